"""Whitening of vectors by the exact characteristic polynomial of their scatter.

Entries become integers, so the scatter matrix over all distinct vectors is an
integer matrix, summed without rounding by Spark.  Its characteristic polynomial
is found modulo many primes, each in a task of its own (reduction to Hessenberg
form, then the recurrence over its leading blocks), and put together by Chinese
remainders.  All roots of it are real, so the changes of sign in the
coefficients of the shifted polynomial count the roots above a point exactly;
halving intervals isolates the largest roots to far more digits than a double
has, multiple ones included.  For each, inverse iteration with as many digits
finds the null space of the matrix less the root: the components.

What reaches the driver are sums and residues whose number depends on the width
of the vectors alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Context, Decimal, localcontext
from fractions import Fraction
from functools import partial, reduce
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from credsieve.session import keep

SCALE = 64
COMPONENTS = 16
#: Entries are cut off at this absolute value, times SCALE, so that all arithmetic on them fits.
LARGEST = 2.0**60
_LIMB = 16
_ROWS = 1 << 14
_FLUSH = 256
_ROOT_BITS = 200
_DIGITS = 90
_SETTLED = Decimal(10) ** -30
_TURNS = 12


def finite(column: str) -> Column:
    """Whether a vector is not null and holds no null and no non-finite entry."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad, F.lit(False))


def whole_numbers(column: str, width: int) -> Column:
    """floor(64 c) of every entry c, as longs; shorter vectors end with zeros."""
    limit = F.lit(LARGEST)
    entries = F.transform(column, lambda c: F.floor(F.greatest(F.least(c.cast("double") * SCALE, limit), -limit)).cast("long"))
    return F.concat(entries, F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size(column)))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def _limbs(y: np.ndarray) -> list[np.ndarray]:
    """Parts of 16 bits, the last one with the sign: products of these sum up in doubles without rounding."""
    largest = max(abs(int(y.max(initial=0))), abs(int(y.min(initial=0))))
    parts = []
    while largest >> (_LIMB - 1):
        parts.append((y & ((1 << _LIMB) - 1)).astype(np.float64))
        y, largest = y >> _LIMB, largest >> _LIMB
    return [*parts, y.astype(np.float64)]


def _moments(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """(i, j, power, value): sums of y_i y_j, and of y_i where j is -1, in units of 2 ** power."""
    held: dict[int, np.ndarray] = {}
    blocks = 0

    def flush():
        rows, columns = np.triu_indices(width)
        i, j = np.concatenate((rows, np.arange(width))), np.concatenate((columns, np.full(width, -1)))
        for power, sums in held.items():
            value = np.concatenate((sums[:width][rows, columns], sums[width]))
            some = value != 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(i[some]), pa.array(j[some]), pa.array(np.full(some.sum(), power)), pa.array(value[some])],
                ["i", "j", "power", "value"],
            )
        held.clear()

    for batch in batches:
        y = _matrix(batch.column("y"), width)
        for start in range(0, len(y), _ROWS):
            parts = _limbs(y[start : start + _ROWS])
            for a, left in enumerate(parts):
                for b, right in enumerate(parts):
                    sums = held.setdefault(_LIMB * (a + b), np.zeros((width + 1, width), np.int64))
                    sums[:width] += (left.T @ right).astype(np.int64)
                held.setdefault(_LIMB * a, np.zeros((width + 1, width), np.int64))[width] += left.sum(axis=0).astype(np.int64)
            blocks += 1
            if blocks % _FLUSH == 0:
                yield from flush()
    yield from flush()


def scatter(vectors: DataFrame, width: int) -> tuple[int, list[int], list[list[int]]]:
    """Number of rows, sums, and n * sum(y y') - sum(y) sum(y)' of integer vectors in column `y`, exactly."""
    n = vectors.count()
    rows = vectors.select("y").mapInArrow(partial(_moments, width=width), "i bigint, j bigint, power bigint, value bigint")
    sums = rows.groupBy("i", "j", "power").agg(F.sum(F.col("value").cast("decimal(20,0)")).alias("value")).collect()
    total, products = [0] * width, [[0] * width for _ in range(width)]
    for r in sums:
        value = int(r.value) << r.power
        if r.j < 0:
            total[r.i] += value
        else:
            products[r.i][r.j] += value
    for i in range(width):
        for j in range(i, width):
            products[i][j] = products[j][i] = n * products[i][j] - total[i] * total[j]
    return n, total, products


def _is_prime(n: int) -> bool:
    if any(n % p == 0 for p in (2, 3, 5, 7)):
        return n in (2, 3, 5, 7)
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):  # enough below 3.2e9
        x = pow(base, odd, n)
        if x in (1, n - 1):
            continue
        if not any((x := x * x % n) == n - 1 for _ in range(twos - 1)):
            return False
    return True


def primes(bits: int) -> list[int]:
    """The largest primes below 2 ** 31 whose product has more than so many bits."""
    found, product, n = [], 1, (1 << 31) - 1
    while product.bit_length() <= bits:
        if _is_prime(n):
            found.append(n)
            product *= n
        n -= 2
    return found


def polynomial_modulo(matrix: np.ndarray, p: int) -> list[int]:
    """Coefficients of det(x - matrix) modulo a prime, lowest first."""
    h, d = matrix.astype(np.int64) % p, len(matrix)
    for k in range(1, d - 1):
        below = np.flatnonzero(h[k:, k - 1])
        if not len(below):
            continue
        pivot = k + int(below[0])
        if pivot != k:
            h[[k, pivot]] = h[[pivot, k]]
            h[:, [k, pivot]] = h[:, [pivot, k]]
        factors = h[k + 1 :, k - 1] * pow(int(h[k, k - 1]), -1, p) % p
        h[k + 1 :] = (h[k + 1 :] - factors[:, None] * h[k] % p) % p
        # the inverse change of basis, on columns; at most d products are added, reduced one by one
        h[:, k] = (h[:, k] + (h[:, k + 1 :] * factors % p).sum(axis=1)) % p
    blocks = [np.array([1] + [0] * d, np.int64)]
    for k in range(d):
        last = blocks[k]
        block = np.roll(last, 1)
        block[0] = 0
        block = (block - h[k, k] * last) % p
        under = 1
        for i in range(k - 1, -1, -1):
            under = under * int(h[i + 1, i]) % p
            block = (block - int(h[i, k]) * under % p * blocks[i]) % p
        blocks.append(block)
    return blocks[d].tolist()


def _residues(batches: Iterator[pa.RecordBatch], matrix: list[list[int]]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for p in batch.column("p").to_pylist():
            small = np.array([[x % p for x in row] for row in matrix], np.int64).reshape(len(matrix), len(matrix))
            yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([polynomial_modulo(small, p)], pa.list_(pa.int64()))], ["p", "c"])


def characteristic(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """Coefficients of det(x - matrix), lowest first, of a symmetric integer matrix without negative eigenvalues."""
    d, trace = len(matrix), sum(matrix[i][i] for i in range(len(matrix)))
    # the mean of the roots bounds every coefficient: all are at most (1 + mean) ** d
    moduli = primes(((trace // d + 2) ** d).bit_length() + 1)
    rows = spark.createDataFrame([(p,) for p in moduli], "p bigint").repartition(min(len(moduli), 512))
    found = rows.mapInArrow(partial(_residues, matrix=matrix), "p bigint, c array<bigint>").collect()
    product = reduce(lambda a, b: a * b, moduli, 1)
    total = [0] * (d + 1)
    for r in found:
        others = product // r.p
        factor = others * pow(others % r.p, -1, r.p)
        for i, c in enumerate(r.c):
            total[i] += factor * c
    return [c - product if 2 * c > product else c for c in (t % product for t in total)]


def _above(polynomial: list[int], numerator: int, bits: int) -> int:
    """How many roots, with their multiplicity, are larger than numerator / 2 ** bits."""
    d = len(polynomial) - 1
    shifted = [c << (bits * (d - i)) for i, c in enumerate(polynomial)]
    for i in range(d):
        for j in range(d - 1, i - 1, -1):
            shifted[j] += numerator * shifted[j + 1]
    signs = [c > 0 for c in shifted if c]
    return sum(a != b for a, b in zip(signs, signs[1:], strict=False))


def _sign(polynomial: list[int], numerator: int, bits: int) -> int:
    value, scale = 0, 0
    for c in reversed(polynomial):
        value = value * numerator + (c << scale)
        scale += bits
    return (value > 0) - (value < 0)


def largest_roots(polynomial: list[int], wanted: int, root_bits: int = _ROOT_BITS) -> list[tuple[Fraction, int]]:
    """The largest positive roots and their multiplicities, falling, `wanted` of them at least (if there are so many).

    The polynomial is monic and all its roots are real and not negative.  A
    root is known to `root_bits` bits of the largest; roots that are closer
    than that are returned as one.
    """
    zeros = next(i for i, c in enumerate(polynomial) if c)
    polynomial = polynomial[zeros:]
    if len(polynomial) == 1:
        return []
    top = -polynomial[-2]  # the sum of all roots
    fine = max(0, root_bits - top.bit_length() + len(polynomial).bit_length())
    found: list[tuple[Fraction, int]] = []
    # intervals (low, high] in units of 2 ** -bits with the roots above each end, largest last
    left = [(0, top, 0, len(polynomial) - 1, 0)]
    while left and sum(m for _, m in found) < wanted:
        low, high, bits, above_low, above_high = left.pop()
        held = above_low - above_high
        if not held:
            continue
        if held == 1:
            found.append((_halved(polynomial, low, high, bits, fine), 1))
        elif high - low <= 1 and bits >= fine:
            found.append((Fraction(2 * high - 1, 1 << (bits + 1)), held))
        else:
            if high - low <= 1:
                low, high, bits = low << 16, high << 16, bits + 16
            middle = (low + high) // 2
            above = _above(polynomial, middle, bits)
            left += [(low, middle, bits, above_low, above), (middle, high, bits, above, above_high)]
    return found


def _halved(polynomial: list[int], low: int, high: int, bits: int, fine: int) -> Fraction:
    """The only root in (low, high], which is simple."""
    beyond = _sign(polynomial, high, bits)
    if not beyond:
        return Fraction(high, 1 << bits)
    while True:
        if high - low <= 1:
            if bits >= fine:
                return Fraction(low + high, 1 << (bits + 1))
            low, high, bits = low << 16, high << 16, bits + 16
        middle = (low + high) // 2
        here = _sign(polynomial, middle, bits)
        if not here:
            return Fraction(middle, 1 << bits)
        low, high = (low, middle) if here == beyond else (middle, high)


def null_space(matrix: list[list[int]], root: Fraction, many: int, digits: int = _DIGITS) -> list[list[Decimal]]:
    """`many` orthonormal vectors that the matrix less the root (almost) sends to zero."""
    d = len(matrix)
    largest = max(abs(x) for row in matrix for x in row)
    with localcontext(Context(prec=digits + len(str(largest)))):
        shift = Decimal(root.numerator) / Decimal(root.denominator)
        tiny = Decimal(largest).scaleb(-digits)
        rows = [[Decimal(x) - (shift if i == j else 0) for j, x in enumerate(row)] for i, row in enumerate(matrix)]
        steps = []
        for k in range(d):  # elimination with the largest pivot of the column
            pivot = max(range(k, d), key=lambda i: abs(rows[i][k]))
            rows[k], rows[pivot] = rows[pivot], rows[k]
            if abs(rows[k][k]) < tiny:
                rows[k][k] = tiny
            factors = []
            for i in range(k + 1, d):
                factor = rows[i][k] / rows[k][k]
                factors.append(factor)
                if factor:
                    rows[i] = [*rows[i][: k + 1], *(a - factor * b for a, b in zip(rows[i][k + 1 :], rows[k][k + 1 :], strict=True))]
            steps.append((pivot, factors))

        def solved(vector):
            x = list(vector)
            for k, (pivot, factors) in enumerate(steps):
                x[k], x[pivot] = x[pivot], x[k]
                for i, factor in enumerate(factors, k + 1):
                    x[i] -= factor * x[k]
            for k in range(d - 1, -1, -1):
                x[k] = (x[k] - sum(a * b for a, b in zip(rows[k][k + 1 :], x[k + 1 :], strict=True))) / rows[k][k]
            return x

        def orthonormal(vectors):
            out = []
            for v in vectors:
                for _ in range(2):
                    size = sum(a * a for a in v).sqrt()
                    v = [a / size for a in v]
                    for u in out:
                        shared = sum(a * b for a, b in zip(u, v, strict=True))
                        v = [a - shared * b for a, b in zip(v, u, strict=True)]
                size = sum(a * a for a in v).sqrt()
                lead = max(v, key=abs)
                out.append([a / size if lead > 0 else -a / size for a in v])
            return out

        deal = np.random.default_rng(d)
        vectors = orthonormal([[Decimal(int(x)) for x in deal.integers(-(10**9), 10**9, d)] for _ in range(many)])
        for _ in range(_TURNS):
            before, vectors = vectors, orthonormal([solved(v) for v in vectors])
            # one vector repeats itself; of several, what they span does
            left = Decimal(0)
            for v in vectors:
                for u in before:
                    shared = sum(a * b for a, b in zip(u, v, strict=True))
                    v = [a - shared * b for a, b in zip(v, u, strict=True)]
                left = max(left, max(abs(a) for a in v))
            if left < _SETTLED:
                break
        return vectors


@dataclass
class Whitener:
    """Components of the distinct vectors of a table: `vectors` by rows, their eigenvalues, and what a row needs."""

    width: int
    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    explained: np.ndarray

    def whiten(self, y: np.ndarray) -> np.ndarray:
        """Projections of centred rows, over the root of each eigenvalue."""
        mean = [divmod(s, self.n) for s in self.sums]
        near = y - np.array([q for q, _ in mean], np.int64)
        return (near - np.array([r / self.n for _, r in mean])) @ (self.vectors / np.sqrt(self.values)[:, None]).T

    def deviations(self, y: np.ndarray) -> list[int | None]:
        """Sums of (n x - S) ** 2, exact; None where a long cannot hold it."""
        largest = self.n * max(abs(int(y.max(initial=0))), abs(int(y.min(initial=0)))) + max((abs(s) for s in self.sums), default=0)
        if largest**2 * self.width < 1 << 63:
            return ((self.n * y - np.array(self.sums, np.int64)) ** 2).sum(axis=1).tolist()
        exact = ((self.n * y.astype(object) - np.array(self.sums, object)) ** 2).sum(axis=1).tolist()
        return [x if x < 1 << 63 else None for x in exact]


def fit(fitted: DataFrame, width: int, components: int = COMPONENTS) -> Whitener:
    """The whitener of integer vectors `y` (distinct rows); components with an eigenvalue of zero are left out."""
    n, sums, matrix = scatter(fitted, width)
    common = reduce(gcd, (x for row in matrix for x in row), 0)
    if not common:
        return Whitener(width, n, sums, np.zeros((0, width)), np.zeros(0), np.zeros(0))
    matrix = [[x // common for x in row] for row in matrix]
    trace = sum(matrix[i][i] for i in range(width))
    vectors, values, shares = [], [], []
    for root, many in largest_roots(characteristic(fitted.sparkSession, matrix), components):
        for v in null_space(matrix, root, many):
            vectors.append([float(a) for a in v])
            values.append(float(root * common / n**2))
            shares.append(float(root / trace))
    return Whitener(width, n, sums, *(np.array(x[:components]) for x in (vectors, values, shares)))


def _spread(batches: Iterator[pa.RecordBatch], model: Whitener) -> Iterator[pa.RecordBatch]:
    """(i, j, value) of the sums of w_i w_j, and of w_i where j is -1."""
    many = len(model.values)
    sums = np.zeros((many + 1, many))
    for batch in batches:
        w = model.whiten(_matrix(batch.column("y"), model.width))
        sums[:many] += w.T @ w
        sums[many] += w.sum(axis=0)
    i, j = np.indices((many + 1, many))
    i[many], j[many] = np.arange(many), -1
    yield pa.RecordBatch.from_arrays([pa.array(x.ravel()) for x in (i, j, sums)], ["i", "j", "value"])


def identity_error(fitted: DataFrame, model: Whitener) -> float:
    """The largest absolute entry of the covariance of the whitened fit list less the identity."""
    many = len(model.values)
    rows = fitted.select("y").mapInArrow(partial(_spread, model=model), "i bigint, j bigint, value double")
    got = {(r.i, r.j): r.value for r in rows.groupBy("i", "j").agg(F.sum("value").alias("value")).collect()}
    mean = [got[i, -1] / model.n for i in range(many)]
    return max(abs(got[i, j] / model.n - mean[i] * mean[j] - (i == j)) for i in range(many) for j in range(many))


def _whitened(batches: Iterator[pa.RecordBatch], model: Whitener, error: float) -> Iterator[pa.RecordBatch]:
    many = len(model.values)
    for whole in batches:
        for start in range(0, whole.num_rows, _ROWS):
            batch = whole.slice(start, _ROWS)
            y, rows = _matrix(batch.column("y"), model.width), batch.num_rows
            apart = pa.array(model.deviations(y), pa.int64()).take(pa.array(np.repeat(np.arange(rows), many)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(pa.array(np.repeat(np.arange(rows), many))),
                    pa.array(np.tile(np.arange(1, many + 1, dtype=np.int32), rows)),
                    pa.array(np.full(rows * many, model.n)),
                    apart,
                    pa.array(model.whiten(y).ravel()),
                    pa.array(np.tile(model.explained, rows)),
                    pa.array(np.full(rows * many, error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )


def whitened(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of `embeddings` (vec_id, embedding).

    Vectors that are null or hold null or non-finite entries are dropped; all
    others take part, all-zero ones too.  An entry c counts as
    x = floor(64 c) + 1000000 (beyond 2 ** 60, as that; the constant drops out of all
    that is centred, so the code goes without).  Shorter vectors end
    with zeros.  The fit list is every distinct x-vector once; repeated rows
    and equal vectors therefore change nothing but their own result rows.
    Rows have one result for each of the up to `components` components with an
    eigenvalue above zero: none if all vectors are equal or there are none.
    `deviation` is null where a long cannot hold it.  Vectors with a null
    vec_id are whitened like others.  Other columns are not read.

    Equal eigenvalues share a space; its basis is one of many, the same for all rows.
    """
    good = embeddings.where(finite("embedding")).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    width = good.agg(F.max(F.size("embedding"))).first()[0] or 0
    schema = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    if not width:
        return embeddings.sparkSession.createDataFrame([], schema)
    rows = good.select("vec_id", whole_numbers("embedding", width).alias("y"))
    fitted = keep(rows.select("y").distinct(), "fit")
    model = fit(fitted, width, components)
    if not len(model.values):
        return embeddings.sparkSession.createDataFrame([], schema)
    return rows.mapInArrow(partial(_whitened, model=model, error=identity_error(fitted, model)), schema)
