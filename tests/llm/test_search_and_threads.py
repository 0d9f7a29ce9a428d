"""Nearest neighbours and conversations."""

import numpy as np
import pytest

from credsieve.llm import ann_forest, quotes


def brute_force(ids, points, query, count):
    scores = points @ points[ids.index(query)]
    order = sorted((i for i in range(len(ids)) if ids[i] != query), key=lambda i: (-scores[i], ids[i]))[:count]
    return [(ids[i], float(scores[i])) for i in order]


@pytest.mark.parametrize("share, least", [(1.0, 1.0), (ann_forest.LEAF_SHARE, 0.9)])
def test_nearest(spark, share, least):
    deal = np.random.default_rng(1)
    centres = deal.standard_normal((30, 24)) * 2
    points = (centres[deal.integers(0, 30, 3000)] + deal.standard_normal((3000, 24))) * deal.uniform(0.2, 3, (3000, 1))
    points = points.astype(np.float32).astype(float)
    points[500:900] = points[20]  # a hot vector: ties go by id
    ids = list(range(3000))
    rows = [(i, p.tolist(), "s", "r") for i, p in enumerate(points)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string, rank string")
    found = ann_forest.nearest(table, share=share, rows_per_shard=700, queries_per_block=60).collect()
    by_query = {}
    for r in sorted(found, key=lambda r: (r.query_id, r["rank"])):
        by_query.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert sorted(by_query) == ids[::20]
    hits = 0
    for query, got in by_query.items():
        want = brute_force(ids, points, query, 20)
        assert len(got) == 20 and got == sorted(got, key=lambda x: (-x[1], x[0]))
        scores = points[[i for i, _ in got]] @ points[query]
        assert np.allclose([s for _, s in got], scores, rtol=0, atol=1e-9)
        if share == 1.0:
            assert [i for i, _ in got] == [i for i, _ in want]
        hits += len({i for i, _ in got} & {i for i, _ in want})
    assert hits >= least * 20 * len(by_query)


def test_nearest_with_few_and_broken_vectors(spark):
    rows = [(0, [1.0, 0.0]), (20, None), (40, [0.0, 0.0]), (60, [float("nan"), 1.0]), (80, [None, 1.0]), (1, [2.0]), (2, [0.5, 9.0]),
            (2, [0.5, 9.0]), (None, [1.0, 1.0]), (100, [float("inf"), 1.0])]
    found = ann_forest.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found) == [(0, 1, 1, 2.0), (0, 2, 2, 0.5)]
    for few in ([], rows[:1], rows[1:4]):
        assert ann_forest.nearest(spark.createDataFrame(few, "vec_id long, embedding array<float>")).collect() == []


@pytest.mark.parametrize("count", [9, 15, 21, 25, 30, 40, 60, 190, 260, 400])
def test_nearest_of_small_tables(spark, count):
    points = np.random.default_rng(count).standard_normal((count, 16))
    points[: count // 3] = points[0]  # equal vectors fill leaves of their own
    ids = list(range(count))
    table = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "vec_id long, embedding array<double>")
    found = ann_forest.nearest(table, every=2).collect()
    hits = 0
    for query in ids[::2]:
        got = [r.vec_id for r in sorted((r for r in found if r.query_id == query), key=lambda r: r["rank"])]
        want = [i for i, _ in brute_force(ids, points, query, 20)]
        assert len(got) == min(20, count - 1)
        if count < 200:
            assert got == want
        hits += len(set(got) & set(want))
    assert hits >= 0.9 * len(ids[::2]) * min(20, count - 1)


def test_tree_leaves_hold_every_point():
    deal = np.random.default_rng(3)
    points = np.concatenate([deal.standard_normal((500, 6)), np.ones((300, 6))])
    tree = ann_forest.grow(points, 16, deal)
    leaves = tree.leaf_of(points)
    assert set(leaves) == set(range(tree.leaves))
    forest = ann_forest.Forest([tree], 5, 1.0)
    assert sorted(forest.reached(points[0], 1.0)) == list(range(tree.leaves))
    assert leaves[0] == forest.reached(points[0], 1e-9)[0]


def messages(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, depth string, link string")


def test_quotes_make_threads(spark):
    first = "How do I read a table\nfrom a folder of files?\n\nThanks a lot."
    reply = f"Ann wrote:\n> How do I READ a table\n>  from a folder of files?\n>\n> Thanks a lot.\n\nUse the reader."
    nested = "Bob schrieb:\n>> How do I read a table\n>> from a folder of files?\n> Use the reader.\n\nThat works."
    wrapped = "> How do I read a table from a\n> folder of files?\nMe too."
    long_one = "this passage has more than eight words so that it links far away"
    rows = [
        (1, 0, "a", first, "x", "y"), (1, 1, "b", reply, "x", "y"), (1, 2, "a", "Something else.", "x", "y"), (1, 3, "c", nested, "x", "y"),
        (1, 4, "d", wrapped, "x", "y"), (1, 5, "e", "> words that nobody said\nNo.", "x", "y"),
        (2, 0, "a", long_one, "x", "y"), (3, 7, "b", f"> {long_one}\nYes.", "x", "y"), (3, 9, "b", "> Use the reader.\nshort", "x", "y"),
        (4, 0, "z", None, "x", "y"), (4, 1, "z", "", "x", "y"), (None, 3, "z", "> a\nb", "x", "y"), (4, None, "z", "c > d", "x", "y"),
        (2, 0, "a", long_one, "x", "y"),
    ]
    found = quotes.conversations(messages(spark, rows)).collect()
    assert len(found) == len(rows)
    got = {(r.conv_id, r.turn): (r.text, r.link, r.parent_conv, r.parent_turn, r.thread_conv, r.thread_turn, r.depth) for r in found}
    assert got[1, 0] == (first, "none", None, None, 1, 0, 0)
    assert got[1, 1] == ("Use the reader.", "quote", 1, 0, 1, 0, 1)
    assert got[1, 2] == ("Something else.", "previous", 1, 1, 1, 0, 2)
    assert got[1, 3] == ("That works.", "quote", 1, 1, 1, 0, 2)
    assert got[1, 4] == ("Me too.", "previous", 1, 3, 1, 0, 3) or got[1, 4][1:4] == ("quote", 1, 0)
    assert got[1, 5] == ("No.", "previous", 1, 4, 1, 0, got[1, 4][6] + 1)
    assert got[3, 7] == ("Yes.", "quote", 2, 0, 2, 0, 1)
    assert got[3, 9] == ("short", "previous", 3, 7, 2, 0, 2)
    assert got[4, 0][:2] == (None, "none") and got[4, 1][:4] == ("", "previous", 4, 0)
    assert got[None, 3][:2] == ("b", "none") and got[4, None] == ("c > d", "none", None, None, 4, None, 0)


@pytest.mark.parametrize("passage", ["漢字仮名交じり文" * 6, "ข้อความภาษาไทยที่ยาวพอสมควร" * 3, "\u00a0".join("abcdefghij")])
def test_far_quotes_without_blanks(spark, passage):
    rows = [(1, 0, "a", passage, "x", "y"), (2, 0, "b", f"> {passage}\nYes.", "x", "y"), (3, 0, "c", passage[:5], "x", "y"),
            (4, 0, "d", f"> {passage[:5]}\nNo.", "x", "y")]
    found = {r.conv_id: (r.link, r.parent_conv) for r in quotes.conversations(messages(spark, rows)).collect()}
    assert found == {1: ("none", None), 2: ("quote", 1), 3: ("none", None), 4: ("none", None)}


def test_a_long_conversation_and_a_popular_first_turn(spark):
    rows = [(1, i, "u", f"message number {i}", None, None) for i in range(0, 1400, 2)]
    rows += [(i, 0, "u", "the same first turn that very many conversations share", None, None) for i in range(10, 300)]
    rows += [(i, 1, "v", "> the same first turn that very many conversations share\nyes", None, None) for i in range(10, 300)]
    found = {(r.conv_id, r.turn): r for r in quotes.conversations(messages(spark, rows)).collect()}
    assert len(found) == len(rows)
    assert all(found[1, i].depth == i // 2 and found[1, i].thread_turn == 0 for i in range(0, 1400, 2))
    assert all((found[i, 1].link, found[i, 1].parent_conv, found[i, 1].text) == ("quote", i, "yes") for i in range(10, 300))


def test_no_messages(spark):
    assert quotes.conversations(messages(spark, [])).collect() == []
