"""Column functions that decode landed payloads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from credsieve.functions.text import bind, remove_space

BASE64_FORMAT = r"\A[A-Za-z0-9+/]*={0,2}\z"


def strict_utf8(data: Column) -> Column:
    """Bytes to text, NULL when they are not valid UTF-8."""
    return F.try_validate_utf8(data.cast("string"))


def blob_text(encoding: Column, content: Column) -> Column:
    """Text of a base64 blob; NULL for any other encoding or damaged content.

    The length and alphabet are checked first because the JVM decoder accepts
    payloads that a strict decoder rejects.  Nearly all payloads hold no white
    space but line feeds, which need no pattern to be removed.
    """

    def compacted(joined: Column) -> Column:
        return F.when(joined.rlike(BASE64_FORMAT), joined).otherwise(remove_space(joined))

    def decoded(compact: Column) -> Column:
        sound = (F.char_length(compact) % 4 == 0) & compact.rlike(BASE64_FORMAT)
        return F.when(sound, strict_utf8(F.try_to_binary(compact, F.lit("base64"))))

    joined = F.when(encoding == "base64", F.replace(content, F.lit("\n"), F.lit("")))
    return bind(bind(joined, compacted), decoded)
