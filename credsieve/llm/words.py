"""How many words a text has, whatever its script."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from credsieve.functions.pyregex import SPACE_RANGES

#: So many characters of a script that puts no blanks between words count as one word.
CHARACTERS_A_WORD = 5
#: Thai, Lao, Tibetan, Myanmar, Khmer, Han and Kana.
_UNSPACED = (
    r"\x{e01}-\x{eff}\x{f40}-\x{fbc}\x{1000}-\x{109f}\x{1780}-\x{17dd}\x{2e80}-\x{2fdf}\x{3005}-\x{3007}\x{3021}-\x{3029}"
    r"\x{3041}-\x{30ff}\x{31f0}-\x{31ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}\x{ff66}-\x{ff9d}\x{20000}-\x{3ffff}"
)
#: What most texts hold: line feeds, ASCII, the other letters up to the Indic scripts, dashes and quotation marks.
_PLAIN = r"\n\x20-\x7e\x{a1}-\x{dff}\x{2010}-\x{2027}"


def may_lack_blanks(text: Column) -> Column:
    """Some character is white space other than blanks and line feeds, of a script without blanks, or rare."""
    return text.rlike(f"[^{_PLAIN}]")


def word_count(text: Column, odd: Column | None = None) -> Column:
    """Words of a text without outer blanks, 0 for an empty one.

    Blanks part words, every one of them; so do runs of any other white space.
    Where a script writes words without a blank, its characters count.  `odd`
    is `may_lack_blanks` of the text, or of a larger one that it is a part of.
    """
    odd = may_lack_blanks(text) if odd is None else odd
    blanks = F.length(text) - F.length(F.replace(text, F.lit(" "))) + 1
    parts = F.regexp_count(text, F.lit(f"[^{SPACE_RANGES}]+"))
    more = F.floor(F.regexp_count(text, F.lit(f"[{_UNSPACED}]")) / CHARACTERS_A_WORD).cast("int")
    return F.when(text == "", 0).when(odd, F.greatest(blanks, parts) + more).otherwise(blanks)
