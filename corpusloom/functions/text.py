"""Text expressions. All are built-in Spark functions, so they stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode whitespace and word characters. With the Unicode flag \s covers
# every White_Space character; the four separators x1c-x1f count as whitespace too.
UNICODE = "(?U)"
WS = r"[\s\x1c-\x1f]"
NON_WS = r"[^\s\x1c-\x1f]"
WORD = r"[\p{L}\p{N}_]"
NON_WORD = r"[^\p{L}\p{N}_]"
SPACES = f"{UNICODE}{WS}+"
EDGE_WS = f"{UNICODE}^{WS}+|{WS}+$"
START_WS = f"{UNICODE}^{WS}+"
NOT_LETTER = rf"{UNICODE}[^a-z\s\x1c-\x1f]+"
SENTENCE = r"[^.!?]+[.!?]+"
NEXT_SENTENCE = rf"{UNICODE}(?<=[.!?])(?=[^.!?]){WS}*"
TERMINATORS = (".", "!", "?")


def strip(col: Column) -> Column:
    """Remove leading and trailing Unicode whitespace (``trim`` only removes spaces)."""
    return F.regexp_replace(col, EDGE_WS, "")


def has_text(col: Column) -> Column:
    """True when the string holds anything but whitespace; NULL counts as blank."""
    return F.coalesce(col.rlike(UNICODE + NON_WS), F.lit(False))


def words(col: Column) -> Column:
    return F.filter(F.split(col, SPACES), lambda w: w != "")


def word_count(col: Column) -> Column:
    """Number of words without building them: parts minus the empty first and last."""
    def blank(c: Column) -> Column:
        return c.rlike(UNICODE + WS).cast("int")

    parts = F.size(F.split(col, SPACES))
    return F.when(col == "", 0).otherwise(
        parts - blank(F.left(col, F.lit(1))) - blank(F.right(col, F.lit(1)))
    )


def sentences(col: Column) -> Column:
    """Runs that end in a terminator; a text without any terminator is one sentence.

    The text is cut behind each run of terminators, together with the space that
    follows. Terminators that open the text and a fragment that closes it are no
    sentences. Searching for the runs directly takes quadratic time in a long text
    without terminators.
    """
    opens_with_text = ~F.left(col, F.lit(1)).isin(*TERMINATORS)
    found = F.filter(
        F.split(F.regexp_replace(col, START_WS, ""), NEXT_SENTENCE),
        lambda part, i: F.right(part, F.lit(1)).isin(*TERMINATORS) & ((i > 0) | opens_with_text),
    )
    return F.coalesce(F.nullif(found, F.array().cast("array<string>")), F.array(col))


def letters_only_words(col: Column) -> Column:
    """Lower-case words reduced to a-z; words with no such letter disappear."""
    return words(F.regexp_replace(F.lower(col), NOT_LETTER, ""))


def basename(col: Column) -> Column:
    return F.regexp_extract(col, r"([^/]*)$", 1)
