"""Visually identical text with different characters.

The Unicode quick-check properties tell which characters can change under normalization. A text is cut into
stable stretches and unstable segments; a segment takes along the one character before it, since a mark or
jamo may compose with that; only segments are normalized, and the results are spliced into the text.
"""

from __future__ import annotations

import re
import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.looks import _BLANKS, _INVISIBLE, BLANKS, INVISIBLE, LOOK_ALIKE, STABLE, look


def quick_check_no(ch: str) -> bool:
    """Whether the character can change, alone or after another one: quick check No or Maybe, a mark, or ours."""
    if unicodedata.combining(ch) or unicodedata.category(ch)[0] == "M" or "ᅠ" <= ch <= "ᇿ" or "ힰ" <= ch <= "ퟻ":
        return True
    return ch in LOOK_ALIKE or ch in "゛゜" or not unicodedata.is_normalized("NFKC", ch) or (ch != " " and bool(_BLANKS.match(ch) or _INVISIBLE.match(ch)))


@cache
def unstable_segments() -> re.Pattern:
    """A run of unstable characters with the character before it. Built once a process, by rule.

    All characters beyond the basic plane count as unstable: few texts have them, and it keeps the class small.
    """
    ranges: list[list[int]] = []
    for k in range(0x10000):
        if not 0xD800 <= k < 0xE000 and quick_check_no(chr(k)):
            if ranges and ranges[-1][1] == k - 1:
                ranges[-1][1] = k
            else:
                ranges.append([k, k])
    body = "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in ranges) + "\\U00010000-\\U0010ffff"
    return re.compile(f"(?s)[^{body}]?[{body}]+")


def _segment(m: re.Match) -> str:
    text = m.group(0)
    lead = " " if text[0] == " " or _BLANKS.match(text[0]) else ""
    done = look(text)
    if not done:
        return " " if _BLANKS.search(text) else ""
    return lead + done + (" " if _BLANKS.search(_INVISIBLE.sub("", text)[-1:]) else "")


_SPACES = re.compile(" {2,}")


def one_form(text: str) -> str:
    """``look(text)``, with only the unstable segments normalized."""
    if text.isascii() and text.isprintable():
        return _SPACES.sub(" ", text).strip(" ")
    return _SPACES.sub(" ", unstable_segments().sub(_segment, text)).strip(" ")


@F.pandas_udf(T.StringType())
def _one_form(s: pd.Series) -> pd.Series:
    return s.map(one_form, na_action="ignore")


def canonical(text: Column) -> Column:
    """The one form of a text column. The JVM passes text that it can prove stable; the rest goes to Python.

    Null stays null; text of blanks and invisible characters is the empty string; texts of any length are
    scanned once. Letter case, accents and voicing marks are kept.
    """
    stable = text.rlike(STABLE)
    return F.coalesce(F.when(stable, text), _one_form(F.when(~stable, text)))


def same_look(left: DataFrame, name: str, right: DataFrame, *names: str) -> DataFrame:
    """Rows of ``left`` whose ``name`` has the look of some text in ``names`` of ``right`` but is none of those
    of that look, character by character.

    A semi join on the one form, then an anti join on the text itself: texts that are the same have the same
    look, so the second needs no look. Both sides on the right are distinct before they are shuffled; a name
    that a third of the rows have is split by adaptive skew handling of the left side. Null names match
    nothing; a blank name has the look of a blank one. Repeated rows of ``left`` stay; an empty side gives no row.
    """
    texts = right.select(F.explode(F.array(*(F.col(f"`{c}`") for c in names))).alias("__text")).dropna().distinct()
    forms = texts.select(canonical(F.col("__text")).alias("__form")).distinct()
    rows = left.filter(F.col(f"`{name}`").isNotNull()).withColumn("__form", canonical(F.col(f"`{name}`")))
    alike = rows.join(forms, "__form", "left_semi").drop("__form")
    return alike.join(texts, alike[name] == texts["__text"], "left_anti")


def forms(names: DataFrame, text: str) -> DataFrame:
    """(form, variants, rows) of the texts: in how many ways a form is written, and how often."""
    each = names.groupBy(F.col(text).alias("text")).agg(F.count("*").alias("rows")).dropna(subset=["text"])
    return each.groupBy(canonical(F.col("text")).alias("form")).agg(F.count("*").alias("variants"), F.sum("rows").alias("rows"))


__all__ = ["BLANKS", "INVISIBLE", "canonical", "forms", "one_form", "same_look"]
