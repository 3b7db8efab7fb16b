"""One consistent form for text that looks the same.

``look`` removes characters a reader can't see, folds width and compatibility forms (NFKC), maps
letters that look alike across scripts to one of them, and writes blanks of any kind or number as
one space without outer ones. Letter case, accents and voicing marks stay: they are visible.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters drawn alike, with the one that stands for both.
LOOK_ALIKE = {
    # Greek capitals and small letters
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N",
    "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ν": "v", "ο": "o",
    # Cyrillic capitals and small letters
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H",
    "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "а": "a", "е": "e", "і": "i",
    "ј": "j", "о": "o", "р": "p", "с": "c", "ѕ": "s", "у": "y", "х": "x",
    # dashes, slashes, dots, quotes
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "―": "-", "−": "-", "⁃": "-",
    "⁄": "/", "∕": "/", "·": "・", "•": "・", "‧": "・", "∙": "・", "⋅": "・",
    "‘": "'", "’": "'", "“": '"', "”": '"', "×": "x",
    # kana and the characters drawn like them
    "へ": "ヘ", "べ": "ベ", "ぺ": "ペ", "二": "ニ", "八": "ハ", "力": "カ", "卜": "ト", "口": "ロ",
    "夕": "タ", "工": "エ",
}
_MAP = str.maketrans(LOOK_ALIKE)
_MARKS = str.maketrans({"゛": "\u3099", "゜": "\u309a"})

# Characters that are drawn as a blank (besides what \s knows) and those that aren't drawn at all.
BLANKS = "\\s\u00a0\u115f\u1160\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u2800\u3000\u3164\uffa0"
INVISIBLE = (
    "\u0000-\u0008\u000e-\u001b\u007f-\u0084\u0086-\u009f\u00ad\u034f\u061c\u17b4\u17b5\u180b-\u180f\u200b-\u200f"
    "\u202a-\u202e\u2060-\u206f\ufe00-\ufe0f\ufeff\ufff9-\ufffb"
)
_BLANKS = re.compile(f"[{BLANKS}]+")
_INVISIBLE = re.compile(f"[{INVISIBLE}\U000e0000-\U000e0fff]+")

# Text of these characters alone, single spaces inside, is its own look; the JVM tests that without Python.
_PLAIN = "[!-~가-힣ぁ-ゖァ-ヺー・一-鿿&&[^へべぺ二八力卜口夕工]]"
STABLE = f"^(?:{_PLAIN}+(?: {_PLAIN}+)*)?\\z"  # not $, which a closing line break passes


def look(text: str) -> str:
    """The form shared by all texts that look like this one. ``look(look(x)) == look(x)``."""
    text = _INVISIBLE.sub("", text)
    text = unicodedata.normalize("NFKC", text.translate(_MARKS))
    text = unicodedata.normalize("NFC", _INVISIBLE.sub("", text).translate(_MAP)).translate(_MAP)
    return _BLANKS.sub(" ", text).strip(" ")


@F.pandas_udf(T.StringType())
def _look(s: pd.Series) -> pd.Series:
    return s.map(look, na_action="ignore")


def look_alike(text: Column) -> Column:
    """``look`` as a column. Only text the JVM can't prove stable is sent to Python (as null otherwise)."""
    stable = text.rlike(STABLE)
    return F.coalesce(F.when(stable, text), _look(F.when(~stable, text)))


def id_key(text: Column) -> Column:
    """The id that this text names: its look without letter case; null for null, blank and the word null."""
    key = F.lower(look_alike(text))
    return F.when(~key.isin("", "null"), key)
