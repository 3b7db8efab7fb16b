"""What a product's name says: grade, scale, model number, series, variant, contents, and the model's name.

Names come in Japanese, Korean and Latin letters; the model's name is brought to one spelling in Latin letters,
syllable by syllable. Grades are fixed values of the trade; variants and sales talk come from a ``Lexicon`` that is
learnt from the names. What no rule reads stays and tells names apart.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import groupby
from zlib import crc32

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.run import cut
from .lexicon import Lexicon, bare, learn, loose, strings, where_begun, words_of
from .lookalike import canonical, one_form

# Grades as they are written, longest first where one begins another.
GRADES = {
    "figure-rise standard": "FRS", "figure rise standard": "FRS", "figurerise standard": "FRS", "피규어라이즈 스탠다드": "FRS",
    "피규어라이즈스탠다드": "FRS", "フィギュアライズスタンダード": "FRS", "entry grade": "EG", "엔트리 그레이드": "EG", "엔트리그레이드": "EG",
    "エントリーグレード": "EG", "perfect grade": "PG", "퍼펙트 그레이드": "PG", "퍼펙트그레이드": "PG", "パーフェクトグレード": "PG",
    "master grade sd": "MGSD", "마스터 그레이드 sd": "MGSD", "mgsd": "MGSD", "master grade": "MG", "마스터 그레이드": "MG",
    "마스터그레이드": "MG", "マスターグレード": "MG", "real grade": "RG", "리얼 그레이드": "RG", "리얼그레이드": "RG", "リアルグレード": "RG",
    "high grade": "HG", "하이 그레이드": "HG", "하이그레이드": "HG", "ハイグレード": "HG", "리본 100": "RE", "re/100": "RE", "re 100": "RE",
    "30ms": "30MS", **{f"hg{x}": "HG" for x in ("uc", "ce", "ac", "aw", "fc", "bf", "bd", "bc", "ibo", "gto")}, "hg": "HG", "mg": "MG", "rg": "RG", "pg": "PG", "sd": "SD", "eg": "EG", "re": "RE",
}
_DECAL = re.compile("데 ?칼|デカール|decal|水転写", re.I)

_VOWEL = dict(zip("ㅏㅐㅑㅒㅓㅔㅕㅖㅗㅘㅙㅚㅛㅜㅝㅞㅟㅠㅡㅢㅣ", "a e ya ye o e yo ye o wa we we yo u wo we wi yu u i i".split(), strict=True))
_LEAD = dict(zip("ㄱㄲㄴㄷㄸㄹㅁㅂㅃㅅㅆㅇㅈㅉㅊㅋㅌㅍㅎ", "g k n d t r m b p s s - z ch ch k t p h".split(), strict=True))
_LEADS, _VOWELS = list(_LEAD.values()), list(_VOWEL.values())
_TAILS = ["", "k", "k", "k", "n", "n", "n", "t", "r", "r", "r", "r", "r", "r", "r", "r", "m", "p", "p", "t", "t", "n", "t", "t", "k", "t", "p", "t"]
_FIX = {"si": "shi", "zi": "ji", "chu": "tsu", "hu": "fu", "su": "su"}
_KANA_VOWELS = "aiueo"
_KANA_ROWS = {
    "ア": "-", "カ": "k", "ガ": "g", "サ": "s", "ザ": "z", "タ": "t", "ダ": "d", "ナ": "n", "ハ": "h", "バ": "b", "パ": "p", "マ": "m", "ラ": "r",
}


def _kana() -> dict[str, str]:
    rows = ["アイウエオ", "カキクケコ", "ガギグゲゴ", "サシスセソ", "ザジズゼゾ", "タチツテト", "ダヂヅデド", "ナニヌネノ", "ハヒフヘホ", "バビブベボ", "パピプペポ", "マミムメモ", "ラリルレロ"]
    out = {k: (_KANA_ROWS[row[0]] + v).replace("-", "") for row in rows for k, v in zip(row, _KANA_VOWELS, strict=True)}
    return out | {"シ": "shi", "ジ": "ji", "チ": "chi", "ツ": "tsu", "ヂ": "ji", "ヅ": "zu", "フ": "fu", "ヤ": "ya", "ユ": "yu", "ヨ": "yo", "ワ": "wa", "ヲ": "o", "ン": "n", "ヴ": "vu"}


KANA = _kana()
_SMALL = {"ャ": "ya", "ュ": "yu", "ョ": "yo", "ァ": "a", "ィ": "i", "ゥ": "u", "ェ": "e", "ォ": "o"}


def syllables(text: str) -> list[str]:
    """The syllables of a name in Latin letters. Katakana, Hangul and Latin spellings of a name give the same;
    a closing n is a syllable's end. Other characters are left out."""
    out: list[str] = []
    for ch in text:
        k = ord(ch) - 0xAC00
        if 0 <= k < 11172:
            lead, vowel, tail = _LEADS[k // 588], _VOWELS[k % 588 // 28], _TAILS[k % 28]
            s = vowel if lead == "-" else lead + vowel
            out.append(_FIX.get(s, s) + tail)
        elif ch == "ン" and out:
            out[-1] += "n"
        elif ch in KANA:
            out.append(KANA[ch])
        elif ch in _SMALL and out:
            out[-1] = out[-1].rstrip("aiueo") + _SMALL[ch]
    if not out:
        out = re.findall(r"(?:ts|sh|ch|[bcdfghjklmnpqrstvwxyz])?y?[aiueo]+(?:n(?![aiueo]))?|[^aiueo\W\d]+", text.lower())
    return out


@dataclass(frozen=True)
class Name:
    """``key``: the syllables of the model's name, joined by spaces. Empty strings where the name doesn't say."""

    key: str
    latin: str
    grade: str
    scale: str
    code: str
    variant: str
    contents: str
    series: str
    rest: str
    either: str  # the key if a closing syllable that may mean a variant belongs to the name; else empty
    size: str  # in millimetres


_SCALE = re.compile(r"(?:(?<![\d/])1 ?[/:] ?(\d{2,3})(?!\d)|(\d{2,3})분의 ?1)(?: ?스케일| ?scale)?", re.I)
_SIZE = re.compile(r"(?:약|높이|전고|全高|約)? ?(?<![/:\d.])(?<![/:] )(\d+(?:\.\d+)?) ?(cm|mm|센티|밀리)(?![a-z])", re.I)
_UNIT = re.compile("[cm]m|센티|밀리", re.I)  # in every size
_CODE = re.compile(r"(?<![A-Za-z0-9])(?!re 100)([A-Za-z]{2,3})(?:-| (?!\d+ ?(?:분의|cm|mm|센티)))(\d{2,4})([A-Za-z]?)(?![A-Za-z0-9/:.])", re.I)
_SET = re.compile(r"x ?(\d)\b|(\d) ?(?:개|박스|체|体|個|箱|點|点)(?: ?(?:세트|묶음|セット))?|(?<![가-힣])(두|세|네|다섯) ?개 ?(?:묶음|세트)|(?:묶음|세트|セット)", re.I)
_COUNT = {"두": "2", "세": "3", "네": "4", "다섯": "5"}
_BRACKET = re.compile(r"^\[([^\]]{1,20})\]")
_LATIN = re.compile(r"\(([A-Za-z][A-Za-z0-9 .\-']{2,60})\)")
_VER = re.compile(r"(?:ver\.? ?|버 ?전 ?|version ?)(\d(?:\.\d)?)(?![\d/:.])|(?<![\d.])(\d) ?버 ?전|(?<![\d./:])(\d\.\d)(?![\d./:])|\bver\. ?([a-z]{1,8})\b", re.I)
_TYPE = re.compile(r"(?:type|타 ?입|タイプ) ?-?([A-Z])\b|(?<![A-Za-z])([A-Z]) ?(?:타 ?입|タイプ)", re.I)
_ROMAN = re.compile(r"(?<![A-Za-z])(I{2,3}|IV|VI{0,3})(?![A-Za-z])|(?<=[가-힣ァ-ヺー ])([2-9])(?:호기?|号機?)?(?![\d가-힣./:])")
_NUMBER = {"II": "2", "III": "3", "IV": "4", "V": "5", "VI": "6", "VII": "7", "VIII": "8"}
_REMARK = re.compile(r"\*[^*]{1,30}\*|[!★♥♡☆●■◆]+")
_KAI = re.compile(r"(?:(?<=[ァ-ヺー])改|(?<=[가-힣])( ?)(개|카 ?이))$")
# Affixes that the rules above read; a lexicon leaves them to these.
READ = r"^(?:(?:ver|version|버전)[.\d]*|\d*버전|(?:type|타입|タイプ)-?[a-z]?|[a-z]타입|[a-z]タイプ|[ivx]+|\d+(?:호기?|号機?)?|개|카이|改|kai|x\d|.*데칼.*|.*デカール.*|전용|専用|습식|水転写|전용습식|본체별매?|별매|\d?(?:개|박스|체|体|個|箱|点|點)?(?:세트|묶음|セット)|\d(?:개|박스|체|体|個|箱|点)|(?:두|세|네|다섯)개(?:묶음|세트)?|묶음|세트|セット|[\W\d_]+)$"


@dataclass
class Parser:
    lexicon: Lexicon = field(default_factory=Lexicon)

    def __post_init__(self) -> None:
        every = "|".join(rf"(?<![a-z0-9가-힣]){re.escape(g)}(?![a-z가-힣])" if g[-1].isascii() else re.escape(g) for g in sorted(GRADES, key=len, reverse=True))
        self._grades = re.compile(where_begun("".join(sorted({g[0] for g in GRADES})), every), re.I)

    def plain(self, text: str) -> str:
        """A text in its one form with bars for grade, scale, size and number."""
        text = re.sub(r"^\[[A-Za-z]{2,4}\d*\]", "|", text).replace("(프라모델)", "|")
        for p in (*(_SIZE,) * bool(_UNIT.search(text)), _CODE, _SCALE, self._grades):
            text = p.sub("|", text)
        return text

    def grade(self, text: str) -> str:
        m = self._grades.search(text)
        return GRADES[m[0].lower()] if m else ""

    def __call__(self, text: str, series: tuple[str, ...] = (), formed: bool = False) -> Name:
        """``series``: the bare series that stand in the text; ``formed``: the text is in its one form."""
        t = text if formed else one_form(text)
        grade = scale = code = latin = ""
        contents, variant = [], []
        if m := _BRACKET.match(t):
            inner = re.sub(r"\d+$", "", m[1].strip()).lower()
            inner = m[1].strip().lower() if m[1].strip().lower() in GRADES else inner
            if inner in GRADES:
                grade, t = GRADES[inner], t[m.end() :]
        t = t.replace("(프라모델)", " ")
        for k in sorted(series, key=len, reverse=True):
            t = _loose(k).sub(" ", t)
        if m := _LATIN.search(t):
            said, found = self.lexicon.take(m[1].lower())
            said, more = _signs(said)
            variant += found + more
            latin = "".join(re.findall("[a-z]+", said))
            t = t[: m.start()] + " " + t[m.end() :]
        t = _REMARK.sub(" ", t)
        if _DECAL.search(t):
            contents.append("decal")
            t = re.sub(r"\(본체 별매\)|(?:전 ?용 ?)?(?:습 ?식 ?)?데 ?칼|(?:専用)? ?(?:水転写)? ?デカール|decals?", " ", t, flags=re.I)
        size = ""
        if _UNIT.search(t) and (m := _SIZE.search(t)):
            size = f"{float(m[1]) * (10 if m[2].lower() in ('cm', '센티') else 1):.0f}"
            t = _SIZE.sub(" ", t)
        if (m := _CODE.search(t)) and m[1].lower() != "ver":
            code = f"{m[1]}{m[2].lstrip('0')}{m[3]}".upper()
            t = t[: m.start()] + " " + t[m.end() :]
        if m := _SCALE.search(t):
            scale = m[1] or m[2]
            t = _SCALE.sub(" ", t)
        if m := self._grades.search(t):
            grade = grade or GRADES[m[0].lower()]
            t = self._grades.sub(" ", t)
        if grade == "RE" and not scale:
            scale = "100"
        t, found = self.lexicon.take(t)
        variant += found
        t = re.sub(r"[\[\]()【】]", " ", t)
        t, found = _signs(t)
        variant += found
        t = re.sub("버 ?전", " ", t)
        if m := _SET.search(t):
            if not (m[2] and re.match(r"\d ?호", t[m.start() :])):
                contents.append("x" + (m[1] or m[2] or _COUNT.get(m[3] or "", "2")))
                t = _SET.sub(" ", t)
        if m := _ROMAN.search(t):
            variant.append("no" + (_NUMBER.get(m[1] or "", "") or m[2] or ""))
            t = _ROMAN.sub(" ", t)
        t = re.sub(r"\s+", " ", t).strip(" -~,.·・/")
        whole = ""
        if m := _KAI.search(t):
            if m[0] == "개" and "kai" not in variant:
                whole = t
            variant.append("kai")
            t = t[: m.start()]
        kana = "".join(re.findall("[ァ-ヺー]+", t))
        hangul = "".join(re.findall("[가-힣]+", t))
        body = kana if len(kana) > len(hangul) else hangul
        rest = [w.lower() for w in re.sub("[가-힣ァ-ヺー・]+", " ", t).split() if w.isalnum()]
        if not body and not latin:  # a name in Latin letters alone
            latin, rest = "".join(w for w in rest if w.isascii() and w.isalpha()), [w for w in rest if not (w.isascii() and w.isalpha())]
            body = latin
        variant += [f"~{w}" for w in rest]
        return Name(" ".join(syllables(body)), latin, grade, scale, code, "+".join(sorted({*variant})), "+".join(sorted(contents)), max(series, key=len, default=""), " ".join(rest), " ".join(syllables("".join(re.findall("[가-힣]+", whole)))), size)


@lru_cache(1 << 14)
def _loose(phrase: str) -> re.Pattern:
    return re.compile(loose(phrase), re.I)


_LATIN_SIGN = re.compile(r"\b(kai|i{2,3}|iv|vi{0,3})\b", re.I)


def _signs(text: str) -> tuple[str, list[str]]:
    """The text without versions, types and, in Latin letters, numbers; and those."""
    out = []
    if m := _VER.search(text):
        out.append("ver" + next(x for x in m.groups() if x).lower().removesuffix(".0"))
        text = _VER.sub(" ", text)
    if m := _TYPE.search(text):
        out.append("type" + (m[1] or m[2]).lower())
        text = _TYPE.sub(" ", text)
    if text.isascii():
        for v in _LATIN_SIGN.findall(text):
            out.append("no" + _NUMBER[v.upper()] if v.upper() in _NUMBER else v.lower())
        text = _LATIN_SIGN.sub(" ", text)
    return text, out


_SOUND = str.maketrans("gdb", "ktp")


def sound(key: str) -> str:
    """A key without what is often misheard: voicing, a glide after a consonant, a syllable said twice. No blanks
    inside a syllable; syllables stay apart."""
    return " ".join(s for s, _ in groupby(map(_soft, key.split())))


@lru_cache(1 << 14)
def _soft(syllable: str) -> str:
    s = syllable.translate(_SOUND)
    return s[0] + s[2:] if len(s) > 2 and s[1] == "y" and s[0] not in "aiueo" else s


def spells(key: str) -> list[str]:
    """The sound of a key, first whole, then with each one of its syllables missing (of at least three left)."""
    s = sound(key).split()
    soft = [*map(_soft, s)] if len(s) > 3 else []
    if soft == s:  # none is said twice but the two beside the one left out
        less = [" ".join(s[:i] + s[i + 1 + (0 < i < len(s) - 1 and s[i - 1] == s[i + 1]) :]) for i in range(len(s))]
    else:
        less = [" ".join(x for x, _ in groupby(soft[:i] + soft[i + 1 :])) for i in range(len(soft))]
    return list(dict.fromkeys([" ".join(s), *less]))


FIELDS = "key string, latin string, grade string, scale string, code string, variant string, contents string, series string, rest string, either string, size string"


@F.pandas_udf(T.StringType())
def _bare(s: pd.Series) -> pd.Series:
    return s.map(lambda x: bare(one_form(x)), na_action="ignore")


MARKS = 1 << 20


def marks(texts: DataFrame, column: str) -> bytes:
    """A bit for each hash that a text has: 128 kB for a table of any size. What has no bit isn't in the table."""
    at = (F.crc32(F.encode(column, "UTF-8")) % MARKS + 1).alias("at")
    got = texts.select(at).groupBy(F.bitmap_bucket_number("at").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    found = {r["b"]: bytes(r["bits"]) for r in got.collect()}
    return b"".join(found.get(b, bytes(4096)) for b in range(1, MARKS // 32768 + 1))


def marked(bits: bytes, text: str) -> bool:
    at = crc32(text.encode()) % MARKS
    return bool(bits[at >> 3] >> (at & 7) & 1)


def located(names: DataFrame, text: str, series: DataFrame | None, longest: int = 5) -> DataFrame:
    """(text, form, in_text): the distinct texts in their one form, with the series of ``series`` (a table of one column, of any
    size) that they hold as words. Computed once, for the lexicon and the parser."""
    forms = cut(names.select(F.col(text).alias("text")).dropna().distinct().select("text", canonical(F.col("text")).alias("form")))
    if series is None:
        return forms.withColumn("in_text", F.lit(None).cast("array<string>"))
    known = cut(series.toDF("s").dropna().distinct().select(_bare("s").alias("phrase")).filter(F.length("phrase") > 1).distinct())
    bits = marks(known, "phrase")

    def run(batches):  # noqa: ANN001, ANN202
        for b in batches:
            rows = set()
            for t in b.column("form").to_pylist():
                for words in words_of(t, lambda x: x):
                    for i in range(len(words)):
                        phrase = ""
                        for w in words[i : i + longest]:
                            phrase += w
                            if marked(bits, phrase):
                                rows.add((t, phrase))
            yield strings(rows, "form", "phrase")

    each = forms.select("form").distinct().mapInArrow(run, "form string, phrase string")
    found = each.join(known, "phrase").groupBy("form").agg(F.collect_list("phrase").alias("in_text"))  # a text's few series
    return cut(forms.join(found, "form", "left").select("text", "form", "in_text"))


def parsed(names: DataFrame, text: str, where: DataFrame | None, lexicon: Lexicon, keep: tuple[str, ...]) -> DataFrame:
    """``names`` (its columns ``keep``) with the fields of ``Name`` for ``text``; null text gives no row.

    ``where``: ``located`` texts; without it no series is taken out. Each row is parsed on its own, in batches: make the names
    distinct first.
    """
    kinds = [f for f in names.select(*keep).schema]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kinds] + [FIELDS])

    def run(batches):  # noqa: ANN001, ANN202
        parser = Parser(lexicon)
        for b in batches:
            got = [parser(t, () if s is None else tuple(s), formed) for t, s, formed in zip(b["__text"], b["in_text"], b["__formed"], strict=True)]
            yield pd.concat([b[list(keep)].reset_index(drop=True), pd.DataFrame(got, columns=[f.strip().split()[0] for f in FIELDS.split(",")])], axis=1)

    rows = names.selectExpr(*(f"`{k}`" for k in keep), f"`{text}` as __text").filter("__text is not null")
    if where is None:
        rows = rows.withColumns({"in_text": F.lit(None).cast("array<string>"), "__formed": F.lit(False)})
    else:
        rows = rows.join(where.withColumnRenamed("text", "__text"), "__text").select(*keep, F.col("form").alias("__text"), "in_text", F.lit(True).alias("__formed"))
    return rows.mapInPandas(run, schema)


@F.pandas_udf(T.StringType())
def _without(text: pd.Series, in_text: pd.Series) -> pd.Series:
    def one(t: str, found) -> str:  # noqa: ANN001
        for k in sorted(found, key=len, reverse=True) if found is not None else ():
            t = _loose(k).sub(" | ", t)
        return t

    return pd.Series([one(t, f) for t, f in zip(text, in_text, strict=True)])


def lexicon_of(texts: DataFrame, pairs: DataFrame, where: DataFrame | None = None) -> Lexicon:
    """The lexicon of ``texts`` (text, price) and of a catalogue's names ``pairs`` (ja, ko); the series of ``where``, the
    ``located`` texts, are no affixes."""
    parser = Parser()
    rows = texts.filter("text is not null").groupBy("text").agg(F.median("price").alias("price"))
    where = located(rows, "text", None) if where is None else where
    rows = rows.join(where, "text").select(F.when(F.col("in_text").isNull(), F.col("form")).otherwise(_without("form", "in_text")).alias("text"), "price")
    pairs = cut(pairs.distinct().select(canonical(F.col("ja")).alias("ja"), canonical(F.col("ko")).alias("ko")))
    return learn(cut(rows), pairs, parser.plain, skip=READ, grade=parser.grade)
