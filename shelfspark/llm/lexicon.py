"""The words of a trade that go with many models: variants, which make another product, and talk, which doesn't.

Nothing is listed; it is learnt from the names. A phrase is an affix if it stands beside many words that are less
connected than it is: a model's words have few neighbours, and those are better connected. What the catalogue's
names use are variants; their spellings in its two languages go together where they stand on the same items. Other
affixes spell a variant if they are written like it or stand beside it. The rest are talk where prices don't change
with them, and a variant of their own where they do.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass
from functools import cached_property

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.run import cut


def bare(phrase: str) -> str:
    """A phrase as it is compared: small letters, without blanks."""
    return phrase.replace(" ", "").lower()


def loose(phrase: str) -> str:
    """A pattern of a phrase that allows a blank anywhere between its characters; short ones must be whole words."""
    body = " ?".join(map(re.escape, phrase))
    if phrase.isascii():
        return rf"(?<![a-z0-9]){body}(?![a-z0-9])"
    return body if len(phrase) > 2 or re.match("[一-鿿ァ-ヺ]", phrase) else rf"(?<![가-힣\d]){body}(?![가-힣])"


def where_begun(heads: str, pattern: str) -> str:
    """A pattern that is tried only where one of the characters ``heads`` stands, each of its matches begins with one of them."""
    return f"(?=[{re.escape(heads)}])(?:{pattern})"


@dataclass(frozen=True)
class Lexicon:
    """``variants``: (spelling, variant), ``talk``: spellings; all bare."""

    variants: tuple[tuple[str, str], ...] = ()
    talk: tuple[str, ...] = ()

    @cached_property
    def pattern(self) -> re.Pattern:
        every = sorted({*dict(self.variants), *self.talk}, key=lambda x: (-len(x), x))
        if not every or not every[-1]:  # the last is the shortest
            return re.compile("|".join(map(loose, every)) or r"(?!)", re.I)
        return re.compile(where_begun("".join(sorted({x[0] for x in every})), "|".join(map(loose, every))), re.I)

    @cached_property
    def meaning(self) -> dict[str, str]:
        return dict(self.variants)

    def take(self, text: str) -> tuple[str, list[str]]:
        """The text without the lexicon's phrases, and the variants that stood in it."""
        said: list[str] = []

        def out(m: re.Match) -> str:
            if v := self.meaning.get(bare(m[0])):
                said.append(v)
            return " "

        return self.pattern.sub(out, text), said


_PUNCTUATION = "-–~.,!?:;'\"…"
_BETWEEN = re.compile(r"[\s\[\]()（）【】<>*★♥♡☆●■◆・,/]+")


def words_of(text: str, plain) -> list[list[str]]:  # noqa: ANN001
    """The words of a name in its one form, between its grade, scale, number and the like, which ``plain`` replaces by bars."""
    out = []
    for part in plain(text).lower().split("|"):
        words = (w.strip(_PUNCTUATION) for w in _BETWEEN.split(part))
        if words := [w for w in words if w]:
            out.append(words)
    return out


def strings(rows, *names: str) -> pa.RecordBatch:  # noqa: ANN001
    """A batch of string columns."""
    rows = list(rows)
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(len(names))], list(names))


def neighbours(texts: DataFrame, text: str, plain, longest: int = 3) -> DataFrame:  # noqa: ANN001
    """(phrase, beside), distinct: the phrases of up to ``longest`` words and the words beside them."""

    def run(batches):  # noqa: ANN001, ANN202
        for b in batches:
            rows = set()
            for t in b.column("t").to_pylist():
                for words in words_of(t, plain):
                    last = len(words)
                    for i in range(last):
                        phrase = ""
                        for k in range(i, min(i + longest, last)):
                            phrase += words[k]
                            if i:
                                rows.add((phrase, words[i - 1]))
                            if k + 1 < last:
                                rows.add((phrase, words[k + 1]))
            yield strings(rows, "phrase", "beside")

    return texts.select(F.col(text).alias("t")).dropna().distinct().mapInArrow(run, "phrase string, beside string").distinct()


def affixes(edges: DataFrame, *, least: int = 6, part: float = 0.001) -> dict[str, int]:
    """Of ``neighbours`` the phrases that stand beside at least ``least``, and ``part`` of all, words with less than half of their neighbours.

    At most 1 / ``part`` times the mean number of a word's neighbours, whatever the number of texts.
    """
    degree = edges.groupBy("phrase").agg(F.count("*").alias("n"))
    words = edges.select("beside").distinct().count()
    of = degree.select(F.col("phrase").alias("beside"), F.col("n").alias("m"))
    hubs = edges.join(of, "beside").join(degree, "phrase").filter("m * 2 < n").groupBy("phrase").agg(F.count("*").alias("lesser"))
    hubs = hubs.join(degree, "phrase").filter("lesser >= 0.3 * n")
    got = hubs.filter((F.col("lesser") >= max(least, part * words)) & (F.length("phrase") > 1)).collect()
    return {r["phrase"]: r["lesser"] for r in got}


def single(hubs: dict[str, int], known: re.Pattern) -> dict[str, int]:
    """Affixes without those that are two of them side by side, by chance: both stand beside more words."""

    def by_chance(x: str) -> bool:
        for k in range(1, len(x)):
            u, v = (None if known.search(y) else hubs.get(y, 0) for y in (x[:k], x[k:]))
            if (u is None or u > hubs[x]) and (v is None or v > hubs[x]):
                return True
        return False

    return {x: n for x, n in hubs.items() if not known.search(x) and not by_chance(x)}


def alike(a: str, b: str) -> bool:
    """Whether one phrase spells the other: it holds it, leaves out at most two fifths of it, or differs in few jamo."""
    import difflib
    import unicodedata

    if len(a) > len(b):
        a, b = b, a
    if len(a) < 3:
        return False
    if a in b:
        return len(a) >= 4
    rest = iter(b)
    if a[0] == b[0] and len(a) * 5 >= len(b) * 3 and all(ch in rest for ch in a):
        return True
    short, long = (unicodedata.normalize("NFD", x) for x in (a, b))
    # the same beginning and another ending: 'for commanders', 'commander's machine'
    if len(a) >= 3 and a[: len(a) - 1] == b[: len(a) - 1] and len(a) >= 4:
        return True
    return len(a) >= 4 and difflib.SequenceMatcher(None, short, long, autojunk=False).ratio() >= 0.8


def learn(texts: DataFrame, pairs: DataFrame, plain, *, skip: str = "(?!)", grade=None) -> Lexicon:  # noqa: ANN001
    """The lexicon of ``texts`` (text, price) and of a catalogue's names ``pairs`` (ja, ko), all in their one form.

    ``plain`` takes out of a name what a parser reads by itself, ``skip`` is a pattern of affixes that it knows, and
    ``grade`` gives the grade that a name says. Null names and prices say nothing; repeated rows count once. Empty tables teach nothing.
    """
    known = re.compile(skip, re.I)
    ja, ko = (single(affixes(cut(neighbours(pairs, c, plain))), known) for c in ("ja", "ko"))
    spelt = _pairs(pairs, sorted(ja), sorted(ko))
    variants = {a: a for a in ja} | spelt
    for k in ko:  # parts of longer spellings aren't variants of their own
        if k not in variants and not any(k in x for x in variants):
            variants[k] = k
    edges = cut(neighbours(texts, "text", plain))
    own = set(single(affixes(edges), known)) - set(variants)
    whole = sorted(variants)
    for x in sorted(own):
        fits = sorted({variants[y] for y in whole if alike(x, y)})
        if len(fits) == 1:
            variants[x] = fits[0]
    own = {x for x in own - set(variants) if not any(x in y for y in variants)}
    beside, priced = _company(texts, Lexicon(tuple(sorted(variants.items())), tuple(sorted(own))), plain, grade)
    talk = set()
    for x in sorted(own):
        n, best, share = beside.get(x, (0, "", 0.0))
        if n >= 5 and share >= 0.85:
            variants[x] = best
        elif abs(priced.get(x, 0.0)) < 0.1:
            talk.add(x)
        else:
            variants[x] = x
    latin = [y for y in variants if y.isascii() and y.isalpha()]
    two = edges.filter(F.concat("phrase", "beside").isin(latin)).collect() if latin else []  # the words of a spelling
    for r in two:
        x = r["phrase"][0] + r["beside"][0]
        if x in own:
            variants[x] = variants[r["phrase"] + r["beside"]]
            talk.discard(x)
    talk = {x for x in talk if not any(x in y for y in variants)}
    return Lexicon(tuple(sorted(variants.items())), tuple(sorted(talk)))


def _pairs(pairs: DataFrame, ja: list[str], ko: list[str], sure: float = 0.85) -> dict[str, str]:
    """Spellings of one language by those of the other that they stand on the same items with, most surely. A Katakana
    beginning that most items of a spelling have, and no other, is its spelling too, though it isn't a word by itself."""

    def run(batches):  # noqa: ANN001, ANN202
        a, b = (Lexicon(talk=tuple(x)) for x in (ja, ko))
        for batch in batches:
            rows = []
            for x, y in zip(batch["ja"], batch["ko"], strict=True):
                left = sorted({bare(m[0]) for m in a.pattern.finditer(x)})
                right = sorted({bare(m[0]) for m in b.pattern.finditer(y)})
                if len(right) == 1 and len(left) == 1:
                    rows.append((right[0], left[0], "both"))
                elif not left:
                    heads = {bare(m[0])[:k] for m in list(re.finditer("[ァ-ヺー]{5,}", x))[:1] for k in range(3, 13)}
                    rows += [(right[0] if len(right) == 1 else "", h, "head") for h in heads]
                if len(right) == 1:
                    rows.append((right[0], "", "all" if left else "bare"))
            yield pd.DataFrame(rows, columns=["k", "j", "kind"])

    got = pairs.select("ja", "ko").dropna().distinct().mapInPandas(run, "k string, j string, kind string").groupBy("k", "j", "kind").agg(F.count("*").alias("n"))
    least = F.when(F.col("kind") == "head", F.col("n") >= 5).otherwise(F.lit(True))
    n: dict[tuple, int] = {(r["k"], r["j"], r["kind"]): r["n"] for r in got.filter(least).collect()}
    heads: dict[str, int] = defaultdict(int)
    for (_, j, kind), m in n.items():
        if kind == "head":
            heads[j] += m
    out: dict[str, str] = {}
    for k in ko:
        with_, alone = n.get((k, "", "all"), 0), n.get((k, "", "bare"), 0)
        both = sorted(((m, j) for (x, j, kind), m in n.items() if x == k and kind == "both"), reverse=True)
        if both and both[0][0] >= max(3, sure * (with_ + alone)):
            out[k] = both[0][1]
            continue
        glued = [j for (x, j, kind), m in n.items() if x == k and kind == "head" and m >= sure * (with_ + alone) and m >= sure * heads[j]]
        if glued:
            j = max(glued, key=lambda s: (len(s), s))
            out[k] = out[j] = j
    for k in ko:  # rarer spellings of the same
        more = [j for j in {*out.values()} if k not in out and n.get((k, j, "head"), 0) >= max(3, sure * (n.get((k, "", "all"), 0) + n.get((k, "", "bare"), 0)))]
        if len(more) == 1:
            out[k] = more[0]
    return out


def _company(texts: DataFrame, lexicon: Lexicon, plain, grade) -> tuple[dict, dict]:  # noqa: ANN001
    """For each phrase not yet understood: (names with a variant, the one most often beside it, its part of them), and the
    median difference that it makes to the logarithm of the price of names that are alike but for such phrases."""
    kinds = lexicon.meaning

    def run(batches):  # noqa: ANN001, ANN202
        for b in batches:
            rows = []
            for t, price in zip(b["t"], b["price"], strict=True):
                found: list[str] = []
                free = lexicon.pattern.sub(lambda m, found=found: found.append(m[0]) or " | ", t)
                hits = {bare(x) for x in found}
                said = sorted({kinds[h] for h in hits if h in kinds})
                left = "".join(sorted(w for part in words_of(free, plain) for w in part))
                rows.append((f"{grade(t) if grade else ''}|{left}|{'+'.join(said)}", price, sorted(h for h in hits if h not in kinds), said))
            yield pd.DataFrame(rows, columns=["body", "price", "open", "said"])

    rows = texts.select(F.col("text").alias("t"), F.col("price").cast("double").alias("price")).filter("t is not null").distinct()
    rows = cut(rows.mapInPandas(run, "body string, price double, open array<string>, said array<string>"))
    each = rows.filter(F.size("said") == 1).select(F.explode("open").alias("x"), F.col("said")[0].alias("v")).groupBy("x", "v").agg(F.count("*").alias("n"))
    beside: dict[str, tuple] = {}
    for r in each.collect():  # phrases times variants
        n, best, top = beside.get(r["x"], (0, "", 0))
        beside[r["x"]] = (n + r["n"], *((r["v"], r["n"]) if r["n"] > top else (best, top)))
    priced = rows.filter("price > 0").withColumn("l", F.log("price"))
    base = priced.filter(F.size("open") == 0).groupBy("body").agg(F.median("l").alias("base"))
    step = priced.filter(F.size("open") == 1).join(base, "body").select(F.col("open")[0].alias("x"), (F.col("l") - F.col("base")).alias("d"))
    moved = step.groupBy("x").agg(F.median("d").alias("d"), F.count("*").alias("n")).filter("n >= 3").collect()
    return {k: (n, v, top / n) for k, (n, v, top) in beside.items()}, {r["x"]: r["d"] for r in moved}
