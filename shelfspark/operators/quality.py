"""Checks of tables, and mining of spelling variants."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.phonetics import spellings, term_sounds
from ..plans.run import cut


def violations(rows: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """(rule, rows): how many rows break each rule (a condition that must hold; null breaks it). One pass."""
    each = F.array(*(F.struct(F.lit(k).alias("rule"), (~F.coalesce(v, F.lit(False))).cast("bigint").alias("bad")) for k, v in rules.items()))
    return rows.select(F.explode(each).alias("x")).groupBy("x.rule").agg(F.sum("x.bad").alias("rows"))


def repeated_keys(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    return rows.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")


def glossary_hits(rows: DataFrame, text: str, terms: Sequence[str]) -> DataFrame:
    """(term, rows) for a stated list of terms, matched within the text; one scan, no join."""
    each = F.array_compact(F.array(*(F.when(F.col(text).contains(t), F.lit(t)) for t in terms)))
    return rows.select(F.explode(each).alias("term")).groupBy("term").agg(F.count("*").alias("rows"))


def substrings(text: Column, least: int, most: int) -> Column:
    """All substrings of ``least`` to ``most`` characters."""
    n = F.length(text)
    starts = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
    each = lambda i: F.transform(F.sequence(F.lit(least), F.lit(most)), lambda k: F.when(i + k - 1 <= n, F.substr(text, i, k)))
    return F.array_distinct(F.array_compact(F.flatten(F.transform(starts, each))))


def closed_terms(docs: DataFrame, id_: str, runs: Column, least: int = 3, most: int = 12, support: int = 3) -> DataFrame:
    """(term, docs): substrings of the runs that are in ``support`` documents or more, of those in the same documents
    only the longest. The set of documents is compared by a sum and a xor of id hashes, not gathered."""
    each = _terms(docs, id_, runs, least, most)
    h = F.xxhash64("d")
    sets = each.groupBy("term").agg(F.count("*").alias("docs"), F.sum(h.cast("decimal(38,0)")).alias("a"), F.bit_xor(h).alias("b")).filter(F.col("docs") >= support)
    return sets.groupBy("docs", "a", "b").agg(F.max_by("term", F.struct(F.length("term"), "term")).alias("term")).select("term", "docs")


def _terms(docs: DataFrame, id_: str, runs: Column, least: int, most: int) -> DataFrame:
    return docs.select(F.col(id_).alias("d"), F.explode(runs).alias("run")).select("d", F.explode(substrings(F.col("run"), least, most)).alias("term")).distinct()


def kana_runs(ja: Column, longest: int = 40) -> Column:
    """Katakana runs of an NFKC text, each cut at ``longest``."""
    return F.transform(F.regexp_extract_all(ja, F.lit("([ァ-ヺー]+)"), 1), lambda r: F.substring(r, 1, longest))


def term_variants(docs: DataFrame, *, support: int = 3, precision: float = 0.85, common: int = 300, exclusive: float = 0.2) -> DataFrame:
    """(ja, items, variants, shop): Katakana terms that are spelt in several ways, of docs (doc, key, ja in NFKC, ko, shop).

    A closed term's candidates are the Hangul words of its documents that are seldom without it (``precision``) and sound as it does. The
    anchor is the most frequent, then the longest, unless it is in more than ``common`` documents; its variants are of the same sound and like
    letters, neither within the other, and seldom in one document with it (``exclusive``). Of the terms of one set of variants the one with
    the most items stays, then the longest; sets within another set go. Counts are of distinct keys. docs is read several times.
    """
    runs = kana_runs(F.col("ja"))
    hits = cut(_terms(docs, "doc", runs, 3, 12).join(closed_terms(docs, "doc", runs, support=support).select("term"), "term"))
    words = cut(docs.select(F.col("doc").alias("d"), F.explode(F.array_distinct(F.regexp_extract_all("ko", F.lit("([가-힣]{2,})"), 1))).alias("word")))
    df = words.groupBy("word").agg(F.count("*").alias("df"))
    n = hits.join(words, "d").groupBy("term", "word").agg(F.count("*").alias("n")).join(df, "word").filter(F.col("n") / F.col("df") >= precision)
    cands = cut(n.filter(term_sounds("word", "term")))
    anchor = cands.groupBy("term").agg(F.max_by(F.struct("word", "df"), F.struct("n", F.length("word"), "word")).alias("x")).select("term", F.col("x.word").alias("anchor"), F.col("x.df").alias("of")).filter(F.col("of") <= common)
    pairs = cut(cands.join(anchor, "term").filter(F.col("word") != F.col("anchor")).filter(spellings("word", "anchor")).select("term", "word", "anchor", "df", "of"))
    two = pairs.select("word", "anchor").distinct()
    both = two.join(words, "word").join(words.select("d", F.col("word").alias("anchor")), ["d", "anchor"]).groupBy("word", "anchor").agg(F.count("*").alias("both"))
    kept = pairs.join(both, ["word", "anchor"], "left").filter(F.coalesce("both", F.lit(0)) / F.least("df", "of") <= exclusive)
    member = cut(kept.select("term", "word").union(kept.select("term", F.col("anchor").alias("word"))).distinct())
    of = docs.select(F.col("doc").alias("d"), "key", "shop")
    items = hits.join(member.select("term").distinct(), "term").join(of, "d").groupBy("term").agg(F.count_distinct("key").alias("items"))
    each = hits.join(member, "term").join(words, ["d", "word"]).join(of, "d").groupBy("term", "word").agg(F.count_distinct("key").alias("n"), F.count_distinct(F.when(F.col("shop"), F.col("key"))).alias("s"))
    entry = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.struct("word", c))))
    rows = each.groupBy("term").agg(F.array_sort(F.collect_list("word")).alias("set"), entry("n").alias("variants"), entry("s").alias("shop")).join(items, "term")
    best = cut(rows.groupBy("set").agg(F.max_by(F.struct("term", "items", "variants", "shop"), F.struct("items", F.length("term"), "term")).alias("x")).select("set", "x.*"))
    a, b = (best.select(F.col("set").alias(x), F.explode("set").alias("word")) for x in ("small", "large"))
    within = a.join(b, "word").filter(F.size("small") < F.size("large")).groupBy("small", "large").agg(F.count("*").alias("n")).filter(F.col("n") == F.size("small")).select(F.col("small").alias("set")).distinct()
    return best.join(within, "set", "left_anti").select(F.col("term").alias("ja"), "items", "variants", "shop").orderBy(F.desc("items"), "ja")
