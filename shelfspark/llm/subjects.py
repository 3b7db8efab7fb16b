"""Subject areas of documents.

Texts become terms: words of letters with cases, pairs and triples of other letters. Document vectors are weighted
by inverse frequency over the whole corpus, projected to few dimensions and normalised; bisecting k-means clusters
them all. A leaf's discriminative terms are those that are more frequent in its documents, by log odds, than in the
others. They name the leaf: by the subjects of the hand-labelled documents that have them. What a leaf says of a
subject are the terms that set both it and the subject's leaves apart. A document is a mixture of leaves: each of its
sentences goes to the leaf and subject whose terms speak for it, or to none, and the document has every subject whose
leaves have a sufficient share of its sentences.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.run import cut
from .leaks import MARKUP
from .lookalike import one_form

BITS = 18  # of the hashed features of document vectors; terms themselves are hashed to 31 bits
_SENTENCE = re.compile(r"[.!?]+(?=\s|$)|[。！？\n]+")
_WORD = re.compile(r"[a-zà-öø-ÿ]{2,}|[가-힣]+|[぀-ヿ一-鿿㐀-䶿]+")


def parts(word: str) -> list[str]:
    if word.isascii() or "à" <= word[0] <= "ÿ" or len(word) == 1:
        return [word]
    return [word[i : i + n] for n in (2, 3) for i in range(len(word) - n + 1)]


@lru_cache(1 << 17)
def _terms(word: str) -> tuple[int, ...]:
    return tuple(zlib.crc32(p.encode()) >> 1 for p in parts(word))


def sentence_words(text: str, least: int = 6) -> Iterator[list[str]]:
    """The words of each sentence. Scraps of fewer than ``least`` letters don't count."""
    for s in _SENTENCE.split(one_form_lines(text)):
        words = _WORD.findall(s.lower())
        if sum(map(len, words)) >= least:
            yield words


def sentences(text: str) -> list[list[int]]:
    """The terms of each sentence, as hashes of 31 bits."""
    return [[t for w in words for t in _terms(w)] for words in sentence_words(text)]


def one_form_lines(text: str) -> str:
    return "\n".join(one_form(line) for line in MARKUP.sub(" ", text).split("\n"))


def terms(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, ids, ends): the terms of all sentences, one after the other, and where each sentence ends.

    The texts aren't shuffled. Of several rows of a doc_id the one with the greatest hash of its terms holds.
    """
    kind = documents.select(doc_id).schema[0].dataType.simpleString()

    def run(batches):  # noqa: ANN001, ANN202
        for b in batches:
            rows = []
            for d, t in zip(b["doc_id"], b["text"], strict=True):
                s = sentences(t)
                rows.append((d, [i for x in s for i in x], np.cumsum([len(x) for x in s]).tolist()))
            yield pd.DataFrame(rows, columns=["doc_id", "ids", "ends"])

    rows = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).dropna()
    rows = cut(rows.mapInPandas(run, f"doc_id {kind}, ids array<int>, ends array<int>"))
    marked = rows.select("*", F.struct(F.xxhash64("ids", "ends").alias("h"), F.monotonically_increasing_id().alias("i")).alias("mark"))
    twice = marked.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("mark").alias("win")).filter("n > 1")
    if twice.isEmpty():
        return rows
    return cut(marked.join(twice, "doc_id", "left").filter("win is null or win = mark").select("doc_id", "ids", "ends"))


def feature(ids) -> np.ndarray:  # noqa: ANN001
    return np.asarray(ids, np.int64) & ((1 << BITS) - 1)


def project(ids, idf: np.ndarray, signs: np.ndarray) -> np.ndarray:  # noqa: ANN001
    """The terms of a document, weighted, projected by random numbers and normalised."""
    t, n = np.unique(feature(ids), return_counts=True)
    v = (np.log1p(n) * idf[t]) @ signs[(t * 2654435761 >> 7) % len(signs)] if len(t) else np.zeros(signs.shape[1])
    return v / (np.linalg.norm(v) or 1.0)


def projection(dims: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((1 << 14, dims)).astype(np.float32)


def document_frequency(docs: DataFrame) -> np.ndarray:
    """How many documents have each feature; a partition sends each feature once, the driver gets 2**BITS rows."""

    def run(batches):  # noqa: ANN001, ANN202
        n = np.zeros(1 << BITS, np.int64)
        for b in batches:
            for ids in b["ids"]:
                n[np.unique(feature(ids))] += 1
        t = np.flatnonzero(n)
        yield pd.DataFrame({"t": t.astype(np.int32), "n": n[t]})

    got = docs.select("ids").mapInPandas(run, "t int, n bigint").groupBy("t").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(1 << BITS, np.int64)
    out[got["t"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    return out


def vectors(docs: DataFrame, idf, dims: int, seed: int) -> DataFrame:  # noqa: ANN001
    """(v) of the documents; ``idf`` is a broadcast."""

    def run(batches):  # noqa: ANN001, ANN202
        signs, own = projection(dims, seed), idf.value
        for b in batches:
            yield pd.DataFrame({"v": [project(ids, own, signs).tolist() for ids in b["ids"]]})

    return docs.select("ids").mapInPandas(run, "v array<double>")


KEYS = 1_000_000


def leaf_counts(batches, idf, centers, frequent, seed: int):  # noqa: ANN001, ANN201
    """(leaf, t, n): how many of a partition's documents, each in the leaf whose centre is nearest, have each term of a
    frequent feature. Keys are counted ``KEYS`` at a time. t is -1 for the documents themselves."""
    c = centers.value
    signs, own, half, often = projection(c.shape[1], seed), idf.value, (c * c).sum(axis=1) / 2, frequent.value
    held: list[np.ndarray] = []

    def counted() -> pd.DataFrame:
        keys, n = np.unique(np.concatenate(held), return_counts=True)
        held.clear()
        return pd.DataFrame({"leaf": (keys >> 32).astype(np.int32), "t": ((keys & 0xFFFFFFFF) - 1).astype(np.int32), "n": n})

    for b in batches:
        for ids in b["ids"]:
            leaf = int((half - c @ project(ids, own, signs)).argmin())
            t = np.unique(np.asarray(ids, np.int64))
            held.append(np.append(t[often[feature(t)]] + 1, 0) | (leaf << 32))
        if sum(map(len, held)) >= KEYS:
            yield counted()
    if held:
        yield counted()


def odds(n, size, n_all, size_all: float, few: float = 3.0):  # noqa: ANN001, ANN201
    """Log odds of a term in a group against the rest, as columns or numbers: rare terms say little."""
    base = n_all * few / size_all
    return F.log((n + base) / (size + few)) - F.log((n_all - n + base) / (size_all - size + few))


def subject_areas(
    documents: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", subject: str = "subject", leaves: int = 96, dims: int = 64,
    share: float = 0.24, sure: float = 0.6, naming: int = 400, speaking: int = 500, part: float = 0.15, seed: int = 7,
) -> tuple[DataFrame, DataFrame]:
    """(doc_id, subject, share) of every subject that has a sufficient share of a document's sentences, and
    (leaf, subject, weight, documents, terms) of the leaves, ``terms`` the hashes of those that speak for the subject.

    ``labels``: doc_id, subject of some documents, a row for each; a null subject means that it is about none.
    A leaf is named by its ``naming`` most discriminative terms: its weight for a subject is the part that the subject
    has among the labelled documents with these terms. Where that is ``part`` or more, the ``speaking`` terms that set apart
    both the leaf and the subject's leaves speak for the two. Wrong labels matter little: they only name terms.
    Documents with null or empty text, or without a sentence, have no row; repeated rows of a doc_id count once; a
    text of any length is read whole. An empty corpus, or one without labels, gives no row.

    What the driver and tasks hold is bounded by the parameters, whatever the corpus: 2**18 features, ``leaves`` times ``naming``
    and ``speaking`` terms a subject. Counts run over all documents and are combined in partitions before a shuffle; a
    term counts if its feature is in 3 documents and one of 10,000. Clustering, counts and shares cover every document.
    """
    spark = documents.sparkSession
    docs = terms(documents, doc_id, text)
    total = docs.count()
    kind = docs.schema["doc_id"].dataType.simpleString()
    told = labels.select(F.col(doc_id).alias("doc_id"), F.col(subject).alias("subject")).filter("doc_id is not null").distinct()
    names = [r[0] for r in told.select("subject").dropna().distinct().orderBy("subject").collect()]
    if not total or not names:
        return spark.createDataFrame([], f"doc_id {kind}, subject string, share double"), spark.createDataFrame([], LEAVES)

    df = document_frequency(docs)
    share_of = spark.sparkContext.broadcast
    idf = share_of(np.where(df > 0, np.log((1 + total) / (1 + df)), 0.0).astype(np.float32))
    frequent = share_of(df >= max(3, total / 10_000))

    from pyspark.ml.clustering import BisectingKMeans
    from pyspark.ml.functions import array_to_vector

    points = vectors(docs, idf, dims, seed).select(array_to_vector("v").alias("features"))
    model = BisectingKMeans(k=leaves, maxIter=8, seed=seed, minDivisibleClusterSize=2.0, distanceMeasure="euclidean").fit(points)
    centers = share_of(np.array(model.clusterCenters(), np.float32))
    counts = docs.select("ids").mapInPandas(lambda it: leaf_counts(it, idf, centers, frequent, seed), "leaf int, t int, n bigint")
    counts = cut(counts.groupBy("leaf", "t").agg(F.sum("n").alias("n")))
    size = {r["leaf"]: r["n"] for r in counts.filter("t = -1").collect()}  # one row a leaf

    # Discriminative terms of the leaves
    sizes = F.create_map(*(F.lit(x) for k, v in size.items() for x in (k, float(v))))
    counts = counts.filter("t >= 0")
    every = counts.groupBy("t").agg(F.sum("n").alias("every"))
    odd = counts.join(every, "t").withColumn("odds", odds(F.col("n"), F.element_at(sizes, F.col("leaf")), F.col("every"), float(total)))
    odd = cut(odd.filter("odds > 0.3").select("leaf", "t", "odds", "n"))
    best = lambda rows, k, *by: rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("w"), "t"))).filter(F.col("rank") <= k)
    top = best(odd.withColumn("w", F.col("odds") * F.sqrt("n")), naming, "leaf").select("leaf", "t", "w").toPandas()

    # Names: the subjects of the labelled documents that have these terms
    weight = named(top, docs, told, names, sorted(size), share_of)

    # What speaks for a leaf and a subject: terms that set both apart
    of = spark.createDataFrame([(int(f), [float(x) for x in weight[f]]) for f in size], "leaf int, weight array<double>")
    mixed = counts.join(F.broadcast(of), "leaf").groupBy("t").agg(F.sum("n").alias("every"), *(F.sum(F.col("n") * F.col("weight")[j]).alias(f"n{j}") for j in range(len(names))))
    whole = [sum(size[f] * weight[f][j] for f in size) for j in range(len(names))]
    speak = mixed.select("t", F.array(*(odds(F.col(f"n{j}"), whole[j], F.col("every"), float(total)) for j in range(len(names)))).alias("r"))
    pairs = odd.join(F.broadcast(of), "leaf").join(speak, "t")
    each = F.transform(F.sequence(F.lit(0), F.lit(len(names) - 1)), lambda j: F.struct(j.alias("s"), F.get("weight", j).alias("weight"), F.get("r", j).alias("r")))
    pairs = pairs.select("leaf", "t", "odds", "n", F.explode(F.filter(each, lambda x: (x["weight"] >= part) & (x["r"] > 0.3))).alias("x"))
    pairs = pairs.select("leaf", "t", "x.s", F.least("odds", "x.r").alias("score"), (F.least("odds", "x.r") * F.sqrt("n")).alias("w"))
    said = best(pairs, speaking, "leaf", "s").select("leaf", "s", "t", "score", "rank").toPandas()

    labelled = share_of(Labels(said, names))
    found = docs.mapInPandas(lambda it: shares(it, labelled.value, share, sure), f"doc_id {kind}, subject string, share double")
    words = {k: g.sort_values("rank")["t"].tolist() for k, g in said.groupby(["leaf", "s"])}
    rows = [(int(f), n, float(weight[f][j]), int(size[f]), words.get((f, j), [])) for f in size for j, n in enumerate([*names, None])]
    return found, spark.createDataFrame(rows, LEAVES)


LEAVES = "leaf int, subject string, weight double, documents bigint, terms array<int>"


def named(top: pd.DataFrame, docs: DataFrame, told: DataFrame, names: list[str], leaves: list[int], share_of) -> dict[int, np.ndarray]:  # noqa: ANN001
    """For each leaf the part of each subject (the last: of none) among the labelled documents with its terms, by weight."""
    wanted = np.unique(top["t"].to_numpy(np.int64)) if len(top) else np.zeros(0, np.int64)
    asked, index = share_of(wanted), {n: j for j, n in enumerate(names)}
    each = told.join(told.groupBy("doc_id").agg(F.count("*").alias("of")), "doc_id")
    each = each.groupBy("doc_id").agg(F.collect_list(F.struct("subject", "of")).alias("told"))  # a document's few subjects

    def run(batches):  # noqa: ANN001, ANN202
        n = np.zeros((len(asked.value), len(names) + 1))
        for b in batches:
            for ids, said in zip(b["ids"], b["told"], strict=True):
                t = np.unique(np.asarray(ids, np.int64))
                k = np.searchsorted(asked.value, t)
                k = k[(k < len(asked.value)) & (asked.value[np.minimum(k, len(asked.value) - 1)] == t)] if len(asked.value) else k[:0]
                for x in said:
                    n[k, index.get(x["subject"], len(names))] += 1 / x["of"]
        k, j = np.nonzero(n)
        yield pd.DataFrame({"k": k.astype(np.int32), "s": j.astype(np.int32), "n": n[k, j]})

    got = docs.join(each, "doc_id").select("ids", "told").mapInPandas(run, "k int, s int, n double").groupBy("k", "s").agg(F.sum("n").alias("n")).toPandas()
    n = np.zeros((len(wanted), len(names) + 1))
    n[got["k"].to_numpy(np.int64), got["s"].to_numpy(np.int64)] = got["n"].to_numpy()
    size = {r["s"]: r["w"] for r in told.join(told.groupBy("doc_id").agg(F.count("*").alias("of")), "doc_id").groupBy(F.col("subject").alias("s")).agg(F.sum(1 / F.col("of")).alias("w")).collect()}
    prior = np.array([size.get(x, 0.0) for x in [*names, None]])
    prior /= prior.sum()
    each_term = (n + 2 * prior) / (n.sum(axis=1, keepdims=True) + 2)
    out = {f: prior.copy() for f in leaves}
    for f, g in top.groupby("leaf"):
        k = np.searchsorted(wanted, g["t"].to_numpy(np.int64))
        w = g["w"].to_numpy() * (n[k].sum(axis=1) > 0)
        if w.sum():
            out[f] = (w[:, None] * each_term[k]).sum(axis=0) / w.sum()
    return out


class Labels:
    """The terms that speak for each (leaf, subject), as a table with a row for each term."""

    def __init__(self, said: pd.DataFrame, names: list[str]) -> None:
        self.names = names
        self.terms = np.unique(said["t"].to_numpy(np.int64))
        pairs = sorted({*zip(said["leaf"].tolist(), said["s"].tolist(), strict=True)})
        column = {p: j for j, p in enumerate(pairs)}
        self.leaf, self.subject = np.array([p[0] for p in pairs] or [0]), np.array([p[1] for p in pairs] or [0])
        self.score = np.zeros((len(self.terms) + 1, max(len(pairs), 1)), np.float32)  # the last row: terms that say nothing
        at = np.searchsorted(self.terms, said["t"].to_numpy(np.int64))
        self.score[at, [column[p] for p in zip(said["leaf"].tolist(), said["s"].tolist(), strict=True)]] = said["score"].to_numpy()

    def chosen(self, ids, ends, sure: float) -> np.ndarray:  # noqa: ANN001
        """Each sentence's (leaf, subject), as a column of ``score``; -1 for none. Scores of terms are summed, over the
        square root of the sentence's terms."""
        ids, ends = np.asarray(ids, np.int64), np.asarray(ends, np.int64)
        out = np.full(len(ends), -1)
        if not len(self.terms):
            return out
        row = np.minimum(np.searchsorted(self.terms, ids), len(self.terms) - 1)
        hit = np.flatnonzero(self.terms[row] == ids)
        if not len(hit):
            return out
        which = np.searchsorted(ends, hit, "right")
        first = np.flatnonzero(np.diff(which, prepend=-1))
        total = np.add.reduceat(self.score[row[hit]], first, axis=0)
        some = which[first]
        total /= np.sqrt(np.diff(ends, prepend=0)[some])[:, None]
        out[some] = np.where(total.max(axis=1) >= sure, total.argmax(axis=1), -1)
        return out


def shares(batches, labels: Labels, share: float, sure: float):  # noqa: ANN001, ANN201
    """Each document's mixture of leaves, summed by the subjects that they stand for."""
    for b in batches:
        rows = []
        for d, ids, ends in zip(b["doc_id"], b["ids"], b["ends"], strict=True):
            if len(ends) == 0:
                continue
            who = labels.chosen(ids, ends, sure)
            part = np.bincount(labels.subject[who[who >= 0]], minlength=len(labels.names)) / len(ends)
            rows += [(d, labels.names[j], float(part[j])) for j in np.flatnonzero(part >= share)]
        yield pd.DataFrame(rows, columns=["doc_id", "subject", "share"])


def readable(documents: DataFrame, leaves: DataFrame, *, text: str = "text", most: int = 12) -> DataFrame:
    """``leaves`` with the first ``most`` of their terms as words: those of the documents that have these hashes. A hash
    of several words is named by the least of them."""
    few = leaves.withColumn("terms", F.slice("terms", 1, most))
    wanted = {t for r in few.select("terms").collect() for t in r[0]}

    def run(batches):  # noqa: ANN001, ANN202
        left = set()
        for b in batches:
            for t in b["text"]:
                left |= {(h, p) for words in sentence_words(t) for w in words for h, p in zip(_terms(w), parts(w), strict=True) if h in wanted}
        yield pd.DataFrame(sorted(left), columns=["t", "word"])

    words = documents.select(F.col(text).alias("text")).dropna().mapInPandas(run, "t int, word string").groupBy("t").agg(F.min("word").alias("word"))
    each = few.select("leaf", "subject", F.posexplode("terms").alias("i", "t")).join(words, "t").groupBy("leaf", "subject").agg(F.array_sort(F.collect_list(F.struct("i", "word"))).alias("x"))
    at = each.select(F.col("leaf").alias("__f"), F.col("subject").alias("__s"), F.transform("x", lambda x: x["word"]).alias("words"))
    got = few.join(at, (F.col("leaf") == F.col("__f")) & F.col("subject").eqNullSafe(F.col("__s")), "left")
    return got.select("leaf", "subject", "weight", "documents", F.coalesce("words", F.array().cast("array<string>")).alias("terms"))
