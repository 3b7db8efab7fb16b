"""Mixing sources to target weights.

Each document of a source gets the same expected number of copies: what its source owes to the mix over what the
source has. The whole part is given to every document; the fraction is rounded by the pivotal method, so that the
tokens of a source come out as owed to within one document. Two documents with fractions p, q and sizes s, t move
mass between them, s*p + t*q staying the same, until one fraction is 0 or 1; the direction is drawn so that each
keeps its expectation. Every bucket does that for its own documents and has at most one left a source; what
is left goes up a reduction tree. A document goes to the bucket and place that its id's hash says and draws come from
that too, so a mix depends on the documents only.
"""

from __future__ import annotations

import base64
import math
import os

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.run import cut

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def source_key(source: Column) -> Column:
    """One spelling of a source: small letters, words joined by underscores, no outer blanks; null for a blank."""
    return F.nullif(F.regexp_replace(F.lower(F.trim(source)), r"[\s_-]+", "_"), F.lit(""))


def encoder(path: str):  # noqa: ANN201
    """The byte-level BPE of a vocabulary file of ranks; its pattern stands in the package beside it."""
    import importlib.util

    import tiktoken

    spec = importlib.util.spec_from_file_location("public_tokenizers", os.path.join(os.path.dirname(path), "__init__.py"))
    about = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(about)
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=about.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, vocabulary: str, keep: tuple[str, ...], text: str = "text") -> DataFrame:
    """``documents`` (its columns ``keep``) with the tokens of their whole text; null text has none."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.select(*keep).schema)

    def run(batches):  # noqa: ANN001, ANN202
        own = encoder(vocabulary)
        for b in batches:
            n = [len(own.encode_ordinary(t)) if t else 0 for t in b["__text"]]
            yield b[list(keep)].assign(tokens=np.asarray(n, np.int64))

    return documents.select(*keep, F.col(text).alias("__text")).mapInPandas(run, f"{schema}, tokens bigint")


def owed(have: list[tuple[str, float, int, int]], total: float | None = None) -> dict[str, float]:
    """Tokens that each source (name, target share, most copies, tokens it has) gives to the mix.

    Without a total: the largest mix in which every source that has something meets its share, the shares of
    those that have nothing being spread over the others. With one: a source that can't reach its share gives all it
    may, and the others fill up in proportion to theirs.
    """
    alive = [(n, s, m * t) for n, s, m, t in have if t > 0 and m > 0 and s > 0]
    if not alive:
        return {n: 0.0 for n, *_ in have}
    if total is None:
        whole = sum(s for _, s, _ in alive)
        total = min(most * whole / s for _, s, most in alive)
    out, left = {n: 0.0 for n, *_ in have}, min(total, sum(x[2] for x in alive))
    while alive:
        whole = sum(s for _, s, _ in alive)
        full = [(n, s, most) for n, s, most in alive if most <= left * s / whole * (1 + 1e-12)]
        if not full:
            return out | {n: left * s / whole for n, s, _ in alive}
        for n, _, most in full:
            out[n] = float(most)
        left -= sum(most for *_, most in full)
        alive = [x for x in alive if x not in full]
    return out


def pivot(rows, rng) -> tuple[list[tuple], list[tuple]]:  # noqa: ANN001
    """(id, p, size) decided as 0 or 1 and at most one left over; sizes are above 0."""
    done, held = [], None
    for i, p, s in rows:
        if p <= EDGE or p >= 1 - EDGE:
            done.append((i, int(p > 0.5)))
            continue
        if held is None:
            held = (i, p, s)
            continue
        j, q, t = held
        up = min((1 - p) * s, q * t)  # tokens that may go from the held one to this
        down = min(p * s, (1 - q) * t)
        if rng.random() < down / (up + down):
            p, q = p + up / s, q - up / t
        else:
            p, q = p - down / s, q + down / t
        held = None
        for k, r, z in ((i, p, s), (j, q, t)):
            if r <= EDGE or r >= 1 - EDGE:
                done.append((k, int(r > 0.5)))
            else:
                held = (k, r, z)
    return done, [] if held is None else [held]


EDGE = 1e-9
BUCKET = 10_000


def mix(documents: DataFrame, targets: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", vocabulary: str | None = None, total: float | None = None, seed: int = 11) -> DataFrame:
    """(doc_id, source, tokens, copies) for every document of a source in ``targets``.

    ``targets``: source, target_share, max_repeat, one row for each source (a few; they are held by the driver).
    Sources are compared in one spelling. Documents of other or no source, and those without a token, are used 0
    times and have no row. Of repeated rows of a doc_id the one with most tokens counts, then the greatest source. No document is used more than max_repeat times; a
    source without documents gives nothing. Empty tables give no row.

    Documents are put into buckets of about ``BUCKET`` by a hash of their id, taken in its order, and draws are seeded by bucket and
    source: the mix depends on the documents alone, not on the cluster, nor on what is computed again. The tree has a
    fan-in of 64; its last step holds one row a source.
    """
    vocabulary = vocabulary or os.path.join(TOKENIZERS, VOCABULARY)
    spark = documents.sparkSession
    want = {r["k"]: (r["target_share"], r["max_repeat"]) for r in targets.select(source_key(F.col("source")).alias("k"), "target_share", "max_repeat").dropna().collect()}
    kind = documents.select(doc_id).schema[0].dataType.simpleString()
    out_schema = f"doc_id {kind}, source string, tokens bigint, copies bigint"
    if not want:
        return spark.createDataFrame([], out_schema)
    docs = documents.select(F.col(doc_id).alias("doc_id"), source_key(F.col(source)).alias("source"), F.col(text).alias("text"))
    docs = docs.filter(F.col("source").isin(*want)).dropna()
    sized = token_counts(docs, vocabulary, ("doc_id", "source")).filter("tokens > 0")  # the texts aren't shuffled
    sized = sized.groupBy("doc_id").agg(F.max(F.struct("tokens", "source")).alias("x")).select("doc_id", "x.source", "x.tokens")
    sized = cut(sized)
    buckets = max(1, math.ceil(sized.count() / BUCKET))
    hashed = F.xxhash64("doc_id", F.lit(seed))
    sized = sized.withColumns({"bucket": F.pmod(hashed, F.lit(buckets)), "h": hashed})
    has = {r["source"]: r["t"] for r in sized.groupBy("source").agg(F.sum("tokens").alias("t")).collect()}
    give = owed([(k, s, m, has.get(k, 0)) for k, (s, m) in want.items()], total)
    rate = {k: min(give[k] / has[k], float(want[k][1])) for k in has}
    whole = {k: int(math.floor(v + EDGE)) for k, v in rate.items()}

    state_schema = f"doc_id {kind}, source string, tokens bigint, bucket bigint, h bigint, p double, pick int"
    names = [f.split()[0] for f in state_schema.split(", ")]

    def level(step: int, first: bool):  # noqa: ANN202
        def run(batches):  # noqa: ANN001, ANN202
            left: dict[tuple, list[tuple]] = {}
            draws: dict[tuple, np.random.Generator] = {}
            for b in batches:
                rows = []
                for (u, k), g in b.groupby(["bucket", "source"], sort=True):
                    rng = draws.setdefault((u, k), np.random.default_rng([seed, step, int(u), *k.encode()]))
                    p = np.full(len(g), rate[k] - whole[k]) if first else g["p"].to_numpy()
                    key = list(zip(g["doc_id"].tolist(), g["tokens"].tolist(), g["h"].tolist(), strict=True))
                    done, left[u, k] = pivot([*left.get((u, k), []), *((x, float(q), x[1]) for x, q in zip(key, p, strict=True))], rng)
                    rows += [(i, k, t, u, h, None, pick) for (i, t, h), pick in done]
                yield table(rows)
            yield table([(i, k, t, u, h, p, None) for (u, k), v in left.items() for (i, t, h), p, _ in v])

        return run

    def table(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=names).astype({"p": "float64", "pick": "Int32"})

    def decide(rows: DataFrame, step: int) -> DataFrame:
        return cut(rows.repartition("bucket").sortWithinPartitions("bucket", "source", "h", "doc_id").mapInPandas(level(step, step == 0), state_schema))

    now, step = decide(sized, 0), 0
    decided, left = now.filter("pick is not null"), now.filter("pick is null")
    while buckets > 1:
        buckets, step = math.ceil(buckets / 64), step + 1
        now = decide(left.withColumn("bucket", F.floor(F.col("bucket") / 64)), step)
        decided, left = decided.unionByName(now.filter("pick is not null")), now.filter("pick is null")
    # one document a source at most: by its own probability
    last = left.withColumn("pick", (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1_000_003)) / 1_000_003 < F.col("p")).cast("int"))
    base = F.element_at(F.create_map(*(F.lit(x) for k, v in whole.items() for x in (k, v))), F.col("source")) if whole else F.lit(0)
    return decided.unionByName(last).select("doc_id", "source", "tokens", (F.col("pick") + base).cast("bigint").alias("copies"))


def report(copies: DataFrame, targets: DataFrame) -> DataFrame:
    """Each source's target and actual share, its documents, and what they are used for."""
    used = copies.groupBy("source").agg(
        F.count("*").alias("documents"), F.sum("tokens").alias("tokens"), F.sum("copies").alias("copies"), F.max("copies").alias("most_copies"), F.sum(F.col("tokens") * F.col("copies")).alias("mixed_tokens"),
    )
    want = targets.select(source_key(F.col("source")).alias("source"), "target_share", "max_repeat")
    all_ = used.agg(F.sum("mixed_tokens").alias("all_tokens"))
    out = want.join(used, "source", "left").join(F.broadcast(all_), how="left").fillna(0)
    return out.select(*(c for c in out.columns if c != "all_tokens"), F.when(F.col("all_tokens") > 0, F.col("mixed_tokens") / F.col("all_tokens")).otherwise(0.0).alias("actual_share"))
