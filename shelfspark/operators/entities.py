"""Resolution of shop names against a catalogue: variants, blocks by grade and scale, model numbers, guard, margin, reasons."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import shopnames as N
from ..plans.run import cut

LINES = ("gunpla", "girl")
_KEY = ["grade", "scale", "text", "models"]
_PICKS = "grade string, scale string, text string, models string, target string, sq double, sp double, score double, conflict boolean, why string"


def _reader(read: Callable) -> Callable[[Column], Column]:
    @F.pandas_udf("grade string, scale string, text string, models string")
    def parsed(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([read(x) for x in s], columns=_KEY, dtype="object")

    return parsed


@F.pandas_udf(T.StructType([T.StructField("texts", T.ArrayType(T.StringType())), T.StructField("models", T.StringType())]))
def _item(a: pd.Series, b: pd.Series, c: pd.Series, ja: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([N.read_item([x, y, z], j) for x, y, z, j in zip(a, b, c, ja, strict=True)], columns=["texts", "models"])


def candidates(items: DataFrame) -> DataFrame:
    """(target, block, of, other, numbers): a row for each distinct name of an item (id, line, grade, scale, nameKo, nameKoAi, nameKoJoy, nameJa)."""
    read = items.filter(F.col("line").isin(*LINES)).select(F.col("id").alias("target"), F.coalesce("grade", F.lit("")).alias("block"), F.coalesce("scale", F.lit("")).alias("of"), _item("nameKo", "nameKoAi", "nameKoJoy", "nameJa").alias("x"))
    return read.select("target", "block", "of", F.explode("x.texts").alias("other"), F.col("x.models").alias("numbers"))


def _picker(keep: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def pick(asked: pd.DataFrame, pool: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked) and len(pool):
            pool = pool.sort_values(["target", "other"], ignore_index=True)
            targets, others, numbers, of = (pool[c].tolist() for c in ("target", "other", "numbers", "of"))
            scales = pool["of"].to_numpy(dtype=object)
            sq, sp = N.Pool([N.squash(t) for t in others]), N.Pool([N.in_order(N.spaced(t)) for t in others])
            for q in asked[_KEY].itertuples(index=False):
                fits = (scales == "") | (scales == q.scale) if q.scale else np.ones(len(of), dtype=bool)
                both = [np.where(fits, r, -1.0) for r in (sq.ratios(N.squash(q.text)), sp.ratios(N.in_order(N.spaced(q.text))))]
                chosen: set[int] = set()
                for r in both:
                    top = np.sort(r)[-keep:][0] if len(r) > keep else 0.0
                    chosen.update(np.flatnonzero(r >= top).tolist() if top > 0 else [*np.flatnonzero(r > 0).tolist(), *np.flatnonzero(r == 0)[:keep].tolist()])
                for i in chosen:
                    score, conflict = N.weigh(max(both[0][i], both[1][i]), q.models, numbers[i])
                    out.append((*q, targets[i], both[0][i], both[1][i], score, conflict, N.guard(q.text, others[i])))
        return pd.DataFrame(out, columns=[x.split()[0] for x in _PICKS.split(", ")])

    return pick


def best_match(names: DataFrame, items: DataFrame, read: Callable, *, keep: int = 12, least: float = 80.0, margin: float = 10.0, sure: float = 92.0, block: int = 20_000) -> DataFrame:
    """(id, target, score, margin, conflict, name_ok, guarded, reason) for every row of names (id, name); ``read`` reads a name.

    Every pair of a block is scored: names of the same grade family whose scale is the same or the item's null. The ``keep`` best by each of two ratios (squashed
    texts; words in order) go on, ties all, so nothing depends on the order of rows. A block with many rows on either side is split into
    parts of about ``block`` rows, each scored in a task, so memory is bounded; the best of all parts are chosen from the best of each.
    Reasons: linked, no-grade, no-name, no-candidates, low-score, guard, model-conflict, ambiguous.
    """
    asked = names.select("name").distinct().select("name", _reader(read)("name").alias("x")).select("name", "x.*")
    asked = cut(asked)
    pool = cut(candidates(items))
    fit = asked.filter("grade is not null and text <> ''").select(*_KEY).distinct()
    wide, tall = -(-fit.count() // block) * 8 or 1, -(-pool.count() // block) or 1
    family = F.coalesce(*(F.when(F.col("grade") == g, F.array(*map(F.lit, x))) for g, x in N.FAMILIES.items()), F.array("grade"))
    left = fit.withColumns({"block": F.explode(family), "i": F.pmod(F.xxhash64("text", "models"), F.lit(wide).cast("bigint"))}).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(tall - 1))))
    right = pool.withColumn("j", F.pmod(F.xxhash64("target", "other"), F.lit(tall)).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(wide - 1).cast("bigint"))))
    pick = _picker(keep)
    found = left.groupBy("block", "i", "j").cogroup(right.groupBy("block", "i", "j")).applyInPandas(pick, _PICKS)
    rank = lambda c: F.rank().over(Window.partitionBy(*_KEY).orderBy(F.desc(c)))
    picks = found.withColumns({"a": rank("sq"), "b": rank("sp")}).filter((F.col("a") <= keep) | (F.col("b") <= keep))
    passed = F.col("why").isNull()
    refused = F.min(F.when(~passed & (F.col("score") >= least), F.struct((-F.col("score")).alias("s"), "target", "why")))
    each = picks.groupBy(*_KEY, "target").agg(F.max(F.when(passed, F.col("score"))).alias("p"), F.max("score").alias("s"), F.max("conflict").alias("conflict"), refused.alias("g"))
    ask = Window.partitionBy(*_KEY)
    order = ask.orderBy(F.desc_nulls_last("p"), F.desc("s"), "target")
    top = each.withColumns({"k": F.row_number().over(order), "second": F.coalesce(F.lead("p").over(order), F.lit(0.0)), "guarded": F.min("g").over(ask).getField("why")}).filter("k = 1")
    score = F.coalesce("p", "s")
    gap = F.round(score - F.when(F.col("p").isNull(), 0.0).otherwise(F.col("second")), 9)
    refuse = F.when(F.col("guarded").isNotNull(), "guard").otherwise("low-score")
    reason = F.when(F.col("p").isNull() | (F.col("p") < least), refuse).when(F.col("conflict"), "model-conflict").when(gap < margin, "ambiguous").otherwise("linked")
    decided = top.select(*_KEY, "target", score.alias("score"), gap.alias("margin"), "conflict", (F.coalesce("p", F.lit(0.0)) >= sure).alias("sure"), "guarded", reason.alias("reason"))
    got = names.join(asked, "name", "left").join(decided, _KEY, "left")
    none = F.when(F.col("grade").isNull(), "no-grade").when(F.col("text") == "", "no-name").otherwise("no-candidates")
    reason = F.coalesce("reason", none)
    return got.select("id", "target", F.round("score", 1).alias("score"), F.round("margin", 1).alias("margin"), F.coalesce("conflict", F.lit(False)).alias("conflict"), ((reason == "linked") & F.coalesce("sure", F.lit(False))).alias("name_ok"), "guarded", reason.alias("reason"), F.col("score").alias("exact"))


def claims(links: DataFrame, goods: DataFrame, items: DataFrame, taken: DataFrame, *, low: float = 9.5, high: float = 12.5) -> DataFrame:
    """A mall's links: a price out of proportion is ``price-mismatch``; of the links to one item only the best holds, the least number on a
    tie, and none if ``taken`` (target) has the item: the others are ``duplicate``. goods (id, price), items (target, jpy)."""
    rows = links.join(goods, "id", "left").join(items, "target", "left").join(taken.distinct().withColumn("has", F.lit(True)), "target", "left")
    ratio = F.col("price") / F.when(F.col("jpy") != 0, F.col("jpy"))
    rows = rows.withColumn("reason", F.when((F.col("reason") == "linked") & ~F.coalesce(ratio.between(low, high), F.lit(True)), "price-mismatch").otherwise(F.col("reason")))
    open_ = rows.filter("reason = 'linked' and has is null")
    first = open_.groupBy("target").agg(F.min(F.struct((-F.col("exact")).alias("s"), F.col("id").cast("bigint").alias("n"), "id")).alias("x")).select("target", F.col("x.id").alias("first"))
    rows = rows.join(first, "target", "left")
    held = F.coalesce(F.col("first") == F.col("id"), F.lit(False))
    reason = F.when((F.col("reason") == "linked") & ~held, "duplicate").otherwise(F.col("reason"))
    return rows.withColumn("reason", reason).withColumn("name_ok", F.col("name_ok") & (F.col("reason") == "linked")).select(*links.columns)
