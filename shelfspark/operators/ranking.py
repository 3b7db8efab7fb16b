"""Ordered choices: quotas, chunks, pages, recency. Every order ends in a key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def quota(rows: DataFrame, first: Column, most_first: int, most_rest: int, order: Sequence[Column]) -> DataFrame:
    """The best ``most_first`` rows of those where ``first`` holds, then the best ``most_rest`` of all others.

    Two top-k passes (each partition sends k rows at most); nothing is sorted as a whole.
    """
    a = rows.filter(first).orderBy(*order).limit(most_first).withColumn("bucket", F.lit("first"))
    key = [c for c in rows.columns]
    rest = rows.join(a.select(*key), key, "left_anti") if most_first else rows
    b = rest.orderBy(*order).limit(most_rest).withColumn("bucket", F.lit("rest"))
    return a.unionByName(b)


def chunks(rows: DataFrame, order: Sequence[Column], size: int, most: int) -> DataFrame:
    """The first ``most`` rows in order, numbered, in chunks of ``size``."""
    top = rows.orderBy(*order).limit(most)
    rank = F.row_number().over(Window.orderBy(*order))
    return top.withColumn("rank", rank).withColumn("chunk", F.floor((F.col("rank") - 1) / size).cast("int"))


def recency(rows: DataFrame, key: str, day: Column, today: Column, window: int = 30) -> DataFrame:
    """Of each key: its last day up to today, the next after it, days since the last, and whether that is recent."""
    got = rows.groupBy(key).agg(F.max(F.when(day <= today, day)).alias("last"), F.min(F.when(day > today, day)).alias("next"))
    since = F.date_diff(today, F.col("last"))
    return got.withColumn("since", since).withColumn("recent", F.coalesce(since <= window, F.lit(False)))


def facet_counts(rows: DataFrame, facets: Sequence[str], chosen: dict[str, str]) -> DataFrame:
    """(facet, value, n): each facet's values counted under the filters of the other facets, in one pass."""
    hit = {f: (F.col(f) == chosen[f]) if f in chosen else F.lit(True) for f in facets}
    each = []
    for f in facets:
        others = F.lit(True)
        for g in facets:
            if g != f:
                others = others & hit[g]
        each.append(F.when(others, F.struct(F.lit(f).alias("facet"), F.col(f).cast("string").alias("value"))))
    return rows.select(F.explode(F.array_compact(F.array(*each))).alias("x")).groupBy("x.facet", "x.value").agg(F.count("*").alias("n"))


def tag_counts(rows: DataFrame, tags: str) -> DataFrame:
    return rows.select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def gaps(rows: DataFrame, key: str, at: str) -> DataFrame:
    """(key, n, least_gap): the least seconds between two of a key's rows that follow each other; null for one row."""
    lag = F.lag(at).over(Window.partitionBy(key).orderBy(at))
    epoch = lambda c: F.unix_micros(c.cast("timestamp")) / 1_000_000 if isinstance(c, Column) else None
    return rows.withColumn("__gap", epoch(F.col(at)) - epoch(lag)).groupBy(key).agg(F.count("*").alias("n"), F.min("__gap").alias("least_gap"))


def duplicate_groups(rows: DataFrame, form: Column, id_: str) -> DataFrame:
    """(form, n, first_id) of every form that more than one row has."""
    return rows.groupBy(form.alias("form")).agg(F.count("*").alias("n"), F.min(id_).alias("first_id")).filter("n > 1 and form is not null")


def unique_candidates(left: DataFrame, right: DataFrame, keys: Sequence[str], id_: str, target: str) -> DataFrame:
    """(id, target): rows of ``left`` whose key fits exactly one target; none where several do."""
    one = right.groupBy(*keys).agg(F.count_distinct(target).alias("__n"), F.min(target).alias(target)).filter("__n = 1").drop("__n")
    return left.join(one, list(keys)).select(id_, target)
