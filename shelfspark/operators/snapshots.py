"""What changed between full snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def row_hash(columns: Sequence[Column]) -> Column:
    """64 bits of the columns' values; a null is another value than any other, in its own place."""
    return F.xxhash64(*(x for c in columns for x in (c.isNull(), c)))


def snapshot_changes(
    rows: DataFrame, snapshots: DataFrame, *, snapshot: str, key: Sequence[str], values: dict[str, Column], latest: Sequence[Column]
) -> DataFrame:
    """(snapshot, *key, change): what was ``added``, ``removed`` or ``changed`` from one snapshot to the next.

    ``snapshots`` has the column ``snapshot`` of the complete ones; only rows of those count, in its order.
    Several rows for one (snapshot, key): the greatest ``latest`` holds, ties go to the greater hash. ``values``
    are the canonical columns that make a change, hashed to 64 bits before the shuffle. Then a full outer join
    of every snapshot with its successor on (key, position): a missing side is an addition or a removal,
    unequal hashes are a change. A null key names no record and is left out; the first snapshot gives no row;
    fewer than two snapshots, or no rows, give an empty result.

    A key repeated any number of times is reduced map-side before it is shuffled; keys of the join are unique.
    ``snapshots`` is one row per delivery; it is ranked without a shuffle of the rows.
    """
    order = snapshots.filter(F.col(snapshot).isNotNull()).select(F.col(snapshot).alias("__s")).distinct()
    order = order.withColumn("__i", F.row_number().over(Window.orderBy("__s")))
    order = order.withColumn("__next", F.lead("__s").over(Window.orderBy("__s")))
    names = [f"__k{i}" for i in range(len(key))]
    flat = rows.select(
        F.col(snapshot).alias("__s"), *(F.col(k).alias(n) for k, n in zip(key, names, strict=True)), row_hash(list(values.values())).alias("__h"), F.struct(*latest).alias("__at")
    ).dropna(subset=names)
    held = flat.groupBy("__s", *names).agg(F.max_by("__h", F.struct("__at", "__h")).alias("__h"))
    held = held.join(order, "__s")
    old = held.filter(F.col("__next").isNotNull()).select(*names, (F.col("__i") + 1).alias("__i"), F.col("__next").alias("__o"), F.col("__h").alias("__a"))
    new = held.filter(F.col("__i") > 1).select(*names, "__i", "__s", F.col("__h").alias("__b"))
    both = old.join(new, [*names, "__i"], "full")
    change = F.when(F.col("__o").isNull(), "added").when(F.col("__s").isNull(), "removed").when(F.col("__a") != F.col("__b"), "changed")
    out = both.select(F.coalesce("__s", "__o").alias(snapshot), *(F.col(n).alias(k) for n, k in zip(names, key, strict=True)), change.alias("change"))
    return out.filter(F.col("change").isNotNull())
