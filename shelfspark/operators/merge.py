"""Keeping tables up to date: latest rows, upserts by precedence, appends, fills. All are pure: run twice, no change."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(rows: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The row of each key with the greatest ``order``. Reduced map-side: a hot key sends one row a partition."""
    rest = [c for c in rows.columns if c not in key]
    got = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__r"))
    return got.select(*key, *(F.col(f"__r.{c}").alias(c) for c in rest))


def upsert(old: DataFrame, new: DataFrame, key: Sequence[str], rules: Mapping[str, str]) -> DataFrame:
    """Full outer join of the kept and the incoming rows, column by column: ``fill`` keeps what is there and fills
    nulls, ``take`` prefers the incoming, ``keep`` never changes, ``least``/``greatest`` compare (nulls lose).

    Adds ``change``: added, changed, same or gone (kept without an incoming row). Keys are unique on both sides.
    """
    a = old.select(*(F.col(k).alias(f"__a{k}") for k in key), *(F.col(c).alias(f"__o{c}") for c in rules), F.lit(True).alias("__old"))
    b = new.select(*(F.col(k).alias(f"__b{k}") for k in key), *(F.col(c).alias(f"__n{c}") for c in rules), F.lit(True).alias("__new"))
    on = [F.col(f"__a{k}") == F.col(f"__b{k}") for k in key]
    both = a.join(b, on, "full")
    make = {"fill": lambda o, n: F.coalesce(o, n), "take": lambda o, n: F.coalesce(n, o), "keep": lambda o, n: F.when(F.col("__old"), o).otherwise(n), "least": F.least, "greatest": F.greatest}
    out = {c: make[r](F.col(f"__o{c}"), F.col(f"__n{c}")) for c, r in rules.items()}
    differs = F.lit(False)
    for c, v in out.items():
        differs = differs | ~v.eqNullSafe(F.col(f"__o{c}"))
    change = F.when(F.col("__old").isNull(), "added").when(F.col("__new").isNull(), "gone").when(differs, "changed").otherwise("same")
    return both.select(*(F.coalesce(f"__a{k}", f"__b{k}").alias(k) for k in key), *(v.alias(c) for c, v in out.items()), change.alias("change"))


def append_new(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """The rows of ``new`` whose key ``old`` hasn't, once each."""
    return new.dropDuplicates(list(key)).join(old.select(*key).distinct(), list(key), "left_anti")


def healthy(count: Column, before: Column, complete: Column, ratio: float = 0.5) -> Column:
    """A snapshot to trust: complete, not empty, and not less than a part of the one before."""
    return complete & (count > 0) & (count >= ratio * F.coalesce(before, F.lit(0)))


def precedence(df: DataFrame, columns: Sequence[str], value: str, source: str) -> DataFrame:
    """``value``: the first non-blank of ``columns``; ``source``: which it is. Taking a source back is dropping it."""
    full = [F.when(F.trim(F.col(c)) != "", F.col(c)) for c in columns]
    named = [F.when(x.isNotNull(), F.lit(c)) for c, x in zip(columns, full, strict=True)]
    return df.withColumns({value: F.coalesce(*full), source: F.coalesce(*named)})


def forced(links: DataFrame, overrides: DataFrame, key: str, target: str) -> DataFrame:
    """Links under overrides (key, target): a null target forbids the link, another replaces it or adds it."""
    said = overrides.select(F.col(key).alias("__k"), F.col(target).alias("__t"), F.lit(True).alias("__said"))
    both = links.join(said, links[key] == F.col("__k"), "full")
    return both.select(F.coalesce(F.col(key), "__k").alias(key), F.when(F.col("__said"), F.col("__t")).otherwise(F.col(target)).alias(target)).filter(F.col(target).isNotNull())


def fill_blanks(df: DataFrame, other: DataFrame, key: str, columns: Sequence[str], filled: str = "filled") -> DataFrame:
    """Null or blank columns filled from the row of ``other`` with the key; ``filled`` names those that were."""
    side = other.select(F.col(key).alias("__k"), *(F.col(c).alias(f"__f{c}") for c in columns))
    both = df.join(side, df[key] == F.col("__k"), "left")
    empty = {c: F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "") for c in columns}
    got = {c: empty[c] & F.col(f"__f{c}").isNotNull() for c in columns}
    names = F.array_compact(F.array(*(F.when(got[c], F.lit(c)) for c in columns)))
    rest = [F.col(c) for c in df.columns if c not in columns]
    return both.select(*rest, *(F.when(got[c], F.col(f"__f{c}")).otherwise(F.col(c)).alias(c) for c in columns), F.concat_ws(",", names).alias(filled))


def same_content(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables have the same rows, in whatever order: counts and a sum of row hashes, one pass each."""
    if a.columns != b.columns:
        return False
    mark = lambda d: d.agg(F.count("*"), F.sum(F.xxhash64(*(x for c in d.columns for x in (F.col(c).isNull(), F.col(c)))).cast("decimal(38,0)"))).first()
    return tuple(mark(a)) == tuple(mark(b))
