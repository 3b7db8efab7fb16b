"""References to records that do not exist."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MATCH = ("simple", "partial", "full")


def check_references(
    refs: DataFrame, targets: DataFrame, keys: Sequence[tuple[str, str]], *, match: str = "simple", carry: Sequence[str] = (), state: str = "_state"
) -> DataFrame:
    """Every row of ``refs`` with ``state``: ``none`` (names nothing), ``found``, ``orphan`` or ``malformed``.

    ``keys`` pairs the columns of a composite reference with those of the target's key. References are grouped
    by their null mask and each mask is matched on its non-null columns alone, under SQL's declared semantics:
    *simple* - a reference with any null names nothing; *partial* - its non-null columns must occur together in
    some target; *full* - all or none may be null, else it is malformed. All masks go through one shuffle join
    whose key is the mask with the columns it leaves; the rows left without a partner are the anti-join.
    ``carry``: columns of the target added to found rows (the least value if several targets fit a mask).

    Nulls in targets match only masks that leave those columns out. Repeated targets count once and repeated
    references stay. Empty targets make every reference an orphan; empty refs give no row. Other columns of
    refs are kept whatever their names; names of helper columns are prefixed and never leave the function.
    One hot key is joined against one target row, so adaptive skew splitting of the reference side is enough.
    """
    if match not in MATCH:
        raise ValueError(f"match is one of {MATCH}")
    n = len(keys)
    whole = (1 << n) - 1
    mask = sum((F.when(F.col(r).isNotNull(), 1 << i).otherwise(0) for i, (r, _) in enumerate(keys)), F.lit(0))
    left = refs.withColumn("__mask", mask)
    masks = [m for m in range(1, whole + 1)] if match == "partial" else [whole]
    used = F.when(F.col("__mask").isin(masks), True)
    left = left.withColumns({f"__k{i}": F.when(used, F.col(r)) for i, (r, _) in enumerate(keys)} | {"__m": F.when(used, F.col("__mask"))})

    got = targets.select(*(F.col(t).alias(f"__t{i}") for i, (_, t) in enumerate(keys)), *(F.col(c).alias(f"__c{j}") for j, c in enumerate(carry)))
    got = got.withColumn("__n", F.explode(F.array(*map(F.lit, masks))))
    for m in masks:  # a null in a column of the mask fits nothing
        need = [F.col(f"__t{i}").isNotNull() for i in range(n) if m >> i & 1]
        bad = ~need[0]
        for x in need[1:]:
            bad = bad | ~x
        got = got.filter(~((F.col("__n") == m) & bad))
    kept = {f"__t{i}": F.when(F.col("__n").bitwiseAND(1 << i) != 0, F.col(f"__t{i}")) for i in range(n)}
    got = got.withColumns(kept).groupBy("__n", *kept).agg(F.lit(True).alias("__hit"), *(F.min(f"__c{j}").alias(f"__c{j}") for j in range(len(carry))))

    on = F.col("__m") == F.col("__n")
    for i in range(n):
        on = on & (F.col(f"__k{i}") == F.col(f"__t{i}") if masks == [whole] else F.col(f"__k{i}").eqNullSafe(F.col(f"__t{i}")))
    joined = left.join(got, on, "left")
    verdict = F.when(F.col("__mask") == 0, "none").when(F.col("__hit"), "found").when(F.col("__m").isNotNull(), "orphan")
    verdict = verdict.otherwise("malformed" if match == "full" else "none")
    return joined.select(*(F.col(f"`{c}`") for c in refs.columns), verdict.alias(state), *(F.col(f"__c{j}").alias(f"{state}_{c}") for j, c in enumerate(carry)))


def state_report(refs: DataFrame, state: str, bad: Sequence[str], table: str, period: str) -> DataFrame:
    """(table, period, refs, one column for each state of ``bad``): the references that name something, counted by table and period."""
    return refs.groupBy(table, period).agg(F.count("*").alias("refs"), *(F.count_if(F.col(state) == x).alias(x) for x in bad))
