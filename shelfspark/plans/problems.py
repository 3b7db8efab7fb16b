"""Queries of the general problems: references without a record, changes between snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.looks import id_key, look_alike
from ..functions.times import local_time
from ..operators.references import check_references, state_report
from ..operators.snapshots import snapshot_changes
from .run import skew_aware, table


def catalog_references(spark: SparkSession, d: str) -> DataFrame:
    """(ref_table, ref_key, period, at, item) of every feed, mall_link and kit row that names an item."""

    def of(name: str, key: str, at: str) -> DataFrame:
        rows = table(spark, d, name).select(F.lit(name).alias("ref_table"), F.col(key).alias("ref_key"), local_time(F.col(at)).alias("at"), F.col("catalogId").alias("item"))
        return rows.filter(F.col("item").isNotNull()).distinct()

    refs = of("feed", "id", "added").unionByName(of("mall_link", "gno", "at")).unionByName(of("kit", "id", "created"))
    return refs.select("ref_table", "ref_key", F.date_format("at", "yyyy-MM").alias("period"), "at", id_key(F.col("item")).alias("item"))


def _checked(spark: SparkSession, d: str) -> DataFrame:
    skew_aware(spark)
    items = table(spark, d, "catalog_gunpla").select(id_key(F.col("id")).alias("id"), local_time(F.col("firstSeen")).alias("seen"))
    return check_references(catalog_references(spark, d), items, [("item", "id")], carry=["seen"])


def _wrong(spark: SparkSession, d: str, got: DataFrame) -> DataFrame:
    """The references that are ``late``, ``deleted`` or ``missing``."""
    late = (F.col("_state") == "found") & (F.col("_state_seen") > F.col("at"))
    wrong = got.filter((F.col("_state") == "orphan") | late)
    gone = table(spark, d, "excluded").select(id_key(F.col("id")).alias("id"))
    wrong = wrong.withColumn("item", F.when(F.col("_state") == "orphan", F.col("item")))  # late ones need no look at the deleted
    wrong = check_references(wrong, gone, [("item", "id")], state="_gone")
    state = F.when(F.col("_state") == "found", "late").when(F.col("_gone") == "found", "deleted").otherwise("missing")
    return wrong.select("ref_table", "ref_key", "period", state.alias("state"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Problem 1: references to catalogue items that are missing, deleted or only seen later."""
    return _wrong(spark, d, _checked(spark, d)).distinct()


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    """Problem 1: references per table and month: how many, and how many of them are missing, deleted or late."""
    got = _checked(spark, d)
    right = got.filter((F.col("_state") == "found") & ~F.coalesce(F.col("_state_seen") > F.col("at"), F.lit(False)))
    each = right.select("ref_table", "ref_key", "period", F.lit("found").alias("state")).unionByName(_wrong(spark, d, got))
    return state_report(each, "state", ("missing", "deleted", "late"), "ref_table", "period")


def p1_partial(spark: SparkSession, d: str) -> DataFrame:
    """Problem 1, composite keys: kit (catalogId, grade, scale) against the catalogue under MATCH PARTIAL, by null mask; a kit's
    repeated rows count once."""
    skew_aware(spark)
    blank = lambda c: F.when(F.trim(c) != "", F.trim(c)).alias(c)
    kits = table(spark, d, "kit").select("id", id_key(F.col("catalogId")).alias("item"), blank("grade"), blank("scale")).distinct()
    items = table(spark, d, "catalog_gunpla").select(id_key(F.col("id")).alias("item"), blank("grade"), blank("scale"))
    got = check_references(kits, items, [(c, c) for c in ("item", "grade", "scale")], match="partial")
    mask = F.concat(*(F.when(F.col(c).isNull(), "-").otherwise(c[0]) for c in ("item", "grade", "scale")))
    return got.groupBy(mask.alias("mask"), F.col("_state").alias("state")).agg(F.count("*").alias("kits"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Problem 3: goods added, removed or changed from one complete snapshot of the mall to the next."""
    skew_aware(spark)
    goods = table(spark, d, "mall_good")
    days = table(spark, d, "mall_scan").filter("complete").select(F.date_format(local_time(F.col("at")), "yyyy-MM-dd").alias("seen"))
    series = look_alike(F.col("series"))
    values = {"name": look_alike(F.col("name")), "series": F.when(series != "", series), **{c: F.col(c) for c in ("price", "soldOut", "cate")}}
    return snapshot_changes(goods, days, snapshot="seen", key=["gno"], values=values, latest=[F.col("loaded_at")])


def p3_daily(spark: SparkSession, d: str) -> DataFrame:
    """Problem 3: how many goods were added, removed and changed by snapshot."""
    kinds = ("added", "removed", "changed")
    return p3_found(spark, d).groupBy("seen").agg(*(F.count_if(F.col("change") == k).alias(k) for k in kinds))


QUERIES = {f.__name__: f for f in (p1_found, p1_report, p1_partial, p3_found, p3_daily)}
