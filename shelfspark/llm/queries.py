"""Queries of the llm problems with the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.oracles import look_sql
from ..plans.run import cut, skew_aware, table
from ..functions.looks import id_key
from . import leaks, link, listings, lookalike, mixing, names, subjects


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Problem 4: kits whose name only looks like a name of the catalogue."""
    skew_aware(spark)
    kits, items = table(spark, d, "kit").select("id", "name"), table(spark, d, "catalog_gunpla").select("nameJa", "nameKo")
    return lookalike.same_look(kits, "name", items, "nameJa", "nameKo").select(F.col("id").alias("kit_id")).distinct()


def p4_forms(spark: SparkSession, d: str) -> DataFrame:
    """Problem 4: every name of the tables in its one form, with the ways it is written."""
    names = [table(spark, d, t).select(F.col(c).alias("text")) for t, c in (("kit", "name"), ("catalog_gunpla", "nameJa"), ("catalog_gunpla", "nameKo"), ("mall_good", "name"), ("arrival_row", "name"))]
    both = names[0]
    for n in names[1:]:
        both = both.unionByName(n)
    return lookalike.forms(both, "text")


def series_of(spark: SparkSession, d: str) -> DataFrame:
    """The catalogue's series in both languages, one column."""
    return table(spark, d, "catalog_gunpla").select(F.explode(F.array("series", "seriesKo")).alias("s"))


def catalog_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "catalog_gunpla").select(F.col("nameJa").alias("ja"), F.col("nameKo").alias("ko"))


def p5_products(spark: SparkSession, d: str) -> DataFrame:
    """Problem 5: each listing with the product it sells."""
    skew_aware(spark)
    rows = table(spark, d, "shop_listing").select("listing_id", "name", "price", "currency")
    where = names.located(rows, "name", series_of(spark, d))
    lexicon = names.lexicon_of(rows.select(F.col("name").alias("text"), F.when(F.col("currency") == "KRW", F.col("price")).alias("price")), catalog_names(spark, d), where)
    return listings.same_product(rows, where, lexicon)


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    """Problem 5: each product with its first listing and how many it has."""
    return listings.groups_of(p5_products(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Problem 5: every two listings that sell the same product."""
    return listings.pairs_of(p5_products(spark, d))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Problem 6: documents with passages of evaluation items."""
    return leaks.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_item"))


def p6_items(spark: SparkSession, d: str) -> DataFrame:
    """Problem 6: which items leaked, and into how many documents."""
    return p6_found(spark, d).groupBy("item_id").agg(F.count("*").alias("documents"))


def unlinked(spark: SparkSession, d: str, *, known: bool = False) -> DataFrame:
    """Mall goods and arrival codes without a known item, or (to measure by) those with one."""
    how = "left_semi" if known else "left_anti"
    goods = table(spark, d, "mall_good").select(F.col("gno").alias("item_key"), "name", "price", "series")
    goods = goods.join(table(spark, d, "mall_link").select(F.col("gno").alias("item_key")).dropna().distinct(), "item_key", how)
    fed = table(spark, d, "feed").filter(F.col("id").startswith("jh-") & id_key(F.col("catalogId")).isNotNull())
    fed = fed.select(F.regexp_extract("id", r"^jh-[^-]*-(.+)$", 1).alias("item_key")).filter("item_key != ''").distinct()
    fed = cut(fed)  # the mentions are read more than once
    codes = table(spark, d, "arrival_row").select(F.col("code").alias("item_key"), "name", "price", F.lit(None).cast("string").alias("series"))
    return goods.unionByName(codes.join(fed, "item_key", how))


def p2_links(spark: SparkSession, d: str, *, known: bool = False) -> DataFrame:
    """Problem 2: mall goods and arrival codes with their catalogue item and a confidence."""
    skew_aware(spark)
    catalog = table(spark, d, "catalog_gunpla")
    each = F.explode(F.array("nameJa", "nameKo")).alias("name")
    records = catalog.select(F.col("id").alias("catalog_id"), each, "grade", "scale", F.col("priceJpy").alias("price"), F.col("seriesKo").alias("series"))
    mentions = unlinked(spark, d, known=known)
    texts = cut(mentions.filter("name is not null").groupBy(F.col("name").alias("text")).agg(F.median("price").alias("price")))
    where = names.located(texts.select("text").union(records.select("name")), "text", series_of(spark, d))
    lexicon = names.lexicon_of(texts, catalog_names(spark, d), where)
    return link.link_mentions(mentions, records, where, lexicon)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Problem 2: the catalogue item of each mall good and arrival code without a known one."""
    return p2_links(spark, d).select("item_key", "catalog_id").distinct()


def p7_copies(spark: SparkSession, d: str) -> DataFrame:
    """Problem 7: how often each document is used in the mix."""
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_target"))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    """Problem 7: the share that each source really got."""
    targets = table(spark, d, "mix_target")
    return mixing.report(mixing.mix(table(spark, d, "documents"), targets), targets)


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """Problem 8: each document's subjects with their share of its sentences."""
    found, _ = subjects.subject_areas(table(spark, d, "documents"), table(spark, d, "subject_label"))
    return found


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Problem 8: each document's subjects."""
    return p8_shares(spark, d).select("doc_id", "subject").distinct()


def p8_leaves(spark: SparkSession, d: str) -> DataFrame:
    """Problem 8: the leaves of the clustering, what they are about, and the terms that say so."""
    documents = table(spark, d, "documents")
    _, leaves = subjects.subject_areas(documents, table(spark, d, "subject_label"))
    return subjects.readable(documents, leaves)


QUERIES = {f.__name__: f for f in (p2_found, p2_links, p4_found, p4_forms, p5_found, p5_products, p5_groups, p6_found, p6_items, p7_copies, p7_mix, p8_found, p8_shares, p8_leaves)}
_TEXTS = "SELECT nameJa AS t FROM catalog_gunpla UNION SELECT nameKo FROM catalog_gunpla"
ORACLES: dict[str, str] = {
    "p4_found": f"""WITH c AS ({_TEXTS}), k AS (SELECT DISTINCT id, name FROM kit WHERE name IS NOT NULL)
 SELECT DISTINCT id AS kit_id FROM k WHERE {look_sql("name")} IN (SELECT {look_sql("t")} FROM c WHERE t IS NOT NULL) AND name NOT IN (SELECT t FROM c WHERE t IS NOT NULL)""",
}
