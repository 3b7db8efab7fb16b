"""Matching entities across sources without keys.

Collective graph linkage. A mention (one thing of a source, with all its names) and a record of the catalogue
become candidates where they share a rare attribute: the sound of the model's name, in any of the record's
languages and spellings, whole or with a syllable missing, within a variant. Attributes that many records share are
refined by the grade and then by the scale, which veto anyway. An edge weighs what its attributes are worth, by inverse
frequency among the records, times how much of the mention's names bear them out. Meta-blocking drops a mention's edges
below half of its heaviest. Then grade, scale, price and series are compared, conflicts veto, and what remains is
refined: mentions that share a model number or a name and grade pull each other towards the same record, until
no similarity moves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.run import cut
from .lexicon import Lexicon
from .names import parsed, spells

@F.udf(T.ArrayType(T.StringType()), useArrow=True)
def _spells(key):  # noqa: ANN001, ANN202
    return spells(key) if key else []


def readings(names: DataFrame, *keep: str) -> DataFrame:
    """One row for each reading of a parsed name: a closing syllable may be a variant or part of the name."""
    plain = F.regexp_replace("variant", r"\+?kai\+?", "")
    both = F.array(F.struct(F.col("key"), F.col("variant")), F.when(F.col("either") != "", F.struct(F.col("either").alias("key"), plain.alias("variant"))))
    each = names.select("*", F.posexplode(F.filter(both, lambda r: r.isNotNull())).alias("reading", "__r")).filter("__r.key != ''")
    sure = F.when(F.col("either") == "", F.col("__r.variant")).alias("sure")
    return each.select(*keep, "reading", "__r.key", "__r.variant", sure, "latin", "grade", "scale", "code", "series", "contents")


def said(column: str):  # noqa: ANN201
    """What most names of a thing say; null if none says it."""
    return F.mode(F.when(F.col(column) != "", F.col(column)), deterministic=True).alias(column)


COMMON = 200  # records of an attribute from which it is refined


def link_mentions(mentions: DataFrame, records: DataFrame, where: DataFrame | None, lexicon: Lexicon, *, least: float = 0.6, margin: float = 0.05, still: float = 0.02) -> DataFrame:
    """(item_key, catalog_id, confidence): the record of each mention that has one.

    ``mentions``: item_key, name, price, series - any number of rows for a thing, all its names mean one product.
    ``records``: catalog_id, name (in any language; a record may have several), grade, scale, price, series.
    ``where``: the names of both with the series in them, see ``names.located``. ``lexicon``: variants and talk, see ``names.lexicon_of``.

    Null names say nothing; a mention without a readable name has no candidate. Nulls in grade, scale, price or
    series neither help nor veto. Repeated rows count once; the names' rows are pre-aggregated before parsing, so
    a thing with a third of all rows is one mention with its distinct names. Of equal candidates none is taken.
    Empty sides give no row. Confidence lies in (0, 1].

    Prices are compared by the ratio of the surest edges' prices, measured anew. Refinement ends when no similarity
    moves by ``still``: each round moves them by at most a quarter of the last, so it always does.
    """
    # What each mention says
    plain = mentions.filter("item_key is not null and name is not null")
    each = plain.groupBy("item_key", "name").agg(F.mode("price", deterministic=True).alias("price"), said("series"))
    head = parsed(each.withColumnRenamed("series", "told"), "name", where, lexicon, ("item_key", "price", "told"))
    names = cut(readings(head, "item_key", "price", "told"))
    about = names.groupBy("item_key").agg(
        said("grade"), said("scale"), said("code"), F.mode("price", deterministic=True).alias("price"), F.mode("sure", deterministic=True).alias("variant"),
        F.coalesce(said("told"), said("series")).alias("series"), F.count_if(F.col("reading") == 0).alias("names"),
    )
    about = cut(about)
    latin = F.when(F.col("latin") != "", F.regexp_replace("latin", " ", ""))
    keys = names.groupBy("item_key", "key", "variant").agg(F.count("*").alias("n"), F.max(latin).alias("latin"))

    # Records: each reading of each name; what the names don't say, the columns do
    plain = records.filter("catalog_id is not null and name is not null")
    got = plain.groupBy("catalog_id", "name").agg(*(F.max(c).alias(c) for c in ("grade", "scale", "price", "series")))
    got = parsed(got.withColumnsRenamed({"grade": "g", "scale": "s", "price": "p", "series": "t"}), "name", where, lexicon, ("catalog_id", "g", "s", "p", "t"))
    got = readings(got, "catalog_id", "g", "s", "p", "t")
    scale = F.coalesce(F.nullif("scale", F.lit("")), F.nullif(F.regexp_extract("s", r"1/(\d+)", 1), F.lit("")))
    grade = F.coalesce(F.nullif("grade", F.lit("")), F.nullif(F.regexp_replace("g", r"/.*", ""), F.lit("")))
    got = cut(got.select("catalog_id", F.col("key").alias("rkey"), "variant", grade.alias("rgrade"), scale.alias("rscale"), F.col("p").alias("rprice"), F.col("t").alias("rseries")))
    facts = got.groupBy("catalog_id").agg(said("rgrade"), said("rscale"), F.max("rprice").alias("rprice"), F.max("rseries").alias("rseries"))
    right = got.select("catalog_id", "rkey", "variant").distinct().withColumn("attrs", _spells("rkey"))
    right = right.select("catalog_id", "rkey", "variant", F.posexplode("attrs").alias("rpos", "attr"))
    total = max(1, got.select("catalog_id").distinct().count())
    rare = right.groupBy("attr", "variant").agg(F.countDistinct("catalog_id").alias("df"))
    worth = F.log1p(total / F.col("df")).alias("worth")
    fine = F.when(F.col("df") > COMMON, F.lit(True)).otherwise(F.lit(False)).alias("common")
    rare = cut(rare.select("attr", "variant", worth, fine))
    right = right.join(rare, ["attr", "variant"]).join(facts.select("catalog_id", "rgrade", "rscale"), "catalog_id")
    left = keys.select("item_key", "key", "variant", "n", "latin", _spells("key").alias("attrs")).filter(F.size("attrs") > 0)
    left = left.select("item_key", "key", "variant", "n", "latin", F.posexplode("attrs").alias("at", "attr")).withColumn("lpos", F.least("at", F.lit(1))).drop("at")
    left = left.join(rare.select("attr", "variant", "common"), ["attr", "variant"]).join(about.select("item_key", "grade", "scale"), "item_key")

    # Candidate graph: one syllable less on one side, not on both. A common attribute is joined within grade and scale: a side
    # that doesn't say stands with each that occurs.
    refined = lambda side, g, s: side.withColumn("finer", F.when(F.col("common"), F.concat_ws("|", F.coalesce(g, F.lit("?")), F.coalesce(s, F.lit("?")))).otherwise(""))
    kinds = facts.select(F.coalesce("rgrade", F.lit("?")).alias("fg"), F.coalesce("rscale", F.lit("?")).alias("fs")).distinct()
    left = refined(left, "grade", "scale")
    open_ = left.filter(F.col("common")).join(F.broadcast(kinds), (F.coalesce("grade", "fg") == F.col("fg")) | (F.col("fg") == "?")).filter((F.coalesce("scale", "fs") == F.col("fs")) | (F.col("fs") == "?"))
    left = left.filter(~F.col("common")).unionByName(open_.withColumn("finer", F.concat_ws("|", "fg", "fs")).drop("fg", "fs"))
    pairs = left.drop("grade", "scale", "common").join(refined(right, "rgrade", "rscale").drop("common"), ["attr", "variant", "finer"]).filter("lpos = 0 or rpos = 0")
    same = F.when(F.col("key") == F.col("rkey"), 1.0).when((F.col("lpos") == 0) & (F.col("rpos") == 0), 0.95).otherwise(0.8)
    pairs = pairs.groupBy("item_key", "catalog_id", "key", "n").agg(
        F.max(same).alias("sim"), F.max("worth").alias("worth"), F.max(F.col("latin") == F.regexp_replace("rkey", " ", "")).alias("latin"), F.min("variant").alias("variant"),
        F.collect_set("variant").alias("variants"),
    )
    edges = pairs.groupBy("item_key", "catalog_id").agg(
        F.sum(F.col("n") * F.col("sim")).alias("borne"), F.max("sim").alias("best"), F.max("worth").alias("worth"),
        F.max(F.coalesce("latin", F.lit(False))).alias("latin"), F.array_distinct(F.flatten(F.collect_set("variants"))).alias("variants"),
    )
    graph = edges.join(about, "item_key").filter(F.col("variant").isNull() | F.array_contains("variants", F.col("variant")))
    graph = graph.withColumn("weight", F.col("worth") * F.least(F.lit(1.0), F.col("borne") / F.col("names")))

    # Meta-blocking
    graph = graph.withColumn("top", F.max("weight").over(Window.partitionBy("item_key"))).filter(F.col("weight") >= 0.5 * F.col("top"))

    # Attributes of the edge: conflicts veto
    fits = lambda a, b: F.when(F.col(a).isNull() | F.col(b).isNull(), 0).when(F.col(a) == F.col(b), 1).otherwise(-1)
    graph = graph.join(facts, "catalog_id").withColumns({"g": fits("grade", "rgrade"), "sc": fits("scale", "rscale"), "se": fits("series", "rseries")})
    graph = cut(graph.filter("g >= 0 and sc >= 0").withColumn("rate", F.log(F.col("price") / F.when(F.col("rprice") > 0, F.col("rprice")))))
    usual = graph.filter("g = 1 and best >= 0.95").agg(F.median("rate").alias("usual"))
    off = F.abs(F.col("rate") - F.col("usual"))
    priced = F.when(off.isNull(), 0.0).when(off < 0.12, 1.0).when(off < 0.25, 0.3).otherwise(-1.0)
    name = F.greatest(F.least(F.lit(1.0), F.col("borne") / F.col("names")), F.when(F.col("latin"), 0.97).otherwise(0.0), F.col("best") * 0.8)
    score = 0.75 * name + 0.1 * F.col("g") + 0.1 * priced + 0.05 * F.greatest(F.col("sc"), F.col("se"))
    graph = graph.join(F.broadcast(usual)).select("item_key", "catalog_id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)).alias("own"))

    # Neighbours: hubs are the model number and the name with its grade
    hub = lambda kind, *c: F.when(F.expr(" and ".join(f"{x} is not null" for x in c)), F.concat_ws("|", F.lit(kind), *c))
    head = keys.groupBy("item_key").agg(F.max_by("key", F.struct("n", "key")).alias("key"))
    near = about.join(head, "item_key").select("item_key", F.explode(F.array(hub("code", "code", "variant", "grade"), hub("name", "key", "variant", "grade"))).alias("hub")).dropna()
    size = near.groupBy("hub").agg(F.count("*").alias("members")).filter("members > 1")
    near = cut(near.join(size, "hub"))
    graph = cut(graph.withColumn("s", F.col("own")))
    moved = 1.0
    while moved >= still:
        pull = near.join(graph, "item_key").groupBy("hub", "catalog_id").agg((F.sum("s") / F.max("members")).alias("pull"))
        pull = near.select("item_key", "hub").join(pull, "hub").groupBy("item_key", "catalog_id").agg(F.avg("pull").alias("pull"))
        new = graph.join(pull, ["item_key", "catalog_id"], "left")
        new = new.select("item_key", "catalog_id", "own", F.when(F.col("pull").isNull(), F.col("s")).otherwise(0.75 * F.col("own") + 0.25 * F.col("pull")).alias("t"), "s")
        new = cut(new)
        moved = new.agg(F.max(F.abs(F.col("t") - F.col("s")))).first()[0] or 0.0
        graph = new.select("item_key", "catalog_id", "own", F.col("t").alias("s"))
    best = Window.partitionBy("item_key").orderBy(F.desc("s"), "catalog_id")
    ranked = graph.withColumns({"rank": F.row_number().over(best), "next": F.lead("s").over(best)})
    sure = ranked.filter((F.col("rank") == 1) & (F.col("s") >= least) & ((F.col("s") - F.coalesce("next", F.lit(0.0))) >= margin))
    return sure.select("item_key", "catalog_id", F.round("s", 4).alias("confidence"))
