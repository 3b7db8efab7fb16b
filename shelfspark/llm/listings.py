"""Product listings describing the same item.

Listings are read by ``names.Parser``; what they say alike is one form, however many listings say it. Forms of one
variant and contents are blocked on rare tokens - the sound of the model's name, whole on one side, whole or with a
syllable missing on the other; a token that many forms have is joined with one of the name's rarest trigrams - and
compared by the cosine of their character trigrams, weighted by inverse frequency among the forms. Disjoint
grades or model numbers veto, and so do variants, contents and any word that no rule reads. Confirmed pairs are clustered
by connected components; within a cluster each grade is a product, and a listing without a grade joins the one that its
number, size, scale and price fit best.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.run import cut
from .graph import components
from .lexicon import Lexicon
from .link import _spells, said
from .names import parsed, syllables


@F.udf(T.StringType(), useArrow=True)
def _latin_key(latin):  # noqa: ANN001, ANN202
    return " ".join(syllables(latin)) if latin else None


def trigrams(key: Column) -> Column:
    text = F.concat(F.lit("^"), F.regexp_replace(key, " ", ""), F.lit("$"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - 2)), lambda i: F.substr(text, i, F.lit(3))))


COMMON = 200  # forms of a token from which it is refined


def same_product(listings: DataFrame, where: DataFrame | None, lexicon: Lexicon, *, least: float = 0.4) -> DataFrame:
    """(listing_id, product): listings with the same ``product`` sell the same thing.

    ``where``: the names with the series in them, see ``names.located``. ``lexicon``: variants and talk, see ``names.lexicon_of``. Prices
    in yen are compared with others by the ratio that listings of one form and grade show.

    ``listings``: listing_id, name, price, currency. Repeated rows count once; a null name, or one without a
    readable model, sells nothing that can be matched and gives no row. Null price or currency neither helps nor
    vetoes. A form that a third of all listings share is compared once. Empty tables give no row.
    """
    rows = listings.filter("listing_id is not null and name is not null").groupBy("listing_id", "name").agg(F.max("price").alias("price"), F.max("currency").alias("currency"))
    kept = ("listing_id", "price", "currency")
    got = parsed(rows, "name", where, lexicon, kept)
    flat = F.regexp_replace("key", " ", "")
    spoken = F.when((F.col("latin") != "") & (F.col("latin") != flat), _latin_key(F.col("latin")))
    got = got.withColumns({"key": F.coalesce(spoken, "key"), "either": F.when(spoken.isNull(), F.col("either")).otherwise("")}).filter("key != ''")
    got = cut(got)

    # A closing syllable that may be a variant: the reading that other listings bear out
    plain = F.regexp_replace("variant", r"^kai\+|\+?kai\b", "")
    sure = got.filter("either = ''").groupBy("key", "variant", "contents").agg(F.count("*").alias("bear"))
    two = got.filter("either != ''").select(*kept, "grade", "scale", "code", "size", "contents", F.explode(F.array(
        F.struct("key", "variant", F.lit(0).alias("o")), F.struct(F.col("either").alias("key"), plain.alias("variant"), F.lit(1).alias("o")))).alias("r"))
    two = two.select("*", "r.key", "r.variant", "r.o").drop("r").join(sure, ["key", "variant", "contents"], "left")
    pick = Window.partitionBy("listing_id").orderBy(F.desc_nulls_last("bear"), "o")
    two = two.withColumn("n", F.row_number().over(pick)).filter("n = 1")
    fields = [*kept, "key", "variant", "contents", "grade", "scale", "code", "size"]
    each = cut(got.filter("either = ''").select(*fields).unionByName(two.select(*fields)))

    # Forms
    what = ["variant", "contents"]
    forms = each.groupBy("key", *what).agg(*(F.collect_set(F.when(F.col(c) != "", F.col(c))).alias(c) for c in ("grade", "code")))
    forms = forms.withColumn("node", F.concat_ws("|", "key", *what)).withColumn("spells", _spells("key"))
    forms = cut(forms.filter(F.size("spells") > 0).withColumn("grams", trigrams(F.element_at("spells", 1))))
    total = forms.count()
    df = forms.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("df"))
    weights = cut(forms.select("node", F.explode("grams").alias("gram")).join(df, "gram").select("node", "gram", F.log1p(total / F.col("df")).alias("w")))
    norms = weights.groupBy("node").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.slice(F.array_sort(F.collect_list(F.struct(-F.col("w"), "gram"))), 1, 3).alias("rare"))
    full = forms.join(norms.withColumn("rare", F.col("rare.gram")), "node")

    # Blocks: ids and what vetoes only. Of three trigrams of a name the other has one at least: a syllable more breaks two.
    side = full.select("node", "grade", "code", "grams", "rare", *what, F.posexplode("spells").alias("pos", "token"))
    often = side.groupBy(*what, "token").agg(F.count("*").alias("n")).select(*what, "token", (F.col("n") > COMMON).alias("common"))
    side = side.join(often, [*what, "token"])
    finer = lambda rows, grams: rows.withColumn("finer", F.explode(F.when(F.col("common"), F.col(grams)).otherwise(F.array(F.lit("")))))
    a, b = (rows.select(*what, "token", "finer", *(F.col(c).alias(f"{c}{k}") for c in ("node", "grade", "code"))) for k, rows in (("a", finer(side.filter("pos = 0"), "rare")), ("b", finer(side, "grams"))))
    pairs = a.join(b, [*what, "token", "finer"]).filter("nodea <> nodeb")
    for c in ("grade", "code"):
        pairs = pairs.filter((F.size(f"{c}a") == 0) | (F.size(f"{c}b") == 0) | F.arrays_overlap(f"{c}a", f"{c}b"))
    pairs = pairs.select(F.least("nodea", "nodeb").alias("a"), F.greatest("nodea", "nodeb").alias("b")).distinct()

    # Cosine, by trigrams
    of = lambda k: weights.select(F.col("node").alias(k), "gram", F.col("w").alias(f"w{k}"))
    dots = pairs.join(of("a"), "a").join(of("b"), ["b", "gram"]).groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("dot"))
    length = lambda k: norms.select(F.col("node").alias(k), F.col("norm").alias(f"norm{k}"))
    edges = dots.join(length("a"), "a").join(length("b"), "b").filter(F.col("dot") / (F.col("norma") * F.col("normb")) >= least).select("a", "b")
    roots = components(forms.select("node"), edges)

    # Grades within a cluster
    each = each.withColumn("node", F.concat_ws("|", "key", *what)).join(roots, "node")
    each = cut(each.select("listing_id", "root", "grade", "scale", "code", "size", "price", "currency"))
    rate = yen_rate(each, ["root", "grade"])
    each = each.withColumn("won", F.when(F.col("currency") == "JPY", F.col("price") * rate).otherwise(F.col("price").cast("double")))
    graded = each.filter("grade != ''")
    kinds = graded.groupBy("root", "grade").agg(said("scale"), F.median("won").alias("won"), F.collect_set(F.nullif("code", F.lit(""))).alias("codes"), F.collect_set(F.nullif("size", F.lit(""))).alias("sizes"))
    kinds = kinds.withColumnsRenamed({"grade": "g", "scale": "gscale", "won": "gwon"})
    open_ = each.filter("grade = ''").drop("grade").join(kinds, "root", "left")
    near = F.abs(F.log(F.col("won") / F.col("gwon")))
    near = F.least(near, F.abs(F.log(F.col("won") * rate / F.col("gwon"))))
    bad = (F.col("scale") != "") & F.col("gscale").isNotNull() & (F.col("scale") != F.col("gscale"))
    fit = F.when(F.array_contains("codes", F.col("code")), 2.0).otherwise(0.0) + F.when(F.array_contains("sizes", F.col("size")), 2.0).otherwise(0.0) - F.coalesce(F.least(near, F.lit(3.0)), F.lit(1.0))
    off = F.col("g").isNotNull() & bad
    best = Window.partitionBy("listing_id").orderBy(F.asc("off"), F.desc("fit"), "g")
    open_ = open_.withColumns({"off": off, "fit": fit}).withColumn("n", F.row_number().over(best)).filter("n = 1")
    other = F.when(F.col("off") | F.col("g").isNull(), F.concat(F.lit("1/"), F.col("scale"))).otherwise(F.col("g"))
    out = graded.select("listing_id", F.concat_ws("|", "root", "grade").alias("product"))
    return out.unionByName(open_.select("listing_id", F.concat_ws("|", F.col("root"), other).alias("product"))).distinct()


def yen_rate(rows: DataFrame, group: list[str]) -> Column:
    """How many of the other currency's units a yen stands for, as a number: the median over the groups with both. Null if none has."""
    log = F.log(F.when(F.col("price") > 0, F.col("price")))
    each = rows.groupBy(*group).agg(F.median(F.when(F.col("currency") == "JPY", log)).alias("y"), F.median(F.when(F.col("currency") != "JPY", log)).alias("w"))
    return F.lit(each.agg(F.exp(F.median(F.col("w") - F.col("y"))).alias("r")).first()["r"]).cast("double")


def groups_of(products: DataFrame) -> DataFrame:
    """(product, representative, listings): each product with its least listing and how many it has. With ``products`` this says
    all that the pairs say, in as many rows as there are listings."""
    return products.groupBy("product").agg(F.min("listing_id").alias("representative"), F.count_distinct("listing_id").alias("listings"))


def pairs_of(products: DataFrame) -> DataFrame:
    """(listing_a, listing_b): every two listings of a product, the smaller first."""
    a = products.select("product", F.col("listing_id").alias("listing_a"))
    b = products.select("product", F.col("listing_id").alias("listing_b"))
    return a.join(b, "product").filter("listing_a < listing_b").select("listing_a", "listing_b").distinct()
