"""Queries of the catalogue's upkeep: projections, worklists, orders, merges of versions, suggestions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.phonetics import likeness, sound_skeleton
from ..operators import ranking as R
from .run import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
TODAY = "2026-08-01"


def query(sql: str | None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def items(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """One row an id: of every column the last value that isn't null, by the time of the version."""
    c = table(spark, d, "catalog_gunpla")
    return c.groupBy("id").agg(*(F.max_by(F.when(F.col(x).isNotNull(), F.col(x)), F.when(F.col(x).isNotNull(), F.struct("updated", F.col(x)))).alias(x) for x in columns))


def _items_sql(*columns: str) -> str:
    return "SELECT id, " + ", ".join(f"arg_max({c}, (updated, {c})) FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in columns) + " FROM catalog_gunpla GROUP BY id"


@query(_items_sql("nameJa", "nameKo", "priceJpy", "scale", "series"))
def version_compaction(spark, d):
    """The fullest row of each id from all its versions."""
    return items(spark, d, "nameJa", "nameKo", "priceJpy", "scale", "series")


@query("""SELECT DISTINCT id, priceJpy AS price, release.month AS month, release.date AS date FROM catalog_gunpla WHERE priceJpy IS NOT NULL AND release.month IS NOT NULL""")
def price_release_parse(spark, d):
    """Prices and releases read again from the text of a card."""
    c = table(spark, d, "catalog_gunpla").filter("priceJpy is not null and release.month is not null")
    text = F.concat(F.format_number("priceJpy", 0), F.lit("円（税込） "), F.regexp_replace(F.coalesce("release.date", "release.month"), r"^(\d{4})-0?(\d+)(?:-0?(\d+))?$", "$1年$2月$3日"), F.lit("発売"))
    t = c.select("id", F.regexp_replace(text, "月日", "月").alias("t"))
    pad = lambda k: F.lpad(F.regexp_extract("t", r"(\d{4})年(\d{1,2})月(?:(\d{1,2})日)?", k), 2, "0")
    month = F.concat_ws("-", F.regexp_extract("t", r"(\d{4})年", 1), pad(2))
    price = F.regexp_replace(F.regexp_extract("t", r"(\d[\d,]*)円", 1), ",", "").cast("long")
    return t.select("id", price.alias("price"), month.alias("month"), F.when(F.col("t").rlike("日発"), F.concat_ws("-", month, pad(3))).alias("date")).distinct()


@query("""WITH r AS (SELECT DISTINCT id, trim(r) AS r FROM (SELECT id, unnest([url, id, replace(id, 'bh-', ''), pbUrl, 'x' || id, repeat('a', 301)]) AS r FROM catalog_gunpla))
 SELECT id, r AS text, CASE WHEN length(r) > 300 THEN NULL WHEN regexp_matches(r, '(?i)site/item/[0-9]{2}_[0-9]+|example/item/[0-9]{2}_[0-9]+') THEN 'bh-' || regexp_extract(r, '/item/([0-9]{2}_[0-9]+)', 1) WHEN regexp_matches(r, '(?i)^(bh-)?[0-9]{2}_[0-9]+$') THEN 'bh-' || regexp_extract(r, '([0-9]{2}_[0-9]+)$', 1)
  WHEN regexp_matches(r, '(?i)example/item/item-[0-9]+') THEN 'pb-' || regexp_extract(r, '/item/(item-[0-9]+)', 1) WHEN regexp_matches(r, '(?i)^pb-item-[0-9]+$') THEN r END AS ref FROM r WHERE r IS NOT NULL""")
def reference_parser(spark, d):
    """What a pasted text refers to: a page's address, an id or a number; null for anything else and for over 300 characters."""
    each = F.array(F.col("url"), F.col("id"), F.replace("id", F.lit("bh-"), F.lit("")), F.col("pbUrl"), F.concat(F.lit("x"), "id"), F.repeat(F.lit("a"), F.lit(301)))
    rows = table(spark, d, "catalog_gunpla").select("id", F.explode(F.array_compact(each)).alias("text")).distinct()
    return rows.select("id", F.trim("text").alias("text"), S.reference(F.trim("text"), r"[\w.]+\.example").alias("ref"))


@query("""SELECT DISTINCT id, len(photos) AS photos, CASE WHEN len(photos) > 0 THEN list_distinct(list_transform(photos, lambda p: p.src))[1] IS NOT NULL ELSE false END AS any, coalesce(cover, '') LIKE 'off:%' AS official FROM kit""")
def photo_counts(spark, d):
    srcs = F.array_distinct(F.transform("photos", lambda p: p["src"]))
    return table(spark, d, "kit").select("id", F.size("photos").cast("long").alias("photos"), (F.size(srcs) > 0).alias("any"), F.coalesce("cover", F.lit("")).startswith("off:").alias("official")).distinct()


@query("""WITH k AS (SELECT DISTINCT id, list_transform(photos, lambda p: p.src) AS mine, cover FROM kit) SELECT id, array_to_string(list_concat(list_filter(['off:1', 'off:2'], lambda x: x = coalesce(cover, '')), list_filter(['off:1', 'off:2'], lambda x: x <> coalesce(cover, '')), mine), '|') AS ordered FROM k""")
def photo_order(spark, d):
    """The cover first, then the other official pictures, then one's own."""
    k = table(spark, d, "kit").select("id", F.transform("photos", lambda p: p["src"]).alias("mine"), F.coalesce("cover", F.lit("")).alias("c")).distinct()
    off = F.array(F.lit("off:1"), F.lit("off:2"))
    return k.select("id", F.concat_ws("|", F.concat(F.filter(off, lambda x: x == F.col("c")), F.filter(off, lambda x: x != F.col("c")), "mine")).alias("ordered"))


@query("""SELECT DISTINCT id, 'https://search.example/?q=' || url_encode(nameJa) AS link FROM catalog_gunpla""")
def search_links(spark, d):
    enc = F.regexp_replace(F.regexp_replace(F.url_encode("nameJa"), r"\+", "%20"), r"\*", "%2A")
    return table(spark, d, "catalog_gunpla").select("id", F.concat(F.lit("https://search.example/?q="), enc).alias("link")).distinct()


@query("""SELECT DISTINCT gno, '₩' || format('{:,}', price) AS price FROM mall_good WHERE price IS NOT NULL""")
def money_format(spark, d):
    return table(spark, d, "mall_good").filter("price is not null").select("gno", F.concat(F.lit("₩"), F.format_number("price", 0)).alias("price")).distinct()


@query("""SELECT DISTINCT replace(id, '-item-', '-new-') AS id, CASE WHEN id LIKE 'pb-%' THEN 'pb-new' ELSE 'new' END AS type, coalesce(release.date, release.month) AS date, images[1] AS image FROM catalog_gunpla""")
def new_item_projection(spark, d):
    c = table(spark, d, "catalog_gunpla")
    kind = F.when(F.col("id").startswith("pb-"), "pb-new").otherwise("new")
    return c.select(F.replace("id", F.lit("-item-"), F.lit("-new-")).alias("id"), kind.alias("type"), F.coalesce("release.date", "release.month").alias("date"), F.try_element_at("images", F.lit(1)).alias("image")).distinct()


@query(f"""SELECT DISTINCT id FROM feed WHERE datediff('day', CAST(substr(added, 1, 10) AS DATE), DATE '{TODAY}') <= 30""")
def recent_feed(spark, d):
    # rows of days to come are recent too
    age = F.date_diff(F.lit(TODAY).cast("date"), F.substring("added", 1, 10).cast("date"))
    return table(spark, d, "feed").filter(age <= 30).select("id").distinct()


@query("""SELECT DISTINCT id FROM feed WHERE (contains(title, 'Ver.2') OR contains(title, '[MG]')) AND id NOT IN (SELECT id FROM feed WHERE type = 'kr-restock')""")
def candidate_titles(spark, d):
    feed = table(spark, d, "feed")
    hit = F.col("title").contains("Ver.2") | F.col("title").contains("[MG]")
    return feed.filter(hit).select("id").distinct().join(feed.filter("type = 'kr-restock'").select("id").distinct(), "id", "left_anti")


@query("""SELECT substr(a.postDate, 1, 7) AS month, count(*) AS rows, count(DISTINCT c.id) AS items FROM (SELECT DISTINCT post, code, postDate FROM arrival_row) a
 JOIN (SELECT DISTINCT id, catalogId FROM feed) f ON f.id = 'jh-' || a.post || '-' || a.code JOIN (SELECT DISTINCT id FROM catalog_gunpla) c ON c.id = f.catalogId GROUP BY 1""")
def arrival_join_chain(spark, d):
    a = table(spark, d, "arrival_row").select("post", "code", "postDate").distinct().withColumn("id", F.concat(F.lit("jh-"), "post", F.lit("-"), "code"))
    f = table(spark, d, "feed").select("id", "catalogId").distinct()
    c = table(spark, d, "catalog_gunpla").select(F.col("id").alias("catalogId")).distinct()
    return a.join(f, "id").join(c, "catalogId").groupBy(F.substring("postDate", 1, 7).alias("month")).agg(F.count("*").alias("rows"), F.count_distinct("catalogId").alias("items"))


_DICT = "SELECT seriesKey, arg_max(series, series) AS ja, arg_max(seriesKo, seriesKo) AS ko FROM catalog_gunpla WHERE seriesKey IS NOT NULL GROUP BY 1"


@query(f"""WITH d AS ({_DICT}) SELECT DISTINCT c.id AS id, CASE WHEN d.ja = c.series THEN d.ko END AS ko FROM catalog_gunpla c LEFT JOIN d ON c.seriesKey = d.seriesKey""")
def dictionary_by_version(spark, d):
    """A translation applies only where the dictionary's original is the row's."""
    c = table(spark, d, "catalog_gunpla")
    words = c.filter("seriesKey is not null").groupBy("seriesKey").agg(F.max("series").alias("ja"), F.max("seriesKo").alias("ko"))
    return c.select("id", "seriesKey", "series").join(words, "seriesKey", "left").select("id", F.when(F.col("ja") == F.col("series"), F.col("ko")).alias("ko")).distinct()


@query(f"""WITH c AS ({_items_sql("grade", "scale", "seriesKo")}) SELECT DISTINCT k.id AS id, 'grade' AS field, k.grade AS mine, c.grade AS theirs FROM kit k JOIN c ON k.catalogId = c.id WHERE k.grade <> '' AND k.grade <> c.grade
 UNION SELECT DISTINCT k.id, 'scale', k.scale, c.scale FROM kit k JOIN c ON k.catalogId = c.id WHERE k.scale <> '' AND k.scale <> c.scale
 UNION SELECT DISTINCT k.id, 'series', k.series, c.seriesKo FROM kit k JOIN c ON k.catalogId = c.id WHERE k.series <> '' AND k.series <> c.seriesKo""")
def comparison_suggestions(spark, d):
    c = items(spark, d, "grade", "scale", "seriesKo").select(F.col("id").alias("catalogId"), F.array("grade", "scale", "seriesKo").alias("theirs"))
    k = table(spark, d, "kit").select("id", "catalogId", F.array("grade", "scale", "series").alias("mine")).distinct().join(c, "catalogId")
    pairs = F.arrays_zip(F.array(*map(F.lit, ("grade", "scale", "series"))).alias("field"), F.col("mine"), F.col("theirs"))
    return k.select("id", F.inline(pairs)).toDF("id", "field", "mine", "theirs").filter("mine <> '' and mine <> theirs").distinct()


@query("""SELECT count(DISTINCT post) AS posts, count(*) AS rows, count(DISTINCT code) AS codes, count(DISTINCT code) FILTER (WHERE code IN (SELECT regexp_extract(id, '^jh-[^-]*-(.+)$', 1) FROM feed WHERE catalogId IS NOT NULL)) AS linked FROM arrival_row""")
def arrival_stats(spark, d):
    rows = table(spark, d, "arrival_row").select("post", "code")
    fed = table(spark, d, "feed").filter("catalogId is not null").select(F.regexp_extract("id", "^jh-[^-]*-(.+)$", 1).alias("code")).distinct()
    linked = rows.select("code").distinct().join(fed, "code", "left_semi").agg(F.count("*").alias("linked"))
    return rows.agg(F.count_distinct("post").alias("posts"), F.count("*").alias("rows"), F.count_distinct("code").alias("codes")).join(F.broadcast(linked))


_GAPS = {"shop": "coalesce(trim(shop), '') = ''", "photo": "coalesce(len(photos), 0) = 0", "series": "coalesce(trim(series), '') = ''", "link": "coalesce(trim(catalogId), '') = ''", "done": "status = 'built' and coalesce(trim(doneDate), '') = ''"}


@query("SELECT " + ", ".join(f"count(*) FILTER (WHERE {v}) AS {k}" for k, v in _GAPS.items()) + " FROM (SELECT DISTINCT id, shop, photos, series, catalogId, status, doneDate FROM kit)")
def gap_counts(spark, d):
    k = table(spark, d, "kit").select("id", "shop", "photos", "series", "catalogId", "status", "doneDate").distinct()
    empty = lambda c: S.is_blank(F.col(c))
    gaps = {"shop": empty("shop"), "photo": F.coalesce(F.size("photos"), F.lit(0)) <= 0, "series": empty("series"), "link": empty("catalogId"), "done": (F.col("status") == "built") & empty("doneDate")}
    return k.agg(*(F.count_if(v).alias(n) for n, v in gaps.items()))


@query("""SELECT seriesKey, count(DISTINCT id) AS items, min(series) AS label FROM catalog_gunpla WHERE seriesKey IS NOT NULL AND seriesKo IS NULL GROUP BY 1""")
def series_worklist(spark, d):
    c = table(spark, d, "catalog_gunpla").filter("seriesKey is not null and seriesKo is null")
    return c.groupBy("seriesKey").agg(F.count_distinct("id").alias("items"), F.min("series").alias("label"))


@query("""SELECT split_part(reason, ':', 1) AS reason, count(*) AS n, list_sort(list(id))[1:3] AS sample FROM excluded GROUP BY 1""")
def reason_histogram(spark, d):
    e = table(spark, d, "excluded").withColumn("reason", F.split_part("reason", F.lit(":"), F.lit(1)))
    near = e.withColumn("k", F.row_number().over(Window.partitionBy("reason").orderBy("id"))).filter("k <= 3").groupBy("reason").agg(F.array_sort(F.collect_list("id")).alias("sample"))
    return e.groupBy("reason").agg(F.count("*").alias("n")).join(near, "reason")


@query("""WITH c AS (SELECT DISTINCT id, coalesce(release.date, release.month || '-00', '') AS key FROM catalog_gunpla) SELECT id, key FROM c ORDER BY key DESC, id DESC""")
def catalog_order(spark, d):
    key = S.partial_date_key(F.coalesce("release.date", "release.month"))
    return table(spark, d, "catalog_gunpla").select("id", F.coalesce(key, F.lit("")).alias("key")).distinct().orderBy(F.desc("key"), F.desc("id"))


@query("""WITH c AS (SELECT id, max(release.month) AS month, bool_or(line IS NOT NULL) AS known FROM catalog_gunpla GROUP BY id HAVING max(detailAt) IS NULL) SELECT id FROM c ORDER BY month DESC NULLS LAST, known DESC, id DESC""")
def backlog_order(spark, d):
    c = table(spark, d, "catalog_gunpla").groupBy("id").agg(F.max("release.month").alias("month"), F.bool_or(F.col("line").isNotNull()).alias("known"), F.max("detailAt").alias("at")).filter("at is null")
    return c.orderBy(F.desc_nulls_last("month"), F.desc("known"), F.desc("id")).select("id")


_OWNED = "SELECT DISTINCT catalogId FROM kit WHERE list = 'own' AND catalogId IS NOT NULL"


@query(f"""WITH f AS (SELECT id, max(added) AS added, bool_or(catalogId IN ({_OWNED})) AS owned FROM feed GROUP BY id), a AS (SELECT id FROM f WHERE owned ORDER BY added DESC, id DESC LIMIT 1)
 SELECT id FROM a UNION ALL SELECT id FROM (SELECT id FROM f WHERE id NOT IN (SELECT id FROM a) ORDER BY added DESC, id DESC LIMIT 2)""")
def pick_with_one_owned(spark, d):
    own = table(spark, d, "kit").filter("list = 'own' and catalogId is not null").select("catalogId", F.lit(True).alias("own")).distinct()
    f = table(spark, d, "feed").select("id", "added", "catalogId").join(own, "catalogId", "left").groupBy("id").agg(F.max("added").alias("added"), F.bool_or(F.coalesce("own", F.lit(False))).alias("owned"))
    return R.quota(f, F.col("owned"), 1, 2, [F.desc("added"), F.desc("id")]).select("id")


@query(f"""WITH f AS (SELECT id, max(added) AS added, max(date) AS date, min(type) AS type, bool_or(coalesce(catalogId IN ({_OWNED}), false)) AS owned FROM feed GROUP BY id)
 SELECT id, owned FROM f ORDER BY owned DESC, added DESC, CASE type WHEN 'kr-new' THEN 0 WHEN 'kr-restock' THEN 1 WHEN 'new' THEN 2 ELSE 3 END, date DESC, id LIMIT 60""")
def feed_page(spark, d):
    own = table(spark, d, "kit").filter("list = 'own' and catalogId is not null").select("catalogId", F.lit(True).alias("own")).distinct()
    f = table(spark, d, "feed").select("id", "added", "date", "type", "catalogId").join(own, "catalogId", "left")
    f = f.groupBy("id").agg(F.max("added").alias("added"), F.max("date").alias("date"), F.min("type").alias("type"), F.bool_or(F.coalesce("own", F.lit(False))).alias("owned"))
    first = F.when(F.col("type") == "kr-new", 0).when(F.col("type") == "kr-restock", 1).when(F.col("type") == "new", 2).otherwise(3)
    return f.orderBy(F.desc("owned"), F.desc("added"), first, F.desc("date"), "id").limit(60).select("id", "owned")


# Grades in the order of the collection.
GRADES = ("PG", "MGEX", "MG", "MGSD", "RG", "HG", "EG", "RE/100", "FM", "SD", "SDCS", "SDEX", "BB", "30MM", "30MS", "30MP", "Figure-rise Standard", "Figure-rise Standard Amplified")
_RANK = "CASE grade " + " ".join(f"WHEN '{g}' THEN {i}" for i, g in enumerate(GRADES)) + " ELSE 99 END"
_ARRIVED = f"""SELECT f.catalogId AS c, max(a.postDate) FILTER (WHERE a.postDate <= '{TODAY}') AS last FROM (SELECT DISTINCT catalogId, id FROM feed WHERE catalogId IS NOT NULL) f JOIN (SELECT DISTINCT post, code, postDate FROM arrival_row) a ON f.id = 'jh-' || a.post || '-' || a.code GROUP BY 1"""


@query(f"""WITH k AS (SELECT id, max(name) AS name, max(price) AS price, min(grade) AS grade, max(doneDate) AS done, max(date) AS date, max(created) AS created, max(catalogId) AS c, max(list) AS list FROM kit GROUP BY id), a AS ({_ARRIVED})
 SELECT id, list, coalesce(name, '') AS by_name, CASE WHEN k.c IS NULL OR k.c = '' THEN 2 WHEN last IS NOT NULL THEN 0 ELSE 1 END AS gap_group, coalesce(last, '9999-12-31') AS gap_key, {_RANK} AS by_grade, coalesce(price, 0) AS by_price, coalesce(done, '') AS by_done, coalesce(date, '') AS by_date, created AS by_created FROM k LEFT JOIN a ON k.c = a.c ORDER BY list, by_date DESC, by_created DESC, id""")
def collection_order(spark, d):
    """The whole collection with the keys of its orders - name, gap, grade, price, completion, purchase, creation - in that of purchase."""
    k = table(spark, d, "kit").groupBy("id").agg(*(F.max(c).alias(c) for c in ("name", "price", "doneDate", "date", "created", "list")), F.min("grade").alias("grade"), F.max("catalogId").alias("c"))
    f = table(spark, d, "feed").filter("catalogId is not null").select(F.col("catalogId").alias("c"), F.col("id").alias("f")).distinct()
    a = table(spark, d, "arrival_row").select(F.concat(F.lit("jh-"), "post", F.lit("-"), "code").alias("f"), "postDate").distinct()
    last = f.join(a, "f").groupBy("c").agg(F.max(F.when(F.col("postDate") <= TODAY, F.col("postDate"))).alias("last"))
    rank = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for i, g in enumerate(GRADES) for x in (g, i))), F.col("grade")), F.lit(99))
    group = F.when(F.coalesce("c", F.lit("")) == "", 2).when(F.col("last").isNotNull(), 0).otherwise(1)
    text = lambda c, n: F.coalesce(c, F.lit("")).alias(n)
    both = k.join(last, "c", "left").select(
        "id", "list", text("name", "by_name"), group.alias("gap_group"), F.coalesce("last", F.lit("9999-12-31")).alias("gap_key"), rank.alias("by_grade"), F.coalesce("price", F.lit(0)).alias("by_price"),
        text("doneDate", "by_done"), text("date", "by_date"), F.col("created").alias("by_created"))
    return both.orderBy("list", F.desc("by_date"), F.desc("by_created"), "id")


@query("""WITH u AS (SELECT tag, 0 AS o, -count(*) AS k FROM (SELECT unnest(tags) AS tag FROM kit) GROUP BY tag UNION ALL SELECT tag, 1, i FROM (VALUES ('선물', 1), ('한정', 2), ('전시', 3)) v(tag, i)) , f AS (SELECT tag, min(o) AS o, arg_min(k, o) AS k FROM u GROUP BY tag) SELECT tag FROM f ORDER BY o, k, tag LIMIT 14""")
def tag_suggestions(spark, d):
    used = R.tag_counts(table(spark, d, "kit"), "tags").select("tag", F.lit(0).alias("o"), (-F.col("n")).alias("k"))
    plain = spark.createDataFrame([("선물", 1), ("한정", 2), ("전시", 3)], "tag string, k long").select("tag", F.lit(1).alias("o"), "k")
    both = used.unionByName(plain).groupBy("tag").agg(F.min(F.struct("o", "k")).alias("x"))
    return both.orderBy("x.o", "x.k", "tag").limit(14).select("tag")


@query("""WITH v AS (SELECT id, arg_min(release, (updated, release.month)) AS a, arg_max(release, (updated, release.month)) AS b FROM catalog_gunpla WHERE release.month IS NOT NULL GROUP BY id)
 SELECT id, CASE WHEN a.month = b.month THEN coalesce(b.date, a.date, a.month) WHEN b.month > a.month THEN coalesce(b.date, b.month) ELSE coalesce(a.date, a.month) END AS release FROM v""")
def release_precedence(spark, d):
    """The same month: a day beats none, the new one first. Another month: the later."""
    c = table(spark, d, "catalog_gunpla").filter("release.month is not null")
    order = F.struct("updated", "release.month")
    v = c.groupBy("id").agg(F.min_by("release", order).alias("a"), F.max_by("release", order).alias("b"))
    same = F.coalesce("b.date", "a.date", "a.month")
    later = F.when(F.col("b.month") > F.col("a.month"), F.coalesce("b.date", "b.month")).otherwise(F.coalesce("a.date", "a.month"))
    return v.select("id", F.when(F.col("a.month") == F.col("b.month"), same).otherwise(later).alias("release"))


@query("""WITH f AS (SELECT id, max(catalogId) AS catalogId, regexp_extract(id, '^jh-[^-]*-(.+)$', 1) AS code FROM feed WHERE id LIKE 'jh-%' GROUP BY id),
 k AS (SELECT code, min(catalogId) AS c FROM f WHERE catalogId LIKE 'bh-%' OR catalogId LIKE 'pb-%' GROUP BY code HAVING count(DISTINCT catalogId) = 1)
 SELECT f.id AS id, coalesce(f.catalogId, k.c) AS catalogId, f.catalogId IS NULL AND k.c IS NOT NULL AS relinked FROM f LEFT JOIN k ON f.code = k.code""")
def late_relink(spark, d):
    """Rows of the feed without an item get the only one that their code has elsewhere."""
    f = table(spark, d, "feed").filter("id like 'jh-%'").groupBy("id").agg(F.max("catalogId").alias("catalogId")).withColumn("code", F.regexp_extract("id", "^jh-[^-]*-(.+)$", 1))
    k = f.filter("catalogId like 'bh-%' or catalogId like 'pb-%'").groupBy("code").agg(F.min("catalogId").alias("c"), F.count_distinct("catalogId").alias("n")).filter("n = 1")
    both = f.join(k, "code", "left")
    return both.select("id", F.coalesce("catalogId", "c").alias("catalogId"), (F.col("catalogId").isNull() & F.col("c").isNotNull()).alias("relinked"))


@query("""WITH g AS (SELECT gno, seen, arg_max(price, loaded_at) AS price FROM mall_good GROUP BY 1, 2), l AS (SELECT gno, price IS DISTINCT FROM lag(price) OVER (PARTITION BY gno ORDER BY seen) AND lag(seen) OVER (PARTITION BY gno ORDER BY seen) IS NOT NULL AS c FROM g) SELECT gno, count(*) FILTER (WHERE c) AS changes FROM l GROUP BY gno""")
def price_changes(spark, d):
    g = table(spark, d, "mall_good").groupBy("gno", "seen").agg(F.max_by("price", "loaded_at").alias("price"))
    w = Window.partitionBy("gno").orderBy("seen")
    c = ~F.col("price").eqNullSafe(F.lag("price").over(w)) & F.lag("seen").over(w).isNotNull()
    return g.withColumn("c", c).groupBy("gno").agg(F.count_if("c").alias("changes"))


@query("""SELECT code, list_sort(list(DISTINCT post)) AS posts FROM arrival_row WHERE code NOT IN ('BD0000077') GROUP BY code""")
def history_without_code(spark, d):
    """Histories nested as arrays, those of a deleted code left out."""
    rows = table(spark, d, "arrival_row").filter(F.col("code") != "BD0000077").select("code", "post").distinct()
    return rows.groupBy("code").agg(F.array_sort(F.collect_list("post")).alias("posts"))


@query("""WITH p AS (SELECT DISTINCT id, split_part(series, ' ', 1) AS ja, unnest(string_split(seriesKo, ' ')) AS ko FROM catalog_gunpla WHERE series IS NOT NULL AND seriesKo IS NOT NULL),
 j AS (SELECT ja, count(DISTINCT id) AS n FROM p GROUP BY 1) SELECT p.ja AS ja, ko, count(DISTINCT id) AS docs FROM p JOIN j ON p.ja = j.ja GROUP BY p.ja, ko, j.n HAVING count(DISTINCT id) >= 0.85 * j.n AND j.n >= 3""")
def term_pairs(spark, d):
    """Words of one language that go with a word of the other in most documents that have it."""
    p = table(spark, d, "catalog_gunpla").filter("series is not null and seriesKo is not null").select("id", F.split_part("series", F.lit(" "), F.lit(1)).alias("ja"), F.explode(F.split("seriesKo", " ")).alias("ko")).distinct()
    n = p.groupBy("ja").agg(F.count_distinct("id").alias("n")).filter("n >= 3")
    return p.groupBy("ja", "ko").agg(F.count_distinct("id").alias("docs")).join(n, "ja").filter("docs >= 0.85 * n").drop("n")


@query("""WITH w AS (SELECT id, max(release.month) AS month FROM catalog_gunpla GROUP BY id HAVING max(nameKo) IS NULL), r AS (SELECT id, row_number() OVER (ORDER BY month DESC NULLS LAST, id DESC) AS k FROM w) SELECT id, CAST((k - 1) // 50 AS INTEGER) AS batch FROM r WHERE k <= 600""")
def translation_batches(spark, d):
    """The worklist of an outside service: newest first, so many a run, in batches."""
    w = table(spark, d, "catalog_gunpla").groupBy("id").agg(F.max("release.month").alias("month"), F.max("nameKo").alias("ko")).filter("ko is null")
    return R.chunks(w.select("id", "month"), [F.desc_nulls_last("month"), F.desc("id")], 50, 600).select("id", F.col("chunk").alias("batch"))


@query("""SELECT DISTINCT id, CASE WHEN status IN ('unbuilt', 'building', 'built', 'custom') THEN status ELSE 'unbuilt' END AS status, greatest(coalesce(price, 0), 0) AS price,
 CASE WHEN regexp_full_match(catalogId, '(bh|pb)-[A-Za-z0-9_-]{1,60}') THEN catalogId END AS catalogId, CASE WHEN regexp_full_match(cover, '(off|mine):[0-9]{1,2}') THEN cover END AS cover FROM kit""")
def row_coercion(spark, d):
    """Values outside their domain become its default."""
    k = table(spark, d, "kit")
    ok = lambda c, p: F.when(F.col(c).rlike(f"^(?:{p})\\z"), F.col(c)).alias(c)
    status = F.when(F.col("status").isin("unbuilt", "building", "built", "custom"), F.col("status")).otherwise("unbuilt")
    return k.select("id", status.alias("status"), F.greatest(F.coalesce("price", F.lit(0)), F.lit(0)).alias("price"), ok("catalogId", "(?:bh|pb)-[A-Za-z0-9_-]{1,60}"), ok("cover", "(?:off|mine):[0-9]{1,2}")).distinct()


@query("SELECT source, min(date) AS oldest, max(date) AS newest FROM feed GROUP BY source")
def oldest_record(spark, d):
    return table(spark, d, "feed").groupBy("source").agg(F.min("date").alias("oldest"), F.max("date").alias("newest"))


@query(None)
def phonetic_pairs(spark, d):
    """Series whose Japanese and Korean names sound alike; Python on distinct names only."""
    pairs = table(spark, d, "catalog_gunpla").select("series", "seriesKo").dropna().distinct()
    kana = F.regexp_extract("series", "([ァ-ヺー]{2,})", 1)
    word = F.element_at(F.split("seriesKo", " "), -1)
    got = pairs.select("series", "seriesKo", sound_skeleton(kana).alias("a"), sound_skeleton(word).alias("b"))
    return got.withColumn("likeness", F.round(likeness(F.col("a"), F.col("b")), 4))
