"""All queries of the core with the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import shopnames as N
from ..functions.times import local_time
from ..operators import entities as E
from ..operators import merge as M
from ..operators import quality as Q
from ..operators import ranking as R
from ..operators import resolve as X
from ..sources import writers
from . import find, merges, pages, problems, upkeep
from .oracles import P1, P1_PARTIAL, P1_REPORT, P3, P3_DAILY
from .run import cut, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = problems.QUERIES | upkeep.QUERIES | find.QUERIES | merges.QUERIES | pages.QUERIES
ORACLES: dict[str, str] = upkeep.ORACLES | find.ORACLES | merges.ORACLES | pages.ORACLES | {"p1_found": P1, "p1_report": P1_REPORT, "p1_partial": P1_PARTIAL, "p3_found": P3, "p3_daily": P3_DAILY}


def query(sql: str | None):  # noqa: ANN201
    def add(f: Callable[[SparkSession, str], DataFrame]):  # noqa: ANN202
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def day(c: str):  # noqa: ANN201
    return F.to_date(F.col(c))


# --- latest rows, upserts, snapshots -------------------------------------------------------------------------------

@query("""SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type,
  arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id""")
def latest_row_per_key(spark, d):
    return M.latest(table(spark, d, "events").select("user_id", "event_id", "event_type", "value", "ts"), ["user_id"], [F.col("ts"), F.col("event_id")]).drop("ts")


@query("""SELECT code, arg_max(name, (postDate, CAST(post AS BIGINT), name)) AS name, arg_max(post, (postDate, CAST(post AS BIGINT), name)) AS post FROM arrival_row
  WHERE name IS NOT NULL GROUP BY code""")
def latest_arrival(spark, d):
    rows = table(spark, d, "arrival_row").filter("name is not null").select("code", "name", "post", "postDate", F.col("post").cast("long").alias("n"))
    return M.latest(rows, ["code"], [F.col("postDate"), F.col("n"), F.col("name")]).select("code", "name", "post")


_CARDS = """WITH o AS (SELECT o_custkey AS id, min(o_totalprice) AS price, max(CAST(o_orderdate AS DATE)) AS release FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01' GROUP BY 1),
 n AS (SELECT o_custkey AS id, min(o_totalprice) AS price, max(CAST(o_orderdate AS DATE)) AS release FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' GROUP BY 1)"""


def cards(spark, d):
    orders = table(spark, d, "orders").select("o_custkey", "o_totalprice", "o_orderdate")
    side = lambda c: orders.filter(c).groupBy(F.col("o_custkey").alias("id")).agg(F.min("o_totalprice").alias("price"), F.max(day("o_orderdate")).alias("release"))
    return side("o_orderdate < '1996-01-01'"), side("o_orderdate >= '1996-01-01'")


@query(_CARDS + """ SELECT coalesce(o.id, n.id) AS id, coalesce(o.price, n.price) AS price, CAST(greatest(o.release, n.release) AS VARCHAR) AS release,
 CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'gone' WHEN greatest(o.release, n.release) IS DISTINCT FROM o.release THEN 'changed' ELSE 'same' END AS change
 FROM o FULL JOIN n ON o.id = n.id""")
def card_upsert(spark, d):
    old, new = cards(spark, d)
    return M.upsert(old, new, ["id"], {"price": "fill", "release": "greatest"}).withColumn("release", F.col("release").cast("string"))


@query(_CARDS + " SELECT count(*) AS changed FROM n WHERE FALSE")
def card_upsert_again(spark, d):
    """Idempotence: merging the same rows again changes none."""
    old, new = cards(spark, d)
    rules = {"price": "fill", "release": "greatest"}
    once = M.upsert(old, new, ["id"], rules).drop("change")
    return M.upsert(once, new, ["id"], rules).agg(F.count_if(F.col("change").isin("added", "changed")).alias("changed"))


@query("""SELECT l_orderkey, l_linenumber, min(l_quantity) AS q FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01'
 AND (l_orderkey, l_linenumber) NOT IN (SELECT (l_orderkey, l_linenumber) FROM lineitem WHERE l_shipdate < TIMESTAMP '1997-01-01') GROUP BY 1, 2""")
def append_missing_pairs(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_shipdate")
    old = rows.filter("l_shipdate < '1997-01-01'")
    new = rows.filter("l_shipdate >= '1997-01-01'").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("q"))
    return M.append_new(old, new, ["l_orderkey", "l_linenumber"])


_MONTHS = """WITH m AS (SELECT DISTINCT l_suppkey AS s, strftime(l_shipdate, '%Y-%m') AS month FROM lineitem),
 n AS (SELECT month, count(*) AS n, lag(count(*)) OVER (ORDER BY month) AS before FROM m GROUP BY month)"""


def months(spark, d):
    m = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("s"), F.date_format("l_shipdate", "yyyy-MM").alias("month")).distinct()
    n = m.groupBy("month").agg(F.count("*").alias("n"))
    return m, n.withColumn("before", F.lag("n").over(Window.orderBy("month")))  # one row a month


@query(_MONTHS + " SELECT month, n, n > 0 AND n >= 0.5 * coalesce(before, 0) AS healthy FROM n")
def snapshot_health(spark, d):
    _, n = months(spark, d)
    return n.select("month", "n", M.healthy(F.col("n"), F.col("before"), F.lit(True)).alias("healthy"))


@query("""WITH c AS (SELECT id, max(nameKoJoy) AS joy, max(nameKoAi) AS ai, max(nameKo) AS ko FROM catalog_gunpla GROUP BY id),
 n AS (SELECT id, CASE WHEN trim(joy) <> '' THEN joy END AS joy, CASE WHEN trim(ai) <> '' THEN ai END AS ai, CASE WHEN trim(ko) <> '' THEN ko END AS ko FROM c)
 SELECT id, coalesce(joy, ai, ko) AS name, CASE WHEN joy IS NOT NULL THEN 'joy' WHEN ai IS NOT NULL THEN 'ai' WHEN ko IS NOT NULL THEN 'ko' END AS source FROM n""")
def source_precedence_name(spark, d):
    c = table(spark, d, "catalog_gunpla").groupBy("id").agg(F.max("nameKoJoy").alias("joy"), F.max("nameKoAi").alias("ai"), F.max("nameKo").alias("ko"))
    return M.precedence(c, ["joy", "ai", "ko"], "name", "source").select("id", "name", "source")


@query("""WITH c AS (SELECT id, max(series) AS series, max(grade) AS grade FROM catalog_gunpla GROUP BY id), k AS (SELECT DISTINCT id, catalogId, series, grade FROM kit)
 SELECT k.id AS id, CASE WHEN (k.series IS NULL OR trim(k.series) = '') AND c.series IS NOT NULL THEN c.series ELSE k.series END AS series,
 CASE WHEN (k.grade IS NULL OR trim(k.grade) = '') AND c.grade IS NOT NULL THEN c.grade ELSE k.grade END AS grade,
 concat_ws(',', CASE WHEN (k.series IS NULL OR trim(k.series) = '') AND c.series IS NOT NULL THEN 'series' END, CASE WHEN (k.grade IS NULL OR trim(k.grade) = '') AND c.grade IS NOT NULL THEN 'grade' END) AS filled
 FROM k LEFT JOIN c ON k.catalogId = c.id""")
def fill_blanks(spark, d):
    items = table(spark, d, "catalog_gunpla").groupBy(F.col("id").alias("catalogId")).agg(F.max("series").alias("series"), F.max("grade").alias("grade"))
    kits = table(spark, d, "kit").select("id", "catalogId", "series", "grade").distinct()
    return M.fill_blanks(kits, items, "catalogId", ["series", "grade"]).drop("catalogId")


@query("""SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'moved' ELSE c_mktsegment END AS segment, c_mktsegment = 'BUILDING' AS touched FROM customer""")
def bulk_update(spark, d):
    hit = F.col("c_mktsegment") == "BUILDING"
    return table(spark, d, "customer").select("c_custkey", F.when(hit, "moved").otherwise(F.col("c_mktsegment")).alias("segment"), hit.alias("touched"))


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM subject_label")
def set_difference(spark, d):
    return table(spark, d, "documents").select("doc_id").subtract(table(spark, d, "subject_label").select("doc_id"))


@query("SELECT count(*) AS n FROM (SELECT id FROM excluded INTERSECT SELECT id FROM catalog_gunpla)")
def intersect_count(spark, d):
    return table(spark, d, "excluded").select("id").intersect(table(spark, d, "catalog_gunpla").select("id")).agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT id, max(nameKo) AS nameKo FROM catalog_gunpla GROUP BY id), k AS (SELECT catalogId, count(DISTINCT id) AS kits FROM kit WHERE catalogId IS NOT NULL GROUP BY 1),
 f AS (SELECT DISTINCT id, catalogId, titleKo, title FROM feed) SELECT f.id AS id, coalesce(f.titleKo, c.nameKo, f.title) AS title, coalesce(k.kits, 0) AS kits FROM f LEFT JOIN c ON f.catalogId = c.id LEFT JOIN k ON f.catalogId = k.catalogId""")
def feed_enriched(spark, d):
    items = table(spark, d, "catalog_gunpla").groupBy(F.col("id").alias("catalogId")).agg(F.max("nameKo").alias("nameKo"))
    kits = table(spark, d, "kit").filter("catalogId is not null").groupBy("catalogId").agg(F.count_distinct("id").alias("kits"))
    feed = table(spark, d, "feed").select("id", "catalogId", "titleKo", "title").distinct()
    both = feed.join(items, "catalogId", "left").join(kits, "catalogId", "left")
    return both.select("id", F.coalesce("titleKo", "nameKo", "title").alias("title"), F.coalesce("kits", F.lit(0)).alias("kits"))


# --- scalars and classification ------------------------------------------------------------------------------------

@query("""SELECT doc_id, regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', '', 'g') AS form FROM documents""")
def search_form(spark, d):
    return table(spark, d, "documents").select("doc_id", S.search_form(F.col("text")).alias("form"))


@query("""SELECT DISTINCT name, nullif(regexp_extract(' ' || name || ' ', '[^0-9/](1/[0-9]{1,4})[^0-9]', 1), '') AS scale FROM arrival_row WHERE name IS NOT NULL""")
def scale_of_name(spark, d):
    return table(spark, d, "arrival_row").select("name").dropna().distinct().withColumn("scale", S.scale_of(F.col("name")))


@query("""SELECT p_partkey, list_sort(list_filter(regexp_extract_all(lower(p_name || ' ' || p_type), '[a-z0-9]+'), lambda x: regexp_matches(x, '[0-9]') OR regexp_matches(x, '^(i{1,3}|iv|vi{0,3}|ix|x)$') OR length(x) <= 3)) AS runs FROM part""")
def short_runs(spark, d):
    return table(spark, d, "part").select("p_partkey", S.short_runs(F.concat_ws(" ", "p_name", "p_type")).alias("runs"))


@query("""SELECT o_orderkey, CASE WHEN CAST(l.d AS DATE) - CAST(o_orderdate AS DATE) >= 60 THEN 'again' ELSE 'new' END AS kind,
 CASE WHEN CAST(l.d AS DATE) - last_day(CAST(o_orderdate AS DATE)) >= 60 THEN 'again' ELSE 'new' END AS month_kind FROM orders JOIN (SELECT l_orderkey, max(l_shipdate) AS d FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey""")
def again_after_60_days(spark, d):
    last = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max(day("l_shipdate")).alias("d"))
    both = table(spark, d, "orders").select("o_orderkey", day("o_orderdate").alias("o")).join(last, "o_orderkey")
    kind = lambda since: F.when(F.date_diff("d", since) >= 60, "again").otherwise("new")
    return both.select("o_orderkey", kind(F.col("o")).alias("kind"), kind(F.last_day("o")).alias("month_kind"))


@query("""WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS near, 1 + o_orderkey % 12 AS m, 1 + o_orderkey % 31 AS dd FROM orders),
 c AS (SELECT o_orderkey, near, try_cast(printf('%d-%02d-%02d', year(near) + y, m, dd) AS DATE) AS c FROM o, (VALUES (-1), (0), (1)) v(y)),
 r AS (SELECT o_orderkey, c, abs(c - near) AS off, row_number() OVER (PARTITION BY o_orderkey ORDER BY abs(c - near), c) AS k FROM c WHERE c IS NOT NULL)
 SELECT o.o_orderkey AS o_orderkey, CAST(CASE WHEN off <= 60 THEN c END AS VARCHAR) AS day FROM o LEFT JOIN r ON o.o_orderkey = r.o_orderkey AND k = 1""")
def date_inference(spark, d):
    said = F.concat(1 + F.col("o_orderkey") % 12, F.lit("/"), 1 + F.col("o_orderkey") % 31)
    return table(spark, d, "orders").select("o_orderkey", S.nearest_year(said, day("o_orderdate")).cast("string").alias("day"))


@query("""SELECT o_custkey, generate_series(date_trunc('month', min(o_orderdate)), date_trunc('month', max(o_orderdate)), INTERVAL 1 MONTH).list_transform(lambda x: strftime(x, '%Y-%m')) AS months FROM orders GROUP BY 1""")
def month_sequence(spark, d):
    span = table(spark, d, "orders").groupBy("o_custkey").agg(F.min(day("o_orderdate")).alias("a"), F.max(day("o_orderdate")).alias("b"))
    return span.select("o_custkey", S.month_range(F.col("a"), F.col("b")).alias("months"))


@query("""SELECT DISTINCT id, CASE WHEN date LIKE '____-__-__' THEN date WHEN date LIKE '____-__' THEN CAST(last_day(CAST(date || '-01' AS DATE)) AS VARCHAR) END AS last_day,
 CASE WHEN date LIKE '____-__-__' THEN date WHEN date LIKE '____-__' THEN date || '-00' ELSE '' END AS key FROM feed""")
def partial_dates(spark, d):
    c = F.col("date")
    return table(spark, d, "feed").select("id", S.partial_date_end(c).cast("string").alias("last_day"), S.partial_date_key(c).alias("key")).distinct()


@query("""SELECT DISTINCT id, CASE WHEN try_cast(doneDate AS DATE) - try_cast(startDate AS DATE) + 1 >= 1 THEN CAST(try_cast(doneDate AS DATE) - try_cast(startDate AS DATE) + 1 AS INTEGER) END AS days FROM kit""")
def build_days(spark, d):
    as_day = lambda c: F.col(c).try_cast("date")
    return table(spark, d, "kit").select("id", S.inclusive_days(as_day("startDate"), as_day("doneDate")).cast("int").alias("days")).distinct()


@query("""SELECT DISTINCT id, CASE WHEN url LIKE 'https://shop.example/%' OR url LIKE 'https://hobby.example/%' THEN url END AS url FROM feed""")
def url_allow_list(spark, d):
    return table(spark, d, "feed").select("id", S.allowed_url(F.col("url"), ["shop.example", "hobby.example"]).alias("url")).distinct()


@query("""WITH p AS (SELECT DISTINCT id, regexp_extract(url, '^https://[^/]+(/.*)$', 1) AS path FROM catalog_gunpla)
 SELECT id, CASE WHEN path LIKE '/item/item-%' THEN false WHEN regexp_matches(path, '^/item/.*/$') THEN true ELSE true END AS allowed FROM p""")
def robots_longest_match(spark, d):
    path = F.regexp_extract("url", "^https://[^/]+(/.*)$", 1)
    rules = [(False, "/item/item-"), (True, "/item/*/$"), (False, "/admin")]
    return table(spark, d, "catalog_gunpla").select("id", S.robots_allowed(path, rules).alias("allowed")).distinct()


# --- rankings, counts ----------------------------------------------------------------------------------------------

@query("""WITH o AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS d FROM orders), g AS (SELECT o_custkey, max(d) FILTER (WHERE d <= DATE '1997-01-01') AS last, min(d) FILTER (WHERE d > DATE '1997-01-01') AS next FROM o GROUP BY 1)
 SELECT o_custkey, CAST(last AS VARCHAR) AS last, CAST(next AS VARCHAR) AS next, CAST(DATE '1997-01-01' - last AS INTEGER) AS since, coalesce(DATE '1997-01-01' - last <= 30, false) AS recent FROM g""")
def recency_gap(spark, d):
    got = R.recency(table(spark, d, "orders").select("o_custkey", day("o_orderdate").alias("d")), "o_custkey", F.col("d"), F.lit("1997-01-01").cast("date"))
    return got.select("o_custkey", F.col("last").cast("string").alias("last"), F.col("next").cast("string").alias("next"), F.col("since").cast("int").alias("since"), "recent")


@query("""SELECT status, count(*) AS kits, count(*) FILTER (WHERE price > 0) AS priced, sum(CASE WHEN price > 0 THEN price ELSE 0 END)::BIGINT AS spent, count(*) FILTER (WHERE doneDate LIKE '2026%') AS done_2026 FROM (SELECT DISTINCT id, status, price, doneDate FROM kit) GROUP BY status""")
def dashboard(spark, d):
    kits = table(spark, d, "kit").select("id", "status", "price", "doneDate").distinct()
    paid = F.col("price") > 0
    return kits.groupBy("status").agg(F.count("*").alias("kits"), F.count_if(paid).alias("priced"), F.sum(F.when(paid, F.col("price")).otherwise(0)).alias("spent"), F.count_if(F.col("doneDate").startswith("2026")).alias("done_2026"))


_CHOSEN = {"o_orderstatus": "F", "c_mktsegment": "BUILDING"}


@query("""WITH r AS (SELECT o_orderstatus AS s, o_orderpriority AS p, c_mktsegment AS m FROM orders JOIN customer ON o_custkey = c_custkey)
 SELECT 'o_orderstatus' AS facet, s AS value, count(*) AS n FROM r WHERE m = 'BUILDING' GROUP BY s UNION ALL SELECT 'o_orderpriority', p, count(*) FROM r WHERE s = 'F' AND m = 'BUILDING' GROUP BY p
 UNION ALL SELECT 'c_mktsegment', m, count(*) FROM r WHERE s = 'F' GROUP BY m""")
def facet_counts_skip_one(spark, d):
    both = table(spark, d, "orders").join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    return R.facet_counts(both.select("o_orderstatus", "o_orderpriority", "c_mktsegment"), ["o_orderstatus", "o_orderpriority", "c_mktsegment"], _CHOSEN)


@query("SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM kit) GROUP BY tag")
def tag_facets(spark, d):
    return R.tag_counts(table(spark, d, "kit"), "tags")


@query("""SELECT DISTINCT id, name, price FROM kit WHERE list = 'own' AND grade = 'HG' AND status = 'built' AND array_contains(tags, '선물') AND (shop IS NULL OR trim(shop) = '' OR price = 0)
 AND contains(lower(concat_ws(' ', name, series, shop, memo)), '1/144')""")
def collection_filter(spark, d):
    kits = table(spark, d, "kit")
    text = F.lower(F.concat_ws(" ", "name", "series", "shop", "memo"))
    gap = S.blank_to_null(F.col("shop")).isNull() | (F.col("price") == 0)
    return kits.filter((F.col("list") == "own") & (F.col("grade") == "HG") & (F.col("status") == "built") & F.array_contains("tags", "선물") & gap & text.contains("1/144")).select("id", "name", "price").distinct()


@query("""SELECT event_id, bucket FROM (SELECT *, 'first' AS bucket FROM events WHERE event_type = 'purchase' ORDER BY ts DESC, event_id DESC LIMIT 50)
 UNION ALL SELECT event_id, 'rest' FROM (SELECT * FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE event_type = 'purchase' ORDER BY ts DESC, event_id DESC LIMIT 50) ORDER BY ts DESC, event_id DESC LIMIT 100)""")
def quota_selection(spark, d):
    rows = table(spark, d, "events").select("event_id", "event_type", "ts")
    return R.quota(rows, F.col("event_type") == "purchase", 50, 100, [F.desc("ts"), F.desc("event_id")]).select("event_id", "bucket")


@query("""SELECT event_id, CAST(row_number() OVER (ORDER BY ts DESC, event_id) AS INTEGER) AS rank, CAST(floor((row_number() OVER (ORDER BY ts DESC, event_id) - 1) / 10) AS INTEGER) AS chunk FROM events ORDER BY ts DESC, event_id LIMIT 30""")
def plan_chunks(spark, d):
    return R.chunks(table(spark, d, "events").select("event_id", "ts"), [F.desc("ts"), F.asc("event_id")], 10, 30).drop("ts")


@query("""WITH g AS (SELECT user_id, epoch_us(ts) / 1000000.0 - lag(epoch_us(ts) / 1000000.0) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events) SELECT user_id, count(*) AS n, round(min(gap), 3) AS least_gap FROM g GROUP BY 1""")
def min_gap(spark, d):
    return R.gaps(table(spark, d, "events").select("user_id", "ts"), "user_id", "ts").withColumn("least_gap", F.round("least_gap", 3))


@query("""SELECT form, count(*) AS n, min(doc_id) AS first_id FROM (SELECT doc_id, trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS form FROM documents) WHERE form IS NOT NULL GROUP BY form HAVING count(*) > 1""")
def duplicate_groups(spark, d):
    return R.duplicate_groups(table(spark, d, "documents").select("doc_id", "text"), S.spaced_form(F.col("text")), "doc_id")


@query("""WITH c AS (SELECT nameKo AS name, coalesce(scale, '-') AS scale, count(DISTINCT id) AS n, min(id) AS target FROM catalog_gunpla WHERE nameKo IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT id) = 1)
 SELECT DISTINCT k.id AS id, c.target AS target FROM kit k JOIN c ON k.name = c.name AND coalesce(k.scale, '-') = c.scale""")
def unique_candidate_link(spark, d):
    scale = F.coalesce("scale", F.lit("-")).alias("scale")
    kits = table(spark, d, "kit").select("id", "name", scale).distinct()
    items = table(spark, d, "catalog_gunpla").filter("nameKo is not null").select(F.col("nameKo").alias("name"), scale, F.col("id").alias("target"))
    return R.unique_candidates(kits, items, ["name", "scale"], "id", "target").distinct()


@query("""SELECT line, count(*) AS items, count(*) FILTER (WHERE detailAt IS NULL) AS open FROM (SELECT id, any_value(line) AS line, max(detailAt) AS detailAt FROM catalog_gunpla GROUP BY id) GROUP BY line""")
def catalog_counts(spark, d):
    items = table(spark, d, "catalog_gunpla").groupBy("id").agg(F.max("line").alias("line"), F.max("detailAt").alias("detailAt"))
    return items.groupBy("line").agg(F.count("*").alias("items"), F.count_if(F.col("detailAt").isNull()).alias("open"))


@query("""SELECT id, list_sort(list(DISTINCT list)) AS lists FROM (SELECT catalogId AS id, list FROM kit WHERE regexp_matches(catalogId, '^(bh|pb)-[A-Za-z0-9_-]{1,60}$')) GROUP BY id""")
def owned_map(spark, d):
    kits = table(spark, d, "kit").filter(F.col("catalogId").rlike(r"^(bh|pb)-[A-Za-z0-9_-]{1,60}\z"))
    return kits.groupBy(F.col("catalogId").alias("id")).agg(F.array_sort(F.collect_set("list")).alias("lists"))


# --- resolution, quality, mining -----------------------------------------------------------------------------------

def _items(spark, d):  # noqa: ANN202
    """The catalogue's row of each id that was updated last."""
    items = table(spark, d, "catalog_gunpla").select("id", "line", "grade", "scale", "nameKo", "nameKoAi", "nameKoJoy", "nameJa", "priceJpy", "updated")
    rest = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in items.columns if c not in ("id", "updated")]
    return M.latest(items, ["id"], [local_time(F.col("updated")), *rest])


@query(None)
def arrival_resolve(spark, d):
    """Each code's last arrival resolved against the catalogue; codes may share an item."""
    names = latest_arrival(spark, d).select(F.col("code").alias("id"), "name")
    return E.best_match(names, _items(spark, d), N.read_arrival).drop("exact").withColumnRenamed("id", "code")


@query(None)
def mall_resolve(spark, d):
    """The mall's goods without a link, as loaded last, resolved against the catalogue; an item has one good."""
    items = cut(_items(spark, d))
    kept = table(spark, d, "mall_link").select("gno", F.col("catalogId").alias("target")).join(items.select(F.col("id").alias("target")), "target", "left_semi")
    goods = table(spark, d, "mall_good").filter("gno is not null").select("gno", "name", "price", "seen", "loaded_at")
    goods = M.latest(goods, ["gno"], [F.col("seen"), F.col("loaded_at"), F.coalesce("name", F.lit("")), F.coalesce("price", F.lit(0))]).join(kept, "gno", "left_anti")
    goods = cut(goods.select(F.col("gno").alias("id"), F.coalesce("name", F.lit("")).alias("name"), "price"))
    links = E.best_match(goods.select("id", "name"), items, N.read_good)
    return E.claims(links, goods.drop("name"), items.select(F.col("id").alias("target"), F.col("priceJpy").alias("jpy")), kept.select("target")).drop("exact").withColumnRenamed("id", "gno")


@query("""SELECT item, min(gno) AS gno FROM (SELECT gno, catalogId AS item, score, rank() OVER (PARTITION BY catalogId ORDER BY score DESC) AS k FROM (SELECT DISTINCT gno, catalogId, score FROM mall_link)) WHERE k = 1 GROUP BY item""")
def one_to_one_claims(spark, d):
    links = table(spark, d, "mall_link").select("gno", F.col("catalogId").alias("item"), "score").distinct()
    return X.one_to_one(links, "gno", "item", "score").select("item", "gno")


@query("""SELECT 'positive' AS rule, count(*) FILTER (WHERE NOT coalesce(l_quantity > 0, false)) AS rows FROM lineitem UNION ALL SELECT 'discount', count(*) FILTER (WHERE NOT coalesce(l_discount BETWEEN 0 AND 0.05, false)) FROM lineitem
 UNION ALL SELECT 'flag', count(*) FILTER (WHERE NOT coalesce(l_returnflag IN ('A', 'N'), false)) FROM lineitem""")
def schema_violations(spark, d):
    rules = {"positive": F.col("l_quantity") > 0, "discount": F.col("l_discount").between(0, 0.05), "flag": F.col("l_returnflag").isin("A", "N")}
    return Q.violations(table(spark, d, "lineitem"), rules)


@query("SELECT post, code, count(*) AS n FROM arrival_row GROUP BY 1, 2 HAVING count(*) > 1")
def repeated_keys(spark, d):
    return Q.repeated_keys(table(spark, d, "arrival_row"), ["post", "code"])


@query("""WITH t(term) AS (VALUES ('계약'), ('試験'), ('photo'), ('1/144')) SELECT term, count(*) AS rows FROM documents JOIN t ON contains(text, term) GROUP BY term""")
def glossary_containment(spark, d):
    return Q.glossary_hits(table(spark, d, "documents"), "text", ["계약", "試験", "photo", "1/144"])


def _term_docs(spark, d):  # noqa: ANN202
    """(doc, key, ja, ko, shop): the catalogue's items, its series, and arrivals by the name of the item that they are linked to."""
    every = table(spark, d, "catalog_gunpla").select("id", "line", "grade", "scale", "nameKo", "nameKoAi", "nameKoJoy", "nameJa", "priceJpy", "nameKoSource", "seriesKey", "series", "seriesKo", "updated")
    rest = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in every.columns if c not in ("id", "updated")]
    items = cut(M.latest(every, ["id"], [local_time(F.col("updated")), *rest]))
    shop = F.coalesce(F.col("nameKoSource").isin("joyhobby", "bnkrmall"), F.lit(False))
    names = items.filter("nameJa <> '' and nameKo <> ''").select(F.col("id").alias("key"), F.col("nameJa").alias("ja"), F.col("nameKo").alias("ko"), shop.alias("shop"))
    series = items.filter("series <> '' and seriesKo <> ''").groupBy(F.concat(F.lit("series:"), F.coalesce("seriesKey", "series")).alias("key")).agg(F.max(F.struct("series", "seriesKo")).alias("x"))
    series = series.select("key", F.col("x.series").alias("ja"), F.col("x.seriesKo").alias("ko"), F.lit(False).alias("shop"))
    links = E.best_match(latest_arrival(spark, d).select(F.col("code").alias("id"), "name"), items, N.read_arrival).filter("reason = 'linked'").select(F.col("id").alias("code"), F.col("target").alias("key"))
    said = table(spark, d, "arrival_row").filter("name is not null").select("code", "name").distinct().join(links, "code").select("key", "name").distinct()
    said = said.join(items.filter("nameJa <> ''").select(F.col("id").alias("key"), F.col("nameJa").alias("ja")), "key").select("key", "ja", F.regexp_replace("name", r"\([^)]*\)", " ").alias("ko"), F.lit(True).alias("shop"))
    docs = names.withColumn("kind", F.lit("item")).union(series.withColumn("kind", F.lit("series"))).union(said.withColumn("kind", F.lit("arrival")))
    return cut(docs.select(F.xxhash64("kind", "key", "ko").alias("doc"), "key", N.nfkc_column("ja").alias("ja"), "ko", "shop").dropDuplicates(["doc"]))


@query(None)
def term_mining(spark, d):
    """Closed kana substrings of the names of items and series and of linked arrivals, with their document counts; compared with brute force in tests."""
    return Q.closed_terms(_term_docs(spark, d), "doc", Q.kana_runs(F.col("ja")))


@query(None)
def term_variants(spark, d):
    """Katakana terms of the same documents that Korean names spell in several ways."""
    return Q.term_variants(_term_docs(spark, d))


# --- sources and sinks ---------------------------------------------------------------------------------------------

@query("""SELECT doc_id, count(*) FILTER (WHERE trim(x) <> '') AS lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents) GROUP BY doc_id""")
def text_lines(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("x"))
    return lines.groupBy("doc_id").agg(F.count_if(F.trim("x") != "").alias("lines"))


@query("""SELECT DISTINCT concat_ws(', ', id) AS "Id", coalesce(name, '') AS "Name", coalesce(CASE WHEN price <> 0 THEN CAST(price AS VARCHAR) END, '') AS "Price", array_to_string(coalesce(tags, []), ', ') AS "Tags" FROM kit""")
def export_rows(spark, d):
    return writers.export_rows(table(spark, d, "kit").select("id", "name", "price", "tags").distinct(), {"id": "Id", "name": "Name", "price": "Price", "tags": "Tags"})


__all__ = ["ORACLES", "QUERIES"]
