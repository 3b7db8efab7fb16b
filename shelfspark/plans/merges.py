"""Queries of the merges that keep a catalogue, with the SQL they are held against. Inputs are made of the versions of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import shopnames as N
from ..operators import keeping as K
from .find import nfkc_sql
from .oracles import quoted
from .run import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
NOW, TODAY = "2026-11-26T00:00:00+09:00", "2026-11-26"


def query(sql: str | None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _map_sql(k: int) -> str:
    pairs = [(b, v[k]) for b, v in C.BRANDS.items() if v[k]]
    return "MAP([" + ", ".join(quoted(b) for b, _ in pairs) + "], [" + ", ".join(quoted(v) for _, v in pairs) + "])"


def _line_sql(keys: str) -> str:
    each = f"list_transform({keys}, lambda k: {_map_sql(0)}[lower(k)])"
    return f"CASE WHEN list_contains({each}, 'girl') THEN 'girl' WHEN list_contains({each}, 'gunpla') THEN 'gunpla' END"


def _grade_sql(keys: str, line: str) -> str:
    return f"list_filter(list_transform({keys}, lambda k: CASE WHEN {_map_sql(0)}[lower(k)] = {line} THEN {_map_sql(1)}[lower(k)] END), lambda g: g IS NOT NULL)[1]"


def _title_sql(c: str, which: int) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({c}, '{r[0]}') THEN {quoted(r[which])}" for r in C.TITLES) + " END"


_OLD = """SELECT id, min(line) AS line, min(grade) AS grade, min(brandKeys) AS brandKeys, min(priceJpy) AS priceJpy, min(channel) AS channel, min(pbUrl) AS pbUrl, min(release.month) AS month,
 min(release.date) AS date, min(detailAt) AS detailAt, min(nameJa) AS nameJa, min(updated) AS updated FROM catalog_gunpla GROUP BY id HAVING min(firstSeen) < '2026-03-01'"""
_CARDS = """SELECT id, min(nameJa) AS nameJa, max(priceJpy) AS priceJpy, max(release.month) AS month, max(release.date) AS date, max(channel) AS channel, max(pbUrl) AS pbUrl,
 CASE WHEN id LIKE '%7' THEN 'tool' WHEN id LIKE '%5' THEN NULL WHEN id LIKE '%3' THEN 'mgka' ELSE max(brandKeys[1]) END AS brandKey FROM catalog_gunpla GROUP BY id"""


def _versions(spark, d):  # noqa: ANN001, ANN202
    c = table(spark, d, "catalog_gunpla")
    low = [F.min(x).alias(x) for x in ("line", "grade", "brandKeys", "priceJpy", "channel", "pbUrl", "detailAt", "nameJa", "updated")]
    old = c.groupBy("id").agg(*low, F.min("release.month").alias("month"), F.min("release.date").alias("date"), F.min("firstSeen").alias("s")).filter("s < '2026-03-01'").drop("s")
    key = F.when(F.col("id").endswith("7"), "tool").when(F.col("id").endswith("5"), None).when(F.col("id").endswith("3"), "mgka").otherwise(F.max(F.get("brandKeys", F.lit(0))))
    cards = c.groupBy("id").agg(F.min("nameJa").alias("nameJa"), *(F.max(x).alias(x) for x in ("priceJpy", "channel", "pbUrl")), F.max("release.month").alias("month"), F.max("release.date").alias("date"), key.alias("brandKey"))
    return old, cards.withColumn("nameJa", N.nfkc_column("nameJa"))


_SHOWN = ("id", "line", "grade", "priceJpy", "channel", "pbUrl", "month", "date", "updated", "change")


@query(f"""WITH o AS ({_OLD}), c AS (SELECT * REPLACE ({nfkc_sql("nameJa")} AS nameJa) FROM ({_CARDS}) WHERE id NOT IN (SELECT id FROM excluded)),
 j AS (SELECT coalesce(o.id, c.id) AS id, o.id IS NOT NULL AS known, c.id IS NOT NULL AS told, o.detailAt IS NULL AS fresh, o.line AS l, o.grade AS g, coalesce(o.brandKeys, []) AS ks, o.priceJpy AS p, o.channel AS ch, o.pbUrl AS pb, o.month AS m, o.date AS dt, o.updated AS u, c.nameJa AS nameJa,
  c.priceJpy AS cp, c.channel AS cch, c.pbUrl AS cpb, c.month AS cm, c.date AS cd, c.brandKey AS k FROM o FULL JOIN c ON o.id = c.id),
 a AS (SELECT *, known AND told AND fresh AND k IS NOT NULL AND NOT list_contains(ks, k) AS grows, upper(trim(nameJa)) AS t FROM j), b AS (SELECT *, CASE WHEN grows THEN ks || [k] WHEN known THEN ks WHEN k IS NOT NULL THEN [k] ELSE [] END AS keys FROM a),
 v AS (SELECT *, grows OR (NOT known AND k IS NOT NULL) AS bykey, {_line_sql("keys")} AS vl, {_title_sql("t", 1)} AS tl, {_title_sql("t", 2)} AS tg, CASE WHEN cm IS NULL THEN false WHEN m IS NULL THEN true WHEN m = cm THEN cd IS NOT NULL ELSE cm > m END AS takes FROM b),
 w AS (SELECT *, {_grade_sql("keys", "vl")} AS vg FROM v),
 n AS (SELECT id, known, told, u, ks, keys, l, g, p, ch, pb, m, dt, CASE WHEN bykey THEN vl WHEN known THEN l ELSE tl END AS line, CASE WHEN grows THEN coalesce(vg, g) WHEN known THEN g WHEN k IS NOT NULL THEN vg ELSE tg END AS grade, coalesce(p, cp) AS priceJpy,
  CASE WHEN known AND told AND fresh AND coalesce(ch, '') = '' AND coalesce(cch, '') <> '' THEN cch WHEN known THEN ch ELSE cch END AS channel, CASE WHEN known AND told AND fresh AND coalesce(pb, '') = '' AND coalesce(cpb, '') <> '' THEN cpb WHEN known THEN pb ELSE cpb END AS pbUrl,
  CASE WHEN takes THEN cm ELSE m END AS month, CASE WHEN takes THEN cd ELSE dt END AS date, (bykey AND vl IS NULL) OR (NOT known AND k IS NULL AND tl IS NULL AND id LIKE 'pb-%') AS gone FROM w),
 x AS (SELECT *, CASE WHEN gone THEN 'excluded' WHEN NOT known THEN 'added' WHEN told AND (line IS DISTINCT FROM l OR grade IS DISTINCT FROM g OR keys IS DISTINCT FROM ks OR priceJpy IS DISTINCT FROM p OR channel IS DISTINCT FROM ch OR pbUrl IS DISTINCT FROM pb OR month IS DISTINCT FROM m OR date IS DISTINCT FROM dt) THEN 'changed' ELSE 'same' END AS change FROM n)
 SELECT id, line, grade, priceJpy, channel, pbUrl, month, date, CASE WHEN change IN ('added', 'changed') THEN '{NOW}' ELSE u END AS updated, change FROM x""")
def card_merge(spark, d):
    """Cards of a listing merged into the catalogue as it was: brand keys, titles, exclusions, prices and releases."""
    old, cards = _versions(spark, d)
    return K.upsert_cards(old, cards, table(spark, d, "excluded"), F.lit(NOW)).select(*_SHOWN)


@query("SELECT 0::BIGINT AS changed, count(*) > 0 AS kept FROM catalog_gunpla")
def card_merge_again(spark, d):
    """The same cards once more change nothing."""
    old, cards = _versions(spark, d)
    once = K.upsert_cards(old, cards, table(spark, d, "excluded"), F.lit(NOW)).filter("change <> 'excluded'").drop("change")
    gone = K.upsert_cards(old, cards, table(spark, d, "excluded"), F.lit(NOW)).filter("change = 'excluded'").select("id")
    again = K.upsert_cards(once, cards, table(spark, d, "excluded").select("id").union(gone), F.lit("later"))
    return again.agg(F.count_if(F.col("change") != "same").alias("changed"), (F.count("*") > 0).alias("kept"))


@query(f"""WITH i AS (SELECT id, min(line) AS line, min(grade) AS grade, min(brandKeys) AS keys, coalesce(bool_or(manual), false) AS manual FROM catalog_gunpla GROUP BY id), v AS (SELECT *, manual OR len(coalesce(keys, [])) = 0 AS exempt, {_line_sql("keys")} AS vl FROM i), w AS (SELECT *, {_grade_sql("keys", "vl")} AS vg FROM v),
 r AS (SELECT id, line AS l, grade AS g, exempt, vl, CASE WHEN exempt THEN line ELSE vl END AS line, CASE WHEN exempt OR vl IS NULL THEN grade ELSE coalesce(vg, grade) END AS grade FROM w)
 SELECT id, line, grade, CASE WHEN NOT exempt AND vl IS NULL THEN 'excluded' WHEN line IS DISTINCT FROM l OR grade IS DISTINCT FROM g THEN 'changed' ELSE 'same' END AS state FROM r""")
def reclassified(spark, d):
    """All items classed anew by the table of brand keys."""
    i = table(spark, d, "catalog_gunpla").groupBy("id").agg(*(F.min(c).alias(c) for c in ("line", "grade", "brandKeys")), F.bool_or("manual").alias("manual"))
    return K.reclassify(i)


@query("""WITH i AS (SELECT id, coalesce(max(detailFails), 0) AS fails FROM catalog_gunpla GROUP BY id), a AS (SELECT id, CASE WHEN id LIKE '%4' THEN 404 ELSE 500 END AS status FROM i WHERE id LIKE '%4' OR id LIKE '%2')
 SELECT i.id AS id, CAST(fails + CASE WHEN status = 500 THEN 1 ELSE 0 END AS INTEGER) AS fails, CASE WHEN status = 404 THEN 'excluded' WHEN fails + CASE WHEN status = 500 THEN 1 ELSE 0 END >= 3 THEN 'given-up' WHEN status IS NOT NULL THEN 'failed' ELSE 'same' END AS state FROM i LEFT JOIN a ON i.id = a.id""")
def detail_failures(spark, d):
    """Items after requests for their pages failed."""
    i = table(spark, d, "catalog_gunpla").groupBy("id").agg(F.max("detailFails").alias("fails"))
    asked = i.filter(F.col("id").endswith("4") | F.col("id").endswith("2")).select("id", F.when(F.col("id").endswith("4"), 404).otherwise(500).alias("status"))
    return K.detail_outcomes(i, asked).withColumn("fails", F.col("fails").cast("int"))


_FEED = "SELECT id, min(added) AS added, max(catalogId) AS catalogId, max(titleKo) AS titleKo, max(image) AS image FROM feed GROUP BY id"


@query(f"""WITH f AS ({_FEED}), o AS (SELECT * FROM f WHERE added < '2026-06-01'), n AS (SELECT * FROM f WHERE added >= '2026-03-01'), c AS (SELECT id, max(nameKo) AS ko, max(images[1]) AS im FROM catalog_gunpla GROUP BY id),
 k AS (SELECT o.id AS id, added, catalogId, coalesce(nullif(titleKo, ''), ko, titleKo) AS titleKo, coalesce(nullif(image, ''), im, image) AS image, false AS inserted FROM o LEFT JOIN c ON o.catalogId = c.id WHERE catalogId IS NULL OR catalogId NOT IN (SELECT id FROM excluded)),
 a AS (SELECT * FROM k UNION ALL SELECT *, true FROM n WHERE id NOT IN (SELECT id FROM k)) SELECT * FROM a ORDER BY added DESC, id DESC LIMIT 1000""")
def feed_merge(spark, d):
    """New rows of the feed merged into those before June: excluded items out, blanks filled, the 1000 newest."""
    f = table(spark, d, "feed").groupBy("id").agg(F.min("added").alias("added"), *(F.max(c).alias(c) for c in ("catalogId", "titleKo", "image")))
    c = table(spark, d, "catalog_gunpla").groupBy("id").agg(F.max("nameKo").alias("nameKo"), F.max(F.get("images", F.lit(0))).alias("image"))
    return K.merge_feed(f.filter("added < '2026-06-01'"), f.filter("added >= '2026-03-01'"), c, table(spark, d, "excluded"))


_DAYS = "SELECT max(seen) AS last, (SELECT max(seen) FROM mall_good WHERE seen < (SELECT max(seen) FROM mall_good)) AS prev FROM mall_good"


@query(f"""WITH t AS ({_DAYS}), g AS (SELECT gno, max(name) AS name, max(price) AS price, min(first) AS first, max(seen) AS seen FROM mall_good, t WHERE seen < t.last AND gno IS NOT NULL GROUP BY gno), s AS (SELECT gno, max(name) AS name, max(price) AS price FROM mall_good, t WHERE seen = t.last AND gno IS NOT NULL GROUP BY gno),
 n AS (SELECT count(*) > 0 AND count(*) >= 0.5 * (SELECT count(*) FROM g) AS sane FROM s), l AS (SELECT DISTINCT gno FROM mall_link)
 SELECT coalesce(g.gno, s.gno) AS gno, CASE WHEN s.gno IS NOT NULL THEN s.name ELSE g.name END AS name, CASE WHEN s.gno IS NOT NULL THEN s.price ELSE g.price END AS price, coalesce(g.first, '{TODAY}') AS first, CASE WHEN s.gno IS NOT NULL THEN '{TODAY}' ELSE g.seen END AS seen,
 s.gno IS NULL AND l.gno IS NOT NULL AND sane AS ended FROM g FULL JOIN s ON g.gno = s.gno LEFT JOIN l ON l.gno = coalesce(g.gno, s.gno), n WHERE s.gno IS NOT NULL OR l.gno IS NOT NULL OR NOT sane""")
def mall_absorbed(spark, d):
    """The goods after the last snapshot: taken over, dropped, or ended if they are linked."""
    rows = table(spark, d, "mall_good").filter("gno is not null")
    last = rows.agg(F.max("seen").alias("last"))
    rows = rows.join(F.broadcast(last))
    goods = rows.filter("seen < last").groupBy("gno").agg(F.max("name").alias("name"), F.max("price").alias("price"), F.min("first").alias("first"), F.max("seen").alias("seen"))
    scan = rows.filter("seen = last").groupBy("gno").agg(F.max("name").alias("name"), F.max("price").alias("price"))
    return K.absorb_snapshot(goods, scan, table(spark, d, "mall_link"), True, goods.count(), TODAY)


@query("""WITH t AS (SELECT DISTINCT id AS target FROM catalog_gunpla), l AS (SELECT gno AS key, min(catalogId) AS target, 'fuzzy' AS method FROM mall_link GROUP BY gno), s AS (SELECT key, CASE WHEN key LIKE '%0' THEN NULL WHEN key LIKE '%1' THEN (SELECT min(target) FROM t) ELSE 'bh-none' END AS target FROM l WHERE key LIKE '%0' OR key LIKE '%1' OR key LIKE '%2'),
 r AS (SELECT * FROM s WHERE target IS NULL OR target IN (SELECT target FROM t)), b AS (SELECT l.key AS key, CASE WHEN r.key IS NOT NULL THEN r.target ELSE l.target END AS target, CASE WHEN r.key IS NOT NULL AND l.target IS DISTINCT FROM r.target THEN 'override' ELSE l.method END AS method, r.key IS NOT NULL AS forced FROM l LEFT JOIN r ON l.key = r.key)
 SELECT key, target, method FROM b WHERE target IN (SELECT target FROM t) AND (forced OR target NOT IN (SELECT target FROM b WHERE forced AND target IS NOT NULL))""")
def forced_links(spark, d):
    """Links of the mall under overrides that forbid, force, or name an item that isn't there; stale links go."""
    items = table(spark, d, "catalog_gunpla").select(F.col("id").alias("target")).distinct()
    links = table(spark, d, "mall_link").groupBy(F.col("gno").alias("key")).agg(F.min("catalogId").alias("target")).withColumn("method", F.lit("fuzzy"))
    first = items.agg(F.min("target").alias("first"))
    says = links.filter(F.col("key").rlike("[012]$")).join(F.broadcast(first))
    says = says.select("key", F.when(F.col("key").endswith("0"), None).when(F.col("key").endswith("1"), F.col("first")).otherwise("bh-none").alias("target"))
    return K.apply_overrides(links, says, items, alone=True)


@query("""WITH p AS (SELECT DISTINCT post, min(postDate) AS date FROM arrival_row GROUP BY post), r AS (SELECT post, code, min(name) AS name FROM arrival_row WHERE name IS NOT NULL AND code NOT LIKE '%1' GROUP BY 1, 2)
 SELECT p.post AS post, date, CASE WHEN count(r.code) > 0 THEN 'done' ELSE 'no-bd' END AS state, count(r.code) AS rows FROM p LEFT JOIN r ON p.post = r.post GROUP BY p.post, date""")
def posts_recorded(spark, d):
    """Posts after their rows were read: done, or without a product."""
    a = table(spark, d, "arrival_row")
    posts = a.groupBy("post").agg(F.min("postDate").alias("date"))
    parsed = a.filter("name is not null and code not like '%1'").groupBy("post", "code").agg(F.min("name").alias("name"), F.min("price").alias("price"))
    return K.record_posts(posts, parsed, parsed.limit(0).select("post", "code", "name", "price", F.lit("").alias("postDate")))[0]


_KITS = "SELECT id, min(list) AS list, min(status) AS status, min(date) AS date, min(shop) AS shop, min(price) AS price, min(startDate) AS startDate, min(doneDate) AS doneDate, min(catalogId) AS catalogId, min(cover) AS cover FROM kit GROUP BY id"


def _kits(spark, d):  # noqa: ANN001, ANN202
    return table(spark, d, "kit").groupBy("id").agg(*(F.min(c).alias(c) for c in ("list", "status", "date", "shop", "price", "startDate", "doneDate", "catalogId", "cover")))


@query(f"""WITH o AS ({_KITS}), e AS (SELECT id, CASE WHEN id LIKE '%a' THEN 'wish' ELSE 'own' END AS list, CASE WHEN id LIKE '%b' THEN 'building' WHEN id LIKE '%c' THEN 'custom' ELSE status END AS status, date, shop, price, '' AS startDate, '' AS doneDate, CASE WHEN id LIKE '%1' THEN NULL ELSE catalogId END AS catalogId, cover FROM o WHERE id NOT LIKE '%z'),
 j AS (SELECT o.*, e.id IS NOT NULL AS told, e.list AS nl, e.list = 'wish' AS w, CASE WHEN e.list = 'wish' THEN 'unbuilt' ELSE e.status END AS ns, e.catalogId AS nc FROM o LEFT JOIN e ON o.id = e.id)
 SELECT id, CASE WHEN told THEN nl ELSE list END AS list, CASE WHEN told THEN ns ELSE status END AS status, CASE WHEN NOT told THEN date WHEN w THEN '' WHEN coalesce(date, '') = '' AND list = 'wish' THEN '{TODAY}' ELSE date END AS date, CASE WHEN told AND w THEN '' ELSE shop END AS shop, CASE WHEN told AND w THEN 0 ELSE price END AS price,
 CASE WHEN NOT told THEN startDate WHEN NOT w AND ns = 'building' AND status IS DISTINCT FROM 'building' THEN '{TODAY}' ELSE '' END AS startDate, CASE WHEN NOT told THEN doneDate WHEN NOT w AND ns IN ('built', 'custom') AND coalesce(status, '') NOT IN ('built', 'custom') THEN '{TODAY}' ELSE '' END AS doneDate,
 CASE WHEN told THEN nc ELSE catalogId END AS catalogId, CASE WHEN told AND cover LIKE 'off:%' AND coalesce(nc, '') = '' THEN NULL ELSE cover END AS cover FROM j""")
def kits_edited(spark, d):
    """Kits after forms were saved: moved between lists, started, finished, unlinked."""
    o, at = _kits(spark, d), lambda x: F.col("id").endswith(x)
    e = o.filter(~at("z")).withColumns({
        "list": F.when(at("a"), "wish").otherwise("own"), "status": F.when(at("b"), "building").when(at("c"), "custom").otherwise(F.col("status")), "startDate": F.lit(""), "doneDate": F.lit(""),
        "catalogId": F.when(at("1"), None).otherwise(F.col("catalogId"))})
    return K.edited(o, e, TODAY)


@query(f"""WITH o AS (SELECT id, catalogId, cover FROM ({_KITS})), l AS (SELECT id, CASE WHEN id LIKE '%2' THEN catalogId ELSE 'bh-01_1000' END AS c FROM o WHERE id LIKE '%2' OR id LIKE '%4')
 SELECT o.id AS id, nullif(CASE WHEN l.id IS NOT NULL THEN l.c ELSE catalogId END, '') AS catalogId, CASE WHEN l.id IS NOT NULL AND nullif(l.c, '') IS DISTINCT FROM nullif(catalogId, '') AND cover LIKE 'off:%' THEN NULL ELSE cover END AS cover FROM o LEFT JOIN l ON o.id = l.id""")
def kits_relinked(spark, d):
    """Kits with other products: an official cover of the one before goes."""
    o = _kits(spark, d).select("id", "catalogId", "cover")
    links = o.filter(F.col("id").rlike("[24]$")).select("id", F.when(F.col("id").endswith("2"), F.col("catalogId")).otherwise("bh-01_1000").alias("catalogId"))
    return K.relinked(o, links)


@query(f"""WITH c AS (SELECT id, max({nfkc_sql("nameJa")}) AS ja, max(nameKo) AS ko, max(nameKoSource) AS source FROM catalog_gunpla GROUP BY id)
 SELECT id, coalesce(ko <> '' AND coalesce(source, '') = '' AND (len(list_filter(regexp_extract_all(ko, '[㐀-䶿一-鿿]'), lambda x: NOT list_contains(regexp_extract_all(coalesce(ja, ''), '[㐀-䶿一-鿿]'), x))) > 0 OR (contains(ja, '水中装備') AND NOT contains(ko, '수중 장비')) OR (contains(ja, '改') AND NOT contains(ko, '카이'))), false) AS again FROM c""")
def outdated_translations(spark, d):
    """Translations to be made again after a term was added and another changed."""
    c = table(spark, d, "catalog_gunpla").groupBy("id").agg(F.max(N.nfkc_column("nameJa")).alias("ja"), F.max("nameKo").alias("ko"), F.max("nameKoSource").alias("source"))
    terms = {"水中装備": "수중 장비", "改": "카이", "砂漠戦仕様": "사막전 사양"}
    return c.select("id", K.outdated_translations(c, terms, {"改": "개", "砂漠戦仕様": "사막전 사양"}).alias("again"))


@query("""WITH e AS (SELECT id, min(reason) AS reason FROM excluded GROUP BY id), i AS (SELECT DISTINCT id FROM catalog_gunpla), w AS (SELECT id FROM e WHERE id LIKE '%1' OR id LIKE '%2'), f AS (SELECT id FROM w WHERE id LIKE '%1' AND id NOT IN (SELECT id FROM i))
 SELECT id, 'item' AS state FROM i UNION ALL SELECT id, 'manual' FROM f UNION ALL SELECT id, 'excluded' FROM e WHERE id NOT IN (SELECT id FROM f)""")
def revived(spark, d):
    """Excluded items that users asked for, where their page was found."""
    e = table(spark, d, "excluded").groupBy("id").agg(F.min("reason").alias("reason"))
    i = table(spark, d, "catalog_gunpla").select("id", F.lit(False).alias("manual")).distinct()
    items, left = K.revive(i, e, e.filter(F.col("id").rlike("[12]$")), e.filter(F.col("id").endswith("1")))
    return items.select("id", F.when(F.col("manual"), "manual").otherwise("item").alias("state")).unionByName(left.select("id", F.lit("excluded").alias("state")))


@query("""WITH f AS (SELECT id, max(added) AS added, max(url) AS url FROM feed WHERE added >= '2026-07-01' GROUP BY id), r AS (SELECT *, row_number() OVER (ORDER BY added DESC, id) AS rank FROM f), t AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY rank) AS k FROM r WHERE rank <= 30)
 SELECT id, CAST(rank AS INTEGER) AS rank, CAST((rank - 1) // 10 AS INTEGER) AS chunk, CASE WHEN k > 1 THEN url || '#' || id ELSE url END AS url, (SELECT greatest(count(*) - 30, 0) FROM f) AS overflow FROM t""")
def message_plan(spark, d):
    """What is told of July's feed: 30 rows in messages of ten, urls told apart, the rest counted."""
    f = table(spark, d, "feed").filter("added >= '2026-07-01'").groupBy("id").agg(F.max("added").alias("added"), F.max("url").alias("url"))
    return K.plan_messages(f, [F.desc("added"), F.asc("id")])


@query("""WITH k AS (SELECT DISTINCT id, nullif(catalogId, '') AS c FROM kit), i AS (SELECT id, max(images) AS images FROM catalog_gunpla GROUP BY id), l AS (SELECT catalogId AS id, min(gno) AS gno FROM mall_link GROUP BY catalogId), g AS (SELECT gno, max(imgPath) AS path FROM mall_good WHERE imgPath IS NOT NULL GROUP BY gno)
 SELECT k.id AS id, coalesce(array_to_string(i.images, '|'), '') AS official, CASE WHEN i.id IS NOT NULL AND len(coalesce(i.images, [])) = 0 THEN g.path END AS other FROM (SELECT id, min(c) AS c FROM k GROUP BY id) k LEFT JOIN i ON k.c = i.id LEFT JOIN l ON l.id = i.id LEFT JOIN g ON g.gno = l.gno""")
def photo_fallback(spark, d):
    """A kit's official pictures, or the mall's where its item has none."""
    k = table(spark, d, "kit").groupBy("id").agg(F.min(F.nullif("catalogId", F.lit(""))).alias("c"))
    i = table(spark, d, "catalog_gunpla").groupBy(F.col("id").alias("c")).agg(F.max("images").alias("images"), F.lit(True).alias("known"))
    links = table(spark, d, "mall_link").groupBy(F.col("catalogId").alias("c")).agg(F.min("gno").alias("gno"))
    g = table(spark, d, "mall_good").filter("imgPath is not null").groupBy("gno").agg(F.max("imgPath").alias("path"))
    both = k.join(i, "c", "left").join(links, "c", "left").join(g, "gno", "left")
    none = F.col("known") & (F.size(F.coalesce("images", F.array().cast("array<string>"))) <= 0)
    return both.select("id", F.coalesce(F.concat_ws("|", "images"), F.lit("")).alias("official"), F.when(none, F.col("path")).alias("other"))
