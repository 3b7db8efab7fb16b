"""Queries of the page readers: pages in the sites' markup are made of the tables' rows and read again; SQL says what must come out."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import pages as P
from .run import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _html(c):  # noqa: ANN001, ANN202
    """Text as it stands in a page."""
    return F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def _text(c: str):  # noqa: ANN202
    return F.trim(F.regexp_replace(c, r"[\s\p{Z}]+", " "))


_TEXT = "trim(regexp_replace({0}, '[\\s\\p{{Z}}]+', ' ', 'g'))"


@query(f"""WITH c AS (SELECT id, min({_TEXT.format("nameJa")}) AS nameJa, max(priceJpy) AS priceJpy, max(release.month) AS month FROM catalog_gunpla GROUP BY id)
 SELECT id, nameJa, priceJpy, CASE WHEN id LIKE 'pb-%' THEN 'online' WHEN id LIKE '%3' THEN 'gbase' ELSE 'general' END AS channel, month, CASE WHEN id LIKE '%1' THEN month || '-07' END AS date, 7 AS pages FROM c""")
def schedule_pages(spark, d):
    """Months of cards with a pager, read as cards; a card that stands twice counts once, other links don't."""
    c = table(spark, d, "catalog_gunpla").groupBy("id").agg(F.min(_text("nameJa")).alias("nameJa"), F.max("priceJpy").alias("priceJpy"), F.max("release.month").alias("month"))
    href = F.concat(F.lit("https://site.example/item/"), F.regexp_replace("id", "^(?:bh|pb)-", ""), F.lit("/?a=1"))
    day = F.concat(F.substr("month", F.lit(1), F.lit(4)), F.lit("年"), F.substr("month", F.lit(6), F.lit(2)).cast("int").cast("string"), F.lit("月"), F.when(F.col("id").endswith("1"), "7日 (土)").otherwise(""))
    tag = F.when(F.col("id").endswith("3"), "p-card__tag -gbase").otherwise("p-card__tag -shop")
    card = F.concat(F.lit("<a class='p-card' href='"), href, F.lit("'><span class='"), tag, F.lit("'></span><p class='p-card__tit'> "), _html(F.col("nameJa")), F.lit("</p>"), F.coalesce(F.concat(F.lit("<p class='p-card__price'>"), F.format_number("priceJpy", 0), F.lit("円（税込）</p>")), F.lit("")), F.coalesce(F.concat(F.lit("<p class='p-card_date'>"), day, F.lit("</p>")), F.lit("")), F.lit("</a>"))
    pages = c.groupBy(F.pmod(F.xxhash64("id"), F.lit(1000)).alias("page")).agg(F.concat_ws("\n", F.collect_list(F.concat(card, F.lit("<a class='p-card' href='/news/1'><p class='p-card__tit'>n</p></a>"), card))).alias("h"))
    html = F.concat(F.lit("<html><script>var a='<a>'</script>"), "h", F.lit("<a class='c-archives__pagination-list-item-link' href='?p=7'>7</a></html>"))
    got = pages.select(P.reader(P.listing, f"cards array<struct<{P.CARD}>>, pages int")(html).alias("x"))
    return got.select(F.explode("x.cards").alias("c"), F.col("x.pages").alias("pages")).select("c.*", "pages")


@query(f"""WITH c AS (SELECT id, min({_TEXT.format("nameJa")}) AS nameJa, max(priceJpy) AS priceJpy, max(release.month) AS month, max(release.date) AS date, min(brandKeys) AS keys, min(seriesKey) AS k, min(series) AS series, max(images) AS images FROM catalog_gunpla GROUP BY id)
 SELECT id, nullif(nameJa, '') AS nameJa, priceJpy, CASE WHEN date IS NOT NULL THEN substr(date, 1, 7) END AS month, date, array_to_string(coalesce(keys, []), ',') AS keys, k AS seriesKey, CASE WHEN k IS NOT NULL THEN coalesce(series, '') END AS series, array_to_string(coalesce(images, []), ',') AS images FROM c""")
def item_pages(spark, d):
    """Items' pages read: fields by label, brand keys and pictures once each in order, the first series, no signed picture."""
    c = table(spark, d, "catalog_gunpla").groupBy("id").agg(F.min(_text("nameJa")).alias("nameJa"), F.max("priceJpy").alias("priceJpy"), F.max("release.date").alias("date"), F.min("brandKeys").alias("keys"), F.min("seriesKey").alias("k"), F.min("series").alias("series"), F.max("images").alias("images"))
    field = lambda label, v: F.coalesce(F.concat(F.lit(f"<dt>{label}</dt><dd>"), v, F.lit("</dd>")), F.lit(""))
    day = F.concat(F.substr("date", F.lit(1), F.lit(4)), F.lit("年"), F.substr("date", F.lit(6), F.lit(2)), F.lit("月"), F.substr("date", F.lit(9), F.lit(2)), F.lit("日"))
    links = F.concat_ws("", F.transform("keys", lambda k: F.concat(F.lit("<li class='p-card__link'><a class='p-card__flat' href='/brand/"), k, F.lit("/'>x</a></li>"))))
    series = F.coalesce(F.concat(F.lit("<li class='p-card__link'><a class='p-card__flat' href='/series/"), F.col("k"), F.lit("/'><b class='p-card__flatTit'>"), _html(F.col("series")), F.lit("</b></a></li><a class='p-card__flat' href='/series/other/'>o</a>")), F.lit(""))
    pictures = F.concat_ws("", F.transform("images", lambda u: F.concat(F.lit("<img src='"), u, F.lit("'>"))))
    html = F.concat(F.lit("<h1 class='p-heading__h1-product'>"), _html(F.col("nameJa")), F.lit("</h1><dl class='pg-products__detail'>"), field("価格", F.concat(F.format_number("priceJpy", 0), F.lit("円"))), field("発売日", day), F.lit("</dl><ul>"), links, links, series, F.lit("</ul><div class='pg-products__contentLeft'>"), pictures, pictures, F.lit("<img src='https://img.example/a.jpg?Expires=1'></div>"))
    got = c.select("id", P.reader(P.detail, P.DETAIL)(html).alias("x"))
    return got.select("id", F.nullif("x.nameJa", F.lit("")).alias("nameJa"), "x.priceJpy", "x.month", "x.date", F.concat_ws(",", "x.brandKeys").alias("keys"), "x.seriesKey", "x.series", F.concat_ws(",", "x.images").alias("images"))


@query("""SELECT post AS id, min(postDate) AS date, 'Post ' || post || ' & more' AS title, CASE WHEN post LIKE '%1' THEN '[notice]' END AS category FROM arrival_row GROUP BY post""")
def board_pages(spark, d):
    """A board's pages read: pinned rows out, the day from the row, the category from beside the title."""
    p = table(spark, d, "arrival_row").groupBy("post").agg(F.min("postDate").alias("day"))
    row = F.concat(F.lit("<tr><td>"), F.when(F.col("post").endswith("1"), "[notice] ").otherwise(""), F.lit("<a href='board_view.asp?x=1&B_iID="), "post", F.lit("'>Post <b>"), "post", F.lit("</b> &amp; more</a></td><td>"), "day", F.lit("</td></tr>"))
    pages = p.groupBy(F.pmod(F.xxhash64("post"), F.lit(500)).alias("page")).agg(F.concat_ws("", F.collect_list(F.concat(row, row))).alias("h"))
    html = F.concat(F.lit("<table><tr><td><a href='board_view.asp?B_iID=1&Notice=true'>pinned</a></td></tr>"), "h", F.lit("</table>"))
    return pages.select(F.explode(P.reader(P.board, f"array<struct<{P.BOARD}>>")(html)).alias("x")).select("x.*")


@query(f"""WITH r AS (SELECT post, code, min({_TEXT.format("name")}) AS name, max(price) AS price FROM arrival_row WHERE name IS NOT NULL AND trim(name) <> '' AND regexp_full_match(code, 'BD[0-9]{{7}}') GROUP BY 1, 2)
 SELECT post, code, name, price, post LIKE '%2' AS restock FROM r WHERE name <> '' """)
def post_pages(spark, d):
    """Posts read: codes, names and prices in three lines; a price may be missing, a code that comes again doesn't count."""
    r = table(spark, d, "arrival_row").filter(r"name is not null and trim(name) <> '' and code rlike '^BD[0-9]{7}\\z'").groupBy("post", "code").agg(F.min(_text("name")).alias("name"), F.max("price").alias("price"))
    lines = F.concat("code", F.lit("<br>"), _html(F.col("name")), F.lit("<br>"), F.coalesce(F.concat(F.format_number("price", 0), F.lit("원<br>")), F.lit("")))
    pages = r.groupBy("post").agg(F.concat_ws("", F.collect_list(lines)).alias("h"))
    html = F.concat(F.lit("<table><tr><td class='Board_View_top'>Arrivals</td></tr><tr><td>"), F.when(F.col("post").endswith("2"), "재입고 안내").otherwise("안내"), F.lit("<br>"), "h", "h", F.lit("</td></tr></table>"))
    got = pages.select("post", P.reader(P.post, P.POST)(html).alias("x")).select("post", "x.restock", F.explode("x.rows").alias("r"))
    return got.select("post", "r.code", "r.name", "r.price", "restock")


@query(f"""WITH g AS (SELECT gno, min({_TEXT.format("name")}) AS name, max(price) AS price, bool_or(soldOut) AS soldOut, max(imgPath) AS imgPath FROM mall_good WHERE gno IS NOT NULL AND name IS NOT NULL AND price IS NOT NULL GROUP BY gno)
 SELECT gno, name, price, soldOut, CASE WHEN regexp_full_match(imgPath, 'goods/(big|middle)/[0-9]{{8}}/[0-9a-f]{{32}}\\.(jpg|jpeg|png|webp)') THEN imgPath END AS imgPath, true AS ok FROM g""")
def mall_pages(spark, d):
    """The mall's lists read: sold out by badge or class, the picture's path without its host; a row without a price is left."""
    g = table(spark, d, "mall_good").filter("gno is not null and name is not null and price is not null").groupBy("gno").agg(F.min(_text("name")).alias("name"), F.max("price").alias("price"), F.bool_or("soldOut").alias("sold"), F.max("imgPath").alias("img"))
    sold = F.coalesce("sold", F.lit(False))
    row = F.concat(F.lit("<li data-childno='1' class='"), F.when(sold & F.col("gno").endswith("1"), "sold-out").otherwise("on"), F.lit("'><a class='thumb' href='detail.do?gno="), "gno", F.lit("'></a><div class='img_box' style='background:url(//cdn.example/base/"), F.coalesce("img", F.lit("none")), F.lit("?resize=1)'></div><h5>"), _html(F.col("name")), F.lit("</h5><p class='price'><b class='num'>"), F.format_number("price", 0), F.lit("</b></p>"), F.when(sold, "<span class='badge'>품절</span>").otherwise(""), F.lit("</li>"))
    pages = g.groupBy(F.pmod(F.xxhash64("gno"), F.lit(1000)).alias("page")).agg(F.concat_ws("", F.collect_list(row)).alias("h"))
    html = F.concat(F.lit("<ul>"), "h", F.lit("<li data-childno='2'><h5>no price</h5></li></ul>"))
    got = pages.select(P.reader(P.mall, f"goods array<struct<{P.MALL}>>, pages int, ok boolean")(html).alias("x"))
    return got.select(F.explode("x.goods").alias("g"), "x.ok").select("g.gno", "g.name", "g.price", "g.soldOut", "g.imgPath", "ok")
