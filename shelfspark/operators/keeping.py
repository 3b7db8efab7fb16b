"""Keeping a catalogue: cards, details, snapshots, links and edits merged into what is there. All are keyed and idempotent."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify as C

ITEM = ("line", "grade", "brandKeys", "priceJpy", "channel", "pbUrl", "month", "date", "detailAt", "nameJa", "updated")


def merged_release(month: Column, date: Column, new_month: Column, new_date: Column, *, sure: bool) -> tuple[Column, Column]:
    """(month, date): of one month the new one if it has a day; of another the new one if it is later, or in any case if ``sure``."""
    later = F.lit(True) if sure else new_month > month
    take = F.when(new_month.isNull(), False).when(month.isNull(), True).when(month == new_month, new_date.isNotNull()).otherwise(later)
    return F.when(take, new_month).otherwise(month), F.when(take, new_date).otherwise(date)


def upsert_cards(items: DataFrame, cards: DataFrame, excluded: DataFrame, now: Column) -> DataFrame:
    """(id, *ITEM, change): ``items`` with the ``cards`` (id, nameJa, priceJpy, month, date, channel, pbUrl, brandKey; one an id) of a listing.

    Cards of an excluded id do nothing. A new id is classed by its brand key, or by its title where it has none; a brand of no line, and
    a title of none if only the title can tell (``pb-``), are ``excluded``. Of a known item only a missing price is filled
    and the release moved; while its detail is unknown it also gains the brand key, which may exclude it, channel and page.
    ``updated`` moves with a change only. Changes: added, changed, same, excluded. One full outer join on the id.
    """
    fresh = cards.join(excluded.select("id").distinct(), "id", "left_anti")
    old = items.select("id", *(F.col(c).alias(f"o_{c}") for c in ITEM), F.lit(True).alias("known"))
    both = old.join(fresh.select("id", *(F.col(c).alias(f"c_{c}") for c in ("nameJa", "priceJpy", "month", "date", "channel", "pbUrl", "brandKey")), F.lit(True).alias("told")), "id", "full")
    known, told, open_ = F.col("known").isNotNull(), F.col("told").isNotNull(), F.col("o_detailAt").isNull()
    key = F.col("c_brandKey")
    grows = known & told & open_ & key.isNotNull() & ~F.array_contains(F.coalesce("o_brandKeys", F.array().cast("array<string>")), key)
    keys = F.when(grows, F.concat(F.coalesce("o_brandKeys", F.array().cast("array<string>")), F.array(key))).when(known, F.col("o_brandKeys")).otherwise(F.when(key.isNotNull(), F.array(key)).otherwise(F.array().cast("array<string>")))
    both = both.withColumns({"keys": keys, "vote": C.by_brand(keys), "title": C.by_title(F.col("c_nameJa")), "grows": grows})
    by_key = F.col("grows") | (~known & key.isNotNull())
    line = F.when(by_key, F.col("vote.line")).when(known, F.col("o_line")).otherwise(F.col("title.line"))
    grade = F.when(F.col("grows"), F.coalesce("vote.grade", "o_grade")).when(known, F.col("o_grade")).otherwise(F.when(key.isNotNull(), F.col("vote.grade")).otherwise(F.col("title.grade")))
    out = (by_key & F.col("vote.line").isNull()) | (~known & key.isNull() & F.col("title.line").isNull() & F.col("id").startswith("pb-"))
    month, date = merged_release(F.col("o_month"), F.col("o_date"), F.col("c_month"), F.col("c_date"), sure=False)
    fill = lambda c: F.when(known & told & open_ & (F.coalesce(F.col(f"o_{c}"), F.lit("")) == "") & (F.coalesce(F.col(f"c_{c}"), F.lit("")) != ""), F.col(f"c_{c}")).when(known, F.col(f"o_{c}")).otherwise(F.col(f"c_{c}"))
    new = {
        "line": line, "grade": grade, "brandKeys": F.col("keys"), "priceJpy": F.coalesce("o_priceJpy", "c_priceJpy"), "channel": fill("channel"), "pbUrl": fill("pbUrl"),
        "month": month, "date": date, "detailAt": F.col("o_detailAt"), "nameJa": F.when(known, F.col("o_nameJa")).otherwise(F.col("c_nameJa")),
    }
    differs = F.lit(False)
    for c, v in new.items():
        differs = differs | ~v.eqNullSafe(F.col(f"o_{c}"))
    change = F.when(out, "excluded").when(~known, "added").when(told & differs, "changed").otherwise("same")
    made = both.select("id", *(v.alias(c) for c, v in new.items()), F.col("o_updated").alias("updated"), change.alias("change"))
    return made.withColumn("updated", F.when(F.col("change").isin("added", "changed"), now).otherwise(F.col("updated"))).select("id", *ITEM, "change")


def reclassify(items: DataFrame, brands: Mapping[str, tuple[str | None, str | None]] = C.BRANDS) -> DataFrame:
    """(id, line, grade, state): items (id, line, grade, brandKeys, manual) classed anew by their brand keys. Manual ones and those without a
    key stay; a brand of no line is ``excluded``; a key without a grade keeps the item's. Twice is once."""
    rows = items.withColumn("vote", C.by_brand(F.col("brandKeys"), brands))
    exempt = F.coalesce("manual", F.lit(False)) | (F.size(F.coalesce("brandKeys", F.array().cast("array<string>"))) <= 0)
    line = F.when(exempt, F.col("line")).otherwise(F.col("vote.line"))
    grade = F.when(exempt | F.col("vote.line").isNull(), F.col("grade")).otherwise(F.coalesce("vote.grade", "grade"))
    state = F.when(~exempt & F.col("vote.line").isNull(), "excluded").when(~line.eqNullSafe(F.col("line")) | ~grade.eqNullSafe(F.col("grade")), "changed").otherwise("same")
    return rows.select("id", line.alias("line"), grade.alias("grade"), state.alias("state"))


def detail_outcomes(items: DataFrame, answers: DataFrame, most: int = 3) -> DataFrame:
    """(id, fails, state): items (id, fails) after failed requests (id, status): 404 is ``excluded``, any other adds a failure;
    ``given-up`` at ``most``; without an answer ``same``."""
    both = items.select("id", F.coalesce("fails", F.lit(0)).alias("fails")).join(answers.select("id", "status"), "id", "left")
    gone = F.coalesce(F.col("status") == 404, F.lit(False))
    fails = F.col("fails") + (F.col("status").isNotNull() & ~gone).cast("int")
    return both.select("id", fails.alias("fails"), F.when(gone, "excluded").when(fails >= most, "given-up").when(F.col("status").isNotNull(), "failed").otherwise("same").alias("state"))


def merge_feed(old: DataFrame, new: DataFrame, catalog: DataFrame, excluded: DataFrame, most: int = 1000) -> DataFrame:
    """The feed (id, added, catalogId, titleKo, image) after new rows: those of excluded items go, only new ids are inserted, blanks of rows
    that were there are filled from the catalogue (id, nameKo, image); the ``most`` newest by (added, id). Adds ``inserted``."""
    gone = excluded.select(F.col("id").alias("catalogId")).distinct()
    kept = old.join(gone, "catalogId", "left_anti").select("id", "added", "catalogId", "titleKo", "image")
    ko, img = (F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c)) for c in ("titleKo", "image"))
    known = catalog.select(F.col("id").alias("catalogId"), F.col("nameKo").alias("__k"), F.col("image").alias("__i"))
    kept = kept.join(known, "catalogId", "left").select("id", "added", "catalogId", F.coalesce(ko, "__k", "titleKo").alias("titleKo"), F.coalesce(img, "__i", "image").alias("image"), F.lit(False).alias("inserted"))
    fresh = new.join(kept.select("id"), "id", "left_anti").select("id", "added", "catalogId", "titleKo", "image", F.lit(True).alias("inserted"))
    return kept.unionByName(fresh).orderBy(F.desc("added"), F.desc("id")).limit(most)


def absorb_snapshot(goods: DataFrame, scan: DataFrame, links: DataFrame, complete: bool, before: int, today: str, *, fresh: bool = True, ratio: float = 0.5) -> DataFrame:
    """(gno, name, price, first, seen, ended): goods (gno, name, price, first, seen) after a scan (gno, name, price).

    What was scanned is taken over and seen today; ``first`` stays. A scan is to be trusted if it is complete, not empty and has
    ``ratio`` of the goods ``before``; only then goods that it hasn't go, unless linked, and linked ones are ``ended`` if the scan is also
    fresh. One aggregate row decides, joined to the goods; nothing is collected.
    """
    sane = scan.agg((F.lit(complete) & (F.count("*") > 0) & (F.count("*") >= ratio * before)).alias("sane"))
    old = goods.select("gno", *(F.col(c).alias(f"o_{c}") for c in ("name", "price", "first", "seen")))
    new = scan.select("gno", F.col("name").alias("n_name"), F.col("price").alias("n_price"), F.lit(True).alias("there"))
    both = old.join(new, "gno", "full").join(links.select("gno").distinct().withColumn("linked", F.lit(True)), "gno", "left").join(F.broadcast(sane))
    there = F.col("there").isNotNull()
    both = both.filter(there | F.col("linked").isNotNull() | ~F.col("sane"))
    pick = lambda c: F.when(there, F.col(f"n_{c}")).otherwise(F.col(f"o_{c}")).alias(c)
    ended = ~there & F.col("linked").isNotNull() & F.col("sane") & F.lit(fresh)
    return both.select("gno", pick("name"), pick("price"), F.coalesce("o_first", F.lit(today)).alias("first"), F.when(there, today).otherwise(F.col("o_seen")).alias("seen"), ended.alias("ended"))


def apply_overrides(links: DataFrame, overrides: DataFrame, targets: DataFrame, *, alone: bool = False) -> DataFrame:
    """(key, target, method) of links (key, target, method) under overrides (key, target): a null target forbids the key, one that
    exists replaces or adds its link, one that doesn't is ignored. ``alone``: a forced target is taken from every other key, unless
    that key is forced to it too. Then links to targets that don't exist go."""
    real = targets.select("target").distinct()
    said = overrides.select("key", F.col("target").alias("t")).join(real.withColumnRenamed("target", "t").withColumn("real", F.lit(True)), "t", "left").filter("t is null or real")
    both = links.join(said.select("key", "t", F.lit(True).alias("said")), "key", "full")
    same = F.col("target").eqNullSafe(F.col("t"))
    forced = F.coalesce("said", F.lit(False))
    out = both.select("key", F.when(forced, F.col("t")).otherwise(F.col("target")).alias("target"), F.when(forced & ~same, "override").otherwise(F.col("method")).alias("method"), forced.alias("forced")).filter("target is not null")
    if alone:
        taken = out.filter("forced").select("target").distinct()
        out = out.filter("forced").unionByName(out.filter("not forced").join(taken, "target", "left_anti").select("key", "target", "method", "forced"))
    return out.join(real, "target", "left_semi").select("key", "target", "method")


def record_posts(posts: DataFrame, parsed: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(posts with state and rows, all rows): parsed rows (post, code, name, price) of posts (post, date): ``done`` with a row, ``no-bd`` without;
    of a (post, code) that is there already, or comes twice, the first by name stays."""
    n = parsed.groupBy("post").agg(F.count("*").alias("n"))
    told = posts.join(n, "post", "left").select("post", "date", F.when(F.col("n") > 0, "done").otherwise("no-bd").alias("state"), F.coalesce("n", F.lit(0)).alias("rows"))
    first = parsed.groupBy("post", "code").agg(F.min(F.struct("name", "price")).alias("x")).select("post", "code", "x.name", "x.price")
    fresh = first.join(rows.select("post", "code"), ["post", "code"], "left_anti").join(posts.select("post", F.col("date").alias("postDate")), "post")
    return told, rows.unionByName(fresh.select(*rows.columns))


def edited(old: DataFrame, edits: DataFrame, today: str) -> DataFrame:
    """Kits (id, list, status, date, shop, price, startDate, doneDate, catalogId, cover) after a form was saved (the same columns), full outer by id.

    A wish has no purchase and no build. A kit that comes to ``building`` starts, one that comes to ``built`` or ``custom`` is done today,
    unless a day is given. Moved from a wish, an empty purchase day is today. An official cover goes when the link does.
    """
    cols = ("list", "status", "date", "shop", "price", "startDate", "doneDate", "catalogId", "cover")
    both = old.select("id", *(F.col(c).alias(f"o_{c}") for c in cols)).join(edits.select("id", *(F.col(c).alias(f"n_{c}") for c in cols), F.lit(True).alias("told")), "id", "full")
    told, wish = F.col("told").isNotNull(), F.col("n_list") == "wish"
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    status = F.when(wish, "unbuilt").otherwise(F.col("n_status"))
    comes = lambda *s: status.isin(*s) & ~F.coalesce(F.col("o_status").isin(*s), F.lit(False))
    new = {
        "list": F.col("n_list"), "status": status,
        "date": F.when(wish, "").when(empty("n_date") & (F.col("o_list") == "wish"), today).otherwise(F.col("n_date")),
        "shop": F.when(wish, "").otherwise(F.col("n_shop")), "price": F.when(wish, 0).otherwise(F.col("n_price")),
        "startDate": F.when(wish, "").when(empty("n_startDate") & comes("building"), today).otherwise(F.col("n_startDate")),
        "doneDate": F.when(wish, "").when(empty("n_doneDate") & comes("built", "custom"), today).otherwise(F.col("n_doneDate")),
        "catalogId": F.col("n_catalogId"), "cover": F.when(F.col("n_cover").startswith("off:") & empty("n_catalogId"), None).otherwise(F.col("n_cover")),
    }
    return both.select("id", *(F.when(told, v).otherwise(F.col(f"o_{c}")).alias(c) for c, v in new.items()))


def relinked(kits: DataFrame, links: DataFrame) -> DataFrame:
    """Kits (id, catalogId, cover) with new links (id, catalogId): an official cover of the product before is dropped."""
    both = kits.join(links.select("id", F.col("catalogId").alias("__n"), F.lit(True).alias("__t")), "id", "left")
    now = F.when(F.col("__t"), F.nullif("__n", F.lit(""))).otherwise(F.nullif("catalogId", F.lit("")))
    moved = F.col("__t").isNotNull() & ~now.eqNullSafe(F.nullif("catalogId", F.lit("")))
    return both.select("id", now.alias("catalogId"), F.when(moved & F.col("cover").startswith("off:"), None).otherwise(F.col("cover")).alias("cover"))


def outdated_translations(items: DataFrame, terms: Mapping[str, str], applied: Mapping[str, str]) -> Column:
    """Whether an item's translation (ja in compatibility form, ko, source) is to be made again: it isn't a shop's, and has Han characters that the
    original hasn't, or lacks what a term that is new, or changed since ``applied``, is to be."""
    fresh = {j: k for j, k in terms.items() if applied.get(j) != k}
    han = lambda c: F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("([㐀-䶿一-鿿])"), 1)
    lacks = F.lit(False)
    for j, k in fresh.items():
        lacks = lacks | (F.col("ja").contains(j) & ~F.col("ko").contains(k))
    own = (F.coalesce("ko", F.lit("")) != "") & (F.coalesce("source", F.lit("")) == "")
    return F.coalesce(own & ((F.size(F.array_except(han(F.col("ko")), han(F.col("ja")))) > 0) | lacks), F.lit(False))


def revive(items: DataFrame, excluded: DataFrame, wanted: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items (id, manual), excluded (id, reason)) after users asked for ``wanted`` (id): an unknown or excluded id becomes a manual item if its
    page was ``found`` (id); otherwise everything stays as it was."""
    asked = wanted.select("id").distinct().join(found.select("id").distinct(), "id", "left_semi")
    fresh = asked.join(items.select("id"), "id", "left_anti").withColumn("manual", F.lit(True))
    return items.select("id", "manual").unionByName(fresh), excluded.join(fresh.select("id"), "id", "left_anti")


def plan_messages(rows: DataFrame, order: Sequence[Column], *, size: int = 10, most: int = 30) -> DataFrame:
    """(id, rank, chunk, url, overflow) of rows (id, url): the first ``most`` in order, in chunks of ``size``; a repeated url gets its row's id;
    ``overflow`` counts the rows left. The order is taken by a top-k; the count is one aggregate."""
    from pyspark.sql import Window

    n = rows.agg(F.greatest(F.count("*") - most, F.lit(0)).alias("overflow"))
    top = rows.orderBy(*order).limit(most)
    top = top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    again = F.row_number().over(Window.partitionBy("url").orderBy("rank")) > 1
    url = F.when(again, F.concat("url", F.lit("#"), F.col("id"))).otherwise(F.col("url"))
    return top.select("id", "rank", F.floor((F.col("rank") - 1) / size).cast("int").alias("chunk"), url.alias("url")).join(F.broadcast(n))
