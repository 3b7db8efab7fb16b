"""Merges: boundary cases; the queries hold them against SQL."""

from pyspark.sql import functions as F

from shelfspark.operators import keeping as K


def test_release_precedence(spark):
    cases = [  # month, day, new month, new day, sure -> month, day
        (("2026-01", None, "2026-01", "2026-01-05"), False, ("2026-01", "2026-01-05")), (("2026-01", "2026-01-03", "2026-01", None), True, ("2026-01", "2026-01-03")),
        (("2026-03", "2026-03-01", "2026-02", "2026-02-01"), False, ("2026-03", "2026-03-01")), (("2026-03", "2026-03-01", "2026-02", None), True, ("2026-02", None)),
        (("2026-03", None, "2026-04", None), False, ("2026-04", None)), ((None, None, "2026-04", None), False, ("2026-04", None)), (("2026-03", None, None, None), True, ("2026-03", None)),
    ]
    for row, sure, want in cases:
        df = spark.createDataFrame([row], "a string, b string, c string, d string")
        assert tuple(df.select(*K.merged_release(*map(F.col, "abcd"), sure=sure)).first()) == want


ITEM = "id string, line string, grade string, brandKeys array<string>, priceJpy long, channel string, pbUrl string, month string, date string, detailAt string, nameJa string, updated string"
CARD = "id string, nameJa string, priceJpy long, month string, date string, channel string, pbUrl string, brandKey string"


def test_cards(spark):
    items = spark.createDataFrame([
        ("bh-1", "gunpla", "HG", ["hg"], None, None, None, "2026-01", None, None, "HG a", "t0"), ("bh-2", "gunpla", "HG", ["hg"], 5, "x", None, "2026-01", None, "t", "HG b", "t0"),
        ("bh-3", "gunpla", "HG", [], 5, None, None, None, None, None, "HG c", "t0"), ("bh-9", "gunpla", "HG", ["hg"], 5, None, None, None, None, None, "HG z", "t0")], ITEM)
    cards = spark.createDataFrame([
        ("bh-1", "HG a", 7, "2026-01", "2026-01-02", "gen", "u", "30ms"), ("bh-2", "HG b", 9, "2025-12", None, "y", "u", "mg"), ("bh-3", "HG c", None, None, None, None, None, "tool"),
        ("bh-4", "RG d", 1, None, None, None, None, None), ("bh-5", "what", 1, None, None, None, None, None), ("pb-6", "what", 1, None, None, None, None, None), ("bh-7", "MG e", 1, None, None, None, None, "train"), ("bh-8", "MG f", 1, None, None, None, None, "mg")], CARD)
    out = spark.createDataFrame([("bh-8",), ("bh-8",)], "id string")
    got = {r.id: r for r in K.upsert_cards(items, cards, out, F.lit("t1")).collect()}
    a = got["bh-1"]  # a girl's key wins, blanks are filled
    assert (a.line, a.grade, a.priceJpy, a.channel, a.date, a.change, a.updated) == ("girl", "30MS", 7, "gen", "2026-01-02", "changed", "t1")
    b = got["bh-2"]  # its detail is known, and the month isn't later
    assert (b.brandKeys, b.priceJpy, b.channel, b.pbUrl, b.month, b.change, b.updated) == (["hg"], 5, "x", None, "2026-01", "same", "t0")
    assert {k: r.change for k, r in got.items()} == {"bh-1": "changed", "bh-2": "same", "bh-3": "excluded", "bh-4": "added", "bh-5": "added", "pb-6": "excluded", "bh-7": "excluded", "bh-9": "same"}
    assert (got["bh-4"].line, got["bh-4"].grade, got["bh-5"].line) == ("gunpla", "RG", None)
    kept = K.upsert_cards(items, cards, out, F.lit("t1")).filter("change <> 'excluded'").drop("change")
    gone = out.union(spark.createDataFrame([("bh-3",), ("pb-6",), ("bh-7",)], "id string"))
    assert {r.change for r in K.upsert_cards(kept, cards, gone, F.lit("t2")).collect()} == {"same"}


def test_snapshots(spark):
    goods = spark.createDataFrame([("1", "a", 1, "f", "s"), ("2", "b", 2, "f", "s"), ("3", "c", 3, "f", "s")], "gno string, name string, price long, first string, seen string")
    scan = spark.createDataFrame([("1", "A", 9), ("4", "d", 4)], "gno string, name string, price long")
    links = spark.createDataFrame([("2",), ("2",)], "gno string")
    run = lambda *a, **k: {r.gno: (r.name, r.first, r.seen, r.ended) for r in K.absorb_snapshot(goods, *a, "t", **k).collect()}
    assert run(scan, links, True, 3) == {"1": ("A", "f", "t", False), "2": ("b", "f", "s", True), "4": ("d", "t", "t", False)}
    small = {"1": ("A", "f", "t", False), "2": ("b", "f", "s", False), "3": ("c", "f", "s", False), "4": ("d", "t", "t", False)}
    assert run(scan, links, True, 5) == small and run(scan, links, False, 3) == small  # not to be trusted
    assert run(scan, links, True, 3, fresh=False)["2"][3] is False
    assert set(run(scan.limit(0), links, True, 0)) == {"1", "2", "3"}


def test_posts(spark):
    posts = spark.createDataFrame([("1", "d1"), ("2", "d2")], "post string, date string")
    rows = spark.createDataFrame([("1", "A", "old", 1, "d1")], "post string, code string, name string, price long, postDate string")
    parsed = spark.createDataFrame([("1", "A", "new", 2), ("1", "B", "y", 3), ("1", "B", "x", 4)], "post string, code string, name string, price long")
    told, every = K.record_posts(posts, parsed, rows)
    assert {tuple(r) for r in told.collect()} == {("1", "d1", "done", 3), ("2", "d2", "no-bd", 0)}
    assert {(r.code, r.name, r.postDate) for r in every.collect()} == {("A", "old", "d1"), ("B", "x", "d1")}
    assert K.record_posts(posts, parsed, every)[1].count() == 2


def test_overrides(spark):
    links = spark.createDataFrame([("a", "x", "fuzzy"), ("b", "y", "fuzzy"), ("c", "z", "fuzzy"), ("d", "gone", "fuzzy")], "key string, target string, method string")
    says = spark.createDataFrame([("a", None), ("c", "y"), ("e", "x"), ("b", "nowhere")], "key string, target string")
    items = spark.createDataFrame([("x",), ("y",), ("z",)], "target string")
    both = {("b", "y", "fuzzy"), ("c", "y", "override"), ("e", "x", "override")}
    assert {tuple(r) for r in K.apply_overrides(links, says, items).collect()} == both
    assert {tuple(r) for r in K.apply_overrides(links, says, items, alone=True).collect()} == both - {("b", "y", "fuzzy")}
