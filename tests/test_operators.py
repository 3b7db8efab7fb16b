from pyspark.sql import functions as F

from shelfspark.functions import scalars as S
from shelfspark.operators import merge as M
from shelfspark.operators import quality as Q
from shelfspark.operators import ranking as R
from shelfspark.operators import resolve as X
from shelfspark.sources import readers, writers
from shelfspark.streaming import incremental


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v"))).first()[0]


def test_scalars(spark):
    assert one(spark, "HG 1/144 ZA-007b", S.scale_of) == "1/144"
    assert one(spark, "11/144 1/14400", S.scale_of) is None
    assert one(spark, "ms-06S and MS-6s RX78 RX-78-2 RX-78-3 Zaku1999", S.model_tokens) == ["MS6S", "RX782", "RX783"]
    assert one(spark, "Ver Ka ii 3rd long", S.short_runs) == ["3rd", "ii", "ka", "ver"]
    assert one(spark, "hg: name", lambda c: S.without_prefix(c, ["HG", "MG"])) == "name"
    assert one(spark, "HG", lambda c: S.without_prefix(c, ["HG"])) == "HG"
    assert str(one(spark, "2026/1/5", S.flexible_date)) == "2026-01-05"
    assert str(one(spark, "1/5/2026", S.flexible_date)) == "2026-01-05"
    assert str(one(spark, "45000", S.flexible_date)) == "2023-03-15"
    assert one(spark, "2026/13/5", S.flexible_date) is None
    assert str(one(spark, "2026년 3월 7일", S.flexible_date)) == "2026-03-07"
    assert str(one(spark, "3/7/26", S.flexible_date)) == "2026-03-07"
    assert one(spark, " a, b;a|c8 # ", S.split_tags) == ["a", "b", "c8"]
    assert one(spark, "data:image/png;base64,YWI=", S.data_uri)["bytes"] == b"ab"
    assert one(spark, "https://a.example/x", lambda c: S.allowed_url(c, ["b.example"])) is None
    assert str(one(spark, "1/3", lambda c: S.nearest_year(c, F.lit("2026-12-20").cast("date")))) == "2027-01-03"
    assert one(spark, "7/3", lambda c: S.nearest_year(c, F.lit("2026-12-20").cast("date"))) is None
    assert one(spark, "2026-02", S.partial_date_key) == "2026-02-00"
    assert str(one(spark, "2026-02", S.partial_date_end)) == "2026-02-28"
    assert one(spark, "/private/x.html", lambda c: S.robots_allowed(c, [(False, "/private"), (True, "/private/*.html$")])) is True
    assert one(spark, "/private/x", lambda c: S.robots_allowed(c, [(False, "/private"), (True, "/private/*.html$")])) is False
    assert one(spark, "ab", lambda c: S.replaced(c, {"a": "b", "bb": "c"})) == "c"


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(1, None, 5), (2, "x", 1)], "id int, name string, n int")
    new = spark.createDataFrame([(1, "a", 3), (3, "c", 9)], "id int, name string, n int")
    rules = {"name": "fill", "n": "greatest"}
    got = M.upsert(old, new, ["id"], rules)
    assert {r.id: (r.name, r.n, r.change) for r in got.collect()} == {1: ("a", 5, "changed"), 2: ("x", 1, "gone"), 3: ("c", 9, "added")}
    again = M.upsert(got.drop("change"), new, ["id"], rules)
    assert {r.change for r in again.collect()} == {"same", "gone"}
    assert M.same_content(got.drop("change"), again.drop("change"))


def test_merges(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, None), ("b", 1, "y")], "k string, t int, v string")
    assert {r.k: r.v for r in M.latest(rows, ["k"], [F.col("t")]).collect()} == {"a": None, "b": "y"}
    assert [r.k for r in M.append_new(rows.filter("k = 'a'"), rows, ["k"]).collect()] == ["b"]
    got = M.forced(rows.filter("t = 1").select("k", "v"), spark.createDataFrame([("a", None), ("c", "z")], "k string, v string"), "k", "v")
    assert sorted(tuple(r) for r in got.collect()) == [("b", "y"), ("c", "z")]
    p = M.precedence(spark.createDataFrame([(" ", "b"), (None, None)], "x string, y string"), ["x", "y"], "value", "source").collect()
    assert [(r.value, r.source) for r in p] == [("b", "y"), (None, None)]
    f = M.fill_blanks(spark.createDataFrame([(1, ""), (2, "q")], "id int, s string"), spark.createDataFrame([(1, "n"), (2, "m")], "id int, s string"), "id", ["s"])
    assert {r.id: (r.s, r.filled) for r in f.collect()} == {1: ("n", "s"), 2: ("q", "")}


def test_rankings(spark):
    rows = spark.createDataFrame([(i, i % 3 == 0) for i in range(20)], "id int, new boolean")
    q = R.quota(rows, F.col("new"), 2, 3, [F.desc("id")]).collect()
    assert sorted((r.id, r.bucket) for r in q) == [(15, "first"), (16, "rest"), (17, "rest"), (18, "first"), (19, "rest")]
    assert [(r.rank, r.chunk) for r in R.chunks(rows, [F.asc("id")], 4, 6).orderBy("rank").collect()][-1] == (6, 1)


def test_one_to_one(spark):
    links = spark.createDataFrame([(1, 9, 90.0), (2, 9, 95.0), (3, 8, 80.0)], "id int, t int, s double")
    assert sorted(r.id for r in X.one_to_one(links, "id", "t", "s").collect()) == [2, 3]


def test_quality(spark):
    rows = spark.createDataFrame([(1, "a"), (None, "b")], "n int, s string")
    assert {r.rule: r.rows for r in Q.violations(rows, {"n": F.col("n") > 0, "s": F.col("s") == "a"}).collect()} == {"n": 1, "s": 1}


def test_closed_terms_against_brute_force(spark):
    docs = [(i, w) for i, w in enumerate(["abcd", "abcx", "zabc", "bcd", None, "abc"])]
    got = Q.closed_terms(spark.createDataFrame(docs, "id int, w string"), "id", F.array_compact(F.array("w")), least=2, most=4, support=2)
    sets = {}
    for i, w in docs:
        for a in range(len(w or "")):
            for b in range(a + 2, len(w) + 1):
                sets.setdefault(w[a:b], set()).add(i)
    best = {}
    for t, s in sets.items():
        if len(s) >= 2:
            best[frozenset(s)] = max(best.get(frozenset(s), ""), t, key=lambda x: (len(x), x))
    assert {r.term: r.docs for r in got.collect()} == {t: len(s) for s, t in best.items()}


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Kit name,Cost\n"a ""b""",3\n,\nx,4\n')
    got = readers.delimited(spark, str(tmp_path / "a.csv"), {"name": ["kit name"], "price": ["cost"]}, "name").collect()
    assert sorted(tuple(r) for r in got) == [('a "b"', "3"), ("x", "4")]
    (tmp_path / "b.tsv").write_text("x\t4\n")
    assert [tuple(r) for r in readers.delimited(spark, str(tmp_path / "b.tsv"), {"name": [], "price": []}, "name").collect()] == [("x", "4")]
    for i, v in enumerate(("old", "new")):
        (tmp_path / f"{i}.json").write_text(f'{{"id": 1, "v": "{v}"}}\n{{broken\n')
    got = readers.json_documents(spark, [str(tmp_path / "0.json"), str(tmp_path / "1.json")], "id int, v string", key="id").collect()
    assert [tuple(r) for r in got] == [(1, "new")]
    html = "<html lang=ko><title> T </title><body><h1>H</h1><script>no</script><a href=/x>l</a><a href=/x>m</a>"
    p = spark.createDataFrame([(html,), (None,)], "h string").select(readers.page(F.col("h")).alias("p")).collect()
    assert (p[0].p.title, p[0].p.h1, p[0].p.lang, p[0].p.links) == ("T", "H", "ko", ["/x"]) and p[1].p.title == ""
    raw = spark.createDataFrame([("가".encode("cp949"), "euc-kr"), (b"<meta charset=euc-kr>" + "가".encode("cp949"), None), ("가".encode(), None)], "b binary, c string")
    assert [r[0][-1] for r in raw.select(readers.decoded(F.col("b"), F.col("c"))).collect()] == ["가"] * 3
    posts = spark.createDataFrame([("p", "intro\nBD1\nname 8\n1,200\nBD2\nBD3\nthird\nBD1\nagain")], "id string, t string")
    got = readers.line_records(posts, "id", "t", r"^BD\d$", r"^[\d,]+$")
    assert sorted((r.code, r.name, r.price) for r in got.collect()) == [("BD1", "name 8", 1200), ("BD3", "third", None)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", ["x", "y"]), (0, None, None)], "n int, s string, t array<string>")
    assert writers.write_changed(df, str(tmp_path / "w")) and not writers.write_changed(df.orderBy("n"), str(tmp_path / "w"))
    assert sorted(tuple(r) for r in writers.export_rows(df, {"n": "N", "s": "S", "t": "T"}).collect()) == [("", "", ""), ("1", "a", "x, y")]
    writers.write_routed(df, str(tmp_path / "r"), F.when(F.col("n") > 0, "a").otherwise("b"), [F.desc("n")])
    assert spark.read.json(str(tmp_path / "r")).count() == 2
    assert writers.json_lines(df.filter("n = 1")).first()[0] == '{"n":1,"s":"a","t":["x","y"]}'


def test_stream_equals_batch(spark, tmp_path):
    src = tmp_path / "in"
    for i in range(3):
        spark.createDataFrame([(1, i), (i + 2, i)], "id int, v int").coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema("id int, v int").option("maxFilesPerTrigger", 1).parquet(str(src))
    fold = lambda old, new: M.latest(new if old is None else old.unionByName(new), ["id"], [F.col("v")])
    q = incremental.merged(stream, str(tmp_path / "out"), str(tmp_path / "cp"), fold)
    assert q.awaitTermination(120)
    last = max(int(p.name) for p in (tmp_path / "out").iterdir())
    batch = fold(None, spark.read.parquet(str(src)))
    assert M.same_content(spark.read.parquet(str(tmp_path / "out" / str(last))), batch)


def test_windows_on_a_stream(spark, tmp_path):
    rows = spark.sql("select id, timestamp_seconds(1700000000 + id * 60) as at from range(10)")
    rows.union(rows).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, at timestamp").parquet(str(tmp_path / "in"))
    for name, df, mode in (("once", incremental.once(stream, ["id"], "at", "1 hour"), "append"), ("win", incremental.windowed(stream, "at", "1 minute", "5 minutes"), "complete")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
        q.processAllAvailable()
        q.stop()
    assert spark.table("once").count() == 10
    assert spark.table("win").agg(F.sum("n")).first()[0] == 20


def test_phonetics(spark):
    from shelfspark.functions.phonetics import likeness, skeleton, sound_skeleton

    assert skeleton("ソンザゲン") == skeleton("손자겐") == "SNSKN"
    rows = spark.createDataFrame([("ザク", "자쿠"), ("ザク", None)], "a string, b string").select(sound_skeleton(F.col("a")).alias("s"), likeness(F.col("a"), F.col("b")).alias("l"))
    got = rows.collect()
    assert got[0].s == "SK" and got[1].l is None


def test_every_query_plans_without_a_cross_join(spark):
    """A broadcast of one row is fine; pairs of all rows are not."""
    import __spark_entry__ as entry

    for name in ("recency_gap", "facet_counts_skip_one", "feed_enriched", "p1_report"):
        plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan, name
