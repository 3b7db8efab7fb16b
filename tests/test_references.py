import itertools
import random

import pytest
from pyspark.sql import functions as F

from shelfspark.functions.times import local_time
from shelfspark.operators.references import check_references, state_report


def brute(ref, targets, match):
    named = [i for i, v in enumerate(ref) if v is not None]
    if not named:
        return "none"
    if len(named) < len(ref) and match != "partial":
        return "malformed" if match == "full" else "none"
    return "found" if any(all(t[i] is not None and t[i] == ref[i] for i in named) for t in targets) else "orphan"


@pytest.mark.parametrize("match", ["simple", "partial", "full"])
def test_against_brute_force(spark, match):
    rng = random.Random(3)
    pick = lambda: tuple(rng.choice([None, "a", "b", "c"]) for _ in range(3))
    refs, targets = [pick() for _ in range(150)], [pick() for _ in range(12)] * 2
    r = spark.createDataFrame([(i, *x, "kept") for i, x in enumerate(refs)], "i int, x string, y string, z string, __mask2 string")
    t = spark.createDataFrame(targets, "x string, y string, z string")
    got = {row.i: row._state for row in check_references(r, t, [(c, c) for c in "xyz"], match=match).collect()}
    assert got == {i: brute(x, targets, match) for i, x in enumerate(refs)}


def test_empty_tables_repeats_and_clashing_names(spark):
    refs = spark.createDataFrame([("a", "t"), ("a", "t"), (None, "t")], "key string, `a.b` string")
    none = spark.createDataFrame([], "key string, seen string")
    got = check_references(refs, none, [("key", "key")], carry=["seen"])
    assert sorted(r._state for r in got.collect()) == ["none", "orphan", "orphan"]
    assert got.columns == ["key", "a.b", "_state", "_state_seen"]
    assert check_references(refs.limit(0), refs, [("key", "key")]).count() == 0
    with pytest.raises(ValueError, match="match"):
        check_references(refs, none, [("key", "key")], match="some")


def test_carry_takes_the_least(spark):
    refs = spark.createDataFrame([("a",)], "key string")
    targets = spark.createDataFrame([("a", 3), ("a", 1), ("a", None)], "key string, v int")
    assert check_references(refs, targets, [("key", "key")], carry=["v"]).first()._state_v == 1


def test_report(spark):
    rows = spark.createDataFrame([("f", "2026-01", s) for s in ("orphan", "found", "none")], "ref_table string, period string, _state string")
    assert [tuple(r) for r in state_report(rows.filter("_state <> 'none'"), "_state", ("orphan",), "ref_table", "period").collect()] == [("f", "2026-01", 2, 1)]


def test_times(spark):
    texts = ["2026-01-31T23:30:00Z", "2026-01-31T23:30:00+09:00", "2026-01-31T23:30:00+00:00", "x", None, "2026-01-31T10:00"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(F.date_format(local_time(F.col("t")), "yyyy-MM-dd HH:mm")).collect()]
    assert got == ["2026-02-01 08:30", "2026-01-31 23:30", "2026-02-01 08:30", None, None, "2026-01-31 19:00"]


def test_every_null_mask(spark):
    masks = list(itertools.product([None, "q"], repeat=2))
    refs = spark.createDataFrame([(*m,) for m in masks], "x string, y string")
    got = check_references(refs, spark.createDataFrame([("q", "z")], "x string, y string"), [("x", "x"), ("y", "y")], match="partial")
    assert {(r.x, r.y): r._state for r in got.collect()} == {(None, None): "none", (None, "q"): "orphan", ("q", None): "found", ("q", "q"): "orphan"}
