import random

from pyspark.sql import functions as F

from shelfspark.operators.snapshots import snapshot_changes


def run(spark, rows, days):
    df = spark.createDataFrame(rows, "day string, id string, a string, n int, at int, __h string")
    s = spark.createDataFrame([(d,) for d in days], "day string")
    got = snapshot_changes(df, s, snapshot="day", key=["id"], values={"a": F.col("a"), "n": F.col("n")}, latest=[F.col("at")])
    return sorted(tuple(r) for r in got.collect())


def test_against_brute_force(spark):
    rng = random.Random(5)
    days = ["d1", "d2", "d4", "d5"]
    rows = [(f"d{rng.randint(1, 5)}", f"k{rng.randint(1, 9)}", rng.choice(["x", "y", None]), rng.choice([1, None]), i, "h") for i in range(120)]
    held = {}
    for d, k, a, n, _, _ in rows:
        held[d, k] = (a, n)
    want = []
    for old, new in zip(days, days[1:], strict=False):
        for k in {k for d, k in held if d in (old, new)}:
            x, y = held.get((old, k)), held.get((new, k))
            if x != y:
                want.append((new, k, "added" if x is None else "removed" if y is None else "changed"))
    assert run(spark, rows, days) == sorted(want)


def test_edges(spark):
    one = [("d1", "k", "x", 1, 1, "h")]
    assert run(spark, one, ["d1"]) == []
    assert run(spark, [], ["d1", "d2"]) == []
    assert run(spark, one, []) == []
    assert run(spark, [*one * 3, ("d2", None, "x", 1, 1, "h")], ["d1", "d2", None]) == [("d2", "k", "removed")]
    # a null in one column isn't a null in another; a value moved is a change
    assert run(spark, [("d1", "k", None, 1, 1, ""), ("d2", "k", "1", None, 1, "")], ["d1", "d2"]) == [("d2", "k", "changed")]
