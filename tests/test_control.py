import pytest
from pyspark.sql import functions as F

from shelfspark.plans import control as C

STAGES = ("plan", "brand", "item", "shop", "translate")


def test_selection():
    pick = lambda **k: C.selected(STAGES, groups={"maker": ("plan", "brand", "item")}, optional=("fill",), costly=("translate",), **k)
    assert pick() == list(STAGES) and pick(dry_run=True) == list(STAGES[:-1])
    assert pick(only=["shop", "maker"]) == ["plan", "brand", "item", "shop"] and pick(only=["fill", "translate"], dry_run=True) == ["translate", "fill"]
    with pytest.raises(ValueError, match="nope"):
        pick(only=["nope"])


def test_a_failing_stage_stops_no_other():
    run = C.Run()
    run.stage("a", lambda: (3, []))
    run.stage("b", lambda: 1 / 0)
    run.stage("c", lambda: (2, [str(i) for i in range(9)]))
    assert run.outcomes["a"] == C.Outcome(True, 3, None) and not run.outcomes["b"].ok and "ZeroDivision" in run.outcomes["b"].error
    assert run.outcomes["c"].items == 2 and run.outcomes["c"].error.startswith("9 failed") and run.outcomes["c"].error.endswith("…")


def test_cursors():
    assert C.months_before(None, "2025-11", "2026-02") == ["2026-01", "2025-12", "2025-11"] and C.months_before("2025-11", "2025-11", "2026-02") == []
    book = {1: [1, 2], 2: [3, 4], 3: [5]}
    assert C.resumed(book.get, None, size=2, budget=9) == ([1, 2, 3, 4, 5], None)
    assert C.resumed(book.get, None, size=2, budget=1) == ([1, 2], 2) and C.resumed(book.get, 2, size=2, budget=1, known=lambda r: r == 3) == ([4], 3)
    assert C.resumed(lambda p: book.get(p) if p != 2 else None, 1, size=2, budget=9) == ([1, 2], 2)
    assert C.resumed(lambda p: [7, 8], 1, size=2, budget=9) == ([7, 8], None)  # past the end the last page comes again


def test_cursor_table(spark):
    seen = spark.createDataFrame([("a", 1, 3, True), ("a", 2, 3, True), ("b", 1, 4, True), ("b", 2, 4, False), ("b", 3, 4, True), ("c", 1, 1, True)], "source string, page int, last int, ok boolean")
    once = C.advanced(C.no_cursors(spark), seen)
    assert {tuple(r) for r in once.collect()} == {("a", 3, 3, False), ("b", 2, 4, False), ("c", 2, 1, True)}
    assert {tuple(r) for r in C.advanced(once, seen.filter("ok and page < 2")).collect()} == {tuple(r) for r in once.collect()}  # nothing new


def test_budgets(spark):
    rows = spark.createDataFrame([(i, i % 2 == 0) for i in range(20)], "id int, new boolean")
    got = C.budgeted(rows, [F.desc("id")], new="new", most_new=3, most_rest=9, hard=5).collect()
    assert sorted(r.id for r in got) == [14, 16, 17, 18, 19]
    assert C.manual_first(["a", "b", "a", "c", "d"], {"b": (True, 0), "c": (False, 3)}) == ["a", "d"] and C.batches(601) == 12 and C.batches(0) == 0


def test_queue():
    ids = ["a", "b", "c", "d"]
    assert C.queue([], ids) == ids
    assert C.queue([("later", "a"), ("link", "b"), ("later", "c")], ids) == ["d", "a", "c"]
    assert C.queue([("skip", "a"), ("back", ""), ("skip", "d"), ("requeue", "d")], ids) == ids
