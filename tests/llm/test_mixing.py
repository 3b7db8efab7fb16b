import os

import numpy as np
import pytest

from shelfspark.llm import mixing

VOCABULARY = os.path.join(mixing.TOKENIZERS, mixing.VOCABULARY)
needs = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no tokenizer files")


def test_owed():
    have = [("a", 0.5, 1, 100), ("b", 0.3, 3, 10), ("c", 0.2, 2, 0)]
    give = mixing.owed(have)
    assert give["c"] == 0 and give["b"] == pytest.approx(30) and give["a"] == pytest.approx(50)
    give = mixing.owed(have, total=120)
    assert give == {"a": pytest.approx(90), "b": 30.0, "c": 0.0}
    assert mixing.owed(have, total=1e9) == {"a": 100.0, "b": 30.0, "c": 0.0}
    assert mixing.owed([("a", 1.0, 1, 0)]) == {"a": 0.0}


def test_pivot_keeps_sums_and_expectations():
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 50, 200)
    p = np.full(200, 0.3)
    hits = np.zeros(200)
    for _ in range(300):
        done, left = mixing.pivot(list(zip(range(200), p, sizes, strict=True)), rng)
        got = sum(sizes[i] * k for i, k in done) + sum(q * s for _, q, s in left)
        assert got == pytest.approx((p * sizes).sum()) and len(left) <= 1
        for i, k, *_ in [*done, *left]:
            hits[i] += k
    assert abs(hits.mean() / 300 - 0.3) < 0.01 and np.abs(hits / 300 - 0.3).max() < 0.15


@needs
def test_mix(spark):
    docs = [(i, "word " * (5 + i % 7), s) for i, s in enumerate(["A b"] * 60 + ["a_B "] * 60 + ["c"] * 30 + [None] * 5 + ["d"] * 5)]
    df = spark.createDataFrame([(*x, 9) for x in [*docs, docs[0], (999, None, "c"), (998, "", "c")]], "doc_id long, text string, source string, tokens int").repartition(5)
    t = spark.createDataFrame([("a-b", 0.6, 1), ("C", 0.3, 3), ("e", 0.1, 2)], "source string, target_share double, max_repeat int")
    got = mixing.mix(df, t)
    rows = got.collect()
    assert len(rows) == 150 and {r.source for r in rows} == {"a_b", "c"}
    assert max(r.copies for r in rows if r.source == "a_b") <= 1 and max(r.copies for r in rows if r.source == "c") <= 3
    rep = {r.source: r for r in mixing.report(got, t).collect()}
    assert rep["e"].actual_share == 0 and abs(rep["a_b"].actual_share - 2 / 3) < 0.02 and abs(rep["c"].actual_share - 1 / 3) < 0.02
    assert sorted(map(tuple, mixing.mix(df, t).collect())) == sorted(map(tuple, rows))
    assert sorted(map(tuple, mixing.mix(df.repartition(11), t).collect())) == sorted(map(tuple, rows))  # whatever the partitions
    assert mixing.mix(df.limit(0), t).count() == 0 and mixing.mix(df, t.limit(0)).count() == 0


@needs
def test_buckets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET", 2)  # a tree of three levels
    df = spark.createDataFrame([(i, "word " * (5 + i % 7), "ab"[i % 2]) for i in range(400)], "doc_id long, text string, source string")
    t = spark.createDataFrame([("a", 0.75, 1), ("b", 0.25, 1)], "source string, target_share double, max_repeat int")
    rep = {r.source: r for r in mixing.report(mixing.mix(df, t), t).collect()}
    assert abs(rep["a"].actual_share - 0.75) < 0.01 and rep["a"].most_copies == 1 and rep["a"].documents == rep["b"].documents == 200


@needs
def test_tokens_round_trip():
    e = mixing.encoder(VOCABULARY)
    for s in ("hello <|endoftext|>", "건담 ガンダム", "a" * 5000):
        assert e.decode(e.encode_ordinary(s)) == s
