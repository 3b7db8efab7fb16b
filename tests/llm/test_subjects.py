import random

import pandas as pd

from shelfspark.llm.subjects import Labels, _terms, readable, sentences, subject_areas, terms

VOCAB = {s: [f"{s}{a}{b}" for a in "abcdef" for b in "uvwxyz"] for s in ("law", "sport", "art")}
COMMON = [f"plain{a}{b}" for a in "abcde" for b in "uvwx"]


def make(n, seed):
    r = random.Random(seed)
    docs, truth = [], {}
    for i in range(n):
        about = r.sample(list(VOCAB), r.choice([0, 1, 1, 1, 2]))
        lines = []
        for k in range(12):
            s = about[k % len(about)] if about and k < 10 else None
            lines.append(" ".join(r.choice(VOCAB[s] if s and r.random() < 0.6 else COMMON) for _ in range(8)) + ".")
        r.shuffle(lines)
        docs.append((i, " ".join(lines)))
        truth[i] = set(about)
    return docs, truth


def test_held_out_accuracy(spark):
    docs, truth = make(500, 1)
    extra = [docs[0], (9001, None), (9002, ""), (9003, "!!")]
    df = spark.createDataFrame([(*d, "x") for d in docs + extra], "doc_id long, text string, subject string")
    labels = [(i, s) for i in range(0, 500, 5) for s in (truth[i] or {None})]
    lab = spark.createDataFrame([*labels, labels[0]], "doc_id long, subject string")
    found, leaves = subject_areas(df, lab, leaves=12)
    rows = found.collect()
    got = {(r.doc_id, r.subject) for r in rows if r.doc_id % 5}
    want = {(i, s) for i, t in truth.items() if i % 5 for s in t}
    assert len(rows) == len({(r.doc_id, r.subject) for r in rows})
    assert len(got & want) / len(got) > 0.95 and len(got & want) / len(want) > 0.95
    told = leaves.collect()
    assert sum(r.documents for r in told) == 502 * 4  # every document with a text, by subjects and none
    for leaf in {r.leaf for r in told}:
        assert abs(sum(r.weight for r in told if r.leaf == leaf) - 1) < 1e-6
    words = {r.subject: set() for r in told}
    for r in readable(df, leaves).collect():
        words[r.subject] |= set(r.terms)
    for s in VOCAB:  # leaves are named by words of their subject alone
        assert words[s] and words[s] <= set(VOCAB[s])
    assert not words[None]


def test_repeated_documents(spark):
    rows = spark.createDataFrame([(1, "one sentence here."), (1, "another sentence there."), (1, "one sentence here."), (2, "one sentence here.")], "doc_id long, text string")
    got = {r.doc_id: r.ids for r in terms(rows, "doc_id", "text").collect()}
    again = {r.doc_id: r.ids for r in terms(rows.repartition(3), "doc_id", "text").collect()}
    assert sorted(got) == [1, 2] and got == again


def test_edges(spark):
    df = spark.createDataFrame([(1, "a sentence here.")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, subject string")
    assert subject_areas(df, none)[0].count() == 0
    assert subject_areas(df.limit(0), none.union(spark.createDataFrame([(1, "x")], "doc_id long, subject string")))[0].count() == 0


def test_sentences_and_scores():
    assert len(sentences("One sentence. Another one!\nHG 1/144 x.\n가나다 라마바사 아자. 短")) == 3
    assert sentences("") == []
    t = sorted(_terms(w)[0] for w in ("law", "art", "plain"))
    law, art, plain = (_terms(w)[0] for w in ("law", "art", "plain"))
    said = pd.DataFrame([(0, 1, law, 1.0), (1, 0, art, 1.5), (2, 1, law, 0.5)], columns=["leaf", "s", "t", "score"])
    labels = Labels(said, ["art", "law"])
    who = labels.chosen([law, plain, plain, plain, art, plain, plain, law], [2, 4, 5, 8], 0.55)
    assert [(labels.leaf[k], labels.subject[k]) if k >= 0 else None for k in who] == [(0, 1), None, (1, 0), (0, 1)]
    assert labels.chosen(t, [3], 2.0).tolist() == [-1] and labels.chosen([], [], 1.0).tolist() == []
    assert Labels(said.head(0), ["art"]).chosen([law], [1], 0.0).tolist() == [-1]
