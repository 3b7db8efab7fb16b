import random

import numpy as np
import pandas as pd
import pytest

from shelfspark.llm.leaks import STRETCH, Finder, cut, distances, edits_at_start, edits_between, leaked_items, letters, prefix_distances, scan

rng = random.Random(1)
WORDS = ["".join(rng.choice("bdfghklmnprstvz") + rng.choice("aeiou") for _ in range(rng.randint(1, 3))) for _ in range(400)]


def text(n, r):
    return " ".join(r.choice(WORDS) for _ in range(n))


def slow(p, t):
    row = [0] * (len(t) + 1)
    for i, a in enumerate(p, 1):
        new = [i]
        for j, b in enumerate(t, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_distances_against_dynamic_programming():
    r = random.Random(2)
    item = "".join(r.choice("abc") for _ in range(200))
    f = Finder([(1, item)])
    f.prepare()
    texts = ["".join(r.choice("abcd") for _ in range(40)) for _ in range(60)]
    starts = [r.randrange(0, 150) for _ in texts]
    codes = np.array([f.coded(t) for t in texts])
    for m in (1, 20, 50):
        got = distances(f.bitmap, np.array(starts), m, codes)
        assert got.tolist() == [slow(item[s : s + m], t) for s, t in zip(starts, texts, strict=True)]
    assert cut(codes[0], np.array([-2, 39]), 3).tolist() == [[0, 0, codes[0][0]], [codes[0][39], 0, 0]]


def test_prefix_distances_against_dynamic_programming():
    r = random.Random(3)
    item = "".join(r.choice("abc") for _ in range(200))
    f = Finder([(1, item)])
    f.prepare()
    texts = ["".join(r.choice("abcd") for _ in range(50)) for _ in range(40)]
    starts = np.array([r.randrange(0, 150) for _ in texts])
    got = prefix_distances(f.bitmap, starts, 43, np.array([f.coded(t) for t in texts]))
    assert got.tolist() == [edits_at_start(item[s : s + 43], t) for s, t in zip(starts.tolist(), texts, strict=True)]
    back = prefix_distances(f.reversed, len(item) - starts, 43, np.array([f.coded(t)[::-1] for t in texts]))
    assert back.tolist()[5] == edits_at_start(item[max(0, starts[5] - 43) : starts[5]][::-1].ljust(43, "?"), texts[5][::-1])
    assert edits_between("kitten", "sitting") == 3 and edits_between("", "ab") == 2
    assert edits_at_start("ab", "xab") == [0, 1, 1] and edits_at_start("ba", "ba") == [0, 0, 0]


ITEMS = [(i, text(60, rng) + f" question {i}?") for i in range(12)]


def altered(s, edits, r):
    s = list(s)
    for _ in range(edits):
        k = r.randrange(len(s))
        s[k : k + 1] = r.choice([[], [s[k], "q"], ["x"]])
    return "".join(s)


@pytest.fixture(scope="module")
def cases():
    r = random.Random(4)
    docs, want = [], set()
    for k in range(120):
        i, s = ITEMS[k % 12]
        at = r.randrange(0, 100)
        part = s[at : at + 110]
        own = text(30, r)
        kind = k // 12 % 6
        if kind == 0:
            got, hit = part, True
        elif kind == 1:
            got, hit = altered(part, 5, r), True
        elif kind == 2:  # cut into by other text
            got, hit = part[:55] + " " + text(12, r) + " " + part[55:], True
        elif kind == 3:  # set out in another way
            got, hit = "> " + "\n> ".join(part[j : j + 20].upper() for j in range(0, len(part), 20)), True
        elif kind == 4:  # too short
            got, hit = s[at : at + 40], False
        else:
            got, hit = text(20, r), False
        docs.append((k, own + " " + got + " " + text(20, r)))
        if hit:
            want.add((k, i))
    return docs, want


def test_planted_passages(spark, cases):
    docs, want = cases
    df = spark.createDataFrame([(d, t, 0) for d, t in docs] + [docs[0] + (1,), (999, None, 0), (998, "", 0)], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([*ITEMS, (77, None), (78, "short")], "item_id int, text string")
    got = {tuple(r) for r in leaked_items(df, items).collect()}
    assert got == want
    assert {tuple(r) for r in leaked_items(df, items, block_letters=1000).collect()} == want  # items in blocks
    assert leaked_items(df.limit(0), items).count() == 0
    assert leaked_items(df, items.limit(0)).count() == 0


def test_a_very_long_text(spark):
    r = random.Random(9)
    long = text(20_000, r) + " " + ITEMS[3][1][10:110] + " " + text(20_000, r)
    df = spark.createDataFrame([(1, long)], "doc_id long, text string")
    assert [tuple(x) for x in leaked_items(df, spark.createDataFrame(ITEMS, "item_id int, text string")).collect()] == [(1, 3)]


def leaks_of(spark, texts, items, **more):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    return {tuple(r) for r in leaked_items(df, spark.createDataFrame(items, "item_id int, text string"), **more).collect()}


def test_repeated_and_quoted_items(spark):
    r = random.Random(5)
    a, b = text(60, r), text(60, r)
    quoting = text(15, r) + " " + a[40:180] + " " + text(15, r)
    items = [(1, a), (2, a), (3, quoting), (4, b)]
    passage = a[70:140]
    texts = [passage, altered(passage[:60], 3, random.Random(2)), altered(b[20:90], 4, random.Random(3))]
    texts = [text(10, r) + " " + t + " " + text(10, r) for t in texts]
    want = {(0, 1), (0, 2), (0, 3), (1, 1), (1, 2), (1, 3), (2, 4)}
    for size in (400_000, 200, 90, 40):  # whatever block an item is in
        assert leaks_of(spark, texts, items, block_letters=size) == want


def test_a_passage_over_a_stretch_s_end(spark):
    r = random.Random(6)
    item = letters(text(80, r))
    other = [letters(text(200, r))[:390] for _ in range(4)]
    passage = item[10:25] + other[0] + item[25:40] + other[1] + item[40:55] + other[2] + item[55:70]
    f = Finder([(1, item, [])])
    assert len(passage) < f.reach
    long = letters(text(40_000, r))
    for before in (0, 1, 500, 1200, STRETCH - 1300, STRETCH - 600, STRETCH - 1, STRETCH, STRETCH + f.reach - 700, STRETCH + f.reach):
        got = pd.concat(scan([pd.DataFrame({"doc_id": [7], "text": [long[:before] + passage + long[-50:]]})], f))
        assert got.values.tolist() == [[7, 1]], before


def test_cuts_and_edits(spark):
    r = random.Random(8)
    item = letters(text(80, r))
    f = Finder([(1, item, [])])
    other = letters(text(40, r))
    parts = {
        "short inserts": item[:20] + other[:4] + item[20:40] + other[4:8] + item[40:60],
        "a letter altered near a cut": item[:30] + other[:20] + item[30:35] + "ß" + item[36:62],
        "a letter altered before a cut": item[:24] + "ß" + item[25:30] + other[:20] + item[30:60],
        "two close letters altered": item[:20] + "ß" + item[21:26] + "ß" + item[27:60],
    }
    for name, t in parts.items():
        assert f.find([other[30:80] + t + other[90:140]]) == {(0, 0)}, name
    assert f.find([other[:50] + item[:11] + other[50:80] + item[11:22] + other[80:99] + item[22:33]]) == set()  # fragments too short


def test_recall_by_edits(spark):
    r = random.Random(11)
    items = [(i, text(60, r)) for i in range(20)]
    f = Finder([(i, letters(t), []) for i, t in items])
    for edits in range(7):
        hit = 0
        for k in range(60):
            i, t = items[k % 20]
            t = letters(t)
            at = r.randrange(0, len(t) - 50)
            part = t[at : at + 50]
            where = set(r.sample(range(50), edits))
            part = "".join("ß" if j in where else c for j, c in enumerate(part))
            hit += (0, k % 20) in f.find([letters(text(20, r)) + part + letters(text(20, r))])
        assert hit == 60, edits


def test_letters():
    assert letters("<b>Ａ b</b>&nbsp;1-2_Ｃ") == "ab12c"
