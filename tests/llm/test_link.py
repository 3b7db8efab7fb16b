from words import LEXICON

from shelfspark.llm import link

RECORDS = [
    ("c1", "HG 1/144 ソンザ・ゲンピ", "1/144", 2000, None), ("c2", "MG 1/100 ソンザ・ゲンピ", "1/100", 6000, None),
    ("c3", "HG 1/144 ソンザ・ゲンピ 水中装備", None, 2500, "s"), ("c4", "SD カミテロ", None, 800, None), ("c4", "SD カミテロ", None, None, None),
    ("c5", "HG 1/144 トキリモボ改", "1/144", 1800, None), (None, "HG x", None, None, None), ("c6", None, None, None, None),
]
MENTIONS = [
    ("m1", "HG 손자 겐피", 21800, None), ("m1", "ＨＧ　손자 겐피 [예약]", 21800, None), ("m2", "1/100 손자겐피", None, None),
    ("m3", "[HG] 손자 겐피 수중장비", 27000, "s"), ("m4", "SD 카테로", 8700, None), ("m5", "HG 도키리모보개", None, None),
    ("m6", "HG 손자 겐피 사막전 사양", 21800, None), ("m7", "손자 겐피", 65000, None), ("m8", None, 1, None), ("m9", "", 1, None), (None, "HG 손자 겐피", 1, None),
    ("m10", "손자 겐피", None, None),
]


def tables(spark):
    r = spark.createDataFrame([(i, n, None, s, p, t) for i, n, s, p, t in RECORDS], "catalog_id string, name string, grade string, scale string, price long, series string")
    m = spark.createDataFrame([(*x, "clash") for x in MENTIONS], "item_key string, name string, price long, series string, grade string")
    return m, r


def test_links(spark):
    m, r = tables(spark)
    got = {x.item_key: x.catalog_id for x in link.link_mentions(m, r, None, LEXICON).collect()}
    # m6: no such variant; m10: two grades, nothing tells them apart
    assert got == {"m1": "c1", "m2": "c2", "m3": "c3", "m4": "c4", "m5": "c5", "m7": "c2"}
    again = {x.item_key: (x.catalog_id, x.confidence) for x in link.link_mentions(m.union(m), r.union(r), None, LEXICON).collect()}
    assert {k: v[0] for k, v in again.items()} == got and all(0 < v[1] <= 1 for v in again.values())


def test_empty(spark):
    m, r = tables(spark)
    assert link.link_mentions(m.limit(0), r, None, LEXICON).count() == 0
    assert link.link_mentions(m, r.limit(0), None, LEXICON).count() == 0


def test_common_attributes_are_refined(spark, monkeypatch):
    m, r = tables(spark)
    want = {tuple(x) for x in link.link_mentions(m, r, None, LEXICON).collect()}
    monkeypatch.setattr(link, "COMMON", 0)  # every attribute is common
    assert {tuple(x) for x in link.link_mentions(m, r, None, LEXICON).collect()} == want


def test_other_language_and_columns(spark):
    r = spark.createDataFrame([("c1", "HG 1/144 聖機", None, "1/144", None, None), ("c1", "HG 1/144 손자 겐피", None, "1/144", None, None), ("c2", "다네네 후야", "MG", None, None, None), ("c3", "다네네 후야", "HG", None, None, None)], "catalog_id string, name string, grade string, scale string, price long, series string")
    m = spark.createDataFrame([("m1", "HG ソンザ・ゲンピ", 100, None), ("m2", "MG 다네네후야", 100, None)], "item_key string, name string, price long, series string")
    assert {x.item_key: x.catalog_id for x in link.link_mentions(m, r, None, LEXICON).collect()} == {"m1": "c1", "m2": "c2"}
