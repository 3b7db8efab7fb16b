import random

from words import LEXICON

from shelfspark.llm.graph import components
from shelfspark.llm import listings
from shelfspark.llm.listings import groups_of, pairs_of, same_product


def test_components_against_union_find(spark):
    r = random.Random(1)
    edges = [(f"n{r.randrange(60):02d}", f"n{r.randrange(60):02d}") for _ in range(45)] + [(f"p{i:03d}", f"p{i + 1:03d}") for i in range(80)]
    nodes = sorted({x for e in edges for x in e} | {"alone"})
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    got = components(spark.createDataFrame([(n,) for n in nodes], "node string"), spark.createDataFrame(edges, "a string, b string"))
    assert {x.node: x.root for x in got.collect()} == {n: root(n) for n in nodes}


LISTINGS = [
    (1, "HG 1/144 ソンザ・ゲンピ", 2000, "JPY"), (2, "무료배송 손자겐피 하이 그레이드", 20000, "KRW"), (3, "HG 손 자 겐피 1:144 (Sonza Genpi)", None, None),
    (4, "HG 손자 겐피 데칼 (본체 별매)", 3000, "KRW"), (5, "HG 손자 겐피 두 개 묶음", 40000, "KRW"), (6, "MG 손자 겐피 1/100", 60000, "KRW"),
    (7, "손자 겐피 정품", 59000, "KRW"), (8, "HG 손자 겐피 Ver.2", 20000, "KRW"), (9, "HG 소자 겐피 SALE", 20000, "KRW"), (10, "HG 전용 습식 데칼 손자 겐피", 3100, "KRW"),
    (11, None, 1, "KRW"), (12, "★", 1, "KRW"), (1, "HG 1/144 ソンザ・ゲンピ", 2000, "JPY"), (13, "SD 나노반칸모개", None, None), (14, "SD 나노반칸모 개", None, None),
]


def test_groups(spark):
    rows = spark.createDataFrame([(*x, "c") for x in LISTINGS], "listing_id long, name string, price long, currency string, product string")
    got = same_product(rows, None, LEXICON)
    groups = {}
    for r in got.collect():
        groups.setdefault(r.product, set()).add(r.listing_id)
    # 9 misspells a syllable's end: another name, as short ones have no spelling with one missing
    assert {1, 2, 3} in groups.values() or {1, 2, 3, 9} in groups.values()
    assert {4, 10} in groups.values() and {5} in groups.values() and {6, 7} in groups.values() and {8} in groups.values() and {13, 14} in groups.values()
    assert not {11, 12} & set().union(*groups.values())
    pairs = {tuple(r) for r in pairs_of(got).collect()}
    assert (1, 2) in pairs and (2, 1) not in pairs and (4, 10) in pairs and (6, 7) in pairs and (5, 6) not in pairs
    assert same_product(rows.limit(0), None, LEXICON).count() == 0


def products(spark, names):
    rows = spark.createDataFrame([(i, n, None, None) for i, n in enumerate(names)], "listing_id long, name string, price long, currency string")
    groups = {}
    for r in same_product(rows, None, LEXICON).collect():
        groups.setdefault(r.product, set()).add(r.listing_id)
    return sorted(map(sorted, groups.values()))


def test_unlisted_variants(spark):
    got = products(spark, ["MG 1/100 사자비 손자", "MG 1/100 사자비 손자 Ver.Ka", "MG 1/100 사자비 손자 2.0", "MG 사자비손자 정품", "MG 사자비 손자 나이트 컬러", "MG サザビ・ソンザ ver.ka"])
    assert got == [[0, 3], [1, 5], [2], [4]]


def test_common_tokens_are_refined(spark, monkeypatch):
    rows = spark.createDataFrame([(*x, "c") for x in LISTINGS], "listing_id long, name string, price long, currency string, product string")
    want = {tuple(r) for r in pairs_of(same_product(rows, None, LEXICON)).collect()}
    monkeypatch.setattr(listings, "COMMON", 0)
    got = same_product(rows, None, LEXICON)
    assert {tuple(r) for r in pairs_of(got).collect()} == want
    assert sum(r.listings for r in groups_of(got).collect()) == 12
