import random
import re
from collections import Counter, defaultdict

from shelfspark.functions import phonetics as P
from shelfspark.operators import quality as Q


def brute(docs):
    J, K = defaultdict(set), defaultdict(set)
    words = [set(re.findall("[가-힣]{2,}", d[3])) for d in docs]
    for i, d in enumerate(docs):
        for w in words[i]:
            K[w].add(i)
        for run in re.findall("[ァ-ヺー]+", d[2]):
            for a in range(len(run)):
                for b in range(a + 3, min(len(run), a + 12) + 1):
                    J[run[a:b]].add(i)
    closed = {}
    for s, ds in J.items():
        if len(ds) >= 3:
            closed[frozenset(ds)] = max(closed.get(frozenset(ds), ""), s, key=lambda x: (len(x), x))
    found = {}
    for ds, s in closed.items():
        n = Counter(w for i in ds for w in words[i])
        cands = {t: c for t, c in n.items() if c / len(K[t]) >= 0.85 and P.sounds_like(t, s)}
        if len(cands) < 2:
            continue
        t0 = max(cands, key=lambda t: (cands[t], len(t), t))
        var = {t0} | {t for t in cands if P.spelt_otherwise(t, t0) and len(K[t] & K[t0]) / min(len(K[t]), len(K[t0])) <= 0.2}
        if len(var) < 2 or len(K[t0]) > 300:
            continue
        keys = lambda t, shop: len({docs[i][1] for i in ds if t in words[i] and (docs[i][4] or not shop)})
        row = (len({docs[i][1] for i in ds}), len(s), s, {t: keys(t, False) for t in var}, {t: keys(t, True) for t in var})
        key = frozenset(var)
        found[key] = max(found.get(key, row), row, key=lambda r: r[:3])
    return sorted(((r[2], r[0], r[3], r[4]) for k, r in found.items() if not any(k < o for o in found)), key=lambda r: (-r[1], r[0]))


def test_variants_against_brute_force(spark):
    rnd = random.Random(3)
    ja, ko = ["クアンタ", "バルバトス", "ガンダム", "サザビー", "デストロイ"], [["쿠안타", "콴타", "퀀타"], ["바르바토스", "발바토스"], ["건담"], ["사자비", "사자비이"], ["디스트로이", "데스트로이"]]
    docs = []
    for i in range(120):
        picked = rnd.sample(range(5), 2)
        docs.append((i, f"k{i // 2}", "HG " + "・".join(ja[k] for k in picked), " ".join(rnd.choice(ko[k]) for k in picked) + " 세트", i % 3 == 0))
    want = brute(docs)
    got = Q.term_variants(spark.createDataFrame(docs, "doc long, key string, ja string, ko string, shop boolean"))
    assert [tuple(r) for r in got.collect()] == want and {"バルバトス", "デストロイ"} <= {r[0] for r in want}


def test_sounds():
    assert P.kana_sound("クアンタ") == P.hangul_sound("퀀터") == "KNT" and P.sounds_like("콴타", "クアンタ")
    assert not P.sounds_like("퍼펙트", "パーフェクトガ") and P.kana_sound("フチハ") == "PSH"


def test_mining_reads_the_names(spark):
    import __spark_entry__ as entry

    items = spark.read.parquet("/root/testdata/sf0.001/catalog_gunpla.parquet")
    got = {r.term for r in entry.queries()["term_mining"](spark, "/root/testdata/sf0.001").collect()}
    series = " ".join(r.series or "" for r in items.collect())
    assert any(t not in series for t in got)
