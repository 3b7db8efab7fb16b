import random

import pytest

from shelfspark.functions import shopnames as N
from shelfspark.operators import entities as E

ITEM = "id string, line string, grade string, scale string, nameKo string, nameKoAi string, nameKoJoy string, nameJa string"


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_ratios_against_brute_force():
    rnd = random.Random(1)
    texts = ["".join(rnd.choices("abcd", k=rnd.choice([0, 1, 5, 12, 64, 90]))) for _ in range(60)]
    pool = N.Pool(texts)
    for t in texts:
        want = [200.0 * common(t, o) / (len(t) + len(o)) if t or o else 100.0 for o in texts]
        assert list(pool.ratios(t)) == pytest.approx(want) and [N.ratio(t, o) for o in texts] == pytest.approx(want)


def test_names():
    assert N.read_arrival("[HG115] 1/144 VSV-0570 부야포 루베(BUYAPO RUBE) - 창환기 네베고(프라모델)") == ("HG", "1/144", "부야포 루베", "VSV570")
    assert N.read_arrival("[HG] 1/144 큐베레이 마크2 - 플 전용기(프라모델)")[2] == "큐베레이 마크2 - 플 전용기"
    assert N.read_good("ENTRY GRADE 1/144 RX-78-02 건담") == ("EG", "1/144", "건담", "RX782")
    assert N.read_good("건담 *한정*")[0] is None
    assert N.guard("짐 스나이퍼 K9", "짐 스나이퍼") == "alnum" and N.guard("델타 건담", "제타 건담") == "token" and N.guard("에어 마스터", "에어마스터") is None


def test_every_reason(spark):
    items = spark.createDataFrame(
        [
            ("a", "gunpla", "HG", "1/144", "HG 1/144 MSN-04 사자비", None, None, None), ("b", "gunpla", "HG", "1/144", "HG 1/144 짐 스나이퍼 K9", None, None, None),
            ("c", "gunpla", "HG", None, "HG 디스트로이 커맨드", "HG 디스트로이 커맨도", None, None), ("d", "gunpla", "MG", "1/100", "MG 1/100 건담 델타", None, "MG 델타건담", "MSN-00100"),
            ("e", "gunpla", "BB", None, "BB 무사 건담", None, None, None), ("f", "other", "PG", None, "PG 건담", None, None, None),
            ("g", "gunpla", "RG", None, "RG 바르바토스", None, None, None), ("h", "gunpla", "RG", None, "RG 바르바토즈", None, None, None),
            ("i", "girl", "30MS", None, "30MS 가나다라마바사아자차카", None, None, None), ("j", "girl", "30MS", None, "30MS 가나다라마바사아자차타", None, None, None),
        ], ITEM,
    )
    names = {
        "[HG] 1/144 MSN-04 사자비(SAZABI)": ("a", "linked"), "[HG] 1/144 MSN-04FF 사자비": ("a", "model-conflict"), "[HG] 1/144 짐 스나이퍼": ("b", "guard"), "[HG] 1/100 디스트로이 커맨드": ("c", "linked"),
        "[MG] 1/100 델타건담": ("d", "linked"), "[SD] 무사 건담": ("e", "linked"), "[PG] 건담": (None, "no-candidates"), "[RG] 바르바토스": ("g", "linked"), "건담": (None, "no-grade"), "[HG] 1/144": (None, "no-name"),
        "[HG] 가나다라": (None, "low-score"), "[30MS] 가나다라마바사아자차카": ("i", "ambiguous"),
    }
    got = E.best_match(spark.createDataFrame([(n, n) for n in names], "id string, name string"), items, N.read_arrival, block=3)
    rows = {r.id: r for r in got.collect()}
    for n, (target, reason) in names.items():
        assert rows[n].reason == reason, (n, rows[n])
        assert target is None or rows[n].target == target
    assert len(rows) == len(names) and rows["[HG] 1/144 MSN-04 사자비(SAZABI)"].name_ok


def test_the_second_list_counts(spark):
    """Fourteen names with other numbers are above the right one by the greater ratio; only the list of words in order holds it."""
    near = [(f"n{i}", "gunpla", "HG", None, f"HG 자 차카타하마 바사아거가나 다라라{i}", None, None, None) for i in range(14)]
    items = spark.createDataFrame([*near, ("right", "gunpla", "HG", None, "HG 가나다라라 마바사아거 자차카타호", None, None, None)], ITEM)
    (got,) = E.best_match(spark.createDataFrame([("q", "[HG] 자차카타하 마바사아거 가나다라라")], "id string, name string"), items, N.read_arrival).collect()
    assert (got.target, got.reason, got.score) == ("right", "linked", 94.1)


def test_claims(spark):
    links = spark.createDataFrame([(i, t, 90.0, True, "linked", s) for i, t, s in (("10", "a", 90.0), ("9", "a", 90.0), ("8", "b", 99.0), ("7", "c", 90.0))], "id string, target string, score double, name_ok boolean, reason string, exact double")
    goods = spark.createDataFrame([("10", 1091), ("9", 1091), ("8", 2000), ("7", 5)], "id string, price long")
    items = spark.createDataFrame([("a", 100), ("b", 100), ("c", None)], "target string, jpy long")
    got = {r.id: (r.reason, r.name_ok) for r in E.claims(links, goods, items, spark.createDataFrame([("c",)], "target string")).collect()}
    assert got == {"10": ("duplicate", False), "9": ("linked", True), "8": ("price-mismatch", False), "7": ("duplicate", False)}
