"""Search, aliases, names and classes: boundary cases."""

from pyspark.sql import functions as F

from shelfspark.functions import classify as C
from shelfspark.functions import scalars as S
from shelfspark.operators import search as X

FIELDS = "id string, grade string, scale string, nameKo string, nameKoAi string, nameKoJoy string, nameJa string, series string, seriesKo string, newest string, picture boolean"
ITEMS = [
    ("a", "HG", "1/144", "HG 1/144 건담 에어리얼", None, None, "HG 1/144 ガンダムエアリアル", None, "수성의 마녀", "2022-10-01", True),
    ("b", "HG", "1/144", "HG 1/144 건담 에어리얼 개수형", None, None, None, None, "수성의 마녀", "2023-03-01", False),
    ("c", "MG", "1/100", "MG 1/100 캠퍼", None, "MG 1/100 켐퍼", None, None, None, "2001-01-01", True),
    ("d", "HG", "1/144", "HG 1/144 건담베이스 한정 [클리어 컬러]", None, None, None, None, None, "2020-01-01", True),
    ("e", "HG", "1/144", None, None, None, None, None, None, "", False),
]


def found(spark, *queries, **more):
    rows = X.index(spark.createDataFrame(ITEMS, FIELDS), "newest", "picture")
    got = X.search(rows, [q if isinstance(q, dict) else {"q": q} for q in queries], newest=F.col("newest"), picture=F.col("picture"), **more)
    return [(r.query, r.id, r.partial) for r in got.orderBy("query", "rank").collect()]


def test_whole_then_beginning_then_other_tokens(spark):
    assert [x[1] for x in found(spark, "건담 에어리얼")] == ["a", "b"]
    assert [x[1] for x in found(spark, "에어리얼 개수형")] == ["b"]
    assert found(spark, "에어리얼 없는말 ") == [("에어리얼 없는말 ", "a", True), ("에어리얼 없는말 ", "b", True)]
    assert found(spark, "없는말", "…", "") == []
    assert [x[1] for x in found(spark, "ＨＧ 마녀")] == ["a", "b"]  # the series, after the picture
    assert [x[1] for x in found(spark, {"q": "건담", "grade": "MG"})] == []
    assert [x[1] for x in found(spark, "건담", most=1)] == ["a"]


def test_aliases_tails_and_generic_words(spark):
    assert [x[1] for x in found(spark, "켐퍼")] == ["c"] and [x[1] for x in found(spark, "켐퍼", aliases=None)] == ["c"]  # its other name
    assert [x[1] for x in found(spark, "에어리얼 클리어")] == ["a", "b"]  # a tail only adds
    assert found(spark, "발길 건담") == []  # a generic word alone makes no hit
    assert {x[1] for x in found(spark, "건담")} == {"a", "b", "d"}  # unless it's all there is
    assert [x[1] for x in found(spark, "클리어")] == ["d"]
    assert X.Aliases().without_tails(["a", "컨트라스트", "컬러"]) == (["a"], [("컨트라스트컬러", ["컨트라스트"])])
    rows = X.index(spark.createDataFrame(ITEMS, FIELDS))
    assert {tuple(r) for r in X.totals(rows, [{"q": "건담"}, {"q": "켐퍼"}, {"q": "zz"}]).collect()} == {("건담", 3), ("켐퍼", 1)}


def one(spark, f, *values):
    names = [f"v{i}" for i in range(len(values))]
    return spark.createDataFrame([values], ", ".join(f"{n} string" for n in names)).select(f(*map(F.col, names))).first()[0]


def test_names_without_grade_and_scale(spark):
    loose = lambda *c: S.stripped(*c, loose=True)
    cases = [("ＭＧ 1/100 x", "MG", "1/100", "x"), ("HGUC 1/144 x", "HG", "1/144", "HGUC 1/144 x"), ("MGx", "MG", None, "MGx"), (None, "MG", None, ""), ("x 1/100", "MG", "1/100", "x 1/100"), ("HG 1/144", "HG", "1/144", "")]
    for name, grade, scale, want in cases:
        assert one(spark, S.stripped, name, grade, scale) == want
    assert one(spark, loose, "HGBD:R 1/144 x", "HG", "1/144") == "x" and one(spark, loose, "HGUCABCDE x", "HG", None) == "HGUCABCDE x"


def test_classes(spark):
    vote = lambda *keys: tuple(spark.range(1).select(C.by_brand(F.array(*map(F.lit, keys))).alias("x")).select("x.*").first())
    assert vote("hg", "30ms") == ("girl", "30MS", []) and vote("pb_gunpla", "MG") == ("gunpla", "MG", []) and vote("tool", "new") == (None, None, ["new"])
    assert vote("pb_gunpla") == ("gunpla", None, [])
    title = lambda t: tuple(one(spark, C.by_title, t))
    assert title("MGSD x") == ("gunpla", "MGSD") and title("eg x") == ("gunpla", "EG") and title("EGX") == (None, None) and title(None) == (None, None)
    assert title("Figure-rise Standard Amplified x") == ("girl", "Figure-rise Standard Amplified")
    for name, want in (("[HG123] x", "HG"), ("[30MM01] x", None), ("[RE] x", "RE/100"), ("[REX] x", None), ("x", None), ("[피규어라이즈 스탠다드] x", None), ("[피규어라이즈스탠다드] x", "Figure-rise Standard")):
        assert one(spark, C.by_bracket, name) == want
    for grade, name, want in (("mg sd", None, "MGSD"), ("", "hg x", "HG"), (None, None, "기타"), ("re 100", None, "RE/100"), ("Figure-rise Standard", None, "Figure-rise Standard")):
        assert one(spark, C.written_grade, grade, name) == want
    for scale, grade, want in (("1 / 60", "HG", "1/60"), ("NON", "HG", "논스케일"), (None, "HG", "1/144"), ("", "기타", "논스케일")):
        assert one(spark, C.written_scale, scale, grade) == want
    assert one(spark, C.duplicate_form, "HGUC 자쿠-II (改)") == one(spark, C.duplicate_form, "hg 자쿠 ii 改") == "자쿠ii改"
