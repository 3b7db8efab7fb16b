from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfspark.functions.looks import look
from shelfspark.llm.lookalike import canonical, forms, one_form, same_look

ODD = list("aA Ηо​　 ﾊﾞｶﾞ゙゚ﾞ゛力卜へべ가각각1¼Ⅱ️́Å\t\nが𝐀ー・·한\U000e0100")


@settings(max_examples=600, deadline=None)
@given(st.one_of(st.text(alphabet=st.sampled_from(ODD), max_size=14), st.text(max_size=20)))
def test_segments_give_the_whole_text_s_form(s):
    assert one_form(s) == look(s)


def test_column(spark):
    texts = ["", None, "  ", "ok", "ﾊﾞ" * 40_000, "a\n"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", canonical(F.col("t")).alias("c")).collect()
    assert [r.c for r in got] == [None if t is None else look(t) for t in texts]


def test_same_look_against_brute_force(spark):
    kits = ["HG ガ", "ＨＧ　ガ", "HG カ", "hg ガ", "HG ガ", " HG  ガ ", None, "", "MG 卜", "ＨＧ　ガ"]
    names = [("HG ガ", None), ("HG ガ", "ＭＧ ト"), (None, None)]
    left = spark.createDataFrame([(i, k, "x") for i, k in enumerate(kits)], "id int, name string, __form2 string")
    right = spark.createDataFrame(names, "nameJa string, nameKo string")
    texts = {t for n in names for t in n if t is not None}
    want = [i for i, k in enumerate(kits) if k is not None and k not in texts and look(k) in {look(t) for t in texts}]
    assert sorted(r.id for r in same_look(left, "name", right, "nameJa", "nameKo").collect()) == want
    assert same_look(left, "name", right.limit(0), "nameJa").count() == 0
    assert same_look(left.limit(0), "name", right, "nameJa").count() == 0


def test_forms(spark):
    rows = spark.createDataFrame([("ＨＧ",), ("HG",), ("HG",), (None,)], "t string")
    assert [tuple(r) for r in forms(rows, "t").collect()] == [("HG", 2, 3)]
