import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfspark.functions.looks import id_key, look, look_alike

SAME = [("ＨＧ　１／１４４", "HG 1/144"), ("НG 1⁄144", "HG 1/144"), ("カ​゙", "ガ"), ("卜゙キ", "ドキ"), ("ｶﾞ", "ガ"), ("가", "가"), (" a   b\n", "a b"), ("へ力", "ヘカ"), ("III", "Ⅲ")]
OTHER = [("Hg", "HG"), ("カ", "ガ"), ("ab", "a b"), ("é", "e")]


def test_same_look():
    for a, b in SAME:
        assert look(a) == look(b), (a, b)
    for a, b in OTHER:
        assert look(a) != look(b), (a, b)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aA Ηо​ 　ﾊﾞｶﾞ゙゚゛力卜へ가각1Ⅱ́é\t\n𝐀ー・")), max_size=12))
def test_look_is_stable(s):
    assert look(look(s)) == look(s)
    assert unicodedata.is_normalized("NFC", look(s))


def test_column_agrees_with_function(spark):
    texts = [a for p in SAME + OTHER for a in p] + ["", " ", "abc\n", "​", None, "x" * 100_000, "HG 1/144 ザク"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", look_alike(F.col("t")).alias("l")).collect()
    assert all(r.l == (None if r.t is None else look(r.t)) for r in rows)


def test_id_key(spark):
    ids = ["bh-01_1\n", " BH-01_1", "ｂｈ－０１＿１", "bh​-01_1", "null", "NULL", "", "　", None]
    got = [r[0] for r in spark.createDataFrame([(i,) for i in ids], "i string").select(id_key(F.col("i"))).collect()]
    assert got == ["bh-01_1"] * 4 + [None] * 5
