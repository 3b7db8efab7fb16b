from words import LEXICON

from shelfspark.llm.names import Parser, located, sound, spells, syllables

P = Parser(LEXICON)


def test_one_spelling():
    for a, b in (("ソンザゲン", "손자겐"), ("ツトケキゼ", "츠토케키제"), ("ザクポペラ", "자쿠포페라"), ("シフ", "시후"), ("ティジ", "티지")):
        assert syllables(a) == syllables(b)
    assert syllables("tsuransopepe") == syllables("츠란소페페")
    assert sound("go to ba") == sound("ko do pa") and sound("ka ka mi") == "ka mi"
    assert "ka mi ro" in spells("ka mi te ro") and spells("ka mi") == ["ka mi"]


def test_parts():
    n = P("[HG71] 1/144 KX-0078M 기노코 케카 수중 장 비(GINOKO KEKA MARINE PACK) - 굉뢰도시 손자겐(프라모델)", ("굉뢰도시손자겐",))
    assert (n.key, n.latin, n.grade, n.scale, n.code, n.variant, n.series) == ("ki no ko ke ka", "ginokokeka", "HG", "144", "KX78M", "marine", "굉뢰도시손자겐") or n.key == "gi no ko ke ka"
    n = P("★당일발송★ 마스터 그레이드 1:100 데네네 후야 2호 rt 0376 약 11.9cm 두 개 묶음 SALE")
    assert (n.key, n.grade, n.scale, n.variant, n.code, n.contents, n.size) == ("de ne ne fu ya", "MG", "100", "no2", "RT376", "x2", "119")
    assert P("MG 1/100 シテリン・ザテ Ver.2 専用水転写デカール").contents == "decal"
    assert (P("HG 나노반칸모개").variant, P("HG 나노반칸모개").either) == ("kai", "na no ban kan mo ge")
    assert P("HG 나노반칸모 개 (재입고)").variant == "kai"
    assert P("RG RE-897L 쿠지니반히").code == "RE897L"
    assert P("").key == "" and P("★★").key == ""


def test_what_no_rule_reads_tells_apart():
    zaku = [P(x).variant for x in ("MG 1/100 사자비", "MG 1/100 사자비 Ver.Ka", "MG 1/100 사자비 2.0", "MG 1/100 사자비 Ver.2.0", "MG 사자비 Ver.2")]
    assert zaku == ["", "verka", "ver2", "ver2", "ver2"]
    assert P("HGUC 1/144 사자비").grade == "HG" and P("HG 사자비 alpha").variant == "~alpha"
    assert P("HG Sonza Genpi 1/144").key == "so n za ge npi" or P("HG Sonza Genpi 1/144").latin == "sonzagenpi"
    assert P("HG 1 / 144 mm 635 사자비").code == "MM635"


def test_series_by_words(spark):
    names = spark.createDataFrame([("HG 사자비 굉뢰 도시 손자겐",), ("HG 굉뢰도시", ), (None,)], "n string")
    series = spark.createDataFrame([("굉뢰도시 손자겐",), (None,), ("x",)], "s string")
    assert {r.text: r.in_text for r in located(names, "n", series).collect()} == {"HG 사자비 굉뢰 도시 손자겐": ["굉뢰도시손자겐"], "HG 굉뢰도시": None}
    assert located(names, "n", None).count() == 2
