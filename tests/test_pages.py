"""Page readers and imports: parts that lack, broken markup, odd files."""

import pytest
from pyspark.sql import functions as F

from shelfspark.sources import pages as P
from shelfspark.sources import readers


def test_cards_and_pager():
    html = """<a class="p-card" href="/item/01_12/"><p class="p-card__tit">HG&nbsp; a
     b</p><p class="p-card__price">2,200円</p><p class="p-card_date">2026年10月7日</p><i class="p-card__tag -gbase"></i></a><a class="p-card" href="/x"><b class="p-card__tit">y</b></a>
     <a class="p-card" href="https://x/item/item-9?q"><b class="p-card__tit">z<br>q</b></a><a class="p-card" href="/item/01_12/"><i class="p-card__tit">again</i></a>
     <a class="p-card" href="/item/01_13/"></a><a class="c-archives__pagination-list-item-link" href="?p=4">4</a>"""
    rows = [("bh-01_12", "HG a b", 2200, "gbase", "2026-10", "2026-10-07"), ("pb-item-9", "z q", None, "online", None, None)]
    assert P.listing(html) == (rows, 4) and P.listing(html, 3)[1] == 3 and P.listing("") == ([], 1)
    assert P.release_of("2026年13月") == (None, None) and P.release_of("2026年3月") == ("2026-03", None) and P.price_of("円") is None


def test_detail():
    assert P.detail("<p>") == (None, None, None, None, [], None, None, [])
    html = "<h1 class='p-heading__h1-product'>N</h1><dl class='pg-products__detail'><dt>価格</dt><dd>1,100円</dd><dt>x</dt></dl><a class='p-card__flat' href='/brand/hg/'>x</a><a class='p-card__flat' href='/brand/hg'>x</a><a class='p-card__flat' href='/series/s1/'>S</a>"
    assert P.detail(html) == ("N", 1100, None, None, ["hg"], "s1", "S", [])


def test_board_and_post():
    rows = "<table><tr><td>[c] <a href='board_view.asp?x=1&B_iID=7'>t <b>1</b></a></td><td>2026-01-02</td></tr><tr><td><a href='board_view.asp?B_iID=8&Notice=True'>p</a></td></tr></table><a href='board_view.asp?B_iID=9'>no row</a>"
    assert P.board(rows) == [("7", "2026-01-02", "t 1", "[c]")]
    text = "<table><tr><td class='Board_View_top'>T</td></tr><tr><td>재입고<script>BD9999999</script><br>BD0000001<br>n1<br>1,000원<br>BD0000002<br>BD0000003<br>n3<br>BD0000001<br>again<br>KB1234<br>BD0000004<br>500원<br>BD0000005"
    assert P.post(text) == ("T", "T 재입고", True, [("BD0000001", "n1", 1000), ("BD0000003", "n3", None)])
    assert P.post("") == (None, "", False, [])


def test_mall():
    one = "<li data-childno='1' class='{}'><a class='thumb' href='?gno=5'></a><h5>n</h5><p class='price'><b class='num'>1,200</b></p></li>"
    assert P.mall(one.format("sold_out")) == ([("5", "n", None, 1200, True, None)], 1, True)
    assert P.mall(one.format("x") + "<li data-childno='2'></li>" * 2 + "pageLink('3')")[1:] == (3, False) and P.mall("") == ([], 1, False)


def test_as_columns(spark):
    df = spark.createDataFrame([("<p>",), (None,)], "h string")
    assert [r[0] for r in df.select(P.reader(P.detail, P.DETAIL)("h").alias("x")).select("x.brandKeys").collect()] == [[], None]
    assert [r[0] for r in df.select(P.reader(P.board, f"array<struct<{P.BOARD}>>")("h")).collect()] == [[], None]
    assert P.listing("<div>" * 5000 + "<a class='p-card' href='/item/01_1'><b class='p-card__tit'>deep")[0][0][1] == "deep"


ALIASES = {"name": ["kit name"], "price": ["cost"], "tags": []}


def lines(spark, tmp_path, text):
    f = tmp_path / "x.csv"
    f.write_text(text)
    return [tuple(r) for r in readers.delimited(spark, str(f), ALIASES, "name").collect()]


def test_delimited(spark, tmp_path):
    odd = 'my list,,\n\nPrice of it,"Kit, no",NAME\n3,x,"a ""b"", c"\nPrice of it,x,NAME\n,,\n5,,\n'
    assert lines(spark, tmp_path, odd) == [("3", 'a "b", c'), ("Price of it", "NAME")]  # price, name; a row like the header stays
    assert lines(spark, tmp_path, "name,price\na,1\n") == [("a", "1")]
    assert lines(spark, tmp_path, "a,1\nb,2\n") == [("a", "1", ""), ("b", "2", "")]
    assert lines(spark, tmp_path, "name\tprice\na,b\t1\n") == [("a,b", "1")]
    assert lines(spark, tmp_path, 'name,price\n"two\nlines",1\n') == [("two\nlines", "1")]


def test_json_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text('[\n {"id": 1,\n  "v": "x"},\n {"id": 2, "v": "y"}\n]\n')
    (tmp_path / "b.json").write_text('{"id": 2,\n "v": "z"}\n')
    (tmp_path / "c.json").write_text('{"id": 2,\n "v": \n')
    at = lambda *n: [str(tmp_path / x) for x in n]
    assert {r.id: r.v for r in readers.json_documents(spark, at("a.json", "none.json", "b.json"), "id int, v string", key="id").collect()} == {1: "x", 2: "z"}
    assert readers.json_documents(spark, at("none.json"), "id int, v string").count() == 0
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        readers.json_documents(spark, at("c.json"), "id int, v string").collect()


def test_legacy_kits(spark):
    rows = ['[{"id": "a", "name": "x", "photo": "data:image/png;base64,YWI="}, {"id": "b", "name": " "}]', '{"kits": [{"id": "c", "name": "y", "photo": "http://x"}]}', "<html><script type='x' id='kit-data'> [{\"id\": \"d\", \"name\": \"z\"}] </script>", "nothing", None]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in rows], "t string").select(readers.legacy_kits(F.col("t"))).collect()]
    assert [g and [(k.id, k.name, k.photo) for k in g] for g in got] == [[("a", "x", "data:image/png;base64,YWI=")], [("c", "y", None)], [("d", "z", None)], None, None]
