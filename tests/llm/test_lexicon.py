import random

from shelfspark.llm.lexicon import Lexicon, alike, single
from shelfspark.llm.names import Parser, lexicon_of

VARIANTS = {"야간위장": ("夜間迷彩", "nightcamo"), "설원사양": ("雪原仕様", "snowspec"), "의전용": ("儀礼用", "paradeuse")}
TALK = ["초특가", "오늘출발", "bargain", "박스 양호"]
SYL = "가나다라마바사아자차카타파하고노도로모보소오조초코토포호구누두루무부수우주"
KANA = dict(zip(SYL, "カナダラマバサアザチャカタパハゴノドロモボソオゾチョコトポホグヌドゥルムブスウズ", strict=False))


def tables(spark, n=400):
    r = random.Random(3)
    models = [("".join(r.choice(SYL) for _ in range(2)), "".join(r.choice(SYL) for _ in range(3))) for _ in range(n)]
    pairs, texts = [], []
    for a, b in models:
        for v in [None, *r.sample(list(VARIANTS), 2)]:
            ja = f"HG 1/144 {KANA[a[0]]}{KANA[a[1]]}・{''.join(KANA[x] for x in b)}" + (f" {VARIANTS[v][0]}" if v else "")
            pairs.append((ja, f"HG 1/144 {a} {b}" + (f" {v}" if v else "")))
            price = 10_000 * (1.2 if v else 1)
            for _ in range(3):
                sheet = r.random() < 0.2
                say = [r.choice(TALK)] if r.random() < 0.7 else []
                texts.append((" ".join(["HG", *say, a, b, *([v] if v else []), *(["도색판"] if sheet else [])]), int(price * (1.5 if sheet else 1))))
            if v:
                texts.append((f"HG {a} {b} {v} ({a} {VARIANTS[v][1]})", int(price)))
    return spark.createDataFrame(texts, "text string, price long"), spark.createDataFrame(pairs, "ja string, ko string")


def test_variants_and_talk_are_learnt(spark):
    texts, pairs = tables(spark)
    got = lexicon_of(texts.union(texts.limit(5)), pairs)
    for ko, (ja, latin) in VARIANTS.items():
        assert got.meaning[ko] == got.meaning[ja] == got.meaning[latin] == ja
    assert got.meaning["도색판"] == "도색판"  # not in the catalogue, but prices change with it
    assert set(got.talk) >= {"초특가", "오늘출발", "bargain", "박스양호"}
    assert Parser(got)("[HG] 초특가 가나 다라마 설원 사양").variant == "雪原仕様"


def test_nothing_to_learn(spark):
    texts, pairs = tables(spark, 1)
    none = lexicon_of(texts.limit(0), pairs.limit(0))
    assert none == Lexicon() and none.take("a b") == ("a b", [])


def test_spellings():
    assert alike("사막사양", "사막전사양") and alike("클리어칼라", "클리어컬러") and alike("지휘관용", "지휘관전용기")
    assert not alike("정품", "신품") and not alike("수중장비", "사막사양")
    import re

    assert single({"sale": 90, "특가": 80, "sale특가": 9, "박스양호": 50, "박스": 60, "양호": 20}, re.compile("(?!)")) == {"sale": 90, "특가": 80, "박스양호": 50, "박스": 60, "양호": 20}
