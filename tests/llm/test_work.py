"""What saves work says the same as what it stands for."""

import random
import re

from words import LEXICON

from shelfspark.llm import names
from shelfspark.llm import queries as Q
from shelfspark.llm.lexicon import Lexicon, loose
from shelfspark.llm.names import GRADES, Parser, located, marked, marks, sound, spells
from test_llm_queries import DATA


def test_mentions_do_not_read_the_feed_again(spark):
    for known in (False, True):
        files = Q.unlinked(spark, DATA, known=known).inputFiles()
        assert any("arrival_row" in f for f in files) and not any("feed" in f for f in files)


def test_patterns_begin_where_they_can():
    r = random.Random(5)
    grades = re.compile("|".join(rf"(?<![a-z0-9가-힣]){re.escape(g)}(?![a-z가-힣])" if g[-1].isascii() else re.escape(g) for g in sorted(GRADES, key=len, reverse=True)), re.I)
    every = sorted({*dict(LEXICON.variants), *LEXICON.talk}, key=lambda x: (-len(x), x))
    affixes = re.compile("|".join(map(loose, every)), re.I)
    parts = [*GRADES, *every, *"hHgGmMsSkKſK [](-)/1003가개セ改", "풀 아머", "Full Armor", "수중 장 비", "re/ 100"]
    for _ in range(5000):
        t = "".join(r.choice(parts) + r.choice(["", " "]) for _ in range(r.randint(0, 6)))
        for p, q in ((grades, Parser(LEXICON)._grades), (affixes, LEXICON.pattern)):
            assert [m.span() for m in p.finditer(t)] == [m.span() for m in q.finditer(t)]
    # one character at each step, not all alternatives
    assert all(p.startswith("(?=[") for p in (Parser()._grades.pattern, LEXICON.pattern.pattern))
    assert Lexicon(talk=("-]^",)).pattern.search("a -]^ b") and Lexicon(talk=("",)).pattern.search("")


def test_sizes_have_a_unit():
    r = random.Random(6)
    parts = ["1", "11.9", " ", "cm", "CM", "Mm", "센티", "밀리", "약", "높이 ", "x", "/", "mm 635"]
    for _ in range(5000):
        t = "".join(r.choice(parts) for _ in range(r.randint(0, 6)))
        assert names._UNIT.search(t) or not names._SIZE.search(t)


def test_spellings_with_one_syllable_missing():
    r = random.Random(7)
    for _ in range(3000):
        key = " ".join(r.choice(["ka", "ga", "kya", "kyya", "bo", "po", "n", "an", "yyu", "t"]) for _ in range(r.randint(0, 7)))
        s = sound(key).split()
        less = [sound(" ".join(s[:i] + s[i + 1 :])) for i in range(len(s))] if len(s) > 3 else []
        assert spells(key) == list(dict.fromkeys([" ".join(s), *less]))


def test_marks(spark, monkeypatch):
    known = [f"시리즈{i}x" for i in range(200)]
    bits = marks(spark.createDataFrame([(x,) for x in known], "p string"), "p")
    assert all(marked(bits, x) for x in known) and sum(marked(bits, f"다른{i}") for i in range(10_000)) < 50
    assert not any(marks(spark.createDataFrame([], "p string"), "p"))
    texts = spark.createDataFrame([("HG 사자비 시리즈7 x",), ("시리즈3x 시리즈4x 가",), ("가나다",)], "n string")
    series = spark.createDataFrame([(x,) for x in known], "s string")
    found = lambda: {x.text: x.in_text and sorted(x.in_text) for x in located(texts, "n", series).collect()}
    want = {"HG 사자비 시리즈7 x": ["시리즈7x"], "시리즈3x 시리즈4x 가": ["시리즈3x", "시리즈4x"], "가나다": None}
    assert found() == want
    monkeypatch.setattr(names, "marks", lambda *_: b"\xff" * (names.MARKS // 8))  # as of a table so large that all bits are set
    assert found() == want
