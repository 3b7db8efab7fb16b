"""A lexicon for tests, as one would be learnt."""

from shelfspark.llm.lexicon import Lexicon

SPELT = {
    "full": ("フルアーマー", "풀아머", "fullarmor", "fa"), "desert": ("砂漠戦仕様", "사막전사양", "사막사양", "desertspec"), "marine": ("水中装備", "수중장비", "marinepack"),
}
LEXICON = Lexicon(tuple((x, v) for v, xs in SPELT.items() for x in xs), ("무료배송", "당일발송", "정품", "sale", "예약", "재입고"))
