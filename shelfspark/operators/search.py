"""Search over a catalogue: tokens with aliases, tails and generic words, scored in one scan."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import shopnames as N
from ..functions.scalars import stripped

# Words that are one, short forms with what they stand for, closing words that only add to a score, and
# words that don't make a hit by themselves.
GROUPS = (
    ("발바토스", "바르바토스"), ("캠퍼", "켐퍼"), ("르브리스", "루브리스"), ("담드", "댐드"), ("퀀터", "퀀타", "콴타", "쿠안타"),
    ("즈곡그", "즈곡", "즈고크", "즈고쿠"), ("판넬", "펀넬"), ("트란잠", "트랜잠"), ("커멘드", "코만도", "커맨드"), ("아카쓰키", "아카츠키"),
    ("하이뉴", "Hi-ν"), ("뉴", "ν"), ("턴엑스", "턴X", "ターンX"), ("턴에이", "턴A", "∀"), ("지쿠악스", "지크악스", "GQuuuuuuX"),
)
SHORT = {"퍼건": ("퍼스트건담", "RX-78-2", "RX78-2")}
TAILS = (("크로스", "컨트라스트", "컬러"), ("컨트라스트", "컬러"), ("철혈", "코팅"), ("클리어",), ("코팅",), ("무등급",))
GENERIC = ("건담", "한정", "건담베이스", "세트", "컬러", "웨폰", "웨폰즈", "유닛", "파츠")


def norm_text(text: str | None) -> str:
    """Small letters and digits of any script, compatibility forms folded, the turn-A sign spelt out."""
    return "".join(ch for ch in N.nfkc(text).replace("∀", "ターンエー").lower() if ch.isalpha() or ch.isnumeric())


def norm(c: Column) -> Column:
    """``norm_text`` as a column; null is empty. Only text that may change under NFKC goes to Python."""
    plain = F.coalesce(c, F.lit(""))
    stable = plain.rlike(r"^[\x00-\x7f가-힣ァ-ヺー一-鿿ぁ-ゖ]*\z")
    folded = F.coalesce(F.when(stable, plain), N.nfkc_column(F.when(~stable, plain)))
    return F.regexp_replace(F.lower(F.replace(folded, F.lit("∀"), F.lit("ターンエー"))), r"[^\p{L}\p{N}]+", "")


@dataclass(frozen=True)
class Aliases:
    groups: Sequence[Sequence[str]] = GROUPS
    short: dict[str, Sequence[str]] | None = None
    tails: Sequence[Sequence[str]] = TAILS
    generic: Sequence[str] = GENERIC

    def alternatives(self, token: str) -> list[str]:
        """A token's spellings, itself first."""
        out = [token]
        for g in self.groups:
            words = [norm_text(w) for w in g]
            out += words if token in words else []
        for k, words in (SHORT if self.short is None else self.short).items():
            out += map(norm_text, words) if norm_text(k) == token else []
        return list(dict.fromkeys(out))

    def is_generic(self, token: str) -> bool:
        return token in {norm_text(w) for w in self.generic}

    def without_tails(self, tokens: list[str]) -> tuple[list[str], list[tuple[str, list[str]]]]:
        """The tokens that must be hit, and the tails among them: joined, and their words of two letters or more that aren't
        generic. The longest tail wins; a query of tails alone is searched as it is."""
        known = sorted(([norm_text(w) for w in t] for t in self.tails), key=len, reverse=True)
        core, found, i = [], [], 0
        while i < len(tokens):
            hit = next((t for t in known if tokens[i : i + len(t)] == t), None)
            if hit:
                found.append(("".join(hit), [w for w in hit if len(w) > 1 and not self.is_generic(w)]))
            else:
                core.append(tokens[i])
            i += len(hit or "x")
        return (core, found) if core else (tokens, [])


def index(items: DataFrame, *keep: str) -> DataFrame:
    """The search fields of items (id, grade, scale, nameKo, nameKoAi, nameKoJoy, nameJa, series, seriesKo): kn, jn, ka, sn, al."""
    name = lambda c: norm(stripped(F.col(c), F.col("grade"), F.col("scale"), loose=True))
    out = items.withColumns({"kn": name("nameKo"), "jn": name("nameJa"), "k1": name("nameKoAi"), "k2": name("nameKoJoy")})
    others = F.array_distinct(F.filter(F.array("k1", "k2"), lambda x: (x != "") & (x != F.col("kn"))))
    out = out.withColumns({"ka": F.concat_ws("|", others), "sn": F.concat(norm(F.col("seriesKo")), norm(F.col("series")))})
    al = F.concat_ws("|", norm(F.col("nameKo")), norm(F.col("nameJa")), "ka", "sn", F.concat_ws("|", norm(F.col("grade")), norm(F.col("scale"))))
    return out.select("id", "grade", "scale", *keep, "kn", "jn", "ka", "sn", al.alias("al"))


def _any(parts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts, F.lit(False))


def scored(query: str, aliases: Aliases | None, *, grade: str | None = None, scale: str | None = None, picture: Column | None = None) -> Column | None:
    """struct(score, strict) of an indexed row, null where the query doesn't find it; None for a query without a token.

    3 for a token in a name, 2 in another name, 1 in the series or anything else; 100, 40 or 20 if a name is the query, begins with
    it or holds it; 75 or 65 for a tail; less a twentieth of the compared name's length up to 60; half a point for a picture, 2 for
    the asked scale. A row needs a hit that isn't generic, unless the query is, and half of two tokens or more.
    """
    raw = [t for t in map(norm_text, query.split()) if t]
    if not raw:
        return None
    tokens, tails = aliases.without_tails(raw) if aliases else (raw, [])
    spelt = [aliases.alternatives(t) if aliases else [t] for t in tokens]
    real = [not (aliases and aliases.is_generic(t)) for t in tokens]
    within = lambda c, words: _any([F.col(c).contains(w) for w in words])
    points, hits, distinct = F.lit(0.0), F.lit(0), F.lit(0)
    for words, counts in zip(spelt, real, strict=True):
        tier = F.when(within("kn", words) | within("jn", words), 3).when(within("ka", words), 2).when(within("sn", words), 1).when(within("al", words), -1).otherwise(0)
        points, hits = points + F.abs(tier), hits + (tier != 0).cast("int")
        distinct = distinct + ((tier > 0).cast("int") if counts else F.lit(0))
    whole = spelt[0] if len(tokens) == 1 else ["".join(tokens)]
    test = lambda f: _any([f(F.col(c), w) for c in ("kn", "jn") for w in whole])
    bonus = F.when(test(lambda c, w: c == w), 100).when(test(lambda c, w: c.startswith(w)), 40).when(test(lambda c, w: c.contains(w)), 20).otherwise(0)
    for joined, words in tails:
        every = F.col("kn").contains(joined) | F.col("jn").contains(joined) | F.col("al").contains(joined)
        bonus = bonus + F.when(every, 75).when(_any([F.col(c).contains(w) for c in ("kn", "jn") for w in words]), 65).otherwise(0)
    compared = F.when(_any([F.col("kn").contains(w) for w in whole]), F.col("kn")).otherwise(F.col("jn"))
    score = points + bonus - F.least(F.length(compared), F.lit(60)) * 0.05
    if picture is not None:
        score = score + F.when(picture, 0.5).otherwise(0.0)
    if scale:
        score = score + F.when(F.col("scale") == scale, 2).otherwise(0)
    strict = hits == len(tokens)
    ok = (hits > 0) & (strict | (F.lit(len(tokens) >= 2) & (hits >= -(-len(tokens) // 2))))
    if aliases and any(real):
        ok = ok & (distinct > 0)
    if grade:
        ok = ok & (F.col("grade") == grade)
    return F.when(ok, F.struct(F.round(score, 4).alias("score"), strict.alias("strict")))


def search(rows: DataFrame, queries: Sequence[dict], *, newest: Column, picture: Column | None = None, aliases: Aliases | None = Aliases(), most: int = 30) -> DataFrame:
    """(query, rank, id, score, partial): the ``most`` best rows of each query over ``index`` rows, by score, then the newest, then id.

    ``queries``: q, and grade or scale if asked for. All queries share one scan; each partition sends ``most`` rows a query
    and class. Rows with every token win outright; ``partial`` says that there were none. A query without a token finds nothing.
    """
    each = []
    for q in queries:
        found = scored(q["q"], aliases, grade=q.get("grade"), scale=q.get("scale"), picture=picture)
        if found is not None:
            each.append(F.when(found.isNotNull(), F.struct(F.lit(q["q"]).alias("query"), found.getField("score").alias("score"), found.getField("strict").alias("strict"))))
    hits = rows.select("id", newest.alias("newest"), F.explode(F.array_compact(F.array(*each))).alias("x")).select("id", "newest", "x.*")
    order = [F.desc("score"), F.desc("newest"), F.asc("id")]
    top = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query", "strict").orderBy(*order))).filter(F.col("rank") <= most)
    best = top.withColumn("any", F.max("strict").over(Window.partitionBy("query"))).filter(F.col("strict") == F.col("any"))
    return best.select("query", "rank", "id", "score", (~F.col("any")).alias("partial"))


def totals(rows: DataFrame, queries: Sequence[dict], *, aliases: Aliases | None = Aliases()) -> DataFrame:
    """(query, total): how many rows each query finds, of the class that ``search`` shows; counted in partitions first."""
    each = []
    for q in queries:
        found = scored(q["q"], aliases, grade=q.get("grade"), scale=q.get("scale"))
        if found is not None:
            each.append(F.when(found.isNotNull(), F.struct(F.lit(q["q"]).alias("query"), found.getField("strict").alias("strict"))))
    hits = rows.select(F.explode(F.array_compact(F.array(*each))).alias("x")).groupBy("x.query", "x.strict").agg(F.count("*").alias("n"))
    return hits.groupBy("query").agg(F.max_by("n", "strict").alias("total"))
