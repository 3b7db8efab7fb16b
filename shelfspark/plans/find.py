"""Queries of search, names and classification, over the catalogue, arrivals, mall goods and kits."""

from __future__ import annotations

import unicodedata

from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import scalars as S
from ..functions import shopnames as N
from ..operators import search as X
from .oracles import LOOK_ALIKE, quoted
from .run import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _compatible() -> tuple[str, str, list[tuple[str, str]]]:
    """Characters with the single one that they are under NFKC, by the rule, and the few that become several."""
    one, more = {}, []
    for k in [*range(0xA0, 0x180), *range(0x2000, 0x2070), *range(0x2150, 0x2190), *range(0x3000, 0x3001), *range(0xFF01, 0xFFEF), *range(0x1D400, 0x1D800)]:
        ch = chr(k)
        form = unicodedata.normalize("NFKC", ch)
        if form != ch and len(form) == 1:
            one[ch] = form
        elif form != ch and 0x2160 <= k < 0x2180:
            more.append((ch, form))
    return "".join(one), "".join(one.values()), more


_FROM, _TO, _MORE = _compatible()


def nfkc_sql(c: str) -> str:
    x = c
    for a, b in _MORE:
        x = f"replace({x}, '{a}', '{b}')"
    return f"nfc_normalize(translate({x}, {quoted(_FROM)}, {quoted(_TO)}))"


def norm_sql(c: str) -> str:
    return f"regexp_replace(lower(replace({nfkc_sql(f'''coalesce({c}, '')''')}, '∀', 'ターンエー')), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"


def _trim_sql(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '^[\\s\\p{{Z}}]+', ''), '[\\s\\p{{Z}}]+$', '')"


_WIDE = quoted("".join(chr(k) for k in range(0xFF01, 0xFF5F)))
_NARROW = quoted("".join(chr(k - 0xFEE0) for k in range(0xFF01, 0xFF5F)))
_TAKE = "regexp_matches(substr({s}, length({w}) + 1) || ' ', '^[\\s\\p{{Z}}]')"


def stripped_ctes(source: str, column: str, out: str, loose: bool = True) -> str:
    """CTEs that end in ``out`` (id, s): ``column`` without its grade and scale."""
    a = f"""{out}1 AS (SELECT id, grade, scale, {_trim_sql(f"coalesce({column}, '')")} AS s FROM {source}),
 {out}2 AS (SELECT id, grade, scale, CASE WHEN grade <> '' AND lower(translate(substr(s, 1, length(grade)), {_WIDE}, {_NARROW})) = lower(grade) AND {_TAKE.format(s="s", w="grade")}
  THEN {_trim_sql("substr(s, length(grade) + 1)")} ELSE s END AS s FROM {out}1), """
    if loose:
        a += f"""{out}3 AS (SELECT id, grade, scale, CASE WHEN regexp_replace(coalesce(grade, ''), '[^A-Za-z]', '', 'g') <> '' AND regexp_matches(s, '(?i)^' || regexp_replace(coalesce(grade, ''), '[^A-Za-z]', '', 'g') || '[A-Za-z]{{1,4}}(:[A-Za-z])?[\\s\\p{{Z}}]')
  THEN {_trim_sql("regexp_replace(s, '^[A-Za-z]+(:[A-Za-z])?', '')")} ELSE s END AS s FROM {out}2), """
    else:
        a += f"{out}3 AS (SELECT * FROM {out}2), "
    return a + f"""{out} AS (SELECT id, CASE WHEN scale <> '' AND starts_with(s, scale) AND {_TAKE.format(s="s", w="scale")} THEN {_trim_sql("substr(s, length(scale) + 1)")} ELSE s END AS s FROM {out}3)"""


_COLUMNS = ("grade", "scale", "nameKo", "nameKoAi", "nameKoJoy", "nameJa", "series", "seriesKo")
_ITEMS = "SELECT id, " + ", ".join(f"max({c}) AS {c}" for c in _COLUMNS) + ", max(release.date) AS day, max(release.month) AS month, max(len(images)) > 0 AS picture FROM catalog_gunpla GROUP BY id"


def items(spark, d):  # noqa: ANN001, ANN201
    """One row an id, of each column the greatest value."""
    most = [F.max(c).alias(c) for c in _COLUMNS]
    return table(spark, d, "catalog_gunpla").groupBy("id").agg(*most, F.max("release.date").alias("day"), F.max("release.month").alias("month"), (F.max(F.size("images")) > 0).alias("picture"))


# The queries: names whole and in part, a grade and a scale asked for, aliases, tails, generic words, words that nothing has.
ALIASES = X.Aliases(groups=(*X.GROUPS, ("풀아머", "フルアーマー")), tails=(*X.TAILS, ("클리어", "컬러")), generic=(*X.GENERIC, "사양", "타입"))
ASKED = (
    {"q": "모히 모베카"}, {"q": "HG 모히"}, {"q": "ＨＧ　모히 베카", "scale": "1/144"}, {"q": "풀아머 베카"}, {"q": "모베카 클리어 컬러"}, {"q": "클리어 컬러"}, {"q": "사양 없는말"},
    {"q": "사양 타입", "grade": "MG"}, {"q": "단비와 즈야 없는말"}, {"q": "굉뢰도시"}, {"q": "…"}, {"q": "モヒモベカ"},
)


def _search_sql() -> str:
    """The same queries, token by token, with the words that stand for each given by hand."""
    spec = {
        "모히 모베카": ([(["모히"], 1), (["모베카"], 1)], []), "HG 모히": ([(["hg"], 1), (["모히"], 1)], []), "ＨＧ　모히 베카": ([(["hg"], 1), (["모히"], 1), (["베카"], 1)], []),
        "풀아머 베카": ([(["풀아머", "フルアーマー"], 1), (["베카"], 1)], []), "모베카 클리어 컬러": ([(["모베카"], 1)], [("클리어컬러", ["클리어"])]),
        "클리어 컬러": ([(["클리어"], 1), (["컬러"], 0)], []), "사양 없는말": ([(["사양"], 0), (["없는말"], 1)], []), "사양 타입": ([(["사양"], 0), (["타입"], 0)], []),
        "단비와 즈야 없는말": ([(["단비와"], 1), (["즈야"], 1), (["없는말"], 1)], []), "굉뢰도시": ([(["굉뢰도시"], 1)], []), "モヒモベカ": ([(["モヒモベカ"], 1)], []),
    }
    some = lambda c, ws: "(" + " OR ".join(f"contains({c}, '{w}')" for w in ws) + ")"
    parts = []
    for asked in ASKED:
        if asked["q"] not in spec:
            continue
        tokens, tails = spec[asked["q"]]
        tiers = [f"CASE WHEN {some('kn', w)} OR {some('jn', w)} THEN 3 WHEN {some('ka', w)} THEN 2 WHEN {some('sn', w)} THEN 1 WHEN {some('al', w)} THEN -1 ELSE 0 END" for w, _ in tokens]
        whole = tokens[0][0] if len(tokens) == 1 else ["".join(w[0] for w, _ in tokens)]
        names = [f"({{}}('{w}', {c}))" for w in whole for c in ("kn", "jn")]
        has = lambda f: " OR ".join(f.format(w=w, c=c) for w in whole for c in ("kn", "jn"))
        bonus = f"CASE WHEN {has('{c} = ' + chr(39) + '{w}' + chr(39))} THEN 100 WHEN {has('starts_with({c}, ' + chr(39) + '{w}' + chr(39) + ')')} THEN 40 WHEN {has('contains({c}, ' + chr(39) + '{w}' + chr(39) + ')')} THEN 20 ELSE 0 END"
        for joined, words in tails:
            bonus += f" + CASE WHEN {some('kn', [joined])} OR {some('jn', [joined])} OR {some('al', [joined])} THEN 75 WHEN {some('kn', words)} OR {some('jn', words)} THEN 65 ELSE 0 END"
        del names
        need = any(r for _, r in tokens)
        distinct = " + ".join(f"(t[{i + 1}] > 0)::INT" for i, (_, r) in enumerate(tokens) if r) or "0"
        parts.append(f"""SELECT '{asked["q"]}' AS query, id, newest, round(list_sum(list_transform(t, lambda x: abs(x))) + {bonus} - 0.05 * least(length(CASE WHEN {" OR ".join(f"contains(kn, '{w}')" for w in whole)} THEN kn ELSE jn END), 60)
   + CASE WHEN picture THEN 0.5 ELSE 0 END {f"+ CASE WHEN scale = '{asked['scale']}' THEN 2 ELSE 0 END" if "scale" in asked else ""}, 4) AS score, len(list_filter(t, lambda x: x <> 0)) AS hits, {len(tokens)} AS n
  FROM (SELECT *, [{", ".join(tiers)}] AS t FROM f) WHERE len(list_filter(t, lambda x: x <> 0)) > 0 {f"AND {distinct} > 0" if need else ""} {f"AND grade = '{asked['grade']}'" if "grade" in asked else ""}""")
    names = ", ".join(stripped_ctes("i", c, o) for c, o in (("nameKo", "ko"), ("nameJa", "ja"), ("nameKoAi", "ai"), ("nameKoJoy", "joy")))
    n = norm_sql
    return f"""WITH i AS ({_ITEMS}), {names},
 m AS (SELECT i.*, {n("ko.s")} AS kn, {n("ja.s")} AS jn, {n("ai.s")} AS k1, {n("joy.s")} AS k2 FROM i JOIN ko USING (id) JOIN ja USING (id) JOIN ai USING (id) JOIN joy USING (id)),
 o AS (SELECT *, concat_ws('|', CASE WHEN k1 <> '' AND k1 <> kn THEN k1 END, CASE WHEN k2 <> '' AND k2 <> kn AND k2 <> k1 THEN k2 END) AS ka, {n("seriesKo")} || {n("series")} AS sn FROM m),
 f AS (SELECT *, coalesce(day, month, '') AS newest, concat_ws('|', {n("nameKo")}, {n("nameJa")}, ka, sn, {n("grade")} || '|' || {n("scale")}) AS al FROM o),
 r AS ({" UNION ALL ".join(parts)}), k AS (SELECT *, hits = n AS strict FROM r WHERE hits = n OR (n >= 2 AND hits >= ceil(n / 2.0))),
 b AS (SELECT *, max(strict) OVER (PARTITION BY query) AS best FROM k) """


_HITS = _search_sql()


@query(_HITS + """SELECT query, CAST(rank AS INTEGER) AS rank, id, score::DOUBLE AS score, NOT best AS partial FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, newest DESC, id) AS rank FROM b WHERE strict = best) WHERE rank <= 30""")
def catalog_search(spark, d):
    """Search as surveyed: names, other names, series, aliases, tails, generic words, picture and scale; the 30 best."""
    rows = X.index(items(spark, d), "day", "month", "picture")
    return X.search(rows, ASKED, newest=F.coalesce("day", "month", F.lit("")), picture=F.col("picture"), aliases=ALIASES)


@query(_HITS + "SELECT query, count(*) AS total FROM b WHERE strict = best GROUP BY query")
def catalog_search_totals(spark, d):
    """How many items each query finds, before the limit."""
    return X.totals(X.index(items(spark, d)), ASKED, aliases=ALIASES)


@query(f"WITH i AS ({_ITEMS}), {stripped_ctes('i', 'coalesce(nullif(nameKo, %s), nameJa)' % quoted(''), 'x', False)} SELECT i.id AS id, coalesce(nullif(x.s, ''), nameKo, nameJa, '') AS title, {norm_sql('x.s')} AS form FROM i JOIN x USING (id)")
def display_names(spark, d):
    """Names as shown: without grade and scale, or whole where nothing would stay; and in search form."""
    i = items(spark, d)
    base = F.coalesce(F.nullif("nameKo", F.lit("")), "nameJa")
    short = S.stripped(base, F.col("grade"), F.col("scale"))
    return i.select("id", F.coalesce(F.nullif(short, F.lit("")), "nameKo", "nameJa", F.lit("")).alias("title"), X.norm(short).alias("form"))



# --- classification ------------------------------------------------------------------------------------------------

_BRANDS = ", ".join(f"('{k}', {quoted(a) if a else 'NULL'}, {quoted(b) if b else 'NULL'})" for k, (a, b) in C.BRANDS.items())


@query(f"""WITH dim(k, line, grade) AS (VALUES {_BRANDS}), v AS (SELECT DISTINCT id, brandKeys FROM catalog_gunpla), e AS (SELECT id, brandKeys, unnest(brandKeys) AS k, generate_subscripts(brandKeys, 1) AS i FROM v),
 j AS (SELECT e.*, dim.k IS NOT NULL AS known, line, grade FROM e LEFT JOIN dim ON lower(e.k) = dim.k), l AS (SELECT id, brandKeys, CASE WHEN bool_or(line = 'girl') THEN 'girl' WHEN bool_or(line = 'gunpla') THEN 'gunpla' END AS line,
 list(k ORDER BY i) FILTER (WHERE NOT known) AS unknown FROM j GROUP BY ALL)
 SELECT v.id AS id, array_to_string(v.brandKeys, ',') AS keys, l.line AS line, (SELECT arg_min(j.grade, j.i) FROM j WHERE j.id = v.id AND j.brandKeys = v.brandKeys AND j.line = l.line AND j.grade IS NOT NULL) AS grade, array_to_string(coalesce(l.unknown, []), ',') AS unknown FROM v LEFT JOIN l ON v.id = l.id AND v.brandKeys = l.brandKeys""")
def brand_votes(spark, d):
    """Line and grade by the brand keys, and the keys that aren't known."""
    v = table(spark, d, "catalog_gunpla").select("id", "brandKeys").distinct().withColumn("x", C.by_brand(F.col("brandKeys")))
    return v.select("id", F.concat_ws(",", "brandKeys").alias("keys"), "x.line", "x.grade", F.concat_ws(",", "x.unknown").alias("unknown"))


def _ladder_sql(c: str, rules: list[tuple[str, str | None]]) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({c}, '{p}') THEN {quoted(v) if v else 'NULL'}" for p, v in rules) + " END"


@query(f"""WITH t AS (SELECT DISTINCT nameJa, upper(trim({nfkc_sql("nameJa")})) AS t FROM catalog_gunpla WHERE nameJa IS NOT NULL)
 SELECT nameJa AS title, {_ladder_sql("t", [(p, a) for p, a, _ in C.TITLES])} AS line, {_ladder_sql("t", [(p, b) for p, _, b in C.TITLES])} AS grade FROM t""")
def title_classes(spark, d):
    """Line and grade by the beginning of a title."""
    t = table(spark, d, "catalog_gunpla").select("nameJa").dropna().distinct().withColumn("x", C.by_title(N.nfkc_column("nameJa")))
    return t.select(F.col("nameJa").alias("title"), "x.line", "x.grade")


@query(f"""WITH t AS (SELECT DISTINCT name, upper(regexp_extract(trim(regexp_extract({nfkc_sql("name")}, '^\\s*\\[([^\\]]*)\\]', 1)), '^([0-9]*[A-Za-z가-힣]+)', 1)) AS c FROM arrival_row WHERE name IS NOT NULL)
 SELECT name, CASE WHEN c <> '' THEN {_ladder_sql("c", list(C.BRACKETS))} END AS grade FROM t""")
def bracket_grades(spark, d):
    """Grades by the leading bracket of arrivals."""
    t = table(spark, d, "arrival_row").select("name").dropna().distinct()
    return t.select("name", C.by_bracket(N.nfkc_column("name")).alias("grade"))


_GRADE_SQL = "coalesce(" + ", ".join("CASE " + " ".join(f"WHEN contains({c}, '{w}') THEN '{g}' END" if i == len(C.WRITTEN) - 1 else f"WHEN contains({c}, '{w}') THEN '{g}'" for i, (w, g) in enumerate(C.WRITTEN)) for c in ("g", "n")) + ", '기타')"


@query(f"""WITH k AS (SELECT DISTINCT id, name, grade, scale, status, date, upper(regexp_replace(coalesce(grade, ''), '\\s', '', 'g')) AS g, upper(coalesce(name, '')) AS n, regexp_replace(coalesce(scale, ''), '\\s', '', 'g') AS s FROM kit),
 r AS (SELECT *, {_GRADE_SQL} AS grade2 FROM k)
 SELECT id, name, grade2 AS grade, CASE WHEN regexp_extract(s, '1/(\\d+)', 1) <> '' THEN '1/' || regexp_extract(s, '1/(\\d+)', 1) WHEN regexp_matches(s, '(?i)논|non|없') THEN '논스케일'
  WHEN grade2 IN ('HG', 'RG', 'EG') THEN '1/144' WHEN grade2 IN ('MG', 'RE/100', 'FM', 'MGEX') THEN '1/100' WHEN grade2 = 'PG' THEN '1/60' ELSE '논스케일' END AS scale FROM r""")
def import_normalised(spark, d):
    """What users write as grade and scale, in the collection's values."""
    k = table(spark, d, "kit").select("id", "name", "grade", "scale", "status", "date").distinct().withColumn("g", C.written_grade(F.col("grade"), F.col("name")))
    return k.select("id", "name", F.col("g").alias("grade"), C.written_scale(F.col("scale"), F.col("g")).alias("scale"))


_SAID = ("'먹선 작업'", "'조 립 중'", "'가조립 완료'", "'완성'", "'가조립중'", "'?'", "NULL")


@query(f"""WITH w AS (SELECT o_orderkey, [{", ".join(_SAID)}][1 + o_orderkey % 7] AS s, CAST(o_orderdate AS DATE) AS d, o_orderkey % 5 AS k FROM orders),
 t AS (SELECT *, CASE k WHEN 0 THEN strftime(d, '%Y년 %-m월 %-d일') WHEN 1 THEN strftime(d, '%-m/%-d/%y') WHEN 2 THEN CAST(d - DATE '1899-12-30' AS VARCHAR) WHEN 3 THEN strftime(d, '%Y.%m.%d') ELSE 'soon' END AS said FROM w)
 SELECT o_orderkey, CASE WHEN s IN ('먹선 작업') THEN 'custom' WHEN s IN ('조 립 중', '가조립중') THEN 'building' WHEN s IN ('가조립 완료', '완성') THEN 'built' ELSE 'unbuilt' END AS status,
 CASE WHEN k = 1 AND year(d) < 2000 THEN CAST(d + INTERVAL 100 YEAR AS DATE)::VARCHAR WHEN k < 4 THEN CAST(d AS VARCHAR) END AS date FROM t""")
def import_dates(spark, d):
    """Statuses and dates in the ways users write them; a year of two digits is of this century."""
    o = table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"), (F.col("o_orderkey") % 5).alias("k"))
    said = F.when(F.col("k") == 0, F.date_format("d", "yyyy년 M월 d일")).when(F.col("k") == 1, F.date_format("d", "M/d/yy"))
    said = said.when(F.col("k") == 2, F.date_diff("d", F.lit("1899-12-30").cast("date")).cast("string")).when(F.col("k") == 3, F.date_format("d", "yyyy.MM.dd")).otherwise("soon")
    status = F.get(F.array(*(F.expr(x) for x in _SAID)), (F.col("o_orderkey") % 7).cast("int"))
    return o.select("o_orderkey", C.written_status(status).alias("status"), S.flexible_date(said).cast("string").alias("date"))


@query(r"""WITH k AS (SELECT DISTINCT id, coalesce(nullif(grade, ''), '기타') AS grade, regexp_replace(regexp_replace(lower(coalesce(name, '')), '^\s*(?:hguc|hgce|hg|rg|mgex|mgsd|mg|pg|eg|sd|re/?100|fm|30mm)\b', ''), '[\s\-_·.,()\[\]''"]', '', 'g') AS form FROM kit)
 SELECT form, grade, count(DISTINCT id) AS kits, min(id) AS first_id FROM k WHERE form <> '' GROUP BY form, grade HAVING count(DISTINCT id) > 1""")
def duplicate_kits(spark, d):
    """Kits of one name and grade, whatever way the name is typed."""
    k = table(spark, d, "kit").select("id", F.coalesce(F.nullif("grade", F.lit("")), F.lit(C.NO_GRADE)).alias("grade"), C.duplicate_form(F.col("name")).alias("form")).distinct()
    return k.filter("form <> ''").groupBy("form", "grade").agg(F.count_distinct("id").alias("kits"), F.min("id").alias("first_id")).filter("kits > 1")


_MODEL = r"[A-Za-z]{1,5}\d{0,3}(?:-[A-Za-z])?-\d[A-Za-z0-9\-/]*"


@query(rf"""WITH t AS (SELECT DISTINCT name, {nfkc_sql("name")} AS n FROM arrival_row WHERE name IS NOT NULL), m AS (SELECT name, unnest(regexp_extract_all(n, '(?:^|[^A-Za-z0-9])({_MODEL})', 1)) AS m FROM t),
 z AS (SELECT DISTINCT name, regexp_replace(regexp_replace(regexp_replace(upper(m), '^0+([0-9])', '\1'), '([^0-9])0+([0-9])', '\1\2', 'g'), '[^A-Z0-9]', '', 'g') AS model FROM m) SELECT model, count(*) AS names FROM z GROUP BY model""")
def model_tokens(spark, d):
    """Model numbers of arrivals, and how many names have each."""
    names = table(spark, d, "arrival_row").select("name").dropna().distinct()
    return names.select(F.explode(S.model_tokens(N.nfkc_column("name"))).alias("model")).groupBy("model").agg(F.count("*").alias("names"))


_GREEK = list(zip("νΝξΞζΖαΑβΒγδΔπΠσΣωΩμΜφΦ", "뉴 뉴 크시 크시 제타 제타 알파 알파 베타 베타 감마 델타 델타 파이 파이 시그마 시그마 오메가 오메가 뮤 뮤 파이 파이".split(), strict=True))


def fold_sql(c: str) -> str:
    x = nfkc_sql(c)
    for a, b in _GREEK:
        x = f"replace({x}, '{a}', '{b}')"
    return f"lower({x})"


_MARKS = "[\\s\\p{Z}\\-_·・.,:;''\"!?/+()\\[\\]~&]+"


@query(f"""WITH t AS (SELECT DISTINCT name, {fold_sql("name")} AS f FROM mall_good WHERE name IS NOT NULL) SELECT name, regexp_replace(f, '{_MARKS}', '', 'g') AS squashed, trim(regexp_replace(f, '{_MARKS}', ' ', 'g')) AS spaced FROM t""")
def squashed_names(spark, d):
    """Names folded, with Greek letters read, without marks or with single blanks for them; Python on distinct names."""
    t = table(spark, d, "mall_good").select("name").dropna().distinct()
    return t.select("name", N.squash_column("name").alias("squashed"), N.spaced_column("name").alias("spaced"))


@query("""WITH c AS (SELECT DISTINCT id, nameJa, nameKo FROM catalog_gunpla WHERE nameKo IS NOT NULL), h AS (SELECT *, list_sort(list_distinct(regexp_extract_all(nameKo, '[㐀-䶿一-鿿]'))) AS a, regexp_extract_all(coalesce(nameJa, ''), '[㐀-䶿一-鿿]') AS b FROM c)
 SELECT id, nameKo AS name, regexp_matches(nameKo, '[ぁ-ゖァ-ヺ]') AS kana, array_to_string(list_filter(a, lambda x: NOT list_contains(b, x)), '') AS stray FROM h""")
def stray_han(spark, d):
    """Kana in a translation, and Han characters that the original hasn't."""
    c = table(spark, d, "catalog_gunpla").filter("nameKo is not null").select("id", "nameJa", F.col("nameKo").alias("name")).distinct()
    return c.select("id", "name", F.col("name").rlike("[ぁ-ゖァ-ヺ]").alias("kana"), F.concat_ws("", S.characters_not_in(F.col("name"), F.col("nameJa"), "㐀-䶿一-鿿")).alias("stray"))


@query(None)
def arrival_names(spark, d):
    """What arrivals' names say: grade, scale, text and model numbers (boundary tables in tests)."""
    names = table(spark, d, "arrival_row").select("name").dropna().distinct()
    return names.select("name", N.reader(N.read_arrival)("name").alias("x")).select("name", "x.*")


@query(None)
def good_names(spark, d):
    """What the mall's names say, and the name that an item gets from it."""
    names = table(spark, d, "mall_good").select("name").dropna().distinct()
    return names.select("name", N.reader(N.read_good)("name").alias("x")).select("name", "x.*", F.concat_ws(" ", F.when(~F.col("x.text").startswith(F.col("x.grade")), F.col("x.grade")), F.nullif("x.scale", F.lit("")), "x.text").alias("shown"))


__all__ = ["LOOK_ALIKE", "ORACLES", "QUERIES"]
