"""SQL that says again what the longer queries say. Character tables are built by the rule they stand for."""

from __future__ import annotations

import unicodedata

from ..functions.looks import LOOK_ALIKE


def _tables() -> tuple[str, str]:
    """Single characters with the single one that stands for them."""
    pairs = dict(LOOK_ALIKE)
    for k in [*range(0xFF01, 0xFFEF), *range(0x1D400, 0x1D800), *range(0x2000, 0x2070), 0xA0, 0x3000]:
        ch = chr(k)
        form = unicodedata.normalize("NFKC", ch)
        if len(form) == 1 and form != ch:
            pairs[ch] = LOOK_ALIKE.get(form, form)
    pairs |= {"\t": " ", "\n": " ", "\r": " ", " ": " ", " ": " "}
    return "".join(pairs), "".join(pairs.values())


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


FROM, TO = _tables()
UNSEEN = "[\\x{00AD}\\x{034F}\\x{061C}\\x{180B}-\\x{180F}\\x{200B}-\\x{200F}\\x{202A}-\\x{202E}\\x{2060}-\\x{206F}\\x{FE00}-\\x{FE0F}\\x{FEFF}]+"


def look_sql(c: str) -> str:
    """The look of a text in SQL: unseen characters out, single forms, Roman numerals, composition, single blanks."""
    x = f"regexp_replace({c}, '{UNSEEN}', '', 'g')"
    for a, b in (("Ⅲ", "III"), ("Ⅱ", "II"), ("Ⅳ", "IV")):
        x = f"replace({x}, '{a}', '{b}')"
    x = f"translate(nfc_normalize(translate({x}, {quoted(FROM)}, {quoted(TO)})), {quoted(''.join(LOOK_ALIKE))}, {quoted(''.join(LOOK_ALIKE.values()))})"
    return f"trim(regexp_replace({x}, ' +', ' ', 'g'))"


def _id(c: str) -> str:
    x = f"lower({look_sql(c)})"
    return f"CASE WHEN {x} NOT IN ('', 'null') THEN {x} END"


def _time(c: str) -> str:
    return f"(CAST(replace({c}, 'Z', '+00:00') AS TIMESTAMPTZ) AT TIME ZONE 'Asia/Seoul')"


_REFS = f"""WITH r AS (SELECT 'feed' AS ref_table, id AS ref_key, {_time("added")} AS t, {_id("catalogId")} AS item FROM feed
 UNION SELECT 'mall_link', gno, {_time('"at"')}, {_id("catalogId")} FROM mall_link UNION SELECT 'kit', id, {_time("created")}, {_id("catalogId")} FROM kit),
 c AS (SELECT {_id("id")} AS id, min({_time("firstSeen")}) AS seen FROM catalog_gunpla GROUP BY 1), e AS (SELECT DISTINCT {_id("id")} AS id FROM excluded)"""

P1 = _REFS + """ SELECT DISTINCT ref_table, ref_key, strftime(t, '%Y-%m') AS period, CASE WHEN c.id IS NOT NULL THEN 'late' WHEN e.id IS NOT NULL THEN 'deleted' ELSE 'missing' END AS state
 FROM r LEFT JOIN c ON r.item = c.id LEFT JOIN e ON r.item = e.id WHERE r.item IS NOT NULL AND (c.id IS NULL OR c.seen > r.t)"""

P1_REPORT = (_REFS.replace('{_id("catalogId")}', "catalogId") + """, n AS (SELECT ref_table, ref_key, t, item, raw FROM r),
 s AS (SELECT ref_table, strftime(t, '%Y-%m') AS period, CASE WHEN c.id IS NOT NULL AND c.seen > n.t THEN 'late' WHEN c.id IS NOT NULL THEN 'found' WHEN e.id IS NOT NULL THEN 'deleted' ELSE 'missing' END AS state
  FROM n LEFT JOIN c ON n.item = c.id LEFT JOIN e ON n.item = e.id WHERE n.item IS NOT NULL)
 SELECT ref_table, period, count(*) AS refs, count(*) FILTER (WHERE state = 'missing') AS missing, count(*) FILTER (WHERE state = 'deleted') AS deleted, count(*) FILTER (WHERE state = 'late') AS late FROM s GROUP BY 1, 2""").replace(
    " AS item FROM feed", " AS item, catalogId AS raw FROM feed").replace("FROM mall_link UNION", ", catalogId FROM mall_link UNION").replace("FROM kit)", ", catalogId FROM kit)")

_BLANK = "nullif(trim({0}), '')"
P1_PARTIAL = f"""WITH k AS (SELECT DISTINCT id, {_id("catalogId")} AS item, {_BLANK.format("grade")} AS grade, {_BLANK.format("scale")} AS scale FROM kit), c AS (SELECT DISTINCT {_id("id")} AS item, {_BLANK.format("grade")} AS grade, {_BLANK.format("scale")} AS scale FROM catalog_gunpla)
 SELECT (CASE WHEN item IS NULL THEN '-' ELSE 'i' END) || (CASE WHEN grade IS NULL THEN '-' ELSE 'g' END) || (CASE WHEN scale IS NULL THEN '-' ELSE 's' END) AS mask,
 CASE WHEN item IS NULL AND grade IS NULL AND scale IS NULL THEN 'none' WHEN EXISTS (SELECT 1 FROM c WHERE (k.item IS NULL OR c.item = k.item) AND (k.grade IS NULL OR c.grade = k.grade) AND (k.scale IS NULL OR c.scale = k.scale)) THEN 'found' ELSE 'orphan' END AS state,
 count(*) AS kits FROM k GROUP BY 1, 2"""

P3 = f"""WITH s AS (SELECT DISTINCT strftime({_time('"at"')}, '%Y-%m-%d') AS seen FROM mall_scan WHERE complete),
 o AS (SELECT seen, row_number() OVER (ORDER BY seen) AS i, lead(seen) OVER (ORDER BY seen) AS nxt FROM s),
 g AS (SELECT seen, gno, arg_max((coalesce({look_sql("name")}, '~'), coalesce(nullif({look_sql("series")}, ''), '~'), coalesce(price, -1), coalesce(CAST(soldOut AS VARCHAR), '~'), coalesce(cate, '~')), loaded_at) AS v FROM mall_good WHERE gno IS NOT NULL GROUP BY 1, 2),
 h AS (SELECT g.*, i, nxt FROM g JOIN o USING (seen)), a AS (SELECT * FROM h WHERE nxt IS NOT NULL), b AS (SELECT * FROM h WHERE i > 1)
 SELECT coalesce(b.seen, a.nxt) AS seen, coalesce(a.gno, b.gno) AS gno, CASE WHEN a.gno IS NULL THEN 'added' WHEN b.gno IS NULL THEN 'removed' ELSE 'changed' END AS change
 FROM a FULL JOIN b ON a.gno = b.gno AND a.i + 1 = b.i WHERE a.gno IS NULL OR b.gno IS NULL OR a.v <> b.v"""


P3_DAILY = f"WITH p AS ({P3}) SELECT seen, count(*) FILTER (WHERE change = 'added') AS added, count(*) FILTER (WHERE change = 'removed') AS removed, count(*) FILTER (WHERE change = 'changed') AS changed FROM p GROUP BY seen"
