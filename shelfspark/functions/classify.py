"""Classification of items by brand keys and titles, of rows to import by what users write; built-in expressions only."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Brand keys with line and grade; a key of no line takes its item out.
BRANDS: dict[str, tuple[str | None, str | None]] = {
    "hg": ("gunpla", "HG"), "hg-c": ("gunpla", "HG"), "hguc": ("gunpla", "HG"), "hgce": ("gunpla", "HG"), "pb_hg": ("gunpla", "HG"),
    "rg": ("gunpla", "RG"), "rg-c": ("gunpla", "RG"), "pb_rg": ("gunpla", "RG"),
    "mg": ("gunpla", "MG"), "mgka": ("gunpla", "MG"), "pb_mg": ("gunpla", "MG"), "mgsd": ("gunpla", "MGSD"), "mgex": ("gunpla", "MGEX"),
    "pg": ("gunpla", "PG"), "pb_pg": ("gunpla", "PG"), "entry_grade_g": ("gunpla", "EG"), "entry_grade": ("gunpla", "EG"),
    "sdcs": ("gunpla", "SDCS"), "sdcs-c": ("gunpla", "SDCS"), "sdex": ("gunpla", "SDEX"), "bb": ("gunpla", "BB"), "pb_bb": ("gunpla", "BB"),
    "sdgundamseries": ("gunpla", "SD"), "re100": ("gunpla", "RE/100"), "fullmechanics": ("gunpla", "FULL MECHANICS"),
    "pb_gunpla": ("gunpla", None), "pb_others": ("gunpla", None),
    "megasize": ("gunpla", "MEGA SIZE"), "hirm": ("gunpla", "Hi-Resolution Model"), "gunpla40th": ("gunpla", None), "gundam_g40": ("gunpla", None),
    "besthit_chronicle": ("gunpla", None), "gundarium_gundam": ("gunpla", None), "gfy": ("gunpla", None), "expo2025-gunpla": ("gunpla", None),
    "hgamplifiedimgn": ("gunpla", "HG"),
    "30ms": ("girl", "30MS"), "30mp": ("girl", "30MP"), "figurerise-standard": ("girl", "Figure-rise Standard"),
    "figurerise-standard-amp": ("girl", "Figure-rise Standard Amplified"),
    **dict.fromkeys((
        "figurerise-bust", "figurerise-labo", "figurerise-mechanics", "figurerise-effect", "pb_charapla", "gundam-assemble", "30mm", "30mf",
        "gundam_decal", "optionpartsset", "optionpartsset_c", "parts", "actionbase", "actionbase_c", "tool", "entry_nipper_c",
        "customize_scenebase", "imaginary_skeleton", "claymonsters", "plakoro", "pokepla", "mecha-colle", "ecoplaproject_g", "ecopla",
        "tokyo2020_official", "petit_rits", "keitorabusou", "nekobusou", "peti", "disney_castle", "claymodelkit", "limex",
        "exploringlab_nature", "ultimagear", "geki-drive", "train", "petitgguy",
    ), (None, None)),
}
# Beginnings of titles in capitals, the first that fits.
TITLES: tuple[tuple[str, str, str], ...] = (
    (r"^MGSD", "gunpla", "MGSD"), (r"^MGEX", "gunpla", "MGEX"), (r"^MG", "gunpla", "MG"), (r"^PG", "gunpla", "PG"), (r"^RG", "gunpla", "RG"), (r"^HG", "gunpla", "HG"),
    (r"^(?:ENTRY GRADE|EG)\b", "gunpla", "EG"), (r"^SDCS|^SDガンダム ?クロスシルエット", "gunpla", "SDCS"), (r"^SDEX|^SDガンダム ?EX", "gunpla", "SDEX"),
    (r"^(?:SDW|SDガンダム|SD ?GUNDAM)", "gunpla", "SD"), (r"^BB戦士", "gunpla", "BB"), (r"^RE/100", "gunpla", "RE/100"), (r"^FULL MECHANICS", "gunpla", "FULL MECHANICS"),
    (r"^30MS|^30 ?MINUTES SISTERS", "girl", "30MS"), (r"^30MP|^30 ?MINUTES PREFERENCE", "girl", "30MP"),
    (r"^FIGURE-RISE STANDARD AMPLIFIED", "girl", "Figure-rise Standard Amplified"), (r"^FIGURE-RISE STANDARD", "girl", "Figure-rise Standard"),
)
# Grades looked for in what users write, the longest first, with the grade that each is.
WRITTEN: tuple[tuple[str, str], ...] = (
    ("FIGURE-RISESTANDARDAMPLIFIED", "Figure-rise Standard Amplified"), ("FIGURERISESTANDARDAMPLIFIED", "Figure-rise Standard Amplified"),
    ("FIGURE-RISESTANDARD", "Figure-rise Standard"), ("FIGURERISESTANDARD", "Figure-rise Standard"), ("FULLMECHANICS", "FM"),
    ("MGEX", "MGEX"), ("MGSD", "MGSD"), ("SDCS", "SDCS"), ("SDEX", "SDEX"), ("RE/100", "RE/100"), ("RE100", "RE/100"),
    ("30MM", "30MM"), ("30MS", "30MS"), ("30MP", "30MP"), ("HG", "HG"), ("RG", "RG"), ("MG", "MG"), ("PG", "PG"), ("EG", "EG"), ("SD", "SD"), ("FM", "FM"), ("BB", "BB"),
)
STATUSES = (("도색|개조|커스텀|먹선", "custom"), ("조립중|진행|작업중|가조립중", "building"), ("완성|완료|조립완|가조립", "built"))
SCALES = {"HG": "1/144", "RG": "1/144", "EG": "1/144", "MG": "1/100", "PG": "1/60", "RE/100": "1/100", "FM": "1/100", "MGEX": "1/100"}
NO_SCALE, NO_GRADE = "논스케일", "기타"
# Brackets of shop names in capitals, the first that fits; a null grade isn't in the catalogue.
BRACKETS = (
    (r"^30M[MF]", None), (r"^30MS", "30MS"), (r"^30MP", "30MP"), (r"^HG", "HG"), (r"^MGSD", "MGSD"), (r"^MGEX", "MGEX"), (r"^MG", "MG"), (r"^PG", "PG"), (r"^RG", "RG"),
    (r"^EG", "EG"), (r"^SDCS", "SDCS"), (r"^SDEX", "SDEX"), (r"^SD", "SD"), (r"^BB", "BB"), (r"^RE$", "RE/100"), (r"^피규어라이즈스탠다드", "Figure-rise Standard"),
)


def by_brand(keys: Column, brands: Mapping[str, tuple[str | None, str | None]] = BRANDS) -> Column:
    """struct(line, grade, unknown) of an array of brand keys: girl if any key is, else gunpla if any is; the grade of the line's
    first key that has one; the keys that aren't known, in order. Null or empty keys have no line."""
    table = lambda k: F.create_map(*(F.lit(x) for b, v in brands.items() if v[k] for x in (b, v[k])))
    lines, grades = table(0), table(1)
    keys = F.coalesce(keys, F.array().cast("array<string>"))
    line_of = lambda k: F.element_at(lines, F.lower(k))
    has = lambda line: F.exists(keys, lambda k: F.coalesce(line_of(k) == line, F.lit(False)))
    line = F.when(has("girl"), "girl").when(has("gunpla"), "gunpla")
    of_line = F.filter(keys, lambda k: (line_of(k) == line) & F.element_at(grades, F.lower(k)).isNotNull())
    unknown = F.filter(keys, lambda k: ~F.lower(k).isin(*brands))
    return F.struct(line.alias("line"), F.element_at(grades, F.lower(F.get(of_line, F.lit(0)))).alias("grade"), unknown.alias("unknown"))


def by_title(title: Column, rules: Sequence[tuple[str, str, str]] = TITLES) -> Column:
    """struct(line, grade) of a title in its compatibility form: the first rule that fits; nulls for none."""
    t, line, grade = F.upper(F.trim(title)), F.lit(None).cast("string"), F.lit(None).cast("string")
    for pattern, a, b in reversed(rules):
        line, grade = F.when(t.rlike(pattern), a).otherwise(line), F.when(t.rlike(pattern), b).otherwise(grade)
    return F.struct(line.alias("line"), grade.alias("grade"))


def by_bracket(name: Column) -> Column:
    """The grade that a name's leading bracket says: its digits and letters, the first pattern that fits; null where it says none."""
    inside = F.trim(F.regexp_extract(name, r"^\s*\[([^\]]*)\]", 1))
    code = F.upper(F.regexp_extract(inside, r"^(\d*[A-Za-z가-힣]+)", 1))
    out = F.lit(None).cast("string")
    for pattern, grade in reversed(BRACKETS):
        out = F.when(code.rlike(pattern), F.lit(grade).cast("string")).otherwise(out)
    return F.when(code != "", out)


def written_grade(grade: Column, name: Column) -> Column:
    """The grade in what a user wrote as grade, else in the name."""

    def hit(c: Column) -> Column:
        out = F.lit(None).cast("string")
        for word, g in reversed(WRITTEN):
            out = F.when(F.contains(c, F.lit(word)), g).otherwise(out)
        return out

    return F.coalesce(hit(F.upper(F.regexp_replace(F.coalesce(grade, F.lit("")), r"\s", ""))), hit(F.upper(F.coalesce(name, F.lit("")))), F.lit(NO_GRADE))


def written_status(c: Column) -> Column:
    s, out = F.regexp_replace(F.coalesce(c, F.lit("")), r"\s", ""), F.lit("unbuilt")
    for pattern, value in reversed(STATUSES):
        out = F.when(s.rlike(pattern), value).otherwise(out)
    return out


def written_scale(c: Column, grade: Column) -> Column:
    """1/n where it is written; no scale where that is written; else the grade's usual one."""
    s = F.regexp_replace(F.coalesce(c, F.lit("")), r"\s", "")
    found = F.regexp_extract(s, r"1/(\d+)", 1)
    usual = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in SCALES.items() for x in kv)), grade), F.lit(NO_SCALE))
    return F.when(found != "", F.concat(F.lit("1/"), found)).when(s.rlike("(?i)논|non|없"), NO_SCALE).otherwise(usual)


def duplicate_form(name: Column) -> Column:
    """Small letters without one leading grade, blanks and marks: the same for names that users type for one thing."""
    s = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"^\s*(?:hguc|hgce|hg|rg|mgex|mgsd|mg|pg|eg|sd|re/?100|fm|30mm)\b", "")
    return F.regexp_replace(s, r"[\s\-_·.,()\[\]'\"]", "")
