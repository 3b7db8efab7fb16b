"""Scalar normalisers as columns: built-in expressions only, null in null out unless said otherwise."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SCALE = r"(?<![\d/])1/\d{1,4}(?!\d)"
MODEL = r"(?<![A-Za-z0-9])[A-Za-z]{1,5}\d{0,3}(?:-[A-Za-z])?-\d[A-Za-z0-9\-/]*"


def is_blank(c: Column) -> Column:
    """Null, or nothing but blanks of any kind."""
    return F.coalesce(c.rlike(r"^[\s\p{Z}]*\z"), F.lit(True))


def blank_to_null(c: Column) -> Column:
    return F.when(~is_blank(c), F.trim(c))


def search_form(c: Column) -> Column:
    """Small letters and digits of any script, nothing else."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "")


def spaced_form(c: Column) -> Column:
    """Words of letters and digits with single blanks between."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))


def without_prefix(c: Column, words: Sequence[str]) -> Column:
    """The name without one leading word of ``words`` (any case) at a word's end; the name itself if nothing stays."""
    cut = F.regexp_replace(c, r"(?i)^\s*(?:" + "|".join(map(_quote, sorted(words, key=len, reverse=True))) + r")\b[\s:.-]*", "")
    return F.when(F.trim(cut) != "", F.trim(cut)).otherwise(F.trim(c))


def _quote(word: str) -> str:
    return "".join("\\" + x if not x.isalnum() and x != " " else x for x in word)


def scale_of(c: Column) -> Column:
    """The first scale 1/n that isn't part of a longer number; null if there is none."""
    return F.nullif(F.regexp_extract(c, SCALE, 0), F.lit(""))


def model_tokens(c: Column) -> Column:
    """The distinct model numbers - letters, a hyphen and digits, perhaps more - in capitals, letters and digits only, without
    zeros that lead a run of digits; sorted."""
    found = F.regexp_extract_all(c, F.lit(f"({MODEL})"), 1)
    plain = F.transform(found, lambda x: F.regexp_replace(F.regexp_replace(F.upper(x), r"(?<!\d)0+(?=\d)", ""), "[^A-Z0-9]", ""))
    return F.array_sort(F.array_distinct(plain))


def short_runs(c: Column) -> Column:
    """Latin runs that tell names apart: with a digit, a Roman numeral, or of at most three letters; a sorted multiset."""
    runs = F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), 1)
    return F.array_sort(F.filter(runs, lambda x: x.rlike(r"\d") | x.rlike("^(?:i{1,3}|iv|vi{0,3}|ix|x)\\z") | (F.length(x) <= 3)))


def replaced(c: Column, words: Mapping[str, str]) -> Column:
    """Each key replaced by its value, one after the other in order."""
    return reduce(lambda x, kv: F.replace(x, F.lit(kv[0]), F.lit(kv[1])), words.items(), c)


def ladder(c: Column, rules: Sequence[tuple[str, str | None]]) -> Column:
    """The value of the first pattern that is found; null for none, and for a rule whose value is null."""
    out = None
    for pattern, value in rules:
        hit, v = c.rlike(pattern), F.lit(value).cast("string")
        out = F.when(hit, v) if out is None else out.when(hit, v)
    return out


def flexible_date(c: Column) -> Column:
    """A date from Y, M and D with anything but digits between, M/D/Y with a year of two to four digits, or a spreadsheet's day
    number of five; null where it is none."""
    c = F.trim(c)
    ymd, mdy = r"(\d{4})\D+(\d{1,2})\D+(\d{1,2})", r"^(\d{1,2})/(\d{1,2})/(\d{2,4})\z"
    part = lambda p, k: F.regexp_extract(c, p, k)
    two = lambda p, k: F.lpad(part(p, k), 2, "0")
    year = F.when(F.length(part(mdy, 3)) == 2, F.concat(F.lit("20"), part(mdy, 3))).otherwise(part(mdy, 3))
    text = F.when(c.rlike(ymd), F.concat_ws("-", part(ymd, 1), two(ymd, 2), two(ymd, 3))).when(c.rlike(mdy), F.concat_ws("-", year, two(mdy, 1), two(mdy, 2)))
    serial = F.when(c.rlike(r"^\d{5}\z"), F.date_add(F.lit("1970-01-01").cast("date"), F.when(c.rlike(r"^\d{5}\z"), c).cast("int") - 25569))
    return F.coalesce(text.try_cast("date"), serial)


def split_tags(c: Column) -> Column:
    """Tags between commas, semicolons, bars or hashes: trimmed, not empty, distinct, in order."""
    return F.array_distinct(F.filter(F.transform(F.split(c, r"[,;|#]"), lambda x: F.trim(x)), lambda x: x != ""))


def inclusive_days(a: Column, b: Column) -> Column:
    """Days from a to b, both counted; null if either is missing or b comes first."""
    n = F.date_diff(b, a) + 1
    return F.when(n >= 1, n)


def nearest_year(month_day: Column, near: Column, most: int = 60) -> Column:
    """The date of a month/day nearest to ``near`` among the years around it; the earlier on a tie; null beyond
    ``most`` days or where the day doesn't exist."""
    m, d = F.regexp_extract(month_day, r"^\s*(\d{1,2})/(\d{1,2})", 1), F.regexp_extract(month_day, r"^\s*(\d{1,2})/(\d{1,2})", 2)
    each = F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda y: F.concat_ws("-", F.year(near) + y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")).try_cast("date"))
    ranked = F.transform(F.filter(each, lambda x: x.isNotNull()), lambda x: F.struct(F.abs(F.date_diff(x, near)).alias("off"), x.alias("day")))
    best = F.array_min(ranked)
    return F.when(best["off"] <= most, best["day"])


def month_range(a: Column, b: Column) -> Column:
    """All months from a to b (dates or YYYY-MM), both included; empty if b comes first."""
    first = lambda c: F.trunc(F.when(F.length(c.cast("string")) == 7, F.concat(c, F.lit("-01"))).otherwise(c.cast("string")).cast("date"), "month")
    x, y = first(a), first(b)
    return F.when(x <= y, F.transform(F.sequence(F.least(x, y), y, F.expr("interval 1 month")), lambda v: F.date_format(v, "yyyy-MM"))).otherwise(F.array().cast("array<string>"))


def partial_date_end(text: Column) -> Column:
    """The day of YYYY-MM-DD, or the last day of YYYY-MM; null for any other text or a month that isn't one."""
    month = F.when(text.rlike(r"^\d{4}-\d{2}$"), F.concat(text, F.lit("-01"))).try_cast("date")
    return F.coalesce(F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text).try_cast("date"), F.last_day(month))


def partial_date_key(text: Column) -> Column:
    """A text to sort by: the day, or the month as its day 00; empty for none."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text).when(text.rlike(r"^\d{4}-\d{2}$"), F.concat(text, F.lit("-00"))).otherwise("")


def characters_not_in(a: Column, b: Column, of: str) -> Column:
    """The distinct characters of class ``of`` in a that b hasn't, sorted."""
    chars = lambda c: F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(f"([{of}])"), 1))
    return F.array_sort(F.array_except(chars(a), chars(b)))


def allowed_url(c: Column, hosts: Sequence[str], schemes: Sequence[str] = ("https",)) -> Column:
    """The URL if its scheme and host are allowed; else null."""
    ok = F.try_parse_url(c, F.lit("HOST")).isin(*hosts) & F.try_parse_url(c, F.lit("PROTOCOL")).isin(*schemes)
    return F.when(ok, c)


def robots_pattern(rule: str) -> str:
    """A robots rule as a regular expression: * is anything, a closing $ is the end."""
    end = rule.endswith("$")
    return "^" + ".*".join(_quote(x) for x in (rule[:-1] if end else rule).split("*")) + ("$" if end else "")


def robots_allowed(path: Column, rules: Sequence[tuple[bool, str]]) -> Column:
    """Whether the rules (allow?, pattern) let the path be read: the longest match decides, a tie allows."""
    hits = [F.when(path.rlike(robots_pattern(p)), F.struct(F.lit(len(p)).alias("n"), F.lit(a).alias("ok"))) for a, p in rules if p]
    return F.coalesce(F.array_max(F.array_compact(F.array(*hits)))["ok"], F.lit(True)) if hits else F.lit(True)


def data_uri(c: Column) -> Column:
    """struct(mime, bytes) of a base64 data URI; null where it is none."""
    p = r"^data:([\w.+-]+/[\w.+-]+);base64,([A-Za-z0-9+/=]+)$"
    return F.when(c.rlike(p), F.struct(F.regexp_extract(c, p, 1).alias("mime"), F.unbase64(F.regexp_extract(c, p, 2)).alias("bytes")))


def reference(text: Column, host: str) -> Column:
    """The item's id in a pasted text: a page of ``host`` (a pattern), an id, or a number; null for none, and beyond 300 characters."""
    get = lambda p: F.regexp_extract(text, "(?i)" + p, 1)
    page, number, shop, own = get(host + r"/item/(\d{2}_\d+)"), get(r"^(?:bh-)?(\d{2}_\d+)\z"), get(host + r"/item/(item-\d+)"), get(r"^pb-(item-\d+)\z")
    found = F.when(page != "", F.concat(F.lit("bh-"), page)).when(number != "", F.concat(F.lit("bh-"), number)).when(shop != "", F.concat(F.lit("pb-"), shop)).when(own != "", F.concat(F.lit("pb-"), own))
    return F.when(F.length(text) <= 300, found)


def stripped(name: Column, grade: Column, scale: Column, *, loose: bool = False) -> Column:
    """A name without its leading grade (any width and case) and then its leading scale, each as a word of its own. ``loose`` also
    takes a word that begins with the grade's letters, of up to four letters more and a letter behind a colon. Null is empty."""
    narrow = lambda c: F.translate(c, _WIDE, _NARROW)
    trim = lambda c: F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+\z", "")
    ends = lambda s, n: F.concat(F.substr(s, n + 1), F.lit(" ")).rlike(r"^[\s\p{Z}]")
    rest = lambda s, n: trim(F.substr(s, n + 1))
    s, n = trim(F.coalesce(name, F.lit(""))), F.length(grade)
    led = (F.lower(narrow(F.substr(s, F.lit(1), n))) == F.lower(grade)) & ends(s, n) & (grade != "")
    s = F.when(F.coalesce(led, F.lit(False)), rest(s, n)).otherwise(s)
    if loose:
        letters = F.regexp_replace(F.coalesce(grade, F.lit("")), "[^A-Za-z]", "")
        word = F.regexp_extract(s, r"^([A-Za-z]+(?::[A-Za-z])?)[\s\p{Z}]", 1)
        plain = F.regexp_replace(word, ":.*$", "")
        fits = (letters != "") & F.startswith(F.lower(plain), F.lower(letters)) & (F.length(plain) - F.length(letters)).between(1, 4)
        s = F.when(fits, rest(s, F.length(word))).otherwise(s)
    n = F.length(scale)
    led = F.startswith(s, scale) & ends(s, n) & (scale != "")
    return F.when(F.coalesce(led, F.lit(False)), rest(s, n)).otherwise(s)


_WIDE = "".join(chr(k) for k in range(0xFF01, 0xFF5F))
_NARROW = "".join(chr(k - 0xFEE0) for k in range(0xFF01, 0xFF5F))
