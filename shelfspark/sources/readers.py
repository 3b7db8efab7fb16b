"""Reading what the catalogue is made of: JSON documents, delimited text with unknown columns, pages, line records."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def json_documents(spark: SparkSession, paths: Sequence[str], schema: T.StructType | str, *, key: str | None = None, lines: bool = False, strict: bool = True) -> DataFrame:
    """JSON documents of a known schema: objects or arrays of them over any number of lines, or one a line. A path that isn't there is an
    empty table. Malformed documents raise when they are read, or give nulls if not ``strict``. With a key, of several rows that of the last path."""
    parts = []
    for i, path in enumerate(paths):
        there = spark._jvm.org.apache.hadoop.fs.Path(path)
        if there.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(there):
            rows = spark.read.schema(schema).option("mode", "FAILFAST" if strict else "PERMISSIVE").option("multiLine", not lines).json(path)
        else:
            rows = spark.createDataFrame([], schema)
        parts.append(rows.withColumn("__file", F.lit(i)))
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p, allowMissingColumns=True)
    if key:
        from ..operators.merge import latest

        both = latest(both.filter(F.col(key).isNotNull()), [key], [F.col("__file")])
    return both.drop("__file")


def delimited(spark: SparkSession, path: str, aliases: Mapping[str, Sequence[str]], required: str) -> DataFrame:
    """Delimited text: tabs if there is one anywhere, else commas; quotes only where a field begins, doubled within.

    A header row is looked for in the first five rows that aren't blank: it names at least two known columns and the required one,
    exactly or by its beginning, the exact name first; rows down to it are dropped, by their place. Without one, columns come in
    the order of ``aliases``. Blank rows and rows without the required value are dropped.
    """
    text = spark.read.text(path)
    sep = "\t" if text.filter(F.contains("value", F.lit("\t"))).limit(1).count() else ","
    reader = spark.read.option("sep", sep).option("quote", '"').option("escape", '"').option("multiLine", True).option("maxColumns", 200)
    wide = reader.schema(", ".join(f"c{i} string" for i in range(100)))
    raw = wide.csv(path).withColumn("__i", F.monotonically_increasing_id())
    filled = raw.filter(F.coalesce(*(F.nullif(F.trim(f"c{i}"), F.lit("")) for i in range(100))).isNotNull())
    found: dict[str, int] = {}
    start = -1
    for row in filled.orderBy("__i").limit(5).collect():
        got: dict[str, int] = {}
        for i in range(100):
            cell = (row[f"c{i}"] or "").strip().lower()
            spelt = {c: [a.lower() for a in (c, *names)] for c, names in aliases.items() if c not in got}
            exact = next((c for c, names in spelt.items() if cell in names), None)
            column = exact or next((c for c, names in spelt.items() if cell and any(cell.startswith(a) for a in names)), None)
            if column:
                got[column] = i
        if len(got) >= 2 and required in got:
            found, start = got, row["__i"]
            break
    columns = found or {c: i for i, c in enumerate(aliases)}
    rows = filled.filter(F.col("__i") > start) if found else filled
    out = rows.select(*(F.coalesce(F.trim(f"c{i}"), F.lit("")).alias(c) for c, i in columns.items()))
    return out.filter(F.col(required) != "")


def legacy_kits(text: Column) -> Column:
    """The kits of an old export: a bare array, an object's ``kits``, or either in a page's script of the id kit-data. array<struct<id, name,
    photo>>, those without a name left out; ``photo`` is kept only where it is a base64 picture. Null where it is none of these."""
    inner = F.regexp_extract(text, r"(?is)<script[^>]*id=[\"']kit-data[\"'][^>]*>(.*?)</script>", 1)
    t = F.trim(F.when(inner != "", inner).otherwise(text))
    kit = "array<struct<id: string, name: string, photo: string>>"
    rows = F.coalesce(F.when(F.startswith(t, F.lit("[")), F.from_json(t, kit)), F.from_json(t, f"struct<kits: {kit}>")["kits"])
    photo = lambda k: F.when(k["photo"].rlike(r"^data:image/(?:jpeg|png|webp|gif);base64,[A-Za-z0-9+/=\s]+\z"), k["photo"])
    return F.transform(F.filter(rows, lambda k: F.trim(k["name"]) != ""), lambda k: F.struct(k["id"].alias("id"), k["name"].alias("name"), photo(k).alias("photo")))


class _Page(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title, self.h1, self.links, self.lang, self.text = "", "", [], None, []
        self._in: list[str] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = dict(attrs)
        if tag == "html":
            self.lang = a.get("lang")
        if tag == "a" and a.get("href"):
            self.links.append(a["href"])
        if tag in ("title", "h1", "script", "style"):
            self._in.append(tag)

    def handle_endtag(self, tag: str) -> None:
        if self._in and self._in[-1] == tag:
            self._in.pop()

    def handle_data(self, data: str) -> None:
        where = self._in[-1] if self._in else ""
        if where == "title":
            self.title += data
        elif where not in ("script", "style"):
            self.h1 += data if where == "h1" else ""
            self.text.append(data)


PAGE = T.StructType([T.StructField(n, T.StringType()) for n in ("title", "h1", "lang", "text")] + [T.StructField("links", T.ArrayType(T.StringType()))])


@F.pandas_udf(PAGE)
def page(html: pd.Series) -> pd.DataFrame:
    """Title, first heading, language, text and distinct links of a page; broken markup is read as far as it goes."""
    rows = []
    for x in html:
        p = _Page()
        if x is not None:
            p.feed(x)
            p.close()
        rows.append((p.title.strip(), p.h1.strip(), p.lang, " ".join("".join(p.text).split()), list(dict.fromkeys(p.links))))
    return pd.DataFrame(rows, columns=[f.name for f in PAGE])


def decoded(body: Column, declared: Column) -> Column:
    """Bytes as text: by the declared charset, else by the one a meta tag names near the start, else UTF-8."""

    @F.pandas_udf(T.StringType())
    def run(raw: pd.Series, said: pd.Series) -> pd.Series:
        import re

        out = []
        for b, c in zip(raw, said, strict=True):
            if b is None:
                out.append(None)
                continue
            b = bytes(b)
            m = re.search(rb"charset=[\"']?([\w-]+)", b[:4096])
            name = (c or (m and m[1].decode("ascii")) or "utf-8").lower()
            try:
                out.append(b.decode({"euc-kr": "cp949", "ks_c_5601-1987": "cp949"}.get(name, name), "replace"))
            except LookupError:
                out.append(b.decode("utf-8", "replace"))
        return pd.Series(out)

    return run(body, declared)


def line_records(posts: DataFrame, id_: str, text: str, code: str, price: str) -> DataFrame:
    """(id, code, name, price) of records in a text's lines: a code, then a name, then a price, which may be missing.
    A record whose name is a code or a price is broken and dropped; of a repeated code the first counts."""
    lines = posts.select(id_, F.posexplode(F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")).alias("i", "line"))
    w = Window.partitionBy(id_).orderBy("i")
    rows = lines.withColumns({"name": F.lead("line", 1).over(w), "cost": F.lead("line", 2).over(w)}).filter(F.col("line").rlike(code))
    good = rows.filter(F.col("name").isNotNull() & ~F.col("name").rlike(code) & ~F.col("name").rlike(price))
    amount = F.regexp_replace(F.when(F.col("cost").rlike(price), F.col("cost")), r"\D", "").cast("bigint")
    once = good.withColumn("k", F.row_number().over(Window.partitionBy(id_, "line").orderBy("i"))).filter("k = 1")
    return once.select(id_, F.col("line").alias("code"), "name", amount.alias("price"))
