"""Writing tables: only when they changed, one file set a kind, rows for other programs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..operators.merge import same_content


def write_changed(df: DataFrame, path: str, kind: str = "parquet") -> bool:
    """Write unless the path holds the same rows already; whether it was written. The committer makes it atomic."""
    try:
        if same_content(df.sparkSession.read.schema(df.schema).format(kind).load(path), df):
            return False
    except AnalysisException:
        pass
    df.write.format(kind).mode("overwrite").save(path)
    return True


def write_routed(df: DataFrame, path: str, route: Column, order: Sequence[Column]) -> None:
    """JSON lines, a folder for each value of ``route``, rows of a file in order. Rows are ranged by route and order, so a route with most of the
    rows is written by several tasks, one file each, in order from file to file."""
    df.withColumn("file", route).repartitionByRange("file", *order).sortWithinPartitions("file", *order).write.mode("overwrite").partitionBy("file").json(path)


def export_rows(df: DataFrame, labels: dict[str, str]) -> DataFrame:
    """Rows for a spreadsheet: labelled columns of text, arrays joined by commas, 0 and null as blanks."""
    out = []
    for c, label in labels.items():
        kind = df.schema[c].dataType.typeName()
        col = F.concat_ws(", ", c) if kind == "array" else F.col(c).cast("string")
        out.append(F.coalesce(F.when(col != "0", col) if kind in ("long", "integer") else col, F.lit("")).alias(label))
    return df.select(*out)


def json_lines(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("line"))
