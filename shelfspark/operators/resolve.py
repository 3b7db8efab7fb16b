"""One-to-one claims on the targets of a resolution; the resolution itself is ``entities``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def one_to_one(links: DataFrame, id_: str, target: str, score: str) -> DataFrame:
    """Of links to one target the best, the least id on a tie."""
    order = Window.partitionBy(target).orderBy(F.desc(score), id_)
    return links.withColumn("__k", F.row_number().over(order)).filter("__k = 1").drop("__k")
