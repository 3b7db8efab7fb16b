"""Times written as ISO text with an offset, without regard to the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO = r"^(\d{4}-\d\d-\d\d)[T ](\d\d:\d\d(?::\d\d(?:\.\d+)?)?)\s*(Z|z|[+-]\d\d:?\d\d)?$"


def local_time(text: Column, zone: str = "Asia/Seoul", default: str = "UTC") -> Column:
    """Wall-clock time in ``zone`` (TIMESTAMP_NTZ) of an ISO text; ``default`` is the zone of text without an
    offset; null where it isn't a time."""
    text = F.trim(text)
    part = [F.regexp_extract(text, ISO, k) for k in (1, 2, 3)]
    offset = F.regexp_replace(part[2], r"^([+-]\d\d):?(\d\d)$", "$1:$2")
    source = F.when(F.upper(part[2]) == "Z", "UTC").when(part[2] == "", default).otherwise(offset)
    at = F.to_timestamp_ntz(F.when(part[0] != "", F.concat_ws(" ", part[0], F.rpad(F.substring(part[1], 1, 8), 8, ":00"))), F.lit("yyyy-MM-dd HH:mm:ss"))
    return F.convert_timezone(source, F.lit(zone), at)
