"""Container logs: JSON lines with a tag that names the container."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LINE = "log string, stream string, attrs string"


def fields(lines: DataFrame, line: str = "line", tag: str = r"^([^|]*)\|") -> DataFrame:
    """Adds log, stream and container_name (the first group of the tag's pattern) for batch or streaming lines."""
    parsed = lines.withColumn("_l", F.from_json(line, LINE))
    attrs = F.coalesce(F.from_json("_l.attrs", "tag string")["tag"], F.lit(""))
    return parsed.select(
        *lines.columns,
        F.col("_l.log").alias("log"),
        F.col("_l.stream").alias("stream"),
        F.regexp_extract(attrs, tag, 1).alias("container_name"),
    )
