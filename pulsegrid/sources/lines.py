"""Lines of text files in the order they were written."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulsegrid.sources.tables import written

#: Parts of files whose counts are sent to all tasks; more are joined.
FEW_PARTS = 200_000


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no (from 0) and line of every line, however the files are split.

    A part of a file is read by one task, in order: a line's number is its place there and the lines of the parts before.
    """
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"), F.col("value").alias("line"))

    def placed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, many = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            file, part = batch.column(0).dictionary_encode().indices.to_numpy(), batch.column(1).to_numpy()
            new = np.concatenate([[True], (file[1:] != file[:-1]) | (part[1:] != part[:-1])])
            first = np.maximum.accumulate(np.where(new, np.arange(batch.num_rows), 0))
            place = np.arange(batch.num_rows) - first
            if (batch.column(0)[0].as_py(), part[0]) == last:
                place[first == 0] += many
            last, many = (batch.column(0)[-1].as_py(), part[-1]), int(place[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place)], names=["file", "part", "line", "place"])

    lines = raw.mapInArrow(placed, "file string, part long, line string, place long")
    counts = written(raw.groupBy("file", "part").agg(F.count("*").alias("_n")))
    before = F.sum("_n").over(Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("file", "part", F.coalesce(before, F.lit(0)).alias("_before"))
    joined = lines.join(F.broadcast(starts) if counts.count() <= FEW_PARTS else starts, ["file", "part"])
    return joined.select("file", (F.col("_before") + F.col("place")).alias("line_no"), "line")
