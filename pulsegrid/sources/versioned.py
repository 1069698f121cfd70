"""A table that batches change, by copy on write.

Rows lie in buckets by a hash of their key. A change rewrites the buckets that it touches, beside the old ones, and then
puts down a version: a small file that names the folder of each bucket and the last batch of each writer. Whoever reads
takes the latest version, so a change is seen whole or not at all; a batch that comes again after a failure changes
nothing; and of two changes made at once, the later one is refused and can be made again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.sources.tables import written


class VersionConflictError(RuntimeError):
    """Another change was made meanwhile."""


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str, schema: str, key: list[str], buckets: int = 16):
        """schema: of the rows, as DDL; key: columns by whose hash rows are dealt to buckets."""
        self.spark, self.path, self.key, self.buckets = spark, path, key, buckets
        self.schema = spark.createDataFrame([], schema).schema
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def version(self) -> tuple[int, dict]:
        """Number and content of the latest version; -1 before the first change."""
        folder = self._path(f"{self.path}/_versions")
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        numbers = [int(n) for n in names if n.isdigit()]
        if not numbers:
            return -1, {"buckets": {}, "batches": {}}
        latest = max(numbers)
        stream = self._fs.open(self._path(f"{self.path}/_versions/{latest:012d}"))
        text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return latest, json.loads(text)

    def read(self) -> DataFrame:
        return self._rows(list(self.version()[1]["buckets"].values()))

    def _rows(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{f}" for f in folders])

    def merge(self, changes: DataFrame, combined: Callable[[DataFrame, DataFrame], DataFrame], writer: str, batch: int) -> bool:
        """Puts combined(rows of the touched buckets, changes) in their place; whether it did, as a batch is taken once.

        changes have the key's columns; combined must keep rows of other keys.
        """
        number, now = self.version()
        if batch <= now["batches"].get(writer, -1):
            return False
        changes = written(changes)
        bucket = F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")
        touched = [str(r[0]) for r in changes.select(bucket).distinct().collect()]
        old = self._rows([now["buckets"][b] for b in touched if b in now["buckets"]])
        rows = combined(old, changes).select(*self.schema.names).withColumn("_bucket", bucket)
        folder = f"v{number + 1}-{uuid.uuid4().hex}"
        if touched:
            rows.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        there = {b for b in touched if self._fs.exists(self._path(f"{self.path}/{folder}/_bucket={b}"))}
        buckets = {b: f for b, f in now["buckets"].items() if b not in touched} | {b: f"{folder}/_bucket={b}" for b in there}
        self._commit(number + 1, {"buckets": buckets, "batches": now["batches"] | {writer: batch}})
        return True

    def _commit(self, number: int, content: dict) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        new, target = self._path(f"{self.path}/_versions/_{uuid.uuid4().hex}"), self._path(f"{self.path}/_versions/{number:012d}")
        out = self._fs.create(new, False)
        out.write(bytearray(json.dumps(content), "utf-8"))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf)
        options = self.spark.sparkContext._gateway.new_array(getattr(jvm, "org.apache.hadoop.fs.Options$Rename"), 1)
        options[0] = getattr(jvm, "org.apache.hadoop.fs.Options$Rename").NONE
        try:
            context.rename(self._fs.makeQualified(new), self._fs.makeQualified(target), options)
        except Exception as e:
            if self._fs.exists(target):
                raise VersionConflictError(f"version {number} of {self.path} was made meanwhile") from e
            raise


def replaced(key: list[str]) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """Changes take the place of rows with their key."""
    return lambda old, new: old.join(new.select(*key), key, "left_anti").unionByName(new)
