"""Streaming sources and sinks."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.operators.clips import new_clips
from pulsegrid.operators.messages import MESSAGE
from pulsegrid.sources.tables import shared_folder
from pulsegrid.sources.versioned import VersionedTable


def kafka_lines(spark: SparkSession, servers: str, topic: str, group: str) -> DataFrame:
    """Lines of a topic from its latest offset on; needs the Kafka connector."""
    rows = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("kafka.group.id", group).option("startingOffsets", "latest").load()
    return rows.select(F.col("value").cast("string").alias("line"), "partition", "offset", F.unix_millis("timestamp").alias("record_ms"))


def json_messages(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Messages of JSON files as they appear in a folder."""
    reader = spark.readStream.schema(MESSAGE)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).json(path)


@contextmanager
def _states_by_cores(spark: SparkSession) -> Iterator[None]:
    """While a stream starts: a state partition for each core, where the session has more shuffle partitions than cores.

    Each batch opens and commits the state of every partition, whether it has rows or not, which costs more than the rows of
    a few keys. A checkpoint keeps the number that it began with.
    """
    key = "spark.sql.shuffle.partitions"
    before = int(spark.conf.get(key))
    spark.conf.set(key, min(before, spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def drained(stream: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """What a stream gives for all input there is now, as a table in a shared folder; called again with its folder, it goes on."""
    spark, folder = stream.sparkSession, folder or shared_folder(stream.sparkSession)
    sink = stream.writeStream.format("parquet").option("path", f"{folder}/rows").option(
        "checkpointLocation",
        f"{folder}/checkpoint",
    ).outputMode("append").trigger(availableNow=True).queryName(name)
    with _states_by_cores(spark):
        run = sink.start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def arriving(rows: DataFrame, part: Column, parts: int) -> Iterator[tuple[DataFrame, str]]:
    """For each part (numbers from 0) in turn, a stream of all rows up to it, and a folder that is the same for all.

    Rows are written once, by many tasks; a part is then moved into the folder that the stream reads.
    """
    spark, folder = rows.sparkSession, shared_folder(rows.sparkSession)
    rows.withColumn("_part", part.cast("int")).write.partitionBy("_part").parquet(f"{folder}/waiting")
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path(f"{folder}/in"))
    for k in range(parts):
        if fs.exists(path(f"{folder}/waiting/_part={k}")):
            fs.rename(path(f"{folder}/waiting/_part={k}"), path(f"{folder}/in/{k}"))
        yield spark.readStream.schema(rows.schema).option("recursiveFileLookup", True).parquet(f"{folder}/in"), folder


def fed(rows: DataFrame, part: Column, parts: int, built: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """What the stream `built` gives if rows arrive part by part, each part closed before the next one."""
    found = None
    for k, (stream, folder) in enumerate(arriving(rows, part, parts)):
        found = drained(built(stream), f"{name}_{k}", f"{folder}/out")
    return found


def late_rows(query) -> int:
    """Of a stream that has run: rows that came behind the watermark and were dropped, as its progress counts them.

    An aggregate counts them after its partial sums, so at most one for each key, bucket and task of a batch.
    """
    return sum(op.numRowsDroppedByWatermark for p in query.recentProgress for op in p.stateOperators)


def capture(messages: DataFrame, path: str, checkpoint: str):
    """Appends messages to files; goes on where it stopped, and never truncates."""
    return messages.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def capture_report(captured: DataFrame, requested_seconds: float | None = None, path: str | None = None) -> DataFrame:
    """One row on what was captured: first and last arrival and the seconds between, messages, errors (rows without a
    broadcaster, as lines that are no message give), messages a second, whether all have a source time, keys, the
    fields that the first message has, bytes of the files below `path`, and whether it lasted as long as was asked for."""
    good = F.col("broadcaster_id").isNotNull()
    of = lambda c: F.when(good, F.col(c))
    seconds = (F.max(of("timestamp")) - F.min(of("timestamp"))) / 1000
    fields = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in sorted(captured.columns)]))
    size = F.lit(None).cast("long")
    if path is not None:
        spark = captured.sparkSession
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        size = F.lit(folder.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(folder).getLength()).cast("long")
    return captured.agg(
        F.min(of("timestamp")).alias("started_ms"),
        F.max(of("timestamp")).alias("ended_ms"),
        seconds.alias("seconds"),
        F.count_if(good).alias("messages"),
        F.count_if(~good).alias("errors"),
        F.round(F.count_if(good) / F.greatest(seconds, F.lit(1.0)), 2).alias("per_second"),
        F.coalesce(F.bool_and(F.when(good, F.col("sent_at").isNotNull())), F.lit(False)).alias("has_sent_at"),
        F.count_distinct(of("broadcaster_id")).alias("keys"),
        F.min_by(F.when(good, fields), F.when(good, F.struct("timestamp", "message_id"))).alias("sample_keys"),
        size.alias("bytes"),
        (seconds >= F.lit(requested_seconds).cast("double")).alias("completed"),
    )


def insert_clips(stream: DataFrame, path: str, checkpoint: str):
    """Adds a stream's clips to a Parquet table, each clip_id once."""

    def add(batch: DataFrame, _: int) -> None:
        stored = batch.sparkSession.read.schema(batch.schema).parquet(path)
        new_clips(batch, stored).write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merge_stream(stream: DataFrame, table: VersionedTable, combined: Callable[[DataFrame, DataFrame], DataFrame], writer: str, checkpoint: str, mode: str = "append"):
    """Merges each batch of a stream into a versioned table; batches that come again after a failure change nothing.

    writer: a name that stays the same as long as the checkpoint does.
    """

    def merge(batch: DataFrame, number: int) -> None:
        table.merge(batch, combined, writer, number)

    return stream.writeStream.foreachBatch(merge).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def write_readings(read: DataFrame, path: str, parts: int = 16) -> None:
    """Readings as a table, partitioned by a hash of the key."""
    read.withColumn("part", F.pmod(F.hash("key"), F.lit(parts))).write.partitionBy("part").mode("overwrite").parquet(path)


def store_readings(read: DataFrame, name: str, path: str, buckets: int = 16) -> DataFrame:
    """Readings as a table in the catalog, bucketed by key and sorted, so that windows by key need no exchange."""
    read.repartition(buckets, "key").write.bucketBy(buckets, "key").sortBy("key", "second").option("path", path).saveAsTable(name)
    return read.sparkSession.table(name)


def write_readings_text(read: DataFrame, path: str, settings: dict) -> None:
    """Readings as tab-separated text: the settings as JSON in a '#' line, a header, and a row for each bucket.

    Each task writes a file of its own, with settings and header.
    """
    columns = ["key", "second", "observed", "status", "window_count", "mean", "std", "intensity"]
    head = [f"# {json.dumps(settings)}", "\t".join(columns)]
    rows = read.select(F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]).alias("value"))

    def headed(batches):
        first = True
        for batch in batches:
            if first:
                yield pa.RecordBatch.from_arrays([pa.array(head, batch.schema.field(0).type)], schema=batch.schema)
                first = False
            yield batch

    rows.mapInArrow(headed, "value string").write.mode("overwrite").text(path)


def read_readings_text(spark: SparkSession, path: str, key: str = "long") -> DataFrame:
    """Readings from tab-separated text with a '#' line of JSON settings first; refused without one."""
    first = spark.read.text(path).filter(F.col("value").startswith("#")).limit(1).collect()
    if not first:
        raise ValueError("the readings have no line of settings")
    schema = f"key {key}, second long, observed int, status string, window_count int, mean double, std double, intensity double"
    return spark.read.schema(schema).option("sep", "\t").option("comment", "#").option("header", True).csv(path)
