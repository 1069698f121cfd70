"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words are runs of anything but ASCII white space.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses the shared folder that the cluster names; where none is set, as in tests, one in the warehouse, which is shared too.

    A warehouse on a machine's own disk is refused unless Spark runs on that machine alone.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            warehouse = spark.conf.get("spark.sql.warehouse.dir")
            if warehouse.startswith(("file:", "/")) and not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            folder = f"{warehouse}/_checkpoints"
        context.setCheckpointDir(folder)


def shared_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share, below the checkpoint folder. It goes when the driver's Python ends."""
    ensure_checkpoint_dir(spark)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{spark.sparkContext.getCheckpointDir()}/pulsegrid-{uuid.uuid4().hex}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.deleteOnExit(path)
    return path.toString()


def written(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """df as a table in the shared folder, which cuts its lineage: lost executors cost no more than reading it again.

    A checkpoint() would run the plan a second time to write it.
    """
    path = shared_folder(df.sparkSession)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Setting, its default, and what texts want: bytes of a batch for Python, rows that a scan decodes at a time.
_BATCHES = (("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "4m"), ("spark.sql.parquet.columnarReaderBatchSize", "4096", "512"))


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """While tables are written: whole texts are read and handed to Python a few megabytes at a time, where the session has
    Spark's defaults, which suit narrow rows. Afterwards the session's settings are as they were.

    What is returned without having been made is not concerned: whoever makes it chooses its settings.
    """
    asked = [(key, value) for key, default, value in _BATCHES if spark.conf.get(key) == default]
    try:
        for key, value in asked:
            spark.conf.set(key, value)
        yield
    finally:
        for key, _ in asked:
            spark.conf.unset(key)


def drop_written(df: DataFrame) -> None:
    """Deletes the table that `written` made, once nothing reads it any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/pulsegrid-" in folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def put_aside(df: DataFrame, **used: str) -> tuple[DataFrame, list[Column]]:
    """df with the used columns under names of ours (name=column) and the others under names that nothing else has, and
    what to select of it to have df's columns again."""
    ours = {column: name for name, column in used.items()}
    names = [ours.get(c, f"aside_{i}") for i, c in enumerate(df.columns)]
    renamed = df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(df.columns, names, strict=True)])
    return renamed, [F.col(n).alias(c) for c, n in zip(df.columns, names, strict=True)]


class Remembered:
    """What a worker has worked out for keys, in two generations of about `most` bytes each.

    When the young one is full it becomes the old one, whose entries come back as they are asked for: frequent keys stay,
    and memory does not grow with the keys that are met.
    """

    _all: list[Remembered] = []

    def __init__(self, most: int = 8_000_000):
        self.most, self.young, self.old, self.size = most, {}, {}, 0
        self._all.append(self)

    def filled(self, wanted: set, make: Callable[[list], Iterable[Any]]) -> dict:
        """A dictionary with (at least) the wanted keys; make gives the values of those that are not known."""
        new = wanted.difference(self.young)
        if new and self.size > self.most:
            self.young, self.old, self.size = {}, self.young, 0
            new = wanted
        if new:
            young, old = self.young, self.old
            unknown = [k for k in new if k not in old]
            young.update((k, old[k]) for k in new if k in old)
            if unknown:
                young.update(zip(unknown, make(unknown), strict=True))
            self.size += sum(map(len, new)) + 150 * len(new)
        return self.young

    @classmethod
    def forget(cls) -> None:
        """Empties all of this worker's and gives free memory back; called at a task's end, as workers outlive tasks, stages and queries."""
        for one in cls._all:
            one.young, one.old, one.size = {}, {}, 0
        for clear in at_task_end:
            clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)


#: Further things that a worker drops then.
at_task_end: list[Callable[[], Any]] = []


def slices(batch: pa.RecordBatch, size: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in runs of about so many bytes, which keeps what a worker makes of a run small."""
    rows = max(1, int(batch.num_rows * size / max(size, batch.nbytes)))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def add_columns(df: DataFrame, inputs: dict[str, Column | str], made: T.StructType, function, keep: list[str] | None = None) -> DataFrame:
    """Runs function(record batch) over df's rows and appends the columns it makes.

    inputs: name seen by function -> expression, or the name of a column, which travels once if it is kept as well.
    function gets batches with those columns and gives a list of Arrow arrays, one per field of `made`, as long as the
    batch. Columns of df with a made name give way. What workers remember is forgotten at each task's end.
    """
    names = [c for c in (df.columns if keep is None else keep) if c.lower() not in {f.name.lower() for f in made}]
    kinds = {f.name: f for f in df.schema}
    own = {n: e for n, e in inputs.items() if not (isinstance(e, str) and e in names)}
    feed = df.select(
        *[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(names)],
        *[(F.col(f"`{e}`") if isinstance(e, str) else e).alias(f"in_{n}") for n, e in own.items()],
    )
    schema = T.StructType([T.StructField(f"k{i}", kinds[c].dataType) for i, c in enumerate(names)] + list(made))
    width, wanted, seen_names = len(names), [f.name for f in made], list(inputs)
    places = [width + list(own).index(n) if n in own else names.index(e) for n, e in inputs.items()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in (part for whole in batches for part in slices(whole)):
                seen = pa.RecordBatch.from_arrays([batch.column(k) for k in places], names=seen_names)
                yield pa.RecordBatch.from_arrays([*batch.columns[:width], *function(seen)], names=[*(f"k{i}" for i in range(width)), *wanted])
        finally:
            Remembered.forget()

    out = feed.mapInArrow(run, schema)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(names)], *wanted)
