"""Mixing sources to target weights by systematic sampling; DataFrame functions only.

Sources, in code-point order with null last, weigh 1, 2, 3 and again. They share the size of all documents by weight; a
target stops at `most` times its source's size, and what is over goes to the other sources by weight until none is
above. That fixed point is the level L (the highest at which the next source is not yet full) at which the sum of least(weight x L, most x size) is the whole size, found by a
running sum over the sources, ordered by the level at which each is full.

Every document of a source expects target / source size copies. Documents of a source stand in the order of their size
class (eighths of a power of two) and then of a digest of their id; expected copies are summed along that order, the source's
random offset is added, and a document gets a copy for each integer that its stretch crosses. Classes keep the words
taken near the target though sizes differ. A place in that order is a row number within a slice of a source plus the
number of rows in the slices before it, so a source of any share of the rows is spread over many tasks.

Null text has size 0; a document of size 0 takes its turn like any other and takes no words. A null source is a source
of its own. Rows that repeat are sampled each for itself. An empty table gives an empty table. Other columns are kept,
but for those named like a made column (size, source_size, target, copies, taken).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.llm.common import WORD_PATTERN, written

MOST = 3.0
SEED = "mix-1"
#: Slices of a source and size class: as many hexadecimal digits of the digest as keep a slice near so many rows.
SLICE_ROWS = 500_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, most: float = MOST) -> DataFrame:
    """sizes: source, source_size, n_docs, a row a source. Adds target and offset.

    The windows without a key run over sources, not documents.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    by_level = Window.orderBy("full_at", F.col("source").isNull(), "source")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    after = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    weighed = sizes.withColumn("weight", ((F.row_number().over(by_name) - 1) % 3 + 1).cast("long")).withColumn("full", F.col("source_size") * most)
    levels = weighed.withColumn("full_at", F.col("full") / F.col("weight")).withColumn(
        "level",
        (F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("full").over(before), F.lit(0.0))) / F.sum("weight").over(after),
    )
    level = F.max(F.when(F.col("level") <= F.col("full_at"), F.col("level"))).over(Window.partitionBy())
    filled = levels.withColumn("at", level).withColumn(
        "target",
        F.when(F.col("at").isNull() | (F.col("full_at") < F.col("at")), F.col("full")).otherwise(F.col("weight") * F.col("at")),
    )
    offset = F.conv(
        F.substring(F.md5(F.concat(F.lit(SEED + ":"), F.coalesce(F.col("source"), F.lit("")))), 1, 8),
        16,
        10,
    ).cast("double") / 4294967296.0
    return filled.select("source", "source_size", F.least("target", "full").alias("target"), offset.alias("offset"))


def _key(source: Column) -> Column:
    """A source's name that is never null, so that windows and joins deal rows out by the same columns."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def mix(docs: DataFrame, source: str = "source", text: str = "text", doc_id: str = "doc_id", most: float = MOST) -> DataFrame:
    """docs with size, source_size, target, copies and taken (copies x size)."""
    made = {"size", "source_size", "target", "copies", "taken"}
    kept = [c for c in docs.columns if c.lower() not in made]
    rows = docs.select(
        *[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(kept)],
        _key(F.col(source).cast("string")).alias("source"),
        n_words(F.col(text)).alias("size"),
        F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).alias("digest"),
    )
    rows = rows.withColumn("size_class", F.expr("length(bin(size)) * 8 + (shiftright(size, greatest(length(bin(size)) - 4, 0)) & 7)"))
    keyed = rows.select("source", "size", "size_class", "digest")
    counted = keyed.agg(F.count("*")).first()[0]
    digits = 1
    while counted > SLICE_ROWS * 16**digits and digits < 8:
        digits += 1
    piece = F.substring("digest", 1, digits).alias("slice")
    # as a table: it is read twice, and texts are not to be counted again for that
    slices = written(keyed.groupBy("source", "size_class", piece).agg(F.count("*").alias("n"), F.sum("size").alias("words")))
    sources = slices.groupBy("source").agg(F.sum("words").alias("source_size"))
    order = Window.partitionBy("source").orderBy("size_class", "slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = slices.select("source", "size_class", "slice", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("start"))
    named = sources.select(F.when(F.col("source") != "n", F.substring("source", 2, 1 << 30)).alias("source"), "source_size")
    goals = targets(named, most).withColumn("source", _key(F.col("source")))
    goals = starts.join(goals, "source")
    placed = rows.withColumn("slice", piece).withColumn(
        "place",
        F.row_number().over(Window.partitionBy("source", "size_class", "slice").orderBy("digest", "size")),
    )
    joined = placed.join(goals, ["source", "size_class", "slice"])  # by what the rows are dealt out already
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    place = F.col("start") + F.col("place")
    crossed = F.floor(place * expected + F.col("offset")) - F.floor((place - 1) * expected + F.col("offset"))
    copies = F.least(crossed, F.lit(int(most))).cast("long")
    return joined.withColumn("copies", copies).select(
        *[F.col(f"k{i}").alias(c) for i, c in enumerate(kept)],
        "size",
        "source_size",
        "target",
        "copies",
        (F.col("copies") * F.col("size")).alias("taken"),
    )


def emit(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """Each row of mixed as often as it has copies, with these columns."""
    return mixed.filter("copies > 0").withColumn(
        "copies",
        F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))),
    ).select(*[F.col(f"`{c}`") for c in columns])


ORACLE = rf"""
WITH d AS (SELECT doc_id, source, md5(coalesce(doc_id::VARCHAR, '')) AS digest, len(regexp_extract_all(coalesce(text, ''), '{WORD_PATTERN}'))::BIGINT AS size FROM documents),
c AS (SELECT *, length(bin(size)) * 8 + ((size >> greatest(length(bin(size)) - 4, 0)) & 7) AS size_class FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM c GROUP BY source),
w AS (SELECT source, source_size, ((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::BIGINT AS weight, source_size * 3.0::DOUBLE AS full_size FROM s),
l AS (SELECT *, full_size / weight AS full_at, ((sum(source_size) OVER ())::BIGINT - coalesce(sum(full_size) OVER (ORDER BY full_size / weight, source
IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) / (sum(weight) OVER (ORDER BY full_size / weight, source IS NULL, source ROWS
BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS level FROM w),
a AS (SELECT *, max(CASE WHEN level <= full_at THEN level END) OVER () AS at_level FROM l),
t AS (SELECT source, source_size, least(full_size, CASE WHEN at_level IS NULL OR full_at < at_level THEN full_size ELSE weight * at_level END) AS
target, ('0x' || substr(md5('{SEED}:' || coalesce(source, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS random_offset FROM a),
p AS (SELECT doc_id, source, size, row_number() OVER (PARTITION BY source ORDER BY size_class, digest, size) AS place FROM c),
e AS (SELECT p.doc_id, p.size, p.place, t.source_size, t.target, t.random_offset, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0
END AS expected FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (least(floor(place * expected + random_offset) - floor((place - 1) * expected + random_offset), 3) * size)::BIGINT AS taken FROM e
"""
