"""What several operators share: reading the tables, words, digests, and connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.sources.io import materialize

#: Text is worked on in slices of an Arrow batch of about this many bytes.
SLICE_BYTES = 8 << 20
#: Rows of a few numbers that one task takes.
TASK_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sliced(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with the UTF-8 bytes of their texts (null: empty), a bounded number of bytes at a time."""
    for batch in batches:
        start = 0
        while start < batch.num_rows:
            rest = batch.slice(start)
            step = max(1, min(rest.num_rows, int(rest.num_rows * SLICE_BYTES / max(1, rest.nbytes))))
            part = rest.slice(0, step)
            column = part.column(part.schema.get_field_index(text))
            yield part, [x or b"" for x in column.cast(pa.binary()).to_pylist()]
            start += step


def per_text(
    docs: DataFrame, text: str, schema: str, arrow: pa.Schema, make: Callable[[pa.RecordBatch, list[bytes]], list]
) -> DataFrame:
    """``make`` gives the output columns for a slice of rows and their texts; runs where the rows are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in sliced(batches, text):
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) if isinstance(c, list) else c.cast(t.type) for c, t in zip(make(part, texts), arrow, strict=True)], schema=arrow)

    return docs.mapInArrow(run, schema)


def words_column(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, in order; none for null or blank."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def tasks_for(*frames: DataFrame) -> int:
    """How many tasks stored frames of a few numbers a row need: a small one does not need all shuffle partitions."""
    return max(1, *[-(-frame.count() // TASK_ROWS) for frame in frames])


def components(edges: DataFrame, tasks: int | None = None) -> DataFrame:
    """Connected components of the pairs (a, b): node and the smallest node it reaches, as (node, component).

    Rounds of large stars and small stars, each stored in the shared folder; the smallest neighbours are
    stored before the join, so that a node with very many neighbours is an ordinary skewed join. Loops and
    repeated pairs are allowed; an empty frame gives no rows. ``tasks`` is how many the pairs need, if that is known.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = materialize(edges.coalesce(tasks) if tasks else edges)
    if edges.isEmpty():
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    before, tasks = None, tasks or tasks_for(edges)

    def stored(frame: DataFrame) -> DataFrame:
        return materialize(frame.coalesce(tasks))  # the stars never have more than twice these rows

    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low")))
        large = stored(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct())
        least = stored(large.groupBy("a").agg(F.min("b").alias("low")))
        small = large.join(least, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        edges = stored(small.unionByName(least.select("a", F.col("low").alias("b"))).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct().coalesce(tasks)
            )
        before = now
