"""Document fingerprints: bottom-k sketches of word shingles, made of Spark's own functions.

A sketch is the sorted array of the k smallest different 64-bit hashes of a text's shingles. The sketch of a
union of shingle sets is the k smallest of the two arrays' union, so parts can be sketched apart and merged.
"""

from __future__ import annotations

from collections.abc import Callable
from math import isqrt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortspark.llm.common import table, words_column
from cohortspark.sources.io import materialize

K = 128
SHINGLE = 5
SEGMENTS = 64


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` applied to a value that is computed once a row."""
    return F.get(F.transform(F.array(value), use), 0)


def shingle_hashes(text: Column, width: int = SHINGLE) -> Column:
    """Hashes of all word shingles; of the whole sequence if there are fewer words; none without words."""

    def shingles(h: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.size(h) - width), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(width)]))
        return F.when(F.size(h) == 0, F.array().cast("array<bigint>")).when(F.size(h) < width, F.array(F.xxhash64(h))).otherwise(each)

    return let(F.transform(words_column(text), lambda w: F.xxhash64(w)), shingles)


def sketch(text: Column, k: int = K, width: int = SHINGLE) -> Column:
    return F.slice(F.sort_array(F.array_distinct(shingle_hashes(text, width))), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the two texts' shingles together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def distinct_count(s: Column, k: int = K) -> Column:
    """Estimated number of different shingles; exact below k."""
    place = (F.get(s, F.lit(k - 1)).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(s) < k, F.size(s).cast("double")).otherwise((k - 1) / place)


def common(a: Column, b: Column, k: int = K) -> Column:
    """(share of the merged sketch that both have, merged sketch's estimated size)"""
    return let(merge(a, b, k), lambda u: F.struct(
        F.when(F.size(u) == 0, 1.0).otherwise(F.size(F.array_intersect(F.array_intersect(u, a), b)) / F.size(u)).alias("share"),
        distinct_count(u, k).alias("size"),
    ))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity; 1 for two texts without words."""
    return common(a, b, k)["share"]


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has too; 1 if a has none."""
    shared = common(a, b, k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), shared["share"] * shared["size"] / distinct_count(a, k)))


def as_text(s: Column) -> Column:
    return F.array_join(F.transform(s, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def id_bucket(ids: DataFrame) -> tuple[Column, int]:
    """A column that deals doc_id to ranges of about equal numbers of rows, and their number at most.

    Ids are cut at up to 63 quantiles, and each piece into ranges of equal width, so a few far-off ids do not
    put the others into one range. With n rows a range has about sqrt(n) of them, 1024 at least.
    """
    n = ids.count()
    if not n:
        return F.lit(0).cast("long"), 1
    cuts = [i / SEGMENTS for i in range(SEGMENTS + 1)]
    edges = sorted(set(ids.agg(F.percentile_approx("doc_id", cuts, 100 * SEGMENTS)).first()[0]))
    ranges = max(1, -(-n // (max(1024, isqrt(n)) * SEGMENTS)))

    def place(low: int, high: int) -> Column:
        if high - low <= 1:
            a, b = edges[low], edges[min(high, len(edges) - 1)]
            step = max(1, -(-(b - a) // ranges))
            inside = F.floor((F.col("doc_id") - F.lit(a)) / F.lit(step))
            return F.lit(low * ranges) + F.greatest(F.lit(0), F.least(F.lit(ranges - 1), inside)).cast("long")
        middle = (low + high) // 2
        return F.when(F.col("doc_id") < F.lit(edges[middle]), place(low, middle)).otherwise(place(middle, high))

    return place(0, len(edges)), len(edges) * ranges


def with_next(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows (doc_id, ...) with ``next_<column>`` of the row that follows by ascending doc_id; after the last, the first.

    One exchange of the rows by ranges of ids; only each range's first row is looked up for the range before it.
    Rows that repeat an id follow each other by ``tie``.
    """
    bucket, _ = id_bucket(rows.select("doc_id"))
    dealt = rows.withColumn("bucket", bucket)
    order = Window.orderBy("bucket")
    firsts = dealt.groupBy("bucket").agg(F.min(F.struct("doc_id", "tie")).alias("f"))
    firsts = materialize(firsts.select("bucket", "f.*"))
    after = F.coalesce(F.lead(F.struct("doc_id", "tie")).over(order), F.first(F.struct("doc_id", "tie")).over(order))
    follows = firsts.select(F.col("bucket").alias("before"), after.alias("f")).select("before", "f.*")
    follows = materialize(rows.join(materialize(follows), ["doc_id", "tie"]).dropDuplicates(["before"]).select(F.col("before").alias("bucket"), F.struct(*columns).alias("head")))
    inside = Window.partitionBy("bucket").orderBy("doc_id", "tie")
    found = dealt.withColumn("following", F.lead(F.struct(*columns)).over(inside)).join(follows.hint("merge"), "bucket", "left")
    found = found.withColumn("following", F.coalesce("following", "head"))
    return found.select(*rows.columns, *[F.col("following")[c].alias(f"next_{c}") for c in columns])


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, width: int = SHINGLE) -> DataFrame:
    """(doc_id, text, edited, sketch, edited_sketch, next_sketch) of every document.

    The edited text has the last half of the code points replaced by the first as many of the next document. Null
    texts are empty; texts without words have an empty sketch; rows without an id are left out; of rows that
    repeat an id, the one with the smaller text hash comes first.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.where("doc_id is not null").withColumn("tie", F.xxhash64("text"))
    found = with_next(rows.withColumn("sketch", sketch(F.col("text"), k, width)), ["text", "sketch"])
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half))
    found = found.select("doc_id", "text", edited.alias("edited"), "sketch", "next_sketch")
    return found.withColumn("edited_sketch", sketch(F.col("edited"), k, width))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = edited_pairs(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        containment(F.col("edited_sketch"), F.col("sketch")).alias("edited_contained"),
        distinct_count(F.col("sketch")).alias("distinct_shingles"),
    )
