"""Line deduplication on levelled sorted runs of line hashes.

A store holds runs: Parquet tables of line hashes, sorted, with the number of documents that hold the line and
the largest id among them. A new batch is reduced to one row a line, merge-anti-joined with the keys of all runs
(what is left is new to the store; the rest only adds to counts) and written as a run of level 0. When a level
has ``fanout`` runs they are merged into one run of the next level, so a store of n batches has a logarithmic
number of runs and every line is rewritten a logarithmic number of times.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.llm.common import table
from cohortspark.sources.io import materialize

MIN_CHARS = 40
MIN_DOCS = 5
BATCHES = 6
FANOUT = 3
BLANKS = " \t\n\x0b\x0c\r"
HASH = ["h1", "h2"]


def line_key(line: Column) -> Column:
    """The line without ASCII blanks at both ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), string.ascii_uppercase, string.ascii_lowercase)


def hashed_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, tk, pos, h1, h2) of the lines whose key has at least ``min_chars`` code points."""
    lines = docs.select("doc_id", F.xxhash64("text").alias("tk"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line"))
    keys = lines.select("doc_id", "tk", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    return keys.select("doc_id", "tk", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), "key").alias("h2"))


class LineRuns:
    """Levels of sorted runs (h1, h2, docs, last, fresh); ``levels`` can be passed on to reopen a store."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT, levels: list[list[DataFrame]] | None = None):
        self.spark, self.fanout, self.levels = spark, fanout, levels or [[]]

    def runs(self) -> DataFrame | None:
        found = [run for level in self.levels for run in level]
        return reduce(DataFrame.unionByName, found) if found else None

    def add(self, lines: DataFrame) -> DataFrame:
        """Takes in the lines (doc_id, h1, h2) of documents that no earlier batch held; gives the batch's own run.

        Its column ``fresh`` is true for lines that no earlier run has.
        """
        batch = lines.select("doc_id", *HASH).distinct().groupBy(*HASH).agg(F.count("*").alias("docs"), F.max("doc_id").alias("last"))
        before = self.runs()
        if before is None:
            run = batch.withColumn("fresh", F.lit(True))
        else:
            batch = materialize(batch)
            keys = before.where("fresh").select(*HASH)
            new = batch.join(keys.hint("merge"), HASH, "left_anti").withColumn("fresh", F.lit(True))
            run = new.unionByName(batch.join(keys.hint("merge"), HASH, "left_semi").withColumn("fresh", F.lit(False)))
        run = materialize(run.sortWithinPartitions(*HASH))
        self.levels[0].append(run)
        self.compact()
        return run

    def compact(self) -> None:
        for k in range(len(self.levels)):
            if len(self.levels[k]) < self.fanout:
                return
            merged = materialize(self.merged(reduce(DataFrame.unionByName, self.levels[k])).sortWithinPartitions(*HASH))
            self.levels[k] = []
            if k + 1 == len(self.levels):
                self.levels.append([])
            self.levels[k + 1].append(merged)

    @staticmethod
    def merged(runs: DataFrame) -> DataFrame:
        return runs.groupBy(*HASH).agg(F.sum("docs").alias("docs"), F.max("last").alias("last"), F.bool_or("fresh").alias("fresh"))

    def frequent(self, min_docs: int) -> DataFrame:
        """(h1, h2, last) of the lines that at least ``min_docs`` documents hold."""
        return self.merged(self.runs()).where(F.col("docs") >= min_docs).select(*HASH, "last")


def split_ids(ids: DataFrame, parts: int) -> list[Column]:
    """Conditions on doc_id that deal the rows to about equal batches, largest ids first."""
    shares = [i / parts for i in range(1, parts)]
    cuts = sorted({int(x) for x in ids.approxQuantile("doc_id", shares, 0.01)}, reverse=True) if shares else []
    edges = [None, *cuts, None]
    found = []
    for high, low in zip(edges, edges[1:], strict=False):
        condition = F.col("doc_id").isNotNull()
        if high is not None:
            condition = condition & (F.col("doc_id") <= high)
        if low is not None:
            condition = condition & (F.col("doc_id") > low)
        found.append(condition)
    return found


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES
) -> DataFrame:
    """The documents with two more columns: __lines (before dropping) and __kept (the lines that stay, an array).

    A line is compared by its key (``line_key``). Keys of at least ``min_chars`` code points that at least
    ``min_docs`` documents hold lose all their lines, except in the document with the largest id. Null and empty
    texts have one empty line. Rows that repeat an id count as one document; rows without an id count for
    nothing and keep their lines. An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    lines = materialize(hashed_lines(rows, min_chars))
    store = LineRuns(spark)
    for condition in split_ids(lines, batches):
        store.add(lines.where(condition))
    dropped = materialize(lines.join(materialize(store.frequent(min_docs)), HASH).where("doc_id <> last").select("doc_id", "tk", "pos"))
    places = dropped.distinct().groupBy(F.col("doc_id").alias("__id"), F.col("tk").alias("__tk")).agg(F.collect_list("pos").alias("__gone"))
    text = F.col(text_col).cast("string")
    joined = docs.join(places, (F.col(id_col).cast("long") == F.col("__id")) & (F.xxhash64(text) == F.col("__tk")), "left")
    kept = F.filter("__lines", lambda line, i: ~F.coalesce(F.array_contains("__gone", i), F.lit(False)))
    return joined.withColumn("__lines", F.split(F.coalesce(text, F.lit("")), "\n")).withColumn("__kept", kept).drop("__id", "__tk", "__gone")


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    n, left = F.size("__lines"), F.size("__kept")
    return dedup_lines(docs).select(
        "doc_id", n.cast("long").alias("n_lines"), (n - left).cast("long").alias("n_dropped"), F.sha2(F.array_join("__kept", "\n"), 256).alias("kept_sha256")
    )


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars", **options) -> DataFrame:
    """The documents with the lines that stay as their text; the character count follows where there is one. Null texts stay null."""
    found = dedup_lines(docs, id_col, text_col, **options)
    text = F.when(F.col(text_col).isNotNull(), F.array_join("__kept", "\n"))
    found = found.withColumn(text_col, text)
    if chars_col in docs.columns:
        found = found.withColumn(chars_col, F.when(text.isNotNull(), F.length(F.col(text_col))).otherwise(F.col(chars_col)).cast(docs.schema[chars_col].dataType))
    return found.select(*docs.columns)


OP8_SQL = """
with l as (
  select doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from (select doc_id, unnest(lines) as line, generate_subscripts(lines, 1) as i
    from (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents) s) t
),
frequent as (select key, max(doc_id) as last from l where length(key) >= 40 group by key having count(distinct doc_id) >= 5),
marked as (select l.*, frequent.key is not null and l.doc_id <> last as gone from l left join frequent on l.key = frequent.key)
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '')) as kept_sha256
from marked group by doc_id"""
