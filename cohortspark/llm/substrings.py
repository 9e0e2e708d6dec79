"""Removal of repeated passages: Rabin-Karp hashes of fixed-length word windows, counted in Spark.

Every window of every document is hashed by a rolling polynomial over 64-bit word hashes. Moving one row per
word through a shuffle is what limits this at scale, so windows are first told apart by a shorter rolling hash:
the smallest hash of ``anchor`` words inside a window is the same wherever that window occurs, so a window can
only repeat if its smallest inner hash occurs twice. About one word in twelve starts such a smallest hash;
these are counted over all documents, and the full windows are then counted for those, and only those, whose
smallest hash occurs twice. Nothing is sampled: the first count drops only windows that cannot repeat.

Equal texts are worked on once, as a text that occurs twice. Windows are compared by 128 bits of hash.
Overlapping repeated windows merge into maximal removal intervals.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.llm.common import per_text, table
from cohortspark.sources.io import materialize

WINDOW = 35
ANCHOR = 12
CACHED_WORDS = 1_000_000
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


class WordHashes(dict):
    """64-bit hash of a word; the first million different words of a task are remembered."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(self) < CACHED_WORDS:
            self[word] = value
        return value


class Rolling:
    """Rabin-Karp hashes modulo 2**64 of all runs of k words, from prefix sums and powers of an odd base."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.powers = self.inverses = np.ones(1, np.uint64)

    def prefix(self, hashes: np.ndarray) -> np.ndarray:
        if len(self.powers) < len(hashes) + 1:
            steps = np.full(2 * len(hashes) + 2, self.base, np.uint64)
            steps[0] = 1
            self.powers = np.cumprod(steps)
            steps[1:] = self.inverse
            self.inverses = np.cumprod(steps)
        sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * self.powers[: len(hashes)], out=sums[1:])
        return sums

    def runs(self, sums: np.ndarray, k: int) -> np.ndarray:
        n = len(sums) - k
        return mixed((sums[k:] - sums[:n]) * self.inverses[:n]) if n > 0 else np.zeros(0, np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    """The smallest of every ``size`` consecutive values."""
    if len(x) < size:
        return x[:0]
    have = 1
    while 2 * have <= size:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    rest = size - have
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


class Windows:
    """Words of a text with the hashes of its windows."""

    def __init__(self, window: int, anchor: int):
        self.window, self.anchor = window, min(anchor, window)
        self.words, self.first, self.second = WordHashes(), Rolling(BASES[0]), Rolling(BASES[1])

    def hashes(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))

    def smallest(self, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All anchor hashes, and the smallest of them in each window."""
        anchors = self.first.runs(sums, self.anchor)
        return anchors, sliding_min(anchors, self.window - self.anchor + 1)


def digest(words: list[bytes]) -> bytes:
    return hashlib.sha256(b" ".join(words)).digest()


STATS = "doc_id long, tk long, t1 long, t2 long, n_words long, sha binary, anchor array<long>, n array<byte>"
STATS_ARROW = pa.schema([("doc_id", pa.int64()), ("tk", pa.int64()), ("t1", pa.int64()), ("t2", pa.int64()), ("n_words", pa.int64()), ("sha", pa.binary()), ("anchor", pa.list_(pa.int64())), ("n", pa.list_(pa.int8()))])


def _stats(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """One row a document: size, digest, and the different smallest anchors of its windows with 1 or 2 (or more) places."""
    tool = []

    def make(part: pa.RecordBatch, texts: list[bytes]) -> list:
        if not tool:
            tool.append(Windows(window, anchor))
        size, sha, t1, t2, found, places = [], [], [], [], [], []
        for text in texts:
            words = text.split()
            size.append(len(words))
            sha.append(digest(words))
            t1.append(int.from_bytes(sha[-1][:8], "little", signed=True))
            t2.append(int.from_bytes(sha[-1][8:16], "little", signed=True))
            if len(words) < window:
                found.append([])
                places.append([])
                continue
            anchors, least = tool[0].smallest(tool[0].first.prefix(tool[0].hashes(words)))
            least = np.unique(least)
            values, counts = np.unique(anchors, return_counts=True)
            found.append(least.view(np.int64))
            places.append(np.minimum(counts[np.searchsorted(values, least)], 2).astype(np.int8))
        return [part.column(0), part.column(1), t1, t2, size, sha, found, places]

    return per_text(docs, "text", STATS, STATS_ARROW, make)


CANDIDATES = "row long, text binary, h1 array<long>, h2 array<long>, n array<byte>"
CANDIDATES_ARROW = pa.schema([("row", pa.int64()), ("text", pa.binary()), ("h1", pa.list_(pa.int64())), ("h2", pa.list_(pa.int64())), ("n", pa.list_(pa.int8()))])


def _candidates(texts: DataFrame, window: int, anchor: int) -> DataFrame:
    """The different windows of a text whose smallest anchor occurs twice, with 1 or 2 (or more) places."""
    tool = []

    def make(part: pa.RecordBatch, texts: list[bytes]) -> list:
        if not tool:
            tool.append(Windows(window, anchor))
        own, h1, h2, places = tool[0], [], [], []
        repeated = part.column(part.schema.get_field_index("anchors")).to_pylist()
        many = part.column(part.schema.get_field_index("m")).to_pylist()
        for text, wanted, m in zip(texts, repeated, many, strict=True):
            hashes = own.hashes(text.split())
            sums = own.first.prefix(hashes)
            at = np.nonzero(np.isin(own.smallest(sums)[1], np.array(wanted, np.int64).view(np.uint64)))[0]
            first, where, counts = np.unique(own.first.runs(sums, window)[at], return_index=True, return_counts=True)
            h1.append(first.view(np.int64))
            h2.append(own.second.runs(own.second.prefix(hashes), window)[at[where]].view(np.int64))
            places.append(np.minimum(counts * min(m, 2), 2).astype(np.int8))
        return [part.column(0), pa.array(texts, pa.binary()), h1, h2, places]

    return per_text(texts, "text", CANDIDATES, CANDIDATES_ARROW, make)


def covered(starts: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Maximal intervals (start, end) that the windows at the given sorted starts cover."""
    if not len(starts):
        return []
    cut = np.nonzero(np.diff(starts) > window)[0]
    return list(zip(starts[np.r_[0, cut + 1]].tolist(), (starts[np.r_[cut, len(starts) - 1]] + window).tolist(), strict=True))


RESULT = "row long, n_removed long, spans array<struct<start:long,end:long>>, kept string, kept_sha binary"
RESULT_ARROW = pa.schema([("row", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.string()), ("kept_sha", pa.binary())])


def _removed(texts: DataFrame, window: int, anchor: int) -> DataFrame:
    tool = []

    def values(part: pa.RecordBatch, column: str, i: int) -> np.ndarray:
        own = part.column(part.schema.get_field_index(column))[i].values
        return np.zeros(0, np.uint64) if own is None else own.to_numpy().view(np.uint64)

    def make(part: pa.RecordBatch, texts: list[bytes]) -> list:
        if not tool:
            tool.append(Windows(window, anchor))
        own, removed, spans, kept, sha = tool[0], [], [], [], []
        for i, text in enumerate(texts):
            words = text.split()
            all_windows = own.first.runs(own.first.prefix(own.hashes(words)), window)
            repeated = np.setdiff1d(values(part, "h1", i), values(part, "once", i))
            found = covered(np.nonzero(np.isin(all_windows, repeated))[0], window)
            left, end = [], 0
            for a, b in found:
                left += words[end:a]
                end = b
            left += words[end:]
            removed.append(len(words) - len(left))
            spans.append([{"start": a, "end": b} for a, b in found])
            kept.append(b" ".join(left).decode())
            sha.append(digest(left))
        return [part.column(0), removed, spans, kept, sha]

    return per_text(texts, "text", RESULT, RESULT_ARROW, make)


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR
) -> DataFrame:
    """One row a document: doc_id, n_words, n_removed, spans, kept, kept_sha.

    ``spans`` are maximal intervals of word positions covered by windows whose words also occur elsewhere (in
    another document or another place of the same one), judged on the input; ``kept`` is what is left of texts
    that lose words, joined by one space, and null where nothing is removed; ``kept_sha`` is its SHA-256 either
    way. Null and blank texts have no words. Repeated rows are documents of their own, so they remove each
    other's windows; rows without an id are left out; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    rows = rows.select("doc_id", F.xxhash64("text").alias("tk"), "text")
    stats = materialize(_stats(rows, window, anchor).withColumn("row", F.monotonically_increasing_id()))
    texts = stats.groupBy("t1", "t2").agg(F.min(F.struct("row", "doc_id", "tk", "anchor", "n")).alias("r"), F.count("*").alias("m"))
    texts = materialize(texts.select("t1", "t2", "r.*", "m"))
    anchors = texts.select("row", "m", F.explode(F.arrays_zip("anchor", "n")).alias("a")).select("row", F.col("a.anchor").alias("anchor"), (F.col("a.n") * F.least("m", F.lit(2))).alias("n"))
    twice = materialize(anchors.groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor"))
    hits = anchors.select("row", "anchor").join(twice, "anchor").groupBy("row").agg(F.collect_list("anchor").alias("anchors"))
    hits = materialize(texts.select("row", "doc_id", "tk", "m").join(hits, "row"))
    found = materialize(_candidates(rows.join(hits, ["doc_id", "tk"]).select("row", "text", "m", "anchors"), window, anchor))
    windows = found.select("row", F.explode(F.arrays_zip("h1", "h2", "n")).alias("w")).select("row", "w.h1", "w.h2", "w.n")
    # a window that occurs once names its text, so counting alone tells each text which candidates do not repeat
    once = windows.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.min("row").alias("row")).where("n = 1")
    once = once.groupBy("row").agg(F.collect_list("h1").alias("once"))
    result = _removed(found.select("row", "text", "h1").join(once, "row", "left").select("row", "text", "h1", "once"), window, anchor)
    result = result.where("n_removed > 0").dropDuplicates(["row"])  # of repeated rows, which have one text
    result = materialize(result.join(texts.select("row", "t1", "t2"), "row").drop("row"))
    return stats.select("doc_id", "t1", "t2", "n_words", "sha").join(result, ["t1", "t2"], "left").select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), "spans", "kept", F.coalesce("kept_sha", "sha").alias("kept_sha")
    )


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.lower(F.hex("kept_sha")).alias("kept_sha256"))


OP4_SQL = r"""
with w as (
  select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as words
  from documents
),
starts as (
  select doc_id, i, array_to_string(words[i : i + 34], ' ') as win
  from (select doc_id, words, unnest(range(1, len(words) - 33)) as i from w where len(words) >= 35) t
),
repeated as (select doc_id, i from starts where win in (select win from starts group by win having count(*) > 1)),
hit as (select distinct doc_id, j from (select doc_id, unnest(range(i, i + 35)) as j from repeated) t),
lost as (select doc_id, list(j) as js, count(*) as n_removed from hit group by doc_id)
select w.doc_id, cast(len(words) as bigint) as n_words, coalesce(n_removed, 0) as n_removed,
  sha256(array_to_string(case when js is null then words
    else list_filter(words, lambda x, k: not list_contains(js, k)) end, ' ')) as kept_sha256
from w left join lost on w.doc_id = lost.doc_id"""
