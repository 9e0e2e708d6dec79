"""SimHash near duplicates, found with chains of segments on a ring (pigeonring filter).

The 64 bits are cut into ``2 * distance + 3`` segments that form a ring. If two fingerprints differ in at
most ``distance`` bits, some start on the ring exists from which every run of consecutive segments stays
within its proportional share of the budget: ``l`` segments hold at most ``floor(l * distance / m)`` of the
differing bits. The first segments of such a chain have budget zero, so they are a key for a hash join; the
later budgets prune the candidates before the full Hamming distance is taken.

Only distinct fingerprints are joined, so exact copies cost nothing. A key that more than ``BUCKET``
fingerprints share is not paired up: its members are grouped by every fingerprint at distance one of them.
Two members share such a neighbour exactly when they differ in at most two bits, so linking each group to its
smallest member loses no link and makes at most 65 rows per fingerprint.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.llm.common import components, per_text, table
from cohortspark.sources.io import materialize

SEED = 42
BUCKET = 32
CHUNK = 1 << 16
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_OFFSETS = (np.arange(8) * 256).astype(np.int64)


def simhash(text: bytes, width: int = 3) -> int:
    """Signed 64-bit SimHash of the word shingles of a text, repeats included; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < width:
        shingles = iter([b" ".join(words)])
        total = 1
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
        total = len(words) - width + 1
    counts = np.zeros(2048, np.int64)
    for start in range(0, total, CHUNK):
        size = min(CHUNK, total - start)
        hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s, _ in zip(shingles, range(size))), "<u8", size)
        counts += np.bincount((hashes.view(np.uint8).reshape(-1, 8) + _OFFSETS).ravel(), minlength=2048)
    ones = np.einsum("pv,vb->pb", counts.reshape(8, 256), _BITS).ravel()
    return int(np.packbits(2 * ones > total, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, fp): the SimHash of each text. A null or blank text has fingerprint 0. Rows without an id are left out."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    return per_text(rows, "text", "doc_id long, fp long", schema, lambda part, texts: [part.column(0), [simhash(t, width) for t in texts]])


def ring(segments: int) -> list[int]:
    """Bit masks of the segments, as even as 64 bits allow."""
    cuts = [64 * i // segments for i in range(segments + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:], strict=False)]


def chains(distance: int) -> list[list[tuple[int, int]]]:
    """For each start on the ring: (bits of the chain so far, bits that may differ there), for every length."""
    m = 2 * distance + 3
    masks = ring(m)
    found = []
    for start in range(m):
        chain, prefix = 0, []
        for length in range(1, m + 1):
            chain |= masks[(start + length - 1) % m]
            prefix.append((chain, length * distance // m))
        found.append(prefix)
    return found


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def links(classes: DataFrame, distance: int = 2, bucket: int = BUCKET) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints ``fp`` that join all fingerprints linked at ``distance`` (0 to 2).

    Pairs of small buckets are all given; a large bucket's fingerprints are joined through their smallest
    common member, which links the same components.
    """
    if not 0 <= distance <= 2:
        raise ValueError("distance must be 0, 1 or 2")
    starts = chains(distance)
    keys = [F.struct(F.lit(i).alias("start"), F.col("fp").bitwiseAND(F.lit(signed([c for c, budget in chain if budget == 0][-1]))).alias("key")) for i, chain in enumerate(starts)]
    keyed = classes.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.start", "k.key")
    sizes = materialize(keyed.groupBy("start", "key").agg(F.count("*").alias("n")).where("n > 1"))
    shared = materialize(keyed.join(sizes, ["start", "key"]))
    small = shared.where(F.col("n") <= bucket).drop("n")
    pairs = small.withColumnRenamed("fp", "a").join(small.withColumnRenamed("fp", "b"), ["start", "key"]).where("a < b")
    differing = F.col("a").bitwiseXOR(F.col("b"))
    within = F.lit(False)
    for i, chain in enumerate(starts):
        fits = F.lit(True)
        for bits, budget in chain:
            if budget:
                fits = fits & (F.bit_count(differing.bitwiseAND(F.lit(signed(bits)))) <= budget)
        within = within | ((F.col("start") == i) & fits)
    pairs = pairs.where(within).where(F.bit_count(differing) <= distance).select("a", "b").distinct()
    dense = shared.where(F.col("n") > bucket).select("fp").distinct()
    if distance == 0:
        return pairs
    flips = [F.lit(0).cast("long")] + [F.lit(signed(1 << i)) for i in range(64)] if distance == 2 else None
    if flips is None:  # at distance one two fingerprints meet in the one of them that has the bit cleared
        near = dense.select("fp", F.explode(F.array(F.col("fp"), *[F.col("fp").bitwiseAND(F.lit(signed(((1 << 64) - 1) ^ (1 << i)))) for i in range(64)])).alias("near")).distinct()
        near = near.join(dense.select(F.col("fp").alias("near")), "near")
    else:
        near = dense.select("fp", F.explode(F.array(*flips)).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("near"))
    stars = near.groupBy("near").agg(F.min("fp").alias("a"), F.max("fp").alias("z"), F.count("*").alias("n")).where("n > 1")
    lone = stars.where("n = 2").select("a", F.col("z").alias("b"))
    full = near.join(stars.where("n > 2").select("near", "a"), "near").where("fp <> a").select("a", F.col("fp").alias("b"))
    return pairs.unionByName(lone).unionByName(full)


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, distance: int = 2
) -> DataFrame:
    """(doc_id, fp, component_id): each document's fingerprint and the smallest id it is linked to, itself included.

    Null and blank texts have fingerprint 0 and link like others. Rows without an id are left out; repeated rows
    and ids stay as they are and share their component. An empty table gives no rows.
    """
    prints = materialize(fingerprints(docs, id_col, text_col, width))
    classes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    found = materialize(components(links(classes.select("fp"), distance)))
    joined = classes.join(found, classes.fp == found.node, "left").select("fp", "first_id", F.coalesce("component", "fp").alias("component"))
    lowest = joined.groupBy("component").agg(F.min("first_id").alias("component_id"))
    labels = materialize(joined.join(lowest, "component").select("fp", "component_id"))
    return prints.join(labels, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, distance: int = 2) -> DataFrame:
    """The documents without near duplicates: of each group the one with the smallest id stays, with all its columns.

    Rows that repeat an id are copies of one document, so one of them stays; rows without an id go.
    """
    kept = near_duplicates(docs, id_col, text_col, width, distance).where("doc_id = component_id").select(F.col("doc_id").alias("__kept")).distinct()
    return docs.join(kept, F.col(id_col) == F.col("__kept"), "left_semi").dropDuplicates([id_col])


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
