"""Best-fit packing of tokenised documents into sequences of bounded length.

Only the histogram of piece lengths (at most as many numbers as a sequence has tokens) leaves the executors. On
it a configuration linear program is solved: a configuration is a set of lengths that fit one sequence, and
configurations must cover the histogram with as few sequences as possible. Multiplicative weights start at the
lengths' sizes and fall for lengths that are covered ahead of schedule; each round a knapsack dynamic program
prices the lengths and gives the configuration of greatest weight. The solution is rounded down, and what is
left is placed by best fit, longest first, on groups of sequences that look alike. The plan says, for each
length, which ranks of its pieces go where; pieces are ranked and looked up on the executors.
"""

from __future__ import annotations

import sys
import types
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortspark.llm.common import sliced, table
from cohortspark.sources.io import materialize

CAPACITY = 2048
END_ID = 0
VOCABULARY = "word_bpe_49k.json"
CACHED_WORDS = 400_000
#: Rounds of the configuration program at most; the weights change slowly, so that configurations stay full; lengths priced in a round; copies of a length; share of a length a round at most.
ROUNDS = 1_200
PRICED = 128
RATE = 0.005
COPIES = 2
STEP = 0.5
#: Share of each length that configurations cover; best fit places the rest in what room there is.
COVER = 0.9
RANK_ROWS = 200_000

# The vocabulary's split pattern, and Latin signs whose case and composition need no table.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
PLAIN = regex.compile("[!-~\u00a1-\u012f\u0132-\u017e]+")


def tokenizer_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Tokens(dict):
    """Little-endian 32-bit ids of a run of non-blank signs; a bounded number of runs is remembered.

    No word of the vocabulary crosses a blank, so a text's ids are those of its runs one after the other. Runs of
    ordinary Latin signs are put in lower case and split by the vocabulary's own pattern here, and only the
    model's merges are asked for; every other run goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.spell = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.pieces: dict[str, bytes] = {}

    def __missing__(self, run: bytes) -> bytes:
        text = run.decode()
        if PLAIN.fullmatch(text) and "<|" not in text:
            made = b"".join([self.pieces.get(x) or self.merged(x) for x in SPLIT.findall(text.lower())])
        else:
            made = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if len(self) < CACHED_WORDS:
            self[run] = made
        return made

    def merged(self, piece: str) -> bytes:
        spelt = piece if piece.isascii() else self.spell(piece)[0][0]
        made = b"".join([x.id.to_bytes(4, "little") for x in self.model.tokenize(spelt)])
        if len(self.pieces) < CACHED_WORDS:
            self.pieces[piece] = made
        return made

    def ids(self, text: bytes) -> bytes:
        return b"".join(map(self.__getitem__, text.split()))


def tokens_of_worker(path: str) -> Tokens:
    """The cache of this Python worker, kept from task to task."""
    kept = sys.modules.setdefault("_cohortspark_tokens", types.ModuleType("_cohortspark_tokens"))
    if path not in kept.__dict__:
        kept.__dict__[path] = Tokens(path)
    return kept.__dict__[path]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PIECES_ARROW = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and the end id, cut where longer than the capacity."""
    path = path or tokenizer_path()
    end = int(end_id).to_bytes(4, "little")
    size = 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = tokens_of_worker(path)
        for part, texts in sliced(batches, "text"):
            rows: list[tuple] = []
            for doc_id, text in zip(part.column(0).to_pylist(), texts, strict=True):
                ids = tokens.ids(text) + end
                for k, at in enumerate(range(0, len(ids), size)):
                    own = ids[at : at + size]
                    rows.append((doc_id, k, at // 4, len(own) // 4, zlib.crc32(own)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), PIECES_ARROW, strict=True)], schema=PIECES_ARROW)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, PIECES)


def knapsack(sizes: np.ndarray, values: np.ndarray, copies: np.ndarray, capacity: int) -> np.ndarray:
    """How often each size is taken in a knapsack of greatest value, each at most ``copies`` times."""
    items = np.repeat(np.arange(len(sizes)), copies)
    best = np.zeros(capacity + 1)
    taken = np.zeros((len(items), capacity + 1), bool)
    for k, i in enumerate(items):
        size = sizes[i]
        with_item = best[:-size] + values[i]
        better = with_item > best[size:]
        taken[k, size:] = better
        best[size:] = np.where(better, with_item, best[size:])
    amounts, room = np.zeros(len(sizes), np.int64), int(np.argmax(best))
    for k in range(len(items) - 1, -1, -1):
        if taken[k, room]:
            amounts[items[k]] += 1
            room -= int(sizes[items[k]])
    return amounts


def configurations(counts: dict[int, int], capacity: int, rounds: int = ROUNDS) -> list[tuple[dict[int, int], float]]:
    """A solution of the configuration program by multiplicative weights: (lengths with amounts, sequences).

    A length's weight is its size times a factor that falls with the share covered so far, so all lengths are
    covered at about the same pace. A round prices the lengths with most volume left and those with most pieces, and uses the configuration
    until one of its lengths is a further half covered.
    """
    sizes = np.array(sorted((x for x in counts if x < capacity), reverse=True), np.int64)
    wanted = np.floor(COVER * np.array([counts[int(x)] for x in sizes], float))
    left, found = wanted.copy(), []
    for _ in range(rounds):
        open_ = np.nonzero(left >= 1)[0]
        by_volume, by_count = np.argsort(-(sizes * left)[open_], kind="stable"), np.argsort(-left[open_], kind="stable")
        priced = open_[np.union1d(by_volume[: PRICED // 2], by_count[: PRICED // 2])]
        if not len(priced):
            break
        own = sizes[priced]
        values = own * np.exp(RATE * ((left / np.maximum(wanted, 1))[priced] - left.sum() / wanted.sum()))
        amounts = knapsack(own, values, np.clip(left[priced], 1, COPIES).astype(int), capacity)
        if own @ amounts < capacity - capacity // 256:
            break  # what is left fills no sequence; best fit does better
        used = np.nonzero(amounts)[0]
        most = np.minimum(left[priced], np.maximum(wanted[priced] * STEP, amounts))
        x = float((most[used] / amounts[used]).min())
        left[priced] -= amounts * x
        found.append(({int(own[i]): int(amounts[i]) for i in used}, x))
    return found


@dataclass
class Group:
    """``count`` sequences that hold the same lengths."""

    content: tuple[int, ...]
    count: int
    room: int


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Group]:
    """Groups of sequences that hold exactly the pieces of a histogram of lengths."""
    left = {int(length): int(n) for length, n in counts.items() if n}
    groups: list[Group] = []
    for amounts, x in configurations(left, capacity):
        k = min(int(x), *(left[length] // a for length, a in amounts.items()))
        if k:
            content = tuple(sorted((length for length, a in amounts.items() for _ in range(a)), reverse=True))
            groups.append(Group(content, k, capacity - sum(content)))
            for length, a in amounts.items():
                left[length] -= k * a
    by_room: dict[int, list[Group]] = {}
    for g in groups:
        by_room.setdefault(g.room, []).append(g)
    for length in sorted(left, reverse=True):
        n = left[length]
        while n:
            room = next((r for r in range(length, capacity + 1) if by_room.get(r)), None)
            if room is None:
                each = capacity // length
                full, rest = divmod(n, each)
                for amount, count in ((each, full), (rest, 1)):
                    if amount and count:
                        made = Group((length,) * amount, count, capacity - amount * length)
                        by_room.setdefault(made.room, []).append(made)
                break
            group = by_room[room].pop()
            each = room // length
            full = min(group.count, n // each)
            if full:
                made = Group(group.content + (length,) * each, full, room - each * length)
                by_room.setdefault(made.room, []).append(made)
                n -= full * each
            if n and group.count > full:
                last = min(n, each)
                made = Group(group.content + (length,) * last, 1, room - last * length)
                by_room.setdefault(made.room, []).append(made)
                n -= last
                full += 1
            if group.count > full:
                by_room[room].append(Group(group.content, group.count - full, room))
    return [g for own in by_room.values() for g in own]


def slots(groups: list[Group]) -> np.ndarray:
    """Rows (length, first rank, first sequence, pieces of the length a sequence, offset), sorted; ranks count from 0."""
    rows, ranks, sequence = [], {}, 0
    for g in groups:
        offset, k = 0, 0
        while k < len(g.content):
            length, amount = g.content[k], 1
            while k + amount < len(g.content) and g.content[k + amount] == length:
                amount += 1
            first = ranks.get(length, 0)
            rows.append((length, first, sequence, amount, offset))
            ranks[length] = first + g.count * amount
            offset += amount * length
            k += amount
        sequence += g.count
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def ranked(stored: DataFrame) -> DataFrame:
    """The pieces with their rank (from 0) among pieces of the same length.

    A length that very many pieces have is ranked in parts of some 200,000 rows, dealt by a hash of the piece.
    """
    parts = max(1, stored.count() // RANK_ROWS)
    dealt = stored.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)))
    sizes = dealt.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")
    numbered = dealt.withColumn("place", F.row_number().over(inside) - 1)
    return numbered.join(sizes, ["length", "part"]).withColumn("rank", F.col("base") + F.col("place")).drop("part", "base", "place")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): every piece of every document has its place.

    Null and empty texts are one end id. Repeated rows and rows without an id are packed like others. An empty
    table gives no rows.
    """
    stored = materialize(pieces(docs, id_col, text_col, path, capacity, end_id))
    counts = {r.length: r.n for r in stored.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    rows = slots(plan(counts, capacity))
    keys = (rows[:, 0] << 44) + rows[:, 1]
    out = pa.schema([*PIECES_ARROW, ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            run = rows[np.searchsorted(keys, (length << 44) + rank, "right") - 1]
            within = rank - run[:, 1]
            sequence, offset = run[:, 2] + within // run[:, 3], run[:, 4] + within % run[:, 3] * length
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(sequence), pa.array(offset)], schema=out)

    found = ranked(stored).select("doc_id", "piece", "start", "length", "ids_crc32", F.col("rank").cast("long").alias("rank"))
    return found.mapInArrow(place, f"{PIECES}, sequence_id long, offset long")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
