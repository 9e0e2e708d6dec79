"""Byte-level BPE: ranked merges folded by Spark's higher-order functions, and decoding by concatenation.

A text is cut into words by the vocabulary's pattern. A word is an array of its bytes; a step of the fold looks up
the ranks of the neighbouring pairs in a literal rank map, joins the leftmost pair of lowest rank, and looks up
the two pairs this makes. The fold runs on distinct words: words are counted over all documents, and those
frequent enough to be at most ``HEAD`` (those met once in a million words don't count) are folded once and sent to every task, so no text and no word occurrence is
shuffled at any size of the corpus. Rare words are met where they occur: with ``fold_all`` they are left open,
folded by the same expression in the same pass, and filled in; else the same steps run on arrays of many words at
once in the task, which takes a tenth of the time.

The fold's work grows with the square of a word's length; words of more than ``LONG`` bytes (runs of letters or
signs without a blank) are merged through a heap in the task, by the same ranks.
"""

from __future__ import annotations

import base64
import heapq
import json
import re
import sys
import types
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.llm.common import sliced, table
from cohortspark.sources.io import materialize

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Distinct words sent to the tasks at most; each has at most ``LONG`` bytes, so this bounds the bytes as well.
HEAD = 1 << 18
LONG = 64
BUCKETS = 1 << 13
DIGITS = 9
PLACES = 1 << 10
NO_PAIR = (1 << 31) - 1
HOLE = 1 << 31
CACHED_UNITS = 150_000
_ENDS = frozenset(".,;:!?")  # signs that are a word of their own after letters
_EDGE = re.compile(r"(?<=\S) (?=\S)")
_BLANKS = re.compile(r"\s{3}|\s\s\Z")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load_ranks(path: str | None = None) -> dict[bytes, int]:
    """Byte pieces with their ranks; each of the 256 bytes has to be a piece."""
    with open(path or vocabulary_path(), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    missing = [i for i in range(256) if bytes([i]) not in ranks]
    if missing:
        raise ValueError(f"The vocabulary lacks the bytes {missing[:5]}.")
    return ranks


def rank_map(ranks: dict[bytes, int]) -> Column:
    """The ranks as a literal: an array of short texts ``|piece in hex:rank``, by CRC-32 of the piece.

    Spark folds it into a constant. Texts keep it small to send with a task, which maps as objects are not.
    """
    buckets = [""] * BUCKETS
    for piece, rank in ranks.items():
        buckets[zlib.crc32(piece) % BUCKETS] += f"|{piece.hex().upper()}:{rank:0{DIGITS}d}"
    return F.from_json(F.lit(json.dumps(buckets, separators=(",", ":"))), "array<string>")


def let(value: Column, body) -> Column:
    """A value used several times in a lambda, computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def folded(word: Column, ranks: Column) -> Column:
    """The ids of a word (binary): ranked merges folded over its bytes. An empty word has none."""

    def rank(map_: Column, piece: Column) -> Column:
        bucket = F.get(map_, F.pmod(F.crc32(piece), F.lit(BUCKETS)).cast("int"))
        found = lambda at: F.when(at > 0, F.substring(bucket, at + 2 * F.length(piece) + 2, F.lit(DIGITS)).cast("long")).otherwise(F.lit(NO_PAIR).cast("long"))
        return let(F.instr(bucket, F.concat(F.lit("|"), F.hex(piece), F.lit(":"))), found)

    def place(pairs: Column) -> Column:
        """Where the leftmost pair of lowest rank is, from 1; 0 if no pair can be joined."""
        least = F.array_min(F.transform(pairs, lambda r, i: r * PLACES + i))
        return let(least, lambda x: F.when(x < NO_PAIR * PLACES, F.pmod(x, F.lit(PLACES)).cast("int") + 1).otherwise(F.lit(0)))

    def merged(map_: Column, parts: Column, pairs: Column, at: Column, joined: Column) -> Column:
        size = F.size(pairs)
        # a pair before and a pair after the joined one, where there are such
        before = F.when(at > 1, F.concat(F.slice(pairs, F.lit(1), at - 2), F.array(rank(map_, F.concat(F.get(parts, at - 2), joined))))).otherwise(none)
        after = F.when(at < size, F.concat(F.array(rank(map_, F.concat(joined, F.get(parts, at + 1)))), F.slice(pairs, at + 2, size))).otherwise(none)
        rest = F.concat(F.slice(parts, F.lit(1), at - 1), F.array(joined), F.slice(parts, at + 2, size))
        return let(F.concat(before, after), lambda now: F.struct(rest.alias("parts"), now.alias("pairs"), place(now).alias("at")))

    none = F.array().cast("array<bigint>")

    def ids(map_: Column) -> Column:
        size = F.length(word)
        later = F.when(size > 1, F.sequence(F.lit(1), size - 1)).otherwise(F.array().cast("array<int>"))
        single = F.transform(F.sequence(F.lit(1), size), lambda i: F.substring(word, i, F.lit(1)))
        start = let(F.transform(later, lambda i: rank(map_, F.substring(word, i, F.lit(2)))), lambda pairs: F.struct(single.alias("parts"), pairs.alias("pairs"), place(pairs).alias("at")))
        joined = lambda s: F.concat(F.get(s.parts, s.at - 1), F.get(s.parts, s.at))
        step = lambda s, _: F.when(s.at > 0, let(joined(s), lambda j: merged(map_, s.parts, s.pairs, s.at, j))).otherwise(s)
        merges = F.aggregate(later, start, step, lambda s: F.transform(s.parts, lambda p: rank(map_, p)))
        return F.when(size == 0, none).otherwise(let(rank(map_, word), lambda whole: F.when(whole < NO_PAIR, F.array(whole)).otherwise(merges)))

    return let(ranks, ids)


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a word of any length by the same merges: a heap of pairs, leftmost first among equal ranks."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(rank, i, i + 2) for i in range(n - 1) if (rank := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i]
        if j < 0 or j >= n or end[j] != stop:  # one of the two is gone or has grown
            continue
        end[i], end[j] = stop, -1
        if stop < n:
            before[stop] = i
            if (rank := ranks.get(word[i : end[stop]])) is not None:
                heapq.heappush(heap, (rank, i, end[stop]))
        if (p := before[i]) >= 0 and (rank := ranks.get(word[p:stop])) is not None:
            heapq.heappush(heap, (rank, p, stop))
    found, i = [], 0
    while i < n:
        found.append(ranks[word[i : end[i]]])
        i = end[i]
    return found


class Ranks(dict):
    """Ranks of pieces, and the piece that two neighbours make as sorted arrays for many words at once."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__(ranks)
        self.packed = {piece: rank.to_bytes(4, "little") for piece, rank in ranks.items()}
        self.single = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        made = [(ranks[piece[:i]] << 32 | ranks[piece[i:]], rank) for piece, rank in ranks.items() for i in range(1, len(piece)) if piece[:i] in ranks and piece[i:] in ranks]
        pairs = np.array(made, np.int64).reshape(-1, 2)
        pairs = pairs[np.argsort(pairs[:, 0])]
        self.keys, self.made = np.ascontiguousarray(pairs[:, 0]), np.ascontiguousarray(pairs[:, 1])

    def together(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank (and id) of the piece that two neighbouring ids make; ``NO_PAIR`` if they make none."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.made[at], NO_PAIR)

    def merge_many(self, words: list[bytes]) -> list[bytes]:
        """The packed ids of short words: the steps of ``folded`` on all words of about one length at once."""
        found: dict[int, bytes] = {}
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        for start in range(0, len(order), 8192):
            rows = order[start : start + 8192]
            self._merge(rows, [words[i] for i in rows], found)
        return [found[i] for i in range(len(words))]

    def _merge(self, places: list[int], words: list[bytes], found: dict[int, bytes]) -> None:
        for i, word in zip(places, words, strict=True):
            if word in self.packed or not word:
                found[i] = self.packed.get(word, b"")
        live = [(i, w) for i, w in zip(places, words, strict=True) if i not in found]
        if not live:
            return
        size = np.array([len(w) for _, w in live])
        width = int(size.max())
        ids = self.single[np.frombuffer(b"".join(w.ljust(width, b"\0") for _, w in live), np.uint8)].reshape(-1, width)
        columns = np.arange(width - 1)
        ranks = np.where(columns < size[:, None] - 1, self.together(ids[:, :-1], ids[:, 1:]), NO_PAIR)
        which = np.array([i for i, _ in live])
        while len(which):
            at = ranks.argmin(axis=1)
            row = np.arange(len(which))
            best = ranks[row, at]
            done = best == NO_PAIR
            if done.any():
                packed = ids[done].astype("<u4")
                for k, (i, n) in enumerate(zip(which[done].tolist(), size[done].tolist(), strict=True)):
                    found[i] = packed[k, :n].tobytes()
                keep = ~done
                ids, ranks, size, which, at, best = ids[keep], ranks[keep], size[keep], which[keep], at[keep], best[keep]
                row = np.arange(len(which))
                if not len(which):
                    return
            ids[row, at] = best
            # what stands behind the joined pair moves up by one
            if ids.shape[1] > 2:
                ids = np.where(np.arange(ids.shape[1] - 1) <= at[:, None], ids[:, :-1], ids[:, 1:])
                ranks = np.where(np.arange(ranks.shape[1] - 1) < at[:, None], ranks[:, :-1], ranks[:, 1:])
            else:
                ids, ranks = ids[:, :1], np.full((len(which), 1), NO_PAIR)
                size = size - 1
                continue
            size = size - 1
            back = np.nonzero(at > 0)[0]
            ranks[back, at[back] - 1] = self.together(ids[back, at[back] - 1], ids[back, at[back]])
            ahead = np.nonzero(at < size - 1)[0]
            ranks[ahead, at[ahead]] = self.together(ids[ahead, at[ahead]], ids[ahead, at[ahead] + 1])
            last = np.nonzero(at == size - 1)[0]
            last = last[at[last] < ranks.shape[1]]
            ranks[last, at[last]] = NO_PAIR


class Splitter:
    """Words of a text by the vocabulary's pattern, letters and numbers as the tokenizer library knows them.

    A text is first cut before each blank and around each line feed, where no word can cross unless three or more
    blanks and line feeds follow each other or two end the text. Most of these units are plain letters, perhaps with
    one sign of punctuation, and need no pattern.
    """

    def __init__(self, pattern: str, other: str, exact: str):
        self.pattern, self.exact = regex.compile(pattern), regex.compile(exact, regex.V1)
        self.other = regex.compile(other) if other else None

    def words(self, unit: str) -> list[bytes]:
        """The words of a unit, given with the blank before it."""
        if unit.isascii():
            bare = unit[1:] if unit[:1] == " " else unit
            if bare.isalpha():
                return [unit.encode()]
            if bare[-1:] in _ENDS and bare[:-1].isalpha():
                return [unit[:-1].encode(), bare[-1].encode()]
        elif self.other is not None and self.other.search(unit):
            return [w.encode() for w in self.exact.findall(unit)]
        return [w.encode() for w in self.pattern.findall(unit)]

    @staticmethod
    def units(text: str) -> list[str]:
        """The units of a text, in order, each with the blank before it."""
        if "\0" in text or _BLANKS.search(text):
            first, *rest = _EDGE.split(text)
            return [first, *(" " + unit for unit in rest)]
        return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")


def library_classes(pattern: str) -> tuple[str, str, str]:
    """The pattern, a class of the signs that the two regex libraries take differently, the pattern with the tokenizer library's classes."""
    import tiktoken

    signs = "".join(map(chr, [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]))
    differ: set[str] = set()
    exact = pattern
    for name in ("L", "N"):
        probe = tiktoken.Encoding(name, pat_str=f"\\p{{{name}}}", mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        theirs = set(bytes(probe.encode_ordinary(signs)).decode())
        differ |= theirs ^ set(regex.findall(f"\\p{{{name}}}", signs))
        exact = exact.replace(f"\\p{{{name}}}", ranges(theirs))
    return pattern, ranges(differ) if differ else "", exact


def ranges(signs: set[str]) -> str:
    """A character class of the signs."""
    codes = np.array(sorted(map(ord, signs)))
    cuts = np.nonzero(np.diff(codes) > 1)[0]
    return "[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(np.r_[codes[0], codes[cuts + 1]], np.r_[codes[cuts], codes[-1]], strict=True)) + "]"


def kept_in_worker(key: str, make):
    """What this Python worker keeps from task to task; only the latest of each key."""
    kept = sys.modules.setdefault("_cohortspark_bpe", types.ModuleType("_cohortspark_bpe")).__dict__
    name, _, run = key.partition(":")
    if kept.get(name, ("", None))[0] != run:
        kept[name] = run, make()
    return kept[name][1]


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def word_counts(docs: DataFrame, text_col: str = "text", pattern: str | None = None, least: int = 1) -> DataFrame:
    """(word, n): how often each word of at most ``LONG`` bytes occurs in all texts. Null texts have none.

    A unit that a stretch of about a million words has fewer than ``least`` times is not counted there.
    """
    classes = library_classes(pattern or _pattern())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = kept_in_worker(f"splitter:{classes[0]}", lambda: Splitter(*classes))

        def counted(units: Counter) -> pa.RecordBatch:
            words: Counter = Counter()
            for unit, n in units.items():
                if n >= least:
                    for word in splitter.words(unit):
                        words[word] += n
            found = [(w, n) for w, n in words.items() if len(w) <= LONG]
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in found], pa.binary()), pa.array([n for _, n in found], pa.int64())], names=["word", "n"])

        units: Counter = Counter()
        for _, texts in sliced(batches, "text"):
            for text in texts:
                units.update(splitter.units(text.decode()))
                if len(units) > CACHED_UNITS:
                    yield counted(units)
                    units = Counter()
        yield counted(units)

    counts = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "word binary, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n"))


def _pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def frequent(counts: DataFrame, head: int = HEAD) -> DataFrame:
    """The most frequent words, at most ``head``: those with a count of the least power of two that keeps to it."""
    by_power = {r.p: r.n for r in counts.groupBy(F.floor(F.log2("n")).alias("p")).agg(F.count("*").alias("n")).collect()}  # at most 63 rows
    total, least = 0, 63
    for p in sorted(by_power, reverse=True):
        total += by_power[p]
        if total > head:
            break
        least = p
    return counts.where(F.col("n") >= F.lit(1 << least) if least < 63 else F.lit(False))


ENCODED = "doc_id long, ids binary"


def encode(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None, head: int = HEAD, long: int = LONG, fold_all: bool = False
) -> DataFrame:
    """(doc_id, ids): the ids of each text as little-endian unsigned 32-bit integers.

    Each word of the pattern is encoded separately, without special tokens. With ``fold_all`` the higher-order
    functions fold the rare words as well. A null or empty text has no ids. Rows
    without an id and repeated rows are encoded like others; an empty table gives no rows. ``long`` is at most ``LONG``.
    """
    pattern, long = pattern or _pattern(), min(long, LONG)
    ranks, classes = load_ranks(path), library_classes(pattern)
    literal = rank_map(ranks)
    rows = _rows(docs, id_col, text_col)
    heads = frequent(materialize(word_counts(docs, text_col, pattern, 2)), head).select("word", folded(F.col("word"), literal).alias("ids"))
    known = {bytes(r.word): np.array(r.ids, "<u4").tobytes() for r in heads.toLocalIterator()}  # at most ``head`` words
    shared = rows.sparkSession.sparkContext.broadcast((known, ranks))
    key, call = zlib.crc32(repr(sorted(ranks.items())).encode()), uuid.uuid4().hex

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Ids with a numbered hole for each word that is left to Spark, and these words."""
        splitter = kept_in_worker(f"splitter:{classes[0]}", lambda: Splitter(*classes))
        words, all_ranks = shared.value[0], kept_in_worker(f"ranks:{key}", lambda: Ranks(shared.value[1]))

        cached: dict[str, bytes] = kept_in_worker(f"units:{call}", dict)

        def opened_units(units: set[str]) -> tuple[dict[str, bytes], dict[str, list[bytes]]]:
            """Ids of units not met before; with ``fold_all`` the words of those that hold an unknown one."""
            split = {unit: splitter.words(unit) for unit in units}
            rare = [w for w in {w for own in split.values() for w in own} if w not in words]
            short = [w for w in rare if len(w) <= long]
            made = {w: np.array(merge_long(w, all_ranks), "<u4").tobytes() for w in rare if len(w) > long}
            if not fold_all:
                made |= zip(short, all_ranks.merge_many(short), strict=True)
            ids, open_ = {}, {}
            for unit, own in split.items():
                parts = [words[w] if w in words else made.get(w) for w in own]
                if None in parts:
                    open_[unit] = own
                else:
                    ids[unit] = b"".join(parts)
            for unit, x in ids.items():
                if len(cached) >= CACHED_UNITS:
                    break
                cached[unit] = x
            for w in made.keys() & {w for own in open_.values() for w in own}:
                open_words[w] = made[w]
            return ids, open_

        open_words: dict[bytes, bytes] = {}

        def hole(word: bytes, holes: dict[bytes, int]) -> bytes:
            own = words.get(word) or open_words.get(word)
            return (HOLE + holes.setdefault(word, len(holes))).to_bytes(4, "little") if own is None else own

        def encoded(texts: list[bytes]) -> list[tuple[bytes, list[bytes]]]:
            split = [splitter.units(t.decode()) for t in texts]
            new, open_ = opened_units({u for units in split for u in units if u not in cached})
            found = []
            for units in split:
                holes: dict[bytes, int] = {}
                parts = [cached.get(u) for u in units]
                if None in parts:
                    parts = [p if p is not None else new[u] if u in new else b"".join(hole(w, holes) for w in open_[u]) for u, p in zip(units, parts, strict=True)]
                found.append((b"".join(parts), list(holes)))
            return found

        for part, texts in sliced(batches, "text"):
            found = [x for at in range(0, len(texts), 512) for x in encoded(texts[at : at + 512])]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([a for a, _ in found], pa.binary()), pa.array([b for _, b in found], pa.list_(pa.binary()))], names=["doc_id", "ids", "holes"])

    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = []
            for ids, holes in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if holes:
                    own = np.frombuffer(ids, "<u4")
                    at = np.nonzero(own >= HOLE)[0]
                    sizes = np.array([len(h) for h in holes])
                    which = (own[at] - HOLE).astype(np.int64)
                    # the ids before a hole, then the hole's, and so on
                    pieces = np.split(own, at)
                    flat = [np.array(h, "<u4") for h in holes]
                    ids = b"".join([pieces[0].tobytes(), *(x for w, p in zip(which, pieces[1:], strict=True) for x in (flat[w].tobytes(), p[1:].tobytes()))])
                    assert len(ids) == 4 * (len(own) - len(at) + sizes[which].sum())
                done.append(ids)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(done, pa.binary())], names=["doc_id", "ids"])

    open_ = rows.mapInArrow(opened, "doc_id long, ids binary, holes array<binary>")
    if not fold_all:
        return open_.select("doc_id", "ids")
    return open_.select("doc_id", "ids", F.transform("holes", lambda w: folded(w, literal)).alias("holes")).mapInArrow(filled, ENCODED)


def as_array(ids: Column) -> Column:
    """Ids as an array of numbers; null for null."""
    one = lambda i: F.conv(F.concat(*[F.hex(F.substring(ids, 4 * i - k, F.lit(1))) for k in range(4)]), 16, 10).cast("long")
    return F.when(F.length(ids) == 0, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(1), (F.length(ids) / 4).cast("int")), one))


def decode(encoded: DataFrame, ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """The rows with ``decoded``, the concatenated byte pieces of their ids (binary; null ids: null)."""
    pieces = {rank: piece for piece, rank in load_ranks(path).items()}
    shared = encoded.sparkSession.sparkContext.broadcast(pieces)  # as large as the vocabulary
    own = [c for c in encoded.columns if c != "decoded"]
    schema = ", ".join(f"`{c}` {encoded.schema[c].dataType.simpleString()}" for c in own) + ", decoded binary"
    at = own.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = shared.value.__getitem__
        for part, ids in sliced(batches, ids_col):
            texts = [b"".join(map(get, np.frombuffer(x, "<u4").tolist())) for x in ids]
            missing = part.column(at).is_null().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.binary(), mask=missing)], names=[*own, "decoded"])

    return encoded.select(*own).mapInArrow(run, schema)


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole document and what they decode to, as digests. Null texts are empty; see ``encode``.

    The ids are stored in between, so that a task has one Python worker at a time.
    """
    found = decode(materialize(encode(table(spark, sf_dir, "documents"))))
    return found.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
