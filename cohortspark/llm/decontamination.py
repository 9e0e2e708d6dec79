"""Benchmark decontamination on templates, which also finds re-parameterised questions.

Numbers, names and units become typed placeholders; windows of such template tokens are joined by hash between
benchmark and documents. Where enough of an item is covered, its slots are compared: the item's values must map
to the document's values one to one, so the same question with other numbers or names is found, and a text that
only has the same frame with slots at odds is not. Beside these there are windows of the exact lower-cased tokens,
signs of calculation included and without a least number of literal words: what they cover counts as covered with
the item's own values, so that items of numbers, names or a few words are found where they are copied.

The benchmark's windows are counted first. Up to ``INDEX_ROWS`` of them go to every task as one sorted array;
beyond that, windows of documents and benchmark meet in a shuffle. Both ways verify with the same code.
"""

from __future__ import annotations

import re
import sys
import types
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.llm.common import sliced, table
from cohortspark.llm.substrings import BASES, Rolling
from cohortspark.sources.io import materialize

WIDTH = 5
LEAST = 3
LITERALS = 0.6
COVER = 0.8
CONSISTENT = 0.8
INDEX_ROWS = 1_000_000
CACHED_WORDS = 300_000

# Units and number words, lower case.
UNITS = frozenset("mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres g kg mg lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons l ml liter liters litre litres gallon gallons s sec min h hr second seconds minute minutes hour hours day days week weeks month months year years cent cents dollar dollars euro euros percent mph kmh kph degree degrees".split())
NUMBERS = frozenset("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split())
LITERAL, NUMBER, NAME, UNIT, NOTHING = range(5)
_NUMBER = re.compile(r"[-+]?[$€£]?\d[\d.,:/]*%?")
_EDGE = re.compile(r"^[^\w$€£+-]+|[^\w%]+$")
_SIGN = re.compile(r"[-+*/=<>^%×÷±−√·]")
_TYPE_HASH = np.array([xxhash.xxh64_intdigest(f"<{k}>") for k in range(5)], np.uint64)


@dataclass
class Tokens:
    """Template tokens of a text: hash of the template, kind, hash of the value.

    ``exact`` are the hashes of the lower-cased words and signs, ``owner`` the template token of each; -1 for signs.
    """

    template: np.ndarray
    kind: np.ndarray
    value: np.ndarray
    exact: np.ndarray
    owner: np.ndarray


def packed(kind: int, name: str, capital: bool, ends: bool, sign: bool) -> int:
    """The 58 upper bits of a name's hash, and in the lower ones the kind and what is said of the run."""
    return (xxhash.xxh64_intdigest(name) & ~63) | kind | capital << 3 | ends << 4 | sign << 5


class Canon(dict):
    """Template tokens; what a run of non-blank signs is, without its place in a sentence, is remembered."""

    def __missing__(self, run: bytes) -> int:
        text = run.decode()
        bare = text.rstrip(".,;:!?")
        if bare.isalpha():  # letters, then perhaps punctuation
            name = bare.lower()
            kind = NUMBER if name in NUMBERS else UNIT if name in UNITS else LITERAL
            capital = kind == LITERAL and bare[:1].isupper() and not (len(bare) > 1 and bare.isupper())
            made = packed(kind, name, capital, text[-1] in ".!?:;", False)
        else:
            made = packed(*self.classed(run))
        self[run] = made
        return made

    @staticmethod
    def classed(run: bytes) -> tuple[int, str, bool, bool, bool]:
        """Kind, what is hashed, and the flags of any run."""
        text = run.decode()
        bare = _EDGE.sub("", text)
        lower = bare.lower()
        if run == b"\x00":
            kind = NOTHING
        elif not any(map(str.isalnum, bare)):
            kind = NOTHING
        elif _NUMBER.fullmatch(bare) or lower in NUMBERS:
            kind = NUMBER
        elif lower in UNITS:
            kind = UNIT
        else:
            kind = LITERAL
        if kind == NUMBER and _NUMBER.fullmatch(bare):
            lower = lower.replace(",", "").rstrip(".:/")
        capital = kind == LITERAL and bare[:1].isupper() and not (len(bare) > 1 and bare.isupper())
        ends = run == b"\x00" or text.rstrip("\"')]}»”’")[-1:] in (".", "!", "?", ":", ";", "…")
        sign = kind == NOTHING and _SIGN.search(text) is not None
        return kind, text if sign else lower, capital, ends, sign

    def tokens(self, text: bytes) -> Tokens:
        if len(self) > CACHED_WORDS:
            self.clear()
        runs = text.replace(b"\x00", b" ").replace(b"\n", b" \x00 ").split()
        about = np.fromiter(map(self.__getitem__, runs), np.uint64, len(runs))
        low = about.astype(np.uint8)
        kinds, hashes, named, ends = (low & 7).astype(np.int8), about & ~np.uint64(63), (low & 8).astype(bool), (low & 16).astype(bool)
        if len(about):
            named[0] = False
            named[1:] &= ~ends[:-1]  # a capital that opens a sentence says nothing
        kinds[named] = NAME
        keep = kinds != NOTHING
        exact, word = hashes, keep
        if not keep.all():
            stays = keep | (low & 32).astype(bool)
            exact, word = hashes[stays], keep[stays]
        kinds, hashes = kinds[keep], hashes[keep]
        follows = np.zeros(len(kinds), bool)
        follows[1:] = (kinds[1:] == NAME) & (kinds[:-1] == NAME)
        if follows.any():  # a name of several words is one slot
            starts = np.nonzero(~follows)[0]
            hashes, kinds = np.add.reduceat(hashes * np.uint64(BASES[1]), starts), kinds[starts]
        else:
            hashes = hashes * np.uint64(BASES[1])
        owner = np.full(len(word), -1, np.int64)
        owner[word] = np.cumsum(~follows) - 1
        return Tokens(np.where(kinds == LITERAL, hashes, _TYPE_HASH[kinds]), kinds, hashes, exact, owner)


class Templates:
    def __init__(self, width: int):
        self.width, self.canon, self.rolling = width, Canon(), Rolling(BASES[0])

    def windows(self, tokens: Tokens, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and starts of the windows with enough literal words; of one token for each word of ``width``."""
        width = width or self.width
        sums = self.rolling.prefix(tokens.template)
        hashes = self.rolling.runs(sums, width)
        literal = np.r_[0, np.cumsum(tokens.kind == LITERAL)]
        starts = np.nonzero(literal[width:] - literal[: len(hashes)] >= LITERALS * width)[0] if len(hashes) else np.zeros(0, np.int64)
        return hashes[starts] + np.uint64(width), starts

    def exact(self, tokens: Tokens, width: int) -> np.ndarray:
        """Hashes of all windows of exact tokens."""
        return self.rolling.runs(self.rolling.prefix(tokens.exact), width) + np.uint64(width)


def templates_of_worker(width: int) -> Templates:
    """The token cache of this Python worker, kept from task to task."""
    kept = sys.modules.setdefault("_cohortspark_templates", types.ModuleType("_cohortspark_templates")).__dict__
    name = str(width)
    if name not in kept:
        kept[name] = Templates(width)
    return kept[name]


@dataclass
class Match:
    coverage: float
    slots: int
    consistent: int
    exact: bool


def compare(doc: Tokens, item: Tokens, hits: list[tuple[int, int]], width: int, copied: frozenset[int] = frozenset()) -> Match:
    """How far windows (start in the document, start in the item) cover the item, and whether its slots agree.

    Hits are followed along diagonals; the strongest diagonal that covers an item's token gives the document's
    value for it. A slot is consistent if its value maps to the usual partner of that value, and back. The item's
    tokens in ``copied`` have their own values, whatever the windows say.
    """
    partner: dict[int, int] = {}
    by_diagonal: dict[int, set[int]] = {}
    for p, q in hits:
        by_diagonal.setdefault(p - q, set()).update(range(q, q + width))
    for diagonal, covered in sorted(by_diagonal.items(), key=lambda x: (-len(x[1]), x[0])):
        for q in covered:
            partner.setdefault(q, q + diagonal)
    pairs = [(int(item.value[q]), int(doc.value[p]), int(item.kind[q])) for q, p in sorted(partner.items()) if item.kind[q] != LITERAL and q not in copied]
    pairs += [(int(item.value[q]), int(item.value[q]), int(item.kind[q])) for q in sorted(copied) if item.kind[q] != LITERAL]
    forth, back = {}, {}
    for a, b, kind in pairs:
        forth.setdefault((kind, a), Counter())[b] += 1
        back.setdefault((kind, b), Counter())[a] += 1
    agree = sum(b == forth[kind, a].most_common(1)[0][0] and a == back[kind, b].most_common(1)[0][0] for a, b, kind in pairs)
    return Match(len(partner) / max(1, len(item.template)), len(pairs), agree, all(a == b for a, b, _ in pairs))


def contaminated(match: Match) -> bool:
    return match.coverage >= COVER and match.consistent >= CONSISTENT * match.slots


def sized(tokens: Tokens, width: int) -> tuple[int, int]:
    """Widths of an item's template windows and exact windows; 0 where it has fewer than ``LEAST`` tokens."""
    n, words = len(tokens.template), int((tokens.owner >= 0).sum())
    return min(width, n) if n >= LEAST else 0, min(width, len(tokens.exact)) if words >= LEAST else 0


class Sorted:
    """Windows by hash: the places (owner, start) of each."""

    def __init__(self, found: list[tuple[int, np.ndarray, np.ndarray]]):
        hashes = np.concatenate([h for _, h, _ in found] + [np.zeros(0, np.uint64)])
        order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[order]
        self.owner = np.concatenate([np.full(len(h), k) for k, h, _ in found] + [np.zeros(0, np.int64)])[order]
        self.starts = np.concatenate([q for _, _, q in found] + [np.zeros(0, np.int64)])[order]

    def among(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes occur, and the first place of each."""
        low = np.searchsorted(self.hashes, hashes)
        found = np.nonzero((low < len(self.hashes)) & (self.hashes[np.minimum(low, len(self.hashes) - 1)] == hashes))[0] if len(self.hashes) else low[:0]
        return found, low[found]

    def places(self, low: int) -> Iterator[tuple[int, int]]:
        k = low
        while k < len(self.hashes) and self.hashes[k] == self.hashes[low]:
            yield int(self.owner[k]), int(self.starts[k])
            k += 1


class Index:
    """The benchmark's items by the hashes of their windows."""

    def __init__(self, items: list[tuple[int, bytes]], width: int):
        self.width, self.items = width, {}
        tool = Templates(width)
        template, exact = [], []
        for k, (item_id, text) in enumerate(items):
            tokens = tool.canon.tokens(text)
            own, same = sized(tokens, width)
            if not same:
                continue
            self.items[k] = item_id, tokens, own, same
            if own:
                template.append((k, *tool.windows(tokens, own)))
            hashes = tool.exact(tokens, same)
            exact.append((k, hashes, np.arange(len(hashes))))
        self.template, self.exact = Sorted(template), Sorted(exact)
        self.widths = sorted({own for _, _, own, _ in self.items.values() if own})
        self.exact_widths = sorted({same for _, _, _, same in self.items.values()})

    def search(self, tool: Templates, text: bytes) -> list[tuple[int, Match]]:
        """(item_id, match) of the items that a text holds."""
        doc = tool.canon.tokens(text)
        hits: dict[int, list[tuple[int, int]]] = {}
        for width in self.widths:
            hashes, places = tool.windows(doc, width)
            found, low = self.template.among(hashes)
            for i, at in zip(found.tolist(), low.tolist(), strict=True):
                for k, q in self.template.places(at):
                    if self.items[k][2] == width:
                        hits.setdefault(k, []).append((int(places[i]), q))
        copied: dict[int, set[int]] = {}
        for width in self.exact_widths:
            for at in np.unique(self.exact.among(tool.exact(doc, width))[1]).tolist():
                for k, q in self.exact.places(at):
                    if self.items[k][3] == width:
                        copied.setdefault(k, set()).add(q)
        result = []
        for k in hits.keys() | copied.keys():
            match = self.judge(k, doc, hits.get(k, []), copied.get(k, set()))
            if match is not None:
                result.append((self.items[k][0], match))
        return sorted(result, key=lambda x: x[0])

    def judge(self, k: int, doc: Tokens, hits: list[tuple[int, int]], copied: set[int]) -> Match | None:
        """The item's match by its template windows, else by its exact windows, else by both together."""
        _, item, width, same = self.items[k]
        starts = {q for _, q in hits}
        if len(starts) * width >= COVER * len(item.template) and hits:  # else it can't be covered
            match = compare(doc, item, hits, width)
            if contaminated(match):
                return match
        if not copied:
            return None
        word = item.owner >= 0
        own = np.zeros(len(item.exact), bool)
        for q in copied:
            own[q : q + same] = True
        whole = np.ones(len(item.template), bool)
        whole[item.owner[word & ~own]] = False
        values = frozenset(np.nonzero(whole)[0].tolist())
        share = float((own & word).sum() / word.sum())
        if share >= COVER:
            slots = int((whole & (item.kind != LITERAL)).sum())
            return Match(share, slots, slots, True)
        both = np.zeros(len(item.template), bool)
        for q in starts:
            both[q : q + width] = True
        share = float((word & (own | both[item.owner])).sum() / word.sum())
        if share < COVER:
            return None
        match = compare(doc, item, hits, width, values)
        match.coverage = share
        return match if contaminated(match) else None


FOUND = "doc_id long, tk long, item_id long, coverage double, slots long, consistent long, exact boolean"
FOUND_ARROW = pa.schema([("doc_id", pa.int64()), ("tk", pa.int64()), ("item_id", pa.int64()), ("coverage", pa.float64()), ("slots", pa.int64()), ("consistent", pa.int64()), ("exact", pa.bool_())])


def _rows(doc_id, tk, found: list[tuple[int, Match]]) -> list[tuple]:
    return [(doc_id, tk, item_id, m.coverage, m.slots, m.consistent, m.exact) for item_id, m in found]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in FOUND_ARROW]
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, FOUND_ARROW, strict=True)], schema=FOUND_ARROW)


def find(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = WIDTH, index_rows: int = INDEX_ROWS
) -> DataFrame:
    """(doc_id, tk, item_id, coverage, slots, consistent, exact) of the items that documents hold.

    ``tk`` is the text's 64-bit hash, ``coverage`` the share of the item's template tokens that common windows
    cover (0.8 at least), or of its words where template windows alone don't reach that and exact windows help;
    ``exact`` whether all slots have the item's own values. Items shorter than a window are one window; items of
    fewer than three words, null texts and rows without an id are never matched.
    Repeated documents are matched each for itself, a repeated row of the benchmark once; empty tables give no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("tk"), F.col(text_col).cast("string").alias("text"))
    rows = rows.where("doc_id is not null and text is not null")
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("item_text")).where("item_id is not null and item_text is not null").dropDuplicates()
    # an item has at most as many windows as blanks and one more
    size = items.agg(F.coalesce(F.sum(F.length("item_text") - F.length(F.regexp_replace("item_text", "[ \t\r\n]+", ""))) + F.count("*"), F.lit(0))).first()[0]
    if size <= index_rows:
        index = Index([(r.item_id, r.item_text.encode()) for r in items.orderBy("item_id", "item_text").collect()], width)
        return _search(rows, index, width)
    return _shuffled(rows, items, width)


def _search(rows: DataFrame, index: Index, width: int) -> DataFrame:
    # of a counted size; by value, as executors may have no copy of this package
    shared = rows.sparkSession.sparkContext.broadcast(cloudpickle.dumps(index))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, own = templates_of_worker(width), cloudpickle.loads(shared.value)
        for part, texts in sliced(batches, "text"):
            yield _batch([row for doc_id, tk, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), texts, strict=True) for row in _rows(doc_id, tk, own.search(tool, text))])

    return rows.mapInArrow(run, FOUND)


def _shuffled(rows: DataFrame, items: DataFrame, width: int) -> DataFrame:
    """The same for a benchmark of any size: pairs that share a window are found by a join, then verified."""

    def hashed(df: DataFrame, text: str) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tool = templates_of_worker(width)
            for part, texts in sliced(batches, text):
                found = []
                for t in texts:
                    tokens = tool.canon.tokens(t)
                    sizes = range(LEAST, width + 1)
                    found.append(np.unique(np.concatenate([tool.windows(tokens, w)[0] for w in sizes] + [tool.exact(tokens, w) for w in sizes])).view(np.int64))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(part.num_columns - 1)), pa.array(found, pa.list_(pa.int64()))], names=[*part.schema.names[:-1], "h"])

        names = [c for c in df.columns if c != text]
        schema = ", ".join(f"{c} long" for c in names) + ", h array<long>"
        return df.select(*names, text).mapInArrow(run, schema).select(*names, F.explode("h").alias("h"))

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """An item's windows with the template tokens and the words that all windows of the hash can cover."""
        tool = templates_of_worker(width)
        for part, texts in sliced(batches, "item_text"):
            rows = []
            for item, t in zip(part.column(0).to_pylist(), texts, strict=True):
                tokens = tool.canon.tokens(t)
                own, same = sized(tokens, width)
                if not same:
                    continue
                word = tokens.owner >= 0
                within = np.r_[0, np.cumsum(np.bincount(tokens.owner[word], minlength=len(tokens.template)))]
                before = np.r_[0, np.cumsum(word)]
                weights: dict[int, list[int]] = {}
                hashes, starts = tool.windows(tokens, own) if own else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
                for h, q in zip(hashes.view(np.int64).tolist(), starts.tolist(), strict=True):
                    have = weights.setdefault(h, [0, 0])
                    have[0] += own
                    have[1] += int(within[q + own] - within[q])
                for q, h in enumerate(tool.exact(tokens, same).view(np.int64).tolist()):
                    weights.setdefault(h, [0, 0])[1] += int(before[q + same] - before[q])
                rows += [(item, h, a, b, len(tokens.template), int(word.sum())) for h, (a, b) in weights.items()]
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["item", "h", "by_template", "by_word", "n_template", "n_word"])

    items = items.withColumn("item", F.xxhash64("item_id", "item_text"))
    wanted = materialize(items.select("item", "item_text").dropDuplicates(["item"]).mapInArrow(weighed, "item long, h long, by_template long, by_word long, n_template long, n_word long"))
    shared = hashed(rows, "text").distinct().join(wanted, "h").groupBy("doc_id", "tk", "item", "n_template", "n_word").agg(F.sum("by_template").alias("by_template"), F.sum("by_word").alias("by_word"))
    # a covered token needs a common window; every place of a window in the item counts
    possible = (F.col("by_template") >= COVER * F.col("n_template")) | (F.col("by_word") >= COVER * F.col("n_word"))
    pairs = materialize(shared.where(possible).select("doc_id", "tk", "item"))
    joined = pairs.join(items.dropDuplicates(["item"]), "item").join(rows, ["doc_id", "tk"]).select("doc_id", "tk", "item_id", "item_text", "text")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = templates_of_worker(width)
        for part, texts in sliced(batches, "text"):
            found = []
            for doc_id, tk, item_id, item, text in zip(*(part.column(i).to_pylist() for i in range(4)), texts, strict=True):
                found += _rows(doc_id, tk, Index([(item_id, item.encode())], width).search(tool, text))
            yield _batch(found)

    return joined.mapInArrow(verify, FOUND)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents, all columns, without those that hold a benchmark item. Rows without an id stay."""
    found = materialize(find(docs, benchmark, id_col, text_col, **options).select(F.col("doc_id").alias("__id"), F.col("tk").alias("__tk")).distinct())
    return docs.join(found, (F.col(id_col).cast("long") == F.col("__id")) & (F.xxhash64(F.col(text_col).cast("string")) == F.col("__tk")), "left_anti")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("tk")
