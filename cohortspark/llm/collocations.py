"""Phrase collocations from a weighted de Bruijn graph of word four-grams.

Nodes are three words, an edge is the four words that two overlapping nodes span, its weight how often they occur.
Every word occurrence starts one row, its four-gram, or a shorter one at the end of a piece. Only these longest
grams are counted. What shorter phrases weigh follows from the graph: a node's count is its outgoing flow plus the
pieces that end in it, a pair's the flow of the nodes that begin with it plus the pieces that end in it, and so on.
Runs of nodes with one way in, one way out and nothing beginning or ending there are compacted into paths; their
inner nodes weigh what the path does, so they are parts of a phrase as frequent as they are and need no scoring.

Most grams of a corpus are too rare for a phrase. A first pass counts hashed grams of one to four words in
saturating cells, a table of fixed size per task that Spark adds up: a cell is never below a gram's true count.
A row is then cut where its gram, or one inside it, is certainly below the least count, as if a piece ended
there. No phrase that is frequent enough loses an occurrence, so all counts that matter stay exact. In a corpus
that fills the cells the cuts fade, and more rows are counted; the result is the same.

Words are 64-bit hashes until the end. The words behind the hashes are gathered, and if two share one the whole
is done again with another seed.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortspark.llm.common import table
from cohortspark.llm.substrings import mixed
from cohortspark.sources.io import materialize

LONGEST = 4
LEAST = 30
TOP = 2000
SHARE = 80
SCORE = 2_000_000
NO_LANGUAGE = "und"
#: Cells of one byte, as powers of two, for grams of one to four words.
CELLS = (22, 24, 24, 24)
CHUNK = 1 << 16
FULL = 255
FAN = 256
#: Hashes worked on at a time when cells and when grams are counted; words a task remembers, of all languages together.
SURVEYED, BUFFERED = 1 << 18, 1 << 19
CACHED_WORDS = 200_000
#: Rows of a batch that goes back to Spark.
SENT = 1 << 16
_GAP, _END = np.uint64(0), np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
# Lower case for A-Z only, every end of a piece as a line feed, a tab as a blank.
_PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\x0d\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9 + b" ")


class Hashes(dict):
    """64-bit hashes of the words of one language; never 0 or 1, which mark gaps and ends of pieces.

    With ``cells``, words that may be frequent enough are noted in ``fresh`` and always remembered. ``room``, shared
    by all languages, says how many words may still be remembered.
    """

    def __init__(self, language: str, seed: int, cells: np.ndarray | None, least: int, room: list[int]):
        self.language, self.seed, self.cells, self.least = language, xxhash.xxh64_intdigest(language.encode(), seed), cells, least
        self.room = room
        self.fresh: list[tuple[int, str, bytes]] = []
        self[b""], self[b"\n"] = int(_GAP), int(_END)

    def __missing__(self, word: bytes) -> int:
        value = max(2, xxhash.xxh64_intdigest(word, self.seed))
        often = self.cells is not None and self.cells[value >> (64 - CELLS[0])] >= self.least
        if often:
            self.fresh.append((value, self.language, word))
        if often or self.room[0] > 0:
            self[word] = value
            self.room[0] -= 1
        return value


class Words:
    """Words of texts as hashes, with an end after each piece."""

    def __init__(self, seed: int, cells: np.ndarray | None = None, least: int = FULL, buffered: int = BUFFERED):
        self.seed, self.cells, self.least, self.buffered = seed, cells, least, buffered
        self.by_language: dict[str, Hashes] = {}
        self.room = [CACHED_WORDS]

    @staticmethod
    def split(text: bytes) -> list[bytes]:
        return text.translate(_PLAIN).replace(b"\n", b" \n ").split(b" ")

    def runs(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, dict[str, int], list]]:
        """About ``buffered`` hashes at a time, how many words that were of each language, and the words to be noted."""
        held, sizes, count = [], {}, 0

        def all_held():
            whole = np.concatenate(held)
            fresh = [x for h in self.by_language.values() for x in h.fresh]
            for h in self.by_language.values():
                h.fresh = []
            return whole[whole != _GAP], sizes, fresh

        for batch in batches:
            for language, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                if language not in self.by_language:
                    self.by_language[language] = Hashes(language, self.seed, self.cells, self.least, self.room)
                words = self.split(text)
                own = np.fromiter(map(self.by_language[language].__getitem__, words), np.uint64, len(words))
                held += [own, np.array([_END])]
                count += len(own)
                sizes[language] = sizes.get(language, 0) + int((own > _END).sum())
                if count >= self.buffered or len(self.by_language) > 256:
                    yield all_held()
                    held, sizes, count = [], {}, 0
                    if len(self.by_language) > 256:  # any number of languages, a bounded number remembered
                        self.by_language.clear()
                        self.room[0] = CACHED_WORDS
        if held:
            yield all_held()


def grams(hashes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For one to four words: hashes of the grams at each place, and whether the gram lies in one piece."""
    inside = hashes != _END
    gram, within = hashes, inside
    yield gram, within
    for k in range(1, LONGEST):
        gram = mixed(gram[:-1] * _STEP + hashes[k:]) if len(gram) else gram
        within = within[:-1] & inside[k:] if len(within) else within
        yield gram, within


def _rows(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANGUAGE))
    return docs.select(lang.alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def _added(cells: np.ndarray, at: np.ndarray) -> None:
    places, counts = np.unique(at, return_counts=True)
    cells[places] = np.minimum(cells[places] + counts, FULL).astype(np.uint8)


def survey(rows: DataFrame, seed: int) -> list[np.ndarray]:
    """Saturating counts of hashed grams over all texts, one array for each number of words."""
    starts = np.cumsum([0] + [1 << c for c in CELLS])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = [np.zeros(1 << c, np.uint8) for c in CELLS]
        for hashes, _, _ in Words(seed, buffered=SURVEYED).runs(batches):
            for own, bits, (gram, within) in zip(cells, CELLS, grams(hashes), strict=True):
                _added(own, gram[within] >> np.uint64(64 - bits))
        task = int(_task())
        for start, own in zip(starts, cells, strict=False):
            for chunk in range(0, len(own), CHUNK):
                part = own[chunk : chunk + CHUNK]
                if part.any():
                    yield _cells_batch((int(start) + chunk) // CHUNK, task // FAN, part)

    def merged(group: pa.Table) -> pa.Table:
        total = np.zeros(CHUNK, np.int64)
        for data in group.column("data").to_pylist():
            total = np.minimum(total + np.frombuffer(zlib.decompress(data), np.uint8), FULL)
        return pa.Table.from_batches([_cells_batch(group.column("chunk")[0].as_py(), 0, total.astype(np.uint8))])

    schema = "chunk int, part int, data binary"
    # the parts of at most ``FAN`` tasks meet first, so that a group stays small with any number of tasks
    cells = rows.mapInArrow(counted, schema).groupBy("chunk", "part").applyInArrow(merged, schema).groupBy("chunk").applyInArrow(merged, schema)
    whole = np.zeros(int(starts[-1]), np.uint8)
    for r in cells.toLocalIterator():  # as large as the table of cells
        whole[r.chunk * CHUNK : (r.chunk + 1) * CHUNK] = np.frombuffer(zlib.decompress(r.data), np.uint8)
    return [whole[a:b] for a, b in zip(starts, starts[1:], strict=False)]


def _task() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def _cells_batch(chunk: int, part: int, data: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([part], pa.int32()), pa.array([zlib.compress(data.tobytes(), 1)], pa.binary())], names=["chunk", "part", "data"])


ROW = "w1 long, w2 long, w3 long, w4 long, n long, lang string, word binary"


def counted_rows(rows: DataFrame, cells: list[np.ndarray], seed: int, least: int) -> DataFrame:
    """Grams with counts; words with their hash (``word`` set); and word totals of each language (``w1`` null)."""
    shared, floor = rows.sparkSession.sparkContext.broadcast([c.tobytes() for c in cells]), min(least, FULL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [np.frombuffer(c, np.uint8) for c in shared.value]
        for hashes, sizes, fresh in Words(seed, own[0], floor).runs(batches):
            length = np.zeros(len(hashes), np.int8)
            key, often = hashes, None
            for k, (gram, within) in enumerate(grams(hashes), 1):
                fits = within & (own[k - 1][gram >> np.uint64(64 - CELLS[k - 1])] >= floor)
                often = fits if often is None else fits & often[: len(fits)] & often[1 : len(fits) + 1]
                at = np.nonzero(often)[0]
                length[at] = k
                key = key.copy() if k == 1 else key
                key[at] = gram[at]
            places = np.nonzero(length)[0]
            places = places[np.argsort(key[places], kind="stable")]
            words = np.zeros((LONGEST, len(places)), np.uint64)
            for k in range(LONGEST):
                longer = length[places] > k
                words[k, longer] = hashes[places[longer] + k]
            new = np.ones(len(places), bool)
            new[1:] = (words[:, 1:] != words[:, :-1]).any(axis=0)
            first = np.nonzero(new)[0]
            n = np.diff(np.r_[first, len(places)])
            columns = [words[k, first].view(np.int64) for k in range(LONGEST)]
            whole = pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(n.astype(np.int64)), pa.nulls(len(first), pa.string()), pa.nulls(len(first), pa.binary())], names=["w1", "w2", "w3", "w4", "n", "lang", "word"])
            for start in range(0, len(first), SENT):
                yield whole.slice(start, SENT)
            more = [(int(np.uint64(h).view(np.int64)), 0, lang, word) for h, lang, word in fresh] + [(None, size, lang, None) for lang, size in sizes.items()]
            none = pa.array([None] * len(more), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in more], pa.int64()), none, none, none, pa.array([m[1] for m in more], pa.int64()), pa.array([m[2] for m in more], pa.string()), pa.array([m[3] for m in more], pa.binary())], names=["w1", "w2", "w3", "w4", "n", "lang", "word"])

    return rows.mapInArrow(run, ROW)


W = [f"w{k}" for k in range(1, LONGEST + 1)]


class Graph:
    """The counted grams of a corpus as a graph, and what follows from it. All counts of ``least`` and more are exact."""

    def __init__(self, docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST):
        rows, self.least = _rows(docs, text_col, lang_col), least
        for seed in range(8):
            stored = materialize(counted_rows(rows, survey(rows, seed), seed, least))
            named = stored.where("word is not null").groupBy("w1").agg(F.min(F.struct("lang", "word")).alias("low"), F.max(F.struct("lang", "word")).alias("high"))
            self.words = materialize(named.select(F.col("w1").alias("w"), "low.lang", F.col("low.word").cast("string").alias("word"), (F.col("low") != F.col("high")).alias("shared")))
            if self.words.where("shared").isEmpty():
                break
        else:
            raise ArithmeticError("Words share hashes with every seed.")
        self.totals = stored.where("w1 is null").groupBy("lang").agg(F.sum("n").alias("total"))
        counts = stored.where("word is null and w1 is not null")
        levels, of = {}, counts
        for k in range(LONGEST, 0, -1):  # flow out of a node, and the pieces that end in it
            of = materialize(of.groupBy(*W[:k]).agg(F.sum("n").alias("n")))
            levels[k] = of.where((F.col(W[k - 1]) != 0) & (F.col("n") >= least))
        self.levels = levels
        self.edges = materialize(levels[LONGEST].withColumn("id", F.monotonically_increasing_id()))

    def node(self, start: bool) -> list[Column]:
        return [F.col(w).alias(v) for w, v in zip(W[: LONGEST - 1] if start else W[1:], "xyz", strict=True)]

    def inner_nodes(self) -> DataFrame:
        """(x, y, z, before, after): nodes with one edge in and one out of the node's own count, and these edges."""
        out = self.edges.select(*self.node(True), "n", "id").groupBy("x", "y", "z").agg(F.count("*").alias("ways"), F.max("n").alias("n"), F.max("id").alias("after"))
        into = self.edges.select(*self.node(False), "n", "id").groupBy("x", "y", "z").agg(F.count("*").alias("ways"), F.max("n").alias("n"), F.max("id").alias("before"))
        own = self.levels[LONGEST - 1].select(*self.node(True), "n")
        one = lambda df: df.where("ways = 1").drop("ways")
        return one(out).join(one(into), ["x", "y", "z", "n"]).join(own, ["x", "y", "z", "n"]).select("x", "y", "z", "before", "after")

    def paths(self) -> DataFrame:
        """(words, n): maximal paths through inner nodes, as hashes of their words in order. Edges of a ring are a path each.

        Every edge finds the first one of its path by doubling its reach; an edge of a ring never does, and once a
        round has brought no other edge home, only rings are left.
        """
        inner = self.inner_nodes()
        step = materialize(self.edges.select("id").join(inner.select(F.col("after").alias("id"), "before"), "id", "left").select("id", F.coalesce("before", "id").alias("to"), F.col("before").isNotNull().cast("long").alias("far"), F.col("before").isNull().alias("home")))
        away = before = None
        while away is None or (away and away != before):
            ahead = step.select(F.col("id").alias("to"), F.col("to").alias("next"), F.col("far").alias("more"), F.col("home").alias("there"))
            before = away
            step = materialize(step.join(ahead, "to").select("id", F.col("next").alias("to"), (F.col("far") + F.col("more")).alias("far"), F.col("there").alias("home")))
            away = step.where(~F.col("home")).count()
        placed = step.select("id", F.when(F.col("home"), F.col("to")).otherwise(F.col("id")).alias("path"), F.when(F.col("home"), F.col("far")).otherwise(0).alias("far"))
        along = self.edges.join(placed, "id").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("far", *W))).alias("along"), F.max("n").alias("n"))
        first = [F.col("along")[0][w] for w in W[:-1]]
        return along.select(F.concat(F.array(*first), F.transform("along", lambda e: e[W[-1]])).alias("words"), "n")

    def candidates(self) -> DataFrame:
        """(w1..w4, a): frequent phrases of two to four words that no longer one nearly equals; missing words are 0."""
        zero = lambda df, k: df.select(*W[:k], *[F.lit(0).cast("long").alias(w) for w in W[k:]], F.col("n").alias("a"))
        at = F.explode(F.sequence(F.lit(1), F.size("words") - LONGEST + 1))
        along = self.paths().withColumn("at", at).select(*[F.col("words")[F.col("at") + k - 1].alias(w) for k, w in enumerate(W)], "n")
        found = [zero(along, LONGEST)]
        for k in range(LONGEST - 1, 1, -1):
            # a phrase inside any longer one is inside one of a word more, which is as frequent at least
            longer = self.levels[k + 1]
            most = longer.select(*W[:k], "n").unionByName(longer.select(*[F.col(v).alias(w) for v, w in zip(W[1 : k + 1], W, strict=False)], "n")).groupBy(*W[:k]).agg(F.max("n").alias("most"))
            own = self.levels[k]
            if k == LONGEST - 1:  # inner nodes of a path weigh what it does
                own = own.join(self.inner_nodes().select(*[F.col(v).alias(w) for v, w in zip("xyz", W, strict=False)]), W[:k], "left_anti")
            kept = own.join(most, W[:k], "left").where(F.coalesce(F.col("most"), F.lit(0)).cast("decimal(20,0)") * 100 < F.col("n").cast("decimal(20,0)") * SHARE)
            found.append(zero(kept, k))
        whole = found[0]
        for more in found[1:]:
            whole = whole.unionByName(more)
        return whole

    def scored(self) -> DataFrame:
        """(w1..w4, a, l, r, score) of the candidates at their lowest-scoring cut, the first of equal ones."""
        keys = ["k1", "k2", "k3"]
        zero = F.lit(0).cast("long")
        counts = None
        for k in range(1, LONGEST):
            own = self.levels[k].select(*[F.col(w).alias(v) for w, v in zip(W, keys[:k], strict=False)], *[zero.alias(v) for v in keys[k:]], "n")
            counts = own if counts is None else counts.unionByName(own)
        cuts = []
        for k in range(1, LONGEST):
            left = [F.col(w) if i < k else zero for i, w in enumerate(W[:-1])]
            right = [F.col(W[i + k]) if i + k < LONGEST else zero for i in range(LONGEST - 1)]
            cuts.append(F.struct(F.lit(k).alias("k"), *[c.alias(f"l{i}") for i, c in enumerate(left)], *[c.alias(f"r{i}") for i, c in enumerate(right)]))
        cut = materialize(self.candidates()).withColumn("cut", F.explode(F.array(*cuts))).where(F.col("cut.r0") != 0).select(*W, "a", "cut.*")
        for side in "lr":
            named = counts.select(*[F.col(v).alias(f"{side}{i}") for i, v in enumerate(keys)], F.col("n").alias(side))
            cut = cut.join(named, [f"{side}{i}" for i in range(3)])
        cut = cut.withColumn("score", F.expr(f"cast(a as decimal(20,0)) * {SCORE} div (cast(l as decimal(20,0)) + r)"))
        best = cut.groupBy(*W, "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
        return best.select(*W, "a", "best.l", "best.r", "best.score")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of two to four words of each language.

    A null language is ``und``; null, empty and blank texts have no words. Repeated rows count each for itself. An
    empty table gives no rows. ``least`` is 1 at least.
    """
    graph = Graph(docs, text_col, lang_col, least)
    scored = materialize(graph.scored().withColumn("id", F.monotonically_increasing_id()))
    places = scored.select("id", F.posexplode(F.array(*W)).alias("place", "w")).where("w <> 0")
    named = places.join(graph.words.drop("shared"), "w").groupBy("id").agg(F.min("lang").alias("lang"), F.array_sort(F.collect_list(F.struct("place", "word"))).alias("words"))
    phrases = scored.join(named, "id").select("lang", F.array_join(F.transform("words", lambda x: x.word), " ").alias("phrase"), "a", "l", "r", "score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = phrases.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(graph.totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 collocations of each language of all documents; see ``collocations``."""
    return collocations(table(spark, sf_dir, "documents"))


_SIGNS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
OP13_SQL = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), {_SIGNS}), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents
), worded AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]'), lambda x: x <> '') AS w FROM pieces
), phrases AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
  FROM worded, (SELECT unnest([1, 2, 3, 4]) AS k)
), counted AS MATERIALIZED (
  SELECT lang, k, phrase, count(*) AS f FROM phrases GROUP BY ALL
), totals AS (SELECT lang, sum(f) AS n FROM counted WHERE k = 1 GROUP BY lang
), candidates AS MATERIALIZED (SELECT *, string_split(phrase, ' ') AS words FROM counted WHERE k > 1 AND f >= 30
), inside AS (
  SELECT c.lang, array_to_string(c.words[s:s + m - 1], ' ') AS phrase, max(c.f) AS most
  FROM candidates c, (SELECT unnest([2, 3]) AS m), (SELECT unnest([1, 2, 3]) AS s) WHERE m < c.k AND s + m - 1 <= c.k GROUP BY ALL
), kept AS (
  SELECT c.* FROM candidates c LEFT JOIN inside i ON i.lang = c.lang AND i.phrase = c.phrase WHERE 100 * coalesce(i.most, 0) < 80 * c.f
), cuts AS (
  SELECT c.lang, c.phrase, c.f AS a, j, l.f AS l, r.f AS r, (2000000::HUGEINT * c.f) // (l.f + r.f) AS score
  FROM kept c CROSS JOIN (SELECT unnest([1, 2, 3]) AS j) x
  JOIN counted l ON l.lang = c.lang AND l.phrase = array_to_string(c.words[1:j], ' ')
  JOIN counted r ON r.lang = c.lang AND r.phrase = array_to_string(c.words[j + 1:c.k], ' ')
  WHERE j < c.k
), best AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best
)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
