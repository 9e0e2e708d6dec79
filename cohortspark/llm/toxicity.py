"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton on folded text.

Folding undoes what hides a word: case, compatibility forms, diacritics, look-alike letters of other scripts,
zero-width signs, and digits or signs that stand for letters inside a word. The lexicon holds whole words and
word beginnings with weights (log-odds), learned from labelled documents; matches inside exception phrases do
not count. A document's sum of weights is divided by the square root of its length and put on a logistic scale.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.llm.common import per_text, sliced, table
from cohortspark.llm.language import sampled
from cohortspark.sources.io import materialize

#: The lexicon and the scale are fitted on about this many labelled documents (all, if there are fewer).
SAMPLE_DOCS = 20_000
LEXICON_SIZE = 2_000
EXCEPTIONS_SIZE = 500
PREFIXES = range(3, 9)
LEAST_DOCS = 4
#: A pattern needs this lower confidence limit of its log-odds, and this share of toxic documents among those that have it.
LEAST_LOG_ODDS = 1.5
LEAST_PRECISION = 0.5
#: Words added to a document's length before the square root is taken.
LENGTH_OFFSET = 20
PREDICT_AT = 0.3
CACHED_WORDS = 500_000

# Letters of other scripts that look like Latin ones, in the order of the Latin letters below.
LOOKALIKES = {
    "а": "a", "ɑ": "a", "α": "a", "в": "b", "β": "b", "с": "c", "ϲ": "c", "ԁ": "d", "е": "e", "ε": "e", "ғ": "f", "ɡ": "g",
    "һ": "h", "н": "h", "і": "i", "ı": "i", "ι": "i", "ј": "j", "к": "k", "κ": "k", "ӏ": "l", "м": "m", "п": "n", "η": "n",
    "ո": "n", "о": "o", "ο": "o", "օ": "o", "σ": "o", "р": "p", "ρ": "p", "ԛ": "q", "г": "r", "ѕ": "s", "т": "t", "τ": "t",
    "υ": "u", "ս": "u", "ѵ": "v", "ν": "v", "ѡ": "w", "ω": "w", "х": "x", "χ": "x", "у": "y", "γ": "y", "ᴢ": "z",
}
# Digits and signs that stand for letters inside a word.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "l", "+": "t", "€": "e"}
_LETTERS = str.maketrans(LOOKALIKES)
_SIGNS = str.maketrans(SUBSTITUTES)


def fold(word: str) -> str:
    """A word as the lexicon sees it; empty if nothing of it is left."""
    if not word.isascii():
        word = unicodedata.normalize("NFKD", word)
        word = "".join(c for c in word if unicodedata.category(c) not in ("Mn", "Cf"))
    word = word.casefold().translate(_LETTERS)
    end = len(word)
    while end and not word[end - 1].isalnum():
        end -= 1
    start = 0
    while start < end and not word[start].isalnum() and not (word[start] in SUBSTITUTES and word[start + 1].isalpha()):
        start += 1
    word = word[start:end]
    if not word.isalpha() and any(map(str.isalpha, word)):
        word = word.translate(_SIGNS)
    return "".join(filter(str.isalnum, word))


class Folded(dict):
    """Folded words; the first half million different words of a task are remembered."""

    def __missing__(self, word: bytes) -> str:
        value = fold(word.decode())
        if len(self) < CACHED_WORDS:
            self[word] = value
        return value

    def text(self, text: bytes) -> tuple[str, int]:
        """The folded words, each between blanks, and their number."""
        words = [w for w in map(self.__getitem__, text.split()) if w]
        return f" {' '.join(words)} ", len(words)


@dataclass
class Lexicon:
    """Weights of patterns (" word " or " beginning"), exception phrases, and the logistic scale."""

    weights: dict[str, float]
    exceptions: list[str] = field(default_factory=list)
    intercept: float = -4.0
    slope: float = 1.0

    def automaton(self) -> ahocorasick.Automaton | None:
        if not self.weights:
            return None
        made = ahocorasick.Automaton()
        for pattern, weight in self.weights.items():
            made.add_word(pattern, (len(pattern), weight))
        for phrase in self.exceptions:
            made.add_word(phrase, (len(phrase), 0.0))
        made.make_automaton()
        return made

    def hits(self, automaton: ahocorasick.Automaton | None, text: str) -> list[tuple[int, int, float]]:
        """(start, end, weight) of the matches that no exception phrase holds; of overlapping ones each counts."""
        if automaton is None:
            return []
        found = [(end - size + 1, end + 1, weight) for end, (size, weight) in automaton.iter(text)]
        excepted = [(a, b) for a, b, weight in found if not weight]
        return [x for x in found if x[2] and not any(a <= x[0] and x[1] <= b for a, b in excepted)]

    def score(self, burden: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.intercept + self.slope * burden))))


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """(doc_id, text, y) of labelled documents that are not held out, at most about ``sample_docs`` of them."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y"))
    known = known.where(~held_out(F.col("doc_id"))).where("doc_id is not null and y is not null").groupBy("doc_id").agg(F.max("y").alias("y"))
    known = sampled(known, sample_docs)  # bounded by the parameter, hence the broadcast
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(known), "doc_id")


def log_odds(hit: Column, clean: Column, all_hit: int, all_clean: int) -> Column:
    """Lower 95 % limit of the log-odds of a pattern."""
    odds = F.log((hit + 0.5) / (all_hit + 1)) - F.log((clean + 0.5) / (all_clean + 1))
    return odds - 1.645 * F.sqrt(1 / (hit + 0.5) + 1 / (clean + 0.5))


def learn_weights(training: DataFrame, size: int = LEXICON_SIZE) -> dict[str, float]:
    """The most telling words and word beginnings; of beginnings that say the same the shortest stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folded = Folded()
        for part, texts in sliced(batches, "text"):
            words = [sorted({w for w in map(folded.__getitem__, t.split()) if w}) for t in texts]
            yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("y")), pa.array(words, pa.list_(pa.string()))], names=["y", "words"])

    totals = training.agg(F.sum("y"), F.sum(1 - F.col("y"))).first()
    if not totals[0] or not totals[1]:
        return {}
    words = training.mapInArrow(run, "y int, words array<string>").select("y", F.explode("words").alias("word"))
    words = materialize(words.groupBy("word").agg(F.sum("y").alias("hit"), F.sum(1 - F.col("y")).alias("clean")))
    starts = F.filter(F.transform(F.sequence(F.lit(PREFIXES.start), F.lit(PREFIXES.stop - 1)), lambda n: F.when(F.length("word") >= n, F.concat(F.lit(" "), F.substring("word", F.lit(1), n)))), lambda p: p.isNotNull())
    patterns = words.select(F.explode(F.concat(F.array(F.concat(F.lit(" "), "word", F.lit(" "))), starts)).alias("pattern"), "hit", "clean")
    patterns = patterns.groupBy("pattern").agg(F.sum("hit").alias("hit"), F.sum("clean").alias("clean"))
    patterns = patterns.withColumn("odds", log_odds(F.col("hit"), F.col("clean"), *totals))
    patterns = patterns.where((F.col("hit") >= LEAST_DOCS) & (F.col("odds") >= LEAST_LOG_ODDS) & (F.col("hit") >= LEAST_PRECISION * (F.col("hit") + F.col("clean"))))
    best = patterns.orderBy(F.desc(F.col("odds") * F.log1p("hit")), "pattern").limit(4 * size).toPandas()
    chosen: dict[str, float] = {}
    for row in best.sort_values(["pattern"], key=lambda s: s.str.len(), kind="stable").itertuples():
        shorter = [chosen[row.pattern[:n]] for n in range(PREFIXES.start + 1, len(row.pattern)) if row.pattern[:n] in chosen]
        if not shorter or row.odds > max(shorter) + 1.0:
            chosen[row.pattern] = float(row.odds)
    return dict(list(chosen.items())[:size])


def learn_exceptions(training: DataFrame, lexicon: Lexicon, size: int = EXCEPTIONS_SIZE) -> list[str]:
    """Phrases of a match and a neighbouring word that occur in clean documents only, in at least ``LEAST_DOCS`` of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folded, automaton = Folded(), lexicon.automaton()
        for part, texts in sliced(batches, "text"):
            phrases = []
            for t in texts:
                text, _ = folded.text(t)
                own = set()
                for start, end, _ in lexicon.hits(automaton, text):
                    stop = text.find(" ", max(end - 1, start + 1))
                    before, after = text.rfind(" ", 0, start), text.find(" ", stop + 1)
                    own |= {text[a : b + 1] for a, b in ((before, stop), (start, after)) if a >= 0 and b > a}
                phrases.append(sorted(own))
            yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("y")), pa.array(phrases, pa.list_(pa.string()))], names=["y", "phrases"])

    found = training.mapInArrow(run, "y int, phrases array<string>").select("y", F.explode("phrases").alias("phrase"))
    found = found.groupBy("phrase").agg(F.sum("y").alias("hit"), F.count("*").alias("n")).where((F.col("hit") == 0) & (F.col("n") >= LEAST_DOCS))
    return [row.phrase for row in found.orderBy(F.desc("n"), "phrase").limit(size).collect()]


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Intercept and slope by Newton steps; a slight penalty keeps separable data finite."""
    design, beta = np.c_[np.ones(len(x)), x], np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        step = np.linalg.solve((design.T * (p * (1 - p))) @ design + 1e-2 * np.eye(2), design.T @ (y - p) - 1e-2 * beta)
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(max(0.0, beta[1]))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", sample_docs: int = SAMPLE_DOCS) -> Lexicon:
    """A lexicon learned from the labelled documents that are not held out; without labels it is empty."""
    training = materialize(training_rows(docs, labels, label_col, sample_docs))
    lexicon = Lexicon(learn_weights(training))
    lexicon.exceptions = learn_exceptions(training, lexicon)
    seen = score(training, lexicon).join(training.select("doc_id", "y").distinct(), "doc_id").select("burden", "y").toPandas()
    if len(seen):
        lexicon.intercept, lexicon.slope = logistic(seen["burden"].to_numpy(float), seen["y"].to_numpy(float))
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, burden, score, n_hits) a row. Null and empty texts have no hits and the lowest score."""
    schema = pa.schema([("doc_id", pa.int64()), ("burden", pa.float64()), ("score", pa.float64()), ("n_hits", pa.int64())])
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    tool: list = []

    def make(part: pa.RecordBatch, texts: list[bytes]) -> list:
        if not tool:
            tool.extend((Folded(), lexicon.automaton()))
        folded, automaton = tool
        burdens, hits = [], []
        for text in texts:
            words, n = folded.text(text)
            found = lexicon.hits(automaton, words)
            burdens.append(sum(w for _, _, w in found) / math.sqrt(n + LENGTH_OFFSET))
            hits.append(len(found))
        return [part.column(0), burdens, [lexicon.score(b) for b in burdens], hits]

    return per_text(rows, "text", "doc_id long, burden double, score double, n_hits long", schema, make)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= PREDICT_AT, 1).otherwise(0).alias("predicted"), "n_hits")
