"""Language identification as a mixture: proportions of languages in a text by expectation-maximisation.

Each language is a distribution over hashed byte n-grams. A text's n-grams are taken as drawn from a mixture of
languages; EM estimates the proportions, and of the nested sets of its strongest languages the one with the best
penalised likelihood is kept. The model is counted on a bounded sample of labelled documents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.llm.common import per_text, sliced, table

#: The model is fitted on about this many labelled documents (all, if there are fewer).
SAMPLE_DOCS = 20_000
CELLS = 1 << 16
SIZES = (2, 3, 4)
SMOOTHING = 0.5
PENALTY = 3.0
LEAST_SHARE = 0.02
ROUNDS = 12
UNKNOWN = "und"

_KEEP = np.full(256, 32, np.uint8)
_KEEP[128:] = np.arange(128, 256)
_KEEP[97:123] = np.arange(97, 123)
_KEEP[65:91] = np.arange(97, 123)
_FACTOR = {2: 0x9E3779B1, 3: 0x85EBCA6B, 4: 0xC2B2AE35}


def cells(text: bytes) -> np.ndarray:
    """Hash cells of the byte n-grams of the letters of a text; blanks and other signs count as one blank."""
    letters = _KEEP[np.frombuffer(b" " + text.decode().lower().encode() + b" ", np.uint8)]
    blank = letters == 32
    letters = letters[~(blank & np.r_[False, blank[:-1]])].astype(np.uint32)
    found, gram = [], letters
    for size in range(2, max(SIZES) + 1):
        gram = (gram[:-1] << np.uint32(8)) | letters[size - 1 :]
        if size in SIZES:
            found.append((gram * np.uint32(_FACTOR[size])) >> np.uint32(16))
    return np.concatenate(found)


def has_letter(text: bytes) -> bool:
    return any(65 <= c <= 90 or 97 <= c <= 122 for c in text[:64]) or any(map(str.isalpha, text.decode()))


@dataclass
class Model:
    """Languages in order, and the probability of each cell in each of them (cells x languages)."""

    languages: list[str]
    chances: np.ndarray

    def mixture(self, text: bytes) -> tuple[str, float, dict[str, float]]:
        """The main language, its score, and the proportions of the languages chosen."""
        return self.fitted(text)[:3]

    def fitted(self, text: bytes) -> tuple[str, float, dict[str, float], float]:
        """The same, and by how much the mixture explains an n-gram of the text better than chance (mean log ratio)."""
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0, {}, 0.0
        found, counts = np.unique(cells(text), return_counts=True)
        chances = self.chances[found].astype(np.float64)
        total = counts.sum()
        alone = counts @ np.log(chances)
        shares = em(chances, counts, np.full(len(self.languages), 1 / len(self.languages)))
        order = np.argsort(-shares, kind="stable")
        best, chosen, proportions = -np.inf, order[:1], np.ones(1)
        for size in range(1, len(order) + 1):
            own = order[:size]
            if size > 1 and shares[own[-1]] < LEAST_SHARE:
                break
            if size == 1:
                own = np.array([int(np.argmax(alone))])
                fitted, likelihood = np.ones(1), alone[own[0]]
            else:
                fitted = em(chances[:, own], counts, np.maximum(shares[own], 1e-6) / np.maximum(shares[own], 1e-6).sum())
                likelihood = counts @ np.log(chances[:, own] @ fitted)
            value = likelihood - PENALTY * (size - 1) * np.log(total)
            if value <= best:
                break
            best, chosen, proportions = value, own, fitted
        main = int(np.argmax(proportions))
        weight = np.exp((alone - alone.max()) / len(SIZES))
        sure = weight[chosen[main]] / weight.sum() if len(chosen) == 1 else 1.0
        return self.languages[chosen[main]], float(min(1.0, proportions[main] * sure)), {self.languages[i]: float(p) for i, p in zip(chosen, proportions, strict=True)}, float(counts @ np.log(chances[:, chosen] @ proportions) / total + np.log(CELLS))


def em(chances: np.ndarray, counts: np.ndarray, shares: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Mixture proportions after some rounds of expectation-maximisation."""
    total = counts.sum()
    for _ in range(rounds):
        new = shares * (chances.T @ (counts / (chances @ shares))) / total
        if np.abs(new - shares).max() < 1e-4:
            return new
        shares = new
    return shares


def sampled(rows: DataFrame, bound: int) -> DataFrame:
    """About ``bound`` of the rows, chosen by a hash of doc_id; all, if there are no more."""
    n = rows.count()
    if n <= bound:
        return rows
    return rows.where(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1_000_000)) < F.lit(int(1_000_000 * bound / n)))


def fit(training: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """A model of the labelled rows (doc_id, text, lang); without any, one that knows no language."""
    rows = sampled(training.where("text is not null and lang is not null"), sample_docs).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for part, texts in sliced(batches, "text"):
            for lang, text in zip(part.column(0).to_pylist(), texts, strict=True):
                sums[lang] = sums.get(lang, 0) + np.bincount(cells(text), minlength=CELLS)
        for lang, count in sums.items():
            at = np.nonzero(count)[0]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(count[at].astype(np.int64))], names=["lang", "cell", "n"])

    # at most CELLS rows a language
    counted = rows.mapInArrow(run, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(counted["lang"].unique())
    sums = np.full((CELLS, len(languages)), SMOOTHING)
    for k, lang in enumerate(languages):
        own = counted[counted["lang"] == lang]
        sums[own["cell"], k] += own["n"]
    return Model(languages, (sums / sums.sum(axis=0)).astype(np.float32))


def training_rows(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """Labelled rows that are not held out (crc32 of the id's text modulo 5 is not 0)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    return rows.where(~held_out(F.col("doc_id")))


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def shared_model(spark: SparkSession, model: Model) -> Callable[[], Model]:
    """The model for tasks: plain names and numbers are sent, as executors may have no copy of this package."""
    languages, shape = list(model.languages), model.chances.shape
    shared = spark.sparkContext.broadcast(model.chances.tobytes())  # CELLS x languages x 4 bytes
    return lambda: Model(languages, np.frombuffer(shared.value, np.float32).reshape(shape))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, mixture) a row; null texts and texts without a letter are ``und`` with score 0."""
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("mixture", pa.map_(pa.string(), pa.float64()))])
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    of_worker = shared_model(docs.sparkSession, model)

    def make(part: pa.RecordBatch, texts: list[bytes]) -> list:
        own = of_worker()
        found = [own.mixture(text) for text in texts]
        return [part.column(0), [x[0] for x in found], [x[1] for x in found], [list(x[2].items()) for x in found]]

    return per_text(rows, "text", "doc_id long, lang_pred string, score double, mixture map<string,double>", schema, make)


def keep_known(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least_gain: float = 0.0) -> DataFrame:
    """The documents, all columns, whose text has a letter and is explained by some mixture of known languages.

    A text is explained if its n-grams are likelier under its mixture than by chance (``least_gain``, mean log
    ratio), however many languages share it. Without a labelled row no language is known, and every text with a
    letter stays. Null, empty and blank texts go; repeated rows and rows without an id are judged each for itself.
    """
    model = fit(training_rows(docs, id_col, text_col, lang_col))
    of_worker = shared_model(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = of_worker()
        for part, texts in sliced(batches, text_col):
            kept = [has_letter(text) and (not own.languages or own.fitted(text)[3] >= least_gain) for text in texts]
            yield part.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(training_rows(docs, "doc_id", "text", "lang"))
    return predict(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "mixture")
