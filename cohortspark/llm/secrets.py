"""Secret scan: fixed patterns, and a battery of randomness tests on long tokens.

The patterns find assignments to password-like names, access keys and hexadecimal runs. The battery looks at
every other long token: it infers an encoding, tests the token against a random string of that encoding
(chi-squared uniformity over the alphabet, runs about the middle of the alphabet, serial correlation of
neighbours), and calls it a secret unless the tests reject randomness. Rejections are controlled over all
candidates of the corpus by Benjamini-Hochberg with weights by length: a long token gives the tests more power
and so more of the error budget, and a token too short for an encoding's tests is no candidate. A token with '/',
'+', '-' or '_' is tested as a whole and in its pieces, so that a path before a random part hides nothing.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.llm.common import per_text, table
from cohortspark.sources.io import materialize

# The patterns of the base kinds, and the least lengths.
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}", re.ASCII)
HEX = re.compile(r"[0-9a-f]{24,}", re.ASCII)
ASSIGN_LEAST = 6
KINDS = ("assign", "access", "hex", "random")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}", re.ASCII)
#: Encodings in the order in which they are tried: alphabet, least length, classes of signs that must occur.
ENCODINGS = (
    ("hex", "0123456789abcdef", 24, ("0123456789", "abcdef")),
    ("HEX", "0123456789ABCDEF", 24, ("0123456789", "ABCDEF")),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 24, ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "234567")),
    ("base36", "0123456789abcdefghijklmnopqrstuvwxyz", 24, ("0123456789", "abcdefghijklmnopqrstuvwxyz")),
    ("BASE36", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", 24, ("0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")),
    ("base62", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", 20, ("0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")),
    ("base64", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/", 20, ("0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")),
    ("base64url", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz_-", 20, ("0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")),
)
#: Mixed-case encodings once more, for random tokens that happen to hold no digit.
DIGITLESS = tuple((name, alphabet, least, classes[1:]) for name, alphabet, least, classes in ENCODINGS if name in ("base62", "base64", "base64url"))
_TABLES = tuple((name, {c: i for i, c in enumerate(alphabet)}, least, tuple(map(frozenset, classes))) for name, alphabet, least, classes in ENCODINGS + DIGITLESS)
PIECES = tuple(re.compile(p, re.ASCII) for p in ("[^/+]{20,}", "[^-_]{20,}", "[^/+_-]{20,}"))
RATE = 0.05
LENGTH_WEIGHT = 32
#: p-values are counted in cells of a logarithmic scale, ``CELLS`` to a factor of ten, down to 1e-30.
CELLS, LOWEST = 50, 30


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base kinds, leftmost and non-overlapping within each kind."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    return found + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


def encoding(token: str) -> tuple[str, list[int]] | None:
    """The first encoding that fits, with the places of the token's signs in its alphabet."""
    core = token.rstrip("=")
    signs = frozenset(core)
    for name, places, least, classes in _TABLES:
        if len(core) >= least and signs <= places.keys() and all(signs & c for c in classes):
            return name, [places[c] for c in core]
    return None


def normal_tail(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def battery(places: list[int], letters: int) -> tuple[float, float, float]:
    """p-values of the chi-squared, runs and serial-correlation tests of a random string over ``letters`` signs.

    Chi-squared is taken over the alphabet cut into cells that expect at least two signs each, with the
    Wilson-Hilferty normal approximation; only an excess counts against randomness.
    """
    x = np.asarray(places, float)
    n = len(x)
    cut = max(2, min(letters, n // 2))
    observed = np.bincount((x * cut / letters).astype(int), minlength=cut)
    share = np.bincount(np.arange(letters) * cut // letters, minlength=cut) / letters
    chi, free = float(((observed - n * share) ** 2 / (n * share)).sum()), cut - 1
    z = ((chi / free) ** (1 / 3) - (1 - 2 / (9 * free))) / math.sqrt(2 / (9 * free))
    p_chi = 0.5 * math.erfc(z / math.sqrt(2))
    high = x >= letters / 2
    a, b = int(high.sum()), int(n - high.sum())
    if not a or not b:
        p_runs = 2.0 ** (1 - n)
    else:
        runs = 1 + int((high[1:] != high[:-1]).sum())
        mean = 1 + 2 * a * b / n
        spread = 2 * a * b * (2 * a * b - n) / (n * n * (n - 1))
        p_runs = normal_tail((runs - mean) / math.sqrt(spread)) if spread > 0 else 1.0
    centred = x - x.mean()
    total = float((centred**2).sum())
    r = float((centred[1:] * centred[:-1]).sum()) / total if total else 1.0
    p_serial = normal_tail((r + 1 / n) * math.sqrt(n))
    return max(p_chi, 1e-300), max(p_runs, 1e-300), max(p_serial, 1e-300)


def combined(ps: tuple[float, ...]) -> float:
    """Smallest p-value of the battery, corrected for their number."""
    return min(1.0, len(ps) * min(ps))


def weight(length: int) -> float:
    """Share of the error budget by length, between a half and two."""
    return max(0.5, min(2.0, length / LENGTH_WEIGHT))


def pieces(start: int, token: str) -> list[tuple[int, int]]:
    """Spans of a token and of its pieces between separators that reach the least length of any encoding."""
    spans = {(start, start + len(token))}
    if any(c in token for c in "/+-_"):
        spans |= {(start + m.start(), start + m.end()) for cut in PIECES for m in cut.finditer(token)}
    return sorted(spans)


def candidates(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str, float, int]]:
    """(start, end, encoding, p, length) of the tokens and pieces outside the base spans that look encoded."""
    found = []
    for m in CANDIDATE.finditer(text):
        for start, end in pieces(m.start(), m.group()):
            if any(a < end and start < b for a, b, _ in base):
                continue
            fits = encoding(text[start:end])
            if fits is not None:
                name, places = fits
                letters = next(len(e[1]) for e in ENCODINGS if e[0] == name)
                found.append((start, end, name, combined(battery(places, letters)), len(places)))
    return found


def listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]))))


SCAN = "doc_id long, n_assign long, n_access long, n_hex long, base string, found array<struct<start:long,end:long,encoding:string,p:double,cell:int,length:long>>"
SCAN_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base", pa.string()),
    ("found", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("encoding", pa.string()), ("p", pa.float64()), ("cell", pa.int32()), ("length", pa.int64())]))),
])


def cell(p: float, length: int) -> int:
    """Cell of a weighted p-value: 0 for the smallest ones."""
    weighted = min(1.0, p / weight(length))
    return max(0, int((LOWEST + math.log10(max(weighted, 10.0**-LOWEST))) * CELLS))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base spans and tested candidates of each text; null is empty."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def make(part: pa.RecordBatch, texts: list[bytes]) -> list:
        counts, base, found = {k: [] for k in KINDS}, [], []
        for raw in texts:
            text = raw.decode()
            spans = base_spans(text)
            for kind in KINDS:
                counts[kind].append(sum(s[2] == kind for s in spans))
            base.append(listed(spans))
            found.append([{"start": a, "end": b, "encoding": e, "p": p, "cell": cell(p, n), "length": n} for a, b, e, p, n in candidates(text, spans)])
        return [part.column(0), counts["assign"], counts["access"], counts["hex"], base, found]

    return per_text(rows, "text", SCAN, SCAN_ARROW, make)


def rejected_below(scanned: DataFrame, rate: float = RATE) -> int:
    """The first cell whose candidates count as random: Benjamini-Hochberg over the cell counts of all candidates."""
    counts = scanned.select(F.explode("found").alias("f")).groupBy("f.cell").agg(F.count("*").alias("n")).collect()  # a few thousand cells at most
    total, seen, limit = sum(r.n for r in counts), 0, 0
    for r in sorted(counts, key=lambda r: r.cell):
        seen += r.n
        if 10.0 ** ((r.cell + 1) / CELLS - LOWEST) <= rate * seen / total:
            limit = r.cell + 1
    return limit


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = RATE) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base, random) a row.

    ``base`` lists kind:start:end of the pattern spans; ``random`` holds the tokens and pieces that pass the battery, none
    inside another. Null and empty texts have none. Every row is scanned by itself, so repeated rows and ids stay as they are.
    """
    scanned = materialize(scan(docs, id_col, text_col))
    limit = rejected_below(scanned, rate)
    passed = F.filter("found", lambda f: f["cell"] >= limit)
    inside = lambda f, g: (g["start"] <= f["start"]) & (f["end"] <= g["end"]) & (g["end"] - g["start"] > f["end"] - f["start"])
    outer = F.filter("passed", lambda f: ~F.exists("passed", lambda g: inside(f, g)))
    return scanned.withColumn("passed", passed).withColumn("random", outer).drop("found", "passed")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    extra = F.transform("random", lambda f: F.concat_ws(":", F.lit("random"), f["start"].cast("string"), f["end"].cast("string")))
    parts = F.concat(F.when(F.col("base") == "", F.array().cast("array<string>")).otherwise(F.split("base", ",")), extra)
    keyed = F.transform(parts, lambda s: F.struct(
        F.split(s, ":")[1].cast("long").alias("start"), F.array_position(F.array(*map(F.lit, KINDS)), F.split(s, ":")[0]).alias("kind"), s.alias("span")
    ))
    spans = F.array_join(F.transform(F.array_sort(keyed), lambda x: x["span"]), ",")
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), spans.alias("spans"), F.size("random").cast("long").alias("n_random"))
