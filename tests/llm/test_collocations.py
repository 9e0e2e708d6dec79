import random
import re
from collections import Counter
from decimal import Decimal

import pyarrow as pa
import pytest

from cohortspark.llm import collocations

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, top=2000, share=80):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    counts[lang, tuple(words[i : i + k])] += 1
    candidates = {k: n for k, n in counts.items() if len(k[1]) > 1 and n >= least}
    inside = Counter()
    for (lang, words), n in candidates.items():
        for k in range(2, len(words)):
            for i in range(len(words) - k + 1):
                inside[lang, words[i : i + k]] = max(inside[lang, words[i : i + k]], n)
    found = {}
    for (lang, words), a in candidates.items():
        if 100 * inside[lang, words] >= share * a:
            continue
        score, _, left, right = min((2_000_000 * a // (counts[lang, words[:k]] + counts[lang, words[k:]]), k, counts[lang, words[:k]], counts[lang, words[k:]]) for k in range(1, len(words)))
        found.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), left, right))
    result = set()
    for lang, own in found.items():
        for rank, (score, a, phrase, left, right) in enumerate(sorted(own)[:top], 1):
            result.add((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return result


def result(df):
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize("least", [1, 3, 300])
def test_equals_brute_force(spark, least):
    draw = random.Random(least)
    words = [f"w{i}" for i in range(12)] + ["É", "ÀB", "x\x00y", "z\x1c", "'s"]
    rows = []
    for i in range(60):
        text = "".join(draw.choice(words) + draw.choice([" ", " ", " ", "\t", ". ", "\n", "  ", "!", "\x0b", "\r\n"]) for _ in range(draw.randint(0, 90)))
        rows.append((draw.choice(["en", "fr", None, "und", ""]), text.upper() if i % 3 else text))
    passage = " ".join(f"p{i}" for i in range(40))  # a long unary path
    rows += [("en", passage)] * 4 + [("en", "a b c a b c a b c a b c a b c a b c a b c")] * 3 + [("fr", "loop " * 50)]
    frame = spark.createDataFrame(rows, "lang string, text string")
    found = result(collocations.collocations(frame, least=least, top=150))
    assert len(found) == len(set(found)) and set(found) == brute(rows, least, 150)


def test_odd_rows(spark, odd, none):
    rows = [(r.lang, r.text) for r in odd.collect()]
    assert set(result(collocations.collocations(odd, least=2, top=300))) == brute(rows, 2, 300)
    assert result(collocations.collocations(none)) == []
    blank = spark.createDataFrame([(None, None), ("en", " .,\n")], "lang string, text string")
    assert result(collocations.collocations(blank, least=1)) == []


def test_paths_join_what_runs_through_and_stop_at_forks(spark):
    rows = [("en", "a b c d e f g")] * 3 + [("en", "c d e x")] + [("en", "m n o p m n o p m n o")]
    graph = collocations.Graph(spark.createDataFrame(rows, "lang string, text string"), least=1)
    names = {r.w: r.word for r in graph.words.collect()}
    found = sorted((" ".join(names[w] for w in r.words), r.n) for r in graph.paths().collect())
    assert ("a b c d e", 3) in found and ("c d e f g", 3) in found and ("c d e x", 1) in found
    edges = [tuple(w.split()[i : i + 4]) for w, _ in found for i in range(len(w.split()) - 3)]
    assert len(edges) == len(set(edges)) == graph.edges.count()  # each edge lies on one path


def test_cells_never_fall_short_and_cuts_keep_counts(spark, monkeypatch):
    monkeypatch.setattr(collocations, "CELLS", (16, 16, 16, 16))
    draw = random.Random(9)
    rows = [("en", " ".join(draw.choices([f"w{i}" for i in range(30)], k=400))) for _ in range(40)]
    frame = spark.createDataFrame(rows, "lang string, text string")
    assert set(result(collocations.collocations(frame, least=20))) == brute(rows, 20)


def test_scores_beyond_64_bits_are_exact(spark):
    graph = collocations.Graph.__new__(collocations.Graph)
    a, b, big = 5, 6, 5_000_000_000_000_000
    levels = {1: [(a, 0, 0, 0, 3 * big), (b, 0, 0, 0, 2 * big)], 2: [(a, b, 0, 0, big)], 3: [], 4: []}
    columns = collocations.W
    make = lambda rows: spark.createDataFrame(rows, ", ".join(f"{c} long" for c in [*columns, "n"]))
    graph.least, graph.levels = 30, {k: make(v) for k, v in levels.items()}
    graph.edges = make([]).selectExpr("*", "0L as id").where("false")
    row = graph.scored().first()
    assert (row.a, row.l, row.r, row.score) == (big, 3 * big, 2 * big, int(Decimal(2_000_000 * big) // (5 * big)))


def test_remembered_words_are_bounded_over_all_languages(monkeypatch):
    monkeypatch.setattr(collocations, "CACHED_WORDS", 10)
    words = collocations.Words(1)
    text = [" ".join(f"{lang}{i}" for i in range(50)) for lang in "abcd"]
    batch = pa.RecordBatch.from_arrays([pa.array(list("abcd")), pa.array(text)], names=["lang", "text"])
    (hashes, sizes, _), = words.runs(iter([batch]))
    assert sizes == dict.fromkeys("abcd", 50) and (hashes > 1).sum() == 200
    assert sum(len(h) - 2 for h in words.by_language.values()) == 10


def test_counted_grams_come_in_small_batches(spark, monkeypatch):
    monkeypatch.setattr(collocations, "SENT", 7)
    rows = spark.createDataFrame([("en", " ".join(f"w{i % 30}" for i in range(300)))] * 3, "lang string, text string")
    cells = collocations.survey(rows, 0)
    got = collocations.counted_rows(rows, cells, 0, 2).where("w1 is not null and word is null")
    monkeypatch.setattr(collocations, "SENT", 1 << 16)
    want = collocations.counted_rows(rows, cells, 0, 2).where("w1 is not null and word is null")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) != []
