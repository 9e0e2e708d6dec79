import hashlib
import re
from collections import Counter, defaultdict

import duckdb
from pyspark.sql import functions as F

from cohortspark.llm import lines, queries, substrings


def rows_of(frame, columns):
    return sorted(tuple(r[c] for c in columns) for r in frame.select(*columns).collect())


def from_sql(sf_dir, sql, columns):
    con = duckdb.connect()
    for name in ("documents", "pages"):
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return sorted(con.sql(f"select {', '.join(columns)} from ({sql})").fetchall())


def test_line_query_equals_sql(spark, sf_dir):
    columns = ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
    assert rows_of(queries.QUERIES["op8_lines"](spark, sf_dir), columns) == from_sql(sf_dir, lines.OP8_SQL, columns)


def test_window_query_equals_sql(spark, sf_dir):
    columns = ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert rows_of(queries.QUERIES["op4_substrings"](spark, sf_dir), columns) == from_sql(sf_dir, substrings.OP4_SQL, columns)


def brute_lines(rows, min_chars, min_docs):
    key = lambda line: re.sub("[A-Z]", lambda m: m.group().lower(), line.strip(" \t\n\x0b\x0c\r"))
    held = defaultdict(set)
    for i, t in rows:
        for line in t.split("\n"):
            held[key(line)].add(i)
    last = {k: max(v) for k, v in held.items() if len(k) >= min_chars and len(v) >= min_docs}
    return {i: [x for x in t.split("\n") if last.get(key(x), i) == i] for i, t in rows}


def test_lines_by_batches(spark):
    shared = "A line that many documents hold, long enough to count."
    rows = [(i, f"own {i}\n {shared.upper() if i % 2 else shared}\t\nshort\n{shared}") for i in range(1, 30)] + [(40, "a" * 40 + "\n" + "é" * 39), (41, "A" * 40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for batches in (1, 3, 9):
        found = {r.doc_id: r["__kept"] for r in lines.dedup_lines(frame, batches=batches).collect()}
        assert found == brute_lines(rows, 40, 5)


def test_runs_are_levelled_and_know_new_lines(spark):
    store = lines.LineRuns(spark, fanout=2)
    fresh = []
    for k in range(5):
        batch = spark.createDataFrame([(10 * k + j, j % 4 + k, 0) for j in range(8)], "doc_id long, h1 long, h2 long")
        fresh.append(store.add(batch).where("fresh").count())
    assert fresh == [4, 1, 1, 1, 1] and [len(level) for level in store.levels] == [1, 0, 1]
    assert {r.h1: r.docs for r in store.merged(store.runs()).collect()} == {0: 2, 1: 4, 2: 6, 3: 8, 4: 8, 5: 6, 6: 4, 7: 2}
    assert store.merged(store.runs()).where("not fresh").count() == 0


def test_odd_lines(odd, none):
    found = lines.drop_lines(odd)
    assert found.columns == odd.columns and found.schema == odd.schema and found.count() == odd.count()
    before = {(r.doc_id, r.text) for r in odd.collect()}
    assert {(r.doc_id, r.text) for r in found.collect()} == before  # no line is held by five documents
    few = {r.doc_id: r.text for r in lines.drop_lines(odd, min_docs=2).where("doc_id is not null").collect()}
    assert few[1] == "" and few[9] != "" and few[2] is None and few[3] == ""
    assert lines.dedup_lines(none).count() == 0


def brute_windows(texts, window):
    words = {k: re.findall(r"[^\x20\x09-\x0D]+", t or "") for k, t in texts}
    seen = Counter(tuple(w[i : i + window]) for w in words.values() for i in range(len(w) - window + 1))
    found = {}
    for k, w in words.items():
        gone = {j for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        found[k] = (len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest())
    return found


def test_windows_equal_brute_force(spark):
    passage = " ".join(f"p{i}" for i in range(50))
    texts = [
        (1, f"a b {passage} c"), (2, f"{passage}"), (3, "x y z " * 40), (4, " ".join(f"u{i}" for i in range(200))), (5, None), (6, ""),
        (7, f"{' '.join(f'q{i}' for i in range(34))} {passage[:60]}"), (8, f"lead {passage} mid {passage} end"), (9, " ".join(f"p{i}" for i in range(20, 54))),
    ]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    for window, anchor in ((35, 12), (5, 12), (5, 2)):
        found = {r.doc_id: (r.n_words, r.n_removed, r.sha) for r in substrings.remove_repeats(frame, window=window, anchor=anchor).withColumn("sha", F.lower(F.hex("kept_sha"))).collect()}
        assert found == brute_windows(texts, window)
    spans = {r.doc_id: [(s.start, s.end) for s in r.spans or []] for r in substrings.remove_repeats(frame).collect()}
    assert spans[1] == [(2, 52)] and spans[8] == [(1, 51), (52, 102)] and spans[2] == [(0, 50)]


def test_odd_windows(odd, none):
    found = {(r.doc_id, r.n_words, r.n_removed) for r in substrings.remove_repeats(odd).collect()}
    assert {(1, 120, 120), (5, 120, 120), (2, 0, 0), (4, 0, 0), (10, 121, 120), (9, 120, 0), (6, 120_000, 0)} <= found
    assert substrings.remove_repeats(odd).count() == 14 and substrings.remove_repeats(none).count() == 0
