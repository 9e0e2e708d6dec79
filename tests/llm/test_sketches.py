import hashlib
import re

import pytest
from pyspark.sql import functions as F

from cohortspark.llm import sketches


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_query_against_exact_sets(spark, sf_dir, texts):
    found = {r.doc_id: r for r in sketches.op9_fingerprints(spark, sf_dir).collect()}
    ids, errors = sorted(texts), []
    assert sorted(found) == ids
    for i, following in zip(ids, ids[1:] + ids[:1], strict=True):
        t, n, half = texts[i], texts[following], len(texts[i]) // 2
        edited = t[: len(t) - half] + n[:half]
        assert found[i].n_chars == len(t) and found[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        errors += [abs(found[i].near_edited - jaccard(shingles(t), shingles(edited))), abs(found[i].near_next - jaccard(shingles(t), shingles(n)))]
        assert found[i].distinct_shingles == pytest.approx(len(shingles(t)), rel=0.4, abs=1e-9)
    assert max(errors) < 0.2 and sum(errors) / len(errors) < 0.03
    same = {}
    for i, t in texts.items():
        assert same.setdefault(t, found[i].fingerprint) == found[i].fingerprint


def test_no_python_on_the_main_path(spark, sf_dir):
    plan = sketches.op9_fingerprints(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)


def test_parts_merge(spark):
    words = [f"w{i}" for i in range(400)]
    a, b, both = " ".join(words[:250]), " ".join(words[246:]), " ".join(words)
    row = spark.createDataFrame([(a, b, both)], "a string, b string, u string").select(*[sketches.sketch(F.col(c)).alias(c) for c in "abu"])
    row = row.select(sketches.merge(F.col("a"), F.col("b")).alias("m"), "u", sketches.containment(F.col("a"), F.col("u")).alias("c"), sketches.distinct_count(F.col("u")).alias("n"), sketches.resemblance(F.col("a"), F.col("u")).alias("r")).first()
    assert row.m == row.u and len(row.m) == 128 and row.c > 0.8 and abs(row.n - 396) < 150 and abs(row.r - 246 / 396) < 0.15


def test_odd_rows_and_wrapping(spark, odd, none):
    found = sketches.edited_pairs(odd).collect()
    assert len(found) == 14 and sketches.edited_pairs(none).count() == 0
    by_id = {r.doc_id: r for r in found}
    assert by_id[2].edited == "" and by_id[2].sketch == [] and by_id[11].edited == "onL"  # half of three is one
    one = sketches.edited_pairs(spark.createDataFrame([(4, "abcd")], "doc_id long, text string")).first()
    assert one.edited == "abab"
    far = spark.createDataFrame([(-(2**62), "ab" * 3), (0, "cd" * 3), (5, "ef" * 3), (2**62, "gh" * 3)], "doc_id long, text string")
    assert {r.doc_id: r.edited for r in sketches.edited_pairs(far).collect()} == {-(2**62): "abacdc", 0: "cdcefe", 5: "efeghg", 2**62: "ghgaba"}


def test_next_over_many_ranges(spark):
    frame = spark.range(0, 5000).select((F.col("id") * F.col("id") * 3).alias("doc_id"), F.col("id").cast("string").alias("text")).withColumn("tie", F.lit(0).cast("long"))
    bucket, n = sketches.id_bucket(frame)
    assert frame.select(bucket).distinct().count() > 2 and n >= 64
    found = sketches.with_next(frame, ["text"]).collect()
    assert len(found) == 5000 and all(int(r.next_text) == (int(r.text) + 1) % 5000 for r in found)
