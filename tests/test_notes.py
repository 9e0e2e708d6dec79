import random
import re

from pyspark.sql import functions as F

from cohortspark.functions import scalars as sc
from cohortspark.plans import note_review as nr
from cohortspark.sources.lookups import CONCEPTS, concept_groups, concept_patterns

SCHEMA = "MRN string, HAR string, NOTE_ID string, NOTE_TEXT string, NOTE_DTTM string"


def notes(spark, texts):
    return spark.createDataFrame([("m", "h", f"n{i}", t, None) for i, t in enumerate(texts)], SCHEMA)


def test_match_across_a_line_break_flags_without_snippet(spark):
    got = nr.note_level(notes(spark, ["known checkpoint\ninhibitor use", "Keytruda given", None]), "handp", "all").orderBy("NOTE_ID").collect()
    assert (got[0].any_ici_general, got[0].snippet_ici_general) == (1, None)
    assert (got[1].any_ici_agent, got[1].snippet_ici_agent, got[1].rule_score, got[1].llm_priority_note) == (1, "Keytruda given", 3, 1)
    assert got[2].rule_score == 0 and got[2].any_radiology_edema == 0 and got[2].snippet_radiology_edema is None


def test_literal_prefilter_changes_nothing(spark):
    rng = random.Random(11)
    words = ["irae", "possible", "concern for", "Pneumonitis", "ICI", "iciñ", "favours", "cycle 3", "V.S.", "vs", "on",
             "pembrolizumab", "the", "\n", "  ", "posſible", "ırae", "suspected", "ground -glass", "ggo", "hepatitis due to immunotherapy"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 12))) for _ in range(300)]
    df = notes(spark, texts)
    got = nr.dictionary_flags(df, CONCEPTS, "radiology")
    patterns = concept_patterns(CONCEPTS, "radiology")
    plain = df.withColumn("clean", sc.normalize_text(F.col("NOTE_TEXT")))
    for group, pattern in patterns.items():
        plain = plain.withColumn(f"any_{group}", F.col("clean").rlike(sc.case_insensitive(pattern)).cast("int"))
        plain = plain.withColumn(f"snippet_{group}", sc.extract_snippet(F.col("NOTE_TEXT"), pattern))
    columns = ["NOTE_ID"] + [f"{p}_{g}" for g in patterns for p in ("any", "snippet")]
    assert sorted(map(str, got.select(*columns).collect())) == sorted(map(str, plain.select(*columns).collect()))
    assert got.agg(F.sum("any_qualifier_uncertainty")).first()[0] > 50


def test_encounter_queue_and_summary(spark):
    handp = spark.createDataFrame(
        [("m1", "h1", f"a{i}", "Keytruda, possible pneumonitis" if i else "Opdivo then pneumonitis and myocarditis", None)
         for i in range(4)]
        + [("m2", "h2", "b1", "sepsis", "2024-01-01"), (None, "h3", "c1", "cytokine storm", None)], SCHEMA)
    radiology = spark.createDataFrame(
        [("m1", "h1", f"r{i}", "ground-glass", None, "CT CHEST") for i in range(5)]
        + [("m2", "h2", "s1", "normal", None, "CT HEAD"), ("m2", "h2", "s2", "lung base clear", None, "CT HEAD")],
        SCHEMA + ", PROC_NAME string")
    level = nr.all_notes(handp, radiology)
    assert level.count() == 12
    enc = nr.encounter_level(level)
    got = {r.HAR: r for r in enc.collect()}
    assert got["h1"].encounter_rule_label == nr.HIGH_LABEL and got["h1"].n_notes == 9
    assert got["h1"].example_ici_snippet == "Opdivo then pneumonitis and myocarditis"
    assert got["h2"].encounter_rule_label == "competing_diagnosis_only" and got["h2"].encounter_llm_priority == 0
    assert got["h3"].encounter_rule_label == nr.MODERATE_LABEL
    queue = nr.review_queue(level, enc)
    assert queue.columns == [c for c in nr.QUEUE_COLUMNS if c in queue.columns]
    kept = sorted((r.HAR, r.NOTE_ID) for r in queue.collect())
    assert kept == [("h1", "a0"), ("h1", "a1"), ("h1", "r0"), ("h1", "r1"), ("h1", "r2"), ("h3", "c1")]
    total = nr.extraction_summary(level, enc, queue).first()
    assert tuple(total) == (12, 6, 6, 3, 1, 1, 6)


def test_top_k_is_cut_before_the_shuffle(spark):
    level = nr.all_notes(notes(spark, ["Keytruda"]), None)
    plan = nr.review_queue(level, nr.encounter_level(level))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_dictionary_groups():
    assert len(CONCEPTS) == 37 and len(concept_groups(CONCEPTS)) == 23
    assert "radiology_edema" not in concept_patterns(CONCEPTS, "all")
    for pattern in concept_patterns(CONCEPTS, "radiology").values():
        re.compile(pattern)


def test_all_literals_are_met_in_one_pass_over_a_note(spark):
    flags = nr.dictionary_flags(notes(spark, ["Keytruda"]), CONCEPTS, "radiology")
    assert flags._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def test_alternatives_are_left_out_only_where_they_cannot_match(spark):
    groups = ["ab|abc x|b.c", "lich.{0,3}keit|MENT[a-z]* LA", "(a)\\1|zz", "v\\.?s\\.?|\\d{3}", "(ed)?ing|x  y", "^abc|\\Qa|b\\E", "irae\\b|zz"]
    concepts = [("all", f"g{i}", "c", pattern) for i, pattern in enumerate(groups)]
    texts = ["xabc x", "b\nc ab", "Lichtkeit", "ment LA", "mental la", "aa", "V.S. 12 345", "x  y", "x y edING", "abc a|b", "İRAE zz", "ırae", "irae zz", "", None]
    df = notes(spark, texts)
    got = {r.NOTE_ID: r for r in nr.dictionary_flags(df, concepts).collect()}
    for i, pattern in enumerate(groups):
        plain = df.select("NOTE_ID", sc.normalize_text(F.col("NOTE_TEXT")).rlike(sc.case_insensitive(pattern)).cast("int").alias("f"), sc.extract_snippet(F.col("NOTE_TEXT"), pattern).alias("s"))
        for r in plain.collect():
            assert (got[r.NOTE_ID][f"any_g{i}"], got[r.NOTE_ID][f"snippet_g{i}"]) == (r.f, r.s), (pattern, r)
    assert sc.alternatives("favou?rs? .* irae|\\d+|v\\.?s") == [("favou?rs? .* irae", ["favo", "irae"]), ("\\d+", []), ("v\\.?s", ["v", "s"])]
    assert all(sc.alternatives(p) is None for p in ("(a)\\1|b", "a||b", "(?i)x", "^ab", "(a|b)c", "\\Qa|b\\E"))


def test_native_literals_equal_those_of_the_one_pass(spark):
    texts = ["Keytruda, possible\npneumonitis", "posſible ırae", "İRAE vs sepsis", "ground -glass ggo", "", None]
    one, native = (nr.dictionary_flags(notes(spark, texts), CONCEPTS, "radiology", native=x) for x in (False, True))
    assert "Python" not in native._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, native.collect())) == sorted(map(str, one.collect()))
