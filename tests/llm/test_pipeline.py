import re
from collections import defaultdict

import corpus_pipeline
from cohortspark.llm import language, simhash
from tests.llm.test_lines_and_windows import brute_lines
from tests.llm.test_near_copies import brute_kept
from tests.llm.test_packing import checked


def test_stages_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash_dedup", "benchmark_decontamination", "best_fit_packing"]


def test_every_stage_against_plain_python(spark, sf_dir, docs):
    """Each stage on its own input; the language model is the same, the rest is brute force."""
    current, columns = docs, docs.columns
    for name, stage in corpus_pipeline.STAGES:
        result = stage(spark, current, sf_dir).cache()
        before = {r.doc_id: r for r in current.collect()}
        rows = result.collect()
        if name != "best_fit_packing":
            assert result.columns == columns and len({r.doc_id for r in rows}) == len(rows)
        if name == "language_id":
            model = language.fit(language.training_rows(current, "doc_id", "text", "lang"))
            kept = {i for i, r in before.items() if model.mixture((r.text or "").encode())[0] != "und"}
            assert {r.doc_id for r in rows} == kept and len(kept) >= 0.95 * len(before)
        elif name == "line_dedup":
            expected = brute_lines([(i, r.text) for i, r in before.items()], 40, 5)
            assert {r.doc_id: r.text for r in rows} == {i: "\n".join(x) for i, x in expected.items()}
            assert all(r.n_chars == len(r.text) for r in rows)
        elif name == "simhash_dedup":
            assert {r.doc_id for r in rows} == brute_kept({i: r.text for i, r in before.items()}) and all(r.text == before[r.doc_id].text for r in rows)
        elif name == "benchmark_decontamination":
            items = [re.sub(r"\s+", " ", r.text.lower()) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
            clean = {i for i, r in before.items() if not any(x in re.sub(r"\s+", " ", r.text.lower()) for x in items)}
            assert {r.doc_id for r in rows} == clean
        else:
            texts = defaultdict(str, {i: r.text for i, r in before.items()})
            assert checked(rows, texts) <= -(-sum(r.length for r in rows) // 2048) + 1
        current = result


def test_pipeline_on_odd_rows(spark, odd, none):
    for frame in (odd, none):
        current = frame
        for _, stage in corpus_pipeline.STAGES:
            current = stage(spark, current, "/root/testdata/sf0.001")
        assert {"doc_id", "sequence_id", "offset"} <= set(current.columns) and (current.count() > 0) == (frame is odd)
    assert simhash.SEED == 42
