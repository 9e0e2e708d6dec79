import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortspark.llm import language, toxicity


def test_language_on_held_out_documents(spark, sf_dir, docs):
    labels = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    found = language.op7_language(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in found) == sorted(labels)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in found)
    held = [r for r in found if r.held_out]
    assert sum(r.lang_pred == labels[r.doc_id] for r in held) >= 0.97 * len(held)


def test_mixture_proportions(spark, docs):
    model = language.fit(language.training_rows(docs, "doc_id", "text", "lang"))
    texts = {lang: docs.where(f"lang = '{lang}' and n_chars > 1500 and crc32(cast(cast(doc_id as string) as binary)) % 5 = 0").first().text[:900] for lang in ("en", "de")}
    main, score, shares = model.mixture((texts["en"][:600] + " " + texts["de"][:300]).encode())
    assert main == "en" and set(shares) == {"en", "de"} and shares["en"] == pytest.approx(2 / 3, abs=0.1) and score == pytest.approx(shares["en"])
    assert set(model.mixture(texts["de"].encode())[2]) == {"de"}


def test_em_recovers_shares():
    draw = np.random.default_rng(1)
    chances = draw.dirichlet(np.ones(500) * 0.1, 3).T + 1e-9
    counts = draw.multinomial(20_000, chances @ np.array([0.6, 0.0, 0.4])).astype(float)
    seen = counts > 0
    assert language.em(chances[seen], counts[seen], np.full(3, 1 / 3), rounds=200) == pytest.approx([0.6, 0.0, 0.4], abs=0.03)


def test_odd_languages(odd, none):
    model = language.fit(language.training_rows(odd, "doc_id", "text", "lang"))
    found = {r.doc_id: r for r in language.predict(odd, model).where("doc_id is not null").collect()}
    assert all(found[i].lang_pred == "und" and found[i].score == 0 for i in (2, 3, 4, 7)) and found[1].lang_pred in ("en", "fr")
    assert language.predict(odd, model).count() == odd.count()
    kept = language.keep_known(odd)
    assert kept.schema == odd.schema and {2, 3, 4, 7}.isdisjoint(r.doc_id for r in kept.collect())
    empty = language.fit(language.training_rows(none, "doc_id", "text", "lang"))
    assert empty.languages == [] and language.predict(none, empty).count() == 0 and language.predict(odd, empty).first().lang_pred == "und"


@pytest.mark.parametrize("word, folded", [("Idiot!", "idiot"), ("1d10t", "idiot"), ("$cum", "scum"), ("іdіоt", "idiot"), ("ｔｒａｓｈ", "trash"), ("st​upid,", "stupid"), ("the&&&", "the"), ("2024", "2024"), ("naïve", "naive"), ("!!", "")])
def test_folding(word, folded):
    assert toxicity.fold(word) == folded


def test_exceptions_and_length():
    lexicon = toxicity.Lexicon({" trash ": 3.0, " idi": 2.0}, [" trash can "], -3.0, 10.0)
    made, folded = lexicon.automaton(), toxicity.Folded()
    hits = [len(lexicon.hits(made, folded.text(t)[0])) for t in (b"the trash can is full", b"you TR4SH", b"idiocy and 1di0ts", b"")]
    assert hits == [0, 1, 2, 0] and lexicon.score(0.0) < 0.3 < lexicon.score(1.0)


def test_toxicity_on_held_out_documents(spark, sf_dir):
    found = toxicity.op2_toxicity(spark, "/root/testdata/sf0.01")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    rows = found.collect()
    assert len(rows) == 1000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    hits = sum(a and b for a, b in held)
    assert hits >= 0.9 * sum(a for a, _ in held) and hits >= 0.8 * sum(b for _, b in held)


def test_odd_toxicity(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (5, 1), (6, 0), (8, None), (None, 1), (1, 1)], "doc_id long, toxic int")
    lexicon = toxicity.fit(odd, labels)
    rows = toxicity.score(odd, lexicon).collect()
    assert len(rows) == odd.count() and len({r.score for r in rows if r.doc_id in (2, 3, 4)}) == 1
    nothing = toxicity.fit(odd, labels.limit(0))
    assert nothing.weights == {} and toxicity.score(none, nothing).count() == 0


def test_mixtures_stay_and_without_labels_all_lettered_texts_stay(spark, docs):
    by_language = {r.lang: r.text for r in docs.where("lang is not null and length(text) > 300").groupBy("lang").agg(F.first("text").alias("text")).collect()}
    mixed = "\n".join(text[:300] for text in by_language.values())
    assert len(by_language) >= 4
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    new = spark.createDataFrame([(10**9, mixed, None, "s", 1), (10**9 + 1, "1234 !!", None, "s", 1), (10**9 + 2, None, None, None, None)], columns)
    kept = language.keep_known(docs.unionByName(new)).where(F.col("doc_id") >= 10**9).collect()
    assert [r.doc_id for r in kept] == [10**9]
    unlabelled = spark.createDataFrame([(1, "some words", None, "s", 1), (2, "...", None, "s", 1), (3, "", None, "s", 1)], columns)
    assert [r.doc_id for r in language.keep_known(unlabelled).collect()] == [1]
