import re

import pytest

from cohortspark.llm import decontamination as dec

QUESTION = "If John Smith buys 3 apples for 12 dollars, how much does John Smith pay for 3 more apples?"


def squeezed(text):
    return re.sub(r"\s+", " ", text.lower())


def test_query_finds_every_passage(spark, sf_dir, texts):
    found = {(r.doc_id, r.item_id) for r in dec.op6_decontamination(spark, sf_dir).collect()}
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()
    assert found == {(i, r.item_id) for i, t in texts.items() for r in items if squeezed(r.text) in squeezed(t)}


@pytest.mark.parametrize("index_rows", [0, 1_000_000])
def test_changed_questions(spark, index_rows):
    docs = spark.createDataFrame([
        (1, f"Some lead. {QUESTION} And a tail."),
        (2, "So. If Mary Jones buys 7 apples for 40 euros, how much does Mary Jones pay for 7 more apples? Yes."),
        (3, "So. If Mary Jones buys 7 apples for 40 euros, how much does Peter pay for 9 more apples? Yes."),
        (4, "If John Smith buys 3 apples, the day is long and nobody knows how much of it is left."),
        (5, QUESTION.upper()), (6, None), (7, ""), (None, QUESTION), (8, "tiny item here"), (1, f"Some lead. {QUESTION} And a tail."),
    ], "doc_id long, text string")
    items = spark.createDataFrame([(1, QUESTION), (2, None), (3, ""), (4, "tiny item here"), (5, "a b"), (None, QUESTION)], "item_id long, text string")
    found = sorted((r.doc_id, r.item_id, r.exact) for r in dec.find(docs, items, index_rows=index_rows).collect())
    assert found == [(1, 1, True), (1, 1, True), (2, 1, False), (5, 1, True), (8, 4, True)]
    assert sorted(r.doc_id or 0 for r in dec.drop_contaminated(docs, items, index_rows=index_rows).collect()) == [0, 3, 4, 6, 7]


def test_template_tokens():
    tokens = dec.Canon().tokens(b"The price is 3,5 km or 12.5% for Anna Maria Berg. Then THE END")
    kinds = "LNPU-"
    assert "".join(kinds[k] for k in tokens.kind) == "LLLNULNLPLLL"
    same = dec.Canon().tokens("the price is 99 km or 7% for Bob. then the end".encode())
    assert (same.template == tokens.template).all()


def test_odd_rows(spark, odd, none):
    items = spark.createDataFrame([(1, QUESTION)], "item_id long, text string")
    for index_rows in (0, 10):
        assert dec.find(odd, items, index_rows=index_rows).count() == 0
        assert dec.find(none, items, index_rows=index_rows).count() == 0 and dec.find(odd, items.limit(0), index_rows=index_rows).count() == 0
    kept = dec.drop_contaminated(odd, items)
    assert kept.schema == odd.schema and kept.count() == odd.count()


@pytest.mark.parametrize("index_rows", [0, 1_000_000])
def test_items_of_numbers_names_and_few_words_are_found_where_copied(spark, index_rows):
    copied = {
        1: "Solve 3 x 5 + 2 x 4 = ?", 2: "12 45 7 1,000 3.5 90 11 8", 3: "Anna Berg, Carl Stone, Maria Lund, Peter Holm", 4: "Berlin has many lakes",
        5: "Name Three Big Rivers", 6: "5 kg 3 km 2 hours 40 percent 7 days 9 miles", 7: "what is 3 + 4 ?",
    }
    others = {20: "He said solve 3 x 5 - 2 x 4 = ? to them", 21: "then what is 3 - 4 ?", 22: "see 12 45 8 1,000 3.5 91 11 8 there", 23: "Anna Stone, Carl Berg, Maria Holm, Peter Lund"}
    docs = [(i, f"They wrote that {t} and went on with Other things.") for i, t in copied.items()] + list(others.items())
    found = dec.find(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(list(copied.items()), "item_id long, text string"), index_rows=index_rows).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(i, i) for i in copied} and all(r.exact and r.coverage >= 0.8 for r in found)


def test_repeated_benchmark_rows_match_once_on_both_paths(spark):
    docs = spark.createDataFrame([(1, "x y z what is the sum of seven and nine apples in a box today a b c")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "what is the sum of seven and nine apples in a box today")] * 2 + [(2, "what is the sum of seven and nine apples in a box today")], "item_id long, text string")
    for index_rows in (1_000_000, 0):
        found = dec.find(docs, items, index_rows=index_rows).collect()
        assert sorted(r.item_id for r in found) == [1, 2]


def test_quick_classes_equal_the_full_ones():
    runs = "one One ONE, km kg. Paris Paris, NASA a I go! end? x: ten. Ten; hours, e.g. it's (see 3.5 $4 Élan été. ß ONE-two".split()
    canon = dec.Canon()
    for run in (r.encode() for r in runs):
        assert canon[run] == dec.packed(*dec.Canon.classed(run))
