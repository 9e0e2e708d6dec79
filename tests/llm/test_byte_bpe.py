import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from cohortspark.llm import byte_bpe


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(), special_tokens={})


def encoded(df, **options):
    return [(r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in byte_bpe.encode(df, **options).collect()]


def test_query_equals_the_library(spark, sf_dir, texts, library):
    rows = byte_bpe.op11_byte_bpe(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


@pytest.mark.parametrize("head", [0, 40])
def test_odd_rows_with_and_without_known_words(spark, odd, none, library, head):
    found = sorted(encoded(odd, head=head), key=str)
    expected = sorted([(r.doc_id, library.encode_ordinary(r.text or "")) for r in odd.select("doc_id", "text").collect()], key=str)
    assert found == expected
    back = byte_bpe.decode(byte_bpe.encode(odd, head=head, fold_all=True)).collect()
    assert sorted(bytes(r.decoded).decode() for r in back) == sorted(r.text or "" for r in odd.select("text").collect())
    assert byte_bpe.op11_byte_bpe.__doc__ and encoded(none) == []


def test_signs_blanks_and_long_words(spark, library):
    draw = random.Random(3)
    alphabet = ["a", "b", "é", "ß", "中", "😀", "\U000107bb", "\U00011de0", "7", "٣", "'s", "'", "!", "  ", " ", "\n", "\n\n", "\t", " ", " ", "\x1c", "\x85", "|", ":", "<|endoftext|>"]
    texts = ["".join(draw.choices(alphabet, k=draw.randint(0, 40))) for _ in range(300)]
    texts += [" lead", "trail ", "  two", "a\n b", "x" * 3000, "ab" * 2000, "".join(draw.choices("abcdefghij", k=5000)), "=" * 700, " " * 500, "don't stop  now"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for options in ({"head": 0}, {"head": 30, "long": 8}, {"head": 30, "fold_all": True}):
        assert dict(encoded(frame, **options)) == {i: library.encode_ordinary(t) for i, t in enumerate(texts)}


def test_fold_equals_heap_on_every_length(spark, library):
    draw, ranks = random.Random(5), byte_bpe.load_ranks()
    words = [bytes(draw.choices(b"aeinst \xc3\xa9|:", k=n)) for n in range(byte_bpe.LONG + 1) for _ in range(4)]
    frame = spark.createDataFrame([(w,) for w in words], "word binary").select("word", byte_bpe.folded(F.col("word"), byte_bpe.rank_map(ranks)).alias("ids"))
    assert all(list(r.ids) == (byte_bpe.merge_long(bytes(r.word), ranks) if r.word else []) for r in frame.collect())


def test_many_words_at_once_equal_heap():
    draw, ranks = random.Random(6), byte_bpe.load_ranks()
    words = [bytes(draw.choices(b"aeinst \xc3\xa9|:", k=draw.randint(0, byte_bpe.LONG))) for _ in range(3000)] + [b"", b"a", b" the", b"zq"]
    found = byte_bpe.Ranks(ranks).merge_many(words)
    assert [np.frombuffer(x, "<u4").tolist() for x in found] == [byte_bpe.merge_long(w, ranks) if w else [] for w in words]


def test_ids_as_array(spark):
    frame = spark.createDataFrame([(np.array([1, 50000, 70000], "<u4").tobytes(),), (b"",), (None,)], "ids binary")
    assert [r[0] for r in frame.select(byte_bpe.as_array(F.col("ids"))).collect()] == [[1, 50000, 70000], [], None]


def test_query_has_one_python_worker_a_task(spark, sf_dir):
    plan = byte_bpe.op11_byte_bpe(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_decode_in_slices_keeps_null_and_empty(spark, monkeypatch):
    monkeypatch.setattr("cohortspark.llm.common.SLICE_BYTES", 64)
    ids = [np.array([i % 256] * 40, "<u4").tobytes() for i in range(20)] + [b"", None]
    pieces = {rank: piece for piece, rank in byte_bpe.load_ranks().items()}
    found = byte_bpe.decode(spark.createDataFrame(list(enumerate(ids)), "doc_id long, ids binary").coalesce(1)).orderBy("doc_id").collect()
    assert [r.decoded and bytes(r.decoded) for r in found[:20]] == [pieces[i % 256] * 40 for i in range(20)]
    assert (bytes(found[20].decoded), found[21].decoded) == (b"", None)
