import random
import zlib
from collections import Counter

import numpy as np
from tokenizers import Tokenizer

from cohortspark.llm import packing


def checked(rows, texts_of_ids, capacity=2048):
    """All pieces in order, each id once, no gap and no overlap; the number of sequences."""
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    by_doc = {}
    for r in sorted(rows, key=lambda r: r.piece):
        by_doc.setdefault(r.doc_id, []).append(r)
    for i, text in texts_of_ids.items():
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for k, r in enumerate(by_doc[i]):
            assert (r.piece, r.start) == (k, at) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
            assert r.length == capacity or k == len(by_doc[i]) - 1
        assert at == len(ids)
    sequences = {}
    for r in sorted(rows, key=lambda r: r.offset):
        assert sequences.get(r.sequence_id, 0) == r.offset
        sequences[r.sequence_id] = r.offset + r.length
    assert max(sequences.values(), default=0) <= capacity
    return len(sequences)


def test_query_packs_everything(spark, sf_dir, texts, monkeypatch):
    monkeypatch.setattr(packing, "RANK_ROWS", 50)
    rows = packing.op5_packing(spark, sf_dir).collect()
    assert checked(rows, texts) <= -(-sum(r.length for r in rows) // 2048) + 1


def test_ids_equal_the_tokenizer():
    tokens = packing.Tokens(packing.tokenizer_path())
    for text in ("Don't stop -- it's 3.5% of 1,000!", "ÉCOLE Öl ŒUVRE ŉ İstanbul ΣΊΣΥΦΟΣ ﬃ", "é ​ zero width\x1cseparators\x85", "<|endoftext|> x<|startoftext|>y <|", "日本語 😀👍🏽 а̀", "", " \n ", "²½ ³x1２"):
        expected = tokens.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(tokens.ids(text.encode()), "<u4").tolist() == expected, text


def test_plans_hold_the_histogram():
    draw = random.Random(2)
    for counts in ({}, {2048: 3}, {1: 5000}, {1025: 7, 1023: 7}, {700: 10, 600: 11, 1400: 3}, Counter(min(2048, int(draw.lognormvariate(6, 1)) + 1) for _ in range(30_000))):
        groups = packing.plan(dict(counts))
        got = Counter()
        for g in groups:
            assert g.room == 2048 - sum(g.content) >= 0 and g.count > 0
            for length in g.content:
                got[length] += g.count
        assert got == Counter(counts)
        bound = -(-sum(k * v for k, v in counts.items()) // 2048)
        large = sum(v for k, v in counts.items() if 2 * k > 2048)
        assert sum(g.count for g in groups) <= 1.01 * max(bound, large) + 2
    groups = packing.plan(dict.fromkeys(range(1, 2048), 400))
    assert sum(g.count for g in groups) <= 1.002 * 400 * sum(range(1, 2048)) / 2048 + 2


def test_knapsack_is_optimal():
    sizes, values, copies = np.array([7, 5, 3]), np.array([9.0, 6.0, 3.4]), np.array([2, 3, 4])
    amounts = packing.knapsack(sizes, values, copies, 23)
    best = max(a * 9 + b * 6 + c * 3.4 for a in range(3) for b in range(4) for c in range(5) if 7 * a + 5 * b + 3 * c <= 23)
    assert amounts @ values == best and amounts @ sizes <= 23 and (amounts <= copies).all()


def test_odd_packing(odd, none):
    rows = packing.pack(odd).collect()
    assert packing.pack(none).count() == 0
    sequences = Counter()
    for r in rows:
        sequences[r.sequence_id] += r.length
    assert max(sequences.values()) <= 2048 and len([r for r in rows if r.doc_id is None]) == 2
    assert sum(r.doc_id == 5 for r in rows) == 2 * sum(r.doc_id == 1 for r in rows)
