import random

import pytest

CLASH = ["fp", "row", "h1", "bucket", "tk", "score", "component_id", "piece", "rank", "pos", "y", "h", "item_id", "anchor", "next_text", "found"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASH)


def odd_rows():
    """Nulls in every column, empty and very long texts, repeated rows, signs of all kinds."""
    draw = random.Random(7)
    words = ["".join(draw.choices("abcdefgh", k=draw.randint(2, 7))) for _ in range(5000)]
    base = " ".join(draw.choices(words, k=120))
    texts = {
        1: base, 2: None, 3: "", 4: " \t\n\x0b\x0c\r ", 5: base, 6: " ".join(draw.choices(words, k=120_000)), 7: "12 345 !!! ...",
        8: "İstanbul Σς ﬃ naïve é  x 😀 ſtraße <|endoftext|> don't", 9: base.upper(), 10: base + " tail", 11: "one", 12: "Line one.\n\nLine two.\r\nLine two.",
    }
    rows = [(i, t, "en" if i % 2 else "fr", "s", len(t) if t is not None else None) for i, t in texts.items()]
    rows += [(None, base, "en", None, 3), (None, None, None, None, None), (5, base, "en", "s", len(base)), (20, "ça va " * 30, None, "s", 1)]
    return [(*r, *["x"] * len(CLASH)) for r in rows]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
