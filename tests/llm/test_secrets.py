import base64
import hashlib
import random
import re

from cohortspark.llm import secrets


def brute(text):
    kinds = ["assign", "access", "hex"]
    found = [("assign", m.start(), m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m.group(2)) >= 6]
    found += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    found += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24]
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(found, key=lambda s: (s[1], kinds.index(s[0]))))


def test_base_equals_brute_force(spark, sf_dir, texts):
    rows = secrets.op10_secrets(spark, sf_dir).collect()
    assert {r.doc_id: r.base_sha256 for r in rows} == {i: hashlib.sha256(brute(t).encode()).hexdigest() for i, t in texts.items()}
    for r in rows:
        base = [s for s in r.spans.split(",") if not s.startswith("random")]
        assert ",".join(x for x in base if x) == brute(texts[r.doc_id])


def test_patterns_at_their_edges():
    for text in ("token=token: abcdef1", "PassWord \"= 'abc.def", "api_key:abcdef apikey=ABC123 token==abcdef", "AKIA" + "A" * 16, "AKIA" + "A" * 15, "ſecret=abcdefg", "a" * 24 + "g" + "0" * 23, "secret=" + "f" * 30):
        assert secrets.listed(secrets.base_spans(text)) == brute(text)


def tokens():
    draw = random.Random(5)
    alphabet = secrets.ENCODINGS[5][1]
    real = ["".join(draw.choices(alphabet, k=40)) for _ in range(60)]
    real += [base64.b64encode(draw.randbytes(36)).decode() for _ in range(60)]
    words = ["Sprint", "Backlog", "review", "Release", "notes", "Team", "build", "2024", "v2", "Node"]
    plain = ["-".join(draw.choices(words, k=6)) + "-X1a" for _ in range(60)] + ["Aa1" * 12 for _ in range(20)] + ["ABCDEFGHIJKLMNOPQRSTUVWXYZabcdef0123456789"] * 20
    return real, plain


def test_battery_tells_random_tokens_from_names(spark):
    real, plain = tokens()
    frame = spark.createDataFrame([(i, f"see {t} here") for i, t in enumerate(real + plain)], "doc_id long, text string")
    found = {r.doc_id: len(r.random) for r in secrets.find(frame).collect()}
    hits = sum(found[i] for i in range(len(real)))
    false = sum(found[i] for i in range(len(real), len(real) + len(plain)))
    assert hits >= 0.85 * len(real) and false <= 0.25 * len(plain)


def test_p_values_are_calibrated():
    draw = random.Random(9)
    ps = [secrets.battery([draw.randrange(62) for _ in range(64)], 62) for _ in range(2000)]
    for column in zip(*ps, strict=True):
        assert 0.01 < sum(p < 0.05 for p in column) / len(ps) < 0.1


def test_odd_secrets(odd, none):
    rows = secrets.find(odd).collect()
    assert len(rows) == odd.count() and all(r.base == "" and not r.random for r in rows if r.doc_id in (2, 3, 4))
    assert secrets.find(none).count() == 0


def test_random_parts_of_paths_and_tokens_without_digits(spark):
    draw = random.Random(17)
    base62, letters = secrets.ENCODINGS[5][1], secrets.ENCODINGS[5][1][10:]
    heads = ["https://host.example/reset-password/", "/api_v1/keys/", "/srv/data+sets/my-own_project/", f"/id/{'0123456789abcdef' * 2}/"]
    parts = ["".join(draw.choices(base62, k=40)) for _ in range(40)]
    texts = [f"see {heads[i % 4]}{t} here" for i, t in enumerate(parts)]
    bare = ["".join(draw.choices(letters, k=20)) for _ in range(20)]
    found = {r.doc_id: r.random for r in secrets.find(spark.createDataFrame(list(enumerate(texts + bare)), "doc_id long, text string")).collect()}
    hits = sum(any(f.start <= texts[i].index(t) and f.end >= texts[i].index(t) + 40 for f in found[i]) for i, t in enumerate(parts))
    assert hits >= 0.85 * len(parts) and sum(len(found[len(texts) + i]) == 1 for i in range(20)) >= 14
    assert all(not (f != g and g.start <= f.start and f.end <= g.end) for r in found.values() for f in r for g in r)
    assert secrets.candidates("https://host.example/some/long/path/without/any/token", []) == []
