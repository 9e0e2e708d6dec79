import random

import xxhash
from pyspark.sql import functions as F

from cohortspark.llm import common, simhash


def brute_fingerprint(text):
    words = text.encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    ids = sorted(prints)
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    return {i: root(i) for i in ids}


def test_query_equals_brute_force(spark, sf_dir, texts):
    prints = {i: brute_fingerprint(t) for i, t in texts.items()}
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op1_simhash(spark, sf_dir).collect()}
    groups = brute_components(prints)
    assert found == {i: (f"{prints[i]:016x}", groups[i]) for i in prints}


def test_links_equal_brute_force_with_dense_buckets(spark):
    draw = random.Random(3)
    prints = []
    for _ in range(12):
        center = draw.getrandbits(64)
        prints += [center ^ sum(1 << b for b in draw.sample(range(64), draw.randint(0, 4))) for _ in range(60)]
    prints += [draw.getrandbits(64) for _ in range(200)]
    prints = sorted(set(prints))
    frame = spark.createDataFrame([(simhash.signed(p),) for p in prints], "fp long")
    for distance in (0, 1, 2):
        found = common.components(simhash.links(frame, distance, bucket=8))
        got = {r.node: r.component for r in found.collect()}
        parent = {p: p for p in prints}

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for i, a in enumerate(prints):
            for b in prints[i + 1 :]:
                if (a ^ b).bit_count() <= distance:
                    parent[root(a)] = root(b)
        brute, spark_groups = {}, {}
        for p in prints:
            brute.setdefault(root(p), set()).add(p)
            key = simhash.signed(p)
            spark_groups.setdefault(got.get(key, key), set()).add(p)
        assert sorted(map(sorted, brute.values())) == sorted(map(sorted, spark_groups.values()))


def test_every_chain_start_covers_the_ring():
    for distance in (0, 1, 2):
        for chain in simhash.chains(distance):
            assert chain[-1] == ((1 << 64) - 1, distance) and chain[0][1] == 0


def test_components_of_a_long_chain_and_a_star(spark):
    pairs = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(1000, 1200)] + [(5, 5)]
    found = common.components(spark.createDataFrame(pairs, "a long, b long"))
    got = {r.node: r.component for r in found.collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 7 for i in range(1000, 1200)}, 7: 7}
    assert found.count() == len(got)


def test_odd_rows(odd, none):
    found = simhash.near_duplicates(odd)
    rows = {(r.doc_id, r.component_id) for r in found.collect()}
    assert found.count() == 14 and {(2, 2), (3, 2), (4, 2), (1, 1), (5, 1), (9, 1)} <= rows
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and {5, 9, 3}.isdisjoint(r.doc_id for r in kept.collect())
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_one(none).count() == 0


def test_repeated_rows_leave_one(spark):
    frame = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (2, "a b c d e")], "doc_id long, text string")
    assert [r.doc_id for r in simhash.keep_one(frame).collect()] == [1]


def test_no_text_leaves_its_task(docs):
    plan = simhash.fingerprints(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and F.lit(1) is not None
