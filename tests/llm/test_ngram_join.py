import itertools
import random
import re

import numpy as np
import pytest

from kegler.llm import components, ngram_join, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(t):
    w = WORD.findall((t or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset([tuple(w)] if len(w) < 5 else [tuple(w[k : k + 5]) for k in range(len(w) - 4)])


def brute(docs):
    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    owners = {}
    for k, s in enumerate(sets):
        for x in s:
            owners.setdefault(x, []).append(k)
    pairs = {(a, b) for o in owners.values() for i, a in enumerate(o) for b in o[i + 1 :]}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(docs):
        least[find(k)] = min(i, least.get(find(k), i))
    return sorted((i, len(sets[k]), least[find(k)]) for k, (i, _) in enumerate(docs))


def planted(seed=7):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(400)]
    passage = [rng.choice(vocab) for _ in range(60)]
    docs = []

    def add(w):
        docs.append((len(docs) * 3 + 1, " ".join(w)))

    for n in (3, 4, 5, 6, 9, 20, 63, 66, 70, 130, 200, 500):
        base = [rng.choice(vocab) for _ in range(n)]
        add(base)
        for _ in range(6):
            w = list(base)
            for _ in range(rng.randint(1, max(1, n // 30))):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            if rng.random() < 0.4:
                w = w[: max(1, int(len(w) * rng.uniform(0.74, 1)))]
            add(w)
        add(base)
    for _ in range(60):  # a passage that many share
        w = [rng.choice(vocab) for _ in range(rng.randint(5, 60))]
        add(w[: len(w) // 2] + passage + w[len(w) // 2 :])
    for k in range(0, 160, 8):  # a chain
        add([f"c{j}" for j in range(k, k + 100)])
    docs += [(9000, None), (9001, ""), (9002, " \n"), (9003, "Solo"), (9004, "SOLO"), (9005, "Ä b c d e"), (9006, "ä b c d e"), (9007, "a " * 3000), (9008, "a " * 2000), (1, docs[0][1])]
    return docs


def run(spark, docs):
    rows = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, n int, class int")
    return sorted(tuple(r) for r in ngram_join.ngram_components(rows).collect())


def test_matches_brute_force(spark):
    docs = planted()
    assert run(spark, docs) == brute(docs)


def test_blocks_and_common_shingles_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", 300)
    monkeypatch.setattr(ngram_join, "BLOCK_MEMBERS", 3)
    monkeypatch.setattr(ngram_join, "SMALL_GROUP", 2)
    monkeypatch.setattr(ngram_join, "TEXT_BYTES", 300)
    docs = planted(8)
    assert run(spark, docs) == brute(docs)
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    kept = sorted(r["doc_id"] for r in ngram_join.keep_one(rows).collect())
    assert kept == sorted(i for i, _, c in brute(docs) if i == c)


def test_parts_are_a_pigeonhole():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 7, 20, 63, 64, 90, 96, 127, 128, 300, 1000):
        for _ in range(12):
            a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            m = len(a)
            drop = int(rng.integers(0, m // 7 + 1))
            b = np.unique(np.concatenate([a[drop:], rng.integers(0, 1 << 63, int(rng.integers(0, m // 7 + 1))).astype(np.uint64)]))
            both = len(np.intersect1d(a, b))
            if 100 * both < 75 * (len(a) + len(b) - both):
                continue
            common = rng.integers(0, 256, ngram_join.BUCKETS // 8).astype(np.uint8)
            ka, kb = (set(np.concatenate(ngram_join.part_keys(x, common)).tolist()) for x in (a, b))
            assert ka & kb, n


def test_shared_parts_across_batches(spark):
    rng = random.Random(9)
    rows = [(c, [rng.randint(0, 150) for _ in range(3)]) for c in range(100)] + [(7, [1, 1, 2])] * 3
    rows += [(c, [-5, 999]) for c in range(200, 260)]
    groups = {}
    for c, keys in rows:
        for k in keys:
            groups.setdefault(k, set()).add(c)
    small = {tuple(sorted(p)) for own in groups.values() if 1 < len(own) <= ngram_join.SMALL_GROUP for p in itertools.combinations(own, 2)}
    large = sorted((k, c) for k, own in groups.items() if len(own) > ngram_join.SMALL_GROUP for c in own)
    for size in ("1", "2", "7", "30", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        got = ngram_join.shared_parts(spark.createDataFrame(rows, "class long, keys array<long>")).collect()
        assert {tuple(sorted((r["u"], r["v"]))) for r in got if r["key"] is None} == small
        assert sorted((r["key"], r["u"]) for r in got if r["key"] is not None) == large and len(large) == 120
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(4)
    for n in (1, 30, 1000, 1100, 5000):
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[n // 9 :], rng.integers(0, 1 << 63, n // 12).astype(np.uint64)]))
        c = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        sketch = [ngram_join.dense_sketch(x).view(np.uint64)[None, :] for x in (a, b, c)]
        w = min(x.shape[1] for x in sketch)
        sa, sb, sc = (ngram_join.folded(x, w) for x in sketch)
        assert np.bitwise_count(sa ^ sb).sum() <= len(np.setxor1d(a, b))
        assert n < 30 or np.bitwise_count(sa ^ sc).sum() > (len(a) + len(c)) // 7


@pytest.mark.parametrize("chunk", [10, 200_000])
def test_components(spark, monkeypatch, chunk):
    monkeypatch.setattr(components, "CHUNK", chunk)
    rng = random.Random(3)
    edges = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(180)] + [(k, k + 1) for k in range(1000, 1300)] + [(5, 5)]
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in root}


def test_empty(spark):
    assert run(spark, []) == []
    assert run(spark, [(4, "a b c d e f")]) == [(4, 2, 4)]


def test_op8_on_table(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted(tuple(r) for r in queries.op8_ngram_jaccard(spark, sf).collect())
    assert got == brute(docs)


def test_null_and_repeated_keys(spark):
    word = lambda a, b: " ".join(f"w{k}" for k in range(a, b))
    # A null key bridges two documents that aren't alike; it is the only one of its class.
    docs = [(1, word(0, 100)), (None, word(10, 110)), (2, word(20, 120)), (None, word(500, 530)), (None, word(502, 532))]
    # One key with two texts, each alike with another document.
    docs += [(7, word(1000, 1100)), (7, word(2000, 2100)), (6, word(1005, 1105)), (8, word(2005, 2105)), (7, word(2000, 2100))]
    for own in (docs, docs[::-1], docs[5:] + docs[:5]):
        rows = spark.createDataFrame(own, "doc_id long, text string").repartition(3)
        got = sorted(((r["doc_id"] or -1, r["n_shingles"], r["component_id"] or -1) for r in ngram_join.ngram_components(rows).collect()))
        assert got == sorted([(1, 96, 1), (-1, 96, 1), (2, 96, 1), (-1, 26, -1), (-1, 26, -1), (7, 96, 6), (6, 96, 6), (7, 96, 7), (7, 96, 7), (8, 96, 7)])
