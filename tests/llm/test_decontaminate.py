import hashlib
import random
import re

import numpy as np
import pytest

from kegler.llm import decontaminate as D
from kegler.llm import queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(t):
    return WORD.findall((t or "").translate(LOWER))


def brute(docs, items):
    windows = {}
    for name, t in items:
        w = words(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(name)
    sizes = {len(w) for w in windows}
    out = []
    for i, t in docs:
        w = words(t)
        hit, names = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                got = windows.get(tuple(w[k : k + n]))
                if got:
                    hit |= set(range(k, k + n))
                    names |= got
        names = sorted(str(x) for x in names if x is not None)
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return out


def run(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    return sorted(tuple(r) for r in D.contamination_digest(d, b).collect())


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(5)
    vocab = [f"w{k}" for k in range(12)] + ["über", "Été", "x1"]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 40)))) for k in range(30)]
    items += [(100, "one two three"), (101, None), (102, ""), (103, "solo"), (104, "the the the the the the the the the the the the"), (9, items[9][1])]
    docs = []
    for k in range(120):
        w = [rng.choice(vocab + ["zz", "qq"]) for _ in range(rng.randint(0, 60))]
        if k % 3 == 0:
            src = words(rng.choice(items)[1])
            a = rng.randint(0, len(src))
            w[len(w) // 2 : len(w) // 2] = src[a : a + rng.randint(1, 25)]
        if k % 10 == 0:
            w += ["One,", "TWO", "three"]
        docs.append((k, "\n ".join(x.upper() if rng.random() < 0.2 and x.isascii() else x for x in w)))
    docs += [(500, None), (501, ""), (502, "Solo!"), (503, "the " * 300), (504, "--- \x00 ..."), (1, docs[3][1]), (1, docs[3][1])]
    return docs, items


def test_matches_brute_force(spark, planted):
    docs, items = planted
    assert run(spark, docs, items) == sorted(brute(docs, items))


def test_blocks_give_the_same(spark, planted, monkeypatch):
    docs, items = planted
    monkeypatch.setattr(D, "BLOCK_BYTES", 400)
    assert run(spark, docs, items) == sorted(brute(docs, items))


def test_filter_keeps_columns(spark, planted, monkeypatch):
    docs, items = planted
    clean = sorted(r[0] for r in brute(docs, items) if not r[5])
    d = spark.createDataFrame([(i, t, 1, "n") for i, t in docs], "doc_id long, text string, n_words int, row string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = D.drop_contaminated(d, b)
    assert got.columns == d.columns and sorted(r["doc_id"] for r in got.collect()) == clean
    monkeypatch.setattr(D, "BLOCK_BYTES", 400)
    assert sorted(r["doc_id"] for r in D.drop_contaminated(d, b).collect()) == clean


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a b c")]) == []
    assert [r[1:4] for r in run(spark, [(1, "a b")], [])] == [(2, 0, 0)]


def test_winnowing_guarantee():
    rng = np.random.default_rng(0)
    for _ in range(200):
        shared = rng.integers(1, 50, 10)
        a = D._mixed(np.concatenate([rng.integers(1, 50, 30), shared, rng.integers(1, 50, 7)]))
        b = D._mixed(np.concatenate([rng.integers(1, 50, 4), shared, rng.integers(1, 50, 20)]))
        marks = [set(D.gram_hashes(x, D.K)[D.fingerprints(x)].tolist()) for x in (a, b)]
        assert marks[0] & marks[1]


def test_op9_on_table(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = sorted(tuple(r) for r in queries.op9_decontamination(spark, sf).collect())
    assert got == sorted(brute(docs, items)) and any(r[5] for r in got)
