import random
import zlib
from collections import Counter, defaultdict

from kegler.llm import queries, sharding


def test_matrix_sums_are_exact():
    counts, sizes = [0, 7, 1000, 13, 5], sharding.shard_sizes(1025, 16)
    m = sharding.communication_matrix(counts, sizes, 4)
    assert [sum(r) for r in m] == counts and [sum(c) for c in zip(*m)] == sizes
    assert m == sharding.communication_matrix(counts, sizes, 4) != sharding.communication_matrix(counts, sizes, 5)


def test_hypergeometric_moments():
    rng = random.Random(1)
    draws = [sharding.hypergeometric(rng, 30, 70, 20) for _ in range(4000)]
    mean = sum(draws) / 4000
    var = sum((x - mean) ** 2 for x in draws) / 4000
    assert abs(mean - 6) < 0.15 and abs(var - 20 * 0.3 * 0.7 * 80 / 99) < 0.3
    big = sharding.hypergeometric(rng, 10**11, 10**12, 10**6)
    assert abs(big - 10**6 / 11) < 6 * (10**6 * 10 / 121) ** 0.5
    assert sharding.hypergeometric(rng, 0, 5, 3) == 0 and sharding.hypergeometric(rng, 5, 0, 3) == 3


def test_op7_on_table(spark, sf):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op7_uniform_shards(spark, sf).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    for r in got:
        t = docs[r["doc_id"]].encode()
        assert r["size"] == len(t) + 1 and r["text_crc32"] == zlib.crc32(t) and r["law"] == "rows" and r["grown_shard"] is None
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert sorted(slots) == list(range(16))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_shards_are_uniform_and_repeatable(spark):
    rows = spark.range(0, 4000, 1, 5).withColumnRenamed("id", "doc_id")
    a = sharding.uniform_shards(rows, 4, seed=1).collect()
    b = sharding.uniform_shards(rows, 4, seed=1).collect()
    assert sorted(a) == sorted(b)
    for s in range(4):
        own = [r["doc_id"] for r in a if r["shard"] == s]
        assert abs(sum(own) / len(own) - 2000) < 200
        fifths = Counter(i // 800 for i in own)
        assert all(140 < n < 260 for n in fifths.values())
    front = [r["doc_id"] for r in a if r["slot"] < 100]
    assert abs(sum(front) / len(front) - 2000) < 250


def test_nulls_ties_and_empty(spark):
    rows = spark.createDataFrame([(None, None, 1)] * 50 + [(1, "a", 2)] * 20 + [(2, "", 3)], "doc_id long, text string, shard int")
    got = sharding.shard_documents(rows).collect()
    assert len(got) == 71 and sum(r["doc_id"] is None for r in got) == 50
    sizes = Counter(r["shard"] for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    assert sharding.shard_documents(rows.where("false")).collect() == []
    one = sharding.shard_documents(rows.limit(1)).collect()
    assert [(r["shard"], r["slot"]) for r in one] == [(0, 0)]
