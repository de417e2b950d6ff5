"""Uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

Row p, column s of the matrix says how many rows of partition p go to shard s. Its row sums are the
partition sizes and its column sums the shard sizes; it is drawn row by row from the multivariate
hypergeometric distribution, as a uniformly random permutation of all rows would deal them. Then
each partition permutes its own rows and cuts them by its row of the matrix, the rows are
exchanged, and each shard permutes what it got. Everything is built-in DataFrame functions.
"""

from __future__ import annotations

import json
import math
import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kegler.llm.storage import discard, materialize

#: Partitions of the matrix at most: physical partitions beyond share a row of it. 4096 x 16 counts are 0.5 MB.
MAX_PARTITIONS = 4096
#: Rows that a task numbers at once in a shard, on average.
ROWS_PER_CELL = 1_000_000


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` rows, taken from good + bad without replacement, are good.

    Inversion outwards from the mode: steps are of the order of the standard deviation, and there
    is no limit to the size of the population.
    """
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    lg = math.lgamma
    choose = lambda n, k: lg(n + 1) - lg(k + 1) - lg(n - k + 1)
    p = math.exp(choose(good, mode) + choose(bad, draws - mode) - choose(good + bad, draws))
    u = rng.random()
    up = down = mode
    p_up = p_down = p
    u -= p
    while u > 0 and (up < high or down > low):
        if up < high:
            p_up *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            u -= p_up
            if u <= 0:
                return up
        if down > low:
            p_down *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            u -= p_down
            if u <= 0:
                return down
    return mode


def shard_sizes(n_rows: int, n_shards: int) -> list[int]:
    return [n_rows // n_shards + (s < n_rows % n_shards) for s in range(n_shards)]


def communication_matrix(counts: list[int], sizes: list[int], seed: int) -> list[list[int]]:
    """Rows that go from each partition (counts) to each shard (sizes); both sums are exact."""
    if sum(counts) != sum(sizes):
        raise ValueError("counts and sizes must have the same sum")
    rng, left, matrix = random.Random(seed), list(sizes), []
    for n in counts:
        row, pool = [], sum(left)
        for s, size in enumerate(left):
            got = hypergeometric(rng, size, pool - size, n)
            row.append(got)
            pool, n = pool - size, n - got
            left[s] -= got
        matrix.append(row)
    return matrix


def uniform_shards(rows: DataFrame, n_shards: int = 16, seed: int = 0) -> DataFrame:
    """Add ``shard`` (0 to n_shards - 1) and ``slot`` (gapless from 0 in its shard) to every row.

    Shard sizes differ by one at most. Rows are told apart by their place in the input, which is
    written down first, so that nulls, ties and rows repeated any number of times are just rows, and
    so that a task that runs again finds the same places. The result is fixed by the seed and the
    input's partitions. An empty table stays empty; columns named ``shard`` or ``slot`` are replaced.
    Pass narrow rows: they cross the network twice.
    """
    spark = rows.sparkSession
    names = [c for c in rows.columns if c not in ("shard", "slot")]
    placed = rows.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.monotonically_increasing_id().alias("rid"))
    placed = materialize(placed.withColumn("part", F.pmod(F.shiftright("rid", 33), F.lit(MAX_PARTITIONS)).cast("int")), "shard-rows")
    counts = {r["part"]: r["n"] for r in placed.groupBy("part").agg(F.count("*").alias("n")).collect()}
    parts = sorted(counts)
    total = sum(counts.values())
    matrix = communication_matrix([counts[p] for p in parts], shard_sizes(total, n_shards), seed)
    cuts = _cuts(spark, parts, matrix)
    first = W.partitionBy("part").orderBy(F.xxhash64(F.lit(seed), F.lit(1), "rid"), "rid")
    dealt = placed.withColumn("k", F.row_number().over(first)).join(F.broadcast(cuts), "part")
    dealt = dealt.withColumn("shard", F.aggregate("upto", F.lit(0), lambda n, c: n + (c < F.col("k")).cast("int")))
    # The second permutation is by a random number whose upper bits choose a cell of the shard.
    n_cells = max(4, -(-total // (n_shards * ROWS_PER_CELL)))
    mixed = dealt.select("row", "rid", "shard", F.xxhash64(F.lit(seed), F.lit(2), "rid").alias("r")).withColumn("cell", F.pmod(F.shiftrightunsigned("r", 20), F.lit(n_cells)).cast("int"))
    mixed = materialize(mixed, "shard-dealt")
    discard(placed)
    sums = mixed.groupBy("shard", "cell").agg(F.count("*").alias("n"))
    before = sums.select("shard", "cell", F.coalesce(F.sum("n").over(W.partitionBy("shard").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    second = W.partitionBy("shard", "cell").orderBy("r", "rid")
    numbered = mixed.withColumn("k", F.row_number().over(second)).join(before, ["shard", "cell"])
    return numbered.select("row.*", "shard", (F.col("before") + F.col("k") - 1).cast("long").alias("slot"))


def _cuts(spark: SparkSession, parts: list[int], matrix: list[list[int]]) -> DataFrame:
    """part, upto: how many rows of the partition go to this shard or an earlier one."""
    table = [{"part": p, "upto": [sum(row[: s + 1]) for s in range(len(row))]} for p, row in zip(parts, matrix, strict=True)]
    rows = F.from_json(F.lit(json.dumps(table)), "array<struct<part:int,upto:array<bigint>>>")
    return spark.range(1).select(F.inline(rows))


def text_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def shard_documents(docs: DataFrame, n_shards: int = 16, seed: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Shard assignment of every document: key, size, text_crc32, law (``rows``), shard, slot, grown_shard.

    Only the key, the size and the checksum of a text are moved; texts can then be joined to their
    shard by the key or written in slot order.
    """
    narrow = docs.select(F.col(key), text_size(F.col(text)).alias("size"), F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"))
    out = uniform_shards(narrow, n_shards, seed)
    return out.select(F.col(key), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
