"""Connected components of a graph given as an edge table, by alternating large-star and small-star."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kegler.llm.storage import Scratch

#: Edges that a task contracts at once, in memory. A graph that has come down to so many is finished by one task.
CHUNK = 200_000


def _stars(edges: list[tuple[list[int], list[int]]]) -> pa.RecordBatch:
    """The components of some edges as edges (node, least node)."""
    root: dict[int, int] = {}

    def find(x):
        top = x
        while (up := root.setdefault(top, top)) != top:
            top = up
        while root[x] != top:
            root[x], x = top, root[x]
        return top

    for u, v in edges:
        for a, b in zip(u, v, strict=True):
            ra, rb = find(a), find(b)
            if ra != rb:
                root[max(ra, rb)] = min(ra, rb)
    rows = [(x, r) for x in list(root) if (r := find(x)) != x]
    return pa.RecordBatch.from_pydict({"u": pa.array([u for u, _ in rows], pa.int64()), "v": pa.array([v for _, v in rows], pa.int64())})


def contract(edges: DataFrame) -> DataFrame:
    """Edges (u, v) replaced, task by task and chunk by chunk, by stars around the least node: the
    same components with at most one edge per node and chunk."""
    def run(batches):
        held, n = [], 0
        for batch in batches:
            for k in range(0, batch.num_rows, CHUNK):
                part = batch.slice(k, CHUNK)
                if n + part.num_rows > CHUNK:
                    yield _stars(held)
                    held, n = [], 0
                held.append((part.column(0).to_pylist(), part.column(1).to_pylist()))
                n += part.num_rows
        if held:
            yield _stars(held)

    return edges.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u is not null and v is not null").mapInArrow(run, "u long, v long")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
    return moved.unionByName(least.withColumnRenamed("m", "v")).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60, scratch: Scratch | None = None) -> DataFrame:
    """(node, root) of every node with an edge; the root is the least node of its component.

    Nodes are longs; loops, repeated edges and either direction are fine. Rounds are a logarithm of
    the longest path; each is written to the shared folder, so lineage doesn't grow. All steps are
    joins and aggregations with partial minima; a node with very many edges is a skewed key of a join,
    which adaptive execution splits. scratch: gets the written rounds, for a caller that deletes them.
    """
    materialize = Scratch() if scratch is None else scratch
    now = materialize(contract(edges).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc-start")
    state = None
    for k in range(max_rounds):
        if now.count() <= CHUNK:
            # Few enough for one task: its stars are the components.
            now = materialize(contract(now.coalesce(1)), "cc-end")
            break
        now = materialize(_small_star(_large_star(now)), f"cc-{k}")
        row = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if row == state:
            break
        state = row
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
