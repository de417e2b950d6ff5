"""Benchmark decontamination by winnowing.

A window is 10 consecutive words of a benchmark item (an item of fewer words is one window). Of the
k-grams of every run of ``WINDOW - K + 1`` consecutive ones, the one with the least hash is a
fingerprint, in items and in documents alike, so two texts that share 10 words in a row share the
fingerprint inside them. Document fingerprints that also occur in the benchmark are extended: the
windows around them are looked up among the item windows and compared word by word. Items of fewer
than 10 words are too short for that guarantee; their windows, one per item, are looked up at every
place.

The benchmark is indexed in blocks of at most ``BLOCK_BYTES`` of text, each of which is broadcast;
documents are scanned once per block and never shuffled. Words that no item has, which end every
run, are told by one dictionary look-up per word.
"""

from __future__ import annotations

import hashlib
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW, K = 10, 5
BLOCK_BYTES = 16 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)

#: Lower-cases A-Z and turns what isn't part of a word into blanks.
WORD_TABLE = bytes(
    c + 32 if 0x41 <= c <= 0x5A else 32 if c <= 0x2F or 0x3A <= c <= 0x60 or 0x7B <= c <= 0x7F else c for c in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_TABLE).split()


def _mixed(ids: np.ndarray) -> np.ndarray:
    x = ids.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def gram_hashes(mixed: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k consecutive values."""
    n = len(mixed) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = mixed[:n].copy()
    for j in range(1, k):
        out *= _BASE
        out += mixed[j : j + n]
    return out ^ (out >> np.uint64(32))


def fingerprints(mixed: np.ndarray) -> np.ndarray:
    """Places of the k-grams that winnowing keeps: the last least hash of each run of k-grams."""
    hashes = gram_hashes(mixed, K)
    run = WINDOW - K + 1
    if len(hashes) < run:
        return np.empty(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(hashes, run)
    least = run - 1 - np.argmin(views[:, ::-1], axis=1)
    return np.unique(least + np.arange(len(views)))


class Windows:
    """The distinct windows of one length, by hash, with the items that have them."""

    def __init__(self, length: int, starts: np.ndarray, owners: np.ndarray, ids: np.ndarray, mixed: np.ndarray):
        self.length = length
        grams = gram_hashes(mixed, length)[starts]
        order = np.lexsort((owners, grams))
        grams, starts, owners = grams[order], starts[order], owners[order]
        texts = ids[starts[:, None] + np.arange(length)]
        same_hash = grams[1:] == grams[:-1]
        if (same_hash & (texts[1:] != texts[:-1]).any(axis=1)).any():
            # Different windows with the same hash stand one after the other, by their words.
            order = np.lexsort((owners, *texts.T[::-1], grams))
            grams, texts, owners = grams[order], texts[order], owners[order]
        new = np.ones(len(grams), bool)
        new[1:] = (grams[1:] != grams[:-1]) | (texts[1:] != texts[:-1]).any(axis=1)
        first = np.flatnonzero(new)
        self.hashes, self.texts = grams[first], texts[first]
        self.edges, self.owners = np.append(first, len(grams)), owners

    def find(self, ids: np.ndarray, mixed: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places among ``at`` where a window stands, number of that window)."""
        at = at[at + self.length <= len(ids)]
        if not len(at) or not len(self.hashes):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        own = mixed[at].copy()
        for j in range(1, self.length):
            own *= _BASE
            own += mixed[at + j]
        own ^= own >> np.uint64(32)
        which = np.minimum(np.searchsorted(self.hashes, own), len(self.hashes) - 1)
        found = []
        while len(at):
            hashed = self.hashes[which] == own
            at, which, own = at[hashed], which[hashed], own[hashed]
            same = (ids[at[:, None] + np.arange(self.length)] == self.texts[which]).all(axis=1)
            found.append((at[same], which[same]))
            # Another window may have the same hash.
            again = ~same & (which + 1 < len(self.hashes))
            at, which, own = at[again], which[again] + 1, own[again]
        at, which = (np.concatenate([f[k] for f in found]) if found else np.empty(0, np.int64) for k in (0, 1))
        return at, which


class BlockIndex:
    """Fingerprints and windows of a block of items, given as (item id, text)."""

    def __init__(self, items: list[tuple[str | None, bytes]]):
        self.names = [name for name, _ in items]
        self.number: dict[bytes, int] = {}
        ids: list[int] = []
        starts: dict[int, list[int]] = {}
        owners: dict[int, list[int]] = {}
        for item, (_, text) in enumerate(items):
            words = words_of(text)
            if not words:
                continue
            length = min(WINDOW, len(words))
            begin = len(ids)
            ids += [self.number.setdefault(w, len(self.number) + 1) for w in words] + [0]
            n = len(words) - length + 1
            starts.setdefault(length, []).extend(range(begin, begin + n))
            owners.setdefault(length, []).extend([item] * n)
        own = np.array(ids, np.int64)
        mixed = _mixed(own)
        self.windows = {n: Windows(n, np.array(starts[n]), np.array(owners[n]), own, mixed) for n in sorted(starts)}
        marks = [gram_hashes(mixed[a:b], K)[fingerprints(mixed[a:b])] for a, b in _runs(own)]
        self.marks = np.unique(np.concatenate(marks)) if marks else np.empty(0, np.uint64)

    def hits(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of a row of word numbers (0: a word of no item, or an end): which are hit, and pairs
        (place, item) with a place inside each occurrence."""
        hit = np.zeros(len(ids) + 1, np.int64)
        found: list[np.ndarray] = []
        mixed = _mixed(ids)
        places: dict[int, list[np.ndarray]] = {}
        shortest = min(self.windows, default=0)
        for a, b in _runs(ids, shortest):
            for length in self.windows:
                if length < WINDOW and b - a >= length:
                    places.setdefault(length, []).append(np.arange(a, b - length + 1))
            if WINDOW in self.windows and b - a >= WINDOW:
                at = fingerprints(mixed[a:b])
                shared = at[np.isin(gram_hashes(mixed[a:b], K)[at], self.marks)]
                if len(shared):
                    around = np.unique(shared[:, None] - np.arange(WINDOW - K + 1))
                    places.setdefault(WINDOW, []).append(a + around[(around >= 0) & (around + WINDOW <= b - a)])
        for length, some in places.items():
            w = self.windows[length]
            at, which = w.find(ids, mixed, np.concatenate(some))
            np.add.at(hit, at, 1)
            np.add.at(hit, at + length, -1)
            counts = w.edges[which + 1] - w.edges[which]
            ends = np.cumsum(counts)
            rows = np.arange(ends[-1] if len(ends) else 0) + np.repeat(w.edges[which] - (ends - counts), counts)
            found.append(np.stack([np.repeat(at, counts), w.owners[rows]], axis=1))
        return np.cumsum(hit[:-1]) > 0, np.concatenate(found) if found else np.empty((0, 2), np.int64)


def _runs(ids: np.ndarray, least: int = 1):
    """(from, to) of the runs of values other than 0, of ``least`` values at least."""
    edge = np.diff(np.concatenate([[0], (ids != 0).view(np.int8), [0]]))
    a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    keep = b - a >= least
    return zip(a[keep].tolist(), b[keep].tolist(), strict=True)


def _blocks(benchmark: DataFrame, key: str, text: str):
    """The items in blocks of bounded size, one after the other. Items stream to the driver, which indexes
    a block and hands it to the executors before it takes the next: the benchmark is the stated query set, not the corpus."""
    block: list[tuple[str | None, bytes]] = []
    size, n = 0, 0
    for row in benchmark.select(F.col(key).cast("string").alias("k"), F.col(text).alias("t")).where("t is not null").toLocalIterator():
        data = row["t"].encode()
        if block and size + len(data) > BLOCK_BYTES:
            yield block
            block, size, n = [], 0, n + 1
        block.append((row["k"], data))
        size += len(data)
    if block or not n:
        yield block


def _scan(docs: DataFrame, block: list[tuple[str | None, bytes]], key: str, text: str, keep_hits: bool) -> DataFrame:
    shipped = docs.sparkSession.sparkContext.broadcast(BlockIndex(block))

    def run(batches):
        from kegler.llm.vocabulary import release, text_slices

        index = shipped.value
        get = index.number.get
        for batch in batches:
            for a, b in text_slices(batch.column(1)):
                flat: list[int] = []
                edges = [0]
                for t in batch.column(1).slice(a, b - a).cast(pa.binary()).to_pylist():
                    t = t or b""
                    flat.extend(map(get, words_of(t), repeat(0)))
                    flat.append(0)
                    edges.append(len(flat))
                ids = np.array(flat, np.int64)
                hit, found = index.hits(ids)
                edge = np.array(edges)
                doc = np.searchsorted(edge, found[:, 0], "right") - 1
                items: list[list[str]] = [[] for _ in range(b - a)]
                for d, i in np.unique(np.stack([doc, found[:, 1]], axis=1), axis=0).tolist():
                    if index.names[i] is not None:
                        items[d].append(index.names[i])
                out = {
                    key: batch.column(0).slice(a, b - a),
                    "n_words": pa.array(np.diff(edge) - 1, pa.int64()),
                    "items": pa.array([sorted(set(x)) for x in items], pa.list_(pa.string())),
                }
                if keep_hits:
                    out["hit"] = pa.array([np.flatnonzero(hit[edges[k] : edges[k + 1]]) for k in range(b - a)], pa.list_(pa.int32()))
                else:
                    out["n_hit"] = pa.array(np.add.reduceat(hit, edge[:-1]), pa.int64())
                yield pa.RecordBatch.from_pydict(out)
        release()

    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_words long, items array<string>, " + ("hit array<int>" if keep_hits else "n_hit long")
    return docs.select(F.col(key), F.col(text)).mapInArrow(run, schema)


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """For every document: key, n_words, n_hit (words inside an occurrence of a window), items.

    ``items`` are the distinct ids, as strings in order, of the items whose windows occur; an item
    with a null id hits but isn't named, one without words or with a null text has no window. A
    null or empty document has no words. Rows that repeat give equal rows; other columns are ignored.
    """
    blocks = _blocks(benchmark, item_key, item_text)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        return _scan(docs, first, key, text, False).select(F.col(key), "n_words", "n_hit", "items")
    # More blocks: gather what each found by row, told by its key and text.
    rows = docs.select(F.struct(F.col(key).alias("k"), F.xxhash64(text).alias("h")).alias("row"), F.col(text).alias("t"))
    scans = [_scan(rows, block, "row", "t", True).where("size(hit) > 0") for block in chain([first, second], blocks)]
    every = scans[0]
    for scan in scans[1:]:
        every = every.unionByName(scan)
    one = every.groupBy("row").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        F.size(F.array_distinct(F.flatten(F.collect_set("hit")))).cast("long").alias("n_hit"),
    )
    base = _scan(rows, [], "row", "t", False).select("row", "n_words")
    joined = base.join(one, "row", "left")
    return joined.select(F.col("row.k").alias(key), "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def contamination_digest(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id") -> DataFrame:
    found = contamination(docs, benchmark, key)
    return found.select(
        F.col(key), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without any word inside an occurrence of a benchmark window.

    Their rows keep all columns, rows that repeat stay or go together; the verdict is worked out beside
    each row, without a join. A null or empty text has no words and stays.
    """
    names = docs.columns
    left = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(text).alias("t"))
    for block in _blocks(benchmark, "item_id", "text"):
        scanned = _scan(left, block, "row", "t", False).where("n_hit = 0")
        left = scanned.select("row", F.col(f"row.`{text}`").alias("t"))
    return left.select("row.*")


def items_sha256(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
