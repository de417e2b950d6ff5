"""N-gram Jaccard join by parity sketches.

A document is the set of its distinct five-word shingles. Shingles are XOR-hashed into parts: a
part's parity word is the XOR of the shingles that fall into it, so each shingle in which two
documents differ changes one part at most, and the number of parts that differ is a lower bound of
the symmetric difference. For a Jaccard similarity of 3/4 that difference is at most a seventh of
the sizes' sum, so by the pigeonhole principle two linked documents agree in one of the first
n // 3 + 1 non-empty parts of each, in any order that is the same for all. That order puts parts
whose shingles are all very common last. The number of parts is that of the size band; documents
near the upper end of a band also take part in the next.

Documents that agree in a part are candidates if dense parity sketches, of as many bits as there are
shingles, allow it, whose Hamming distance also bounds the symmetric difference from below; passages
that documents share get no further. Of a part that many documents show, each is tested against the
first one; a part whose documents that hasn't connected is compared in blocks of bounded size.
Groups of connected candidates are then verified with the whole sets, again in blocks that have one
member in common, and block against block only where that leaves a group in pieces. Pairs that are
already connected need no look, so a group of near copies costs about one look per member. Copies
with equal sets are one class from the first pass on.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kegler.llm.components import connected_components
from kegler.llm.decontaminate import gram_hashes
from kegler.llm.storage import Scratch, discard, materialize
from kegler.llm.vocabulary import release, text_slices

SHINGLE = 5
#: Similarity 75 / 100. The bounds below (n // 3, a seventh) are those of this value.
NUMERATOR, DENOMINATOR = 75, 100
#: Up to this set size each shingle is a part of its own.
SMALL = 64
#: Buckets of the shingle counts that tell common shingles; 8 MB a task, 256 kB once thresholded.
BUCKETS = 1 << 21
SKETCH_BITS = 1024
#: Bits per candidate of the filter that tells which documents are candidates, and most bits of it: 32 MB.
#: With more candidates it lets more through; the join drops the rest.
FILTER_SHARE, FILTER_BITS = 16, 1 << 28
#: Members of a group with the same part that a block holds, and shingles of a group of candidates: 16 MB.
BLOCK_MEMBERS, BLOCK_SHINGLES = 4096, 1 << 21
#: Classes that show the same part up to which all their pairs are written down.
SMALL_GROUP = 16
#: Bytes of text that a task works on at once.
TEXT_BYTES = 1 << 20


class Shingler:
    """Shingle sets of texts. A word's hash is a polynomial in the numbers of its bytes, so the hashes of
    all words come from one running sum over the bytes; nothing is kept from text to text."""

    _BASE = 0x9E3779B97F4A7C15
    _SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])

    def __init__(self):
        rng = np.random.default_rng(0x5EED)
        self.number = rng.integers(1, 1 << 64, 256, np.uint64)
        self.number[0x41:0x5B] = self.number[0x61:0x7B]  # A-Z as a-z
        self.power, self.inverse = self._powers(self._BASE, 1 << 16), self._powers(pow(self._BASE, -1, 1 << 64), 1 << 16)

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    def words(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hashes of the words of a text given as bytes, where each begins)."""
        while len(text) + 1 > len(self.power):
            n = 2 * len(self.power)
            self.power, self.inverse = self._powers(self._BASE, n), self._powers(pow(self._BASE, -1, 1 << 64), n)
        solid = np.zeros(len(text) + 2, np.int8)
        solid[1:-1] = ~self._SPACE[text]
        edge = np.diff(solid)
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        upto = np.zeros(len(text) + 1, np.uint64)
        np.cumsum(self.number[text] * self.power[: len(text)], out=upto[1:])
        own = (upto[end] - upto[begin]) * self.inverse[begin]
        own ^= own >> np.uint64(32)
        own *= np.uint64(0xD6E8FEB86659FD93)
        return own ^ (own >> np.uint64(32)), begin

    def __call__(self, text: bytes) -> np.ndarray:
        """Sorted distinct 64-bit hashes of the shingles of a text."""
        return self.all([text])[0]

    def all(self, texts: list[bytes]) -> list[np.ndarray]:
        """The sets of several texts, whose words are hashed together."""
        own, begin = self.words(np.frombuffer(b"\n".join(texts), np.uint8))
        edges = np.searchsorted(begin, np.cumsum([0, *(len(t) + 1 for t in texts)]))
        grams = gram_hashes(own, SHINGLE)
        out = []
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if b - a >= SHINGLE:
                own_grams = np.sort(grams[a : b - SHINGLE + 1])
                out.append(own_grams[np.concatenate([[True], own_grams[1:] != own_grams[:-1]])])
            else:
                out.append(gram_hashes(own[a:b], b - a) ^ np.uint64(b - a) if b > a else own[a:b])
        return out


def class_of(shingles: np.ndarray) -> int:
    """A 64-bit name of a set; equal sets have the same."""
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def _spread(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x ^ np.uint64(salt)) * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(32)
    return x * np.uint64(0xC4CEB9FE1A85EC53) ^ (x >> np.uint64(29))


def part_keys(shingles: np.ndarray, common: np.ndarray | None = None) -> list[np.ndarray]:
    """Keys of the parts that a document shows, for each size band in which it takes part.

    common: bit array by bucket of the shingles that very many documents have.
    """
    n = len(shingles)
    if n == 0:
        return []
    hot = np.unpackbits(common)[_bucket(shingles)].astype(bool) if common is not None else np.zeros(n, bool)
    band = n.bit_length() - 1
    out = []
    for b in (band, band + 1) if 4 * n >= 3 << (band + 1) else (band,):
        size = 1 << b
        part = _spread(shingles, 0x51ED27) % np.uint64(size * 3 // 2) if size >= SMALL else shingles
        order = np.argsort(part, kind="stable")
        part, own, cold = part[order], _spread(shingles, 0xA11CE)[order], ~hot[order]
        first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        key = _spread(np.bitwise_xor.reduceat(own, first) ^ _spread(part[first], b + 1), 0xBEE)
        rare = np.logical_or.reduceat(cold, first)
        pick = np.lexsort((key, ~rare))[: n // 3 + 1]
        out.append(key[pick])
    return out


def dense_sketch(shingles: np.ndarray) -> np.ndarray:
    """Parities of the shingles by bucket, at least as many buckets as shingles: the Hamming distance of
    two sketches of one width is at most the symmetric difference."""
    bits = max(SKETCH_BITS, 1 << (len(shingles) - 1).bit_length()) if len(shingles) else SKETCH_BITS
    return np.packbits(np.bincount((shingles >> np.uint64(7)).astype(np.int64) % bits, minlength=bits) & 1)


def folded(sketches: np.ndarray, words: int) -> np.ndarray:
    """Sketches, one a row, brought down to ``words`` words: the parities of the halves add up."""
    while sketches.shape[1] > words:
        half = sketches.shape[1] // 2
        sketches = sketches[:, :half] ^ sketches[:, half:]
    return sketches


def _sets(shingler: Shingler, column: pa.Array):
    """(from, to, shingle sets) of runs of rows of a text column."""
    for a, b in text_slices(column, TEXT_BYTES):
        yield a, b, shingler.all([t or b"" for t in column.slice(a, b - a).cast(pa.binary()).to_pylist()])


def _bucket(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def _reduced(frame: DataFrame, combine: str, kinds: dict[int, str], wide: str) -> DataFrame:
    """Arrays that many tasks give in pieces (piece, data), combined piece by piece into a wider kind.
    kinds: the kind of number by the bytes of a piece."""
    def run(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k in range(batch.num_rows):
                piece, data = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                own = np.frombuffer(data, kinds[len(data)])
                if piece not in total:
                    total[piece] = own.astype(wide)
                elif combine == "sum":
                    total[piece] += own
                else:
                    total[piece] |= own
        if total:
            yield pa.RecordBatch.from_pydict({"piece": pa.array(list(total), pa.int32()), "data": pa.array([x.tobytes() for x in total.values()], pa.binary())})
        release()

    return frame.repartition(PIECES, "piece").mapInArrow(run, "piece int, data binary")


PIECES = 64


def _pieces(values: np.ndarray):
    """The parts of an array, one a batch, so that no large batch is built."""
    for k, x in enumerate(values.reshape(PIECES, -1)):
        yield pa.RecordBatch.from_pydict({"piece": pa.array([k], pa.int32()), "data": pa.array([x.tobytes()], pa.binary())})


def common_shingles(docs: DataFrame, text: str) -> np.ndarray:
    """Bits by bucket (upper bits of a hash): whether far more documents have its shingles than the
    average bucket's, beyond what chance spreads. Any choice gives the same links; this one keeps passages that many
    documents share from making candidates of all of them. Counts are of all documents."""
    def count(batches):
        shingler, total = Shingler(), np.zeros(BUCKETS, np.uint32)
        for batch in batches:
            for _, _, sets in _sets(shingler, batch.column(0)):
                np.add.at(total, _bucket(np.concatenate(sets)), np.uint32(1))
        yield from _pieces(total.astype(np.uint16) if total.max() < 1 << 16 else total)
        del total
        release()

    size = BUCKETS // PIECES
    rows = _reduced(docs.select(text).mapInArrow(count, "piece int, data binary"), "sum", {2 * size: "u2", 4 * size: "u4"}, "u8").collect()
    counts = np.zeros((PIECES, size), np.uint64)
    for r in rows:
        counts[r["piece"]] = np.frombuffer(r["data"], np.uint64)
    mean = float(counts.mean())
    return np.packbits(counts.ravel() > mean + 6 * mean**0.5 + 10)


def signatures(docs: DataFrame, key: str, text: str) -> DataFrame:
    """id, class (null without words), n, sketch, keys of the parts shown. One row per document."""
    common = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, text))

    def run(batches):
        shingler, hot = Shingler(), common.value
        for batch in batches:
            for a, b, sets in _sets(shingler, batch.column(1)):
                classes = [class_of(s) if len(s) else None for s in sets]
                seen: set[int] = set()
                keys = []
                for s, c in zip(sets, classes, strict=True):
                    # Of copies at hand one shows its parts.
                    keys.append([] if c is None or c in seen else np.concatenate(part_keys(s, hot)).view(np.int64))
                    if c is not None:
                        seen.add(c)
                yield pa.RecordBatch.from_pydict({
                    "id": batch.column(0).slice(a, b - a),
                    "class": pa.array(classes, pa.int64()),
                    "n": pa.array([len(s) for s in sets], pa.int64()),
                    "sketch": pa.array([dense_sketch(s).tobytes() for s in sets], pa.binary()),
                    "keys": pa.array(keys, pa.list_(pa.int64())),
                })
        release()

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"id {kind}, class long, n long, sketch binary, keys array<long>")


def shared_parts(shown: DataFrame) -> DataFrame:
    """What classes that show the same part make, as rows (key, u, v): of a part that up to
    ``SMALL_GROUP`` classes show all pairs u, v with a null key, of others each class as u with the least as v.

    Rows stream through in order of key and class, so a group of any size needs no memory.
    """
    def run(batches):
        big = None  # key, least and last class of a large group that has begun
        held_k = held_c = np.empty(0, np.int64)
        for batch in batches:
            k, c = np.append(held_k, batch.column(0).to_numpy()), np.append(held_c, batch.column(1).to_numpy())
            if not len(k):
                continue
            new = np.concatenate([[True], (k[1:] != k[:-1]) | (c[1:] != c[:-1])])
            k, c = k[new], c[new]
            if big is not None:
                upto = int(np.searchsorted(k != big[0], True)) if (k != big[0]).any() else len(k)
                skip = int(upto > 0 and c[0] == big[2])
                if upto > skip:
                    yield _shown(k[skip:upto], c[skip:upto], np.full(upto - skip, big[1]))
                    big = (big[0], big[1], c[upto - 1])
                k, c = k[upto:], c[upto:]
                if not len(k):
                    continue
                big = None
            last = int(np.searchsorted(k, k[-1])) if (np.diff(k) >= 0).all() else int(np.flatnonzero(k[1:] != k[:-1])[-1]) + 1
            yield from _grouped(k[:last], c[:last])
            held_k, held_c = k[last:], c[last:]
            if len(held_k) > SMALL_GROUP:
                yield _shown(held_k, held_c, np.full(len(held_k), held_c[0]))
                big, held_k, held_c = (held_k[-1], held_c[0], held_c[-1]), held_k[:0], held_c[:0]
        yield from _grouped(held_k, held_c)
        release()

    n = int(shown.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = shown.select(F.explode("keys").alias("key"), "class").repartition(n, "key").sortWithinPartitions("key", "class")
    return rows.mapInArrow(run, "key long, u long, v long")


def _shown(keys: np.ndarray, classes: np.ndarray, least: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.int64()), "u": pa.array(classes, pa.int64()), "v": pa.array(least, pa.int64())})


def _grouped(keys: np.ndarray, classes: np.ndarray):
    """Rows of ``shared_parts`` for whole groups."""
    if len(keys) < 2:
        return
    first = np.concatenate([[True], keys[1:] != keys[:-1]])
    group = np.cumsum(first) - 1
    members = np.bincount(group)[group]
    small = np.flatnonzero((members > 1) & (members <= SMALL_GROUP))
    found = []
    for shift in range(1, SMALL_GROUP):
        a, b = small[:-shift], small[shift:]
        same = group[a] == group[b]
        if not same.any():
            break
        found.append(np.stack([classes[a[same]], classes[b[same]]], axis=1))
    if found:
        pairs = np.unique(np.concatenate(found), axis=0)
        yield pa.RecordBatch.from_pydict({"key": pa.nulls(len(pairs), pa.int64()), "u": pa.array(pairs[:, 0], pa.int64()), "v": pa.array(pairs[:, 1], pa.int64())})
    large = members > SMALL_GROUP
    if large.any():
        yield _shown(keys[large], classes[large], classes[np.flatnonzero(first)][group][large])


def _forest(rows: DataFrame, group: str, blocks, values: list[str], find, scratch: Scratch) -> DataFrame:
    """Edges (u, v) that connect, within each group, all that ``find`` connects.

    rows: group, class, root (which tells what is connected already) and values. A group has
    ``blocks`` blocks, each of which also gets the member with the least class; ``find`` gives a spanning forest
    of the near pairs of a block. Only groups that this leaves in pieces are compared block against block.
    """
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("blocks", F.greatest(F.lit(1), F.ceil(blocks)).cast("int")).withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    own = [group, "i", "j", "block", "class", "root", "blocks", *values]
    kinds = f"u long, v long, `{group}` long"

    def run(batches):
        for unit, names, side, roots, n_blocks, columns in _groups(batches, len(values)):
            across = unit[1] != unit[2]
            found = find(names, columns, np.array(side) if across else None, roots)
            yield from _edge_batches(found, group)
            if not across and n_blocks > 1 and not _one(roots, names, found):
                yield pa.RecordBatch.from_pydict({"u": pa.nulls(1, pa.int64()), "v": pa.nulls(1, pa.int64()), group: pa.array([unit[0]], pa.int64())})
        release()

    all_blocks = F.sequence(F.lit(0), F.col("blocks") - 1)
    first = dealt.withColumn("i", F.explode(F.when((F.col("class") == F.col("least")) & (F.col("blocks") > 1), all_blocks).otherwise(F.array("block")))).withColumn("j", F.col("i"))
    found = scratch(first.select(*own).repartition(n, group, "i").sortWithinPartitions(group, "i").mapInArrow(run, kinds), "ngram-blocks")
    edges = found.where("u is not null").select("u", "v")
    pieces = found.where("u is null").select(group).distinct()
    if pieces.isEmpty():
        return edges
    roots = connected_components(edges.unionByName(rows.where("root != class").select(F.col("class").alias("u"), F.col("root").alias("v"))), scratch=scratch)
    left = dealt.join(pieces, group, "left_semi").drop("root").join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    spread = left.withColumn("other", F.explode(all_blocks)).where("other != block")
    units = spread.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).select(*own)
    return edges.unionByName(scratch(units.repartition(n, group, "i", "j").sortWithinPartitions(group, "i", "j").mapInArrow(run, kinds), "ngram-across").select("u", "v"))


def _one(roots: list[int], names: list[int], found: list[tuple[int, int]]) -> bool:
    """Whether what was found, and what was connected before, connects all."""
    return len(found) == len(set(roots)) - 1


def candidate_edges(table: DataFrame, scratch: Scratch) -> DataFrame:
    """Edges between classes that agree in a part and whose dense sketches are near enough.

    table: class, n, sketch, keys. Pairs of small groups, and of the members of large groups with the least of them,
    each once, are tested one by one; a large group that these leave in pieces gives a
    spanning forest of its near pairs. scratch: gets the tables that the edges are read from.
    """
    shared = scratch(shared_parts(table.where("size(keys) > 0")), "ngram-shared")
    known = scratch(table.groupBy("class").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch")), "ngram-known")

    def test(batches):
        for whole in batches:
            for begin in range(0, whole.num_rows, 1024):
                batch = whole.slice(begin, 1024)
                u, v, nu, nv = (batch.column(k).to_numpy() for k in range(4))
                su, sv = batch.column(4).to_pylist(), batch.column(5).to_pylist()
                widths = np.array([(len(x) // 8, len(y) // 8) for x, y in zip(su, sv, strict=True)]).reshape(-1, 2)
                near = 3 * np.maximum(nu, nv) <= 4 * np.minimum(nu, nv)
                for wide in np.unique(widths[near], axis=0).tolist():
                    at = np.flatnonzero(near & (widths == wide).all(axis=1))
                    a, b = (folded(np.frombuffer(b"".join(x[k] for k in at), np.uint64).reshape(len(at), -1), min(wide)) for x in (su, sv))
                    near[at] = np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64) <= (nu[at] + nv[at]) // 7
                yield pa.RecordBatch.from_pydict({"u": pa.array(u[near], pa.int64()), "v": pa.array(v[near], pa.int64())})
        release()

    pairs = shared.where("u != v").select("u", "v").distinct()
    pairs = pairs.join(known.select(F.col("class").alias("u"), F.col("n").alias("nu"), F.col("sketch").alias("su")), "u")
    pairs = pairs.join(known.select(F.col("class").alias("v"), F.col("n").alias("nv"), F.col("sketch").alias("sv")), "v")
    tested = scratch(pairs.select("u", "v", "nu", "nv", "su", "sv").mapInArrow(test, "u long, v long"), "ngram-tested")
    # Large groups that the least member hasn't connected.
    roots = connected_components(tested, scratch=scratch)
    large = shared.where("key is not null").select("key", F.col("u").alias("class")).join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    large = scratch(large, "ngram-large")
    sizes = large.groupBy("key").agg(F.count("*").alias("members"), F.min("class").alias("least"), F.min("root").alias("a"), F.max("root").alias("b")).where("a != b").drop("a", "b")
    rows = large.join(sizes, "key").join(known, "class")

    def near(names, columns, side, roots):
        n, sketch = columns
        return near_pairs(names, np.array(n), [np.frombuffer(x, np.uint64) for x in sketch], side, roots)

    return tested.unionByName(_forest(rows, "key", F.col("members") / BLOCK_MEMBERS, ["n", "sketch"], near, scratch))


def _groups(batches, n_values: int):
    """(unit, names, sides, roots, blocks, value columns) of rows unit, block, name, root, blocks, values in order of unit."""
    unit, names, side, roots, blocks, values = None, [], [], [], 1, [[] for _ in range(n_values)]
    for batch in batches:
        for begin in range(0, batch.num_rows, 1024):
            columns = [c.slice(begin, 1024).to_pylist() for c in batch.columns]
            for key, i, j, block, name, root, n_blocks, *own in zip(*columns, strict=True):
                if unit != (key, i, j):
                    if unit is not None:
                        yield unit, names, side, roots, blocks, values
                    unit, names, side, roots, blocks, values = (key, i, j), [], [], [], n_blocks, [[] for _ in range(n_values)]
                names.append(name)
                side.append(int(block == j))
                roots.append(root)
                for column, v in zip(values, own, strict=True):
                    column.append(v)
    if unit is not None:
        yield unit, names, side, roots, blocks, values


def _edge_batches(found: list[tuple[int, int]], group: str):
    if found:
        yield pa.RecordBatch.from_pydict({"u": pa.array([u for u, _ in found], pa.int64()), "v": pa.array([v for _, v in found], pa.int64()), group: pa.nulls(len(found), pa.int64())})


def _id_bit(ids: pa.Array, n_bits: int) -> np.ndarray:
    """Place of an id in a filter; that of a null is any."""
    x = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    return (_spread(x, 0xF117E5) >> np.uint64(20)).astype(np.int64) % n_bits


def _id_filter(ids: DataFrame) -> np.ndarray:
    """Bits of the (long) ids of a one-column table: as many as fit its number of rows, up to ``FILTER_BITS``."""
    n_bits = min(FILTER_BITS, max(1 << 16, 1 << (FILTER_SHARE * ids.count()).bit_length()))

    def run(batches):
        bits = np.zeros(n_bits // 8, np.uint8)
        for batch in batches:
            place = _id_bit(batch.column(0), n_bits)
            np.bitwise_or.at(bits, place >> 3, (128 >> (place & 7)).astype(np.uint8))
        yield from _pieces(bits)

    size = n_bits // 8 // PIECES
    rows = _reduced(ids.mapInArrow(run, "piece int, data binary"), "or", {size: "u1"}, "u1").collect()
    out = np.zeros((PIECES, size), np.uint8)
    for r in rows:
        out[r["piece"]] = np.frombuffer(r["data"], np.uint8)
    return out.ravel()


def candidate_sets(docs: DataFrame, key: str, text: str, wanted: DataFrame) -> DataFrame:
    """id, class, shingles (binary) of the documents that ``wanted`` has by id and class, with its other
    columns. A null id is one like any other, and a document whose id also stands for another text
    comes with the class of its own."""
    bits = docs.sparkSession.sparkContext.broadcast(_id_filter(wanted.where("id is not null").select("id")))
    nulls = not wanted.where("id is null").isEmpty()

    def run(batches):
        shingler, on = Shingler(), bits.value
        for batch in batches:
            place = _id_bit(batch.column(0), 8 * len(on))
            own = (on[place >> 3] >> (7 - (place & 7)) & 1).astype(bool)
            null = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            chosen = batch.filter(pa.array(np.where(null, nulls, own)))
            for a, b, sets in _sets(shingler, chosen.column(1)):
                classes = [class_of(x) if len(x) else None for x in sets]
                yield pa.RecordBatch.from_pydict({"id": chosen.column(0).slice(a, b - a), "class": pa.array(classes, pa.int64()), "shingles": pa.array([x.tobytes() for x in sets], pa.binary())})
        release()

    rows = docs.select(F.col(key).cast("long"), F.col(text)).mapInArrow(run, "id long, class long, shingles binary")
    named = wanted.withColumnsRenamed({"id": "_id", "class": "_class"})
    return rows.join(named, F.col("id").eqNullSafe(F.col("_id")) & (F.col("class") == F.col("_class"))).drop("_id", "_class")


def near_pairs(names: list[int], sizes: np.ndarray, sketch: list[np.ndarray], side: np.ndarray | None = None, roots: list[int] | None = None, verify=None) -> list[tuple[int, int]]:
    """A spanning forest of the pairs that sizes and sketches allow, or, with ``verify(a, b)``, of those
    that it confirms: pairs that are already connected, by roots or by pairs found, aren't looked at.

    side: 0 or 1 for each; then only pairs of either side count.
    """
    order = np.lexsort((np.array(names), sizes))
    sizes = sizes[order]
    # Widths grow with sizes: for each width, the sketches of that width and beyond, folded to it.
    width = np.array([len(sketch[k]) for k in order])
    begin = {w: int(np.searchsorted(width, w)) for w in np.unique(width).tolist()}
    rows = {w: np.concatenate([folded(sketch[k][None, :], w) for k in order[at:]]) for w, at in begin.items()}
    sides = None if side is None else side[order]
    label = np.arange(len(order)) if roots is None else np.unique(np.array(roots, np.int64)[order], return_inverse=True)[1]
    most = len(np.unique(label)) - 1
    found = []
    for a in range(len(order) - 1):
        if len(found) == most:
            break  # all are connected
        upto = int(np.searchsorted(sizes, sizes[a] * 4 // 3, "right"))
        near = a + 1 + np.flatnonzero(label[a + 1 : upto] != label[a])
        if sides is not None:
            near = near[sides[near] != sides[a]]
        if not len(near):
            continue
        w = int(width[a])
        distance = np.bitwise_count(rows[w][near - begin[w]] ^ rows[w][a - begin[w]]).sum(axis=1, dtype=np.int64)
        for b in near[distance <= (sizes[near] + sizes[a]) // 7].tolist():
            if label[b] != label[a] and (verify is None or verify(order[a], order[b])):
                found.append((names[order[a]], names[order[b]]))
                label[label == label[b]] = label[a]
    return found


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return DENOMINATOR * both >= NUMERATOR * (len(a) + len(b) - both)


def _links(members: DataFrame, scratch: Scratch) -> DataFrame:
    """Verified links (u, v) between classes; members: comp, class, total (shingles of the group), least, shingles."""
    def confirmed(names, columns, side, roots):
        sets = [np.frombuffer(x, np.uint64) for x in columns[0]]
        sketch = [dense_sketch(s).view(np.uint64) for s in sets]
        return near_pairs(names, np.array([len(s) for s in sets]), sketch, side, roots, lambda a, b: similar(sets[a], sets[b]))

    return _forest(members.withColumn("root", F.col("class")), "comp", F.col("total") / BLOCK_SHINGLES, ["shingles"], confirmed, scratch)


def ngram_components(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles, component_id of every document: the least key reachable by links.

    Two documents link when 100 * shingles in both >= 75 * shingles in either. Keys are integers. A
    null text or one without words has no shingles and is its own component; with fewer than five
    words, the whole sequence is the one shingle. Rows that share a null key link like others, and a
    component's id passes over null keys. Sets are told apart by 64-bit hashes of their shingles.
    """
    spark_key = docs.schema[key].dataType.simpleString()
    table = materialize(signatures(docs, key, text), "ngram-signatures")
    scratch = Scratch()
    groups = connected_components(candidate_edges(table.where("class is not null").select("class", "n", "sketch", "keys"), scratch), scratch=scratch)
    # A class is fetched by its least id, or by the null id where it has no other.
    first = table.where("class is not null").groupBy("class").agg(F.min(F.col("id").cast("long")).alias("id"), F.min("n").alias("n"))
    wanted = first.join(groups.select(F.col("node").alias("class"), F.col("root").alias("comp")), "class")
    wanted = materialize(wanted, "ngram-wanted")
    scratch.drop()
    totals = wanted.groupBy("comp").agg(F.sum("n").alias("total"), F.min("class").alias("least"))
    members = candidate_sets(docs, key, text, wanted.join(totals, "comp").drop("n")).select("comp", "class", "total", "least", "shingles").dropDuplicates(["class"])
    roots = connected_components(_links(members, scratch), scratch=scratch).select(F.col("node").alias("class"), "root")
    named = table.select("id", "n", "class").join(roots, "class", "left").withColumn("root", F.coalesce("root", "class"))
    named = materialize(named.select("id", "n", "root"), "ngram-named")
    scratch.drop()
    discard(table, wanted)
    least = named.where("root is not null").groupBy("root").agg(F.min("id").alias("least"))
    out = named.join(least, "root", "left").select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("least", "id").alias("component_id"))
    return out.select(F.col(key).cast(spark_key), "n_shingles", "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that are the first of their component, with all their columns.

    A key stands for one document: rows that repeat a key stay or go together. A null key stays.
    """
    found = ngram_components(docs, key, text)
    dropped = found.where(F.col(key) != F.col("component_id")).select(F.col(key)).distinct()
    return docs.join(dropped, key, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
