"""Token-ID output: sorted-string-table shards.

A shard file holds documents in key order:

    data blocks   entries (shared key bytes, other key bytes, value bytes as varints; key rest; value),
                  then the offsets of the restart points, their count and a CRC-32; keys are
                  prefix-compressed against the entry before, in full at each restart point
    index block   last key, offset and length of each data block: the sparse index
    Bloom filter  over all keys
    footer        fixed size: places of index and filter, counts, id width, magic

A key is the document id as eight big-endian bytes with the sign bit flipped, so byte order is
numeric order; a null id is the empty key and comes first. A value is the ids of the document
as little-endian unsigned 16- or 32-bit integers. A look-up asks the Bloom filter, then searches
the index and the restart points of one block by bisection.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kegler.llm.storage import materialize, open_fs, qualified, work_path
from kegler.llm.vocabulary import ChunkVocabulary, release, text_slices

MAGIC = b"KGSST001"
FOOTER = struct.Struct("<QQQQQQBB6x8s")
#: ASCII marks that follow a word as a piece of their own; an apostrophe may begin an ending instead.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
BLOCK_BYTES, RESTART_EVERY, BLOOM_BITS_PER_KEY, BLOOM_HASHES = 1 << 16, 16, 10, 7


def pack_key(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else ((doc_id + (1 << 63)) & ((1 << 64) - 1)).to_bytes(8, "big")


def unpack_key(key: bytes) -> int | None:
    return int.from_bytes(key, "big") - (1 << 63) if key else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


class Bloom:
    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @staticmethod
    def _places(hashes: np.ndarray, n_bits: int) -> np.ndarray:
        step = (hashes >> np.uint64(33)) | np.uint64(1)
        return (hashes[:, None] + step[:, None] * np.arange(BLOOM_HASHES, dtype=np.uint64)) % np.uint64(n_bits)

    @classmethod
    def of(cls, hashes: list[int]) -> "Bloom":
        n_bits = max(64, -(-len(hashes) * BLOOM_BITS_PER_KEY // 64) * 64)
        bits = np.zeros(n_bits, bool)
        bits[cls._places(np.array(hashes, np.uint64), n_bits).ravel()] = True
        return cls(np.packbits(bits))

    def may_hold(self, key: bytes) -> bool:
        places = self._places(np.array([xxhash.xxh3_64_intdigest(key)], np.uint64), len(self.bits) * 8)[0]
        return all(self.bits[int(p) >> 3] >> (7 - (int(p) & 7)) & 1 for p in places)


class ShardWriter:
    """Writes entries that come in key order; holds one block, the index and the key hashes."""

    def __init__(self, sink, width: int):
        self.sink, self.width = sink, width
        self.at = self.n_entries = self.n_ids = 0
        self.index: list[tuple[bytes, int, int]] = []
        self.hashes: list[int] = []
        self.last = b""
        self._fresh()

    def _fresh(self) -> None:
        self.block, self.restarts, self.in_block = bytearray(), [], 0

    def add(self, key: bytes, ids: np.ndarray) -> None:
        self.put(key, ids.astype("<u2" if self.width == 2 else "<u4").tobytes())

    def put(self, key: bytes, value: bytes) -> None:
        """Add an entry whose ids are packed already."""
        if self.n_entries and key < self.last:
            raise ValueError("keys must not descend")
        shared = 0
        if self.in_block % RESTART_EVERY:
            limit = min(len(key), len(self.last))
            while shared < limit and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.restarts.append(len(self.block))
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.last, self.in_block = key, self.in_block + 1
        self.n_entries, self.n_ids = self.n_entries + 1, self.n_ids + len(value) // self.width
        self.hashes.append(xxhash.xxh3_64_intdigest(key))
        if len(self.block) >= BLOCK_BYTES:
            self._flush()

    def _put(self, data: bytes) -> tuple[int, int]:
        begin = self.at
        self.sink.write(data)
        self.at += len(data)
        return begin, len(data)

    def _flush(self) -> None:
        if not self.in_block:
            return
        body = bytes(self.block) + struct.pack(f"<{len(self.restarts)}II", *self.restarts, len(self.restarts))
        self.index.append((self.last, *self._put(body + struct.pack("<I", zlib.crc32(body)))))
        self._fresh()

    def close(self) -> None:
        self._flush()
        index = b"".join(_varint(len(k)) + k + _varint(o) + _varint(n) for k, o, n in self.index)
        where = *self._put(index), *self._put(Bloom.of(self.hashes).bits.tobytes())
        self._put(FOOTER.pack(*where, self.n_entries, self.n_ids, self.width, 1, MAGIC))


class ShardReader:
    """Reads a shard through a seekable source: in order, or by key."""

    def __init__(self, source, size: int):
        self.source = source
        footer = FOOTER.unpack(self._get(size - FOOTER.size, FOOTER.size))
        if footer[-1] != MAGIC:
            raise ValueError("not a shard file")
        index_at, index_len, bloom_at, bloom_len, self.n_entries, self.n_ids, self.width, _, _ = footer
        data, at, self.index = self._get(index_at, index_len), 0, []
        while at < len(data):
            n, at = _read_varint(data, at)
            key, at = data[at : at + n], at + n
            offset, at = _read_varint(data, at)
            length, at = _read_varint(data, at)
            self.index.append((key, offset, length))
        self.bloom = Bloom(np.frombuffer(self._get(bloom_at, bloom_len), np.uint8))

    def _get(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def _block(self, k: int) -> tuple[bytes, list[int]]:
        body = self._get(*self.index[k][1:])
        body, crc = body[:-4], struct.unpack("<I", body[-4:])[0]
        if zlib.crc32(body) != crc:
            raise ValueError("damaged block")
        (n,) = struct.unpack("<I", body[-4:])
        return body[: -4 - 4 * n], list(struct.unpack(f"<{n}I", body[-4 - 4 * n : -4]))

    def _entries(self, data: bytes, at: int) -> Iterator[tuple[bytes, np.ndarray]]:
        key = b""
        while at < len(data):
            shared, at = _read_varint(data, at)
            rest, at = _read_varint(data, at)
            n, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + rest]
            at += rest
            yield key, np.frombuffer(data, "<u2" if self.width == 2 else "<u4", n // self.width, at)
            at += n

    def __iter__(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for k in range(len(self.index)):
            yield from self._entries(self._block(k)[0], 0)

    def get(self, key: bytes) -> list[np.ndarray]:
        """The values of all entries with this key; a key that was written twice has two."""
        if not self.bloom.may_hold(key):
            return []
        found: list[np.ndarray] = []
        for k in range(bisect_left(self.index, key, key=lambda x: x[0]), len(self.index)):
            data, restarts = self._block(k)
            first = bisect_left(restarts, key, key=lambda at: next(self._entries(data, at))[0])
            for here, ids in self._entries(data, restarts[max(0, first - 1)]):
                if here > key:
                    return found
                if here == key:
                    found.append(ids)
        return found


class LibraryEncoder:
    """Ids of whole texts as the tokenizers library gives them, for a byte-level model.

    The library's own pre-tokenizer cuts each distinct chunk into pieces; the pieces of many chunks are
    encoded in one call, and the ids dealt out by the bytes they stand for. A text that holds the
    string of a special token is encoded whole by the plain call, which makes it that token's id;
    with ``special_as_text`` such strings are ordinary text everywhere.
    """

    BATCH = 1000

    def __init__(self, tokenizer_json: str, special_as_text: bool = False):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole, self.bare = Tokenizer.from_str(tokenizer_json), Tokenizer.from_str(tokenizer_json)
        self.whole.encode_special_tokens = special_as_text
        self.bare.encode_special_tokens = True
        self.bare.pre_tokenizer = None
        self.special = [] if special_as_text else [t["content"] for t in json.loads(tokenizer_json).get("added_tokens", [])]
        # A byte-level token spells each byte as one character.
        n_ids = self.whole.get_vocab_size(with_added_tokens=True)
        self.n_bytes = np.array([len(self.whole.id_to_token(i) or "") for i in range(n_ids)], np.int64)
        # Letters up to U+024F in the model's spelling, and a blank.
        cut = self.whole.pre_tokenizer.pre_tokenize_str
        self.spelling = {k: cut(chr(k))[0][0] for k in range(0x250) if chr(k).isalpha()} | {0x20: cut(" ")[0][0]}
        self.vocabulary = ChunkVocabulary(self._chunks, max_chunks=400_000)

    def _cut(self, chunk: str) -> list[str]:
        """The pieces of a chunk, spelt as the model spells them. Latin letters, after a blank or none, are one piece
        and ASCII marks after them another; all else is left to the library."""
        word = chunk.rstrip(MARKS)
        bare = word[1:] if word[:1] == " " else word
        if bare.isalpha() and max(bare) < "\u0250":
            spelt = word.translate(self.spelling)
            return [spelt] if len(word) == len(chunk) else [spelt, chunk[len(word) :]]
        return [piece for piece, _ in self.whole.pre_tokenizer.pre_tokenize_str(chunk)]

    def _chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, counts = [], []
        for k in range(0, len(chunks), self.BATCH):
            some = chunks[k : k + self.BATCH]
            pieces = [piece for c in some for piece in self._cut(c)]
            got = np.array([t for p in self.bare.encode_batch_fast([pieces], is_pretokenized=True, add_special_tokens=False) for t in p.ids], np.int32)
            ends, sizes = np.cumsum(self.n_bytes[got]), np.cumsum([len(c.encode()) for c in some])
            if len(got) and ends[-1] != sizes[-1]:
                raise ValueError("ids do not spell the text")
            counts.append(np.diff(np.searchsorted(ends, sizes) + 1, prepend=0))
            ids.append(got)
        return np.concatenate(ids), np.concatenate(counts)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each)."""
        apart = [k for k, t in enumerate(texts) if any(x in t for x in self.special)]
        if not apart:
            return self.vocabulary.encode(texts)
        own = {k: self.whole.encode(texts[k], add_special_tokens=False).ids for k in apart}
        ids, counts = self.vocabulary.encode(["" if k in own else t for k, t in enumerate(texts)])
        ends = np.cumsum(counts).tolist()
        rows = [own.get(k, ids[e - n : e]) for k, (e, n) in enumerate(zip(ends, counts.tolist(), strict=True))]
        return np.concatenate([np.asarray(r, np.int32) for r in rows]), np.array(list(map(len, rows)), np.int64)


_ENCODERS: dict[tuple[int, bool], LibraryEncoder] = {}


def library_encoder(tokenizer_json: str, special_as_text: bool = False) -> LibraryEncoder:
    key = zlib.crc32(tokenizer_json.encode()), special_as_text
    if key not in _ENCODERS:
        _ENCODERS[key] = LibraryEncoder(tokenizer_json, special_as_text)
    return _ENCODERS[key]


def packed(ids: np.ndarray, counts: np.ndarray, end_id: int, width: int) -> list[bytes]:
    """The ids of each text and the end id, as little-endian integers of ``width`` bytes."""
    ends = np.cumsum(counts) + np.arange(1, len(counts) + 1)
    out = np.empty(len(ids) + len(counts), "<u2" if width == 2 else "<u4")
    last = np.zeros(len(out), bool)
    last[ends - 1] = True
    out[last], out[~last] = end_id, ids
    data, places = out.tobytes(), (ends * width).tolist()
    return [data[a:b] for a, b in zip([0, *places], places, strict=False)]


def vocabulary_width(tokenizer_json: str, end_id: int) -> int:
    from tokenizers import Tokenizer

    return 2 if max(Tokenizer.from_str(tokenizer_json).get_vocab_size(with_added_tokens=True), end_id + 1) <= 1 << 16 else 4


def write_shards(docs: DataFrame, tokenizer_path: str, end_id: int, path: str | None = None, key: str = "doc_id", text: str = "text", n_shards: int | None = None, special_as_text: bool = False) -> DataFrame:
    """Encode every text, append ``end_id`` and write shard files in ascending key order.

    Rows are dealt by ranges of (key, hash of the text), so that repeated keys, even a third of all
    rows, spread over shards; repeated keys stand in that order. A null key comes first, a null text
    is empty. Each task streams its range into one file under a name of its own and then moves it in
    place, so that a task that runs again replaces what a lost one left. Other columns are ignored.
    Returns the manifest: shard, path, bytes, n_docs, n_ids, first_key, last_key.
    """
    spark = docs.sparkSession
    path = qualified(spark, path or work_path(spark, "sstable"))
    with open(tokenizer_path, encoding="utf-8") as f:
        model = f.read()  # a vocabulary file: a few MB, whatever the corpus
    width = vocabulary_width(model, end_id)
    shipped = spark.sparkContext.broadcast(model)
    n_shards = n_shards or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def write(batches):
        import os as _os

        from pyspark import TaskContext

        task = TaskContext.get()
        encoder = library_encoder(shipped.value, special_as_text)
        fs, folder = open_fs(path)
        fs.create_dir(folder, recursive=True)
        name = f"{folder}/shard-{task.partitionId():06d}.sst"
        own = f"{name}.{task.taskAttemptId()}.{_os.getpid()}.tmp"
        writer = sink = first = last = None
        for batch in batches:
            for a, b in text_slices(batch.column(1)):
                keys = batch.column(0).slice(a, b - a).to_pylist()
                values = packed(*encoder.encode([t or "" for t in batch.column(1).slice(a, b - a).to_pylist()]), end_id, width)
                if writer is None:
                    sink = fs.open_output_stream(own)
                    writer = ShardWriter(sink, width)
                    first = keys[0]
                for k, value in zip(keys, values, strict=True):
                    writer.put(pack_key(k), value)
                last = keys[-1]
        if writer is not None:
            writer.close()
            sink.close()
            fs.move(own, name)
            yield pa.RecordBatch.from_pydict({"shard": pa.array([task.partitionId()], pa.int32()), "path": [f"{path}/{name.rpartition('/')[2]}"], "bytes": pa.array([writer.at], pa.int64()), "n_docs": pa.array([writer.n_entries], pa.int64()), "n_ids": pa.array([writer.n_ids], pa.int64()), "first_key": pa.array([first], pa.int64()), "last_key": pa.array([last], pa.int64())})
        release()

    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"), F.xxhash64(text).alias("h"))
    ranged = rows.repartitionByRange(n_shards, "k", "h").sortWithinPartitions("k", "h").select("k", "t")
    return materialize(ranged.mapInArrow(write, "shard int, path string, bytes long, n_docs long, n_ids long, first_key long, last_key long"), "sstable-manifest")


def scan_shards(manifest: DataFrame) -> DataFrame:
    """Read shard files back, whole and in order: doc_id, start, n_tokens, ids_crc32, shard.

    ``start`` counts the ids of all documents before, over all shards. The running sum is over one
    row per shard; documents are read by one task per shard, a block at a time.
    """
    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                fs, name = open_fs(row["path"])
                with fs.open_input_file(name) as source:
                    reader, start = ShardReader(source, source.size()), row["start"]
                    out: dict[str, list] = {"doc_id": [], "start": [], "n_tokens": [], "ids_crc32": [], "shard": []}
                    for key, ids in reader:
                        for c, v in zip(out, (unpack_key(key), start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), row["shard"]), strict=True):
                            out[c].append(v)
                        start += len(ids)
                        if len(out["start"]) >= 4096:
                            yield _scan_batch(out)
                            out = {c: [] for c in out}
                    if start != row["start"] + reader.n_ids:
                        raise ValueError("a shard has lost ids")
                    if out["start"]:
                        yield _scan_batch(out)

    before = F.coalesce(F.sum("n_ids").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = manifest.select("shard", "path", before.cast("long").alias("start")).repartition(n)
    return placed.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, shard int")


def _scan_batch(out: dict[str, list]) -> pa.RecordBatch:
    kinds = {c: pa.int64() for c in out} | {"shard": pa.int32()}
    return pa.RecordBatch.from_pydict({c: pa.array(v, kinds[c]) for c, v in out.items()})


def lookup(manifest: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """Find documents by key: doc_id, tokens; a key that was written twice gives two rows.

    Wanted keys are dealt by ranges, so that a task meets few shards. Each task has the key range
    and path of every shard (one row per shard, not per document) and opens those it needs.
    """
    shards = [(r["first_key"], r["last_key"], r["path"]) for r in manifest.where("last_key is not null").orderBy("shard").collect()]

    def find(batches):
        ends = [x[1] for x in shards]
        place, reader, source = -1, None, None
        for batch in batches:
            hits: list[tuple[int, list[int]]] = []
            for k in batch.column(0).to_pylist():
                at = bisect_left(ends, k)
                while at < len(shards) and (shards[at][0] is None or shards[at][0] <= k):
                    if at != place:
                        if source is not None:
                            source.close()
                        fs, name = open_fs(shards[at][2])
                        source = fs.open_input_file(name)
                        place, reader = at, ShardReader(source, source.size())
                    hits += [(k, v.tolist()) for v in reader.get(pack_key(k))]
                    at += 1
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array([k for k, _ in hits], pa.int64()), "tokens": pa.array([v for _, v in hits], pa.list_(pa.int32()))})

    wanted = ids.select(F.col(key).cast("long").alias("k")).where("k is not null").distinct()
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return wanted.repartitionByRange(n, "k").sortWithinPartitions("k").mapInArrow(find, "doc_id long, tokens array<int>")
