"""Byte-level BPE encoding and decoding by merge replay over the vocabulary of a slice of texts.

The distinct pieces of a block of texts form its vocabulary. Their bytes lie in one array with
links to the neighbours, and an inverted index leads from each merge, told by the token that a pair
of adjacent tokens makes, to the positions where it can be done. Merges are replayed in rank order
over that vocabulary: a merge visits just the positions of its pairs and updates the two neighbours
of each, whose new pairs join the index. A piece's merges depend on that piece alone, so blocks can be replayed apart, and each
worker keeps the ids of chunks that it has seen (see ``vocabulary``).
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kegler.llm.vocabulary import ChunkVocabulary, release, text_slices


def load_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file in order of rank; a token's rank is its id."""
    return parse_ranks(open(path, "rb").read())


def parse_ranks(data: bytes) -> list[bytes]:
    found = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, data.splitlines()) if token}
    if sorted(found) != list(range(len(found))):
        raise ValueError("ranks must be gapless from 0")
    return [found[i] for i in range(len(found))]


class MergeReplay:
    """Replays the merges of a rank file over a set of pieces."""

    #: Places of a merge up to which they are taken one by one.
    FEW = 32

    def __init__(self, tokens: list[bytes]):
        self.rank = {t: i for i, t in enumerate(tokens)}
        if len(self.rank) != len(tokens):
            raise ValueError("tokens must differ")
        self.of_byte = np.array([self.rank[bytes([b])] for b in range(256)], np.int32)
        # Every pair of tokens that makes a token: as many as there are ways to cut the tokens in two.
        get = self.rank.get
        pairs = {a << 32 | b: r for t, r in self.rank.items() for k in range(1, len(t)) if (a := get(t[:k])) is not None and (b := get(t[k:])) is not None}
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.made = np.array([pairs[k] for k in self.keys.tolist()], np.int32)

    def _makes(self, a, b) -> np.ndarray:
        """Ranks of the tokens that pairs make, -1 where they make none. a or b may be one number."""
        key = np.asarray(a, np.int64) << 32 | np.asarray(b, np.int64)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.made[at], -1) if len(self.keys) else np.full(key.shape, -1, np.int32)

    def one(self, piece: bytes) -> list[int]:
        """The ids of a piece by merging its leftmost pair of least rank again and again."""
        if piece in self.rank:
            return [self.rank[piece]]
        token = self.of_byte[np.frombuffer(piece, np.uint8)].tolist()
        while True:
            least = min(((r, k) for k in range(len(token) - 1) if (r := self.pairs.get(token[k] << 32 | token[k + 1])) is not None), default=None)
            if least is None:
                return token
            token[least[1] : least[1] + 2] = [least[0]]

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces in a row, number of ids of each). No piece is empty.

        Pieces that are tokens themselves need no merge. A merge with many places visits all of them at
        once. Where a new pair would come before the merge at hand, which a vocabulary learnt by
        merging hardly ever has, the order within the piece decides, and it is done apart.
        """
        whole = np.fromiter((self.rank.get(p, -1) for p in pieces), np.int32, len(pieces))
        open_ = np.flatnonzero(whole < 0)
        if not len(open_):
            return whole, np.ones(len(whole), np.int64)
        data = b"".join([pieces[k] for k in open_.tolist()])
        n = len(data)
        ends = np.cumsum([len(pieces[k]) for k in open_.tolist()])
        # Arrays that can be read one by one and all at once; place n stands for none.
        own = [array("i", bytes(4 * (n + 1))) for _ in range(4)]
        token, right, left, pend = own
        tokens, rights, lefts, pends = (np.frombuffer(x, np.int32) for x in own)
        tokens[:n], tokens[n] = self.of_byte[np.frombuffer(data, np.uint8)], -1
        rights[:n], rights[n], rights[ends - 1] = np.arange(1, n + 1), n, n
        lefts[1:n], lefts[0], lefts[n], lefts[ends[:-1]] = np.arange(n - 1), n, n, n
        # pend: the rank of the token that a place makes with its right neighbour.
        pends[: n - 1], pends[n - 1 :] = self._makes(tokens[: n - 1], tokens[1:n]), -1
        pends[ends - 1] = -1
        index: dict[int, list[int]] = {}
        queue: list[int] = []

        def enter(places: np.ndarray, ranks: np.ndarray) -> None:
            order = np.argsort(ranks, kind="stable")
            places, ranks = places[order], ranks[order]
            first = np.flatnonzero(np.diff(ranks, prepend=-1))
            flat = places.tolist()
            for r, a, b in zip(ranks[first].tolist(), first.tolist(), [*first[1:].tolist(), len(flat)], strict=True):
                there = index.get(r)
                if there is None:
                    index[r] = flat[a:b]
                    heapq.heappush(queue, r)
                else:
                    there += flat[a:b]

        at = np.flatnonzero(pends >= 0)
        if len(at):
            enter(at, pends[at])
        early: list[int] = []
        get = self.pairs.get
        while queue:
            rank = heapq.heappop(queue)
            some = index.pop(rank)
            if len(some) > self.FEW:
                places = np.unique(np.array(some, np.int32))
                places = places[pends[places] == rank]
                nxt = rights[places]
                after, before = rights[nxt], lefts[places]
                if not ((nxt[:-1] == places[1:]) | (after[:-1] == places[1:])).any():
                    tokens[places], tokens[nxt], pends[nxt] = rank, -1, -1
                    rights[places], lefts[after] = after, places
                    ahead = np.where(after < n, self._makes(rank, tokens[after]), -1)
                    behind = np.where(before < n, self._makes(tokens[before], rank), -1)
                    pends[places], pends[before] = ahead, behind
                    pends[n] = -1
                    places, ranks = np.concatenate([places[ahead >= 0], before[behind >= 0]]), np.concatenate([ahead[ahead >= 0], behind[behind >= 0]])
                    if len(ranks):
                        if ranks.min() < rank:
                            early += places[ranks < rank].tolist()
                        enter(places, ranks)
                    continue
                some = places.tolist()
            else:
                some.sort()
            for at in some:
                if pend[at] != rank:
                    continue  # a merge beside it has changed the pair
                nxt = right[at]
                after, before = right[nxt], left[at]
                token[at], token[nxt], pend[nxt], right[at], pend[at] = rank, -1, -1, after, -1
                if after < n:
                    left[after] = at
                    new = get(rank << 32 | token[after])
                    if new is not None:
                        pend[at] = new
                        if new in index:
                            index[new].append(at)
                        else:
                            index[new] = [at]
                            heapq.heappush(queue, new)
                        if new < rank:
                            early.append(at)
                if before < n:
                    new = get(token[before] << 32 | rank)
                    pend[before] = -1 if new is None else new
                    if new is not None:
                        if new in index:
                            index[new].append(before)
                        else:
                            index[new] = [before]
                            heapq.heappush(queue, new)
                        if new < rank:
                            early.append(before)
        left_over = tokens[:n] >= 0
        counts = np.ones(len(pieces), np.int64)
        counts[open_] = np.add.reduceat(left_over, np.concatenate([[0], ends[:-1]]), dtype=np.int64)
        redone = {int(open_[k]): None for k in np.unique(np.searchsorted(ends, early, "right")).tolist()}
        merged = tokens[:n][left_over]
        if not redone:
            ids = np.empty(counts.sum(), np.int32)
            mine = np.repeat(whole < 0, counts)
            ids[mine], ids[~mine] = merged, whole[whole >= 0]
            return ids, counts
        rows, at = [], 0
        for k, (r, c) in enumerate(zip(whole.tolist(), counts.tolist(), strict=True)):
            row = [r] if r >= 0 else merged[at : at + c].tolist()
            at += c if r < 0 else 0
            rows.append(self.one(pieces[k]) if k in redone else row)
        return np.array([t for row in rows for t in row], np.int32), np.array(list(map(len, rows)), np.int64)


class Codec:
    """Encodes and decodes whole texts by a rank file and the pattern that cuts texts into pieces."""

    #: Bytes of pieces that are replayed at once.
    REPLAY_BYTES = 4 << 20

    def __init__(self, tokens: list[bytes], pattern: str, max_chunks: int = 200_000):
        import regex

        self.pattern, self.replay = regex.compile(pattern), MergeReplay(tokens)
        self.vocabulary = ChunkVocabulary(self._chunks, max_chunks)
        self.decimals = list(map(str, range(len(tokens))))
        self.lens = np.array([len(t) for t in tokens], np.int64)
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.begins = np.cumsum(self.lens) - self.lens

    def _chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct chunks: the distinct pieces of all of them are replayed together."""
        find = self.pattern.findall
        number: dict[str, int] = {}
        places, sizes = array("i"), array("i")
        for c in chunks:
            # Latin letters after a blank or none are one piece.
            bare = c[1:] if c[0] == " " else c
            cut = (c,) if bare.isalpha() and max(bare) < "\u0250" else find(c)
            sizes.append(len(cut))
            for p in cut:
                places.append(number.setdefault(p, len(number)))
        ids, counts = [np.empty(0, np.int32)], [np.empty(0, np.int64)]
        some, size = [], 0
        for p in number:
            some.append(p.encode())
            size += len(some[-1])
            if size > self.REPLAY_BYTES:
                got = self.replay.encode(some)
                ids.append(got[0])
                counts.append(got[1])
                some, size = [], 0
        if some:
            got = self.replay.encode(some)
            ids.append(got[0])
            counts.append(got[1])
        flat, lens = np.concatenate(ids), np.concatenate(counts)
        begins = np.cumsum(lens) - lens
        place = np.frombuffer(places, np.int32)
        own = lens[place]
        upto = np.concatenate([[0], np.cumsum(own)])
        out = flat[np.arange(upto[-1]) + np.repeat(begins[place] - upto[:-1], own)]
        edges = np.concatenate([[0], np.cumsum(np.frombuffer(sizes, np.int32))])
        return out, np.diff(upto[edges])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self.vocabulary.encode(texts)

    def digest(self, ids: np.ndarray) -> str:
        """SHA-256 of the decimal ids, joined by one blank."""
        return hashlib.sha256(" ".join(map(self.decimals.__getitem__, ids.tolist())).encode()).hexdigest()

    def decode(self, ids: np.ndarray) -> bytes:
        lens = self.lens[ids]
        ends = np.cumsum(lens)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.arange(total) + np.repeat(self.begins[ids] - (ends - lens), lens)].tobytes()


_CODECS: dict[tuple[int, str], Codec] = {}


def codec(data: bytes, pattern: str) -> Codec:
    key = zlib.crc32(data), pattern
    if key not in _CODECS:
        _CODECS[key] = Codec(parse_ranks(data), pattern)
    return _CODECS[key]


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text", digests_only: bool = False) -> DataFrame:
    """Ids of every whole text and the text decoded from them again.

    Returns key, n_tokens, ids (array, left out with ``digests_only``), ids_sha256 (of the decimal
    ids joined by one blank) and decoded_sha256 (of the decoded bytes). A null text is empty and has
    no ids; rows repeat as they come; no row leaves its partition, so nothing is shuffled and a
    lost task runs again alone. The rank file is a few MB, whatever the corpus, and is broadcast.
    """
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast(open(ranks_path, "rb").read())

    def run(batches):
        own = codec(shipped.value, pattern)
        for batch in batches:
            for a, b in text_slices(batch.column(1)):
                ids, counts = own.encode([t or "" for t in batch.column(1).slice(a, b - a).to_pylist()])
                ends = np.cumsum(counts).tolist()
                rows = [ids[e - n : e] for e, n in zip(ends, counts.tolist(), strict=True)]
                out = {
                    key: batch.column(0).slice(a, b - a),
                    "n_tokens": pa.array(counts, pa.int64()),
                    "ids": pa.ListArray.from_arrays(pa.array([0, *ends], pa.int32()), pa.array(ids, pa.int32())),
                    "ids_sha256": pa.array(list(map(own.digest, rows))),
                    "decoded_sha256": pa.array([hashlib.sha256(own.decode(r)).hexdigest() for r in rows]),
                }
                if digests_only:
                    del out["ids"]
                yield pa.RecordBatch.from_pydict(out)
        del own
        release()

    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_tokens long, " + ("" if digests_only else "ids array<int>, ") + "ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col(key), F.col(text)).mapInArrow(run, schema)


def decode_documents(rows: DataFrame, ranks_path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """The text of every list of ids: key, text. Bytes that are not UTF-8 become U+FFFD; null stays null."""
    spark = rows.sparkSession
    shipped = spark.sparkContext.broadcast(open(ranks_path, "rb").read())

    def run(batches):
        tokens = parse_ranks(shipped.value)
        for batch in batches:
            texts = [None if r is None else b"".join(map(tokens.__getitem__, r)).decode("utf-8", "replace") for r in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({key: batch.column(0), "text": pa.array(texts, pa.string())})

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(F.col(key), F.col(ids)).mapInArrow(run, f"`{key}` {kind}, text string")
