"""op1 and op4 against the libraries themselves, and round trips."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest

from kegler.llm import bpe, queries, sstable
from kegler.llm.vocabulary import ChunkVocabulary, is_plain

ODD = [None, "", " ", "\n", "  ", "a", " a", "a ", "a  b", "a   b", "a \n b", "a\n\n\nb", "\ta\tb ", "it's we'll 12 three!!!", "x y  z　w", "naïve café ßtraße", "日本語 テキスト", "😀😀 👨‍👩‍👧", "a" * 3000, "  " * 500, "<|endoftext|> and more", "aaa aaaa aaaaa", "\x1c \x1d", "﻿bom", "é combining", "a\r\nb\r\n", "½ ² Ⅷ ٣"]


def random_texts(n=150, seed=3):
    rng = random.Random(seed)
    alphabet = list("abcdeZ  \n\n'st.,!09é  😀ß\t")
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def tik():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def hf():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def docs(spark, texts, ids=None):
    ids = ids or list(range(len(texts)))
    return spark.createDataFrame([(i, t, "x") for i, t in zip(ids, texts)], "doc_id long, text string, n_tokens string")


def test_merge_replay_is_the_library(spark, tik):
    texts = ODD + random_texts()
    got = {r["doc_id"]: r for r in bpe.encode_documents(docs(spark, texts), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()}
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        want = tik.encode_ordinary(t or "")
        assert got[k]["ids"] == want, t
        assert got[k]["n_tokens"] == len(want)
        assert got[k]["ids_sha256"] == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert got[k]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def test_op4_on_table(spark, sf, tik):
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = {r["doc_id"]: r for r in queries.op4_byte_bpe(spark, sf).collect()}
    assert len(got) == len(rows)
    for r in rows:
        ids = tik.encode_ordinary(r["text"] or "")
        assert got[r["doc_id"]]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_decode_round_trip(spark):
    texts = [t for t in ODD if t is not None]
    coded = bpe.encode_documents(docs(spark, texts), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    back = {r["doc_id"]: r["text"] for r in bpe.decode_documents(coded, P.path("byte_bpe_50k.tiktoken")).collect()}
    assert [back[k] for k in range(len(texts))] == texts


def test_chunk_store_starts_anew_without_change():
    seen = []

    def encode(chunks):
        seen.append(len(chunks))
        return np.array([ord(c) for x in chunks for c in x], np.int32), np.array([len(x) for x in chunks])

    small, large = ChunkVocabulary(encode, max_chunks=2), ChunkVocabulary(encode)
    for t in ["a b c", "c  d\n\ne", "a b", "f g h i"]:
        ids, counts = small.encode([t])
        assert "".join(map(chr, ids)) == t and counts.tolist() == [len(t)]
        assert ids.tolist() == large.encode([t])[0].tolist()
    assert not is_plain("a\tb") and not is_plain("a b") and is_plain("ä b\nc")


def brute_shards(texts, ids, hf):
    out, start = [], 0
    for i, t in sorted(zip(ids, texts)):
        own = hf.encode(t or "", add_special_tokens=False).ids + [2]
        out.append((i, start, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
        start += len(own)
    return out


def test_op1_on_table(spark, sf, hf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = brute_shards([r["text"] for r in rows], [r["doc_id"] for r in rows], hf)
    got = sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in queries.op1_sstable_shards(spark, sf).collect())
    assert got == want


def test_shards_with_odd_texts_and_lookup(spark, hf):
    texts = [t or "" for t in ODD + random_texts(60)]
    ids = [7 * k - 200 for k in range(len(texts))]
    manifest = sstable.write_shards(docs(spark, texts, ids), P.path("byte_bpe_50k.json"), 2, n_shards=3)
    got = sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in sstable.scan_shards(manifest).collect())
    assert got == brute_shards(texts, ids, hf)
    wanted = spark.createDataFrame([(i,) for i in [-200, -199, 0, 150, 3, 10**12, None]], "doc_id long")
    found = {r["doc_id"]: r["tokens"] for r in sstable.lookup(manifest, wanted).collect()}
    want = {i: hf.encode(t, add_special_tokens=False).ids + [2] for i, t in zip(ids, texts) if i in (-200, -199, 0, 150, 3)}
    assert found == want


def test_special_tokens_by_the_plain_call_or_as_text(hf):
    with open(P.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        model = f.read()
    texts = ["a <|endoftext|> b", "", "plain text", "<|endoftext|>", "<|endoftext|"]
    for as_text in (False, True):
        ids, counts = sstable.LibraryEncoder(model, as_text).encode(texts)
        hf.encode_special_tokens = as_text
        want = [hf.encode(t, add_special_tokens=False).ids for t in texts]
        hf.encode_special_tokens = False
        assert ids.tolist() == [i for w in want for i in w] and counts.tolist() == list(map(len, want))
        assert (50256 in ids) == (not as_text)


def test_shards_null_and_repeated_keys_and_empty(spark):
    rows = spark.createDataFrame([(None, "n"), (5, "a"), (5, "b"), (5, "a"), (-1, None)], "doc_id long, text string")
    manifest = sstable.write_shards(rows, P.path("byte_bpe_50k.json"), 2, n_shards=2)
    got = [(r["doc_id"], r["start"], r["n_tokens"]) for r in sstable.scan_shards(manifest).orderBy("start").collect()]
    assert got == [(None, 0, 2), (-1, 2, 1), (5, 3, 2), (5, 5, 2), (5, 7, 2)]
    assert sstable.lookup(manifest, rows.select("doc_id")).count() == 4
    empty = sstable.write_shards(rows.where("false"), P.path("byte_bpe_50k.json"), 2)
    assert sstable.scan_shards(empty).count() == 0


def test_block_format(tmp_path):
    path = tmp_path / "x.sst"
    with open(path, "wb") as f:
        w = sstable.ShardWriter(f, 4)
        for k in range(5000):
            w.add(sstable.pack_key(k * 3), np.arange(k % 40, dtype=np.int32))
        with pytest.raises(ValueError):
            w.add(sstable.pack_key(0), np.arange(1))
        w.close()
    with open(path, "rb") as f:
        r = sstable.ShardReader(f, path.stat().st_size)
        assert len(r.index) > 3 and r.n_entries == 5000
        assert [sstable.unpack_key(k) for k, _ in r] == [k * 3 for k in range(5000)]
        assert [len(v) for v in r.get(sstable.pack_key(3 * 777))] == [777 % 40]
        assert sum(bool(r.get(sstable.pack_key(3 * k + 1))) for k in range(2000)) == 0
        assert sum(r.bloom.may_hold(sstable.pack_key(3 * k + 1)) for k in range(2000)) < 100


def test_replay_of_repeated_letters_and_many_pieces(tik):
    """Runs of one letter, pairs that overlap, and batches in which a merge has many places."""
    replay = bpe.MergeReplay(bpe.load_ranks(P.path("byte_bpe_50k.tiktoken")))
    rng = random.Random(5)
    pieces = [b"a" * n for n in range(1, 60)] + [("-" * rng.randint(1, 40) + "=" * rng.randint(0, 9)).encode() for _ in range(200)]
    pieces += ["".join(rng.choice("aeinrst") for _ in range(rng.randint(1, 25))).encode() for _ in range(5000)]
    ids, counts = replay.encode(pieces)
    ends = np.cumsum(counts)
    for p, e, n in zip(pieces, ends.tolist(), counts.tolist(), strict=True):
        want = tik._core_bpe.encode_single_piece(p)
        assert ids[e - n : e].tolist() == want == replay.one(p)


def test_very_long_texts_in_one_batch(spark, tik, hf):
    """Long texts of different kinds beside short ones: ids by both libraries, and a look-up of them."""
    rng = random.Random(1)
    long = ["x" * 20_000, "ab " * 60_000, " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(40_000)), "é\n" * 30_000, "-=" * 3_000]
    texts = [t for k, one in enumerate(long) for t in (one, f"short {k}")]
    rows = docs(spark, texts).coalesce(1)
    got = {r["doc_id"]: r["ids"] for r in bpe.encode_documents(rows, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()}
    assert all(got[k] == tik.encode_ordinary(t) for k, t in enumerate(texts))
    found = {r["doc_id"]: r["tokens"] for r in sstable.lookup(sstable.write_shards(rows, P.path("byte_bpe_50k.json"), 2, n_shards=2), rows).collect()}
    assert all(found[k] == hf.encode(t, add_special_tokens=False).ids + [2] for k, t in enumerate(texts))


def test_store_keeps_the_frequent_chunks():
    seen = []

    def encode(chunks):
        seen.append(list(chunks))
        return np.array([ord(c) for x in chunks for c in x], np.int32), np.array([len(x) for x in chunks])

    store = ChunkVocabulary(encode, max_chunks=20)
    for k in range(40):
        text = "aa bb cc " + " ".join(f"n{k}x{j}" for j in range(5))
        ids, counts = store.encode([text, "", "aa"])
        assert "".join(map(chr, ids)) == text + "aa" and counts.tolist() == [len(text), 0, 2]
    assert sum(" bb" in chunks for chunks in seen) == 1 and store.size <= 30
