import hashlib
import re

import corpus_pipeline
import test_decontaminate
import test_ngram_join
import test_pii
import test_quality


def test_pipeline_matches_brute_force(spark, sf):
    import base64

    import public_tokenizers as P
    import tiktoken

    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    docs = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in rows]
    verdict = test_quality.brute(docs)
    docs = [(i, t) for i, t, _, _ in docs if verdict[i][-1]]
    docs = [(i, t) for (i, t), (_, _, c) in zip(sorted(docs), test_ngram_join.brute(docs)) if i == c]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    docs = [(i, t) for (i, t), r in zip(docs, test_decontaminate.brute(docs, items)) if not r[-1]]
    # Masking stated anew: the stated patterns, and the secrets that the table has.
    def masked(t):
        names = ("EMAIL", "IP", "CARD", "PHONE", "SECRET")
        spans = test_pii.brute(t) + [(4, *m.span(1)) for m in re.finditer(r'token = "([0-9a-f]{40})"', t)]
        out, end = "", 0
        for a, b, k in sorted((a, b, k) for k, a, b in spans):
            if a >= end:
                out += t[end:a] + f"<{names[k]}>"
            end = max(end, b)
        return out + t[end:]

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    tik = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {}
    for i, t in docs:
        ids = tik.encode_ordinary(masked(t))
        want[i] = hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    got = {r["doc_id"]: r["ids_sha256"] for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == want and 0 < len(want) < len(rows)


def test_stages_on_odd_and_empty_tables(spark, sf):
    odd = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "a " * 60, "en", None, 120), (3, "x y z " * 5000, "en", "s", 30000), (4, " ".join(f"w{k}" for k in range(80)) + " a@b.com", "en", "s", 9), (4, " ".join(f"v{k}" for k in range(80)), "en", "s", 9)]
    for rows in (odd, []):
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, sf)
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
        assert [r["doc_id"] for r in out] == ([4, 4] if rows else [])
