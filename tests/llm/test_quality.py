import math
import random
import re
from collections import Counter, defaultdict

import numpy as np

from kegler.llm import quality, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(t):
    t = t or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    tri = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    covered = {k + j for k in range(len(w) - 2) if tri[tuple(w[k : k + 3])] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


# The method's numbers, stated anew: regularisation, and chi-square quantiles of four dimensions from tables.
FLOORS, KEPT, CUTOFF, CONSISTENCY = (0.1, 0.3, 0.6, 0.6), 0.75, 47.879456, 1.48636


def test_constants():
    """The cutoff leaves 1e-9 of a normal group out; the kept share's scatter is that much too small."""
    rng = np.random.default_rng(0)
    x = rng.standard_normal((400_000, 4))
    near = np.sort((x**2).sum(axis=1).argsort()[:300_000])
    assert abs(1 / x[near].var() - quality.CONSISTENCY) < 0.01 and abs(quality.CONSISTENCY - CONSISTENCY) < 1e-4
    assert abs(math.exp(-quality.CUTOFF / 2) * (1 + quality.CUTOFF / 2) - 1e-9) < 1e-12 and abs(quality.CUTOFF - CUTOFF) < 1e-3


def mcd(x):
    """Location and regularised scatter: the least determinant of what four starts come to."""
    h, floor = math.ceil(KEPT * len(x) - 1e-9), np.diag(np.square(FLOORS))
    coarse = np.floor(np.round(x * 10000) / 50) * 50 / 10000
    a, b, c = (np.sort(coarse, axis=0)[math.ceil(q * len(x)) - 1] for q in (0.25, 0.5, 0.75))
    spread, found = np.diag(((c - a) / 1.349) ** 2), []
    for m, s in ((b, spread * 0), (b, spread), (a, spread), (c, spread)):
        for _ in range(10):
            d = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(s + floor), x - m)
            bins = np.floor(np.log(1 + d) * 100)
            own = x[bins <= np.sort(bins)[h - 1]]
            m, s = own.mean(axis=0), np.cov(own.T, bias=True).reshape(4, 4) * CONSISTENCY
        found.append((np.linalg.det(s + floor), len(found), m, s + floor))
    return min(found, key=lambda f: f[:2])[2:]


def brute(docs):
    """docs: (id, text, lang, source). The same rules with numpy, group by group."""
    base, groups = {}, defaultdict(list)
    for i, t, lang, source in docs:
        n, c, s, d, r = counts(t)
        failed = n < 50 or 100 * r > 50 * n
        words, chars = max(n, 1), max(c, 1)
        x = [math.floor(v * 10000 + 0.5) / 10000 for v in (math.log(chars / words), *(math.log(1 + 100 * v / of) for v, of in ((s, chars), (r, words), (d, words))))]
        base[i] = (n, c, s, d, r, failed)
        if not failed:
            groups[lang, source].append((i, x))
    kept = dict.fromkeys(base, False)
    for rows in groups.values():
        x = np.array([v for _, v in rows], float)
        m, s = mcd(x)
        for (i, _), d in zip(rows, np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(s), x - m)):
            kept[i] = bool(d <= CUTOFF)
    return {i: (*b, kept[i]) for i, b in base.items()}


def test_repeated_lines_alone_can_reject(spark):
    """Each statistic can decide: here nothing but repeated short lines differs."""
    rng = random.Random(6)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    docs = [(k, "\n".join(prose(8) for _ in range(12)), "en", "s") for k in range(80)]
    docs.append((100, "\n".join([prose(60), *(["yes ok", "no ok"] * 120)]), "en", "s"))
    rows = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r for r in quality.quality(rows).collect()}
    assert all(got[k]["kept"] for k in range(80)) and not got[100]["kept"]


COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def test_op5_on_table(spark, sf):
    docs = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in queries.op5_quality_outliers(spark, sf).collect()}
    assert got == brute(docs)
    assert any(not r[-1] and not r[-2] for r in got.values())


def planted():
    rng = random.Random(2)
    vocab = ["alpha", "be", "gamma", "delta", "épsilon", "zz", "eta", "theta", "io", "ka", "lambda", "mu"]
    prose = lambda n: " ".join(rng.choice(vocab) + str(rng.randint(0, 30)) for _ in range(n))
    docs = [(k, prose(rng.randint(55, 200)), "en", "s0" if k % 3 else None) for k in range(120)]
    docs += [(200 + k, " ".join(w + "###" for w in prose(90).split()), "en", "s0") for k in range(5)]
    odd = [None, "", " \n\t ", "a", "a b c", "a b c a b c", "x x x x x", "a\n\na\n a\na", "z " * 4000, "a\x0bb\x0cc d", "😀 " * 60, prose(60) + "\n" + prose(5)]
    return docs + [(300 + k, t, None if k % 2 else "de", "s1") for k, t in enumerate(odd)]


def test_matches_brute_force(spark):
    docs = planted()
    rows = spark.createDataFrame([(*r, 5, "c") for r in docs], "doc_id long, text string, lang string, source string, n_words int, distance string")
    got = quality.quality(rows)
    assert {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in got.collect()} == brute(docs)
    kept = quality.keep_good(rows)
    want = {i for i, r in brute(docs).items() if r[-1]}
    assert kept.columns == rows.columns and {r["doc_id"] for r in kept.collect()} == want
    assert all(200 + k not in want for k in range(5)) and sum(i < 200 for i in want) == 120


def test_repeats_and_empty(spark):
    rows = spark.createDataFrame([(1, "w " * 5, "en", "s"), (1, "w " * 5, "en", "s")], "doc_id long, text string, lang string, source string")
    assert [r["n_repeat_words"] for r in quality.quality(rows).collect()] == [5, 5]
    assert quality.quality(rows.where("false")).collect() == [] and quality.keep_good(rows.where("false")).collect() == []
