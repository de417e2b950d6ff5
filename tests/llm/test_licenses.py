import random

from kegler.llm import licenses as L
from kegler.llm import queries


def brute(t, templates, threshold):
    """Every window of every template at every place."""
    words = L.words_of((t or "").encode())
    found = []
    for name in sorted(templates):
        own = L.words_of(templates[name].encode())
        size = min(len(own), len(words))
        for b in range(len(words) - size + 1):
            d = L.dice(words[b : b + size], own)
            if size > 1 and d >= threshold:
                found.append((-d, b, name, b + size))
    kept, taken = [], set()
    for d, b, name, e in sorted(found):
        if not taken & set(range(b, e)):
            taken |= set(range(b, e))
            kept.append((name, b, e, -d))
    return sorted(kept, key=lambda x: x[1])


def rows_of(docs, templates=L.TEMPLATES):
    out = []
    for i, t in docs:
        found = brute(t, templates, L.THRESHOLD)
        best = min(found, key=lambda x: (-x[3], x[1], x[0]), default=None)
        out.append((i, len(found), ",".join(sorted({x[0] for x in found})), best and best[0], best and round(best[3], 6), ",".join(f"{n}:{b}:{e}" for n, b, e, _ in found)))
    return out


COLUMNS = ("doc_id", "n_matches", "licenses", "best", "dice", "matches")


def test_matches_brute_force(spark):
    rng = random.Random(6)
    fill = lambda n: " ".join(rng.choice(["the", "license", "under", "copy", "work", "word", "é", "licensed", "cc"]) for _ in range(n))
    docs = []
    for k, name in enumerate(sorted(L.TEMPLATES)):
        w = L.TEMPLATES[name].split()
        for _ in range(2):
            own = [x.upper() if rng.random() < 0.3 else x for x in w if rng.random() > 0.03]
            docs.append((len(docs), f"{fill(rng.randint(0, 20))}\n{' '.join(own)}\n{fill(rng.randint(0, 20))}"))
    both = L.TEMPLATES["MIT-line"] + " " + L.TEMPLATES["GPL-3.0-line"]
    docs += [(900, None), (901, ""), (902, "licensed"), (903, both), (904, both + " " + both), (905, "Licensed under the Apache License"), (906, "the " * 5000), (903, both)]
    got = [tuple(r[c] for c in COLUMNS) for r in L.scan_licenses(spark.createDataFrame(docs, "doc_id long, text string")).collect()]
    key = lambda r: (r[0], r[5])
    assert sorted(got, key=key) == sorted(rows_of(docs), key=key)
    by = {r[0]: r for r in got}
    assert by[903][2] == "GPL-3.0-line,MIT-line" and by[904][1] == 4 and by[902][1] == 0


def test_op6_on_table(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted(tuple(r[c] for c in COLUMNS) for r in queries.op6_license_scan(spark, sf).collect())
    # A coefficient needs so many of the template's bigrams: only templates that have them in the text are tried, in every window.
    pairs = {name: list(zip(w := L.words_of(t.encode()), w[1:], strict=False)) for name, t in L.TEMPLATES.items()}
    want = []
    for i, t in docs:
        words = L.words_of((t or "").encode())
        has = set(zip(words, words[1:], strict=False))
        near = {n: L.TEMPLATES[n] for n, own in pairs.items() if sum(x in has for x in own) >= L.THRESHOLD * len(own) / 2}
        want += rows_of([(i, t)], near)
    assert got == sorted(want, key=lambda r: r[0]) and any(r[1] for r in got) and len(got) == len(docs)


def test_columns_with_the_names_of_results(spark):
    line = L.TEMPLATES["MIT-line"]
    rows = spark.createDataFrame([(1, line, "x", 7, "y"), (1, line, "x", 7, "y"), (None, None, None, None, None)], "doc_id long, text string, licenses string, n_words int, best string")
    got = [(r["doc_id"], r["licenses"], r["n_words"]) for r in L.scan_licenses(rows).collect()]
    assert sorted(got, key=str) == sorted([(1, "MIT-line", len(L.words_of(line.encode())))] * 2 + [(None, "", 0)], key=str)


def test_empty(spark):
    rows = spark.createDataFrame([], "doc_id long, text string")
    assert L.scan_licenses(rows).collect() == []


# The lines that the generator plants, stated here rather than taken from the templates.
PLANTED = {
    "Released under the MIT License.": "MIT-line",
    "Licensed under the Apache License, Version 2.0.": "Apache-2.0-line",
    "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0-line",
    "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0-line",
    "All rights reserved.": "All-rights-reserved-line",
}


def test_op6_finds_planted_lines(spark, sf):
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        names = [PLANTED[line] for line in (r["text"] or "").split("\n") if line in PLANTED]
        want[r["doc_id"]] = (len(names), ",".join(sorted(set(names))))
    got = {r["doc_id"]: (r["n_matches"], r["licenses"]) for r in queries.op6_license_scan(spark, sf).collect()}
    assert got == want and {x for _, x in want.values()} >= {"All-rights-reserved-line"}


def test_variants_and_whole_texts():
    scanner = L.Scanner(L.TEMPLATES | L.WHOLE, L.THRESHOLD)
    names = lambda t: [x[0] for x in scanner.scan(L.words_of(t.encode()))]
    for text, name in (
        ("x (c) 2020 A. All rights reserved.", "All-rights-reserved-line"),
        ("Distributed under the MIT license, see there", "MIT-line-1"),
        ("available under the terms of the MIT License", "MIT-line-3"),
        ("code released under Apache 2.0 here", "Apache-2.0-line-5"),
        ("released under the GNU GPL v2 or so", "GPL-2.0-line-4"),
        ("licensed under the GNU General Public License, version 1", "GPL-line-1"),
        ("Available under CC BY-NC-SA 4.0.", "CC-BY-NC-SA-4.0-line-1"),
        ("under a Creative Commons Attribution-NoDerivatives 3.0 Unported License", "CC-BY-ND-3.0-line-4"),
        ("// SPDX-License-Identifier: GPL-2.0-or-later", "GPL-2.0-or-later-spdx"),
    ):
        assert names("word " * 5 + text + " word" * 5) == [name], text
    assert names("rights are reserved, all under license of the work") == []
    for name, text in L.WHOLE.items():
        assert names(f"some words before {text} and after") == [name]
    # A body with changed words and without its last tenth.
    words = L.WHOLE["GPL-2.0-text"].split()
    words[::300] = ["changed"] * len(words[::300])
    assert "GPL-2.0-text" in names(" ".join(words[: len(words) * 9 // 10]))
    bsd = L.WHOLE["BSD-3-Clause"].replace("copyright holder nor", "Foo Company nor")
    assert names(bsd)[:2] == ["BSD-conditions", "BSD-3-Clause-endorsement"]


def test_whole_texts_match_brute_force():
    own = {k: v for k, v in L.WHOLE.items() if k.startswith("BSD")} | {k: L.TEMPLATES[k] for k in ("BSD-conditions", "All-rights-reserved-line", "MIT", "MIT-line-1")}
    scanner, rng = L.Scanner(own, L.THRESHOLD), random.Random(3)
    for text in own.values():
        words = [w for w in text.split() if rng.random() > 0.02]
        t = "all rights reserved " + " ".join(words[: rng.randint(len(words) * 8 // 10, len(words))]) + " under the MIT License " * 2
        assert [(n, b, e, d) for n, d, b, e in scanner.scan(L.words_of(t.encode()))] == brute(t, own, L.THRESHOLD)
