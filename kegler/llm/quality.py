"""Quality rules: counts of whole texts, base limits, and robust multivariate outliers.

Statistics of a text become a vector of four transformed shares (mean word length, symbols, repeated
words, repeated lines). Per language and source, location and scatter of the vectors are estimated by
minimum covariance determinant, regularised by ``FLOORS``: from each of four starts, concentration
steps keep the share ``KEPT`` of the documents with the least Mahalanobis distance and estimate anew
from those, until nothing changes; of the starts, the one with the least determinant counts. A
document whose squared distance from it is beyond ``CUTOFF`` is rejected.

Vectors are fixed-point integers and quantiles come from counts per bin, so every sum is exact and
the verdict depends neither on the order of rows nor on partitions. All of it is aggregation with
partial sums on the map side: a source that has a third of all documents costs no more than many
small ones. Built-in DataFrame functions only.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kegler.llm.storage import Scratch, discard, materialize

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Fixed-point units in 1.0 of a transformed statistic.
UNIT = 10_000
#: Regularisation: standard deviations of each statistic, in units, whose squares are added to the variances. A
#: share that is the same for most documents of a group doesn't make outliers of all others.
FLOORS = (1000, 3000, 6000, 6000)
P = len(FLOORS)
#: Share of a group's documents that an estimate keeps, and concentration steps at most.
KEPT, STEPS = 0.75, 10
#: Share of the documents of a normal group that may lie beyond the cutoff.
TAIL = 1e-9
#: Bins of a squared distance: these many in each unit of its logarithm.
BINS = 100


def _tail(x: float, p: int) -> float:
    """The share of a chi-square distribution with an even number p of degrees of freedom beyond x."""
    return math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(p // 2))


def _quantile(share: float, p: int) -> float:
    """The value beyond which that share of a chi-square distribution lies."""
    low, high = 0.0, 1e4
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if _tail(middle, p) > share else (low, middle)
    return high


#: Squared distance from which on a document is rejected, and the factor by which the scatter of the kept share falls short.
CUTOFF = round(_quantile(TAIL, P), 6)
CONSISTENCY = round(KEPT / (1 - _tail(_quantile(1 - KEPT, P), P + 2)), 6)
#: Units in which quartiles are counted: starts need no more, and a group has at most some hundred counts.
COARSE = 50
#: Quartile ranges of a normal distribution in standard deviations.
QUARTILES = 1.349

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SPACE = r"[ \t\n\x0B\f\r]"


def text_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words to ``docs``.

    A null text counts as empty. Windows of three words are compared as they are; hashes only spare
    texts without a repeated window that comparison. Work and memory of a row are of the order of
    its text, times a logarithm.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(t, _SPACE + "+"), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^ \t\n\x0B\f\r]"))
    base = docs.withColumns({
        "_words": words,
        "_lines": lines,
        "word_chars": F.length(F.regexp_replace(t, _SPACE + "+", "")).cast("long"),
        "n_symbols": (F.length(t) - F.length(F.regexp_replace(t, r"[#*$%&|<>]+", ""))).cast("long"),
    })
    at = F.sequence(F.lit(0), F.size("_words") - 3)
    own = lambda i: [F.get(F.col("_words"), i + k) for k in range(3)]
    hashed = F.when(F.size("_words") >= 3, F.transform(at, lambda i: F.xxhash64(*own(i)))).otherwise(F.array().cast("array<long>"))
    base = base.withColumns({
        "n_words": F.size("_words").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_hashed": hashed,
    })
    ordered = F.array_sort(F.transform(at, lambda i: F.struct(F.concat_ws(" ", *own(i)).alias("w"), i.alias("i"))))
    differ = F.size("_hashed") == F.size(F.array_distinct("_hashed"))
    base = base.withColumn("_ordered", F.when(~differ, ordered)).drop("_hashed", "_words", "_lines")
    same = lambda x, k: F.coalesce(F.get(F.col("_ordered"), k)["w"] == x["w"], F.lit(False))
    found = F.transform(F.filter("_ordered", lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"])
    base = base.withColumn("_found", F.when(F.col("_ordered").isNotNull(), F.array_sort(found))).drop("_ordered")
    # A window covers three words, or as many as there are to the next one.
    covered = F.aggregate("_found", F.struct(F.lit(0).alias("n"), F.lit(-3).alias("end")), lambda s, i: F.struct((s["n"] + F.least(F.lit(3), i + 3 - s["end"])).alias("n"), (i + 3).alias("end")), lambda s: s["n"])
    own = [F.col(f"`{c}`") for c in docs.columns]
    counted = F.struct(*COUNTS[:-1], F.coalesce(covered, F.lit(0)).cast("long").alias(COUNTS[-1]))
    # A generator is where the optimizer stops moving filters down: moved into the lambdas above, a
    # filter would count the text anew for each of its words.
    return base.select(*own, F.inline(F.array(counted)))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def _vector() -> list[Column]:
    n, c = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    share = lambda x, of: F.log(1.0 + 100.0 * x / of)
    stats = [F.log(c / n), share(F.col("n_symbols"), c), share(F.col("n_repeat_words"), n), share(F.col("n_dup_lines"), n)]
    return [F.floor(x * UNIT + 0.5).cast("long") for x in stats]


_X = tuple(f"x{k + 1}" for k in range(P))
_GROUP = ("g_lang", "g_source")
_PAIRS = [(a, b) for a in range(1, P + 1) for b in range(a, P + 1)]
_MOMENTS = ("n", *(f"t{k}" for k in range(1, P + 1)), *(f"t{a}{b}" for a, b in _PAIRS))


def _factored(groups: DataFrame) -> DataFrame:
    """Add the factors d and l of the regularised scatter, L D L', so that distances need no inverse, and ``det``.
    Later columns name earlier ones of the same select."""
    out = []
    for k in range(1, P + 1):
        # What the coordinates before leave of column k.
        out.append(f"s{k}{k} + {(FLOORS[k - 1] / UNIT) ** 2!r}D" + "".join(f" - l{k}{j} * l{k}{j} * d{j}" for j in range(1, k)) + f" AS d{k}")
        out += [f"(s{k}{i}" + "".join(f" - l{k}{j} * l{i}{j} * d{j}" for j in range(1, k)) + f") / d{k} AS l{i}{k}" for i in range(k + 1, P + 1)]
    return groups.selectExpr("*", *out, " * ".join(f"d{k}" for k in range(1, P + 1)) + " AS det")


def _distance(rows: DataFrame) -> DataFrame:
    """Add ``distance``, the squared Mahalanobis distance from m, by forward substitution."""
    y = [f"(x{k} - m{k}) / {float(UNIT)!r}D" + "".join(f" - l{k}{j} * y{j}" for j in range(1, k)) + f" AS y{k}" for k in range(1, P + 1)]
    return rows.selectExpr("*", *y, " + ".join(f"y{k} * y{k} / d{k}" for k in range(1, P + 1)) + " AS distance").drop(*[f"y{k}" for k in range(1, P + 1)])


def _join(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows with their group's values. Groups are as many as languages times sources: Spark decides
    by their size whether to broadcast them, and splits a hot group if it doesn't."""
    named = groups.withColumnsRenamed({g: f"_{g}" for g in _GROUP})
    on = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in _GROUP])
    return rows.join(named, on, "left").drop(*[f"_{g}" for g in _GROUP])


def _starts(rows: DataFrame) -> DataFrame:
    """Four starts of each group: the median with no scatter but the floors; the median, the lower and the
    upper quartiles with the scatter that the quartile ranges tell."""
    long = rows.select(*_GROUP, F.explode(F.array(*[F.struct(F.lit(k).alias("k"), (F.floor(F.col(x) / COARSE) * COARSE).alias("v")) for k, x in enumerate(_X, 1)])).alias("e")).select(*_GROUP, "e.k", "e.v")
    counts = long.groupBy(*_GROUP, "k", "v").agg(F.count("*").alias("n"))
    by = W.partitionBy(*_GROUP, "k")
    upto = counts.withColumn("upto", F.sum("n").over(by.orderBy("v"))).withColumn("total", F.sum("n").over(by))
    cut = lambda share: F.min(F.when(F.col("upto") >= share * F.col("total"), F.col("v"))).cast("double")
    cuts = upto.groupBy(*_GROUP, "k").agg(cut(0.25).alias("a"), cut(0.5).alias("b"), cut(0.75).alias("c"))
    wide = cuts.groupBy(*_GROUP).agg(*[F.max(F.when(F.col("k") == k, F.col(q))).alias(f"{q}{k}") for k in range(1, P + 1) for q in "abc"])
    starts = []
    for number, (q, spread) in enumerate((("b", False), ("b", True), ("a", True), ("c", True))):
        own = [F.lit(number).alias("start")] + [F.col(f"{q}{k}").alias(f"m{k}") for k in range(1, P + 1)]
        for a, b in _PAIRS:
            sd = (F.col(f"c{a}") - F.col(f"a{a}")) / (UNIT * QUARTILES)
            own.append((sd * sd if spread and a == b else F.lit(0.0)).alias(f"s{a}{b}"))
        starts.append(F.struct(*own))
    return wide.select(*_GROUP, F.explode(F.array(*starts)).alias("e")).select(*_GROUP, "e.*")


def _step(rows: DataFrame, now: DataFrame) -> DataFrame:
    """One concentration step of every start of every group: the moments of the nearest ``KEPT``.

    The rows are read once: they are summed by bin of their distance, and the bins up to the cut added up."""
    near = _distance(_join(rows, _factored(now))).withColumn("v", F.floor(F.log(1.0 + F.col("distance")) * BINS).cast("long"))
    sums = [F.count("*").alias("n")] + [F.sum(x).alias(f"t{k}") for k, x in enumerate(_X, 1)]
    sums += [F.sum((F.col(_X[a - 1]) * F.col(_X[b - 1])).cast("decimal(12,0)")).alias(f"t{a}{b}") for a, b in _PAIRS]
    bins = near.groupBy(*_GROUP, "start", "v").agg(*sums)
    by = W.partitionBy(*_GROUP, "start")
    placed = bins.withColumn("upto", F.sum("n").over(by.orderBy("v"))).withColumn("total", F.sum("n").over(by))
    kept = placed.where(F.col("upto") - F.col("n") < KEPT * F.col("total")).groupBy(*_GROUP, "start").agg(*[F.sum(c).alias(c) for c in _MOMENTS])
    n = F.col("n").cast("double")
    whole = lambda c, digits: F.col(c).cast(f"decimal({digits},0)")
    out = [F.col(c) for c in (*_GROUP, "start")] + [(F.col(f"t{k}").cast("double") / n).alias(f"m{k}") for k in range(1, P + 1)]
    for a, b in _PAIRS:
        # n * sum(xy) - sum(x) * sum(y) is exact in decimals.
        exact = whole("n", 13) * whole(f"t{a}{b}", 22) - whole(f"t{a}", 18) * whole(f"t{b}", 18)
        out.append((exact.cast("double") / (n * n) / float(UNIT * UNIT) * CONSISTENCY).alias(f"s{a}{b}"))
    return kept.select(*out)


def estimates(rows: DataFrame) -> DataFrame:
    """Location m1.. and factors of the scatter of each group, by concentration from four starts."""
    scratch = Scratch()
    now, state = scratch(_starts(rows), "mcd-start"), None
    for step in range(STEPS):
        now = scratch(_step(rows, now), f"mcd-step{step}")
        told = now.agg(F.sum(F.xxhash64(*now.columns).cast("decimal(20,0)"))).first()
        if told == state:
            break
        state = told
    factored = _factored(now)
    own = [c for c in factored.columns if c not in (*_GROUP, "det", "start")]
    best = factored.groupBy(*_GROUP).agg(F.min(F.struct("det", "start", *own)).alias("e"))
    out = materialize(best.select(*_GROUP, *[F.col(f"e.{c}") for c in own]), "mcd-best")
    scratch.drop()
    return out


def quality(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Counts and verdict of every document: key, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, distance (squared; null where the base rules fail), kept.

    Estimates come from the documents that pass the base rules, grouped by language and source; a
    null language or source is a group like any other. A document alone in its group is its own
    estimate and is kept. Rows repeat as they come, an empty table stays empty.
    """
    narrow = docs.select(F.col(key).alias("key"), F.col(lang).alias("g_lang"), F.col(source).alias("g_source"), F.col(text).alias("text"))
    counted = text_counts(narrow, "text").drop("text").withColumn("base_failed", base_failed())
    stats = materialize(counted.withColumns(dict(zip(_X, _vector(), strict=True))), "quality-stats")
    now = estimates(stats.where("not base_failed").select(*_GROUP, *_X))
    judged = _distance(_join(stats, now)).withColumn("distance", F.when(~F.col("base_failed"), F.col("distance")))
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= CUTOFF, F.lit(False))
    return judged.select(F.col("key").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", kept.alias("kept"))


def keep_good(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The documents that ``quality`` keeps, with all their columns; the texts are not shuffled.

    The estimates are few rows and meet the documents in a second pass over the texts.
    """
    names = docs.columns
    narrow = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(lang).alias("g_lang"), F.col(source).alias("g_source"), F.col(text).alias("text"))
    counted = text_counts(narrow, "text").drop("text").withColumn("base_failed", base_failed())
    counted = counted.withColumns(dict(zip(_X, _vector(), strict=True)))
    stats = materialize(counted.where("not base_failed").select(*_GROUP, *_X), "quality-stats")
    now = estimates(stats)
    discard(stats)
    judged = _distance(_join(counted.where("not base_failed").select("row", *_GROUP, *_X), now))
    return judged.where(F.col("distance") <= CUTOFF).select("row.*")
