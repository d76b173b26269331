"""Quality rules on robust multivariate outliers: minimum covariance determinant per language and source. Column functions only."""

from __future__ import annotations

from math import exp, lgamma, log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, Scratch

#: Transformed statistics, and the standard deviation that is added to each: what a group's spread is never taken to be below, so
#: that each statistic can reject by itself (repeats and duplicate lines from a share of about 7 percent, where a group has none).
DIMS = ("z_words", "z_length", "z_symbols", "z_lines", "z_repeats")
FLOOR = (0.35, 0.06, 0.03, 0.06, 0.06)
P = len(DIMS)
STEPS = 5
#: Share of a group's rows that the estimate stands on, and the chi-square probability beyond which a row is rejected.
SHARE, TAIL = 0.75, 1e-3
#: A group with fewer rows has no estimate of its own: its rows are judged by that of all rows of their language, or of the table.
MIN_ROWS = 60
#: Ways to begin: the medians with median deviations alone, with correlations of spatial signs, and of hyperbolic tangents.
STARTS = ("spread", "signs", "tanh")
#: Bins of squared distance for each doubling.
BINS = 16


def chi2_cdf(x: float, k: int) -> float:
    """Regularised lower incomplete gamma function by its series."""
    if x <= 0:
        return 0.0
    a, h = k / 2, x / 2
    term = total = 1 / a
    n = a
    while term > total * 1e-15:
        n += 1
        term *= h / n
        total += term
    return total * exp(-h + a * log(h) - lgamma(a))


def chi2_quantile(q: float, k: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, k) < q else (lo, mid)
    return (lo + hi) / 2


CUT = chi2_quantile(1 - TAIL, P)


def shrunk(share: float) -> float:
    """The covariance of the innermost share of a normal distribution is smaller by this factor."""
    return chi2_cdf(chi2_quantile(share, P), P + 2) / share if share < 1 else 1.0


#: By the percentage of rows that were taken.
SHRUNK = [shrunk(max(k, 1) / 100) for k in range(101)]


def let(value: Column, then) -> Column:
    """then(value), with the value computed once though `then` uses it in a nested lambda."""
    return F.element_at(F.transform(F.array(value), then), 1)


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of every whole text; no shuffle."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), text.alias("text"))
    bare = F.regexp_replace("text", f"^{SPACE}|{SPACE}$", "")
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = d.select("doc_id", "lang", "source", words.alias("words"), lines.alias("lines"),
                 F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"))
    n = F.size("words")
    # Each word is hashed once; windows of two, four and eight words by the hashes of their halves.
    both = lambda h, k: let(h, lambda x: F.zip_with(F.slice(x, 1, F.size(x) - k), F.slice(x, k + 1, F.size(x) - k), lambda a, b: F.xxhash64(a, b)))
    hashes = F.when(n > 8, both(both(both(F.transform("words", lambda w: F.xxhash64(w)), 1), 2), 4)).otherwise(F.array().cast("array<bigint>"))
    d = d.select("doc_id", "lang", "source", "n_symbols", n.cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
                 F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), hashes.alias("hashes"))

    def repeated(h: Column) -> Column:
        """Words under windows whose hash occurs twice: places of such windows by sorting, then the union of their spans."""
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        size = F.size(h)
        twice = let(pairs, lambda s: F.filter(s, lambda e, k: ((k > 0) & (F.get(s, k - 1)["x"] == e["x"])) | ((k < size - 1) & (F.get(s, k + 1)["x"] == e["x"]))))
        places = F.array_sort(F.transform(twice, lambda e: e["i"]))
        zero = F.struct(F.lit(0).alias("sum"), F.lit(-8).alias("last"))
        return F.aggregate(places, zero, lambda acc, i: F.struct((acc["sum"] + F.least(F.lit(8), i - acc["last"])).alias("sum"), i.alias("last")), lambda acc: acc["sum"].cast("long"))

    some = F.size(F.array_distinct("hashes")) < F.size("hashes")
    n_repeat = F.when(some, let(F.col("hashes"), repeated)).otherwise(F.lit(0).cast("long"))
    return d.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", n_repeat.alias("n_repeat_words"))


def transformed(stats: DataFrame) -> DataFrame:
    """Adds base_failed and the vector. Logarithms of sizes and roots of ratios make the bulk of a group about normal."""
    failed = (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    words, chars, lines = (F.greatest(F.col(c), F.lit(1)).cast("double") for c in ("n_words", "word_chars", "n_lines"))
    z = (F.log1p("n_words"), F.log((F.col("word_chars") + 1) / words), F.sqrt(F.col("n_symbols") / chars), F.sqrt(F.col("n_dup_lines") / lines), F.sqrt(F.col("n_repeat_words") / words))
    return stats.withColumn("base_failed", failed).withColumns(dict(zip(DIMS, z)))


def _same(df: DataFrame, other: DataFrame, keys: tuple[str, ...], how: str = "inner") -> DataFrame:
    """Join on keys of which nulls are equal."""
    right = other.select(*(F.col(k).alias(f"r_{k}") for k in keys), *(c for c in other.columns if c not in keys))
    on = [F.col(k).eqNullSafe(F.col(f"r_{k}")) for k in keys]
    return df.join(right, on, how).drop(*(f"r_{k}" for k in keys))


def grouped(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows with g, whose estimate judges them: their language and source, or if that has under MIN_ROWS rows their language, or the
    table; and the rows with each g whose estimate they are part of. A pool has all rows of its language or of the table, those
    of large groups too; only pools that some row is judged by are made."""
    name = lambda *c: F.to_json(F.struct(*c), {"ignoreNullFields": "false"})
    sizes = rows.groupBy("lang", "source").agg(F.sum((~F.col("base_failed")).cast("long")).alias("n"))
    small = F.col("n") < MIN_ROWS
    by_lang = sizes.groupBy("lang").agg(F.sum("n").alias("n_lang"), F.max(small).alias("some"))
    few = F.col("n_lang") < MIN_ROWS
    whole = by_lang.agg(F.coalesce(F.max(few), F.lit(False)).alias("rest"))  # one row
    g = F.when(~small, name("lang", "source")).when(~few, name("lang")).otherwise("all")
    part = F.array_compact(F.array(F.when(~small, name("lang", "source")), F.when(F.col("some") & ~few, name("lang")), F.when(F.col("rest"), F.lit("all"))))
    keys = _same(sizes, by_lang, ("lang",)).crossJoin(F.broadcast(whole)).select("lang", "source", g.alias("g"), part.alias("part"))
    named = _same(rows, keys, ("lang", "source"))
    return named.drop("part"), named.filter("not base_failed").select(F.explode("part").alias("g"), *DIMS)


def solved(est: DataFrame) -> DataFrame:
    """From g, start, n, m and cov (a lower triangle) to g, start, n, m, w, the inverse of the Cholesky factor of cov with its floor, and
    spread, the logarithm of the factor's determinant.

    One small column at a time: an expression over the whole matrix would repeat its parts over and over."""
    d, at = est, lambda i, j: i * (i + 1) // 2 + j
    for j in range(P):
        rest = {i: sum((-F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.get("cov", F.lit(at(i, j))) + (FLOOR[i] ** 2 if i == j else 0.0)) for i in range(j, P)}
        d = d.withColumn(f"l{j}{j}", F.sqrt(F.greatest(rest.pop(j), F.lit(1e-12))))
        d = d.withColumns({f"l{i}{j}": x / F.col(f"l{j}{j}") for i, x in rest.items()}) if rest else d
    for i in range(P):
        below = lambda j: sum((-F.col(f"l{i}{k}") * F.col(f"w{k}{j}") for k in range(j, i)), F.lit(0.0))  # noqa: E731, B023
        d = d.withColumns({f"w{i}{j}": (F.lit(1.0) if i == j else below(j)) / F.col(f"l{i}{i}") for j in range(i + 1)})
    w = F.array(*(F.col(f"w{i}{j}") for i in range(P) for j in range(i + 1)))
    return d.select("g", "start", "n", "m", w.alias("w"), sum((F.log(F.col(f"l{i}{i}")) for i in range(P)), F.lit(0.0)).alias("spread"))


def distance() -> Column:
    """Squared Mahalanobis distance of a row joined with its group's estimate."""
    total = F.lit(0.0)
    for i in range(P):
        y = sum((F.get("w", F.lit(i * (i + 1) // 2 + j)) * (F.col(DIMS[j]) - F.get("m", F.lit(j))) for j in range(i + 1)), F.lit(0.0))
        total = total + F.pow(y, F.lit(2.0))
    return total


def _moments() -> list[Column]:
    sums = [F.sum(F.col(a)).alias(f"s{i}") for i, a in enumerate(DIMS)]
    return [F.count(F.lit(1)).alias("n"), *sums, *(F.sum(F.col(DIMS[i]) * F.col(DIMS[j])).alias(f"c{i}{j}") for i in range(P) for j in range(i + 1))]


def _estimate(sums: DataFrame, factor: Column) -> DataFrame:
    mean = [F.col(f"s{i}") / F.col("n") for i in range(P)]
    cov = [(F.col(f"c{i}{j}") / F.col("n") - mean[i] * mean[j]) / factor for i in range(P) for j in range(i + 1)]
    return solved(sums.select("g", "start", "n", F.array(*mean).alias("m"), F.array(*cov).alias("cov")))


def _starts(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """The estimates to begin with, one for each of STARTS: medians and median absolute deviations, exact on a grid of 1/64, alone and
    with two robust correlations. Of rows equal in a statistic there are few kinds on the grid, so no group is gathered."""
    grid = lambda c: F.round(c * 64) / 64
    med = scratch.save(rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.array(*(F.percentile(grid(F.col(c)), F.lit(0.5)) for c in DIMS)).alias("m")), "median")
    mad = [F.percentile(grid(F.abs(F.col(c) - F.get("m", F.lit(i)))), F.lit(0.5)) for i, c in enumerate(DIMS)]
    scale = F.transform(F.array(*mad), lambda x: F.greatest(x * 1.4826, F.lit(1e-3)))
    spread = scratch.save(rows.join(med.drop("n"), "g").groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.first("m").alias("m"), scale.alias("sd")), "spread")
    z = [(F.col(c) - F.get("m", F.lit(i))) / F.get("sd", F.lit(i)) for i, c in enumerate(DIMS)]
    at = rows.join(spread.drop("n"), "g").select("g", *(x.alias(f"z{i}") for i, x in enumerate(z)))
    size = F.sqrt(F.greatest(sum((F.pow(F.col(f"z{i}"), F.lit(2.0)) for i in range(P)), F.lit(0.0)), F.lit(1e-12)))
    at = at.select("g", *((F.col(f"z{i}") / size).alias(f"u{i}") for i in range(P)), *(F.tanh(f"z{i}").alias(f"t{i}") for i in range(P)))
    cross = at.groupBy("g").agg(*(F.sum(F.col(f"{k}{i}") * F.col(f"{k}{j}")).alias(f"{k}{i}{j}") for k in "ut" for i in range(P) for j in range(i + 1)))
    both = spread.join(cross, "g")
    sd = [F.get("sd", F.lit(i)) for i in range(P)]
    corr = lambda k, i, j: F.coalesce(F.col(f"{k}{i}{j}") / F.nullif(F.sqrt(F.col(f"{k}{i}{i}") * F.col(f"{k}{j}{j}")), F.lit(0.0)), F.lit(0.0))
    cov = lambda k: F.array(*(sd[i] * sd[j] * (F.lit(1.0) if i == j else corr(k, i, j) if k else F.lit(0.0)) for i in range(P) for j in range(i + 1)))
    kinds = F.explode(F.array(*(F.struct(F.lit(name).alias("start"), cov(k).alias("cov")) for name, k in zip(STARTS, ("", "u", "t")))))
    return solved(both.select("g", "n", "m", kinds.alias("k")).select("g", "n", "m", "k.*"))


def robust_estimates(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """g, m, w: the minimum-covariance-determinant estimate of each group of `rows` (g and the vector).

    Several starts, and from each of them concentration steps: order a group's rows by their distance, in bins of 2^(1/16), and
    estimate anew from the least whole bins that hold SHARE of them, by the consistency factor of the share that they hold.
    Bins keep equal rows together and let every step be one aggregation with partial results, for all starts together and
    whatever the size of a group. The start that ends with the least determinant counts. Last, one step on the rows within its
    97.5 % ellipsoid. Estimates stay in tables: there may be many groups."""
    est = scratch.save(_starts(rows, scratch), "start")
    factor = F.element_at(F.array(*map(F.lit, SHRUNK)), F.round(F.col("n") * 100 / F.col("of")).cast("int") + 1)
    for step in range(STEPS):
        near = F.floor(F.log2(F.greatest(distance(), F.lit(1e-6))) * BINS).alias("bin")
        bins = rows.join(est.drop("n"), "g").select("g", "start", *DIMS, near).groupBy("g", "start", "bin").agg(*_moments())
        group = Window.partitionBy("g", "start")
        before = F.coalesce(F.sum("n").over(group.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        inner = bins.withColumn("before", before).withColumn("of", F.sum("n").over(group)).filter(F.col("before") < F.col("of") * SHARE)
        sums = inner.groupBy("g", "start").agg(*(F.sum(c).alias(c) for c in bins.columns if c not in ("g", "start", "bin")), F.first("of").alias("of"))
        est = scratch.save(_estimate(sums, factor), f"step{step}")
    best = est.groupBy("g").agg(F.min(F.struct("spread", "start")).alias("b")).select("g", "b.start")
    est = scratch.save(est.join(best, ["g", "start"]), "best")
    inner = rows.join(est.drop("n"), "g").filter(distance() <= chi2_quantile(0.975, P)).groupBy("g", "start").agg(*_moments())
    return scratch.save(_estimate(inner, F.lit(shrunk(0.975))), "final")


def outliers(docs: DataFrame) -> DataFrame:
    """Statistics of every whole text, the base rule, and the verdict of the robust distance within language and source.

    docs: doc_id, text, lang, source; other columns are ignored. Returns a row per row: doc_id, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed, kept, distance (null where no row passes the base rule). Words of a null
    or empty text: none, so it fails the base rule. A null language or source is a value like any other. Rows that fail the
    base rule take no part in estimates. Equal rows get equal verdicts. Every group is estimated from all of its rows.
    """
    scratch = Scratch(docs.sparkSession, "outliers")
    stats = scratch.save(transformed(statistics(docs)), "stats")
    rows, members = grouped(stats)
    est = robust_estimates(scratch.save(members, "rows"), scratch)
    out = rows.join(est.select("g", "m", "w"), "g", "left").withColumn("distance", distance())
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= CUT, F.lit(True))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "distance")
