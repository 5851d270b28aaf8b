"""Quality rules: fixed rules, then robust multivariate outliers, in DataFrame operations.

Statistics of each whole text (words, characters, symbols, repeated lines and 5-word
windows) give a fixed verdict (base) and a vector of transformed statistics. For each
language and source a minimum-covariance-determinant (MCD) estimate of centre and scatter
is found by concentration steps: keep the 75 % of documents nearest by Mahalanobis
distance, re-estimate, repeat. Two starts (medians with robust spreads, plain moments)
run side by side until no determinant changes any more, the smaller determinant wins. A
document far outside its group is rejected. A group of fewer than ``least`` documents is
judged by the estimate of all documents of its language, and if these are too few by that
of the whole table. A floor on each variance (a regularised MCD) keeps the scatter invertible where
most documents share a value, as with symbol counts of zero.

Everything that is gathered (histograms of quantised values, sums of products) is a
mergeable aggregate by group, so a hot source costs no more than its partial sums, and
all documents count.

Defined results: a null text is empty; a null language or source is a group of its own,
apart from an empty one; a table of fewer than ``least`` documents that pass the fixed rules
has no estimate, and only these rules reject; rows are judged one by one, also repeated ones; doc_id may be null; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import Stash, cut, text_column

#: Transformed statistics and the least standard deviation assumed of each.
FEATURES = {
    "x0": ("ln(1 + n_words)", 0.5),
    "x1": ("ln(word_chars / greatest(n_words, 1) + 1)", 0.1),
    "x2": ("sqrt(n_symbols / greatest(word_chars, 1))", 0.04),
    "x3": ("ln(1 + n_dup_lines)", 0.35),
    "x4": ("sqrt(n_repeat_words / greatest(n_words, 1))", 0.12),
}
X = list(FEATURES)
D = len(X)
KEEP = 0.75
TAIL = 1e-9


def _chi2_cdf(x: float, k: int) -> float:
    """Chi-square distribution function (series of the lower incomplete gamma function)."""
    a, s = k / 2, x / 2
    if s <= 0:
        return 0.0
    term = total = 1 / a
    n = 0
    while term > total * 1e-17:
        n += 1
        term *= s / (a + n)
        total += term
    return total * math.exp(-s + a * math.log(s) - math.lgamma(a))


def _chi2_quantile(p: float, k: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _chi2_cdf(mid, k) < p else (lo, mid)
    return hi


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of each text, without a shuffle."""
    gap, any_word = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]"
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("lang").cast("string").alias("lang"),
        F.col("source").cast("string").alias("source"),
        text_column().alias("text"),
    )
    parts = base.select(
        "doc_id", "lang", "source",
        F.expr(rf"filter(split(text, r'{gap}'), w -> w <> '')").alias("w"),
        F.expr(rf"filter(split(text, '\n'), l -> l rlike r'{any_word}')").alias("lines"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).alias("n_symbols"),
    )
    windows = "if(size(w) < 5, cast(array() as array<bigint>), transform(sequence(0, size(w) - 5), i -> xxhash64(w[i], w[i + 1], w[i + 2], w[i + 3], w[i + 4])))"
    counted = parts.select(
        "doc_id", "lang", "source", "n_symbols",
        F.size("w").alias("n_words"),
        F.length(F.array_join("w", "")).alias("word_chars"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.expr(windows).alias("h"),
    )
    # positions of windows found twice or more: neighbours in the sorted windows
    placed = counted.withColumn("s", F.expr("if(size(array_distinct(h)) = size(h), null, array_sort(transform(h, (x, i) -> struct(x as x, i as i))))"))
    twice = "filter(s, (p, k) -> (k > 0 and s[k - 1].x = p.x) or (k < size(s) - 1 and s[k + 1].x = p.x))"
    covered = f"aggregate(array_sort(transform({twice}, p -> p.i)), struct(-5 as last, 0 as n), (a, i) -> struct(i as last, a.n + least(5, i - a.last) as n), a -> a.n)"
    long = [F.col(c).cast("long").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines")]
    return placed.select("doc_id", "lang", "source", *long, F.expr(f"if(s is null, 0, {covered})").cast("long").alias("n_repeat_words"))


# --- estimates by group -----------------------------------------------------------------


def _moments(rows: DataFrame) -> DataFrame:
    """g, start, n, means m_i and (floored) scatter c_i_j."""
    sums = [F.count("*").alias("n"), *[F.avg(x).alias(f"m{i}") for i, x in enumerate(X)]]
    sums += [F.covar_pop(X[i], X[j]).alias(f"c{i}_{j}") for i in range(D) for j in range(i + 1)]
    return rows.groupBy("g", "start").agg(*sums)


def _floored(estimates: DataFrame, factor: float) -> DataFrame:
    return estimates.withColumns({f"c{i}_{i}": F.col(f"c{i}_{i}") * factor + floor * floor for i, (_, floor) in enumerate(FEATURES.values())}).withColumns(
        {f"c{i}_{j}": F.col(f"c{i}_{j}") * factor for i in range(D) for j in range(i)}
    )


def _cholesky(estimates: DataFrame) -> DataFrame:
    """Adds the lower factor l_i_j of the scatter, and log_det."""
    for i in range(D):
        for j in range(i + 1):
            rest = F.col(f"c{i}_{j}")
            for k in range(j):
                rest = rest - F.col(f"l{i}_{k}") * F.col(f"l{j}_{k}")
            estimates = estimates.withColumn(f"l{i}_{j}", F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"l{j}_{j}"))
    log_det = sum((2 * F.log(f"l{i}_{i}") for i in range(D)), F.lit(0.0))
    return estimates.select("g", "start", log_det.alias("log_det"), *[f"m{i}" for i in range(D)], *[f"l{i}_{j}" for i in range(D) for j in range(i + 1)])


def _distance(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """Adds d2, the squared Mahalanobis distance by the estimates of the row's group."""
    rows = rows.join(estimates, ["g", "start"])
    for i, x in enumerate(X):
        rest = F.col(x) - F.col(f"m{i}")
        for j in range(i):
            rest = rest - F.col(f"l{i}_{j}") * F.col(f"z{j}")
        rows = rows.withColumn(f"z{i}", rest / F.col(f"l{i}_{i}"))
    return rows.withColumn("d2", sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(D)), F.lit(0.0)))


def _quantile(rows: DataFrame, keys: list[str], value, share: float, step: float) -> DataFrame:
    """keys, bound: the smallest multiple of ``step`` that ``share`` of the values don't pass."""
    counts = rows.select(*keys, F.ceil(value / step).alias("b")).groupBy(*keys, "b").agg(F.count("*").alias("n"))
    by = Window.partitionBy(*keys)
    sofar = F.sum("n").over(by.orderBy("b"))
    ranked = counts.select(*keys, "b", sofar.alias("sofar"), F.sum("n").over(by).alias("all"))
    return ranked.where(F.col("sofar") >= share * F.col("all")).groupBy(*keys).agg((F.min("b") * step).alias("bound"))


def _robust_start(rows: DataFrame) -> DataFrame:
    """Medians, and spreads from the middle half, of each statistic (scatter diagonal)."""
    each = rows.select("g", F.posexplode(F.array(*X)).alias("i", "x"))
    mid = _quantile(each, ["g", "i"], F.col("x"), 0.5, 1 / 256).withColumnRenamed("bound", "m")
    away = each.join(mid, ["g", "i"]).select("g", "i", "m", F.abs(F.col("x") - F.col("m")).alias("a"))
    spread = _quantile(away, ["g", "i"], F.col("a"), 0.5, 1 / 256)
    both = mid.join(spread, ["g", "i"])
    wide = [F.max(F.when(F.col("i") == i, F.col("m"))).alias(f"m{i}") for i in range(D)]
    wide += [F.max(F.when(F.col("i") == i, F.pow(1.4826 * F.col("bound"), F.lit(2)))).alias(f"c{i}_{i}") for i in range(D)]
    zero = {f"c{i}_{j}": F.lit(0.0) for i in range(D) for j in range(i)}
    return both.groupBy("g").agg(*wide).withColumn("start", F.lit(0)).withColumns(zero)


def mcd(rows: DataFrame, steps: int = 12, least: int = 30, settled: float = 1e-3) -> DataFrame:
    """g, log_det, means and factors of each group's MCD estimate, from rows (g, x_i).

    Concentration steps end when no group's log determinant moves by ``settled``, and after
    ``steps`` of them at the latest (quantised bounds may swing by a row for ever).
    """
    sized = rows.groupBy("g").agg(F.count("*").alias("size")).where(F.col("size") >= least)
    rows = rows.join(sized.select("g"), "g", "left_semi").select("g", *X)
    columns = ["g", "start", *[f"m{i}" for i in range(D)], *[f"c{i}_{j}" for i in range(D) for j in range(i + 1)]]
    plain = _moments(rows.withColumn("start", F.lit(1)))
    now = cut(_cholesky(_floored(_robust_start(rows).select(*columns).unionByName(plain.select(*columns)), 1.0)))
    twofold = rows.withColumn("start", F.explode(F.array(F.lit(0), F.lit(1))))
    # the scatter of the nearest 75 % of a normal sample is too small by this factor
    factor = KEEP / _chi2_cdf(_chi2_quantile(KEEP, D), D + 2)
    for _ in range(steps):
        measured = _distance(twofold, now)
        bound = _quantile(measured, ["g", "start"], F.log1p("d2"), KEEP, 1 / 128)
        bound = cut(bound)
        nearest = measured.join(bound, ["g", "start"]).where(F.log1p("d2") <= F.col("bound"))
        before, now = now, cut(_cholesky(_floored(_moments(nearest), factor)))
        both = now.join(before.select("g", "start", F.col("log_det").alias("was")), ["g", "start"])
        if (both.agg(F.max(F.abs(F.col("log_det") - F.col("was"))).alias("moved")).first().moved or 0) < settled:
            break
    best = Window.partitionBy("g").orderBy("log_det", "start")
    return now.withColumn("rank", F.row_number().over(best)).where("rank = 1").drop("rank")


def _key(*names: str):
    """One string for the values of some columns; null and empty differ."""
    return F.concat(*[F.concat(F.coalesce(F.length(n), F.lit(-1)).cast("string"), F.lit(":")) for n in names], *[F.coalesce(n, F.lit("")) for n in names])


def _judges(rows: DataFrame, least: int) -> DataFrame:
    """own, g: the group whose estimate judges each (language, source), by how many documents
    of a group pass the fixed rules."""
    sizes = rows.groupBy("own", "parent").agg(F.count_if(~F.col("base_failed")).alias("n"))  # one row for each group
    by_parent = Window.partitionBy("parent")
    enough = F.when(F.col("n") >= least, F.col("own")).when(F.col("n_parent") >= least, F.col("parent")).otherwise(F.lit(_ALL))
    return cut(sizes.withColumn("n_parent", F.sum("n").over(by_parent)).select("own", enough.alias("g")))


#: The group of all documents.
_ALL = "*"


def judge(docs: DataFrame, steps: int = 12, least: int = 30) -> DataFrame:
    """doc_id, counts, base_failed, kept and the squared distance (null where not measured)."""
    features = [F.expr(e).alias(x) for x, (e, _) in FEATURES.items()]
    failed = F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words")
    own, parent = F.concat(F.lit("own "), _key("lang", "source")), F.concat(F.lit("lang "), _key("lang"))
    rows = Stash(statistics(docs).select("*", failed.alias("base_failed"), own.alias("own"), parent.alias("parent"), *features)).df
    passed = rows.where("not base_failed")
    judges = _judges(rows, least)
    # each row takes part in those of its three groups that judge some group
    used = judges.select("g").distinct()
    taking = passed.select(F.explode(F.array("own", "parent", F.lit(_ALL))).alias("g"), *X).join(used, "g", "left_semi")
    estimates = mcd(taking, steps, least)
    limit = _chi2_quantile(1 - TAIL, D)
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    parts = [x for x in estimates.columns if x != "g"]
    known = rows.join(judges.select("own", "g"), "own").join(estimates.select("g", *parts), "g", "left")
    for i, x in enumerate(X):
        rest = F.col(x) - F.col(f"m{i}")
        for j in range(i):
            rest = rest - F.col(f"l{i}_{j}") * F.col(f"z{j}")
        known = known.withColumn(f"z{i}", rest / F.col(f"l{i}_{i}"))
    d2 = sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(D)), F.lit(0.0))
    return known.withColumn("distance", d2).select(
        *columns, (~F.col("base_failed") & F.coalesce(F.col("distance") <= limit, F.lit(True))).alias("kept"), "distance"
    )
