"""Literal search, line search, path search, ranking and BM25."""

from __future__ import annotations

import operator
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.scalars import depth, file_name
from tessera.sources.shared import written


def count_matches(text: Column, pattern: str, ignore_case: bool = False, overlapping: bool = True) -> Column:
    """Occurrences of a literal; an empty pattern has none."""
    if not pattern:
        return F.lit(0).cast("long")
    flags, literal = "(?i)" if ignore_case else "", _quoted(pattern)
    return F.regexp_count(text, F.lit(f"{flags}(?={literal})" if overlapping else f"{flags}{literal}")).cast("long")


def _quoted(literal: str) -> str:
    return r"\Q" + literal.replace(r"\E", r"\E\\E\Q") + r"\E"


def _starts(df: DataFrame, keep: list[str], text: str, ahead: str) -> DataFrame:
    """keep, line (from 1), column and offset (from 0) of every place where ``ahead``, a
    pattern without width, holds. The text is cut at these places; only the lengths of the
    pieces are shuffled, by row, for the running sums."""
    numbered = df.where(F.col(text).rlike(ahead)).withColumn("_u", F.monotonically_increasing_id())
    each = numbered.select(
        "_u", *keep, F.col(text).rlike(f"^(?:{ahead})").alias("_first"), F.posexplode(F.split(text, ahead)).alias("_n", "_piece")
    )
    sized = each.select(
        "_u", *keep, "_n", ((F.col("_n") > 0) | F.col("_first")).alias("_hit"), F.length("_piece").cast("long").alias("_size"),
        (F.length("_piece") - F.length(F.replace("_piece", F.lit("\n"), F.lit("")))).cast("long").alias("_breaks"),
        F.length(F.substring_index("_piece", "\n", -1)).alias("_tail"),
    )
    before = Window.partitionBy("_u").orderBy("_n").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("offset", F.coalesce(F.sum("_size").over(before), F.lit(0))).withColumn("line", 1 + F.coalesce(F.sum("_breaks").over(before), F.lit(0)))
    begins = F.max(F.when(F.col("_breaks") > 0, F.col("offset") + F.col("_size") - F.col("_tail"))).over(before)
    return placed.withColumn("column", F.col("offset") - F.coalesce(begins, F.lit(0))).where("_hit").select(*keep, "line", "column", "offset")


def positions(df: DataFrame, row: str, text: str, pattern: str, keep: list[str] | None = None) -> DataFrame:
    """row, line (from 1), column (from 0) and offset of each overlapping occurrence of a
    literal without a line break."""
    return _starts(df, [row, *(keep or [])], text, f"(?={_quoted(pattern)})")


def grep(df: DataFrame, row: str, text: str, pattern: str, context: int = 0) -> DataFrame:
    """Matching lines (carriage returns stripped) with up to ``context`` lines around; a line
    carries its own context only."""
    lines = F.transform(F.split(text, "\n"), lambda l: F.rtrim(l, F.lit("\r")))
    each = df.where(F.col(text).contains(pattern)).select(row, lines.alias("_lines"))
    found = F.filter(F.transform("_lines", lambda l, i: F.struct(i.alias("i"), l.alias("l"))), lambda x: x["l"].contains(pattern))
    hits = each.select(row, "_lines", found.alias("_found"))
    around = lambda x: F.struct(
        (x["i"] + 1).cast("long").alias("line_number"),
        x["l"].alias("line_content"),
        *(
            [
                F.slice("_lines", F.greatest(x["i"] - context, F.lit(0)) + 1, F.least(x["i"], F.lit(context))).alias("context_before"),
                F.slice("_lines", x["i"] + 2, F.lit(context)).alias("context_after"),
            ]
            if context
            else []
        ),
    )
    return hits.select(row, F.explode(F.transform("_found", around)).alias("_h")).select(row, "_h.*")


def search_names(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """Paths whose file name holds the pattern, scored: 100 / bytes of the path, +10 for the
    exact name, +5 for a name that starts with it (an exact name does, too)."""
    name, p = F.lower(file_name(F.col(path))), pattern.lower()
    score = F.lit(100.0) / F.greatest(F.octet_length(path), F.lit(1)) + F.when(name == p, 10.0).otherwise(0.0) + F.when(name.startswith(p), 5.0).otherwise(0.0)
    return df.where(F.instr(name, p) > 0).withColumn("score", score)


def search_paths(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """Paths that hold the pattern, those whose file name does marked."""
    p = pattern.lower()
    return df.where(F.lower(path).contains(p)).withColumn("in_name", F.lower(file_name(F.col(path))).contains(p))


def exclude_paths(df: DataFrame, path: str, prefixes: list[str], names: list[str], keep: list[str]) -> DataFrame:
    """Drops paths that are or lie below a prefix, or have a listed component, unless the path
    itself is in ``keep``."""
    c = F.col(path)
    below = F.coalesce(*[F.when((c == x) | c.startswith(f"{x}/"), True) for x in prefixes], F.lit(False))
    parts = F.arrays_overlap(F.split(c, "/"), F.array(*map(F.lit, names))) if names else F.lit(False)
    return df.where(c.isin(keep) | ~(below | parts))


def rank_matches(df: DataFrame, row: str, text: str, path: str, pattern: str) -> DataFrame:
    """row, line, column, word_match, rank_score of every match, best first.

    A match with no ASCII letter, digit or underscore on either side scores 1, any other
    0.5, less 0.02 for each level of the path, 0.01 at least. Whole words come first, then
    shallow paths; ties in order of row and place.
    """
    p, word = _quoted(pattern), "[A-Za-z0-9_]"
    marked = df.select(F.col(row).alias("_row"), F.col(text).alias("_text"), F.xxhash64(text).alias("_hash"), depth(F.col(path)).alias("_depth"))
    every = _starts(marked, ["_row", "_hash", "_depth"], "_text", f"(?={p})").withColumn("_word", F.lit(False))
    whole = _starts(marked, ["_row", "_hash", "_depth"], "_text", f"(?<!{word})(?={p}(?!{word}))").withColumn("_word", F.lit(True))
    found = every.unionByName(whole).groupBy("_row", "_hash", "_depth", "line", "column", "offset").agg(F.max("_word").alias("word_match"))
    score = F.greatest(F.lit(0.01), F.when(F.col("word_match"), 1.0).otherwise(0.5) - 0.02 * F.col("_depth"))
    ordered = found.orderBy(F.desc("word_match"), "_depth", "_row", "offset")
    return ordered.select(F.col("_row").alias(row), "line", "column", "word_match", F.round(score, 6).alias("rank_score"))


def verify_matches(found: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """confirmed, false_positive and missed counts of two sets of matches."""
    both = found.select(*keys, F.lit(1).alias("f")).join(truth.select(*keys, F.lit(1).alias("t")), keys, "full")
    return both.agg(F.count_if(F.expr("f = 1 and t = 1")).alias("confirmed"), F.count_if(F.expr("t is null")).alias("false_positive"), F.count_if(F.expr("f is null")).alias("missed"))


def bm25(df: DataFrame, row: str, columns: dict[str, float], query: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """row, score: BM25 with a weight on each column's term frequency.

    Terms are runs of a-z and 0-9. Texts are read once, for their number of terms and the
    frequency of each term of the query; totals and scores come from these few numbers.
    """
    low = {c: F.lower(F.coalesce(c, F.lit(""))) for c in columns}
    size = sum((F.regexp_count(x, F.lit("[a-z0-9]+")) for x in low.values()), F.lit(0))
    # a term of other characters occurs nowhere
    once = [q for q in query if re.fullmatch("[a-z0-9]+", q)]
    counts = [sum((F.regexp_count(low[c], F.lit(f"(?<![a-z0-9]){q}(?![a-z0-9])")) * float(w) for c, w in columns.items()), F.lit(0.0)) for q in once]
    sized = written(df.select(row, size.alias("_len"), *[x.alias(f"_q{i}") for i, x in enumerate(counts)]))
    totals = sized.agg(F.count("*").alias("_n"), F.avg("_len").alias("_avg"), *[F.count_if(F.col(f"_q{i}") > 0).alias(f"_df{i}") for i in range(len(once))])

    def part(i: int) -> Column:
        tf, df_ = F.col(f"_q{i}"), F.col(f"_df{i}")
        idf = F.log((F.col("_n") - df_ + 0.5) / (df_ + 0.5) + 1.0)
        return F.when(tf > 0, idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("_len") / F.col("_avg")))).otherwise(0.0)

    some = reduce(operator.or_, [F.col(f"_q{i}") > 0 for i in range(len(once))], F.lit(False))
    score = sum((part(i) for i in range(len(once))), F.lit(0.0))
    return sized.where(some).join(F.broadcast(totals)).groupBy(row).agg(F.round(F.sum(score), 6).alias("score"))  # totals: one row


def top_by(df: DataFrame, key: str, order: list, k: int) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_r") <= k).drop("_r")
