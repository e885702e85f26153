"""Combining repeated candidate sets.

Samples are held long: ``headers`` has one row for each readable sample (``row_idx, pass_idx``) and
``passes`` one row for each of its candidates (``row_idx, pass_idx, pos, value``).  Headers matter: an
empty sample has no candidate but counts in every denominator and votes for "no object".

``tally`` turns them into one row for each ``row_idx`` with the candidates in the order in which they
were first seen; the rules are then expressions on that row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

EMPTY = "array<string>"


def tally(headers: DataFrame, passes: DataFrame, key: str = "row_idx") -> DataFrame:
    """``key, n, none_n, candidates`` with ``candidates`` as (count, pass_idx, pos, value, nk), first seen first."""
    keyed = passes.select(key, "pass_idx", "pos", "value", text.key("value").alias("nk")).where("nk <> ''")
    once = keyed.groupBy(key, "pass_idx", "nk").agg(F.min(F.struct("pos", "value")).alias("at"))
    seen = F.min(F.struct("pass_idx", F.col("at.pos").alias("pos"), F.col("at.value").alias("value"))).alias("first")
    counted = once.groupBy(key, "nk").agg(F.count("*").alias("count"), seen)
    one = F.struct(F.col("first.pass_idx"), F.col("first.pos"), "count", F.col("first.value"), "nk")
    listed = counted.groupBy(key).agg(F.sort_array(F.collect_list(one)).alias("candidates"))
    filled = once.select(key, "pass_idx").distinct().withColumn("filled", F.lit(1))
    totals = headers.select(key, "pass_idx").distinct().join(filled, [key, "pass_idx"], "left")
    totals = totals.groupBy(key).agg(F.count("*").alias("n"), (F.count("*") - F.coalesce(F.sum("filled"), F.lit(0))).alias("none_n"))
    return totals.join(listed, key, "left").withColumn("candidates", F.coalesce("candidates", F.array().cast(listed.schema["candidates"].dataType)))


def values(candidates: Column) -> Column:
    """First-seen spellings of candidates."""
    return F.transform(candidates, lambda c: c["value"])


def _empty() -> Column:
    return F.array().cast(EMPTY)


def union(candidates: str = "candidates") -> Column:
    """All candidates."""
    return values(F.col(candidates))


def support(threshold: Column | float, candidates: str = "candidates", n: str = "n") -> Column:
    """Candidates that at least a share of the samples holds."""
    t = F.lit(threshold) if isinstance(threshold, float) else threshold
    return values(F.filter(F.col(candidates), lambda c: c["count"] / F.col(n) >= t))


def top(candidates: str = "candidates") -> Column:
    """The candidate with most votes; the first seen wins ties."""
    most = F.array_max(F.transform(candidates, lambda c: c["count"]))
    return F.get(F.filter(candidates, lambda c: c["count"] == most), F.lit(0))


def none_wins(threshold: Column | float) -> Column:
    """Whether "no object" has a strict plurality and at least a share of the samples."""
    t = F.lit(threshold) if isinstance(threshold, float) else threshold
    best = F.coalesce(F.array_max(F.transform("candidates", lambda c: c["count"])), F.lit(0))
    return (F.col("none_n") > best) & (F.col("none_n") / F.col("n") >= t)


def majority_or_none(threshold: Column | float) -> Column:
    """The top candidate alone, unless "no object" wins."""
    silent = (F.size("candidates") == 0) | none_wins(threshold)
    return F.when(silent, _empty()).otherwise(F.array(top()["value"]))


def threshold_or_none(candidate: Column | float, none: Column | float) -> Column:
    """Candidates with enough support, unless "no object" wins."""
    return F.when(none_wins(none), _empty()).otherwise(support(candidate))


def median_values(headers: DataFrame, passes: DataFrame, key: str = "row_idx") -> DataFrame:
    """``key, median`` of the first values of the samples; samples without a number do not count."""
    first = passes.groupBy(key, "pass_idx").agg(F.min_by("value", "pos").alias("value"))
    numbers = first.select(key, text.number("value").alias("x"))
    middle = numbers.groupBy(key).agg(F.median("x").alias("median"))
    return headers.select(key).distinct().join(middle, key, "left")


def aggregate(rows: DataFrame, headers: DataFrame, passes: DataFrame, policies: dict, key: str = "row_idx") -> DataFrame:
    """``key, result, samples, empty_samples`` of every input row by its relation's rule.

    Driven by the input rows: a row whose samples were all unreadable gets an empty result.
    """
    from ..policy import by_relation

    tallied = tally(headers, passes, key)
    numeric = [r for r, p in policies.items() if p.rule == "median"]
    # numbers are only parsed for relations that use them
    wanted = rows.where(F.col("Relation").isin(numeric)).select(key)
    middle = median_values(headers.join(wanted, key, "left_semi"), passes.join(wanted, key, "left_semi"), key)
    joined = rows.select(key, "Relation").join(tallied, key, "left").join(middle, key, "left")
    candidate = by_relation({r: p.candidate for r, p in policies.items() if p.candidate is not None}).cast("double")
    none = by_relation({r: p.none for r, p in policies.items() if p.none is not None}).cast("double")
    rule = by_relation({r: p.rule for r, p in policies.items()})
    result = (
        F.when(F.col("n").isNull(), _empty())
        .when(rule == "median", F.when(F.col("median").isNull(), _empty()).otherwise(F.array(text.number_text("median"))))
        .when(rule == "majority_none", majority_or_none(none))
        .when(rule == "threshold_none", threshold_or_none(candidate, none))
        .when(rule == "union", union())
        .when(rule == "support", support(candidate))
    )
    zero = F.lit(0).cast("long")
    return joined.select(key, "Relation", result.alias("result"), F.coalesce("n", zero).alias("samples"), F.coalesce("none_n", zero).alias("empty_samples"))
