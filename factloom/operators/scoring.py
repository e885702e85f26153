"""Matching predictions with gold objects and averaging the scores.

Everything that concerns one fact stays in its row: predictions and gold alias groups are arrays, so
after one join by key no further shuffle is needed until the averages.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from ..policy import NUMERIC, TOLERANCE

KEY = ["SubjectEntity", "Relation"]
ALL = "*** All Relations ***"


def last_by_key(rows: DataFrame, objects: str = "ObjectEntities") -> DataFrame:
    """One row for each key: of duplicates the last counts."""
    return rows.groupBy(*KEY).agg(F.max_by(objects, "row_idx").alias(objects))


def unique_predictions(df: DataFrame, objects: str) -> DataFrame:
    """Add ``surfaces`` and ``pred_keys``: predictions that differ by key (the first spelling stays), and the keys.

    Unlike elsewhere an empty key counts, once.
    """
    real = F.filter(F.coalesce(objects, F.array().cast("array<string>")), lambda x: x.isNotNull())
    keyed = df.withColumn("__real", real).withColumn("__keyed", text.keys("__real"))
    each = F.arrays_zip("__real", "__keyed")
    first = F.filter(each, lambda x, i: F.array_position(F.col("__keyed"), x["__keyed"]) == i + 1)
    return keyed.withColumn("surfaces", F.transform(first, lambda x: x["__real"])).withColumn("pred_keys", F.array_distinct("__keyed")).drop("__real", "__keyed")


def _augment(edges: list[list[str]]) -> int:
    """Size of a maximum matching between gold objects and the prediction keys each may take."""
    owner: dict[str, int] = {}
    for start in range(len(edges)):
        # breadth-first search for an alternating path from a free gold object to a free prediction
        came: dict[str, tuple[int, str | None]] = {}
        frontier: list[tuple[int, str | None]] = [(start, None)]
        end = None
        while frontier and end is None:
            gold, via = frontier.pop(0)
            for p in edges[gold]:
                if p in came:
                    continue
                came[p] = (gold, via)
                if p not in owner:
                    end = p
                    break
                frontier.append((owner[p], p))
        while end is not None:
            gold, via = came[end]
            owner[end] = gold
            end = via
    return len(owner)


@F.pandas_udf(T.IntegerType())
def _matching_udf(edges: pd.Series) -> pd.Series:
    return edges.map(lambda gold: _augment([list(g) for g in gold]), na_action="ignore").astype("Int32")


def matched_hits(hits: Column) -> Column:
    """Size of a maximum matching, given the predictions that each gold object may take.

    If no prediction fits two objects, or no object two predictions, counting suffices; only the rest
    goes through the matching function.
    """
    flat = F.flatten(hits)
    single_gold = F.size(flat) == F.size(F.array_distinct(flat))
    single_pred = F.forall(hits, lambda h: F.size(h) <= 1)
    counted = F.when(single_gold, F.size(F.filter(hits, lambda h: F.size(h) > 0))).when(single_pred, F.size(F.array_distinct(flat)))
    rest = F.transform(hits, lambda h: h.cast("array<string>"))
    return F.coalesce(counted, _matching_udf(F.when(~single_gold & ~single_pred, rest)))


def matched_strings(pred_keys: Column, gold_keys: Column) -> Column:
    """Maximum number of predictions matched with different gold objects."""
    return matched_hits(F.transform(gold_keys, lambda g: F.array_intersect(g, pred_keys)))


def matched_numbers(pred_numbers: Column, gold_numbers: Column, tolerance: float = TOLERANCE) -> Column:
    """Predictions matched first-fit with gold numbers within a relative tolerance, each gold number once."""

    def fits(p: Column, g: Column) -> Column:
        return p.isNotNull() & g.isNotNull() & (g != 0) & (F.abs(p - g) / F.nullif(g, F.lit(0.0)) <= tolerance)

    def take(used: Column, p: Column) -> Column:
        free = F.filter(F.sequence(F.lit(0), F.size(gold_numbers)), lambda i: (i < F.size(gold_numbers)) & ~F.array_contains(used, i) & F.coalesce(fits(p, F.get(gold_numbers, i)), F.lit(False)))
        return F.when(F.size(free) > 0, F.array_append(used, F.get(free, F.lit(0)))).otherwise(used)

    return F.size(F.aggregate(pred_numbers, F.array().cast("array<int>"), take))


def f1(p: Column, r: Column) -> Column:
    """Harmonic mean; 0 if both are 0."""
    return F.when(p + r == 0, F.lit(0.0)).otherwise(2 * p * r / F.nullif(p + r, F.lit(0.0)))


def capped_ratio(tp: Column, total: Column) -> Column:
    """Precision or recall on its own: 1 if there is nothing to divide by, and never above 1."""
    return F.when(total == 0, F.lit(1.0)).otherwise(F.least(tp / F.nullif(total, F.lit(0)), F.lit(1.0)))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _numbers_udf(values: pd.Series) -> pd.Series:
    return values.map(lambda xs: [None if x is None else text.parse_float(x) for x in xs], na_action="ignore")


def score_pairs(gold: DataFrame, predictions: DataFrame, numeric: tuple[str, ...] = NUMERIC, tolerance: float = TOLERANCE) -> DataFrame:
    """``SubjectEntity, Relation, p, r, f1, tp, total_pred, total_gt`` of every gold key.

    ``gold`` has alias groups, ``predictions`` flat lists, both with ``row_idx``.  Predictions for other
    keys are ignored; a missing prediction is an empty one.
    """
    gold_one = last_by_key(gold)
    pred_one = last_by_key(predictions).withColumnRenamed("ObjectEntities", "preds")
    joined = gold_one.join(pred_one, KEY, "left").withColumn("golds", F.coalesce("ObjectEntities", F.array().cast("array<array<string>>")))
    ready = unique_predictions(joined, "preds").select(*KEY, "golds", "surfaces", "pred_keys")
    return with_scores(ready, numeric, tolerance)


def with_scores(ready: DataFrame, numeric: tuple[str, ...] = NUMERIC, tolerance: float = TOLERANCE, keep: tuple[str, ...] = ()) -> DataFrame:
    """Scores of rows with ``golds, surfaces, pred_keys``; ``keep`` names columns to carry along."""
    is_number = F.col("Relation").isin(*numeric)
    none = F.array().cast("array<array<string>>")
    grouped = ready.withColumn("__gold_keys", text.nested_keys(F.when(is_number, none).otherwise(F.col("golds"))))
    gold_numbers = _numbers_udf(F.when(is_number, F.transform("golds", lambda g: F.get(g, F.lit(0)))))
    pred_numbers = _numbers_udf(F.when(is_number, F.col("surfaces")))
    counted = grouped.withColumn("__pn", pred_numbers).withColumn("__gn", gold_numbers)
    empty = F.array().cast("array<double>")
    tp = F.when(is_number, matched_numbers(F.coalesce("__pn", empty), F.coalesce("__gn", empty), tolerance)).otherwise(matched_strings(F.col("pred_keys"), F.col("__gold_keys")))
    sized = counted.select(*KEY, *keep, tp.alias("tp"), F.size("surfaces").alias("total_pred"), F.size("golds").alias("total_gt"))
    return rated(sized).select(*KEY, *keep, "p", "r", "f1", "tp", "total_pred", "total_gt")


def rated(sized: DataFrame) -> DataFrame:
    """Add ``p, r, f1`` to ``tp, total_pred, total_gt``; nothing to divide by counts as 1."""
    p = F.when(F.col("total_pred") > 0, F.col("tp") / F.nullif(F.col("total_pred"), F.lit(0))).otherwise(F.lit(1.0))
    r = F.when(F.col("total_gt") > 0, F.col("tp") / F.nullif(F.col("total_gt"), F.lit(0))).otherwise(F.lit(1.0))
    return sized.withColumn("p", p).withColumn("r", r).withColumn("f1", f1(F.col("p"), F.col("r")))


def _by_relation(scores: DataFrame, *aggregates: Column) -> DataFrame:
    grouped = scores.groupingSets([[F.col("Relation")], []], F.col("Relation")).agg(F.grouping("Relation").alias("__all"), *aggregates)
    return grouped.withColumn("Relation", F.when(F.col("__all") == 1, F.lit(ALL)).otherwise(F.col("Relation"))).drop("__all")


def macro_average(scores: DataFrame) -> DataFrame:
    """Means over rows, by relation and over all rows."""
    return _by_relation(scores, F.avg("p").alias("macro_p"), F.avg("r").alias("macro_r"), F.avg("f1").alias("macro_f1"))


def _micro(sums: DataFrame) -> DataFrame:
    p = F.when(F.col("__pred") > 0, F.col("__tp") / F.nullif(F.col("__pred"), F.lit(0))).otherwise(F.lit(1.0))
    r = F.when(F.col("__gold") > 0, F.col("__tp") / F.nullif(F.col("__gold"), F.lit(0))).otherwise(F.lit(1.0))
    rated = sums.withColumn("micro_p", p).withColumn("micro_r", r)
    return rated.withColumn("micro_f1", f1(F.col("micro_p"), F.col("micro_r"))).drop("__tp", "__pred", "__gold")


def micro_average(scores: DataFrame) -> DataFrame:
    """Ratios of summed counts, by relation and over all rows."""
    return _micro(_by_relation(scores, F.sum("tp").alias("__tp"), F.sum("total_pred").alias("__pred"), F.sum("total_gt").alias("__gold")))


def prediction_statistics(scores: DataFrame) -> DataFrame:
    """Mean number of predictions and number of empty ones, by relation and over all rows."""
    return _by_relation(scores, F.avg("total_pred").alias("avg_preds"), F.count_if(F.col("total_pred") == 0).alias("empty_preds"))


def report(scores: DataFrame, digits: int = 3) -> DataFrame:
    """Macro and micro averages and statistics in one aggregation, rounded half to even."""
    sums = _by_relation(
        scores,
        F.avg("p").alias("macro_p"),
        F.avg("r").alias("macro_r"),
        F.avg("f1").alias("macro_f1"),
        F.sum("tp").alias("__tp"),
        F.sum("total_pred").alias("__pred"),
        F.sum("total_gt").alias("__gold"),
        F.avg("total_pred").alias("avg_preds"),
        F.count_if(F.col("total_pred") == 0).alias("empty_preds"),
    )
    rated = _micro(sums)
    shown = [F.bround(c, digits).alias(c) for c in ("macro_p", "macro_r", "macro_f1", "micro_p", "micro_r", "micro_f1", "avg_preds")]
    return rated.select("Relation", *shown, F.col("empty_preds").cast("int").alias("empty_preds"))


def zero_object_scores(scores: DataFrame) -> DataFrame:
    """Precision, recall and F1 of predicting no object, with the empty set as positive class."""
    none_pred, none_gold = F.col("total_pred") == 0, F.col("total_gt") == 0
    sums = _by_relation(scores, F.count_if(none_pred & none_gold).alias("__tp"), F.count_if(none_pred).alias("__pred"), F.count_if(none_gold).alias("__gold"))
    return _micro(sums).toDF("Relation", "zero_p", "zero_r", "zero_f1")


def oracle_ceiling(pass_scores: DataFrame) -> DataFrame:
    """Share of rows of which at least one sample is fully right, by relation and over all rows."""
    best = pass_scores.groupBy(*KEY).agg(F.max((F.col("f1") == 1.0).cast("int")).alias("right"))
    return _by_relation(best, F.avg("right").alias("ceiling"))


def _resampled(resamples: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sums of weights and of weighted differences of a task's ``d, n, h``, by resample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, sums, seen = np.zeros(resamples), np.zeros(resamples), False
        for batch in batches:
            for d, n, h in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if d is None:
                    continue
                drawn = np.random.default_rng(h % (1 << 64)).poisson(n, resamples)
                weights += drawn
                sums += drawn * d
                seen = True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(1, resamples + 1, dtype=np.int32)), pa.array(weights), pa.array(sums)], ["k", "w", "wd"])

    return run


def paired_bootstrap(left: DataFrame, right: DataFrame, resamples: int = 20_000, seed: int = 0) -> DataFrame:
    """``diff, low, high, p_value``: mean F1 difference with a 95 % interval from row resampling.

    Each row has a Poisson(1) weight in every resample.  Rows of equal difference count by the sum of their
    weights only, which for n rows is Poisson(n), so each distinct difference is drawn once a resample, from
    a generator seeded by the difference: draws need no shuffle of rows and agree between runs.
    """
    both = left.select(*KEY, F.col("f1").alias("a")).join(right.select(*KEY, F.col("f1").alias("b")), KEY)
    rows = both.select((F.col("a") - F.col("b")).alias("d"))
    equal = rows.groupBy("d").agg(F.count("*").alias("n"), F.xxhash64("d", F.lit(seed)).alias("h"))
    drawn = equal.mapInArrow(_resampled(resamples), "k int, w double, wd double")
    # rounded, so that a mean of 0 stays 0 in whatever order a task adds
    means = drawn.groupBy("k").agg(F.round(F.sum("wd") / F.nullif(F.sum("w"), F.lit(0.0)), 12).alias("m"))
    spread = means.agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"), F.avg((F.col("m") <= 0).cast("double")).alias("below"))
    p = F.least(2 * F.least(F.col("below"), 1 - F.col("below")), F.lit(1.0))
    return rows.agg(F.avg("d").alias("diff")).join(spread, how="cross").select("diff", "low", "high", p.alias("p_value"))
