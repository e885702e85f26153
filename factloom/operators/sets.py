"""Set operations, coverage, prefix checks and resumption on keyed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def bag_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of ``left`` beyond their number in ``right``."""
    return left.exceptAll(right)


def canonical_rows(df: DataFrame) -> DataFrame:
    """``row`` as JSON with sorted fields, so that equal rows are equal strings."""
    return df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("row"))


def missing_keys(expected: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    """Expected keys that were not observed."""
    return expected.select(*keys).distinct().join(observed.select(*keys), keys, "left_anti")


def remaining(rows: DataFrame, done: DataFrame, key: str = "row_idx") -> DataFrame:
    """Rows that are not done yet."""
    return rows.join(done.select(key), key, "left_anti")


def prefix_gap(done: DataFrame, key: str = "row_idx") -> DataFrame:
    """One row: how many are done, the highest number, and whether they are a gapless prefix from 0."""
    facts = done.agg(F.count("*").alias("n"), F.count_distinct(key).alias("d"), F.max(key).alias("highest"))
    whole = (F.col("n") == F.col("d")) & (F.coalesce(F.col("highest") + 1, F.lit(0)) == F.col("n"))
    return facts.select("n", "highest", whole.alias("is_prefix"))


def keep_accepted(candidates: DataFrame, accepted: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates whose key was accepted; their spelling and order stay."""
    return candidates.join(accepted.select(*keys), keys, "left_semi")


def first_rows(rows: DataFrame, n: int, order: str = "row_idx") -> DataFrame:
    """The first ``n`` rows; a negative number is an error."""
    if n < 0:
        raise ValueError("limit cannot be negative")
    return rows.orderBy(order).limit(n)


def first_of(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("__nth", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("__nth = 1").drop("__nth")
