"""Training facts and the check that they are copied from the bundled ones."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sets import bag_difference
from . import digests, records
from .records import DataError

# Where the bundled training rows are, from the folder a command runs in.
BUNDLED = "data/train.jsonl"


def bundled_path(named: str | None = None) -> str | None:
    """The bundled training file: the named one, else the usual one where it is there."""
    return named if named is not None else BUNDLED if Path(BUNDLED).is_file() else None


def row_text(line: str) -> Column:
    """A JSON line with sorted keys, so that equal rows are equal strings."""
    return F.to_json(F.try_parse_json(line))


def train_rows(spark: SparkSession, path: str, bundled: str | None = None) -> DataFrame:
    """Training facts; with a bundled file every row must be copied from it, each as often at most."""
    digests.refuse_held_back(path, "training data")
    lines = records.read_records(spark, path)
    if not lines.limit(1).count():
        raise DataError("training data must contain at least one row")
    if bundled is not None:
        own, allowed = (x.select(row_text("line").alias("row")) for x in (lines, records.read_records(spark, bundled)))
        odd = bag_difference(own, allowed).limit(1).collect()
        if odd:
            raise DataError(f"training data contains a row not copied exactly from the bundled file: {odd[0]['row'][:200]}")
    return records.gold_facts(lines)
