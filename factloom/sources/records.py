"""JSON line records: lenient and strict readers, row ordinals, and writers.

Facts are ordered, so every reader gives a contiguous ``row_idx``.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Iterable
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEY = ("SubjectEntity", "Relation")


class DataError(ValueError):
    """Rows break a rule that the caller relies on."""


def numbered(df: DataFrame, name: str = "row_idx", start: int = 0) -> DataFrame:
    """Add contiguous row numbers in reading order, without gathering rows in one task.

    For rows straight from a reader: an order that a sort made need not survive the join.
    """
    marked = df.withColumn("__id", F.monotonically_increasing_id())
    part = F.shiftright("__id", 33)
    counts = marked.groupBy(part.alias("__part")).agg(F.count("*").alias("__count"))
    before = counts.select("__part", (F.sum("__count").over(Window.orderBy("__part")) - F.col("__count")).alias("__before"))
    joined = marked.withColumn("__part", part).join(F.broadcast(before), "__part")
    number = F.col("__before") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)) + F.lit(start)
    return joined.withColumn(name, number).drop("__id", "__part", "__before")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``row_idx, line`` of a text file."""
    return numbered(spark.read.text(path).withColumnRenamed("value", "line"))


def is_blank(line: str | Column) -> Column:
    """Whether a line holds white space only."""
    c = F.col(line) if isinstance(line, str) else line
    return c.rlike(r"^[\s\x1c-\x1f]*$")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """``row_idx, line`` of the non-blank lines; a line that is no JSON is an error."""
    rows = numbered(spark.read.text(path).withColumnRenamed("value", "line").where(~is_blank("line")))
    broken = rows.where(F.try_parse_json("line").isNull()).select("row_idx", F.lit("invalid JSON").alias("problem"))
    require_none(broken, path)
    return rows


def strict_violations(lines: DataFrame) -> DataFrame:
    """``row_idx, problem`` of lines that are blank, no JSON, or no object."""
    kind = F.schema_of_variant(F.try_parse_json("line"))
    problem = (
        F.when(is_blank("line"), "blank lines are not allowed")
        .when(kind.isNull(), "invalid JSON")
        .when(~kind.startswith("OBJECT"), "each row must be an object")
    )
    return lines.select("row_idx", problem.alias("problem")).where("problem is not null")


def read_strict(spark: SparkSession, path: str) -> DataFrame:
    """``row_idx, line`` of a file whose every line must be a JSON object."""
    lines = read_lines(spark, path)
    require_none(strict_violations(lines), path)
    return lines


def require_none(violations: DataFrame, source: str) -> None:
    """Raise with the first violation, if there is one."""
    first = violations.orderBy("row_idx").limit(1).collect()
    if first:
        raise DataError(f"{source}:{first[0]['row_idx'] + 1}: {first[0]['problem']}")


def facts(lines: DataFrame) -> DataFrame:
    """Add ``SubjectEntity, Relation, objects_kind, ObjectEntities`` to lines.

    ``objects_kind`` is the type of the object list; ``ObjectEntities`` has its string elements, and a
    list's first element in place of an inner list.
    """
    v = F.try_parse_json("line")
    read = lines.withColumn("__v", v)
    subject, relation = (F.when(F.schema_of_variant(F.try_variant_get("__v", f"$.{k}", "variant")) == "STRING", F.try_variant_get("__v", f"$.{k}", "string")) for k in KEY)
    return (
        read.withColumn("SubjectEntity", subject)
        .withColumn("Relation", relation)
        .withColumn("objects_kind", F.schema_of_variant(F.try_variant_get("__v", "$.ObjectEntities", "variant")))
        .withColumn("ObjectEntities", _flat_objects("line"))
        .drop("__v")
    )


@F.pandas_udf(T.ArrayType(T.StringType()))
def _flat_objects(lines: pd.Series) -> pd.Series:
    def one(line: str | None) -> list[str] | None:
        try:
            row = json.loads(line) if line else None
        except ValueError:
            return None
        found = row.get("ObjectEntities") if isinstance(row, dict) else None
        if not isinstance(found, list):
            return None
        heads = [x[0] if isinstance(x, list) and x else x for x in found]
        return [x for x in heads if isinstance(x, str)]

    return lines.map(one, na_action="ignore")


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def _gold_objects(lines: pd.Series) -> pd.Series:
    def one(line: str) -> list[list[str]] | None:
        row = json.loads(line)
        found = row.get("ObjectEntities") if isinstance(row, dict) else None
        if not isinstance(found, list):
            return None
        if found and isinstance(found[0], str):  # the older flat form, told by its first element
            return [[x] for x in found if isinstance(x, str)]
        return [[a for a in x if isinstance(a, str)] for x in found if isinstance(x, list)]

    return lines.map(one, na_action="ignore")


def gold_facts(lines: DataFrame) -> DataFrame:
    """``row_idx, SubjectEntity, Relation, ObjectEntities`` with alias groups; flat lists are wrapped."""
    return facts(lines).withColumn("ObjectEntities", _gold_objects("line")).drop("line", "objects_kind")


def to_lines(rows: DataFrame) -> DataFrame:
    """``row_idx, line`` with the other columns as JSON."""
    rest = [c for c in rows.columns if c != "row_idx"]
    return rows.select("row_idx", F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}).alias("line"))


def write_parts(lines: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write lines as a folder of ordered text files."""
    lines.orderBy("row_idx").select("line").write.mode(mode).text(path)


def replace_file(path: str | Path, chunks: Iterable[bytes], tries: int = 30) -> None:
    """Write a local file whole or not at all."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    draft = target.with_name(f".{target.name}.{uuid.uuid4().hex}.tmp")
    try:
        with draft.open("wb") as out:
            for chunk in chunks:
                out.write(chunk)
            out.flush()
            os.fsync(out.fileno())
        for k in range(tries):
            try:
                os.replace(draft, target)
                break
            except PermissionError:
                if k == tries - 1:
                    raise
                time.sleep(min(1.0, 0.25 * (k + 1)))
    finally:
        draft.unlink(missing_ok=True)


def write_file(lines: DataFrame, path: str | Path) -> None:
    """Write lines to one local file, in order, row by row."""
    replace_file(path, (row["line"].encode() + b"\n" for row in lines.orderBy("row_idx").select("line").toLocalIterator()))
