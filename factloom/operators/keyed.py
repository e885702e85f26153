"""Operations on keyed fact files: validation, selection, merging, packaging."""

from __future__ import annotations

import json
import zipfile
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..policy import RELATIONS
from ..sources import records
from ..sources.records import KEY, DataError

MEMBER = "predictions.jsonl"


def duplicate_keys(rows: DataFrame, keys: list[str], order: str = "row_idx") -> DataFrame:
    """Rows whose key an earlier row has, with that row's number as ``first_row``."""
    same = Window.partitionBy(*keys).orderBy(order)
    marked = rows.withColumn("__nth", F.row_number().over(same)).withColumn("first_row", F.first(order).over(same))
    return marked.where("__nth > 1").drop("__nth")


def key_violations(rows: DataFrame) -> DataFrame:
    """``row_idx, problem`` of rows without a usable key or with a key that was seen before."""
    problem = F.lit(None).cast("string")
    for name in reversed(KEY):
        blank = F.col(name).isNull() | records.is_blank(name)
        problem = F.when(blank, F.lit(f"{name} must be a non-empty string")).otherwise(problem)
    bad = rows.select("row_idx", problem.alias("problem")).where("problem is not null")
    copies = duplicate_keys(rows.select("row_idx", *KEY).dropna(subset=list(KEY)), list(KEY))
    said = F.concat(F.lit("duplicate key ("), F.concat_ws(", ", *KEY), F.lit("), first seen on row "), (F.col("first_row") + 1).cast("string"))
    return bad.unionByName(copies.select("row_idx", said.alias("problem")))


def input_violations(rows: DataFrame, relations: tuple[str, ...] = RELATIONS) -> DataFrame:
    """Key violations, and rows of a relation that is not supported."""
    odd = rows.where(F.col("Relation").isNotNull() & ~F.col("Relation").isin(*relations))
    said = F.concat(F.lit("unsupported relation "), F.col("Relation"))
    return key_violations(rows).unionByName(odd.select("row_idx", said.alias("problem")))


def object_violations(rows: DataFrame) -> DataFrame:
    """``row_idx, problem`` of rows whose objects are not a flat list of strings."""
    kind = F.coalesce("objects_kind", F.lit("VOID"))
    empty = (kind == "ARRAY<VOID>") & F.coalesce(F.size("ObjectEntities") == 0, F.lit(False)) & ~F.col("line").rlike(r'"ObjectEntities"\s*:\s*\[\s*null')
    problem = F.when(~kind.startswith("ARRAY"), "ObjectEntities must be a list of strings").when(
        ~((kind == "ARRAY<STRING>") | empty), "ObjectEntities must hold strings only (nested arrays and other values are invalid)"
    )
    nulls = F.col("line").isNotNull() & (kind == "ARRAY<STRING>") & F.coalesce(F.size("ObjectEntities") != F.json_array_length(F.get_json_object("line", "$.ObjectEntities")), F.lit(False))
    return rows.select("row_idx", F.when(nulls, "ObjectEntities must hold strings only").otherwise(problem).alias("problem")).where("problem is not null")


def validate_predictions(lines: DataFrame, source: str, expected_rows: int | None = None) -> DataFrame:
    """Facts of prediction lines; raises at the first broken rule."""
    if expected_rows is not None:
        if isinstance(expected_rows, bool) or expected_rows < 0:
            raise DataError("expected row count must be a non-negative integer")
        found = lines.count()
        if found != expected_rows:
            raise DataError(f"{source}: expected {expected_rows} rows, found {found}")
    rows = records.facts(lines)
    records.require_none(key_violations(rows), source)
    records.require_none(object_violations(rows), source)
    return rows


def distinct_output(output: str | Path, *inputs: str | Path) -> None:
    """Raise if the output is one of the inputs."""
    for path in inputs:
        if Path(path).resolve() == Path(output).resolve():
            raise DataError(f"output path must differ from input path: {output}")


@F.pandas_udf(T.StringType())
def _with_objects(lines: pd.Series, objects: pd.Series) -> pd.Series:
    def one(line: str, found) -> str:
        row = json.loads(line)
        row["ObjectEntities"] = list(found)
        return json.dumps(row, ensure_ascii=False)

    return pd.Series([one(a, b) for a, b in zip(lines, objects, strict=True)], dtype=object)


def with_objects(rows: DataFrame, objects: str) -> DataFrame:
    """``row_idx, line`` with other objects; every other field and the field order stay."""
    return rows.select("row_idx", _with_objects("line", objects).alias("line"))


def blank(rows: DataFrame) -> DataFrame:
    """``row_idx, line`` without answers."""
    return with_objects(rows.withColumn("__none", F.array().cast("array<string>")), "__none")


def missing_relations(rows: DataFrame, wanted: list[str]) -> list[str]:
    """Wanted relations that no row has."""
    asked = rows.sparkSession.createDataFrame([(r,) for r in sorted(set(wanted))], "Relation string")
    return [r[0] for r in asked.join(rows.select("Relation"), "Relation", "left_anti").orderBy("Relation").collect()]


def select_relations(rows: DataFrame, wanted: list[str]) -> DataFrame:
    """``row_idx, line`` of the rows of some relations, answers blanked, in input order."""
    if not wanted or any(not isinstance(r, str) or not r.strip() for r in wanted):
        raise DataError("relation names must be non-empty strings, one at least")
    unknown = missing_relations(rows, wanted)
    if unknown:
        raise DataError(f"relations not found: {', '.join(unknown)}")
    return blank(rows.where(F.col("Relation").isin(*wanted)))


def select_file(spark: SparkSession, source: str, output: str, relations: list[str]) -> int:
    """Write the answer-blanked rows of some relations; returns their number."""
    distinct_output(output, source)
    rows = records.facts(records.read_strict(spark, source))
    records.require_none(key_violations(rows), source)
    lines = select_relations(rows, relations)
    records.write_file(lines, output)
    return lines.count()


def override_violations(base: DataFrame, overrides: DataFrame) -> DataFrame:
    """``row_idx, problem`` of overrides whose key the base lacks or an earlier override has."""
    lost = overrides.join(base.select(*KEY), list(KEY), "left_anti").select("row_idx", F.lit("override key is not in the base").alias("problem"))
    twice = duplicate_keys(overrides.select("row_idx", *KEY), list(KEY)).select("row_idx", F.lit("duplicate override key").alias("problem"))
    return lost.unionByName(twice)


def merge(base: DataFrame, overrides: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Base rows with the value of the override of the same key, where there is one."""
    new = overrides.select(*keys, F.col(value).alias("__new"), F.lit(True).alias("__has"))
    joined = base.join(new, keys, "left")
    return joined.withColumn(value, F.when(F.col("__has"), F.col("__new")).otherwise(F.col(value))).drop("__new", "__has")


def merge_files(spark: SparkSession, base: str, overrides: list[str], output: str) -> int:
    """Write the base with the objects of keyed partial files; returns the number of rows."""
    if not overrides:
        raise DataError("at least one partial override file is required")
    distinct_output(output, base, *overrides)
    rows = validate_predictions(records.read_strict(spark, base), base)
    partial = None
    for k, path in enumerate(overrides):
        one = validate_predictions(records.read_strict(spark, path), path)
        one = one.select((F.col("row_idx") + F.lit(k << 44)).alias("row_idx"), *KEY, "ObjectEntities")
        partial = one if partial is None else partial.unionByName(one)
    records.require_none(override_violations(rows, partial), ", ".join(overrides))
    merged = merge(rows, partial, list(KEY), "ObjectEntities")
    records.write_file(with_objects(merged, "ObjectEntities"), output)
    return merged.count()


def package(spark: SparkSession, source: str, output: str, expected_rows: int | None = None) -> int:
    """Validate predictions and write a ZIP with their bytes as its one member; returns the row count."""
    distinct_output(output, source)
    if Path(output).suffix.lower() != ".zip":
        raise DataError(f"package output must have a .zip extension: {output}")
    rows = validate_predictions(records.read_strict(spark, source), source, expected_rows)
    count = rows.count()
    draft = Path(output).with_name(f".{Path(output).name}.draft")
    draft.parent.mkdir(parents=True, exist_ok=True)
    try:
        with zipfile.ZipFile(draft, "w", zipfile.ZIP_DEFLATED) as box:
            box.write(source, MEMBER)
        with zipfile.ZipFile(draft) as box:
            if box.namelist() != [MEMBER] or box.testzip() is not None:
                raise RuntimeError("the package does not read back")
        records.replace_file(output, [draft.read_bytes()])
    finally:
        draft.unlink(missing_ok=True)
    return count
