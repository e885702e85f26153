"""Reasoning paths: correct, explained answers kept as examples, bound to what they were made from."""

from __future__ import annotations

import json
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from ..functions.jsontext import LISTING, unique_values
from ..policy import NUMERIC
from ..sources import digests, records, traces, training
from ..sources.records import KEY, DataError, require_none
from ..sources.shared import ranked, stored
from . import keyed, scoring

# Fields of a path, fields and constants of its manifest.
FIELDS = ("SubjectEntity", "Relation", "ObjectEntities", "Rationale", "Model", "ModelParametersBillion")
MANIFEST_FIELDS = ("artifact_type", "manifest_version", "model", "model_parameters_billion", "train_canonical_sha256", "traces_sha256", "synthetic_cot_sha256", "row_count")
ARTIFACT, MANIFEST_VERSION, LARGEST_MODEL = "synthetic-cot", 1, 32.0
_SHA = r"^[0-9a-f]{64}$"
_STEPS = T.ArrayType(T.StructType([T.StructField("rationale", T.StringType()), T.StructField("answers", T.ArrayType(T.StringType()))]))


@F.pandas_udf(_STEPS)
def _steps(lines: pd.Series) -> pd.Series:
    def one(line: str) -> list[dict]:
        found = json.loads(line).get("workflow_steps")
        kept = []
        for step in found if isinstance(found, list) else []:
            said, parsed = (step.get("rationale"), step.get("parsed")) if isinstance(step, dict) else (None, None)
            if isinstance(said, str) and said.strip() and isinstance(parsed, list) and all(isinstance(x, str) for x in parsed):
                kept.append({"rationale": said.strip(), "answers": unique_values([x.strip() for x in parsed])})
        return kept

    return lines.map(one, na_action="ignore")


def reasoned_steps(trace_rows: DataFrame) -> DataFrame:
    """``row_idx, step, SubjectEntity, Relation, rationale, answers`` of explained answers."""
    each = trace_rows.select("row_idx", *KEY, F.posexplode(_steps("line")).alias("step", "s"))
    return each.select("row_idx", "step", *KEY, "s.rationale", "s.answers")


def eligible(relation: Column | str = "Relation") -> Column:
    """Whether a scored answer may serve as an example.

    Lists of award winners need no miss among one hit or more, numbers one right answer, other sets to
    be exactly right.
    """
    rel = F.col(relation) if isinstance(relation, str) else relation
    exact = (F.col("p") == 1.0) & (F.col("r") == 1.0)
    listing = (F.col("tp") >= 1) & (F.col("p") == 1.0)
    return F.when(rel.isin(*LISTING), listing).when(rel.isin(*NUMERIC), exact & (F.col("total_pred") == 1) & (F.col("tp") == 1)).otherwise(exact)


def scored_answers(rows: DataFrame, gold: DataFrame, answers: str, keep: tuple[str, ...]) -> DataFrame:
    """``keep`` columns, keys and scores of answers against the gold of their key."""
    golds = scoring.last_by_key(gold).withColumnRenamed("ObjectEntities", "golds")
    ready = scoring.unique_predictions(rows.join(golds, list(KEY)), answers)
    return scoring.with_scores(ready.select(*KEY, *keep, "golds", "surfaces", "pred_keys"), keep=keep)


def provenance(trace_rows: DataFrame) -> tuple[str, float]:
    """The one model and parameter count of all traces."""
    said = trace_rows.select("row_idx", F.get_json_object("line", "$.model").alias("model"), F.get_json_object("line", "$.model_parameters_billion").try_cast("double").alias("size"))
    fine = F.coalesce(F.col("model").rlike(r"\S"), F.lit(False)) & F.coalesce((F.col("size") > 0) & (F.col("size") <= LARGEST_MODEL), F.lit(False))
    require_none(said.where(~fine).select("row_idx", F.lit("a trace must record its model and its size in (0, 32]").alias("problem")), "traces")
    found = said.select("model", "size").distinct().limit(2).collect()
    if len(found) != 1:
        raise DataError("traces must come from exactly one model of one size" if found else "at least one trace is needed")
    return found[0]["model"], found[0]["size"]


def build_paths(gold: DataFrame, trace_rows: DataFrame) -> DataFrame:
    """``row_idx`` and the fields of every distinct correct path, in trace order."""
    model, size = provenance(trace_rows)
    lost = trace_rows.join(gold.select(*KEY), list(KEY), "left_anti")
    require_none(lost.select("row_idx", F.lit("trace row is not present in the training gold").alias("problem")), "traces")
    steps = reasoned_steps(trace_rows).withColumnRenamed("row_idx", "trace_idx")
    scored = scored_answers(steps, gold, "answers", ("trace_idx", "step", "rationale", "answers")).where(eligible())
    same = scored.withColumn("nks", text.keys("answers"))
    nth = F.row_number().over(Window.partitionBy(*KEY, F.to_json("nks"), "rationale").orderBy("trace_idx", "step"))
    first = same.withColumn("nth", nth).where("nth = 1")
    return ranked(first, ["trace_idx", "step"]).select("row_idx", *KEY, F.col("answers").alias("ObjectEntities"), F.col("rationale").alias("Rationale"), F.lit(model).alias("Model"), F.lit(size).alias("ModelParametersBillion"))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _tidy(answers: pd.Series) -> pd.Series:
    return answers.map(lambda xs: unique_values([x.strip() for x in xs if x is not None]), na_action="ignore")


def path_violations(paths: DataFrame, gold: DataFrame, model: str | None = None, size: float | None = None) -> DataFrame:
    """``row_idx, problem`` of paths that break a rule."""
    known = paths.join(gold.select(*KEY).distinct().withColumn("__known", F.lit(True)), list(KEY), "left").withColumn("__tidy", _tidy("ObjectEntities"))
    right = scored_answers(paths, gold, "ObjectEntities", ("row_idx",)).where(eligible()).select("row_idx").withColumn("__right", F.lit(True))
    seen = known.join(right, "row_idx", "left")
    first = paths.orderBy("row_idx").select("Model", "ModelParametersBillion").limit(1).collect()
    model = model if model is not None else (first[0]["Model"] if first else None)
    size = size if size is not None else (first[0]["ModelParametersBillion"] if first else None)
    n = F.col("ModelParametersBillion")
    problem = (
        F.when(F.col("__known").isNull(), "key is not in the training data")
        .when(~F.coalesce(F.col("Rationale").rlike(r"\S"), F.lit(False)), "Rationale must be a non-empty string")
        .when(~F.coalesce(F.col("Model").rlike(r"\S"), F.lit(False)), "Model must be a non-empty string")
        .when(F.col("Model") != F.lit(model), "was generated by another model")
        .when(~F.coalesce((n > 0) & (n <= LARGEST_MODEL), F.lit(False)), "ModelParametersBillion must be in (0, 32]")
        .when(n != F.lit(size), "was generated by a model of another size")
        .when(F.col("ObjectEntities").isNull(), "ObjectEntities must be a flat string list")
        .when(F.col("ObjectEntities") != F.col("__tidy"), "ObjectEntities must be stripped and free of duplicates")
        .when(F.col("__right").isNull(), "answer is not correct")
    )
    return seen.select("row_idx", problem.alias("problem")).where("problem is not null")


def manifest_path(path: str | Path) -> Path:
    """Where the manifest of a path file is."""
    return Path(f"{path}.manifest.json")


def read_manifest(path: str | Path) -> dict:
    """The manifest of a path file; every field must be there and well-formed, and no other."""
    where = manifest_path(path)
    if not where.is_file():
        raise DataError(f"manifest is missing: {where}")
    try:
        found = json.loads(where.read_text(encoding="utf-8"))
    except ValueError as e:
        raise DataError(f"manifest is invalid JSON: {where}") from e
    if not isinstance(found, dict) or set(found) != set(MANIFEST_FIELDS):
        raise DataError(f"manifest must have exactly the fields {sorted(MANIFEST_FIELDS)}")
    size, rows = found["model_parameters_billion"], found["row_count"]
    import re

    rules = {
        "artifact_type": found["artifact_type"] == ARTIFACT,
        "manifest_version": found["manifest_version"] == MANIFEST_VERSION and not isinstance(found["manifest_version"], bool),
        "model": isinstance(found["model"], str) and bool(found["model"].strip()),
        "model_parameters_billion": isinstance(size, (int, float)) and not isinstance(size, bool) and 0 < size <= LARGEST_MODEL,
        "row_count": isinstance(rows, int) and not isinstance(rows, bool) and rows >= 0,
    } | {k: isinstance(found[k], str) and bool(re.match(_SHA, found[k])) for k in MANIFEST_FIELDS if k.endswith("sha256")}
    for name, fine in rules.items():
        if not fine:
            raise DataError(f"manifest field {name} is not valid: {found[name]!r}")
    return found


def _lines(path: str | Path) -> list[dict]:
    return [json.loads(x) for x in Path(path).read_text(encoding="utf-8").splitlines() if x.strip()]


def read_paths(spark: SparkSession, path: str) -> DataFrame:
    """``row_idx`` and the fields of a path file."""
    kinds = "SubjectEntity string, Relation string, ObjectEntities array<string>, Rationale string, Model string, ModelParametersBillion double"
    return records.read_records(spark, path).select("row_idx", F.from_json("line", kinds).alias("r")).select("row_idx", "r.*")


def load_paths(spark: SparkSession, path: str, train_path: str, model: str, size: float, traces_path: str | None = None) -> DataFrame:
    """Paths whose manifest still fits the training file, the model, the file itself (and the traces, if given)."""
    found, before = read_manifest(path), digests.file_digest(path)
    checks = {"model": model, "model_parameters_billion": float(size), "train_canonical_sha256": digests.rows_digest(_lines(train_path)), "synthetic_cot_sha256": before}
    if traces_path is not None:
        checks["traces_sha256"] = digests.folder_digest(traces_path)
    for name, value in checks.items():
        if found[name] != value:
            raise DataError(f"path file does not fit: {name} is {found[name]!r}, not {value!r}")
    rows = stored(read_paths(spark, path))
    if rows.count() != found["row_count"]:
        raise DataError("row count does not match the manifest")
    require_none(path_violations(rows, stored(records.gold_facts(records.read_records(spark, train_path))), model, float(size)), path)
    if digests.file_digest(path) != before:
        raise DataError("path file changed while it was being loaded")
    return rows


def build_file(spark: SparkSession, train_path: str, traces_path: str, output: str, bundled: str | None = None) -> int:
    """Write the correct paths of traces with their manifest, and read them back; returns their number."""
    digests.refuse_held_back(traces_path, "trace")
    for made in (Path(output), manifest_path(output)):
        keyed.distinct_output(made, train_path, traces_path)
        if Path(traces_path).resolve() in made.resolve().parents:
            raise DataError("output must be outside its trace folder")
    before = digests.folder_digest(traces_path)
    gold = stored(training.train_rows(spark, train_path, bundled))
    require_none(keyed.key_violations(gold), train_path)
    trace_rows = traces.read_traces(spark, traces_path)
    model, size = provenance(trace_rows)
    paths = stored(build_paths(gold, trace_rows))
    require_none(path_violations(paths, gold, model, size), "paths")
    records.write_file(records.to_lines(paths), output)
    if digests.folder_digest(traces_path) != before:
        raise DataError("trace source changed while it was being read")
    manifest = {
        "artifact_type": ARTIFACT,
        "manifest_version": MANIFEST_VERSION,
        "model": model,
        "model_parameters_billion": size,
        "train_canonical_sha256": digests.rows_digest(_lines(train_path)),
        "traces_sha256": before,
        "synthetic_cot_sha256": digests.file_digest(output),
        "row_count": paths.count(),
    }
    records.replace_file(manifest_path(output), [json.dumps(manifest, ensure_ascii=False, indent=2, sort_keys=True).encode() + b"\n"])
    return load_paths(spark, output, train_path, model, size, traces_path).count()
