"""Model traces: JSON lists, row shards, wrapped lists or JSON lines, read into long samples."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import digests
from .records import KEY, DataError, require_none
from .shared import ranked

# Fields that wrap one trace, and fields that wrap a list of them.
WRAPPED, LISTED = ("raw", "trace"), ("traces", "rows", "results")
SCHEMA = "path string, part int, line string"


def _is_trace(value: object) -> bool:
    return isinstance(value, dict) and all(k in value for k in KEY)


def unwrap(value: object) -> Iterator[dict]:
    """Traces of one JSON value, whatever wraps them."""
    if isinstance(value, dict):
        inner = next((value[k] for k in WRAPPED if _is_trace(value.get(k))), None)
        if inner is not None:
            yield inner
        elif _is_trace(value):
            yield value
        else:
            value = next((value[k] for k in LISTED if isinstance(value.get(k), list)), None)
    if isinstance(value, list):
        yield from (x for x in value if isinstance(x, dict))


def file_traces(text: str, path: str = "") -> Iterator[dict]:
    """Traces of a file's text: one JSON value, or JSON lines."""
    if not text.strip():
        return
    try:
        found = json.loads(text)
    except ValueError:
        for k, line in enumerate(text.splitlines(), 1):
            if line.strip():
                try:
                    yield from unwrap(json.loads(line))
                except ValueError as e:
                    raise DataError(f"invalid JSON in trace file {path} on line {k}") from e
        return
    yield from unwrap(found)


def _split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, text in zip(batch["path"], batch["value"], strict=True):
            rows = [(path, k, json.dumps(t, ensure_ascii=False)) for k, t in enumerate(file_traces(text, path))]
            yield pd.DataFrame(rows, columns=["path", "part", "line"])


def is_folder(spark: SparkSession, path: str) -> bool:
    """Whether a path, of whatever store, is a folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(at):
        raise FileNotFoundError(path)
    return files.getFileStatus(at).isDirectory()


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """``row_idx, line, SubjectEntity, Relation`` of all traces in path order; a folder is read recursively."""
    digests.refuse_held_back(path, "trace")
    reader = spark.read
    if is_folder(spark, path):
        reader = reader.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json")
    files = reader.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    split = files.mapInPandas(_split, SCHEMA)
    named = split.select(*split.columns, *[F.get_json_object("line", f"$.{k}").alias(k) for k in KEY])
    # files in the order of their paths, the traces of a file in their own order
    rows = ranked(named, ["path", "part"]).select("row_idx", "line", *KEY)
    if not rows.limit(1).count():
        raise DataError(f"no trace rows found in {path}")
    return rows


def pass_violations(traces: DataFrame) -> DataFrame:
    """``row_idx, problem`` of traces whose samples are not a non-empty list of lists of strings."""
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json("line"), "$.self_consistency.passes", "variant"))
    size = F.json_array_length(F.get_json_object("line", "$.self_consistency.passes"))
    fine = (F.coalesce(size, F.lit(0)) > 0) & F.coalesce(kind.isin("ARRAY<ARRAY<STRING>>", "ARRAY<ARRAY<VOID>>"), F.lit(False))
    return traces.where(~fine).select("row_idx", F.lit("self_consistency.passes must be a non-empty list of lists of strings").alias("problem"))


def samples(traces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Headers and passes of traces: values stripped, blank ones dropped; raises on malformed samples."""
    require_none(pass_violations(traces), "traces")
    lists = F.from_json(F.get_json_object("line", "$.self_consistency.passes"), "array<array<string>>")
    each = traces.select("row_idx", F.posexplode(lists).alias("pass_idx", "values"))
    values = each.select("row_idx", "pass_idx", F.posexplode("values").alias("pos", "raw"))
    bare = F.regexp_replace("raw", r"^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
    return each.select("row_idx", "pass_idx"), values.select("row_idx", "pass_idx", "pos", bare.alias("value")).where("value <> ''")
