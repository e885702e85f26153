"""A whole run: verified inputs, resumable chunks of rows, result files."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import RunConfig
from ..operators import inference, keyed, reasoning
from ..sources import digests, records
from ..sources.checkpoint import RowShards
from ..sources.records import DataError, require_none

CHUNK_ROWS = 256
POLICY_FILES = ("functions/jsontext.py", "functions/text.py", "operators/inference.py", "operators/prompts.py", "operators/votes.py", "policy.py")


def input_rows(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """``row_idx, SubjectEntity, Relation, line`` of the first input rows, checked."""
    rows = records.facts(records.read_records(spark, path))
    if limit is not None:
        if limit < 0:
            raise DataError("limit cannot be negative")
        rows = rows.where(F.col("row_idx") < limit)
    require_none(keyed.input_violations(rows), path)
    return rows.select("row_idx", "SubjectEntity", "Relation", "line")


def blank_predictions(rows: DataFrame) -> DataFrame:
    """``row_idx, line`` of predictions without objects."""
    return records.to_lines(rows.select("row_idx", "SubjectEntity", "Relation", F.array().cast("array<string>").alias("ObjectEntities")))


def example_rows(spark: SparkSession, config: RunConfig, gold: DataFrame) -> DataFrame:
    """Training facts as examples, after the reasoning paths if there are any."""
    plain = gold.withColumn("Rationale", F.lit(None).cast("string"))
    if not config.synthetic_cot_file:
        return plain
    digests.refuse_held_back(config.synthetic_cot_file, "reasoning path")
    model = config.lm_studio
    paths = reasoning.load_paths(spark, config.synthetic_cot_file, config.train_data_file, model.model, model.model_parameters_billion)
    if not paths.limit(1).count():
        raise DataError("the reasoning path file contains no usable examples")
    nested = paths.select((F.col("row_idx") - F.lit(1 << 62)).alias("row_idx"), "SubjectEntity", "Relation", F.transform("ObjectEntities", lambda x: F.array(x)).alias("ObjectEntities"), "Rationale")
    return nested.unionByName(plain)


def policy_digest() -> str:
    """SHA-256 of the code that decides what a row's result is."""
    digest = hashlib.sha256()
    home = Path(__file__).resolve().parents[1]
    for name in POLICY_FILES:
        digest.update(name.encode())
        digest.update((home / name).read_bytes())
    return digest.hexdigest()


def state_folder(output: Path, runtime_dir: str | None) -> Path:
    """Where the finished rows of an output are kept."""
    mark = hashlib.sha256(str(output.resolve()).encode()).hexdigest()[:16]
    return (Path(runtime_dir) if runtime_dir else output.parent / ".run-state") / f"{output.stem}-{mark}.{inference.METHOD}.state"


def run(spark: SparkSession, rows: DataFrame, client, config: RunConfig, gold: DataFrame, shots: DataFrame, output: str, resume: bool = False, runtime_dir: str | None = None, chunk: int = CHUNK_ROWS) -> int:
    """Predict all rows in chunks, each stored when it is done; returns the number of rows.

    A chunk's rows are few enough to pass through the driver; the calls they need run on executors.
    """
    target = Path(output)
    keys = [(r["SubjectEntity"], r["Relation"]) for r in rows.orderBy("row_idx").select("SubjectEntity", "Relation").toLocalIterator()]
    about = asdict(config)
    about["lm_studio"].pop("api_key", None)
    shown = hashlib.sha256()
    for r in shots.orderBy("row_idx").select(F.to_json(F.struct(*sorted(shots.columns))).alias("j")).toLocalIterator():
        shown.update(r["j"].encode() + b"\n")
    shards = RowShards(state_folder(target, runtime_dir), about | {"method": inference.METHOD, "policy_sha256": policy_digest(), "prompt_examples_sha256": shown.hexdigest()}, keys)
    if not resume and shards.manifest_path.exists():
        raise DataError(f"finished rows are stored in {shards.root}; resume, or choose another output or runtime folder")
    done = len(shards.load()) if resume else 0
    shards.open()
    while done < len(keys):
        part = rows.where((F.col("row_idx") >= done) & (F.col("row_idx") < done + chunk))
        predictions, traces = inference.predict(part, client, config, gold, shots)
        raw = {r["row_index"]: json.loads(r["j"]) for r in traces.select("row_index", F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).collect()}
        for r in predictions.orderBy("row_idx").collect():
            shards.write(r["row_idx"], {"SubjectEntity": r["SubjectEntity"], "Relation": r["Relation"], "ObjectEntities": list(r["ObjectEntities"])}, raw[r["row_idx"]])
        done += chunk
    stored = shards.load()
    records.replace_file(target, (json.dumps(r["prediction"], ensure_ascii=False).encode() + b"\n" for r in stored))
    records.replace_file(target.parent / "raw" / f"{target.stem}.raw.json", [json.dumps([r["raw"] for r in stored], ensure_ascii=False, indent=2).encode()])
    records.replace_file(shards.root / "complete.json", [json.dumps({"completed_rows": len(stored), "total_rows": len(keys)}, indent=2).encode()])
    return len(stored)
