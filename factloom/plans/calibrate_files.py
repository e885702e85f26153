"""Calibration from files, written as a configuration snippet with its provenance."""

from __future__ import annotations

from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import SparkSession

from ..operators import calibration
from ..policy import POLICIES, TOLERANCE
from ..sources import digests, records, traces
from ..sources.training import train_rows

TIE_BREAK = "best macro F1, then macro precision, then fewest predicted objects, then the higher thresholds"


def calibrate_files(spark: SparkSession, train_path: str, traces_path: str, output: str, relations: list[str] | None = None, allow_partial: bool = False, bundled: str | None = None) -> dict:
    """Write the best thresholds of traces as YAML; returns what was written."""
    import yaml

    digests.refuse_held_back(traces_path, "trace")
    gold = train_rows(spark, train_path, bundled)
    rows = traces.read_traces(spark, traces_path)
    headers, passes = traces.samples(rows)
    best, sizes = calibration.calibrate(gold, headers, passes, rows.select("row_idx", "SubjectEntity", "Relation"), relations, allow_partial)
    found = {r["Relation"]: r.asDict() for r in best.collect()}  # a row for each of three relations at most
    grids = {r["Relation"]: {k: r[k] for k in ("candidate_thresholds", "none_thresholds")} for r in sizes.collect()}
    with_candidate = {r: x["tc"] for r, x in found.items() if POLICIES[r].rule != "majority_none"}
    with_none = {r: x["tn"] for r, x in found.items() if POLICIES[r].none is not None}
    results = {
        r: ({"candidate_threshold": with_candidate[r]} if r in with_candidate else {})
        | ({"none_threshold": with_none[r]} if r in with_none else {})
        | {
            "train_macro_p": x["macro_p"], "train_macro_r": x["macro_r"], "train_macro_f1": x["macro_f1"], "rows": x["rows"], "train_rows_available": x["rows_available"],
            "coverage_complete": x["coverage_complete"], "predicted_entities": int(x["predicted"]), "empty_predictions": int(x["empty"]),
        }
        for r, x in found.items()
    }
    snippet = {
        "generation": {"candidate_thresholds": with_candidate, "abstention_thresholds": with_none},
        "calibration_provenance": {
            "method": "grid search over observed fractions of training traces",
            "objective": "macro F1 over rows of each relation",
            "numeric_tolerance": TOLERANCE,
            "generated_at_utc": datetime.now(UTC).isoformat(),
            "train_gold_path": str(train_path),
            "train_gold_sha256": digests.source_digest(train_path),
            "raw_traces_path": str(traces_path),
            "raw_traces_sha256": digests.source_digest(traces_path),
            "tie_break": TIE_BREAK,
            "allow_partial": allow_partial,
            "grid_sizes": grids,
            "results": results,
        },
    }
    records.replace_file(Path(output), [yaml.safe_dump(snippet, sort_keys=False, allow_unicode=True).encode()])
    return snippet
