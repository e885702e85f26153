"""Command line: predict, calibrate, build-cot, select, merge, package, evaluate."""

from __future__ import annotations

import argparse
import sys
import time
from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import SparkSession

from .config import OUTPUT_MODES, load_config, smoke, validated
from .operators import keyed, reasoning, scoring
from .plans import calibrate_files, run
from .policy import CALIBRATABLE
from .sources import records, training
from .sources.client import HttpClient
from .sources.records import DataError


def parser() -> argparse.ArgumentParser:
    """The commands and their options."""
    top = argparse.ArgumentParser(prog="factloom", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, said: str, *options: tuple) -> None:
        sub = commands.add_parser(name, help=said)
        for names, extra in options:
            sub.add_argument(*names, **extra)

    need, many = {"required": True}, {"required": True, "nargs": "+"}
    bundled = (("--bundled",), {"help": f"file that training rows must be copied from (default: {training.BUNDLED}, if it is there)"})
    command(
        "predict", "predict objects with a model",
        (("-c", "--config"), need), (("-i", "--input"), need), (("-o", "--output"), need), (("--resume",), {"action": "store_true"}), (("--runtime-dir",), {}), (("--limit",), {"type": int}),
        (("--dry-run",), {"action": "store_true"}), (("--smoke",), {"action": "store_true", "help": "one cool sample of each relation"}), (("--output-mode",), {"choices": OUTPUT_MODES}), (("--model",), {}),
        (("--model-parameters-billion",), {"type": float}), (("--max-restarts",), {"type": int, "default": 10}), (("--restart-delay",), {"type": float, "default": 10.0}), bundled,
    )
    command(
        "calibrate", "choose thresholds from training traces",
        (("--train",), need), (("--traces",), need), (("--output",), need), (("--relations",), {"nargs": "+", "choices": CALIBRATABLE}), (("--allow-partial",), {"action": "store_true"}), bundled,
    )
    command("build-cot", "keep correct reasoning paths", (("--train",), need), (("--traces",), need), (("--output",), need), bundled)
    command("select", "answer-blanked input of some relations", (("-i", "--input"), need), (("-o", "--output"), need), (("-r", "--relations"), many))
    command("merge", "replace objects by keyed partial files", (("-b", "--base"), need), (("-p", "--partial"), many), (("-o", "--output"), need))
    command("package", "validate predictions and zip them", (("-i", "--input"), need), (("-o", "--output"), need), (("--expected-rows",), {"type": int}))
    command("evaluate", "score predictions against gold", (("-p", "--predictions"), need), (("-g", "--ground_truth"), need))
    return top


def _predict(spark: SparkSession, args: argparse.Namespace, client=None) -> str:
    config = load_config(args.config)
    if (args.model is None) != (args.model_parameters_billion is None):
        raise DataError("a model and its size are one choice: give --model and --model-parameters-billion together")
    if args.model is not None:
        config = replace(config, lm_studio=replace(config.lm_studio, model=args.model, model_parameters_billion=args.model_parameters_billion))
    if args.output_mode is not None:
        config = replace(config, generation=replace(config.generation, output_mode=args.output_mode))
    config = validated(smoke(config) if args.smoke else config)
    if args.max_restarts < 0 or args.restart_delay < 0:
        raise DataError("restarts and their delay must not be negative")
    keyed.distinct_output(args.output, args.input, config.train_data_file, *filter(None, [config.synthetic_cot_file]))
    rows = run.input_rows(spark, args.input, args.limit)
    if args.dry_run:
        records.write_file(run.blank_predictions(rows), args.output)
        return f"Validated {rows.count()} rows; no request was made."
    gold = training.train_rows(spark, config.train_data_file, training.bundled_path(args.bundled))
    shots = run.example_rows(spark, config, gold)
    for attempt in range(args.max_restarts + 1):
        try:
            made = run.run(spark, rows, client or HttpClient(config.lm_studio), config, gold, shots, args.output, args.resume or attempt > 0, args.runtime_dir)
            return f"Wrote {made} predictions to {args.output}"
        except ValueError:
            raise
        except Exception as e:
            if attempt == args.max_restarts:
                raise
            print(f"{type(e).__name__} ended the run; trying again ({attempt + 1} of {args.max_restarts}) after {args.restart_delay:g} s", file=sys.stderr, flush=True)
            time.sleep(args.restart_delay)
    raise AssertionError("unreachable")


def execute(spark: SparkSession, args: argparse.Namespace, client=None) -> str:
    """Carry out a parsed command; returns what to print."""
    if args.command == "predict":
        return _predict(spark, args, client)
    if args.command == "calibrate":
        calibrate_files.calibrate_files(spark, args.train, args.traces, args.output, args.relations, args.allow_partial, training.bundled_path(args.bundled))
        return f"Wrote {args.output}"
    if args.command == "build-cot":
        return f"Retained {reasoning.build_file(spark, args.train, args.traces, args.output, training.bundled_path(args.bundled))} examples in {args.output}"
    if args.command == "select":
        return f"Wrote {keyed.select_file(spark, args.input, args.output, args.relations)} answer-blanked rows to {args.output}"
    if args.command == "merge":
        return f"Wrote {keyed.merge_files(spark, args.base, args.partial, args.output)} merged rows to {args.output}"
    if args.command == "package":
        return f"Packaged {keyed.package(spark, args.input, args.output, args.expected_rows)} predictions in {args.output}"
    gold = records.gold_facts(records.read_strict(spark, args.ground_truth))
    predictions = records.facts(records.read_strict(spark, args.predictions)).select("row_idx", "SubjectEntity", "Relation", "ObjectEntities")
    table = scoring.report(scoring.score_pairs(gold, predictions)).orderBy(scoring.F.col("Relation") == scoring.ALL, "Relation")
    shown = table.toPandas()  # a row for each relation
    return shown.to_string(index=False)


def main(argv: Sequence[str] | None = None) -> int:
    """Entry point; errors of input end with the parser's message."""
    top = parser()
    args = top.parse_args(argv)
    spark = SparkSession.builder.appName("factloom").getOrCreate()
    try:
        print(execute(spark, args))
    except (OSError, ValueError, RuntimeError) as e:
        top.error(str(e))
    return 0
