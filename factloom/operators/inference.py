"""Model calls as a staged dataflow: identity, samples, aggregation, completion, verification.

Every stage is one table of requests that a client answers partition by partition.  Answers are written
before anything is derived from them, so no request is made twice and a lost executor costs its
unfinished requests only.  Seeds depend on row, stage and sample alone.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import RunConfig
from ..functions import jsontext, text
from ..policy import POLICIES, RELATIONS, by_relation
from ..sources.shared import stored
from . import aliases, examples, prompts, votes

METHOD = "factloom-1"
# Seed offsets of the stages and of a row, limits of the identity request.
ROW_SEEDS, SAMPLE_SEED, COMPLETION_SEED, VERIFICATION_SEED = 1000, 10, 100, 110
ANCHOR_TOKENS, ANCHOR_TEMPERATURE = 256, 0.2
REWRITES = "array<struct<from: string, to: string>>"
# Why nothing was asked, and what an unreadable verification falls back to.
SKIPPED, FALLBACK = "unanimous-empty-aggregate", "malformed-verifier-response"
ANSWERED = "row_idx long, stage string, sample_idx int, text string, provider string, usage string"


def ask(requests: DataFrame, client, concurrency: int) -> DataFrame:
    """Answers to requests, of which at most ``concurrency`` are in flight at once, over all tasks."""
    parts = max(1, min(int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions")), concurrency))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(max(1, concurrency // parts)) as pool:
            for batch in batches:
                asked = batch.to_dict("records")
                for r in asked:
                    r["messages"] = [dict(role=m["role"], content=m["content"]) for m in r["messages"]]
                    r["seed"] = None if pd.isna(r["seed"]) else int(r["seed"])
                    r["response_format"] = json.loads(r["response_format"]) if r["response_format"] else None
                got = list(pool.map(client.chat, asked))
                yield pd.DataFrame(
                    {
                        "row_idx": batch["row_idx"],
                        "stage": batch["stage"],
                        "sample_idx": batch["sample_idx"],
                        "text": [g["text"] for g in got],
                        "provider": [g.get("provider") for g in got],
                        "usage": [None if g.get("usage") is None else json.dumps(g["usage"]) for g in got],
                    }
                )

    return stored(requests.repartition(parts, "row_idx", "sample_idx").mapInPandas(run, ANSWERED))


def _format(config: RunConfig, reasoned: bool, stage: str):
    if config.generation.output_mode != "json_schema":
        return F.lit(None).cast("string")
    return by_relation({r: json.dumps(jsontext.answer_schema(r, reasoned).response_format(f"{r}_{stage}")) for r in RELATIONS})


def _requests(rows: DataFrame, config: RunConfig, stage: str, sample, offset, messages, response_format, tokens: int | None = None, heat: float | None = None) -> DataFrame:
    g = config.generation
    base = F.lit(None).cast("long") if g.seed is None else F.lit(g.seed) + F.col("row_idx") * ROW_SEEDS + offset
    return rows.select(
        "row_idx",
        F.lit(stage).alias("stage"),
        sample.cast("int").alias("sample_idx"),
        base.cast("long").alias("seed"),
        messages.alias("messages"),
        F.lit(g.temperature if heat is None else heat).alias("temperature"),
        F.lit(g.top_p).alias("top_p"),
        F.lit(g.max_tokens if tokens is None else tokens).alias("max_tokens"),
        response_format.alias("response_format"),
    )


def _spell(values: DataFrame, rows: DataFrame, gold: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Canonical spellings of ``row_idx, pass_idx, pos, value`` by aliases that other rows' gold gives."""
    targets = values.join(rows, "row_idx").select("row_idx", "SubjectEntity", "Relation", text.key("value").alias("alias_key")).where("alias_key <> ''")
    return aliases.canonicalize(values, aliases.left_out_lookup(targets, gold), ["row_idx"])


def _as_values(sets: DataFrame, column: str, pass_idx: int = 0) -> DataFrame:
    return sets.select("row_idx", F.lit(pass_idx).alias("pass_idx"), F.posexplode(column).alias("pos", "value"))


def _as_sets(values: DataFrame, rows: DataFrame, column: str) -> DataFrame:
    listed = values.groupBy("row_idx").agg(F.transform(F.sort_array(F.collect_list(F.struct("pass_idx", "pos", "value"))), lambda s: s["value"]).alias(column))
    return rows.select("row_idx").join(listed, "row_idx", "left").withColumn(column, F.coalesce(column, F.array().cast("array<string>")))


def predict(rows: DataFrame, client, config: RunConfig, gold: DataFrame, shots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Predictions and traces of ``row_idx, SubjectEntity, Relation``.

    ``gold`` has the nested training facts for aliases, ``shots`` the examples for prompts.
    """
    g = config.generation
    strict, policies = g.output_mode == "json_schema", g.policies()
    subject, relation = F.col("SubjectEntity"), F.col("Relation")
    rows = rows.select("row_idx", "SubjectEntity", "Relation")

    # identity
    anchor_format = F.lit(json.dumps(jsontext.ANCHOR.response_format("identity")) if strict else None).cast("string")
    asked = _requests(rows, config, "anchor", F.lit(0), F.lit(0), prompts.anchor_messages(subject, relation, strict), anchor_format, min(g.max_tokens, ANCHOR_TOKENS), ANCHOR_TEMPERATURE)
    got = ask(asked, client, g.concurrency).join(rows, "row_idx")
    anchors = got.withColumn("a", jsontext.anchor("text", "SubjectEntity")).select("row_idx", F.col("a.anchor").alias("anchor"), F.struct("a.description", "a.identity_checks", F.col("text").alias("raw_text"), "a.schema_valid", "provider", "usage").alias("anchor_info"))

    # samples
    count = by_relation({r: p.samples for r, p in policies.items()})
    few = by_relation(g.shots())
    turns = rows.join(anchors, "row_idx").withColumn("sample_idx", F.explode(F.sequence(F.lit(0), count - 1))).withColumn("limit", few)
    focus = F.lit(None).cast("string")
    for r, sides in prompts.FOCI.items():
        focus = F.when(relation == r, F.get(F.array(*[F.lit(s) for s in sides]), F.pmod("sample_idx", F.lit(len(sides))).cast("int"))).otherwise(focus)
    turns = turns.withColumn("focus", focus).withColumn("offset", F.col("sample_idx") * F.greatest(F.col("limit"), F.lit(1)))
    targets = turns.select(F.struct("row_idx", "sample_idx").alias("target"), "SubjectEntity", "Relation", "offset", "limit")
    chosen = examples.select_examples(targets, shots)
    names = F.transform("ObjectEntities", lambda o: F.get(o, F.lit(0)))
    pair = F.array(prompts.message("user", F.concat(F.lit("Subject: "), subject)), prompts.message("assistant", prompts.answer_json(relation, names, F.col("Rationale"))))
    listed = chosen.select("target", F.struct("place", pair.alias("pair"), subject.alias("subject")).alias("s")).groupBy("target").agg(F.sort_array(F.collect_list("s")).alias("ss"))
    shown = listed.select("target.row_idx", "target.sample_idx", F.flatten(F.transform("ss", lambda s: s["pair"])).alias("shots"), F.transform("ss", lambda s: s["subject"]).alias("example_subjects"))
    turns = turns.join(shown, ["row_idx", "sample_idx"], "left").withColumn("shots", F.coalesce(F.col("shots").cast(prompts.MESSAGES), F.array().cast(prompts.MESSAGES)))
    messages = prompts.candidate_messages(subject, relation, F.col("focus"), F.col("anchor"), F.col("shots"), strict)
    asked = _requests(turns, config, "sample", F.col("sample_idx"), F.lit(SAMPLE_SEED) + F.col("sample_idx"), messages, _format(config, True, "sample"))
    read = ask(asked, client, g.concurrency).join(rows, "row_idx").withColumn("a", jsontext.reasoned_answer("text", "Relation"))
    steps = read.join(turns.select("row_idx", "sample_idx", "focus", "example_subjects"), ["row_idx", "sample_idx"])
    usable = read.where("a.usable").select("row_idx", F.col("sample_idx").alias("pass_idx"), F.col("a.parsed").alias("parsed"))
    headers = usable.select("row_idx", "pass_idx")
    raw = usable.select("row_idx", "pass_idx", F.posexplode("parsed").alias("pos", "value"))

    # aggregation
    spelled, rewrites = _spell(raw, rows, gold)
    result = stored(votes.aggregate(rows, headers, spelled, policies)).drop("Relation")
    found = rows.join(result, "row_idx").join(anchors.select("row_idx", "anchor"), "row_idx")

    # completion, where the aggregate is not empty
    due = found.where(relation.isin(*[r for r, p in policies.items() if p.completes]) & (F.size("result") > 0))
    asked = _requests(due, config, "completion", F.lit(0), F.lit(COMPLETION_SEED), prompts.completion_messages(subject, relation, F.col("result"), F.col("anchor"), strict), _format(config, False, "completion"))
    completed = ask(asked, client, g.concurrency).join(rows, "row_idx").withColumn("a", jsontext.plain_answer("text", "Relation"))
    missing = completed.where("a.usable").select("row_idx", F.lit(1).alias("pass_idx"), F.posexplode("a.parsed").alias("pos", "value"))
    whole = _as_values(found, "result").unionByName(missing)
    once, named = _spell(votes_union(whole), rows, gold)
    sets = stored(_as_sets(once, rows, "whole"))

    # verification of what is there
    due = rows.join(sets, "row_idx").where(relation.isin(*[r for r, p in policies.items() if p.verifies]) & (F.size("whole") > 0))
    asked = _requests(due, config, "verification", F.lit(0), F.lit(VERIFICATION_SEED), prompts.verification_messages(subject, relation, F.col("whole"), strict), _format(config, False, "verification"))
    verified = ask(asked, client, g.concurrency).join(rows, "row_idx").withColumn("a", jsontext.plain_answer("text", "Relation"))
    accepted, allowed = _spell(verified.where("a.usable").select("row_idx", F.lit(0).alias("pass_idx"), F.posexplode("a.parsed").alias("pos", "value")), rows, gold)
    accepted = accepted.select("row_idx", text.key("value").alias("nk")).distinct()
    judged = verified.where("a.usable").select("row_idx", F.lit(True).alias("judged"))
    values = _as_values(sets, "whole").withColumn("nk", text.key("value")).join(judged, "row_idx", "left").join(accepted.withColumn("ok", F.lit(True)), ["row_idx", "nk"], "left")
    kept = values.where("judged is null or ok").select("row_idx", "pass_idx", "pos", "value")
    final, last = _spell(kept, rows, gold)
    objects = stored(_as_sets(final, rows, "ObjectEntities"))
    predictions = rows.join(objects, "row_idx")

    # traces
    def step(df: DataFrame, focus=None, subjects=None) -> DataFrame:
        none = F.lit(None)
        return df.select(
            "row_idx",
            F.struct(
                "stage", "sample_idx", "text", F.col("a.parsed").alias("parsed"), F.col("a.usable").alias("usable"), F.col("a.rationale").alias("rationale"), F.col("a.schema_valid").alias("schema_valid"),
                F.lit(g.output_mode).alias("output_mode"), "provider", "usage", (none.cast("string") if focus is None else F.col(focus)).alias("focus"),
                (none.cast("array<string>") if subjects is None else F.col(subjects)).alias("example_subjects"),
            ).alias("step"),
        )

    order = {"sample": 0, "completion": 1, "verification": 2}
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in order.items() for x in kv]), F.col("step.stage"))
    each = step(steps, "focus", "example_subjects").unionByName(step(completed)).unionByName(step(verified))
    ordered = each.select("row_idx", F.struct(rank.alias("rank"), F.col("step.sample_idx").alias("n"), "step").alias("s"))
    taken = ordered.groupBy("row_idx").agg(F.transform(F.array_sort(F.collect_list("s"), lambda x, y: F.when(x["rank"] * 10_000 + x["n"] < y["rank"] * 10_000 + y["n"], -1).otherwise(1)), lambda s: s["step"]).alias("workflow_steps"))
    unread = read.groupBy("row_idx").agg(F.count_if(~F.col("a.usable")).alias("unusable_samples"))
    passes = _pass_lists(headers, spelled).withColumnRenamed("lists", "passes").join(_pass_lists(headers, raw).withColumnRenamed("lists", "raw_passes"), "row_idx")
    renamed, end = _listed(rewrites, "alias_rewrites"), _listed(last, "final_alias_rewrites")
    # what completion and verification did: nothing was asked where the aggregate is empty, and an unreadable
    # answer leaves the set as it is
    none = F.array().cast(REWRITES)
    filled = found.where(relation.isin(*[r for r, p in policies.items() if p.completes])).select("row_idx", F.when(F.size("result") == 0, F.lit(SKIPPED)).alias("skipped"))
    asked_for = filled.join(completed.select("row_idx", "a.parsed", "a.usable"), "row_idx", "left").join(_listed(named, "r"), "row_idx", "left")
    about_completion = F.struct(F.col("parsed").alias("missing"), "usable", F.when(F.col("skipped").isNull(), F.coalesce("r", none)).alias("alias_rewrites"), "skipped")
    completion = asked_for.select("row_idx", about_completion.alias("completion"))
    judgement = verified.select("row_idx", "a.usable").join(_as_sets(kept, rows, "accepted"), "row_idx").join(_listed(allowed, "r"), "row_idx", "left")
    about_verification = F.struct("accepted", F.when(~F.col("usable"), F.lit(FALLBACK)).alias("fallback"), F.col("r").alias("alias_rewrites"))
    verification = judgement.select("row_idx", about_verification.alias("verification"))
    trace = rows
    for part in (anchors.select("row_idx", F.col("anchor_info").alias("anchor")), taken, unread, passes, renamed, end, result, completion, verification, objects.withColumnRenamed("ObjectEntities", "final")):
        trace = trace.join(part, "row_idx", "left")
    trace = trace.withColumn("method", F.lit(METHOD)).withColumn("model", F.lit(config.lm_studio.model)).withColumn("model_parameters_billion", F.lit(float(config.lm_studio.model_parameters_billion)))
    about = F.struct("passes", "raw_passes", "samples", "empty_samples", "unusable_samples", "alias_rewrites", by_relation({r: p.rule for r, p in policies.items()}).alias("method"), *[by_relation({r: getattr(p, k) for r, p in policies.items()}).cast("double").alias(f"{k}_threshold") for k in ("candidate", "none")], "result")
    return predictions, trace.select(
        F.col("row_idx").alias("row_index"), "SubjectEntity", "Relation", "method", "model", "model_parameters_billion", "anchor", "workflow_steps", "unusable_samples", about.alias("self_consistency"), "completion", "verification", "final_alias_rewrites", "final"
    )


def votes_union(values: DataFrame) -> DataFrame:
    """Values that differ by key, first seen first, as one sample."""
    first = values.withColumn("nk", text.key("value")).where("nk <> ''").groupBy("row_idx", "nk").agg(F.min(F.struct("pass_idx", "pos", "value")).alias("f"))
    # places follow the order of passes, then positions, however long a pass is
    place = (F.row_number().over(Window.partitionBy("row_idx").orderBy("f")) - 1).alias("pos")
    return first.select("row_idx", F.lit(0).alias("pass_idx"), place, F.col("f.value").alias("value"))


def _listed(rewrites: DataFrame, name: str) -> DataFrame:
    """``row_idx`` and its rewrites in order, as (from, to)."""
    listed = rewrites.groupBy("row_idx").agg(F.sort_array(F.collect_list(F.struct("pass_idx", "pos", "from", "to"))).alias("r"))
    return listed.select("row_idx", F.transform("r", lambda x: F.struct(x["from"].alias("from"), x["to"].alias("to"))).alias(name))


def _pass_lists(headers: DataFrame, values: DataFrame) -> DataFrame:
    listed = values.groupBy("row_idx", "pass_idx").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "value"))), lambda s: s["value"]).alias("vs"))
    whole = headers.join(listed, ["row_idx", "pass_idx"], "left").withColumn("vs", F.coalesce("vs", F.array().cast("array<string>")))
    return whole.groupBy("row_idx").agg(F.transform(F.sort_array(F.collect_list(F.struct("pass_idx", "vs"))), lambda s: s["vs"]).alias("lists"))


def expected_calls(rows: dict[str, int], samples: dict[str, int], filled: dict[str, int]) -> int:
    """Number of requests of a run: identity and samples for each row, and what non-empty aggregates ask."""
    extra = {r: (p.completes + p.verifies) for r, p in POLICIES.items()}
    return sum(n * (1 + samples[r]) + filled.get(r, 0) * extra[r] for r, n in rows.items())
