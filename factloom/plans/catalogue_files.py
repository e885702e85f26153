"""Queries over files, traces, answers and whole runs made from the data tables, with their DuckDB equivalents."""

from __future__ import annotations

import json
import os
import re
import tempfile
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import cli
from ..config import ConfigError, Endpoint, env_values, load_config, parse_config, smoke
from ..functions import jsontext, text
from ..operators import calibration, keyed, reasoning, scoring, sets, votes
from ..policy import POLICIES, RELATIONS
from ..sources import checkpoint, client, digests, records, traces
from ..sources.shared import shared_dir
from . import adapters, run
from .adapters import table
from .catalogue import _EVENTS, _GRID, ORACLES, joined, query

FACT = "SubjectEntity string, Relation string, objects string"


def folder(spark: SparkSession) -> str:
    """A new folder that file commands on the driver can use, with no part that guards on evaluation data refuse."""
    path = shared_dir(spark).removeprefix("file:")
    if not re.match(r"/[^/]|//+[^/]", path) or any(digests._HELD_BACK.search(p.casefold()) for p in path.split("/")):
        path = tempfile.mkdtemp(prefix="facts")
    path = re.sub("^/+", "/", path)
    os.makedirs(path, exist_ok=True)
    return path


def write(spark: SparkSession, path: str, rows: list[dict]) -> str:
    """Write a small file of JSON lines."""
    records.replace_file(path, (json.dumps(r, ensure_ascii=False).encode() + b"\n" for r in rows))
    return path


def read(path: str) -> list[dict]:
    """Rows of a small file of JSON lines."""
    return [json.loads(x) for x in open(path, encoding="utf-8")]


def fact(subject: str, relation: str, objects: list) -> dict:
    return {"SubjectEntity": subject, "Relation": relation, "ObjectEntities": objects}


def shown(spark: SparkSession, rows: list[dict]) -> DataFrame:
    return spark.createDataFrame([(r["SubjectEntity"], r["Relation"], "|".join(r["ObjectEntities"])) for r in rows], FACT)


def nations(spark: SparkSession, sf_dir: str) -> list:
    """The nation table in order; it has the same few rows at every scale."""
    return table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()


def by_part(spark: SparkSession, sf_dir: str, *texts: str) -> DataFrame:
    """``row_idx, line``: parts in turn have each of some texts."""
    pick = F.element_at(F.array(*[F.lit(t) for t in texts]), (F.col("p_partkey") % len(texts) + 1).cast("int"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("row_idx"), pick.alias("line"))


# --- lines ---


@query("SELECT CAST(o_orderkey AS VARCHAR) AS SubjectEntity, o_orderpriority AS Relation, o_orderstatus AS objects FROM orders")
def jsonl_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    rows = orders.select(F.col("o_orderkey").alias("row_idx"), F.col("o_orderkey").cast("string").alias("SubjectEntity"), F.col("o_orderpriority").alias("Relation"), F.array("o_orderstatus").alias("ObjectEntities"))
    path = shared_dir(spark)
    records.write_parts(records.to_lines(rows), path)
    return records.facts(records.read_strict(spark, path)).select("SubjectEntity", "Relation", joined("ObjectEntities").alias("objects"))


@query("SELECT p_brand AS Relation, count(*) AS n FROM part GROUP BY p_brand")
def jsonl_lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.to_json(F.struct(F.col("p_brand").alias("Relation")))
    path = shared_dir(spark)
    table(spark, sf_dir, "part").select(F.explode(F.array(line, F.lit(" "), F.lit(""), F.lit("\t"))).alias("value")).write.text(path)
    return records.facts(records.read_records(spark, path)).groupBy("Relation").agg(F.count("*").alias("n"))


@query(
    """SELECT p_partkey AS row_idx, CASE p_partkey % 4 WHEN 1 THEN 'blank lines are not allowed' WHEN 2 THEN 'invalid JSON' ELSE 'each row must be an object' END AS problem
    FROM part WHERE p_partkey % 4 <> 0"""
)
def line_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.strict_violations(by_part(spark, sf_dir, '{"a": 1}', " ", "nope", "[1]"))


@query(
    """SELECT p_partkey AS row_idx, CASE p_partkey % 4 WHEN 2 THEN 'ObjectEntities must be a list of strings'
        ELSE 'ObjectEntities must hold strings only (nested arrays and other values are invalid)' END AS problem FROM part WHERE p_partkey % 4 <> 0"""
)
def object_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = by_part(spark, sf_dir, *[f'{{"SubjectEntity": "s", "Relation": "r", "ObjectEntities": {x}}}' for x in ('["a"]', '[["a"]]', '"a"', "[1]")])
    return keyed.object_violations(records.facts(lines))


@query("SELECT p_partkey AS row_idx, CAST(2 AS BIGINT) AS groups, CASE WHEN p_partkey % 2 = 0 THEN 'a|c' ELSE 'b|c' END AS firsts, CAST(3 - p_partkey % 2 AS BIGINT) AS aliases FROM part")
def gold_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = by_part(spark, sf_dir, *[f'{{"SubjectEntity": "s", "Relation": "r", "ObjectEntities": {x}}}' for x in ('[["a", "b"], ["c"]]', '["b", "c"]')])
    gold = records.gold_facts(lines)
    firsts = joined(F.transform("ObjectEntities", lambda o: F.get(o, F.lit(0))))
    return gold.select("row_idx", F.size("ObjectEntities").cast("long").alias("groups"), firsts.alias("firsts"), F.size(F.flatten("ObjectEntities")).cast("long").alias("aliases"))


@query("SELECT s_suppkey, s_suppkey % 5 IN (1, 2, 3) AS held_back FROM supplier")
def path_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(x) for x in ("train", "val-run.state", "my_TEST", "Validation.old", "values")])
    path = F.concat(F.lit("runs/"), F.element_at(names, (F.col("s_suppkey") % 5 + 1).cast("int")), F.lit("/rows.json"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", digests.held_back(path).alias("held_back"))


@query("""SELECT '{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}' AS "row", sha256('{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}') AS digest FROM nation""")
def value_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sets.canonical_rows(table(spark, sf_dir, "nation"))
    digest = F.udf(lambda line: digests.value_digest(json.loads(line)))  # a row a nation
    return rows.select("row", digest("row").alias("digest"))


@query(
    """WITH j AS (SELECT n_nationkey AS k, '{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}' AS j FROM nation)
    SELECT sha256(unhex(string_agg(lpad(to_hex(strlen(j)), 16, '0') || hex(encode(j)), '' ORDER BY k))) AS digest FROM j"""
)
def rows_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(digests.rows_digest(r.asDict() for r in nations(spark, sf_dir)),)], "digest string")


@query("SELECT doc_id, least(CAST(1.0 AS DOUBLE), 3.0 / (doc_id % 5)) AS ratio FROM documents WHERE doc_id % 5 > 0 UNION ALL SELECT doc_id, 1.0 FROM documents WHERE doc_id % 5 = 0")
def capped_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", scoring.capped_ratio(F.lit(3), F.col("doc_id") % 5).alias("ratio"))


# --- text ---


@query("WITH x AS (SELECT p_partkey, p_retailprice * 123.457::DOUBLE AS x FROM part) SELECT p_partkey, CASE WHEN x = floor(x) THEN CAST(CAST(x AS BIGINT) AS VARCHAR) ELSE format('{:g}', x) END AS shown FROM x")
def formatted_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.number_text(F.col("p_retailprice") * F.lit(123.457)).alias("shown"))


@query(
    """SELECT p_partkey AS row_idx, p_partkey % 4 <> 3 AS usable, p_partkey % 4 = 0 AS schema_valid, CASE p_partkey % 4 WHEN 0 THEN 'x' WHEN 1 THEN 'x|1' WHEN 2 THEN 'y' END AS parsed FROM part"""
)
def answer_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = by_part(spark, sf_dir, '{"answers": ["x"]}', 'Sure: {"answers": ["x", "X", 1]} ok', 'a list ["y"]', "nothing")
    read = said.withColumn("a", jsontext.plain_answer("line", F.lit("countryLandBordersCountry")))
    return read.select("row_idx", "a.usable", "a.schema_valid", joined("a.parsed").alias("parsed"))


@query("SELECT p_partkey AS row_idx, CASE WHEN p_partkey % 6 IN (0, 2) THEN 'None' ELSE '' END AS answers FROM part")
def explicit_none(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = by_part(spark, sf_dir, *RELATIONS).withColumnRenamed("line", "rel")
    return rows.select("row_idx", joined(jsontext.parse_answers(F.lit('I say ["None"]'), F.col("rel"))).alias("answers"))


@query("SELECT n_nationkey, 'd ' || n_name || ' Identity checks: c; e' AS anchor, CAST(1 AS BOOLEAN) AS schema_valid FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT n_nationkey, 'Exact identity of ' || n_name || '; details are uncertain.', CAST(0 AS BOOLEAN) FROM nation WHERE n_nationkey % 2 = 1")
def identity_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.when(F.col("n_nationkey") % 2 == 0, F.to_json(F.struct(F.concat(F.lit("d "), "n_name").alias("description"), F.array(F.lit("c"), F.lit("e")).alias("identity_checks")))).otherwise(F.lit("no idea"))
    return table(spark, sf_dir, "nation").withColumn("a", jsontext.anchor(said, F.col("n_name"))).select("n_nationkey", "a.anchor", "a.schema_valid")


# --- traces ---


def _passes(key: Column) -> Column:
    return F.struct(F.array(F.array(F.concat(F.lit(" "), key.cast("string"), F.lit("\t"))), F.array().cast("array<string>"), F.array(F.lit("b"), F.lit(" "))).alias("passes"))


@query("SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS row_idx, s_name AS SubjectEntity, 'awardWonBy' AS Relation FROM supplier")
def trace_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    bare = F.struct(F.col("s_name").alias("SubjectEntity"), F.lit("awardWonBy").alias("Relation"), _passes(F.col("s_suppkey")).alias("self_consistency"))
    kind = F.col("s_suppkey") % 4
    rows = table(spark, sf_dir, "supplier").orderBy("s_suppkey").select(
        F.when(kind == 0, bare).alias("raw"), F.when(kind == 1, bare).alias("trace"), F.when(kind == 2, F.array(bare)).alias("results"),
        *[F.when(kind == 3, bare[c]).alias(c) for c in ("SubjectEntity", "Relation", "self_consistency")],
    )
    path = f"{folder(spark)}/traces"
    rows.write.json(path)
    return traces.read_traces(spark, path).select("row_idx", "SubjectEntity", "Relation")


@query("SELECT s_suppkey AS row_idx, CAST(p.pass AS BIGINT) AS pass_idx, CASE p.pass WHEN 0 THEN CAST(s_suppkey AS VARCHAR) ELSE 'b' END AS value FROM supplier, (SELECT unnest([0, 2]) AS pass) p")
def trace_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.to_json(F.struct(_passes(F.col("s_suppkey")).alias("self_consistency")))
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("row_idx"), line.alias("line"))
    return traces.samples(rows)[1].select("row_idx", F.col("pass_idx").cast("long").alias("pass_idx"), "value")


_RULES = f"""WITH {_EVENTS}, m AS (SELECT user_id, max(c) AS best FROM c GROUP BY user_id), d AS (SELECT user_id, median(event_id % 1000) AS m FROM events WHERE event_type <> 'error' GROUP BY user_id),
    k AS (SELECT user_id, event_type AS top FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY c DESC, fs) AS rn FROM c) WHERE rn = 1),
    l AS (SELECT user_id, string_agg(event_type, '|' ORDER BY fs) AS every, string_agg(event_type, '|' ORDER BY fs) FILTER (WHERE c * 1.0::DOUBLE / n >= 0.05) AS few,
              string_agg(event_type, '|' ORDER BY fs) FILTER (WHERE c * 1.0::DOUBLE / n >= 0.3) AS many FROM c JOIN t USING (user_id) GROUP BY user_id),
    s AS (SELECT *, none_n > coalesce(best, 0) AND none_n * 1.0::DOUBLE / n >= 0.5 AS silent FROM t LEFT JOIN m USING (user_id) LEFT JOIN d USING (user_id) LEFT JOIN k USING (user_id) LEFT JOIN l USING (user_id))
    SELECT user_id AS row_idx, coalesce(CASE user_id % 6 WHEN 0 THEN few WHEN 1 THEN CASE WHEN silent THEN '' ELSE many END WHEN 2 THEN every WHEN 5 THEN CASE WHEN silent THEN '' ELSE top END
        ELSE CASE WHEN m = floor(m) THEN CAST(CAST(m AS BIGINT) AS VARCHAR) ELSE CAST(m AS VARCHAR) END END, '') AS result, n AS samples, none_n AS empty_samples FROM s"""


@query(_RULES)
def rule_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    headers, passes = adapters.user_votes(spark, sf_dir)
    relation = F.element_at(F.array(*[F.lit(r) for r in RELATIONS]), (F.col("row_idx") % 6 + 1).cast("int"))
    rows = headers.select("row_idx").distinct().withColumn("Relation", relation)
    numeric = (F.col("row_idx") % 6).isin(*[k for k, p in enumerate(POLICIES.values()) if p.kind == "numeric"])
    worded = passes.withColumn("value", F.when(numeric, (F.col("pass_idx") % 1000).cast("string")).otherwise(F.col("value")))
    made = votes.aggregate(rows, headers, worded, POLICIES)
    return made.select("row_idx", joined("result").alias("result"), "samples", "empty_samples")


@query(
    f"""WITH {_GRID}, k AS (SELECT *, row_number() OVER (ORDER BY round(macro_f1, 12) DESC, round(macro_p, 12) DESC, predicted, tc DESC, tn DESC) AS rn FROM scores)
    SELECT 'companyTradesAtStockExchange' AS Relation, round(tc, 9) AS tc, round(tn, 9) AS tn, round(macro_f1, 9) AS macro_f1, (SELECT count(*) FROM r) AS rows, (SELECT count(*) FROM orders) AS rows_available,
        (SELECT count(*) FROM r) = (SELECT count(*) FROM orders) AS coverage_complete FROM k WHERE rn = 1"""
)
def calibrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    headers, passes, gold = adapters.flag_votes(spark, sf_dir)
    seen = gold.join(headers.select("row_idx").distinct(), "row_idx", "left_semi").select("row_idx", "SubjectEntity", "Relation")
    best = calibration.calibrate(gold, headers, passes, seen, allow_partial=True)[0]
    return best.select("Relation", *[F.round(c, 9).alias(c) for c in ("tc", "tn", "macro_f1")], "rows", "rows_available", "coverage_complete")


@query(
    """SELECT CAST(2 * n_nationkey + k AS BIGINT) AS row_idx, n_name AS SubjectEntity, ['exact', 'near'][k + 1] AS Rationale, CASE k WHEN 0 THEN CAST(100 + 10 * n_nationkey AS VARCHAR) ELSE CAST(104 + 10 * n_nationkey AS VARCHAR) END AS answer
    FROM nation, (SELECT unnest([0, 1]) AS k)"""
)
def reasoning_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The build-cot command: paths with exact or near answers stay, wrong and repeated ones go."""
    home, gold = folder(spark), []
    os.makedirs(f"{home}/traces")
    for r in nations(spark, sf_dir):
        x = 100 + 10 * r["n_nationkey"]
        gold.append(fact(r["n_name"], "hasArea", [[str(x)]]))
        steps = [("exact", x), ("near", x + 4), ("far", 2 * x), ("exact", x), (" ", x)]
        trace = {"SubjectEntity": r["n_name"], "Relation": "hasArea", "model": "m", "model_parameters_billion": 7, "workflow_steps": [{"rationale": said, "parsed": [f" {y} "]} for said, y in steps]}
        write(spark, f"{home}/traces/{r['n_nationkey']:04d}.json", [trace])
    train = write(spark, f"{home}/train.jsonl", gold)
    args = cli.parser().parse_args(["build-cot", "--train", train, "--traces", f"{home}/traces", "--output", f"{home}/paths.jsonl", "--bundled", train])
    cli.execute(spark, args)
    paths = reasoning.load_paths(spark, f"{home}/paths.jsonl", train, "m", 7.0, f"{home}/traces")
    return paths.select("row_idx", "SubjectEntity", "Rationale", joined("ObjectEntities").alias("answer"))


@query("SELECT 'personHasCityOfDeath' AS Relation, round(2.0::DOUBLE / 3, 9) AS none_threshold, 1.0::DOUBLE AS macro_f1, count(*) AS rows FROM nation")
def calibrated_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The calibrate command: half of the rows name a city in two of three samples, half of them in one."""
    home, gold, said = folder(spark), [], []
    for r in nations(spark, sf_dir):
        known = r["n_nationkey"] % 2 == 1
        gold.append(fact(r["n_name"], "personHasCityOfDeath", [["City"]] if known else []))
        said.append({"SubjectEntity": r["n_name"], "Relation": "personHasCityOfDeath", "self_consistency": {"passes": [["City"], ["city"], []] if known else [[], ["Other"], []]}})
    train = write(spark, f"{home}/train.jsonl", gold)
    write(spark, f"{home}/traces.jsonl", said)
    cli.execute(spark, cli.parser().parse_args(["calibrate", "--train", train, "--traces", f"{home}/traces.jsonl", "--output", f"{home}/out.yaml", "--bundled", train]))
    import yaml

    with open(f"{home}/out.yaml", encoding="utf-8") as stream:
        found = yaml.safe_load(stream)["calibration_provenance"]["results"]
    return spark.createDataFrame([(k, round(v["none_threshold"], 9), v["train_macro_f1"], v["rows"]) for k, v in found.items()], "Relation string, none_threshold double, macro_f1 double, rows long")


# --- keyed files and commands ---


_KEYED = "CASE WHEN n_nationkey % 2 = 0 THEN 'hasArea' ELSE 'awardWonBy' END"


def _base(spark: SparkSession, sf_dir: str) -> list[dict]:
    return [fact(r["n_name"], "awardWonBy" if r["n_nationkey"] % 2 else "hasArea", [str(r["n_nationkey"])]) for r in nations(spark, sf_dir)]


@query(f"SELECT n_name AS SubjectEntity, {_KEYED} AS Relation, '' AS objects FROM nation WHERE n_nationkey % 2 = 0")
def selected_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    home = folder(spark)
    write(spark, f"{home}/in.jsonl", _base(spark, sf_dir))
    cli.execute(spark, cli.parser().parse_args(["select", "-i", f"{home}/in.jsonl", "-o", f"{home}/out.jsonl", "-r", "hasArea"]))
    return shown(spark, read(f"{home}/out.jsonl"))


@query(f"SELECT n_name AS SubjectEntity, {_KEYED} AS Relation, CASE n_nationkey % 3 WHEN 0 THEN 'new|objects' WHEN 1 THEN '' ELSE CAST(n_nationkey AS VARCHAR) END AS objects FROM nation")
def packaged_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The merge and package commands: two partial files over a base, zipped and read back."""
    home, base = folder(spark), _base(spark, sf_dir)
    write(spark, f"{home}/base.jsonl", base)
    for k, objects in enumerate((["new", "objects"], [])):
        write(spark, f"{home}/part{k}.jsonl", [r | {"ObjectEntities": objects} for n, r in enumerate(base) if n % 3 == k])
    cli.execute(spark, cli.parser().parse_args(["merge", "-b", f"{home}/base.jsonl", "-p", f"{home}/part0.jsonl", f"{home}/part1.jsonl", "-o", f"{home}/all.jsonl"]))
    cli.execute(spark, cli.parser().parse_args(["package", "-i", f"{home}/all.jsonl", "-o", f"{home}/all.zip", "--expected-rows", str(len(base))]))
    with zipfile.ZipFile(f"{home}/all.zip") as box:
        return shown(spark, [json.loads(x) for x in box.read(keyed.MEMBER).decode().splitlines()])


@query(ORACLES["evaluator_report"])
def evaluated_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold, predictions = (shared_dir(spark) for _ in range(2))
    for path, rows in zip((gold, predictions), adapters.order_facts(spark, sf_dir), strict=True):
        records.write_parts(records.to_lines(rows), path)
    said = records.facts(records.read_strict(spark, predictions)).select("row_idx", "SubjectEntity", "Relation", "ObjectEntities")
    return scoring.report(scoring.score_pairs(records.gold_facts(records.read_strict(spark, gold)), said))


@query(f"SELECT n_name AS SubjectEntity, {_KEYED} AS Relation, '' AS objects FROM nation ORDER BY n_nationkey LIMIT 7")
def dry_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predict command without calls; its limit is the feature."""
    home = folder(spark)
    write(spark, f"{home}/in.jsonl", _base(spark, sf_dir))
    write(spark, f"{home}/conf.yaml", [{"lm_studio": {"model": "m", "model_parameters_billion": 7}, "train_data_file": f"{home}/train.jsonl"}])
    cli.execute(spark, cli.parser().parse_args(["predict", "-c", f"{home}/conf.yaml", "-i", f"{home}/in.jsonl", "-o", f"{home}/out.jsonl", "--dry-run", "--limit", "7"]))
    return shown(spark, read(f"{home}/out.jsonl"))


@query("SELECT n_nationkey, printf('%06d.json', n_nationkey) AS shard, n_name AS SubjectEntity FROM nation")
def row_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, home = nations(spark, sf_dir), folder(spark)
    shards = checkpoint.RowShards(f"{home}/state", {"a": 1}, [(r["n_name"], "hasArea") for r in rows])
    shards.open()
    for k, r in enumerate(rows):
        own = fact(r["n_name"], "hasArea", [])
        for _ in range(2):  # the same row again is fine
            shards.write(k, own, own | {"row_index": k})
    found = [(r["row_index"], shards.path(r["row_index"]).name, r["prediction"]["SubjectEntity"]) for r in shards.load()]
    return spark.createDataFrame(found, "n_nationkey int, shard string, SubjectEntity string")


@query("SELECT DISTINCT p_size, p_size <= 20 AS valid, CAST(CASE WHEN p_size <= 20 THEN 1 END AS BIGINT) AS smoke_samples FROM part")
def configurations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with each sample count that a part's size gives; 20 is the highest that is allowed."""
    home, found = folder(spark), []
    for r in table(spark, sf_dir, "part").select("p_size").distinct().collect():  # sizes are fifty at most
        n = r["p_size"]
        write(spark, f"{home}/conf.yaml", [{"lm_studio": {"model": "m", "model_parameters_billion": 7}, "generation": {"samples": dict.fromkeys(RELATIONS, n)}}])
        try:
            found.append((n, True, max(smoke(load_config(f"{home}/conf.yaml")).generation.samples.values())))
        except ConfigError:
            found.append((n, False, None))
    return spark.createDataFrame(found, "p_size int, valid boolean, smoke_samples long")


@query("SELECT 'KEY_' || n_nationkey AS name, n_name AS value FROM nation")
def environment_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "# keys\n" + "".join(f"KEY_{r['n_nationkey']} = \"{r['n_name']}\"\nKEY_{r['n_nationkey']}=later\n" for r in nations(spark, sf_dir)) + "no sign\n"
    return spark.createDataFrame(list(env_values(text).items()), "name string, value string")


@query("SELECT r_regionkey, CAST(r_regionkey + 1 AS BIGINT) AS requests, r_name AS answer FROM region")
def client_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A server that fails as often as the region's key before it answers."""
    found = []
    for r in table(spark, sf_dir, "region").collect():
        failures = [(503, {}, "down"), (200, {}, "no json"), (200, {}, '{"error": "odd"}'), (200, {}, '{"choices": []}'), (429, {"Retry-After": "0"}, "")][: r["r_regionkey"]]
        replies = [*failures, (200, {}, json.dumps({"choices": [{"message": {"content": r["r_name"]}}]}))]
        sent = []

        def send(url, payload, token, timeout, replies=replies, sent=sent):
            sent.append(payload)
            return replies[len(sent) - 1]

        asked = client.HttpClient(Endpoint(model="m"), send, lambda seconds: None)
        answer = asked.chat({"messages": [], "temperature": 0.5, "top_p": 0.9, "max_tokens": 5})
        found.append((r["r_regionkey"], len(sent), answer["text"]))
    return spark.createDataFrame(found, "r_regionkey int, requests long, answer string")


# --- a whole run ---


@query(
    """WITH n AS (SELECT *, n_nationkey AS k, n_regionkey % 2 = 0 AS numeric, n_nationkey % 5 = 0 AS silent FROM nation)
    SELECT CAST(k AS BIGINT) AS row_idx, CASE WHEN numeric THEN CAST(100 * k + 10 AS VARCHAR) WHEN silent THEN '' WHEN k % 2 = 0 THEN 'A' || n_name || '|C' || n_name ELSE 'A' || n_name || '|B' || n_name || '|C' || n_name END AS objects,
        CASE WHEN numeric OR silent THEN NULL ELSE 'C' || n_name END AS missing, CASE WHEN NOT numeric AND silent THEN 'unanimous-empty-aggregate' END AS skipped,
        CASE WHEN numeric OR silent THEN NULL WHEN k % 2 = 0 THEN 'A' || n_name || '|C' || n_name ELSE 'A' || n_name || '|B' || n_name || '|C' || n_name END AS accepted,
        CASE WHEN NOT numeric AND NOT silent AND k % 2 = 1 THEN 'malformed-verifier-response' END AS fallback, CAST(CASE WHEN numeric OR silent THEN 3 ELSE 2 END AS BIGINT) AS samples,
        CAST(CASE WHEN numeric OR silent THEN 0 ELSE 1 END AS BIGINT) AS unusable, CASE WHEN numeric THEN 'median' ELSE 'union' END AS method FROM n"""
)
def replayed_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run over recorded answers: its predictions and traces as its files have them."""
    home, texts, rows = folder(spark), {}, []
    for r in nations(spark, sf_dir):
        k, name, numeric = r["n_nationkey"], r["n_name"], r["n_regionkey"] % 2 == 0
        rows.append((k, name, "hasCapacity" if numeric else "countryLandBordersCountry"))
        silent = k % 5 == 0

        def said(*objects: str) -> str:
            return json.dumps({"rationale": "r", "answers": list(objects)})

        answers = [said(f"{100 * k + x:,} seats") for x in (0, 10, 30)] if numeric else [said()] * 3 if silent else [said("A" + name), "unreadable", said("B" + name, "A" + name)]
        texts[(k, "anchor", 0)] = json.dumps({"description": "d", "identity_checks": ["c"]})
        texts |= {(k, "sample", n): t for n, t in enumerate(answers)}
        texts[(k, "completion", 0)] = json.dumps({"answers": ["C" + name]})
        texts[(k, "verification", 0)] = json.dumps({"answers": ["A" + name, "c" + name]}) if k % 2 == 0 else "unreadable"
    config = parse_config({"lm_studio": {"model": "m", "model_parameters_billion": 7}, "generation": {"samples": dict.fromkeys(RELATIONS, 3), "concurrency": 4, "few_shot": 1}})
    asked = spark.createDataFrame(rows, "row_idx long, SubjectEntity string, Relation string")
    gold = spark.createDataFrame([(0, "Hall", "hasCapacity", [["9"]]), (1, "Land", "countryLandBordersCountry", [["Other land"]])], "row_idx long, SubjectEntity string, Relation string, ObjectEntities array<array<string>>")
    run.run(spark, asked, client.ReplayClient(texts), config, gold, gold.withColumn("Rationale", F.lit(None).cast("string")), f"{home}/out.jsonl")
    with open(f"{home}/raw/out.raw.json", encoding="utf-8") as stream:
        raw = json.load(stream)

    def listed(values: list | None) -> str | None:
        return None if values is None else "|".join(values)

    found = []
    for said, t in zip(read(f"{home}/out.jsonl"), raw, strict=True):
        completion, verification, own = t["completion"] or {}, t["verification"] or {}, t["self_consistency"]
        found.append((t["row_index"], listed(said["ObjectEntities"]), listed(completion.get("missing")), completion.get("skipped"), listed(verification.get("accepted")), verification.get("fallback"), own["samples"], t["unusable_samples"], own["method"]))
    return spark.createDataFrame(found, "row_idx long, objects string, missing string, skipped string, accepted string, fallback string, samples long, unusable long, method string")
