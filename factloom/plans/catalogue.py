"""Queries over the data tables and their DuckDB equivalents, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import jsontext, text
from ..operators import aliases, calibration, examples, keyed, prompts, scoring, sets, votes
from ..policy import RELATIONS
from ..sources.shared import stored
from . import adapters
from .adapters import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    """Register a query under its function's name, with its SQL if there is one."""

    def add(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[run.__name__] = run
        if oracle:
            ORACLES[run.__name__] = oracle
        return run

    return add


def joined(c: str, by: str = "|"):
    """Array of strings as one string, for results that are compared as scalars."""
    return F.array_join(c, by)


# SQL shared by the scoring queries: gold and predicted sets of customers, matched by equality
_PAIRS = """
    gold AS (SELECT DISTINCT o_custkey AS k, 'priority' AS rel, o_orderpriority AS v FROM orders UNION SELECT DISTINCT o_custkey, 'status', o_orderstatus FROM orders),
    pred AS (SELECT DISTINCT o_custkey AS k, 'priority' AS rel, o_orderpriority AS v FROM orders WHERE o_orderstatus = 'F'
             UNION SELECT DISTINCT o_custkey, 'status', o_orderstatus FROM orders WHERE o_orderstatus = 'F'),
    g AS (SELECT k, rel, count(*) AS total_gt FROM gold GROUP BY k, rel),
    p AS (SELECT k, rel, count(*) AS total_pred FROM pred GROUP BY k, rel),
    m AS (SELECT k, rel, count(*) AS tp FROM gold JOIN pred USING (k, rel, v) GROUP BY k, rel),
    n AS (SELECT g.k, g.rel, coalesce(tp, 0) AS tp, coalesce(total_pred, 0) AS total_pred, total_gt FROM g LEFT JOIN p USING (k, rel) LEFT JOIN m USING (k, rel)),
    s AS (SELECT *, CASE WHEN total_pred > 0 THEN tp * 1.0::DOUBLE / total_pred ELSE 1.0::DOUBLE END AS p, tp * 1.0::DOUBLE / total_gt AS r FROM n),
    scores AS (SELECT CAST(k AS VARCHAR) AS SubjectEntity, rel AS Relation, p, r, CASE WHEN p + r = 0 THEN 0.0::DOUBLE ELSE 2 * p * r / (p + r) END AS f1, tp, total_pred, total_gt FROM s)
"""
_LABEL = "CASE WHEN grouping(Relation) = 1 THEN '*** All Relations ***' ELSE Relation END AS Relation"
_SETS = "FROM scores GROUP BY GROUPING SETS ((Relation), ())"


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score_pairs(*adapters.order_facts(spark, sf_dir))


@query(f"WITH {_PAIRS} SELECT SubjectEntity, Relation, round(p, 9) AS p, round(r, 9) AS r, round(f1, 9) AS f1, tp, total_pred, total_gt FROM scores")
def score_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _scores(spark, sf_dir)
    return s.select("SubjectEntity", "Relation", *[F.round(c, 9).alias(c) for c in ("p", "r", "f1")], *[F.col(c).cast("long").alias(c) for c in ("tp", "total_pred", "total_gt")])


@query(f"WITH {_PAIRS} SELECT {_LABEL}, round(avg(p), 9) AS macro_p, round(avg(r), 9) AS macro_r, round(avg(f1), 9) AS macro_f1 {_SETS}")
def macro_by_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = scoring.macro_average(_scores(spark, sf_dir))
    return m.select("Relation", *[F.round(c, 9).alias(c) for c in ("macro_p", "macro_r", "macro_f1")])


_MICRO = f"""WITH {_PAIRS}, t AS (SELECT {_LABEL}, sum(tp) AS tp, sum(total_pred) AS a, sum(total_gt) AS b {_SETS}),
    q AS (SELECT Relation, CASE WHEN a > 0 THEN tp * 1.0::DOUBLE / a ELSE 1.0::DOUBLE END AS p, CASE WHEN b > 0 THEN tp * 1.0::DOUBLE / b ELSE 1.0::DOUBLE END AS r FROM t)
    SELECT Relation, round(p, 9) AS micro_p, round(r, 9) AS micro_r, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 9) AS micro_f1 FROM q"""


@query(_MICRO)
def micro_by_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = scoring.micro_average(_scores(spark, sf_dir))
    return m.select("Relation", *[F.round(c, 9).alias(c) for c in ("micro_p", "micro_r", "micro_f1")])


@query(f"WITH {_PAIRS} SELECT {_LABEL}, round(avg(total_pred), 9) AS avg_preds, count(*) FILTER (WHERE total_pred = 0) AS empty_preds {_SETS}")
def prediction_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.prediction_statistics(_scores(spark, sf_dir)).select("Relation", F.round("avg_preds", 9).alias("avg_preds"), "empty_preds")


@query(
    f"""WITH {_PAIRS}, t AS (SELECT {_LABEL}, avg(p) AS macro_p, avg(r) AS macro_r, avg(f1) AS macro_f1, sum(tp) AS tp, sum(total_pred) AS a, sum(total_gt) AS b,
        avg(total_pred) AS avg_preds, count(*) FILTER (WHERE total_pred = 0) AS empty_preds {_SETS}),
    q AS (SELECT *, CASE WHEN a > 0 THEN tp * 1.0::DOUBLE / a ELSE 1.0::DOUBLE END AS p, CASE WHEN b > 0 THEN tp * 1.0::DOUBLE / b ELSE 1.0::DOUBLE END AS r FROM t)
    SELECT Relation, round_even(macro_p, 3) AS macro_p, round_even(macro_r, 3) AS macro_r, round_even(macro_f1, 3) AS macro_f1, round_even(p, 3) AS micro_p, round_even(r, 3) AS micro_r,
        round_even(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 3) AS micro_f1, round_even(avg_preds, 3) AS avg_preds, CAST(empty_preds AS INTEGER) AS empty_preds FROM q"""
)
def evaluator_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.report(_scores(spark, sf_dir))


@query(
    f"""WITH {_PAIRS}, t AS (SELECT {_LABEL}, count(*) FILTER (WHERE total_pred = 0 AND total_gt = 0) AS tp, count(*) FILTER (WHERE total_pred = 0) AS a, count(*) FILTER (WHERE total_gt = 0) AS b {_SETS}),
    q AS (SELECT Relation, CASE WHEN a > 0 THEN tp * 1.0::DOUBLE / a ELSE 1.0::DOUBLE END AS p, CASE WHEN b > 0 THEN tp * 1.0::DOUBLE / b ELSE 1.0::DOUBLE END AS r FROM t)
    SELECT Relation, p AS zero_p, r AS zero_r, CASE WHEN p + r = 0 THEN 0.0::DOUBLE ELSE 2 * p * r / (p + r) END AS zero_f1 FROM q"""
)
def zero_object_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.zero_object_scores(_scores(spark, sf_dir))


@query(
    """WITH q AS (SELECT l_partkey, median(l_quantity) AS g, round(avg(l_quantity), 6) AS a FROM lineitem GROUP BY l_partkey)
    SELECT CAST(l_partkey AS VARCHAR) AS SubjectEntity, CASE WHEN g <> 0 AND abs(a - g) / g <= 0.05 THEN 1 ELSE 0 END AS tp, 1 AS total_pred FROM q"""
)
def numeric_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score_pairs(*adapters.quantity_facts(spark, sf_dir)).select("SubjectEntity", "tp", "total_pred")


@query(
    """WITH q AS (SELECT l_orderkey, l_linenumber, arg_min(l_quantity, (l_partkey * 1000 + l_suppkey) * 100 + CAST(l_quantity AS BIGINT)) AS x FROM lineitem GROUP BY ALL)
    SELECT l_orderkey AS row_idx, median(x) AS median FROM q GROUP BY l_orderkey"""
)
def median_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    pos = ((F.col("l_partkey") * 1000 + F.col("l_suppkey")) * 100 + F.col("l_quantity").cast("long")).alias("pos")
    passes = lines.select(F.col("l_orderkey").alias("row_idx"), F.col("l_linenumber").alias("pass_idx"), pos, F.col("l_quantity").cast("string").alias("value"))
    return votes.median_values(passes, passes)


_BRANDS = """v AS (SELECT l_suppkey AS s, l_orderkey AS o, min(CAST(l_linenumber AS BIGINT) * 10000000 + l_partkey) AS pos, p_brand AS b
              FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_suppkey, l_orderkey, p_brand),
    n AS (SELECT l_suppkey AS s, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY l_suppkey),
    c AS (SELECT s, b, count(*) AS c, min(struct_pack(o := o, p := pos)) AS fs FROM v GROUP BY s, b)"""


def _supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return votes.tally(*adapters.supplier_votes(spark, sf_dir))


@query(f"WITH {_BRANDS} SELECT n.s AS row_idx, coalesce(string_agg(b, '|' ORDER BY fs) FILTER (WHERE c * 1.0::DOUBLE / n >= 0.05), '') AS result FROM n LEFT JOIN c USING (s) GROUP BY n.s")
def support_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _supplier(spark, sf_dir).withColumn("result", votes.support(0.05)).select("row_idx", joined("result").alias("result"))


@query(f"WITH {_BRANDS} SELECT n.s AS row_idx, coalesce(string_agg(b, '|' ORDER BY fs), '') AS result FROM n LEFT JOIN c USING (s) GROUP BY n.s")
def union_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _supplier(spark, sf_dir).withColumn("result", votes.union()).select("row_idx", joined("result").alias("result"))


_EVENTS = """t AS (SELECT user_id, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS none_n FROM events GROUP BY user_id),
    c AS (SELECT user_id, event_type, count(*) AS c, min(event_id) AS fs FROM events WHERE event_type <> 'error' GROUP BY user_id, event_type)"""


def _user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return votes.tally(*adapters.user_votes(spark, sf_dir))


@query(
    f"""WITH {_EVENTS}, k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY c DESC, fs) AS rn FROM c)
    SELECT t.user_id AS row_idx, CASE WHEN none_n > coalesce(c, 0) AND none_n * 1.0::DOUBLE / n >= 0.2 THEN '' ELSE coalesce(event_type, '') END AS result
    FROM t LEFT JOIN k ON k.user_id = t.user_id AND rn = 1"""
)
def majority_none(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _user(spark, sf_dir).withColumn("result", votes.majority_or_none(0.2)).select("row_idx", joined("result").alias("result"))


@query(
    f"""WITH {_EVENTS}, m AS (SELECT user_id, max(c) AS best FROM c GROUP BY user_id)
    SELECT t.user_id AS row_idx, coalesce(string_agg(event_type, '|' ORDER BY fs) FILTER (WHERE c * 1.0::DOUBLE / n >= 0.2 AND NOT (none_n > coalesce(best, 0) AND none_n * 1.0::DOUBLE / n >= 0.2)), '') AS result
    FROM t LEFT JOIN c USING (user_id) LEFT JOIN m USING (user_id) GROUP BY t.user_id"""
)
def threshold_none(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _user(spark, sf_dir).withColumn("result", votes.threshold_or_none(0.2, 0.2)).select("row_idx", joined("result").alias("result"))


@query(f"WITH {_EVENTS} SELECT t.user_id AS row_idx, event_type AS value, c AS count, round(c * 1.0::DOUBLE / n, 9) AS fraction, none_n FROM t JOIN c USING (user_id)")
def support_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = _user(spark, sf_dir).select("row_idx", "n", "none_n", F.explode("candidates").alias("c"))
    return flat.select("row_idx", F.col("c.value").alias("value"), F.col("c.count").alias("count"), F.round(F.col("c.count") / F.col("n"), 9).alias("fraction"), "none_n")


_PARTS = """e AS (SELECT p_partkey AS i, p_type AS r, lower(regexp_replace(p_brand, '#', ' ')) AS ck, p_brand AS canon, 0 AS ai, p_brand AS a FROM part
        UNION ALL SELECT p_partkey, p_type, lower(regexp_replace(p_brand, '#', ' ')), p_brand, 1, p_name || ' ' || p_size FROM part),
    k AS (SELECT *, trim(lower(regexp_replace(a, '#', ' '))) AS ak FROM e)"""


@query(f"WITH {_PARTS} SELECT r AS Relation, ak AS alias_key, arg_min(canon, struct_pack(i := i, ai := ai)) AS canonical FROM k GROUP BY r, ak HAVING count(DISTINCT ck) = 1")
def alias_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aliases.alias_map(adapters.part_aliases(spark, sf_dir))


@query(
    f"""WITH {_PARTS}, t AS (SELECT DISTINCT i, r, ak FROM k WHERE ai = 1)
    SELECT t.i AS row_idx, t.ak AS alias_key, arg_min(k.canon, struct_pack(i := k.i, ai := k.ai)) AS canonical
    FROM t JOIN k ON k.r = t.r AND k.ak = t.ak AND k.i <> t.i GROUP BY t.i, t.ak HAVING count(DISTINCT k.ck) = 1"""
)
def alias_loo(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = adapters.part_aliases(spark, sf_dir)
    targets = gold.select("row_idx", "SubjectEntity", "Relation", text.key(F.get(F.get("ObjectEntities", F.lit(0)), F.lit(1))).alias("alias_key"))
    return aliases.left_out_lookup(targets, gold)


def _named_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    name = F.concat_ws(" ", "p_name", F.col("p_size").cast("string"))
    return lines.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("row_idx"), F.col("l_linenumber").alias("pass_idx"), (F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("pos"), F.col("p_type").alias("Relation"), name.alias("value")
    )


_CANON = f"""WITH {_PARTS}, m AS (SELECT r, ak, arg_min(canon, struct_pack(i := i, ai := ai)) AS canon FROM k GROUP BY r, ak HAVING count(DISTINCT ck) = 1),
    x AS (SELECT l_orderkey AS o, l_linenumber AS ln, l_partkey * 1000 + l_suppkey AS pos, p_type AS r, p_name || ' ' || p_size AS v FROM lineitem JOIN part ON l_partkey = p_partkey),
    y AS (SELECT o, ln, pos, v, coalesce(canon, v) AS t, trim(lower(regexp_replace(coalesce(canon, v), '#', ' '))) AS nk FROM x LEFT JOIN m ON m.r = x.r AND m.ak = lower(v)),
    z AS (SELECT o, ln, nk, min(struct_pack(pos := pos, v := v, t := t)) AS f FROM y GROUP BY o, ln, nk)"""


@query(f"{_CANON} SELECT o AS row_idx, ln AS pass_idx, f.pos AS pos, f.t AS value FROM z")
def canonicalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    lookup = aliases.alias_map(adapters.part_aliases(spark, sf_dir))
    return aliases.canonicalize(_named_lines(spark, sf_dir), lookup, ["Relation"])[0]


@query(f"{_CANON} SELECT f.v AS \"from\", f.t AS \"to\", count(*) AS times FROM z WHERE f.v <> f.t GROUP BY ALL")
def alias_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    lookup = aliases.alias_map(adapters.part_aliases(spark, sf_dir))
    return aliases.canonicalize(_named_lines(spark, sf_dir), lookup, ["Relation"])[1].groupBy("from", "to").agg(F.count("*").alias("times"))


_NORM = r"trim(regexp_replace(regexp_replace(replace(lower(strip_accents(replace({0}, 'ß', 'ss'))), 'ß', 'ss'), '[''`´‘’]', '', 'g'), '[\s\x1c-\x1f!-/:-@\[-`{{-~]+', ' ', 'g'))"


@query(f"SELECT doc_id, md5({_NORM.format('text')}) AS digest FROM documents")
def normalize_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", text.key("text").alias("k"))
    return docs.select("doc_id", F.md5(F.col("k").cast("binary")).alias("digest"))


@query(f"WITH k AS (SELECT doc_id, {_NORM.format('text')} AS k FROM documents) SELECT min(doc_id) AS doc_id, count(*) AS copies FROM k WHERE k <> '' GROUP BY k")
def dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", text.key("text").alias("k"))
    same = docs.groupBy(F.sha2(F.col("k").cast("binary"), 256).alias("d")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))
    return same.where(F.col("d") != F.sha2(F.lit("").cast("binary"), 256)).select("doc_id", "copies")


@query("SELECT p_partkey, regexp_extract(p_brand, '[0-9]+') AS brand_number, CAST(p_retailprice AS DOUBLE) AS price FROM part")
def numeric_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    spaced = F.replace("p_brand", F.lit("#"), F.lit(" "))
    return part.select("p_partkey", text.leading_number(spaced).alias("brand_number"), text.number(F.col("p_retailprice").cast("string")).alias("price"))


# --- keyed rows, sets, validation ---


@query("SELECT l_orderkey, l_linenumber, count(*) - 1 AS copies FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_key_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("row_idx"))
    return keyed.duplicate_keys(lines, ["l_orderkey", "l_linenumber"]).groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("copies"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def coverage_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return sets.missing_keys(table(spark, sf_dir, "orders"), done, ["o_orderkey"])


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) ORDER BY o_orderkey LIMIT 3")
def first_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.first_rows(coverage_missing(spark, sf_dir), 3, "o_orderkey")


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS times FROM (SELECT o_orderstatus, o_orderpriority FROM orders EXCEPT ALL SELECT 'F', o_orderpriority FROM orders WHERE o_orderstatus <> 'O') GROUP BY ALL")
def multiset_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    left = orders.select("o_orderstatus", "o_orderpriority")
    right = orders.where("o_orderstatus <> 'O'").select(F.lit("F").alias("o_orderstatus"), "o_orderpriority")
    return sets.bag_difference(left, right).groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("times"))


@query("SELECT o_orderkey, o_custkey, CASE WHEN o_totalprice > 400000 THEN 'HIGH' ELSE o_orderpriority END AS o_orderpriority FROM orders")
def merge_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    overrides = orders.where("o_totalprice > 400000").select("o_orderkey", F.lit("HIGH").alias("o_orderpriority"))
    return keyed.merge(orders.select("o_orderkey", "o_custkey", "o_orderpriority"), overrides, ["o_orderkey"], "o_orderpriority")


@query("SELECT o_orderkey, o_orderpriority AS Relation, '' AS objects FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def select_blank(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    line = F.to_json(F.struct(F.col("o_orderpriority").alias("Relation"), F.array(F.col("o_orderstatus")).alias("ObjectEntities")))
    rows = orders.select(F.col("o_orderkey").alias("row_idx"), F.col("o_orderpriority").alias("Relation"), line.alias("line"))
    chosen = keyed.select_relations(rows, ["1-URGENT", "2-HIGH"])
    objects = F.from_json("line", "Relation string, ObjectEntities array<string>")
    return chosen.withColumn("o", objects).select(F.col("row_idx").alias("o_orderkey"), F.col("o.Relation").alias("Relation"), joined("o.ObjectEntities").alias("objects"))


@query("SELECT row_idx, problem FROM (SELECT event_id AS row_idx, CASE WHEN event_type = 'error' THEN 'unsupported relation error' END AS problem FROM events) WHERE problem IS NOT NULL")
def input_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("row_idx"), F.col("event_id").cast("string").alias("SubjectEntity"), F.col("event_type").alias("Relation"))
    known = tuple(r[0] for r in events.select("Relation").distinct().collect() if r[0] != "error")  # a handful of types
    return keyed.input_violations(events, known)


@query("SELECT o_orderkey AS row_idx FROM orders WHERE o_orderstatus <> 'F'")
def resume_remaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_idx"), "o_orderstatus")
    return sets.remaining(orders.select("row_idx"), orders.where("o_orderstatus = 'F'"))


@query("SELECT count(*) AS n, max(o_orderkey) AS highest, count(*) = count(DISTINCT o_orderkey) AND coalesce(max(o_orderkey) + 1, 0) = count(*) AS is_prefix FROM orders")
def prefix_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.prefix_gap(table(spark, sf_dir, "orders"), "o_orderkey")


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def semi_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    accepted = table(spark, sf_dir, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))
    return sets.keep_accepted(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority"), accepted, ["o_custkey"]).drop("o_custkey")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", jsontext.object_field(F.concat(F.lit("Props: "), "props"), "k").cast("long").alias("k"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS VARCHAR) AS answer FROM events")
def json_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat(F.lit("The answer is ["), F.get_json_object("props", "$.k"), F.lit('] I think, not {"x": [}'))
    answers = jsontext.parse_answers(said, F.lit("hasCapacity"))
    return table(spark, sf_dir, "events").select("event_id", F.get(answers, F.lit(0)).alias("answer"))


# --- examples and prompts ---


@query(
    """WITH e AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS rank, count(*) OVER (PARTITION BY source) AS size FROM documents JOIN labels USING (doc_id))
    SELECT doc_id, source, CAST(((rank - 5) % size + size) % size AS BIGINT) AS place FROM e"""
)
def rotate_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapters.labelled_examples(spark, sf_dir)
    ring = Window.partitionBy("Relation")
    ranked = rows.withColumn("rank", F.row_number().over(ring.orderBy("row_idx")) - 1).withColumn("size", F.count("*").over(ring))
    place = examples.rotated_rank(F.col("rank"), F.col("size"), F.lit(5)).cast("long")
    return ranked.select(F.col("row_idx").alias("doc_id"), F.col("Relation").alias("source"), place.alias("place"))


@query(
    """WITH c AS (SELECT doc_id, source, toxic = 1 AS empty FROM documents JOIN labels USING (doc_id)),
    t AS (SELECT doc_id AS target, source, doc_id % 7 AS shift FROM documents),
    m AS (SELECT target, shift, c.doc_id, c.empty, row_number() OVER (PARTITION BY target, c.empty ORDER BY c.doc_id) - 1 AS rank, count(*) OVER (PARTITION BY target, c.empty) AS size,
              count(*) OVER (PARTITION BY target) AS n FROM t JOIN c ON c.source = t.source AND c.doc_id <> t.target),
    r AS (SELECT *, ((rank - shift) % size + size) % size AS k FROM m),
    q AS (SELECT *, CAST(count(*) FILTER (WHERE empty) OVER (PARTITION BY target) AS INTEGER) AS e, CAST(count(*) FILTER (WHERE NOT empty) OVER (PARTITION BY target) AS INTEGER) AS f FROM r),
    a AS (SELECT *, least(CAST(round_even(5.0::DOUBLE * e / n, 0) AS INTEGER), e) AS e1 FROM q),
    b AS (SELECT *, least(5 - e1, f) AS tf FROM a),
    d AS (SELECT *, least(5 - tf, e) AS te FROM b),
    s AS (SELECT *, te + tf AS total FROM d WHERE (empty AND k < te) OR (NOT empty AND k < tf)),
    p AS (SELECT *, list_transform(range(te), lambda i: CAST(greatest(0, floor((total * (2 * i + 1) - te + 2 * te - 1) / (2.0 * te))) AS BIGINT)) AS places FROM s)
    SELECT target, CASE WHEN empty THEN places[k + 1] ELSE list_filter(range(total), lambda x: NOT list_contains(places, x))[k + 1] END AS place, doc_id AS example FROM p"""
)
def few_shot_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    targets = docs.select(
        F.col("doc_id").alias("target"), F.col("doc_id").cast("string").alias("SubjectEntity"), F.col("source").alias("Relation"), (F.col("doc_id") % 7).alias("offset"), F.lit(5).alias("limit")
    )
    chosen = examples.select_examples(targets, adapters.labelled_examples(spark, sf_dir))
    return chosen.select("target", F.col("place").cast("long").alias("place"), F.col("row_idx").alias("example"))


def cases(values: dict[str, str], relation: str = "rel") -> str:
    """SQL that gives the value of a row's relation."""
    quoted = {k: v.replace("'", "''") for k, v in values.items()}
    return f"CASE {relation} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in quoted.items()) + " END"


_RELATION = "[" + ", ".join(f"'{r}'" for r in RELATIONS) + "]"


@query(
    f"""WITH n AS (SELECT n_nationkey, n_name, {_RELATION}[n_nationkey % 6 + 1] AS rel FROM nation)
    SELECT n_nationkey, 'system: {prompts.anchor_lead(False)}' || chr(10) || 'Relation: ' || rel || chr(10) || 'Definition: ' || {cases(prompts.DEFINITIONS)} || chr(10) || 'Tell apart by: '
        || {cases(prompts.IDENTITIES)} || chr(10) || 'user: Subject: ' || n_name AS prompt FROM n"""
)
def prompt_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    relation = F.element_at(F.array(*[F.lit(r) for r in RELATIONS]), F.col("n_nationkey") % 6 + 1)
    nations = table(spark, sf_dir, "nation").withColumn("rel", relation)
    messages = prompts.anchor_messages(F.col("n_name"), F.col("rel"), False)
    return nations.select("n_nationkey", joined(F.transform(messages, lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n").alias("prompt"))


# --- calibration ---

_GRID = """l AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS pass, l_returnflag AS v FROM lineitem),
    h AS (SELECT k, pass, max(CASE WHEN v <> 'N' THEN 1 ELSE 0 END) AS filled FROM l GROUP BY k, pass),
    t AS (SELECT k, count(*) AS n, count(*) - sum(filled) AS none_n FROM h GROUP BY k),
    c AS (SELECT k, v, count(*) AS c FROM l WHERE v <> 'N' GROUP BY k, v),
    m AS (SELECT k, max(c) AS best FROM c GROUP BY k),
    tc AS (SELECT DISTINCT c * 1.0::DOUBLE / n AS tc FROM c JOIN t USING (k) UNION SELECT 0.0::DOUBLE UNION SELECT 1.0::DOUBLE),
    tn AS (SELECT DISTINCT none_n * 1.0::DOUBLE / n AS tn FROM t UNION SELECT 0.0::DOUBLE UNION SELECT 1.0::DOUBLE),
    g AS (SELECT o_orderkey AS k, CASE o_orderstatus WHEN 'F' THEN 'A' WHEN 'P' THEN 'R' END AS gold FROM orders),
    r AS (SELECT t.k, n, none_n, coalesce(best, 0) AS best, gold, CASE WHEN gold IS NULL THEN 0 ELSE 1 END AS total_gt FROM t JOIN g USING (k) LEFT JOIN m USING (k)),
    x AS (SELECT tc, tn, r.k, total_gt, CASE WHEN c.c * 1.0::DOUBLE / r.n >= tc AND NOT (none_n > best AND none_n * 1.0::DOUBLE / r.n >= tn) THEN 1 ELSE 0 END AS keep, CASE WHEN c.v = gold THEN 1 ELSE 0 END AS hit
          FROM r LEFT JOIN c USING (k), tc, tn),
    y AS (SELECT tc, tn, k, total_gt, sum(keep) AS total_pred, sum(keep * hit) AS tp FROM x GROUP BY tc, tn, k, total_gt),
    z AS (SELECT *, CASE WHEN total_pred > 0 THEN tp * 1.0::DOUBLE / total_pred ELSE 1 END AS p, CASE WHEN total_gt > 0 THEN tp * 1.0::DOUBLE / total_gt ELSE 1 END AS r FROM y),
    scores AS (SELECT tc, tn, avg(p) AS macro_p, avg(r) AS macro_r, avg(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END) AS macro_f1, sum(total_pred) AS predicted,
        sum(CASE WHEN total_pred = 0 THEN 1 ELSE 0 END) AS empty FROM z GROUP BY tc, tn)"""


def _calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    headers, passes, gold = adapters.flag_votes(spark, sf_dir)
    tallied = stored(votes.tally(headers, passes).join(gold.select("row_idx", "SubjectEntity", "Relation"), "row_idx").withColumn("empty_n", F.col("none_n")))
    grid = calibration.observed_grid(tallied, ("companyTradesAtStockExchange",))
    return calibration.grid_scores(tallied, gold, grid, {"companyTradesAtStockExchange": "threshold_none"})


@query(f"WITH {_GRID} SELECT round(tc, 9) AS tc, round(tn, 9) AS tn, round(macro_p, 9) AS macro_p, round(macro_r, 9) AS macro_r, round(macro_f1, 9) AS macro_f1, CAST(predicted AS BIGINT) AS predicted, CAST(empty AS BIGINT) AS empty FROM scores")
def threshold_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _calibration(spark, sf_dir)
    return s.select(*[F.round(c, 9).alias(c) for c in ("tc", "tn", "macro_p", "macro_r", "macro_f1")], "predicted", "empty")


@query(
    f"""WITH {_GRID}, k AS (SELECT *, row_number() OVER (ORDER BY round(macro_f1, 12) DESC, round(macro_p, 12) DESC, predicted, tc DESC, tn DESC) AS rn FROM scores)
    SELECT round(tc, 9) AS tc, round(tn, 9) AS tn, round(macro_f1, 9) AS macro_f1, CAST(predicted AS BIGINT) AS predicted FROM k WHERE rn = 1"""
)
def best_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = calibration.best_points(_calibration(spark, sf_dir))
    return best.select(*[F.round(c, 9).alias(c) for c in ("tc", "tn", "macro_f1")], "predicted")


@query(
    """WITH h AS (SELECT o_custkey AS k, o_orderstatus AS pass, count(DISTINCT o_orderpriority) AS c FROM orders GROUP BY o_custkey, o_orderstatus),
    g AS (SELECT o_custkey AS k, count(DISTINCT o_orderpriority) AS priorities, count(DISTINCT o_orderstatus) AS states FROM orders GROUP BY o_custkey),
    r AS (SELECT k, 'priority' AS Relation, max(CASE WHEN c = priorities THEN 1 ELSE 0 END) AS ok FROM h JOIN g USING (k) GROUP BY k
          UNION ALL SELECT k, 'status', max(CASE WHEN states = 1 THEN 1 ELSE 0 END) FROM g GROUP BY k)
    SELECT Relation, round(avg(ok), 9) AS ceiling FROM r GROUP BY Relation UNION ALL SELECT '*** All Relations ***', round(avg(ok), 9) FROM r"""
)
def oracle_ceiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = adapters.order_facts(spark, sf_dir)[0]
    passes = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.collect_set("o_orderpriority").alias("priorities"))
    preds = F.when(F.col("Relation") == "priority", F.col("priorities")).otherwise(F.array("o_orderstatus"))
    ready = gold.join(passes, gold.row_idx == passes.o_custkey).withColumn("preds", preds).withColumnRenamed("ObjectEntities", "golds")
    scored = scoring.with_scores(scoring.unique_predictions(ready, "preds").select("SubjectEntity", "Relation", "o_orderstatus", "golds", "surfaces", "pred_keys"), keep=("o_orderstatus",))
    return scoring.oracle_ceiling(scored).select("Relation", F.round("ceiling", 9).alias("ceiling"))


@query()
def bootstrap_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _scores(spark, sf_dir)
    flipped = s.withColumn("f1", F.greatest(F.col("f1") - F.lit(0.1), F.lit(0.0)))
    return scoring.paired_bootstrap(s, flipped)
