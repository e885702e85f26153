"""Registered queries of the training-data operators and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontaminate, html_extract, lm_score, mixing, near_dup, quality_fm, quality_rules, token_count, toxicity
from .common import table

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.concat(F.lit(chat_format.END), F.lit(chat_format.START), F.lit("assistant ok"))
    roles = F.explode(F.array(F.lit("user"), F.lit("assistant"))).alias("role")
    own = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), roles).select("conv_id", (F.col("role") == "assistant").cast("long").alias("turn"), "role", said.alias("text"))
    return chat_format.digests(chat_format.format_turns(chat_format.row_conversations(rows.unionByName(own))))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.scores(table(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_fm.quality(docs, quality_fm.fit(docs, table(spark, sf_dir, "labels")))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(table(spark, sf_dir, "documents"), TOKENIZER)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(table(spark, sf_dir, "pages"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.toxicity(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_formatting": op1_chat_formatting,
    "op2_decontamination": op2_decontamination,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_token_counts": op5_token_counts,
    "op6_quality_rules": op6_quality_rules,
    "op7_source_mixing": op7_source_mixing,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_html_extraction": op9_html_extraction,
    "op10_toxicity": op10_toxicity,
}
ORACLES: dict[str, str] = {
    "op1_chat_formatting": """
        WITH rows AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
            UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
        ), written AS (
            SELECT *, length(replace(replace(role, chr(92), chr(92) || chr(92)), '<|', '<' || chr(92) || '|')) AS role_chars,
                length(replace(replace(text, chr(92), chr(92) || chr(92)), '<|', '<' || chr(92) || '|')) AS text_chars
            FROM rows
        ), whole AS (
            SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
                coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS loss,
                sum(role_chars + text_chars + length('<|im_start|>') + length('<|im_end|>') + 2) AS formatted_chars
            FROM written GROUP BY conv_id
        )
        SELECT conv_id, n_turns, sha256(said) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
            CAST(formatted_chars AS BIGINT) AS formatted_chars
        FROM whole
    """,
    "op2_decontamination": """
        WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[^\\x20\\x09-\\x0D]+') AS w FROM documents WHERE doc_id IS NOT NULL),
        i AS (SELECT item_id, regexp_extract_all(lower(text), '[^\\x20\\x09-\\x0D]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
        wanted AS (SELECT DISTINCT least(len(w), 5) AS k FROM i WHERE len(w) > 0),
        s AS (SELECT DISTINCT item_id, k, array_to_string(w[p:p + k - 1], ' ') AS g
              FROM (SELECT item_id, w, least(len(w), 5) AS k, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS p FROM i WHERE len(w) > 0)),
        n AS (SELECT item_id, count(*) AS n_item FROM s GROUP BY item_id),
        g AS (SELECT DISTINCT doc_id, k, array_to_string(w[p:p + k - 1], ' ') AS g
              FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, wanted WHERE len(w) >= k))
        SELECT doc_id, item_id, count(*) AS n_shared, n_item, CAST(count(*) AS DOUBLE) / n_item AS containment
        FROM g JOIN s USING (k, g) JOIN n USING (item_id) GROUP BY doc_id, item_id, n_item HAVING 5 * count(*) >= 4 * n_item
    """,
    "op3_lm_scoring": """
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        p AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, w FROM d),
        t AS (SELECT doc_id, i, CASE WHEN i > 1 THEN w[i - 1] END AS u, w[i] AS v FROM p),
        one AS (SELECT v, count(*) AS c FROM t GROUP BY v),
        two AS (SELECT u, v, count(*) AS c FROM t WHERE u IS NOT NULL GROUP BY u, v HAVING count(*) >= 2),
        n AS (SELECT sum(c) AS n FROM one),
        s AS (SELECT t.doc_id, CASE WHEN two.c IS NOT NULL THEN ln(two.c) - ln(cu.c) ELSE ln(cv.c) - ln(n.n) + CASE WHEN t.u IS NULL THEN 0 ELSE ln(0.4) END END AS x
              FROM t JOIN one cv ON cv.v = t.v LEFT JOIN one cu ON cu.v = t.u LEFT JOIN two ON two.u = t.u AND two.v = t.v, n),
        g AS (SELECT doc_id, count(*) AS n_tokens, sum(x) AS x FROM s GROUP BY doc_id)
        SELECT i.doc_id, coalesce(n_tokens, 0) AS n_tokens, round(coalesce(x, 0), 4) AS log_score, round(x / n_tokens, 6) AS mean_log_score
        FROM (SELECT DISTINCT doc_id FROM d) i LEFT JOIN g ON i.doc_id IS NOT DISTINCT FROM g.doc_id
    """,
    "op7_source_mixing": """
        WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
        r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM s),
        w AS (SELECT *, [3.0, 1.0, 2.0][(rank - 1) % 3 + 1]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS ceiling FROM r),
        f AS (SELECT *, sum(ceiling) OVER o AS full_up, sum(weight) OVER o AS spent, 1.5::DOUBLE * sum(source_size) OVER () AS budget, sum(weight) OVER () AS weights
              FROM w WINDOW o AS (ORDER BY ceiling / weight, rank ROWS UNBOUNDED PRECEDING)),
        l AS (SELECT *, (budget - full_up + ceiling) / (weights - spent + weight) AS level FROM f),
        c AS (SELECT arg_min(level, struct_pack(a := ceiling / weight, b := rank)) AS level FROM l WHERE ceiling / weight >= level),
        t AS (SELECT source, source_size, budget, CASE WHEN c.level IS NULL THEN ceiling ELSE least(ceiling, c.level * weight) END AS target FROM l, c),
        q AS (SELECT d.doc_id, d.source, d.size, t.source_size, t.target, t.budget,
                  sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(CAST(d.doc_id AS VARCHAR)), d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS cumulative
              FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
        e AS (SELECT q.*, pass, CASE WHEN target > 0 THEN CAST(cumulative + pass * source_size AS DOUBLE) / target ELSE CAST('inf' AS DOUBLE) END AS finish
              FROM q, (SELECT unnest([0, 1]) AS pass)),
        v AS (SELECT *, sum(size) OVER (ORDER BY finish, source NULLS LAST, cumulative, doc_id, pass ROWS UNBOUNDED PRECEDING) AS total FROM e)
        SELECT doc_id, source, size, source_size, target, CAST(sum(CASE WHEN total <= budget THEN size ELSE 0 END) AS BIGINT) AS taken
        FROM v GROUP BY doc_id, source, size, source_size, target, cumulative
    """,
}
