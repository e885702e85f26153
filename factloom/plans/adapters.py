"""Fact-shaped views of the data tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_facts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Gold and predicted sets of customers: priorities and statuses of all orders against finished ones.

    Two relations; the subject is the customer's key as text.
    """
    orders = table(spark, sf_dir, "orders")
    gold, predicted = [], []
    for relation, column in (("priority", "o_orderpriority"), ("status", "o_orderstatus")):
        sets = F.sort_array(F.collect_set(column))
        finished = F.sort_array(F.collect_set(F.when(F.col("o_orderstatus") == "F", F.col(column))))
        both = orders.groupBy("o_custkey").agg(sets.alias("all"), finished.alias("done"))
        subject = F.col("o_custkey").cast("string").alias("SubjectEntity")
        gold.append(both.select(F.col("o_custkey").alias("row_idx"), subject, F.lit(relation).alias("Relation"), F.transform("all", lambda x: F.array(x)).alias("ObjectEntities")))
        predicted.append(both.select(F.col("o_custkey").alias("row_idx"), subject, F.lit(relation).alias("Relation"), F.col("done").alias("ObjectEntities")))
    return gold[0].unionByName(gold[1]), predicted[0].unionByName(predicted[1])


def quantity_facts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Gold and predicted numbers of parts: median against mean quantity, as text."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.median("l_quantity").alias("m"), F.round(F.avg("l_quantity"), 6).alias("a"))
    base = lines.select(F.col("l_partkey").alias("row_idx"), F.col("l_partkey").cast("string").alias("SubjectEntity"), F.lit("hasCapacity").alias("Relation"), "m", "a")
    keys = ["row_idx", "SubjectEntity", "Relation"]
    return base.select(*keys, F.array(F.array(F.col("m").cast("string"))).alias("ObjectEntities")), base.select(*keys, F.array(F.col("a").cast("string")).alias("ObjectEntities"))


def user_votes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Samples of users: every event votes for its type, an error for nothing."""
    events = table(spark, sf_dir, "events")
    headers = events.select(F.col("user_id").alias("row_idx"), F.col("event_id").alias("pass_idx"))
    passes = events.where("event_type <> 'error'").select(
        F.col("user_id").alias("row_idx"), F.col("event_id").alias("pass_idx"), F.lit(0).alias("pos"), F.col("event_type").alias("value")
    )
    return headers, passes


def supplier_votes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Samples of suppliers: every order is a sample, the brands of its lines are the candidates."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_partkey", "l_linenumber")
    named = lines.join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    pos = (F.col("l_linenumber") * F.lit(10_000_000) + F.col("l_partkey")).cast("long")
    headers = lines.select(F.col("l_suppkey").alias("row_idx"), F.col("l_orderkey").alias("pass_idx")).distinct()
    passes = named.select(F.col("l_suppkey").alias("row_idx"), F.col("l_orderkey").alias("pass_idx"), pos.alias("pos"), F.col("p_brand").alias("value"))
    return headers, passes


def part_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested gold of parts: brand first, then name and size as its alias; the relation is the type."""
    part = table(spark, sf_dir, "part")
    alias = F.concat_ws(" ", "p_name", F.col("p_size").cast("string"))
    return part.select(
        F.col("p_partkey").alias("row_idx"), F.col("p_partkey").cast("string").alias("SubjectEntity"), F.col("p_type").alias("Relation"), F.array(F.array("p_brand", alias)).alias("ObjectEntities")
    )


def labelled_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Example rows from labelled documents: relation is the source, toxic ones have no objects."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    objects = F.when(F.col("toxic") == 1, F.array().cast("array<array<string>>")).otherwise(F.array(F.array(F.col("lang"))))
    return docs.select(F.col("doc_id").alias("row_idx"), F.col("doc_id").cast("string").alias("SubjectEntity"), F.col("source").alias("Relation"), objects.alias("ObjectEntities"))


def flag_votes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Samples of orders and their gold: each line number is a sample of return flags, ``N`` for nothing.

    Gold is one flag for finished and pending orders and nothing for open ones.
    """
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("row_idx"), F.col("l_linenumber").alias("pass_idx"), F.col("l_returnflag").alias("value"))
    flag = F.when(F.col("o_orderstatus") == "F", "A").when(F.col("o_orderstatus") == "P", "R")
    none = F.array().cast("array<array<string>>")
    gold = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("row_idx"),
        F.col("o_orderkey").cast("string").alias("SubjectEntity"),
        F.lit("companyTradesAtStockExchange").alias("Relation"),
        F.when(flag.isNull(), none).otherwise(F.array(F.array(flag))).alias("ObjectEntities"),
    )
    return lines.select("row_idx", "pass_idx").distinct(), lines.where("value <> 'N'").withColumn("pos", F.ascii("value")), gold
