"""Mixing sources to target weights by weighted fair queueing.

Every document of a source is queued in a shuffled order that depends on its id alone.  Its virtual
finish time is the source's cumulative words divided by the source's target, so all queues finish
together; a second pass of each queue follows the first.  The queue entries are range-sorted by
virtual finish time over all sources and taken while the running total stays within the budget.

Running totals are distributed: rows are range-partitioned, each partition is summed, the few partition
sums are accumulated, and a window adds up inside each partition.  No source, however large, meets in
one task.

Null texts have size 0 and are never taken; null sources form one source, ordered last; documents
with a null id are queued first.  Rows with the same id, source and size are interchangeable; each has a
number of its own, written with it, so that however many there are they can be sorted into several tasks.
Documents of size 0 are not queued.  Only the size of a text, however long, leaves the first pass.  Extra
columns, whatever their names, are not read.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stored

WEIGHTS = (3, 1, 2)
SHARE = 1.5
COPIES = 2


def running_total(df: DataFrame, order: list[Column], **totals: str) -> DataFrame:
    """Add inclusive running totals in the given global order: ``name=column`` for each."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = stored(df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()))
    sums = placed.groupBy("__part").agg(*[F.sum(c).alias(f"__sum_{n}") for n, c in totals.items()])
    # as many rows as partitions, whatever the input
    upto = Window.orderBy("__part")
    before = sums.select(F.col("__part").alias("__part_of"), *[(F.sum(f"__sum_{n}").over(upto) - F.col(f"__sum_{n}")).alias(f"__before_{n}") for n in totals])
    inside = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for n, c in totals.items():
        placed = placed.withColumn(n, F.sum(c).over(inside))
    joined = placed.join(F.broadcast(before), F.col("__part") == F.col("__part_of"))
    for n in totals:
        joined = joined.withColumn(n, F.col(n) + F.col(f"__before_{n}"))
    return joined.drop("__part", "__part_of", *[f"__before_{n}" for n in totals])


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, copies: int = COPIES) -> tuple[DataFrame, float]:
    """``source, source_size, source_end, target`` of each source, and the budget.

    ``sizes`` has ``source, source_size``.  A target is ``level * weight`` but at most ``copies`` times
    the source's size; the level makes the targets add up to the budget.
    """
    by_name = [F.col("source").asc_nulls_last()]
    ranked = running_total(sizes.withColumn("__one", F.lit(1)), by_name, __rank="__one", source_end="source_size")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = ranked.withColumn("__weight", F.element_at(cycle, (F.pmod(F.col("__rank") - 1, F.lit(len(weights))) + 1).cast("int")))
    ranked = ranked.withColumn("__ceiling", F.col("source_size") * float(copies)).withColumn("__ratio", F.col("__ceiling") / F.col("__weight"))
    total, weight = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("__weight"), F.lit(0.0))).first()
    budget = share * total
    order = [F.col("__ratio"), F.col("__rank")]
    filled = running_total(ranked, order, __full="__ceiling", __spent="__weight")
    rest = F.lit(weight) - F.col("__spent") + F.col("__weight")
    level = (F.lit(budget) - F.col("__full") + F.col("__ceiling")) / rest
    found = filled.select(level.alias("level"), "__ratio", "__rank").where(F.col("__ratio") >= F.col("level"))
    first = found.agg(F.min_by("level", F.struct("__ratio", "__rank"))).first()[0]
    target = F.col("__ceiling") if first is None else F.least(F.col("__ceiling"), F.lit(first) * F.col("__weight"))
    return ranked.select("source", "source_size", "source_end", target.alias("target")), budget


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, copies: int = COPIES) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken`` of every document."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    slim = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), F.monotonically_increasing_id().alias("__row")))
    goals, budget = targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, copies)
    known = goals.withColumnRenamed("source", "__source")
    shuffled = F.md5(F.col("doc_id").cast("string").cast("binary"))
    order = [F.col("source").asc_nulls_last(), F.col("__shuffled"), F.col("doc_id"), F.col("size"), F.col("__row")]
    queued = running_total(slim.where("size > 0").withColumn("__shuffled", shuffled), order, __running="size")
    queued = queued.join(known, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    cumulative = F.col("__running") - (F.col("source_end") - F.col("source_size"))
    entries = (
        queued.withColumn("__cumulative", cumulative)
        .withColumn("__pass", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
        .withColumn("__finish", (F.col("__cumulative") + F.col("__pass") * F.col("source_size")) / F.col("target"))
    )
    keys = ["doc_id", "source", "size", "source_size", "target", "__running"]
    line = [F.col("__finish"), F.col("source").asc_nulls_last(), F.col("__running"), F.col("__pass")]
    served = running_total(entries.select(*keys, "__finish", "__pass"), line, __total="size")
    taken = F.sum(F.when(F.col("__total") <= F.lit(budget), F.col("size")).otherwise(F.lit(0)))
    merged = served.groupBy(*keys).agg(taken.alias("taken"))  # running totals of sizes above 0 differ
    empty = slim.where("size = 0").join(known, F.col("source").eqNullSafe(F.col("__source")))
    none = empty.select("doc_id", "source", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"))
    return merged.select("doc_id", "source", "size", "source_size", "target", "taken").unionByName(none)
