"""Choosing few-shot examples: leave-one-out, rotation, class quotas, even spacing.

For every target the examples of its relation are ordered in two rings (with and without objects),
those with a rationale first, each rotated by the target's offset; quotas follow the relation's share
of empty examples, and the empty ones are spaced evenly among the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import small_side


def rotated_rank(rank: Column, size: Column, offset: Column) -> Column:
    """Position of the item of 0-based ``rank`` in a ring of ``size`` after a shift by ``offset``."""
    return F.pmod(rank - offset, F.nullif(size, F.lit(0)))


def quotas(limit: Column, n: Column, empty: Column, full: Column, pool: Column) -> tuple[Column, Column]:
    """Numbers of empty and other examples.

    ``n`` counts the candidates, ``pool`` the empty ones by subject as ``empty``; one class fills up
    for the other.
    """
    share = F.bround(limit * pool / F.nullif(n, F.lit(0)), 0).cast("int")
    first = F.least(F.coalesce(share, F.lit(0)), empty)
    others = F.least(limit - first, full)
    return F.least(limit - others, empty), others


def slots(total: Column, empty: Column) -> Column:
    """Evenly spaced 0-based places of ``empty`` items among ``total``, in closed form."""
    e = F.greatest(empty, F.lit(1))

    def place(k: Column) -> Column:
        # least index i with (k + 1/2) / e <= (i + 1/2) / total, in integers
        x = total * (2 * k + 1) - e
        return F.greatest(F.lit(0), F.floor((x + 2 * e - 1) / (2 * e))).cast("int")

    return F.when(empty > 0, F.transform(F.sequence(F.lit(0), e - 1), place)).otherwise(F.array().cast("array<int>"))


def _rings(examples: DataFrame) -> DataFrame:
    """Examples with their class, their place in its ring, and whether an example with a rationale stands for them.

    A ring holds the examples of a relation with or without objects, with or without a rationale, in
    order.  ``nth_fresh`` counts the places before that no example with a rationale stands for.
    """
    plain = F.coalesce(~F.col("Rationale").rlike(r"\S"), F.lit(True))
    marked = examples.withColumn("plain", plain).withColumn("empty", F.coalesce(F.size("ObjectEntities") == 0, F.lit(True)))
    told = marked.where("not plain").select("Relation", "empty", "SubjectEntity", F.lit(True).alias("told")).distinct()
    known = marked.join(told, ["Relation", "empty", "SubjectEntity"], "left").withColumn("fresh", ~F.col("plain") | F.col("told").isNull()).drop("told")
    ring = Window.partitionBy("Relation", "empty", "plain").orderBy("row_idx")
    before = F.coalesce(F.count_if("fresh").over(ring.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return known.withColumn("rank", F.row_number().over(ring) - 1).withColumn("nth_fresh", before)


def _skipping(start: Column, own: Column) -> Column:
    """The place of the ``start``-th item of a ring without the places in ``own`` (ascending)."""
    return F.aggregate(own, start, lambda t, p: F.when(p <= t, t + 1).otherwise(t))


def select_examples(targets: DataFrame, examples: DataFrame) -> DataFrame:
    """``target, place`` and the chosen example's ``row_idx, SubjectEntity, ObjectEntities, Rationale``.

    ``targets`` has ``target, SubjectEntity, Relation, offset, limit``; ``examples`` has ``row_idx,
    SubjectEntity, Relation, ObjectEntities`` and may have ``Rationale``.  A target reads the few places
    of each ring that its offset points at, by equi-joins, so the work is the number of targets times
    their limits, whatever the number of examples.
    """
    if "Rationale" not in examples.columns:
        examples = examples.withColumn("Rationale", F.lit(None).cast("string"))
    rings = _rings(examples.select("row_idx", "SubjectEntity", "Relation", "ObjectEntities", "Rationale"))
    ring_key, own_key = ["Relation", "empty", "plain"], ["Relation", "SubjectEntity"]
    # sizes of rings, and how often a subject comes in one at most
    times = rings.groupBy(*ring_key, "SubjectEntity").agg(F.count("*").alias("times"), F.count_if("fresh").alias("fresh_times"), F.sort_array(F.collect_list("rank")).alias("places"))
    sizes = times.groupBy(*ring_key).agg(F.sum("times").alias("size"), F.sum("fresh_times").alias("fresh_size"), F.max("times").alias("most"))
    classes = times.groupBy("Relation", "empty").agg(F.count_distinct("SubjectEntity").alias("subjects"), F.sum("times").alias("rows"))
    totals = classes.groupBy("Relation").agg(
        F.sum("rows").alias("all_rows"), F.sum(F.when(F.col("empty"), F.col("subjects")).otherwise(0)).alias("all_e"), F.sum(F.when(~F.col("empty"), F.col("subjects")).otherwise(0)).alias("all_f")
    )
    own_totals = times.groupBy(*own_key).agg(F.sum("times").alias("own_rows"), F.max(F.col("empty").cast("int")).alias("own_e"), F.max((~F.col("empty")).cast("int")).alias("own_f"))
    asked = targets.where("limit > 0").select("target", "SubjectEntity", "Relation", "offset", "limit")
    counted = asked.join(small_side(totals), "Relation").join(own_totals, own_key, "left").fillna(0, ["own_rows", "own_e", "own_f"])
    pools = counted.select(
        "target", "SubjectEntity", "Relation", "offset", "limit", (F.col("all_rows") - F.col("own_rows")).alias("n"), (F.col("all_e") - F.col("own_e")).cast("int").alias("e"), (F.col("all_f") - F.col("own_f")).cast("int").alias("f")
    ).where("n > 0")
    own = times.select(*ring_key, "SubjectEntity", "places", "times")
    turned = pools.join(small_side(sizes), "Relation").join(own, [*ring_key, "SubjectEntity"], "left")
    left = F.col("size") - F.coalesce("times", F.lit(0))
    none = F.array().cast("array<int>")
    start = F.pmod(F.col("offset"), F.nullif(left, F.lit(0))).cast("int")
    begun = turned.where(left > 0).withColumn("rank", _skipping(start, F.coalesce("places", none)))
    # from the place to the number of fresh ones before it, then to the next fresh places in turn
    at = rings.select(*ring_key, "rank", "nth_fresh")
    reach = F.least(F.col("fresh_size"), (F.col("limit") + 1) * F.col("most")).cast("int")
    pointed = begun.join(at, [*ring_key, "rank"]).where("fresh_size > 0").withColumn("turn", F.explode(F.sequence(F.lit(0), reach - 1)))
    pointed = pointed.withColumn("nth_fresh", F.pmod(F.col("nth_fresh") + F.col("turn"), F.col("fresh_size"))).withColumnRenamed("SubjectEntity", "__for")
    fresh = rings.where("fresh").drop("rank", "fresh")
    met = pointed.drop("rank", "places", "times", "size", "most", "fresh_size").join(fresh, [*ring_key, "nth_fresh"]).where(~F.col("SubjectEntity").eqNullSafe(F.col("__for")))
    order = [F.col("plain"), F.col("turn")]
    first = met.withColumn("nth", F.row_number().over(Window.partitionBy("target", "empty", "SubjectEntity").orderBy(*order))).where("nth = 1")
    ranked = first.withColumn("k", F.row_number().over(Window.partitionBy("target", "empty").orderBy(*order)) - 1)
    take_e, take_f = quotas(F.col("limit"), F.col("n"), F.col("e"), F.col("f"), F.col("e"))
    kept = ranked.withColumn("te", take_e.cast("int")).withColumn("tf", take_f.cast("int")).where("(empty and k < te) or (not empty and k < tf)")
    places = slots(F.col("te") + F.col("tf"), F.col("te"))
    free = F.array_except(F.sequence(F.lit(0), F.col("te") + F.col("tf") - 1), F.col("places"))
    placed = kept.withColumn("places", places).withColumn("place", F.when(F.col("empty"), F.get("places", F.col("k"))).otherwise(F.get(free, F.col("k"))))
    return placed.select("target", "place", "row_idx", "SubjectEntity", "Relation", "ObjectEntities", "Rationale")
