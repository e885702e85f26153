"""Alias maps from nested gold objects and canonical spellings by lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text


def contributions(gold: DataFrame) -> DataFrame:
    """``Relation, SubjectEntity, alias_key, canon_key, canon, ord`` of every alias of every object.

    ``gold`` has nested objects.  The canonical spelling is an object's first non-blank alias; keys that
    normalise to nothing are left out.
    """
    groups = gold.select("row_idx", "SubjectEntity", "Relation", F.posexplode("ObjectEntities").alias("ei", "group"))
    bare = F.filter(F.transform("group", lambda a: F.regexp_replace(a, r"^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")), lambda a: a != "")
    named = groups.select("row_idx", "SubjectEntity", "Relation", "ei", bare.alias("aliases")).where(F.size("aliases") > 0)
    each = named.select("*", F.get("aliases", F.lit(0)).alias("canon"), F.posexplode("aliases").alias("ai", "alias"))
    keyed = each.select(
        "Relation", "SubjectEntity", text.key("alias").alias("alias_key"), text.key("canon").alias("canon_key"), "canon", F.struct("row_idx", "ei", "ai").alias("ord")
    )
    return keyed.where("alias_key <> '' and canon_key <> ''")


def alias_map(gold: DataFrame) -> DataFrame:
    """``Relation, alias_key, canonical`` of the aliases that name one object only."""
    grouped = contributions(gold).groupBy("Relation", "alias_key").agg(F.count_distinct("canon_key").alias("n"), F.min_by("canon", "ord").alias("canonical"))
    return grouped.where("n = 1").select("Relation", "alias_key", "canonical")


def left_out_lookup(targets: DataFrame, gold: DataFrame) -> DataFrame:
    """Alias map entries for each target row, without what its own gold row contributes.

    ``targets`` has ``row_idx, SubjectEntity, Relation, alias_key``; the result has ``row_idx,
    alias_key, canonical``.  One equi-join on relation and key replaces a map for each target.
    """
    own = contributions(gold).withColumnRenamed("SubjectEntity", "__by")
    met = targets.distinct().join(own, ["Relation", "alias_key"]).where(~F.col("__by").eqNullSafe(F.col("SubjectEntity")))
    grouped = met.groupBy("row_idx", "alias_key").agg(F.count_distinct("canon_key").alias("n"), F.min_by("canon", "ord").alias("canonical"))
    return grouped.where("n = 1").select("row_idx", "alias_key", "canonical")


def canonicalize(passes: DataFrame, lookup: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """Passes under canonical spellings, and the rewrites made.

    ``passes`` has ``row_idx, pass_idx, pos, value`` (and ``Relation`` if the lookup is by relation);
    ``lookup`` has ``on`` and ``alias_key, canonical``.  One hop only; of spellings that become equal
    within a sample the first stays.
    """
    known = passes.withColumn("alias_key", text.key("value")).join(lookup, [*on, "alias_key"], "left")
    spelled = known.withColumn("to", F.coalesce("canonical", "value"))
    keyed = spelled.withColumn("nk", F.when(F.col("canonical").isNull(), F.col("alias_key")).otherwise(text.key("canonical"))).where("nk <> ''")
    first = keyed.groupBy("row_idx", "pass_idx", "nk").agg(F.min(F.struct("pos", "value", "to")).alias("f"))
    kept = first.select("row_idx", "pass_idx", F.col("f.pos").alias("pos"), F.col("f.to").alias("value"))
    rewrites = first.where("f.value <> f.to").select("row_idx", "pass_idx", F.col("f.pos").alias("pos"), F.col("f.value").alias("from"), F.col("f.to").alias("to"))
    return kept, rewrites
