"""Threshold calibration: support fractions, grids, scores at every grid point, the best point."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..policy import CALIBRATABLE, POLICIES, by_relation
from ..sources.records import KEY, DataError, require_none
from ..sources.shared import small_side, stored
from . import scoring, votes
from .keyed import duplicate_keys
from .sets import missing_keys


def observed_grid(tallied: DataFrame, none_aware: tuple[str, ...], fixed: tuple[str, ...] = ()) -> DataFrame:
    """``Relation, tc, tn``: observed support fractions and none fractions, with 0 and 1.

    ``tallied`` has ``Relation, n, empty_n, candidates``.  Relations in ``fixed`` keep the candidate
    threshold 0; relations that are not none-aware have no none threshold.
    """
    ends = F.explode(F.array(F.lit(0.0), F.lit(1.0)))
    relations = tallied.select("Relation").distinct()
    seen = tallied.select("Relation", F.explode("candidates").alias("c"), "n").select("Relation", (F.col("c.count") / F.col("n")).alias("tc"))
    seen = seen.where(~F.col("Relation").isin(*fixed)).unionByName(relations.where(~F.col("Relation").isin(*fixed)).select("Relation", ends.alias("tc")))
    seen = seen.unionByName(relations.where(F.col("Relation").isin(*fixed)).select("Relation", F.lit(0.0).alias("tc"))).distinct()
    none = tallied.select("Relation", (F.col("empty_n") / F.col("n")).alias("tn")).unionByName(relations.select("Relation", ends.alias("tn")))
    aware = none.where(F.col("Relation").isin(*none_aware)).distinct()
    blind = relations.where(~F.col("Relation").isin(*none_aware)).select("Relation", F.lit(None).cast("double").alias("tn"))
    return seen.join(aware.unionByName(blind), "Relation")


def patterns(tallied: DataFrame, gold: DataFrame) -> DataFrame:
    """``Relation, n, none_n, counts, hits, total_gt, rows``: rows that score alike at every grid point, as one.

    A row is reduced to the vote counts of its candidates and, for each gold object, the candidates that
    match it, by position.  The many rows of a table are few patterns, so the grid meets those alone.
    """
    golds = scoring.last_by_key(gold).withColumn("gold_keys", text.nested_keys(F.coalesce("ObjectEntities", F.array().cast("array<array<string>>"))))
    met = tallied.join(golds.select(*KEY, "gold_keys"), list(KEY))
    keyed = met.withColumn("cand_keys", F.transform("candidates", lambda c: c["nk"]))
    # positions count from 1; a candidate that no object holds has position 0 and is dropped
    hits = F.transform("gold_keys", lambda g: F.array_sort(F.array_remove(F.array_distinct(F.transform(g, lambda k: F.array_position(F.col("cand_keys"), k))), 0)))
    reduced = keyed.select("Relation", "n", "none_n", F.transform("candidates", lambda c: c["count"]).alias("counts"), hits.alias("hits"))
    return reduced.groupBy("Relation", "n", "none_n", "counts", "hits").agg(F.count("*").alias("rows"))


def grid_scores(tallied: DataFrame, gold: DataFrame, grid: DataFrame, rules: dict[str, str]) -> DataFrame:
    """``Relation, tc, tn, macro_p, macro_r, macro_f1, predicted, empty, rows`` of every grid point."""
    met = patterns(tallied, gold).join(small_side(grid), "Relation")
    rule = by_relation(rules)
    places = F.filter(F.sequence(F.lit(1), F.size("counts") + 1), lambda i: i <= F.size("counts")).cast("array<bigint>")
    none = F.array().cast("array<bigint>")
    best = F.coalesce(F.array_max("counts"), F.lit(0))
    silent = (F.col("none_n") > best) & F.coalesce(F.col("none_n") / F.col("n") >= F.col("tn"), F.lit(False))
    enough = F.filter(places, lambda i: F.get("counts", i.cast("int") - 1) / F.col("n") >= F.col("tc"))
    top = F.when(F.size("counts") > 0, F.array(F.array_position("counts", best))).otherwise(none)
    chosen = F.when((rule != "support") & silent, none).when(rule == "majority_none", top).otherwise(enough)
    kept = met.withColumn("chosen", chosen).withColumn("kept_hits", F.transform("hits", lambda h: F.array_intersect(h, F.col("chosen"))))
    tp = scoring.matched_hits(F.col("kept_hits"))
    sized = kept.select("Relation", "tc", "tn", "rows", tp.alias("tp"), F.size("chosen").alias("total_pred"), F.size("hits").alias("total_gt"))
    scored = scoring.rated(sized)
    total = F.sum("rows")
    return scored.groupBy("Relation", "tc", "tn").agg(
        *[(F.sum(F.col(c) * F.col("rows")) / total).alias(f"macro_{c}") for c in ("p", "r", "f1")],
        F.sum(F.col("total_pred") * F.col("rows")).alias("predicted"),
        F.sum(F.when(F.col("total_pred") == 0, F.col("rows")).otherwise(F.lit(0))).alias("empty"),
        total.alias("rows"),
    )


def best_points(scores: DataFrame) -> DataFrame:
    """The grid point of each relation with the best F1, then precision, fewest predictions, highest thresholds.

    Means are compared to 12 places, so that the order of summation cannot turn a tie.
    """
    rank = F.struct(F.round("macro_f1", 12), F.round("macro_p", 12), -F.col("predicted"), F.col("tc"), F.coalesce("tn", F.lit(0.0)))
    best = scores.groupBy("Relation").agg(F.max_by(F.struct(*[c for c in scores.columns if c != "Relation"]), rank).alias("b"))
    return best.select("Relation", "b.*")


def calibrate(gold: DataFrame, headers: DataFrame, passes: DataFrame, traces: DataFrame, relations: list[str] | None = None, allow_partial: bool = False) -> tuple[DataFrame, DataFrame]:
    """Best thresholds by relation, and the sizes of the grids.

    ``traces`` has ``row_idx, SubjectEntity, Relation`` of every trace; ``headers`` and ``passes`` its
    samples; ``gold`` the training facts.  Traces must be of gold keys, once each; unless partial
    coverage is allowed every gold key of a relation needs a trace.
    """
    for rows, label in ((gold, "gold"), (traces, "trace")):
        copies = duplicate_keys(rows.select("row_idx", *KEY), list(KEY))
        require_none(copies.select("row_idx", F.concat(F.lit(f"duplicate {label} row for "), F.concat_ws(", ", *KEY)).alias("problem")), label)
    lost = traces.join(gold.select(*KEY), list(KEY), "left_anti")
    require_none(lost.select("row_idx", F.concat(F.lit("trace row is not present in the training gold: "), F.concat_ws(", ", *KEY)).alias("problem")), "trace")
    present = {r[0] for r in traces.where(F.col("Relation").isin(*CALIBRATABLE)).select("Relation").distinct().collect()}  # three at most
    chosen = [r for r in CALIBRATABLE if r in present] if relations is None else list(relations)
    unknown = sorted(set(chosen) - set(CALIBRATABLE))
    if unknown:
        raise DataError(f"unsupported calibration relations: {unknown}")
    if not chosen:
        raise DataError("no calibratable relations are represented in the traces")
    for r in chosen:
        if r not in present:
            raise DataError(f"no trace rows found for requested relation {r}")
    wanted = traces.where(F.col("Relation").isin(*chosen))
    asked = gold.where(F.col("Relation").isin(*chosen))
    missing = missing_keys(asked, wanted, list(KEY))
    if not allow_partial:
        few = missing.orderBy(*reversed(KEY)).limit(3).collect()
        if few:
            raise DataError("incomplete train trace coverage; missing " + ", ".join(f"{r['SubjectEntity']!r}" for r in few))
    own = wanted.select("row_idx", *KEY)
    held = passes.join(own.select("row_idx"), "row_idx", "left_semi")
    empty = headers.join(held.select("row_idx", "pass_idx").distinct(), ["row_idx", "pass_idx"], "left_anti").groupBy("row_idx").agg(F.count("*").alias("empty_n"))
    tallied = stored(votes.tally(headers.join(own.select("row_idx"), "row_idx", "left_semi"), held).join(own, "row_idx").join(empty, "row_idx", "left").fillna(0, ["empty_n"]))
    aware = tuple(r for r in chosen if POLICIES[r].none is not None)
    fixed = tuple(r for r in chosen if POLICIES[r].rule == "majority_none")
    grid = stored(observed_grid(tallied, aware, fixed))
    best = best_points(grid_scores(tallied, gold, grid, {r: POLICIES[r].rule for r in chosen}))
    available = asked.groupBy("Relation").agg(F.count("*").alias("rows_available"))
    gaps = missing.groupBy("Relation").agg(F.count("*").alias("rows_missing"))
    best = best.join(available, "Relation", "left").join(gaps, "Relation", "left").fillna(0, ["rows_missing"])
    sizes = grid.groupBy("Relation").agg(F.count_distinct("tc").alias("candidate_thresholds"), F.count_distinct("tn").alias("none_thresholds"))
    return best.withColumn("coverage_complete", F.col("rows_missing") == 0).drop("rows_missing"), sizes


