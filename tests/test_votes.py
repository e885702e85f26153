import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from factloom.operators import aliases, scoring, votes
from factloom.policy import POLICIES


def long(spark, samples):
    """Headers and passes of ``{row: [sample, ...]}``."""
    headers = [(r, i) for r, ss in samples.items() for i in range(len(ss))]
    passes = [(r, i, p, v) for r, ss in samples.items() for i, s in enumerate(ss) for p, v in enumerate(s)]
    return spark.createDataFrame(headers, "row_idx long, pass_idx int"), spark.createDataFrame(passes, "row_idx long, pass_idx int, pos int, value string")


def results(spark, samples, rule):
    tallied = votes.tally(*long(spark, samples))
    return {r["row_idx"]: r["x"] for r in tallied.select("row_idx", rule.alias("x")).collect()}


def test_voting_rules(spark):
    samples = {1: [["O’Brien"], ["OBrien"], ["O'BRIEN"]], 2: [[], ["Paris"]], 3: [[], [], ["NYSE"]], 4: [["A", "B"], ["b"], []], 5: [[], [".."]]}
    assert results(spark, samples, votes.support(1.0)) == {1: ["O’Brien"], 2: [], 3: [], 4: [], 5: []}
    assert results(spark, samples, votes.majority_or_none(0.5)) == {1: ["O’Brien"], 2: ["Paris"], 3: [], 4: ["B"], 5: []}
    assert results(spark, samples, votes.majority_or_none(0.9))[3] == ["NYSE"]
    assert results(spark, samples, votes.threshold_or_none(0.3, 0.5))[3] == []
    assert results(spark, samples, votes.threshold_or_none(0.2, 0.9))[3] == ["NYSE"]
    assert results(spark, samples, votes.union())[4] == ["A", "B"]
    assert results(spark, samples, votes.support(0.0))[4] == ["A", "B"]


def test_median(spark):
    headers, passes = long(spark, {1: [["100"], ["110"], ["120"], ["130"]], 2: [["x"], []], 3: [["5", "900"], ["7"]]})
    got = {r["row_idx"]: r["median"] for r in votes.median_values(headers, passes).collect()}
    assert got == {1: 115.0, 2: None, 3: 6.0}


def test_aggregate_is_driven_by_rows(spark):
    rows = spark.createDataFrame([(1, "hasArea"), (2, "personHasCityOfDeath"), (3, "countryLandBordersCountry"), (4, "awardWonBy"), (5, "hasArea")], "row_idx long, Relation string")
    headers, passes = long(spark, {1: [["1000"], ["1200"], ["1100"]], 2: [[], ["Paris"], [], ["Paris"], []], 3: [["France"], ["Spain", "france"]], 4: [["A"], [], ["B"], ["B"]]})
    got = {r["row_idx"]: (r["result"], r["samples"], r["empty_samples"]) for r in votes.aggregate(rows, headers, passes, POLICIES).collect()}
    assert got == {1: (["1100"], 3, 0), 2: ([], 5, 3), 3: (["France", "Spain"], 2, 0), 4: (["A", "B"], 4, 1), 5: ([], 0, 0)}


def test_partitions_do_not_matter(spark):
    rng = random.Random(1)
    samples = {r: [[rng.choice("abcde") for _ in range(rng.randrange(4))] for _ in range(6)] for r in range(20)}
    headers, passes = long(spark, samples)
    seen = []
    for n in (1, 8):
        t = votes.tally(headers.repartition(n), passes.repartition(n))
        seen.append(sorted((r["row_idx"], r["n"], r["none_n"], [tuple(c) for c in r["candidates"]]) for r in t.collect()))
    assert seen[0] == seen[1]


NAMES = "row_idx long, SubjectEntity string, Relation string, ObjectEntities array<array<string>>"


def test_alias_maps(spark):
    gold = spark.createDataFrame(
        [
            (0, "Acme", "x", [["New York Stock Exchange", "NYSE"]]),
            (1, "Bob", "d", [["Springfield, Illinois", "Springfield"]]),
            (2, "Eve", "d", [["Springfield, Ohio", "Springfield"]]),
            (3, "Nil", "d", [[" ", "Ulm"], []]),
        ],
        NAMES,
    )
    found = {(r["Relation"], r["alias_key"]): r["canonical"] for r in aliases.alias_map(gold).collect()}
    assert found[("x", "nyse")] == "New York Stock Exchange" and ("d", "springfield") not in found and found[("d", "ulm")] == "Ulm"
    passes = spark.createDataFrame([(9, 0, 0, "NYSE", "x"), (9, 0, 1, "New York Stock Exchange", "x"), (9, 1, 0, "..", "x")], "row_idx long, pass_idx int, pos int, value string, Relation string")
    kept, rewrites = aliases.canonicalize(passes, aliases.alias_map(gold), ["Relation"])
    assert [(r["pass_idx"], r["value"]) for r in kept.collect()] == [(0, "New York Stock Exchange")]
    assert [(r["from"], r["to"]) for r in rewrites.collect()] == [("NYSE", "New York Stock Exchange")]
    targets = spark.createDataFrame([(7, "Acme", "x", "nyse"), (8, "Other", "x", "nyse")], "row_idx long, SubjectEntity string, Relation string, alias_key string")
    assert [(r["row_idx"], r["canonical"]) for r in aliases.left_out_lookup(targets, gold).collect()] == [(8, "New York Stock Exchange")]


def brute_matching(preds, golds):
    best = 0
    for n in range(min(len(preds), len(golds)), 0, -1):
        for ps in itertools.permutations(preds, n):
            for gs in itertools.combinations(range(len(golds)), n):
                if all(p in golds[g] for p, g in zip(ps, gs, strict=True)):
                    return n
    return best


def test_matching_against_brute_force(spark):
    rng = random.Random(3)
    cases = []
    for i in range(120):
        preds = rng.sample("abcde", rng.randrange(5))
        golds = [rng.sample("abcdef", rng.randrange(4)) for _ in range(rng.randrange(4))]
        cases.append((i, preds, golds))
    rows = spark.createDataFrame(cases, "i int, p array<string>, g array<array<string>>")
    got = {r["i"]: r["tp"] for r in rows.select("i", scoring.matched_strings(F.col("p"), F.col("g")).alias("tp")).collect()}
    assert got == {i: brute_matching(p, g) for i, p, g in cases}


PREDS = "row_idx long, SubjectEntity string, Relation string, ObjectEntities array<string>"


def test_scores(spark):
    gold = spark.createDataFrame(
        [
            (0, "e", "s", []), (1, "e2", "s", []), (2, "g", "s", [["Paris"]]), (3, "nyc", "s", [["New York", "NYC", "New York City"]]), (4, "n", "hasArea", [["100"]]), (5, "n0", "hasArea", [["0"]]),
            (6, "neg", "hasArea", [["-5"]]), (7, "greedy", "s", [["A", "B"], ["A"]]), (8, "dup", "s", [["old"]]), (9, "dup", "s", [["new"]]), (10, "void", "s", [["..", "x"]]), (11, "many", "hasArea", [["100"], ["104"]]),
        ],
        NAMES,
    )
    predictions = spark.createDataFrame(
        [
            (0, "e", "s", []), (1, "e2", "s", ["x"]), (3, "nyc", "s", ["NYC", "New York City", "nyc."]), (4, "n", "hasArea", ["105"]), (5, "n0", "hasArea", ["0"]), (6, "neg", "hasArea", ["77"]),
            (7, "greedy", "s", ["A", "B"]), (8, "dup", "s", ["old"]), (9, "dup", "s", ["New"]), (10, "void", "s", ["!", "?"]), (11, "many", "hasArea", ["102", "101"]), (12, "extra", "s", ["x"]),
        ],
        PREDS,
    )
    got = {r["SubjectEntity"]: (r["p"], r["r"], r["f1"], r["tp"], r["total_pred"], r["total_gt"]) for r in scoring.score_pairs(gold, predictions).collect()}
    assert got["e"] == (1.0, 1.0, 1.0, 0, 0, 0) and got["e2"] == (0.0, 1.0, 0.0, 0, 1, 0) and got["g"] == (1.0, 0.0, 0.0, 0, 0, 1)
    assert got["nyc"] == (0.5, 1.0, 2 / 3, 1, 2, 1)
    assert got["n"][3] == 1 and got["n0"][3] == 0 and got["neg"][3] == 1
    assert got["greedy"][3] == 2 and got["dup"][3] == 1 and got["void"][3:] == (1, 1, 1) and got["many"][3] == 2
    assert "extra" not in got


def test_averages(spark):
    scores = spark.createDataFrame(
        [("a", "x", 1.0, 0.0, 0.0, 0, 0, 1), ("b", "x", 0.5, 1.0, 2 / 3, 1, 2, 1), ("c", "y", 1.0, 1.0, 1.0, 0, 0, 0)],
        "SubjectEntity string, Relation string, p double, r double, f1 double, tp int, total_pred int, total_gt int",
    )
    macro = {r["Relation"]: r["macro_p"] for r in scoring.macro_average(scores).collect()}
    assert macro == {"x": 0.75, "y": 1.0, scoring.ALL: 2.5 / 3}
    micro = {r["Relation"]: (r["micro_p"], r["micro_r"]) for r in scoring.micro_average(scores).collect()}
    assert micro == {"x": (0.5, 0.5), "y": (1.0, 1.0), scoring.ALL: (0.5, 0.5)}
    shown = {r["Relation"]: (r["macro_p"], r["avg_preds"], r["empty_preds"]) for r in scoring.report(scores).collect()}
    assert shown[scoring.ALL] == (0.833, 0.667, 2)
    zero = {r["Relation"]: (r["zero_p"], r["zero_r"]) for r in scoring.zero_object_scores(scores).collect()}
    assert zero[scoring.ALL] == (0.5, 1.0)
    empty = scoring.macro_average(scores.limit(0)).collect()
    assert empty == []
    b = scoring.paired_bootstrap(scores, scores.withColumn("f1", F.lit(0.0)), 300, 1).first()
    assert b["low"] <= b["diff"] <= b["high"] and 0 <= b["p_value"] <= 1


def test_bootstrap_against_brute_force(spark):
    made = random.Random(4)
    left = [(f"s{i}", "x" if i % 3 else "y", made.choice([0.0, 0.25, 1 / 3, 0.5, 2 / 3, 1.0])) for i in range(150)]
    right = [(s, r, made.choice([0.0, 0.25, 0.5, 2 / 3, 1.0])) for s, r, _ in left]
    schema = "SubjectEntity string, Relation string, f1 double"
    got = scoring.paired_bootstrap(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)).first()
    d = np.array([a[2] - b[2] for a, b in zip(left, right, strict=True)])
    weights = np.random.default_rng(1).poisson(1, (20_000, len(d)))  # one weight for every row
    means = weights @ d / weights.sum(axis=1)
    low, high = np.percentile(means, [2.5, 97.5])
    below = (means <= 0).mean()
    p = min(2 * min(below, 1 - below), 1.0)
    assert abs(got["diff"] - d.mean()) < 1e-12
    # two tails of 20,000 draws each differ by less than a twentieth of the standard error; those of 200 do not
    assert abs(got["low"] - low) < means.std() / 10 and abs(got["high"] - high) < means.std() / 10 and abs(got["p_value"] - p) < 0.02
    again = scoring.paired_bootstrap(spark.createDataFrame(left, schema).repartition(7), spark.createDataFrame(right, schema)).first()
    assert np.allclose(again, got, atol=1e-9)


def test_capped_helpers(spark):
    one = spark.range(1)
    got = one.select(scoring.capped_ratio(F.lit(3), F.lit(2)).alias("a"), scoring.capped_ratio(F.lit(0), F.lit(0)).alias("b"), scoring.f1(F.lit(0.0), F.lit(0.0)).alias("c")).first()
    assert tuple(got) == (1.0, 1.0, 0.0)
