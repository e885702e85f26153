import hashlib
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from factloom.operators import calibration, examples, inference, keyed, reasoning, sets
from factloom.plans import calibrate_files
from factloom.sources import digests, records, shared, traces
from factloom.sources.checkpoint import RowShards
from factloom.sources.records import DataError


def write(path, rows):
    path.write_text("".join((r if isinstance(r, str) else json.dumps(r, ensure_ascii=False)) + "\n" for r in rows), encoding="utf-8")
    return str(path)


def read(path):
    return [json.loads(x) for x in open(path, encoding="utf-8")]


def fact(subject, relation, objects, **more):
    return {"SubjectEntity": subject, "Relation": relation, "ObjectEntities": objects} | more


# --- readers and writers ---


def test_numbered_is_contiguous(spark):
    rows = records.numbered(spark.range(0, 1000, numPartitions=7))
    assert [r["row_idx"] for r in rows.orderBy("id").collect()] == list(range(1000))
    assert records.numbered(spark.range(0)).count() == 0


def test_ranked_is_contiguous_and_ordered(spark):
    rows = spark.range(0, 3000, numPartitions=5).selectExpr("id", "id % 7 AS a", "-id AS b")
    got = shared.ranked(rows, ["a", "b"], "n").orderBy("n").collect()
    assert [r["n"] for r in got] == list(range(3000)) and [(r["a"], r["b"]) for r in got] == sorted((r["a"], r["b"]) for r in got)
    assert shared.ranked(rows.where("id < 0"), ["a"]).count() == 0


def test_numbers_have_no_caps(spark):
    # more steps in a trace, and more candidates in a sample, than any fixed stride
    gold = spark.createDataFrame([(0, "A", "hasArea", [["5"]]), (1, "B", "hasArea", [["5"]])], "row_idx long, SubjectEntity string, Relation string, ObjectEntities array<array<string>>")
    steps = [{"rationale": f"r{k}", "parsed": ["5"]} for k in range(5000)]
    lines = [(k, json.dumps({"SubjectEntity": s, "Relation": "hasArea", "model": "m", "model_parameters_billion": 7, "workflow_steps": steps}), s, "hasArea") for k, s in enumerate("AB")]
    made = reasoning.build_paths(gold, spark.createDataFrame(lines, "row_idx long, line string, SubjectEntity string, Relation string")).orderBy("row_idx").collect()
    assert [(r["row_idx"], r["SubjectEntity"], r["Rationale"]) for r in made] == [(5000 * k + n, s, f"r{n}") for k, s in enumerate("AB") for n in range(5000)]
    values = spark.createDataFrame([(0, 0, 2_000_000, "late"), (0, 1, 0, "next"), (0, 2500, 7, "last"), (0, 0, 1, "first")], "row_idx long, pass_idx int, pos int, value string")
    assert [r["value"] for r in inference.votes_union(values).orderBy("pos").collect()] == ["first", "late", "next", "last"]


def test_strict_and_lenient_reading(spark, tmp_path):
    path = write(tmp_path / "a.jsonl", [fact("A", "hasArea", []), "", fact("B", "hasArea", [])])
    assert records.read_records(spark, path).count() == 2
    with pytest.raises(DataError, match="2: blank"):
        records.read_strict(spark, path)
    for line, said in (("nope", "invalid JSON"), ("[1]", "must be an object")):
        with pytest.raises(DataError, match=said):
            records.read_strict(spark, write(tmp_path / "b.jsonl", [line]))
    with pytest.raises(DataError, match="invalid JSON"):
        records.read_records(spark, write(tmp_path / "c.jsonl", ["nope"]))


def test_gold_forms(spark, tmp_path):
    path = write(tmp_path / "g.jsonl", [fact("A", "x", ["a", "b"]), fact("B", "x", [["c", "d"], []]), fact("C", "x", []), fact("D", "x", [["e"], "f"])])
    got = [r["ObjectEntities"] for r in records.gold_facts(records.read_strict(spark, path)).orderBy("row_idx").collect()]
    assert got == [[["a"], ["b"]], [["c", "d"], []], [], [["e"]]]
    assert [r["ObjectEntities"] for r in records.facts(records.read_strict(spark, path)).orderBy("row_idx").collect()][1] == ["c"]


def test_files_are_replaced_whole(tmp_path):
    target = tmp_path / "deep" / "x.txt"
    records.replace_file(target, [b"a", b"b"])
    assert target.read_bytes() == b"ab"

    def broken():
        yield b"c"
        raise RuntimeError

    with pytest.raises(RuntimeError):
        records.replace_file(target, broken())
    assert target.read_bytes() == b"ab" and [p.name for p in target.parent.iterdir()] == ["x.txt"]


def test_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, "B", ["é"]), (0, "A", [])], "row_idx long, SubjectEntity string, ObjectEntities array<string>")
    records.write_file(records.to_lines(rows), tmp_path / "o.jsonl")
    assert read(tmp_path / "o.jsonl") == [{"SubjectEntity": "A", "ObjectEntities": []}, {"SubjectEntity": "B", "ObjectEntities": ["é"]}]
    records.write_parts(records.to_lines(rows), str(tmp_path / "parts"))
    assert spark.read.text(str(tmp_path / "parts")).count() == 2


# --- select, merge, package ---


def test_select(spark, tmp_path):
    source = write(tmp_path / "in.jsonl", [fact("A", "hasArea", [["10"]], note="keep"), fact("B", "awardWonBy", []), fact("C", "hasArea", [])])
    out = str(tmp_path / "out.jsonl")
    assert keyed.select_file(spark, source, out, ["hasArea"]) == 2
    assert read(out) == [fact("A", "hasArea", [], note="keep"), fact("C", "hasArea", [])]
    for relations, said in ((["noSuchRelation"], "not found"), ([], "non-empty")):
        with pytest.raises(DataError, match=said):
            keyed.select_file(spark, source, str(tmp_path / "no.jsonl"), relations)
    assert not (tmp_path / "no.jsonl").exists()
    with pytest.raises(DataError, match="differ"):
        keyed.select_file(spark, source, source, ["hasArea"])


def test_merge(spark, tmp_path):
    base = write(tmp_path / "b.jsonl", [fact("A", "x", ["1"], note=1), fact("B", "x", ["Old"]), fact("C", "x", ["3"])])
    one, two = write(tmp_path / "1.jsonl", [fact("B", "x", ["New"])]), write(tmp_path / "2.jsonl", [fact("A", "x", ["2"], note=9)])
    out = str(tmp_path / "o.jsonl")
    assert keyed.merge_files(spark, base, [one, two], out) == 3
    assert read(out) == [fact("A", "x", ["2"], note=1), fact("B", "x", ["New"]), fact("C", "x", ["3"])]
    bad = {
        "not in the base": [fact("Z", "x", [])], "nested": [fact("A", "x", [["3"]])], "strings": [fact("A", "x", [1])], "list": [fact("A", "x", "100")], "non-empty": [fact(" ", "x", [])],
        "duplicate": [fact("A", "x", []), fact("A", "x", [])], "only": [fact("A", "x", ["a", None])],
    }
    for said, rows in bad.items():
        with pytest.raises(DataError, match=said):
            keyed.merge_files(spark, base, [write(tmp_path / "bad.jsonl", rows)], str(tmp_path / "no.jsonl"))
    with pytest.raises(DataError, match="duplicate override"):
        keyed.merge_files(spark, base, [two, write(tmp_path / "3.jsonl", [fact("A", "x", ["5"])])], str(tmp_path / "no.jsonl"))
    with pytest.raises(DataError, match="at least one"):
        keyed.merge_files(spark, base, [], out)


def test_package(spark, tmp_path):
    source, out = write(tmp_path / "p.jsonl", [fact("A", "x", ["é"]), fact("B", "x", [])]), str(tmp_path / "p.zip")
    assert keyed.package(spark, source, out, 2) == 2
    with zipfile.ZipFile(out) as box:
        assert box.namelist() == ["predictions.jsonl"] and box.read("predictions.jsonl") == open(source, "rb").read()
    before = open(out, "rb").read()
    with pytest.raises(DataError, match="expected 3 rows, found 2"):
        keyed.package(spark, source, out, 3)
    with pytest.raises(DataError, match="strings only"):
        keyed.package(spark, write(tmp_path / "q.jsonl", [fact("A", "x", [5])]), out)
    with pytest.raises(DataError, match="zip"):
        keyed.package(spark, source, str(tmp_path / "p.tar"))
    assert open(out, "rb").read() == before


# --- sets ---


def test_sets(spark):
    a, b = spark.createDataFrame([("x",), ("x",), ("y",)], "k string"), spark.createDataFrame([("x",)], "k string")
    assert sorted(r[0] for r in sets.bag_difference(a, b).collect()) == ["x", "y"]
    n = spark.createDataFrame([(0,), (1,), (3,)], "row_idx long")
    assert tuple(sets.prefix_gap(n).first()) == (3, 3, False) and sets.prefix_gap(n.where("row_idx < 2")).first()["is_prefix"]
    assert sets.prefix_gap(n.limit(0)).first()["is_prefix"]
    assert [r[0] for r in sets.remaining(n, n.where("row_idx = 1")).orderBy("row_idx").collect()] == [0, 3]
    assert sets.first_rows(n, 2).count() == 2 and sets.first_of(n.withColumn("k", F.lit(1)), ["k"], "row_idx").first()["row_idx"] == 0
    with pytest.raises(ValueError):
        sets.first_rows(n, -1)
    assert sets.canonical_rows(spark.createDataFrame([(1, 2)], "b int, a int")).first()[0] == '{"a":2,"b":1}'


# --- digests ---


@pytest.mark.parametrize("path", ["val.jsonl", "validation-traces.json", "test_gold.jsonl", "runs/val-run.state/rows", "archive/validation/rows/train-traces.json"])
def test_held_back_paths(path):
    with pytest.raises(DataError):
        digests.refuse_held_back(path, "gold")
    digests.refuse_held_back("data/train-latest/values.jsonl", "gold")


def test_digests(tmp_path):
    assert digests.value_digest({"b": 1, "a": "é"}) == digests.value_digest({"a": "é", "b": 1})
    assert digests.rows_digest([{"a": 1}, {"b": 2}]) != digests.rows_digest([{"b": 2}, {"a": 1}])
    (tmp_path / "x.json").write_text("{}")
    first = digests.folder_digest(tmp_path)
    (tmp_path / "x.json").write_text("{ }")
    assert digests.folder_digest(tmp_path) != first and len(first) == 64
    # the fixed layouts, byte by byte
    assert digests.folder_digest(tmp_path) == hashlib.sha256(b"\0" * 7 + b"\6x.json" + b"\0" * 7 + b"\3{ }").hexdigest()
    (tmp_path / "y.jsonl").write_text("[]")
    assert digests.source_digest(tmp_path) == hashlib.sha256(b"x.json{ }y.jsonl[]").hexdigest()
    assert digests.source_digest(tmp_path / "x.json") == hashlib.sha256(b"{ }").hexdigest()


# --- examples ---


def pool(spark, empty, full, start=0):
    rows = [(i, f"s{i}", "r", []) for i in range(start, start + empty)] + [(i, f"s{i}", "r", [["Object"]]) for i in range(start + empty, start + empty + full)]
    return spark.createDataFrame(rows, "row_idx long, SubjectEntity string, Relation string, ObjectEntities array<array<string>>")


def chosen(spark, rows, limit, offset=0, subject="other"):
    targets = spark.createDataFrame([(1, subject, "r", offset, limit)], "target int, SubjectEntity string, Relation string, offset int, limit int")
    return examples.select_examples(targets, rows).orderBy("place").collect()


@pytest.mark.parametrize(("empty", "full", "count"), [(42, 58, 2), (34, 66, 2), (12, 55, 1), (0, 100, 0)])
def test_quota(spark, empty, full, count):
    got = chosen(spark, pool(spark, empty, full), 5)
    assert [r["place"] for r in got] == [0, 1, 2, 3, 4] and sum(not r["ObjectEntities"] for r in got) == count
    if count == 2:
        assert "".join("N" if r["ObjectEntities"] else "E" for r in got) == "NENNE"


def test_rotation_and_exclusion(spark):
    rows = pool(spark, 12, 55)
    seen = set()
    for offset in (0, 5, 10, 25, 133):
        got = chosen(spark, rows, 5, offset)
        assert sum(not r["ObjectEntities"] for r in got) == 1 and len({r["SubjectEntity"] for r in got}) == 5
        seen.add(tuple(r["SubjectEntity"] for r in got))
    assert len(seen) == 5
    assert "s0" not in {r["SubjectEntity"] for r in chosen(spark, rows, 20, 0, "s0")}
    assert chosen(spark, rows, 0) == [] and chosen(spark, rows.limit(0), 5) == []
    few = chosen(spark, pool(spark, 1, 9), 5)
    assert len(few) == 5 and sum(not r["ObjectEntities"] for r in few) <= 1
    assert len(chosen(spark, pool(spark, 5, 1), 5)) == 5


def test_reasoned_copy_comes_first(spark):
    plain = pool(spark, 0, 6).withColumn("Rationale", F.lit(None).cast("string"))
    told = pool(spark, 0, 6).where("row_idx = 4").withColumn("row_idx", F.lit(-1).cast("long")).withColumn("Rationale", F.lit("why"))
    got = chosen(spark, plain.unionByName(told), 3)
    assert got[0]["SubjectEntity"] == "s4" and got[0]["Rationale"] == "why" and len({r["SubjectEntity"] for r in got}) == 3


def test_slots_equal_the_greedy_rule(spark):
    cases = [(e, n) for e in range(0, 13) for n in range(0, 13) if e + n]
    rows = spark.createDataFrame(cases, "e int, n int")
    for r in rows.select("e", "n", examples.slots(F.col("e") + F.col("n"), F.col("e")).alias("s")).collect():
        e, n, used, expected = r["e"], r["n"], 0, []
        for i in range(e + n):
            if used < e and (n - (i - used) == 0 or (used + 0.5) / e <= (i + 0.5) / (e + n)):
                expected.append(i)
                used += 1
        assert list(r["s"]) == expected


# --- traces, calibration, reasoning paths ---

GOLD = [
    fact("Alice", "personHasCityOfDeath", [["Paris"]]), fact("Bob", "personHasCityOfDeath", []), fact("Acme", "companyTradesAtStockExchange", [["NYSE"]]),
    fact("PrivateCo", "companyTradesAtStockExchange", []), fact("Prize", "awardWonBy", [["Ada"], ["Bob"]]),
]
PASSES = {"Alice": [["Paris"], ["Paris"], []], "Bob": [[], [], ["London"]], "Acme": [["NYSE"], ["NYSE"], []], "PrivateCo": [[], [], ["Nasdaq"]], "Prize": [["Ada"], ["Bob"], ["Wrong"]]}


def trace(gold, passes, **more):
    return {"SubjectEntity": gold["SubjectEntity"], "Relation": gold["Relation"], "self_consistency": {"passes": passes}} | more


def trace_rows(**kw):
    return [trace(g, PASSES[g["SubjectEntity"]], **kw) for g in GOLD]


def test_trace_envelopes(spark, tmp_path):
    folder = tmp_path / "traces"
    (folder / "deep").mkdir(parents=True)
    a, b, c, d, e = trace_rows()
    (folder / "1.json").write_text(json.dumps([a, 5]))
    (folder / "2.json").write_text(json.dumps({"version": 3, "SubjectEntity": "other", "Relation": "x", "raw": b}))
    (folder / "3.json").write_text(json.dumps({"results": [c]}))
    (folder / "deep" / "4.json").write_text(json.dumps(d))
    (folder / "5.json").write_text("\n".join([json.dumps(e), ""]))
    got = traces.read_traces(spark, str(folder)).orderBy("row_idx").collect()
    assert [r["SubjectEntity"] for r in got] == ["Alice", "Bob", "Acme", "Prize", "PrivateCo"]
    headers, passes = traces.samples(traces.read_traces(spark, str(folder)))
    assert headers.count() == 15 and passes.count() == 9
    with pytest.raises(DataError, match="passes"):
        traces.samples(traces.read_traces(spark, write(tmp_path / "bad.jsonl", [trace(GOLD[0], "not-a-list")])))
    with pytest.raises(DataError, match="no trace rows"):
        traces.read_traces(spark, write(tmp_path / "none.jsonl", [{"a": 1}]))


def test_calibration(spark, tmp_path):
    train, path = write(tmp_path / "train.jsonl", GOLD), write(tmp_path / "t.jsonl", trace_rows())
    out = tmp_path / "c.yaml"
    got = calibrate_files.calibrate_files(spark, train, path, str(out))
    results = got["calibration_provenance"]["results"]
    assert results["personHasCityOfDeath"]["train_macro_f1"] == 1.0 and results["companyTradesAtStockExchange"]["train_macro_f1"] == 1.0 and results["awardWonBy"]["train_macro_f1"] > 0
    assert set(got["generation"]["candidate_thresholds"]) == {"companyTradesAtStockExchange", "awardWonBy"} and out.exists()
    with pytest.raises(DataError, match="not present"):
        calibrate_files.calibrate_files(spark, train, write(tmp_path / "x.jsonl", [*trace_rows(), trace(fact("Leak", "awardWonBy", []), [["x"]])]), str(out))
    partial = write(tmp_path / "p.jsonl", trace_rows()[:1])
    with pytest.raises(DataError, match="incomplete"):
        calibrate_files.calibrate_files(spark, train, partial, str(out))
    some = calibrate_files.calibrate_files(spark, train, partial, str(out), allow_partial=True)["calibration_provenance"]["results"]["personHasCityOfDeath"]
    assert (some["rows"], some["train_rows_available"], some["coverage_complete"]) == (1, 2, False)
    with pytest.raises(DataError, match="duplicate"):
        calibrate_files.calibrate_files(spark, train, write(tmp_path / "d.jsonl", trace_rows() + trace_rows()[:1]), str(out))
    with pytest.raises(DataError, match="not copied exactly"):
        calibrate_files.calibrate_files(spark, write(tmp_path / "e.jsonl", [fact("Alice", "personHasCityOfDeath", [["Rome"]])]), path, str(out), bundled=train)
    gold = records.gold_facts(records.read_records(spark, train))
    rows = traces.read_traces(spark, path)
    with pytest.raises(DataError, match="unsupported"):
        calibration.calibrate(gold, *traces.samples(rows), rows, ["hasArea"])


COT_GOLD = [fact("Island", "hasArea", [["100"]]), fact("Country", "countryLandBordersCountry", [["Northland"], ["Southland"]]), fact("Prize", "awardWonBy", [["Ada"], ["Bob"]]), fact("Living Person", "personHasCityOfDeath", [])]
STEPS = {
    "Island": [(" good ", ["104"]), ("bad", ["106"]), ("", ["100"]), ("good", ["104 "])], "Country": [("both", ["Northland", "southland"]), ("one", ["Northland"])],
    "Prize": [("sub", ["Ada", "ada"]), ("miss", ["Ada", "Wrong"]), ("none", []), ("unread", None)], "Living Person": [("alive", [])],
}


def cot_traces(model="m", size=27):
    return [trace(g, [["x"]], model=model, model_parameters_billion=size, workflow_steps=[{"rationale": r, "parsed": p} for r, p in STEPS[g["SubjectEntity"]]]) for g in COT_GOLD]


def test_reasoning_paths(spark, tmp_path):
    train, path, out = write(tmp_path / "train.jsonl", COT_GOLD), write(tmp_path / "t.jsonl", cot_traces()), str(tmp_path / "out" / "cot.jsonl")
    assert reasoning.build_file(spark, train, path, out) == 4
    assert [(r["SubjectEntity"], r["ObjectEntities"]) for r in read(out)] == [("Island", ["104"]), ("Country", ["Northland", "southland"]), ("Prize", ["Ada"]), ("Living Person", [])]
    assert reasoning.load_paths(spark, out, train, "m", 27).count() == 4
    for args in (("other", 27), ("m", 12)):
        with pytest.raises(DataError, match="does not fit"):
            reasoning.load_paths(spark, out, train, *args)
    manifest = reasoning.manifest_path(out)
    good = manifest.read_text()
    for change in ({"row_count": 5}, {"synthetic_cot_sha256": "0" * 64}, {"manifest_version": True}, {"traces_sha256": "x"}, {"extra": 1}):
        manifest.write_text(json.dumps(json.loads(good) | change))
        with pytest.raises(DataError):
            reasoning.load_paths(spark, out, train, "m", 27)
    manifest.write_text(good)
    open(path, "a").write("\n")
    with pytest.raises(DataError, match="traces_sha256"):
        reasoning.load_paths(spark, out, train, "m", 27, path)
    for target in (train, path):
        with pytest.raises(DataError, match="differ"):
            reasoning.build_file(spark, train, path, target)
    with pytest.raises(DataError, match="one model"):
        reasoning.build_file(spark, train, write(tmp_path / "mix.jsonl", cot_traces()[:2] + cot_traces("n")[2:]), out)


def test_path_rules(spark, tmp_path):
    gold = records.gold_facts(records.read_records(spark, write(tmp_path / "train.jsonl", COT_GOLD)))
    rows = [
        (0, "Island", "hasArea", ["104"], "r", "m", 27.0), (1, "Nobody", "hasArea", ["104"], "r", "m", 27.0), (2, "Island", "hasArea", ["104"], " ", "m", 27.0), (3, "Island", "hasArea", ["106"], "r", "m", 27.0),
        (4, "Prize", "awardWonBy", ["Ada", "Wrong"], "r", "m", 27.0), (5, "Prize", "awardWonBy", [" Ada"], "r", "m", 27.0), (6, "Prize", "awardWonBy", ["Ada"], "r", "n", 27.0), (7, "Prize", "awardWonBy", ["Ada"], "r", "m", 12.0),
    ]
    paths = spark.createDataFrame(rows, "row_idx long, SubjectEntity string, Relation string, ObjectEntities array<string>, Rationale string, Model string, ModelParametersBillion double")
    got = {r["row_idx"]: r["problem"] for r in reasoning.path_violations(paths, gold).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5, 6, 7] and "not in the training" in got[1] and "another model" in got[6] and "another size" in got[7]


# --- row shards ---


def test_row_shards(tmp_path):
    keys = [("Island", "hasArea"), ("Other", "hasArea")]
    store = RowShards(tmp_path, {"t": 1}, keys)
    assert store.load() == []
    store.open()
    prediction, raw = fact("Island", "hasArea", ["100"]), {"row_index": 0, "SubjectEntity": "Island", "Relation": "hasArea"}
    store.write(0, prediction, raw)
    store.write(0, prediction, raw)
    assert [r["prediction"] for r in RowShards(tmp_path, {"t": 1}, keys).load()] == [prediction]
    with pytest.raises(DataError, match="refusing"):
        store.write(0, fact("Island", "hasArea", ["101"]), raw)
    with pytest.raises(DataError, match="manifest"):
        RowShards(tmp_path, {"t": 2}, keys).load()
    record = json.loads(store.path(0).read_text())
    for change in ({"version": 2}, {"row_index": True}, {"prediction": fact("Other", "hasArea", [])}, {"raw": None}, {"raw": raw | {"row_index": 1}}, *({"prediction": fact("Island", "hasArea", o)} for o in ("100", [["100"]], [100], ["100", None]))):
        store.path(0).write_text(json.dumps(record | change))
        with pytest.raises(DataError, match="shard"):
            store.load()
    store.path(0).rename(store.path(1))
    with pytest.raises(DataError, match="contiguous"):
        store.load()


def plain_choice(rows, relation, limit, subject, offset):
    """The rule for one target, row by row."""
    own = [r for r in rows if r[2] == relation and r[1] != subject]
    if limit <= 0 or not own:
        return []

    def pool(empty):
        group = [r for r in own if (not r[3]) is empty]
        turned = []
        for told in (True, False):
            ring = [r for r in group if bool(r[4] and r[4].strip()) is told]
            shift = offset % len(ring) if ring else 0
            turned += ring[shift:] + ring[:shift]
        return [r for i, r in enumerate(turned) if r[1] not in {x[1] for x in turned[:i]}]

    e, f = pool(True), pool(False)
    n_e = min(round(limit * len(e) / len(own)), len(e))
    n_f = min(limit - n_e, len(f))
    n_e = min(limit - n_f, len(e))
    e, f, out = e[:n_e], f[:n_f], []
    used = 0
    for i in range(n_e + n_f):
        if used < n_e and (n_f == i - used or (used + 0.5) / n_e <= (i + 0.5) / (n_e + n_f)):
            out.append(e[used][0])
            used += 1
        else:
            out.append(f[i - used][0])
    return out


def test_examples_against_the_plain_rule(spark):
    rng = random.Random(9)
    rows = [
        (i, f"s{rng.randrange(14)}", rng.choice(["r", "q"]), [] if rng.random() < 0.4 else [["o"]], "why" if rng.random() < 0.3 else rng.choice([None, " "]))
        for i in range(60)
    ]
    table = spark.createDataFrame(rows, "row_idx long, SubjectEntity string, Relation string, ObjectEntities array<array<string>>, Rationale string")
    asked = [(t, f"s{rng.randrange(16)}", rng.choice(["r", "q", "none"]), rng.randrange(40), rng.randrange(8)) for t in range(60)]
    targets = spark.createDataFrame(asked, "target int, SubjectEntity string, Relation string, offset int, limit int")
    got = {t: [] for t, *_ in asked}
    for r in examples.select_examples(targets, table).orderBy("place").collect():
        got[r["target"]].append(r["row_idx"])
    assert got == {t: plain_choice(rows, rel, limit, s, o) for t, s, rel, o, limit in asked}
