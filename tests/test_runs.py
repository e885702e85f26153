import json

import pytest
from pyspark.sql import functions as F

from factloom import cli, config
from factloom.operators import inference
from factloom.plans import run
from factloom.policy import POLICIES
from factloom.sources import client, records, training
from factloom.sources.records import DataError

ENDPOINT = {"model": "m", "model_parameters_billion": 27, "retry_backoff_seconds": 0.01}


def settings(**generation):
    samples = dict.fromkeys(POLICIES, 3) | generation.pop("samples", {})
    return config.parse_config({"lm_studio": ENDPOINT, "generation": {"samples": samples, **generation}})


def answers(*sets):
    return [json.dumps({"rationale": "r", "answers": s}) if isinstance(s, list) else s for s in sets]


def awards(*sets):
    return [json.dumps({"rationale": "r", "candidates": [{"recipient": x, "work": None, "year": None} for x in s]}) for s in sets]


ANCHOR = '{"description": "d", "identity_checks": ["c"]}'
# relation, sample texts, further stages, thresholds, expected objects
CASES = [
    ("hasArea", answers(["100"], ["110"], ["120"], ["130"]), {}, {}, ["115"]),
    ("hasCapacity", answers(["1000"], ["1200"], ["1100"]), {}, {}, ["1100"]),
    ("personHasCityOfDeath", answers([], ["Paris"], [], ["Paris"], []), {}, {"abstention_thresholds": {"personHasCityOfDeath": 0.6, "companyTradesAtStockExchange": 0.5}}, []),
    ("companyTradesAtStockExchange", answers(["NYSE"], ["New York Stock Exchange"], ["NYSE"], []), {}, {"candidate_thresholds": {"companyTradesAtStockExchange": 0.75, "awardWonBy": 0.05}, "abstention_thresholds": {"personHasCityOfDeath": 0.5, "companyTradesAtStockExchange": 1.0}}, ["New York Stock Exchange"]),
    ("countryLandBordersCountry", answers(["France"], ["Spain"]), {"completion": '{"answers": ["Portugal"]}', "verification": '{"answers": ["France", "Portugal"]}'}, {}, ["France", "Portugal"]),
    ("countryLandBordersCountry", answers(["France"]), {"completion": '{"answers": []}', "verification": "unreadable"}, {}, ["France"]),
    ("awardWonBy", awards(["Recipient A"], [], ["Recipient B"], ["Recipient B"]), {"completion": awards(["Recipient C"])[0]}, {"candidate_thresholds": {"companyTradesAtStockExchange": 0.3, "awardWonBy": 0.25}}, ["Recipient A", "Recipient B", "Recipient C"]),
    ("personHasCityOfDeath", answers("not JSON", ["Paris"], ["Paris"]), {}, {}, ["Paris"]),
    ("personHasCityOfDeath", answers("not JSON", "nor this"), {}, {}, []),
    ("countryLandBordersCountry", answers([], [], []), {}, {}, []),
    ("countryLandBordersCountry", answers(["France"], ["France"], ["France"]), {"completion": '{"answers": ["Germany"]}', "verification": '{"answers": ["France", "Germany"]}'}, {}, ["France", "Germany"]),
    ("countryLandBordersCountry", answers(["France"]), {"completion": "??", "verification": '{"answers": ["france"]}'}, {}, ["France"]),
    ("countryLandBordersCountry", answers(["France"]), {"completion": '{"answers": ["Italy"]}', "verification": '{"answers": []}'}, {}, []),
]
NAMES = "row_idx long, SubjectEntity string, Relation string, ObjectEntities array<array<string>>"
TRAIN = [
    (0, "Acme", "companyTradesAtStockExchange", [["New York Stock Exchange", "NYSE"]]), (1, "Country", "countryLandBordersCountry", [["Northland"]]), (2, "Dead", "personHasCityOfDeath", [["Rome"]]),
    (3, "Alive", "personHasCityOfDeath", []), (4, "Lake", "hasArea", [["7"]]), (5, "Hall", "hasCapacity", [["9"]]), (6, "Prize", "awardWonBy", [["Ada"]]),
]


def predicted(spark, group, generation):
    """Cases that share settings, as rows of one run."""
    texts, rows = {}, []
    samples = {}
    for i, (relation, said, more, _, _) in group:
        rows.append((i, f"Subject {i}", relation))
        samples[relation] = len(said)
        texts[(i, "anchor", 0)] = ANCHOR
        texts.update({(i, "sample", k): t for k, t in enumerate(said)} | {(i, stage, 0): t for stage, t in more.items()})
    gold = spark.createDataFrame(TRAIN, NAMES)
    table = spark.createDataFrame(rows, "row_idx long, SubjectEntity string, Relation string")
    return inference.predict(table, client.ReplayClient(texts), settings(samples=samples, **generation), gold, gold)


def test_rows_end_to_end(spark):
    groups = {}
    for i, case in enumerate(CASES):
        key = json.dumps([case[3], case[0], len(case[1])])
        groups.setdefault(key, []).append((i, case))
    merged = []  # one run holds cases of different relations under the same thresholds
    for members in groups.values():
        for m in merged:
            if m[0][1][3] == members[0][1][3] and not {c[0] for _, c in m} & {c[0] for _, c in members}:
                m += members
                break
        else:
            merged.append(list(members))
    for group in merged:
        predictions, traces = predicted(spark, group, group[0][1][3])
        got = {r["row_idx"]: r["ObjectEntities"] for r in predictions.collect()}
        assert got == {i: case[4] for i, case in group}
        for r in traces.collect():
            i = r["row_index"]
            case = CASES[i]
            unread = sum("JSON" in t or "nor" in t for t in case[1])
            assert r["unusable_samples"] == unread and r["self_consistency"]["samples"] == len(case[1]) - unread
            stages = [s["stage"] for s in r["workflow_steps"]]
            assert stages == ["sample"] * len(case[1]) + [s for s in ("completion", "verification") if s in case[2]]
            assert r["final"] == case[4] and r["anchor"]["description"] == "d"
            own, policy = r["self_consistency"], settings(**case[3]).generation.policies()[case[0]]
            assert (own["candidate_threshold"], own["none_threshold"]) == (policy.candidate, policy.none)
            done, judged = r["completion"], r["verification"]
            if not policy.completes:
                assert done is None
            elif "completion" not in case[2]:
                assert done["skipped"] == "unanimous-empty-aggregate" and done["missing"] is None
            else:
                assert done["usable"] == ("answers" in case[2]["completion"] or "candidates" in case[2]["completion"]) and done["alias_rewrites"] == [] and done["skipped"] is None
            assert (judged is not None) == ("verification" in case[2])
            if judged is not None:
                assert judged["accepted"] == case[4] and judged["fallback"] == (None if "{" in case[2]["verification"] else "malformed-verifier-response")


def test_seeds_and_messages(spark):
    seen = spark.sparkContext.accumulator([], ListParam())

    class Recorder:
        def chat(self, request):
            seen.add([(request["row_idx"], request["stage"], request["sample_idx"], request["seed"], request["max_tokens"], request["temperature"], len(request["messages"]), request["response_format"] is not None)])
            return {"text": ANCHOR if request["stage"] == "anchor" else '{"rationale": "r", "answers": ["100"]}'}

    gold = spark.createDataFrame(TRAIN, NAMES)
    rows = spark.createDataFrame([(0, "X", "hasArea"), (2, "Lake", "hasArea")], "row_idx long, SubjectEntity string, Relation string")
    predictions, _ = inference.predict(rows, Recorder(), settings(samples={"hasArea": 4}, output_mode="json_schema"), gold, gold)
    assert {r["row_idx"]: r["ObjectEntities"] for r in predictions.collect()} == {0: ["100"], 2: ["100"]}
    calls = sorted(set(seen.value))
    assert [c[3] for c in calls if c[0] == 0] == [42, 52, 53, 54, 55] and [c[3] for c in calls if c[0] == 2] == [2042, 2052, 2053, 2054, 2055]
    assert {(c[4], c[5]) for c in calls if c[1] == "anchor"} == {(256, 0.2)} and {c[4] for c in calls if c[1] == "sample"} == {2048}
    assert {c[6] for c in calls if c[1] == "sample" and c[0] == 0} == {4} and {c[6] for c in calls if c[1] == "sample" and c[0] == 2} == {2}
    assert all(c[7] for c in calls)


class ListParam:
    """Gathers lists of calls."""

    def zero(self, value):
        return []

    def addInPlace(self, a, b):
        return a + b


def test_number_of_calls():
    rows = {"hasArea": 100, "hasCapacity": 100, "personHasCityOfDeath": 100, "companyTradesAtStockExchange": 100, "countryLandBordersCountry": 68, "awardWonBy": 10}
    samples = {"hasArea": 7, "hasCapacity": 7, "personHasCityOfDeath": 20, "companyTradesAtStockExchange": 10, "countryLandBordersCountry": 3, "awardWonBy": 20}
    assert inference.expected_calls(rows, samples, {"countryLandBordersCountry": 50, "awardWonBy": 10}) == 5392
    assert inference.expected_calls(rows, samples, {"countryLandBordersCountry": 68, "awardWonBy": 10}) == 5428


# --- client ---


class Wire:
    def __init__(self, *replies):
        self.replies, self.sent = list(replies), []

    def __call__(self, url, payload, token, timeout):
        self.sent.append((url, dict(payload), token))
        reply = self.replies.pop(0)
        if isinstance(reply, Exception):
            raise reply
        status, headers, body = reply
        return status, headers, body if isinstance(body, str) else json.dumps(body)


def good(text="hi", **message):
    return 200, {}, {"choices": [{"message": {"content": text} | message}], "provider": "p", "usage": {"n": 1}}


ASK = {"messages": [{"role": "user", "content": "q"}], "temperature": 0.6, "top_p": 0.9, "max_tokens": 9, "seed": 4, "response_format": {"type": "json_schema"}}


def talk(*replies, **endpoint):
    wire, waits = Wire(*replies), []
    c = client.HttpClient(config.Endpoint(**(ENDPOINT | {"max_retries": 2, **endpoint})), wire, waits.append)
    return c, wire, waits


def test_client_answers():
    c, wire, waits = talk(good())
    assert c.chat(ASK) == {"text": "hi", "provider": "p", "usage": {"n": 1}} and waits == []
    url, payload, token = wire.sent[0]
    assert url.endswith("/v1/chat/completions") and token == "lm-studio" and payload["seed"] == 4 and payload["reasoning"] == {"enabled": False} and "provider" not in payload
    assert talk(good("", reasoning_content="deep"))[0].chat(ASK)["text"] == "deep"


def test_client_retries():
    c, wire, waits = talk((429, {"Retry-After": "7"}, "slow"), (503, {}, "down"), good())
    assert c.chat(ASK)["text"] == "hi" and waits[0] == 7.0 and 0 < waits[1] <= 0.02 and len(wire.sent) == 3
    for reply in ((200, {}, {"error": {"message": "upstream", "code": 502}}), (200, {}, {"error": "odd"}), (200, {}, "no json"), (200, {}, [1]), (200, {}, {"choices": []}), client.Retry("reset")):
        assert talk(reply, good())[0].chat(ASK)["text"] == "hi"
    with pytest.raises(RuntimeError, match="after 3 attempts"):
        talk(*[(500, {}, "x")] * 3)[0].chat(ASK)
    for reply in ((401, {}, "no"), (200, {}, {"error": {"message": "bad", "code": 400}}), good(" ")):
        with pytest.raises(RuntimeError):
            talk(reply)[0].chat(ASK)


def test_client_drops_what_is_not_supported():
    c, wire, waits = talk((500, {}, "seed is not supported"), (429, {}, "response_format unsupported"), good())
    assert c.chat(ASK)["text"] == "hi"
    assert "seed" not in wire.sent[1][1] and "response_format" not in wire.sent[2][1] and "top_p" in wire.sent[2][1]
    assert client.wait_of("x") is None and client.wait_of("-3") == 0.0 and client.refused("seed missing") is None
    assert c.backoff(20, None) <= 60 and c.backoff(1, 1000) == 60


def test_api_key(tmp_path, monkeypatch):
    env = tmp_path / ".env"
    env.write_text('# c\nKEY_A = "quoted"\nBAD\nKEY_B=file\n')
    monkeypatch.setenv("KEY_B", "real")
    key = lambda name: config.api_key(config.Endpoint(api_key_env=name), env)
    assert key("KEY_A") == "quoted" and key("KEY_B") == "real" and key(None) == "lm-studio"
    with pytest.raises(config.ConfigError):
        key("KEY_C")


# --- configuration ---


def test_configuration(tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text("lm_studio: {model: m, model_parameters_billion: 27}\ngeneration: {few_shot: 2}\ncalibration_provenance: {a: 1}\n")
    loaded = config.load_config(path)
    assert loaded.generation.few_shot == 2 and loaded.generation.shots()["awardWonBy"] == 1 and loaded.generation.shots()["hasArea"] == 2
    quick = config.smoke(loaded)
    assert set(quick.generation.samples.values()) == {1} and quick.generation.max_tokens == 2048 and quick.generation.temperature == 0.2
    base = {"lm_studio": dict(ENDPOINT)}
    bad = [
        [], {"lm_studio": 1}, base | {"odd": 1}, base | {"train_data_file": 5}, base | {"calibration_provenance": 1}, {"lm_studio": {"model": "m", "odd": 1}}, base | {"generation": [1]},
        *({"lm_studio": ENDPOINT | x} for x in ({"model": " "}, {"model_parameters_billion": 33}, {"model_parameters_billion": True}, {"max_retries": 21}, {"timeout_seconds": 0}, {"retry_backoff_seconds": 0}, {"api_key_env": ""}, {"reasoning": 1})),
        *(base | {"generation": x} for x in ({"temperature": 3}, {"top_p": 0}, {"max_tokens": True}, {"seed": 1.5}, {"samples": {"hasArea": 1}}, {"output_mode": "x"}, {"concurrency": 0}, {"few_shot": 21}, {"few_shot_by_relation": {"x": 1}},
            {"candidate_thresholds": {"awardWonBy": 0.1}}, {"abstention_thresholds": {"personHasCityOfDeath": 2, "companyTradesAtStockExchange": 0}}, {"samples": dict.fromkeys(POLICIES, 21)})),
    ]
    for raw in bad:
        with pytest.raises(config.ConfigError):
            config.parse_config(raw)


# --- command line ---


def lines(path, rows):
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))
    return str(path)


def fact(subject, relation, objects):
    return {"SubjectEntity": subject, "Relation": relation, "ObjectEntities": objects}


class Fixed:
    def __init__(self, fail=()):
        self.fail = set(fail)

    def chat(self, request):
        if request["row_idx"] in self.fail:
            raise RuntimeError("down")
        return {"text": ANCHOR if request["stage"] == "anchor" else json.dumps({"rationale": "r", "answers": [str(100 + request["row_idx"])]})}


@pytest.fixture
def job(tmp_path):
    conf = tmp_path / "c.yaml"
    train = lines(tmp_path / "train.jsonl", [fact("Lake", "hasArea", [["7"]])])
    conf.write_text(json.dumps({"lm_studio": ENDPOINT, "generation": {"samples": dict.fromkeys(POLICIES, 2)}, "train_data_file": train}))
    rows = lines(tmp_path / "in.jsonl", [fact("A", "hasArea", [["1"]]), fact("B", "hasArea", []), fact("C", "hasArea", [])])
    return tmp_path, str(conf), rows


def execute(spark, *argv, client=None):
    return cli.execute(spark, cli.parser().parse_args([str(a) for a in argv]), client)


def test_dry_run_and_guards(spark, job):
    tmp, conf, rows = job
    out = tmp / "o.jsonl"
    assert "1 rows" in execute(spark, "predict", "-c", conf, "-i", rows, "-o", out, "--dry-run", "--limit", "1")
    assert [json.loads(x) for x in out.read_text().splitlines()] == [fact("A", "hasArea", [])]
    for more, said in ((["--model", "x"], "together"), (["--limit", "-1"], "negative"), (["--max-restarts", "-1"], "negative")):
        with pytest.raises(DataError, match=said):
            execute(spark, "predict", "-c", conf, "-i", rows, "-o", out, "--dry-run", *more)
    with pytest.raises(DataError, match="differ"):
        execute(spark, "predict", "-c", conf, "-i", rows, "-o", rows, "--dry-run")
    with pytest.raises(DataError, match="duplicate"):
        execute(spark, "predict", "-c", conf, "-i", lines(tmp / "d.jsonl", [fact("A", "hasArea", [])] * 2), "-o", out, "--dry-run")
    with pytest.raises(DataError, match="unsupported relation"):
        execute(spark, "predict", "-c", conf, "-i", lines(tmp / "u.jsonl", [fact("A", "odd", [])]), "-o", out, "--dry-run")


def test_run_and_resume(spark, job):
    tmp, conf, path = job
    loaded = config.load_config(conf)
    gold = training.train_rows(spark, loaded.train_data_file)
    shots = run.example_rows(spark, loaded, gold)
    rows = run.input_rows(spark, path)
    out = str(tmp / "o.jsonl")
    with pytest.raises(Exception, match="down"):
        run.run(spark, rows, Fixed(fail=[1]), loaded, gold, shots, out, chunk=1)
    folder = run.state_folder(tmp / "o.jsonl", None)
    first = (folder / "rows" / "000000.json").read_bytes()
    with pytest.raises(DataError, match="resume"):
        run.run(spark, rows, Fixed(), loaded, gold, shots, out, chunk=1)
    assert run.run(spark, rows, Fixed(fail=[0]), loaded, gold, shots, out, resume=True, chunk=2) == 3
    assert (folder / "rows" / "000000.json").read_bytes() == first
    assert [json.loads(x)["ObjectEntities"] for x in open(out)] == [["100"], ["101"], ["102"]]
    assert json.loads((folder / "complete.json").read_text()) == {"completed_rows": 3, "total_rows": 3} and len(json.loads((tmp / "raw" / "o.raw.json").read_text())) == 3
    other = config.parse_config({"lm_studio": ENDPOINT, "generation": {"samples": dict.fromkeys(POLICIES, 2), "temperature": 0.1}, "train_data_file": loaded.train_data_file})
    with pytest.raises(DataError, match="manifest"):
        run.run(spark, rows, Fixed(), other, gold, shots, out, resume=True)


def test_predict_restarts(spark, job, monkeypatch):
    tmp, conf, rows = job
    tries = []
    real = run.run

    def flaky(*args, **kw):
        tries.append(args[7])
        if len(tries) == 1:
            raise RuntimeError("lost")
        return real(*args, **kw)

    monkeypatch.setattr(run, "run", flaky)
    said = execute(spark, "predict", "-c", conf, "-i", rows, "-o", tmp / "o.jsonl", "--restart-delay", "0", "--smoke", client=Fixed())
    assert "3 predictions" in said and tries == [False, True]


def test_training_rows_must_be_bundled(spark, job):
    tmp, conf, rows = job
    bundled = lines(tmp / "bundled.jsonl", [fact("Sea", "hasArea", [["7"]])])
    for argv in (["predict", "-c", conf, "-i", rows, "-o", tmp / "o.jsonl"], ["calibrate", "--train", tmp / "train.jsonl", "--traces", rows, "--output", tmp / "y"], ["build-cot", "--train", tmp / "train.jsonl", "--traces", rows, "--output", tmp / "z"]):
        with pytest.raises(DataError, match="not copied exactly"):
            execute(spark, *argv, "--bundled", bundled, client=Fixed())


def test_evaluate_and_parser(spark, job):
    tmp, _, _ = job
    gold, pred = lines(tmp / "g.jsonl", [fact("A", "hasArea", [["100"]])]), lines(tmp / "p.jsonl", [fact("A", "hasArea", ["104"])])
    shown = execute(spark, "evaluate", "-p", pred, "-g", gold)
    assert "*** All Relations ***" in shown and "hasArea" in shown
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["predict"])


# --- streaming ---


def test_scores_as_files_arrive(spark, tmp_path):
    from factloom.streaming.resume import latest_scores, score_stream

    folder = tmp_path / "in"
    folder.mkdir()
    gold = spark.createDataFrame([(0, "A", "x", [["a"]]), (1, "B", "x", [["b"]])], NAMES)
    for k, row in enumerate((fact("A", "x", ["a"]), fact("B", "x", ["z"]))):
        lines(folder / f"{k}.json", [row])
        score_stream(spark, str(folder), gold, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = {r["SubjectEntity"]: r["f1"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"A": 1.0, "B": 0.0}
    # a key that comes again counts by its last batch, copies within a batch once
    lines(folder / "9.json", [fact("B", "x", ["b"]), fact("A", "x", ["a"]), fact("A", "x", ["a"])])
    score_stream(spark, str(folder), gold, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert {r["SubjectEntity"]: r["f1"] for r in latest_scores(spark, str(tmp_path / "out")).collect()} == {"A": 1.0, "B": 1.0}


def test_policy_columns(spark):
    from factloom.policy import by_relation

    got = spark.createDataFrame([("hasArea",), ("odd",)], "Relation string").select(by_relation({"hasArea": 1}, default=0).alias("x"), F.lit(1)).collect()
    assert [r["x"] for r in got] == [1, 0]
    assert records.KEY == ("SubjectEntity", "Relation")
