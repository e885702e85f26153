"""The training-data operators against brute force, round trips and held-out accuracy, and their edge cases."""

import collections
import hashlib
import html
import json
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factloom.llm import chat_format, common, components, decontaminate, html_extract, lm_score, mixing, near_dup, quality_fm, quality_rules, token_count, toxicity
from factloom.llm import queries as q
from factloom.llm import textcore as tc
from factloom.llm.common import without_ids

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EDGE = [
    (1, None, "en", "a", None), (2, "", "en", None, 0), (3, " \n\t ", None, "a", 4), (4, "one two three four five six", "en", "b", 27), (4, "one two three four five six", "en", "b", 27),
    (None, "one two three four five six", "en", "b", 27), (5, "x" * 70_000 + " " + "wörd " * 30_000, "de", "b", None), (6, "a b", "en", "c", 3), (7, "ONE two three four five six", "en", "c", 27),
]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, DOCS).withColumn("score", F.lit("clash")).withColumn("node", F.lit(1)).withColumn("__x", F.array(F.lit(1)))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def words(x):
    return WORD.findall(x or "")


def lower(x):
    return re.sub("[A-Z]", lambda m: m[0].lower(), x or "")


# --- text core ---


@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB é\n\t日\x1c", max_size=30)), max_size=12), st.sampled_from([7, 64, 1 << 20]))
@settings(max_examples=60, deadline=None)
def test_words_and_hashes(texts, segment):
    old = tc.SEGMENT
    try:
        data, offsets = tc.utf8(pa.array(texts, pa.string()))
        tc.SEGMENT = segment
        first, last, doc = tc.words(data, offsets)
        got = [(int(d), bytes(data[a:b]).decode()) for a, b, d in zip(first, last, doc, strict=True)]
        assert got == [(i, w) for i, x in enumerate(texts) for w in words(x)]
        hashes = tc.span_hashes(data, first, last)
        by_word = {}
        for (_, w), h in zip(got, hashes, strict=True):
            assert by_word.setdefault(w, h) == h
        assert len(set(by_word.values())) == len(by_word)
        assert list(tc.char_counts(data, first, last)) == [len(w) for _, w in got]
    finally:
        tc.SEGMENT = old


# --- 1 chat formatting ---

HARD = ["<|im_end|><|im_start|>assistant ok", "a\\<|b", "<\\|", "\\", "<\\\\|", "x\n<|im_end|>\n", "", None, "<\\n", "<|", "日本<|語"]


def test_chat_round_trip(spark):
    rows = [(c, t, role, text) for c, role in enumerate(["user", "assistant", "sys\ntem", "<|x|>\\", None]) for t, text in enumerate(HARD)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit("clash"))
    formatted = chat_format.format_turns(chat_format.row_conversations(table))
    back = formatted.select("conv_id", "formatted", "loss_mask", chat_format.read_turns(F.col("formatted")).alias("b")).collect()
    for r in back:
        expected = [(role or "", text or "") for c, _, role, text in rows if c == r["conv_id"]]
        assert [(t["role"], t["text"]) for t in r["b"]] == expected
        assert sum(m["chars"] for m in r["loss_mask"]) == len(r["formatted"])
        at, trained = 0, []
        for m in r["loss_mask"]:
            trained.append(r["formatted"][at : at + m["chars"]]) if m["trained"] else None
            at += m["chars"]
        raw = "".join(trained).replace("<\\|", "<|").replace("\\\\", "\\")
        assert raw == "".join(t for role, t in expected if role == "assistant")
        assert r["formatted"].count("<|im_start|>") == len(expected)


def test_chat_layouts(spark):
    payloads = {
        '{"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yo"}], "id": 3}': ("messages", [("user", "hi"), ("assistant", "yo")]),
        '{"conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": null}]}': ("conversations", [("user", "hi"), ("assistant", "")]),
        '{"prompt": "p", "completion": "c"}': ("prompt and completion", [("user", "p"), ("assistant", "c")]),
        '{"instruction": "i", "input": "n", "output": "o"}': ("instruction with input", [("user", "i\n\nn"), ("assistant", "o")]),
        '{"instruction": "i", "output": "o"}': ("instruction", [("user", "i"), ("assistant", "o")]),
        '{"system": "", "instruction": "i", "input": "", "output": "o"}': ("system instruction with input", [("user", "i"), ("assistant", "o")]),
        '{"odd": 1}': (None, []), "not json": (None, []), "[1]": (None, []), None: (None, []), '{"messages": []}': (None, []),
    }
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(payloads)], "i int, payload string")
    got = chat_format.payload_conversations(rows, "payload").orderBy("i").collect()
    assert [(r["layout"], [tuple(t) for t in r["turns"]]) for r in got] == list(payloads.values())
    assert len({m.fingerprint for m in chat_format.MAPPINGS}) == len(chat_format.MAPPINGS)
    with pytest.raises(ValueError):
        chat_format.row_conversations(rows)


def test_chat_layouts_with_extra_known_keys(spark):
    chat = '"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yo"}]'
    said = [("user", "hi"), ("assistant", "yo")]
    payloads = {
        '{"instruction": "i", "input": "n", "output": "o", "text": "all of it"}': ("instruction with input", [("user", "i\n\nn"), ("assistant", "o")]),
        f'{{"prompt": "hi", {chat}}}': ("messages", said),
        f'{{"system": "s", {chat}, "role": "x"}}': ("system messages", [("system", "s"), *said]),
        f'{{"system": null, {chat}}}': ("system messages", said),
        '{"system": "s", "prompt": "p", "completion": "c", "turn": 1}': ("system prompt and completion", [("system", "s"), ("user", "p"), ("assistant", "c")]),
        '{"conv_id": 1, "turn": 1, "role": "user", "text": "x"}': (None, []),
    }
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(payloads)], "i int, payload string")
    got = chat_format.payload_conversations(rows, "payload").orderBy("i").collect()
    assert [(r["layout"], [tuple(t) for t in r["turns"]]) for r in got] == list(payloads.values())


def test_chat_elements_of_mixed_layouts(spark):
    payloads = {
        '{"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "text": "not lost"}]}': ("messages", [("user", "a"), ("assistant", "not lost")]),
        '{"messages": [{"role": "user"}, {"from": "gpt", "value": "b"}, {"role": "assistant", "content": ["x"]}]}': ("messages", [("user", ""), ("assistant", "b"), ("assistant", '["x"]')]),
        '{"turns": [{"content": "no role"}, {"role": null, "text": null}]}': ("turns", [("", "no role"), ("", "")]),
        '{"messages": [{"role": "user", "content": "a"}, {"said": "unknown"}]}': (None, []),
        '{"messages": [{"role": "user", "content": "a"}, "bare"]}': (None, []),
        '{"messages": {"role": "user", "content": "a"}}': (None, []), '{"messages": null}': (None, []),
    }
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(payloads)], "i int, payload string")
    got = chat_format.payload_conversations(rows, "payload").orderBy("i").collect()
    assert [(r["layout"], [tuple(t) for t in r["turns"]]) for r in got] == list(payloads.values())


def test_chat_loss_is_read_through_the_mask(spark):
    table = spark.createDataFrame([(1, 0, "user", "qu <|x"), (1, 1, "assistant", "a \\ <|b"), (1, 2, "assistant", "é"), (None, None, None, None), (2, 0, "human", "x" * 300_000), (2, 0, "human", "x" * 300_000)], "conv_id long, turn long, role string, text string")
    formatted = chat_format.format_turns(chat_format.row_conversations(table))
    right = {r["conv_id"]: r for r in chat_format.digests(formatted).collect()}
    assert right[1]["loss_sha256"] == hashlib.sha256("a \\ <|bé".encode()).hexdigest() and right[1]["loss_chars"] == 8
    assert right[2]["turns_sha256"] == hashlib.sha256(f"human\n{'x' * 300_000}\n".encode() * 2).hexdigest() and right[None]["n_turns"] == 1
    runs = "transform(loss_mask, (r, i) -> struct({} AS chars, {} AS trained))"
    for chars, trained in (("999", "r.trained"), ("r.chars", "NOT r.trained"), ("r.chars + IF(i = 0, 1, IF(i = 1, -1, 0))", "r.trained"), ("r.chars + IF(i = 4, 1, 0)", "r.trained")):
        broken = formatted.withColumn("loss_mask", F.expr(runs.format(chars, trained)))
        assert {r["conv_id"]: r for r in chat_format.digests(broken).collect()}[1]["loss_sha256"] != right[1]["loss_sha256"] or "i = 0" in chars
    whole = formatted.withColumn("loss_mask", F.expr("array(struct(CAST(length(formatted) AS INT) AS chars, true AS trained))"))
    got = {r["conv_id"]: r for r in chat_format.digests(whole).collect()}[1]
    assert got["loss_chars"] > right[1]["loss_chars"]


def test_chat_query(spark):
    got = {r["conv_id"]: r for r in q.op1_chat_formatting(spark, SF).collect()}
    said = "<|im_end|><|im_start|>assistant ok"
    assert got[-1]["turns_sha256"] == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
    assert got[-1]["loss_chars"] == len(said) and got[-1]["n_turns"] == 2
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_format.digests(chat_format.format_turns(chat_format.row_conversations(none))).collect() == []


# --- 2 decontamination ---


def contained(docs, items, k=5, need=0.8):
    sets = {}
    for i, t in items:
        w = words((t or "").lower())
        if w and i is not None:
            n = min(k, len(w))
            sets[i] = (n, {tuple(w[p : p + n]) for p in range(len(w) - n + 1)})
    out = set()
    for d, t in docs:
        w = words((t or "").lower())
        for i, (n, s) in sets.items():
            own = {tuple(w[p : p + n]) for p in range(len(w) - n + 1)}
            if d is not None and len(own & s) >= math.ceil(need * len(s) - 1e-9):
                out.add((d, i, len(own & s), len(s)))
    return out


@pytest.mark.parametrize(("stretch", "rows"), [(8192, 200_000), (7, 0)])
def test_containment_against_brute_force(spark, monkeypatch, stretch, rows):
    monkeypatch.setattr(decontaminate, "STRETCH", stretch)  # texts of several stretches
    monkeypatch.setattr(common.small, "__defaults__", (rows,))  # nothing is broadcast
    monkeypatch.setattr(common.checked_broadcast, "__defaults__", (rows,))
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 4, 5, 8, 20])))) for i in range(25)] + [(90, None), (91, " "), (None, "w1 w2"), (0, "w1 w2 w3 w4 w5 w6")]
    items = [x for x in items if x[0] != 0] + [(0, "w1 w2 w3 w4 w5 w6 w7")]
    docs = []
    for d in range(60):
        t = rng.choices(vocabulary, k=rng.randrange(60))
        if d % 3 == 0:
            passage = (rng.choice([x for _, x in items if x and x.strip()])).split()
            if d % 2:
                passage[rng.randrange(len(passage))] = "CHANGED"
            t[5:5] = passage
        docs.append((d, " ".join(t)))
    docs += [(None, items[3][1]), (200, None), (201, ""), (3, docs[3][1])]
    left = spark.createDataFrame(docs, "doc_id long, text string").withColumn("items", F.lit(0))
    right = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["n_shared"], r["n_item"]) for r in decontaminate.contained_items(left, right).collect()}
    assert got == contained(docs, items)
    assert decontaminate.contained_items(left, right.limit(0)).collect() == [] and decontaminate.contained_items(left.limit(0), right).collect() == []


# --- 3 language model ---


def backoff_scores(texts, order, least=2, alpha=0.4):
    toks = [words(lower(t)) for t in texts]
    counts = collections.Counter(tuple(w[i : i + n]) for w in toks for n in range(1, order + 1) for i in range(len(w) - n + 1))
    total = max(sum(len(w) for w in toks), 1)

    def score(w, i, n):
        if n == 1:
            return math.log(counts[(w[i],)] / total)
        gram = tuple(w[i - n + 1 : i + 1])
        if counts[gram] >= least:
            return math.log(counts[gram] / counts[gram[:-1]])
        return math.log(alpha) + score(w, i, n - 1)

    return [sum(score(w, i, min(i + 1, order)) for i in range(len(w))) for w in toks]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_lm_scores_against_brute_force(spark, order):
    rng = random.Random(order)
    texts = [" ".join(rng.choices("a b c d E f g".split(), k=rng.randrange(12))) for _ in range(40)] + [None, "", "zz"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_tokens"], r["log_score"], r["mean_log_score"]) for r in lm_score.scores(rows, order, partition_entries=20, batch_bytes=100).collect()}
    for i, (t, x) in enumerate(zip(texts, backoff_scores(texts, order), strict=True)):
        n = len(words(t))
        assert got[i][0] == n and got[i][1] == pytest.approx(x, abs=1e-3)
        assert (got[i][2] is None) == (n == 0)


def test_lm_batches_have_a_task_each(spark):
    numbers = [int(x) for x in lm_score.batch_numbers(97)]
    placed = spark.createDataFrame([(x,) for x in numbers], "n int").select(F.expr("pmod(hash(n), 97)")).collect()
    assert sorted(r[0] for r in placed) == list(range(97)) and len(lm_score.batch_numbers(lm_score.PLACED + 1)) == lm_score.PLACED + 1


def test_lm_edges(spark, edge, empty):
    got = lm_score.scores(edge).collect()
    assert len(got) == len(EDGE) and lm_score.scores(empty).collect() == []
    values = np.array([0, 1, 255, 256, (1 << 63) + 5], np.uint64)
    assert list(lm_score._unpack(lm_score._pack(values), 5)) == list(values) and len(lm_score._unpack(lm_score._pack(values[:0]), 0)) == 0


# --- 4 and 10 classifiers ---


def accuracy(rows, labels):
    held = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    return sum(r["predicted"] == labels[r["doc_id"]] for r in held) / len(held)


def test_classifiers_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = q.op4_quality_classifier(spark, folder).collect()
    assert len(rows) == 1000 and accuracy(rows, {k: v["quality"] for k, v in labels.items()}) > 0.95
    rows = q.op10_toxicity(spark, folder).collect()
    assert len(rows) == 1000 and accuracy(rows, {k: v["toxic"] for k, v in labels.items()}) > 0.85
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_labelled_rows_are_bounded_and_alike_in_any_layout(spark):
    rows = [(1, f"text {k}", "en", "a", 6) for k in range(500)] + [(k, "more", "en", "a", 4) for k in range(3, 60)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)] * 2, "doc_id long, toxic int")
    got = [sorted(map(tuple, common.labelled(docs.repartition(n), labels.repartition(n), "toxic", bound, ("n_chars",)).collect())) for n, bound in ((1, 100), (7, 100), (3, 2))]
    assert got[0] == got[1] and len(got[2]) <= 2 and set(got[2]) <= set(got[0])
    assert len({r[3] for r in got[0]}) == len(got[0]) < 60  # one row an id


def test_classifiers_learn_from_nothing_held_out(spark):
    folder = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.select("doc_id", *[F.when(common.residue("doc_id") == 2, 1 - F.col(c)).otherwise(F.col(c)).alias(c) for c in ("quality", "toxic")])
    other = docs.withColumn("lang", F.lit("x")).withColumn("source", F.lit(None).cast("string")).repartition(5)

    def scores(made):
        return {r["doc_id"]: r["score"] for r in made.collect()}

    for module, made in ((quality_fm, quality_fm.quality), (toxicity, toxicity.toxicity)):
        plain = scores(made(docs, module.fit(docs, labels)))
        assert scores(made(other, module.fit(other, turned.repartition(3)))) == plain
    # ids are no input of a score: the same texts under others score alike by one model
    model = toxicity.fit(docs, labels)
    moved = scores(toxicity.toxicity(docs.withColumn("doc_id", F.col("doc_id") + 1_000_000), model))
    assert {k - 1_000_000: v for k, v in moved.items()} == plain


def test_extreme_value_scale():
    # steps of +1 and -1: the scale is the log of the odds of a step down
    for up in (1, 10, 40):
        assert toxicity.evd_scale(np.array([-1.0, 1.0]), np.array([100 - up, up])) == pytest.approx(math.log((100 - up) / up), rel=1e-6)
    assert toxicity.evd_scale(np.array([-1.0, 1.0]), np.array([10, 90])) == 1.0 == toxicity.evd_scale(np.array([-1.0]), np.array([0]))
    # chance segments are as rare as their tail probability says, within the fit's constant
    rng = np.random.default_rng(3)
    best = [max([v for _, _, v in toxicity.segments(rng.choice([-1.0, 1.0], 400, p=[0.75, 0.25]))], default=0.0) for _ in range(1500)]
    rates = [np.mean([b >= s for b in best]) for s in (5.0, 7.0)]
    assert math.log(rates[0] / rates[1]) == pytest.approx(2 * math.log(3), abs=0.7)


def test_classifier_edges(spark, edge, empty):
    labels = spark.createDataFrame([(4, 1, 0), (6, 0, 1), (7, 1, None), (None, 1, 1), (99, 0, 1)], "doc_id long, quality int, toxic int")
    for rows in (quality_fm.quality(edge, quality_fm.fit(edge, labels)), toxicity.toxicity(edge, toxicity.fit(edge, labels))):
        got = rows.collect()
        assert len(got) == len(EDGE) and all(0 <= r["score"] <= 1 for r in got)
    none = labels.limit(0)
    assert {r["score"] for r in quality_fm.quality(edge, quality_fm.fit(edge, none)).collect()} == {0.5}
    assert len(toxicity.toxicity(edge, toxicity.fit(edge, none)).collect()) == len(EDGE)
    assert quality_fm.quality(empty, quality_fm.fit(empty, labels)).collect() == [] and toxicity.toxicity(empty, toxicity.fit(empty, labels)).collect() == []


def test_factorisation_identity():
    rng = np.random.default_rng(0)
    m = quality_fm.Machine(0.3, rng.normal(size=quality_fm.BUCKETS + quality_fm.MEASURES), rng.normal(size=(quality_fm.BUCKETS + quality_fm.MEASURES, quality_fm.FACTORS)), np.zeros(quality_fm.MEASURES), np.ones(quality_fm.MEASURES))
    index, x = np.array([3, 9, 70, 11]), rng.normal(size=4)
    raw, _ = m.raw(1, np.zeros(4, int), index, x)
    pairs = sum(m.factors[index[a]] @ m.factors[index[b]] * x[a] * x[b] for a in range(4) for b in range(a + 1, 4))
    assert raw[0] == pytest.approx(0.3 + m.linear[index] @ x + pairs)


def all_segments(x):
    def rec(a, b):
        best = (1e-12, None)
        for i in range(a, b):
            total = 0.0
            for j in range(i, b):
                total += x[j]
                if total > best[0] + 1e-12:
                    best = (total, (i, j + 1))
        return [] if best[1] is None else rec(a, best[1][0]) + [best[1]] + rec(best[1][1], b)

    return rec(0, len(x))


def test_segments_against_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(300):
        x = rng.normal(-0.3, 1, rng.integers(0, 15))
        assert [(s, e) for s, e, _ in toxicity.segments(x)] == all_segments(x)
    assert toxicity.segments(np.full(5, -1.0)) == []


def test_toxic_passages_point_into_the_text(spark):
    toxic = [(i, f"some plain words here vile vile rotten words {i} more plain text follows after that", 1) for i in range(40)]
    clean = [(100 + i, f"some plain words here nice words {i} more plain text follows after that again", 0) for i in range(120)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in toxic + clean] + [(500, "vile rotten"), (501, "nice words")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in toxic + clean], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs, toxicity.fit(docs, labels)).collect()}
    assert got[500]["predicted"] == 1 and got[501]["predicted"] == 0
    text = toxic[3][1].encode()
    assert any(b"vile" in text[p["start"] : p["end"]] for p in got[3]["passages"])


# --- 5 token counts ---


def test_token_counts(spark, edge, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(q.TOKENIZER)
    odd = ["a <|endoftext|>b  <|startoftext|>", "it's  I'LL x y", "é ́a ΣΑΣ ΟΔΟΣ x y İ", " ", "", "日本" * 50, "a" * 5000, "x " * 3000, None]
    assert token_count.count_tokens(odd, q.TOKENIZER, batch_bytes=64) == [len(library.encode(x or "", add_special_tokens=False)) for x in odd]
    assert " ".join(token_count.slices("ab cd efgh ij", " ", size=3)) == "ab cd efgh ij" and list(token_count.slices("ab cd", size=3, spaces="")) == ["ab cd"]
    assert list(token_count.slices("日本語。日本語。日本", " ", True, 4)) == ["日本語。", "日本語。", "日本"]
    got = token_count.token_counts(edge, q.TOKENIZER).collect()
    assert collections.Counter((r["doc_id"], r["n_bytes"]) for r in got) == collections.Counter((i, len((t or "").encode())) for i, t, *_ in EDGE)
    assert all(r["over_limit"] == (r["n_tokens"] > 2048) for r in got) and token_count.token_counts(empty, q.TOKENIZER).collect() == []


# --- 6 quality rules ---


def rule_counts(x):
    w = words(x)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    seen = collections.Counter(grams)
    covered = {p for i, g in enumerate(grams) if seen[g] > 1 for p in (i, i + 1, i + 2)}
    lines, again = set(), 0
    for line in (x or "").split("\n"):
        if WORD.search(line):
            again += line in lines
            lines.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", x or "")), again, len(covered)


def test_quality_rules_against_brute_force(spark, edge, empty):
    rng = random.Random(7)
    texts = ["".join(rng.choice(["a ", "b ", "c", "\n", "é ", "#", "a b c d e f g h "]) for _ in range(rng.randrange(80))) for _ in range(200)]
    texts += [" ".join(f"w{rng.randrange(400)}" for _ in range(80)) + "\n" + "one line of five words\n" * rng.randrange(1, 5) + "x " * rng.randrange(9) for _ in range(100)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality_rules.quality_rules(rows).collect():
        expected = rule_counts(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == expected
        failed = expected[0] < 50 or 100 * expected[4] > 50 * expected[0]
        assert r["base_failed"] == failed and not (failed and r["kept"])
        w = words(texts[r["doc_id"]])
        fine = not failed
        for n, limit in quality_rules.COVERAGE_LIMITS.items():
            seen = collections.Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
            inside = {p for i in range(len(w) - n + 1) if seen[tuple(w[i : i + n])] > 1 for p in range(i, i + n)}
            covered = sum(len(w[p]) for p in inside)
            assert r[f"dup_{n}gram_chars"] == covered
            fine = fine and covered <= limit * expected[1]
        lines, again = set(), 0
        for line in texts[r["doc_id"]].split("\n"):
            again += sum(map(len, words(line))) if line in lines else 0
            lines.add(line)
        assert r["dup_line_chars"] == again and r["kept"] == (fine and again <= quality_rules.LINE_CHARS_LIMIT * expected[1])
    assert len(quality_rules.quality_rules(edge).collect()) == len(EDGE) and quality_rules.quality_rules(empty).collect() == []
    assert quality_rules.passing(edge).columns == edge.columns and quality_rules.passing(empty).collect() == []


# --- 7 mixing ---


def test_mixing(spark, edge, empty):
    rng = random.Random(8)
    docs = [(i, " ".join(["w"] * rng.randrange(1, 40)), "en", rng.choice(["big"] * 6 + ["mid", "mid", "tiny", None]), 0) for i in range(600)]
    rows = spark.createDataFrame(docs, DOCS)
    got = [mixing.mix(rows.repartition(n)).collect() for n in (1, 5)]
    assert sorted(map(tuple, got[0]), key=str) == sorted(map(tuple, got[1]), key=str)
    sizes = {i: len(words(t)) for i, t, *_ in docs}
    by_source = collections.defaultdict(list)
    for r in got[0]:
        assert r["size"] == sizes[r["doc_id"]] and r["taken"] in (0, r["size"], 2 * r["size"])
        by_source[r["source"]].append(r)
    total = sum(sizes.values())
    assert sum(rs[0]["target"] for rs in by_source.values()) == pytest.approx(1.5 * total)
    for rs in by_source.values():
        assert rs[0]["target"] <= 2 * rs[0]["source_size"] + 1e-6
        assert abs(sum(r["taken"] for r in rs) - rs[0]["target"]) <= 80
    assert len(mixing.mix(edge).collect()) == len(EDGE) and mixing.mix(empty).collect() == []
    # rows without an id and with equal sizes: what is taken follows from the number of them alone
    same = spark.createDataFrame([(None, "w w", "en", "a", 3)] * 30 + [(5, "w w", "en", "a", 3)] * 3 + [(6, "w", "en", "b", 1)], DOCS)
    got = [collections.Counter(map(tuple, mixing.mix(same.repartition(n)).collect())) for n in (1, 4)]
    assert got[0] == got[1] and sum(got[0].values()) == 34 and sum(r[5] * n for r, n in got[0].items()) == pytest.approx(1.5 * 67, abs=4)
    blank = spark.createDataFrame([(1, None, "en", "a", 0), (2, " ", "en", "b", 0)], DOCS)
    assert [r["taken"] for r in mixing.mix(blank).collect()] == [0, 0]


# --- 8 near duplicates ---


def brute_components(docs, size, num, den):
    sets = {}
    for i, t in docs:
        w = words(lower(t))
        sets[i] = {tuple(w[p : p + size]) for p in range(max(len(w) - size + 1, 1))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            n = len(sets[a] & sets[b])
            if a < b and n and den * n >= num * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize(("size", "num", "den"), [(3, 85, 100), (5, 80, 100)])
def test_near_duplicates_against_brute_force(spark, size, num, den, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK_ROWS", 16)  # several blocks in a group
    rng = random.Random(size)
    docs = []
    for g in range(12):
        base = rng.choices([f"w{g}_{i}" for i in range(200)], k=rng.choice([4, 12, 60, 120]))
        for _ in range(rng.choice([1, 3, 60])):
            w = list(base)
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
            docs.append((len(docs), " ".join(w)))
    docs += [(1000, "a b"), (1001, "A b"), (1002, ""), (1003, None), (1004, " "), (1005, "a"), (1006, "a")]
    rows = spark.createDataFrame(docs, "doc_id long, text string").withColumn("node", F.lit(0)).withColumn("sig", F.lit("x"))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dup.near_duplicates(rows, size, num, den).collect()}
    assert got == brute_components(docs, size, num, den)


def test_near_duplicate_edges(spark, edge, empty):
    got = near_dup.near_duplicates(edge).collect()
    assert len(got) == len(EDGE) and near_dup.near_duplicates(empty).collect() == []
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[7]["component_id"] == 4 and not by_id[7]["kept"] and by_id[None]["kept"] and by_id[1]["component_id"] == 1
    sets = [np.unique(np.random.default_rng(i).integers(0, 400, 120).astype(np.uint64)) for i in range(60)]
    counts = near_dup.shared_counts(sets, sets)
    assert all(counts[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(60) for j in range(60) if i != j)


def test_near_duplicates_under_one_id(spark):
    base = [f"w{k}" for k in range(80)]
    rows = [(7, " ".join(base))] * 40 + [(7, "other text of few words")] * 2 + [(9, "other text of few words"), (3, " ".join(base[:-1]))]
    got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {3: 3, 7: 3, 9: 3}


def test_group_links_against_brute_force(monkeypatch):
    rng = np.random.default_rng(6)
    base = rng.integers(1, 1 << 60, 120).astype(np.uint64)
    sets = []
    for _ in range(90):
        s = base.copy()
        s[rng.integers(0, 120, rng.integers(0, 18))] = rng.integers(1, 1 << 60)
        sets.append(np.unique(np.concatenate([s, rng.integers(1, 1 << 60, rng.integers(0, 8)).astype(np.uint64)])))
    sig, node = np.array([near_dup.signature(s) for s in sets]), np.arange(90)
    block = rng.integers(0, 3, 90)
    block[17] = -1

    def parts(links):
        root = list(range(90))
        for a, b in near_dup.stars(links):
            root[a] = b
        return root

    linked = []
    for a in range(90):
        for b in range(a):
            n = len(np.intersect1d(sets[a], sets[b]))
            if 100 * n >= 85 * (len(sets[a]) + len(sets[b]) - n):
                linked.append((a, b))
    for alone in (0, 10**9):
        monkeypatch.setattr(near_dup, "PAIRS_ALONE", alone)
        found = []
        for i in range(3):
            for j in range(i, 3):
                at = np.flatnonzero(np.isin(block, [-1, i, j]))
                found += near_dup.group_links(node[at], block[at], sig[at], [sets[k] for k in at], 85, 100)
        assert parts(found) == parts(linked) and len(set(parts(linked))) > 3


def test_components_edges(spark):
    none = spark.createDataFrame([(None, 1), (5, 5), (2, None)], "a long, b long")
    assert components.components(none).collect() == [] and components.components(none.limit(0)).collect() == []
    links = spark.createDataFrame([(3, 1), (1, 3), (3, 1), (9, 3)], "x long, y long")
    assert sorted(map(tuple, components.components(links).collect())) == [(1, 1), (3, 1), (9, 1)]


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 50), (60, 50), (60, 200), (7, 7)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {50: 50, 60: 50, 100: 50, 200: 50}


# --- 9 html ---


@pytest.mark.parametrize(
    ("page", "expected"),
    [
        (None, ""), ("", ""), ("plain", "plain"), ("<nav>menu</nav>", ""),
        ("<body><nav>n</nav><article><h1>T</h1><p>a &amp;  b\n c</p><aside>s</aside><p>d<br>e</p></article><footer>f</footer>", "T\na & b c\nd\ne"),
        ("<main><h1>T</h1><form>x</form><div class='comments'><p>c</p></div><p>end</p></main>", "T\nend"),
        ("<article><header><h1>Head</h1></header><p>x<script>var t='</p>';</script></p><style>p{}</style></article>", "Head\nx"),
        ("<article><p>kept</p><div id='cookie-notice'>no</div><div class=ad>no</div><div hidden>no</div><p style='display:none'>no</p>", "kept"),
        ("<article><ul><li>one</li><li>two &#233;</li></ul><table><tr><td>a</td><td>b</td></tr></table></article>", "one\ntwo é\na b"),
        ("<header>site</header><div><h2>Title</h2><p>" + "long text " * 20 + "</p></div><div class='sidebar'>links</div>", "Title\n" + ("long text " * 20).strip()),
    ],
)
def test_html(page, expected):
    assert html_extract.extract(page) == expected


@pytest.mark.parametrize("bad", ["<![foo[ x ]]>", "<![ zz]>", "<![>", "<![endif]-->", "<![if x>", "<!x>", "&#" + "9" * 5000 + ";"])
def test_html_is_read_beyond_broken_markup(bad):
    assert html_extract.extract(f"<article><p>a</p>{bad}<p>b</p></article>").replace("\ufffd\n", "") == "a\nb"


_PROSE = [f"{k} " + "long text " * 19 + "end" for k in range(6)]
_PROSE_HTML = "".join(f"<p>{x}</p>" for x in _PROSE)
_MENU, _FOOT = "<div>" + "<li><a href=x>menu</a></li>" * 4 + "</div>", "<footer><p>a</p><p>b</p><p>c</p></footer>"


@pytest.mark.parametrize(
    ("page", "expected"),
    [
        (f"<body>{_MENU}<div>{_PROSE_HTML}<p>The end.</p></div>{_FOOT}", [*_PROSE, "The end."]),
        (f"<body>{_MENU}<div><h1>T</h1><p>By A. Writer</p><p>Two days ago</p>{_PROSE_HTML}</div>{_FOOT}", ["T", "By A. Writer", "Two days ago", *_PROSE]),
        (f"<body>{_MENU}<div>{_PROSE_HTML}" + "<p>No.</p><p>Yes.</p>" * 3 + f"</div>{_FOOT}", [*_PROSE, *["No.", "Yes."] * 3]),
        (f"<body><div>{_PROSE_HTML}<aside>x</aside><h2>Last</h2><p>Bye.</p><h2>Bare</h2></div>{_FOOT}", [*_PROSE, "Last", "Bye."]),
        (f"<body><article>{_PROSE_HTML}</article>" + "<nav>n</nav>" * 4 + "<article><p>Short.</p></article>", [*_PROSE, "Short."]),
    ],
)
def test_html_keeps_short_paragraphs(page, expected):
    assert html_extract.extract(page).split("\n") == expected


@pytest.mark.parametrize(
    ("page", "expected"),
    [
        ("<p class=ad>x<p>a<p>b", "a\nb"), ("<p class=ad>x <b class=promo>y</b><h2>a</h2>", "a"), ("<p class=ad>x<hr/>a", "a"),
        ("<ul><li class=ad>x<li>a<li>b</ul>", "a\nb"), ("<ul><li class=ad>x<ul><li>y</ul>z<li>a</ul>", "a"), ("<dl><dt class=ad>x<dd>a</dl>", "a"),
        ("<table><tr class=ad><td>x<tr><td>a</table>", "a"), ("<table><tr><td class=ad>x<td>a</table>", "a"),
        ("<div class=ad><p>x<p>y</div>a", "a"),
    ],
)
def test_html_start_tags_end_open_boilerplate(page, expected):
    assert html_extract.extract(f"<article>{page}</article>") == expected


_BODY = "".join(f"<p>{k} {'long text ' * 20}end</p>" for k in range(4))
_LONG = ("long text " * 20).strip()


@pytest.mark.parametrize(
    ("more", "kept"),
    [
        (f"<section id='discussion'><h2>Discussion</h2><p>{_LONG}</p></section>", ["Discussion", _LONG]),
        (f"<section id='related-work'><p>{_LONG}</p></section>", [_LONG]),
        ("<h2 id='legal-history'>Law</h2><p>Short.</p>", ["Law", "Short."]),
        ("<div class='responses-of-plants'><p>Short.</p></div>", ["Short."]),
        ("<p>x <math><mi>a</mi></math> <label>b</label></p>", ["x a b"]),
        ("<p class='promo'>buy<p>Real paragraph", ["Real paragraph"]),
        (f"<div class='notice'><p>{_LONG}</p></div>", []),
        (f"<div class='comments'><div class='comment'><p>{_LONG}</p></div></div>", []),
        (f"<div id='discussion'><div class='reply'><p>Nice, thanks.</p></div><div class='reply'><p>{_LONG[:60]}</p></div></div>", []),
    ],
)
def test_html_marks_lower_ratios(more, kept):
    body = [f"{k} {'long text ' * 20}end" for k in range(4)]
    assert html_extract.extract(f"<article>{_BODY}{more}</article>").split("\n") == [*body, *kept]


def test_html_teaser_does_not_replace_the_body():
    page = f"<article class='teaser'><p>short teaser</p></article><div>{_BODY}</div>"
    assert "teaser" not in html_extract.extract(page) and html_extract.extract(page).count("end") == 4


def test_html_names():
    assert [html_extract.mark(x) for x in ("ad", "nyt-comments", "siteFooter", "related-posts", "entry-header", "page-header", "ad-hoc", "social-science x")] == [0.1, 0.1, 0.1, 0.8, 1.0, 0.1, 1.0, 1.0]


def test_html_of_all_pages(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    for r in rows:
        article = re.search(r"<article>(.*?)</article>", r["html"], re.DOTALL)[1]
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub("<[^>]*>", "", x))).strip() for x in re.split(r"</?(?:p|h1|br)\b[^>]*>", article)]
        assert html_extract.extract(r["html"]) == "\n".join(x for x in blocks if x)


def test_html_very_long_and_broken():
    assert html_extract.extract("<article>" + "<p>a b" * 20_000) == "\n".join(["a b"] * 20_000)
    assert html_extract.extract("<div>" * 3000 + "deep") == "deep" and html_extract.extract("<article><p>a</div></b><<p>b") == "a\n<\nb"


def test_html_query(spark):
    pages = spark.createDataFrame([(1, "u", "<article>x</article>"), (None, None, None), (1, "u", "<article>x</article>")], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    assert sorted(map(tuple, html_extract.main_text(pages).collect()), key=str) == sorted([(1, "u", "x", 1), (None, None, "", 0), (1, "u", "x", 1)], key=str)
    assert html_extract.main_text(pages.limit(0)).collect() == []


# --- pipeline ---


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for _, stage in p.STAGES[:-1]:
        before = kept
        kept = stage(spark, kept, SF)
        assert kept.columns == docs.columns
        assert kept.join(before, "doc_id", "left_anti").count() == 0
    again = near_dup.near_duplicates(kept, p.SHINGLE, *p.SIMILARITY).where("not kept").count()
    assert again == 0
    assert decontaminate.contained_items(kept, spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 0
    last = p.run(spark, SF)
    assert last.where("taken <= 0 or taken > 2 * size").count() == 0 and last.count() > 0


def test_pipeline_edges(spark, edge, empty):
    import corpus_pipeline as p

    for docs in (edge, empty):
        for _, stage in p.STAGES:
            stage(spark, docs, SF).collect()
    kept = without_ids(edge.withColumn("__gone_id", F.lit(4)).withColumn("x", F.lit(4)), spark.createDataFrame([(4,), (4,)], "x long"))
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 2, 3, 5, 6, 7]


def test_pipeline_judges_rows_without_an_id(spark):
    import corpus_pipeline as p

    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    copied, other = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60))
    rows = [(None, copied, "first"), (9, copied, "named"), (None, copied, "second"), (None, other, "alone"), (None, other + " " + item, "leak"), (3, "a b c " + item, "leak 2"), (None, None, "null")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    stages = dict(p.STAGES)
    kept = stages["near duplicates"](spark, docs, SF)
    assert kept.columns == docs.columns
    assert {r["source"] for r in kept.collect()} >= {"named", "alone", "null"}
    assert not {r["source"] for r in kept.collect()} & {"first", "second"}
    clean = stages["benchmark decontamination"](spark, kept, SF)
    assert clean.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["source"]) for r in clean.collect()) == [(0, "alone"), (0, "null"), (9, "named")]
