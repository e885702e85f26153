import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from factloom.functions import jsontext, text


def column(spark, values, make):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in rows.select("i", make("v").alias("x")).orderBy("i").select("x").collect()]


def test_keys(spark):
    values = ["O’Brien", "New-York", " Canal+ ", "Straße", "Élan", "KAUAʻI", "a\x1cb", "™", "", None, "..", "İstanbul"]
    expected = ["obrien", "new york", "canal", "strasse", "elan", "kauai", "a b", "tm", "", None, "", "istanbul"]
    assert column(spark, values, text.key) == expected


def test_native_key_equals_general_key(spark):
    rng = random.Random(5)
    values = ["".join(chr(rng.randrange(128)) for _ in range(rng.randrange(20))) for _ in range(400)]
    assert column(spark, values, text.key) == [text.normalize_text(v) for v in values]
    mixed = ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x3000)])) for _ in range(8)) for _ in range(200)]
    assert column(spark, mixed, text.key) == [text.normalize_text(v) for v in mixed]
    assert all(not unicodedata.combining(c) for v in mixed for c in text.normalize_text(v))


def test_keys_of_arrays(spark):
    rows = spark.createDataFrame([(["A-b", None, "É"], [["X"], None, ["Ü", "u"]])], "a array<string>, n array<array<string>>")
    got = rows.select(text.keys("a").alias("a"), text.nested_keys("n").alias("n")).first()
    assert got["a"] == ["a b", None, "e"] and got["n"] == [["x"], [], ["u", "u"]]


def test_numbers(spark):
    values = ["1,234", " 5 ", "1_000", "1__0", "٣", "1d", "inf", "-Infinity", "nan", "x", "", None, "1e3", ".5", "5."]
    got = column(spark, values, text.number)
    expected = [1234.0, 5.0, 1000.0, None, 3.0, None, float("inf"), float("-inf"), "nan", None, None, None, 1000.0, 0.5, 5.0]
    assert [("nan" if g is not None and g != g else g) for g in got] == expected
    for v in values:
        if v is not None and v != "nan":
            assert text.parse_float(v) == expected[values.index(v)]


@pytest.mark.parametrize(
    ("value", "expected"),
    [
        ("35,000 people", "35000"), ("1.5 million km2", "1500000"), ("1.23e6 km2", "1230000"), ("2E+4 seats", "20000"), ("12.50", "12.50"), ("-7", "-7"), ("none", None),
        ("about 3k", "3000"), ("1234567.5e0", "1.23457e+06"), ("v1.2.3", None), ("٣٥", "٣٥"),
    ],
)
def test_leading_numbers(spark, value, expected):
    assert text.first_number(value) == expected
    assert column(spark, [value], text.leading_number) == [expected]


def test_number_text(spark):
    rows = spark.createDataFrame([(115.0,), (74.36,), (1234567.5,), (-3.0,), (None,)], "x double")
    assert [r[0] for r in rows.select(text.number_text("x")).collect()] == ["115", "74.36", "1.23457e+06", "-3", None]


@pytest.mark.parametrize(
    ("said", "relation", "expected"),
    [
        ('["35,000 people"]', "hasCapacity", ["35000"]), ('["None"]', "personHasCityOfDeath", []), ('["None"]', "awardWonBy", ["None"]), ('["n/a"]', "personHasCityOfDeath", ["n/a"]),
        ('x [1, true, "A", "a", ["b"]] [2]', "awardWonBy", ["1", "A"]), ("nothing", "awardWonBy", []), ("[]", "hasArea", []), ('[ {"a": 1} oops ["x"]', "awardWonBy", ["x"]),
    ],
)
def test_answers(said, relation, expected):
    assert jsontext.clean_answers(jsontext.first_array(said) or [], relation) == expected


def test_array_differs_from_no_array():
    assert jsontext.first_array("none") is None and jsontext.first_array("so []") == []
    assert jsontext.first_object('{"a" {"b": 1}') == {"b": 1} and jsontext.first_object("[1]") == {}


def test_answer_schemas():
    strict = jsontext.read_answer('{"rationale": " why ", "answers": ["Paris"]}', "personHasCityOfDeath", True)
    assert strict == {"parsed": ["Paris"], "usable": True, "rationale": "why", "schema_valid": True}
    loose = jsontext.read_answer('noise {"answers": ["Paris"], "more": 1}', "personHasCityOfDeath", True)
    assert loose["parsed"] == ["Paris"] and not loose["schema_valid"]
    assert jsontext.read_answer("no json", "personHasCityOfDeath", True)["parsed"] is None
    award = jsontext.read_answer('{"rationale": "r", "candidates": [{"recipient": "Ada", "work": null, "year": 1900}]}', "awardWonBy", True)
    assert award["parsed"] == ["Ada"] and award["schema_valid"]
    assert jsontext.read_answer('{"candidates": [{"recipient": " Bob "}]}', "awardWonBy", False)["parsed"] == ["Bob"]
    assert jsontext.read_anchor("junk", "X")["description"] == "Exact identity of X; details are uncertain."
    assert jsontext.read_anchor('{"description": "d", "identity_checks": ["c"]}', "X")["anchor"] == "d Identity checks: c"
    shown = jsontext.ANSWER.response_format("n")
    assert shown["json_schema"]["strict"] and shown["json_schema"]["schema"]["required"] == ["answers"]


def test_answer_columns(spark):
    rows = spark.createDataFrame([(0, '["7 km"]', "hasArea"), (1, "x", "hasArea")], "i int, t string, Relation string")
    got = rows.withColumn("a", jsontext.plain_answer("t", "Relation")).orderBy("i").select("a.parsed", "a.usable").collect()
    assert [tuple(r) for r in got] == [(["7"], True), (None, False)]
    assert rows.select(jsontext.parse_answers(F.col("t"), F.col("Relation"))).first()[0] == ["7"]
