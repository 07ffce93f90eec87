"""Column functions against small independent definitions."""

import unicodedata

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docaudit.functions import schema as S
from docaudit.functions import text as X
from docaudit.functions.exact import first_object, leaves


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()["x"]


def test_text_key_matches_definition(spark):
    words = ["Müller GmbH & Co.", "Çà et là", "straße 12-b", "ÉCOLE", "plain", "", "***"]
    got = [r["x"] for r in spark.createDataFrame([(w,) for w in words], "w string").select(X.text_key("w").alias("x")).collect()]
    assert got == ["".join(c for c in unicodedata.normalize("NFKD", w.casefold()) if c.isalnum()) for w in words]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab é-1", max_size=9), min_size=2, max_size=8))
def test_edit_similarity_is_bounded_and_symmetric(spark, words):
    pairs = [(a, b) for a in words for b in words]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", X.edit_similarity(F.col("a"), F.col("b")).alias("x"), X.edit_similarity(F.col("b"), F.col("a")).alias("y")).collect()
    assert all(0 <= r["x"] <= 1 and r["x"] == r["y"] and (r["x"] == 1) == (r["a"] == r["b"]) for r in rows)


def test_decimals(spark):
    cases = {"1.500": "1.5", "10.0": "10", "100": "100", "0.0": "0", "-0": "0", "3.14": "3.14"}
    rows = spark.createDataFrame([(c,) for c in cases], "c string").select("c", X.plain_decimal("c").alias("x")).collect()
    assert {r["c"]: r["x"] for r in rows} == cases


def test_dates(spark):
    cases = {"31.02.2020": False, "29/02/2020": True, "2020-12-01": True, "1.1.20": True, "13.13.2020": False, "week 12": None, "": None}
    rows = spark.createDataFrame([(c,) for c in cases], "c string").select("c", X.date_state("c").alias("x")).collect()
    assert {r["c"]: r["x"] for r in rows} == cases


def test_character_classes(spark):
    cases = {" ": "blank", "a1": "alphanumeric", "ab": "alphabetic", "12": "numeric", "--": "symbols", "é": "alphabetic"}
    rows = spark.createDataFrame([(c,) for c in cases], "c string").select("c", X.character_class("c").alias("x")).collect()
    assert {r["c"]: r["x"] for r in rows} == cases


def test_locations_and_slugs(spark):
    assert one(spark, X.location_parts("a"), a="Wien, Austria, EU").asDict() == {"city": "Wien", "suffix": "Austria, EU"}
    assert one(spark, X.location_parts("a"), a="Wien,  ") is None and one(spark, X.location_parts("a"), a="Wien")["suffix"] is None
    assert one(spark, X.slug("a"), a="--A b/c!") == "A-b-c"
    assert one(spark, X.strip_thinking("a"), a="<think>x\ny</think>\n ok <think>z</think>") == "ok"
    assert one(spark, X.strip_dpi("a"), a="scan_360DPI") == "scan"


def test_first_object():
    assert first_object('x {"a": "}\\"{", "b": {"c": 1}} y {') == '{"a": "}\\"{", "b": {"c": 1}}'
    assert first_object("{ open") is None and first_object("none") is None


def test_leaves():
    assert leaves({"a": [{"b": 1}, {"b": None}], "c": {}, "d": True, "e": 1.5}) == {"a[0].b": ("integer", "1"), "a[1].b": ("null", None), "d": ("boolean", "true"), "e": ("number", "1.5")}
    assert leaves(5) == {"": ("integer", "5")}


SCHEMA = {
    "type": "object", "required": ["a"], "additionalProperties": False, "$defs": {"n": {"type": ["integer", "null"]}},
    "properties": {"a": {"$ref": "#/$defs/n"}, "l": {"type": "array", "items": {"type": "object", "properties": {"x": {"enum": ["u", "v"]}}}}, "o": {"oneOf": [{"type": "string"}, {"const": "k"}]}},
}


def test_schema():
    assert S.errors({"a": 1, "l": [{"x": "u"}]}, SCHEMA, SCHEMA) == []
    assert S.errors({"a": True, "z": 0}, SCHEMA, SCHEMA) == ["$.a: expected integer/null, got boolean", "$.z: unexpected"]
    assert S.errors({"l": [{"x": "w"}], "o": "k"}, SCHEMA, SCHEMA) == ["$.a: missing", "$.l[0].x: not one of the allowed values", "$.o: does not match oneOf"]
    assert S.errors([], SCHEMA, SCHEMA) == ["$: expected object, got array"]
    assert S.leaf_paths(SCHEMA) == ["a", "l[].x", "o"]


def test_repair_fill_tokens(spark):
    assert S.repaired({"a": "null", "l": {"x": "u"}}, SCHEMA, SCHEMA) == {"a": None, "l": [{"x": "u"}]}
    template = {"s": {"n": None, "c": None}, "i": [{"d": None}]}
    assert S.filled(template, {"i": [{"d": "x", "e": 1}], "s": {"n": "A"}, "z": 0}) == {"s": {"n": "A", "c": None}, "i": [{"d": "x"}]}
    assert S.tokens({"b": None, "a": [True, "x"], "z": 1}, {"z": 0, "a": []}) == "<s_z>1</s_z><s_a>true<sep/>x</s_a><s_b><null/></s_b>"
    got = spark.createDataFrame([('{"a": "x"}',), ("{",)], "j string").select(S.validate("j", SCHEMA).alias("e")).collect()
    assert [r["e"] for r in got] == [["$.a: expected integer/null, got string"], None]


def test_blank_dates_and_containers(spark):
    from docaudit.functions import text as X

    df = spark.createDataFrame([("\t",), ("1.2.202",), ("123.1.2020",), ("2020-2-29",), ("29.2.21",), ("x",), ("\n a \u00a0",)], "v string")
    got = [tuple(r) for r in df.select(X.date_state("v"), X.strip("v")).collect()]
    assert [g[0] for g in got] == [None, True, False, True, False, None, None] and got[0][1] == "" and got[6][1] == "a"
    assert S.filled({"a": 1, "b": [{"c": 1}]}, {"a": {"x": 1}, "b": [{"c": [2]}, 5]}) == {"a": {"x": 1}, "b": [{"c": [2]}, {"c": None}]}
    assert S.errors("x", {"type": "integer", "enum": [1]}, {}) == ["$: expected integer, got string"]
    assert first_object('{"q') is None and first_object('x {"b": "\\"}"} c') == '{"b": "\\"}"}'
