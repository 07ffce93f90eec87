"""Metric arithmetic on small documents of any shape."""

import json

import pytest
from pyspark.sql import functions as F

from docaudit.functions.exact import leaf_map
from docaudit.functions.jsonx import Contract, contract_leaves
from docaudit.operators import compare as C

TRUTH = {"ship": "Argo", "berth": None, "cargo": [{"tons": 7, "goods": "oak"}]}


def metrics(spark, truth, prediction, case=True):
    text = prediction if isinstance(prediction, str) else json.dumps(prediction)
    df = spark.createDataFrame([(1, json.dumps(truth), text)], "id int, t string, p string")
    empty = F.create_map().cast("map<string,struct<jtype:string,value:string>>")
    pairs = df.select("id", leaf_map("t").alias("truth"), F.coalesce(leaf_map("p"), empty).alias("prediction"))
    sums = C.with_outcomes(C.leaf_pairs(pairs, ["id"]), case=case).agg(*C.counters())
    return sums.select("*", *[c.alias(n) for n, c in C.ratios().items()]).first()


@pytest.mark.parametrize(
    ("truth", "prediction", "expect"),
    [
        (TRUTH, TRUTH, {"tp": 3, "fp": 0, "fn": 0, "f1": 1.0, "similarity": 1.0, "empty_correct": 1}),
        (TRUTH, {"ship": "Nereid", "berth": "N4", "cargo": [{"tons": 7, "goods": None}]}, {"tp": 1, "fp": 2, "fn": 2, "precision": 0.333333, "recall": 0.333333, "f1": 0.333333, "hallucinated": 1}),
        ({"ship": None, "berth": None, "cargo": []}, {"ship": None, "berth": None, "cargo": []}, {"tp": 0, "empty_correct": 2, "f1": 1.0}),
        ({"ship": "\tÉTOILE   du Nord\n", "berth": "007"}, {"ship": "étoile du nord", "berth": 7}, {"recall": 0.5}),
        ({"tons": 41}, {"tons": "41"}, {"f1": 1.0}),
        ({"tons": 41}, {"tons": "41.00"}, {"f1": 1.0}),
        ({"tons": "\t"}, {"tons": "\n"}, {"empty_correct": 1, "fp": 0}),
        ({"value": 1}, {"value": True}, {"f1": 0.0, "tp": 0}),
        (TRUTH, "not json", {"recall": 0.0, "tp": 0, "fn": 3}),
        ({"items": [{"q": 1}, {"q": 2}]}, {"items": [{"q": 1}, {"q": 2}]}, {"support": 2}),
    ],
)
def test_outcomes(spark, truth, prediction, expect):
    got = metrics(spark, truth, prediction)
    assert {k: got[k] for k in expect} == expect


def test_case_sensitive(spark):
    assert metrics(spark, {"a": "X"}, {"a": "x"}, case=False)["f1"] == 0.0


def test_published_counts(spark):
    row = spark.createDataFrame([(58, 12, 13, 1.0, 1)], "tp long, fp long, fn long, similarity_sum double, similarity_support long")
    got = row.select(*[c.alias(n) for n, c in C.ratios(4).items()]).first()
    assert (got["precision"], got["recall"], got["f1"]) == (0.8286, 0.8169, 0.8227)


def test_contract_leaves_equal_general_leaves(spark):
    contract = Contract(("ship", "berth", "extra.deep"), "cargo", ("tons", "goods"))
    df = spark.createDataFrame([(json.dumps(TRUTH),), ('{"cargo": [{"tons": "x"}, {}, null]}',), ("{",)], "j string")
    got = df.select(contract_leaves(F.try_parse_json("j"), contract).alias("a"), leaf_map("j").alias("b")).collect()
    assert got[0]["a"] == got[0]["b"] and set(got[1]["a"]) == {"cargo[0].tons"} and got[2]["a"] == {} and got[2]["b"] is None


def test_review_kinds(spark):
    df = spark.createDataFrame([('{"a": "X", "b": "1", "c": "v", "d": "v", "e": null, "f": []}', '{"a": " x", "b": "2", "d": null, "e": "new", "g": [{"q": null}]}')], "t string, p string")
    pairs = df.select(F.lit(1).alias("id"), leaf_map("t").alias("truth"), leaf_map("p").alias("prediction"))
    got = {r["path"]: r["kind"] for r in C.differences(C.leaf_pairs(pairs, ["id"]), ["id"]).collect()}
    assert got == {"a": "formatting_only", "b": "value_mismatch", "c": "annotation_only", "d": "annotation_only", "e": "prediction_only"}
