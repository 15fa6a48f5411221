"""Deeply nested records as flat tables, against plain loops."""

import json

from lodestat.operators import nested

AMB = "array<struct<field:string,kind:string,options:array<string>,note:string>>"


def test_options_count_null_elements(spark):
    rows = [
        ("r1", [("f", "k", ["a", None, "a"], None), None, (None, None, None, None), ("g", None, [], None), ("h", None, ["z"], "n")], "x"), ("r2", None, None), ("r3", [], None), (None, [("f", "k", ["q"], None)], None),
    ]
    df = spark.createDataFrame(rows, f"record_id string, ambiguities {AMB}, field string")
    got = sorted((r.record_id or "", r.pos_outer, r.pos_inner, r.option) for r in nested.flatten_options(df).collect())
    assert got == [("", 0, 0, "q"), ("r1", 0, 0, "a"), ("r1", 0, 2, "a"), ("r1", 4, 0, "z")]


def test_cells_of_lists_and_bare_objects(spark):
    cell = lambda c: {"claim_id": "c", "location": {"page": 3, "cell": c}}
    payloads = {
        "x1": {"a": [cell("A1"), {"claim_id": "d"}, None, {"location": None}, cell(""), cell(None), 7, cell(5)], "b": cell("B1")},
        "x2": {"a": None}, "x3": {}, "x4": {"a": "text", "b": []},
    }
    rows = [(k, json.dumps(v), "t") for k, v in payloads.items()] + [("x5", "not json", "t"), ("x6", None, "t"), ("x1", json.dumps(payloads["x1"], indent=2), "t")]
    df = spark.createDataFrame(rows, "case_id string, payload string, cell string")
    got = nested.flatten_cells(df)
    kept = {(r.case_id, r.list_name, r.pos_outer, r.cell) for r in got.where("cell <> ''").collect()}
    assert kept == {("x1", "a", 0, "A1"), ("x1", "a", 7, "5"), ("x1", "b", 0, "B1")}


def test_uncertainty_and_keys(spark):
    claims = spark.createDataFrame([(1, {"sd": "2", "n": None}), (1, {"sd": "2"}), (2, {}), (3, None), (4, {"sd": None})], "claim_uid bigint, uncertainty map<string,string>")
    empty = spark.createDataFrame([], f"record_id string, ambiguities {AMB}")
    cases = spark.createDataFrame([], "case_id string, payload string")
    got = [tuple(r) for r in nested.nested_keys(empty, cases, claims).collect()]
    assert got == [("sd", "1", "", -1, -1)]
    assert nested.nested_keys(empty, cases, claims.limit(0)).count() == 0
