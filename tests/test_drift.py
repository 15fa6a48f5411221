"""Schemas that drift: changes between files, and one table of all records."""

import datetime as dt
import json

from lodestat.operators import drift

FILES = "file_id string, path string, written_at timestamp, loaded_at timestamp, payload string, field string"


def at(n):
    return dt.datetime(2025, 1, 1) + dt.timedelta(days=n)


def doc(records, section="readouts", **meta):
    return json.dumps({"meta": meta, section: records})


def kinds(before, after):
    return {(c["change_kind"], c["field_before"], c["field_after"]) for c in drift.changes(before, after)}


def test_each_kind_of_change():
    a = doc([{"claim_id": "c1", "op": "mean", "gone": 1, "n": 1}, {"claim_id": "c2", "op": None}], version="1")
    b = doc([{"claim_id": "c1", "operation": "mean", "new": True, "n": "1"}], version=1)
    assert kinds(a, b) == {
        ("renamed", "readouts.op", "readouts.operation"), ("removed", "readouts.gone", ""), ("added", "", "readouts.new"),
        ("retyped", "readouts.n", "readouts.n"), ("retyped", "meta.version", "meta.version"),
    }


def test_rename_needs_a_value_and_equality_everywhere():
    nothing = kinds(doc([{"claim_id": "c1", "a": None}]), doc([{"claim_id": "c1", "b": None}]))
    assert nothing == {("removed", "readouts.a", ""), ("added", "", "readouts.b")}
    other = kinds(doc([{"claim_id": "c1", "a": 1}, {"claim_id": "c2", "a": 2}]), doc([{"claim_id": "c1", "b": 1}, {"claim_id": "c2", "b": 3}]))
    assert ("renamed", "readouts.a", "readouts.b") not in other


def test_rename_with_another_type_is_both():
    found = kinds(doc([{"claim_id": "c1", "m": 100}]), doc([{"claim_id": "c1", "multiplier": "100"}]))
    assert found == {("renamed", "readouts.m", "readouts.multiplier"), ("retyped", "readouts.m", "readouts.multiplier")}


def test_nested_values_compare_whatever_their_layout():
    a, b = doc([{"claim_id": "c1", "x": {"p": [1, 2], "q": 1}}]), json.dumps({"meta": {}, "readouts": [{"claim_id": "c1", "y": {"q": 1, "p": [1, 2]}}]}, indent=2)
    assert ("renamed", "readouts.x", "readouts.y") in kinds(a, b)


def test_all_null_is_no_retype_and_bad_payloads_report_nothing():
    assert kinds(doc([{"claim_id": "c", "x": None}]), doc([{"claim_id": "c", "x": 1}])) == set()
    for bad in (None, "", "[1]", "{", "5"):
        assert drift.changes(bad, doc([])) == [] == drift.changes(doc([]), bad)


def test_files_are_compared_in_the_order_of_writing(spark):
    one, two, three = (doc([{"claim_id": "c", k: 1}]) for k in ("a", "b", "c"))
    rows = [
        ("f3", "p", at(40), at(0), three, "x"), ("f1", "p", at(0), at(9), one, None), ("f2", "p", at(20), at(1), two, "x"), ("f2", "p", at(20), at(2), two, "x"),
        ("g1", "q", at(1), None, None, None), ("g2", "q", at(2), None, one, None), (None, "p", at(3), None, one, None), ("h1", None, at(1), None, one, None), ("h2", None, None, None, two, None),
    ]
    files = spark.createDataFrame(rows, FILES)
    got = {(r.file_id, r.change_kind, r.field_before, r.field_after) for r in drift.file_changes(files).collect()}
    assert got == {("f2", "renamed", "readouts.a", "readouts.b"), ("f3", "renamed", "readouts.b", "readouts.c"), ("h1", "renamed", "readouts.b", "readouts.a")}
    assert drift.file_changes(files.limit(0)).count() == 0


def test_one_consistent_table(spark):
    rows = [
        ("f1", "p", at(0), at(0), doc([{"claim_id": "c", "op": "mean", "k": "x", "m": 1.5}]), None), ("f2", "p", at(1), at(1), doc([{"claim_id": "c", "operation": "mean", "k": ["x"], "m": "100"}]), None),
        ("f3", "p", at(2), at(1), doc([{"claim_id": "c", "op2": "mean", "k": {"name": 7}, "m": [{"v": 2}]}]), None), ("f4", "q", at(2), at(1), doc([{"claim_id": "d", "op": "sd", "operation": "mean", "k": "y", "m": "many"}]), None),
        ("f5", "r", at(2), at(1), json.dumps({"meta": 5, "note": "n", "readouts": [3, {"claim_id": "e", "k": "z"}]}), None),
    ]
    got = drift.consistent_records(spark.createDataFrame(rows, FILES)).collect()
    by = {(r.file_id, r.section, r.record_no, r.field): (r.field_before, r.value, r.kind, r.rule) for r in got}
    at_ = lambda f, field, no=0, section="readouts": by.get((f, section, no, field))
    assert at_("f1", "op") == ("op", "mean", "string", "kept") and at_("f2", "op") == ("operation", "mean", "string", "renamed") and at_("f3", "op")[3] == "renamed"
    assert at_("f2", "k") == ("k", "x", "string", "cast array>string") and at_("f3", "k") == ("k", "7", "string", "cast object>number, cast number>string")
    assert at_("f2", "m")[2:] in (("number", "cast string>number"), ("string", "kept")) and at_("f4", "m")[3] in ("uncast string", "kept")
    assert at_("f4", "op")[0] == "op" and at_("f4", "operation") == ("operation", "mean", "string", "collision")
    assert at_("f5", "op", None) == (None, None, "string", "default") and at_("f5", "value")[1] == "3" and at_("f5", "note", 0, "file")[1] == "n" and at_("f5", "meta", 0, "file")[1] == "5"
    assert drift.consistent_records(spark.createDataFrame([], FILES)).count() == 0


def test_casts():
    number = drift._Number
    assert drift.cast_value([{"v": number("2")}], "number") == ("2", ["array>object", "object>number"]) and drift.cast_value("1e3", "number")[1] == ["string>number"]
    assert drift.cast_value(True, "string") == ("true", ["boolean>string"]) and drift.cast_value("true", "boolean") == (True, ["string>boolean"]) and drift.cast_value("x", "array") == (["x"], ["string>array"])
    assert drift.cast_value("x", "number") is None and drift.cast_value([1, 2], "string") is None and drift.cast_value({"a": 1, "b": 2}, "array") is None and drift.cast_value([None], "string") is None


def test_versions_of_a_path(spark):
    one, two = doc([{"claim_id": "c", "a": 1}]), doc([{"claim_id": "c", "b": 1}])
    rows = [("f1", "p", at(0), at(0), one, None), ("f2", "p", at(1), at(0), one, None), ("f3", "p", at(2), at(0), two, None), ("f3", "p", at(2), at(5), two, None), ("f4", "p", at(3), at(0), one, None), ("g", "q", at(0), at(0), None, None)]
    got = {(r.path, r.version): (r.first_file, r.n_files, [tuple(s) for s in r.steps]) for r in drift.schema_versions(spark.createDataFrame(rows, FILES)).collect()}
    assert got == {
        ("p", 1): ("f1", 2, []), ("p", 2): ("f3", 1, [("renamed", "readouts.a", "readouts.b")]), ("p", 3): ("f4", 1, [("renamed", "readouts.b", "readouts.a")]), ("q", 1): ("g", 1, []),
    }
    assert drift.schema_versions(spark.createDataFrame([], FILES)).count() == 0


def test_deliveries_that_differ(spark):
    """The one written first counts, wherever it comes."""
    rows = [("f1", "p", at(0), at(0), doc([{"claim_id": "c", "a": 1}]), None), ("f2", "p", at(2), at(0), doc([{"claim_id": "c", "b": 1}]), None), ("f2", "p", at(3), at(0), doc([{"claim_id": "c", "z": 9}]), None)]
    for some in (rows, rows[::-1]):
        assert {(r.file_id, r.field_after) for r in drift.file_changes(spark.createDataFrame(some, FILES)).collect()} == {("f2", "readouts.b")}
