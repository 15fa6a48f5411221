"""Profiles: expressions by minimum description length, and loads that break with their study's first."""

import datetime as dt
import math
import re

import pytest

from lodestat.operators import profile

LOADS = "study string, load bigint, at timestamp, x double, k string, value string"
T0 = dt.datetime(2025, 1, 1)


def breaks(spark, rows):
    df = spark.createDataFrame(rows, LOADS)
    got = profile.load_breaks(df, study="study", load="load", at="at", numeric=["x"], categorical=["k"])
    return {(r.column_name, r.load, r.issue) for r in got.collect()}


def load(n, day, xs, ks, study="s"):
    return [(study, n, T0 + dt.timedelta(days=day), x, k, None) for x, k in zip(xs, ks)]


BASE = load(9, 0, [1.0, 2.0, 3.0, 4.0, 5.0] * 4, ["a", "b"] * 10)


def test_a_load_like_the_first_breaks_nothing(spark):
    assert breaks(spark, BASE + load(2, 5, [1.0, 2.0, 3.0, 4.0, 5.0] * 4, ["a", "b"] * 10)) == set()


def test_each_issue(spark):
    rows = BASE + load(1, 1, [None] * 3 + [1.0, 2.0, 3.0, 4.0, 5.0] * 3 + [1.0, 5.0], ["a", "b"] * 10)
    rows += load(2, 2, [1.0, 2.0, 3.0, 4.0, 5.0] * 3 + [1.0, 2.0, 3.0, 4.0, 9.5], ["a", "b"] * 9 + ["a", "B"])
    rows += load(3, 3, [4.0, 5.0, 6.0, 7.0, 8.0] * 4, ["a"] * 15 + ["b"] * 5)
    rows += load(4, 4, [3.0] * 20, ["a"] * 20)
    assert breaks(spark, rows) == {
        ("x", 1, "nulls"), ("x", 2, "foreign"), ("k", 2, "foreign"), ("x", 3, "shift"), ("k", 3, "shift"), ("x", 4, "shift"), ("k", 4, "shift"),
    }


def test_limits_are_exclusive(spark):
    ten = load(9, 0, [1.0] * 10, ["a"] * 6 + ["b"] * 4)
    assert ("x", 1, "nulls") not in breaks(spark, ten + load(1, 1, [1.0] * 9 + [None], ["a"] * 6 + ["b"] * 4))
    assert ("k", 1, "shift") not in breaks(spark, ten + load(1, 1, [1.0] * 10, ["a"] * 8 + ["b"] * 2))
    five = load(9, 0, [0.0, 1.0], ["a", "a"])
    assert breaks(spark, five + load(1, 1, [-1.0, 2.0], ["a", "a"])) == {("x", 1, "shift")}  # at the edge of the range: not foreign


def test_unknown_values_and_empty_tables(spark):
    rows = load(9, 0, [None] * 4, [None] * 4) + load(1, 1, [1.0, math.nan, 2.0, 3.0], ["a", None, "b", "c"])
    assert breaks(spark, rows) == {("x", 1, "nulls"), ("k", 1, "nulls"), ("k", 1, "foreign")}
    assert breaks(spark, [(None, 1, T0, 1.0, "a", None), ("s", None, T0, 1.0, "a", None)]) == set()
    assert breaks(spark, []) == set()


def test_studies_do_not_mix_and_repeats_count(spark):
    rows = BASE + load(5, 3, [100.0, 101.0], ["z", "z"], study="other") + load(6, 4, [100.0, 101.0, 101.0, 100.0], ["z"] * 4, study="other")
    assert breaks(spark, rows) == set()


def expressions(spark, values):
    df = spark.createDataFrame([("c", v, 1) for v in values], "column_name string, value string, n bigint")
    return [(r.level, r.expression) for r in profile.induce_expressions(df, ["column_name"], "value", "n").collect()]


def test_expressions_match_their_values(spark):
    values = [f"P{i:03d}" for i in range(50)] + ["n/a", "", "x.y(z)", "Ünï 1"]
    got = expressions(spark, values)
    assert ("runs", r"[A-Z]+\d+") in got or ("lengths", r"[A-Z]\d\d\d") in got
    for v in values:
        assert any(re.fullmatch(e.replace(r"\p{L}", "[^\\W\\d_]"), v) for _, e in got) or not v.isascii()


def test_one_value_stays_a_literal_and_many_lengths_become_runs(spark):
    assert expressions(spark, ["ab"]) == [("literal", "ab")] or expressions(spark, ["ab"])[0][0] in ("lengths", "runs")
    many = expressions(spark, ["a" * i for i in range(1, 30)])
    assert many == [("runs", "[a-z]+")]
    assert expressions(spark, [None]) == []


def test_profile_counts(spark):
    rows = [(1, 1.0, "aa"), (1, 1.0, "bb"), (1, None, None), (1, math.nan, "cc"), (None, 5.0, "dd")]
    df = spark.createDataFrame(rows, "load bigint, x double, k string")
    got = {(r.column_name, r.load): r for r in profile.profile_loads(df, load="load", numeric=["x"], categorical=["k"]).collect()}
    x = got["x", 1]
    assert (x.n_rows, x.n_null, x.n_distinct, x.mean, x.sd) == (4, 2, 1, 1.0, 0.0)
    assert got["k", 1].n_distinct == 3 and got["k", 1].mean is None and got["x", None].n_rows == 1
    assert profile.profile_loads(df.limit(0), load="load", numeric=["x"], categorical=["k"]).count() == 0


def test_coverage_changes(spark):
    rows = [("s", 1, T0, 1.0, "aa", None)] * 4 + [("s", 2, T0 + dt.timedelta(days=1), 1.0, k, None) for k in ("aa", "b1", "c2", "d-3")] + [("s", 3, None, 1.0, None, None)]
    df = spark.createDataFrame(rows, LOADS)
    got = {(r.column_name, r.load): (r.form_expression, r.change) for r in profile.coverage_changes(df, study="study", load="load", at="at", columns=["k", "x"]).collect()}
    assert got["k", 2][1] == pytest.approx(0.75) and got["x", 2][1] == 0.0 and ("k", 3) not in got and ("k", 1) not in got
    assert profile.coverage_changes(df.limit(0), study="study", load="load", at="at", columns=["k"]).count() == 0


def test_foreign_categories_come_from_the_expressions(spark, monkeypatch):
    """Without expressions every category is foreign; with them the unknown ones are, whatever level matches."""
    codes = [f"P{i:03d}" for i in range(40)]
    rows = load(9, 0, [1.0] * 40, codes) + load(1, 1, [1.0] * 40, codes) + load(2, 2, [1.0] * 40, [*codes[:39], "P999"]) + load(3, 3, [1.0] * 40, [*codes[:39], "p-1"])
    assert breaks(spark, rows) == {("k", 2, "foreign"), ("k", 3, "foreign")}
    real = profile.induce_expressions
    monkeypatch.setattr(profile, "induce_expressions", lambda *a: real(*a).where("false"))
    assert {("k", i, "foreign") for i in (1, 2, 3)} <= breaks(spark, rows)


def test_moments_do_not_cancel_and_small_numbers_have_no_exponent(spark):
    df = spark.createDataFrame([(1, 1e9 + x) for x in (0.0, 1.0, 2.0)] + [(2, 0.0004), (2, 25000000.0)], "load bigint, x double")
    got = {r.load: r for r in profile.profile_loads(df, load="load", numeric=["x"], categorical=[]).collect()}
    assert got[1].sd == pytest.approx(1.0) and got[2].n_distinct == 2
    assert {r.value for r in profile.value_counts(df, [], ["x"]).collect()} == {"0.0004", "25000000.0", "1000000000.0", "1000000001.0", "1000000002.0"}
