"""Rows count for the expression that was chosen for their values, not for all of one form of runs."""

import datetime as dt

import pytest

from lodestat.operators import profile

T0 = dt.datetime(2025, 1, 1)
AGES = [a for a in range(10, 100) for _ in range(20)]


def test_a_rare_length_does_not_conform(spark):
    df = spark.createDataFrame([(1, a) for a in AGES] + [(2, a) for a in (100, 203, 311, 450, 999)], "load bigint, age bigint")
    got = {r.load: r.n_nonconforming for r in profile.profile_loads(df, load="load", numeric=["age"], categorical=[]).collect()}
    assert got == {1: 0, 2: 5}


def test_a_rare_literal_does_not_conform(spark):
    df = spark.createDataFrame([(1, "中文")] * 999 + [(1, "日本")], "load bigint, k string")
    found = profile.induce_expressions(profile.value_counts(df, [], ["k"]), ["column_name"], "value", "n").collect()
    assert {(r.level, r.expression, r.n_rows) for r in found} == {("literal", "中文", 999), ("literal", "日本", 1)}
    assert [r.n_nonconforming for r in profile.profile_loads(df, load="load", numeric=[], categorical=["k"]).collect()] == [1]


def test_coverage_changes_by_length(spark):
    rows = [("s", 1, T0, a) for a in AGES] + [("s", 2, T0 + dt.timedelta(days=1), a) for a in (10, 20, 100, 203)]
    df = spark.createDataFrame(rows, "study string, load bigint, at timestamp, age bigint")
    got = profile.coverage_changes(df, study="study", load="load", at="at", columns=["age"]).collect()
    assert [(r.load, r.change) for r in got] == [(2, pytest.approx(0.5))] and got[0].form_expression in ("\\d\\d", "100", "203", "\\d\\d\\d")
