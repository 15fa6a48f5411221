"""Candidates for linkage: each gate on its own."""

import random

import pytest
from pyspark.sql import functions as F

from lodestat.operators import reconcile, records

FIELDS = ("id", "paper_id", "page", "kind", "study_id", "loc_kind", "label", "cell", "description", "source_quote")
SCHEMA = "id int, paper_id string, page int, kind string, study_id string, loc_kind string, label string, cell string, description string, source_quote string"
BASE = dict(id=1, paper_id="p", page=3, kind="t", study_id="1", loc_kind="table", label="Table 2", cell="men / total", description="test of the reaction time in the 85 dB group", source_quote="the reaction time fell, t(27) = 2.50, in Study 1")


def candidates(spark, **other):
    a = spark.createDataFrame([tuple(BASE[f] for f in FIELDS)], SCHEMA)
    b = spark.createDataFrame([tuple((BASE | {"id": 2} | other)[f] for f in FIELDS)], SCHEMA)
    return records.linkage_candidates(a, b).collect()


@pytest.mark.parametrize(
    ("other", "linked"),
    [
        ({}, True), ({"page": 4}, False), ({"page": None}, False), ({"paper_id": "q"}, False), ({"kind": "F"}, False), ({"study_id": "2"}, False), ({"study_id": None}, True), ({"loc_kind": "text"}, False),
        ({"label": "table 2"}, True), ({"label": "Table 3"}, False), ({"label": None}, True), ({"cell": "total - men"}, True), ({"cell": "women / total"}, False), ({"cell": ""}, True),
        ({"description": "reaction time of the 80 dB group", "source_quote": None}, False), ({"source_quote": "the reaction time fell, t(28) = 2.50, in Study 1"}, False), ({"source_quote": "the reaction time fell, t(27) = 2.91, in Study 1"}, True),
        ({"source_quote": "in Experiment 2, t(27) = 2.50"}, False), ({"description": "hunger", "source_quote": "no word of it"}, False), ({"description": "reaction time", "source_quote": None}, True),
    ],
)
def test_gates(spark, other, linked):
    assert bool(candidates(spark, **other)) is linked


def test_support(spark):
    same, near, far = candidates(spark)[0].score, candidates(spark, source_quote=BASE["source_quote"].replace("2.50", "2.91"))[0].score, candidates(spark, source_quote=None)[0].score
    assert same > near > far and far == pytest.approx(2.0)
    a = spark.createDataFrame([tuple((BASE | {"kind": "mean"})[f] for f in FIELDS)], SCHEMA)
    b = spark.createDataFrame([tuple((BASE | {"id": 2, "kind": "other"})[f] for f in FIELDS)], SCHEMA)
    assert records.linkage_candidates(a, b).count() == 1 and records.linkage_candidates(a, b.limit(0)).count() == 0


def sides(spark, seed):
    """Two lists with ties, missing values and, for odd seeds, leads that are narrow."""
    rng = random.Random(seed)
    make = lambda n, first: [(first + i, rng.choice([1, 1, 2, None]), rng.choice([None] + 12 * [round(rng.uniform(0, 3 if seed % 2 else 12), 1 + seed % 2)])) for i in range(n)]
    left, right = make(40, 0), make(30, 1000)
    if seed == 3:  # a row delivered twice, and a key with two values
        left += [left[3], (left[0][0], 1, 2.5)]
    return spark.createDataFrame(left, "l long, lb int, lx double"), spark.createDataFrame(right, "r long, rb int, rx double")


@pytest.mark.parametrize("seed", range(4))
def test_mutual_nearest_is_mutual_best_of_all_pairs(spark, seed):
    a, b = sides(spark, seed)
    pairs = a.join(b, a.lb == b.rb).where("lx is not null and rx is not null").select("l", "r", (-F.abs(F.col("lx") - F.col("rx"))).alias("score"))
    for rounds in (1, None):
        want = reconcile.mutual_best(pairs, "l", "r", "score", rounds=rounds).collect()
        got = reconcile.mutual_nearest(a, b, "l", "r", ("lb", "rb"), ("lx", "rx"), rounds=rounds)
        assert got.columns == ["l", "r", "score", "round"] and sorted(map(tuple, got.collect())) == sorted(map(tuple, want)) and want
    with pytest.raises(ValueError):
        reconcile.mutual_nearest(a, b, "l", "r", ("lb", "rb"), ("lx", "rx"), margin=0.0)


def test_mutual_best_forms_no_pairs(spark, small):
    """A nation's customers times its suppliers are too many to be formed."""
    import __spark_entry__ as entry

    assert "Join" not in entry.queries()["mutual_best"](spark, small)._jdf.queryExecution().toString()


def test_mutual_best_fixpoint_forms_no_pairs(spark, small, monkeypatch):
    import __spark_entry__ as entry

    seen = []
    own = reconcile.cut
    monkeypatch.setattr(reconcile, "cut", lambda df: seen.append(df._jdf.queryExecution().toString()) or own(df))
    entry.queries()["mutual_best_fixpoint"](spark, small)
    assert seen and not any("Join" in plan for plan in seen)
