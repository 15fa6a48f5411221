"""Grades, bounds, designs and samples of specifications, row by row from their rules."""

from pyspark.sql import functions as F

from lodestat.functions import text as T
from lodestat.operators import reconcile, specspace

ROWS = [  # kind, reported, replicated, precision, comparator, band
    ("n", 40.0, 39.6, 0, None, "A"), ("n", 40.0, 39.4, 0, None, "fail"), ("n", 400.0, 397.0, 0, "=", "B"), ("n", 0.0, 0.4, 0, None, "A"), ("n", 0.0, 1.0, 0, None, "fail"),
    ("d", 0.5, 0.0, 2, None, "fail"), ("d", 0.5, -0.5, 2, None, "fail"), ("sd", 0.5, -0.5, 2, None, "fail"), ("d", 0.0004, -0.001, None, None, "A"), ("d", 0.0, 0.0, 2, None, "A"),
    ("OR", 2.0, 2.004, 2, None, "A"), ("OR", 1.0, 1.0015, None, None, "A"), ("OR", 1.0, 1.1, None, None, "fail"), ("HR", 2.0, 0.001, 2, None, "fail"), ("OR", -2.0, -2.0, 2, None, "fail"),
    ("p_value", 0.03, 0.034, 2, None, "A"), ("p_value", 0.03, 0.044, 3, None, "B"), ("p_value", 0.03, 0.051, 3, None, "fail"), ("p_value", 0.0, 0.0004, 3, None, "A"), ("p_value", 0.001, 0.0004, 4, "<", "A"),
    ("p_value", 0.05, 0.05, 2, "<", "fail"), ("mean", 10.0, 11.0, 1, None, "B"), ("mean", 10.0, 13.0, 1, None, "C"), ("mean", 10.0, 14.0, 1, None, "fail"), (None, 10.0, 10.1, 1, None, "A"),
    ("mean", None, None, 1, None, "fail"), ("mean", None, 1.0, 1, None, None), ("mean", 1.0, None, 1, None, "fail"),
]


def test_every_rule_of_the_grades(spark):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(ROWS)], "i int, kind string, r double, v double, p int, c string, band string")
    got = df.select("i", "band", reconcile.grade(*map(F.col, "kind r v p c".split())).alias("got")).collect()
    assert {r.i: r.got for r in got} == {i: r[-1] for i, r in enumerate(ROWS)}


def test_what_goes_with_a_grade(spark):
    df = spark.createDataFrame([("d", 0.3, 0.304, 2, "<"), ("d", 0.3, 0.306, 2, "<"), ("d", 0.3, 0.2, 2, "<"), ("p_value", 0.05, 0.0501, 2, "<"), ("d", 0.3, 0.297, 2, ">="), ("d", 0.3, 0.3, None, "<")], "k string, r double, v double, p int, c string")
    assert [r[0] for r in df.select(reconcile.rounding_compatible(*map(F.col, "krvpc"))).collect()] == [True, False, None, None, True, None]
    r = df.limit(1).select(reconcile.unit_candidates(F.lit(0.5)).alias("u"), reconcile.sigma_rule(F.lit(1.0), F.lit(3.0), F.lit(1.0)).alias("a"), reconcile.sigma_rule(F.lit(1.0), F.lit(3.0), F.lit(0.0)).alias("b")).first()
    assert [x.value for x in r.u] == [50.0, 0.005, -0.5] and (r.a, r.b) == ("within", "na")


def test_designs(spark):
    rows = [
        ("Paired t-test", 1, 0, "paired"), ("repeated measures", 1, 0, None), ("independent samples t test", 1, 0, "two_group"), ("t-test", 1, 2, None), ("mixed ANOVA", 1, 0, None), ("one-way ANOVA", 1, 0, None),
        ("Pearson correlation", 1, 0, "correlation"), ("correlation", 2, 0, None), ("linear regression", 1, 0, "correlation"), ("linear regression", 1, 1, None), ("OLS", None, None, None), ("between-group contrast", 1, 0, None), ("", 1, 0, None), (None, 1, 0, None),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, m string, p int, c int, want string")
    assert {r.i: r.d for r in df.select("i", T.design_of(F.col("m"), F.col("p"), F.col("c")).alias("d")).collect()} == {i: r[-1] for i, r in enumerate(rows)}


def test_masks(spark):
    df = spark.createDataFrame([("Two hundred of N300 gave t2 = -1.5 (a thousand times)",)], "t string")
    assert df.select(T.mask_numbers(F.col("t"))).first()[0] == "[quantity] [quantity] of N[quantity] gave t[quantity] = -[quantity] (a [quantity] times)"


def test_samples_of_specifications():
    specs = [{"spec_id": f"s{a}{b}{c}", "a": a, "b": b, "c": c} for a in "xyz" for b in "pq" for c in "mn"]
    one = specspace.sample_specs(specs, 5, "paper-1", "sxpm")
    assert one == specspace.sample_specs(specs, 5, "paper-1", "sxpm") and "sxpm" in one and len(one) == 5 and one == [s["spec_id"] for s in specs if s["spec_id"] in one]
    assert {i[1] for i in one} == set("xyz") and {i[2] for i in one} == set("pq") and {i[3] for i in one} == set("mn")
    assert len({tuple(specspace.sample_specs(specs, 5, f"p{i}")) for i in range(6)}) > 1 and specspace.sample_specs(specs, 12, None) == [s["spec_id"] for s in specs]
    assert len(specspace.sample_specs(specs, 2, None)) == 2
