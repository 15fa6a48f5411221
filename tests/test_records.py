"""Small record operators and text helpers."""

import pytest
from pyspark.sql import functions as F

from lodestat.functions import distributions as dist
from lodestat.functions import text as T
from lodestat.operators import records
from lodestat.plans.recipe import Recipe, describe
from lodestat.sources import readers


def values(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_kinds_and_transforms(spark):
    df = spark.createDataFrame([("beta", "x"), ("N", "inferential"), ("odd", None), (None, None)], "k string, r string")
    got = [tuple(r) for r in df.select(records.canonical_kind(F.col("k")), records.normal_role(F.col("k"), F.col("r"))).collect()]
    assert got == [("coefficient", "x"), ("n", "descriptive"), ("odd", None), (None, None)]
    with pytest.raises(Exception, match="positive"):
        spark.createDataFrame([(1.0, -1.0)], "x double, y double").select(records.pair_value(F.col("x"), F.col("y"), "log_ratio")).collect()
    r = spark.createDataFrame([(1.0, 0.5, 0.0, 2.0)], "v double, s double, l double, h double").select(*records.linear_transform(F.col("v"), F.col("s"), F.col("l"), F.col("h"), F.lit(-2.0))).first()
    assert tuple(r) == (-2.0, 1.0, -4.0, 0.0)


def test_lists_and_packets(spark):
    df = spark.createDataFrame([("[1,\"a\"]",), ("\"x\"",), ("{\"k\": 2}",), ("3",), (None,), ("not json",)], "j string")
    assert [r[0] for r in df.select(records.coerce_list(F.col("j"))).collect()] == [["1", "a"], ["x"], ["2"], ["3"], [], ["not json"]]
    p = spark.createDataFrame([(1, "a"), (2, "b")], "k int, n string")
    c = spark.createDataFrame([(1, 9), (1, 3), (5, 5)], "k int, v int")
    assert [(r.k, [x.v for x in r.items_]) for r in records.packets(p, c, ["k"], ["v"], "items_").orderBy("k").collect()] == [(1, [3, 9]), (2, [])]


def test_gates_anchors_and_rules(spark):
    amb = spark.createDataFrame([("a", [("f", "source_identity")]), ("b", [("f", None), None]), ("c", None), ("d", [])], "k string, ambiguities array<struct<field:string,kind:string>>")
    assert values(records.ambiguity_gate(amb, "k"), "k", "n_ambiguities", "abstain") == [("a", 1, True), ("b", 1, False), ("c", 0, False), ("d", 0, False)]
    claims = spark.createDataFrame([("p", "a1", 2.0), ("p", "a2", 3.0), ("q", "a1", 1.0), ("q", "a2", 1.0)], "paper string, analysis_id string, value double")
    focal = spark.createDataFrame([("p", 2.0 + 1e-9), ("q", 1.0)], "paper string, focal_value double")
    assert values(records.focal_anchor(claims, focal, "paper"), "paper", "analysis_id", "n_claims") == [("p", "a1", 1)]
    assert records.matched_columns(["pre_a", "pre_b"], ["post_b", "post_a"], ("pre", "post")) == [("pre_a", "post_a"), ("pre_b", "post_b")]
    with pytest.raises(ValueError):
        records.matched_columns(["pre_a"], ["post_b"], ("pre", "post"))
    assert records.amended_factors({"a": ["1", "2"], "b": ["x"]}, [("add", "a", "3"), ("remove", "a", "1"), ("pin", "b", "x")]) == {"a": ["2", "3"], "b": ["x"]}
    for bad in ([("remove", "b", "x")], [("pin", "a", "9")], [("add", "z", "1")], [("mix", "a", "1")]):
        with pytest.raises(ValueError):
            records.amended_factors({"a": ["1"], "b": ["x"]}, bad)


def test_eligible_ids_keep_order_and_repeats(spark):
    df = spark.createDataFrame([("r", "p", ["b", "x", "a", "b", None]), ("s", "p", None), ("t", "q", ["a"])], "k string, paper string, ids array<string>")
    allowed = spark.createDataFrame([("p", "a"), ("p", "b"), ("p", "b")], "paper string, id string")
    assert values(records.eligible_ids(df, "k", "ids", allowed, "id", "paper"), "k", "ids") == [("r", ["b", "a", "b"]), ("s", []), ("t", [])]


def test_perturbation_depends_on_keys_only(spark):
    df = spark.range(200).withColumn("x", F.lit(0.0))
    a = values(records.perturbed_rows(df.repartition(1), "id", "x", 3, 1.0), "id", "x")
    b = values(records.perturbed_rows(df.repartition(5), "id", "x", 3, 1.0), "id", "x")
    xs = [x for _, x in a]
    assert a == b and abs(sum(xs) / 200) < 0.3 and 0.7 < (sum(x * x for x in xs) / 200) ** 0.5 < 1.3


def test_text_helpers():
    assert T.supports("t(27) = 2.10, p = .04", 2.1, 2, "t") and not T.supports("F(1, 2) = 2.10", 2.1, 2, "t") and not T.supports("t = 2.1", 2.1, 2) and not T.supports("t = -2.10", 2.1, 2)
    assert T.unique_clause("x rose, t(27) = 2.10, p = .04. x fell, p = .04.", "missing; t(27) = 2.10") == (8, 20)
    assert T.unique_clause("ab ab", "ab ab ab ab") is None
    s = "One here. Two is long. Three."
    assert s[slice(*T.sentence_span(s, 12))] == "Two is long."
    assert T.replace_spans("abcdef", [(0, 1, "X"), (4, 6, "")]) == "Xbcd"
    with pytest.raises(ValueError):
        T.replace_spans("abc", [(0, 2, ""), (1, 3, "")])
    assert T.first_json('```json\n{"a": {"b": 1}} tail') == '{"a": {"b": 1}}' and T.first_json("{ no") is None
    assert T.scrub("p = .04 and .041, 0.04", [".04", "0.04"]) == "p = [withheld] and .041, [withheld]"
    assert T.unified_diff("a\nb", "a\nc").splitlines()[-2:] == ["-b", "+c"]


def test_power_and_words(tmp_path, spark):
    assert dist.minimum_effect(62, 4.0) == pytest.approx(0.71, abs=0.02)
    words = describe(Recipe("association", "x", "y", "partial", "t", "fisher_z", covariates=("z",)))
    assert words == "partial of x and y (association); given z; tested by t; with a fisher z interval"
    (tmp_path / "c.txt").write_text("variable: label\n")
    assert "label" in readers.read_codebook(spark, str(tmp_path / "c.txt"))
    with pytest.raises(ValueError):
        readers.read_codebook(spark, str(tmp_path / "c.exe"))
