"""Decisions about records: every rule on a small table."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestat.operators import decisions as D
from lodestat.operators import resample


def one(spark, row, schema, *columns):
    return spark.createDataFrame([row], schema).select(*columns).first()


def test_decisions_and_their_lineage(spark):
    items = spark.createDataFrame([(i, "p", float(i), None) for i in range(7)], "id int, paper string, v double, note0 string")
    made = [(1, "correct", True, (9.0,)), (2, "drop", None, None), (3, "keep", False, None), (4, "keep", False, (9.0,)), (5, "keep", False, (5.0,)), (6, "correct", False, (7.0,)), (99, "drop", False, None)]
    merged = D.apply_decisions(items, spark.createDataFrame(made, "id int, decision string, uncertain boolean, corrected struct<v:double>"), "id", ["v"], ["v"])
    got = {r.id: (r.v, r.state, r.note) for r in merged.collect()}
    assert got[0][1:] == ("unresolved", "no decision") and got[1] == (1.0, "unresolved", "uncertain") and got[2][1] == "dropped" and got[3][2] == "no record"
    assert got[4] == (4.0, "unresolved", "keep changed a field") and got[5] == (5.0, "kept", None) and got[6] == (7.0, "kept", None)
    lineage = {r.id: r.claim_id for r in D.decision_lineage(merged.join(items.select("id", "paper"), "id"), "id", ["paper"], ["id"]).collect()}
    assert lineage[2] is None and lineage[0] == "c001" and lineage[6] == "c006"
    assert D.apply_decisions(items.limit(0), spark.createDataFrame(made, "id int, decision string, uncertain boolean, corrected struct<v:double>"), "id", ["v"], ["v"]).count() == 0


def test_units_are_decided_once(spark):
    items = spark.createDataFrame([(1, "a", None), (2, "a", None), (3, "b", "x"), (4, None, "x")], "id int, f string, g string")
    unit = spark.createDataFrame([("a", None)], "f string, g string").select(D.unit_id(["f", "g"]).alias("unit_id"), F.lit("verified").alias("decision"))
    assert {r.id: (r.n_members, r.decision) for r in D.decide_once(items, ["f", "g"], unit).collect()} == {1: (2, "verified"), 2: (2, "verified"), 3: (1, "unresolved"), 4: (1, "unresolved")}


def test_evidence_and_levels(spark):
    rows = [(["ab", "cd"], "ab cd", None), (["ab", "ab"], "ab", "fewer than two quotations"), (["ab", "x"], "ab", "a quotation is not in the source"), (None, "ab", "fewer than two quotations"), (["ab", None], "ab", "a quotation is not in the source"), (["ab", " "], "ab ", "a quotation is not in the source")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, q array<string>, s string, want string")
    assert all(r.want == r.got for r in df.select("want", D.competing_problem(F.col("q"), F.col("s")).alias("got")).collect())
    factors = spark.createDataFrame([("p", f, ["a", "b"]) for f in "vwxyz"] + [("q", "v", ["a"])], "paper string, factor string, levels array<string>")
    answers = [("p", "v", "a", "We  used the FIRST of both rules"), ("p", "w", "c", "We used the first of both rules"), ("p", "x", None, "x"), ("p", "y", "a", "short"), ("q", "v", "a", "We used the first of both rules"), ("q", "v", "a", "twice")]
    sources = spark.createDataFrame([("p", "Here we used the first of both rules."), ("q", "we used the first of both rules")], "paper string, source string")
    got = {(r.paper, r.factor): (r.level, r.status) for r in D.author_levels(factors, spark.createDataFrame(answers, "paper string, factor string, level string, evidence string"), sources, ["paper"]).collect()}
    assert got == {("p", "v"): ("a", "documented"), ("p", "w"): (None, "invalid_level"), ("p", "x"): (None, "undetermined"), ("p", "y"): (None, "quote_rejected"), ("p", "z"): (None, "missing"), ("q", "v"): (None, "missing")}


def test_legends_and_places(spark):
    text = "Note. * p < .05. ** p b .01; *** p � .001"
    schema = "legend string, lit string, adj boolean, v double, p int, t string"
    legend = lambda *r: one(spark, (*r, text), schema, D.table_legend(*map(F.col, ("legend", "lit", "adj", "v", "p", "t"))))[0]
    assert legend("* p < .05", "*", False, 0.05, 2) == "* p < .05" and legend("** p < .01", "**", True, 0.01, 2) == "** p b .01"
    assert legend("** p < .01", "**", False, 0.01, 2) is None and legend("** p < .01", "**", True, 0.01, 3) is None and legend("*** p < .001", "***", True, 0.001, 3) == "*** p � .001"
    place = lambda kind, quote, t: one(spark, (kind, quote, t), "k string, q string, t string", D.token_position(F.col("k"), F.col("q"), F.col("t")))[0]
    assert place("t", "as t(27) = 2.50, p < .05", "So, as t(27) = 2.50, p < .05.") == "So, as t(27) = 2.50".index("2.50") and place("p_value", "t(27) = 2.50, p < .05", "t(27) = 2.50, p < .05") == 18
    assert place("t", "t = 1.0 and t = 2.0", "t = 1.0 and t = 2.0") is None and place("t", "t = 1.25", "t = 1.25 or t = 1.25") is None and place("t", None, "x") is None and place("mean", "M = 2.5000", "M = 2.5000") is None


def test_small_rules(spark):
    r = one(spark, (["a", "b"], ["a", "b", "c"], ["a", "b", "b"], " Trim = A=b "), "r array<string>, v array<string>, a array<string>, t string",
            D.audit_covers(F.col("r"), F.col("v"), F.col("r")).alias("ok"), D.audit_covers(F.col("r"), F.col("v"), F.col("a")).alias("twice"), D.audit_covers(F.col("v"), F.col("v"), F.col("r")).alias("short"),
            D.parse_reference(F.col("t")).alias("ref"), D.row_distance(F.lit(None).cast("double"), F.lit(1.0), F.lit(-2.0)).alias("d"), D.comparator_number(F.lit("<= .05")).alias("n"), D.numbers_in(F.lit("a -1.5 .2 3")).alias("ns"))
    assert (r.ok, r.twice, r.short) == (True, False, False) and tuple(r.ref) == ("trim", "a=b") and (r.d, r.n, list(r.ns)) == (2.0, 0.05, [-1.5, 0.2, 3.0])
    cache = spark.createDataFrame([("f", "text", "l"), ("g", "text", None)], "fingerprint string, response string, ledger_id string").withColumn("response_hash", F.sha2("response", 256))
    wanted = spark.createDataFrame([("f",), ("g",), ("h",)], "fingerprint string")
    assert {r.fingerprint: r.response for r in D.cached_answers(wanted, cache).collect()} == {"f": "text", "g": None, "h": None}
    assert {r.fingerprint: r.response for r in D.cached_answers(wanted, cache.withColumn("response", F.lit("other"))).collect()} == {"f": None, "g": None, "h": None}
    runs = spark.createDataFrame([("a",), ("b/c",), (None,), ("z",)], "r string")
    assert {x.r: x.problem for x in D.run_problems(runs, runs.where("r = 'a'"), "r").collect()} == {"b/c": "no folder name", None: "no folder name", "z": "missing"}
    assert [x.replica_id for x in D.replica_runs(spark.createDataFrame([("m", 3), ("n", 0)], "family string, runs int"), cap=2).orderBy("replica_id").collect()] == ["m_1", "m_2"]


def test_the_engine_and_its_second_formulation(spark):
    rng = np.random.default_rng(3)
    rows = [(f"s{i:02d}", float(a), float(b)) for i, (a, b) in enumerate(zip(rng.uniform(2, 9, 12), rng.uniform(1, 8, 12)))]
    df = spark.createDataFrame(rows, "id string, x double, y double")
    got = {(r.omitted, r.spec_id): r for r in resample.paired_engine(df, "x", "y", "id", draws=2000).collect()}
    assert len(got) == 10 + 12 * 4 and all(r.problem is None for r in got.values())
    d = np.array([a - b for _, a, b in rows])
    boot = d[np.random.default_rng(resample.ENGINE_SEED + 12).integers(0, 12, (2000, 12))].mean(1)
    want = (int((abs(boot - d.mean()) >= abs(d.mean())).sum()) + 1) / 2001
    r = got[None, "raw/mean/centred/percentile"]
    assert r.p_raw == want and r.ci_lower == pytest.approx(np.quantile(boot, 0.025)) and got["s03", "raw/mean/centred/percentile"].estimate == pytest.approx(np.delete(d, 3).mean())
    index = resample.resample_index(spark, 12, 2000, resample.ENGINE_SEED + 12)
    two = resample.bootstrap_by_index(df, "x", "y", "id", index).first()
    assert two.p_raw == want and two.n == 12


def test_blocks_of_the_index_are_one_stream(spark, monkeypatch):
    monkeypatch.setattr(resample, "BLOCK_CELLS", 70)
    got = resample.resample_index(spark, 7, 95, 5).orderBy("draw", "pos").toPandas()["idx"].to_numpy().reshape(95, 7)
    assert (got == np.random.default_rng(5).integers(0, 7, (95, 7))).all()
