"""Samples, integrity, reconciliation, specification space, sequences, text, sources and streams on small tables."""

import datetime as dt
import json
import math
import os

import pytest
from pyspark.sql import functions as F

from lodestat.functions import expr, udtf
from lodestat.functions import text as T
from lodestat.operators import evidence, integrity, ordered, readouts, reconcile, sample, sequence, specspace
from lodestat.operators.sample import Predicate
from lodestat.sources import readers, writers
from lodestat.streaming import ledger

NAN, T0 = float("nan"), dt.datetime(2025, 1, 1)


def values(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_filters_and_missing_values(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, " ", 2.0), (3, None, NAN), (4, "b", None)], "id bigint, k string, x double")
    assert values(sample.row_filter(df, [Predicate("k", "not_missing")]), "id") == [(1,), (4,)]
    assert values(sample.row_filter(df, [Predicate("x", "ne", 1)]), "id") == [(2,)]
    assert values(sample.row_filter(df, [Predicate("k", "eq", "a"), Predicate("x", "eq", "1")]), "id") == [(1,)]
    assert values(sample.complete_cases(df, ["k", "x"]), "id") == [(1,)]
    with pytest.raises(ValueError):
        Predicate("k", "like", "x")
    ids = spark.createDataFrame([(1,), (4,)], "i bigint")
    assert values(sample.id_sample(df, "id", ids, "i"), "id") == [(1,), (4,)]
    for bad in ([(1,), (1,)], [(9,)]):
        with pytest.raises(ValueError):
            sample.id_sample(df, "id", spark.createDataFrame(bad, "i bigint"), "i")


def test_strict_numbers(spark):
    df = spark.createDataFrame([("1",), (" -2.5e1 ",), (None,), (".5",)], "v string")
    assert [r.x for r in df.select(expr.strict_number(F.col("v")).alias("x")).collect()] == [1.0, -25.0, None, 0.5]
    for bad in ("1d", "1,5", "", "inf", "0x1", "x"):
        with pytest.raises(Exception, match="malformed"):
            spark.createDataFrame([(bad,)], "v string").select(expr.strict_number(F.col("v"))).collect()
    assert spark.createDataFrame([(" ",)], "v string").select(expr.strict_number(F.col("v"), True)).first()[0] is None
    with pytest.raises(Exception, match="infinite"):
        spark.createDataFrame([(float("inf"),)], "v double").select(expr.finite(F.col("v"))).collect()


def test_readouts(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 3.0, None), (None, NAN, 4.0)], "k string, x double, y double")
    one = lambda *a, **k: tuple(readouts.readout(df, *a, **k).first())
    assert one("mean", ["x"]) == (2.0, 2) and one("mean_columns", ["x", "y"]) == (2.5, 3) and one("count_missing", ["k"]) == (1.0, 3)
    assert one("count_threshold", ["x"], rule=">=2", multiplier=100)[0] == pytest.approx(100 / 3) and one("count_category", ["k"], category="a") == (2.0, 3)
    with pytest.raises(ValueError):
        readouts.threshold(F.col("x"), "about 2")
    p = {r.column_name: r for r in readouts.profile_table(df, ["x", "k"]).collect()}
    assert (p["x"].n, p["x"].missing, p["x"].n_distinct, p["x"].mean) == (3, 1, 2, 2.0) and p["k"].n_distinct == 1 and p["k"].mean is None
    alpha = spark.createDataFrame([(1.0, -1.0), (2.0, -2.0), (3.0, -3.0)], "a double, b double")
    assert readouts.readout(alpha, "cronbach_alpha", ["a", "b"], reverse=["b"]).first()["value"] == pytest.approx(1.0)


def test_rescoring(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0, 3.0), (2, 1.5, 2.0, 3.5), (3, 1.5, 2.5, 4.0)], "id bigint, a double, b double, total double")
    assert values(sample.rescore(df, ["a", "b"], "total", "prorate"), "id", "total") == [(1, 3.0), (2, 4.0)]
    assert values(sample.rescore(df, ["a", "b"], "total", "exclude_flagged"), "id") == [(1,)]
    with pytest.raises(Exception, match="add up"):
        sample.rescore(df.withColumn("total", F.lit(9.0)), ["a", "b"], "total", "prorate").collect()


def test_outlier_rules(spark):
    df = spark.createDataFrame([(i, float(x), float((x * 7) % 11)) for i, x in enumerate([1, 2, 3, 4, 5, 100])], "id bigint, x double, y double")
    for kept in (sample.outliers_sd(df, "x", 2.0), sample.outliers_iqr(df, "x", 1.5), sample.outliers_mad(df, "x", 3.0)):
        assert values(kept, "id") == [(i,) for i in range(5)]
    assert sample.outliers_mahalanobis(df, ["x", "y"], 0.8).count() == 5
    with pytest.raises(ValueError, match="singular"):
        sample.outliers_mahalanobis(df.withColumn("x2", F.col("x") * 2), ["x", "x2"], 0.9)
    assert values(sample.outliers_residual(df, "x", "y", [], 0.1, "id"), "id") == [(i,) for i in range(5)]
    ties = spark.createDataFrame([(i, float(i % 2), float(i % 2)) for i in range(10)], "id bigint, x double, y double")
    assert values(sample.outliers_residual(ties, "x", "y", [], 0.1, "id"), "id") == [(i,) for i in range(1, 10)]


def test_integrity(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (2, "d")], "k bigint, v string")
    assert {(r.k, r.n) for r in integrity.key_violations(df, ["k"]).collect()} == {(1, 2), (None, 1)}
    want = spark.createDataFrame([(1,), (3,)], "k bigint")
    assert {(r.k, r.problem) for r in integrity.exact_cover(df.where("k is not null"), want, ["k"]).collect()} == {(1, "repeated"), (2, "unexpected"), (3, "missing")}
    base = spark.createDataFrame([(1, "x"), (2, "y")], "k bigint, v string")
    change = spark.createDataFrame([(2, "z")], "k bigint, v string")
    assert values(integrity.upsert(base, change, ["k"], change), "k", "v") == [(1, "x"), (2, "z")]
    with pytest.raises(ValueError):
        integrity.upsert(base, change, ["k"], base)
    a = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, None)], "k bigint, v double")
    b = spark.createDataFrame([(1, 1.0 + 1e-12), (2, 2.1), (4, None)], "k bigint, v double")
    assert {(r.k, r.problem) for r in integrity.compare_results(a, b, ["k"], ["v"]).collect()} == {(2, "differs"), (3, "only_left"), (4, "only_right")}
    assert [r.column_name for r in integrity.round_trip_differences(a, a.withColumn("v", F.col("v") + F.when(F.col("k") == 2, 1e-6).otherwise(0.0)), "k").collect()] == ["v"]
    got = integrity.result_contract(spark.createDataFrame([(1.0, -1.0, 2.0, 1.5)], "estimate double, se double, p double, n double")).first()
    assert got.problems == ["se", "p", "n"]


@pytest.mark.parametrize(
    ("kind", "reported", "replicated", "precision", "comparator", "band"),
    [
        ("mean", 10.0, None, 1, None, "fail"), ("mean", None, 1.0, 1, None, None), ("p_value", 0.001, 0.0004, 3, "<", "A"), ("p_value", 0.001, 0.002, 3, "<", "fail"),
        ("p_value", 0.03, 0.0312, 2, None, "A"), ("p_value", 0.04, 0.03, 2, None, "B"), ("p_value", 0.04, 0.06, 2, None, "fail"), ("n", 100.0, 100.0, 0, None, "A"), ("n", 100.0, 101.0, 0, None, "B"),
        ("n", 100.0, 105.0, 0, None, "fail"), ("t", 2.0, -2.0, 2, None, "fail"), ("t", 2.0, 0.0, 2, None, "fail"), ("t", 2.0, 2.01, 2, None, "A"), ("t", 2.0, 2.3, 2, None, "B"), ("t", 2.0, 2.7, 2, None, "C"),
        ("t", 2.0, 3.0, 2, None, "fail"), ("d", 0.0, 0.001, 2, None, "A"), ("d", 0.0, 0.3, 2, None, "fail"), ("OR", 2.0, 2.02, 2, None, "A"), ("OR", 2.0, -1.0, 2, None, "fail"), ("sd", 2.0, 2.0, 2, None, "A"),
    ],
)
def test_grading(spark, kind, reported, replicated, precision, comparator, band):
    df = spark.createDataFrame([(kind, reported, replicated, precision, comparator)], "kind string, r double, v double, p int, c string")
    assert df.select(reconcile.grade(F.col("kind"), F.col("r"), F.col("v"), F.col("p"), F.col("c"))).first()[0] == band


def test_rounding(spark):
    df = spark.createDataFrame([(2.675, 2), (-0.5, 0), (1.005, 2), (0.125, 2)], "x double, p int")
    assert [r[0] for r in df.select(expr.round_half_up(F.col("x"), F.col("p"))).collect()] == pytest.approx([2.68, -1.0, 1.01, 0.13])


def test_mutual_best_is_order_free_and_leaves_ties(spark):
    pairs = [("a", "x", 5.0), ("a", "y", 4.0), ("b", "x", 4.5), ("b", "y", 3.0), ("c", "z", 1.0), ("c", "w", 1.0)]
    for order in (pairs, pairs[::-1]):
        got = reconcile.mutual_best(spark.createDataFrame(order, "l string, r string, s double"), "l", "r", "s")
        assert values(got, "l", "r", "round") == [("a", "x", 1), ("b", "y", 2)]
    assert reconcile.mutual_best(spark.createDataFrame([], "l string, r string, s double"), "l", "r", "s").count() == 0


def test_keyed_results_matrix_and_summary(spark):
    claims = spark.createDataFrame([("c1",), ("c2",), ("c3",)], "c string")
    results = spark.createDataFrame([("c1", 1.0), ("c1", 1.0 + 1e-9), ("c2", 1.0), ("c2", 2.0)], "c string, v double")
    assert values(reconcile.keyed_results(claims, results, "c", "v"), "c", "state") == [("c1", "matched"), ("c2", "ambiguous"), ("c3", "missing")]
    cells = spark.createDataFrame([("c1", "r1", 1.0), ("c2", "r1", None)], "c string, r string, v double")
    reps = spark.createDataFrame([("r1",), ("r2",)], "r string")
    got = {(r.c, r.r): r.disposition for r in reconcile.request_matrix(claims, reps, cells, "c", "r", "v").collect()}
    assert got["c1", "r1"] == "delivered" and got["c2", "r1"] == "invalid" and got["c3", "r1"] == "omitted" and got["c1", "r2"] == "failed"
    t = reconcile.trace_agreement(spark.createDataFrame([("k", "a"), ("k", "a"), ("k", "b"), ("k", None), ("m", None)], "k string, v string"), ["k"], "v")
    assert values(t, "k", "n_known", "n_unknown", "modal_value") == [("k", 3, 1, "a"), ("m", 0, 1, None)]


def test_specification_space(spark):
    grid = specspace.spec_grid(spark, {"a": ["1", "2"], "b": ["x", "y", "z"]}, [("a=2", "b=z")])
    assert [tuple(r) for r in grid.orderBy("position").collect()][:4] == [("spec_001", 1, "1", "x"), ("spec_002", 2, "1", "y"), ("spec_003", 3, "1", "z"), ("spec_004", 4, "2", "x")]
    assert grid.count() == 5
    specs = [r.asDict() for r in grid.orderBy("position").collect()]
    chosen = specspace.sample_specs(specs, 4, "paper")
    assert chosen == specspace.sample_specs(specs, 4, "paper") and len(chosen) == 4 and {s["b"] for s in specs if s["spec_id"] in chosen} == {"x", "y", "z"}
    with pytest.raises(ValueError):
        specspace.spec_grid(spark, {f"f{i}": ["a"] * 10 for i in range(6)})
    res = spark.createDataFrame([("1", "x", 1.0, 0.01), ("1", "y", 3.0, 0.2), ("2", "x", 1.5, 0.03)], "a string, b string, e double, p double")
    got = {r.factor: (r.n_sets, r.max_change_e) for r in specspace.matched_sets(res, ["a", "b"], ["e"]).collect()}
    assert got == {"a": (1, 0.5), "b": (1, 2.0)}
    c = specspace.curve_rank(res, [], "e", F.lit(1.5), 1, "p").first()
    assert (c.below, c.above, c.tied, c.rank, c.rank_high, c.extremeness) == (1, 1, 1, 2, 2, pytest.approx(1 / 3))


def test_sequences(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", 2), ("a", 5), (None, 7), ("b", None)], "g string, i bigint")
    assert {tuple(r) for r in sequence.islands(df, ["g"], "i").collect()} == {("a", 1, 2, 2), ("a", 5, 5, 1), (None, 7, 7, 1)}
    iv = spark.createDataFrame([("a", 0, 5), ("a", 3, 4), ("a", 5, 9), ("a", 20, 21), ("a", None, 3)], "g string, s bigint, e bigint")
    assert values(sequence.merge_intervals(iv, ["g"], "s", "e"), "s", "e", "n") == [(0, 9, 3), (20, 21, 1)]
    w = spark.createDataFrame([("a", i, x) for i, x in enumerate([4.0, 5.0, 12.0, 1.0, None, 9.0])], "g string, i bigint, w double")
    assert [r.batch for r in sequence.greedy_batches(w, ["g"], ["i"], "w", 10.0).orderBy("i").collect()] == [0, 0, 1, 2, 2, 2]
    ev = spark.createDataFrame([("u", T0 + dt.timedelta(seconds=s), f) for s, f in ((0, True), (900, False), (901, False), (902, None))], "u string, ts timestamp, failed boolean")
    assert [r.cooling for r in sequence.cooldown(ev, "u", "ts", "failed", 900).orderBy("ts").collect()] == [False, True, False, False]
    pts = spark.createDataFrame([("k", x) for x in (-7, 0, 3, 4, 11)], "k string, x bigint")
    got = values(sequence.band_join(pts, pts.withColumnRenamed("x", "y"), "k", "x", "y", 1, 7), "x", "y")
    assert got == sorted((a, b) for a in (-7, 0, 3, 4, 11) for b in (-7, 0, 3, 4, 11) if 1 <= b - a <= 7)


def test_previous_row_spans_slices(spark):
    rows = [("p", i, i // 3) for i in range(10)] + [("q", 1, 0), (None, 2, 0), (None, 3, 1)]
    df = spark.createDataFrame(rows, "k string, t bigint, s bigint")
    got = {(r.k, r.t): r.prev and r.prev.t for r in ordered.previous_row(df, by="k", order=["t"], carry=["t"], slice_of=F.col("s")).collect()}
    assert got == {("p", i): (i - 1 if i else None) for i in range(10)} | {("q", 1): None, (None, 2): None, (None, 3): 2}


def test_text_functions(spark):
    df = spark.createDataFrame([("Study 2: M = −3.10, t(27) = .45, c003 1,204 85 dB",), ("<.001",), (None,)], "s string")
    r = df.select(T.number_tokens(F.col("s")).alias("n"), T.parse_reported(F.col("s")).alias("p"), T.printed_df(F.col("s")).alias("d"), T.design_markers(F.col("s")).alias("m")).collect()
    assert r[0].n == ["2", "−3.10", "27", ".45", "1,204", "85"] and r[0].d == "27" and r[0].m == ["85 db", "study 2"] and r[1].p.value == 0.001 and r[1].p.comparator == "<" and r[0].p.value is None
    assert T.number_words("forty-two") == 42 and T.number_words("two hundred and seven") == 207 and T.number_words("many") is None
    assert T.leak_forms(0.512, 3) == ["0.512", ".512", "0.51", ".51"] and "0.05" not in T.leak_forms(0.051, 3)
    assert T.norm_source("a  ∗ b , −1") == "a * b, -1" and T.norm_review("“A” — b") == '"a" - b' and T.compact("a b−c") == "ab-c"
    assert T.holds_fragments("The quick brown fox jumps over the dog", "quick brown fox … jumps over the") and not T.holds_fragments("abc", "abc")
    assert T.labels_match("Section Results 2", "results 2") and not T.labels_match("Table 1", "Table 2") and T.ratio("", "x") == 1.0


def test_leaks_and_spans(spark):
    texts = spark.createDataFrame([(1, "t was .512, not 0.5120 or x.512; 0.512."), (2, None), (3, "[95% CI .51]"), (4, "")], "d bigint, s string")
    forms = evidence.forbidden_forms(spark.createDataFrame([("c", 0.512, 3), ("n", None, 2)], "k string, v double, p int"), "k", "v", "p", 3)
    hits = values(evidence.scan_forms(texts, "d", "s", forms), "d", "form", "start")
    assert hits == [(1, ".512", 6), (1, "0.512", 33)]
    assert evidence.scan_forms(texts, "d", "s", forms.limit(0)).count() == 0
    assert evidence.repair_spans(evidence.scan_forms(texts, "d", "s", forms), "d", 20).count() == 1
    nums = spark.createDataFrame([("t1", 1, 1, 10.0, 5.0), ("t2", 1, 1, 30.0, 5.0)], "token_id string, page int, line int, x1 double, y double")
    marks = spark.createDataFrame([("m1", 1, 1, 12.0, 6.0), ("m2", 1, 1, 31.0, 5.0), ("m3", 1, 1, 33.0, 5.0)], "marker_id string, page int, line int, x0 double, y double")
    assert values(evidence.marker_join(nums, marks), "token_id", "marker_id") == [("t1", "m1")]
    claims = spark.createDataFrame(
        [("a", "descriptive", 1, 1, True, False, "text", 0, 0, "o1"), ("b", "unknown", 1, 1, True, False, "text", 0, 0, "o2"), ("c", "d", None, 1, False, False, None, 1, 20, "o3"), ("d", "d", None, 1, False, False, None, 1, 20, "o3")],
        "k string, role string, token_page int, page int, token_supports boolean, adjudicated boolean, token_kind string, quote_hits int, quote_length int, occurrence_id string",
    )
    assert values(evidence.evidence_ladder(claims), "k", "evidence") == [("a", "text_anchored"), ("b", "abstained"), ("c", "abstained"), ("d", "abstained")]


def test_sql_functions(spark):
    udtf.register(spark)
    assert spark.sql("SELECT is_close(1.0D, 1.0D + 1e-12, 1e-9D, 0D), norm_name('A  b!'), t_two_sided(2.0D, 10D)").first()[:2] == (True, "a_b")
    doc = json.dumps({"a": [1, {"b": None}], "meta": {"x": 1}, "c": {"d": {"e": "f"}}})
    got = spark.createDataFrame([(doc,), ("nope",), (None,)], "j string").createOrReplaceTempView("docs")
    del got
    rows = {tuple(r) for r in spark.sql("SELECT l.* FROM docs, LATERAL json_leaves(j, 'meta') l").collect()}
    assert rows == {("$.a[0]", "1"), ("$.a[1].b", None), ("$.c.d.e", "f")}


def test_sources_and_sinks(spark, tmp_path):
    import pandas as pd

    (tmp_path / "a.csv").write_text('id,v\n1,NA\n2,"x, ""y"""\n3,\n')
    assert values(readers.read_table(spark, str(tmp_path / "a.csv")), "id", "v")[1] == ("2", 'x, "y"') and readers.read_table(spark, str(tmp_path / "a.csv")).where("v is null").count() == 2
    (tmp_path / "b.txt").write_text("a\tb\n1\t2\n")
    (tmp_path / "c.txt").write_text("just some prose\nin two lines\n")
    assert readers.read_table(spark, str(tmp_path / "b.txt")).columns == ["a", "b"] and readers.read_table(spark, str(tmp_path / "c.txt")) is None
    (tmp_path / "two.csv").write_text("T1,,T2,\nm,s,m,s\n1,2,3,4\n")
    assert readers.two_row_header(spark, str(tmp_path / "two.csv")) == ["T1_m", "T1_s", "T2_m", "T2_s"]
    pd.DataFrame({"x": [1.0, 2.0], "k": ["a", "b"]}).to_stata(tmp_path / "d.dta", write_index=False)
    assert values(readers.read_table(spark, str(tmp_path / "d.dta")), "k", "x") == [("a", "1.0"), ("b", "2.0")]
    cat = readers.catalog(spark, [str(tmp_path / n) for n in ("a.csv", "c.txt", "gone.csv")])
    assert {(os.path.basename(r.file), r.error) for r in cat.collect()} >= {("c.txt", "prose")} and cat.where("error is not null").count() == 2
    with pytest.raises(ValueError):
        readers.contained(str(tmp_path), "../x")
    assert readers.read_artifact(spark, str(tmp_path / "none.json"), "a int").count() == 0
    (tmp_path / "l.xml").write_text('<doc><page number="1"><line y="5.0"><word x0="1" x1="2">p</word><word x0="3" x1="4">.05</word></line></page></doc>')
    assert values(readers.layout_words(spark, str(tmp_path / "l.xml")), "page", "word_index", "word") == [(1, 0, "p"), (1, 1, ".05")]
    assert readers.assemble_manifest(["a/x.csv", "b/x.csv", "c/s.R"], {"title": "T"}) == {"data_files": ["a/x.csv"], "original_code": ["c/s.R"], "pdf": [], "codebook": [], "title": "T"}
    df = spark.createDataFrame([(1, "a|b", 0.5)], "n bigint, k string, x double")
    assert "a\\|b" in writers.markdown(df)
    writers.append_events(df, str(tmp_path / "log"))
    writers.append_events(df, str(tmp_path / "log"))
    assert readers.read_events(spark, str(tmp_path / "log"), "n bigint, k string, x double").count() == 2
    writers.write_artifact(str(tmp_path / "r.json"), {"a": 1})
    assert writers.archive(str(tmp_path / "r.json")).endswith(".v1") and not os.path.exists(tmp_path / "r.json")
    writers.done_marker(str(tmp_path / "done"), {"i": "1"}, "x", {})
    assert writers.is_current(str(tmp_path / "done"), {"i": "1"}, "x", {}) and not writers.is_current(str(tmp_path / "done"), {"i": "2"}, "x", {})
    ids = readers.identifier_columns(spark.createDataFrame([(1, 1, None), (2, 1, "a")], "a int, b int, c string"), ["a", "b", "c"])
    assert ids == ["a"]


def test_streams_equal_batches(spark, tmp_path):
    rows = [(i, T0 + dt.timedelta(minutes=7 * i), f"u{i % 3}", float(i % 5) if i % 4 else None, 2.0, i % 6 == 0) for i in range(60)]
    schema = "event_id bigint, ts timestamp, u string, cost double, reserved double, failed boolean"
    batch = spark.createDataFrame(rows, schema)
    path = str(tmp_path / "events")
    batch.repartition(3).write.parquet(path)
    stream = lambda: ledger.event_stream(spark, path, batch.schema)
    got = ledger.run_once(ledger.running_totals(stream(), "u", "cost"), "complete", str(tmp_path / "c1"))
    assert values(got, "u", "n", "total") == values(batch.groupBy("u").agg(F.count("*").alias("n"), F.sum("cost").alias("total")), "u", "n", "total")
    got = ledger.run_once(ledger.budget_stream(stream(), "u", 20.0), "append", str(tmp_path / "c2"), own_state=True)
    used, want = {}, set()
    for i, ts, u, cost, reserved, _ in sorted(rows, key=lambda r: (r[1], r[0])):
        amount = reserved if cost is None else cost
        ok = used.get(u, 0.0) + amount <= 20.0
        used[u] = used.get(u, 0.0) + amount * ok
        want.add((i, ok))
    assert {(r.event_id, r.accepted) for r in got.collect()} == want
    cooled = ledger.run_once(ledger.cooling_windows(stream(), "ts", "u", "failed"), "append", str(tmp_path / "c3"))
    assert cooled.count() > 0 and not any(math.isnan(r.n_failures) for r in cooled.collect())
