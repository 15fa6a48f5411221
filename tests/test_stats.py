"""Tests from aggregates against NumPy on the same rows, recipes against brute force, and wrong methods told apart."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestat.functions import distributions as dist
from lodestat.operators import ranked, resample, tstats
from lodestat.plans.recipe import DirectPlan, Recipe, RecipeBook, canonical_family, from_json, from_mapping, run_direct, to_json

RNG = np.random.default_rng(5)
N = 60
DATA = {"x": RNG.normal(1, 2, N).round(2), "y": RNG.normal(0.5, 1, N).round(1), "z": RNG.normal(0, 1, N).round(2)}
DATA["y"] = (DATA["y"] + 0.5 * DATA["z"] + 0.2 * DATA["x"]).round(2)
ROWS = [(i, "ab"[i % 2], *(float(DATA[c][i]) for c in "xyz")) for i in range(N)]
SCHEMA = "id bigint, g string, x double, y double, z double"


@pytest.fixture(scope="module")
def df(spark):
    holes = [(100, "a", None, 1.0, 2.0), (101, "b", float("nan"), 1.0, 2.0)]
    return spark.createDataFrame(ROWS + holes, SCHEMA)


@pytest.fixture(scope="module")
def whole(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def row(d):
    return d.first().asDict()


def test_paired_and_one_sample_t(df):
    d = DATA["x"] - DATA["y"]
    r = row(tstats.paired_t(df, "x", "y"))
    se = d.std(ddof=1) / math.sqrt(N)
    assert r["n"] == N and r["t"] == pytest.approx(d.mean() / se, rel=1e-12) and r["dz"] == pytest.approx(d.mean() / d.std(ddof=1), rel=1e-12)
    assert r["p"] == pytest.approx(dist.t_two_sided_np(r["t"], N - 1), rel=1e-10)
    assert row(tstats.one_sample_t(df, "x", 1.0))["mean_diff"] == pytest.approx(DATA["x"].mean() - 1)


def test_independent_t_pooled_and_welch(df):
    a, b = DATA["x"][::2], DATA["x"][1::2]
    r = row(tstats.independent_t(df, "x", "g", "a", "b"))
    sp = math.sqrt(((len(a) - 1) * a.var(ddof=1) + (len(b) - 1) * b.var(ddof=1)) / (N - 2))
    assert r["t"] == pytest.approx((a.mean() - b.mean()) / (sp * math.sqrt(1 / len(a) + 1 / len(b))), rel=1e-12) and r["d"] == pytest.approx((a.mean() - b.mean()) / sp)
    w = row(tstats.independent_t(df, "x", "g", "a", "b", welch=True))
    assert w["df"] < N - 2 and w["se"] == pytest.approx(math.sqrt(a.var(ddof=1) / len(a) + b.var(ddof=1) / len(b)))


def test_regression_and_partial_correlation(df, whole):
    z = np.column_stack([np.ones(N), DATA["x"], DATA["z"]])
    beta, sse, *_ = np.linalg.lstsq(z, DATA["y"], rcond=None)
    got = {r.term: r for r in tstats.ols(df, "y", ["x", "z"]).collect()}
    assert [got[t].b for t in ("intercept", "x", "z")] == pytest.approx(beta.tolist(), rel=1e-9)
    cov = np.linalg.inv(z.T @ z) * sse[0] / (N - 3)
    assert [got[t].se for t in ("intercept", "x", "z")] == pytest.approx(np.sqrt(np.diag(cov)).tolist(), rel=1e-9)
    p = row(tstats.partial_correlation(df, "x", "y", ["z"]))
    r = resample.evaluate(Recipe("association", "x", "y", "partial", "t", covariates=("z",)), DATA)
    s = resample.evaluate(Recipe("association", "x", "y", "semipartial", "t", covariates=("z",)), DATA)
    assert p["r"] == pytest.approx(r["estimate"], rel=1e-9) and p["semi_r"] == pytest.approx(s["estimate"], rel=1e-9) and p["p"] == pytest.approx(r["p_raw"], rel=1e-7)
    assert abs(p["r"] - p["semi_r"]) > 1e-4  # one must not stand for the other


def test_rank_deficient_designs_raise(whole):
    twice = whole.withColumn("z2", F.col("z") * 2)
    with pytest.raises(Exception, match="rank-deficient"):
        tstats.ols(twice, "y", ["z", "z2"]).collect()
    with pytest.raises(ValueError, match="rank-deficient"):
        resample.evaluate(Recipe("association", "x", "y", "partial", "t", covariates=("z", "z2")), DATA | {"z2": DATA["z"] * 2})


def test_trimmed_forms_agree_and_differ_from_each_other(whole):
    y = row(tstats.yuen_paired(whole, "x", "y", 0.2))
    t = row(tstats.trimmed_difference(whole, "x", "y", 0.2))
    ry = resample.evaluate(Recipe("paired", "x", "y", "yuen", "yuen", "yuen"), DATA)
    rt = resample.evaluate(Recipe("paired", "x", "y", "trimmed_difference", "yuen"), DATA)
    for a, b in ((y, ry), (t, rt)):
        assert (a["estimate"], a["se"], a["df"], a["p"]) == pytest.approx((b["estimate"], b["se"], b["df"], b["p_raw"]), rel=1e-9)
    assert abs(y["estimate"] - t["estimate"]) > 1e-6
    g = int(N * 0.2)
    s = np.sort(DATA["x"])
    m = row(ranked.trimmed_moments(whole, [], "x", 0.2))
    assert m["trimmed_mean"] == pytest.approx(s[g : N - g].mean()) and m["winsor_sd"] == pytest.approx(np.clip(DATA["x"], s[g], s[N - g - 1]).std(ddof=1))


def test_ranks_quantiles_and_ties(spark):
    values = [3.0, 1.0, 3.0, 3.0, 2.0, None, 1.0]
    df = spark.createDataFrame([(i, "k", v) for i, v in enumerate(values)] + [(9, None, 5.0)], "id bigint, g string, v double")
    got = {r.id: r.midrank for r in ranked.with_midrank(df, ["g"], "v").collect()}
    assert got == {0: 5.0, 1: 1.5, 2: 5.0, 3: 5.0, 4: 3.0, 5: None, 6: 1.5, 9: 1.0}
    assert resample.midranks(np.array([3.0, 1.0, 3.0, 3.0, 2.0, 1.0])).tolist() == [5.0, 1.5, 5.0, 5.0, 3.0, 1.5]
    q = {r.g: (r.a, r.b) for r in ranked.exact_quantiles(df, ["g"], "v", {"a": 0.25, "b": 0.9}).collect()}
    assert q["k"] == pytest.approx(tuple(np.quantile([3, 1, 3, 3, 2, 1], [0.25, 0.9]))) and q[None] == (5.0, 5.0)
    assert ranked.with_midrank(df.limit(0), ["g"], "v").count() == 0


def test_holm_against_the_definition(spark):
    p = [0.01, 0.04, 0.03, 0.005, 0.04, 0.5]
    df = spark.createDataFrame(list(enumerate(p)), "id bigint, p double")
    order = sorted(range(6), key=lambda i: (p[i], i))
    want, top = {}, 0.0
    for k, i in enumerate(order):
        top = max(top, (6 - k) * p[i])
        want[i] = min(1.0, top)
    assert {r.id: round(r.p_holm, 12) for r in ranked.holm(df, "p", "id").collect()} == {i: round(v, 12) for i, v in want.items()}
    assert {r.id: round(r.p_bonferroni, 12) for r in ranked.bonferroni(df, "p").collect()} == {i: round(min(1, 6 * v), 12) for i, v in enumerate(p)}


def test_tails_survive_and_quantiles_invert(spark):
    r = spark.range(1).select(
        *[f(F.lit(x), F.lit(d)).alias(n) for n, f, x, d in (("t", dist.t_two_sided, 40.0, 100.0), ("c", dist.chi2_upper, 3.0, 2.0))], dist.norm_upper(F.lit(10.0)).alias("z"), dist.norm_ppf(F.lit(0.975)).alias("q"),
        dist.f_upper(F.lit(2.0), F.lit(1.0), F.lit(10.0)).alias("f"), dist.t_two_sided(F.lit(2.0) ** 0.5, F.lit(10.0)).alias("tf"), dist.t_two_sided(F.lit(None).cast("double"), F.lit(3.0)).alias("none"),
    ).first()
    assert 0 < r.t < 1e-60 and r.c == pytest.approx(math.exp(-1.5)) and 0 < r.z < 1e-22 and r.q == pytest.approx(1.959964, abs=1e-6) and r.f == pytest.approx(r.tf) and r.none is None
    for p, d in ((0.975, 27.0), (0.6, 3.0), (0.01, 5.0)):
        assert dist.t_ppf(p, d) == pytest.approx(dist.quantile(spark, "t", p, d), rel=1e-8)
    assert dist.beta_ppf(0.3, 2, 5) == pytest.approx(dist.quantile(spark, "beta", 0.3, 2, 5), rel=1e-8)
    assert dist.clopper_pearson(0, 10)[0] == 0 and dist.clopper_pearson(10, 10)[1] == 1
    assert dist.noncentral_t_power(0.0, 30) == pytest.approx(0.05, abs=1e-4) and dist.noncentral_t_power(2.8, 60) == pytest.approx(0.79, abs=0.02)


def test_exact_signed_rank_and_sign_flips_by_enumeration():
    d = np.array([1.1, -0.4, 2.3, 0.7, -1.9, 3.2, 0.2])
    r = resample.midranks(np.abs(d))
    w = r[d > 0].sum()
    sums = [sum(s) for s in itertools.product(*[(0, x) for x in r])]
    low = min(w, r.sum() - w)
    assert resample.signed_rank_p(d) == pytest.approx(min(1, 2 * np.mean([s <= low for s in sums])))
    flips = [np.mean(np.array(s) * d) for s in itertools.product((1, -1), repeat=len(d))]
    recipe = Recipe("paired", "a", "b", "mean", "sign_flip")
    assert resample.sign_flip_p(d, recipe, np.random.default_rng(1)) == pytest.approx(np.mean(np.abs(flips) >= abs(d.mean()) - 1e-12))
    with pytest.raises(ValueError):
        resample.signed_rank_p(np.array([1.0, -1.0, 2.0]), exact_no_ties=True)


def test_bootstrap_blocks_do_not_change_the_stream(monkeypatch):
    r = Recipe("paired", "x", "y", "mean", "t", "percentile", bootstrap_draws=1000)
    one = resample.evaluate(r, DATA)
    monkeypatch.setattr(resample, "BLOCK_CELLS", 777)
    assert resample.evaluate(r, DATA) == one
    b = resample.evaluate(Recipe("paired", "x", "y", "mean", "t", "bca", bootstrap_draws=2000), DATA)
    assert b["ci_lower"] < b["estimate"] < b["ci_upper"]
    assert all(math.isnan(v) for v in resample.bca_interval(np.ones(10), 1.0, np.ones(5)))


def test_permutations_tell_their_methods_apart():
    base = dict(design="association", x="x", y="w", estimator="partial", covariates=("z",), null_draws=2000)
    data = DATA | {"w": np.sin(np.arange(N)) + 0.5 * DATA["z"] + 0.08 * DATA["x"]}
    fl = resample.evaluate(Recipe(test="freedman_lane", **base), data)["p_raw"]
    rp = resample.evaluate(Recipe(test="residual_permutation", **base), data)["p_raw"]
    t = resample.evaluate(Recipe(test="t", **base), data)["p_raw"]
    assert abs(fl - t) < 0.03 and abs(rp - t) < 0.03 and fl != rp


def test_recipes_do_not_depend_on_partitions_or_order(spark, whole):
    plans = {"m": Recipe("paired", "x", "y", "mean", "sign_flip", "percentile", null_draws=1000, bootstrap_draws=1000), "p": Recipe("association", "x", "y", "partial", "t", covariates=("z",), rank=True)}
    a = sorted(map(tuple, resample.run_recipes(whole.repartition(1), plans, "id", ["g"]).collect()))
    b = sorted(map(tuple, resample.run_recipes(whole.orderBy(F.desc("x")).repartition(3), plans, "id", ["g"]).collect()))
    assert a == b and len(a) == 4 and all(r[-1] is None for r in a)
    twice = resample.run_recipes(whole.unionByName(whole), plans, "id").collect()
    assert all("identities" in r.problem and r.estimate is None for r in twice)
    assert resample.run_recipes(whole.limit(0), plans, "id").count() == 0


def test_leave_one_out(whole):
    got = {r.id: r for r in resample.leave_one_out_means(whole, "id", "x", ["g"]).collect()}
    a = DATA["x"][::2]
    assert got[0].without == pytest.approx(np.delete(a, 0).mean()) and got[0].baseline == pytest.approx(a.mean())
    sizes = {r.omitted: r["count"] for r in resample.leave_one_out(whole, "id", 3).groupBy("omitted").count().collect()}
    assert sizes == {None: N, 0: N - 1, 1: N - 1, 2: N - 1}


def test_illegal_recipes():
    ok = dict(design="paired", x="a", y="b", estimator="mean", test="t")
    for bad in (
        {"test": "wilcoxon"}, {"interval": "fisher_z"}, {"covariates": ("z",)}, {"outliers": "studentized_residual_trim"}, {"adjustment": "holm"}, {"family": ("q",)}, {"trim": 0.5},
        {"adjustment": "fixed_threshold", "alpha": 0.2}, {"design": "nested"}, {"interval": "bca", "bootstrap_draws": 5},
    ):
        with pytest.raises(ValueError):
            Recipe(**(ok | bad))
    with pytest.raises(ValueError):
        Recipe("association", "x", "y", "semipartial", "residual_permutation")
    with pytest.raises(ValueError):
        Recipe("association", "x", "y", "partial", "t", "fisher_z", rank=True)
    with pytest.raises(ValueError):
        from_mapping(ok | {"surprise": 1})
    r = Recipe(**ok)
    assert from_json(to_json(r)) == r


def test_recipe_books_and_direct_plans(whole):
    book = RecipeBook(
        {"design": "paired", "x": "x", "y": "y", "estimator": "mean", "test": "t"}, {("est", "yuen"): {"estimator": "yuen", "test": "yuen"}, ("trim", "10"): {"trim": 0.1}}, (({"est": "yuen", "trim": "10"}, {"interval": "yuen"}),)
    )
    assert book.compile({"est": "yuen", "trim": "10"}) == Recipe("paired", "x", "y", "yuen", "yuen", "yuen", trim=0.1)
    clash = RecipeBook(book.base, {("a", "1"): {"trim": 0.1}, ("b", "1"): {"trim": 0.2}})
    with pytest.raises(ValueError, match="conflicting"):
        clash.compile({"a": "1", "b": "1"})
    assert canonical_family("Welch t") == "welch_t"
    with pytest.raises(ValueError):
        canonical_family("magic")
    with pytest.raises(ValueError):
        DirectPlan("paired_t", ("x",))
    for plan in (DirectPlan("paired_t", ("x", "y")), DirectPlan("one_sample_t", ("x",)), DirectPlan("welch_t", ("x",), "g", ("a", "b")), DirectPlan("correlation", ("x", "y")), DirectPlan("partial_correlation", ("x", "y"), covariates=("z",)), DirectPlan("linear_regression", ("y", "x"))):
        assert run_direct(whole, plan).count() >= 1
