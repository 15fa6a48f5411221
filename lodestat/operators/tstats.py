"""Classical and robust tests from aggregates: each group is one row of moments, never a collected sample."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestat.functions.distributions import chi2_upper, f_upper, t_tail, t_two_sided
from lodestat.functions.expr import nan_to_null
from lodestat.operators.ranked import trimmed_moments, with_midrank


def paired_t(df: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    """by, n, mean_diff, se, df, t, dz, p of the differences x - y over complete pairs."""
    d = nan_to_null(F.col(x).cast("double")) - nan_to_null(F.col(y).cast("double"))
    a = df.groupBy(*(by or [])).agg(F.count(d).alias("n"), F.avg(d).alias("mean_diff"), F.stddev_samp(d).alias("__sd"))
    return _one_sample(a, by or []).select(*(by or []), "n", "mean_diff", "se", "df", "t", F.col("d").alias("dz"), "p")


def one_sample_t(df: DataFrame, x: str, mu: float, by: list[str] | None = None) -> DataFrame:
    """by, n, mean_diff, se, df, t, d, p against ``mu``."""
    v = nan_to_null(F.col(x).cast("double"))
    a = df.groupBy(*(by or [])).agg(F.count(v).alias("n"), (F.avg(v) - mu).alias("mean_diff"), F.stddev_samp(v).alias("__sd"))
    return _one_sample(a, by or []).select(*(by or []), "n", "mean_diff", "se", "df", "t", "d", "p")


def _one_sample(a: DataFrame, by: list[str]) -> DataFrame:
    se = F.col("__sd") / F.sqrt("n")
    t = F.col("mean_diff") / F.nullif(se, F.lit(0.0))
    a = a.select(*by, "n", "mean_diff", se.alias("se"), (F.col("n") - 1).cast("double").alias("df"), t.alias("t"), (F.col("mean_diff") / F.nullif(F.col("__sd"), F.lit(0.0))).alias("d"))
    return a.withColumn("p", t_two_sided(F.col("t"), F.col("df")))


def independent_t(df: DataFrame, value: str, group: str, a: object, b: object, by: list[str] | None = None, welch: bool = False) -> DataFrame:
    """by, n_a, n_b, mean_diff, se, df, t, d, p of group ``a`` against ``b``; d uses the pooled standard deviation."""
    by = by or []
    v = nan_to_null(F.col(value).cast("double"))
    va, vb = F.when(F.col(group) == F.lit(a), v), F.when(F.col(group) == F.lit(b), v)
    m = df.where(F.col(group).isin(a, b)).groupBy(*by).agg(
        F.count(va).alias("n_a"), F.count(vb).alias("n_b"), (F.avg(va) - F.avg(vb)).alias("mean_diff"), F.var_samp(va).alias("__va"), F.var_samp(vb).alias("__vb")
    )
    na, nb = F.col("n_a"), F.col("n_b")
    pooled = ((na - 1) * F.col("__va") + (nb - 1) * F.col("__vb")) / (na + nb - 2)
    if welch:
        ea, eb = F.col("__va") / na, F.col("__vb") / nb
        se, dof = F.sqrt(ea + eb), (ea + eb) ** 2 / (ea**2 / (na - 1) + eb**2 / (nb - 1))
    else:
        se, dof = F.sqrt(pooled * (1 / na + 1 / nb)), (na + nb - 2).cast("double")
    m = m.select(*by, "n_a", "n_b", "mean_diff", se.alias("se"), dof.alias("df"), (F.col("mean_diff") / F.sqrt(pooled)).alias("d"))
    m = m.withColumn("t", F.col("mean_diff") / F.col("se"))
    return m.select(*by, "n_a", "n_b", "mean_diff", "se", "df", "t", "d", t_two_sided(F.col("t"), F.col("df")).alias("p"))


def correlation(df: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    """by, n, r, df, t, p of Pearson's correlation over complete pairs."""
    by = by or []
    a, b = nan_to_null(F.col(x).cast("double")), nan_to_null(F.col(y).cast("double"))
    rows = df.where(a.isNotNull() & b.isNotNull())
    m = rows.groupBy(*by).agg(F.count("*").alias("n"), F.corr(a, b).alias("r")).withColumn("df", (F.col("n") - 2).cast("double"))
    m = m.withColumn("t", F.col("r") * F.sqrt(F.col("df") / (1 - F.col("r") * F.col("r"))))
    return m.withColumn("p", t_two_sided(F.col("t"), F.col("df")))


def likelihood_ratio(df: DataFrame, full: str, reduced: str, df_per_row: int, by: list[str] | None = None) -> DataFrame:
    """by, n, chi2, df, p of nested log likelihoods; a full one below its reduced one is an error."""
    by = by or []
    gain = F.col(full) - F.col(reduced)
    safe = F.when(gain >= -1e-8, gain).otherwise(F.raise_error(F.lit("the full model fits worse")).cast("double"))
    m = df.where(gain.isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), (2 * F.sum(safe)).alias("chi2"))
    m = m.withColumn("df", F.col("n") * df_per_row)
    return m.withColumn("p", chi2_upper(F.col("chi2"), F.col("df")))


def family(members: dict[str, DataFrame], by: list[str] | None = None) -> DataFrame:
    """The rows of several tests as one family, each with its member's name."""
    parts = [df.withColumn("member", F.lit(name)) for name, df in members.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _moments(df: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """by, n and the upper triangle of X'X with an intercept, as one array."""
    cells = [F.lit(1.0), *[nan_to_null(F.col(c).cast("double")) for c in columns]]
    rows = df.where(reduce(lambda a, b: a & b, [c.isNotNull() for c in cells]))
    k = len(cells)
    sums = [F.sum(cells[i] * cells[j]) for i in range(k) for j in range(i, k)]
    return rows.groupBy(*by).agg(F.array(*sums).alias("xx"))


def _unpack(flat: np.ndarray, k: int) -> np.ndarray:
    m = np.zeros((k, k))
    m[np.triu_indices(k)] = flat
    return m + np.triu(m, 1).T


def _centred(xx: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    n = xx[0, 0]
    mean = xx[0, 1:] / n
    return n, mean, xx[1:, 1:] - n * np.outer(mean, mean)


def ols(df: DataFrame, outcome: str, predictors: list[str], by: list[str] | None = None) -> DataFrame:
    """by, term, n, b, se, t, beta, df, r2, f, p, p_f: least squares with intercept and classical errors.

    One aggregation gives the moments; each group's small system is solved from them.  A design without full rank is
    an error.
    """
    by = by or []
    k = len(predictors)
    width = k + 2
    kinds = [f"`{c}` {dict(df.dtypes)[c]}" for c in by]

    def solve(batches):
        for batch in batches:
            rows = []
            for i, flat in enumerate(batch["xx"]):
                n, mean, s = _centred(_unpack(np.asarray(flat, float), width))
                sxx, sxy, syy = s[:k, :k], s[:k, k], s[k, k]
                if np.linalg.matrix_rank(sxx) < k:
                    raise ValueError("rank-deficient design")
                inverse = np.linalg.inv(sxx)
                b = inverse @ sxy
                dof = n - k - 1
                sse = syy - b @ sxy
                sigma2 = sse / dof
                f = ((syy - sse) / k) / sigma2
                b0 = mean[k] - b @ mean[:k]
                se0 = np.sqrt(sigma2 * (1 / n + mean[:k] @ inverse @ mean[:k]))
                head = tuple(batch[c].iloc[i] for c in by)
                terms = [("intercept", b0, se0, None), *zip(predictors, b, np.sqrt(sigma2 * np.diag(inverse)), b * np.sqrt(np.diag(sxx) / syy))]
                rows += [(*head, t, int(n), float(x), float(e), float(x / e), None if z is None else float(z), float(dof), float(1 - sse / syy), float(f)) for t, x, e, z in terms]
            yield pd.DataFrame(rows, columns=[*by, "term", "n", "b", "se", "t", "beta", "df", "r2", "f"])

    schema = ", ".join([*kinds, "term string, n bigint, b double, se double, t double, beta double, df double, r2 double, f double"])
    out = _moments(df, [*predictors, outcome], by).mapInPandas(solve, schema)
    return out.withColumn("p", t_two_sided(F.col("t"), F.col("df"))).withColumn("p_f", f_upper(F.col("f"), F.lit(k), F.col("df")))


def partial_correlation(df: DataFrame, x: str, y: str, covariates: list[str], by: list[str] | None = None) -> DataFrame:
    """by, n, r, semi_r, df, t, p of x and y given the covariates.

    ``semi_r`` correlates y itself with the rest of x.  A design without full rank is an error.
    """
    by = by or []
    k = len(covariates)
    kinds = [f"`{c}` {dict(df.dtypes)[c]}" for c in by]

    def solve(batches):
        for batch in batches:
            rows = []
            for i, flat in enumerate(batch["xx"]):
                n, _, s = _centred(_unpack(np.asarray(flat, float), k + 3))
                if k:
                    szz, sz = s[:k, :k], s[:k, k:]
                    if np.linalg.matrix_rank(szz) < k:
                        raise ValueError("rank-deficient design")
                    rest = s[k:, k:] - sz.T @ np.linalg.solve(szz, sz)
                else:
                    rest = s
                r = rest[0, 1] / np.sqrt(rest[0, 0] * rest[1, 1])
                semi = rest[0, 1] / np.sqrt(rest[0, 0] * s[k + 1, k + 1])
                rows.append((*[batch[c].iloc[i] for c in by], int(n), float(r), float(semi), float(n - k - 2)))
            yield pd.DataFrame(rows, columns=[*by, "n", "r", "semi_r", "df"])

    out = _moments(df, [*covariates, x, y], by).mapInPandas(solve, ", ".join([*kinds, "n bigint, r double, semi_r double, df double"]))
    out = out.withColumn("t", F.col("r") * F.sqrt(F.col("df") / (1 - F.col("r") * F.col("r"))))
    return out.withColumn("p", t_two_sided(F.col("t"), F.col("df")))


def trimmed_difference(df: DataFrame, x: str, y: str, fraction: float, by: list[str] | None = None, alternative: str = "two-sided") -> DataFrame:
    """by, n, h, estimate, se, df, t, p: the trimmed mean of the paired differences with its winsorised error."""
    by = by or []
    d = df.withColumn("__d", nan_to_null(F.col(x).cast("double")) - nan_to_null(F.col(y).cast("double")))
    m = trimmed_moments(d, by, "__d", fraction)
    return _trimmed_test(m, by, alternative)


def trimmed_mean_test(df: DataFrame, value: str, fraction: float, by: list[str] | None = None) -> DataFrame:
    """by, n, h, estimate, se, df, t, p of a trimmed mean against zero."""
    return _trimmed_test(trimmed_moments(df, by or [], value, fraction), by or [], "two-sided")


def _trimmed_test(m: DataFrame, by: list[str], alternative: str) -> DataFrame:
    n, h = F.col("n"), F.col("h")
    se = F.col("winsor_sd") * F.sqrt((n - 1) / (h * (h - 1)))
    m = m.where(h >= 3).select(*by, "n", "h", F.col("trimmed_mean").alias("estimate"), se.alias("se"), (h - 1).cast("double").alias("df"))
    m = m.withColumn("t", F.col("estimate") / F.col("se"))
    return m.withColumn("p", t_tail(F.col("t"), F.col("df"), alternative))


def trimmed_independent(df: DataFrame, value: str, group: str, a: object, b: object, fraction: float, by: list[str] | None = None, pooled: bool = False) -> DataFrame:
    """by, estimate, se, df, t, p of the difference of two groups' trimmed means (Yuen, or pooled)."""
    by = by or []
    m = trimmed_moments(df.where(F.col(group).isin(a, b)), [*by, group], value, fraction).where(F.col("h") >= 3)
    v = F.col("winsor_sd") * F.col("winsor_sd") * (F.col("n") - 1) / (F.col("h") * (F.col("h") - 1))
    m = m.withColumn("v", v)

    def of(c: str, g: object) -> Column:
        return F.max(F.when(F.col(group) == F.lit(g), F.col(c)))

    w = m.groupBy(*by).agg(*[of(c, g).alias(f"{c}_{s}") for c in ("trimmed_mean", "v", "h") for g, s in ((a, "a"), (b, "b"))])
    va, vb, ha, hb = (F.col(c) for c in ("v_a", "v_b", "h_a", "h_b"))
    if pooled:
        common = ((ha - 1) * va * ha + (hb - 1) * vb * hb) / (ha + hb - 2)
        se, dof = F.sqrt(common * (1 / ha + 1 / hb)), (ha + hb - 2).cast("double")
    else:
        se, dof = F.sqrt(va + vb), (va + vb) ** 2 / (va**2 / (ha - 1) + vb**2 / (hb - 1))
    w = w.select(*by, (F.col("trimmed_mean_a") - F.col("trimmed_mean_b")).alias("estimate"), se.alias("se"), dof.alias("df")).withColumn("t", F.col("estimate") / F.col("se"))
    return w.withColumn("p", t_two_sided(F.col("t"), F.col("df")))


def yuen_paired(df: DataFrame, x: str, y: str, fraction: float, by: list[str] | None = None) -> DataFrame:
    """by, n, h, estimate, se, df, t, p: marginal trimmed means with the error of the winsorised pairs."""
    by = by or []
    a, b = nan_to_null(F.col(x).cast("double")), nan_to_null(F.col(y).cast("double"))
    rows = df.where(a.isNotNull() & b.isNotNull()).select(*by, a.alias("__x"), b.alias("__y"))
    mx = trimmed_moments(rows, by, "__x", fraction).select(*by, "n", "h", F.col("trimmed_mean").alias("tx"), F.col("lo").alias("lox"), F.col("hi").alias("hix"))
    my = trimmed_moments(rows, by, "__y", fraction).select(*by, F.col("trimmed_mean").alias("ty"), F.col("lo").alias("loy"), F.col("hi").alias("hiy"))
    if by:
        limits = mx.join(my, by)
        wide = rows.join(limits, by)
    else:
        one = {**mx.first().asDict(), **my.first().asDict()}
        wide = rows.withColumns({k: F.lit(v) for k, v in one.items()})
    clipped = F.least(F.greatest("__x", "lox"), F.col("hix")) - F.least(F.greatest("__y", "loy"), F.col("hiy"))
    m = wide.groupBy(*by, "n", "h", "tx", "ty").agg(F.stddev_samp(clipped).alias("sd"))
    n, h = F.col("n"), F.col("h")
    m = m.select(*by, "n", "h", (F.col("tx") - F.col("ty")).alias("estimate"), (F.col("sd") * F.sqrt((n - 1) / (h * (h - 1)))).alias("se"), (h - 1).cast("double").alias("df"))
    m = m.withColumn("t", F.col("estimate") / F.col("se"))
    return m.withColumn("p", t_two_sided(F.col("t"), F.col("df")))


def rank_biserial(df: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    """by, n, estimate: the signed share of the midranks of the differences, zeros dropped."""
    by = by or []
    d = df.select(*by, (nan_to_null(F.col(x).cast("double")) - nan_to_null(F.col(y).cast("double"))).alias("__d")).where("__d <> 0").withColumn("__abs", F.abs("__d"))
    r = with_midrank(d, by, "__abs")
    return r.groupBy(*by).agg(F.count("*").alias("n"), (F.sum(F.col("midrank") * F.signum("__d")) / F.sum("midrank")).alias("estimate"))


def spearman(df: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    """by, n, r, df, t, p of Pearson's correlation of the midranks."""
    by = by or []
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, F.col(x).alias("__x"), F.col(y).alias("__y"))
    return correlation(with_midrank(with_midrank(rows, by, "__x", "rx"), by, "__y", "ry"), "rx", "ry", by)
