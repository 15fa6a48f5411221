"""Samples: declared filters, identifiers, strict parsing, scoring and outlier rules."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestat.functions.distributions import quantile
from lodestat.functions.expr import blank_to_null, finite, is_close, nan_to_null, strict_number
from lodestat.operators.ranked import cumulative, exact_quantiles

NUMERIC = ("double", "float", "int", "bigint", "smallint", "tinyint")


@dataclass(frozen=True)
class Predicate:
    """A row filter: ``eq``, ``ne`` or ``not_missing``; missing rows never pass."""

    column: str
    operator: str
    value: object = None

    def __post_init__(self) -> None:
        if self.operator not in ("eq", "ne", "not_missing"):
            raise ValueError(f"unknown operator {self.operator}")


def _known(df: DataFrame, column: str) -> Column:
    kind = dict(df.dtypes)[column]
    if kind in ("double", "float"):
        return nan_to_null(F.col(column))
    return blank_to_null(F.col(column)) if kind == "string" else F.col(column)


def row_filter(df: DataFrame, predicates: list[Predicate]) -> DataFrame:
    """Rows that pass all predicates; blank text and NaN are missing, literals become numbers for numeric columns."""
    kinds = dict(df.dtypes)

    def one(p: Predicate) -> Column:
        c = _known(df, p.column)
        if p.operator == "not_missing":
            return c.isNotNull()
        value = F.lit(float(p.value)) if kinds[p.column] in NUMERIC else F.lit(str(p.value))
        return c == value if p.operator == "eq" else c != value

    return df.where(reduce(lambda a, b: a & b, map(one, predicates), F.lit(True)))


def id_sample(df: DataFrame, key: str, ids: DataFrame, id_column: str) -> DataFrame:
    """Rows whose key is listed.  Listed ids must be unique and all present, and keys unique among them."""
    repeated = ids.groupBy(id_column).count().where("count > 1").limit(1).count()
    absent = ids.join(df, ids[id_column] == df[key], "left_anti").limit(1).count()
    kept = df.join(ids.select(F.col(id_column).alias("__id")), F.col(key) == F.col("__id"), "left_semi")
    twice = kept.groupBy(key).count().where("count > 1").limit(1).count()
    if repeated or absent or twice:
        raise ValueError("ids must be unique and present exactly once")
    return kept


def complete_cases(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows without a missing value (null, NaN or blank) in the columns."""
    return df.where(reduce(lambda a, b: a & b, [_known(df, c).isNotNull() for c in columns], F.lit(True)))


def parse_numbers(df: DataFrame, columns: list[str], blank_missing: bool = False) -> DataFrame:
    """Text columns as strict numbers, numeric columns as finite doubles."""
    kinds = dict(df.dtypes)
    parsed = {c: strict_number(F.col(c), blank_missing) if kinds[c] == "string" else finite(F.col(c).cast("double")) for c in columns}
    return df.withColumns(parsed)


def rescore(df: DataFrame, items: list[str], total: str, mode: str = "deposited", tolerance: float = 1e-9, min_fraction: float = 0.5) -> DataFrame:
    """``total`` rescored from its items.

    ``prorate`` puts the mean of the items that are whole numbers times their number in place of the total, if enough of
    them are; ``exclude_flagged`` drops rows with an item that is none; ``deposited`` keeps all.  The deposited total
    must be the sum of its items.
    """
    if mode not in ("deposited", "prorate", "exclude_flagged"):
        raise ValueError(mode)
    if mode == "deposited":
        return df
    k = len(items)
    cells = F.array(*[F.col(c).cast("double") for c in items])
    summed = F.aggregate(cells, F.lit(0.0), lambda s, x: s + x)
    checked = df.where(F.when(is_close(summed, F.col(total), 1e-7, 1e-6), True).otherwise(F.raise_error(F.lit("items do not add up")).cast("boolean")))
    good = F.filter(cells, lambda x: F.abs(x - F.rint(x)) <= tolerance)
    if mode == "exclude_flagged":
        return checked.where(F.size(good) == k)
    mean = F.aggregate(good, F.lit(0.0), lambda s, x: s + x) / F.size(good)
    return checked.where(F.size(good) >= math.ceil(k * min_fraction)).withColumn(total, mean * k)


def _bounded(df: DataFrame, by: list[str], value: str, bounds: DataFrame) -> DataFrame:
    """Rows of ``df`` inside lo..hi of their group; ``bounds`` has a row for each group."""
    b = bounds.select(*[F.col(c).alias(f"__{c}") for c in by], "__lo", "__hi")
    cond = F.lit(True)
    for c in by:
        cond = cond & F.col(c).eqNullSafe(F.col(f"__{c}"))
    if not by:  # one row
        lo, hi = (bounds.select("__lo", "__hi").first() or (None, None))[:2]
        return df.where((F.col(value) >= F.lit(lo)) & (F.col(value) <= F.lit(hi)))
    return df.join(b, cond).where((F.col(value) >= F.col("__lo")) & (F.col(value) <= F.col("__hi"))).select(*df.columns)


def outliers_sd(df: DataFrame, value: str, k: float, by: list[str] | None = None) -> DataFrame:
    """Rows within k standard deviations of the mean of their group."""
    by = by or []
    m, s = F.avg(value), F.stddev_samp(value)
    return _bounded(df, by, value, df.groupBy(*by).agg((m - k * s).alias("__lo"), (m + k * s).alias("__hi")))


def outliers_iqr(df: DataFrame, value: str, k: float, by: list[str] | None = None) -> DataFrame:
    """Rows within Tukey's fences of their group, with type-7 quartiles."""
    by = by or []
    q = exact_quantiles(df, by, value, {"q1": 0.25, "q3": 0.75})
    width = F.col("q3") - F.col("q1")
    return _bounded(df, by, value, q.select(*by, (F.col("q1") - k * width).alias("__lo"), (F.col("q3") + k * width).alias("__hi")))


def outliers_mad(df: DataFrame, value: str, k: float, by: list[str] | None = None) -> DataFrame:
    """Rows within k times 1.4826 median absolute deviations of the median of their group."""
    by = by or []
    med = exact_quantiles(df, by, value, {"med": 0.5}).drop("n")
    if by:
        away = df.join(med, by).withColumn("__away", F.abs(F.col(value) - F.col("med")))
    else:
        away = df.withColumn("med", F.lit(med.first()["med"])).withColumn("__away", F.abs(F.col(value) - F.col("med")))
    mad = exact_quantiles(away, by, "__away", {"mad": 0.5}).drop("n")
    limits = med.join(mad, by) if by else mad.withColumn("med", F.lit(med.first()["med"]))
    reach = F.col("mad") * (1.4826 * k)
    return _bounded(df, by, value, limits.select(*by, (F.col("med") - reach).alias("__lo"), (F.col("med") + reach).alias("__hi")))


def outliers_mahalanobis(df: DataFrame, columns: list[str], probability: float) -> DataFrame:
    """Rows whose squared Mahalanobis distance is at most the chi-squared quantile.  Singular covariance is an error."""
    import numpy as np

    aggs = [F.avg(c) for c in columns] + [F.covar_samp(a, b) for a in columns for b in columns]
    row = df.agg(*aggs).first()  # one row of p + p * p numbers
    p = len(columns)
    mean, cov = np.array(row[:p], float), np.array(row[p:], float).reshape(p, p)
    if not np.isfinite(cov).all() or np.linalg.matrix_rank(cov) < p:
        raise ValueError("singular covariance")
    inverse = np.linalg.inv(cov)
    d2 = F.lit(0.0)
    for i, a in enumerate(columns):
        for j, b in enumerate(columns):
            d2 = d2 + (F.col(a) - float(mean[i])) * (F.col(b) - float(mean[j])) * float(inverse[i, j])
    return df.where(d2 <= quantile(df.sparkSession, "chi2", probability, p))


def outliers_residual(df: DataFrame, outcome: str, predictor: str, covariates: list[str], fraction: float, tie: str) -> DataFrame:
    """Drops the ceil(fraction n) rows of the largest internally studentised residual.

    The score of a row is the larger of its two from the regressions of outcome and of predictor on the covariates,
    rounded to 12 decimals; ties go by the column ``tie``.  Normal equations come from one aggregation, leverages
    and residuals are expressions.
    """
    import numpy as np

    z = [F.lit(1.0), *[F.col(c).cast("double") for c in covariates]]
    k = len(z)
    aggs = [F.sum(z[i] * z[j]) for i in range(k) for j in range(k)]
    for v in (outcome, predictor):
        aggs += [F.sum(z[i] * F.col(v)) for i in range(k)] + [F.sum(F.col(v) * F.col(v))]
    row = df.agg(F.count("*"), *aggs).first()
    n, flat = row[0], np.array(row[1:], float)
    zz = flat[: k * k].reshape(k, k)
    if np.linalg.matrix_rank(zz) < k:
        raise ValueError("rank-deficient design")
    inverse = np.linalg.inv(zz)
    lever = reduce(lambda a, b: a + b, [z[i] * z[j] * float(inverse[i, j]) for i in range(k) for j in range(k)])
    scores, at = [], k * k
    for v in (outcome, predictor):
        zv, vv = flat[at : at + k], flat[at + k]
        at += k + 1
        beta = inverse @ zv
        s = math.sqrt(max(0.0, (vv - beta @ zv) / (n - k)))
        residual = F.col(v) - reduce(lambda a, b: a + b, [z[i] * float(beta[i]) for i in range(k)])
        scores.append(F.abs(residual) / (s * F.sqrt(1 - lever)))
    scored = df.withColumns({"__score": -F.round(F.greatest(*scores), 12), "__one": F.lit(1)})
    ranked = cumulative(scored, [], ["__score", tie], "__one")  # largest scores first, without one task for all rows
    return ranked.where(F.col("before") >= math.ceil(fraction * n)).select(*df.columns)
