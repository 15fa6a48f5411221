"""Orders over whole tables without one task for all rows.

Distinct keys are counted first (so repeated values cost one row), laid out in ranges of the
order, summed inside each range, and the ranges' totals (one row each) are added up.  Ranks, order
statistics, exact quantiles, trimming and step-down corrections all build on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestat.session import cut


def cumulative(df: DataFrame, by: list[str], order: list[str], weight: str, descending: bool = False) -> DataFrame:
    """``df`` with ``before``, the sum of ``weight`` over the rows of the same ``by`` before it, and ``total``.

    ``order`` must be total within ``by``.  Nulls order first.  The ranges are written to the shared folder, so that a
    lost executor cannot change them.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c).desc() if descending else F.col(c).asc() for c in order]
    ranged = cut(df.repartitionByRange(n, *[F.col(c) for c in by], *keys).withColumn("__pid", F.spark_partition_id()))
    inside = Window.partitionBy("__pid", *by).orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy(*by, "__pid").agg(F.sum(weight).alias("__sum"))
    over = Window.partitionBy(*by)  # one row for each range
    sums = sums.withColumn("__offset", F.coalesce(F.sum("__sum").over(over.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    sums = sums.withColumn("total", F.sum("__sum").over(over)).drop("__sum")
    out = ranged.withColumn("__in", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
    cond = F.col("r.__pid") == F.col("s.__pid")
    for c in by:
        cond = cond & F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}"))
    joined = out.alias("r").join(sums.alias("s"), cond)
    return joined.select(*[F.col(f"r.{c}") for c in df.columns], (F.col("__in") + F.col("__offset")).alias("before"), F.col("s.total").alias("total"))


def value_positions(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, value, ties, before, total of every distinct value that is not null."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("ties"))
    return cumulative(counts, by, [value], "ties")


def with_midrank(df: DataFrame, by: list[str], value: str, out: str = "midrank") -> DataFrame:
    """``df`` with the midrank of ``value`` within ``by``; null for null values."""
    ranks = value_positions(df, by, value).select(*[F.col(c).alias(f"__{c}") for c in by], F.col(value).alias("__v"), (F.col("before") + (F.col("ties") + 1) / 2).alias(out))
    cond = F.col(value) == F.col("__v")
    for c in by:
        cond = cond & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return df.join(ranks, cond, "left").select(*df.columns, out)


def order_statistics(df: DataFrame, by: list[str], value: str, positions: dict[str, Column]) -> DataFrame:
    """by, total, and the value at each position (from 0, an expression of ``total``)."""
    at = value_positions(df, by, value)
    aggs = [
        F.max(F.when((F.col("before") <= p) & (p < F.col("before") + F.col("ties")), F.col(value))).alias(name) for name, p in positions.items()
    ]
    return at.groupBy(*by).agg(F.max("total").alias("total"), *aggs)


def exact_quantiles(df: DataFrame, by: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """by, n and the type-7 quantiles of ``value`` by name.  Groups without values give no row."""
    positions = {}
    for name, p in probs.items():
        h = (F.col("total") - 1) * F.lit(p)
        positions[f"__lo_{name}"] = F.floor(h)
        positions[f"__hi_{name}"] = F.ceil(h)
    at = order_statistics(df, by, value, positions)
    out = []
    for name, p in probs.items():
        h = (F.col("total") - 1) * F.lit(p)
        lo, hi = F.col(f"__lo_{name}"), F.col(f"__hi_{name}")
        out.append((lo + (hi - lo) * (h - F.floor(h))).alias(name))
    return at.select(*by, F.col("total").alias("n"), *out)


def trimmed_moments(df: DataFrame, by: list[str], value: str, fraction: float) -> DataFrame:
    """by, n, h, trimmed_mean, winsor_sd: g = floor(n f) values are trimmed, or clipped, at each end.

    Computed from the counted distinct values: each contributes as often as it lies inside.
    """
    at = value_positions(df, by, value).withColumn("g", F.floor(F.col("total") * F.lit(fraction)))
    last = F.col("total") - F.col("g")
    kept = F.greatest(F.lit(0), F.least(F.col("before") + F.col("ties"), last) - F.greatest(F.col("before"), F.col("g")))
    at = at.withColumn("kept", kept)
    ends = at.groupBy(*by).agg(
        F.max("total").alias("n"),
        F.max("g").alias("g"),
        F.sum("kept").alias("h"),
        (F.sum(F.col("kept") * F.col(value)) / F.sum("kept")).alias("trimmed_mean"),
        F.min(F.when(F.col("kept") > 0, F.col(value))).alias("lo"),
        F.max(F.when(F.col("kept") > 0, F.col(value))).alias("hi"),
        # order statistics g and n - g - 1 are the least and the greatest value kept
        F.sum(F.when(F.col("kept") > 0, F.col("kept") * F.col(value) * F.col(value)).otherwise(0.0)).alias("__sxx"),
        F.sum(F.when(F.col("kept") > 0, F.col("kept") * F.col(value)).otherwise(0.0)).alias("__sx"),
    )
    sx = F.col("__sx") + F.col("g") * (F.col("lo") + F.col("hi"))
    sxx = F.col("__sxx") + F.col("g") * (F.col("lo") * F.col("lo") + F.col("hi") * F.col("hi"))
    var = (sxx - sx * sx / F.col("n")) / (F.col("n") - 1)
    return ends.select(*by, "n", "g", "h", "trimmed_mean", F.sqrt(F.greatest(var, F.lit(0.0))).alias("winsor_sd"), "lo", "hi")


def holm(df: DataFrame, p: str, key: str, by: list[str] | None = None) -> DataFrame:
    """``df`` with ``p_holm``: the running maximum of (m - i) p(i), at most 1, in the order of p then ``key``."""
    by = by or []
    ranked = cumulative(df.withColumn("__one", F.lit(1)), by, [p, key], "__one")
    raw = ranked.withColumn("__raw", (F.col("total") - F.col("before")) * F.col(p))
    # the running maximum over ranges: the maximum of each range before, then inside
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(raw.repartitionByRange(n, *[F.col(c) for c in by], F.col("before")).withColumn("__pid", F.spark_partition_id()))
    inside = Window.partitionBy("__pid", *by).orderBy("before").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tops = ranged.groupBy(*by, "__pid").agg(F.max("__raw").alias("__top"))
    tops = tops.withColumn("__floor", F.max("__top").over(Window.partitionBy(*by).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)))
    out = ranged.withColumn("__run", F.max("__raw").over(inside)).join(tops.drop("__top"), [*by, "__pid"])
    return out.select(*df.columns, F.least(F.lit(1.0), F.greatest("__run", "__floor")).alias("p_holm"))


def bonferroni(df: DataFrame, p: str, by: list[str] | None = None) -> DataFrame:
    """``df`` with ``p_bonferroni``."""
    by = by or []
    if by:
        m = df.groupBy(*by).agg(F.count("*").alias("__m"))
        return df.join(m, by).select(*df.columns, F.least(F.lit(1.0), F.col(p) * F.col("__m")).alias("p_bonferroni"))
    return df.withColumn("p_bonferroni", F.least(F.lit(1.0), F.col(p) * df.count()))


def fixed_threshold(p: Column, alpha: float) -> Column:
    """The p value rescaled so that ``alpha`` becomes .05."""
    if not 0 < alpha <= 0.05:
        raise ValueError("alpha must be in (0, .05]")
    return F.least(F.lit(1.0), p * (0.05 / alpha))
