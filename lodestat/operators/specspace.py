"""The space of specifications: factors and levels, compatible combinations, samples, ranks, sensitivity, influence."""

from __future__ import annotations

import hashlib
import random
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestat.functions.expr import round_half_up

#: Combinations that may be enumerated.
MAX_GRID = 200_000


def spec_grid(spark: SparkSession, factors: dict[str, list[str]], incompatible: list[tuple[str, str]] | None = None) -> DataFrame:
    """spec_id, position and one column for each factor: every combination without an incompatible pair.

    Pairs are named ``factor=level``.  The last factor varies fastest; ids keep the order of the grid.  More than
    MAX_GRID combinations are an error before any is made.
    """
    size = reduce(lambda a, b: a * b, map(len, factors.values()), 1)
    if size > MAX_GRID:
        raise ValueError(f"{size} combinations exceed {MAX_GRID}")
    grid, stride = spark.range(size).withColumnRenamed("id", "__i"), size
    for name, levels in factors.items():
        stride //= len(levels)
        index = F.pmod(F.floor(F.col("__i") / stride), F.lit(len(levels))).cast("int")
        grid = grid.withColumn(name, F.array(*[F.lit(v) for v in levels])[index])
    for a, b in incompatible or []:
        (fa, la), (fb, lb) = (tuple(x.split("=", 1)) for x in (a, b))
        if fa not in factors or fb not in factors:
            raise ValueError(f"unknown factor in {a} or {b}")
        grid = grid.where(~((F.col(fa) == la) & (F.col(fb) == lb)))
    from pyspark.sql import Window

    number = F.row_number().over(Window.orderBy("__i"))  # at most MAX_GRID rows
    return grid.withColumn("position", number).select(F.format_string("spec_%03d", "position").alias("spec_id"), F.col("position").cast("bigint").alias("position"), *factors)


def sample_specs(specs: list[dict[str, str]], cap: int, paper_id: str | None, first: str | None = None) -> list[str]:
    """At most ``cap`` ids in the order of the grid: the paper's own (``first``) if it is among them, then one for each level that none has yet, then more.

    All come from one order of the whole grid, shuffled by a seed from the paper's id, so a paper always runs the same ones.
    Levels are compared without case and outer blanks.
    """
    ids = [s["spec_id"] for s in specs]
    if len(ids) <= cap:
        return ids
    order = ids.copy()
    random.Random(int(hashlib.sha256((paper_id or "").encode()).hexdigest()[:16], 16)).shuffle(order)
    level_of = {s["spec_id"]: {k: str(v).strip().lower() for k, v in s.items() if k not in ("spec_id", "position")} for s in specs}
    chosen = [first] if first in level_of and cap > 0 else []
    for factor in level_of[ids[0]]:
        for level in dict.fromkeys(level_of[i][factor] for i in ids):
            if len(chosen) < cap and all(level_of[c][factor] != level for c in chosen):
                chosen += [i for i in order if level_of[i][factor] == level][:1]
    rest = [i for i in order if i not in set(chosen)]
    taken = {*chosen, *rest[: cap - len(chosen)]}
    return [i for i in ids if i in taken]


def active_dimensions(specs: DataFrame, factors: list[str]) -> DataFrame:
    """factor, n_levels, active: whether more than one level occurs."""
    counts = specs.agg(*[F.countDistinct(f).alias(f) for f in factors])
    rows = F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f).alias("n_levels")) for f in factors])
    return counts.select(F.inline(rows)).withColumn("active", F.col("n_levels") > 1)


def curve_rank(results: DataFrame, by: list[str], estimate: str, reported: Column, precision: int, p: str | None = None, alpha: float = 0.05) -> DataFrame:
    """Where the reported value lies among the estimates, at printed precision.

    by, n, below, above, tied, rank, rank_high, extremeness (null if all are tied), same_sign and, with p, significant.
    The median holds a group's distinct estimates: a curve has at most MAX_GRID.
    """
    shown, target = round_half_up(F.col(estimate), precision), round_half_up(reported, precision)
    rows = results.where(F.col(estimate).isNotNull())
    aggs = [
        F.count("*").alias("n"), F.count_if(shown < target).alias("below"), F.count_if(shown > target).alias("above"), F.count_if(shown == target).alias("tied"),
        F.avg((F.signum(estimate) == F.signum(reported)).cast("double")).alias("same_sign"), F.median(estimate).alias("median_estimate"),
    ]
    if p:
        aggs.append(F.avg((F.col(p) < alpha).cast("double")).alias("significant"))
    a = rows.groupBy(*by).agg(*aggs)
    extreme = F.least(F.col("below"), F.col("above")) / F.col("n")
    extra = ["significant"] if p else []
    return a.select(
        *by, "n", "below", "above", "tied", (F.col("below") + 1).alias("rank"), (F.col("n") - F.col("above")).alias("rank_high"),
        F.when(F.col("tied") < F.col("n"), extreme).alias("extremeness"), "same_sign", "median_estimate", *extra,
    )


def sensitivity(results: DataFrame, by: list[str], estimate: str, p: str, null: float = 0.0, alpha: float = 0.05) -> DataFrame:
    """by, n, min, max, median, n_positive, n_negative, p_min, p_max, n_significant of converged estimates.

    The median holds a group's distinct estimates: a group is one curve of at most MAX_GRID specifications.
    """
    e = F.col(estimate)
    return results.where(e.isNotNull()).groupBy(*by).agg(
        F.count("*").alias("n"), F.min(e).alias("min_estimate"), F.max(e).alias("max_estimate"), F.median(e).alias("median_estimate"),
        F.count_if(e > null).alias("n_positive"), F.count_if(e < null).alias("n_negative"), F.min(p).alias("p_min"), F.max(p).alias("p_max"), F.count_if(F.col(p) < alpha).alias("n_significant"),
    )


def matched_sets(results: DataFrame, factors: list[str], values: list[str], by: list[str] | None = None) -> DataFrame:
    """factor, n_sets and the largest span of each value among specifications that differ in that factor alone."""
    by, parts = by or [], []
    for f in factors:
        others = [g for g in factors if g != f]
        spans = results.groupBy(*by, *others).agg(*[(F.max(v) - F.min(v)).alias(v) for v in values], F.count("*").alias("__n")).where("__n > 1")
        parts.append(spans.groupBy(*by).agg(F.count("*").alias("n_sets"), *[F.max(v).alias(f"max_change_{v}") for v in values]).select(*by, F.lit(f).alias("factor"), "n_sets", *[f"max_change_{v}" for v in values]))
    return reduce(lambda a, b: a.unionByName(b), parts)


def influence_summary(changes: DataFrame, by: list[str], key: str) -> DataFrame:
    """by, n, max_change, most_influential (ties: the smallest key), n_sign_flips from leave-one-out means."""
    size = F.abs("change")
    return changes.groupBy(*by).agg(
        F.count("*").alias("n"), F.max(size).alias("max_change"), F.max_by(key, F.struct(size, -F.col(key))).alias("most_influential"),
        F.count_if(F.signum("without") != F.signum("baseline")).alias("n_sign_flips"),
    )


def spec_order(results: DataFrame, by: list[str], estimate: str, key: str) -> DataFrame:
    """``results`` with ``spec_rank``: the position of each estimate in its curve."""
    from lodestat.operators.ranked import cumulative

    ranked = cumulative(results.withColumn("__one", F.lit(1)), by, [estimate, key], "__one")
    return ranked.select(*results.columns, (F.col("before") + 1).alias("spec_rank"))
