"""Descriptive readouts and column profiles."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestat.functions.expr import finite
from lodestat.operators.sample import Predicate, _known, row_filter

_THRESHOLD = re.compile(r"\s*(>=|<=|>|<|==|=)\s*([+-]?\d+(?:\.\d+)?)\s*$")
OPERATIONS = ("n", "count_category", "count_missing", "count_threshold", "mean", "sd", "min", "max", "mean_columns", "cronbach_alpha")


def threshold(c: Column, rule: str) -> Column:
    """A comparison such as ``>=2`` as a condition."""
    m = _THRESHOLD.match(rule)
    if m is None:
        raise ValueError(f"no threshold: {rule}")
    op, x = m[1], F.lit(float(m[2]))
    return {">=": c >= x, "<=": c <= x, ">": c > x, "<": c < x, "==": c == x, "=": c == x}[op]


def readout(
    df: DataFrame, operation: str, columns: list[str] | None = None, *, by: list[str] | None = None, filters: list[Predicate] | None = None,
    category: object = None, rule: str | None = None, reverse: list[str] | None = None, multiplier: int = 1,
) -> DataFrame:
    """``by``, value and n of one readout; counts with a multiplier of 100 are per cent of n.

    Missing cells are null, NaN or blank; an infinite cell is an error.  ``mean_columns`` pools the cells of several columns, its
    n being the rows with any cell; ``cronbach_alpha`` takes complete cases, reversed items negated.
    """
    if operation not in OPERATIONS:
        raise ValueError(operation)
    if multiplier not in (1, 100):
        raise ValueError("the multiplier is 1 or 100")
    columns, by = columns or [], by or []
    rows = row_filter(df, filters or [])
    kinds = dict(rows.dtypes)
    cells = [finite(F.col(c).cast("double")) if kinds[c] != "string" else F.col(c) for c in columns]
    n = F.count("*")
    if operation == "n":
        value = n.cast("double")
    elif operation == "count_category":
        literal = F.lit(str(category)) if kinds[columns[0]] == "string" else F.lit(float(category))
        value = F.count_if(cells[0] == literal).cast("double")
    elif operation == "count_missing":
        value = F.count_if(_known(rows, columns[0]).isNull()).cast("double")
    elif operation == "count_threshold":
        value = F.count_if(threshold(cells[0], rule or "")).cast("double")
    elif operation in ("mean", "sd", "min", "max"):
        value = {"mean": F.avg, "sd": F.stddev_samp, "min": F.min, "max": F.max}[operation](cells[0])
        n = F.count(cells[0])
    elif operation == "mean_columns":
        total = reduce(lambda a, b: a + b, [F.coalesce(F.sum(c), F.lit(0.0)) for c in cells])
        number = reduce(lambda a, b: a + b, [F.count(c) for c in cells])
        value, n = total / F.nullif(number, F.lit(0)), F.count(F.coalesce(*cells))
    else:
        signed = [-c if name in (reverse or []) else c for name, c in zip(columns, cells)]
        whole = reduce(lambda a, b: a + b, signed)
        rows = rows.where(whole.isNotNull())
        k = len(columns)
        parts = reduce(lambda a, b: a + b, [F.var_samp(c) for c in signed])
        value = F.lit(k / (k - 1)) * (1 - parts / F.var_samp(whole))
    if multiplier == 100 and operation.startswith("count"):
        value = value / F.nullif(n, F.lit(0)) * 100
    elif multiplier == 100:
        value = value * 100
    return rows.groupBy(*by).agg(value.alias("value"), n.alias("n"))


def profile_table(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row for each column: n, missing, distinct, min, max, mean, sd, skewness (bias-corrected).

    One scan counts the distinct values of all columns; everything else follows from the counts.
    """
    kinds = dict(df.dtypes)
    none = F.lit(None).cast("double")
    cells = [(c, _known(df, c), kinds[c] != "string") for c in columns]
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), (v.cast("double") if number else none).alias("x"), v.cast("string").alias("v")) for c, v, number in cells])
    counts = df.select(F.inline(pairs)).groupBy("column_name", "x", "v").agg(F.count("*").alias("n"))
    named = counts.withColumn("w", F.when(F.col("x").isNotNull(), F.col("n")))
    sums = [F.sum(F.col("w") * F.pow("x", F.lit(float(i)))) for i in (1, 2, 3)]
    agg = named.groupBy("column_name").agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).alias("missing"), F.count("v").alias("n_distinct"),
        F.min("x").alias("min"), F.max("x").alias("max"), F.sum("w").alias("w"), *[s.alias(f"s{i}") for i, s in enumerate(sums, 1)],
    )
    w, m = F.col("w").cast("double"), F.col("s1") / F.col("w")
    m2 = F.col("s2") / w - m * m
    m3 = F.col("s3") / w - 3 * m * F.col("s2") / w + 2 * m * m * m
    g1 = m3 / F.pow(m2, F.lit(1.5))
    return agg.select(
        "column_name", "n", "missing", "n_distinct", "min", "max", m.alias("mean"), F.sqrt(m2 * w / (w - 1)).alias("sd"),
        F.when((w > 2) & (m2 > 0), g1 * F.sqrt(w * (w - 1)) / (w - 2)).alias("skewness"),
    )


def value_census(df: DataFrame, columns: list[str], at_most: int = 12) -> DataFrame:
    """column_name, value, n of the columns with at most ``at_most`` distinct values."""
    from lodestat.operators.profile import value_counts

    counts = value_counts(df, [], columns).where(F.col("value").isNotNull())
    few = counts.groupBy("column_name").agg(F.count("*").alias("k")).where(F.col("k") <= at_most)
    return counts.join(few, "column_name", "left_semi")
