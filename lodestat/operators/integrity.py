"""Integrity checks: keys, pairs, completeness, nesting, exact coverage, upserts and equality of results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestat.functions.expr import is_close
from lodestat.operators.sample import _known


def key_violations(df: DataFrame, key: list[str]) -> DataFrame:
    """key, n of keys that repeat or hold a null."""
    null = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in key])
    return df.groupBy(*key).agg(F.count("*").alias("n")).where((F.col("n") > 1) | null)


def pair_check(df: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    """by, n_complete, n_half, n_missing, n_infinite of a pair of columns."""
    a, b = _known(df, x), _known(df, y)
    inf = F.lit(float("inf"))
    infinite = F.coalesce(F.abs(F.col(x)) == inf, F.lit(False)) | F.coalesce(F.abs(F.col(y)) == inf, F.lit(False))
    return df.groupBy(*(by or [])).agg(
        F.count_if(a.isNotNull() & b.isNotNull()).alias("n_complete"), F.count_if(a.isNull() != b.isNull()).alias("n_half"),
        F.count_if(a.isNull() & b.isNull()).alias("n_missing"), F.count_if(infinite).alias("n_infinite"),
    )


def completeness(df: DataFrame, members: list[str]) -> DataFrame:
    """member, n_known, n_missing of each column, in one scan."""
    stacked = F.array(*[F.struct(F.lit(m).alias("member"), _known(df, m).isNotNull().alias("known")) for m in members])
    return df.select(F.inline(stacked)).groupBy("member").agg(F.count_if("known").alias("n_known"), F.count_if(~F.col("known")).alias("n_missing"))


def nested_likelihood(df: DataFrame, full: str, reduced: str) -> DataFrame:
    """Rows whose full model has a lower log likelihood than the restricted one."""
    return df.where(F.col(full) + 1e-8 < F.col(reduced))


def run_checks(checks: dict[str, DataFrame]) -> DataFrame:
    """check, status, n_affected: ``passed`` if a check's violations are empty, else ``anomaly``."""
    parts = [v.agg(F.count("*").alias("n_affected")).select(F.lit(k).alias("check"), F.when(F.col("n_affected") == 0, "passed").otherwise("anomaly").alias("status"), "n_affected") for k, v in checks.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def exact_cover(df: DataFrame, expected: DataFrame, key: list[str]) -> DataFrame:
    """key, problem: ``missing``, ``unexpected`` or ``repeated`` against the expected keys; empty means covered once."""
    have = df.groupBy(*key).agg(F.count("*").alias("__n"))
    want = expected.select(*key).distinct().withColumn("__w", F.lit(1))
    both = have.join(want, key, "full_outer")
    problem = F.when(F.col("__n").isNull(), "missing").when(F.col("__w").isNull(), "unexpected").when(F.col("__n") > 1, "repeated")
    return both.select(*key, problem.alias("problem")).where(F.col("problem").isNotNull())


def assert_exact_cover(df: DataFrame, expected: DataFrame, key: list[str]) -> DataFrame:
    """``df``, or an error naming one key that is not covered exactly once."""
    bad = exact_cover(df, expected, key).limit(1).collect()
    if bad:
        raise ValueError(f"not covered exactly once: {bad[0].asDict()}")
    return df


def upsert(base: DataFrame, changes: DataFrame, key: list[str], allowed: DataFrame) -> DataFrame:
    """``base`` with the rows of ``changes`` in place of those of the same key; every allowed key must come exactly once."""
    assert_exact_cover(changes, allowed, key)
    return base.join(changes.select(*key), key, "left_anti").unionByName(changes)


def rule_problems(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``df`` with ``problems``: the names of the rules (conditions that must hold) that a row breaks; unknown breaks none."""
    broken = [F.when(~ok, F.lit(name)) for name, ok in rules.items()]
    return df.withColumn("problems", F.array_compact(F.array(*broken)))


def result_contract(df: DataFrame) -> DataFrame:
    """Problems of result rows (estimate, se, p, n): finite, se not negative, p within 0..1, n whole and at least 2."""
    inf = float("inf")
    return rule_problems(
        df,
        {
            "estimate": ~F.isnan("estimate") & (F.abs("estimate") < inf), "se": (F.col("se") >= 0) & (F.col("se") < inf), "p": F.col("p").between(0, 1),
            "n": (F.col("n") >= 2) & (F.col("n") == F.floor("n")),
        },
    )


def compare_results(a: DataFrame, b: DataFrame, key: list[str], values: list[str], rtol: float = 1e-7, atol: float = 1e-9) -> DataFrame:
    """key, problem, fields: rows of only one side, or whose values are not close; empty means equal."""
    left = a.select(*key, *[F.col(c).alias(f"__a_{c}") for c in values], F.lit(True).alias("__a"))
    right = b.select(*key, *[F.col(c).alias(f"__b_{c}") for c in values], F.lit(True).alias("__b"))
    both = left.join(right, key, "full_outer")
    off = []
    for c in values:
        x, y = F.col(f"__a_{c}"), F.col(f"__b_{c}")
        same = F.when(x.isNull() | y.isNull(), x.isNull() & y.isNull()).otherwise(is_close(x, y, rtol, atol))
        off.append(F.when(~same, F.lit(c)))
    fields = F.array_compact(F.array(*off))
    problem = F.when(F.col("__b").isNull(), "only_left").when(F.col("__a").isNull(), "only_right").when(F.size(fields) > 0, "differs")
    return both.select(*key, problem.alias("problem"), fields.alias("fields")).where(F.col("problem").isNotNull())


def round_trip_differences(a: DataFrame, b: DataFrame, position: str, atol: float = 1e-12) -> DataFrame:
    """position, column_name, before, after of every cell that a conversion changed."""
    def long(df: DataFrame, name: str) -> DataFrame:
        cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias(name)) for c in df.columns if c != position])
        return df.select(position, F.inline(cells))

    both = long(a, "before").join(long(b, "after"), [position, "column_name"], "full_outer")
    x, y = F.col("before").try_cast("double"), F.col("after").try_cast("double")
    same = F.col("before").eqNullSafe(F.col("after")) | F.coalesce(F.abs(x - y) <= F.lit(atol) * F.greatest(F.lit(1.0), F.abs(x)), F.lit(False))
    return both.where(~same)


def binding_problems(bindings: DataFrame, catalog: DataFrame) -> DataFrame:
    """Each binding (file, table_name, column_name, range_min, range_max, n_total) with its problems against the catalogue.

    The catalogue has file, table_name, column_name, n, min, max, is_number.  The pair (file, table) is matched null-safely.
    """
    c = catalog.select(*[F.col(x).alias(f"c_{x}") for x in ("file", "table_name", "column_name", "n", "min", "max", "is_number")])
    on = F.col("file").eqNullSafe(F.col("c_file")) & F.col("table_name").eqNullSafe(F.col("c_table_name")) & (F.col("column_name") == F.col("c_column_name"))
    joined = bindings.join(c, on, "left")
    found = F.col("c_column_name").isNotNull()
    checked = rule_problems(
        joined,
        {
            "unknown column": found, "not numeric": ~found | F.coalesce("c_is_number", F.lit(True)),
            "below range": ~found | F.coalesce(F.col("c_min") >= F.col("range_min"), F.lit(True)),
            "above range": ~found | F.coalesce(F.col("c_max") <= F.col("range_max"), F.lit(True)),
            "more rows than the table": ~found | F.coalesce(F.col("n_total") <= F.col("c_n"), F.lit(True)),
        },
    )
    return checked.select(*bindings.columns, "problems")
