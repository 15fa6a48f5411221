"""Data quality profile of columns, and where a load breaks with its study's first.

Standard aggregates come from one scan with partial aggregation.  Column expressions are
induced by minimum description length over the distinct values: each value has three
forms - itself, its characters as classes with exact lengths, and its runs as classes - and
a form of a coarser level is kept where writing it down and coding its values costs fewer bits
than its finer forms together.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestat.session import cut

#: Character classes, as (private symbol, Java class, hundredths of a bit for one character, name in an expression).
CLASSES = (
    ("\ue001", r"\p{Lu}", 470, "[A-Z]"),
    ("\ue002", r"\p{Ll}", 470, "[a-z]"),
    ("\ue003", r"\p{L}", 1200, r"\p{L}"),
    ("\ue004", r"\p{Nd}", 333, r"\d"),
    ("\ue005", r"\s", 100, r"\s"),
)
#: Hundredths of a bit to write down a literal character, a class, and a length: whole numbers, so that sums have no order.
LITERAL_BITS, CLASS_BITS, LENGTH_BITS = 800, 300, 400
#: An expression must hold this share of a column's known rows, else its rows do not conform.
MIN_SHARE = 0.005

#: The limits of the load comparison.
NULL_SHARE, MEAN_SDS, SD_RATIO, VALUE_SHARE = (1, 10), 0.4, 1.6, (1, 5)


def known(c: Column, kind: str) -> Column:
    """``c`` with NaN as null."""
    return F.when(~F.isnan(c), c) if kind in ("double", "float") else c


def _classes(v: Column) -> Column:
    for symbol, java, _, _ in CLASSES:
        v = F.regexp_replace(v, java, symbol)
    return v


def _runs(exact: Column) -> Column:
    for symbol, *_ in CLASSES:
        exact = F.regexp_replace(exact, f"{symbol}+", symbol)
    return exact


def _count(text: Column, symbol: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(symbol), F.lit("")))


def _expression(form: Column, exact: bool) -> Column:
    """A form as a regular expression in plain text."""
    out = F.regexp_replace(form, r"([\\.\[\]{}()*+?^$|])", r"\\$1")
    for symbol, _, _, name in CLASSES:
        name = name.replace("\\", "\\\\")
        if exact:
            out = F.regexp_replace(out, symbol, name)
        else:
            out = F.regexp_replace(out, symbol, f"{name}+")
    return out


def induce_expressions(values: DataFrame, by: list[str], value: str, rows: str) -> DataFrame:
    """The expressions of each column, by minimum description length.

    ``values`` has one row for each distinct ``value`` of each group ``by`` (the column's name, say)
    with its number of ``rows``.  Gives ``by``, form (the runs of the value: the group of
    candidates), level (``literal``, ``lengths`` or ``runs``), expression, key (by which ``with_keys``
    matches values to it), n_values, n_rows, bits.

    Null values are left out; an empty string has the empty expression.  Values repeated in
    ``values`` only count more often.  All groups are decided by aggregation, so no column's
    values meet in one task.
    """
    v = values.where(F.col(value).isNotNull()).withColumn("__exact", _classes(F.col(value).cast("string")))
    v = v.withColumn("__runs", _runs(F.col("__exact")))
    coded = reduce(lambda a, b: a + b, [_count(F.col("__exact"), s) * F.lit(b) for s, _, b, _ in CLASSES])
    tokens = F.length("__runs")
    lengths = reduce(lambda a, b: a + b, [_count(F.col("__runs"), s) for s, *_ in CLASSES])
    v = v.select(
        *by, F.col(value).cast("string").alias("__value"), "__exact", "__runs", F.col(rows).alias("__n"), coded.alias("__coded"),
        (F.length(F.col(value).cast("string")) * LITERAL_BITS + LENGTH_BITS).alias("__literal"),
        (tokens * CLASS_BITS + LENGTH_BITS).alias("__written"), (lengths * LENGTH_BITS).alias("__lengths"),
    )
    exact = v.groupBy(*by, "__runs", "__exact").agg(
        F.sum("__literal").alias("as_literals"),
        (F.max("__written") + F.max("__lengths") + F.sum("__coded")).alias("as_exact"),
        (F.sum("__coded") + F.sum("__lengths")).alias("under_runs"),
        F.max("__written").alias("written"),
        F.count("*").alias("n_values"),
        F.sum("__n").alias("n_rows"),
    )
    exact = exact.withColumn("best", F.least("as_literals", "as_exact"))
    runs = exact.groupBy(*by, "__runs").agg(
        F.sum("best").alias("finer"),
        (F.max("written") + F.sum("under_runs")).alias("bits"),
        F.sum("n_values").alias("n_values"),
        F.sum("n_rows").alias("n_rows"),
    )
    coarse = runs.where(F.col("bits") <= F.col("finer")).select(
        *by, F.col("__runs").alias("form"), F.lit("runs").alias("level"), _expression(F.col("__runs"), False).alias("expression"), _key("runs", F.col("__runs")).alias("key"),
        "n_values", "n_rows", (F.col("bits") / 100).alias("bits"),
    )
    fine = exact.join(runs.where(F.col("bits") > F.col("finer")).select(*by, "__runs"), [*by, "__runs"], "left_semi").withColumn("literal", F.col("as_literals") <= F.col("as_exact"))
    exactly = fine.where("NOT literal").select(
        *by, F.col("__runs").alias("form"), F.lit("lengths").alias("level"), _expression(F.col("__exact"), True).alias("expression"), _key("lengths", F.col("__exact")).alias("key"),
        "n_values", "n_rows", (F.col("best") / 100).alias("bits"),
    )
    # values kept as literals are one expression each
    literal = v.join(fine.where("literal").select(*by, "__runs", "__exact"), [*by, "__runs", "__exact"], "left_semi").groupBy(*by, "__runs", "__value").agg(
        F.count("*").alias("n_values"), F.sum("__n").alias("n_rows"), (F.sum("__literal") / 100).alias("bits")
    )
    literal = literal.select(
        *by, F.col("__runs").alias("form"), F.lit("literal").alias("level"), _escape(F.col("__value")).alias("expression"), _key("literal", F.col("__value")).alias("key"), "n_values", "n_rows", "bits"
    )
    return coarse.unionByName(exactly).unionByName(literal)


def _key(level: str, form: Column) -> Column:
    return F.concat(F.lit(f"{level} "), form)


def with_keys(df: DataFrame, value: str) -> DataFrame:
    """``df`` with ``key``, three rows for each: the keys of the expressions that may match ``value``.

    A group of forms is kept on one level, so of the three at most one is the key of an expression that was chosen.
    """
    forms = df.withColumn("__exact", _classes(F.col(value)))
    keys = F.array(_key("runs", _runs(F.col("__exact"))), _key("lengths", F.col("__exact")), _key("literal", F.col(value)))
    return forms.withColumn("key", F.explode(keys)).drop("__exact")


def _escape(c: Column) -> Column:
    return F.regexp_replace(c, r"([\\.\[\]{}()*+?^$|])", r"\\$1")


def number_text(c: Column) -> Column:
    """A double as text without an exponent, as far as 12 decimals and 26 digits before them go."""
    plain = F.regexp_replace(F.regexp_replace(c.try_cast("decimal(38,12)").cast("string"), "0+$", ""), r"\.$", ".0")
    usual = (c == 0) | F.abs(c).between(1e-3, 9_999_999)
    return F.when(usual | (F.abs(c) < 1e-12), c.cast("string")).otherwise(F.coalesce(plain, c.cast("string")))


def value_counts(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """``by``, column_name, value (as text; null for null and NaN), n: one row for each distinct value.

    Numbers are shuffled as numbers under the column's place; text and names come after the aggregation.
    """
    kinds = dict(df.dtypes)
    number = {c: kinds[c] not in ("string", "boolean", "date", "timestamp", "timestamp_ntz") for c in columns}
    cells = []
    for i, c in enumerate(columns):
        v = known(F.col(c), kinds[c])
        num, text = (v.cast("double"), F.lit(None).cast("string")) if number[c] else (F.lit(None).cast("double"), v.cast("string"))
        cells.append(F.struct(F.lit(i).cast("tinyint").alias("__c"), num.alias("__x"), text.alias("__t")))
    counts = df.select(*by, F.inline(F.array(*cells))).groupBy(*by, "__c", "__x", "__t").agg(F.count("*").alias("n"))
    whole = [i for i, c in enumerate(columns) if number[c] and kinds[c] not in ("double", "float")]
    shown = F.when(F.col("__c").isin(whole), F.col("__x").cast("bigint").cast("string")).otherwise(number_text(F.col("__x")))
    names = F.array(*[F.lit(c) for c in columns])
    return counts.select(*by, F.get(names, F.col("__c").cast("int")).alias("column_name"), F.coalesce("__t", shown).alias("value"), "n")


def load_breaks(
    df: DataFrame, *, study: str, load: str, at: str, numeric: list[str], categorical: list[str]
) -> DataFrame:
    """Where loads break with the first load of their study: column_name, load, issue.

    The first load has the smallest ``at``, then the smallest ``load``.  ``nulls``: the share of nulls
    differs by more than 0.10.  ``foreign``: a number further outside of the first load's range than
    that range is wide, or a category that the first load does not have.  Categories are told by the expressions
    induced from the first load's values: one that none matches is foreign, one that a literal matches is not, and one
    that only a coarser expression matches is compared exactly.  ``shift``: without nulls and foreign values, two at least being left, the mean
    differs by more than 0.4 of the first load's standard deviation or the standard deviation is
    more than 1.6 times as large or small; for categories the share of a value of the first load
    differs by more than 0.20.

    NaN counts as null.  Rows with a null study or load are left out.  Where the first load has
    no number there is nothing foreign and no shift, where it has one no shift; where it has no
    category every later one is foreign.
    Repeated rows count as delivered.  An empty table gives no rows.

    Scale: two scans with partial aggregation by load, one of the distinct categories.  The first loads
    (a row for each study) are joined to the second scan; Spark broadcasts them only below its
    own size threshold, and splits a study that holds most rows otherwise.
    """
    kinds = dict(df.dtypes)
    df = df.where(F.col(study).isNotNull() & F.col(load).isNotNull())
    df = df.select(study, load, at, *[known(F.col(c), kinds[c]).alias(c) for c in [*numeric, *categorical]])
    aggs = [F.min(at).alias("__at"), F.count("*").alias("__rows")]
    for c in numeric:
        aggs += [F.count(c).alias(f"n_{c}"), F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}"), F.avg(c).alias(f"avg_{c}"), F.stddev_samp(c).alias(f"sd_{c}")]
    aggs += [F.count(c).alias(f"n_{c}") for c in categorical]
    loads = cut(df.groupBy(study, load).agg(*aggs))
    stats = [c for c in loads.columns if c not in (study, load, "__at")]
    when = F.coalesce("__at", F.lit("9999-12-31").cast(loads.schema["__at"].dataType))
    first = cut(loads.groupBy(study).agg(F.min_by(F.struct(load, *stats), F.struct(when, load)).alias("f")))
    issues = []

    with_first = loads.join(first, study).where(F.col(load) != F.col(f"f.{load}"))
    num, den = NULL_SHARE
    for c in [*numeric, *categorical]:
        here, there = F.col("__rows") - F.col(f"n_{c}"), F.col("f.__rows") - F.col(f"f.n_{c}")
        wide = F.abs(here * F.col("f.__rows") - there * F.col("__rows")) * den > num * F.col("__rows") * F.col("f.__rows")
        issues.append(F.when(wide, F.struct(F.lit(c).alias("column_name"), F.lit("nulls").alias("issue"))))
    out = [with_first.select(F.col(load), F.inline(F.array_compact(F.array(*issues))))]

    if numeric:
        ranges = []
        for c in numeric:
            lo, hi = F.col(f"f.min_{c}"), F.col(f"f.max_{c}")
            ranges += [(lo - (hi - lo)).alias(f"lo_{c}"), (hi + (hi - lo)).alias(f"hi_{c}"), F.col(f"f.avg_{c}").alias(f"favg_{c}"), F.col(f"f.sd_{c}").alias(f"fsd_{c}")]
        bounds = first.select(study, F.col(f"f.{load}").alias("__first"), *ranges)
        rows = df.select(study, load, *numeric).join(bounds, study).where(F.col(load) != F.col("__first"))
        aggs = []
        for c in numeric:
            kept = F.when((F.col(c) >= F.col(f"lo_{c}")) & (F.col(c) <= F.col(f"hi_{c}")), F.col(c))
            aggs += [
                F.count_if((F.col(c) < F.col(f"lo_{c}")) | (F.col(c) > F.col(f"hi_{c}"))).alias(f"foreign_{c}"),
                F.count(kept).alias(f"n_{c}"), F.avg(kept).alias(f"avg_{c}"), F.stddev_samp(kept).alias(f"sd_{c}"),
                F.first(f"favg_{c}").alias(f"favg_{c}"), F.first(f"fsd_{c}").alias(f"fsd_{c}"),
            ]
        per_load = rows.groupBy(study, load).agg(*aggs)
        issues = []
        for c in numeric:
            sd, fsd = F.col(f"sd_{c}"), F.col(f"fsd_{c}")
            moved = (F.abs(F.col(f"avg_{c}") - F.col(f"favg_{c}")) > MEAN_SDS * fsd) | (sd > SD_RATIO * fsd) | (fsd > SD_RATIO * sd)
            issues.append(F.when(F.col(f"foreign_{c}") > 0, F.struct(F.lit(c).alias("column_name"), F.lit("foreign").alias("issue"))))
            issues.append(F.when((F.col(f"n_{c}") >= 2) & moved, F.struct(F.lit(c).alias("column_name"), F.lit("shift").alias("issue"))))
        out.append(per_load.select(F.col(load), F.inline(F.array_compact(F.array(*issues)))))

    if categorical:
        firsts = first.select(study, F.col(f"f.{load}").alias("__first"))
        counts = value_counts(df, [study, load], categorical).where(F.col("value").isNotNull())
        marked = cut(counts.join(firsts, study).select(study, load, "column_name", "value", "n", (F.col(load) == F.col("__first")).alias("__is_first")))
        base = marked.where("__is_first").select(study, "column_name", "value", F.col("n").alias("first_n"))
        forms = induce_expressions(base, [study, "column_name"], "value", "first_n").select(study, "column_name", "key", (F.col("level") == "literal").alias("__literal"))
        base_total = base.groupBy(study, "column_name").agg(F.sum("first_n").alias("base_n"))
        later = with_keys(marked.where("NOT __is_first").drop("__is_first"), "value").join(forms, [study, "column_name", "key"], "left")
        later = later.groupBy(study, load, "column_name", "value").agg(F.first("n").alias("n"), F.max("__literal").alias("__literal"))
        # matched by a literal: known; by nothing: foreign; by a coarser expression: looked up among the first load's values
        exact = base.select(study, "column_name", F.col("value").alias("__open"), F.lit(True).alias("__there"))
        later = later.withColumn("__open", F.when(~F.col("__literal"), F.col("value"))).join(exact, [study, "column_name", "__open"], "left")
        seen = later.join(base_total, [study, "column_name"], "left")
        foreign = F.col("__literal").isNull() | (~F.col("__literal") & F.col("__there").isNull())
        seen = cut(seen.select(study, load, "column_name", "value", "n", "base_n", foreign.alias("__foreign")))
        out.append(seen.where("__foreign").select(F.col(load), "column_name", F.lit("foreign").alias("issue")).distinct())
        kept = seen.where("NOT __foreign")
        total = kept.groupBy(study, load, "column_name", "base_n").agg(F.sum("n").alias("kept_n")).where("kept_n >= 2")
        # each value of the first load against each load of the same study: at most as many rows as the loads have
        pairs = total.join(base, [study, "column_name"]).join(kept.select(study, load, "column_name", "value", "n"), [study, load, "column_name", "value"], "left")
        num, den = VALUE_SHARE
        n = F.coalesce("n", F.lit(0))
        far = F.abs(n * F.col("base_n") - F.col("first_n") * F.col("kept_n")) * den > num * F.col("base_n") * F.col("kept_n")
        out.append(pairs.where(far).select(F.col(load), "column_name", F.lit("shift").alias("issue")).distinct())
    return reduce(lambda a, b: a.unionByName(b), out)


def coverage_changes(df: DataFrame, *, study: str, load: str, at: str, columns: list[str]) -> DataFrame:
    """How the coverage of the columns' expressions changes from the first load of a study: column_name, ``load``, form_expression, change.

    Expressions are induced over all distinct values of a column.  The coverage of one is its share of a load's known rows;
    ``change`` is the largest absolute difference to the first load (smallest ``at``, then smallest ``load``), and
    form_expression the expression that has it (ties: the first in order).  Nulls and NaN are not known rows; loads without
    any known value, and columns of which the first load has none, are left out, as are null studies and loads.
    """
    df = df.where(F.col(study).isNotNull() & F.col(load).isNotNull())
    counts = cut(value_counts(df, [study, load], columns).where(F.col("value").isNotNull()))
    distinct = cut(counts.groupBy("column_name", "value").agg(F.sum("n").alias("n")))
    induced = cut(induce_expressions(distinct, ["column_name"], "value", "n").select("column_name", "key", F.col("expression").alias("form_expression")))
    matched = with_keys(distinct.drop("n"), "value").join(induced.select("column_name", "key"), ["column_name", "key"])
    forms = counts.join(matched, ["column_name", "value"]).groupBy(study, load, "column_name", "key").agg(F.sum("n").alias("n"))
    totals = counts.groupBy(study, load, "column_name").agg(F.sum("n").alias("all_n"))
    shares = cut(forms.join(totals, [study, load, "column_name"]).select(study, load, "column_name", "key", (F.col("n") / F.col("all_n")).alias("share")))
    when = F.coalesce(F.min(at), F.lit("9999-12-31").cast(df.schema[at].dataType))
    first = df.groupBy(study, load).agg(when.alias("__at")).groupBy(study).agg(F.min_by(load, F.struct("__at", load)).alias("__first"))
    marked = shares.join(first, study)
    base = marked.where(F.col(load) == F.col("__first")).select(study, "column_name", "key", (-F.col("share")).alias("share"))
    later = marked.where(F.col(load) != F.col("__first"))
    # the first load's expressions against each later load of the study: as many rows as loads times expressions
    expected = later.select(study, load, "column_name").distinct().join(base, [study, "column_name"])
    both = later.select(study, load, "column_name", "key", "share").join(base.select(study, "column_name").distinct(), [study, "column_name"], "left_semi")
    off = both.unionByName(expected).groupBy(load, "column_name", "key").agg(F.abs(F.sum("share")).alias("change"))
    named = off.join(induced, ["column_name", "key"])
    top = named.groupBy(load, "column_name").agg(F.max("change").alias("change"))
    return named.join(top.withColumnRenamed("change", "__top"), [load, "column_name"]).where(F.col("change") == F.col("__top")).groupBy("column_name", load).agg(
        F.min("form_expression").alias("form_expression"), F.max("change").alias("change")
    )


def profile_loads(df: DataFrame, *, load: str, numeric: list[str], categorical: list[str], min_share: float = MIN_SHARE) -> DataFrame:
    """The profile of each column and load.

    Gives column_name, ``load``, n_rows, n_null, n_distinct, min_value, max_value, mean, sd (numbers only),
    n_nonconforming: known rows whose value matches no expression that holds at least ``min_share`` of
    the column's known rows.  Expressions are induced over all distinct values of the column.

    NaN counts as null; a null ``load`` is a load of its own; an empty table gives no rows.

    Scale: one aggregation of the rows into counts by load, column and value, in which numbers travel as numbers, and one
    of the distinct values, over which expressions are induced; moments come from a partial aggregation by load.
    """
    columns = [*numeric, *categorical]
    counts = cut(value_counts(df, [load], columns))
    named = counts.where(F.col("value").isNotNull())
    distinct = cut(named.groupBy("column_name", "value").agg(F.sum("n").alias("n")))
    expressions = induce_expressions(distinct, ["column_name"], "value", "n")
    whole = named.groupBy("column_name").agg(F.sum("n").alias("all_n"))
    good = cut(expressions.join(whole, "column_name").where(F.col("n_rows") >= min_share * F.col("all_n")).select("column_name", "key"))
    conforming = with_keys(distinct.drop("n"), "value").join(good, ["column_name", "key"]).select("column_name", "value", F.lit(True).alias("conforms"))
    marked = counts.join(conforming, ["column_name", "value"], "left")
    agg = marked.groupBy("column_name", load).agg(
        F.sum("n").alias("n_rows"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("n_null"),
        F.count("value").alias("n_distinct"),
        F.coalesce(F.sum(F.when(F.col("value").isNotNull() & F.col("conforms").isNull(), F.col("n"))), F.lit(0)).alias("n_nonconforming"),
    )
    # moments straight from the rows: Spark merges centred moments, so large means cancel nothing
    kinds = dict(df.dtypes)
    aggs, cells = [], []
    for i, c in enumerate(numeric):
        v = known(F.col(c), kinds[c]).cast("double")
        aggs += [F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}"), F.avg(v).alias(f"m{i}"), F.stddev_samp(v).alias(f"s{i}")]
        cells.append(F.struct(F.lit(c).alias("column_name"), F.col(f"lo{i}").alias("min_value"), F.col(f"hi{i}").alias("max_value"), F.col(f"m{i}").alias("mean"), F.col(f"s{i}").alias("sd")))
    if not numeric:
        none = [F.lit(None).cast("double").alias(n) for n in ("min_value", "max_value", "mean", "sd")]
        return agg.select("column_name", load, "n_rows", "n_null", "n_distinct", *none, "n_nonconforming")
    moments = df.groupBy(load).agg(*aggs).select(F.col(load).alias("__load"), F.inline(F.array(*cells)))
    moments = moments.withColumnRenamed("column_name", "__column")
    on = (F.col("column_name") == F.col("__column")) & F.col(load).eqNullSafe(F.col("__load"))
    return agg.join(moments, on, "left").select("column_name", load, "n_rows", "n_null", "n_distinct", "min_value", "max_value", "mean", "sd", "n_nonconforming")
