"""Column expressions for missing values, strict parsing, tolerances, rounding and digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Texts that count as missing when a table is read.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
)
#: The grammar of a number; Java's forms such as ``1d`` are none.
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def nan_to_null(c: Column) -> Column:
    """NaN is missing."""
    return F.when(~F.isnan(c), c)


def na_to_null(c: Column) -> Column:
    """Text that stands for a missing value is null."""
    return F.when(~c.isin(*NA_TOKENS), c)


def blank_to_null(c: Column) -> Column:
    """Blank text is null; other text is trimmed."""
    return F.nullif(F.trim(c), F.lit(""))


def number_or_problem(c: Column, blank_missing: bool = False) -> Column:
    """Text as struct<value, problem>: a finite number, or what is wrong with it.

    Null is neither.  Blank text is malformed unless ``blank_missing``; numbers beyond a double are not finite.
    """
    text = blank_to_null(c) if blank_missing else c
    value = F.when(F.trim(text).rlike(NUMBER), F.trim(text).try_cast("double"))
    whole = F.when(F.abs(value) < F.lit(float("inf")), value)
    problem = F.when(text.isNotNull() & value.isNull(), "malformed number").when(value.isNotNull() & whole.isNull(), "not finite")
    return F.struct(whole.alias("value"), problem.alias("problem"))


def strict_number(c: Column, blank_missing: bool = False) -> Column:
    """Text as a finite number; null stays null and what ``number_or_problem`` reports is an error."""
    parsed = number_or_problem(c, blank_missing)
    return F.when(parsed["problem"].isNull(), parsed["value"]).otherwise(F.raise_error(F.concat(parsed["problem"], F.lit(": "), c)).cast("double"))


def finite(c: Column) -> Column:
    """``c`` with NaN as null; an infinite value is an error."""
    return F.when(F.abs(c) == F.lit(float("inf")), F.raise_error(F.lit("infinite value")).cast("double")).otherwise(nan_to_null(c))


def is_close(a: Column, b: Column, rtol: float, atol: float) -> Column:
    """Equal within a relative or an absolute tolerance; null if either is null."""
    return F.abs(a - b) <= F.greatest(F.lit(rtol) * F.greatest(F.abs(a), F.abs(b)), F.lit(atol))


#: Digits after the point that rounding by a column knows; others are left as they are.
DIGITS = range(-6, 16)


def round_half_up(c: Column, digits: Column | int) -> Column:
    """Decimal rounding of the printed value, halves away from zero; ``digits`` may be a column.

    Null digits leave the value as it is.  The shortest printed form decides, so 2.675 rounds to 2.68 though the double lies below.
    """
    printed = c.cast("string").try_cast("decimal(38,16)")
    if isinstance(digits, int):
        return F.coalesce(F.round(printed, digits).cast("double"), F.round(c, digits))
    out = F.when(digits.isNull() | printed.isNull(), c)
    for d in DIGITS:
        out = out.when(digits == d, F.round(printed, d).cast("double"))
    return out.otherwise(c)


def spline_term(c: Column, a: float, b: float, d: float) -> Column:
    """The three-knot natural cubic spline term with knots a < b < d."""
    if not a < b < d:
        raise ValueError("knots must rise")

    def cube(k: float) -> Column:
        return F.pow(F.greatest(c - k, F.lit(0.0)), F.lit(3.0))

    return (cube(a) - cube(b) * ((d - a) / (d - b)) + cube(d) * ((b - a) / (d - b))) / (d - a) ** 2


def digest(*parts: Column, length: int = 64) -> Column:
    """SHA-256 of the parts as a JSON array, cut to ``length`` hex digits."""
    return F.left(F.sha2(F.to_json(F.array(*[p.cast("string") for p in parts])), 256), F.lit(length))


def seed_of(c: Column) -> Column:
    """A deterministic seed from a text: the first 15 hex digits of its SHA-256 as a number."""
    return F.conv(F.substring(F.sha2(c, 256), 1, 15), 16, 10).cast("bigint")


def age_seconds(ts: Column, now: Column) -> Column:
    """Seconds from ``ts`` to ``now``."""
    return F.unix_timestamp(now) - F.unix_timestamp(ts)


def json_leaves(c: Column, skip: tuple[str, ...] = ()) -> Column:
    """The leaves of a JSON object of up to two levels as array<struct<path, value>>.

    Deeper trees are walked by functions.udtf.JsonLeaves; this form stays inside the JVM.
    """
    top = F.from_json(c, "map<string,string>")
    entries = F.map_entries(F.map_filter(top, lambda k, _: ~k.isin(*skip) if skip else F.lit(True)))

    def inner(e: Column) -> Column:
        sub = F.from_json(e["value"], "map<string,string>")
        deep = F.transform(F.map_entries(sub), lambda s: F.struct(F.concat(F.lit("$."), e["key"], F.lit("."), s["key"]).alias("path"), s["value"].alias("value")))
        flat = F.array(F.struct(F.concat(F.lit("$."), e["key"]).alias("path"), e["value"].alias("value")))
        return F.when(e["value"].startswith("{") & sub.isNotNull(), deep).otherwise(flat)

    return F.flatten(F.transform(entries, inner))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Every double rounded, so that the order of partial sums does not show."""
    return df.select(*[F.round(F.col(c), digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
