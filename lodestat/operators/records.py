"""Small record operators: kinds, roles, transforms, numbering, packets, identities, gates, focal anchors, completions."""

from __future__ import annotations

import re
from collections.abc import Mapping
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestat.functions import text
from lodestat.functions.expr import is_close
from lodestat.operators.ranked import cumulative

# Names of kinds, metrics and null values.
KIND_ALIASES = {"ci_lower": "ci_bound", "ci_upper": "ci_bound", "beta": "coefficient", "b": "coefficient", "M": "mean", "SD": "sd", "p": "p_value", "p-value": "p_value", "N": "n", "pct": "percentage", "average": "mean"}
METRIC_ALIASES = {"d": "dz", "p_value": "p_raw", "beta": "coefficient", "b": "coefficient", "lower": "ci_lower", "upper": "ci_upper"}
INFERENTIAL = ("p_value", "t", "F", "r", "d", "chi2", "coefficient", "ci_lower", "ci_upper")


def mapped(c: Column, names: Mapping[str, str], default: Column | None = None) -> Column:
    """A value by a fixed mapping; others stay, or become ``default``."""
    out = F.lit(None).cast("string")
    for k, v in sorted(names.items()):
        out = F.when(c == k, v).otherwise(out)
    return F.coalesce(out, c if default is None else default)


def canonical_kind(kind: Column) -> Column:
    """The canonical kind of a quantity."""
    return mapped(kind, KIND_ALIASES)


def normal_role(kind: Column, role: Column) -> Column:
    """Sample sizes are descriptive, whatever was said."""
    return F.when(canonical_kind(kind) == "n", "descriptive").otherwise(role)


def pair_value(x: Column, y: Column, how: str) -> Column:
    """The difference, log ratio or difference of logs of a pair; logarithms need positive values."""
    if how == "difference":
        return x - y
    if how != "log_ratio":
        raise ValueError(how)
    return F.when((x > 0) & (y > 0), F.ln(x / y)).when(x.isNull() | y.isNull(), None).otherwise(F.raise_error(F.lit("a logarithm needs positive values")).cast("double"))


def linear_transform(value: Column, se: Column, low: Column, high: Column, scale: Column) -> list[Column]:
    """A declared rescaling: value s, |s| se, and the interval in order."""
    a, b = low * scale, high * scale
    return [(value * scale).alias("value"), (F.abs(scale) * se).alias("se"), F.least(a, b).alias("ci_lower"), F.greatest(a, b).alias("ci_upper")]


def renumber(df: DataFrame, by: list[str], order: list[str], out: str = "number", pattern: str = "c%03d") -> DataFrame:
    """``df`` with sequential ids in a total order, nulls last, without one task for all rows of a key."""
    keyed = df.withColumns({f"__{c}": F.coalesce(F.col(c), F.lit(1e6)) if t in ("int", "bigint", "double") else F.coalesce(F.col(c).cast("string"), F.lit("￿")) for c, t in df.dtypes if c in order})
    ranked = cumulative(keyed.withColumn("__one", F.lit(1)), by, [f"__{c}" for c in order], "__one")
    return ranked.select(*df.columns, F.format_string(pattern, (F.col("before") + 1).cast("int")).alias(out))


def blinded(df: DataFrame, drop: list[str], nested: Mapping[str, list[str]] | None = None) -> DataFrame:
    """``df`` without result-carrying columns and struct fields."""
    for column, names in (nested or {}).items():
        df = df.withColumn(column, F.col(column).dropFields(*names))
    return df.drop(*drop)


def packets(parents: DataFrame, children: DataFrame, key: list[str], fields: list[str], out: str) -> DataFrame:
    """Each parent with the sorted array of its children's ``fields``; without any, an empty array."""
    grouped = children.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(out))
    empty = F.array().cast(grouped.schema[out].dataType)
    return parents.join(grouped, key, "left").withColumn(out, F.coalesce(F.col(out), empty))


def coerce_list(c: Column) -> Column:
    """A JSON value (scalar, list or object) as an array of texts; null gives an empty array."""
    v = F.try_parse_json(c)
    many = F.try_variant_get(v, "$", "array<string>")
    object_ = F.map_values(F.try_variant_get(v, "$", "map<string,string>"))
    one = F.array_compact(F.array(F.coalesce(F.try_variant_get(v, "$", "string"), F.when(v.isNull(), c))))
    return F.coalesce(many, object_, one)


def parsers(policies: DataFrame, column: str, parser: str) -> DataFrame:
    """column, parser, conflict: the declared parser of each column; two different ones conflict."""
    g = policies.groupBy(column).agg(F.array_sort(F.collect_set(parser)).alias("__p"))
    return g.select(column, F.when(F.size("__p") == 1, F.col("__p")[0]).alias(parser), (F.size("__p") > 1).alias("conflict"))


def complete_checks(requested: DataFrame, required: DataFrame, key: list[str]) -> DataFrame:
    """Requested checks and the required ones that are missing, as ``added``."""
    missing = required.join(requested, key, "left_anti").withColumn("added", F.lit(True))
    return requested.withColumn("added", F.lit(False)).unionByName(missing, allowMissingColumns=True)


def ambiguity_gate(contracts: DataFrame, key: str, kind: str = "source_identity") -> DataFrame:
    """key, n_ambiguities, abstain: whether any ambiguity of the blocking kind is open."""
    each = contracts.select(key, F.explode_outer("ambiguities").alias("a"))
    return each.groupBy(key).agg(F.count("a").alias("n_ambiguities"), F.coalesce(F.bool_or(F.col("a.kind") == kind), F.lit(False)).alias("abstain"))


def matched_columns(a: list[str], b: list[str], names: tuple[str, str]) -> list[tuple[str, str]]:
    """Column pairs of two conditions that are one-to-one once their condition's name is taken out; else an error."""
    keys = [{c.lower().replace(n.lower(), "").strip("_ "): c for c in cols} for cols, n in zip((a, b), names)]
    if len(keys[0]) != len(a) or len(keys[1]) != len(b) or keys[0].keys() != keys[1].keys():
        raise ValueError("columns do not match one to one")
    return [(keys[0][k], keys[1][k]) for k in sorted(keys[0])]


def percent_problem(kind: Column, value: Column, multiplier: Column) -> Column:
    """What is wrong with the unit of a readout, or null."""
    return F.when((kind == "percentage") & (multiplier != 100), "a percentage needs the multiplier 100").when((kind != "percentage") & (multiplier == 100), "only percentages are multiplied").when((kind == "percentage") & ~value.between(0, 100), "out of 0..100")


def metric_join(results: DataFrame, quantities: DataFrame, key: str, metric: str) -> DataFrame:
    """Quantities with the result of the same key and metric, names of metrics being aliased on both sides."""
    r = results.withColumn("__m", mapped(F.col(metric), METRIC_ALIASES)).drop(metric)
    q = quantities.withColumn("__m", mapped(F.col(metric), METRIC_ALIASES))
    return q.join(r, [key, "__m"], "left").drop("__m")


def alias_lookup(items: DataFrame, mappings: DataFrame, text: str) -> DataFrame:
    """Items (paper_id, field, text) with their canonical term, if one only is mapped within the paper and field; state says which."""
    m = mappings.select("paper_id", "field", F.lower(F.trim("source_text")).alias("__t"), "canonical").distinct()
    m = m.groupBy("paper_id", "field", "__t").agg(F.min("canonical").alias("canonical"), F.countDistinct("canonical").alias("__n"))
    j = items.withColumn("__t", F.lower(F.trim(text))).join(m, ["paper_id", "field", "__t"], "left")
    state = F.when(F.col("__n").isNull(), "unmapped").when(F.col("__n") > 1, "ambiguous").otherwise("mapped")
    return j.select(*items.columns, F.when(F.col("__n") == 1, F.col("canonical")).alias("canonical"), state.alias("state"))


def focal_anchor(claims: DataFrame, focal: DataFrame, by: str) -> DataFrame:
    """by, analysis_id, n_claims: the one analysis whose claims print the focal value; several or none give no row.

    ``claims`` has by, analysis_id, value; ``focal`` has by, focal_value.
    """
    j = claims.join(focal, by).where(is_close(F.col("value"), F.col("focal_value"), 1e-6, 1e-9))
    g = j.groupBy(by, "analysis_id").agg(F.count("*").alias("n_claims"))
    one = g.groupBy(by).agg(F.count("*").alias("__k"))
    return g.join(one.where("__k = 1"), by).drop("__k")


def exactly_one(items: DataFrame, rules: DataFrame, on: list[str], rule: str) -> DataFrame:
    """Items with the one rule that matches them by ``on``; n_rules tells those that have none or several."""
    g = rules.groupBy(*on).agg(F.countDistinct(rule).alias("n_rules"), F.min(rule).alias("__r"))
    j = items.join(g, on, "left")
    return j.select(*items.columns, F.coalesce("n_rules", F.lit(0)).alias("n_rules"), F.when(F.col("n_rules") == 1, F.col("__r")).alias(rule))


def dispersion(rows: DataFrame, outer: str, inner: str, value: str) -> DataFrame:
    """outer, within_range (largest, of groups of two or more), between_range of the groups' means."""
    g = rows.where(F.col(value).isNotNull()).groupBy(outer, inner).agg(F.avg(value).alias("__m"), F.when(F.count("*") >= 2, F.max(value) - F.min(value)).alias("__r"))
    return g.groupBy(outer).agg(F.max("__r").alias("within_range"), (F.max("__m") - F.min("__m")).alias("between_range"))


def needs_focus(share_ab: Column, share_a: Column, cv: Column) -> Column:
    """Whether a claim's replications call for a closer look."""
    return F.coalesce(share_ab < 0.5, F.lit(False)) | F.coalesce(share_a == 0, F.lit(False)) | F.coalesce(cv > 0.2, F.lit(False))


def disagreement(rows: DataFrame, by: list[str], value: str, rtol: float = 1e-8, atol: float = 1e-12, magnitudes: bool = False) -> DataFrame:
    """by, n, disagree: whether any two values are not close (in magnitude)."""
    v = F.abs(F.col(value)) if magnitudes else F.col(value)
    return rows.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), (~is_close(F.min(v), F.max(v), rtol, atol)).alias("disagree"))


def disputed_fields(pairs: DataFrame, fields: list[str]) -> DataFrame:
    """field, n_disputed over pairs with columns ``a`` and ``b`` (structs); equal nulls agree."""
    counts = pairs.agg(*[F.count_if(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}"))).alias(f) for f in fields])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("n_disputed")) for f in fields])))


def acceptance(df: DataFrame, rules: Mapping[str, Column], by: list[str]) -> DataFrame:
    """by, accepted, blockers: all rules hold for all rows, or the names of those that do not; unknown blocks."""
    aggs = [F.bool_and(F.coalesce(ok, F.lit(False))).alias(f"__{i}") for i, ok in enumerate(rules.values())]
    g = df.groupBy(*by).agg(*aggs)
    blockers = F.array_compact(F.array(*[F.when(~F.col(f"__{i}"), F.lit(n)) for i, n in enumerate(rules)]))
    return g.select(*by, (F.size(blockers) == 0).alias("accepted"), blockers.alias("blockers"))


def repeats(df: DataFrame, by: list[str], line: str) -> DataFrame:
    """by, max_repeats: how often the most repeated line comes again."""
    return df.groupBy(*by, line).agg((F.count("*") - 1).alias("n")).groupBy(*by).agg(F.max("n").alias("max_repeats"))


def identity_groups(df: DataFrame, by: list[str], a: str, b: str, members: str) -> DataFrame:
    """by, pair, members: rows grouped by an unordered pair of columns."""
    pair = F.array_sort(F.array(F.col(a).cast("string"), F.col(b).cast("string")))
    return df.groupBy(*by, pair.alias("pair")).agg(F.array_sort(F.collect_set(members)).alias("members"))


def eligible_ids(df: DataFrame, key: str, ids: str, allowed: DataFrame, allowed_id: str, scope: str) -> DataFrame:
    """``df`` with the array ``ids`` cut down to the allowed ids of its ``scope``, in order."""
    each = df.select(key, scope, F.posexplode(ids).alias("__pos", allowed_id))
    kept = each.join(allowed.select(scope, allowed_id).distinct(), [scope, allowed_id], "left_semi")
    back = kept.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("__pos", allowed_id))), lambda s: s[allowed_id]).alias("__ids"))
    return df.join(back, key, "left").withColumn(ids, F.coalesce("__ids", F.array().cast(df.schema[ids].dataType))).drop("__ids")


# Words that say nothing about which quantity is meant, and units and names that identify a design.
STOP_WORDS = "the a an of in for and between to was is when with p t d dz test tests paired condition conditions".split()
DESIGN_LEVEL = r"(?i)(?<![\w.])(\d+(?:\.\d+)?\s*(?:dB|ms|Hz|seconds?|milliseconds?))\b"
DESIGN_ID = r"(?i)\b((?:experiment|exp|study|sample|wave|session)\.?\s*\d+)\b"
PRINTED_DF = r"(?i)\b((?:t|f|r)\s*\([\d.,\s]+\))"
#: Descriptions and quotations support a link from these similarities on, quotations from this length.
ALIKE, CONTEXT_ALIKE, CONTEXT_LEAST = 0.5, 0.8, 20
#: Cells are one if they have the same digits and this share of their words.
LABEL_ALIKE = 0.8


def linkage_candidates(a: DataFrame, b: DataFrame, alike: float = ALIKE) -> DataFrame:
    """a_id, b_id, score: which readings of two readers may be of one quantity, and how well they are supported.

    Both have id, paper_id, page, kind, study_id, loc_kind, label, cell, description, source_quote.  A pair has one paper and page and
    the same canonical kind (a mean may meet an ``other``); unless unknown on a side, the same study, kind of place, cell, design levels, design
    numbers and printed degrees of freedom, and labels with the same digits that are alike.  It then needs support: the same
    quotation, quotations alike but for their numbers, or descriptions alike or containing each other's words by ``alike``.  The value is no
    part of it.  A null paper, page or kind never pairs.

    Scale: an equi-join on (paper, page, kind); the gates are expressions inside of it, so that only pairs that pass them reach the
    text comparison.
    """
    norm = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    found = lambda c, p: F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(p), F.lit(1)), lambda x: F.lower(F.regexp_replace(x, r"[\s.]+(?=\S)", "")))))

    pieces = lambda c, p: F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(p), F.lit(1))

    def side(df: DataFrame, s: str) -> DataFrame:
        text = F.concat_ws(" ", "description", "source_quote")
        words = F.array_except(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("description", F.lit(""))), F.lit("([a-z]+)"), F.lit(1))), F.array(*map(F.lit, STOP_WORDS)))
        return df.select(
            F.col("id").alias(f"{s}_id"), "paper_id", "page", canonical_kind(F.col("kind")).alias(f"{s}_kind"), norm(F.col("study_id")).alias(f"{s}_study"), F.col("loc_kind").alias(f"{s}_place"),
            F.col("label").alias(f"{s}_label"), F.array_distinct(pieces(F.col("cell"), "([a-z0-9]+)")).alias(f"{s}_cell"), pieces(F.col("cell"), "([0-9]+)").alias(f"{s}_digits"), F.col("description").alias(f"{s}_description"), F.col("source_quote").alias(f"{s}_quote"),
            found(F.col("description"), DESIGN_LEVEL).alias(f"{s}_levels"), found(text, DESIGN_ID).alias(f"{s}_designs"), found(F.col("source_quote"), PRINTED_DF).alias(f"{s}_df"), words.alias(f"{s}_words"),
        )

    left = side(a, "a").withColumn("__kind", F.col("a_kind"))
    right = side(b, "b").withColumn("__kind", F.explode(F.when(F.col("b_kind").isin("mean", "other"), F.array(F.lit("mean"), F.lit("other"))).otherwise(F.array("b_kind"))))
    open_or_same = lambda f: F.coalesce(F.col(f"a_{f}") == F.col(f"b_{f}"), F.lit(True))
    empty_or_same = lambda f: (F.size(f"a_{f}") == 0) | (F.size(f"b_{f}") == 0) | (F.col(f"a_{f}") == F.col(f"b_{f}"))
    union = F.nullif(F.size(F.array_union("a_cell", "b_cell")), F.lit(0))
    one_empty = (F.size("a_cell") == 0) | (F.size("b_cell") == 0)
    cells = one_empty | ((F.col("a_digits") == F.col("b_digits")) & (F.size(F.array_intersect("a_cell", "b_cell")) / union >= LABEL_ALIKE))
    j = left.join(right, ["paper_id", "page", "__kind"]).where(
        open_or_same("study") & open_or_same("place") & cells & empty_or_same("levels") & empty_or_same("designs") & empty_or_same("df")
    )
    smaller = F.nullif(F.least(F.size("a_words"), F.size("b_words")), F.lit(0))
    contained = F.coalesce(F.size(F.array_intersect("a_words", "b_words")) / smaller, F.lit(0.0))
    quoted = F.coalesce((F.col("a_quote") == F.col("b_quote")) & (F.col("a_quote") != ""), F.lit(False))
    compared = F.pandas_udf(_compare_texts, "labels boolean, description double, context double")
    j = j.withColumn("__t", compared("a_label", "b_label", "a_description", "b_description", "a_quote", "b_quote")).where("__t.labels")
    similarity = F.greatest(F.col("__t.description"), contained)
    context = F.when(F.col("__t.context") >= CONTEXT_ALIKE, F.col("__t.context")).otherwise(0.0)
    both_cells = (~one_empty).cast("double")
    scored = j.where(quoted | (context > 0) | (similarity >= alike))
    return scored.select("a_id", "b_id", (3.0 * quoted.cast("double") + 6 * context + similarity + both_cells).alias("score"))


def _compare_texts(la: pd.Series, lb: pd.Series, da: pd.Series, db: pd.Series, qa: pd.Series, qb: pd.Series) -> pd.DataFrame:
    """Whether labels match, and the likeness of descriptions and of quotations without their numbers."""
    bare = lambda s: re.sub(r"[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?", "#", s or "")
    out = []
    for a, b, x, y, p, q in zip(la, lb, da, db, qa, qb):
        p, q = bare(text.norm_source(p or "")), bare(text.norm_source(q or ""))
        long = min(len(p), len(q)) >= CONTEXT_LEAST
        out.append((text.labels_match(a, b), text.ratio(bare(x), bare(y)) if x and y else 0.0, text.ratio(p, q) if long else 0.0))
    return pd.DataFrame(out, columns=["labels", "description", "context"])


def value_band(tokens: DataFrame, by: list[str], y: str, margin: float) -> DataFrame:
    """by, y_min, y_max: the band of a page that holds the tokens, widened by a margin."""
    return tokens.groupBy(*by).agg((F.min(y) - margin).alias("y_min"), (F.max(y) + margin).alias("y_max"))


def perturbed_rows(df: DataFrame, key: str, column: str, seed: int, scale: float) -> DataFrame:
    """``df`` with normal noise on a column, drawn from each row's key, so that partitions do not matter."""
    u = lambda salt: (F.pmod(F.xxhash64(F.col(key), F.lit(seed), F.lit(salt)), F.lit(1 << 53)) + 1) / float((1 << 53) + 1)
    noise = F.sqrt(-2 * F.ln(u(1))) * F.cos(2 * F.pi() * u(2))
    return df.withColumn(column, F.col(column) + scale * noise)


def resampled_rows(df: DataFrame, key: str, index: DataFrame, draw: int) -> DataFrame:
    """The rows of one draw of a shared resampling index (draw, pos, idx), rows numbered in the order of ``key``."""
    numbered = cumulative(df.withColumn("__one", F.lit(1)), [], [key], "__one").withColumnRenamed("before", "idx").drop("total", "__one")
    return index.where(F.col("draw") == draw).join(numbered, "idx").drop("idx", "draw")


def amended_factors(factors: dict[str, list[str]], amendments: list[tuple[str, str, str]]) -> dict[str, list[str]]:
    """Factors after (action, factor, level) amendments: ``add`` and ``remove`` a level, ``pin`` a factor to one, ``merge`` a factor away.

    An unknown factor or level, or a factor left without levels, is an error.
    """
    out = {k: list(v) for k, v in factors.items()}
    for action, factor, level in amendments:
        if factor not in out or (action in ("remove", "pin") and level not in out[factor]):
            raise ValueError(f"cannot {action} {factor}={level}")
        if action == "add":
            out[factor] += [level] if level not in out[factor] else []
        elif action == "remove":
            out[factor].remove(level)
        elif action == "pin":
            out[factor] = [level]
        elif action == "merge":
            del out[factor]
        else:
            raise ValueError(f"unknown action {action}")
        if factor in out and not out[factor]:
            raise ValueError(f"{factor} has no levels left")
    return out


def within_budget(df: DataFrame, by: str, order: list[str], amount: str, cap: float) -> DataFrame:
    """``df`` with the running sum before each row, and whether it stays within the cap."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(amount).over(w), F.lit(0.0))
    return df.withColumn("before", before).withColumn("fits", before + F.col(amount) <= cap)
