"""Reconciliation: linkage, grading, request matrices, divergence, coverage and evaluation roll-ups."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestat.functions.expr import is_close, round_half_up
from lodestat.session import cut

# Kinds without a sign, kinds compared on logs, significance limits, bands, and the limits near zero.
UNSIGNED = ("sd", "n", "F", "chi2", "p_value", "se", "eta2", "percent")
LOG_KINDS = ("OR", "HR")
CUTS = (0.05, 0.01, 0.001)
BANDS = ((0.02, "A"), (0.20, "B"), (0.40, "C"))
SMALL, SMALL_OFF = 0.001, 0.002


def grade(kind: Column, reported: Column, replicated: Column, precision: Column, comparator: Column) -> Column:
    """The band of a replicated value: A, B, C or fail; null where nothing was reported.

    A missing replicated value fails.  Then, the first that applies: a comparator's bound, taken literally; p values; sample
    sizes, exact or within one per cent; opposite signs, which fail (zero has none); ratios, on logs and positive only; the
    relative bands.  Sample sizes, ratios and bands see the replicated value rounded as the reported one was printed.
    """
    r, v, shown = reported, replicated, round_half_up(replicated, precision)
    met = F.when(comparator == "<", v < r).when(comparator == "<=", v <= r).when(comparator == ">", v > r).when(comparator == ">=", v >= r)
    opposite = ~F.coalesce(kind.isin(*UNSIGNED), F.lit(False)) & (F.abs(r) >= SMALL) & (v != 0) & ((v > 0) != (r > 0))
    ratio = F.when((shown <= 0) | (r <= 0), "fail").otherwise(_band(F.ln(r), F.ln(shown)))
    return (
        F.when(v.isNull(), "fail")
        .when(r.isNull(), None)
        .when(met, "A").when(~met, "fail")
        .when(kind == "p_value", F.when(precision.isNotNull() & (shown == r), "A").otherwise(_p_band(r, v)))
        .when(kind == "n", F.when(shown == r, "A").when((r != 0) & (F.abs(shown - r) / F.abs(r) <= 0.01), "B").otherwise("fail"))
        .when(opposite, "fail")
        .when(kind.isin(*LOG_KINDS), ratio)
        .otherwise(_band(r, shown))
    )


def _p_band(r: Column, v: Column) -> Column:
    """p values: on the same side of every limit, and both tiny (A) or within 2 (A) or 50 per cent (B)."""
    together = F.lit(True)
    for c in CUTS:
        together = together & ((v < c) == (r < c))
    tiny, off = (v < 0.001) & (r < 0.001), F.when(r != 0, F.abs(v - r) / F.abs(r))
    close = lambda limit: tiny | F.coalesce(off < limit, F.lit(False))
    return F.when(together & close(0.02), "A").when(together & close(0.5), "B").otherwise("fail")


def _band(r: Column, v: Column) -> Column:
    """The relative band, or the absolute rule near zero."""
    off = F.abs(v - r) / F.nullif(F.abs(r), F.lit(0.0))
    out = F.when(F.abs(r) < SMALL, F.when(F.abs(v - r) < SMALL_OFF, "A").otherwise("fail"))
    for edge, band in BANDS:
        out = out.when(off < edge, band)
    return out.otherwise("fail")


def exact_at_precision(reported: Column, replicated: Column, precision: Column) -> Column:
    """Whether both print the same."""
    return is_close(round_half_up(reported, precision), round_half_up(replicated, precision), 1e-9, 1e-12)


def rounding_compatible(kind: Column, reported: Column, replicated: Column, precision: Column, comparator: Column) -> Column:
    """Whether a bound that does not hold as printed would hold within half a unit of its precision; it never changes the grade.

    Null where nothing is to explain: no bound, a bound that holds, unknown precision, or a p value against a significance limit.
    """
    half = F.pow(F.lit(10.0), -precision) / 2
    met = F.when(comparator == "<", replicated < reported).when(comparator == "<=", replicated <= reported).when(comparator == ">", replicated > reported).when(comparator == ">=", replicated >= reported)
    near = (
        F.when(comparator == "<", replicated < reported + half).when(comparator == "<=", replicated <= reported + half)
        .when(comparator == ">", replicated > reported - half).when(comparator == ">=", replicated >= reported - half)
    )
    limit = F.coalesce((kind == "p_value") & reported.isin(*CUTS), F.lit(False))
    return F.when(~met & precision.isNotNull() & ~limit, near)


def unit_candidates(replicated: Column) -> Column:
    """Other units a replicated value might be in, as array<struct<value, note>>; they are listed, never applied."""
    listed = ((replicated * 100, "times 100"), (replicated / 100, "divided by 100"), (F.lit(0.0) - replicated, "sign turned"))
    return F.when(replicated.isNotNull(), F.array(*[F.struct(v.alias("value"), F.lit(n).alias("note")) for v, n in listed]))


def sigma_rule(reported: Column, replicated: Column, se: Column) -> Column:
    """``within`` or ``outside`` two standard errors; ``na`` without one."""
    off = F.abs(replicated - reported) / F.nullif(se, F.lit(0.0))
    return F.coalesce(F.when(off <= 2, "within").when(off > 2, "outside"), F.lit("na"))


def std_difference(reported: Column, replicated: Column, se: Column) -> Column:
    """The difference in standard errors; null without one."""
    return F.when(se > 0, F.abs(replicated - reported) / se)


def paired_grade(magnitude: Column, source_sign: Column, result_sign: Column, author_order: Column) -> Column:
    """Magnitude and direction apart: the magnitude's band, ``fail`` for a contradicted direction, ``unknown`` for an unstated one."""
    stated = F.coalesce(author_order, source_sign)
    return F.when(stated.isNull(), "unknown").when(stated != result_sign, "fail").otherwise(magnitude)


def df_gate(band: Column, printed_df: Column, computed_df: Column) -> Column:
    """A degrees-of-freedom mismatch fails whatever the band."""
    return F.when(printed_df.isNotNull() & computed_df.isNotNull() & ~is_close(printed_df, computed_df, 5e-3, 5e-3), "fail").otherwise(band)


def keyed_results(claims: DataFrame, results: DataFrame, key: str, value: str, rtol: float = 1e-6, atol: float = 1e-12) -> DataFrame:
    """Each claim with its result: ``value``, n_results and state ``matched``, ``missing`` or ``ambiguous``.

    Agreeing repeats merge; repeats that disagree are ambiguous and give no value.
    """
    folded = results.where(F.col(value).isNotNull()).groupBy(key).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"), F.count("*").alias("n_results"))
    j = claims.join(folded, key, "left")
    agree = is_close(F.col("__lo"), F.col("__hi"), rtol, atol)
    state = F.when(F.col("n_results").isNull(), "missing").when(agree, "matched").otherwise("ambiguous")
    return j.select(*claims.columns, F.when(agree, F.col("__lo")).alias(value), F.coalesce("n_results", F.lit(0)).alias("n_results"), state.alias("state"))


def request_matrix(rows: DataFrame, columns: DataFrame, cells: DataFrame, row_key: str, column_key: str, value: str) -> DataFrame:
    """row_key, column_key, value, disposition of every requested cell; missing cells are ``omitted``, or ``failed`` without any row in the column.

    The matrix is its result, so rows times columns come out; ``columns`` (replicas, say) must be few.
    """
    listed = [r[0] for r in columns.select(column_key).distinct().orderBy(column_key).limit(10_001).collect()]
    if len(listed) > 10_000:
        raise ValueError("more than 10000 columns")
    kind = columns.schema[column_key].dataType
    dense = rows.select(row_key).distinct().withColumn(column_key, F.explode(F.array(*[F.lit(x).cast(kind) for x in listed])))
    alive = cells.select(column_key).distinct().withColumn("__alive", F.lit(True))
    j = dense.join(cells.select(row_key, column_key, value, F.lit(True).alias("__cell")), [row_key, column_key], "left").join(alive, column_key, "left")
    state = F.when(F.col("__cell") & F.col(value).isNotNull(), "delivered").when(F.col("__cell"), "invalid").when(F.col("__alive"), "omitted").otherwise("failed")
    return j.select(row_key, column_key, value, state.alias("disposition"))


def mutual_best(pairs: DataFrame, left: str, right: str, score: str, margin: float = 0.05, rounds: int | None = None) -> DataFrame:
    """left, right, score, round: pairs that are each other's best by ``margin``, taken out and repeated until none is left.

    ``rounds`` asks for the first so many rounds only.  Ties and narrow leads stay unmatched.  The result does not depend on the order of rows.
    """
    out, rest = None, pairs.select(left, right, score)
    for i in range(1, rounds + 1) if rounds else count(1):  # each round takes a pair out, so there is a last one
        def lead(df: DataFrame, side: str, name: str) -> DataFrame:
            w = Window.partitionBy(side).orderBy(F.desc(score))
            nxt = F.coalesce(F.lead(score).over(w), F.lit(float("-inf")))
            return df.withColumn(name, (F.row_number().over(w) == 1) & (F.col(score) - nxt >= margin))

        best = cut(lead(lead(rest, left, "__a"), right, "__b").where(F.col("__a") & F.col("__b")).select(left, right, score, F.lit(i).alias("round")))
        if not best.limit(1).count():
            break
        out = best if out is None else out.unionByName(best)
        if i % 50 == 0:
            out = cut(out)
        for side in (left, right):  # a null key is a key as well; taken out by = it would be found again and again
            rest = rest.join(best.select(F.col(side).alias("__k")), F.col(side).eqNullSafe(F.col("__k")), "left_anti")
        rest = cut(rest)
    return out if out is not None else rest.where("false").withColumn("round", F.lit(0))


def mutual_nearest(left: DataFrame, right: DataFrame, left_key: str, right_key: str, block: tuple[str, str], value: tuple[str, str], margin: float = 0.05, rounds: int | None = None) -> DataFrame:
    """``mutual_best`` of all pairs of rows of one block, scored by minus the distance of their values, without forming the pairs.

    ``block`` and ``value`` name the columns of either side.  In the order of a block's values a row's best two partners are among its next
    two of the other side on either hand, and rows that are each other's best are neighbours.  Rows of a side and block that share a value are
    folded first: they tie for everyone, so none of them is ever taken, but they stand in the way of others.  Null blocks and values pair with nothing.

    Repeated keys with different values, and values that are not finite, take the pairs themselves.

    Scale: one row for each side, block and value; a round is one shuffle of them by block and is streamed in order.
    """
    if margin <= 0:
        raise ValueError("a lead needs a margin above zero")
    known = [df.select(F.col(k).alias("k"), F.col(b).alias("__b"), F.col(v).cast("double").alias("__x")).where("__b IS NOT NULL AND __x IS NOT NULL") for df, k, b, v in zip((left, right), (left_key, right_key), block, value)]
    wild = F.isnan("__x") | (F.abs("__x") == float("inf"))
    odd = [df.distinct().groupBy("k").agg(F.count("*").alias("n"), F.bool_or(wild).alias("wild")).where("n > 1 OR wild").select(F.lit(1)) for df in known]
    if odd[0].unionAll(odd[1]).limit(1).count():
        a, b = known[0].withColumnsRenamed({"k": left_key, "__x": "__l"}), known[1].withColumnsRenamed({"k": right_key, "__x": "__r"})
        return mutual_best(a.join(b, "__b").select(left_key, right_key, (-F.abs(F.col("__l") - F.col("__r"))).alias("score")), left_key, right_key, "score", margin, rounds)
    none = [F.lit(None).cast(df.schema["k"].dataType) for df in known]
    folded = [df.groupBy("__b", "__x").agg(F.min("k").alias("k"), (F.count("*") == 1).alias("__one")) for df in known]
    rest = folded[0].select("__b", "__x", F.lit(0).alias("__side"), F.col("k").alias("__l"), none[1].alias("__r"), "__one").unionAll(
        folded[1].select("__b", "__x", F.lit(1).alias("__side"), none[0].alias("__l"), F.col("k").alias("__r"), "__one")
    )
    up, down = Window.partitionBy("__b").orderBy("__x", "__side"), Window.partitionBy("__b").orderBy(F.desc("__x"), F.desc("__side"))
    seen = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    of = lambda side: F.when(F.col("__side") == side, F.col("__x"))
    apart = lambda x, y: -F.abs(x - y)
    out = None
    for i in range(1, rounds + 1) if rounds else count(1):  # each round takes a pair out, so there is a last one
        around = rest.select(
            "*", *[F.min(of(s)).over(seen(down)).alias(f"__after{s}") for s in (0, 1)], *[F.max(of(s)).over(seen(up)).alias(f"__before{s}") for s in (0, 1)],
        ).withColumn("v", F.lead(F.struct("__x", "__side", "__l", "__r", "__one", "__after0", "__after1")).over(up))
        first = F.col("__side") == 0
        x = F.when(first, F.col("__x")).otherwise(F.col("v.__x")), F.when(first, F.col("v.__x")).otherwise(F.col("__x"))
        score, least = apart(*x), F.lit(float("-inf"))
        leads = F.lit(True)
        for s in (0, 1):
            others = F.greatest(apart(x[s], F.col(f"__before{1 - s}")), apart(x[s], F.col(f"v.__after{1 - s}")))
            leads = leads & (score - F.coalesce(others, least) >= margin)
        pair = F.coalesce((F.col("__side") != F.col("v.__side")) & F.col("__one") & F.col("v.__one") & leads, F.lit(False))
        marked = around.withColumn("__pair", pair).select(
            "__b", "__x", "__side", "__l", "__r", "__one", "__pair", F.lag("__pair", 1, False).over(up).alias("__taken"),
            *[F.when(F.col("__pair"), e).alias(n) for n, e in ((left_key, F.coalesce("__l", "v.__l")), (right_key, F.coalesce("__r", "v.__r")), ("score", score))],
        )
        if i != rounds:
            marked = cut(marked)
        best = marked.where("__pair").select(left_key, right_key, "score", F.lit(i).alias("round"))
        if i != rounds and not best.limit(1).count():
            break
        out = best if out is None else out.unionByName(best)
        rest = marked.where("NOT __pair AND NOT __taken").select(*rest.columns)
    return out if out is not None else best


def partition_pairs(left: DataFrame, right: DataFrame, pairs: DataFrame, left_key: str, right_key: str, agree: Column) -> DataFrame:
    """left_key, right_key, part: ``agreed``, ``conflict``, ``only_left`` or ``only_right``; ``agree`` is over the joined rows."""
    j = pairs.select(left_key, right_key).join(left, left_key).join(right, right_key)
    both = j.select(left_key, right_key, F.when(agree, "agreed").otherwise("conflict").alias("part"))
    a = left.join(pairs, left_key, "left_anti").select(left_key, F.lit(None).cast(right.schema[right_key].dataType).alias(right_key), F.lit("only_left").alias("part"))
    b = right.join(pairs, right_key, "left_anti").select(F.lit(None).cast(left.schema[left_key].dataType).alias(left_key), right_key, F.lit("only_right").alias("part"))
    return both.unionByName(a).unionByName(b)


def coalescing_merge(pairs: DataFrame, fields: list[str]) -> list[Column]:
    """The fields of both records, the first's winning where known (columns ``a.field`` and ``b.field``)."""
    kinds = dict(pairs.select("a.*").dtypes)
    return [F.coalesce(F.nullif(F.col(f"a.{f}"), F.lit("")) if kinds[f] == "string" else F.col(f"a.{f}"), F.col(f"b.{f}")).alias(f) for f in fields]


def band_statistics(rows: DataFrame, by: list[str]) -> DataFrame:
    """by, n, n_graded, coverage, share_a, share_ab (of the graded) and end_to_end_ab (of all)."""
    graded, a, ab = F.count("band"), F.count_if(F.col("band") == "A"), F.count_if(F.col("band").isin("A", "B"))
    n = F.count("*")
    return rows.groupBy(*by).agg(
        n.alias("n"), graded.alias("n_graded"), (graded / n).alias("coverage"), (a / F.nullif(graded, F.lit(0))).alias("share_a"),
        (ab / F.nullif(graded, F.lit(0))).alias("share_ab"), (ab / n).alias("end_to_end_ab"),
    )


def keep_last(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by ``order``; partial aggregation, so a hot key needs no sort.  Rows of key and order alone are moved once."""
    if set(rows.columns) <= {*key, *order}:
        last = rows.groupBy(*key).agg(F.max(F.struct(*order)).alias("__r"))
        return last.select(*[c if c in key else F.col(f"__r.{c}").alias(c) for c in rows.columns])
    last = rows.groupBy(*key).agg(F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("__r"))
    return last.select("__r.*")


def macro_mean(rows: DataFrame, inner: str, value: str, by: list[str] | None = None) -> DataFrame:
    """by, n_groups, macro_mean: the mean over ``inner`` of the means within it."""
    by = by or []
    m = rows.groupBy(*by, inner).agg(F.avg(value).alias("__m"))
    return m.groupBy(*by).agg(F.count("*").alias("n_groups"), F.avg("__m").alias("macro_mean"))


def trace_agreement(rows: DataFrame, key: list[str], value: str) -> DataFrame:
    """key, n_known, n_unknown, modal_value, agreement: the share of the most frequent known value (ties: the smallest)."""
    counts = rows.groupBy(*key, value).agg(F.count("*").alias("__n"))
    known = F.when(F.col(value).isNotNull(), F.col("__n"))
    top = F.max(known)
    agg = counts.groupBy(*key).agg(
        F.coalesce(F.sum(known), F.lit(0)).alias("n_known"), F.coalesce(F.sum(F.when(F.col(value).isNull(), F.col("__n"))), F.lit(0)).alias("n_unknown"), top.alias("__top"),
    )
    tied = counts.where(F.col(value).isNotNull()).join(agg.select(*key, "__top"), key).where(F.col("__n") == F.col("__top")).groupBy(*key).agg(F.min(value).alias("modal_value"))
    return agg.join(tied, key, "left").select(*key, "n_known", "n_unknown", "modal_value", (F.col("__top") / F.nullif(F.col("n_known"), F.lit(0))).alias("agreement"))


def match_summary(rows: DataFrame, by: list[str], value: str, band: str) -> DataFrame:
    """by, n_ran, n_abstained, share_a, share_ab, cv of replicated values."""
    graded = F.count(band)
    return rows.groupBy(*by).agg(
        F.count("*").alias("n_ran"), F.count_if(F.col(value).isNull()).alias("n_abstained"), (F.count_if(F.col(band) == "A") / F.nullif(graded, F.lit(0))).alias("share_a"),
        (F.count_if(F.col(band).isin("A", "B")) / F.nullif(graded, F.lit(0))).alias("share_ab"), (F.stddev_samp(value) / F.nullif(F.abs(F.avg(value)), F.lit(0.0))).alias("cv"),
    )


def coverage_status(claims: DataFrame, key: str, inferential: DataFrame, descriptive: DataFrame, analyses: DataFrame) -> DataFrame:
    """key, status of each claim, the first that applies of ``inferential``, ``descriptive``, ``no_data``, ``data_invalid``, ``unresolved``.

    ``analyses`` has (key, state) rows; a claim is invalid or without data if all of its analyses are.
    """
    states = analyses.groupBy(key).agg(F.bool_and(F.col("state") == "data_invalid").alias("__bad"), F.bool_and(F.col("state") == "no_data").alias("__none"))
    j = claims.select(key).distinct()
    j = j.join(inferential.select(key).distinct().withColumn("__i", F.lit(True)), key, "left").join(descriptive.select(key).distinct().withColumn("__d", F.lit(True)), key, "left").join(states, key, "left")
    status = F.when(F.col("__i"), "inferential").when(F.col("__d"), "descriptive").when(F.col("__bad"), "data_invalid").when(F.col("__none"), "no_data").otherwise("unresolved")
    return j.select(key, status.alias("status"))


def divergence_groups(issues: list[DataFrame]) -> DataFrame:
    """group_id, analysis_id, kind, n_issues, claim_ids: the union of issue streams (analysis_id, kind, claim_id) by group."""
    union = issues[0]
    for other in issues[1:]:
        union = union.unionByName(other, allowMissingColumns=True)
    once = union.groupBy("analysis_id", "kind", "claim_id").agg(F.count("*").alias("n"))
    return once.groupBy("analysis_id", "kind").agg(F.sum("n").alias("n_issues"), F.array_sort(F.collect_list("claim_id")).alias("claim_ids")).select(
        F.concat_ws(":", "analysis_id", "kind").alias("group_id"), "analysis_id", "kind", "n_issues", "claim_ids"
    )


def precision_recall(gold: DataFrame, observed: DataFrame, key: list[str], stratum: str) -> DataFrame:
    """stratum (null for all), n_gold, n_observed, n_hit, precision, recall by grouping sets."""
    g = gold.select(*key, stratum).distinct().withColumn("__g", F.lit(1))
    o = observed.select(*key).distinct().withColumn("__o", F.lit(1))
    j = g.join(o, key, "full_outer").withColumn("__s", F.coalesce(F.col(stratum), F.lit("(none)")))
    r = j.rollup("__s").agg(F.count("__g").alias("n_gold"), F.count("__o").alias("n_observed"), F.count_if(F.col("__g").isNotNull() & F.col("__o").isNotNull()).alias("n_hit"))
    return r.select(F.col("__s").alias(stratum), "n_gold", "n_observed", "n_hit", (F.col("n_hit") / F.nullif(F.col("n_observed"), F.lit(0))).alias("precision"), (F.col("n_hit") / F.nullif(F.col("n_gold"), F.lit(0))).alias("recall"))


def grouping_totals(df: DataFrame, sets: list[str], sums: dict[str, Column]) -> DataFrame:
    """The totals overall and by each column of ``sets`` alone: level, member and the sums."""
    df = df.withColumn("__all", F.lit("all"))
    groups = df.groupingSets([["__all"], *[[c] for c in sets]], "__all", *sets)
    level = F.when(F.col("__all").isNotNull(), "all")
    agg = groups.agg(*[e.alias(n) for n, e in sums.items()], F.grouping_id().alias("__id"))
    width = len(sets) + 1
    for i, c in enumerate(sets, 1):
        bit = 1 << (width - 1 - i)
        level = level.when((F.col("__id").bitwiseAND(bit) == 0), c)
    member = F.coalesce(F.col("__all"), *[F.col(c).cast("string") for c in sets])
    return agg.select(level.alias("level"), member.alias("member"), *sums)


def aggregate_vector(values: Column, rule: Column) -> Column:
    """A vector as one number by its declared rule: min, max, all_above (min), all_below (max), any_above (max), any_below (min)."""
    return F.when(rule.isin("min", "all_above", "any_below"), F.array_min(values)).when(rule.isin("max", "all_below", "any_above"), F.array_max(values)).when(F.size(values) == 1, values[0])
