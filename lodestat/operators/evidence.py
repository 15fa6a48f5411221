"""Source evidence and leaks: anchors, page bands, spatial joins, forbidden forms and merged spans."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestat.functions.text import leak_forms
from lodestat.operators.sequence import merge_intervals

#: Distinct forms that one scan may look for; they make one automaton for each worker.
MAX_FORMS = 2_000_000
#: Kinds that carry a result; the bounds of an interval count as one kind.
INFERENTIAL = ("t", "F", "chi2", "z", "d", "r", "OR", "HR", "eta2", "coefficient", "p_value", "se", "ci_bound", "ci_lower", "ci_upper")
#: Kinds that are never printed as a percentage.
NEVER_PERCENT = ("t", "F", "chi2", "z", "d", "r", "OR", "HR", "eta2", "p_value")
#: Degrees of freedom in notes on uncertainty follow from the sample size: they are no results.
DF_KEYS = ("df", "df1", "df2", "df_num", "df_den", "df_numerator", "df_denominator", "degrees_of_freedom")
DF_TEXT = r"(?<![A-Za-z])(?:t|F|z|Z|r|Q|W|H|U|chi2|χ2|χ²)\s*\(\s*[\d.,\s]+\)|(?i:\b(?:df(?:[_ ]?(?:num|den|numerator|denominator|1|2))?|degrees?\s+of\s+freedom)\s*[=:]\s*\d+(?:\.\d+)?)"


def pages(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, page (from 1), page_text of texts split at form feeds."""
    return df.select(key, F.posexplode(F.split(F.col(text), "\f")).alias("__p", "page_text")).select(key, (F.col("__p") + 1).alias("page"), "page_text")


def marker_join(numbers: DataFrame, markers: DataFrame) -> DataFrame:
    """Each number with the one marker to its right: same page and line, -1 <= dx <= 12, |dy| <= 8; several or none give none.

    Numbers have (token_id, page, line, x1, y), markers (marker_id, page, line, x0, y).
    """
    m = markers.select("marker_id", "page", "line", F.col("x0").alias("__x"), F.col("y").alias("__y"))
    near = (F.col("__x") - F.col("x1")).between(-1, 12) & (F.abs(F.col("__y") - F.col("y")) <= 8)
    j = numbers.join(m, ["page", "line"]).where(near)
    return j.groupBy("token_id").agg(F.count("*").alias("__n"), F.min("marker_id").alias("marker_id")).where("__n = 1").drop("__n")


def quote_pages(claims: DataFrame, page_texts: DataFrame, paper: str, claim: str, page: str, quote: str, reach: int = 3, least: int = 20) -> DataFrame:
    """claim, page, found_page: quotes of at least ``least`` characters that occur on exactly one page within ``reach`` pages."""
    p = page_texts.select(paper, F.col("page").alias("found_page"), "page_text")
    wanted = claims.where(F.length(quote) >= least).withColumn("found_page", F.explode(F.sequence(F.col(page) - reach, F.col(page) + reach)))
    hits = wanted.join(p, [paper, "found_page"]).where(F.col("page_text").contains(F.col(quote)))
    return hits.groupBy(claim, page).agg(F.count("*").alias("__n"), F.min("found_page").alias("found_page")).where("__n = 1").drop("__n")


def anchored(findings: DataFrame, texts: DataFrame, key: str, anchor: str, text: str, least: int = 12) -> DataFrame:
    """Findings joined to texts of the same ``key`` that hold their anchor of at least ``least`` characters."""
    return findings.where(F.length(anchor) >= least).join(texts, key).where(F.col(text).contains(F.col(anchor)))


def result_values(claims: DataFrame, contracts: DataFrame) -> DataFrame:
    """claim_uid, value, precision_digits, least_digits, percent: the numbers of all claims that give a result away.

    A claim does if its kind is inferential, if it is a headline, or if an analysis of ``contracts`` lists it together with
    one of these.  The numbers in its uncertainty count too, without degrees of freedom.  Two digits give away a headline
    or a p value, three any other.  Design numbers are exempt only if the caller leaves them out: no table has them.
    """
    kind, headline = F.col("quantity_kind"), F.coalesce(F.col("importance") == "headline", F.lit(False))
    c = claims.where(F.col("value").isNotNull()).withColumn("__own", headline | F.coalesce(kind.isin(*INFERENTIAL), F.lit(False)))
    listed = contracts.select("record_id", "paper_id", F.explode("claim_ids").alias("claim_id")).where("claim_id is not null").distinct()
    carrying = claims.where(headline | kind.isin(*INFERENTIAL)).select("paper_id", "claim_id").distinct()
    carried = listed.join(listed.join(carrying, ["paper_id", "claim_id"], "left_semi").select("record_id", "paper_id").distinct(), ["record_id", "paper_id"], "left_semi")
    c = c.join(carried.select("paper_id", "claim_id", F.lit(True).alias("__carried")).distinct(), ["paper_id", "claim_id"], "left")
    notes = F.filter(F.map_entries("uncertainty"), lambda e: ~F.lower(e["key"]).isin(*DF_KEYS) & e["value"].isNotNull())
    texts = F.transform(notes, lambda e: F.regexp_replace(e["value"], DF_TEXT, " "))
    found = F.flatten(F.transform(texts, lambda t: F.regexp_extract_all(t, F.lit(r"-?\d*\.?\d+"), F.lit(0))))
    numbers = F.transform(F.coalesce(found, F.array().cast("array<string>")), lambda n: F.struct(n.cast("double").alias("value"), F.lit(None).cast("int").alias("precision_digits")))
    own = F.array(F.struct(F.col("value").cast("double").alias("value"), F.col("precision_digits").cast("int").alias("precision_digits")))
    digits = F.when(headline | F.coalesce(kind == "p_value", F.lit(False)), 2).otherwise(3)
    wanted = c.where(F.col("__own") | F.col("__carried"))
    return wanted.select(
        "claim_uid", digits.alias("least_digits"), F.coalesce(~kind.isin(*NEVER_PERCENT), F.lit(False)).alias("percent"), F.inline(F.concat(own, numbers))
    ).distinct()


def forbidden_forms(values: DataFrame, key: str, value: str, precision: str, least_digits: int | str = 2) -> DataFrame:
    """key, form of every printed form that would give a value away, and ``percent`` if ``values`` have it.

    ``least_digits`` is a number or the column that has it.
    """
    kept = ["percent"] if "percent" in values.columns else []
    chosen = values.select(key, value, precision, *kept, (F.col(least_digits) if isinstance(least_digits, str) else F.lit(least_digits)).alias("__least"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, v, p, least, *more in zip(b[key], b[value], b[precision], b["__least"], *[b[c] for c in kept]):
                if v is not None and math.isfinite(v):
                    rows += [(k, f, *more) for f in leak_forms(float(v), int(p) if p is not None and p == p else None, int(least))]
            yield pd.DataFrame(rows, columns=[key, "form", *kept])

    kind = dict(values.dtypes)[key]
    return chosen.mapInPandas(run, f"`{key}` {kind}, form string" + ", percent boolean" * len(kept))


def scan_forms(texts: DataFrame, key: str, text: str, forms: DataFrame) -> DataFrame:
    """key, form, start, end of every boundary-aware occurrence of a form.

    All forms make one automaton, so a text is read once whatever their number.  An occurrence must not touch a word
    character or a point with a digit, nor stand before ``% CI``; a minus before it belongs to it.  Forms have no sign.
    A form whose ``percent`` (if ``forms`` have it) is false in all rows may not stand before a percent sign.
    """
    percent = F.max("percent") if "percent" in forms.columns else F.lit(True)
    listed = sorted((r.form, r.percent) for r in forms.where("form <> ''").groupBy("form").agg(percent.alias("percent")).limit(MAX_FORMS + 1).collect())
    if len(listed) > MAX_FORMS:
        raise ValueError(f"more than {MAX_FORMS} forms")
    kind = dict(texts.dtypes)[key]
    box: list[ahocorasick.Automaton] = []

    level, share = re.compile(r"\s*%\s*(?:CI|confidence)"), re.compile(r"\s*%")

    def bounded(t: str, a: int, b: int, percent: bool) -> bool:
        before, after = t[a - 1 : a], t[b : b + 1]
        if (before and (before.isalnum() or before in "_.")) or (after and (after.isalnum() or after == "_")):
            return False
        if after == "." and t[b + 1 : b + 2].isdigit():
            return False
        return not (level if percent else share).match(t, b)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if not box:
            machine = ahocorasick.Automaton()
            for f, percent in listed:
                machine.add_word(f, (f, percent))
            if listed:
                machine.make_automaton()
            box.append(machine)
        for b in batches:
            rows = []
            for k, t in zip(b[key], b[text]):
                if t and listed:
                    for last, (f, percent) in box[0].iter(t):
                        a = last + 1 - len(f)
                        if bounded(t, a, last + 1, percent):
                            signed = t[a - 1 : a] in ("-", "−") and not (t[a - 2 : a - 1].isalnum() or t[a - 2 : a - 1] in ("_", "."))
                            rows.append((k, f, a - signed, last + 1))
            yield pd.DataFrame(rows, columns=[key, "form", "start", "end"])

    return texts.select(key, text).mapInPandas(run, f"`{key}` {kind}, form string, start bigint, end bigint")


def repair_spans(hits: DataFrame, key: str, margin: int = 40) -> DataFrame:
    """key, start, end, n of the spans around hits, merged where they overlap."""
    wide = hits.select(key, F.greatest(F.lit(0), F.col("start") - margin).alias("start"), (F.col("end") + margin).alias("end"))
    return merge_intervals(wide, [key], "start", "end")


def evidence_ladder(claims: DataFrame) -> DataFrame:
    """``claims`` with ``evidence``: the first rung that applies, repeated occurrences abstaining together.

    Columns: role, token_page, page, token_supports, adjudicated, token_kind (text, table, figure), quote_hits, quote_length,
    occurrence_id.
    """
    rung = (
        F.when(F.col("role") == "unknown", "abstained")
        .when(F.col("token_page").isNotNull() & (F.col("token_page") != F.col("page")), "abstained")
        .when(F.col("token_supports") & (F.col("token_kind") == "text"), "text_anchored")
        .when(F.col("token_supports") & F.col("adjudicated") & F.col("token_kind").isin("table", "figure"), "visual_adjudicated")
        .when(F.col("token_page").isNotNull() & ~F.col("token_supports"), "abstained")
        .when((F.col("quote_hits") == 1) & (F.col("quote_length") >= 8), "text_anchored")
        .otherwise("abstained")
    )
    ranked = claims.withColumn("evidence", rung)
    twice = ranked.where(F.col("evidence") != "abstained").groupBy("occurrence_id").agg(F.count("*").alias("__n"))
    j = ranked.join(twice, "occurrence_id", "left")
    return j.withColumn("evidence", F.when(F.col("__n") > 1, "abstained").otherwise(F.col("evidence"))).select(*claims.columns, "evidence")
