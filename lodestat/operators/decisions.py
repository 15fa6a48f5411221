"""Decisions about records: merging, lineage, groups that are decided once, evidence, fallbacks, chunks and cached answers."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestat.functions.expr import digest
from lodestat.operators.records import renumber

# Null values of the effect scales.
NULL_VALUES = {"mean_difference": 0.0, "d": 0.0, "dz": 0.0, "r": 0.0, "log_ratio": 0.0, "log_odds_ratio": 0.0, "odds_ratio": 1.0, "risk_ratio": 1.0, "risk_difference": 0.0}
#: A quotation is located from this length on.
LEAST_QUOTE = 15


def plain(c: Column) -> Column:
    """Text in lower case with single spaces, for quotations."""
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def apply_decisions(items: DataFrame, decisions: DataFrame, key: str, fields: list[str], substantive: list[str]) -> DataFrame:
    """Each item with its decision folded in: key, ``fields``, state (``kept``, ``dropped``, ``unresolved``) and note.

    ``decisions`` has key, decision (keep, drop, correct), uncertain and a struct ``corrected`` of ``fields`` (null: none), one row for each key at most.
    No or an uncertain decision, and one that neither drops nor brings a record, leaves the item unresolved.  A ``keep`` must
    not change a ``substantive`` field; nulls compare as equal.  Unresolved and dropped items stay as they are.
    """
    d = decisions.select(key, F.col("decision").alias("__d"), F.coalesce("uncertain", F.lit(False)).alias("__u"), F.col("corrected").alias("__c"))
    j = items.join(d, key, "left")
    same = reduce(lambda a, b: a & b, [F.col(f"__c.{f}").eqNullSafe(F.col(f)) for f in substantive], F.lit(True))
    note = (
        F.when(F.col("__d").isNull(), "no decision").when(F.col("__u"), "uncertain").when(F.col("__d") == "drop", None)
        .when(F.col("__c").isNull(), "no record").when((F.col("__d") == "keep") & ~same, "keep changed a field")
    )
    state = F.when(note.isNotNull(), "unresolved").when(F.col("__d") == "drop", "dropped").otherwise("kept")
    j = j.withColumn("note", note).withColumn("state", state)
    return j.select(key, *[F.when(F.col("state") == "kept", F.col(f"__c.{f}")).otherwise(F.col(f)).alias(f) for f in fields], "state", "note")


def decision_lineage(merged: DataFrame, key: str, by: list[str], order: list[str]) -> DataFrame:
    """key, claim_id, state, note of every item: those not dropped get their new number in order, the dropped none."""
    numbered = renumber(merged.where("state <> 'dropped'"), by, order, "claim_id").select(key, "claim_id")
    return merged.select(key, "state", "note").join(numbered, key, "left").select(key, "claim_id", "state", "note")


def decide_once(items: DataFrame, operation: list[str], decisions: DataFrame) -> DataFrame:
    """Items with ``unit_id`` of their operation, ``n_members`` that share it and the unit's ``decision``.

    ``operation`` compares null-safely; ``decisions`` has unit_id and decision.  Units without a decision are ``unresolved``.
    """
    unit = unit_id(operation)
    counts = items.groupBy(unit.alias("unit_id")).agg(F.count("*").alias("n_members"))
    known = counts.join(decisions.select("unit_id", "decision"), "unit_id", "left").withColumn("decision", F.coalesce("decision", F.lit("unresolved")))
    return items.withColumn("unit_id", unit).join(known, "unit_id")


def unit_id(operation: list[str]) -> Column:
    """The id of an operation: a digest of its columns."""
    return digest(*[F.col(c).cast("string") for c in operation], length=16)


def competing_problem(quotes: Column, source: Column) -> Column:
    """What is wrong with the evidence for an unbound item: it needs two distinct quotations, none blank and all in the source; else null."""
    distinct = F.array_distinct(F.coalesce(quotes, F.array().cast("array<string>")))
    lost = F.exists(distinct, lambda q: q.isNull() | (F.trim(q) == "") | ~F.coalesce(F.contains(source, q), F.lit(False)))
    return F.when(F.size(distinct) < 2, "fewer than two quotations").when(lost, "a quotation is not in the source")


def curve_rows(results: DataFrame, reference_only: DataFrame, key: str) -> DataFrame:
    """Results without those that only serve as a reference."""
    return results.join(reference_only.select(key).distinct(), key, "left_anti")


def author_levels(factors: DataFrame, answers: DataFrame, sources: DataFrame, by: list[str], least: int = 20) -> DataFrame:
    """by, factor, level, status of every factor: what the authors did, if an answer's quotation is in their text.

    ``factors`` has by, factor, levels (array); ``answers`` by, factor, level, evidence; ``sources`` by, source.  Status: ``documented``,
    ``missing``, ``undetermined`` (no level), ``invalid_level`` or ``quote_rejected`` (shorter than ``least`` or not in the source).  A
    group with two answers to one factor, or one to none of its factors, has all answers rejected as ``missing``.
    """
    named = answers.join(factors.select(*by, "factor", F.lit(True).alias("__known")), [*by, "factor"], "left")
    bad = named.groupBy(*by, "factor").agg(F.count("*").alias("__n"), F.bool_and(F.coalesce("__known", F.lit(False))).alias("__k")).where("__n > 1 or not __k").select(*by).distinct()
    usable = answers.join(bad, by, "left_anti").withColumn("__a", F.lit(True))
    j = factors.join(usable, [*by, "factor"], "left").join(sources, by, "left")
    found = (F.length(F.trim("evidence")) >= least) & F.contains(plain(F.col("source")), plain(F.col("evidence")))
    status = (
        F.when(F.col("__a").isNull(), "missing").when(F.col("level").isNull(), "undetermined").when(~F.array_contains("levels", F.col("level")), "invalid_level")
        .when(F.coalesce(found, F.lit(False)), "documented").otherwise("quote_rejected")
    )
    return j.withColumn("status", status).select(*by, "factor", F.when(F.col("status") == "documented", F.col("level")).alias("level"), "status")


def replica_runs(families: DataFrame, cap: int | None = None, only: list[str] | None = None) -> DataFrame:
    """family, replica_id of each run of each family (family, runs), at most ``cap`` for each, and of ``only`` if given."""
    runs = F.col("runs") if cap is None else F.least(F.col("runs"), F.lit(cap))
    out = families.where(runs >= 1).select("family", F.explode(F.sequence(F.lit(1), runs)).alias("__i")).select("family", F.concat("family", F.lit("_"), F.col("__i").cast("string")).alias("replica_id"))
    return out if only is None else out.where(F.col("replica_id").isin(*only))


def family_of(replica_id: Column, recorded: Column | None = None) -> Column:
    """The recorded family, else the id without its number."""
    own = F.regexp_replace(replica_id, r"^(.+)_\d+$", "$1")
    return own if recorded is None else F.coalesce(F.nullif(recorded, F.lit("")), own)


def tier_of(route: Column, tiers: Mapping[str, str]) -> Column:
    """The tier of a route by a fixed mapping; others are unknown."""
    out = F.lit("unknown")
    for k, v in sorted(tiers.items()):
        out = F.when(route == k, v).otherwise(out)
    return out


def bound_ids(df: DataFrame, key: str, blocks: list[Column]) -> DataFrame:
    """key, id: every id in any of the array ``blocks``, once each; null and empty ids are none."""
    ids = F.flatten(F.array(*[F.coalesce(b, F.array().cast("array<string>")) for b in blocks]))
    return df.select(key, F.explode(ids).alias("id")).where("id <> ''").distinct()


def line_hits(df: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    """key, line_no (from 1), line of the lines that a pattern matches."""
    lines = df.select(key, F.posexplode(F.split(text, "\n")).alias("__p", "line"))
    return lines.where(F.col("line").rlike(pattern)).select(key, (F.col("__p") + 1).alias("line_no"), "line")


def hashed_entries(df: DataFrame, key: str, entries: str, fields: list[str]) -> DataFrame:
    """key, entry_id, ``fields`` of the structs in an array; the id is a digest of key and fields, so equal entries have one."""
    each = df.select(key, F.explode(entries).alias("__e")).where(F.col("__e").isNotNull()).select(key, *[F.col(f"__e.{f}").alias(f) for f in fields])
    return each.select(key, digest(F.col(key), *[F.col(f) for f in fields], length=16).alias("entry_id"), *fields).distinct()


def focal_rows(rows: DataFrame, focal: DataFrame, by: str, id_: str, group: str) -> DataFrame:
    """Rows whose id is among the focal ids of their ``by``, or whose group is the focal one.  ``focal`` has by, ids (array), group."""
    ids = focal.select(by, F.explode("ids").alias(id_)).distinct().withColumn("__i", F.lit(True))
    groups = focal.where(F.col(group).isNotNull()).select(by, group).distinct().withColumn("__g", F.lit(True))
    j = rows.join(ids, [by, id_], "left").join(groups, [by, group], "left")
    return j.where(F.col("__i") | F.col("__g")).select(*rows.columns)


def row_distance(reported: Column, replicated: Column, recorded: Column) -> Column:
    """How far a row is off: its values' distance, else the recorded one, else infinitely."""
    return F.coalesce(F.abs(replicated - reported), F.abs(recorded), F.lit(float("inf")))


def merge_chunks(records: DataFrame, regions: DataFrame, by: str, chunk: str, first_page: str) -> tuple[DataFrame, DataFrame]:
    """Records and regions of chunks as one: pages counted from the document's first, ids numbered anew in order of page and old id.

    ``records`` has by, chunk, page, claim_id (unique in the chunk) and ``first_page`` of its chunk; ``regions`` by, chunk, region_id,
    page, claim_ids, ``first_page``.  Gives (by, chunk, old_id, page, claim_id) and (by, region_id, page, claim_ids); ids of a region that
    no record has are left out, null and empty lists stay empty.
    """
    at = records.select(by, chunk, F.col("claim_id").alias("old_id"), (F.col("page") + F.col(first_page)).alias("page"))
    numbered = renumber(at, [by], ["page", chunk, "old_id"], "claim_id")
    listed = regions.select(by, chunk, "region_id", (F.col("page") + F.col(first_page)).alias("page"), F.posexplode_outer("claim_ids").alias("__p", "old_id"))
    known = listed.join(numbered.select(by, chunk, "old_id", "claim_id"), [by, chunk, "old_id"], "left")
    ids = F.array_sort(F.collect_list(F.when(F.col("claim_id").isNotNull(), F.struct("__p", "claim_id"))))
    merged = known.groupBy(by, chunk, "region_id", "page").agg(F.transform(ids, lambda x: x["claim_id"]).alias("claim_ids"))
    return numbered, merged.select(by, F.concat(F.lit("part"), F.col(chunk).cast("string"), F.lit(":"), "region_id").alias("region_id"), "page", "claim_ids")


def direction_flags(quote: Column, order_quote: Column, text: Column, direction: Column, author_order: Column, bound: Column) -> list[Column]:
    """anchor_verified, order_verified and usable of a stated direction: what is stated must be quoted from the text, and bound to the right columns."""
    located = lambda q: F.coalesce((F.length(q) >= LEAST_QUOTE) & F.contains(plain(text), plain(q)), F.lit(False))
    a, o = located(quote), located(order_quote)
    usable = F.coalesce(bound, F.lit(False)) & ((direction == "not_stated") | a) & ((author_order == "not_stated") | o)
    return [a.alias("anchor_verified"), o.alias("order_verified"), F.coalesce(usable, F.lit(False)).alias("usable")]


def method_payload(fields: list[str], members: str | None = None) -> Column:
    """A digest of what a plan does, whatever it is called: its method fields, and those of its members in order."""
    own = F.struct(*fields) if members is None else F.struct(*fields, F.transform(members, lambda m: F.struct(*[m[f].alias(f) for f in fields])).alias("members"))
    return F.sha2(F.to_json(own, {"ignoreNullFields": "false"}), 256)


def keyed_output(payload: Column, path: str, id_: str) -> Column:
    """Whether any entry of a JSON list has an id that is neither null nor empty; false for what is no such list."""
    entries = F.try_variant_get(F.try_parse_json(payload), path, "array<variant>")
    keyed = F.exists(entries, lambda e: F.coalesce(F.try_variant_get(e, f"$.{id_}", "string"), F.lit("")) != "")
    return F.coalesce(keyed, F.lit(False))


def fingerprint(*contents: Column) -> Column:
    """A digest of contents, missing ones being empty."""
    return F.sha2(F.concat(*[F.sha2(F.coalesce(c, F.lit("")), 256) for c in contents]), 256)


def eligible_repairs(levels: DataFrame, screen: DataFrame, attempted: DataFrame, kinds: tuple[str, ...] = ("operational", "nonstandard")) -> DataFrame:
    """Levels (factor, level, how) that the screen rejected for one of ``kinds``, of factors not attempted before."""
    bad = screen.where((F.col("verdict") == "rejected") & F.col("rejection_kind").isin(*kinds)).select("factor", "level", "rejection_kind")
    return levels.join(bad, ["factor", "level"]).join(attempted.select("factor").distinct(), "factor", "left_anti")


def audit_covers(required: Column, visible: Column, audited: Column) -> Column:
    """Whether the audited ids are distinct, hold all required ones and no other than visible ones; a null list covers nothing."""
    once = F.size(audited) == F.size(F.array_distinct(audited))
    inside = (F.size(F.array_except(required, audited)) == 0) & (F.size(F.array_except(audited, F.array_union(required, visible))) == 0)
    return F.coalesce(once & inside, F.lit(False))


def first_resolved(candidates: list[tuple[str, DataFrame]], by: str, value: str) -> DataFrame:
    """by, value, rule from the first candidate query that has a row for ``by`` (the smallest value of several)."""
    parts = [df.where(F.col(value).isNotNull()).select(by, value, F.lit(i).alias("__rank"), F.lit(rule).alias("rule")) for i, (rule, df) in enumerate(candidates)]
    union = reduce(lambda a, b: a.unionByName(b), parts)
    return union.groupBy(by).agg(F.min(F.struct("__rank", value, "rule")).alias("__m")).select(by, F.col(f"__m.{value}").alias(value), "__m.rule")


def parse_reference(c: Column) -> Column:
    """``factor=level`` as struct<factor, level> in lower case without outer blanks; null without ``=``."""
    norm = lambda x: F.lower(F.trim(x))
    return F.when(F.contains(c, F.lit("=")), F.struct(norm(F.substring_index(c, "=", 1)).alias("factor"), norm(F.regexp_replace(c, r"^[^=]*=", "")).alias("level")))


def cached_answers(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """``wanted`` (with fingerprint) and the cached response of the same fingerprint whose content still has its recorded hash; others miss.

    ``cache`` has fingerprint (unique), response, response_hash, ledger_id.
    """
    sound = cache.where(F.col("ledger_id").isNotNull() & (F.sha2("response", 256) == F.col("response_hash"))).select("fingerprint", "response", "ledger_id")
    return wanted.join(sound, "fingerprint", "left")


def run_problems(runs: DataFrame, present: DataFrame, run_id: str) -> DataFrame:
    """run_id, problem: ids that are no plain folder name, and runs that are not there."""
    there = present.select(run_id).distinct().withColumn("__there", F.lit(True))
    j = runs.select(run_id).distinct().join(there, run_id, "left")
    bad = F.col(run_id).isNull() | F.col(run_id).rlike(r"[/\\]") | F.col(run_id).isin("", ".", "..")
    return j.select(run_id, F.when(bad, "no folder name").when(F.col("__there").isNull(), "missing").alias("problem")).where("problem is not null")


def numbers_in(c: Column) -> Column:
    """The numbers of a sentence as doubles, in order; null text has none."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(-?(?:\d+\.?\d*|\.\d+))"), F.lit(1))
    return F.transform(found, lambda x: x.try_cast("double"))


def comparator_number(c: Column) -> Column:
    """A number after an optional leading comparator; null for other text."""
    return F.trim(F.regexp_replace(c, r"^\s*[<>=≤≥]+\s*", "")).try_cast("double")


def curve_reference(contracts: DataFrame, claims: DataFrame, by: list[str]) -> DataFrame:
    """by, metric, null_value, reference, source: the scale of a contract's curve and the one value reported on it.

    ``contracts`` has by, metric, claim_ids; ``claims`` has claim_id, quantity_kind, value and the columns of ``by`` that both have.  The reference
    is the value of the only listed claim of that kind; with none or several there is none.  Metrics that are no effect scale give no row.
    """
    scales = F.create_map(*[F.lit(x) for kv in sorted(NULL_VALUES.items()) for x in kv])
    c = contracts.withColumn("null_value", scales[F.col("metric")]).where("null_value is not null")
    shared = [k for k in by if k in claims.columns]
    listed = c.select(*by, "metric", F.explode(F.array_distinct("claim_ids")).alias("claim_id"))
    own = claims.select(*shared, "claim_id", F.col("quantity_kind").alias("metric"), "value")
    hits = listed.join(own, [*shared, "claim_id", "metric"]).groupBy(*by, "metric").agg(F.count("*").alias("__n"), F.min("value").alias("__v"))
    j = c.select(*by, "metric", "null_value").join(hits, [*by, "metric"], "left")
    one = F.coalesce(F.col("__n") == 1, F.lit(False))
    return j.select(*by, "metric", "null_value", F.when(one, F.col("__v")).alias("reference"), F.when(one, "claim").otherwise("none").alias("source"))


#: How a statistic of a kind is introduced; its number follows.
MARKERS = {"p_value": r"p(?:s|[- ]values?)?", "t": "t", "F": "F", "r": "r", "d": r"d(?:z|_z)?"}
_NUMBER = r"(-?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?)"


def token_position(kind: Column, quote: Column, text: Column, least: int = 8) -> Column:
    """Where the number of a quoted statistic stands in a text (from 0); null unless the quotation occurs once and its statistic once in it.

    The place does not depend on the value that was read, only on the kind's marker.
    """
    once = (F.length(quote) >= least) & (F.length(text) - F.length(F.replace(text, quote, F.lit(""))) == F.length(quote))
    at = F.lit(None).cast("int")
    for name, marker in sorted(MARKERS.items()):
        lead = rf"(?i)(?<!\w){marker}\s*(?:\([^)]*\))?\s*(?:<=|>=|[<>=≤≥])\s*"
        whole = F.regexp_extract(quote, lead + _NUMBER, 0)
        offset = F.locate("\x00", F.regexp_replace(quote, f"({lead}){_NUMBER}", "$1\x00")) - 1
        at = F.when(kind == name, F.when((F.regexp_count(quote, F.lit(lead + _NUMBER)) == 1) & (whole != ""), offset)).otherwise(at)
    return F.when(F.coalesce(once, F.lit(False)), F.instr(text, quote) - 1 + at)


def table_legend(legend: Column, literal: Column, adjudicated: Column, value: Column, precision: Column, text: Column) -> Column:
    """The legend of a table marker as it stands in the text: as quoted, or, if a reading of the image bears it out, with a damaged ``<``.

    The damaged form is the marker, ``p``, ``b`` or a replacement character, and a number of the claim's value and precision.
    """
    pattern = F.concat(F.lit(r"(?<![*†‡])"), F.regexp_replace(literal, r"([\\.\[\]{}()*+?^$|])", r"\\$1"), F.lit("(?![*†‡])\\s*p\\s*[b�]\\s*(?:\\d+(?:\\.\\d+)?|\\.\\d+)"))
    damaged = F.filter(
        F.regexp_extract_all(text, pattern, F.lit(0)),
        lambda m: (F.regexp_extract(m, r"(\d*\.?\d+)$", 1).try_cast("double") == value) & (F.length(F.regexp_extract(m, r"\.(\d+)$", 1)) == precision),
    )
    whole = F.when(F.contains(text, legend) & (legend != ""), legend)
    return F.coalesce(whole, F.when(adjudicated & (legend != ""), F.get(damaged, F.lit(0))))
