
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestat.functions import text as T
from lodestat.functions.expr import rounded
from lodestat.operators import evidence, records, resample, sequence
from lodestat.session import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


@query("""SELECT CASE quantity_kind WHEN 'beta' THEN 'coefficient' WHEN 'b' THEN 'coefficient' WHEN 'M' THEN 'mean' WHEN 'average' THEN 'mean' WHEN 'p' THEN 'p_value' WHEN 'p-value' THEN 'p_value' WHEN 'N' THEN 'n'
WHEN 'pct' THEN 'percentage' WHEN 'ci_lower' THEN 'ci_bound' WHEN 'ci_upper' THEN 'ci_bound' ELSE quantity_kind END AS kind, count(*) AS n FROM reader_claims GROUP BY 1""")
def canonical_kinds(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "reader_claims").groupBy(records.canonical_kind(F.col("quantity_kind")).alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT DISTINCT claim_uid, CASE WHEN quantity_kind = 'n' THEN 'descriptive' ELSE quantity_role END AS role FROM claims")
def normal_roles(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "claims").select("claim_uid", records.normal_role(F.col("quantity_kind"), F.col("quantity_role")).alias("role")).distinct()


@query("SELECT event_id, round(ln((value + 1) / (user_id + 1)), 8) AS log_ratio FROM events")
def log_ratio(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select("event_id", F.round(records.pair_value(F.col("value") + 1, (F.col("user_id") + 1).cast("double"), "log_ratio"), 8).alias("log_ratio"))


@query("""SELECT l_suppkey, round(m * -100, 5) AS value, round(s * 100, 5) AS se, round((m + 2 * s) * -100, 5) AS ci_lower, round((m - 2 * s) * -100, 5) AS ci_upper
FROM (SELECT l_suppkey, avg(l_discount) AS m, stddev_samp(l_discount) / sqrt(count(*)) AS s FROM lineitem GROUP BY 1)""")
def rescaled(spark: SparkSession, sf: str) -> DataFrame:
    g = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.avg("l_discount").alias("m"), (F.stddev_samp("l_discount") / F.sqrt(F.count("*"))).alias("s"))
    return rounded(g.select("l_suppkey", *records.linear_transform(F.col("m"), F.col("s"), F.col("m") - 2 * F.col("s"), F.col("m") + 2 * F.col("s"), F.lit(-100.0))), 5)


@query("""SELECT paper_id, claim_uid, printf('c%03d', row_number() OVER (PARTITION BY paper_id ORDER BY coalesce(page, 1e6), claim_uid)) AS number FROM (SELECT DISTINCT paper_id, claim_uid, location.page AS page FROM claims)""")
def renumbered(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "claims").select("paper_id", "claim_uid", F.col("location.page").alias("page")).distinct()
    return records.renumber(c, ["paper_id"], ["page", "claim_uid"]).select("paper_id", "claim_uid", "number")


@query("SELECT DISTINCT claim_uid, paper_id, coalesce(location.page, -1) AS page, location.kind AS kind, location.label AS label FROM claims")
def blinded(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "claims").select("claim_uid", "paper_id", "location", "value", "source_quote")
    return records.blinded(c, ["value", "source_quote"], {"location": ["cell"]}).select("claim_uid", "paper_id", "location.*").withColumn("page", F.coalesce("page", F.lit(-1))).distinct()


@query("""SELECT n_nationkey, n_name, coalesce(len(l), 0) AS n_suppliers, coalesce(list_transform(list_sort(l), lambda x: x)::BIGINT[], []) AS suppliers
FROM nation LEFT JOIN (SELECT s_nationkey, list(s_suppkey) AS l FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey""")
def packets(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("n_nationkey"), "s_suppkey")
    p = records.packets(table(spark, sf, "nation"), s, ["n_nationkey"], ["s_suppkey"], "s")
    return p.select("n_nationkey", "n_name", F.size("s").cast("bigint").alias("n_suppliers"), F.col("s.s_suppkey").alias("suppliers"))


@query("""SELECT event_id, [json_extract_string(props, '$.k')] AS parts FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL""")
def coerced_lists(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", records.coerce_list(F.col("props")).alias("parts")).where(F.size("parts") > 0)


@query("""SELECT paper_id, CASE WHEN count(DISTINCT model_type) = 1 THEN min(model_type) END AS model_type, count(DISTINCT model_type) > 1 AS conflict FROM contracts WHERE model_type IS NOT NULL GROUP BY 1""")
def policies(spark: SparkSession, sf: str) -> DataFrame:
    return records.parsers(table(spark, sf, "contracts").where("model_type is not null"), "paper_id", "model_type")


@query("""SELECT paper_id, claim_id, added FROM (SELECT DISTINCT paper_id, claim_id, false AS added FROM claims UNION ALL
SELECT DISTINCT u.paper_id, u.claim_id, true FROM unassigned_claims u WHERE u.claim_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM claims c WHERE c.paper_id = u.paper_id AND c.claim_id = u.claim_id))""")
def completed(spark: SparkSession, sf: str) -> DataFrame:
    have = table(spark, sf, "claims").select("paper_id", "claim_id").distinct()
    need = table(spark, sf, "unassigned_claims").where("claim_id is not null").select("paper_id", "claim_id").distinct()
    return records.complete_checks(have, need, ["paper_id", "claim_id"])


@query("""SELECT record_id, coalesce(len(list_filter(ambiguities, lambda a: a IS NOT NULL)), 0) AS n_ambiguities, coalesce(len(list_filter(ambiguities, lambda a: a.kind = 'source_identity')), 0) > 0 AS abstain FROM (SELECT record_id, any_value(ambiguities) AS ambiguities FROM contracts GROUP BY 1)""")
def ambiguity_gate(spark: SparkSession, sf: str) -> DataFrame:
    return records.ambiguity_gate(table(spark, sf, "contracts").dropDuplicates(["record_id"]), "record_id")


@query("""SELECT DISTINCT claim_uid, CASE WHEN quantity_kind = 'percentage' AND (value < 0 OR value > 100) THEN 'out of 0..100' END AS problem FROM claims""")
def unit_problems(spark: SparkSession, sf: str) -> DataFrame:
    m = F.when(F.col("quantity_kind") == "percentage", 100).otherwise(1)
    return table(spark, sf, "claims").select("claim_uid", records.percent_problem(F.col("quantity_kind"), F.col("value"), m).alias("problem")).distinct()


@query("""WITH m AS (SELECT paper_id, field, lower(trim(source_text)) AS t, min(canonical) AS c, count(DISTINCT canonical) AS n FROM term_mappings GROUP BY 1, 2, 3),
i AS (SELECT DISTINCT paper_id, 'outcome' AS field, outcome AS text FROM contracts WHERE outcome IS NOT NULL)
SELECT i.paper_id, i.field, i.text, CASE WHEN n = 1 THEN c END AS canonical, CASE WHEN n IS NULL THEN 'unmapped' WHEN n > 1 THEN 'ambiguous' ELSE 'mapped' END AS state FROM i LEFT JOIN m ON i.paper_id = m.paper_id AND i.field = m.field AND lower(trim(i.text)) = m.t""")
def alias_lookup(spark: SparkSession, sf: str) -> DataFrame:
    i = table(spark, sf, "contracts").where("outcome is not null").select("paper_id", F.lit("outcome").alias("field"), F.col("outcome").alias("text")).distinct()
    return records.alias_lookup(i, table(spark, sf, "term_mappings"), "text")


_FOCAL = "(SELECT paper_id, max(value) AS focal_value FROM claims WHERE quantity_kind = 't' GROUP BY 1)"


@query(f"""WITH b AS (SELECT DISTINCT k.paper_id, k.analysis_id, c.claim_uid, c.value FROM (SELECT paper_id, analysis_id, unnest(claim_ids) AS claim_id FROM contracts) k JOIN claims c ON c.paper_id = k.paper_id AND c.claim_id = k.claim_id),
g AS (SELECT b.paper_id, b.analysis_id, count(*) AS n_claims FROM b JOIN {_FOCAL} f ON f.paper_id = b.paper_id WHERE abs(value - focal_value) <= greatest(1e-6 * greatest(abs(value), abs(focal_value)), 1e-9) GROUP BY 1, 2)
SELECT * FROM g WHERE paper_id IN (SELECT paper_id FROM g GROUP BY 1 HAVING count(*) = 1)""")
def focal_anchor(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "claims")
    bridge = table(spark, sf, "contracts").select("paper_id", "analysis_id", F.explode("claim_ids").alias("claim_id"))
    b = bridge.join(c, ["paper_id", "claim_id"]).select("paper_id", "analysis_id", "claim_uid", "value").distinct()
    f = c.where("quantity_kind = 't'").groupBy("paper_id").agg(F.max("value").alias("focal_value"))
    return records.focal_anchor(b, f, "paper_id")


@query("""SELECT record_id, coalesce(n, 0) AS n_rules, CASE WHEN n = 1 THEN e END AS estimator FROM (SELECT DISTINCT record_id, model_type FROM contracts) i LEFT JOIN (SELECT model_type, count(DISTINCT estimator) AS n, min(estimator) AS e FROM contracts GROUP BY 1) r ON r.model_type = i.model_type""")
def one_rule(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "contracts")
    return records.exactly_one(c.select("record_id", "model_type").distinct(), c.select("model_type", "estimator"), ["model_type"], "estimator").drop("model_type")


@query("""WITH g AS (SELECT event_type, user_id, avg(value) AS m, CASE WHEN count(*) >= 2 THEN max(value) - min(value) END AS r FROM events GROUP BY 1, 2)
SELECT event_type, round(max(r), 6) AS within_range, round(max(m) - min(m), 6) AS between_range FROM g GROUP BY 1""")
def dispersion(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(records.dispersion(table(spark, sf, "events"), "event_type", "user_id", "value"))


@query("SELECT user_id, count(*) AS n, max(value) - min(value) > greatest(1e-8 * greatest(abs(min(value)), abs(max(value))), 1e-12) AS disagree FROM events GROUP BY 1")
def disagreement(spark: SparkSession, sf: str) -> DataFrame:
    return records.disagreement(table(spark, sf, "events"), ["user_id"], "value")


@query("""WITH p AS (SELECT a.claim_uid, a.study_id AS s1, b.study_id AS s2, a.importance AS i1, b.importance AS i2, a.state AS t1, b.state AS t2 FROM (SELECT DISTINCT claim_uid, paper_id, claim_id, study_id, importance, state FROM claims) a
JOIN (SELECT DISTINCT claim_uid, study_id, importance, state FROM claims) b ON b.claim_uid = a.claim_uid + 1)
SELECT 'study_id' AS field, count_if(s1 IS DISTINCT FROM s2)::BIGINT AS n_disputed FROM p UNION ALL SELECT 'importance', count_if(i1 IS DISTINCT FROM i2)::BIGINT FROM p UNION ALL SELECT 'state', count_if(t1 IS DISTINCT FROM t2)::BIGINT FROM p""")
def disputed_fields(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "claims").select("claim_uid", "paper_id", "claim_id", "study_id", "importance", "state").distinct()
    b = table(spark, sf, "claims").select((F.col("claim_uid") - 1).alias("claim_uid"), F.struct("study_id", "importance", "state").alias("b")).distinct()
    pairs = c.select("claim_uid", F.struct("study_id", "importance", "state").alias("a")).join(b, "claim_uid")
    return records.disputed_fields(pairs, ["study_id", "importance", "state"])


@query("""SELECT o_orderpriority, (p AND s) AS accepted, list_filter([CASE WHEN NOT p THEN 'price' END, CASE WHEN NOT s THEN 'status' END], lambda x: x IS NOT NULL) AS blockers
FROM (SELECT o_orderpriority, bool_and(o_totalprice > 0) AS p, bool_and(o_orderstatus = 'F') AS s FROM orders GROUP BY 1)""")
def acceptance(spark: SparkSession, sf: str) -> DataFrame:
    rules = {"price": F.col("o_totalprice") > 0, "status": F.col("o_orderstatus") == "F"}
    return records.acceptance(table(spark, sf, "orders"), rules, ["o_orderpriority"])


@query("SELECT file_name, max(n) AS max_repeats FROM (SELECT file_name, raw_line, count(*) - 1 AS n FROM raw_study_lines GROUP BY 1, 2) GROUP BY 1")
def line_repeats(spark: SparkSession, sf: str) -> DataFrame:
    return records.repeats(table(spark, sf, "raw_study_lines"), ["file_name"], "raw_line")


@query("SELECT l_returnflag, list_sort([l_linestatus, l_returnflag]) AS pair, list_sort(list(DISTINCT l_linenumber)) AS members FROM lineitem GROUP BY 1, 2")
def identity_groups(spark: SparkSession, sf: str) -> DataFrame:
    return records.identity_groups(table(spark, sf, "lineitem"), ["l_returnflag"], "l_linestatus", "l_returnflag", "l_linenumber")


@query("""WITH k AS (SELECT record_id, paper_id, any_value(claim_ids) AS ids FROM term_mappings GROUP BY 1, 2), e AS (SELECT record_id, paper_id, ids[i] AS id, i FROM (SELECT record_id, paper_id, ids, unnest(range(1, len(ids) + 1)) AS i FROM k))
SELECT k.record_id, coalesce(l, []) AS claim_ids FROM k LEFT JOIN (SELECT e.record_id, list(e.id ORDER BY e.i) AS l FROM e WHERE EXISTS (SELECT 1 FROM claims c WHERE c.paper_id = e.paper_id AND c.claim_id = e.id) GROUP BY 1) x ON x.record_id = k.record_id""")
def eligible_ids(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "term_mappings").dropDuplicates(["record_id", "paper_id"]).select("record_id", "paper_id", "claim_ids")
    return records.eligible_ids(t, "record_id", "claim_ids", table(spark, sf, "claims"), "claim_id", "paper_id").select("record_id", "claim_ids")


@query("SELECT paper_id, region_id, y_min, y_max FROM (SELECT paper_id, kind AS region_id, min(page)::DOUBLE - 2 AS y_min, max(page)::DOUBLE + 2 AS y_max FROM region_coverage GROUP BY 1, 2)")
def value_band(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "region_coverage").select("paper_id", F.col("kind").alias("region_id"), F.col("page").cast("double").alias("y"))
    return records.value_band(r, ["paper_id", "region_id"], "y", 2.0)


@query("""SELECT event_id, round(before, 4) AS before, before + value <= 200 AS fits FROM (SELECT event_id, value, coalesce(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM events)""")
def within_budget(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(records.within_budget(table(spark, sf, "events"), "user_id", ["ts", "event_id"], "value", 200.0).select("event_id", "before", "fits"), 4)


@query("""SELECT DISTINCT record_id, CASE WHEN model_type IS NULL OR trim(model_type) = '' THEN NULL WHEN model_type IN ('paired t test') THEN 'paired' WHEN model_type = 'independent-samples t test' THEN CASE WHEN nc = 0 THEN 'two_group' END
WHEN model_type = 'correlation' THEN CASE WHEN np <= 1 AND nc = 0 THEN 'correlation' END WHEN model_type = 'linear regression' THEN CASE WHEN np = 1 AND nc = 0 THEN 'correlation' END END AS design
FROM (SELECT record_id, model_type, coalesce(len(predictors), 0) AS np, coalesce(len(covariates), 0) AS nc FROM contracts)""")
def designs(spark: SparkSession, sf: str) -> DataFrame:
    """The design of every contract by its model and the number of its predictors and covariates."""
    size = lambda c: F.when(F.col(c).isNotNull(), F.size(c))
    c = table(spark, sf, "contracts").select("record_id", T.design_of(F.col("model_type"), size("predictors"), size("covariates")).alias("design"))
    return c.distinct()


@query()
def linkage_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Which readings of the two readers may be of one quantity, with their support."""
    place = [F.col("location.page").alias("page"), F.col("location.kind").alias("loc_kind"), F.col("location.label").alias("label"), F.col("location.cell").alias("cell")]
    c = table(spark, sf, "claims").select(F.col("claim_uid").alias("id"), "paper_id", F.col("quantity_kind").alias("kind"), *place, F.regexp_replace("study_id", "[^0-9]", "").alias("study_id"), "description", "source_quote").distinct()
    study = F.nullif(F.regexp_extract("description", r"(?i)\b(?:study|experiment|exp\.?|s)\s*(\d)\b", 1), F.lit(""))
    place[2] = F.lit(None).cast("string").alias("label")  # the second reader names places in another way
    r = table(spark, sf, "reader_claims").select(F.col("reader_uid").alias("id"), "paper_id", F.col("quantity_kind").alias("kind"), *place, study.alias("study_id"), "description", F.lit(None).cast("string").alias("source_quote")).distinct()
    return records.linkage_candidates(c, r).select("a_id", "b_id", F.round("score", 6).alias("score"))


@query()
def resampled(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation")
    return records.resampled_rows(n.select("n_nationkey", "n_name"), "n_nationkey", resample.resample_index(spark, 25, 50, 7), 3)


@query()
def perturbed(spark: SparkSession, sf: str) -> DataFrame:
    return records.perturbed_rows(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), "c_custkey", "c_acctbal", 11, 5.0)


@query("SELECT user_id, count(*) AS n_sessions, sum(n)::BIGINT AS n_events FROM (SELECT user_id, i, count(*) AS n FROM (SELECT user_id, sum(o) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS i FROM (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 3600 SECOND THEN 0 ELSE 1 END AS o FROM events)) GROUP BY 1, 2) GROUP BY 1")
def sessions(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    s = sequence.session_windows(e, ["user_id"], "ts", "3600 seconds")
    return s.groupBy("user_id").agg(F.count("*").alias("n_sessions"), F.sum("n").alias("n_events"))


@query("""SELECT doc_id, i::INTEGER AS page, p AS page_text FROM (SELECT doc_id, unnest(range(1, len(string_split(text, chr(12))) + 1)) AS i, unnest(string_split(text, chr(12))) AS p FROM documents WHERE text IS NOT NULL)""")
def paged_text(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.pages(table(spark, sf, "documents").where("text is not null"), "doc_id", "text")


@query("""SELECT DISTINCT c.claim_uid, c.location.page AS page, r.n AS n_regions FROM claims c JOIN (SELECT paper_id, page, count(DISTINCT region_id) AS n FROM region_coverage GROUP BY 1, 2) r ON r.paper_id = c.paper_id AND c.location.page BETWEEN r.page AND r.page WHERE c.location.page IS NOT NULL""")
def page_regions(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "claims").select("claim_uid", "paper_id", F.col("location.page").alias("page")).distinct().where("page is not null")
    r = table(spark, sf, "region_coverage").groupBy("paper_id", F.col("page").alias("region_page")).agg(F.countDistinct("region_id").alias("n_regions"))
    return sequence.band_join(c, r, "paper_id", "page", "region_page", 0, 0).select("claim_uid", "page", "n_regions")
