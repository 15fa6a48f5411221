"""Queries for decisions about records, over the driver's tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestat.operators import decisions as D
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


#: One row for each claim; the decision on it follows from its key, so that every rule is met.
_ITEMS = "(SELECT DISTINCT claim_uid, paper_id, quantity_kind, value, precision_digits FROM claims)"
_STATE = """CASE WHEN claim_uid % 7 = 0 THEN 'unresolved' WHEN claim_uid % 7 = 1 THEN 'unresolved' WHEN claim_uid % 7 = 2 THEN 'dropped' WHEN claim_uid % 7 = 3 THEN 'unresolved'
  WHEN claim_uid % 7 = 4 AND value IS NOT NULL THEN 'unresolved' ELSE 'kept' END"""
_NOTE = """CASE WHEN claim_uid % 7 = 0 THEN 'no decision' WHEN claim_uid % 7 = 1 THEN 'uncertain' WHEN claim_uid % 7 = 3 THEN 'no record'
  WHEN claim_uid % 7 = 4 AND value IS NOT NULL THEN 'keep changed a field' END"""


def _items(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "claims").select("claim_uid", "paper_id", "quantity_kind", "value", "precision_digits").distinct()


def _merged(spark: SparkSession, sf: str) -> DataFrame:
    """Every claim with no, an uncertain, a dropping, an empty, a wrongly keeping, a keeping or a correcting decision."""
    items, r = _items(spark, sf), F.col("claim_uid") % 7
    fields = ["paper_id", "quantity_kind", "value", "precision_digits"]
    changed = F.struct("paper_id", "quantity_kind", (F.col("value") + F.when(r == 5, 0.0).otherwise(1.0)).alias("value"), "precision_digits")
    made = items.where(r != 0).select(
        "claim_uid", F.when(r == 2, "drop").when(r.isin(4, 5), "keep").otherwise("correct").alias("decision"), (r == 1).alias("uncertain"), F.when(r >= 4, changed).alias("corrected")
    )
    return D.apply_decisions(items, made, "claim_uid", fields, ["quantity_kind", "value", "precision_digits"])


@query(f"""SELECT claim_uid, paper_id, quantity_kind, CASE WHEN claim_uid % 7 = 6 THEN value + 1 ELSE value END AS value, precision_digits, {_STATE} AS state, {_NOTE} AS note FROM {_ITEMS}""")
def decision_merge(spark: SparkSession, sf: str) -> DataFrame:
    return _merged(spark, sf)


@query(f"""SELECT claim_uid, CASE WHEN state <> 'dropped' THEN printf('c%03d', row_number() OVER (PARTITION BY paper_id, state = 'dropped' ORDER BY claim_uid)) END AS claim_id, state, note
FROM (SELECT *, {_STATE} AS state, {_NOTE} AS note FROM {_ITEMS})""")
def decision_lineage(spark: SparkSession, sf: str) -> DataFrame:
    return D.decision_lineage(_merged(spark, sf), "claim_uid", ["paper_id"], ["claim_uid"])


@query("""WITH c AS (SELECT DISTINCT record_id, model_type, estimator, se_type FROM contracts), u AS (SELECT model_type, estimator, se_type, count(*) AS n FROM c GROUP BY ALL)
SELECT record_id, n AS n_members, CASE WHEN n >= 5 THEN 'verified' WHEN n >= 2 THEN 'unavailable' ELSE 'unresolved' END AS decision
FROM c JOIN u ON c.model_type IS NOT DISTINCT FROM u.model_type AND c.estimator IS NOT DISTINCT FROM u.estimator AND c.se_type IS NOT DISTINCT FROM u.se_type""")
def decide_once(spark: SparkSession, sf: str) -> DataFrame:
    """Contracts by their operation; each operation with two or more is decided once."""
    operation = ["model_type", "estimator", "se_type"]
    c = table(spark, sf, "contracts").select("record_id", *operation).distinct()
    made = c.groupBy(D.unit_id(operation).alias("unit_id")).agg(F.when(F.count("*") >= 5, "verified").otherwise("unavailable").alias("decision"), F.count("*").alias("n")).where("n >= 2")
    return D.decide_once(c, operation, made).select("record_id", "n_members", "decision")


@query("""SELECT claim_uid, CASE WHEN (source_quote IS NOT NULL)::INT + (legend_quote IS NOT NULL AND legend_quote IS DISTINCT FROM source_quote)::INT + (source_quote IS NULL AND legend_quote IS NULL)::INT * 0
    + (CASE WHEN (source_quote IS NULL) <> (legend_quote IS NULL) THEN 1 ELSE 0 END) < 2 THEN 'fewer than two quotations'
  WHEN source_quote IS NULL OR legend_quote IS NULL OR trim(source_quote, ' ') = '' OR trim(legend_quote, ' ') = '' OR description IS NULL OR NOT contains(source_quote || ' ' || description, legend_quote) THEN 'a quotation is not in the source' END AS problem
FROM (SELECT DISTINCT claim_uid, source_quote, legend_quote, description FROM claims)""")
def competing_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Both quotations of every claim against its quotation and description."""
    c = table(spark, sf, "claims").select("claim_uid", "source_quote", "legend_quote", "description").distinct()
    source = F.concat("source_quote", F.lit(" "), "description")
    return c.select("claim_uid", D.competing_problem(F.array("source_quote", "legend_quote"), source).alias("problem"))


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def curve_rows(spark: SparkSession, sf: str) -> DataFrame:
    only = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return D.curve_rows(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), only, "o_orderkey")


@query("""WITH m AS (SELECT DISTINCT paper_id, field, canonical, quote FROM term_mappings WHERE paper_id IS NOT NULL AND field IS NOT NULL),
f AS (SELECT paper_id, field AS factor, list(DISTINCT canonical) FILTER (canonical IS NOT NULL) AS levels FROM m GROUP BY ALL),
a AS (SELECT paper_id, field AS factor, CASE WHEN length(quote) % 5 = 0 THEN 'none of them' ELSE canonical END AS level, quote AS evidence FROM m WHERE quote IS NOT NULL),
bad AS (SELECT DISTINCT paper_id FROM (SELECT paper_id, factor FROM a GROUP BY ALL HAVING count(*) > 1)),
s AS (SELECT paper_id, string_agg(q, ' ' ORDER BY q) AS source FROM (SELECT DISTINCT paper_id, source_quote AS q FROM claims WHERE source_quote IS NOT NULL) GROUP BY 1),
j AS (SELECT f.paper_id, f.factor, a.level, CASE WHEN a.factor IS NULL THEN 'missing' WHEN a.level IS NULL THEN 'undetermined' WHEN NOT list_contains(f.levels, a.level) THEN 'invalid_level'
  WHEN coalesce(length(trim(evidence, ' ')) >= 20 AND contains(lower(trim(regexp_replace(source, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' ')), lower(trim(regexp_replace(evidence, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' '))), false) THEN 'documented' ELSE 'quote_rejected' END AS status
  FROM f LEFT JOIN (SELECT * FROM a WHERE paper_id NOT IN (SELECT paper_id FROM bad)) a ON a.paper_id = f.paper_id AND a.factor = f.factor LEFT JOIN s ON s.paper_id = f.paper_id)
SELECT paper_id, factor, CASE WHEN status = 'documented' THEN level END AS level, status FROM j""")
def author_levels(spark: SparkSession, sf: str) -> DataFrame:
    """The mapped terms of each paper and field as levels, with the mapping's quotation as evidence."""
    m = table(spark, sf, "term_mappings").where("paper_id is not null and field is not null").select("paper_id", F.col("field").alias("factor"), "canonical", "quote").distinct()
    factors = m.groupBy("paper_id", "factor").agg(F.collect_set("canonical").alias("levels"))
    answers = m.where("quote is not null").select("paper_id", "factor", F.when(F.length("quote") % 5 == 0, "none of them").otherwise(F.col("canonical")).alias("level"), F.col("quote").alias("evidence"))
    sources = table(spark, sf, "claims").groupBy("paper_id").agg(F.array_join(F.array_sort(F.collect_set("source_quote")), " ").alias("source"))
    return D.author_levels(factors, answers, sources, ["paper_id"])


@query("""SELECT family, replica_id, regexp_replace(replica_id, '_[0-9]+$', '') AS family_again, CASE family WHEN 'click' THEN 'frontier' WHEN 'view' THEN 'cheap' ELSE 'unknown' END AS tier FROM (
SELECT family, family || '_' || i AS replica_id FROM (SELECT family, unnest(range(1, least(runs, 4) + 1)) AS i FROM (SELECT event_type AS family, (count(*) % 7)::INT AS runs FROM events GROUP BY 1)))""")
def replica_runs(spark: SparkSession, sf: str) -> DataFrame:
    families = table(spark, sf, "events").groupBy(F.col("event_type").alias("family")).agg((F.count("*") % 7).cast("int").alias("runs"))
    return D.replica_runs(families, cap=4).select("family", "replica_id", D.family_of(F.col("replica_id")).alias("family_again"), D.tier_of(F.col("family"), {"click": "frontier", "view": "cheap"}).alias("tier"))


@query("""SELECT DISTINCT paper_id, id FROM (SELECT paper_id, unnest(claim_ids) AS id FROM contracts UNION ALL SELECT paper_id, claim_id FROM unassigned_claims) WHERE id <> '' AND paper_id IS NOT NULL""")
def bound_ids(spark: SparkSession, sf: str) -> DataFrame:
    """The claims that a packet of a paper asks about, in its analyses or outside of them."""
    a = table(spark, sf, "contracts").select("paper_id", F.struct(F.transform("claim_ids", lambda c: F.struct(c.alias("claim_id"))).alias("quantities")).alias("a"))
    u = table(spark, sf, "unassigned_claims").select("paper_id", F.struct("claim_id").alias("u"))
    packets = a.withColumn("u", F.lit(None).cast(u.schema["u"].dataType)).unionByName(u.withColumn("a", F.lit(None).cast(a.schema["a"].dataType))).where("paper_id is not null")
    return D.bound_ids(packets, "paper_id", [F.transform("a.quantities", lambda q: q["claim_id"]), F.array("u.claim_id")]).distinct()


@query("""SELECT doc_id, i AS line_no, line FROM (SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1))::INT AS i, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL)
WHERE regexp_matches(line, '[.]csv|codebook|/data/')""")
def line_hits(spark: SparkSession, sf: str) -> DataFrame:
    return D.line_hits(table(spark, sf, "documents"), "doc_id", "text", r"[.]csv|codebook|/data/")


@query("""SELECT DISTINCT record_id, left(sha256(to_json([record_id, field, kind, note])::VARCHAR), 16) AS entry_id, field, kind, note FROM (
SELECT record_id, a.field AS field, a.kind AS kind, a.note AS note FROM (SELECT record_id, unnest(ambiguities) AS a FROM contracts) WHERE a IS NOT NULL)""")
def hashed_entries(spark: SparkSession, sf: str) -> DataFrame:
    return D.hashed_entries(table(spark, sf, "contracts"), "record_id", "ambiguities", ["field", "kind", "note"])


_FOCAL = "(SELECT paper_id, arg_min(claim_ids, record_id) AS ids, arg_min(study_id, record_id) AS study_id FROM (SELECT DISTINCT paper_id, record_id, claim_ids, study_id FROM contracts WHERE claim_ids IS NOT NULL AND study_id IS NOT NULL) GROUP BY 1)"


@query(f"""SELECT DISTINCT c.claim_uid, c.claim_id FROM claims c JOIN {_FOCAL} f USING (paper_id) WHERE c.claim_id IS NOT NULL AND (list_contains(f.ids, c.claim_id) OR c.study_id = f.study_id)""")
def focal_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The claims of each paper's first contract, and those of its study."""
    c = table(spark, sf, "contracts").where("claim_ids is not null and study_id is not null").select("paper_id", "record_id", "claim_ids", "study_id").distinct()
    first = c.groupBy("paper_id").agg(F.min_by(F.struct("claim_ids", "study_id"), "record_id").alias("f")).select("paper_id", F.col("f.claim_ids").alias("ids"), "f.study_id")
    rows = table(spark, sf, "claims").where("claim_id is not null").select("claim_uid", "paper_id", "claim_id", "study_id").distinct()
    return D.focal_rows(rows, first, "paper_id", "claim_id", "study_id").select("claim_uid", "claim_id")


@query("SELECT DISTINCT claim_uid, coalesce(abs(try_cast(uncertainty['sd'] AS DOUBLE) - value), abs(value), 'inf'::DOUBLE) AS distance FROM claims")
def row_distances(spark: SparkSession, sf: str) -> DataFrame:
    sd = F.try_element_at("uncertainty", F.lit("sd")).try_cast("double")
    return table(spark, sf, "claims").select("claim_uid", D.row_distance(F.col("value"), sd, F.col("value")).alias("distance")).distinct()


_CHUNKS = """c AS (SELECT DISTINCT paper_id, claim_id, coalesce(location.page, 0) // 4 AS chunk, coalesce(location.page, 0)::BIGINT AS page FROM claims WHERE paper_id IS NOT NULL AND claim_id IS NOT NULL),
n AS (SELECT *, printf('c%03d', row_number() OVER (PARTITION BY paper_id ORDER BY page, chunk, claim_id)) AS new_id FROM c)"""


@query(f"WITH {_CHUNKS} SELECT paper_id, chunk::INT AS chunk, claim_id AS old_id, page, new_id AS claim_id FROM n")
def merged_records(spark: SparkSession, sf: str) -> DataFrame:
    return _chunks(spark, sf)[0]


@query(f"""WITH {_CHUNKS}, r AS (SELECT DISTINCT record_id, paper_id, page // 4 AS chunk, page::BIGINT AS page, claim_ids FROM region_coverage WHERE paper_id IS NOT NULL AND page IS NOT NULL),
e AS (SELECT record_id, paper_id, chunk, unnest(range(0, len(claim_ids))) AS i, unnest(claim_ids) AS claim_id FROM r)
SELECT r.paper_id, 'part' || r.chunk || ':' || r.record_id AS region_id, r.page, coalesce(list(n.new_id ORDER BY e.i) FILTER (n.new_id IS NOT NULL), []) AS claim_ids
FROM r LEFT JOIN e ON e.record_id = r.record_id AND e.paper_id = r.paper_id AND e.chunk = r.chunk LEFT JOIN n ON n.paper_id = e.paper_id AND n.chunk = e.chunk AND n.claim_id = e.claim_id GROUP BY r.paper_id, r.chunk, r.record_id, r.page""")
def merged_regions(spark: SparkSession, sf: str) -> DataFrame:
    return _chunks(spark, sf)[1]


def _chunks(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Claims and regions as chunks of four pages, each counting its pages from its own first."""
    page = F.coalesce("location.page", F.lit(0))
    c = table(spark, sf, "claims").where("paper_id is not null and claim_id is not null").select(
        "paper_id", "claim_id", F.floor(page / 4).cast("int").alias("chunk"), (page % 4).cast("bigint").alias("page"), (F.floor(page / 4) * 4).cast("bigint").alias("first_page")
    ).distinct()
    r = table(spark, sf, "region_coverage").where("paper_id is not null and page is not null").select(
        "paper_id", F.col("record_id").alias("region_id"), F.floor(F.col("page") / 4).cast("int").alias("chunk"), (F.col("page") % 4).cast("bigint").alias("page"),
        (F.floor(F.col("page") / 4) * 4).cast("bigint").alias("first_page"), "claim_ids",
    ).distinct()
    return D.merge_chunks(c, r, "paper_id", "chunk", "first_page")


@query("""SELECT DISTINCT claim_uid, a AS anchor_verified, o AS order_verified, study_id IS NOT NULL AND (comparator IS NULL OR a) AND (legend_quote IS NULL OR o) AS usable FROM (
SELECT *, coalesce(length(source_quote) >= 15 AND contains(lower(trim(regexp_replace(t, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' ')), lower(trim(regexp_replace(source_quote, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' '))), false) AS a,
  coalesce(length(legend_quote) >= 15 AND contains(lower(trim(regexp_replace(t, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' ')), lower(trim(regexp_replace(legend_quote, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' '))), false) AS o
FROM (SELECT *, coalesce(description, '') || ' ' || coalesce(source_quote, '') AS t FROM claims))""")
def direction_flags(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "claims")
    text = F.concat(F.coalesce("description", F.lit("")), F.lit(" "), F.coalesce("source_quote", F.lit("")))
    stated = lambda name: F.when(F.col(name).isNull(), "not_stated").otherwise("stated")
    flags = D.direction_flags(F.col("source_quote"), F.col("legend_quote"), text, stated("comparator"), stated("legend_quote"), F.col("study_id").isNotNull())
    return c.select("claim_uid", *flags).distinct()


@query("""SELECT count(*) AS n_records, min(record_id) AS first_record FROM (SELECT DISTINCT record_id, model_type, estimator, se_type, list_transform(ambiguities, lambda a: {'field': a.field, 'kind': a.kind}) AS m FROM contracts)
GROUP BY model_type, estimator, se_type, m""")
def method_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """Contracts whose method and members are the same, however they are called."""
    members = F.transform("ambiguities", lambda a: F.struct(a["field"].alias("estimator"), a["kind"].alias("model_type"), F.lit(None).cast("string").alias("se_type")))
    c = table(spark, sf, "contracts").select("record_id", "model_type", "estimator", "se_type", members.alias("members")).distinct()
    payload = D.method_payload(["model_type", "estimator", "se_type"], "members")
    return c.groupBy(payload.alias("p")).agg(F.countDistinct("record_id").alias("n_records"), F.min("record_id").alias("first_record")).drop("p")


@query("""SELECT DISTINCT case_id, coalesce(json_type(payload, '$.a') = 'ARRAY' AND len(list_filter(json_extract_string(payload, '$.a[*].claim_id'), lambda x: x <> '')) > 0, false) AS keyed,
sha256(sha256(coalesce(payload, '')) || sha256(coalesce(paper_id, ''))) AS content FROM extraction_cases""")
def keyed_outputs(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "extraction_cases")
    return c.select("case_id", D.keyed_output(F.col("payload"), "$.a", "claim_id").alias("keyed"), D.fingerprint(F.col("payload"), F.col("paper_id")).alias("content")).distinct()


@query("""SELECT DISTINCT factor, level, how, rejection_kind FROM (SELECT DISTINCT field AS factor, canonical AS level, note AS how FROM term_mappings) JOIN (
SELECT DISTINCT field AS factor, canonical AS level, CASE WHEN length(canonical) % 2 = 0 THEN 'operational' ELSE 'irrelevant' END AS rejection_kind FROM term_mappings) USING (factor, level)
WHERE rejection_kind = 'operational' AND factor <> 'model'""")
def eligible_repairs(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "term_mappings")
    levels = t.select(F.col("field").alias("factor"), F.col("canonical").alias("level"), F.col("note").alias("how")).distinct()
    screen = levels.select("factor", "level", F.lit("rejected").alias("verdict"), F.when(F.length("level") % 2 == 0, "operational").otherwise("irrelevant").alias("rejection_kind")).distinct()
    return D.eligible_repairs(levels, screen, t.where("field = 'model'").select(F.col("field").alias("factor")))


@query("""WITH r AS (SELECT paper_id, list(DISTINCT id) AS required FROM (SELECT paper_id, unnest(claim_ids) AS id FROM contracts) WHERE id <> '' GROUP BY 1),
v AS (SELECT paper_id, list(DISTINCT claim_id) AS visible FROM claims WHERE claim_id IS NOT NULL GROUP BY 1),
a AS (SELECT paper_id, list(id) AS audited FROM (SELECT DISTINCT paper_id, id FROM (SELECT paper_id, unnest(claim_ids) AS id FROM contracts) WHERE id <> '' UNION ALL SELECT DISTINCT paper_id, claim_id FROM unassigned_claims WHERE claim_id <> '') GROUP BY 1)
SELECT paper_id, len(audited) = len(list_distinct(audited)) AND len(list_filter(required, lambda x: NOT list_contains(audited, x))) = 0
  AND len(list_filter(audited, lambda x: NOT list_contains(required, x) AND NOT list_contains(visible, x))) = 0 AS covered FROM r JOIN v USING (paper_id) JOIN a USING (paper_id)""")
def audit_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Whether what a paper lists as assigned or not is listed once, holds all that is assigned, and only its claims."""
    listed = table(spark, sf, "contracts").select("paper_id", F.explode("claim_ids").alias("id")).where("id <> ''").distinct()
    loose = table(spark, sf, "unassigned_claims").select("paper_id", F.col("claim_id").alias("id")).where("id <> ''").distinct()
    required = listed.groupBy("paper_id").agg(F.collect_set("id").alias("required"))
    visible = table(spark, sf, "claims").groupBy("paper_id").agg(F.collect_set("claim_id").alias("visible"))
    audited = listed.unionByName(loose).groupBy("paper_id").agg(F.collect_list("id").alias("audited"))
    j = required.join(visible.where("size(visible) > 0"), "paper_id").join(audited, "paper_id")
    return j.select("paper_id", D.audit_covers(F.col("required"), F.col("visible"), F.col("audited")).alias("covered"))


@query("""WITH c AS (SELECT DISTINCT paper_id, claim_id, importance FROM claims WHERE claim_id IS NOT NULL), u AS (SELECT paper_id, min(claim_id) AS claim_id FROM unassigned_claims WHERE conflict_field IS NOT NULL GROUP BY 1),
h AS (SELECT paper_id, min(claim_id) AS claim_id FROM c WHERE importance = 'headline' GROUP BY 1), a AS (SELECT paper_id, min(claim_id) AS claim_id FROM c GROUP BY 1)
SELECT a.paper_id, coalesce(u.claim_id, h.claim_id, a.claim_id) AS claim_id, CASE WHEN u.claim_id IS NOT NULL THEN 'recorded' WHEN h.claim_id IS NOT NULL THEN 'headline' ELSE 'any' END AS rule
FROM a LEFT JOIN u USING (paper_id) LEFT JOIN h USING (paper_id) UNION ALL SELECT paper_id, claim_id, 'recorded' FROM u WHERE claim_id IS NOT NULL AND paper_id NOT IN (SELECT paper_id FROM a WHERE paper_id IS NOT NULL)""")
def first_resolved(spark: SparkSession, sf: str) -> DataFrame:
    """The claim to show of each paper: one recorded in conflict, else a headline, else any."""
    c = table(spark, sf, "claims")
    return D.first_resolved([("recorded", table(spark, sf, "unassigned_claims").where("conflict_field is not null")), ("headline", c.where("importance = 'headline'")), ("any", c)], "paper_id", "claim_id")


@query("SELECT claim_type, importance, state, count(*) AS n FROM (SELECT DISTINCT claim_uid, claim_type, importance, state FROM claims) GROUP BY CUBE (claim_type, importance, state)")
def claim_counts(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "claims").select("claim_uid", "claim_type", "importance", "state").distinct()
    return c.cube("claim_type", "importance", "state").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN lower(trim(p_brand)) END AS factor, CASE WHEN p_partkey % 3 <> 0 THEN lower(trim(p_type)) || '=x' END AS level FROM part")
def parsed_references(spark: SparkSession, sf: str) -> DataFrame:
    text = F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")).otherwise(F.concat(F.lit(" "), "p_brand", F.lit(" = "), "p_type", F.lit("=x")))
    return table(spark, sf, "part").select("p_partkey", D.parse_reference(text).alias("r")).select("p_partkey", "r.factor", "r.level")


@query("""WITH f AS (SELECT DISTINCT finding_id, review, demonstration FROM findings WHERE review IS NOT NULL)
SELECT finding_id, CASE WHEN demonstration IS NOT NULL AND length(review) % 3 <> 0 THEN review END AS response FROM f""")
def cached_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Findings whose review is cached under its digest; a third has another hash than its content, some have no call."""
    f = table(spark, sf, "findings").where("review is not null").select("finding_id", "review", "demonstration").distinct()
    key = D.fingerprint(F.col("finding_id"), F.col("review"), F.col("demonstration"))
    sound = F.sha2(F.when(F.length("review") % 3 == 0, F.lit("changed")).otherwise(F.col("review")), 256)
    cache = f.select(key.alias("fingerprint"), F.col("review").alias("response"), sound.alias("response_hash"), F.col("demonstration").alias("ledger_id"))
    return D.cached_answers(f.select("finding_id", key.alias("fingerprint")), cache).select("finding_id", "response")


@query("""SELECT run_id, CASE WHEN contains(run_id, '/') THEN 'no folder name' ELSE 'missing' END AS problem FROM (
SELECT DISTINCT file_name AS run_id FROM raw_study_lines UNION SELECT DISTINCT study_id FROM fixture_study WHERE study_id IS NOT NULL)
WHERE contains(run_id, '/') OR run_id NOT IN (SELECT study_id FROM claims WHERE study_id IS NOT NULL)""")
def run_problems(spark: SparkSession, sf: str) -> DataFrame:
    runs = table(spark, sf, "raw_study_lines").select(F.col("file_name").alias("run_id")).unionByName(table(spark, sf, "fixture_study").where("study_id is not null").select(F.col("study_id").alias("run_id")))
    return D.run_problems(runs, table(spark, sf, "claims").select(F.col("study_id").alias("run_id")), "run_id")


@query("""SELECT DISTINCT claim_uid, list_transform(regexp_extract_all(coalesce(source_quote, ''), '-?(?:[0-9]+[.]?[0-9]*|[.][0-9]+)'), lambda x: x::DOUBLE) AS numbers, CASE WHEN value IS NOT NULL THEN value END AS shown FROM claims""")
def sentence_numbers(spark: SparkSession, sf: str) -> DataFrame:
    shown = F.concat(F.coalesce("comparator", F.lit("")), F.lit(" "), F.col("value").cast("string"))
    return table(spark, sf, "claims").select("claim_uid", D.numbers_in(F.col("source_quote")).alias("numbers"), D.comparator_number(shown).alias("shown")).distinct()


@query("""WITH c AS (SELECT DISTINCT paper_id, record_id, claim_ids, CASE WHEN length(record_id) % 2 = 0 THEN 'd' ELSE 'r' END AS metric FROM contracts WHERE paper_id IS NOT NULL),
e AS (SELECT paper_id, record_id, metric, unnest(list_distinct(claim_ids)) AS claim_id FROM c), k AS (SELECT DISTINCT paper_id, claim_id, quantity_kind AS metric, value FROM claims WHERE state = 'complete'),
h AS (SELECT paper_id, record_id, metric, count(*) AS n, min(value) AS v FROM e JOIN k USING (paper_id, claim_id, metric) GROUP BY ALL)
SELECT paper_id, record_id, metric, 0.0::DOUBLE AS null_value, CASE WHEN n = 1 THEN v END AS reference, CASE WHEN n = 1 THEN 'claim' ELSE 'none' END AS source FROM c LEFT JOIN h USING (paper_id, record_id, metric)""")
def curve_references(spark: SparkSession, sf: str) -> DataFrame:
    """Every contract on the scale of d or r, with the one complete claim of that kind that it lists."""
    c = table(spark, sf, "contracts").where("paper_id is not null").select("paper_id", "record_id", "claim_ids", F.when(F.length("record_id") % 2 == 0, "d").otherwise("r").alias("metric")).distinct()
    k = table(spark, sf, "claims").where("state = 'complete'").select("paper_id", "claim_id", "quantity_kind", "value").distinct()
    return D.curve_reference(c, k, ["paper_id", "record_id"])


_LEAD = {
    "p_value": "p(?:s|[- ]values?)?", "t": "t", "F": "F", "r": "r", "d": "d(?:z|_z)?",
}
_PLACE = " ".join(
    f"WHEN quantity_kind = '{k}' AND len(regexp_extract_all(q, '(?i)(?:^|[^\\pL\\pM\\p{{Nd}}_])({m}\\s*(?:\\([^)]*\\))?\\s*(?:<=|>=|[<>=≤≥])\\s*)(-?(?:[0-9]+(?:[.][0-9]*)?|[.][0-9]+)(?:[eE][+-]?[0-9]+)?)')) = 1 "
    f"THEN strpos(q, regexp_extract(q, '(?i)(?:^|[^\\pL\\pM\\p{{Nd}}_])({m}\\s*(?:\\([^)]*\\))?\\s*(?:<=|>=|[<>=≤≥])\\s*)(-?(?:[0-9]+(?:[.][0-9]*)?|[.][0-9]+)(?:[eE][+-]?[0-9]+)?)', 0)) - 1 "
    f"+ length(regexp_extract(q, '(?i)(?:^|[^\\pL\\pM\\p{{Nd}}_])({m}\\s*(?:\\([^)]*\\))?\\s*(?:<=|>=|[<>=≤≥])\\s*)(-?(?:[0-9]+(?:[.][0-9]*)?|[.][0-9]+)(?:[eE][+-]?[0-9]+)?)', 0)) "
    f"- length(regexp_extract(q, '(?i)(?:^|[^\\pL\\pM\\p{{Nd}}_])({m}\\s*(?:\\([^)]*\\))?\\s*(?:<=|>=|[<>=≤≥])\\s*)(-?(?:[0-9]+(?:[.][0-9]*)?|[.][0-9]+)(?:[eE][+-]?[0-9]+)?)', 2))"
    for k, m in _LEAD.items()
)


@query(f"""SELECT DISTINCT claim_uid, CASE WHEN length(q) >= 8 AND length(t) - length(replace(t, q, '')) = length(q) THEN strpos(t, q) - 1 + CASE {_PLACE} END END AS position FROM (
SELECT claim_uid, quantity_kind, source_quote AS q, coalesce(description, '') || ' | ' || source_quote AS t FROM claims)""")
def token_positions(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(F.coalesce("description", F.lit("")), F.lit(" | "), "source_quote")
    return table(spark, sf, "claims").select("claim_uid", D.token_position(F.col("quantity_kind"), F.col("source_quote"), text).alias("position")).distinct()
