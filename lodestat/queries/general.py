"""Queries p1, p3, p4, p6 and p7 over the tables of TESTDATA.md, with SQL where it can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestat.operators import drift, nested, profile, referential
from lodestat.session import table
from lodestat.sources import rejects

Query = Callable[[SparkSession, str], DataFrame]

#: The tables with loads: numeric and categorical columns to compare.
LOADED = {
    "fixture_study": (["baseline", "outcome", "age"], ["condition", "attention_check"]),
    "study1": (["age", "closeness"], ["condition"]),
}


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    changed = drift.file_changes(table(spark, sf, "artifact_files"))
    return changed.select("file_id", "change_kind", "field_before", "field_after").distinct()


def p1_records(spark: SparkSession, sf: str) -> DataFrame:
    return drift.consistent_records(table(spark, sf, "artifact_files"))


def p1_versions(spark: SparkSession, sf: str) -> DataFrame:
    return drift.schema_versions(table(spark, sf, "artifact_files"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    out = None
    for name, (numeric, categorical) in LOADED.items():
        breaks = profile.load_breaks(
            table(spark, sf, name), study="study_id", load="load_id", at="loaded_at", numeric=numeric, categorical=categorical
        ).select(F.lit(name).alias("table_name"), "column_name", "load_id", "issue")
        out = breaks if out is None else out.unionByName(breaks)
    return out


def p3_profile(spark: SparkSession, sf: str) -> DataFrame:
    out = None
    for name, (numeric, categorical) in LOADED.items():
        found = profile.profile_loads(table(spark, sf, name), load="load_id", numeric=numeric, categorical=categorical)
        found = found.select(F.lit(name).alias("table_name"), "*")
        out = found if out is None else out.unionByName(found)
    return out


def p3_coverage(spark: SparkSession, sf: str) -> DataFrame:
    out = None
    for name, (numeric, categorical) in LOADED.items():
        found = profile.coverage_changes(table(spark, sf, name), study="study_id", load="load_id", at="loaded_at", columns=[*numeric, *categorical])
        found = found.select(F.lit(name).alias("table_name"), "*")
        out = found if out is None else out.unionByName(found)
    return out


def p3_expressions(spark: SparkSession, sf: str) -> DataFrame:
    out = None
    for name, (numeric, categorical) in LOADED.items():
        counts = profile.value_counts(table(spark, sf, name), [], [*numeric, *categorical])
        found = profile.induce_expressions(counts, ["column_name"], "value", "n").select(F.lit(name).alias("table_name"), "*")
        out = found if out is None else out.unionByName(found)
    return out.drop("form", "key")


def references(spark: SparkSession, sf: str) -> DataFrame:
    """Every reference to a claim once: ref_table, record_id, paper_id, claim_id, first_loaded."""
    out = None
    for name in ("contracts", "term_mappings", "unassigned_claims", "region_coverage"):
        t = table(spark, sf, name)
        ids = F.col("claim_id") if name == "unassigned_claims" else F.explode("claim_ids")
        first = t.groupBy("record_id").agg(F.min("loaded_at").alias("first_loaded"))
        refs = t.select("record_id", "paper_id", ids.alias("claim_id")).where(F.col("claim_id") != "").distinct()
        refs = refs.join(first, "record_id").select(F.lit(name).alias("ref_table"), "*")
        out = refs if out is None else out.unionByName(refs)
    return out


def _orphans(spark: SparkSession, sf: str) -> DataFrame:
    found = referential.find_orphans(
        references(spark, sf), table(spark, sf, "claims"), key=["paper_id", "claim_id"],
        ref_time="first_loaded", parent_time="loaded_at", parent_deleted=F.col("withdrawn_at").isNotNull(),
    )
    return found.select("ref_table", F.date_format("first_loaded", "yyyy-MM").alias("ref_month"), "record_id", "claim_id", "status")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return _orphans(spark, sf).distinct()


def p4_report(spark: SparkSession, sf: str) -> DataFrame:
    return _orphans(spark, sf).distinct().groupBy("ref_table", "ref_month", "status").agg(F.count("*").alias("n_orphans"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return nested.nested_keys(table(spark, sf, "contracts"), table(spark, sf, "extraction_cases"), table(spark, sf, "claims"))


def p6_options(spark: SparkSession, sf: str) -> DataFrame:
    return nested.flatten_options(table(spark, sf, "contracts")).distinct()


def p6_cells(spark: SparkSession, sf: str) -> DataFrame:
    return nested.flatten_cells(table(spark, sf, "extraction_cases")).distinct()


def p6_uncertainty(spark: SparkSession, sf: str) -> DataFrame:
    return nested.flatten_uncertainty(table(spark, sf, "claims")).distinct()


def _judged(spark: SparkSession, sf: str) -> DataFrame:
    return rejects.judge_records(table(spark, sf, "raw_study_lines"), table(spark, sf, "study_layouts"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return _judged(spark, sf).where(F.col("reason").isNotNull()).select("line_id", "reason").distinct()


def p7_study1(spark: SparkSession, sf: str) -> DataFrame:
    return rejects.typed_rows(_judged(spark, sf), "study1", table(spark, sf, "study_layouts"))


def p7_fixture_study(spark: SparkSession, sf: str) -> DataFrame:
    return rejects.typed_rows(_judged(spark, sf), "fixture_study", table(spark, sf, "study_layouts"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        p1_found, p1_records, p1_versions, p3_found, p3_profile, p3_coverage, p3_expressions, p4_found, p4_report, p6_found, p6_options, p6_cells,
        p6_uncertainty, p7_found, p7_study1, p7_fixture_study,
    )
}

_REFS = """
refs AS (
  SELECT 'contracts' AS ref_table, record_id, paper_id, unnest(claim_ids) AS claim_id, loaded_at FROM contracts
  UNION ALL SELECT 'term_mappings', record_id, paper_id, unnest(claim_ids), loaded_at FROM term_mappings
  UNION ALL SELECT 'unassigned_claims', record_id, paper_id, claim_id, loaded_at FROM unassigned_claims
  UNION ALL SELECT 'region_coverage', record_id, paper_id, unnest(claim_ids), loaded_at FROM region_coverage
), firsts AS (
  SELECT 'contracts' AS ref_table, record_id, min(loaded_at) AS first_loaded FROM contracts GROUP BY 2
  UNION ALL SELECT 'term_mappings', record_id, min(loaded_at) FROM term_mappings GROUP BY 2
  UNION ALL SELECT 'unassigned_claims', record_id, min(loaded_at) FROM unassigned_claims GROUP BY 2
  UNION ALL SELECT 'region_coverage', record_id, min(loaded_at) FROM region_coverage GROUP BY 2
), folded AS (
  SELECT paper_id, claim_id, min(loaded_at) AS first_claim, max(CASE WHEN withdrawn_at IS NOT NULL THEN 1 ELSE 0 END) AS gone
  FROM claims GROUP BY 1, 2
), orphans AS (
  SELECT DISTINCT r.ref_table, strftime(f.first_loaded, '%Y-%m') AS ref_month, r.record_id, r.claim_id,
    CASE WHEN c.claim_id IS NULL THEN 'missing' WHEN c.gone = 1 THEN 'deleted' WHEN c.first_claim > f.first_loaded THEN 'late' END AS status
  FROM refs r JOIN firsts f USING (ref_table, record_id) LEFT JOIN folded c ON c.paper_id = r.paper_id AND c.claim_id = r.claim_id
  WHERE r.claim_id <> ''
)"""

_P3 = """
SELECT DISTINCT '{t}' AS table_name, column_name, load_id, issue FROM (
  WITH long AS (
    SELECT study_id, load_id, loaded_at, unnest([{names}]) AS column_name, unnest([{values}]) AS v, unnest([{kinds}]) AS is_number FROM {t}
  ), f AS (SELECT study_id, arg_min(load_id, (loaded_at, load_id)) AS first_id FROM {t} GROUP BY 1),
  a AS (
    SELECT study_id, column_name, is_number, load_id, count(*) AS n, count(*) - count(v) AS n0, min(CASE WHEN is_number THEN v::DOUBLE END) AS lo,
      max(CASE WHEN is_number THEN v::DOUBLE END) AS hi, avg(CASE WHEN is_number THEN v::DOUBLE END) AS m, stddev_samp(CASE WHEN is_number THEN v::DOUBLE END) AS s
    FROM long GROUP BY ALL
  ), b AS (SELECT a.* FROM a JOIN f ON a.study_id = f.study_id AND a.load_id = f.first_id),
  x AS (
    SELECT l.study_id, l.column_name, l.load_id, l.v, l.is_number, b.m AS bm, b.s AS bs, b.n - b.n0 AS bn,
      CASE WHEN l.is_number THEN l.v::DOUBLE BETWEEN b.lo - (b.hi - b.lo) AND b.hi + (b.hi - b.lo)
           ELSE l.v IN (SELECT k.v FROM long k WHERE k.study_id = l.study_id AND k.load_id = f.first_id AND k.column_name = l.column_name AND k.v IS NOT NULL) END AS near
    FROM long l JOIN f ON l.study_id = f.study_id AND l.load_id <> f.first_id
    JOIN b ON b.study_id = l.study_id AND b.column_name = l.column_name WHERE l.v IS NOT NULL AND (b.n > b.n0 OR NOT l.is_number)
  ), g AS (
    SELECT study_id, column_name, load_id, avg(v::DOUBLE) AS m, stddev_samp(v::DOUBLE) AS s, count(*) AS n, any_value(bm) AS bm, any_value(bs) AS bs
    FROM x WHERE is_number AND near GROUP BY ALL
  ), bv AS (
    SELECT l.study_id, l.column_name, l.v, count(*) AS c FROM long l JOIN f ON l.study_id = f.study_id AND l.load_id = f.first_id
    WHERE l.v IS NOT NULL AND NOT is_number GROUP BY ALL
  ), bt AS (SELECT study_id, column_name, sum(c) AS t FROM bv GROUP BY ALL),
  kt AS (SELECT study_id, column_name, load_id, count(*) AS t FROM x WHERE NOT is_number AND near GROUP BY ALL),
  kv AS (SELECT study_id, column_name, load_id, v, count(*) AS c FROM x WHERE NOT is_number AND near GROUP BY ALL)
  SELECT a.column_name, a.load_id, 'nulls' AS issue FROM a JOIN b USING (study_id, column_name)
    WHERE a.load_id <> b.load_id AND abs(a.n0 * b.n - b.n0 * a.n) * 10 > a.n * b.n
  UNION ALL SELECT column_name, load_id, 'foreign' FROM x WHERE NOT near
  UNION ALL SELECT column_name, load_id, 'shift' FROM g WHERE n >= 2 AND (abs(m - bm) > 0.4 * bs OR s > 1.6 * bs OR bs > 1.6 * s)
  UNION ALL SELECT kt.column_name, kt.load_id, 'shift' FROM kt JOIN bv USING (study_id, column_name) JOIN bt USING (study_id, column_name)
    LEFT JOIN kv ON kv.study_id = kt.study_id AND kv.column_name = kt.column_name AND kv.load_id = kt.load_id AND kv.v = bv.v
    WHERE kt.t >= 2 AND abs(coalesce(kv.c, 0) * bt.t - bv.c * kt.t) * 5 > bt.t * kt.t
)"""


def _p3_sql() -> str:
    parts = []
    for name, (numeric, categorical) in LOADED.items():
        columns = [*numeric, *categorical]
        parts.append(
            _P3.format(
                t=name, names=", ".join(f"'{c}'" for c in columns), values=", ".join(f"{c}::VARCHAR" for c in columns),
                kinds=", ".join(str(c in numeric).lower() for c in columns),
            )
        )
    return " UNION ALL ".join(parts)


def _p3_long(t: str) -> str:
    """The cells of a table's columns as text: column_name, value, with the row's study, load and time."""
    columns = [c for group in LOADED[t] for c in group]
    names, values = ", ".join(f"'{c}'" for c in columns), ", ".join(f"{c}::VARCHAR" for c in columns)
    return f"SELECT study_id, load_id, loaded_at, unnest([{names}]) AS column_name, unnest([{values}]) AS value FROM {t}"


def _nested(start: str, pattern) -> str:
    for i, (_, java, _, name) in enumerate(profile.CLASSES):
        start = pattern(start, f"chr({0xE001 + i})", java, name)
    return start


def _p3_induced(t: str) -> str:
    """CTEs that end in ``picked``: every distinct value of each column with the expression that was chosen for it."""
    exact = _nested("value", lambda x, symbol, java, _: f"regexp_replace({x}, '{java}', {symbol}, 'g')")
    runs = _nested("exact", lambda x, symbol, *_: f"regexp_replace({x}, {symbol} || '+', {symbol}, 'g')")
    count = lambda text, i: f"(length({text}) - length(replace({text}, chr({0xE001 + i}), '')))"
    coded = " + ".join(f"{count('exact', i)} * {c[2]}" for i, c in enumerate(profile.CLASSES))
    lengths = " + ".join(count("runs", i) for i in range(len(profile.CLASSES)))
    escape = lambda x: rf"regexp_replace({x}, '([\\.\[\]{{}}()*+?^$|])', '\\\1', 'g')"
    as_runs = _nested(escape("runs"), lambda x, symbol, _, name: f"replace({x}, {symbol}, '{name}+')")
    as_lengths = _nested(escape("exact"), lambda x, symbol, _, name: f"replace({x}, {symbol}, '{name}')")
    return f"""
long AS ({_p3_long(t)}), c0 AS (SELECT column_name, value, count(*) AS n FROM long WHERE value IS NOT NULL GROUP BY ALL),
c1 AS (SELECT *, {exact} AS exact FROM c0), c2 AS (SELECT *, {runs} AS runs FROM c1),
c3 AS (SELECT *, {coded} AS coded, length(value) * {profile.LITERAL_BITS} + {profile.LENGTH_BITS} AS lit,
  length(runs) * {profile.CLASS_BITS} + {profile.LENGTH_BITS} AS written, ({lengths}) * {profile.LENGTH_BITS} AS lens FROM c2),
e AS (SELECT column_name, runs, exact, sum(lit) AS l, max(written) + max(lens) + sum(coded) AS x, sum(coded) + sum(lens) AS u, max(written) AS w FROM c3 GROUP BY ALL),
r AS (SELECT column_name, runs, sum(least(l, x)) AS finer, max(w) + sum(u) AS coarse FROM e GROUP BY ALL),
picked AS (
  SELECT *, CASE level WHEN 'runs' THEN {as_runs} WHEN 'lengths' THEN {as_lengths} ELSE {escape('value')} END AS expression,
    level || ' ' || CASE level WHEN 'runs' THEN runs WHEN 'lengths' THEN exact ELSE value END AS key FROM (
    SELECT c3.*, CASE WHEN coarse <= finer THEN 'runs' WHEN l <= x THEN 'literal' ELSE 'lengths' END AS level,
      CASE WHEN coarse <= finer THEN coarse WHEN l <= x THEN lit ELSE x END / 100 AS bits
    FROM c3 JOIN e USING (column_name, runs, exact) JOIN r USING (column_name, runs)))"""


def _p3_expressions(t: str) -> str:
    return f"""SELECT * FROM (WITH {_p3_induced(t)} SELECT '{t}' AS table_name, column_name, level, any_value(expression) AS expression, count(*) AS n_values,
      sum(n)::BIGINT AS n_rows, any_value(bits) AS bits FROM picked GROUP BY column_name, level, key)"""


def _p3_profile(t: str) -> str:
    numeric = ", ".join(f"'{c}'" for c in LOADED[t][0])
    number = f"CASE WHEN column_name IN ({numeric}) THEN value::DOUBLE END"
    return f"""SELECT * FROM (WITH {_p3_induced(t)},
      whole AS (SELECT column_name, sum(n) AS all_n FROM c0 GROUP BY 1),
      held AS (SELECT column_name, key FROM picked JOIN whole USING (column_name) GROUP BY column_name, key, all_n HAVING sum(n) >= {profile.MIN_SHARE}::DOUBLE * all_n),
      good AS (SELECT column_name, value, true AS conforms FROM picked SEMI JOIN held USING (column_name, key))
      SELECT '{t}' AS table_name, column_name, load_id, count(*) AS n_rows, count(*) - count(value) AS n_null, count(DISTINCT value) AS n_distinct,
        min({number}) AS min_value, max({number}) AS max_value, avg({number}) AS mean, stddev_samp({number}) AS sd,
        count(value) FILTER (conforms IS NULL) AS n_nonconforming
      FROM long LEFT JOIN good USING (column_name, value) GROUP BY column_name, load_id)"""


def _p3_coverage(t: str) -> str:
    return f"""SELECT * FROM (WITH {_p3_induced(t)}, first AS (SELECT study_id, arg_min(load_id, (loaded_at, load_id)) AS first_id FROM {t} GROUP BY 1),
      k AS (SELECT study_id, load_id, column_name, key, count(*) AS n FROM long JOIN picked USING (column_name, value) GROUP BY ALL),
      share AS (SELECT *, n / sum(n) OVER (PARTITION BY study_id, load_id, column_name) AS share FROM k),
      base AS (SELECT study_id, column_name, key, share FROM share JOIN first USING (study_id) WHERE load_id = first_id),
      later AS (SELECT share.* FROM share JOIN first USING (study_id) WHERE load_id <> first_id),
      pairs AS (SELECT DISTINCT l.study_id, l.load_id, l.column_name, b.key FROM later l JOIN base b USING (study_id, column_name)
        UNION SELECT study_id, load_id, column_name, key FROM later SEMI JOIN base USING (study_id, column_name)),
      off AS (SELECT load_id, column_name, key, abs(coalesce(l.share, 0) - coalesce(b.share, 0)) AS change
        FROM pairs LEFT JOIN later l USING (study_id, load_id, column_name, key) LEFT JOIN base b USING (study_id, column_name, key))
      SELECT '{t}' AS table_name, column_name, load_id, min(expression) AS form_expression, max(change) AS change FROM (
        SELECT *, max(change) OVER (PARTITION BY load_id, column_name) AS top FROM off) JOIN (SELECT DISTINCT column_name, key, expression FROM picked) USING (column_name, key)
      WHERE change = top GROUP BY column_name, load_id)"""


_CELLS = """
lists AS (
  SELECT case_id, list_name, CASE json_type(l) WHEN 'OBJECT' THEN json_array(l) WHEN 'ARRAY' THEN l END AS l FROM (
    SELECT case_id, 'a' AS list_name, json_extract(payload, '$.a') AS l FROM extraction_cases
    UNION ALL SELECT case_id, 'b', json_extract(payload, '$.b') FROM extraction_cases)
), cells AS (
  SELECT case_id, list_name, i AS pos_outer, json_extract(l, '$[' || i || ']') AS e
  FROM (SELECT case_id, list_name, l, unnest(range(0, json_array_length(l)::BIGINT)) AS i FROM lists WHERE l IS NOT NULL)
)"""

_OPTIONS = """
amb AS (SELECT record_id, ambiguities, unnest(range(0, len(ambiguities))) AS i FROM contracts),
opt AS (SELECT record_id, i, ambiguities[i + 1] AS a, unnest(range(0, len(ambiguities[i + 1].options))) AS j FROM amb WHERE ambiguities[i + 1].options IS NOT NULL),
options AS (SELECT DISTINCT record_id, i AS pos_outer, j AS pos_inner, a.field AS field, a.kind AS kind, a.options[j + 1] AS option FROM opt WHERE a.options[j + 1] IS NOT NULL)"""

_FIELD = '(?:"(?:[^"]|"")*"|[^",]*)'
_P7_RULES = f"""
WITH l AS (SELECT layout, list(column_type ORDER BY pos) AS types FROM study_layouts GROUP BY 1),
r AS (
  SELECT line_id, file_name, layout, line_no, types, regexp_full_match(raw_line, '{_FIELD}(?:,{_FIELD})*') AS ok, regexp_extract_all(raw_line || ',', '({_FIELD}),', 1) AS f
  FROM raw_study_lines JOIN l USING (layout)
), v AS (
  SELECT *, list_transform(f, lambda x: trim(CASE WHEN starts_with(x, '"') THEN replace(substr(x, 2, len(x) - 2), '""', '"') ELSE x END, ' ')) AS w FROM r
), j AS (
  SELECT line_id, file_name, layout, line_no, w, f, CASE WHEN NOT ok THEN 'quoting' WHEN len(f) <> len(types) THEN 'column_count' WHEN len(list_filter(range(1, len(w) + 1), lambda i:
    w[i] NOT IN ('', 'NA') AND CASE types[i] WHEN 'integer' THEN NOT regexp_full_match(w[i], '{rejects.GRAMMAR["integer"]}')
      WHEN 'number' THEN NOT regexp_full_match(w[i], '{rejects.GRAMMAR["number"]}') WHEN 'flag' THEN NOT regexp_full_match(w[i], '{rejects.GRAMMAR["flag"]}') ELSE false END)) > 0
    THEN 'bad_value' END AS reason FROM v
)"""
_P7 = f"{_P7_RULES} SELECT DISTINCT line_id, reason FROM j WHERE reason IS NOT NULL"


def _p7_typed(layout: str, columns: list[tuple[str, str]]) -> str:
    """The valid rows of a layout: its columns in order with their types of study_layouts."""
    kinds = {"integer": "BIGINT", "number": "DOUBLE", "flag": "INTEGER"}
    cells = []
    for i, (name, kind) in enumerate(columns, 1):
        raw = f"CASE WHEN starts_with(f[{i}], '\"') THEN replace(substr(f[{i}], 2, len(f[{i}]) - 2), '\"\"', '\"') ELSE f[{i}] END"
        cells.append(f"nullif({raw}, '') AS {name}" if kind == "text" else f"TRY_CAST(nullif(w[{i}], 'NA') AS {kinds[kind]}) AS {name}")
    return f"{_P7_RULES} SELECT line_id, file_name, line_no, {', '.join(cells)} FROM j WHERE reason IS NULL AND layout = '{layout}'"


SQL: dict[str, str] = {
    "p3_found": _p3_sql(),
    "p3_profile": " UNION ALL ".join(map(_p3_profile, LOADED)),
    "p3_coverage": " UNION ALL ".join(map(_p3_coverage, LOADED)),
    "p3_expressions": " UNION ALL ".join(map(_p3_expressions, LOADED)),
    "p4_found": f"WITH {_REFS} SELECT * FROM orphans WHERE status IS NOT NULL",
    "p4_report": f"WITH {_REFS} SELECT ref_table, ref_month, status, count(*) AS n_orphans FROM orphans WHERE status IS NOT NULL GROUP BY ALL",
    "p7_found": _P7,
    "p7_study1": _p7_typed("study1", [("pid", "text"), ("condition", "text"), ("age", "integer"), ("closeness", "number")]),
    "p7_fixture_study": _p7_typed(
        "fixture_study", [("pid", "text"), ("condition", "text"), ("baseline", "number"), ("outcome", "number"), ("attention_check", "flag"), ("age", "integer")]
    ),
    "p6_options": f"WITH {_OPTIONS} SELECT * FROM options",
    "p6_cells": f"""WITH {_CELLS} SELECT DISTINCT case_id, list_name, pos_outer, e->>'$.claim_id' AS claim_id, e->>'$.location.page' AS page,
      e->>'$.location.kind' AS kind, e->>'$.location.label' AS label, e->>'$.location.cell' AS cell FROM cells""",
    "p6_uncertainty": """SELECT DISTINCT claim_uid, entry, value FROM (
      SELECT claim_uid, unnest(map_keys(uncertainty)) AS entry, unnest(map_values(uncertainty)) AS value FROM claims) WHERE value IS NOT NULL""",
    "p6_found": f"""WITH {_CELLS}, {_OPTIONS}
      SELECT 'option' AS child, record_id AS parent_id, 'ambiguities' AS list_name, pos_outer, pos_inner FROM options WHERE record_id IS NOT NULL
      UNION SELECT 'cell', case_id, list_name, pos_outer, -1 FROM cells WHERE e->>'$.location.cell' <> ''
      UNION SELECT 'sd', claim_uid::VARCHAR, '', -1, -1 FROM claims WHERE uncertainty['sd'] IS NOT NULL""",
}
