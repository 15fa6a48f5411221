"""The driver's contract: names, SQL, and the independence of the core from the text subpackage."""

import os
import re
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_outside_imports_the_text_subpackage():
    for folder, _, files in os.walk(os.path.join(ROOT, "lodestat")):
        if os.path.basename(folder) == "llm":
            continue
        for name in files:
            if name.endswith(".py"):
                with open(os.path.join(folder, name), encoding="utf-8") as f:
                    assert not re.search(r"(from|import)\s+lodestat\.llm", f.read()), name


HIDE = """
import sys
class Hidden:
    def find_spec(self, name, path=None, target=None):
        if any(name == h or name.startswith(h + ".") for h in {hidden!r}):
            raise ModuleNotFoundError(f"No module named {{name!r}}", name=name)
sys.meta_path.insert(0, Hidden())
import __spark_entry__ as entry
names = set(entry.queries())
print("p8_ids" in names, "p7_found" in names, "paired_t" in names, len(names))
"""


def _names_without(*hidden):
    run = subprocess.run([sys.executable, "-c", HIDE.format(hidden=hidden)], cwd=ROOT, capture_output=True, text=True, timeout=120)
    return run.stdout.split() if run.returncode == 0 else run.stderr


def test_text_queries_are_left_out_only_where_they_cannot_be_imported():
    assert _names_without("lodestat.llm")[:3] == ["False", "True", "True"]
    assert _names_without("regex")[:3] == ["False", "True", "True"]


def test_a_broken_core_is_an_error():
    assert "lodestat.functions.distributions" in _names_without("lodestat.functions.distributions")


def _same(spark, small, name):
    con = duckdb.connect()
    for file in os.listdir(small):
        con.execute(f"CREATE VIEW {file[:-8]} AS SELECT * FROM read_parquet('{small}/{file}')")
    got, want = entry.queries()[name](spark, small).toPandas(), con.execute(entry.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)

    def norm(df):
        cells = lambda v: "" if v is None or v != v else f"{v:.5g}" if isinstance(v, float) else str(list(v)) if hasattr(v, "tolist") and not isinstance(v, (int, str)) and hasattr(v, "__len__") else f"{float(v):.5g}" if hasattr(v, "__int__") and not isinstance(v, (str, bool)) else str(v)
        return sorted(tuple(map(cells, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None))

    assert norm(got) == norm(want)


@pytest.mark.parametrize("name", ["paired_t", "p3_found", "p4_found", "p6_found", "p7_found", "yuen_paired", "holm", "grade_bands", "grouping_totals", "precision_recall"])
def test_against_sql(spark, small, name):
    _same(spark, small, name)


def test_entry_has_rows(spark, small):
    assert entry.entry(spark).count() == 3
