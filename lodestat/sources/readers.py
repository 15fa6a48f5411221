"""Sources: delimited text, workbooks, labelled containers, artifacts, logs, pages and word layouts."""

from __future__ import annotations

import importlib.util
import json
import os
import re
import tomllib
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

from lodestat.functions.expr import na_to_null

SEPARATORS = {".csv": ",", ".tsv": "\t"}


def contained(root: str, path: str) -> str:
    """The real path under ``root``; leaving it is an error."""
    full, base = os.path.realpath(os.path.join(root, path)), os.path.realpath(root)
    if os.path.commonpath([full, base]) != base:
        raise ValueError(f"{path} lies outside of {root}")
    return full


def read_delimited(spark: SparkSession, path: str, sep: str | None = None, header: bool = True, na: bool = True) -> DataFrame:
    """Delimited text with every column as text; texts that stand for missing values are null unless ``na`` is off."""
    sep = sep or SEPARATORS.get(os.path.splitext(path)[1].lower(), ",")
    df = spark.read.option("header", header).option("sep", sep).option("inferSchema", False).option("multiLine", True).option("escape", '"').csv(path)
    return df.select(*[na_to_null(F.col(f"`{c}`")).alias(c) for c in df.columns]) if na else df


def sniff_separator(spark: SparkSession, path: str) -> str | None:
    """Tab, then comma, if the first lines have at least two columns by it; None for prose."""
    head = [r.value for r in spark.read.text(path).limit(20).collect() if r.value.strip()]
    for sep in ("\t", ","):
        if head and all(len(line.split(sep)) >= 2 for line in head):
            return sep
    return None


def two_row_header(spark: SparkSession, path: str, sep: str = ",") -> list[str]:
    """Column names of a table with a merged header: where over 30 per cent of row 0 is blank, its labels are filled
    forward and row 1 names the columns below them."""
    rows = spark.read.option("header", False).option("sep", sep).csv(path).limit(2).collect()
    top = [v or "" for v in rows[0]]
    if len(rows) < 2 or sum(not v.strip() for v in top) <= 0.3 * len(top):
        return top
    names, label = [], ""
    for group, name in zip(top, rows[1]):
        label = group.strip() or label
        names.append(f"{label}_{name}".strip("_") if label else name or "")
    return names


class StataSource(DataSource):
    """``spark.read.format("lodestat_stata").load(path)``: Stata files, codes rather than labels, as text columns."""

    @classmethod
    def name(cls) -> str:
        return "lodestat_stata"

    def schema(self) -> StructType:
        import pandas as pd

        with pd.read_stata(self.options["path"], iterator=True, convert_categoricals=False) as reader:
            columns = list(reader.read(1).columns)
        return StructType([StructField(c, StringType()) for c in columns])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _StataReader(self.options["path"], [f.name for f in schema])


class _StataReader(DataSourceReader):
    CHUNK = 50_000

    def __init__(self, path: str, columns: list[str]):
        self.path, self.columns = path, columns

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import pandas as pd

        for chunk in pd.read_stata(self.path, chunksize=self.CHUNK, convert_categoricals=False):
            for row in chunk[self.columns].itertuples(index=False):
                yield tuple(None if v is None or v != v else str(v) for v in row)


def _optional(module: str):
    if importlib.util.find_spec(module) is None:
        raise ImportError(f"this source needs the package {module}")
    return importlib.import_module(module)


def read_workbook(spark: SparkSession, path: str, sheet: str | None = None, header: int = 0) -> DataFrame:
    """A sheet of a workbook as text columns; needs openpyxl."""
    book = _optional("openpyxl").load_workbook(path, read_only=True, data_only=True)
    rows = list((book[sheet] if sheet else book.worksheets[0]).iter_rows(values_only=True))
    names = [str(v) if v is not None else f"column_{i}" for i, v in enumerate(rows[header])]
    return spark.createDataFrame([tuple(None if v is None else str(v) for v in r) for r in rows[header + 1 :]], StructType([StructField(n, StringType()) for n in names]))


def read_spss(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, str]]:
    """An SPSS file as text columns, and its column labels; needs pyreadstat."""
    data, meta = _optional("pyreadstat").read_sav(path, apply_value_formats=False)
    df = spark.createDataFrame([tuple(None if v != v or v is None else str(v) for v in r) for r in data.itertuples(index=False)], StructType([StructField(c, StringType()) for c in data.columns]))
    return df, dict(zip(meta.column_names, meta.column_labels))


def read_table(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame | None:
    """A table by its suffix; None for prose."""
    suffix = os.path.splitext(path)[1].lower()
    if suffix in SEPARATORS:
        return read_delimited(spark, path)
    if suffix == ".txt":
        sep = sniff_separator(spark, path)
        return None if sep is None else read_delimited(spark, path, sep)
    if suffix == ".parquet":
        return spark.read.parquet(path)
    if suffix in (".json", ".jsonl"):
        return spark.read.json(path, multiLine=suffix == ".json")
    if suffix in (".xlsx", ".xls"):
        return read_workbook(spark, path, sheet)
    if suffix == ".sav":
        return read_spss(spark, path)[0]
    if suffix == ".dta":
        spark.dataSource.register(StataSource)
        return spark.read.format("lodestat_stata").load(path)
    raise ValueError(f"unknown format {suffix}")


def catalog(spark: SparkSession, paths: list[str]) -> DataFrame:
    """file, column_name, kind, error of several files; a file that cannot be read is a row with its error."""
    rows = []
    for p in paths:
        try:
            df = read_table(spark, p)
            rows += [(p, None, None, "prose")] if df is None else [(p, c, t, None) for c, t in df.dtypes]
        except Exception as e:  # recorded, not raised
            rows.append((p, None, None, type(e).__name__))
    return spark.createDataFrame(rows, "file string, column_name string, kind string, error string")


def identifier_columns(df: DataFrame, candidates: list[str]) -> list[str]:
    """The candidates that are unique and never null, by one aggregation."""
    n = F.count("*")
    row = df.agg(n.alias("__n"), *[F.countDistinct(c).alias(f"d_{c}") for c in candidates], *[F.count(c).alias(f"k_{c}") for c in candidates]).first()
    return [c for c in candidates if row[f"d_{c}"] == row[f"k_{c}"] == row["__n"]]


def read_artifact(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A JSON artifact (an object or a list) under a schema; a missing file is an empty table of that schema."""
    if not os.path.exists(path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path, multiLine=True)


def read_events(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines under a schema."""
    return spark.read.schema(schema).json(path)


def read_glob(spark: SparkSession, pattern: str, schema: StructType | str) -> DataFrame:
    """JSON files of a pattern with ``file_path``."""
    df = spark.read.schema(schema).json(pattern, multiLine=True)
    return df.select("*", F.col("_metadata.file_path").alias("file_path"))


@lru_cache(maxsize=64)
def _toml(text: str) -> str:
    return json.dumps(tomllib.loads(text))


def read_config(path: str) -> dict:
    """A TOML file, parsed once for each text."""
    with open(path, encoding="utf-8") as f:
        return json.loads(_toml(f.read()))


# Kinds of files by suffix.
FILE_KINDS = {"data_files": (".csv", ".tsv", ".xlsx", ".xls", ".sav", ".dta"), "original_code": (".r", ".py", ".do", ".sps", ".rmd"), "pdf": (".pdf",), "codebook": (".txt", ".md", ".docx")}


def assemble_manifest(paths: list[str], edited: dict | None = None) -> dict:
    """A manifest of files by kind, the first of equal names winning; hand-edited fields are kept."""
    out: dict[str, list[str]] = {k: [] for k in FILE_KINDS}
    seen = set()
    for p in sorted(paths):
        name, suffix = os.path.basename(p), os.path.splitext(p)[1].lower()
        kind = next((k for k, s in FILE_KINDS.items() if suffix in s), None)
        if kind and name not in seen:
            seen.add(name)
            out[kind].append(p)
    return {**out, **{k: v for k, v in (edited or {}).items() if v}}


def decode_results(raw: DataFrame, specs: DataFrame) -> DataFrame:
    """Result rows with their factor levels by spec_id and typed helpers: n only if whole, alpha .05 by default."""
    names = {re.sub("[^a-z0-9]+", "_", c.lower()).strip("_"): c for c in raw.columns}

    def number(name: str):
        return F.col(names[name]).try_cast("double") if name in names else F.lit(None).cast("double")

    n = number("n")
    typed = raw.select(
        F.col(names["spec_id"]).alias("spec_id"), number("estimate").alias("estimate"), number("p").alias("p"), F.coalesce(number("alpha"), F.lit(0.05)).alias("alpha"),
        F.when(n == F.floor(n), n.cast("bigint")).alias("n"),
        (F.lower(F.col(names["converged"]).cast("string")).isin("1", "true", "t", "yes", "y") if "converged" in names else F.lit(True)).alias("converged"),
    )
    return typed.join(specs, "spec_id", "left")


#: The schema of one page of a word layout.
LAYOUT = "_number int, line array<struct<_y:double, word:array<struct<_VALUE:string, _x0:double, _x1:double>>>>"


def layout_words(spark: SparkSession, path: str) -> DataFrame:
    """page, line, word_index, x0, x1, y, word of a word-layout XML (``page`` elements of ``line`` elements of ``word``)."""
    pages = spark.read.format("xml").option("rowTag", "page").schema(LAYOUT).load(path)
    lines = pages.select(F.col("_number").alias("page"), F.posexplode("line").alias("line", "l"))
    words = lines.select("page", "line", F.col("l._y").alias("y"), F.posexplode("l.word").alias("word_index", "w"))
    return words.select("page", "line", "word_index", F.col("w._x0").alias("x0"), F.col("w._x1").alias("x1"), "y", F.col("w._VALUE").alias("word"))


def read_codebook(spark: SparkSession, path: str) -> str:
    """A codebook as one text: text, Markdown, CSV and JSON as they are, every sheet of a workbook as JSON; else an error."""
    suffix = os.path.splitext(path)[1].lower()
    if suffix in (".txt", ".md", ".csv", ".tsv", ".json"):
        return spark.read.text(path, wholetext=True).first()[0]
    if suffix in (".xlsx", ".xls"):
        book = _optional("openpyxl").load_workbook(path, read_only=True, data_only=True)
        return json.dumps({s.title: [[None if v is None else str(v) for v in r] for r in s.iter_rows(values_only=True)] for s in book.worksheets})
    raise ValueError(f"no codebook: {suffix}")
