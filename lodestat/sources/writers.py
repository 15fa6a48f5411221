"""Sinks: artifacts, logs, receipts, archives, flattened results and Markdown."""

from __future__ import annotations

import hashlib
import json
import os
import shutil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that a report table may have; it is made on the driver.
MAX_REPORT_ROWS = 10_000


def write_atomic(path: str, text: str) -> None:
    """A small text, put in place in one step."""
    tmp = f"{path}.tmp"
    with open(tmp, "w", encoding="utf-8") as f:
        f.write(text)
    os.replace(tmp, path)


def archive(path: str) -> str | None:
    """Moves what is at ``path`` to the next free ``path.vN`` and says where."""
    if not os.path.exists(path):
        return None
    n = 1
    while os.path.exists(f"{path}.v{n}"):
        n += 1
    shutil.move(path, f"{path}.v{n}")
    return f"{path}.v{n}"


def write_artifact(path: str, value: object) -> None:
    """A small JSON artifact."""
    write_atomic(path, json.dumps(value, ensure_ascii=False, sort_keys=True, indent=1, default=str))


def write_results(df: DataFrame, path: str, nested: str | None = None) -> None:
    """Rows as CSV, a struct column flattened into its fields."""
    flat = df.select(*[c for c in df.columns if c != nested], f"{nested}.*") if nested else df
    flat.write.mode("overwrite").option("header", True).csv(path)


def append_events(df: DataFrame, path: str) -> None:
    """Rows appended to a folder of JSON lines."""
    df.write.mode("append").json(path)


def normal_cost(route: Column, cost: Column, tokens: Column, price: Column, subscriptions: tuple[str, ...] = ("subscription",)) -> tuple[Column, Column]:
    """(cost, list_equivalent): a subscription route costs nothing and is valued at tokens times price."""
    free = route.isin(*subscriptions)
    return F.when(free, F.lit(0.0)).otherwise(cost), F.when(free, tokens * price).otherwise(cost)


def receipts(paths: list[str]) -> list[dict]:
    """name, path, bytes and SHA-256 of files; two files of one name are an error."""
    out, names = [], set()
    for p in paths:
        name = os.path.basename(p)
        if name in names:
            raise ValueError(f"two files are named {name}")
        names.add(name)
        with open(p, "rb") as f:
            out.append({"name": name, "path": p, "bytes": os.path.getsize(p), "sha256": hashlib.file_digest(f, "sha256").hexdigest()})
    return out


def file_digests(spark, pattern: str) -> DataFrame:
    """path, n_bytes, sha256 of files, computed on the workers."""
    return spark.read.format("binaryFile").load(pattern).select("path", F.col("length").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))


def done_marker(path: str, inputs: dict[str, str], implementation: str, outputs: dict[str, str]) -> None:
    """Records the digests under which a stage was finished."""
    write_artifact(path, {"inputs": inputs, "implementation": implementation, "outputs": outputs})


def is_current(path: str, inputs: dict[str, str], implementation: str, outputs: dict[str, str]) -> bool:
    """Whether a stage was finished under just these digests."""
    if not os.path.exists(path):
        return False
    with open(path, encoding="utf-8") as f:
        return json.load(f) == {"inputs": inputs, "implementation": implementation, "outputs": outputs}


def markdown(df: DataFrame, digits: int = 3) -> str:
    """A small table as Markdown; more than MAX_REPORT_ROWS rows are an error."""
    rows = df.limit(MAX_REPORT_ROWS + 1).collect()
    if len(rows) > MAX_REPORT_ROWS:
        raise ValueError("too many rows for a report")

    def cell(v: object) -> str:
        return "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v).replace("|", "\\|")

    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join([*lines, *["| " + " | ".join(cell(v) for v in r) + " |" for r in rows]])


def curve_layout(results: DataFrame, key: str, estimate: str, low: str, high: str) -> DataFrame:
    """key, x, estimate, low, high: the marks of a specification curve in rising order; rendering is left to others."""
    from lodestat.operators.specspace import spec_order

    return spec_order(results, [], estimate, key).select(key, F.col("spec_rank").alias("x"), F.col(estimate).alias("estimate"), F.col(low).alias("low"), F.col(high).alias("high"))
