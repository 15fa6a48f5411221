"""References to records that do not exist.

Parents are hashed to 64 bits and range-partitioned by that hash; each range is kept
as one sorted array.  References are sent to the same ranges in batches of bounded
size and probed by binary search.  The hash only orders the keys: a hit is confirmed
on the full key, so equal hashes of different keys give no wrong answer.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parents held as one sorted array, and references probed against it in one call.
ROWS_PER_RANGE = 20_000
ROWS_PER_BATCH = 50_000
#: Parts of a range while its number of batches is looked up.
SALTS = 64


def _key(cols: list[Column]) -> Column:
    """One string per composite key; lengths keep ('a','bc') and ('ab','c') apart."""
    parts = []
    for c in cols:
        s = c.cast("string")
        parts += [F.length(s).cast("string"), F.lit(":"), s]
    return F.concat(*parts)


def _range(hashed: Column, ranges: int) -> Column:
    """The range of a 64-bit hash: its top 31 bits scaled to ``ranges``."""
    top = F.shiftrightunsigned(hashed, 33)
    return F.shiftright(top * F.lit(ranges).cast("bigint"), 31).cast("int")


def _micros(c: Column) -> Column:
    """A timestamp, with or without zone, as microseconds in the session's zone."""
    return F.unix_micros(c.cast("timestamp"))


def probe(keys: np.ndarray, texts: np.ndarray, wanted: np.ndarray, wanted_texts: np.ndarray) -> np.ndarray:
    """Positions in the sorted ``keys`` whose text equals that wanted, else -1."""
    out = np.full(len(wanted), -1, dtype=np.int64)
    if not len(keys):
        return out
    lo = np.searchsorted(keys, wanted, side="left")
    inside = np.minimum(lo, len(keys) - 1)
    hit = (keys[inside] == wanted) & (lo < len(keys))
    same = np.zeros(len(wanted), dtype=bool)
    same[hit] = texts[inside[hit]] == wanted_texts[hit]
    out[same] = inside[same]
    for i in np.flatnonzero(hit & ~same):  # runs of equal hashes: practically never longer than one
        j = lo[i] + 1
        while j < len(keys) and keys[j] == wanted[i]:
            if texts[j] == wanted_texts[i]:
                out[i] = j
                break
            j += 1
    return out


def find_orphans(
    refs: DataFrame,
    parents: DataFrame,
    *,
    key: list[str],
    ref_time: str,
    parent_time: str,
    parent_deleted: Column,
    rows_per_range: int = ROWS_PER_RANGE,
    rows_per_batch: int = ROWS_PER_BATCH,
) -> DataFrame:
    """The references of ``refs`` that do not resolve, with a column ``status``.

    ``missing``: no parent has the key; else ``deleted``: ``parent_deleted`` holds for any
    delivery of the parent; else ``late``: the parent's earliest ``parent_time`` is after
    the reference's ``ref_time``.  Resolved references are left out.

    Nulls: a parent whose key has a null is no parent; a reference with a null in its key
    columns resolves to nothing and is ``missing`` (callers drop what is no reference).
    A null time on either side is never ``late``.  Repeated parents are folded first, repeated
    references are kept.  Either side may be empty.  Columns other than those named pass
    through; clashes with parents cannot arise, as no parent column is carried over.

    Scale: one shuffle of the folded parents and one of the references, both by range.  Equal references are counted before they are
    shuffled (tables with maps are spread by row instead).  A range or key that holds most references is spread over batches of about
    ``rows_per_batch`` rows, the sorted arrays of its parents (at most about ``rows_per_range``) being copied to each batch.
    """
    ranges = max(1, -(-parents.count() // rows_per_range))  # from the footers of Parquet files
    parent = (
        parents.where(_all_known([F.col(c) for c in key]))
        .groupBy(*key)
        .agg(F.min(_micros(F.col(parent_time))).alias("first_us"), F.max(F.coalesce(parent_deleted, F.lit(False))).alias("gone"))
        .select(F.xxhash64(*key).alias("h"), _key([F.col(c) for c in key]).alias("k"), "first_us", "gone")
        .withColumn("range_id", _range(F.col("h"), ranges))
    )
    clash = [c for c in refs.columns if c.startswith("__") or c.lower() == "status"]
    if clash:
        raise ValueError(f"columns reserved by this operator: {clash}")
    # equal references have one answer: they are probed once and come back as often as they came
    if any("map<" in t or "variant" in t for _, t in refs.dtypes):
        counted, spread = refs.withColumn("__times", F.lit(1).cast("bigint")), F.xxhash64(F.monotonically_increasing_id())
    else:
        counted, spread = refs.groupBy(*refs.columns).agg(F.count("*").alias("__times")), F.xxhash64(*[F.col(c) for c in refs.columns])
    ref = counted.select(
        "*",
        F.coalesce(F.xxhash64(*key), F.lit(0)).alias("__h"),
        F.coalesce(_key([F.col(c) for c in key]), F.lit("")).alias("__k"),
        _micros(F.col(ref_time)).alias("__at"),
        spread.alias("__spread"),
    ).withColumns({"__range": _range(F.col("__h"), ranges), "__salt": F.pmod(F.col("__spread"), F.lit(SALTS)).cast("int")})
    batches = F.ceil(F.count("*") / rows_per_batch).cast("int")
    per_range = ref.groupBy("__range").agg(batches.alias("__batches"))
    # a range that holds most references is met by SALTS tasks here, and then by as many as it has batches
    salted = per_range.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    ref = ref.join(salted, ["__range", "__salt"]).withColumn("__batch", F.pmod(F.shiftright("__spread", 8), F.col("__batches").cast("bigint")).cast("int"))
    ref = ref.drop("__batches", "__spread", "__salt")
    # the parents of a range are one row of arrays in the order of their hash, copied to each batch of the range
    held = F.array_sort(F.collect_list(F.struct("h", "k", "first_us", "gone")))
    arrays = parent.groupBy("range_id").agg(held.alias("__p")).join(per_range.withColumnRenamed("__range", "range_id"), "range_id")
    arrays = arrays.select("range_id", *[F.col(f"__p.{c}").alias(c) for c in ("h", "k", "first_us", "gone")], F.explode(F.sequence(F.lit(0), F.col("__batches") - 1)).alias("__batch"))
    names = refs.columns
    out = refs.withColumn("status", F.lit("")).withColumn("__times", F.lit(1).cast("bigint"))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        known = len(right) > 0
        keys = np.asarray(right["h"].iloc[0] if known else [], dtype=np.int64)
        texts = np.asarray(right["k"].iloc[0] if known else [], dtype=object)
        at = probe(keys, texts, left["__h"].to_numpy(np.int64), left["__k"].to_numpy(object))
        status = np.full(len(left), None, dtype=object)
        status[at < 0] = "missing"
        found = np.flatnonzero(at >= 0)
        if len(found):
            gone = np.asarray(right["gone"].iloc[0], dtype=bool)[at[found]]
            first = np.asarray(right["first_us"].iloc[0], dtype=float)[at[found]]
            late = first > left["__at"].to_numpy(float)[found]  # a null is NaN and never greater
            status[found] = np.where(gone, "deleted", np.where(late, "late", None))
        answers = left[[*names, "__times"]].assign(status=status)
        return answers.loc[answers["status"].notna(), [*names, "status", "__times"]]

    probed = ref.groupBy("__range", "__batch").cogroup(arrays.groupBy("range_id", "__batch")).applyInPandas(run, out.schema)
    return probed.withColumn("__n", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("__times")))).select(*names, "status")


def _all_known(cols: list[Column]) -> Column:
    known = F.lit(True)
    for c in cols:
        known = known & c.isNotNull()
    return known
