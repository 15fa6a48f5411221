"""Window-shaped operators: fill, islands, interval coalescing, batching, cool-down, band joins."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def forward_fill(df: DataFrame, by: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """``df`` with the last known value at or before each row of its group."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(out, F.last(value, ignorenulls=True).over(w))


def lag_context(df: DataFrame, by: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """``df`` with the value of the row before."""
    return df.withColumn(out, F.lag(value).over(Window.partitionBy(*by).orderBy(*order)))


def running_text(df: DataFrame, by: list[str], order: list[str], word: str, out: str) -> DataFrame:
    """``df`` with the words before each row of its group (a line, say) joined by spaces."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(out, F.array_join(F.collect_list(word).over(w), " "))


def islands(df: DataFrame, by: list[str], position: str) -> DataFrame:
    """by, first, last, n of the runs of consecutive positions; repeated positions count once."""
    once = df.select(*by, position).where(F.col(position).isNotNull()).distinct()
    w = Window.partitionBy(*by).orderBy(position)
    return (
        once.withColumn("__island", F.col(position) - F.row_number().over(w))
        .groupBy(*by, "__island").agg(F.min(position).alias("first"), F.max(position).alias("last"), F.count("*").alias("n")).drop("__island")
    )


def merge_intervals(df: DataFrame, by: list[str], start: str, end: str, gap: float = 0) -> DataFrame:
    """by, start, end, n of intervals merged where they overlap or are at most ``gap`` apart."""
    w = Window.partitionBy(*by).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(reach.isNull() | (F.col(start) > reach + gap), 1).otherwise(0)
    marked = df.where(F.col(start).isNotNull() & F.col(end).isNotNull()).withColumn("__opens", opens)
    numbered = marked.withColumn("__i", F.sum("__opens").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.groupBy(*by, "__i").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n")).drop("__i")


def session_windows(df: DataFrame, by: list[str], ts: str, gap: str) -> DataFrame:
    """by, session_start, session_end, n: events no further apart than ``gap``."""
    return df.groupBy(*by, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n")).select(*by, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def fixed_batches(df: DataFrame, by: list[str], order: list[str], size: int) -> DataFrame:
    """``df`` with ``batch``: consecutive rows of a group in batches of ``size``."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size))


def greedy_batches(df: DataFrame, by: list[str], order: list[str], weight: str, capacity: float) -> DataFrame:
    """``df`` with ``batch``: rows in order fill a batch until the next would exceed the capacity; one alone may.

    A sequential fold: groups are streamed in sorted order through one task each, holding no group in memory.
    """
    kept = df.columns
    schema = df.withColumn("batch", F.lit(0).cast("bigint")).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, load, number = None, 0.0, 0
        for batch in batches:
            out = []
            for group, w in zip(zip(*[batch[c] for c in by]) if by else [()] * len(batch), batch[weight]):
                w = 0.0 if w is None or w != w else w
                if group != key:
                    key, load, number = group, 0.0, 0
                elif load > 0 and load + w > capacity:
                    load, number = 0.0, number + 1
                load += w
                out.append(number)
            yield batch[kept].assign(batch=out)

    return df.repartition(*[F.col(c) for c in by]).sortWithinPartitions(*by, *order).mapInPandas(run, schema)


def cooldown(events: DataFrame, by: str, ts: str, failed: str, seconds: int) -> DataFrame:
    """``events`` with ``cooling``: whether an earlier event of the same ``by`` failed within the last ``seconds``."""
    t = F.unix_micros(F.col(ts).cast("timestamp"))
    w = Window.partitionBy(by).orderBy("__t").rangeBetween(-seconds * 1_000_000, -1)
    return events.withColumn("__t", t).withColumn("cooling", F.coalesce(F.max(F.col(failed).cast("int")).over(w), F.lit(0)) == 1).drop("__t")


def band_join(left: DataFrame, right: DataFrame, by: str, left_at: str, right_at: str, low: int, high: int) -> DataFrame:
    """Pairs of the same ``by`` with low <= right_at - left_at <= high, over whole numbers.

    Both sides meet in bins of the band's width, so the join is an equi-join with a residual: each left row goes to
    the (at most two) bins that its band touches, and no pair is emitted twice.
    """
    width = high - low + 1
    a = left.withColumn("__bin", F.explode(F.sequence(F.floor((F.col(left_at) + low) / width), F.floor((F.col(left_at) + high) / width))))
    b = right.withColumn("__bin", F.floor(F.col(right_at) / width))
    return a.join(b, [by, "__bin"]).where((F.col(right_at) - F.col(left_at)).between(low, high)).drop("__bin")


def budget_state(events: DataFrame, by: str, order: list[str], cost: str, reserved: str, cap: float, baseline: float = 0.0) -> DataFrame:
    """``events`` with ``used`` before each event and ``accepted``: baseline + used + amount <= cap, unknown costs staying reserved.

    This batch form counts every earlier event, as the running sum of a window.
    """
    amount = F.coalesce(F.col(cost), F.col(reserved), F.lit(0.0))
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    used = F.lit(baseline) + F.coalesce(F.sum(amount).over(w), F.lit(0.0))
    return events.withColumn("used", used).withColumn("accepted", used + amount <= cap)
