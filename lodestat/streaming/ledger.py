"""Streams of ledger events: running totals, cool-down and budget state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType


def event_stream(spark, path: str, schema: StructType, files_per_trigger: int = 64) -> DataFrame:
    """Events of a folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def jsonl_stream(spark, path: str, schema: StructType) -> DataFrame:
    """An append-only folder of JSON lines as a stream."""
    return spark.readStream.schema(schema).json(path)


def running_totals(events: DataFrame, by: str, amount: str) -> DataFrame:
    """by, n, total, for update or complete mode."""
    return events.groupBy(by).agg(F.count("*").alias("n"), F.sum(amount).alias("total"))


def windowed_totals(events: DataFrame, ts: str, by: str, amount: str, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """window_start, by, n, total of tumbling windows.

    In complete mode every window is there, those still open at the end as well, and no event is dropped.  In append mode, for streams
    that go on, a window comes when the watermark has passed it: open ones are held back, events later than ``late`` are dropped.
    """
    w = events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), by).agg(F.count("*").alias("n"), F.sum(amount).alias("total"))
    return w.select(F.col("w.start").alias("window_start"), by, "n", "total")


def cooling_windows(events: DataFrame, ts: str, by: str, failed: str, width: str = "900 seconds", late: str | None = "1 hour") -> DataFrame:
    """by, cool_from, cool_until, n_failures: sessions of failures no further apart than the cool-down; modes as in ``windowed_totals``.

    Sessions drop events later than ``late`` in every mode.  A run over what is there, whose files may come in any order, takes
    null: no watermark and no late events.
    """
    failures = events.where(F.col(failed))
    failures = failures if late is None else failures.withWatermark(ts, late)
    w = failures.groupBy(F.session_window(ts, width).alias("w"), by).agg(F.count("*").alias("n_failures"))
    return w.select(by, F.col("w.start").alias("cool_from"), F.col("w.end").alias("cool_until"), "n_failures")


class Budget(StatefulProcessor):
    """Accepts an amount while baseline + used + amount stays within the cap; unknown costs stay reserved."""

    def __init__(self, cap: float, baseline: float):
        self.cap, self.baseline = cap, baseline

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.used = handle.getValueState("used", "used double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        used = self.used.get()[0] if self.used.exists() else 0.0
        for batch in rows:
            batch = batch.sort_values(["ts", "event_id"], kind="stable")
            out = []
            for event, cost, reserved in zip(batch["event_id"], batch["cost"], batch["reserved"]):
                amount = cost if cost is not None and cost == cost else reserved if reserved is not None and reserved == reserved else 0.0
                ok = self.baseline + used + amount <= self.cap
                if ok:
                    used += amount
                out.append((str(key[0]), int(event), float(amount), bool(ok)))
            yield pd.DataFrame(out, columns=["budget", "event_id", "amount", "accepted"])
        self.used.update((used,))

    def close(self) -> None:
        pass


def budget_stream(events: DataFrame, by: str, cap: float, baseline: float = 0.0) -> DataFrame:
    """budget, event_id, amount, accepted, keyed by ``by``; events have event_id, ts, cost, reserved."""
    return events.groupBy(by).transformWithStateInPandas(
        Budget(cap, baseline), "budget string, event_id bigint, amount double, accepted boolean", outputMode="Append", timeMode="None"
    )


#: Processors with state of their own need this store.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_once(df: DataFrame, mode: str, folder: str, own_state: bool = False) -> DataFrame:
    """Runs a stream over all that is there and returns the table of its results, written under ``folder`` (a shared one).

    Appended rows go to a file sink; complete results replace the table with each batch.  Nothing passes through the driver.
    """
    conf, key, out = df.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass", f"{folder}/result"
    before = conf.get(key)
    if own_state:
        conf.set(key, ROCKS)
    try:
        stream = df.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True)
        if mode == "append":
            query = stream.format("parquet").option("path", out).start()
        else:
            query = stream.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out)).start()
        query.awaitTermination()
    finally:
        conf.set(key, before)
    return df.sparkSession.read.schema(df.schema).parquet(out)
