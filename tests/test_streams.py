"""Streams run to their end give what the batch gives, the windows still open at the end included."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from test_entry import _same

from lodestat.streaming import ledger

T0 = dt.datetime(2025, 1, 1, 22)


@pytest.mark.parametrize("name", ["stream_windows", "stream_cooldown"])
def test_streams_against_sql(spark, small, name):
    _same(spark, small, name)


def test_open_windows_are_there_at_the_end(spark, tmp_path):
    at = [0, 900, 1801, 3600 * 3, 3600 * 3 + 10]  # the second touches the first, the third is past it, the last two are open
    events = spark.createDataFrame([(T0 + dt.timedelta(seconds=s), "u", 1.0, True) for s in at], "ts timestamp, u string, x double, failed boolean")
    path = str(tmp_path / "events")
    for when in reversed(at):  # the last event's file comes first: nothing is too late for a run over what is there
        events.where(F.unix_timestamp("ts") == F.lit(int(T0.replace(tzinfo=dt.timezone.utc).timestamp()) + when)).coalesce(1).write.mode("append").parquet(path)
    stream = lambda: ledger.event_stream(spark, path, events.schema, 1)
    w = ledger.run_once(ledger.windowed_totals(stream(), "ts", "u", "x"), "complete", str(tmp_path / "w"))
    assert sorted((r.window_start.day, r.n, r.total) for r in w.collect()) == [(1, 3, 3.0), (2, 2, 2.0)]
    s = ledger.run_once(ledger.cooling_windows(stream(), "ts", "u", "failed", late=None), "complete", str(tmp_path / "s"), True)
    assert sorted(tuple(r) for r in s.select((F.unix_timestamp("cool_until") - F.unix_timestamp("cool_from")).alias("d"), "n_failures").collect()) == [(900, 1), (910, 2), (1800, 2)]
