"""Orphan references against a plain dictionary."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestat.operators import referential

REFS = "record string, paper string, claim string, at timestamp"
PARENTS = "paper string, claim string, at timestamp, gone timestamp, record string"
T0 = dt.datetime(2025, 1, 1)


def day(n):
    return None if n is None else T0 + dt.timedelta(days=n)


def run(spark, refs, parents, **limits):
    got = referential.find_orphans(
        spark.createDataFrame(refs, REFS), spark.createDataFrame(parents, PARENTS), key=["paper", "claim"], ref_time="at", parent_time="at",
        parent_deleted=F.col("gone").isNotNull(), **limits,
    )
    return sorted((r.record, r.paper, r.claim, r.status) for r in got.collect()) if all(r[1] is not None for r in refs) else got.collect()


def plain(refs, parents):
    first, gone = {}, set()
    for p, c, at, g, _ in parents:
        if p is not None and c is not None:
            first[p, c] = min((x for x in (first.get((p, c)), at) if x is not None), default=None)
            if g is not None:
                gone.add((p, c))
    out = []
    for r, p, c, at in refs:
        if (p, c) not in first:
            out.append((r, p, c, "missing"))
        elif (p, c) in gone:
            out.append((r, p, c, "deleted"))
        elif at is not None and first[p, c] is not None and first[p, c] > at:
            out.append((r, p, c, "late"))
    return sorted(out)


@pytest.mark.parametrize("limits", [{}, {"rows_per_range": 3, "rows_per_batch": 4}])
def test_against_a_dictionary(spark, limits):
    rng = random.Random(4)
    parents = [(f"p{rng.randrange(4)}", f"c{rng.randrange(12)}", day(rng.randrange(20)), day(1) if rng.random() < 0.2 else None, "x") for _ in range(40)]
    refs = [(f"r{i}", f"p{rng.randrange(5)}", "c1" if rng.random() < 0.4 else f"c{rng.randrange(15)}", day(rng.randrange(20))) for i in range(200)]
    refs += refs[:5]  # repeated references stay
    assert run(spark, refs, parents, **limits) == plain(refs, parents)


def test_keys_are_compared_as_written(spark):
    assert run(spark, [("r", "p", "c1 ", day(1)), ("r", "p1", "c", day(1))], [("p", "c1", day(0), None, "x"), ("p", "1c", day(0), None, "x")]) == [
        ("r", "p", "c1 ", "missing"), ("r", "p1", "c", "missing"),
    ]


def test_nulls_and_empty_sides(spark):
    assert [r.status for r in run(spark, [("r", None, "c", day(1))], [(None, "c", day(0), None, "x")])] == ["missing"]
    assert run(spark, [("r", "p", "c", None)], [("p", "c", day(5), None, "x")]) == []
    assert run(spark, [("r", "p", "c", day(1))], [("p", "c", None, None, "x")]) == []
    assert run(spark, [], [("p", "c", day(0), None, "x")]) == []
    assert run(spark, [("r", "p", "c", day(1))], []) == [("r", "p", "c", "missing")]


def test_reserved_columns_are_refused(spark):
    refs = spark.createDataFrame([("p", "c", day(1), "s")], "paper string, claim string, at timestamp, status string")
    with pytest.raises(ValueError):
        referential.find_orphans(refs, spark.createDataFrame([], PARENTS), key=["paper", "claim"], ref_time="at", parent_time="at", parent_deleted=F.lit(False))


def test_equal_hashes_are_told_apart():
    keys, texts = np.array([1, 5, 5, 5, 9]), np.array(["a", "b", "c", "d", "e"], dtype=object)
    wanted, named = np.array([5, 5, 5, 9, 0, 10]), np.array(["d", "b", "x", "e", "a", "z"], dtype=object)
    assert referential.probe(keys, texts, wanted, named).tolist() == [3, 1, -1, 4, -1, -1]
    assert referential.probe(keys[:0], texts[:0], wanted, named).tolist() == [-1] * 6
