"""Matching goes on until no pair is certain."""

from lodestat.operators import reconcile


def test_a_chain_of_falling_scores_is_matched_to_its_end(spark):
    n = 23  # each left has its own right and, better by the margin, the one before, which is taken a round earlier
    pairs = [(i, i, 100.0 - 2 * i) for i in range(n)] + [(i, i - 1, 101.0 - 2 * i) for i in range(1, n)]
    got = reconcile.mutual_best(spark.createDataFrame(pairs, "l bigint, r bigint, s double"), "l", "r", "s").collect()
    assert {(r.l, r.r) for r in got} == {(i, i) for i in range(n)} and max(r.round for r in got) == n
    first = reconcile.mutual_best(spark.createDataFrame(pairs, "l bigint, r bigint, s double"), "l", "r", "s", rounds=1).collect()
    assert [(r.l, r.r) for r in first] == [(0, 0)]
