"""Texts that look the same, and texts that do not."""

import pytest

from lodestat.llm import lookalike as L

SAME = [
    ("５３．１％， p", "53.1%, p"), ("närden", "närden"), ("Kältzner in­dex", "Kältzner index"), ("a b c", "a b c"), ("s​core", "score"), ("self‑control", "self-control"),
    ("−1.02", "-1.02"), ("participants’", "participants'"), ("oﬁce", "ofice"), ("ѕсоре", "scope"), ("𝑙𝑜𝑎𝑑", "load"), ("𝟷𝟶", "10"), (" edge ", "edge"), ("Ångstr", "Ångstr"),
    ("Αge", "Age"), ("hοurѕ", "hours"), ("﻿text", "text"), ("ɡrip", "grip"), ("x⁣y", "xy"),
]
OTHER = [("1.02", "1.20"), ("p < .05", "p > .05"), ("keiN", "kein"), ("naïve", "naive"), ("a  b", "a b"), ("not so", "so"), ("größer", "großer"), ("d = -1", "d = 1"), ("ß", "ss")]


@pytest.mark.parametrize(("a", "b"), SAME)
def test_same_look(a, b):
    assert L.visible_form(a) == L.visible_form(b)
    assert L.visible_form(L.visible_form(a)) == L.visible_form(a)


@pytest.mark.parametrize(("a", "b"), OTHER)
def test_other_look(a, b):
    assert L.visible_form(a) != L.visible_form(b)


def test_folding_joins_cases_only():
    assert L.folded_form(L.visible_form("STRASSE")) == L.folded_form(L.visible_form("straße")) and L.folded_form(None) is None and L.visible_form(None) is None


def test_pairs(spark):
    left = spark.createDataFrame([("f1", "p", "ѕcore"), ("f1", "p", "ѕcore"), ("f2", "p", "score"), ("f3", "q", "ѕcore"), ("f4", "p", None), ("f5", None, "ѕcore"), ("f6", "p", ""), ("f7", "p", "Score")], "f string, paper string, anchor string")
    right = spark.createDataFrame([(1, "p", "score"), (2, "p", "ѕcore"), (3, "p", None), (4, None, "score"), (5, "p", " ")], "u bigint, paper string, quote string")
    got = sorted((r.f, r.u) for r in L.same_look(left, right, within="paper", left_text="anchor", right_text="quote").collect())
    assert got == [("f1", 1), ("f1", 1), ("f2", 2), ("f6", 5)]
    assert L.same_look(left.limit(0), right, within="paper", left_text="anchor", right_text="quote").count() == 0
    with pytest.raises(ValueError):
        L.same_look(left.withColumn("u", left.f), right, within="paper", left_text="anchor", right_text="quote")


def test_columns(spark):
    df = spark.createDataFrame([("Ａ", 1), (None, 2), ("", 3), ("x" * 100_000, 4)], "t string, n int")
    got = {r.n: r for r in L.normalise(df, ["t"]).collect()}
    assert got[1].t_visible == "A" and got[1].t_folded == "a" and got[2].t_visible is None and got[3].t_folded == "" and len(got[4].t_visible) == 100_000
    with pytest.raises(ValueError):
        L.normalise(df.withColumn("t_visible", df.t), ["t"])
