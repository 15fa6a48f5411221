"""All claims that carry a result are looked for, whatever their kind and sign."""

from lodestat.functions import text as T
from lodestat.operators import evidence

CLAIMS = "claim_uid bigint, paper_id string, claim_id string, importance string, quantity_kind string, value double, precision_digits int, uncertainty map<string,string>"


def test_claims_that_give_results_away(spark):
    claims = spark.createDataFrame(
        [
            (1, "p", "a", "supporting", "p_value", 0.034, 3, None),
            (2, "p", "b", "headline", "mean", 12.5, 1, {"sd": "3.21", "df": "777", "x": "t(888) = 4.56"}),
            (3, "p", "c", None, "ci_lower", -0.417, 3, None),
            (4, "p", "d", "supporting", "mean", 55.25, 2, None),  # beside the headline in one analysis
            (5, "p", "e", "supporting", "mean", 99.75, 2, None),  # in none with a result
            (6, "q", "d", "supporting", "mean", 33.75, 2, None),  # the same id in another paper
            (7, "p", "g", "supporting", "r", None, 2, None),
        ],
        CLAIMS,
    )
    contracts = spark.createDataFrame([("k", "p", ["b", "d"]), ("m", "p", ["e", None])], "record_id string, paper_id string, claim_ids array<string>")
    found = evidence.result_values(claims, contracts)
    assert sorted((r.claim_uid, r.value, r.least_digits) for r in found.collect()) == [(1, 0.034, 2), (2, 3.21, 2), (2, 4.56, 2), (2, 12.5, 2), (3, -0.417, 3), (4, 55.25, 3)]
    forms = evidence.forbidden_forms(found, "claim_uid", "value", "precision_digits", "least_digits")
    texts = spark.createDataFrame([(1, "p = .034, .034%, a bound of −0.417 or -.417, 12.5%, 99.75, x-12.5, 12.5 % confidence")], "d bigint, s string")
    hits = sorted((r.start, r.form) for r in evidence.scan_forms(texts, "d", "s", forms).collect())
    assert hits == [(4, ".034"), (28, "0.417"), (38, ".417"), (45, "12.5"), (61, "12.5")]


def test_forms_have_no_sign():
    assert T.leak_forms(-0.512, 3) == T.leak_forms(0.512, 3) and T.leak_forms(123.4, 1, 3) == ["123.4"]
    assert T.leak_forms(3.21, None, 2) == ["3.21", "3.2"] and T.leak_forms(12.0, 1, 2) == ["12.0", "12"] and T.leak_forms(0.0, 2) == []
