"""Matching two lists without keys: exact search, and accuracy on made-up lists with known pairs."""

import random

import pytest
from pyspark.sql import functions as F

from lodestat.llm import matching as M

MAPPINGS = [
    ("response latency", "reaction time"), ("speed of responding", "reaction time"), ("accuracy of recall", "recall accuracy"), ("rated hunger", "hunger rating"),
    ("female versus male participants", "women vs men"), ("known versus new items", "familiar vs novel"), ("early versus late sessions", "morning vs evening"),
]
CLAIM = "claim_uid bigint, paper_id string, study_id string, quantity_kind string, value double, location struct<page:int>, description string, analysis_label string"
READ = "reader_uid bigint, paper_id string, quantity_kind string, value double, location struct<page:int>, description string, analysis_label string, study_id string"
MAPS = "source_text string, canonical string"
OUTCOMES = {"reaction time": ["reaction time", "response latency", "speed of responding"], "recall accuracy": ["recall accuracy", "accuracy of recall"], "hunger rating": ["hunger rating", "rated hunger"]}
CONTRASTS = {"women vs men": ["women vs. men", "female versus male participants"], "familiar vs novel": ["familiar vs. novel", "known versus new items"]}


def lists(seed=1):
    """Claims, a second reader's rows and the true pairs."""
    rng = random.Random(seed)
    claims, reads, true = [], [], set()
    uid = 0
    for p in range(12):
        for study in (1, 2):
            for o in OUTCOMES:
                c = rng.choice(list(CONTRASTS))
                for kind, group in [("t", None), ("p_value", None), ("mean", c.split(" vs ")[0]), ("mean", c.split(" vs ")[1])]:
                    uid += 1
                    value, page = round(rng.uniform(0.1, 30), 2), rng.randrange(1, 15)
                    what = f"in the {group} group" if group else f"comparing {c.replace(' vs ', ' with ')}"
                    claims.append((uid, f"p{p}", f"study{study}", kind, value, (page,), f"{kind} for {o} {what} (Study {study}).", f"Study {study}: {o}, {c}"))
                    if rng.random() < 0.8:
                        name = rng.choice(OUTCOMES[o])
                        if rng.random() < 0.2:
                            i = rng.randrange(len(name) - 1)
                            name = name[:i] + name[i + 1] + name[i] + name[i + 2 :]
                        shown = value if rng.random() < 0.8 else round(value * 1.05, 2)
                        where = f"those in {group}" if group else rng.choice(CONTRASTS[c])
                        label = None if rng.random() < 0.2 else f"Exp. {study} {name}: {rng.choice(CONTRASTS[c])}"
                        rid = 1000 + uid
                        reads.append((rid, f"p{p}", {"p_value": "p", "mean": "M"}.get(kind, kind), shown, (page + rng.choice([0, 0, 0, 1]),), f"Exp. {study}, {name}: value, {where}", label, None))
                        true.add((uid, rid))
                    elif rng.random() < 0.5:  # the same number of another outcome: no partner
                        other = rng.choice([x for x in OUTCOMES if x != o])
                        reads.append((5000 + uid, f"p{p}", "d", value, (page,), f"Exp. {study}, {other}: d, {rng.choice(CONTRASTS[c])}", None, None))
    return claims, reads, true


def match(spark, claims, reads, maps=MAPPINGS):
    return M.match_quantities(spark.createDataFrame(claims, CLAIM), spark.createDataFrame(reads, READ), spark.createDataFrame(maps, MAPS))


def test_accuracy_and_confidence(spark):
    claims, reads, true = lists()
    rows = match(spark, claims, reads).collect()
    got = {(r.claim_uid, r.reader_uid) for r in rows}
    assert len(got & true) / len(got) > 0.97 and len(got & true) / len(true) > 0.93
    assert all(0 < r.confidence <= 1 for r in rows) and sum(r.confidence > 0.9 for r in rows) > 0.7 * len(rows)
    again = match(spark, claims[::-1], reads[::-1]).collect()
    assert {tuple(r) for r in again} == {tuple(r) for r in rows}


def test_twice_listed_and_contradicted(spark):
    claims, reads, _ = lists(2)
    c = (9001, "z", "study1", "t", 4.2, (3,), "t for reaction time comparing women with men (Study 1).", "Study 1: reaction time, women vs men")
    r = lambda i, o, v=4.2: (i, "z", "t", v, (3,), f"S1, {o}: Student t, women vs. men", f"S1 {o} (women/men)", None)
    got = {(x.claim_uid, x.reader_uid) for x in match(spark, [*claims, c, c], [*reads, r(1, "response latency"), r(2, "reaction time"), r(3, "rated hunger"), r(2, "reaction time")]).collect()}
    assert {(9001, 1), (9001, 2)} <= got and not any(b == 3 for _, b in got)


def test_unknown_attributes_and_empty_tables(spark):
    claims, reads, _ = lists(3)
    blank = (9999, None, None, "t", 1.0, None, None, None)
    nulls = [(8000 + i, None if i == 0 else "p1", None if i == 1 else "t", None, None, None, None, None) for i in range(3)]
    got = match(spark, [*claims, blank], [*reads, *nulls, (None, "p1", "t", 1.0, None, "", "", None)]).collect()
    assert got and not any(r.reader_uid is None or 8000 <= r.reader_uid < 8003 or r.claim_uid == 9999 for r in got)
    assert match(spark, [], reads).count() == 0 and match(spark, claims, []).count() == 0
    assert match(spark, claims, reads, []).count() >= 0


def test_hamming_search_is_exact(spark):
    rng = random.Random(5)
    make = lambda n: [(i, "b" if rng.random() < 0.7 else "c", i % 3, [("v", [rng.getrandbits(2) << rng.randrange(4) for _ in range(M.CHUNKS)])]) for i in range(n)]
    left, right = make(60), make(80)
    schema = "{0} bigint, block string, x int, views array<struct<view:string,chunks:array<bigint>>>"
    got = [tuple(r) for r in M.hamming_pairs(spark.createDataFrame(left, schema.format("l")), spark.createDataFrame(right, schema.format("r")), "l", "r", ["block"], F.col("views"), ["x"]).collect()]
    far = lambda a, b: sum((x ^ y).bit_count() for x, y in zip(a[3][0][1], b[3][0][1]))
    want = {(a[0], b[0], a[2], b[2]) for a in left for b in right if a[1] == b[1] and far(a, b) <= M.RADIUS}
    assert set(got) == want and len(got) == len(want) and any(far(left[i], right[j]) for i, j, *_ in want)


def test_reading_attributes():
    reader = M.Reader(M.vocabulary(sorted(MAPPINGS)))
    assert reader.find("outcome", "Exp. 2, acuracy of recal: t, x") == "recall accuracy" and reader.find("outcome", "nothing here") is None and reader.find("outcome", None) is None
    assert reader.group("mean, those in wwomen", "women vs men") == "women" and reader.group("mean of it", "women vs men") is None
    assert M.study_of(None, "Expeirment 2") == "2" and M.study_of("study3") == "3" and M.study_of("S1: x") == "1" and M.study_of("none") is None
    assert M.printed(0.807, "percentage") == M.printed(80.7, "percentage") == "80.7" and M.printed(float("nan"), "t") is None and M.kind_of("M") == "mean" and M.kind_of(None) is None
    assert M.dice(0b1100, 0b0110) == 0.5 and M.dice(0, 0) == 1.0
    none = M.fit_mixture({})
    assert len(none.weights) == len(M.PARTS) and none.prior < 0


def test_confidence_follows_the_patterns():
    mix = M.fit_mixture({"f22": (800, 800.0), "f12": (60, 50.0), "f02": (20, 0.0), "x00": (900, 0.0), "x11": (100, 40.0), "g22": (50, 50.0), "x22": (30, 30.0)})
    assert mix.confidence("f22") > 0.95 > mix.confidence("x00") < 0.1 and mix.confidence("f02") < mix.confidence("f12") < mix.confidence("f22")
    assert mix.confidence("g12", 0.2) < mix.confidence("g12", mix.near) < mix.confidence("g12", 0.99) and mix.confidence("g12", mix.near) == pytest.approx(mix.confidence("g12"))


def test_the_confidence_alone_decides(spark):
    """Every pair has the posterior of its pattern, and none below the limit is given."""
    claims, reads, _ = lists(7)
    some = match(spark, claims, reads).collect()
    strict = M.match_quantities(spark.createDataFrame(claims, CLAIM), spark.createDataFrame(reads, READ), spark.createDataFrame(MAPPINGS, MAPS), min_confidence=0.99).collect()
    assert {tuple(r) for r in strict} == {tuple(r) for r in some if r.confidence >= 0.99} and len(strict) < len(some)
    assert M.match_quantities(spark.createDataFrame(claims, CLAIM), spark.createDataFrame(reads, READ), spark.createDataFrame(MAPPINGS, MAPS), min_confidence=1.1).count() == 0


def test_confidences_are_calibrated_on_known_pairs(spark):
    claims, reads, true = lists(11)
    matches = match(spark, claims, reads)
    bins = M.reliability(matches, spark.createDataFrame(sorted(true), "claim_uid bigint, reader_uid bigint")).collect()
    n = sum(r.n for r in bins)
    assert n > 100 and sum(r.n * abs(r.mean_confidence - r.share_true) for r in bins) / n < 0.1


def test_similarities_are_dice_coefficients(spark):
    table = M.FieldBits()
    own, other = table[1, "reaction time"], table[1, "reaction tmie"]
    row, names = [1, 2], ["claim_uid bigint", "reader_uid bigint"]
    for f in M.WEIGHTS:
        for i in range(M.CHUNKS):
            row += {"study": (own[i], own[i]), "outcome": (own[i], other[i])}.get(f, (None, None))
            names += [f"{f}{i}_l bigint", f"{f}{i}_r bigint"]
    df = spark.createDataFrame([(*row, 4.0, 4.4, 3.0, 4.0)], ", ".join([*names, *[f"{n}_{s} double" for n in ("value_number", "page_number") for s in "lr"]]))
    got = M.similarities(df).withColumn("pattern", M.levels()).first()
    whole = lambda chunks: sum((c & (1 << 64) - 1) << 64 * i for i, c in enumerate(chunks))
    want = (1.0 * 1 + 1.2 * M.dice(whole(own), whole(other))) / 2.2
    assert got.identity == pytest.approx(want) and got.coverage == pytest.approx(0.5) and got.page_near == 0.5 and 0 < got.value_near < 1 and got.off == pytest.approx(0.4)
    assert got.pattern == ("q11" if want >= M.AGREES else "x11")


def test_no_text_is_shuffled(spark):
    claims, _, _ = lists()
    read = M.read_attributes(spark.createDataFrame(claims, CLAIM), "claim_uid", M.vocabulary(sorted(MAPPINGS)), F.col("study_id"))
    above, below = read._jdf.queryExecution().executedPlan().toString().split("ArrowEvalPython", 1)
    assert "Exchange" in above and "Exchange" not in below and read.count() == len(claims)


@pytest.mark.parametrize("dense", [0, 10**6])
def test_view_pairs_are_those_within_the_radius(spark, monkeypatch, dense):
    """By comparing each pair or by hashing; a pair that differs in one digit of study or page is near."""
    monkeypatch.setattr(M, "DENSE", dense)
    rng, table = random.Random(9), M.FieldBits()
    some = {"study": "12", "outcome": ["recall accuracy", "hunger rating"], "contrast": ["women vs men"], "grp": ["women", "-"], "printed": ["4.99", "4.9", "0.034"], "page": ["3", "4", "11"]}
    whole = lambda f, text: sum((c & (1 << 64) - 1) << 64 * i for i, c in enumerate(table[M.FIELDS.index(f), text]))

    def make(first, n):
        texts = [{f: rng.choice([None, *some[f]]) for f in M.FIELDS} for _ in range(n)]
        rows = [(first + k, rng.choice("pq"), "t", *[c for f in M.FIELDS for c in (table[M.FIELDS.index(f), t[f]] if t[f] else [None] * M.CHUNKS)], 1.0) for k, t in enumerate(texts)]
        return texts, rows

    (lt, left), (rt, right) = make(0, 30), make(100, 40)
    schema = "{0} bigint, paper_id string, kind string, " + ", ".join(f"{c} bigint" for c in M.CHUNK_COLUMNS) + ", x double"
    got = M.view_pairs(spark.createDataFrame(left, schema.format("l")), spark.createDataFrame(right, schema.format("r")), "l", "r", ["paper_id", "kind"], ["x"]).collect()

    def near(a, b, radius):
        known = [(f, g) for f, g in M.VIEWS if None not in (a[f], a[g], b[f], b[g])]
        return any(((whole(f, a[f]) | whole(g, a[g])) ^ (whole(f, b[f]) | whole(g, b[g]))).bit_count() <= radius for f, g in known)

    want = {(i, 100 + j) for i, a in enumerate(lt) for j, b in enumerate(rt) if left[i][1] == right[j][1] and near(a, b, M.RADIUS)}
    assert {(r.l, r.r) for r in got} == want and len(got) == len(want)
    assert len(want) > sum(left[i][1] == right[j][1] and near(a, b, 0) for i, a in enumerate(lt) for j, b in enumerate(rt))
