"""Matching two lists of printed quantities that share no key.

Attributes (study, outcome, contrast, group) are read from free text: the q-grams of a text are a
fixed bit vector, and a known phrase belongs to the text whose bits hold nearly all of the phrase's.
Records then get one bit vector for each view (sets of attributes that both sides may know); pairs
within a Hamming radius are found exactly: in blocks of few pairs by comparing each, in others by multi-index hashing, since of radius + 1
pieces one at least must be equal.  The Dice coefficients of the fields' bits, weighted by field, and the nearness of values and pages
become a confidence by a mixture model that is fitted to all candidate pairs; the confidence alone decides.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable
from dataclasses import dataclass
from difflib import SequenceMatcher

import ahocorasick
import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestat.session import cut, stored

#: Length of q-grams, bits of a text's and of a record's vector.
Q, TEXT_BITS, WORDS = 3, 1024, 16
#: Pairs are searched within this distance.  A letter or digit that differs moves two bits at least, and two differing studies or pages are two apart.
RADIUS = 3
#: A vector is so many 64-bit chunks, each of PARTED pieces; there is one piece more than the radius.
CHUNKS = 2
PARTED = (RADIUS + 1) // CHUNKS
#: Blocks of up to so many pairs are compared pair by pair.
DENSE = 250_000
#: A phrase is in a text that holds this share of its q-grams.
HELD = 0.72
#: Phrases that the vocabulary may hold; it is read to the driver, and its size is that of the language used.
MAX_PHRASES = 50_000
#: Pairs of at least this confidence match.
MIN_CONFIDENCE = 0.5
#: The weights of the fields of the identity, and the weighted Dice coefficient from which on it agrees.
WEIGHTS = {"study": 1.0, "outcome": 1.2, "contrast": 1.2, "grp": 1.0}
AGREES = 0.95
#: Values are near within this share of the larger one, pages within one page.
VALUE_REACH, PAGE_REACH = 0.25, 2.0

# Names of one kind of quantity.
KINDS = {
    "p_value": "p p-value p_value pvalue", "mean": "m mean average", "sd": "sd", "d": "d cohens_d cohen_d", "n": "n", "t": "t", "f": "f", "r": "r",
    "percentage": "percentage pct percent proportion", "coefficient": "coefficient beta b", "ci_lower": "ci_lower", "ci_upper": "ci_upper",
}
_KIND = {alias: kind for kind, names in KINDS.items() for alias in names.split()}
#: Kinds that belong to one group of a contrast.
GROUP_KINDS = ("mean", "sd", "percentage")
_STUDY = regex.compile(r"(?:\b(?:stu+dy|experiment|expt?\.?|s)\s*(\d)\b)|^study\s*(\d)$", regex.I)
_SLIP = regex.compile(r"([\p{L}.]{3,12})\s(\d)\b")
_SIDES = regex.compile(r"^(.+?) vs\.? (.+)$")


def _grams(text: str) -> set[int]:
    padded = f" {text.lower()} "
    return {zlib.crc32(padded[i : i + Q].encode()) for i in range(len(padded) - Q + 1)}


def text_bits(text: str) -> np.ndarray:
    """The q-grams of a text as TEXT_BITS bits."""
    out = np.zeros(WORDS, dtype=np.uint64)
    for g in _grams(text):
        g %= TEXT_BITS
        out[g >> 6] |= np.uint64(1 << (g & 63))
    return out


def dice(a: int, b: int) -> float:
    """The Dice coefficient of two bit vectors."""
    n = a.bit_count() + b.bit_count()
    return 2 * (a & b).bit_count() / n if n else 1.0


@dataclass(frozen=True)
class Phrase:
    """A phrase of the vocabulary: the attribute it names, its canonical value, its text."""

    attribute: str
    value: str
    text: str


def vocabulary(mappings: list[tuple[str, str]]) -> list[Phrase]:
    """Phrases from (source_text, canonical) pairs; a canonical "A vs B" names a contrast and its two groups."""
    out = set()
    for source, canonical in mappings:
        sides = _SIDES.match(canonical)
        if sides is None:
            out |= {Phrase("outcome", canonical, canonical), Phrase("outcome", canonical, source)}
        else:
            a, b = sides.groups()
            texts = [source, canonical, f"{a} vs. {b}", f"{a}/{b}", f"{a}-{b}", f"{a} with {b}", f"{a} against {b}", f"{a} and {b}"]
            out |= {Phrase("contrast", canonical, t) for t in texts}
            for side in (a, b):
                out |= {Phrase("group", side, t) for t in (f"{side} group", f"{side} condition", f"those in {side}")}
    return sorted((p for p in out if p.text), key=lambda p: (-len(p.text), p.text, p.attribute, p.value))


#: Between the two groups of a known contrast the nearer one is taken from this Dice coefficient and this lead on.
SIDE_NEAR, SIDE_LEAD = 0.5, 0.05


def _pairs(text: str) -> frozenset[str]:
    """The letter pairs of a text, its ends counted."""
    padded = f" {text} "
    return frozenset(padded[i : i + 2] for i in range(len(padded) - 1))


def _nearest(phrases: Iterable[str], words: list[str], windows: dict[int, list[frozenset[str]]]) -> float:
    """The best Dice coefficient of a phrase and as many words of a text; ``windows`` keeps those of each width."""
    best = 0.0
    for phrase in phrases:
        n, own = len(phrase.split()), _pairs(phrase)
        if n not in windows:
            windows[n] = [_pairs(" ".join(words[i : i + n]).strip("()[],.;:")) for i in range(max(1, len(words) - n + 1))]
        best = max(best, max(2 * len(own & w) / (len(own) + len(w)) for w in windows[n]))
    return best


class Reader:
    """Reads the attributes of texts by a vocabulary."""

    def __init__(self, phrases: list[Phrase]):
        self.by = {}
        for attribute in ("outcome", "contrast", "group"):
            own = [p for p in phrases if p.attribute == attribute]
            if own:
                machine = ahocorasick.Automaton()
                for p in reversed(own):  # of equal texts the first in order stays
                    machine.add_word(p.text.lower(), (len(p.text.lower()), p.value))
                machine.make_automaton()
                bits = np.array([text_bits(p.text) for p in own])
                self.by[attribute] = (own, machine, bits, np.bitwise_count(bits).sum(1))
        owners: dict[str, set[str]] = {}
        for p in phrases:
            sides = _SIDES.match(p.value) if p.attribute == "contrast" else None
            for side in sides.groups() if sides else ():
                owners.setdefault(side, set()).add(p.value)
        #: The contrast of a group that belongs to one only.
        self.contrast_of = {side: min(c) for side, c in owners.items() if len(c) == 1}
        #: The phrases of each group.
        self.phrases_of: dict[str, list[str]] = {}
        for p in phrases:
            if p.attribute == "group":
                self.phrases_of.setdefault(p.value, []).append(p.text.lower())
        self.known: dict[tuple[str, str], str | None] = {}

    def written(self, attribute: str, text: str) -> list[str]:
        """The values of the phrases of an attribute that a text holds as whole words, leftmost and longest first."""
        low = text.lower()
        hits = []
        for last, (size, value) in self.by[attribute][1].iter(low):
            a, b = last + 1 - size, last + 1
            if not (a and low[a - 1].isalnum()) and not low[b : b + 1].isalnum():
                hits.append((a, -b, value))
        out, at = [], 0
        for a, b, value in sorted(hits):
            if a >= at:
                out.append(value)
                at = -b
        return out

    def find(self, attribute: str, text: str | None) -> str | None:
        """The value of an attribute in a text: a phrase as written, else the one whose q-grams it holds best."""
        if not text or attribute not in self.by:
            return None
        key = (attribute, text)
        if key not in self.known:
            if len(self.known) > 200_000:
                self.known.clear()
            own, _, bits, sizes = self.by[attribute]
            written = self.written(attribute, text)
            if written:
                self.known[key] = written[0]
            else:
                held = np.bitwise_count(bits & text_bits(text)).sum(1) / sizes
                best = np.lexsort((-sizes, -held))[0]
                self.known[key] = own[best].value if held[best] >= HELD else None
        return self.known[key]

    def group(self, text: str | None, contrast: str | None) -> str | None:
        """The group in a text: one of the two of the contrast, if that is known."""
        sides = _SIDES.match(contrast or "")
        if not text or sides is None or "group" not in self.by:
            return self.find("group", text)
        key = (contrast, text)
        if key not in self.known:
            written = [v for v in dict.fromkeys(self.written("group", text)) if v in sides.groups()]
            if len(written) == 1:
                self.known[key] = written[0]
            else:
                words, windows = text.lower().split(), {}
                best = [_nearest(self.phrases_of.get(v, ()), words, windows) for v in sides.groups()]
                lead = abs(best[0] - best[1]) >= SIDE_LEAD and max(best) >= SIDE_NEAR
                self.known[key] = sides.groups()[int(best[1] > best[0])] if lead else None
        return self.known[key]


def kind_of(kind: str | None) -> str | None:
    """The canonical kind of a quantity; unknown kinds stand for themselves in lower case."""
    return None if kind is None else _KIND.get(kind.strip().lower(), kind.strip().lower())


def study_of(*texts: str | None) -> str | None:
    """The first study number in the texts."""
    for t in texts:
        for m in _STUDY.finditer(t or ""):
            return m[1] or m[2]
    for t in texts:
        for m in _SLIP.finditer(t or ""):
            if max(SequenceMatcher(None, m[1].lower(), w).ratio() for w in ("experiment", "study", "exp.")) >= 0.75:
                return m[2]
    return None


def printed(value: float | None, kind: str | None) -> str | None:
    """A value as it may be printed; shares are per cent."""
    if value is None or value != value:
        return None
    if kind == "percentage" and abs(value) <= 1:
        value *= 100
    return f"{value:.6g}"


#: The views: sets of fields that two records must nearly share to be a candidate pair.
VIEWS = (("outcome", "contrast"), ("study", "contrast"), ("study", "outcome"), ("printed", "page"), ("printed", "outcome"), ("printed", "contrast"), ("printed", "study"))
#: The fields with bits.
FIELDS = (*WEIGHTS, "printed", "page")
CHUNK_COLUMNS = [f"{f}{i}" for f in FIELDS for i in range(CHUNKS)]


class FieldBits(dict):
    """The q-grams of a field's text as signed 64-bit chunks, looked up once; fields share no bits but by chance."""

    def __missing__(self, key: tuple[int, str]) -> tuple[int, ...]:
        if len(self) > 200_000:
            self.clear()
        field, text = key
        bits = [0] * CHUNKS
        for g in _grams(text):
            at = (((g + field) * 2654435761 & 0xFFFFFFFF) >> 7) % (CHUNKS * 64)
            bits[at % CHUNKS] |= 1 << (at // CHUNKS)
        self[key] = tuple(b - (1 << 64) if b >= 1 << 63 else b for b in bits)
        return self[key]


def _attributes(phrases: list[Phrase]):
    """A pandas function from (quantity_kind, study_id, description, analysis_label, value, page) to the kind, the bits of FIELDS and the numbers."""
    box: list[tuple[Reader, FieldBits]] = []

    def run(kind: pd.Series, study: pd.Series, description: pd.Series, label: pd.Series, value: pd.Series, page: pd.Series) -> pd.DataFrame:
        if not box:
            box.append((Reader(phrases), FieldBits()))
        reader, bits = box[0]
        n = len(kind)
        kinds: list[str | None] = [None] * n
        numbers: list[list] = [[None] * n, [None] * n]
        chunks: list[list] = [[None] * n for _ in CHUNK_COLUMNS]
        for row, (k, s, d, a, v, p) in enumerate(zip(kind, study, description, label, value, page)):
            kinds[row] = k = kind_of(k)
            no = study_of(s, a, d)
            outcome = reader.find("outcome", a) or reader.find("outcome", d)
            contrast = reader.find("contrast", a) or reader.find("contrast", d)
            group = reader.group(d, contrast) if k in GROUP_KINDS else "-"
            contrast = contrast or reader.contrast_of.get(group)
            shown = printed(v, k)
            at = None if p is None or p != p else f"{p:.6g}"
            numbers[0][row] = None if shown is None else float(shown)
            numbers[1][row] = None if at is None else float(p)
            for field, text in enumerate((no, outcome, contrast, group, shown, at)):
                if text is not None:
                    for i, c in enumerate(bits[field, text]):
                        chunks[field * CHUNKS + i][row] = c
        out = {"kind": kinds} | {c: pd.array(x, dtype="Int64") for c, x in zip(CHUNK_COLUMNS, chunks)}
        return pd.DataFrame(out | {"value_number": pd.array(numbers[0], dtype="Float64"), "page_number": pd.array(numbers[1], dtype="Float64")})

    return run


ATTRIBUTES = "kind string, " + ", ".join(f"{c} bigint" for c in CHUNK_COLUMNS) + ", value_number double, page_number double"


def views() -> Column:
    """The view vectors of a record with the bits of FIELDS: array<struct<view, chunks>>, those of whose fields one is unknown left out."""
    each = []
    for no, fields in enumerate(VIEWS):
        known = F.lit(True)
        for f in fields:
            known = known & F.col(f"{f}0").isNotNull()
        chunks = [F.col(f"{fields[0]}{i}").bitwiseOR(F.col(f"{fields[1]}{i}")) for i in range(CHUNKS)]
        each.append(F.when(known, F.struct(F.lit(no).alias("view"), F.array(*chunks).alias("chunks"))))
    return F.array_compact(F.array(*each))


def read_attributes(rows: DataFrame, key: str, phrases: list[Phrase], study: Column) -> DataFrame:
    """``key``, paper_id and the attributes of a list of quantities, one row for each key."""
    run = F.pandas_udf(_attributes(phrases), ATTRIBUTES)
    attributes = run(F.col("quantity_kind"), study, F.col("description"), F.col("analysis_label"), F.col("value"), F.col("location.page"))
    read = rows.where(F.col(key).isNotNull()).select(F.col(key), "paper_id", attributes.alias("a")).select(key, "paper_id", "a.*")
    return read.dropDuplicates([key])  # after reading, so that no text is shuffled


def hamming_pairs(left: DataFrame, right: DataFrame, left_key: str, right_key: str, block: list[str], vectors: Column, keep: Iterable[str] = ()) -> DataFrame:
    """Pairs (left_key, right_key) of one block whose vectors of some view are within RADIUS, once each, with ``keep`` of both (suffixes _l and _r).

    ``vectors`` is the array<struct<view, chunks>> of a row of either side.  Exact multi-index hashing: of RADIUS + 1 pieces a pair within
    the radius agrees in one, and it is emitted by the first in which it agrees.  Only keys, chunks and one hash of block, view and
    piece are shuffled by that hash; what was ``keep`` joins the pairs, where the blocks themselves are compared.  Null
    blocks never pair.
    """
    keep = list(keep)
    width = 64 // PARTED
    piece = lambda chunk, i: F.shiftrightunsigned(F.shiftleft(chunk, 64 - width * (i % PARTED + 1)), 64 - width)

    def chunked(df: DataFrame, key: str, side: str) -> DataFrame:
        known = df.where(" AND ".join(f"`{c}` IS NOT NULL" for c in block)) if block else df
        one = known.select(key, F.xxhash64(*block).alias("__block"), F.inline(vectors))
        each = F.array(*[F.struct(F.lit(i).cast("tinyint").alias("piece"), F.xxhash64("__block", "view", F.lit(i), piece(F.col("chunks")[i // PARTED], i)).alias("__h")) for i in range(RADIUS + 1)])
        return one.select(key, *[F.col("chunks")[i].alias(f"c{i}_{side}") for i in range(CHUNKS)], F.inline(each)).withColumnRenamed("piece", f"piece_{side}")

    pairs = chunked(left, left_key, "l").join(chunked(right, right_key, "r"), "__h")
    off, first = F.lit(0), F.lit(None).cast("int")
    for i in reversed(range(CHUNKS)):
        x, y = F.col(f"c{i}_l"), F.col(f"c{i}_r")
        off = off + F.bit_count(x.bitwiseXOR(y))
        for j in reversed(range(i * PARTED, (i + 1) * PARTED)):
            first = F.when(piece(x, j) == piece(y, j), j).otherwise(first)
    near = pairs.where((off <= RADIUS) & (F.col("piece_l") == first) & (F.col("piece_r") == first)).select(left_key, right_key).distinct()
    a = left.select(left_key, *[F.col(c).alias(f"{c}_l") for c in [*block, *keep]])
    b = right.select(right_key, *[F.col(c).alias(f"{c}_r") for c in [*block, *keep]])
    both = near.join(a, left_key).join(b, right_key)
    for c in block:
        both = both.where(F.col(f"{c}_l") == F.col(f"{c}_r"))
    return both.select(left_key, right_key, *[f"{c}_{s}" for c in keep for s in "lr"])


def view_pairs(left: DataFrame, right: DataFrame, left_key: str, right_key: str, block: list[str], keep: Iterable[str] = ()) -> DataFrame:
    """``hamming_pairs`` over the VIEWS of rows with the bits of FIELDS.

    Blocks of up to DENSE pairs are shuffled once and all their pairs compared, which costs less than a row for each view and piece; larger ones take
    ``hamming_pairs``.
    """
    keep = list(keep)
    mark = F.xxhash64(*block)
    sizes = [df.groupBy(mark.alias("__h")).agg(F.count("*").alias(n)) for df, n in ((left, "n"), (right, "m"))]
    crowded, hashed = cut(sizes[0].join(sizes[1], "__h").where(F.col("n") * F.col("m") > DENSE).select("__h")), None
    if crowded.limit(1).count():
        within = lambda df, how: df.withColumn("__h", mark).join(crowded, "__h", how).drop("__h")
        hashed = hamming_pairs(within(left, "left_semi"), within(right, "left_semi"), left_key, right_key, block, views(), keep)
        left, right = within(left, "left_anti"), within(right, "left_anti")
    columns = list(dict.fromkeys([*CHUNK_COLUMNS, *keep]))
    a = left.select(left_key, *block, *[F.col(c).alias(f"{c}_l") for c in columns])
    b = right.select(right_key, *block, *[F.col(c).alias(f"{c}_r") for c in columns])
    near = F.lit(False)
    for f, g in VIEWS:
        of = lambda i, s: F.col(f"{f}{i}_{s}").bitwiseOR(F.col(f"{g}{i}_{s}"))  # noqa: B023, E731
        off = sum((F.bit_count(of(i, "l").bitwiseXOR(of(i, "r"))) for i in range(1, CHUNKS)), F.bit_count(of(0, "l").bitwiseXOR(of(0, "r"))))
        near = near | F.coalesce(off <= RADIUS, F.lit(False))
    compared = a.join(b, block).where(near).select(left_key, right_key, *[f"{c}_{s}" for c in keep for s in "lr"])
    return compared if hashed is None else compared.unionByName(hashed)


def _ones(column: str, side: str) -> Column:
    return sum((F.bit_count(F.col(f"{column}{i}_{side}")) for i in range(1, CHUNKS)), F.bit_count(F.col(f"{column}0_{side}")))


def similarities(pairs: DataFrame) -> DataFrame:
    """Pairs with identity (the weighted Dice coefficient of the known fields), coverage (their share of the weights), group_open, value_near, page_near and off.

    All in [0, 1] but off, the distance of the values; null where nothing is known on both sides.
    """
    total, weight = F.lit(0.0), F.lit(0.0)
    for f, w in WEIGHTS.items():
        both = sum((F.bit_count(F.col(f"{f}{i}_l").bitwiseAND(F.col(f"{f}{i}_r"))) for i in range(1, CHUNKS)), F.bit_count(F.col(f"{f}0_l").bitwiseAND(F.col(f"{f}0_r"))))
        s = 2 * both / (_ones(f, "l") + _ones(f, "r"))
        total, weight = total + F.coalesce(s * w, F.lit(0.0)), weight + F.when(s.isNotNull(), w).otherwise(0.0)
    x, y = F.col("value_number_l"), F.col("value_number_r")
    off, largest = F.abs(x - y), F.greatest(F.abs(x), F.abs(y))
    value = F.when(x == y, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - off / (VALUE_REACH * largest)))
    page = F.greatest(F.lit(0.0), 1 - F.abs(F.col("page_number_l") - F.col("page_number_r")) / PAGE_REACH)
    return pairs.select(
        "claim_uid", "reader_uid", (total / F.nullif(weight, F.lit(0.0))).alias("identity"), (weight / sum(WEIGHTS.values())).alias("coverage"),
        (F.col("grp0_l").isNull() | F.col("grp0_r").isNull()).alias("group_open"), value.alias("value_near"), page.alias("page_near"), off.alias("off"),
    )


#: The share of true pairs whose known fields contradict each other by a misreading.  It is given, not fitted: candidates
#: that share everything but one field would else pass for matches.
CONTRADICTED = 0.001
#: The start counts as this share of all candidates, so that rare levels of small lists give no certainty.
HELD_BACK = 0.1
#: The mixture's parts and their levels.  Identity: f (all known agrees and all is known), g (all but the group is known), p (all but one), q (less), x (something differs).  Values and pages: 2 (equal), 1 (near), 0 (far).
START = (
    {"f": (0.83, 0.02), "g": (0.06, 0.06), "p": (0.06, 0.06), "q": (0.049, 0.06), "x": (CONTRADICTED, 0.8)},
    {"2": (0.9, 0.1), "1": (0.07, 0.2), "0": (0.03, 0.7)},
    {"2": (0.8, 0.3), "1": (0.12, 0.3), "0": (0.08, 0.4)},
)
PARTS = ("identity", "value_near", "page_near")


def levels() -> Column:
    """The pattern of a pair over PARTS; unknown is -."""
    whole, one = 1 - 1e-9, 1 - (max(WEIGHTS.values()) + 1e-9) / sum(WEIGHTS.values())
    known = F.when(F.col("coverage") >= whole, "f").when(F.col("coverage") >= one, F.when(F.col("group_open"), "g").otherwise("p")).otherwise("q")
    identity = F.when(F.col("identity") < AGREES, "x").otherwise(known)
    near = lambda c: F.when(F.col(c).isNull(), "-").when(F.col(c) == 1, "2").when(F.col(c) > 0, "1").otherwise("0")
    return F.concat(identity, near("value_near"), near("page_near"))


@dataclass(frozen=True)
class Mixture:
    """Log ratios of the levels of each part, the prior log odds, and the mean nearness of the near values among matches."""

    weights: tuple[dict[str, float], ...]
    prior: float
    near: float

    def confidence(self, pattern: str, value_near: float | None = None) -> float:
        """The posterior of a pair; near values count by how near they are."""
        odds = self.prior + sum(self.weights[i][v] for i, v in enumerate(pattern) if v != "-")
        if value_near is not None and pattern[1] == "1":
            odds += self.slope(value_near) - self.weights[1]["1"]
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, odds))))

    def slope(self, s: float) -> float:
        """The weight of a value at nearness ``s``: that of near values at their mean, falling and rising to those of far and equal ones."""
        w = self.weights[1]
        return w["0"] + (w["1"] - w["0"]) * s / self.near if s <= self.near else w["1"] + (w["2"] - w["1"]) * (s - self.near) / (1 - self.near)

    def column(self) -> Column:
        """``confidence`` over the columns of ``similarities`` and ``pattern``."""
        odds = F.lit(self.prior)
        for i, part in enumerate(self.weights):
            level = F.substring("pattern", i + 1, 1)
            known = F.lit(0.0)
            for v, w in sorted(part.items()):
                known = F.when(level == v, F.lit(w)).otherwise(known)
            if i == 1:
                s, w = F.col("value_near"), part
                low = F.lit(w["0"]) + (w["1"] - w["0"]) * s / self.near
                high = F.lit(w["1"]) + (w["2"] - w["1"]) * (s - self.near) / (1 - self.near)
                known = F.when(level == "1", F.when(s <= self.near, low).otherwise(high)).otherwise(known)
            odds = odds + known
        return F.round(1 / (1 + F.exp(-odds)), 6)


def fit_mixture(patterns: dict[str, tuple[int, float]], rounds: int = 60) -> Mixture:
    """The mixture of matches and others, by expectation maximisation over the patterns of all candidate pairs.

    ``patterns`` gives the number of pairs of each pattern and the sum of their values' nearness; there are at most 5 * 4 * 4.
    """
    m = [{v: p[0] for v, p in part.items()} for part in START]
    u = [{v: p[1] for v, p in part.items()} for part in START]
    prior, total, near = 0.3, sum(n for n, _ in patterns.values()), (0.5, 1.0)
    for _ in range(rounds if total else 0):
        sums_m = [{v: 0.5 + HELD_BACK * total * p[0] for v, p in part.items()} for part in START]
        sums_u = [{v: 0.5 + HELD_BACK * total * p[1] for v, p in part.items()} for part in START]
        matched, near_sum, near_n = 0.0, 0.5, 1.0
        for code, (n, nearness) in sorted(patterns.items()):
            odds = math.log(prior / (1 - prior)) + sum(math.log(m[i][v] / u[i][v]) for i, v in enumerate(code) if v != "-")
            g = 1 / (1 + math.exp(-max(-60.0, min(60.0, odds))))
            matched += g * n
            for i, v in enumerate(code):
                if v != "-":
                    sums_m[i][v] += g * n
                    sums_u[i][v] += (1 - g) * n
            if code[1] == "1":
                near_sum, near_n = near_sum + g * nearness, near_n + g * n
        near = (near_sum, near_n)
        prior = min(0.99, max(0.001, matched / total))
        m = [{v: s[v] / sum(s.values()) for v in s} for s in sums_m]
        u = [{v: s[v] / sum(s.values()) for v in s} for s in sums_u]
        rest = sum(p for v, p in m[0].items() if v != "x")
        m[0] = {v: CONTRADICTED if v == "x" else p * (1 - CONTRADICTED) / rest for v, p in m[0].items()}
    weights = tuple({v: math.log(m[i][v] / u[i][v]) for v in START[i]} for i in range(len(START)))
    return Mixture(weights, math.log(prior / (1 - prior)), min(0.99, max(0.01, near[0] / near[1])))


def reliability(matches: DataFrame, true: DataFrame, bins: int = 10) -> DataFrame:
    """bin, n, mean_confidence, share_true: how the confidences of ``matches`` agree with known pairs (claim_uid, reader_uid)."""
    marked = matches.join(true.select("claim_uid", "reader_uid", F.lit(1.0).alias("__hit")).distinct(), ["claim_uid", "reader_uid"], "left")
    cell = F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1)).cast("int")
    return marked.groupBy(cell.alias("bin")).agg(F.count("*").alias("n"), F.avg("confidence").alias("mean_confidence"), F.avg(F.coalesce("__hit", F.lit(0.0))).alias("share_true"))


def match_quantities(claims: DataFrame, readers: DataFrame, mappings: DataFrame, *, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """claim_uid, reader_uid, confidence: which rows of the second list stand for which of the first.

    A pair matches if its confidence, the posterior of the mixture, reaches ``min_confidence``; nothing else decides.  A row of the
    second list has at most one partner, the most confident one, then that of the nearest value; where two are equal in both it
    has none.  A row of the first may have several.

    Null keys are left out, repeated keys are folded (the first delivery read counts).  Null or empty attributes are
    unknown and neither help nor hurt; rows with nothing known but their kind have no partner.  A null paper
    or kind never pairs.  Empty tables give no rows.  Without mappings the texts' attributes stay unknown and only
    studies, values and pages speak.

    Scale: rows are shuffled once, by paper and kind; only blocks of more than DENSE pairs are shuffled by a hash of (paper, kind, view, piece).  A
    value is a candidate only together with a page, study, outcome or contrast, so equal p values of a large paper do not all pair.  Attributes are read once and cut off.  The
    vocabulary (distinct phrases) and the counts of patterns (at most 5 * 4 * 4) are all that the driver sees.
    """
    pairs_of = (
        mappings.select(F.trim("source_text").alias("s"), F.trim("canonical").alias("c")).where("s <> '' AND c <> ''").distinct().limit(MAX_PHRASES + 1).collect()
    )
    if len(pairs_of) > MAX_PHRASES:
        raise ValueError(f"more than {MAX_PHRASES} phrases")
    phrases = vocabulary(sorted((r.s, r.c) for r in pairs_of))
    left = stored(read_attributes(claims, "claim_uid", phrases, F.col("study_id")))  # read once, used twice
    right = stored(read_attributes(readers, "reader_uid", phrases, F.lit(None).cast("string")))
    keep = [c for c in CHUNK_COLUMNS if c.rstrip("0123456789") in WEIGHTS]
    found = view_pairs(left, right, "claim_uid", "reader_uid", ["paper_id", "kind"], [*keep, "value_number", "page_number"])
    scored = stored(similarities(found).withColumn("pattern", levels()))  # used twice: to fit and to match
    patterns = {r.pattern: (r.n, r.near or 0.0) for r in scored.groupBy("pattern").agg(F.count("*").alias("n"), F.sum("value_near").alias("near")).collect()}
    good = scored.withColumn("confidence", fit_mixture(patterns).column()).where(F.col("confidence") >= min_confidence)
    order = Window.partitionBy("reader_uid").orderBy(F.desc("confidence"), F.asc_nulls_last("off"), "claim_uid")
    runner_up = F.lead(F.struct("confidence", "off")).over(order)
    ranked = good.withColumn("rank", F.row_number().over(order)).withColumn("next", runner_up)
    alone = F.col("next").isNull() | ~(F.col("next.confidence").eqNullSafe(F.col("confidence")) & F.col("next.off").eqNullSafe(F.col("off")))
    return ranked.where((F.col("rank") == 1) & alone).select("claim_uid", "reader_uid", "confidence")
