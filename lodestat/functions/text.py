"""Text normalisers, label matching and number forms.

The normalisers differ on purpose and are not interchangeable.  Those that SQL can say are Column expressions; the
rest are vectorised Python functions.
"""

from __future__ import annotations

import math
import re
import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Marks that are one mark.
QUOTES = {ord(c): "'" for c in "‘’‚‛′"} | {ord(c): '"' for c in "“”„‟″"}
DASHES = {ord(c): "-" for c in "‐‑‒–—−"}
STARS = {ord(c): "*" for c in "∗⁎✱＊"}
#: A printed number: no digit, letter or point around it.
NUMBER = r"(?<![\w.])[-−]?(?:\d+(?:,\d{3})*(?:\.\d+)?|\.\d+)(?:[eE][+-]?\d+)?(?![\w]|\.\d)"
SIMPLE_NUMBER = r"[0-9]+(?:[.][0-9]+)?"
WORDS = {
    w: i for i, w in enumerate(
        "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
    )
}
TENS = {w: 10 * i for i, w in enumerate("twenty thirty forty fifty sixty seventy eighty ninety".split(), 2)}


def norm_alnum(c: Column) -> Column:
    """Lower case without anything but ASCII letters and digits."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def norm_name(c: Column) -> Column:
    """Lower case, runs of other characters as one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def norm_source(text: str) -> str:
    """Compatibility form, one minus, one star, single spaces, none before closing marks."""
    text = unicodedata.normalize("NFKC", text).translate({ord("−"): "-"} | STARS)
    return re.sub(r"\s+([,;:)\]])", r"\1", re.sub(r"\s+", " ", text)).strip()


def norm_direction(text: str) -> str:
    """Compatibility form without control characters, subscripts joined to their letter."""
    text = "".join(c for c in unicodedata.normalize("NFKC", text) if c.isspace() or unicodedata.category(c)[0] != "C")
    return re.sub(r"\s+", " ", re.sub(r"(?<=\b[A-Za-z])\s*_\s*(?=\w)", "", text)).strip()


def norm_review(text: str) -> str:
    """Compatibility form, one kind of quote and dash, single spaces, case folded."""
    text = unicodedata.normalize("NFKC", text).translate(QUOTES | DASHES)
    return re.sub(r"\s+", " ", text).strip().casefold()


def compact(text: str) -> str:
    """Compatibility form, one kind of quote and minus, without white space."""
    return re.sub(r"\s+", "", unicodedata.normalize("NFKC", text).translate(QUOTES | DASHES))


def holds_fragments(text: str, quote: str, shortest: int = 12) -> bool:
    """Whether the parts of a quote between ellipses occur in order, each of at least ``shortest`` characters."""
    text, at = compact(text), 0
    parts = [p for p in re.split(r"\.{3}|…", compact(quote)) if p]
    if not parts or any(len(p) < shortest for p in parts):
        return False
    for p in parts:
        at = text.find(p, at)
        if at < 0:
            return False
        at += len(p)
    return True


def ratio(a: str | None, b: str | None) -> float:
    """The matching share of two labels in their alphanumeric form; 1 if either is empty."""
    x, y = (re.sub("[^a-z0-9]", "", (s or "").lower()) for s in (a, b))
    return SequenceMatcher(None, x, y).ratio() if x and y else 1.0


def labels_match(a: str | None, b: str | None) -> bool:
    """Whether labels agree: the same digits in order, and a ratio of at least .8 without a leading ``section``; a label without letters or digits agrees with any."""
    x, y = (re.sub(r"^section\s+", "", (s or "").lower()) for s in (a, b))
    if not re.search("[a-z0-9]", x) or not re.search("[a-z0-9]", y):
        return True
    return re.findall(r"\d+", x) == re.findall(r"\d+", y) and ratio(x, y) >= 0.8


def number_words(text: str) -> int | None:
    """The value of a number in words up to 999."""
    words = [w for w in re.split(r"[\s-]+", text.strip().lower()) if w and w != "and"]
    total, seen = 0, False
    for w in words:
        if w == "hundred" and seen:
            total *= 100
        elif w in TENS:
            total, seen = total + TENS[w], True
        elif w in WORDS:
            total, seen = total + WORDS[w], True
        else:
            return None
    return total if seen else None


def leak_forms(value: float, precision: int | None, least_digits: int = 2) -> list[str]:
    """Every printed form that gives a value away, without its sign: as printed and each coarser rounding, with and without the leading zero.

    An unknown precision is that of the shortest form.  Forms of fewer significant digits and other forms than the printed
    one equal to a significance limit are left out, as are roundings to whole numbers of what is none.
    """
    a = abs(value)
    natural = f"{a:g}" if "e" not in f"{a:g}" else None
    p = precision if precision is not None and 0 <= precision <= 6 else len((natural or "").partition(".")[2])
    printed = f"{a:.{p}f}" if p or natural is None else natural
    forms = [printed, *[f"{a:.{d}f}" for d in range(p - 1, 0, -1)], natural, str(int(a)) if a == int(a) else None]
    out = []
    for shown in forms:
        if shown is None or len(shown.replace(".", "").lstrip("0")) < least_digits or (shown != printed and float(shown) in (0.1, 0.05, 0.01, 0.001)):
            continue
        out.append(shown)
        if shown.startswith("0."):
            out.append(shown[1:])
    return list(dict.fromkeys(out))


def spellings(value: float, precision: int) -> list[str]:
    """The printed spellings of a value: as printed, without the leading zero, with grouped thousands."""
    plain = f"{value:.{precision}f}"
    return list(dict.fromkeys([plain, plain.replace("0.", ".", 1) if abs(value) < 1 else plain, f"{value:,.{precision}f}"]))


def longest_blocks(a: str, b: str, least: int = 30, top: int = 3) -> list[str]:
    """The longest common pieces of two texts."""
    blocks = SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()
    return [a[m.a : m.a + m.size] for m in sorted(blocks, key=lambda m: -m.size)[:top] if m.size >= least]


def vectorised(function, kind: str):
    """A pandas UDF that applies a Python function once to each distinct text of a batch; nulls stay null."""

    def run(texts: pd.Series) -> pd.Series:
        codes, values = pd.factorize(texts)
        out = [function(v) for v in values]
        return pd.Series([None if c < 0 else out[c] for c in codes], dtype=object)

    return F.pandas_udf(run, kind)


def pairwise(function, kind: str):
    """A pandas UDF over two columns."""

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([function(x, y) for x, y in zip(a, b)], dtype=object)

    return F.pandas_udf(run, kind)


# Parsing as Column expressions.


def parse_reported(c: Column) -> Column:
    """``<.001`` as struct<value, comparator>; text without a number gives nulls, a bare number ``=``."""
    pattern = r"^\s*(<=|>=|[<>=≤≥≈~]?)\s*([-−]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)\s*%?\s*$"
    op = F.regexp_extract(c, pattern, 1)
    value = F.nullif(F.regexp_replace(F.regexp_extract(c, pattern, 2), "−", "-"), F.lit("")).try_cast("double")
    op = F.when(op == "≤", "<=").when(op == "≥", ">=").when(op.isin("≈", "~"), "=").when(op == "", "=").otherwise(op)
    return F.struct(value.alias("value"), F.when(value.isNotNull(), op).alias("comparator"))


def number_tokens(c: Column) -> Column:
    """The printed numbers of a text in order, as written."""
    return F.regexp_extract_all(c, F.lit(f"({NUMBER})"), F.lit(1))


def token_value(token: Column) -> Column:
    """The value of a printed number."""
    return F.regexp_replace(F.regexp_replace(token, ",", ""), "−", "-").try_cast("double")


def token_decimals(token: Column) -> Column:
    """The decimals of a printed number."""
    return F.length(F.regexp_extract(token, r"\.(\d+)", 1))


def printed_df(c: Column) -> Column:
    """The degrees of freedom printed as ``t(27)`` or ``F(1, 57)``, if all that are printed agree; else null."""
    found = F.array_distinct(F.regexp_extract_all(c, F.lit(r"\b(?:t|r|F|χ2|χ²)\s?\(\s*([0-9.]+(?:\s*,\s*[0-9.]+)?)\s*\)"), F.lit(1)))
    return F.when(F.size(found) == 1, F.regexp_replace(found[0], r"\s+", ""))


def mask_numbers(c: Column) -> Column:
    """All digits with their decimals, wherever they stand, and number words as ``[quantity]``."""
    words = "|".join([*WORDS, *TENS, "hundred", "thousand"])
    return F.regexp_replace(F.regexp_replace(c, r"\d+(?:\.\d+)?", "[quantity]"), rf"(?i)\b(?:{words})\b", "[quantity]")


def design_markers(c: Column) -> Column:
    """Markers of the design (``2 x 3``, ``85 dB``, ``study 2``), sorted."""
    found = F.regexp_extract_all(F.lower(c), F.lit(r"(\d+\s*[x×]\s*\d+|\d+(?:\.\d+)?\s*(?:db|hz|ms|kg|cm)\b|(?:study|experiment)\s+\d+)"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: F.regexp_replace(x, r"\s+", " "))))


def leak_pattern(form: Column) -> Column:
    """A boundary-aware Java pattern for a printed form."""
    return F.concat(F.lit(r"(?<![\w.])-?"), F.regexp_replace(form, r"\.", r"\\\\."), F.lit(r"(?![\w]|\.\d|%?\s*CI)"))


def jaccard(a: Column, b: Column) -> Column:
    """|A ∩ B| / |A ∪ B| of two arrays as sets; null if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.size(F.array_intersect(a, b)) / F.nullif(union, F.lit(0))


def containment(a: Column, b: Column) -> Column:
    """|A ∩ B| over the smaller set; null if one is empty."""
    small = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.size(F.array_intersect(a, b)) / F.nullif(small, F.lit(0))


def output_density(c: Column) -> Column:
    """The number of decimal tokens of a page."""
    return F.regexp_count(c, F.lit(r"\d*\.\d+"))


def magnitude(x: float) -> int:
    """The power of ten of a number."""
    return math.floor(math.log10(abs(x))) if x else 0


def supports(text: str, value: float, decimals: int, marker: str | None = None) -> bool:
    """Whether a text prints a value: sign, decimals and, if given, the statistic before it must agree."""
    for m in re.finditer(NUMBER, text):
        token = m.group().replace("−", "-").replace(",", "")
        shown = len(token.split(".")[1]) if "." in token else 0
        if shown != decimals or abs(float(token) - value) > 1e-9:
            continue
        if marker is None or re.search(rf"(?<!\w){re.escape(marker)}\s*(?:\([^)]*\))?\s*[=<>≤≥]\s*$", text[: m.start()]):
            return True
    return False


def unique_clause(text: str, quote: str, least: int = 8) -> tuple[int, int] | None:
    """Where a quote stands once in a text, else its longest clause with a number that does."""
    clauses = sorted((c.strip() for c in re.split(r"[;,](?=\s)", quote)), key=lambda c: -len(c))
    for part in (quote, *[c for c in clauses if re.search(r"\d", c)]):
        if len(part) >= least and text.count(part) == 1:
            at = text.index(part)
            return at, at + len(part)
    return None


def sentence_span(text: str, at: int) -> tuple[int, int]:
    """The sentence around an offset, by plain stops; operators of the text subpackage cut whole corpora."""
    start = max((m.end() for m in re.finditer(r"[.!?]\s+|\n\s*\n", text[:at])), default=0)
    m = re.search(r"[.!?](?=\s|$)|\n\s*\n", text[at:])
    return start, at + m.end() if m else len(text)


def replace_spans(text: str, spans: list[tuple[int, int, str]]) -> str:
    """Spans replaced from the right; overlapping spans are an error."""
    last = len(text) + 1
    for a, b, new in sorted(spans, reverse=True):
        if b > last:
            raise ValueError("spans overlap")
        text, last = text[:a] + new + text[b:], a
    return text


def unified_diff(a: str, b: str, cap: int = 200) -> str:
    """The unified diff of two scripts, cut after ``cap`` lines."""
    from difflib import unified_diff as diff

    lines = list(diff(a.splitlines(), b.splitlines(), lineterm="", n=2))
    return "\n".join(lines[:cap])


def first_json(text: str) -> str | None:
    """The first balanced JSON object in a text, without fences."""
    import json

    decoder, at = json.JSONDecoder(), text.find("{")
    while at >= 0:
        try:
            return json.dumps(decoder.raw_decode(text, at)[0])
        except ValueError:
            at = text.find("{", at + 1)
    return None


def scrub(text: str, values: list[str], mark: str = "[withheld]") -> str:
    """A text without the printed values, longest first, where no word or number goes on."""
    for v in sorted(set(values), key=lambda x: -len(x)):
        text = re.sub(rf"(?<![\w.]){re.escape(v)}(?![\w]|\.\d)", mark, text)
    return text


# What names a design, and what leaves it open.
OPEN_DESIGN = r"anova|interaction|mixed|cluster|multilevel|factorial"
PAIRED_TEST = r"paired[- ]?\s*t[- ]?\s*test|matched[- ]pairs?\s*t"
PAIRED_OTHER = r"paired|within[- ]subject|repeated[- ]measures|matched[- ]pairs"
TWO_GROUPS = r"\b(?:two[- ]sample|independent[- ]samples?|between[- ]subjects?|welch|student'?s? t)\b|\bt[- ]?test\b"
CORRELATED = r"\bcorrelat|\bpearson\b|\bspearman\b|\bsimple (?:linear )?regression\b"
LINEAR = r"\bols\b|\blinear (?:model|regression)\b|\blm\b"


def design_of(model: Column, n_predictors: Column, n_covariates: Column, formula: Column | None = None) -> Column:
    """The design that a model's text names, of ``paired``, ``two_group`` and ``correlation``; null if none of them is certain.

    Analyses of variance, interactions, mixed, clustered and factorial models, pairs without a t test, and groups with covariates have none.
    Null counts are none.
    """
    text = F.lower(F.concat_ws(" ", model, *([formula] if formula is not None else [])))
    predictors, covariates = F.coalesce(n_predictors, F.lit(0)), F.coalesce(n_covariates, F.lit(0))
    return (
        F.when((F.trim(text) == "") | text.rlike(OPEN_DESIGN), None)
        .when(text.rlike(PAIRED_TEST), "paired")
        .when(text.rlike(PAIRED_OTHER), None)
        .when(text.rlike(TWO_GROUPS), F.when(covariates == 0, "two_group"))
        .when(text.rlike(CORRELATED) & (predictors <= 1) & (covariates == 0), "correlation")
        .when(text.rlike(LINEAR) & (predictors == 1) & (covariates == 0), "correlation")
    )
