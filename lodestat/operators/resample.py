"""Recipes evaluated on whole samples: estimators, tests and intervals that need draws or matrices.

All specifications run in one job, a group for samples of one size.  A sample is a declared study sample and must not
exceed MAX_SAMPLE rows; larger tables take the aggregate forms of operators.tstats.  Every stream of random numbers is a
NumPy generator seeded by the recipe, over rows in the order of their identity, so results depend neither on
partitions nor on the order of delivery.  Samples of a size share their streams: each is walked once for all of them.
"""

from __future__ import annotations

import json
import math
from bisect import bisect_left
from collections.abc import Generator, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestat.functions.distributions import norm_cdf_np, norm_ppf_np, t_ppf, t_two_sided_np
from lodestat.plans.recipe import Recipe

#: Rows of one sample; resampling holds a block of draws of the sample in memory.
MAX_SAMPLE = 100_000
#: Cells of one block of draws.
BLOCK_CELLS = 2_000_000
#: Draws of up to so many cells are kept for the next sample of the size, as samples of a size share their stream.
KEPT_CELLS = 8_000_000
#: Samples of a matrix product: always as many, the rest zeros, so that a sample's result does not depend on the others.
LANES = 16
#: Samples whose permutations are made together, and those evaluated together in one group of a task, which holds up to GROUP_ROWS rows.
TOGETHER, GROUP_SAMPLES, GROUP_ROWS = 64, 256, 1_000_000
#: Tasks of a job at most.
MAX_TASKS = 1_000


def midranks(v: np.ndarray) -> np.ndarray:
    """Ranks from 1, ties averaged, along the last axis."""
    v = np.asarray(v, float)
    if v.ndim == 1:
        _, inverse, counts = np.unique(v, return_inverse=True, return_counts=True)
        return (np.cumsum(counts) - (counts - 1) / 2)[inverse]
    return np.array([midranks(r) for r in v])


def _g(n: int, f: float) -> int:
    return math.floor(n * f + 1e-9)


def trimmed_mean(v: np.ndarray, f: float) -> np.ndarray:
    g = _g(v.shape[-1], f)
    s = np.sort(v, axis=-1)
    return s[..., g : v.shape[-1] - g].mean(-1)


def winsorized(v: np.ndarray, f: float) -> np.ndarray:
    s = np.sort(v)
    g = _g(len(v), f)
    return np.clip(v, s[g], s[len(v) - g - 1])


def rank_biserial(d: np.ndarray) -> float:
    d = d[d != 0]
    if not len(d):
        return 0.0
    r = midranks(np.abs(d))
    return float((r * np.sign(d)).sum() / r.sum())


def signed_rank_p(d: np.ndarray, exact_no_ties: bool = False) -> float:
    """The two-sided Wilcoxon p: exact where there are neither ties nor zeros and n is at most 50, else normal with continuity."""
    zeros = (d == 0).any()
    d = d[d != 0]
    n = len(d)
    a = np.abs(d)
    ties = len(np.unique(a)) < n
    if exact_no_ties and (ties or zeros):
        raise ValueError("ties or zeros")
    r = midranks(a)
    w = float(r[d > 0].sum())
    if (not ties and not zeros and n <= 50) or exact_no_ties:
        counts = np.zeros(n * (n + 1) // 2 + 1)
        counts[0] = 1.0
        for k in range(1, n + 1):  # subsets of the ranks by their sum
            counts[k:] = counts[k:] + counts[:-k]
        low = min(w, n * (n + 1) / 2 - w)
        return float(min(1.0, 2 * counts[: int(low) + 1].sum() / 2.0**n))
    _, t = np.unique(a, return_counts=True)
    mean = n * (n + 1) / 4
    var = n * (n + 1) * (2 * n + 1) / 24 - (t**3 - t).sum() / 48
    z = (w - mean - 0.5 * np.sign(w - mean)) / math.sqrt(var)
    return min(1.0, math.erfc(abs(z) / math.sqrt(2)))


def spline(c: np.ndarray, knots: tuple[float, float, float]) -> np.ndarray:
    a, b, d = knots
    cube = lambda k: np.maximum(c - k, 0.0) ** 3
    return (cube(a) - cube(b) * (d - a) / (d - b) + cube(d) * (b - a) / (d - b)) / (d - a) ** 2


class Association:
    """Outcome y and predictor x given a nuisance design, for one sample or a batch of draws."""

    def __init__(self, recipe: Recipe, knots: tuple[float, float, float] | None):
        self.recipe, self.knots = recipe, knots

    def design(self, s: dict[str, np.ndarray]) -> np.ndarray:
        r = self.recipe
        n = len(s[r.x])
        cols = [np.ones(n)]
        if r.polynomial:
            c = s[r.polynomial].astype(float)
            if r.spline_probs:
                cols += [c, spline(c, self.knots)]
            else:
                if r.rank:
                    c = midranks(c)
                if r.degree == 2:
                    c = c - c.mean()
                cols += [c] + ([c * c] if r.degree == 2 else [])
        cols += [midranks(s[c]) if r.rank and r.rank_covariates else s[c].astype(float) for c in r.covariates]
        z = np.column_stack(cols)
        if np.linalg.matrix_rank(z) < z.shape[1]:
            raise ValueError("rank-deficient design")
        return z

    def parts(self, s: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The orthonormal nuisance basis, y, and the residuals of y and x."""
        r = self.recipe
        x, y = s[r.x].astype(float), s[r.y].astype(float)
        if r.rank:
            x, y = midranks(x), midranks(y)
        q, _ = np.linalg.qr(self.design(s))
        return q, y, y - q @ (q.T @ y), x - q @ (q.T @ x)

    def effect(self, s: dict[str, np.ndarray]) -> tuple[float, float, float]:
        """(effect, full partial correlation, degrees of freedom)."""
        q, y, ey, ex = self.parts(s)
        full = _corr(ey, ex)
        effect = full if self.recipe.estimator == "partial" else _corr(y, ex)
        return effect, full, len(y) - q.shape[1] - 1.0


def _corr(a: np.ndarray, b: np.ndarray) -> float:
    a, b = a - a.mean(), b - b.mean()
    scale = math.sqrt(float(a @ a) * float(b @ b))
    if scale == 0:
        raise ValueError("a constant cannot be correlated")
    return float(a @ b) / scale


def bca_interval(draws: np.ndarray, theta: float, leave_out: np.ndarray, level: float = 0.95) -> tuple[float, float]:
    """The bias-corrected accelerated interval; nan where it is not defined."""
    b = len(draws)
    ties = np.abs(draws - theta) <= 1e-12 * max(1.0, abs(theta))
    share = (np.sum((draws < theta) & ~ties) + ties.sum() / 2) / b
    z0 = norm_ppf_np(min(max(share, 0.5 / b), 1 - 0.5 / b))
    infl = leave_out.mean() - leave_out
    denom = 6 * (infl @ infl) ** 1.5
    if denom == 0 or draws.min() == draws.max():
        return math.nan, math.nan
    a = float((infl**3).sum() / denom)
    probs = []
    for p in ((1 - level) / 2, (1 + level) / 2):
        z = norm_ppf_np(p)
        probs.append(norm_cdf_np(z0 + (z0 + z) / (1 - a * (z0 + z))))
    if not probs[0] < probs[1]:
        return math.nan, math.nan
    lo, hi = np.quantile(draws, probs)
    return float(lo), float(hi)


def _blocks(draws: int, n: int) -> Iterator[int]:
    size = max(1, min(draws, BLOCK_CELLS // max(n, 1)))
    for at in range(0, draws, size):
        yield min(size, draws - at)


def _screen(r: Recipe, s: dict[str, np.ndarray], chi2: dict[int, float]) -> np.ndarray:
    """Rows kept by the recipe's outlier rule."""
    n = len(s[r.x])
    if r.outliers == "none":
        return np.ones(n, bool)
    if r.outliers == "iqr_difference":
        d = s[r.x] - s[r.y]
        q1, q3 = np.quantile(d, [0.25, 0.75])
        return (d >= q1 - r.outlier_k * (q3 - q1)) & (d <= q3 + r.outlier_k * (q3 - q1))
    if r.outliers == "mahalanobis":
        m = np.column_stack([s[c] for c in dict.fromkeys((r.x, r.y, *r.covariates))]).astype(float)
        cov = np.atleast_2d(np.cov(m, rowvar=False))
        if np.linalg.matrix_rank(cov) < m.shape[1]:
            raise ValueError("singular covariance")
        c = m - m.mean(0)
        return np.einsum("ij,jk,ik->i", c, np.linalg.inv(cov), c) <= chi2[m.shape[1]]
    z = Association(Recipe(design="association", x=r.x, y=r.y, estimator="partial", test="t", covariates=r.covariates, polynomial=r.polynomial, degree=r.degree), None).design(s)
    q, _ = np.linalg.qr(z)
    lever = (q * q).sum(1)
    scores = []
    for v in (s[r.y].astype(float), s[r.x].astype(float)):
        e = v - q @ (q.T @ v)
        scores.append(np.abs(e) / (math.sqrt(e @ e / (n - z.shape[1])) * np.sqrt(1 - lever)))
    score = np.round(np.maximum(*scores), 12)
    kept = np.ones(n, bool)
    kept[np.argsort(-score, kind="stable")[: math.ceil(r.outlier_k * n)]] = False
    return kept


@dataclass(frozen=True)
class Ask:
    """What an evaluation needs of a stream's draws: its answers' kind and what they are made of."""

    what: str
    seed: int
    n: int
    draws: int
    given: tuple | Permuted


def evaluate(r: Recipe, sample: dict[str, np.ndarray], chi2: dict[int, float] | None = None) -> dict[str, float | None]:
    """estimate, se, df, n, p_raw, ci_lower, ci_upper of one recipe on one sample (rows in identity order)."""
    (result,) = evaluate_all([(r, sample)], chi2)
    if isinstance(result, ValueError):
        raise result
    return result


def evaluate_all(pairs: Iterable[tuple[Recipe, dict[str, np.ndarray]]], chi2: dict[int, float] | None = None) -> list[dict | ValueError]:
    """What ``evaluate`` gives or raises for each recipe and sample; a stream is walked once for all that ask for its draws."""
    going = [(k, _evaluation(r, s, chi2 or {}), None) for k, (r, s) in enumerate(pairs)]
    out: list[dict | ValueError] = [{}] * len(going)
    while going:
        asked: dict[tuple, list] = {}
        for k, steps, answer in going:
            try:
                ask = steps.send(answer)
                asked.setdefault((ask.what, ask.seed, ask.n, ask.draws), []).append((k, steps, ask.given))
            except StopIteration as done:
                out[k] = done.value
            except ValueError as e:
                out[k] = e
        going = []
        for stream, some in asked.items():
            answers = ANSWERS[stream[0]](stream, [given for _, _, given in some])
            going += [(k, steps, answer) for (k, steps, _), answer in zip(some, answers)]
    return out


def _evaluation(r: Recipe, sample: dict[str, np.ndarray], chi2: dict[int, float]) -> Generator[Ask, object, dict]:
    """One recipe on one sample; yields what it asks of a stream."""
    cols = list(dict.fromkeys([r.x, r.y, *r.covariates, *([r.polynomial] if r.polynomial else [])]))
    s = {c: np.asarray(sample[c], float) for c in cols}
    complete = np.all([np.isfinite(v) | np.isnan(v) for v in s.values()], axis=0)
    if not complete.all():
        raise ValueError("infinite value")
    keep = ~np.any([np.isnan(v) for v in s.values()], axis=0)
    if keep.sum() < 4:
        raise ValueError("fewer than four rows")
    s = {c: v[keep] for c, v in s.items()}
    knots = tuple(np.quantile(s[r.polynomial], r.spline_probs)) if r.spline_probs and r.polynomial else None
    if r.transform == "log":
        for c in (r.x, r.y):
            if (s[c] <= 0).any():
                raise ValueError("a logarithm needs positive values")
            s[c] = np.log(s[c])
    keep = _screen(r, s, chi2)
    s = {c: v[keep] for c, v in s.items()}
    n = len(s[r.x])
    if n < 4:
        raise ValueError("fewer than four rows")
    out: dict[str, float | None] = {"n": n, "se": None, "df": None, "p_raw": None, "ci_lower": None, "ci_upper": None}
    return out | (yield from _paired(r, s, n) if r.design == "paired" else _association(r, s, n, knots))


def _ends(lo: float, hi: float) -> dict[str, float]:
    return {"ci_lower": float(lo), "ci_upper": float(hi)}


def _paired(r: Recipe, s: dict[str, np.ndarray], n: int) -> Generator[Ask, object, dict]:
    x, y = s[r.x], s[r.y]
    d = x - y
    out: dict = {}
    statistic = {
        "mean": lambda a, b: (a - b).mean(-1),
        "trimmed_difference": lambda a, b: trimmed_mean(a - b, r.trim),
        "yuen": lambda a, b: trimmed_mean(a, r.trim) - trimmed_mean(b, r.trim),
        "rank_biserial": lambda a, b: np.array([rank_biserial(v) for v in np.atleast_2d(a - b)]),
    }[r.estimator]
    theta = float(np.asarray(statistic(x, y)).ravel()[0])
    if r.estimator == "mean":
        se, df = d.std(ddof=1) / math.sqrt(n), n - 1.0
    elif r.estimator in ("trimmed_difference", "yuen"):
        h = n - 2 * _g(n, r.trim)
        if h < 3:
            raise ValueError("too few rows are left")
        w = winsorized(d, r.trim) if r.estimator == "trimmed_difference" else winsorized(x, r.trim) - winsorized(y, r.trim)
        se, df = w.std(ddof=1) * math.sqrt((n - 1) / (h * (h - 1))), h - 1.0
    else:
        se = df = None
    out |= {"estimate": theta, "se": se, "df": df}
    drawn = lambda i: np.asarray(statistic(x[i], y[i]) if r.estimator == "yuen" else statistic(d[i], 0.0)).ravel()
    if r.test in ("t", "yuen"):
        both = t_two_sided_np(theta / se, df)
        out["p_raw"] = both if r.alternative == "two-sided" else both / 2 if (theta > 0) == (r.alternative == "greater") else 1 - both / 2
    elif r.test == "wilcoxon":
        out["p_raw"] = signed_rank_p(d)
    elif r.test == "centred_bootstrap":
        out["p_raw"] = centred_bootstrap_p(np.concatenate([drawn(i) for i in rng_blocks(r, n, r.null_draws)]), theta, r.alternative)
    elif n <= 16:
        out["p_raw"] = sign_flip_p(d, r)
    else:
        out["p_raw"] = ((yield Ask("sign", r.seed, n, r.null_draws, (d, _flip_hit(r, d)))) + 1) / (r.null_draws + 1)
    if r.interval in ("student_t", "yuen"):
        reach = t_ppf(0.975, df) * se
        out |= _ends(theta - reach, theta + reach)
    elif r.interval in ("percentile", "bca"):
        ask = lambda kind, v: Ask("index", _seed(r, n), n, r.bootstrap_draws, (kind, v, _g(n, r.trim)))
        if r.estimator == "mean":
            boot = yield ask("mean", d)
        elif r.estimator == "trimmed_difference":
            boot = yield ask("trimmed", d)
        elif r.estimator == "yuen":
            boot = (yield ask("trimmed", x)) - (yield ask("trimmed", y))
        else:
            boot = np.concatenate([drawn(i) for i in rng_blocks(r, n)])
        if r.interval == "percentile":
            out |= _ends(*np.quantile(boot, [0.025, 0.975]))
        else:
            jack = (d.sum() - d) / (n - 1) if r.estimator == "mean" else np.array([float(np.asarray(statistic(np.delete(x, i), np.delete(y, i))).ravel()[0]) for i in range(n)])
            out |= _ends(*bca_interval(boot, theta, jack))
    return out


def _seed(r: Recipe, n: int) -> int:
    """The seed of the bootstrap draws, which may add the sample's size."""
    return r.seed + (n if r.seed_by_size else 0)


def rng_blocks(r: Recipe, n: int, draws: int | None = None) -> Iterator[np.ndarray]:
    """Row indices of the bootstrap draws, in blocks of one stream."""
    yield from _stream("index", _seed(r, n), n, draws or r.bootstrap_draws)


def _stream(what: str, seed: int, n: int, draws: int) -> Iterator[np.ndarray]:
    """All draws of a stream for samples of n rows, one a row, in blocks: row indices, signs as 0 and 1, or permutations of the rows."""
    if draws * n <= KEPT_CELLS:
        yield from _slices(_kept(what, seed, n, draws))
        return
    yield from _made(what, seed, n, draws)


def _made(what: str, seed: int, n: int, draws: int) -> Iterator[np.ndarray]:
    rng = np.random.default_rng(seed)
    for size in _blocks(draws, n):
        if what == "permutation":
            rows = np.tile(np.arange(n), (size, 1))  # whole words, which are moved faster
            yield rng.permuted(rows, axis=1, out=rows)
        else:
            yield rng.integers(0, 2 if what == "sign" else n, (size, n))


@lru_cache(maxsize=8)
def _kept(what: str, seed: int, n: int, draws: int) -> np.ndarray:
    """The whole stream in small numbers."""
    kind = np.int8 if what == "sign" else np.int16 if n < 2**15 else np.int32
    return np.concatenate([some.astype(kind) for some in _made(what, seed, n, draws)])


def _slices(kept: np.ndarray) -> Iterator[np.ndarray]:
    at = 0
    for size in _blocks(*kept.shape):
        yield kept[at : at + size]
        at += size


def centred_bootstrap_p(boot: np.ndarray, theta: float, alternative: str) -> float:
    """The p of an estimate under resampled estimates moved to a null of zero, as (k + 1) / (B + 1)."""
    null = boot - theta
    k = {"two-sided": np.abs(null) >= abs(theta), "greater": null >= theta, "less": null <= theta}[alternative].sum()
    return (int(k) + 1) / (len(boot) + 1)


def _flip_hit(r: Recipe, d: np.ndarray):
    effect = d.mean()
    return {
        "two-sided": lambda null: np.abs(null) >= abs(effect) - 1e-12, "greater": lambda null: null >= effect - 1e-12, "less": lambda null: null <= effect + 1e-12,
    }[r.alternative]


def sign_flip_p(d: np.ndarray, r: Recipe, rng: np.random.Generator | None = None) -> float:
    """The sign-flip p: all 2 ** n signs for n up to 16, else seeded draws with (k + 1) / (B + 1)."""
    n, hit = len(d), _flip_hit(r, d)
    if n <= 16:
        signs = 1 - 2 * ((np.arange(2**n)[:, None] >> np.arange(n)) & 1)
        return float(hit(signs @ d / n).mean())
    bits = (rng.integers(0, 2, (size, n)) for size in _blocks(r.null_draws, n)) if rng else _stream("sign", r.seed, n, r.null_draws)
    return (_flipped(bits, n, [(d, hit)])[0] + 1) / (r.null_draws + 1)


def _lanes(rows: list[np.ndarray]) -> Iterator[tuple[int, int, np.ndarray]]:
    """Rows in matrices of LANES, the last one filled with zeros: first row, number of rows, matrix."""
    for at in range(0, len(rows), LANES):
        some = rows[at : at + LANES]
        yield at, len(some), np.vstack([*some, *[np.zeros(len(some[0]))] * (LANES - len(some))])


def _flipped(bits: Iterable[np.ndarray], n: int, given: list[tuple]) -> list[int]:
    """How many draws of signs hit, for each sample's differences and rule."""
    k = [0] * len(given)
    lanes = list(_lanes([d for d, _ in given]))
    for some in bits:
        signs = 2.0 * some - 1
        for at, count, m in lanes:
            nulls = m @ signs.T / n
            for j in range(count):
                k[at + j] += int(given[at + j][1](nulls[j]).sum())
    return k


def _resampled(stream: tuple, given: list[tuple]) -> list[np.ndarray]:
    """The means or trimmed means of all bootstrap draws, for each sample's values.

    A draw is how often it takes each row.  Values count from one of the sample's, so that equal values give equal draws.
    """
    _, _, n, draws = stream
    out = np.empty((len(given), draws))
    means = [k for k, (kind, *_) in enumerate(given) if kind == "mean"]
    base = [np.sort(given[k][1])[n // 2] for k in means]
    centred = [(given[k][1] - b) / n for k, b in zip(means, base)]
    trims = [(k, _steps(v), g) for k, (kind, v, g) in enumerate(given) if kind == "trimmed"]
    part = 48 * max(1, 5_000 // n)  # whole tiles of the product, so that a draw's place doesn't matter
    done = 0
    for index in _stream(*stream):
        counts, end = _counts(index, n), done + len(index)
        for k, b in zip(means, base):
            out[k, done:end] = b
        uncut = [-_trimmed(counts, *steps, g, out[k, done:end]) for k, steps, g in trims]
        lanes, rows = list(_lanes(centred + uncut)), means + [k for k, *_ in trims]
        taken = np.zeros((n, part))
        for at in range(0, len(index), part):
            here = min(part, len(index) - at)
            taken[:, :here] = counts[:, at : at + here]
            for first, some, m in lanes:
                out[rows[first : first + some], done + at : done + at + here] += (m @ taken)[:some, :here]
        done = end
    return list(out)


def _counts(index: np.ndarray, n: int) -> np.ndarray:
    """How often each draw takes each row: rows by draws."""
    size = len(index)
    out = np.empty((n, size), np.int16 if n < 2**15 else np.int32)
    for at in range(0, size, part := max(1, 250_000 // n)):
        some = index[at : at + part].astype(np.int64)
        width = len(some)
        out[:, at : at + width] = np.bincount((some * width + np.arange(width)[:, None]).ravel(), minlength=n * width).reshape(n, width)
    return out


def _steps(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of the values, the values in it, and the steps from each to the next."""
    order = np.argsort(v, kind="stable")
    return order, v[order], np.diff(v[order])


def _trimmed(counts: np.ndarray, order: np.ndarray, values: np.ndarray, steps: np.ndarray, g: int, out: np.ndarray) -> np.ndarray:
    """The trimmed mean of each draw: the middle value, and each step between neighbours as often as kept places lie beyond it.

    Steps that no draw cuts are left to the caller: what is returned, times the counts, is to be taken off.
    """
    n, middle = len(values), len(values) // 2
    below = counts[order]  # places up to each value
    for j in range(1, n):
        below[j] += below[j - 1]
    at_first = lambda reached: bisect_left(range(n - 1), True, key=lambda j: bool(reached(below[j])))
    # where every draw cuts a step off it counts for nothing, and where none does it counts in proportion
    start, stop = at_first(lambda b: b.min() >= g), at_first(lambda b: b.max() > n - g)
    if start >= stop:
        start = stop = middle
    low, high = min(at_first(lambda b: b.max() > g), middle, start), max(at_first(lambda b: b.min() >= n - g), middle, stop)
    beyond = np.where(np.arange(n - 1) < middle, g, n - g)
    rows, share = np.r_[low:start, stop:high], 1 / (n - 2 * g)
    kept = np.clip(below[rows], g, n - g)
    kept -= beyond[rows, None].astype(kept.dtype)
    fixed = values[middle] + float(steps[start:stop] @ beyond[start:stop]) * share
    for at in range(0, kept.shape[1], part := max(1, 125_000 // n)):
        out[at : at + part] = fixed - steps[rows] @ kept[:, at : at + part].astype(float) * share
    weights = np.zeros(n)
    weights[order[:stop]] = np.concatenate([np.full(start, steps[start:stop].sum()), np.cumsum(steps[start:stop][::-1])[::-1]]) * share
    return weights


def _association(r: Recipe, s: dict[str, np.ndarray], n: int, knots) -> Generator[Ask, object, dict]:
    a = Association(r, knots)
    effect, full, df = a.effect(s)
    t = full * math.sqrt(df / max(1 - full * full, 1e-300))
    out: dict = {"estimate": effect, "df": df}
    if r.test == "t":
        both = t_two_sided_np(t, df)
        out["p_raw"] = both if r.alternative == "two-sided" else both / 2 if (t > 0) == (r.alternative == "greater") else 1 - both / 2
    else:
        k = yield Ask("permutation", r.seed, n, r.null_draws, Permuted.of(r, a, s, effect, t, df))
        out["p_raw"] = (k + 1) / (r.null_draws + 1)
    if r.interval == "fisher_z":
        reach = norm_ppf_np(0.975) / math.sqrt(df - 1)
        out |= _ends(math.tanh(math.atanh(effect) - reach), math.tanh(math.atanh(effect) + reach))
    elif r.interval == "percentile":
        boot = np.array([a.effect({c: v[i] for c, v in s.items()})[0] for block in rng_blocks(r, n) for i in block])
        out |= _ends(*np.quantile(boot, [0.025, 0.975]))
    return out


@dataclass(frozen=True)
class Permuted:
    """A permutation test of one sample: what is moved, what it is held against, and what the statistic must reach."""

    moved: np.ndarray
    fitted: np.ndarray
    centred: np.ndarray
    q: np.ndarray
    want: float
    df: float
    by_t: bool
    lane: bool
    projected: bool

    @classmethod
    def of(cls, r: Recipe, a: Association, s: dict[str, np.ndarray], effect: float, t: float, df: float) -> Permuted:
        q, y, ey, ex = a.parts(s)
        x = midranks(s[r.x]) if r.rank else s[r.x].astype(float)
        moved, fixed = (ey, ex) if r.permute == "outcome" else (ex, ey if r.estimator == "partial" else y)
        fitted = (y if r.permute == "outcome" else x) - moved
        by_t, lane = r.permutation_statistic == "t", r.test == "freedman_lane"
        projected = lane and (r.permute == "predictor" or r.estimator == "partial" or by_t)
        return cls(moved, fitted, fixed - fixed.mean(), q, abs(t) if by_t else abs(effect), df, by_t, lane, projected)

    def hits(self, order: np.ndarray) -> int:
        """How many of the permutations reach what the sample has."""
        moved, centred, q = self.moved, self.centred, self.q
        scale = math.sqrt(float(centred @ centred))
        squares, new = float(moved @ moved), moved[order]
        if self.lane and not self.projected:
            new += self.fitted
            new -= new.mean(1, keepdims=True)
            top, square = new @ centred, (new * new).sum(1)
        elif self.lane:  # what was fitted lies in the span of q, which holds the constant, and falls out with it
            z = new @ np.column_stack([centred, q])
            top, square = z[:, 0] - z[:, 1:] @ (q.T @ centred), squares - (z[:, 1:] ** 2).sum(1)
        else:  # a permutation keeps the sum and the squares
            top, square = new @ centred, squares - float(moved.sum()) ** 2 / len(moved)
        c = top / (np.sqrt(square) * scale)
        value = np.abs(c) * np.sqrt(self.df / np.maximum(1 - c * c, 1e-300)) if self.by_t else np.abs(c)
        return int((value >= self.want - 1e-12).sum())

    def against(self) -> np.ndarray:
        """The columns of unit length whose products with the moved values decide; the first is the fixed one, a constant one is left out."""
        moving = self.q[:, np.ptp(self.q, axis=0) > 1e-9] if self.lane else self.q[:, :0]
        return np.column_stack([self.centred / math.sqrt(float(self.centred @ self.centred)), moving])

    def decided(self, z: np.ndarray, off: float) -> tuple[np.ndarray, np.ndarray]:
        """Draws that surely hit, and those that are too near, from products z (columns by draws) of unit vectors that are wrong by ``off`` at most."""
        unit = math.sqrt(float(self.moved @ self.moved))
        first = self.against()[:, 0]
        total = float(self.moved.sum()) / unit
        top = z[0].astype(float)
        square = np.full(len(top), 1 - total**2 / len(self.moved))
        if self.lane:
            steady = np.ptp(self.q, axis=0) <= 1e-9
            weights = self.q.T @ first
            top = top - weights[~steady] @ z[1:] - total * float(self.q.mean(0)[steady] @ weights[steady])
            square = 1 - total**2 * float((self.q.mean(0)[steady] ** 2).sum()) - (z[1:].astype(float) ** 2).sum(0)
        want = self.want / math.sqrt(self.df + self.want**2) if self.by_t else self.want
        with np.errstate(all="ignore"):
            value = np.abs(top) / np.sqrt(square)
        # with a square of a quarter at least: twice the error of top, and that of the square, which is twice that of each column
        near = ~(np.abs(value - want) > (2 + 12 * (len(z) - 1)) * off + 1e-9) | ~(square > 0.25)
        return ~near & (value >= want), near


def _permuted(stream: tuple, given: list[Permuted]) -> list[int]:
    """How many permutations hit, for each test.

    Products are made in single precision for many samples at once; draws whose outcome that leaves open are made again in double.
    """
    _, _, n, _ = stream
    k = [0] * len(given)
    off = (n + 8) * 2.0**-23  # of a sum of n products of unit vectors, twice over
    linear: dict[int, list[int]] = {}
    usable = lambda p: (p.projected or not p.lane) and float(p.moved @ p.moved) > 0 and float(p.centred @ p.centred) > 0
    for j, p in enumerate(given):
        linear.setdefault(p.against().shape[1] if usable(p) else 0, []).append(j)
    whole = linear.pop(0, [])
    unit = lambda p: p.moved / math.sqrt(float(p.moved @ p.moved))
    alone, batches = [], []
    for width, some in linear.items():
        for own in np.array_split(some, -(-len(some) // TOGETHER)):
            if len(own) < LANES // 2:
                alone += [(j, unit(given[j]).astype(np.float32), given[j].against().astype(np.float32)) for j in own]
                continue
            lanes = -(-len(own) // 8) * 8
            moved, against = np.zeros((n, lanes), np.float32), np.zeros((width, n, lanes), np.float32)
            for i, j in enumerate(own):
                moved[:, i], against[:, :, i] = unit(given[j]), given[j].against().T
            batches.append((own, moved, against))

    def count(j: int, order: np.ndarray, z: np.ndarray) -> int:
        hit, near = given[j].decided(z, off)
        return int(hit.sum()) + (given[j].hits(order[near]) if near.any() else 0)

    for order in _stream(*stream):
        for j in whole:
            k[j] += given[j].hits(order)
        part = max(1, 250_000 // n)
        made = [np.empty((len(order), against.shape[1]), np.float32) for _, _, against in alone]
        new = np.empty((part, n), np.float32)
        for at in range(0, len(order), part) if alone else ():
            some = order[at : at + part].astype(np.intp)
            for z, (_, moved, against) in zip(made, alone):
                np.take(moved, some, out=new[: len(some)], mode="clip")
                np.matmul(new[: len(some)], against, out=z[at : at + part])
        for z, (j, _, _) in zip(made, alone):
            k[j] += count(j, order, np.ascontiguousarray(z.T))
        for own, moved, against in batches:
            width, _, lanes = against.shape
            z = np.empty((width, len(order), lanes), np.float32)
            part = max(1, 128_000 // (n * lanes))
            new = np.empty((part, n, lanes), np.float32)
            for at in range(0, len(order), part):
                some = order[at : at + part].astype(np.intp)
                np.take(moved, some, axis=0, out=new[: len(some)], mode="clip")
                for c in range(width):
                    np.einsum("kis,is->ks", new[: len(some)], against[c], out=z[c, at : at + part])
            for i, j in enumerate(own):
                k[j] += count(j, order, np.ascontiguousarray(z[:, :, i]))
    return k


#: What answers the asks of each kind of stream.
ANSWERS = {"index": _resampled, "sign": lambda stream, given: _flipped(_stream(*stream), stream[2], given), "permutation": _permuted}

RESULT = "estimate double, se double, df double, n bigint, p_raw double, ci_lower double, ci_upper double, problem string"
_NAMES = [c.split()[0] for c in RESULT.split(", ")]
_KINDS = [{"double": pa.float64(), "bigint": pa.int64(), "string": pa.string()}[c.split()[1]] for c in RESULT.split(", ")]


def _columns(r: Recipe) -> set[str]:
    return {r.x, r.y, *r.covariates, *([r.polynomial] if r.polynomial else [])}


def _sets(recipes: dict[str, Recipe]) -> list[tuple[list[str], list[tuple[str, Recipe]]]]:
    """Recipes by the columns that decide how many rows of a sample are complete, as that is what draws depend on; those without draws are one set."""
    draws = lambda r: r.interval in ("bca", "percentile") or r.test in ("sign_flip", "centred_bootstrap", "freedman_lane", "residual_permutation")
    rest = sorted(set().union(*[_columns(r) for r in recipes.values() if not draws(r)]))
    out: dict[tuple, list] = {}
    for spec, r in sorted(recipes.items()):
        key = sorted(_columns(r))
        own = key if draws(r) or any(draws(o) and sorted(_columns(o)) == key for o in recipes.values()) else rest
        out.setdefault(tuple(own), []).append((spec, r))
    return [(list(columns), listed) for columns, listed in out.items()]


def run_recipes(df: DataFrame, recipes: dict[str, Recipe], identity: str, by: list[str] | None = None) -> DataFrame:
    """spec_id, by and the result of every recipe on every group, in one job.

    ``problem`` says why a recipe could not be evaluated; such a row has nulls.  A group above MAX_SAMPLE rows is an
    error: such tables take the aggregate forms.  Null or repeated identities are an error.  Empty tables give no rows.

    Scale: a sample is one row of arrays, once for each set of columns that the recipes with draws need.  Samples with as many complete
    rows are evaluated together, up to about GROUP_SAMPLES and GROUP_ROWS, so draws are made once for all of them.  Only how many samples there are of
    each size is read to the driver.
    """
    by = by or []
    spark, sets = df.sparkSession, _sets(recipes)
    columns = sorted(set().union(*[c for c, _ in sets]))
    from lodestat.functions.distributions import quantile

    widths = {len({r.x, r.y, *r.covariates}) for r in recipes.values() if r.outliers == "mahalanobis"}
    chi2 = {w: quantile(spark, "chi2", 0.975, w) for w in widths}
    kinds = dict(df.dtypes)
    name = {c: f"__c{k}" for k, c in enumerate(columns)}
    rows = df.select(*by, F.col(identity).alias("__id"), *[F.coalesce(F.col(c).cast("double"), F.lit(math.nan)).alias(name[c]) for c in columns])
    whole = [F.count_if(~F.greatest(*[F.isnan(name[c]) for c in [*own, own[0]]])) for own, _ in sets]
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("__set"), F.least(F.col(f"__n{k}"), F.lit(MAX_SAMPLE + 1)).alias("__n")) for k in range(len(sets))]))
    counted = [w.alias(f"__n{k}") for k, w in enumerate(whole)]
    sizes = rows.groupBy(*by).agg(F.count("*").alias("__rows"), *counted).select("__rows", each.alias("__s")).groupBy("__s.__set", "__s.__n")
    found = sizes.agg(F.count("*").alias("samples"), F.sum("__rows").alias("rows"), F.max("__rows").alias("most")).collect()
    if any(f.most > MAX_SAMPLE for f in found):
        raise ValueError(f"a sample has more than {MAX_SAMPLE} rows")
    parts = [max(1, -(-f.samples // GROUP_SAMPLES), -(-(f.rows or 0) // GROUP_ROWS)) for f in found]
    first = np.cumsum([0, *parts])
    places = pa.table({"__set": pa.array([f["__set"] for f in found], pa.int32()), "__n": pa.array([f["__n"] for f in found], pa.int64()), "__first": pa.array(first[:-1], pa.int64()), "__parts": pa.array(parts, pa.int64())})
    known = F.col("__count") == F.size(F.array_distinct(F.filter("__all.__id", F.isnotnull)))
    if kinds[identity] in ("double", "float"):
        known &= ~F.exists("__all.__id", F.isnan)
    samples = rows.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("__id", *name.values()))).alias("__all"), F.count("*").alias("__count"), *counted)
    samples = samples.where("__count > 0").select(*by, known.alias("__known"), "__all", each.alias("__s")).select(*by, "__known", "__all", "__s.*")
    held = [F.when(F.col("__set").isin([k for k, (own, _) in enumerate(sets) if c in own]), F.col(f"__all.{name[c]}")).alias(name[c]) for c in columns]
    group = (F.col("__first") + F.pmod(F.xxhash64(*by) if by else F.lit(0), "__parts")).alias("__group")
    placed = samples.join(spark.createDataFrame(places), ["__set", "__n"]).select(group, "__set", *by, "__known", *held)

    def run(table: pa.Table) -> pa.Table:
        own, listed = sets[table.column("__set")[0].as_py()]
        held = {c: table.column(name[c]).to_pandas() for c in own}
        sure = table.column("__known").to_pylist()
        pairs = [(r, {c: held[c][j] for c in own}) for j, good in enumerate(sure) if good for _, r in listed]
        evaluated = iter(evaluate_all(pairs, chi2))
        unsure = ValueError("identities must be unique and known")
        results = [next(evaluated) if good else unsure for good in sure for _ in listed]
        results = [{"problem": str(x)} if isinstance(x, ValueError) else x for x in results]
        at = pa.array(np.repeat(np.arange(len(sure)), len(listed)))
        out = {c: table.column(c).take(at) for c in by} | {"spec_id": pa.array([spec for _ in sure for spec, _ in listed], pa.string())}
        for c, kind in zip(_NAMES, _KINDS):
            out[c] = pa.array([None if (v := x.get(c)) is None else v if kind == pa.string() else int(v) if kind == pa.int64() else float(v) for x in results], kind)
        return pa.table(out)

    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in by], "spec_id string", RESULT])
    return placed.repartition(max(1, min(MAX_TASKS, int(first[-1]))), "__group").groupBy("__group").applyInArrow(run, schema)


#: The engine's seed, to which a sample's size is added, and its draws.
ENGINE_SEED, ENGINE_DRAWS = 8729, 9_999


def paired_engine(df: DataFrame, x: str, y: str, identity: str, draws: int = ENGINE_DRAWS) -> DataFrame:
    """The registered engine over one declared paired sample: omitted (null: none), spec_id and the result of each specification.

    The full sample takes raw differences and log ratios by mean (t test; centred bootstrap with percentile and BCa intervals) and 20 %
    trimmed mean (centred bootstrap, both intervals); each sample without one row takes the centred bootstraps with percentile intervals.  Samples of
    a size share their indices, which are those of ``resample_index(n, draws, ENGINE_SEED + n)``.  Values that are not positive have no log
    ratio, which ``problem`` says.

    Scale: for samples that are declared and small, as it makes one group for each row and the full sample, in one job.
    """
    full, without = {}, {}
    for scale, transform in (("raw", "none"), ("log_ratio", "log")):
        for name, estimator in (("mean", "mean"), ("trim20", "trimmed_difference")):
            make = lambda test, interval: Recipe(
                "paired", x, y, estimator, test, interval, transform=transform, null_draws=draws, bootstrap_draws=draws, seed=ENGINE_SEED, seed_by_size=True
            )
            if name == "mean":
                full[f"{scale}/{name}/t"] = make("t", "student_t")
            full[f"{scale}/{name}/centred/percentile"] = without[f"{scale}/{name}/centred/percentile"] = make("centred_bootstrap", "percentile")
            full[f"{scale}/{name}/centred/bca"] = make("centred_bootstrap", "bca")
    kind = df.schema[identity].dataType
    sample = df.select(identity, x, y)
    n = sample.where(F.col(identity).isNotNull()).count()
    whole = run_recipes(sample, full, identity).select(F.lit(None).cast(kind).alias("omitted"), "spec_id", *_NAMES)
    left = run_recipes(leave_one_out(sample, identity, n).where("omitted is not null"), without, identity, ["omitted"])
    return whole.unionByName(left)


def bootstrap_by_index(df: DataFrame, x: str, y: str, identity: str, index: DataFrame) -> DataFrame:
    """n, estimate, exceedances, p_raw of the mean difference under its centred bootstrap, by joins over a table of shared indices.

    The second formulation of the engine's test: no arrays, only an equi-join of draws and rows and two aggregations.
    """
    from lodestat.operators.ranked import cumulative

    d = df.select(identity, (F.col(x).cast("double") - F.col(y).cast("double")).alias("__d"), F.lit(1).alias("__one"))
    rows = cumulative(d, [], [identity], "__one").select(F.col("before").cast("bigint").alias("idx"), "__d")
    theta = d.agg(F.count("*").alias("n"), F.avg("__d").alias("estimate"))
    means = index.join(rows, "idx").groupBy("draw").agg(F.avg("__d").alias("__m"))
    # means that differ by rounding alone count as equal, as the two formulations add in other orders
    off = F.abs(F.col("__m") - F.col("estimate")) >= F.abs("estimate") * (1 - 1e-12)
    counted = means.crossJoin(theta).groupBy("n", "estimate").agg(F.count_if(off).alias("exceedances"), F.count("*").alias("__b"))  # theta is one row
    return counted.select("n", "estimate", "exceedances", ((F.col("exceedances") + 1) / (F.col("__b") + 1)).alias("p_raw"))


def leave_one_out(df: DataFrame, key: str, omit: int) -> DataFrame:
    """The full sample (omitted null) and those without one of the ``omit`` smallest ids, one after the other.

    For declared samples only: the result has omit + 1 times as many rows.  Means of large tables take
    leave_one_out_means, which never repeats a row.
    """
    ids = [r[0] for r in df.select(key).distinct().orderBy(key).limit(omit).collect()]
    kind = df.schema[key].dataType
    omitted = F.explode(F.array(F.lit(None).cast(kind), *[F.lit(i).cast(kind) for i in ids])).alias("omitted")
    return df.select("*", omitted).where(F.col("omitted").isNull() | (F.col(key) != F.col("omitted")))


def leave_one_out_means(df: DataFrame, key: str, value: str, by: list[str]) -> DataFrame:
    """by, key, baseline, without, change: each row's group mean with and without that row."""
    sums = df.groupBy(*by).agg(F.sum(value).alias("__s"), F.count(value).alias("__n"))
    joined = df.where(F.col(value).isNotNull()).join(sums, by)
    without = (F.col("__s") - F.col(value)) / F.nullif(F.col("__n") - 1, F.lit(0))
    base = F.col("__s") / F.col("__n")
    return joined.select(*by, key, base.alias("baseline"), without.alias("without"), (without - base).alias("change"))


def resample_index(spark, n: int, draws: int, seed: int) -> DataFrame:
    """The shared resampling indices: draw, pos, idx of ``draws`` samples of size n with replacement, from one stream.

    The stream is walked once on the driver, which keeps the generator's state at the head of each block of about BLOCK_CELLS indices; a
    task draws its block alone from there.
    """
    size = max(1, BLOCK_CELLS // max(n, 1))
    rng, blocks = np.random.default_rng(seed), []
    for at in range(0, draws, size):
        some = min(size, draws - at)
        blocks.append((at, some, json.dumps(rng.bit_generator.state)))
        if at + some < draws:
            rng.integers(0, n, (some, n))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for first, some, state in zip(batch["first"], batch["size"], batch["state"]):
                own = np.random.default_rng()
                own.bit_generator.state = json.loads(state)
                index = own.integers(0, n, (int(some), n))
                yield pd.DataFrame({"draw": np.repeat(np.arange(first, first + some), n), "pos": np.tile(np.arange(n), some), "idx": index.ravel()})

    return spark.createDataFrame(blocks, "first bigint, size bigint, state string").mapInPandas(rows, "draw bigint, pos bigint, idx bigint")
