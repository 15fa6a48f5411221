"""The closed plan language: one frozen recipe says how a quantity is computed, and what is illegal raises."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import asdict, dataclass, field, fields, replace

# Which tests and intervals an estimator admits.
LEGAL = {
    ("paired", "mean"): ({"t", "sign_flip", "centred_bootstrap"}, {"student_t", "bca", "percentile"}),
    ("paired", "yuen"): ({"yuen"}, {"yuen", "student_t", "percentile"}),
    ("paired", "trimmed_difference"): ({"yuen", "centred_bootstrap"}, {"yuen", "student_t", "percentile", "bca"}),
    ("paired", "rank_biserial"): ({"wilcoxon"}, {"percentile"}),
    ("association", "partial"): ({"t", "freedman_lane", "residual_permutation"}, {"fisher_z", "percentile"}),
    ("association", "semipartial"): ({"t", "freedman_lane", "residual_permutation"}, {"percentile"}),
}
OUTLIERS = ("none", "iqr_difference", "mahalanobis", "studentized_residual_trim")
ADJUSTMENTS = ("none", "bonferroni", "holm", "fixed_threshold")
#: Draws that a recipe may ask for.
DRAWS = (1_000, 200_000)


@dataclass(frozen=True)
class Recipe:
    """One analysis: design, sample rules, estimator, test, interval and multiplicity."""

    design: str
    x: str
    y: str
    estimator: str
    test: str
    interval: str = "none"
    covariates: tuple[str, ...] = ()
    rank: bool = False
    rank_covariates: bool = False
    polynomial: str | None = None
    degree: int = 1
    spline_probs: tuple[float, ...] = ()
    transform: str = "none"
    outliers: str = "none"
    outlier_k: float = 1.5
    trim: float = 0.2
    alternative: str = "two-sided"
    permutation_statistic: str = "effect"
    permute: str = "outcome"
    adjustment: str = "none"
    alpha: float = 0.05
    family: tuple[str, ...] = ()
    null_draws: int = 20_000
    bootstrap_draws: int = 10_000
    seed: int = 20260915
    seed_by_size: bool = False
    approximate_rank_fisher: bool = False

    def __post_init__(self) -> None:
        problems = self.problems()
        if problems:
            raise ValueError("; ".join(problems))

    def problems(self) -> list[str]:
        """Everything that makes the recipe illegal."""
        out = []
        legal = LEGAL.get((self.design, self.estimator))
        if legal is None:
            return [f"no {self.estimator} for a {self.design} design"]
        if self.test not in legal[0]:
            out.append(f"no {self.test} test of {self.estimator}")
        if self.interval != "none" and self.interval not in legal[1]:
            out.append(f"no {self.interval} interval of {self.estimator}")
        paired = self.design == "paired"
        if paired and (self.rank or self.covariates or self.polynomial):
            out.append("a paired design has no ranks, covariates or polynomial")
        if not paired and self.transform != "none":
            out.append("an association has no transform")
        if self.outliers not in OUTLIERS:
            out.append(f"no outlier rule {self.outliers}")
        if self.outliers == "iqr_difference" and not paired:
            out.append("fences on differences need pairs")
        if self.outliers == "studentized_residual_trim" and paired:
            out.append("residual trimming needs an association")
        permuted = self.test in ("freedman_lane", "residual_permutation", "sign_flip")
        if self.test in ("freedman_lane", "residual_permutation") and self.alternative != "two-sided":
            out.append("permutation tests are two-sided")
        if self.permutation_statistic == "t" and self.test != "freedman_lane":
            out.append("the t statistic belongs to freedman_lane")
        if self.estimator == "semipartial" and self.test == "residual_permutation" and self.permute != "predictor":
            out.append("a semipartial residual permutation moves the predictor")
        if self.rank and self.interval == "fisher_z" and not self.approximate_rank_fisher:
            out.append("fisher_z of ranks is approximate and must say so")
        if self.spline_probs and (len(self.spline_probs) != 3 or list(self.spline_probs) != sorted(set(self.spline_probs)) or not 0 < self.spline_probs[0] or not self.spline_probs[-1] < 1 or self.degree != 1):
            out.append("a spline needs three rising probabilities in (0, 1) and degree 1")
        if self.adjustment not in ADJUSTMENTS:
            out.append(f"no adjustment {self.adjustment}")
        if self.adjustment == "fixed_threshold" and (not 0 < self.alpha <= 0.05 or self.family):
            out.append("a fixed threshold needs alpha in (0, .05] and no family")
        if self.adjustment == "holm" and not self.family:
            out.append("holm needs a family")
        if self.adjustment == "none" and self.family:
            out.append("a family needs an adjustment")
        if not 0 <= self.trim < 0.5:
            out.append("trim must be in [0, .5)")
        for draws in (self.null_draws,) * permuted + (self.bootstrap_draws,) * (self.interval in ("bca", "percentile")):
            if not DRAWS[0] <= draws <= DRAWS[1]:
                out.append(f"draws must be within {DRAWS}")
        return out


@dataclass(frozen=True)
class RecipeBook:
    """A base, patches by (factor, level), and patches that hold for several levels at once."""

    base: Mapping[str, object]
    levels: Mapping[tuple[str, str], Mapping[str, object]] = field(default_factory=dict)
    conditional: tuple[tuple[Mapping[str, str], Mapping[str, object]], ...] = ()

    def compile(self, spec: Mapping[str, str]) -> Recipe:
        """The recipe of one specification; two patches that set a field differently are an error."""
        values = dict(self.base)
        own: dict[str, object] = {}
        for item in spec.items():
            own = merge_strict(own, self.levels.get(item, {}))
        extra: dict[str, object] = {}
        for when, patch in self.conditional:
            if all(spec.get(k) == v for k, v in when.items()):
                extra = merge_strict(extra, patch)
        return from_mapping(values | own | extra)


def merge_strict(a: Mapping[str, object], b: Mapping[str, object]) -> dict[str, object]:
    """Both mappings; a key with two different values is an error."""
    clash = [k for k in a.keys() & b.keys() if a[k] != b[k]]
    if clash:
        raise ValueError(f"conflicting settings of {sorted(clash)}")
    return {**a, **b}


def from_mapping(values: Mapping[str, object]) -> Recipe:
    """A recipe from a mapping; unknown fields are an error."""
    known = {f.name for f in fields(Recipe)}
    unknown = set(values) - known
    if unknown:
        raise ValueError(f"unknown fields {sorted(unknown)}")
    return Recipe(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items()})


def to_json(recipe: Recipe) -> str:
    return json.dumps(asdict(recipe), sort_keys=True)


def from_json(text: str) -> Recipe:
    return from_mapping(json.loads(text))


def perturbed(recipe: Recipe, **changes: object) -> Recipe:
    """The recipe with some fields changed, checked again."""
    return replace(recipe, **changes)


# Names of analyses in direct plans, by their canonical name.
FAMILIES = {
    "independent_t": ("independent t", "two-sample t", "student t", "t-test"), "welch_t": ("welch", "welch t"), "paired_t": ("paired t", "dependent t"),
    "one_sample_t": ("one-sample t", "single-sample t"), "correlation": ("pearson", "pearson correlation"), "partial_correlation": ("partial correlation",),
    "linear_regression": ("ols", "regression"), "likelihood_ratio": ("lrt", "likelihood ratio test"),
}


@dataclass(frozen=True)
class DirectPlan:
    """A classical test named directly: family and columns."""

    family: str
    columns: tuple[str, ...]
    group: str | None = None
    levels: tuple[object, object] | None = None
    mu: float = 0.0
    covariates: tuple[str, ...] = ()
    df_per_row: int = 1

    def __post_init__(self) -> None:
        if self.family not in FAMILIES:
            raise ValueError(f"unsupported family {self.family}")
        need = {"paired_t": 2, "correlation": 2, "partial_correlation": 2, "likelihood_ratio": 2, "one_sample_t": 1, "independent_t": 1, "welch_t": 1}
        if self.family in need and len(self.columns) != need[self.family]:
            raise ValueError(f"{self.family} needs {need[self.family]} columns")
        if self.family in ("independent_t", "welch_t") and (self.group is None or self.levels is None):
            raise ValueError("two groups must be named")


def canonical_family(name: str) -> str:
    """The canonical family of a free name; anything unknown is an error."""
    low = name.strip().lower()
    for family, names in FAMILIES.items():
        if low == family or low in names:
            return family
    raise ValueError(f"unsupported family {name}")


def run_direct(df, plan: DirectPlan, by: list[str] | None = None):
    """The DataFrame of a direct plan."""
    from lodestat.operators import tstats as t

    c = plan.columns
    if plan.family == "paired_t":
        return t.paired_t(df, c[0], c[1], by)
    if plan.family == "one_sample_t":
        return t.one_sample_t(df, c[0], plan.mu, by)
    if plan.family in ("independent_t", "welch_t"):
        return t.independent_t(df, c[0], plan.group, *plan.levels, by=by, welch=plan.family == "welch_t")
    if plan.family == "correlation":
        return t.correlation(df, c[0], c[1], by)
    if plan.family == "partial_correlation":
        return t.partial_correlation(df, c[0], c[1], list(plan.covariates), by)
    if plan.family == "likelihood_ratio":
        return t.likelihood_ratio(df, c[0], c[1], plan.df_per_row, by)
    return t.ols(df, c[0], list(c[1:]), by)


def describe(recipe: Recipe) -> str:
    """A recipe in words."""
    parts = [f"{recipe.estimator.replace('_', ' ')} of {recipe.x} and {recipe.y} ({recipe.design})"]
    if recipe.covariates:
        parts.append(f"given {', '.join(recipe.covariates)}")
    if recipe.polynomial:
        parts.append(f"with {'a spline' if recipe.spline_probs else f'a term of degree {recipe.degree}'} of {recipe.polynomial}")
    if recipe.rank:
        parts.append("on ranks")
    if recipe.transform != "none":
        parts.append(f"after a {recipe.transform} transform")
    if recipe.outliers != "none":
        parts.append(f"without outliers by {recipe.outliers.replace('_', ' ')}")
    parts.append(f"tested by {recipe.test.replace('_', ' ')}")
    if recipe.interval != "none":
        parts.append(f"with a {recipe.interval.replace('_', ' ')} interval")
    if recipe.adjustment != "none":
        parts.append(f"adjusted by {recipe.adjustment.replace('_', ' ')}")
    return "; ".join(parts)
