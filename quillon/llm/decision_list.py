"""Learned decision lists: ordered threshold conjunctions by sequential covering with growing and pruning."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] >= self.threshold if self.above else x[self.feature] < self.threshold

    def column(self, prefix: str = "") -> Column:
        c = F.col(prefix + self.feature)
        return c >= F.lit(self.threshold) if self.above else c < F.lit(self.threshold)


Rule = tuple[Condition, ...]


def _covers(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    hit = np.ones(n, bool)
    for c in rule:
        hit &= c.holds(x)
    return hit


def _gain(p0: int, n0: int, p1: int, n1: int) -> float:
    """FOIL's gain of a condition that keeps p1 of p0 positives and n1 of n0 negatives."""
    if not p1:
        return 0.0
    return p1 * (math.log2(p1 / (p1 + n1)) - math.log2(p0 / (p0 + n0)))


def _grow(x: dict, y: np.ndarray, live: np.ndarray, cuts: dict, most: int) -> Rule:
    rule: Rule = ()
    inside = live.copy()
    while len(rule) < most:
        pos, neg = int((inside & y).sum()), int((inside & ~y).sum())
        if not pos or not neg:
            break
        best, found = 1e-9, None
        for name, values in cuts.items():
            v = x[name][inside]
            t = y[inside]
            at = np.searchsorted(values, v, side="right")  # v reaches the first `at` thresholds
            up = np.bincount(at[t], minlength=len(values) + 1)[::-1].cumsum()[::-1][1:]
            un = np.bincount(at[~t], minlength=len(values) + 1)[::-1].cumsum()[::-1][1:]
            for k, threshold in enumerate(values):
                for above, p, n in ((True, int(up[k]), int(un[k])), (False, pos - int(up[k]), neg - int(un[k]))):
                    g = _gain(pos, neg, p, n)
                    if g > best:
                        best, found = g, Condition(name, above, float(threshold))
        if found is None:
            break
        found = _centre(found, x[found.feature][inside], y[inside])
        rule += (found,)
        inside &= found.holds(x)
    return rule


def _centre(c: Condition, v: np.ndarray, t: np.ndarray) -> Condition:
    """The condition with its threshold halfway between the last negative that it leaves out and the next positive."""
    if c.above:
        edge = v[~t & (v < c.threshold)].max(initial=-np.inf)
        near = v[t & (v > edge)].min(initial=np.inf)
        middle = near if np.isinf(edge) else (edge + near) / 2
    else:
        edge = v[~t & (v >= c.threshold)].min(initial=np.inf)
        near = v[t & (v < edge)].max(initial=-np.inf)
        middle = np.nextafter(near, np.inf) if np.isinf(edge) else (edge + near) / 2
    return Condition(c.feature, c.above, float(middle)) if np.isfinite(middle) else c


def _prune(rule: Rule, x: dict, y: np.ndarray, live: np.ndarray) -> Rule:
    """Drops final conditions while (p - n) / (p + n) on the pruning rows does not fall."""

    def worth(r: Rule) -> float:
        hit = _covers(r, x, len(y)) & live
        p, n = int((hit & y).sum()), int((hit & ~y).sum())
        return (p - n) / (p + n) if p + n else -1.0

    while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
        rule = rule[:-1]
    return rule


def learn(
    x: dict[str, np.ndarray],
    y: np.ndarray,
    *,
    precision: float = 0.9,
    least: int = 3,
    conditions: int = 4,
    rules: int = 24,
    cuts: int = 48,
) -> list[Rule]:
    """Ordered rules for the rows with y true, all others being the default.

    Two thirds of the rows grow each rule and one third prunes it. A rule is kept if its precision over all rows it
    is the first to cover reaches `precision` and it covers `least` positives; the list ends with the first rule that does
    not, as later ones would be grown from the same rows. No rows or one class: no rules.
    """
    n = len(y)
    if not n or y.all() or not y.any():
        return []
    grow = np.arange(n) % 3 != 2
    at = {k: np.unique(np.quantile(v, np.linspace(0, 1, cuts + 2)[1:-1])) for k, v in x.items()}
    # thresholds between the classes matter most where positives are rare
    at = {k: np.unique(np.concatenate([at[k], np.quantile(v[y], np.linspace(0, 1, cuts + 2)[1:-1])])) for k, v in x.items()}
    live = np.ones(n, bool)
    out: list[Rule] = []
    while len(out) < rules and (live & y & grow).sum() >= least:
        rule = _grow(x, y, live & grow, at, conditions)
        if not rule:
            break
        rule = _prune(rule, x, y, live & ~grow)
        hit = _covers(rule, x, n) & live
        p, q = int((hit & y).sum()), int((hit & ~y).sum())
        if p < least or p < precision * (p + q):
            break
        out.append(rule)
        live &= ~hit
    return out


def expression(rules: list[Rule], matched: Column, default: Column, prefix: str = "") -> Column:
    """The list as one ordered Spark conditional over columns prefix + feature: the first rule that holds decides."""
    out = None
    for rule in rules:
        test = rule[0].column(prefix)
        for c in rule[1:]:
            test = test & c.column(prefix)
        out = F.when(test, matched) if out is None else out.when(test, matched)
    return default if out is None else out.otherwise(default)
