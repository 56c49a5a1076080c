"""Scalar rules of linking, confidence and triage as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
FUSION = {"cross_encoder": 0.4, "value_rules": 0.4, "lexical": 0.2}
STOCK_ROLES = ("opening", "closing", "closing_equiv", "total")
FALLBACK_MAP = (6.0, -3.0)
PASS_DOUBT, FAIL_FACTOR, OPEN_FACTOR = 0.85, 0.6, 0.9


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def relation_type(role: Column, anchored: Column) -> Column:
    typed = F.when(role.isin("opening", "closing", "closing_equiv"), "balance_reconciliation").when(role == "total", "total_reconciliation").otherwise("flow_match")
    return F.when(anchored, typed).otherwise("semantic")


def agreement(a: Column, b: Column, c: Column, d: Column | None = None) -> Column:
    """Which approaches accept; a lone fourth voter shows as d_only."""
    out = F.when(a & b, "consensus").when(a, "a_only").when(b, "b_only").when(c, "baseline_only")
    return (out.when(d, "d_only") if d is not None else out).otherwise("none")


def period_scope(anchors: Column) -> Column:
    """``anchors``: array of structs whose field ``sp`` is the summary period, in order."""
    periods = F.array_distinct(F.transform(anchors, lambda x: x["sp"]))
    return F.when(F.size(periods) > 1, "both").when(F.size(periods) == 1, F.get(periods, F.lit(0))).otherwise("unscoped")


def accept_cross_encoder(score: Column, rank: Column, threshold: float = 0.5, rank1_least: float = 0.2) -> Column:
    return (score >= threshold) | ((rank == 1) & (score >= rank1_least))


def accept_value_rules(anchored: Column, role: Column, is_flow: Column) -> Column:
    return anchored & F.when(is_flow, role == "flow").otherwise(role.isin(*STOCK_ROLES))


def value_rules_score(anchored: Column, accepted: Column) -> Column:
    return F.when(accepted, 1.0).when(anchored, 0.5).otherwise(0.0)


def accept_lexical(score: Column, threshold: float = 0.75) -> Column:
    return score >= threshold


def fused_score(ce: Column, rules: Column, lex: Column) -> Column:
    return FUSION["cross_encoder"] * ce + FUSION["value_rules"] * rules + FUSION["lexical"] * lex


def relation_confidence(fused: Column, recon: Column, a: Column | float, b: Column | float) -> Column:
    """Calibrated probability after the verdict of the reconciliation check."""
    p = sigmoid(a * fused + b)
    return clamp(F.when(recon == "pass", 1 - PASS_DOUBT * (1 - p)).when(recon == "fail", FAIL_FACTOR * p).otherwise(OPEN_FACTOR * p))


def confidence_components(ce: Column, rules: Column, lex: Column, recon: Column, a: Column | float, b: Column | float, p0: Column | None = None, p1: Column | None = None) -> Column:
    """What a confidence is made of: the scores, the verdict, the factor it changed the probability by, and the interval's ends."""
    fused = fused_score(ce, rules, lex)
    p, after = sigmoid(a * fused + b), relation_confidence(fused, recon, a, b)
    verdict = F.when(recon == "pass", 1.0).when(recon == "fail", 0.0).otherwise(0.5)
    none = F.lit(None).cast("double")
    return F.struct(
        F.round(ce, 4).alias("cross_encoder"),
        F.round(rules, 4).alias("value_rules"),
        F.round(lex, 4).alias("lexical"),
        F.round(fused, 4).alias("fused"),
        verdict.alias("reconciliation"),
        F.when(p > 1e-9, F.round(after / p, 4)).otherwise(0.0).alias("validation_factor"),
        (none if p0 is None else F.round(p0, 4)).alias("venn_abers_p0"),
        (none if p1 is None else F.round(p1, 4)).alias("venn_abers_p1"),
    )


def low_confidence(p: Column, fitted: Column, d_only: Column, ce_available: Column, flag: float = 0.5) -> Column:
    return (p < flag) | ~fitted | d_only | ~ce_available


def cell_confidence(ocr: Column, parse: Column) -> Column:
    return clamp(ocr * parse)


def rescue_confidence(score: Column, vote: Column) -> Column:
    conf = F.least(F.lit(0.95), F.greatest(F.lit(0.5), score))
    return F.when(vote == "suffix", conf * 0.97).when(vote == "mismatch", F.least(conf, F.lit(0.4))).otherwise(conf)


def engine_update(conf: Column, agrees: Column) -> Column:
    return F.when(agrees, F.least(F.lit(1.0), conf * 1.05)).otherwise(F.least(conf, F.lit(0.4)))


def conf_color(conf: Column) -> Column:
    return F.when(conf >= 0.8, "high").when(conf >= 0.5, "middle").otherwise("low")


def p_star(c_review: float, c_miss: float) -> float:
    """The probability below which reviewing costs less than a miss is likely to."""
    if c_miss <= 0 or c_review < 0:
        raise ValueError("c_miss must be positive and c_review not negative")
    return max(0.0, min(1.0, 1.0 - c_review / c_miss))


def beta_share(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function: the chance of ``a`` hits or more among a + b - 1 of chance ``x``.

    By Lentz's continued fraction: some square root of a + b steps and no term out of a double's range.
    """
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_share(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    least = 1e-300
    away = lambda v: v if abs(v) > least else least
    c, d = 1.0, 1 / away(1 - (a + b) * x / (a + 1))
    total, m, change = d, 0, 0.0
    while abs(change - 1) > 1e-15:
        m += 1
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / away(1 + term * d), away(1 + term / c)
            change = c * d
            total *= change
    return front * total


def clopper_pearson(k: int, n: int, alpha: float = 0.05) -> tuple[float, float]:
    """Exact binomial interval, by bisection on the binomial tail."""

    def solve(f) -> float:
        lo, hi = 0.0, 1.0
        for _ in range(80):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if f(mid) else (lo, mid)
        return (lo + hi) / 2

    if n == 0:
        return 0.0, 1.0
    low = 0.0 if k == 0 else solve(lambda p: beta_share(k, n - k + 1, p) < alpha / 2)
    high = 1.0 if k == n else solve(lambda p: beta_share(n - k, k + 1, 1 - p) > alpha / 2)
    return low, high


def mcnemar_exact(b: int, c: int) -> float:
    """Two-sided exact test of the discordant pairs."""
    n = b + c
    if n == 0:
        return 1.0
    return min(1.0, 2 * sum(math.comb(n, i) for i in range(min(b, c) + 1)) / 2**n)
