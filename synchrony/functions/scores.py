"""Scalar score functions: columns in, column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parameters of the published scoring.
TAU, DWELL_THRESHOLD, DWELL_TAU, FLOOR = 2.5, 15.0, 30.0, 0.5
WEIGHTS = {1: 0.3, 2: 0.6, 3: 1.0, 4: 1.5, 5: 2.0}
HEURISTIC_WEIGHTS = {1: 0.8, 2: 0.9, 3: 1.0, 4: 1.1, 5: 1.2}
ZONES = ("Optimal", "Suboptimal", "Disruptive", "Unacceptable")


def bell(x: Column, sigma: float) -> Column:
    """Gaussian weight of an offset."""
    return F.exp(-0.5 * F.pow(x / sigma, 2))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def dwell(delta: Column, threshold: float, tau: float) -> Column:
    """Score of a visual that is still on screen: full up to the threshold, then decaying."""
    return F.when(F.abs(delta) <= threshold, 100.0).otherwise(100 * bell(F.abs(delta) - threshold, tau))


def ramp(d: Column) -> Column:
    """Piecewise linear score of an absolute gap."""
    return F.when(d <= 1, 100.0).when(d <= 3, 100 - 15 * (d - 1)).when(d <= 5, 70 - 35 * (d - 3)).otherwise(0.0)


def shown(delta: Column, on_screen: Column) -> Column:
    return (delta <= 0) & F.coalesce(on_screen, F.lit(False))


def gaussian_score(delta: Column, on_screen: Column, tau: float = TAU, threshold: float = DWELL_THRESHOLD, dwell_tau: float = DWELL_TAU) -> Column:
    return F.when(delta.isNotNull(), F.when(shown(delta, on_screen), dwell(delta, threshold, dwell_tau)).otherwise(100 * bell(delta, tau)))


def piecewise_score(delta: Column, on_screen: Column, threshold: float = DWELL_THRESHOLD, dwell_tau: float = DWELL_TAU) -> Column:
    return F.when(delta.isNotNull(), F.when(shown(delta, on_screen), dwell(delta, threshold, dwell_tau)).otherwise(ramp(F.abs(delta))))


def symmetric_score(delta: Column) -> Column:
    """The first generation's score: the same for either sign."""
    return F.when(delta.isNotNull(), ramp(F.abs(delta)))


def zone_of_score(score: Column) -> Column:
    return F.when(score >= 80, ZONES[0]).when(score >= 60, ZONES[1]).when(score >= 40, ZONES[2]).otherwise(ZONES[3])


def zone_of_gap(d: Column) -> Column:
    return F.when(d <= 1, ZONES[0]).when(d <= 3, ZONES[1]).when(d <= 5, ZONES[2]).otherwise(ZONES[3])


def zone(delta: Column, on_screen: Column, threshold: float = DWELL_THRESHOLD, dwell_tau: float = DWELL_TAU) -> Column:
    return F.when(delta.isNull(), "No Match").when(shown(delta, on_screen), zone_of_score(dwell(delta, threshold, dwell_tau))).otherwise(zone_of_gap(F.abs(delta)))


def report_zone(delta: Column) -> Column:
    """Zone without persistence: anything shown before it is said is optimal."""
    return F.when(delta.isNull(), "No Match").when(delta <= 0, ZONES[0]).otherwise(zone_of_gap(delta))


def symmetric_zone(delta: Column) -> Column:
    return F.when(delta.isNull(), "No Match").otherwise(zone_of_gap(F.abs(delta)))


def grade(score: Column) -> Column:
    return F.when(score.isNull(), "N/A").when(score >= 80, "Excellent").when(score >= 60, "Good").when(score >= 40, "Acceptable").when(score >= 20, "Poor").otherwise("Unacceptable")


def alpha_linear(x: Column, low: float, high: float) -> Column:
    """[low, high] to [0, 1], held at the ends."""
    return F.least(F.greatest((x - low) / (high - low), F.lit(0.0)), F.lit(1.0))


def alpha_half(x: Column, low: float, high: float) -> Column:
    """[low, high] to [0.5, 1]."""
    return 0.5 + 0.5 * alpha_linear(x, low, high)


def weight(importance: Column, backend: Column) -> Column:
    """Importance weight: the compressed table for the heuristic backend, else the full one."""

    def pick(table: dict[int, float]) -> Column:
        out = F.when(importance == 1, table[1])
        for k in (2, 3, 4, 5):
            out = out.when(importance == k, table[k])
        return out.otherwise(1.0)

    return F.when(F.coalesce(backend, F.lit("heuristic")) == "heuristic", pick(HEURISTIC_WEIGHTS)).otherwise(pick(WEIGHTS))


def floored(score: Column, alpha: Column, floor: float = FLOOR) -> Column:
    return score * (floor + (1 - floor) * alpha)


def priority(score: Column, w: Column, alpha: Column) -> Column:
    return F.coalesce((100 - score) * w * F.coalesce(alpha, F.lit(1.0)), F.lit(0.0))


def format_time(t: Column) -> Column:
    s = F.floor(t).cast("int")
    return F.when(t.isNull(), "N/A").otherwise(F.format_string("%d:%02d", F.floor(s / 60).cast("int"), s % 60))


def format_delta(d: Column) -> Column:
    return F.when(d.isNull(), "N/A").otherwise(F.format_string("%+.1fs", d))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """Vector of length 1; a zero vector stays."""
    return F.when(norm(a) > 0, F.transform(a, lambda x: x / norm(a))).otherwise(F.transform(a, lambda x: x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def mean_abs_difference(a: Column, b: Column) -> Column:
    return F.try_divide(F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x), F.size(a))
