"""Scatter and singlet gates: fitted per sample on compacted cells, applied as column expressions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import is_finite
from .beside import beside
from .compact import cells
from .ranking import quantiles

#: Fixed values.
CHI2_95 = 5.991
CONSISTENT = 1.4826
LEAST_RATIO, LEAST_COVERAGE, LEAST_OFF_AXIS = 4.0, 0.05, 1e-6


def weighted_median(x: np.ndarray, n: np.ndarray) -> float:
    order = np.argsort(x, kind="stable")
    c = np.cumsum(n[order])
    half = c[-1] / 2
    k = int(np.searchsorted(c, half))
    if c[k] == half and k + 1 < len(x):
        return float((x[order[k]] + x[order[k + 1]]) / 2)
    return float(x[order[k]])


def _log_gaussian(p: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
    det = cov[0, 0] * cov[1, 1] - cov[0, 1] ** 2
    d = p - mean
    q = (cov[1, 1] * d[:, 0] ** 2 - 2 * cov[0, 1] * d[:, 0] * d[:, 1] + cov[0, 0] * d[:, 1] ** 2) / det
    return -math.log(2 * math.pi) - 0.5 * math.log(det) - 0.5 * q


def _regular(cov: np.ndarray, share: float) -> np.ndarray:
    return cov + np.eye(2) * max(share * np.trace(cov) / 2, 1e-12)


def mixture(p: np.ndarray, n: np.ndarray, *, rounds: int = 100, tolerance: float = 1e-6, regular: float = 1e-6, least: float = 1e-4) -> tuple[list[tuple[float, np.ndarray, np.ndarray]], bool]:
    """Two Gaussians of full covariance by expectation-maximisation over weighted points, from quantiles of a summed robust
    score: (weight, mean, covariance) of each, and whether it converged."""
    total = n.sum()
    scale = []
    for k in (0, 1):
        m = weighted_median(p[:, k], n)
        s = CONSISTENT * weighted_median(np.abs(p[:, k] - m), n)
        scale.append((m, s if s > 0 else math.sqrt(np.average((p[:, k] - np.average(p[:, k], weights=n)) ** 2, weights=n)) or 1.0))
    rank = np.lexsort((p[:, 1], p[:, 0], sum((p[:, k] - scale[k][0]) / scale[k][1] for k in (0, 1))))
    c = np.cumsum(n[rank])
    starts = [p[rank[min(int(np.searchsorted(c, q * total, "right")), len(rank) - 1)]] for q in (0.25, 0.75)]
    whole = _regular(np.cov(p.T, fweights=n, bias=True) if total > 1 else np.eye(2), regular)
    parts = [(0.5, m.copy(), whole.copy()) for m in starts]
    before, converged = -np.inf, False
    for step in range(rounds):
        logs = np.stack([math.log(max(w, 1e-300)) + _log_gaussian(p, m, s) for w, m, s in parts])
        norm = np.logaddexp(logs[0], logs[1])
        value = float((norm * n).sum())
        if step and abs(value - before) <= tolerance * (1 + abs(before)):
            converged = True
            break
        before, new = value, []
        for k in (0, 1):
            r = np.exp(logs[k] - norm) * n
            if r.sum() < least * total:
                new.append((least, starts[k].copy(), whole.copy()))
                continue
            mean = (r[:, None] * p).sum(axis=0) / r.sum()
            d = p - mean
            new.append((r.sum() / total, mean, _regular((d * r[:, None]).T @ d / r.sum(), regular)))
        w = sum(x[0] for x in new)
        parts = [(a / w, m, s) for a, m, s in new]
    return parts, converged


SCATTER = "{by}, n long, status string, weight double, mean_x double, mean_y double, xx double, xy double, yy double, converged boolean, review array<string>"


def fit_scatter(points: DataFrame, by: str, x: str, y: str, *, grid: int = 256, least_events: int = 10, reliable: int = 100, least_component: int = 25, most_condition: float = 1e4, least_coverage: float = 0.01) -> DataFrame:
    """A row per sample: the main cloud's ellipse. status: fitted, skipped (under least_events), or review, with reasons; a
    gate under review is not applied."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for key, found in zip(pdf[by], pdf["cells"], strict=True):
            a = np.array([(c["x"], c["y"], c["n"]) for c in found])
            p, n = a[:, :2], a[:, 2].astype(int)
            total = int(n.sum())
            if total < least_events:
                rows.append((key, total, "skipped", *[None] * 6, None, []))
                continue
            mid = [weighted_median(p[:, k], n) for k in (0, 1)]
            sd = [CONSISTENT * weighted_median(np.abs(p[:, k] - mid[k]), n) or p[:, k].std() or 1.0 for k in (0, 1)]
            parts, converged = mixture((p - mid) / sd, n)
            cond = [float(np.linalg.cond(s)) for _, _, s in parts]
            fair = [k for k in (0, 1) if parts[k][0] >= 0.1 and cond[k] <= most_condition] or [0, 1]
            best = max(fair, key=lambda k: parts[k][0] + 1e-6 * parts[k][1][0])
            w, m, s = parts[best]
            d = (p - mid) / sd - m
            inside = (np.einsum("ij,jk,ik->i", d, np.linalg.inv(s), d) <= CHI2_95) @ n / total
            review = [r for r, bad in (("few_events", total < reliable), ("small_component", w * total < least_component), ("near_singular", cond[best] > most_condition), ("low_coverage", inside < least_coverage), ("not_converged", not converged)) if bad]
            rows.append((key, total, "review" if review else "fitted", w, m[0] * sd[0] + mid[0], m[1] * sd[1] + mid[1], s[0, 0] * sd[0] ** 2, s[0, 1] * sd[0] * sd[1], s[1, 1] * sd[1] ** 2, converged, review))
        return pd.DataFrame(rows, columns=[by, "n", "status", "weight", "mean_x", "mean_y", "xx", "xy", "yy", "converged", "review"])

    kind = dict(points.dtypes)[by]
    return cells(points, by, x, y, grid).mapInPandas(lambda it: (fit(b) for b in it), SCATTER.format(by=f"{by} {kind}"))


def apply_scatter(points: DataFrame, fits: DataFrame, by: str, x: str, y: str, coverage: float | None = None) -> DataFrame:
    """points with scatter_ok: inside the ellipse; null where the sample's gate is skipped or under review. coverage: another
    share of the cloud than 95 %."""
    limit = CHI2_95 if coverage is None else -2 * math.log(1 - coverage)
    dx, dy = F.col(x) - F.col("mean_x"), F.col(y) - F.col("mean_y")
    d2 = (F.col("yy") * dx * dx - 2 * F.col("xy") * dx * dy + F.col("xx") * dy * dy) / (F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy"))
    gate = fits.select(by, "status", "mean_x", "mean_y", "xx", "xy", "yy")
    inside = F.when(F.col("status") == "fitted", F.coalesce(d2 <= limit, F.lit(False)))
    return beside(points, gate, by, [x, y], "left").withColumn("scatter_ok", inside).drop("status", "mean_x", "mean_y", "xx", "xy", "yy")


def ridge(p: np.ndarray, n: np.ndarray, *, rounds: int = 50, tolerance: float = 1e-7, huber: float = 1.345) -> tuple[np.ndarray, np.ndarray, float, float, np.ndarray, bool]:
    """The principal line of weighted points under Huber weights: (centre, direction, median, MAD of signed distances,
    eigenvalues of the covariance, smaller first, and whether it converged)."""
    centre = np.array([weighted_median(p[:, k], n) for k in (0, 1)])
    w = n.astype(float)

    def spread(c: np.ndarray) -> np.ndarray:
        d = p - c
        return (d * w[:, None]).T @ d / w.sum() + np.eye(2) * 1e-9

    def axis(c: np.ndarray) -> np.ndarray:
        s = spread(c)
        angle = 0.5 * math.atan2(2 * s[0, 1], s[0, 0] - s[1, 1])
        return np.array([math.cos(angle), math.sin(angle)])

    direction, converged = axis(centre), False
    for _ in range(rounds):
        dist = (p - centre) @ np.array([-direction[1], direction[0]])
        mid = weighted_median(dist, n)
        scale = CONSISTENT * weighted_median(np.abs(dist - mid), n)
        if not scale > np.finfo(float).eps:
            break
        z = np.abs(dist - mid) / scale
        w = n * np.where(z <= huber, 1.0, huber / np.maximum(z, 1e-300))
        new = (p * w[:, None]).sum(axis=0) / w.sum()
        turned = axis(new)
        turned = turned if turned @ direction >= 0 else -turned
        moved = max(np.hypot(*(new - centre)), np.hypot(*(turned - direction)))
        centre, direction = new, turned
        if moved <= tolerance:
            converged = True
            break
    dist = (p - centre) @ np.array([-direction[1], direction[0]])
    mid = weighted_median(dist, n)
    return centre, direction, mid, weighted_median(np.abs(dist - mid), n), np.linalg.eigvalsh(spread(centre)), converged


RIDGE = "{by}, n long, status string, cx double, cy double, dx double, dy double, mid double, mad double, sx double, sy double, mx double, my double, review array<string>"


def fit_singlets(points: DataFrame, by: str, area: str, other: str, *, grid: int = 256, least: int = 20, reliable: int = 50, k: float = 5.0) -> DataFrame:
    """A row per sample: the ridge of area against height or width, in robust units (mx, sx, my, sy). status: fitted, skipped
    (under `least` events), or review, with reasons; a gate under review is not applied. k: the MADs that apply_singlets() takes."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for key, found in zip(pdf[by], pdf["cells"], strict=True):
            a = np.array([(c["x"], c["y"], c["n"]) for c in found])
            p, n = a[:, :2], a[:, 2].astype(int)
            if n.sum() < least:
                rows.append((key, int(n.sum()), "skipped", *[None] * 10, []))
                continue
            mid = [weighted_median(p[:, j], n) for j in (0, 1)]
            sd = [CONSISTENT * weighted_median(np.abs(p[:, j] - mid[j]), n) or p[:, j].std() or 1.0 for j in (0, 1)]
            z = (p - mid) / sd
            c, d, m, mad, (minor, major), converged = ridge(z, n)
            inside = (np.abs((z - c) @ np.array([-d[1], d[0]]) - m) <= k * mad) @ n / n.sum()
            reasons = (("few_events", n.sum() < reliable), ("not_converged", not converged), ("poorly_identified", not major >= LEAST_RATIO * minor), ("near_collinear", not minor > LEAST_OFF_AXIS), ("zero_mad", mad <= 0), ("low_coverage", inside < LEAST_COVERAGE))
            review = [r for r, bad in reasons if bad]
            rows.append((key, int(n.sum()), "review" if review else "fitted", *c, *d, m, mad, sd[0], sd[1], mid[0], mid[1], review))
        return pd.DataFrame(rows, columns=[by, "n", "status", "cx", "cy", "dx", "dy", "mid", "mad", "sx", "sy", "mx", "my", "review"])

    kind = dict(points.dtypes)[by]
    return cells(points, by, area, other, grid).mapInPandas(lambda it: (fit(b) for b in it), RIDGE.format(by=f"{by} {kind}"))


def _pulse_evidence(points: DataFrame, by: str, area: str, other: str, preference: int) -> DataFrame:
    pairs = points.where(is_finite(F.col(area)) & is_finite(F.col(other))).select(by, F.col(area).cast("double").alias("_x"), F.col(other).cast("double").alias("_y"))
    middle = quantiles(pairs, by, ["_x", "_y"], [0.5]).groupBy(by).agg(*[F.max(F.when(F.col("column") == c, F.col("q"))).alias(m) for c, m in (("_x", "_mx"), ("_y", "_my"))])
    dx, dy = F.col("_x") - F.col("_mx"), F.col("_y") - F.col("_my")
    sums = beside(pairs, middle, by, ["_x", "_y"]).groupBy(by).agg(F.count(F.lit(1)).alias("_f"), F.count_if((F.col("_x") > 0) & (F.col("_y") > 0)).alias("_pos"), F.sum(dx * dy).alias("_xy"), F.sum(dx * dx).alias("_xx"), F.sum(dy * dy).alias("_yy"))
    each = points.groupBy(by).agg(F.count(F.lit(1)).alias("_all")).join(sums, by, "left")
    spread = (F.col("_f") >= 3) & (F.col("_xx") > 0) & (F.col("_yy") > 0)
    correlation = F.when(spread, F.col("_xy") / F.sqrt(F.col("_xx") * F.col("_yy"))).otherwise(0.0)
    finite, positive = F.coalesce(F.col("_f") / F.col("_all"), F.lit(0.0)), F.coalesce(F.col("_pos") / F.col("_f"), F.lit(0.0))
    score = finite + 0.25 * F.abs(correlation) + 0.05 * positive + 1e-6 * preference
    return each.select(by, F.lit(other).alias("channel"), finite.alias("finite"), positive.alias("positive"), correlation.alias("correlation"), score.alias("score"))


def pulse_channel_choice(points: DataFrame, by: str, area: str, height: str | None, width: str | None) -> DataFrame:
    """(by, channel, finite, positive, correlation, score): per sample the channel, height or width, to hold against area: the one
    with more finite pairs, a stronger correlation about the medians and more positive pairs; height if equal. A channel that
    is None is no candidate; a sample without finite pairs scores zero."""
    found = [_pulse_evidence(points, by, area, c, preference) for c, preference in ((height, 1), (width, 0)) if c is not None]
    if not found:
        raise ValueError("pulse_channel_choice: neither a height nor a width channel")
    every = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    best = F.max_by(F.struct("channel", "finite", "positive", "correlation", "score"), "score").alias("_best")
    return every.groupBy(by).agg(best).select(by, "_best.*")


def ridge_distance(area: Column, other: Column) -> Column:
    """The signed distance from a ridge of fit_singlets() in the same row."""
    x, y = (area - F.col("mx")) / F.col("sx") - F.col("cx"), (other - F.col("my")) / F.col("sy") - F.col("cy")
    return y * F.col("dx") - x * F.col("dy")


def apply_singlets(points: DataFrame, fits: DataFrame, by: str, area: str, other: str, k: float = 5.0) -> DataFrame:
    """points with singlet_ok: within k MADs of the ridge; null where the sample's gate, as singlet_status says, is skipped or
    under review."""
    gate = fits.drop("n", "review")
    near = F.abs(ridge_distance(F.col(area), F.col(other)) - F.col("mid")) <= k * F.col("mad")
    inside = F.when(F.col("status") == "fitted", F.coalesce(near, F.lit(False)))
    return beside(points, gate, by, [area, other], "left").withColumns({"singlet_ok": inside, "singlet_status": F.col("status")}).drop(*[c for c in gate.columns if c != by])
