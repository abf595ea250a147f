"""Peak-tracking time QC: density peaks of overlapping bins, followed along a sample, tell which stretch of it went wrong.

Bins and their events are relational (timeqc.overlapping_bins); a bin's density is estimated where the bin's values are, so
grouped Python sees at most `size` values of a bin; tracks and the isolation tree see peak positions only, one number a bin.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRID = 256
CONSISTENT = 1.4826


def density_peaks(x: np.ndarray, least_height: float = 1 / 3, least: int = 20) -> list[float]:
    """The places of the major peaks of a Gaussian kernel density on a grid, by Silverman's width; the highest, if none stands
    out. Fewer than `least` values or no spread: none."""
    x = x[np.isfinite(x)]
    if len(x) < least:
        return []
    q1, q3 = np.quantile(x, [0.25, 0.75])
    spreads = [v for v in (x.std(), (q3 - q1) / 1.349) if v > 0]
    if not spreads:
        return []
    h = 0.9 * min(spreads) * len(x) ** -0.2
    low, high = x.min() - 3 * h, x.max() + 3 * h
    step = (high - low) / (GRID - 1)
    at = (x - low) / step
    k = np.minimum(at.astype(int), GRID - 2)
    mass = np.bincount(k, 1 - (at - k), GRID) + np.bincount(k + 1, at - k, GRID)
    reach = min(GRID - 1, max(1, math.ceil(4 * h / step)))
    y = np.convolve(mass, np.exp(-0.5 * (np.arange(-reach, reach + 1) * step / h) ** 2))[reach : reach + GRID]
    tops = [i for i in range(1, GRID - 1) if y[i - 1] < y[i] >= y[i + 1] and y[i] >= least_height * y.max()]
    merged: list[int] = []
    for i in tops:
        if merged and i - merged[-1] <= 2:
            merged[-1] = i if y[i] > y[merged[-1]] else merged[-1]
        else:
            merged.append(i)
    return [low + step * i for i in merged or [int(y.argmax())]]


def tracks(found: list[list[float]], prevalence: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """(peaks by bin and track, whether it was found): as many tracks as bins mostly have peaks (the smaller number on ties),
    around the medians of those bins; each takes the nearest peak, and its median where there is none."""
    counts = np.array([len(f) for f in found])
    seen = counts[counts > 0]
    if not len(seen):
        return np.zeros((len(found), 0)), np.zeros((len(found), 0), bool)
    values, n = np.unique(seen, return_counts=True)
    m = int(values[n.argmax()])
    centre = np.median([sorted(f) for f in found if len(f) == m], axis=0)
    out, have = np.full((len(found), m), np.nan), np.zeros((len(found), m), bool)
    for b, f in enumerate(found):
        free = set(range(m))
        for p in sorted(f, key=lambda p: np.abs(centre - p).min()):
            if free:
                k = min(free, key=lambda k: (abs(centre[k] - p), k))
                out[b, k], have[b, k] = p, True
                free.discard(k)
    keep = have.mean(axis=0) >= prevalence
    out, have = out[:, keep], have[:, keep]
    return np.where(have, out, np.nanmedian(out, axis=0) if len(out) and out.shape[1] else out), have


def largest_leaf(x: np.ndarray, gain: float = 0.6, least: int = 5) -> np.ndarray:
    """Which rows stay in the largest leaf of a tree that splits by the column and value of the greatest relative loss of
    deviation, as long as that is over `gain`."""
    best = np.zeros(len(x), bool)
    todo = [np.arange(len(x))]
    while todo:
        rows = todo.pop()
        top, cut = gain, None
        for k in range(x.shape[1]):
            v = np.sort(x[rows, k])
            sd = v.std()
            if not sd > 0:
                continue
            n = np.arange(1, len(v))
            one, two = np.cumsum(v)[:-1], np.cumsum(v * v)[:-1]
            left = np.sqrt(np.maximum(two / n - (one / n) ** 2, 0))
            r, rn = v.sum() - one, len(v) - n
            right = np.sqrt(np.maximum(((v * v).sum() - two) / rn - (r / rn) ** 2, 0))
            g = np.where((v[1:] > v[:-1]) & (n >= least) & (rn >= least), (sd - (left + right) / 2) / sd, -1)
            if len(g) and g.max() > top:
                top, cut = float(g.max()), (k, (v[g.argmax()] + v[g.argmax() + 1]) / 2)
        if cut is None:
            if len(rows) > best.sum():
                best = np.zeros(len(x), bool)
                best[rows] = True
            continue
        side = x[rows, cut[0]] <= cut[1]
        todo += [rows[side], rows[~side]]
    return best


def moving_mean(x: np.ndarray, reach: int = 2) -> np.ndarray:
    return np.array([np.nanmean(x[max(0, i - reach) : i + reach + 1]) for i in range(len(x))])


def runs_at_least(flag: np.ndarray, n: int) -> np.ndarray:
    out, i = np.zeros(len(flag), bool), 0
    while i < len(flag):
        j = i
        while j < len(flag) and flag[j] == flag[i]:
            j += 1
        if flag[i] and j - i >= n:
            out[i:j] = True
        i = j
    return out


def judged(found: list[list[float]], rate: np.ndarray, *, tree_bins: int = 150, mads: float = 6.0, rate_z: float = 4.0, missing: int = 3, good_run: int = 5) -> list[list[str]]:
    """Why each bin of a segment is rejected, in its order; empty: it is kept."""
    n = len(found)
    why: list[list[str]] = [[] for _ in range(n)]

    def add(rows: np.ndarray, reason: str) -> None:
        for i in np.flatnonzero(rows):
            why[i].append(reason)

    x, have = tracks(found)
    for k in range(x.shape[1]):
        add(runs_at_least(~have[:, k], missing), "missing_peak")
    if x.shape[1] and n >= tree_bins:
        add(~largest_leaf(x), "isolated")
    for k in range(x.shape[1]):
        s = moving_mean(x[:, k])
        c = np.median(s)
        add(np.abs(s - c) > mads * max(np.median(np.abs(s - c)), abs(c) * 1e-3), "peak_shift")
    finite = rate[np.isfinite(rate)]
    if len(finite) >= 3:
        c = np.median(finite)
        scale = max(CONSISTENT * np.median(np.abs(finite - c)), 0.01 * abs(c))
        add(np.where(np.isfinite(rate), np.abs(rate - c) > rate_z * scale if scale > 0 else False, False), "rate")
    bad = np.array([bool(w) for w in why])
    good = ~bad
    i = 0
    while i < n:
        j = i
        while j < n and good[j] == good[i]:
            j += 1
        if good[i] and j - i < good_run and i > 0 and j < n:
            for b in range(i, j):
                why[b].append("short_run")
        i = j
    return [sorted(set(w)) for w in why]


def flagged_bins(binned: DataFrame, by: str, index: str, time: str, channel: str) -> DataFrame:
    """timeqc.overlapping_bins() -> (by, segment, bin, n, reasons)."""
    rate = (F.count(F.lit(1)) - 1) / F.nullif(F.max_by(time, index) - F.min_by(time, index), F.lit(0.0))
    bins = binned.groupBy(by, "segment", "bin").agg(F.count(F.lit(1)).alias("n"), rate.alias("rate"), F.collect_list(F.col(channel).cast("double")).alias("x"))
    kind = dict(binned.dtypes)[by]

    def locate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.drop(columns="x").assign(peaks=[density_peaks(np.asarray(x, float)) for x in b["x"]])

    places = bins.mapInPandas(locate, f"{by} {kind}, segment long, bin long, n long, rate double, peaks array<double>")

    def judge(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("bin")
        return b[[by, "segment", "bin", "n"]].assign(reasons=judged([list(p) for p in b["peaks"]], b["rate"].to_numpy(float)))

    return places.groupBy(by, "segment").applyInPandas(judge, f"{by} {kind}, segment long, bin long, n long, reasons array<string>")


def retained(binned: DataFrame, flags: DataFrame, by: str, index: str) -> DataFrame:
    """(by, index, time_ok): an event is bad if any of its bins is."""
    bad = flags.select(by, "segment", "bin", (F.size("reasons") > 0).alias("_bad"))
    return binned.join(bad, [by, "segment", "bin"]).groupBy(by, index).agg((~F.bool_or("_bad")).alias("time_ok"))
