"""Column expressions: all run inside whole-stage codegen or as built-in functions, none in Python."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < INF)


def safe_divide(a: Column, b: Column) -> Column:
    """a / b, or null where b is zero."""
    return F.when(b != 0, a / b)


def clamp(x: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def half_up(x: Column) -> Column:
    """Rounding with halves towards plus infinity, as a long."""
    return F.floor(x + 0.5)


def natural_key(name: Column) -> Column:
    """Sorts digits by value and letters without case: a1, A2, a10."""
    return F.array_join(F.transform(F.regexp_extract_all(F.lower(name), F.lit(r"([0-9]+|[^0-9]+)"), 1), lambda t: F.when(t.rlike("^[0-9]"), F.lpad(t, 20, "0")).otherwise(t)), "")


def filename_key(path: Column) -> Column:
    """The base name without .fcs, trimmed and lower-cased."""
    base = F.element_at(F.split(path, r"[\\/]"), -1)
    return F.lower(F.trim(F.regexp_replace(base, r"(?i)\.fcs$", "")))


def display_name(name: Column) -> Column:
    return F.regexp_replace(name, r"(?i)\.fcs$", "")


def normalized_measurement(name: Column) -> Column:
    """Lower case, area/height/width shortened, other signs as hyphens."""
    text = F.lower(F.trim(name))
    for word in ("area", "height", "width"):
        text = F.regexp_replace(text, rf"\b{word}\b", word[0])
    return F.regexp_replace(F.regexp_replace(text, r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def measurement_kind(name: Column) -> Column:
    """a, h or w by the last part of the normalized name, else null."""
    last = F.element_at(F.split(normalized_measurement(name), "-"), -1)
    return F.when(last.isin("a", "h", "w"), last)


def measurement_base(name: Column) -> Column:
    """The normalized name without its kind."""
    text = normalized_measurement(name)
    return F.when(measurement_kind(name).isNotNull(), F.regexp_replace(text, "-?[ahw]$", "")).otherwise(text)


def normalized_keyword(key: Column) -> Column:
    return F.upper(F.replace(F.regexp_replace(F.trim(key), r"^\$", ""), F.lit(" "), F.lit("_")))


def first_decimal(text: Column) -> Column:
    """The first signed decimal number of a text, or null."""
    return F.regexp_extract(text, r"([-+]?[0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")


def leading_number(text: Column) -> Column:
    """The number that a text starts with; +Infinity if there is none, so that it sorts last."""
    return F.coalesce(F.regexp_extract(text, r"^\s*([-+]?[0-9]+(?:\.[0-9]+)?)", 1).try_cast("double"), F.lit(INF))


def tsv_cell(value: Column) -> Column:
    """A spreadsheet-safe cell: a leading sign that starts a formula is quoted by an apostrophe; tabs, newlines and quotes are
    enclosed. Null is empty."""
    safe = F.when(value.rlike(r"^[\x00-\x20]*[=+\-@]"), F.concat(F.lit("'"), value)).otherwise(F.coalesce(value, F.lit("")))
    return F.when(safe.rlike('[\t\r\n"]'), F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(safe)


def split_binary(text: Column, step: tuple) -> tuple[Column, Column]:
    """One step of a filename split: (part, rest). step: ("delimiter", d), ("fixed", n) or ("regex", pattern with a group).
    Without a match the part is the whole text and the rest is empty."""
    kind, arg = step
    if kind == "delimiter":
        at = F.instr(text, arg)
        return F.when(at > 0, F.substring(text, F.lit(1), at - 1)).otherwise(text), F.when(at > 0, F.substring(text, at + len(arg), F.length(text))).otherwise("")
    if kind == "fixed":
        inside = F.length(text) > arg
        return F.when(inside, F.substring(text, 1, arg)).otherwise(text), F.when(inside, F.substring(text, F.lit(arg + 1), F.length(text))).otherwise("")
    if kind == "regex":
        whole = F.regexp_extract(text, arg, 0)
        group = F.regexp_extract(text, arg, 1)
        at = F.instr(text, whole)
        hit = text.rlike(arg) & (F.length(whole) > 0)
        before = F.substring(text, F.lit(1), at - 1)
        return F.when(hit, F.when(group != "", group).otherwise(before)).otherwise(text), F.when(hit, F.substring(text, at + F.length(whole), F.length(text))).otherwise("")
    raise ValueError(f"unknown split {kind}")


def split_name(text: Column, steps: Sequence[tuple]) -> list[Column]:
    """The parts of a text by binary splits in order; the remainder comes last."""
    parts, rest = [], text
    for step in steps:
        part, rest = split_binary(rest, step)
        parts.append(part)
    return [*parts, rest]


#: A polynomial approximation of the error function, Abramowitz and Stegun 7.1.26.
ERF = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429, 0.3275911)


def erf(x: Column) -> Column:
    a1, a2, a3, a4, a5, p = ERF
    t = 1 / (1 + p * F.abs(x))
    y = 1 - ((((a5 * t + a4) * t + a3) * t + a2) * t + a1) * t * F.exp(-x * x)
    return F.when(x < 0, -y).otherwise(y)


def normal_cdf(x: Column) -> Column:
    return 0.5 * (1 + erf(x / F.sqrt(F.lit(2.0))))


def gaussian_mass(left: Column, right: Column, area, mean, sd) -> Column:
    """The mass of a Gaussian of given area between two edges."""
    return F.lit(area) * (normal_cdf((right - mean) / sd) - normal_cdf((left - mean) / sd))


def poisson_deviance(y: Column, mu: Column, least: float = 1e-12) -> Column:
    m = F.greatest(mu, F.lit(least))
    return 2 * F.when(y > 0, y * F.log(y / m) - (y - m)).otherwise(m)


def pearson_residual(y: Column, mu: Column, least: float = 1e-12) -> Column:
    m = F.greatest(mu, F.lit(least))
    return (y - m) / F.sqrt(m)


def robust_z(x: Column, centre: Column, scale: Column) -> Column:
    """(x - centre) / scale; with no scale 0 at the centre and infinite elsewhere."""
    return F.when(scale > 0, (x - centre) / scale).when(x == centre, 0.0).when(x > centre, INF).when(x < centre, -INF)


def mahalanobis(x: Column, y: Column, mean: tuple, covariance: tuple) -> Column:
    """Squared distance under covariance (xx, xy, yy)."""
    xx, xy, yy = covariance
    det = xx * yy - xy * xy
    dx, dy = x - mean[0], y - mean[1]
    return (yy * dx * dx - 2 * xy * dx * dy + xx * dy * dy) / det
