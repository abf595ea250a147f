"""A run of ordered filters over a cohort, in which a filter may fail for one sample and not for another.

A filter is a mask and what it needs of a sample's events that the filters before it kept. Where a need is not met the filter fails
for that sample with the need's code: its mask is null there, that is, not applied. After a failure the sample's other filters are
not run, or with go_on run on what was kept so far. One pass over the events a filter; what is known of a sample so far, a row each,
is joined to its events.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from decimal import Decimal
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .samples import combined

APPLIED, FAILED, NOT_RUN = "applied", "failed", "not_run"


class Filter(NamedTuple):
    """needs: code -> function of the condition "still kept" that returns an aggregate over a sample's events."""

    name: str
    mask: Column
    needs: dict[str, Callable[[Column], Column]] = {}


def mean_at_least(x: Column, least: str, places: int = 6) -> Column:
    """Whether the mean of x, rounded to so many places, is `least` (a decimal number) or more; null without values. Sums are of
    decimals: those of doubles depend on the order of rows, and a mean that equals the limit would fall to either side of it. Values that no such decimal holds leave the mean of doubles."""
    exact = x.try_cast(f"decimal(18,{places})")
    return F.when(F.count(exact) == F.count(x), F.sum(exact) >= F.count(x) * F.lit(Decimal(least))).otherwise(F.avg(x) >= float(least))


def _mask(k: int, f: Filter) -> Column:
    """A filter's mask where it was applied, else null; an event for which the mask is null is kept."""
    return F.when(F.col(f"_status{k}") == APPLIED, F.coalesce(f.mask, F.lit(True)))


def run(events: DataFrame, by: str, filters: Sequence[Filter], *, go_on: bool = False) -> tuple[DataFrame, DataFrame]:
    """(events with a column per filter, its mask, and kept; a row (by, step, name, status, code, entered, kept) per sample and
    filter). Events of a null sample are a sample of their own. Names of filters must be new to the events."""
    clash = {f.name.lower() for f in filters} & {c.lower() for c in events.columns}
    if clash or len({f.name.lower() for f in filters}) < len(filters):
        raise ValueError(f"names of filters must be new and different: {sorted(clash)}")
    state, known = None, []
    for k, f in enumerate(filters):
        rows = events if state is None else _with(events, state, by)
        so_far = combined(*[_mask(j, g) for j, g in enumerate(filters[:k])])
        unmet = F.coalesce(*[F.when(~F.coalesce(need(so_far), F.lit(False)), F.lit(code)) for code, need in f.needs.items()], F.lit(None).cast("string"))
        state = rows.groupBy(by, *known).agg(F.count_if(so_far).alias(f"_in{k}"), F.count_if(so_far & F.coalesce(f.mask, F.lit(True))).alias(f"_out{k}"), unmet.alias(f"_code{k}"))
        stopped = F.lit(False)
        for j in range(0 if go_on else k):
            stopped = stopped | (F.col(f"_status{j}") == FAILED)
        status = F.when(stopped, NOT_RUN).when(F.col(f"_code{k}").isNotNull(), FAILED).otherwise(APPLIED)
        state = state.withColumn(f"_status{k}", status).withColumns({f"_code{k}": F.when(F.col(f"_status{k}") == FAILED, F.col(f"_code{k}")), f"_out{k}": F.when(F.col(f"_status{k}") == APPLIED, F.col(f"_out{k}")).otherwise(F.col(f"_in{k}"))})
        known += [f"_{c}{k}" for c in ("in", "out", "code", "status")]
    if state is None:
        return events.withColumn("kept", F.lit(True)), events.select(by).limit(0).selectExpr("*", "0 step", "'' name", "'' status", "'' code", "0L entered", "0L kept")
    out = _with(events, state, by).withColumns({f.name: _mask(k, f) for k, f in enumerate(filters)})
    masked = out.select(*events.columns, *[f.name for f in filters], combined(*[F.col(f.name) for f in filters]).alias("kept"))
    steps = [F.struct(F.lit(k + 1).alias("step"), F.lit(f.name).alias("name"), F.col(f"_status{k}").alias("status"), F.col(f"_code{k}").alias("code"), F.col(f"_in{k}").alias("entered"), F.col(f"_out{k}").alias("kept")) for k, f in enumerate(filters)]
    return masked, state.select(by, F.inline(F.array(*steps)))


def _with(events: DataFrame, state: DataFrame, by: str) -> DataFrame:
    own = state.withColumnRenamed(by, "_by")
    return events.join(own, events[by].eqNullSafe(own["_by"])).drop("_by")


def completion(steps: DataFrame, by: str) -> DataFrame:
    """(by, status, failed, lost, percent): complete or incomplete, the filters that were not applied, and what all of them lost."""
    bad = F.col("status") != APPLIED
    one = steps.groupBy(by).agg(F.array_sort(F.collect_list(F.when(bad, F.struct("step", "name")))).alias("_bad"), F.min_by("entered", "step").alias("_in"), F.max_by("kept", "step").alias("_out"))
    lost = F.col("_in") - F.col("_out")
    return one.select(by, F.when(F.size("_bad") > 0, "incomplete").otherwise("complete").alias("status"), F.transform("_bad", lambda x: x["name"]).alias("failed"), lost.alias("lost"), F.when(F.col("_in") > 0, 100.0 * lost / F.col("_in")).alias("percent"))


def ceilings(files: DataFrame, by: str, own: dict[str, str], settings: dict[str, dict]) -> DataFrame:
    """files(by, ...) with ceiling_<channel> for each channel of own, which names the column of the file's own limit. settings:
    channel -> {"enabled": bool, "override": number}, both optional: a ceiling that is not enabled is null, an override replaces
    the file's. Channels and keys that are not known are an error."""
    unknown = sorted(set(settings) - set(own)) + sorted(f"{c}.{k}" for c, s in settings.items() for k in set(s) - {"enabled", "override"})
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    limit = {c: F.lit(None) if not settings.get(c, {}).get("enabled", True) else F.lit(o) if (o := settings.get(c, {}).get("override")) is not None else F.col(column) for c, column in own.items()}
    return files.select(by, *[x.cast("double").alias(f"ceiling_{c}") for c, x in limit.items()])
