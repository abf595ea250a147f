"""From the parameters of a file to the channels that quality control reads: companions, scatter and time, all as joins on the
parameter table(file, index, name). A file has few parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import measurement_base, measurement_kind, normalized_measurement


def companions(params: DataFrame, file: str = "file", index: str = "index", name: str = "name", kinds: tuple[str, ...] = ("h", "w")) -> DataFrame:
    """(file, index, one column per kind): for each area parameter the first other one of that kind with the same, not empty, base."""
    own = params.select(F.col(file).alias("file"), F.col(index).alias("index"), measurement_kind(F.col(name)).alias("kind"), F.nullif(measurement_base(F.col(name)), F.lit("")).alias("base"))
    area = own.where("kind = 'a'").select("file", "index", "base")
    for kind in kinds:
        first = own.where(F.col("kind") == kind).groupBy("file", "base").agg(F.min("index").alias(kind))
        area = area.join(first, ["file", "base"], "left")
    return area.select("file", "index", *kinds)


def overridden(found: Column, override: Column) -> Column:
    """A companion by configuration: null leaves the one found, an empty label disables it, a label names another."""
    return F.when(override.isNull(), found).when(override != "", override)


def scatter_of(name: Column, short: str, long: str) -> Column:
    """Whether a name is the area of a scatter detector, by the beginning of its base."""
    base = measurement_base(name)
    begins = (base == short) | base.startswith(short + "-") | (base == long) | base.startswith(long + "-")
    return (measurement_kind(name) == "a") & begins


def time_score(name: Column) -> Column:
    """4 to 1 as a name is surely or vaguely the acquisition time, else 0."""
    n = normalized_measurement(name)
    return F.when(n.isin("time", "hdr-t", "hdr-time"), 4).when(n.isin("acquisition-time", "event-time"), 3).when(n.rlike(r"(^|-)time($|-)"), 2).when(n.rlike(r"(^|-)hdr-t($|-)"), 1).otherwise(0)


def canonical(params: DataFrame, file: str = "file", index: str = "index", name: str = "name") -> DataFrame:
    """(file, fsc_a, ssc_a, time): the first parameter of each scatter, and that of the best time score; null if there is none."""
    n, i = F.col(name), F.col(index)
    score = time_score(n)
    return params.groupBy(F.col(file).alias("file")).agg(
        F.min(F.when(scatter_of(n, "fsc", "forward-scatter"), i)).alias("fsc_a"),
        F.min(F.when(scatter_of(n, "ssc", "side-scatter"), i)).alias("ssc_a"),
        F.min_by(F.when(score > 0, i), F.struct(-score, i)).alias("time"),
    )


def suggested(params: DataFrame, patterns: tuple[str, ...], file: str = "file", index: str = "index", name: str = "name") -> DataFrame:
    """(file, name): the first name that has one of the patterns, both in upper case with other signs as underscores."""
    plain = F.regexp_replace(F.upper(F.col(name)), "[^A-Z0-9]+", "_")
    fits = F.lit(False)
    for p in patterns:
        fits = fits | plain.contains(p.upper())
    return params.where(fits).groupBy(F.col(file).alias("file")).agg(F.min_by(F.col(name), F.col(index)).alias("name"))


def label_union(params: DataFrame, order: str, index: str = "index", name: str = "name") -> DataFrame:
    """(name, place): distinct names in the order in which files, then parameters, first have them."""
    first = params.groupBy(F.col(name).alias("name")).agg(F.min(F.struct(order, index)).alias("at"))
    return first.select("name", F.row_number().over(Window.orderBy("at")).alias("place"))  # a row per distinct label


def unique_files(files: DataFrame, key: str, order: str) -> DataFrame:
    """files with duplicate: whether a file of the same key came before."""
    return files.withColumn("duplicate", F.row_number().over(Window.partitionBy(key).orderBy(order)) > 1)
