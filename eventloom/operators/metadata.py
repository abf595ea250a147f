"""The sample table: links to files, filters, sorts, unions, splits and labels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import leading_number, natural_key, split_name


def linked(records: DataFrame, files: DataFrame, key: str, record_order: str, file_order: str) -> DataFrame:
    """records with file (the linked file's `file_order`) and link: matched, duplicate (an earlier record has the file),
    unmatched, or empty (no key). The first file of a key counts, and each is linked once."""
    first = files.where(F.col(key).isNotNull() & (F.col(key) != "")).groupBy(key).agg(F.min(file_order).alias("file"))
    own = records.groupBy(key).agg(F.min(record_order).alias("_own"))  # the record that may have the file
    joined = records.join(own.join(first, key), key, "left")
    empty = F.col(key).isNull() | (F.col(key) == "")
    link = F.when(empty, "empty").when(F.col("file").isNull(), "unmatched").when(F.col(record_order) != F.col("_own"), "duplicate").otherwise("matched")
    return joined.withColumn("link", link).withColumn("file", F.when(F.col("link") == "matched", F.col("file"))).drop("_own")


def late_linked(table: DataFrame, arrived: DataFrame, key: str, order: str, file: str = "file") -> DataFrame:
    """table in which the first unlinked row of each key takes the file that arrived under it (key, new_file)."""
    open_ = F.col(file).isNull()
    first = table.where(open_).groupBy(key).agg(F.min(order).alias("_first"))
    come = arrived.groupBy(key).agg(F.min("new_file").alias("new_file"))
    joined = table.join(first.join(come, key), key, "left")
    return joined.withColumn(file, F.when(open_ & (F.col(order) == F.col("_first")), F.col("new_file")).otherwise(F.col(file))).drop("_first", "new_file")


def overlaid(table: DataFrame, saved: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """table with saved values over current ones; a missing value is empty."""
    mine = saved.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    out = table.join(mine, key, "left")
    return out.withColumns({c: F.coalesce(f"_{c}", c, F.lit("")) for c in columns}).drop(*[f"_{c}" for c in columns])


def filtered(table: DataFrame, allowed: Mapping[str, Sequence[str]]) -> DataFrame:
    """Rows whose trimmed values are allowed in every column; no values for a column: no filter."""
    for column, values in allowed.items():
        if values:
            table = table.where(F.trim(F.coalesce(F.col(column).cast("string"), F.lit(""))).isin(list(values)))
    return table


def sort_keys(column: str, tie: str, *, descending: bool = False, numeric: bool = False) -> list:
    """Orders by natural order, or by the leading number of the text, then by `tie`."""
    key = leading_number(F.col(column)) if numeric else natural_key(F.coalesce(F.col(column), F.lit("")))
    return [key.desc() if descending else key.asc(), F.col(tie).asc()]


def union_outer(one: DataFrame, two: DataFrame) -> DataFrame:
    return one.unionByName(two, allowMissingColumns=True)


def distinct_values(table: DataFrame, column: str) -> DataFrame:
    """Trimmed distinct values that aren't blank."""
    return table.select(F.trim(F.col(column)).alias(column)).where(F.col(column) != "").distinct()


def with_split(table: DataFrame, name: str, steps: Sequence[tuple], into: Sequence[str], *, keep: bool = False) -> DataFrame:
    """table with the parts of `name` in the columns `into`; keep: values that aren't empty stay."""
    parts = split_name(F.col(name), steps)
    return table.withColumns({c: F.coalesce(F.nullif(F.col(c), F.lit("")), p) if keep and c in table.columns else p for c, p in zip(into, parts, strict=False)})


def unique_label(label: str, taken: Sequence[str]) -> str:
    """label, or with the first number from 2 on that makes it unlike all taken ones, whatever their case."""
    have, text, k = {t.lower() for t in taken}, label.strip() or "Column", 2
    out = text
    while out.lower() in have:
        out, k = f"{text} {k}", k + 1
    return out


def field_name(label: str, taken: Sequence[str], reserved: Sequence[str] = ("id", "name")) -> str:
    """A camel-case field for a label, unlike the taken and reserved ones."""
    words = "".join(c if c.isalnum() else " " for c in label).split()
    base = (words[0].lower() + "".join(w[:1].upper() + w[1:].lower() for w in words[1:])) if words else "column"
    out, k, have = base, 2, {*taken, *reserved}
    while out in have:
        out, k = f"{base}{k}", k + 1
    return out


def reconnected(records: DataFrame, files: DataFrame) -> DataFrame:
    """records(name, size, modified) with file: the one of equal name, size and time, else the only one of equal name and size."""
    exact = files.groupBy("name", "size", "modified").agg(F.min("file").alias("_exact"))
    only = files.groupBy("name", "size").agg(F.count(F.lit(1)).alias("_n"), F.min("file").alias("_only"))
    out = records.join(exact, ["name", "size", "modified"], "left").join(only, ["name", "size"], "left")
    return out.withColumn("file", F.coalesce("_exact", F.when(F.col("_n") == 1, F.col("_only")))).drop("_exact", "_only", "_n")
