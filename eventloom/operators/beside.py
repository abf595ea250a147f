"""A row per sample joined to the events of the sample."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: tasks that the events of one group are dealt over.
SALTS = 32


def beside(rows: DataFrame, own: DataFrame, by: str | Sequence[str], over: Sequence[str], how: str = "inner", null_safe: bool = False) -> DataFrame:
    """rows joined to own, which has a row per group of the keys `by`, far fewer. A join by the keys alone takes all rows of a group
    to one task, and sorts them there. Here each row of own comes SALTS times and a row meets one of these, by a hash of its columns
    `over` (of many values); own is the side that is held in a hash table, so no row is sorted. null_safe: a null key meets a null key."""
    keys = [by] if isinstance(by, str) else list(by)
    copies = own.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*over), F.lit(SALTS)).cast("int"))
    if not null_safe:
        return salted.join(copies.hint("shuffle_hash"), [*keys, "_salt"], how).drop("_salt")
    copies = copies.withColumnsRenamed({k: f"_own{i}" for i, k in enumerate(keys)} | {"_salt": "_copy"})
    on = F.col("_salt") == F.col("_copy")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_own{i}"))
    return salted.join(copies.hint("shuffle_hash"), on, how).drop("_salt", "_copy", *[f"_own{i}" for i in range(len(keys))])
