"""Text and number columns of the reference's tables: names, stamps, escapes, hashes, array helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def guessed_annotations(name: Column) -> Column:
    """struct(strain, replicate, arrest, timepoint) read from a file name, empty where it says nothing."""
    base = F.regexp_replace(name, r"\.[^.]+$", "")
    core, pair = r"(?:^|[_\s-])(\d+)([A-Za-z])([A-Za-z])\s+[tT](\d+)(?:[_\s.-]|$)", r"(?:^|[_\s-])([^_\s-]+)\s+[tT](\d+)(?:[_\s-]|$)"
    own = base.rlike(core)
    replicate = F.when(base.rlike(r"__([A-Za-z]+\d+)(?:\.|_|\s|-|$)"), F.regexp_extract(base, r"__([A-Za-z]+\d+)(?:\.|_|\s|-|$)", 1)).otherwise(F.regexp_extract(base, r"(?:^|[_\s-])([A-Za-z]+\d+)(?:\.|_|\s|-|$)", 1))
    either = lambda k, other: F.when(own, F.regexp_extract(base, core, k)).otherwise(other)
    return F.struct(either(1, F.regexp_extract(base, pair, 1)).alias("strain"), either(2, replicate).alias("replicate"), either(3, F.lit("")).alias("arrest"), either(4, F.regexp_extract(base, pair, 2)).alias("timepoint"))


def filename_timestamp(at: Column) -> Column:
    return F.date_format(at, "yyyyMMdd-HHmmss")


def html_escaped(text: Column) -> Column:
    for plain, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def percent_text(fraction: Column) -> Column:
    """A share as percent to one place; a dash for what is missing or not finite."""
    return F.when(fraction.isNull() | F.isnan(fraction) | (F.abs(fraction) == float("inf")), "-").otherwise(F.format_string("%.1f", fraction * 100.0))


def fnv1a(values: Column) -> Column:
    """The 32-bit FNV-1a hash of an array of bytes as integers."""
    step = lambda h, c: F.pmod(h.bitwiseXOR(c.cast("long")) * F.lit(16_777_619), F.lit(1 << 32))
    return F.aggregate(values, F.lit(2_166_136_261).cast("long"), step)


def bin_centres(edges: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(edges) - 1), lambda k: (F.element_at(edges, k) + F.element_at(edges, k + 1)) / 2)


def arg_min(values: Column) -> Column:
    """The place, from 0, of the least value, the first of equals."""
    return F.array_position(values, F.array_min(values)) - 1


def linspace(low: Column, high: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: low + (high - low) * k / (n - 1))
