"""Delimited sample tables in and out, content digests, and session documents."""

from __future__ import annotations

import hashlib
import json
import tomllib
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import tsv_cell

#: Headers under which a table may name its files, without signs and case.
FILENAME_HEADERS = ("filename", "file", "fcsfile", "fcsfilename", "fcs", "name", "samplefile", "sample", "filepath")
SECTIONS = ("session", "files", "metadata", "metadata_template", "table", "plot", "ui", "stats_plan", "structural_qc", "time_qc", "modeling")


def delimiter_of(first_line: str) -> str:
    return "\t" if first_line.count("\t") > first_line.count(",") else ","


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A delimited table: the delimiter by its first line that isn't blank, quoted fields, missing cells empty, all strings."""
    first = spark.read.text(path).where(F.length(F.trim("value")) > 0).limit(1).collect()
    sep = delimiter_of(first[0][0].lstrip("﻿") if first else ",")
    df = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("sep", sep).csv(path)
    names = [c.lstrip("﻿").strip() for c in df.columns]
    plain = ["".join(x for x in n.lower() if x.isalnum()) for n in names]
    if len(set(plain)) < len(plain):
        raise ValueError("METADATA_DUPLICATE_HEADER")
    return df.toDF(*names).na.fill("")


def filename_column(df: DataFrame) -> str | None:
    return next((c for c in df.columns if "".join(x for x in c.lower() if x.isalnum()) in FILENAME_HEADERS), None)


def write_table(df: DataFrame, path: str) -> None:
    """Tab-separated, safe for spreadsheets, in the order of df."""
    cells = [tsv_cell(F.col(f"`{n}`")) if t == "string" else F.coalesce(F.when(F.isnan(F.col(f"`{n}`")), F.lit("")).otherwise(F.col(f"`{n}`").cast("string")) if t in ("double", "float") else F.col(f"`{n}`").cast("string"), F.lit("")) for n, t in df.dtypes]
    header = "\t".join(df.columns)
    df.select(F.concat_ws("\t", *cells).alias(header)).write.mode("overwrite").option("header", True).option("quote", "").option("sep", "\x01").csv(path)


def digests(files: DataFrame, chunk: int = 1 << 20) -> DataFrame:
    """binaryFile rows with digest: SHA-256 of the SHA-256 of each chunk."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            tree = [hashlib.sha256(b"".join(hashlib.sha256(c[k : k + chunk]).digest() for k in range(0, len(c), chunk))).hexdigest() for c in b["content"]]
            yield pd.DataFrame({"path": b["path"], "digest": tree})

    return files.select("path", "content").mapInPandas(run, "path string, digest string")


def read_session(text: str, most_bytes: int = 16 << 20) -> dict:
    """A session document; unknown sections and versions are errors."""
    if len(text.encode()) > most_bytes:
        raise ValueError("session is too large")
    found = tomllib.loads(text)
    if unknown := set(found) - set(SECTIONS):
        raise ValueError(f"unknown sections: {sorted(unknown)}")
    if found.get("session", {}).get("version", 1) not in (0, 1):
        raise ValueError("unknown session version")
    return found


def write_session(session: Mapping) -> str:
    """The document of a session: sections of scalars, lists and tables."""

    def value(v) -> str:
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, (int, float)):
            return repr(v)
        if isinstance(v, Mapping):
            return "{" + ", ".join(f"{json.dumps(str(k))} = {value(x)}" for k, x in v.items()) + "}"
        if isinstance(v, (list, tuple)):
            return "[" + ", ".join(value(x) for x in v) + "]"
        return json.dumps(str(v), ensure_ascii=False).replace("\x7f", "\\u007f")

    return "\n".join(f"[{s}]\n" + "".join(f"{json.dumps(str(k))} = {value(v)}\n" for k, v in rows.items() if v is not None) for s, rows in session.items())
