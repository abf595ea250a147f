"""A session's tables: collected into one document, and restored from it together or not at all.

Restoring stages every section as a table of its own version: rows are typed, checked against the section's rules and against other
sections by joins, and written. Only when all are there a pointer file is renamed into place, which names the version that readers
take. If a section is broken, the pointer and with it every table stay as they were, the staged ones go, and the report names the
section, the rule and examples.

A document of text is read by the driver, so it is bounded. One of any size is in parts: a folder with lines of JSON per section, a
row of its table each, which tasks write and read; its rules, staging and pointer are the same.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable, Iterator, Mapping
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.statsplan import METRICS
from .scratch import stored
from .tables import read_session, write_session

POINTER = "current.json"
HEAD = "session.json"  # of a document in parts, written last
#: Rows of the tables, by section; of "metadata" also the columns.
SCHEMAS = {
    "files": "name string, size long, digest string",
    "metadata_columns": "field string, label string, source string",
    "metadata": "name string, field string, value string",
    "stats_plan": "channel string, metric string, mask string",
    "structural_qc": "channel string, enabled boolean, override double",
    "modeling": "name string, model string, g1_left double, g1_right double, g2_left double, g2_right double",
    "table": "selected string",
}
CHANNELS = ("DNA_A", "DNA_H", "DNA_W")  # fixed values: those that may have a ceiling
EXAMPLES = 5


class BrokenSection(ValueError):
    def __init__(self, section: str, rule: str, examples: list | None = None):
        super().__init__(f"{section}: {rule}" + (f" ({', '.join(map(str, examples))})" if examples else ""))
        self.section, self.rule, self.examples = section, rule, examples or []


def _rows(document: Mapping) -> dict[str, list[tuple]]:
    """The rows of every table, taken apart; a part of the wrong shape is a broken section."""

    def listed(section: str, key: str) -> list:
        found = document.get(section, {}).get(key, [])
        if not isinstance(found, list):
            raise BrokenSection(section, f"{key} is not a list")
        return found

    def entry(section: str, v, *keys: str) -> list:
        if not isinstance(v, Mapping):
            raise BrokenSection(section, "an entry is not a table", [v])
        return [v.get(k) for k in keys]

    columns = [entry("metadata", c, "field", "label", "source") for c in listed("metadata", "columns")]
    cells = []
    for row in listed("metadata", "rows"):
        name = entry("metadata", row, "name")[0]
        cells += [(name, k, None if v is None else str(v)) for k, v in row.items() if k != "name"] or [(name, None, None)]
    regions = ("g1_left", "g1_right", "g2_left", "g2_right")
    return {
        "files": [tuple(entry("files", r, "name", "size", "digest")) for r in listed("files", "records")] or [(n, None, None) for n in listed("files", "names")],
        "metadata_columns": [(f, lab, s or "") for f, lab, s in columns],
        "metadata": cells,
        "stats_plan": [(c, m, e.get("mask", "")) for e in listed("stats_plan", "entries") for c, ms in [entry("stats_plan", e, "channel", "metrics")] for m in (ms if isinstance(ms, list) else [ms])],
        "structural_qc": [(c, v.get("enabled", True), v.get("override")) if isinstance(v, Mapping) else (c, None, None) for c, v in document.get("structural_qc", {}).items()],
        "modeling": [tuple(entry("modeling", s, "name", "model", *regions)) for s in listed("modeling", "samples")],
        "table": [(n,) for n in listed("table", "selected_files")],
    }


def _typed(spark: SparkSession, section: str, rows: list[tuple]) -> DataFrame:
    schema = T._parse_datatype_string(SCHEMAS[section])
    kinds = {T.StringType: str, T.LongType: int, T.DoubleType: float, T.BooleanType: bool}
    out = []
    for r in rows:
        cells = []
        for f, v in zip(schema.fields, r, strict=True):
            want = kinds[type(f.dataType)]
            v = float(v) if want is float and isinstance(v, int) and not isinstance(v, bool) else v
            if v is not None and (not isinstance(v, want) or want is int and isinstance(v, bool)):
                raise BrokenSection(section, f"{f.name} is not a {f.dataType.simpleString()}", [v])
            cells.append(v)
        out.append(tuple(cells))
    return spark.createDataFrame(out, schema)


def _parts(spark: SparkSession, parts: str) -> list[str]:
    """The sections of a document in parts, all of them; unknown sections and versions are errors."""
    fs, path = _files(spark, parts)
    if not fs.exists(path(HEAD)):
        raise ValueError("not a session in parts")
    if json.loads(spark.read.text(str(path(HEAD)), wholetext=True).first()[0]).get("version") != 1:
        raise ValueError("unknown session version")
    found = {f.getPath().getName() for f in fs.listStatus(path(".")) if f.isDirectory()}
    if unknown := found - set(SCHEMAS):
        raise ValueError(f"unknown sections: {sorted(unknown)}")
    return list(SCHEMAS)


def _read_part(spark: SparkSession, parts: str, section: str) -> DataFrame:
    fs, path = _files(spark, parts)
    if not fs.exists(path(section)):
        return spark.createDataFrame([], SCHEMAS[section])
    rows = spark.read.schema(f"{SCHEMAS[section]}, _wrong string").option("columnNameOfCorruptRecord", "_wrong").json(str(path(section)))
    wrong = stored(rows, "session-part")  # Spark answers no question about broken lines alone from the file itself
    if found := wrong.where("_wrong IS NOT NULL").limit(EXAMPLES).collect():
        raise BrokenSection(section, "a line is not a row of its table", [r["_wrong"] for r in found])
    return wrong.drop("_wrong")


def _rules(t: dict[str, DataFrame]) -> list[tuple[str, str, DataFrame]]:
    """(section, rule, rows that break it)."""
    repeated = lambda s, *c: t[s].groupBy(*c).count().where("count > 1").drop("count")
    unknown = lambda s, c, of, key: t[s].where(F.col(c).isNotNull()).join(t[of].select(F.col(key).alias(c)), c, "left_anti").select(c)
    ends = [F.col(c) for c in ("g1_left", "g1_right", "g2_left", "g2_right")]
    given = sum(((~e.isNull()).cast("int") for e in ends), F.lit(0))
    ordered = (ends[0] < ends[1]) & (ends[1] <= ends[2]) & (ends[2] < ends[3])
    return [
        ("files", "a file has no name", t["files"].where("coalesce(name, '') = ''")),
        ("files", "a name comes twice", repeated("files", "name")),
        ("files", "a size is below zero", t["files"].where("size < 0").select("name")),
        ("metadata", "a column has no field or that of another", t["metadata_columns"].where("coalesce(field, '') in ('', 'name')").select("field").unionByName(repeated("metadata_columns", "field"))),
        ("metadata", "a cell of an unknown column", unknown("metadata", "field", "metadata_columns", "field")),
        ("metadata", "a row of an unknown file", unknown("metadata", "name", "files", "name")),
        ("metadata", "a row comes twice", repeated("metadata", "name", "field")),
        ("stats_plan", "an entry without a channel or of an unknown metric", t["stats_plan"].where((F.coalesce("channel", F.lit("")) == "") | ~F.coalesce(F.col("metric").isin(*METRICS), F.lit(False)))),
        ("structural_qc", "an unknown channel or no setting", t["structural_qc"].where(~F.col("channel").isin(*CHANNELS) | F.col("enabled").isNull())),
        ("structural_qc", "an override is not above zero", t["structural_qc"].where("override <= 0 OR isnan(override)")),
        ("modeling", "a sample of an unknown file", unknown("modeling", "name", "files", "name")),
        ("modeling", "regions are incomplete or out of order", t["modeling"].where((given > 0) & ~F.coalesce(ordered, F.lit(False))).select("name")),
        ("table", "an unknown file is selected", unknown("table", "selected", "files", "name")),
    ]


class Report(NamedTuple):
    status: str  # restored or failed
    version: str | None
    failed_section: str | None
    reason: str | None
    rows: dict[str, int]


def _files(spark: SparkSession, folder: str):
    path = lambda p: spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{p}")
    return path(".").getFileSystem(spark._jsc.hadoopConfiguration()), path


def _current(spark: SparkSession, folder: str) -> dict | None:
    fs, path = _files(spark, folder)
    if not fs.exists(path(POINTER)):
        return None
    return json.loads(spark.read.text(str(path(POINTER)), wholetext=True).first()[0])


def _promote(spark: SparkSession, folder: str, version: str) -> None:
    """Writes the pointer beside its place and renames it over the old one, in one step."""
    jvm, (fs, path) = spark._jvm, _files(spark, folder)
    fresh = path(f".{version}.json")
    out = fs.create(fresh, True)
    out.write(json.dumps({"version": version}).encode())
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(path(".").toUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(fs.makeQualified(fresh), fs.makeQualified(path(POINTER)), options)


def restore(spark: SparkSession, document: str, folder: str, before_promotion: Callable[[], None] | None = None) -> Report:
    """Restores a document's tables under folder. before_promotion runs when all sections are staged; what it raises fails the
    restore like a broken section."""

    def sections():
        for section, rows in _rows(read_session(document)).items():
            yield section, lambda section=section, rows=rows: _typed(spark, section, rows)

    return _restore(spark, sections, folder, before_promotion)


def restore_parts(spark: SparkSession, parts: str, folder: str, before_promotion: Callable[[], None] | None = None) -> Report:
    """restore() of a document in parts. Numbers in place of a text are read as their text."""

    def sections():
        for section in _parts(spark, parts):
            yield section, lambda section=section: _read_part(spark, parts, section)

    return _restore(spark, sections, folder, before_promotion)


def _restore(spark: SparkSession, sections: Callable[[], Iterator[tuple[str, Callable[[], DataFrame]]]], folder: str, before_promotion: Callable[[], None] | None) -> Report:
    version, section = uuid.uuid4().hex, "document"
    fs, path = _files(spark, folder)
    try:
        staged = {}
        for section, typed in sections():
            staged[section] = typed()
            staged[section].write.parquet(f"{folder.rstrip('/')}/{version}/{section}")
        staged = {s: spark.read.schema(SCHEMAS[s]).parquet(f"{folder.rstrip('/')}/{version}/{s}") for s in staged}
        for section, rule, broken in _rules(staged):
            if found := broken.limit(EXAMPLES).collect():
                raise BrokenSection(section, rule, [r[0] for r in found])
        counts = {s: t.count() for s, t in staged.items()}
        section = "promotion"
        if before_promotion is not None:
            before_promotion()
        _promote(spark, folder, version)
    except Exception as e:  # whatever it is, nothing of this version may be seen
        fs.delete(path(version), True)
        return Report("failed", (_current(spark, folder) or {}).get("version"), getattr(e, "section", section), str(e), {})
    return Report("restored", version, None, None, counts)


def restored(spark: SparkSession, folder: str, section: str) -> DataFrame:
    """A table as the last restore that succeeded left it; empty if none did."""
    now = _current(spark, folder)
    if now is None:
        return spark.createDataFrame([], SCHEMAS[section])
    return spark.read.schema(SCHEMAS[section]).parquet(f"{folder.rstrip('/')}/{now['version']}/{section}")


def collected(tables: Mapping[str, DataFrame], most_bytes: int = 16 << 20) -> str:
    """The document of tables by section. A session's document is bounded, and so is what is collected for it."""

    def rows(s: str) -> list[dict]:
        if s not in tables:
            return []
        own = [{k: v for k, v in r.asDict().items() if v is not None and not (isinstance(v, float) and math.isnan(v))} for r in tables[s].limit(1_000_001).collect()]
        if len(own) > 1_000_000:
            raise ValueError(f"{s}: too many rows for a session")
        return own

    wide: dict[str, dict] = {}
    for r in rows("metadata"):
        wide.setdefault(r["name"], {"name": r["name"]}).update({r["field"]: r.get("value", "")} if "field" in r else {})
    plan: dict[tuple, list] = {}
    for r in rows("stats_plan"):
        plan.setdefault((r["channel"], r.get("mask", "")), []).append(r["metric"])
    document = {
        "session": {"version": 1}, "files": {"records": rows("files")}, "metadata": {"columns": rows("metadata_columns"), "rows": list(wide.values())},
        "stats_plan": {"entries": [{"channel": c, "mask": m, "metrics": sorted(x)} for (c, m), x in sorted(plan.items())]},
        "structural_qc": {r["channel"]: {k: r[k] for k in ("enabled", "override") if k in r} for r in rows("structural_qc")},
        "modeling": {"samples": rows("modeling")}, "table": {"selected_files": [r["selected"] for r in rows("table")]},
    }
    text = write_session(document)
    if len(text.encode()) > most_bytes:
        raise ValueError("session is too large")
    return text


def collected_parts(tables: Mapping[str, DataFrame], parts: str) -> str:
    """Writes the document of tables by section in parts, in a new folder, and returns it: no row comes to the driver."""
    if unknown := set(tables) - set(SCHEMAS):
        raise ValueError(f"unknown sections: {sorted(unknown)}")
    spark = next(iter(tables.values())).sparkSession
    for section, table in tables.items():
        fields = [f for f in T._parse_datatype_string(SCHEMAS[section]).fields if f.name in table.columns]
        cells = {f.name: F.col(f.name).cast(f.dataType) for f in fields}
        cells |= {f.name: F.when(~F.isnan(cells[f.name]), cells[f.name]) for f in fields if isinstance(f.dataType, T.DoubleType)}
        table.select(*[c.alias(k) for k, c in cells.items()]).write.json(f"{parts.rstrip('/')}/{section}")
    fs, path = _files(spark, parts)
    out = fs.create(path(HEAD), False)
    out.write(json.dumps({"version": 1}).encode())
    out.close()
    return parts
