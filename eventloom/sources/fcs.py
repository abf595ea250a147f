"""List-mode event files (FCS 2.0, 3.0, 3.1) as a Spark data source.

    spark.dataSource.register(FcsSource)
    spark.read.format("fcs").load("dir/*.fcs")                                  # a row per event, a column per parameter
    spark.read.format("fcs").option("channels", "DNA-A,Time").load(...)         # only these are decoded
    spark.read.format("fcs").option("mode", "header").load(...)                 # a row per file; DATA is not read
    spark.read.format("fcs").option("quarantine", "true").load(...)             # files that can't be read are rows with _error
    events, errors = load_events(spark, "dir")                                  # the same, apart, with the cohort's channels

Planning only lists files: a file is cut by bytes, and each task reads the header of its file and those records that begin within its
cut. Files are opened through pyarrow's file systems (local, HDFS, S3, ...). With mode "header" a file that can't be read is a row
with error_code. With "quarantine" it is one row whose _error is struct(path, code, detail), with null events; a read that fails
half-way is such a row too, after the events that were read. Otherwise reading it fails. "missing" = "error" treats a file without
one of the channels as one that can't be read, else such channels are null.
"""

from __future__ import annotations

import glob
import os
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DoubleType, LongType, MapType, StringType, StructField, StructType

#: Limits of a file, and the versions that are read.
MOST = {"parameters": 1024, "events": 100_000_000, "data": 2 << 30, "text": 16 << 20, "padding": 8}
VERSIONS = ("FCS2.0", "FCS3.0", "FCS3.1")
LITTLE, BIG = ("1,2,3,4", "1,2"), ("4,3,2,1", "2,1")


class FcsError(ValueError):
    def __init__(self, code: str, text: str):
        super().__init__(f"{code}: {text}")
        self.code = code


@dataclass
class Summary:
    """What a file's HEADER and TEXT say."""

    version: str
    metadata: dict[str, str]
    names: list[str]
    stains: list[str]
    events: int
    begin: int
    end: int
    widths: list[int]
    kind: str
    little: bool
    labels: list[str] = field(default_factory=list)

    @property
    def width(self) -> int:
        return sum(self.widths)


def _offset(raw: bytes, what: str) -> int:
    text = raw.decode("latin-1").strip()
    if not text:
        return 0
    if not text.isdigit() or int(text) > (1 << 53) - 1:
        raise FcsError("FCS_OFFSET_INVALID", f"{what}: {text!r}")
    return int(text)


def keyword(key: str) -> str:
    return key.strip().removeprefix("$").replace(" ", "_").upper()


def parse_text(text: str) -> dict[str, str]:
    """Keys and values between delimiters; the first character is the delimiter, and doubled it stands for itself."""
    if not text:
        raise FcsError("FCS_TEXT_INVALID", "TEXT is empty")
    mark = text[0]
    parts, now, i = [], [], 1
    while i < len(text):
        if text[i] == mark:
            if text[i + 1 : i + 2] == mark and now:
                now.append(mark)
                i += 2
                continue
            parts.append("".join(now))
            now = []
        else:
            now.append(text[i])
        i += 1
    if "".join(now).strip():
        parts.append("".join(now))
    if len(parts) % 2:
        raise FcsError("FCS_TEXT_INVALID", "TEXT has a key without a value")
    return {keyword(k): v.strip() for k, v in zip(parts[::2], parts[1::2], strict=True)}


def _number(metadata: dict[str, str], key: str, code: str) -> int:
    try:
        return int(metadata[key].strip())
    except (KeyError, ValueError) as e:
        raise FcsError(code, f"${key} is {metadata.get(key)!r}") from e


def summarize(read, size: int | None) -> Summary:
    """read(offset, length) -> bytes. Checks offsets, sizes and limits against each other."""
    head = read(0, 58)
    if len(head) < 58:
        raise FcsError("FCS_HEADER_TRUNCATED", f"{len(head)} bytes")
    version = head[:6].decode("latin-1")
    if not version.startswith("FCS"):
        raise FcsError("FCS_VERSION_UNSUPPORTED", version)
    t0, t1, d0, d1, a0, a1 = (_offset(head[10 + 8 * k : 18 + 8 * k], f"offset {k}") for k in range(6))
    if t0 < 58 or t1 < t0 or t1 - t0 + 1 > MOST["text"] or (size is not None and t1 >= size):
        raise FcsError("FCS_SEGMENT_RANGE_INVALID", "TEXT")
    meta = parse_text(read(t0, t1 - t0 + 1).decode("utf-8", "replace"))
    if int(meta.get("BEGINSTEXT", "0") or 0) or int(meta.get("ENDSTEXT", "0") or 0):
        raise FcsError("FCS_SUPPLEMENTAL_TEXT_UNSUPPORTED", "supplemental TEXT")
    for name, own, begin, end in (("DATA", (d0, d1), "BEGINDATA", "ENDDATA"), ("ANALYSIS", (a0, a1), "BEGINANALYSIS", "ENDANALYSIS")):
        said = _offset(meta.get(begin, "").encode(), begin), _offset(meta.get(end, "").encode(), end)
        if all(own) and all(said) and own != said:
            raise FcsError("FCS_OFFSET_CONFLICT", name)
        if not any(own):
            d0, d1, a0, a1 = (*said, a0, a1) if name == "DATA" else (d0, d1, *said)
    n, events = _number(meta, "PAR", "FCS_METADATA_INVALID"), _number(meta, "TOT", "FCS_METADATA_INVALID")
    if n < 1 or events < 0:
        raise FcsError("FCS_METADATA_INVALID", f"$PAR {n}, $TOT {events}")
    if n > MOST["parameters"]:
        raise FcsError("FCS_PARAMETER_LIMIT_EXCEEDED", str(n))
    if events > MOST["events"]:
        raise FcsError("FCS_EVENT_LIMIT_EXCEEDED", str(events))
    order = meta.get("BYTEORD", LITTLE[0]).replace(" ", "")
    if order not in LITTLE + BIG:
        raise FcsError("FCS_BYTE_ORDER_UNSUPPORTED", order)
    kind = meta.get("DATATYPE", "F").upper()
    if kind not in ("F", "D", "I"):
        raise FcsError("FCS_DATATYPE_UNSUPPORTED", kind)
    widths = [4] * n if kind == "F" else [8] * n
    if kind == "I":
        for k in range(n):
            bits = _number({"B": meta.get(f"P{k + 1}B", "32")}, "B", "FCS_INTEGER_WIDTH_INVALID")
            if bits < 1:
                raise FcsError("FCS_INTEGER_WIDTH_INVALID", str(bits))
            if bits % 8:
                raise FcsError("FCS_PACKED_INTEGER_UNSUPPORTED", str(bits))
            if bits > 53:
                raise FcsError("FCS_INTEGER_PRECISION_UNSUPPORTED", str(bits))
            widths[k] = bits // 8
    need, have = events * sum(widths), d1 - d0 + 1
    if need > MOST["data"]:
        raise FcsError("FCS_DATA_LIMIT_EXCEEDED", str(need))
    if d0 <= 0 or d1 < d0 or (size is not None and d0 >= size):
        raise FcsError("FCS_SEGMENT_RANGE_INVALID", "DATA")
    if a0 > 0 and d1 >= a0:
        raise FcsError("FCS_SEGMENT_OVERLAP", "DATA and ANALYSIS")
    if size is not None and d1 >= size:
        raise FcsError("FCS_DATA_TRUNCATED" if have == need and size - d0 < need else "FCS_SEGMENT_RANGE_INVALID", "DATA")
    if have < need:
        raise FcsError("FCS_DATA_TRUNCATED" if need - have <= sum(widths) else "FCS_DATA_LENGTH_MISMATCH", f"{have} of {need} bytes")
    if have - need > MOST["padding"]:
        raise FcsError("FCS_DATA_LENGTH_MISMATCH", f"{have} bytes for {need}")
    names = [meta.get(f"P{k + 1}N", "") for k in range(n)]
    stains = [meta.get(f"P{k + 1}S", "") for k in range(n)]
    labels = [s or m or f"P{k + 1}" for k, (s, m) in enumerate(zip(stains, names, strict=True))]
    return Summary(version, meta, names, stains, events, d0, d1, widths, kind, order in LITTLE, labels)


def eligibility(s: Summary, k: int) -> str:
    """"linear", or the first reason for which parameter k (from 0) can't be read as linear."""
    m, p = s.metadata, f"P{k + 1}"
    number = lambda x: float(x) if x.replace(".", "", 1).replace("-", "", 1).isdigit() else None
    value_range, gain = number(m.get(p + "R", "")), number(m.get(p + "G", "1"))
    spill = next((m[x] for x in ("SPILLOVER", "SPILL", "COMP") if x in m), "")
    parts = [x.strip() for x in spill.split(",")]
    compensated = parts[1 : 1 + int(parts[0])] if parts[0].isdigit() else []
    if s.version not in VERSIONS:
        return "unsupported_version"
    if m.get("MODE", "L").upper() != "L":
        return "unsupported_mode"
    if m.get("NEXTDATA", "0").strip() not in ("", "0"):
        return "multiple_datasets"
    if not value_range or value_range <= 0:
        return "invalid_range"
    if [number(x) for x in m.get(p + "E", "0,0").split(",")] != [0.0, 0.0]:
        return "logarithmic"
    if gain != 1:
        return "gain"
    return "compensation" if s.names[k] in compensated else "linear"


def decode(raw: bytes, s: Summary, columns: list[int]) -> list[np.ndarray]:
    """The chosen parameters of whole records, as doubles."""
    table = np.frombuffer(raw, np.uint8).reshape(-1, s.width)
    at = np.concatenate(([0], np.cumsum(s.widths)))
    out = []
    for k in columns:
        part = table[:, at[k] : at[k + 1]]
        if s.kind == "I":
            powers = 256.0 ** np.arange(s.widths[k])
            out.append(part.astype(np.float64) @ (powers if s.little else powers[::-1]))
        else:
            kind = ("<" if s.little else ">") + ("f4" if s.kind == "F" else "f8")
            out.append(np.ascontiguousarray(part).view(kind)[:, 0].astype(np.float64))
    return out


def header(names: list[str], events: int, *, kind: str = "F", little: bool = True, bits: list[int] | None = None, extra: dict[str, str] | None = None, version: str = "FCS3.1", mark: str = "/") -> bytes:
    """HEADER and TEXT of a file of so many events; DATA follows them. Offsets that HEADER has no room for are in TEXT alone."""
    bits = bits or [64 if kind == "D" else 32] * len(names)
    size = events * sum(b // 8 for b in bits)
    meta = {"$PAR": len(names), "$TOT": events, "$DATATYPE": kind, "$BYTEORD": LITTLE[0] if little else BIG[0], "$MODE": "L", "$NEXTDATA": 0}
    for k, name in enumerate(names, 1):
        meta |= {f"$P{k}N": name, f"$P{k}B": bits[k - 1], f"$P{k}R": 262144, f"$P{k}E": "0,0", f"$P{k}G": 1}
    meta |= extra or {}
    written = lambda more: (mark + "".join(f"{k}{mark}{str(v).replace(mark, mark * 2)}{mark}" for k, v in (meta | more).items())).encode()
    raw = written({})
    begin = 58 + len(raw)
    at = (begin, begin + size - 1)
    if at[1] > 99_999_999:
        begin = 58 + len(written({"$BEGINDATA": "0" * 15, "$ENDDATA": "0" * 15}))
        raw, at = written({"$BEGINDATA": f"{begin:015}", "$ENDDATA": f"{begin + size - 1:015}"}), (0, 0)
    return (f"{version:<10}" + "".join(f"{x:>8}" for x in (58, begin - 1, *at, 0, 0))).encode() + raw


def records(columns: list[np.ndarray], *, kind: str = "F", little: bool = True, bits: list[int] | None = None) -> bytes:
    """DATA of these columns."""
    bits = bits or [64 if kind == "D" else 32] * len(columns)
    parts = []
    for c, b in zip(columns, bits, strict=True):
        if kind == "I":
            raw = np.asarray(c, np.uint64).astype("<u8" if little else ">u8").view(np.uint8).reshape(-1, 8)
            parts.append(raw[:, : b // 8] if little else raw[:, 8 - b // 8 :])
        else:
            parts.append(np.ascontiguousarray(np.asarray(c).astype(("<" if little else ">") + ("f4" if kind == "F" else "f8"))).view(np.uint8).reshape(len(c), -1))
    return np.concatenate(parts, axis=1).tobytes()


def encode(names: list[str], columns: list[np.ndarray], *, kind: str = "F", little: bool = True, bits: list[int] | None = None, **more) -> bytes:
    """A file of these columns, in memory."""
    return header(names, len(columns[0]), kind=kind, little=little, bits=bits, **more) + records(columns, kind=kind, little=little, bits=bits)


def _files(path: str) -> list[tuple[str, int]]:
    """(file, size) of a file, the .fcs files of a directory, or those that a pattern of local names matches; -1: unknown size."""
    if "://" not in path and any(c in path for c in "*?["):
        return [(p, os.path.getsize(p)) for p in sorted(glob.glob(path))]
    fs, inner = pyarrow.fs.FileSystem.from_uri(path) if "://" in path else (pyarrow.fs.LocalFileSystem(), path)
    info = fs.get_file_info(inner)
    if info.type == pyarrow.fs.FileType.Directory:
        return sorted((path.rstrip("/") + "/" + posixpath.basename(f.path), f.size) for f in fs.get_file_info(pyarrow.fs.FileSelector(inner)) if f.path.lower().endswith(".fcs"))
    return [(path, info.size if info.size is not None else -1)]


def _open(path: str):
    fs, inner = pyarrow.fs.FileSystem.from_uri(path) if "://" in path else (pyarrow.fs.LocalFileSystem(), path)
    f = fs.open_input_file(inner)
    return f, f.size()


def _summary(path: str) -> Summary:
    f, size = _open(path)
    with f:
        return summarize(lambda at, n: f.read_at(n, at), size)


@dataclass
class FileCut(InputPartition):
    """The records of a file that begin at the bytes first..last - 1; the first cut answers for the file's errors."""

    path: str
    first: int
    last: int


ERROR = StructType([StructField("path", StringType()), StructField("code", StringType()), StructField("detail", StringType())])


HEADER_SCHEMA = StructType([StructField("path", StringType()), StructField("sample_id", StringType()), StructField("version", StringType()), StructField("events", LongType()), StructField("labels", ArrayType(StringType())), StructField("eligibility", ArrayType(StringType())), StructField("metadata", MapType(StringType(), StringType())), StructField("error_code", StringType())])


def sample_name(path: str) -> str:
    base = posixpath.basename(path.replace("\\", "/"))
    return base[:-4] if base.lower().endswith(".fcs") else base


class FcsSource(DataSource):
    """See the module."""

    @classmethod
    def name(cls) -> str:
        return "fcs"

    def _labels(self) -> list[str]:
        """The channels asked for. Else those of every file, whose headers are read here, one by one: for many files ask for
        channels, or use load_events()."""
        wanted = [x.strip() for x in self.options.get("channels", "").split(",") if x.strip()]
        if wanted:
            return wanted
        seen: dict[str, None] = {}
        for path, _ in _files(self.options["path"]):
            try:
                seen |= dict.fromkeys(_summary(path).labels)
            except (FcsError, OSError):
                if self.options.get("quarantine") != "true":
                    raise
        return list(seen)

    def schema(self) -> StructType:
        if self.options.get("mode") == "header":
            return HEADER_SCHEMA
        error = [StructField("_error", ERROR)] if self.options.get("quarantine") == "true" else []
        return StructType([StructField("sample_id", StringType()), StructField("event_index", LongType()), *(StructField(x, DoubleType()) for x in self._labels()), *error])

    def reader(self, schema: StructType) -> DataSourceReader:
        return FcsReader(self.options, schema)


class FcsReader(DataSourceReader):
    def __init__(self, options, schema: StructType):
        self.options, self.schema = dict(options), schema
        self.bytes = int(options.get("split_bytes", 64 << 20))
        self.quarantine = options.get("quarantine") == "true" and options.get("mode") != "header"

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for path, size in _files(self.options["path"]):
            ends = [0] if self.options.get("mode") == "header" or size <= 0 else [*range(0, size, self.bytes)]
            out += [FileCut(path, a, b) for a, b in zip(ends, [*ends[1:], 1 << 62], strict=True)]
        return out or [FileCut("", 0, 0)]

    def read(self, partition: FileCut) -> Iterator:
        if not partition.path:
            return
        if self.options.get("mode") == "header":
            yield self._header(partition.path)
            return
        begun = False
        try:
            for batch in self._events(partition):
                begun = True
                yield batch
        except (FcsError, OSError) as e:
            if not self.quarantine:
                raise
            if partition.first == 0 or begun or not isinstance(e, FcsError):  # a bad header is told once, by the first cut
                yield self._error(partition.path, getattr(e, "code", "FCS_UNREADABLE"), str(e))

    def _events(self, cut: FileCut) -> Iterator[pa.RecordBatch]:
        s = _summary(cut.path)
        labels = [f.name for f in self.schema.fields[2:] if f.name != "_error"]
        have = {x: k for k, x in reversed(list(enumerate(s.labels)))}
        have |= {x: k for k, x in reversed(list(enumerate(s.names))) if x and x not in have}
        lost = [x for x in labels if x not in have]
        if lost and self.options.get("missing") == "error":
            raise FcsError("FCS_CHANNEL_MISSING", ", ".join(lost))
        first, last = (min(s.events, max(0, -(-(at - s.begin) // s.width))) for at in (cut.first, cut.last))
        if first == last:
            return
        f, _ = _open(cut.path)
        step = max(1, (8 << 20) // s.width)
        with f:
            for at in range(first, last, step):
                n = min(step, last - at)
                raw = f.read_at(n * s.width, s.begin + at * s.width)
                if len(raw) < n * s.width:
                    raise FcsError("FCS_DATA_TRUNCATED", f"{len(raw)} of {n * s.width} bytes at event {at}")
                columns = decode(raw, s, [have[x] for x in labels if x in have])
                found = dict(zip([x for x in labels if x in have], columns, strict=True))
                values = [pa.array([sample_name(cut.path)] * n), pa.array(np.arange(at, at + n)), *(pa.array(found[x]) if x in found else pa.nulls(n, pa.float64()) for x in labels)]
                yield self._batch(values + ([pa.nulls(n, to_arrow_type(ERROR))] if self.quarantine else []))

    def _error(self, path: str, code: str, detail: str) -> pa.RecordBatch:
        error = pa.array([{"path": path, "code": code, "detail": detail}], to_arrow_type(ERROR))
        return self._batch([pa.array([sample_name(path)]), pa.nulls(1, pa.int64()), *[pa.nulls(1, pa.float64())] * (len(self.schema.fields) - 3), error])

    def _batch(self, values: list[pa.Array]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(values, names=[f.name for f in self.schema.fields])

    def _header(self, path: str) -> tuple:
        try:
            s = _summary(path)
        except (FcsError, OSError) as e:
            return (path, sample_name(path), None, None, None, None, None, getattr(e, "code", "FCS_UNREADABLE"))
        return (path, sample_name(path), s.version, s.events, s.labels, [eligibility(s, k) for k in range(len(s.labels))], s.metadata, None)


def load_events(spark: SparkSession, path: str, channels: list[str] | None = None, *, missing: str = "null", split_bytes: int = 64 << 20) -> tuple[DataFrame, DataFrame]:
    """(events, errors) of a cohort's files. Errors (path, code, detail) has a row for each file that can't be read; the others'
    events are all there. Without channels, those of all readable headers, which tasks read."""
    spark.dataSource.register(FcsSource)
    if channels is None:
        heads = spark.read.format("fcs").option("mode", "header").load(path)
        found = heads.select(F.posexplode("labels").alias("at", "label")).groupBy("label").agg(F.min("at").alias("at"))
        channels = [r.label for r in found.orderBy("at", "label").limit(MOST["parameters"] + 1).collect()]
        if len(channels) > MOST["parameters"]:
            raise FcsError("FCS_PARAMETER_LIMIT_EXCEEDED", "the files have too many different channels: name some")
        if not channels:
            channels = ["Time"]  # no file can be read: the errors say why
    rows = spark.read.format("fcs").option("channels", ",".join(channels)).option("quarantine", "true").option("missing", missing).option("split_bytes", split_bytes).load(path)
    return rows.where("_error IS NULL").drop("_error"), rows.where("_error IS NOT NULL").select("_error.*")


def write_events(events: DataFrame, by: str, index: str, channels: list[str], folder: str) -> DataFrame:
    """Writes a file of doubles per sample, named after it, and returns (sample, path, events), a row a file.

    A task streams a sample's events, in order, into a file of another name, which it renames when all are there: a lost task
    leaves no half-written file under the sample's name, and its repetition replaces what it wrote.

    A window, not a repartition, brings a sample together: of a repartition after a join by the same key nothing may be left in the
    plan, and then adaptive execution is free to split a sample over tasks. That a sample is whole and in order is checked.
    """
    counts = events.groupBy(by).agg(F.count(F.lit(1)).alias("_n"))
    rows = events.select(F.col(by).cast("string").alias("sample"), F.col(index).cast("long").alias("i"), *[F.col(c).cast("double").alias(f"c{k}") for k, c in enumerate(channels)])
    whole = rows.join(counts.select(F.col(by).cast("string").alias("sample"), "_n"), "sample").select("sample", "_n", F.row_number().over(Window.partitionBy("sample").orderBy("i")).alias("_at"), *[f"c{k}" for k in range(len(channels))])
    most = MOST["events"]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pyarrow.fs.FileSystem.from_uri(folder) if "://" in folder else (pyarrow.fs.LocalFileSystem(), folder)
        fs.create_dir(base, recursive=True)
        now, out, temporary, left, total = None, None, "", 0, 0
        for batch in batches:
            sample = np.asarray(batch.column(0).to_pylist(), object)
            edges = [0, *(np.flatnonzero(sample[1:] != sample[:-1]) + 1).tolist(), len(sample)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                if sample[a] != now:
                    now, left = sample[a], batch.column(1)[a].as_py()
                    if left > most:
                        raise FcsError("FCS_EVENT_LIMIT_EXCEEDED", f"{now}: {left}")
                    temporary = f"{base}/.{uuid.uuid4().hex}.tmp"
                    out = fs.open_output_stream(temporary, compression=None)
                    out.write(header(channels, left, kind="D"))
                    total = left
                if batch.column(2)[a].as_py() != total - left + 1:
                    raise FcsError("FCS_DATA_LENGTH_MISMATCH", f"{now}: events are not in one task or not in order")
                out.write(records([batch.column(k)[a:b].to_numpy(zero_copy_only=False).astype(np.float64) for k in range(3, batch.num_columns)], kind="D"))
                left -= b - a
                if not left:
                    out.close()
                    fs.move(temporary, f"{base}/{now}.fcs")
                    yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([f"{folder}/{now}.fcs"]), pa.array([total])], names=["sample", "path", "events"])
        if left:
            raise FcsError("FCS_DATA_LENGTH_MISMATCH", f"{now}: {left} events are missing")

    return whole.mapInArrow(write, "sample string, path string, events long")
