"""Text exports as a data source of Spark's: ``spark.read.format("maskwave")``, and formats of a user's own beside it.

A format says which keys a file name holds and what matrix a file's text holds. ``register`` makes it known to a session by its name;
files are then listed once, dealt into partitions by size and parsed where they are read; options keep files unread.

    exports.register(spark)
    spark.read.format("maskwave").option("fs", 25).option("segments", "A1,V3").load("/shared/exports")
    cells.write.format("maskwave").mode("append").save("/shared/again")
"""

from __future__ import annotations

import posixpath
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..functions.protocol import Protocol

CELLS = "subject_id string, visit_id string, segment_label string, vessel_type string, t_idx int, t double, locus int, x double, m boolean, units string, path string, error string"
KEYS = ("subject_id", "visit_id", "segment_label")
# Names and extensions of exports, what header lines hold, texts that a plain table reads as missing.
NAME = r"([^_/]+)_([^_/]+)_([A-Za-z]\d+)"
EXTENSIONS = (".rtf", ".txt", ".csv")
HEADERS = ("diameters complete", "-> position")
MISSING = frozenset(("", "nan", "NaN", "NA", "N/A", "NULL", "null", "None", "n/a", "-nan", "-NaN", "<NA>"))
#: Bytes of files that one partition reads.
PARTITION_BYTES = 32 << 20
ROWS = 65_536


@dataclass
class Options:
    """fs: samples a second (required to read). skip_lines: head of a file that is no plain table. end: seconds of the protocol, and strict:
    whether files must have ceil(end * fs) samples. mode: FAILFAST, DROPMALFORMED, or PERMISSIVE (a row with the error for the file).
    subjects, visits, segments: the only ones whose files are read, between commas. recordings: a Parquet table of subject_id and visit_id, the
    only recordings whose files are read."""

    fs: float = 0.0
    skip_lines: int = 4
    end: float = 0.0
    strict: bool = False
    mode: str = "FAILFAST"
    units: str = "a.u."
    pattern: str = NAME
    partition_bytes: int = PARTITION_BYTES
    subjects: str = ""
    visits: str = ""
    segments: str = ""
    recordings: str = ""

    @classmethod
    def of(cls, given: dict) -> Options:
        """From a reader's options, whose names may have any case and no underscores."""
        plain = {k.lower().replace("_", ""): v for k, v in given.items()}
        found = {}
        for name, f in cls.__dataclass_fields__.items():
            text = plain.get(name.replace("_", ""))
            if text is not None:
                found[name] = {"float": float, "int": int, "bool": lambda v: v.strip().lower() == "true", "str": str}[f.type](text)
        out = cls(**found)
        out.mode = out.mode.upper()
        if out.mode not in ("FAILFAST", "DROPMALFORMED", "PERMISSIVE"):
            raise ValueError(f"unknown mode {out.mode}")
        return out


def options(protocol: Protocol, **more) -> dict[str, str]:
    """A reader's options for a protocol."""
    return {k: str(v) for k, v in {"fs": protocol.fs, "end": protocol.end(), **more}.items()}


class ExportFormat:
    """What a user's format gives: a name, keys of a file name, and the matrix (times x loci, NaN for missing) of a file's text."""

    name = "maskwave"
    version = "1.0"

    def __init__(self, options: Options) -> None:
        self.options = options
        self._pattern = re.compile(options.pattern)

    def keys(self, filename: str) -> tuple[str, str, str] | None:
        """subject, visit and label; None for files that are no exports."""
        found = self._pattern.search(filename) if filename.lower().endswith(EXTENSIONS) else None
        return found.groups()[:3] if found else None

    def matrix(self, text: str) -> np.ndarray:
        """Plain tables as they are; other texts line by line, after the head. Fewer than two rows are an error."""
        lines = normalised(text).removesuffix("\n").split("\n")
        table = plain_table(lines)
        if table is None:
            table = tolerant_table(lines, self.options.skip_lines)
        if table.shape[0] < 2 or table.shape[1] < 1:
            raise ValueError(f"a matrix of {table.shape[0]} x {table.shape[1]}")
        table = without_time(table)
        wanted = int(np.ceil(self.options.end * self.options.fs))
        if self.options.strict and len(table) != wanted:
            raise ValueError(f"{len(table)} samples where the protocol has {wanted}")
        return table


def normalised(text: str) -> str:
    """Rich-text tokens as tabs and line ends; lines that are empty close up."""
    out = re.sub(r"\\(?:tab|cell)(?![a-zA-Z]) ?", "\t", text.replace("\r\n", "\n").replace("\r", "\n"))
    return re.sub(r"\n{2,}", "\n", re.sub(r"\\(?:par|line)(?![a-zA-Z]) ?", "\n", out))


def _cut(line: str) -> list[str]:
    return line.split("\t") if "\t" in line else line.split()


def _float(text: str) -> float | None:
    try:
        return float(text)
    except ValueError:
        return None


def number(token: str) -> float:
    """A tolerant number: decimal comma, other characters dropped, NaN if none is left."""
    value = _float(re.sub(r"[^0-9.+\-eE]", "", token.strip().replace(",", ".")))
    return np.nan if value is None else value


def numbers(line: str) -> list[float]:
    """The numbers of a line: cells between tabs, else words between blanks, else every number that stands in it."""
    if "\t" in line or re.search(r"\s", line.strip()):
        return [number(c) for c in _cut(line)]
    return [float(n) for n in re.findall(r"[-+]?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?", line.replace(",", "."))]


def plain_table(lines: list[str]) -> np.ndarray | None:
    """The table from the first line on that begins with a number; None unless all cells are numbers or missing, with decimal points.

    Its first row gives the width: shorter rows are filled up, wider ones left out."""
    start = next((k for k, line in enumerate(lines) if line.strip() and _float(_cut(line.strip())[0].strip().replace(",", ".")) is not None), None)
    if start is None:
        return None
    tabs = "\t" in "\n".join(lines[start : start + 40])[:500]
    rows, width = [], None
    for line in lines[start:]:
        if not line.strip(" ") if tabs else not line.strip():
            continue
        cells = line.split("\t") if tabs else line.split()
        width = width or len(cells)
        if len(cells) > width:
            continue
        row = [np.nan if c.strip() in MISSING else _float(c) for c in cells]
        if None in row:
            return None
        rows.append(row + [np.nan] * (width - len(row)))
    return np.array(rows) if len(rows) >= 2 else None


def tolerant_table(lines: list[str], skip: int) -> np.ndarray:
    """Rows of numbers after the head; the most frequent width (the smallest of equals) holds. Rows between that hold nothing are missing
    as a whole; wider rows lose cells that are missing, and are an error if they have others."""
    rows: list[list[float]] = []
    for line in lines[skip:]:
        text = line.strip()
        if not rows and (text.startswith(("{", "\\")) or any(h in text.lower() for h in HEADERS) or "time" in text.lower()):
            continue
        if text.strip("{}") == "" != text:  # the end of a rich text is no row
            continue
        found = numbers(line) if text else []
        if found or rows:
            rows.append(found)
    widths = [len(r) for r in rows if r]
    if len(rows) < 2 or not widths:
        raise ValueError("no rows of numbers")
    width = int(np.bincount(widths).argmax())
    out = np.full((len(rows), width), np.nan)
    for k, row in enumerate(rows):
        if np.isfinite(row[width:]).any():
            raise ValueError(f"row {k} has {len(row)} numbers where others have {width}")
        out[k, : len(row[:width])] = row[:width]
    return out


def without_time(table: np.ndarray) -> np.ndarray:
    """Without a first column that counts time: mostly there, rising by nearly equal steps."""
    if table.shape[1] < 2 or np.mean(~np.isfinite(table[:, 0])) > 0.2:
        return table
    steps = np.diff(table[:, 0])
    steps = steps[np.isfinite(steps)]
    if len(steps) < 10 or np.mean(steps > 0) < 0.95:
        return table
    mid = np.median(steps)
    return table[:, 1:] if mid > 0 and np.median(np.abs(steps - mid)) < 0.05 * mid else table


def vessel(label: str) -> str:
    return {"A": "artery", "V": "vein"}.get(label.strip()[:1].upper(), "unknown")


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    """A file system and the path in it; a path without a scheme is local."""
    if re.match(r"^[a-z][a-z0-9+.-]*:", path):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), posixpath.abspath(path)


@dataclass
class Files(InputPartition):
    """Files of one partition: (path, keys)."""

    found: tuple[tuple[str, tuple[str, str, str]], ...]


class ExportReader(DataSourceReader):
    """Lists files by name and size, deals them into partitions, and parses each where it is read.

    Predicates are left to Spark, which keeps a first scan's partitions for later scans of the same DataFrame; options choose files."""

    def __init__(self, form: type[ExportFormat], options: dict) -> None:
        self.path = options.get("path")
        if not self.path:
            raise ValueError("a path is needed: load(path)")
        self.options = Options.of(dict(options))
        if not self.options.fs > 0:
            raise ValueError("option fs, the samples a second, is needed")
        self.form = form
        given = (self.options.subjects, self.options.visits, self.options.segments)
        self.wanted = [{w.strip() for w in text.split(",")} if text else None for text in given]

    def files(self) -> list[tuple[tuple[str, str, str], tuple[str, int]]]:
        """((subject, visit, label), (path, bytes)) of every file that is to be read; of files with equal keys the last path."""
        store, root = _opened(self.path)
        form = self.form(self.options)
        only = None
        if self.options.recordings:
            held, at = _opened(self.options.recordings)
            table = ds.dataset(at, filesystem=held, format="parquet").to_table(columns=list(KEYS[:2]))
            only = set(zip(*(c.to_pylist() for c in table.columns), strict=True))
        last: dict[tuple, tuple[str, int]] = {}
        for info in sorted(store.get_file_info(pafs.FileSelector(root, recursive=True)), key=lambda i: i.path):
            keys = form.keys(info.base_name) if info.type == pafs.FileType.File else None
            if keys is not None and all(w is None or k in w for w, k in zip(self.wanted, keys, strict=True)) and (only is None or keys[:2] in only):
                last[keys] = (info.path, info.size or 0)
        return sorted(last.items(), key=lambda x: x[1])

    def partitions(self) -> list[InputPartition]:
        out, held, size = [], [], 0
        for keys, (path, n) in self.files():
            if held and size + n > self.options.partition_bytes:
                out.append(Files(tuple(held)))
                held, size = [], 0
            held.append((path, keys))
            size += n
        return [*out, Files(tuple(held))]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = _opened(self.path)
        form = self.form(self.options)
        for path, keys in partition.found:
            try:
                with store.open_input_stream(path) as f:
                    table = np.asarray(form.matrix(f.read().decode("utf-8", "ignore")), float)
            except Exception as e:  # noqa: BLE001 - what a user's format raises is the file's error
                if self.options.mode == "FAILFAST":
                    raise ValueError(f"{path}: {e}") from e
                if self.options.mode == "PERMISSIVE":
                    yield self._batch(keys, path, np.zeros(1), np.zeros(1), np.full(1, np.nan), f"{type(e).__name__}: {e}")
                continue
            times, loci = table.shape
            at = max(1, ROWS // max(loci, 1))
            for k in range(0, times, at):
                part = table[k : k + at]
                yield self._batch(keys, path, np.repeat(np.arange(k, k + len(part)), loci), np.tile(np.arange(loci), len(part)), part.ravel())

    def _batch(self, keys, path, t_idx, locus, x, error=None) -> pa.RecordBatch:
        n, there = len(x), np.isfinite(x)
        same = lambda v: pa.array([v] * n, pa.string())
        gone = np.full(n, error is not None)
        columns = [same(k) for k in (*keys, vessel(keys[2]))]
        columns += [pa.array(t_idx, pa.int32(), mask=gone), pa.array(t_idx / self.options.fs, mask=gone), pa.array(locus, pa.int32(), mask=gone), pa.array(x, mask=~there), pa.array(there, mask=gone)]
        return pa.RecordBatch.from_arrays([*columns, same(self.options.units), same(path), same(error)], [c.split()[0] for c in CELLS.split(", ")])


@dataclass
class Written(WriterCommitMessage):
    files: tuple[tuple[str, str], ...]


class ExportWriter(DataSourceArrowWriter):
    """Writes cells as one tab-separated file a segment: rows must come with a segment's cells together, by time and locus
    (``together`` sorts them so). Files get their names when all tasks are done, so a job that breaks leaves none."""

    def __init__(self, options: dict) -> None:
        self.path = options.get("path")

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        store, root = _opened(self.path)
        store.create_dir(root, recursive=True)
        made, out, at, row = [], None, None, (None, [])

        def close():
            if out is not None:
                out.write(("\t".join(row[1]) + "\n").encode())
                out.close()

        for batch in batches:
            for *keys, t, x in zip(*(batch.column(c).to_pylist() for c in (*KEYS, "t_idx", "x")), strict=True):
                if keys != at:
                    close()
                    name = f"{root}/{'_'.join(keys)}.txt"
                    if name in (n for _, n in made):
                        raise ValueError(f"rows of {name} are not together")
                    made.append((f"{root}/.{uuid.uuid4().hex}.part", name))
                    at, out, row = keys, store.open_output_stream(made[-1][0]), (t, [])
                elif t != row[0]:
                    out.write(("\t".join(row[1]) + "\n").encode())
                    row = (t, [])
                row[1].append("" if x is None or x != x else repr(x))
        close()
        return Written(tuple(made))

    def commit(self, messages: list[Written | None]) -> None:
        store, _ = _opened(self.path)
        for m in messages:
            for part, name in m.files if m else ():
                store.move(part, name)

    def abort(self, messages: list[Written | None]) -> None:
        store, _ = _opened(self.path)
        for m in messages:
            for part, _ in m.files if m else ():
                store.delete_file(part)


def together(cells):
    """Cells with each segment's together and in order, as the writer needs them."""
    return cells.repartition(*KEYS).sortWithinPartitions(*KEYS, "t_idx", "locus")


def source(form: type[ExportFormat] = ExportFormat) -> type[DataSource]:
    """The data source of a format."""

    class Exports(DataSource):
        @classmethod
        def name(cls) -> str:
            return form.name

        def schema(self) -> str:
            return CELLS

        def reader(self, schema) -> DataSourceReader:
            return ExportReader(form, self.options)

        def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
            return ExportWriter(self.options)

    return Exports


def register(spark: SparkSession, form: type[ExportFormat] = ExportFormat) -> None:
    """Makes a format known to a session by its name: ``spark.read.format(form.name)``."""
    spark.dataSource.register(source(form))


def listed(spark: SparkSession, path: str, form: type[ExportFormat] = ExportFormat, **more):
    """subject_id, visit_id, segment_label, path, bytes of the files that a format would read; nothing is parsed."""
    found = ExportReader(form, {"path": path, "fs": "1", **more}).files()
    return spark.createDataFrame([(*keys, p, n) for keys, (p, n) in found], "subject_id string, visit_id string, segment_label string, path string, bytes long")
