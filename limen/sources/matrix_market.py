"""MatrixMarket coordinate files as a Spark data source, in batches and as a stream that resumes.

A matrix is one file, or a folder of files of which one begins with the banner; its bytes count through all of them.
They are cut into ranges, each of which has the lines that begin in it, so a file of any size is read once, by as many
tasks as it has ranges, and no line is looked at twice. Lines are parsed in blocks into Arrow batches.

The stream's offsets are byte positions: each micro-batch takes the next ``maxBytesPerTrigger`` bytes, in ranges as
above. Spark's checkpoint holds how far it got, so a query that was stopped or lost goes on there. Its reader is not
told that position when it starts, so it notes in the folder ``progress`` up to where batches were planned, which
happens after Spark has logged them and again when it repeats one.

Options: ``path``; ``splitBytes`` of a range; for streams ``maxBytesPerTrigger`` with ``progress``, else all in one
batch. Gzipped files (``.gz``) are read as one range by one task, as nothing in them tells where lines begin, and not
as streams.

Schema: row, col (from 0), value by the banner's field: long (integer), double (real), 1 (pattern). Symmetric matrices
store one triangle: the other is added. Explicit zeros stay. Comment and blank lines may stand anywhere. An index
outside the declared dimensions, a line of another number of fields or a fraction in an integer matrix stops the job
with its place; the number of triplets is checked where the scan ends: see Matrix.check().
"""

from __future__ import annotations

import gzip
import json
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

FORMAT = "matrixmarket"
SPLIT = 64 << 20
#: Bytes that a task parses at once.
BLOCK = 4 << 20

# executors get these classes with the query, installed or not
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Bytes:
    """The bytes of one file, or of a folder's files one after the other, the one with the banner first.

    files: their names and sizes where they are known, as tasks know them from the driver: nothing is listed again."""

    def __init__(self, path: str, files: list[tuple[str, int]] | None = None):
        from pyarrow import fs

        self.store, at = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        self.files = files or self._found(path, at)
        self.gzipped = self.files[0][0].endswith(".gz")
        if self.gzipped and len(self.files) > 1:
            raise ValueError(f"{path}: a gzipped matrix is one file")
        self.starts = [0]
        for _, size in self.files:
            self.starts.append(self.starts[-1] + size)
        self.size = self.starts[-1]

    def _found(self, path: str, at: str) -> list[tuple[str, int]]:
        from pyarrow import fs

        info = self.store.get_file_info(at)
        if info.type == fs.FileType.Directory:
            found = [f for f in self.store.get_file_info(fs.FileSelector(at)) if f.type == fs.FileType.File and f.base_name[0] not in "_."]
            first = [f for f in found if f.size and self._head(f.path, 14) == b"%%MatrixMarket"]
            if len(first) != 1:
                raise ValueError(f"{path}: {len(first)} of {len(found)} files begin with a MatrixMarket banner")
            rest = sorted((f for f in found if f.path != first[0].path), key=lambda f: f.path)
            return [(f.path, f.size) for f in first + rest]
        if info.type == fs.FileType.File:
            return [(info.path, info.size)]
        raise ValueError(f"{path}: no such file")

    def _head(self, path: str, n: int) -> bytes:
        with self.store.open_input_stream(path, compression=None) as f:
            return f.read(n)

    def blocks(self, start: int, end: int, size: int = BLOCK) -> Iterator[tuple[int, bytes]]:
        """(position, whole lines) of the lines that begin in [start, end)."""
        if self.gzipped:
            if start == 0:
                with self.store.open_input_stream(self.files[0][0], compression=None) as raw, gzip.open(raw) as f:
                    yield from self._lines(f.read, 0, sys.maxsize, 0, size)
            return
        for (name, size_of), low, high in zip(self.files, self.starts, self.starts[1:]):
            if low < end and high > start and size_of:
                with self.store.open_input_file(name) as source:
                    first = max(start - low, 0)
                    # the byte before tells whether a line begins here
                    source.seek(max(first - 1, 0))
                    for at, lines in self._lines(source.read, first, min(end, high) - low, max(first - 1, 0), size):
                        yield low + at, lines

    @staticmethod
    def _lines(read, first: int, stop: int, at: int, size: int) -> Iterator[tuple[int, bytes]]:
        """read gives bytes from ``at`` on; lines that begin in [first, stop)."""
        held, skip = b"", at < first
        while True:
            more = read(size)
            held += more
            if skip:  # the rest of a line that began before
                cut = held.find(b"\n") + 1
                if not cut and more:
                    at, held = at + len(held), b""
                    continue
                at, held, skip = at + cut, held[cut:] if cut else b"", False
            if at >= stop:
                return
            if at + len(held) >= stop:  # the last line that begins before stop may end behind it
                cut = held.find(b"\n", stop - at - 1) + 1
                if cut:
                    yield at, held[:cut]
                    return
            if not more:
                if held:
                    yield at, held
                return
            if at + len(held) < stop:
                cut = held.rfind(b"\n") + 1
                if cut:
                    yield at, held[:cut]
                    at, held = at + cut, held[cut:]


@dataclass(frozen=True)
class Head:
    rows: int
    cols: int
    entries: int
    field: str
    symmetry: str
    body: int

    @property
    def dims(self) -> tuple[int, int, int]:
        return self.rows, self.cols, self.entries


def read_head(source: Bytes, path: str) -> Head:
    """Banner and dimension line; body is where the triplets begin."""
    text = b""
    for at, lines in source.blocks(0, source.size or 1, 1 << 16):
        text += lines
        if not text.startswith(b"%%MatrixMarket"):
            break
        place = 0
        for line in text.splitlines(keepends=True):
            place += len(line)
            if line.startswith(b"%") or not line.strip():
                continue
            banner = text.split(b"\n", 1)[0].decode().lower().split()
            kinds = [*banner[1:], *[""] * 4][:4]
            if kinds[:2] != ["matrix", "coordinate"] or kinds[2] not in ("integer", "real", "double", "pattern") or kinds[3] not in ("general", "symmetric", "skew-symmetric"):
                raise ValueError(f"{path}: cannot read a matrix of the kind {' '.join(banner[1:])}")
            dims = line.split()
            if len(dims) != 3 or not all(x.isdigit() for x in dims):
                raise ValueError(f"{path}: no dimension line, but {line[:80]!r}")
            return Head(*map(int, dims), kinds[2].replace("double", "real"), kinds[3], place)
    if not text.startswith(b"%%MatrixMarket"):
        raise ValueError(f"{path}: no MatrixMarket banner")
    raise ValueError(f"{path}: no dimension line")


def parse(lines: bytes, field: str) -> list[np.ndarray]:
    """row, col (as written) and value of whole lines."""
    from pyarrow import csv

    names = ["row", "col"] + ["value"] * (field != "pattern")
    types = {"row": pa.int64(), "col": pa.int64(), "value": pa.int64() if field == "integer" else pa.float64()}
    try:
        t = csv.read_csv(pa.BufferReader(lines), csv.ReadOptions(column_names=names, use_threads=False), csv.ParseOptions(delimiter=" ", quote_char=False), csv.ConvertOptions(column_types=types, strings_can_be_null=False, null_values=[]))
        out = [t[c].to_numpy() for c in names]
    except pa.ArrowInvalid:  # other blanks between fields, comments, fractions: line by line
        rows = [r for line in lines.splitlines() if (r := line.split()) and not r[0].startswith(b"%")]
        if odd := next((r for r in rows if len(r) != len(names)), None):
            raise ValueError(f"a line of {len(odd)} fields: {b' '.join(odd)[:80].decode(errors='replace')}") from None
        out = [np.array([int(r[k]) for r in rows], np.int64) for k in range(2)]
        if field == "real":
            out.append(np.array([float(r[2]) for r in rows]))
        elif field == "integer":
            if odd := next((r for r in rows if float(r[2]) % 1), None):
                raise ValueError(f"a fraction in an integer matrix: {b' '.join(odd).decode()}") from None
            out.append(np.array([int(float(r[2])) if b"." in r[2] or b"e" in r[2].lower() else int(r[2]) for r in rows], np.int64))
    return out if len(out) == 3 else [*out, np.ones(len(out[0]), np.int64)]


class Range(InputPartition):
    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


class _Reader:
    """What the batch and the stream reader share."""

    def __init__(self, options):
        self.path = options["path"]
        self.split = int(options.get("splitBytes", SPLIT))
        source = Bytes(self.path)
        self.head = read_head(source, self.path)
        self.size, self.gzipped, self.files = source.size, source.gzipped, source.files

    def ranges(self, start: int, end: int) -> list[Range]:
        return [Range(at, min(at + self.split, end)) for at in range(start, end, self.split)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        h = self.head
        kind = pa.float64() if h.field == "real" else pa.int64()
        for at, lines in Bytes(self.path, self.files).blocks(partition.start, partition.end):
            if self.gzipped and at < h.body:  # the head stands in front of the first lines
                lines = lines[h.body - at :]
            try:
                row, col, value = parse(lines, h.field)
            except ValueError as wrong:
                raise ValueError(f"{self.path}, bytes {at} to {at + len(lines)}: {wrong}") from None
            if not len(row):
                continue
            if row.min() < 1 or col.min() < 1 or row.max() > h.rows or col.max() > h.cols:
                raise ValueError(f"{self.path}, bytes {at} to {at + len(lines)}: indices from {row.min()}, {col.min()} to {row.max()}, {col.max()}; the file declares {h.rows} rows, {h.cols} columns")
            if h.symmetry != "general":
                off = row != col
                row, col, value = np.concatenate([row, col[off]]), np.concatenate([col, row[off]]), np.concatenate([value, value[off] * (-1 if h.symmetry[:4] == "skew" else 1)])
            yield pa.RecordBatch.from_arrays([pa.array(row - 1), pa.array(col - 1), pa.array(value, kind)], ["row", "col", "value"])


class _Batch(_Reader, DataSourceReader):
    def partitions(self) -> list[Range]:
        return [Range(0, 1)] if self.gzipped else self.ranges(self.head.body, self.size) or [Range(self.size, self.size)]


class _Stream(_Reader, DataSourceStreamReader):
    def __init__(self, options):
        super().__init__(options)
        if self.gzipped:
            raise ValueError(f"{self.path}: a gzipped file cannot be resumed within; unpack it first")
        self.most, self.progress = int(options.get("maxBytesPerTrigger", 0)), options.get("progress", "")
        if self.most and not self.progress:
            raise ValueError("maxBytesPerTrigger needs a folder progress beside the checkpoint")
        self.at = self.head.body
        if self.progress:
            store, at = self._noted()
            from pyarrow import fs

            if store.get_file_info(at).type == fs.FileType.File:
                with store.open_input_stream(at) as f:
                    self.at = json.loads(f.read())["byte"]

    def _noted(self):
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(self.progress) if "://" in self.progress else (fs.LocalFileSystem(), self.progress)
        return store, f"{at}/planned.json"

    def initialOffset(self) -> dict:
        return {"byte": self.head.body}

    def latestOffset(self) -> dict:
        self.at = min(self.size, self.at + self.most) if self.most else self.size
        return {"byte": self.at}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        if self.progress and end["byte"] > start["byte"]:
            store, at = self._noted()
            store.create_dir(at.rpartition("/")[0], recursive=True)
            with store.open_output_stream(at) as f:
                f.write(json.dumps(end).encode())
        return self.ranges(start["byte"], end["byte"])


class MatrixMarketSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        path = self.options["path"]
        kind = "double" if read_head(Bytes(path), path).field == "real" else "long"
        return f"row long, col long, value {kind}"

    def reader(self, schema) -> _Batch:
        return _Batch(self.options)

    def streamReader(self, schema) -> _Stream:
        return _Stream(self.options)


@dataclass
class Matrix:
    """A matrix to be scanned: its head, its triplets, and what the first scan of them will have counted."""

    path: str
    head: Head
    entries: DataFrame
    seen: Observation

    def check(self) -> int:
        """The number of triplets in the file, as counted by the scan that has run; ValueError if another was declared."""
        n = self.seen.get["stored"]
        if n != self.head.entries:
            raise ValueError(f"{self.path}: {n} triplets, the file declares {self.head.entries}")
        return n


def open_matrix(spark: SparkSession, path: str, rows: int | None = None, cols: int | None = None, split: int = SPLIT) -> Matrix:
    """rows, cols: how many feature and barcode names there are; ValueError if the file declares others."""
    head = read_head(Bytes(path), path)
    for name, given, declared in (("rows", rows, head.rows), ("columns", cols, head.cols)):
        if given is not None and given != declared:
            raise ValueError(f"{path}: {declared} {name}, but {given} names for them")
    spark.dataSource.register(MatrixMarketSource)
    seen = Observation()
    entries = spark.read.format(FORMAT).option("splitBytes", split).load(path)
    stored = F.count(F.lit(1)) if head.symmetry == "general" else F.count_if(F.col("row") >= F.col("col")) if head.rows == head.cols else F.count(F.lit(1))
    return Matrix(path, head, entries.observe(seen, stored.alias("stored")), seen)


def matrix_stream(spark: SparkSession, path: str, progress: str, max_bytes: int, split: int = SPLIT) -> DataFrame:
    """The triplets as a stream of micro-batches of about max_bytes; progress: a folder kept beside the checkpoint."""
    spark.dataSource.register(MatrixMarketSource)
    options = {"splitBytes": split, "maxBytesPerTrigger": max_bytes, "progress": progress}
    return spark.readStream.format(FORMAT).options(**options).load(path)


def write_matrix(entries: DataFrame, path: str, rows: int, cols: int) -> None:
    """(row, col, value) from 0 as a folder of text files, the banner and the dimensions in one of their own."""
    spark = entries.sparkSession
    real = dict(entries.dtypes)["value"] in ("double", "float") or dict(entries.dtypes)["value"].startswith("decimal")
    seen = Observation()
    lines = entries.observe(seen, F.count(F.lit(1)).alias("n")).select(F.concat_ws(" ", F.col("row") + 1, F.col("col") + 1, F.col("value")).alias("value"))
    lines.write.text(path)
    head = f"%%MatrixMarket matrix coordinate {'real' if real else 'integer'} general\n{rows} {cols} {seen.get['n']}"
    spark.createDataFrame([(head,)], "value string").coalesce(1).write.mode("append").text(path)
