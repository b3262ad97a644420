"""PLY files as a Spark data source, and PLY export.

Reading: ``spark.read.format("ply").load(path)`` after ``register(spark)``. The driver only lists files and
their sizes; every task reads the short header itself and decodes its own range of fixed-size records.
"""

from __future__ import annotations

import json
import posixpath
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote_plus

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from pointlake.functions.geometry import NORMAL, XYZ
from pointlake.operators.tiles import ranked
from pointlake.session import cut

SPLIT_BYTES = 128 * 1024 * 1024
BATCH_ROWS = 65_536
ROWS_PER_FILE = 1_000_000
#: Ending of the folder that holds the parts of one exported cloud.
CLOUD_FOLDER = ".cloud"
SCHEMA = (
    "cloud_id string, path string, point_id long, x double, y double, z double, "
    "nx double, ny double, nz double, r int, g int, b int"
)
COLUMNS = {"x": "x", "y": "y", "z": "z", "nx": "nx", "ny": "ny", "nz": "nz", "r": "red", "g": "green", "b": "blue"}

# The scalar type names of the format and their sizes.
SCALARS = {
    "char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2",
    "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4",
    "double": "f8", "float64": "f8",
}


@dataclass
class Header:
    encoding: str
    rows: int
    dtype: np.dtype
    start: int  # byte of the first vertex record (binary) or of the first body line (ascii)
    skip_lines: int  # ascii body lines before the vertices
    first_row: int  # number of the first vertex within its cloud, for a part of a cloud


def read_header(handle) -> Header:
    """Parse the header from the start of a seekable file."""
    handle.seek(0)
    text = b""
    while b"end_header" not in text or b"\n" not in text[text.index(b"end_header") :]:
        more = handle.read(4096)
        if not more:
            raise ValueError("PLY header does not end")
        text += more
    end = text.index(b"\n", text.index(b"end_header")) + 1
    lines = [ln.split() for ln in text[:end].decode("ascii", "replace").splitlines()]
    if not lines or lines[0] != ["ply"]:
        raise ValueError("not a PLY file")
    encoding, elements, first_row = None, [], 0
    for words in lines:
        if words[:1] == ["format"]:
            encoding = words[1]
        elif words[:2] == ["comment", "first_row"]:
            first_row = int(words[2])
        elif words[:1] == ["element"]:
            elements.append((words[1], int(words[2]), []))
        elif words[:1] == ["property"]:
            elements[-1][2].append(words[1:])
    order = {"binary_little_endian": "<", "binary_big_endian": ">", "ascii": "<"}
    if encoding not in order:
        raise ValueError(f"unknown PLY encoding {encoding}")
    start, skip = end, 0
    for name, count, props in elements:
        if any(p[0] == "list" for p in props) and (name == "vertex" or encoding != "ascii"):
            raise ValueError("list properties before or inside the vertex element are not supported")
        if name == "vertex":
            dtype = np.dtype([(p[1], order[encoding] + SCALARS[p[0]]) for p in props])
            return Header(encoding, count, dtype, start, skip, first_row)
        skip += count
        if encoding != "ascii":
            start += count * np.dtype([(p[1], SCALARS[p[0]]) for p in props]).itemsize
    raise ValueError("PLY file without vertices")


def _binary_rows(handle, head: Header, begin: int, end: int) -> Iterator[tuple[int, np.ndarray]]:
    """Records that start inside the byte range [begin, end)."""
    width = head.dtype.itemsize
    first = max(0, -(-(begin - head.start) // width))
    last = min(head.rows, max(0, -(-(end - head.start) // width)))
    for row in range(first, last, BATCH_ROWS):
        n = min(BATCH_ROWS, last - row)
        handle.seek(head.start + row * width)
        data = handle.read(n * width)
        if len(data) < n * width:
            raise ValueError("PLY file is shorter than its header says")
        yield row, np.frombuffer(data, dtype=head.dtype)


def _ascii_rows(handle, head: Header) -> Iterator[tuple[int, np.ndarray]]:
    handle.seek(head.start)
    rest, row, skip = b"", 0, head.skip_lines
    while row < head.rows:
        data = handle.read(1 << 22)
        lines = (rest + data).split(b"\n")
        rest = lines.pop() if data else b""
        lines = [ln for ln in lines if ln.strip()]
        dropped = min(skip, len(lines))
        skip -= dropped
        lines = lines[dropped:][: head.rows - row]
        if lines:
            yield row, _ascii_block(lines, head.dtype)
            row += len(lines)
        if not data and row < head.rows:
            raise ValueError("PLY file is shorter than its header says")


def _lines_from(handle, start: int, begin: int, end: int) -> Iterator[list[bytes]]:
    """Lines that are not blank and begin inside the byte range [begin, end), of a body that begins at ``start``."""
    at = max(begin, start)
    if at > start:  # a line begins here only if the one before ends here
        handle.seek(at - 1)
        while (byte := handle.read(1 << 16)) and b"\n" not in byte:
            at += len(byte)
        if not byte:
            return
        at += byte.index(b"\n")
    handle.seek(at)
    rest = b""
    while at < end:
        data = handle.read(1 << 22)
        parts = (rest + data).split(b"\n")
        rest = parts.pop() if data else b""
        if parts:
            sizes = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
            starts = at + np.cumsum(sizes) - sizes
            found = [ln for ln, s in zip(parts, starts.tolist()) if s < end and ln.strip()]
            if found:
                yield found
            at = int(starts[-1] + sizes[-1])
        if not data:
            return


def _ascii_block(lines: list[bytes], dtype: np.dtype) -> np.ndarray:
    block = np.array([ln.split()[: len(dtype)] for ln in lines], dtype=object)
    out = np.empty(len(lines), dtype=dtype)
    for i, name in enumerate(dtype.names):
        out[name] = block[:, i].astype("f8").astype(dtype[name])
    return out


def _ascii_range(handle, head: Header, begin: int, end: int, before: int, total: int) -> Iterator[tuple[int, np.ndarray]]:
    """Vertices of the lines that begin in a byte range, ``before`` lines of the body being in front of it."""
    if total - head.skip_lines < head.rows:
        raise ValueError("PLY file is shorter than its header says")
    row = before - head.skip_lines
    for lines in _lines_from(handle, head.start, begin, end):
        mine = lines[max(0, -row) : max(0, head.rows - row)]
        if mine:
            yield max(row, 0), _ascii_block(mine, head.dtype)
        row += len(lines)


@dataclass
class FileRanges(InputPartition):
    pieces: list  # (path, begin, end)

    def __init__(self, pieces):
        super().__init__(None)
        self.pieces = pieces


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and the path in it."""
    root = path[5:] if path.startswith("file:") else path
    return pafs.FileSystem.from_uri(root) if "://" in root else (pafs.LocalFileSystem(), root)


class PlyReader(DataSourceReader):
    def __init__(self, options: dict):
        options = {k.lower(): v for k, v in options.items()}
        self.root = options["path"]
        self.split = int(options.get("splitbytes", SPLIT_BYTES))
        self.columns = [c for c in options.get("columns", ",".join(COLUMNS)).replace(" ", "").split(",") if c]
        self.normals_required = str(options.get("requirenormals", "false")).lower() == "true"
        self.skip_broken = str(options.get("skipbroken", "false")).lower() == "true"
        # Of text files in several ranges: lines before each range and in all, by path and first byte.
        self.lines = json.loads(options.get("lines", "{}"))

    def _filesystem(self):
        return _store(self.root)

    def files(self) -> list[tuple[str, int]]:
        """(path, size) of all files."""
        store, root = self._filesystem()
        info = store.get_file_info(root)
        found = [info] if info.is_file else store.get_file_info(pafs.FileSelector(root, recursive=True))
        return sorted((f.path, f.size) for f in found if f.is_file and f.path.lower().endswith(".ply"))

    def partitions(self):
        out, bundle, weight = [], [], 0
        for path, size in self.files():
            for begin in range(0, max(size, 1), self.split):
                piece = (path, begin, min(size, begin + self.split))
                if bundle and weight + piece[2] - begin > self.split:
                    out.append(FileRanges(bundle))
                    bundle, weight = [], 0
                bundle.append(piece)
                weight += piece[2] - begin
        return out + [FileRanges(bundle)] if bundle else out

    def read(self, partition):
        store, _ = self._filesystem()
        for path, begin, end in partition.pieces:
            try:
                if self.skip_broken:
                    self._check(store, path)
            except BROKEN:
                continue
            yield from self._blocks(store, path, begin, end)

    def _blocks(self, store, path: str, begin: int, end: int) -> Iterator[pa.RecordBatch]:
        with store.open_input_file(path) as handle:
            head = read_header(handle)
            if self.normals_required and "nx" not in head.dtype.names:
                raise ValueError(f"{path} has no normals")
            if head.encoding == "ascii" and path in self.lines:
                before, total = self.lines[path][str(begin)], self.lines[path]["total"]
                rows = _ascii_range(handle, head, begin, end, before, total)
            elif head.encoding == "ascii":
                rows = _ascii_rows(handle, head) if begin == 0 else ()
            else:
                rows = _binary_rows(handle, head, begin, end)
            for first, block in rows:
                yield self._batch(path, head.first_row + first, block)

    def _check(self, store, path: str) -> int:
        """Rows of a file that can be read as a whole; raises what reading would raise. Binary rows are not decoded."""
        with store.open_input_file(path) as handle:
            head = read_header(handle)
            if self.normals_required and "nx" not in head.dtype.names:
                raise ValueError(f"{path} has no normals")
            if head.encoding == "ascii":
                return sum(len(block) for _, block in _ascii_rows(handle, head))
            if handle.size() < head.start + head.rows * head.dtype.itemsize:
                raise ValueError("PLY file is shorter than its header says")
            return head.rows

    def cloud_of(self, path: str) -> str:
        """The path below the root without its ending; for a part of an exported cloud, that cloud's id."""
        _, root = self._filesystem()
        below = path[len(root) :].strip("/") if path.startswith(root) and path != root else path.rsplit("/", 1)[-1]
        folder = below.rpartition("/")[0] or root.rstrip("/").rsplit("/", 1)[-1]
        if folder.endswith(CLOUD_FOLDER):
            return unquote_plus(folder.rsplit("/", 1)[-1][: -len(CLOUD_FOLDER)])
        return below[: -len(".ply")]

    def _batch(self, path: str, first: int, block: np.ndarray) -> pa.RecordBatch:
        n = len(block)
        arrays = [pa.array([self.cloud_of(path)] * n), pa.array([path] * n), pa.array(np.arange(first, first + n))]
        for name, prop in COLUMNS.items():
            kind = pa.int32() if name in "rgb" else pa.float64()
            known = prop in block.dtype.names and name in self.columns
            arrays.append(pa.array(block[prop].astype(kind.to_pandas_dtype())) if known else pa.nulls(n, kind))
        return pa.RecordBatch.from_arrays(arrays, names=["cloud_id", "path", "point_id", *COLUMNS])


#: What a file that is no sound PLY file raises while it is read.
BROKEN = (ValueError, KeyError, IndexError, TypeError, OverflowError)


class PlyLinesReader(PlyReader):
    """Lines of each byte range of the text files that have several."""

    def partitions(self):
        large = {path for path, size in self.files() if size > self.split}
        out = [[piece for piece in part.pieces if piece[0] in large] for part in super().partitions()]
        return [FileRanges(pieces) for pieces in out if pieces]

    def read(self, partition):
        store, _ = self._filesystem()
        for path, begin, end in partition.pieces:
            try:
                with store.open_input_file(path) as handle:
                    head = read_header(handle)
                    if head.encoding == "ascii":
                        yield path, begin, sum(map(len, _lines_from(handle, head.start, begin, end)))
            except BROKEN:  # reading the file says what is wrong
                continue


class PlyStatusReader(PlyReader):
    """One row per file, whether it can be read or not."""

    def read(self, partition):
        store, _ = self._filesystem()
        for path, begin, _ in partition.pieces:
            if begin == 0:
                rows, error = None, None
                try:
                    rows = self._check(store, path)
                except BROKEN as problem:
                    error = f"{type(problem).__name__}: {problem}"
                yield self.cloud_of(path), path, rows, error


class PlyLinesSource(DataSource):
    """Lines of the ranges of large text files below ``path``."""

    @classmethod
    def name(cls):
        return "ply_lines"

    def schema(self):
        return "path string, begin long, lines long"

    def reader(self, schema):
        return PlyLinesReader(dict(self.options))


class PlyStatusSource(DataSource):
    """Files below ``path`` with their rows, or the error that reading them raises."""

    @classmethod
    def name(cls):
        return "ply_status"

    def schema(self):
        return "cloud_id string, path string, rows long, error string"

    def reader(self, schema):
        return PlyStatusReader(dict(self.options))


class PlyDataSource(DataSource):
    """Options: path, splitBytes, columns (only these are decoded), requireNormals, skipBroken.

    A cloud is named by the path of its file below the root, so equal file names in two folders are two clouds.
    """

    @classmethod
    def name(cls):
        return "ply"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return PlyReader(dict(self.options))

    def writer(self, schema, overwrite):
        return PlyWriter(dict(self.options))


@dataclass
class PlyFiles(WriterCommitMessage):
    """Files that a task has written: (draft, name)."""

    files: list


class PlyWriter(DataSourceArrowWriter):
    """Writes rows in runs of one ``_file``, each a complete file. Options: path, binary, normals, colours.

    Tasks write drafts into a folder of the job's own. Only the commit of the whole job gives the drafts of the successful
    attempts their names and removes that folder; so attempts that die or are repeated leave neither files nor copies.
    """

    def __init__(self, options: dict):
        options = {k.lower(): v for k, v in options.items()}
        self.binary, self.normals, self.colours = (str(options.get(k, "false")).lower() == "true" for k in ("binary", "normals", "colours"))
        self.columns = [*XYZ, *(NORMAL if self.normals else ()), *("rgb" if self.colours else "")]
        self.root = options["path"]
        self.drafts = f"_drafts-{uuid.uuid4().hex}"

    def _body(self, rows: pa.Table) -> bytes:
        if not self.binary:
            return ("\n".join(rows.column("line").to_pylist()) + "\n").encode("ascii")
        body = np.empty(len(rows), np.dtype([(c, "u1" if c in "rgb" else "<f8") for c in self.columns]))
        for c in self.columns:
            body[c] = rows.column(c).to_numpy()
        return body.tobytes()

    def write(self, iterator):
        store, base = _store(self.root)
        folder, done, held = f"{base}/{self.drafts}", [], []

        def flush():
            if not held:
                return
            rows = pa.Table.from_batches(held)
            held.clear()
            head = header_text(len(rows), self.binary, self.normals, self.colours, rows.column("_rn")[0].as_py() - 1).encode("ascii")
            draft = f"{folder}/{uuid.uuid4().hex}.tmp"
            store.create_dir(folder, recursive=True)
            with store.open_output_stream(draft) as out:
                out.write(head + self._body(rows))
            done.append((draft, f"{base}/{rows.column('_file')[0].as_py()}.ply"))

        for batch in iterator:
            name = batch.column("_file").to_pylist()
            starts = [i for i in range(len(name)) if i == 0 or name[i] != name[i - 1]]
            for s, e in zip(starts, [*starts[1:], len(name)]):
                if held and held[0].column("_file")[0].as_py() != name[s]:
                    flush()
                held.append(batch.slice(s, e - s))
        flush()
        return PlyFiles(done)

    def commit(self, messages):
        store, base = _store(self.root)
        for message in messages:
            for draft, name in message.files if message else ():
                store.create_dir(name.rpartition("/")[0], recursive=True)
                store.move(draft, name)
        self.abort(messages)

    def abort(self, messages):
        store, base = _store(self.root)
        if store.get_file_info(f"{base}/{self.drafts}").type != pafs.FileType.NotFound:
            store.delete_dir(f"{base}/{self.drafts}")


def register(spark: SparkSession) -> None:
    for source in (PlyDataSource, PlyStatusSource, PlyLinesSource):
        spark.dataSource.register(source)


def _full(spark: SparkSession, path: str) -> str:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(jvm_path).toString()


def qualified(spark: SparkSession, path: str) -> str:
    """The path as Spark resolves it, with its file system.

    A path in the file system of the machine is for a local master, or lies in the folder of ``spark.checkpoint.dir``, which
    all executors share.
    """
    sc, full = spark.sparkContext, _full(spark, path)
    if full.startswith("file:"):
        shared = [_full(spark, root) for root in (sc.getCheckpointDir(), spark.conf.get("spark.checkpoint.dir", None)) if root]
        inside = any(posixpath.normpath(full).startswith(f"{posixpath.normpath(root)}/") for root in shared)
        if not sc.master.startswith("local") and not inside:
            raise ValueError(f"{full} is a local path outside spark.checkpoint.dir; executors of a cluster would each see their own")
        return "/" + full[5:].lstrip("/")
    return full


def ply_status(spark: SparkSession, path: str, require_normals: bool = False) -> DataFrame:
    """(cloud_id, path, rows, error) of every file; an unreadable file is a row with its error, not the end of the job."""
    register(spark)
    return spark.read.format("ply_status").option("requireNormals", str(require_normals).lower()).load(qualified(spark, path))


def read_ply(spark: SparkSession, path: str, columns: list[str] | None = None, require_normals: bool = False,
             skip_broken: bool = False, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Points of all files below ``path``. ``skip_broken`` leaves out what ``ply_status`` reports with an error.

    Files larger than ``split_bytes`` are read by several tasks. For text files, tasks count the lines of the ranges first,
    so that every task knows the number of its first point.
    """
    register(spark)
    reader = spark.read.format("ply").option("requireNormals", str(require_normals).lower())
    reader = reader.option("skipBroken", str(skip_broken).lower()).option("splitBytes", split_bytes)
    if columns:
        reader = reader.option("columns", ",".join(columns))
    full = qualified(spark, path)
    if any(size > split_bytes for _, size in PlyReader({"path": full}).files()):
        reader = reader.option("lines", json.dumps(line_places(spark, full, split_bytes)))
    return reader.load(full)


def line_places(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> dict:
    """Lines before each range of the large text files, by path and first byte: one number per range of a file."""
    register(spark)
    out: dict = {}
    counts = spark.read.format("ply_lines").option("splitBytes", split_bytes).load(path)
    for file, begin, lines in sorted(tuple(r) for r in counts.collect()):
        places = out.setdefault(file, {"total": 0})
        places[str(begin)] = places["total"]
        places["total"] += lines
    return out


def read_points(spark: SparkSession, table_path: str | None, ply_path: str | None) -> DataFrame:
    """The preprocessed Parquet table when it exists, else the raw files."""
    if table_path is not None:
        jvm_path = spark._jvm.org.apache.hadoop.fs.Path(table_path)
        if jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path):
            return spark.read.parquet(table_path)
    if ply_path is None:
        raise FileNotFoundError(f"neither a table at {table_path} nor raw files")
    return read_ply(spark, ply_path)


def ascii_lines(df: DataFrame, normals: bool = False, colours: bool = False) -> DataFrame:
    """The vertex line of every point: six decimals, colours as integers."""
    cols, spec = [F.col(c) for c in XYZ], ["%.6f"] * 3
    if normals:
        cols, spec = cols + [F.col(c) for c in NORMAL], spec + ["%.6f"] * 3
    if colours:
        cols, spec = cols + [F.col(c).cast("int") for c in "rgb"], spec + ["%d"] * 3
    return df.withColumn("line", F.format_string(" ".join(spec), *cols))


def header_text(rows: int, binary: bool, normals: bool, colours: bool, first_row: int = 0) -> str:
    kind = "double" if binary else "float"
    names = [*XYZ, *(NORMAL if normals else ())]
    lines = ["ply", f"format {'binary_little_endian' if binary else 'ascii'} 1.0", f"comment first_row {first_row}", f"element vertex {rows}"]
    lines += [f"property {kind} {n}" for n in names]
    lines += [f"property uchar {n}" for n in ("red", "green", "blue")] if colours else []
    return "\n".join(lines + ["end_header", ""])


def write_ply(points: DataFrame, folder: str, binary: bool = False, normals: bool = False, colours: bool = False,
              rows_per_file: int = ROWS_PER_FILE) -> DataFrame:
    """Write every cloud in point order and return the manifest (cloud_id, part, path, rows).

    A cloud of any size is one folder ``<cloud>.cloud`` of complete files ``part-<n>.ply`` with up to ``rows_per_file``
    points each; the name is percent-encoded, so no two clouds meet, and reading the folder gives one cloud. Files appear
    when the whole job has succeeded, those of failed or repeated attempts never.
    """
    folder = qualified(points.sparkSession, folder)
    cols = [*XYZ, *(NORMAL if normals else ()), *("rgb" if colours else "")]
    df = points.select("cloud_id", "point_id", *cols)
    df = ranked(df, ["cloud_id"], ["point_id"], ["point_id"], "_rn")
    df = df.withColumn("part", F.floor((F.col("_rn") - 1) / F.lit(rows_per_file)))
    name = F.regexp_replace(F.url_encode(F.col("cloud_id").cast("string")), r"\.", "%2E")
    part = F.lpad(F.col("part").cast("string"), 8, "0")
    df = df.withColumn("_file", F.concat(name, F.lit(f"{CLOUD_FOLDER}/part-"), part))
    if not binary:
        df = ascii_lines(df, normals, colours)
    keep = cols if binary else ["line"]
    parts = cut(df.groupBy("cloud_id", "part", "_file").agg(F.count(F.lit(1)).alias("rows")))
    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select("cloud_id", "part", "_file", "_rn", *keep).repartition(tasks, "cloud_id", "part").sortWithinPartitions("cloud_id", "part", "_rn")
    register(points.sparkSession)
    writer = rows.drop("cloud_id", "part").write.format("ply").mode("append").option("binary", str(binary).lower())
    writer.option("normals", str(normals).lower()).option("colours", str(colours).lower()).save(folder)
    base = _store(folder)[1]
    return parts.select("cloud_id", "part", F.concat(F.lit(f"{base}/"), "_file", F.lit(".ply")).alias("path"), "rows")


COPY_BYTES = 1 << 22


def _join_files(pdf: pd.DataFrame) -> pd.DataFrame:
    """One file out of the parts of a cloud, copied block by block."""
    target, parts = pdf["target"].iloc[0], pdf.sort_values("part")
    store, name = _store(target)
    folder, file = name.rsplit("/", 1)
    draft = f"{folder}/_{file}-{uuid.uuid4().hex}.tmp"
    store.create_dir(folder, recursive=True)
    try:
        with store.open_output_stream(draft) as out:
            for i, path in enumerate(parts["path"]):
                with store.open_input_file(path) as handle:
                    start = read_header(handle).start
                    handle.seek(0)
                    head = handle.read(start)
                    if i == 0:
                        out.write(re.sub(rb"element vertex \d+", b"element vertex %d" % parts["rows"].sum(), head, count=1))
                    while block := handle.read(COPY_BYTES):
                        out.write(block)
        store.move(draft, name)
    except BaseException:
        if store.get_file_info(draft).type != pafs.FileType.NotFound:
            store.delete_file(draft)
        raise
    return pd.DataFrame({"path": [name], "rows": [parts["rows"].sum()]})


def join_parts(manifest: DataFrame, folder: str) -> DataFrame:
    """Put the parts of every exported cloud together to one plain file below ``folder`` and return (path, rows).

    ``manifest`` is what ``write_ply`` returns, with the name of each cloud's file as ``file``; the parts lie in the same
    store and stay there. A file is written by one task, since it has one end to append to; the task holds a block of it.
    """
    root = qualified(manifest.sparkSession, folder)
    rows = manifest.select(F.concat(F.lit(f"{root}/"), "file").alias("target"), "part", "path", "rows")
    return cut(rows.groupBy("target").applyInPandas(_join_files, "path string, rows long"))
