"""NPZ archives of arrays as a Spark source and sink.

``register(spark)``, then ``spark.read.format("arrays").option("arrays", "x,y").load(path)`` gives one
row for each position of the named arrays, which must be of one length: `row` (long), then a
column for each array: a scalar for one dimension, an array for two. A name may have alternatives,
``id:node_ids|ids``: the first that an archive has is read, under the name before the colon. The driver
reads headers only. A partition is a range of rows of one file of about `partitionBytes`, and a
task seeks to its range in each named array and reads no other. Only in compressed archives it has to decompress what
stands before its range, so those are cut into `compressedParts` partitions at most.

path is a file, a folder (all .npz in and below it; hidden names and those that begin with _ are
left out), or a URI that Arrow's file systems open. Without an archive, with arrays of different lengths or more than two
dimensions, with pickled objects or Fortran order an error is raised.

``df.write.format("arrays").mode(...).save(path)`` writes each column as an array: numbers and booleans without nulls, strings, and
lists of numbers of one length. Each task writes archives of up to `rowsPerFile` rows, uncompressed unless the
option `compressed` is true, into a folder of its own job below ``_temporary``; the driver moves
those of the tasks that succeeded into place and then writes _SUCCESS. A task that fails or runs twice leaves nothing in place.
"""

from __future__ import annotations

import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ledgerloom.contract import GraphFrame, GraphSchema, validate

FORMAT = "arrays"
TEMPORARY, SUCCESS = "_temporary", "_SUCCESS"
#: Spark's type of an array's elements, by numpy's kind and bytes; unsigned numbers go to the next larger type.
TYPES = {"b1": "boolean", "i1": "byte", "i2": "short", "i4": "int", "i8": "long", "u1": "short", "u2": "int", "u4": "long", "u8": "decimal(20,0)", "f2": "float", "f4": "float", "f8": "double"}

# The names under which prediction archives may hold ids, labels and scores, the usual one first.
PREDICTIONS = {
    "node_id": ("node_ids", "ids"),
    "y_true": ("y_true", "labels"),
    "probability": ("probability", "probabilities", "score", "scores", "avg_probability", "avg_probabilities", "avg_score", "avg_scores"),
}


def file_system(path: str):
    """(Arrow file system, path in it) of a local path or a URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def archives(path: str) -> list[str]:
    """The archives of a path, in order of name."""
    from pyarrow import fs

    system, at = file_system(path)
    if system.get_file_info(at).type == fs.FileType.File:
        return [at]
    found = system.get_file_info(fs.FileSelector(at, recursive=True, allow_not_found=True))
    hidden = lambda p: any(x[:1] in ("_", ".") for x in p[len(at) :].split("/"))
    return sorted(x.path for x in found if x.type == fs.FileType.File and x.path.endswith(".npz") and not hidden(x.path))


def locate(root: str, name: str) -> str:
    """The path of the one file of this name in or below a folder; an error if there is none or several."""
    from pyarrow import fs

    system, at = file_system(root)
    found = sorted(x.path for x in system.get_file_info(fs.FileSelector(at, recursive=True, allow_not_found=True)) if x.type == fs.FileType.File and x.base_name == name)
    if not found:
        raise FileNotFoundError(f"no {name} in or below {root}")
    if len(found) > 1:
        raise ValueError(f"several {name} below {root}: {found}")
    return found[0] if "://" not in root else f"{root.split('://')[0]}://{found[0]}"


@dataclass(frozen=True)
class Header:
    """An array of an archive: its shape, type, where its values begin in the member, and whether that is compressed."""

    shape: tuple[int, ...]
    dtype: np.dtype
    start: int
    compressed: bool


def header(archive: zipfile.ZipFile, name: str) -> Header:
    member = f"{name}.npy"
    with archive.open(member) as f:
        version = np.lib.format.read_magic(f)
        read = {(1, 0): np.lib.format.read_array_header_1_0, (2, 0): np.lib.format.read_array_header_2_0}.get(version)
        if read is None:
            raise ValueError(f"{name}: version {version} of the array format isn't known")
        shape, fortran, dtype = read(f)
        if dtype.hasobject or fortran and len(shape) > 1 or len(shape) > 2:
            raise ValueError(f"{name}: only plain values in C order, of one or two dimensions, can be read")
        return Header(shape or (1,), dtype, f.tell(), archive.getinfo(member).compress_type != zipfile.ZIP_STORED)


def wanted(option: str) -> dict[str, tuple[str, ...]]:
    """The column's name and its arrays' names, first choice first, of the option `arrays`."""
    out = {}
    for part in filter(None, (x.strip() for x in option.split(","))):
        name, _, rest = part.partition(":")
        out[name] = tuple((rest or name).split("|"))
    if not out:
        raise ValueError("the option `arrays` names no array")
    return out


def chosen(archive: zipfile.ZipFile, names: dict[str, tuple[str, ...]], path: str) -> dict[str, str]:
    have = {x.removesuffix(".npy") for x in archive.namelist()}
    found = {column: next((n for n in choice if n in have), None) for column, choice in names.items()}
    if absent := [c for c, n in found.items() if n is None]:
        raise ValueError(f"{path} has no array for {absent}; it has {sorted(have)}")
    return found


def spark_type(h: Header, flat: bool) -> str:
    kind = "string" if h.dtype.kind == "U" else TYPES.get(f"{h.dtype.kind}{h.dtype.itemsize}")
    if kind is None:
        raise ValueError(f"values of type {h.dtype} can't be read")
    return f"array<{kind}>" if len(h.shape) > 1 and not (flat and h.shape[1] == 1) else kind


@dataclass
class Rows(InputPartition):
    path: str
    start: int
    end: int


class ArraysReader(DataSourceReader):
    def __init__(self, options: dict, schema):
        self.options, self.schema = options, schema
        self.names = wanted(options.get("arrays", ""))
        self.size, self.parts = int(options.get("partitionbytes", 128 << 20)), int(options.get("compressedparts", 4))

    def partitions(self) -> list[Rows]:
        out, (system, _) = [], file_system(self.options["path"])
        for path in archives(self.options["path"]):
            with system.open_input_file(path) as f, zipfile.ZipFile(f) as archive:
                found = [header(archive, n) for n in chosen(archive, self.names, path).values()]
            if len({h.shape[0] for h in found}) > 1:
                raise ValueError(f"{path}: the arrays {list(self.names)} aren't of one length: {[h.shape for h in found]}")
            n, width = found[0].shape[0], sum(h.dtype.itemsize * int(np.prod(h.shape[1:], dtype=np.int64)) for h in found)
            parts = max(1, min(n, -(-n * width // self.size)))
            parts = min(parts, self.parts) if any(h.compressed for h in found) else parts
            cuts = [n * i // parts for i in range(parts + 1)]
            out += [Rows(path, a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if a < b]
        return out or [Rows("", 0, 0)]

    def read(self, part: Rows) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        if not part.path:
            return
        target, (system, _) = to_arrow_schema(self.schema), file_system(self.options["path"])
        with system.open_input_file(part.path) as f, zipfile.ZipFile(f) as archive:
            names = chosen(archive, self.names, part.path)
            heads = {c: header(archive, n) for c, n in names.items()}
            data = {c: self._reader(f, archive, names[c], h, part.start) for c, h in heads.items()}
            step = max(1, (4 << 20) // sum(map(self._width, heads.values())))
            for at in range(part.start, part.end, step):
                n = min(step, part.end - at)
                values = {c: self._values(data[c](n * self._width(h)), n, h) for c, h in heads.items()}
                columns = [pa.array(np.arange(at, at + n)) if x.name == "row" else values[x.name].cast(x.type) for x in target]
                yield pa.RecordBatch.from_arrays(columns, schema=target)

    def _reader(self, f, archive: zipfile.ZipFile, name: str, h: Header, row: int):
        """What reads the next bytes of an array from a row on: by position where it is stored as it is, else through what stands before."""
        skip = h.start + row * self._width(h)
        if h.compressed:
            member = archive.open(f"{name}.npy")
            while skip:
                skip -= len(member.read(min(skip, 1 << 20)))
            return member.read
        local = archive.getinfo(f"{name}.npy").header_offset
        names, more = np.frombuffer(f.read_at(4, local + 26), "<u2").tolist()  # of the member's own header: 30 bytes, its name, extra fields
        at = local + 30 + names + more + skip

        def next_(n: int) -> bytes:
            nonlocal at
            at += n
            return f.read_at(n, at - n)

        return next_

    @staticmethod
    def _width(h: Header) -> int:
        return h.dtype.itemsize * int(np.prod(h.shape[1:], dtype=np.int64))

    def _values(self, data: bytes, n: int, h: Header) -> pa.Array:
        flat = np.frombuffer(data, h.dtype)
        flat = flat.astype(h.dtype.newbyteorder("="), copy=False)
        values = pa.array(flat.tolist() if h.dtype.kind == "U" else flat)
        if spark_type(h, self.options.get("flat", "true") == "true").startswith("array"):
            return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * h.shape[1]), values)
        return values


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class ArraysWriter(DataSourceArrowWriter):
    """Archives of a bounded number of rows; the job's folder is drawn on the driver, the files' names in the tasks."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.rows, self.compressed = int(options.get("rowsperfile", 1 << 20)), options.get("compressed", "false") == "true"
        self.job = uuid.uuid4().hex

    def _folder(self) -> str:
        return f"{file_system(self.path)[1].rstrip('/')}/{TEMPORARY}/{self.job}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        system, _ = file_system(self.path)
        files, held, n = [], [], 0
        name = uuid.uuid4().hex  # a second attempt writes other files
        system.create_dir(self._folder(), recursive=True)

        def put() -> None:
            table = pa.Table.from_batches(held)
            files.append(f"part-{name}-{len(files):05d}.npz")
            with system.open_output_stream(f"{self._folder()}/{files[-1]}") as out:
                with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED if self.compressed else zipfile.ZIP_STORED) as archive:
                    for c in table.column_names:
                        with archive.open(f"{c}.npy", "w", force_zip64=True) as f:
                            np.lib.format.write_array(f, plain(c, table.column(c).combine_chunks()), allow_pickle=False)

        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, self.rows - n)
                held.append(part)
                n, batch = n + part.num_rows, batch.slice(part.num_rows)
                if n == self.rows:
                    put()
                    held, n = [], 0
        if n:
            put()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        system, top = file_system(self.path)
        top = top.rstrip("/")
        system.create_dir(top, recursive=True)
        old = archives(self.path) if self.overwrite else []
        for m in messages:
            for name in m.files if m else []:
                system.move(f"{self._folder()}/{name}", f"{top}/{name}")
        for path in old:
            system.delete_file(path)
        self._clear()
        with system.open_output_stream(f"{top}/{SUCCESS}"):
            pass

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        from pyarrow import fs

        system, _ = file_system(self.path)
        if system.get_file_info(self._folder()).type == fs.FileType.Directory:
            system.delete_dir(self._folder())
        above = self._folder().rsplit("/", 1)[0]
        if system.get_file_info(above).type == fs.FileType.Directory and not system.get_file_info(fs.FileSelector(above)):
            system.delete_dir(above)


def plain(name: str, column: pa.Array) -> np.ndarray:
    """A column as an array without nulls and objects."""
    if column.null_count:
        raise ValueError(f"{name}: an archive's arrays hold no nulls")
    if pa.types.is_list(column.type):
        flat, sizes = column.flatten(), set(np.diff(column.offsets.to_numpy()).tolist())
        if len(sizes) > 1 or flat.null_count:
            raise ValueError(f"{name}: lists must be of one length and without nulls")
        return flat.to_numpy(zero_copy_only=False).reshape(len(column), -1)
    out = column.to_numpy(zero_copy_only=False)
    return out.astype(str) if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else out


class Arrays(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        path, names = self.options["path"], wanted(self.options.get("arrays", ""))
        found = archives(path)
        if not found:
            raise FileNotFoundError(f"no archive in or below {path}")
        system, _ = file_system(path)
        with system.open_input_file(found[0]) as f, zipfile.ZipFile(f) as archive:
            kinds = {c: spark_type(header(archive, n), self.options.get("flat", "true") == "true") for c, n in chosen(archive, names, found[0]).items()}
        return ", ".join(["row long", *[f"`{c}` {k}" for c, k in kinds.items()]])

    def reader(self, schema) -> ArraysReader:
        return ArraysReader(dict(self.options), schema)

    def writer(self, schema, overwrite: bool) -> ArraysWriter:
        return ArraysWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Arrays)


def read(spark: SparkSession, path: str, arrays: str, **options: object) -> DataFrame:
    """row and the named arrays of an archive or a folder of them."""
    register(spark)
    return spark.read.format(FORMAT).options(**options).option("arrays", arrays).load(path)


def write(df: DataFrame, path: str, **options: object) -> None:
    """df's columns as arrays, in archives below path, which are replaced."""
    register(df.sparkSession)
    df.write.format(FORMAT).mode("overwrite").options(**options).save(path)


def read_predictions(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """(node_id, y_true, probability) of prediction archives, whichever of the known names they use."""
    names = ",".join(f"{c}:{'|'.join(choice)}" for c, choice in PREDICTIONS.items())
    found = read(spark, path, names, **options)
    return found.select(F.col("node_id").cast("long").alias("node_id"), F.col("y_true").cast("int").alias("y_true"), F.col("probability").cast("double").alias("probability"))


def write_predictions(df: DataFrame, path: str, **options: object) -> None:
    """(node_id, y_true, probability) under the usual names and types."""
    write(df.select(F.col("node_id").cast("int").alias("node_ids"), F.col("y_true").cast("byte").alias("y_true"), F.col("probability").cast("float").alias("probability")), path, **options)


def write_phase(g: GraphFrame, path: str, train: DataFrame | None = None, test: DataFrame | None = None, **options: object) -> None:
    """Validate a graph, then write its arrays as archives: x, y and the ids by node; edge_index, edge_type and edge_timestamp by edge; the two lists of ids."""
    validate(g, train, test)
    raw = F.array(*[F.col(c).cast("double") for c in g.schema.raw_columns])
    write(g.nodes.select(F.col("node_id").cast("long").alias("node_id"), raw.alias("x"), F.col("y").cast("int").alias("y")), f"{path}/nodes", **options)
    index = F.array(F.col("src").cast("long"), F.col("dst").cast("long"))
    write(g.edges.select(index.alias("edge_index"), F.col("edge_type").cast("short").alias("edge_type"), F.col("day").cast("int").alias("edge_timestamp")), f"{path}/edges", **options)
    for name, ids in (("train_mask", train), ("test_mask", test)):
        if ids is not None:
            write(ids.select(F.col("node_id").cast("long").alias(name)), f"{path}/{name}", **options)


def read_phase(spark: SparkSession, path: str, schema: GraphSchema, **options: object) -> GraphFrame:
    """A graph from what write_phase wrote, or from one .npz that holds all arrays and whose nodes are numbered by position.

    Nodes and edges are two reads, each of its own arrays, however many others the archive has.
    """
    whole = path.endswith(".npz")
    nodes = read(spark, path if whole else f"{path}/nodes", "x,y" if whole else "node_id,x,y", flat="false", **options)
    x = [F.col("x")[i].cast("double").alias(c) for i, c in enumerate(schema.raw_columns)]
    scalar = lambda c: F.col(c)[0] if nodes.schema[c].dataType.typeName() == "array" else F.col(c)
    nodes = nodes.select(F.col("row" if whole else "node_id").cast("long").alias("node_id"), *x, scalar("y").cast("int").alias("y"))
    edges = read(spark, path if whole else f"{path}/edges", "edge_index,edge_type,edge_timestamp", **options)
    ends = [F.col("edge_index")[i].cast("long").alias(c) for i, c in enumerate(("src", "dst"))]
    return GraphFrame(nodes, edges.select(*ends, F.col("edge_type").cast("int").alias("edge_type"), F.col("edge_timestamp").cast("int").alias("day")), schema)


def read_ids(spark: SparkSession, path: str, name: str, **options: object) -> DataFrame:
    """(node_id): the ids of train_mask or test_mask of a phase."""
    found = read(spark, path if path.endswith(".npz") else f"{path}/{name}", name, **options)
    return found.select(F.col(name).cast("long").alias("node_id"))
