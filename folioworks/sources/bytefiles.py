"""Files as bytes: a reader of ranges that reads nothing else, and a writer that runs on executors.

Paths are those of a file system (``/a``, ``file:``, ``hdfs:``, ``s3:``), of the web (``http:``, ``https:``), or of a bucket that
``Stores`` places somewhere. They may end in ``?bytes=offset,length``; a negative length means to the end.

* ``read_ranges`` answers a table of paths, however many: requests move to tasks by file and stripe, are sorted there, and
  ranges that touch or nearly touch are read at once. A file that very many requests ask for is spread by its stripes.
* ``byte_blocks`` is a data source whose rows are blocks of files, small ones packed into partitions. Filters on ``path`` and ``offset`` decide
  which blocks there are before any is read; the options ``offset`` and ``length`` read that one range of every file.
* ``byte_files`` is a data source that writes ``(path, content)`` rows to files of a folder. A file appears whole under its
  name or not at all, and a task that runs again writes the same files again.
"""

from __future__ import annotations

import json
import urllib.error
import urllib.request
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import functions as F

from .corpus import parse_range

#: Requests this near to each other are read at once, up to so many bytes; stripes of a file go to tasks of their own.
NEAR, AT_ONCE, STRIPE = 1 << 14, 1 << 23, 1 << 26
BLOCK = 1 << 26
#: Bytes that a partition of blocks has at most (or one block), what opening a range counts as, and blocks that have a partition each.
PARTITION, RANGE_COST, FEW_PARTITIONS = 1 << 26, 1 << 16, 64


class _Web:
    """[S13] A file of the web, read by range requests; a server that ignores them is read as far as it must be."""

    def __init__(self, url: str):
        self.url, self.at, self.read_bytes = url, 0, 0

    def seek(self, at: int) -> None:
        self.at = at

    def read(self, n: int = -1) -> bytes:
        wanted = {} if self.at == 0 and n < 0 else {"Range": f"bytes={self.at}-{'' if n < 0 else self.at + n - 1}"}
        if n == 0:
            return b""
        try:
            with urllib.request.urlopen(urllib.request.Request(self.url, headers=wanted)) as got:
                if got.status == 206:
                    return got.read()
                got.read(self.at)
                return got.read() if n < 0 else got.read(n)
        except urllib.error.HTTPError as error:
            if error.code == 416:  # beyond the end
                return b""
            raise

    def size(self) -> int:
        with urllib.request.urlopen(urllib.request.Request(self.url, method="HEAD")) as got:
            return int(got.headers["Content-Length"])

    def close(self) -> None:
        pass


@dataclass(frozen=True)
class Stores:
    """[S12] Where buckets are: each ``s3://bucket/key`` is ``key`` in the folder of its bucket, whose URI may carry its
    endpoint and access. With no buckets the path itself says it all. A path without a scheme is one of the default
    ``bucket/prefix``, if there is one. A bucket that isn't placed is an error."""

    buckets: dict[str, str] = field(default_factory=dict)
    default: str = ""

    def __post_init__(self):
        if self.default and self.buckets and self.default.strip("/").split("/")[0] not in self.buckets:
            raise ValueError(f"the default bucket of {self.default!r} is not among {sorted(self.buckets)}")

    def place(self, path: str) -> str:
        if self.default and "://" not in path and not path.startswith(("/", "file:")):
            path = f"s3://{self.default.strip('/')}/{path}"
        for scheme in ("s3://", "s3a://"):
            if path.startswith(scheme) and self.buckets:
                bucket, _, key = path[len(scheme) :].partition("/")
                if bucket not in self.buckets:
                    raise KeyError(f"bucket {bucket!r} is not among {sorted(self.buckets)}")
                base, mark, query = self.buckets[bucket].partition("?")
                return f"{base.rstrip('/')}/{key}{mark}{query}"
        return path

    def system(self, path: str) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.place(path).replace("s3a://", "s3://"))

    def open(self, path: str):
        placed = self.place(path)
        if placed.startswith(("http://", "https://")):
            return _Web(placed)
        system, name = self.system(path)
        return system.open_input_file(name)

    def to_json(self) -> str:
        return json.dumps({"buckets": self.buckets, "default": self.default})


def read_at(handle, offset: int, length: int) -> bytes:
    """[S11] Bytes from an offset on, fewer at the end of the file; a negative length means to the end."""
    if offset < 0:
        raise ValueError(f"offset {offset} is negative")
    if not isinstance(handle, _Web) and offset >= handle.size():
        return b""
    handle.seek(offset)
    return handle.read() if length < 0 else handle.read(length)


def _runs(offsets: list[int], lengths: list[int], files: list[str]) -> Iterator[tuple[int, int]]:
    """Requests that are read together, as ranges of rows; rows come by file and offset."""
    first = 0
    while first < len(files):
        last, start, end = first + 1, offsets[first], offsets[first] + lengths[first]
        while last < len(files) and files[last] == files[first] and min(lengths[first], lengths[last], start) >= 0:
            reach = max(end, offsets[last] + lengths[last])
            if offsets[last] - end > NEAR or reach - start > AT_ONCE:
                break
            last, end = last + 1, reach
        yield first, last
        first = last


def _answer(stores: Stores, keep: bool):
    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, handle = None, None
        try:
            for batch in batches:
                files, offsets, lengths = (batch.column(c).to_pylist() for c in ("__file", "__offset", "__length"))
                contents, reads, errors = [None] * len(files), [0] * len(files), [None] * len(files)
                for first, last in _runs(offsets, lengths, files):
                    try:
                        if files[first] is None:
                            continue
                        if files[first] != name or handle is None:
                            if handle is not None:
                                handle.close()
                            handle, name = None, files[first]
                            handle = stores.open(name)
                        start = offsets[first]
                        end = -1 if lengths[first] < 0 else max(offsets[k] + lengths[k] for k in range(first, last))
                        data = read_at(handle, start, end - start if end >= 0 else -1)
                        reads[first] = len(data)
                        for k in range(first, last):
                            contents[k] = data[offsets[k] - start : None if lengths[k] < 0 else offsets[k] - start + lengths[k]]
                    except (OSError, KeyError, ValueError, pa.ArrowException) as error:
                        if not keep:
                            raise
                        errors[first:last] = [f"{type(error).__name__}: {error}"] * (last - first)
                own = [batch.column(c) for c in batch.schema.names[:-3]]
                yield pa.RecordBatch.from_arrays([*own, pa.array(contents, pa.binary()), pa.array(reads, pa.int64()), pa.array(errors, pa.string())], [*batch.schema.names[:-3], "content", "bytes_read", "error"])
        finally:
            if handle is not None:
                handle.close()

    return answer


def read_ranges(requests: DataFrame, stores: Stores | None = None, path: str = "path", keep_errors: bool = True) -> DataFrame:
    """[S11][S12] The rows of ``requests`` with the ``content`` that each path asks for, the ``bytes_read`` for it, counted at
    the first of the ranges that were read at once, and the ``error`` of one that can't be read.

    A null path has no content. Rows may repeat. ``keep_errors=False`` fails on the first unreadable range.
    """
    whole = F.col(path)
    plain = F.regexp_replace(whole, r"\?bytes=-?\d+,-?\d+$", "")
    asked = F.when(plain != whole, parse_range(F.concat(F.lit("s3://b/k"), F.regexp_extract(whole, r"(\?bytes=-?\d+,-?\d+)$", 1))))
    rows = requests.select("*", plain.alias("__file"), F.coalesce(asked["offset"], F.lit(0)).alias("__offset"), F.coalesce(asked["length"], F.lit(-1)).alias("__length"))
    dealt = rows.repartition(F.col("__file"), F.floor(F.col("__offset") / STRIPE)).sortWithinPartitions("__file", "__offset", "__length")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema.fields)
    return dealt.mapInArrow(_answer(stores or Stores(), keep_errors), f"{kinds}, content binary, bytes_read long, error string")


@dataclass
class _Range:
    path: str
    offset: int
    length: int
    size: int


@dataclass
class _Ranges(D.InputPartition):
    """Ranges that one task reads one after the other."""

    ranges: tuple[_Range, ...]


def _packed(ranges: list[_Range]) -> list[_Ranges]:
    """Few ranges with a partition each; many in order, as many to a partition as are worth a task."""
    costs = [r.length + RANGE_COST for r in ranges]
    full = min(PARTITION, -(-sum(costs) // FEW_PARTITIONS)) if len(ranges) > FEW_PARTITIONS else 0
    out: list[list[_Range]] = []
    held = full
    for r, cost in zip(ranges, costs, strict=True):
        if not out or held + cost > full:
            out.append([])
            held = 0
        out[-1].append(r)
        held += cost
    return [_Ranges(tuple(rs)) for rs in out]


class _BlockReader(D.DataSourceReader):
    def __init__(self, options: dict):
        self.stores = Stores(**json.loads(options.get("stores", "{}")))
        self.paths = json.loads(options["paths"]) if "paths" in options else [options["path"]]
        self.block = int(options.get("block", BLOCK))
        self.offset, self.length = (int(options[k]) if k in options else None for k in ("offset", "length"))
        self.tests: dict[str, list] = {"path": [], "offset": []}

    def pushFilters(self, filters):
        by = {
            D.EqualTo: lambda x, v: x == v, D.In: lambda x, v: x in v, D.GreaterThan: lambda x, v: x > v, D.GreaterThanOrEqual: lambda x, v: x >= v,
            D.LessThan: lambda x, v: x < v, D.LessThanOrEqual: lambda x, v: x <= v, D.StringStartsWith: lambda x, v: x.startswith(v), D.StringEndsWith: lambda x, v: x.endswith(v),
        }
        for f in filters:
            column = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if column in self.tests and type(f) in by:
                self.tests[column].append((by[type(f)], f.value))
            elif not (column in self.tests and isinstance(f, D.IsNotNull)):  # never null
                yield f

    def _wanted(self, column: str, value) -> bool:
        return all(test(value, v) for test, v in self.tests[column])

    def _files(self) -> Iterator[tuple[str, int]]:
        for path in self.paths:
            if self.stores.place(path).startswith(("http://", "https://")):
                yield path, self.stores.open(path).size()
                continue
            system, name = self.stores.system(path)
            info = system.get_file_info(name)
            if info.type == fs.FileType.NotFound:
                raise FileNotFoundError(path)
            found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(name, recursive=True))
            for x in sorted(found, key=lambda x: x.path):
                if x.type == fs.FileType.File and not x.base_name.startswith((".", "_")):
                    yield path.rstrip("/") + x.path[len(name.rstrip("/")) :], x.size

    def partitions(self):
        out = []
        for path, size in self._files():
            if not self._wanted("path", path):
                continue
            if self.offset is None and self.length is None:
                starts = range(0, size, self.block)
                out += [_Range(path, at, min(self.block, size - at), size) for at in starts if self._wanted("offset", at)]
            else:
                at = self.offset or 0
                length = max(0, min(size - at, self.length if self.length is not None and self.length >= 0 else size))
                if self._wanted("offset", at):
                    out.append(_Range(path, at, length, size))
        return _packed(out) or [_Ranges(())]

    def read(self, partition):
        for path, ranges in groupby(partition.ranges, key=lambda r: r.path):
            handle = self.stores.open(path)
            try:
                for r in ranges:
                    yield r.path, r.offset, r.length, r.size, read_at(handle, r.offset, r.length)
            finally:
                handle.close()


class ByteBlocks(D.DataSource):
    """[S11] ``spark.read.format("byte_blocks").load(folder)``: blocks of ``block`` bytes of every file below a path."""

    @classmethod
    def name(cls) -> str:
        return "byte_blocks"

    def schema(self) -> str:
        return "path string, offset long, length long, size long, content binary"

    def reader(self, schema) -> D.DataSourceReader:
        return _BlockReader(self.options)


class _FileWriter(D.DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.folder, self.stores = options["path"].rstrip("/"), Stores(**json.loads(options.get("stores", "{}")))

    def write(self, iterator):
        system, folder = self.stores.system(self.folder)
        whole_on_close = not isinstance(system, fs.LocalFileSystem | fs.HadoopFileSystem)
        made: set[str] = set()
        for batch in iterator:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                if path is None or path.startswith("/") or ".." in path.split("/"):
                    raise ValueError(f"{path!r} is no path below {self.folder}")
                target = f"{folder}/{path}"
                parent = target.rpartition("/")[0]
                if parent not in made:
                    system.create_dir(parent, recursive=True)
                    made.add(parent)
                at = target if whole_on_close else f"{parent}/.{uuid.uuid4().hex}"
                with system.open_output_stream(at) as out:
                    if content.is_valid:
                        out.write(content.as_buffer())
                if at != target:
                    system.move(at, target)
        return D.WriterCommitMessage()


class ByteFiles(D.DataSource):
    """[K5] ``rows.write.format("byte_files").mode("append").save(folder)``: a file for each ``(path, content)`` row."""

    @classmethod
    def name(cls) -> str:
        return "byte_files"

    def schema(self) -> str:
        return "path string, content binary"

    def writer(self, schema, overwrite: bool) -> D.DataSourceWriter:
        return _FileWriter(self.options)


def register(spark: SparkSession) -> None:
    """Makes the two sources known, and lets sources of Python see filters, which is off unless it is set."""
    spark.dataSource.register(ByteBlocks)
    spark.dataSource.register(ByteFiles)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def write_files(rows: DataFrame, folder: str, stores: Stores | None = None) -> None:
    """[K5] Files of ``(path, content)``, written where the rows are. Paths are relative; a null content is an empty file; of
    rows with one path any may stay."""
    register(rows.sparkSession)
    chosen = rows.select("path", F.col("content").cast("binary").alias("content"))
    chosen.write.format("byte_files").mode("append").option("stores", (stores or Stores()).to_json()).save(folder)


def byte_blocks(spark: SparkSession, paths: str | list[str], block: int = BLOCK, stores: Stores | None = None, **one: int) -> DataFrame:
    """[S11] ``(path, offset, length, size, content)``: blocks of files, or the range ``offset=``, ``length=`` of each."""
    register(spark)
    reader = spark.read.format("byte_blocks").option("paths", json.dumps([paths] if isinstance(paths, str) else paths)).option("block", block)
    for name, value in one.items():
        reader = reader.option(name, value)
    return reader.option("stores", (stores or Stores()).to_json()).load()
