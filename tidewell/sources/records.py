"""Files of a user's own records as a Spark source and sink: byte-range splits, requested columns, pushed filters, commits.

A user says how a row becomes bytes and back (``Format``, ``Codec``); ``source`` makes a Python data source of it,
for ``spark.read.format`` and ``df.write.format``. A file is a mark of 16 random bytes and blocks, each of them the
mark, its payload's size, its number of records, a CRC-32 and the records with their lengths. A split is a range of bytes: it has
the blocks whose mark begins in it, so files are read in as many parts as asked, whatever the records hold.

Each task writes a file of its own. The commit writes a manifest, a list of files, and puts it in place by one rename;
readers see the files of the manifest only, so all of a job's rows appear at once, and a failed job or attempt leaves no row. Two
jobs that write one path at the same time aren't kept apart: the later manifest wins.

Files are opened by Arrow's file systems, so paths may be ``file:``, ``hdfs:``, ``s3:`` or ``gs:``.
"""

from __future__ import annotations

import datetime as dt
import json
import os
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from decimal import Decimal
from typing import Any

import pyarrow as pa
from pyarrow import fs as afs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import types as T

from tidewell.operators.runs import arrow_schema, gathered
from tidewell.session import ship

MANIFEST = "_manifest.json"
SPLIT_BYTES, BLOCK_BYTES = 64 << 20, 1 << 20
#: Splits of small files, if their size isn't given: about so many, but none of fewer bytes, as each is a task.
SPLITS, LEAST_SPLIT = 192, 64 << 10
#: Rows of a batch that are packed at a time.
SLICE = 1024
_HEAD, _LENGTH, _NONE = struct.Struct("<III"), struct.Struct("<I"), 0xFFFFFFFF
_EPOCH = dt.datetime(1970, 1, 1)


# values


class Codec:
    """A value of a column as bytes and back; null isn't given to it."""

    def pack(self, value: Any) -> bytes:
        raise NotImplementedError

    def unpack(self, raw: bytes) -> Any:
        raise NotImplementedError


class Made(Codec):
    """A codec of two functions."""

    def __init__(self, pack: Callable[[Any], bytes], unpack: Callable[[bytes], Any]):
        self.pack, self.unpack = pack, unpack


class _Many(Codec):
    """Values one after the other, each by a codec of its own, or all by one."""

    def __init__(self, codecs: list[Codec], repeat: bool, make: Callable[[list], Any], parts: Callable[[Any], list]):
        self.codecs, self.repeat, self.make, self.parts = codecs, repeat, make, parts

    def pack(self, value):
        parts = self.parts(value)
        return join_fields([None if v is None else self.codecs[i % len(self.codecs)].pack(v) for i, v in enumerate(parts)])

    def unpack(self, raw):
        return self.make([None if v is None else self.codecs[i % len(self.codecs)].unpack(v) for i, v in enumerate(split_fields(raw))])


def _number(form: str) -> Codec:
    s = struct.Struct("<" + form)
    return Made(s.pack, lambda raw: s.unpack(raw)[0])


def _micros(value: dt.datetime) -> int:
    zone = dt.timezone.utc if value.tzinfo else None
    return (value - _EPOCH.replace(tzinfo=zone)) // dt.timedelta(microseconds=1)


def codec_of(kind: T.DataType) -> Codec:
    """The codec of a type that needs none of the user's."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return _number("q")
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return _number("d")
    if isinstance(kind, T.BooleanType):
        return _number("?")
    if isinstance(kind, T.StringType):
        return Made(str.encode, lambda raw: bytes(raw).decode())
    if isinstance(kind, T.BinaryType):
        return Made(bytes, bytes)
    if isinstance(kind, T.DecimalType):
        return Made(lambda v: str(v).encode(), lambda raw: Decimal(bytes(raw).decode()))
    if isinstance(kind, T.DateType):
        s = struct.Struct("<q")
        return Made(lambda v: s.pack(v.toordinal()), lambda raw: dt.date.fromordinal(s.unpack(raw)[0]))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        s, zone = struct.Struct("<q"), dt.timezone.utc if isinstance(kind, T.TimestampType) else None
        return Made(lambda v: s.pack(_micros(v)), lambda raw: _EPOCH.replace(tzinfo=zone) + dt.timedelta(microseconds=s.unpack(raw)[0]))
    if isinstance(kind, T.ArrayType):
        return _Many([codec_of(kind.elementType)], True, list, list)
    if isinstance(kind, T.MapType):
        pairs = lambda v: [x for kv in (v.items() if isinstance(v, dict) else v) for x in kv]
        return _Many([codec_of(kind.keyType), codec_of(kind.valueType)], True, lambda x: list(zip(x[::2], x[1::2])), pairs)
    if isinstance(kind, T.StructType):
        names = kind.names
        return _Many([codec_of(f.dataType) for f in kind], False, lambda x: dict(zip(names, x)), lambda v: [v[n] for n in names])
    raise TypeError(f"no codec for {kind.simpleString()}")


def join_fields(fields: list[bytes | None]) -> bytes:
    """Fields with their lengths; null has a length of its own."""
    out = []
    for f in fields:
        out += (_LENGTH.pack(_NONE),) if f is None else (_LENGTH.pack(len(f)), f)
    return b"".join(out)


def split_fields(raw: bytes) -> list[bytes | None]:
    at, size, out, length = 0, len(raw), [], _LENGTH.unpack_from
    while at < size:
        n = length(raw, at)[0]
        at += 4
        if n == _NONE:
            out.append(None)
        else:
            if at + n > size:
                raise ValueError("a field goes beyond its record")
            out.append(raw[at : at + n])
            at += n
    return out


class Format:
    """How rows become records. The source's options that it doesn't use itself come as arguments, as strings.

    This one puts fields with their lengths side by side; a user's class changes what it likes: ``codec`` for the values of a
    column, ``join`` and ``split`` for the layout of a record. Fields that nobody asks for aren't unpacked.
    """

    def __init__(self, **arguments: str):
        self.arguments = arguments

    def codec(self, field: T.StructField) -> Codec:
        return codec_of(field.dataType)

    def join(self, fields: list[bytes | None]) -> bytes:
        return join_fields(fields)

    def split(self, record: bytes) -> list[bytes | None]:
        return split_fields(record)


# blocks


def blocks_of(records: Iterator[bytes], mark: bytes, most: int = BLOCK_BYTES) -> Iterator[tuple[bytes, int]]:
    """(a block, its number of records) of about ``most`` bytes each; a larger record is a block of its own."""
    held, size = [], 0
    for r in records:
        if held and size + len(r) > most:
            yield _block(held, mark), len(held)
            held, size = [], 0
        held.append(r)
        size += len(r) + 4
    if held:
        yield _block(held, mark), len(held)


def _block(records: list[bytes], mark: bytes) -> bytes:
    payload = b"".join(x for r in records for x in (_LENGTH.pack(len(r)), r))
    return mark + _HEAD.pack(len(payload), len(records), zlib.crc32(payload)) + payload


def records_of(file: pa.NativeFile, start: int, end: int, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The records of the blocks whose mark begins in a range of bytes. A damaged block is an error."""
    size = file.size()
    file.seek(0)
    mark = file.read(16)
    at = max(start, 16)
    file.seek(at)
    held = file.read(min(chunk, max(0, end + 15 - at)))
    # the first mark in the range; it may reach over its end
    while True:
        found = held.find(mark)
        if found >= 0:
            at += found
            break
        at, held = at + max(0, len(held) - 15), held[-15:]
        more = file.read(min(chunk, max(0, end + 15 - (at + len(held)))))
        if not more:
            return
        held += more
    while at < min(end, size):
        file.seek(at)
        head = file.read(16 + _HEAD.size)
        if len(head) < 16 + _HEAD.size or head[:16] != mark:
            raise ValueError(f"no block at byte {at}")
        length, n, crc = _HEAD.unpack_from(head, 16)
        payload = file.read(length)
        if len(payload) < length or zlib.crc32(payload) != crc:
            raise ValueError(f"a damaged block at byte {at}")
        place, size_of = 0, _LENGTH.unpack_from
        for _ in range(n):
            m = size_of(payload, place)[0]
            yield payload[place + 4 : place + 4 + m]
            place += 4 + m
        at += len(head) + length


# filters


def _ordered(v):
    """Numbers in Spark's order: what isn't a number is the greatest and equal to itself."""
    return (v != v, 0.0 if v != v else v) if isinstance(v, float) else v


#: Tests of a value that isn't null against a filter's value.
_TESTS = {
    ds.EqualTo: lambda v, x: _ordered(v) == _ordered(x), ds.EqualNullSafe: lambda v, x: _ordered(v) == _ordered(x), ds.GreaterThan: lambda v, x: _ordered(v) > _ordered(x), ds.GreaterThanOrEqual: lambda v, x: _ordered(v) >= _ordered(x),
    ds.LessThan: lambda v, x: _ordered(v) < _ordered(x), ds.LessThanOrEqual: lambda v, x: _ordered(v) <= _ordered(x), ds.In: lambda v, x: any(_ordered(v) == _ordered(y) for y in x),
    ds.StringStartsWith: lambda v, x: v.startswith(x), ds.StringEndsWith: lambda v, x: v.endswith(x), ds.StringContains: lambda v, x: x in v,
}
_COMPARED = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.StringType, T.BooleanType, T.DateType)


def test_of(f: ds.Filter, schema: T.StructType) -> tuple[str, Callable[[Any], bool]] | None:
    """(column, test of its value or None) of a filter that a reader can decide as Spark does."""
    if isinstance(f, ds.Not):
        inner = test_of(f.child, schema)
        if inner is None or not isinstance(f.child, (ds.IsNull, ds.IsNotNull)):
            return None  # not of null is null, which only Spark tells from false here
        return inner[0], lambda v, t=inner[1]: not t(v)
    column = getattr(f, "attribute", ())
    if len(column) != 1 or column[0] not in schema.names:
        return None
    if isinstance(f, ds.IsNull):
        return column[0], lambda v: v is None
    if isinstance(f, ds.IsNotNull):
        return column[0], lambda v: v is not None
    if type(f) not in _TESTS or not isinstance(schema[column[0]].dataType, _COMPARED):
        return None
    wanted, test = f.value, _TESTS[type(f)]
    if isinstance(f, ds.EqualNullSafe) and wanted is None:
        return column[0], lambda v: v is None
    if wanted is None or isinstance(f, ds.In) and any(x is None for x in wanted):
        return None
    return column[0], lambda v: v is not None and test(v, wanted)


# the source


def _opened(path: str) -> tuple[afs.FileSystem, str]:
    if "://" not in path and not path.startswith("file:"):
        return afs.LocalFileSystem(), os.path.abspath(path)
    return afs.FileSystem.from_uri("file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path)


def _manifest(files: afs.FileSystem, folder: str) -> dict | None:
    if files.get_file_info(f"{folder}/{MANIFEST}").type == afs.FileType.NotFound:
        return None
    with files.open_input_stream(f"{folder}/{MANIFEST}") as f:
        return json.loads(f.read())


class _Range(ds.InputPartition):
    def __init__(self, name: str, start: int, end: int):
        super().__init__((name, start, end))
        self.name, self.start, self.end = name, start, end


class Reader(ds.DataSourceReader):
    """Reads the requested columns (those of the schema that the user gives) of the rows that pass the pushed filters."""

    def __init__(self, path: str, fmt: Format, schema: T.StructType, split_bytes: int | None):
        self.path, self.format, self.schema, self.split_bytes = path, fmt, schema, split_bytes
        self.tests: list[tuple[str, Callable]] = []
        files, folder = _opened(path)
        self.manifest = _manifest(files, folder)
        if self.manifest is None:
            raise FileNotFoundError(f"no committed records at {path}")
        self.stored = T.StructType.fromJson(self.manifest["schema"])
        for f in schema:
            if f.name not in self.stored.names or self.stored[f.name].dataType != f.dataType:
                raise ValueError(f"no column {f.name} of type {f.dataType.simpleString()} in {path}")

    def pushFilters(self, filters):
        for f in filters:
            test = test_of(f, self.stored)
            if test is None:
                yield f
            else:
                self.tests.append(test)

    def partitions(self):
        out, files = [], self.manifest["files"]
        size = self.split_bytes or min(SPLIT_BYTES, max(LEAST_SPLIT, sum(x["size"] for x in files) // SPLITS))
        for x in files:
            out += [_Range(x["name"], a, min(a + size, x["size"])) for a in range(0, x["size"], size)]
        return out or [_Range("", 0, 0)]

    def rows(self, part: _Range) -> Iterator[tuple]:
        if not part.name:
            return
        names = self.stored.names
        codecs = {n: self.format.codec(self.stored[n]) for n in {*self.schema.names, *(c for c, _ in self.tests)}}
        tests = [(names.index(c), codecs[c], t) for c, t in self.tests]
        wanted = [(names.index(n), codecs[n]) for n in self.schema.names]
        files, folder = _opened(self.path)
        with files.open_input_file(f"{folder}/{part.name}") as f:
            for record in records_of(f, part.start, part.end):
                fields = self.format.split(record)
                if len(fields) != len(names):
                    raise ValueError(f"a record of {len(fields)} fields for {len(names)} columns in {part.name}")
                known: dict[int, Any] = {}
                for i, codec, test in tests:
                    if i not in known:
                        known[i] = None if fields[i] is None else codec.unpack(fields[i])
                    if not test(known[i]):
                        break
                else:
                    yield tuple(known[i] if i in known else None if fields[i] is None else codec.unpack(fields[i]) for i, codec in wanted)

    def read(self, part):
        return gathered(self.rows(part), arrow_schema(self.schema))


def _packed(pack: Callable[[Any], bytes], values: list) -> list[bytes | None]:
    return [None if v is None else pack(v) for v in values]


class Written(ds.WriterCommitMessage):
    def __init__(self, name: str, size: int, rows: int):
        self.name, self.size, self.rows = name, size, rows


class Writer(ds.DataSourceArrowWriter):
    """A file for each task; all of a job's files appear by its commit, and go if it fails."""

    def __init__(self, path: str, fmt: Format, schema: T.StructType, overwrite: bool, block_bytes: int):
        self.path, self.format, self.schema, self.overwrite, self.block_bytes = path, fmt, schema, overwrite, block_bytes
        self.job = uuid.uuid4().hex
        files, folder = _opened(path)
        before = None if overwrite else _manifest(files, folder)
        if before is not None and T.StructType.fromJson(before["schema"]) != _nullable(schema):
            raise ValueError(f"the rows at {path} have other columns")

    def write(self, iterator):
        files, folder = _opened(self.path)
        files.create_dir(folder, recursive=True)
        at = TaskContext.get()
        name = f"part-{self.job}-{at.partitionId():05d}-{at.taskAttemptId()}.rec"
        codecs, mark, rows = [self.format.codec(f) for f in self.schema], os.urandom(16), 0

        def records():
            join = self.format.join
            for b in iterator:
                # a column after the other, in slices, so that few rows are held as objects
                for first in range(0, len(b), SLICE):
                    packed = [_packed(c.pack, column.slice(first, SLICE).to_pylist()) for c, column in zip(codecs, b.columns)]
                    yield from map(join, map(list, zip(*packed)))

        try:
            with files.open_output_stream(f"{folder}/{name}") as f:
                f.write(mark)
                for block, n in blocks_of(records(), mark, self.block_bytes):
                    f.write(block)
                    rows += n
                size = f.tell()
        except BaseException:
            files.delete_file(f"{folder}/{name}")
            raise
        return Written(name, size, rows)

    def _own(self, files, folder) -> list[str]:
        found = files.get_file_info(afs.FileSelector(folder, allow_not_found=True))
        return [x.path for x in found if x.base_name.startswith(f"part-{self.job}-")]

    def commit(self, messages):
        files, folder = _opened(self.path)
        files.create_dir(folder, recursive=True)
        before = _manifest(files, folder)
        kept = [] if self.overwrite or before is None else before["files"]
        new = [{"name": m.name, "size": m.size, "rows": m.rows} for m in messages if m is not None and m.rows]
        temporary = f"{folder}/.manifest-{self.job}"
        with files.open_output_stream(temporary) as f:
            f.write(json.dumps({"schema": _nullable(self.schema).jsonValue(), "files": [*kept, *new]}).encode())
        files.move(temporary, f"{folder}/{MANIFEST}")
        # what isn't in the manifest can't be seen: other attempts' files, and rows that were overwritten
        listed = {x["name"] for x in new}
        gone = [p for p in self._own(files, folder) if p.rpartition("/")[2] not in listed]
        gone += [f"{folder}/{x['name']}" for x in (before["files"] if self.overwrite and before else [])]
        for p in gone:
            files.delete_file(p)

    def abort(self, messages):
        files, folder = _opened(self.path)
        for p in self._own(files, folder):
            files.delete_file(p)


def _nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType) for f in schema])


def source(fmt: type[Format], name: str) -> type[ds.DataSource]:
    """A data source class of a user's format."""

    class Source(ds.DataSource):
        @classmethod
        def name(cls):
            return name

        def _format(self) -> Format:
            return fmt(**{k: v for k, v in self.options.items() if k not in ("path", "split_bytes", "block_bytes")})

        def schema(self):
            files, folder = _opened(self.options["path"])
            found = _manifest(files, folder)
            if found is None:
                raise FileNotFoundError(f"no committed records at {self.options['path']}")
            return T.StructType.fromJson(found["schema"])

        def reader(self, schema):
            return Reader(self.options["path"], self._format(), schema, int(self.options.get("split_bytes", 0)) or None)

        def writer(self, schema, overwrite):
            return Writer(self.options["path"], self._format(), schema, overwrite, int(self.options.get("block_bytes", BLOCK_BYTES)))

    return Source


def register(spark: SparkSession, fmt: type[Format], name: str) -> str:
    """Makes a format known to a session under a name; pushes filters down to it from here on."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(source(fmt, name))
    return name


def write(df: DataFrame, path: str, name: str, mode: str = "append", **options: str) -> None:
    df.write.format(name).mode(mode).options(**options).save(path)


def read(spark: SparkSession, path: str, name: str, columns: list[str] | None = None, **options: str) -> DataFrame:
    """The rows at a path; of ``columns`` only, whose fields alone are unpacked then."""
    r = spark.read.format(name).options(**options)
    if columns is None:
        return r.load(path)
    files, folder = _opened(path)
    found = _manifest(files, folder)
    if found is None:
        raise FileNotFoundError(f"no committed records at {path}")
    stored = T.StructType.fromJson(found["schema"])
    return r.schema(T.StructType([stored[c] for c in columns])).load(path)
