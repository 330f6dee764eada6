"""A user's records as a source and sink: splits, requested columns, pushed filters, commits."""

import datetime as dt
import json
import math
import os
import sys
from collections import Counter
from decimal import Decimal

import pyarrow as pa
import pytest
from pyspark import cloudpickle
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.plans import storage
from tidewell.plans.registry import Tables
from tidewell.plans.storage import Tabbed, WithVersions
from tidewell.sources import records as rec

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks can't import tests

KINDS = {
    "b": T.ByteType(), "i": T.IntegerType(), "n": T.LongType(), "d": T.DoubleType(), "f": T.FloatType(), "ok": T.BooleanType(), "s": T.StringType(), "raw": T.BinaryType(), "m": T.DecimalType(20, 3), "day": T.DateType(), "at": T.TimestampType(),
    "local": T.TimestampNTZType(), "a": T.ArrayType(T.ArrayType(T.IntegerType())), "q": T.MapType(T.StringType(), T.DoubleType()), "r": T.StructType([T.StructField("x", T.IntegerType()), T.StructField("y", T.StringType())]),
}
SCHEMA = T.StructType([T.StructField(k, v) for k, v in KINDS.items()])
VALUES = (
    -3, 7, 2**62, 1.5, 0.25, True, "été\t\n\x00", b"\x00\xff", Decimal("12.345"), dt.date(1969, 12, 31), dt.datetime(2024, 2, 29, 1, 2, 3, 456789, dt.timezone.utc), dt.datetime(1960, 1, 1, 0, 0, 0, 1), [[1, None], [], None], {"k": 1.0, "": None}, {"x": None, "y": "z"},
)


@pytest.mark.parametrize("values", [VALUES, (None,) * len(VALUES)])
def test_values_come_back(values):
    fmt = rec.Format()
    record = fmt.join([None if v is None else fmt.codec(f).pack(v) for v, f in zip(values, SCHEMA)])
    back = [None if raw is None else fmt.codec(f).unpack(raw) for raw, f in zip(fmt.split(record), SCHEMA)]
    assert [dict(v) if isinstance(f.dataType, T.MapType) and v is not None else v for v, f in zip(back, SCHEMA)] == list(values)


def test_every_block_is_in_one_split():
    records = [bytes([i % 256]) * (i % 97) for i in range(3000)]
    mark = os.urandom(16)
    data = mark + b"".join(b for b, _ in rec.blocks_of(iter(records), mark, 1000))
    for size in (17, 1000, 5003, len(data)):
        for chunk in (20, 1 << 20):
            got = []
            for start in range(0, len(data), size):
                got += rec.records_of(pa.PythonFile(pa.BufferReader(data), mode="r"), start, min(start + size, len(data)), chunk)
                if size == 17 and start > 20_000:
                    break
            assert got == records[: len(got)] and (len(got) == len(records) or size == 17)
    one = mark + b"".join(b for b, _ in rec.blocks_of(iter([b"x" * 5000, b""]), mark, 10))
    assert [len(r) for s in range(0, len(one), 64) for r in rec.records_of(pa.PythonFile(pa.BufferReader(one), mode="r"), s, min(s + 64, len(one)), 32)] == [5000, 0]


def test_damage_is_an_error():
    mark = os.urandom(16)
    data = bytearray(mark + b"".join(b for b, _ in rec.blocks_of(iter([b"abc"] * 500), mark, 700)))
    read = lambda d: list(rec.records_of(pa.PythonFile(pa.BufferReader(bytes(d)), mode="r"), 0, len(d)))
    assert len(read(data)) == 500
    data[60] ^= 1
    with pytest.raises(ValueError, match="damaged block"):
        read(data)
    data[60] ^= 1
    with pytest.raises(ValueError, match="damaged block|no block"):
        read(data[:-5])


@pytest.fixture()
def plain(spark):
    return rec.register(spark, rec.Format, "tidewell_plain")


@pytest.fixture()
def place(tmp_path):
    return f"file://{tmp_path}/records"


def test_round_trip_over_several_splits(spark, plain, place):
    df = spark.createDataFrame([VALUES, (None,) * len(VALUES)] * 300, SCHEMA).repartition(3)
    rec.write(df, place, plain, block_bytes="2000")
    got = rec.read(spark, place, plain, split_bytes="5000")
    assert got.rdd.getNumPartitions() > 6 and got.schema == df.schema
    assert Counter(map(repr, got.collect())) == Counter(map(repr, df.collect()))
    again = rec.read(spark, place, plain, ["s", "n"])
    assert again.columns == ["s", "n"] and again.where("n is not null").count() == 300


def test_modes_and_empty_tables(spark, plain, place):
    df = spark.range(10).withColumn("s", F.lit("x"))
    rec.write(df, place, plain)
    rec.write(df.where("id < 3"), place, plain)
    assert rec.read(spark, place, plain).count() == 13
    with pytest.raises(Exception, match="other columns"):
        rec.write(spark.range(2), place, plain)
    rec.write(df.where("id > 7"), place, plain, "overwrite")
    assert sorted(r.id for r in rec.read(spark, place, plain).collect()) == [8, 9]
    folder = place.removeprefix("file://")
    assert len([n for n in os.listdir(folder) if n.endswith(".rec")]) <= 2  # overwritten files are gone
    rec.write(df.where("false"), place, plain, "overwrite")
    empty = rec.read(spark, place, plain)
    assert empty.collect() == [] and empty.columns == ["id", "s"]
    with pytest.raises(FileNotFoundError):
        rec.read(spark, place + "-none", plain, ["id"])


class Picky(rec.Format):
    """Can't write the number 77; counts what it unpacks."""

    unpacked = Counter()

    def codec(self, field):
        c = super().codec(field)

        def pack(v):
            if v == 77:
                raise ValueError("77 can't be written")
            return c.pack(v)

        def unpack(raw):
            Picky.unpacked[field.name] += 1
            return c.unpack(raw)

        return rec.Made(pack, unpack)


def test_a_failed_job_leaves_nothing(spark, place):
    name = rec.register(spark, Picky, "tidewell_picky")
    folder = place.removeprefix("file://")
    with pytest.raises(Exception, match="77 can't be written"):
        rec.write(spark.range(0, 200, 1, 4), place, name)
    assert not os.path.exists(folder) or os.listdir(folder) == []
    rec.write(spark.range(0, 50, 1, 4), place, name)
    before = sorted(os.listdir(folder))
    for mode in ("append", "overwrite"):
        with pytest.raises(Exception, match="77 can't be written"):
            rec.write(spark.range(0, 200, 1, 4), place, name, mode)
        assert sorted(os.listdir(folder)) == before and rec.read(spark, place, name).count() == 50


def test_rows_without_a_manifest_are_not_seen(spark, plain, place):
    rec.write(spark.range(20), place, plain)
    folder = place.removeprefix("file://")
    file = next(n for n in os.listdir(folder) if n.endswith(".rec"))
    with open(f"{folder}/{file}", "rb") as a, open(f"{folder}/part-stray.rec", "wb") as b:
        b.write(a.read())
    assert rec.read(spark, place, plain).count() == 20


def test_only_wanted_fields_are_unpacked(spark, place):
    """Fields that are neither asked for nor filtered by stay as they are; of rows that a filter drops the rest does too."""
    name = rec.register(spark, Picky, "tidewell_picky")
    df = spark.range(100, 1100).selectExpr("id", "id % 10 as m", "cast(id as string) as s", "id * 2 as d")
    rec.write(df.repartition(2), place, name)
    schema = T.StructType([T.StructField("s", T.StringType()), T.StructField("m", T.LongType())])
    reader = rec.source(Picky, "x")({"path": place}).reader(schema)
    left = list(reader.pushFilters([ds.EqualTo(("m",), 3), ds.GreaterThan(("id",), 599)]))
    assert left == []
    Picky.unpacked.clear()
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert sorted(int(r["s"]) for r in rows) == list(range(603, 1100, 10))
    assert Picky.unpacked == {"m": 1000, "id": 100, "s": 50}
    got = rec.read(spark, place, name, ["s", "m"]).where("m = 3 and s like '60%'")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.s for r in got.collect()) == ["603"] and "Filter" not in plan.split("BatchScan")[0]


NAN = float("nan")


@pytest.mark.parametrize(
    "condition",
    ["d > 1.0", "d >= double('NaN')", "d = double('NaN')", "d < 1.5", "d <= 0", "d in (1.5, double('NaN'))", "d is null", "d is not null", "s = 'b'", "s > 'a'", "s like 'é%'", "s like '%x'", "s like '%b%'", "s <=> null", "not (s = 'b')", "day > date'2024-01-01'", "ok", "not ok", "n in (1, 3, null)", "n <=> 3", "s is not null and n < 3", "n != 1"],
)
def test_pushed_filters_decide_as_spark_does(spark, plain, tmp_path, condition):
    rows = [(d, s, day, ok, n) for d in (1.5, -0.0, NAN, None, math.inf) for s, day in (("b", dt.date(2024, 1, 2)), ("éx", dt.date(2023, 1, 1)), ("", None), (None, None)) for ok, n in ((True, 1), (False, 3), (None, None))]
    df = spark.createDataFrame(rows, "d double, s string, day date, ok boolean, n long").coalesce(1)
    place = f"file://{tmp_path}/filters"
    rec.write(df, place, plain)
    assert Counter(map(repr, rec.read(spark, place, plain).where(condition).collect())) == Counter(map(repr, df.where(condition).collect()))


def test_formats_of_users(spark, tmp_path):
    tabbed = rec.register(spark, Tabbed, "tidewell_tabbed")
    df = spark.createDataFrame([(1, "a\tb\\t", 0.1), (2, None, None), (None, "", -1e300), (4, "\\N", 2.0)], "k long, s string, d double")
    rec.write(df, f"file://{tmp_path}/t", tabbed)
    assert Counter(map(repr, rec.read(spark, f"file://{tmp_path}/t", tabbed).collect())) == Counter(map(repr, df.collect()))
    upper = rec.read(spark, f"file://{tmp_path}/t", tabbed, capitalise="true")
    assert {r.s for r in upper.collect()} == {"A\tB\\T", None, "", "\\N"}
    versions = rec.register(spark, WithVersions, "tidewell_versions")
    v = spark.createDataFrame([([1, 10, 2],), ([1, 9],), (None,)], "v array<long>")
    rec.write(v, f"file://{tmp_path}/v", versions, versions="v")
    got = rec.read(spark, f"file://{tmp_path}/v", versions, versions="v")
    assert got.agg(F.max("v")).first()[0] == [1, 10, 2] and got.count() == 3


@pytest.mark.parametrize("size, least, most", [(1_000_000, 8, 40), (1_600_000_000, 190, 220), (10_000_000_000, 190, 220)])
def test_splits_follow_the_size_of_the_files(spark, tmp_path, size, least, most):
    class Stored(rec.Format):
        pass

    files = [{"name": f"part-{i}.rec", "size": size // 8, "rows": 1} for i in range(8)]
    schema = T.StructType([T.StructField("n", T.LongType())])
    (tmp_path / rec.MANIFEST).write_text(json.dumps({"schema": schema.jsonValue(), "files": files}))
    reader = rec.source(Stored, "stored")({"path": str(tmp_path)}).reader(schema)
    parts = reader.partitions()
    assert least <= len(parts) <= most
    assert sum(p.end - p.start for p in parts) == size and max(p.end - p.start for p in parts) <= rec.SPLIT_BYTES


def test_queries_leave_the_splits_to_the_files(spark, monkeypatch):
    given = []
    monkeypatch.setattr(storage.rec, "write", lambda *a, **options: None)
    monkeypatch.setattr(storage.rec, "read", lambda *a, **options: given.append(options))
    storage.record_trip(Tables(spark, ""), None, rec.Format)
    assert given == [{}]
