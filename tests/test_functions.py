"""User functions of values, and table functions whose columns follow their arguments."""

import sys

import pyarrow.compute as pc
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tidewell.functions.user import Scalar, scalar
from tidewell.operators import tables

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks can't import tests


class Inverse(Scalar):
    def setup(self):
        self.factor = 12

    def call(self, x):
        return None if x is None else self.factor / x


class Joined(Scalar):
    def call_batch(self, a, b):
        return pc.binary_join_element_wise(a, b, "-")


class Sizes(Scalar):
    """How many rows each call gets, and how often this worker was set up."""

    ups = 0

    def setup(self):
        Sizes.ups += 1

    def call_batch(self, x):
        assert len(x) > 0
        return [100 * len(x) + Sizes.ups] * len(x)


class Short(Scalar):
    def call_batch(self, x):
        return x.slice(1)


def test_values_and_nulls(spark):
    df = spark.createDataFrame([(1.0, "a", "x"), (None, None, "y"), (4.0, "c", None), (2.0, "d", "z")], "x double, a string, b string")
    assert [r[0] for r in df.select(scalar(Inverse(), "double")("x")).collect()] == [12.0, None, 3.0, 6.0]
    assert [r[0] for r in df.select(scalar(Inverse(), "double", nulls="pass")("x")).collect()] == [12.0, None, 3.0, 6.0]
    assert [r[0] for r in df.select(scalar(Joined(), "string")("a", F.col("b"))).collect()] == ["a-x", None, None, "d-z"]
    assert df.where("false").select(scalar(Inverse(), "double")("x")).collect() == []
    assert df.where("x is null").select(scalar(Inverse(), "double")("x")).first()[0] is None
    with pytest.raises(ValueError, match="skip or pass"):
        scalar(Inverse(), "double", nulls="drop")


def test_batches_have_a_bound_and_one_setup(spark):
    df = spark.range(0, 1000, 1, 1)
    got = df.select(scalar(Sizes(), "long", rows=300)("id").alias("n")).groupBy("n").count().collect()
    assert {(r.n // 100, r["count"]) for r in got} == {(300, 900), (100, 100)} and len({r.n % 100 for r in got}) == 1


def test_a_failing_row_is_named(spark):
    df = spark.range(-500, 500).select(F.col("id").cast("double").alias("x"))
    with pytest.raises(Exception, match=r"Inverse failed on 0\.0: float division by zero|Inverse failed on 0\.0: division by zero"):
        df.select(scalar(Inverse(), "double")("x")).collect()
    with pytest.raises(Exception, match="halves failed on"):
        df.select(scalar(Short(), "double", name="halves")("x")).collect()


def test_columns_follow_the_mode(spark):
    df = spark.createDataFrame([("red", "#FF0000"), ("none", None)], "name string, hex string")
    typed, plain = tables.typed_view(df, "hex", "typed"), tables.typed_view(df, "hex", "untyped")
    assert dict(typed.dtypes) == {"name": "string", "hex": "bigint"} and plain.schema == df.schema
    assert sorted(map(tuple, typed.collect())) == [("none", None), ("red", 0xFF0000)] and sorted(map(str, plain.collect())) == sorted(map(str, df.collect()))
    for column, mode in (("hex", "other"), ("size", "typed")):
        with pytest.raises(Exception, match="typed or untyped|no text column"):
            tables.typed_view(df, column, mode)


def test_groups_come_in_order(spark):
    df = spark.createDataFrame([(k, x, str(x)) for k in ("a", "b", None) for x in range(50)], "k string, x int, s string").repartition(5)
    before = {f.name for f in spark.catalog.listFunctions()}
    got = tables.first_of_each(df, ["k"], ["-x"], 3)
    assert got.columns == ["k", "x", "s", "place"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(k, 49 - i, str(49 - i), i + 1) for k in ("a", "b", None) for i in range(3)], key=repr)
    assert {f.name for f in spark.catalog.listFunctions()} == before
    with pytest.raises(Exception, match="no column z"):
        tables.first_of_each(df, ["k"], ["z"], 3)
    with pytest.raises(Exception, match="at least one row"):
        tables.first_of_each(df, ["k"], ["x"], 0)
