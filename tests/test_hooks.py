"""User aggregates, reducers of ordered groups and combiners of streams."""

import datetime as dt
import random
import sys
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tidewell.operators import hooks, runs
from tidewell.plans.grouping import ArrayTotal, ElementSums, LabelAndTotal, Total
from tidewell.plans.rowsets import Sessions

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks can't import tests


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture()
def apart(spark):
    """Small partitions stay apart."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.fixture()
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


class Middle(hooks.Aggregate):
    """All values, so that each one must arrive once; counts merges and rows."""

    def start(self):
        return []

    def add(self, state, x):
        state.append(x)
        return state

    def merge(self, a, b):
        return a + b

    def finish(self, state):
        return (sorted(state, key=lambda x: (x is None, x)), len(state))


@pytest.mark.parametrize("salts,most", [(16, 20_000), (1, 20_000), (3, 1)])
def test_every_row_reaches_its_group_once(spark, small_batches, salts, most):
    r = random.Random(salts)
    data = [(r.choice(["a", "a", "a", "b", None, ""]), r.choice([0.0, -0.0, float("nan"), None, 1.5]), r.choice([None, *range(50)])) for _ in range(2000)]
    df = spark.createDataFrame(data, "k string, f double, x long").repartition(5)
    expected = defaultdict(list)
    for k, f, x in data:
        expected[k, None if f is None else "nan" if f != f else f + 0.0].append(x)
    got = hooks.aggregate(df, ["k", "f"], ["x"], Middle(), "xs array<long>, n long", salts=salts, most=most).collect()
    assert {(r.k, None if r.f is None else "nan" if r.f != r.f else r.f): r.xs for r in got} == {k: sorted(v, key=lambda x: (x is None, x)) for k, v in expected.items()}
    assert len(got) == len(expected)


def test_keys_of_other_types(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 1), True, 3)] * 4 + [(None, None, 5)], "d date, b boolean, x int").withColumn("m", F.lit("1.50").cast("decimal(10,2)")).withColumn("t", F.lit("2024-01-02 03:04:05").cast("timestamp"))
    got = hooks.aggregate(df, ["d", "b", "m", "t"], ["x"], Total(), "s long")
    assert got.columns == ["d", "b", "m", "t", "s"] and sorted(r.s for r in got.collect()) == [5, 12]
    assert got.where("s = 12").select("d", "b", "m", "t").collect() == df.where("x = 3").select("d", "b", "m", "t").distinct().collect()
    with pytest.raises(TypeError, match="not a key"):
        hooks.aggregate(df.withColumn("a", F.array("x")), ["a"], ["x"], Total(), "s long")
    with pytest.raises(ValueError, match="named like groups"):
        hooks.aggregate(df, ["d"], ["x"], Total(), "d long")


def test_no_rows(spark):
    none = spark.createDataFrame([], "k string, x long, a array<long>")
    assert hooks.aggregate(none, ["k"], ["x"], Total(), "s long").collect() == []
    assert [tuple(r) for r in hooks.aggregate(none, [], ["x"], Total(), "s long").collect()] == [(None,)]
    assert [tuple(r) for r in hooks.aggregate(none, [], ["x", "k"], LabelAndTotal(), "s string").collect()] == [(" 0",)]
    assert [tuple(r) for r in hooks.aggregate(none, [], ["a"], ElementSums(), "s array<long>").collect()] == [(None,)]


def test_arrays(spark):
    df = spark.createDataFrame([("a", [1, 0, 1]), ("a", [1, 1, 1]), ("b", [5]), ("b", None), ("c", None), ("d", [])], "k string, v array<long>").repartition(3)
    assert rows(hooks.aggregate(df, ["k"], ["v"], ElementSums(), "s array<long>")) == [("a", [2, 1, 2]), ("b", [5]), ("c", None), ("d", [])]
    assert rows(hooks.aggregate(df, ["k"], ["v"], ArrayTotal(), "s long")) == [("a", 5), ("b", 5), ("c", None), ("d", None)]
    with pytest.raises(Exception, match="different lengths"):
        hooks.aggregate(df.union(spark.createDataFrame([("a", [1])], df.schema)), ["k"], ["v"], ElementSums(), "s array<long>").collect()


class Counted(hooks.Aggregate):
    """How many rows came one by one and how many in arrays, and how often the state was packed."""

    def start(self):
        return [0, 0, 0]

    def add(self, state, x):
        return [state[0] + 1, *state[1:]]

    def add_batch(self, state, x):
        return [state[0], state[1] + len(x), state[2]]

    def merge(self, a, b):
        return [x + y for x, y in zip(a, b)]

    def dump(self, state):
        return super().dump([*state[:2], state[2] + 1])

    def finish(self, state):
        return tuple(state)


class InArrays(Counted):
    def add_batch(self, state, x):
        return super().add_batch(state, x)


def test_small_groups_take_no_arrays_and_lone_states_are_passed_on(spark):
    df = spark.range(0, 2000, 1, 2).select(F.when(F.col("id") < 1000, -1).otherwise(F.col("id")).alias("k"), F.lit(1).alias("x"))
    got = rows(hooks.aggregate(df, ["k"], ["x"], Counted(), "one long, many long, packed long"))
    assert got == [(-1, 0, 1000, 1), *[(k, 1, 0, 1) for k in range(1000, 2000)]]
    # the way of the class above isn't taken beside another one
    assert rows(hooks.aggregate(df, ["k"], ["x"], InArrays(), "one long, many long, packed long"))[1:] == [(k, 0, 1, 1) for k in range(1000, 2000)]


class Failing(Total):
    def merge(self, a, b):
        if a is not None and b is not None:
            raise ValueError("these states can't be merged")
        return super().merge(a, b)


def test_a_failing_merge_surfaces(spark):
    df = spark.range(100).repartition(4).select(F.lit("k").alias("k"), "id")
    with pytest.raises(Exception, match="these states can't be merged"):
        hooks.aggregate(df, ["k"], ["id"], Failing(), "s long").collect()


class Places(hooks.Aggregate):
    """In which tasks a state was merged."""

    def start(self):
        return [0, {}]

    def add_batch(self, state, x):
        state[0] += len(x)
        return state

    def merge(self, a, b):
        from pyspark import TaskContext

        at = TaskContext.get()
        seen = Counter(a[1]) + Counter(b[1])
        seen[at.stageId(), at.partitionId()] += 1
        return [a[0] + b[0], dict(seen)]

    def finish(self, state):
        return state[0], len(state[1]), sum(state[1].values())


def test_a_hot_group_is_merged_in_parts(spark, apart):
    """32 tasks have states of one group: eight salts merge four each, and one task the eight."""
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        df = spark.range(0, 320_000, 1, 32).select(F.lit("hot").alias("k"), "id")
        n, places, merges = hooks.aggregate(df, ["k"], ["id"], Places(), "n long, places long, merges long", salts=8).select("n", "places", "merges").first()
        assert n == 320_000 and merges == 31 and places > 4
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


# reducers


def collected(key, found):
    yield (*key, [(r.o, r.x) for r in found])


@pytest.mark.parametrize("order", [["o", "x"], ["-o", "x"]])
def test_groups_come_whole_and_in_order(spark, small_batches, order):
    r = random.Random(1)
    data = [(r.choice(["a", "a", "b", None]), r.randrange(9), x) for x in range(500)]
    df = spark.createDataFrame(data, "k string, o int, x int").repartition(4)
    got = {r.k: [tuple(v) for v in r.v] for r in hooks.reduce_ordered(df, ["k"], order, collected, "k string, v array<struct<o:int,x:int>>").collect()}
    sign = -1 if order[0] == "-o" else 1
    assert got == {k: sorted(((o, x) for q, o, x in data if q == k), key=lambda v: (sign * v[0], v[1])) for k in ("a", "b", None)}


def first_two(key, found):
    yield key[0], next(found).x
    yield key[0], next(found).x


def test_rows_that_are_not_read_are_skipped(spark, small_batches):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), (-F.col("id")).alias("x"))
    assert rows(hooks.reduce_ordered(df, ["k"], [F.col("x")], first_two, "k long, x long")) == [(0, -96), (0, -99), (1, -94), (1, -97), (2, -95), (2, -98)]
    assert hooks.reduce_ordered(df.where("false"), ["k"], ["x"], first_two, "k long, x long").collect() == []


def memory_used(key, found):
    import resource

    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    n = sum(1 for _ in found)
    yield key[0], n, (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024


def test_a_large_group_takes_no_memory(spark):
    df = spark.range(0, 3_000_000, 1, 4).select(F.lit(1).alias("k"), "id")
    k, n, mb = hooks.reduce_ordered(df, ["k"], ["id"], memory_used, "k int, n long, mb long").first()
    assert n == 3_000_000 and mb < 40


def spread_sessions(spark, data, **conf):
    df = spark.createDataFrame(data, "k string, ts timestamp_ntz, event_id long").repartition(6)
    s = Sessions(dt.timedelta(minutes=5))
    parts = "start timestamp_ntz, stop timestamp_ntz, first_event long, last_event long, n long"
    schema = "k string, session long, first_event long, last_event long, n long"
    order = ["ts", "event_id"]
    return rows(hooks.reduce_ordered(df, ["k"], order, s.at_once, schema)), rows(hooks.reduce_ordered(df, ["k"], order, s.piece, schema, merge=s.whole, parts=parts)), df


def test_pieces_of_a_large_key_give_what_the_key_gives(spark, small_batches, apart):
    r = random.Random(4)
    start = dt.datetime(2024, 1, 1)
    data = [(r.choice(["hot"] * 9 + ["b", None]), start + dt.timedelta(seconds=r.randrange(200_000)), i) for i in range(3000)]
    whole, pieces, df = spread_sessions(spark, data)
    assert whole == pieces and sum(r[-1] for r in whole) == 3000
    tasks = df.repartitionByRange("k", "ts").where("k = 'hot'").select(F.spark_partition_id()).distinct().count()
    assert tasks > 2  # the hot key is in several pieces
    with pytest.raises(ValueError, match="schema of the parts"):
        hooks.reduce_ordered(df, ["k"], ["ts"], collected, "k string", merge=collected)


def test_rows_of_a_wrong_width_are_errors(spark):
    with pytest.raises(Exception, match="a row of 1 values for 2 columns"):
        hooks.reduce_ordered(spark.range(3), ["id"], [], lambda key, found: [(1,)], "a long, b long").collect()


# combiners


def both(key, left, right):
    kept = [r.y for r in right]
    yield (*key, sorted(r.x for r in left), sorted(kept))


def test_sides_of_each_key(spark, small_batches):
    a = spark.createDataFrame([(k, x) for k, n in (("a", 30), ("b", 1), (None, 3)) for x in range(n)], "k string, x int")
    b = spark.createDataFrame([(k, y) for k, n in (("a", 20), ("c", 2), (None, 1)) for y in range(n)], "k string, y int")
    got = rows(hooks.combine_streams(a, b, ["k"], both, "k string, x array<int>, y array<int>"))
    assert got == sorted([("a", [*range(30)], [*range(20)]), ("b", [0], []), ("c", [], [0, 1]), (None, [0, 1, 2], [0])], key=repr)
    assert hooks.combine_streams(a.where("false"), b.where("false"), ["k"], both, "k string, x array<int>, y array<int>").collect() == []


def joined(key, left, right, cell):
    kept = [r.y for r in right]
    for r in left:
        for y in kept:
            yield key[0], r.x, y, len(kept)


@pytest.mark.parametrize("cell_rows", [10, 1000])
def test_a_grid_holds_all_pairs_once(spark, small_batches, cell_rows):
    a = spark.createDataFrame([("hot", x) for x in range(90)] + [("b", 1), ("n", 2), (None, 3), (None, 4)], "k string, x int")
    b = spark.createDataFrame([("hot", y) for y in range(35)] + [("b", y) for y in range(25)] + [("m", 1), (None, 9)], "k string, y int")
    found = hooks.combine_streams(a, b, ["k"], joined, "k string, x int, y int, held int", cell_rows=cell_rows).collect()
    expected = [(r.k, r.x, s.y) for r in a.collect() for s in b.collect() if r.k == s.k]
    assert sorted([(r.k, r.x, r.y) for r in found], key=repr) == sorted(expected, key=repr)
    most = max(r.held for r in found)
    assert most < 25 if cell_rows == 10 else most == 35  # no cell holds all right rows of a large key


def counted(key, left, right, cell):
    m = sum(1 for _ in right)
    yield key[0], sum(1 for _ in left) if cell[1] == 0 else 0, m if cell[0] == 0 else 0


def added(key, parts):
    found = list(parts)
    yield key[0], sum(p.n for p in found), sum(p.m for p in found)


@pytest.mark.parametrize("cell_rows", [7, 10_000])
def test_cells_are_merged_by_key(spark, cell_rows):
    a = spark.range(500).select((F.col("id") % 4).alias("k"), "id").union(spark.range(900).selectExpr("7L", "id"))
    b = spark.range(60).select((F.col("id") % 5).alias("k"), "id")
    got = rows(hooks.combine_streams(a, b, ["k"], counted, "k long, n long, m long", cell_rows=cell_rows, merge=added))
    assert got == [(0, 125, 12), (1, 125, 12), (2, 125, 12), (3, 125, 12), (4, 0, 12), (7, 900, 0)]


def wrong_order(key, left, right):
    yield (sum(1 for _ in left) + sum(1 for _ in right),)


def test_right_rows_are_read_first(spark):
    with pytest.raises(Exception, match="read before its left rows"):
        hooks.combine_streams(spark.range(3), spark.range(3), ["id"], wrong_order, "n long").collect()


def test_runs_tell_keys_apart():
    nan = float("nan")
    b = pa.RecordBatch.from_pydict({"a": pa.array([None, None, nan, nan, 1.0, 1.0, 2.0]), "b": pa.array(["x", "x", None, None, "y", "z", "z"]), "v": pa.array(range(7))})
    got = [(repr(key), [p.column(2).to_pylist() for _, p in found]) for key, found in runs.groups([b, b.slice(6), b.slice(0, 0), b.slice(6)], 2)]
    assert got == [("(None, 'x')", [[0, 1]]), ("(nan, None)", [[2, 3]]), ("(1.0, 'y')", [[4]]), ("(1.0, 'z')", [[5]]), ("(2.0, 'z')", [[6], [6], [6]])]
