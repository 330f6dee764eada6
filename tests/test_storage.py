"""Backfills, copies that follow their base, outputs of one pass, and sets of many files."""

import datetime as dt
import os
import time

import pytest
from pyspark.sql import functions as F

from tidewell.session import names
from tidewell.sources import backfill, copies, sinks
from tidewell.sources import fileset as fs

FIRST = dt.date(2024, 1, 1)
SCHEMA = "id long, day date"


@pytest.fixture()
def place(tmp_path):
    return f"file://{tmp_path}/here"


def local(path):
    return path.removeprefix("file://")


def tree(path):
    """Each data file below a path with its time of writing."""
    return {os.path.join(d, n)[len(local(path)) :]: os.stat(os.path.join(d, n)).st_mtime_ns for d, _, some in os.walk(local(path)) for n in some if n.endswith(".parquet")}


def daily(spark, n=1000, n_days=10, step=0):
    """Rows of some days; ``step`` makes other rows of them."""
    df = spark.range(n).select((F.col("id") + step).alias("id"), F.date_add(F.lit(FIRST), (F.col("id") % n_days).cast("int")).alias("day"))
    return lambda days: df


DAYS = backfill.days_between(FIRST, FIRST + dt.timedelta(days=9))


def test_a_run_goes_on_with_missing_days(spark, place):
    assert backfill.finished(spark, place).collect() == []
    assert backfill.run(spark, daily(spark), place, DAYS[:4]) == DAYS[3::-1]
    before = tree(f"{place}/data")
    assert backfill.run(spark, daily(spark), place, DAYS, batch=4) == DAYS[:3:-1]
    after = tree(f"{place}/data")
    assert before.items() <= after.items() and backfill.read(spark, place, SCHEMA).count() == 1000
    assert {r.day: r.n_rows for r in backfill.finished(spark, place).collect()} == {d: 100 for d in DAYS}
    assert backfill.run(spark, daily(spark), place, DAYS) == [] and tree(f"{place}/data") == after


def test_a_rerun_of_a_day_changes_its_folder_only(spark, place):
    backfill.run(spark, daily(spark), place, DAYS)
    before = tree(f"{place}/data")
    assert backfill.run(spark, daily(spark, step=5000), place, DAYS, again=DAYS[3:4]) == [DAYS[3]]
    after = tree(f"{place}/data")
    own = f"/day={DAYS[3]}/"
    assert {k: v for k, v in before.items() if own not in k} == {k: v for k, v in after.items() if own not in k}
    assert not {k for k in before if own in k} & {k for k in after if own in k}
    got = backfill.read(spark, place, SCHEMA)
    assert got.where(F.col("day") == DAYS[3]).agg(F.min("id")).first()[0] >= 5000 and got.count() == 1000


def test_days_that_lose_their_rows(spark, place):
    backfill.run(spark, daily(spark), place, DAYS)
    gone = lambda days: daily(spark)(days).where(F.col("day") != F.lit(DAYS[2]))
    backfill.run(spark, gone, place, [], again=DAYS[2:4])
    got = backfill.read(spark, place, SCHEMA)
    assert got.count() == 900 and got.where(F.col("day") == DAYS[2]).count() == 0
    assert {r.day: r.n_rows for r in backfill.finished(spark, place).collect()}[DAYS[2]] == 0
    assert backfill.run(spark, daily(spark), place, DAYS) == []  # a day without rows is finished
    none = lambda days: daily(spark)(days).where("false")
    assert backfill.run(spark, none, f"{place}-none", DAYS[:1]) == DAYS[:1]
    assert backfill.read(spark, f"{place}-none", SCHEMA).count() == 0


def test_a_failed_batch_is_done_by_the_next_run(spark, place):
    fail = F.when(F.col("id") == 995, F.raise_error(F.lit("no more"))).otherwise(F.col("id"))
    bad = lambda days: daily(spark)(days).withColumn("id", fail)  # noqa: E731  a row of the sixth day fails
    with pytest.raises(Exception, match="no more"):
        backfill.run(spark, bad, place, DAYS, batch=2)
    done = {r.day for r in backfill.finished(spark, place).collect()}
    assert done == set(DAYS[6:]) and {str(r.day) for r in backfill.read(spark, place, SCHEMA).select("day").distinct().collect()} == {str(d) for d in done}
    assert backfill.run(spark, daily(spark), place, DAYS) == DAYS[5::-1]
    assert backfill.read(spark, place, SCHEMA).count() == 1000


def test_a_large_day_is_several_files(spark, place):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        backfill.run(spark, daily(spark, 20_000, 1), place, DAYS[:1])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(tree(f"{place}/data")) == 4


# copies


def base_of(spark, place, **parts):
    for name, (low, high) in parts.items():
        spark.range(low, high).select((F.col("id") % 13).alias("k"), "id", (F.col("id") * 2).alias("v")).repartition(2).write.mode("overwrite").parquet(f"{place}/{name}")


def same_rows(spark, base, copy):
    got = sorted(map(tuple, copies.read(spark, copy).collect()))
    return got == sorted(map(tuple, spark.read.parquet(f"{base}/*").select("k", "v").collect())) and len(got)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_copy_follows_its_base(spark, place):
    import shutil

    base, copy = f"{place}/base", f"{place}/copy"
    base_of(spark, base, a=(0, 100), b=(100, 250))
    assert copies.create(spark, f"{base}/*", copy, "k", ["k", "v"], 4)["added"] == 4
    assert same_rows(spark, base, copy) == 250
    assert copies.refresh(spark, copy) == {"added": 0, "removed": 0, "merged": 0}
    first = tree(f"{copy}")
    base_of(spark, base, c=(250, 300), d=(300, 330))
    assert copies.refresh(spark, copy) == {"added": 4, "removed": 0, "merged": 0} and same_rows(spark, base, copy) == 330
    shutil.rmtree(local(f"{base}/d"))
    assert copies.refresh(spark, copy) == {"added": 0, "removed": 2, "merged": 0} and same_rows(spark, base, copy) == 300
    assert first.items() <= tree(copy).items()  # what stood stands as it was
    grouped = copies.read(spark, copy).groupBy("k").agg(F.sum("v").alias("s"))
    assert "Exchange hash" not in plan_of(grouped) and "Bucketed: true" in plan_of(grouped)
    assert sorted(map(tuple, grouped.collect())) == sorted(map(tuple, spark.read.parquet(f"{base}/*").groupBy("k").agg(F.sum("v")).collect()))
    base_of(spark, base, b=(1000, 1010))  # files written anew
    got = copies.refresh(spark, copy)
    assert got["added"] == 2 and got["removed"] == 2 and got["merged"] == 1 and same_rows(spark, base, copy) == 160
    assert len([n for n in names(spark, copy) if n.startswith("g-")]) == 1 and len([n for n in names(spark, copy) if n.startswith("manifest")]) == 1
    rebuilt = f"{place}/rebuilt"
    copies.create(spark, f"{base}/*", rebuilt, "k", ["k", "v"], 4)
    assert sorted(map(tuple, copies.read(spark, rebuilt).collect())) == sorted(map(tuple, copies.read(spark, copy).collect()))
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("bucketed_")]  # nothing is left in the catalogue
    with pytest.raises(FileExistsError):
        copies.create(spark, f"{base}/*", copy, "k", ["k", "v"], 4)


def test_many_generations_are_merged(spark, place):
    base, copy = f"{place}/base", f"{place}/copy"
    base_of(spark, base, a=(0, 50))
    copies.create(spark, f"{base}/*", copy, "k", ["k", "v"], 4)
    for i in range(4):
        base_of(spark, base, **{f"x{i}": (i * 10, i * 10 + 10)})
        got = copies.refresh(spark, copy, most_generations=3)
        assert got["merged"] == (i == 2) and same_rows(spark, base, copy) == 60 + 10 * i
    joined = copies.read(spark, copy).join(copies.read(spark, copy).withColumnRenamed("v", "w"), "k")
    assert "Exchange hash" not in plan_of(joined.hint("merge"))


def test_a_refresh_that_fails_changes_nothing(spark, place, monkeypatch):
    base, copy = f"{place}/base", f"{place}/copy"
    base_of(spark, base, a=(0, 50))
    copies.create(spark, f"{base}/*", copy, "k", ["k", "v"], 4)
    base_of(spark, base, b=(50, 80))

    def stopped(*a):
        raise OSError("stopped")

    with monkeypatch.context() as m:
        m.setattr(copies, "write_small", stopped)
        with pytest.raises(OSError, match="stopped"):
            copies.refresh(spark, copy)
    assert copies.read(spark, copy).count() == 50
    # the next one finds the folder of the generation that was never named
    assert copies.refresh(spark, copy)["added"] == 2 and same_rows(spark, base, copy) == 80


# outputs of one pass


def test_outputs_and_counters_take_one_pass(spark, place):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    df = spark.range(1000).mapInPandas(count, "id long")
    even = F.col("id") % 2 == 0
    counts = sinks.write_routed(
        df, place, {"even": (even, [F.col("id")]), "lines": (F.lit(True), [F.format_string("Line %d", "id").alias("Content")]), "none": (F.lit(None).cast("boolean"), [(F.col("id") / 2).alias("half"), F.lit("x").alias("x")])}, {"n": F.count("*"), "even": F.count_if(even), "top": F.max("id")}
    )
    assert counts == {"n": 1000, "even": 500, "top": 999} and seen.value == 1000
    read = lambda n, k: sinks.read_routed(spark, place, ["even", "lines", "none"], n, k)
    assert sorted(r.id for r in read("even", "id long").collect()) == list(range(0, 1000, 2))
    assert {r.Content for r in read("lines", "Content string").collect()} == {f"Line {i}" for i in range(1000)}
    assert read("none", "half double, x string").collect() == []
    plan = plan_of(read("even", "id long"))
    assert "PartitionFilters: [isnotnull(output" in plan  # other outputs' files aren't read


# sets of files


def write(w, p):
    w.parquet(p)


def number_set(spark, place, n, rows, low=0):
    df = spark.range(rows).select("id", (F.col("id") % n).alias("m"))
    fs.write_set(df, place, "x-<N>.parquet", {"N": f"intrange:{low}...{n - 1}"}, {"N": F.col("m")}, ["id"], write)


def read_numbers(spark, place, a, b, sparse=False):
    return fs.read_set(spark, place, "x-<N>.parquet", {"N": f"intrange:{a}...{b}"}, lambda paths: spark.read.schema("id long").parquet(*paths), sparse)


def test_a_set_of_many_members(spark, place):
    began = time.time()
    number_set(spark, place, 1500, 3000)
    assert len(names(spark, place)) == 1500
    got = read_numbers(spark, place, 0, 1499)
    assert got.agg(F.count("*"), F.sum(F.col("N"))).first()[:] == (3000, 2 * sum(range(1500)))
    assert time.time() - began < 60
    assert os.listdir(os.path.dirname(local(place))) == ["here"]  # nothing beside it is left


def test_missing_members(spark, place):
    number_set(spark, place, 5, 100, low=2)
    with pytest.raises(FileNotFoundError, match=r"missing: \['x-0.parquet', 'x-1.parquet'\]"):
        read_numbers(spark, place, 0, 4)
    assert read_numbers(spark, place, 0, 4, sparse=True).count() == 60
    with pytest.raises(FileNotFoundError):
        read_numbers(spark, place, 7, 9, sparse=True)
    number_set(spark, place, 2, 10)  # more members of the same set
    assert read_numbers(spark, place, 0, 4).count() == 70
    with pytest.raises(FileExistsError, match="there already"):
        number_set(spark, place, 2, 10)


def test_a_failed_write_leaves_no_member(spark, place):
    df = spark.range(100).select(F.when(F.col("id") == 99, F.raise_error(F.lit("broken"))).otherwise(F.col("id")).cast("long").alias("id"), (F.col("id") % 5).alias("m"))
    put = lambda d, template="x-<N>.parquet": fs.write_set(d, place, template, {"N": "intrange:0...4"}, {"N": F.col("m")}, ["id"], write)
    with pytest.raises(Exception, match="broken"):
        put(df)
    assert names(spark, place) == set() and os.listdir(os.path.dirname(local(place))) == []
    number_set(spark, place, 7, 70, low=5)
    with pytest.raises(Exception, match="broken"):
        put(df)
    assert names(spark, place) == {"x-5.parquet", "x-6.parquet"} and os.listdir(os.path.dirname(local(place))) == ["here"]


def test_rows_of_a_copy_have_the_numbers_of_their_files(spark, place):
    base, copy = f"{place}/base", f"{place}/copy"
    base_of(spark, base, a=(0, 50), b=(50, 200), c=(200, 250))
    copies.create(spark, f"{base}/*", copy, "k", ["k", "v"], 4)
    g = [n for n in names(spark, copy) if n.startswith("g-")]
    stored = spark.read.parquet(f"{copy}/{g[0]}")
    # a name beside each row was most of a copy's work
    assert stored.schema["_base_file"].dataType.simpleString() == "int" and stored.select("_base_file").distinct().count() == 6
    # a file that goes and comes again has its rows once
    os.rename(local(f"{base}/a"), local(f"{place}/away"))
    assert copies.refresh(spark, copy)["removed"] == 2 and same_rows(spark, base, copy) == 200
    os.rename(local(f"{place}/away"), local(f"{base}/a"))
    assert copies.refresh(spark, copy)["added"] == 2 and same_rows(spark, base, copy) == 250
