"""Aggregates whose semantics differ from Spark's own, all with partial sums before a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def argmax(by: Column, value: Column) -> Column:
    """The value at the greatest ``by``; of ties the greatest value."""
    return F.max(F.struct(by.alias("by"), value.alias("value")))["value"]


def map_agg(df: DataFrame, by: list[str], key: str, value: str, name: str = "map") -> DataFrame:
    """A map for each group; of a key's values the greatest is kept."""
    one = df.where(F.col(key).isNotNull()).groupBy(*by, key).agg(F.max(value).alias(value))
    return one.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, value)))).alias(name))


def element_sums(df: DataFrame, by: list[str], array: str, name: str = "sums") -> DataFrame:
    """Sums of arrays element by element; arrays of one group must be equally long.

    Elements are summed by place, so a group of any size needs no more than its length.
    """
    sizes = F.size(array)
    parts = df.where(F.col(array).isNotNull()).select(*by, F.posexplode(array).alias("pos", "x"), sizes.alias("n"))
    sums = parts.groupBy(*by, "pos").agg(F.sum("x").alias("x"), F.min("n").alias("low"), F.max("n").alias("high"))
    checked = F.when(F.min("low") == F.max("high"), F.array_sort(F.collect_list(F.struct("pos", "x")))).otherwise(F.raise_error(F.lit("arrays of different lengths")))
    return sums.groupBy(*by).agg(checked.alias("s")).select(*by, F.col("s.x").alias(name))


def array_total(array: Column) -> Column:
    return F.aggregate(array, F.lit(0).cast("double"), lambda a, x: a + x)


def label_and_total(label: Column, x: Column) -> Column:
    """ "label total" of a group; the greatest label stands for the group."""
    return F.concat_ws(" ", F.max(label), F.sum(x).cast("string"))


def version_min(v: Column) -> Column:
    return F.min(v)


def version_max(v: Column) -> Column:
    """The greatest version, at least 0.0.0.0."""
    floor = F.array(*[F.lit(0)] * 4)
    return F.greatest(F.coalesce(F.max(v), floor), floor)


def sample_deviation(x: Column) -> Column:
    """Bessel's deviation; 0 of no rows, not a number of one."""
    return F.when(F.count(x) == 0, 0.0).when(F.count(x) == 1, float("nan")).otherwise(F.stddev_samp(x))


def population_deviation(x: Column) -> Column:
    """Deviation of the whole; 0 of no rows."""
    return F.coalesce(F.stddev_pop(x), F.lit(0.0))


def sum_all(df: DataFrame) -> DataFrame:
    """The sum of each column under its own name; a column that isn't a number is an error."""
    other = [f.name for f in df.schema if not isinstance(f.dataType, T.NumericType)]
    if other:
        raise TypeError(f"not numbers: {', '.join(other)}")
    return df.agg(*[F.sum(f"`{c}`").alias(c) for c in df.columns])


def share_unlike(c: Column, value: str) -> Column:
    """Percentage of a group's rows with another value."""
    return 100 * F.avg((c != value).cast("double"))


#: Repeated keys that are told to all tasks; with more of them all items are grouped.
MOST_REPEATED = 100_000


def item_counts(df: DataFrame, key: str, items: Column, item: str, count: str, most_repeated: int = MOST_REPEATED) -> DataFrame:
    """``key``, each of its items and how often it has it; rows whose array is null or empty have none. Items aren't null.

    Items of a row are counted in the row, where they are sorted, and only those of keys that stand in several rows go
    through a shuffle. Which keys do is found by a pass over the keys alone.
    """
    rows = df.select(F.col(f"`{key}`").alias("k"), items.alias("a"))
    repeated = rows.groupBy("k").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select(F.col("k").alias("again"))
    some = repeated.limit(most_repeated + 1).count()
    grouped = lambda r: r.select("k", F.explode("a").alias("w")).groupBy("k", "w").agg(F.count(F.lit(1)).alias("n"))
    if some > most_repeated:
        return grouped(rows).toDF(key, item, count)
    same = F.col("k").eqNullSafe(F.col("again"))
    alone = rows.join(F.broadcast(repeated), same, "left_anti") if some else rows
    # arrays that lambdas read are columns of their own, made once a row
    alone = alone.where(F.size("a") > 0).select("k", F.array_sort("a").alias("a"))
    first = F.filter(F.sequence(F.lit(0), F.size("a") - 1), lambda i: (i == 0) | (F.get("a", i) != F.get("a", i - 1)))
    alone = alone.select("k", "a", first.alias("first"))
    runs = F.transform("first", lambda i, j: F.struct(F.get("a", i).alias("w"), (F.coalesce(F.get("first", j + 1), F.size("a")) - i).cast("long").alias("n")))
    out = alone.select("k", F.inline(runs))
    if some:
        out = out.union(grouped(rows.join(F.broadcast(repeated), same, "left_semi")))
    return out.toDF(key, item, count)
