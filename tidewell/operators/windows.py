"""Window operators that Spark lacks, or would run in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.session import cut


def _join_back(df: DataFrame, by: list[str], sums: DataFrame) -> DataFrame:
    """df with the columns of ``sums``, whose keys may be null."""
    names = [c for c in sums.columns if c not in by]
    right = sums.select(*[F.col(c).alias(f"_{c}") for c in by], *names)
    on = None
    for c in by:
        one = F.col(c).eqNullSafe(F.col(f"_{c}"))
        on = one if on is None else on & one
    return df.join(right, on, "left").drop(*[f"_{c}" for c in by])


def over_distinct(df: DataFrame, by: list[str], column: str, name: str, how=F.sum) -> DataFrame:
    """``how`` of the distinct values of a column in each partition; nulls don't count.

    Distinct values are summed first and joined back, null keys with null keys.
    """
    sums = df.select(*by, column).distinct().groupBy(*by).agg(how(column).alias(name))
    return _join_back(df, by, sums)


def with_total(df: DataFrame, **totals: Column) -> DataFrame:
    """Adds aggregates of all rows to each row: one row is broadcast, no window over all rows."""
    return df.crossJoin(F.broadcast(df.agg(*[c.alias(n) for n, c in totals.items()])))


def numbered(df: DataFrame, *order: str, name: str = "number") -> DataFrame:
    """Gapless numbers from 1 in an order, whatever the size: ranges are dealt and their counts added up."""
    at = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    at = cut(at)
    part = F.shiftright("_at", 33)
    counts = at.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    out = at.withColumn("_part", part).join(F.broadcast(before), "_part")
    return out.withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_at", "_part", "_before")


def top_in_group(df: DataFrame, by: list[str], order: list[Column], n: int, rank=F.row_number) -> DataFrame:
    """The rows of each group whose rank is at most n; Spark cuts each task's groups before the shuffle."""
    return df.withColumn("_rank", rank().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_rank") <= n).drop("_rank")


def positions(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """by, order, _n, _before, _index, _total: the rows of each value of ``order``, the rows and values before it, and all rows of its group.

    However few and large the groups are, values are counted first, their counts are added up in ranges of values,
    and the ranges' sums, a row for each range of a group, are added up and broadcast.
    """
    counts = df.groupBy(*by, *order).agg(F.count(F.lit(1)).alias("_n")).repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id())
    local = Window.partitionBy("_part", *by).orderBy(*order)
    at = cut(counts).withColumn("_before", F.sum("_n").over(local.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).withColumn("_index", F.row_number().over(local) - 1)
    sums = at.groupBy("_part", *by).agg(F.sum("_n").alias("_s"), F.count(F.lit(1)).alias("_d"))
    parts = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    sums = sums.select("_part", *by, F.coalesce(F.sum("_s").over(parts), zero).alias("_rows"), F.coalesce(F.sum("_d").over(parts), zero).alias("_values"), F.sum("_s").over(Window.partitionBy(*by)).alias("_total"))
    right = sums.select(F.col("_part").alias("_p"), *[F.col(c).alias(f"_{c}") for c in by], "_rows", "_values", "_total")
    on = F.col("_part") == F.col("_p")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    out = at.join(F.broadcast(right), on)
    return out.select(*by, *order, "_n", (F.col("_before") + F.col("_rows")).alias("_before"), (F.col("_index") + F.col("_values")).alias("_index"), "_total")


def ranked(df: DataFrame, by: list[str], order: list[str], **ranks: str) -> DataFrame:
    """df with ranks by name: ``rank``, ``dense_rank``, ``cume_dist``, ``percent_rank``, ``row_number`` or ``ntile(n)``.

    For the last two, ``order`` must tell all rows of a group apart. No group is sorted in one task.
    """
    at = positions(df, by, order)
    number, total = F.col("_before") + 1, F.col("_total")

    def one(kind: str) -> Column:
        if kind in ("rank", "row_number"):
            return number
        if kind == "dense_rank":
            return F.col("_index") + 1
        if kind == "cume_dist":
            return (F.col("_before") + F.col("_n")) / total
        if kind == "percent_rank":
            return F.when(total == 1, 0.0).otherwise(F.col("_before") / (total - 1))
        n = int(kind.removeprefix("ntile(").removesuffix(")"))
        size, more = F.floor(total / n), total % n
        large = more * (size + 1)  # the first tiles have one row more
        return F.when(F.col("_before") < large, F.floor(F.col("_before") / (size + 1))).otherwise(more + F.floor((F.col("_before") - large) / F.greatest(size, F.lit(1)))) + 1

    at = at.select(*by, *order, *[one(kind).alias(name) for name, kind in ranks.items()])
    return _join_back(df, [*by, *order], at)


def over_percentile(df: DataFrame, by: list[str], column: str, share: float, name: str, discrete: bool = False) -> DataFrame:
    """df with an exact percentile of its group: interpolated, or the first value whose share of rows is enough."""
    at = positions(df.where(F.col(column).isNotNull()), by, [column])
    if discrete:
        found = at.where((F.col("_before") + F.col("_n")) >= F.lit(share) * F.col("_total")).groupBy(*by).agg(F.min(column).alias(name))
    else:
        place = F.lit(share) * (F.col("_total") - 1)
        low, high = F.floor(place), F.ceil(place)
        inside = lambda x: (F.col("_before") <= x) & (x < F.col("_before") + F.col("_n"))
        ends = at.where(inside(low) | inside(high)).groupBy(*by).agg(F.min(column).alias("_a"), F.max(column).alias("_b"), F.max(place - low).alias("_f"))
        found = ends.select(*by, (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_f")).alias(name))
    return _join_back(df, by, found)
