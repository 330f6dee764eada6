"""Ways to write a table: text, Parquet, clustered copies, side outputs, exports."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.sources.text import write_text


def write_table(df: DataFrame, path: str) -> None:
    df.write.parquet(path)


def write_clustered(df: DataFrame, path: str, keys: list[str], sort: list[Column] | None = None) -> None:
    """Files in which the rows of a key stand together, sorted if asked; a large key goes on over several files."""
    spread = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    out = df.repartitionByRange(*keys, *(sort or []), spread)
    out.sortWithinPartitions(*keys, *(sort or [])).write.parquet(path)


def save_bucketed(df: DataFrame, name: str, key: str, buckets: int, sort: str | None = None) -> None:
    """A table of the warehouse whose joins and groupings by ``key`` need no exchange."""
    w = df.write.mode("overwrite").format("parquet").bucketBy(buckets, key)
    (w.sortBy(sort) if sort else w).saveAsTable(name)


def write_bucketed(df: DataFrame, path: str, key: str, buckets: int, sort: str | None = None) -> None:
    """Files at ``path`` whose joins and groupings by ``key`` need no exchange, if read by ``read_bucketed``."""
    name = f"bucketed_{uuid.uuid4().hex}"
    w = df.write.format("parquet").option("path", path).bucketBy(buckets, key)
    try:
        (w.sortBy(sort) if sort else w).saveAsTable(name)
    finally:
        # the files stay; the catalogue, which may outlive them, keeps nothing
        df.sparkSession.sql(f"drop table if exists {name}")


def read_bucketed(spark: SparkSession, path: str, schema: T.StructType, key: str, buckets: int, sort: str | None = None) -> DataFrame:
    name = f"bucketed_{uuid.uuid4().hex}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    order = f"sorted by (`{sort}`)" if sort else ""
    spark.sql(f"create table {name} ({columns}) using parquet clustered by (`{key}`) {order} into {buckets} buckets location '{path}'")
    try:
        return spark.table(name)
    finally:
        spark.sql(f"drop table {name}")


def write_ordered(df: DataFrame, path: str, *order) -> None:
    """Part files in a global order: ranges are dealt, each sorted; no single task."""
    df.orderBy(*order).write.parquet(path)


def write_by(df: DataFrame, path: str, *columns: str, mode: str = "error") -> None:
    """One folder for each value, all in one job; a value with many rows goes on over several files and tasks.

    ``mode``: ``error`` if there is something, or ``replace`` the folders of the values that the rows have, and no others.
    """
    spread = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    w = df.repartitionByRange(*columns, spread).sortWithinPartitions(*columns).write.partitionBy(*columns)
    w = w.mode("overwrite").option("partitionOverwriteMode", "dynamic") if mode == "replace" else w
    w.parquet(path)


def write_both(df: DataFrame, path: str) -> None:
    """A structured and a text copy under derived names; the text is made from the structured copy, so rows are computed once."""
    df.write.parquet(f"{path}.ss")
    write_text(df.sparkSession.read.schema(df.schema).parquet(f"{path}.ss"), f"{path}.tsv")


def write_routed(df: DataFrame, path: str, outputs: dict[str, tuple[Column, list[Column]]], counters: dict[str, Column] | None = None) -> dict[str, object]:
    """Several outputs and counters of one pass over ``df``, in one write job.

    ``outputs``: for each name a condition and named columns. A row goes to every output whose condition holds. Each output has a
    folder of its own below ``path``, which ``read_routed`` reads. ``counters`` are aggregates over all rows of ``df``, and come back
    when the outputs stand; they cost no pass of their own.
    """
    watch = Observation()
    if counters:
        df = df.observe(watch, *[c.alias(n) for n, c in counters.items()])
    kinds = {n: df.select(*columns).schema for n, (_, columns) in outputs.items()}
    empty = {n: F.lit(None).cast(k) for n, k in kinds.items()}
    routed = []
    for n, (condition, columns) in outputs.items():
        values = [F.struct(*columns).cast(kinds[n]).alias(f"o{i}") if m == n else empty[m].alias(f"o{i}") for i, m in enumerate(outputs)]
        routed.append(F.when(condition, F.struct(F.lit(n).alias("output"), *values)))
    one = df.select(F.explode(F.array_compact(F.array(*routed))).alias("r")).select("r.*")
    one.write.partitionBy("output").parquet(path)
    return watch.get if counters else {}


def read_routed(spark: SparkSession, path: str, outputs: list[str], name: str, schema: str | T.StructType) -> DataFrame:
    """The rows of one output; ``outputs``: the names of all, in their order."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    fields = T.StructType([T.StructField(f"o{outputs.index(name)}", schema), T.StructField("output", T.StringType())])
    return spark.read.schema(fields).parquet(path).where(F.col("output") == name).select(f"o{outputs.index(name)}.*")


def flat(df: DataFrame, item: str = ";", pair: str = "=") -> DataFrame:
    """Arrays and maps as text: items in order, map entries by key."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.ArrayType):
            c = F.array_join(F.transform(c, lambda x: x.cast("string")), item)
        elif isinstance(f.dataType, T.MapType):
            entries = F.array_sort(F.transform(F.map_entries(c), lambda e: F.concat_ws(pair, e["key"].cast("string"), e["value"].cast("string"))))
            c = F.array_join(entries, item)
        out.append(c.alias(f.name))
    return df.select(*out)


def export_csv(df: DataFrame, path: str, columns: list[str] | None = None, top: int | None = None, sep: str = ",", header: bool = True, line_sep: str = "\n") -> None:
    out = df.select(*columns) if columns else df
    out = out.limit(top) if top is not None else out
    out.write.options(sep=sep, header=header, lineSep=line_sep).csv(path)


def schema_rows(df: DataFrame) -> DataFrame:
    """ordinal, name, type, provider (the class of the type), nullable of each column."""
    rows = [(i, f.name, f.dataType.simpleString(), type(f.dataType).__name__, f.nullable) for i, f in enumerate(df.schema)]
    return df.sparkSession.createDataFrame(rows, "ordinal int, name string, type string, provider string, nullable boolean")


def client_rows(df: DataFrame, most: int = 10_000):
    """An iterator of all rows for the client, a partition at a time; more than ``most`` are an error after the last of them."""
    for n, row in enumerate(df.limit(most + 1).toLocalIterator()):
        if n == most:
            raise ValueError(f"more than {most} rows")
        yield row
