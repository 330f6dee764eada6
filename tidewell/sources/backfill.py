"""A table of days that is filled in and filled again: runs that know which days are done.

Below a path stand ``data``, a folder for each day, and ``done``, a table of finished days. A run works on the days that aren't finished, newest
first and in batches; each batch is one job, whose days replace their folders and no others, and are then
put down as finished. A run that fails or is stopped leaves finished days and whole folders only, so the next one goes on with the
missing ones. A day is done again if asked for by name.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterable
from itertools import batched

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.session import delete, exists, names
from tidewell.sources import sinks

DONE = "day date, n_rows long, at timestamp"


def days_between(first: dt.date, last: dt.date) -> list[dt.date]:
    return [first + dt.timedelta(n) for n in range((last - first).days + 1)]


def finished(spark: SparkSession, path: str) -> DataFrame:
    """day, n_rows, at of each finished day, as it was last done."""
    if not exists(spark, f"{path}/done"):
        return spark.createDataFrame([], DONE)
    rows = spark.read.schema(DONE).parquet(f"{path}/done")
    last = rows.groupBy("day").agg(F.max(F.struct("at", "n_rows")).alias("m"))
    return last.select("day", "m.n_rows", "m.at")


def run(spark: SparkSession, rows: Callable[[list[dt.date]], DataFrame], path: str, days: Iterable[dt.date], *, day: str = "day", again: Iterable[dt.date] = (), batch: int = 32) -> list[dt.date]:
    """Fills in the days of ``days`` that aren't finished, and those of ``again`` in any case; gives the days that it has done.

    ``rows(days)``: the rows of some days, with a date column ``day``. A day without rows is finished too, and has no folder.
    Large days are dealt over several tasks and files.
    """
    done = {r.day for r in finished(spark, path).select("day").collect()}
    again = set(again)
    todo = sorted((set(days) - done) | again, reverse=True)
    data = f"{path}/data"
    for some in batched(todo, batch):
        some, folders = list(some), {d: f"{data}/{day}={d.isoformat()}" for d in some}
        before = {d: names(spark, folders[d]) for d in some if d in again}
        sinks.write_by(rows(some).where(F.col(f"`{day}`").isin(some)), data, day, mode="replace")
        for d, old in before.items():
            # a day that is done again and has no rows any more has replaced nothing
            if old and old == names(spark, folders[d]):
                delete(spark, folders[d])
        counts = spark.read.schema(f"`{day}` date").parquet(data).where(F.col(f"`{day}`").isin(some)).groupBy(F.col(f"`{day}`").alias("day")).agg(F.count(F.lit(1)).alias("n_rows"))
        log = spark.createDataFrame([(d,) for d in some], "day date").join(counts, "day", "left")
        log = log.select("day", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.lit(dt.datetime.now(dt.timezone.utc)).cast("timestamp").alias("at"))
        log.coalesce(1).write.mode("append").parquet(f"{path}/done")
    return todo


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all days; ``schema`` has the day's column too, by which folders are picked."""
    return spark.read.schema(schema).parquet(f"{path}/data")
