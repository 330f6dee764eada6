"""Many files read as one table: numbered and templated sets, whose parts become columns.

A template such as ``orders-<Status>-<Day.Year><Day.Month><Day.Day>.txt`` has parts, each with
an expansion: ``enum:A;B``, ``intrange:1...3`` or ``daterange:2013-03-29...2013-03-31``, ends
included. Several parts give every combination. Files are read in one scan; the parts'
values come from the files' names.
"""

from __future__ import annotations

import datetime as dt
import re
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.session import delete, exists, hadoop, names, rename

_PART = re.compile(r"<(\w+)(?:\.(Year|Month|Day))?>")
_WIDTH = {"Year": 4, "Month": 2, "Day": 2}


def expand(expansion: str) -> list:
    """The values of an expansion: strings, ints or dates."""
    kind, _, spec = expansion.partition(":")
    if kind == "enum":
        return [x for x in spec.split(";") if x]
    low, sep, high = spec.partition("...")
    if not sep:
        raise ValueError(f"not a range: {expansion!r}")
    if kind == "intrange":
        a, b = int(low), int(high)
        if a < 0 or b < 0 or a > b:
            raise ValueError(f"not a range of numbers: {expansion!r}")
        return list(range(a, b + 1))
    if kind == "daterange":
        a, b = dt.date.fromisoformat(low), dt.date.fromisoformat(high)
        if a > b:
            raise ValueError(f"not a range of days: {expansion!r}")
        return [a + dt.timedelta(n) for n in range((b - a).days + 1)]
    raise ValueError(f"unknown expansion: {expansion!r}")


def fill(template: str, values: dict[str, object]) -> str:
    """The file name of one combination of values."""

    def one(m: re.Match) -> str:
        v = values[m[1]]
        return f"{getattr(v, m[2].lower()):0{_WIDTH[m[2]]}d}" if m[2] else v.isoformat() if isinstance(v, dt.date) else str(v)

    return _PART.sub(one, template)


def members(template: str, expansions: dict[str, str]) -> list[str]:
    """All file names of a set."""
    named = {m[1] for m in _PART.finditer(template)}
    if named != set(expansions):
        raise ValueError(f"template and expansions differ: {sorted(named ^ set(expansions))}")
    lists = {k: expand(v) for k, v in expansions.items()}
    return [fill(template, dict(zip(lists, combo))) for combo in product(*lists.values())]


def _pattern(template: str, expansions: dict[str, str]) -> tuple[str, list[tuple[str, str | None]]]:
    out, groups, at = "", [], 0
    for m in _PART.finditer(template):
        kind = expansions[m[1]].partition(":")[0]
        out += re.escape(template[at : m.start()])
        out += f"(\\d{{{_WIDTH[m[2]]}}})" if m[2] else r"(\d+)" if kind == "intrange" else r"(\d{4}-\d{2}-\d{2})" if kind == "daterange" else "(" + "|".join(map(re.escape, expand(expansions[m[1]]))) + ")"
        groups.append((m[1], m[2]))
        at = m.end()
    # a member is a file, or a folder of part files
    return "(?:^|/)" + out + re.escape(template[at:]) + "(?:/[^/]*)?$", groups


def with_parts(df: DataFrame, template: str, expansions: dict[str, str]) -> DataFrame:
    """Adds a typed column for each part, from the names of the files that rows come from.

    ``df`` must come straight from a file scan and have ``_metadata.file_path`` as ``_file``.
    """
    pattern, groups = _pattern(template.rpartition("/")[2], {k: v for k, v in expansions.items() if f"<{k}" in template.rpartition("/")[2]})
    found: dict[str, dict] = {}
    for i, (name, field) in enumerate(groups):
        found.setdefault(name, {})[field] = F.regexp_extract("_file", pattern, i + 1)
    columns = []
    for name, parts in found.items():
        kind = expansions[name].partition(":")[0]
        if kind == "intrange":
            c = parts[None].cast("int")
        elif kind == "daterange":
            c = parts[None].cast("date") if None in parts else F.make_date(*[parts[x].cast("int") if x in parts else F.lit(1) for x in ("Year", "Month", "Day")])
        else:
            c = parts[None]
        columns.append(c.alias(name))
    return df.select("*", *columns).drop("_file")


def _in_set(keys: dict[str, Column], expansions: dict[str, str]) -> Column:
    """Whether a row's parts are values of the set, part by part, so that no list of members is needed."""
    every = F.lit(True)
    for name, c in keys.items():
        values = expand(expansions[name])
        kind = expansions[name].partition(":")[0]
        every = every & (c.cast("string").isin(values) if kind == "enum" else c.cast("int" if kind == "intrange" else "date").between(values[0], values[-1]))
    return every


def write_set(df: DataFrame, folder: str, template: str, expansions: dict[str, str], keys: dict[str, Column], columns: list[str], write: Callable, threads: int = 16) -> None:
    """Writes ``columns`` of the rows of each member as a folder of its name, all in one job; ``write(writer, path)`` chooses the format.

    ``keys`` are the values of the parts. Rows of no member aren't written, members without rows have an empty folder; a member with many rows
    is dealt over several tasks. The set is put together in a folder beside: a new set appears by one
    rename; members of a set that is there already are moved in one by one and taken out again if one of them can't be.
    A write that fails leaves no member.
    """
    spark, wanted = df.sparkSession, members(template, expansions)
    pieces, at = [], 0
    for m in _PART.finditer(template):
        pieces.append(F.lit(template[at : m.start()]))
        value = keys[m[1]]
        pieces.append(F.date_format(value, {"Year": "yyyy", "Month": "MM", "Day": "dd"}[m[2]]) if m[2] else value.cast("string"))
        at = m.end()
    there = names(spark, folder)
    if clash := sorted(there & set(wanted)):
        raise FileExistsError(f"members are there already: {clash[:3]}")
    rows = df.where(_in_set(keys, expansions)).withColumn("_member", F.concat(*pieces, F.lit(template[at:]))).select(*columns, "_member")
    rows = rows.repartitionByRange("_member", F.xxhash64(*columns)).sortWithinPartitions("_member")
    beside = f"{folder}-{uuid.uuid4().hex}"
    try:
        write(rows.write.partitionBy("_member"), f"{beside}/all")
        fs, _ = hadoop(spark, beside)
        path = spark._jvm.org.apache.hadoop.fs.Path
        written = names(spark, f"{beside}/all")
        target = folder if there else f"{beside}/set"
        moved = []

        def put(name: str) -> None:
            new = path(f"{target}/{name}")
            if not (fs.rename(path(f"{beside}/all/_member={name}"), new) if f"_member={name}" in written else fs.mkdirs(new)):
                raise OSError(f"member {name} can't be put in place")
            moved.append(name)

        if not there:
            fs.mkdirs(path(target))
        with ThreadPoolExecutor(threads) as pool:
            try:
                list(pool.map(put, wanted))
            except BaseException:
                pool.shutdown(wait=True, cancel_futures=True)
                for name in moved if there else []:
                    delete(spark, f"{target}/{name}")
                raise
        if not there:
            delete(spark, folder)  # an empty folder is no set
            rename(spark, target, folder)
    finally:
        delete(spark, beside)


def read_set(spark: SparkSession, folder: str, template: str, expansions: dict[str, str], read, sparse: bool = False) -> DataFrame:
    """The rows of all members, with the parts as columns. ``read(paths)`` makes one scan.

    A dense set fails if a member is missing; a sparse one leaves missing members out. Each folder is listed once.
    """
    wanted = members(template, expansions)
    listed = {x: names(spark, f"{folder}/{x}".rstrip("/")) for x in {m.rpartition("/")[0] for m in wanted}}
    there = [m for m in wanted if m.rpartition("/")[2] in listed[m.rpartition("/")[0]]]
    if not there or len(there) < len(wanted) and not sparse:
        missing = sorted(set(wanted) - set(there))
        raise FileNotFoundError(f"[PATH_NOT_FOUND] members of {folder}/{template} are missing: {missing[:3]}{' ...' if len(missing) > 3 else ''}")
    # Spark lists members in tasks, one each unless told otherwise
    tasks = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(tasks)
    spark.conf.set(tasks, str(4 * spark.sparkContext.defaultParallelism))
    try:
        df = read([f"{folder}/{m}" for m in there])
    finally:
        spark.conf.set(tasks, before)
    return with_parts(df.select("*", F.col("_metadata.file_path").alias("_file")), template, expansions)


def numbered(spark: SparkSession, folder: str, pattern: str, low: int, high: int, read, sparse: bool = False) -> DataFrame:
    """A set whose file names hold a number, ``%n`` in ``pattern``, from low to high; column ``serial``."""
    return read_set(spark, folder, pattern.replace("%n", "<serial>"), {"serial": f"intrange:{low}...{high}"}, read, sparse)


def most_recent(spark: SparkSession, paths: list[str]) -> str:
    """The first path that exists; the last is the default and isn't looked for."""
    for p in paths[:-1]:
        if exists(spark, p):
            return p
    return paths[-1]
