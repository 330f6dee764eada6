"""A second copy of a table, bucketed by another key, that follows its base.

The base is a folder of Parquet files that come and go. The copy is a list of generations, each a set of bucketed
files; every row has the number of the file that it came from. A refresh compares the base's files with those that the copy knows, writes
the rows of new files as one more generation, and lists files that are gone, whose rows readers leave out; nothing that stands is
touched. A manifest names generations, files with their numbers, and the numbers of gone files; no number is used twice. A new one is put in place by one rename, and readers
take the one of the highest number. When generations or gone files are many, the refresh writes one generation of what is left, bucket by
bucket, without an exchange. One refresh runs at a time; what a failed one has left goes with the next.

Groupings and joins by the key read all generations bucket by bucket, so they need no exchange either.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.session import delete, names, read_small, write_small
from tidewell.sources import sinks

#: Generations, and rows of gone files as a share of all, beyond which a refresh writes one generation.
MOST_GENERATIONS, MOST_GONE = 8, 0.25
_FILE = "_base_file"


def _base_files(spark: SparkSession, base: str) -> DataFrame:
    """file, path of each of the base's files; a file that is written anew under an old name is another file."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(base)
    return found.select(F.concat_ws("|", *_identity(F.col("path"), F.col("length"), F.col("modificationTime"))).alias("file"), "path")


def _identity(path, size, time) -> list[Column]:
    return [F.substring_index(path, "/", -1), size, F.unix_millis(time)]


def _rows(df: DataFrame, columns: list[str], numbers: dict[str, int]) -> DataFrame:
    """The rows of these files with their numbers; a file that was written anew since the listing isn't one of them."""
    listed = [(name, int(size), int(time), n) for f, n in numbers.items() for name, size, time in [f.rsplit("|", 2)]]
    files = df.sparkSession.createDataFrame(listed, "f0 string, f1 long, f2 long, n int")
    m = F.col("_metadata")
    here = _identity(m["file_path"], m["file_size"], m["file_modification_time"])
    rows = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)], *[x.alias(f"h{i}") for i, x in enumerate(here)])
    rows = rows.join(F.broadcast(files), [F.col(f"h{i}") == F.col(f"f{i}") for i in range(3)])
    return rows.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)], F.col("n").alias(_FILE))


def _manifests(spark: SparkSession, path: str) -> list[str]:
    return sorted(n for n in names(spark, path) if n.startswith("manifest-") and n.endswith(".json"))


def _manifest(spark: SparkSession, path: str) -> dict:
    found = _manifests(spark, path)
    if not found:
        raise FileNotFoundError(f"no copy at {path}")
    return json.loads(read_small(spark, f"{path}/{found[-1]}"))


def _put(spark: SparkSession, path: str, m: dict) -> None:
    """The next manifest; what only older ones name goes after it stands."""
    before = _manifests(spark, path)
    number = int(before[-1][9:-5]) + 1 if before else 0
    write_small(spark, f"{path}/manifest-{number:08d}.json", json.dumps(m))
    kept = {*m["generations"]}
    for n in names(spark, path):
        if n in before or n.startswith("g-") and n not in kept:
            delete(spark, f"{path}/{n}")


def create(spark: SparkSession, base: str, path: str, key: str, columns: list[str], buckets: int) -> dict[str, int]:
    """A copy of some columns of a base, bucketed and sorted by ``key``."""
    if _manifests(spark, path):
        raise FileExistsError(f"there is a copy at {path}")
    df = spark.read.parquet(base)
    schema = T.StructType([*[df.schema[c] for c in columns], T.StructField(_FILE, T.IntegerType())])
    return _advance(spark, path, {"base": base, "key": key, "columns": columns, "buckets": buckets, "schema": schema.jsonValue(), "generations": [], "files": {}, "next": 0, "gone": []}, MOST_GENERATIONS)


def _all_rows(spark: SparkSession, path: str, m: dict) -> DataFrame:
    """The rows of all generations but those of files that are gone."""
    out = None
    for g in m["generations"]:
        df = sinks.read_bucketed(spark, f"{path}/{g}", T.StructType.fromJson(m["schema"]), m["key"], m["buckets"], m["key"])
        out = df if out is None else out.union(df)
    if m["gone"]:
        # a list that a refresh keeps short against the copy; the join leaves rows in their buckets
        gone = spark.createDataFrame([(x,) for x in m["gone"]], f"{_FILE} int")
        out = out.join(F.broadcast(gone), _FILE, "left_anti")
    return out


def read(spark: SparkSession, path: str) -> DataFrame:
    m = _manifest(spark, path)
    return _all_rows(spark, path, m).select(*m["columns"])


def refresh(spark: SparkSession, path: str, most_generations: int = MOST_GENERATIONS) -> dict[str, int]:
    """Makes the copy follow its base; gives how many files were added and removed, and whether one generation was written."""
    return _advance(spark, path, _manifest(spark, path), most_generations)


def _written(df: DataFrame, path: str, m: dict) -> dict:
    """The manifest with one more generation, which has these rows."""
    name = f"g-{uuid.uuid4().hex}"
    sinks.write_bucketed(df, f"{path}/{name}", m["key"], m["buckets"], m["key"])
    return m | {"generations": [*m["generations"], name]}


def _advance(spark: SparkSession, path: str, m: dict, most_generations: int) -> dict[str, int]:
    now = {r.file: r.path for r in _base_files(spark, m["base"]).collect()}
    known = set(m["files"])
    added, removed = sorted(set(now) - known), sorted(known - set(now))
    if not added and not removed and m["generations"]:
        return {"added": 0, "removed": 0, "merged": 0}
    # a file that was gone and comes again has a new number, so its old rows stay away
    numbers = {f: m["next"] + i for i, f in enumerate(added)}
    gone = sorted([*m["gone"], *[m["files"][f] for f in removed]])
    m = m | {"files": {f: n for f, n in m["files"].items() if f in now} | numbers, "next": m["next"] + len(added), "gone": gone}
    if added:
        m = _written(_rows(spark.read.parquet(*[now[f] for f in added]), m["columns"], numbers), path, m)
    merged = len(m["generations"]) > most_generations or len(m["gone"]) > MOST_GONE * (len(now) + len(m["gone"]))
    if merged and m["generations"]:
        m = _written(_all_rows(spark, path, m).select(*T.StructType.fromJson(m["schema"]).names), path, m)
        m = m | {"generations": m["generations"][-1:], "gone": []}
    _put(spark, path, m)
    return {"added": len(added), "removed": len(removed), "merged": int(merged)}
