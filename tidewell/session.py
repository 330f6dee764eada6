"""Small helpers about the running session."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per application."""
    sc = spark.sparkContext
    if getattr(sc, "_tidewell_shipped", False):
        return
    top = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="tidewell-"), "tidewell.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    sc.addPyFile(path)
    sc._tidewell_shipped = True


#: Bytes of an Arrow batch for a Python worker; JVM and worker hold more than one copy of it. Spark's own bound is 64 MB.
BATCH = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of this session are of some BATCH bytes or one row, as 10,000 texts are tens of MB; a bound that a user set stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name).rstrip("b") == str(64 << 20):
        spark.conf.set(name, str(BATCH))


def shared_dir(spark: SparkSession) -> str:
    """A folder that driver and executors share: this application's own below spark.checkpoint.dir where it is set, or
    below the folder of checkpoints that the context was given.

    Neither: below a temporary folder for a local master (driver and executors are one
    process), else below the warehouse, which a cluster shares. What is left in the folder
    when the application ends, and Spark's own folder of checkpoints, goes with it.
    """
    sc = spark.sparkContext
    if not getattr(sc, "_tidewell_shared", None):
        top = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
        if not top:
            local = sc.master.startswith("local[") or sc.master == "local"
            top = "file://" + tempfile.mkdtemp(prefix="spark-tidewell-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_tidewell"
            sc.setCheckpointDir(top)
        sc._tidewell_shared = f"{top.rstrip('/')}/tidewell-{uuid.uuid4().hex}"
        for path in (sc._tidewell_shared, sc.getCheckpointDir()):
            if path:
                p = spark._jvm.org.apache.hadoop.fs.Path(path)
                fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
                fs.mkdirs(p)
                fs.deleteOnExit(p)
    return sc._tidewell_shared


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def hadoop(spark: SparkSession, path: str):
    """(file system, path) of Hadoop, whatever store the path is in."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def delete(spark: SparkSession, path: str) -> None:
    fs, p = hadoop(spark, path)
    fs.delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = hadoop(spark, path)
    return bool(fs.exists(p))


def rename(spark: SparkSession, old: str, new: str) -> None:
    """Gives a file or folder a name that nothing has yet; a file system does that at once or not at all."""
    fs, a = hadoop(spark, old)
    b = spark._jvm.org.apache.hadoop.fs.Path(new)
    if fs.exists(b) or not fs.rename(a, b):
        raise FileExistsError(f"{old} can't be renamed to {new}")


def names(spark: SparkSession, folder: str) -> set[str]:
    """The names in a folder, by one listing; none if it isn't there."""
    fs, p = hadoop(spark, folder)
    if not fs.exists(p):
        return set()
    jvm = spark._jvm
    paths = jvm.org.apache.hadoop.fs.FileUtil.stat2Paths(fs.listStatus(p))
    # as one text, so that it is a few calls of the JVM, not some for each name
    plain = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, len(paths))
    jvm.java.lang.System.arraycopy(paths, 0, plain, 0, len(paths))
    return {x.rpartition("/")[2] for x in jvm.org.apache.commons.lang3.StringUtils.join(plain, "\n").split("\n") if x}


def write_small(spark: SparkSession, path: str, text: str) -> None:
    """A small file that appears at once under a name that nothing has yet."""
    temporary = f"{path}.{uuid.uuid4().hex}"
    fs, p = hadoop(spark, temporary)
    out = fs.create(p, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    rename(spark, temporary, path)


def read_small(spark: SparkSession, path: str) -> str:
    fs, p = hadoop(spark, path)
    file = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(file, "UTF-8")
    finally:
        file.close()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
