"""Tables and folders that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

KEY = "spark.checkpoint.dir"
#: Folders of applications on local masters that name none; Spark lets no session set the entry. They go with the process.
_OWN: dict[str, str] = {}
#: With this, Spark removes a query's shuffle files as soon as it has ended.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _hadoop(spark: SparkSession, path: str) -> tuple:
    """(Hadoop's path, its file system)."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def configured(spark: SparkSession) -> str | None:
    return spark.conf.get(KEY, None)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, with its scheme. Where that is unset and the master is local, one of our own.

    A path without a scheme lies in Hadoop's default file system, as it does for Spark.
    """
    if found := configured(spark):
        at, fs = _hadoop(spark, found.rstrip("/"))
        return fs.makeQualified(at).toString()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{KEY} must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file:" + tempfile.mkdtemp(prefix="sarvgrid-")
        atexit.register(shutil.rmtree, _OWN[app].removeprefix("file:"), ignore_errors=True)
    return _OWN[app]


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path with a scheme, and the path in it, for files that executors write themselves.

    Spark's names of stores are taken: s3a and s3n are S3, dbfs is the folder it is mounted at. Others are pyarrow's: file, hdfs, s3,
    gs, abfs and abfss. What it doesn't know is an error.
    """
    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        return pafs.LocalFileSystem(), path
    if scheme in ("file", "dbfs"):
        return pafs.LocalFileSystem(), ("/dbfs/" if scheme == "dbfs" else "/") + rest.lstrip("/")
    try:
        return pafs.FileSystem.from_uri(f"s3:{rest}" if scheme in ("s3a", "s3n") else path)
    except pa.ArrowInvalid as e:
        raise ValueError(f"executors can't write files of their own to {scheme}: ({e}); let {KEY} name a folder in another store") from e


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Queries in here leave no shuffle files behind: what they write stands by itself."""
    before = spark.conf.get(CLEAN, None)
    spark.conf.set(CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEAN) if before is None else spark.conf.set(CLEAN, before)


def settle(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` written as Parquet to the shared folder and read back, which cuts its lineage; and the path."""
    path = fresh_path(df.sparkSession, name)
    with released(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    """Removes settled tables that no later plan reads."""
    for path in paths:
        at, fs = _hadoop(spark, path)
        fs.delete(at, True)


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` is called so in any case."""
    taken = {c.lower() for c in df.columns}
    while (name := f"_{name}").lower() in taken:
        pass
    return name


def parts(spark: SparkSession) -> int:
    """The session's number of shuffle partitions, which is how the deployment states the size of the data."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
