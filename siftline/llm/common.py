"""Small helpers shared by the operators: column names, row keys, durable tables."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def fresh(taken: DataFrame | list[str], *wanted: str) -> list[str]:
    """Names like ``wanted`` that clash with no column of ``taken`` (case does not count)."""
    used = {c.lower() for c in (taken.columns if isinstance(taken, DataFrame) else taken)}
    out = []
    for name in wanted:
        while name.lower() in used:
            name = "_" + name
        used.add(name.lower())
        out.append(name)
    return out


def col(name: str) -> Column:
    """A column by its exact name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def require(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme and host of its Hadoop file system; a bare path lies on the default one."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; one of our own where that is unset and all run on this machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            path = held.get()
        elif spark.sparkContext.master.split("[")[0] == "local":
            path = tempfile.mkdtemp(prefix="siftline-")
            spark.sparkContext.setCheckpointDir(path)
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return qualified(spark, path).rstrip("/")


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """pyarrow's file system and path for a qualified Hadoop path, for use in workers."""
    scheme, _, rest = uri.partition(":")
    if scheme in ("s3a", "s3n"):
        uri = f"s3:{rest}"
    elif scheme == "dbfs":
        return pafs.LocalFileSystem(), f"/dbfs/{rest.lstrip('/')}"
    elif scheme == "file":
        return pafs.LocalFileSystem(), "/" + rest.lstrip("/")
    return pafs.FileSystem.from_uri(uri)


_made: list[str] = []


def made(path: str) -> str:
    """Note a folder for ``forget``."""
    _made.append(path)
    return path


def durable(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there and no executor's loss undoes it."""
    spark = df.sparkSession
    path = made(f"{shared_dir(spark)}/table-{uuid.uuid4().hex}")
    df.write.parquet(path, compression=codec)
    spark.sparkContext._jvm.System.gc()  # the shuffle files that led here go when the driver collects their handles
    return spark.read.schema(df.schema).parquet(path)


def mark() -> int:
    """The number of folders noted so far."""
    return len(_made)


def forget(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Delete the folders noted since a ``mark``, but for the last ``keep``; call it when what was made of them has been stored."""
    jvm = spark.sparkContext._jvm
    gone = _made[since : len(_made) - keep]
    del _made[since : len(_made) - keep]
    for name in gone:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def other_columns_hash(df: DataFrame, *but: str) -> Column:
    """A value that orders repeated rows by their other columns, whatever the types."""
    rest = [col(c) for c in df.columns if c not in but]
    return F.to_json(F.struct(*rest)) if rest else F.lit("")
