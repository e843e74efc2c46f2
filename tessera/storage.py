"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Paths made by this process and not yet removed, oldest first.
_MADE: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``.

    Where it is unset, a local session gets a temporary folder; on a cluster
    that is an error, as executors would each write to a folder of their own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


def stored(df: DataFrame, label: str, level: int = 3) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends at a table that survives lost executors.

    ``level``: how hard zstd tries, for tables that are large beside the input.
    """
    spark = df.sparkSession
    # shuffle files of the finished write are of no further use
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    path = fresh_path(spark, label)
    df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", str(level)).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


#: Rows up to which a stored table may be sent to every task.
FEW = 100_000


def joined_by(df: DataFrame, label: str) -> DataFrame:
    """``df`` stored, with the hint for joins that its rows ask for: broadcast if they are few, else merge.

    Without a hint the engine goes by the size on disk, which says little about
    ids that compress well.
    """
    out = stored(df, label)
    return F.broadcast(out) if out.count() <= FEW else out.hint("merge")


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder of any file system that Spark reaches."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    if path in _MADE:
        _MADE.remove(path)


def drop(df: DataFrame) -> None:
    """Removes a ``stored`` table that nothing reads any more."""
    remove(df.sparkSession, df.stored_at)


def clear(spark: SparkSession) -> None:
    """Removes all scratch tables; results that still read them must be written or collected before."""
    for path in list(_MADE):
        remove(spark, path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is stored inside the block goes at its end; results must be written inside it."""
    before = set(_MADE)
    try:
        yield
    finally:
        for path in [p for p in _MADE if p not in before]:
            remove(spark, path)
