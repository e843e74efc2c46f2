"""Helpers shared by the operators: word rules, tables, shared-folder storage."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.storage import drop, fresh_path, scratch, stored

__all__ = ["drop", "fresh_path", "scratch", "stored"]

#: The white space of the word rule ``[^\x20\x09-\x0D]+``.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
#: The most rows of a batch between Spark and Python.
BATCH_ROWS = 2000
#: Keys with more than one row in HOT are hot: there are fewer than HOT of them, however large a table is.
HOT = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` under ``sf_dir``, through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Gives this package to the Python workers, once per application.

    Executors need not have it installed: it goes out as a zip file with
    Spark's own distribution of Python files.  Batches handed to Python are
    held to BATCH_ROWS rows, as texts are long and a worker holds a batch in
    several forms at once.
    """
    context = spark.sparkContext
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    if getattr(context, "_tessera_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    with tempfile.TemporaryDirectory() as d:
        shutil.copytree(package, f"{d}/in/{package.name}", ignore=shutil.ignore_patterns("__pycache__"))
        context.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp(prefix='tessera-')}/{package.name}", "zip", f"{d}/in"))
    context._tessera_shipped = True


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text; no words for null."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_RUN))


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once for each row.

    A lambda that reads an array expression evaluates it again for every
    element; going through a one-element array binds the result to a variable.
    """
    return F.transform(F.array(value), body)[0]


def held_out(doc_id: Column) -> Column:
    """Rows whose crc32(doc_id as text) mod 3 is 1; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def joined(rows: DataFrame, stats: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` with the columns of ``stats``, which has one row for each key and, as ``n``, its number of rows.

    ``total``: the rows of ``rows``.  Hot keys, of which there are fewer than
    HOT, meet their statistics by broadcast, so their rows stay where they are;
    the other keys are joined by a shuffle that gives no task more than a
    HOT-th of all rows for one key.  Keys without statistics drop out.
    """
    stats = stored(stats, "stats")
    hot = stats.where(F.col("n") * HOT > total).collect()
    if not hot:
        return rows.join(stats, key)
    is_hot = F.col(key).isin([r[key] for r in hot])
    few = F.broadcast(rows.sparkSession.createDataFrame(hot, stats.schema))
    return rows.where(is_hot).join(few, key).unionByName(rows.where(~is_hot).join(stats, key))
