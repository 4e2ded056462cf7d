"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: str | Column) -> Column:
    """Words of a text; a null text has none."""
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares, from spark.checkpoint.dir; where that is unset, a temporary one, in local mode only."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="clauselake-"))
        shared = spark.sparkContext.getCheckpointDir()
    return shared


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """The session's setting holds inside."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


#: Deletes the files of a job's shuffles when it ends: its rows are in a table then.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Tables written inside each `scratch` that is open, innermost last.
_open: list[list[str]] = []


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def new_path(spark: SparkSession) -> str:
    """A new folder in the shared one, deleted with the innermost open `scratch`."""
    path = f"{shared_dir(spark)}/clauselake-{uuid.uuid4().hex}"
    if _open:
        _open[-1].append(path)
    return path


def durable(df: DataFrame) -> DataFrame:
    """The same rows read back from Parquet in the shared folder: lineage is cut, and a lost executor costs nothing.

    The shuffles behind them are then of no use, and their files are deleted.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession)
    with setting(spark, FREE_SHUFFLES, "true"):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """`durable`, dealt into files by a hash of `key`: what is grouped or joined by it then moves the other side only."""
    spark, path = df.sparkSession, new_path(df.sparkSession)
    name = path.rsplit("/", 1)[1].replace("-", "_")
    with setting(spark, FREE_SHUFFLES, "true"):
        df.write.bucketBy(buckets, key).option("path", path).saveAsTable(name)
    out = spark.table(name)
    # The files stay, and `out` knows how they are dealt; the catalog need not.
    spark.sql(f"drop table {name}")
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that `durable` wrote; nothing may read them any more."""
    for df in tables:
        _delete(df.sparkSession, df.stored_at)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that `durable` writes inside are deleted at the end, but for those passed through the function that this gives."""
    kept: list[DataFrame] = []
    _open.append([])
    try:
        yield lambda df: kept.append(df) or df
    finally:
        mine, stay = _open.pop(), {df.stored_at for df in kept}
        for path in mine:
            if path not in stay:
                _delete(spark, path)
        if _open:
            _open[-1].extend(stay)


def arrow_bytes(spark: SparkSession, most: int):
    """Jobs run inside send batches of about `most` bytes to Python: long texts otherwise make batches of any size."""
    return setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", str(most))


def small_batches(spark: SparkSession, most: int = 8_000_000) -> None:
    """From now on, batches to Python have about `most` bytes at most.

    A job that a caller starts reads the session's setting when it runs, so this stays set; it changes no result.
    """
    now = re.fullmatch(r"(\d+)b?", spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch"))
    if not now or not 0 < int(now[1]) <= most:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most))


def buckets_for(rows: int, each: int) -> int:
    return max(1, -(-rows // each))


def range_bucket(key: Column, buckets: int) -> Column:
    """Of `buckets` equal ranges of a uniformly random 64-bit key, the one it lies in: ascending with the unsigned key."""
    return F.floor(F.shiftrightunsigned(key, 11).cast("double") * F.lit(buckets / 9007199254740992.0)).cast("long")
