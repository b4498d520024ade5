"""Session helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import io
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and all executors see.

    It lies in spark.checkpoint.dir. Where that is unset (tests on a local master) the
    driver's temporary folder serves; on a cluster the setting is required.
    """
    base = spark.conf.get("spark.checkpoint.dir", "")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/caudal/{name}-{uuid.uuid4().hex}"


def table(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there, and a lost executor loses nothing."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once per application, so that their workers import it from any folder."""
    context = spark.sparkContext
    if getattr(context, "_caudal_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    with zipfile.ZipFile(packed := io.BytesIO(), "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, f"{package.name}/{file.relative_to(package)}")
    target = Path(tempfile.mkdtemp(prefix="spark-")) / f"{package.name}_package.zip"
    target.write_bytes(packed.getvalue())
    context.addPyFile(str(target))
    context._caudal_shipped = True


def small_batches(spark: SparkSession, records: int = 1000) -> None:
    """Bounds what a Python worker holds at once, since one text can be long; also ships the code."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(records))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def give_back() -> None:
    """Hands freed memory back to the system, since a worker is used again by later stages and its heap else stays as large as it ever was."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidied(run: Callable) -> Callable:
    """run (of batches), with give_back() after every fourth batch and the last one."""

    def inner(batches: Iterator) -> Iterator:
        for n, batch in enumerate(run(batches), 1):
            yield batch
            if n % 4 == 0:
                give_back()
        give_back()

    return inner


def smallest(df: DataFrame, key: str, salt: int, most: int) -> DataFrame:
    """At most so many rows of df, those of the smallest salted hash of key (ties by all columns); null keys are left out.

    A threshold on the hash, set from the (estimated) count of distinct keys, comes first, so that no task hands the driver much more
    than its share; four times as many keys as asked for pass it, however often each is repeated.
    """
    known = df.filter(F.col(key).isNotNull())
    share = min(1.0, 4 * most / max(1, known.agg(F.approx_count_distinct(key)).first()[0]))
    hashed = F.xxhash64(F.lit(salt), key)
    if share < 1:
        known = known.filter(F.pmod(hashed, F.lit(1 << 30)) < int(share * (1 << 30)))
    return known.orderBy(F.pmod(hashed, F.lit(1 << 30)), *sorted(df.columns)).limit(most)
