"""Helpers shared by the operators of this package."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession

#: Tables whose rows are texts.
SPREAD = ("documents", "pages")
#: Words per NumPy block inside a Python task; one document longer than this is a block of its own.
BLOCK_WORDS = 400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables. A small file that gives fewer partitions than there are cores is dealt over all
    cores; larger tables stay as they are read."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name in SPREAD and df.rdd.getNumPartitions() < cores else df


#: With this, the shuffle files of a write go when it has ended; its table takes their place.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Only where the session names none and runs on one machine (tests) is a temporary folder set."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        where = known.get() if known.isDefined() else None
    if not where:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        where = tempfile.mkdtemp(prefix="lodestone-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back.

    This cuts the lineage, so a lost executor costs a re-read and not a recomputation, and a
    table that several passes read is computed once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestone-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    kept = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, kept)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that `staged` has written, once nothing reads them any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.staged_at)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def blocks(sizes: np.ndarray, most: int):
    """Slices (start, end) of consecutive items with at most `most` in total, one item at least."""
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield start, i
            start, held = i, 0
        held += int(n)
    if start < len(sizes):
        yield start, len(sizes)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (Stafford's variant 13)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def utf8_column(column) -> list[bytes | None]:
    """The values of an Arrow string column as UTF-8 bytes, nulls kept."""
    import pyarrow as pa

    return column.cast(pa.large_binary()).to_pylist()
