"""Generations of a derived table: written aside, made current by one rename, checked against their source when read; and
work that can be cancelled between its units."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTER = "current.json"


def _files(spark: SparkSession, path: str):
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(jvm.org.apache.hadoop.fs.Path(path).toUri(), spark._jsparkSession.sessionState().newHadoopConf())
    return context, jvm.org.apache.hadoop.fs


def pointer(spark: SparkSession, path: str) -> dict | None:
    """The manifest of the current generation: name, rows, source."""
    context, fs = _files(spark, path)
    at = fs.Path(f"{path}/{POINTER}")
    if not context.util().exists(at):
        return None
    held = context.open(at)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(held, "UTF-8"))
    finally:
        held.close()


def manifest(spark: SparkSession, path: str) -> dict | None:
    """What `replace_manifest` has last put under a path."""
    return pointer(spark, path)


def replace_manifest(spark: SparkSession, path: str, state: dict) -> None:
    """Write `state` aside and make it current by one rename."""
    context, fs = _files(spark, path)
    aside = fs.Path(f"{path}/.{uuid.uuid4().hex}.pointer")
    out = aside.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).create(aside, True)
    out.write(json.dumps(state).encode())
    out.close()
    overwrite = spark.sparkContext._gateway.new_array(fs.Options.Rename, 1)
    overwrite[0] = fs.Options.Rename.OVERWRITE
    context.rename(aside, fs.Path(f"{path}/{POINTER}"), overwrite)


def publish(df: DataFrame, path: str, source: str) -> dict:
    """Write `df` as a new generation and make it current. source: digest of what it was made from.

    Readers see the old generation or the new one; a write that fails leaves the old one current."""
    spark = df.sparkSession
    name = f"generation-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{name}")
    state = {"name": name, "rows": spark.read.parquet(f"{path}/{name}").count(), "source": source}
    replace_manifest(spark, path, state)
    return state


def current(spark: SparkSession, path: str, source: str) -> DataFrame | None:
    """The current generation, or None if there is none or its source has changed since: the derived table is then invalid."""
    state = pointer(spark, path)
    return spark.read.parquet(f"{path}/{state['name']}") if state and state["source"] == source else None


def drop(spark: SparkSession, path: str) -> None:
    """Remove the pointer and all generations."""
    context, fs = _files(spark, path)
    if context.util().exists(fs.Path(path)):
        context.delete(fs.Path(path), True)


def invalid(derived: DataFrame, source: DataFrame) -> DataFrame:
    """Both: id, hash. Ids of derived rows whose source row has changed (`changed`) or is gone (`gone`), and of source rows
    without a derived one (`absent`)."""
    d, s = derived.select("id", F.col("hash").alias("made")), source.select("id", F.col("hash").alias("now"))
    why = F.when(F.col("now").isNull(), "gone").when(F.col("made").isNull(), "absent").when(F.col("made") != F.col("now"), "changed")
    return d.join(s, "id", "full_outer").select("id", why.alias("why")).where("why is not null")


class Cancelled(RuntimeError):
    """Work that was stopped between two units."""


class Cancellation:
    """A token for units of work: `run` stops before the next unit once `cancel` was called, and `cancel` interrupts the
    Spark jobs of the unit at hand, known by their tag."""

    def __init__(self, spark: SparkSession):
        self.spark, self.tag, self.stopped = spark, f"lodestone-{uuid.uuid4().hex}", False

    def cancel(self) -> None:
        self.stopped = True
        self.spark.interruptTag(self.tag)

    def run(self, units: Iterable[Callable[[], object]]) -> list:
        done = []
        for unit in units:
            if self.stopped:
                raise Cancelled(f"stopped after {len(done)} units")
            self.spark.addTag(self.tag)
            try:
                done.append(unit())
            finally:
                self.spark.removeTag(self.tag)
        return done
