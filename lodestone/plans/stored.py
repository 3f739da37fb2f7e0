"""Tables that are derived from a folder of input tables once and then read by all queries: the full-text index and the vectors of active passages.

They stand in the shared folder under a name made of the input's path, and carry a digest of the input files (path, size, time of change); where
that differs from the files as they are now, they are made again.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import SparkSession

from lodestone.operators.segments import TextIndex
from lodestone.operators.vectors import VectorStore
from lodestone.plans import canonical as C
from lodestone.plans import generations
from lodestone.plans.storage import shared_dir


#: Part of the digest, so that tables of another form are made again.
FORMAT = "segments 3, vectors 1"


def source_digest(spark: SparkSession, path: str) -> str:
    """Digest of a table's files: one line for each file reaches the driver, as in any listing of a scan."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    found, files = [FORMAT], fs.listFiles(at, True)
    while files.hasNext():
        f = files.next()
        found.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()


def place(spark: SparkSession, sf_dir: str, name: str) -> str:
    return f"{shared_dir(spark)}/lodestone-{name}-{hashlib.sha256(sf_dir.encode()).hexdigest()[:16]}"


def text_index(spark: SparkSession, sf_dir: str) -> TextIndex:
    """The index of all canonical passages; built when it is first asked for, or when documents have changed."""
    now = source_digest(spark, f"{sf_dir}/documents.parquet")
    path = place(spark, sf_dir, "text-index")
    index = TextIndex(spark, path)
    if index.state["source"] != now:
        generations.drop(spark, path)
        index = TextIndex(spark, path).upsert(C.passages(spark, sf_dir).drop("text"), now)
    return index


def vectors(spark: SparkSession, sf_dir: str) -> VectorStore:
    """The vectors of all passages of the index; refreshed where documents have changed."""
    index = text_index(spark, sf_dir)
    store = VectorStore(spark, place(spark, sf_dir, "vectors"))
    return store if store.state["source"] == index.state["source"] else store.refresh(index.passages(), index.state["source"])
