"""The bounded job queue: admission, claim sequence with a burst limit, retries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_PENDING, MAX_RECORDS, BURST, TOP_PRIORITY = 128, 4_096, 4, 2


def admitted(requests: DataFrame, max_records: int = MAX_RECORDS) -> DataFrame:
    """requests: queue, seq, key, operation, priority. admitted, repeated, conflict or refused.

    The first request of a key decides; later ones repeat it or conflict. New keys beyond max_records are refused."""
    key = Window.partitionBy("queue", "key").orderBy("seq")
    rows = requests.withColumns({"nth": F.row_number().over(key), "op": F.first("operation").over(key), "pr": F.first("priority").over(key)})
    new = F.when(F.col("nth") == 1, 1).otherwise(0)
    rows = rows.withColumn("record", F.sum(new).over(Window.partitionBy("queue").orderBy("seq")))
    first = F.max(F.when(F.col("nth") == 1, F.col("record"))).over(Window.partitionBy("queue", "key"))
    rows = rows.withColumn("own", first)
    outcome = F.when(F.col("own") > max_records, "refused").when(F.col("nth") == 1, "admitted").when((F.col("op") == F.col("operation")) & (F.col("pr") == F.col("priority")), "repeated").otherwise("conflict")
    return rows.withColumn("outcome", outcome).drop("nth", "op", "pr", "record", "own")


def claim_sequence(jobs: DataFrame, burst: int = BURST) -> DataFrame:
    """jobs: queue, sequence, priority (0 to 2). The order in which a queue is claimed: by priority, then sequence; after
    `burst` claims of the top priority in a row the oldest job is taken.

    Each choice needs the one before, and a queue has MAX_RECORDS jobs at most, so a queue is one group."""
    import pandas as pd

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        import heapq

        by_priority = [(-p, s) for s, p in zip(frame["sequence"], frame["priority"], strict=True)]
        by_age = [(s, p) for s, p in zip(frame["sequence"], frame["priority"], strict=True)]
        heapq.heapify(by_priority)
        heapq.heapify(by_age)
        done, streak, order = set(), 0, []
        while len(order) < len(frame):
            forced = streak >= burst
            if forced:
                sequence, priority = heapq.heappop(by_age)
            else:
                priority, sequence = heapq.heappop(by_priority)
                priority = -priority
            if sequence in done:
                continue
            done.add(sequence)
            order.append((sequence, priority))
            streak = streak + 1 if priority == TOP_PRIORITY and not forced else 0
        out = pd.DataFrame(order, columns=["sequence", "priority"])
        out["queue"], out["claim"] = frame["queue"].iloc[0], range(1, len(out) + 1)
        return out[["queue", "sequence", "priority", "claim"]]

    return jobs.select("queue", "sequence", "priority").groupBy("queue").applyInPandas(run, "queue long, sequence long, priority int, claim long")


def next_states(jobs: DataFrame) -> DataFrame:
    """jobs: state, attempts, max_attempts, cancel_requested, failed. What a settled job becomes."""
    state = F.when(F.col("cancel_requested"), "cancelled").when(~F.col("failed"), "completed").when(F.col("attempts") < F.col("max_attempts"), "retryable").otherwise("failed")
    return jobs.withColumn("next_state", F.when(F.col("state") == "running", state).otherwise(F.col("state")))


def directory_quanta(progress: DataFrame, files: DataFrame) -> DataFrame:
    """progress: job_id, next_unit, fingerprint; files: job_id, unit, path, fingerprint (of the folder as it is now).
    job_id, action, unit, path: what the next claim of each job does.

    One file a claim (`process`); after the last one the final `reconcile`; a folder whose names have changed since starts
    again (`restart`), as does one that is gone or empty while units were done. An empty folder at unit 0 reconciles."""
    now = files.groupBy("job_id").agg(F.count("*").alias("total"), F.first("fingerprint").alias("scan"))
    rows = progress.select("job_id", "next_unit", "fingerprint").join(now, "job_id", "left").withColumn("total", F.coalesce("total", F.lit(0)))
    same = F.coalesce(F.col("scan") == F.col("fingerprint"), F.col("next_unit") == 0)
    action = F.when(~same, "restart").when(F.col("next_unit") < F.col("total"), "process").otherwise("reconcile")
    rows = rows.select("job_id", action.alias("action"), F.when(action == "process", F.col("next_unit")).alias("unit"))
    return rows.join(files.select("job_id", "unit", "path"), ["job_id", "unit"], "left").select("job_id", "action", "unit", "path")


def directory_stream(spark, path: str, handle):
    """A folder as a stream of one file a micro-batch: handle(rows, epoch) gets path, modificationTime, length, content;
    start it with a checkpoint, from which it goes on after an interruption."""
    columns = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.schema(columns).format("binaryFile").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).load(path)
    return files.writeStream.foreachBatch(handle)
