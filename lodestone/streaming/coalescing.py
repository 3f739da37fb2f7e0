"""Coalescing of observation events on a stream, in state keyed by root and path.

An event is taken apart into what it does to each path before it meets any state: a rename removes the old path and changes the new one, with
the event's number. The state of a path is the largest (number, part) with what it says, so it does not depend on how
the stream is cut or in which order its parts arrive. A root's counts are kept under an empty path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def moves(events: DataFrame) -> DataFrame:
    """events: root, seq, kind, path, previous_path. root, path, seq, sub, state; and, for each event, a row with an empty path that counts it."""
    part = lambda path, state, sub: F.struct(path.alias("path"), F.lit(state).alias("state"), F.lit(sub).alias("sub"))
    event = part(F.lit("").cast("string"), "event", 0)
    path, kind = F.col("path"), F.col("kind")
    parts = (
        F.when(kind == "renamed", F.array(event, part(F.col("previous_path"), "removed", 0), part(path, "changed", 1))).when(kind == "removed", F.array(event, part(path, "removed", 0)))
        .when(kind.isin("created", "modified"), F.array(event, part(path, "changed", 0))).otherwise(F.array(event))
    )
    return events.select("root", "seq", (kind == "overflow").alias("overflow"), F.explode(parts).alias("m")).select("root", "seq", "overflow", "m.*")


def states(events: DataFrame) -> DataFrame:
    """One row per root and path (batch), or the state of a stream (output mode update or complete): state, seq, events and overflow; the
    last two are of use where the path is empty."""
    last = F.max(F.struct("seq", "sub", "state"))
    return moves(events).groupBy("root", "path").agg(last.alias("last"), F.count("*").alias("events"), F.max("overflow").alias("overflow")).select("root", "path", F.col("last.state").alias("state"), F.col("last.seq").alias("seq"), "events", "overflow")


def coalesced(held: DataFrame, max_events: int) -> DataFrame:
    """held: of `states`. root, path and state of the roots that need no full rescan."""
    whole = held.where((F.col("path") == "") & (F.col("overflow") | (F.col("events") > max_events))).select(F.col("root").alias("whole"))
    return held.where("path <> ''").join(whole, F.col("root").eqNullSafe(F.col("whole")), "left_anti").select("root", "path", "state")
