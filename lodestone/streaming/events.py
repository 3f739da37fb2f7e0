"""Observation events and capture state: coalescing, replay, rate limits, lifecycle, job order. Batch forms and streams with the same rules."""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.merges import root_status, upsert_versions

#: The legal moves of a capture.
MOVES = {
    ("requested", "accept"): "accepted", ("requested", "reject"): "rejected", ("requested", "expire"): "expired",
    ("accepted", "revoke"): "revoked", ("accepted", "delete"): "deleted", ("revoked", "repair"): "accepted", ("revoked", "delete"): "deleted",
}
PER_MINUTE = 4
#: Request ids and intents that a ledger remembers, and how long it knows a session.
MAX_REMEMBERED, SESSION_US, MINUTE_US = 4096, 86_400_000_000, 60_000_000


def coalesce(events: DataFrame, max_events: int) -> DataFrame:
    """events: batch, seq, kind, path, previous_path. Per batch and path the state that the last event leaves.

    A rename removes the old path and changes the new one. Batches with an overflow or more than max_events
    events ask for a full rescan and give no paths (see `plans`)."""
    moves = F.when(F.col("kind") == "renamed", F.array(F.struct(F.col("previous_path").alias("path"), F.lit("removed").alias("state"), F.lit(0).alias("sub")), F.struct(F.col("path"), F.lit("changed").alias("state"), F.lit(1).alias("sub"))))
    moves = moves.when(F.col("kind") == "removed", F.array(F.struct(F.col("path"), F.lit("removed").alias("state"), F.lit(0).alias("sub"))))
    moves = moves.when(F.col("kind").isin("created", "modified"), F.array(F.struct(F.col("path"), F.lit("changed").alias("state"), F.lit(0).alias("sub"))))
    each = events.select("batch", "seq", F.explode(moves).alias("m"))
    last = each.groupBy("batch", F.col("m.path").alias("path")).agg(F.max(F.struct("seq", "m.sub", "m.state"))["state"].alias("state"))
    whole = rescans(events, max_events).where("full_rescan").select("batch")
    return last.join(whole, "batch", "left_anti")


def rescans(events: DataFrame, max_events: int) -> DataFrame:
    n = events.groupBy("batch").agg(F.count("*").alias("events_received"), F.max(F.col("kind") == "overflow").alias("overflow"))
    return n.select("batch", "events_received", (F.col("overflow") | (F.col("events_received") > max_events)).alias("full_rescan"))


def plans(events: DataFrame, max_events: int) -> DataFrame:
    """Per batch: events received, coalesced paths, full rescan."""
    paths = coalesce(events, max_events).groupBy("batch").agg(F.count_if(F.col("state") == "changed").alias("changed"), F.count_if(F.col("state") == "removed").alias("removed"))
    return rescans(events, max_events).join(paths, "batch", "left").fillna(0, ["changed", "removed"])


def replay(requests: DataFrame) -> DataFrame:
    """requests: session, seq, counter, request_id. accept if the counter is above all before it in its session and the
    request id is new, else replay. Accepted counters rise, so the largest of all before decides."""
    w = Window.partitionBy("session").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    first = F.row_number().over(Window.partitionBy("request_id").orderBy("seq")) == 1
    fresh = F.coalesce(F.col("counter") > F.max("counter").over(w), F.lit(True))
    return requests.withColumn("decision", F.when(fresh & first, "accept").otherwise("replay"))


def rate_limit(requests: DataFrame, most: int = PER_MINUTE, window_us: int = 60_000_000) -> DataFrame:
    """requests: key, at_us, seq. accept or rate_limited: at most `most` accepted in a sliding window; a request at the
    window's end is outside; refused ones do not count.

    Each decision needs the ones before it, so rows are sorted by key and time and read once; a task holds only
    the last accepted times of the key at hand, whatever the key's size."""
    schema = requests.schema
    rows = requests.repartition("key").sortWithinPartitions("key", "at_us", "seq")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        key, accepted = object(), deque()
        for batch in batches:
            out = []
            for k, t in zip(batch.column("key").to_pylist(), batch.column("at_us").to_pylist(), strict=True):
                if k != key:
                    key, accepted = k, deque()
                while accepted and accepted[0] + window_us <= t:
                    accepted.popleft()
                if len(accepted) < most:
                    accepted.append(t)
                    out.append("accept")
                else:
                    out.append("rate_limited")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*batch.schema.names, "decision"])

    return rows.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema) + ", decision string")


def capture_time(issued_us: Column, expires_us: Column, intent_us: Column, now_us: Column, slack_us: int = 120_000_000) -> Column:
    """session_expired, capture_time_invalid or null."""
    expired = (expires_us <= issued_us) | (expires_us <= now_us) | (issued_us > now_us + slack_us)
    return F.when(expired, "session_expired").when(F.abs(intent_us - now_us) > slack_us, "capture_time_invalid")


def lifecycle(events: DataFrame) -> DataFrame:
    """events: capture, seq, event. Final state of each capture from `requested`, and the number of illegal moves, which change nothing.

    A capture has a handful of events; they are folded in order inside one row."""
    table = F.create_map(*(F.lit(x) for (a, b), c in MOVES.items() for x in (f"{a} {b}", c)))
    zero = F.struct(F.lit("requested").alias("state"), F.lit(0).alias("illegal"))

    def step(s: Column, e: Column) -> Column:
        after = F.try_element_at(table, F.concat_ws(" ", s["state"], e["event"]))
        return F.struct(F.coalesce(after, s["state"]).alias("state"), (s["illegal"] + F.when(after.isNull(), 1).otherwise(0)).alias("illegal"))

    rows = events.groupBy("capture").agg(F.array_sort(F.collect_list(F.struct("seq", "event"))).alias("e"))
    return rows.select("capture", F.aggregate("e", zero, step).alias("s")).select("capture", "s.state", F.col("s.illegal").cast("long").alias("illegal"))


def claim_order(jobs: DataFrame, key: str = "queue") -> DataFrame:
    """jobs: queue, priority, sequence. Order in which a queue's jobs are claimed: priority, then sequence."""
    w = Window.partitionBy(key).orderBy(F.col("priority").desc(), "sequence")
    return jobs.withColumn("claim", F.row_number().over(w).cast("long"))


def coalesced_stream(stream: DataFrame, max_events: int, sink):
    """A stream of events as coalesced micro-batches: `sink(paths, plans, epoch)` for each; start it with a checkpoint."""

    def handle(rows: DataFrame, epoch: int) -> None:
        own = rows.withColumn("batch", F.lit(epoch))
        sink(coalesce(own, max_events), plans(own, max_events), epoch)

    return stream.writeStream.foreachBatch(handle)


def _timed(stream: DataFrame, delay_us: int) -> DataFrame:
    """The stream with event time from at_us; rows later than the delay, or not after 1970, are dropped without a decision."""
    return stream.withColumn("event_time", F.timestamp_micros("at_us")).withWatermark("event_time", f"{-(-delay_us // 1000)} milliseconds")


def _expire(state, at_us: int) -> None:
    state.setTimeoutTimestamp(max(at_us // 1000 + 1, state.getCurrentWatermarkMs() + 1))


def rate_limit_stream(stream: DataFrame, most: int = PER_MINUTE, window_us: int = 60_000_000) -> DataFrame:
    """The rate limit on a stream; the state of a key is its accepted times in the window, and goes when the watermark (a window
    behind the latest row) has left the window."""
    import pandas as pd

    def run(key, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        accepted = deque(state.get[0]) if state.exists else deque()
        frame = pd.concat(frames).sort_values(["at_us", "seq"])
        out = []
        for t in frame["at_us"].tolist():
            while accepted and accepted[0] + window_us <= t:
                accepted.popleft()
            out.append("accept" if len(accepted) < most else "rate_limited")
            if out[-1] == "accept":
                accepted.append(t)
        state.update((list(accepted),))
        _expire(state, int(frame["at_us"].max()) + window_us)
        yield pd.DataFrame({"key": key[0], "at_us": frame["at_us"], "seq": frame["seq"], "decision": out})

    return _timed(stream, window_us).groupBy("key").applyInPandasWithState(run, "key long, at_us long, seq long, decision string", "accepted array<long>", "append", "EventTimeTimeout")


def reconciled(events: DataFrame, versions: DataFrame, scan: DataFrame) -> DataFrame:
    """What a batch of observations leads to: events are hints, so any event asks for a merge of the whole scan
    (`upsert_versions`); without events nothing happens and there are no rows."""
    hint = events.agg(F.count("*").alias("hints")).where("hints > 0").select("hints")
    return upsert_versions(versions, scan).crossJoin(F.broadcast(hint)).drop("hints")  # one row at most


def reconcile_stream(stream: DataFrame, versions: Callable[[], DataFrame], scan: Callable[[], DataFrame], sink: Callable[[DataFrame, int], None]):
    """`reconciled` for each micro-batch with events: versions and scan are read anew, sink(merged, epoch) keeps the result."""

    def handle(rows: DataFrame, epoch: int) -> None:
        if not rows.isEmpty():
            sink(upsert_versions(versions(), scan()), epoch)

    return stream.writeStream.foreachBatch(handle)


def startup(roots: DataFrame, versions: DataFrame, scan: DataFrame) -> DataFrame:
    """The reconcile of all roots at a start. roots: root_id, enabled, kind, probe; versions, scan: as for `upsert_versions`, with root_id.
    root_id, failure (null: reconciled), inserted, updated, reused, unchanged, missing.

    Revoked roots are left out; a root that is not available gives its status as failure and keeps its artifacts."""
    status = root_status(roots).where("status <> 'revoked'").select("root_id", F.when(F.col("status") != "available", F.col("status")).alias("failure"))
    good = status.where("failure is null").select("root_id")
    of = versions.select("artifact_id", "root_id").union(scan.select("artifact_id", "root_id")).distinct()
    merged = upsert_versions(versions.join(good, "root_id", "left_semi"), scan.join(good, "root_id", "left_semi")).join(of, "artifact_id")
    names = ("inserted", "updated", "reused", "unchanged", "missing")
    counts = merged.groupBy("root_id").agg(*(F.count_if(F.col("outcome") == n).alias(n) for n in names))
    return status.join(counts, "root_id", "left").fillna(0, list(names))


class Ledger:
    """What a replay ledger remembers, and its decisions in order. A counter must rise within its session, request ids and
    intents must be new, and at most `most` captures a minute are accepted; only accepted ones are remembered."""

    def __init__(self, most: int = PER_MINUTE, saved: str | None = None):
        self.most, self.sessions, self.accepted, self.requests, self.intents = most, {}, deque(), deque(), deque()
        if saved:
            sessions, accepted, requests, intents = json.loads(saved)
            self.sessions = {k: tuple(v) for k, v in sessions.items()}
            self.accepted, self.requests, self.intents = deque(accepted), deque(requests), deque(intents)
        self.known = (set(self.requests), set(self.intents))

    def saved(self) -> str:
        return json.dumps([self.sessions, list(self.accepted), list(self.requests), list(self.intents)])

    def decide(self, session: str, counter: int, request: str, intent: str, at_us: int) -> str:
        while self.accepted and self.accepted[0] + MINUTE_US <= at_us:
            self.accepted.popleft()
        last = self.sessions.get(session)
        if last and last[1] + SESSION_US <= at_us:
            last = self.sessions.pop(session) and None
        if (last and counter <= last[0]) or request in self.known[0] or intent in self.known[1]:
            return "replay"
        if len(self.accepted) >= self.most:
            return "rate_limited"
        self.sessions[session] = (counter, at_us)
        for held, known, value in ((self.requests, self.known[0], request), (self.intents, self.known[1], intent)):
            held.append(value)
            known.add(value)
            if len(held) > MAX_REMEMBERED:
                known.discard(held.popleft())
        if len(self.sessions) > MAX_REMEMBERED:
            self.sessions = {k: v for k, v in self.sessions.items() if v[1] + SESSION_US > at_us}
        self.accepted.append(at_us)
        return "accept"


LEDGER_COLUMNS = ("session", "counter", "request_id", "intent", "at_us")


def replay_ledger(requests: DataFrame, most: int = PER_MINUTE) -> DataFrame:
    """requests: ledger, session, counter, request_id, intent, at_us, seq. Each request with its decision: accept, replay or rate_limited.

    Rows are sorted by ledger and time and read once; a task holds the bounded memory of the ledger at hand."""
    names = ("ledger", *LEDGER_COLUMNS, "seq")
    rows = requests.select(*names).repartition("ledger").sortWithinPartitions("ledger", "at_us", "seq")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        key, book = object(), None
        for batch in batches:
            columns, out = batch.to_pydict(), []
            for i, ledger in enumerate(columns["ledger"]):
                if ledger != key:
                    key, book = ledger, Ledger(most)
                out.append(book.decide(*(columns[c][i] for c in LEDGER_COLUMNS)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*batch.schema.names, "decision"])

    return rows.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", decision string")


def replay_stream(stream: DataFrame, most: int = PER_MINUTE) -> DataFrame:
    """The replay ledger on a stream; the state is the ledger's memory, and goes a day after its last request by the watermark,
    which is two minutes behind the latest row."""
    import pandas as pd

    def run(key, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        book = Ledger(most, state.get[0] if state.exists else None)
        frame = pd.concat(frames).sort_values(["at_us", "seq"])
        rows = frame[list(LEDGER_COLUMNS)].itertuples(index=False)
        out = [book.decide(str(r.session), int(r.counter), str(r.request_id), str(r.intent), int(r.at_us)) for r in rows]
        state.update((book.saved(),))
        _expire(state, int(frame["at_us"].max()) + SESSION_US)
        yield pd.DataFrame({"ledger": key[0], "seq": frame["seq"], "decision": out})

    return _timed(stream, 2 * MINUTE_US).groupBy("ledger").applyInPandasWithState(run, "ledger string, seq long, decision string", "memory string", "append", "EventTimeTimeout")
