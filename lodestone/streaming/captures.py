"""Captures that arrive as frames: authenticated chunks put together in state keyed by request.

A frame carries one chunk of a snapshot with its place, whether it is the last, the whole's SHA-256, the session's life and a message code over
all other fields. Frames may come in any order. A request is decided once, by the first of these: a frame that fails a check (its
reason), all chunks there (complete, or hash_mismatch), or LIFE after its first frame (expired). What comes later is not looked at. The batch
form and the stream run the same `Assembly` over a request's frames by time, so any cut into micro-batches gives the same decisions
as long as a request's frames are not handed over behind the watermark.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import hmac
import json
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.sources.capture import MAX_CHUNK_BYTES, MAX_SNAPSHOT_BYTES

#: How far clocks may differ; how long a request stays open.
SKEW_US = LIFE_US = 120_000_000
FRAME = "request_id string, session string, issued_us long, expires_us long, sequence int, final boolean, bytes int, body string, content_hash string, at_us long, mac string"
NAMES = tuple(f.split()[0] for f in FRAME.split(", "))
DECISION = "request_id string, status string, n_frames int, n_bytes long, content_hash string, decided_us long"


def code(frame: dict, key: bytes) -> str:
    """HMAC-SHA256 of the frame's fields but for the code and the time it was received, as JSON with sorted keys."""
    signed = {k: v for k, v in frame.items() if k not in ("mac", "at_us")}
    return hmac.new(key, json.dumps(signed, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode(), hashlib.sha256).hexdigest()


def chunk(frame: dict, key: bytes) -> tuple[str | None, bytes]:
    """Why a frame is refused, or None and its bytes."""
    if not hmac.compare_digest(code(frame, key), frame["mac"] or ""):
        return "authentication_failed", b""
    at, issued, expires = frame["at_us"], frame["issued_us"], frame["expires_us"]
    if expires <= issued or expires <= at or issued - at > SKEW_US:
        return "session_expired", b""
    try:
        data = base64.b64decode(frame["body"], validate=True)
    except (binascii.Error, ValueError):
        return "payload_integrity_failed", b""
    if not data or len(data) != frame["bytes"] or len(data) > MAX_CHUNK_BYTES:
        return "payload_too_large", b""
    return None, data


class Assembly:
    """The open state of one request; what it holds is bounded by MAX_SNAPSHOT_BYTES."""

    def __init__(self, key: bytes, saved: str | None = None):
        self.key, self.chunks, self.first, self.last, self.hash, self.done = key, {}, None, None, None, False
        if saved:
            chunks, self.first, self.last, self.hash, self.done = json.loads(saved)
            self.chunks = {int(k): base64.b64decode(v) for k, v in chunks.items()}

    def saved(self) -> str:
        return json.dumps([{k: base64.b64encode(v).decode() for k, v in self.chunks.items()}, self.first, self.last, self.hash, self.done])

    def _decide(self, frame: dict, status: str, at: int) -> dict:
        size = sum(map(len, self.chunks.values()))
        out = {"request_id": frame["request_id"], "status": status, "n_frames": len(self.chunks), "n_bytes": size, "content_hash": self.hash if status == "complete" else None, "decided_us": at}
        self.chunks, self.done = {}, True
        return out

    def add(self, frame: dict) -> dict | None:
        """The decision that this frame brings, if it does."""
        if self.done:
            return None
        if self.first is None:
            self.first = frame["at_us"]
        if frame["at_us"] > self.first + LIFE_US:
            return self.expired(frame["request_id"])
        problem, data = chunk(frame, self.key)
        if problem:
            return self._decide(frame, problem, frame["at_us"])
        self.hash = self.hash or frame["content_hash"]
        place, last = frame["sequence"], frame["sequence"] if frame["final"] else self.last
        if frame["content_hash"] != self.hash or place < 0 or self.chunks.get(place, data) != data or (self.last is not None and last != self.last):
            return self._decide(frame, "payload_integrity_failed", frame["at_us"])
        self.last = last
        self.chunks[place] = data
        if sum(map(len, self.chunks.values())) > MAX_SNAPSHOT_BYTES:
            return self._decide(frame, "snapshot_too_large", frame["at_us"])
        if self.last is not None and max(self.chunks) > self.last:
            return self._decide(frame, "payload_integrity_failed", frame["at_us"])
        if self.last is None or len(self.chunks) <= self.last:
            return None
        whole = hashlib.sha256(b"".join(self.chunks[i] for i in range(self.last + 1))).hexdigest()
        return self._decide(frame, "complete" if whole == self.hash else "hash_mismatch", frame["at_us"])

    def expired(self, request_id: str) -> dict | None:
        return None if self.done or self.first is None else self._decide({"request_id": request_id}, "expired", self.first + LIFE_US)


def signed(frames: DataFrame, key: bytes) -> DataFrame:
    """frames: FRAME without mac. Adds the code, as a sender would."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            mac = [code({k: r[k] for k in NAMES if k != "mac"}, key) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(mac, pa.string())], names=[*batch.schema.names, "mac"])

    return frames.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frames.schema) + ", mac string")


def assembled(frames: DataFrame, key: bytes) -> DataFrame:
    """DECISION for each request of a whole table: rows are sorted by request and time and read once; a task holds the request at hand."""
    rows = frames.select(*NAMES).repartition("request_id").sortWithinPartitions("request_id", "at_us", "sequence")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        at, book, columns = None, None, [f.split()[0] for f in DECISION.split(", ")]
        types = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64()]
        batch_of = lambda found: pa.RecordBatch.from_arrays([pa.array([d[c] for d in found], t) for c, t in zip(columns, types, strict=True)], names=columns)
        for batch in batches:
            found = []
            for frame in batch.to_pylist():
                if frame["request_id"] != at:
                    if book and (d := book.expired(at)):
                        found.append(d)
                    at, book = frame["request_id"], Assembly(key)
                if d := book.add(frame):
                    found.append(d)
            yield batch_of(found)
        if book and (d := book.expired(at)):
            yield batch_of([d])

    return rows.mapInArrow(run, DECISION)


def assembled_stream(frames: DataFrame, key: bytes, late_us: int = LIFE_US) -> DataFrame:
    """The same decisions from a stream of frames; a request that stays open expires when the watermark (`late_us` behind the latest frame) passes its
    life, and its state stays until frames that could still come are behind the watermark too."""
    import pandas as pd

    timed = frames.select(*NAMES, F.timestamp_micros("at_us").alias("at")).withWatermark("at", f"{late_us} microseconds")
    columns = [f.split()[0] for f in DECISION.split(", ")]

    def run(request, parts, state):
        book = Assembly(key, state.get[0] if state.exists else None)
        found = []
        if state.hasTimedOut:
            if d := book.expired(request[0]):
                found.append(d)
            state.remove()
        else:
            rows = pd.concat(parts).sort_values(["at_us", "sequence"])
            for r in rows.to_dict("records"):
                frame = {k: None if r[k] is None else r[k] for k in NAMES}
                frame |= {k: int(frame[k]) for k in ("issued_us", "expires_us", "sequence", "bytes", "at_us")} | {"final": bool(frame["final"])}
                if d := book.add(frame):
                    found.append(d)
            state.update((book.saved(),))
            state.setTimeoutTimestamp(max((book.first + LIFE_US) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(found, columns=columns)

    return timed.groupBy("request_id").applyInPandasWithState(run, DECISION, "memory string", "append", "EventTimeTimeout")
