"""Streams with state by key, in a state store: incremental scans, and admission to a bounded number of slots.

Both are stateful processors of Structured Streaming (transformWithState) over the RocksDB store: state is partitioned
by key, kept off heap, changed in place and written to the checkpoint as it changes, so a batch costs what arrives and not
what is known, and a restart goes on where the checkpoint stands. `rocksdb()` chooses the store for a query.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

MINUTE = 60_000_000
STORE = "spark.sql.streaming.stateStore.providerClass"
#: Whether the store counts its rows, for which it reads the old value before each write.
COUNTED = "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows"
#: Rows of a state value at most.
CHUNK = 1 << 16
#: Groups in which the paths of an incremental scan are kept.
SHARDS = 1 << 12


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries that are started within it keep their state in RocksDB; the session's own settings come back after."""
    old = {k: spark.conf.get(k, None) for k in (STORE, COUNTED)}
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set(COUNTED, "false")
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _packed(rows: list[tuple], schema: pa.Schema) -> list[tuple[bytes]]:
    """Rows as values of a state, each an Arrow stream of CHUNK rows: a store reads and writes each value on its own."""
    out = []
    for at in range(0, len(rows), CHUNK):
        columns = zip(*rows[at : at + CHUNK], strict=True)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, schema) as w:
            w.write_batch(pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema))
        out.append((sink.getvalue().to_pybytes(),))
    return out


def _unpacked(values) -> list[tuple]:
    return [r for (v,) in values for r in zip(*(c.to_pylist() for c in pa.ipc.open_stream(v).read_all().columns), strict=True)]


# incremental scans


class LastHash(StatefulProcessor):
    """Keeps the last hash of each path of a shard and lets rows through whose hash differs from it."""

    SCHEMA = pa.schema([("path", pa.string()), ("sha256", pa.string())])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getListState("known", "rows binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frames = list(rows)  # what one batch has of a shard
        frame = frames[0] if len(frames) == 1 else pd.concat(frames)
        frame = frame.sort_values("revision", kind="stable")
        known = dict(_unpacked(self.known.get()))
        keep = []
        for path, value in zip(frame["path"], frame["sha256"], strict=True):
            path = None if pd.isna(path) else path
            keep.append(known.get(path) != value)
            known[path] = value
        if any(keep):
            self.known.put(_packed(list(known.items()), self.SCHEMA))
            yield frame[keep]

    def close(self) -> None:
        pass


def changed_stream(files: DataFrame, revision: str | None = None, text: bool = True) -> DataFrame:
    """A stream of files (path, text) -> path, revision, sha256, text of those that are new or differ from what their path
    had last. Rows of a path that meet in one batch count in order of the column `revision`; batches count in turn. A
    null text is an empty file; a null path is a path like others. text: whether texts come along, which are shuffled
    then; without them only their hashes are. State is kept by shards of paths, as a call for each path would cost more than
    its row: a batch rewrites the shards that change, one of SHARDS parts of what is known each."""
    order = F.col(revision).cast("long") if revision else F.lit(0).cast("long")
    body = F.coalesce("text", F.lit(""))
    shard = F.pmod(F.xxhash64("path"), F.lit(SHARDS)).cast("int")
    rows = files.select(shard.alias("_shard"), "path", order.alias("revision"), F.sha2(body, 256).alias("sha256"), *[body.alias("text")] * text)
    return rows.groupBy("_shard").transformWithStateInPandas(LastHash(), "path string, revision long, sha256 string" + ", text string" * text, "Append", "None")


def scan_stream(files: DataFrame, scan, checkpoint: str, revision: str | None = None, **trigger):
    """Start to scan a stream of files: scan takes the new and changed ones (path, revision, sha256, text) of each batch,
    once unless the batch is repeated after a failure. The checkpoint holds the state. The running query."""
    with rocksdb(files.sparkSession):
        return changed_stream(files, revision).writeStream.foreachBatch(lambda df, _: scan(df)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


# admission


class Slots(StatefulProcessor):
    """Admits the requests of a key in order of (at, request) to `most` slots; a slot returns when its request is done or
    after `hold` microseconds, and goes to the longest waiting request at that time.

    Rows are kept until the watermark has passed them, so that those that come out of order count in order. What happens
    up to the watermark is then worked off in one go; a timer waits for the next row or the next slot that returns."""

    ROW = pa.schema([("at", pa.int64()), ("request", pa.string())])
    INBOX = ROW.append(pa.field("done", pa.bool_()))

    def __init__(self, most: int, hold: int):
        self.most, self.hold = most, hold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.inbox, self.waiting, self.active = (handle.getListState(name, "rows binary") for name in ("inbox", "waiting", "active"))

    def _timer(self, at: int | None) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if at is not None:
            self.handle.registerTimer(-(-at // 1000))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first: int | None = None
        for frame in rows:
            new = [(int(a), str(r), bool(d)) for a, r, d in zip(frame["at"], frame["request"], frame["done"], strict=True)]
            self.inbox.appendList(_packed(new, self.INBOX))
            first = min([*([] if first is None else [first]), *(a for a, _, _ in new)])
        if first is not None:
            timers = list(self.handle.listTimers())
            if not timers or -(-first // 1000) < min(timers):
                self._timer(first)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()) * 1000
        inbox = sorted(_unpacked(self.inbox.get()), key=lambda x: (x[0], not x[2], x[1]))  # at one time slots return before they are asked for
        waiting, active = _unpacked(self.waiting.get()), _unpacked(self.active.get())
        out, behind = [], 0

        def admit(at: int) -> None:
            nonlocal behind
            while behind < len(waiting) and len(active) < self.most:
                asked, request = waiting[behind]
                behind += 1
                active.append((at, request))
                out.append((*key, request, asked, at))

        def returned(until: int) -> None:
            while active and (end := min(s for s, _ in active) + self.hold) <= until:
                active[:] = [x for x in active if x[0] + self.hold != end]
                admit(end)

        done = 0
        for at, request, over in inbox:
            if at > now:
                break
            done += 1
            returned(at)
            if over:
                active[:] = [x for x in active if x[1] != request]
            else:
                waiting.append((at, request))
            admit(at)
        returned(now)
        for state, rows, schema in ((self.inbox, inbox[done:], self.INBOX), (self.waiting, waiting[behind:], self.ROW), (self.active, active, self.ROW)):
            state.put(_packed(rows, schema)) if rows else state.clear()
        nexts = [inbox[done][0]] if done < len(inbox) else []
        if active and behind < len(waiting):
            nexts.append(min(s for s, _ in active) + self.hold)
        self._timer(min(nexts) if nexts else None)
        if out:
            yield pd.DataFrame(out, columns=["key", "request", "at", "admitted"])

    def close(self) -> None:
        pass


def admissions(requests: DataFrame, most: int = 4, hold_minutes: float = 5, delay: str = "1 minute") -> DataFrame:
    """A stream of requests (key, request, at timestamp, optionally done) -> key, request, at, admitted_at: at most `most`
    of a key are at work at a time, others wait for their turn. A row with done says that a request is over; without one
    its slot returns after hold_minutes. Rows may come out of order by `delay`; later ones count as late as they come. The
    stream's clock is its watermark: a source that falls silent needs rows of another key to move it."""
    done = F.col("done") if "done" in requests.columns else F.lit(False)
    rows = requests.withWatermark("at", delay).select(F.col("key").cast("string").alias("key"), F.col("request").cast("string").alias("request"), F.unix_micros("at").alias("at"), done.alias("done"))  # no time as such: pandas has none after 2262
    made = rows.groupBy("key").transformWithStateInPandas(Slots(most, round(hold_minutes * MINUTE)), "key string, request string, at long, admitted long", "Append", "EventTime")
    return made.select("key", "request", F.timestamp_micros("at").alias("at"), F.timestamp_micros("admitted").alias("admitted_at"))


# running a stream over what is there


def drained(stream: DataFrame, folder: str) -> str:
    """Run a stream over all that its source holds now, with its checkpoint and its Parquet rows in a folder; again, with
    more in the source, it goes on. Where the rows are."""
    with rocksdb(stream.sparkSession):
        query = stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    return f"{folder}/rows"
