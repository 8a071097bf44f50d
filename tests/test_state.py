"""Streams with state by key."""

import datetime as dt
import random

from pyspark.sql import functions as F

from palisade.streaming import state


def feed(spark, folder, rows, schema, files=1):
    spark.createDataFrame(rows, schema).repartition(files).write.mode("append").parquet(folder)


def test_changed_stream_over_restarts(spark, tmp_path):
    rng = random.Random(6)
    source, schema, want, known = f"{tmp_path}/in", "path string, text string, revision int", [], {}
    revision = 0
    old = spark.conf.get(state.STORE)
    for run in range(3):
        for _ in range(2 if run else 3):
            rows = [(f"p{i}" if i else None, rng.choice([None, "", "a", "b"]), revision) for i in range(12) if rng.random() < 0.7]
            rows += [(p, "twice", revision + 1) for p, _, _ in rows[:3]]  # two revisions of a path that may meet in a batch
            revision += 2
            feed(spark, source, rows, schema)
            for p, t, r in sorted(rows, key=lambda x: x[2]):
                if known.get(p, 0) != (t or ""):
                    want.append((p, r, t or ""))
                known[p] = t or ""
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        rows = state.drained(state.changed_stream(stream, "revision"), f"{tmp_path}/out")
        got = spark.read.schema("path string, revision long, sha256 string, text string").parquet(rows).select("path", "revision", "text").collect()
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
        rows = state.drained(state.changed_stream(stream, "revision", text=False), f"{tmp_path}/hashes")
        assert spark.read.schema("path string, revision long, sha256 string").parquet(rows).count() == len(want)
    assert spark.conf.get(state.STORE) == old


def plain_admissions(events, most, hold):
    """events: (at, request, done) of one key, in minutes."""
    waiting, active, out = [], [], []
    times = sorted({t for t, _, _ in events})
    clock = sorted(events, key=lambda x: (x[0], not x[2], x[1]))

    def admit(at):
        while waiting and len(active) < most:
            asked, r = waiting.pop(0)
            active.append((at, r))
            out.append((r, asked, at))

    def ends(until):
        while active and min(active)[0] + hold <= until:
            end = min(active)[0] + hold
            active[:] = [x for x in active if x[0] + hold != end]
            admit(end)

    for at, r, done in clock:
        ends(at)
        if done:
            active[:] = [x for x in active if x[1] != r]
        else:
            waiting.append((at, r))
        admit(at)
    ends(times[-1] + 10**6 if times else 0)
    return out


def test_admissions_out_of_order_with_early_ends(spark, tmp_path):
    rng = random.Random(7)
    base = dt.datetime(2024, 5, 1, tzinfo=dt.UTC)
    schema, source = "key string, request string, at timestamp, done boolean, extra int", f"{tmp_path}/in"
    events = {k: [] for k in ("a", "b", "busy")}
    for k, n in (("a", 12), ("b", 3), ("busy", 60)):
        for i in range(n):
            at = rng.randrange(0, 120)
            events[k].append((at, f"{k}{i:03d}", False))
            if rng.random() < 0.4:
                events[k].append((at + rng.randrange(1, 9), f"{k}{i:03d}", True))
    rows = [(k, r, base + dt.timedelta(minutes=t), d, 1) for k, x in events.items() for t, r, d in x]
    rows.sort(key=lambda x: x[2])
    late = [*rows[: len(rows) // 2 : 3], *(r for i, r in enumerate(rows[: len(rows) // 2]) if i % 3)]  # out of order within a batch
    feed(spark, source, late, schema)
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    out = "key string, request string, at timestamp, admitted_at timestamp"
    path = state.drained(state.admissions(stream(), 2, 5, "3 hours"), f"{tmp_path}/out")  # the watermark has passed nothing: all wait in the store
    assert spark.read.schema(out).parquet(path).count() == 0
    feed(spark, source, rows[len(rows) // 2 :], schema)
    feed(spark, source, [("clock", "", base + dt.timedelta(days=30), False, 1)], schema)
    path = state.drained(state.admissions(stream(), 2, 5, "3 hours"), f"{tmp_path}/out")  # restarted, from the checkpoint
    minutes = lambda c: ((F.unix_micros(c) - int(base.timestamp()) * 1_000_000) / 60_000_000).cast("int")
    got = spark.read.schema(out).parquet(path).select("key", "request", minutes("at"), minutes("admitted_at")).collect()
    want = [(k, *x) for k, e in events.items() for x in plain_admissions(e, 2, 5)]
    assert sorted(map(tuple, got)) == sorted(want) and any(a != b for _, _, a, b in want)
    for k in events:  # never more at work than there are slots
        starts = [(b, r) for key, r, _, b in want if key == k]
        over = {r: t for t, r, d in events[k] if d}
        for t, _ in starts:
            assert sum(b <= t < min(b + 5, max(over.get(r, 10**9), b)) for b, r in starts) <= 2
