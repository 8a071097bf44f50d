"""Connected components by alternating large-star and small-star rounds.

Edges inside a partition are first contracted to a spanning star, which shortens chains at no cost in shuffles. Every
round is written to the shared folder; nothing about the graph reaches the driver but a count and a checksum.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.scratch import discard, materialise


#: Edges that a task holds at once, 16 bytes each.
MOST_EDGES = 2_000_000


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges as (member, smallest member) of their components; the smallest members themselves aren't listed."""
    ids, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = place[: len(u)], place[len(u) :]
    label = np.arange(len(ids))
    while len(a):
        x, y = label[a], label[b]
        least = np.minimum(x, y)
        for at in (x, y):  # roots, whose members follow
            np.minimum.at(label, at, least)
        while not np.array_equal(up := label[label], label):
            label = up
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    member = np.flatnonzero(label != np.arange(len(ids)))
    return ids[member], ids[label[member]]


def _contract(most: int):
    """Edges (u, v) of a partition as stars, of at most so many edges at a time."""

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for b in batches:
            held.append((np.asarray(b.column(0)), np.asarray(b.column(1))))
            size += b.num_rows
            if size >= most:
                held = [stars(*(np.concatenate(x) for x in zip(*held, strict=True)))]
                size = len(held[0][0])
                if 2 * size >= most:
                    yield from _batches(*held[0])
                    held, size = [], 0
        if held:
            yield from _batches(*stars(*(np.concatenate(x) for x in zip(*held, strict=True))))

    return run


def _batches(u: np.ndarray, v: np.ndarray):
    for at in range(0, len(u), 1 << 18):
        yield pa.RecordBatch.from_arrays([pa.array(u[at : at + (1 << 18)]), pa.array(v[at : at + (1 << 18)])], names=["u", "v"])


def _state(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r.n, int(r.h or 0)


def components(edges: DataFrame, most_edges: int = MOST_EDGES, most_rounds: int = 60) -> DataFrame:
    """Edges (a, b) of long ids, loops and repeats allowed -> (id, component), the smallest id reachable; only ids
    that are not the smallest of their component are listed. Up to most_edges contracted edges, a size that is counted
    first, one task contracts them all; more take alternating rounds over the cluster, with the same result."""
    contract = _contract(most_edges)
    now = materialise(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v").mapInArrow(contract, "u long, v long"), "edges")
    state = _state(now)
    if state[0] <= most_edges:
        whole = materialise(now.coalesce(1).mapInArrow(_contract(max(2, 2 * most_edges)), "u long, v long"), "edges")
        discard(now)
        return whole.select(F.col("u").alias("id"), F.col("v").alias("component"))
    for _ in range(most_rounds):
        both = now.union(now.select("v", "u")).toDF("u", "v")
        # written, so that the join reads plain exchanges on both sides and Spark can split a hub's rows
        least = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.where("m < u").select("u", F.col("m").alias("v"))).distinct()
        after_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(after_least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(after_least.select("u", F.col("m").alias("v")))
        after = materialise(small.distinct().mapInArrow(contract, "u long, v long"), "edges")
        had, state = state, _state(after)
        discard(now)
        discard(least)
        now = after
        if state == had:
            return now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    raise RuntimeError("components did not converge")
