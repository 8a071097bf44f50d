"""Benchmark decontamination: a broadcast hash set of normalised benchmark n-grams scans training windows.

Words are runs of ASCII digits, lower-cased ASCII letters and non-ASCII bytes. A window is ``n`` consecutive words of
an item, or the whole item if it is shorter. Every hash hit is verified word by word against the item, so results are
exact. Documents are read once and never shuffled. Up to INDEX_BYTES of benchmark text, a size that is measured first,
the whole index of its windows is broadcast and hits are verified where they are found. A larger benchmark is broadcast
as a set of 2**FILTER_BITS bits, whatever its size; the few windows that pass, with their words, are joined to the
benchmark's windows by a shuffle of plain exchanges, whose skewed partitions Spark splits.

Edge cases: null or empty texts have no words, are never contaminated and match nothing; an item without words has no
window; items with equal windows all count; an item without an id contaminates like others but is not in the list of
items; repeated documents are repeated in the result; an empty benchmark leaves
every document clean; columns of the input that clash with result names are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm.kernels import LOWER, Words, slices
from palisade.llm.scratch import columns, materialise

N_GRAM = 10
INDEX_BYTES = 16 << 20
#: Bits of the filter for larger benchmarks: 16 MB.
FILTER_BITS = 27

NOT_WORD = np.ones(256, bool)
NOT_WORD[0x30:0x3A] = False
NOT_WORD[0x61:0x7B] = False
NOT_WORD[0x80:] = False

_FOUND = "doc_id long, text string, n_words long, spans array<int>, items array<string>"


class WindowIndex:
    """The windows of a benchmark shard: by length, sorted hashes with the items and positions that have them."""

    def __init__(self, items: list[tuple[str | None, bytes]], n: int = N_GRAM):
        self.names = [name for name, _ in items]
        self.words = [_plain(text) for _, text in items]
        self.by_length: list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        w = Words(pa.array([t for _, t in items], pa.large_binary()), lower=True, white=NOT_WORD)
        lengths = np.minimum(w.counts, n)
        for k in np.unique(lengths[lengths > 0]):
            start, row = w.windows(int(k))
            own = lengths[row] == k
            start, row = start[own], row[own]
            h = w.rolling(int(k))[start]
            order = np.argsort(h, kind="stable")
            near = np.zeros(1 << 16, bool)
            near[(h >> np.uint64(48)).astype(np.int64)] = True
            self.by_length.append((int(k), h[order], row[order], (start - w.first[row])[order], near))

    def scan(self, w: Words) -> tuple[np.ndarray, list[set[str]]]:
        """Which words of a slice are hit, and the items found in each row."""
        hit = np.zeros(len(w.start) + 1, np.int64)
        items: list[set[str]] = [set() for _ in w.counts]
        for k, hashes, item, at, near in self.by_length:
            start, row = w.windows(k)
            h = w.rolling(k)[start]
            maybe = np.flatnonzero(near[(h >> np.uint64(48)).astype(np.int64)])
            low = np.searchsorted(hashes, h[maybe], "left")
            high = np.searchsorted(hashes, h[maybe], "right")
            for i, lo, hi in zip(maybe[high > low], low[high > low], high[high > low], strict=True):
                s, own = int(start[i]), None
                for j in range(lo, hi):
                    own = own or [w.word(x) for x in range(s, s + k)]
                    if self.words[item[j]][at[j] : at[j] + k] == own:
                        hit[s] += 1
                        hit[s + k] -= 1
                        if self.names[item[j]] is not None:
                            items[row[i]].add(self.names[item[j]])
        return np.cumsum(hit[:-1]) > 0, items


def _plain(text: bytes) -> list[bytes]:
    keep = np.where(NOT_WORD, 0x20, np.arange(256)).astype(np.uint8).tobytes()
    return text.translate(LOWER.tobytes()).translate(keep).split()


def _runs(hit: np.ndarray) -> list[int]:
    """Starts and ends, one after the other, of the runs of hit words."""
    return np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))).tolist()


def _scan(items):
    def run(batches):
        index = WindowIndex(items.value)
        for b in slices(batches):
            w = Words(b.column("text"), lower=True, white=NOT_WORD)
            hit, found = index.scan(w)
            spans = [_runs(hit[i:j]) for i, j in zip(w.first, w.first[1:], strict=False)]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("text"), pa.array(w.counts, pa.int64()), pa.array(spans, pa.list_(pa.int32())), pa.array([sorted(x) for x in found], pa.list_(pa.string()))],
                names=["doc_id", "text", "n_words", "spans", "items"],
            )

    return run


_WINDOWS = "k int, hash long, words binary"


def _windows_of(w: Words, k: int, start: np.ndarray) -> list[bytes]:
    return [b" ".join(w.word(x) for x in range(s, s + k)) for s in start.tolist()]


def _benchmark_windows(batches):
    for b in slices(batches):
        w = Words(b.column("text"), lower=True, white=NOT_WORD)
        lengths = np.minimum(w.counts, N_GRAM)
        for k in np.unique(lengths[lengths > 0]).tolist():
            start, row = w.windows(k)
            own = lengths[row] == k
            start, row = start[own], row[own]
            words = pa.array(_windows_of(w, k, start), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(start), k, np.int32)), pa.array(w.rolling(k)[start].view(np.int64)), words, b.column("item").take(pa.array(row))], names=["k", "hash", "words", "item"])


def _maybe(bits, lengths: list[int]):
    """Windows of documents that pass the filter."""

    def run(batches):
        has = bits.value
        for b in slices(batches):
            w = Words(b.column("text"), lower=True, white=NOT_WORD)
            for k in lengths:
                start, row = w.windows(k)
                h = w.rolling(k)[start]
                slot = h >> np.uint64(64 - FILTER_BITS)
                keep = (has[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) > 0
                start, row, h = start[keep], row[keep], h[keep]
                if len(start):
                    at = pa.array((start - w.first[row]).astype(np.int32))
                    yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(row)), b.column("key").take(pa.array(row)), at, pa.array(np.full(len(start), k, np.int32)), pa.array(h.view(np.int64)), pa.array(_windows_of(w, k, start), pa.binary())], names=["doc_id", "key", "start", "k", "hash", "words"])

    return run


def _spans(batches):
    for b in slices(batches):
        w = Words(b.column("text"), lower=True, white=NOT_WORD)
        spans = []
        for n, hits in zip(w.counts.tolist(), b.column("hits").to_pylist(), strict=True):
            hit = np.zeros(n + 1, np.int64)
            for x in hits or []:
                hit[x["start"]] += 1
                hit[x["start"] + x["k"]] -= 1
            spans.append(_runs(np.cumsum(hit[:-1]) > 0))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text"), pa.array(w.counts, pa.int64()), pa.array(spans, pa.list_(pa.int32())), b.column("items")], names=["doc_id", "text", "n_words", "spans", "items"])


def contamination(docs: DataFrame, benchmark: DataFrame, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """Per document: doc_id, text, n_words, spans (starts and ends of hit word runs), items (their ids as strings)."""
    sc = docs.sparkSession.sparkContext
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = items.agg(F.sum(F.octet_length("text") + F.coalesce(F.octet_length("item"), F.lit(0)) + 16)).first()[0] or 0
    if size <= index_bytes:
        rows = sorted(((r.item, r.text.encode()) for r in items.collect()), key=lambda x: (x[0] or "", x[1]))
        return texts.mapInArrow(_scan(sc.broadcast(rows)), _FOUND)
    windows = materialise(items.mapInArrow(_benchmark_windows, f"{_WINDOWS}, item string"), "windows")
    slots = windows.select(F.shiftrightunsigned("hash", 64 - FILTER_BITS).alias("slot"))
    words = slots.selectExpr("slot >> 6 AS at", "shiftleft(1L, CAST(slot & 63 AS INT)) AS bit").groupBy("at").agg(F.bit_or("bit").alias("bits"))
    held = columns(words)  # 2 ** (FILTER_BITS - 6) rows at most
    bits = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    bits[held["at"]] = held["bits"].view(np.uint64)
    lengths = [r.k for r in windows.select("k").distinct().collect()]  # N_GRAM at most
    keyed = texts.withColumn("key", F.xxhash64("text"))
    maybe = materialise(keyed.mapInArrow(_maybe(sc.broadcast(bits), sorted(lengths)), f"doc_id long, key long, start int, {_WINDOWS}"), "maybe")
    hits = maybe.join(windows.select("k", "hash", "words", "item").distinct(), ["k", "hash", "words"])
    # a set of places and one of items for each text, whatever the number of its hits
    found = materialise(hits.groupBy("doc_id", "key").agg(F.collect_set(F.struct("start", "k")).alias("hits"), F.sort_array(F.collect_set("item")).alias("items")), "hits")
    none = F.array().cast("array<string>")
    joined = keyed.join(found, keyed["key"].eqNullSafe(found["key"]) & keyed["doc_id"].eqNullSafe(found["doc_id"]), "left")
    return joined.select(keyed["doc_id"], keyed["text"], F.col("hits"), F.coalesce("items", none).alias("items")).mapInArrow(_spans, _FOUND)


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", most_hit: float = 0.5) -> DataFrame:
    """doc_id and text without contamination. mode "documents" drops every document with a hit; "spans" cuts the hit
    words and what stands between them, and drops documents of which more than most_hit of the words were hit."""
    if mode not in ("documents", "spans"):
        raise ValueError(f"unknown mode {mode!r}")
    found = contamination(docs, benchmark)
    if mode == "documents":
        return found.where(F.size("spans") == 0).select("doc_id", "text")

    def cut(batches):
        for b in slices(batches):
            w = Words(b.column("text"), lower=True, white=NOT_WORD)
            ids, texts = [], []
            for i, (doc, text, spans) in enumerate(zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True)):
                if spans:
                    if sum(spans[1::2]) - sum(spans[::2]) > most_hit * w.counts[i]:
                        continue
                    raw, keep, at = text.encode(), [], 0
                    begin = w.first[i]
                    for s, e in zip(spans[::2], spans[1::2], strict=True):
                        keep.append(raw[at : w.start[begin + s] - w.offsets[i]])
                        at = w.end[begin + e - 1] - w.offsets[i]
                    text = b"".join([*keep, raw[at:]]).decode()
                ids.append(doc)
                texts.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return found.mapInArrow(cut, "doc_id long, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))

    def digest(batches):
        for b in batches:
            items = b.column("items").to_pylist()
            spans = b.column("spans").to_pylist()
            hit = [sum(s[1::2]) - sum(s[::2]) for s in spans]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("n_words"), pa.array(hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]), pa.array([h > 0 for h in hit])],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
            )

    return found.drop("text").mapInArrow(digest, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), '[^ ]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), '[^ ]+') AS w FROM benchmark),
ik AS (SELECT item_id, w, least(len(w), 10) AS k FROM iw WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM ik)),
dk AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, (SELECT DISTINCT k FROM win) WHERE len(w) >= k),
hits AS (SELECT doc_id, i, win.k, item_id FROM (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM dk) d JOIN win ON d.k = win.k AND d.g = win.g),
hitw AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hitw.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(its.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(its.s, '')) AS items_sha256, coalesce(hitw.n, 0) > 0 AS contaminated
FROM dw LEFT JOIN hitw USING (doc_id) LEFT JOIN its USING (doc_id)
"""
