"""Substring dedup with repeated-phrase automata.

Words are runs of bytes other than ASCII white space. A window is WINDOW consecutive words; it is removed from a
document if the same words also start in a document with a smaller id.

1. Winnowing picks phrases of PHRASE words so that every window holds one, chosen by its content alone.
2. Phrases picked in two documents or more are confirmed as recurring by a sharded count.
3. The recurring phrases of each shard of documents are compiled into an Aho-Corasick automaton, whose letters are
   the shard's words, and the shard's documents are streamed through it to locate every occurrence.
4. Windows that hold an occurrence are hashed to 128 bits; a sharded minimum finds the first document of each, and the words
   covered by windows of later documents are removed.

Documents with equal words are handled as one: all but the first lose everything (or nothing, if shorter than a
window), so large groups of exact copies cost one row each. Every shuffle is keyed by hashes or ids, aggregated before
it is sent, or a join whose skewed partitions Spark splits.

Edge cases: null and blank texts have no words and keep an empty text; equal ids are never smaller than each other, so
repeated rows stay; rows with one id and different texts are judged each by its own text; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm.kernels import Words, binary, groups, slices
from palisade.llm.scratch import bounded_broadcast, materialise

WINDOW = 50
PHRASE = 16
#: Text of the documents that share an automaton.
SHARD_BYTES = 1 << 20
BROADCAST_IDS = 1_000_000
EMPTY = hashlib.sha256(b"").hexdigest()


def _slide(x: np.ndarray, width: int, low: bool) -> np.ndarray:
    """Minimum (or maximum) of each range [i, i + width), cut at the end."""
    f, fill = (np.minimum, np.uint64(2**64 - 1)) if low else (np.maximum, np.uint64(0))
    span = 1
    x = np.concatenate([x, np.full(width, fill)])
    n = len(x) - width
    while span * 2 <= width:
        x = f(x[: len(x) - span], x[span:])
        span *= 2
    rest = width - span
    return f(x[:n], x[rest : n + rest]) if rest else x[:n]


def winnow(w: Words, window: int = WINDOW, phrase: int = PHRASE) -> tuple[np.ndarray, np.ndarray]:
    """Words at which picked phrases start, and the phrases' hashes: every window of a row holds an occurrence of a picked phrase."""
    n = len(w.start)
    start, _ = w.windows(phrase)
    h = np.full(n, 2**64 - 1, np.uint64)
    h[start] = w.rolling(phrase)[start]
    width = window - phrase + 1
    least = _slide(h, width, True)
    valid = np.zeros(n, bool)
    valid[w.windows(window)[0]] = True
    least[~valid] = 0
    # a phrase is picked if it is the least of some window that holds it
    most = _slide(np.concatenate([np.zeros(width - 1, np.uint64), least]), width, False)[:n]
    at = np.flatnonzero((most == h) & (most > 0))
    # the first of equal phrases in a row: the automaton finds the others
    row = np.searchsorted(w.first, at, "right")
    order = np.lexsort((at, h[at], row))
    same = np.zeros(len(at), bool)
    same[1:] = (h[at][order][1:] == h[at][order][:-1]) & (row[order][1:] == row[order][:-1])
    at = np.sort(at[order][~same])
    return at, h[at]


def _prepare(batches):
    for b in slices(batches):
        w = Words(b.column("text"))
        at, h = winnow(w)
        first = np.searchsorted(at, w.first)
        texts = binary(b.column("text")).to_pylist()
        joined = [b" ".join(t.split()) for t in texts]
        keys = np.array([np.frombuffer(hashlib.blake2b(t, digest_size=16).digest(), np.int64) for t in joined]).reshape(-1, 2)
        lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(h.view(np.int64)))
        places = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array((at - w.first[:-1][np.repeat(np.arange(len(first) - 1), np.diff(first))]).astype(np.int32)))
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id").cast(pa.int64()), pa.array(w.counts, pa.int64()), pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array([hashlib.sha256(t).hexdigest() for t in joined]), lists, places],
            names=["doc_id", "n_words", "k1", "k2", "sha", "phrases", "places"],
        )


def _locate(batches):
    """Windows that hold an occurrence of a recurring phrase: their first words and hashes."""
    for b in slices(batches, most=SHARD_BYTES):
        w = Words(b.column("text"))
        picked = b.column("places").to_pylist()
        _, letter = np.unique(w.hash, return_inverse=True)
        letters = (letter % 1_000_000 + 0x10000).astype("<u4")
        rows = [letters[w.first[i] : w.first[i + 1]].tobytes().decode("utf-32-le") for i in range(b.num_rows)]
        automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for text, places in zip(rows, picked, strict=True):
            for p in places:
                automaton.add_word(text[p : p + PHRASE])
        automaton.make_automaton()
        starts = []
        for i, text in enumerate(rows):
            n = len(text)
            found = np.fromiter((end for end, _ in automaton.iter(text)), np.int64) - PHRASE + 1
            inside = np.zeros(n + 1, np.int64)
            np.add.at(inside, np.maximum(found - (WINDOW - PHRASE), 0), 1)
            np.add.at(inside, found + 1, -1)
            starts.append(np.flatnonzero(np.cumsum(inside[: max(0, n - WINDOW + 1)]) > 0))
        count = np.array([len(x) for x in starts])
        at = np.concatenate(starts) + np.repeat(w.first[:-1], count)
        h, g = (w.rolling(WINDOW, seed)[at] if len(at) else np.zeros(0, np.uint64) for seed in (0, 1))
        offsets = pa.array(np.concatenate(([0], np.cumsum(count))).astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("k1"), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(starts).astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(h.view(np.int64))), pa.ListArray.from_arrays(offsets, pa.array(g.view(np.int64)))],
            names=["doc_id", "k1", "starts", "windows", "checks"],
        )


def _cut(batches):
    """Texts and first words of removed windows -> what is kept."""
    for b in slices(batches):
        out = []
        for text, starts in zip(binary(b.column("text")).to_pylist(), b.column("starts"), strict=True):
            words = text.split()
            gone = np.zeros(len(words) + 1, np.int64)
            s = np.asarray(starts.values)
            np.add.at(gone, s, 1)
            np.add.at(gone, s + WINDOW, -1)
            gone = np.cumsum(gone[:-1]) > 0
            out.append((int(gone.sum()), b" ".join([x for x, g in zip(words, gone.tolist(), strict=True) if not g])))
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("k1"), pa.array([n for n, _ in out], pa.int64()), pa.array([t.decode() for _, t in out])], names=["doc_id", "k1", "n_removed", "kept"]
        )


def _near(ids: DataFrame) -> DataFrame:
    """ids, to be broadcast if there are few enough of them."""
    return F.broadcast(ids) if bounded_broadcast(ids, BROADCAST_IDS) else ids


def removals(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(prepared, cut): of every row its doc_id, n_words, keys of its words, sha of all its words, and first (the
    smallest id with equal words); of rows that lose words to windows found elsewhere doc_id, k1, n_removed, kept."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    prepared = materialise(texts.mapInArrow(_prepare, "doc_id long, n_words long, k1 long, k2 long, sha string, phrases array<long>, places array<int>"), "phrases")
    classes = materialise(prepared.groupBy("k1", "k2").agg(F.min("doc_id").alias("first")), "classes")
    whole = prepared.drop("phrases", "places").join(classes, ["k1", "k2"])
    own = prepared.where(F.col("n_words") >= WINDOW).join(classes.withColumnRenamed("first", "doc_id"), ["k1", "k2", "doc_id"], "left_semi")
    picked = own.select("doc_id", "k1", F.explode(F.arrays_zip("phrases", "places")).alias("p")).select("doc_id", "k1", F.col("p.phrases").alias("phrase"), F.col("p.places").alias("place"))
    # written, so that the joins below read plain exchanges on both sides, whose skewed partitions Spark splits
    recurring = materialise(picked.groupBy("phrase").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("phrase"), "recurring")
    places = materialise(picked.join(recurring, "phrase", "left_semi").groupBy("doc_id", "k1").agg(F.collect_list("place").alias("places")), "places")

    ids = _near(places.select("doc_id").distinct())
    keyed = texts.where("text is not null").join(ids, "doc_id", "left_semi").mapInArrow(_keyed, "doc_id long, k1 long, text string")
    located = materialise(keyed.dropDuplicates(["doc_id", "k1"]).join(places, ["doc_id", "k1"]).select("doc_id", "k1", "text", "places").mapInArrow(_locate, "doc_id long, k1 long, starts array<int>, windows array<long>, checks array<long>"), "windows")
    windows = located.select("doc_id", "k1", F.explode(F.arrays_zip("starts", "windows", "checks")).alias("w")).select("doc_id", "k1", F.col("w.starts").alias("start"), F.col("w.windows").alias("window"), F.col("w.checks").alias("check"))
    holder = materialise(windows.groupBy("window", "check").agg(F.min("doc_id").alias("holder"), F.max("doc_id").alias("most")).where("holder < most").select("window", "check", "holder"), "holders")
    gone = materialise(windows.join(holder, ["window", "check"]).where("doc_id > holder").groupBy("doc_id", "k1").agg(F.collect_list("start").alias("starts")), "removed")

    ids = _near(gone.select("doc_id").distinct())
    keyed = texts.where("text is not null").join(ids, "doc_id", "left_semi").mapInArrow(_keyed, "doc_id long, k1 long, text string")
    cut = keyed.dropDuplicates(["doc_id", "k1"]).join(gone, ["doc_id", "k1"]).select("doc_id", "k1", "text", "starts").mapInArrow(_cut, "doc_id long, k1 long, n_removed long, kept string")
    return whole, cut


def _keyed(batches):
    for b in slices(batches):
        k = [int.from_bytes(hashlib.blake2b(b" ".join(t.split()), digest_size=16).digest()[:8], "little", signed=True) for t in binary(b.column("text")).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(k, pa.int64()), b.column("text")], names=["doc_id", "k1", "text"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole, cut = removals(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    cut = cut.select("doc_id", "k1", F.col("n_removed").alias("lost"), F.sha2("kept", 256).alias("rest"))
    copy = (F.col("doc_id") > F.col("first")) & (F.col("n_words") >= WINDOW)
    return whole.join(cut, ["doc_id", "k1"], "left").select(
        "doc_id",
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("lost", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(EMPTY)).otherwise(F.coalesce("rest", "sha")).alias("kept_sha256"),
    )


SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - 48)) AS i FROM dw WHERE len(w) >= 50)),
first AS (SELECT g, min(doc_id) AS m FROM win GROUP BY g HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN first USING (g) WHERE doc_id > m)),
g2 AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM gone GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM dw) x
  WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.doc_id = x.doc_id AND gone.p = x.p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(g2.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM dw LEFT JOIN g2 USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
