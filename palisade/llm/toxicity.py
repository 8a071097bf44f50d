"""Toxicity with a convolutional text classifier, trained in numpy.

A word's embedding is the sum of a hashed embedding of the word and one of its first bytes, so that inflected and
unseen forms share what is known of their stems. Filters of several widths slide over the whole text; their maxima,
rectified, feed a logistic output. Embeddings start from the words' log-odds in the training texts and everything is
trained by Adagrad through the maxima. Part of the training rows is kept aside to calibrate the score and, for each
language, the threshold at which a document is flagged.

The classifier is fitted on all labelled rows that may be learned from. Their words' buckets are written once, dealt to
tasks by a hash of their ids. In each of EPOCHS rounds every task trains the last network on its rows; a value then moves
by the mean of what the tasks moved it, weighed by how often they did. With one task that is plain Adagrad. The driver
holds one network and counts of the kept rows' logits. Every whole text is scored, on the executors, without a shuffle.
Scores depend on the text alone.

Edge cases: null and empty texts get the score of a text without words; labels that repeat count once, toxic if any
says so; null labels and labels without a document are ignored; if the labels hold one class only, or none, the score
is the share of toxic ones (0 without any); a row without an id is scored, keeps its null and is not held out; a
score of exactly the threshold is flagged;
repeated documents are repeated; a very long text is convolved whole; an empty table gives no row; extra columns are ignored.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm.decontaminate import NOT_WORD
from palisade.llm.kernels import Words, crc_of_id, slices
from palisade.llm.scratch import bounded_broadcast, materialise, small_batches

WORD_BUCKETS, STEM_BUCKETS = 1 << 15, 1 << 13
STEM_BYTES = 4
DIMENSIONS = 12
WIDTHS = (1, 2, 3)
FILTERS = 6
EPOCHS, BATCH, RATE = 6, 64, 0.1
#: Labelled rows for each task that trains; rows of which it mixes the order.
SHARD_ROWS, POOL = 8192, 1024
#: One labelled row of so many is kept aside for calibration, whose logits are counted in steps of 1 / STEPS.
ASIDE, STEPS = 5, 1024
#: Labels that are broadcast rather than joined by a shuffle: 12 MB at most.
BROADCAST_LABELS = 1_000_000
THRESHOLD = 0.3
LEAST_FOR_LANGUAGE = 30

OFFSETS = [(k, j) for k in range(len(WIDTHS)) for j in range(WIDTHS[k])]


def bucketed(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word and stem buckets of all words of a column, and where each row's words begin."""
    w = Words(column, lower=True, white=NOT_WORD)
    stem = w.heads(STEM_BYTES)
    return (w.hash >> np.uint64(40)).astype(np.int64) % WORD_BUCKETS, (stem >> np.uint64(40)).astype(np.int64) % STEM_BUCKETS, w.first


@dataclass
class Network:
    words: np.ndarray = field(default_factory=lambda: np.zeros((WORD_BUCKETS, DIMENSIONS), np.float32))
    stems: np.ndarray = field(default_factory=lambda: np.zeros((STEM_BUCKETS, DIMENSIONS), np.float32))
    filters: np.ndarray = field(default_factory=lambda: np.zeros((len(OFFSETS), DIMENSIONS, FILTERS), np.float32))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(len(WIDTHS) * FILTERS, np.float32))
    out: np.ndarray = field(default_factory=lambda: np.zeros(len(WIDTHS) * FILTERS, np.float32))
    last: float = 0.0
    scale: float = 1.0
    shift: float = 0.0
    constant: float | None = None
    thresholds: dict[str, float] = field(default_factory=dict)

    def projected(self) -> tuple[np.ndarray, np.ndarray]:
        """Each bucket's share in each filter at each offset."""
        weights = self.filters.transpose(1, 0, 2).reshape(DIMENSIONS, -1)
        return self.words @ weights, self.stems @ weights


def convolve(tables: tuple[np.ndarray, np.ndarray], word: np.ndarray, stem: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Filter outputs at every word; words beyond a row's end count as zero."""
    q = (tables[0][word] + tables[1][stem]).reshape(len(word), len(OFFSETS), FILTERS)
    out = np.zeros((len(word), len(WIDTHS), FILTERS), np.float32)
    left = np.repeat(first[1:], np.diff(first)) - np.arange(len(word))  # words to the row's end
    for o, (k, j) in enumerate(OFFSETS):
        if j == 0:
            out[:, k] += q[:, o]
        else:
            out[:-j, k] += np.where(left[:-j, None] > j, q[j:, o], 0)
    return out.reshape(len(word), -1)


def logits(net: Network, tables, word: np.ndarray, stem: np.ndarray, first: np.ndarray) -> np.ndarray:
    pooled = np.zeros((len(first) - 1, len(net.bias)), np.float32)
    full = np.flatnonzero(np.diff(first))
    if len(full):
        pooled[full] = np.maximum(np.maximum.reduceat(convolve(tables, word, stem, first), first[full]) + net.bias, 0)
    return pooled @ net.out + net.last


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


DENSE = ("filters", "bias", "out", "last")
#: Buckets of a piece of the network, as which tasks send what they have learned.
CHUNK = 1024


def _state(net: Network) -> dict[str, np.ndarray]:
    return {name: np.full(np.shape(getattr(net, name)), 1e-3, np.float32) for name in ("words", "stems", *DENSE)}


def _start(counts: dict[str, np.ndarray], rows: np.ndarray) -> Network:
    """Random filters; embeddings of the buckets' log-odds. counts: by label and bucket, rows: by label."""
    rng = np.random.default_rng(7)
    net = Network()
    for at, name in enumerate(("words", "stems")):
        n, table = counts[name], getattr(net, name)
        odds = np.log((n[1] + 0.5) / (rows[1] + 1)) - np.log((n[0] + 0.5) / (rows[0] + 1))
        table[:] = rng.normal(0, 0.05, table.shape)
        table[:, at] += odds * n.sum(0) / (n.sum(0) + 5) / 2
    net.filters[:] = rng.normal(0, 0.2, net.filters.shape)
    net.filters[:, :2] = np.abs(net.filters[:, :2]) + 0.3
    net.out[:] = 0.3
    net.last = -3.0
    return net


def _learn(net: Network, state: dict[str, np.ndarray], touches: dict[str, np.ndarray], word: list[np.ndarray], stem: list[np.ndarray], y: np.ndarray) -> None:
    """One step of Adagrad on some rows; touches counts the steps that have moved a bucket."""

    def move(name: str, gradient: np.ndarray, at=...) -> None:
        state[name][at] += gradient**2
        step = RATE * gradient / np.sqrt(state[name][at])
        if name == "last":
            net.last -= float(step)
        else:
            getattr(net, name)[at] -= step

    w, s = np.concatenate(word), np.concatenate(stem)
    first = np.concatenate(([0], np.cumsum([len(x) for x in word]))).astype(np.int64)
    if not len(w):
        return
    found = convolve(net.projected(), w, s, first)
    at = np.array([a + found[a:b].argmax(0) if b > a else np.full(found.shape[1], -1) for a, b in zip(first[:-1], first[1:], strict=True)])
    top = np.where(at >= 0, found[at, np.arange(found.shape[1])] + net.bias, 0)
    pooled = np.maximum(top, 0)
    d = (_sigmoid(pooled @ net.out + net.last) - y).astype(np.float32) / len(y) * BATCH
    back = d[:, None] * net.out * (top > 0)
    filters = np.zeros_like(net.filters)
    ends = np.repeat(first[1:], len(net.bias)).reshape(at.shape)
    wg, sg, gg = [], [], []
    for o, (k, j) in enumerate(OFFSETS):
        c = slice(k * FILTERS, (k + 1) * FILTERS)
        place, g = at[:, c] + j, back[:, c]
        ok = (at[:, c] >= 0) & (place < ends[:, c]) & (g != 0)
        r, f = np.nonzero(ok)
        p = place[ok]
        e = net.words[w[p]] + net.stems[s[p]]
        np.add.at(filters[o].T, f, g[ok][:, None] * e)
        wg.append(w[p])
        sg.append(s[p])
        gg.append(g[ok][:, None] * net.filters[o].T[f])
    move("out", pooled.T @ d)
    move("last", d.sum())
    move("bias", back.sum(0))
    g = np.concatenate(gg)
    for name, ids in (("words", np.concatenate(wg)), ("stems", np.concatenate(sg))):
        touched, where = np.unique(ids, return_inverse=True)
        total = np.zeros((len(touched), DIMENSIONS), np.float32)
        np.add.at(total, where, g)
        if len(touched):
            move(name, total, touched)
            touches[name][touched] += 1
    move("filters", filters)
    touches["dense"] += len(y)


def _flat(values: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Words, stems and all the rest, each as rows."""
    return {"words": values["words"], "stems": values["stems"], "dense": np.concatenate([np.ravel(values[x]) for x in DENSE]).astype(np.float32)[None, :]}


def _values(net: Network) -> dict[str, np.ndarray]:
    return {name: np.asarray(getattr(net, name), np.float32) for name in ("words", "stems", *DENSE)}


LEARNED = "part string, chunk int, task int, touches binary, moved binary, gained binary"


def _rows(b: pa.RecordBatch) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Word and stem buckets of each row, and labels."""
    word, stem = ([np.frombuffer(x, np.uint16).astype(np.int64) for x in b.column(name).to_pylist()] for name in ("word", "stem"))
    return word, stem, b.column("toxic").to_numpy().astype(np.int64)


def _epoch(shared, number: int):
    """Trains on a task's rows, in random order within POOL of them; returns what it moved, weighed by touches."""

    def run(batches):
        net, state = pickle.loads(shared.value)
        before, gained = _flat({k: v.copy() for k, v in _values(net).items()}), _flat({k: v.copy() for k, v in state.items()})
        touches = {"words": np.zeros(WORD_BUCKETS, np.float32), "stems": np.zeros(STEM_BUCKETS, np.float32), "dense": np.zeros(1, np.float32)}
        rng = np.random.default_rng([7, number])
        word, stem, y = [], [], []

        def learn() -> None:
            for rows in np.array_split(rng.permutation(len(y)), max(1, len(y) // BATCH)) if y else ():
                _learn(net, state, touches, [word[i] for i in rows], [stem[i] for i in rows], np.array([y[i] for i in rows]))
            for x in (word, stem, y):
                x.clear()

        for b in batches:
            for own, more in zip((word, stem, y), _rows(b), strict=True):
                own.extend(more)
            if len(y) >= POOL:
                learn()
        learn()
        task = TaskContext.get().partitionId() if TaskContext.get() else 0
        now, squares = _flat(_values(net)), _flat(state)
        out = []
        for part, n in touches.items():
            for at in range(0, len(n), CHUNK):
                own = slice(at, at + CHUNK)
                if n[own].any():
                    out.append((part, at, task, n[own].tobytes(), ((now[part][own] - before[part][own]) * n[own, None]).tobytes(), ((squares[part][own] - gained[part][own]) * n[own, None]).tobytes()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.string(), pa.int32(), pa.int32(), *[pa.binary()] * 3), strict=True)], names=[x.split()[0] for x in LEARNED.split(", ")])

    return run


def _summed(key, table):
    table = table.sort_by("task")  # sums of floats depend on their order
    sums = [sum(np.frombuffer(x.as_py(), np.float32).astype(float) for x in table[c]).astype(np.float32).tobytes() for c in ("touches", "moved", "gained")]
    return pa.table([pa.array([key[0].as_py()]), pa.array([key[1].as_py()], pa.int32()), pa.array([-1], pa.int32()), *(pa.array([x], pa.binary()) for x in sums)], names=table.column_names)


def _moved(net: Network, state: dict[str, np.ndarray], learned: pa.Table) -> None:
    """Moves each value by the mean of what tasks moved it, each weighed by how often it did."""
    values, squares = _flat(_values(net)), _flat(state)
    for part, at, _, n, moved, gained in zip(*(learned[c].to_pylist() for c in learned.column_names), strict=True):
        n = np.frombuffer(n, np.float32)
        own, shape = slice(at, at + len(n)), (len(n), -1)
        for table, change in ((values, moved), (squares, gained)):
            table[part][own] += np.frombuffer(change, np.float32).reshape(shape) / np.maximum(n, 1)[:, None]
    for flat, target in ((values, None), (squares, state)):
        at = 0
        for name in DENSE:
            shape = np.shape(getattr(net, name)) if target is None else np.shape(state[name])
            size = int(np.prod(shape))
            value = flat["dense"][0, at : at + size].reshape(shape)
            at += size
            if target is not None:
                state[name] = value.copy()
            else:
                setattr(net, name, float(value) if name == "last" else value.copy())


def _calibrate(net: Network, lang: list[str], bins: np.ndarray, t: np.ndarray, n: np.ndarray) -> None:
    """A scale and shift of the logits by logistic regression, then each language's threshold of best F1; from counts of
    rows by language, label and logit in steps of 1 / STEPS."""
    z, t, w = bins / STEPS, t.astype(float), n.astype(float)
    a, b = 1.0, 0.0
    for _ in range(200):  # damped Newton steps with a weak prior that keeps separable classes finite
        p = _sigmoid(a * z + b)
        e, v = w * (p - t), w * (p * (1 - p) + 1e-6)
        g = np.array([(e * z).sum() + 0.1 * (a - 1), e.sum() + 0.01 * b])
        h = np.array([[(v * z * z).sum() + 0.1, (v * z).sum()], [(v * z).sum(), v.sum() + 0.01]])
        step = np.linalg.solve(h, g)
        a, b = a - 0.5 * step[0], b - 0.5 * step[1]
    net.scale, net.shift = max(a, 1e-3), b
    names = np.array(lang, object)
    for name in {*lang, ""}:
        own = np.full(len(z), True) if not name else names == name
        if name and (w[own].sum() < LEAST_FOR_LANGUAGE or not (w * t)[own].any()):
            continue
        cuts, where = np.unique(_sigmoid(net.scale * z[own] + net.shift), return_inverse=True)
        flagged = np.cumsum(np.bincount(where, w[own])[::-1])[::-1]
        right = np.cumsum(np.bincount(where, (w * t)[own])[::-1])[::-1]
        best = int(np.argmax(2 * right / np.maximum(1e-9, flagged + (w * t)[own].sum())))
        net.thresholds[name] = float((cuts[best] + (cuts[best - 1] if best else 0)) / 2)


def _document_counts(batches):
    """Rows with each bucket, by label; bucket -1 counts the rows."""
    sizes = {"words": WORD_BUCKETS, "stems": STEM_BUCKETS}
    n = {part: np.zeros((2, size), np.int64) for part, size in sizes.items()}
    rows = np.zeros(2, np.int64)
    for b in batches:
        word, stem, y = _rows(b)
        for part, ids in (("words", word), ("stems", stem)):
            for x, label in zip(ids, y, strict=True):
                n[part][label][np.unique(x)] += 1
        rows += np.bincount(y, minlength=2)
    for part, counts in n.items():
        label, bucket = np.nonzero(counts)
        label, bucket, count = np.append(label, [0, 1]), np.append(bucket, [-1, -1]), np.append(counts[label, bucket], rows)
        yield pa.RecordBatch.from_arrays([pa.array([part] * len(label), pa.string()), pa.array(label), pa.array(bucket), pa.array(count)], names=["part", "label", "bucket", "n"])


def _logit_counts(shared):
    def run(batches):
        net = pickle.loads(shared.value)
        tables = net.projected()
        for b in batches:
            word, stem, y = _rows(b)
            first = np.concatenate(([0], np.cumsum([len(x) for x in word]))).astype(np.int64)
            z = logits(net, tables, np.concatenate([*word, np.zeros(0, np.int64)]), np.concatenate([*stem, np.zeros(0, np.int64)]), first)
            yield pa.RecordBatch.from_arrays([b.column("lang"), pa.array(y), pa.array(np.rint(np.clip(z.astype(float), -40, 40) * STEPS).astype(np.int64))], names=["lang", "toxic", "bin"])

    return run


def fit(docs: DataFrame, labels: DataFrame) -> Network:
    """Fits on all labelled rows whose CRC-32 of doc_id isn't 2 modulo 4."""
    spark = docs.sparkSession
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna().where(crc % 4 != 2).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    usable = materialise(usable, "labels")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang")).fillna("", ["text"])
    texts = texts.where(crc % 4 != 2)

    def ids(batches):
        for b in slices(batches):
            word, stem, first = bucketed(b.column("text"))
            packed = [pa.array([x[i:j].astype(np.uint16).tobytes() for i, j in zip(first[:-1], first[1:], strict=True)], pa.binary()) for x in (word, stem)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("toxic"), b.column("lang"), *packed], names=["doc_id", "toxic", "lang", "word", "stem"])

    small_batches(spark)
    shards = max(1, -(-usable.count() // SHARD_ROWS))
    known = texts.join(F.broadcast(usable) if bounded_broadcast(usable, BROADCAST_LABELS) else usable, "doc_id").select("doc_id", "text", "toxic", "lang")
    order = F.xxhash64("doc_id")  # a task's rows are dealt without regard to the files they come from
    rows = known.mapInArrow(ids, "doc_id long, toxic int, lang string, word binary, stem binary").repartition(shards, order).sortWithinPartitions(order, "doc_id")
    rows = materialise(rows.withColumn("aside", F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(ASIDE)) == 0), "labelled")
    have = {(r.aside, r.toxic): r["count"] for r in rows.groupBy("aside", "toxic").count().collect()}
    total = np.array([sum(n for (_, label), n in have.items() if label == k) for k in (0, 1)])
    if not total.all():
        return Network(constant=float(total[1] / max(1, total.sum())))
    apart = have.get((False, 0)) and have.get((False, 1)) and (have.get((True, 0), 0) + have.get((True, 1), 0))
    train, aside = ((rows.where(c) if apart else rows) for c in ("not aside", "aside"))
    train = train.select("toxic", "word", "stem")

    # a row for each bucket and label
    found = train.mapInArrow(_document_counts, "part string, label long, bucket long, n long").groupBy("part", "label", "bucket").agg(F.sum("n").alias("n")).toArrow()
    part, label, bucket, n = (found[c].to_numpy() for c in ("part", "label", "bucket", "n"))
    counts = {"words": np.zeros((2, WORD_BUCKETS)), "stems": np.zeros((2, STEM_BUCKETS))}
    for name, table in counts.items():
        own = (part == name) & (bucket >= 0)
        table[label[own], bucket[own]] = n[own]
    own = (part == "words") & (bucket < 0)
    net = _start(counts, np.bincount(label[own], n[own], 2))
    state = _state(net)
    for number in range(EPOCHS):
        shared = spark.sparkContext.broadcast(pickle.dumps((net, state)))
        learned = train.mapInArrow(_epoch(shared, number), LEARNED).groupBy("part", "chunk").applyInArrow(_summed, LEARNED)
        _moved(net, state, learned.toArrow())  # as much as one network
        shared.destroy()

    shared = spark.sparkContext.broadcast(pickle.dumps(net))
    binned = aside.select("toxic", "word", "stem", "lang").mapInArrow(_logit_counts(shared), "lang string, toxic long, bin long").groupBy("lang", "toxic", "bin").count().toArrow()  # counts by language and step
    _calibrate(net, binned["lang"].to_pylist(), *(binned[c].to_numpy() for c in ("bin", "toxic", "count")))
    return net


RESULT = "doc_id long, held_out boolean, score double, predicted int, flagged int"


def score(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= 0.3) and flagged (score >= the language's threshold)."""
    model = docs.sparkSession.sparkContext.broadcast((net, net.projected()))

    def run(batches):
        net, tables = model.value
        for b in slices(batches, most=1 << 20):
            if net.constant is None:
                p = _sigmoid(net.scale * logits(net, tables, *bucketed(b.column("text"))).astype(float) + net.shift)
            else:
                p = np.full(b.num_rows, net.constant)
            cut = np.array([net.thresholds.get(x, net.thresholds.get("", THRESHOLD)) for x in b.column("lang").to_pylist()])
            held = crc_of_id(np.asarray(b.column("doc_id").fill_null(0))) % 4 == 2
            held &= np.asarray(b.column("doc_id").is_valid())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(held), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32)), pa.array((p >= cut).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted", "flagged"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).mapInArrow(run, RESULT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
