"""MinHash near-dedup by a chosen-path set similarity join.

A document's set has its distinct 5-word shingles. Every distinct set is a node of TREES independent trees: from a
node's path the next minwise coordinate is chosen, and the document branches by its value there, so that two
documents of similarity J share a path of depth d with probability J**d. Nodes of at most LEAF documents are compared
exhaustively by their sketches; larger ones branch again. What is still large then is tied to one of its members, the
links are confirmed and components found. A large node that is one component but for at most PROBE * CHUNKS members (a
group of near copies) ends with a comparison of those members with the whole node; other large nodes, mixtures, branch
again by fresh coordinates, as long as there are any. No task forms all pairs of a group. Every candidate is confirmed
on the full sets before it counts; the set of a document is made once.

Recall: averaged over the coordinates that a pair of similarity 0.75 has in common, 24 trees miss it with probability
2e-7 at depth 2 and 5e-4 at depth 4, which only nodes of more than LEAF documents reach (that a node's members are then
tied together does not need every link). The sketch filter misses such a pair with probability below 1e-5.

Edge cases: null and blank texts have an empty set, link with nothing and are kept; texts of fewer than five words have
one shingle, the whole; equal sets (exact copies among them) are one class that is joined once; an id that occurs in
several rows keeps its rows, all with the smallest component id found for any of them; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palisade.llm.components import components
from palisade.llm.kernels import Words, buffers, mix, slices
from palisade.llm.scratch import bounded_broadcast, discard, materialise

WORDS = 5
NUMERATOR, DENOMINATOR = 3, 4
COORDINATES = 128
TREES = 24
#: Depth at which nodes are looked at first, and steps by which those that are too large branch further.
DEPTH, STEPS = 2, 2
LEAF = 64
PROBE, CHUNKS = 128, 4
#: Of the first members of the large nodes that hold a document, those that it is compared with before anything else.
HUBS = 8
#: Beyond this depth nodes aren't branched but probed in rounds: all their coordinates were equal that often.
DEEPEST = 64
#: Equal sketch values that a candidate needs of COORDINATES: 4.5 standard deviations below what similarity 0.75 gives.
LEAST_EQUAL = 74
#: Equal sketch values of documents that are similar beyond doubt, some five standard deviations above.
SURE_EQUAL = 121
#: Ids sent to every executor instead of being joined by a shuffle: 8 MB at most.
BROADCAST_IDS = 1_000_000
#: Documents of large nodes get a finer sketch, a byte for each of FINE coordinates, and need FINE_EQUAL equal ones.
FINE = 512
FINE_EQUAL = 340

_rng = np.random.default_rng(20240501)
_FACTORS = _rng.integers(1, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FINE_FACTORS = _rng.integers(1, 1 << 63, FINE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SEEDS = mix(np.arange(1, TREES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingle_sets(w: Words, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row of a slice, sorted within the row, and where each row's begin."""
    start, row = w.windows(k)
    short = np.flatnonzero((w.counts > 0) & (w.counts < k))
    h = np.concatenate([w.rolling(k)[start], w.runs(w.first[:-1][short], w.first[1:][short])])
    row = np.concatenate([row, short])
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    if len(h):
        new = np.concatenate(([True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])))
        h, row = h[new], row[new]
    return h, np.searchsorted(row, np.arange(len(w.counts) + 1))


def _sketch(batches):
    for b in slices(batches):
        w = Words(b.column("text"), lower=True)
        h, first = shingle_sets(w)
        n = np.diff(first)
        full = np.flatnonzero(n)
        signature = np.zeros((len(n), COORDINATES), np.uint16)
        if len(full):
            for t in range(COORDINATES):
                least = np.minimum.reduceat(h * _FACTORS[t], first[full])
                signature[full, t] = (mix(least) >> np.uint64(48)).astype(np.uint16)
        keys = np.zeros((len(n), 2), np.int64)
        for i in full:
            keys[i] = np.frombuffer(hashlib.blake2b(h[first[i] : first[i + 1]].tobytes(), digest_size=16).digest(), np.int64)
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array([x.tobytes() for x in signature], pa.binary())],
            names=["doc_id", "n_shingles", "k1", "k2", "sketch"],
        )


def _fine(batches):
    for b in slices(batches):
        h, first = shingle_sets(Words(b.column("text"), lower=True))
        n = np.diff(first)
        signature = np.zeros((len(n), FINE), np.uint8)
        full = np.flatnonzero(n)
        if len(full):
            for t in range(FINE):
                signature[full, t] = mix(np.minimum.reduceat(h * _FINE_FACTORS[t], first[full])) >> np.uint64(56)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array([x.tobytes() for x in signature], pa.binary())], names=["rep", "n", "fine"])


def _matrix(column: pa.Array, kind: type = np.uint16, width: int = COORDINATES) -> np.ndarray:
    return buffers(column)[0].view(kind).reshape(-1, width)


def _branch(p: np.ndarray, signature: np.ndarray) -> np.ndarray:
    """The path one step deeper: the path so far chooses the coordinate whose value is followed."""
    at = (mix(p ^ np.uint64(0xA0761D6478BD642F)) % np.uint64(COORDINATES)).astype(np.int64)
    return mix(p * np.uint64(0xE7037ED1A0B428DB) ^ signature[np.arange(len(p)), at].astype(np.uint64))


def _roots(depth: int):
    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            m = _matrix(b.column("sketch"))
            ids = np.asarray(b.column("rep"))
            for seed in _SEEDS:
                p = np.full(len(ids), seed)
                for _ in range(depth):
                    p = _branch(p, m)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(p.view(np.int64))], names=["rep", "path"])

    return run


def _trees(m: np.ndarray, depth: int) -> np.ndarray:
    """The paths of documents in every tree."""
    out = np.empty((len(m), TREES), np.uint64)
    for t, seed in enumerate(_SEEDS):
        p = np.full(len(m), seed)
        for _ in range(depth):
            p = _branch(p, m)
        out[:, t] = p
    return out


def _deeper(steps: int):
    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            m = _matrix(b.column("sketch"))
            p = np.asarray(b.column("path")).view(np.uint64)
            for _ in range(steps):
                p = _branch(p, m)
            yield pa.RecordBatch.from_arrays([b.column("rep"), pa.array(p.view(np.int64))], names=["rep", "path"])

    return run


def _equal(m: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal sketch values of the pairs (a, b) of rows; 0 where the sizes of the sets forbid similarity."""
    out = np.zeros(len(a), np.int64)
    at = np.flatnonzero(np.minimum(n[a], n[b]) * DENOMINATOR >= np.maximum(n[a], n[b]) * NUMERATOR)
    for i in range(0, len(at), 1 << 14):
        part = at[i : i + (1 << 14)]
        out[part] = (m[a[part]] == m[b[part]]).sum(1)
    return out


def _pairs(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    x, y = ids[a], ids[b]
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])


def _members(column: pa.Array) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Offsets of lists of structs and the structs' columns."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten()
    offsets = np.asarray(column.offsets)
    kinds = {"sketch": (np.uint16, COORDINATES), "fine": (np.uint8, FINE)}
    return offsets - offsets[0], {f.name: (_matrix(flat.field(f.name), *kinds[f.name]) if f.name in kinds else np.asarray(flat.field(f.name))) for f in flat.type}


def _leaf_pairs(batches):
    """Candidates among all pairs of each small node. Of documents that are similar to an earlier one beyond doubt, only
    the pairs with that one are listed: all three are in one component."""
    for b in batches:
        if not b.num_rows:
            continue
        offsets, c = _members(b.column("members"))
        size = np.diff(offsets)
        for g in np.unique(size[size > 1]):
            i, j = np.triu_indices(int(g), 1)
            nodes = offsets[:-1][size == g]
            step = max(1, (1 << 17) // len(i))
            for at in range(0, len(nodes), step):
                base = nodes[at : at + step, None]
                a, d = base + i, base + j
                equal = _equal(c["sketch"], c["n"], a.ravel(), d.ravel()).reshape(a.shape)
                keep = equal >= LEAST_EQUAL
                if g > 2 and (equal >= SURE_EQUAL).any():
                    sure = np.zeros((len(base), g, g), bool)
                    sure[:, i, j] = equal >= SURE_EQUAL
                    for k in range(int(g) - 2):
                        keep &= ~(sure[:, k, :][:, i] & sure[:, k, :][:, j])
                if keep.any():
                    yield _pairs(c["rep"], a[keep], d[keep])


def _probe_pairs(depth: int):
    """Candidates between a member and the probed documents of its node that are in other components. A pair that
    shares several nodes is a candidate in that of its first common tree only."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            offsets, c = _members(b.column("probe"))
            fine, m = _matrix(b.column("fine"), np.uint8, FINE), _matrix(b.column("sketch"))
            n, ids, label, here = (np.asarray(b.column(x)) for x in ("n", "rep", "label", "path"))
            row = np.repeat(np.arange(len(ids)), np.diff(offsets))
            other = np.flatnonzero(label[row] != c["label"])
            for at in range(0, len(other), 1 << 14):
                o = other[at : at + (1 << 14)]
                r = row[o]
                keep = np.minimum(n[r], c["n"][o]) * DENOMINATOR >= np.maximum(n[r], c["n"][o]) * NUMERATOR
                o, r = o[keep], r[keep]
                keep = (fine[r] == c["fine"][o]).sum(1) >= FINE_EQUAL
                r, o = r[keep], o[keep]
                common = _trees(m[r], depth) == _trees(c["sketch"][o], depth)
                keep = _trees(m[r], depth)[np.arange(len(r)), common.argmax(1)].view(np.int64) == here[r]
                if keep.any():
                    x, y = ids[r[keep]], c["rep"][o[keep]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    return run


def _hashes(batches):
    """The full set of each text."""
    for b in slices(batches):
        h, first = shingle_sets(Words(b.column("text"), lower=True))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first) - 1, [None, pa.py_buffer(first.astype(np.int64) * 8), pa.py_buffer(h)]).cast(pa.binary())], names=["doc_id", "set"])


def _confirm(batches):
    """Pairs with both sets -> those that are similar enough, with the sizes of intersection and union."""
    for b in batches:
        if not b.num_rows:
            continue
        (x, at_x), (y, at_y) = (buffers(b.column(f"set_{k}")) for k in "ab")
        x, y, at_x, at_y = x.view(np.uint64), y.view(np.uint64), at_x // 8, at_y // 8
        both = np.zeros(b.num_rows, np.int64)
        for i in range(b.num_rows):
            own, other = x[at_x[i] : at_x[i + 1]], y[at_y[i] : at_y[i + 1]]
            if len(own) and len(other):
                both[i] = np.count_nonzero(own[np.minimum(np.searchsorted(own, other), len(own) - 1)] == other)
        joint = np.diff(at_x) + np.diff(at_y) - both
        take = np.flatnonzero((both * DENOMINATOR >= joint * NUMERATOR) & (joint > 0))
        yield pa.RecordBatch.from_arrays([b.column("a").take(pa.array(take)), b.column("b").take(pa.array(take)), pa.array(both[take]), pa.array(joint[take])], names=["a", "b", "shared", "joint"])


def _few(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if bounded_broadcast(ids, BROADCAST_IDS) else ids


def _confirmed(candidates: DataFrame, texts: DataFrame) -> DataFrame:
    """Candidates (a, b) whose sets are similar, as a written table. A document's set is made once, from its whole text."""
    candidates = materialise(candidates.distinct(), "candidates")
    ids = _few(candidates.select(F.col("a").alias("doc_id")).union(candidates.select("b")).distinct())
    # several rows of an id are several sets
    sets = materialise(texts.join(ids, "doc_id", "left_semi").mapInArrow(_hashes, "doc_id long, set binary"), "sets")
    pairs = candidates.join(sets.select(F.col("doc_id").alias("b"), F.col("set").alias("set_b")), "b").join(sets.select(F.col("doc_id").alias("a"), F.col("set").alias("set_a")), "a")
    links = materialise(pairs.select("a", "b", "set_a", "set_b").mapInArrow(_confirm, "a long, b long, shared long, joint long"), "links")
    discard(sets)
    discard(candidates)
    return links


def similar(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sets, links): doc_id, n_shingles, rep (the smallest id with an equal set; null for an empty set) of every
    document, and the confirmed links (a, b, shared, joint) between representatives that tie components together:
    those of nodes compared exhaustively, and a connected choice of those within large groups of near copies."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketched = materialise(texts.mapInArrow(_sketch, "doc_id long, n_shingles long, k1 long, k2 long, sketch binary"), "sketches")
    # equal sets have equal sketches, so a class is its first row
    reps = materialise(sketched.where("n_shingles > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch")), "reps")
    sets = sketched.select("doc_id", "n_shingles", "k1", "k2").join(reps.select("k1", "k2", "rep"), ["k1", "k2"], "left").select("doc_id", "n_shingles", "rep", "k1", "k2")
    reps = reps.select("rep", "n", "sketch")
    texts = texts.where("text is not null")

    def sized(rows: DataFrame) -> DataFrame:
        # written, as are other sides of joins below: Spark splits skewed partitions only of plain exchanges
        size = materialise(rows.groupBy("path").agg(F.count("*").alias("m")).where("m > 1"), "sizes")
        return materialise(rows.join(_few(size), "path"), "nodes")

    def leaves(level: DataFrame) -> DataFrame:
        members = level.where(F.col("m") <= LEAF).join(reps, "rep").groupBy("path").agg(F.collect_list(F.struct("rep", "n", "sketch")).alias("members"))
        return members.select("members").mapInArrow(_leaf_pairs, "a long, b long")

    def stars(large: DataFrame) -> DataFrame:
        """Each member of nodes with the first of each of them, HUBS of these at most: members that this leaves out of their
        node's main component are compared with all of it."""
        hub = materialise(large.groupBy("path").agg(F.min("rep").alias("a")), "hubs")
        pairs = large.join(_few(hub), "path").where("rep <> a").select("a", F.col("rep").alias("b")).distinct()
        rank = F.row_number().over(Window.partitionBy("b").orderBy("a"))
        return pairs.withColumn("rank", rank).where(F.col("rank") <= HUBS).select("a", "b")

    level = sized(reps.mapInArrow(_roots(DEPTH), "rep long, path long"))
    candidates, depth = leaves(level), DEPTH + STEPS
    large = level.where(F.col("m") > LEAF).select("rep", "path")
    if large.isEmpty():
        return sets, _confirmed(candidates, texts)
    level = sized(large.join(reps, "rep").mapInArrow(_deeper(STEPS), "rep long, path long"))
    large = level.where(F.col("m") > LEAF).select("rep", "path")
    links = _confirmed(candidates.union(leaves(level)).union(stars(large)), texts)
    if large.isEmpty():
        return sets, links
    ids = _few(large.select(F.col("rep").alias("doc_id")).distinct())
    fine = materialise(texts.join(ids, "doc_id", "left_semi").mapInArrow(_fine, "rep long, n long, fine binary").join(reps.drop("n"), "rep"), "fine")
    while True:
        found = components(links.select("a", "b")).withColumnRenamed("id", "rep")
        member = materialise(large.join(_few(found), "rep", "left").select("path", "rep", F.coalesce("component", "rep").alias("label")), "members")
        main = member.groupBy("path", "label").agg(F.count("*").alias("n")).groupBy("path").agg(F.max_by("label", F.struct("n", F.negative("label"))).alias("main"), (F.sum("n") - F.max("n")).alias("others")).where("others > 0")
        main = materialise(main, "main")
        if main.isEmpty():
            return sets, links
        # nodes that are one component but for a bounded number of members: these are compared with all others
        rank = F.row_number().over(Window.partitionBy("path").orderBy("rep"))
        few = F.lit(depth >= DEEPEST) | (F.col("others") <= PROBE * CHUNKS)
        others = member.join(_few(main.where(few)), "path").where("label <> main").select("path", "rep", "label").withColumn("rank", rank)
        probed = materialise(others.where(F.col("rank") <= PROBE * CHUNKS), "others")
        probe = probed.join(fine, "rep").groupBy("path", F.floor((F.col("rank") - 1) / PROBE).alias("chunk")).agg(F.collect_list(F.struct("rep", "label", "n", "fine", "sketch")).alias("probe"))
        candidates = member.join(fine, "rep").join(probe, "path").select("path", "rep", "label", "n", "fine", "sketch", "probe").mapInArrow(_probe_pairs(depth), "a long, b long")
        # the rest: members of larger mixtures branch again; beyond DEEPEST what was probed leaves its node
        if depth >= DEEPEST:
            left = member.join(main, "path").join(probed.select("path", "rep"), ["path", "rep"], "left_anti")
            large = materialise(left.select("rep", "path"), "nodes")
        else:
            mixed = member.join(_few(main.where(~few)), "path").select("rep", "path")
            large = mixed
            if not mixed.isEmpty():
                level = sized(mixed.join(reps, "rep").mapInArrow(_deeper(STEPS), "rep long, path long"))
                large = level.where(F.col("m") > LEAF).select("rep", "path")
                candidates = candidates.union(leaves(level)).union(stars(large))
                depth += STEPS
        links = materialise(links.union(_confirmed(candidates.distinct().join(links, ["a", "b"], "left_anti"), texts)), "links")
        if large.isEmpty():
            return sets, links


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id (smallest doc_id reachable by links), kept."""
    sets, links = similar(docs)
    found = components(links.select("a", "b")).withColumnRenamed("id", "rep")
    out = sets.join(found, "rep", "left").select("doc_id", "n_shingles", F.coalesce("component", "rep", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH RECURSIVE dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, g FROM (
  SELECT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - 3)) AS i FROM dw WHERE len(w) >= 5)
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM dw WHERE len(w) BETWEEN 1 AND 4)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS MATERIALIZED (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM dw UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
comp AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, comp.m AS component_id, doc_id = comp.m AS kept
FROM dw LEFT JOIN n USING (doc_id) JOIN comp ON comp.a = doc_id
"""
