"""Document fingerprints: a Merkle tree over sections, paragraphs and runs of words.

Paragraphs are lines. A section is a run of paragraphs that ends where a paragraph's digest says so, so that an edit
moves no border but its own. The leaves are runs of a few words of a paragraph, whose borders are set by content too,
so that texts of a single paragraph have branches as well. A paragraph's digest covers its bytes, a section's those of
its paragraphs and the root's the sections': equal roots mean equal texts, and differing branches locate edits. The
likeness of two trees is the share of leaves that they have in common, found by a descent from the roots: branches
with equal digests are common with all their leaves, only differing ones are looked into.

A fingerprint is ``root.sections.paragraphs.leaves``: hex digits of 16 bytes, then base64 of 8 bytes for a section
and for a paragraph (a digest of 4, the number of branches) and 3 for a leaf, all in order.

Edge cases: null is an empty text, whose tree has one empty paragraph; trees without leaves are alike only if their
roots are equal; rows with the same id follow each other in order of their texts; a row without an id stands first;
a table of one row is its own next document; texts may be of any length, a range of ids streams through one task;
extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left
from collections import Counter
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm.kernels import Words, slices
from palisade.llm.ranges import even_keys, id_ranges, range_of

#: One word in so many ends a leaf, one paragraph in so many a section.
LEAF_WORDS = 3
SECTION_PARAGRAPHS = 8
#: Text of the documents that are compared with their neighbours in one task.
RANGE_BYTES = 12 << 20

SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


class Tree:
    """root; of each section and paragraph its digest and the number of its branches; the leaves' digests. All in order."""

    __slots__ = ("root", "sections", "paragraphs", "leaves")

    def __init__(self, root: str, sections: list[tuple[bytes, int]], paragraphs: list[tuple[bytes, int]], leaves: np.ndarray):
        self.root, self.sections, self.paragraphs, self.leaves = root, sections, paragraphs, leaves

    def encode(self) -> str:
        parts = [b"".join(d + n.to_bytes(4, "little") for d, n in x) for x in (self.sections, self.paragraphs)]
        parts.append(self.leaves.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes())
        return ".".join([self.root, *(base64.b64encode(x).decode() for x in parts)])

    @classmethod
    def decode(cls, fingerprint: str) -> Tree:
        root, *parts = fingerprint.split(".")
        s, p, m = (base64.b64decode(x) for x in parts)
        pairs = [[(x[i : i + 4], int.from_bytes(x[i + 4 : i + 8], "little")) for i in range(0, len(x), 8)] for x in (s, p)]
        leaves = np.zeros((len(m) // 3, 4), np.uint8)
        leaves[:, :3] = np.frombuffer(m, np.uint8).reshape(-1, 3)
        return cls(root, *pairs, leaves.view("<u4").reshape(-1).astype(np.int64))


def trees(texts: list[bytes]) -> list[Tree]:
    w = Words(pa.array(texts, pa.large_binary()))
    n = len(w.start)
    last = np.zeros(n, bool)
    if n:
        line = np.cumsum(w.data == 10)[w.start]
        last = w.hash % np.uint64(LEAF_WORDS) == 0
        last[:-1] |= line[1:] != line[:-1]
        last[w.first[1:][w.counts > 0] - 1] = True
    end = np.flatnonzero(last) + 1
    begin = np.concatenate(([0], end[:-1])).astype(np.int64)
    leaf = (w.runs(begin, end) >> np.uint64(40)).astype(np.int64) if n else np.zeros(0, np.int64)
    # leaves begin in the paragraph that holds them
    starts = w.start[begin] if n else np.zeros(0, np.int64)
    out = []
    for i, text in enumerate(texts):
        lines = text.split(b"\n")
        border = np.minimum(w.offsets[i] + np.cumsum([0, *(len(x) + 1 for x in lines)]), w.offsets[i + 1])
        at = np.searchsorted(starts, border)
        digests = [hashlib.blake2b(x, digest_size=8).digest() for x in lines]
        sections, first = [], 0
        for k, d in enumerate(digests, 1):
            if d[0] % SECTION_PARAGRAPHS == 0 or k == len(digests):
                sections.append((hashlib.blake2b(b"".join(digests[first:k]), digest_size=8).digest(), k - first))
                first = k
        root = hashlib.blake2b(b"".join(d for d, _ in sections), digest_size=16).hexdigest()
        paragraphs = list(zip((d[:4] for d in digests), np.diff(at).tolist(), strict=True))
        out.append(Tree(root, [(d[:4], k) for d, k in sections], paragraphs, leaf[at[0] : at[-1]]))
    return out


def _unequal(a: list[tuple], b: list[tuple]) -> tuple[int, list[tuple], list[tuple]]:
    """Leaves of the branches (digest, branches, first leaf, end) that both have, and the other branches of each."""
    have = Counter(x[:2] for x in b)
    shared, rest, matched = 0, [], Counter()
    for x in a:
        if have[x[:2]] > 0:
            have[x[:2]] -= 1
            matched[x[:2]] += 1
            shared += x[3] - x[2]
        else:
            rest.append(x)
    others = []
    for x in b:
        if matched[x[:2]] > 0:
            matched[x[:2]] -= 1
        else:
            others.append(x)
    return shared, rest, others


def alike(a: Tree, b: Tree) -> float:
    """Twice the common leaves over all leaves; 1 for equal roots."""
    if a.root == b.root:
        return 1.0
    total = len(a.leaves) + len(b.leaves)
    if not total:
        return 0.0
    levels = []
    for t in (a, b):
        at = np.concatenate(([0], np.cumsum([n for _, n in t.paragraphs]))).tolist()
        own = np.concatenate(([0], np.cumsum([n for _, n in t.sections]))).tolist()
        sections = [(d, n, at[i], at[j], i, j) for (d, n), i, j in zip(t.sections, own, own[1:], strict=False)]
        levels.append((at, sections))
    common, *open_ = _unequal(levels[0][1], levels[1][1])
    below = [[(*t.paragraphs[k], at[k], at[k + 1]) for *_, i, j in x for k in range(i, j)] for t, (at, _), x in zip((a, b), levels, open_, strict=True)]
    more, *open_ = _unequal(*below)
    x, y = (np.concatenate([t.leaves[:0], *(t.leaves[i:j] for _, _, i, j in rest)]) for t, rest in zip((a, b), open_, strict=True))
    (u, m), (v, k) = np.unique(x, return_counts=True), np.unique(y, return_counts=True)
    _, p, q = np.intersect1d(u, v, assume_unique=True, return_indices=True)
    return 2 * (common + more + int(np.minimum(m[p], k[q]).sum())) / total


def likeness(a: str, b: str) -> float:
    """Share of leaves that two fingerprints have in common."""
    return alike(Tree.decode(a), Tree.decode(b))


def _runs(a: list, b: list) -> list[tuple[int, int, int, int]]:
    """Where two lists differ: runs [i, j) of a that stand where [k, m) stands in b. What both have once, in a longest
    common order, is aligned, and what is equal beside it; the time is that of sorting."""
    (na, nb), pa_, pb = (Counter(a), Counter(b)), {x: i for i, x in enumerate(a)}, {x: i for i, x in enumerate(b)}
    pairs = [(pa_[x], pb[x]) for x in a if na[x] == 1 and nb[x] == 1]
    tops: list[int] = []
    last: list[int] = []
    before = [-1] * len(pairs)
    for i, (_, k) in enumerate(pairs):  # longest increasing run of places in b
        at = bisect_left(tops, k)
        tops[at : at + 1] = [k]
        last[at : at + 1] = [i]
        before[i] = last[at - 1] if at else -1
    chain = []
    i = last[-1] if last else -1
    while i >= 0:
        chain.append(pairs[i])
        i = before[i]
    out, i, k = [], 0, 0
    for j, m in [*reversed(chain), (len(a), len(b))]:
        while i < j and k < m and a[i] == b[k]:
            i, k = i + 1, k + 1
        end_j, end_m = j, m
        while end_j > i and end_m > k and a[end_j - 1] == b[end_m - 1]:
            end_j, end_m = end_j - 1, end_m - 1
        if end_j > i or end_m > k:
            out.append((i, end_j, k, end_m))
        i, k = j, m
    return out


def edits(a: str, b: str) -> list[tuple[int, int, int, int]]:
    """Runs of paragraphs [i, j) of a that stand where [k, m) stands in b; branches with equal digests are skipped."""
    x, y = Tree.decode(a), Tree.decode(b)
    if x.root == y.root:
        return []
    sx, sy = ([0, *np.cumsum([n for _, n in t.sections]).tolist()] for t in (x, y))
    out = []
    for i, j, k, m in _runs(x.sections, y.sections):
        out += [(sx[i] + p, sx[i] + q, sy[k] + r, sy[k] + s) for p, q, r, s in _runs(x.paragraphs[sx[i] : sx[j]], y.paragraphs[sy[k] : sy[m]])]
    return out


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id and the fingerprint of each text; no shuffle."""

    def run(batches):
        for b in slices(batches):
            prints = [t.encode() for t in trees([(t or "").encode() for t in b.column("text").to_pylist()])]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(prints)], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fingerprint string")


def _deal(bounds: np.ndarray, keys: np.ndarray):
    """Each document to the range of ids that holds it, and the first of each range to the range before, too."""

    def run(batches):
        for b in slices(batches):
            ids = np.asarray(b.column("doc_id").fill_null(int(bounds[0])))
            range_ = range_of(bounds, ids)
            edge = np.flatnonzero(bounds[range_] == ids)
            take = pa.array(np.concatenate([np.arange(len(ids)), edge]))
            at = np.concatenate([range_, (range_[edge] - 1) % len(bounds)])
            ahead = np.concatenate([np.zeros(len(ids), np.int32), np.ones(len(edge), np.int32)])
            yield pa.RecordBatch.from_arrays([pa.array(keys[at].astype(np.int32)), pa.array(ahead), b.column("doc_id").take(take), b.column("text").take(take)], names=["range", "ahead", "doc_id", "text"])

    return run


def _compare(batches):
    """Rows in order of range, ahead, id; the last of a range stands ahead and belongs to the next one."""
    held: tuple | None = None
    for b in slices(batches):
        texts = b.column("text").to_pylist()
        rows = list(zip(b.column("range").to_pylist(), b.column("ahead").to_pylist(), b.column("doc_id").to_pylist(), texts, trees([t.encode() for t in texts]), strict=True))
        rows = [held, *rows] if held else rows
        held = rows[-1]
        out, edited = [], []
        for row, after in zip(rows, islice(rows, 1, None), strict=False):
            if not row[1]:
                text = row[3]
                cut = len(text) // 4
                edited.append((text[: len(text) - cut] + after[3][:cut]).encode())
                out.append((row, after))
        columns: list[tuple] = []
        for (row, after), text, t in zip(out, edited, trees(edited), strict=True):
            columns.append((row[2], len(row[3]), hashlib.sha256(text).hexdigest(), row[4].encode(), t.encode(), alike(row[4], t), alike(row[4], after[4])))
        if columns:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*columns, strict=True), kinds, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of each document and of its text with the last quarter replaced from the next document, by id.

    Documents are dealt to ranges of ids of about RANGE_BYTES, sorted within them; the first document of each range is
    also sent to the range before, so neighbours always meet and each text is shuffled once."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    bounds, _ = id_ranges(texts, RANGE_BYTES)
    parts = max(len(bounds), docs.sparkSession.sparkContext.defaultParallelism)
    dealt = texts.mapInArrow(_deal(bounds, even_keys(docs.sparkSession, len(bounds), parts)), "range int, ahead int, doc_id long, text string")
    return dealt.repartition(parts, "range").sortWithinPartitions("range", "ahead", "doc_id", "text").mapInArrow(_compare, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))
