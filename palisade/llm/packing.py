"""Lexical retrieval packing: a sharded BM25 inverted index fills each seed document's window with its neighbours.

Documents are tokenised once, in the partitions in which they are read, and written to the shared folder. Document
frequencies and mean length are counted over all of them. A shard is a run of a partition's documents of SHARD_TOKENS
ids; its inverted index answers the query of each seed (its heaviest terms, then all its others if their neighbours
don't fill the window) with unused neighbours, best first, which are put whole while they fit; the best of those too
long is then cut to fill the window exactly, and only without any neighbour left the shortest of the other documents. What is left of a
shard joins the partition's next one, and what is left at the end of a partition is cut into sequences whose lengths
are powers of two, so nothing is padded. Token ids are never shuffled.

Edge cases: null and empty texts are one end id; documents longer than a window give full windows and a rest; a text that
holds an added token of the tokenizer's file gets its id, as the plain tokenizer gives it; of neighbours with equal
scores the earlier one comes first; repeated rows are packed as often as they occur; an empty table gives no piece; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm.kernels import buffers, slices
from palisade.llm.scratch import materialise

WINDOW = 2048
END = 1
SHARD_TOKENS = 2_000_000
QUERY_TERMS = 16
NEIGHBOURS = 48
K1, B = 1.2, 0.75

#: Characters on whose being white space regular expression engines differ.
ODD = "[\x1c-\x1f\x85\u180e\u200b\u2060\ufeff]"

_LOADED: dict[str, ByteTokenizer] = {}


class ByteTokenizer:
    """Ids of texts by a byte-level BPE file of the tokenizers library.

    Where the file's merges stand in the order of their ids, its vocabulary serves as a table of ranks for tiktoken,
    which gives the same ids several times faster; all else is left to tokenizers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.plain = Tokenizer.from_file(path)
        with open(path) as f:
            spec = json.load(f)
        #: Ids are below it; they are kept in two bytes where they can be.
        self.size = 1 + max([*self.plain.get_vocab(with_added_tokens=True).values(), END])
        self.kind = np.uint16 if self.size <= 1 << 16 else np.uint32
        # texts with white space on which regular expression engines differ, or an added token, take the plain way
        self.odd = re.compile("|".join([ODD, *(re.escape(t["content"]) for t in spec.get("added_tokens", []))]), re.I)
        self.fast = self._ranked(spec)

    @staticmethod
    def _ranked(spec: dict):
        import tiktoken

        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        merged = [model["vocab"].get("".join(m.split(" ") if isinstance(m, str) else m)) for m in model.get("merges", [])]
        if before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or spec.get("normalizer") or None in merged or merged != sorted(merged):
            return None
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(sorted({*range(256)} - {*printable}))}
        special = {t["content"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
        return tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        if self.fast is None or self.odd.search(text):
            return np.array(self.plain.encode(text, add_special_tokens=False).ids, self.kind)
        return self.fast.encode_to_numpy(text).astype(self.kind)


def loaded(path: str) -> ByteTokenizer:
    """The tokenizer of a file, read once in a process."""
    if path not in _LOADED:
        _LOADED[path] = ByteTokenizer(path)
    return _LOADED[path]


def _tokenise(path: str):
    def run(batches):
        tokenizer = loaded(path)
        for b in slices(batches):
            ids = [np.append(tokenizer.encode(t or ""), tokenizer.kind(END)).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return run


def _frequencies(size: int, kind: type):
    def run(batches):
        df, documents, total = np.zeros(size, np.int64), 0, 0
        for b in batches:
            data, offsets = buffers(b.column("ids"))
            ids, offsets = data.view(kind).astype(np.int64), offsets // np.dtype(kind).itemsize
            documents += b.num_rows
            total += len(ids)
            for at in range(0, b.num_rows, 256):
                end = min(at + 256, b.num_rows)
                row = np.repeat(np.arange(end - at), np.diff(offsets[at : end + 1]))
                df += np.bincount(np.unique(row * size + ids[offsets[at] : offsets[end]]) % size, minlength=size)
        term = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(term, [-1, -2])), pa.array(np.append(df[term], [documents, total]))], names=["term", "n"])

    return run


class Packer:
    """Packs the documents of a partition, shard by shard."""

    def __init__(self, idf: np.ndarray, mean: float, base: int):
        self.idf, self.mean, self.next = idf, mean, base
        self.pool: list[list] = []  # doc_id, ids, start, document's tokens
        self.rows: list[tuple] = []
        self.near = 0  # ids that retrieval has placed beside a seed

    def emit(self, parts: list[tuple]) -> None:
        """One sequence of parts: (doc_id, ids, start, document's tokens)."""
        at = 0
        for doc, ids, start, tokens in parts:
            self.rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), tokens, self.next, at))
            at += len(ids)
        self.next += 1

    def add(self, doc: int, ids: np.ndarray) -> int:
        start = 0
        while len(ids) - start >= WINDOW:
            self.emit([(doc, ids[start : start + WINDOW], start, len(ids))])
            start += WINDOW
        if start < len(ids):
            self.pool.append([doc, ids[start:], start, len(ids)])
        return len(ids) - start

    def _index(self):
        length = np.array([len(p[1]) for p in self.pool])
        flat = np.concatenate([p[1] for p in self.pool]).astype(np.int64)
        key, tf = np.unique(flat * len(length) + np.repeat(np.arange(len(length)), length), return_counts=True)
        term, frag = key // len(length), key % len(length)
        weight = (self.idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[frag] / self.mean))).astype(np.float32)
        first = np.searchsorted(term, np.arange(len(self.idf) + 1))
        # the terms of each fragment, heaviest first
        order = np.lexsort((-weight, frag))
        begin = np.searchsorted(frag[order], np.arange(len(length) + 1))
        return length, frag, weight, first, term[order], begin

    @staticmethod
    def _best(score: np.ndarray, length: np.ndarray, room: int) -> np.ndarray:
        """Neighbours from the best on, as many as the window can need and all if they can't fill it."""
        n = NEIGHBOURS
        while n < len(score):
            best = np.argpartition(-score, n)[:n]
            if score[best].min() <= 0 or length[best].sum() >= 2 * room:
                break
            n *= 4
        else:
            best = np.arange(len(score))
        best = best[score[best] > 0]
        return best[np.argsort(-score[best], kind="stable")]

    @staticmethod
    def _whole(best: np.ndarray, length: np.ndarray, room: int) -> tuple[list[int], int]:
        """Of the best, in order, those that still fit whole, and the room that is left."""
        taken = []
        for i, n in zip(best.tolist(), length[best].tolist(), strict=True):
            if n <= room:
                taken.append(i)
                room -= n
                if not room:
                    break
        return taken, room

    def pack(self, last: bool) -> None:
        """Fills windows from the pool; if it isn't the last shard, what can't fill a window stays in the pool."""
        if not self.pool:
            return
        length, frag, weight, first, queries, begin = self._index()
        free = np.ones(len(length), bool)
        left = int(length.sum())
        order = np.argsort(-length, kind="stable")
        at = spare = 0
        rest = None
        while left:
            if left < WINDOW and not last:
                break
            while not free[order[at]]:
                at += 1
            seed = int(order[at])
            free[seed] = False
            parts, room = [tuple(self.pool[seed])], WINDOW - int(length[seed])
            left -= int(length[seed])
            score = np.zeros(len(length), np.float32)
            terms = queries[begin[seed] : begin[seed + 1]]
            best = np.zeros(0, np.int64)
            for query in (terms[:QUERY_TERMS], terms[QUERY_TERMS:]):  # all terms of the seed if the heaviest don't fill its window
                for t in query:
                    s = slice(first[t], first[t + 1])
                    score[frag[s]] += weight[s]
                score[~free] = 0
                best = self._best(score, length, room)
                taken, room = self._whole(best, length, room)
                parts += [tuple(self.pool[i]) for i in taken]
                free[taken] = False
                left -= int(length[taken].sum())
                if len(best) and length[best].sum() >= WINDOW or not room:
                    break
            self.near += WINDOW - room - int(length[seed])
            long = [int(i) for i in best if free[i]]
            spare = len(order) - 1 if spare == 0 else spare
            while room and left:
                if long:
                    i = long.pop(0)
                else:  # no neighbour is left: the shortest of the others
                    while not free[order[spare]]:
                        spare -= 1
                    i = int(order[spare])
                doc, ids, start, tokens = self.pool[i]
                n = min(room, len(ids))
                parts.append((doc, ids[:n], start, tokens))
                self.near += n if score[i] > 0 else 0
                room -= n
                left -= n
                if n < len(ids):
                    self.pool[i] = [doc, ids[n:], start + n, tokens]
                    length[i] -= n
                else:
                    free[i] = False
            if room:
                rest = parts
            else:
                self.emit(parts)
        self.pool = [p for p, f in zip(self.pool, free, strict=True) if f]
        if rest:
            self._powers(rest)

    def _powers(self, parts: list[tuple]) -> None:
        """Fewer ids than a window, in sequences of 2**i ids."""
        left = sum(len(p[1]) for p in parts)
        parts = list(parts)
        while left:
            room = size = 1 << (left.bit_length() - 1)
            out = []
            while room:
                doc, ids, start, tokens = parts.pop(0)
                n = min(room, len(ids))
                out.append((doc, ids[:n], start, tokens))
                if n < len(ids):
                    parts.insert(0, (doc, ids[n:], start + n, tokens))
                room -= n
            self.emit(out)
            left -= size

    def take(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        columns = list(zip(*rows, strict=True)) or [()] * 7
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _pack(idf, mean: float, kind: type):
    def run(batches):
        packer = Packer(idf.value, mean, (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32)
        held = 0
        for b in batches:
            for doc, x in zip(b.column("doc_id").to_pylist(), b.column("ids").to_pylist(), strict=True):
                held += packer.add(doc, np.frombuffer(x, kind))
                if held >= SHARD_TOKENS:
                    packer.pack(False)
                    held = sum(len(p[1]) for p in packer.pool)
                    yield packer.take()
        packer.pack(True)
        yield packer.take()

    return run


def pack(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Pieces of documents in sequences: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    size, kind = loaded(path).size, loaded(path).kind
    ids = materialise(texts.mapInArrow(_tokenise(path), "doc_id long, ids binary"), "tokens")
    counts = {r.term: r.n for r in ids.mapInArrow(_frequencies(size, kind), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}  # a row for each id of the vocabulary
    documents, tokens = counts.pop(-1, 0), counts.pop(-2, 0)
    df = np.zeros(size)
    df[list(counts)] = list(counts.values())
    idf = np.where(df > 0, np.log1p((documents - df + 0.5) / (df + 0.5)), 0)
    return ids.mapInArrow(_pack(spark.sparkContext.broadcast(idf), tokens / max(1, documents), kind), PIECES)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
