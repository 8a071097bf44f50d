"""Token ids as flat binary files: unsigned integers beside 64-bit document offsets, read back by memory maps.

A data set is a folder of parts. A part holds a run of documents, ascending by id, in two files: ``*.bin``, the ids one
after the other in 2 or 4 little-endian bytes, and ``*.idx``, where each document ends, in ids from the part's beginning,
and the documents' own ids, both as 64-bit integers. ``manifest.json`` names the parts in order with their counts and
their bases, the numbers of documents and ids before them, which are prefix sums over the counts.

Documents are dealt to parts by ranges of (id, text hash), which Spark samples, so equal ids, or many rows without one,
spread over parts as well; texts are shuffled once, tokenized behind the shuffle and streamed to the files. A part's
name is new in each attempt of its task, and only the parts of tasks that succeeded are in the manifest, which is
written last: lost executors and repeated attempts leave files that nothing names. Folders are reached through pyarrow's
file systems (local, HDFS, S3, by the URI); parts in local or mounted folders are memory-mapped, others are read by ranges.

The tokenizer is a file of the tokenizers library and is never trained. Its results are remembered by word: where
white space borders every token (which the file's own parts say), texts are cut at ASCII white space, the words of a
slice are counted off in a dictionary, and only words that are new to the process go through the library, each once.
All other tokenizers, and texts with added tokens of the file, are encoded whole.

Edge cases: null and empty texts are the end id alone; null ids come first; repeated rows are written as often as they
occur, equal ids in order of their texts' hashes; an empty table gives a manifest without parts and no rows; very long
texts are one document and one row; columns with other names are ignored.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm.kernels import LOWER, Words, slices
from palisade.llm.scratch import columns, materialise, scratch_root

END = 2
#: Bytes of text of a part, about.
PART_BYTES = 128 << 20
#: Bytes of words that a process remembers.
MEMORY_BYTES = 96 << 20
READ_IDS = 1 << 18
#: Bytes of text that are encoded at a time.
SLICE = 2 << 20

#: Classes of bytes: letter, digit, other, apostrophe, white space or beyond ASCII; and the pairs between which a token of
#: a bordered tokenizer always ends, with nothing on either side that could change the other.
CLASS = np.full(256, 2, np.uint8)
CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = 0
CLASS[0x30:0x3A] = 1
CLASS[0x27] = 3
CLASS[[0x20, *range(0x09, 0x0E), *range(0x80, 0x100)]] = 4
CLASS[0x00:0x09], CLASS[0x0E:0x20] = 4, 4
CUTS = np.zeros((5, 5), bool)
CUTS[0, 1:4] = CUTS[1, :4] = CUTS[2, :2] = CUTS[3, 1] = True

_PARTS = "part int, name string, documents long, ids long"
SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"


class WordTokenizer:
    """Ids of whole texts, as the tokenizers library gives them without special tokens."""

    def __init__(self, path: str, end: int = END):
        from tokenizers import Tokenizer

        self.plain = Tokenizer.from_file(path)
        self.bare = Tokenizer(self.plain.model)
        with open(path) as f:
            spec = json.load(f)
        self.end = end
        most = max([*self.plain.get_vocab(with_added_tokens=True).values(), end])
        self.kind = np.dtype("<u2" if most < 1 << 16 else "<u4")
        self.added = re.compile(b"|".join(re.escape(t["content"].lower().encode()) for t in spec.get("added_tokens", [])) or b"(?!)")
        self.by_word, self.lower = self._bordered(spec)
        self._clear()

    @staticmethod
    def _bordered(spec: dict) -> tuple[bool, bool]:
        """Whether white space borders every token and goes, and whether the case of ASCII words is of no account."""
        steps = lambda x, key: [] if x is None else [s for y in x[key] for s in steps(y, key)] if x["type"] == "Sequence" else [x]
        normal, before = steps(spec.get("normalizer"), "normalizers"), steps(spec.get("pre_tokenizer"), "pretokenizers")
        even = all(s["type"] in ("NFC", "Lowercase") or s["type"] == "Replace" and s["pattern"] == {"Regex": r"\s+"} and s["content"] == " " for s in normal)
        # a Split that drops all but matches of letters, digits and what is neither nor white space
        drops = bool(before) and before[0]["type"] == "Split" and before[0].get("invert") and before[0]["behavior"] == "Removed" and before[0]["pattern"].get("Regex", "").endswith(r"|[^\s\p{L}\p{N}]+")
        plain = all(s["type"] == "ByteLevel" and not s.get("add_prefix_space") for s in before[1:]) and all(not t.get("lstrip") and not t.get("rstrip") and not t.get("single_word") for t in spec.get("added_tokens", []))
        alternatives = before[0]["pattern"].get("Regex", "").split("|") if drops else []
        known = all(re.fullmatch(r"'[a-z]+|\[\\p\{[LN]\}\]\+?|\[\^\\s\\p\{L\}\\p\{N\}\]\+", a) for a in alternatives)
        return even and drops and plain and known, any(s["type"] == "Lowercase" for s in normal)

    def _forget(self) -> None:
        """Drop the words of few slices, so that what stays takes less than half of MEMORY_BYTES."""
        keep = np.zeros(0, np.int64)
        for least in range(2, 64):
            keep = np.flatnonzero(self.uses[: len(self.known)] >= least)
            if (len(keep) + 1) * self.held < len(self.known) * MEMORY_BYTES // 2:
                break
        else:
            keep = keep[:0]
        words = list(self.known)
        size, uses = self.size[keep], self.uses[keep]
        before = np.concatenate(([0], np.cumsum(size)))
        flat = self.flat[np.repeat(self.start[keep] - before[:-1], size) + np.arange(before[-1])]
        self._clear()
        self._store([words[i] for i in keep.tolist()], flat, size)
        self.uses[: len(keep)] = uses

    def _clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat, self.used, self.held = np.zeros(1 << 16, self.kind), 0, 0
        self.start, self.size, self.uses = (np.zeros(1 << 14, np.int64) for _ in range(3))

    def _store(self, words: list[bytes], flat: np.ndarray, size: np.ndarray) -> None:
        k, n = len(self.known), len(words)
        if self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.zeros(self.used + len(flat), self.kind)])
        if k + n > len(self.start):
            self.start, self.size, self.uses = (np.concatenate([x[:k], np.zeros(k + n, np.int64)]) for x in (self.start, self.size, self.uses))
        self.flat[self.used : self.used + len(flat)] = flat
        self.size[k : k + n], self.start[k : k + n], self.uses[k : k + n] = size, self.used + np.cumsum(size) - size, 0
        self.known.update(zip(words, range(k, k + n), strict=True))
        self.used += len(flat)
        self.held += sum(map(len, words)) + 150 * n

    def _learn(self, words: list[bytes]) -> None:
        # lower-case ASCII letters pass the normalizer and the pre-tokenizer as they are
        easy = [w for w in words if w.isalpha() and w.islower()] if self.lower else []
        for some, tokenizer in ((easy, self.bare), ([w for w in words if not (w.isalpha() and w.islower())] if easy else words, self.plain)):
            ids = [e.ids for e in tokenizer.encode_batch_fast([w.decode() for w in some], add_special_tokens=False)]
            self._store(some, np.fromiter(chain.from_iterable(ids), self.kind), np.fromiter(map(len, ids), np.int64, len(ids)))

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        rows = [np.array([*e.ids, self.end], self.kind) for e in self.plain.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate(rows), np.array([len(r) for r in rows], np.int64)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a slice of texts, each with its end id, and their numbers by text."""
        if not len(column):
            return np.zeros(0, self.kind), np.zeros(0, np.int64)
        if not self.by_word:
            return self._whole([t or "" for t in column.to_pylist()])
        w = Words(column, lower=self.lower)  # lower case of ASCII letters commutes with composition
        if self.added.search(w.data if self.lower else LOWER[w.data]):
            texts = column.to_pylist()
            odd = [bool(self.added.search((t or "").lower().encode())) for t in texts]
            if len(texts) == 1:
                return self._whole([texts[0] or ""])
            parts = [self._whole([texts[i]]) if o else self.encode(column.slice(i, 1)) for i, o in enumerate(odd)]
            return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        # the words without what stands between them, cut where a token always ends, as a dictionary
        byte, first = w.data[w._black], np.concatenate(([0], np.cumsum(w.end - w.start)))
        class_ = CLASS[byte]
        cut = CUTS[class_[:-1], class_[1:]]
        border = np.zeros(len(byte) + 1, bool)
        border[1:-1] = cut
        border[first] = True
        border = np.flatnonzero(border)
        size = np.diff(border)
        if self.lower:
            wide = np.concatenate(([0], np.cumsum(byte >= 0x80)))
            ascii_ = wide[border[1:]] == wide[border[:-1]]
            byte = np.where(np.repeat(ascii_, size), LOWER[byte], byte)
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(border), pa.py_buffer(byte)]).dictionary_encode()
        if self.held > MEMORY_BYTES:
            self._forget()
        words = coded.dictionary.to_pylist()
        new = [x for x in words if x not in self.known]
        if new:
            self._learn(new)
        place = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        self.uses[place] += 1
        word = place[np.asarray(coded.indices)]
        # ids of all words one after the other, and an end id behind each text
        n = self.size[word]
        before = np.concatenate(([0], np.cumsum(n)))
        text = np.searchsorted(border, first[w.first])
        row = np.repeat(np.arange(len(column)), np.diff(text))
        counts = before[text[1:]] - before[text[:-1]] + 1
        out = np.full(int(counts.sum()), self.end, self.kind)
        place = np.arange(before[-1]) + np.repeat(row, n)
        out[place] = self.flat[np.repeat(self.start[word] - before[:-1], n) + np.arange(before[-1])]
        return out, counts


_LOADED: dict[tuple[str, int], WordTokenizer] = {}


def loaded(path: str, end: int = END) -> WordTokenizer:
    """The tokenizer of a file, read once in a process."""
    if (path, end) not in _LOADED:
        _LOADED[path, end] = WordTokenizer(path, end)
    return _LOADED[path, end]


def _file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub("^file:/+", "file:///", uri) if ":" in uri.split("/")[0] else f"file://{uri}")


def _writer(folder: str, tokenizer: str, end: int):
    def run(batches):
        part, name = TaskContext.get().partitionId(), f"part-{uuid.uuid4().hex}"
        encoder, (system, root) = loaded(tokenizer, end), _file_system(folder)
        ends, ids, total = [], [], 0
        out = None
        for b in slices(batches, most=SLICE):
            if out is None:
                out = system.open_output_stream(f"{root}/{name}.bin")
            flat, counts = encoder.encode(b.column("text"))
            out.write(flat.tobytes())
            ends.append(total + np.cumsum(counts))
            ids.append(b.column("doc_id"))
            total += len(flat)
        if out is None:
            return
        out.close()
        docs = pa.chunked_array(ids).combine_chunks()
        with system.open_output_stream(f"{root}/{name}.idx") as index:
            index.write(np.concatenate(ends).astype("<u8").tobytes())
            index.write(np.asarray(docs.fill_null(0)).astype("<i8").tobytes())
            index.write(np.packbits(np.asarray(docs.is_null())).tobytes() if docs.null_count else b"")
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "name": [name], "documents": [len(docs)], "ids": [total]})

    return run


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end: int = END, part_bytes: int = PART_BYTES) -> dict:
    """Write the ids of docs (doc_id, text) to a folder that all executors reach; what its manifest holds."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // part_bytes))
    system, root = _file_system(folder)
    system.create_dir(root, recursive=True)
    keyed = texts.withColumn("_hash", F.xxhash64("text"))
    dealt = keyed.repartitionByRange(parts, "doc_id", "_hash").sortWithinPartitions("doc_id", "_hash").drop("_hash")
    held = columns(materialise(dealt.mapInArrow(_writer(folder, tokenizer, end), _PARTS), "parts"))
    order = np.argsort(held["part"])
    names, documents, ids = ([*held[c][order]] for c in ("name", "documents", "ids"))
    base = lambda counts: [0, *np.cumsum(counts)[:-1].tolist()] if counts else []
    rows = [{"name": n, "documents": int(d), "ids": int(i), "first_document": a, "first_id": b} for n, d, i, a, b in zip(names, documents, ids, base(documents), base(ids), strict=True)]
    manifest = {"dtype": loaded(tokenizer, end).kind.str, "end": end, "documents": int(sum(documents)), "ids": int(sum(ids)), "parts": rows}
    with system.open_output_stream(f"{root}/manifest.json") as out:
        out.write(json.dumps(manifest).encode())
    return manifest


class Part:
    """One part, mapped: ids and offsets stay in the files until they are looked at."""

    def __init__(self, folder: str, manifest: dict, part: dict):
        system, root = _file_system(folder)
        kind = np.dtype(manifest["dtype"])
        if isinstance(system, pafs.LocalFileSystem):
            flat, index = (np.memmap(f"{root}/{part['name']}.{x}", np.uint8, "r") for x in ("bin", "idx"))
            self._read = lambda a, b: flat[a * kind.itemsize : b * kind.itemsize].view(kind)
        else:
            file = system.open_input_file(f"{root}/{part['name']}.bin")
            self._read = lambda a, b: np.frombuffer(file.read_at((b - a) * kind.itemsize, a * kind.itemsize), kind)
            with system.open_input_stream(f"{root}/{part['name']}.idx") as x:
                index = np.frombuffer(x.read(), np.uint8)
        n = part["documents"]
        self.base, self.ends, self.doc_ids = part["first_id"], index[: 8 * n].view("<u8"), index[8 * n : 16 * n].view("<i8")
        self.null = np.unpackbits(np.asarray(index[16 * n :]), count=n).astype(bool) if len(index) > 16 * n else np.zeros(n, bool)

    def __len__(self) -> int:
        return len(self.ends)

    def bounds(self, i: int) -> tuple[int, int]:
        return int(self.ends[i - 1]) if i else 0, int(self.ends[i])

    def __getitem__(self, i: int) -> np.ndarray:
        return self._read(*self.bounds(i))

    def chunks(self, i: int, most: int = READ_IDS) -> Iterator[np.ndarray]:
        """The ids of a document, a bounded number at a time."""
        a, b = self.bounds(i)
        for at in range(a, b, most):
            yield self._read(at, min(at + most, b))


class Tokens:
    """Random access to a folder: the i-th document of all."""

    def __init__(self, folder: str):
        system, root = _file_system(folder)
        with system.open_input_stream(f"{root}/manifest.json") as f:
            self.manifest = json.loads(f.read())
        self.folder, self.first = folder, [p["first_document"] for p in self.manifest["parts"]]
        self._open: dict[int, Part] = {}

    def __len__(self) -> int:
        return self.manifest["documents"]

    def __getitem__(self, i: int) -> np.ndarray:
        if not 0 <= i < len(self):
            raise IndexError(i)
        k = int(np.searchsorted(self.first, i, "right")) - 1
        if k not in self._open:
            self._open[k] = Part(self.folder, self.manifest, self.manifest["parts"][k])
        return self._open[k][i - self.first[k]]


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files."""
    manifest = Tokens(folder).manifest
    shared = spark.sparkContext.broadcast(manifest)

    def run(batches):
        for b in batches:
            for k in b.column("id").to_pylist():
                part = Part(folder, shared.value, shared.value["parts"][k])
                for low in range(0, len(part), 1 << 14):
                    high = min(low + (1 << 14), len(part))
                    crc = []
                    for i in range(low, high):
                        x = 0
                        for ids in part.chunks(i):
                            x = zlib.crc32(ids.astype("<u4"), x)
                        crc.append(x)
                    ends = np.asarray(part.ends[low:high]).astype(np.int64)
                    start = np.concatenate(([part.bounds(low)[0]], ends[:-1]))
                    doc = pa.array(np.asarray(part.doc_ids[low:high]).astype(np.int64), mask=part.null[low:high])
                    yield pa.RecordBatch.from_arrays([doc, pa.array(start + part.base), pa.array(ends - start), pa.array(crc, pa.int64())], names=[x.split()[0] for x in SCHEMA.split(", ")])

    n = len(manifest["parts"])
    return spark.range(0, n, 1, max(1, n)).mapInArrow(run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{scratch_root(spark)}/palisade/tokens-{uuid.uuid4().hex}"
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder, public_tokenizers.path("word_bpe_49k.json"))
    return read_tokens(spark, folder)
