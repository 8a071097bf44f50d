"""Image archives, as docker save writes them: tables of the entries of their layers."""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import tarfile
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.sinks.folders import file_system

# Package databases and release files of distributions.
APK, DPKG, RPM = ("lib/apk/db/installed",), ("var/lib/dpkg/status",), ("var/lib/rpm/rpmdb.sqlite", "usr/lib/sysimage/rpm/rpmdb.sqlite")
RELEASE = ("etc/os-release", "usr/lib/os-release")
ENTRIES = "image string, layer_index int, layer_digest string, tar_pos int, path string, kind string, size long, content binary"


def entries(archives: DataFrame, wanted: tuple[str, ...] = (), leaves: tuple[str, ...] = (), max_bytes: int = 10 << 20) -> DataFrame:
    """archives (image, content), plain or gzip -> a row for each entry of each layer, in order; content only of files of
    the wanted paths or base names of at most max_bytes (of wanted paths, of any size). Broken archives give nothing."""

    def rows(image: str, content: bytes):
        raw = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
        with tarfile.open(fileobj=io.BytesIO(raw)) as t:
            layers = json.load(t.extractfile("manifest.json"))[0]["Layers"]
            for index, name in enumerate(layers):
                data = t.extractfile(name).read()
                data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
                digest = "sha256:" + hashlib.sha256(data).hexdigest()
                with tarfile.open(fileobj=io.BytesIO(data)) as layer:
                    for at, m in enumerate(layer):
                        path = m.name.removeprefix("./").lstrip("/")
                        keep = m.isfile() and (path in wanted or path.rsplit("/", 1)[-1] in leaves and m.size <= max_bytes)
                        yield image, index, digest, at, path, "file" if m.isfile() else "dir" if m.isdir() else "other", m.size, layer.extractfile(m).read() if keep else None

    def run(batches):
        kinds = pa.schema([("image", pa.string()), ("layer_index", pa.int32()), ("layer_digest", pa.string()), ("tar_pos", pa.int32()), ("path", pa.string()), ("kind", pa.string()), ("size", pa.int64()), ("content", pa.binary())])
        for b in batches:
            for image, content in zip(b.column("image").to_pylist(), b.column("content").to_pylist(), strict=True):
                try:
                    out = list(rows(image, content or b""))
                except (tarfile.TarError, OSError, ValueError, KeyError, IndexError, TypeError, EOFError):
                    continue
                for i in range(0, len(out), 4096):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*out[i : i + 4096], strict=True), kinds, strict=True)], schema=kinds)

    return archives.select(F.col("image").cast("string").alias("image"), F.col("content").cast("binary").alias("content")).mapInArrow(run, ENTRIES)


# archives that are files: a task reads a layer, and holds one entry of it at a time

_LAYER = "image string, path string, layer_index int, name string, offset long, size long"
_KINDS = pa.schema([("image", pa.string()), ("layer_index", pa.int32()), ("layer_digest", pa.string()), ("tar_pos", pa.int32()), ("path", pa.string()), ("kind", pa.string()), ("size", pa.int64()), ("content", pa.binary())])
_BROKEN = (tarfile.TarError, OSError, ValueError, KeyError, IndexError, TypeError, EOFError, zlib.error)
#: Bytes of contents and rows of a batch.
BATCH_BYTES, BATCH_ROWS, BLOCK = 16 << 20, 4096, 1 << 20


class _Slice(io.RawIOBase):
    """Bytes [at, at + size) of a file as a file."""

    def __init__(self, file, at: int, size: int):
        self.file, self.at, self.left = file, at, size

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        self.file.seek(self.at)
        data = self.file.read(min(len(into), self.left))
        into[: len(data)] = data
        self.at, self.left = self.at + len(data), self.left - len(data)
        return len(data)


def _plain(file):
    """A file as it is, or what it holds if it is gzip."""
    file = io.BufferedReader(file, BLOCK) if isinstance(file, io.RawIOBase) else file
    return gzip.GzipFile(fileobj=file) if file.peek(2)[:2] == b"\x1f\x8b" else file


def _digest(file) -> str:
    h = hashlib.sha256()
    while block := file.read(BLOCK):
        h.update(block)
    return f"sha256:{h.hexdigest()}"


def _layers_of(path: str) -> list[tuple[int, str, int | None, int]]:
    """(index, name, offset, size) of the layers of an archive; offsets are null in one that is gzip as a whole."""
    system, inner = file_system(path)
    with system.open_input_file(inner) as f:
        packed = f.read(2) == b"\x1f\x8b"
        f.seek(0)
        with tarfile.open(fileobj=gzip.GzipFile(fileobj=f) if packed else f) as t:
            members = {m.name: m for m in t}
            layers = json.load(t.extractfile("manifest.json"))[0]["Layers"]
    return [(i, n, None if packed else members[n].offset_data, members[n].size) for i, n in enumerate(layers)]


def _opened(path: str, name: str, offset: int | None, size: int):
    """(file to close, the layer as a file)."""
    system, inner = file_system(path)
    f = system.open_input_file(inner)
    if offset is not None:
        return f, _plain(_Slice(f, offset, size))
    t = tarfile.open(fileobj=gzip.GzipFile(fileobj=f))  # noqa: SIM115
    return f, _plain(io.BufferedReader(t.extractfile(name), BLOCK))


def file_entries(archives: DataFrame, wanted: tuple[str, ...] = (), leaves: tuple[str, ...] = (), max_bytes: int = 10 << 20) -> DataFrame:
    """entries() of archives (image, path) that all executors can open: each layer is a row of its own, streamed by the task
    that gets it, so an image of any size is read in parallel and by pieces. A layer that breaks off gives nothing, nor does
    an archive that can't be read. An archive that is gzip as a whole is decompressed by each of its layers' tasks."""

    def layers(batches):
        for b in batches:
            for image, path in zip(b.column("image").to_pylist(), b.column("path").to_pylist(), strict=True):
                try:
                    found = _layers_of(path)
                except _BROKEN:
                    continue
                if found:
                    index, name, offset, size = zip(*found, strict=True)
                    n = len(found)
                    yield pa.RecordBatch.from_arrays([pa.array([image] * n, pa.string()), pa.array([path] * n, pa.string()), pa.array(index, pa.int32()), pa.array(name, pa.string()), pa.array(offset, pa.int64()), pa.array(size, pa.int64())], names=[x.split()[0] for x in _LAYER.split(", ")])

    def rows(image, path, index, name, offset, size):
        f, layer = _opened(path, name, offset, size)
        with f:
            digest = _digest(layer)
        f, layer = _opened(path, name, offset, size)
        with f, tarfile.open(fileobj=layer, mode="r|") as t:
            for at, m in enumerate(t):
                own = m.name.removeprefix("./").lstrip("/")
                keep = m.isfile() and (own in wanted or own.rsplit("/", 1)[-1] in leaves and m.size <= max_bytes)
                yield image, index, digest, at, own, "file" if m.isfile() else "dir" if m.isdir() else "other", m.size, t.extractfile(m).read() if keep else None

    def whole(row) -> bool:
        try:
            f, layer = _opened(*row[1:2], *row[3:])
            with f, tarfile.open(fileobj=layer, mode="r|") as t:
                for _ in t:
                    pass
            return True
        except _BROKEN:
            return False

    def run(batches):
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if not whole(row):
                    continue
                out, held = [], 0
                for x in rows(*row):
                    out.append(x)
                    held += len(x[-1] or b"")
                    if held > BATCH_BYTES or len(out) == BATCH_ROWS:
                        yield _batch(out)
                        out, held = [], 0
                if out:
                    yield _batch(out)

    found = archives.select(F.col("image").cast("string").alias("image"), F.col("path").cast("string").alias("path")).where("path IS NOT NULL").mapInArrow(layers, _LAYER)
    parts = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return found.repartition(parts, "path", "layer_index").mapInArrow(run, ENTRIES)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], schema=_KINDS)
