"""One document of any size, written by many tasks.

A document is a frame around sections of items: the first text of the frame, the items of section 0 with commas between
them, the second text, and so on. Its DataFrame has the columns section and json, sorted by section and then as the
items shall stand. Each task streams what it has of a section to a fragment of its own; the commit puts the fragments of
the tasks that succeeded into one file, in order, and renames it to its final name, so readers see a whole document or
none, and a failed job leaves only its fragments, which it deletes. No task holds more than a batch of items, and no row
holds more than one item. On file systems of this machine or mounted ones the kernel copies fragments (sharing blocks
where it can); on others they are streamed in blocks.
"""

from __future__ import annotations

import json
import os
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from palisade.sinks.folders import file_system

BLOCK = 8 << 20


@dataclass
class Fragments(WriterCommitMessage):
    """What a task has written: its place among the tasks, and (section, file name, bytes) in order."""

    place: int
    files: list[tuple[int, str, int]]


class DocumentSource(DataSource):
    """Options: path; frame, a JSON list of texts, one more than there are sections."""

    @classmethod
    def name(cls) -> str:
        return "palisade_document"

    def writer(self, schema: StructType, overwrite: bool) -> DocumentWriter:
        return DocumentWriter(self.options["path"], json.loads(self.options["frame"]), schema)


class DocumentWriter(DataSourceArrowWriter):
    def __init__(self, path: str, frame: list[str], schema: StructType):
        if schema.fieldNames() != ["section", "json"]:
            raise ValueError(f"a document has the columns section and json, not {schema.fieldNames()}")
        self.path, self.frame = path, frame
        self.staging = f"{posixpath.dirname(path.rstrip('/'))}/.{posixpath.basename(path.rstrip('/'))}-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Fragments:
        system, staging = file_system(self.staging)
        system.create_dir(staging, recursive=True)
        place, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        files: list[tuple[int, str, int]] = []
        out, section, size = None, -1, 0
        for batch in iterator:
            for at, item in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if at != section or out is None:
                    if at < section or at >= len(self.frame) - 1:
                        raise ValueError(f"section {at} after {section} in a frame of {len(self.frame) - 1}")
                    if out is not None:
                        out.close()
                        files.append((section, name, size))
                    name, section, size = f"{place:08d}-{attempt}-{at}", at, 0
                    out = system.open_output_stream(f"{staging}/{name}", buffer_size=1 << 20)
                data = (b",\n" if size else b"") + item.encode()
                out.write(data)
                size += len(data)
        if out is not None:
            out.close()
            files.append((section, name, size))
        return Fragments(place, files)

    def commit(self, messages: list[Fragments | None]) -> None:
        system, staging = file_system(self.staging)
        _, path = file_system(self.path)
        system.create_dir(staging, recursive=True)
        done = sorted((m for m in messages if m is not None), key=lambda m: m.place)
        with _Output(system, f"{staging}/document") as out:
            for section, before in enumerate(self.frame[:-1]):
                out.text(before)
                for i, (name, size) in enumerate((n, b) for m in done for s, n, b in m.files if s == section):
                    out.text(",\n" if i else "")
                    out.file(f"{staging}/{name}", size)
            out.text(self.frame[-1])
        system.move(f"{staging}/document", path)
        system.delete_dir(staging)

    def abort(self, messages: list[Fragments | None]) -> None:
        system, staging = file_system(self.staging)
        if system.get_file_info(staging).type != pafs.FileType.NotFound:
            system.delete_dir(staging)


class _Output:
    """A file that is put together from texts and other files."""

    def __init__(self, system: pafs.FileSystem, path: str):
        self.system = system
        self.local = isinstance(system, pafs.LocalFileSystem)
        self.out = open(path, "wb", buffering=0) if self.local else system.open_output_stream(path)  # noqa: SIM115

    def __enter__(self) -> _Output:
        return self

    def __exit__(self, *_) -> None:
        if self.local:
            os.fsync(self.out.fileno())
        self.out.close()

    def text(self, text: str) -> None:
        data = memoryview(text.encode())
        while data:
            data = data[self.out.write(data) or len(data) :]

    def file(self, path: str, size: int) -> None:
        if not self.local:
            with self.system.open_input_stream(path) as f:
                while block := f.read(BLOCK):
                    self.out.write(block)
            return
        with open(path, "rb") as f:
            at = 0
            while at < size:
                n = os.sendfile(self.out.fileno(), f.fileno(), at, min(size - at, 1 << 30))
                if not n:
                    raise OSError(f"{path} ends after {at} of {size} bytes")
                at += n


def write_document(sections: DataFrame, path: str, frame: list[str]) -> None:
    """Write sections (section, json), which are sorted, as one document at path, a URI that all executors reach."""
    spark = sections.sparkSession
    spark.dataSource.register(DocumentSource)
    sections.select("section", "json").write.format("palisade_document").option("path", path).option("frame", json.dumps(frame)).mode("overwrite").save()
