"""A table by key that is changed in place: an upsert writes what changes, and a new manifest that names all files.

Rows lie in buckets by the hash of their key. An upsert writes its rows as a layer over the buckets that they fall in and
touches no other; a bucket whose layers have grown past MERGE of its base is merged into a new base, so each row is
rewritten a bounded number of times as a bucket grows, and reading meets few layers. The manifest of a version is written
last and never changed, under a name that only one writer can get: readers see all of an upsert or nothing, a failed one
leaves the version before, and of two at once one fails and can be repeated. Old versions stay readable until vacuum().
"""

from __future__ import annotations

import json
import os
import re
import uuid
from dataclasses import dataclass

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palisade.sinks.folders import file_system

#: Share of a bucket's base that its layers may have before they are merged.
MERGE = 0.3


class Conflict(RuntimeError):
    """Another writer has made the next version meanwhile."""


@dataclass(frozen=True)
class Version:
    """What a manifest holds; files are (bucket, layer, path below the table's folder, bytes), layer 0 is the base."""

    number: int
    keys: list[str]
    buckets: int
    schema: str
    files: list[tuple[int, int, str, int]]

    def of(self, buckets) -> list[tuple[int, int, str, int]]:
        return [f for f in self.files if f[0] in buckets]


class KeyedTable:
    """A table in a folder that all executors reach. keys: columns that name a row; null is a key like others."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.system, self.root = file_system(self.folder)

    # versions

    def versions(self) -> list[int]:
        found = self.system.get_file_info(pafs.FileSelector(f"{self.root}/manifests", allow_not_found=True))
        return sorted(int(m[1]) for f in found if (m := re.fullmatch(r"(\d+)\.json", f.base_name)))

    def version(self, number: int | None = None) -> Version | None:
        there = self.versions()
        if not there:
            return None
        with self.system.open_input_stream(f"{self.root}/manifests/{there[-1] if number is None else number:010d}.json") as f:
            held = json.loads(f.read())
        return Version(**held | {"files": [tuple(x) for x in held["files"]]})

    def _publish(self, version: Version) -> None:
        self.system.create_dir(f"{self.root}/manifests", recursive=True)
        target, own = f"{self.root}/manifests/{version.number:010d}.json", f"{self.root}/manifests/.{uuid.uuid4().hex}"
        with self.system.open_output_stream(own) as f:
            f.write(json.dumps(version.__dict__).encode())
        try:
            if isinstance(self.system, pafs.LocalFileSystem):
                os.link(own, target)  # fails if it is there, at once for all writers
            elif self.system.get_file_info(target).type != pafs.FileType.NotFound:
                raise FileExistsError(target)
            else:
                self.system.move(own, target)
        except FileExistsError as e:
            raise Conflict(f"version {version.number} of {self.folder} exists") from e
        finally:
            if self.system.get_file_info(own).type != pafs.FileType.NotFound:
                self.system.delete_file(own)

    # rows

    def _read(self, version: Version, files: list[tuple[int, int, str, int]], layer: bool = False) -> DataFrame:
        schema = f"{version.schema}, _layer int"
        df = self.spark.read.schema(schema).parquet(*[f"{self.folder}/{f[2]}" for f in files]) if files else self.spark.createDataFrame([], schema)
        return df if layer else df.drop("_layer")

    @staticmethod
    def _names(version: Version) -> list[str]:
        return [x.strip("`") for x in re.findall(r"(`[^`]+`) ", version.schema + " ")]

    def _merged(self, version: Version, files: list[tuple[int, int, str, int]]) -> DataFrame:
        """Rows of buckets with layers: of each key the one of the last layer. Layers are small beside their base, so the base
        is only looked up in them."""
        over = self._read(version, [f for f in files if f[1]], layer=True)
        if len({f[1] for f in files}) > 2:
            last = F.row_number().over(Window.partitionBy(*version.keys).orderBy(F.desc("_layer")))
            over = over.withColumn("_n", last).where("_n = 1").drop("_n")
        base = self._read(version, [f for f in files if not f[1]])
        return _without_keys(base, over, version.keys).unionByName(over.drop("_layer"))

    def read(self, number: int | None = None) -> DataFrame:
        """The rows of a version, or of the last one. Buckets without layers are read as they are."""
        version = self.version(number)
        if version is None:
            raise FileNotFoundError(f"{self.folder} has no version")
        layered = {f[0] for f in version.files if f[1]}
        if not layered:
            return self._read(version, version.files)
        plain = self._read(version, [f for f in version.files if f[0] not in layered])
        return plain.unionByName(self._merged(version, version.of(layered)))

    # changes

    def _bucketed(self, df: DataFrame, keys: list[str], buckets: int) -> DataFrame:
        return df.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))

    def _write(self, df: DataFrame) -> list[tuple[int, int, str, int]]:
        """Write rows with _bucket and _layer to new files, one for each bucket."""
        own = f"data/{uuid.uuid4().hex}"
        df.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.folder}/{own}")
        out = []
        for f in self.system.get_file_info(pafs.FileSelector(f"{self.root}/{own}", recursive=True)):
            if m := re.search(rf"({own}/_bucket=(\d+)/[^/]+\.parquet)$", f.path):
                out.append((int(m[2]), 0, m[1], f.size))
        return out

    def create(self, rows: DataFrame, keys: list[str], buckets: int = 64) -> Version:
        """The first version. Of rows with equal keys one stays, the greatest by all columns."""
        if self.versions():
            raise Conflict(f"{self.folder} exists")
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        files = self._write(self._bucketed(_one_each(rows, keys).withColumn("_layer", F.lit(0)), keys, buckets))
        version = Version(1, keys, buckets, schema, files)
        self._publish(version)
        return version

    def upsert(self, changes: DataFrame) -> Version:
        """Rows of changes, which has the table's columns, replace those of their keys or are added. The new version; what it
        has written is in its files that the one before has not."""
        old = self.version()
        if old is None:
            raise FileNotFoundError(f"{self.folder} has no version")
        layer = old.number + 1
        new = _one_each(changes.select(*self._names(old)), old.keys).withColumn("_layer", F.lit(layer))
        files = [(b, layer, path, size) for b, _, path, size in self._write(self._bucketed(new, old.keys, old.buckets))]
        every = [*old.files, *files]
        base, over = ({b: 0 for b, *_ in every} for _ in range(2))
        for b, at, _, size in every:
            (over if at else base)[b] += size
        grown = {b for b, *_ in files if over[b] > MERGE * base[b]}
        if grown:
            version = Version(layer, old.keys, old.buckets, old.schema, every)
            merged = self._write(self._bucketed(self._merged(version, version.of(grown)).withColumn("_layer", F.lit(0)), old.keys, old.buckets))
            every = [*(f for f in every if f[0] not in grown), *merged]
        version = Version(layer, old.keys, old.buckets, old.schema, every)
        self._publish(version)
        return version

    def vacuum(self, keep: int = 2) -> int:
        """Delete manifests but for the last `keep`, and files that none of these name. How many files went. Not beside a writer."""
        there = self.versions()
        named = {f[2] for n in there[-keep:] for f in self.version(n).files}
        for n in there[:-keep]:
            self.system.delete_file(f"{self.root}/manifests/{n:010d}.json")
        gone = 0
        for f in self.system.get_file_info(pafs.FileSelector(f"{self.root}/data", recursive=True, allow_not_found=True)):
            if (m := re.search(r"(data/[0-9a-f]{32}/_bucket=\d+/[^/]+\.parquet)$", f.path)) and m[1] not in named:
                self.system.delete_file(f.path)
                gone += 1
        return gone


def _without_keys(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """df without the rows whose key other has; nulls are equal."""
    right = other.select(*[F.col(k).alias(f"_{k}") for k in keys])
    equal = F.lit(True)
    for k in keys:
        equal = equal & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return df.join(right, equal, "left_anti")


def _one_each(rows: DataFrame, keys: list[str]) -> DataFrame:
    every = F.struct(*rows.columns)
    return rows.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.max(every).alias("_row")).select("_row.*")


def comment_upserts(comments: DataFrame, wanted: DataFrame, marker: str, most: int = 50) -> DataFrame:
    """comments (place, id, body) that there are and wanted (place, body) -> place, id, body, action: of the first `most`
    comments of a place, the first whose body holds the marker is edited; where there is none, one is made (id null)."""
    first = comments.withColumn("_n", F.row_number().over(Window.partitionBy("place").orderBy("id"))).where(F.col("_n") <= most)
    own = first.where(F.contains("body", F.lit(marker))).groupBy("place").agg(F.min("id").alias("id"))
    return wanted.join(own, "place", "left").select("place", "id", "body", F.when(F.col("id").isNull(), "create").otherwise("edit").alias("action"))
