"""Package inventories: parsers of package databases and lockfiles, over columns of file contents."""

from __future__ import annotations

import sqlite3

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions import scalar as S


def _last_field(block: Column, name: str) -> Column:
    return S.last(F.regexp_extract_all(block, F.lit(rf"(?md)^{name}(.*)$"), F.lit(1)))


def _blocks(df: DataFrame) -> DataFrame:
    keep = [c for c in df.columns if c != "content"]
    return df.select(*keep, F.explode(F.split(F.col("content").cast("string"), r"\n(?:[ \t\r]*\n)+")).alias("_block"))


def apk(files: DataFrame) -> DataFrame:
    """An Alpine database (content) -> name, version of each block that has both."""
    out = _blocks(files).select("*", S.strip(_last_field(F.col("_block"), "P:")).alias("name"), S.strip(_last_field(F.col("_block"), "V:")).alias("version"))
    return out.drop("_block").where("name <> '' and version <> ''")


def dpkg(files: DataFrame) -> DataFrame:
    """A Debian status file -> name, version of each block whose status contains "installed"."""
    out = _blocks(files).select("*", *[S.strip(_last_field(F.col("_block"), f"{k}: ")).alias(v) for k, v in (("Package", "name"), ("Version", "version"), ("Status", "_status"))])
    return out.where("name <> '' and version <> '' and contains(_status, 'installed')").drop("_block", "_status")


def os_release(files: DataFrame) -> DataFrame:
    """An os-release file -> distro, version."""
    field = lambda name: F.coalesce(F.regexp_replace(S.strip(_last_field(F.col("content").cast("string"), name)), "^[\"']+|[\"']+$", ""), F.lit(""))
    return files.select(*[c for c in files.columns if c != "content"], field("ID=").alias("distro"), field("VERSION_ID=").alias("version"))


def rpm(files: DataFrame) -> DataFrame:
    """RPM databases in SQLite (key, content) -> key, name, version; unreadable ones give nothing."""

    def read(batches):
        for b in batches:
            keys, names, versions = [], [], []
            for key, content in zip(b.column("key").to_pylist(), b.column("content").to_pylist(), strict=True):
                if not (content or b"").startswith(b"SQLite format 3\0"):
                    continue
                db = sqlite3.connect(":memory:")
                try:
                    db.deserialize(content)
                    rows = db.execute("SELECT name, version, release FROM packages").fetchall()
                except sqlite3.Error:
                    rows = []
                finally:
                    db.close()
                for name, version, release in rows:
                    keys.append(key)
                    names.append(name)
                    versions.append(f"{version}-{release}" if release else version)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(names, pa.string()), pa.array(versions, pa.string())], names=["key", "name", "version"])

    return files.select(F.col("key").cast("string").alias("key"), F.col("content").cast("binary").alias("content")).mapInArrow(read, "key string, name string, version string")


def requirements(files: DataFrame) -> DataFrame:
    """requirements.txt (path, text) -> pinned packages."""
    lines = files.select("path", F.explode(S.lines_scanned(F.col("text"))).alias("_l"))
    pin = r"^\s*([A-Za-z0-9][A-Za-z0-9._-]*)(?:\[[^\]]*\])?\s*==\s*([^\s;#]+)"
    return lines.select("path", F.regexp_extract("_l", pin, 1).alias("name"), F.regexp_extract("_l", pin, 2).alias("version"), F.lit("PyPI").alias("ecosystem")).where("name <> ''")


def go_modules(files: DataFrame) -> DataFrame:
    """go.mod -> required modules."""
    lines = files.select("path", F.explode(S.lines_scanned(F.col("text"))).alias("_l"))
    need = r"^\s*(?:require\s+)?([^\s()/]+\.[^\s()]+)\s+v([^\s]+)"
    return lines.select("path", F.regexp_extract("_l", need, 1).alias("name"), F.regexp_extract("_l", need, 2).alias("version"), F.lit("Go").alias("ecosystem")).where("name <> ''")


def package_lock(files: DataFrame) -> DataFrame:
    """package-lock.json -> packages, from both of its forms."""
    one = "struct<version:string>"
    d = files.select("path", F.from_json("text", f"packages map<string,{one}>, dependencies map<string,{one}>").alias("_j"))
    new = d.select("path", F.explode(F.map_entries("_j.packages")).alias("_e")).select("path", F.regexp_extract("_e.key", r"(?:^|/)node_modules/((?:@[^/]+/)?[^/]+)$", 1).alias("name"), F.col("_e.value.version").alias("version"))
    old = d.where("_j.packages is null").select("path", F.explode(F.map_entries("_j.dependencies")).alias("_e")).select("path", F.col("_e.key").alias("name"), F.col("_e.value.version").alias("version"))
    return new.union(old).where("name <> '' and version is not null").withColumn("ecosystem", F.lit("npm"))


def layer_files(entries: DataFrame) -> DataFrame:
    """Contents that layers hold by path; a later entry of an archive overwrites an earlier one."""
    return entries.groupBy("image", "layer_index", "path").agg(F.max_by("content", "tar_pos").alias("content"))
