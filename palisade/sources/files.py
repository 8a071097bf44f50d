"""Files: from tables of texts, from directories, and what says which of them count."""

from __future__ import annotations

import json
import os
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.functions import scalar as S

# Names of directories that scans skip, files that hold licenses, lockfiles.
SECRET_SKIP = ("vendor", "node_modules", ".git", "dist", "build", "__pycache__", ".venv", "venv", "target")
SOURCE_SKIP = (*SECRET_SKIP, ".tox", ".gradle", "out")
LICENSE_SKIP = ("vendor", "node_modules", ".git", "dist", "build")
LICENSE_FILES = ("LICENSE", "LICENSE.md", "LICENSE.txt", "LICENCE", "LICENCE.md", "LICENCE.txt", "COPYING", "COPYING.md", "COPYING.txt")
LOCKFILES = (
    "requirements.txt", "requirements-dev.txt", "Pipfile.lock", "poetry.lock", "pdm.lock", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "go.sum", "go.mod", "Gemfile.lock",
    "Cargo.lock", "composer.lock", "pom.xml", "build.gradle", "build.gradle.kts", "packages.lock.json", "packages.config", "pubspec.lock", "mix.lock", "rebar.lock",
)
MAX_LOCKFILE = 10 << 20


#: Inputs of fewer bytes, which may be one row group, are dealt to all cores before they are searched.
SMALL_BYTES = 64 << 20


def spread(df: DataFrame) -> DataFrame:
    if df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < SMALL_BYTES:
        return df.repartition(df.sparkSession.sparkContext.defaultParallelism)
    return df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table as files: path (source/doc_id), text."""
    d = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))
    return d.select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), "text")


def directory(spark: SparkSession, root: str) -> DataFrame:
    """Files below a directory: path relative to it, size, content. Filters on size reach the scan. A root without a scheme
    is a local path, and may be relative."""
    root = root if "://" in root or root.startswith("file:") else os.path.abspath(root)
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true").load(root)
    absolute, base = F.regexp_replace("path", "^file:/+", "/"), re.sub("^file:/+", "/", root).rstrip("/") + "/"
    return d.select(F.when(absolute.startswith(base), F.substring(absolute, len(base) + 1, 1 << 20)).otherwise(absolute).alias("path"), F.col("length").alias("size"), "content")


def outside(path: Column, names: tuple[str, ...]) -> Column:
    """Whether no directory of the path has one of the names."""
    folders = F.split(path, "/")
    return ~F.arrays_overlap(F.slice(folders, F.lit(1), F.size(folders) - 1), F.array(*[F.lit(n) for n in names]))


def for_secrets(files: DataFrame, exclude: list[str] = (), max_bytes: int = 100 << 20) -> DataFrame:
    """Files to scan for secrets: path, size. Excludes name a base name or a whole path exactly."""
    p = F.col("path")
    return files.where(outside(p, SECRET_SKIP) & F.col("size").between(1, max_bytes) & ~S.basename(p).isin(*exclude) & ~p.isin(*exclude))


def for_source(files: DataFrame, languages: list[str] = (), max_bytes: int = 512 << 10) -> DataFrame:
    """Files to scan as source code, with their language."""
    out = files.where(outside(F.col("path"), SOURCE_SKIP) & F.col("size").between(1, max_bytes)).withColumn("language", S.language(F.col("path"))).where("language <> ''")
    return out.where(F.col("language").isin(*languages)) if languages else out


def license_files(files: DataFrame) -> DataFrame:
    """One license file of each directory, the first by path: package, path."""
    p = F.col("path")
    own = files.where(outside(p, LICENSE_SKIP) & S.basename(p).isin(*LICENSE_FILES)).withColumn("package", F.regexp_replace(p, "/?[^/]*$", ""))
    return own.groupBy("package").agg(F.min("path").alias("path"))


def lockfiles(entries: DataFrame) -> DataFrame:
    """Entries (path, size, kind) that may be lockfiles."""
    return entries.where((F.col("kind") == "file") & S.basename(F.col("path")).isin(*LOCKFILES) & (F.col("size") <= MAX_LOCKFILE) & S.safe_relative(F.col("path")))


# Extensions of source files of which changes count.
CODE = (".go", ".py", ".js", ".ts", ".jsx", ".tsx", ".java", ".rb", ".rs", ".php", ".c", ".cpp", ".cs", ".kt", ".swift", ".sh")


def changed_list(listed: DataFrame, most: int = 100) -> DataFrame:
    """Changed files (ord, path) of a request, as its host lists them: source files among the first `most`."""
    first = listed.orderBy("ord").limit(most)
    return first.where(F.concat(F.lit("."), F.lower(F.substring_index(S.basename(F.col("path")), ".", -1))).isin(*CODE)).select("path")


def changed(hashes: DataFrame, known: DataFrame) -> DataFrame:
    """Files (path, sha256) that are new or differ from a known state (path, sha256)."""
    old = known.select("path", F.col("sha256").alias("_old"))
    return hashes.join(old, "path", "left").where(~F.col("sha256").eqNullSafe(F.col("_old"))).drop("_old")


def remembered(known: DataFrame, finished: DataFrame) -> DataFrame:
    """The state after a scan: hashes of finished files replace what was known; nothing is forgotten."""
    return known.join(finished.select("path"), "path", "left_anti").select("path", "sha256").unionByName(finished.select("path", "sha256"))


def save_state(state: DataFrame, path: str) -> None:
    """A state (path, sha256) as the JSON that load_state() reads, written by all executors as one document."""
    from palisade.sinks.document import write_document

    quoted = lambda c: F.regexp_replace(F.to_json(F.struct(F.col(c).alias("k"))), r'^\{"k":|\}$', "")
    write_document(state.orderBy("path").select(F.lit(0).alias("section"), F.concat(quoted("path"), F.lit(": "), quoted("sha256")).alias("json")), path, ['{"hashes": {\n', "\n}}\n"])


def load_state(spark: SparkSession, path: str) -> DataFrame:
    """A JSON state of hashes; missing or broken ones are empty."""
    try:
        hashes = json.loads(Path(path).read_text())["hashes"]
        rows = [(str(k), str(v)) for k, v in hashes.items()]
    except (OSError, ValueError, KeyError, TypeError, AttributeError):
        rows = []
    return spark.createDataFrame(rows, "path string, sha256 string")
