"""Folders that all executors share, reached from tasks by their URIs."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyarrow import fs as pafs
from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """The URI of a new folder below the session's spark.checkpoint.dir; below a local one only where that is unset and
    Spark has no other machine, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="palisade-")
    return f"{root.rstrip('/')}/palisade/{name}-{uuid.uuid4().hex}"


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """pyarrow's file system of a URI or an absolute path, and the path in it."""
    if re.match("[a-z0-9]+:", uri):
        return pafs.FileSystem.from_uri(re.sub("^file:/+", "file:///", uri))
    return pafs.LocalFileSystem(), uri
