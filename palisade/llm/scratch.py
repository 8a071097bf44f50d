"""Intermediate tables in the folder that the whole cluster shares.

Executors may be lost at any time, so what an iterative plan needs again is written as Parquet under
``spark.checkpoint.dir`` and reread: the lineage ends there and every executor sees the files.
"""

from __future__ import annotations

import gc
import re
import tempfile
import time
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; a new local folder only where that is unset and Spark has no other machine, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="palisade-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


#: Bytes of an Arrow batch between Spark and Python, where the session has Spark's default of 64 MB.
BATCH_BYTES = "4m"


def small_batches(spark: SparkSession) -> None:
    """Texts are long: batches of 64 MB, held on both sides by every task, would take much of an executor's memory."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) in ("67108864b", "67108864", "64m", "64MB"):
        spark.conf.set(key, BATCH_BYTES)


def materialise(df: DataFrame, name: str = "t") -> DataFrame:
    """Write df to the shared folder and read it back."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{scratch_root(spark)}/palisade/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._palisade_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what materialise() wrote for df; only for tables that no later plan reads."""
    path = getattr(df, "_palisade_path", None)
    if path:
        jvm = df.sparkSession._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


def release(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files of tables that nothing refers to, which it does when the driver's garbage is
    collected. The scheduler refers to its last job until another one ends, so a small one is run first."""
    gc.collect()
    spark.range(1).count()
    time.sleep(0.2)
    spark._jvm.System.gc()


def columns(df: DataFrame) -> dict[str, np.ndarray]:
    """The number columns of a table of bounded size as arrays on the driver, without rows as Python objects."""
    table = df.toArrow()
    return {name: table[name].to_numpy() for name in table.column_names}


def bounded_broadcast(df: DataFrame, max_rows: int) -> bool:
    """Whether df has at most max_rows rows, so that a broadcast of it has a known size."""
    return df.limit(max_rows + 1).count() <= max_rows
