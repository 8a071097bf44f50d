"""Ranges of document ids that hold about equal numbers of rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm.kernels import mix
from palisade.llm.scratch import columns

#: Bounds that the driver and each task hold, 8 bytes each.
MOST_RANGES = 200_000
MOST_KEYS = 20_000


def id_ranges(texts: DataFrame, range_bytes: int) -> tuple[np.ndarray, int]:
    """First ids of the ranges, ascending and all of them present in the table (0 if it is empty). There are as many as
    shuffle partitions at least, so that small tables are spread too, and MOST_RANGES at most: beyond some 2 TB ranges
    grow (to 500 MB at 100 TB), and stream through their tasks all the same. Also the bytes of all texts."""
    size = texts.agg(F.sum(F.octet_length("text")).alias("bytes"), F.min("doc_id").alias("least")).first()
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = min(MOST_RANGES, max(parts, (size.bytes or 0) // range_bytes))
    least = size.least if size.least is not None else 0
    cuts = texts.select(F.percentile_approx("doc_id", [i / n for i in range(1, n)], max(40_000, 10 * n)).alias("q")).first().q if n > 1 else []
    return np.unique(np.array([least, *(cuts or [])], np.int64)), size.bytes or 0


def even_keys(spark: SparkSession, count: int, parts: int) -> np.ndarray:
    """Keys for count groups such that a shuffle by key deals them evenly to parts partitions, the first to the first."""
    if count > MOST_KEYS:  # so many that their hashes even out
        return np.arange(count)
    n = 4 * count + 30 * parts
    at = columns(spark.range(n).select(F.col("id"), F.pmod(F.hash(F.col("id").cast("int")), F.lit(parts)).alias("at")))
    at = at["at"][np.argsort(at["id"])]
    order = np.argsort(at, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n) - np.searchsorted(at[order], at[order])
    return np.lexsort((at, rank))[:count]


def range_of(bounds: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return np.maximum(np.searchsorted(bounds, ids, "right") - 1, 0)


class Blocks:
    """Blocks of documents: ranges of ids, each dealt to as many parts as keep it near block_bytes. Rows of one id are
    dealt by their texts."""

    def __init__(self, docs: DataFrame, block_bytes: int):
        spark = docs.sparkSession
        self.bounds, self.total = id_ranges(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), block_bytes)
        self.parts = max(1, -(-self.total // (2 * block_bytes * len(self.bounds))))
        self.keys = even_keys(spark, len(self.bounds) * self.parts, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def of(self, ids: pa.Array, salt: pa.Array) -> np.ndarray:
        x = np.asarray(ids.fill_null(0))
        part = mix(x.astype(np.uint64) ^ np.asarray(salt).view(np.uint64)) % np.uint64(self.parts)
        return self.keys[range_of(self.bounds, x) * self.parts + part.astype(np.int64)]
