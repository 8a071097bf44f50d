"""Arrays packed to bytes, in which blocks of documents and shards of counts exchange them."""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.kernels import slices
from palisade.llm.ranges import Blocks


def pack(arrays: dict[str, np.ndarray]) -> bytes:
    """Arrays by bytes of equal weight, which compress well. Those named h ascend and are kept as differences."""
    planes = {k: np.diff(x, prepend=x.dtype.type(0)) if k == "h" else x for k, x in arrays.items()}
    raw = pickle.dumps({k: (x.dtype.str, np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T)) for k, x in planes.items()}, 5)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unpack(data: bytes) -> dict[str, np.ndarray]:
    planes = pickle.loads(pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True))
    arrays = {k: np.ascontiguousarray(x.T).reshape(-1).view(kind) for k, (kind, x) in planes.items()}
    return {k: np.cumsum(x, dtype=x.dtype) if k == "h" else x for k, x in arrays.items()}


def small(x: np.ndarray) -> np.ndarray:
    """Whole numbers in as few bytes as they need."""
    return x.astype(np.min_scalar_type(int(x.max(initial=0))))


def deal(docs: DataFrame, blocks: Blocks) -> DataFrame:
    """(block, data): rows of docs, which has doc_id and text, compressed for the blocks that they belong to."""
    keyed = docs.withColumn("_id", F.col("doc_id").cast("long")).withColumn("_salt", F.xxhash64("text"))

    def run(batches):
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for b in slices(batches):
            block = blocks.of(b.column("_id"), b.column("_salt"))
            b = b.drop_columns(["_id", "_salt"])
            keys, data = np.unique(block), []
            for x in keys:
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, b.schema, options=options) as out:
                    out.write_batch(b if len(keys) == 1 else b.take(pa.array(np.flatnonzero(block == x))))
                data.append(sink.getvalue().to_pybytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int32)), pa.array(data, pa.binary())], names=["block", "data"])

    return keyed.mapInArrow(run, "block int, data binary")


def gathered(rows: pa.Table) -> pa.Table:
    """The rows of a block."""
    return pa.concat_tables([pa.ipc.open_stream(x.as_buffer()).read_all() for x in rows["data"]])
