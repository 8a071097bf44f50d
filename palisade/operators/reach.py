"""What is reached over edges, breadth first, level by level."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.sinks.folders import shared_folder


def written(df: DataFrame, folder: str) -> DataFrame:
    """df as a table: lineage ends there, and what is built on it does not compute it again."""
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def breadth_first(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """edges (path, target) and starts (primary) -> primary, path, depth: what each start reaches in `depth` steps, with
    the fewest that it takes. The frontier of a level is written before the next one, which joins only it; the search ends
    with the first empty one. A start that a cycle brings back is reached like others, nulls are no nodes."""
    spark, folder = edges.sparkSession, shared_folder(edges.sparkSession, "reach")
    step = written(edges.where("path IS NOT NULL AND target IS NOT NULL").select("path", "target").distinct(), f"{folder}/edges")
    front = starts.where("primary IS NOT NULL").select("primary", F.col("primary").alias("path")).distinct()
    levels: list[DataFrame] = []
    for d in range(1, depth + 1):
        new = front.join(step, "path").select("primary", F.col("target").alias("path")).distinct()
        for seen in levels:
            new = new.join(seen, ["primary", "path"], "left_anti")
        front = written(new, f"{folder}/level-{d}")
        if front.isEmpty():
            break
        levels.append(front)
    out = spark.createDataFrame([], f"primary {step.schema['path'].dataType.simpleString()}, path {step.schema['path'].dataType.simpleString()}, depth int")
    for d, level in enumerate(levels, 1):
        out = out.unionByName(level.withColumn("depth", F.lit(d)))
    return out
