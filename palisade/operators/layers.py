"""Container images: which layer brings a package or a file."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def new_packages(packages: DataFrame) -> DataFrame:
    """image, layer_index, name, version, ... rows whose name and version the image's previous layer that had packages
    lacks."""
    layers = packages.select("image", "layer_index").distinct()
    before = F.lag("layer_index").over(Window.partitionBy("image").orderBy("layer_index"))
    layers = layers.withColumn("_before", before)
    had = packages.select("image", F.col("layer_index").alias("_before"), "name", "version").distinct()
    return packages.join(layers, ["image", "layer_index"]).join(had, ["image", "_before", "name", "version"], "left_anti").drop("_before")


def overlay(entries: DataFrame) -> DataFrame:
    """entries (image, layer_index, tar_pos, path, kind) -> the files that are tracked when all layers are applied.

    A whiteout removes its path, an opaque whiteout all that lies below its folder; both only what came before them."""
    name = F.substring_index("path", "/", -1)
    folder = F.when(F.col("path").contains("/"), F.expr("substring(path, 1, length(path) - length(substring_index(path, '/', -1)) - 1)")).otherwise("")
    e = entries.withColumn("_name", name).withColumn("_dir", folder).withColumn("_at", F.struct("layer_index", "tar_pos"))
    adds = e.where(~F.col("_name").startswith(".wh.") & (F.col("kind") == "file"))
    opaque = e.where("_name = '.wh..wh..opq'").select("image", F.col("_dir").alias("_gone"), F.col("_at").alias("_when"), F.col("layer_index").alias("_layer"))
    deleted = e.where("startswith(_name, '.wh.') and _name <> '.wh..wh..opq'").select("image", F.concat(F.when(F.col("_dir") == "", "").otherwise(F.concat("_dir", F.lit("/"))), F.substring("_name", 5, 1 << 20)).alias("path"), F.col("_at").alias("_when"))
    deleted = deleted.groupBy("image", "path").agg(F.max("_when").alias("_when"))
    left = adds.join(deleted, ["image", "path"], "left").where("_when is null or _when < _at").drop("_when")
    # each folder above a file is a key: an equi-join finds opaque whiteouts
    up = F.expr("transform(sequence(0, size(split(path, '/')) - 1), i -> array_join(slice(split(path, '/'), 1, i), '/'))")
    above = left.select("image", "layer_index", "tar_pos", "path", F.explode(up).alias("_gone"))
    opaque = opaque.groupBy("image", "_gone").agg(F.max(F.col("_layer")).alias("_layer"))
    wiped = above.join(opaque, ["image", "_gone"]).where("layer_index < _layer").select("image", "layer_index", "tar_pos", "path").distinct()
    return left.join(wiped, ["image", "layer_index", "tar_pos", "path"], "left_anti").select(*entries.columns)


def attribution(artifacts: DataFrame, tracked: DataFrame) -> DataFrame:
    """artifacts (image, path, ...) with the last layer that wrote the path; -1 if none did."""
    last = tracked.groupBy("image", "path").agg(F.max("layer_index").alias("layer_index"))
    return artifacts.join(last, ["image", "path"], "left").withColumn("layer_index", F.coalesce("layer_index", F.lit(-1)))
