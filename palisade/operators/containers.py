"""Containers: packages of an image's distribution and of the lockfiles in it, matched with advisories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.functions import scalar as S
from palisade.operators import layers, producers
from palisade.sources import images, lockfiles
from palisade.sources import packages as PKG


def system_packages(entries: DataFrame) -> DataFrame:
    """image, layer_index, layer_digest, name, version, ecosystem of the packages that a layer brings, if the image's distribution is a
    known one; the last release file counts."""
    files = entries.where("kind = 'file' and content is not null")
    release = PKG.os_release(files.where(F.col("path").isin(*images.RELEASE)).withColumn("_at", F.struct("layer_index", "tar_pos"))).where("distro <> ''")
    distro = release.groupBy("image").agg(F.max_by(F.struct("distro", "version"), "_at").alias("_d")).select("image", S.distro_ecosystem(F.col("_d.distro"), F.col("_d.version")).alias("ecosystem")).where("ecosystem <> ''")
    keep = ["image", "layer_index", "layer_digest", "content"]
    found = PKG.apk(files.where(F.col("path").isin(*images.APK)).select(*keep)).unionByName(PKG.dpkg(files.where(F.col("path").isin(*images.DPKG)).select(*keep)))
    key = F.to_json(F.struct("image", "layer_index", "layer_digest"))
    rpm = PKG.rpm(files.where(F.col("path").isin(*images.RPM)).select(key.alias("key"), "content")).withColumn("_k", F.from_json("key", "image string, layer_index int, layer_digest string"))
    found = found.unionByName(rpm.select("_k.image", "_k.layer_index", "_k.layer_digest", "name", "version"))
    return layers.new_packages(found.dropDuplicates(["image", "layer_index", "name", "version"])).join(distro, "image")


def language_packages(entries: DataFrame) -> DataFrame:
    """image, layer_index, layer_digest, name, version, ecosystem, artifact_path of lockfiles that are left when all layers are applied."""
    left = layers.overlay(entries).where(S.basename(F.col("path")).isin(*lockfiles.names()) & F.col("content").isNotNull() & S.safe_relative(F.col("path")))
    last = left.groupBy("image", "path").agg(F.max_by(F.struct("layer_index", "layer_digest", "content"), F.struct("layer_index", "tar_pos")).alias("_l"))
    # the parser keeps path and text alone: the image goes with the path
    text = last.select(F.concat("image", F.lit("\n/"), "path").alias("path"), F.col("_l.content").cast("string").alias("text"))
    where = last.select(F.concat("image", F.lit("\n/"), "path").alias("path"), "image", F.col("path").alias("artifact_path"), "_l.layer_index", "_l.layer_digest")
    return lockfiles.parse(text).join(where, "path").drop("path")


def container_findings(entries: DataFrame, advisories: DataFrame, details: DataFrame | None = None) -> DataFrame:
    """Findings of an image's system packages, if its distribution is known and it has some, and always of its lockfiles."""
    system = system_packages(entries).withColumn("artifact_path", F.lit(""))
    found = system.unionByName(language_packages(entries)).withColumn("locations", F.array("artifact_path"))
    return producers.package_findings(producers.advisory_matches(found, advisories), details, container=True)
