"""Webhook deliveries: verified, decoded and turned into scan requests."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BODY = """action string, ref string, after string, number long, installation struct<id: long>,
    repository struct<full_name: string, default_branch: string>, pull_request struct<number: long, head: struct<sha: string, ref: string>, base: struct<sha: string, ref: string>>"""
MAX_BODY = 10 << 20


def verified(deliveries: DataFrame, secret: str) -> DataFrame:
    """Deliveries (method, event_type, signature, body) by POST, of at most 10 MB, whose HMAC-SHA256 is right."""

    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    pad = lambda x: F.lit(bytes(b ^ x for b in key))
    body = F.coalesce(F.col("body"), F.lit("")).cast("binary")
    inner = F.unhex(F.sha2(F.concat(pad(0x36), body), 256))
    # both sides are hashed again, so that how long they compare tells nothing
    right = F.sha2(F.concat(F.lit("sha256="), F.sha2(F.concat(pad(0x5C), inner), 256)), 256) == F.sha2(F.coalesce(F.col("signature"), F.lit("")), 256)
    return deliveries.where((F.upper("method") == "POST") & (F.octet_length("body") <= MAX_BODY)).where(right)


def requests(deliveries: DataFrame) -> DataFrame:
    """Scan requests: pull requests that are opened or get commits, pushes to main or master. kind, repository, sha,
    number, installation."""
    d = deliveries.select("event_type", F.from_json("body", BODY).alias("b"))
    pull = (F.col("event_type") == "pull_request") & F.col("b.action").isin("opened", "synchronize")
    push = (F.col("event_type") == "push") & F.col("b.ref").isin("refs/heads/main", "refs/heads/master")
    return d.where(pull | push).select(
        F.when(pull, "pull_request").otherwise("push").alias("kind"), F.col("b.repository.full_name").alias("repository"), F.coalesce("b.pull_request.head.sha", "b.after").alias("sha"),
        F.coalesce("b.pull_request.number", "b.number").alias("number"), F.col("b.installation.id").alias("installation"),
    )


def admitted(requests: DataFrame, running: DataFrame, most: int = 4) -> DataFrame:
    """requests (at, repository, sha, ...) that may start while those of running (repository, sha) are at work: one for
    each commit, none that is running, the earliest first while fewer than `most` run."""
    one = requests.groupBy("repository", "sha").agg(F.min_by(F.struct(*requests.columns), "at").alias("_r")).select("_r.*")
    waiting = one.join(running.select("repository", "sha"), ["repository", "sha"], "left_anti").select(*requests.columns)
    return waiting.orderBy("at", "repository", "sha").limit(max(0, most - running.count()))


def push_findings(findings: DataFrame, listed: DataFrame) -> DataFrame:
    """Findings of a push in the files (ord, path) that it changes; they are logged, nothing is posted."""
    from palisade.plans.postprocess import changed_only
    from palisade.sources.files import changed_list

    return changed_only(findings, changed_list(listed))
