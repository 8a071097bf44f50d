"""Command line: scan and sbom of a directory, validate-rules, version."""

from __future__ import annotations

import argparse
import importlib
import os
import re
import sys
from dataclasses import fields, replace
from importlib import metadata
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from palisade.functions import answers as A
from palisade.functions import limits
from palisade.functions import scalar as S
from palisade.operators import assistant, containers, producers, registry
from palisade.operators.rules import RULES, SECRET_RULES, java
from palisade.plans import postprocess as P
from palisade.plans import report
from palisade.schema import Config
from palisade.sinks.folders import shared_folder
from palisade.sources import files as SRC
from palisade.sources import images, lockfiles, settings

VERSION = "0.2"
ADVISORY = """id string, name string, ecosystem string, versions array<string>, aliases array<string>, summary string, severity array<struct<score: string>>, refs array<struct<url: string>>,
    affected array<struct<ranges: array<struct<events: array<struct<introduced: string, fixed: string>>>>>>"""


def load_config(path: str | None) -> Config:
    """A file of settings; a missing one is silent, a broken one warns, unknown keys are ignored."""
    known = {f.name for f in fields(Config)}
    return replace(Config(), **{k: v for k, v in settings.load(path).items() if k in known})


def load_baseline(spark: SparkSession, path: str | None):
    """(suppress, require) tables of a baseline; missing or broken ones are empty."""
    given = settings.load(path)
    get = lambda x, *names: tuple(str(x.get(n) or "") for n in names)
    suppress = spark.createDataFrame([get(x, "fingerprint", "reason") for x in given.get("suppress") or []], "fingerprint string, reason string")
    return suppress, spark.createDataFrame([get(x, "fingerprint", "rule_id", "file", "reason") for x in given.get("require") or []], "fingerprint string, rule_id string, file string, reason string")


def packages_of(spark: SparkSession, root: str):
    """Packages of the lockfiles below a directory."""
    p = lockfiles.parse(SRC.lockfiles(SRC.directory(spark, root).withColumn("kind", F.lit("file"))).select("path", F.col("content").cast("string").alias("text")))
    return p.groupBy("name", "version", "ecosystem").agg(F.array_sort(F.collect_set("path")).alias("locations"))


def advisories_of(spark: SparkSession, path: str):
    """Advisories in lines of JSON."""
    return spark.read.schema(ADVISORY).json(path).fillna("", ["summary"]).withColumns({c: F.coalesce(c, F.array().cast(k)) for c, k in (("versions", "array<string>"), ("aliases", "array<string>"))})


def _text(d):
    return d.select("path", F.col("content").cast("string").alias("text"))


@registry.register("secrets", "secrets")
def _secrets(spark: SparkSession, inputs: dict, cfg: Config):
    return producers.secret_findings(_text(SRC.for_secrets(inputs["files"], cfg.exclude_paths, cfg.max_secret_bytes)), cfg, settings.secret_rules(cfg.secret_rules) if cfg.secret_rules else ()) if cfg.secrets else None


@registry.register("sca", "sca")
def _sca(spark: SparkSession, inputs: dict, cfg: Config):
    return producers.package_findings(producers.advisory_matches(packages_of(spark, inputs["root"]), advisories_of(spark, cfg.advisories))) if cfg.advisories else None


@registry.register("sast", "sast")
def _sast(spark: SparkSession, inputs: dict, cfg: Config):
    if not cfg.sast:
        return None
    source = SRC.for_source(inputs["files"], cfg.languages, cfg.max_source_bytes)
    if "known" in inputs:  # incremental: only what is new or differs from the last scan
        hashes = source.select("path", F.sha2("content", 256).alias("sha256"))
        source = source.join(SRC.changed(hashes, inputs["known"]).select("path"), "path", "left_semi")
    return producers.source_findings(_text(source), cfg)


@registry.register("container", "container")
def _container(spark: SparkSession, inputs: dict, cfg: Config):
    if not (cfg.image and cfg.advisories):
        return None
    image = cfg.image if "://" in cfg.image else os.path.abspath(cfg.image)
    archive = spark.createDataFrame([(cfg.image, image)], "image string, path string")
    entries = images.file_entries(archive, (*images.APK, *images.DPKG, *images.RPM, *images.RELEASE), lockfiles.names())
    return containers.container_findings(entries, advisories_of(spark, cfg.advisories))


@registry.register("license", "license")
def _license(spark: SparkSession, inputs: dict, cfg: Config):
    if not (cfg.allowed_licenses or cfg.denied_licenses):
        return None
    named = inputs["files"].where(S.basename(F.col("path")).isin(*SRC.LICENSE_FILES))  # few: only they are joined
    heads = named.join(SRC.license_files(named).select("path"), "path", "left_semi")
    return producers.license_findings(producers.licenses(_text(heads)), cfg)


@registry.register("package-intelligence", "sca")
def _unknown_packages(spark: SparkSession, inputs: dict, cfg: Config):
    """Packages that no registry has, by the responses (backend, ecosystem, name, http_status) of a file."""
    if not (cfg.package_intelligence and cfg.registry_responses):
        return None
    packages = packages_of(spark, inputs["root"])
    asked = registry.backends(spark, {"npm": cfg.npm_registry_url, "pypi": cfg.pypi_registry_url, "crates": cfg.crates_registry_url}, cfg.package_registry_mode)
    responses = spark.read.schema("backend string, ecosystem string, name string, http_status int").json(cfg.registry_responses)
    return producers.hallucinated_findings(packages, producers.registry_decisions(producers.registry_lookups(packages, asked, responses)), cfg)


def _written(df, name: str):
    """df as a table in the shared folder: what stands above it runs once."""
    folder = shared_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def completer_of(name: str):
    """The function of a list of prompts that module:function names."""
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def scan(spark: SparkSession, root: str, cfg: Config, baseline: str | None = None, cache: str | None = None):
    """(findings, required findings that are missing) of a directory, by all scanners that are registered and on. Files
    are scanned once: what the scanners find is written, and all that follows reads that. cache: a file of hashes; source
    code that it knows is passed over, and what was scanned is remembered in it."""
    every = SRC.directory(spark, root)
    inputs = {"root": root, "files": every} | ({"known": SRC.load_state(spark, cache)} if cache else {})
    made = [f for x in registry.SCANNERS.values() if (f := x.scan(spark, inputs, cfg)) is not None]
    if not made:
        raise ValueError("no scanner is selected")
    suppress, require = load_baseline(spark, baseline)
    raw = _written(P.score(P.dedup(P.with_fingerprints(P.union(made)))), "scanned")
    # markers count in whatever file has a finding
    marked = _text(every.where(F.col("size") <= cfg.max_secret_bytes).join(raw.select(F.col("file_path").alias("path")).distinct(), "path", "left_semi"))
    found = P.process([raw], cfg, marked, suppress)
    if cfg.model and (cfg.ai_filter_secrets or cfg.ai_triage):
        found = _reviewed(spark, _written(found, "found"), marked, cfg)
    found = _written(found, "findings")
    if cache:
        known, source = inputs["known"], SRC.for_source(every, cfg.languages, cfg.max_source_bytes)
        SRC.save_state(_written(SRC.remembered(known, source.select("path", F.sha2("content", 256).alias("sha256"))), "state"), cache)
    return found, P.missing_required(raw, require)


def _reviewed(spark: SparkSession, found, files, cfg: Config):
    """Findings after a language model has seen them, within the limits of requests that all tasks share."""
    completer = completer_of(cfg.model)
    with limits.shared(spark) as limiter:
        if cfg.ai_filter_secrets:
            secret = found.where("type = 'secrets'")
            answers = A.complete(assistant.triage_prompts(secret, files), completer, limiter=limiter)
            found = _written(P.without_false_secrets(found, answers.select("fingerprint", A.secret_verdict(F.col("answer")).alias("verdict"))), "filtered")
        if cfg.ai_triage:
            answers = assistant.triaged(found, files, completer, limiter)
            found = _written(P.merge_triage(found, answers if cfg.explain else answers.withColumn("explanation", F.lit(""))), "triaged")
    return found


def version_info() -> str:
    """The package's version as installed, else that of the source."""
    try:
        return metadata.version("palisade")
    except metadata.PackageNotFoundError:
        return VERSION


#: Options of a scan: name, setting, kind (a value, a list, or what a bare option sets).
OPTIONS = (
    ("--min-severity", "min_severity", str), ("--include-rule", "include_rules", list), ("--exclude-rule", "exclude_rules", list), ("--allow-license", "allowed_licenses", list), ("--deny-license", "denied_licenses", list),
    ("--language", "languages", list), ("--exclude", "exclude_paths", list), ("--no-secrets", "secrets", False), ("--no-sast", "sast", False), ("--llm-only-sast", "llm_only_sast", True), ("--max-secret-bytes", "max_secret_bytes", int),
    ("--max-source-bytes", "max_source_bytes", int), ("--no-redact", "redact", False), ("--no-fail", "fail_on_findings", False), ("--secret-rules", "secret_rules", str), ("--advisories", "advisories", str), ("--image", "image", str),
    ("--namespace", "namespace", str), ("--marker", "marker", str), ("--package-intelligence", "package_intelligence", True), ("--package-registry-mode", "package_registry_mode", str), ("--registry-responses", "registry_responses", str),
    ("--npm-registry-url", "npm_registry_url", str), ("--pypi-registry-url", "pypi_registry_url", str), ("--crates-registry-url", "crates_registry_url", str), ("--ai-model", "model", str), ("--ai-triage", "ai_triage", True),
    ("--ai-filter-secrets", "ai_filter_secrets", True), ("--explain", "explain", True),
)


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0: clean, 1: findings or missing required ones, 2: error."""
    parser = argparse.ArgumentParser(prog="palisade")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("scan", "sbom"):
        c = commands.add_parser(name)
        c.add_argument("root")
        c.add_argument("--format", default="json" if name == "scan" else "cyclonedx")
        c.add_argument("--output")
        c.add_argument("--workers", type=int)
        c.add_argument("--quiet", action="store_true")
        if name == "scan":
            c.add_argument("--config")
            c.add_argument("--baseline")
            c.add_argument("--incremental", action="store_true")
            c.add_argument("--cache-path", default=".palisade-cache.json")
            for option, setting, kind in OPTIONS:
                how = {"action": "append"} if kind is list else {"type": kind} if isinstance(kind, type) else {"action": "store_const", "const": kind}
                c.add_argument(option, dest=setting, default=None, **how)
    commands.add_parser("validate-rules")
    commands.add_parser("version")
    a = parser.parse_args(args)
    if a.command == "version":
        print(version_info())
        return 0
    if a.command == "validate-rules":
        for x in (*(r.regex for r in RULES), *(r for _, r, _ in SECRET_RULES)):
            re.compile(x)
            java(x)
        print(f"{len(RULES)} source rules, {len(SECRET_RULES)} secret rules")
        return 0
    try:
        if spark is None:
            builder = SparkSession.builder.appName("palisade")
            spark = (builder.master(f"local[{a.workers}]") if a.workers else builder).getOrCreate()
            spark.sparkContext.setLogLevel("ERROR" if a.quiet else "WARN")
        if a.command == "sbom":
            found, status = packages_of(spark, a.root), 0
        else:
            cfg = load_config(a.config)
            given = {setting: getattr(a, setting) for _, setting, _ in OPTIONS if getattr(a, setting) is not None}
            cfg = replace(cfg, **given)
            found, missing = scan(spark, a.root, cfg, a.baseline, os.path.abspath(a.cache_path) if a.incremental else None)
            status = report.exit_status(found, missing).first().status if cfg.fail_on_findings else 0
        if a.output and a.format in report.DOCUMENTS:
            target = os.path.abspath(a.output)
            report.save(a.format, found, target)
            Path(target).chmod(0o600)
            return status
        if a.command == "scan" and a.format == "json":
            out = report.json_document(found, report.envelope(found))
        else:
            df = report.render(a.format, found)
            out = (r.json for r in df.select("json").toLocalIterator()) if "json" in df.columns else df.toJSON().toLocalIterator()
        sink = Path(a.output).open("w") if a.output else sys.stdout
        for line in out:
            print(line, file=sink)
        if a.output:
            sink.close()
            Path(a.output).chmod(0o600)
        return status
    except Exception as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
