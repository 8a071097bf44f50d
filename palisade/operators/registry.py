"""Registries that are asked for packages, scanners by name, and what else a scan can be extended by."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession

# Public registries by ecosystem.
PUBLIC = {"npm": "https://registry.npmjs.org", "pypi": "https://pypi.org", "crates": "https://crates.io"}
MODES = ("auto", "public-only", "custom-only")


def base_url(raw: str) -> str:
    """An absolute http or https address without a slash at its end; others raise."""
    url = urlsplit(raw.strip())
    if url.scheme not in ("http", "https") or not url.netloc:
        raise ValueError(f"no registry address: {raw!r}")
    return raw.strip().rstrip("/")


def backends(spark: SparkSession, custom: dict[str, str] | None = None, mode: str = "auto") -> DataFrame:
    """backend, ecosystem, base, ord: custom registries first (auto: then the public ones; or only one kind). No rows: the check is off."""
    if mode not in MODES:
        raise ValueError(f"unknown registry mode {mode!r}; there are {', '.join(MODES)}")
    own = [(f"{eco}-custom", eco, base_url(url)) for eco, url in sorted((custom or {}).items()) if url]
    public = [(eco, eco, url) for eco, url in PUBLIC.items()]
    rows = {"auto": own + public, "public-only": public, "custom-only": own}[mode]
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "backend string, ecosystem string, base string, ord int")


@dataclass(frozen=True)
class Scanner:
    """A scanner: its name, the type of its findings, and scan(spark, inputs, config) -> findings, or None if it is off."""

    name: str
    type: str
    scan: Callable[..., DataFrame | None]


SCANNERS: dict[str, Scanner] = {}


def register(name: str, type_: str):
    """Registers a function as a scanner; scans run in order of registration."""

    def add(f):
        SCANNERS[name] = Scanner(name, type_, f)
        return f

    return add
