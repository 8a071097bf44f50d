"""The findings table and the severity scale."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Severity labels by rank.
SEVERITIES = ("INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL")

#: Columns of a finding with their types and what an unset one holds.
FINDING = {
    "id": ("string", ""), "type": ("string", ""), "rule_id": ("string", ""), "rule_name": ("string", ""), "severity": ("int", 0), "priority_score": ("int", 0),
    "confidence": ("string", ""), "title": ("string", ""), "description": ("string", ""), "file_path": ("string", ""), "artifact_path": ("string", ""),
    "start_line": ("int", 0), "end_line": ("int", 0), "start_column": ("int", 0), "end_column": ("int", 0), "snippet": ("string", ""), "package_name": ("string", ""),
    "package_version": ("string", ""), "ecosystem": ("string", ""), "fixed_version": ("string", ""), "cve": ("string", ""), "cvss_score": ("double", 0.0),
    "redacted": ("string", ""), "entropy": ("double", 0.0), "image_digest": ("string", ""), "layer_digest": ("string", ""), "layer_index": ("int", 0),
    "base_image": ("string", ""), "cwe": ("array<string>", None), "references": ("array<string>", None), "tags": ("array<string>", None), "fingerprint": ("string", ""),
    "timestamp": ("timestamp", None), "verdict": ("string", ""), "verdict_reason": ("string", ""), "fix_suggestion": ("string", ""), "fix_code": ("string", ""), "explanation": ("string", ""),
}


def as_findings(df: DataFrame, **columns: Column | str | int | float) -> DataFrame:
    """A findings table: the given columns, and defaults for the others."""
    out = []
    for name, (kind, default) in FINDING.items():
        value = columns.get(name, default)
        if value is None and kind.startswith("array"):
            value = F.array()
        value = value if isinstance(value, Column) else F.lit(value)
        value = value.cast(kind)
        out.append((F.coalesce(value, F.array().cast(kind)) if kind.startswith("array") else F.coalesce(value, F.lit(default).cast(kind)) if default is not None else value).alias(name))
    return df.select(*out)


@dataclass
class Config:
    """What a scan takes; names of rules and markers are settings."""

    namespace: str = "palisade"
    marker: str = "palisade:ignore"
    min_severity: str = "INFO"
    include_rules: list[str] = field(default_factory=list)
    exclude_rules: list[str] = field(default_factory=list)
    allowed_licenses: list[str] = field(default_factory=list)
    denied_licenses: list[str] = field(default_factory=list)
    languages: list[str] = field(default_factory=list)
    exclude_paths: list[str] = field(default_factory=list)
    secrets: bool = True
    sast: bool = True
    llm_only_sast: bool = False
    max_secret_bytes: int = 100 << 20
    max_source_bytes: int = 512 << 10
    redact: bool = True
    fail_on_findings: bool = True
    secret_rules: str = ""
    advisories: str = ""
    image: str = ""
    package_intelligence: bool = False
    package_registry_mode: str = "auto"
    registry_responses: str = ""
    npm_registry_url: str = ""
    pypi_registry_url: str = ""
    crates_registry_url: str = ""
    model: str = ""
    ai_triage: bool = False
    ai_filter_secrets: bool = False
    explain: bool = False
