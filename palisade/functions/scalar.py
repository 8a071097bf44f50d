"""Scalar functions over columns: built-in expressions that stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palisade.schema import SEVERITIES

#: Go's white space, for trimming: Unicode's.
_SPACE = r"[\t\n\x0B\f\r \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"

# Language by file extension.
EXTENSIONS = {
    ".go": "go", ".py": "python", ".js": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript",
    ".java": "java", ".rb": "ruby", ".php": "php", ".cs": "csharp", ".rs": "rust", ".c": "c", ".cpp": "cpp", ".h": "c", ".hpp": "cpp", ".kt": "kotlin",
    ".swift": "swift", ".sh": "bash", ".bash": "bash", ".dockerfile": "dockerfile",
}

# Package URL types by what an ecosystem's name contains, in order of precedence.
PURL_TYPES = (
    ("golang", ("go",)), ("pypi", ("pypi", "python")), ("npm", ("npm", "javascript")), ("gem", ("rubygems", "ruby")), ("cargo", ("cargo", "rust")),
    ("maven", ("maven", "java")), ("composer", ("packagist", "php")), ("nuget", ("nuget", "dotnet")), ("cpan", ("cpan", "perl")),
)

# Scores of the priority formula, by severity rank and by tag.
SEVERITY_SCORES = {4: 10, 3: 8, 2: 5, 1: 3}
FREQUENCY_TAGS = {"injection": 9, "xss": 9, "secrets": 8, "crypto": 6, "config": 4}
DETECTION_TAGS = {"prefilter": 8, "ai": 4}


def first(array: Column) -> Column:
    return F.try_element_at(array, F.lit(1))


def last(array: Column) -> Column:
    return F.try_element_at(array, F.lit(-1))


def nonempty(c: Column) -> Column:
    """Null for empty strings."""
    return F.nullif(c, F.lit(""))


def strip(c: Column) -> Column:
    """Trim any Unicode white space."""
    return F.regexp_replace(c, f"^{_SPACE}+|{_SPACE}+$", "")


def choose(cases, otherwise) -> Column:
    """An ordered CASE of (condition, value)."""
    out = None
    for condition, value in cases:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out.otherwise(otherwise if isinstance(otherwise, Column) else F.lit(otherwise))


def contains_any(c: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


# severity


def severity_label(rank: Column) -> Column:
    return choose([(rank == i, s) for i, s in enumerate(SEVERITIES)], "INFO")


def severity_rank(label: Column) -> Column:
    """Rank of a label, trimmed and in any case; unknown ones are INFO."""
    return F.coalesce(severity_rank_strict(label), F.lit(0))


def severity_rank_strict(label: Column) -> Column:
    """Null for unknown labels."""
    x = F.upper(strip(label))
    return choose([(x == s, i) for i, s in enumerate(SEVERITIES)], F.lit(None).cast("int"))


def cvss_rank(score: Column) -> Column:
    return choose([(score >= 9.0, 4), (score >= 7.0, 3), (score >= 4.0, 2), (score > 0.0, 1)], 0)


def cvss_vector(vector: Column) -> Column:
    """struct(severity, score) of a CVSS vector; null if it isn't one."""
    v = F.upper(vector)
    has = lambda metric: v.contains(f"/{metric}").cast("int")
    high = has("C:H") + has("I:H") + has("A:H")
    reach = has("AV:N") * has("AC:L") * F.greatest(has("PR:N"), has("PR:L"))
    level = choose([((high >= 2) | ((has("S:C") == 1) & (high >= 1)), 4), (high >= 1, 3), (reach == 1, 2)], 1)
    score = choose([(level == 4, 9.5), (level == 3, 8.0), (level == 2, 6.5)], 3.5)
    return F.when(v.startswith("CVSS:"), F.struct(level.alias("severity"), score.alias("score")))


def advisory_severity(scores: Column) -> Column:
    """struct(severity, score) of the first entry that is a number or a vector; MEDIUM and 0 if none is."""

    def one(s: Column) -> Column:
        number = s.try_cast("double")
        return F.coalesce(F.when(number.isNotNull(), F.struct(cvss_rank(number).alias("severity"), number.alias("score"))), cvss_vector(s))

    return F.coalesce(first(F.filter(F.transform(scores, one), lambda x: x.isNotNull())), F.struct(F.lit(2).alias("severity"), F.lit(0.0).alias("score")))


# findings


def priority(severity: Column, tags: Column) -> Column:
    """Twice the frequency, twice the severity, and the detectability; the last tag that says something counts."""

    def by_tag(scores: dict[str, int]) -> Column:
        found = last(F.filter(tags, lambda t: t.isin(*scores)))
        return choose([(found == t, n) for t, n in scores.items()], 5)

    level = choose([(severity == rank, n) for rank, n in SEVERITY_SCORES.items()], 1)
    return (by_tag(FREQUENCY_TAGS) * 2 + level * 2 + by_tag(DETECTION_TAGS)).cast("int")


def fingerprint() -> Column:
    """SHA-256 of what identifies a finding of its type."""
    c = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(""))
    joined = lambda *parts: F.sha2(F.concat_ws(":", *parts), 256)
    package = [c(x) for x in ("type", "rule_id", "package_name", "package_version", "ecosystem", "file_path")]
    secret = F.coalesce(nonempty(F.col("redacted")), c("snippet"))
    place = lambda text: joined(c("type"), c("rule_id"), c("file_path"), text, c("start_line"))
    return choose(
        [(F.col("type") == "sca", joined(*package)), (F.col("type") == "container", joined(*package, c("layer_digest"), c("artifact_path"))), (F.col("type") == "secrets", place(secret))],
        place(c("snippet")),
    )


def sarif_level(severity: Column) -> Column:
    return choose([(severity >= 3, "error"), (severity == 2, "warning")], "note")


def annotation_level(severity: Column) -> Column:
    return choose([(severity >= 3, "failure"), (severity <= 1, "notice")], "warning")


def file_uri(path: Column) -> Column:
    image = path.contains(":") & ~path.startswith("/") & ~path.startswith(".")
    return choose([(image, F.concat(F.lit("container://"), path)), (path.startswith("/"), F.concat(F.lit("file://"), path))], path)


# advisories


def cve_of(aliases: Column) -> Column:
    return F.coalesce(first(F.filter(aliases, lambda a: a.startswith("CVE-"))), F.lit(""))


def fixed_version(affected: Column) -> Column:
    """The first fixed version in order of affected packages, ranges and events."""
    events = F.flatten(F.transform(affected, lambda a: F.flatten(F.transform(a["ranges"], lambda r: r["events"]))))
    return F.coalesce(first(F.filter(F.transform(events, lambda e: e["fixed"]), lambda v: v != "")), F.lit(""))


# text


def redact(text: Column) -> Column:
    """Four bytes at either end, all stars up to eight bytes."""
    n = F.octet_length(text)
    raw = text.cast("binary")
    ends = F.concat(F.substring(raw, 1, 4).cast("string"), F.lit("****"), F.substring(raw, n - 3, F.lit(4)).cast("string"))
    return F.when(n <= 8, F.repeat(F.lit("*"), n)).otherwise(ends)


def slugify(text: Column) -> Column:
    s = F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_")
    return F.coalesce(nonempty(F.substring(F.regexp_replace(s, "^_+|_+$", ""), 1, 50)), F.lit("unknown"))


def line_number(location: Column) -> Column:
    """After the last colon, up to a dash; else all that follows "line "; 0 if that isn't a number."""
    tail = F.when(location.contains(":"), F.trim(F.substring_index(F.substring_index(location, ":", -1), "-", 1))).try_cast("int")
    at = F.instr(F.lower(location), "line ")
    rest = F.when(at > 0, strip(F.substring(location, at + 5, F.length(location)))).try_cast("int")
    return F.coalesce(tail, rest, F.lit(0))


def cwes(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.upper(text), F.lit("CWE-[0-9]+"), F.lit(0)))


def capitalize(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, F.lit(2), F.length(text)))


def inline_text(text: Column) -> Column:
    return strip(F.regexp_replace(text, f"{_SPACE}+", " "))


def truncated(text: Column, n: int) -> Column:
    return F.when(F.length(text) <= n, text).otherwise(F.concat(F.substring(text, 1, n - 1), F.lit("…")))


def truncated_path(text: Column, n: int) -> Column:
    return F.when(F.length(text) <= n, text).otherwise(F.concat(F.lit("…"), F.right(text, F.lit(n - 1))))


# packages


def purl(name: Column, version: Column, ecosystem: Column) -> Column:
    eco = F.lower(ecosystem)
    kind = choose([(contains_any(eco, words), kind) for kind, words in PURL_TYPES], "generic")
    return F.concat(F.lit("pkg:"), kind, F.lit("/"), name, F.lit("@"), version)


def spdx_id(name: Column, version: Column) -> Column:
    """Safe letters of the name, 40 bytes at most, and four bytes of a hash."""
    safe = F.regexp_replace(name, "[^A-Za-z0-9.-]", "-")
    return F.concat(F.substring(safe, 1, 40), F.lit("-"), F.substring(F.sha2(F.concat(name, F.lit("@"), version), 256), 1, 8))


def group_and_name(name: Column) -> Column:
    """struct(group, name), split at the last slash."""
    leaf = F.substring_index(name, "/", -1)
    group = F.when(name.contains("/"), F.substring(name, F.lit(1), F.length(name) - F.length(leaf) - 1)).otherwise("")
    return F.struct(group.alias("group"), leaf.alias("name"))


def registry_ecosystem(ecosystem: Column) -> Column:
    eco = F.lower(ecosystem)
    return choose([(contains_any(eco, ("npm", "javascript", "node")), "npm"), (contains_any(eco, ("pypi", "python")), "pypi"), (contains_any(eco, ("cargo", "rust", "crates")), "crates")], "")


def registry_tag(ecosystem: Column) -> Column:
    return F.coalesce(nonempty(registry_ecosystem(ecosystem)), F.lower(ecosystem))


def registry_name(ecosystem: Column, name: Column) -> Column:
    return F.when(registry_ecosystem(ecosystem) == "pypi", F.regexp_replace(F.lower(name), "[-_.]+", "-")).otherwise(name)


def path_escape(text: Column) -> Column:
    """Percent-encoding of a path segment: spaces as %20, and $ & + : = @ as themselves."""
    out = F.regexp_replace(F.url_encode(text), r"\+", "%20")
    for code, char in (("%24", "\\$"), ("%26", "&"), ("%2B", "+"), ("%3A", ":"), ("%3D", "="), ("%40", "@"), ("%7E", "~"), (r"\*", "%2A")):
        out = F.regexp_replace(out, code, char)
    return out


def registry_url(ecosystem: Column, base: Column, name: Column) -> Column:
    """Null for registries that aren't supported."""
    eco, leaf = registry_ecosystem(ecosystem), path_escape(name)
    return choose(
        [(eco == "npm", F.concat(base, F.lit("/"), leaf)), (eco == "pypi", F.concat(base, F.lit("/pypi/"), leaf, F.lit("/json"))), (eco == "crates", F.concat(base, F.lit("/api/v1/crates/"), leaf))],
        F.lit(None).cast("string"),
    )


def lookup_status(status: Column) -> Column:
    """What a registry's HTTP status says of a package."""
    return choose([(status == 200, "exists"), (status == 404, "missing"), (status.isin(401, 403), "ambiguous"), ((status == 429) | (status >= 500), "transient_error")], "ambiguous")


def import_patterns(name: Column, ecosystem: Column) -> Column:
    """Texts of which a line that imports a package contains one."""
    eco, leaf = F.lower(ecosystem), F.substring_index(name, "/", -1)
    wrap = lambda before, x, after="": F.concat(F.lit(before), x, F.lit(after))
    return choose(
        [
            (eco.contains("go"), F.array(wrap('"', name, '"'), wrap('"', leaf, '"'))),
            (contains_any(eco, ("pypi", "python")), F.array(wrap("import ", leaf), wrap("from ", leaf))),
            (contains_any(eco, ("npm", "javascript", "node")), F.array(wrap("require('", leaf, "')"), wrap('require("', leaf, '")'), wrap("from '", leaf), wrap('from "', leaf))),
            (contains_any(eco, ("maven", "java")), F.array(wrap("import ", F.replace(name, F.lit("/"), F.lit("."))))),
            (contains_any(eco, ("rubygems", "ruby")), F.array(wrap("require '", leaf, "'"), wrap('require "', leaf, '"'))),
            (contains_any(eco, ("cargo", "rust")), F.array(wrap("use ", leaf, "::"), wrap("extern crate ", leaf))),
        ],
        F.array(leaf),
    )


def distro_ecosystem(distro: Column, version: Column) -> Column:
    major, minor = F.substring_index(version, ".", 1), F.substring_index(version, ".", 2)
    return choose(
        [
            (distro == "alpine", F.concat(F.lit("Alpine:v"), minor)),
            (distro == "debian", F.concat(F.lit("Debian:"), version)),
            (distro == "ubuntu", F.concat(F.lit("Ubuntu:"), version)),
            (distro.isin("rhel", "centos", "rocky", "almalinux", "ol"), F.concat(F.lit("Red Hat:"), major)),
            (distro == "fedora", F.concat(F.lit("Fedora:"), version)),
        ],
        "",
    )


# files


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """With its dot, in lower case; empty if there is none."""
    return F.lower(F.regexp_extract(basename(path), r"(\.[^.]*)$", 1))


def language_by_name(name: Column) -> Column:
    n = F.lower(name)
    compose = n.rlike(r"^(docker-)?compose\.(.*\.)?ya?ml$")
    return choose([(n.rlike("^(dockerfile|containerfile)([.-].*)?$"), "dockerfile"), (compose, "docker-compose")], "")


def language(path: Column) -> Column:
    """By extension, else by name; empty if unknown."""
    pairs = F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, extension(path)), language_by_name(basename(path)))


def safe_relative(path: Column) -> Column:
    """Whether a path stays below its root."""
    return (path != "") & ~path.startswith("/") & ~F.arrays_overlap(F.split(path, "/"), F.array(F.lit("..")))


# licenses


def identify_license(head: Column) -> Column:
    """The license that the head of a text, in lower case, names; the first that fits, in order."""
    has = head.contains
    # Phrases by license, in order of precedence.
    return choose(
        [
            (has("apache license") & has("version 2"), "Apache-2.0"),
            (has("mit license") | has("permission is hereby granted") & has("without restriction"), "MIT"),
            (has("bsd 3-clause") | has("redistribution") & has("neither the name"), "BSD-3-Clause"),
            (has("bsd 2-clause") | has("redistribution") & has("binary form"), "BSD-2-Clause"),
            (has("gnu general public license") & has("version 3"), "GPL-3.0"),
            (has("gnu general public license") & has("version 2"), "GPL-2.0"),
            (has("gnu lesser general public license") | has("gnu library general"), "LGPL"),
            (has("gnu affero general public license"), "AGPL-3.0"),
            (has("mozilla public license") & has("version 2"), "MPL-2.0"),
            (has("isc license") | has("permission to use, copy, modify") & has("isc"), "ISC"),
            (has("unlicense") | has("this is free and unencumbered"), "Unlicense"),
            (has("creative commons") & has("cc0"), "CC0-1.0"),
            (has("eclipse public license"), "EPL"),
        ],
        "unknown",
    )


def license_policy(license: Column, allowed: list[str], denied: list[str]) -> Column:
    """denied, allowed or unknown; what no list names is allowed only if there is no list of allowed ones."""
    x = F.lower(license)
    return choose([(x.isin(*[d.lower() for d in denied]), "denied"), (F.lit(not allowed), "allowed"), (x.isin(*[a.lower() for a in allowed]), "allowed")], "unknown")


# lines


def lines_kept(text: Column) -> Column:
    """All lines as they are, an empty one after a final line feed included."""
    return F.split(text, "\n", -1)


def lines_scanned(text: Column) -> Column:
    """Lines without their ends, no empty one after the last."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(text, r"(\r?\n|\r)\z", ""), "\r?\n", -1))


def context(text: Column, line: Column, radius: int) -> Column:
    """Numbered lines around one, clipped to the text."""
    return _frame(text, F.greatest(F.lit(1), line - radius), line + radius, None, None, None)


def redacted_context(text: Column, start: Column, end: Column, radius: int, placeholder: str) -> Column:
    """Numbered lines around start to end, which are replaced."""
    return _frame(text, F.greatest(F.lit(1), start - radius), F.greatest(start, end) + radius, start, F.greatest(start, end), placeholder)


def _frame(text: Column, low: Column, high: Column, start, end, placeholder) -> Column:
    all_ = lines_kept(text)
    shown = F.slice(all_, low, F.greatest(F.lit(0), F.least(high, F.size(all_)) - low + 1))

    def numbered(x: Column, i: Column) -> Column:
        n = low + i
        body = x if placeholder is None else F.when(n.between(start, end), F.lit(placeholder)).otherwise(x)
        return F.format_string("%4d  %s\n", n, body)

    return F.array_join(F.transform(shown, numbered), "")
