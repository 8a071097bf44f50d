"""Lockfiles and manifests of many ecosystems: one projection over (path, text) picks a file's parser by its name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions import scalar as S

# How a line or block of each format states a package; group 1 is the name, group 2 the version.
PATTERNS = {
    "requirements.txt": ("PyPI", r"(?m)^[ \t]*([A-Za-z0-9][A-Za-z0-9._-]*)(?:\[[^\]]*\])?[ \t]*==[ \t]*([^\s;#]+)"),
    "go.mod": ("Go", r"(?m)^[ \t]*(?:require[ \t]+)?([^\s()/]+\.[^\s()]+)[ \t]+v([^\s]+)"),
    "go.sum": ("Go", r"(?m)^(\S+) v([^\s/]+) h1:"),
    "poetry.lock": ("PyPI", r'(?m)^\[\[package\]\]\s+name = "([^"]+)"\s+version = "([^"]+)"'),
    "pdm.lock": ("PyPI", r'(?m)^\[\[package\]\]\s+name = "([^"]+)"\s+version = "([^"]+)"'),
    "uv.lock": ("PyPI", r'(?m)^\[\[package\]\]\s+name = "([^"]+)"\s+version = "([^"]+)"'),
    "Cargo.lock": ("crates.io", r'(?m)^\[\[package\]\]\s+name = "([^"]+)"\s+version = "([^"]+)"'),
    "yarn.lock": ("npm", r'(?m)^"?((?:@[^/\s"]+/)?[^@\s"#]+)@[^\n]*:\r?\n[ ]+version:? "?([^"\s]+)"?'),
    "pnpm-lock.yaml": ("npm", r"(?m)^  ['\"]?/?((?:@[^/\s'\"]+/)?[^@/\s'\"]+)[@/](\d[^:()'\"\s_]*)[^\n]*:[ \t]*\r?$"),
    "Gemfile.lock": ("RubyGems", r"(?m)^    ([A-Za-z0-9][\w.-]*) \(([^()\s]+)\)\r?$"),
    "pom.xml": ("Maven", r"(?s)<dependency>\s*<groupId>\s*([^<\s]+)\s*</groupId>\s*<artifactId>\s*([^<\s]+)\s*</artifactId>\s*<version>\s*([^<\s$]+)\s*</version>"),
    "build.gradle": ("Maven", r"['\"]([\w.-]+):([\w.-]+):(\d[\w.+-]*)['\"]"),
    "packages.config": ("NuGet", r'<package\s[^>]*?id="([^"]+)"[^>]*?version="([^"]+)"'),
    "pubspec.lock": ("Pub", r'(?m)^  ([\w-]+):\r?\n(?:    [^\n]*\n)*?    version: "([^"]+)"'),
    "mix.lock": ("Hex", r'"([^"]+)": \{:hex, :[^,]+, "([^"]+)"'),
    "rebar.lock": ("Hex", r'\{<<"([^"]+)">>,\s*\{pkg,\s*<<"[^"]+">>,\s*<<"([^"]+)">>'),
    "conan.lock": ("ConanCenter", r'"([\w.+-]+)/([\w.+-]+)[#@"]'),
    "cabal.project.freeze": ("Hackage", r"any\.([\w-]+) ==([\d.]+)"),
    "Podfile.lock": ("CocoaPods", r"(?m)^  - \"?([^\s\"(]+) \(([^()\s]+)\)"),
    "Manifest.toml": ("Julia", r'(?m)^\[\[deps\.([^\]]+)\]\][^\[]*?^version = "([^"]+)"'),
}
#: Other names of formats.
ALIASES = {"requirements-dev.txt": "requirements.txt", "build.gradle.kts": "build.gradle"}

_ONE = "struct<version:string>"
_ENTRY = "array<struct<name:string,version:string>>"


def _pairs(text: Column, pattern: str, joined: bool) -> Column:
    """Names and versions of all matches; joined: the name is of groups 1 and 2."""
    group = lambda i: F.regexp_extract_all(text, F.lit(pattern), F.lit(i))
    names = F.zip_with(group(1), group(2), lambda a, b: F.concat(a, F.lit(":"), b)) if joined else group(1)
    return F.zip_with(names, group(3 if joined else 2), lambda n, v: F.struct(n.alias("name"), v.alias("version")))


def _of_map(entries: Column, name=lambda e: e["key"], version=lambda e: e["value"]["version"]) -> Column:
    return F.transform(F.map_entries(entries), lambda e: F.struct(name(e).alias("name"), version(e).alias("version")))


def _json(text: Column) -> dict[str, tuple[str, Column]]:
    none = F.array().cast(_ENTRY)
    both = lambda *x: F.concat(*(F.coalesce(y, none) for y in x))
    npm = F.from_json(text, f"packages map<string,{_ONE}>, dependencies map<string,{_ONE}>")
    inside = lambda e: F.regexp_extract(e["key"], r"(?:^|/)node_modules/((?:@[^/]+/)?[^/]+)$", 1)
    pip = F.from_json(text, f"default map<string,{_ONE}>, develop map<string,{_ONE}>")
    pinned = lambda e: F.regexp_replace(e["value"]["version"], "^=+", "")
    php = F.from_json(text, f"packages {_ENTRY}, `packages-dev` {_ENTRY}")
    plain = lambda x: F.transform(x, lambda e: F.struct(e["name"].alias("name"), F.regexp_replace(e["version"], "^[vV]", "").alias("version")))
    net = F.from_json(text, "dependencies map<string,map<string,struct<resolved:string>>>")
    of_target = F.flatten(F.transform(F.map_values(net["dependencies"]), lambda m: _of_map(m, version=lambda e: e["value"]["resolved"])))
    r = F.from_json(text, "Packages map<string,struct<Version:string>>")
    swift = F.from_json(text, "pins array<struct<identity:string,state:struct<version:string>>>")
    return {
        "package-lock.json": ("npm", F.coalesce(_of_map(npm["packages"], inside), _of_map(npm["dependencies"]), none)),
        "Pipfile.lock": ("PyPI", both(_of_map(pip["default"], version=pinned), _of_map(pip["develop"], version=pinned))),
        "composer.lock": ("Packagist", both(plain(php["packages"]), plain(php["packages-dev"]))),
        "packages.lock.json": ("NuGet", both(of_target)),
        "renv.lock": ("CRAN", both(_of_map(r["Packages"], version=lambda e: e["value"]["Version"]))),
        "Package.resolved": ("SwiftURL", both(F.transform(swift["pins"], lambda p: F.struct(p["identity"].alias("name"), p["state"]["version"].alias("version"))))),
    }


def names() -> tuple[str, ...]:
    return (*PATTERNS, *ALIASES, *_json(F.lit("")))


def parse(files: DataFrame) -> DataFrame:
    """Files (path, text) -> distinct path, name, version, ecosystem; files of other names, or that can't be read, give nothing."""
    leaf, text = S.basename(F.col("path")), F.col("text")
    kinds = {k: (eco, _pairs(text, pattern, k in ("pom.xml", "build.gradle"))) for k, (eco, pattern) in PATTERNS.items()} | _json(text)
    found, ecosystem = F.lit(None).cast(_ENTRY), F.lit(None).cast("string")
    for kind, (eco, pairs) in kinds.items():
        own = leaf.isin(kind, *(a for a, k in ALIASES.items() if k == kind))
        found, ecosystem = F.when(own, pairs).otherwise(found), F.when(own, eco).otherwise(ecosystem)
    out = files.where(leaf.isin(*names())).select("path", ecosystem.alias("ecosystem"), F.explode(found).alias("_p"))
    return out.select("path", "_p.name", "_p.version", "ecosystem").where("name <> '' and version <> ''").distinct()
