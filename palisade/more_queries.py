"""Further queries, one for each operator that queries.py doesn't reach, with the same in DuckDB SQL."""

from __future__ import annotations

import io
import json
import sqlite3
import tarfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palisade.functions import answers as A
from palisade.functions import scalar as S
from palisade.functions.versions import version_key
from palisade.operators import assistant, containers, producers, registry, rules, slices
from palisade.plans import postprocess as P
from palisade.plans import report
from palisade.queries import _LABEL, _WITH, CFG, Fixture, _literal, all_findings, files, query
from palisade.schema import Config, as_findings
from palisade.sinks.folders import shared_folder
from palisade.sources import files as SRC
from palisade.sources import images, lockfiles, settings
from palisade.sources import packages as PKG
from palisade.streaming import webhook


def _values(columns: str, rows: list[tuple]) -> str:
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_literal, r)) + ')' for r in rows)}) AS t({columns})"


# all secret rules over the documents

_SECRETS = Fixture("rule string, regex string", [(n, r) for n, r, _ in rules.SECRET_RULES])
_FOUND = _WITH + f""", secret AS (SELECT path, CAST(no AS INT) AS start_line, rule, unnest(regexp_extract_all(line, regex, 1)) AS x FROM lines, (SELECT * FROM {_SECRETS.sql}) r)
SELECT """


@query("secret_findings", _FOUND + "'secrets' AS type, rule AS rule_id, 3 AS severity, path AS file_path, start_line, start_line AS end_line, CASE WHEN strlen(x) <= 8 THEN repeat('*', strlen(x)) ELSE left(x, 4) || '****' || right(x, 4) END AS snippet FROM secret")
def _(s: SparkSession, d: str) -> DataFrame:
    return producers.secret_findings(files(s, d), CFG).select("type", "rule_id", "severity", "file_path", "start_line", "end_line", "snippet")


@query("secret_findings_by_rule", _FOUND + "rule AS rule_id, count(*) AS n, count(DISTINCT path) AS files FROM secret GROUP BY rule")
def _(s, d):
    return producers.secret_findings(files(s, d), CFG).groupBy("rule_id").agg(F.count("*").alias("n"), F.countDistinct("file_path").alias("files"))


@query("custom_secret_rules", _FOUND.rpartition("SELECT ")[0] + r"SELECT path AS file_path, CAST(no AS INT) AS start_line FROM (SELECT path, no, unnest(regexp_extract_all(line, '([A-Z][a-z]+) [0-9]{4}', 1)) AS x FROM lines)")
def _(s, d):
    return producers.secret_findings(files(s, d), CFG, [("year", "([A-Z][a-z]+) [0-9]{4}", 1)]).select("file_path", "start_line")


@query("findings_table_groups", _WITH + "SELECT type, count(*) AS findings, count(*) FILTER (severity = 4) AS critical, count(*) FILTER (severity = 3) AS high, count(*) FILTER (severity = 2) AS medium, count(*) FILTER (severity = 1) AS low, count(*) FILTER (severity = 0) AS info FROM findings GROUP BY type")
def _(s, d):
    return report.table_groups(all_findings(s, d))


@query("check_run", _WITH + "SELECT CASE WHEN count(*) > 0 THEN 'failure' ELSE 'success' END AS conclusion, count(*) AS findings, least(count(*) FILTER (file_path <> '' AND start_line >= 1), 50) AS annotated FROM findings")
def _(s, d):
    return report.check_run(all_findings(s, d))


@query("false_positive_boxes", _WITH + "SELECT fingerprint, '- [ ] ' || rule_id || ' in ' || file_path || ' <!-- fp:' || left(fingerprint, 16) || ' -->' AS line FROM (SELECT * FROM findings ORDER BY severity DESC, file_path, start_line, rule_id, fingerprint LIMIT 30)")
def _(s, d):
    return report.false_positive_boxes(all_findings(s, d))


@query("json_report", _WITH + f"SELECT fingerprint, rule_id, {_LABEL} AS severity, file_path, CAST(start_line AS BIGINT) AS start_line, total FROM findings, (SELECT count(*) AS total FROM findings)")
def _(s, d):
    path = f"{shared_folder(s, 'documents')}/report.json"
    report.save("json", all_findings(s, d), path)
    lines = s.read.text(path)  # the document is what is tested: it is read back
    total = lines.where("startswith(value, '{\"total_findings\"')").select(F.regexp_extract("value", r'"total_findings": (\d+)', 1).cast("long").alias("total"))
    found = lines.where("startswith(value, '{\"type\"')").select(F.from_json(F.regexp_replace("value", ",$", ""), "fingerprint string, rule_id string, severity string, file_path string, start_line long").alias("x")).select("x.*")
    return found.crossJoin(F.broadcast(total))  # one row


@query("suppressed_counts", _WITH + "SELECT count(*) FILTER (severity = 4) AS inline, count(*) FILTER (severity < 4 AND start_line = 1) AS baseline, count(*) FILTER (severity = 4 OR start_line = 1) AS suppressed FROM findings")
def _(s, d):
    f = all_findings(s, d)
    return P.suppressed_counts(f, f.where("severity = 4"), f.where("start_line = 1"))


@query("two_runs", _WITH + "SELECT rule_id, 2 * count(*) AS n FROM findings GROUP BY rule_id")
def _(s, d):
    f = all_findings(s, d)
    return P.both_runs(f, f).groupBy("rule_id").agg(F.count("*").alias("n"))


@query("push_findings", _WITH + ", c AS (SELECT path, row_number() OVER (ORDER BY path) AS ord FROM files) SELECT rule_id, file_path, start_line FROM findings WHERE file_path IN (SELECT path FROM c WHERE ord <= 100)")
def _(s, d):
    # names without extensions aren't source files: the first hundred become some
    f, p = all_findings(s, d), F.concat("file_path", F.lit(".py"))
    listed = files(s, d).select(F.concat("path", F.lit(".py")).alias("path")).orderBy("path").limit(300)
    listed = listed.withColumn("ord", F.row_number().over(Window.orderBy("path")))  # of 300 rows
    out = webhook.push_findings(f.withColumn("file_path", p), listed)
    return out.select("rule_id", F.expr("substring(file_path, 1, length(file_path) - 3)").alias("file_path"), "start_line")


# versions and advisories

_ORDER = {
    "npm": ["1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-beta", "1.0.0-rc.1", "1.0.0", "1.0.1", "1.2.0", "1.10.0", "2.0.0"],
    "PyPI": ["1.0.dev1", "1.0a1", "1.0b2", "1.0rc1", "1.0", "1.0.post1", "1.1", "1!0.5"],
    "Debian:12": ["1.0~rc1", "1.0", "1.0-1", "1.0.1-1", "1:0.9"],
    "Maven": ["1.0-alpha1", "1.0-beta1", "1.0-SNAPSHOT", "1.0", "1.0.1", "1.10"],
}
_PLACES = [(eco, v, i) for eco, vs in _ORDER.items() for i, v in enumerate(vs)]


@query("version_order", _values("ecosystem, version, place", _PLACES))
def _(s, d):
    v = s.createDataFrame([x[:2] for x in reversed(_PLACES)], "ecosystem string, version string").withColumn("k", version_key(F.col("version"), F.col("ecosystem")))
    return v.select("ecosystem", "version", (F.row_number().over(Window.partitionBy("ecosystem").orderBy("k")) - 1).alias("place"))


_RANGED = "id string, name string, ecosystem string, versions array<string>, aliases array<string>, summary string, severity array<struct<score:string>>, refs array<struct<url:string>>, affected array<struct<ranges:array<struct<events:array<struct<introduced:string,fixed:string>>>>>>"


def _advisory(id_, name, eco, *ranges, versions=()):
    return (id_, name, eco, list(versions), [], id_, [], [], [([([*map(tuple, r)],) for r in ranges],)])


_RANGES = [
    _advisory("R1", "a", "npm", [("0", ""), ("", "1.2.0")], [("2.0.0", ""), ("", "2.1.0")]),
    _advisory("R2", "a", "npm", [("1.5.0", "")]),
    _advisory("R3", "b", "PyPI", [("1.0rc1", ""), ("", "1.0.post1")], versions=["0.1"]),
    _advisory("R4", "c", "Debian:12", [("0", ""), ("", "1:1.0-2")]),
]
_INSTALLED = [("a", v, "npm") for v in ("1.1.9", "1.2.0", "1.5.0", "2.0.5", "2.1.0-rc.1", "2.1.0")] + [("b", v, "PyPI") for v in ("0.1", "0.9", "1.0a1", "1.0rc1", "1.0", "1.0.0", "1.1")] + [("c", v, "Debian:12") for v in ("2.0-1", "1:1.0-1", "1:1.0-2")]
_HITS = [("R1", "1.1.9"), ("R1", "2.0.5"), ("R1", "2.1.0-rc.1"), ("R2", "1.5.0"), ("R2", "2.0.5"), ("R2", "2.1.0-rc.1"), ("R2", "2.1.0"), ("R3", "0.1"), ("R3", "1.0rc1"), ("R3", "1.0"), ("R3", "1.0.0"), ("R4", "2.0-1"), ("R4", "1:1.0-1")]


@query("advisory_ranges", _values("advisory, version", _HITS))
def _(s, d):
    p = s.createDataFrame([(*x, ["l"]) for x in _INSTALLED], "name string, version string, ecosystem string, locations array<string>")
    return producers.advisory_matches(p, s.createDataFrame(_RANGES, _RANGED)).select("advisory", "version")


# lockfiles

_LOCKS = {
    "requirements-dev.txt": ("flask[async]==2.0 # x\n# no==1\nx>=1\n", [("flask", "2.0", "PyPI")]),
    "go.mod": ("module ex.com/m\nrequire ex.com/a v1.2.3\nrequire (\n\tex.com/b v0.1.0 // indirect\n)\n", [("ex.com/a", "1.2.3", "Go"), ("ex.com/b", "0.1.0", "Go")]),
    "go.sum": ("ex.com/a v1.2.3 h1:x=\nex.com/a v1.2.3/go.mod h1:y=\n", [("ex.com/a", "1.2.3", "Go")]),
    "poetry.lock": ('[[package]]\nname = "six"\nversion = "1.16.0"\n\n[[package]]\nname = "attrs"\nversion = "23.1"\n', [("six", "1.16.0", "PyPI"), ("attrs", "23.1", "PyPI")]),
    "pdm.lock": ('[[package]]\nname = "idna"\nversion = "3.4"\n', [("idna", "3.4", "PyPI")]),
    "Cargo.lock": ('[[package]]\nname = "serde"\nversion = "1.0.1"\n', [("serde", "1.0.1", "crates.io")]),
    "yarn.lock": ('# yarn\n"@babel/core@^7.0.0", "@babel/core@^7.1":\n  version "7.2.0"\n\nlodash@^4:\n  version "4.17.21"\n', [("@babel/core", "7.2.0", "npm"), ("lodash", "4.17.21", "npm")]),
    "pnpm-lock.yaml": ("packages:\n\n  /left-pad@1.3.0:\n    resolution: {}\n\n  '@a/b@2.0.0':\n    x: y\n", [("left-pad", "1.3.0", "npm"), ("@a/b", "2.0.0", "npm")]),
    "Gemfile.lock": ("GEM\n  specs:\n    rails (6.0.1)\n      rack (>= 2)\n    rack (2.2)\n", [("rails", "6.0.1", "RubyGems"), ("rack", "2.2", "RubyGems")]),
    "pom.xml": ("<dependency>\n <groupId>g</groupId> <artifactId>a</artifactId>\n <version>1.1</version></dependency><dependency><groupId>g</groupId><artifactId>p</artifactId><version>${v}</version></dependency>", [("g:a", "1.1", "Maven")]),
    "build.gradle.kts": ('implementation("com.x:y:1.0.2")\nproject(":a")\n', [("com.x:y", "1.0.2", "Maven")]),
    "packages.config": ('<package id="N.Json" version="9.0.1" />', [("N.Json", "9.0.1", "NuGet")]),
    "pubspec.lock": ('packages:\n  http:\n    dependency: "direct"\n    version: "0.13.5"\n', [("http", "0.13.5", "Pub")]),
    "mix.lock": ('%{\n  "jason": {:hex, :jason, "1.4.0", "x"},\n}\n', [("jason", "1.4.0", "Hex")]),
    "rebar.lock": ('[{<<"cowboy">>,{pkg,<<"cowboy">>,<<"2.9.0">>},0}].', [("cowboy", "2.9.0", "Hex")]),
    "conan.lock": ('{"requires": ["zlib/1.2.13#x"]}', [("zlib", "1.2.13", "ConanCenter")]),
    "cabal.project.freeze": ("constraints: any.aeson ==2.1.0.0,\n", [("aeson", "2.1.0.0", "Hackage")]),
    "Podfile.lock": ("PODS:\n  - AFNetworking (4.0.1):\n    - X (1)\n", [("AFNetworking", "4.0.1", "CocoaPods")]),
    "Manifest.toml": ('[[deps.JSON]]\nuuid = "x"\nversion = "0.21.3"\n', [("JSON", "0.21.3", "Julia")]),
    "package-lock.json": ('{"packages": {"": {"version": "0"}, "node_modules/a": {"version": "1"}, "node_modules/a/node_modules/@s/b": {"version": "2"}}}', [("a", "1", "npm"), ("@s/b", "2", "npm")]),
    "Pipfile.lock": ('{"default": {"x": {"version": "==1.1"}}, "develop": {"y": {"version": "==2"}}}', [("x", "1.1", "PyPI"), ("y", "2", "PyPI")]),
    "composer.lock": ('{"packages": [{"name": "a/b", "version": "v1.0"}], "packages-dev": [{"name": "c/d", "version": "2.1"}]}', [("a/b", "1.0", "Packagist"), ("c/d", "2.1", "Packagist")]),
    "packages.lock.json": ('{"dependencies": {"net6.0": {"Serilog": {"resolved": "2.10.0"}}}}', [("Serilog", "2.10.0", "NuGet")]),
    "renv.lock": ('{"Packages": {"dplyr": {"Version": "1.1.0"}}}', [("dplyr", "1.1.0", "CRAN")]),
    "Package.resolved": ('{"pins": [{"identity": "nio", "state": {"version": "2.40.0"}}]}', [("nio", "2.40.0", "SwiftURL")]),
    "other.txt": ("a==1", []),
}


@query("lockfile_formats", _values("path, name, version, ecosystem", [(f"d/{f}", *x) for f, (_, xs) in _LOCKS.items() for x in xs]))
def _(s, d):
    return lockfiles.parse(s.createDataFrame([(f"d/{f}", t) for f, (t, _) in _LOCKS.items()] + [("d/composer.lock.bak", "x"), ("e/composer.lock", "broken")], "path string, text string"))


# containers


def _tar(files_: list[tuple[str, bytes]]) -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as t:
        for name, data in files_:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return out.getvalue()


def _rpm_database() -> bytes:
    db = sqlite3.connect(":memory:")
    db.execute("CREATE TABLE packages (name, version, release)")
    db.executemany("INSERT INTO packages VALUES (?, ?, ?)", [("bash", "5.1", "2.el9"), ("gpg-pubkey", "1", "")])
    db.commit()
    return db.serialize()


def _archive(s: SparkSession) -> DataFrame:
    one = _tar([("etc/os-release", b'ID=alpine\nVERSION_ID="3.19.1"\n'), ("lib/apk/db/installed", b"P:musl\nV:1.2.3-r0\n\nP:zlib\nV:1.2.11-r0\n"), ("app/yarn.lock", b'lodash@^4:\n  version "4.17.20"\n'), ("old/yarn.lock", b'gone@^1:\n  version "1.0.0"\n')])
    two = _tar([("lib/apk/db/installed", b"P:musl\nV:1.2.3-r0\n\nP:zlib\nV:1.2.11-r0\n\nP:curl\nV:8.0.0-r1\n"), ("old/.wh.yarn.lock", b"")])
    alpine = _tar([("manifest.json", json.dumps([{"Layers": ["a/layer.tar", "b/layer.tar"]}]).encode()), ("a/layer.tar", one), ("b/layer.tar", two)])
    red = _tar([("manifest.json", json.dumps([{"Layers": ["x.tar"]}]).encode()), ("x.tar", _tar([("etc/os-release", b"ID=rocky\nVERSION_ID=9.2\n"), ("var/lib/rpm/rpmdb.sqlite", _rpm_database())]))])
    strange = _tar([("manifest.json", json.dumps([{"Layers": ["x.tar"]}]).encode()), ("x.tar", _tar([("etc/os-release", b"ID=plan9\n"), ("lib/apk/db/installed", b"P:musl\nV:1.2.3-r0\n"), ("go.sum", b"ex.com/a v1.0.0 h1:x\n")]))])
    archives = s.createDataFrame([("alpine", alpine), ("red", red), ("strange", strange), ("broken", b"no tar")], "image string, content binary")
    return images.entries(archives, (*images.APK, *images.DPKG, *images.RPM, *images.RELEASE), lockfiles.names())


_IN_IMAGES = [("alpine", 0, i, p, True) for i, p in enumerate(("etc/os-release", "lib/apk/db/installed", "app/yarn.lock", "old/yarn.lock"))] + [("alpine", 1, 0, "lib/apk/db/installed", True), ("alpine", 1, 1, "old/.wh.yarn.lock", False)]
_IN_IMAGES += [("red", 0, 0, "etc/os-release", True), ("red", 0, 1, "var/lib/rpm/rpmdb.sqlite", True)] + [("strange", 0, i, p, True) for i, p in enumerate(("etc/os-release", "lib/apk/db/installed", "go.sum"))]


@query("image_entries", _values("image, layer_index, tar_pos, path, whole", _IN_IMAGES))
def _(s, d):
    return _archive(s).select("image", "layer_index", "tar_pos", "path", F.coalesce((F.octet_length("content") == F.col("size")) & F.startswith("layer_digest", F.lit("sha256:")), F.lit(False)).alias("whole"))


@query("container_packages", _values("image, layer_index, name, version, ecosystem", [("alpine", 0, "musl", "1.2.3-r0", "Alpine:v3.19"), ("alpine", 0, "zlib", "1.2.11-r0", "Alpine:v3.19"), ("alpine", 1, "curl", "8.0.0-r1", "Alpine:v3.19"), ("red", 0, "bash", "5.1-2.el9", "Red Hat:9"), ("red", 0, "gpg-pubkey", "1", "Red Hat:9"), ("alpine", 0, "lodash", "4.17.20", "npm"), ("strange", 0, "ex.com/a", "1.0.0", "Go")]))
def _(s, d):
    e, columns = _archive(s), ["image", "layer_index", "name", "version", "ecosystem"]
    return containers.system_packages(e).select(columns).unionByName(containers.language_packages(e).select(columns))


@query("container_findings", _values("type, rule_id, file_path, artifact_path, layer_index, package_name, fixed_version, tag", [("container", "C1", "alpine", "", 2, "curl", "8.1.0-r0", "alpine:v3.19"), ("container", "C2", "alpine", "app/yarn.lock", 1, "lodash", "4.17.21", "npm"), ("container", "C3", "red", "", 1, "bash", "5.1-3.el9", "red hat:9")]))
def _(s, d):
    a = [_advisory("C1", "curl", "Alpine:v3.19", [("0", ""), ("", "8.1.0-r0")]), _advisory("C2", "lodash", "npm", [("0", ""), ("", "4.17.21")]), _advisory("C3", "bash", "Red Hat:9", [("0", ""), ("", "5.1-3.el9")]), _advisory("C4", "musl", "Alpine:v3.19", [("0", ""), ("", "1.2.3-r0")])]
    f = containers.container_findings(_archive(s), s.createDataFrame(a, _RANGED))
    return f.select("type", "rule_id", "file_path", "artifact_path", "layer_index", "package_name", "fixed_version", F.element_at("tags", 2).alias("tag"))


@query("rpm_parse", _values("key, name, version", [("k", "bash", "5.1-2.el9"), ("k", "gpg-pubkey", "1")]))
def _(s, d):
    return PKG.rpm(s.createDataFrame([("k", bytearray(_rpm_database())), ("broken", bytearray(b"x")), ("none", None)], "key string, content binary"))


# settings, registries, scanners


def _written(text: str) -> str:
    import tempfile
    from pathlib import Path

    with tempfile.TemporaryDirectory() as folder:  # read on the driver, where it is written
        path = Path(folder) / "settings"
        path.write_text(text)
        return json.dumps(settings.load(str(path)), sort_keys=True)


@query("settings_files", _values("name, content", [("json", '{"a": [1, 2]}'), ("broken", "{}"), ("list", "{}"), ("empty", "{}"), ("missing", "{}")]))
def _(s, d):
    rows = [("json", _written('{"a": [1, 2]}')), ("broken", _written('{"a": [')), ("list", _written("[1]")), ("empty", _written("")), ("missing", json.dumps(settings.load("/no/such/file")))]
    return s.createDataFrame(rows, "name string, content string")


@query("registry_backends", _values("mode, backend, ecosystem, base, ord", [
    ("auto", "npm-custom", "npm", "https://r.ex.com/npm", 0), ("auto", "npm", "npm", "https://registry.npmjs.org", 1), ("auto", "pypi", "pypi", "https://pypi.org", 2), ("auto", "crates", "crates", "https://crates.io", 3),
    ("public-only", "npm", "npm", "https://registry.npmjs.org", 0), ("public-only", "pypi", "pypi", "https://pypi.org", 1), ("public-only", "crates", "crates", "https://crates.io", 2), ("custom-only", "npm-custom", "npm", "https://r.ex.com/npm", 0),
]))
def _(s, d):
    made = [registry.backends(s, {"npm": "https://r.ex.com/npm/", "pypi": ""}, m).withColumn("mode", F.lit(m)) for m in registry.MODES]
    return made[0].unionByName(made[1]).unionByName(made[2])


@query("registry_off", "SELECT CAST(0 AS BIGINT) AS backends, CAST(0 AS BIGINT) AS findings")
def _(s, d):
    none = registry.backends(s, {}, "custom-only")
    p = s.createDataFrame([("a", "1", "npm", ["l"])], "name string, version string, ecosystem string, locations array<string>")
    looked = producers.registry_lookups(p, none, s.createDataFrame([], "backend string, ecosystem string, name string, http_status int"))
    f = producers.hallucinated_findings(p, producers.registry_decisions(looked), CFG)
    return none.agg(F.count("*").alias("backends")).crossJoin(f.agg(F.count("*").alias("findings")))


@query("scanner_plugins", _WITH + "SELECT 'own' AS name, count(*) AS n FROM files WHERE text LIKE '%Oneaea%'")
def _(s, d):
    own = registry.Scanner("own", "sast", lambda spark, inputs, cfg: as_findings(inputs["files"].where(F.contains("text", F.lit("Oneaea"))), type="sast", rule_id="own", file_path=F.col("path"), start_line=1))
    return own.scan(s, {"files": files(s, d)}, Config()).agg(F.count("*").alias("n")).select(F.lit(own.name).alias("name"), "n")


# suppression, slices, code

_MARKED = [("a.py", "x = md5(y) # PALISADE:Ignore\nmd5(z)\nmd5(q)"), ("b.py", "# Palisade:ignore PALISADE.prefilter.weak_hash__md5\nmd5(y)\n// palisade:IGNORE other\nmd5(y)"), ("c.py", "# it's\nmd5(y)")]


@query("inline_markers", _values("path, line, rule", [("a.py", 1, ""), ("b.py", 1, "palisade.prefilter.weak_hash__md5"), ("b.py", 3, "other")]))
def _(s, d):
    return P.markers(s.createDataFrame(_MARKED, "path string, text string"), "palisade:ignore")


@query("marker_with_quote", _values("path, line, rule", [("c.py", 1, "")]))
def _(s, d):
    return P.markers(s.createDataFrame(_MARKED, "path string, text string"), "It's")


_GO = [("p/a.go", 'package p\nimport (\n"ex.com/m/u"\n"fmt"\n)'), ("p/b.go", "package p"), ("p/empty.go", ""), ("p/a_test.go", "package p"), ("u/z.go", "package u"), ("u/y.go", 'package u\nimport "ex.com/m/w"'), ("w/w.go", "package w")]


@query("go_slices", _values("primary_path, path, rank", [("p/a.go", "p/b.go", 1), ("p/a.go", "u/y.go", 2), ("p/a.go", "u/z.go", 3), ("p/b.go", "p/a.go", 1), ("u/z.go", "u/y.go", 1), ("u/y.go", "u/z.go", 1), ("u/y.go", "w/w.go", 2)]))
def _(s, d):
    f = s.createDataFrame(_GO, "path string, text string")
    return slices.supporting(slices.go_edges(f, "ex.com/m"), f, depth=1).select(F.col("primary").alias("primary_path"), "path", "rank")


@query("slice_skips_empty_files", _values("path, rank", [("m8.js", 1), ("m9.js", 2)]))
def _(s, d):
    rows = [("a.js", "".join(f"import x from './m{i}.js';\n" for i in range(10)))] + [(f"m{i}.js", "" if i < 8 else "x") for i in range(10)]
    f = s.createDataFrame(rows, "path string, text string")
    return slices.supporting(slices.js_edges(f), f).where("primary = 'a.js'").select("path", "rank")


@query("supporting_language", _values("path, language", [("a/b.go", "go"), ("x.tsx", "typescript"), ("Dockerfile", ""), ("a.unknown", "")]))
def _(s, d):
    return s.createDataFrame([("a/b.go",), ("x.tsx",), ("Dockerfile",), ("a.unknown",)], "path string").select("path", slices.supporting_language(F.col("path")).alias("language"))


@query("go_module", _values("text, module", [("module ex.com/m\n\ngo 1.20", "ex.com/m"), ("// x\nmodule a\n", "a"), ("go 1.2", "")]))
def _(s, d):
    return s.createDataFrame([("module ex.com/m\n\ngo 1.20",), ("// x\nmodule a\n",), ("go 1.2",)], "text string").select("text", slices.go_module(F.col("text")).alias("module"))


_CODE = "func f() {\n\n  x := 1\n}\ny := 2"


@query("code_line", _values("line, code", [(0, ""), (1, "func f() {\nx := 1"), (3, "x := 1"), (5, "y := 2"), (6, "")]))
def _(s, d):
    return s.createDataFrame([(n, _CODE) for n in (0, 1, 3, 5, 6)], "line int, text string").select("line", assistant.code_line(F.col("text"), F.col("line")).alias("code"))


@query("truncated_text", _values("text, short, tail", [("abcdef", "abc…", "…def"), ("abcd", "abcd", "abcd"), ("", "", "")]))
def _(s, d):
    t = F.col("text")
    return s.createDataFrame([("abcdef",), ("abcd",), ("",)], "text string").select("text", S.truncated(t, 4).alias("short"), S.truncated_path(t, 4).alias("tail"))


@query("changed_list", _values("path", [("a.go",), ("b/c.PY",)]))
def _(s, d):
    listed = [(i, f"x{i}.md") for i in range(2, 100)] + [(0, "a.go"), (1, "b/c.PY"), (100, "late.go")]
    return SRC.changed_list(s.createDataFrame(listed, "ord int, path string"))


@query("state_after_scan", _WITH + "SELECT path, sha256(coalesce(text, '')) AS sha256 FROM files")
def _(s, d):
    now = files(s, d).select("path", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))
    old = now.withColumn("sha256", F.when(F.crc32("path") % 3 == 0, "old").otherwise(F.col("sha256"))).where(F.crc32("path") % 5 != 0)
    return SRC.remembered(old, SRC.changed(now, old))


# language models


def _finding(s: SparkSession) -> DataFrame:
    rows = [("f1", "sast", 3, "SQL injection", "Query from input", "a.py", 2, "TRUE_POSITIVE", "use parameters", ""), ("f2", "sast", 4, "Path traversal", "x", "b.py", 1, "FALSE_POSITIVE", "no", ""), ("f3", "sca", 2, "GHSA", "y", "", 0, "TRUE_POSITIVE", "", "fix()")]
    names = "fingerprint string, type string, severity int, rule_name string, description string, file_path string, start_line int, verdict string, fix_suggestion string, fix_code string"
    d = s.createDataFrame(rows, names)
    return as_findings(d, **{c: F.col(c) for c in d.columns}, rule_id=F.col("fingerprint"), title=F.col("rule_name"))


@query("fix_suggestions", _values("fingerprint, fix_suggestion, fix_code", [("f1", "use parameters", ""), ("f3", "", "fix()")]))
def _(s, d):
    return report.fix_suggestions(_finding(s)).select("fingerprint", "fix_suggestion", "fix_code")


@query("vulnerability_example", _values("rule_name, example", [("SSRF in client", "ssrf"), ("AES ECB mode", "ecb"), ("Nothing known", "")]))
def _(s, d):
    return s.createDataFrame([("SSRF in client",), ("AES ECB mode",), ("Nothing known",)], "rule_name string").select("rule_name", assistant.example_of(F.col("rule_name"), F.lit("")).alias("example"))


_ANSWER = "**Vulnerability Level**: HIGH\n**Issue**: SQL injection CWE-89\n**Location**: a.py:12\n**Risk**: data loss\n**Fix**: bind\n---\n"


@query("model_findings", _values("type, rule_id, file_path, start_line, severity, cwe, tag", [("sast", "palisade.sast.ai.sql_injection_cwe_89", "a.py", 12, 3, "CWE-89", "ai"), ("dockerfile", "palisade.dockerfile.sql_injection_cwe_89", "Dockerfile", 12, 3, "CWE-89", "ai")]))
def _(s, d):
    a = s.createDataFrame([("a.py", "python", ["a.py"], _ANSWER), ("Dockerfile", "dockerfile", ["Dockerfile"], _ANSWER), ("c.py", "python", ["c.py"], "NO_FINDINGS")], "path string, language string, files array<string>, answer string")
    f = assistant.answered_findings(a, Config())
    return f.select("type", "rule_id", "file_path", "start_line", "severity", F.element_at("cwe", 1).alias("cwe"), F.element_at("tags", 2).alias("tag"))


@query("scan_success", _values("path, done", [("a.py", True), ("c.py", True), ("d.py", False), ("e.py", False), ("f.py", True)]))
def _(s, d):
    a = s.createDataFrame([("a.py", _ANSWER), ("c.py", "NO_FINDINGS"), ("d.py", "what?"), ("e.py", None), ("f.py", " ")], "path string, answer string")
    return assistant.succeeded(a)


@query("model_triage", _values("fingerprint, verdict, reason", [("f1", "TRUE_POSITIVE", "seen"), ("f2", "TRUE_POSITIVE", "seen"), ("f3", "TRUE_POSITIVE", "seen")]))
def _(s, d):
    code = s.createDataFrame([("a.py", "x\nq(y)\n"), ("b.py", "z")], "path string, text string")
    return assistant.triaged(_finding(s), code, lambda prompts: ["VERDICT: TRUE_POSITIVE\nCONFIDENCE: HIGH\nREASON: seen" for _ in prompts]).select("fingerprint", "verdict", "reason")


@query("model_context", _values("fingerprint, context", [("f1", "   1  x\n   2  q(y)\n   3  \n"), ("f2", "   1  z\n")]))
def _(s, d):
    return assistant.finding_context(_finding(s), s.createDataFrame([("a.py", "x\nq(y)\n"), ("b.py", "z")], "path string, text string"))


@query("model_completion", _values("prompt, answer", [("a", "A"), ("b", "B")]))
def _(s, d):
    return A.complete(s.createDataFrame([("a",), ("b",)], "prompt string"), lambda texts: [t.upper() for t in texts])


# the server

def _signature(secret: str, body: str) -> str:
    import hashlib
    import hmac

    return "sha256=" + hmac.new(secret.encode(), body.encode(), hashlib.sha256).hexdigest()


@query("webhook_verified", _values("id", [("good",), ("lower",)]))
def _(s, d):
    body = '{"a": "é"}'
    rows = [("good", "POST", body, _signature("key", body)), ("lower", "post", body, _signature("key", body)), ("get", "GET", body, _signature("key", body)), ("wrong", "POST", body, _signature("other", body)), ("none", "POST", body, None), ("changed", "POST", body + " ", _signature("key", body))]
    return webhook.verified(s.createDataFrame(rows, "id string, method string, body string, signature string"), "key").select("id")


@query("webhook_long_key", _values("id", [("good",)]))
def _(s, d):
    key = "k" * 100
    rows = [("good", "POST", "{}", _signature(key, "{}")), ("bad", "POST", "{}", _signature(key[:64], "{}"))]
    return webhook.verified(s.createDataFrame(rows, "id string, method string, body string, signature string"), key).select("id")


@query("admission", _values("arrived, repository, sha", [(1, "r", "a"), (2, "r", "c")]))
def _(s, d):
    asked = s.createDataFrame([(1, "r", "a"), (3, "r", "a"), (2, "r", "c"), (0, "r", "busy"), (4, "q", "d")], "at int, repository string, sha string")
    return webhook.admitted(asked, s.createDataFrame([("r", "busy"), ("x", "y")], "repository string, sha string"), most=4).withColumnRenamed("at", "arrived")


@query("summary_comment", _values("n, line", [(0, "<!-- palisade -->"), (1, "## Findings"), (3, "CRITICAL: 1, HIGH: 1, MEDIUM: 1"), (5, "| severity | rule | place |")]))
def _(s, d):
    lines = report.comment(_finding(s)).split("\n")
    return s.createDataFrame([(i, x) for i, x in enumerate(lines) if i in (0, 1, 3, 5)], "n int, line string")
