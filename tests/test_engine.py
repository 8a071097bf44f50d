"""Cases that the tables don't hold, and properties of the post-processing chain."""

import hashlib
import hmac
import json
import sqlite3

from pyspark.sql import functions as F

from palisade.functions import answers as A
from palisade.functions import scalar as S
from palisade.operators import layers, producers, rules, slices
from palisade.plans import postprocess as P
from palisade.plans import report
from palisade.schema import Config, as_findings
from palisade.sources import files as SRC
from palisade.sources import packages as PKG
from palisade.streaming import state, webhook


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or [F.lit(1)])
    return df.select(column.alias("x")).first().x


def finding(spark, **values):
    columns = {k: F.array(*[F.lit(x) for x in v]) if isinstance(v, list) else v for k, v in values.items()}
    return P.with_fingerprints(as_findings(spark.range(1), **columns))


def prints(*dfs):
    return [df.first().fingerprint for df in dfs]


def test_fingerprint_depends_on_path_and_layer(spark):
    sca = dict(type="sca", rule_id="GHSA-123", package_name="lodash", package_version="1.0.0", ecosystem="npm")
    a, b = prints(finding(spark, **sca, file_path="/repo/app-a/package-lock.json"), finding(spark, **sca, file_path="/repo/app-b/package-lock.json"))
    assert a != b and a == hashlib.sha256(b"sca:GHSA-123:lodash:1.0.0:npm:/repo/app-a/package-lock.json").hexdigest()
    image = sca | dict(type="container", file_path="alpine:3.19")
    places = [("layer-a", "srv/app/package-lock.json"), ("layer-a", "srv/worker/package-lock.json"), ("layer-b", "srv/app/package-lock.json")]
    assert len({*prints(*[finding(spark, **image, layer_digest=x, artifact_path=y) for x, y in places])}) == 3


def test_secret_fingerprint_takes_the_redacted_text(spark):
    base = dict(type="secrets", rule_id="r", file_path="p", start_line=3, redacted="ab****cd")
    a, b = prints(finding(spark, **base, snippet="one"), finding(spark, **base, snippet="two"))
    assert a == b


def test_priority(spark):
    cases = [(4, ["sast", "prefilter", "injection"], 46), (3, ["secrets"], 37), (3, ["sast", "prefilter", "input"], 34), (2, ["license", "policy"], 25), (1, ["injection", "config"], 19), (0, [], 17)]
    for severity, tags, expected in cases:
        array = F.array(*[F.lit(t) for t in tags]).cast("array<string>")
        assert one(spark, S.priority(F.lit(severity), array)) == expected


def test_redact_counts_bytes(spark):
    assert one(spark, S.redact(F.lit("éééé"))) == "********"
    assert one(spark, S.redact(F.lit("abcdéfghij"))) == "abcd****ghij"


def test_lines(spark):
    assert one(spark, S.lines_kept(F.lit("a\r\nb\n"))) == ["a\r", "b", ""]
    for text, expected in (("a\r\nb\n", ["a", "b"]), ("", []), ("\n", [""]), ("a\n\n", ["a", ""]), ("a\r", ["a"])):
        assert one(spark, S.lines_scanned(F.lit(text))) == expected


def test_trim_is_unicode(spark):
    assert one(spark, S.strip(F.lit("\t  x　 "))) == "x"


def test_dot_matches_carriage_return(spark):
    df = spark.createDataFrame([("a", 'x = "SELECT \r a" + b')], "path string, text string")
    assert [r.name for r in rules.prefilter(df).collect()] == ["SQL string concatenation"]


def test_lgpl_text_that_names_gpl(spark):
    text = "gnu lesser general public license\ngnu general public license\nversion 3"
    df = spark.createDataFrame([("a", text), ("b", "\n" * 50 + "MIT License"), ("c", None)], "path string, text string")
    assert {r.path: r.license for r in producers.licenses(df).collect()} == {"a": "GPL-3.0", "b": "unknown", "c": "unknown"}


def test_policy(spark):
    check = lambda lic, allowed, denied: one(spark, S.license_policy(F.lit(lic), allowed, denied))
    assert (check("unknown", [], []), check("ISC", ["MIT"], []), check("GPL-3.0", ["GPL-3.0"], ["gpl-3.0"]), check("mit", ["MIT"], [])) == ("allowed", "unknown", "denied", "allowed")


def test_dedup_is_idempotent_and_filters_commute(spark, sf):
    f = SRC.documents(spark, sf)
    raw = P.with_fingerprints(P.union([producers.source_findings(f, Config()), producers.license_findings(producers.licenses(f), Config(denied_licenses=["MIT", "Apache-2.0"]))] * 2))
    once = P.dedup(raw)
    assert once.count() == P.dedup(once).count() == raw.select("fingerprint").distinct().count()
    x, y = P.by_rule(P.severe(once, "HIGH"), [], ["q"]), P.severe(P.by_rule(once, [], ["q"]), "HIGH")
    assert {r.fingerprint for r in x.collect()} == {r.fingerprint for r in y.collect()}
    gone = once.where("substring(fingerprint, 1, 1) < '8'")
    assert P.without(once, gone).count() + gone.count() == once.count()


def test_required_is_checked_before_filters(spark):
    f = P.score(finding(spark, type="sast", rule_id="SQL-INJECTION", file_path="api/handlers.py", severity=1))
    need = spark.createDataFrame([("", "sql-injection", "handlers", "")], "fingerprint string, rule_id string, file string, reason string")
    assert P.missing_required(f, need).count() == 0 and P.severe(f, "HIGH").count() == 0


def test_changed_only_with_an_empty_list_keeps_all(spark):
    f = finding(spark, type="sast", file_path="a")
    none = spark.createDataFrame([], "path string")
    assert P.changed_only(f, none).count() == 1
    assert P.changed_only(f, spark.createDataFrame([("b",)], "path string")).count() == 0


def test_triage_keeps_an_old_fix(spark):
    f = finding(spark, type="sast", fix_suggestion="old")
    columns = "fingerprint string, verdict string, confidence string, reason string, explanation string, recommendation string, code_fix string"
    r = P.merge_triage(f, spark.createDataFrame([(f.first().fingerprint, "TRUE_POSITIVE", "HIGH", "r", "", "", "new")], columns)).first()
    assert (r.verdict, r.fix_suggestion, r.fix_code, r.verdict_reason) == ("TRUE_POSITIVE", "old", "new", "r")


def test_triage_prompt_answers_survive_a_failing_completer(spark):
    prompts = spark.createDataFrame([("a", "p")], "fingerprint string, prompt string")

    def broken(texts):
        raise RuntimeError

    assert A.complete(prompts, broken).first().answer is None
    assert A.complete(prompts, lambda texts: [t.upper() for t in texts]).first().answer == "P"


def test_rpm_database(spark, tmp_path):
    db = sqlite3.connect(tmp_path / "rpm.sqlite")
    db.execute("CREATE TABLE packages (name TEXT, version TEXT, release TEXT)")
    db.executemany("INSERT INTO packages VALUES (?, ?, ?)", [("a", "1", "2.el9"), ("b", "3", "")])
    db.commit()
    df = spark.createDataFrame([("k", bytearray((tmp_path / "rpm.sqlite").read_bytes())), ("bad", bytearray(b"x"))], "key string, content binary")
    assert sorted(tuple(r) for r in PKG.rpm(df).collect()) == [("k", "a", "1-2.el9"), ("k", "b", "3")]


def test_later_archive_entry_wins(spark):
    df = spark.createDataFrame([("i", 0, "p", 1, "a"), ("i", 0, "p", 2, "b")], "image string, layer_index int, path string, tar_pos int, content string")
    assert PKG.layer_files(df).first().content == "b"


def test_package_twice_in_a_layer_stays_twice(spark):
    df = spark.createDataFrame([("i", 0, "a", "1"), ("i", 0, "a", "1")], "image string, layer_index int, name string, version string")
    assert layers.new_packages(df).count() == 2


def test_directory_scan(spark, tmp_path):
    for path, text in (("a/main.py", "x"), ("vendor/v.py", "x"), ("a/empty.py", ""), ("a/LICENSE", "MIT License")):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    f = SRC.directory(spark, str(tmp_path))
    assert [r.path for r in SRC.for_source(f).collect()] == ["a/main.py"]
    assert {r.path for r in SRC.for_secrets(f).collect()} == {"a/main.py", "a/LICENSE"}
    assert [r.path for r in SRC.license_files(f).collect()] == ["a/LICENSE"]


def test_state_file(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"hashes": {"a": "1"}}')
    (tmp_path / "b.json").write_text("{")
    assert SRC.load_state(spark, str(tmp_path / "s.json")).count() == 1
    assert SRC.load_state(spark, str(tmp_path / "b.json")).count() == SRC.load_state(spark, str(tmp_path / "none")).count() == 0


def test_slice_budget_cuts_the_last_file(spark):
    f = spark.createDataFrame([("a.js", "import './b'"), ("a.js", "x")][:0] + [("a.js", "import x from './b'\nimport y from './c'"), ("b.js", "1" * 10), ("c.js", "2" * 10)], "path string, text string")
    got = slices.supporting(slices.js_edges(f), f, most_bytes=14).orderBy("rank").collect()
    assert [(r.path, len(r.text)) for r in got] == [("b.js", 10), ("c.js", 4)]


def test_webhook_signature(spark):
    sign = lambda b: "sha256=" + hmac.new(b"k", b.encode(), hashlib.sha256).hexdigest()
    rows = [("POST", "push", sign("{}"), "{}"), ("GET", "push", sign("{}"), "{}"), ("POST", "push", "sha256=0", "{}"), ("POST", "push", None, "{}")]
    assert webhook.verified(spark.createDataFrame(rows, "method string, event_type string, signature string, body string"), "k").count() == 1


def test_scan_stream_skips_what_it_knows(spark, tmp_path):
    source, seen = tmp_path / "in", []
    files = lambda rows: spark.createDataFrame(rows, "path string, text string").coalesce(1).write.mode("append").json(str(source))

    def run():
        stream = spark.readStream.schema("path string, text string").json(str(source))
        state.scan_stream(stream, lambda df: seen.append(sorted(r.path for r in df.collect())), str(tmp_path / "cp")).awaitTermination()

    files([("a", "1"), ("b", "1")])
    run()
    files([("a", "1"), ("b", "2"), ("c", "1")])
    run()
    assert seen == [["a", "b"], ["b", "c"]]


def test_documents_and_formats(spark):
    f = P.score(finding(spark, type="sast", rule_id="r", title="t", file_path="a", start_line=2, severity=3))
    assert '"severity":"HIGH"' in report.json_rows(f).first().json and "redacted" not in report.json_rows(f).first().json
    assert '"level":"error"' in report.sarif(f).first().json
    assert "r" in report.comment(f)
    packages = spark.createDataFrame([("a", "1", "npm")], "name string, version string, ecosystem string")
    for name, holds in (("json", "rule_id"), ("sarif", "ruleId"), ("table", "type"), ("cyclonedx", "CycloneDX"), ("spdx", "SPDX-2.3")):
        df = report.render(name, packages if name in ("cyclonedx", "spdx") else f)
        assert holds in (df.first().json if "json" in df.columns else df.toJSON().first())
    assert set(report.FORMATS) == {"json", "sarif", "table", "cyclonedx", "spdx"}
    try:
        report.render("x", f)
        raise AssertionError
    except ValueError:
        pass


def test_rules_are_joined_without_python(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("path"), "text")
    plan = rules.prefilter(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan and "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_command_line(spark, tmp_path, capsys):
    from palisade.cli import main

    root = tmp_path / "r"
    root.mkdir()
    (root / "a.py").write_text('password = "abcdefgh1"\n')
    (root / "requirements.txt").write_text("requests==2.0\n")
    assert main(["scan", str(root), "--output", str(tmp_path / "o.json")], spark) == 1
    report_ = json.loads((tmp_path / "o.json").read_text())
    assert report_["total_findings"] == 1 and report_["scan_types"] == ["sast"] and [f["rule_id"] for f in report_["findings"]] == ["palisade.prefilter.hardcoded_secret"]
    assert (tmp_path / "o.json").stat().st_mode & 0o777 == 0o600
    (tmp_path / "c.json").write_text('{"sast": false, "secrets": true, "unknown": 1}')
    assert main(["scan", str(root), "--config", str(tmp_path / "c.json"), "--format", "sarif"], spark) == 0
    (tmp_path / "b.json").write_text('{"require": [{"rule_id": "x", "file": "y"}]}')
    assert main(["scan", str(root), "--config", str(tmp_path / "c.json"), "--baseline", str(tmp_path / "b.json")], spark) == 1
    assert main(["scan", str(root), "--format", "nope"], spark) == 2
    assert main(["sbom", str(root)], spark) == 0 and "pkg:pypi/requests@2.0" in capsys.readouterr().out
    assert main(["validate-rules"]) == main(["version"]) == 0


def test_assistant(spark):
    from palisade.operators import assistant

    code = spark.createDataFrame([("a.py", 'x\npassword = "abcdefgh1"\ny')], "path string, text string")
    f = P.process([producers.source_findings(code, Config())], Config())
    prompt = assistant.triage_prompts(f, code).first().prompt
    assert "abcdefgh1" not in prompt and "[REDACTED]" in prompt and "Kind: secret" in prompt
    answers = assistant.triaged(f, code, lambda prompts: ["VERDICT: TRUE_POSITIVE\nCONFIDENCE: HIGH" for _ in prompts])
    assert P.merge_triage(f, answers).first().verdict == "TRUE_POSITIVE"

    def broken(prompts):
        raise RuntimeError

    assert assistant.triaged(f, code, broken).first().verdict == "UNKNOWN"
    said = "**Vulnerability Level**: HIGH\n**Issue**: SQL injection\n**Location**: b.py:12\n**Risk**: CWE-89"
    rows = [("a.py", "python", ["a.py", "lib/b.py"], said), ("Dockerfile", "dockerfile", ["Dockerfile"], said), ("c.py", "python", ["c.py"], "mumble"), ("d.py", "python", ["d.py"], None), ("e.py", "python", ["e.py"], "NO_FINDINGS")]
    a = spark.createDataFrame(rows, "path string, language string, files array<string>, answer string")
    got = sorted((r.type, r.rule_id, r.file_path, r.start_line, r.severity, r.cwe, r.tags) for r in assistant.answered_findings(a, Config()).collect())
    assert got == [("dockerfile", "palisade.dockerfile.sql_injection", "Dockerfile", 12, 3, ["CWE-89"], ["dockerfile", "ai"]), ("sast", "palisade.sast.ai.sql_injection", "lib/b.py", 12, 3, ["CWE-89"], ["sast", "ai"])]
    assert {r.path: r.done for r in assistant.succeeded(a).collect()} == {"a.py": True, "Dockerfile": True, "c.py": False, "d.py": False, "e.py": True}


def test_code_line(spark):
    from palisade.operators.assistant import code_line

    text = F.lit("  func x() {\n\n  y\nz")
    assert [one(spark, code_line(text, F.lit(n))) for n in (1, 2, 3, 4, 5, 0)] == ["func x() {\ny", "", "y", "z", "", ""]
