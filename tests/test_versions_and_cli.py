"""Debian's order of versions; the command line's options."""

import functools
import json
import random
import re

from pyspark.sql import functions as F

from palisade.cli import main
from palisade.functions.versions import dpkg_key, version_key
from palisade.sources import files as SRC


def plain_dpkg(a, b):
    """-1, 0 or 1, by Debian's policy manual."""

    def split(v):
        epoch, rest = v.split(":", 1) if re.match(r"\d+:", v) else ("0", v)
        up, _, rev = rest.rpartition("-") if "-" in rest else (rest, "", "")
        return int(epoch), up, rev

    def weight(c):
        return -1 if c == "~" else ord(c) if c.isalpha() else ord(c) + 256

    def part(x, y):
        while x or y:
            p, q = re.match(r"\D*", x)[0], re.match(r"\D*", y)[0]
            x, y = x[len(p) :], y[len(q) :]
            for i in range(max(len(p), len(q))):
                u, v = (weight(s[i]) if i < len(s) else 0 for s in (p, q))
                if u != v:
                    return -1 if u < v else 1
            p, q = re.match(r"\d*", x)[0], re.match(r"\d*", y)[0]
            x, y = x[len(p) :], y[len(q) :]
            if int(p or 0) != int(q or 0):
                return -1 if int(p or 0) < int(q or 0) else 1
        return 0

    (e, u, r), (f, v, s) = split(a), split(b)
    return (e > f) - (e < f) or part(u, v) or part(r, s)


def test_dpkg_order(spark):
    rng = random.Random(10)
    bits = ["1", "0", "10", "2", "007", ".", "~", "+", "a", "b", "rc", "-", "Z", "~~", "b1", "+b1", "dfsg", "ubuntu"]
    versions = {"1.0", "1.0+b1", "1.0a", "1.0rc1", "1.0~rc1", "1.0-1", "1.0-1+b1", "1:0.1", "1.0-0", "1.", "1.0~", "2:1.0", "1.00", "1.0-1~bpo1", "1.0.1"}
    versions |= {rng.choice(["", "1:", "0:"]) + "1" + "".join(rng.choice(bits) for _ in range(rng.randrange(7))) for _ in range(150)}
    versions = sorted(versions)
    keys = {r.v: r.k for r in spark.createDataFrame([(v,) for v in versions], "v string").select("v", dpkg_key(F.col("v")).alias("k")).collect()}
    for a in versions:
        for b in versions:
            assert (keys[a] > keys[b]) - (keys[a] < keys[b]) == plain_dpkg(a, b), (a, b)
    assert sorted(["1.0", "1.0+b1", "1.0a", "1.0~rc1", "1.0-2"], key=functools.cmp_to_key(plain_dpkg)) == ["1.0~rc1", "1.0", "1.0-2", "1.0a", "1.0+b1"]


def test_orders_of_other_families(spark):
    order = {
        "Debian:12": ["1.0~rc1", "1.0", "1.0a", "1.0rc1", "1.0+b1"], "Ubuntu:22.04": ["1.0~", "1.0", "1.0b1"], "PyPI": ["1.0a1", "1.0rc1", "1.0", "1.0.1"], "Maven": ["1.0-alpha", "1.0-rc1", "1.0", "1.0-xyz"],
        "Red Hat:9": ["1.0~rc1", "1.0", "1.0a", "1.0rc1", "1.0.0", "1.0.1"], "Alpine:v3.19": ["1.0_alpha1", "1.0_rc1", "1.0", "1.0a", "1.0_p1"],
    }
    for ecosystem, versions in order.items():
        df = spark.createDataFrame([(v,) for v in reversed(versions)], "v string").orderBy(version_key(F.col("v"), F.lit(ecosystem)))
        assert [r.v for r in df.collect()] == versions, ecosystem


def tree(root):
    (root / "lib").mkdir(parents=True)
    (root / "lib/a.py").write_text('password = "abcdefgh1"\n')
    (root / "b.py").write_text("h = md5(x)\n")
    (root / "requirements.txt").write_text("requests==2.0\nmade-up==1\n")


def test_relative_roots_are_as_good_as_absolute_ones(spark, tmp_path, monkeypatch, capsys):
    tree(tmp_path / "r")
    (tmp_path / "adv.json").write_text(json.dumps({"id": "A-1", "name": "requests", "ecosystem": "PyPI", "versions": ["2.0"], "aliases": [], "summary": "s", "severity": [], "refs": [], "affected": []}))
    monkeypatch.chdir(tmp_path / "r")
    outs = []
    for root in (str(tmp_path / "r"), ".", "../r"):
        assert main(["scan", root, "--advisories", str(tmp_path / "adv.json"), "--output", str(tmp_path / "o.json")], spark) == 1
        outs.append(json.loads((tmp_path / "o.json").read_text())["findings"])
    assert outs[0] == outs[1] == outs[2] and sorted(f["file_path"] for f in outs[0]) == ["b.py", "lib/a.py", "requirements.txt"]
    assert main(["sbom", "."], spark) == 0 and "pkg:pypi/requests@2.0" in capsys.readouterr().out
    assert main(["sbom", ".", "--format", "spdx", "--output", str(tmp_path / "s.json")], spark) == 0 and len(json.loads((tmp_path / "s.json").read_text())["packages"]) == 2


def test_incremental_scan(spark, tmp_path):
    tree(tmp_path / "r")
    args = ["scan", str(tmp_path / "r"), "--no-secrets", "--incremental", "--cache-path", str(tmp_path / "c.json"), "--output", str(tmp_path / "o.json")]
    found = lambda: [f["file_path"] for f in json.loads((tmp_path / "o.json").read_text())["findings"]]
    assert main(args, spark) == 1 and sorted(found()) == ["b.py", "lib/a.py"]
    assert set(json.loads((tmp_path / "c.json").read_text())["hashes"]) >= {"b.py", "lib/a.py"}
    assert main(args, spark) == 0 and found() == []
    (tmp_path / "r/b.py").write_text("h = md5(y)\n")
    assert main(args, spark) == 1 and found() == ["b.py"]


def test_state_survives_any_path(spark, tmp_path):
    rows = [('a "quoted"\\path\n{k}', "1"), ("é/ü", "2"), ("", "3")]
    SRC.save_state(spark.createDataFrame(rows, "path string, sha256 string"), f"{tmp_path}/s.json")
    assert sorted(map(tuple, SRC.load_state(spark, f"{tmp_path}/s.json").collect())) == sorted(rows)


def test_registries_and_models(spark, tmp_path, monkeypatch):
    tree(tmp_path / "r")
    rows = [{"backend": "pypi", "ecosystem": "pypi", "name": n, "http_status": c} for n, c in (("requests", 200), ("made-up", 404))]
    (tmp_path / "reg.json").write_text("\n".join(map(json.dumps, rows)))
    base = ["scan", str(tmp_path / "r"), "--output", str(tmp_path / "o.json"), "--quiet", "--workers", "2"]
    assert main([*base, "--no-sast", "--no-secrets", "--package-intelligence", "--registry-responses", str(tmp_path / "reg.json")], spark) == 1
    got = json.loads((tmp_path / "o.json").read_text())["findings"]
    assert [(f["rule_id"], f["package_name"]) for f in got] == [("palisade.sca.unknown-package", "made-up")]
    (tmp_path / "own_model.py").write_text('def answers(prompts):\n    return ["VERDICT: TRUE_POSITIVE\\nCONFIDENCE: HIGH\\nEXPLANATION: because" for _ in prompts]\n')
    monkeypatch.syspath_prepend(str(tmp_path))
    spark.sparkContext.addPyFile(str(tmp_path / "own_model.py"))
    assert main([*base, "--ai-model", "own_model:answers", "--ai-triage", "--explain"], spark) == 1
    got = json.loads((tmp_path / "o.json").read_text())["findings"]
    assert {f["verdict"] for f in got} == {"TRUE_POSITIVE"} and {f["explanation"] for f in got} == {"because"}
    assert main([*base, "--ai-model", "no_such_module:f", "--ai-triage"], spark) == 2
    assert main([*base, "--package-registry-mode", "odd", "--package-intelligence", "--registry-responses", str(tmp_path / "reg.json")], spark) == 2
