"""Documents that many tasks write."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from palisade.plans import postprocess as P
from palisade.plans import report
from palisade.schema import as_findings
from palisade.sinks.document import write_document
from palisade.sinks.folders import file_system, shared_folder


def findings(spark, n, parts=7):
    f = spark.range(0, n, 1, parts)
    return P.with_fingerprints(as_findings(
        f, type="sast", rule_id=F.concat(F.lit("r."), (F.col("id") % 23).cast("string")), rule_name=F.concat(F.lit('rule "'), (F.col("id") % 23).cast("string"), F.lit('"')), severity=(F.col("id") % 5).cast("int"),
        title=F.lit("a\ttitle, é "), description=F.concat(F.lit("about "), F.col("id").cast("string")), file_path=F.concat(F.lit("/src/f"), (F.col("id") % 97).cast("string")), start_line=(F.col("id") % 400).cast("int"), end_line=(F.col("id") % 300).cast("int"),
        start_column=(F.col("id") % 3).cast("int"), tags=F.when(F.col("id") % 23 > 2, F.array(F.lit("t"))),
    ))


def test_sarif_is_one_valid_document_in_display_order(spark, tmp_path):
    f = findings(spark, 40_000)
    path = f"{tmp_path}/out/report.sarif"
    report.save("sarif", f, path, version="3")
    lines = Path(path).read_text().split("\n")
    assert max(map(len, lines)) < 1 << 20 and [p.name for p in Path(path).parent.iterdir()] == ["report.sarif"]
    run = json.loads("\n".join(lines))["runs"][0]
    want = f.orderBy(*report.display_order()).collect()
    assert [x["fingerprints"]["primary"] for x in run["results"]] == [r.fingerprint for r in want]
    first = {}
    for r in want:
        first.setdefault(r.rule_id, r)
    assert [x["id"] for x in run["tool"]["driver"]["rules"]] == list(first)
    assert [x.get("properties", {}).get("tags", []) for x in run["tool"]["driver"]["rules"]] == [r.tags for r in first.values()]
    for x, r in list(zip(run["results"], want, strict=True))[::997]:
        region = {"startLine": max(1, r.start_line)} | ({"endLine": r.end_line} if r.end_line >= max(1, r.start_line) else {}) | ({"startColumn": r.start_column} if r.start_column else {})
        assert x["message"]["text"] == r.description and x["locations"][0]["physicalLocation"] == {"artifactLocation": {"uri": f"file://{r.file_path}"}, "region": region}
    assert run["tool"]["driver"]["version"] == "3"


@pytest.mark.parametrize("n", [0, 1, 300])
def test_reports_and_bills_of_materials(spark, tmp_path, n):
    f = findings(spark, n)
    report.save("json", f, f"{tmp_path}/r.json", inline=2, baseline=1)
    got = json.loads((tmp_path / "r.json").read_text())
    assert got["total_findings"] == len(got["findings"]) == n and got["suppressed"] == 3
    assert got == json.loads("\n".join(report.json_document(f, report.envelope(f, 2, 1))))
    report.save("sarif", f, f"{tmp_path}/r.sarif")
    assert len(json.loads((tmp_path / "r.sarif").read_text())["runs"][0]["results"]) == n
    packages = spark.createDataFrame([(f"@o/p{i % 50}", str(i % 3), "npm") for i in range(n)], "name string, version string, ecosystem string")
    report.save("cyclonedx", packages, f"{tmp_path}/c.json", serial="urn:x", timestamp="t")
    report.save("spdx", packages, f"{tmp_path}/s.json", name="n")
    c, s = (json.loads((tmp_path / x).read_text()) for x in ("c.json", "s.json"))
    k = packages.distinct().count()
    assert len(c["components"]) == len(s["packages"]) == len(s["relationships"]) == k and c["serialNumber"] == "urn:x" and s["name"] == "n"
    if n:
        old = json.loads(report.spdx(packages, "n").first().json)
        assert s == old and c["components"] == sorted(json.loads(report.cyclonedx(packages).first().json)["components"], key=lambda x: x["purl"])
    with pytest.raises(ValueError, match="unknown document"):
        report.save("pdf", f, f"{tmp_path}/x")


def test_a_failed_write_leaves_the_old_document(spark, tmp_path):
    path = f"{tmp_path}/d.json"
    rows = spark.range(0, 1000, 1, 5).select(F.lit(0).alias("section"), F.col("id").cast("string").alias("json"))
    write_document(rows, path, ["[\n", "\n]\n"])
    assert json.loads(Path(path).read_text()) == list(range(1000))
    broken = rows.withColumn("json", F.when(F.col("json") == "900", F.raise_error(F.lit("lost"))).otherwise(F.col("json")))
    with pytest.raises(Exception, match="lost"):
        write_document(broken, path, ["[\n", "\n]\n"])
    with pytest.raises(Exception, match="section 2"):
        write_document(rows.withColumn("section", F.lit(2)), path, ["[\n", "\n]\n"])
    assert json.loads(Path(path).read_text()) == list(range(1000)) and [p.name for p in tmp_path.iterdir()] == ["d.json"]
    write_document(rows.limit(3), path, ["[\n", "\n]\n"])
    assert json.loads(Path(path).read_text()) == [0, 1, 2]


def test_sections_stand_in_the_frame_in_order(spark, tmp_path):
    rows = spark.range(0, 30, 1, 4).select((F.col("id") % 3).cast("int").alias("section"), F.col("id").cast("string").alias("json")).where("section <> 1").orderBy("section", F.col("json").cast("int"))
    write_document(rows, f"file://{tmp_path}/s.json", ['{"a": [', '], "b": [', '], "c": [', "]}"])
    assert json.loads((tmp_path / "s.json").read_text()) == {"a": list(range(0, 30, 3)), "b": [], "c": list(range(2, 30, 3))}
    with pytest.raises(Exception, match="section and json"):
        spark.range(1).write.format("palisade_document").option("path", "/x").option("frame", "[]").mode("overwrite").save()


def test_folders(spark):
    assert shared_folder(spark, "a") != shared_folder(spark, "a")
    assert file_system("/x/y")[1] == file_system("file:/x/y")[1] == file_system("file:///x/y")[1] == "/x/y"
