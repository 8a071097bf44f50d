"""Reports: JSON, SARIF, annotations, the summary comment, SBOM documents. Rows are made by Spark; only documents of
bounded size are put together on the driver."""

from __future__ import annotations

import json
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions import scalar as S
from palisade.plans.postprocess import TYPES
from palisade.schema import FINDING, SEVERITIES


def display_order() -> list[Column]:
    """Most severe first, then by path; the rest makes it reproducible."""
    return [F.desc("severity"), F.asc("file_path"), F.asc("start_line"), F.asc("rule_id"), F.asc("fingerprint")]


def json_object() -> Column:
    """A finding as JSON, without empty fields."""
    fields = []
    for name, (kind, _) in FINDING.items():
        c = F.col(name)
        if name == "severity":
            c = S.severity_label(c)
        elif kind == "string":
            c = S.nonempty(c)
        elif kind in ("int", "double"):
            c = F.nullif(c, F.lit(0).cast(kind))
        elif kind.startswith("array"):
            c = F.when(F.size(c) > 0, c)
        fields.append(c.alias(name))
    return F.to_json(F.struct(*fields))


def json_rows(findings: DataFrame) -> DataFrame:
    """A JSON object for each finding."""
    return findings.select("fingerprint", json_object().alias("json"))


def envelope(findings: DataFrame, inline: int = 0, baseline: int = 0, seconds: float = 0.0) -> dict:
    """What stands around the findings of a JSON report: totals, types, suppressed ones, seconds; "findings" is left to be
    streamed from json_rows() in its place."""
    s = summary(findings).first()
    out = {"total_findings": s.total, "scan_types": list(s["types"] or []), "duration_seconds": round(seconds, 3)}
    return out | ({"suppressed": inline + baseline, "suppressed_inline": inline, "suppressed_baseline": baseline} if inline + baseline else {})


def json_document(findings: DataFrame, head: dict):
    """Lines of an indented JSON report: the envelope with its findings, which stream row by row in display order."""
    yield "{"
    for k, v in head.items():
        yield f"  {json.dumps(k)}: {json.dumps(v)},"
    yield '  "findings": ['
    last = None
    for r in json_rows(findings.orderBy(*display_order())).toLocalIterator():
        if last is not None:
            yield last + ","
        last = "\n".join("    " + x for x in json.dumps(json.loads(r.json), indent=2).split("\n"))
    if last is not None:
        yield last
    yield "  ]"
    yield "}"


def check_run(findings: DataFrame, most: int = 50) -> DataFrame:
    """One row: failure if there is any finding, else success; how many there are and how many are annotated."""
    n = findings.agg(F.count("*").alias("findings"), F.count(F.expr("CASE WHEN file_path <> '' AND start_line >= 1 THEN 1 END")).alias("_p"))
    return n.select(F.when(F.col("findings") > 0, "failure").otherwise("success").alias("conclusion"), "findings", F.least("_p", F.lit(most)).alias("annotated"))


def false_positive_boxes(findings: DataFrame, most: int = 30) -> DataFrame:
    """Lines with a box to mark a finding as false, for the first findings that have a fingerprint."""
    f = findings.where("fingerprint <> ''").orderBy(*display_order()).limit(most)
    place = F.when(F.col("file_path") != "", F.concat(F.lit(" in "), F.col("file_path"))).otherwise("")
    return f.select("fingerprint", F.concat(F.lit("- [ ] "), F.col("rule_id"), place, F.lit(" <!-- fp:"), F.substring("fingerprint", 1, 16), F.lit(" -->")).alias("line"))


def table_groups(findings: DataFrame) -> DataFrame:
    """Groups of the text table in their order: type, findings, and of each severity."""
    place = F.array_position(F.array(*[F.lit(t) for t in TYPES]), F.col("type"))
    by = [F.count(F.when(F.col("severity") == i, 1)).alias(name.lower()) for i, name in reversed(list(enumerate(SEVERITIES)))]
    return findings.groupBy("type").agg(F.count("*").alias("findings"), *by).orderBy(place, "type")


def sarif_rules(findings: DataFrame) -> DataFrame:
    """rule_id, name, title, tags of the first finding of each rule, in display order."""
    order = F.struct((-F.col("severity")).alias("s"), "file_path", "start_line", "fingerprint")
    g = findings.groupBy("rule_id").agg(F.min_by(F.struct("rule_name", "title", "tags"), order).alias("x"))
    return g.select("rule_id", F.col("x.rule_name").alias("name"), F.col("x.title").alias("title"), F.col("x.tags").alias("tags"))


def sarif_results(findings: DataFrame) -> DataFrame:
    start = F.greatest("start_line", F.lit(1))
    return findings.select(
        "rule_id", S.sarif_level(F.col("severity")).alias("level"), F.col("description").alias("message"), S.file_uri(F.col("file_path")).alias("uri"), start.alias("start_line"),
        F.when(F.col("end_line") >= start, F.col("end_line")).alias("end_line"), "fingerprint",
    )


def sarif(findings: DataFrame, tool: str = "palisade", version: str = "0") -> DataFrame:
    """One SARIF 2.1.0 document as JSON."""
    rules = sarif_rules(findings).agg(F.array_sort(F.collect_list(F.struct(F.col("rule_id").alias("id"), "name", F.struct(F.col("title").alias("text")).alias("shortDescription"), F.struct("tags").alias("properties")))).alias("rules"))
    r = sarif_results(findings)
    place = F.struct(F.struct(F.struct("uri").alias("artifactLocation"), F.struct(F.col("start_line").alias("startLine"), F.col("end_line").alias("endLine")).alias("region")).alias("physicalLocation"))
    one = F.struct(F.col("rule_id").alias("ruleId"), "level", F.struct(F.col("message").alias("text")).alias("message"), F.array(place).alias("locations"), F.create_map(F.lit("primary"), F.col("fingerprint")).alias("fingerprints"))
    results = r.agg(F.collect_list(one).alias("results"))
    run = F.struct(F.struct(F.struct(F.lit(tool).alias("name"), F.lit(version).alias("version"), "rules").alias("driver")).alias("tool"), "results")
    return rules.crossJoin(results).select(F.to_json(F.struct(F.lit("2.1.0").alias("version"), F.lit("https://json.schemastore.org/sarif-2.1.0.json").alias("$schema"), F.array(run).alias("runs"))).alias("json"))


def annotations(findings: DataFrame, most: int = 50) -> DataFrame:
    """What a check run shows: the first findings that have a place."""
    f = findings.where("file_path <> '' and start_line >= 1").orderBy(*display_order()).limit(most)
    message = F.when((F.col("description") != "") & (F.col("description") != F.col("title")), F.concat_ws("\n", "title", "description")).otherwise(F.col("title"))
    return f.select(F.col("file_path").alias("path"), "start_line", F.greatest("end_line", "start_line").alias("end_line"), S.annotation_level(F.col("severity")).alias("level"), message.alias("message"), "fingerprint")


def top(findings: DataFrame, most: int = 30) -> DataFrame:
    return findings.orderBy(*display_order()).limit(most)


def fix_suggestions(findings: DataFrame, most: int = 10) -> DataFrame:
    return findings.where("verdict = 'TRUE_POSITIVE' and (fix_suggestion <> '' or fix_code <> '')").orderBy(*display_order()).limit(most)


def summary(findings: DataFrame) -> DataFrame:
    """One row: total, whether any was triaged, types in display order."""
    types = F.filter(F.array(*[F.lit(t) for t in TYPES]), lambda t: F.array_contains("_types", t))
    return findings.agg(F.count("*").alias("total"), F.coalesce(F.bool_or(F.col("verdict") != ""), F.lit(False)).alias("triaged"), F.collect_set("type").alias("_types")).select("total", "triaged", types.alias("types"))


def exit_status(findings: DataFrame, missing: DataFrame) -> DataFrame:
    """0 if there is neither a finding nor a missing required one, else 1."""
    return findings.agg(F.count("*").alias("findings")).crossJoin(missing.agg(F.count("*").alias("missing"))).withColumn("status", F.when((F.col("findings") > 0) | (F.col("missing") > 0), 1).otherwise(0))


def comment(findings: DataFrame, marker: str = "<!-- palisade -->") -> str:
    """A Markdown summary of at most 30 findings and 10 fixes."""
    n = {r.label: r.n for r in _counts(findings)}
    lines = [marker, "## Findings", "", ", ".join(f"{label}: {k}" for label, k in n.items()) or "None.", ""]
    rows = top(findings).collect()  # 30 at most
    if rows:
        lines += ["| severity | rule | place |", "| --- | --- | --- |", *(f"| {r.severity} | {r.rule_id} | {r.file_path}:{r.start_line} |" for r in rows)]
    fixes = fix_suggestions(findings).collect()  # 10 at most
    lines += [f"\n**{r.rule_id}**: {r.fix_suggestion or r.fix_code}" for r in fixes]
    return "\n".join(lines)


def _counts(findings: DataFrame):
    from palisade.plans.postprocess import counts_by_severity

    return counts_by_severity(findings, zeros=False).orderBy(F.desc("severity")).collect()  # five at most


def by_type_layout(findings: DataFrame) -> DataFrame:
    """What the text table shows of each finding: type, severity, subject, detail, place."""
    place = F.when(F.col("start_line") > 0, F.concat_ws(":", "file_path", F.col("start_line").cast("string"))).otherwise(F.col("file_path"))
    patch = F.coalesce(S.nonempty(F.col("fixed_version")), F.lit("no patch"))
    package = F.concat_ws("@", "package_name", "package_version")
    layer = F.when(F.col("layer_index") > 0, F.concat(F.lit("#"), F.col("layer_index").cast("string"))).otherwise("n/a")
    t = F.col("type")
    return findings.select(
        "type", S.severity_label(F.col("severity")).alias("severity"), S.choose([(t.isin("sca", "container"), package)], F.col("rule_name")).alias("subject"),
        S.choose([(t == "sca", patch), (t == "container", F.concat_ws(" ", layer, patch)), (t == "secrets", F.col("redacted"))], S.inline_text(F.col("title"))).alias("detail"), place.alias("place"), "fingerprint",
    )


# software bills of materials


def components(packages: DataFrame) -> DataFrame:
    """Distinct packages with their URLs."""
    p = packages.select("name", "version", "ecosystem").dropDuplicates(["name", "version", "ecosystem"])
    return p.withColumn("purl", S.purl(F.col("name"), F.col("version"), F.col("ecosystem")))


def cyclonedx(packages: DataFrame, serial: str = "", timestamp: str = "") -> DataFrame:
    split = S.group_and_name(F.col("name"))
    c = components(packages).select(F.struct(F.lit("library").alias("type"), S.nonempty(split["group"]).alias("group"), split["name"].alias("name"), "version", "purl").alias("c"))
    g = c.agg(F.array_sort(F.collect_list("c")).alias("components"))
    return g.select(F.to_json(F.struct(F.lit("CycloneDX").alias("bomFormat"), F.lit("1.5").alias("specVersion"), F.lit(serial).alias("serialNumber"), F.lit(1).alias("version"), F.struct(F.lit(timestamp).alias("timestamp")).alias("metadata"), "components")).alias("json"))


def spdx_packages(packages: DataFrame) -> DataFrame:
    c = components(packages)
    return c.select(F.concat(F.lit("SPDXRef-Package-"), S.spdx_id(F.col("name"), F.col("version"))).alias("spdx_id"), "name", F.col("version").alias("version_info"), "purl")


def spdx(packages: DataFrame, name: str = "sbom", created: str = "") -> DataFrame:
    """An SPDX 2.3 document; it describes each package."""
    p = spdx_packages(packages)
    ref = F.struct(F.lit("PACKAGE-MANAGER").alias("referenceCategory"), F.lit("purl").alias("referenceType"), F.col("purl").alias("referenceLocator"))
    one = F.struct(F.col("spdx_id").alias("SPDXID"), "name", F.col("version_info").alias("versionInfo"), F.lit("NOASSERTION").alias("downloadLocation"), F.array(ref).alias("externalRefs"))
    edge = F.struct(F.lit("SPDXRef-DOCUMENT").alias("spdxElementId"), F.lit("DESCRIBES").alias("relationshipType"), F.col("spdx_id").alias("relatedSpdxElement"))
    g = p.agg(F.sort_array(F.collect_list(one)).alias("packages"), F.sort_array(F.collect_list(edge)).alias("relationships"))
    head = [F.lit("SPDX-2.3").alias("spdxVersion"), F.lit("CC0-1.0").alias("dataLicense"), F.lit("SPDXRef-DOCUMENT").alias("SPDXID"), F.lit(name).alias("name"), F.struct(F.lit(created).alias("created")).alias("creationInfo")]
    return g.select(F.to_json(F.struct(*head, "packages", "relationships")).alias("json"))


# documents of any size, an item a row


class Document(NamedTuple):
    """What stands around the sections of a document, and their items (section, json), sorted."""

    frame: list[str]
    items: DataFrame


def _sorted(*sections: tuple[DataFrame, list[Column]]) -> DataFrame:
    """Rows (json) of each section in its order. The orders have as many columns of the same types or are filled up."""
    most = max(len(order) for _, order in sections)
    parts = []
    for i, (df, order) in enumerate(sections):
        keys = [c.alias(f"_k{j}") for j, c in enumerate([*order, *[F.lit(None).cast("string")] * (most - len(order))])]
        parts.append(df.select(F.lit(i).alias("section"), *keys, "json"))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.orderBy("section", *[f"_k{j}" for j in range(most)]).select("section", "json")


def _place() -> list[Column]:
    """display_order() as columns that ascend."""
    return [(4 - F.col("severity")).cast("int"), F.col("file_path"), F.col("start_line").cast("int"), F.col("rule_id"), F.col("fingerprint")]


def sarif_document(findings: DataFrame, tool: str = "palisade", version: str = "0") -> Document:
    """SARIF 2.1.0: each rule as its first finding has it, in order of those, and the results in display order."""
    start = F.greatest("start_line", F.lit(1))
    region = F.struct(start.alias("startLine"), F.when(F.col("end_line") >= start, F.col("end_line")).alias("endLine"), F.nullif("start_column", F.lit(0)).alias("startColumn"), F.nullif("end_column", F.lit(0)).alias("endColumn"))
    place = F.struct(F.struct(F.struct(S.file_uri(F.col("file_path")).alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    text = lambda c: F.struct(F.col(c).alias("text"))
    result = F.to_json(F.struct(F.col("rule_id").alias("ruleId"), S.sarif_level(F.col("severity")).alias("level"), text("description").alias("message"), F.array(place).alias("locations"), F.struct(F.col("fingerprint").alias("primary")).alias("fingerprints")))
    key = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(_place())])
    rules = findings.groupBy("rule_id").agg(F.min_by(F.struct("rule_name", "title", "tags"), key).alias("x"), F.min(key).alias("k"))
    rule = F.to_json(F.struct(F.col("rule_id").alias("id"), F.col("x.rule_name").alias("name"), F.struct(F.col("x.title").alias("text")).alias("shortDescription"), F.when(F.size("x.tags") > 0, F.struct(F.col("x.tags").alias("tags"))).alias("properties")))
    items = _sorted((rules.withColumn("json", rule), [F.col(f"k.k{i}") for i in range(5)]), (findings.withColumn("json", result), _place()))
    head = json.dumps({"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0"})[:-1]
    driver = json.dumps({"name": tool, "version": version})[:-1]
    return Document([f'{head}, "runs": [{{"tool": {{"driver": {driver}, "rules": [\n', '\n]}}, "results": [\n', "\n]}]}\n"], items)


def json_report(findings: DataFrame, inline: int = 0, baseline: int = 0, seconds: float = 0.0) -> Document:
    """The envelope around all findings in display order."""
    head = json.dumps(envelope(findings, inline, baseline, seconds))[:-1]
    rows = findings.select(*[c.alias(f"_p{i}") for i, c in enumerate(_place())], json_object().alias("json"))
    return Document([f'{head}, "findings": [\n', "\n]}\n"], _sorted((rows, [F.col(f"_p{i}") for i in range(5)])))


def cyclonedx_document(packages: DataFrame, serial: str = "", timestamp: str = "") -> Document:
    split = S.group_and_name(F.col("name"))
    one = F.to_json(F.struct(F.lit("library").alias("type"), S.nonempty(split["group"]).alias("group"), split["name"].alias("name"), "version", "purl"))
    head = {"bomFormat": "CycloneDX", "specVersion": "1.5"} | ({"serialNumber": serial} if serial else {}) | {"version": 1, "metadata": {"timestamp": timestamp}}
    return Document([json.dumps(head)[:-1] + ', "components": [\n', "\n]}\n"], _sorted((components(packages).withColumn("json", one), [F.col("purl"), F.col("name"), F.col("ecosystem")])))


def spdx_document(packages: DataFrame, name: str = "sbom", created: str = "") -> Document:
    """SPDX 2.3: the packages and that the document describes each."""
    p = spdx_packages(packages)
    ref = F.struct(F.lit("PACKAGE-MANAGER").alias("referenceCategory"), F.lit("purl").alias("referenceType"), F.col("purl").alias("referenceLocator"))
    one = F.struct(F.col("spdx_id").alias("SPDXID"), "name", F.col("version_info").alias("versionInfo"), F.lit("NOASSERTION").alias("downloadLocation"), F.array(ref).alias("externalRefs"))
    edge = F.struct(F.lit("SPDXRef-DOCUMENT").alias("spdxElementId"), F.lit("DESCRIBES").alias("relationshipType"), F.col("spdx_id").alias("relatedSpdxElement"))
    head = {"spdxVersion": "SPDX-2.3", "dataLicense": "CC0-1.0", "SPDXID": "SPDXRef-DOCUMENT", "name": name, "creationInfo": {"created": created}}
    order = [F.col("spdx_id"), F.col("purl")]
    return Document([json.dumps(head)[:-1] + ', "packages": [\n', '\n], "relationships": [\n', "\n]}\n"], _sorted((p.withColumn("json", F.to_json(one)), order), (p.withColumn("json", F.to_json(edge)), order)))


DOCUMENTS = {"json": json_report, "sarif": sarif_document, "cyclonedx": cyclonedx_document, "spdx": spdx_document}


def save(name: str, df: DataFrame, path: str, /, **info) -> None:
    """Write the document of that name over findings or packages as one file, by all executors. df is read more than
    once: give a table, or something that is written or cached."""
    from palisade.sinks.document import write_document

    if name not in DOCUMENTS:
        raise ValueError(f"unknown document {name!r}; there are {', '.join(DOCUMENTS)}")
    made = DOCUMENTS[name](df, **info)
    write_document(made.items, path, made.frame)


FORMATS = {"json": json_rows, "sarif": sarif, "table": by_type_layout, "cyclonedx": cyclonedx, "spdx": spdx}


def render(name: str, df: DataFrame) -> DataFrame:
    """The report or document of that name."""
    if name not in FORMATS:
        raise ValueError(f"unknown format {name!r}; there are {', '.join(FORMATS)}")
    return FORMATS[name](df)
