"""Queries of sinks: documents and tables that are written and read back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palisade.operators.reach import breadth_first
from palisade.plans import report
from palisade.queries import _DESCRIBED, _LABEL, all_findings, query
from palisade.sinks.folders import shared_folder
from palisade.sinks.keyed_table import KeyedTable, comment_upserts


def _lines(s: SparkSession, path: str) -> DataFrame:
    """Lines of a document without the commas between them."""
    return s.read.text(path).select(F.regexp_replace("value", ",$", "").alias("line"))


def _written(s: SparkSession, name: str, df: DataFrame, **info) -> DataFrame:
    path = f"{shared_folder(s, 'documents')}/{name}.json"
    kept = df.persist()
    try:
        report.save(name, kept, path, **info)
    finally:
        kept.unpersist()
    return _lines(s, path)


_ORDER = "ORDER BY severity DESC, file_path, start_line, rule_id, fingerprint"


@query("sarif_file", _DESCRIBED + f"""SELECT '{{"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [{{"tool": {{"driver": {{"name": "palisade", "version": "1", "rules": [' AS line
UNION ALL SELECT '{{"id":"' || rule_id || '","name":' || to_json(rule_name) || ',"shortDescription":{{"text":' || to_json(title) || '}},"properties":{{"tags":' || to_json(tags) || '}}}}' FROM (SELECT * FROM described QUALIFY row_number() OVER (PARTITION BY rule_id {_ORDER}) = 1)
UNION ALL SELECT ']}}}}, "results": ['
UNION ALL SELECT '{{"ruleId":"' || rule_id || '","level":"' || CASE WHEN severity >= 3 THEN 'error' WHEN severity = 2 THEN 'warning' ELSE 'note' END || '","message":{{"text":' || to_json(description) || '}},"locations":[{{"physicalLocation":{{"artifactLocation":{{"uri":"' || file_path || '"}},"region":{{"startLine":' || start_line || '}}}}}}],"fingerprints":{{"primary":"' || fingerprint || '"}}}}' FROM described
UNION ALL SELECT ']}}]}}'""")
def _(s, d):
    return _written(s, "sarif", all_findings(s, d), version="1")


@query("json_file", _DESCRIBED + f"""SELECT '{{"total_findings": ' || count(*) || ', "scan_types": [' || coalesce((SELECT string_agg('"' || type || '"', ', ' ORDER BY CASE type WHEN 'sast' THEN 3 ELSE 6 END) FROM (SELECT DISTINCT type FROM findings)), '') || '], "duration_seconds": 0.0, "findings": [' AS line FROM findings
UNION ALL SELECT '{{"type":"' || type || '","rule_id":"' || rule_id || '","rule_name":' || to_json(rule_name) || ',"severity":"' || {_LABEL} || '","priority_score":' || priority_score || ',"title":' || to_json(title) || ',"description":' || to_json(description) || ',"file_path":"' || file_path || '","start_line":' || start_line || CASE type WHEN 'sast' THEN ',"cwe":["' || cwe || '"]' ELSE '' END || ',"tags":' || to_json(tags) || ',"fingerprint":"' || fingerprint || '"}}' FROM described
UNION ALL SELECT ']}}'""")
def _(s, d):
    return _written(s, "json", all_findings(s, d))


# parts as packages: their brand is the ecosystem, their size the version

_BOM = "WITH p AS (SELECT DISTINCT p_type || '/' || p_name AS name, CAST(p_size AS VARCHAR) AS version, CASE p_brand WHEN 'Brand#1' THEN 'PyPI' WHEN 'Brand#2' THEN 'npm' ELSE 'Maven' END AS ecosystem FROM part), c AS (SELECT *, 'pkg:' || CASE ecosystem WHEN 'PyPI' THEN 'pypi' WHEN 'npm' THEN 'npm' ELSE 'maven' END || '/' || name || '@' || version AS purl, 'SPDXRef-Package-' || left(regexp_replace(name, '[^A-Za-z0-9.-]', '-', 'g'), 40) || '-' || left(sha256(name || '@' || version), 8) AS spdx_id FROM p) "


def _parts(s: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("p_brand") == "Brand#1", "PyPI").when(F.col("p_brand") == "Brand#2", "npm").otherwise("Maven")
    return s.read.parquet(f"{d}/part.parquet").select(F.concat_ws("/", "p_type", "p_name").alias("name"), F.col("p_size").cast("string").alias("version"), kind.alias("ecosystem"))


@query("cyclonedx_file", _BOM + """SELECT '{"bomFormat": "CycloneDX", "specVersion": "1.5", "version": 1, "metadata": {"timestamp": ""}, "components": [' AS line
UNION ALL SELECT '{"type":"library","group":"' || string_split(name, '/')[1] || '","name":"' || string_split(name, '/')[2] || '","version":"' || version || '","purl":"' || purl || '"}' FROM c
UNION ALL SELECT ']}'""")
def _(s, d):
    return _written(s, "cyclonedx", _parts(s, d))


@query("spdx_file", _BOM + """SELECT '{"spdxVersion": "SPDX-2.3", "dataLicense": "CC0-1.0", "SPDXID": "SPDXRef-DOCUMENT", "name": "sbom", "creationInfo": {"created": ""}, "packages": [' AS line
UNION ALL SELECT '{"SPDXID":"' || spdx_id || '","name":"' || name || '","versionInfo":"' || version || '","downloadLocation":"NOASSERTION","externalRefs":[{"referenceCategory":"PACKAGE-MANAGER","referenceType":"purl","referenceLocator":"' || purl || '"}]}' FROM c
UNION ALL SELECT '], "relationships": ['
UNION ALL SELECT '{"spdxElementId":"SPDXRef-DOCUMENT","relationshipType":"DESCRIBES","relatedSpdxElement":"' || spdx_id || '"}' FROM c
UNION ALL SELECT ']}'""")
def _(s, d):
    return _written(s, "spdx", _parts(s, d))


# the state of a scan as a table by path: four scans, each with one changed document of a hundred

_SCANS = 4


def _hashes(s: SparkSession, d: str, scan: int) -> DataFrame:
    """Paths and hashes at a scan: a hundredth of the documents has changed, some of them are new."""
    docs = s.read.parquet(f"{d}/documents.parquet")
    own = docs.where(F.col("doc_id") % 100 == scan) if scan else docs.where(F.col("doc_id") % 200 != 1)
    text = F.concat(F.coalesce("text", F.lit("")), F.lit(f" {scan}") if scan else F.lit(""))
    return own.select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.sha2(text, 256).alias("sha256"), F.lit(scan).alias("scan"))


_STATE = """WITH v AS (SELECT source || '/' || CAST(doc_id AS VARCHAR) AS path, sha256(coalesce(text, '') || CASE scan WHEN 0 THEN '' ELSE ' ' || CAST(scan AS VARCHAR) END) AS sha256, CAST(scan AS INT) AS scan
  FROM documents, range(4) t(scan) WHERE CASE scan WHEN 0 THEN doc_id % 200 <> 1 ELSE doc_id % 100 = scan END),
state AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY path ORDER BY scan DESC, sha256 DESC) = 1)
"""


def _state(s: SparkSession, d: str) -> KeyedTable:
    table = KeyedTable(s, shared_folder(s, "state"))
    table.create(_hashes(s, d, 0), ["path"])
    for scan in range(1, _SCANS):
        table.upsert(_hashes(s, d, scan))
    return table


@query("state_upsert", _STATE + "SELECT path, sha256, scan FROM state")
def _(s, d):
    return _state(s, d).read()


@query("state_versions", "SELECT CAST(scan + 1 AS INT) AS version, (SELECT count(DISTINCT doc_id) FROM documents WHERE doc_id % 200 <> 1 OR (doc_id % 100 = 1 AND scan >= 1)) AS rows FROM range(4) t(scan)")
def _(s, d):
    table = _state(s, d)
    counts = [table.read(n).agg(F.lit(n).alias("version"), F.count("*").alias("rows")) for n in table.versions()]
    return reduce(DataFrame.unionByName, counts)


# turns of conversations as comments, and a summary for each conversation


@query("comment_upsert", "SELECT conv_id AS place, min(turn) FILTER (contains(text, 'the')) AS id, CASE WHEN count(*) FILTER (contains(text, 'the')) > 0 THEN 'edit' ELSE 'create' END AS action, '<!-- the --> ' || CAST(count(*) AS VARCHAR) || ' turns' AS body FROM conversations GROUP BY conv_id")
def _(s, d):
    turns = s.read.parquet(f"{d}/conversations.parquet")
    wanted = turns.groupBy(F.col("conv_id").alias("place")).agg(F.concat(F.lit("<!-- the --> "), F.count("*").cast("string"), F.lit(" turns")).alias("body"))
    return comment_upserts(turns.select(F.col("conv_id").alias("place"), F.col("turn").alias("id"), F.col("text").alias("body")), wanted, "the")


# links between pages: two that follow each other among those with a link in common


@query("link_graph", r"""WITH RECURSIVE l AS (SELECT DISTINCT url, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS h FROM pages),
e AS (SELECT DISTINCT path, target FROM (SELECT url AS path, lead(url) OVER (PARTITION BY h ORDER BY url) AS target FROM l) WHERE target IS NOT NULL),
r AS (SELECT DISTINCT url AS start, url AS path, 0 AS depth FROM pages WHERE page_id % 20 = 0 UNION SELECT start, target, depth + 1 FROM r JOIN e USING (path) WHERE depth < 5)
SELECT start, path, min(depth) AS depth FROM r WHERE depth > 0 GROUP BY start, path""")
def _(s, d):
    pages = s.read.parquet(f"{d}/pages.parquet")
    links = pages.select("url", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("h")).distinct()
    edges = links.select(F.col("url").alias("path"), F.lead("url").over(Window.partitionBy("h").orderBy("url")).alias("target"))
    return breadth_first(edges, pages.where("page_id % 20 = 0").select(F.col("url").alias("primary")), 5).withColumnRenamed("primary", "start")
