"""Queries of operators that take their rules and requirements from tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palisade.functions.versions import version_key
from palisade.operators import producers, rule_table, rules
from palisade.plans import postprocess as P
from palisade.queries import _WITH, CFG, Fixture, all_findings, files, query

# a rule for each long word of the benchmark: that word at the end of a clause


def _word_rules(s: SparkSession, d: str) -> DataFrame:
    word = F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{7,}"), F.lit(0))).alias("w")
    w = s.read.parquet(f"{d}/benchmark.parquet").select(word).select(F.lower("w").alias("w")).distinct()
    return w.select(F.concat(F.lit("word "), "w").alias("name"), F.lit("CWE-0").alias("cwe"), (F.length("w") % 5).cast("int").alias("severity"), F.substring("w", 1, 1).alias("category"), F.concat(F.lit("(?i)"), "w", F.lit("[a-z]*[.,;]")).alias("regex"))


_WORDS = _WITH + """, words AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-z]{7,}'))) AS w FROM benchmark),
low AS (SELECT *, lower(line) AS l FROM code WHERE NOT (starts_with(t, '//') OR starts_with(t, '#') OR t = '*' OR starts_with(t, '* '))),
word_hits AS (SELECT path, no, w FROM low JOIN words ON contains(l, w) WHERE regexp_matches(line, '(?i)' || w || '[a-z]*[.,;]'))
"""


@query("rules_from_table", _WORDS + "SELECT path, CAST(no AS INT) AS line, 'word ' || w AS name, CAST(len(w) % 5 AS INT) AS severity, left(w, 1) AS category FROM word_hits")
def _(s, d):
    return rule_table.prefilter_table(files(s, d), _word_rules(s, d)).select("path", "line", "name", "severity", "category")


@query("rules_from_table_by_category", _WORDS + "SELECT left(w, 1) AS category, count(*) AS n, count(DISTINCT w) AS rules, count(DISTINCT path) AS files FROM word_hits GROUP BY ALL")
def _(s, d):
    hits = rule_table.prefilter_table(files(s, d), _word_rules(s, d))
    return hits.groupBy("category").agg(F.count("*").alias("n"), F.countDistinct("name").alias("rules"), F.countDistinct("path").alias("files"))


@query("prefilter_in_spark", _WITH + "SELECT path, line, ordinal, name, cwe, severity, category FROM hits")
def _(s, d):
    return rules.prefilter(files(s, d)).select("path", "line", "ordinal", "name", "cwe", "severity", "category")


_SECRET_TABLE = [*rules.SECRET_RULES, ("assignment", r"""(?i)\b(token|secret|password)\s*[=:]\s*["'][^"']+["']""", 1), ("year", "([A-Za-z]+) (?:19|20)[0-9]{2}", 1), ("short", r"\b([a-z])\1[0-9]", 1)]
_SECRET_ROWS = Fixture("rule string, regex string", [(n, r) for n, r, _ in _SECRET_TABLE[:-1]])  # the last one has a back reference, which SQL's engine lacks


@query("secret_rules_from_table", _WITH + f", r AS (SELECT * FROM {_SECRET_ROWS.sql}) SELECT path, CAST(no AS INT) AS line, rule, unnest(regexp_extract_all(line, regex, 1)) AS secret FROM lines JOIN r ON regexp_matches(line, regex)")
def _(s, d):
    table = s.createDataFrame(_SECRET_TABLE[:-1], "name string, regex string, group int")
    return rule_table.secrets_table(files(s, d), table).select("path", "line", "rule", "secret")


# requirements of one rule for every document, by a part of its path, beside those of other rules


def _requirements(s: SparkSession, d: str) -> DataFrame:
    docs = s.read.parquet(f"{d}/documents.parquet").select("doc_id", "source")
    id_ = F.col("doc_id").cast("string")
    file = F.when(F.col("doc_id") % 3 == 0, F.concat_ws("/", "source", id_)).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("/"), id_)).otherwise(F.concat_ws("/", F.expr("substr(source, -2)"), F.substring(id_, 1, 2)))
    rule = F.when(F.col("doc_id") % 10 < 9, "palisade.prefilter.HARDCODED_secret").otherwise("palisade.license.denied")
    return docs.select(F.lit("").alias("fingerprint"), rule.alias("rule_id"), file.alias("file"), F.lit("").alias("reason")).distinct()


@query("required_by_path", _WITH + """, r AS (SELECT DISTINCT '' AS fingerprint, CASE WHEN doc_id % 10 < 9 THEN 'palisade.prefilter.HARDCODED_secret' ELSE 'palisade.license.denied' END AS rule_id,
  CASE doc_id % 3 WHEN 0 THEN source || '/' || CAST(doc_id AS VARCHAR) WHEN 1 THEN '/' || CAST(doc_id AS VARCHAR) ELSE right(source, 2) || '/' || left(CAST(doc_id AS VARCHAR), 2) END AS file FROM documents)
SELECT rule_id, file, rule_id || ' in ' || file AS description FROM r WHERE NOT EXISTS (SELECT 1 FROM findings f WHERE lower(f.rule_id) = lower(r.rule_id) AND contains(f.file_path, r.file))""")
def _(s, d):
    return P.missing_required(all_findings(s, d), _requirements(s, d)).select("rule_id", "file", "description")


# parts as packages of Debian, whose versions have epochs, tildes, builds and revisions

_TAILS = ["~rc1", "", "-2", "a", "+b1"]  # in their order
_VERSION = "CASE WHEN p_partkey % 11 = 0 THEN '1:' ELSE '' END || CAST(p_size AS {0}) || '.' || CAST(p_partkey % 7 AS {0}) || CASE p_partkey % 5 WHEN 0 THEN '-2' WHEN 1 THEN 'a' WHEN 2 THEN '' WHEN 3 THEN '~rc1' ELSE '+b1' END"
_TAIL = "CASE p_partkey % 5 WHEN 3 THEN 0 WHEN 2 THEN 1 WHEN 0 THEN 2 WHEN 1 THEN 3 ELSE 4 END"
_EPOCH = "CASE WHEN p_partkey % 11 = 0 THEN 1 ELSE 0 END"


@query("debian_versions", f"SELECT DISTINCT p_brand AS brand, {_VERSION.format('VARCHAR')} AS version, CAST(dense_rank() OVER (PARTITION BY p_brand ORDER BY {_EPOCH}, p_size, p_partkey % 7, {_TAIL}) AS INT) AS place FROM part")
def _(s, d):
    v = s.read.parquet(f"{d}/part.parquet").select(F.col("p_brand").alias("brand"), F.expr(_VERSION.format("STRING")).alias("version")).distinct()
    order = Window.partitionBy("brand").orderBy(version_key(F.col("version"), F.lit("Debian:12")))
    return v.withColumn("place", F.dense_rank().over(order))


@query("debian_matches", f"""WITH p AS (SELECT DISTINCT p_type || '/' || p_name AS name, {_VERSION.format('VARCHAR')} AS version, {_EPOCH} AS epoch, p_size AS a, p_partkey % 7 AS b, {_TAIL} AS tail FROM part),
n AS (SELECT DISTINCT name FROM p)
SELECT 'D-' || name AS advisory, name, version FROM p WHERE epoch = 0 AND a * 100 + b * 10 + tail < 2531 AND a * 100 + b * 10 + tail >= 500""")
def _(s, d):
    packages = s.read.parquet(f"{d}/part.parquet").select(F.concat_ws("/", "p_type", "p_name").alias("name"), F.expr(_VERSION.format("STRING")).alias("version"), F.lit("Debian:12").alias("ecosystem")).distinct()
    empty = F.array().cast("array<string>")
    events = F.array(F.struct(F.lit("5.0~rc1").alias("introduced"), F.lit("").alias("fixed")), F.struct(F.lit("").alias("introduced"), F.lit("25.3").alias("fixed")))
    ranged = F.array(F.struct(F.array(F.struct(events.alias("events"))).alias("ranges")))
    advisories = packages.select("name", "ecosystem").distinct().select(F.concat(F.lit("D-"), "name").alias("id"), "name", "ecosystem", empty.alias("versions"), ranged.alias("affected"))
    return producers.advisory_matches(packages, advisories).select("advisory", "name", "version")


# all producers of texts, secrets included, in one scan

_SECRET_FIXTURE = Fixture("rule string, regex string", [(n, r) for n, r, _ in rules.SECRET_RULES])
_EVERY = _WITH + f""", secret AS (SELECT path, no, rule, unnest(regexp_extract_all(line, regex, 1)) AS x FROM lines, (SELECT * FROM {_SECRET_FIXTURE.sql}) r),
every AS (SELECT type, rule_id, severity, file_path, CAST(start_line AS INT) AS start_line, title, '' AS redacted FROM (SELECT * FROM sast UNION ALL SELECT * FROM policy)
  UNION ALL SELECT 'secrets', rule, 3, path, CAST(no AS INT), 'Secret: ' || rule, CASE WHEN strlen(x) <= 8 THEN repeat('*', strlen(x)) ELSE left(x, 4) || '****' || right(x, 4) END FROM secret)
"""


@query("one_pass_findings", _EVERY + "SELECT * FROM every")
def _(s, d):
    return producers.text_findings(files(s, d), CFG).select("type", "rule_id", "severity", "file_path", "start_line", "title", "redacted")


@query("one_pass_by_rule", _EVERY + "SELECT type, rule_id, count(*) AS n, count(DISTINCT file_path) AS files FROM every GROUP BY ALL")
def _(s, d):
    return producers.text_findings(files(s, d), CFG).groupBy("type", "rule_id").agg(F.count("*").alias("n"), F.countDistinct("file_path").alias("files"))
