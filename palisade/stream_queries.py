"""Queries of streams: tables as streams in several batches, and the same in DuckDB SQL."""

from __future__ import annotations

from pyarrow.fs import FileSelector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.operators import rules
from palisade.queries import _WITH, query
from palisade.sinks.folders import file_system, shared_folder
from palisade.streaming import state

BATCHES = 5


def _in_parts(s: SparkSession, parts: list[DataFrame]) -> tuple[str, int]:
    """Parts written one after the other to one folder, which a stream reads in that order; and files that make about
    BATCHES batches."""
    folder = f"{shared_folder(s, 'stream')}/source"
    for p in parts:
        p.write.mode("append").option("compression", "zstd").parquet(folder)
    system, root = file_system(folder)
    n = sum(f.base_name.endswith(".parquet") for f in system.get_file_info(FileSelector(root)))
    return folder, max(1, -(-n // BATCHES))


def _stream(s: SparkSession, folder: str, schema, files: int) -> DataFrame:
    return s.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


# documents in five revisions: each has two thirds of them, some with a line more


def _revisions(s: SparkSession, d: str) -> list[DataFrame]:
    docs = s.read.parquet(f"{d}/documents.parquet")
    out = []
    for r in range(BATCHES):
        text = F.when(F.col("doc_id") % 7 == r, F.concat(F.coalesce("text", F.lit("")), F.lit('\npassword = "revision-of-five"'))).otherwise(F.col("text"))
        out.append(docs.where((F.col("doc_id") + r) % 3 != 0).select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), text.alias("text"), F.lit(r).alias("revision")))
    return out


_REVISIONS = _WITH + """, revision AS (SELECT source || '/' || CAST(doc_id AS VARCHAR) AS path, r AS revision, CASE WHEN doc_id % 7 = r THEN coalesce(text, '') || chr(10) || 'password = "revision-of-five"' ELSE coalesce(text, '') END AS text
  FROM documents, range(5) t(r) WHERE (doc_id + r) % 3 <> 0),
hashed AS (SELECT path, CAST(revision AS BIGINT) AS revision, text, sha256(text) AS sha256 FROM revision),
changed AS (SELECT * FROM (SELECT *, lag(sha256) OVER (PARTITION BY path ORDER BY revision) AS old FROM hashed) WHERE sha256 IS DISTINCT FROM old)
"""


def _changed(s: SparkSession, d: str, text: bool) -> DataFrame:
    folder, files = _in_parts(s, _revisions(s, d))
    return state.changed_stream(_stream(s, folder, "path string, text string, revision int", files), "revision", text)


@query("incremental_stream", _REVISIONS + "SELECT path, revision, sha256 FROM changed")
def _(s, d):
    rows = state.drained(_changed(s, d, False), shared_folder(s, "incremental"))
    return s.read.schema("path string, revision long, sha256 string").parquet(rows)


@query("incremental_stream_findings", _REVISIONS + """SELECT revision, name, severity, count(*) AS n, count(DISTINCT path) AS files FROM (SELECT path, revision, unnest(string_split(text, chr(10))) AS line FROM changed) l JOIN rules ON regexp_matches(line, regex)
WHERE NOT regexp_matches(trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)), '^(//|#|\\*$|\\* )') GROUP BY ALL""")
def _(s, d):
    hits = rules.prefilter(_changed(s, d, True).select("path", "revision", "text")).select("path", "revision", "name", "severity")
    rows = state.drained(hits, shared_folder(s, "incremental"))
    found = s.read.schema("path string, revision long, name string, severity int").parquet(rows)
    return found.groupBy("revision", "name", "severity").agg(F.count("*").alias("n"), F.countDistinct("path").alias("files"))


# events as requests for slots, by their type

_HOLD = 90


def _requests(s: SparkSession, d: str) -> list[DataFrame]:
    """Events in fifths of their time, and a last row that moves the clock past all that can happen. Their time has no
    zone, so it is counted from 1970 as if in UTC."""
    time = F.timestamp_micros(F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01', ts)"))
    e = s.read.parquet(f"{d}/events.parquet").where("ts is not null").select(F.col("event_type").alias("key"), F.col("event_id").cast("string").alias("request"), time.alias("at"))
    ends = e.agg(F.min(F.unix_micros("at")).alias("low"), F.max(F.unix_micros("at")).alias("high"), F.count("*").alias("n")).first()
    low, high = ends.low or 0, ends.high or 0
    place = F.expr(f"(unix_micros(at) - {low}L) * {BATCHES} DIV {high - low + 1}L")
    clock = s.range(1).select(F.lit("clock").alias("key"), F.lit("").alias("request"), F.timestamp_micros(F.lit(high + (_HOLD + 1) * state.MINUTE * (ends.n + 1) + 7 * 24 * 60 * state.MINUTE)).alias("at"))
    return [*(e.where(place == i) for i in range(BATCHES)), clock]


@query("admission_stream", f"""WITH RECURSIVE e AS (SELECT event_type AS key, CAST(event_id AS VARCHAR) AS request, ts AS asked, row_number() OVER (PARTITION BY event_type ORDER BY ts, CAST(event_id AS VARCHAR)) AS i FROM events WHERE ts IS NOT NULL),
q AS (SELECT key, request, asked, i, asked AS admitted_at, [asked] AS starts FROM e WHERE i = 1
  UNION ALL SELECT key, request, asked, i, start, (starts || [start])[-4:] FROM (SELECT e.*, q.starts, CASE WHEN len(q.starts) < 4 THEN e.asked ELSE greatest(e.asked, q.starts[1] + INTERVAL {_HOLD} MINUTE) END AS start FROM q JOIN e ON e.key = q.key AND e.i = q.i + 1))
SELECT key, request, asked, admitted_at FROM q""")
def _(s, d):
    folder, files = _in_parts(s, _requests(s, d))
    made = state.admissions(_stream(s, folder, "key string, request string, at timestamp", files), 4, _HOLD, "7 days")
    rows = state.drained(made.where("key <> 'clock'"), shared_folder(s, "admission"))
    back = lambda c: F.expr(f"timestampadd(MICROSECOND, unix_micros({c}), TIMESTAMP_NTZ '1970-01-01')")
    return s.read.schema("key string, request string, at timestamp, admitted_at timestamp").parquet(rows).select("key", "request", back("at").alias("asked"), back("admitted_at").alias("admitted_at"))
