"""What happens to findings after they are produced, in this order: dedup, score, required check, severity filter, rule
filter, inline suppression, baseline suppression, triage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions import scalar as S
from palisade.schema import SEVERITIES, Config

# Scan types in order of display.
TYPES = ("secrets", "sca", "sast", "dockerfile", "container", "license")


def union(producers: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), producers)


def with_fingerprints(findings: DataFrame) -> DataFrame:
    return findings.withColumn("fingerprint", S.fingerprint())


def dedup(findings: DataFrame) -> DataFrame:
    """The first finding of each fingerprint, in order of type, path, line, rule and title: arrival order would not be
    reproducible."""
    place = F.coalesce(F.array_position(F.array(*[F.lit(t) for t in TYPES]), F.col("type")), F.lit(0))
    order = F.struct(place, "file_path", "start_line", "rule_id", "title", F.xxhash64(*[c for c in findings.columns if not c.startswith("time")]))
    # an aggregate: repeats go before rows are shuffled
    first = findings.groupBy("fingerprint").agg(F.min_by(F.struct(*findings.columns), order).alias("_first"))
    return first.select("_first.*")


def score(findings: DataFrame) -> DataFrame:
    return findings.withColumn("priority_score", S.priority(F.col("severity"), F.col("tags")))


#: Characters of the part of a path by which requirements look for findings.
GRAM = 6


def _parts(text: Column, n: Column) -> Column:
    """The n-grams of a text that is no shorter."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, n)))


def _probes(pairs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(_r, _p, _g): the parts of the paths of pairs (_r, _p) by which some requirement of their rule is looked for."""
    # a part has GRAM characters, or is all of a shorter name
    sizes = [r.n for r in wanted.select(F.length("_g").alias("n")).distinct().collect()]  # GRAM at most
    none = F.array().cast("array<string>")
    each = pairs.withColumn("_g", F.explode(F.array_distinct(F.flatten(F.array(none, *[F.when(F.length("_p") >= n, _parts(F.col("_p"), F.lit(n))).otherwise(none) for n in sizes])))))
    return each.join(wanted.select("_r", "_g").distinct(), ["_r", "_g"], "left_semi")


def contained(required: DataFrame, findings: DataFrame) -> DataFrame:
    """Distinct (_r, file) of required (_r, file) that some path of findings (_r, _p) of that rule contains.

    A containment is no equality, so it is looked for by an index of the paths' n-grams: of the parts of a file's name,
    the one that the fewest paths of the rule have. Only paths that have it are compared. A rule that all findings share
    is spread over its parts; parts of all requirements are counted, and only parts that some requirement has leave the
    paths, so the index is no larger than what is asked of it."""
    r, pairs = required.select("_r", "file").distinct(), findings.select("_r", "_p").distinct()
    whole = r.where("file = ''").join(pairs.select("_r").distinct(), "_r", "left_semi")
    parts = r.where("file <> ''").select("_r", "file", F.explode(_parts(F.col("file"), F.least(F.length("file"), F.lit(GRAM)))).alias("_g"))
    index = _probes(pairs, parts)
    counted = parts.select("_r", "_g").distinct().join(index.groupBy("_r", "_g").agg(F.count("*").alias("_n")), ["_r", "_g"], "left")
    # a part that no path has settles the matter: nothing is compared
    rarest = parts.join(counted, ["_r", "_g"]).groupBy("_r", "file").agg(F.min_by(F.struct("_g", "_n"), F.struct(F.coalesce("_n", F.lit(0)), "_g")).alias("_x")).where("_x._n IS NOT NULL").select("_r", "file", F.col("_x._g").alias("_g"))
    found = rarest.join(index, ["_r", "_g"]).where(F.contains("_p", F.col("file"))).select("_r", "file").distinct()
    return whole.unionByName(found)


def missing_required(findings: DataFrame, required: DataFrame) -> DataFrame:
    """required (fingerprint, rule_id, file, reason) that no finding meets, with their descriptions. One with a fingerprint
    is met by that finding, others by one of their rule, in whatever case, in a path that contains their file; one without
    a fingerprint and a rule is never met."""
    by_print = required.where("fingerprint <> ''").join(findings.select("fingerprint").distinct(), "fingerprint", "left_anti").select(*required.columns)
    r, f = required.where("fingerprint = ''").withColumn("_r", F.lower("rule_id")), findings.select(F.lower("rule_id").alias("_r"), F.col("file_path").alias("_p"))
    by_rule = r.join(contained(r.where("rule_id <> ''"), f), ["_r", "file"], "left_anti").select(*required.columns)
    text = S.choose([(F.col("reason") != "", F.col("reason")), (F.col("fingerprint") != "", F.concat(F.lit("fingerprint "), F.substring("fingerprint", 1, 8), F.lit("...")))], F.concat_ws(" in ", "rule_id", "file"))
    return by_print.unionByName(by_rule).withColumn("description", text)


def severe(findings: DataFrame, least: str) -> DataFrame:
    rank = SEVERITIES.index(least.strip().upper()) if least.strip().upper() in SEVERITIES else 0
    return findings.where(F.col("severity") >= rank) if rank else findings


def by_rule(findings: DataFrame, include: list[str], exclude: list[str]) -> DataFrame:
    out = findings.where(F.col("rule_id").isin(*include)) if include else findings
    return out.where(~F.col("rule_id").isin(*exclude)) if exclude else out


def markers(files: DataFrame, marker: str) -> DataFrame:
    """path, line, rule of each suppression marker, in whatever case; the rule is empty for one that suppresses all."""
    sign = F.lit(marker.lower())
    lines = files.where(F.contains(F.lower("text"), sign)).select("path", F.posexplode(S.lines_scanned(F.lower("text"))).alias("_pos", "_l")).where(F.contains("_l", sign))
    rest = S.strip(F.substring(F.col("_l"), F.instr(F.col("_l"), sign) + len(marker), F.lit(1 << 20)))
    return lines.select("path", (F.col("_pos") + 1).alias("line"), F.regexp_extract(rest, r"^(\S*)", 1).alias("rule"))


def inline_suppressed(findings: DataFrame, files: DataFrame, marker: str) -> DataFrame:
    """Fingerprints that a marker on their line or the one above suppresses."""
    m = markers(files, marker)
    reach = m.union(m.withColumn("line", F.col("line") + 1)).distinct()
    f = findings.where("file_path <> '' and start_line > 0").select("fingerprint", F.col("file_path").alias("path"), F.col("start_line").alias("line"), F.lower("rule_id").alias("_r"))
    return f.join(reach, ["path", "line"]).where("rule = '' or rule = _r").select("fingerprint").distinct()


def without(findings: DataFrame, suppressed: DataFrame) -> DataFrame:
    return findings.join(suppressed.select("fingerprint").where("fingerprint <> ''").distinct(), "fingerprint", "left_anti").select(*findings.columns)


def merge_triage(findings: DataFrame, answers: DataFrame) -> DataFrame:
    """findings with parsed answers (fingerprint, verdict, confidence, reason, explanation, recommendation, code_fix): a
    fix replaces an old one if it isn't empty or the old one is."""
    a = answers.select("fingerprint", *[F.col(c).alias(f"_{c}") for c in ("verdict", "confidence", "reason", "explanation", "recommendation", "code_fix")])
    j = findings.join(a, "fingerprint", "left")
    has = F.col("_verdict").isNotNull()
    keep = lambda old, new: F.when(has & ((F.col(new) != "") | (F.col(old) == "")), F.col(new)).otherwise(F.col(old))
    over = lambda old, new: F.when(has, F.col(new)).otherwise(F.col(old))
    changed = {
        "verdict": over("verdict", "_verdict"), "confidence": over("confidence", "_confidence"), "verdict_reason": over("verdict_reason", "_reason"), "explanation": over("explanation", "_explanation"),
        "fix_suggestion": keep("fix_suggestion", "_recommendation"), "fix_code": keep("fix_code", "_code_fix"),
    }
    return j.withColumns(changed).select(*findings.columns)


def without_false_secrets(findings: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Secret findings stay unless an answer (fingerprint, verdict) calls them false; no answer keeps them."""
    false = verdicts.where("verdict is not null and not contains(verdict, 'TRUE_POSITIVE')").select("fingerprint")
    return findings.join(false, "fingerprint", "left_anti").select(*findings.columns)


def changed_only(findings: DataFrame, changed: DataFrame) -> DataFrame:
    """Findings in changed files; all of them if no file is listed."""
    any_ = changed.agg((F.count("*") > 0).alias("_any"))
    c = changed.select(F.col("path").alias("file_path")).distinct().withColumn("_in", F.lit(True))
    return findings.join(c, "file_path", "left").crossJoin(F.broadcast(any_)).where("not _any or _in").select(*findings.columns)


def relative_paths(findings: DataFrame, root: str) -> DataFrame:
    prefix = root.rstrip("/") + "/"
    p = F.col("file_path")
    return findings.withColumn("file_path", F.when(p.startswith(prefix), F.substring(p, len(prefix) + 1, 1 << 20)).otherwise(p))


def suppressed_counts(findings: DataFrame, inline: DataFrame, baseline: DataFrame) -> DataFrame:
    """One row: findings that markers suppress, those of the others that the baseline does, and both."""
    marked = findings.join(inline.select("fingerprint").distinct().withColumn("_i", F.lit(1)), "fingerprint", "left").join(baseline.select("fingerprint").where("fingerprint <> ''").distinct().withColumn("_b", F.lit(1)), "fingerprint", "left")
    n = marked.agg(F.count("_i").alias("inline"), F.count(F.expr("CASE WHEN _i IS NULL THEN _b END")).alias("baseline"))
    return n.withColumn("suppressed", F.col("inline") + F.col("baseline"))


def both_runs(first: DataFrame, second: DataFrame) -> DataFrame:
    """Findings of two runs one after the other: what both have stays twice."""
    return first.unionByName(second, allowMissingColumns=True)


def process(producers: list[DataFrame], cfg: Config, files: DataFrame | None = None, baseline: DataFrame | None = None, answers: DataFrame | None = None) -> DataFrame:
    """All of it but the required check, which missing_required() makes on the findings after score()."""
    f = score(dedup(with_fingerprints(union(producers))))
    f = by_rule(severe(f, cfg.min_severity), cfg.include_rules, cfg.exclude_rules)
    if files is not None:
        f = without(f, inline_suppressed(f, files, cfg.marker))
    if baseline is not None:
        f = without(f, baseline)
    return merge_triage(f, answers) if answers is not None else f


def counts_by_severity(findings: DataFrame, zeros: bool = True) -> DataFrame:
    """severity, label, n from the most severe; levels without findings too, if zeros."""
    levels = findings.sparkSession.createDataFrame(list(enumerate(SEVERITIES)), "severity int, label string")
    n = findings.groupBy("severity").agg(F.count("*").alias("n"))
    return F.broadcast(levels).join(n, "severity", "left" if zeros else "inner").select("severity", "label", F.coalesce("n", F.lit(0)).alias("n"))


def counts_by_type(findings: DataFrame) -> DataFrame:
    place = F.array_position(F.array(*[F.lit(t) for t in TYPES]), F.col("type"))
    return findings.groupBy("type").agg(F.count("*").alias("n")).select("type", "n", place.cast("int").alias("place"))
