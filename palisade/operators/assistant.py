"""What goes to a language model and what becomes of its answers. The model is an injected function of a list of
prompts; prompts are expressions, in our own words, and ask for the grammar that functions/answers.py parses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions import answers as A
from palisade.functions import scalar as S
from palisade.operators.slices import attribute
from palisade.schema import Config, as_findings

#: Lines of context on either side of a finding.
RADIUS = 8
HIDDEN = "[REDACTED]"

# Phrases of a finding's name and description by vulnerability, in order of precedence.
EXAMPLES = (
    ("sql", ("sql injection", "sql string concatenation", "sql f-string", "sql format", "sql concat")),
    ("command", ("command injection", "shell command with concat", "os command injection", "shell=true")),
    ("xss", ("xss", "cross-site scripting", "innerhtml assignment")),
    ("secret", ("hardcoded secret", "hardcoded password", "hardcoded credential", "hardcoded api key", "hardcoded token", "aws access key", "private key block", "jwt secret")),
    ("path", ("path traversal", "path concatenation", "directory traversal")),
    ("hash", ("weak hash", "weak hash (md5)", "weak hash (sha1)", "insecure hash")),
    ("deserialization", ("insecure deserialization", "unsafe deserialization")),
    ("redirect", ("open redirect", "url redirect", "unvalidated redirect")),
    ("debug", ("debug mode enabled",)),
    ("cors", ("cors allow all",)),
    ("ecb", ("ecb mode", "aes ecb", "cipher ecb")),
    ("random", ("math.random for security", "weak random", "insecure random")),
    ("ssrf", ("ssrf", "server-side request forgery", "unvalidated url")),
    ("xxe", ("xxe", "xml external entity", "xml injection")),
)


def example_of(name: Column, description: Column) -> Column:
    """The kind of example that fits a finding; empty if none does."""
    text = F.lower(F.concat_ws(" ", name, description))
    return S.choose([(S.contains_any(text, phrases), kind) for kind, phrases in EXAMPLES], "")


def source_prompts(slices: DataFrame) -> DataFrame:
    """slices (path, language, text, supporting: array<struct<path, text>>) -> path, prompt."""
    more = F.array_join(F.transform("supporting", lambda s: F.concat(F.lit("\n### "), s["path"], F.lit("\n"), s["text"])), "")
    ask = "Report each vulnerability as **Vulnerability Level**, **Issue**, **Location** (file:line), **Risk** and **Fix**, one record after another; --- ends a fix. Reply NO_FINDINGS if there is none.\n\n### "
    return slices.select("path", F.concat(F.lit("Review this "), "language", F.lit(" code. " + ask), "path", F.lit("\n"), "text", more).alias("prompt"))


def finding_context(findings: DataFrame, files: DataFrame) -> DataFrame:
    """fingerprint, context: lines around a finding; those of secrets, and of rules that find secrets, are hidden."""
    f = findings.where("file_path <> '' and start_line > 0").select("fingerprint", "type", "tags", "start_line", "end_line", F.col("file_path").alias("path"))
    j = f.join(files.select("path", "text"), "path")
    secret = (F.col("type") == "secrets") | F.array_contains("tags", "secrets")
    shown, hidden = S.context(F.col("text"), F.col("start_line"), RADIUS), S.redacted_context(F.col("text"), F.col("start_line"), F.col("end_line"), RADIUS, HIDDEN)
    return j.select("fingerprint", F.when(secret, hidden).otherwise(shown).alias("context"))


def triage_prompts(findings: DataFrame, files: DataFrame) -> DataFrame:
    """fingerprint, prompt for each finding, by what it is about: a package, a package in an image, or code."""
    f = findings.join(finding_context(findings, files), "fingerprint", "left")
    package = F.concat_ws(" ", "package_name", "package_version", "ecosystem", "cve", "fixed_version")
    subject = S.choose(
        [(F.col("type") == "container", F.concat(F.lit("Package in image "), "file_path", F.lit(": "), package)), (F.col("type") == "sca", F.concat(F.lit("Package: "), package))],
        F.concat(F.lit("Code at "), "file_path", F.lit(":"), F.col("start_line").cast("string"), F.lit("\n"), F.coalesce("context", F.lit(""))),
    )
    example = example_of(F.col("rule_name"), F.col("description"))
    hint = F.when(example != "", F.concat(F.lit("\nKind: "), example)).otherwise("")
    head = F.concat(F.lit("Is this finding real? "), "title", F.lit("\n"), "description", F.lit("\n"))
    return f.select("fingerprint", F.concat(head, subject, hint, F.lit("\nAnswer with VERDICT, CONFIDENCE, REASON, EXPLANATION, RECOMMENDATION and CODE_FIX.")).alias("prompt"))


def triaged(findings: DataFrame, files: DataFrame, completer, limiter=None) -> DataFrame:
    """Parsed answers (fingerprint, verdict, ...) of a model; without an answer the verdict is UNKNOWN. limiter: functions.limits."""
    a = A.complete(triage_prompts(findings, files), completer, limiter=limiter).withColumn("_r", A.parse_triage("answer"))
    reason = F.when(F.col("answer").isNull(), "no answer").otherwise(F.col("_r.reason"))
    return a.select("fingerprint", F.when(F.col("answer").isNull(), "UNKNOWN").otherwise(F.col("_r.verdict")).alias("verdict"), "_r.confidence", reason.alias("reason"), "_r.explanation", "_r.recommendation", "_r.code_fix")


def answered_findings(answers: DataFrame, cfg: Config) -> DataFrame:
    """answers (path, language, files: paths of the slice, answer) -> findings, each placed in the slice's file that it
    names. Rules of container files have a namespace and a type of their own."""
    r = answers.select(F.col("path").alias("primary"), "language", "files", F.explode(A.parse_findings("answer")).alias("r")).select("primary", "language", "files", "r.*")
    placed = attribute(r)
    docker = F.col("language").isin("dockerfile", "docker-compose")
    kind = F.when(docker, "dockerfile").otherwise("sast")
    prefix = F.when(docker, f"{cfg.namespace}.dockerfile.").otherwise(f"{cfg.namespace}.sast.ai.")
    text = F.coalesce(S.nonempty(F.col("risk")), F.col("issue"))
    return as_findings(
        placed, type=kind, rule_id=F.concat(prefix, S.slugify(F.col("issue"))), rule_name=F.col("issue"), severity=S.severity_rank(F.col("level")), confidence="high", title=F.col("issue"), description=text,
        file_path=F.col("path"), start_line=S.line_number(F.col("location")), cwe=S.cwes(F.concat_ws(" ", "issue", "risk")), tags=F.array(kind, F.lit("ai")), fix_suggestion=F.col("fix"),
    )


def succeeded(answers: DataFrame) -> DataFrame:
    """path, done: whether a file's scan counts, so that its hash may be remembered. It doesn't if there is no answer, or
    one that says something but can't be parsed."""
    empty = S.strip(F.col("answer")) == ""
    return answers.select("path", F.coalesce(empty | F.contains("answer", F.lit("NO_FINDINGS")) | (F.size(A.parse_findings("answer")) > 0), F.lit(False)).alias("done"))


def code_line(text: Column, line: Column) -> Column:
    """A finding's line, trimmed; if it opens a block, with the next line that isn't blank."""
    rows = F.transform(S.lines_kept(text), S.strip)
    own = F.coalesce(F.try_element_at(rows, line), F.lit(""))
    after = S.first(F.filter(F.slice(rows, line + 1, F.greatest(F.size(rows) - line, F.lit(0))), lambda x: x != ""))
    opens = own.startswith("func ") | own.startswith("if ") | own.startswith("for ") | own.endswith("{")
    return F.when((line >= 1) & (line <= F.size(rows)), F.when(opens & after.isNotNull(), F.concat_ws("\n", own, after)).otherwise(own)).otherwise("")
