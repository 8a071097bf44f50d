"""Whether the code of a scan reaches a vulnerable package: files that import it, a model's answer about them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.functions import answers as A
from palisade.functions import scalar as S
from palisade.operators.producers import annotate_reachability, importing_files
from palisade.sinks.folders import shared_folder

# Files of a package and lines of each that are shown, tokens of an answer.
MOST_FILES, MOST_LINES, ANSWER_TOKENS = 5, 300, 512
NOT_IMPORTED, NO_ANSWER = "No scanned file imports this package.", "The model gave no answer."


def reachability_prompts(findings: DataFrame, files: DataFrame) -> DataFrame:
    """fingerprint, prompt for each finding of a package, null where no file imports it: there is nothing to ask then. Texts
    are searched once; the few files that are shown, at most MOST_FILES a package, are written, so that Spark knows their
    size, and only their heads are made. Each package is looked for once, however many findings it has."""
    f = findings.where("type = 'sca'").select("fingerprint", "rule_id", "description", F.col("package_name").alias("name"), F.col("package_version").alias("version"), "ecosystem")
    folder, found = shared_folder(files.sparkSession, "imports"), importing_files(f.select("name", "ecosystem"), files, MOST_FILES)
    found.write.parquet(folder)
    found = files.sparkSession.read.schema(found.schema).parquet(folder)
    head = F.array_join(F.slice(S.lines_kept(F.substring_index("text", "\n", MOST_LINES)), 1, MOST_LINES), "\n")
    shown = files.select("path", "text").join(found, "path").withColumn("head", head).groupBy("name", "ecosystem")
    shown = shown.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "path", "head"))), lambda x: F.concat(F.lit("\n### "), x["path"], F.lit("\n"), x["head"])), "").alias("_shown"))
    ask = "\nDoes this code use the part of the package that is vulnerable? Judge by the code alone. Answer with REACHABILITY: REACHABLE, UNREACHABLE or UNKNOWN, and REASON: one sentence.\n"
    prompt = F.concat(F.col("rule_id"), F.lit(": "), F.col("name"), F.lit("@"), F.col("version"), F.lit("\n"), F.col("description"), F.lit(ask), F.col("_shown"))
    return f.join(shown, ["name", "ecosystem"], "left").select("fingerprint", prompt.alias("prompt"))


def reachability(findings: DataFrame, files: DataFrame, completer, limiter=None) -> DataFrame:
    """fingerprint, status, reason: UNKNOWN without a call where nothing imports the package, and where no answer comes."""
    asked = A.complete(reachability_prompts(findings, files), completer, limiter=limiter, answer_tokens=ANSWER_TOKENS)
    answer, none = F.col("answer"), F.when(F.col("prompt").isNull(), NOT_IMPORTED).otherwise(NO_ANSWER)
    return asked.select("fingerprint", F.when(answer.isNull(), "UNKNOWN").otherwise(A.reachability_status(answer)).alias("status"), F.when(answer.isNull(), none).otherwise(A.reachability_reason(answer)).alias("reason"))


def with_reachability(findings: DataFrame, files: DataFrame, completer, limiter=None) -> DataFrame:
    """Findings with what was found worked in; those of other types stay as they are."""
    other = findings.where("type <> 'sca'")
    return annotate_reachability(findings.where("type = 'sca'"), reachability(findings, files, completer, limiter)).unionByName(other)
