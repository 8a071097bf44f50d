"""Regular expression rules and their matching against lines."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions import scalar as S


class Rule(NamedTuple):
    name: str
    cwe: str
    severity: int
    category: str
    regex: str


# The built-in rules, in order.
RULES = (
    Rule("Hardcoded secret", "CWE-798", 4, "secrets", r"""(?i)(password|secret|api[_-]?key|token|credential)\s*[=:]\s*["'][^"']{8,}["']"""),
    Rule("AWS access key", "CWE-798", 4, "secrets", r"""AKIA[0-9A-Z]{16}"""),
    Rule("Private key block", "CWE-321", 4, "secrets", r"""-----BEGIN (RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----"""),
    Rule("JWT secret", "CWE-798", 3, "secrets", r"""(?i)jwt[_-]?secret\s*[=:]\s*["'][^"']+["']"""),
    Rule("SQL string concatenation", "CWE-89", 4, "injection", r"""(?i)(SELECT|INSERT|UPDATE|DELETE|FROM|WHERE).*["']\s*\+\s*"""),
    Rule("SQL f-string/format", "CWE-89", 4, "injection", r"""(?i)f["'](SELECT|INSERT|UPDATE|DELETE|FROM|WHERE).*\{"""),
    Rule("Shell command with concat", "CWE-78", 4, "injection", r"""(?i)(os\.system|subprocess\.call|exec\.Command|child_process\.exec)\s*\(.*\+"""),
    Rule("Shell=True", "CWE-78", 3, "injection", r"""shell\s*=\s*True"""),
    Rule("innerHTML assignment", "CWE-79", 3, "xss", r"""\.innerHTML\s*="""),
    Rule("document.write", "CWE-79", 3, "xss", r"""document\.write\s*\("""),
    Rule("Weak hash (MD5)", "CWE-328", 3, "crypto", r"""(?i)(md5|MD5)\s*[.(]"""),
    Rule("Weak hash (SHA1)", "CWE-328", 2, "crypto", r"""(?i)(sha1|SHA1)\s*[.(]"""),
    Rule("ECB mode", "CWE-327", 3, "crypto", r"""(?i)(ECB|MODE_ECB|AES\.ECB)"""),
    Rule("Math.random for security", "CWE-330", 3, "crypto", r"""Math\.random\s*\("""),
    Rule("Path concatenation", "CWE-22", 3, "input", r"""(?i)(?:read_?file|write_?file)\s*\(.*\+|open\s*\([^)]*["'/][^)]*\+"""),
    Rule("Debug mode enabled", "CWE-215", 2, "config", r"""(?i)(DEBUG|debug)\s*[=:]\s*(true|True|1|"true")"""),
    Rule("CORS allow all", "CWE-346", 2, "config", r"""(?i)(Access-Control-Allow-Origin|allowedOrigins?)\s*[=:]\s*["']\*["']"""),
)

_QUOTES = ('"', "'")
#: Texts of which, in lower case, one of each group stands in whatever the rule matches: a cheap test before the rule.
NEEDS = {
    "Hardcoded secret": (("password", "secret", "api", "token", "credential"), _QUOTES),
    "AWS access key": (("akia",),),
    "Private key block": (("-----begin ",),),
    "JWT secret": (("jwt",), _QUOTES),
    "SQL string concatenation": (("+",), _QUOTES, ("select", "insert", "update", "delete", "from", "where")),
    "SQL f-string/format": (("{",), ('f"', "f'")),
    "Shell command with concat": (("+",), ("os.system", "subprocess.call", "exec.command", "child_process.exec")),
    "Shell=True": (("shell",), ("true",)),
    "innerHTML assignment": ((".innerhtml",),),
    "document.write": (("document.write",),),
    "Weak hash (MD5)": (("md5",),),
    "Weak hash (SHA1)": (("sha1",),),
    "ECB mode": (("ecb",),),
    "Math.random for security": (("math.random",),),
    "Path concatenation": (("+",), ("(",), ("read", "write", "open")),
    "Debug mode enabled": (("debug",),),
    "CORS allow all": (("access-control-allow-origin", "allowedorigin"), ("*",)),
}

#: Own rules for secrets in public formats: name, regular expression, group that holds the secret.
SECRET_RULES = (
    ("aws-access-key-id", r"\b((?:AKIA|ASIA)[0-9A-Z]{16})\b", 1),
    ("github-token", r"\b(gh[pousr]_[A-Za-z0-9]{36,})\b", 1),
    ("gitlab-token", r"\b(glpat-[A-Za-z0-9_-]{20,})", 1),
    ("slack-token", r"\b(xox[abprs]-[A-Za-z0-9-]{10,})", 1),
    ("stripe-key", r"\b([rs]k_live_[A-Za-z0-9]{16,})\b", 1),
    ("google-api-key", r"\b(AIza[0-9A-Za-z_-]{35})", 1),
    ("npm-token", r"\b(npm_[A-Za-z0-9]{36})\b", 1),
    ("private-key", r"(-----BEGIN (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----)", 1),
    ("json-web-token", r"\b(eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,})", 1),
    ("generic-token", r"""(?i)\b(?:token|secret|password|api[_-]?key)\s*[=:]\s*["']([A-Za-z0-9+/_=-]{16,})["']""", 1),
)


def java(regex: str) -> str:
    """For Java's engine: only a line feed ends a line, and case folds in all scripts."""
    return "(?d)" + regex.replace("(?i)", "(?iu)")


def comment(line: Column) -> Column:
    """Lines that are comments: //, #, or a star that stands alone or is followed by a space."""
    t = S.strip(line)
    return t.startswith("//") | t.startswith("#") | (t == "*") | t.startswith("* ")


def prefilter(files: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """files (path, text, ...) -> a row for each rule and line: the files' other columns, line, ordinal, name, cwe,
    severity, category.

    No rule is anchored, so one that matches a line also matches its text: files without any match, nearly all, are
    dropped before lines are split, most of them by plain searches for what a match needs. Rules are literals and
    compile once."""

    def matched(low: Column) -> Column:
        out = F.lit(False)
        for r in rules:
            needed = F.lit(True)
            for group in NEEDS.get(r.name, ()):
                needed = needed & S.contains_any(low, group)
            # a long s folds to s but is a letter of its own in lower case
            out = out | (needed | low.contains("\u017f")) & F.col("text").rlike(java(r.regex))
        return out

    # the lambda's variable holds the lower-cased text, which a plain filter would compute for each search
    lines = files.where(F.exists(F.array(F.lower("text")), matched)).select(*[c for c in files.columns if c != "text"], F.posexplode(S.lines_kept(F.col("text"))).alias("_pos", "_line")).where(~comment(F.col("_line")))
    hits = F.array_compact(F.array(*[F.when(F.col("_line").rlike(java(r.regex)), F.lit(i)) for i, r in enumerate(rules)]))
    table = F.array(*[F.struct(F.lit(r.name).alias("name"), F.lit(r.cwe).alias("cwe"), F.lit(r.severity).alias("severity"), F.lit(r.category).alias("category")) for r in rules])
    out = lines.withColumn("ordinal", F.explode(hits)).withColumn("_rule", F.element_at(table, F.col("ordinal") + 1))
    return out.select(*[c for c in files.columns if c != "text"], (F.col("_pos") + 1).alias("line"), "ordinal", "_rule.*")


def secrets(files: DataFrame, rules=SECRET_RULES) -> DataFrame:
    """files (path, text) -> path, line, rule, secret for each match of a rule in a line."""
    any_ = F.lit(False)
    for _, regex, _ in rules:
        any_ = any_ | F.col("text").rlike("(?d)" + regex)
    lines = files.where(any_).select("path", F.posexplode(S.lines_kept(F.col("text"))).alias("_pos", "_line"))
    found = F.array(*[F.struct(F.lit(name).alias("rule"), F.regexp_extract_all("_line", F.lit("(?d)" + regex), F.lit(group)).alias("all")) for name, regex, group in rules])
    out = lines.withColumn("_f", F.explode(F.filter(found, lambda x: F.size(x["all"]) > 0)))
    return out.select("path", (F.col("_pos") + 1).alias("line"), F.col("_f.rule").alias("rule"), F.explode("_f.all").alias("secret"))
