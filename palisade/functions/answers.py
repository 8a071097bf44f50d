"""Parsers of what a language model answers. Single-field answers are expressions; answers in records are parsed in
Arrow batches."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palisade.functions import limits
from palisade.functions import scalar as S

FINDINGS = T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("level", "issue", "location", "risk", "fix")]))
TRIAGE = T.StructType([T.StructField(c, T.StringType()) for c in ("verdict", "confidence", "reason", "explanation", "recommendation", "code_fix")])

_HEAD = re.compile(r"^\s*\*\*\s*Vulnerability Level\s*\*\*\s*:?\s*(.*)$", re.I)
_FIELD = re.compile(r"^\s*\*\*\s*(Issue|Location|Risk|Fix)\s*\*\*\s*:?\s*(.*)$", re.I)


def findings_of(text: str | None) -> list[dict]:
    """Records that start at a level; lines after a field belong to it, blank ones are dropped, --- ends a fix."""
    if not text or "NO_FINDINGS" in text:
        return []
    out: list[dict] = []
    field = ""
    for line in text.split("\n"):
        if m := _HEAD.match(line):
            out.append({"level": m[1].strip(), "issue": "", "location": "", "risk": "", "fix": ""})
            field = ""
        elif not out:
            continue
        elif m := _FIELD.match(line):
            field = m[1].lower()
            out[-1][field] = m[2].strip()
        elif line.strip() == "---":
            field = ""
        elif field and line.strip():
            out[-1][field] = f"{out[-1][field]}\n{line.strip()}".strip("\n")
    return [r for r in out if r["issue"]]


@F.pandas_udf(FINDINGS)
def parse_findings(text: pd.Series) -> pd.Series:
    return text.map(findings_of)


_KEYS = ("VERDICT", "CONFIDENCE", "REASON", "EXPLANATION", "RECOMMENDATION", "CODE_FIX", "FIX")


def triage_of(text: str | None) -> dict:
    """Keyed lines with their continuations; a plain fix is a recommendation unless there is a code fix."""
    held: dict[str, list[str]] = {}
    key = ""
    for line in (text or "").split("\n"):
        found = next((k for k in _KEYS if line.strip().upper().startswith(f"{k}:")), "")
        if found:
            key = found
            held[key] = [line.strip()[len(found) + 1 :].strip()]
        elif key:
            held[key].append(line.rstrip())
    value = {k: "\n".join(v).strip() for k, v in held.items()}
    said = value.get("VERDICT", "").upper()
    level = value.get("CONFIDENCE", "").upper()
    fix, code = value.get("FIX", ""), value.get("CODE_FIX", "")
    return {
        "verdict": "FALSE_POSITIVE" if "FALSE" in said else "TRUE_POSITIVE" if "TRUE" in said else "UNKNOWN",
        "confidence": next((x for x in ("HIGH", "MEDIUM", "LOW") if x in level), ""),
        "reason": value.get("REASON", ""),
        "explanation": value.get("EXPLANATION", ""),
        "recommendation": value.get("RECOMMENDATION", "") or (fix if not code else ""),
        "code_fix": code,
    }


@F.pandas_udf(TRIAGE)
def parse_triage(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([triage_of(x) for x in text], columns=TRIAGE.names)


def reachability_status(text: Column) -> Column:
    """The last status, in upper case; UNKNOWN without one."""
    return F.coalesce(S.nonempty(F.upper(S.strip(S.last(F.regexp_extract_all(text, F.lit(r"(?imd)^\s*REACHABILITY:(.*)$"), F.lit(1)))))), F.lit("UNKNOWN"))


def reachability_reason(text: Column) -> Column:
    return F.coalesce(S.strip(S.last(F.regexp_extract_all(text, F.lit(r"(?imd)^\s*REASON:(.*)$"), F.lit(1)))), F.lit(""))


def secret_verdict(text: Column) -> Column:
    """The first verdict line; null if there is none."""
    return S.first(F.regexp_extract_all(text, F.lit(r"(?md)^\s*VERDICT:\s*(.*)$"), F.lit(1)))


def complete(prompts, completer, answer: str = "answer", limiter=None, answer_tokens: int = limits.ANSWER_TOKENS):
    """prompts (.., prompt) with the answers of an injected completer, a picklable function of a list of texts. One that
    raises gives null answers; null prompts are not sent and have null answers. With a limiter (limits.shared) prompts are
    sent one by one as it allows, whatever the number of tasks; those that its budget of tokens does not hold are not sent
    and have null answers."""
    schema = T.StructType([*prompts.schema.fields, T.StructField(answer, T.StringType())])

    def one(prompt):
        if prompt is None:
            return None
        try:
            limiter.wait(limits.prompt_tokens(prompt, answer_tokens))
        except limits.OutOfTokens:
            return None
        try:
            return completer([prompt])[0]
        except Exception:
            return None

    def run(frames):
        for f in frames:
            if limiter is not None:
                yield f.assign(**{answer: [one(p) for p in f["prompt"]]})
                continue
            sent = f["prompt"].notna()
            got = pd.Series([None] * len(f), f.index, object)
            if sent.any():
                try:
                    got[sent] = completer(f["prompt"][sent].tolist())
                except Exception:
                    pass
            yield f.assign(**{answer: got})

    return prompts.mapInPandas(run, schema)
