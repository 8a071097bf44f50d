"""Rules from a table, hundreds or thousands of them, at a cost that follows the text.

Whatever a rule matches holds certain literals, or one of each of some groups, which are read off its regular
expression. The best group of each rule goes into one Aho-Corasick automaton in each task. It runs over a text once and
names the lines, and for each the rules, that may match: where an expression goes on with sets of characters behind its
literal, these must follow it; lines that lack a literal of another group are passed over. Only
the rest leaves the task, and only these pairs meet the regular expressions, in Spark's own engine. A literal only selects: hits are the expressions' own, as if each rule had been tried on each line.

Case does not count for the automaton, which folds ASCII letters and the two letters that fold to them, so it serves
expressions with and without (?i). Rules whose expressions name no literal of LEAST_LITERAL characters, or that Python
cannot read (other engines know more), are bare: they are tried on every line, which costs as much as it always did.

A table of rules is code, not data: up to MOST_RULES and MOST_BYTES, which are counted before it is collected, travel to
every task. A larger one raises; it can be applied part by part, as hits of a rule do not depend on other rules.
"""

from __future__ import annotations

import re
import uuid
import warnings
from collections.abc import Iterator
from re import _constants as K  # the tree of an expression: the standard library's, read and never changed
from re import _parser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.functions import scalar as S
from palisade.operators.rules import RULES, comment, java

LEAST_LITERAL = 2
MOST_RULES = 200_000
MOST_BYTES = 32 << 20
#: Alternatives of a rule beyond which its literals are not worth their number.
MOST_LITERALS = 64
#: Characters of a text that are folded and searched at a time.
PIECE = 1 << 20

RULE = "name string, cwe string, severity int, category string, regex string"

#: Letters beyond ASCII that fold to ASCII ones.
FOLDING = ("\u017f", "\u212a")
_FOLD = {i: i + 32 for i in range(65, 91)} | {0x17F: "s", 0x212A: "k"}


def fold(text: str) -> str:
    """Lower case of the letters that fold to ASCII ones; as many characters as before."""
    return text.lower() if text.isascii() else text.translate(_FOLD)


def needed(regex: str) -> list[list[str]]:
    """Groups of folded literals: whatever matches holds one of each group. The first one selects best; none if the
    expression cannot be read."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = _parser.parse(regex)
    except (re.error, OverflowError, RecursionError):
        return []
    groups = {frozenset(g) for g in _of_sequence(tree) if len(g) <= MOST_LITERALS}
    return [sorted(g) for g in sorted(groups, key=lambda g: (-min(map(len, g)), len(g), sorted(g)))]


def required(regex: str) -> list[str] | None:
    """The literals by which the automaton looks for an expression; None if there are none of LEAST_LITERAL characters."""
    first = next(iter(needed(regex)), None)
    return first if first and min(map(len, first)) >= LEAST_LITERAL else None


def _folded(code: int) -> str | None:
    c = fold(chr(code))
    return c if len(c) == 1 and c.isascii() else None


def _of_sequence(items) -> list[set[str]]:
    groups: list[set[str]] = []
    run = ""
    for op, value in items:
        if op is K.LITERAL and (c := _folded(value)):
            run += c
            continue
        if op is K.AT or op in (K.ASSERT, K.ASSERT_NOT):  # takes no characters: the run goes on
            continue
        if run:
            groups.append({run})
            run = ""
        if op is K.SUBPATTERN:
            groups += _of_sequence(value[3])
        elif op is K.ATOMIC_GROUP:
            groups += _of_sequence(value)
        elif op is K.BRANCH:
            best = [max(_of_sequence(x), key=lambda g: (min(map(len, g)), -len(g)), default=None) for x in value[1]]
            groups += [set().union(*best)] if all(best) else []
        elif op in (K.MAX_REPEAT, K.MIN_REPEAT, K.POSSESSIVE_REPEAT) and value[0] >= 1:
            groups += _of_sequence(value[2])
        elif op is K.IN and all(o is K.LITERAL and _folded(v) for o, v in value):
            groups.append({_folded(v) for _, v in value})
    return [*groups, {run}] if run else groups


def _accepted(op, value) -> str | None:
    """A class of the characters that a literal or a set of ASCII ones can stand for, in either case; None if it isn't one."""
    codes: set[int] = set()
    for o, v in [(op, value)] if op is K.LITERAL else value if op is K.IN else [(None, None)]:
        if o is K.LITERAL:
            codes.add(v)
        elif o is K.RANGE:
            codes.update(range(v[0], min(v[1], 128) + 1))
        else:
            return None
    # other engines have sets within sets, which Python reads as characters
    if max(codes) > 127 or codes & {ord("["), ord("&")}:
        return None
    of = {fold(chr(c)) for c in codes}
    return "[" + "".join(sorted(re.escape(x) for c in of for x in {c, c.upper(), *(y for y in FOLDING if fold(y) == c)})) + "]"


def tail(regex: str, literal: str) -> str | None:
    """What must follow a literal of the expression wherever it matches, as an expression that may accept more: the sets
    and repeated sets of ASCII characters behind it, as far as they are read off. None if there are none."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        items = list(_parser.parse(regex))
    run, after = "", None
    for i, (op, value) in enumerate(items):
        if op is K.LITERAL and (c := _folded(value)):
            run += c
        elif op is K.AT or op in (K.ASSERT, K.ASSERT_NOT):  # as in _of_sequence
            continue
        else:
            if run == literal:
                after = items[i:]
                break
            run = ""
    out, endless = "", False
    for op, value in after or ():
        least = most = 1
        if op in (K.MAX_REPEAT, K.MIN_REPEAT):
            least, most = value[0], value[1]
            if len(value[2]) != 1 or most is K.MAXREPEAT and endless:  # one endless repeat: no backtracking among several
                break
            endless = endless or most is K.MAXREPEAT
            op, value = value[2][0]
        accepted = _accepted(op, value)
        if accepted is None:
            break
        out += accepted + ("" if (least, most) == (1, 1) else f"{{{least},{'' if most is K.MAXREPEAT else most}}}")
    return out or None


class Automaton:
    """The literals of some rules: those of their first groups are looked for, the others in the lines that have them.
    Rules without a group of LEAST_LITERAL characters are left out. A rule's tail, if it has one, must follow its literal."""

    def __init__(self, groups: list[list[list[str]]], tails: list[str | None] | None = None):
        import ahocorasick

        literals = [g[0] if g and min(map(len, g[0])) >= LEAST_LITERAL else None for g in groups]
        self.others = [g[1:] for g in groups]

        by_literal: dict[str, dict[str | None, list[int]]] = {}
        for ordinal, words in enumerate(literals):
            for word in words or ():
                by_literal.setdefault(word, {}).setdefault(tails[ordinal] if tails else None, []).append(ordinal)
        self.words = ahocorasick.Automaton()
        follows = {x: re.compile(x).match for by_tail in by_literal.values() for x in by_tail if x}
        for word, by_tail in by_literal.items():
            self.words.add_word(word, [(follows.get(x), ordinals) for x, ordinals in by_tail.items()])
        self.reach = max(map(len, by_literal), default=1) - 1
        if by_literal:
            self.words.make_automaton()

    def lines(self, text: str) -> Iterator[tuple[int, str, list[int]]]:
        """(number, line, rules that may match) for the lines of a text that hold a literal, numbered from 0."""
        if not len(self.words):
            return
        found: dict[int, set[int]] = {}  # by the line's first character
        start, end, rules = 0, -1, set()
        for at in range(0, max(1, len(text)), PIECE):
            low = max(0, at - self.reach)
            for place, by_tail in self.words.iter(fold(text[low : at + PIECE])):
                place += low
                if place < at:
                    continue
                # the tail may run past the line, as a match may not: it only selects
                own = [ordinals for follows, ordinals in by_tail if follows is None or follows(text, place + 1)]
                if not own:
                    continue
                if place > end:
                    start = text.rfind("\n", 0, place) + 1
                    end = text.find("\n", place)
                    end = len(text) if end < 0 else end
                    rules = found.setdefault(start, set())
                rules.update(*own)
        number, last = 0, 0
        for start, rules in found.items():
            number += text.count("\n", last, start)
            last = start
            end = text.find("\n", start)
            line = text[start : len(text) if end < 0 else end]
            low = fold(line)
            kept = sorted(r for r in rules if all(any(x in low for x in g) for g in self.others[r]))
            if kept:
                yield number, line, kept


#: Characters of lines, repeated for each of their rules, and pairs of both that a task holds before it passes them on.
HELD, MOST_PAIRS = 4 << 20, 1 << 16
#: Bytes of texts that go to a task at a time, where the session has Spark's default of 64 MB.
BATCH_BYTES = "4m"


def _small_batches(spark) -> None:
    size = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(size) in ("67108864b", "67108864", "64m", "64MB"):
        spark.conf.set(size, BATCH_BYTES)


#: The automaton that a worker process has built last.
_BUILT: dict[str, Automaton] = {}


def candidates(files: DataFrame, groups: list[list[list[str]]], flag: str | None = None, tails: list[str | None] | None = None) -> DataFrame:
    """The columns of files but text, and (_pos, _line, _folds, ordinal): lines, numbered from 0, whether they hold a letter
    beyond ASCII that folds to one of ASCII, and the rules that they may match; for files whose column `flag` is true also one row of ordinal -1, without a line."""
    shared, key = files.sparkSession.sparkContext.broadcast((groups, tails)), uuid.uuid4().hex
    kept = [c for c in files.columns if c != "text"]

    def made(b, rows: list[tuple]) -> list[pa.RecordBatch]:
        row, pos, line, ordinal = zip(*rows, strict=True)
        take = pa.array(row)
        table = pa.table([*(b.column(c).take(take) for c in kept), pa.array(pos, pa.int32()), pa.array(line, pa.string()), pa.array([not x.isascii() and any(c in x for c in FOLDING) for x in line]), pa.array(ordinal, pa.int32())], names=[*kept, "_pos", "_line", "_folds", "ordinal"])
        return table.sort_by("ordinal").to_batches()  # so that each expression is compiled once a batch

    def run(batches):
        if key not in _BUILT:
            _BUILT.clear()
            _BUILT[key] = Automaton(*shared.value)
        automaton = _BUILT[key]
        for b in batches:
            rows, size = [(i, 0, "", -1) for i, x in enumerate(b.column(flag).to_pylist()) if x] if flag else [], 0
            for i, text in enumerate(b.column("text")):
                for number, content, rules in automaton.lines(text.as_py() or ""):
                    for r in rules:
                        rows.append((i, number, content, r))
                        size += len(content)
                        if size > HELD or len(rows) >= MOST_PAIRS:
                            yield from made(b, rows)
                            rows, size = [], 0
            if rows:
                yield from made(b, rows)
            rows = []
            pa.default_memory_pool().release_unused()

    _small_batches(files.sparkSession)
    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema if f.name != "text"]
    return files.select(*kept, F.col("text").cast("string").alias("text")).mapInArrow(run, ", ".join([*schema, "_pos int", "_line string", "_folds boolean", "ordinal int"]))


def collected(rules: DataFrame) -> list[tuple]:
    """The rows of a table of rules, ordered by all columns; it is counted first. An expression without a match raises here."""
    size = rules.agg(F.count("*").alias("n"), F.sum(F.octet_length("regex")).alias("bytes")).first()
    if size.n > MOST_RULES or (size.bytes or 0) > MOST_BYTES:
        raise ValueError(f"{size.n} rules of {size.bytes} bytes are more than a task should hold ({MOST_RULES}, {MOST_BYTES}); apply them part by part")
    return [tuple(r) for r in rules.orderBy(*rules.columns).collect()]


def plainly(regex: str) -> str:
    """java() without folding in other scripts, which takes four times as long, if it says the same of lines that hold no
    letter of FOLDING: if all that the expression compares with is ASCII."""
    return "(?d)" + regex if regex.isascii() and not re.search(r"\\[0-9kuxNpPcXQ]", regex) else java(regex)


def _verified(found: DataFrame, rows: list[tuple], schema: str, flagged: bool) -> DataFrame:
    """Pairs of lines and rules whose expression matches, with the rule's columns."""
    names = [x.split()[0] for x in schema.split(", ")]
    table = found.sparkSession.createDataFrame([(i, java(r[names.index("regex")]), plainly(r[names.index("regex")]), *r) for i, r in enumerate(rows)] + [(-1, "", "", *[None] * len(names))] * flagged, f"ordinal int, _java string, _plain string, {schema}").drop("regex")
    return found.join(F.broadcast(table), "ordinal").where(F.expr("regexp_instr(_line, IF(_folds, _java, _plain)) > 0")).drop("_java", "_plain", "_folds")


def matches(files: DataFrame, rows: list[tuple], schema: str = RULE, flag: str | None = None) -> DataFrame:
    """files (path, text, ...) and rules of a schema that has regex -> a row for each rule and line that it matches: the
    files' columns but text, _pos, _line, ordinal and the rule's columns but regex. Files whose column `flag` is true
    give a row of ordinal -1, without a rule."""
    at = [x.split()[0] for x in schema.split(", ")].index("regex")
    groups = [needed(r[at]) for r in rows]
    tails = [tail(r[at], g[0][0]) if g and len(g[0]) == 1 else None for r, g in zip(rows, groups, strict=True)]
    made = candidates(files, groups, flag, tails)
    bare = [i for i, g in enumerate(groups) if not g or min(map(len, g[0])) < LEAST_LITERAL]
    if bare:
        any_ = F.lit(False)
        for i in bare[:50]:
            any_ = any_ | F.col("text").rlike(java(rows[i][at]))
        some = files.where(any_) if len(bare) <= 50 else files  # a text without a match of any has no line with one
        lines = some.select(*[c for c in files.columns if c != "text"], F.posexplode(S.lines_kept(F.col("text"))).alias("_pos", "_line")).withColumn("_folds", S.contains_any(F.col("_line"), FOLDING))
        made = made.unionByName(lines.withColumn("ordinal", F.explode(F.array(*map(F.lit, bare)))).withColumn("ordinal", F.col("ordinal").cast("int")))
    return _verified(made, rows, schema, flag is not None)


def prefilter_table(files: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """rules.prefilter() with the rules of a table (name, cwe, severity, category, regex), or the built-in ones: a row for
    each rule and line that is no comment. ordinal is a rule's place in the order of all columns (built-in: its own)."""
    rows = list(map(tuple, RULES)) if rules is None else collected(rules.select(*[x.split()[0] for x in RULE.split(", ")]))
    hits = matches(files, rows).where(~comment(F.col("_line")))
    return hits.select(*[c for c in files.columns if c != "text"], (F.col("_pos") + 1).alias("line"), "ordinal", "name", "cwe", "severity", "category")


def secrets_table(files: DataFrame, rules) -> DataFrame:
    """rules.secrets() with the rules of a table, or a list, of (name, regex, group): path, line, rule, secret for each match."""
    rows = collected(rules.select("name", "regex", F.col("group").cast("int").alias("group"))) if isinstance(rules, DataFrame) else [tuple(r) for r in rules]
    hits = matches(files.select("path", "text"), rows, "name string, regex string, group int")
    regexes = files.sparkSession.createDataFrame([(i, "(?d)" + r[1]) for i, r in enumerate(rows)], "ordinal int, _regex string")
    found = hits.join(F.broadcast(regexes), "ordinal").withColumn("secret", F.explode(F.expr("regexp_extract_all(_line, _regex, `group`)")))
    return found.select("path", (F.col("_pos") + 1).alias("line"), F.col("name").alias("rule"), "secret")
