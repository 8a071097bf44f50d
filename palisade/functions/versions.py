"""Versions as keys that sort in the order of their ecosystem, in SQL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ecosystems whose versions are semantic ones, those of Debian's and of rpm's tools, and words of versions before a release in their order.
SEMANTIC = ("npm", "go", "crates.io", "cargo", "nuget", "pub", "hex", "swifturl", "julia")
DPKG = ("debian", "ubuntu")
RPM = ("red hat", "rocky linux", "almalinux", "centos", "fedora", "oracle linux", "amazon linux", "opensuse", "suse", "mageia", "openeuler")
BEFORE = {"dev": "10", "a": "11", "alpha": "11", "b": "12", "beta": "12", "m": "125", "milestone": "125", "c": "13", "rc": "13", "cr": "13", "pre": "13", "preview": "13", "snapshot": "14"}


def _number(x: Column) -> Column:
    return F.concat(F.lit("5"), F.lpad(F.regexp_replace(x, "^0+(?=.)", ""), 24, "0"))


def dpkg_key(version: Column) -> Column:
    """Arrays of strings that compare as Debian's tools compare versions: epoch, upstream version, revision; in both runs of
    other characters and of digits in turn, digits as numbers, a tilde before the end, the end before letters, letters
    before all else. A version without a revision has revision 0."""
    v = F.trim(version)
    epoch, rest = F.regexp_extract(v, r"^(\d+):", 1), F.regexp_replace(v, r"^\d+:", "")
    revision = F.regexp_extract(rest, "-([^-]*)$", 1)

    def part(x: Column) -> Column:
        code = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_extract(x, r"^(\D*)", 1), "([^A-Za-z~])", "3$1"), "([A-Za-z])", "2$1"), "~", "0~")
        return F.array(F.concat(code, F.lit("1")), _number(F.regexp_extract(x, r"(\d*)$", 1)))

    keys = [F.flatten(F.transform(F.regexp_extract_all(x, F.lit(r"\D*\d*"), F.lit(0)), part)) for x in (F.regexp_replace(rest, "-[^-]*$", ""), F.when(revision == "", "0").otherwise(revision))]
    return F.concat(F.array(_number(F.when(epoch == "", "0").otherwise(epoch))), *keys)


def version_key(version: Column, ecosystem: Column) -> Column:
    """Arrays of strings that compare as the versions of an ecosystem do. Debian's and Ubuntu's are dpkg_key()'s. Others:
    epochs first, numbers as numbers, a tilde before the release, words after it. Words such as alpha sort before the
    release (in Alpine's only behind an underscore, never in rpm's), and trailing zeros of a release don't count (but in rpm's)."""
    family = F.lower(F.substring_index(ecosystem, ":", 1))
    return F.when(family.isin(*DPKG), dpkg_key(version)).otherwise(_general_key(version, ecosystem, family))


def _general_key(version: Column, ecosystem: Column, family: Column) -> Column:
    semantic, rpm = F.lower(ecosystem).isin(*SEMANTIC), family.isin(*RPM)
    v = F.regexp_replace(F.lower(F.trim(version)), r"^[v=]+", "")
    marked = lambda before: F.regexp_replace(v, rf"{before}({'|'.join(BEFORE)})(?![a-z])", "<$1")
    v = F.when(semantic, F.regexp_replace(v, r"\+.*$", "")).when(rpm, v).when(family == "alpine", marked("_")).otherwise(marked("[-._]?"))
    epoch = F.regexp_extract(v, r"^(\d+)[:!]", 1)
    rest = F.regexp_replace(v, r"^\d+[:!]", "")
    rest = F.when(rpm, rest).otherwise(F.regexp_replace(rest, r"^(\d+(?:\.\d+)*?)(?:\.0+)+(?![.\d])", "$1"))
    number = _number

    def token(x: Column) -> Column:
        out = F.when(x.rlike(r"^\d"), number(x)).when(x == "~", "0").when(x == "-", F.when(semantic, "1").otherwise("35")).when(x == "^", "34")
        for word, key in BEFORE.items():
            out = out.when(x == "<" + word, key)
        return out.otherwise(F.concat(F.when(semantic, "6").otherwise("4"), x))

    tokens = F.transform(F.regexp_extract_all(rest, F.lit(r"(\d+|<?[a-z]+|[~^-])"), F.lit(1)), token)
    return F.concat(F.array(number(F.when(epoch == "", "0").otherwise(epoch))), tokens, F.array(F.lit("3")))


def range_keys(packages: Column, ecosystem: Column, introduced: bool) -> Column:
    """The ranges of an advisory's affected packages as arrays of events (at, opens) with the keys of their versions.
    introduced: events have that field; else a range begins with the first version."""

    def keyed(r: Column) -> Column:
        kind = lambda e, name: F.coalesce(e[name], F.lit(""))
        start = lambda e: kind(e, "introduced") if introduced else F.lit("")
        events = F.filter(r["events"], lambda e: (start(e) != "") | (kind(e, "fixed") != ""))
        key = lambda e: F.when(start(e) == "0", F.array(F.lit(""))).otherwise(version_key(F.when(start(e) != "", start(e)).otherwise(kind(e, "fixed")), ecosystem))
        return F.transform(events, lambda e: F.struct(key(e).alias("at"), (start(e) != "").alias("opens")))

    return F.transform(F.flatten(F.transform(packages, lambda a: F.coalesce(a["ranges"], F.array()))), keyed)


def affected(own: Column, ranges: Column, introduced: bool) -> Column:
    """Whether a version, by its key, is in one of the ranges of range_keys(): the last event at or before it opens one."""

    def hit(events: Column) -> Column:
        last = F.array_max(F.filter(events, lambda e: e["at"] <= own))
        return F.coalesce(last["opens"], F.lit(not introduced) & (F.size(events) > 0))

    return F.exists(ranges, hit)
