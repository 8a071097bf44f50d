"""Fill-in-middle transformation: documents cut into prefix, middle and suffix at unit borders and put in another order.

A Split pre-tokenizer of the tokenizers library isolates the units (lines by default) and gives their offsets in code
points; nothing is trained. The number of offsets is n, and the places that a document's own hash ranks among them cut
the text in three. Documents are read once, never shuffled, and a row depends on its own id and text alone, so lost
tasks repeat with the same result. Texts over PIECE code points are handed to the pre-tokenizer in pieces that end at a
seam, behind which its matches start anew whatever stands before, so its memory is bounded by PIECE and the longest unit.

Edge cases: null and empty texts are plain, with no units; a text that holds a sentinel is plain, so every output can
be undone; a text of one unit may leave any of the three parts empty; a null id hashes as an empty one; repeated rows
give equal rows; an empty table gives none; other columns of the input, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm.kernels import slices

LINES = r"[^\n]*\n|[^\n]+"
SEAM = "\n"
PIECE = 1 << 20
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = "7"
#: Per cent of the texts that are transformed, and of those that take the order suffix, prefix, middle.
RATE, SPM_RATE = 100, 50

SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


class Units:
    """Ends of a text's units, in code points."""

    def __init__(self, pattern: str = LINES, seam: str | None = SEAM, piece: int = PIECE):
        from tokenizers import Regex
        from tokenizers.pre_tokenizers import Split

        self.split, self.seam, self.piece = Split(Regex(pattern), "isolated"), seam, piece

    def _pieces(self, text: str) -> Iterator[tuple[int, str]]:
        at = 0
        while self.seam and len(text) - at > self.piece:
            end = text.rfind(self.seam, at, at + self.piece) + 1 or text.find(self.seam, at + self.piece) + 1
            if not end:
                break
            yield at, text[at:end]
            at = end
        yield at, text[at:] if at else text

    def ends(self, text: str) -> list[int]:
        return [at + end for at, piece in self._pieces(text) for _, (_, end) in self.split.pre_tokenize_str(piece)]


def draws(doc_id: int | None, seed: str = SEED) -> tuple[int, int, int, int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))


def transform(doc_id: int | None, text: str, units: Units, rate: int = RATE, spm_rate: int = SPM_RATE, seed: str = SEED) -> tuple[int, str, int | None, int | None, str]:
    """n, form, code points of prefix and middle, output."""
    ends = units.ends(text)
    n = len(ends)
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or h3 % 100 >= rate or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (ends[i - 1] if i else 0 for i in (low, high))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm_rate:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def restore(output: str, form: str) -> str:
    """The text that an output was made of."""
    if form == "plain":
        return output
    rest, middle = output.split(MIDDLE)
    if form == "psm":
        prefix, suffix = rest.removeprefix(PREFIX).split(SUFFIX)
    else:
        suffix, prefix = rest.removeprefix(SUFFIX).split(PREFIX)
    return prefix + middle + suffix


def fill_in_middle(docs: DataFrame, pattern: str = LINES, seam: str | None = SEAM, rate: int = RATE, spm_rate: int = SPM_RATE, seed: str = SEED) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output of each row of docs, which has doc_id and text. `seam` is a
    character behind which matches of `pattern` always start anew; None if there is none."""

    def run(batches):
        units = Units(pattern, seam)
        for b in slices(batches):
            rows = [(d, *transform(d, t, units, rate, spm_rate, seed)) for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True)]
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.mapInArrow(run, SCHEMA)


def restored(rows: DataFrame) -> DataFrame:
    """rows of fill_in_middle() with the column text, rebuilt from output and form, in place of output."""

    def run(batches):
        for b in slices(batches, "output"):
            text = [restore(o, f) for o, f in zip(b.column("output").to_pylist(), b.column("form").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in b.schema.names if c != "output"), pa.array(text, pa.string())], names=[*(c for c in b.schema.names if c != "output"), "text"])

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "output"]
    return rows.mapInArrow(run, ", ".join([*kept, "text string"]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumn("output_sha256", F.sha2("output", 256))
    return restored(made).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", F.sha2("text", 256).alias("restored_sha256"))


SQL = r"""
WITH d AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS units, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
             CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT *, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS low, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS high,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(units[1:low], '') AS pre, array_to_string(units[low + 1:high], '') AS mid, array_to_string(units[high + 1:], '') AS suf FROM c)
SELECT doc_id, CAST(len(units) AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(text) AS restored_sha256
FROM p
"""
