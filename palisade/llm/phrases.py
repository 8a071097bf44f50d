"""Phrase collocation mining: which words stand together more often than their parts would have it, by language.

Texts are lower-cased (A-Z), split into pieces at punctuation and line ends and the pieces into words. The 1- to
max_n-grams of the pieces become DataFrame rows, which Spark aggregates by language and phrase; the counts of both
parts of each cut of a phrase are joined to it, the lowest-scoring cut is kept, phrases that a one-word extension nearly
always continues are anti-joined away (a longer one implies a one-word extension that is as frequent), and a window
ranks the rest. Scores are exact: products are Decimals, the quotient is an integral division.

No phrase is more frequent than its parts. So words are counted first, then pairs of words that both reach `least`, then
longer phrases all of whose pairs reach it; grams that cannot are not made rows. What reached it travels as a filter of
16 bits a gram and 2**FILTER_BITS at most: a gram that passes by chance is counted like others and goes by its count, so
the result is the same however full the filter is. Counts come from all documents, without samples or caps. A hot word
or pair is summed in each slice and each task before it is shuffled; joins read plain exchanges, whose skewed partitions
Spark splits; ranks are taken in SALTS groups of a language before they meet, `top` rows each.

Edge cases: null and empty texts have no words; a null language is `und`, also beside documents that say so; repeated
documents count each time; equal scores are ranked by frequency, then by the phrase's bytes; a language without
candidates and an empty table give no rows; very long texts are cut where a piece ends, so memory is bounded by the
longest piece; columns of the input with other names are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palisade.llm.kernels import Words, buffers, mix, slices
from palisade.llm.scratch import columns, materialise

MAX_N = 4
LEAST = 30
TOP = 2000
SCALE = 2_000_000
#: Per cent of a phrase's occurrences inside a longer one from which the longer one stands for it.
INSIDE = 80
#: Bits of the largest filter: 16 MB.
FILTER_BITS = 27
SALTS = 256
SLICE = 1 << 20

BREAK = np.zeros(256, bool)
BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
GAP = BREAK.copy()
GAP[[0x20, 0x09]] = True

_COUNTS = "lang string, phrase string, k int, c long"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Slices of texts (as bytes) and their languages; texts over twice SLICE are cut behind a break."""
    for b in slices(batches, most=SLICE):
        text, lang = b.column("text"), b.column("lang")
        data, _ = buffers(text)
        if len(data) <= 2 * SLICE:
            yield text, lang
            continue
        breaks, at = np.flatnonzero(BREAK[data]) + 1, 0  # the slice is one text
        while at < len(data):
            k = int(np.searchsorted(breaks, at + SLICE, "right"))
            end = len(data) if at + SLICE >= len(data) or not len(breaks) else int(breaks[k - 1])
            if end <= at:
                end = int(breaks[k]) if k < len(breaks) else len(data)
            yield pa.array([data[at:end].tobytes()], pa.large_binary()), lang
            at = end


class Grams:
    """The words of a slice as numbers, and runs of them within pieces as numbers made of those of their parts."""

    def __init__(self, text: pa.Array, lang: pa.Array):
        w = Words(text, lower=True, white=GAP)
        size = w.end - w.start
        border = np.concatenate(([0], np.cumsum(size)))
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(border), pa.py_buffer(w.data[w._black])]).dictionary_encode()
        langs = lang.dictionary_encode()
        self.words, self.langs = coded.dictionary.cast(pa.binary()), langs.dictionary
        row = w.row()
        self.lang = np.asarray(langs.indices)[row].astype(np.int64)
        code = np.asarray(coded.indices).astype(np.int64)
        breaks = np.concatenate(([0], np.cumsum(BREAK[w.data])))
        #: Whether a word and the next one are of the same piece.
        self.joined = (row[1:] == row[:-1]) & (breaks[w.start[1:]] == breaks[w.end[:-1]])
        self.code = code
        self.own = self.lang * max(1, len(self.words)) + code
        _, self.word_id = np.unique(self.own, return_inverse=True)
        self.n_words = int(self.word_id.max(initial=-1)) + 1

    def phrases(self, at: np.ndarray, k: int) -> tuple[pa.Array, pa.Array]:
        """The k-grams that begin at some words, and their languages."""
        out = pa.array([b""] * len(at), pa.binary()) if not len(self.words) else self.words.take(pa.array(self.code[at]))
        for i in range(1, k):
            out = pa.compute.binary_join_element_wise(out, self.words.take(pa.array(self.code[at + i])), b" ")
        return out.cast(pa.string()), self.langs.take(pa.array(self.lang[at]))

    def rows(self, k: int, at: np.ndarray, id_: np.ndarray) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray]:
        """A row for each k-gram of those that begin at `at` and have numbers id_; places of its first and its number."""
        _, first, inverse, count = np.unique(id_, return_index=True, return_inverse=True, return_counts=True)
        phrase, lang = self.phrases(at[first], k)
        batch = pa.RecordBatch.from_arrays([lang, phrase, pa.array(np.full(len(first), k, np.int32)), pa.array(count)], names=["lang", "phrase", "k", "c"])
        return batch, first, inverse


def _hashes(phrase: pa.Array, lang: pa.Array) -> np.ndarray:
    """Hashes of phrases, which aren't empty, in their languages, which may be."""
    whole = lambda a: Words(a, white=np.zeros(256, bool))
    langs = lang.dictionary_encode()
    own = np.zeros(len(langs.dictionary), np.uint64)
    spoken = whole(langs.dictionary)
    own[spoken.counts > 0] = spoken.hash
    return mix(whole(phrase).hash ^ mix(own[np.asarray(langs.indices)] + np.uint64(1)))


class Filter:
    """A set of bits; it never misses a gram that it was made of."""

    def __init__(self, words: np.ndarray):
        self.words, self.shift = words, np.uint64(64 - (len(words) * 64).bit_length() + 1)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        slot = hashes >> self.shift
        return (self.words[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) > 0


def make_filter(grams: DataFrame, most_bits: int = FILTER_BITS) -> Filter:
    """Of a written table of grams (lang, phrase). The driver gets 2**(most_bits - 6) numbers at most."""
    bits = min(most_bits, max(12, (16 * grams.count()).bit_length()))

    def slots(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array((_hashes(b.column("phrase"), b.column("lang")) >> np.uint64(64 - bits)).astype(np.int64))], names=["slot"])

    at = grams.select("lang", "phrase").mapInArrow(slots, "slot long").selectExpr("slot >> 6 AS at", "shiftleft(1L, CAST(slot & 63 AS INT)) AS bit")
    held = columns(at.groupBy("at").agg(F.bit_or("bit").alias("bits")))
    words = np.zeros(1 << (bits - 6), np.uint64)
    words[held["at"]] = held["bits"].view(np.uint64)
    return Filter(words)


def _count(texts: DataFrame, level: str, max_n: int, filters: list) -> DataFrame:
    """Counts by language and phrase: of words (and, without a phrase, of all of a language's words), of pairs, or of longer phrases."""

    def run(batches):
        has = [f.value.has for f in filters]
        for text, lang in _cut(batches):
            g = Grams(text, lang)
            here = np.arange(len(g.code))
            words, first, word = g.rows(1, here, g.word_id)
            if level == "words":
                yield words
                total = np.bincount(g.lang, minlength=len(g.langs))
                yield pa.RecordBatch.from_arrays([g.langs, pa.nulls(len(total), pa.string()), pa.array(np.zeros(len(total), np.int32)), pa.array(total)], names=["lang", "phrase", "k", "c"])
                continue
            may = has[0](_hashes(words.column("phrase"), words.column("lang")))[word]
            at = np.flatnonzero(g.joined & may[1:] & may[:-1])
            if not len(at):
                continue
            pairs, first, pair = g.rows(2, at, g.word_id[at] * g.n_words + g.word_id[at + 1])
            if level == "pairs":
                yield pairs
                continue
            keep = has[1](_hashes(pairs.column("phrase"), pairs.column("lang")))[pair]
            at, id_ = at[keep], pair[keep]
            ok = np.zeros(len(here) + 1, bool)
            ok[at] = True
            for k in range(3, max_n + 1):
                more = ok[at + k - 2]
                at, id_ = at[more], id_[more]
                if not len(at):
                    break
                batch, first, inverse = g.rows(k, at, id_ * g.n_words + g.word_id[at + k - 1])
                yield batch
                id_ = inverse

    return texts.mapInArrow(run, _COUNTS).groupBy("lang", "phrase", "k").agg(F.sum("c").alias("c"))


def frequent(docs: DataFrame, max_n: int = MAX_N, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """The 1- to max_n-grams that occur at least `least` times (lang, phrase, k, c), and the words of each language (lang, n)."""
    sc = docs.sparkSession.sparkContext
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    words = materialise(_count(texts, "words", max_n, []).where(F.col("phrase").isNull() | (F.col("c") >= least)), "words")
    tables, filters = [words.where("phrase IS NOT NULL")], []
    for level in ["pairs", "phrases"][: max_n - 1]:
        filters.append(sc.broadcast(make_filter(tables[-1])))
        tables.append(materialise(_count(texts, level, max_n, filters).where(F.col("c") >= least), level))
    out = tables[0]
    for t in tables[1:]:
        out = out.union(t)
    return out, words.where("phrase IS NULL").select("lang", F.col("c").alias("n"))


def collocations(docs: DataFrame, max_n: int = MAX_N, least: int = LEAST, top: int = TOP, scale: int = SCALE, inside: int = INSIDE) -> DataFrame:
    """The first `top` phrases of 2 to max_n words of each language: lang, rank, phrase, a, l, r, n, score."""
    counts, totals = frequent(docs, max_n, least)
    phrases = counts.where("k > 1").select("lang", "phrase", "k", F.col("c").alias("a"), F.split("phrase", " ").alias("w"))
    cuts = phrases.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "cut", F.array_join(F.slice("w", F.lit(1), F.col("cut")), " ").alias("head"), F.array_join(F.slice("w", F.col("cut") + 1, F.col("k") - F.col("cut")), " ").alias("tail"))
    of = lambda part, name: counts.select("lang", F.col("phrase").alias(part), F.col("c").alias(name))
    scored = cuts.join(of("head", "l"), ["lang", "head"]).join(of("tail", "r"), ["lang", "tail"])
    exact = f"CAST(a AS DECIMAL(20, 0)) * {scale} DIV (CAST(l AS DECIMAL(20, 0)) + CAST(r AS DECIMAL(20, 0)))"
    lowest = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct(F.expr(exact).alias("score"), "cut", "l", "r")).alias("x"))
    # both phrases of one word less in each longer one; the most frequent longer one decides
    parts = phrases.where("k > 2").select("lang", F.col("a").alias("longer"), F.explode(F.array(F.expr("array_join(slice(w, 1, k - 1), ' ')"), F.expr("array_join(slice(w, 2, k - 1), ' ')"))).alias("phrase"))
    parts = parts.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    own, part = lowest.alias("own"), parts.alias("part")
    held = F.expr(f"own.lang = part.lang AND own.phrase = part.phrase AND CAST(part.longer AS DECIMAL(20, 0)) * 100 >= CAST(own.a AS DECIMAL(20, 0)) * {inside}")
    kept = own.join(part, held, "left_anti").select("lang", "phrase", "a", "x.score", "x.l", "x.r")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM t),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, (VALUES (1), (2), (3), (4)) v(k) WHERE len(w) >= k)),
f AS (SELECT lang, phrase, k, count(*) AS c FROM g GROUP BY lang, phrase, k),
n AS (SELECT lang, CAST(sum(c) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
cand AS (SELECT lang, phrase, k, c AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND c >= 30),
cut AS (SELECT *, array_to_string(w[1:j], ' ') AS head, array_to_string(w[j + 1:], ' ') AS tail FROM (SELECT *, unnest(range(1, k)) AS j FROM cand)),
s AS (SELECT cut.lang, cut.phrase, a, j, h.c AS l, r.c AS r, 2000000::HUGEINT * a // (h.c + r.c) AS score FROM cut JOIN f h ON h.lang = cut.lang AND h.phrase = head JOIN f r ON r.lang = cut.lang AND r.phrase = tail),
m AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
o AS (SELECT lang, a AS b, k, w, unnest(range(2, k)) AS size FROM cand WHERE k > 2),
i AS (SELECT DISTINCT lang, b, array_to_string(w[x:x + size - 1], ' ') AS phrase FROM (SELECT *, unnest(range(1, k - size + 2)) AS x FROM o)),
kept AS (SELECT * FROM m WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.lang = m.lang AND i.phrase = m.phrase AND 100::HUGEINT * i.b >= 80::HUGEINT * m.a)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""
