"""LM scoring with a weighted backoff automaton.

Words that training documents hold LEAST times are letters of their own; all others are letters by shape (accents,
length, how they end), and a rare word's probability is its letter's times its own share of the letter's tokens, with a
share for unseen words. Letter trigrams and bigrams are kept from LEAST training occurrences, whatever the corpus's
size, and smoothed by absolute discounting. Contexts become states; what a context doesn't list follows its failure arc
to the next shorter one at the cost of its backoff weight. A document's log-probability is accumulated in one
left-to-right traversal that carries the state; the documents of a block are traversed in step.

Nothing of the model is held in one place. Texts are dealt once to blocks, which keep them as numbers of their own
distinct words. Then come four rounds, in each of which every block sends what it counts, packed by shards of the hashes
and in their order, and gets back what the shards have summed, place by place: words; bigrams; trigrams of kept bigrams,
with each letter's discounted counts after it; then those after each bigram. From these a block builds the states and
arcs of the automaton that its own documents can reach. A block sends each gram once, however often it holds it, so a
frequent gram is a few bytes of each block. Blocks and shards are of bounded size; their number grows with the corpus.

Edge cases: null and empty texts are the end token alone; a row without an id is trained on, scored and keeps its null;
without training documents every count is 0; repeated rows count and are scored as often as they occur; very long texts
are traversed whole; an empty table gives no row; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm.kernels import Words, crc_of_id, groups, mix, slices, trim
from palisade.llm.packed import deal, gathered, pack, small, unpack
from palisade.llm.ranges import Blocks, even_keys
from palisade.llm.scratch import discard, materialise, release

HELD_OUT = 10
ADD = 0.1
#: Training occurrences that make a word a letter and that an n-gram needs, at every size of the corpus.
LEAST = 2
DISCOUNT = 0.75
BLOCK_BYTES = 8 << 20
#: Letters that a document is traversed in one go; the state in which the next ones begin follows from the two before.
PIECE = 256
#: Grams, counted once per block, of a shard, and bytes of text that have one at least.
SHARD_GRAMS = 2_000_000
GRAM_BYTES = 5

SHAPES = 17 * 5 * 4
#: Letters: shapes, then the end, then the start, then frequent words.
END, START, FIRST_WORD = SHAPES, SHAPES + 1, SHAPES + 2

_KIND = np.zeros(256, np.int64)
_KIND[[ord(".")]] = 1
_KIND[[ord(x) for x in ",;:"]] = 2
_KIND[[x for x in range(33, 127) if not chr(x).isalnum() and chr(x) not in ".,;:"]] = 3
_KIND[[ord(x) for x in "0123456789"]] = 4


def shapes(w: Words) -> np.ndarray:
    """The shape of each word: its first non-ASCII letter, how it ends, how long it is."""
    accents = np.flatnonzero(w.data >= 0x80)
    at = np.searchsorted(accents, w.start)
    first = np.append(accents, len(w.data))[at]
    has = first < w.end
    accent = np.where(has, 1 + (np.append(w.data, [0, 0])[np.minimum(first + 1, len(w.data))] & 15), 0).astype(np.int64)
    size = np.digitize(w.end - w.start, (4, 7, 11))
    return (accent * 5 + _KIND[w.data[w.end - 1]]) * 4 + size if len(w.start) else np.zeros(0, np.int64)


def _held_out(ids: pa.Array) -> np.ndarray:
    return (crc_of_id(np.asarray(ids.fill_null(0))) % HELD_OUT == 0) & np.asarray(ids.is_valid())


PACKED = "shard int, block int, kind int, data binary, sums array<long>"
#: Kinds of packed rows: a block's documents, words, bigrams, discounted counts after letters, trigrams, discounted counts
#: after bigrams, and a shard's totals of words by shape.
DOCUMENTS, WORD, BIGRAM, AFTER_LETTER, TRIGRAM, AFTER_BIGRAM, TOTALS = range(7)
#: Bits of a gram's hash that aren't sent: of 10 billion grams, one in some 7 million shares the other 56 with another.
UNUSED = np.uint64(8)
#: Discounted counts are sent as whole numbers of quarters.
QUARTERS = 4
#: Bits of a letter's number in a block's own keys.
WIDE = 31
_BIGRAM, _TRIGRAM = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _rows(rows: list[tuple]) -> pa.Table:
    shard, block, kind, data, sums = zip(*rows, strict=True) if rows else ((), (), (), (), ())
    return pa.table([pa.array(shard, pa.int32()), pa.array(block, pa.int32()), pa.array(kind, pa.int32()), pa.array(data, pa.binary()), pa.array(sums, pa.list_(pa.int64()))], names=["shard", "block", "kind", "data", "sums"])


def _sent_bits(kind: int, h: np.ndarray) -> np.ndarray:
    return h if kind == WORD else h >> UNUSED


def _send(shards: np.ndarray, block: int, kind: int, h: np.ndarray, value: np.ndarray, shape: np.ndarray | None = None) -> list[tuple]:
    """Rows of distinct hashes and values for the shards that have them, in order. shards: their keys."""
    h = _sent_bits(kind, h)
    order = np.argsort(h, kind="stable")
    h, value = h[order], value[order]
    top = h >> np.uint64(32 if kind == WORD else 32 - int(UNUSED))
    start, size = groups((top * np.uint64(len(shards)) >> np.uint64(32)).astype(np.int64))
    at = (top[start] * np.uint64(len(shards)) >> np.uint64(32)).astype(np.int64)
    out = []
    for shard, i, n in zip(at.tolist(), start.tolist(), size.tolist(), strict=True):
        data = {"h": h[i : i + n], "n": small(value[i : i + n])}
        if shape is not None:
            data["s"] = shape[order[i : i + n]].astype(np.uint16)
        out.append((int(shards[shard]), block, kind * len(shards) + shard, pack(data), None))
    return out


def _sum_shard(count: int):
    """To each block the sums of its grams, place by place: all words; grams of LEAST training occurrences, one block of
    each marked; discounted counts above 0. count: how many shards there are."""

    def run(key, rows):
        out = []
        where = np.asarray(rows["kind"])
        for kind in np.unique(where // count):
            own = np.flatnonzero(where // count == kind)
            blocks = rows["block"].take(own).to_pylist()
            parts = [unpack(rows["data"][int(i)].as_py()) for i in own]
            # several shards may have one key
            h = np.concatenate([p["h"] for p in parts])
            value = np.concatenate([p["n"].astype(np.int64) for p in parts])
            order = np.argsort(h, kind="stable")
            start, size = groups(h[order])
            each = np.add.reduceat(value[order], start) if len(start) else value
            total, mark = np.empty(len(h), np.int64), np.zeros(len(h), bool)
            total[order] = np.repeat(each, size)
            mark[order[start]] = True
            if kind == WORD:
                shape = np.concatenate([p["s"] for p in parts])[order[start]].astype(np.int64)
                often = each >= LEAST
                once = (each > 0) & ~often
                sums = [np.bincount(shape[x], w[x], SHAPES) for x, w in ((often, each), (often, np.ones(len(each))), (once, each), (once, np.ones(len(each))))]
                out.append((0, -1, TOTALS, b"", np.concatenate(sums).astype(np.int64).tolist()))
            kept = total >= LEAST if kind in (BIGRAM, TRIGRAM) else total > 0
            at = 0
            for i, block, part in zip(own, blocks, parts, strict=True):
                n = len(part["h"])
                has = kept[at : at + n]
                answer = {"size": np.array([n]), "has": np.packbits(has), "n": small(total[at : at + n][has])}
                if kind in (BIGRAM, TRIGRAM):
                    answer["mark"] = np.packbits(mark[at : at + n][has])
                at += n
                out.append((int(where[i] % count), block, int(kind), pack(answer), None))
        return _rows(out)

    return run


class Block:
    """The documents of a block as letters, and what the rounds so far have given for its grams."""

    def __init__(self, rows: pa.Table):
        kinds, shards = np.asarray(rows["kind"]), np.asarray(rows["shard"])
        at = np.lexsort((shards, kinds))
        self.got = {k: [unpack(rows["data"][int(i)].as_py()) for i in at[kinds[at] == k]] for k in range(TOTALS)}
        self.docs = self.got[DOCUMENTS][0]

    def spell(self) -> None:
        """Words become letters, documents sequences of bigrams."""
        d = self.docs
        self.word_count = self.given(WORD, d["word"])[0]
        often = self.word_count >= LEAST
        letter_of = np.where(often, FIRST_WORD + np.cumsum(often) - 1, d["shape"].astype(np.int64))
        own = letter_of[d["own"]]
        self.hashes = np.concatenate((mix(np.arange(1, FIRST_WORD + 1, dtype=np.uint64)), d["word"][often]))
        self.counts = self.word_count[often]
        self.own, self.size = own, len(self.hashes)
        # each row: two starts, its letters, the end
        counts = d["counts"].astype(np.int64)
        size = counts + 3
        first = np.cumsum(size) - size
        c = np.full(int(size.sum()), START, np.int64)
        ends = np.cumsum(counts)
        c[np.arange(len(own)) + np.repeat(first + 2 - (ends - counts), counts)] = own
        c[first + size - 1] = END
        at = np.ones(len(c), bool)
        at[first] = at[first + 1] = False
        at = np.flatnonzero(at)
        self.train = np.repeat(~d["held"], counts + 1)
        begins = np.cumsum(counts + 1) - (counts + 1)
        self.last = c[at].astype(np.int32)
        key = c[at - 1] << WIDE | c[at]
        del c, at
        self.pairs, pair = np.unique(key, return_inverse=True)
        del key
        # the bigram before each; the last one stands for two starts
        pair = pair.astype(np.int32)
        before = np.concatenate((pair[:1], pair[:-1]))
        before[begins] = len(self.pairs)
        self.pair, self.before = pair, before
        a, b = self.pairs >> WIDE, self.pairs & ((1 << WIDE) - 1)
        self.a, self.b = a, b
        self.hash = np.append(mix(mix(self.hashes[a] ^ _BIGRAM) + self.hashes[b]), mix(mix(self.hashes[START : START + 1] ^ _BIGRAM) + self.hashes[START]))

    def given(self, kind: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums and marks of the hashes that were sent, 0 of those that were not kept."""
        total, mark = np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        order = np.argsort(_sent_bits(kind, h), kind="stable")
        at = 0
        for part in self.got[kind]:
            n = int(part["size"][0])
            own = order[at : at + n][np.unpackbits(part["has"], count=n).astype(bool)]
            total[own] = part["n"]
            if "mark" in part:
                mark[own] = np.unpackbits(part["mark"], count=len(own)).astype(bool)
            at += n
        return total, mark

    def bigrams(self) -> tuple[np.ndarray, np.ndarray]:
        return self.given(BIGRAM, self.hash[:-1])

    def trigrams(self, n2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bigram before, bigram of the last two letters, hash and training occurrences of the trigrams that can be kept."""
        can = np.append(n2 > 0, True)
        can = np.flatnonzero(can[self.before] & can[self.pair])
        key, one, inverse = np.unique(self.before[can].astype(np.int64) << WIDE | self.last[can], return_index=True, return_inverse=True)
        before, pair = self.before[can][one], self.pair[can][one]
        n = np.bincount(inverse, self.train[can], len(key)).astype(np.int64)
        return before, pair, mix(mix(self.hash[before] ^ _TRIGRAM) + self.hashes[self.b[pair]]), n


def _discounted(n: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """Quarters of the discounted counts of marked grams."""
    return np.where(mark, n * QUARTERS - int(DISCOUNT * QUARTERS), 0)


def _words_round(block: Block, shards: np.ndarray, key: int) -> list[tuple]:
    d = block.docs
    return _send(shards, key, WORD, d["word"], d["n"].astype(np.int64), d["shape"])


def _bigram_round(block: Block, shards: np.ndarray, key: int) -> list[tuple]:
    block.spell()
    return _send(shards, key, BIGRAM, block.hash[:-1], np.bincount(block.pair, block.train, len(block.pairs)).astype(np.int64))


def _trigram_round(block: Block, shards: np.ndarray, key: int) -> list[tuple]:
    block.spell()
    n2, mark = block.bigrams()
    after = np.bincount(block.a, _discounted(n2, mark), block.size).astype(np.int64)
    _, _, h, n = block.trigrams(n2)
    return _send(shards, key, AFTER_LETTER, block.hashes, after) + _send(shards, key, TRIGRAM, h, n)


def _last_round(block: Block, shards: np.ndarray, key: int) -> list[tuple]:
    block.spell()
    n2, _ = block.bigrams()
    before, _, h, _ = block.trigrams(n2)
    n3, mark = block.given(TRIGRAM, h)
    after = np.bincount(before, _discounted(n3, mark), len(block.hash)).astype(np.int64)
    used = np.flatnonzero(np.append(n2 > 0, True))
    return _send(shards, key, AFTER_BIGRAM, block.hash[used], after[used])


class Automaton:
    """States: 0 is the empty context, 1 + letter a context of one letter, then contexts of two. Arcs are sorted by
    state << bits | letter."""

    bits = 16

    @classmethod
    def part(cls, block: Block, tokens: int, letters: int, documents: int, shape_tokens: np.ndarray) -> Automaton:
        """The states and arcs that a block's documents can reach, of the automaton of all training documents."""
        self = cls.__new__(cls)
        self.bits, self.size = WIDE, block.size
        count = np.concatenate((shape_tokens, [documents, 0], block.counts)).astype(np.float64)
        p1 = (count + ADD) / (tokens + ADD * letters)
        p1[START] = 1e-300
        self.root = np.log10(p1)
        context = count.copy()
        context[START], context[END] = documents, 0
        rest1 = 1 - block.given(AFTER_LETTER, block.hashes)[0] / QUARTERS / np.maximum(context, 1)

        n2, _ = block.bigrams()
        a, b = block.a, block.b
        p2 = np.where(n2 > 0, (n2 - DISCOUNT) / np.maximum(context[a], 1), 0) + rest1[a] * p1[b]
        kept = np.flatnonzero(n2 > 0)

        total = np.append(n2, documents)
        used = np.flatnonzero(np.append(n2 > 0, True))
        after = np.zeros(len(total))
        after[used] = block.given(AFTER_BIGRAM, block.hash[used])[0] / QUARTERS
        own = np.flatnonzero(after > 0)
        state = np.append(1 + b, 1 + START)  # of each bigram
        state[own] = 1 + self.size + np.arange(len(own))
        rest2 = 1 - after / np.maximum(total, 1)
        before, pair, h, _ = block.trigrams(n2)
        n3, _ = block.given(TRIGRAM, h)
        three = np.flatnonzero(n3 > 0)
        before, pair, n3 = before[three], pair[three], n3[three]
        p3 = (n3 - DISCOUNT) / total[before] + rest2[before] * p2[pair]

        self.fail = np.concatenate(([0], np.zeros(self.size, np.int64), np.append(1 + b, 1 + START)[own])).astype(np.int64)
        self.weight = np.log10(np.maximum(np.concatenate(([1.0], rest1, rest2[own])), 1e-300))
        arc = np.concatenate(((1 + a[kept]) << WIDE | b[kept], state[before] << WIDE | b[pair]))
        order = np.argsort(arc)
        self.arc, self.cost = arc[order], np.log10(np.concatenate((p2[kept], p3)))[order]
        self.next = np.concatenate((state[kept], state[pair]))[order]
        if not len(self.arc):
            self.arc, self.cost, self.next = np.array([-1]), np.zeros(1), np.zeros(1, np.int64)
        self._start = int(state[-1])
        return self

    def __init__(self, size: int, documents: int, letters: dict[int, int], bigrams: tuple[np.ndarray, np.ndarray], trigrams: tuple[np.ndarray, np.ndarray]):
        count = np.zeros(size)
        count[list(letters)] = list(letters.values())
        possible = np.ones(size, bool)
        possible[START] = False
        p1 = np.where(possible, (count + ADD) / (count.sum() + ADD * possible.sum()), 1e-300)
        self.root = np.log10(p1)
        context = count.copy()
        context[START], context[END] = documents, 0

        k2, n2 = bigrams
        a2, c2 = k2 >> 16, k2 & 0xFFFF
        p2 = (n2 - DISCOUNT) / np.maximum(context[a2], 1)
        rest1 = 1 - np.bincount(a2, p2, size)
        p2 = p2 + rest1[a2] * p1[c2]

        k3, n3 = trigrams
        pair, c3 = k3 >> 16, k3 & 0xFFFF
        self.pairs, owner = np.unique(pair, return_inverse=True)
        total = np.zeros(len(self.pairs))
        starts = self.pairs == (START << 16 | START)
        total[starts] = documents
        if len(k2):
            total[~starts] = n2[np.searchsorted(k2, self.pairs[~starts])]
        p3 = (n3 - DISCOUNT) / np.maximum(total[owner], 1)
        rest2 = 1 - np.bincount(owner, p3, len(self.pairs))
        lower = np.searchsorted(k2, k3 & 0xFFFFFFFF)
        # a kept trigram's last two letters are a kept bigram
        p3 = p3 + rest2[owner] * p2[lower] if len(k3) else p3

        self.fail = np.concatenate(([0], np.zeros(size, np.int64), 1 + (self.pairs & 0xFFFF))).astype(np.int64)
        self.weight = np.log10(np.maximum(np.concatenate(([1.0], rest1, rest2)), 1e-300))
        one = (1 + a2) << 16 | c2
        two = (1 + size + owner) << 16 | c3
        self.arc = np.concatenate([one, two])
        self.cost = np.log10(np.concatenate([p2, p3]))
        self.size = size
        self._start = int(self._context(np.array([START << 16 | START]))[0])
        self.next = self._context(np.concatenate([k2, k3 & 0xFFFFFFFF]))
        if not len(self.arc):
            self.arc, self.cost, self.next = np.array([-1]), np.zeros(1), np.zeros(1, np.int64)

    def _context(self, pair: np.ndarray) -> np.ndarray:
        """The longest context state of a letter and the one before."""
        if not len(self.pairs):
            return 1 + (pair & 0xFFFF)
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        return np.where(self.pairs[at] == pair, 1 + self.size + at, 1 + (pair & 0xFFFF))

    def start(self) -> int:
        return self._start

    def step(self, state: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """States after reading a letter in each state, and the log10 probabilities."""
        score = np.zeros(len(state))
        after = 1 + letter
        open_ = np.arange(len(state))
        s = state
        while len(open_):
            done = s == 0
            if done.any():
                score[open_[done]] += self.root[letter[open_[done]]]
                open_, s = open_[~done], s[~done]
            key = s << self.bits | letter[open_]
            at = np.minimum(np.searchsorted(self.arc, key), len(self.arc) - 1)
            hit = self.arc[at] == key
            score[open_[hit]] += self.cost[at[hit]]
            after[open_[hit]] = self.next[at[hit]]
            open_, s = open_[~hit], s[~hit]
            score[open_] += self.weight[s]
            s = self.fail[s]
        return after, score

    def scores(self, letters: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Log10 probability of each row of letters and its end. Rows are traversed in step, in pieces of PIECE letters."""
        rows = np.diff(first)
        pieces = np.maximum(1, -(-rows // PIECE))
        row = np.repeat(np.arange(len(rows)), pieces)
        place = (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * PIECE
        begin, size = first[:-1][row] + place, np.minimum(PIECE, rows[row] - place)
        order = np.argsort(-size, kind="stable")
        begin, size, place = begin[order], size[order], place[order]
        state = np.full(len(order), self.start(), np.int64)
        later = np.flatnonzero(place > 0)
        if len(later):
            two = begin[later, None] - [2, 1]
            state[later], _ = self.step(1 + letters[two[:, 0]].astype(np.int64), letters[two[:, 1]].astype(np.int64))
        live = np.searchsorted(-size, -np.arange(int(size.max(initial=0))), "left")  # pieces longer than t
        total = np.zeros(len(order))
        for t, n in enumerate(live):
            state[:n], got = self.step(state[:n], letters[begin[:n] + t].astype(np.int64))
            total[:n] += got
        last = np.flatnonzero(place + size == rows[row[order]])
        _, got = self.step(state[last], np.full(len(last), END))
        total[last] += got
        return np.bincount(row[order], total, len(rows))


class Totals:
    """Totals of the training documents: tokens with ends, distinct words with the end, letters, rows, and the tokens and
    distinct words of each shape that are not letters of their own."""

    def __init__(self, tokens: int, words: int, letters: int, documents: int, rare_tokens: np.ndarray, rare_words: np.ndarray):
        self.tokens, self.words, self.letters, self.documents = tokens, words, letters, documents
        self.rare_tokens = rare_tokens
        self.rare = np.log10(np.maximum(rare_tokens + ADD * (rare_words + 1), ADD))


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _read(key, docs):
    """Texts of a block -> its documents as numbers of its distinct words, the most frequent first."""
    key = int(np.asarray(docs["block"])[0])
    docs = gathered(docs)
    hashes, shape, counts = [], [], []
    for b in slices(docs.combine_chunks().to_batches()):
        w = Words(b.column("text"), lower=True)
        hashes.append(w.hash)
        shape.append(shapes(w).astype(np.uint16))
        counts.append(w.counts)
    hashes, shape, counts = (np.concatenate(x) for x in (hashes, shape, counts))
    ids = docs["doc_id"].combine_chunks()
    held = _held_out(ids)
    word, one, own, n = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
    train = np.bincount(own, np.repeat(~held, counts), len(word)).astype(np.int64)
    order = np.argsort(-n, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    data = {"id": np.asarray(ids.fill_null(0)), "null": ~np.asarray(ids.is_valid()), "held": held, "counts": small(counts), "own": small(rank[own]), "word": word[order], "shape": shape[one][order], "n": small(train[order])}
    return _rows([(0, key, DOCUMENTS, pack(data), None)])


def _round(step, shards):
    def run(key, rows):
        out = _rows(step(Block(rows), shards.value, key[0].as_py()))
        trim()
        return out

    return run


def _score(totals):
    def run(key, rows):
        m: Totals = totals.value
        block = Block(rows)
        block.spell()
        d = block.docs
        counts = d["counts"].astype(np.int64)
        first = np.concatenate(([0], np.cumsum(counts)))
        # of each word: its base score, the share of a rare one in its letter, whether it is known
        log = np.log10(block.word_count + ADD)
        share = np.where(block.word_count < LEAST, log - m.rare[d["shape"]], 0)
        base, share, seen = (np.diff(np.concatenate(([0], np.cumsum(x[d["own"]])))[first]) for x in (log, share, (block.word_count > 0).astype(np.int64)))
        base += np.log10(m.documents + ADD) - np.log10(m.tokens + ADD * (m.words + 1)) * (counts + 1)
        got = Automaton.part(block, m.tokens, m.letters, m.documents, m.rare_tokens).scores(block.own, first)
        ids = pa.array(d["id"], pa.int64(), mask=d["null"])
        return pa.table([ids, pa.array(d["held"]), counts + 1, seen + (m.documents > 0), np.full(len(got), m.tokens), base, got + share], names=[x.split()[0] for x in RESULT.split(", ")])

    return run


def train_and_score(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    blocks = Blocks(texts, BLOCK_BYTES)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % HELD_OUT == 0, F.lit(False))
    documents = texts.where(~held_out).count()
    # a block sends a gram of each token at most
    count = max(parts, -(-blocks.total // (GRAM_BYTES * SHARD_GRAMS)))
    shards = sc.broadcast(even_keys(spark, count, parts))

    held = materialise(deal(texts, blocks).groupBy("block").applyInArrow(_read, PACKED), "blocks")
    totals = None
    for step in (_words_round, _bigram_round, _trigram_round, _last_round):
        release(spark)
        sent = held.groupBy("block").applyInArrow(_round(step, shards), PACKED)
        summed = materialise(sent.groupBy("shard").applyInArrow(_sum_shard(count), PACKED), "sums")
        del sent
        if totals is None:
            sums = np.zeros(4 * SHAPES, np.int64)
            for r in summed.where(F.col("kind") == TOTALS).select(F.posexplode("sums").alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n")).collect():  # four rows for each shape
                sums[r["at"]] = r.n
            tokens, letters, rare_tokens, rare_words = sums.reshape(4, SHAPES)
            all_tokens = int(tokens.sum() + rare_tokens.sum()) + documents
            all_words = int(letters.sum() + rare_words.sum()) + (documents > 0)
            totals = sc.broadcast(Totals(all_tokens, all_words, int(letters.sum()) + SHAPES + 1, documents, rare_tokens, rare_words))
        held = held.union(summed.where(F.col("block") >= 0))
    release(spark)
    return held.groupBy("block").applyInArrow(_score(totals), RESULT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return train_and_score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
