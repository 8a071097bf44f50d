"""Operators against plain versions on small tables that hold the awkward cases."""

import hashlib
import math
import random
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palisade.llm import backoff, components, decontaminate, fingerprints, html_text, kernels, lines, neardup, packing, quality, substrings, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, spans string, rep long, path string, hash long, perplexity double, _text string, held_out string"


def words(rng, n, k=400):
    return " ".join(f"w{rng.randrange(k)}" for _ in range(n))


def corpus():
    """Nulls, blanks, short and long texts, exact and near copies, shared passages, ties and repeated rows."""
    rng = random.Random(3)
    base, passage, line = words(rng, 120), words(rng, 60), "This very line stands in many of the documents, 2024."
    edited = base.split()
    edited[50] = "edited"
    texts = [None, "", " \n\t ", "one", "two words", "One two THREE four", "one two three four five", base, base, base.upper(), " ".join(edited), base + " tail " + words(rng, 10), passage, words(rng, 30) + " " + passage + " " + words(rng, 30)]
    texts += [words(rng, 20) + "\n" + passage.replace(" ", "  ") + "\n" + line for _ in range(3)] + [line + "\n" + line, line.replace("2024", "2025"), line.replace("2024", "202"), line[:-1], "x\n\n" + line + "\n", words(rng, 5000), "same " * 300, "é" * 50 + "\n" + "日本 語  text"]
    texts += [words(rng, rng.randrange(1, 90)) for _ in range(30)]
    rows = [(i * 3, t, ["en", "de", None][i % 3], "s", len(t or "")) for i, t in enumerate(texts)]
    return [*rows, rows[7], rows[3]]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "p", 2, 0.5, "t", "h") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, corpus()).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def split(text):
    return (text or "").encode().split()


# kernels


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab é\n\t\x0b日Z", max_size=30)), max_size=8))
def test_words_are_those_of_split(texts):
    import pyarrow as pa

    w = kernels.Words(pa.array(texts, pa.string()), lower=True)
    plain = [(t or "").encode().lower().split() for t in texts]
    assert [[w.word(i) for i in range(a, b)] for a, b in zip(w.first[:-1], w.first[1:], strict=True)] == plain
    flat = [x for p in plain for x in p]
    assert len(set(zip(flat, w.hash.tolist(), strict=True))) == len(set(flat)) == len(set(w.hash.tolist()))


def test_words_of_like_structure_have_hashes_of_their_own():
    import pyarrow as pa

    bits = [bin(i).count("1") % 2 for i in range(4096)]
    texts = [bytes(97 + b for b in bits), bytes(98 - b for b in bits), bytes(97 + b for b in bits[:1024]), bytes(98 - b for b in bits[:1024]), b"ab" * 40, b"ba" * 40, b"a" * 65, b"a" * 66]
    w = kernels.Words(pa.array(texts, pa.large_binary()))
    assert len(set(w.hash.tolist())) == len(texts)
    names = [b" ".join(b"xy"[b : b + 1] for b in y) for y in (bits, [1 - b for b in bits])]
    w = kernels.Words(pa.array(names, pa.large_binary()))
    for k in (1, 2, 3, 5, 16, 50, 64):
        start, row = w.windows(k)
        seen = {}
        for s, h, g in zip(start.tolist(), w.rolling(k)[start].tolist(), w.rolling(k, 1)[start].tolist(), strict=True):
            seq = tuple(w.word(i) for i in range(s, s + k))
            assert seen.setdefault(h, seq) == seq and h != g
    assert len(set(w.runs(w.first[:-1], w.first[1:]).tolist())) == 2


def test_slices_hold_every_row_once():
    import pyarrow as pa

    b = pa.RecordBatch.from_arrays([pa.array(["a" * n for n in (5, 0, 100, 1, 1, 50)])], names=["text"])
    assert [len(x) for s in kernels.slices([b], most=10) for x in s.column(0).to_pylist()] == [5, 0, 100, 1, 1, 50]


# 1


def plain_hits(text, items):
    def norm(t):
        keep = lambda c: c in b"0123456789abcdefghijklmnopqrstuvwxyz" or c >= 0x80
        return bytes(c if keep(c) else 32 for c in (t or "").encode().lower()).split()

    own, hit, found = norm(text), set(), set()
    for name, item in items:
        w = norm(item)
        k = min(10, len(w))
        for i in range(len(w) - k + 1) if k else ():
            for j in range(len(own) - k + 1):
                if own[j : j + k] == w[i : i + k]:
                    hit.update(range(j, j + k))
                    found.add(str(name))
    return len(own), len(hit), found


@pytest.mark.parametrize("index_bytes", [decontaminate.INDEX_BYTES, 200])
def test_decontamination(spark, docs, empty, index_bytes):
    base = corpus()[7][1].split()
    items = [(1, " ".join(base[5:30])), (2, "TWO, words!"), (3, None), (4, ""), (5, "..."), (6, "one"), (20, " ".join(base[8:20])), (7, "absent from all of the documents here")]
    bench = spark.createDataFrame([(*x, "clash") for x in items], "item_id long, text string, doc_id string")
    assert decontaminate.contamination(empty, bench, index_bytes).count() == 0
    got = decontaminate.contamination(docs, bench, index_bytes).collect()
    expected = [(r[0], *plain_hits(r[1], items)) for r in corpus()]
    mine = [(r.doc_id, r.n_words, sum(r.spans[1::2]) - sum(r.spans[::2]), set(r["items"])) for r in got]
    assert sorted(map(repr, mine)) == sorted(map(repr, expected))
    clean = {r.doc_id for r in decontaminate.decontaminate(docs, bench).collect()}
    assert clean == {r[0] for r in expected if not r[2]}
    assert decontaminate.contamination(docs, bench.where("false")).where("size(spans) > 0").count() == 0


def test_benchmark_rows_without_id_contaminate(spark, docs):
    base = corpus()[7][1].split()
    items = [(None, " ".join(base[5:30])), (None, "one"), (2, "TWO, words!")]
    got = decontaminate.contamination(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    mine = [(r.doc_id, r.n_words, sum(r.spans[1::2]) - sum(r.spans[::2]), set(r["items"])) for r in got]
    assert sorted(map(repr, mine)) == sorted(repr((r[0], n, hit, found - {"None"})) for r in corpus() for n, hit, found in [plain_hits(r[1], items)])


def test_span_removal_leaves_no_window(spark, docs):
    base = corpus()[7][1].split()
    bench = spark.createDataFrame([(1, " ".join(base[5:30]))], "item_id long, text string")
    kept = decontaminate.decontaminate(docs, bench, mode="spans")
    assert kept.count() == docs.count()
    assert decontaminate.contamination(kept, bench).where("size(spans) > 0").count() == 0


# 2


def plain_kneser_ney(texts, vocabulary):
    """Counts of 5-grams of characters, padded, to a function of probabilities."""
    n = quality.ORDER
    c = [Counter() for _ in range(n + 1)]
    for t in texts:
        ids = [quality.START] * (n - 1) + t
        c[n].update(tuple(ids[i : i + n]) for i in range(len(t)))
    for k in range(n - 1, 0, -1):
        c[k].update(g[1:] for g in c[k + 1])
    d = [quality.discounts(*[sum(v == j for v in x.values()) for j in (1, 2, 3, 4)]) for x in c]

    def p(g):
        if not g:
            return 1 / vocabulary
        k = len(g)
        own = {x: v for x, v in c[k].items() if x[:-1] == g[:-1]}
        if not own:
            return p(g[1:])
        cut = lambda v: d[k][min(v, 3) - 1]
        total = sum(own.values())
        rest = sum(cut(v) for v in own.values()) / total
        return (max(own.get(g, 0) - cut(own[g]), 0) / total if g in own else 0) + rest * p(g[1:])

    return p


def test_kneser_ney_is_a_probability_and_equals_a_plain_one(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("aab c") for _ in range(40)) for _ in range(6)]
    characters = quality.Characters(np.array([ord(x) for x in "abc "]))
    ids = [[int(x) & quality.mask(1) for x in characters.encode([t])[0]] for t in texts]
    keys, n = np.unique(characters.encode(texts)[0], return_counts=True)
    counts = spark.createDataFrame([(int(k), int(v)) for k, v in zip(keys, n, strict=True)], "key long, n long")
    grams, contexts = quality.kneser_ney(counts, 5)
    g, c = grams.toPandas(), contexts.toPandas()
    tables = quality.by_order(*(g[x].to_numpy() for x in ("order", "key", "logp"))), quality.by_order(*(c[x].to_numpy() for x in ("order", "key", "weight")))
    logs = lambda key: quality.logs(key, *tables, -math.log10(5))
    p = plain_kneser_ney(ids, 5)
    for t in ("abcab", "ccccc", "a b z", "zzzz"):
        key, _ = characters.encode([t])
        seq = [quality.START] * 4 + [int(k) & quality.mask(1) for k in key]
        assert np.allclose(logs(key), [math.log10(p(tuple(seq[i : i + 5]))) for i in range(len(t))])
    context = characters.encode(["abca"])[0][-1]
    following = np.array([(int(context) << 12 & quality.mask(5)) | i for i in range(1, 6)])
    assert np.isclose((10 ** logs(following)).sum(), 1)


def test_quality_rejects_junk_and_keeps_prose(spark, empty):
    rng = random.Random(5)
    prose = lambda: " ".join(rng.choice("the cat sat on a mat with his old hat and dog".split()) for _ in range(40))
    rows = [(i, prose(), "en", "s", 1) for i in range(300)] + [(300 + i, "".join(rng.choice("#%$&*@!XQZ") for _ in range(100)), "en", "s", 1) for i in range(20)]
    rows += [(400, None, "en", "s", 0), (401, "  ", None, "s", 0), (402, prose(), None, "s", 1)]
    d = frame(spark, rows)
    labels = spark.createDataFrame([(i, 1 if i < 300 else 0, "x") for i in range(0, 320, 2)] + [(5, None, "x"), (0, 1, "x")], "doc_id long, quality int, text string")
    got = {r.doc_id: r for r in quality.judged(d, labels).collect()}
    assert sum(got[i].accepted for i in range(300)) >= 297 and not any(got[i].accepted for i in (*range(300, 320), 400, 401)) and got[402].accepted
    assert got[400].perplexity is None and got[1].source == "s"
    assert quality.train(d, labels.where("false")) is None
    assert quality.judged(d, labels.where("false")).where("accepted").count() == 321
    assert quality.judged(empty, labels).count() == 0


@pytest.mark.parametrize("size", [quality.BLOCK_BYTES, 2000])
def test_quality_thresholds_are_of_all_trusted_rows(spark, monkeypatch, size):
    """A language that is rare in the training sample has its own quantile, of all its trusted rows."""
    monkeypatch.setattr(quality, "BLOCK_BYTES", size)
    monkeypatch.setattr(quality, "SHARD_BYTES", size)
    rng = random.Random(5)
    prose = lambda x: " ".join(rng.choice(x.split()) for _ in range(40))
    rows = [(i, prose("der hund lief weit durch wald" if i % 5 == 0 else "the cat sat on a mat with his old hat and dog"), "de" if i % 5 == 0 else "en", "s", 1) for i in range(600)]
    d = frame(spark, rows)
    labels = spark.createDataFrame([(i, 1) for i in range(600)], "doc_id long, quality int")
    model = quality.train(d, labels, trusted_rows=100)
    measured = quality.measure(d, model).cache()
    cuts = quality.thresholds(measured, model)
    assert set(cuts) == {"*", "en", "de"}
    chosen = {r.doc_id for r in labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(100).collect() if zlib.crc32(str(r.doc_id).encode()) % quality.CALIBRATE}
    assert {r.doc_id for r in model.learned.collect()} == chosen
    p = {r.doc_id: r.perplexity for r in measured.collect()}
    # the sharded join against the whole model in one place
    g, c = model.grams.toPandas(), model.contexts.toPandas()
    tables = quality.by_order(*(g[x].to_numpy() for x in ("order", "key", "logp"))), quality.by_order(*(c[x].to_numpy() for x in ("order", "key", "weight")))
    for i, text, *_ in rows:
        key, _ = model.characters.encode([text])
        assert math.isclose(p[i], 10 ** -quality.logs(key, *tables, -math.log10(model.vocabulary)).mean(), rel_tol=1e-3)
    own = sorted(p[i] for i in range(0, 600, 5) if i not in chosen)
    assert math.isclose(cuts["de"][0], own[math.ceil(quality.QUANTILE * len(own)) - 1] * quality.MARGIN)
    got = {r.doc_id: r for r in quality.classify(measured, cuts).collect()}
    variety = {r.doc_id: r.variety for r in measured.collect()}
    assert all(got[i].accepted == (p[i] <= cuts[lang][0] and variety[i] >= cuts[lang][1]) for i, _, lang, *_ in rows)


def test_quality_rejects_what_repeats_itself(spark):
    rng = random.Random(5)
    prose = lambda n: " ".join(rng.choice("the cat sat on a mat with his old hat and dog by that big house".split()) + rng.choice("abcdefgh") for _ in range(n))
    rows = [(i, prose(rng.randrange(10, 2000)), "en", "s", 1) for i in range(300)] + [(300 + i, " ".join([prose(1 + i % 3)] * (30 + 40 * i)), "en", "s", 1) for i in range(20)]
    d = frame(spark, rows)
    got = {r.doc_id: r.accepted for r in quality.judged(d, spark.createDataFrame([(i, 1) for i in range(0, 300, 2)], "doc_id long, quality int")).collect()}
    assert sum(got[i] for i in range(300)) >= 294 and not any(got[i] for i in range(300, 320))


# 3


def test_fingerprints(spark, docs, empty):
    got = fingerprints.compare_with_next(docs).collect()
    rows = sorted(((r[0], r[1] or "") for r in corpus()), key=lambda x: (x[0], x[1]))
    expected = []
    for i, (doc, t) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        cut = len(t) // 4
        e = t[: len(t) - cut] + after[:cut]
        own, edited, other = (fingerprints.trees([x.encode()])[0] for x in (t, e, after))
        expected.append((doc, len(t), hashlib.sha256(e.encode()).hexdigest(), own.encode(), edited.encode(), plain_likeness(own, edited), plain_likeness(own, other)))
    assert sorted(map(tuple, got)) == sorted(expected)
    assert fingerprints.compare_with_next(empty).count() == 0
    only = fingerprints.compare_with_next(frame(spark, [(1, "a b c d", "en", "s", 7)])).first()
    assert only.near_next == 1.0
    unnamed = fingerprints.compare_with_next(frame(spark, [(None, "a b", "en", "s", 3), (1, "c d", "en", "s", 3)])).collect()
    assert sorted((r.doc_id is None, r.n_chars) for r in unnamed) == [(False, 3), (True, 3)]


def plain_likeness(a, b):
    """All leaves against all, without a look at the branches above them."""
    if a.root == b.root:
        return 1.0
    x, y = Counter(a.leaves.tolist()), Counter(b.leaves.tolist())
    return 2 * (x & y).total() / max(1, x.total() + y.total())


def test_equal_texts_and_edits():
    a = b"\n".join(b"paragraph %d with some words of its own" % i for i in range(60))
    b = a.replace(b"paragraph 30", b"sentence 30")
    x, y, z = (t.encode() for t in fingerprints.trees([a, b, a]))
    assert x == z != y and fingerprints.edits(x, z) == [] and fingerprints.edits(x, y) == [(30, 31, 30, 31)]
    assert 0.9 < fingerprints.likeness(x, y) < 1
    assert fingerprints.trees([b"a b"])[0].root != fingerprints.trees([b"a  b"])[0].root
    added = a.replace(b"paragraph 7 ", b"new\nnew too\nparagraph 7 ")
    assert fingerprints.edits(x, fingerprints.trees([added])[0].encode()) == [(7, 7, 7, 9)]


def test_trees_of_many_paragraphs_end_soon():
    a, b = b"same line\n" * 70_000 + b"end", b"same line\n" * 69_990 + b"other\nend"
    x, y = fingerprints.trees([a, b])
    decoded = fingerprints.Tree.decode(x.encode())
    assert sum(n for _, n in decoded.sections) == 70_001 and sum(n for _, n in decoded.paragraphs) == len(decoded.leaves)
    runs = fingerprints.edits(x.encode(), y.encode())
    assert runs and all(i <= j and k <= m for i, j, k, m in runs) and 0.99 < fingerprints.alike(x, y) < 1


# 4


def plain_components(rows):
    sets = {}
    for doc, text, *_ in rows:
        w = (text or "").encode().lower().split()
        sets[doc] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def check_components(spark, rows):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(frame(spark, rows)).collect()}
    assert got == {d: (n, c, d == c) for d, (n, c) in plain_components(rows).items()}


def test_near_duplicates(spark, empty):
    check_components(spark, corpus())
    assert neardup.near_duplicates(empty).count() == 0


def test_near_duplicates_in_large_nodes(spark, monkeypatch):
    """Chains of gradually edited copies, whose ends aren't alike, in nodes that are too large to compare in full."""
    monkeypatch.setattr(neardup, "LEAF", 4)
    monkeypatch.setattr(neardup, "PROBE", 2)
    monkeypatch.setattr(neardup, "CHUNKS", 1)
    rng = random.Random(9)
    rows, doc = [], 0
    for _ in range(3):
        w = words(rng, 80).split()
        for _ in range(12):
            w = list(w)
            for _ in range(2):
                w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
            rows.append((doc, " ".join(w), "en", "s", 1))
            doc += 1
    rng.shuffle(rows)
    check_components(spark, rows)


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(300 + i, 301 + i) for i in range(60)] + [(5, 5)]
    got = {r.id: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    root = {x: x for e in edges for x in e}
    for _ in range(400):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {x: r for x, r in root.items() if x != r}


# 5


def test_packing_is_a_lossless_cut(spark, docs, empty, monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    plain.encode_special_tokens = True
    ids = Counter()
    full = {}
    for doc, text, *_ in corpus():
        full[doc] = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        ids[doc] += 1
    p = packing.pack(docs).toPandas()
    assert set(p.doc_id) == set(full)
    lengths = p.groupby("sequence_id")["length"].sum()
    assert lengths.max() <= 2048 and all(n & (n - 1) == 0 for n in lengths)
    for _, g in p.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *np.cumsum(g["length"])[:-1]]
    for doc, g in p.groupby("doc_id"):
        assert g["length"].sum() == len(full[doc]) * ids[doc] and (g.doc_tokens == len(full[doc])).all()
        for s, n, crc in zip(g.start, g["length"], g.ids_crc32, strict=True):
            assert zlib.crc32(full[doc][s : s + n].tobytes()) == crc
    assert packing.pack(empty).count() == 0


def test_tokenizer_gives_the_ids_of_the_plain_one():
    import public_tokenizers

    t = packing.loaded(public_tokenizers.path("byte_bpe_50k.json"))
    from tokenizers import Tokenizer

    assert t.fast is not None
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert t.encode("a <|endoftext|> b").tolist() == [64, 220, 50256, 275]
    for text in ["", "x<|ENDOFTEXT|>", "<|endoftext|><|endoftext|>", "a  b\n\n c\t\td  x", " lead", "trail ", "don't I'll 12 34,5 ...", "\x1c a\x85b", "é日本 x", "<|endoftext|> a", "x" * 3000, "​﻿z"]:
        assert t.encode(text).tolist() == plain.encode(text, add_special_tokens=False).ids


def test_neighbours_come_first():
    rng = random.Random(4)
    topics = [[rng.randrange(100, 40000) for _ in range(60)] for _ in range(4)]
    docs = [(i, np.array([rng.choice(topics[i % 4]) for _ in range(500)], np.uint16)) for i in range(40)]
    df = np.zeros(1 << 16)
    for _, x in docs:
        df[np.unique(x)] += 1
    packer = packing.Packer(np.where(df > 0, np.log1p((40 - df + 0.5) / (df + 0.5)), 0), 500, 0)
    for d, x in docs:
        packer.add(d, x)
    packer.pack(True)
    p = packer.take().to_pandas()
    alike = p[p.sequence_id < 8].groupby("sequence_id").doc_id.agg(lambda x: Counter(v % 4 for v in x).most_common(1)[0][1] / len(x))
    assert alike.mean() > 0.75


# 6


def plain_removed(rows):
    texts = [(d, split(t)) for d, t, *_ in rows]
    first = {}
    for d, w in texts:
        for i in range(len(w) - 49):
            k = tuple(w[i : i + 50])
            first[k] = min(first.get(k, d), d)
    out = []
    for d, w in texts:
        gone = {j for i in range(len(w) - 49) if first[tuple(w[i : i + 50])] < d for j in range(i, i + 50)}
        out.append((d, len(w), len(gone), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in gone)).hexdigest()))
    return sorted(out)


def test_substrings(spark, docs, empty, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert sorted(map(tuple, substrings.query(spark, str(tmp_path)).collect())) == plain_removed(corpus())
    empty.write.parquet(str(tmp_path / "e/documents.parquet"))
    assert substrings.query(spark, str(tmp_path / "e")).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=0, max_size=200))
def test_every_window_holds_a_picked_phrase(seq):
    import pyarrow as pa

    w = kernels.Words(pa.array([" ".join(map(str, seq))], pa.string()))
    at, _ = substrings.winnow(w)
    picked = {tuple(seq[p : p + substrings.PHRASE]) for p in at}
    for i in range(len(seq) - substrings.WINDOW + 1):
        assert any(tuple(seq[j : j + substrings.PHRASE]) in picked for j in range(i, i + substrings.WINDOW - substrings.PHRASE + 1))


# 7


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def units(line):
    words = line.split(" ")
    return (True, words) if len(words) >= lines.LEAST_WORDS else (False, list(line)) if len(line) >= lines.LEAST_CHARACTERS else None


def plain_lines(rows):
    seen, out = {}, []
    own = [(d, p, x.strip(" ")) for d, t, *_ in rows if t is not None for p, x in enumerate(t.split("\n"))]
    for d, p, x in own:
        if x:
            seen[x] = min(seen.get(x, (d, p)), (d, p))
    split = {x: u for x in seen if (u := units(x))}
    close = lambda a, b: a[0] == b[0] and abs(len(a[1]) - len(b[1])) <= 1 and edits(a[1], b[1]) <= 1
    later = {x for x in split for y in split if seen[y] < seen[x] and close(split[x], split[y])}
    for d, t, *_ in rows:
        keep = [x for p, x in enumerate(t.split("\n")) if not ((k := x.strip(" ")) in seen and (k in later or seen[k] != (d, p)))] if t is not None else None
        out.append((d, "\n".join(keep) if keep is not None else None))
    return sorted(out, key=repr)


def line_cases():
    """Lines of words and of characters with one edit and with two, at the ends and inside, short lines, repeated ones."""
    rng = random.Random(4)
    letters = "abcdefghijé一😀"
    said = lambda n: " ".join("".join(rng.choice("abc") for _ in range(3)) for _ in range(n))
    rows = []
    for i in range(60):
        words, signs = said(rng.choice((7, 8, 9, 30))).split(" "), [rng.choice(letters) for _ in range(rng.choice((31, 32, 33, 50)))]
        out = []
        for had in (words, signs):
            for k in (0, 1, 1, 2):
                new = list(had)
                for _ in range(k):
                    p, how = rng.randrange(len(new)), rng.randrange(3)
                    new[p : p + (how > 0)] = [] if how == 1 else ["zz" if had is words else rng.choice(letters)]
                out.append((" " if had is words else "").join(new))
        rng.shuffle(out)
        rows.append((1000 + i, "\n".join([*out, "So.", "", " x ", "x"])))
    return rows


@pytest.mark.parametrize("limit", [1, 2, 3])
def test_bit_parallel_edit_distance(spark, limit):
    rng = random.Random(limit)
    pairs = [([], []), ([], ["a"]), (["a"], [])]
    for _ in range(300):
        a = [rng.choice("ab") for _ in range(rng.randrange(9))]
        b = list(a) if rng.random() < 0.5 else [rng.choice("ab") for _ in range(rng.randrange(9))]
        for _ in range(rng.randrange(limit + 2)):
            b[(p := rng.randrange(len(b) + 1)) : p + rng.randrange(2)] = rng.choice(([], ["c"]))
        pairs.append((a, b))
    df = spark.createDataFrame(pairs, "a array<string>, b array<string>").selectExpr("a", "b", f"{lines.within('a', 'b', limit)} as near")
    for r in df.collect():
        assert r.near == (edits(r.a, r.b) <= limit), r


@pytest.mark.parametrize("bucket", [64, 1])
def test_lines_within_an_edit(spark, monkeypatch, bucket):
    monkeypatch.setattr(lines, "BUCKET", bucket)
    rows = line_cases()
    got = sorted(((r.doc_id, r.text) for r in lines.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert got == plain_lines(rows)


@pytest.mark.parametrize("bucket", [64, 1])
def test_line_dedup(docs, empty, monkeypatch, bucket):
    monkeypatch.setattr(lines, "BUCKET", bucket)
    got = sorted(((r.doc_id, r.text) for r in lines.dedup(docs).collect()), key=repr)
    assert got == plain_lines(corpus())
    assert lines.dedup(empty).count() == 0


# 8


def test_html():
    page = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><a href=/>Home</a></nav><!-- no <p>no</p> -->
    <div class="cookie-notice">We use cookies on this site.</div><article><h1>A &amp; B</h1><p>First <b>bold
    text<br>next<p>Second &#233;<script>var t="</p>";</script><div class="ad">Buy</div><p></p><p>Short.</p><form><p>Name</p></form><aside>Side</aside>
    <section id="comments"><p>Nice article, thank you for all of it.</p></section></article><footer>Foot</footer></body></html>"""
    assert html_text.main_text(page) == "A & B\nFirst bold text next\nSecond é\nShort."
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<p") == ""
    long = "This is a text about the thing that is in the house and it was there for a very long time, as they say to the people who were with us in the days of old when it was up and all of it was well with us."
    assert html_text.main_text(f"<div><a href=x>Home</a> <a href=y>More</a></div><p>{long}</p><p>Short one.</p><p>{long}</p><p>Tail</p>") == f"{long}\nShort one.\n{long}"


def test_names_of_what_a_page_has_drop_nothing():
    prose = "<p>It is what it was, and all of us were there for the most of it, as they said to him and to her.</p>" * 3
    for name in ("content has-sidebar", "no-ads", "post with-comments", "sidebar-right", "layout-sidebar"):
        assert len(html_text.main_text(f'<div class="{name}"><article>{prose}</article></div>')) > 200
        assert len(html_text.main_text(f'<div class="{name}">{prose}</div>')) > 200
    assert len(html_text.main_text('<p id="related-work">' + prose[3:])) > 200
    page = f'{prose}<div class="ad">It is for you and all of yours.</div><div id="comments">{prose}</div><div class="cookie-banner">We use it for the site and for you.</div><div class="header">It was the site of all that is.</div>'
    assert html_text.main_text(page) == html_text.main_text(prose)


@pytest.mark.parametrize("piece", ["<a ", '<a ">"', "<b><div></div>", "<script ", "<script>", "<!--", "<div></p>", "<i><div><b></i>", '<div class="ad">x', "<", "&#", "<p x='"])
def test_odd_pages_take_linear_time(piece):
    import time

    began = time.time()
    html_text.main_text(piece * (1_000_000 // len(piece)) + "</p></div>" * 20_000 + ">")
    assert time.time() - began < 10


def plain_passes(found):
    """The two passes, block by block."""
    found = [b for b in found if b.main] or found
    first = []
    for b in found:
        n, links = len(b.text), b.linked / len(b.text)
        w = [x for x in "".join(c if c.isalpha() else " " for c in b.text.lower()).split()]
        stop = sum(x in html_text.STOP_WORDS for x in w) / max(1, len(w))
        if links > html_text.MOST_LINKS and not (b.main and (links <= 0.8 or n >= html_text.SHORT)):
            first.append("bad")
        elif b.main:
            first.append("short" if b.linked and n < html_text.SHORT else "good")
        elif n < html_text.SHORT:
            first.append("bad" if b.linked else "short")
        elif stop < html_text.LOW_STOP:
            first.append("bad")
        else:
            first.append("good" if stop >= html_text.HIGH_STOP and n > html_text.LONG else "near")
    if "good" not in first:
        first = ["good" if x == "near" else x for x in first]
    for kind, needed in (("near", 1), ("short", 2)):
        known = list(first)
        for i, x in enumerate(known):
            if x == kind:
                sides = (next((y for y in reversed(known[:i]) if y in ("good", "bad")), "bad"), next((y for y in known[i + 1 :] if y in ("good", "bad")), "bad"))
                first[i] = "good" if sides.count("good") >= needed else "bad"
    return [b.text for b, x in zip(found, first, strict=True) if x == "good"]


def test_two_passes_equal_plain_ones():
    rng = random.Random(12)
    for _ in range(300):
        parts = []
        for _ in range(rng.randrange(1, 14)):
            text = " ".join(rng.choice(["the", "and", "of", "xylo", "quark", "brim"]) for _ in range(rng.randrange(1, 70)))
            parts.append(rng.choice([f"<p>{text}</p>", f"<p><a href=x>{text}</a></p>", f"<div>{text} <a>{text[:20]}</a></div>", f"<li>{text}"]))
        page = "".join(parts) if rng.random() < 0.7 else f"<p>top</p><article>{''.join(parts)}</article>"
        assert html_text.main_text(page).split("\n") == (plain_passes(html_text.blocks(page)) or [""])


def test_html_rows(spark, sf):
    pages = spark.createDataFrame([(1, "u", None, "x"), (1, "u", None, "x"), (2, None, "<article>a &lt; b</article>", "x")], "page_id long, url string, html string, text string")
    assert sorted((r.page_id, r.text, r.n_chars) for r in html_text.extract(pages).collect()) == [(1, "", 0), (1, "", 0), (2, "a < b", 5)]


# 9


def test_toxicity(spark):
    rng = random.Random(6)
    rows = [(i, words(rng, 60, 300) + (f" vexo{rng.randrange(10**6)} " if i % 5 == 0 else " ") + words(rng, 20, 300), ["en", "fr"][i % 2], "s", 1) for i in range(800)]
    rows += [(900, None, None, "s", 0), (901, "", "en", "s", 0), (0, rows[0][1], "fr", "t", 1)]
    d = frame(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 5 == 0), "x") for i in range(800)] + [(3, None, "x"), (10**9, 1, "x")], "doc_id long, toxic int, text string")
    got = toxicity.score(d, toxicity.fit(d, labels)).toPandas()
    assert len(got) == len(rows) and got.score.between(0, 1).all() and ((got.score >= 0.3) == (got.predicted == 1)).all()
    assert (got.held_out == [zlib.crc32(str(x).encode()) % 4 == 2 for x in got.doc_id]).all()
    held = got[got.held_out & (got.doc_id < 800)]
    assert (held.predicted == (held.doc_id % 5 == 0)).mean() > 0.97
    assert got[got.doc_id == 900].score.iloc[0] == got[got.doc_id == 901].score.iloc[0]
    # labels, lang, source and ids aren't inputs
    other = toxicity.score(d.withColumn("lang", F.lit("zz")).withColumn("source", F.lit("q")), toxicity.fit(d, labels)).toPandas()
    assert sorted(other.score) == sorted(got.score)
    assert toxicity.score(d, toxicity.fit(d, labels.where("false"))).agg(F.max("score")).first()[0] == 0
    assert toxicity.score(d, toxicity.fit(d, labels.where("toxic = 1"))).agg(F.min("score")).first()[0] == 1


# 10


def test_backoff(spark, docs, empty):
    got = backoff.train_and_score(docs).toPandas()
    rows = corpus()
    c = Counter()
    for d, t, *_ in rows:
        if zlib.crc32(str(d).encode()) % 10:
            c.update([*(t or "").encode().lower().split(), None])
    n, v = sum(c.values()), len(c)
    expected = []
    for d, t, *_ in rows:
        tokens = [*(t or "").encode().lower().split(), None]
        expected.append((d, zlib.crc32(str(d).encode()) % 10 == 0, len(tokens), sum(c[x] > 0 for x in tokens), n, sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in tokens)))
    mine = sorted(got.drop(columns="score").itertuples(index=False, name=None))
    for a, b in zip(mine, sorted(expected), strict=True):
        assert a[:5] == b[:5] and math.isclose(a[5], b[5], rel_tol=1e-9)
    assert np.isfinite(got.score).all() and (got.score <= 0).all()
    unnamed = backoff.train_and_score(frame(spark, [(None, "a b a b", "en", "s", 3), (1, "a b", "en", "s", 3)])).collect()
    assert sorted((r.doc_id or 0, r.held_out, r.n_tokens, r.train_tokens) for r in unnamed) == [(0, False, 5, 8), (1, False, 3, 8)]
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    one, other = ("".join("ab"[b ^ x] for b in bits) for x in (0, 1))
    alike = backoff.train_and_score(frame(spark, [(1, one, "en", "s", 3), (10, other, "en", "s", 3)])).collect()
    held = [r for r in alike if r.held_out] or alike
    assert zlib.crc32(b"1") % 10 and zlib.crc32(b"10") % 10 and all(r.n_known == 2 and math.isclose(r.base_score, math.log10(1.1 / 4.4) + math.log10(2.1 / 4.4)) for r in alike) and held
    assert backoff.train_and_score(empty).count() == 0


@pytest.mark.parametrize("shard_grams", [backoff.SHARD_GRAMS, 50])
def test_backoff_keeps_what_occurs_twice_at_every_size(spark, monkeypatch, shard_grams):
    """Against one automaton of all words and grams that occur twice, on more tokens than let a share of them keep these."""
    import pyarrow as pa

    monkeypatch.setattr(backoff, "SHARD_GRAMS", shard_grams)
    rng = random.Random(7)
    rows = [(i, words(rng, 3000, 9), "en", "s", 1) for i in range(45)] + [(100 + i, words(rng, 60, 3000), "en", "s", 1) for i in range(60)] + [(i, "Rare words, said twice. " + words(rng, 2, 9), "en", "s", 1) for i in (200, 201, 202, 203)] + [(300, None, "en", "s", 0)]
    got = {r.doc_id: r for r in backoff.train_and_score(frame(spark, rows).repartition(3)).collect()}
    tokens = {d: (t or "").encode().lower().split() for d, t, *_ in rows}
    count = Counter(x for d, w in tokens.items() if zlib.crc32(str(d).encode()) % 10 for x in w)
    kept = [x for x, n in count.items() if n >= 2]
    w = backoff.Words(pa.array([b" ".join(kept).decode()]))
    order = sorted(kept, key=dict(zip(kept, w.hash.tolist(), strict=True)).get)
    number = {x: backoff.FIRST_WORD + i for i, x in enumerate(order)}
    shape = lambda x: int(backoff.shapes(backoff.Words(pa.array([x.decode()])))[0])
    grams, rare = {k: Counter() for k in (1, 2, 3)}, Counter(shape(x) for x in count if count[x] < 2)
    for d, own in tokens.items():
        if zlib.crc32(str(d).encode()) % 10:
            c = [backoff.START] * 2 + [number.get(x, -1) if x in number else shape(x) for x in own] + [backoff.END]
            for i in range(2, len(c)):
                grams[1][c[i]] += 1
                grams[2][c[i - 1] << 16 | c[i]] += 1
                grams[3][c[i - 2] << 32 | c[i - 1] << 16 | c[i]] += 1
    pick = lambda k: tuple(np.array(x) for x in zip(*sorted((g, float(n)) for g, n in grams[k].items() if n >= 2), strict=True))
    a = backoff.Automaton(backoff.FIRST_WORD + len(kept), grams[1][backoff.END], dict(grams[1]), pick(2), pick(3))
    for d, own in tokens.items():
        c = np.array([number[x] if x in number else shape(x) for x in own], np.int64)
        share = sum(math.log10(count[x] + 0.1) - math.log10(max(rare[shape(x)] + 0.1 * (rare[shape(x)] + 1), 0.1)) for x in own if x not in number)
        assert math.isclose(got[d].score, a.scores(c, np.array([0, len(c)]))[0] + share, rel_tol=1e-9), d


def test_automaton_is_a_probability():
    rng = np.random.default_rng(1)
    size = backoff.FIRST_WORD + 6
    letters = [3, 7, backoff.END, *range(backoff.FIRST_WORD, size)]
    grams = {k: Counter() for k in (1, 2, 3)}
    rows = [[backoff.START] * 2 + [letters[i] for i in rng.integers(0, 9, 12) if letters[i] != backoff.END] + [backoff.END] for _ in range(60)]
    for r in rows:
        for i in range(2, len(r)):
            grams[1][r[i]] += 1
            grams[2][r[i - 1] << 16 | r[i]] += 1
            grams[3][r[i - 2] << 32 | r[i - 1] << 16 | r[i]] += 1
    pick = lambda k: tuple(np.array(x) for x in zip(*sorted((g, float(n)) for g, n in grams[k].items() if n >= 2), strict=True))
    a = backoff.Automaton(size, len(rows), dict(grams[1]), pick(2), pick(3))
    possible = np.array([i for i in range(size) if i != backoff.START])
    states = [a.start()]
    for x in letters:
        states.append(int(a.step(np.array([states[-1]]), np.array([x]))[0][0]))
    for s in {*states} - {1 + backoff.END}:
        assert np.isclose((10 ** a.step(np.full(len(possible), s), possible)[1]).sum(), 1), s
    # in step and in pieces, scores are those of one letter after the other
    seqs = [np.array([letters[i] for i in rng.integers(3, 9, n)], np.int64) for n in (0, 5, 2, 9, backoff.PIECE, backoff.PIECE + 1, 3 * backoff.PIECE + 7, 0)]
    first = np.cumsum([0, *map(len, seqs)])

    def plain(seq):
        state, total = a.start(), 0.0
        for x in [*seq, backoff.END]:
            after, got = a.step(np.array([state]), np.array([x]))
            state, total = int(after[0]), total + float(got[0])
        return total

    assert np.allclose(a.scores(np.concatenate(seqs), first), [plain(s) for s in seqs])
