"""Phrase mining, fill-in-middle and token files against plain versions."""

import hashlib
import json
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from test_operators import corpus, frame

from palisade.llm import binary_tokens, fim, phrases

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], frame(spark, corpus()[:1]).schema)


# phrases


def plain_collocations(rows, max_n=4, least=30, top=2000, scale=2_000_000, inside=80):
    f, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, max_n + 1):
                for i in range(len(w) - k + 1):
                    f.setdefault(lang, Counter())[tuple(w[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        cand = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in cand.items():
            cuts = [(scale * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p))]
            score, _, left, right = min(cuts)
            longer = [b for q, b in cand.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if not any(100 * b >= inside * a for b in longer):
                kept.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(kept)[:top])]
    return sorted(out)


def phrase_rows():
    rng = random.Random(11)
    sets = ["in the old house", "in the old days", "New York City", "été à la plage", "tick, tock", "a a a a a", "x\ty  z", "zero\x00byte word"]
    rows = [(None, None), ("en", ""), ("en", " .,;\n"), ("", "ein wort " * 9), ("und", "an end " * 7)]
    rows += [(rng.choice(["en", "de", None]), " ".join(rng.choice(sets) + rng.choice(["", ".", ":", "\r\n", " "]) for _ in range(rng.randrange(1, 40)))) for _ in range(60)]
    return [*rows, rows[-1], ("en", "long text here. " * 400)]


@pytest.mark.parametrize("options", [{"least": 5}, {"least": 5, "max_n": 2}, {"least": 3, "max_n": 5, "top": 4, "inside": 95}, {}])
def test_collocations_equal_the_plain_version(spark, options):
    rows = phrase_rows()
    docs = spark.createDataFrame([(i, lang, t, 1, "c") for i, (lang, t) in enumerate(rows)], "doc_id long, lang string, text string, c int, phrase string").repartition(3)
    got = phrases.collocations(docs, **options)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == plain_collocations(rows, **options)


def test_collocations_of_very_long_texts_and_full_filters(spark, monkeypatch):
    rows = phrase_rows()
    text = " . ".join(t for _, t in rows if t) + " " + "endless piece " * 300
    rows = [("en", text), ("en", "no break at all " * 200)]
    docs = spark.createDataFrame([(i, lang, t) for i, (lang, t) in enumerate(rows)], "doc_id long, lang string, text string")
    want = plain_collocations(rows, least=5)
    monkeypatch.setattr(phrases, "SLICE", 100)
    cut = [t.to_pylist() for t, _ in phrases._cut(iter(docs.toArrow().to_batches()))]
    assert b"".join(x for y in cut for x in y) == "".join(t for _, t in rows).encode() and len(cut) > 20
    monkeypatch.undo()
    assert sorted(map(tuple, phrases.collocations(docs, least=5).collect())) == want
    grams = spark.createDataFrame([("en", f"w{i}") for i in range(3000)], "lang string, phrase string")
    small = phrases.make_filter(grams, 10)  # 3000 grams in 1024 bits: it passes nearly all, and never misses one
    assert small.has(phrases._hashes(pa.array([f"w{i}" for i in range(3000)]), pa.array(["en"] * 3000))).all()
    large = phrases.make_filter(grams)
    assert large.has(phrases._hashes(pa.array([f"w{i}" for i in range(3000)]), pa.array(["en"] * 3000))).all()
    assert large.has(phrases._hashes(pa.array([f"w{i}" for i in range(3000)]), pa.array(["de"] * 3000))).mean() < 0.2


def test_collocations_of_no_rows(spark, empty):
    assert phrases.collocations(empty).count() == 0


# fill-in-middle


def plain_fim(doc_id, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, _, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(units)
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:low], units[low:high], units[high:]))
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 50 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.none(), st.integers(-5, 99)), st.text(alphabet="ab\n\r é日𝄞\x00 <P>", max_size=40), st.integers(1, 6))
def test_fim_equals_the_plain_version(doc_id, text, piece):
    units = fim.Units(piece=piece)  # texts in pieces of that many code points give the same
    got = fim.transform(doc_id, text, units)
    assert got == plain_fim(doc_id, text) and fim.restore(got[4], got[1]) == text
    assert fim.transform(doc_id, text, units, rate=0)[1] == "plain"


def test_fim_of_tables(spark, empty):
    rows = [*corpus(), (None, "no id\nat all", "en", "s", 1), (7, "holds <S> inside\n", "en", "s", 1), (8, "x" * 300_000 + "\n" + "y\n" * 100_000, "en", "s", 1)]
    docs = frame(spark, rows).repartition(3)
    made = fim.fill_in_middle(docs)
    got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in made.collect()), key=str)
    assert got == sorted(((r[0], *plain_fim(r[0], r[1])) for r in rows), key=str)
    assert {f for _, _, f, *_ in got} == {"plain", "spm", "psm"}
    assert sorted(r.text for r in fim.restored(made).collect()) == sorted(r[1] or "" for r in rows)
    assert fim.fill_in_middle(empty).count() == 0


# token files


@pytest.fixture(scope="module")
def encoder():
    return binary_tokens.loaded(TOKENIZER)


def plain_ids(encoder, text):
    return [*encoder.plain.encode(text or "", add_special_tokens=False).ids, 2]


TEXTS = ["It's 12,345.67 o'clock!", "ÉCOLE École KK ſ İ İ ß", "a b c\x1cd\x85e", "'s''ll 'LL_x'S9's", "<|endoftext|> <|EndOfText|>x<|startoftext|>", "日本語 テキスト 한국어 한", "a̸ ≮ 1́ _́", "", " \n\t", "word" * 3000, None]


def test_ids_are_those_of_the_library(encoder):
    assert encoder.by_word and encoder.lower and encoder.kind.itemsize == 2
    for texts in (TEXTS, [t for t in TEXTS if not t or "<|" not in t]):
        flat, counts = encoder.encode(pa.array(texts, pa.string()))
        want = [plain_ids(encoder, t) for t in texts]
        assert counts.tolist() == [len(x) for x in want] and flat.tolist() == [i for x in want for i in x]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("abSTL'’ \n\t.,!<|>_-0129éÉß̸́İΣς日　\x1f"), st.characters(exclude_categories=("Cs",))), max_size=30), max_size=4))
def test_ids_of_any_text_are_those_of_the_library(texts):
    encoder = binary_tokens.loaded(TOKENIZER)
    flat, counts = encoder.encode(pa.array(texts, pa.string()))
    assert flat.tolist() == [i for t in texts for i in plain_ids(encoder, t)] and len(counts) == len(texts)


def test_words_may_be_forgotten(monkeypatch, encoder):
    own = binary_tokens.WordTokenizer(TOKENIZER)
    monkeypatch.setattr(binary_tokens, "MEMORY_BYTES", 4000)
    rng = random.Random(2)
    for _ in range(12):
        texts = [" ".join(f"the {rng.choice('abcdef') * rng.randrange(1, 40)}" for _ in range(30)) for _ in range(3)]
        flat, _ = own.encode(pa.array(texts))
        assert flat.tolist() == [i for t in texts for i in plain_ids(encoder, t)]
    assert own.held < 30_000 and b"the" in own.known


def test_other_tokenizers_take_whole_texts():
    own = binary_tokens.WordTokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    assert not own.by_word
    flat, counts = own.encode(pa.array(TEXTS, pa.string()))
    assert flat.tolist() == [i for t in TEXTS for i in plain_ids(own, t)] and counts.sum() == len(flat)


def test_files_hold_all_documents_in_order(spark, empty, tmp_path, encoder):
    rows = [*corpus(), *((None, f"no id {i % 7}", "en", "s", 1) for i in range(40)), (5, "same id", "en", "s", 1), (5, "same id, other text", "en", "s", 1), (6, "<|endoftext|> inside", "en", "s", 1)]
    folder = f"{tmp_path}/tokens"
    manifest = binary_tokens.write_tokens(frame(spark, rows).repartition(5), folder, TOKENIZER, part_bytes=2000)
    want = {}
    for r in rows:
        want.setdefault(r[0], []).append(plain_ids(encoder, r[1]))
    data = binary_tokens.Tokens(folder)
    assert len(data) == len(rows) == manifest["documents"] and manifest["ids"] == sum(len(x) for v in want.values() for x in v) and len(manifest["parts"]) > 4
    assert [p["first_id"] for p in manifest["parts"]] == np.cumsum([0, *(p["ids"] for p in manifest["parts"])])[:-1].tolist()
    got = sorted(binary_tokens.read_tokens(spark, folder).collect(), key=lambda r: r.start)
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda x: (x is not None, x))
    at = 0
    for i, r in enumerate(got):
        assert r.start == at
        at += r.n_tokens
        own = data[i].tolist()
        want[r.doc_id].remove(own)
        assert len(own) == r.n_tokens and zlib.crc32(np.array(own, "<u4").tobytes()) == r.ids_crc32
    assert not any(want.values())
    with pytest.raises(IndexError):
        data[len(rows)]
    part = binary_tokens.Part(folder, manifest, manifest["parts"][0])
    assert np.concatenate(list(part.chunks(0, 3))).tolist() == part[0].tolist() and isinstance(part[0].base, np.ndarray)
    assert json.loads((tmp_path / "tokens/manifest.json").read_text()) == manifest
    none = binary_tokens.write_tokens(empty, f"{tmp_path}/none", TOKENIZER)
    assert none["parts"] == [] and binary_tokens.read_tokens(spark, f"{tmp_path}/none").count() == 0 and len(binary_tokens.Tokens(f"{tmp_path}/none")) == 0
