"""The corpus pipeline against a plain version of its stages on a small corpus."""

import random

import corpus_pipeline as cp
from test_operators import plain_components, plain_hits, plain_lines

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def build(spark, path):
    rng = random.Random(8)
    sentence = lambda: " ".join(rng.choice("the old cat sat on a mat with his good hat and dog by that big house".split()) + str(rng.randrange(30)) for _ in range(12))
    prose = lambda n=6: "\n".join(sentence() for _ in range(n))
    base = prose(12)
    near = base.split()
    near[70] = "dog99"
    near = " ".join(near)
    junk = lambda: "".join(rng.choice("#%$&*@!XQZ") for _ in range(200))
    rows = [(i, prose(), "en") for i in range(120)] + [(200, base, "en"), (201, near, "en"), (202, base, None), (203, None, "en"), (204, "", "en")] + [(300 + i, junk(), "en") for i in range(5)]
    leak = " ".join(sentence().split()[:11])
    rows += [(400, prose(2) + "\n" + leak + " " + sentence(), "en"), (401, base.split("\n")[0] + "\n" + prose(3), "en")]
    spark.createDataFrame([(*r, "s", len(r[1] or "")) for r in rows], SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 300), 0) for i in [*range(0, 120, 2), 300, 301]], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, leak), (2, "words that are in no document of all, not one of them")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return rows, leak


def test_stages_and_run(spark, tmp_path):
    rows, leak = build(spark, str(tmp_path))
    assert [n for n, _ in cp.STAGES] == ["quality classifier", "line dedup", "near-dedup", "decontamination", "packing"]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for i, (name, stage) in enumerate(cp.STAGES):
        had = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()] if i < 5 else []
        docs = stage(spark, docs, str(tmp_path))
        if i == 4:
            break
        assert docs.columns == list(cp.COLUMNS)
        path = f"{tmp_path}/stage{i}"
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        got = {r.doc_id: r.text for r in docs.collect()}
        if i == 0:
            good = {d for d, t, _ in rows if t and d not in range(300, 305)}
            assert set(got) <= good and len(got) >= 0.97 * len(good)
        elif i == 1:
            assert got == {d: t for d, t in plain_lines(had) if t and t.strip()}
            assert all(r.n_chars == len(r.text) for r in docs.collect())
        elif i == 2:
            assert set(got) == {d for d, (_, c) in plain_components(had).items() if d == c} and 201 not in got
        elif i == 3:
            assert set(got) == {d for d, t in had if not plain_hits(t, [(1, leak)])[1]} and 400 not in got
    last = {r.doc_id for r in docs.select("doc_id").distinct().collect()}
    ran = cp.run(spark, str(tmp_path))
    assert {r.doc_id for r in ran.select("doc_id").distinct().collect()} == last == set(got)
