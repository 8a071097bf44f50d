"""What the third round's checks of larger tables found in the training-data operators."""

import zlib

from pyspark.sql import functions as F

from palisade.llm import lines, toxicity


def test_line_dedup_joins_small_tables_as_it_joins_large_ones(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"the same line stands in all of these documents again\nand number {i} is a line of its own, but for its number, here") for i in range(200)], "doc_id long, text string")
    plans, real = [], lines.materialise

    def kept(df, name="t"):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, name)

    monkeypatch.setattr(lines, "materialise", kept)
    out = lines.dedup(docs)
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert {r._removed for r in out.where("doc_id > 0").collect()} == {2}
    assert sum("SortMergeJoin" in p for p in plans) >= 7
    assert not any("Broadcast" in p for p in plans)


def test_toxicity_learns_from_every_labelled_row(spark, monkeypatch):
    usable = [i for i in range(9000) if zlib.crc32(str(i).encode()) % 4 != 2][:6500]
    ids = spark.createDataFrame([(i,) for i in usable[:3300]], "doc_id long").orderBy(F.xxhash64("doc_id"), "doc_id")
    last = {r.doc_id for r in ids.collect()[3000:]}  # the toxic rows beyond the first 3,000 by hash
    rows = [(i, f"some words {'vile' if i in last else 'nasty'} more words" if n < 3300 else "some words fine more words", "en") for n, i in enumerate(usable)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = docs.select("doc_id", F.when(F.col("text").contains("fine"), 0).otherwise(1).alias("toxic"))
    asked = spark.createDataFrame([(1, "more vile words", "en"), (2, "more fine words", "en"), (3, "more other words", "en")], "doc_id long, text string, lang string")
    for rows_of_a_task, most in ((8192, 1_000_000), (2000, 0)):  # one task, several; labels broadcast, shuffled
        monkeypatch.setattr(toxicity, "BROADCAST_LABELS", most, raising=False)
        monkeypatch.setattr(toxicity, "SHARD_ROWS", rows_of_a_task, raising=False)
        score = {r.doc_id: r.score for r in toxicity.score(asked, toxicity.fit(docs, labels)).collect()}
        assert score[1] > 0.9 > score[3] and score[2] < 0.1, score
