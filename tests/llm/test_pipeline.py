"""The pipeline: each stage against plain code on its own input, and on odd rows."""

import public_tokenizers
import pyarrow as pa
import pytest
from llm_plain import components, words_ws
from pyspark.sql import functions as F

import corpus_pipeline
from terrace.llm import packing
from terrace.scratch import materialize

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    (_, q), (_, e), (_, n), (_, m), (_, p) = corpus_pipeline.STAGES

    good = materialize(q(spark, docs, SF), "q")
    ids = {r.doc_id for r in good.collect()}
    assert good.columns == columns and sum((labels[i] == 1) == (i in ids) for i in labels) >= 0.97 * len(labels)

    once = materialize(e(spark, good, SF), "e")
    want = {}
    for r in good.collect():
        want[r.text] = max(want.get(r.text, -1), r.doc_id)
    assert once.columns == columns and sorted(r.doc_id for r in once.collect()) == sorted(want.values())

    near = materialize(n(spark, once, SF), "n")
    group = components({r.doc_id: r.text for r in once.collect()}, 5, 4, 5)
    assert near.columns == columns and sorted(r.doc_id for r in near.collect()) == sorted({c for _, c in group.values()})

    mixed = materialize(m(spark, near, SF), "m")
    size, taken = {}, {}
    for r in near.collect():
        size[r.source] = size.get(r.source, 0) + len(words_ws(r.text))
    for r in mixed.collect():
        taken[r.source] = taken.get(r.source, 0) + len(words_ws(r.text))
    assert mixed.columns == columns and all(taken.get(s, 0) <= 2 * size[s] for s in size)
    assert abs(sum(taken.values()) - 1.5 * sum(size.values())) < 0.2 * sum(size.values())

    packed = p(spark, mixed, SF).toPandas()
    assert packed.groupby("sequence_id")["length"].sum().max() <= 2048
    assert packed[packed["piece"] == 0].shape[0] == mixed.count()


def test_stages_take_odd_rows(spark, odd, tmp_path):
    spark.createDataFrame([(1, 1, 0), (2, 1, 0), (8, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for rows, repeat in ((None, True), ([], False)):
        docs = odd() if rows is None else odd(rows, repeat)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            if name != "best-fit packing":
                assert out.columns == docs.columns, name
            assert out.count() >= 0
    assert F and public_tokenizers


@pytest.mark.parametrize("k", [0, 2, 4])
def test_stages_hand_small_batches_to_python(spark, tmp_path, k):
    bound, key = corpus_pipeline.BATCH_BYTES, "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.range(0, 4000, 1, 1).select(F.col("id").alias("doc_id"), F.concat(F.col("id"), F.repeat(F.lit(" word"), 400)).alias("text"), F.lit("s").alias("source"))
    docs = materialize(docs, "docs")
    spark.conf.unset(key)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "size"])

    try:
        corpus_pipeline.STAGES[k][1](spark, docs, str(tmp_path))
        got = docs.select("text").mapInArrow(sizes, "n long, size long").collect()
    finally:
        spark.conf.unset(key)
    assert sum(r.n for r in got) == 4000 and max(r.size for r in got) <= bound + 4096


def test_ranges_of_packing_need_no_python_workers(spark, monkeypatch):
    made, create = [], type(spark).createDataFrame
    monkeypatch.setattr(type(spark), "createDataFrame", lambda *a, **k: made.append(create(*a, **k)) or made[-1])
    monkeypatch.setattr(packing, "RANGE_ROWS", 100)
    pieces = spark.range(2000).select(F.col("id").alias("doc"), F.lit(0).alias("piece"), (F.pmod(F.xxhash64("id"), F.lit(2048)) + 1).alias("length"))
    packed = packing.pack(pieces).toPandas()
    assert made and all("LocalTableScan" in df._jdf.queryExecution().executedPlan().toString() for df in made)
    assert len(packed) == 2000 and packed.groupby("sequence_id")["length"].sum().max() <= 2048
