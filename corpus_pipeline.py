"""A corpus pipeline: quality, exact copies, near copies, mixing, packing. Each stage takes all that the one before it kept."""

from __future__ import annotations

import uuid
from fractions import Fraction

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.llm.dedup import exact_dedup
from terrace.llm.jaccard import BROADCAST_ROWS, jaccard_groups
from terrace.llm.mixing import mix
from terrace.llm.packing import crc32, pack, tokenize_pieces
from terrace.llm.quality import score, train
from terrace.llm.queries import label_weights
from terrace.scratch import drop_path, new_path, scope, write_to

TOKENIZER = "word_bpe_49k.json"

#: Documents with a lower score are rejected.
LEAST_QUALITY = 0.7

#: Bytes of a batch of rows that a task hands to Python (one row at least). Spark's own limit, 64 MB, is held several times over by either
#: side of each task: growing buffers, their copies, and what the workers make of it and keep until they end.
BATCH_BYTES = 2 << 20

#: No SQL says what a trained classifier and a sampler keep; tests hold the stages against brute force.
ORACLE_SQL = None


def bound_batches(spark: SparkSession) -> None:
    """Bound the session's batches. This stays set: a stage's last job only runs when its result is written."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at least LEAST_QUALITY; the classifier learns from the labelled ones among docs.

    Null, empty and very long texts are scored as any other, repeated rows alike; an empty table gives an empty one; extra columns stay.
    """
    bound_batches(spark)
    model, name = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), f"score_{uuid.uuid4().hex}"
    return score(docs, model, out_col=name).where(F.col(name) >= LEAST_QUALITY).drop(name)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text: that with the largest id. Null text counts as empty, null ids rank lowest; an empty table gives an empty one; extra columns stay."""
    kept = f"kept_{uuid.uuid4().hex}"
    return exact_dedup(spark, docs, kept_col=kept).where(F.col(kept)).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a similarity of 0.8 over five-word shingles the document with the smallest id.

    Rows without an id and texts without words stay; of repeated rows all or none; an empty table gives an empty one; extra columns stay.
    """
    bound_batches(spark)
    path = new_path(spark, "near-copies")
    with scope(spark):
        groups = jaccard_groups(docs, width=5, similarity=Fraction(4, 5))
        others = write_to(groups.where("doc_id <> component_id").select("doc_id").distinct(), path)
    if others.count() <= BROADCAST_ROWS:
        others = F.broadcast(others)
    return docs.join(others, "doc_id", "left_anti").select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed corpus: each document as often as the mix takes it (never, once or twice); rows alike in id and text alike often.

    Null texts and sources, and null ids, are mixed as any other; an empty table gives an empty one; extra columns stay, whatever their names.
    """
    taken = mix(docs, quality=label_weights(spark, sf_dir)).groupBy(F.col("doc_id").alias("taken_id"), F.col("same").alias("taken_text")).agg(F.max("times").alias("taken_times")).where("taken_times > 0")
    inner = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns)])
    at = {c: F.col(f"c{k}") for k, c in enumerate(docs.columns)}
    found = inner.join(taken, at["doc_id"].eqNullSafe(F.col("taken_id")) & (F.xxhash64(at["text"]) == F.col("taken_text")))
    copies = found.select(*at.values(), F.explode(F.sequence(F.lit(1).cast("long"), F.col("taken_times"))).alias("taken_copy"))
    return copies.select(*[x.alias(c) for c, x in at.items()])


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the mixed corpus in sequences of 2048 tokens.

    Null and empty texts are a piece of one token, repeated rows have pieces of their own; an empty table gives an empty one.
    """
    bound_batches(spark)
    pieces = tokenize_pieces(docs, public_tokenizers.path(TOKENIZER), payload=("ids_crc32", "long", crc32))
    return pack(pieces).withColumnRenamed("doc", "doc_id")


STAGES = [
    ("quality classifier", quality_classifier), ("exact dedup", exact_copies), ("n-gram Jaccard join", near_copies),
    ("mixing sources to target weights", source_mix), ("best-fit packing", best_fit),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last stage gives. A stage's intermediate tables, and the table that it read, are deleted when its own is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES):
        path = new_path(spark, f"stage-{k}")
        with scope(spark):
            docs = write_to(stage(spark, docs, sf_dir), path)
        if before:
            drop_path(spark, before)
        before = path
    return docs
