"""Exact deduplication as a stateful stream, with DataFrame operations only.

The stream keeps one state row for each digest, for ever (no watermark): the number of rows, and the identifier and the
place (file and row) of the row that stays. The state lives in RocksDB on the executors' disks and in the checkpoint. After
the stream has drained, the state is read as a table; every row that hit an existing digest is then compared with the
bytes of the row that stays, found by its place. Rows whose bytes differ (digest collisions) are grouped again by their bytes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.scratch import materialize, new_path

#: A group of copies is compared in slices of so many rows, each with its own copy of the text that stays.
SLICE_ROWS = 256
#: Digests of repeated texts and the places of the rows that stay are broadcast up to so many bytes; beyond that the tables are joined by shuffle.
BROADCAST_BYTES = 32 << 20

_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else each partition's store reserves megabytes
}


def sha256_hex(content: Column) -> Column:
    return F.sha2(content, 256)


def _content(text: str) -> Column:
    return F.coalesce(F.col(text), F.lit("")).cast("binary")


def digest_state(spark: SparkSession, arrivals: DataFrame, checkpoint: str) -> DataFrame:
    """Drain the stream `arrivals` (digest, doc, file, row) into keyed state under `checkpoint`; returns digest, n, keep.

    A second call with the same checkpoint goes on from the state it finds and takes in only what is new.
    """
    grouped = arrivals.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("doc", "file", "row")).alias("keep"))
    before = {k: spark.conf.get(k, None) for k in _STATE}
    for k, v in _STATE.items():
        spark.conf.set(k, v)
    try:
        query = grouped.writeStream.format("noop").outputMode("update").trigger(availableNow=True).option("checkpointLocation", checkpoint).start()
        query.awaitTermination()
        state = spark.read.format("statestore").load(checkpoint)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    n, keep = state.schema["value"].dataType.names
    return state.select(F.col("key.digest").alias("digest"), F.col(f"value.{n}").alias("n"), F.col(f"value.{keep}").alias("keep"))


def exact_dedup(
    spark: SparkSession, docs: DataFrame, *, path: str | None = None, id_col: str = "doc_id", text_col: str = "text",
    digest: Callable[[Column], Column] = sha256_hex, bytes_per_batch: int = 64 << 30, checkpoint: str | None = None,
    kept_col: str = "kept",
) -> DataFrame:
    """Every row of docs with keep_id, group_size, kept and text_sha256; of equal texts the row with the largest id stays.

    docs: a table read from files. path: its folder, if the stream may read that itself; else the digests are written once
    and streamed from there. Null text counts as empty; null ids rank lowest; of repeated rows with the same id exactly one
    is kept (the last by file and row); texts may be of any length; an empty table gives no rows; the result's columns replace
    input columns of the same name, and no other name clashes. With another kept_col that column alone is added.
    """
    # Input columns go by position inside, so that none clashes with what is made here.
    names = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    meta = docs.metadataColumn("_metadata")
    inner = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()], meta["file_path"].alias("file"), meta["row_index"].alias("row"))
    doc, content = F.col(names[id_col]).cast("long"), _content(names[text_col])
    if path is None:
        arrived = new_path(spark, "arrivals")
        slim = inner.select(doc.alias("doc"), digest(content).alias("digest"), "file", "row")
        slim.write.parquet(arrived)
        stream = spark.readStream.schema(slim.schema).option("maxBytesPerTrigger", bytes_per_batch).parquet(arrived)
    else:
        stream = spark.readStream.schema(docs.schema).option("maxBytesPerTrigger", bytes_per_batch).parquet(_pattern(path))
        meta = stream.metadataColumn("_metadata")
        stream = stream.select(F.col(f"`{id_col}`").cast("long").alias("doc"), digest(_content(f"`{text_col}`")).alias("digest"), meta["file_path"].alias("file"), meta["row_index"].alias("row"))
    state = digest_state(spark, stream, checkpoint or new_path(spark, "dedup-state"))
    repeated = materialize(state.where("n > 1").selectExpr("digest", "n as _n", "keep as _keep"), "repeated")
    if (repeated.agg(F.sum(F.length("digest") + F.length("_keep.file") + 64)).first()[0] or 0) <= BROADCAST_BYTES:
        repeated = F.broadcast(repeated)

    at = F.struct(doc.alias("doc"), "file", "row").alias("_at")
    marked = inner.select(*names.values(), at, digest(content).alias("digest")).join(repeated, "digest", "left")
    odd = materialize(_unequal(marked, names[text_col]), "unequal")
    group = F.coalesce(F.col("_n"), F.lit(1).cast("long"))
    keep = F.coalesce(F.col("_keep"), F.col("_at"))
    if not odd.isEmpty():
        again = odd.groupBy("digest", "content").agg(F.count(F.lit(1)).alias("_n2"), F.max("_at").alias("_keep2"))
        fixed = odd.join(again, ["digest", "content"]).select(F.col("_at").alias("_at2"), "_n2", "_keep2")
        fewer = odd.groupBy("digest").agg(F.count(F.lit(1)).alias("_fewer"))
        marked = marked.join(fewer, "digest", "left").join(fixed, marked["_at"].eqNullSafe(F.col("_at2")), "left")
        group = F.coalesce(F.col("_n2"), group - F.coalesce(F.col("_fewer"), F.lit(0)))
        keep = F.coalesce(F.col("_keep2"), keep)
    made = {"keep_id", "group_size", kept_col, "text_sha256"} if kept_col == "kept" else {kept_col}
    return marked.select(
        *[F.col(n).alias(c) for c, n in names.items() if c.lower() not in made], keep.eqNullSafe(F.col("_at")).alias(kept_col),
        *([keep["doc"].alias("keep_id"), group.cast("long").alias("group_size"), (F.col("digest") if digest is sha256_hex else sha256_hex(_content(names[text_col]))).alias("text_sha256")] if len(made) > 1 else []),
    )


def _pattern(path: str) -> str:
    """The same place as a pattern: a stream takes a single file only from a pattern."""
    path = path.rstrip("/")
    return f"{path[:-1]}[{path[-1]}]"


def _unequal(marked: DataFrame, text_col: str) -> DataFrame:
    """Rows with a repeated digest whose bytes are not those of the row that stays. Each group is dealt in slices."""
    slices = F.ceil(F.col("_n") / SLICE_ROWS).cast("int")
    hits = marked.where("_n is not null").select("digest", "_n", "_keep", "_at", _content(text_col).alias("content"))
    stays = hits.where("_at <=> _keep").select("digest", F.col("content").alias("kept_content"), F.explode(F.sequence(F.lit(0), slices - 1)).alias("slice"))
    copies = hits.where("not (_at <=> _keep)").withColumn("slice", F.pmod(F.xxhash64("_at.file", "_at.row"), slices).cast("int"))
    return copies.join(stays, ["digest", "slice"]).where("content <> kept_content").select("digest", "content", "_at")
