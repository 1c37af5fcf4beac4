"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A source's target is its share of the budget by weight, at most `cap` times its size; what it can't take is shared out
again. It is met by complete epochs, then by a part of one: each document draws an exponential key, divided by its quality
weight, and the documents with the smallest keys are taken up to the words that are left. The running sums come from a sort
by range over (source, key), so a source of any size is dealt over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.llm.ranges import ranged_sums
from terrace.scratch import materialize

#: So many sources (of some 100 bytes each) are broadcast; more are joined by shuffle.
BROADCAST_SOURCES = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """source, source_size, start, target: sizes has a row for each source (null is one). The weights repeat in order of code point, null last.

    start: the size of all sources before, in the order of a sort by source (null first). The rounds of sharing out are at most as
    many as there are different ratios of size and weight at which sources fill up; each is one sum over the sources.
    """
    nulls, many, whole = sizes.agg(F.sum(F.when(F.col("source").isNull(), F.col("source_size"))), F.count(F.lit(1)), F.sum("source_size")).first()
    named = sizes.select(F.col("source").isNull().alias("_null"), "source", "source_size")
    ranked = ranged_sums(named, ["_null", "source"], ["source_size"], many, "sources-sorted")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("row_before") % len(weights) + 1).cast("int"))
    start = F.when(F.col("_null"), 0).otherwise(F.col("source_size_before") + (nulls or 0))
    table = materialize(ranked.select("source", "source_size", start.cast("long").alias("start"), w.alias("weight")), "sources")
    budget = share * (whole or 0)
    level, full = 0.0, -1  # a source gets level x weight, or cap x size if that is less; level only rises
    while True:
        got = F.col("source_size") * cap <= F.lit(level) * F.col("weight")
        taken, free, now = table.agg(F.sum(F.when(got, F.col("source_size") * cap)), F.sum(F.when(~got, F.col("weight"))), F.count_if(got)).first()
        if now == full or not free:
            break
        level, full = (budget - (taken or 0.0)) / free, now
    return table.select("source", "source_size", "start", F.least(F.lit(level) * F.col("weight"), F.col("source_size") * F.lit(float(cap))).alias("target"))


def sampling_key(doc: Column, same: Column, quality_weight: Column, seed: int) -> Column:
    """An exponential variable, divided by the weight (1 if there is none): the smallest keys of a source are a sample by weight."""
    unit = (F.shiftrightunsigned(F.xxhash64(doc, same, F.lit(seed)), 11) + 0.5) / float(1 << 53)
    return -F.log(unit) / F.greatest(F.coalesce(quality_weight, F.lit(1.0)), F.lit(1e-6))


def mix(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", quality: DataFrame | None = None,
    weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: int = 42,
) -> DataFrame:
    """A row for each row of docs: id, source, same (a hash of the text), size, source_size, target, taken, times.

    quality: id and quality_weight (above 0), one row for each id; a document without one weighs 1. Null text has size 0,
    null source is a source of its own, the last; documents of size 0 are taken 0 words but as many times as there are
    complete epochs. Of a source's last epoch the document that crosses the target is taken if that ends nearer to it.
    Equal rows draw equal keys and stand in any order; reruns agree; an empty table gives an empty one. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc"), F.col(source_col).alias("source"), F.xxhash64(F.col(text_col)).alias("same"), word_count(F.col(text_col)).alias("size"))
    if quality is not None:
        rows = rows.join(quality.select(F.col(id_col).alias("doc"), "quality_weight"), "doc", "left")
    else:
        rows = rows.withColumn("quality_weight", F.lit(1.0))
    rows = materialize(rows.select("doc", "source", "same", "size", sampling_key(F.col("doc"), F.col("same"), F.col("quality_weight"), seed).alias("key")), "sizes")
    sizes = materialize(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")), "source-sizes")
    order = ["source", "key", "doc", "same"]
    summed = ranged_sums(rows, order, ["size"], rows.count(), "mix-sorted")
    per_source = materialize(source_targets(sizes.select("source", "source_size"), weights, share, cap), "targets")
    if per_source.count() <= BROADCAST_SOURCES:
        per_source = F.broadcast(per_source)
    joined = summed.alias("d").join(per_source.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.col("target") - F.col("epochs") * F.col("source_size")
    more = (F.col("size") > 0) & (F.col("size_before") - F.col("start") + F.col("size") / 2 <= rest)
    out = joined.select("doc", F.col("d.source").alias("source"), "same", "size", "size_before", "start", "source_size", "target").withColumn("epochs", epochs)
    out = out.withColumn("times", F.col("epochs") + more.cast("long"))
    return out.select(F.col("doc").alias(id_col), F.col("source").alias(source_col), "same", "size", "source_size", "target", (F.col("times") * F.col("size")).alias("taken"), "times")
