"""Running sums over a sorted table of any size: sort by range, sum within each range, add what stands before it."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrace.scratch import materialize

#: Rows of a range.
RANGE_ROWS = 250_000


def ranged_sums(df: DataFrame, order: list[str], sums: list[str], rows: int, name: str = "ranged") -> DataFrame:
    """df with <c>_before (the sum of c over the rows that stand before, in order) for each c of sums, and row_before.

    rows: about how many there are; it sets the number of ranges. The order must tell all rows apart that aren't alike. The
    sorted rows are written to the shared folder, so a lost executor doesn't deal them out anew. What is broadcast is one
    row for each range. Nothing but the sums of c must be non-null; an empty table gives an empty one.
    """
    parts = max(1, -(-rows // RANGE_ROWS), min(8, rows // 1000))
    made = [f"{c}_before" for c in sums] + ["row_before"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        so_far = [0] * (len(sums) + 1)
        for batch in batches:
            if not batch.num_rows:
                continue
            ones = pa.array([1] * batch.num_rows, pa.int64())
            out = list(batch.columns)
            for k, values in enumerate([*(batch.column(c).cast(pa.int64()) for c in sums), ones]):
                upto = pc.add(pc.cumulative_sum(values), so_far[k])
                out.append(pc.subtract(upto, values))
                so_far[k] = upto[-1].as_py()
            yield pa.RecordBatch.from_arrays(out, names=[*batch.schema.names, *made])

    cols = df.columns
    sorted_rows = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_range", F.spark_partition_id())
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in sorted_rows.schema] + [f"{c} long" for c in made])
    local = materialize(sorted_rows.mapInArrow(run, schema), name)
    totals = local.groupBy("_range").agg(*[F.sum(c).alias(f"{c}_sum") for c in sums], F.count(F.lit(1)).alias("row_sum"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_range", *[F.coalesce(F.sum(f"{c}_sum").over(before), F.lit(0)).alias(f"{c}_off") for c in [*sums, "row"]])
    joined = local.join(F.broadcast(offsets), "_range")
    return joined.select(*cols, *[(F.col(f"{c}_before") + F.col(f"{c}_off")).cast("long").alias(f"{c}_before") for c in [*sums, "row"]])
