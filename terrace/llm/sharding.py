"""Shards of near equal bytes: a minimax contiguous partition of ordered groups that stay whole.

Rows with equal texts are a group; groups stand in the order of their smallest id. The smallest capacity for which a greedy
walk needs no more than the wanted shards is found by binary search. The walk only asks for the last group boundary before a
position. The driver holds a bounded sketch of the boundaries (running sums of bytes); where a walk's answer hangs on
boundaries between two that it holds, just those are fetched, as many as there are or, if too many, a finer sketch of them,
until the walk is exact. With the capacity known, each cut is the boundary nearest to its even share that keeps all shards
within the capacity.
"""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.llm.ranges import ranged_sums
from terrace.scratch import materialize

#: Boundaries in the first sketch, and boundaries fetched at once.
SKETCH, FETCH = 16_384, 100_000


class Boundaries:
    """Running sums at which a cut may stand, held in part. `inner[i]`: boundaries not held between known[i] and known[i + 1]."""

    def __init__(self, ends: DataFrame | None, total: int, known: list[tuple[int, int]]) -> None:
        """ends: column `upto` (the running sum with each group). known: some of them, with their ranks from 1, ascending."""
        self.ends, self.total = ends, total
        self._hold([(0, 0), *known])

    def _hold(self, points: list[tuple[int, int]]) -> None:
        points = sorted(set(points))
        self.known = [x for x, _ in points]
        self.rank = [r for _, r in points]
        self.inner = [b - a - 1 for a, b in zip(self.rank, self.rank[1:], strict=False)]

    def bounds(self, x: int) -> tuple[int, int]:
        """The last boundary up to x lies between these two; they are the same where it is known."""
        k = bisect.bisect_right(self.known, x) - 1
        low = self.known[k]
        return (low, x) if low < x and k < len(self.inner) and self.inner[k] else (low, low)

    def fetch(self, spans: list[tuple[int, int]]) -> bool:
        """Get the boundaries in the gaps that these spans touch, all or finer ones; whether there was one to get."""
        gaps = {k for a, b in spans for k in range(max(0, bisect.bisect_right(self.known, a) - 1), min(len(self.inner), bisect.bisect_right(self.known, b))) if self.inner[k]}
        if not gaps:
            return False
        merged: list[list[int]] = []
        for k in sorted(gaps):
            a, b = self.known[k], self.known[k + 1]
            if merged and merged[-1][1] == a:
                merged[-1][1] = b
            else:
                merged.append([a, b])
        where = F.lit(False)
        for a, b in merged:
            where = where | ((F.col("upto") > a) & (F.col("upto") < b))
        rows = self.ends.where(where)
        many = sum(self.inner[k] for k in gaps)
        if many > FETCH:
            step = max(1, sum(b - a for a, b in merged) // FETCH)
            rows = rows.groupBy(F.floor(F.col("upto") / step)).agg(F.max("upto").alias("upto"), F.max("rank").alias("rank"))
        self._hold([*zip(self.known, self.rank, strict=True), *((r.upto, r.rank) for r in rows.select("upto", "rank").collect())])
        return True


def _walk(edges: Boundaries, capacity: int, shards: int, low: bool) -> tuple[bool, list[tuple[int, int]]]:
    """Whether a greedy walk gets to the end, with all cuts as early (low) or as late as they may be; the spans passed."""
    at, spans = 0, []
    for _ in range(shards):
        if at + capacity >= edges.total:
            return True, spans
        a, b = edges.bounds(at + capacity)
        spans.append((a, b))
        at = a if low else b
    return at >= edges.total, spans


def smallest_capacity(edges: Boundaries, shards: int, largest: int) -> int:
    """The least capacity with which the greedy walk needs at most `shards` shards; no group is larger than `largest`."""
    low, high = max(largest, -(-edges.total // shards)), largest + -(-edges.total // shards)  # high always does
    while low < high:
        middle = (low + high) // 2
        sure, early = _walk(edges, middle, shards, True)
        may, late = _walk(edges, middle, shards, False)
        if sure:
            high = middle
        elif not may:
            low = middle + 1
        else:
            edges.fetch([(min(a, c), max(b, d)) for (a, b), (c, d) in zip(early, late, strict=False)] + early + late)
    return low


def even_cuts(edges: Boundaries, capacity: int, shards: int) -> list[int]:
    """Ends of the shards but the last: within the capacity, and each as near as can be to its even share."""
    def exact(x: int) -> int:
        while True:
            a, b = edges.bounds(x)
            if a == b:
                return a
            edges.fetch([(a, b)])

    def following(x: int) -> int:
        """The first boundary from x on."""
        a = exact(x)
        while a < x:
            k = bisect.bisect_right(edges.known, x - 1)
            if not edges.inner[k - 1]:
                return edges.known[k]
            edges.fetch([(edges.known[k - 1], edges.known[k])])
        return a

    least = [edges.total] * (shards + 1)
    for k in range(shards - 1, -1, -1):
        least[k] = following(max(0, least[k + 1] - capacity))
    cuts: list[int] = []
    for k in range(1, shards):
        last = cuts[-1] if cuts else 0
        ideal = min(edges.total, edges.total * k // shards)
        a = exact(ideal)
        b = following(ideal)
        best = a if ideal - a <= b - ideal else b
        cuts.append(min(max(best, least[k], last), exact(min(last + capacity, edges.total))))
    return cuts


def shard(docs: DataFrame, shards: int = 24, *, id_col: str = "doc_id", text_col: str = "text", overhead: int = 8) -> DataFrame:
    """A row for each row of docs: id, size, text_crc32, digest, shard (from 0), slot (gapless from 0 in each shard).

    Null text has no bytes (size: the overhead) and is a group of its own with empty text; null ids stand first. Repeated
    rows stay together, and each has its slot. A group larger than an even share fills a shard alone or nearly so, and later
    shards may then be empty. An empty table gives an empty one; other columns are not read.
    """
    content = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.sha2(content, 256).alias("digest"), (F.octet_length(content) + overhead).cast("long").alias("size"), F.crc32(content).cast("long").alias("text_crc32"))
    rows = materialize(rows, "sizes")
    groups = materialize(rows.groupBy("digest").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("many"), F.min("doc").alias("leader")), "groups")
    n, n_groups, total, largest = groups.agg(F.sum("many"), F.count(F.lit(1)), F.sum("bytes"), F.max("bytes")).first()
    n, total, largest = n or 0, total or 0, largest or 0
    ends = ranged_sums(groups, ["leader", "digest"], ["bytes", "many"], n_groups, "groups-sorted").withColumn("upto", F.col("bytes_before") + F.col("bytes")).withColumn("rank", F.col("row_before") + 1)
    step = max(1, -(-total // SKETCH))
    sketch = ends.groupBy(F.floor(F.col("upto") / step)).agg(F.max("upto").alias("upto"), F.max("rank").alias("rank")).select("upto", "rank").collect()  # at most SKETCH + 1 rows
    edges = Boundaries(ends.select("upto", "rank"), total, [(r.upto, r.rank) for r in sketch])
    cuts = even_cuts(edges, smallest_capacity(edges, shards, largest), shards) if total else []
    which = F.lit(0)
    for c in cuts:
        which = which + (F.col("bytes_before") >= c).cast("int")
    placed = materialize(ends.select("digest", "leader", "many", which.cast("int").alias("shard"), F.col("many_before").alias("_rows_before")), "placed")
    first = {r.shard: r.first for r in placed.groupBy("shard").agg(F.min("_rows_before").alias("first")).collect()}  # at most a row for each shard
    start = F.lit(0)
    for k, v in first.items():
        start = F.when(F.col("shard") == k, F.lit(v)).otherwise(start)
    # A group's rows stand from its first slot on; those of large groups are ranked in many tasks.
    single = placed.where("many = 1").select("digest", "shard", (F.col("_rows_before") - start).alias("slot"))
    several = placed.where("many > 1").select("digest", "shard", (F.col("_rows_before") - start).alias("_first"))
    alone = rows.join(single, "digest").select("doc", "size", "text_crc32", "digest", "shard", "slot")
    copies = rows.join(several.select("digest", "shard", "_first"), "digest")
    copies = materialize(copies, "copies")
    summed = ranged_sums(copies, ["shard", "_first", "digest", "doc"], ["size"], copies.count(), "copies-sorted").drop("size_before")
    begin = summed.groupBy("digest").agg(F.min("row_before").alias("_begin"))
    together = summed.join(begin, "digest").select("doc", "size", "text_crc32", "digest", "shard", (F.col("_first") + F.col("row_before") - F.col("_begin")).alias("slot"))
    return alone.unionByName(together).select(F.col("doc").alias(id_col), "size", "text_crc32", "digest", "shard", F.col("slot").cast("long").alias("slot"))
