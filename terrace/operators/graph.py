"""Connected components by alternating large and small stars; all rounds stay on the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrace.scratch import drop_path, materialize, new_path, write_to

#: A node with more edges than this (or than a share of all edges, so that such nodes are never more than HUBS) is a hub.
HUB_EDGES, HUBS = 4096, 250_000


def _least_neighbour() -> Column:
    """Of each row's u the smallest v. Without hubs the edges of a node fit a task: a star needs no join and no broadcast then."""
    return F.min("v").over(Window.partitionBy("u"))


def _with_least(edges: DataFrame, least: DataFrame, hub: int) -> DataFrame:
    """edges with the m of their u. Rows of a hub stay where they are: hubs are broadcast, at most twice HUBS of them."""
    hubs = F.broadcast(least.where(F.col("n") > hub).select("u", "m"))
    rest = edges.join(hubs.select("u"), "u", "left_anti")
    return edges.join(hubs, "u").unionByName(rest.join(least.where(F.col("n") <= hub).select("u", "m"), "u"))


def _large_star(edges: DataFrame, hub: int | None) -> DataFrame:
    ends = F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
    both = edges.select(F.explode(ends).alias("e")).select("e.u", "e.v")
    if hub is None:
        seen = both.withColumn("m", F.least(_least_neighbour(), F.col("u"))).where("v > u")
        return seen.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").repartition("u").distinct()
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
    return _with_least(both.where("v > u"), least, hub).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(down: DataFrame, hub: int | None) -> DataFrame:
    """down: edges with u > v, as the large star gives them."""
    if hub is None:
        ends = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))
        return down.withColumn("m", _least_neighbour()).select(F.explode(ends).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    moved = _with_least(down, least, hub).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of edges (u, v: long, not null) but the roots; root is the smallest node reachable.

    Repeated edges, edges both ways and loops are allowed; no edges give no rows. Each round is written to the shared folder and
    the one before it deleted. The rounds end when all edges form stars: no node has two edges down, and none that has one is
    below another.
    """
    spark = edges.sparkSession
    now = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while True:
        ends = now.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("down"), F.lit(0).alias("up")), F.struct(F.col("v").alias("x"), F.lit(0).alias("down"), F.lit(1).alias("up")))).alias("e")).select("e.*")
        nodes = ends.groupBy("x").agg(F.sum("down").alias("down"), F.sum("up").alias("up"))
        many, odd, most = nodes.agg(F.coalesce(F.sum("down"), F.lit(0)), F.count_if((F.col("down") > 1) | ((F.col("down") > 0) & (F.col("up") > 0))), F.max(F.col("down") + F.col("up"))).first()
        if not odd:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        hub = max(HUB_EDGES, many // HUBS)
        path = new_path(spark, "stars")
        hub = hub if most > hub else None
        # The second star looks at edges down alone, of which the first gives a node no more than it has edges now.
        now = write_to(_small_star(_large_star(now, hub), hub), path)
        if before:
            drop_path(spark, before)
        before = path
