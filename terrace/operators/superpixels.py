"""Superpixels: pixels gather around seeds of a square grid by place and colour, and stay connected.

A pixel belongs to a cell of the grid and may join the seed of that cell or of its eight neighbours, whichever is nearest in (row,
col, features). Seeds move to the means of their pixels, round after round, until none moves any more or a number of rounds. A
round is a join of pixels with their cell's nine seeds and an aggregation by seed; only seeds are written. Sums are of
whole numbers (features in steps), so results don't depend on tasks or their order. In the end the connected patches of
each seed are found; its largest stays, others join the neighbour with which they share the longest border.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrace.functions.scalars import all_of, finite
from terrace.operators.components import TILE, patches
from terrace.operators.graph import components
from terrace.scratch import materialize

#: Steps of a feature's unit.
STEPS = 1_000_000


def _means(pixels: DataFrame, features: int) -> DataFrame:
    """sr, sc (a seed), r, c and x (an array) of rows with sr, sc: exact sums over counts."""
    sums = pixels.groupBy("sr", "sc").agg(F.count(F.lit(1)).alias("n"), F.sum("row").alias("r"), F.sum("col").alias("c"), *[F.sum(F.col("x")[k]).alias(f"x{k}") for k in range(features)])
    return sums.select("sr", "sc", (F.col("r") / F.col("n")).alias("r"), (F.col("c") / F.col("n")).alias("c"), F.array(*[F.col(f"x{k}") / F.col("n") for k in range(features)]).alias("x"))


def _around(seeds: DataFrame) -> DataFrame:
    """For each cell the seeds (at most nine) of it and its neighbours, in order."""
    near = F.array(*[F.struct((F.col("sr") + i).alias("cr"), (F.col("sc") + j).alias("cc")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    each = seeds.select(F.explode(near).alias("at"), F.struct("sr", "sc", "r", "c", "x").alias("seed"))
    return each.groupBy("at.cr", "at.cc").agg(F.sort_array(F.collect_list("seed")).alias("seeds"))


def _nearest(pixels: DataFrame, seeds: DataFrame, spacing: int, compactness: float) -> DataFrame:
    """pixels with sr, sc of the nearest seed; of equals the first by cell."""
    weight = (compactness / spacing) ** 2

    def away(s: Column) -> Column:
        colour = F.aggregate(F.zip_with(F.col("x"), s["x"], lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda t, v: t + v) / float(STEPS) ** 2
        return colour + weight * ((F.col("row") - s["r"]) * (F.col("row") - s["r"]) + (F.col("col") - s["c"]) * (F.col("col") - s["c"]))

    joined = pixels.join(_around(seeds), ["cr", "cc"])
    best = F.array_min(F.transform("seeds", lambda s: F.struct(away(s).alias("d"), s["sr"].alias("sr"), s["sc"].alias("sc"))))
    return joined.withColumn("best", best).select("row", "col", "x", F.col("best.sr").alias("sr"), F.col("best.sc").alias("sc"))


def gathered(pixels: DataFrame, bands: list[str], *, spacing: int = 6, compactness: float = 0.1, rounds: int = 10, still: float = 0.0) -> DataFrame:
    """row, col, sr, sc (the seed's cell) of pixels whose bands are all finite. Seeds are `spacing` pixels apart; rounds end when no seed moves by more than still (pixels, or features).

    bands count about alike if they go from 0 to 1; compactness is how much a distance of `spacing` counts against them. Rows of a pixel repeated count again.
    """
    if spacing < 1 or compactness < 0 or rounds < 1 or not bands:
        raise ValueError("spacing and rounds are at least 1, compactness isn't below 0, and there is a band")
    own = pixels.where(all_of([finite(F.col(b).cast("double")) for b in bands]) & F.col("row").isNotNull() & F.col("col").isNotNull())
    steps = F.array(*[F.bround(F.col(b).cast("double") * STEPS).cast("long") for b in bands])
    own = materialize(own.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), steps.alias("x"), F.floor(F.col("row") / spacing).alias("cr"), F.floor(F.col("col") / spacing).alias("cc")), "pixels")
    seeds = materialize(_means(own.select("row", "col", "x", F.col("cr").alias("sr"), F.col("cc").alias("sc")), len(bands)), "seeds")
    for k in range(rounds):
        moved = materialize(_means(_nearest(own, seeds, spacing, compactness), len(bands)), f"seeds-{k}")
        both = moved.join(seeds.select("sr", "sc", F.col("r").alias("pr"), F.col("c").alias("pc"), F.col("x").alias("px")), ["sr", "sc"])
        colour = F.array_max(F.zip_with("x", "px", lambda a, b: F.abs(a - b))) / STEPS
        most = both.agg(F.max(F.greatest(F.abs(F.col("r") - F.col("pr")), F.abs(F.col("c") - F.col("pc")), colour))).first()[0]
        before, seeds = seeds, moved
        if most is None or most <= still:
            break
    # What the last seeds are the means of.
    return _nearest(own, before, spacing, compactness).select("row", "col", "sr", "sc")


def superpixels(pixels: DataFrame, bands: list[str], *, spacing: int = 6, compactness: float = 0.1, rounds: int = 10, still: float = 0.0, least: int | None = None, tile: int = TILE) -> DataFrame:
    """row, col, seg (an id): segments are connected (by sides) unless what surrounds them has no pixels. See `gathered`.

    A seed's largest patch (of equals the first by row and column) stays a segment if it has `least` pixels (a quarter of a cell, if not
    given). Each other patch joins the neighbour with which it shares most sides (those that stay before others, then the first);
    patches that have no way to one that stays are a segment together. Pixels with a band that isn't finite have none.
    """
    least = max(1, spacing * spacing // 4) if least is None else least
    made = gathered(pixels, bands, spacing=spacing, compactness=compactness, rounds=rounds, still=still)
    numbered = made.select("row", "col", (F.shiftleft(F.col("sr") + (1 << 30), 31) + F.col("sc") + (1 << 30)).alias("cls"))
    own = materialize(patches(numbered, eight=False, tile=tile), "patches")
    each = own.groupBy("cls", "patch").agg(F.first("size").alias("size"))
    largest = Window.partitionBy("cls").orderBy(F.desc("size"), "patch")
    each = materialize(each.select("patch", ((F.row_number().over(largest) == 1) & (F.col("size") >= least)).alias("stays")), "stays")
    lost = own.join(each.where("NOT stays").select("patch"), "patch").select("row", "col", "patch")
    sides = F.explode(F.array(*[F.struct((F.col("row") + i).alias("row"), (F.col("col") + j).alias("col")) for i, j in ((0, 1), (1, 0), (0, -1), (-1, 0))]))
    beside = lost.select("patch", sides.alias("at")).select("patch", "at.row", "at.col").join(own.select("row", "col", F.col("patch").alias("other")), ["row", "col"])
    shared = beside.where("patch <> other").groupBy("patch", "other").count().join(each.select(F.col("patch").alias("other"), "stays"), "other")
    # Each patch that doesn't stay has one link, so what links join holds one patch that stays at most.
    links = shared.groupBy("patch").agg(F.max(F.struct("stays", "count", (-F.col("other")).alias("first"))).alias("to")).select(F.col("patch").alias("u"), (-F.col("to.first")).alias("v"))
    roots = components(links)
    return own.join(roots, own["patch"] == roots["node"], "left").select("row", "col", F.coalesce("root", "patch").alias("seg"))
