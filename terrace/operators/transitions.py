"""Change between maps: matrices, consistency rules, decomposition of change, trajectories. Epoch maps are columns of one pixel table."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.grid import GridSpec
from terrace.schema import FOREST, SWIDDEN, TRAJECTORIES, TREE_CROP, WATER
from terrace.scratch import materialize


def align(maps: dict[int, DataFrame]) -> DataFrame:
    """row, col, traj: the classes of all epochs in order, of pixels that every map has. One shuffle, whatever the number of epochs."""
    each = [m.select("row", "col", F.lit(year).alias("epoch"), F.col("cls").cast("int").alias("cls")) for year, m in maps.items()]
    rows = reduce(DataFrame.unionByName, each).where("cls is not null")
    joined = rows.groupBy("row", "col").agg(F.sort_array(F.collect_list(F.struct("epoch", "cls"))).alias("t"))
    return joined.where(F.size("t") == len(maps)).select("row", "col", F.col("t.cls").alias("traj"))


def transition_counts(pixels: DataFrame, pairs: list[tuple[str, str, str]], classes: list[int], grid: GridSpec) -> DataFrame:
    """interval, from_cls, to_cls, n_pixels, area_ha for each (interval, first, second): all intervals in one pass over the pixels."""
    both = F.explode(F.array(*[F.struct(F.lit(k).alias("interval"), F.col(a).cast("int").alias("from_cls"), F.col(b).cast("int").alias("to_cls")) for k, a, b in pairs]))
    rows = pixels.select("row", both.alias("p")).select("row", "p.*").where(F.col("from_cls").isin(classes) & F.col("to_cls").isin(classes))
    done = rows.groupBy("interval", "from_cls", "to_cls").agg(F.count(F.lit(1)).alias("n_pixels"), F.sum(grid.pixel_area_ha()).alias("_ha"))
    return done.select("interval", "from_cls", "to_cls", "n_pixels", F.bround("_ha", 4).alias("area_ha"))


def transition_matrix(pixels: DataFrame, first: str, second: str, classes: list[int], grid: GridSpec) -> DataFrame:
    """from_cls, to_cls, n_pixels, area_ha for every pair of classes, empty ones too; only classes above 0 in both maps count."""
    found = transition_counts(pixels, [("", first, second)], classes, grid).drop("interval")
    every = pixels.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, classes))).alias("from_cls")).withColumn("to_cls", F.explode(F.array(*map(F.lit, classes))))
    joined = every.join(found, ["from_cls", "to_cls"], "left")
    return joined.select("from_cls", "to_cls", F.coalesce("n_pixels", F.lit(0)).cast("long").alias("n_pixels"), F.coalesce("area_ha", F.lit(0.0)).alias("area_ha"))


def rule_code(a: Column, b: Column) -> Column:
    return (a * 256 + b).cast("int")


def consistent(t1: Column, t2: Column, rules: list[tuple[int, int]], *, target: str = "t2", replacement: dict[tuple[int, int], int] | None = None, stable: Column | None = None) -> tuple[Column, Column]:
    """(corrected class of the target date, whether it was changed). A pair in rules takes its replacement or else the other date's class."""
    bad = [a for pair in rules for a in pair if not 0 <= a <= 255]
    if bad or target not in ("t1", "t2"):
        raise ValueError(f"classes run from 0 to 255 and the target is t1 or t2: {bad} {target}")
    own, other = (t2, t1) if target == "t2" else (t1, t2)
    hit = F.coalesce(rule_code(t1, t2).isin([a * 256 + b for a, b in rules]), F.lit(False))
    if stable is not None:
        hit = hit & F.coalesce(stable, F.lit(False))
    value = other
    if replacement:
        table = F.create_map(*[F.lit(x) for (a, b), c in replacement.items() for x in (a * 256 + b, c)])
        value = F.coalesce(F.try_element_at(table, rule_code(t1, t2)), other)
    return F.when(hit, value).otherwise(own).cast("int"), hit


def enforce(t1: Column, t2: Column, everywhere: list[tuple[int, int]], if_stable: list[tuple[int, int]], stable: Column) -> tuple[Column, Column]:
    """(t1 corrected to t2's class, whether it was): pairs of the first set wherever they occur, pairs of the second only on stable pixels."""
    first, hit = consistent(t1, t2, everywhere, target="t1")
    second, more = consistent(t1, t2, if_stable, target="t1", stable=stable)
    return F.when(hit, first).otherwise(second), hit | more


def consistent_series(cols: list[str], rules: list[tuple[int, int]], *, anchor: str = "last", replacement: dict | None = None) -> list[Column]:
    """Corrected maps from the anchor on: each is held against its neighbour as corrected already."""
    done: dict[str, Column] = {}
    order = cols[::-1] if anchor == "last" else cols
    for k, c in enumerate(order):
        if k == 0:
            done[c] = F.col(c).cast("int")
        elif anchor == "last":
            done[c] = consistent(F.col(c), done[order[k - 1]], rules, target="t1", replacement=replacement)[0]
        else:
            done[c] = consistent(done[order[k - 1]], F.col(c), rules, target="t2", replacement=replacement)[0]
    return [done[c].alias(c) for c in cols]


def bidirectional(pixels: DataFrame, cols: list[str], backward: list[tuple[int, int]], forward: list[tuple[int, int]]) -> DataFrame:
    """pixels with corrected cols and <c>_qa (1: by the backward pass, 2: by the forward pass); pixels with a class of 0 or null in any map stay as they are."""
    valid = reduce(lambda a, b: a & b, [F.coalesce(F.col(c) > 0, F.lit(False)) for c in cols])
    out = pixels.withColumn("_valid", valid)
    for c in cols:
        out = out.withColumn(f"{c}_qa", F.lit(0))
    codes = lambda rules: [a * 256 + b for a, b in rules]
    steps = [(cols[k], cols[k + 1], codes(backward), 1) for k in range(len(cols) - 2, -1, -1)] + [(cols[k + 1], cols[k], codes(forward), 2) for k in range(len(cols) - 1)]
    for own, other, rules, bit in steps:
        a, b = (own, other) if bit == 1 else (other, own)
        hit = F.col("_valid") & rule_code(F.col(a), F.col(b)).isin(rules)
        out = out.withColumns({own: F.when(hit, F.col(other)).otherwise(F.col(own)), f"{own}_qa": F.when(hit, F.col(f"{own}_qa").bitwiseOR(F.lit(bit))).otherwise(F.col(f"{own}_qa"))})
    return out.drop("_valid")


def two_date(t1: Column, t2: Column, backward: list[tuple[int, int]], forward: list[tuple[int, int]]) -> tuple[Column, Column, Column]:
    """(t1, t2, qa): both passes look at the pair as it was."""
    code = rule_code(t1, t2)
    back, forth = code.isin([a * 256 + b for a, b in backward]), code.isin([a * 256 + b for a, b in forward])
    return F.when(back, t2).otherwise(t1), F.when(forth, t1).otherwise(t2), F.when(forth, 2).when(back, 1).otherwise(0)


def trajectory_class(traj: Column) -> Column:
    """1 to 9 for an array of classes over the epochs."""
    first, last, n = F.element_at(traj, 1), F.element_at(traj, -1), F.size(traj)
    step = F.zip_with(F.slice(traj, 1, n - 1), F.slice(traj, 2, n - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    odd = F.exists(step, lambda s: ((s["a"] != 1) & (s["b"] == 1)) | ((s["a"] == 16) & s["b"].isin(1, 2, 3, 4, 11, 12, 13, 14)))
    back = (n >= 3) & (first == last) & F.exists(F.slice(traj, 2, F.greatest(n - 2, F.lit(0))), lambda x: x != first)
    return (
        F.when(F.forall(traj, lambda x: x == first), 1).when(odd | back, 9).when(F.forall(traj, lambda x: x.isin(*WATER)), 7)
        .when((first != 16) & (last == 16), 6).when(~first.isin(*TREE_CROP) & last.isin(*TREE_CROP), 5).when(F.forall(traj, lambda x: x.isin(*SWIDDEN)), 4)
        .when(first.isin(*SWIDDEN) & last.isin(*FOREST), 3).when(first.isin(*FOREST) & (last.isin(*SWIDDEN) | (last == 16)), 2).otherwise(8)
    )


def trajectory_area(pixels: DataFrame, cols: list[str], grid: GridSpec) -> DataFrame:
    """trajectory, label, n_pixels, area_ha (2 places), share_pct (of the rounded areas): nine rows; pixels above 0 in all maps."""
    valid = reduce(lambda a, b: a & b, [F.col(c) > 0 for c in cols])
    counts = pixels.where(valid).groupBy(trajectory_class(F.array(*[F.col(c).cast("int") for c in cols])).alias("trajectory")).agg(F.count(F.lit(1)).alias("n"), F.sum(grid.pixel_area_ha()).alias("ha"))
    labels = pixels.sparkSession.createDataFrame(list(TRAJECTORIES.items()), "trajectory int, label string")
    table = labels.join(counts, "trajectory", "left").select("trajectory", "label", F.coalesce("n", F.lit(0)).cast("long").alias("n_pixels"), F.bround(F.coalesce("ha", F.lit(0.0)), 2).alias("area_ha"))
    total = table.agg(F.sum("area_ha").alias("_total"))
    return table.crossJoin(F.broadcast(total)).select("trajectory", "label", "n_pixels", "area_ha", F.when(F.col("_total") > 0, F.bround(F.col("area_ha") / F.col("_total") * 100, 2)).otherwise(0.0).alias("share_pct"))  # nine rows by one


def change_summary(matrix: DataFrame, years: float) -> DataFrame:
    """A row for each interval and class of a table of interval, from_cls, to_cls, area_ha: areas, gain, loss, net, quantity, allocation, exchange, shift, total, pct, rate."""
    m = matrix.select("interval", F.col("from_cls").alias("i"), F.col("to_cls").alias("j"), F.col("area_ha").alias("a"))
    sides = m.select("interval", F.explode(F.array(F.struct(F.col("i").alias("cls"), F.col("a").alias("t1"), F.lit(0.0).alias("t2"), F.when(F.col("i") == F.col("j"), F.col("a")).otherwise(0.0).alias("same")), F.struct(F.col("j").alias("cls"), F.lit(0.0).alias("t1"), F.col("a").alias("t2"), F.lit(0.0).alias("same")))).alias("s")).select("interval", "s.*")
    per = sides.groupBy("interval", "cls").agg(F.sum("t1").alias("t1"), F.sum("t2").alias("t2"), F.sum("same").alias("same"))
    other = m.select("interval", F.col("j").alias("i"), F.col("i").alias("j"), F.col("a").alias("b"))
    swap = m.where("i <> j").join(other, ["interval", "i", "j"]).groupBy("interval", F.col("i").alias("cls")).agg((2 * F.sum(F.least("a", "b"))).alias("ex"))
    whole = m.groupBy("interval").agg(F.greatest(F.sum("a"), F.lit(1e-6)).alias("land"))
    t = per.join(swap, ["interval", "cls"], "left").join(F.broadcast(whole), "interval").withColumn("ex", F.coalesce("ex", F.lit(0.0)))
    t = t.withColumn("loss", F.col("t1") - F.col("same")).withColumn("gain", F.col("t2") - F.col("same")).withColumn("alloc", 2 * F.least("loss", "gain"))
    rate = F.when((F.col("t1") > 0) & (F.col("t2") > 0), F.bround(F.log(F.greatest(F.col("t2"), F.lit(1e-300)) / F.greatest(F.col("t1"), F.lit(1e-300))) / max(years, 0.1) * 100, 3)).otherwise(0.0)
    r = lambda c: F.bround(c, 4)
    return t.select(
        "interval", "cls", r(F.col("t1")).alias("area_t1"), r(F.col("t2")).alias("area_t2"), r(F.col("loss")).alias("loss"), r(F.col("gain")).alias("gain"), r(F.col("t2") - F.col("t1")).alias("net"),
        r(F.abs(F.col("gain") - F.col("loss"))).alias("quantity"), r(F.col("alloc")).alias("allocation"), r(F.col("ex")).alias("exchange"), r(F.greatest(F.lit(0.0), F.col("alloc") - F.col("ex"))).alias("shift"),
        r(F.col("loss") + F.col("gain")).alias("total"), F.bround((F.col("loss") + F.col("gain")) / F.col("land") * 100, 3).alias("total_pct"), rate.alias("rate_pct"),
    )


def change_overall(summary: DataFrame) -> DataFrame:
    """interval, landscape, persistence, quantity, allocation, exchange, shift, total (2 places): half the sums over the classes; and three of them in percent of the landscape (3 places)."""
    half = lambda c: F.bround(F.sum(c) / 2, 2).alias(c)
    s = summary.groupBy("interval").agg(F.greatest(F.sum("area_t1"), F.lit(1e-6)).alias("_land"), F.bround(F.sum(F.col("area_t1") - F.col("loss")), 2).alias("persistence"), half("quantity"), half("allocation"), half("exchange"), half("shift"))
    s = s.withColumn("total", F.bround(F.col("quantity") + F.col("allocation"), 2))
    pct = [F.bround(F.col(c) / F.col("_land") * 100, 3).alias(f"{c}_pct") for c in ("quantity", "allocation", "total")]
    return s.select("interval", F.bround("_land", 2).alias("landscape"), "persistence", "quantity", "allocation", "exchange", "shift", "total", *pct)


@dataclass(frozen=True)
class ChangeAnalysis:
    """All tables of change over several epochs: matrices of each interval and of first to last ("net"), measures by class and overall, trajectories."""

    matrices: DataFrame
    summary: DataFrame
    overall: DataFrame
    trajectories: DataFrame


def analyse(pixels: DataFrame, epochs: dict[int, str], classes: list[int], grid: GridSpec) -> ChangeAnalysis:
    """The whole analysis of maps in columns, by year: of pixels that have a class above 0 in every map. All matrices come from one pass."""
    years = sorted(epochs)
    if len(years) < 2:
        raise ValueError("change takes two epochs at least")
    cols = [epochs[y] for y in years]
    valid = pixels.where(reduce(lambda a, b: a & b, [F.col(c) > 0 for c in cols]))
    spans = [(f"{a}-{b}", a, b) for a, b in zip(years, years[1:], strict=False)] + [("net", years[0], years[-1])]
    matrices = materialize(transition_counts(valid, [(n, epochs[a], epochs[b]) for n, a, b in spans], classes, grid), "matrices")
    summary = reduce(DataFrame.unionByName, [change_summary(matrices.where(F.col("interval") == n), b - a) for n, a, b in spans])
    return ChangeAnalysis(matrices, summary, change_overall(summary), trajectory_area(pixels, cols, grid))


def sankey_links(matrix: DataFrame, least_ha: float, top: int | None = None) -> DataFrame:
    """interval, source, target, area_ha of links of at least least_ha; with top only the largest of each interval."""
    from pyspark.sql import Window

    links = matrix.where(F.col("area_ha") >= least_ha).select("interval", F.col("from_cls").alias("source"), F.col("to_cls").alias("target"), "area_ha")
    if top is None:
        return links
    order = Window.partitionBy("interval").orderBy(F.desc("area_ha"), "source", "target")
    return links.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= top).drop("_n")
