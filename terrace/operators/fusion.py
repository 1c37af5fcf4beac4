"""Fusion of pixel and segment probabilities, confusion and stability, and the rules that refine the classes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.functions.scalars import confusion_index, top_two
from terrace.schema import SENSITIVITY, SMOOTHNESS, TAU


@dataclass(frozen=True)
class MaskRule:
    """Classes `source` become `target` where the mask `require` is `value` and the mask `exclude` isn't `exclude_value`."""

    source: tuple[int, ...]
    target: int
    require: str | None = None
    value: int = 1
    exclude: str | None = None
    exclude_value: int = 1

    def hits(self, cls: Column) -> Column:
        hit = cls.isin(*self.source)
        if self.require:
            hit = hit & F.coalesce(F.col(self.require) == self.value, F.lit(False))
        if self.exclude:
            hit = hit & ~F.coalesce(F.col(self.exclude) == self.exclude_value, F.lit(False))
        return hit


def river_and_town_rules(corridor: str, settlement: str, built: int = 16, water: int = 17, riverbed: int = 18) -> list[MaskRule]:
    return [MaskRule((built,), water, corridor, 1, settlement, 1), MaskRule((water, riverbed), built, settlement, 1, corridor, 1)]


def resolve_rules(rules: list[MaskRule] = (), corridor: str | None = None, settlement: str | None = None, *, built: int = 16, water: int = 17, riverbed: int = 18) -> list[MaskRule]:
    """The user's rules first, then those of rivers and towns, as far as there are masks for them."""
    out = list(rules)
    if corridor:
        out.append(MaskRule((built,), water, corridor, 1, settlement, 1))
    if settlement:
        out.append(MaskRule((water, riverbed), built, settlement, 1, corridor, 1))
    return out


def apply_rules(cls: Column, rules: list[MaskRule]) -> Column:
    """Each rule sees what the one before it made."""
    for r in rules:
        cls = F.when(r.hits(cls), r.target).otherwise(cls)
    return cls


def rule_counts(pixels: DataFrame, rules: list[MaskRule], cls: str = "cls") -> DataFrame:
    """rule (from 1), n_changed, pct of all rows: one pass over the pixels for all rules."""
    if not rules:
        raise ValueError("no rules")
    now, hits = F.col(cls), []
    for r in rules:
        hits.append(r.hits(now))
        now = F.when(hits[-1], r.target).otherwise(now)
    totals = pixels.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.coalesce(h, F.lit(False))).alias(f"r{k}") for k, h in enumerate(hits, 1)])
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(f"r{k}").alias("n_changed")) for k in range(1, len(rules) + 1)]))
    return totals.select("n", each.alias("x")).select("x.*", F.when(F.col("n") > 0, F.bround(F.col("x.n_changed") / F.col("n") * 100, 4)).otherwise(0.0).alias("pct"))


def segment_means(pixels: DataFrame, seg: str = "seg", p: str = "p", bands: int = 18) -> DataFrame:
    """seg, mean (array): the mean of each band over each segment above 0. Partial sums leave the map side; a segment of any size is fine."""
    own = pixels.where(F.col(seg) > 0)
    done = own.groupBy(seg).agg(*[F.avg(F.col(p)[k].cast("double")).alias(f"_{k}") for k in range(bands)])
    return done.select(seg, F.array(*[F.col(f"_{k}") for k in range(bands)]).alias("mean"))


def blend(raw: Column, mean: Column, smoothness: list[float] = SMOOTHNESS, sensitivity: float = SENSITIVITY, normalize: bool = False) -> Column:
    """Pixel and segment probabilities, the segment's weighing more for smooth classes and less where they disagree; raw where there is no segment."""
    base = F.array(*[F.lit(max(0.2, min(0.9, s / 5))) for s in smoothness])
    pairs = F.arrays_zip(raw.alias("raw"), mean.alias("obj"), base.alias("w"))

    def one(x: Column) -> Column:
        w = x["w"] * (1 - sensitivity * F.least(F.lit(1.0), F.abs(x["obj"] - x["raw"])))
        return F.when(x["raw"].isNull(), None).otherwise(x["obj"] * w + x["raw"] * (1 - w))

    mixed = F.filter(F.transform(pairs, one), lambda x: x.isNotNull())
    if normalize:
        total = F.aggregate(mixed, F.lit(0.0), lambda a, x: a + x)
        mixed = F.transform(mixed, lambda x: F.when(total > 0, x / total).otherwise(0.0))
    return F.when(mean.isNull(), raw).otherwise(mixed)


def fuse(pixels: DataFrame, *, bands: int, scale: float = 10000.0, tau: float = TAU, rules: list[MaskRule] = (), merge_riverbed: bool = True, smoothness: list[float] = SMOOTHNESS) -> DataFrame:
    """row, col, lulc, is_stable, ci of pixels with p (scaled probabilities by class) and seg, and the masks that rules name.

    Stability is taken before any rule. A pixel whose probabilities are all 0 is background: 0 in all three.
    """
    raw = F.transform("p", lambda x: x / scale)
    own = pixels.withColumn("_raw", raw)
    means = segment_means(own, p="_raw", bands=bands)
    joined = own.join(means, "seg", "left").withColumn("_t", top_two(blend(F.col("_raw"), F.col("mean"), smoothness[:bands])))
    ci = confusion_index(F.col("_t.w"), F.col("_t.s"))
    joined = joined.withColumn("_ci", ci).withColumn("_cls", F.greatest(F.col("_t.wi"), F.lit(1)))
    cls = F.when(F.col("_cls").isin(17, 18) & F.col("_t.si").isin(15, 16) & (F.col("_ci") > 0.65), F.col("_t.si")).otherwise(F.col("_cls"))
    if merge_riverbed:
        cls = F.when(cls == 18, 17).otherwise(cls)
    cls = apply_rules(cls, list(rules))
    lit = F.exists("p", lambda x: x != 0)
    return joined.select("row", "col", F.when(lit, cls).otherwise(0).cast("int").alias("lulc"), F.when(lit, (F.col("_ci") <= tau).cast("int")).otherwise(0).alias("is_stable"), F.when(lit, F.col("_ci")).otherwise(0.0).alias("ci"))


def reallocate(p: dict[str, Column], canopy: Column, settlement: Column) -> dict[str, Column]:
    """Structural limits on probabilities by name (Primary, Secondary, Built, Grassland): low canopy turns primary forest into secondary, no town no built-up, high canopy no grassland."""
    low = canopy < 15
    return p | {
        "Primary": F.when(low, 0.0).otherwise(p["Primary"]), "Secondary": F.when(low, p["Secondary"] + p["Primary"]).otherwise(p["Secondary"]),
        "Built": F.when(settlement == 1, p["Built"]).otherwise(0.0), "Grassland": F.when(canopy > 12, 0.0).otherwise(p["Grassland"]),
    }


def unique_segments(seg: Column, tile: Column, stride: int = 300_000_000) -> Column:
    """Segment ids that are unique over tiles."""
    return seg.cast("long") + tile.cast("long") * stride


def segment_statistics(pixels: DataFrame, values: list[str], seg: str = "seg", most: int = 1024) -> DataFrame:
    """seg, n, <value>_mean and <value>_sd of each segment above 0 with at most `most` pixels; larger ones have null figures."""
    own = pixels.where(F.col(seg) > 0).groupBy(seg).agg(F.count(F.lit(1)).alias("n"), *[f(F.col(v).cast("double")).alias(f"{v}_{n}") for v in values for n, f in (("mean", F.avg), ("sd", F.stddev_pop))])
    return own.select(seg, "n", *[F.when(F.col("n") <= most, F.col(f"{v}_{n}")).alias(f"{v}_{n}") for v in values for n in ("mean", "sd")])


def fuse_by_object(pixels: DataFrame, *, bands: int, scale: float = 10000.0, tau: float = TAU, sensitivity: float = SENSITIVITY, smoothness: list[float] = SMOOTHNESS, guard_sd: float | None = None, merge_riverbed: bool = True) -> DataFrame:
    """row, col, lulc, conf, ci, runner_up, is_stable (conf and ci in hundredths), the variant in which the segment's own confusion damps its weight.

    guard_sd: segments with a band that varies more than this count for nothing. Blended probabilities are scaled to sum to 1.
    """
    own = pixels.withColumn("_raw", F.transform("p", lambda x: x / scale))
    seg = own.where("seg > 0").groupBy("seg").agg(
        F.array(*[F.avg(F.col("_raw")[k]) for k in range(bands)]).alias("_obj"), F.greatest(*[F.stddev_pop(F.col("_raw")[k]) for k in range(bands)]).alias("_sd") if bands > 1 else F.stddev_pop(F.col("_raw")[0]).alias("_sd"))
    t = own.join(seg, "seg", "left").withColumn("_obj", F.coalesce("_obj", "_raw")).withColumn("_o", top_two(F.col("_obj")))
    damp = 1 - confusion_index(F.col("_o.w"), F.col("_o.s")) * sensitivity
    if guard_sd is not None:
        damp = damp * (F.coalesce("_sd", F.lit(0.0)) <= guard_sd).cast("double")
    weights = F.array(*[F.lit(max(0.2, min(0.9, s / 5))) for s in smoothness[:bands]])
    mixed = F.transform(F.arrays_zip(F.col("_obj").alias("o"), F.col("_raw").alias("r"), weights.alias("w")), lambda x: x["o"] * (x["w"] * F.col("_damp")) + x["r"] * (1 - x["w"] * F.col("_damp")))
    t = t.withColumn("_damp", damp).withColumn("_mix", mixed)
    total = F.aggregate("_mix", F.lit(0.0), lambda a, x: a + x)
    t = t.withColumn("_b", top_two(F.transform("_mix", lambda x: x / F.when(total == 0, 1.0).otherwise(total))))
    ci = confusion_index(F.col("_b.w"), F.col("_b.s"))
    t = t.withColumn("_ci", ci).withColumn("_pct", F.bround(ci * 100).cast("int")).withColumn("_cls", F.greatest(F.col("_b.wi"), F.lit(1)))
    cls = F.when(F.col("_cls").isin(17, 18) & F.col("_b.si").isin(15, 16) & (F.col("_pct") > 65), F.col("_b.si")).otherwise(F.col("_cls"))
    cls = F.when((cls == 18) & (F.col("_b.si") == 15) & (F.col("_pct") > 75), 15).otherwise(cls)
    if merge_riverbed:
        cls = F.when(cls == 18, 17).otherwise(cls)
    return t.select("row", "col", cls.cast("int").alias("lulc"), F.bround(F.col("_b.w") * 100).cast("int").alias("conf"), F.col("_pct").alias("ci"), F.col("_b.si").alias("runner_up"), (F.col("_ci") <= tau).cast("int").alias("is_stable"))
