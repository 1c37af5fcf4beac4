"""Outputs: tables as CSV or JSON, accuracy reports, manifests, flow diagrams. Files go where Spark writes; only small summaries pass the driver."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.functions import geometry
from terrace.grid import GridSpec
from terrace.operators import accuracy, areas, sampling
from terrace.schema import CLASSES_18
from terrace.scratch import materialize


def write_csv(df: DataFrame, path: str) -> None:
    """A small summary in one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


@dataclass(frozen=True)
class AccuracyResult:
    """Tables of an assessment: overall and class_accuracy, the matrix, the area-weighted estimates, the samples."""

    overall: DataFrame
    classes: DataFrame
    matrix: DataFrame
    weighted: DataFrame | None
    adjusted: DataFrame | None
    samples: DataFrame

    def save(self, folder: str, prefix: str = "accuracy") -> list[str]:
        """overall as JSON, the others as CSV, each in a folder of its own; returns the folders."""
        at = lambda name: f"{folder.rstrip('/')}/{prefix}_{name}"
        self.overall.coalesce(1).write.mode("overwrite").json(at("overall"))
        tables = [n for n in ("classes", "matrix", "weighted", "adjusted", "samples") if getattr(self, n) is not None]
        for name in tables:
            write_csv(getattr(self, name), at(name))
        return [at(n) for n in ("overall", *tables)]


def class_names_of(reference: DataFrame, label: str, name: str) -> dict[int, str]:
    """The first name of each class, as the reference is read (a class each)."""
    if name not in reference.columns:
        raise ValueError(f"no column {name} among {reference.columns}")
    own = reference.select(F.col(label).try_cast("int").alias("c"), F.trim(F.col(name).cast("string")).alias("n"), F.monotonically_increasing_id().alias("at")).where("c IS NOT NULL AND n <> ''")
    return {r["c"]: r["n"] for r in own.groupBy("c").agg(F.min_by("n", "at").alias("n")).collect()}


def assess_samples(samples: DataFrame, *, counts: DataFrame | None = None, pixel_m2: float = 1.0, names: dict[int, str] | None = None, labels: list[int] | None = None, mapping: dict[int, int] | None = None, confidence: float = 0.95) -> AccuracyResult:
    """Accuracy of samples (ref_class, map_class). mapping goes entry by entry over samples, in one step over counts and labels; classes of 0 or less count for nothing in counts.

    Classes: labels, or all that samples, counts and names have above 0. No samples mean an error.
    """
    m = mapping or {}
    own = samples.withColumns({"ref_class": areas.remap_chain(F.col("ref_class"), m), "map_class": areas.remap_chain(F.col("map_class"), m)})
    own = own.withColumn("is_correct", (F.col("ref_class") == F.col("map_class")).cast("int"))
    matrix = materialize(accuracy.confusion(own), "confusion")
    if matrix.isEmpty():
        raise ValueError("there are no samples")
    if counts is not None:
        counts = counts.groupBy(areas.remap(F.col("cls"), m).cast("int").alias("cls")).agg(F.sum("n_pixels").alias("n_pixels")).where("cls > 0")
    if labels is not None:
        classes = sorted({m.get(c, c) for c in labels})
    else:
        seen = {r[0] for r in matrix.select(F.explode(F.array("map_class", "ref_class"))).distinct().collect()} | ({r[0] for r in counts.select("cls").distinct().collect()} if counts is not None else set())
        classes = sorted(c for c in seen | set(names or {}) if c > 0)
    every = matrix.sparkSession.createDataFrame([(c, (names or {}).get(c, f"Class_{c}")) for c in classes], "cls int, class_name string")
    inside = matrix.where(F.col("map_class").isin(classes) & F.col("ref_class").isin(classes))
    per = every.join(accuracy.class_accuracy(inside), "cls", "left").fillna(0, ["n_map", "n_ref"]).orderBy("cls")
    weighted = accuracy.area_weighted_overall(inside, counts) if counts is not None else None
    adjusted = every.join(accuracy.adjusted_area(inside, counts, pixel_m2, confidence), "cls").orderBy("cls") if counts is not None else None
    return AccuracyResult(accuracy.overall_accuracy(matrix, confidence), per, accuracy.confusion_table(inside, classes), weighted, adjusted, own)


def assess_map(
    pixels: DataFrame, reference: DataFrame, grid: GridSpec, *, cls: str = "cls", label: str = "class_id", key: str = "point_id", name_col: str | None = None, names: dict[int, str] | None = None, labels: list[int] | None = None,
    filter_col: str | None = None, filter_value: object = 1, mapping: dict[int, int] | None = None, area: bool = True, mode: str = "majority", confidence: float = 0.95, nodata: tuple[int, ...] = (0, -1, 255), epsg: int | None = None, folder: str | None = None,
) -> AccuracyResult:
    """Accuracy of a map at reference points (x, y) or polygons (ring or geometry; mode: majority, all_pixels or centroid), with its pixel counts as strata.

    Reference rows without a class or place, and those whose filter_col isn't filter_value, are left out; none left means an error. mapping
    goes in one step over what was sampled and over counts, then as in assess_samples.
    """
    for c in (label, filter_col):
        if c is not None and c not in reference.columns:
            raise ValueError(f"no column {c} among {reference.columns}")
    found = {} if name_col is None else class_names_of(reference, label, name_col)
    polygons = geometry.has_shapes(reference)
    own = reference if filter_col is None else reference.where(F.col(filter_col) == F.lit(filter_value))
    own = own.where(F.col(label).isNotNull() & (F.col(geometry.column_of(reference)).isNotNull() if polygons else F.col("x").isNotNull() & F.col("y").isNotNull()))
    if own.isEmpty():
        raise ValueError("no reference features are left")
    own = sampling.to_grid(own, epsg or grid.epsg, grid)
    good = pixels.where(F.col(cls).isNotNull() & ~F.col(cls).isin(*nodata))
    if polygons:
        got = sampling.polygon_samples(own, good, grid, mode=mode, poly=key, label=label, cls=cls)
    else:
        got = sampling.point_pixels(own, good, grid, bands=[cls], label=label, keep=(key,)).select(key, F.col(label).cast("int").alias("ref_class"), F.col(cls).cast("int").alias("map_class"))
    m = mapping or {}
    got = got.withColumns({c: areas.remap(F.col(c), m).cast("int") for c in ("ref_class", "map_class")})
    counts = areas.pixel_counts(pixels, m, cls, nodata) if area else None
    done = assess_samples(got, counts=counts, pixel_m2=grid.mean_pixel_area_m2(), names={**found, **(names or {})}, labels=labels, mapping=m, confidence=confidence)
    if folder is not None:
        done.save(folder)
    return done


def batch_summary(maps: dict[str, DataFrame], points: DataFrame, grid: GridSpec, **how) -> DataFrame:
    """name, year and overall measures of several maps."""
    rows = None
    for name, pixels in sorted(maps.items()):
        one = assess_map(pixels, points, grid, **{"area": False, **how}).overall.select(F.lit(name).alias("name"), F.regexp_extract(F.lit(name), r"(20\d\d)", 1).alias("year"), "*")
        rows = one if rows is None else rows.unionByName(one)
    return rows


def manifest(features: list[str], grid: GridSpec, stack_path: str, composite: str, sources: list[str]) -> str:
    """JSON text that tells what a feature stack holds."""
    return json.dumps({"stack_path": stack_path, "feature_names": features, "composite": composite, "epsg": grid.epsg, "resolution": [abs(grid.a), abs(grid.e)], "sources": sources}, indent=2)


def sankey_html(links: DataFrame, names: dict[int, str] = CLASSES_18, title: str = "Transitions") -> str:
    """A page that draws the links (a few hundred rows: interval, source, target, area_ha) as bars of flow, without any library."""
    rows = [r.asDict() for r in links.orderBy("interval", F.desc("area_ha")).collect()]
    data = [{**r, "source": names.get(r["source"], str(r["source"])), "target": names.get(r["target"], str(r["target"]))} for r in rows]
    return (
        f"<!doctype html><meta charset=utf-8><title>{title}</title><h1>{title}</h1><div id=f></div><script>const d={json.dumps(data)};const m=Math.max(1e-9,...d.map(x=>x.area_ha));"
        "for(const x of d){const e=document.createElement('div');e.textContent=`${x.interval}: ${x.source} to ${x.target}, ${x.area_ha} ha`;"
        "const b=document.createElement('div');b.style.cssText=`height:8px;background:#4a7;width:${100*x.area_ha/m}%`;document.getElementById('f').append(e,b)}</script>"
    )


def bar_chart(area: DataFrame, title: str = "Area by class") -> dict:
    """A chart description (Vega-Lite) of a class-area table."""
    rows = [r.asDict() for r in area.select("class_name", "area_ha").collect()]
    return {"title": title, "data": {"values": rows}, "mark": "bar", "encoding": {"x": {"field": "class_name", "type": "nominal"}, "y": {"field": "area_ha", "type": "quantitative"}}}


def class_area_report(pixels: DataFrame, grid: GridSpec, *, names: dict[int, str] | None = None, cls: str = "cls", csv: str | None = None, chart: str | None = None) -> DataFrame:
    """areas.class_area, also written as CSV to a folder and as a chart description to another, where they are named."""
    table = areas.class_area(pixels, grid, names, cls)
    if csv:
        write_csv(table, csv)
    if chart:
        text = json.dumps(bar_chart(table))
        table.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(chart)
    return table
