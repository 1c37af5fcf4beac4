"""Exact quantiles by counting: each pass counts values in finer steps around the wanted ranks, so no task holds a column."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Steps of a pass, and values near a rank that are sorted at last.
STEPS, LAST = 256, 50_000


def exact_quantiles(rows: DataFrame, group: Column, value: Column, quantiles: tuple[float, ...]) -> dict[object, list[float]]:
    """For each group (few: a class, a band) its quantiles, interpolated between neighbours in rank. Null groups and values that aren't finite count for nothing.

    The driver gets, for each group and quantile, at most STEPS counts a pass and LAST values in the end.
    """
    v = value.cast("double")
    own = rows.select(group.alias("g"), v.alias("v")).where(F.col("g").isNotNull() & F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") < float("inf")))
    about = {r["g"]: r for r in own.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect()}
    wanted = {(g, k) for g, r in about.items() for q in quantiles for k in (math.floor(q * (r["n"] - 1)), math.ceil(q * (r["n"] - 1)))}
    span = {(g, k): (about[g]["low"], about[g]["high"], 0, about[g]["n"]) for g, k in wanted}  # from, to, values before, values within
    known: dict[tuple, float] = {}
    spark = rows.sparkSession
    kind = next(f.dataType for f in own.schema if f.name == "g").simpleString()
    while len(known) < len(wanted):
        for key, (low, high, _, _) in span.items():
            if low == high:
                known[key] = low
        left = {key: s for key, s in span.items() if key not in known}
        if not left:
            break
        table = F.broadcast(spark.createDataFrame([(g, k, low, high) for (g, k), (low, high, _, _) in left.items()], f"g {kind}, k long, low double, high double"))
        near = own.join(table, "g").where("v >= low AND v <= high")
        if all(n <= LAST or _narrow(low, high) for low, high, _, n in left.values()):
            counts = near.groupBy("g", "k", "v").count()
            for r in counts.groupBy("g", "k").agg(F.sort_array(F.collect_list(F.struct("v", "count"))).alias("x")).collect():
                at = span[r["g"], r["k"]][2]
                for x in r["x"]:
                    if at + x["count"] > r["k"]:
                        known[r["g"], r["k"]] = x["v"]
                        break
                    at += x["count"]
            break
        step = F.least(F.floor((F.col("v") - F.col("low")) / (F.col("high") - F.col("low")) * STEPS), F.lit(STEPS - 1))
        found: dict[tuple, list] = {}
        for r in near.groupBy("g", "k", step.alias("s")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect():
            found.setdefault((r["g"], r["k"]), []).append((r["s"], r["low"], r["high"], r["n"]))
        for key, parts in found.items():
            at = span[key][2]
            for _, low, high, n in sorted(parts):
                if at + n > key[1]:
                    span[key] = (low, high, at, n)
                    break
                at += n
    out = {}
    for g, r in about.items():
        out[g] = []
        for q in quantiles:
            at = q * (r["n"] - 1)
            a, b = known[g, math.floor(at)], known[g, math.ceil(at)]
            out[g].append(a if a == b else (math.ceil(at) - at) * a + (at - math.floor(at)) * b)
    return out


def _narrow(low: float, high: float) -> bool:
    """Whether hardly any double lies between: values there are few, however many rows have them."""
    return high - low <= 64 * math.ulp(max(abs(low), abs(high)))
