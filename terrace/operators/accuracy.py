"""Accuracy of maps from a sample: confusion matrix, measures by class and overall, area-weighted estimates. All on tables of classes by classes."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.functions.scalars import ratio


def confusion(samples: DataFrame, ref: str = "ref_class", mapped: str = "map_class") -> DataFrame:
    """map_class, ref_class, n of pairs that occur; rows with a null class count for nothing."""
    own = samples.where(F.col(ref).isNotNull() & F.col(mapped).isNotNull())
    return own.groupBy(F.col(mapped).cast("int").alias("map_class"), F.col(ref).cast("int").alias("ref_class")).agg(F.count(F.lit(1)).alias("n"))


def confusion_table(matrix: DataFrame, labels: list[int]) -> DataFrame:
    """map_class (as text, and "total"), c_<label>... and total: map rows by reference columns."""
    wide = matrix.groupBy("map_class").pivot("ref_class", labels).agg(F.sum("n"))
    wide = wide.where(F.col("map_class").isin(labels)).select(F.col("map_class").cast("string").alias("map_class"), *[F.coalesce(F.col(str(x)), F.lit(0)).cast("long").alias(f"c_{x}") for x in labels])
    cols = [f"c_{x}" for x in labels]
    wide = wide.withColumn("total", sum((F.col(c) for c in cols), F.lit(0).cast("long")))
    return wide.unionByName(wide.agg(F.lit("total").alias("map_class"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in [*cols, "total"]]))


def _margins(matrix: DataFrame) -> DataFrame:
    """cls, n_map, n_ref, hit, n: a row for each class that occurs."""
    sides = matrix.select(F.explode(F.array(
        F.struct(F.col("map_class").alias("cls"), F.col("n").alias("m"), F.lit(0).cast("long").alias("r"), F.when(F.col("map_class") == F.col("ref_class"), F.col("n")).otherwise(0).alias("h")),
        F.struct(F.col("ref_class").alias("cls"), F.lit(0).cast("long").alias("m"), F.col("n").alias("r"), F.lit(0).cast("long").alias("h")),
    )).alias("x")).select("x.*")
    per = sides.groupBy("cls").agg(F.sum("m").alias("n_map"), F.sum("r").alias("n_ref"), F.sum("h").alias("hit"))
    return per.crossJoin(F.broadcast(matrix.agg(F.sum("n").alias("n"))))  # by one row


def class_accuracy(matrix: DataFrame) -> DataFrame:
    """By class: n_map, n_ref, user's and producer's accuracy with standard errors, specificity, F1, G-mean, Fowlkes-Mallows, commission, omission (6 places)."""
    t = _margins(matrix).withColumn("ua", ratio(F.col("hit"), F.col("n_map"))).withColumn("pa", ratio(F.col("hit"), F.col("n_ref")))
    fp, fn = F.col("n_map") - F.col("hit"), F.col("n_ref") - F.col("hit")
    tn = F.col("n") - F.col("hit") - fp - fn
    t = t.withColumn("spec", ratio(tn, tn + fp))
    se = lambda a, n: F.when(n > 1, F.sqrt(a * (1 - a) / (n - 1)))
    f1 = F.when(F.coalesce("ua", F.lit(0.0)) + F.coalesce("pa", F.lit(0.0)) > 0, 2 * F.col("ua") * F.col("pa") / (F.col("ua") + F.col("pa"))).otherwise(0.0)
    both = F.coalesce("ua", F.lit(0.0)) * F.coalesce("pa", F.lit(0.0))
    r = lambda c: F.bround(c, 6)
    return t.select(
        "cls", "n_map", "n_ref", r(F.col("ua")).alias("ua"), r(se(F.col("ua"), F.col("n_map"))).alias("ua_se"), r(F.col("pa")).alias("pa"), r(se(F.col("pa"), F.col("n_ref"))).alias("pa_se"), r(F.col("spec")).alias("specificity"),
        r(f1).alias("f1"), r(F.sqrt(F.col("pa") * F.col("spec"))).alias("g_mean"), r(F.when(F.coalesce("ua", "pa").isNotNull(), F.sqrt(both))).alias("fowlkes_mallows"), r(1 - F.col("ua")).alias("commission"), r(1 - F.col("pa")).alias("omission"),
    )


def overall_accuracy(matrix: DataFrame, confidence: float = 0.95) -> DataFrame:
    """One row: n, num_classes, oa, oa_se, oa_ci, balanced accuracy, F1 macro, weighted and micro, G-mean and Fowlkes-Mallows macro and weighted, kappa, mcc, geometric mean of recalls (6 places).

    Means are over the classes that the reference has, weights are its counts; kappa is null where it has no meaning.
    """
    z = NormalDist().inv_cdf(1 - (1 - confidence) / 2)
    t = _margins(matrix).withColumn("ua", ratio(F.col("hit"), F.col("n_map"))).withColumn("pa", ratio(F.col("hit"), F.col("n_ref")))
    spec = ratio(F.col("n") - F.col("n_map") - F.col("n_ref") + F.col("hit"), F.col("n") - F.col("n_ref"))
    gm, fm = F.sqrt(F.col("pa") * spec), F.when(F.col("n_ref") > 0, F.sqrt(F.coalesce("ua", F.lit(0.0)) * F.col("pa")))
    f1 = F.when(F.col("n_map") + F.col("n_ref") > 0, 2 * F.col("hit") / (F.col("n_map") + F.col("n_ref"))).otherwise(0.0)
    s = t.withColumns({"f1": f1, "gm": gm, "fm": fm}).agg(
        F.max("n").alias("n"), F.sum("hit").alias("c"), F.sum(F.col("n_map") * F.col("n_ref")).alias("pt"), F.sum(F.col("n_map") * F.col("n_map")).alias("pp"), F.sum(F.col("n_ref") * F.col("n_ref")).alias("tt"),
        F.avg("pa").alias("bal"), F.avg("f1").alias("f1m"), F.sum(F.col("f1") * F.col("n_ref")).alias("f1w"), F.min("pa").alias("least"), F.avg(F.when(F.col("pa") > 0, F.log("pa"))).alias("lnpa"),
        F.avg("gm").alias("gmm"), F.sum(F.col("gm") * F.col("n_ref")).alias("gmw"), F.avg("fm").alias("fmm"), F.sum(F.col("fm") * F.col("n_ref")).alias("fmw"), F.count(F.lit(1)).alias("many"),
    )
    n, oa = F.col("n").cast("double"), F.col("c") / F.col("n")
    pe = F.col("pt") / (n * n)
    se = F.when(F.col("n") > 1, F.sqrt(oa * (1 - oa) / (n - 1)))
    below = F.sqrt((n * n - F.col("pp")) * (n * n - F.col("tt")))
    r = lambda c: F.bround(c, 6)
    return s.select(
        "n", F.col("many").alias("num_classes"), r(oa).alias("oa"), r(se).alias("oa_se"), r(se * z).alias("oa_ci"), r(F.col("bal")).alias("balanced_accuracy"),
        r(F.col("f1m")).alias("f1_macro"), r(F.col("f1w") / n).alias("f1_weighted"), r(oa).alias("f1_micro"),
        r(F.col("gmm")).alias("g_mean_macro"), r(F.col("gmw") / n).alias("g_mean_weighted"), r(F.col("fmm")).alias("fowlkes_macro"), r(F.col("fmw") / n).alias("fowlkes_weighted"),
        r(F.when(pe != 1, (oa - pe) / (1 - pe))).alias("kappa"), r(F.when(below > 0, (F.col("c") * n - F.col("pt")) / below).otherwise(0.0)).alias("mcc"), r(F.when(F.col("least") > 0, F.exp("lnpa")).otherwise(0.0)).alias("g_mean_multiclass"),
    )


def _weights(matrix: DataFrame, counts: DataFrame) -> DataFrame:
    """i, j, p, v: area-weighted cells and their variances. counts: cls, n_pixels."""
    total = counts.agg(F.sum("n_pixels").alias("big"))
    w = counts.select(F.col("cls").alias("i"), F.col("n_pixels")).crossJoin(F.broadcast(total)).select("i", (F.col("n_pixels") / F.col("big")).alias("w"))  # by one row
    rows = matrix.groupBy(F.col("map_class").alias("i")).agg(F.sum("n").alias("ni"))
    cells = matrix.select(F.col("map_class").alias("i"), F.col("ref_class").alias("j"), "n").join(rows, "i").join(F.broadcast(w), "i")
    q = F.col("n") / F.col("ni")
    return cells.select("i", "j", (F.col("w") * q).alias("p"), F.when(F.col("ni") > 1, F.col("w") * F.col("w") * q * (1 - q) / (F.col("ni") - 1)).otherwise(0.0).alias("v"))


def area_weighted_overall(matrix: DataFrame, counts: DataFrame) -> DataFrame:
    """One row: oa_area and oa_area_se."""
    c = _weights(matrix, counts)
    s = c.agg(F.sum(F.when(F.col("i") == F.col("j"), F.col("p"))).alias("oa"), F.sum(F.when(F.col("i") == F.col("j"), F.col("v"))).alias("v"))
    return s.select(F.bround("oa", 6).alias("oa_area"), F.bround(F.sqrt("v"), 6).alias("oa_area_se"))


def adjusted_area(matrix: DataFrame, counts: DataFrame, pixel_m2: float, confidence: float = 0.95) -> DataFrame:
    """By class of the reference or the map: mapped pixels and weight, area-weighted producer's accuracy with error and interval, the adjusted share, and mapped and adjusted
    area in pixels, ha and km2 with errors, intervals (not below 0) and the coefficient of variation."""
    z = NormalDist().inv_cdf(1 - (1 - confidence) / 2)
    c = _weights(matrix, counts)
    per = c.groupBy("j").agg(F.sum("p").alias("pj"), F.sum(F.when(F.col("i") == F.col("j"), F.col("p")).otherwise(0.0)).alias("pjj"), F.sum("v").alias("vj"))
    per = per.withColumn("pa", ratio(F.col("pjj"), F.col("pj")))
    error = c.join(per.select("j", "pa"), "j").groupBy("j").agg(F.sum(F.col("v") * F.pow(F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0) - F.col("pa"), 2)).alias("pv"))
    big = counts.agg(F.sum("n_pixels").alias("big"))
    t = per.join(error, "j").join(counts.select(F.col("cls").alias("j"), "n_pixels"), "j", "full").crossJoin(F.broadcast(big))  # by one row
    t = t.fillna(0, ["pj", "vj", "n_pixels"])
    share, se = F.col("pj"), F.sqrt("vj")
    r = lambda c, k=4: F.bround(c, k)
    pa_se = F.when(F.col("pj") > 0, F.sqrt("pv") / F.col("pj"))
    units = []
    for name, unit in (("ha", pixel_m2 / 1e4), ("km2", pixel_m2 / 1e6)):
        whole = F.col("big") * F.lit(float(unit))
        k = 4 if name == "ha" else 6
        units += [
            r(F.col("n_pixels") * F.lit(float(unit)), k).alias(f"mapped_{name}"), r(whole * share, k).alias(f"area_{name}"), r(whole * se, k).alias(f"se_{name}"), r(whole * se * z, k).alias(f"ci_{name}"),
            r(F.greatest(F.lit(0.0), whole * share - whole * se * z), k).alias(f"low_{name}"), r(whole * share + whole * se * z, k).alias(f"high_{name}"),
        ]
    return t.select(
        F.col("j").alias("cls"), F.col("n_pixels").alias("mapped_pixels"), r(F.col("n_pixels") / F.col("big"), 6).alias("map_weight"), r(F.col("pa"), 6).alias("pa_area"), r(pa_se, 6).alias("pa_area_se"), r(pa_se * z, 6).alias("pa_area_ci"),
        r(share, 6).alias("share"), r(se, 6).alias("share_se"), r(F.col("big") * share).alias("pixels"), r(F.col("big") * se).alias("pixels_se"), r(F.col("big") * se * z).alias("pixels_ci"), *units, r(F.when(share > 0, se / share), 6).alias("cv"),
    )


def overall_log_loss(samples: DataFrame, prob: str, floor: float = 1e-3) -> DataFrame:
    """One row: n, log_loss: the mean of -ln(p) of the true class's probability, held above floor."""
    own = samples.where(F.col(prob).isNotNull())
    return own.agg(F.count(F.lit(1)).alias("n"), F.bround(F.avg(-F.log(F.greatest(F.col(prob), F.lit(floor)))), 6).alias("log_loss"))


def log_loss(samples: DataFrame, prob: str, label: str, eps: float = 1e-7) -> DataFrame:
    """label, n, log_loss: the mean of -ln(p + eps) of the true class's probability, by class."""
    return samples.where(F.col(prob).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.bround(F.avg(-F.log(F.col(prob) + eps)), 6).alias("log_loss"))
