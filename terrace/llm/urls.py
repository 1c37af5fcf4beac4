"""URL filter: rules first, then a tree of path templates with smoothed labelled purity.

A url is a host and path segments. Level by level, for each node of a host's tree, a segment stays a branch of its own if it
is frequent there or has enough labelled pages, whatever its form; all others fall into a wildcard of their form (digits, hex, mixed, words).
A path that ends is a branch of its own. Branches of a node whose shares of bad labels don't differ significantly are merged: in
order of their rates a branch joins the run before it, unless it differs from all that the run holds so far. Nodes carry
counts of labelled pages, good and bad; a node's purity is its share of bad pages, smoothed towards that of its parent (host,
then all hosts). A node with few pages is a leaf: no branch of it could have support. The tree is as deep as the paths are.
A page is rejected if the purity of its deepest node is at least a threshold. Labels are what the rules say, or a given table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrace.scratch import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# The rules of the contract (host, path, whether it allows).
RULES = (("org", "/", True), ("example.org", "/es/", False), ("example.org", "/en/1", False), ("com", "/fr/", True), ("com", "/de/", False))

#: A segment stays a branch if it has this share of its node's pages and so many of them, or so many labelled pages, however large the node is.
SHARE, SUPPORT = 0.02, 20
#: Names that the text of merged branches has; of more it has the first and how many there are.
NAMES = 64
#: Two branches merge if the z statistic of their shares of bad labels is below this; pages that a parent's purity counts for.
MERGE_Z, PRIOR = 1.96, 4.0
REJECT = 0.5


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str, bool], ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and whether it allows; null if none fits. Of equally long ones the first by text."""
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
    name, allow = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    for h, p, ok in reversed(ordered):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        name, allow = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(ok)).otherwise(allow)
    return name, allow


def _kind(segment: Column) -> Column:
    """The wildcard of a segment, by its form."""
    return (
        F.when(segment.rlike(r"^[0-9]+(\.[A-Za-z]+)?$"), "{n}").when(segment.rlike(r"^[0-9a-fA-F-]{8,}$"), "{hex}")
        .when(segment.rlike("[0-9]"), "{mixed}").otherwise("{*}")
    )


def merge_runs(bad: np.ndarray, labelled: np.ndarray, many: np.ndarray, above: float) -> np.ndarray:
    """For branches with these counts (many of each), in the order of their rates, the number of the run that each is merged into."""
    rate = (bad + PRIOR * above) / (labelled + PRIOR)
    run = np.zeros(len(bad), np.int64)
    now = held_bad = held_labelled = 0
    for k in range(len(bad)):
        if k:
            own = (held_bad + PRIOR * above) / (held_labelled + PRIOR)
            spread = max(rate[k] * (1 - rate[k]), 0.01) / (labelled[k] + PRIOR) + max(own * (1 - own), 0.01) / (held_labelled + PRIOR)
            if abs(rate[k] - own) >= MERGE_Z * spread**0.5:
                now, held_bad, held_labelled = now + 1, 0, 0
        held_bad, held_labelled = held_bad + many[k] * bad[k], held_labelled + many[k] * labelled[k]
        run[k] = now
    return run


def _runs(pdf: pd.DataFrame) -> pd.DataFrame:
    """One node's pairs of counts: those that differ are fewer than the power two thirds of its labelled pages."""
    above = float(pdf["above"].iloc[0])
    rate = (pdf["bad"] + PRIOR * above) / (pdf["labelled"] + PRIOR)
    pdf = pdf.assign(rate=rate).sort_values(["rate", "labelled", "bad"], ignore_index=True)
    return pdf[["node", "labelled", "bad"]].assign(run=merge_runs(pdf["bad"].to_numpy(), pdf["labelled"].to_numpy(), pdf["many"].to_numpy(), above))


def template_tree(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """pages (key columns, host, path, bad: null if not labelled) with node and purity; and the nodes: node (an id), parent, template, pages, labelled, bad, purity.

    Templates are text: the host and its branches, "{n}", "{hex}", "{mixed}", "{*}" for wildcards, "{a|b}" for merged branches and
    "$" for a path that ends; "{", "}", "|", "$" and "\\" of a segment have a "\\" before them. A node's id is a digest of its way from the host.
    """
    each = pages.withColumn("_seg", F.array_remove(F.split("path", "/"), ""))
    paths = each.groupBy("host", "_seg").agg(*_counts())
    paths = materialize(paths, "paths")
    nodes = paths.groupBy("host").agg(*_sums())
    total = nodes.agg(F.sum("bad"), F.sum("labelled")).first()
    base = ((total[0] or 0) + 1) / ((total[1] or 0) + 2)
    purity = lambda above: (F.col("bad") + PRIOR * above) / (F.col("labelled") + PRIOR)
    root = nodes.select(F.md5("host").alias("node"), F.lit(None).cast("string").alias("parent"), F.col("host").alias("template"), "host", "pages", "labelled", "bad", purity(F.lit(base)).alias("purity"))
    levels = [materialize(root, "nodes-0")]
    at = paths.join(levels[0].select("host", "node", F.col("pages").alias("_all"), F.col("purity").alias("above")), "host")
    at, done, k = at.withColumn("_open", F.col("_all") >= SUPPORT), [], 0
    while True:
        done.append(at.where("NOT _open").select("host", "_seg", "node", F.col("above").alias("purity")))
        now = at.where("_open")
        text = F.regexp_replace(F.get("_seg", F.lit(k)), r"([{}|$\\])", r"\\$1")
        here = now.withColumn("_s", F.coalesce(text, F.lit("$")))
        by = here.groupBy("node", "_s").agg(*_sums(), F.first("_all").alias("_all"), F.first("above").alias("above"))
        enough = (F.col("pages") >= F.greatest(F.lit(SUPPORT), F.col("_all") * SHARE)) | (F.col("labelled") >= SUPPORT)
        own = (F.col("_s") == "$") | enough
        by = materialize(by.withColumn("branch", F.when(own, F.col("_s")).otherwise(_kind(F.col("_s")))), f"segments-{k}")
        if by.isEmpty():
            break
        branch = by.groupBy("node", "branch", "above").agg(*_sums())
        counted = branch.groupBy("node", "labelled", "bad", "above").agg(F.count(F.lit(1)).alias("many"))
        runs = counted.groupBy("node").applyInPandas(_runs, "node string, labelled long, bad long, run long")
        branch = materialize(branch.join(runs, ["node", "labelled", "bad"]), f"branches-{k}")
        first = Window.partitionBy("node", "run").orderBy("branch")
        few = branch.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= NAMES).groupBy("node", "run").agg(F.sort_array(F.collect_list("branch")).alias("_names"))
        merged = branch.groupBy("node", "run", "above").agg(*_sums(), F.count(F.lit(1)).alias("_many")).join(few, ["node", "run"])
        more = F.when(F.col("_many") > NAMES, F.concat(F.lit("|+"), (F.col("_many") - NAMES).cast("string"))).otherwise("")
        name = F.when(F.col("_many") > 1, F.concat(F.lit("{"), F.array_join("_names", "|"), more, F.lit("}"))).otherwise(F.col("_names")[0])
        child = F.md5(F.concat_ws("/", "node", F.col("run").cast("string")))
        merged = merged.select(child.alias("node"), F.col("node").alias("parent"), "run", name.alias("_name"), "pages", "labelled", "bad", purity(F.col("above")).alias("purity"))
        merged = merged.join(levels[-1].select(F.col("node").alias("parent"), F.col("template").alias("_up")), "parent")
        merged = merged.select("node", "parent", "run", F.concat_ws("/", "_up", "_name").alias("template"), "pages", "labelled", "bad", "purity")
        levels.append(materialize(merged, f"nodes-{k + 1}"))
        into = branch.select("node", "branch", "run").join(levels[-1].select(F.col("parent").alias("node"), "run", F.col("node").alias("_child"), F.col("pages").alias("_many"), F.col("purity").alias("_below")), ["node", "run"])
        into = by.select("node", "_s", "branch").join(into, ["node", "branch"]).select("node", "_s", "_child", "_many", "_below")
        k += 1
        at = here.join(into, ["node", "_s"]).select("host", "_seg", "pages", "labelled", "bad", F.col("_child").alias("node"), F.col("_many").alias("_all"), F.col("_below").alias("above"), ((F.size("_seg") >= k) & (F.col("_many") >= SUPPORT)).alias("_open"))
        at = materialize(at, f"paths-{k}")
    placed = done[0]
    for x in done[1:]:
        placed = placed.unionByName(x)
    tree = levels[0].drop("host")
    for x in levels[1:]:
        tree = tree.unionByName(x.drop("run"))
    return each.join(placed, ["host", "_seg"]).drop("_seg"), tree


def _counts() -> list[Column]:
    return [F.count(F.lit(1)).alias("pages"), F.count("bad").alias("labelled"), F.coalesce(F.sum(F.col("bad").cast("long")), F.lit(0)).alias("bad")]


def _sums() -> list[Column]:
    return [F.sum(c).alias(c) for c in ("pages", "labelled", "bad")]


def filter_urls(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", rules: tuple = RULES, labels: DataFrame | None = None, reject: float = REJECT) -> DataFrame:
    """A row for each row of pages: id, host, path, rule, verdict (allow or block), template, purity.

    labels: id and bad (boolean), instead of what the rules say. Null urls, and those without "://", have empty host and
    path and are judged as pages of the host "". Repeated rows each get a row; an empty table gives an empty one; other
    columns are not read.
    """
    url = F.col(url_col)
    slim = pages.select(F.col(id_col).alias("_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rule, allow = rule_of(F.col("host"), F.col("path"), rules)
    slim = slim.withColumn("rule", rule).withColumn("_allow", allow)
    if labels is None:
        slim = slim.withColumn("bad", ~F.col("_allow"))
    else:
        slim = slim.join(labels.groupBy(F.col(id_col).alias("_id")).agg(F.max("bad").alias("bad")), "_id", "left")
    placed, tree = template_tree(slim)
    placed = placed.join(tree.select("node", "template"), "node")
    verdict = F.when(F.coalesce("_allow", F.col("purity") < reject), "allow").otherwise("block")
    return placed.select(F.col("_id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "template", "purity")
