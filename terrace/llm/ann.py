"""Approximate nearest neighbours by inner product over balanced posting lists.

Vectors get one more component, so that the largest inner product is the smallest Euclidean distance. Equal vectors are one
class, which keeps its smallest ids (as many as a result can need, so nothing is lost). Centroids come from balanced k-means on a bounded sample
(eight vectors a centroid), in two levels if they are many; they and a graph over them are of bounded size and go to every task. A vector joins the list of its nearest centroid and, near a
boundary, further ones; lists that are too large are dealt out in blocks. A query walks the graph for its nearest
centroids and takes the lists whose distance is within a ratio of the nearest. Lists are read against their queries in
blocks, in double precision, and so are a list's queries; of each block only the nearest leave. Then each query reads every further list that can hold
a vector as near as the last one it found (a list's vectors are at most its radius from its centroid), so results are those of
a full search: lists far away cost nothing if vectors are in clusters, and all lists are read if they are not. With a recall
below 1 asked for, a query instead reads so many of its nearest lists that a sample of queries, searched in full, would find that share.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrace.scratch import materialize


@dataclass(frozen=True)
class Plan:
    """Documented bounds and ratios of the index."""

    sample: int = 131_072  # vectors that the centroids are fitted on, at most; 20,000 or eight a centroid if that is less
    list_size: int = 400  # wanted vectors of a list; sets the number of centroids
    max_lists: int = 16_384  # centroids, and so the size of what every task holds
    copies: int = 3  # lists that a vector may be in
    near: float = 1.12  # ratio of distances within which a vector is copied to another list
    probe: int = 48  # lists that a query may read before it knows how near its hits are
    prune: float = 1.7  # ratio of distances within which a query reads a list
    degree: int = 24  # neighbours of a centroid in the graph
    beam: int = 96  # centroids that a walk over the graph keeps
    block: int = 4_000  # vectors of a list that one task reads at once, and queries of a list
    unit: int = 32_000  # vectors of several lists that one task reads at once, and queries, when further lists are read
    sample_bytes: int = 256 << 20  # of the vectors that the centroids are fitted on, at most
    recall: float | None = None  # None: exact; else the share of the nearest that the lists read are to hold, by a sample of queries
    calibration: int = 256  # queries of that sample


@dataclass
class Centroids:
    points: np.ndarray  # with the added component
    graph: np.ndarray
    entries: np.ndarray
    beam: int

    def nearest(self, x: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray]:
        """Centroids and distances for each row of x, nearest first, by a beam search over the graph from fixed entries."""
        outs = [self._search(x[k : k + 256], many) for k in range(0, len(x), 256)]
        return np.concatenate([a for a, _ in outs]), np.concatenate([b for _, b in outs])

    def _search(self, x: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray]:
        n, count = len(x), len(self.points)
        beam = min(count, max(self.beam, many))
        row = np.arange(n)[:, None]
        norm = (self.points**2).sum(1)
        own = (x**2).sum(1)[:, None]
        best = np.broadcast_to(self.entries, (n, len(self.entries)))
        dist = norm[best] - 2 * np.einsum("nd,nkd->nk", x, self.points[best]) + own
        seen = np.zeros((n, count), bool)
        opened = np.zeros((n, count), bool)
        seen[row, best] = True
        while True:
            order = np.argsort(dist, 1)[:, :beam]
            best, dist = np.take_along_axis(best, order, 1), np.take_along_axis(dist, order, 1)
            fresh = ~opened[row, best]
            if not fresh.any():
                break
            # Each row opens its nearest unopened centroids, some at a time.
            pick = np.argsort(~fresh, 1, kind="stable")[:, : min(8, best.shape[1])]
            live = np.take_along_axis(fresh, pick, 1)
            node = np.take_along_axis(best, pick, 1)
            opened[row, node] |= live
            cand = self.graph[node].reshape(n, -1)
            new = ~seen[row, cand] & np.repeat(live, self.graph.shape[1], 1)
            first = np.zeros_like(new)
            at = np.argsort(cand, 1, kind="stable")
            sorted_new = np.take_along_axis(cand, at, 1)
            lead = np.ones_like(new)
            lead[:, 1:] = sorted_new[:, 1:] != sorted_new[:, :-1]
            np.put_along_axis(first, at, lead, 1)
            new &= first
            seen[row, cand] |= np.repeat(live, self.graph.shape[1], 1)
            d = np.where(new, norm[cand] - 2 * np.einsum("nd,nkd->nk", x, self.points[cand]) + own, np.inf)
            best, dist = np.concatenate([best, cand], 1), np.concatenate([dist, d], 1)
        return best[:, :many], np.sqrt(np.maximum(dist[:, :many], 0))


def balanced_kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 3, flat: int = 256) -> np.ndarray:
    """About k centroids; a centroid's distance grows with the number of points that it held in the round before. More than `flat`
    are found in two levels: those of each of about sqrt(k) parts, as many as its share of the points."""
    if k > flat:
        top = balanced_kmeans(x, math.isqrt(k), rounds, seed, k)
        own = _own(x, top, np.zeros(len(top)))
        parts = [x[own == j] for j in range(len(top)) if (own == j).any()]
        return np.concatenate([balanced_kmeans(p, max(1, round(k * len(p) / len(x))), rounds, seed, k) for p in parts])
    rng = np.random.default_rng(seed)
    k = max(1, min(k, len(x)))
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    weight = np.zeros(k)
    for _ in range(rounds):
        own = _own(x, centres, weight)
        size = np.bincount(own, minlength=k)
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        centres = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], x[rng.choice(len(x), k)])
        spread = ((x - centres[own]) ** 2).sum(1).mean()
        weight = 0.5 * weight + 0.5 * spread * np.clip(size / (len(x) / k) - 1, -1, 4) * 0.2
    return centres


def _own(x: np.ndarray, centres: np.ndarray, weight: np.ndarray) -> np.ndarray:
    return np.concatenate([np.argmin(((centres**2).sum(1) - 2 * x[i : i + 2048] @ centres.T) + weight, 1) for i in range(0, len(x), 2048)])


def centroid_graph(points: np.ndarray, degree: int, beam: int, seed: int = 5) -> Centroids:
    """Each centroid's nearest ones, both ways, and some at random so that the graph hangs together."""
    k = len(points)
    rng = np.random.default_rng(seed)
    degree = min(degree, max(1, k - 1))
    near = np.zeros((k, degree), int)
    for i in range(0, k, 1024):
        d = (points**2).sum(1) - 2 * points[i : i + 1024] @ points.T
        d[np.arange(len(d)), np.arange(i, i + len(d))] = np.inf
        near[i : i + 1024] = np.argpartition(d, min(degree, k - 1), 1)[:, :degree]
    back = [[] for _ in range(k)]
    for a, row in enumerate(near):
        for b in row:
            if len(back[b]) < degree // 2:
                back[b].append(a)
    more = np.array([(b + list(rng.integers(0, k, degree // 2 + 2)))[: degree // 2 + 2] for b in back])
    return Centroids(points, np.concatenate([near, more], 1), rng.choice(k, min(k, 32), replace=False), beam)


def search(
    vectors: DataFrame, is_query, *, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", plan: Plan = Plan(),
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row of which is_query holds, the k nearest other rows that are found.

    Score: the inner product in double precision; ties to smaller ids. Vectors null, empty, zero, or with null or non-finite
    components take no part, nor do null ids, nor vectors of another length than most have. Rows repeated with one id and
    vector are one; an id with several vectors is searched and found by each. A query with fewer others gets them all. Vectors of any
    finite size are compared rightly (a score beyond the doubles is infinite); an empty table gives an empty one; other columns are not read.
    """
    v, i = F.col(vector_col), F.col(id_col).cast("long")
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    ok = v.isNotNull() & (F.size(v) > 0) & F.forall(v, finite) & F.exists(v, lambda c: c != 0)
    rows = vectors.where(ok & i.isNotNull()).select(i.alias("id"), v.cast("array<double>").alias("x"), is_query.alias("is_query"))
    largest = F.array_max(F.transform("x", lambda c: F.abs(c)))
    lengths = rows.groupBy(F.size("x").alias("n")).agg(F.count(F.lit(1)).alias("count"), F.max(largest).alias("largest")).orderBy(F.desc("count"), "n").first()
    spark = vectors.sparkSession
    if lengths is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = lengths["n"]
    # Very large or small components are taken times a power of two, so that their squares are doubles; scores are put right at the end.
    power = 0 if 1e-100 < lengths["largest"] < 1e100 else -math.frexp(lengths["largest"])[1]
    if power:
        rows = rows.withColumn("x", F.transform("x", lambda c: c * F.lit(2.0 ** (power // 2)) * F.lit(2.0 ** (power - power // 2))))
    rows = rows.where(F.size("x") == dim).withColumn("key", F.sha2(F.concat_ws(",", F.transform("x", lambda c: (c + F.lit(0.0)).cast("string"))), 256))

    # Classes of equal vectors: the smallest k + 1 ids of each, found in slices first.
    slim = materialize(rows.select("id", "key", "is_query").distinct(), "ids")
    slices = Window.partitionBy("key", "slice").orderBy("id")
    few = slim.withColumn("slice", F.pmod(F.xxhash64("id"), F.lit(32))).withColumn("n", F.row_number().over(slices)).where(F.col("n") <= k + 1)
    few = few.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("id"))).where(F.col("n") <= k + 1).select("key", "id")
    members = materialize(few, "members")
    leaders = members.groupBy("key").agg(F.min("id").alias("cls"))
    asked = slim.where("is_query").select("key").distinct().withColumn("asked", F.lit(True))
    classes = rows.join(leaders, "key").where("id = cls").dropDuplicates(["key"]).join(asked, "key", "left")
    classes = materialize(classes.select("cls", "key", "x", F.coalesce("asked", F.lit(False)).alias("asked"), F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, c: a + c * c)).alias("norm")), "classes")
    count, top, askers = classes.agg(F.count(F.lit(1)), F.max("norm"), F.count_if("asked")).first()

    wanted = min(plan.max_lists, max(1, math.ceil(count / plan.list_size)))
    sample = classes.orderBy(F.xxhash64("key"), "key").limit(max(1, min(plan.sample, max(20_000, 8 * wanted), plan.sample_bytes // (8 * dim)))).select("x").toPandas()
    base = _lift(np.array(sample["x"].tolist()), top, False)
    points = balanced_kmeans(base, min(wanted, max(1, len(base) // 8)))
    lists = len(points)
    shared = spark.sparkContext.broadcast(centroid_graph(points, plan.degree, plan.beam))

    def post(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                c, d = shared.value.nearest(_lift(np.array(b["x"].tolist()), top, False), min(plan.copies, lists))
                keep = d <= np.maximum(d[:, :1] * plan.near, 1e-12)
                r, j = np.nonzero(keep)
                yield pd.DataFrame({"list": c[r, j], "cls": b["cls"].to_numpy()[r], "key": b["key"].to_numpy()[r], "x": b["x"].to_numpy()[r], "home": j == 0, "away": d[r, j]})

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                c, d = shared.value.nearest(_lift(np.array(b["x"].tolist()), top, True), min(plan.probe, lists))
                r, j = np.nonzero(d <= np.maximum(d[:, :1] * plan.prune, 1e-12))
                yield pd.DataFrame({"list": c[r, j], "asking": b["key"].to_numpy()[r], "x": b["x"].to_numpy()[r]})

    posted = materialize(classes.select("cls", "key", "x").mapInPandas(post, "list long, cls long, key string, x array<double>, home boolean, away double"), "postings")
    sizes = posted.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / plan.block).cast("int").alias("blocks"))  # a row for each centroid
    blocks = posted.drop("home", "away").join(F.broadcast(sizes), "list").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")).drop("blocks")
    queries = materialize(classes.where("asked").select("key", "x").mapInPandas(ask, "list long, asking string, x array<double>"), "queries")
    turns = F.broadcast(queries.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / plan.block).cast("int").alias("turns")))  # a row for each centroid
    queries = queries.join(F.broadcast(sizes), "list").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    queries = queries.join(turns, "list").withColumn("turn", F.pmod(F.xxhash64("asking"), F.col("turns")).cast("int")).drop("turns")
    blocks = blocks.join(turns, "list").withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1))).drop("turns")

    def read(own: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(asking):
            return pd.DataFrame({"asking": pd.Series([], dtype=object), "cls": pd.Series([], dtype="int64"), "key": pd.Series([], dtype=object), "score": pd.Series([], dtype=float)})
        x = np.array(own["x"].tolist())
        cls, key, who = own["cls"].to_numpy(), own["key"].to_numpy(), asking["asking"].to_numpy()
        out = []
        for a in range(0, len(asking), 512):
            q = np.array(asking["x"].iloc[a : a + 512].tolist())
            s = q @ x.T
            r = np.repeat(np.arange(len(s)), len(x))
            c = np.tile(np.arange(len(x)), len(s))
            if len(x) > k + 1:
                edge = -np.partition(-s, k, 1)[:, k]
                r, c = np.nonzero(s >= (edge - 1e-9 * top * np.sqrt((q**2).sum(1)))[:, None])
            exact = (q[r] * x[c]).sum(1)  # in one order, whatever the block was
            order = np.lexsort((cls[c], -exact, r))
            r, c, exact = r[order], c[order], exact[order]
            near = np.arange(len(r)) - np.searchsorted(r, r) <= k
            out.append(pd.DataFrame({"asking": who[a + r[near]], "cls": cls[c[near]], "key": key[c[near]], "score": exact[near]}))
        return pd.concat(out)

    found = blocks.groupBy("list", "block", "turn").cogroup(queries.groupBy("list", "block", "turn")).applyInPandas(read, "asking string, cls long, key string, score double")
    best = Window.partitionBy("asking").orderBy(F.desc("score"), "cls")
    few = lambda df: df.groupBy("asking", "cls", "key").agg(F.max("score").alias("score")).withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1)
    first = materialize(few(found), "hits-first")

    # Every further list whose nearest possible vector is as near as a query's last hit; all lists for queries that have too few hits.
    radius = np.full(lists, -np.inf)
    for r in posted.where("home").groupBy("list").agg(F.max("away").alias("away")).collect():  # a row for each centroid
        radius[r["list"]] = r["away"]
    reach = spark.sparkContext.broadcast(radius)
    units, parts = min(lists, max(16, math.ceil(count / plan.unit))), max(1, math.ceil(askers / plan.unit))

    many = lists if plan.recall is None else lists_needed(classes, posted, points, top, k, plan)

    def ask_on(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        points = shared.value.points
        for whole in batches:
            for a in range(0, len(whole), 256):
                b = whole.iloc[a : a + 256]
                q = _lift(np.array(b["x"].tolist()), top, True)
                own = (q**2).sum(1)
                d = np.sqrt(np.maximum((points**2).sum(1) - 2 * q @ points.T + own[:, None], 0))
                if plan.recall is None:
                    last = np.sqrt(np.maximum(top**2 + own - 2 * b["least"].to_numpy(), 0))
                    want = d - reach.value <= (last + 1e-6 * (top + np.sqrt(own)))[:, None]
                else:  # queries that have too few hits read all
                    want = (d <= np.partition(d, many - 1, axis=1)[:, many - 1 : many]) | np.isneginf(b["least"].to_numpy())[:, None]
                out = [(u, np.nonzero(w)[0] * units + u, k) for u in range(units) for k, w in enumerate(want[:, u::units]) if w.any()]
                at = [k for _, _, k in out]
                yield pd.DataFrame({"unit": [u for u, _, _ in out], "lists": [w for _, w, _ in out], "asking": b["asking"].to_numpy()[at], "x": b["x"].to_numpy()[at], "least": b["least"].to_numpy()[at]})

    def read_on(own: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"asking": pd.Series([], dtype=object), "cls": pd.Series([], dtype="int64"), "key": pd.Series([], dtype=object), "score": pd.Series([], dtype=float)})]
        if not len(own) or not len(asking):
            return out[0]
        asking = asking.assign(_first=[w[0] for w in asking["lists"]]).sort_values(["_first", "asking"])
        everything, lists_of, all_cls, all_key = np.array(own["x"].tolist()), own["list"].to_numpy(), own["cls"].to_numpy(), own["key"].to_numpy()
        for a in range(0, len(asking), 128):
            b = asking.iloc[a : a + 128]
            use = np.nonzero(np.isin(lists_of, np.unique(np.concatenate(b["lists"].tolist()))))[0]
            if not len(use):
                continue
            x, cls, key = everything[use], all_cls[use], all_key[use]
            q, who, least = np.array(b["x"].tolist()), b["asking"].to_numpy(), b["least"].to_numpy()
            s = q @ x.T
            edge = least.copy()
            short = np.isneginf(least)
            if short.any() and len(x) > k + 1:
                edge[short] = -np.partition(-s[short], k, 1)[:, k]
            r, c = np.nonzero(s >= (edge - 1e-9 * top * np.sqrt((q**2).sum(1)))[:, None])
            exact = (q[r] * x[c]).sum(1)  # as above
            order = np.lexsort((cls[c], -exact, r))
            r, c, exact = r[order], c[order], exact[order]
            near = np.arange(len(r)) - np.searchsorted(r, r) <= k
            out.append(pd.DataFrame({"asking": who[r[near]], "cls": cls[c[near]], "key": key[c[near]], "score": exact[near]}))
        return pd.concat(out[1:] or out)

    known = first.where(F.col("n") == k + 1).select("asking", F.col("score").alias("least"))
    on = classes.where("asked").select(F.col("key").alias("asking"), "x").join(known, "asking", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))
    home = posted.where("home").select("list", "cls", "key", "x", (F.col("list") % units).alias("unit"))
    large = F.broadcast(home.groupBy("unit").agg(F.ceil(F.count(F.lit(1)) / (2 * plan.unit)).cast("int").alias("blocks")))  # a row for each unit
    home = home.join(large, "unit").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).drop("blocks")
    on = on.mapInPandas(ask_on, "unit long, lists array<long>, asking string, x array<double>, least double").join(large, "unit")
    on = on.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("part", F.pmod(F.xxhash64("asking"), F.lit(parts)).cast("int")).drop("blocks")
    deal = ["unit", "block", "part"]
    more = home.groupBy(*deal).cogroup(on.groupBy(*deal)).applyInPandas(read_on, "asking string, cls long, key string, score double")
    hits = materialize(few(first.drop("n").unionByName(more)).drop("n"), "hits")
    each = slim.where("is_query").select(F.col("id").alias("query_id"), F.col("key").alias("asking")).join(hits, "asking").join(members, "key").where("id <> query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.col("vec_id"))
    ranked = each.select("query_id", F.col("id").alias("vec_id"), "score").groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(order))
    back = F.col("score")
    for part in (-power // 2, -power // 2, -power - -power // 2, -power - -power // 2) if power else ():  # the square of 2 ** -power, in parts that are doubles
        back = back * F.lit(2.0**part)
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", back.alias("score"))


def lists_needed(classes: DataFrame, posted: DataFrame, points: np.ndarray, top: float, k: int, plan: Plan) -> int:
    """How many of a query's nearest lists hold the share plan.recall of its k nearest vectors, by a sample of queries that is held against all vectors."""
    some = classes.where("asked").orderBy(F.xxhash64("key"), "key").limit(plan.calibration).select("key", "x").toPandas()
    if not len(some):
        return 1
    q, names = np.array(some["x"].tolist()), some["key"].to_numpy()
    shared = classes.sparkSession.sparkContext.broadcast((q, names))

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q, names = shared.value
        for b in batches:
            if not len(b):
                continue
            x, key = np.array(b["x"].tolist()), b["key"].to_numpy()
            s = q @ x.T
            own = np.argpartition(-s, min(k, len(x) - 1), axis=1)[:, : k + 1]  # itself is among them
            r = np.repeat(np.arange(len(q)), own.shape[1])
            yield pd.DataFrame({"asking": names[r], "key": key[own.ravel()], "score": s[r, own.ravel()]})

    found = classes.select("key", "x").mapInPandas(nearest, "asking string, key string, score double").where("asking <> key")
    best = Window.partitionBy("asking").orderBy(F.desc("score"), "key")
    true = found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k).select("asking", "key")
    home = true.join(posted.where("home").select("key", "list"), "key").select("asking", "list").toPandas()  # k rows a query of the sample at most
    lifted = _lift(q, top, True)
    d = (points**2).sum(1) - 2 * lifted @ points.T
    place = np.empty(d.shape, np.int64)
    np.put_along_axis(place, np.argsort(d, axis=1, kind="stable"), np.broadcast_to(np.arange(len(points)), d.shape), axis=1)
    row = {name: i for i, name in enumerate(names)}
    ranks = np.sort(place[[row[a] for a in home["asking"]], home["list"].to_numpy()])
    return int(ranks[max(0, math.ceil(plan.recall * len(ranks)) - 1)]) + 1 if len(ranks) else 1


def _lift(x: np.ndarray, top: float, query: bool) -> np.ndarray:
    """x with the component that makes inner products distances: what is lacking to the longest norm; none for queries."""
    more = np.zeros(len(x)) if query else np.sqrt(np.maximum(top**2 - (x**2).sum(1), 0))
    return np.concatenate([x, more[:, None]], 1)
