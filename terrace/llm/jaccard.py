"""Exact join of documents by the Jaccard similarity of their sets of word shingles, and the groups that the links make.

Equal sets are one class from the start. Then, on distinct sets only:

1. First regions. Most documents are at distance 1 from almost all others, so no document serves as a pivot for all of them (the
   window of twice the distance bound would put every document into every region). The first pivots are therefore
   hash ranges of all shingles: sets of like size are cut by them into parts, more parts than linked sets can differ in, so
   that linked sets agree in whole parts. Sets that agree in a part meet, but for the most frequent ones of each, of which a link
   has others too; what meets is gathered to families. Families that are too large lose what can't link there and are gathered again.
2. Voronoi regions. Within every family some documents are pivots (one for each LEAF documents, PIVOTS at most); a document goes to the
   region of its nearest pivot and, by the triangle inequality, to every region whose pivot is at most twice the bound farther. Regions
   are split again until they are small, by what their documents hold and by how many they are. A pivot's distances are exact, so a
   document within the bound of its nearest pivot is linked with it there and then.
3. Where windows put nearly a whole region into one, its documents are near each other: those linked with the pivot that has
   most are one group already, and needn't be compared among themselves. They are dealt in blocks, which the other documents
   (blocks of them, if they are many) visit; the others alone are the region that goes on.
4. In a small region, distances to a few pivots rule out pairs (the triangle inequality again); what is left is counted exactly. Pairs
   that are connected already needn't be counted. Of a region only links that connect something leave: fewer than its documents.

No step limits candidates or partners.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrace.operators.graph import components
from terrace.scratch import drop_path, materialize, new_path, write_to

#: Shingles of a region that one task joins (a document counts as so many at least, since pairs of documents are work too); documents
#: chosen as pivots to split one, at most, and documents for each of them.
REGION_SHINGLES, LEAST_SHINGLES, PIVOTS, LEAF = 1_000_000, 100, 16, 8
#: Shingles of a large region whose distances to its pivots one task takes.
SLICE_SHINGLES = 100_000
#: Rows (of some 16 bytes) that are broadcast at most.
BROADCAST_ROWS = 500_000
#: Shares of all parts that are shuffled one after the other.
SHARES = 4
#: Sizes of sets that share a division into parts differ by this ratio at most.
RATIO = 1.25

_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """For each text the sorted 64-bit hashes of its distinct shingles, A-Z lower-cased, words between ASCII white space."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    code = pc.dictionary_encode(parts.flatten())
    names = code.dictionary.to_pylist()
    word = np.fromiter(map(xxhash.xxh3_64_intdigest, names), np.uint64, len(names))
    blank = np.fromiter((not w for w in names), bool, len(names))
    del names
    at = code.indices.to_numpy()
    keep = ~blank[at] if len(at) else np.zeros(0, bool)
    offsets = parts.offsets.to_numpy() - parts.offsets[0].as_py()
    offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
    h = word[at[keep]]
    rolled = np.zeros(max(0, len(h) - width + 1), np.uint64)
    for j in range(width):
        rolled = _mix(rolled * _MIX + h[j : j + len(rolled)])
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        if b - a >= width:
            yield np.unique(rolled[a : b - width + 1])
        elif b > a:
            short = np.zeros(1, np.uint64)
            for x in h[a:b]:
                short = _mix(short * _MIX + x)
            yield _mix(short + np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)


class Parts:
    """Into how many parts sets of a size are cut, for a least similarity."""

    def __init__(self, similarity: Fraction) -> None:
        self.p, self.q = similarity.numerator, similarity.denominator
        self.tops = [1]  # the largest size of each category

    def groups(self, size: int) -> list[tuple[int, int, int]]:
        """(group, parts, differing at most) for each group of sizes in which a set of this size may have a partner."""
        while self.tops[-1] < size:
            self.tops.append(max(self.tops[-1] + 1, int(self.tops[-1] * RATIO)))
        own = int(np.searchsorted(self.tops, size))
        out = []
        while own >= 0 and size * self.p <= self.tops[own] * self.q:
            differ = self.tops[own] * (self.q - self.p) // self.p
            parts = differ + 2
            for _ in range(4):  # so many more that empty parts seldom count
                parts = differ + 2 + int(1.5 * parts * np.exp(-0.85 * self.tops[own] / parts))
            out.append((own, 1 if not differ else parts, differ))
            own -= 1
        return out

    def signatures(self, own: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
        """Of a set, for each group: (group, how many of its signatures a linked set of the group shares at least, a hash for each part).

        Parts that are empty are left out if at least one that isn't is sure to be shared.
        """
        out = []
        mixed = _mix(own + _MIX)
        for group, parts, differ in self.groups(len(own)):
            part = (own % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            full, first = np.unique(part[order], return_index=True)
            sums = np.add.reduceat(mixed[order], first)
            salt = np.uint64((group * 1_000_003 + 17) * int(_MIX) % 2**64)
            hashes, need = _mix(sums + _mix(full.astype(np.uint64) + salt)), len(full) - differ
            if need < 1:
                none = np.setdiff1d(np.arange(parts), full).astype(np.uint64)
                hashes, need = np.concatenate([hashes, _mix(_mix(none + salt))]), 1
            out.append((group, need, hashes))
        return out


def _slices(batch: pa.RecordBatch, column: int, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy())
    cuts = np.unique(np.searchsorted(upto, np.arange(0, (upto[-1] if len(upto) else 0) + size, size), "right").clip(0, len(upto)))
    for a, b in zip([0, *cuts], [*cuts, len(upto)], strict=True):
        if a < b:
            yield batch.slice(a, b - a)


def sketch(docs: DataFrame, width: int, similarity: Fraction, id_col: str, text_col: str) -> DataFrame:
    """doc, n (size of the set), hi, lo (a digest of the set), groups (signatures)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = Parts(similarity)
        for whole in batches:
            for b in _slices(whole, 1):
                n, hi, lo, groups, needs, parts, many = [], [], [], [], [], [], [0]
                for own in shingle_sets(b.column(1), width):
                    n.append(len(own))
                    raw = own.tobytes()
                    hi.append(xxhash.xxh3_64_intdigest(raw))
                    lo.append(xxhash.xxh3_64_intdigest(raw, 99))
                    for group, need, hashes in cut.signatures(own) if len(own) else ():
                        groups.append(group)
                        needs.append(need)
                        parts.append(hashes.view(np.int64))
                    many.append(len(groups))
                flat = np.concatenate([*parts, np.zeros(0, np.int64)])
                hashes = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(flat))
                each = pa.StructArray.from_arrays([pa.array(groups, pa.int32()), pa.array(needs, pa.int32()), hashes], ["group", "need", "parts"])
                lists = pa.ListArray.from_arrays(pa.array(many, pa.int32()), each)
                columns = [b.column(0), pa.array(n, pa.int64()), *(pa.array(np.array(x, np.uint64).view(np.int64)) for x in (hi, lo)), lists]
                yield pa.RecordBatch.from_arrays(columns, names=["doc", "n", "hi", "lo", "groups"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, "doc long, n long, hi long, lo long, groups array<struct<group: int, need: int, parts: array<long>>>")


class Sets:
    """Sets of a region as one array; counts of what one has in common with others."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.size = np.fromiter(map(len, sets), np.int64, len(sets))
        self.begin = np.concatenate([[0], np.cumsum(self.size)])
        _, at = np.unique(np.concatenate(sets), return_inverse=True)
        self.at = at
        self.mark = np.zeros(int(at.max()) + 1 if len(at) else 0, np.int64)

    def common(self, x: int, others: np.ndarray) -> np.ndarray:
        own = self.at[self.begin[x] : self.begin[x + 1]]
        self.mark[own] = 1
        size = self.size[others]
        upto = np.cumsum(size)
        flat = np.repeat(self.begin[others] - upto + size, size) + np.arange(upto[-1])
        got = np.add.reduceat(self.mark[self.at[flat]], upto - size)
        self.mark[own] = 0
        return got

    def distances(self, x: int) -> np.ndarray:
        got = self.common(x, np.arange(len(self.size)))
        return 1 - got / (self.size + self.size[x] - got)


def region_links(ids: np.ndarray, sets: list[np.ndarray], similarity: Fraction, pivots: int = 6, together: np.ndarray | None = None, visit: bool = False) -> list[tuple[int, int]]:
    """Links that connect all documents of a region that links connect; sets aren't empty. together: those that are connected already; visit: only pairs of one of these and another count."""
    together = np.zeros(len(ids), bool) if together is None else together
    p, q = similarity.numerator, similarity.denominator
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    while len(sets) > 1:  # a linked set has at least the share p / q of its shingles in common with others
        code = np.unique(np.concatenate(sets), return_inverse=True)[1]
        shared = np.add.reduceat((np.bincount(code)[code] > 1).astype(np.int64), np.cumsum(sizes) - sizes)
        keep = q * shared >= p * sizes
        if keep.all():
            break
        ids, sizes, together, sets = ids[keep], sizes[keep], together[keep], [x for x, k in zip(sets, keep, strict=True) if k]
    if len(sets) < 2:
        return []
    n, out = len(ids), []
    own = Sets(sets)
    far = np.full(n, np.inf)
    table = []
    x = 0
    for _ in range(min(pivots, n // 8)):  # each the farthest from those before
        table.append(own.distances(x))
        far = np.minimum(far, table[-1])
        x = int(far.argmax())
    d = np.stack(table, 1) if table else np.zeros((n, 0))
    group = np.arange(n)
    if together.any():
        group[together] = group[together][0]
    bound = float(1 - similarity) + 1e-9
    for x in range(n - 1):
        rest = np.arange(x + 1, n)
        if visit:
            rest = rest[together[rest] != together[x]]
        near = (group[rest] != group[x]) & (p * np.maximum(own.size[rest], own.size[x]) <= q * np.minimum(own.size[rest], own.size[x]))
        for k in range(d.shape[1]):
            near &= np.abs(d[rest, k] - d[x, k]) <= bound
        rest = rest[near]
        if not len(rest):
            continue
        got = own.common(x, rest)
        for y in rest[q * got >= p * (own.size[rest] + own.size[x] - got)]:
            if group[y] != group[x]:
                group[group == group[y]] = group[x]
                out.append((int(ids[x]), int(ids[y])))
    return out


def _assign(regions: DataFrame, similarity: Fraction, weights: DataFrame) -> DataFrame:
    """region, doc, child, pivot, linked: the Voronoi regions of each document of the regions, with windows of twice the bound.

    The first row of a document is its nearest pivot's, with the pivot's document and whether the two are linked; pivot is null in the
    others. Regions are dealt out in slices.
    """
    window, p, q = 2 * float(1 - similarity) + 1e-9, similarity.numerator, similarity.denominator

    def deal(docs: pd.DataFrame, chosen: pd.DataFrame) -> pd.DataFrame:
        if not len(docs) or not len(chosen):
            return pd.DataFrame({"region": pd.Series([], dtype=object), "doc": pd.Series([], dtype="int64"), "child": pd.Series([], dtype=object), "pivot": pd.Series([], dtype="Int64"), "linked": pd.Series([], dtype=bool)})
        chosen = chosen.sort_values("nr", ignore_index=True)
        sets = Sets([np.asarray(x, np.int64) for x in [*chosen["pivot"], *docs["shingles"]]])
        many, every = len(chosen), np.arange(len(chosen), len(sets.size))
        common = np.stack([sets.common(k, every) for k in range(many)], 1)
        union = sets.size[many:, None] + sets.size[:many] - common
        d = 1 - common / union
        least = d.argmin(1)
        r, j = np.nonzero(d <= d.min(1, keepdims=True) + window)
        region, doc, own = docs["region"].to_numpy(), docs["doc"].to_numpy(), chosen["pivot_doc"].to_numpy()
        linked = (q * common >= p * union)[r, j] & (j == least[r]) & (own[j] != doc[r])
        pivot = pd.Series(own[j], dtype="Int64").where(pd.Series(j == least[r]))
        return pd.DataFrame({"region": region[r], "doc": doc[r], "child": [f"{region[a]}.{b}" for a, b in zip(r, j, strict=True)], "pivot": pivot, "linked": linked})

    parts = F.ceil(F.col("weight") / SLICE_SHINGLES).cast("int")
    w = regions.join(weights.select("region", parts.alias("many")), "region")
    order = Window.partitionBy("region").orderBy(F.xxhash64("doc"), "doc")
    wanted = weights.select("region", F.least(F.lit(PIVOTS), F.ceil(F.col("docs") / LEAF)).alias("wanted"))
    chosen = regions.withColumn("nr", F.row_number().over(order)).where(F.col("nr") <= PIVOTS).join(wanted, "region").where("nr <= wanted").select("region", "nr", F.col("doc").alias("pivot_doc"), F.col("shingles").alias("pivot"))
    chosen = chosen.join(weights.select("region", parts.alias("many")), "region").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("many") - 1))).drop("many")
    w = w.withColumn("part", F.pmod(F.xxhash64("doc", F.lit(1)), F.col("many")).cast("int")).drop("many")
    chosen = chosen.select(F.col("region").alias("at"), F.col("part").alias("piece"), "nr", "pivot_doc", "pivot")
    return w.groupBy("region", "part").cogroup(chosen.groupBy("at", "piece")).applyInPandas(deal, "region string, doc long, child string, pivot long, linked boolean")


def _weight() -> Column:
    """What joining documents costs, in shingles."""
    return F.sum(F.greatest(F.size("shingles"), F.lit(LEAST_SHINGLES)))


def _prune(regions: DataFrame, similarity: Fraction) -> DataFrame:
    """Documents with so many shingles in common with others of their region as a link takes."""
    each = regions.select("region", "doc", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
    seen = each.groupBy("region", "shingle").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).where("a <> b").select("region", "shingle")
    held = each.join(seen, ["region", "shingle"], "left_semi").groupBy("region", "doc", "n").agg(F.count(F.lit(1)).alias("shared"))
    return regions.join(held.where(f"{similarity.denominator} * shared >= {similarity.numerator} * n").select("region", "doc"), ["region", "doc"], "left_semi")


def _blocks(regions: DataFrame, weights: DataFrame) -> DataFrame:
    """Regions that pivots don't split: every two of their blocks meet in a region of their own."""
    many = F.ceil(2 * F.col("weight") / REGION_SHINGLES).cast("int")
    w = regions.join(weights.select("region", many.alias("many")), "region").withColumn("own", F.pmod(F.xxhash64("doc", F.lit(2)), F.col("many")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("many") - 1))
    w = w.withColumn("other", other)
    return w.select(F.concat_ws(":", "region", F.least("own", "other").cast("string"), F.greatest("own", "other").cast("string")).alias("region"), "doc", "shingles", F.lit(False).alias("together"), F.lit(False).alias("visit"))


def _visits(regions: DataFrame) -> DataFrame:
    """regions: core (whether a document is one of those that are connected already). Blocks of these, each with a block of the others."""
    side = regions.groupBy("region", "core").agg(_weight().alias("weight"))
    many = F.ceil(2 * F.col("weight") / REGION_SHINGLES).cast("int")
    both = side.groupBy("region").agg(F.max(F.when(F.col("core"), many)).alias("inner"), F.max(F.when(~F.col("core"), many)).alias("outer")).where("inner IS NOT NULL AND outer IS NOT NULL")
    w = regions.join(both, "region").withColumn("own", F.pmod(F.xxhash64("doc", F.lit(3)), F.when(F.col("core"), F.col("inner")).otherwise(F.col("outer"))).cast("int"))
    w = w.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("core"), F.col("outer")).otherwise(F.col("inner")) - 1)))
    a, b = F.when(F.col("core"), F.col("own")).otherwise(F.col("other")), F.when(F.col("core"), F.col("other")).otherwise(F.col("own"))
    return w.select(F.concat_ws(":", "region", F.lit("v"), a.cast("string"), b.cast("string")).alias("region"), "doc", "shingles", F.col("core").alias("together"), F.lit(True).alias("visit"))


def _small_regions(regions: DataFrame, similarity: Fraction, depth: int = 8) -> tuple[list[DataFrame], list[DataFrame]]:
    """Tables of regions that fit a task, and tables of links (u, v): all links of all regions are among these, or in one of those, or follow from them.

    together: documents of a region that links connect already. visit: of the region only pairs of one of these and another count.
    """
    done: list[DataFrame] = []
    links: list[DataFrame] = []
    apart = lambda df: df.select("region", "doc", "shingles", F.lit(False).alias("together"), F.lit(False).alias("visit"))
    for level in range(-1, depth):
        weights = materialize(regions.groupBy("region").agg(_weight().alias("weight"), F.count(F.lit(1)).alias("docs")), "weights")
        # Every family goes by pivots once; after that only what is too large for a task.
        heavy = F.col("weight") > REGION_SHINGLES
        large = weights.where(F.col("docs") > 1) if level == 0 else weights.where(heavy & (F.col("docs") > 2))
        if large.isEmpty():
            if level < 0:
                continue
            return [*done, apart(regions)], links
        big, small = regions.join(large.select("region"), "region", "left_semi"), regions.join(large.select("region"), "region", "left_anti")
        if level < 0:
            regions = materialize(_prune(big, similarity).unionByName(small), "pruned")
            continue
        done.append(apart(small))
        assigned = materialize(_assign(big, similarity, large), f"assigned-{level}")
        near = assigned.where("pivot IS NOT NULL")
        links.append(near.where("linked").select(F.col("doc").alias("u"), F.col("pivot").alias("v")))
        # Regions that windows put into one child nearly whole stay as they are; the documents linked with the pivot that has most are their core.
        most = assigned.groupBy("region", "child").count().groupBy("region").agg(F.max("count").alias("most"))
        held = near.where("linked").groupBy("region", "pivot").agg(F.count(F.lit(1)).alias("n")).groupBy("region").agg(F.max_by("pivot", F.struct("n", "pivot")).alias("core_pivot"), F.max("n").alias("core_docs"))
        whole = large.join(most, "region").join(held, "region", "left").where((F.col("most") > 0.8 * F.col("docs")) | (F.lit(level == depth - 1) & heavy))
        peeled = heavy & F.lit(level < depth - 1) & (F.coalesce("core_docs", F.lit(0)) >= 0.1 * F.col("docs"))
        whole = materialize(whole.select("region", "weight", "core_pivot", F.when(~heavy, "leaf").when(peeled, "peel").otherwise("blocks").alias("way")), "whole")
        core = F.coalesce((F.col("linked") & (F.col("pivot") == F.col("core_pivot"))) | (F.col("doc") == F.col("core_pivot")), F.lit(False))
        flags = near.join(whole, "region").select("region", "doc", "way", core.alias("core"))
        parted = materialize(big.join(flags, ["region", "doc"]), f"whole-{level}")
        done.append(parted.where("way = 'leaf'").select("region", "doc", "shingles", F.col("core").alias("together"), F.lit(False).alias("visit")))
        if not whole.where("way <> 'leaf'").isEmpty():
            done.append(_blocks(parted.where("way = 'blocks'"), whole))
            done.append(_visits(parted.where("way = 'peel'")))
        rest = parted.where("way = 'peel' AND NOT core").select(F.concat("region", F.lit("'")).alias("region"), "doc", "shingles")
        children = assigned.join(whole.select("region"), "region", "left_anti").select("region", "doc", "child").join(big, ["region", "doc"])
        regions = materialize(children.select(F.col("child").alias("region"), "doc", "shingles").unionByName(rest), f"regions-{level}")
    return [*done, apart(regions)], links


def _join_regions(regions: DataFrame, similarity: Fraction) -> DataFrame:
    """u, v: links of all regions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, sets, flags, visits = None, [], [], [], False

        def close() -> list[tuple[int, int]]:
            return region_links(np.array(ids), sets, similarity, together=np.array(flags), visit=visits) if len(ids) > 1 else []

        for b in batches:
            out = []
            offsets, flat = b.column(2).offsets.to_numpy(), b.column(2).values.to_numpy()
            for k, (region, doc, together, visit) in enumerate(zip(*(b.column(c).to_pylist() for c in (0, 1, 3, 4)), strict=True)):
                if region != now:
                    out += close()
                    now, ids, sets, flags, visits = region, [], [], [], visit
                ids.append(doc)
                flags.append(together)
                sets.append(flat[offsets[k] : offsets[k + 1]].copy())
            yield pa.RecordBatch.from_arrays([pa.array([e[i] for e in out], pa.int64()) for i in (0, 1)], names=["u", "v"])
        out = close()
        yield pa.RecordBatch.from_arrays([pa.array([e[i] for e in out], pa.int64()) for i in (0, 1)], names=["u", "v"])

    dealt = regions.select("region", "doc", "shingles", "together", "visit").repartition("region").sortWithinPartitions("region", "doc")
    return dealt.mapInArrow(run, "u long, v long")


def _met(signed: DataFrame, paths: list[str]) -> DataFrame:
    """doc, group, need, part and n (rows that hold the part) of the parts that several documents hold, written to paths.

    Each path takes an equal share of all parts, one after the other: no more than that is shuffled at once.
    """
    parts = signed.select("doc", F.explode("groups").alias("g")).select("doc", "g.group", "g.need", F.explode("g.parts").alias("part"))
    at = Window.partitionBy("part")
    shared = lambda df: df.withColumns({"n": F.count(F.lit(1)).over(at), "least": F.min("doc").over(at), "most": F.max("doc").over(at)}).where("least <> most").drop("least", "most")
    tables = [write_to(shared(parts.where(F.pmod("part", F.lit(len(paths))) == k)), path) for k, path in enumerate(paths)]
    return reduce(DataFrame.unionByName, tables)


def _rare(met: DataFrame) -> DataFrame:
    """met without the most frequent parts of each document and group, of which a link has others too.

    A linked set shares at least `need` parts of a group with its partner. Of these the rarest (of equals the largest) has `need` - 1 parts
    or more before it among all that either holds, the most frequent first: those that stand before aren't looked at. So what very many
    hold, a common line's parts, seldom joins documents that share nothing else; and a document with fewer parts than that meets nobody.
    """
    return met.withColumn("nr", F.row_number().over(Window.partitionBy("doc", "group").orderBy(F.desc("n"), "part"))).where("nr >= need")


def _families(rare: DataFrame) -> DataFrame:
    """node, root of all documents that meet in a part, directly or by others."""
    pairs = rare.withColumn("least", F.min("doc").over(Window.partitionBy("part"))).where("doc <> least")
    roots = components(pairs.select(F.col("doc").alias("u"), F.col("least").alias("v")))
    return materialize(roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()), "families")


def _gatherings(rare: DataFrame) -> DataFrame:
    """at, doc: for each part the documents that hold it, at least two; of parts that the same ones hold only one."""
    held = materialize(rare.select("part", "doc").distinct(), "held")
    digest = [F.count(F.lit(1)).alias("n"), F.min("doc").alias("a"), F.max("doc").alias("b"), F.bit_xor(F.xxhash64("doc")).alias("x"), F.bit_xor(F.xxhash64("doc", F.lit(1))).alias("y")]
    one = held.groupBy("part").agg(*digest).where("n > 1").groupBy("n", "a", "b", "x", "y").agg(F.min("part").alias("part"))
    return held.join(one.select("part"), "part").select(F.concat(F.lit("p"), F.col("part").cast("string")).alias("at"), "doc")


def _narrowed(regions: DataFrame, met: DataFrame, similarity: Fraction) -> DataFrame:
    """regions (families, each document in one), of which those too large for a task are gathered again.

    A chance meeting or a common line joins many small families to a large one; most of its documents share too few shingles with others.
    Those go, and families are made of who meets among the rest. One that is still too large falls apart into those that hold one part.
    """
    spark, before = regions.sparkSession, None
    for last in (False, True):
        weights = materialize(regions.groupBy("region").agg(_weight().alias("weight"), F.count(F.lit(1)).alias("docs")), "weights")
        large = weights.where((F.col("weight") > REGION_SHINGLES) & (F.col("docs") > 2)).select("region")
        if large.isEmpty():
            break
        pruned, path = new_path(spark, "pruned"), new_path(spark, "narrowed")
        big = write_to(_prune(regions.join(large, "region", "left_semi"), similarity), pruned)
        inside = met.join(_maybe_broadcast(big.select("doc").distinct()), "doc", "left_semi")
        rare = _rare(inside.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("part"))).where("n > 1"))
        found = _gatherings(rare) if last else _families(rare).select(F.col("root").cast("string").alias("at"), F.col("node").alias("doc"))
        again = big.join(_maybe_broadcast(found), "doc").select(F.col("at").alias("region"), "doc", "shingles")
        regions = write_to(again.unionByName(regions.join(large, "region", "left_anti")), path)
        for old in (pruned, before):
            if old:
                drop_path(spark, old)
        before = path
    return regions


def _maybe_broadcast(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def jaccard_groups(docs: DataFrame, *, width: int = 3, similarity: Fraction = Fraction(9, 10), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: id, n_shingles, component_id (the smallest id that links reach, its own included).

    Two documents link if their sets' similarity (common over all shingles) is at least `similarity`. Null texts and texts
    without words have no shingles and no links; texts with fewer words than `width` are one shingle. Rows with one id are one
    document; rows with a null id link with nothing and have no component. An empty table gives an empty one; other columns
    are not read.
    """
    spark = docs.sparkSession
    path = new_path(spark, "sketch")
    signed = write_to(sketch(docs, width, similarity, id_col, text_col), path)
    rows = materialize(signed.drop("groups"), "sets")
    sets = ["n", "hi", "lo"]
    classes = rows.where("n > 0 and doc is not null").groupBy(*sets).agg(F.min("doc").alias("rep"), F.max("doc").alias("last"))
    repeated = materialize(classes.where("rep < last").drop("last"), "repeated")
    repeated = _maybe_broadcast(repeated)
    with_first = lambda df: df.join(repeated, sets, "left").withColumn("rep", F.coalesce("rep", "doc"))
    member = with_first(rows)
    paths = [new_path(spark, "met") for _ in range(SHARES)]
    met = _met(with_first(signed).where("n > 0 and doc = rep"), paths)
    drop_path(spark, path)  # the signatures, as large as the texts: whatever meets is written by now
    families = _families(_rare(met))

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _slices(whole, 2):
                own = list(shingle_sets(b.column(2), width))
                flat = np.concatenate(own).view(np.int64) if own else np.zeros(0, np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, own)]), pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists], names=["region", "doc", "shingles"])

    texts = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).cast("string").alias("text")).join(_maybe_broadcast(families), "node")
    regions = texts.select(F.col("root").cast("string").alias("region"), F.col("node").alias("doc"), "text").mapInArrow(sets_of, "region string, doc long, shingles array<long>")
    path = new_path(spark, "regions")
    whole = write_to(regions.where(F.size("shingles") > 0), path)
    regions = _narrowed(whole, met, similarity)
    for old in [*paths, path] if regions is not whole else paths:
        drop_path(spark, old)
    small, by_pivots = _small_regions(regions, similarity)
    together = small[0]
    for more in small[1:]:
        together = together.unionByName(more)
    links = _join_regions(together, similarity)
    for more in by_pivots:
        links = links.unionByName(more)
    # Rows with one id are one document, whatever their sets; a row is linked with the first of its set.
    same = member.where("doc <> rep and n > 0").select(F.col("doc").alias("u"), F.col("rep").alias("v"))
    linked = materialize(links, "links")
    roots = components(linked.unionByName(same))
    out = rows.select("doc", "n").join(_maybe_broadcast(materialize(roots, "roots")).withColumnRenamed("node", "doc"), "doc", "left")
    return out.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("root", "doc").alias("component_id"))
