"""Continuous change detection: a harmonic is fitted to each pixel's observations in order of time, until several in a row don't fit.

A segment is kept as the sums of its normal equations, so it grows by an observation without its rows. Once it has enough of them it
is fitted; a new observation whose residuals, over the fit's error, are too far out by the chi-square distribution waits. If an
observation fits, those that wait were outliers and are dropped. If enough wait, there was a change where the first of them is: the
segment ends and they begin the next. Rows come sorted by pixel and time, in one shuffle; tasks step many pixels at once through
their observations, and hold a pixel of any length by its sums. What comes before a segment's first fit isn't screened: clouds are to be masked before.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.functions.scalars import all_of, finite

#: Observations (times bands) that a task steps through together.
CELLS = 1 << 20


def chi_square_cdf(x: float, dof: int) -> float:
    """The share of the chi-square distribution up to x, by the series of the incomplete gamma function."""
    a, z = dof / 2, x / 2
    if z <= 0:
        return 0.0
    term = total = 1 / a
    k = 0
    while term > total * 1e-16:
        k += 1
        term *= z / (a + k)
        total += term
    return total * math.exp(a * math.log(z) - z - math.lgamma(a))


def chi_square_quantile(p: float, dof: int) -> float:
    if p >= 1:
        return math.inf
    low, high = 0.0, 1.0
    while chi_square_cdf(high, dof) < p:
        high *= 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square_cdf(mid, dof) < p else (low, mid)
    return high


@dataclass(frozen=True)
class Detection:
    """harmonics: turns a year at most; a fit has three observations a term at least. consecutive: how many that don't fit are a change.

    probability: of the chi-square distribution, with a degree for each band (1: everything fits). A segment is fitted from least_years on, again when it has grown by
    the factor refit, and when it ends. least_rmse: errors are held to be no smaller.
    """

    harmonics: int = 3
    consecutive: int = 6
    probability: float = 0.99
    least_years: float = 1.33
    refit: float = 1.1
    least_rmse: float = 1e-6

    @property
    def terms(self) -> int:
        return 2 + 2 * self.harmonics

    @property
    def least(self) -> int:
        """Observations of the smallest fit."""
        return 3 * (2 + 2 * min(1, self.harmonics))


class Segmenter:
    """Segments of some pixels that step together; times are counted from `origin`, a whole year of each pixel."""

    def __init__(self, how: Detection, origin: np.ndarray, bands: int) -> None:
        p, k = len(origin), how.terms
        self.how, self.origin, self.bands = how, origin, bands
        self.limit = chi_square_quantile(how.probability, bands)
        self.xx, self.xy, self.yy = np.zeros((p, k, k)), np.zeros((p, k, bands)), np.zeros((p, bands))
        self.n, self.start, self.end = np.zeros(p, np.int64), np.zeros(p), np.zeros(p)
        self.fitted_n, self.coefs, self.rmse = np.zeros(p, np.int64), np.zeros((p, k, bands)), np.zeros((p, bands))
        self.waiting, self.wait_t, self.wait_y = np.zeros(p, np.int64), np.zeros((p, how.consecutive)), np.zeros((p, how.consecutive, bands))
        self.closed: list[tuple] = []

    def design(self, at: np.ndarray, t: np.ndarray) -> np.ndarray:
        s = t - self.origin[at]
        turns = [f(2 * math.pi * h * s) for h in range(1, self.how.harmonics + 1) for f in (np.cos, np.sin)]
        return np.stack([np.ones_like(s), s, *turns], axis=1)

    def step(self, at: np.ndarray, t: np.ndarray, y: np.ndarray) -> None:
        """One observation of each of the pixels at."""
        x = self.design(at, t)
        known = self.fitted_n[at] > 0
        far = np.zeros(len(at), bool)
        if known.any():
            some = at[known]
            left = y[known] - np.einsum("pk,pkb->pb", x[known], self.coefs[some])
            far[known] = ((left / self.rmse[some]) ** 2).sum(axis=1) > self.limit
        odd = at[far]
        self.wait_t[odd, self.waiting[odd]], self.wait_y[odd, self.waiting[odd]] = t[far], y[far]
        self.waiting[odd] += 1
        good = ~far
        self.waiting[at[good]] = 0
        self.add(at[good], t[good], x[good], y[good])
        changed = odd[self.waiting[odd] == self.how.consecutive]
        if len(changed):
            self.close(changed, self.wait_t[changed, 0])
            for k in range(self.how.consecutive):
                now = self.wait_t[changed, k]
                self.add(changed, now, self.design(changed, now), self.wait_y[changed, k])
            self.waiting[changed] = 0
        grown = at[(self.n[at] >= self.how.least) & (self.end[at] - self.start[at] >= self.how.least_years) & (self.n[at] >= self.how.refit * self.fitted_n[at])]
        self.fit(grown[self.n[grown] > self.fitted_n[grown]])

    def add(self, at: np.ndarray, t: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
        self.start[at] = np.where(self.n[at] == 0, t, self.start[at])
        self.end[at] = t
        self.n[at] += 1
        self.xx[at] += x[:, :, None] * x[:, None, :]
        self.xy[at] += x[:, :, None] * y[:, None, :]
        self.yy[at] += y * y

    def fit(self, at: np.ndarray) -> None:
        """Least squares from the sums; terms that the observations are too few for are 0."""
        turns = np.minimum(self.how.harmonics, self.n[at] // 6 - 1)
        for h in np.unique(turns):
            some, k = at[turns == h], 2 + 2 * int(h)
            a, b = self.xx[some, :k, :k], self.xy[some, :k]
            # Observations at few different times leave terms open: a trace of damping then decides.
            damp = np.einsum("pkk->p", a)[:, None, None] * 1e-13 * np.eye(k)
            c = np.linalg.solve(a + damp, b)
            squares = self.yy[some] - 2 * np.einsum("pkb,pkb->pb", c, b) + np.einsum("pkb,pkl,plb->pb", c, a, c)
            self.coefs[some] = 0
            self.coefs[some, :k] = c
            self.rmse[some] = np.maximum(np.sqrt(np.maximum(squares, 0) / np.maximum(self.n[some] - k, 1)[:, None]), self.how.least_rmse)
            self.fitted_n[some] = self.n[some]

    def close(self, at: np.ndarray, changed: np.ndarray | None = None) -> None:
        """The segments of these pixels end, those that were never fitted without a trace; changed: when, if they changed."""
        keep = self.fitted_n[at] > 0
        self.fit(at[keep])
        own = at[keep]
        coefs = self.coefs[own].copy()
        coefs[:, 0] -= coefs[:, 1] * self.origin[own][:, None]  # times from year 0 again; whole years leave the turns as they are
        breaks = np.full(len(own), np.nan) if changed is None else changed[keep]
        self.closed.append((own, self.start[own], self.end[own], breaks, self.n[own], coefs, self.rmse[own].copy()))
        self.xx[at], self.xy[at], self.yy[at], self.n[at], self.fitted_n[at] = 0, 0, 0, 0, 0


def _batch(done: Segmenter, keys: pa.Array) -> pa.RecordBatch:
    """What was closed, sorted by pixel and time, as rows."""
    own, start, end, breaks, n, coefs, rmse = (np.concatenate(x) for x in zip(*done.closed, strict=True))
    done.closed = []
    order = np.lexsort((start, own))
    k, bands = done.how.terms, done.bands
    cols = [keys.take(pa.array(own[order])), *(pa.array(x[order]) for x in (start, end)), pa.array(breaks[order], mask=np.isnan(breaks[order])), pa.array(n[order])]
    flat = lambda b: pa.array(coefs[order][:, :, b].ravel())
    cols += [pa.ListArray.from_arrays(pa.array(np.arange(len(order) + 1) * k, pa.int32()), flat(b)) for b in range(bands)]
    cols += [pa.array(rmse[order][:, b]) for b in range(bands)]
    return pa.RecordBatch.from_arrays(cols, names=["key", "tStart", "tEnd", "tBreak", "n", *(f"coefs{b}" for b in range(bands)), *(f"rmse{b}" for b in range(bands))])


def detect_changes(series: DataFrame, bands: list[str], how: Detection | None = None, *, key: str = "pixel", t: str = "t") -> DataFrame:
    """key, tStart, tEnd, tBreak (null if it didn't change), n, and coefs_<band> and rmse_<band> of each band, a row for each segment.

    series: key, t (in years) and the bands; rows with a null or a value that isn't finite are left out, and so are pixels that never have a
    segment. Observations at one time go by the bands' values. coefs: constant, slope, cosine and sine of each turn, as `harmonic` takes them.
    """
    how, width = how or Detection(), len(bands)
    if not bands:
        raise ValueError("there are no bands")
    own = series.select(F.col(key).alias("key"), F.col(t).cast("double").alias("t"), *[F.col(b).cast("double").alias(f"y{k}") for k, b in enumerate(bands)])
    own = own.where(F.col("key").isNotNull() & all_of([finite(F.col(c)) for c in own.columns[1:]]))
    sorted_rows = own.repartition("key").sortWithinPartitions(*own.columns)

    def stepped(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        """Whole pixels."""
        key = rows.column(0).combine_chunks()
        t, y = rows.column(1).to_numpy(), np.stack([rows.column(2 + b).to_numpy() for b in range(width)], axis=1)
        heads = starts_of(key)
        size = np.diff([*heads, len(key)])
        done = Segmenter(how, np.floor(t[heads]), width)
        order = np.argsort(-size, kind="stable")  # the longest first, so that those that still go on are the first ones
        left = np.searchsorted(-size[order], -np.arange(size.max()), "left")
        for i, many in enumerate(left):
            at = order[:many]
            done.step(at, t[heads[at] + i], y[heads[at] + i])
        done.close(np.arange(len(heads)))
        yield _batch(done, key.take(pa.array(heads)))

    def long(rows: Iterator[pa.Table]) -> Iterator[pa.RecordBatch]:
        """One pixel, in pieces."""
        done = key = None
        for piece in rows:
            t, y = piece.column(1).to_numpy(), np.stack([piece.column(2 + b).to_numpy() for b in range(width)], axis=1)
            if done is None:
                done, key = Segmenter(how, np.floor(t[:1]), width), piece.column(0).combine_chunks().slice(0, 1)
            for i in range(len(t)):
                done.step(np.zeros(1, np.int64), t[i : i + 1], y[i : i + 1])
            if done.closed:
                yield _batch(done, key)
        done.close(np.zeros(1, np.int64))
        yield _batch(done, key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []  # whole pixels and the last one, which may go on
        many = 0
        pieces = _Pieces(pa.Table.from_batches([b]) for b in batches if b.num_rows)
        for piece in pieces:
            held.append(piece)
            many += len(piece)
            if many * width < CELLS:
                continue
            rows = pa.concat_tables(held)
            last = int(starts_of(rows.column(0).combine_chunks())[-1])
            if last:
                yield from stepped(rows.slice(0, last))
            rest = rows.slice(last)
            held, many = [rest], len(rest)
            if many * width >= CELLS:
                yield from long(pieces.of_key(rest))
                held, many = [], 0
        if many:
            yield from stepped(pa.concat_tables(held))

    kind = own.schema["key"].dataType.simpleString()
    made = ["key " + kind, "tStart double", "tEnd double", "tBreak double", "n long", *(f"coefs{b} array<double>" for b in range(width)), *(f"rmse{b} double" for b in range(width))]
    found = sorted_rows.mapInArrow(run, ", ".join(made))
    names = {"key": key, **{f"coefs{k}": f"coefs_{b}" for k, b in enumerate(bands)}, **{f"rmse{k}": f"rmse_{b}" for k, b in enumerate(bands)}}
    return found.select(*[F.col(c).alias(names.get(c, c)) for c in found.columns])


def starts_of(key: pa.Array) -> np.ndarray:
    """Where runs of equal keys begin."""
    if not len(key):
        return np.zeros(0, np.int64)
    import pyarrow.compute as pc

    new = pc.not_equal(key.slice(1), key.slice(0, len(key) - 1)).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.flatnonzero(new) + 1])


class _Pieces:
    """A stream of tables from which the rows of the key at its head can be taken."""

    def __init__(self, tables: Iterator[pa.Table]) -> None:
        self.tables, self.back = iter(tables), []

    def __iter__(self) -> Iterator[pa.Table]:
        return self

    def __next__(self) -> pa.Table:
        return self.back.pop() if self.back else next(self.tables)

    def of_key(self, first: pa.Table) -> Iterator[pa.Table]:
        """first, which is of one key, and what follows it of that key."""
        key = first.column(0)[0]
        yield first
        for table in self:
            heads = starts_of(table.column(0).combine_chunks())
            end = int(heads[1]) if len(heads) > 1 else len(table)
            if table.column(0)[0] != key:
                end = 0
            if end:
                yield table.slice(0, end)
            if end < len(table):
                self.back.append(table.slice(end))
                return
