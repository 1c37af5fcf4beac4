"""Quality classifier: gated attention over the passages of a document (multiple-instance learning).

A text is cut into passages of so many words; each is encoded by shares of character classes, word lengths and repetition.
A passage's hidden state h is tanh(x W); its attention is the softmax over the document of w . (tanh(h V) * sigmoid(h U));
the document is the attention-weighted mean of its passages' states, and its score a logistic function of that. All weights
are learnt from the labels of documents; no passage has a label.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.scratch import materialize

PASSAGE_WORDS = 64
#: The sample that the classifier is fitted on: documents, and passages among them (whole documents only).
TRAIN_DOCS, TRAIN_PASSAGES = 8000, 120_000
HIDDEN, GATE, EPOCHS, RATE = 24, 12, 160, 0.02

#: Byte classes: letters, digits, space, line ends, each mark that is common alone, other marks, control, beyond ASCII.
_CLASS = np.zeros(256, np.int64)
_CLASS[ord("A"):ord("Z") + 1] = 1
_CLASS[ord("a"):ord("z") + 1] = 2
_CLASS[ord("0"):ord("9") + 1] = 3
_CLASS[[10, 13]] = 4
_CLASS[[9, 11, 12, 32]] = 5
for _k, _c in enumerate("!#$%&*|.,?:<>-/@"):
    _CLASS[ord(_c)] = 6 + _k
_CLASS[128:] = 22
_CLASS[[c for c in range(33, 127) if not _CLASS[c]]] = 23
CLASSES = 24
FEATURES = CLASSES + 6


def encode(text: str | None) -> np.ndarray:
    """Passages x FEATURES of a text: at least one passage, all zero if there is no word."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    n = len(words)
    if not n:
        return np.zeros((1, FEATURES), np.float32)
    count = -(-n // PASSAGE_WORDS)
    code = _CLASS[np.frombuffer(raw, np.uint8)]
    gap = (code == 4) | (code == 5)
    start = ~gap
    start[1:] &= gap[:-1]
    passage = np.maximum(np.cumsum(start) - 1, 0) // PASSAGE_WORDS
    shares = np.bincount(passage * CLASSES + code, minlength=count * CLASSES)[: count * CLASSES].reshape(count, CLASSES).astype(np.float32)
    length = np.fromiter(map(len, words), np.int64, n)
    ids = np.fromiter(map(hash, words), np.int64, n)
    at = np.arange(n) // PASSAGE_WORDS
    size = np.bincount(at, minlength=count).astype(np.float32)
    mean = np.bincount(at, length, count) / size
    spread = np.sqrt(np.maximum(np.bincount(at, length.astype(float) ** 2, count) / size - mean**2, 0))
    same = np.zeros(n)
    same[1:] = ids[1:] == ids[:-1]
    order = np.lexsort((ids, at))
    fresh = np.ones(n)
    fresh[1:] = (ids[order][1:] != ids[order][:-1]) | (at[order][1:] != at[order][:-1])
    long = np.bincount(at, length > 20, count) / size
    extra = [mean / 10, spread / 10, np.bincount(at, same, count) / size, np.bincount(at[order], fresh, count) / size, long, np.log1p(size) / 5]
    return np.concatenate([shares / shares.sum(1, keepdims=True), np.stack(extra, 1)], 1).astype(np.float32)


def bags(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All passages of all texts, and the first passage of each text."""
    each = [encode(t) for t in texts]
    return np.concatenate(each), np.cumsum([0, *(len(x) for x in each[:-1])])


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def scores(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The score of each document; x: the passages of all."""
        return _forward(self.weights, (x - self.mean) / self.scale, first)["score"]


def _forward(w: dict[str, np.ndarray], x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
    doc = np.repeat(np.arange(len(first)), np.diff([*first, len(x)]))
    h = np.tanh(x @ w["W"] + w["b"])
    t, s = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-np.clip(h @ w["U"], -30, 30)))
    e = (t * s) @ w["w"]
    e = np.exp(e - np.maximum.reduceat(e, first)[doc])
    a = e / np.add.reduceat(e, first)[doc]
    z = np.add.reduceat(h * a[:, None], first)
    logit = z @ w["o"] + w["c"][0]
    return {"doc": doc, "h": h, "t": t, "s": s, "a": a, "z": z, "score": 1 / (1 + np.exp(-np.clip(logit, -30, 30)))}


def _gradients(w: dict[str, np.ndarray], x: np.ndarray, first: np.ndarray, y: np.ndarray, f: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Of the mean log loss."""
    d = (f["score"] - y) / len(y)
    dz = d[:, None] * w["o"]
    doc, a, h, t, s = f["doc"], f["a"], f["h"], f["t"], f["s"]
    da = (h * dz[doc]).sum(1)
    de = a * (da - np.add.reduceat(a * da, first)[doc])
    dg = de[:, None] * w["w"]
    dt, ds = dg * s * (1 - t**2), dg * t * s * (1 - s)
    dh = (a[:, None] * dz[doc] + dt @ w["V"].T + ds @ w["U"].T) * (1 - h**2)
    return {"o": f["z"].T @ d, "c": np.array([d.sum()]), "w": (t * s).T @ de, "V": h.T @ dt, "U": h.T @ ds, "W": x.T @ dh, "b": dh.sum(0)}


def fit(x: np.ndarray, first: np.ndarray, y: np.ndarray, seed: int = 7) -> Model:
    """Adam over batches of documents, with a little weight decay. Without labels every score is one half."""
    rng = np.random.default_rng(seed)
    shapes = {"W": (FEATURES, HIDDEN), "b": (HIDDEN,), "V": (HIDDEN, GATE), "U": (HIDDEN, GATE), "w": (GATE,), "o": (HIDDEN,), "c": (1,)}
    w = {k: np.zeros(s) if k in "bc" else rng.normal(0, 1 / np.sqrt(s[0]), s) for k, s in shapes.items()}
    if not len(y):
        return Model(np.zeros(FEATURES), np.ones(FEATURES), w | {"o": np.zeros(HIDDEN)})
    mean, scale = x.mean(0), x.std(0) + 1e-3
    x = ((x - mean) / scale).astype(np.float64)
    size = np.diff([*first, len(x)])
    m, v, step = {k: 0 * a for k, a in w.items()}, {k: 0 * a for k, a in w.items()}, 0
    batch = max(64, len(y) // 16)
    for epoch in range(max(20, min(EPOCHS, EPOCHS * 4000 // max(len(y), 1)))):
        order = rng.permutation(len(y))
        for k in range(0, len(y), batch):
            own = order[k : k + batch]
            at = np.concatenate([np.arange(first[i], first[i] + size[i]) for i in own])
            begin = np.cumsum([0, *size[own][:-1]])
            g = _gradients(w, x[at], begin, y[own], _forward(w, x[at], begin))
            step += 1
            for n in w:
                grad = g[n] + 1e-4 * w[n]
                m[n], v[n] = 0.9 * m[n] + 0.1 * grad, 0.999 * v[n] + 0.001 * grad**2
                w[n] = w[n] - RATE / (1 + epoch / 40) * (m[n] / (1 - 0.9**step)) / (np.sqrt(v[n] / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, w)


def held_out(id_col: str = "doc_id"):
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), 4) == 2


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_docs: int = TRAIN_DOCS) -> Model:
    """Fit on at most max_docs labelled documents, the first by a hash of their ids, none of them held out.

    A document with labels 0 and 1 counts as bad. Labels other than 0 and 1, and null ids, are left out. Of rows repeated with one
    id one text counts; null and empty texts are one empty passage. Of the chosen documents, those that would bring the passages
    above TRAIN_PASSAGES are passed over; only ids and numbers of passages, and then the passages that are taken, come to
    the driver. Without labels or documents every score is one half. Other columns are not read.
    """
    good = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~F.coalesce(held_out(id_col), F.lit(True)))
    chosen = good.groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("y")).orderBy(F.xxhash64("id"), "id").limit(max_docs)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "id")
    one = texts.groupBy("id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t")).select("id", "y", "t.text")

    def passages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = [encode(t) for t in b["text"]]
            yield pd.DataFrame({"id": b["id"], "y": b["y"], "n": [len(e) for e in x], "x": [e.tobytes() for e in x]})

    empty = np.zeros((0, FEATURES), np.float32), np.zeros(0, int), np.zeros(0)
    if not max_docs:
        return fit(*empty)
    made = materialize(one.mapInPandas(passages, "id long, y int, n long, x binary"), "passages")
    sizes = made.select("id", "n").toPandas().sort_values("id").sample(frac=1, random_state=7)  # at most max_docs rows
    taken, total = [], 0
    for i, n in zip(sizes["id"], sizes["n"], strict=True):
        if total + n <= TRAIN_PASSAGES:
            taken.append(int(i))
            total += n
    got = made.where(F.col("id").isin(taken)).toPandas() if len(taken) < len(sizes) else made.toPandas()
    if not len(got):
        return fit(*empty)
    got = got.set_index("id").loc[taken]
    each = [np.frombuffer(x, np.float32).reshape(-1, FEATURES) for x in got["x"]]
    return fit(np.concatenate(each), np.cumsum([0, *(len(x) for x in each[:-1])]), got["y"].to_numpy(float))


def score(docs: DataFrame, model: Model, *, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """docs with a score from 0 to 1 for each row, of its text alone; null and empty texts get one too.

    Equal texts score alike, texts of any length are read whole, an empty table gives an empty one. out_col replaces a column of its name.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            yield pd.Series(np.concatenate([shared.value.scores(*bags(list(t[k : k + 256]))) for k in range(0, len(t), 256)]) if len(t) else np.zeros(0))

    return docs.withColumn(out_col, of(F.col(text_col)))
