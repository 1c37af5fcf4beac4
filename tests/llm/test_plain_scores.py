"""The quality score of every document, computed again by plain loops over passages."""

import math
from collections import Counter

import numpy as np
import pytest

from terrace.llm import quality

SF = "/root/testdata/sf0.001"


def _passages(text):
    """Features of each passage of 64 words, by loops over bytes and words."""
    raw = (text or "").encode()
    words = raw.split()
    if not words:
        return [[0.0] * quality.FEATURES]
    blocks, at, inside, seen = [Counter() for _ in range(-(-len(words) // 64))], -1, False, -1
    for byte in raw:
        blank = byte in b" \t\n\r\x0b\x0c"
        if not blank and not inside:
            seen += 1
        inside = not blank
        at = max(seen, 0) // 64
        blocks[at][int(quality._CLASS[byte])] += 1
    out = []
    for k, block in enumerate(blocks):
        own, total = words[64 * k : 64 * k + 64], sum(block.values())
        size = [len(w) for w in own]
        mean = sum(size) / len(own)
        spread = math.sqrt(max(sum(s * s for s in size) / len(own) - mean * mean, 0))
        same = sum(64 * k + i > 0 and words[64 * k + i - 1] == w for i, w in enumerate(own)) / len(own)
        out.append([block[c] / total for c in range(quality.CLASSES)] + [mean / 10, spread / 10, same, len(set(own)) / len(own), sum(s > 20 for s in size) / len(own), math.log1p(len(own)) / 5])
    return out


def _score(model, text):
    w, states, votes = {k: v.tolist() for k, v in model.weights.items()}, [], []
    sigmoid = lambda v: 1 / (1 + math.exp(-max(-30.0, min(30.0, v))))
    dot = lambda x, m, j: sum(a * row[j] for a, row in zip(x, m))
    for passage in _passages(text):
        x = [(v - m) / s for v, m, s in zip(passage, model.mean.tolist(), model.scale.tolist())]
        h = [math.tanh(dot(x, w["W"], j) + w["b"][j]) for j in range(quality.HIDDEN)]
        gate = [math.tanh(dot(h, w["V"], j)) * sigmoid(dot(h, w["U"], j)) for j in range(quality.GATE)]
        states.append(h)
        votes.append(sum(a * b for a, b in zip(gate, w["w"])))
    top = max(votes)
    share = [math.exp(v - top) for v in votes]
    z = [sum(s * h[j] for s, h in zip(share, states)) / sum(share) for j in range(quality.HIDDEN)]
    return sigmoid(sum(a * b for a, b in zip(z, w["o"])) + w["c"][0])


def test_scores_equal_plain_loops(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    got = quality.score(docs, model).collect()
    assert len(got) == docs.count()
    for r in got:
        assert r.score == pytest.approx(_score(model, r.text), abs=2e-5)


@pytest.mark.parametrize("text", [None, "", " \n", "a", " lead a a b", "é " * 130, "x" * 50 + " y", " w w w"])
def test_features_equal_plain_loops(text):
    assert np.allclose(quality.encode(text), _passages(text), atol=1e-5)
