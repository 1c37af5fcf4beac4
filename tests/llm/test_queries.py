"""The registered queries: against SQL where there is any, else against plain code on the smallest tables."""

import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from llm_plain import components, licenses, words_ws

from terrace.llm import queries

SF = "/root/testdata/sf0.001"


def table(name):
    return duckdb.sql(f"SELECT * FROM '{SF}/{name}.parquet'").df()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_sql(spark, name):
    from oracle import same

    same(queries.QUERIES[name](spark, SF), queries.ORACLES[name], SF)


def test_op2_hosts_paths_and_rules(spark):
    got = {r.page_id: r for r in queries.op2_url_filter(spark, SF).collect()}
    pages = table("pages")
    assert len(got) == len(pages)
    for p in pages.itertuples():
        rest = p.url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, tail = rest[:cut].lower(), rest[cut:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
        fits = [(h + q, ok) for h, q, ok in (("org", "/", 1), ("example.org", "/es/", 0), ("example.org", "/en/1", 0), ("com", "/fr/", 1), ("com", "/de/", 0)) if (host == h or host.endswith("." + h)) and path.startswith(q)]
        rule = max(fits, key=lambda x: len(x[0])) if fits else None
        r = got[p.page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule and rule[0])
        assert r.verdict in ("allow", "block") and (not rule or r.verdict == ("allow" if rule[1] else "block"))


def test_op3_recall(spark):
    e = table("embeddings").sort_values("vec_id")
    x = np.array(e["embedding"].tolist(), float)
    got = queries.op3_posting_lists(spark, SF).toPandas()
    hits = []
    for q, own in got.groupby("query_id"):
        s = x @ x[q]
        s[q] = -np.inf
        hits.append(len(set(own["vec_id"]) & set(np.argsort(-s, kind="stable")[:20])) / 20)
        own = own.sort_values("rank")
        assert list(own["rank"]) == list(range(1, 21)) and np.allclose(own["score"], s[own["vec_id"]]) and (own["score"].diff().dropna() <= 0).all()
    assert len(hits) == 25 and np.mean(hits) >= 0.9


def test_op4_ids_and_places(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = queries.op4_best_fit_packing(spark, SF).toPandas()
    by = {(r.doc_id, r.piece): r for r in got.itertuples()}
    n = 0
    for d in table("documents").itertuples():
        ids = np.array([*t.encode(d.text or "", add_special_tokens=False).ids, 0], "<u4")
        for k in range(0, len(ids), 2048):
            r = by[d.doc_id, k // 2048]
            assert (r.start, r.length, r.ids_crc32) == (k, len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048].tobytes()))
            n += 1
    assert n == len(got)
    got = got.sort_values(["sequence_id", "offset"])
    assert (got.groupby("sequence_id")["length"].cumsum() - got["length"] == got["offset"]).all()
    assert got.groupby("sequence_id")["length"].sum().max() <= 2048
    assert got["sequence_id"].nunique() <= 1.02 * -(-got["length"].sum() // 2048) + 1


def test_op5_targets(spark):
    got = queries.op5_mix_sources(spark, SF).toPandas()
    again = queries.op5_mix_sources(spark, SF).toPandas()
    docs = table("documents")
    size = {d.doc_id: len(words_ws(d.text or "")) for d in docs.itertuples()}
    assert {r.doc_id: r.size for r in got.itertuples()} == size
    assert sorted(got.itertuples(index=False)) == sorted(again.itertuples(index=False))
    assert (got["taken"] <= 2 * got["size"]).all()
    got = got.merge(docs[["doc_id", "source"]], on="doc_id")
    sources = sorted(set(docs["source"]))
    total = {s: sum(size[d.doc_id] for d in docs.itertuples() if d.source == s) for s in sources}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sources)}
    target, left, open_ = {}, 1.5 * sum(total.values()), set(sources)
    while True:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * total[s]}
        if not full:
            break
        for s in full:
            target[s] = 2 * total[s]
            left -= target[s]
        open_ -= full
    target |= {s: level * weight[s] for s in open_}
    for s, own in got.groupby("source"):
        assert own["target"].iloc[0] == pytest.approx(target[s]) and own["source_size"].iloc[0] == total[s]
        assert abs(own["taken"].sum() - target[s]) <= own["size"].max() / 2 + 1


def test_op5_takes_the_smallest_keys(spark):
    from pyspark.sql import functions as F

    from terrace.llm.mixing import sampling_key

    got = {r.doc_id: r for r in queries.op5_mix_sources(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").join(queries.label_weights(spark, SF), "doc_id", "left")
    rows = docs.select("doc_id", "source", sampling_key(F.col("doc_id"), F.xxhash64("text"), F.col("quality_weight"), 42).alias("key")).collect()
    for source in {r.source for r in rows}:
        own = sorted((r.key, r.doc_id) for r in rows if r.source == source)
        size, target = got[own[0][1]].source_size, got[own[0][1]].target
        epochs, before = int(target // size), 0
        for _, doc in own:  # whole epochs, then documents in order of their keys as long as they end nearer to the target
            n = got[doc].size
            more = n > 0 and before + n / 2 <= target - epochs * size
            assert got[doc].taken == n * (epochs + more)
            before += n


def test_op7_shards(spark):
    got = queries.op7_minimax_shards(spark, SF).toPandas()
    docs = table("documents").set_index("doc_id")["text"].fillna("")
    for r in got.itertuples():
        raw = docs[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(raw) + 8, zlib.crc32(raw))
    assert all(sorted(s["slot"]) == list(range(len(s))) for _, s in got.groupby("shard"))
    assert got.assign(t=docs[got["doc_id"]].to_numpy()).groupby("t")["shard"].nunique().max() == 1
    assert set(got["shard"]) <= set(range(24)) and set(got["law"]) == {"bytes"} and got["grown_shard"].isna().all()
    groups = got.assign(t=docs[got["doc_id"]].to_numpy()).groupby("t").agg(b=("size", "sum"), k=("doc_id", "min")).sort_values("k")["b"].tolist()

    def shards(capacity):
        n, now = 1, 0
        for b in groups:
            n, now = (n + 1, b) if now + b > capacity else (n, now + b)
        return n

    most = int(got.groupby("shard")["size"].sum().max())
    assert shards(most) <= 24 < shards(most - 1)


def test_op8_components(spark):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op8_jaccard_regions(spark, SF).collect()}
    assert got == components({d.doc_id: d.text for d in table("documents").itertuples()}, 3, 9, 10)


def test_op9_base_phrases(spark):
    got = {r.doc_id: r for r in queries.op9_license_scan(spark, SF).collect()}
    docs = table("documents")
    assert len(got) == len(docs)
    for d in docs.itertuples():
        r = got[d.doc_id]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == licenses(d.text)
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1


def test_op10_held_out(spark):
    got = queries.op10_quality_mil(spark, SF).toPandas()
    assert len(got) == len(table("documents")) and got["score"].between(0, 1).all()
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got["doc_id"]]).all()
    own = got.merge(table("labels"), on="doc_id")
    own = own[own["held_out"]]
    assert (own["predicted"] == own["quality"]).mean() >= 0.95 and ((got["score"] >= 0.7) == (got["predicted"] == 1)).all()
