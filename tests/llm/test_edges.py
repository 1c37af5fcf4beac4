"""Odd rows, empty tables, ties, collisions and hot groups, operator by operator."""

import hashlib
import random
from fractions import Fraction

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from llm_plain import components, license_spans, url_tree, words_ws
from llm_plain import licenses as plain_licenses
from pyspark.sql import functions as F

from terrace.llm import ann, chat, jaccard, licenses, mixing, packing, quality, sharding, urls
from terrace.llm.dedup import digest_state, exact_dedup
from terrace.scratch import new_path


# 1 exact dedup
def test_dedup_odd_rows(spark, odd):
    got = exact_dedup(spark, odd()).collect()
    assert len(got) == 14
    by = {}
    for r in got:
        by.setdefault(r.text or "", []).append(r)
    for text, rows in by.items():
        assert sum(r.kept for r in rows) == 1 and {r.group_size for r in rows} == {len(rows)}
        assert {r.keep_id for r in rows} == {max((r.doc_id for r in rows if r.doc_id is not None), default=None)}
        assert rows[0].text_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert set(got[0].asDict()) >= {"score", "rank"}


def test_dedup_empty(spark, odd):
    assert exact_dedup(spark, odd([], False)).count() == 0


def test_dedup_checks_bytes_on_hits(spark, odd):
    got = exact_dedup(spark, odd(), digest=lambda c: F.substring(F.sha2(c, 256), 1, 1)).collect()
    want = exact_dedup(spark, odd()).collect()
    key = lambda r: (str(r.doc_id), r.text or "", r.score, r.kept, r.group_size, r.keep_id, r.text_sha256)
    assert sorted(map(key, got), key=str) == sorted(map(key, want), key=str)


def test_dedup_state_goes_on(spark, tmp_path):
    src, ck = str(tmp_path / "in"), new_path(spark, "state")
    slim = lambda rows: spark.createDataFrame(rows, "digest string, doc long, file string, row long")
    slim([("a", 1, "f", 0), ("b", 2, "f", 1)]).write.mode("append").parquet(src)
    stream = lambda: spark.readStream.schema("digest string, doc long, file string, row long").parquet(src)
    assert {r.digest: r.n for r in digest_state(spark, stream(), ck).collect()} == {"a": 1, "b": 1}
    slim([("a", 9, "g", 0)]).write.mode("append").parquet(src)
    assert {r.digest: (r.n, r.keep.doc) for r in digest_state(spark, stream(), ck).collect()} == {"a": (2, 9), "b": (1, 2)}


def test_names_of_columns_do_not_clash(spark, tmp_path):
    names = ["digest", "_n", "_keep", "_at", "file", "row", "_id", "_same", "_times", "_copy", "_score", "id", "doc", "y", "size", "key", "same", "n", "template", "label", "hi", "lo", "component_id", "node", "piece", "start", "length", "c0", "c1", "Digest2"]
    rows = [(1, "a b c d e f", "en", "s", 1), (2, "a b c d e f", "en", None, 1), (None, None, None, None, None), (4, "g h", "fr", "s", 1)]
    df = spark.createDataFrame([(*r, *("x" for _ in names)) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names))
    df.write.parquet(str(tmp_path / "clash"))
    docs = spark.read.parquet(str(tmp_path / "clash"))
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    kept = exact_dedup(spark, docs)
    assert kept.columns[: len(docs.columns)] == docs.columns and {r.keep_id for r in kept.where("doc_id < 3").collect()} == {2} and {r.digest for r in kept.collect()} == {"x"}
    assert quality.score(docs, quality.train(docs, labels)).count() == 4
    assert mixing.mix(docs).count() == licenses.license_scan(docs).count() == sharding.shard(docs, 2).count() == jaccard.jaccard_groups(docs).count() == 4
    assert packing.pack(packing.tokenize_pieces(docs, public_tokenizers.path("word_bpe_49k.json"))).count() == 4


# 2 url filter
def test_url_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "no scheme"), (4, "http://"), (5, "HTTP://EXAMPLE.org/ES/"), (6, "x://a.example.org?q=/es/"), (7, "http://example.org/es/#a://b"), (7, "http://example.org/es/#a://b"), (None, "http://notorg/fr/")]
    got = urls.filter_urls(spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, verdict string")).collect()
    assert sorted((str(r.page_id), r.host, r.path, str(r.rule)) for r in got) == sorted([
        ("1", "", "", "None"), ("2", "", "", "None"), ("3", "", "", "None"), ("4", "", "", "None"), ("5", "example.org", "/ES/", "org/"), ("6", "a.example.org", "", "None"),
        ("7", "example.org", "/es/", "example.org/es/"), ("7", "example.org", "/es/", "example.org/es/"), ("None", "notorg", "/fr/", "None")])
    assert urls.filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_url_templates_learn_bad_branches(spark):
    rows = [(k, f"http://shop.test/{'junk' if k % 2 else 'good'}/{k}") for k in range(200)]
    labels = spark.createDataFrame([(k, bool(k % 2)) for k in range(0, 150)], "page_id long, bad boolean")
    got = urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), rules=(), labels=labels).collect()
    assert all((r.verdict == "block") == bool(r.page_id % 2) for r in got) and all("{n}" in r.template for r in got)


def test_url_rare_bad_section_is_a_branch_of_its_own(spark):
    # 3000 pages: 1.5 % bad and labelled, many clean sections without labels, each below the share of a branch.
    path = lambda k: f"en/{k}" if k < 1800 else f"fr/{k}" if k < 2600 else f"de/{k}" if k < 2645 else f"part{'abcdefghijklmnopqrst'[k % 20]}/{k}".replace("part", "sec")
    rows = [(k, f"http://hot.test/{path(k)}") for k in range(3000)]
    labels = spark.createDataFrame([(k, k >= 2600) for k in range(1800, 2645)], "page_id long, bad boolean")
    got = urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), rules=(), labels=labels).collect()
    assert len(got) == 3000
    assert all((r.verdict == "block") == (2600 <= r.page_id < 2645) for r in got)


def test_url_tree_equals_plain_code(spark):
    rng = random.Random(9)
    words = ["a", "b", "$", "{n}", "{a|b}", "en", "\\x", "junk", "17", "deadbeef00", "x1", "a"]
    rows = []
    for _ in range(1500):
        host = rng.choice(["h.test", "h.test", "h.test", "k.test", ""])
        path = "".join("/" + rng.choice(words[: rng.choice([3, 6, len(words)])]) for _ in range(rng.choice([0, 1, 2, 3, 9, 12]))) + rng.choice(["", "/"])
        rows.append((host, path, None if rng.random() < 0.4 else rng.random() < (0.9 if "junk" in path or "/$" in path else 0.1)))
    df = spark.createDataFrame([(k, *r, "x") for k, r in enumerate(rows)], "k long, host string, path string, bad boolean, template string").drop("template")
    placed, tree = urls.template_tree(df)
    got = {r.k: (r.template, r.purity) for r in placed.join(tree.select("node", "template"), "node").collect()}
    want = url_tree(rows, urls.SHARE, urls.SUPPORT, urls.PRIOR, urls.MERGE_Z, urls.NAMES)
    assert len(got) == len(rows)
    for k, (template, purity) in enumerate(want):
        assert got[k][0] == template and got[k][1] == pytest.approx(purity), (rows[k], got[k], want[k])


@pytest.mark.parametrize("good, bad", [("archive", "spam"), ("2023-archive", "2024-spam"), ("1", "2")])
def test_sections_separate_whatever_their_form(spark, good, bad):
    rows = [(k, f"http://h.test/{good if k % 2 else bad}/{k}") for k in range(800)]
    labels = spark.createDataFrame([(k, k % 2 == 0) for k in range(600)], "page_id long, bad boolean")
    got = urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), rules=(), labels=labels).collect()
    assert {(r.page_id % 2, r.verdict) for r in got} == {(0, "block"), (1, "allow")}


def test_url_deep_segments_are_told_apart(spark):
    page = spark.createDataFrame([(k, f"http://h.test/a/b/c/d/e/f/g/{'junk' if k % 2 else 'good'}") for k in range(400)] + [(400 + k, f"http://e.test/x/{'$' if k % 2 else ''}") for k in range(200)], "page_id long, url string")
    labels = spark.range(600).select(F.col("id").alias("page_id"), (F.col("id") % 2 == 1).alias("bad"))
    got = urls.filter_urls(page, rules=(), labels=labels).collect()
    assert len(got) == 600 and all((r.verdict == "block") == bool(r.page_id % 2) for r in got)


# 3 nearest neighbours
def test_search_equals_brute_force_on_odd_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(k, [float(np.float32(v)) for v in rng.normal(size=4)]) for k in range(60)] + [(60 + k, [1.0, 0.0, 0.0, 0.0]) for k in range(40)]
    bad = [(200, None), (220, []), (240, [0.0] * 4), (260, [1.0, None, 0.0, 0.0]), (280, [1.0, float("nan"), 0.0, 0.0]), (300, [float("inf")] * 4), (320, [1.0, 2.0]), (None, [1.0] * 4)]
    df = spark.createDataFrame([(*r, 1) for r in [*rows, *bad, rows[0]]], "vec_id long, embedding array<double>, score int")
    got = {}
    for r in ann.search(df, F.col("vec_id") % 20 == 0, k=5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    x = np.array([v for _, v in rows])
    for q in (0, 20, 40, 60, 80):
        s = [(-(x[q] @ x[j]), j) for j in range(100) if j != q]
        assert [j for _, j in sorted(got[q])] == [j for _, j in sorted(s)[:5]]
    assert set(got) == {0, 20, 40, 60, 80}
    assert ann.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_lists_in_blocks_and_graph(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 16))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.search(df, F.col("vec_id") % 100 == 0, k=10, plan=ann.Plan(list_size=60, block=50)).toPandas()
    hit = [len(set(o["vec_id"]) & set([j for j in np.argsort(-(x @ x[q])) if j != q][:10])) / 10 for q, o in got.groupby("query_id")]
    assert len(hit) == 30 and np.mean(hit) >= 0.9


def test_search_is_whole_beyond_the_first_lists(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(4000, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.search(df, F.col("vec_id") % 100 == 0, k=10, plan=ann.Plan(list_size=16, unit=500)).toPandas()  # 250 lists, 48 read at first
    for q, own in got.groupby("query_id"):
        assert list(own.sort_values("rank")["vec_id"]) == [j for j in np.argsort(-(x @ x[q]), kind="stable") if j != q][:10]
    assert got["query_id"].nunique() == 40


def test_search_fills_up_beyond_a_tight_cluster(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(40, 8))
    x = np.repeat(centres / np.linalg.norm(centres, axis=1)[:, None], 8, 0) + rng.normal(size=(320, 8)) * 1e-4
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.search(df, F.col("vec_id") % 20 == 0, plan=ann.Plan(list_size=8)).toPandas()
    assert len(got) == 16 * 20
    for q, own in got.groupby("query_id"):
        assert list(own.sort_values("rank")["vec_id"]) == [j for j in np.argsort(-(x @ x[q]), kind="stable") if j != q][:20]


@pytest.mark.parametrize("size", [1e200, 1e-200, 3e5])
def test_search_of_very_large_and_small_vectors(spark, size):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 6))
    df = spark.createDataFrame([(k, (v * size).tolist(), "x") for k, v in enumerate(x)], "vec_id long, embedding array<double>, key string")
    got = ann.search(df, F.col("vec_id") % 20 == 0, k=5, plan=ann.Plan(list_size=20, block=7)).toPandas()
    for q, own in got.groupby("query_id"):
        own = own.sort_values("rank")
        assert list(own["vec_id"]) == [j for j in np.argsort(-(x @ x[q]), kind="stable") if j != q][:5]
        if size == 3e5:
            assert np.allclose(own["score"], (x * size)[own["vec_id"]] @ (x[q] * size))


def test_centroids_in_two_levels_are_balanced():
    x = np.random.default_rng(9).normal(size=(9000, 8))
    points = ann.balanced_kmeans(x, 900)
    assert 800 <= len(points) <= 1000
    assert np.bincount(ann._own(x, points, np.zeros(len(points))), minlength=len(points)).max() < 80


# 4 packing
def _best_fit(sizes, limit):
    """Sequences of best fit of single pieces, largest first, as a yardstick."""
    gaps = []
    for s in sorted(sizes, reverse=True):
        fit = min((g for g in gaps if g >= s), default=None)
        gaps.remove(fit) if fit is not None else None
        gaps.append((fit if fit is not None else limit) - s)
    return len(gaps)


@pytest.mark.parametrize(("limit", "most", "rows", "bucket"), [(64, 64, 100_000, 65_536), (2048, 900, 100_000, 65_536), (2048, 900, 150, 4_096), (7, 7, 40, 16)])
def test_packing_rounds(spark, monkeypatch, limit, most, rows, bucket):
    monkeypatch.setattr(packing, "RANGE_ROWS", rows)
    monkeypatch.setattr(packing, "BUCKET_TOKENS", bucket)
    rng = random.Random(limit + rows)
    sizes = [rng.randint(1, rng.choice([most, most // 4])) for _ in range(600)]
    df = spark.createDataFrame([(k // 3, 0, 0, x, "x") for k, x in enumerate(sizes)], "doc long, piece long, start long, length long, seq string")
    got = packing.pack(df, limit).toPandas().sort_values(["sequence_id", "offset"])
    assert sorted(got["length"]) == sorted(sizes) and set(got["seq"]) == {"x"}
    assert (got.groupby("sequence_id")["length"].cumsum() - got["length"] == got["offset"]).all() and got.groupby("sequence_id")["length"].sum().max() <= limit
    assert got["sequence_id"].nunique() <= 1.02 * _best_fit(sizes, limit) + 1


def test_sweep_of_ranges_is_that_of_one_list():
    rng = random.Random(1)
    for _ in range(200):
        items = sorted(((rng.random() < 0.6, k, rng.randint(1, 9)) for k in range(rng.randint(0, 40))), key=lambda x: (-x[2], x[0], x[1]))
        cuts = sorted(rng.randint(0, len(items)) for _ in range(rng.randint(0, 4)))
        rows = [r for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(items)])) for r in packing._sweep_range(k, iter(items[a:b]))]
        for part, first, last, source, top in packing.stack_of_ranges([(r[0], r[5], r[6]) for r in rows if r[1] == packing.SUMS]):
            assert source < part and first < last and top - (last - first) >= 0
        room = {r[2]: r[3] for r in rows if r[1] == packing.GAP}
        for r in rows:
            if r[1] == packing.PLACED:
                room[r[4]] -= r[3]
        assert all(x >= 0 for x in room.values())
        left = [r for r in rows if r[1] == packing.LEFT]
        assert sum(r[6] - r[5] for r in left) == sum(room.values()) and all(r[6] - r[5] == room[r[4]] for r in left)


def test_packing_odd_rows(spark, odd):
    pieces = packing.tokenize_pieces(odd(), public_tokenizers.path("word_bpe_49k.json"), limit=64)
    got = packing.pack(pieces, 64)
    seqs = packing.sequences(got).collect()
    assert all(len(s.input_ids) <= 64 for s in seqs) and sum(len(s.input_ids) for s in seqs) == got.agg(F.sum("length")).first()[0]
    assert got.where("doc = 4").count() == 1 and got.where("doc is null").count() == 1
    assert packing.pack(packing.tokenize_pieces(odd([], False), public_tokenizers.path("word_bpe_49k.json")), 64).count() == 0


def test_words_equal_whole_texts():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain, ours, rng = Tokenizer.from_file(path), packing.WordTokenizer(path), random.Random(2)
    letters = list("abXYZİéÉ ' '.!,-|<>019\n\tΣ»́ßIJ")
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    for batch in (texts, [t for t in texts if "<|" not in t], ["a<|endoftext|>b", None, "", "don't!'s", "İ.", "İ"]):
        ids, at = ours.texts(pa.array(batch, pa.string()), 0)
        for k, t in enumerate(batch):
            assert ids[at[k] : at[k + 1]].tolist() == [*plain.encode(t or "", add_special_tokens=False).ids, 0]


# 5 mixing
def test_mixing_odd_rows(spark, odd):
    got = mixing.mix(odd()).collect()
    assert len(got) == 14
    assert {r.doc_id: r.size for r in got if r.doc_id == 3} == {3: 0} and all(r.taken <= 2 * r.size for r in got)
    for s in {r.source for r in got}:
        own = [r for r in got if r.source == s]
        assert sum(r.size for r in own) == own[0].source_size
    assert mixing.mix(odd([], False)).count() == 0


def test_mixing_prefers_good_documents(spark):
    rows = [(k, "w " * 10, "a" if k < 1000 else "b", 1) for k in range(1400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, x int")
    weight = spark.range(1400).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, 1.0).otherwise(0.2).alias("quality_weight"))
    got = mixing.mix(df, quality=weight, weights=(1, 1), share=0.5).where("source = 'a' and taken > 0").toPandas()
    assert (got["doc_id"] % 2 == 0).mean() > 0.65


# 6 chat
def test_chat_odd_rows(spark):
    texts = ["</s>[INST] ok [/INST]", "\\</s>", "\\\\[INST]\\", "", None, "a\n[/INST]</s>\n<s>[INST]user\nb", "end\\", "<s", "\n"]
    rows = [(1, k, r, t, 5) for k, (t, r) in enumerate(zip(texts, ["user", "assistant", None, "sy stem\n", "=x", "assistant", "[INST]", "assistant", "a\\b"]))]
    rows += [(2, None, "user", "x", 5), (2, None, "user", "x", 5), (None, 1, "assistant", "y", 5)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, loss int")
    got = {r.conv_id: r for r in chat.format_chat(df).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [(r[2] or "", r[3] or "") for r in rows[:9]]
    assert "".join(c.text for c in got[1].chunks) == got[1].text and got[2].n_turns == 2 and got[None].n_turns == 1
    learnt = [c.text for c in got[1].chunks if c.loss]
    spans = sorted((r.start, r.length) for r in chat.loss_spans(chat.format_chat(df.where("conv_id = 1"))).collect())
    assert [got[1].text[a : a + n] for a, n in spans] == learnt
    assert chat.format_chat(df.limit(0)).count() == 0


def test_chat_roles_that_end_in_a_line_and_a_template_that_lacks_escapes(spark, monkeypatch):
    rows = [(1, 0, "user\n", "a", 1, 1), (1, 1, "assistant", "b [INST]\n[/INST]</s>", 1, 1), (1, 2, "~x", "c", 1, 1), (1, 3, "assistant", "%41+", 1, 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, source int, turns int")
    plain = chat.format_chat(df).first()
    monkeypatch.setattr(chat, "escape", lambda text: text)  # then conflicts are found by parsing again, and are URL encoded
    coded = chat.format_chat(df).first()
    for r in (plain, coded):
        assert [(t.role, t.text) for t in r.turns] == [(x[2], x[3]) for x in rows]
        assert "".join(c.text for c in r.chunks) == r.text and [t.loss for t in r.turns] == [False, True, False, True]
    assert "<s>[INST]~assistant" in coded.text and "~" not in plain.text


# 7 sharding
class Held(sharding.Boundaries):
    def __init__(self, sizes, every):
        self.points, total = [], 0
        for k, s in enumerate(sizes, 1):
            total += s
            self.points.append((total, k))
        self.total = total
        self._hold([(0, 0), *(p for p in self.points if p[1] % every == 0), self.points[-1]])

    def fetch(self, spans):
        new = [p for a, b in spans for p in self.points if a <= p[0] <= b or True]
        self._hold([*zip(self.known, self.rank), *new])
        return True


def test_smallest_capacity_equals_brute_force():
    rng = random.Random(3)
    for _ in range(200):
        sizes, k = [rng.randint(1, rng.choice([5, 50])) for _ in range(rng.randint(1, 50))], rng.randint(1, 9)

        def need(c):
            n, now = 1, 0
            for s in sizes:
                n, now = (n + 1, s) if now + s > c else (n, now + s)
            return n

        edges = Held(sizes, rng.choice([1, 3, 10]))
        c = sharding.smallest_capacity(edges, k, max(sizes))
        assert c >= max(sizes) and need(c) <= k and (c == max(sizes) or need(c - 1) > k)
        cuts = [0, *sharding.even_cuts(edges, c, k), edges.total]
        assert all(0 <= b - a <= c for a, b in zip(cuts, cuts[1:]))


def test_sharding_odd_rows(spark, odd):
    got = sharding.shard(odd(), 4).toPandas()
    assert len(got) == 14 and all(sorted(s["slot"]) == list(range(len(s))) for _, s in got.groupby("shard"))
    assert got.groupby("digest")["shard"].nunique().max() == 1
    assert sharding.shard(odd([], False), 4).count() == 0


def test_sketch_is_refined(spark, odd, monkeypatch):
    monkeypatch.setattr(sharding, "SKETCH", 4)
    monkeypatch.setattr(sharding, "FETCH", 5)
    rows = [(k, "x" * (k * 37 % 101), "en", "s", 1) for k in range(300)]
    got = sharding.shard(odd(rows, False), 7).toPandas().groupby("shard")["size"].sum()
    assert len(got) == 7 and got.max() - got.min() < 1500


# 8 Jaccard join
def test_jaccard_goes_by_pivots_and_regions_whatever_the_size(spark, odd, monkeypatch):
    calls = []
    plain = jaccard._assign
    monkeypatch.setattr(jaccard, "_assign", lambda regions, similarity, weights: calls.append(weights.count()) or plain(regions, similarity, weights))
    text = " ".join(f"w{k}" for k in range(80))
    far = lambda k: " ".join(f"w{(j + k) if j % 9 else j * k}" for j in range(80))
    rows = [(k, f"{text} x{k}" if k < 20 else far(k), "en", "s", 1) for k in range(40)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_groups(odd(rows, False)).collect()}
    assert got == components({r[0]: r[1] for r in rows}, 3, 9, 10) and calls and calls[0] >= 1


@pytest.mark.parametrize("region", [2_000_000, 40, 900])
@pytest.mark.parametrize(("k", "t"), [(3, Fraction(9, 10)), (2, Fraction(1, 2))])
def test_jaccard_equals_all_pairs(spark, odd, monkeypatch, region, k, t):
    monkeypatch.setattr(jaccard, "REGION_SHINGLES", region)
    monkeypatch.setattr(jaccard, "PIVOTS", 3)
    rng = random.Random(4)
    base = [rng.choice("abcdefghij") + str(rng.randint(0, 40)) for _ in range(60)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(60)] = "new" + str(rng.randint(0, 9))
        rows.append((100 + i, " ".join(w[: rng.choice([60, 60, 58, 30, 2])]), "en", "s", 1))
    rows += [r for r in __import__("conftest_rows").ROWS if r[0] is not None]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_groups(odd(rows, False), width=k, similarity=t).collect()}
    assert got == components({r[0]: r[1] for r in rows}, k, t.numerator, t.denominator)


def test_jaccard_families_joined_by_common_lines_fall_apart(spark, odd, monkeypatch):
    monkeypatch.setattr(jaccard, "REGION_SHINGLES", 4000)
    replicated, plain = [], jaccard._blocks
    monkeypatch.setattr(jaccard, "_blocks", lambda regions, weights: replicated.append(regions.count()) or plain(regions, weights))
    line, rows = " ".join(f"line{j}" for j in range(40)), []
    for i in range(60):  # pairs of near copies, and a common line in each
        words = [f"own{i}x{j}" for j in range(60)]
        rows += [(2 * i + k, " ".join(words[: 60 - k]) + f" {line}", "en", "s", 1) for k in range(2)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_groups(odd(rows, False), width=5, similarity=Fraction(4, 5)).collect()}
    assert got == components({r[0]: r[1] for r in rows}, 5, 4, 5) and not sum(replicated)


def test_jaccard_shuffles_parts_by_shares(spark, odd, monkeypatch):
    shares, plain = [], jaccard.write_to
    monkeypatch.setattr(jaccard, "write_to", lambda df, path: (shares.append(path) if path.endswith("/met") else None, plain(df, path))[1])
    rows = [(k, " ".join(f"w{j * (1 + (k // 2) % 5)}" for j in range(60)) + f" x{k}", "en", "s", 1) for k in range(20)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_groups(odd(rows, False)).collect()}
    assert got == components({r[0]: r[1] for r in rows}, 3, 9, 10) and len(shares) == jaccard.SHARES > 1


def test_jaccard_odd_rows(spark, odd):
    got = jaccard.jaccard_groups(odd()).collect()
    assert len(got) == 14
    assert {r.component_id for r in got if r.doc_id in (1, 2)} == {1} and {r.component_id for r in got if r.doc_id is None} == {None}
    assert {(r.n_shingles, r.component_id) for r in got if r.doc_id in (3, 4, 5)} == {(0, 3), (0, 4), (0, 5)}
    assert jaccard.jaccard_groups(odd([], False)).count() == 0


def test_linked_sets_share_a_signature():
    rng = np.random.default_rng(5)
    for t in (Fraction(9, 10), Fraction(4, 5)):
        cut = jaccard.Parts(t)
        for _ in range(400):
            n = int(rng.integers(1, 300))
            a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            b = a[rng.random(len(a)) > rng.choice([0.02, 0.05, 0.09])]
            b = np.unique(np.concatenate([b, rng.integers(0, 2**63, int(rng.integers(0, 1 + n // 20))).astype(np.uint64)]))
            common = len(np.intersect1d(a, b))
            if len(b) and t.denominator * common >= t.numerator * (len(a) + len(b) - common):
                ours, theirs = ({g: (need, set(h)) for g, need, h in cut.signatures(x)} for x in (a, b))
                both = [g for g in set(ours) & set(theirs) if len(ours[g][1] & theirs[g][1]) >= max(ours[g][0], theirs[g][0])]
                assert both, (len(a), len(b), common)


# 9 licenses
def test_license_odd_rows(spark, odd):
    rows = [(1, "All rights reserved all RIGHTS reserved", "en", "s", 1), (1, "cc-by", "en", "s", 1), (2, None, "en", "s", 1), (3, "", "en", "s", 1), (None, "GNU General  Public\nLicense", "en", "s", 1),
            (4, "Permission is hereby granted free of charge, to any person who is obtaining a copy of this software and associated documentation files", "en", "s", 1)]
    got = sorted((str(r.doc_id), r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) for r in licenses.license_scan(odd(rows)).collect())
    assert got == sorted([("1", 6, 2, 0, 3, "reserved", "reserved")] * 2 + [("1", 2, 1, 0, 0, "cc-by", "cc-by")] + [("2", 0, 0, None, None, "", "")] * 2 + [("3", 0, 0, None, None, "", ""), ("None", 4, 1, 1, 1, "gpl", "gpl"), ("4", 22, 0, None, None, "", "mit")])
    assert licenses.license_scan(odd([], False)).count() == 0


def test_licenses_equal_plain_code(spark):
    rng = random.Random(7)
    templates = (*licenses.TEMPLATES, ("a b a b c a b", "loop"), (" ".join(f"w{k % 83}" for k in range(200)), "long"))
    texts = []
    for _ in range(150):
        w = []
        for _ in range(rng.randint(0, 4)):
            t = rng.choice([*templates, *licenses.BASE])[0].split()
            for _ in range(rng.randint(0, max(1, len(t) // 8))):
                k = rng.randrange(len(t))
                t[k : k + rng.randint(0, 1)] = rng.choice([[], ["x"], ["a"]])
            w += ["z"] * rng.randint(0, 3) + t
        texts.append(rng.choice([" ", ", ", "\n"]).join(w))
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate([*texts, None, ""])], "doc_id long, text string, label string, template int")
    got = {r.doc_id: r for r in licenses.license_scan(df, templates=templates).collect()}
    for k, t in enumerate([*texts, None, ""]):
        n, n_base, first, last, base = plain_licenses(t)
        labels, best = license_spans(t, templates, licenses.COVER, licenses.DRIFT)
        r = got[k]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (n, n_base, first, last, base)
        assert r.labels == ",".join(sorted(labels | set(base.split(",")) - {""})) and r.score == pytest.approx(max(best, 1.0 if n_base else 0.0))
    assert any("long" in r.labels for r in got.values()) and any("mit-full" in r.labels for r in got.values())


# 10 quality
def test_gradients_equal_differences():
    rng = np.random.default_rng(6)
    x, first, y = rng.normal(size=(9, quality.FEATURES)), np.array([0, 2, 5]), np.array([1.0, 0.0, 1.0])
    w = {"W": rng.normal(size=(quality.FEATURES, 4)) / 5, "b": rng.normal(size=4), "V": rng.normal(size=(4, 3)), "U": rng.normal(size=(4, 3)), "w": rng.normal(size=3), "o": rng.normal(size=4), "c": rng.normal(size=1)}
    loss = lambda: -np.mean(y * np.log(quality._forward(w, x, first)["score"]) + (1 - y) * np.log(1 - quality._forward(w, x, first)["score"]))
    g = quality._gradients(w, x, first, y, quality._forward(w, x, first))
    for k in w:
        at = tuple(rng.integers(0, s) for s in w[k].shape)
        w[k][at] += 1e-5
        up = loss()
        w[k][at] -= 2e-5
        down = loss()
        w[k][at] += 1e-5
        assert g[k][at] == pytest.approx((up - down) / 2e-5, abs=1e-6)


def test_quality_odd_rows(spark, odd, monkeypatch):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, 1, 0), (None, 1, 0), (6, 7, 0), (9, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(odd(), labels)
    got = quality.score(odd(), model).collect()
    assert len(got) == 14 and all(0 <= r.score <= 1 for r in got)
    monkeypatch.setattr(quality, "TRAIN_PASSAGES", 20)  # the long texts are passed over, the others still count
    docs = odd()
    assert len({r.score for r in quality.score(docs, quality.train(docs, labels.unionByName(spark.range(1, 12).selectExpr("id as doc_id", "int(id % 2) as quality", "0 as toxic")))).collect()}) > 1
    nothing = quality.train(odd(), labels.limit(0))
    assert {r.score for r in quality.score(odd(), nothing).collect()} == {0.5}
    assert quality.score(odd([], False), nothing).count() == 0


def test_word_count_is_of_ascii_blanks(spark):
    t = "a\u00a0b c\td\x1ce \n"
    assert spark.createDataFrame([(t,)], "t string").select(mixing.word_count(F.col("t"))).first()[0] == len(words_ws(t))


def test_all_links_pass_voronoi_regions(spark, monkeypatch):
    from terrace.llm import queries

    seen, plain = [], jaccard._assign

    def assign(regions, similarity, weights):
        seen.append(plain(regions, similarity, weights))
        return seen[-1]

    monkeypatch.setattr(jaccard, "_assign", assign)
    sf = "/root/testdata/sf0.01"
    got = queries.op8_jaccard_regions(spark, sf).collect()
    passed = {r.doc for df in seen for r in df.select("doc").distinct().collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    # Of equal sets one goes on: all texts of a component that differ by more than their sets' copies must have met a pivot.
    groups = {}
    for r in got:
        words = "".join(c.lower() if c.isascii() else c for c in texts[r.doc_id] or "").split()
        groups.setdefault(r.component_id, {}).setdefault(frozenset(zip(words, words[1:], words[2:])), []).append(r.doc_id)
    linked = [g for g in groups.values() if len(g) > 1]
    assert linked
    for g in linked:
        for ids in g.values():
            assert passed & set(ids)


@pytest.mark.parametrize("most", [200_000, 5])
def test_licenses_by_any_join_and_label(spark, odd, monkeypatch, most):
    monkeypatch.setattr(licenses, "BROADCAST_PAIRS", most)
    rows = [(1, "this is released under my own terms, all rights reserved", "en", "s", 1), (2, None, "en", "s", 1), (3, "released under my own", "en", "s", 1)]
    got = {r.doc_id: (r.n_words, r.n_base, r.labels) for r in licenses.license_scan(odd(rows, False), templates=(("released under my own terms", "author's \\ own"),)).collect()}
    assert got == {1: (10, 1, "author's \\ own,reserved"), 2: (0, 0, ""), 3: (4, 0, "")}


@pytest.mark.parametrize("clusters", [0, 40])
def test_lists_are_read_by_a_sampled_recall(spark, monkeypatch, clusters):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 16)) if not clusters else rng.normal(size=(clusters, 16))[rng.integers(0, clusters, 3000)] * 4 + rng.normal(size=(3000, 16)) * 0.3
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    told, plain = [], ann.lists_needed
    monkeypatch.setattr(ann, "lists_needed", lambda classes, posted, points, *rest: told.append((plain(classes, posted, points, *rest), len(points))) or told[-1][0])
    got = ann.search(df, F.col("vec_id") % 20 == 0, plan=ann.Plan(list_size=60, probe=2, recall=0.95)).toPandas()
    hits = []
    for q, own in got.groupby("query_id"):
        s = x @ x[q]
        s[q] = -np.inf
        hits.append(len(set(own["vec_id"]) & set(np.argsort(-s, kind="stable")[:20])) / 20)
        assert list(own.sort_values("rank")["rank"]) == list(range(1, 21))
    assert len(hits) == 150 and np.mean(hits) >= 0.9
    needed, lists = told[0]
    assert needed < lists and (not clusters or needed <= 0.3 * lists)
    assert ann.search(df.limit(1), F.lit(True), plan=ann.Plan(recall=0.9)).count() == 0
