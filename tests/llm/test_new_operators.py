"""Token counts, spelling variants and fill-in-the-middle, against the library, brute force and plain code."""

import hashlib
import random
import zlib
from collections import Counter

import public_tokenizers
import pytest
from oracle import same
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from terrace.llm import infill, queries, spelling, tokencount

SF = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def _library(texts):
    t = Tokenizer.from_file(VOCABULARY)
    return [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]


# Token counts

def test_counts_equal_the_library(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = dict(zip([d.doc_id for d in docs], _library([d.text or "" for d in docs]), strict=True))
    got = queries.op11_heap_token_counts(spark, SF).collect()
    assert {r.doc_id: r.n_tokens for r in got} == want
    texts = {d.doc_id: d.text or "" for d in docs}
    assert all(r.n_bytes == len(texts[r.doc_id].encode()) and r.over_limit == (r.n_tokens > 1024) for r in got)


def test_merging_equals_the_library_on_any_text():
    rnd, counter = random.Random(5), tokencount.TokenCounter(VOCABULARY)
    parts = [*"abc  \n\t\r'sdtll19²½٣é世界!?<|>　\xa0\u0000͸", "<|endoftext|>", "don't", "'re", "the ", "ing", " \n", "😀", "\U00011f02", "꟎", "՘", "ा", "İ"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40))) for _ in range(4_000)] + ["", " ", "<|endoftext|>" * 3, "ab" * 20_000, "x" * 5_000, " " * 3_000]
    assert [counter.count(t) for t in texts] == _library(texts)


def test_counts_of_long_texts_and_a_full_memory(monkeypatch):
    monkeypatch.setattr(tokencount, "LISTED", 100)
    monkeypatch.setattr(tokencount, "CACHE_WORDS", 7)
    counter = tokencount.TokenCounter(VOCABULARY)
    text = " ".join(f"word{k % 50} é{k}" for k in range(400))
    assert counter.count(text) == _library([text])[0] and len(counter) <= 8 and len(counter.old) <= 8


def test_counts_take_odd_rows(spark, odd):
    docs = odd()
    done = tokencount.count_tokens(docs.withColumn("n_tokens", F.lit("old")), VOCABULARY)
    assert done.columns == [*docs.columns, "n_tokens", "n_bytes", "over_limit"]
    rows = done.collect()
    assert len(rows) == docs.count()
    want = _library([r.text or "" for r in rows])
    assert [r.n_tokens for r in rows] == want and [r.n_bytes for r in rows] == [len((r.text or "").encode()) for r in rows]
    assert tokencount.count_tokens(odd(rows=[], repeat=False), VOCABULARY, prefix="x_").count() == 0


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        tokencount.TokenCounter(public_tokenizers.path("word_bpe_49k.json"))


# Spelling variants

def _near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    s, t = sorted((a, b), key=len)
    return any(t[:k] + t[k + 1 :] == s for k in range(len(t)))


def _brute(words, ratio=5):
    near = {w: [v for v in words if _near(w, v)] for w in words}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None
    out = {}
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (words[w], len(near[w]), form[w], words.get(form[w]), root)
    return out


def _found(df):
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect()}


@pytest.mark.parametrize("alphabet, least", [("ab", 1), ("aé😀", 2), ("abcdefgh", 4)])
def test_variants_equal_all_pairs(spark, alphabet, least):
    rnd = random.Random(9)
    words = {"".join(rnd.choice(alphabet) for _ in range(rnd.randint(least, least + 3))): rnd.choice([1, 1, 2, 5, 25, 125]) for _ in range(250)}
    df = spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)
    assert _found(spelling.spelling_variants(df)) == _brute(words)


def test_variants_of_edges(spark):
    words = {"": 2, "a": 50, "aa": 3, "aaa": 1, "aaaa": 700, "b": 50, "ab": 1}
    df = spark.createDataFrame([*words.items(), (None, 4)], "word string, n int").withColumn("rest", F.lit("x"))
    assert _found(spelling.spelling_variants(df)) == _brute(words)
    assert spelling.spelling_variants(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        spelling.spelling_variants(df, ratio=1)
    chain = {"aaaaaa" + "b" * k: 5**k for k in range(12)}
    got = _found(spelling.spelling_variants(spark.createDataFrame(list(chain.items()), "word string, n long")))
    assert {r[4] for r in got.values()} == {"aaaaaa" + "b" * 11}


def test_words_of_odd_rows(spark, odd):
    import re

    docs = odd()
    want = Counter()
    for r in docs.collect():
        for run in re.findall("[A-Za-zÀ-ÿ]+", r.text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if r.doc_id is None else r.doc_id}:{run}".encode())
            want[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 3 == 0 else run] += 1
    want = {w: n for w, n in want.items() if len(w) >= 3 and n >= 2}
    got = {r.word: r.n for r in spelling.word_counts(docs, least_length=3, least_count=2, thin=3).collect()}
    assert got == want
    assert spelling.word_counts(odd(rows=[], repeat=False)).count() == 0


def test_variants_query_equals_sql(spark):
    same(queries.op12_spelling_variants(spark, SF), queries.OP12_SQL, SF)


# Fill-in-the-middle

def _rearranged(doc_id, text, plain=10, spm=20, marks=("<P>", "<S>", "<M>")):
    text, n = text or "", len(text or "")
    x = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(x[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, s, m = marks
    if not text or any(k in text for k in marks) or h[2] % 100 >= 100 - plain:
        return n, "plain", None, None, text
    if h[3] % 100 < spm:
        return n, "spm", a, b - a, f"{s}{text[b:]}{p}{text[:a]}{m}{text[a:b]}"
    return n, "psm", a, b - a, f"{p}{text[:a]}{s}{text[b:]}{m}{text[a:b]}"


@pytest.mark.parametrize("block", [3, 11, 1 << 18])
def test_infill_equals_plain_code(spark, monkeypatch, block):
    monkeypatch.setattr(infill, "BLOCK", block)
    rnd = random.Random(block)
    parts = ["<", "P", "S", "M", ">", "a", "é", "€", "😀", "<S", "<P>", "<M"]
    rows = [(k, "".join(rnd.choice(parts[: rnd.choice([10, 12])]) for _ in range(rnd.choice([0, 1, 2, 3, 8, 40])))) for k in range(400)]
    rows += [(None, "nobody's"), (7, None), (7, "<P"), (7, "<P"), (500, "x" * 1000), (501, "a<M>b")]
    import pyarrow as pa

    automaton = infill.Automaton(infill.SENTINELS)
    import numpy as np

    hashes = [hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest() for i, _ in rows]
    keys = [np.array([int(x[8 * k : 8 * k + 8], 16) for x in hashes]) for k in range(4)]
    got = infill._rearranged(automaton, [s.encode() for s in infill.SENTINELS], pa.array([t for _, t in rows]).slice(0), keys, 10, 20).to_pylist()
    assert [tuple(g.values()) for g in got] == [_rearranged(*r) for r in rows]


def test_infill_takes_odd_rows(spark, odd):
    docs = odd().withColumn("fim", F.lit(1)).withColumn("n", F.lit(2))
    done = infill.fill_in_middle(docs)
    assert done.columns == docs.columns
    rows = done.withColumn("back", infill.restored(F.col("fim.output"), F.col("fim.form"))).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert tuple(r.fim) == _rearranged(r.doc_id, r.text) and r.back == (r.text or "")
    assert infill.fill_in_middle(odd(rows=[], repeat=False)).count() == 0


def test_infill_with_other_marks(spark):
    marks = ("<|pre|>", "<|suf|>", "<|mid|>")
    rows = [(k, f"text {k} <|pre| <P> é<|suf" + ("|>" if k % 5 == 0 else "|")) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    done = infill.fill_in_middle(df, plain_percent=0, spm_percent=50, sentinels=marks)
    for r in done.withColumn("back", infill.restored(F.col("fim.output"), F.col("fim.form"), marks)).collect():
        assert tuple(r.fim) == _rearranged(r.doc_id, r.text, 0, 50, marks) and r.back == r.text
    with pytest.raises(ValueError):
        infill.Automaton(("<P>", "é", "<M>"))


def test_infill_query_equals_sql(spark):
    same(queries.op13_byte_automaton_infill(spark, SF), queries.OP13_SQL, SF)
