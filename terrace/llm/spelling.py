"""Grouping of spelling variants without pairs: each word finds its near words through groups that share all but one code point.

Every word of the vocabulary gives a row for each of its places: the place and the word without its code point there (prefix and
suffix, joined). Words that differ by a replacement at a place meet in the group of (place, rest), which keeps its size and its
two most frequent words: for a member the best other one is one of the two. Words that differ by an insertion or a deletion meet
where the rest is itself a word: the vocabulary is dealt by the same key, so the group of a rest knows how many longer words lead
to it and the most frequent of them, and each longer word learns how frequent the rest is. A word has few places and a
group at most as many members as there are code points, so rows grow with the vocabulary and never with the square of a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrace.scratch import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Fixed value: runs of letters of the contract.
RUNS = "[A-Za-zÀ-ÿ]+"


def thinned(word: Column, doc_id: Column, rate: int) -> Column:
    """word without one code point if rate divides its hash with the document's id, else as it is. One of rate is changed."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), word).cast("binary"))
    at = (h % F.char_length(word)).cast("int")
    cut = F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.char_length(word)))
    return F.when(h % rate == 0, cut).otherwise(word)


def word_counts(docs: DataFrame, *, least_length: int = 6, least_count: int = 5, thin: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: lower-cased (A-Z only) runs of letters of all texts that are long and frequent enough. thin: see `thinned`; None changes nothing.

    Null and empty texts have none, texts of any length are read whole, repeated rows count again, a null id is an empty one.
    """
    runs = docs.select(F.col(id_col).alias("id"), F.explode(F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(RUNS), F.lit(0))).alias("run"))
    # A run that's too short stays so: what is cut away makes it shorter.
    low = runs.where(F.char_length("run") >= least_length).select("id", F.translate("run", UPPER, LOWER).alias("word"))
    words = low if thin is None else low.select(thinned(F.col("word"), F.col("id"), thin).alias("word")).where(F.char_length("word") >= least_length)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def near_words(words: DataFrame) -> DataFrame:
    """words: word, n, each word once. word, n_near, best: how many words differ from it by one code point inserted, deleted or replaced, and the most frequent (more, word).

    best.more is -n; ties go to the smallest word in code-point order. Words without near ones are left out, null words too.
    """
    words = words.where("word IS NOT NULL").select("word", F.col("n").cast("long").alias("n"))
    without = lambda k: F.concat(F.substring(F.col("word"), F.lit(1), k), F.substring(F.col("word"), k + 2, F.char_length("word")))
    places = F.sequence(F.lit(0), F.char_length("word") - 1)
    # Of equal neighbouring code points any gives the same rest: the first stands for them.
    each = F.transform(places, lambda k: F.struct(k.alias("place"), without(k).alias("rest"), ((k == 0) | (F.substring(F.col("word"), k + 1, F.lit(1)) != F.substring(F.col("word"), k, F.lit(1)))).alias("leads")))
    rows = words.where("word <> ''").select("word", "n", F.explode(each).alias("x")).select("word", "n", "x.place", "x.rest", "x.leads")
    own = words.select("word", "n", F.lit(-1).alias("place"), F.col("word").alias("rest"), F.lit(False).alias("leads"))
    member = F.struct((-F.col("n")).alias("more"), "word")
    by_rest, by_both = Window.partitionBy("rest"), Window.partitionBy("rest", "place").orderBy(F.desc("n"), "word")
    whole = by_both.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    met = rows.unionByName(own).repartition("rest").select(
        "word", "place", "rest", "leads", F.max(F.when(F.col("place") < 0, F.col("n"))).over(by_rest).alias("rest_n"),
        F.sum(F.col("leads").cast("long")).over(by_rest).alias("longer"), F.min(F.when(F.col("leads"), member)).over(by_rest).alias("longest"),
        F.count(F.lit(1)).over(whole).alias("size"), F.first(member).over(whole).alias("first"), F.nth_value(member, 2).over(whole).alias("second"),
    )
    shorter = F.col("leads") & F.col("rest_n").isNotNull()
    replaced = (F.col("place") >= 0) & (F.col("size") > 1)
    found = met.select(
        "word", F.when(F.col("place") < 0, F.col("longer")).otherwise(F.when(replaced, F.col("size") - 1).otherwise(0) + shorter.cast("long")).alias("near"),
        F.when(F.col("place") < 0, F.col("longest")).otherwise(
            F.least(F.when(replaced, F.when(F.col("first.word") == F.col("word"), F.col("second")).otherwise(F.col("first"))), F.when(shorter, F.struct((-F.col("rest_n")).alias("more"), F.col("rest").alias("word"))))
        ).alias("best"),
    )
    return found.where("near > 0").groupBy("word").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """forms: word, form, each word once and without circles. word, root: where following forms ends. Each round doubles how far a word looks."""
    ptr = materialize(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while not ptr.where("moved").isEmpty():
        far = ptr.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        ptr = materialize(ptr.join(far, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "roots")
    return ptr.select("word", "root")


def spelling_variants(words: DataFrame, ratio: int = 5) -> DataFrame:
    """words: word, n, each word once. word, n, n_near, form, form_n, root: a word's form is its most frequent near word, if that is at least ratio times as frequent.

    ratio is above 1, so that forms lead upwards and end. An empty table gives an empty one.
    """
    if ratio <= 1:
        raise ValueError("a form must be more frequent than its variants")
    words = materialize(words.where("word IS NOT NULL").select("word", F.col("n").cast("long").alias("n")), "words")
    better = -F.col("best.more") >= ratio * F.col("n")
    found = materialize(words.join(near_words(words), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(better, F.col("best.word")).alias("form"), F.when(better, -F.col("best.more")).alias("form_n"),
    ), "forms")
    ends = roots(found.where("form IS NOT NULL"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
