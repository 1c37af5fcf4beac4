"""License scan by diagonal voting, with DataFrame operations only.

Every pair of neighbouring words of a text is hashed, and all rolling hashes are joined with the pairs of all templates (broadcast
up to a number of rows, shuffled beyond it). A hit compares the words themselves and votes for a diagonal: its place
in the text less its place in the template. The votes of a diagonal are the set of its template places, of any length. A
diagonal with every vote is a place where the phrase stands; near diagonals (words put in or left out) are merged, and a
merged span counts if it covers enough of the template's words and isn't much longer than it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrace.scratch import materialize

# The phrases and labels of the contract.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

# Further templates by label, in lower case, words only; of any length.
TEMPLATES = (
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("you may not use this file except in compliance with the license", "apache-2.0"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("licensed under cc by nd 4 0", "cc-by-nd"),
    ("creative commons attribution 4 0 international", "cc-by"),
    ("licensed under the gnu general public license version 3", "gpl-3"),
    ("licensed under the gnu general public license version 2", "gpl-2"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that", "bsd"),
    ("subject to the terms of the mozilla public license v 2 0", "mpl-2.0"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("dedicated to the public domain", "public-domain"),
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software "
        "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense "
        "and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions "
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability "
        "fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or "
        "other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other "
        "dealings in the software",
        "mit-full",
    ),
)

BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Share of a template's words that a span must cover; words that may be put in or left out between neighbouring diagonals.
COVER, DRIFT = 0.9, 2
#: Pairs of templates (of some 100 bytes) that are broadcast at most.
BROADCAST_PAIRS = 200_000


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN), "")


def template_pairs(spark: SparkSession, templates: tuple[tuple[str, str], ...]) -> tuple[DataFrame, int]:
    """A row for each two neighbouring words of each template, and one without a template that stands for a document; how many rows there are."""
    rows: list[tuple] = [(-1, None, False, 0, 0, None, None)]
    for k, (phrase, label, base) in enumerate([(*x, True) for x in BASE] + [(*x, False) for x in templates]):
        words = phrase.split()
        assert len(words) >= 2 and all(w.isalnum() for w in words)
        rows += [(k, label, base, len(words), i, a, b) for i, (a, b) in enumerate(zip(words, words[1:], strict=False))]
    pairs = spark.createDataFrame(rows, "template int, label string, base boolean, length int, tpos int, w1 string, w2 string")
    return pairs.withColumn("gram", F.when(F.col("template") < 0, F.lit(0).cast("long")).otherwise(F.xxhash64("w1", "w2"))), len(rows)


def license_hits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """doc, same (a hash of the text), n_words, template, label, base, length, tpos, pos: a row for each pair of words that a template has; template -1: the document."""
    pairs, many = template_pairs(docs.sparkSession, templates)
    words = docs.select(F.col(id_col).alias("doc"), F.xxhash64(F.col(text_col)).alias("same"), words_of(F.col(text_col)).alias("words"))
    w, n = F.col("words"), F.size("words")
    pair = lambda a, b: F.struct(F.xxhash64(a, b).alias("gram"), a.alias("a"), b.alias("b"))
    rolling = F.zip_with(F.slice(w, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(w, F.lit(2), F.greatest(n - 1, F.lit(0))), pair)
    document = F.array(F.struct(F.lit(0).cast("long").alias("gram"), F.lit("").alias("a"), F.lit("").alias("b")))
    each = words.select("doc", "same", n.alias("n_words"), F.posexplode(F.concat(document, rolling)).alias("at", "pair")).select("doc", "same", "n_words", "at", "pair.*")
    hit = ((F.col("at") == 0) & (F.col("template") == -1)) | ((F.col("at") > 0) & (F.col("a") == F.col("w1")) & (F.col("b") == F.col("w2")))
    if many <= BROADCAST_PAIRS:
        found = each.join(F.broadcast(pairs), "gram").where(hit)
    else:  # documents, which all have one hash, meet their row by themselves
        documents = each.where(F.col("at") == 0).drop("gram").join(F.broadcast(pairs.where("template < 0").drop("gram")))
        found = each.where(F.col("at") > 0).join(pairs.where("template >= 0"), "gram").where(hit).drop("gram").unionByName(documents)
    return found.select("doc", "same", "n_words", "template", "label", "base", "length", "tpos", (F.col("at") - 1).alias("pos"))


def license_votes(hits: DataFrame) -> DataFrame:
    """doc, same, template, label, base, length, diagonal, votes: the set of template places that voted for each diagonal."""
    own = hits.where("template >= 0").withColumn("diagonal", F.col("pos") - F.col("tpos"))
    return own.groupBy("doc", "same", "template", "label", "base", "length", "diagonal").agg(F.collect_set("tpos").alias("votes"))


def license_spans(votes: DataFrame) -> DataFrame:
    """doc, same, label, base, first, last (words), cover: verified spans. Exact places of base phrases, merged spans of the others."""
    key = ["doc", "same", "template", "label", "length", "run"]
    base = votes.where("base and size(votes) = length - 1").select("doc", "same", "label", "base", F.col("diagonal").alias("first"), (F.col("diagonal") + F.col("length") - 1).alias("last"), F.lit(1.0).alias("cover"))
    line = Window.partitionBy("doc", "same", "template").orderBy("diagonal")
    run = votes.where("not base").withColumn("new", (F.col("diagonal") - F.lag("diagonal").over(line) > DRIFT).cast("int"))
    run = run.withColumn("run", F.sum(F.coalesce("new", F.lit(1))).over(line.rowsBetween(Window.unboundedPreceding, 0)))
    covered = F.explode(F.array_union("votes", F.transform("votes", lambda t: t + 1)))
    each = run.select(*key, (F.col("diagonal") + F.array_min("votes")).alias("first"), (F.col("diagonal") + F.array_max("votes") + 1).alias("last"), covered.alias("word"))
    words = each.groupBy(*key, "word").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    merged = words.groupBy(*key).agg(F.min("first").alias("first"), F.max("last").alias("last"), (F.count(F.lit(1)) / F.col("length")).alias("cover"))
    spans = merged.where((F.col("cover") >= COVER) & (F.expr("last - first + 1") <= F.col("length") * (2 - COVER) + DRIFT))
    return base.unionByName(spans.select("doc", "same", "label", F.lit(False).alias("base"), "first", "last", "cover"))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """A row for each row of docs: its id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    templates: words in lower case, and a label; two words at least. Null or empty text has no words, no labels and score 0; texts
    are read whole. Rows repeated with the same id and text each get a row, with the figures of one; rows with one id and other
    texts are told apart. Null ids are kept; an empty table gives an empty one. Other columns are not read.
    """
    hits = materialize(license_hits(docs, id_col, text_col, templates), "hits")
    spans = license_spans(license_votes(hits)).select("doc", "same", F.lit(0).alias("n_words"), F.lit(0).cast("long").alias("rows"), "label", "base", "first", "cover")
    anchors = hits.where("template < 0").select("doc", "same", "n_words", F.lit(1).cast("long").alias("rows"), F.lit(None).cast("string").alias("label"), F.lit(False).alias("base"), F.lit(None).cast("int").alias("first"), F.lit(0.0).alias("cover"))
    at = F.when(F.col("base"), F.col("first"))
    found = anchors.unionByName(spans).groupBy("doc", "same").agg(
        F.max("n_words").cast("long").alias("n_words"), F.count_if("base").alias("n_base"), F.min(at).cast("long").alias("first_word"), F.max(at).cast("long").alias("last_word"),
        _joined(F.col("base")).alias("base_labels"), _joined(F.lit(True)).alias("labels"), F.max("cover").alias("score"), F.sum("rows").alias("rows"),
    )
    return found.select(F.col("doc").alias(id_col), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", F.explode(F.sequence(F.lit(1).cast("long"), "rows")).alias("copy")).drop("copy")


def _joined(only: Column) -> Column:
    return F.array_join(F.array_sort(F.collect_set(F.when(only, F.col("label")))), ",")
