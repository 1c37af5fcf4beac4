"""The queries op1_ to op13_ and pipeline, each over its whole table, with DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrace.llm.dedup import exact_dedup

    path = f"{sf_dir}/documents.parquet"
    return exact_dedup(spark, spark.read.parquet(path), path=path).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP1_SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
"""

def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrace.llm.urls import filter_urls

    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "host", "path", "rule", "verdict", "template", "purity")


def op3_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrace.llm.ann import search

    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from terrace.llm.packing import crc32, pack, tokenize_pieces

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pieces = tokenize_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), payload=("ids_crc32", "long", crc32))
    return pack(pieces).select(F.col("doc").alias("doc_id"), F.col("piece").cast("int").alias("piece"), "start", "length", "ids_crc32", "sequence_id", "offset")


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrace.llm.mixing import mix

    quality = label_weights(spark, sf_dir)
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"), quality=quality).select("doc_id", "size", "source_size", "target", "taken")


def label_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, quality_weight: 1 for documents labelled good, 0.25 for those labelled bad."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality is not null and doc_id is not null")
    return labels.groupBy("doc_id").agg(F.min(F.when(F.col("quality") == 1, 1.0).otherwise(0.25)).alias("quality_weight"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrace.llm.chat import format_chat

    more = spark.sql("SELECT -7L AS conv_id, t AS turn, r AS role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS x(t, r)")
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(more)
    done = format_chat(turns)
    learnt = F.array_join(F.transform(F.filter("turns", lambda x: x["loss"]), lambda x: x["text"]), "")
    lines = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return done.withColumn("_learnt", learnt).select(
        "conv_id", "n_turns", F.sha2(lines.cast("binary"), 256).alias("turns_sha256"), F.char_length("_learnt").cast("long").alias("loss_chars"),
        F.sha2(F.col("_learnt").cast("binary"), 256).alias("loss_sha256"), F.char_length("text").cast("long").alias("formatted_chars"),
    )


OP6_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(9 + length(role) + 1 + length(regexp_replace(text, '(\\*(?:</?s>|\[/?INST\]))', '\\\1', 'g')) + 12) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""


def op7_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrace.llm.sharding import shard

    done = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"), 24)
    return done.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_jaccard_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrace.llm.jaccard import jaccard_groups

    return jaccard_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w
), e AS (SELECT doc_id, unnest(s) AS g FROM s), n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
k AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, k.b FROM reach r JOIN k ON k.a = r.b)
SELECT n.doc_id, n.n AS n_shingles, min(b) AS component_id FROM n JOIN reach ON reach.a = n.doc_id GROUP BY 1, 2
"""


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrace.llm.licenses import license_scan

    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op10_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrace.llm.quality import held_out, score, train

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op11_heap_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from terrace.llm.tokencount import count_tokens

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json")).drop("text")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrace.llm.spelling import spelling_variants, word_counts

    words = word_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), thin=199)
    return spelling_variants(words)


# T, what four bits do to a CRC-32.
OP12_SQL = r"""
WITH RECURSIVE r AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents
), once AS (SELECT id, run, count(*) AS times, hex(encode(id || ':' || run)) AS x FROM r WHERE length(run) >= 6 GROUP BY id, run),
h AS (
  SELECT run, times, xor(4294967295, list_reduce(
    list_transform(range(1, CAST(length(x) / 2 + 1 AS BIGINT)), lambda i: CAST(16 * (instr('0123456789ABCDEF', substr(x, 2 * i - 1, 1)) - 1) + instr('0123456789ABCDEF', substr(x, 2 * i, 1)) - 1 AS BIGINT)),
    lambda c, b: xor(xor(xor(c, b) >> 4, t[(xor(c, b) & 15) + 1]) >> 4, t[(xor(xor(c, b) >> 4, t[(xor(c, b) & 15) + 1]) & 15) + 1]), CAST(4294967295 AS BIGINT))) AS h
  FROM once, (SELECT list_transform(['00000000', '1DB71064', '3B6E20C8', '26D930AC', '76DC4190', '6B6B51F4', '4DB26158', '5005713C', 'EDB88320', 'F00F9344', 'D6D6A3E8', 'CB61B38C', '9B64C2B0', '86D3D2D4', 'A00AE278', 'BDBDF21C'], lambda v: CAST('0x' || v AS BIGINT)) AS t)
), made AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, times FROM h),
w AS MATERIALIZED (SELECT word, CAST(sum(times) AS BIGINT) AS n FROM made WHERE length(word) >= 6 GROUP BY word HAVING sum(times) >= 5),
g AS MATERIALIZED (SELECT word, n, k, substr(word, 1, k) || substr(word, k + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS k FROM w)),
p AS (
  SELECT a.word, b.word AS other, b.n AS m FROM g a JOIN g b ON a.k = b.k AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT g.word, w.word, w.n FROM g JOIN w ON w.word = g.rest
  UNION SELECT w.word, g.word, g.n FROM g JOIN w ON w.word = g.rest
), s AS (SELECT word, count(*) AS n_near, max(m) AS m, arg_min(other, struct_pack(m := -m, w := other)) AS best FROM p GROUP BY word),
f AS MATERIALIZED (SELECT w.word, w.n, coalesce(s.n_near, 0) AS n_near, CASE WHEN s.m >= 5 * w.n THEN s.best END AS form, CASE WHEN s.m >= 5 * w.n THEN s.m END AS form_n FROM w LEFT JOIN s ON s.word = w.word),
e AS (SELECT word, form, word AS at FROM f UNION ALL SELECT e.word, f.form, f.word FROM e JOIN f ON f.word = e.form)
SELECT f.word, f.form, e.at AS root, f.n, f.n_near, f.form_n FROM f JOIN e ON e.word = f.word AND e.form IS NULL
"""


def op13_byte_automaton_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrace.llm.infill import fill_in_middle, restored

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return fill_in_middle(docs).select(
        "doc_id", "fim.n", "fim.form", "fim.prefix_chars", "fim.middle_chars",
        digest(F.col("fim.output")).alias("output_sha256"), digest(restored(F.col("fim.output"), F.col("fim.form"))).alias("restored_sha256"),
    )


OP13_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
h AS (SELECT *, CAST('0x' || substr(x, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(x, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(x, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(x, 25, 8) AS BIGINT) AS h4 FROM d),
c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || substr(t, 1, a) || '<S>' || substr(t, b + 1) || '<M>' || substr(t, a + 1, b - a)
              ELSE '<S>' || substr(t, b + 1) || '<P>' || substr(t, 1, a) || '<M>' || substr(t, a + 1, b - a) END) AS output_sha256, sha256(t) AS restored_sha256
FROM c
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Query] = {
    "op1_exact_dedup": op1_exact_dedup, "op2_url_filter": op2_url_filter, "op3_posting_lists": op3_posting_lists,
    "op4_best_fit_packing": op4_best_fit_packing, "op5_mix_sources": op5_mix_sources, "op6_chat_format": op6_chat_format,
    "op7_minimax_shards": op7_minimax_shards, "op8_jaccard_regions": op8_jaccard_regions, "op9_license_scan": op9_license_scan,
    "op10_quality_mil": op10_quality_mil, "op11_heap_token_counts": op11_heap_token_counts, "op12_spelling_variants": op12_spelling_variants,
    "op13_byte_automaton_infill": op13_byte_automaton_infill, "pipeline": pipeline,
}
ORACLES: dict[str, str] = {"op1_exact_dedup": OP1_SQL, "op6_chat_format": OP6_SQL, "op8_jaccard_regions": OP8_SQL, "op12_spelling_variants": OP12_SQL, "op13_byte_automaton_infill": OP13_SQL}
