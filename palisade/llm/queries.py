"""Registered queries of the corpus operators, over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm import conversation_trie, embedding_forest, hamming_search, hard_negatives, lattice_lm, mixing, packing, secret_entropy, simhash, substring, token_counts, toxicity, warc

END_ID = 2


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text; rows without an id are in no fold."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Model:
    return toxicity.fit(docs, _table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 4) != 2)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    scored = toxicity.score_toxicity(docs, toxicity_model(spark, docs, sf_dir))
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "score", "predicted")


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_forest.dedup_embeddings(_table(spark, sf_dir, "embeddings"))


def op3_hamming_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes are the signs of the first 64 components, which is all that the given vectors have."""
    return hamming_search.search_codes(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.dedup_substrings(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_sequences(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), END_ID)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lattice_lm.score_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), fold(F.col("doc_id"), 5) != 1)
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id"), 5) == 1, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.dedup_simhash(_table(spark, sf_dir, "documents"))


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op11_secret_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_entropy.find_secrets(_table(spark, sf_dir, "documents"))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["known"])

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, secret_entropy.KNOWN), F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.conversation_trie(_table(spark, sf_dir, "conversations"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine_hard_negatives(vectors.withColumn("label", label), F.col("vec_id") % 100 == 0)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_toxicity, op2_embedding_dedup, op3_hamming_search, op4_substring_dedup, op5_best_fit_packing, op6_token_counts, op7_warc, op8_lattice_lm, op9_simhash_dedup, op10_source_mix, op11_secret_entropy, op12_conversation_trie, op13_hard_negatives, pipeline)
}

OP2_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e, list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]) AS q
  FROM embeddings WHERE label IS NOT NULL
),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE a.q > 0 AND b.q > 0 AND list_inner_product(a.e, b.e) / (sqrt(a.q) * sqrt(b.q)) >= 0.98
),
reached(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS b FROM reached GROUP BY a),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, least(vec_id, coalesce(least.b, vec_id)) AS component_id,
       vec_id = least(vec_id, coalesce(least.b, vec_id)) AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN least ON least.a = vec_id
"""

OP3_SQL = """
WITH c AS (
  SELECT vec_id, array_to_string(list_transform(embedding[1:64], lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '')::BIT AS code
  FROM embeddings
),
d AS (
  SELECT q.vec_id, o.vec_id AS neighbor_id, bit_count(xor(q.code, o.code))::INT AS distance
  FROM c q JOIN c o ON q.vec_id <> o.vec_id WHERE q.vec_id % 20 = 0
),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbor_id)::INT AS rank FROM d)
SELECT vec_id, rank, neighbor_id, distance FROM r WHERE rank <= 10
"""

OP4_SQL = """
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, s, hash(w[s : s + 49]) AS h, array_to_string(w[s : s + 1], ' ') AS head
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS s FROM t WHERE len(w) >= 50)
),
late AS (
  SELECT doc_id, s FROM (SELECT *, min(doc_id) OVER (PARTITION BY h, head) AS first FROM windows) WHERE first < doc_id
),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS p FROM late),
removed AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id),
kept AS (
  SELECT t.doc_id, len(w) AS n_words, coalesce(len(ps), 0) AS n_removed,
         CASE WHEN ps IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(ps, i)) END AS k
  FROM t LEFT JOIN removed USING (doc_id)
)
SELECT doc_id, n_words, n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM kept
"""

OP12_SQL = r"""
WITH c AS (
  SELECT conv_id, list(struct_pack(role := coalesce(role, ''), text := coalesce(text, '')) ORDER BY turn NULLS FIRST) AS t
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
),
h AS (
  SELECT conv_id, t, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)),
    lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))
  )) % 4 AS h
  FROM c
),
rebuilt AS (
  SELECT h.conv_id, list_concat(coalesce(c.t[1:h], []), h.t[h + 1:len(h.t)]) AS t
  FROM h LEFT JOIN c ON c.conv_id = h.conv_id - h.conv_id % 20
),
members AS (SELECT conv_id, len(t) AS turns, d, t[1:d] AS k FROM (SELECT conv_id, t, unnest(range(0, len(t) + 1)) AS d FROM rebuilt)),
nodes AS (
  SELECT d, k, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (turns = d), '')) AS ends_sha256
  FROM members GROUP BY d, k
),
children AS (SELECT d - 1 AS d, k[1:d - 1] AS k, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
valued AS (
  SELECT nodes.*, coalesce(n, 0) AS n_children,
         CASE WHEN d = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(k[d].text, '[^\x20\x09-\x0D]+')) END AS saved
  FROM nodes LEFT JOIN children USING (d, k)
),
totals AS (
  SELECT a AS d, k[1:a] AS k, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved)::BIGINT AS saved_tokens
  FROM (SELECT d, k, n_children, saved, unnest(range(0, d + 1)) AS a FROM valued) GROUP BY ALL
)
SELECT v.conv_id, v.d AS depth, p.conv_id AS parent_conv_id, v.n_convs, v.n_children, n_leaves, saved_tokens, v.ends_sha256
FROM valued v JOIN totals USING (d, k) LEFT JOIN nodes p ON p.d = v.d - 1 AND p.k = v.k[1:v.d - 1]
"""

OP13_SQL = """
WITH v AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, list_inner_product(a.e, b.e)::BIGINT AS score
  FROM v a JOIN v b ON a.id <> b.id WHERE a.id % 100 = 0
),
near AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INT AS rank,
       id AS negative_id, positive_score, score AS negative_score
FROM near JOIN scored USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""

ORACLES: dict[str, str] = {"op2_embedding_dedup": OP2_SQL, "op3_hamming_search": OP3_SQL, "op4_substring_dedup": OP4_SQL, "op12_conversation_trie": OP12_SQL, "op13_hard_negatives": OP13_SQL}
