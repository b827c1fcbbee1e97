"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from asofly.llm import centroids, divergence
from asofly.llm.common import table
from asofly.llm.decontamination import contaminated
from asofly.llm.html_mincut import extract_pages
from asofly.llm.packing import pack_documents
from asofly.llm.parity_join import jaccard_components
from asofly.llm.pii import personal_data
from asofly.llm.pivot_index import near_duplicates
from asofly.llm.quality import quality
from asofly.llm.quality_rules import quality_rules
from asofly.llm.sharding import shard_documents
from asofly.llm.token_spans import attribute_tokens
from asofly.llm.toxicity import toxicity


def op1_noisy_channel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_disclosure_sanitisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))


def op5_mincut_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


def op6_parity_sketch_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), n_words=4, num=85, den=100)


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_pivot_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.93)


def op9_vector_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), shards=24)


def op10_token_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return attribute_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, rule="majority", unit="sentences")


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.centroid_clusters(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_noisy_channel_toxicity": op1_noisy_channel_toxicity,
    "op2_ordinal_quality": op2_ordinal_quality,
    "op3_retrieval_packing": op3_retrieval_packing,
    "op4_disclosure_sanitisation": op4_disclosure_sanitisation,
    "op5_mincut_extraction": op5_mincut_extraction,
    "op6_parity_sketch_join": op6_parity_sketch_join,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
    "op8_pivot_permutation": op8_pivot_permutation,
    "op9_vector_sharding": op9_vector_sharding,
    "op10_token_attribution": op10_token_attribution,
    "op11_quality_rules": op11_quality_rules,
    "op12_source_divergence": op12_source_divergence,
    "op13_centroid_clustering": op13_centroid_clustering,
}

#: op6: all pairs by shared shingles, and reachability. op8: all pairs of a label by cosine, and reachability. op12, op13: beside
#: their operators.
ORACLE_SQL: dict[str, str] = {
    "op6_parity_sketch_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
 s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END)) AS g FROM w),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
 l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
 r AS (SELECT doc_id AS node, doc_id AS c FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT node, min(c) AS c FROM r GROUP BY node) m ON m.node = d.doc_id""",
    "op8_pivot_permutation": """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
 l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id WHERE list_cosine_similarity(x.e, y.e) >= 0.93),
 r AS (SELECT vec_id AS node, vec_id AS c FROM embeddings UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.node),
 m AS (SELECT node, min(c) AS c FROM r GROUP BY node)
SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.a = e.vec_id) AS n_links, m.c AS component_id, e.vec_id = m.c AS kept FROM embeddings e JOIN m ON m.node = e.vec_id""",
    "op12_source_divergence": divergence.ORACLE_SQL,
    "op13_centroid_clustering": centroids.ORACLE_SQL,
}
