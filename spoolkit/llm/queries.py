"""The thin queries over the operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spoolkit.llm.attention_lm import score_texts
from spoolkit.llm.block_max_search import ORACLE_SQL as SEARCH_SQL
from spoolkit.llm.block_max_search import search
from spoolkit.llm.embedding_dedup import near_duplicates
from spoolkit.llm.harmonic_packing import pack
from spoolkit.llm.lexicon_bpe import encode_decode
from spoolkit.llm.merkle_manifest import ORACLE_SQL as MERKLE_SQL
from spoolkit.llm.merkle_manifest import document_manifest, proof_hash
from spoolkit.llm.partenum_join import jaccard_components
from spoolkit.llm.secret_scan import scan
from spoolkit.llm.token_files import token_files
from spoolkit.llm.tool_calls import ORACLE_SQL as TOOL_CALLS_SQL
from spoolkit.llm.tool_calls import linked_events
from spoolkit.llm.toxic_lexicon import toxicity
from spoolkit.llm.turn_repair import ORACLE_SQL as REPAIR_SQL
from spoolkit.llm.turn_repair import damaged, repair
from spoolkit.llm.weak_quality import classify

BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"

#: Components by reachability along ``sym`` (a, b), symmetric.
_REACH = "reach AS (SELECT a AS v, a AS r FROM sym UNION SELECT reach.v, sym.b FROM reach JOIN sym ON sym.a = reach.r), components AS (SELECT v, min(r) AS c FROM reach GROUP BY v)"

PARTENUM_SQL = f"""WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM words
), sized AS (SELECT doc_id, g, count(*) OVER (PARTITION BY doc_id) AS n FROM shingles
), pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM sized x JOIN sized y ON x.g = y.g AND x.doc_id < y.doc_id AND 100 * least(x.n, y.n) >= 90 * greatest(x.n, y.n)
  GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 90 * (x.n + y.n - count(*))
), sym AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs), {_REACH}
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(c, doc_id) AS component_id FROM documents LEFT JOIN (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id) USING (doc_id) LEFT JOIN components ON v = doc_id"""

EMBEDDING_SQL = f"""WITH RECURSIVE sound AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), sym AS (SELECT x.vec_id AS a, y.vec_id AS b FROM sound x JOIN sound y ON x.vec_id <> y.vec_id AND len(x.e) = len(y.e) WHERE list_cosine_similarity(x.e, y.e) >= 0.9), {_REACH}
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(c, vec_id) AS component_id, coalesce(c, vec_id) = vec_id AS kept FROM embeddings LEFT JOIN (SELECT a, count(*) AS n FROM sym GROUP BY a) ON a = vec_id LEFT JOIN components ON v = vec_id"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_partenum_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), width=3, percent=90)


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_lexicon_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), keep=False)


def op4_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op5_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def op7_block_max_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    asked = docs.where("doc_id % 100 = 0").withColumnRenamed("doc_id", "query_id")
    return search(docs, asked, k=10).withColumn("score", F.round("score", 6))


def op8_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op10_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_events(table(spark, sf_dir, "conversations"))


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damaged(table(spark, sf_dir, "conversations")))


def op12_toxic_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = document_manifest(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "leaf", "subroot", "root", proof_hash(F.col("proof")).alias("proof_sha256"), "folded_root", "verified")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_partenum_join, op2_embedding_dedup, op3_lexicon_bpe, op4_attention_lm, op5_weak_quality, op6_secret_scan, op7_block_max_search, op8_harmonic_packing, op9_token_files, op10_tool_calls, op11_turn_repair, op12_toxic_lexicon, op13_merkle_manifest)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_partenum_join": PARTENUM_SQL, "op2_embedding_dedup": EMBEDDING_SQL, "op7_block_max_search": SEARCH_SQL, "op10_tool_calls": TOOL_CALLS_SQL, "op11_turn_repair": REPAIR_SQL, "op13_merkle_manifest": MERKLE_SQL}
