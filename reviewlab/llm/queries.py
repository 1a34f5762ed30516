"""Registered queries of the operators here: thin projections onto their contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, dialogue, hnsw, katz, langid, lines, negatives, oracle, packing, passages, quality, simhash, sketch, winnow
from .store import table, written
from .tokens import vocabulary_path

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


ORACLE["op7_embedding_dedup"] = """
WITH RECURSIVE vec AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL)) = 0
    AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pair AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM vec a JOIN vec b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
  WHERE list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v))) >= 0.93),
reach AS (SELECT vec_id AS id, vec_id AS root FROM embeddings UNION SELECT p.b, r.root FROM reach r JOIN pair p ON r.id = p.a),
least AS (SELECT id, min(root) AS component_id FROM reach GROUP BY id),
degree AS (SELECT a AS id, count(*) AS n FROM pair GROUP BY a)
SELECT e.vec_id, CAST(coalesce(d.n, 0) AS BIGINT) AS n_links, l.component_id, l.component_id = e.vec_id AS kept
FROM embeddings e JOIN least l ON e.vec_id = l.id LEFT JOIN degree d ON e.vec_id = d.id"""


ORACLE["op11_conversation_repair"] = oracle.CONVERSATION_REPAIR


@query
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, present = dialogue.damaged(table(spark, sf_dir, "conversations"))
    return dialogue.repair(rows, present=present)


ORACLE["op13_decontamination"] = oracle.DECONTAMINATION


@query
def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = winnow.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


ORACLE["op12_hard_negatives"] = oracle.HARD_NEGATIVES


@query
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    moved = vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return negatives.hard_negatives(moved, F.col("vec_id") % 100 == 0)


@query
def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    near = simhash.near_duplicates(docs, words=4, max_bits=4, keep=["doc_id"])
    return near.select("doc_id", "near.fingerprint", "near.component_id")


@query
def op2_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary_path("byte_bpe_50k.json")
    ids = bpe.encode(table(spark, sf_dir, "documents"), path)
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                      F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                      F.sha2(bpe.decode(F.col("ids"), path).cast("binary"), 256).alias("decoded_sha256"))


@query
def op3_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"))


@query
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = langid.held_out(F.col("doc_id"))
    found = langid.predict(docs, langid.fit(docs.where(~held)))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


@query
def op9_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sketch.fingerprints(docs).select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        sketch.written_out(F.col("sketch")).alias("fingerprint"), sketch.written_out(F.col("edited_sketch")).alias("edited_fingerprint"),
        "near_edited", "near_next")


@query
def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    stats = written(quality.with_stats(docs).drop("text"), "quality-stats")
    found = quality.scored(stats, quality.train(stats, table(spark, sf_dir, "labels")), out="score")
    return found.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_report(table(spark, sf_dir, "documents"))


@query
def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.93)


@query
def op5_katz_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(table(spark, sf_dir, "documents"))


@query
def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.passage_report(table(spark, sf_dir, "documents"))
