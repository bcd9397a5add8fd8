"""Queries of this subpackage: each applies one operator, with production parameters, to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The rules of the url query.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.url_filter import judge_urls

    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return judge_urls(table(spark, sf_dir, "pages"), rules)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.line_dedup import line_report

    return line_report(table(spark, sf_dir, "documents"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.ngram_join import ngram_components

    return ngram_components(table(spark, sf_dir, "documents"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.class_lm import class_lm_scores
    from tessera.llm.quality_knn import held_out

    return class_lm_scores(table(spark, sf_dir, "documents"), ~held_out(F.col("doc_id"), of=7))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.quality_knn import held_out, score_quality

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_quality(docs, table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_score").alias("score"), F.col("_predicted").alias("predicted"))


def op6_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.fingerprints import fingerprint_documents

    return fingerprint_documents(table(spark, sf_dir, "documents"))


#: A public vocabulary file; its path is a parameter of the operator.
MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.sentencepiece_codec import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"), MODEL_FILE)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.exact_dedup import exact_duplicates

    return exact_duplicates(table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.sharding import shard_documents

    return shard_documents(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.mixing import mix_sources

    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.language_id import identify_languages
    from tessera.llm.quality_knn import held_out

    out = held_out(F.col("doc_id"), of=3, remainder=1)
    told = identify_languages(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), ~out)
    return told.select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.spelling_variants import spelling_variants

    return spelling_variants(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.whitening import whiten

    return whiten(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filters": op1_url_filters,
    "op2_line_dedup": op2_line_dedup,
    "op3_ngram_jaccard": op3_ngram_jaccard,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_document_fingerprints": op6_document_fingerprints,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_sharding": op9_sharding,
    "op10_mixing": op10_mixing,
    "op11_language_id": op11_language_id,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_whitening": op13_whitening,
}

ORACLES: dict[str, str] = {
    "op1_url_filters": """
        WITH rules(host, path, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
            ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
        parts AS (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        split AS (SELECT row_number() OVER () AS rid, page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
            regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
        hits AS (SELECT s.rid, r.host || r.path AS rule, r.verdict, row_number() OVER (PARTITION BY s.rid ORDER BY length(r.host || r.path) DESC, length(r.host) DESC) AS k
            FROM split s JOIN rules r ON (s.host = r.host OR ends_with(s.host, '.' || r.host)) AND starts_with(s.path, r.path))
        SELECT s.page_id, s.host, s.path, h.rule, coalesce(h.verdict, 'allow') AS verdict FROM split s LEFT JOIN hits h ON h.rid = s.rid AND h.k = 1
    """,
    "op8_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
    """,
}
