"""Dense retrieval, fusion and projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import lexical, retrieval
from tessera.plans.registry import query, table
from tessera.plans.text import TERMS, _BM25, _TOKENS, text_tokens



def _cosine(a: str, b: str) -> str:
    dot = lambda x, y: f"list_sum(list_transform(list_zip({x}, {y}), lambda p: p[1]::DOUBLE * p[2]::DOUBLE))"
    return f"{dot(a, b)} / sqrt({dot(a, a)} * {dot(b, b)})"


def _query_vector(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> list[float]:
    return [float(x) for x in table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).first()["embedding"]]


@query(f"WITH q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 0) SELECT vec_id, label, round({_cosine('embedding', 'v')}, 6) AS score FROM embeddings, q ORDER BY 3 DESC, 1 LIMIT 20")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.dense_top_k(table(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir), 20).select("vec_id", "label", "score")


@query(f"WITH q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 0) SELECT vec_id, label, round({_cosine('embedding', 'v')}, 6) AS score FROM embeddings, q WHERE label IN (1, 2, 3) AND vec_id % 2 = 1 ORDER BY 3 DESC, 1 LIMIT 20")
def dense_filtered_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eligibility first (label and odd identifier), scores only for what is left."""
    eligible = F.col("label").isin(1, 2, 3) & (F.col("vec_id") % 2 == 1)
    return retrieval.dense_top_k(table(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir), 20, eligible).select("vec_id", "label", "score")


@query(f"""WITH q AS (SELECT vec_id AS query_id, embedding AS v FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT query_id, vec_id AS neighbour, round({_cosine('embedding', 'v')}, 6) AS score FROM embeddings, q WHERE vec_id <> query_id)
    SELECT query_id, neighbour, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, neighbour) AS rank FROM s) WHERE rank <= 5""")
def dense_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest five of every twentieth vector among all vectors."""
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return retrieval.nearest_of_each(vectors, asked, 5).withColumn("rank", F.col("rank").cast("long"))


@query("""WITH m AS (SELECT label, unnest(range(1, 65)) AS place, embedding FROM embeddings), c AS (SELECT label, place, sum(embedding[place]::DOUBLE) AS s, count(*) AS n FROM m GROUP BY 1, 2)
    SELECT label, max(n) AS vectors, round(sqrt(sum((s / n) * (s / n))), 6) AS centroid_norm FROM c GROUP BY 1""")
def label_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean vectors by label: one row for each label and place, aggregated before the shuffle."""
    cells = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("place", "value"))
    means = cells.groupBy("label", "place").agg(F.sum(F.col("value").cast("double")).alias("s"), F.count(F.lit(1)).alias("n"))
    return means.groupBy("label").agg(F.max("n").alias("vectors"), F.round(F.sqrt(F.sum((F.col("s") / F.col("n")) * (F.col("s") / F.col("n")))), 6).alias("centroid_norm"))


@query("""WITH w AS (SELECT label AS id, (vec_id % 3 + 1)::DOUBLE AS weight, unnest(range(1, 65)) AS place, embedding FROM embeddings), s AS (SELECT id, place, sum(weight * embedding[place]::DOUBLE) AS v FROM w GROUP BY 1, 2), n AS (SELECT id, sqrt(sum(v * v)) AS norm FROM s GROUP BY 1)
    SELECT id, place - 1 AS place, round(v / norm, 6) AS value FROM s JOIN n USING (id)""")
def pooled_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").alias("id"), (F.col("vec_id") % 3 + 1).cast("double").alias("weight"), F.transform("embedding", lambda v: v.cast("double")).alias("vector"))
    return retrieval.pool_windows(rows).select("id", F.posexplode("vector").alias("place", "value")).select("id", F.col("place").cast("long").alias("place"), F.round("value", 6).alias("value"))


@query(f"""WITH {_TOKENS}, f AS (SELECT normalized, count(DISTINCT id) AS df FROM tok GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 200), t AS (SELECT count(DISTINCT id) AS n FROM tok), tf AS (SELECT id, normalized, sum(count) AS tf FROM tok GROUP BY ALL)
    SELECT id, normalized, round((1 + ln(tf)) * ln(1 + n / (1 + df)), 6) AS weight FROM tf JOIN f USING (normalized), t""")
def tfidf_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = text_tokens(spark, sf_dir)
    return retrieval.tf_idf(tokens, 200).withColumn("weight", F.round("weight", 6))


@query()
def usage_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of the occurrences of one word in a space of three dimensions; signs of axes are free, so there is no SQL."""
    tokens = text_tokens(spark, sf_dir)
    chosen = tokens.where("normalized = 'heha'").select("id").distinct().orderBy("id").limit(120)
    weights = retrieval.tf_idf(tokens.join(F.broadcast(chosen), "id"), 2500)  # at most 120 points
    return spark.createDataFrame(retrieval.usage_space(weights), "id long, x double, y double, z double")


_LISTS = f"""{_TOKENS}, {_BM25.format(terms="'heha', 'the', 'with'")}, parent AS (SELECT doc_id, md5(text) AS group_key FROM documents),
    lex AS (SELECT 'lexical' AS signal, row_number() OVER (ORDER BY score DESC, id) AS position, id FROM (SELECT * FROM scored ORDER BY score DESC, id LIMIT 400)),
    frm AS (SELECT 'forms' AS signal, row_number() OVER (ORDER BY covered DESC, id) AS position, id FROM (SELECT * FROM scored ORDER BY covered DESC, id LIMIT 400)),
    qv AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 0), sem AS (SELECT 'semantic' AS signal, row_number() OVER (ORDER BY s DESC, vec_id) AS position, vec_id AS id FROM (SELECT vec_id, round({_cosine('embedding', 'v')}, 6) AS s FROM embeddings, qv ORDER BY 2 DESC, 1 LIMIT 1000)),
    lists AS (SELECT l.*, p.group_key FROM (SELECT * FROM lex UNION ALL SELECT * FROM frm UNION ALL SELECT * FROM sem) l JOIN parent p ON p.doc_id = l.id),
    firsts AS (SELECT signal, group_key, min(position) AS position, arg_min(id, position) AS id FROM lists GROUP BY 1, 2),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY signal ORDER BY position) AS rank FROM firsts),
    fused AS (SELECT group_key, round(sum(CASE signal WHEN 'lexical' THEN 2.0 ELSE 1.0 END / (60 + rank)), 8) AS score, min(rank) AS best_rank, array_to_string(list_sort(list(signal || ':' || rank)), ',') AS ranks, min(id) AS id FROM ranked GROUP BY 1)"""


def _ranked_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = lexical.bm25(text_tokens(spark, sf_dir), TERMS)
    place = lambda rows, *order: rows.withColumn("position", F.row_number().over(Window.orderBy(*order)))
    lex = place(scored.orderBy(F.desc("score"), "id").limit(400), F.desc("score"), "id").select(F.lit("lexical").alias("signal"), "position", "id")
    forms = place(scored.orderBy(F.desc("covered"), "id").limit(400), F.desc("covered"), "id").select(F.lit("forms").alias("signal"), "position", "id")
    dense = retrieval.dense_top_k(table(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir), 1000)
    sem = place(dense, F.desc("score"), "vec_id").select(F.lit("semantic").alias("signal"), "position", F.col("vec_id").alias("id"))
    keys = docs.select(F.col("doc_id").alias("id"), F.md5("text").alias("group_key"))
    return lex.union(forms).union(sem).join(keys, "id")


@query(f"WITH {_LISTS} SELECT group_key, score, best_rank, ranks, id FROM fused ORDER BY score DESC, best_rank, id LIMIT 100")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three ranked lists fused; copies of one text have one vote in each list."""
    fused = retrieval.reciprocal_rank_fusion(_ranked_lists(spark, sf_dir), {"lexical": 2.0})
    return fused.withColumn("best_rank", F.col("best_rank").cast("long")).orderBy(F.desc("score"), "best_rank", "id").limit(100)


@query(f"""WITH {_LISTS}, tier AS (SELECT f.*, CASE WHEN contains(lower(d.text), 'of the') THEN 0 ELSE 1 END AS tier, d.source, substr(d.text, 1, 200) AS excerpt, length(d.text) > 200 AS truncated FROM (SELECT * FROM fused ORDER BY score DESC, best_rank, id LIMIT 100) f JOIN documents d ON d.doc_id = f.id)
    SELECT id, source, score, tier, excerpt, truncated FROM tier ORDER BY tier, score DESC, best_rank, id LIMIT 40""")
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fused list with texts that hold the phrase first; texts are only fetched for the hundred that are left."""
    from tessera.functions.text import excerpt

    fused = rrf_fusion(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", "text")
    joined = docs.join(F.broadcast(fused), "id")  # a hundred rows
    tier = F.when(F.lower("text").contains("of the"), 0).otherwise(1)
    rows = joined.withColumns({"tier": tier, "_e": excerpt(F.col("text"))}).orderBy("tier", F.desc("score"), "best_rank", "id").limit(40)
    return rows.select("id", "source", "score", "tier", "_e.excerpt", "_e.truncated")


_PARENTS = "t AS (SELECT conv_id * 1000 + turn AS id, conv_id, turn, role, text FROM conversations), link AS (SELECT *, max(CASE WHEN role = 'user' THEN id END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS parent_id FROM t)"


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with the user turn that they follow as parent."""
    rows = table(spark, sf_dir, "conversations").withColumn("id", F.col("conv_id") * 1000 + F.col("turn"))
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("parent_id", F.max(F.when(F.col("role") == "user", F.col("id"))).over(before))


@query(f"WITH {_PARENTS} SELECT id, role, parent_id, CASE WHEN role = 'assistant' AND parent_id IS NOT NULL THEN parent_id ELSE id END AS target_id FROM link")
def parent_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers stand for the question they answer."""
    turns = _turns(spark, sf_dir)
    links = turns.where("role = 'assistant' and parent_id is not null").select(F.col("id").alias("child_id"), "parent_id", F.lit(True).alias("parent_ok"))
    hits = turns.select("id", "role", F.col("parent_id").alias("_p"))
    return retrieval.project_to_parents(hits, links).select("id", "role", F.col("_p").alias("parent_id"), "target_id")


@query(f"""WITH {_PARENTS}, tok AS (SELECT id, form, lower(form) AS normalized, count(*) AS count FROM (SELECT id, unnest(regexp_extract_all(text, '\\p{{L}}+')) AS form FROM link WHERE role = 'assistant' AND parent_id IS NOT NULL) GROUP BY ALL),
    {_BM25.format(terms="'the', 'of'")} SELECT s.id, parent_id, score FROM scored s JOIN link USING (id) ORDER BY score DESC, s.id LIMIT 40""")
def linked_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 over answers that have a question, with the question they lead to."""
    turns = _turns(spark, sf_dir).where("role = 'assistant' and parent_id is not null")
    scored = lexical.bm25(lexical.token_table(turns, "id"), ["the", "of"])
    return scored.join(turns.select("id", "parent_id"), "id").select("id", "parent_id", "score").orderBy(F.desc("score"), "id").limit(40)
