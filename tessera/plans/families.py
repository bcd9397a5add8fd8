"""Lookups, pairings, audits and reports over the standard tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import audit, lookup
from tessera.plans.registry import query, table

_T = "SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '\\p{L}+')) AS key FROM documents"


@query(f"WITH t AS (SELECT DISTINCT id, key FROM ({_T}) WHERE key IN ('the', 'with', 'of')) SELECT t.id, d.source, count(*) AS keys FROM t JOIN documents d ON d.doc_id = t.id WHERE d.lang = 'en' GROUP BY 1, 2 ORDER BY 2, 1 LIMIT 50")
def occurrences_of_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of one language that hold any of some keys, in order of their work, the first fifty."""
    docs = table(spark, sf_dir, "documents").where("lang = 'en'")
    return lookup.occurrences(docs.select(F.col("doc_id").alias("id"), "source", "text"), ["the", "with", "of"], ["source"], 50)


@query("""WITH c AS (SELECT conv_id * 1000 + turn AS id, conv_id, turn, role, text FROM conversations), p AS (SELECT id, max(CASE WHEN role = 'user' THEN id END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS parent_id, role, text FROM c)
    SELECT a.id, a.parent_id, CASE WHEN a.role <> 'assistant' THEN 'no translation' WHEN a.parent_id IS NULL THEN 'no parent' WHEN trim(a.text) = '' THEN 'empty' WHEN length(b.text) > 4 * length(a.text) THEN 'too short' ELSE 'accepted' END AS reason FROM p a LEFT JOIN c b ON b.id = a.parent_id""")
def pairing_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers paired with the question they follow, or the first reason why not."""
    rows = table(spark, sf_dir, "conversations").withColumn("id", F.col("conv_id") * 1000 + F.col("turn"))
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    linked = rows.withColumn("parent_id", F.max(F.when(F.col("role") == "user", F.col("id"))).over(before)).select("id", "parent_id", "role", "text")
    parents = rows.select(F.col("id").alias("_parent"), F.col("text").alias("_text"))
    joined = linked.join(parents, F.col("parent_id") == F.col("_parent"), "left")
    reasons = [("no translation", F.col("role") != "assistant"), ("no parent", F.col("parent_id").isNull()), ("empty", F.trim("text") == ""), ("too short", F.length("_text") > 4 * F.length("text"))]
    return lookup.first_reason(joined, reasons, "accepted").select("id", "parent_id", "reason")


@query(f"""WITH q AS (SELECT item_id, regexp_extract_all(lower(text), '\\p{{L}}+') AS t FROM benchmark), k AS (SELECT item_id, unnest(t) AS key FROM q), v AS (SELECT key, count(*) AS n FROM ({_T}) GROUP BY 1)
    SELECT item_id, arg_min(key, (n, key)) AS anchor, min(n) AS occurrences, count(DISTINCT key) AS keys FROM k JOIN v USING (key) GROUP BY 1""")
def rarest_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rarest word of each passage: the one to look for first."""
    words = lambda rows, name: rows.select(F.col(name), F.explode(F.regexp_extract_all(F.lower("text"), F.lit("\\p{L}+"), F.lit(0))).alias("key"))
    asked = words(table(spark, sf_dir, "benchmark"), "item_id").distinct()
    return lookup.rarest_anchor(asked, words(table(spark, sf_dir, "documents"), "doc_id"), "item_id")


@query("""WITH r AS (SELECT doc_id, source, lang, text, regexp_matches(text, '[&%$#*]') AS odd, len(regexp_extract_all(text, '\\p{L}')) AS letters FROM documents)
    SELECT doc_id, letters, CASE WHEN letters < 80 THEN 'short' WHEN letters * 2 < length(text) THEN 'mixed' WHEN odd THEN 'marked' ELSE 'descriptive' END AS block FROM r""")
def block_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts sorted into classes by the letters and signs they hold."""
    letters = F.regexp_count("text", F.lit("\\p{L}")).cast("long")
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", letters.alias("letters"))
    block = F.when(F.col("letters") < 80, "short").when(F.col("letters") * 2 < F.length("text"), "mixed").when(F.col("text").rlike("[&%$#*]"), "marked").otherwise("descriptive")
    return rows.select("doc_id", "letters", block.alias("block"))


@query("""WITH e AS (SELECT doc_id AS id, regexp_extract(substr(text, 1, 240), '^(.*)\\s', 1, 's') AS cut, text FROM documents) SELECT id, md5(CASE WHEN length(text) <= 240 OR cut = '' THEN substr(text, 1, 240) ELSE rtrim(cut) END) AS digest, length(text) > 240 AS truncated FROM e""")
def word_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Excerpts of 240 characters that end with a whole word."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return rows.select("id", F.md5(lookup.word_excerpt(F.col("text"), 240)).alias("digest"), (F.length("text") > 240).alias("truncated"))


@query("""WITH p AS (SELECT l_partkey, l_suppkey, count(*) AS n, min(l_orderkey) AS first_order FROM lineitem GROUP BY 1, 2), g AS (SELECT l_partkey, count(*) AS candidates, sum(n)::BIGINT AS lines, arg_min(l_suppkey, (-n, l_suppkey)) AS best FROM p GROUP BY 1)
    SELECT l_partkey AS form, best, candidates, lines, candidates > 1 AS ambiguous FROM g""")
def candidate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of a form, the most attested first, with totals and whether the form is ambiguous."""
    return lookup.candidate_groups(table(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey")


@query("""WITH s AS (SELECT c_custkey, c_name, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey)
    SELECT r_name, n_name, count(*) AS members, sum(length(c_name))::BIGINT AS bytes, grouping(n_name) AS level FROM s GROUP BY GROUPING SETS ((r_name), (r_name, n_name))""")
def metrics_by_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and sizes by family and by member of a family, in one pass."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    rows = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left").select("c_name", "n_name", "r_name")
    sets = rows.groupingSets([[F.col("r_name")], [F.col("r_name"), F.col("n_name")]], "r_name", "n_name")
    return sets.agg(F.count(F.lit(1)).alias("members"), F.sum(F.octet_length("c_name")).alias("bytes"), F.grouping("n_name").cast("long").alias("level"))


@query("""WITH a AS (SELECT source, count(*) AS documents, sum(n_chars)::BIGINT AS characters FROM documents GROUP BY 1), b AS (SELECT source, count(*) AS labelled FROM documents JOIN labels USING (doc_id) GROUP BY 1)
    SELECT coalesce(a.source, b.source) AS source, documents, coalesce(labelled, 0) AS labelled, round(coalesce(labelled, 0) / documents, 4) AS share, CASE WHEN coalesce(labelled, 0) = 0 THEN 'missing' WHEN labelled < documents THEN 'partial' ELSE 'complete' END AS state FROM a LEFT JOIN b USING (source)""")
def store_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two stores held against each other, source by source."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), table(spark, sf_dir, "labels").select("doc_id")
    return audit.reconcile(docs, docs.select("doc_id", "source").join(labels, "doc_id"), "source", F.sum("n_chars").alias("characters")).select("source", F.col("rows").alias("documents"), F.col("present").alias("labelled"), "share", "state")


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS k FROM documents), s AS (SELECT doc_id, md5(trim(line)) AS s FROM l WHERE length(trim(line)) >= 32)
    SELECT s AS signature, count(DISTINCT doc_id) AS documents, array_to_string(list_slice(list_sort(list(DISTINCT doc_id)), 1, 3), ',') AS refs FROM s GROUP BY 1 HAVING count(DISTINCT doc_id) > 1""")
def overlap_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that several documents have, with the first three of them."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where("length(trim(line)) >= 32")
    return lookup.bounded_refs(lines.select("doc_id", F.md5(F.trim("line")).alias("signature")), "signature", "doc_id", 3).where("documents > 1")


@query("""WITH d AS (SELECT doc_id, source, md5(text) AS key, n_chars FROM documents), g AS (SELECT key, count(DISTINCT source) AS sources, count(*) AS n FROM d GROUP BY 1) SELECT d.doc_id, CASE WHEN n = 1 THEN doc_id WHEN sources = 1 THEN min(doc_id) OVER (PARTITION BY key) END AS upstream FROM d JOIN g USING (key)""")
def unique_upstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record a copy goes back to, where only one source has the text."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", F.md5("text").alias("key"))
    return lookup.upstream(rows, "key", "source", "doc_id")


@query("""WITH e AS (SELECT event_type AS kind, user_id, length(props) AS bytes, epoch_us(ts) AS us FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY us DESC, user_id DESC, bytes DESC) AS k, sum(bytes) OVER (PARTITION BY kind ORDER BY us DESC, user_id DESC, bytes DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS held FROM e)
    SELECT kind, count(*) AS entries, sum(bytes)::BIGINT AS bytes, count_if(k <= 1000 AND held <= 50000) AS kept FROM r GROUP BY 1""")
def cache_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries and bytes of each cache, and how many stay when the oldest go beyond a thousand entries or 50,000 bytes."""
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), "user_id", F.octet_length("props").alias("bytes"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    newest = Window.partitionBy("kind").orderBy(F.desc("at"), F.desc("user_id"), F.desc("bytes"))
    held = F.sum("bytes").over(newest.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = rows.withColumns({"_k": F.row_number().over(newest), "_held": held})
    return ranked.groupBy("kind").agg(F.count(F.lit(1)).alias("entries"), F.sum("bytes").alias("bytes"), F.count_if((F.col("_k") <= 1000) & (F.col("_held") <= 50000)).alias("kept"))


@query("""WITH t AS (SELECT doc_id, source, CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 ELSE 2 END AS bucket FROM documents WHERE length(trim(text)) > 0) SELECT doc_id, source, bucket FROM t ORDER BY bucket, source, doc_id LIMIT 200""")
def priority_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts to work on first: by bucket, then work, the first two hundred."""
    rows = table(spark, sf_dir, "documents").where("length(trim(text)) > 0")
    bucket = F.when(F.col("lang") == "en", 0).when(F.col("lang") == "fr", 1).otherwise(2)
    return rows.select("doc_id", "source", bucket.alias("bucket")).orderBy("bucket", "source", "doc_id").limit(200)


@query("""WITH c AS (SELECT p_partkey AS id, CASE WHEN p_size < 10 THEN 0 WHEN p_size < 30 THEN 1 ELSE 2 END AS status_rank, p_type AS predicate, p_brand AS family FROM part) SELECT id, row_number() OVER (PARTITION BY family ORDER BY status_rank, predicate, id) AS place, family FROM c""")
def claim_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of a family in their order: status, predicate, identifier."""
    rank = F.when(F.col("p_size") < 10, 0).when(F.col("p_size") < 30, 1).otherwise(2)
    place = F.row_number().over(Window.partitionBy("p_brand").orderBy(rank, "p_type", "p_partkey"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), place.cast("long").alias("place"), F.col("p_brand").alias("family"))


@query("""WITH q AS (SELECT 7 AS number), r AS (SELECT page_id, url, regexp_extract_all(url, '[0-9]+') AS n FROM pages) SELECT page_id, url, len(n) AS numbers, CASE WHEN len(n) = 0 THEN 'none' WHEN len(n) = 1 THEN 'single' ELSE 'several' END AS coverage FROM r ORDER BY CASE WHEN len(n) = 1 THEN 0 WHEN len(n) > 1 THEN 1 ELSE 2 END, url, page_id LIMIT 100""")
def reference_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses by how surely their numbers name a place: one number first, then several, then none."""
    rows = table(spark, sf_dir, "pages").select("page_id", "url", F.size(F.regexp_extract_all("url", F.lit("[0-9]+"), F.lit(0))).cast("long").alias("numbers"))
    return lookup.by_coverage(rows, "numbers", ["url", "page_id"]).limit(100)
