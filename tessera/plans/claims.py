"""Alternatives stated in the documents, and claims that rest on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.alternatives import alternatives, qualified_claims
from tessera.plans.registry import query, table
from tessera.sources.stored import materialized

#: Small words of the documents by what they say.
LABELS = {
    "the": ("article", "definite"), "this": ("article", "near"), "that": ("article", "far"), "is": ("time", "present"), "are": ("time", "present"), "was": ("time", "past"),
    "of": ("relation", "origin"), "from": ("relation", "origin"), "to": ("relation", "goal"), "for": ("relation", "goal"), "in": ("relation", "place"), "on": ("relation", "place"), "at": ("relation", "place"), "by": ("relation", "agent"),
}

_TOKEN = "[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s]"
_STATED = f"""lab(w, k, v) AS (VALUES {", ".join(f"('{w}', '{k}', '{v}')" for w, (k, v) in LABELS.items())}),
    d AS (SELECT doc_id, regexp_extract_all(text, '{_TOKEN}') AS toks, string_split_regex(text, '{_TOKEN}') AS gaps FROM documents),
    u AS (SELECT doc_id, generate_subscripts(toks, 1) AS i, unnest(toks) AS tok, unnest(gaps[:len(toks)]) AS gap FROM d),
    p AS (SELECT u.*, sum(length(gap) + length(tok)) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT AS stop, k, v, CASE WHEN k IS NOT NULL THEN 1 WHEN lower(tok) = 'and' THEN 2 WHEN lower(tok) IN ('a', 'an', '.', ',') THEN 3 ELSE 0 END AS kind FROM u LEFT JOIN lab ON w = lower(tok)),
    g AS (SELECT *, sum((kind = 0)::INT) OVER (PARTITION BY doc_id ORDER BY i) AS grp FROM p),
    r AS (SELECT *, min(i) FILTER (kind = 1) OVER (PARTITION BY doc_id, grp) AS first, sum((kind = 2)::INT) OVER (PARTITION BY doc_id, grp ORDER BY i)::BIGINT AS b FROM g WHERE kind > 0),
    c AS (SELECT *, b - coalesce(max(b) FILTER (i < first) OVER (PARTITION BY doc_id, grp), 0) AS branch FROM r WHERE first IS NOT NULL),
    said AS (SELECT doc_id, grp, branch, k, count(DISTINCT v) AS n, min(v) AS v FROM c WHERE kind = 1 GROUP BY ALL),
    br AS (SELECT doc_id, grp, branch, min(stop - length(tok)) AS low, max(stop) AS last FROM c WHERE kind = 1 GROUP BY ALL),
    ok AS (SELECT doc_id, grp, max(branch) AS joins FROM c WHERE i >= first GROUP BY ALL HAVING max(branch) > 0 AND count(DISTINCT branch) FILTER (kind = 1) = max(branch) + 1),
    tell AS (SELECT doc_id, grp, branch, string_agg(k || '=' || v, ',' ORDER BY k) FILTER (n = 1) AS features, string_agg(k, ',' ORDER BY k) FILTER (n > 1) AS unresolved FROM said GROUP BY ALL),
    st AS (SELECT br.doc_id, grp, branch::BIGINT AS branch, low::BIGINT AS branch_start, (last + (substring(text, last + 1, 1) = '.')::INT)::BIGINT AS branch_end, coalesce(features, '') AS features, coalesce(unresolved, '') AS unresolved, text
        FROM br JOIN ok USING (doc_id, grp) JOIN tell USING (doc_id, grp, branch) JOIN documents ON documents.doc_id = br.doc_id),
    stated AS (SELECT *, min(branch_start) OVER (PARTITION BY doc_id, grp) AS start, max(branch_end) OVER (PARTITION BY doc_id, grp) AS stop, substring(text, branch_start + 1, branch_end - branch_start) AS label FROM st)"""


def _stated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(alternatives(F.col("text"), LABELS, "and")).alias("a"))


@query(f"""WITH {_STATED} SELECT doc_id, start, stop, branch, label, branch_start, branch_end, features, unresolved FROM stated""")
def stated_alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run of small words that "and" divides, a row for each branch."""
    rows = _stated(spark, sf_dir).select("doc_id", F.col("a.start").cast("long").alias("start"), F.col("a.end").cast("long").alias("stop"), F.posexplode("a.branches").alias("branch", "b"))
    told = F.array_join(F.transform(F.map_entries("b.features"), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ",")
    return rows.select("doc_id", "start", "stop", F.col("branch").cast("long").alias("branch"), "b.label", F.col("b.start").cast("long").alias("branch_start"), F.col("b.end").cast("long").alias("branch_end"), told.alias("features"), F.array_join("b.unresolved", ",").alias("unresolved"))


@query(f"""WITH {_STATED},
    q AS (SELECT *, NOT (doc_id % 3 = 0 AND stop = branch_end) AS accepted, branch_end = stop OR NOT regexp_matches(substring(text, branch_end + 1, 1), '[\\p{{L}}\\p{{N}}_]') AS placed FROM stated),
    w AS (SELECT doc_id, grp, bool_and(accepted AND placed AND unresolved = '') AS complete FROM q GROUP BY ALL),
    x AS (SELECT a.doc_id, a.grp, a.branch, string_agg(DISTINCT a.k, ',' ORDER BY a.k) AS conflicting FROM said a JOIN said b ON a.doc_id = b.doc_id AND a.grp = b.grp AND a.k = b.k AND a.n = 1 AND b.n = 1 AND a.v <> b.v GROUP BY ALL)
    SELECT q.doc_id || ':' || start || ':' || q.branch AS claim_id, CASE WHEN complete THEN 'represented' WHEN conflicting IS NOT NULL THEN 'incomplete' ELSE 'partial' END AS status, coalesce(conflicting, '') AS conflicting
    FROM q JOIN w USING (doc_id, grp) LEFT JOIN x ON x.doc_id = q.doc_id AND x.grp = q.grp AND x.branch = q.branch WHERE placed AND features <> ''""")
def claims_on_alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A claim for each branch of what is stated; in every third document the last one is not accepted."""
    # texts are read once, not by every side of the joins
    rows = materialized(_stated(spark, sf_dir), "alternatives").select("doc_id", "a", F.posexplode("a.branches").alias("branch", "b"))
    claims = rows.select(
        F.concat_ws(":", "doc_id", "a.start", "branch").alias("claim_id"), F.col("doc_id").alias("subject"), (~((F.col("doc_id") % 3 == 0) & (F.col("b.end") == F.col("a.end")))).alias("accepted"), "b.label", "b.features",
        (F.col("b.start") - F.col("a.start")).alias("start"), (F.col("b.end") - F.col("a.start")).alias("end"), F.array(F.struct(F.col("a.start").alias("place"), F.col("a.text").alias("quote"))).alias("evidence"),
    )
    return qualified_claims(claims, LABELS, "and").select("claim_id", "status", F.array_join("conflicting", ",").alias("conflicting"))
