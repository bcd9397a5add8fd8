"""Token tables, term and phrase search, copies of one text, BM25."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import letter_words


def token_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, form, normalized, count): how often each form stands in each text.  Aggregated before the shuffle."""
    forms = docs.select(F.col(id_col).alias("id"), F.explode(letter_words(F.col(text_col))).alias("form"))
    return forms.groupBy("id", "form").agg(F.count(F.lit(1)).alias("count")).withColumn("normalized", F.lower("form"))


def vocabulary(tokens: DataFrame) -> DataFrame:
    """(normalized, form, count): collection frequency and the smallest spelling."""
    return tokens.groupBy("normalized").agg(F.min("form").alias("form"), F.sum("count").alias("count"))


def with_sequence(rows: DataFrame, work: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Add each row's place in its work, from 0."""
    return rows.withColumn("sequence", F.row_number().over(Window.partitionBy(*work).orderBy(*order)) - 1)


def neighbours(rows: DataFrame, work: Sequence[str], order: Sequence[str], id_col: str) -> DataFrame:
    """Add the identifiers of the row before and the row after within a work."""
    window = Window.partitionBy(*work).orderBy(*order)
    return rows.withColumns({"previous_id": F.lag(id_col).over(window), "next_id": F.lead(id_col).over(window)})


def term_candidates(tokens: DataFrame, phrase_hits: DataFrame, terms: Sequence[str]) -> DataFrame:
    """(id, priority, matched): phrase hits have priority 0; rows with any term 1 and the number of distinct terms they hold."""
    hits = tokens.where(F.col("normalized").isin(*terms)).groupBy("id").agg(F.lit(1).alias("priority"), F.countDistinct("normalized").alias("matched"))
    exact = phrase_hits.select("id", F.lit(0).alias("priority"), F.lit(0).cast("long").alias("matched"))
    return exact.unionByName(hits).groupBy("id").agg(F.min("priority").alias("priority"), F.max("matched").alias("matched"))


def mirror_groups(rows: DataFrame, key: Sequence[str], order: Sequence[Column], id_col: str = "id", coarse: Sequence[str] | None = None) -> DataFrame:
    """One representative for each group of copies, with the group's size and sorted identifiers.

    With ``coarse``, rows carry (priority, matched), and the best of each is
    taken over the coarser groups.
    """
    # the first of a group is carried through an aggregation: no row but one sees the list of identifiers
    told = [c for c in rows.columns if c not in key]
    best = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    first = rows.withColumn("_first", best).where("_first = 1").select(*[F.col(k).alias(f"_k_{k}") for k in key], *told)
    sizes = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("copies"), F.array_sort(F.collect_list(id_col)).alias("_ids"))
    kept = sizes.join(first, F.expr(" and ".join(f"{k} <=> _k_{k}" for k in key))).select(*rows.columns, "copies", "_ids")
    if coarse:
        ranks = rows.groupBy(*[F.col(c).alias(f"_c_{c}") for c in coarse]).agg(F.min("priority").alias("group_priority"), F.max("matched").alias("group_matched"))
        kept = kept.join(ranks, F.expr(" and ".join(f"{c} <=> _c_{c}" for c in coarse))).drop(*[f"_c_{c}" for c in coarse])
    return kept.withColumn("mirrored_ids", F.array_join(F.array_remove("_ids", F.col(id_col)), ",")).drop("_ids")


def page(rows: DataFrame, order: Sequence[Column], offset: int, limit: int) -> DataFrame:
    """A page of ordered rows; the sort keeps offset + limit rows of each partition only."""
    return rows.orderBy(*order).offset(offset).limit(limit)


def bm25(tokens: DataFrame, terms: Sequence[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(id, score, covered): BM25 over whole texts (higher is better) and how many distinct terms are there.

    Document lengths and frequencies cover the whole table; only postings of the
    terms are joined with them.
    """
    lengths = tokens.groupBy("id").agg(F.sum("count").alias("length"))
    about = lengths.agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("length").alias("mean"))
    postings = tokens.where(F.col("normalized").isin(*terms)).groupBy("id", "normalized").agg(F.sum("count").alias("tf"))
    df = postings.groupBy("normalized").agg(F.count(F.lit(1)).alias("df"))
    scored = postings.join(df, "normalized").join(lengths, "id").crossJoin(F.broadcast(about))  # about: one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    return scored.groupBy("id").agg(F.round(F.sum(part), 6).alias("score"), F.count(F.lit(1)).alias("covered"))


def feedback_terms(tokens: DataFrame, seeds: Sequence, most: int = 30, least_length: int = 4, most_frequent: int = 400) -> DataFrame:
    """The rarest terms of some seed texts that other texts have too: pseudo-relevance feedback."""
    own = tokens.where(F.col("id").isin(*seeds) & (F.length("normalized") >= least_length)).select("normalized").distinct()
    counts = tokens.join(own, "normalized").groupBy("normalized").agg(F.sum("count").alias("count"))
    return counts.where((F.col("count") > 1) & (F.col("count") <= most_frequent)).orderBy("count", "normalized").limit(most)


def all_groups_present(tokens: DataFrame, groups: DataFrame) -> DataFrame:
    """Relational division: identifiers that have at least one key of every group of (gid, key)."""
    wanted = groups.select("gid").distinct().count()
    met = tokens.join(F.broadcast(groups), tokens["normalized"] == groups["key"])  # groups come from one query
    return met.groupBy("id").agg(F.countDistinct("gid").alias("groups")).where(F.col("groups") == wanted)
