"""Claims, form edges, dictionaries: lookups over typed records and the links between them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def related(rows: DataFrame, links: Sequence[tuple[str, Column, int]], id_col: str, seeds: DataFrame) -> DataFrame:
    """Rows that share a subject, a passage or a form with seed rows: one equality join for each kind of link, best kind first.

    ``links``: name, key column and priority of each kind.
    """
    found = None
    for name, key, priority in links:
        keyed = rows.select(F.col(id_col).alias("related_id"), key.alias("_key")).where("_key is not null")
        own = seeds.select(F.col(id_col).alias("seed_id"), key.alias("_key")).where("_key is not null").distinct()
        hits = own.join(keyed, "_key").where("seed_id != related_id").select("seed_id", "related_id", F.lit(priority).alias("priority"), F.lit(name).alias("strength"))
        found = hits if found is None else found.unionByName(hits)
    return found.groupBy("seed_id", "related_id").agg(F.min(F.struct("priority", "strength")).alias("_best")).select("seed_id", "related_id", "_best.priority", "_best.strength")


def form_edges(claims: DataFrame, id_col: str, forms_col: str) -> DataFrame:
    """(claim_id, ordinal, form, normalized): the forms that a claim lists, in order."""
    rows = claims.select(F.col(id_col).alias("claim_id"), F.posexplode(forms_col).alias("ordinal", "form"))
    return rows.withColumn("normalized", F.lower("form"))


def dictionary_keys(entries: DataFrame) -> DataFrame:
    """(id, headword, forms) to lookup rows (key, entry_id, kind, form_index)."""
    head = entries.select(F.lower("headword").alias("key"), F.col("id").alias("entry_id"), F.lit("headword").alias("kind"), F.lit(None).cast("int").alias("form_index"))
    listed = entries.select(F.col("id").alias("entry_id"), F.posexplode("forms").alias("form_index", "_form")).select(F.lower("_form").alias("key"), "entry_id", F.lit("listed_form").alias("kind"), "form_index")
    return head.unionByName(listed)


def dictionary_lookup(keys: DataFrame, key: str, limit: int = 20, most_forms: int = 5) -> DataFrame:
    """Entries of a key: those with it as headword first, each with its first matching forms."""
    hits = keys.where(F.col("key") == key)
    rank = F.min(F.when(F.col("kind") == "headword", 0).otherwise(1))
    return hits.groupBy("entry_id").agg(rank.alias("rank"), F.slice(F.array_sort(F.collect_set("form_index")), 1, most_forms).alias("matched_forms")).orderBy("rank", "entry_id").limit(limit)


def unambiguous(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Keys that have one value only, with it."""
    return rows.groupBy(key).agg(F.countDistinct(value).alias("_n"), F.min(value).alias(value)).where("_n = 1").drop("_n")


def conflicts(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Keys that have several values: an alias table with any is refused."""
    return rows.groupBy(key).agg(F.countDistinct(value).alias("values")).where("values > 1")


def mutually_unique(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """Pairs whose both ends occur in no other pair."""
    one = F.count(F.lit(1)).over(Window.partitionBy(left))
    two = F.count(F.lit(1)).over(Window.partitionBy(right))
    return pairs.distinct().withColumns({"_l": one, "_r": two}).where("_l = 1 and _r = 1").drop("_l", "_r")


def inventory(rows: DataFrame, group: Sequence[str], form: str, location: str, most_forms: int = 50, most_locations: int = 20) -> DataFrame:
    """Per group: its forms and places, the first of each, with totals and whether something is left out.

    Lists are bounded before they are gathered, so a large group stays small.
    """
    counted = rows.groupBy(*group, form).agg(F.count(F.lit(1)).alias("_n"), F.min(location).alias("_first"))
    order = F.row_number().over(Window.partitionBy(*group).orderBy(form))
    kept = counted.withColumn("_order", order)
    forms = kept.groupBy(*group).agg(
        F.count(F.lit(1)).alias("forms_total"),
        F.sum("_n").alias("occurrences"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("_order") <= most_forms, F.col(form)))), ",").alias("forms"),
    )
    place = F.row_number().over(Window.partitionBy(*group).orderBy(location))
    places = rows.select(*group, location).distinct().withColumn("_order", place).where(F.col("_order") <= most_locations)
    listed = places.groupBy(*group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(location)), lambda x: x.cast("string")), ",").alias("locations"))
    return forms.join(listed, list(group)).withColumn("truncated", F.col("forms_total") > most_forms)


def carry_forward(rows: DataFrame, partition: Sequence[str], order: Sequence[str], value: Column) -> Column:
    """The last value that is not null so far: headings that hold for the lines below them."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))


def claims_of_entries(entries: DataFrame, dialects: Sequence[str]) -> DataFrame:
    """Dictionary entries (id, headword, forms<form, tags>, senses<gloss, tags, form_of>) to typed claims (claim_id, entry_id, predicate, value, locator)."""
    entries = entries.withColumnRenamed("id", "entry_id")
    base = F.col("entry_id")
    allowed = lambda tags: F.filter(tags, lambda t: t.isin(*dialects))
    forms = entries.select(base, F.posexplode("forms").alias("i", "f"))
    senses = entries.select(base, F.posexplode("senses").alias("i", "s"))
    at = lambda kind: F.concat(F.lit(f"/{kind}/"), F.col("i").cast("string"))
    parts = [
        entries.select(base, F.lit("lemma").alias("predicate"), F.col("headword").alias("value"), F.lit("/word").alias("locator")),
        entries.where(F.size("forms") > 0).select(base, F.lit("morphology").alias("predicate"), F.array_join(F.transform("forms", lambda f: f["form"]), ",").alias("value"), F.lit("/forms").alias("locator")),
        forms.select(base, F.lit("dialect_label").alias("predicate"), F.explode(allowed(F.col("f.tags"))).alias("value"), at("forms").alias("locator")),
        senses.select(base, F.lit("dialect_label").alias("predicate"), F.explode(allowed(F.col("s.tags"))).alias("value"), at("senses").alias("locator")),
        senses.where("s.gloss is not null and trim(s.gloss) != ''").select(base, F.lit("sense_gloss").alias("predicate"), F.col("s.gloss").alias("value"), at("senses").alias("locator")),
        senses.where("s.form_of is not null").select(base, F.lit("equivalent_form").alias("predicate"), F.col("s.form_of").alias("value"), at("senses").alias("locator")),
    ]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out.withColumn("claim_id", F.substring(F.sha2(F.concat_ws("\u001f", "entry_id", "predicate", "value", "locator"), 256), 1, 24))
