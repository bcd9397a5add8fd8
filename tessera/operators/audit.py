"""Row audits, verdicts, differences between snapshots, repairs, coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.stored import materialized


def findings(rows: DataFrame, id_col: str, rules: Sequence[tuple[str, str, Column]]) -> DataFrame:
    """(id, severity, code) for every rule (code, severity, broken) that a row breaks; all rules in one pass."""
    broken = F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"))) for code, severity, bad in rules])
    told = rows.select(F.col(id_col).alias("id"), F.explode(F.filter(broken, lambda x: x.isNotNull())).alias("_f"))
    return told.select("id", "_f.severity", "_f.code")


def verdicts(rows: DataFrame, found: DataFrame, group: str, id_col: str) -> DataFrame:
    """Per group: rows, errors, warnings and FAIL, WARN or PASS."""
    counts = found.groupBy("id").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    joined = rows.select(F.col(group), F.col(id_col).alias("id")).join(counts, "id", "left")
    out = joined.groupBy(group).agg(F.count(F.lit(1)).alias("records"), F.coalesce(F.sum("errors"), F.lit(0)).alias("errors"), F.coalesce(F.sum("warnings"), F.lit(0)).alias("warnings"))
    return out.withColumn("verdict", F.when(F.col("errors") > 0, "FAIL").when(F.col("warnings") > 0, "WARN").otherwise("PASS"))


def duplicate_ids(rows: DataFrame, id_col: str) -> DataFrame:
    return rows.groupBy(F.col(id_col).alias("id")).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1)


def snapshot_diff(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, change, changed_fields) of rows added, removed or changed."""
    fields = [c for c in before.columns if c != key]
    old, new = before.select(key, *[F.col(c).alias(f"_o_{c}") for c in fields], F.lit(True).alias("_old")), after.select(key, *[F.col(c).alias(f"_n_{c}") for c in fields], F.lit(True).alias("_new"))
    joined = old.join(new, key, "full")
    changed = F.array_join(F.filter(F.array(*[F.when(~F.col(f"_o_{c}").eqNullSafe(F.col(f"_n_{c}")), F.lit(c)) for c in fields]), lambda x: x.isNotNull()), ",")
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").otherwise("changed")
    out = joined.select(key, change.alias("change"), changed.alias("_fields"))
    return out.where("change != 'changed' or _fields != ''").select(key, "change", F.when(F.col("change") == "changed", F.col("_fields")).otherwise("").alias("changed_fields"))


def table_difference(one: DataFrame, two: DataFrame) -> DataFrame:
    """Rows in excess on either side, with multiplicity: empty where the tables are equal."""
    return one.exceptAll(two).withColumn("side", F.lit("left")).unionByName(two.exceptAll(one).withColumn("side", F.lit("right")))


def table_fingerprint(rows: DataFrame) -> DataFrame:
    """One row: count and an order-free hash of a table."""
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.bit_xor(F.xxhash64(*rows.columns)).alias("fingerprint"))


def stale_tokens(expected: DataFrame, stored: DataFrame) -> DataFrame:
    """Identifiers whose stored token counts differ from the expected ones, with the number of differing forms."""
    a, b = expected.select("id", "form", F.col("count").alias("_e")), stored.select("id", "form", F.col("count").alias("_s"))
    return a.join(b, ["id", "form"], "full").where(~F.col("_e").eqNullSafe(F.col("_s"))).groupBy("id").agg(F.count(F.lit(1)).alias("differing"))


def replace_touched(table: DataFrame, fresh: DataFrame, key: str, touched: DataFrame) -> DataFrame:
    """A derived table in which only the rows of touched keys are exchanged for fresh ones."""
    return table.join(touched.select(key).distinct(), key, "left_anti").unionByName(fresh.join(touched.select(key).distinct(), key, "left_semi"))


def upsert(table: DataFrame, news: DataFrame, key: str) -> DataFrame:
    """News replace rows with the same key; the rest stays."""
    return table.join(news.select(key).distinct(), key, "left_anti").unionByName(news)


def incremental(rows: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows that no checkpoint has yet in this version."""
    return rows.join(done.select(*keys).distinct(), list(keys), "left_anti")


def coverage(rows: DataFrame, by: Sequence[str], over: str, values: Sequence[str]) -> DataFrame:
    """Counts of each value side by side, and in all."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col(over) == v).alias(f"n_{v}") for v in values])


def reconcile(rows: DataFrame, found: DataFrame, by: str, *more: Column) -> DataFrame:
    """Per group: rows, how many the other store has, their share and whether that is all, some or none."""
    own = rows.groupBy(by).agg(F.count(F.lit(1)).alias("rows"), *more)
    other = found.groupBy(F.col(by).alias("_by")).agg(F.count(F.lit(1)).alias("_present"))
    joined = own.join(other, F.col(by).eqNullSafe(F.col("_by")), "left").withColumn("present", F.coalesce("_present", F.lit(0)))
    state = F.when(F.col("present") == 0, "missing").when(F.col("present") < F.col("rows"), "partial").otherwise("complete")
    return joined.withColumns({"share": F.round(F.col("present") / F.col("rows"), 4), "state": state}).drop("_by", "_present")


def patched(tokens: DataFrame, vocabulary: DataFrame, news: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Token table and vocabulary after the tokens of new texts came in; only keys that these hold are counted anew.

    ``tokens`` (id, form, normalized, count), ``vocabulary`` (normalized, form,
    count).  The rows of other keys are taken over as they are.
    """
    grown = tokens.unionByName(news.select(*tokens.columns))
    touched = news.select("normalized").distinct()
    own = grown.join(touched, "normalized", "left_semi")
    fresh = own.groupBy("normalized").agg(F.min("form").alias("form"), F.sum("count").alias("count"))
    return grown, replace_touched(vocabulary, fresh.select(*vocabulary.columns), "normalized", touched)


def appended_works(works: DataFrame, additions: DataFrame, key: Sequence[str], order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(works, placed additions): counts of touched works grown, and the new rows placed behind the old ones.

    ``works``: the key and ``count``.  New works begin at 0.
    """
    place = F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1
    before = works.select(*[F.col(k).alias(f"_{k}") for k in key], F.col("count").alias("_count"))
    same = F.expr(" and ".join(f"{k} <=> _{k}" for k in key))
    placed = additions.withColumn("_place", place).join(before, same, "left").withColumn("sequence", F.col("_place") + F.coalesce("_count", F.lit(0)))
    more = additions.groupBy(*key).agg(F.count(F.lit(1)).alias("count"))
    grown = works.select(*key, "count").unionByName(more).groupBy(*key).agg(F.sum("count").alias("count"))
    return grown, placed.select(*additions.columns, "sequence")


def with_ordinals(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Rows numbered from 0 in a total order, without bringing them into one task.

    Ranges of the order are stored, counted, and each numbered by itself from
    the number of rows in the ranges before.
    """
    ranges = materialized(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = sorted((r["_range"], r["n"]) for r in ranges.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).collect())  # one row for each range
    starts, total = [], 0
    for number, n in sizes:
        starts.append((number, total))
        total += n
    offsets = rows.sparkSession.createDataFrame(starts, "_of int, _start long")
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return ranges.withColumn("_inside", inside).join(F.broadcast(offsets), F.col("_range") == F.col("_of")).withColumn("ordinal", F.col("_start") + F.col("_inside")).drop("_range", "_inside", "_of", "_start")


def zipped(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two numbered tables side by side (``ordinal``, and structs left and right); tables of different lengths fail the query."""
    a = left.select("ordinal", F.struct(*[c for c in left.columns if c != "ordinal"]).alias("left"))
    b = right.select(F.col("ordinal").alias("_ordinal"), F.struct(*[c for c in right.columns if c != "ordinal"]).alias("right"))
    both = a.join(b, F.col("ordinal") == F.col("_ordinal"), "full")
    whole = F.when(F.col("ordinal").isNull() | F.col("_ordinal").isNull(), F.raise_error(F.lit("the tables have different lengths")).cast("boolean")).otherwise(True)
    return both.where(whole).drop("_ordinal")
