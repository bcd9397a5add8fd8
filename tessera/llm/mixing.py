"""Mixing sources to target weights by pivotal dependent rounding.

A source's target divided by its size is the expected number of copies of each
of its documents.  The whole part is taken at once; the fractional part is a
probability, and pivotal rounding turns the probabilities into 0 or 1: two
documents meet, mass moves at random from one to the other until one is
integral, and the other goes on to the next meeting.  The mass is counted in
words, so meetings between documents of any sizes keep the number of words that
a source gives; only the last document of a source is rounded alone.

The meetings form a reduction tree.  At every level the open documents of a
source are put into groups of ``fan_in``; a group is rounded in one expression
and hands at most one open document, its residual, up to the next level.  No
group grows with the data, and a source that holds most rows only has more
groups.  All randomness is a hash of seed, level and document, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut, word_count

#: A word has this many parts, so transfers are exact in whole numbers.
UNIT = 1 << 24
#: Rows of one source that are ordered by size together.
BUCKET = 2048


def targets(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Add each source's target to (source, source_size): one row for each source, no text.

    Shares go by weight; what exceeds ``most`` times a source's size is shared
    again by weight among the others.  That ends at one level L with target =
    min(most * size, L * weight); L follows from sources in the order in which
    they fill up.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1)
    ranked = sizes.withColumn("_weight", weight).withColumn("_cap", F.col("source_size") * F.lit(float(most)))
    filling = Window.orderBy(F.col("_cap") / F.col("_weight"), F.col("source").asc_nulls_last())
    full = filling.rowsBetween(Window.unboundedPreceding, -1)
    rest = filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    budget = F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share))
    level = (budget - F.coalesce(F.sum("_cap").over(full), F.lit(0.0))) / F.sum("_weight").over(rest)
    solved = ranked.withColumn("_level", level).withColumn("_open", F.col("_level") * F.col("_weight") <= F.col("_cap"))
    least = F.min(F.when(F.col("_open"), F.struct((F.col("_cap") / F.col("_weight")).alias("at"), F.col("_level").alias("level")))).over(Window.partitionBy())
    return solved.select(
        "source",
        "source_size",
        F.least(F.col("_cap"), F.coalesce(least["level"] * F.col("_weight"), F.col("_cap"))).alias("target"),
    )


def _round_group(members: Column, seed: int, level: int) -> Column:
    """Pivotal rounding along an ordered array of (key, hash, full, mass): the decided (key, up) and what stays open.

    ``mass`` of ``full`` are the words that a document is expected to give, in
    parts of UNIT.  In a meeting either mass flows from the first to the second
    until one is 0 or full, or the other way round; the odds keep each one's
    expectation, and the sum never changes.
    """

    def meet(state: Column, new: Column) -> Column:
        old = state["open"]
        forth = F.least(old["mass"], new["full"] - new["mass"])
        back = F.least(new["mass"], old["full"] - old["mass"])
        draw = F.pmod(F.xxhash64(F.lit(seed), F.lit(level), old["hash"], new["hash"]), F.lit(UNIT))
        to_new = draw * (forth + back) < back * F.lit(float(UNIT))
        old_mass = F.when(to_new, old["mass"] - forth).otherwise(old["mass"] + back)
        new_mass = F.when(to_new, new["mass"] + forth).otherwise(new["mass"] - back)
        old_settles = F.when(to_new, old_mass == 0).otherwise(new_mass != 0)
        settled = F.struct(
            F.when(old_settles, old["key"]).otherwise(new["key"]).alias("key"),
            F.when(old_settles, old_mass > 0).otherwise(new_mass > 0).alias("up"),
        )
        goes_on = F.struct(
            *[F.when(old_settles, new[f]).otherwise(old[f]).alias(f) for f in ("key", "hash", "full")],
            F.when(old_settles, new_mass).otherwise(old_mass).alias("mass"),
        )
        return F.struct(
            F.when(old.isNull(), state["done"]).otherwise(F.concat(state["done"], F.array(settled))).alias("done"),
            F.when(old.isNull(), new).otherwise(goes_on).alias("open"),
        )

    start = F.struct(
        F.expr("cast(array() as array<struct<key: bigint, up: boolean>>)").alias("done"),
        F.expr("cast(null as struct<key: bigint, hash: bigint, full: bigint, mass: bigint>)").alias("open"),
    )
    return F.aggregate(members, start, meet)


def pivotal(rows: DataFrame, seed: int = 17, fan_in: int = 64) -> DataFrame:
    """Round rows (_source, key, hash, full, mass) with 0 < mass < full: (key, up)."""
    decided, level = [], 0
    while True:
        counts = cut(rows.groupBy("_source").agg(F.count(F.lit(1)).alias("_n")))
        largest = counts.agg(F.max("_n")).first()[0] or 0
        salts = F.greatest(F.ceil(F.col("_n") / BUCKET), F.lit(1))
        # one key for source and salt: with two, the join's distribution by source would do for the window
        salted = rows.join(counts, "_source").withColumn("_bucket", F.struct("_source", F.pmod(F.xxhash64(F.lit(seed), F.col("hash")), salts).alias("salt")))
        order = Window.partitionBy("_bucket").orderBy(F.desc("full"), F.desc("hash"), F.desc("key"))
        done = cut(
            salted.withColumn("_group", F.floor((F.row_number().over(order) - 1) / fan_in))
            .groupBy("_bucket", "_group")
            .agg(F.sort_array(F.collect_list(F.struct("full", "hash", "key", "mass")), asc=False).alias("_members"))
            .select(F.col("_bucket._source").alias("_source"), F.transform("_members", lambda m: F.struct(*[m[f].alias(f) for f in ("key", "hash", "full", "mass")])).alias("_members"))
            .select("_source", _round_group(F.col("_members"), seed, level).alias("_state"))
        )
        decided.append(done.select(F.explode("_state.done").alias("_d")).select("_d.key", "_d.up"))
        rest = done.select("_source", "_state.open.*")
        certain = (F.col("mass") <= 0) | (F.col("mass") >= F.col("full"))
        decided.append(rest.where(certain).select("key", (F.col("mass") > 0).alias("up")))
        rows = rest.where(~certain)
        if largest <= fan_in:  # one group for each source: the root decides by a draw
            draw = F.pmod(F.xxhash64(F.lit(seed), F.lit(-1), F.col("hash")), F.lit(UNIT))
            decided.append(rows.select("key", (draw * F.col("full") < F.col("mass") * F.lit(float(UNIT))).alias("up")))
            break
        level += 1
    out = decided[0]
    for more in decided[1:]:
        out = out.unionByName(more)
    return out


def mix_sources(
    docs: DataFrame,
    weights: Sequence[int] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 17,
    fan_in: int = 64,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row for each document: doc_id, source, size, source_size, target, copies, taken.

    Size is the number of words; null, empty and blank texts have size 0 and
    are copied as often as the whole part of the rate says, which adds no words.  A null source is a
    source of its own, last in order.  Rows that repeat, identifier included,
    are rounded each on its own.  Sources whose documents are all empty have
    target 0 and take nothing.  An empty table gives an empty result.
    """
    sized = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size")
    )
    # the row number only tells rows that repeat apart; draws and order come from what a row holds
    rows = cut(sized.withColumn("_row", F.monotonically_increasing_id()))
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = cut(targets(totals, weights, share, most))
    rate = F.coalesce(F.col("target") / F.when(F.col("source_size") > 0, F.col("source_size")), F.lit(0.0))
    whole = F.floor(rate).cast("int")
    parts = F.round((rate - F.floor(rate)) * UNIT).cast("long")
    priced = rows.join(goals.withColumnRenamed("source", "_name"), F.col("source").eqNullSafe(F.col("_name"))).drop("_name")
    priced = priced.withColumn("_whole", whole + F.when(parts >= UNIT, 1).otherwise(0)).withColumn("_p", F.when(parts >= UNIT, F.lit(0)).otherwise(parts))
    name = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("null"))
    open_rows = priced.where((F.col("_p") > 0) & (F.col("size") > 0)).select(
        name.alias("_source"),
        F.col("_row").alias("key"),
        F.xxhash64("doc_id", "size", "source").alias("hash"),
        (F.col("size") * UNIT).alias("full"),
        (F.col("size") * F.col("_p")).alias("mass"),
    )
    chosen = pivotal(open_rows, seed, fan_in)
    copies = F.col("_whole") + F.when(F.col("up"), 1).otherwise(0)
    return priced.join(chosen, F.col("_row") == F.col("key"), "left").select(
        "doc_id", "source", "size", "source_size", "target", copies.cast("int").alias("copies"), (copies * F.col("size")).cast("long").alias("taken")
    )


def mixed_documents(
    docs: DataFrame,
    weights: Sequence[int] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """The mix itself: every document as many times as it is taken, all columns kept."""
    named = docs.withColumn("__text_key", F.xxhash64(F.col(text_col)))
    keyed = named.select(F.struct(F.col(id_col), F.col("__text_key")).alias("__key"), F.col(text_col), F.col(source_col))
    told = mix_sources(keyed, weights, share, most, seed, id_col="__key", text_col=text_col, source_col=source_col)
    told = told.groupBy(F.col("doc_id").alias("__taken")).agg(F.sum("copies").cast("int").alias("__copies")).where("__copies > 0")
    # rows that repeat have their copies added up and are there once before they are multiplied
    single = named.withColumn("__key", F.struct(F.col(id_col), F.col("__text_key"))).dropDuplicates(["__key"])
    chosen = single.join(told, F.col("__key") == F.col("__taken"))
    return chosen.withColumn("__n", F.explode(F.array_repeat(F.lit(0), F.col("__copies")))).select(*docs.columns)
