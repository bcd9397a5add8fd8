"""Document fingerprints: threshold-scaled sketches of word shingles.

A fingerprint keeps every distinct shingle hash below a fixed fraction of the
hash range, so its size follows the document's.  Whether a hash is kept depends
on the hash alone: sketches of parts merge by union, and the share of one sketch
found in another estimates containment even between very unequal documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tessera.llm.common import cut, lower_ascii, words

#: One hash in this many is kept.
SCALE = 4
#: Digits of a hash in a fingerprint string.
DIGITS = 12
#: Documents in a block of the walk in doc_id order, and the largest number of blocks: it bounds what is
#: broadcast (512 KB); with more documents than both together, blocks grow, and a window spills.
BLOCK, MOST_BLOCKS = 1024, 1 << 16


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _shingles(h: Column, width: int) -> Column:
    """Hashes of all runs of ``width`` word hashes, by doubling: runs of 2, 4, ... and then the rest one word at a time."""
    rest = F.lit(1 << 30)  # more words than a text can have

    def grow(runs: Column, length: int) -> Column:
        if length == width:
            return F.slice(runs, F.lit(1), F.size(h) - F.lit(width - 1))
        more = length if 2 * length <= width else 1
        other = F.slice(runs if more == length else h, F.lit(length + 1), rest)
        return _let(F.zip_with(runs, other, lambda a, b: F.xxhash64(a, b)), lambda longer: grow(longer, length + more))

    return grow(h, 1)


def sketch(text: Column, width: int = 5, scale: int = SCALE) -> Column:
    """Sorted distinct 48-bit hashes of the word shingles that fall below 1/scale of the range.

    Words are lower-cased in A-Z.  Fewer words than ``width`` are one shingle; no
    words and null texts give an empty sketch.
    """

    def of_words(h: Column) -> Column:
        hashes = F.when(F.size(h) >= width, _shingles(h, width)).when(F.size(h) > 0, F.array(F.xxhash64(h)))
        kept = F.filter(hashes, lambda x: (x >= 0) & (x < F.lit((1 << 64) // scale)))
        return F.coalesce(F.array_sort(F.array_distinct(F.transform(kept, lambda x: F.shiftrightunsigned(x, 16)))), F.expr("cast(array() as array<bigint>)"))

    return _let(F.transform(words(lower_ascii(text)), lambda w: F.xxhash64(w)), of_words)


def fingerprint(text: Column, hashes: Column) -> Column:
    """A string: a hash of the whole text, then the sketch; equal texts have equal strings."""
    return F.concat_ws(" ", F.lower(F.hex(F.xxhash64(text))), F.array_join(F.transform(hashes, lambda x: F.lower(F.lpad(F.hex(x), DIGITS, "0"))), ""))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has too; null if a's sketch is empty."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a))


def likeness(a: Column, b: Column, text_a: Column, text_b: Column) -> Column:
    """Estimated Jaccard similarity of two documents, 0 to 1; where both sketches are empty, 1 for equal texts, else 0."""
    shared = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - shared
    return F.when(union > 0, shared / union).otherwise(F.when(text_a == text_b, 1.0).otherwise(0.0))


def _blocked(rows: DataFrame, bounds: DataFrame) -> DataFrame:
    """Add the number of bounds that are not above the identifier, by bisection: sixteen looks at most, however many bounds there are."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(MOST_BLOCKS.bit_length()))])
    found = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get("_bounds", at + step - 1) <= F.col("doc_id"), at + step).otherwise(at))
    return rows.crossJoin(F.broadcast(bounds)).withColumn("_block", found).drop("_bounds")  # bounds: one row


def _next_rows(rows: DataFrame, bounds: DataFrame) -> DataFrame:
    """Add ``_next`` (the next row's text and sketch by doc_id, after the last the first) without ever sorting all rows in one task.

    Rows are cut into blocks of consecutive identifiers at known bounds; within a
    block the next row follows by a window, the last row of a block gets the
    first row of the next block.
    """
    window = Window.partitionBy("_block").orderBy(F.col("doc_id").asc_nulls_first(), "_check")
    return _blocked(rows, bounds).withColumn("_next", F.lead(F.struct("text", "_sketch")).over(window))


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, scale: int = SCALE) -> DataFrame:
    """One row for each document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, contained_in_next.

    The edited text has its last floor(n_chars / 2) code points replaced by the
    first as many (or all) of the next document by doc_id; after the last comes
    the first.  Null texts count as empty.  Equal identifiers follow in order of
    a hash of their text, null identifiers come first; a lone document is its own
    next.  An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType
    if isinstance(kind, IntegralType):
        blocks = max(1, min(rows.count() // BLOCK, MOST_BLOCKS))
        at = F.approx_percentile("doc_id", [i / blocks for i in range(blocks)], F.lit(max(1000, 10 * blocks)))
        bounds = rows.agg(at.alias("at")).select(F.array_distinct("at").alias("_bounds"))
    else:  # identifiers that have no percentiles: bounds are drawn from the rows, a few thousand of them
        total = max(1, rows.count())
        drawn = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, total // 4096))) == 0).select("doc_id").distinct()
        bounds = drawn.agg(F.array_sort(F.collect_list("doc_id")).alias("_bounds"))
    bounds = cut(bounds.select(F.coalesce("_bounds", F.expr(f"cast(array() as array<{kind.simpleString()}>)")).alias("_bounds")))
    rows = rows.withColumn("_check", F.xxhash64("text"))
    linked = _next_rows(rows.withColumn("_sketch", sketch(F.col("text"), width, scale)), bounds)

    # the first row of each block, moved to the block before it; the first of all to the last
    ahead = F.struct(F.col("doc_id").isNotNull().alias("known"), F.col("doc_id").alias("id"), F.col("_check").alias("check"))
    heads = cut(_blocked(rows, bounds).groupBy("_block").agg(F.min(ahead).alias("_head")))  # one row for each block
    same = rows["doc_id"].eqNullSafe(heads["_head.id"]) & (rows["_check"] == heads["_head.check"])
    around = Window.orderBy("_block")  # of blocks, MOST_BLOCKS at most
    before = F.coalesce(F.lag("_block").over(around), F.max("_block").over(Window.partitionBy()))
    heads = cut(heads.withColumn("_block_", before))
    heads = rows.join(F.broadcast(heads), same).groupBy("_block_").agg(F.first("text").alias("_text"))
    follow = cut(heads.select("_block_", F.struct(F.col("_text").alias("text"), sketch(F.col("_text"), width, scale).alias("_sketch")).alias("_follow")))
    joined = linked.join(follow, F.col("_block") == F.col("_block_"), "left")
    after = F.coalesce(F.col("_next"), F.col("_follow"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(after["text"], F.lit(1), half))
    return (
        joined.withColumn("_after", after["_sketch"])
        .withColumn("_after_text", after["text"])
        .withColumn("_edited", edited)
        .withColumn("_edited_sketch", sketch(F.col("_edited"), width, scale))
        .select(
            "doc_id",
            n.cast("long").alias("n_chars"),
            F.sha2("_edited", 256).alias("edited_sha256"),
            fingerprint(F.col("text"), F.col("_sketch")).alias("fingerprint"),
            fingerprint(F.col("_edited"), F.col("_edited_sketch")).alias("edited_fingerprint"),
            likeness(F.col("_sketch"), F.col("_edited_sketch"), F.col("text"), F.col("_edited")).alias("near_edited"),
            likeness(F.col("_sketch"), F.col("_after"), F.col("text"), F.col("_after_text")).alias("near_next"),
            containment(F.col("_sketch"), F.col("_after")).alias("contained_in_next"),
        )
    )
