"""Exact duplicates by a tree merge of sorted digest runs.

A run is the sorted list of a group of input partitions' digests, with one entry
(digest, length, check, survivor, copies) for each.  Runs are held as arrays,
cut at fixed places of the digest's range into segments of about ``SEGMENT``
entries, so that no task ever holds a whole run: that is one row for each run
and segment.  In a binomial round, ``fan_in`` neighbouring runs exchange their
segments (run r goes to r // fan_in); the sorted arrays that meet are merged -
the sort of arrays that are sorted already is a merge of their runs - and
entries of one digest, which are neighbours then, are made one.  Rounds go on
until one run is left.

A round moves one entry for each digest and run, whatever the number of copies:
a text that a third of all rows hold enters a merge with one entry of each run.
At every level a survivor's digest is verified by the text's UTF-8 length and a
second, unrelated hash: entries are one only where all three agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut

KEY = ["text_sha256", "_bytes", "_check"]
#: Entries of a run that are merged together.
SEGMENT = 2048


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", runs: int = 64) -> DataFrame:
    """One row for each document: identifier, digest, verification and the run (input partition) it belongs to."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("_id"),
        F.unhex(F.sha2(text, 256)).alias("text_sha256"),
        F.octet_length(text).alias("_bytes"),
        F.xxhash64(text).alias("_check"),
        F.pmod(F.spark_partition_id(), F.lit(runs)).alias("_run"),
    )


def merge_sorted(runs: Column, keep: str) -> Column:
    """Sorted runs of entries to one sorted run with one entry for each digest."""
    whole = F.sort_array(F.flatten(runs))  # by digest, length and check, then identifier

    def merged(rows: Column) -> Column:
        same = lambda x, y: (x["text_sha256"] == y["text_sha256"]) & (x["_bytes"] == y["_bytes"]) & (x["_check"] == y["_check"])
        places = F.sequence(F.lit(0), F.size(rows) - 1)
        first = F.filter(places, lambda i: (i == 0) | ~same(F.get(rows, i), F.get(rows, F.greatest(i - 1, F.lit(0)))))
        ends = F.concat(F.slice(first, F.lit(2), F.size(first)), F.array(F.size(rows)))

        def one(start: Column, end: Column) -> Column:
            # nulls sort first: the last is the largest; the smallest is the first that is no null
            own = F.slice(rows, start + 1, end - start)
            known = F.filter(own, lambda x: x["keep_id"].isNotNull())
            best = F.element_at(own, -1) if keep == "largest" else F.coalesce(F.get(known, F.lit(0)), F.get(own, F.lit(0)))
            head = F.get(own, F.lit(0))
            return F.struct(*[head[k].alias(k) for k in KEY], best["keep_id"].alias("keep_id"), F.aggregate(own, F.lit(0).cast("long"), lambda n, x: n + x["group_size"]).alias("group_size"))

        return F.zip_with(first, ends, one)

    return F.element_at(F.transform(F.array(whole), merged), 1)


def merge_runs(rows: DataFrame, keep: str = "largest", runs: int = 64, fan_in: int = 8) -> DataFrame:
    """Merge the runs to one entry for each digest: survivor and group size."""
    pick = F.max if keep == "largest" else F.min
    # copies within a run fall together before anything is sorted into arrays
    level = rows.groupBy("_run", *KEY).agg(pick("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    # segments of the last run hold SEGMENT entries on the average; digests are spread evenly
    segments = max(1, -(-rows.count() // SEGMENT))
    prefix = F.conv(F.hex(F.substring("text_sha256", 1, 6)), 16, 10).cast("decimal(20,0)")
    segment = F.floor(prefix * F.lit(segments).cast("decimal(18,0)") / F.lit(1 << 48)).cast("long")
    entry = F.struct(*KEY, "keep_id", "group_size")
    level = level.withColumn("_segment", segment).groupBy("_run", "_segment").agg(F.sort_array(F.collect_list(entry)).alias("_entries"))
    left = runs
    while left > 1:
        left = -(-left // fan_in)
        met = level.withColumn("_run", F.floor(F.col("_run") / fan_in).cast("int")).groupBy("_run", "_segment").agg(F.collect_list("_entries").alias("_runs"))
        level = met.select("_run", "_segment", merge_sorted(F.col("_runs"), keep).alias("_entries"))
    return level.select(F.explode("_entries").alias("_e")).select("_e.*")


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", runs: int = 64, fan_in: int = 8
) -> DataFrame:
    """One row for each document: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty and form one group with empty texts.  ``keep_id``
    is the largest (or smallest) identifier of the group; null identifiers never
    win unless the whole group has none, and are then kept as one.  Where rows
    repeat with the same identifier, all copies carry the same ``keep_id`` and
    ``kept`` is true for each row with that identifier.  Columns other than the
    identifier and the text are ignored, so their names can't clash.  An empty
    table gives an empty result.
    """
    rows = cut(digests(docs, id_col, text_col, runs))
    groups = cut(merge_runs(rows, keep, runs, fan_in))
    return rows.join(groups, KEY, "left").select(
        F.col("_id").alias("doc_id"),
        "keep_id",
        "group_size",
        F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("text_sha256")).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """The documents without their exact copies, all columns kept; exactly one row stays for each text."""
    groups = merge_runs(cut(digests(docs, id_col, text_col)), keep).select(
        *[F.col(k).alias(f"__{k}") for k in KEY], F.col("keep_id").alias("__keep")
    )
    text = F.coalesce(F.col(text_col), F.lit(""))
    probe = docs.withColumns(
        {"__text_sha256": F.unhex(F.sha2(text, 256)), "__bytes_": F.octet_length(text), "__check_": F.xxhash64(text), "__keep_": F.col(id_col)}
    )
    on = [
        probe["__text_sha256"] == groups["__text_sha256"],
        probe["__bytes_"] == groups["___bytes"],
        probe["__check_"] == groups["___check"],
        probe["__keep_"].eqNullSafe(groups["__keep"]),
    ]
    kept = probe.join(groups, on, "left_semi")
    return kept.dropDuplicates(["__text_sha256", "__bytes_", "__check_", "__keep_"]).select(*docs.columns)
