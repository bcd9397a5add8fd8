"""URL rules by a sort-merge range join over reversed-host keys.

A rule (host, path) fits its host and all subdomains when the url's path starts
with the rule's.  Its canonical key is the host with labels reversed, a
separator and the path; the urls it fits are an interval of keys, because
everything behind the key shares it as a prefix.  A url has one key for each
host suffix at a label boundary, so subdomains need no interval of their own.

Rules and url keys are sorted together and swept once.  At a rule, the stack of
active nested rules is the rules whose key is a prefix of this one's; since
prefix intervals nest, the rules active at a url are the stack of the last rule
before it, less those that have ended.  The stack at each rule is found once on
the rules' side; the sweep carries the last rule along with a window function
and picks the deepest entry that still covers the url.

Rules are cut into blocks of consecutive keys, each block carrying the stack
that is open at its start; url keys go to the block they fall in and, within a
block, to one of ``spread`` equal parts that each see all rules of the block,
so that one host with most of the pages is no hot spot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut, lower_ascii, shuffle_partitions

#: Separates host and path in a key; sorts before all that hosts and paths hold.
MARK = "\x01"
#: Rules in a block of the sweep.
BLOCK = 4096


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path: both empty for null urls and urls without ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return lower_ascii(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def reversed_host(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, "\\.")), ".")


def rule_stacks(rules: DataFrame) -> DataFrame:
    """Rules (host, path, verdict) with canonical keys and stacks of the rules that enclose them, outermost first.

    Rules that repeat count once; block wins over allow where they disagree.
    """
    key = F.concat(reversed_host(lower_ascii(F.col("host"))), F.lit(MARK), F.col("path"))
    own = (
        rules.where(F.col("host").isNotNull() & F.col("path").isNotNull())
        .groupBy(key.alias("_key"))
        .agg(F.max_by("verdict", F.when(F.col("verdict") == "block", 1).otherwise(0)).alias("verdict"), F.min(F.concat(lower_ascii(F.col("host")), "path")).alias("rule"))
    )
    # rules whose keys are prefixes of this one's: equality joins on the prefix lengths that exist, host part always whole
    host_part = F.instr(F.col("_key"), MARK)
    prefixes = F.transform(F.sequence(host_part, F.length("_key")), lambda n: F.substring(F.col("_key"), F.lit(1), n))
    entry = F.struct(F.length("_outer").alias("depth"), F.col("_outer").alias("key"), F.col("_rule").alias("rule"), F.col("_verdict").alias("verdict"))
    outer = own.select(F.col("_key").alias("_outer"), F.col("rule").alias("_rule"), F.col("verdict").alias("_verdict"))
    return (
        own.select("_key", F.explode(prefixes).alias("_outer"))
        .join(outer, "_outer")
        .groupBy("_key")
        .agg(F.array_sort(F.collect_list(entry)).alias("_stack"))
    )


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url", spread: int | None = None) -> DataFrame:
    """One row for each page: page_id, host, path, rule, verdict.

    The longest fitting rule wins (host and path together; between equals the
    longer host).  Urls that no rule fits, null urls and urls without ``://``
    get a null rule and the default verdict.  Repeated rows and null identifiers
    are judged each on its own; other columns are ignored; an empty table gives
    an empty result, an empty rule table the default for all.
    """
    spread = spread or shuffle_partitions(pages.sparkSession)
    stacks = cut(rule_stacks(rules))
    # blocks of consecutive rules; there is one boundary for BLOCK rules
    numbered = stacks.withColumn("_block", F.floor((F.row_number().over(Window.orderBy("_key")) - 1) / BLOCK).cast("int"))
    numbered = cut(numbered)
    starts = numbered.groupBy("_block").agg(F.min("_key").alias("_from"))
    bounds = starts.agg(F.array_sort(F.collect_list("_from")).alias("_bounds"))
    # no rule has more labels than this, so longer suffixes of a host meet none
    deepest = stacks.agg(F.coalesce(F.max(F.size(F.split(F.split_part("_key", F.lit(MARK), F.lit(1)), "\\."))), F.lit(1)).alias("_deepest"))

    host, path = split_url(F.col(url_col))
    judged = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path")).withColumn("_row", F.monotonically_increasing_id())
    backwards = F.reverse(F.split("host", "\\."))
    suffixes = F.transform(F.sequence(F.lit(1), F.size("_labels")), lambda n: F.struct(n.alias("n"), F.array_join(F.slice("_labels", 1, n), ".").alias("h")))
    keyed = (
        judged.crossJoin(F.broadcast(bounds.crossJoin(deepest)))  # one row
        .withColumn("_labels", F.slice(backwards, F.lit(1), F.col("_deepest")))
        .select("page_id", "host", "path", "_row", "_bounds", F.explode(suffixes).alias("_s"))
        .withColumn("_key", F.concat(F.col("_s.h"), F.lit(MARK), "path"))
        .withColumn("_block", F.greatest(F.size(F.filter("_bounds", lambda b: b <= F.col("_key"))) - 1, F.lit(0)))
        .withColumn("_part", F.pmod(F.col("_row"), F.lit(spread)).cast("int"))
        .drop("_bounds", "_s")
    )
    events = keyed.select("_block", "_part", "_key", F.lit(1).alias("_kind"), "page_id", "host", "path", "_row").unionByName(
        numbered.select("_block", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))).alias("_part"), "_key", F.lit(0).alias("_kind"), "_stack"),
        allowMissingColumns=True,
    )
    sweep = Window.partitionBy("_block", "_part").orderBy("_key", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    active = F.filter(F.last("_stack", ignorenulls=True).over(sweep), lambda r: F.col("_key").startswith(r["key"]))
    best = F.element_at(F.col("_active"), -1)
    rank = F.struct(F.length(best["rule"]).alias("length"), F.instr(best["rule"], "/").alias("host_end"), best["rule"].alias("rule"), best["verdict"].alias("verdict"))
    swept = events.withColumn("_active", active).where(F.col("_kind") == 1)
    return (
        swept.withColumn("_best", F.when(F.size("_active") > 0, rank))
        .groupBy("_row")
        .agg(F.first("page_id").alias("page_id"), F.first("host").alias("host"), F.first("path").alias("path"), F.max("_best").alias("_best"))
        .select("page_id", "host", "path", F.col("_best.rule").alias("rule"), F.coalesce(F.col("_best.verdict"), F.lit(default)).alias("verdict"))
    )
