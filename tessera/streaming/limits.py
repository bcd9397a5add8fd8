"""Rate limits: attempts in a window before each one, and admission that depends on what was admitted before."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

DECISION = "user_id long, event_id long, at long, admitted boolean, reason string, retry_after long"
STATE = "recent array<long>, day long, today long"


def epoch(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def attempts_before(events: DataFrame, seconds: int, user: str = "user_id", ts: str = "ts") -> DataFrame:
    """Add, for each event, the attempts of its user in the window that ends with it and the oldest of them."""
    window = Window.partitionBy(user).orderBy("_at").rangeBetween(-seconds * 1_000_000, 0)
    rows = events.withColumn("_at", epoch(ts))
    return rows.withColumns({"attempts": F.count(F.lit(1)).over(window), "oldest": F.min("_at").over(window)}).drop("_at")


def attempts_today(events: DataFrame, user: str = "user_id", ts: str = "ts") -> DataFrame:
    """Add the number of a user's attempts since the start of the UTC day, itself included."""
    window = Window.partitionBy(user, F.to_date(ts)).orderBy("_at").rangeBetween(Window.unboundedPreceding, 0)
    return events.withColumn("_at", epoch(ts)).withColumn("today", F.count(F.lit(1)).over(window)).drop("_at")


def sessions(events: DataFrame, gap_seconds: int, user: str = "user_id", ts: str = "ts") -> DataFrame:
    """Runs of a user's events without a longer gap: start, end and number of events."""
    order = Window.partitionBy(user).orderBy("_at", "event_id")
    rows = events.withColumn("_at", epoch(ts))
    new = F.when(F.col("_at") - F.lag("_at").over(order) > gap_seconds * 1_000_000, 1).otherwise(0)
    numbered = rows.withColumn("_new", new).withColumn("session", F.sum("_new").over(order))
    return numbered.groupBy(user, "session").agg(F.min(ts).alias("first_at"), F.max(ts).alias("last_at"), F.count(F.lit(1)).alias("events"))


def overlapping_leases(leases: DataFrame) -> DataFrame:
    """(id, start, end) with how many leases are open when each starts: one pass over starts and ends, by day and then within it."""
    points = leases.select("id", F.col("start").alias("at"), F.lit(1).alias("step")).unionByName(leases.select("id", F.col("end").alias("at"), F.lit(-1).alias("step")))
    points = points.withColumn("day", F.floor(F.col("at") / 86_400_000_000))
    days = points.groupBy("day").agg(F.sum("step").alias("net"))  # one row for each day
    before = days.select(F.col("day").alias("_day"), F.coalesce(F.sum("net").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("carried"))
    within = Window.partitionBy("day").orderBy("at", "step", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return points.withColumn("open", F.sum("step").over(within)).join(before, F.col("day") == F.col("_day")).where("step = 1").select("id", (F.col("open") + F.col("carried")).alias("open"))


def decide(at: int, recent: list[int], day: int, today: int, per_minute: int, per_day: int) -> tuple[bool, str | None, int, list[int], int, int]:
    """One attempt against the caps; only admitted attempts count later."""
    recent = [t for t in recent if t > at - 60_000_000]
    now = at // 86_400_000_000
    if now != day:
        day, today = now, 0
    if today >= per_day:
        return False, "day", (day + 1) * 86_400_000_000 - at, recent, day, today
    if len(recent) >= per_minute:
        return False, "minute", recent[0] + 60_000_000 - at, recent, day, today
    return True, None, 0, [*recent, at], day, today + 1


def admit_batch(events: DataFrame, per_minute: int = 10, per_day: int = 100) -> DataFrame:
    """Admission of each user's attempts in order of time; state is at most ``per_minute`` times."""

    def run(key, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        recent, day, today = [], -1, 0
        for pdf in batches:
            out = []
            for event, at in zip(pdf["event_id"], pdf["at"], strict=True):
                ok, reason, wait, recent, day, today = decide(int(at), recent, day, today, per_minute, per_day)
                out.append((int(key[0]), int(event), int(at), ok, reason, wait))
            yield pd.DataFrame(out, columns=["user_id", "event_id", "at", "admitted", "reason", "retry_after"])

    def whole(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return next(run(key, iter([pdf.sort_values(["at", "event_id"])])))

    rows = events.select("user_id", "event_id", epoch("ts").alias("at"))
    return rows.groupBy("user_id").applyInPandas(whole, DECISION)


def admit_stream(events: DataFrame, per_minute: int = 10, per_day: int = 100) -> DataFrame:
    """The same on a stream: a user's state between micro-batches is at most ``per_minute`` times and a day's count."""

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        recent, day, today = (list(state.get[0]), state.get[1], state.get[2]) if state.exists else ([], -1, 0)
        pdf = pd.concat(list(batches)).sort_values(["at", "event_id"])
        out = []
        for event, at in zip(pdf["event_id"], pdf["at"], strict=True):
            ok, reason, wait, recent, day, today = decide(int(at), recent, day, today, per_minute, per_day)
            out.append((int(key[0]), int(event), int(at), ok, reason, wait))
        state.update((recent, day, today))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "at", "admitted", "reason", "retry_after"])

    rows = events.select("user_id", "event_id", epoch("ts").alias("at"))
    return rows.groupBy("user_id").applyInPandasWithState(step, DECISION, STATE, "append", GroupStateTimeout.NoTimeout)


def live_cache(writes: DataFrame, reads: DataFrame, seconds: int) -> DataFrame:
    """(key, at) reads with the newest write of the key that is not older than ``seconds``: one ordered pass over both."""
    both = writes.select("key", "at", F.lit(0).alias("_kind"), F.col("id").alias("write_id"), F.lit(None).cast("long").alias("read_id")).unionByName(
        reads.select("key", "at", F.lit(1).alias("_kind"), F.lit(None).cast("long").alias("write_id"), F.col("id").alias("read_id"))
    )
    order = Window.partitionBy("key").orderBy("at", "_kind", "write_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    newest = F.last(F.when(F.col("_kind") == 0, F.struct("at", "write_id")), ignorenulls=True).over(order)
    served = both.withColumn("_w", newest).where("_kind = 1")
    fresh = F.col("at") - F.col("_w.at") <= seconds * 1_000_000
    return served.select("read_id", "key", F.when(fresh, F.col("_w.write_id")).alias("write_id"))
