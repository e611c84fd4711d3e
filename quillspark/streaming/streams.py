"""Live operations as Structured Streaming queries over event tables.

Each function takes a streaming DataFrame and returns one; sinks and triggers
are the caller's.  State is keyed, and bounded by watermarks or by the feature
(a feed's length).  Event times must be TIMESTAMP.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def lockouts(attempts: DataFrame, most: int = 10, minutes: int = 15, late: str = "30 minutes") -> DataFrame:
    """ST-1: (username, start, end, n): sliding windows with `most` failures or more since the last success in them.

    attempts: (username, attempted_at, success).  A window's attempts of one name
    are held as times, which the window bounds.
    """
    w = F.window("attempted_at", f"{minutes} minutes", "1 minute")
    failed = F.collect_list(F.when(~F.col("success"), F.col("attempted_at")))
    per = attempts.withWatermark("attempted_at", late).groupBy(w.alias("w"), "username").agg(failed.alias("failed"), F.max(F.when(F.col("success"), F.col("attempted_at"))).alias("cleared"))
    n = per.withColumn("n", F.size(F.filter("failed", lambda t: F.col("cleared").isNull() | (t > F.col("cleared")))).cast("bigint"))
    return n.filter(F.col("n") >= most).select("username", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def usage_meter(calls: DataFrame) -> DataFrame:
    """ST-5: running totals for each job and model (update or complete mode)."""
    totals = [F.sum(c).alias(c) for c in ("prompt_tokens", "completion_tokens", "cached_tokens", "reasoning_tokens", "cost_usd")]
    return calls.groupBy("job_id", "model").agg(F.count("*").alias("calls"), *totals)


def daily(findings: DataFrame, late: str = "1 day") -> DataFrame:
    """ST-6: (date, rule, n) by tumbling days; late rows re-open a day until the watermark passes."""
    n = findings.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), "rule").agg(F.count("*").alias("n"))
    return n.select(F.to_date("w.start").alias("date"), "rule", "n")


def reviews(answers: DataFrame, idle: str = "30 seconds", late: str = "10 minutes", hard_seconds: int = 600) -> DataFrame:
    """ST-4: (job_id, start, end, answers): a review closes when no answer came for `idle`; of each paragraph the last answer within the hard limit counts."""
    session = F.session_window("ts", idle)
    per = answers.withWatermark("ts", late).groupBy(session.alias("w"), "job_id").agg(F.collect_list(F.struct("ts", "idx", "decision")).alias("all"))
    within = F.filter("all", lambda a: F.unix_timestamp(a["ts"]) - F.unix_timestamp("w.start") <= hard_seconds)
    ordered = F.array_sort(within)
    last = F.filter(ordered, lambda a: ~F.exists(ordered, lambda b: (b["idx"] == a["idx"]) & (b["ts"] > a["ts"])))
    return per.select("job_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), F.transform(last, lambda a: F.struct(a["idx"], a["decision"])).alias("answers"))


def patterns(pairs: DataFrame) -> DataFrame:
    """ST-7: (job_id, old, new, n): running counts of substitutions, first letters folded; a sink keeps those of three or more."""
    fold = lambda c: F.concat(F.lower(F.substring(c, 1, 1)), F.substr(c, F.lit(2)))
    return pairs.groupBy("job_id", fold("old").alias("old"), fold("new").alias("new")).agg(F.count("*").alias("n"))


def ingest(jobs: DataFrame, late: str = "1 day") -> DataFrame:
    """ST-8: jobs without repeats of a remote id within the watermark."""
    return jobs.withWatermark("ts", late).dropDuplicatesWithinWatermark(["remote_id"])


def throttle(progress: DataFrame, every: str = "3 seconds", late: str = "1 minute") -> DataFrame:
    """ST-9: the last progress row of each job and interval."""
    w = F.window("ts", every)
    last = progress.withWatermark("ts", late).groupBy(w.alias("w"), "job_id").agg(F.max_by(F.struct("ts", "stage", "progress"), "ts").alias("r"))
    return last.select("job_id", "r.ts", "r.stage", "r.progress")


class StallProcessor(StatefulProcessor):
    """Reports jobs whose last heartbeat is over `minutes` old by event time; a new one re-arms them.

    A key is a bucket of jobs with their last heartbeats as one value, and with one
    timer, for the first of them that is due: a call of the state store or of a timer
    goes to the JVM and back, so one for each job takes far longer than its data.
    """

    def __init__(self, minutes: int = 15):
        self.wait = minutes * 60_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "jobs array<bigint>, ms array<bigint>")

    def _keep(self, held: dict[int, int], due: int | None) -> None:
        """Holds the jobs, and sets the timer anew if it isn't the one at `due`."""
        self.last.update((list(held), list(held.values())))
        first = min(held.values()) + self.wait
        if first != due:
            if due is not None:
                self.handle.deleteTimer(due)
            self.handle.registerTimer(first)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = dict(zip(*self.last.get(), strict=True)) if self.last.exists() else {}
        due = min(held.values()) + self.wait if held else None
        for df in rows:
            for job, ms in zip(df["job"].tolist(), (df["ts"].astype("datetime64[ns]").astype("int64") // 1_000_000).tolist(), strict=True):
                held[job] = max(held.get(job, ms), ms)
        self._keep(held, due)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = dict(zip(*self.last.get(), strict=True))
        now = timerValues.getCurrentWatermarkInMs()
        gone = {job: ms for job, ms in held.items() if ms + self.wait <= now}
        left = {job: ms for job, ms in held.items() if job not in gone}
        if left:
            self._keep(left, None)
        else:
            self.last.clear()
        yield pd.DataFrame({"job_id": pd.Series([None if key[0] < 0 else job for job in gone], dtype="Int64"), "last_seen": [pd.Timestamp(ms, unit="ms") for ms in gone.values()]})

    def close(self) -> None:
        pass


#: Buckets of jobs; with a few thousand jobs in each, calls take no more time than the jobs.
BUCKETS = 1024


def stalled(heartbeats: DataFrame, minutes: int = 15, late: str = "1 minute", buckets: int = BUCKETS) -> DataFrame:
    """ST-2: (job_id, last_seen) of jobs whose heartbeats stopped.  Needs the RocksDB state store.

    A heartbeat of no job counts for one of its own, in a bucket of its own: pandas
    would read numbers beside nulls as floats.
    """
    job = F.col("job_id").cast("bigint")
    dealt = F.when(job.isNull(), -1).otherwise(F.pmod(F.xxhash64(job), F.lit(buckets))).cast("int")
    rows = heartbeats.withWatermark("ts", late).select(dealt.alias("bucket"), F.coalesce(job, F.lit(0)).alias("job"), "ts")
    return rows.groupBy("bucket").transformWithStateInPandas(StallProcessor(minutes), "job_id bigint, last_seen timestamp", "Append", "EventTime")


class FeedProcessor(StatefulProcessor):
    """Keeps the last `size` events of each job and puts them out whenever some arrive."""

    def __init__(self, size: int = 40):
        self.size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.events = handle.getListState("events", "ms bigint, text string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = list(self.events.get()) if self.events.exists() else []
        for df in rows:
            held += [(t.value // 1_000_000, x) for t, x in zip(df["ts"], df["text"], strict=True)]
        held = sorted((int(a), b) for a, b in held)[-self.size :]
        self.events.put(held)
        yield pd.DataFrame({"job_id": [key[0]], "events": [[b for _, b in held]]})

    def close(self) -> None:
        pass


def live_feed(events: DataFrame, size: int = 40) -> DataFrame:
    """ST-3: (job_id, events): the last events of each job (the feature is the length)."""
    return events.groupBy("job_id").transformWithStateInPandas(FeedProcessor(size), "job_id bigint, events array<string>", "Update", "None")
