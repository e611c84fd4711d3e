"""Streaming queries replayed over the events table, with their batch twins in SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.sinks import shared_folder
from ..streaming import streams

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream, its time cast to TIMESTAMP."""
    source = spark.readStream.schema(EVENTS).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    return source.withColumn("ts", F.col("ts").cast("timestamp"))


#: Days of events in a batch, files of a batch, and the watermark's delay, which is more than a batch.
DAYS, FILES, LATE = 3, 4, "4 days"
#: The batch of an event; some come one batch late, within the watermark, and some four, when they are dropped.
BATCH = "CAST(floor(datediff('day', TIMESTAMP '2024-01-01', ts) / 3) AS INT)"
SHIFTED = "CASE WHEN event_id % 97 = 0 AND {b} + 4 <= {last} THEN {b} + 4 WHEN event_id % 11 = 0 AND {b} + 1 <= {last} THEN {b} + 1 ELSE {b} END"
STATE = "spark.sql.streaming.stateStore.providerClass"


def staged(spark: SparkSession, d: str) -> DataFrame:
    """The events as a stream of batches in order of time, FILES files each: one batch a trigger, late rows included.

    A last batch holds one event of no user, far in the future, whose time closes all windows.
    """
    folder = f"{shared_folder(spark)}/staged-{uuid.uuid4().hex}"
    rows = spark.read.schema(EVENTS).parquet(f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    day = F.floor(F.datediff(F.col("ts"), F.lit("2024-01-01")) / DAYS).cast("int")
    rows = rows.withColumn("b", day)
    first, last = rows.agg(F.min("b"), F.max("b")).first()
    late = F.expr(SHIFTED.format(b="b", last=last))
    rows = rows.withColumn("batch", late)
    end = rows.agg((F.max("ts") + F.expr("INTERVAL 100 DAYS")).alias("ts")).select(F.lit(None).cast("bigint").alias("event_id"), "ts", F.lit(None).cast("bigint").alias("user_id"), F.lit(None).cast("string").alias("event_type"), F.lit(None).cast("double").alias("value"), F.lit(None).cast("string").alias("props"))
    fields = [F.col(c) for c in end.columns]
    for k in range(first, last + 1):  # a file source takes files in order of their times, so batches are written one after the other
        rows.filter(F.col("batch") == k).select(*fields).repartition(FILES).write.option("maxRecordsPerFile", 0).mode("append").parquet(folder)
    end.write.mode("append").parquet(folder)
    return spark.readStream.schema(end.schema).option("maxFilesPerTrigger", FILES).parquet(folder)


def stateful(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """make(), a replay of stateful processors, with the RocksDB store that they need."""
    before = spark.conf.get(STATE)
    spark.conf.set(STATE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return make()
    finally:
        spark.conf.set(STATE, before)


def replay(stream: DataFrame, mode: str) -> DataFrame:
    """All that the stream puts out for the events at hand, as a table in the shared folder; in update mode with its batch.

    Each batch writes a folder of its own, and writes it anew if it runs again.
    In complete mode the last batch has everything.
    """
    spark = stream.sparkSession
    folder = f"{shared_folder(spark)}/replay-{uuid.uuid4().hex}"
    written: list[int] = []

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={batch_id}")
        written.append(batch_id)

    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/progress").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    if mode == "update":
        return spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{folder}/rows")
    batches = sorted(set(written))[-1:] if mode == "complete" else sorted(set(written))
    return spark.read.schema(stream.schema).parquet(*[f"{folder}/rows/batch={b}" for b in batches])


def _lockouts(spark: SparkSession, d: str) -> DataFrame:
    attempts = events(spark, d).filter("event_type IN ('error', 'signup')").select(F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("username"), F.col("ts").alias("attempted_at"), (F.col("event_type") == "signup").alias("success"))
    return replay(streams.lockouts(attempts, most=2, minutes=15), "complete")


def _usage(spark: SparkSession, d: str) -> DataFrame:
    calls = events(spark, d).select(F.col("user_id").alias("job_id"), F.concat(F.lit("model-"), (F.col("event_id") % 3).cast("string")).alias("model"), *[(F.col("event_id") % n).alias(c) for c, n in (("prompt_tokens", 900), ("completion_tokens", 300), ("cached_tokens", 50), ("reasoning_tokens", 20))], ((F.col("event_id") % 16).cast("double") / 8).alias("cost_usd"))
    return replay(streams.usage_meter(calls), "complete")


def _daily(spark: SparkSession, d: str) -> DataFrame:
    return replay(streams.daily(events(spark, d).select("ts", F.col("event_type").alias("rule"))), "complete")


def _patterns(spark: SparkSession, d: str) -> DataFrame:
    pairs = events(spark, d).select(F.col("user_id").alias("job_id"), F.initcap("event_type").alias("old"), F.lit("X").alias("new"))
    return replay(streams.patterns(pairs), "complete")


def _ingest(spark: SparkSession, d: str) -> DataFrame:
    jobs = events(spark, d).select((F.col("event_id") - F.col("event_id") % 2).alias("remote_id"), "ts")
    return replay(streams.ingest(jobs, "60 days").select("remote_id"), "append")


def _stalled(spark: SparkSession, d: str) -> DataFrame:
    """ST-2: ten jobs of each user whose events stopped, reported while the stream runs on and at its end."""
    beats = staged(spark, d).select(F.coalesce(F.col("user_id") * 10 + F.col("event_id") % 10, F.lit(-1)).alias("job_id"), "ts")
    return stateful(spark, lambda: replay(streams.stalled(beats, 15, LATE), "append")).filter("job_id >= 0").withColumn("last_seen", F.col("last_seen").cast("timestamp_ntz"))


def _feed(spark: SparkSession, d: str) -> DataFrame:
    """ST-3: each user's last five events, as the last update left them."""
    rows = staged(spark, d).filter("user_id IS NOT NULL").select(F.col("user_id").alias("job_id"), F.concat_ws(" ", F.col("event_id").cast("string"), "event_type").alias("text"), "ts")
    updates = stateful(spark, lambda: replay(streams.live_feed(rows, 5), "update"))
    return updates.groupBy("job_id").agg(F.max_by("events", "batch").alias("events")).select("job_id", F.array_join("events", ", ").alias("events"))


def _reviews(spark: SparkSession, d: str) -> DataFrame:
    """ST-4: sessions of answers that end after half an hour of silence, and count for two hours at most."""
    answers = staged(spark, d).select(F.coalesce(F.col("user_id") % 20, F.lit(-1)).alias("job_id"), (F.col("event_id") % 4).cast("int").alias("idx"), F.col("event_type").alias("decision"), "ts")
    closed = replay(streams.reviews(answers, "30 minutes", LATE, 7200), "append").filter("job_id >= 0")
    return closed.select("job_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), F.array_join(F.transform("answers", lambda a: F.concat_ws(":", a["idx"].cast("string"), a["decision"])), ",").alias("answers"))


def _throttle(spark: SparkSession, d: str) -> DataFrame:
    """ST-9: one row of progress for each user and six hours."""
    rows = staged(spark, d).select(F.coalesce("user_id", F.lit(-1)).alias("job_id"), F.col("event_type").alias("stage"), F.col("value").alias("progress"), "ts")
    return replay(streams.throttle(rows, "6 hours", LATE), "append").filter("job_id >= 0").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"lockout_stream": _lockouts, "usage_stream": _usage, "daily_stream": _daily, "pattern_stream": _patterns, "ingest_stream": _ingest, "stalled_stream": _stalled, "feed_stream": _feed, "review_stream": _reviews, "throttle_stream": _throttle}


# The batches of staged(): e has each event with its batch, seen those that aren't dropped, w each batch's watermark.
STAGED = f"""WITH days AS (SELECT *, {BATCH} AS b FROM events), last AS (SELECT max(b) AS last FROM days), e AS (SELECT days.*, {SHIFTED.format(b="b", last="last")} AS batch FROM days, last), seen AS (SELECT * FROM e WHERE batch < b + 4),
  w AS (SELECT n, (SELECT max(ts) FROM e WHERE batch < n) - INTERVAL 4 DAY AS mark FROM (SELECT unnest(range((SELECT min(batch) FROM e), (SELECT max(batch) FROM e) + 1)) AS n) x)"""


def oracle_sql() -> dict[str, str]:
    return {
        "lockout_stream": """WITH a AS (SELECT user_id, ts, event_type = 'error' AS failed, unnest(generate_series(date_trunc('minute', ts) - INTERVAL 14 MINUTE, date_trunc('minute', ts), INTERVAL 1 MINUTE)) AS w FROM events WHERE event_type IN ('error', 'signup')),
          c AS (SELECT *, max(CASE WHEN NOT failed THEN ts END) OVER (PARTITION BY user_id, w) AS cleared FROM a)
          SELECT concat('user', CAST(user_id AS STRING)) AS username, w AS start, w + INTERVAL 15 MINUTE AS "end", count(*) AS n FROM c WHERE failed AND (cleared IS NULL OR ts > cleared) GROUP BY ALL HAVING count(*) >= 2""",
        "usage_stream": "SELECT user_id AS job_id, concat('model-', CAST(event_id % 3 AS STRING)) AS model, count(*) AS calls, CAST(sum(event_id % 900) AS BIGINT) AS prompt_tokens, CAST(sum(event_id % 300) AS BIGINT) AS completion_tokens, CAST(sum(event_id % 50) AS BIGINT) AS cached_tokens, CAST(sum(event_id % 20) AS BIGINT) AS reasoning_tokens, sum(CAST(event_id % 16 AS DOUBLE) / 8) AS cost_usd FROM events GROUP BY ALL",
        "daily_stream": "SELECT CAST(ts AS DATE) AS date, event_type AS rule, count(*) AS n FROM events GROUP BY ALL",
        "pattern_stream": "SELECT user_id AS job_id, event_type AS old, 'x' AS new, count(*) AS n FROM events GROUP BY ALL",
        # a report comes if the watermark passes the last beat by 15 minutes before a batch brings another
        "stalled_stream": STAGED + """, beats AS (SELECT user_id * 10 + event_id % 10 AS job_id, batch, max(ts) AS ts FROM seen GROUP BY ALL), runs AS (SELECT *, max(ts) OVER (PARTITION BY job_id ORDER BY batch) AS seen_at, lead(batch) OVER (PARTITION BY job_id ORDER BY batch) AS again FROM beats)
          SELECT job_id, date_trunc('millisecond', seen_at) AS last_seen FROM runs LEFT JOIN w ON w.n = again - 1 WHERE again IS NULL OR (again - 1 > batch AND w.mark >= date_trunc('millisecond', seen_at) + INTERVAL 15 MINUTE)""",
        "feed_stream": """WITH k AS (SELECT user_id, epoch_ms(ts) AS ms, concat(event_id, ' ', event_type) AS text FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ms DESC, text DESC) AS k FROM k)
          SELECT user_id AS job_id, string_agg(text, ', ' ORDER BY ms, text) AS events FROM r WHERE k <= 5 GROUP BY user_id""",
        "review_stream": STAGED + """, g AS (SELECT user_id % 20 AS job_id, event_id % 4 AS idx, event_type AS decision, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id % 20 ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens FROM seen),
          s AS (SELECT *, sum(opens) OVER (PARTITION BY job_id ORDER BY ts) AS s FROM g), f AS (SELECT *, min(ts) OVER (PARTITION BY job_id, s) AS start, max(ts) OVER (PARTITION BY job_id, s) + INTERVAL 30 MINUTE AS "end" FROM s),
          h AS (SELECT *, max(ts) OVER (PARTITION BY job_id, s, idx) AS latest FROM f WHERE floor(epoch(ts)) - floor(epoch(start)) <= 7200)
          SELECT job_id, start, "end", string_agg(concat(idx, ':', decision), ',' ORDER BY ts) AS answers FROM h WHERE ts = latest GROUP BY ALL""",
        "throttle_stream": STAGED + " SELECT user_id AS job_id, max(ts) AS ts, arg_max(event_type, ts) AS stage, arg_max(value, ts) AS progress FROM seen GROUP BY user_id, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2024-01-01')",
        "ingest_stream": "SELECT DISTINCT event_id - event_id % 2 AS remote_id FROM events",
    }
