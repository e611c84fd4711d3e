"""Live operations from streams to tables."""

import datetime
import random

from quillspark.plans import jobs
from quillspark.sources import sinks
from quillspark.streaming import streams


def at(minute, second=0):
    return datetime.datetime(2024, 1, 1, 10, minute, second)


def stream(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
    return spark.readStream.schema(schema).parquet(path)


def test_live_ops(spark, tmp_path):
    source = lambda name, rows, schema: stream(spark, rows, schema, f"{tmp_path}/in-{name}")
    attempts = [("ann", at(m), False) for m in range(11)] + [("bob", at(m), m == 9) for m in range(12)]
    found = jobs.live_ops(
        source("attempts", attempts, "username string, attempted_at timestamp, success boolean"),
        source("beats", [(1, at(0)), (2, at(50))], "job_id int, ts timestamp"),
        source("events", [(1, f"e{i}", at(i)) for i in range(3)], "job_id int, text string, ts timestamp"),
        source("answers", [(1, 5, "accept", at(0)), (2, 5, "accept", at(50))], "job_id int, idx int, decision string, ts timestamp"),
        source("calls", [(1, "m", 10, 5, 0, 0, 0.5), (1, "m", 20, 5, 0, 0, 0.5)], "job_id int, model string, prompt_tokens int, completion_tokens int, cached_tokens int, reasoning_tokens int, cost_usd double"),
        source("progress", [(1, "a", 0.1, at(0)), (1, "b", 0.2, at(0, 1)), (2, "z", 1.0, at(50))], "job_id int, stage string, progress double, ts timestamp"),
    )
    for query in jobs.start_live_ops(found, str(tmp_path / "out"), availableNow=True):
        query.awaitTermination()
    table = lambda name: spark.read.parquet(f"{tmp_path}/out/{name}")
    assert {r.username for r in table("lockouts").collect()} == {"ann"}
    assert [r.job_id for r in table("stalled").collect()] == [1]
    assert table("feed").first().events == ["e0", "e1", "e2"]
    assert [r.job_id for r in table("decisions").collect()] == [1]
    assert (table("meters").first().prompt_tokens, table("meters").first().calls) == (30, 2)
    assert {r.stage for r in table("progress").collect()} == {"b"}


def test_upserts_keep_the_latest(spark, tmp_path):
    write = sinks.upsert_stream(str(tmp_path / "t"), "k", "v", 4)
    rows = lambda *x: spark.createDataFrame(list(x), "k int, v int, s string")
    write(rows((1, 1, "a"), (2, 5, "b")), 0)
    write(rows((1, 2, "c"), (2, 4, "old"), (3, 1, "d")), 1)
    write(rows((1, 2, "c"), (2, 4, "old"), (3, 1, "d")), 1)
    write(rows(), 2)
    assert {(r.k, r.v, r.s) for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {(1, 2, "c"), (2, 5, "b"), (3, 1, "d")}
    assert streams is not None


def test_stalled_jobs_share_state(spark, tmp_path):
    rng = random.Random(3)
    jobs_of = [None, 2**60 + 1, *range(40)]
    schema = "job_id bigint, ts timestamp"
    batches = [[(job, at(0) + datetime.timedelta(minutes=10 * k, seconds=rng.randrange(900), milliseconds=k)) for job in rng.choices(jobs_of, k=30) for _ in range(2)] for k in range(8)]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    want, held, mark, before = [], {}, datetime.datetime(1970, 1, 1), datetime.datetime(1970, 1, 1)
    for rows in [*batches, []]:
        for job, ts in rows:
            if ts > before:  # rows are late by the watermark of the batch before
                held[job] = max(ts, held.get(job, ts))
        gone = [job for job, ts in held.items() if ts + datetime.timedelta(minutes=15) <= mark]
        want += [(job, held.pop(job)) for job in gone]
        before, mark = mark, max([mark, *[ts - datetime.timedelta(minutes=1) for _, ts in rows]])
    beats = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = streams.stalled(beats, 15, buckets=3).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).start()
    query.awaitTermination()
    got = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()]
    key = lambda x: (str(x[0]), x[1])
    assert sorted(got, key=key) == sorted(want, key=key) and len(want) > 20 and {None, 2**60 + 1} & {job for job, _ in want}
    # a value and a timer for each bucket, not for each job
    assert max(s["numRowsTotal"] for p in query.recentProgress for s in p["stateOperators"]) <= 4 * 3
