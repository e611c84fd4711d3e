"""Operational reports over jobs, users, logs, attempts and model calls."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.operations import job_results


def daily_stats(logs: DataFrame, newest: int = 90) -> DataFrame:
    """AG-1: (day, jobs, paragraphs, avg_duration, successes), the newest days (a report's length)."""
    per = logs.groupBy(F.to_date("timestamp").alias("day")).agg(
        F.count("*").alias("jobs"),
        F.coalesce(F.sum("paragraphs_count"), F.lit(0)).alias("paragraphs"),
        F.coalesce(F.avg("duration_seconds"), F.lit(0.0)).alias("avg_duration"),
        F.sum(F.when(F.col("status") == "Success", 1).otherwise(0)).alias("successes"),
    )
    return per.orderBy(F.desc("day")).limit(newest)


def role_counts(users: DataFrame) -> DataFrame:
    """AG-2: (role, n); no role is a member."""
    return users.groupBy(F.coalesce("role", F.lit("member")).alias("role")).agg(F.count("*").alias("n"))


def queue_stats(jobs: DataFrame) -> DataFrame:
    """AG-2: (status, n)."""
    return jobs.groupBy("status").agg(F.count("*").alias("n"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """AG-2: (name, n) of each table."""
    return reduce(DataFrame.union, [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables.items()])


def month_usage(jobs: DataFrame) -> DataFrame:
    """AG-3: (user_id, month, jobs, prompt_tokens, completion_tokens, cached_tokens, total_tokens, cost_usd); failed jobs count; a cost nobody gave stays null."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    per = jobs.groupBy("user_id", F.date_format("created_at", "yyyy-MM").alias("month")).agg(F.count("*").alias("jobs"), total("prompt_tokens"), total("completion_tokens"), total("cached_tokens"), F.sum("cost_usd").alias("cost_usd"))
    return per.withColumn("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens"))


def quota(users: DataFrame, usage: DataFrame, month: str, jobs_default: int = 3, tokens_default: int = 0) -> DataFrame:
    """AG-4: (user_id, jobs_used, jobs_cap, used, cap, allowed, reason): jobs first, then tokens; no cap takes the default, 0 is unlimited, administrators are exempt."""
    month_of = usage.filter(F.col("month") == month).select("user_id", "jobs", "total_tokens")
    both = users.join(month_of, users["id"] == month_of["user_id"], "left")
    exempt = F.col("role").isin("admin", "superadmin")
    limit = lambda c, default: F.when(exempt, 0).otherwise(F.greatest(F.coalesce(c, F.lit(default)), F.lit(0))).cast("bigint")
    rows = both.select(
        F.col("id").alias("user_id"), F.coalesce("jobs", F.lit(0)).alias("jobs_used"), limit("monthly_job_cap", jobs_default).alias("jobs_cap"), F.coalesce("total_tokens", F.lit(0)).alias("used"), limit("monthly_token_cap", tokens_default).alias("cap")
    )
    reason = F.when((F.col("jobs_cap") > 0) & (F.col("jobs_used") >= F.col("jobs_cap")), "jobs").when((F.col("cap") > 0) & (F.col("used") >= F.col("cap")), "tokens")
    return rows.withColumn("reason", reason).withColumn("allowed", F.col("reason").isNull())


def locked_out(attempts: DataFrame, now: Column, most: int = 10, minutes: int = 15) -> DataFrame:
    """AG-5: (username, n) of names with `most` or more failures in the window before `now`."""
    recent = attempts.filter((F.col("attempted_at") > now - F.make_dt_interval(mins=F.lit(minutes))) & (F.col("attempted_at") <= now))
    return recent.groupBy("username").agg(F.count("*").alias("n")).filter(F.col("n") >= most)


def user_activity(users: DataFrame, logs: DataFrame) -> DataFrame:
    """JN-1: every user with job_count and last_active; those without jobs have 0 and null.  Logs are counted before the join."""
    per = logs.groupBy("user_id").agg(F.count("*").alias("n"), F.max("timestamp").alias("last_active"))
    return users.join(per, users["id"] == per["user_id"], "left").select("id", "username", "role", F.coalesce("n", F.lit(0)).alias("job_count"), "last_active")


def with_owner(df: DataFrame, users: DataFrame) -> DataFrame:
    """JN-2: rows with their owner's username, null for unknown owners."""
    return df.join(users.select(F.col("id").alias("user_id"), "username"), "user_id", "left")


def active_sessions(tokens: DataFrame, users: DataFrame, now: Column, ttl_days: int) -> DataFrame:
    """JN-3: (token_hash, user_id, username) of tokens younger than the time to live; 0 days never end."""
    live = tokens if ttl_days == 0 else tokens.filter(F.col("created_at") > now - F.make_dt_interval(F.lit(ttl_days)))
    return live.join(users.select(F.col("id").alias("user_id"), "username"), "user_id").select("token_hash", "user_id", "username")


def undelivered(bridge: DataFrame, jobs: DataFrame) -> DataFrame:
    """JN-4: bridge rows (job_id, returned_at) not yet returned whose job has ended."""
    ended = jobs.filter(F.col("status").isin("done", "error")).select(F.col("id").alias("job_id"))
    return bridge.filter("returned_at IS NULL").join(ended, "job_id", "left_semi")


def search_logs(logs: DataFrame, users: DataFrame, user_id: int | None = None, status: str | None = None, search: str = "", newest: int = 200) -> DataFrame:
    """FIL-10: the audit trail by user, status and part of a file name, newest first (a report's length)."""
    found = logs
    if user_id is not None:
        found = found.filter(F.col("user_id") == user_id)
    if status:
        found = found.filter(F.col("status") == status)
    if search:
        found = found.filter(F.contains(F.lower("filename"), F.lit(search.strip().lower())))
    return with_owner(found.orderBy(F.desc("timestamp"), F.desc("id")).limit(newest), users)


def jobs_view(jobs: DataFrame, users: DataFrame, status: str | None = None, newest: int = 100) -> DataFrame:
    """FIL-11: jobs with their owner, newest first (a report's length)."""
    chosen = jobs if status is None else jobs.filter(F.col("status") == status)
    return with_owner(chosen.orderBy(F.desc("created_at"), F.desc("id")).limit(newest), users)


def latest(df: DataFrame, column: str, n: int, *ties: str) -> DataFrame:
    """TK-2: the n latest rows."""
    return df.orderBy(F.desc(column), *[F.desc(t) for t in ties]).limit(n)


def queue_order(jobs: DataFrame) -> DataFrame:
    """TK-3: queued jobs, the oldest first."""
    return jobs.filter("status = 'queued'").orderBy("created_at", "id")


def top_counts(df: DataFrame, by: list[str], key: str, k: int, seen: str) -> DataFrame:
    """TK-4: the k commonest keys of each group with their count; of equal counts the one seen first."""
    n = df.groupBy(*by, key).agg(F.count("*").alias("n"), F.min(seen).alias("first_seen"))
    order = Window.partitionBy(*by).orderBy(F.desc("n"), "first_seen", key)
    return n.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def usage_rollup(calls: DataFrame) -> DataFrame:
    """AG-6: (job_id, model, calls, tokens..., cost_usd) for each job and model, and for each job (model null)."""
    totals = [F.sum(c).alias(c) for c in ("prompt_tokens", "completion_tokens", "cached_tokens", "reasoning_tokens", "cost_usd")]
    return calls.groupingSets([["job_id", "model"], ["job_id"]], "job_id", "model").agg(F.count("*").alias("calls"), *totals)


def format_cost(cost: Column) -> Column:
    return F.when(cost.isNull(), "not reported").otherwise(F.concat(F.lit("$"), F.format_number(cost, 4)))


def daily_findings(jobs: DataFrame, k: int = 12) -> DataFrame:
    """AG-7: (date, jobs, failed, for_the_author, guard_findings, proofreading, layout): a day's record, the k commonest rules of a family."""
    day = F.to_date("created_at").alias("date")
    heads = jobs.groupBy(day).agg(F.count("*").alias("jobs"), F.count(F.when(F.col("status") == "error", 1)).alias("failed"))
    rows = job_results(jobs.filter("status <> 'error'")).select(day, "id", "family", "rule", "audience")
    author = rows.filter("family = 'guard' AND audience = 'author'").groupBy("date").agg(F.count("*").alias("for_the_author"))
    ranked = top_counts(rows, ["date", "family"], "rule", k, "id").union(top_counts(rows.filter("family = 'guard'"), ["date", "family"], "rule", 1 << 30, "id").filter(F.col("rank") > k))
    maps = ranked.groupBy("date").pivot("family", ["guard", "proofreading", "layout"]).agg(F.map_from_entries(F.collect_list(F.struct("rule", "n"))))
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>"))
    pick = lambda c, name: F.coalesce(c, empty).alias(name)
    return heads.join(author, "date", "left").join(maps, "date", "left").select("date", "jobs", "failed", F.coalesce("for_the_author", F.lit(0)).alias("for_the_author"), pick("guard", "guard_findings"), pick("proofreading", "proofreading"), pick("layout", "layout"))


def new_guards(daily: DataFrame, last: int = 14) -> DataFrame:
    """WN-17: (date, new): guards that fired on a day and not on the recorded day before, of the last records."""
    order = Window.orderBy("date")  # one row for each day
    keys = F.array_sort(F.map_keys("guard_findings"))
    both = daily.withColumn("now", keys).withColumn("was", F.lag("now").over(order))
    ranked = both.withColumn("k", F.row_number().over(Window.orderBy(F.desc("date")))).filter(F.col("k") <= last)
    return ranked.select("date", F.array_join(F.array_sort(F.array_except("now", F.coalesce("was", F.col("now")))), ",").alias("new"))


def stalled(jobs: DataFrame, now: Column, minutes: int = 15) -> DataFrame:
    """ST-2's batch twin: running jobs whose last sign of life is over `minutes` old; a job without one is judged on its start."""
    quiet = F.coalesce("heartbeat_at", "started_at") < now - F.make_dt_interval(mins=F.lit(minutes))
    return jobs.filter((F.col("status") == "running") & quiet).select("id", "user_id")


def enabled_rules(users: DataFrame, disabled: DataFrame, groups: list[str]) -> DataFrame:
    """JN-28: (user_id, rule): rule groups of each user, without those that their preferences (user_id, disabled array) switch off."""
    every = users.select(F.col("id").alias("user_id"), F.explode(F.array(*[F.lit(g) for g in groups])).alias("rule"))
    off = disabled.select("user_id", F.explode("disabled").alias("rule"))
    return every.join(off, ["user_id", "rule"], "left_anti")
