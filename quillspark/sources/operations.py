"""Operational tables: typed scans, JSON results, and their derivation from the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RESULT = "struct<guard_findings:array<struct<guard:string,audience:string>>,findings:struct<proofreading:array<struct<rule:string>>,layout:array<struct<rule:string>>>>"
SCHEMAS = {
    "users": "id bigint, username string, email string, role string, auth_provider string, monthly_token_cap bigint, monthly_job_cap bigint",
    "process_logs": "id bigint, timestamp timestamp, filename string, paragraphs_count bigint, edit_style string, ref_style string, language string, duration_seconds double, status string, error_message string, user_id bigint",
    "jobs": "id bigint, user_id bigint, filename string, status string, progress double, stage string, result_json string, created_at timestamp, started_at timestamp, heartbeat_at timestamp, finished_at timestamp, prompt_tokens bigint, completion_tokens bigint, cached_tokens bigint, llm_calls bigint, cost_usd double",
    "login_attempts": "username string, attempted_at timestamp",
    "login_tokens": "token_hash string, user_id bigint, created_at timestamp",
    "usage_calls": "job_id bigint, ts timestamp, model string, prompt_tokens bigint, completion_tokens bigint, cached_tokens bigint, reasoning_tokens bigint, cost_usd double",
}


def ops_table(spark: SparkSession, name: str, path: str | None = None, jdbc: dict | None = None) -> DataFrame:
    """SRC-6: an operational table with its declared schema, from Parquet or over JDBC."""
    if jdbc:
        return spark.read.format("jdbc").options(dbtable=name, **jdbc).load()
    return spark.read.schema(SCHEMAS[name]).parquet(path)


def job_results(jobs: DataFrame) -> DataFrame:
    """SRC-7: (id, status, created_at, family, rule, audience): a row for each finding of a job's JSON; bad JSON gives none."""
    parsed = jobs.select("id", "status", "created_at", F.from_json("result_json", RESULT, {"mode": "PERMISSIVE"}).alias("r"))
    guard = F.transform(F.coalesce("r.guard_findings", F.array()), lambda g: F.struct(F.lit("guard").alias("family"), F.coalesce(g["guard"], F.lit("unknown")).alias("rule"), g["audience"].alias("audience")))
    rules = lambda family: F.transform(F.coalesce(f"r.findings.{family}", F.array()), lambda x: F.struct(F.lit(family).alias("family"), F.coalesce(x["rule"], F.lit("unknown")).alias("rule"), F.lit(None).cast("string").alias("audience")))
    each = parsed.select("id", "status", "created_at", F.explode(F.concat(guard, rules("proofreading"), rules("layout"))).alias("x"))
    return each.select("id", "status", "created_at", "x.family", "x.rule", "x.audience")


# The star schema's tables in the roles of the operational ones; the same expressions serve DuckDB.
USERS = """SELECT c_custkey AS id, c_name AS username, concat(lower(c_name), '@example.org') AS email,
  CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'admin' WHEN 'MACHINERY' THEN 'superadmin' ELSE 'member' END AS role, 'local' AS auth_provider,
  CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 7 = 1 THEN 0 ELSE CAST(floor(abs(c_acctbal)) AS BIGINT) END AS monthly_token_cap,
  CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 5 = 1 THEN 0 ELSE CAST(c_custkey % 4 AS BIGINT) END AS monthly_job_cap FROM customer"""
LOGS = """SELECT o_orderkey AS id, o_orderdate AS timestamp, concat(lower(substr(o_orderpriority, 3, 20)), '-', CAST(o_orderkey AS STRING), '.docx') AS filename,
  CAST(o_orderkey % 200 AS BIGINT) AS paragraphs_count, o_totalprice / 1000 AS duration_seconds,
  CASE o_orderstatus WHEN 'F' THEN 'Success' WHEN 'O' THEN 'Running' ELSE 'Error' END AS status, o_custkey AS user_id FROM orders"""
JOBS = """SELECT event_id AS id, user_id, CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'queued' WHEN 'click' THEN 'running' ELSE 'done' END AS status, ts AS created_at,
  CASE WHEN event_id % 3 = 0 THEN NULL ELSE ts END AS heartbeat_at, ts AS started_at,
  CAST(event_id % 900 AS BIGINT) AS prompt_tokens, CAST(event_id % 300 AS BIGINT) AS completion_tokens, CAST(event_id % 50 AS BIGINT) AS cached_tokens,
  CASE WHEN user_id % 4 = 0 THEN NULL ELSE CAST(event_id % 16 AS DOUBLE) / 8 END AS cost_usd,
  CASE WHEN event_id % 11 = 0 THEN 'not json' ELSE concat('{"guard_findings":[{"guard":"g', CAST(event_id % 6 AS STRING), '","audience":"', CASE WHEN event_id % 2 = 0 THEN 'author' ELSE 'internal' END,
    '"}],"findings":{"proofreading":[{"rule":"r', CAST(event_id % 17 AS STRING), '"},{"rule":"r', CAST(event_id % 5 AS STRING), '"}],"layout":[{"rule":"l', CAST(event_id % 3 AS STRING), '"}]}}') END AS result_json FROM events"""
ATTEMPTS = "SELECT concat('user', CAST(user_id AS STRING)) AS username, ts AS attempted_at FROM events WHERE event_type = 'error'"
TOKENS = "SELECT concat('t', CAST(event_id AS STRING)) AS token_hash, user_id, ts AS created_at FROM events WHERE event_type = 'signup'"
CALLS = """SELECT user_id AS job_id, ts, concat('model-', CAST(event_id % 3 AS STRING)) AS model, CAST(event_id % 900 AS BIGINT) AS prompt_tokens, CAST(event_id % 300 AS BIGINT) AS completion_tokens,
  CAST(event_id % 50 AS BIGINT) AS cached_tokens, CAST(event_id % 20 AS BIGINT) AS reasoning_tokens, CASE WHEN user_id % 4 = 0 THEN NULL ELSE CAST(event_id % 16 AS DOUBLE) / 8 END AS cost_usd FROM events"""
DERIVED = {"users": USERS, "process_logs": LOGS, "jobs": JOBS, "login_attempts": ATTEMPTS, "login_tokens": TOKENS, "usage_calls": CALLS}


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An operational table derived from the star schema of sf_dir."""
    sql = DERIVED[name]
    table = sql.rsplit("FROM ", 1)[1].split()[0]
    frame = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    if "ts" in frame.columns:
        frame = frame.withColumn("ts", F.col("ts").cast("timestamp"))
    return spark.sql(sql.replace("{", "{{").replace("}", "}}").replace(f"FROM {table}", "FROM {frame}"), frame=frame)
