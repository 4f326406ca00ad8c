"""The star-schema tables read as usage requests, log records and ledger rows: integer arithmetic only, so SQL can say the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import seconds

# The model named for each event type; one has a date tail, one has no price.
MODELS = {"click": "claude-opus-4-7-20260101", "view": "claude-sonnet-4-6", "signup": "claude-haiku-4-5-20251001", "error": "gpt-5.5", "purchase": "mystery-model-1"}
COMMANDS = ("project", "scan", "mcp", "audit")
EPOCH = 1_704_067_200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    agent = F.pmod("user_id", F.lit(10))
    kind = F.col("event_type")
    model: Column = F.lit("mystery-model-1")
    for name, of in MODELS.items():
        model = F.when(kind == name, F.lit(of)).otherwise(model)
    whole = lambda c: F.floor(c).cast("long")
    day = F.date_format("ts", "yyyy-MM-dd")
    return e.select(
        "event_id",
        F.when(agent == 9, "codex").otherwise("claude_code").alias("source"),
        F.concat(F.lit("a"), agent, F.lit("-"), day).alias("session_id"),
        F.concat(F.lit("p"), F.pmod(agent, F.lit(5))).alias("project_key"),
        (F.pmod(agent, F.lit(4)) == 3).alias("is_subagent"),
        model.alias("model"),
        seconds(F.col("ts")).alias("ts"),
        day.alias("day"),
        (F.pmod("event_id", F.lit(500)) + 10).alias("input"),
        whole(F.col("value")).alias("output"),
        F.when(kind.isin("click", "view"), whole(F.col("value") * 50)).otherwise(F.lit(0)).cast("long").alias("cache_read"),
        F.when(kind == "signup", 2000 + F.pmod("event_id", F.lit(500))).otherwise(F.lit(0)).cast("long").alias("w5"),
        F.when(kind == "error", 1500 + F.pmod("event_id", F.lit(300))).otherwise(F.lit(0)).cast("long").alias("w1"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).drop("event_id")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines before dedup: each event as a line, a streamed earlier copy of every third, and a second file with every seventh."""
    e = _events(spark, sf_dir).select(F.concat(F.lit("m"), "event_id").alias("message_id"), F.lit("r").alias("request_id"), "event_id", "ts", "output")
    main = e.withColumn("file", F.lit("p/b.jsonl")).withColumn("line_no", F.col("event_id") * 2 + 1)
    early = e.where("event_id % 3 = 0").withColumn("output", F.col("output") + 7).withColumn("file", F.lit("p/b.jsonl")).withColumn("line_no", F.col("event_id") * 2)
    other = e.where("event_id % 7 = 0").withColumn("ts", F.col("ts") + F.pmod("event_id", F.lit(3)) - 1).withColumn("output", F.col("output") + F.pmod("event_id", F.lit(2))).withColumn("file", F.lit("p-b/x.jsonl")).withColumn("line_no", F.col("event_id"))
    return main.unionByName(early).unionByName(other).drop("event_id")


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    k = F.pmod("o_orderkey", F.lit(4))
    command = F.when(k == 0, COMMANDS[0]).when(k == 1, COMMANDS[1]).when(k == 2, COMMANDS[2]).otherwise(COMMANDS[3])
    price = F.floor("o_totalprice").cast("long")
    only = lambda on, c: F.when(on, c)
    return o.select(
        F.col("o_orderkey").alias("line_no"),
        (F.lit(EPOCH).cast("long") + F.pmod("o_orderkey", F.lit(30)) * 86_400 + F.pmod("o_custkey", F.lit(86_400))).alias("ts"),
        command.alias("command"),
        F.concat(F.lit("p"), F.pmod("o_custkey", F.lit(5))).alias("project_key"),
        only(k == 0, price).alias("always_tokens"),
        only(k == 0, F.floor(price / 10)).alias("reclaimable_min"),
        only(k == 0, F.floor(price / 5)).alias("reclaimable_max"),
        only(k.isin(1, 2), F.floor(price / 3)).alias("swap"),
        only(k.isin(1, 2), F.floor(price / 7)).alias("slim"),
        only(k == 3, F.floor(price / 20)).alias("savings_min"),
        only(k == 3, F.floor(price / 8)).alias("savings_max"),
    )


#: The same in DuckDB's SQL: common table expressions events -> requests, records, ledger.
SQL = """
ev AS (
  SELECT event_id, CASE WHEN user_id % 10 = 9 THEN 'codex' ELSE 'claude_code' END AS source,
    'a' || (user_id % 10) || '-' || strftime(ts, '%Y-%m-%d') AS session_id, 'p' || ((user_id % 10) % 5) AS project_key, (user_id % 10) % 4 = 3 AS is_subagent,
    CASE event_type WHEN 'click' THEN 'claude-opus-4-7-20260101' WHEN 'view' THEN 'claude-sonnet-4-6' WHEN 'signup' THEN 'claude-haiku-4-5-20251001' WHEN 'error' THEN 'gpt-5.5' ELSE 'mystery-model-1' END AS model,
    CASE event_type WHEN 'click' THEN 'claude-opus-4.7' WHEN 'view' THEN 'claude-sonnet-4.6' WHEN 'signup' THEN 'claude-haiku-4.5' WHEN 'error' THEN 'gpt-5.5' ELSE 'mystery-model-1' END AS price_id,
    CAST(floor(epoch(ts)) AS BIGINT) AS ts, strftime(ts, '%Y-%m-%d') AS day, event_id % 500 + 10 AS input, CAST(floor(value) AS BIGINT) AS output,
    CASE WHEN event_type IN ('click', 'view') THEN CAST(floor(value * 50) AS BIGINT) ELSE 0 END AS cache_read,
    CASE WHEN event_type = 'signup' THEN 2000 + event_id % 500 ELSE 0 END AS w5, CASE WHEN event_type = 'error' THEN 1500 + event_id % 300 ELSE 0 END AS w1
  FROM events),
requests AS (SELECT *, input + cache_read + w5 + w1 AS input_side, w5 + w1 AS writes FROM ev),
ledger AS (
  SELECT o_orderkey AS line_no, 1704067200 + (o_orderkey % 30) * 86400 + o_custkey % 86400 AS ts, ['project', 'scan', 'mcp', 'audit'][o_orderkey % 4 + 1] AS command, 'p' || (o_custkey % 5) AS project_key,
    CAST(floor(o_totalprice) AS BIGINT) AS price, o_orderkey % 4 AS k FROM orders),
sess AS (
  SELECT source, is_subagent, session_id, project_key, CAST(count(*) AS BIGINT) AS requests, CAST(sum(input) AS BIGINT) AS input, CAST(sum(output) AS BIGINT) AS output, CAST(sum(cache_read) AS BIGINT) AS cache_read,
    CAST(sum(w5) AS BIGINT) AS w5, CAST(sum(w1) AS BIGINT) AS w1, min(ts) AS first_ts, max(ts) AS last_ts FROM requests GROUP BY ALL)
"""
