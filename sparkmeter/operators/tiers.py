"""Savings tiers over ledger snapshots: identified, and realized in measured and assumed mode; project histories.

Ledger rows: line_no, ts, command, project_key, and the headline's figures as columns (null where a command has none).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import DAY


def latest(ledger: DataFrame) -> DataFrame:
    """Per (project_key, command) the row of the greatest time, on ties the later line."""
    row = F.struct(*ledger.columns)
    return ledger.groupBy("project_key", "command").agg(F.max_by(row, F.struct("ts", "line_no")).alias("r")).select("r.*")


def identified(ledger: DataFrame) -> DataFrame:
    """One row: sums over projects of their latest project, scan (else mcp) and audit figures."""
    rows = latest(ledger)
    pick = lambda command, c: F.max(F.when(F.col("command") == command, F.coalesce(F.col(c), F.lit(0))))
    when = lambda command: F.max(F.when(F.col("command") == command, F.col("ts")))
    per = rows.groupBy("project_key").agg(
        pick("project", "reclaimable_min").alias("p_min"), pick("project", "reclaimable_max").alias("p_max"), when("project").alias("p_ts"),
        F.coalesce(pick("scan", "swap"), pick("mcp", "swap")).alias("m_swap"), F.coalesce(pick("scan", "slim"), pick("mcp", "slim")).alias("m_slim"), F.coalesce(when("scan"), when("mcp")).alias("m_ts"),
        pick("audit", "savings_min").alias("a_min"), pick("audit", "savings_max").alias("a_max"), when("audit").alias("a_ts"),
    )
    some = per.where("p_ts is not null or m_ts is not null or a_ts is not null")
    return some.agg(
        F.sum("p_min").alias("project_min"), F.sum("p_max").alias("project_max"), F.max("p_ts").alias("project_as_of"), F.sum("m_swap").alias("mcp_swap"), F.sum("m_slim").alias("mcp_slim"), F.max("m_ts").alias("mcp_as_of"),
        F.sum("a_min").alias("audit_min"), F.sum("a_max").alias("audit_max"), F.max("a_ts").alias("audit_as_of"), F.count("*").alias("projects"),
    )


def snapshots(ledger: DataFrame) -> DataFrame:
    """(project_key, ts, weight, baseline, next_ts, n) of project snapshots in time order; baseline is the first weight."""
    order = Window.partitionBy("project_key").orderBy("ts", "line_no")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = ledger.where(F.col("command") == "project")
    return rows.select(
        "project_key", "ts", F.col("always_tokens").alias("weight"), F.first("always_tokens").over(whole).alias("baseline"), F.first("ts").over(whole).alias("first_snapshot"), F.lead("ts").over(order).alias("next_ts"),
        F.count("*").over(Window.partitionBy("project_key")).alias("n"), F.row_number().over(order).alias("place"),
    )


def realized_measured(ledger: DataFrame, sessions: DataFrame, usd_per_million: float) -> DataFrame:
    """Per project: the sum over its sessions of baseline minus the weight active when each began; may be negative.

    The active snapshot is the last at or before the session's start. Snapshots and sessions stand in one order of time,
    cut into days: within a day the last snapshot is carried on, and what a day begins with comes from the days' last ones.
    So no session meets more than the snapshots of its day, and no window holds more than a project's day.
    """
    marks = snapshots(ledger).where("n >= 2").select("project_key", "ts", F.lit(0).alias("kind"), "place", F.struct("baseline", "weight").alias("mark"))
    begun = sessions.select("project_key", F.col("first_ts").alias("ts"), F.lit(1).alias("kind"), F.lit(None).cast("int").alias("place"), F.lit(None).cast("struct<baseline:bigint,weight:bigint>").alias("mark"))
    line = marks.unionByName(begun).withColumn("day", F.floor(F.col("ts") / DAY))
    own = F.last("mark", ignorenulls=True).over(Window.partitionBy("project_key", "day").orderBy("ts", "kind", "place").rowsBetween(Window.unboundedPreceding, 0))
    days = line.groupBy("project_key", "day").agg(F.max_by("mark", F.when(F.col("kind") == 0, F.struct("ts", "place"))).alias("last"))
    before = Window.partitionBy("project_key").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)  # one row a day
    days = days.withColumn("begin", F.last("last", ignorenulls=True).over(before)).select("project_key", "day", "begin")
    at = line.withColumn("own", own).where("kind = 1").join(days, ["project_key", "day"]).withColumn("active", F.coalesce("own", "begin")).where("active is not null")
    sums = at.groupBy("project_key").agg(F.sum(F.col("active.baseline") - F.col("active.weight")).alias("tokens"), F.count("*").alias("sessions"))
    return sums.withColumn("usd", F.round(F.col("tokens") * usd_per_million / 1e6, 9))


def realized_assumed(ledger: DataFrame, now: int, rate_per_day: float, usd_per_million: float) -> DataFrame:
    """One row: baseline minus weight over each snapshot's interval up to now, at so many sessions a day."""
    marks = snapshots(ledger).where("n >= 2")
    end = F.least(F.coalesce("next_ts", F.lit(now)), F.lit(now))
    days = F.greatest(F.lit(0), end - F.col("ts")) / DAY
    count = days * rate_per_day
    # summed in the order of projects' totals only at the end, from whole seconds
    per = marks.agg(F.sum((F.col("baseline") - F.col("weight")) * count).alias("tokens"), F.sum(count).alias("sessions"))
    tokens = F.floor(F.col("tokens") + 0.5).cast("long")
    return per.select(tokens.alias("tokens"), F.floor(F.col("sessions") + 0.5).cast("long").alias("sessions"), F.round(tokens * usd_per_million / 1e6, 9).alias("usd"))


def sparkline(ledger: DataFrame) -> DataFrame:
    """Per snapshot of projects with two or more: what it saves against the first, not below zero."""
    return snapshots(ledger).where("n >= 2").select("project_key", "place", "ts", F.greatest(F.lit(0), F.col("baseline") - F.col("weight")).alias("saved"))


def history(ledger: DataFrame) -> DataFrame:
    """Per project: its weights in time order as one string, and the times of the first and last."""
    rows = snapshots(ledger)
    series = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "weight"))), lambda x: x["weight"].cast("string")), ",")
    return rows.groupBy("project_key").agg(series.alias("weights"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("snapshots"))


def ranked_projects(rows: DataFrame, by: str, top: int) -> DataFrame:
    """The first so many projects of machine_projects(), by weight, sessions or recency, greatest first, then by key; with their place."""
    column = {"weight": "weight", "sessions": "sessions", "recency": "as_of"}[by]
    order = (F.col(column).desc(), F.col("project_key"))
    return rows.orderBy(*order).limit(top).withColumn("place", F.row_number().over(Window.orderBy(*order))).select("place", *rows.columns)  # so many rows


def machine_projects(ledger: DataFrame, sessions: DataFrame) -> DataFrame:
    """Latest weight of each project with its number of sessions (projects with an empty key have none)."""
    now = latest(ledger).where(F.col("command") == "project").select("project_key", F.col("always_tokens").alias("weight"), F.col("ts").alias("as_of"))
    count = sessions.where("project_key <> ''").groupBy("project_key").agg(F.count("*").alias("sessions"))
    return now.join(count, "project_key", "left").withColumn("sessions", F.coalesce("sessions", F.lit(0)))
