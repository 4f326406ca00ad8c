"""Usage analytics over requests: dedup, sessions, cost, cache health.

Requests: source, session_id, project_key, is_subagent, model, ts (epoch seconds), day, input, output, cache_read, w5, w1.
A session is (source, is_subagent, session_id, project_key). Sums stay integers until the last step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.models import normalized, usage_cost
from ..functions.scalars import ratio

SESSION = ["source", "is_subagent", "session_id", "project_key"]
TOKENS = ["input", "output", "cache_read", "w5", "w1"]
TTL_5M, TTL_1H = 300, 3600
FACTOR_5M, FACTOR_1H = 1.15, 1.9


def input_side() -> Column:
    return F.col("input") + F.col("cache_read") + F.col("w5") + F.col("w1")


def writes() -> Column:
    return F.col("w5") + F.col("w1")


def last_lines(records: DataFrame) -> DataFrame:
    """In each file the last line of a (message_id, request_id) stays, whatever its time."""
    order = Window.partitionBy("file", "message_id", "request_id").orderBy(F.col("line_no").desc())
    return records.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def winners(records: DataFrame) -> DataFrame:
    """Across files: latest time, then most output, then the first path in order of its components."""
    order = Window.partitionBy("message_id", "request_id").orderBy(F.col("ts").desc(), F.col("output").desc(), F.split("file", "/").asc())
    return records.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def _sums() -> list[Column]:
    return [F.sum(c).alias(c) for c in TOKENS]


def sessions(requests: DataFrame) -> DataFrame:
    return requests.groupBy(*SESSION).agg(F.count("*").alias("requests"), *_sums(), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def session_models(requests: DataFrame) -> DataFrame:
    return requests.groupBy(*SESSION, "model").agg(*_sums())


def session_days(requests: DataFrame) -> DataFrame:
    return requests.groupBy(*SESSION, "day").agg(*_sums())


def scoped(requests: DataFrame, project: str | None = None, source: str | None = None) -> DataFrame:
    if project is not None:
        requests = requests.where(F.col("project_key") == project)
    return requests if source is None else requests.where(F.col("source") == source)


def priced(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Rows with a model, joined to their price row on the normalized id; unmatched rows keep null rates."""
    return rows.withColumn("_id", normalized(F.col("model"))).join(table.withColumnRenamed("model", "_id"), "_id", "left").drop("_id")


def cost_by_model(requests: DataFrame, table: DataFrame) -> DataFrame:
    sums = requests.groupBy("model").agg(F.count("*").alias("requests"), *_sums())
    costed = priced(sums, table).withColumn("cost_usd", usage_cost())
    return costed.select("model", "requests", *TOKENS, F.round("cost_usd", 9).alias("cost_usd"), F.col("in_rate").isNotNull().alias("is_priced"))


def unpriced_models(requests: DataFrame, table: DataFrame) -> DataFrame:
    sums = requests.groupBy("model").agg(F.sum(input_side() + F.col("output")).alias("tokens"))
    return priced(sums, table).where("in_rate is null").select("model", "tokens")


def measured(requests: DataFrame, table: DataFrame) -> DataFrame:
    """One row: sessions, requests, token sums, span of time, priced cost, hit rate, unpriced tokens."""
    models = requests.groupBy("model").agg(F.count("*").alias("requests"), *_sums(), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    costed = priced(models, table).withColumn("cost_usd", usage_cost())
    one = costed.agg(
        F.sum("requests").alias("requests"), *_sums(), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), F.round(F.sum("cost_usd"), 9).alias("cost_usd"),
        F.coalesce(F.sum(F.when(F.col("in_rate").isNull(), input_side() + F.col("output"))), F.lit(0)).alias("unpriced_tokens"),
    )
    count = requests.select(*SESSION).distinct().agg(F.count("*").alias("sessions"))
    return one.crossJoin(count).withColumn("hit_rate", F.round(ratio(F.col("cache_read"), input_side()), 9))  # one row by one row


def hit_rate(requests: DataFrame) -> DataFrame:
    sums = requests.agg(F.coalesce(F.sum("cache_read"), F.lit(0)).alias("cache_read"), F.coalesce(F.sum(input_side()), F.lit(0)).alias("input_side"))
    return sums.withColumn("hit_rate", F.round(ratio(F.col("cache_read"), F.col("input_side")), 9))


def low_hit_days(requests: DataFrame, below: float = 0.5) -> DataFrame:
    """Days with input whose hit rate is under the bar; the worst is the first of the least rate."""
    days = requests.groupBy("day").agg(F.sum("cache_read").alias("cache_read"), F.sum(input_side()).alias("input_side")).where("input_side > 0")
    low = days.withColumn("rate", F.col("cache_read") / F.col("input_side")).where(F.col("rate") < below)
    worst = low.agg(F.min_by("day", F.struct("rate", "day")).alias("worst"))
    return low.join(F.broadcast(worst)).select("day", "cache_read", "input_side", F.round("rate", 9).alias("hit_rate"), (F.col("day") == F.col("worst")).alias("is_worst"))


def _timeline() -> Window:
    return Window.partitionBy(*SESSION).orderBy("ts", "input", "cache_read", "w5", "w1")


def churn(requests: DataFrame) -> DataFrame:
    """Per session: total writes, the first write's size, and what was written after it."""
    first = F.min_by(writes(), F.when(writes() > 0, F.struct("ts", "input", "cache_read", "w5", "w1")))
    per = requests.groupBy(*SESSION).agg(F.sum(writes()).alias("total_writes"), F.coalesce(first, F.lit(0)).alias("first_write"), F.min("ts").alias("first_ts"))
    return per.withColumn("after_first", F.col("total_writes") - F.when(F.col("total_writes") > 0, F.col("first_write")).otherwise(F.lit(0)))


def churn_report(requests: DataFrame) -> DataFrame:
    per = churn(requests)
    sums = per.agg(F.sum("total_writes").alias("total_writes"), F.sum("after_first").alias("after_first"), F.count_if(F.col("total_writes") > 0).alias("sessions_with_writes"))
    return sums.withColumn("after_share", F.round(ratio(F.col("after_first"), F.col("total_writes")), 9))


def worst_sessions(requests: DataFrame, top: int = 5) -> DataFrame:
    per = churn(requests).where("after_first > 0")
    return per.orderBy(F.col("after_first").desc(), "first_ts", "session_id", "project_key", "source", "is_subagent").limit(top).select(*SESSION, "total_writes", "after_first", "first_ts")


def ttl_events(requests: DataFrame) -> DataFrame:
    """Per session how often a prefix would be written with each time to live; a gap of exactly the time is a hit."""
    gaps = requests.withColumn("gap", F.col("ts") - F.lag("ts").over(_timeline()))
    past = lambda ttl: (1 + F.count_if(F.col("gap") > ttl)).alias(f"events_{ttl}")
    return gaps.groupBy(*SESSION).agg(past(TTL_5M), past(TTL_1H))


def dominant_models(requests: DataFrame) -> DataFrame:
    sums = requests.groupBy(*SESSION, "model").agg(F.sum(input_side()).alias("volume"))
    return sums.groupBy(*SESSION).agg(F.min_by("model", F.struct(-F.col("volume"), "model")).alias("model"))


def ttl_counterfactual(requests: DataFrame, table: DataFrame) -> DataFrame:
    """One row: observed writes, simulated events and tokens for both times to live, dollars, and which is cheaper."""
    per = churn(requests).join(ttl_events(requests), SESSION).join(dominant_models(requests), SESSION)
    live = per.where("total_writes > 0")
    tokens = live.groupBy("model").agg(
        F.count("*").alias("n"), F.sum(f"events_{TTL_5M}").alias("e5"), F.sum(f"events_{TTL_1H}").alias("e1"),
        F.sum(F.col(f"events_{TTL_5M}") * F.col("first_write")).alias("t5"), F.sum(F.col(f"events_{TTL_1H}") * F.col("first_write")).alias("t1"),
    )
    rate = lambda c: F.coalesce(F.col(c), F.col("in_rate"))
    dollars = lambda t, w: F.round(F.coalesce(F.sum(F.col(t) * (rate(w) - rate("read_rate")) / 1e6), F.lit(0.0)), 9)
    both = F.col("t5") + F.col("t1")
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    simulated = priced(tokens, table).agg(
        zero("n").alias("sessions_simulated"), zero("e5").alias("w5_events"), zero("e1").alias("w1_events"), zero("t5").alias("w5_tokens"), zero("t1").alias("w1_tokens"),
        dollars("t5", "w5_rate").alias("usd_5m"), dollars("t1", "w1_rate").alias("usd_1h"), zero(F.when(F.col("in_rate").isNotNull(), both)).alias("priced_tokens"), zero(both).alias("all_tokens"),
    )
    seen = requests.agg(F.sum("w5").alias("observed_5m"), F.sum("w1").alias("observed_1h"))
    idle = per.agg(F.count_if(F.col("total_writes") == 0).alias("sessions_excluded"))
    w5, w1 = F.col("w5_tokens") * FACTOR_5M, F.col("w1_tokens") * FACTOR_1H
    verdict = F.when(F.col("sessions_simulated") == 0, "none").when(w1 < w5, "1h").when(w1 > w5, "5m").otherwise("tie")
    one = simulated.crossJoin(seen).crossJoin(idle)  # single rows
    return one.select(
        "observed_5m", "observed_1h", "sessions_simulated", "sessions_excluded", "w5_events", "w1_events", "w5_tokens", "w1_tokens", "usd_5m", "usd_1h",
        F.round(ratio(F.col("priced_tokens"), F.col("all_tokens")), 9).alias("priced_share"), verdict.alias("verdict"),
    )


def cadence(requests: DataFrame) -> DataFrame:
    """One row: gaps within and between sessions, and sessions that read nothing from the cache."""
    gaps = requests.withColumn("gap", F.col("ts") - F.lag("ts").over(_timeline()))
    inside = gaps.agg(F.count("gap").alias("intra_gaps"), F.count_if(F.col("gap") > TTL_5M).alias("intra_over_5m"))
    per = requests.groupBy(*SESSION).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.max("cache_read").alias("most_read"))
    order = Window.partitionBy("project_key").orderBy("first_ts", "last_ts", "session_id", "source", "is_subagent")
    between = per.withColumn("gap", F.greatest(F.lit(0), F.col("first_ts") - F.lag("last_ts").over(order)))
    between = between.withColumn("gap", F.when(F.lag("last_ts").over(order).isNotNull(), F.col("gap")))
    outside = between.agg(F.count("gap").alias("inter_gaps"), F.count_if(F.col("gap") < TTL_1H).alias("inter_under_1h"), F.count_if(F.col("most_read") == 0).alias("zero_read_sessions"), F.count("*").alias("sessions"))
    one = inside.crossJoin(outside)  # one row by one row
    return one.withColumn("intra_share", F.round(ratio(F.col("intra_over_5m"), F.col("intra_gaps")), 9)).withColumn("inter_share", F.round(ratio(F.col("inter_under_1h"), F.col("inter_gaps")), 9))
