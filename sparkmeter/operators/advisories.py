"""Model mix, output share, daily cost and spend projection; calendar series for dashboards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.models import usage_cost
from ..functions.scalars import ratio
from .usage import SESSION, input_side, priced, session_days, session_models, sessions

FRONTIER, CHEAP = 0.25, 0.10
ACTIVE_DAYS = 3


def model_mix(requests: DataFrame, table: DataFrame) -> DataFrame:
    """One row: the model of most spend (ties: the last id), that of the least input rate (the first), and both flags."""
    sums = requests.groupBy("model").agg(*[F.sum(c).alias(c) for c in ("input", "output", "cache_read", "w5", "w1")])
    costs = priced(sums, table).where("in_rate is not null").withColumn("cost", usage_cost())
    one = costs.agg(
        F.sum("cost").alias("total"), F.max_by("model", F.struct("cost", "model")).alias("frontier_model"), F.max("cost").alias("frontier_cost"),
        F.min_by(F.struct("model", "cost"), F.struct("in_rate", "model")).alias("c"),
    ).where("total > 0")
    share, small = F.col("frontier_cost") / F.col("total"), F.col("c.cost") / F.col("total")
    return one.select(
        F.round("total", 9).alias("priced_spend"), "frontier_model", F.round(share, 9).alias("frontier_share"), (share > FRONTIER).alias("frontier_flag"),
        F.col("c.model").alias("cheap_model"), F.round(small, 9).alias("cheap_share"), (small < CHEAP).alias("cheap_flag"),
    )


def output_share(requests: DataFrame, table: DataFrame) -> DataFrame:
    sums = requests.groupBy("model").agg(*[F.sum(c).alias(c) for c in ("input", "output", "cache_read", "w5", "w1")])
    costs = priced(sums, table)
    known = F.col("in_rate").isNotNull()
    one = costs.agg(F.sum("output").alias("output_tokens"), F.sum(F.when(known, F.col("output") * F.col("out_rate") / 1e6)).alias("o"), F.sum(F.when(known, usage_cost())).alias("t"))
    return one.select("output_tokens", F.round("o", 9).alias("output_usd"), F.round("t", 9).alias("priced_usd"), F.round(ratio(F.col("o"), F.col("t")), 9).alias("output_share"))


def daily_cost(requests: DataFrame, table: DataFrame) -> DataFrame:
    """Each session's priced cost, dealt over its days by their share of its input and output."""
    models = priced(session_models(requests), table).withColumn("cost", usage_cost())
    cost = models.groupBy(*SESSION).agg(F.sum("cost").alias("cost"))
    volume = (input_side() + F.col("output")).alias("volume")
    days = session_days(requests).select(*SESSION, "day", volume)
    whole = sessions(requests).select(*SESSION, (input_side() + F.col("output")).alias("whole"))
    dealt = days.join(whole, SESSION).join(cost, SESSION).where("cost is not null and whole > 0")
    return dealt.groupBy("day").agg(F.sum(F.col("cost") * F.col("volume") / F.col("whole")).alias("cost_usd"))


def cap_runway(requests: DataFrame, table: DataFrame, today: str, cap: float) -> DataFrame:
    """One row a window of 7 and 30 days: month to date, what is left, the daily rate, and the day the cap is reached."""
    days = daily_cost(requests, table)
    month = days.agg(F.coalesce(F.sum(F.when(F.col("day").startswith(today[:7]), F.col("cost_usd"))), F.lit(0.0)).alias("mtd"))
    spans = requests.sparkSession.createDataFrame([(7,), (30,)], "window_days int")
    end = F.lit(today).cast("date")
    when = F.col("day").cast("date")
    inside = (when >= F.date_sub(end, F.col("window_days") - 1)) & (when <= end)
    sums = F.broadcast(spans).join(days, inside, "left").groupBy("window_days")
    sums = sums.agg(F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("spent"), F.count_if(F.col("cost_usd") > 0).alias("active_days"))
    rows = sums.crossJoin(month).withColumn("rate", F.col("spent") / F.col("window_days")).withColumn("left", F.lit(cap) - F.col("mtd"))  # by one row
    reached = F.col("mtd") >= cap
    ahead = ~reached & (F.col("active_days") >= ACTIVE_DAYS) & (F.col("rate") > 0)
    date = F.when(ahead, F.date_format(F.date_add(end, F.ceil(F.col("left") / F.when(ahead, F.col("rate"))).cast("int")), "yyyy-MM-dd"))
    return rows.select(
        "window_days", F.round("mtd", 9).alias("mtd_usd"), F.round(F.greatest(F.lit(0.0), F.col("left")), 9).alias("remaining_usd"), reached.alias("reached"),
        "active_days", F.round("rate", 9).alias("daily_usd"), date.alias("cap_date"),
    )


def calendar(requests: DataFrame, table: DataFrame, today: str, days: int = 30) -> DataFrame:
    """The last days up to today, one row each, zero where nothing was used."""
    spark = requests.sparkSession
    dates = spark.range(days).select(F.date_format(F.date_sub(F.lit(today).cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("day"))
    used = requests.groupBy("day").agg(F.sum(input_side()).alias("input_side"), F.sum("input").alias("fresh"), F.sum("cache_read").alias("cache_read"), F.sum("output").alias("output"))
    rows = dates.join(used, "day", "left").join(daily_cost(requests, table), "day", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.select("day", zero("input_side"), zero("fresh"), zero("cache_read"), zero("output"), F.round(F.coalesce("cost_usd", F.lit(0.0)), 9).alias("cost_usd"))


def spend_bars(requests: DataFrame, table: DataFrame, today: str, days: int = 30, height: int = 8) -> DataFrame:
    """Calendar rows with the bar's per cent of the tallest and its rounded-up height."""
    rows = calendar(requests, table, today, days).select("day", "input_side")
    most = rows.agg(F.max("input_side").alias("most"))
    rows = rows.join(F.broadcast(most))
    return rows.select("day", "input_side", F.floor(F.when(F.col("most") > 0, F.col("input_side") * 100 / F.col("most")).otherwise(F.lit(0.0))).alias("percent"), F.ceil(F.when(F.col("most") > 0, F.col("input_side") * height / F.col("most")).otherwise(F.lit(0.0))).alias("bar"))
