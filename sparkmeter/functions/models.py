"""Model prices, model ids, and cost expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Observed list prices in USD per million tokens.
# id, provider, input, output, cache_read, write_5m, write_1h, long_threshold, long_input, long_output, is_default
PRICES: tuple[tuple, ...] = (
    ("claude-opus-4.8", "anthropic", 5.0, 25.0, 0.50, 6.25, 10.0, None, None, None, False),
    ("claude-opus-4.7", "anthropic", 5.0, 25.0, 0.50, 6.25, 10.0, None, None, None, False),
    ("claude-sonnet-4.6", "anthropic", 3.0, 15.0, 0.30, 3.75, 6.0, None, None, None, True),
    ("claude-haiku-4.5", "anthropic", 1.0, 5.0, 0.10, 1.25, 2.0, None, None, None, False),
    ("gpt-5.5", "openai", 5.0, 30.0, 0.50, None, None, None, None, None, False),
    ("gpt-5.4", "openai", 2.5, 15.0, 0.25, None, None, None, None, None, True),
    ("gpt-5.4-mini", "openai", 0.75, 4.5, 0.075, None, None, None, None, None, False),
    ("gpt-5.4-nano", "openai", 0.20, 1.25, 0.02, None, None, None, None, None, False),
    ("gemini-2.5-pro", "gemini", 1.25, 10.0, 0.125, None, None, 200_000, 2.5, 15.0, True),
    ("gemini-2.5-flash", "gemini", 0.30, 2.5, 0.03, None, None, None, None, None, False),
    ("gemini-2.5-flash-lite", "gemini", 0.10, 0.40, 0.01, None, None, None, None, None, False),
)
COLUMNS = "model string, provider string, in_rate double, out_rate double, read_rate double, w5_rate double, w1_rate double, long_threshold bigint, long_in double, long_out double, is_default boolean"


def prices(spark: SparkSession) -> DataFrame:
    """The price table; its size is fixed, so joins may broadcast it."""
    return F.broadcast(spark.createDataFrame(list(PRICES), COLUMNS))


def prices_sql() -> str:
    """The same rows as a VALUES list, for SQL."""
    text = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v).upper() if isinstance(v, bool) else f"{v!r}::DOUBLE" if isinstance(v, float) else str(v)
    return ", ".join("(" + ", ".join(map(text, row)) + ")" for row in PRICES)


def normalized(model: Column) -> Column:
    """Model id without date tail, in lower case; a pair of neighbouring numbers is joined by a dot, each number once."""
    plain = F.regexp_replace(F.lower(F.trim(model)), r"-\d{8}$", "")
    return F.regexp_replace(plain, r"(^|-)(\d+)-(\d+)(?=-|$)", "$1$2.$3")


def usage_cost() -> Column:
    """USD of token sums at a price row; cache rates that a provider lacks fall back to its input rate."""
    rate = lambda c: F.coalesce(F.col(c), F.col("in_rate"))
    terms = F.col("input") * F.col("in_rate") + F.col("output") * F.col("out_rate")
    terms = terms + F.col("cache_read") * rate("read_rate") + F.col("w5") * rate("w5_rate") + F.col("w1") * rate("w1_rate")
    return terms / 1e6


def estimate(requests: DataFrame, table: DataFrame) -> DataFrame:
    """Call cost of what-if requests.

    Rows: model, input_tokens, output_tokens (or null), estimate_output, output_ratio, calls, cache_hit_rate,
    cache_write_tokens, cache_ttl ('5m' or '1h'), batch_fraction, long_context. Rates of a write that a provider lacks
    cost nothing here. Adds the call's fresh_input, cached_input, cache_write, output and total, and grand_total.
    """
    share = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col(c), F.lit(0.0))))
    rows = requests.join(table, "model")
    far = F.coalesce(F.col("long_context") & (F.col("input_tokens") > F.col("long_threshold")), F.lit(False))
    rate_in, rate_out = F.when(far, F.col("long_in")).otherwise(F.col("in_rate")), F.when(far, F.col("long_out")).otherwise(F.col("out_rate"))
    hit, batch = share("cache_hit_rate"), share("batch_fraction")
    discount = 1 - 0.5 * batch
    cached = F.floor(F.col("input_tokens") * hit + 0.5)
    fresh = F.greatest(F.col("input_tokens") - cached, F.lit(0))
    out = F.coalesce(F.col("output_tokens"), F.when(F.col("estimate_output"), F.floor(F.col("input_tokens") * F.col("output_ratio") + 0.5)).otherwise(F.lit(0)))
    write = F.when(F.col("cache_ttl") == "1h", F.col("w1_rate")).otherwise(F.col("w5_rate"))
    rows = rows.select(
        *requests.columns,
        (fresh / 1e6 * rate_in * discount).alias("fresh_input"),
        (cached / 1e6 * F.coalesce("read_rate", rate_in)).alias("cached_input"),
        (F.col("cache_write_tokens") / 1e6 * F.coalesce(write, F.lit(0.0))).alias("cache_write"),
        (out / 1e6 * rate_out * discount).alias("output"),
    )
    rows = rows.withColumn("total", F.col("fresh_input") + F.col("cached_input") + F.col("cache_write") + F.col("output"))
    return rows.withColumn("grand_total", F.col("total") * F.greatest(F.lit(1), F.col("calls")))
