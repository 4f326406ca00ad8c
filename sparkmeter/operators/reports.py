"""Rows as people read them: numbers, ages, shortened paths, and reports as Markdown or HTML over a few collected rows."""

from __future__ import annotations

import html

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.models import usage_cost
from ..functions.scalars import ratio
from .tiers import identified
from .usage import SESSION, TOKENS, priced


def commas(n: Column) -> Column:
    return F.format_number(n, 0)


def usd(v: Column) -> Column:
    fixed = lambda d: F.concat(F.lit("$"), F.format_string(f"%.{d}f", v))
    return F.when(v == 0, "$0").when(v < 0.01, fixed(5)).when(v < 1, fixed(3)).otherwise(fixed(2))


def humanized(n: Column) -> Column:
    """950, 12.4k, 1.2M, 340B: one decimal below a hundred, none from there on."""

    def of(scale: float, mark: str) -> Column:
        v = n / F.lit(scale)
        return F.concat(F.when(v >= 100, F.format_string("%.0f", v)).otherwise(F.format_string("%.1f", v)), F.lit(mark))

    return F.when(n < 1000, n.cast("string")).when(n < 1_000_000, of(1e3, "k")).when(n < 1_000_000_000, of(1e6, "M")).otherwise(of(1e9, "B"))


def age(now: Column, ts: Column) -> Column:
    """Time since, in its largest unit; a time to come is now."""
    s = F.greatest(F.lit(0), now - ts)
    of = lambda unit, mark: F.concat(F.floor(s / unit).cast("string"), F.lit(mark))
    return F.when(s < 60, "now").when(s < 3600, of(60, "m")).when(s < 86_400, of(3600, "h")).when(s < 86_400_000, of(86_400, "d")).otherwise("999d+")


def escaped(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def delta_markdown(delta: DataFrame) -> str:
    """The table of a change report; its three rows are collected."""
    lines = ["### Change vs base", "", "| Metric | Base | Head | Delta | Percent of base |", "| :--- | ---: | ---: | ---: | ---: |"]
    for r in delta.orderBy("metric").collect():
        pct = "n/a" if r["pct"] is None else f"{r['pct']:+.1f}%"
        lines.append(f"| {r['metric']} | {r['base']:,} | {r['head']:,} | {r['delta']:+,} | {pct} |")
    return "\n".join(lines) + "\n"


def html_table(rows: DataFrame, title: str, most: int = 200) -> str:
    """A page with one table of at most so many rows, which the caller has put in order."""
    cells = lambda values, tag: "<tr>" + "".join(f"<{tag}>{html.escape(str(v))}</{tag}>" for v in values) + "</tr>"
    body = "".join(cells(r, "td") for r in rows.limit(most).collect())
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1><table>{cells(rows.columns, 'th')}{body}</table></body></html>"


def snapshot(requests: DataFrame, ledger: DataFrame, table: DataFrame) -> DataFrame:
    """One row from one pass over the requests and one over the ledger: sessions, tokens, cost, cache health, output's share, identified savings.

    All figures come from one table of sums by session and model, so tiers, cache and advisories agree with each other.
    """
    base = requests.groupBy(*SESSION, "model").agg(F.count("*").alias("requests"), *[F.sum(c).alias(c) for c in TOKENS])
    whole = base.groupBy("model").agg(F.sum("requests").alias("requests"), *[F.sum(c).alias(c) for c in TOKENS])
    costed = priced(whole, table).withColumn("cost", usage_cost()).withColumn("out_cost", F.col("output") * F.col("out_rate") / 1e6)
    sums = costed.agg(*[F.sum(c).alias(c) for c in ("requests", *TOKENS)], F.sum("cost").alias("cost"), F.sum("out_cost").alias("out_cost"))
    counts = base.select(*SESSION).distinct().agg(F.count("*").alias("sessions"), F.count_if("is_subagent").alias("subagent_streams"))
    saved = identified(ledger).select("project_min", "project_max")
    records = ledger.agg(F.count("*").alias("ledger_records"))
    one = sums.crossJoin(counts).crossJoin(saved).crossJoin(records)  # single rows
    side = F.col("input") + F.col("cache_read") + F.col("w5") + F.col("w1")
    return one.select(
        "sessions", "subagent_streams", "ledger_records", "requests", *TOKENS, F.round("cost", 9).alias("cost_usd"), F.round(ratio(F.col("cache_read"), side), 9).alias("hit_rate"),
        F.round(ratio(F.col("out_cost"), F.col("cost")), 9).alias("output_share"), "project_min", "project_max",
    )


def stats_json(snapshots: DataFrame, scope: str = "global") -> DataFrame:
    """A snapshot's counts as one JSON report, in a fixed order of fields."""
    cache = F.struct("cache_read", "w5", "w1").alias("cache")
    tiers = F.struct(F.struct("project_min", "project_max").alias("identified"), F.struct("requests", "input", "output", cache).alias("measured")).alias("tiers")
    ingestion = F.struct(F.col("sessions").alias("sessions_scanned"), (F.col("sessions") - F.col("subagent_streams")).alias("parent_sessions"), "subagent_streams").alias("ingestion")
    return snapshots.select(F.to_json(F.struct(F.lit(scope).alias("scope"), F.struct(F.col("ledger_records").alias("records")).alias("ledger"), ingestion, tiers)).alias("json"))
