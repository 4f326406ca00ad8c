"""Queries of usage analytics over whole tables, each with the SQL that it is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.models import estimate, prices, prices_sql
from ..operators import advisories as A
from ..operators import tiers as T
from ..operators import usage as U
from ..sources import tables as S

TODAY, CAP, NOW, RATE, USD = "2024-01-20", 40.0, 1_706_745_600, 10.0, 3.0
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

PRICES = f"prices AS (SELECT * FROM (VALUES {prices_sql()}) AS t(id, provider, in_rate, out_rate, read_rate, w5_rate, w1_rate, long_threshold, long_in, long_out, is_default))"
COST = "(input * in_rate + output * out_rate + cache_read * coalesce(read_rate, in_rate) + w5 * coalesce(w5_rate, in_rate) + w1 * coalesce(w1_rate, in_rate)) / 1e6"
SUMS = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in U.TOKENS)
KEY = "source, is_subagent, session_id, project_key"
LINE = f"PARTITION BY {KEY} ORDER BY ts, input, cache_read, w5, w1"


def query(name: str, sql: str, *more: str) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[name] = f
        SQL[name] = f"WITH {', '.join([S.SQL.strip(), PRICES, *more])} {sql}"
        return f

    return add


MODEL = f"mc AS (SELECT model, any_value(price_id) AS price_id, CAST(count(*) AS BIGINT) AS requests, {SUMS}, min(ts) AS first_ts, max(ts) AS last_ts FROM requests GROUP BY model), pc AS (SELECT *, {COST} AS cost FROM mc LEFT JOIN prices ON price_id = id)"


@query("cost_by_model", "SELECT model, requests, input, output, cache_read, w5, w1, round(cost, 9) AS cost_usd, in_rate IS NOT NULL AS is_priced FROM pc", MODEL)
def cost_by_model(spark, d):
    return U.cost_by_model(S.requests(spark, d), prices(spark))


@query("unpriced_models", "SELECT model, input + output + cache_read + w5 + w1 AS tokens FROM pc WHERE in_rate IS NULL", MODEL)
def unpriced_models(spark, d):
    return U.unpriced_models(S.requests(spark, d), prices(spark))


@query(
    "measured_tier",
    """SELECT CAST(sum(requests) AS BIGINT) AS requests, CAST(sum(input) AS BIGINT) AS input, CAST(sum(output) AS BIGINT) AS output, CAST(sum(cache_read) AS BIGINT) AS cache_read, CAST(sum(w5) AS BIGINT) AS w5, CAST(sum(w1) AS BIGINT) AS w1,
    min(first_ts) AS first_ts, max(last_ts) AS last_ts, round(sum(cost), 9) AS cost_usd, CAST(sum(CASE WHEN in_rate IS NULL THEN input + output + cache_read + w5 + w1 ELSE 0 END) AS BIGINT) AS unpriced_tokens,
    (SELECT CAST(count(*) AS BIGINT) FROM sess) AS sessions, round(sum(cache_read) / sum(input + cache_read + w5 + w1), 9) AS hit_rate FROM pc""",
    MODEL,
)
def measured_tier(spark, d):
    return U.measured(S.requests(spark, d), prices(spark))


@query("sessions_rollup", "SELECT * FROM sess")
def sessions_rollup(spark, d):
    return U.sessions(S.requests(spark, d))


@query("session_by_model", f"SELECT {KEY}, model, {SUMS} FROM requests GROUP BY {KEY}, model")
def session_by_model(spark, d):
    return U.session_models(S.requests(spark, d))


@query("session_by_day", f"SELECT {KEY}, day, {SUMS} FROM requests GROUP BY {KEY}, day")
def session_by_day(spark, d):
    return U.session_days(S.requests(spark, d))


@query("session_scope", f"SELECT {KEY}, CAST(count(*) AS BIGINT) AS requests, {SUMS}, min(ts) AS first_ts, max(ts) AS last_ts FROM requests WHERE project_key = 'p1' AND source = 'claude_code' GROUP BY {KEY}")
def session_scope(spark, d):
    return U.sessions(U.scoped(S.requests(spark, d), "p1", "claude_code"))


@query(
    "dedup_winners",
    """, lines AS (SELECT event_id, ts, output, 'p/b.jsonl' AS file, event_id * 2 + 1 AS line_no FROM ev
      UNION ALL SELECT event_id, ts, output + 7, 'p/b.jsonl', event_id * 2 FROM ev WHERE event_id % 3 = 0
      UNION ALL SELECT event_id, ts + event_id % 3 - 1, output + event_id % 2, 'p-b/x.jsonl', event_id FROM ev WHERE event_id % 7 = 0),
    infile AS (SELECT *, row_number() OVER (PARTITION BY file, event_id ORDER BY line_no DESC) AS n FROM lines),
    across AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY ts DESC, output DESC, string_split(file, '/')) AS k FROM infile WHERE n = 1)
    SELECT 'm' || event_id AS message_id, 'r' AS request_id, ts, output, file, line_no FROM across WHERE k = 1""".lstrip(", "),
)
def dedup_winners(spark, d):
    return U.winners(U.last_lines(S.records(spark, d)))


SQL["dedup_winners"] = SQL["dedup_winners"].replace(" lines AS (SELECT event_id", ", lines AS (SELECT event_id", 1)


@query("hit_rate_overall", "SELECT CAST(sum(cache_read) AS BIGINT) AS cache_read, CAST(sum(input_side) AS BIGINT) AS input_side, round(sum(cache_read) / sum(input_side), 9) AS hit_rate FROM requests WHERE source = 'claude_code'")
def hit_rate_overall(spark, d):
    return U.hit_rate(U.scoped(S.requests(spark, d), source="claude_code"))


@query(
    "hit_rate_low_days",
    "SELECT day, cache_read, input_side, round(rate, 9) AS hit_rate, row_number() OVER (ORDER BY rate, day) = 1 AS is_worst FROM days WHERE rate < 0.5",
    "days AS (SELECT day, CAST(sum(cache_read) AS BIGINT) AS cache_read, CAST(sum(input_side) AS BIGINT) AS input_side, sum(cache_read) / sum(input_side) AS rate FROM requests WHERE source = 'claude_code' GROUP BY day)",
)
def hit_rate_low_days(spark, d):
    return U.low_hit_days(U.scoped(S.requests(spark, d), source="claude_code"))


CHURN = f"""ordered AS (SELECT *, row_number() OVER ({LINE}) AS pos FROM requests WHERE source = 'claude_code'),
ch AS (SELECT {KEY}, CAST(sum(writes) AS BIGINT) AS total_writes, coalesce(arg_min(writes, pos) FILTER (writes > 0), 0) AS first_write, min(ts) AS first_ts FROM ordered GROUP BY {KEY}),
churn AS (SELECT *, total_writes - first_write AS after_first FROM ch)"""


@query("write_churn", "SELECT CAST(sum(total_writes) AS BIGINT) AS total_writes, CAST(sum(after_first) AS BIGINT) AS after_first, CAST(count(*) FILTER (total_writes > 0) AS BIGINT) AS sessions_with_writes, round(sum(after_first) / sum(total_writes), 9) AS after_share FROM churn", CHURN)
def write_churn(spark, d):
    return U.churn_report(U.scoped(S.requests(spark, d), source="claude_code"))


@query("worst_sessions", f"SELECT {KEY}, total_writes, after_first, first_ts FROM churn WHERE after_first > 0 ORDER BY after_first DESC, first_ts, session_id, project_key, source, is_subagent LIMIT 5", CHURN)
def worst_sessions(spark, d):
    return U.worst_sessions(U.scoped(S.requests(spark, d), source="claude_code"))


EVENTS = f"""gaps AS (SELECT *, ts - lag(ts) OVER ({LINE}) AS gap FROM requests WHERE source = 'claude_code'),
te AS (SELECT {KEY}, CAST(1 + count(*) FILTER (gap > 300) AS BIGINT) AS events_300, CAST(1 + count(*) FILTER (gap > 3600) AS BIGINT) AS events_3600 FROM gaps GROUP BY {KEY})"""


@query("ttl_events", "SELECT * FROM te", EVENTS)
def ttl_events(spark, d):
    return U.ttl_events(U.scoped(S.requests(spark, d), source="claude_code"))


DOMINANT = f"""vol AS (SELECT {KEY}, model, any_value(price_id) AS price_id, sum(input_side) AS v FROM requests WHERE source = 'claude_code' GROUP BY {KEY}, model),
dom AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY v DESC, model) AS n FROM vol) WHERE n = 1)"""


@query("dominant_model", f"SELECT {KEY}, model FROM dom", DOMINANT)
def dominant_model(spark, d):
    return U.dominant_models(U.scoped(S.requests(spark, d), source="claude_code"))


@query(
    "ttl_counterfactual",
    """SELECT (SELECT CAST(sum(w5) AS BIGINT) FROM ordered) AS observed_5m, (SELECT CAST(sum(w1) AS BIGINT) FROM ordered) AS observed_1h, CAST(sum(n) AS BIGINT) AS sessions_simulated,
    (SELECT CAST(count(*) AS BIGINT) FROM churn WHERE total_writes = 0) AS sessions_excluded, CAST(sum(e5) AS BIGINT) AS w5_events, CAST(sum(e1) AS BIGINT) AS w1_events, CAST(sum(t5) AS BIGINT) AS w5_tokens, CAST(sum(t1) AS BIGINT) AS w1_tokens,
    round(sum(t5 * (coalesce(w5_rate, in_rate) - coalesce(read_rate, in_rate)) / 1e6), 9) AS usd_5m, round(sum(t1 * (coalesce(w1_rate, in_rate) - coalesce(read_rate, in_rate)) / 1e6), 9) AS usd_1h,
    round(sum(CASE WHEN in_rate IS NOT NULL THEN t5 + t1 ELSE 0 END) / sum(t5 + t1), 9) AS priced_share,
    CASE WHEN sum(t1) * 1.9 < sum(t5) * 1.15 THEN '1h' WHEN sum(t1) * 1.9 > sum(t5) * 1.15 THEN '5m' ELSE 'tie' END AS verdict FROM tok LEFT JOIN prices ON price_id = id""",
    CHURN,
    EVENTS,
    DOMINANT,
    f"tok AS (SELECT model, any_value(price_id) AS price_id, count(*) AS n, sum(events_300) AS e5, sum(events_3600) AS e1, sum(events_300 * first_write) AS t5, sum(events_3600 * first_write) AS t1 FROM churn JOIN te USING ({KEY}) JOIN dom USING ({KEY}) WHERE total_writes > 0 GROUP BY model)",
)
def ttl_counterfactual(spark, d):
    return U.ttl_counterfactual(U.scoped(S.requests(spark, d), source="claude_code"), prices(spark))


@query(
    "cadence",
    """SELECT CAST(count(gap) AS BIGINT) AS intra_gaps, CAST(count(*) FILTER (gap > 300) AS BIGINT) AS intra_over_5m, (SELECT CAST(count(g) AS BIGINT) FROM b) AS inter_gaps, (SELECT CAST(count(*) FILTER (g < 3600) AS BIGINT) FROM b) AS inter_under_1h,
    (SELECT CAST(count(*) FILTER (r = 0) AS BIGINT) FROM b) AS zero_read_sessions, (SELECT CAST(count(*) AS BIGINT) FROM b) AS sessions, round(count(*) FILTER (gap > 300) / count(gap), 9) AS intra_share,
    (SELECT round(count(*) FILTER (g < 3600) / count(g), 9) FROM b) AS inter_share FROM gaps""",
    EVENTS,
    f"""per AS (SELECT {KEY}, min(ts) AS f, max(ts) AS l, max(cache_read) AS r FROM requests WHERE source = 'claude_code' GROUP BY {KEY}),
    b AS (SELECT *, greatest(0, f - lag(l) OVER w) + 0 * lag(l) OVER w AS g FROM per WINDOW w AS (PARTITION BY project_key ORDER BY f, l, session_id, source, is_subagent))""",
)
def cadence(spark, d):
    return U.cadence(U.scoped(S.requests(spark, d), source="claude_code"))


@query(
    "identified_tier",
    """SELECT CAST(sum(p // 10) AS BIGINT) AS project_min, CAST(sum(p // 5) AS BIGINT) AS project_max, max(pt) AS project_as_of, CAST(sum(m // 3) AS BIGINT) AS mcp_swap, CAST(sum(m // 7) AS BIGINT) AS mcp_slim, max(mt) AS mcp_as_of,
    CAST(sum(a // 20) AS BIGINT) AS audit_min, CAST(sum(a // 8) AS BIGINT) AS audit_max, max(au) AS audit_as_of, CAST(count(*) AS BIGINT) AS projects FROM per""",
    """lat AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_key, command ORDER BY ts DESC, line_no DESC) AS n FROM ledger) WHERE n = 1),
    per AS (SELECT project_key, max(price) FILTER (k = 0) AS p, max(ts) FILTER (k = 0) AS pt, coalesce(max(price) FILTER (k = 1), max(price) FILTER (k = 2)) AS m, coalesce(max(ts) FILTER (k = 1), max(ts) FILTER (k = 2)) AS mt,
      max(price) FILTER (k = 3) AS a, max(ts) FILTER (k = 3) AS au FROM lat GROUP BY project_key)""",
)
def identified_tier(spark, d):
    return T.identified(S.ledger(spark, d))


SNAPS = """sn AS (SELECT project_key, ts, price AS weight, line_no, row_number() OVER w AS place, first_value(price) OVER w AS baseline, lead(ts) OVER w AS next_ts, count(*) OVER (PARTITION BY project_key) AS n
  FROM ledger WHERE k = 0 WINDOW w AS (PARTITION BY project_key ORDER BY ts, line_no)),
lastsn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_key, ts ORDER BY line_no DESC) AS z FROM sn WHERE n >= 2) WHERE z = 1)"""


@query(
    "realized_measured",
    "SELECT project_key, CAST(sum(baseline - weight) AS BIGINT) AS tokens, CAST(count(*) AS BIGINT) AS sessions, round(sum(baseline - weight) * 3.0::DOUBLE / 1e6, 9) AS usd FROM (SELECT l.* FROM sess s ASOF JOIN lastsn l ON s.project_key = l.project_key AND s.first_ts >= l.ts) GROUP BY project_key",
    SNAPS,
)
def realized_measured(spark, d):
    return T.realized_measured(S.ledger(spark, d), U.sessions(S.requests(spark, d)), USD)


@query(
    "realized_assumed",
    f"""SELECT CAST(floor(sum((baseline - weight) * c) + 0.5) AS BIGINT) AS tokens, CAST(floor(sum(c) + 0.5) AS BIGINT) AS sessions, round(floor(sum((baseline - weight) * c) + 0.5) * 3.0::DOUBLE / 1e6, 9) AS usd
    FROM (SELECT *, greatest(0, least(coalesce(next_ts, {NOW}), {NOW}) - ts) / 86400::DOUBLE * {RATE}::DOUBLE AS c FROM sn WHERE n >= 2)""",
    SNAPS,
)
def realized_assumed(spark, d):
    return T.realized_assumed(S.ledger(spark, d), NOW, RATE, USD)


@query("savings_sparkline", "SELECT project_key, CAST(place AS INTEGER) AS place, ts, greatest(0, baseline - weight) AS saved FROM sn WHERE n >= 2", SNAPS)
def savings_sparkline(spark, d):
    return T.sparkline(S.ledger(spark, d))


@query("project_history", "SELECT project_key, string_agg(weight, ',' ORDER BY place) AS weights, min(ts) AS first_ts, max(ts) AS last_ts, CAST(count(*) AS BIGINT) AS snapshots FROM sn GROUP BY project_key", SNAPS)
def project_history(spark, d):
    return T.history(S.ledger(spark, d))


@query(
    "machine_projects",
    "SELECT project_key, price AS weight, ts AS as_of, coalesce((SELECT CAST(count(*) AS BIGINT) FROM sess s WHERE s.project_key = l.project_key), 0) AS sessions FROM (SELECT *, row_number() OVER (PARTITION BY project_key ORDER BY ts DESC, line_no DESC) AS z FROM ledger WHERE k = 0) l WHERE z = 1",
)
def machine_projects(spark, d):
    return T.machine_projects(S.ledger(spark, d), U.sessions(S.requests(spark, d)))


@query(
    "model_mix",
    """SELECT round(sum(cost), 9) AS priced_spend, arg_max(model, cost) AS frontier_model, round(max(cost) / sum(cost), 9) AS frontier_share, max(cost) / sum(cost) > 0.25 AS frontier_flag,
    arg_min(model, in_rate) AS cheap_model, round(arg_min(cost, in_rate) / sum(cost), 9) AS cheap_share, arg_min(cost, in_rate) / sum(cost) < 0.1 AS cheap_flag FROM pc WHERE in_rate IS NOT NULL""",
    MODEL,
)
def model_mix(spark, d):
    return A.model_mix(S.requests(spark, d), prices(spark))


@query("output_share", "SELECT CAST(sum(output) AS BIGINT) AS output_tokens, round(sum(output * out_rate / 1e6), 9) AS output_usd, round(sum(cost), 9) AS priced_usd, round(sum(output * out_rate / 1e6) / sum(cost), 9) AS output_share FROM pc", MODEL)
def output_share(spark, d):
    return A.output_share(S.requests(spark, d), prices(spark))


DAILY = f"""smc AS (SELECT {KEY}, sum(c) AS cost FROM (SELECT *, {COST} AS c FROM (SELECT {KEY}, model, any_value(price_id) AS price_id, {SUMS} FROM requests GROUP BY {KEY}, model) JOIN prices ON price_id = id) GROUP BY {KEY}),
dv AS (SELECT {KEY}, day, sum(input_side + output) AS v FROM requests GROUP BY {KEY}, day), tv AS (SELECT {KEY}, sum(v) AS t FROM dv GROUP BY {KEY}),
daily AS (SELECT day, sum(cost * v / t) AS cost_usd FROM dv JOIN tv USING ({KEY}) JOIN smc USING ({KEY}) WHERE t > 0 GROUP BY day)"""


@query("daily_cost", "SELECT day, round(cost_usd, 9) AS cost_usd FROM daily", DAILY)
def daily_cost(spark, d):
    return A.daily_cost(S.requests(spark, d), prices(spark)).select("day", F.round("cost_usd", 9).alias("cost_usd"))


@query(
    "cap_runway",
    f"""SELECT w AS window_days, round(mtd, 9) AS mtd_usd, round(greatest(0.0, {CAP} - mtd), 9) AS remaining_usd, mtd >= {CAP} AS reached, active_days, round(spent / w, 9) AS daily_usd,
    CASE WHEN mtd < {CAP} AND active_days >= 3 AND spent > 0 THEN strftime(DATE '{TODAY}' + CAST(ceil(({CAP} - mtd) / (spent / w)) AS INTEGER), '%Y-%m-%d') END AS cap_date
    FROM (SELECT w, (SELECT coalesce(sum(cost_usd), 0) FROM daily WHERE day LIKE '{TODAY[:7]}%') AS mtd, (SELECT coalesce(sum(cost_usd), 0) FROM daily WHERE CAST(day AS DATE) BETWEEN DATE '{TODAY}' - (w - 1) AND DATE '{TODAY}') AS spent,
      (SELECT CAST(count(*) AS BIGINT) FROM daily WHERE cost_usd > 0 AND CAST(day AS DATE) BETWEEN DATE '{TODAY}' - (w - 1) AND DATE '{TODAY}') AS active_days FROM (VALUES (7), (30)) AS x(w))""",
    DAILY,
)
def cap_runway(spark, d):
    return A.cap_runway(S.requests(spark, d), prices(spark), TODAY, CAP)


CALENDAR = f"""cal AS (SELECT strftime(CAST(g AS DATE), '%Y-%m-%d') AS day FROM generate_series(DATE '{TODAY}' - 29, DATE '{TODAY}', INTERVAL 1 DAY) AS t(g)),
used AS (SELECT day, CAST(sum(input_side) AS BIGINT) AS input_side, CAST(sum(input) AS BIGINT) AS fresh, CAST(sum(cache_read) AS BIGINT) AS cache_read, CAST(sum(output) AS BIGINT) AS output FROM requests GROUP BY day)"""


@query("spend_details_30d", "SELECT day, coalesce(input_side, 0) AS input_side, coalesce(fresh, 0) AS fresh, coalesce(cache_read, 0) AS cache_read, coalesce(output, 0) AS output, round(coalesce(cost_usd, 0), 9) AS cost_usd FROM cal LEFT JOIN used USING (day) LEFT JOIN daily USING (day)", DAILY, CALENDAR)
def spend_details_30d(spark, d):
    return A.calendar(S.requests(spark, d), prices(spark), TODAY)


@query(
    "spend_bars_30d",
    "SELECT day, v AS input_side, CAST(floor(v * 100::DOUBLE / max(v) OVER ()) AS BIGINT) AS percent, CAST(ceil(v * 8::DOUBLE / max(v) OVER ()) AS BIGINT) AS bar FROM (SELECT day, coalesce(input_side, 0) AS v FROM cal LEFT JOIN used USING (day))",
    CALENDAR,
)
def spend_bars_30d(spark, d):
    return A.spend_bars(S.requests(spark, d), prices(spark), TODAY)


@query(
    "model_rows",
    "SELECT CAST(row_number() OVER (ORDER BY coalesce(cost, -1) DESC, model) AS INTEGER) AS place, model, input, output, round(cost, 9) AS cost_usd FROM pc",
    MODEL,
)
def model_rows(spark, d):
    from pyspark.sql import Window

    rows = U.cost_by_model(S.requests(spark, d), prices(spark))
    order = Window.orderBy(F.coalesce("cost_usd", F.lit(-1.0)).desc(), "model")  # one row a model
    return rows.select(F.row_number().over(order).alias("place"), "model", "input", "output", "cost_usd")


GRID = "grid AS (SELECT o_orderkey, ['claude-opus-4.7', 'gpt-5.4', 'gemini-2.5-pro', 'claude-haiku-4.5'][o_orderkey % 4 + 1] AS model, CAST(floor(o_totalprice) AS BIGINT) * 2 AS i, (o_orderkey % 5) / 4.0::DOUBLE AS hit, (o_orderkey % 3) / 2.0::DOUBLE AS batch, o_orderkey % 7 * 100 AS wr FROM orders)"


@query(
    "cost_estimates",
    """SELECT o_orderkey, model, round(fresh, 12) AS fresh_input, round(cin, 12) AS cached_input, round(cw, 12) AS cache_write, round(ou, 12) AS output, round((fresh + cin + cw + ou) * greatest(1, o_orderkey % 4), 12) AS grand_total FROM (
    SELECT *, greatest(i - floor(i * hit + 0.5), 0) / 1e6 * ri * (1 - 0.5 * batch) AS fresh, floor(i * hit + 0.5) / 1e6 * coalesce(read_rate, ri) AS cin, wr / 1e6 * coalesce(CASE WHEN o_orderkey % 2 = 1 THEN w1_rate ELSE w5_rate END, 0) AS cw,
      floor(i * 0.25::DOUBLE + 0.5) / 1e6 * ro * (1 - 0.5 * batch) AS ou FROM (
      SELECT g.*, p.*, CASE WHEN i > long_threshold THEN long_in ELSE in_rate END AS ri, CASE WHEN i > long_threshold THEN long_out ELSE out_rate END AS ro FROM grid g JOIN prices p ON g.model = p.id))""",
    GRID,
)
def cost_estimates(spark, d):
    key = F.col("o_orderkey")
    model = F.element_at(F.array(*map(F.lit, ("claude-opus-4.7", "gpt-5.4", "gemini-2.5-pro", "claude-haiku-4.5"))), (F.pmod(key, F.lit(4)) + 1).cast("int"))
    asks = S.table(spark, d, "orders").select(
        key, model.alias("model"), (F.floor("o_totalprice") * 2).alias("input_tokens"), F.lit(None).cast("long").alias("output_tokens"), F.lit(True).alias("estimate_output"), F.lit(0.25).alias("output_ratio"), F.pmod(key, F.lit(4)).alias("calls"),
        (F.pmod(key, F.lit(5)) / 4.0).alias("cache_hit_rate"), (F.pmod(key, F.lit(7)) * 100).alias("cache_write_tokens"), F.when(F.pmod(key, F.lit(2)) == 1, "1h").otherwise("5m").alias("cache_ttl"), (F.pmod(key, F.lit(3)) / 2.0).alias("batch_fraction"), F.lit(True).alias("long_context"),
    )
    out = estimate(asks, prices(spark))
    return out.select("o_orderkey", "model", *(F.round(c, 12).alias(c) for c in ("fresh_input", "cached_input", "cache_write", "output", "grand_total")))
