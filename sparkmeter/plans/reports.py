"""Queries of ordered findings, notes, skeletons, snapshots and conversions, with the SQL that each is compared with."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import markup as M
from ..functions.models import prices
from ..operators import audit as A
from ..operators import mcp as C
from ..operators import project as P
from ..operators import reports as R
from ..operators import tiers as T
from ..operators import usage as U
from ..sources import tables as S
from . import context, text, usage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str, *more: str) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[name] = f
        SQL[name] = (f"WITH {', '.join(more)} " if more else "") + sql
        return f

    return add


# Audit --------------------------------------------------------------------------------------------------------------

_FOUND = [text.BASE, *text._ALL, f"found AS (SELECT * FROM {text._UNION})"]
_MADE = "list_position([" + ", ".join(f"'{r}'" for r in A.EMITTED) + "], rule)"


@query("audit_findings_ordered", f"SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, savings_max DESC, {_MADE}, byte_start, byte_end) AS INTEGER) AS place FROM found", *_FOUND)
def audit_findings_ordered(spark, d):
    return A.ordered(text._whole_text_findings(spark, d))


_TRIED = ", ".join(f"'{r}'" for r in A.EXPERIMENTAL)


@query("audit_notes", f"SELECT doc_id, 'estimates' || CASE WHEN supplied THEN '' ELSE ',bytes-per-token' END || CASE WHEN doc_id IN (SELECT doc_id FROM found WHERE rule IN ({_TRIED})) THEN ',experimental' ELSE '' END AS notes FROM t", *_FOUND)
def audit_notes(spark, d):
    return A.notes(A.prepared(text.texts(spark, d)), text._whole_text_findings(spark, d)).select("doc_id", F.array_join("notes", ",").alias("notes"))


_ROLLED = "rolled AS (SELECT rule, CAST(count(*) AS BIGINT) AS findings, CAST(sum(savings_min) AS BIGINT) AS savings_min, CAST(sum(savings_max) AS BIGINT) AS savings_max FROM found GROUP BY rule), rules AS (SELECT *, CAST(row_number() OVER (ORDER BY savings_max DESC, rule) AS INTEGER) AS place FROM rolled)"


@query("audit_rules_ranked", "SELECT * FROM rules", *_FOUND, _ROLLED)
def audit_rules_ranked(spark, d):
    return A.ranked_rules(text._whole_text_findings(spark, d))


@query("audit_severity_floor", "SELECT doc_id, CAST(count(*) AS BIGINT) AS findings, CAST(sum(savings_max) AS BIGINT) AS savings_max FROM found WHERE severity IN ('high', 'medium') AND rule <> 'html-content' GROUP BY doc_id", *_FOUND)
def audit_severity_floor(spark, d):
    """Findings of medium severity and above, of one rule or another, and the totals of what is left."""
    found = text._whole_text_findings(spark, d).where((A.rank(F.col("severity")) <= A.RANK["medium"]) & (F.col("rule") != "html-content"))
    return A.report(found).select("doc_id", "findings", "savings_max")


# Projects -----------------------------------------------------------------------------------------------------------


@query("heavy_rows", "SELECT path, tokens, tokens / (SELECT sum(tokens) FROM entries WHERE profile = 'always') * 100 AS pct_always FROM (SELECT path, CAST(sum(tokens) AS BIGINT) AS tokens FROM entries WHERE profile <> 'mcp' GROUP BY path)", context.ENTRIES)
def heavy_rows(spark, d):
    return P.heavy_rows(P.entries(context.files(spark, d)))


POINTER = "full detail: project and scan reports"
_SKELETON = f"""skel AS (SELECT '{{"totals":{{"files_scanned":' || (SELECT count(*) FROM f) || ',"context_files":' || (SELECT count(DISTINCT path) FROM entries WHERE profile <> 'mcp') || ',"context_tokens":' || (SELECT sum(tokens) FROM entries WHERE profile <> 'mcp')
  || '}},"heaviest":[' || (SELECT string_agg('{{"path":"' || path || '","tokens":' || tokens || '}}', ',' ORDER BY tokens DESC, path) FROM (SELECT path, CAST(sum(tokens) AS BIGINT) AS tokens FROM entries WHERE profile <> 'mcp' GROUP BY path ORDER BY 2 DESC, 1 LIMIT 5))
  || '],"findings_by_rule":[' || (SELECT string_agg('{{"rule":"' || rule || '","count":' || findings || '}}', ',' ORDER BY place) FROM rules) || '],"mcp_servers":7,"pointer":"{POINTER}"}}' AS json)"""


def skeletons(spark: SparkSession, d: str) -> DataFrame:
    files = context.files(spark, d)
    return P.skeleton(files, P.entries(files), A.ranked_rules(text._whole_text_findings(spark, d)), 7, POINTER)


@query("project_skeleton", "SELECT json FROM skel", *_FOUND, _ROLLED, context.ENTRIES, _SKELETON)
def project_skeleton(spark, d):
    return skeletons(spark, d)


SYSTEM = "Explain the summary in plain words. Use only numbers of the input."


@query("narrate_plan", f"SELECT 'Input JSON:' || chr(10) || json || chr(10) || chr(10) || 'Explain this summary now.' AS user, CAST({len(SYSTEM.encode()) // 4} + strlen('Input JSON:' || chr(10) || json || chr(10) || chr(10) || 'Explain this summary now.') // 4 AS BIGINT) AS prompt_tokens FROM skel", *_FOUND, _ROLLED, context.ENTRIES, _SKELETON)
def narrate_plan(spark, d):
    return P.narrate_plan(skeletons(spark, d), SYSTEM)


# Usage --------------------------------------------------------------------------------------------------------------

_MACHINE = "machine AS (SELECT project_key, price AS weight, ts AS as_of, coalesce((SELECT CAST(count(*) AS BIGINT) FROM sess s WHERE s.project_key = l.project_key), 0) AS sessions FROM (SELECT *, row_number() OVER (PARTITION BY project_key ORDER BY ts DESC, line_no DESC) AS z FROM ledger WHERE k = 0) l WHERE z = 1)"
_RANKED = " UNION ALL ".join(f"(SELECT '{by}' AS sorted_by, CAST(row_number() OVER (ORDER BY {column} DESC, project_key) AS INTEGER) AS place, * FROM machine ORDER BY {column} DESC, project_key LIMIT 4)" for by, column in (("weight", "weight"), ("sessions", "sessions"), ("recency", "as_of")))


@query("machine_projects_ranked", _RANKED, S.SQL.strip(), _MACHINE)
def machine_projects_ranked(spark, d):
    rows = T.machine_projects(S.ledger(spark, d), U.sessions(S.requests(spark, d)))
    one, two, three = (T.ranked_projects(rows, by, 4).select(F.lit(by).alias("sorted_by"), "*") for by in ("weight", "sessions", "recency"))
    return one.unionByName(two).unionByName(three)


_IDENTIFIED = """lat AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_key, command ORDER BY ts DESC, line_no DESC) AS n FROM ledger) WHERE n = 1),
per AS (SELECT project_key, max(price) FILTER (k = 0) AS p FROM lat GROUP BY project_key)"""


@query(
    "stats_snapshot",
    """SELECT (SELECT CAST(count(*) AS BIGINT) FROM sess) AS sessions, (SELECT CAST(count(*) AS BIGINT) FROM sess WHERE is_subagent) AS subagent_streams, (SELECT CAST(count(*) AS BIGINT) FROM ledger) AS ledger_records, CAST(sum(requests) AS BIGINT) AS requests, CAST(sum(input) AS BIGINT) AS input, CAST(sum(output) AS BIGINT) AS output,
    CAST(sum(cache_read) AS BIGINT) AS cache_read, CAST(sum(w5) AS BIGINT) AS w5, CAST(sum(w1) AS BIGINT) AS w1, round(sum(cost), 9) AS cost_usd, round(sum(cache_read) / sum(input + cache_read + w5 + w1), 9) AS hit_rate, round(sum(output * out_rate / 1e6) / sum(cost), 9) AS output_share,
    (SELECT CAST(sum(p // 10) AS BIGINT) FROM per) AS project_min, (SELECT CAST(sum(p // 5) AS BIGINT) FROM per) AS project_max FROM pc""",
    S.SQL.strip(),
    usage.PRICES,
    usage.MODEL,
    _IDENTIFIED,
)
def stats_snapshot(spark, d):
    return R.snapshot(S.requests(spark, d), S.ledger(spark, d), prices(spark))


@query(
    "stats_json",
    """SELECT '{"scope":"global","ledger":{"records":' || (SELECT count(*) FROM ledger) || '},"ingestion":{"sessions_scanned":' || (SELECT count(*) FROM sess) || ',"parent_sessions":' || (SELECT count(*) FROM sess WHERE NOT is_subagent) || ',"subagent_streams":' || (SELECT count(*) FROM sess WHERE is_subagent)
    || '},"tiers":{"identified":{"project_min":' || (SELECT sum(p // 10) FROM per) || ',"project_max":' || (SELECT sum(p // 5) FROM per) || '},"measured":{"requests":' || CAST(sum(requests) AS BIGINT) || ',"input":' || CAST(sum(input) AS BIGINT) || ',"output":' || CAST(sum(output) AS BIGINT) || ',"cache":{"cache_read":' || CAST(sum(cache_read) AS BIGINT)
    || ',"w5":' || CAST(sum(w5) AS BIGINT) || ',"w1":' || CAST(sum(w1) AS BIGINT) || '}}}}' AS json FROM pc""",
    S.SQL.strip(),
    usage.PRICES,
    usage.MODEL,
    _IDENTIFIED,
)
def stats_json(spark, d):
    return R.stats_json(R.snapshot(S.requests(spark, d), S.ledger(spark, d), prices(spark)))


# Tool lists and conversions --------------------------------------------------------------------------------------------


@query(
    "manifest_files",
    """SELECT regexp_replace(lower(server), '[^a-z0-9]+', '-', 'g') || '.json' AS file, '{' || chr(10) || '  "server": "' || server || '",' || chr(10) || '  "captured_at": "2026-06-01",' || chr(10) || '  "tools": [' || chr(10)
    || string_agg('    {' || chr(10) || '      "name": "' || name || '",' || chr(10) || '      "description": "' || description || '"' || chr(10) || '    }', ',' || chr(10) ORDER BY name, description) || chr(10) || '  ]' || chr(10) || '}' AS body
    FROM (SELECT p_brand AS server, p_name AS name, CASE WHEN p_partkey % 9 = 0 THEN 'uses <REDACTED:github-token>' ELSE 'about ' || p_type END AS description FROM part) GROUP BY server""",
)
def manifest_files(spark, d):
    """Parts as tools of their brand's server; every ninth has a token in its description, which is not kept."""
    secret = "uses ghp_" + "0a1B2c3D4e5F6g7H8i9J0k1L2m3N4o5P6q7R"
    about = F.when(F.pmod("p_partkey", F.lit(9)) == 0, secret).otherwise(F.concat(F.lit("about "), "p_type"))
    return C.saved(S.table(spark, d, "part").select(F.col("p_brand").alias("server"), F.col("p_name").alias("name"), about.alias("description")), "2026-06-01")


@query("manifest_names", "SELECT p_partkey, trim(regexp_replace(lower(p_brand || ' / ' || p_name || '!'), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part")
def manifest_names(spark, d):
    return S.table(spark, d, "part").select("p_partkey", C.slug(F.concat("p_brand", F.lit(" / "), "p_name", F.lit("!"))).alias("slug"))


def _mapped(rows: DataFrame, key: str, change: Callable[[str], str | None], out: str) -> DataFrame:
    """(key, out) of rows (key, text)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([change(t) if t is not None else None for t in batch.column(1).to_pylist()], pa.string())], names=[key, out])

    return rows.select(key, "text").mapInArrow(work, f"{key} long, {out} string")


@query("json_minified", """SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN '{"a":{"k":[1,' || o_custkey || ']},"status":"' || o_orderstatus || '","z":' || o_orderkey || '}' END AS minified FROM orders""")
def json_minified(spark, d):
    """Orders as spaced JSON with keys out of order; every seventh is broken."""
    body = F.concat(F.lit('{ "z" : '), "o_orderkey", F.lit(',\n  "status": "'), "o_orderstatus", F.lit('", "a":\t{"k": [1, '), "o_custkey", F.when(F.pmod("o_orderkey", F.lit(7)) == 0, F.lit("] ")).otherwise(F.lit("]} }")))
    return _mapped(S.table(spark, d, "orders").select("o_orderkey", body.alias("text")), "o_orderkey", M.minified, "minified")


@query(
    "json_tables",
    """SELECT c_custkey, CASE WHEN c_custkey % 6 NOT IN (0, 5) THEN 'items[' || (c_custkey % 6 + 2) || ']{id,name}:' || chr(10) || (SELECT string_agg('  ' || (c_custkey + i) || ',' || CASE WHEN i = 2 THEN '"' || c_name || ', jr"' ELSE c_name END || chr(10), '' ORDER BY i) FROM range(1, c_custkey % 6 + 3) AS r(i)) END AS tabular FROM customer""",
)
def json_tables(spark, d):
    """Customers as arrays of flat objects; too few rows, or one that is not flat, make no table."""
    n = F.pmod("c_custkey", F.lit(6))
    items = F.transform(F.sequence(F.lit(1).cast("long"), n + 2), lambda i: F.concat(F.lit('{"name": "'), "c_name", F.when(i == 2, ", jr").otherwise(""), F.lit('", "id": '), F.col("c_custkey") + i, F.when((n == 5) & (i == 3), ', "x": []').otherwise(""), F.lit("}")))
    rows = S.table(spark, d, "customer").select("c_custkey", F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]")).alias("text"))
    return _mapped(rows, "c_custkey", M.tabular, "tabular")


@query("previews", f"SELECT doc_id, CASE WHEN bytes <= {M.PREVIEW} THEN text ELSE left(text, list_max(list_filter(range({M.PREVIEW // 4}, {M.PREVIEW + 1}), lambda k: strlen(left(text, k)) <= {M.PREVIEW}))) || chr(10) || '... (truncated)' END AS preview, bytes FROM (SELECT doc_id, text, strlen(text) AS bytes FROM documents)")
def previews(spark, d):
    docs = S.table(spark, d, "documents").select("doc_id", "text")
    return _mapped(docs, "doc_id", M.preview, "preview").join(docs.select("doc_id", F.octet_length("text").cast("long").alias("bytes")), "doc_id")


def _dumps(key: Column) -> Column:
    """A log of four dumps, of which the third and fourth may repeat the first's body."""
    head = lambda n: F.lit(f"2024-01-0{n}T00:00:00Z ERROR boom {n}\n")
    body = lambda x: F.concat(F.lit("  at a.b("), x, F.lit(")\n  at c.d(2)"))
    own = key.cast("string")
    return F.concat(F.lit("start\n"), head(1), body(own), F.lit("\n"), head(2), body(F.lit("other")), F.lit("\n"), head(3), F.when(F.pmod(key, F.lit(2)) == 0, body(own)).otherwise(body(F.lit("third"))), F.lit("\n"), head(4), F.when(F.pmod(key, F.lit(3)) == 0, body(own)).otherwise(F.lit("")))


@query(
    "stack_dumps_once",
    """SELECT c_custkey AS doc_id, 'start' || chr(10) || '2024-01-01T00:00:00Z ERROR boom 1' || chr(10) || b || chr(10) || '2024-01-02T00:00:00Z ERROR boom 2' || chr(10) || '  at a.b(other)' || chr(10) || '  at c.d(2)' || chr(10) || '2024-01-03T00:00:00Z ERROR boom 3' || chr(10)
    || CASE WHEN c_custkey % 2 = 0 THEN '[same stack as dump 1]' ELSE '  at a.b(third)' || chr(10) || '  at c.d(2)' END || chr(10) || '2024-01-04T00:00:00Z ERROR boom 4' || chr(10) || CASE WHEN c_custkey % 3 = 0 THEN '[same stack as dump 1]' ELSE '' END AS text FROM (SELECT c_custkey, '  at a.b(' || c_custkey || ')' || chr(10) || '  at c.d(2)' AS b FROM customer)""",
)
def stack_dumps_once(spark, d):
    return M.unique_dumps(S.table(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), _dumps(F.col("c_custkey")).alias("text")))


@query(
    "iso_times",
    "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN NULL ELSE epoch(CAST(o_orderdate AS DATE))::BIGINT + (o_custkey % 24) * 3600 + 59 + CASE WHEN o_orderkey % 5 = 3 THEN 1 ELSE 0 END END AS seconds, CASE WHEN o_orderkey % 5 > 1 THEN strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') END AS day FROM orders",
)
def iso_times(spark, d):
    """Orders' days as times: with an offset, with a missing zone, with a fraction, with a second of sixty."""
    from ..functions.scalars import iso_seconds, utc_day

    k = F.pmod("o_orderkey", F.lit(5))
    time = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T"), F.lpad(F.pmod("o_custkey", F.lit(24)).cast("string"), 2, "0"), F.lit(":00:"), F.when(k == 3, "60").otherwise("59"), F.when(k == 4, ".987654").otherwise(""), F.when(k == 0, "+01:00").when(k == 1, "").otherwise("Z"))
    seconds = iso_seconds(time)
    return S.table(spark, d, "orders").select("o_orderkey", seconds.alias("seconds"), utc_day(seconds).alias("day"))


@query("html_escaped", "SELECT doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(39), '&#39;') AS escaped FROM documents")
def html_escaped(spark, d):
    return S.table(spark, d, "documents").select("doc_id", R.escaped(F.col("text")).alias("escaped"))


