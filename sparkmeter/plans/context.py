"""Queries of tool servers, tool lists, repositories, and checks on generated text, with the SQL that each is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import gates as G
from ..operators import mcp as C
from ..operators import project as P
from ..operators import reports as W
from ..operators import scan as N
from ..sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def text(v: object) -> str:
    return "NULL" if v is None else str(v) if isinstance(v, (int, float)) else "[" + ", ".join(map(text, v)) + "]::VARCHAR[]" if isinstance(v, (list, tuple)) else "'" + str(v).replace("'", "''") + "'"


def values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(map(text, r)) + ")" for r in rows)


CONFIGS = [
    ("a/.mcp.json", '{"mcpServers": {"github": {"command": "npx", "args": ["-y", "@modelcontextprotocol/server-github"], "env": {"TOKEN": "x"}}, "slim": {"command": "github-mcp", "args": ["--toolsets=repos"]}, "db": {"command": "uvx", "args": ["mcp-server-postgres"]}}}'),
    ("b/settings.json", '{"mcp": {"servers": {"supa": {"url": "https://mcp.supabase.com/mcp?features=docs", "type": "http"}, "own": {"command": "./tool"}}}, // note\n}'),
    ("c/settings.json", '{"context_servers": {"notes": {"command": {"path": "notion-mcp", "args": ["run"]}}, "slack": {"command": "slack-mcp", "env": {"SLACK_MCP_ENABLED_TOOLS": "a"}}}}'),
]
#: The servers of each form: form, name, command, args, url, transport, env keys.
PARSED = [
    ("a/.mcp.json", "db", "uvx", ["mcp-server-postgres"], None, "stdio", []),
    ("a/.mcp.json", "github", "npx", ["-y", "@modelcontextprotocol/server-github"], None, "stdio", ["TOKEN"]),
    ("a/.mcp.json", "slim", "github-mcp", ["--toolsets=repos"], None, "stdio", []),
    ("b/settings.json", "own", "./tool", [], None, "stdio", []),
    ("b/settings.json", "supa", None, [], "https://mcp.supabase.com/mcp?features=docs", "http", []),
    ("c/settings.json", "notes", "notion-mcp", ["run"], None, "stdio", []),
    ("c/settings.json", "slack", "slack-mcp", [], None, "stdio", ["SLACK_MCP_ENABLED_TOOLS"]),
]
MEASURED = [("db", 7, 1234)]


def configs(spark: SparkSession, d: str) -> DataFrame:
    """Parts as configuration files of three forms; every seventh is broken."""
    form = lambda k: F.element_at(F.array(*[F.lit(c[k]) for c in CONFIGS]), (F.pmod("p_partkey", F.lit(3)) + 1).cast("int"))
    text_ = F.when(F.pmod("p_partkey", F.lit(7)) == 0, F.concat(F.lit("{"), form(1))).otherwise(form(1))
    return table(spark, d, "part").select(F.concat(F.lit("p"), "p_partkey", F.lit("/"), form(0)).alias("path"), text_.alias("text"))


def reports(spark: SparkSession, d: str) -> DataFrame:
    measured = spark.createDataFrame(MEASURED, "name string, tools long, tokens long")
    return C.server_reports(C.servers(configs(spark, d)), C.catalog(spark), measured)


_FORMS = "[" + ", ".join(text(c[0]) for c in CONFIGS) + "][p_partkey % 3 + 1]"
REPORT = f"""s AS (SELECT 'p' || p_partkey || '/' || path AS path, name, command, args, url, transport, env_keys FROM part JOIN (VALUES {values(PARSED)}) AS v(path, name, command, args, url, transport, env_keys) ON path = {_FORMS} WHERE p_partkey % 7 <> 0),
cat AS (SELECT * FROM (VALUES {values([(n, *r) for n, r in enumerate(C.CATALOG)])}) AS v(place, id, marks, tools, cold, cli, rec, pct, senv, sflags, surl)),
m AS (SELECT * FROM (VALUES {values(MEASURED)}) AS v(name, m_tools, m_tokens)),
hit AS (SELECT s.*, (SELECT min(place) FROM cat WHERE len(list_filter(marks, lambda k: contains(lower(concat_ws(' ', s.name, s.command, array_to_string(s.args, ' '), s.url)), k))) > 0) AS p FROM s),
j AS (SELECT hit.*, id, tools, cold, cli, rec, coalesce(pct, 0) AS pct, m_tools, m_tokens,
  coalesce(id IS NOT NULL AND (list_has_any(senv, env_keys) OR len(list_filter(args, lambda a: list_contains(sflags, a) OR list_contains(sflags, split_part(a, '=', 1)))) > 0 OR coalesce(contains(url, surl), FALSE)), FALSE) AS is_slim
  FROM hit LEFT JOIN cat ON place = p LEFT JOIN m USING (name)),
k AS (SELECT *, CASE WHEN m_tokens IS NOT NULL THEN 'measured' WHEN id IS NOT NULL THEN 'catalog' ELSE 'unknown' END AS basis, CAST(coalesce(m_tokens, CASE WHEN is_slim THEN floor(cold * (100 - pct) / 100) ELSE cold END, 0) AS BIGINT) AS tok, CAST(coalesce(m_tools, tools, 0) AS BIGINT) AS n_tools FROM j),
rep AS (SELECT path, name, id, basis, is_slim, n_tools, CAST(floor(tok * 1.25::DOUBLE + 0.5) AS BIGINT) AS cold_tokens, CAST(floor(tok * (0.3::DOUBLE / 3.0) + 0.5) AS BIGINT) AS warm_tokens, 500 + 600 * least(n_tools, 5) AS search_tokens, tok AS capacity_tokens,
  CASE WHEN rec <> 'Keep' AND cli IS NOT NULL THEN tok ELSE 0 END AS swap_savings, CAST(CASE WHEN id IS NOT NULL AND NOT is_slim THEN floor(tok * pct / 100) ELSE 0 END AS BIGINT) AS slim_savings FROM k)"""


@query("mcp_servers", f"WITH {REPORT} SELECT path, name, command, array_to_string(args, ' ') AS args, url, transport, array_to_string(env_keys, ' ') AS env_keys FROM s")
def mcp_servers(spark, d):
    return C.servers(configs(spark, d)).select("path", "name", "command", F.array_join("args", " ").alias("args"), "url", "transport", F.array_join("env_keys", " ").alias("env_keys"))


@query("mcp_server_report", f"WITH {REPORT} SELECT * FROM rep")
def mcp_server_report(spark, d):
    return reports(spark, d)


_ZERO = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in ("cold_tokens", "warm_tokens", "search_tokens", "capacity_tokens", "swap_savings", "slim_savings"))


@query("mcp_totals", f"WITH {REPORT} SELECT CAST(count(*) AS BIGINT) AS servers, {_ZERO}, CAST(count(*) FILTER (basis = 'catalog') AS BIGINT) AS matched, CAST(count(*) FILTER (basis = 'unknown') AS BIGINT) AS unknown, CAST(count(*) FILTER (basis = 'measured') AS BIGINT) AS measured, floor(sum(capacity_tokens) * 10000::DOUBLE / 200000 + 0.5) / 100 AS window_pct, sum(cold_tokens) / 1e6::DOUBLE * 3.0::DOUBLE AS cold_usd FROM rep")
def mcp_totals(spark, d):
    return C.totals(reports(spark, d))


@query("mcp_inventory_origin", f"WITH {REPORT} SELECT name, CASE WHEN name = 'db' THEN 'explicit' WHEN name = 'own' THEN 'cached' WHEN id IS NOT NULL THEN 'catalog' ELSE 'unknown' END AS origin FROM rep")
def mcp_inventory_origin(spark, d):
    names = lambda *x: spark.createDataFrame([(n,) for n in x], "name string")
    return C.resolved(names("db"), names("own", "db"), reports(spark, d))


@query("mcp_first_definition", "SELECT p_brand AS name, p_name AS command FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS n FROM part) WHERE n = 1")
def mcp_first_definition(spark, d):
    """Parts as servers of their brand's name, sizes and keys as the order of the places that define them."""
    rows = table(spark, d, "part").select(F.col("p_brand").alias("name"), F.col("p_name").alias("command"), F.struct("p_size", "p_partkey").alias("priority"))
    return C.first_defined(rows, "name").select("name", "command")


@query("manifest_staleness", "SELECT 's' || o_orderkey AS server, strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS captured_at, CAST(DATE '1998-08-02' - CAST(o_orderdate AS DATE) AS INTEGER) AS age_days, DATE '1998-08-02' - CAST(o_orderdate AS DATE) > 90 AS is_stale FROM orders")
def manifest_staleness(spark, d):
    rows = table(spark, d, "orders").select(F.concat(F.lit("s"), "o_orderkey").alias("server"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("captured_at"))
    return C.stale(rows, "1998-08-02")


def part_tools(spark: SparkSession, d: str) -> DataFrame:
    """Parts as tools: the brand is the server, names repeat, descriptions vary in length and wording."""
    p = table(spark, d, "part")
    verb = F.element_at(F.array(*map(F.lit, ("Creates", "Fetches", "Red", "Lists"))), (F.pmod("p_partkey", F.lit(4)) + 1).cast("int"))
    text_ = F.when(F.pmod("p_partkey", F.lit(11)) == 0, F.lit("")).otherwise(F.concat(verb, F.lit(" the "), "p_name", F.when(F.pmod("p_partkey", F.lit(3)) == 0, F.lit(" and returns it as JSON")).otherwise(F.lit("")), F.when(F.pmod("p_partkey", F.lit(50)) == 7, F.repeat(F.lit(" long"), 170)).otherwise(F.lit(""))))
    rows = p.select(F.col("p_brand").alias("server"), F.col("p_name").alias("name"), text_.alias("description"))
    return rows.withColumn("serialized", F.concat(F.lit('{"name":"'), "name", F.lit('","description":"'), "description", F.lit('"}')))


TOOLS = """pt AS (SELECT p_partkey, p_brand AS server, p_name AS name, CASE WHEN p_partkey % 11 = 0 THEN '' ELSE ['Creates', 'Fetches', 'Red', 'Lists'][p_partkey % 4 + 1] || ' the ' || p_name || CASE WHEN p_partkey % 3 = 0 THEN ' and returns it as JSON' ELSE '' END || CASE WHEN p_partkey % 50 = 7 THEN repeat(' long', 170) ELSE '' END END AS description FROM part),
tools AS (SELECT *, CAST(ceil(strlen('{"name":"' || name || '","description":"' || description || '"}') / 4) AS BIGINT) AS tokens FROM pt)"""


@query("tool_inventory", f"WITH {TOOLS} SELECT server, name, tokens, floor(tokens * 10000::DOUBLE / sum(tokens) OVER (PARTITION BY server) + 0.5) / 100 AS share_pct FROM tools")
def tool_inventory(spark, d):
    return C.inventory(part_tools(spark, d))


@query("duplicate_tool_names", f"WITH {TOOLS} SELECT server, name, CAST(count(*) AS BIGINT) AS n FROM tools GROUP BY ALL HAVING count(*) > 1")
def duplicate_tool_names(spark, d):
    return C.duplicate_names(part_tools(spark, d))


_VERB = f"list_contains({text(sorted(C.VERBS))}, %s)"
_WORD = "lower(regexp_extract(description, '([A-Za-z]+)', 1))"
_IS_VERB = " OR ".join(_VERB % x for x in (_WORD, f"regexp_replace({_WORD}, 's$', '')", f"regexp_replace({_WORD}, 'es$', '')"))
_SHAPE = f"len(list_filter({text(list(C.SHAPES))}, lambda m: contains(lower(description), m))) > 0"


@query(
    "tool_lints",
    f"WITH {TOOLS} SELECT server, name, 'missing-description' AS rule FROM tools WHERE description = '' UNION ALL SELECT server, name, 'no-leading-purpose-verb' FROM tools WHERE description <> '' AND NOT ({_IS_VERB}) UNION ALL SELECT server, name, 'no-output-shape' FROM tools WHERE description <> '' AND NOT {_SHAPE} UNION ALL SELECT server, name, 'over-long-description' FROM tools WHERE ceil(strlen(description) / 4) > 200",
)
def tool_lints(spark, d):
    return C.lints(part_tools(spark, d))


@query("tool_near_duplicates")
def tool_near_duplicates(spark, d):
    return C.near_duplicate_descriptions(part_tools(spark, d)).select("server", "first", F.array_join("members", ",").alias("members"))


@query(
    "tool_manifests",
    """SELECT 's' || p_partkey AS server, name, description, serialized FROM (SELECT p_partkey, unnest(CASE p_partkey % 5
    WHEN 0 THEN [{'name': p_name, 'description': 'List ' || p_type, 'serialized': '{"name":"' || p_name || '","description":"List ' || p_type || '","input_schema":{"a":' || p_size || ',"type":"object"}}'}, {'name': 'helper', 'description': '', 'serialized': '{"name":"helper","description":""}'}]
    WHEN 1 THEN [{'name': p_name, 'description': 'Get it', 'serialized': '{"name":"' || p_name || '","description":"Get it"}'}] WHEN 2 THEN [{'name': 'run', 'description': p_type, 'serialized': '{"name":"run","description":"' || p_type || '"}'}] ELSE [] END, recursive := true) FROM part)""",
)
def tool_manifests(spark, d):
    """Parts as tool lists in three envelopes, as a configuration, and broken."""
    k, q = F.pmod("p_partkey", F.lit(5)), F.concat
    one = q(F.lit('{"tools": [{"name": "'), "p_name", F.lit('", "description": "List '), "p_type", F.lit('", "inputSchema": {"type": "object", "a": '), F.col("p_size").cast("string"), F.lit('}}, {"name": "helper"}]}'))
    two = q(F.lit('[{"description": "Get it", "name": "'), "p_name", F.lit('"}]'))
    three = q(F.lit('{"result": {"tools": [{"name": "run", "description": "'), "p_type", F.lit('"}]}}'))
    text_ = F.when(k == 0, one).when(k == 1, two).when(k == 2, three).when(k == 3, '{"mcpServers": {}, "tools": [{"name": "no"}]}').otherwise("not json")
    return C.tools(table(spark, d, "part").select(q(F.lit("s"), "p_partkey").alias("server"), text_.alias("text")))


#: What stands before and after a document's id in its path; skills begin with front matter.
PATHS = (
    ("d", "/CLAUDE.md"),
    ("README", ".md"),
    ("pkg", "/.claude/skills/x/SKILL.md"),
    ("pkg", "/.claude/skills/x/run.py"),
    (".cursor/rules/a", ".mdc"),
    (".claude/commands/do", ".md"),
    ("docs/guide", ".md"),
    ("prompts/p", ".md"),
    ("src/m", ".rs"),
    ("d", "/.mcp.json"),
    ("d", "/.github/copilot-instructions.md"),
    (".codex/prompts/z", ".md"),
)


def files(spark: SparkSession, d: str) -> DataFrame:
    """Documents as a repository's files (path, text)."""
    part = lambda k: F.element_at(F.array(*[F.lit(p[k]) for p in PATHS]), (F.pmod("doc_id", F.lit(len(PATHS))) + 1).cast("int"))
    matter = F.concat(F.lit("---\nname: s"), "doc_id", F.lit('\ndescription: "does '), "lang", F.lit('"\n---\n'))
    text_ = F.concat(F.when(F.pmod("doc_id", F.lit(len(PATHS))) == 2, matter).otherwise(""), "text")
    return table(spark, d, "documents").select(F.concat(part(0), "doc_id", part(1)).alias("path"), text_.alias("text"))


_KINDS = " ".join(f"WHEN regexp_matches(path, {text(p)}) THEN {{'class': '{k}', 'profile': '{f}'}}" for p, k, f in P.CLASSES)
_AROUND = [", ".join(text(p[k]) for p in PATHS) for k in (0, 1)]
ENTRIES = f"""f AS (SELECT [{_AROUND[0]}][doc_id % {len(PATHS)} + 1] || doc_id || [{_AROUND[1]}][doc_id % {len(PATHS)} + 1] AS path, CASE WHEN doc_id % {len(PATHS)} = 2 THEN '---' || chr(10) || 'name: s' || doc_id || chr(10) || 'description: "does ' || lang || '"' || chr(10) || '---' || chr(10) ELSE '' END || text AS text FROM documents), k AS (SELECT *, CASE {_KINDS} END AS k FROM f),
e AS (SELECT path, k.class AS class, 'whole' AS part, k.profile AS profile, text FROM k WHERE k IS NOT NULL AND k.class <> 'skill'
  UNION ALL SELECT path, k.class, 'head', 'always', regexp_extract(text, '(?s)^---\\r?\\n(.*?)\\r?\\n---[ \\t]*(?:\\r?\\n|$)', 1) FROM k WHERE k.class = 'skill'
  UNION ALL SELECT path, k.class, 'body', 'on_invocation', regexp_replace(text, '(?s)^---\\r?\\n.*?\\r?\\n---[ \\t]*(?:\\r?\\n|$)', '') FROM k WHERE k.class = 'skill'),
entries AS (SELECT *, CAST(ceil(strlen(text) / 4) AS BIGINT) AS tokens FROM e)"""


@query("path_classifier", f"WITH {ENTRIES} SELECT path, k.class AS class, k.profile AS profile FROM k")
def path_classifier(spark, d):
    return files(spark, d).select("path", P.classified(F.col("path")).alias("k")).select("path", "k.*")


@query("project_entries", f"WITH {ENTRIES} SELECT * FROM entries")
def project_entries(spark, d):
    return P.entries(files(spark, d)).select("path", "class", "part", "profile", "text", "tokens")


@query("skill_front_matter", "SELECT 'pkg' || doc_id || '/.claude/skills/x/SKILL.md' AS path, 's' || doc_id AS name, 'does ' || lang AS description FROM documents WHERE doc_id % 12 = 2")
def skill_front_matter(spark, d):
    head, _ = P.front_matter(F.col("text"))
    return files(spark, d).where(F.col("path").endswith("SKILL.md")).select("path", P.front_field(head, "name").alias("name"), P.front_field(head, "description").alias("description"))


@query("project_profiles", f"WITH {ENTRIES} SELECT profile, CAST(count(DISTINCT path) AS BIGINT) AS files, CAST(sum(tokens) + CASE WHEN profile = 'always' THEN 700 ELSE 0 END AS BIGINT) AS tokens FROM entries WHERE profile <> 'mcp' GROUP BY profile")
def project_profiles(spark, d):
    return P.profiles(P.entries(files(spark, d)), 700)


@query("heaviest_files", f"WITH {ENTRIES} SELECT path, CAST(sum(tokens) AS BIGINT) AS tokens FROM entries WHERE profile <> 'mcp' GROUP BY path ORDER BY 2 DESC, 1 LIMIT 5")
def heaviest_files(spark, d):
    return P.heaviest(P.entries(files(spark, d)), 5)


@query("project_findings")
def project_findings(spark, d):
    return P.file_findings(P.entries(files(spark, d)))


@query(
    "delta_report",
    f"""WITH {ENTRIES}, base AS (SELECT * FROM (VALUES ('always_tokens', 100), ('context_tokens', 0), ('files', 9)) AS v(metric, base)),
    head AS (SELECT 'always_tokens' AS metric, CAST(coalesce(sum(tokens) FILTER (profile = 'always'), 0) AS BIGINT) AS head FROM entries WHERE profile <> 'mcp' UNION ALL SELECT 'context_tokens', CAST(sum(tokens) AS BIGINT) FROM entries WHERE profile <> 'mcp' UNION ALL SELECT 'files', CAST(count(DISTINCT path) AS BIGINT) FROM entries WHERE profile <> 'mcp'),
    x AS (SELECT metric, CAST(coalesce(base, 0) AS BIGINT) AS base, coalesce(head, 0) AS head FROM base FULL JOIN head USING (metric))
    SELECT metric, base, head, head - base AS delta, CASE WHEN base <> 0 THEN floor((head - base) * 1000::DOUBLE / base + 0.5) / 10 END AS pct, coalesce((metric = 'always_tokens' AND head - base > 50) OR (metric = 'context_tokens' AND base <> 0 AND floor((head - base) * 1000::DOUBLE / base + 0.5) / 10 > 10), FALSE) AS fails FROM x""",
)
def delta_report(spark, d):
    base = spark.createDataFrame([("always_tokens", 100), ("context_tokens", 0), ("files", 9)], "metric string, value long")
    return P.delta(base, P.metrics(P.entries(files(spark, d))), 50, 10.0)


_NUMBERS = """SELECT o_orderkey AS id, 'Spent ' || format('{:,}', CAST(floor(o_totalprice) AS BIGINT)) || ' tokens over ' || o_custkey % 40 || ' days, 100% of 0' || o_orderkey % 20 || ' and ' || o_custkey AS output, '{"tokens": ' || CAST(floor(o_totalprice) AS BIGINT) || ', "n": ' || CASE WHEN o_orderkey % 2 = 0 THEN o_custkey ELSE 12 END || '}' AS source FROM orders"""


@query(
    "number_gate",
    f"WITH v AS ({_NUMBERS}), r AS (SELECT id, list_distinct(regexp_extract_all(regexp_replace(regexp_replace(output, '([0-9]),([0-9])', '\\1\\2', 'g'), '([0-9]),([0-9])', '\\1\\2', 'g'), '[0-9]+')) AS o, regexp_extract_all(regexp_replace(source, '([0-9]),([0-9])', '\\1\\2', 'g'), '[0-9]+') AS s FROM v) SELECT CAST(id AS BIGINT) AS id, array_to_string(list_sort(list_filter(o, lambda x: NOT list_contains(s, x) AND CAST(x AS BIGINT) > 10 AND x <> '100')), ',') AS violations FROM r",
)
def number_gate(spark, d):
    """Orders as told numbers and their sources."""
    price, cust = F.floor("o_totalprice").cast("long"), F.col("o_custkey")
    output = F.concat(F.lit("Spent "), W.commas(price), F.lit(" tokens over "), F.pmod(cust, F.lit(40)), F.lit(" days, 100% of 0"), F.pmod("o_orderkey", F.lit(20)), F.lit(" and "), cust)
    source = F.concat(F.lit('{"tokens": '), price, F.lit(', "n": '), F.when(F.pmod("o_orderkey", F.lit(2)) == 0, cust).otherwise(F.lit(12)), F.lit("}"))
    rows = table(spark, d, "orders").select(F.col("o_orderkey").cast("long").alias("id"), output.alias("output"), source.alias("source"))
    return rows.select("id", F.array_join(F.array_sort(G.number_violations(F.col("output"), F.col("source"))), ",").alias("violations"))


@query("grounding_gate", f"WITH {TOOLS}, f AS (SELECT DISTINCT server, name AS tool, CASE WHEN p_partkey % 2 = 0 THEN 'the ' || name ELSE 'missing' END AS quote FROM pt) SELECT server, tool, quote FROM f WHERE EXISTS (SELECT 1 FROM tools t WHERE t.server = f.server AND t.name = f.tool AND contains(t.description, f.quote))")
def grounding_gate(spark, d):
    index = part_tools(spark, d)
    p = table(spark, d, "part")
    found = p.select(F.col("p_brand").alias("server"), F.col("p_name").alias("tool"), F.when(F.pmod("p_partkey", F.lit(2)) == 0, F.concat(F.lit("the "), "p_name")).otherwise("missing").alias("quote")).distinct()
    return G.grounded(found, index)


@query("tool_index_blocks", f"WITH {TOOLS} SELECT server, string_agg(server || ' :: ' || name || ' :: ' || array_to_string(list_slice(regexp_split_to_array(trim(description), '\\s+'), 1, 25), ' '), chr(10) ORDER BY name, server || ' :: ' || name || ' :: ' || array_to_string(list_slice(regexp_split_to_array(trim(description), '\\s+'), 1, 25), ' ')) AS block FROM tools GROUP BY server")
def tool_index_blocks(spark, d):
    return G.index_lines(part_tools(spark, d)).select("server", "block")


@query("tool_index_packed")
def tool_index_packed(spark, d):
    return G.packed_index(G.index_lines(part_tools(spark, d)), 4000)


@query("eta_by_customer", "SELECT c_custkey, CAST(ceil(c_custkey * 10 / CASE c_custkey % 3 WHEN 0 THEN 420.0::DOUBLE WHEN 1 THEN 190.0::DOUBLE ELSE 85.0::DOUBLE END + 256 / CASE c_custkey % 3 WHEN 0 THEN 35.0::DOUBLE WHEN 1 THEN 22.0::DOUBLE ELSE 12.0::DOUBLE END) AS BIGINT) AS seconds, CASE WHEN c_custkey % 64 >= 48 THEN '32b' WHEN c_custkey % 64 >= 32 THEN '14b' WHEN c_custkey % 64 >= 16 THEN '8b' WHEN c_custkey % 64 >= 8 THEN '4b' ELSE 'none' END AS model FROM customer")
def eta_by_customer(spark, d):
    chip = F.element_at(F.array(F.lit("Apple M4 Max"), F.lit("Apple M3 Pro"), F.lit("Other")), (F.pmod("c_custkey", F.lit(3)) + 1).cast("int"))
    return table(spark, d, "customer").select("c_custkey", G.eta_seconds(chip, F.col("c_custkey") * 10, F.lit(256)).alias("seconds"), G.model_for(F.pmod("c_custkey", F.lit(64))).alias("model"))


@query("skills_plan", f"WITH {ENTRIES}, p AS (SELECT DISTINCT path FROM f WHERE path LIKE '%SKILL.md') SELECT CAST(row_number() OVER (ORDER BY path) AS INTEGER) AS place, path, greatest(0, (SELECT count(*) FROM p) - 20) AS capped FROM p ORDER BY path LIMIT 20")
def skills_plan(spark, d):
    return G.skills_plan(files(spark, d).unionByName(files(spark, d)), 20)


@query(
    "answers_match",
    "SELECT CAST(p_partkey AS BIGINT) AS id, p_partkey % 4 <> 3 AS ok FROM part",
)
def answers_match(spark, d):
    """Parts as answers: spaced and in capitals, inside a sentence, the second of two, and another one's."""
    k, name = F.pmod("p_partkey", F.lit(4)), F.col("p_name")
    given = F.when(k == 0, F.concat(F.lit("  "), F.upper(F.replace(name, F.lit(" "), F.lit("   "))))).when(k == 1, F.concat(F.lit("It is "), name, F.lit(" indeed"))).when(k == 2, name).otherwise("none of them")
    rows = table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("id"), given.alias("given"), F.array(F.when(k == 2, "zzz").otherwise(name), name).alias("accepted"))
    return rows.select("id", G.answers_match(F.col("given"), F.col("accepted")).alias("ok"))


MACHINE = [
    ("/home/u/.claude.json", '{"mcpServers": {"gh": {"command": "github-mcp"}}, "projects": {"/w": {"mcpServers": {"gh": {"command": "other"}, "fs": {"command": "filesystem-mcp"}}}}}'),
    ("/home/u/.codex/config.toml", '[mcp_servers.db]\ncommand = "postgres-mcp"\n'), ("/w/.cursor/mcp.json", "{bad"), ("/w/CLAUDE.md", "x" * 41), ("/w/.cursor/rules/a.mdc", "rule"), ("/w/src/a.py", "pass"),
    ("/home/u/.zshrc", 'export TOKEN="' + "0123456789abcdef" * 2 + '01234567"\n'), ("/w/.claude/settings.json", '{"hooks": {"Stop": []}}'), ("/w/.github/workflows/ci.yml", "steps:\n  - uses: anthropics/claude-code-action@v1\n    with:\n      prompt: Review it\n"),
]


def machine(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return spark.createDataFrame(MACHINE, "path string, text string"), N.locations(spark, "/home/u", "/home/u/.config", "/w", "linux")


@query(
    "scan_report",
    """SELECT kind, path, name, CAST(amount AS BIGINT) AS amount FROM (VALUES ('server', '/home/u/.claude.json', 'gh', 50000), ('server', '/home/u/.claude.json', 'fs', 2500), ('server', '/home/u/.codex/config.toml', 'db', 7500), ('instructions', '/w/CLAUDE.md', '', 11),
    ('instructions', '/w/.cursor/rules/a.mdc', '', 1), ('shell', '/home/u/.zshrc', 'high-entropy', 1), ('hooks', '/w/.claude/settings.json', 'Stop', 1), ('workflow', '/w/.github/workflows/ci.yml', 'prompt', 3)) AS v(kind, path, name, amount)""",
)
def scan_report(spark, d):
    return N.report(*machine(spark))


@query("scan_locations", f"SELECT DISTINCT replace(replace(replace(base, 'home', '/home/u'), 'config', '/home/u/.config'), 'cwd', '/w') || '/' || rel AS path FROM (VALUES {values([x for x in N.LOCATIONS if x[3] is None or 'linux' in x[3]])}) AS v(client, base, rel, system)")
def scan_locations(spark, d):
    return machine(spark)[1].select("path")


@query("swap_info", "SELECT * FROM (VALUES ('gh', 'github', 'gh', 40000::BIGINT, TRUE), ('fs', 'filesystem', 'bash + find/cat/rg', 2000, TRUE), ('db', 'postgres', 'psql', 6000, FALSE)) AS v(name, id, cli, swap_savings, installed)")
def swap_info(spark, d):
    files_, known = machine(spark)
    found = C.server_reports(C.servers(N.configurations(files_, known)), C.catalog(spark))
    return N.swaps(found, spark.createDataFrame([("gh",), ("rg",)], "name string"))


@query(
    "display_numbers",
    """SELECT o_orderkey, format('{:,}', n) AS grouped, CASE WHEN n < 1000 THEN CAST(n AS VARCHAR) WHEN n < 1000000 THEN CASE WHEN n / 1e3 >= 100 THEN printf('%.0fk', n / 1e3::DOUBLE) ELSE printf('%.1fk', n / 1e3::DOUBLE) END WHEN n / 1e6 >= 100 THEN printf('%.0fM', n / 1e6::DOUBLE) ELSE printf('%.1fM', n / 1e6::DOUBLE) END AS short,
    CASE WHEN s < 60 THEN 'now' WHEN s < 3600 THEN (s // 60) || 'm' WHEN s < 86400 THEN (s // 3600) || 'h' WHEN s < 86400000 THEN (s // 86400) || 'd' ELSE '999d+' END AS age FROM (SELECT *, CAST(floor(o_totalprice) AS BIGINT) * 4 + 1 AS n, CAST(o_custkey AS BIGINT) * 1700 AS s FROM orders)""",
)
def display_numbers(spark, d):
    n = (F.floor("o_totalprice") * 4 + 1).cast("long")
    rows = table(spark, d, "orders").withColumn("n", n)
    return rows.select("o_orderkey", W.commas(F.col("n")).alias("grouped"), W.humanized(F.col("n")).alias("short"), W.age(F.col("o_custkey").cast("long") * 1700, F.lit(0)).alias("age"))
