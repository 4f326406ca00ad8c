"""Queries of the text audit, redaction and format conversions, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import markup as M
from ..operators import audit as A
from ..operators import redact as R
from ..sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

ROLE = "You are a helpful assistant. You must answer briefly. Your role is to help. You should always cite. As an expert you know. The end."
TRACE = "boom\n" + "\n".join(f"\tat com.acme.Service.run{n}(Service.java:{n})" for n in range(9)) + "\nafter"
PAGE = "intro <div class=\"x\"><p>" + "".join(f"<li><b>item {n}</b> &amp; more</li>" for n in range(15)) + "</p></div> outro"
#: Texts that the driver's documents have no case of: (doc_id, text, input_tokens).
CASES: tuple[tuple[int, str, int | None], ...] = (
    (-1, ROLE, None),
    (-2, TRACE, None),
    (-3, "Report of 2026-06-10T12:30 for 123e4567-e89b-12d3-a456-426614174000. Rest.", None),
    (-4, "é 1781108711 first, then session_id=0123456789abcdef0123", 500),
    (-5, PAGE, None),
    (-6, "Please note that this is really, very, very simple; just do it in order to win.", 100),
    (-7, "# Title\n## Part\n- one\n- two\n| a | b |\n**bold** [link](http://x.y)\n", None),
    (-8, "você are here. you are é " * 60, None),
    (-9, "middle " * 12, 60_000),
    (-10, "é" * 50, 50_001),
)


def cases_sql() -> str:
    value = lambda v: "NULL::BIGINT" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(value, row)) + ")" for row in CASES)


def texts(spark: SparkSession, d: str) -> DataFrame:
    """All documents and pages' sources as prompts, and the cases; every other document comes with a count of tokens."""
    docs = table(spark, d, "documents").select("doc_id", "text", F.when(F.col("doc_id") % 2 == 0, F.ceil(F.octet_length("text") / 4)).alias("input_tokens"))
    pages = table(spark, d, "pages").select((F.col("page_id") + 1_000_000_000).alias("doc_id"), F.col("html").alias("text"), F.lit(None).cast("long").alias("input_tokens"))
    own = spark.createDataFrame(list(CASES), "doc_id long, text string, input_tokens long")
    return docs.unionByName(pages).unionByName(own)


BASE = f"""base AS (SELECT doc_id, text, CASE WHEN doc_id % 2 = 0 THEN CAST(ceil(strlen(text) / 4) AS BIGINT) END AS input_tokens FROM documents UNION ALL SELECT page_id + 1000000000, html, NULL FROM pages
  UNION ALL SELECT * FROM (VALUES {cases_sql()})),
t AS (SELECT doc_id, text, strlen(text) AS bytes, coalesce(input_tokens, CAST(ceil(strlen(text) / 4) AS BIGINT)) AS total, input_tokens IS NOT NULL AS supplied FROM base WHERE text IS NOT NULL)"""


def lit(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def head(n: int) -> str:
    return f"CASE WHEN bytes <= {n} THEN text ELSE left(text, list_max(list_filter(range({n // 4}, {n + 1}), lambda k: strlen(left(text, k)) <= {n}))) END"


def row(rule: str, severity: str, a: str, b: str, low: str, high: str, confidence: float) -> str:
    whole = lambda x: f"CAST(floor({x}) AS BIGINT)"
    return f"SELECT doc_id, '{rule}' AS rule, {severity} AS severity, {whole(a)} AS byte_start, {whole(b)} AS byte_end, {whole(low)} AS savings_min, {whole(high)} AS savings_max, {confidence}::DOUBLE AS confidence"


def before(text: str, pattern: str) -> str:
    import re

    flags = "".join(sorted(set("".join(re.findall(r"^\(\?([a-z]+)\)", pattern)) + "s")))
    return f"strlen(regexp_extract({text}, {lit(f'(?{flags})^(.*?)(?:' + re.sub(r'^\(\?[a-z]+\)', '', pattern) + ')')}, 1))"


def query(name: str, sql: str | None = None, *more: str) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = f"WITH {', '.join([BASE, *more])} {sql}"
        return f

    return add


FINDINGS: dict[str, tuple[str, ...]] = {}

FINDINGS["html"] = (
    row("html-content", "CASE WHEN ceil(strlen(region) / 4) > 2000 THEN 'high' ELSE 'medium' END", "a", "a + strlen(region)", "CASE WHEN saved > 0 THEN saved * 60 / 100 ELSE ceil(strlen(region) / 4) * 20 / 100 END", "CASE WHEN saved > 0 THEN saved ELSE ceil(strlen(region) / 4) * 90 / 100 END", 0.8)
    + f" FROM (SELECT *, ceil(greatest(0, strlen(region) - strlen({M.html_to_markdown_sql('region')})) / 4) AS saved FROM (SELECT *, {before('text', A.TAG)} AS a, regexp_extract(text, {lit(f'(?s)({A.TAG}.*{A.TAG})')}, 1) AS region FROM t WHERE len(regexp_extract_all(text, {lit(A.TAG)})) > 20 AND len(regexp_extract_all(text, {lit(A.TAG)})) / (bytes / 1024.0::DOUBLE) > 5))",
)
_SPANS = ", ".join(f"CASE WHEN regexp_matches(head, {lit(p)}) THEN {{'a': {before('head', p)}, 'i': {i}, 'n': strlen(regexp_extract(head, {lit(p)}))}} END" for i, p in enumerate(A.VOLATILE))
FINDINGS["volatile"] = (
    row("volatile-prefix", "'medium'", "s.a", "s.a + s.n", "0", "total * 90 / 100", 0.6) + f" FROM (SELECT *, list_min(list_filter([{_SPANS}], lambda x: x IS NOT NULL)) AS s FROM heads) WHERE s IS NOT NULL",
    f"heads AS (SELECT *, {head(1024)} AS head FROM t)",
)
FINDINGS["sub_cache"] = (row("sub-cache-threshold", "'low'", "0", "bytes", "0", "total / 2", 0.5) + f" FROM t WHERE total >= 256 AND total < 1024 AND (supplied OR contains(lower({head(200)}), 'you are'))",)
FINDINGS["filler"] = (row("filler-phrases", "'low'", "a", f"a + strlen(regexp_extract(text, {lit(A.FILLER)}))", "total * 5 / 100", "total * 15 / 100", 0.5) + f" FROM (SELECT *, {before('text', A.FILLER)} AS a FROM t WHERE len(regexp_extract_all(text, {lit(A.FILLER)})) >= 5)",)
FINDINGS["markdown"] = (
    row("markdown-overhead", "'low'", "0", "bytes", "total * 5 / 100", "total * 20 / 100", 0.4)
    + f""" FROM (SELECT *, strlen(array_to_string(regexp_extract_all(text, '(?m)^[^\\S\\n]*(#+)', 1), '')) + len(regexp_extract_all(text, '(?m)^[^\\S\\n]*(#+)')) + 2 * len(regexp_extract_all(text, '(?m)^[^\\S\\n]*[-+] '))
    + strlen(text) - strlen(replace(replace(text, '|', ''), '*', '')) + strlen(array_to_string(regexp_extract_all(text, {lit(A.LINK)}), '')) - strlen(array_to_string(regexp_extract_all(text, {lit(A.LINK)}, 1), '')) AS marks FROM t WHERE NOT contains(text, '```')) WHERE marks * 100 > bytes * 15""",
)
FINDINGS["middle"] = (
    row("lost-in-the-middle", "'low'", "a", "b", "0", "0", 0.4)
    + " FROM (SELECT *, list_max(list_filter(list_transform(range(0, length(text) + 1), lambda k: strlen(left(text, k))), lambda n: n <= bytes * 30 // 100)) AS a, list_max(list_filter(list_transform(range(0, length(text) + 1), lambda k: strlen(left(text, k))), lambda n: n <= bytes * 70 // 100)) AS b FROM t WHERE total > 50000)",
)
FINDINGS["stack"] = (
    row("stack-trace-verbosity", "'high'", "a", "b", "ceil((b - tail) / 4) * 60 / 100", "ceil((b - tail) / 4) * 80 / 100", 0.9)
    + " FROM (SELECT doc_id, count(*) AS n, min(a) AS a, max(a + strlen(line)) AS b, min(a) FILTER (place = 6) AS tail FROM frames GROUP BY doc_id, run) WHERE n >= 6",
    "cut AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM t WHERE regexp_matches(text, ':[0-9]+|line [0-9]+|at '))",
    "lines AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM cut)",
    "offs AS (SELECT doc_id, pos, regexp_replace(line, '\\r+$', '') AS line, coalesce(sum(strlen(line) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM lines)",
    f"runs AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM offs WHERE regexp_matches(line, {lit(A.FRAMES)}))",
    "frames AS (SELECT *, row_number() OVER (PARTITION BY doc_id, run ORDER BY pos) AS place FROM runs)",
)
FINDINGS["role_runs"] = (
    row("verbose-role-description", "'low'", "a", "b", "ceil((b - a) / 4) * 5 / 100", "ceil((b - a) / 4) * 15 / 100", 0.45)
    + " FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, a) AS z FROM (SELECT doc_id, count(*) AS n, min(a) AS a, max(a + strlen(part)) AS b FROM rr GROUP BY doc_id, run)) WHERE z = 1 AND n > 3",
    f"rh AS (SELECT doc_id, regexp_split_to_array({head(2048)}, '[.\\n]') AS l FROM t WHERE len(regexp_extract_all(text, {lit(A.ROLE)})) > 3)",
    "rs AS (SELECT doc_id, unnest(l) AS part, generate_subscripts(l, 1) AS pos FROM rh)",
    "ro AS (SELECT doc_id, pos, regexp_replace(part, '^\\s+|\\s+$', '', 'g') AS part, coalesce(sum(strlen(part) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + strlen(part) - strlen(regexp_replace(part, '^\\s+', '')) AS a FROM rs)",
    "rn AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM ro WHERE part <> '')",
    f"rr AS (SELECT *, k - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM rn WHERE regexp_matches(part, {lit(A.ROLE)}))",
)
RULES = {"html": A.html_content, "volatile": A.volatile_prefix, "sub_cache": A.sub_cache_threshold, "filler": A.filler_phrases, "markdown": A.markdown_overhead, "middle": A.lost_in_the_middle, "stack": A.stack_traces, "role_runs": A.role_description}


def _rule_query(name: str) -> None:
    sql, *more = FINDINGS[name]
    query(f"audit_{name}", sql, *more)(lambda spark, d: RULES[name](A.prepared(texts(spark, d))))


for _name in RULES:
    _rule_query(_name)

_ALL = [more for _, *rest in FINDINGS.values() for more in rest] + [f"f_{name} AS ({sql})" for name, (sql, *_) in FINDINGS.items()]
_UNION = "(" + " UNION ALL ".join(f"SELECT * FROM f_{name}" for name in FINDINGS) + ")"


def _whole_text_findings(spark: SparkSession, d: str) -> DataFrame:
    from functools import reduce

    rows = A.prepared(texts(spark, d))
    return reduce(DataFrame.unionByName, [f(rows) for f in RULES.values()])


@query("audit_report", f"SELECT doc_id, CAST(count(*) AS BIGINT) AS findings, CAST(sum(savings_min) AS BIGINT) AS savings_min, CAST(sum(savings_max) AS BIGINT) AS savings_max, min(CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END) AS worst, bool_or(severity = 'high') AS fails_high FROM {_UNION} GROUP BY doc_id", *_ALL)
def audit_report(spark, d):
    return A.report(_whole_text_findings(spark, d))


@query("audit_rules_rollup", f"SELECT rule, CAST(count(*) AS BIGINT) AS findings, CAST(sum(savings_min) AS BIGINT) AS savings_min, CAST(sum(savings_max) AS BIGINT) AS savings_max FROM {_UNION} GROUP BY rule", *_ALL)
def audit_rules_rollup(spark, d):
    return A.rules_rollup(_whole_text_findings(spark, d))


@query("audit_scanning_rules")
def audit_scanning_rules(spark, d):
    return A.scanning_rules(A.prepared(texts(spark, d)))


@query("redact_findings")
def redact_findings(spark, d):
    return R.findings(texts(spark, d))


@query("redact_summary")
def redact_summary(spark, d):
    return R.summary(texts(spark, d))


@query("redact_hex_tokens", "SELECT doc_id, CAST(len(regexp_extract_all(text, 'token = \"[0-9a-f]{40}\"')) AS BIGINT) AS tokens FROM documents WHERE regexp_matches(text, 'token = \"[0-9a-f]{40}\"')")
def redact_hex_tokens(spark, d):
    """Forty hex digits beside the word token: the generic pattern's redactions in documents."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    found = R.findings(docs.where(F.col("text").rlike('token = "[0-9a-f]{40}"'))).where("redacted and kind = 'high-entropy' and byte_end - byte_start = 40")
    return found.groupBy("doc_id").agg(F.count("*").alias("tokens"))


SQL["redact_hex_tokens"] = SQL["redact_hex_tokens"].replace(f"WITH {BASE} ", "")


@query("html_to_markdown", f"SELECT page_id, {M.html_to_markdown_sql('html')} AS markdown, strlen(html) AS bytes_before, strlen({M.html_to_markdown_sql('html')}) AS bytes_after FROM pages")
def html_to_markdown(spark, d):
    rows = table(spark, d, "pages").select("page_id", "html", M.html_to_markdown(F.col("html")).alias("markdown"))
    return rows.select("page_id", "markdown", F.octet_length("html").cast("long").alias("bytes_before"), F.octet_length("markdown").cast("long").alias("bytes_after"))


@query(
    "paragraph_dedup",
    "SELECT conv_id, array_to_string(list_transform(list_filter(list_transform(range(1, len(p) + 1), lambda i: {'i': i, 'x': p[i]}), lambda s: list_position(p, s.x) = s.i), lambda s: s.x), chr(10) || chr(10)) AS text FROM (SELECT conv_id, regexp_split_to_array(string_agg(text, chr(10) || chr(10) ORDER BY turn), '\\n{2,}') AS p FROM conversations GROUP BY conv_id)",
)
def paragraph_dedup(spark, d):
    """Conversations joined to one text, paragraphs once."""
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("t"))
    whole = F.array_join(F.transform("t", lambda x: x["text"]), "\n\n")
    return turns.select("conv_id", M.unique_paragraphs(whole).alias("text"))


@query("approx_tokens_by_lang", "SELECT lang, CAST(count(*) AS BIGINT) AS docs, CAST(sum(strlen(text)) AS BIGINT) AS bytes, CAST(sum(ceil(strlen(text) / 4)) AS BIGINT) AS tokens FROM documents GROUP BY lang")
def approx_tokens_by_lang(spark, d):
    size = F.octet_length("text")
    return table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("docs"), F.sum(size).alias("bytes"), F.sum(F.ceil(size / 4)).alias("tokens"))


@query("drift_band", "SELECT lang, tokens, round(tokens * 1.0::DOUBLE, 2) AS low, round(tokens * 1.35::DOUBLE, 2) AS high, floor((words - tokens) * 1000::DOUBLE / tokens + 0.5) / 10 AS words_pct FROM (SELECT lang, CAST(sum(ceil(strlen(text) / 4)) AS BIGINT) AS tokens, sum(len(regexp_extract_all(text, '[^ \\t-\\r]+'))) AS words FROM documents GROUP BY lang)")
def drift_band(spark, d):
    """Token estimates of each language against its words: change in per cent, and the band up to 1.35 times."""
    rows = table(spark, d, "documents").groupBy("lang").agg(F.sum(F.ceil(F.octet_length("text") / 4)).alias("tokens"), F.sum(F.regexp_count("text", F.lit(r"[^ \t-\r]+"))).alias("words"))
    pct = F.when(F.col("tokens") == 0, F.lit(None)).otherwise(F.floor((F.col("words") - F.col("tokens")) * F.lit(1000.0) / F.col("tokens") + 0.5) / 10)
    return rows.select("lang", "tokens", F.round(F.col("tokens") * 1.0, 2).alias("low"), F.round(F.col("tokens") * 1.35, 2).alias("high"), pct.alias("words_pct"))
