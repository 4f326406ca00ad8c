"""Tool servers and tool lists: configuration parsing, catalog match, costs in scenarios, inventories and lints."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.markup import without_comments
from ..functions.models import PRICES
from ..functions.scalars import approx_tokens
from .audit import minhash
from .redact import redact

# Known servers; the first row any of whose marks is in a server's text is its entry.
# id, marks, tools, cold tokens, command-line tool, recommendation, slim per cent, slim env keys, slim flags, slim url parameter
CATALOG: tuple[tuple, ...] = (
    ("github", ["server-github", "github-mcp", "mcp-server-github"], 90, 40000, "gh", "Replace", 50, ["GITHUB_TOOLSETS"], ["--toolsets", "--tools"], None),
    ("gitlab", ["server-gitlab", "gitlab-mcp", "mcp-server-gitlab"], 65, 25000, "glab", "Replace", 50, ["GITLAB_READ_ONLY_MODE"], [], None),
    ("git", ["mcp-server-git", "mcp_server_git"], 13, 2500, "git", "Replace", None, [], [], None),
    ("filesystem", ["server-filesystem", "filesystem-mcp"], 11, 2000, "bash + find/cat/rg", "Replace", None, [], [], None),
    ("postgres", ["server-postgres", "postgres-mcp", "mcp-server-postgres"], 20, 6000, "psql", "ReplaceForAdHoc", None, [], [], None),
    ("neon", ["neon"], 20, 6000, "neonctl", "ReplaceForAdHoc", None, [], [], None),
    ("supabase", ["supabase"], 22, 5000, "supabase", "Replace", 70, [], [], "features="),
    ("notion", ["notion"], 21, 26000, None, "Keep", None, [], [], None),
    ("linear", ["linear"], 42, 13000, "linear", "Replace", None, [], [], None),
    ("slack", ["server-slack", "slack-mcp", "slack"], 30, 21000, "slack-cli", "ReplaceForAdHoc", 75, ["SLACK_MCP_ENABLED_TOOLS"], [], None),
    ("jira", ["atlassian", "jira"], 25, 17000, "jira-cli", "Replace", 90, ["ENABLED_TOOLS", "TOOLSETS"], [], None),
    ("aws", ["aws-mcp", "server-aws", "awslabs", "@aws"], 30, 17000, "aws", "Replace", None, [], [], None),
    ("kubernetes", ["kubernetes", "mcp-server-kubernetes", "k8s"], 25, 10000, "kubectl", "Replace", 40, [], ["--toolsets"], None),
    ("xcode", ["xcodebuild", "xcode"], 60, 12600, "xcodebuild / xcrun simctl", "ReplaceForAdHoc", None, [], [], None),
    ("figma", ["figma"], 15, 6000, None, "Keep", None, [], [], None),
    ("sentry", ["sentry"], 16, 9000, "sentry-cli", "ReplaceForAdHoc", 25, ["MCP_DISABLE_SKILLS"], [], None),
    ("brave-search", ["brave-search", "brave"], 2, 1500, None, "Keep", 85, ["BRAVE_MCP_ENABLED_TOOLS"], [], None),
    ("playwright", ["playwright"], 25, 12000, "playwright", "ReplaceForAdHoc", 0, [], [], None),
    ("puppeteer", ["puppeteer"], 7, 4000, None, "Keep", None, [], [], None),
    ("fetch", ["server-fetch"], 1, 800, "curl", "Replace", None, [], [], None),
    ("memory", ["server-memory"], 9, 3000, None, "Keep", None, [], [], None),
    ("gdrive", ["gdrive", "google-drive", "googledrive"], 10, 7000, None, "Keep", None, [], [], None),
)
# Words with which a purpose begins.
VERBS = frozenset(
    (
        "add",
        "aggregate",
        "analyze",
        "append",
        "approve",
        "archive",
        "assign",
        "attach",
        "batch",
        "browse",
        "build",
        "calculate",
        "call",
        "cancel",
        "capture",
        "check",
        "clear",
        "click",
        "clone",
        "close",
        "comment",
        "compare",
        "compute",
        "configure",
        "convert",
        "copy",
        "count",
        "create",
        "delete",
        "deploy",
        "describe",
        "detach",
        "disable",
        "dismiss",
        "download",
        "drop",
        "echo",
        "edit",
        "enable",
        "estimate",
        "execute",
        "extract",
        "fetch",
        "filter",
        "find",
        "follow",
        "fork",
        "format",
        "generate",
        "get",
        "grant",
        "group",
        "insert",
        "install",
        "invoke",
        "kill",
        "label",
        "link",
        "list",
        "load",
        "lock",
        "make",
        "manage",
        "mark",
        "merge",
        "move",
        "navigate",
        "open",
        "parse",
        "pause",
        "ping",
        "play",
        "post",
        "print",
        "publish",
        "pull",
        "push",
        "query",
        "react",
        "read",
        "record",
        "refresh",
        "register",
        "reject",
        "remove",
        "rename",
        "replace",
        "reply",
        "request",
        "reset",
        "resolve",
        "restore",
        "resume",
        "retrieve",
        "return",
        "revoke",
        "run",
        "sample",
        "save",
        "schedule",
        "search",
        "send",
        "set",
        "show",
        "sort",
        "spawn",
        "star",
        "start",
        "stop",
        "stream",
        "submit",
        "summarize",
        "switch",
        "sync",
        "tag",
        "take",
        "test",
        "toggle",
        "translate",
        "trigger",
        "truncate",
        "type",
        "uninstall",
        "unlink",
        "unlock",
        "update",
        "upload",
        "use",
        "validate",
        "verify",
        "view",
        "wait",
        "watch",
        "write",
    )
)
SHAPES = ("return", "respond", "response", "output", "result", "format", "json", "markdown", "yield", "produce", "emit", "list of", "array of", "as text", "as a string", "as html", "gives back")
WINDOW = 200_000
LONG = 200


def catalog(spark: SparkSession) -> DataFrame:
    rows = [(n, *row) for n, row in enumerate(CATALOG)]
    return F.broadcast(spark.createDataFrame(rows, "place int, id string, marks array<string>, tools int, cold long, cli string, recommendation string, slim_pct int, slim_env array<string>, slim_flags array<string>, slim_url string"))


# Configuration ------------------------------------------------------------------------------------------------------


def _servers_of(text: str | None) -> list[dict]:
    """Servers of one configuration file (comments allowed): four places in which clients keep them."""
    try:
        root = json.loads(without_comments(text or ""))
    except ValueError:
        return []
    if not isinstance(root, dict):
        return []
    found = root.get("mcpServers")
    for place in (root.get("mcp", {}).get("servers") if isinstance(root.get("mcp"), dict) else None, root.get("servers"), root.get("context_servers")):
        found = found if isinstance(found, dict) else place
    out = []
    for name, x in sorted(found.items()) if isinstance(found, dict) else ():
        if not isinstance(x, dict):
            continue
        command, args = x.get("command"), x.get("args")
        if isinstance(command, dict):
            command, args = command.get("path"), command.get("args", args)
        url = x.get("url") if isinstance(x.get("url"), str) else None
        env = x.get("env") if isinstance(x.get("env"), dict) else {}
        transport = (x.get("type") if isinstance(x.get("type"), str) else "sse") if url else "stdio"
        out.append({"name": name, "command": command if isinstance(command, str) else None, "args": [a for a in args or [] if isinstance(a, str)] if isinstance(args, list) else [], "url": url, "transport": transport, "env_keys": sorted(env)})
    return out


SERVER = "name string, command string, args array<string>, url string, transport string, env_keys array<string>"


def servers(configs: DataFrame) -> DataFrame:
    """One row a server of each configuration (path, text); values of env are never read."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string(), pa.list_(pa.string())]
        names = ["path", "name", "command", "args", "url", "transport", "env_keys"]
        for batch in batches:
            rows = [{"path": p} | s for p, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for s in _servers_of(t)]
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True)], names=names)

    return configs.select("path", "text").mapInArrow(parse, "path string, " + SERVER)


def first_defined(rows: DataFrame, *keys: str) -> DataFrame:
    """Of servers with one name the one of the smallest priority: top level before projects."""
    order = Window.partitionBy(*keys).orderBy("priority")
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def cache_factors(provider: str) -> tuple[float, float]:
    """(write, read) rates of a provider's default model as shares of its input rate."""
    row = next(r for r in PRICES if r[1] == provider and r[10])
    return (row[5] / row[2] if row[5] else 1.0), (row[4] / row[2] if row[4] else 1.0)


def server_reports(rows: DataFrame, known: DataFrame, measured: DataFrame | None = None, provider: str = "anthropic") -> DataFrame:
    """Each server with its entry, tokens, savings and scenarios.

    measured: (name, tools, tokens) of inventories that were read; they go before the catalog's figures and are never
    scaled down. The catalog is small and fixed, so each server looks through it as a broadcast.
    """
    text = F.lower(F.concat_ws(" ", "name", "command", F.concat_ws(" ", "args"), "url"))
    marked = rows.withColumn("_text", text)
    c = known.alias("c")
    hits = marked.join(c, F.exists("c.marks", lambda m: F.instr(F.col("_text"), m) > 0), "left")
    keys = [k for k in ("path", "name") if k in rows.columns]
    first = hits.groupBy(*keys).agg(F.min_by(F.struct("command", "args", "url", "transport", "env_keys", "place", "id", "tools", "cold", "cli", "recommendation", "slim_pct", "slim_env", "slim_flags", "slim_url"), F.coalesce("place", F.lit(99))).alias("r")).select(*keys, "r.*")
    flag = F.exists("slim_flags", lambda f: F.exists("args", lambda a: (a == f) | a.startswith(F.concat(f, F.lit("=")))))
    slim = F.coalesce(F.arrays_overlap("slim_env", "env_keys") | flag | F.coalesce(F.instr("url", F.col("slim_url")) > 0, F.lit(False)), F.lit(False))
    if measured is not None:
        first = first.join(measured.select("name", F.col("tools").alias("m_tools"), F.col("tokens").alias("m_tokens")), "name", "left")
    else:
        first = first.withColumn("m_tools", F.lit(None).cast("long")).withColumn("m_tokens", F.lit(None).cast("long"))
    is_measured, is_known = F.col("m_tokens").isNotNull(), F.col("id").isNotNull()
    pct = F.coalesce("slim_pct", F.lit(0))
    out = first.withColumn("is_slim", is_known & slim)
    base = F.when(F.col("is_slim"), F.floor(F.col("cold") * (100 - pct) / 100)).otherwise(F.col("cold"))
    out = out.withColumn("basis", F.when(is_measured, "measured").when(is_known, "catalog").otherwise("unknown"))
    out = out.withColumn("tokens", F.coalesce("m_tokens", F.when(is_known, base), F.lit(0)).cast("long")).withColumn("n_tools", F.coalesce("m_tools", "tools", F.lit(0)).cast("long"))
    swap = F.coalesce((F.col("recommendation") != "Keep") & F.col("cli").isNotNull(), F.lit(False))
    out = out.withColumn("swap_savings", F.when(swap, F.col("tokens")).otherwise(F.lit(0)).cast("long"))
    out = out.withColumn("slim_savings", F.when(~F.col("is_slim") & is_known, F.floor(F.col("tokens") * pct / 100)).otherwise(F.lit(0)).cast("long"))
    write, read = cache_factors(provider)
    whole = lambda x: F.floor(x + 0.5).cast("long")
    return out.select(
        *keys, "id", "basis", "is_slim", "n_tools", whole(F.col("tokens") * write).alias("cold_tokens"), whole(F.col("tokens") * read).alias("warm_tokens"),
        (F.lit(500) + 600 * F.least("n_tools", F.lit(5))).cast("long").alias("search_tokens"), F.col("tokens").alias("capacity_tokens"), "swap_savings", "slim_savings",
    )


def totals(reports: DataFrame, provider: str = "anthropic") -> DataFrame:
    rate = next(r for r in PRICES if r[1] == provider and r[10])[2]
    sums = reports.agg(
        F.count("*").alias("servers"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("cold_tokens", "warm_tokens", "search_tokens", "capacity_tokens", "swap_savings", "slim_savings")],
        F.count_if(F.col("basis") == "catalog").alias("matched"), F.count_if(F.col("basis") == "unknown").alias("unknown"), F.count_if(F.col("basis") == "measured").alias("measured"),
    )
    return sums.withColumn("window_pct", F.floor(F.col("capacity_tokens") * 10_000 / WINDOW + 0.5) / 100).withColumn("cold_usd", F.col("cold_tokens") / 1e6 * rate)


def not_configured(measured: DataFrame, rows: DataFrame) -> DataFrame:
    """Inventories of servers that no configuration names: an error of the caller's."""
    return measured.join(rows, "name", "left_anti").select("name")


# Tool lists ---------------------------------------------------------------------------------------------------------


def _tools_of(text: str | None) -> list[tuple[str, str, str]] | None:
    """(name, description, canonical form) of a tools list in any of three envelopes; nothing if it is none."""
    try:
        root = json.loads(text or "")
    except ValueError:
        return None
    if isinstance(root, dict):
        if any(k in root for k in ("mcpServers", "servers", "context_servers")):
            return None
        inner = root.get("result")
        root = root.get("tools", inner.get("tools") if isinstance(inner, dict) else None)
    if not isinstance(root, list) or not root or not all(isinstance(t, dict) and isinstance(t.get("name"), str) for t in root):
        return None
    out = []
    for t in root:
        description = t.get("description") if isinstance(t.get("description"), str) else ""
        form = {"name": t["name"], "description": description}
        schema = t.get("inputSchema", t.get("input_schema"))
        if schema is not None:
            form["input_schema"] = json.loads(json.dumps(schema, sort_keys=True))
        out.append((t["name"], description, json.dumps(form, separators=(",", ":"), ensure_ascii=False)))
    return out


def tools(manifests: DataFrame) -> DataFrame:
    """(server, name, description, serialized) of manifests (server, text)."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(s, *t) for s, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for t in _tools_of(x) or ()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(4)], names=["server", "name", "description", "serialized"])

    return manifests.select("server", "text").mapInArrow(parse, "server string, name string, description string, serialized string")


def inventory(rows: DataFrame) -> DataFrame:
    """Tools (server, name, description, serialized) with tokens and their share of the server's, in per cent of two places."""
    sized = rows.withColumn("tokens", approx_tokens(F.octet_length("serialized")))
    whole = F.sum("tokens").over(Window.partitionBy("server"))
    return sized.withColumn("share_pct", F.floor(F.col("tokens") * 10_000 / whole + 0.5) / 100).select("server", "name", "tokens", "share_pct")


def duplicate_names(rows: DataFrame) -> DataFrame:
    return rows.groupBy("server", "name").agg(F.count("*").alias("n")).where("n > 1")


def first_word(text: Column) -> Column:
    return F.lower(F.regexp_extract(text, r"([A-Za-z]+)", 1))


def is_purpose_verb(word: Column) -> Column:
    """A verb of the list, or one with s or es after it."""
    verbs = list(VERBS)
    return word.isin(verbs) | F.regexp_replace(word, r"s$", "").isin(verbs) | F.regexp_replace(word, r"es$", "").isin(verbs)


def lints(rows: DataFrame) -> DataFrame:
    """(server, name, rule) of tools by their own descriptions: no purpose verb first, none at all, no output shape, too long."""
    text = F.trim(F.coalesce("description", F.lit("")))
    shape = F.lit(False)
    for mark in SHAPES:
        shape = shape | (F.instr(F.lower(text), mark) > 0)
    empty = text == ""
    rules = F.array_compact(F.array(
        F.when(empty, "missing-description"), F.when(~empty & ~is_purpose_verb(first_word(text)), "no-leading-purpose-verb"),
        F.when(~empty & ~shape, "no-output-shape"), F.when(approx_tokens(F.octet_length(text)) > LONG, "over-long-description"),
    ))
    return rows.select("server", "name", F.explode(rules).alias("rule"))


def near_duplicate_descriptions(rows: DataFrame, alike: float = 0.7, least: int = 60) -> DataFrame:
    """(server, first, members) of tools whose descriptions are the same but for case and space, or alike and not short.

    Only descriptions that share a band of their min-hash slots are compared; alike ones always share one.
    """

    slots = 64
    bands = slots - math.ceil(alike * slots) + 1  # so many bands: slots that differ spoil all but one at most
    width = slots // bands

    def group(table: pa.Table) -> pa.Table:
        names, texts = table.column("name").to_pylist(), [(d or "").strip() for d in table.column("description").to_pylist()]
        order = sorted(range(len(names)), key=lambda i: (names[i], texts[i]))
        names, texts = [names[i] for i in order], [texts[i] for i in order]
        root = list(range(len(names)))

        def top(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        def join(i: int, j: int) -> None:
            a, b = sorted((top(i), top(j)))
            root[b] = a

        same: dict[str, int] = {}
        held: dict[tuple[int, bytes], list[int]] = {}
        signs: dict[int, np.ndarray] = {}
        for i, text in enumerate(texts):
            if text and same.setdefault(text.lower(), i) != i:
                join(i, same[text.lower()])
            if len(text.encode()) < least:
                continue
            signs[i] = minhash(text.encode())
            for band in range(bands):
                met = held.setdefault((band, signs[i][band * width : (band + 1) * width].tobytes()), [])
                for j in met:
                    if top(i) != top(j) and (signs[i] == signs[j]).mean() >= alike:
                        join(i, j)
                met.append(i)
        groups: dict[int, list[int]] = {}
        for i in range(len(names)):
            groups.setdefault(top(i), []).append(i)
        found = [g for g in groups.values() if len(g) > 1]
        server = table.column("server")[0].as_py()
        return pa.table({"server": pa.array([server] * len(found), pa.string()), "first": pa.array([names[g[0]] for g in found], pa.string()), "members": pa.array([[names[i] for i in g] for g in found], pa.list_(pa.string()))})

    return rows.select("server", "name", "description").groupBy("server").applyInArrow(group, "server string, first string, members array<string>")


def slug(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(name), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def saved(rows: DataFrame, captured_at: str) -> DataFrame:
    """(file, body) of servers' tool lists (server, name, description): a slug of the server's name, and indented JSON with secrets redacted."""

    def body(table: pa.Table) -> pa.Table:
        server = table.column("server")[0].as_py()
        listed = sorted(zip(table.column("name").to_pylist(), (d or "" for d in table.column("description").to_pylist()), strict=True))
        text = json.dumps({"server": server, "captured_at": captured_at, "tools": [{"name": n, "description": redact(d)[0]} for n, d in listed]}, indent=2, ensure_ascii=False)
        return pa.table({"server": pa.array([server], pa.string()), "body": pa.array([text], pa.string())})

    made = rows.select("server", "name", "description").groupBy("server").applyInArrow(body, "server string, body string")
    return made.select(F.concat(slug(F.col("server")), F.lit(".json")).alias("file"), "body")


def resolved(explicit: DataFrame, cached: DataFrame, reports: DataFrame) -> DataFrame:
    """Where each server's inventory comes from: a given list, then a cached manifest, then the catalog, else unknown."""
    mark = lambda df, label: df.select("name").distinct().withColumn(label, F.lit(True))
    rows = reports.select("name", "id").join(mark(explicit, "given"), "name", "left").join(mark(cached, "kept"), "name", "left")
    return rows.select("name", F.when(F.col("given"), "explicit").when(F.col("kept"), "cached").when(F.col("id").isNotNull(), "catalog").otherwise("unknown").alias("origin"))


def stale(manifests: DataFrame, today: str, days: int = 90) -> DataFrame:
    """Cached manifests (server, captured_at) with their age, and whether it is over so many days."""
    age = F.datediff(F.lit(today).cast("date"), F.col("captured_at").cast("date"))
    return manifests.select("server", "captured_at", age.alias("age_days"), (age > days).alias("is_stale"))
