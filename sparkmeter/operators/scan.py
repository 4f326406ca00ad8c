"""A machine's agent set-up: where clients keep configurations, instruction files, shell files, hooks; and one report of all.

Files come as (path, text), listed by the caller; home, config and cwd say where the three bases are.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.markup import without_comments
from ..sources.logs import hooks, toml_servers, workflows
from . import audit as A
from . import redact as R
from .mcp import catalog, first_defined, server_reports, servers

# Fixed values: (client, base, path below it, operating systems or all).
LOCATIONS: tuple[tuple[str, str, str, str | None], ...] = (
    ("Claude Desktop", "config", "Claude/claude_desktop_config.json", None),
    ("Claude Code", "home", ".claude.json", None),
    ("Claude Code", "home", ".claude/settings.json", None),
    ("Claude Code (project)", "cwd", ".mcp.json", None),
    ("Claude Code (project)", "cwd", ".claude/settings.json", None),
    ("Cursor", "home", ".cursor/mcp.json", None),
    ("Cursor (project)", "cwd", ".cursor/mcp.json", None),
    ("Codex", "home", ".codex/config.toml", None),
    ("VS Code", "config", "Code/User/settings.json", None),
    ("VS Code (project)", "cwd", ".vscode/mcp.json", None),
    ("Zed", "home", ".config/zed/settings.json", "macos,linux"),
    ("Zed", "config", "Zed/settings.json", "windows"),
    ("Zed (project)", "cwd", ".zed/settings.json", None),
    ("Continue", "home", ".continue/config.json", None),
    ("Continue (project)", "cwd", ".continue/config.json", None),
    ("Windsurf", "home", ".codeium/windsurf/mcp_config.json", None),
    ("Gemini CLI", "home", ".gemini/settings.json", None),
)
INSTRUCTIONS = (r"/(CLAUDE|CLAUDE\.local|AGENTS|GEMINI)\.md$", r"/\.cursorrules$", r"/\.windsurfrules$", r"/\.github/copilot-instructions\.md$", r"/\.cursor/rules/[^/]+$", r"/\.windsurf/rules/[^/]+$")
SHELLS = (r"/\.(bashrc|bash_profile|profile|zshrc|zprofile|zshenv)$", r"/\.config/fish/config\.fish$")


def locations(spark: SparkSession, home: str, config: str, cwd: str, system: str) -> DataFrame:
    """(place, client, path) of the configurations to look for on a system; a path that two clients name is the first's."""
    roots = {"home": home, "config": config, "cwd": cwd}
    rows = [(n, client, f"{roots[base]}/{rel}") for n, (client, base, rel, only) in enumerate(LOCATIONS) if only is None or system in only.split(",")]
    return F.broadcast(first_defined(spark.createDataFrame(rows, "priority int, client string, path string"), "path").withColumnRenamed("priority", "place"))


def configurations(files: DataFrame, known: DataFrame) -> DataFrame:
    """(client, path, text) of the configurations that are there, in one shape: JSON with servers.

    TOML becomes JSON; servers of projects inside one file come after those at its top, and the first of a name counts.
    """

    def shape(path: str, text: str | None) -> str:
        try:
            if path.endswith(".toml"):
                return json.dumps(toml_servers(text or ""))
            root = json.loads(without_comments(text or ""))
        except ValueError:
            return "{}"
        if isinstance(root, dict) and isinstance(root.get("projects"), dict):
            merged = dict(root.get("mcpServers") or {})
            for project in root["projects"].values():
                for name, server in (project.get("mcpServers") or {}).items() if isinstance(project, dict) else ():
                    merged.setdefault(name, server)
            return json.dumps({"mcpServers": merged})
        return json.dumps(root)

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            texts = [shape(p, t) for p, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["client", "path", "text"])

    return files.join(known, "path").select("client", "path", "text").mapInArrow(read, "client string, path string, text string")


def instructions(files: DataFrame, deep: bool = False) -> DataFrame:
    """Instruction files with their tokens and, if deep, their findings' count and savings."""
    rows = files.where(reduce(lambda a, b: a | b, (F.col("path").rlike(p) for p in INSTRUCTIONS))).dropDuplicates(["path"])
    out = rows.select("path", F.ceil(F.octet_length("text") / 4).alias("tokens"))
    if not deep:
        return out
    docs = rows.select(F.xxhash64("path").alias("doc_id"), "text", F.ceil(F.octet_length("text") / 4).alias("input_tokens"))
    sums = A.report(A.audit(docs)).select(F.col("doc_id").alias("_id"), "findings", "savings_max")
    return out.join(sums, F.xxhash64("path") == F.col("_id"), "left").select("path", "tokens", F.coalesce("findings", F.lit(0)).alias("findings"), F.coalesce("savings_max", F.lit(0)).alias("savings_max"))


def shells(files: DataFrame) -> DataFrame:
    """Shell files with secrets: how many and of which kinds, never the values."""
    rows = files.where(reduce(lambda a, b: a | b, (F.col("path").rlike(p) for p in SHELLS))).select(F.xxhash64("path").alias("doc_id"), "path", "text")
    return R.file_secrets(rows.select("doc_id", "text")).join(rows.select("doc_id", "path"), "doc_id").where("secret_count > 0").select("path", "secret_count", "kinds")


def swaps(reports: DataFrame, binaries: DataFrame) -> DataFrame:
    """Servers that a command-line tool can replace, and whether one of its programs is on this machine."""
    spark = reports.sparkSession
    tools = catalog(spark).select("id", "cli", "recommendation").where("cli is not null and recommendation <> 'Keep'")
    rows = reports.join(tools, "id").withColumn("program", F.explode(F.split(F.regexp_replace("cli", r" (\+|/) ", "/"), "/")))
    rows = rows.join(binaries.select(F.col("name").alias("program"), F.lit(True).alias("found")), "program", "left")
    return rows.groupBy("name", "id", "cli", "swap_savings").agg(F.coalesce(F.bool_or("found"), F.lit(False)).alias("installed"))


def report(files: DataFrame, known: DataFrame) -> DataFrame:
    """One row a thing found: kind, path, name, amount."""
    spark = files.sparkSession
    row = lambda df, kind, name, amount: df.select(F.lit(kind).alias("kind"), "path", F.col(name).alias("name") if isinstance(name, str) else name.alias("name"), F.col(amount).cast("long").alias("amount"))
    configs = configurations(files, known)
    found = server_reports(servers(configs), catalog(spark))
    parts = [
        row(found, "server", "name", "cold_tokens"), row(instructions(files), "instructions", F.lit(""), "tokens"), row(shells(files), "shell", "kinds", "secret_count"),
        row(hooks(files.where(F.col("path").rlike(r"/\.claude/settings(\.local)?\.json$"))).withColumn("n", F.size(F.split("events", ","))), "hooks", "events", "n"),
        row(workflows(files.where(F.col("path").rlike(r"/\.github/workflows/[^/]+\.ya?ml$"))), "workflow", "field", "tokens"),
    ]
    return reduce(DataFrame.unionByName, parts)
