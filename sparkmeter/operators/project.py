"""Repository roll-ups: path classes and load profiles, per-file tokens and findings, base against head."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import audit as A
from . import redact as R

METRICS = ("always_tokens", "context_tokens", "files")


#: Fixed values: (pattern of the path, class, profile); the first that fits counts. Files that fit none are no context.
CLASSES: tuple[tuple[str, str, str], ...] = (
    (r"(^|/)\.mcp\.json$|(^|/)\.cursor/mcp\.json$|(^|/)\.vscode/mcp\.json$|(^|/)\.zed/settings\.json$|(^|/)\.claude/settings\.json$", "mcp-config", "mcp"),
    (r"(^|/)SKILL\.md$", "skill", "on_invocation"),
    (r"(^|/)CLAUDE\.md$", "claude-md", "always"),
    (r"(^|/)AGENTS\.md$", "agents-md", "always"),
    (r"(^|/)GEMINI\.md$", "gemini-md", "always"),
    (r"(^|/)\.cursorrules$", "cursorrules", "always"),
    (r"(^|/)\.windsurfrules$", "windsurfrules", "always"),
    (r"(^|/)\.github/copilot-instructions\.md$", "copilot-instructions", "always"),
    (r"(^|/)\.cursor/rules(/|$)", "cursor-rule", "always"),
    (r"(^|/)\.claude/commands/(.*/)?[^/]*\.md$", "command", "on_invocation"),
    (r"(^|/)\.claude/agents/(.*/)?[^/]*\.md$", "agent", "on_invocation"),
    (r"(^|/)\.codex/prompts/(.*/)?[^/]*\.md$", "codex-prompt", "on_invocation"),
    (r"(^|/)\.claude/skills(/|$)", "skill-resource", "on_demand"),
    (r"(^|/)prompts?/(.*/)?[^/]*\.md$", "prompt-doc", "on_demand"),
    (r"^[^/]*\.md$", "doc", "docs"),
)


def classified(path: Column) -> Column:
    """struct<class, profile> of a path, null for a file that is no context."""
    out = F.lit(None).cast("struct<class:string,profile:string>")
    for pattern, kind, profile in reversed(CLASSES):
        out = F.when(path.rlike(pattern), F.struct(F.lit(kind).alias("class"), F.lit(profile).alias("profile"))).otherwise(out)
    return out


def front_matter(text: Column) -> tuple[Column, Column]:
    """(what stands between the first pair of --- lines, the rest)."""
    head = F.regexp_extract(text, r"(?s)^---\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|$)", 1)
    body = F.regexp_replace(text, r"(?s)^---\r?\n.*?\r?\n---[ \t]*(?:\r?\n|$)", "")
    return head, body


def front_field(head: Column, field: str) -> Column:
    return F.trim(F.regexp_replace(F.regexp_extract(head, rf"(?m)^{field}:[ \t]*(.*)$", 1), "^[\"']|[\"'\\s]+$", ""))


def entries(files: DataFrame, most: int = 2_000_000) -> DataFrame:
    """Context files (path, text) as entries: class, profile, part, tokens; a skill's front matter is loaded always, its body on invocation."""
    rows = files.where(F.octet_length("text") <= most).select("path", "text", classified(F.col("path")).alias("k")).where("k is not null").select("path", "text", "k.*")
    head, body = front_matter(F.col("text"))
    skill = F.col("class") == "skill"
    both = F.array(F.struct(F.lit("head").alias("part"), F.lit("always").alias("profile"), head.alias("text")), F.struct(F.lit("body").alias("part"), F.lit("on_invocation").alias("profile"), body.alias("text")))
    whole = F.array(F.struct(F.lit("whole").alias("part"), F.col("profile"), F.col("text")))
    rows = rows.select("path", "class", F.explode(F.when(skill, both).otherwise(whole)).alias("e")).select("path", "class", "e.*")
    return rows.withColumn("tokens", F.ceil(F.octet_length("text") / 4))


def file_findings(parts: DataFrame) -> DataFrame:
    """Audit findings of entries, by path; a skill's only for its body."""
    docs = parts.where("part <> 'head' and profile <> 'mcp'").withColumn("doc_id", F.xxhash64("path"))
    found = A.audit(docs.select("doc_id", "text", F.col("tokens").alias("input_tokens")))
    return found.join(docs.select("doc_id", "path"), "doc_id").drop("doc_id")


def file_secrets(parts: DataFrame) -> DataFrame:
    docs = parts.where("part <> 'head'").withColumn("doc_id", F.xxhash64("path"))
    return R.file_secrets(docs.select("doc_id", "text")).join(docs.select("doc_id", "path"), "doc_id").where("secret_count > 0").select("path", "secret_count", "kinds")


def profiles(parts: DataFrame, mcp_cold: int = 0) -> DataFrame:
    """Files and tokens of each profile; the cold tokens of tool servers are always loaded."""
    sums = parts.where("profile <> 'mcp'").groupBy("profile").agg(F.countDistinct("path").alias("files"), F.sum("tokens").alias("tokens"))
    return sums.withColumn("tokens", F.col("tokens") + F.when(F.col("profile") == "always", F.lit(mcp_cold)).otherwise(F.lit(0)))


def heaviest(parts: DataFrame, top: int = 10) -> DataFrame:
    sums = parts.where("profile <> 'mcp'").groupBy("path").agg(F.sum("tokens").alias("tokens"))
    return sums.orderBy(F.col("tokens").desc(), "path").limit(top)


def heavy_rows(parts: DataFrame, top: int | None = None) -> DataFrame:
    """(path, tokens, pct_always) of context files, heaviest first: their share of what is always loaded, in per cent; all if no top is given."""
    always = parts.agg(F.coalesce(F.sum(F.when(F.col("profile") == "always", F.col("tokens"))), F.lit(0)).alias("always"))
    rows = parts.where("profile <> 'mcp'").groupBy("path").agg(F.sum("tokens").alias("tokens")) if top is None else heaviest(parts, top)
    share = F.when(F.col("always") > 0, F.col("tokens") / F.col("always") * 100).otherwise(F.lit(0.0))
    return rows.crossJoin(F.broadcast(always)).select("path", "tokens", share.alias("pct_always"))  # one row


def skeleton(files: DataFrame, parts: DataFrame, rules: DataFrame, mcp_servers: int, pointer: str, top: int = 5) -> DataFrame:
    """One row, json: totals, the heaviest files, findings by rule (rule, findings, place) and servers, in a fixed order of fields."""
    listed = lambda place, *cols: F.transform(F.sort_array(F.collect_list(F.struct(*place, F.struct(*cols).alias("x")))), lambda r: r["x"])
    heavy = heaviest(parts, top).agg(listed((-F.col("tokens"), "path"), "path", "tokens").alias("heaviest"))
    by_rule = rules.agg(listed(("place",), "rule", F.col("findings").alias("count")).alias("findings_by_rule"))
    scanned = files.agg(F.count("*").alias("files_scanned"))
    context = parts.where("profile <> 'mcp'").agg(F.countDistinct("path").alias("context_files"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("context_tokens"))
    one = scanned.crossJoin(context).crossJoin(heavy).crossJoin(by_rule)  # single rows
    return one.select(F.to_json(F.struct(F.struct("files_scanned", "context_files", "context_tokens").alias("totals"), "heaviest", "findings_by_rule", F.lit(mcp_servers).alias("mcp_servers"), F.lit(pointer).alias("pointer"))).alias("json"))


def narrate_plan(skeletons: DataFrame, system: str) -> DataFrame:
    """(user, prompt_tokens) for each skeleton (json): what a model is asked to tell, and its size at four bytes a token."""
    user = F.concat(F.lit("Input JSON:\n"), "json", F.lit("\n\nExplain this summary now."))
    return skeletons.select(user.alias("user"), (F.lit(len(system.encode()) // 4) + F.floor(F.octet_length(user) / 4)).alias("prompt_tokens"))


def delta(base: DataFrame, head: DataFrame, max_always: int, max_growth_pct: float) -> DataFrame:
    """Metrics (metric, value) of two reports side by side, the change, and whether a gate fails."""
    rows = base.select("metric", F.col("value").alias("base")).join(head.select("metric", F.col("value").alias("head")), "metric", "full")
    rows = rows.select("metric", F.coalesce("base", F.lit(0)).alias("base"), F.coalesce("head", F.lit(0)).alias("head"))
    rows = rows.withColumn("delta", F.col("head") - F.col("base")).withColumn("pct", F.when(F.col("base") != 0, F.floor(F.col("delta") * F.lit(1000.0) / F.col("base") + 0.5) / 10))
    fails = ((F.col("metric") == "always_tokens") & (F.col("delta") > max_always)) | ((F.col("metric") == "context_tokens") & (F.col("pct") > max_growth_pct))
    return rows.withColumn("fails", F.coalesce(fails, F.lit(False)))


def metrics(parts: DataFrame) -> DataFrame:
    """(metric, value) of a report."""
    one = parts.where("profile <> 'mcp'").agg(F.coalesce(F.sum(F.when(F.col("profile") == "always", F.col("tokens"))), F.lit(0)).alias("always_tokens"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("context_tokens"), F.countDistinct("path").alias("files"))
    return reduce(DataFrame.unionByName, [one.select(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS])
