"""Readers of files: session logs, rollout logs, ledgers, configurations, workflows, hooks, office documents.

Log trees are read whole-file, since "the last line wins" needs the order of lines; a session's file is bounded by the
session. Everything after the split is column expressions on VARIANT.
"""

from __future__ import annotations

import io
import re
import tomllib
import zipfile
from collections.abc import Iterator
from pathlib import Path
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import iso_seconds, utc_day
from ..operators.usage import last_lines, winners

# Actions whose steps call a model, and the fields of their steps that hold prompts.
ACTIONS = ("anthropics/claude-code-action", "anthropics/claude-action")
PROMPTS = ("prompt", "system_prompt", "claude_args")
SUBAGENT = r"/subagents/agent-[^/]*\.jsonl$"


def whole_texts(spark: SparkSession, root: str, glob: str = "*.jsonl") -> DataFrame:
    """(file, text) of all files below a folder that fit the glob."""
    return spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def once(rows: DataFrame, *cols: Column) -> DataFrame:
    """The rows with more columns, each computed once a row: no filter and no later column goes below a generator and repeats them there."""
    return rows.select("*", F.inline(F.array(F.struct(*cols))))


def lines(files: DataFrame) -> DataFrame:
    """(file, line_no, json, bad): lines that are not blank, parsed leniently; bad if they are no JSON."""
    rows = files.select("file", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).where(F.trim("line") != "")
    return once(rows, F.try_parse_json("line").alias("json")).withColumn("bad", F.col("json").isNull())


def _get(path: str, kind: str, of: str = "json") -> Column:
    return F.try_variant_get(of, path, kind)


def session_lines(files: DataFrame) -> DataFrame:
    """Usage records of session logs and, with skipped set, lines that count as skipped.

    A record needs usage, a model that is not synthetic, message id, request id, time and cwd as strings. A counter that
    is missing is 0; the split of cache writes by time to live counts if there is one, else all are of five minutes.
    """
    fields = lambda of, *names: F.try_variant_get(of, "$", f"struct<{', '.join(f'{n}: variant' for n in names)}>")
    text = lambda of: F.when(F.schema_of_variant(of) == "STRING", F.try_variant_get(of, "$", "string"))
    rows = once(lines(files), fields("json", "requestId", "timestamp", "cwd", "message").alias("top"))
    rows = once(rows, fields(F.col("top.message"), "id", "model", "usage").alias("message"))
    counters = ("input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens", "cache_creation")
    named = {"message_id": "message.id", "request_id": "top.requestId", "model": "message.model", "time": "top.timestamp", "cwd": "top.cwd"}
    rows = once(rows, fields(F.col("message.usage"), *counters).alias("usage"), *[text(F.col(at)).alias(name) for name, at in named.items()])
    full = F.col("usage").isNotNull() & F.col("message_id").isNotNull() & F.col("request_id").isNotNull() & F.col("time").isNotNull() & F.col("cwd").isNotNull() & (F.col("model") != "<synthetic>")
    split = fields(F.col("usage.cache_creation"), "ephemeral_5m_input_tokens", "ephemeral_1h_input_tokens")
    rows = once(rows, F.coalesce(full, F.lit(False)).alias("is_usage"), iso_seconds(F.col("time")).alias("ts"), split.alias("split"))
    count = lambda at: F.coalesce(F.greatest(F.lit(0), F.try_variant_get(F.col(at), "$", "bigint")), F.lit(0)).cast("long")
    some = F.col("split").isNotNull()
    return rows.select(
        "file", "line_no", (F.col("bad") | (F.col("is_usage") & F.col("ts").isNull())).alias("skipped"), "is_usage", "message_id", "request_id", "model", "cwd", "ts",
        count("usage.input_tokens").alias("input"), count("usage.output_tokens").alias("output"), count("usage.cache_read_input_tokens").alias("cache_read"),
        F.when(some, count("split.ephemeral_5m_input_tokens")).otherwise(count("usage.cache_creation_input_tokens")).alias("w5"),
        F.when(some, count("split.ephemeral_1h_input_tokens")).otherwise(F.lit(0)).cast("long").alias("w1"),
    )


def session_requests(files: DataFrame) -> DataFrame:
    """Requests of session logs after both steps of dedup, as the usage operators take them."""
    rows = session_lines(files).where("is_usage and not skipped")
    won = winners(last_lines(rows))
    sub = F.col("file").rlike(SUBAGENT)
    stem = F.regexp_extract("file", r"([^/]*)\.jsonl$", 1)
    parent = F.when(sub, F.regexp_extract("file", r"([^/]*)/subagents/[^/]*$", 1))
    return won.select(F.lit("claude_code").alias("source"), stem.alias("session_id"), F.col("cwd").alias("project_key"), sub.alias("is_subagent"), parent.alias("parent_session_id"), "model", "ts", utc_day(F.col("ts")).alias("day"), "input", "output", "cache_read", "w5", "w1")


def ingest_metrics(files: DataFrame) -> DataFrame:
    rows = session_lines(files)
    return rows.agg(F.count_if("skipped").alias("skipped_lines"), F.countDistinct("file").alias("files"), F.count_if(F.col("is_usage") & ~F.col("skipped")).alias("records"))


def changed(files: DataFrame, cached: DataFrame) -> DataFrame:
    """Files (file, mtime, size) that the cache does not hold as they are: what has to be parsed again."""
    return files.join(cached.select("file", "mtime", "size"), ["file", "mtime", "size"], "left_anti")


def file_stamps(spark: SparkSession, root: str, glob: str = "*.jsonl") -> DataFrame:
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    return rows.select(F.col("path").alias("file"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size"))


def rollout_requests(files: DataFrame) -> DataFrame:
    """Requests of rollout logs: one for each token count that is not empty, with the file's first cwd, id and model.

    A file with events but without cwd is skipped; its id falls back to the last part of its name, its model to unknown.
    """
    rows = lines(files).withColumn("type", _get("$.type", "string"))
    meta, turn, event = F.col("type") == "session_meta", F.col("type") == "turn_context", F.col("type") == "event_msg"
    first = lambda p, on: F.min_by(_get(p, "string"), F.when(on & _get(p, "string").isNotNull(), F.col("line_no")))
    per = rows.groupBy("file").agg(first("$.payload.cwd", meta).alias("cwd"), first("$.payload.id", meta).alias("id"), first("$.payload.model", meta).alias("m1"), first("$.payload.model", turn).alias("m2"))
    count = lambda p: F.coalesce(_get(f"$.payload.info.last_token_usage.{p}", "bigint"), F.lit(0)).cast("long")
    some = F.try_variant_get("json", "$.payload.info.last_token_usage", "variant").isNotNull() & (_get("$.payload.type", "string") == "token_count")
    events = rows.where(event & some).select("file", iso_seconds(_get("$.timestamp", "string")).alias("ts"), F.greatest(F.lit(0), count("input_tokens") - count("cached_input_tokens")).alias("input"), count("cached_input_tokens").alias("cache_read"), count("output_tokens").alias("output"))
    events = events.where("ts is not null and input + cache_read + output > 0").join(per.where("cwd is not null"), "file")
    stem = F.element_at(F.split(F.regexp_extract("file", r"([^/]*)\.jsonl$", 1), "-"), -1)
    zero = F.lit(0).cast("long")
    return events.select(F.lit("codex").alias("source"), F.coalesce("id", stem).alias("session_id"), F.col("cwd").alias("project_key"), F.lit(False).alias("is_subagent"), F.lit(None).cast("string").alias("parent_session_id"), F.coalesce("m1", "m2", F.lit("codex-unknown")).alias("model"), "ts", utc_day(F.col("ts")).alias("day"), "input", "output", "cache_read", zero.alias("w5"), zero.alias("w1"))


def skipped_rollouts(files: DataFrame) -> DataFrame:
    """Rollout files with events and no cwd."""
    rows = lines(files).withColumn("type", _get("$.type", "string"))
    per = rows.groupBy("file").agg(F.max(F.when(F.col("type") == "session_meta", _get("$.payload.cwd", "string"))).alias("cwd"), F.count_if((F.col("type") == "event_msg") & F.try_variant_get("json", "$.payload.info.last_token_usage", "variant").isNotNull()).alias("events"))
    return per.where("events > 0 and cwd is null").select("file")


def ledger(files: DataFrame) -> DataFrame:
    """Ledger rows with their headline's figures; lines that are no JSON are left out."""
    rows = lines(files).where("not bad")
    figure = lambda p: _get(f"$.headline.{p}", "bigint")
    return rows.select(
        F.col("line_no").cast("long").alias("line_no"), _get("$.ts", "bigint").alias("ts"), _get("$.command", "string").alias("command"), F.coalesce(_get("$.project_key", "string"), F.lit("")).alias("project_key"),
        figure("always_tokens").alias("always_tokens"), figure("reclaimable_min").alias("reclaimable_min"), figure("reclaimable_max").alias("reclaimable_max"), figure("swap_savings_tokens").alias("swap"), figure("slim_savings_tokens").alias("slim"),
        figure("savings_min").alias("savings_min"), figure("savings_max").alias("savings_max"),
    ).where("ts is not null and command is not null")


def append_ledger(rows: DataFrame, path: str) -> None:
    """Add rows (v, ts, command, project_key, headline) to a ledger of JSON lines."""
    rows.write.mode("append").json(path)


def config(path: str) -> dict:
    """Settings of the queries from a TOML file; nothing if it is missing."""
    file = Path(path)
    return tomllib.loads(file.read_text()) if file.exists() else {}


def toml_servers(text: str) -> dict:
    """Servers of a TOML configuration, in the shape of the JSON ones."""
    return {"mcpServers": tomllib.loads(text).get("mcp_servers", {})}


def hooks(settings: DataFrame) -> DataFrame:
    """(path, events) of settings files (path, text) that define hooks; event names in order; malformed files are left out."""
    json = F.try_parse_json("text")
    names = F.json_object_keys(F.to_json(F.try_variant_get(json, "$.hooks", "variant")))
    return settings.select("path", F.array_join(F.array_sort(names), ",").alias("events")).where("events <> ''")


def workflow_prompts(text: str) -> list[tuple[str, str]]:
    """(field, value) of the prompts in steps of a workflow that call a model.

    A step begins at its uses line and ends at the next list item no deeper; a block value goes on while lines are deeper
    than its key.
    """
    out: list[tuple[str, str]] = []
    step: int | None = None
    block: tuple[str, int, list[str]] | None = None

    def close() -> None:
        nonlocal block
        if block is not None:
            value = "\n".join(block[2]).strip()
            if value:
                out.append((block[0], value))
            block = None

    for line in text.splitlines():
        bare = line.strip()
        depth = len(line) - len(line.lstrip())
        if block is not None:
            if not bare or depth > block[1]:
                block[2].append(bare)
                continue
            close()
        uses = re.match(r"(?:- )?uses:\s*['\"]?([^'\"]*)", bare)
        if step is not None and bare.startswith("- ") and depth <= step:
            step = None
        if uses and step is None:
            step = depth if any(a in uses[1].lower() for a in ACTIONS) else None
            continue
        if step is not None and depth > step:
            field = next((f for f in PROMPTS if bare.startswith(f + ":")), None)
            if field:
                value = bare[len(field) + 1 :].strip()
                if value in ("|", "|-", "|+"):
                    block = (field, depth, [])
                elif value:
                    out.append((field, value.strip("'\"")))
    close()
    return out


def workflows(files: DataFrame) -> DataFrame:
    """(path, field, value, tokens) of the prompts in workflow files (path, text)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(p, *f) for p, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for f in workflow_prompts(t or "")]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(3)], names=["path", "field", "value"])

    calls = F.lit(False)
    for action in ACTIONS:
        calls = calls | F.lower("text").contains(action)
    found = files.where(calls).select("path", "text").mapInArrow(scan, "path string, field string, value string")
    return found.withColumn("tokens", F.ceil(F.octet_length("value") / 4))


# Office documents --------------------------------------------------------------------------------------------------


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def docx_text(raw: bytes) -> str:
    """Runs of text, a new line after each paragraph."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    paragraphs = [p for p in root.iter() if _local(p.tag) == "p"]
    return "".join("".join(t.text or "" for t in p.iter() if _local(t.tag) == "t") + "\n" for p in paragraphs)


def xlsx_text(raw: bytes) -> str:
    """Cells that are not empty, tabs between them, a blank line between sheets."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = z.namelist()
        shared: list[str] = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in s.iter() if _local(t.tag) == "t") for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")) if _local(s.tag) == "si"]
        sheets = []
        for name in sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[0])):
            rows = []
            for row in (r for r in ElementTree.fromstring(z.read(name)).iter() if _local(r.tag) == "row"):
                cells = []
                for cell in (c for c in row if _local(c.tag) == "c"):
                    value = next((v.text or "" for v in cell.iter() if _local(v.tag) in ("v", "t")), "")
                    cells.append(shared[int(value)] if cell.get("t") == "s" and value else value)
                rows.append("\t".join(c for c in cells if c))
            sheets.append("\n".join(r for r in rows if r))
    return "\n\n".join(sheets)


def extracted(raw: bytes, name: str) -> str | None:
    """Text of a file by its ending, then by how it begins, else as UTF-8; nothing if it is neither."""
    low = name.lower()
    try:
        if low.endswith(".docx"):
            return docx_text(raw)
        if low.endswith((".xlsx", ".xlsm")):
            return xlsx_text(raw)
        if raw.startswith(b"PK\x03\x04"):
            with zipfile.ZipFile(io.BytesIO(raw)) as z:
                inside = z.namelist()
            return docx_text(raw) if "word/document.xml" in inside else xlsx_text(raw) if "xl/workbook.xml" in inside else None
        return raw.decode()
    except (UnicodeDecodeError, zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return None


def read_files(files: DataFrame) -> DataFrame:
    """(path, text) of files (path, content); text is null where there is none to read."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [extracted(raw, p) for p, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=["path", "text"])

    return files.select("path", "content").mapInArrow(read, "path string, text string")


def texts(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path, text) of all files below a folder."""
    return read_files(spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root))


def ignored(patterns: list[str]) -> re.Pattern:
    """One pattern for the lines of an ignore file: *, **, ?, a leading slash, and a trailing one."""
    parts = []
    for line in (p.strip() for p in patterns):
        if not line or line.startswith(("#", "!")):
            continue
        rooted = "/" in line.rstrip("/")
        body = re.escape(line.strip("/")).replace(r"\*\*/", "(?:.*/)?").replace(r"\*\*", ".*").replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
        parts.append(("^" if rooted else "(?:^|/)") + body + "(?:/|$)")
    parts.append(r"(?:^|/)(?:\.git|node_modules|target)(?:/|$)")
    return re.compile("|".join(parts))


def repository(files: DataFrame, patterns: list[str]) -> DataFrame:
    """Files (path, ...) of a repository without those that its ignore lines, or its fixed folders, leave out."""
    return files.where(~F.col("path").rlike(ignored(patterns).pattern))


def parents(rows: DataFrame) -> DataFrame:
    """Streams of subagents with their parent's session, and how many each parent has."""
    subs = rows.where("is_subagent").select("session_id", "parent_session_id").distinct()
    return subs.withColumn("streams", F.count("*").over(Window.partitionBy("parent_session_id")))
