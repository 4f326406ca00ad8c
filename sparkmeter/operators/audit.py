"""Prompt audit: thirteen rules over texts, each a function from docs (doc_id, text, input_tokens) to findings.

Findings: doc_id, rule, severity, byte_start, byte_end, savings_min, savings_max, confidence. Offsets and sizes are
bytes of UTF-8. Rules that look at a text as a whole are column expressions; those that scan in order (paragraph and
sentence clusters, JSON spans, example blocks) run in Arrow batches behind a cheap filter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.markup import html_to_markdown, minified, tabular
from ..functions.scalars import approx_tokens, byte_prefix

# What each rule looks for.
FRAMES = r"^\s*File \"[^\"]*\", line \d+|^\s*at .*\(.*:\d+:\d+\)|^\tat [\w.$]+\(|^\s+\d+: "
VOLATILE = (
    r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}",
    r"\b1[78]\d{8}\b",
    r"(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b",
    r"(?i)(?:session|request|trace)[ _-]?id[\"':=\s]{0,4}[0-9a-f]{16,}",
)
TAG = r"</?[A-Za-z][A-Za-z0-9-]*(?:\s[^<>]*)?/?>"
FILLER = r"(?i)please note that|it is important to|in order to|as you can see|keep in mind that|it should be noted|\b(?:basically|actually|very|really|just)\b"
ROLE = r"(?i)\b(?:you are|your role|as an? |you should always|you must)"
EXAMPLE = r"(?im)^\s*(?:input|example|q)\s*[:#]|<example>"
MARKER = r"(?im)^\s*(?:input|output|example|q|a)\s*[:#]|</?example>"
LINK = r"\[([^\]]*)\]\([^)]*\)"
SCHEMA = "doc_id long, rule string, severity string, byte_start long, byte_end long, savings_min long, savings_max long, confidence double"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def prepared(docs: DataFrame) -> DataFrame:
    """doc_id, text, bytes, total: the given count of tokens, else one for four bytes; supplied: whether it was given."""
    size = F.octet_length("text").cast("long")
    given = F.col("input_tokens") if "input_tokens" in docs.columns else F.lit(None).cast("long")
    return docs.where("text is not null").select("doc_id", "text", size.alias("bytes"), F.coalesce(given, approx_tokens(size)).alias("total"), given.isNotNull().alias("supplied"))


def _finding(rows: DataFrame, rule: str, severity: Column | str, start: Column, end: Column, low: Column, high: Column, confidence: float) -> DataFrame:
    long = lambda c: F.floor(c).cast("long")
    severity = F.lit(severity) if isinstance(severity, str) else severity
    return rows.select("doc_id", F.lit(rule).alias("rule"), severity.alias("severity"), long(start).alias("byte_start"), long(end).alias("byte_end"), long(low).alias("savings_min"), long(high).alias("savings_max"), F.lit(confidence).alias("confidence"))


def _before(text: Column, pattern: str) -> Column:
    """Bytes before the first match; there is one."""
    flags = "".join(sorted(set("".join(re.findall(r"^\(\?([a-z]+)\)", pattern)) + "s")))
    return F.octet_length(F.regexp_extract(text, rf"(?{flags})^(.*?)(?:{re.sub(r'^\(\?[a-z]+\)', '', pattern)})", 1))


def stack_traces(docs: DataFrame, least: int = 6, kept: int = 5) -> DataFrame:
    some = docs.where(F.regexp_count("text", F.lit("(?m)" + FRAMES)) >= least)
    lines = some.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    order = Window.partitionBy("doc_id").orderBy("pos")
    start = F.coalesce(F.sum(F.octet_length("line") + 1).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lines = lines.withColumn("start", start).withColumn("line", F.regexp_replace("line", r"\r+$", ""))
    frames = lines.where(F.col("line").rlike(FRAMES)).withColumn("run", F.col("pos") - F.row_number().over(order))
    place = F.row_number().over(Window.partitionBy("doc_id", "run").orderBy("pos"))
    runs = frames.withColumn("place", place).groupBy("doc_id", "run")
    runs = runs.agg(F.count("*").alias("n"), F.min("start").alias("a"), F.max(F.col("start") + F.octet_length("line")).alias("b"), F.min(F.when(F.col("place") == kept + 1, F.col("start"))).alias("tail")).where(F.col("n") >= least)
    tokens = approx_tokens(F.col("b") - F.col("tail"))
    return _finding(runs, "stack-trace-verbosity", "high", F.col("a"), F.col("b"), tokens * 60 / 100, tokens * 80 / 100, 0.9)


def volatile_prefix(docs: DataFrame, zone: int = 1024) -> DataFrame:
    rows = docs.withColumn("head", byte_prefix(F.col("text"), zone))
    rows = rows.where(reduce(lambda a, b: a | b, (F.col("head").rlike(p) for p in VOLATILE)))
    spans = F.array(*[F.when(F.col("head").rlike(p), F.struct(_before(F.col("head"), p).alias("a"), F.lit(i).alias("i"), F.octet_length(F.regexp_extract("head", p, 0)).alias("n"))) for i, p in enumerate(VOLATILE)])
    rows = rows.withColumn("first", F.array_min(F.filter(spans, lambda s: s.isNotNull())))
    return _finding(rows, "volatile-prefix", "medium", F.col("first.a"), F.col("first.a") + F.col("first.n"), F.lit(0), F.col("total") * 90 / 100, 0.6)


def sub_cache_threshold(docs: DataFrame, low: int = 256, high: int = 1024) -> DataFrame:
    opener = F.lower(byte_prefix(F.col("text"), 200)).contains("you are")
    rows = docs.where((F.col("total") >= low) & (F.col("total") < high) & (opener | F.col("supplied")))
    return _finding(rows, "sub-cache-threshold", "low", F.lit(0), F.col("bytes"), F.lit(0), F.col("total") / 2, 0.5)


def html_content(docs: DataFrame) -> DataFrame:
    rows = docs.where(F.col("text").contains("<")).withColumn("tags", F.regexp_count("text", F.lit(TAG)))
    rows = rows.where((F.col("tags") > 20) & (F.col("tags") / (F.col("bytes") / 1024.0) > 5.0))
    region = F.regexp_extract("text", rf"(?s)({TAG}.*{TAG})", 1)
    rows = rows.withColumn("a", _before(F.col("text"), TAG)).withColumn("region", region).withColumn("size", F.octet_length("region"))
    saved = approx_tokens(F.greatest(F.lit(0), F.col("size") - F.octet_length(html_to_markdown(F.col("region")))))
    rows = rows.withColumn("saved", saved).withColumn("tokens", approx_tokens(F.col("size")))
    some = F.col("saved") > 0
    severity = F.when(F.col("tokens") > 2000, "high").otherwise("medium")
    return _finding(rows, "html-content", severity, F.col("a"), F.col("a") + F.col("size"), F.when(some, F.col("saved") * 60 / 100).otherwise(F.col("tokens") * 20 / 100), F.when(some, F.col("saved")).otherwise(F.col("tokens") * 90 / 100), 0.8)


def filler_phrases(docs: DataFrame, least: int = 5) -> DataFrame:
    rows = docs.where(F.regexp_count("text", F.lit(FILLER)) >= least).withColumn("a", _before(F.col("text"), FILLER))
    return _finding(rows, "filler-phrases", "low", F.col("a"), F.col("a") + F.octet_length(F.regexp_extract("text", FILLER, 0)), F.col("total") * 5 / 100, F.col("total") * 15 / 100, 0.5)


def role_description(docs: DataFrame, zone: int = 2048, most: int = 3) -> DataFrame:
    rows = docs.where(F.regexp_count("text", F.lit(ROLE)) > most).withColumn("head", byte_prefix(F.col("text"), zone))
    parts = rows.select("doc_id", F.posexplode(F.split("head", r"[.\n]")).alias("pos", "part"))
    order = Window.partitionBy("doc_id").orderBy("pos")
    start = F.coalesce(F.sum(F.octet_length("part") + 1).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lead = F.octet_length("part") - F.octet_length(F.regexp_replace("part", r"^\s+", ""))
    parts = parts.withColumn("a", start + lead).withColumn("part", F.regexp_replace("part", r"^\s+|\s+$", "")).where("part <> ''")
    parts = parts.withColumn("n", F.row_number().over(order)).withColumn("is_role", F.col("part").rlike(ROLE))
    roles = parts.where("is_role").withColumn("run", F.col("n") - F.row_number().over(order))
    runs = roles.groupBy("doc_id", "run").agg(F.count("*").alias("len"), F.min("a").alias("a"), F.max(F.col("a") + F.octet_length("part")).alias("b"))
    best = runs.groupBy("doc_id").agg(F.max_by(F.struct("len", "a", "b"), F.struct("len", -F.col("a"))).alias("r")).select("doc_id", "r.*").where(F.col("len") > most)
    tokens = approx_tokens(F.col("b") - F.col("a"))
    return _finding(best, "verbose-role-description", "low", F.col("a"), F.col("b"), tokens * 5 / 100, tokens * 15 / 100, 0.45)


def markdown_overhead(docs: DataFrame, percent: int = 15) -> DataFrame:
    """Heading marks and the space after them, list marks, every pipe and asterisk, and the syntax of links."""
    text = F.col("text")
    sizes = lambda pattern, group: F.aggregate(F.regexp_extract_all(text, F.lit(pattern), group), F.lit(0), lambda n, x: n + F.octet_length(x))
    heading = r"(?m)^[^\S\n]*(#+)"
    marks = sizes(heading, 1) + F.regexp_count(text, F.lit(heading)) + 2 * F.regexp_count(text, F.lit(r"(?m)^[^\S\n]*[-+] ")) + F.regexp_count(text, F.lit(r"[|*]")) + sizes(LINK, 0) - sizes(LINK, 1)
    rows = docs.where(~text.contains("```") & text.rlike(r"[#|*+\[-]")).withColumn("marks", marks).where(F.col("marks") * 100 > F.col("bytes") * percent)
    return _finding(rows, "markdown-overhead", "low", F.lit(0), F.col("bytes"), F.col("total") * 5 / 100, F.col("total") * 20 / 100, 0.4)


def lost_in_the_middle(docs: DataFrame, least: int = 50_000) -> DataFrame:
    rows = docs.where(F.col("total") > least)
    at = lambda p: F.floor(F.col("bytes") * p / 100).cast("int")
    # down to the start of a character: continuation bytes are 0x80 to 0xBF
    raw = F.encode("text", "UTF-8")
    continues = lambda n: F.substring(F.hex(F.substring(raw, n + 1, F.lit(1))), 1, 1).isin("8", "9", "A", "B")
    floor = lambda n: F.when(~continues(n), n).when(~continues(n - 1), n - 1).when(~continues(n - 2), n - 2).otherwise(n - 3)
    return _finding(rows, "lost-in-the-middle", "low", floor(at(30)), floor(at(70)), F.lit(0), F.lit(0), 0.4)


# Rules that scan in order ------------------------------------------------------------------------------------------


def _mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of the splitmix64 generator, with its increment; on wrapping 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        return x


def _seeds(n: int = 64, state: int = 0x706B656E6C79) -> np.ndarray:
    out, x = [], np.array([state], dtype=np.uint64)
    for _ in range(n):
        x = _mix(x)
        out.append(x[0])
    return np.array(out, dtype=np.uint64)


SEEDS = _seeds()
#: Strings that minhash() mixes with all seeds at a time, few enough for a processor's cache.
BLOCK = 128


def minhash(raw: bytes, width: int = 5) -> np.ndarray:
    """64 least values of seeded hashes (FNV-1a, then mixed) over the strings of width bytes."""
    data = np.frombuffer(raw, dtype=np.uint8).astype(np.uint64)
    grams = [data] if len(data) < width else [data[i : len(data) - width + 1 + i] for i in range(width)]
    with np.errstate(over="ignore"):
        if len(data) < width:
            h = np.array([0xCBF29CE484222325], dtype=np.uint64)
            for byte in data:
                h = (h ^ byte) * np.uint64(0x100000001B3)
        else:
            h = np.full(len(grams[0]), 0xCBF29CE484222325, dtype=np.uint64)
            for g in grams:
                h = (h ^ g) * np.uint64(0x100000001B3)
    h = np.unique(h)
    blocks = (h[at : at + BLOCK] for at in range(0, len(h), BLOCK))
    return reduce(np.minimum, (_mix(block ^ SEEDS[:, None]).min(axis=1) for block in blocks))


def clusters(n: int, near) -> list[list[int]]:
    """Connected groups of two or more of n members, in order of their first member."""
    top = list(range(n))

    def find(i: int) -> int:
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    for i in range(n):
        for j in range(i + 1, n):
            if find(i) != find(j) and near(i, j):
                a, b = sorted((find(i), find(j)))
                top[b] = a
    groups: dict[int, list[int]] = {}
    for i in range(n):
        groups.setdefault(find(i), []).append(i)
    return [g for g in groups.values() if len(g) > 1]


def _tokens(n: int) -> int:
    return -(-n // 4)


def near_duplicate_paragraphs(raw: bytes, least: int = 200, alike: float = 0.7) -> Iterator[tuple]:
    spans = [(m.start(), m.start() + len(m[0].rstrip())) for m in re.finditer(rb"(?:^[^\n]*\S[^\n]*(?:\n|\Z))+", raw, re.M)]
    spans = [s for s in spans if s[1] - s[0] >= least]
    if len(spans) < 2:
        return
    each = [raw[a:b] for a, b in spans]
    sign = {x: minhash(x) for x in set(each)}
    signs = [sign[x] for x in each]
    for group in clusters(len(spans), lambda i, j: np.count_nonzero(signs[i] == signs[j]) / 64 >= alike):
        most = min(_tokens(spans[k][1] - spans[k][0]) for k in group) * (len(group) - 1)
        yield "near-duplicate-paragraphs", "high" if most > 500 else "medium", *spans[group[1]], most // 2, most, 0.85


_JSON = re.compile(rb'"(?:\\.|[^"\\])*"?|[{}\[\]]', re.S)


def _span_end(raw: bytes, start: int) -> int | None:
    """End of the balanced brackets that begin at start; brackets in strings do not count."""
    depth = 0
    for m in _JSON.finditer(raw, start):
        if m[0] in (b"{", b"["):
            depth += 1
        elif m[0] in (b"}", b"]"):
            depth -= 1
            if depth <= 0:
                return m.end()
    return None


def json_blocks(raw: bytes, least: int = 300) -> Iterator[tuple]:
    at = 0
    opens = re.compile(rb"^[^\S\n]*([{\[])", re.M)
    while (m := opens.search(raw, at)) is not None:
        start = m.start(1)
        line = raw.find(b"\n", start)
        at = len(raw) if line < 0 else line + 1
        end = _span_end(raw, start)
        if end is None or end - start <= least:
            continue
        span = raw[start:end]
        text = span.decode(errors="replace")
        small = minified(text)
        if small is not None:
            saved = _tokens(max(0, len(span) - len(small.encode())))
            table = tabular(text)
            if table is not None and (fewer := _tokens(max(0, len(span) - len(table.encode())))):
                yield "json-toon-candidate", "medium", start, end, fewer // 2, fewer, 0.5
            if saved:
                yield "json-verbosity", "high" if saved > 1000 else "medium", start, end, saved, saved, 0.95
            at = end
        else:
            lines = text.split("\n")
            if sum('": ' in x for x in lines) < 3:
                continue
            saved = _tokens(sum(len(x.encode()) - len(x.lstrip().encode()) + 1 for x in lines))
            yield "json-verbosity", "high" if saved > 1000 else "medium", start, end, saved // 2, saved, 0.7
            at = end


def repeated_instructions(raw: bytes, zone: int = 4096, least: int = 40, alike: float = 0.8) -> Iterator[tuple]:
    head = raw[:zone].decode(errors="ignore")
    spans, at = [], 0
    for part in re.split(r"[.\n]", head):
        a = at + len(part.encode()) - len(part.lstrip().encode())
        b = a + len(part.strip().encode())
        at += len(part.encode()) + 1
        if b - a >= least:
            spans.append((a, b, frozenset(part.lower().split())))
    near = lambda i, j: len(spans[i][2] & spans[j][2]) / max(1, len(spans[i][2] | spans[j][2])) >= alike
    for group in clusters(len(spans), near):
        extra = sum(_tokens(spans[k][1] - spans[k][0]) for k in group[1:])
        yield "repeated-instructions", "medium", *spans[group[1]][:2], extra // 2, extra, 0.6


def few_shot(raw: bytes, most: int = 5) -> Iterator[tuple]:
    text = raw.decode(errors="replace")
    starts = [m.start() for m in re.finditer(EXAMPLE, text)]
    if len(starts) <= most:
        return
    last = [m.end() for m in re.finditer(MARKER, text)][-1]
    end = text.find("\n", last)
    a, b = (len(text[:n].encode()) for n in (starts[most], len(text) if end < 0 else end))
    if b > a:
        yield "excessive-few-shot", "medium", a, b, _tokens(b - a) // 2, _tokens(b - a), 0.55


SCANS = (near_duplicate_paragraphs, json_blocks, repeated_instructions, few_shot)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
    for batch in batches:
        rows = [(i, *found) for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for rule in SCANS for found in rule(text.encode())]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=NAMES)


def scanning_rules(docs: DataFrame) -> DataFrame:
    """Findings of the rules that scan; texts with no blank line, bracket, sentence pair or example are left out first."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_scan, SCHEMA)


RULES = (stack_traces, volatile_prefix, sub_cache_threshold, html_content, filler_phrases, role_description, markdown_overhead, lost_in_the_middle)
EXPERIMENTAL = ("json-toon-candidate", "filler-phrases", "repeated-instructions", "verbose-role-description", "excessive-few-shot", "markdown-overhead", "lost-in-the-middle")
RANK = {"high": 0, "medium": 1, "low": 2}


def rank(severity: Column) -> Column:
    out = F.lit(3)
    for name, n in RANK.items():
        out = F.when(severity == name, n).otherwise(out)
    return out


def audit(docs: DataFrame, experimental: bool = True, least: str = "low", rule: str | None = None) -> DataFrame:
    """All findings at or above a severity, of one rule or all."""
    rows = prepared(docs)
    found = reduce(DataFrame.unionByName, [f(rows) for f in RULES], scanning_rules(rows))
    if not experimental:
        found = found.where(~F.col("rule").isin(*EXPERIMENTAL))
    found = found.where(rank(F.col("severity")) <= RANK[least])
    return found if rule is None else found.where(F.col("rule") == rule)


#: The order in which a text's findings are made, which breaks ties of severity and savings.
EMITTED = (
    "near-duplicate-paragraphs",
    "json-verbosity",
    "json-toon-candidate",
    "stack-trace-verbosity",
    "volatile-prefix",
    "sub-cache-threshold",
    "html-content",
    "filler-phrases",
    "repeated-instructions",
    "verbose-role-description",
    "excessive-few-shot",
    "markdown-overhead",
    "lost-in-the-middle",
)


def ordered(findings: DataFrame) -> DataFrame:
    """Findings with their place in their text's report: severity, then most savings, then as they are made."""
    made = F.array_position(F.array(*map(F.lit, EMITTED)), F.col("rule"))
    order = Window.partitionBy("doc_id").orderBy(rank(F.col("severity")), F.col("savings_max").desc(), made, "byte_start", "byte_end")  # one text's findings
    return findings.withColumn("place", F.row_number().over(order))


def notes(docs: DataFrame, findings: DataFrame) -> DataFrame:
    """(doc_id, notes) of prepared docs: savings are estimates; tokens were not given; some findings are experimental."""
    tried = findings.where(F.col("rule").isin(*EXPERIMENTAL)).select("doc_id").distinct().withColumn("tried", F.lit(True))
    lines = F.array_compact(F.array(F.lit("estimates"), F.when(~F.col("supplied"), "bytes-per-token"), F.when(F.col("tried"), "experimental")))
    return docs.join(tried, "doc_id", "left").select("doc_id", lines.alias("notes"))


def ranked_rules(findings: DataFrame) -> DataFrame:
    """The roll-up by rule with its place: most savings first, then by name."""
    order = Window.orderBy(F.col("savings_max").desc(), "rule")  # one row a rule
    return rules_rollup(findings).withColumn("place", F.row_number().over(order))


def report(findings: DataFrame) -> DataFrame:
    """Per text: findings, savings, the worst severity, and whether a gate at high severity fails."""
    return findings.groupBy("doc_id").agg(F.count("*").alias("findings"), F.sum("savings_min").alias("savings_min"), F.sum("savings_max").alias("savings_max"), F.min(rank(F.col("severity"))).alias("worst"), F.bool_or(F.col("severity") == "high").alias("fails_high"))


def rules_rollup(findings: DataFrame) -> DataFrame:
    return findings.groupBy("rule").agg(F.count("*").alias("findings"), F.sum("savings_min").alias("savings_min"), F.sum("savings_max").alias("savings_max"))
