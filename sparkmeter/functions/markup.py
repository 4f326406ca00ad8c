"""Conversions of text: HTML to Markdown, JSON minifying, tabular JSON, comments in JSON, exact dedup of paragraphs and dumps."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PREVIEW = 8192
# Rewrites in their order; entities, the ampersand last.
TAGS: tuple[tuple[str, str], ...] = (
    (r"(?is)<script\b[^>]*>.*?</script\s*>", ""),
    (r"(?is)<style\b[^>]*>.*?</style\s*>", ""),
    *((rf"(?i)<h{n}\b[^>]*>", "\n" + "#" * n + " ") for n in range(1, 7)),
    (r"(?i)</h[1-6]\s*>", "\n"),
    (r"(?i)<li\b[^>]*>", "\n- "),
    (r"(?i)</li\s*>", ""),
    (r"(?i)</?(?:p|div)\b[^>]*>|<br\s*/?>", "\n"),
    (r"""(?is)<a\b[^>]*\bhref\s*=\s*["']?([^"'\s>]+)["']?[^>]*>(.*?)</a\s*>""", "[$2]($1)"),
    (r"(?i)</?(?:strong|b)\b[^>]*>", "**"),
    (r"(?i)</?(?:em|i)\b[^>]*>", "*"),
    (r"(?s)</?[A-Za-z][^>]*>", ""),
)
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&"))


def html_to_markdown(text: Column) -> Column:
    for pattern, by in TAGS:
        text = F.regexp_replace(text, pattern, by)
    for entity, by in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(by))
    return F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def html_to_markdown_sql(text: str) -> str:
    for pattern, by in TAGS:
        by = re.sub(r"\$(\d)", r"\\\1", by)
        text = f"regexp_replace({text}, '{pattern.replace(chr(39), chr(39) * 2)}', '{by}', 'g')"
    for entity, by in ENTITIES:
        text = f"replace({text}, '{entity}', '{by}')"
    return f"regexp_replace(regexp_replace({text}, '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')"


def minified(text: str) -> str | None:
    """Compact JSON with sorted keys, or nothing if the text is no strict JSON."""
    try:
        return json.dumps(json.loads(text, parse_constant=_no_constant), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    except ValueError:
        return None


def _no_constant(name: str) -> None:
    raise ValueError(name)


def tabular(text: str, least: int = 3) -> str | None:
    """An array of at least so many flat objects with one set of keys, as a header and one row each; else nothing."""
    try:
        rows = json.loads(text, parse_constant=_no_constant)
    except ValueError:
        return None
    if not isinstance(rows, list) or len(rows) < least or not all(isinstance(r, dict) for r in rows) or not rows[0]:
        return None
    keys = sorted(rows[0])
    if any(sorted(r) != keys or any(isinstance(v, (dict, list)) for v in r.values()) for r in rows):
        return None

    def cell(v: object) -> str:
        if isinstance(v, str):
            return f'"{v}"' if "," in v else v
        return json.dumps(v)

    lines = ["  " + ",".join(cell(r[k]) for k in keys) for r in rows]
    return f"items[{len(rows)}]{{{','.join(keys)}}}:\n" + "".join(line + "\n" for line in lines)


def without_comments(text: str) -> str:
    """JSON from JSON with comments and trailing commas; strings are left alone."""
    token = re.compile(r'"(?:\\.|[^"\\])*"|//[^\n]*|/\*.*?(?:\*/|\Z)', re.S)
    plain = token.sub(lambda m: m[0] if m[0].startswith('"') else "", text)
    comma = re.compile(r'"(?:\\.|[^"\\])*"|,(?=\s*[}\]])', re.S)
    return comma.sub(lambda m: m[0] if m[0].startswith('"') else "", plain)


def preview(text: str) -> str:
    """The first PREVIEW bytes, whole characters only, with a mark if more follows."""
    raw = text.encode()
    return text if len(raw) <= PREVIEW else raw[:PREVIEW].decode(errors="ignore") + "\n... (truncated)"


def unique_paragraphs(text: Column) -> Column:
    """Each paragraph once, where it first stands."""
    return F.array_join(F.array_distinct(F.split(text, r"\n{2,}")), "\n\n")


def unique_dumps(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with the bodies of repeated dumps replaced by a mark; a dump begins at a line '<ISO time>Z ERROR ...'."""
    head = r"^\d{4}-\d{2}-\d{2}T[^ ]*Z ERROR"
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    order = Window.partitionBy("doc_id").orderBy("pos")
    lines = lines.withColumn("dump", F.sum(F.col("line").rlike(head).cast("int")).over(order)).withColumn("is_head", F.col("line").rlike(head))
    dumps = lines.groupBy("doc_id", "dump").agg(F.sort_array(F.collect_list(F.struct("pos", "is_head", "line"))).alias("rows"))  # lines of one text
    body = F.array_join(F.transform(F.filter("rows", lambda r: ~r["is_head"]), lambda r: r["line"]), "\n")
    first = F.first("dump").over(Window.partitionBy("doc_id", "body").orderBy("dump"))
    dumps = dumps.withColumn("body", body).withColumn("first", first)
    again = (F.col("dump") > F.col("first")) & (F.col("dump") > 0) & (F.trim("body") != "")
    whole = F.array_join(F.transform("rows", lambda r: r["line"]), "\n")
    heads = F.array_join(F.transform(F.filter("rows", lambda r: r["is_head"]), lambda r: r["line"]), "\n")
    dumps = dumps.withColumn("shown", F.when(again, F.concat(heads, F.lit("\n[same stack as dump "), F.col("first"), F.lit("]"))).otherwise(whole))
    texts = dumps.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("dump", "shown"))).alias("all"))
    return texts.select("doc_id", F.array_join(F.transform("all", lambda r: r["shown"]), "\n").alias("text"))
