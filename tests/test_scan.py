"""The machine scan, reports and token counts, on small input."""

import os

import pytest
from pyspark.sql import functions as F

from sparkmeter.functions import tokens
from sparkmeter.operators import mcp as C
from sparkmeter.operators import project as P
from sparkmeter.operators import reports as W
from sparkmeter.operators import scan as N

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"


def test_locations_follow_the_system(spark):
    paths = lambda system: {r.path for r in N.locations(spark, "/h", "/c", "/w", system).collect()}
    assert "/h/.config/zed/settings.json" in paths("macos") and "/c/Zed/settings.json" in paths("windows")
    assert len(paths("linux")) == 16 and "/c/Zed/settings.json" not in paths("linux")


def test_secrets_of_shells_leave_no_values(spark):
    key = "0123456789abcdef" * 2 + "01234567"
    files = spark.createDataFrame([("/h/.zshrc", f"export TOKEN={key}"), ("/h/.bashrc", "alias a=b"), ("/h/x.txt", f"token {key}")], "path string, text string")
    rows = N.shells(files).collect()
    assert [tuple(r) for r in rows] == [("/h/.zshrc", 1, "high-entropy")] and key not in str(rows)


def test_empty_files(spark):
    none = spark.createDataFrame([], "path string, text string")
    assert N.report(none, N.locations(spark, "/h", "/c", "/w", "linux")).count() == 0
    assert P.entries(none).count() == 0 and C.servers(none).count() == 0


def test_unknown_inventory_is_an_error_of_the_caller(spark):
    rows = spark.createDataFrame([("a",), ("b",)], "name string")
    assert [r.name for r in C.not_configured(spark.createDataFrame([("b",), ("z",)], "name string"), rows).collect()] == ["z"]


def test_numbers_and_ages(spark):
    row = spark.range(1).select(W.usd(F.lit(0.0)), W.usd(F.lit(0.00123)), W.usd(F.lit(0.5)), W.usd(F.lit(12.345)), W.humanized(F.lit(340_000_000_000)), W.humanized(F.lit(950)), W.age(F.lit(10), F.lit(99)), W.age(F.lit(10**9), F.lit(0)), W.escaped(F.lit("<a&'b\">"))).first()
    assert tuple(row) == ("$0", "$0.00123", "$0.500", "$12.35", "340B", "950", "now", "999d+", "&lt;a&amp;&#39;b&quot;&gt;")


def test_reports(spark):
    base = spark.createDataFrame([("always_tokens", 1000), ("context_tokens", 0)], "metric string, value long")
    head = spark.createDataFrame([("always_tokens", 1500), ("context_tokens", 9)], "metric string, value long")
    text = W.delta_markdown(P.delta(base, head, 400, 10.0))
    assert "| always_tokens | 1,000 | 1,500 | +500 | +50.0% |" in text and "| context_tokens | 0 | 9 | +9 | n/a |" in text
    assert "<td>&lt;b&gt;</td>" in W.html_table(spark.createDataFrame([("<b>",)], "x string"), "t")


def test_token_counts(spark):
    docs = spark.createDataFrame([(1, "héllo wörld"), (2, ""), (3, None)], "doc_id long, text string")
    assert [r.tokens for r in tokens.counted(docs).orderBy("doc_id").collect()] == [4, 0, 0]
    if not os.path.exists(VOCABULARY):
        pytest.skip("no vocabulary here")
    assert [r.tokens for r in tokens.counted(docs, VOCABULARY).orderBy("doc_id").collect()][1:] == [0, 0]
    cut = tokens.segments(docs, VOCABULARY).where("doc_id = 1").first().segments
    assert cut[0].byte_start == 0 and cut[-1].byte_end == len("héllo wörld".encode())
