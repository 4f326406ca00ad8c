"""Readers of logs and files, on small trees written here."""

import io
import json
import zipfile

from pyspark.sql import functions as F

from sparkmeter.functions.scalars import iso_seconds
from sparkmeter.operators import usage as U
from sparkmeter.sources import logs as L


def record(mid, rid, ts, out, cwd="/work/a", model="claude-sonnet-4-6", **usage):
    return json.dumps({"requestId": rid, "timestamp": ts, "cwd": cwd, "message": {"id": mid, "model": model, "usage": {"input_tokens": 5, "output_tokens": out, **usage}}})


def tree(root):
    a = root / "slug"
    (a / "s1" / "subagents").mkdir(parents=True)
    main = [
        '{"type": "meta"}',
        record("m1", "r1", "2026-06-10T12:00:00Z", 50),
        record("m1", "r1", "2026-06-10T12:00:00.250Z", 180),
        record("m1", "r1", "2026-06-10T12:00:01Z", 300, cache_creation_input_tokens=99, cache_creation={"ephemeral_5m_input_tokens": 40, "ephemeral_1h_input_tokens": 60}),
        "",
        record("m2", "r2", "2026-06-10T12:10:00Z", 25, cwd="/work/b", cache_creation_input_tokens=30, cache_read_input_tokens=7),
        record("m3", "r3", "2026-06-10T12:10:00Z", 1, model="<synthetic>"),
        "{broken",
        record("m4", "r4", "2026-06-10 12:00:00", 1),
    ]
    (a / "s1.jsonl").write_text("\n".join(main) + "\n")
    (a / "s1" / "subagents" / "agent-x.jsonl").write_text(record("m5", "r5", "2026-06-10T13:00:00Z", 9) + "\n")
    (a / "s1" / "subagents" / "agent-x.meta.json").write_text("{}")
    (a / "s2.jsonl").write_text(record("m2", "r2", "2026-06-10T12:10:00Z", 24, cwd="/work/b") + "\n")


def test_session_logs(spark, tmp_path):
    tree(tmp_path)
    files = L.whole_texts(spark, str(tmp_path))
    rows = {r.output: r for r in L.session_requests(files).collect()}
    assert set(rows) == {300, 25, 9}
    assert (rows[300].w5, rows[300].w1, rows[300].input, rows[300].ts) == (40, 60, 5, 1781092801)
    assert (rows[25].w5, rows[25].w1, rows[25].cache_read, rows[25].project_key) == (30, 0, 7, "/work/b")
    assert rows[9].is_subagent and rows[9].parent_session_id == "s1" and rows[9].session_id == "agent-x"
    metrics = L.ingest_metrics(files).first()
    assert (metrics.skipped_lines, metrics.files) == (2, 3)
    assert U.sessions(L.session_requests(files)).count() == 3
    assert L.parents(L.session_requests(files)).first().streams == 1


def test_rollup_parses_each_line_once(spark, tmp_path):
    """A filter on what is read from the lines had the parser in it, again for each use of a field."""
    tree(tmp_path)
    requests = L.session_requests(L.whole_texts(spark, str(tmp_path)))
    for df in (U.sessions(requests), L.parents(requests)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("parseJson(") == 1


def test_odd_records(spark):
    """Each line lacks something or has it as another type; only the last two are records."""
    whole = json.loads(record("m", "r", "2026-06-10T12:00:00Z", 1))
    odd = [whole | {"requestId": 3}, whole | {"cwd": None}, whole | {"message": [1]}, whole | {"message": whole["message"] | {"usage": "x"}}, whole | {"message": whole["message"] | {"id": {"a": 1}}}, [1], "s", None]
    good = [record("m1", "r", "2026-06-10T12:00:00Z", "7", cache_creation=[1], cache_creation_input_tokens=-4), record("m2", "r", "2026-06-10T12:00:00Z", 2, cache_creation={}, cache_creation_input_tokens=9)]
    files = spark.createDataFrame([("f", "\n".join([*map(json.dumps, odd), *good])), ("none", None)], "file string, text string")
    rows = L.session_lines(files).collect()
    assert len(rows) == len(odd) + 2 and not any(r.skipped for r in rows)
    assert [(r.message_id, r.input, r.output, r.w5, r.w1) for r in rows if r.is_usage] == [("m1", 5, 7, 0, 0), ("m2", 5, 2, 0, 0)]


def test_copied_file_changes_nothing(spark, tmp_path):
    tree(tmp_path)
    before = U.cost_by_model(L.session_requests(L.whole_texts(spark, str(tmp_path))), __import__("sparkmeter.functions.models", fromlist=["x"]).prices(spark)).collect()
    (tmp_path / "slug" / "z-copy.jsonl").write_text((tmp_path / "slug" / "s1.jsonl").read_text())
    after = U.cost_by_model(L.session_requests(L.whole_texts(spark, str(tmp_path))), __import__("sparkmeter.functions.models", fromlist=["x"]).prices(spark)).collect()
    assert before == after


def test_changed_files(spark, tmp_path):
    tree(tmp_path)
    stamps = L.file_stamps(spark, str(tmp_path))
    cached = spark.createDataFrame(stamps.limit(2).collect(), stamps.schema)
    assert L.changed(stamps, cached).count() == 1


def test_winner_takes_the_first_path_by_components(spark):
    rows = spark.createDataFrame([("m", "r", "p-b/x", 1, 5, 7), ("m", "r", "p/b", 1, 5, 7)], "message_id string, request_id string, file string, line_no int, ts int, output int")
    assert U.winners(rows).first().file == "p/b"


def test_rollout_logs(spark, tmp_path):
    day = tmp_path / "2026" / "06" / "10"
    day.mkdir(parents=True)
    use = lambda i, c, o: {"type": "event_msg", "timestamp": "2026-06-10T12:00:00Z", "payload": {"type": "token_count", "info": {"last_token_usage": {"input_tokens": i, "cached_input_tokens": c, "output_tokens": o}}}}
    rows = [{"type": "session_meta", "payload": {"cwd": "/work/c", "id": "feed"}}, {"type": "turn_context", "payload": {"model": "gpt-5.5"}}, {"type": "event_msg", "payload": {"type": "token_count", "info": None}}, use(200, 140, 30), use(100, 70, 20)]
    (day / "rollout-2026-06-10-feed.jsonl").write_text("\n".join(map(json.dumps, rows)))
    (day / "rollout-2026-06-10-lost.jsonl").write_text(json.dumps(use(1, 0, 1)))
    files = L.whole_texts(spark, str(tmp_path), "rollout-*.jsonl")
    got = L.rollout_requests(files).groupBy("session_id", "model", "project_key").agg(F.sum("input").alias("i"), F.sum("cache_read").alias("r"), F.sum("output").alias("o")).collect()
    assert [tuple(r) for r in got] == [("feed", "gpt-5.5", "/work/c", 90, 210, 50)]
    assert L.skipped_rollouts(files).count() == 1


def test_ledger_reads_and_appends(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1000, "project", "p")], "v int, ts long, command string, project_key string").withColumn("headline", F.struct(F.lit(10_000).alias("always_tokens")))
    L.append_ledger(rows, str(tmp_path / "ledger"))
    L.append_ledger(rows, str(tmp_path / "ledger"))
    got = L.ledger(L.whole_texts(spark, str(tmp_path / "ledger"), "*.json")).collect()
    assert [(r.ts, r.command, r.always_tokens) for r in got] == [(1000, "project", 10_000)] * 2


def test_iso_times(spark):
    cases = ["2026-06-10T16:25:11Z", "2026-06-10T16:25:11.123Z", "2026-02-30T00:00:00Z", "", "nope", "2026-06-10 16:25:11Z", "2026-06-10T16:25:11+00:00", "2026-13-01T00:00:00Z", "1969-12-31T23:59:59Z"]
    got = [r[0] for r in spark.createDataFrame([(c,) for c in cases], "t string").select(iso_seconds(F.col("t"))).collect()]
    assert got == [1781108711, 1781108711, 1772409600, None, None, None, None, None, None]


def test_iso_times_match_the_shape_once(spark):
    rows = spark.createDataFrame([("1969-12-31T23:59:60Z",), ("1969-12-31T23:59:59Z",), ("0000-01-01T00:00:00Z",), ("2026-06-10T24:00:00Z",), (None,)], "t string").select(iso_seconds(F.col("t")).alias("s"))
    assert [r.s for r in rows.collect()] == [0, None, None, None, None]
    assert rows._jdf.queryExecution().optimizedPlan().toString().upper().count("RLIKE") + rows._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract") == 1


def test_workflows_and_hooks(spark):
    text = "jobs:\n  a:\n    steps:\n      - uses: anthropics/claude-code-action@v1\n        with:\n          prompt: Do it\n          system_prompt: |\n            One.\n            Two.\n      - uses: actions/checkout@v4\n        with:\n          prompt: no\n"
    assert L.workflow_prompts(text) == [("prompt", "Do it"), ("system_prompt", "One.\nTwo.")]
    assert L.workflows(spark.createDataFrame([("w.yml", text), ("x.yml", "prompt: no")], "path string, text string")).count() == 2
    rows = spark.createDataFrame([("s", '{"hooks": {"Stop": [], "PreToolUse": []}}'), ("bad", "{"), ("none", "{}")], "path string, text string")
    assert [tuple(r) for r in L.hooks(rows).collect()] == [("s", "PreToolUse,Stop")]


def test_office_and_other_texts(spark, tmp_path):
    def packed(files):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, body in files.items():
                z.writestr(name, body)
        return out.getvalue()

    docx = packed({"word/document.xml": '<w:document xmlns:w="u"><w:p><w:r><w:t>One</w:t></w:r><w:r><w:t> two</w:t></w:r></w:p><w:p><w:r><w:t>Three</w:t></w:r></w:p></w:document>'})
    xlsx = packed({"xl/workbook.xml": "<x/>", "xl/sharedStrings.xml": "<sst><si><t>name</t></si></sst>", "xl/worksheets/sheet1.xml": '<w><row><c t="s"><v>0</v></c><c><v>7</v></c></row></w>'})
    (tmp_path / "a.docx").write_bytes(docx)
    (tmp_path / "b.bin").write_bytes(xlsx)
    (tmp_path / "c.md").write_text("é")
    (tmp_path / "d.bin").write_bytes(b"\xff\xfe\x00")
    got = {r.path[-5:]: r.text for r in L.texts(spark, str(tmp_path)).collect()}
    assert got == {".docx": "One two\nThree\n", "b.bin": "name\t7", "/c.md": "é", "d.bin": None}


def test_ignore_lines(spark):
    files = spark.createDataFrame([(p,) for p in ("a.md", "build/x.md", "src/build/y.md", "node_modules/z.md", "log/a.log", "keep/a.txt", "docs/t.tmp")], "path string")
    got = sorted(r.path for r in L.repository(files, ["# note", "build/", "*.log", "/docs/*.tmp"]).collect())
    assert got == ["a.md", "keep/a.txt"]


def test_toml(tmp_path):
    assert L.toml_servers('[mcp_servers.a]\ncommand = "x"\n') == {"mcpServers": {"a": {"command": "x"}}}
    (tmp_path / "c.toml").write_text("monthly_cap_usd = 20.0\n")
    assert L.config(str(tmp_path / "c.toml")) == {"monthly_cap_usd": 20.0} and L.config(str(tmp_path / "no")) == {}
