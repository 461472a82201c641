"""Files in and out, and streams: restart, late rows, timeouts, bytes in pieces."""

import datetime as dt

from pyspark.sql import functions as F

from maskmill.functions.rules import PLACEHOLDER
from maskmill.operators import text
from maskmill.sources import tables
from maskmill.streaming import redaction

SECRET = "sk-ant-" + "a1" * 12


def test_rules_files_of_both_kinds(spark, tmp_path):
    (tmp_path / "r.yaml").write_text('rules:\n  - type: exact\n    value: "abcd1234"\n    name: tail\n  - type: regex\n    value: n[0-9]+\n')
    (tmp_path / "r.jsonl").write_text('{"type":"exact","value":"abcd1234","name":"tail"}\n{"type":"regex","value":"n[0-9]+"}\n')
    (tmp_path / "r.json").write_text('[{"type":"exact","value":"abcd1234","name":"tail"},{"type":"regex","value":"n[0-9]+"}]')
    for name in ("r.yaml", "r.jsonl", "r.json"):
        rows = [(r["type"], r["value"], r["name"]) for r in tables.load_rules(spark, str(tmp_path / name)).orderBy("ord").collect()]
        assert rows == [("exact", "abcd1234", "tail"), ("regex", "n[0-9]+", None)], name
    policy = tables.policy_of(tables.load_rules(spark, str(tmp_path / "r.yaml")))
    assert [r.name for r in policy.rules] == ["tail", "regex_1"]


def test_written_tables_and_audit_lines(spark, tmp_path):
    df = spark.createDataFrame([(f"x {SECRET}", "/p"), ("plain", "/q")], "text string, path string")
    scanned = text.scan_text(df)
    tables.write_redacted(scanned.select("text"), str(tmp_path / "out"))
    assert sorted(r["text"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["plain", f"x {PLACEHOLDER}"]
    for _ in range(2):  # audit lines are appended
        tables.write_audit(text.audit_events(scanned), str(tmp_path / "audit"))
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "audit")).collect()]
    assert len(lines) == 2 and all('"path":"/p"' in x and SECRET not in x for x in lines)


def _step(spark, rows, schema, folder, name, build, mode="append"):
    """One more file of input, and what the restarted query gives for it."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder / "in"))
    stream = spark.readStream.schema(schema).parquet(str(folder / "in"))
    writer = build(stream).writeStream.format("parquet").outputMode(mode).option("checkpointLocation", str(folder / f"{name}-checkpoint")).option("path", str(folder / name))
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(str(folder / name))


def _at(minute):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)


def test_a_restarted_stream_gives_each_row_once(spark, tmp_path):
    for i in range(3):
        out = _step(spark, [(i, f"k {SECRET}")], "id int, text string", tmp_path, "out", redaction.stream_redact)
    assert sorted(r["id"] for r in out.collect()) == [0, 1, 2] and {r["text"] for r in out.collect()} == {f"k {PLACEHOLDER}"}


def test_rows_later_than_the_watermark_are_dropped(spark, tmp_path):
    schema, build = "ts timestamp, path string, text string", redaction.stream_audit
    _step(spark, [(_at(0), "/p", SECRET), (_at(5), "/p", SECRET)], schema, tmp_path, "out", build)
    _step(spark, [(_at(300), "/p", SECRET)], schema, tmp_path, "out", build)
    _step(spark, [(_at(1), "/p", SECRET), (_at(295), "/p", SECRET)], schema, tmp_path, "out", build)  # the first is hours late
    out = _step(spark, [(_at(900), "/p", SECRET)], schema, tmp_path, "out", build)
    assert sorted(r["hits"] for r in out.collect()) == [1, 1, 2]


def test_responses_are_put_together_or_time_out(spark, tmp_path):
    schema = "response_id long, seq long, chunk binary, ts timestamp"
    event = lambda s: f'data: {{"choices":[{{"delta":{{"content":"{s}"}}}}]}}\r\n\r\n'.encode()
    build = redaction.stream_assemble
    _step(spark, [(1, 1, event("b"), _at(0)), (2, 0, event("é")[:-6], _at(0))], schema, tmp_path, "out", build)
    _step(spark, [(1, 0, event("a"), _at(0)), (1, 2, b"data: [DONE]\n\n", _at(0))], schema, tmp_path, "out", build)
    _step(spark, [(3, 0, event("x"), _at(60))], schema, tmp_path, "out", build)
    out = _step(spark, [(3, 1, b"data: [DONE]\n\n", _at(120))], schema, tmp_path, "out", build)
    got = {r["response_id"]: (r["text"], r["complete"]) for r in out.collect()}
    assert got[1] == ("ab", True) and got[3] == ("x", True) and got[2][1] is False


def test_tables_in_folders_stream_too(spark, tmp_path):
    from maskmill.plans import catalogue

    turns = spark.createDataFrame([(c, t, "user", "x") for c in range(6) for t in range(3)], "conv_id long, turn long, role string, text string")
    turns.repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    assert catalogue.m4_stream_assemble(spark, str(tmp_path)).where("complete AND length(text) = 24").count() == 6
    (part,) = turns.coalesce(1).write.parquet(str(tmp_path / "one")) or (tmp_path / "one").glob("part-*.parquet")
    (tmp_path / "file").mkdir()
    (tmp_path / "file" / "conversations.parquet").write_bytes(part.read_bytes())
    assert catalogue.m4_stream_assemble(spark, str(tmp_path / "file")).where("complete AND length(text) = 24").count() == 6


def test_streamed_answers_need_no_whole_count_of_turns(spark, tmp_path):
    """Turns that are missing, or come twice, in a table of several files."""
    from maskmill.plans import catalogue

    turns = spark.createDataFrame([(1, t) for t in (0, 1, 3, 6)] + [(2, t) for t in (4, 4, 7, 9)], "conv_id long, turn long").withColumns({"role": F.lit("user"), "text": F.lit("x")})
    turns.repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r["response_id"]: r for r in catalogue.m4_stream_tool_answers(spark, str(tmp_path)).collect()}
    assert all(r["complete"] for r in got.values()) and {k: (r["text"], r["total_tokens"]) for k, r in got.items()} == {1: ("t0 t6 ", 8), 2: ("t4 t4 ", 11)}
    whole = {r["id"]: r["tool_calls"] for r in catalogue.m3_tool_answers(spark, str(tmp_path)).collect()}
    assert {k: r["tool_calls"] for k, r in got.items()} == whole


def test_a_tasks_share_stays_the_same_as_tables_grow(spark, tmp_path):
    from maskmill.sources import derived

    rows = spark.range(9 * tables.TASK_ROWS).select(F.col("id").alias("o_orderkey"), F.timestamp_seconds("id").alias("o_orderdate"))
    assert tables.spread(rows).rdd.getNumPartitions() == tables.spread(rows, "o_orderkey").rdd.getNumPartitions() == 9
    rows.coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    for name in ("seeded", "request_log"):
        log = derived.view(spark, str(tmp_path), name)
        assert log._jdf.queryExecution().executedPlan().toString().count("Exchange hash") <= 2  # the join uses the tables' own
        assert log.rdd.getNumPartitions() == 9 and log.count() == rows.count()


def test_documents_are_dealt_once_whatever_they_are_joined_with(spark, tmp_path):
    """Texts moved once more for the join where the tables were large, and not at all where they were small (F16)."""
    from maskmill.sources import derived

    spark.range(100).select(F.col("id").alias("o_orderkey")).write.parquet(str(tmp_path / "orders.parquet"))
    spark.range(200).selectExpr("id AS doc_id", "'x' AS text", "'en' AS lang", "'s' AS source").write.parquet(str(tmp_path / "documents.parquet"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for limit in ("-1", "10m"):  # as for large tables, and for small ones
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
            docs = derived.view(spark, str(tmp_path), "seeded_docs").select("doc_id", "text")
            plan = docs._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange hash") == 2 and "RoundRobin" not in plan, plan
            assert docs.count() == 200 and docs.where("text LIKE '%note%'").count() == 100
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_the_shared_folder_is_the_sessions(spark):
    assert tables.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    assert spark.range(3).where(F.lit(True)).count() == 3
