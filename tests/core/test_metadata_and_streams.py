"""Job metadata, small functions, streams and control."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from textloom import schema
from textloom.functions import text
from textloom.jsstr import is_blank, trim, utf16_length
from textloom.operators import metadata, rebuild
from textloom.operators.translate import glossary_lines
from textloom.streaming import Cancelled, JobControl, progress_by_window, ring_buffers, running_progress


def _one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_strings(spark):
    assert _one(spark, trim(F.lit("  ﻿\t x  \n"))) == "x" and _one(spark, is_blank(F.lit("　\r\n")))
    assert _one(spark, utf16_length(F.lit("a😀"))) == 3


@pytest.mark.parametrize(("size", "want"), [(0, "0 B"), (1023, "1023 B"), (1536, "1.5 KB"), (5 * 1024 * 1024, "5.00 MB")])
def test_file_size(spark, size, want):
    assert _one(spark, text.format_file_size(F.lit(size))) == want


def test_small_functions(spark):
    assert _one(spark, text.join_path(F.lit("OEBPS"), F.lit("../a/./b"))) == "a/b" and _one(spark, text.join_path(F.lit(""), F.lit("x/../y"))) == "x/../y"
    assert _one(spark, text.parent_path(F.lit("a/b/c"))) == "a/b" and _one(spark, text.parent_path(F.lit("c"))) == ""
    assert _one(spark, text.normalize_key(F.lit("//a/b"))) == "a/b"
    assert _one(spark, text.output_name(F.lit("a.b.json"), F.lit("ar"))) == "a.b_ar.json"
    assert _one(spark, text.compact_text(F.lit("  a \n b  c"), 3)) == "a b…"
    assert _one(spark, text.clip(F.lit("abcd"), 2)) == "ab...[truncated]"
    assert _one(spark, text.mask_sensitive(F.lit("apiToken"), F.lit("x"))) == "[REDACTED]"
    assert _one(spark, text.progress_percent(F.lit(0), F.lit(0))) == 100 and _one(spark, text.progress_percent(F.lit(1), F.lit(4))) == 25
    platforms = F.array(F.lit("X"), F.lit("REGISTERED_PLATFORM_GITHUB"), F.lit("REGISTERED_PLATFORM_AZURE"))
    assert _one(spark, text.login_method(platforms, F.lit(None).cast("string"))) == "microsoft" and _one(spark, text.login_method(platforms, F.lit("sso"))) == "sso"
    assert _one(spark, text.login_method(F.array(F.lit("Other")), F.lit(""))) == "other"
    name = _one(spark, rebuild.stored_name(F.lit("/u/a.txt")))
    assert name.startswith("u/a_") and name.endswith(".txt") and len(name) == len("u/a_.txt") + 8
    assert _one(spark, metadata.media_type(F.lit("x.MD"))) == "text/markdown" and _one(spark, metadata.media_type(F.lit("x.bin"))) == "application/octet-stream"
    assert _one(spark, metadata.media_type_of(F.lit("json_game"))) == "application/json"


def _jobs(spark):
    rows = [(1, 7, 10, "en", "ar", "completed", 3), (2, 7, 10, "fr", "ja", "failed", 5), (3, 8, 11, "en", "ja", "processing", 5), (4, 7, 10, "xx", "ar", "paused", 5)]
    return spark.createDataFrame(rows, "id long, user_id long, uploaded_file_id long, source_language string, target_language string, status string, created_at long")


def test_history(spark):
    jobs = _jobs(spark)
    assert [r.id for r in metadata.history(jobs, 7).collect()] == [4, 2, 1]
    assert sorted(r.id for r in metadata.search_history(jobs, "日本").collect()) == [2, 3]
    assert [r.id for r in metadata.search_history(jobs, "JAPAN", "failed").collect()] == [2] and metadata.search_history(jobs).count() == 4
    assert metadata.in_progress(jobs, 10).first().id == 4
    assert metadata.status_counts(jobs).first().asDict() == {"total": 4, "pending": 0, "processing": 1, "completed": 1, "failed": 1, "paused": 1}
    asked = spark.createDataFrame([(1, 7), (1, 8), (99, 7)], "id long, user_id long")
    assert [r.allowed for r in metadata.may_access(jobs, asked).orderBy("id", "user_id").collect()] == [True, False, False]
    assert metadata.pick_language(spark, "arab").first().code == "ar" and schema.languages(spark).count() == 31


def test_glossary(spark):
    rows = [(1, 7, "a", "A", None, None, ""), (2, 7, "b", "B", "n", "en", "ar"), (3, 7, "c", "C", None, "fr", None), (4, 8, "d", "", None, "en", "ar")]
    terms = spark.createDataFrame(rows, "id long, user_id long, term string, translation string, notes string, source_language string, target_language string")
    assert sorted(r.id for r in metadata.scoped_glossary(terms, "en", "ar").collect()) == [1, 2, 4]
    assert sorted((r.job_id, r.id) for r in metadata.glossary_for_jobs(_jobs(spark), terms).collect()) == [(1, 1), (1, 2), (2, 1), (2, 3), (4, 1)]
    assert glossary_lines(terms).first().prompt_lines == '- "a" -> "A"\n- "b" -> "B" (n)\n- "c" -> "C"'
    assert [r.id for r in metadata.search_glossary(terms, " B ").collect()] == [2] and metadata.search_glossary(terms, " ").count() == 4


def test_writes(spark):
    jobs = _jobs(spark).select("id", "status")
    changes = spark.createDataFrame([(1, "failed"), (2, None)], "id long, status string")
    out = metadata.deleted(metadata.updated(jobs, changes), spark.createDataFrame([(3,)], "id long"))
    assert sorted((r.id, r.status) for r in out.collect()) == [(1, "failed"), (2, "failed"), (4, "paused")]


def test_upsert(spark):
    shape = "open_id string, name string, email string, login_method string, role string, last_signed_in timestamp"
    users = spark.createDataFrame([("a", "A", "a@x", None, "user", None), ("b", "B", None, None, "admin", None)], shape)
    changes = spark.createDataFrame([("a", None, "new", None, None, None, ["name"]), ("c", "C", None, None, None, None, ["name"]), ("b", None, None, None, "user", None, []), ("own", None, None, None, None, None, [])], shape + ", given array<string>")
    now = F.lit("2024-05-01 00:00:00").cast("timestamp")
    out = {r.open_id: r for r in metadata.upsert_users(users, changes, "own", now).collect()}
    assert (out["a"].name, out["a"].email) == (None, "a@x") and (out["b"].name, out["b"].role) == ("B", "admin")
    assert (out["c"].name, out["c"].role) == ("C", "user") and out["own"].role == "admin" and out["c"].last_signed_in is not None


def test_requests_and_uploads(spark):
    rows = [("a.txt", "en", "ar", 500, 0.5), ("", "en", "zz", 5000, None), ("b", "fr", "de", None, 3.0)]
    data = spark.createDataFrame(rows, "file_name string, source_language string, target_language string, chunk_size int, temperature double")
    assert [r.errors for r in metadata.checked_requests(data).collect()] == [[], ["file-name", "target-language", "chunk-size"], ["temperature"]]
    files = spark.createDataFrame([("a.TXT", 5), ("a.exe", 5), ("a.epub", 26 * 1024 * 1024)], "file_name string, size long")
    assert [r.reason for r in metadata.admitted(files).collect()] == [None, "unsupported-type", "too-large"]
    chat = spark.createDataFrame([("system",), ("user",)], "role string")
    assert metadata.without_system(chat).count() == 1


def test_budget_stops_at_the_first_overflow(spark):
    lines = spark.createDataFrame([("l", 1, "a"), ("l", 2, "x" * 50), ("l", 3, "bb"), ("l", 4, "é")], "log string, line_no int, line string")
    assert sorted(r.line_no for r in metadata.newest_within(lines, 6).collect()) == [3, 4]


def test_progress_stream(spark, tmp_path):
    rows = [(1, f"2024-01-01 00:{m:02d}:00", 4) for m in (1, 2, 15)] + [(2, "2024-01-01 00:03:00", 1)]
    data = spark.createDataFrame(rows, "job_id long, at string, total int").withColumn("at", F.col("at").cast("timestamp"))
    data.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(data.schema).parquet(str(tmp_path / "in"))
    q = running_progress(stream).writeStream.outputMode("complete").format("memory").queryName("progress").start()
    q.processAllAvailable()
    q.stop()
    assert {r.job_id: r.progress for r in spark.table("progress").collect()} == {1: 75.0, 2: 100.0}
    q = progress_by_window(stream).writeStream.outputMode("update").format("memory").queryName("windows").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.job_id, r.start.minute, r.processed) for r in spark.table("windows").collect()) == [(1, 0, 2), (1, 10, 1), (2, 0, 1)]
    batch = {r.job_id: r.processed for r in running_progress(data).collect()}
    assert batch == {1: 3, 2: 1}


def test_ring_buffers(spark, tmp_path):
    for number in range(3):
        rows = [("console", number * 10 + i, "m") for i in range(10)] + [("network", number, "n")]
        spark.createDataFrame(rows, "kind string, seq long, body string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("kind string, seq long, body string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = ring_buffers(stream, str(tmp_path / "out"), str(tmp_path / "check"), limit=5, once=True)
    q.awaitTermination()
    last = sorted((r.kind, r.seq) for r in spark.read.parquet(str(tmp_path / "out/flush=2")).collect())
    assert last == [("console", i) for i in range(25, 30)] + [("network", i) for i in range(3)]


def test_control(spark):
    control = JobControl()
    assert not control.pause(1) and not control.cancel(1)
    control.register(1)
    assert control.pause(1) and control.state(1) == "paused"
    done = threading.Event()
    waiter = threading.Thread(target=lambda: (control.wait(1), done.set()))
    waiter.start()
    time.sleep(0.05)
    assert not done.is_set()
    control.resume(1)
    waiter.join(2)
    assert done.is_set()
    seen = []
    for number in control.batches(1, [spark.range(2), spark.range(3), spark.range(4)], lambda df: seen.append(df.count())):
        if number == 1:
            control.cancel(1)
            break
    assert seen == [2, 3]
    with pytest.raises(Cancelled):
        control.wait(1)
    control.dispose(1)
    assert not control.known(1)


def test_captured_requests(spark):
    rows = [(200, "text/event-stream", 0, "x"), (404, "application/json", 99999, "x"), (500, None, 0, "y" * 20_000), (200, "image/png", 0, "z")]
    data = spark.createDataFrame(rows, "status int, content_type string, declared_length int, body string")
    got = [(r.body[:20], r.is_error, len(r.body)) for r in metadata.classify_requests(data).collect()]
    assert got == [("[streaming response]", False, 20), ("[large response]", True, 16), ("y" * 20, True, 10_240), ("[binary response]", False, 17)]


def test_sanitized_json_dates_and_paths(spark, tmp_path):
    given = '{"Token": 1, "a": {"b": {"c": {"d": {"e": {"f": 1}}}}}, "l": [1, 2], "s": "%s"}' % ("x" * 1001)
    import json

    out = json.loads(_one(spark, metadata.sanitize_json(F.lit(given))))
    assert out["Token"] == "[REDACTED]" and out["a"]["b"]["c"]["d"]["e"]["f"] == "[Max Depth]" and out["s"].endswith("...[truncated]") and out["l"] == [1, 2]
    assert _one(spark, metadata.sanitize_json(F.lit("{"))) is None
    assert _one(spark, text.format_date(F.lit("2024-03-05 06:07:00").cast("timestamp"))) == "5 March 2024 06:07"
    assert _one(spark, text.read_path(F.lit('{"a": [{"b": "x"}]}'), F.lit("root.a[0].b"))) == "x" and _one(spark, text.read_path(F.lit("{}"), F.lit("root.a"))) is None
    for _ in range(2):
        metadata.append_rows(spark.range(3), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 6
