"""Jobs that are killed, cancelled, paused and watched; calls at a time over all tasks; reviewers that fail; trees that cannot end."""

import json
import threading
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from textloom.operators import quality, rebuild
from textloom.operators.translate import TransformOptions
from textloom.plans import jobs
from textloom.plans.resumable import ResumableJob
from textloom.sources import trees
from textloom.streaming.control import JobControl


def _files(spark, n=30):
    rows = [(i, f"f{i}.txt", f"first {i}\nsecond {i}\n \nlast") for i in range(n)] + [(100, "a.json", '{"text": "hello", "id": "x", "n": ["one", ""]}'), (101, "b.json", "{broken"), (102, "c.txt", "")]
    return spark.createDataFrame(rows, "file_id long, file_name string, content string")


class Recorder:
    """A translator that notes each call in a file of its own; with `deadly` it ends its worker's task once at a text."""

    def __init__(self, folder, deadly=None, wait_s=0.0):
        self.folder, self.deadly, self.wait_s = str(folder), deadly, wait_s

    def __call__(self, text, prompt):
        import os
        import uuid

        began = time.time()
        time.sleep(self.wait_s)
        with open(f"{self.folder}/{uuid.uuid4().hex}", "w") as f:
            json.dump([text, prompt, began, time.time()], f)
        if self.deadly and self.deadly in text and not os.path.exists(f"{self.folder}/../alive"):
            raise KeyboardInterrupt("killed")
        return f"<{text}>"

    def calls(self):
        from pathlib import Path

        return [json.loads(p.read_text()) for p in Path(self.folder).iterdir()]


@pytest.fixture
def noted(tmp_path):
    folder = tmp_path / "calls"
    folder.mkdir()
    return folder


def _job(spark, tmp_path, translator, **options):
    given = {"rows_per_batch": 20, "options": TransformOptions(attempts=1, concurrency=2, prompt="usual"), "types": ("txt", "json"), **options}
    return ResumableJob(spark, 1, f"{tmp_path}/jobs", translator, **given)


def test_a_killed_job_goes_on(spark, tmp_path, noted):
    deadly = Recorder(noted, deadly="second 17")
    job = _job(spark, tmp_path, deadly)
    job.stage(_files(spark), prompt="the job's own")
    with pytest.raises(Exception, match="killed"):
        job.run()
    before = job.progress().orderBy("batch").collect()
    finished = {t for t, *_ in ((r.text,) for r in job.results().where("translated <> text").collect())}
    (tmp_path / "alive").touch()
    again = _job(spark, tmp_path, deadly)
    again.stage(_files(spark), prompt="another")  # staged already: nothing changes
    assert again.run() == "completed"
    after = again.progress().orderBy("batch").collect()
    assert len(after) > len(before) and [r.processed for r in after] == sorted(r.processed for r in after) and after[-1].progress == 100
    times = Counter(t for t, *_ in deadly.calls() if t != "last")
    assert set(times.values()) <= {1, 2} and 1 <= sum(n == 2 for n in times.values()) <= 20 and all(times[t] == 1 for t in finished if t != "last")
    assert {p for _, p, *_ in deadly.calls()} == {"the job's own"}
    rows = {r.file_id: r for r in again.outputs().collect()}
    assert rows[3].output == "<first 3>\n\n<second 3>\n\n<last>" and rows[3].total_chunks == rows[3].processed_chunks == 3
    assert json.loads(rows[100].output) == {"text": "<hello>", "id": "x", "n": ["<one>", ""]} and rows[101].error and rows[102].total_chunks == 0
    plain = {r.file_id: r.output for r in jobs.translate_files(_files(spark), types=("txt", "json")).collect()}
    assert {k: v.replace("[T]", "<") for k, v in plain.items() if k < 100} == {k: r.output.replace(">", "") for k, r in rows.items() if k < 100}
    assert again.run() == "completed" and len(again.progress().collect()) == len(after)
    again.forget()


def test_cancel_before_the_start_calls_nothing(spark, tmp_path, noted):
    control = JobControl()
    job = _job(spark, tmp_path, Recorder(noted), control=control)
    job.stage(_files(spark))
    control.register(1)
    control.cancel(1)
    assert job.run() == "cancelled" and Recorder(noted).calls() == [] and job.progress().collect() == []


def test_pause_and_cancel_between_batches(spark, tmp_path, noted):
    control, states = JobControl(), []
    job = _job(spark, tmp_path, Recorder(noted, wait_s=0.01), control=control)
    job.stage(_files(spark))
    control.register(1)
    control.pause(1)
    runner = threading.Thread(target=lambda: states.append(job.run()))
    runner.start()
    time.sleep(4)
    assert job.progress().collect() == [] and runner.is_alive()
    control.resume(1)
    while not job.progress().collect():
        time.sleep(0.2)
    control.cancel(1)
    runner.join(60)
    some = job.results().where("translated <> text").count()
    assert states == ["cancelled"] and 0 < some < 91
    # A new control takes the job up again.
    assert _job(spark, tmp_path, Recorder(noted)).run() == "completed"
    assert job.results().where("translated <> text").count() == 92


@pytest.mark.parametrize("slots", [1, 3])
def test_calls_at_a_time_over_all_tasks(spark, tmp_path, noted, slots):
    slow = Recorder(noted, wait_s=0.05)
    job = _job(spark, tmp_path, slow, options=TransformOptions(attempts=1, concurrency=slots), rows_per_batch=1000)
    job.stage(_files(spark, 12))
    assert job.run() == "completed"
    calls = slow.calls()
    most = max(sum(a <= moment < b for *_, a, b in calls) for *_, moment, _ in calls)
    assert len(calls) == 38 and most <= slots


def _entries(spark):
    rows = [(f, i, f"root.{i}", "k", f"one {i}", f"eins {i}") for f in (0, 1) for i in range(3)]
    return spark.createDataFrame(rows, "file_id long, seg_no int, path string, key string, original string, translation string")


def test_a_reviewer_that_fails_stops_no_other_file(spark, tmp_path):
    flag = str(tmp_path / "tried")

    def reviewer(batch, glossary):
        import os

        if not os.path.exists(flag):
            open(flag, "w").close()
            raise ValueError("busy")
        return '{"issues": [{"index": 1, "suggestion": "besser"}]}'

    found = quality.review_with(_entries(spark), reviewer, first_wait_s=0.0).collect()
    assert sorted((r.file_id, r.path, r.suggestion) for r in found) == [(0, "root.1", "besser"), (1, "root.1", "besser")]

    def half(batch, glossary):
        if glossary == "x":
            raise ValueError("refused")
        return "no json"

    replies = quality.reviewer_replies(_entries(spark), half, "x", attempts=2, first_wait_s=0.0).collect()
    assert [(r.reply, r.error) for r in replies] == [(None, "refused")] * 2
    assert quality.review_with(_entries(spark), half, "x", attempts=2, first_wait_s=0.0).collect() == []


def test_parsers_that_cannot_be_stalled(spark):
    began = time.perf_counter()
    for content in ("<!--" * 20_000, "<a " * 50_000, "<!--" * 20_000 + "-->" + "<!--" * 20_000 + "<b>", "<!" * 40_000):
        for clean in (False, True):
            tokens = list(trees.html_tokens(content, clean))
            assert "".join(content[a:b] for a, b, *_ in tokens) == content
    assert time.perf_counter() - began < 2
    many = {str(i): "x" for i in range(100_000)}
    assert len(trees.entries({**many, "b": "y"})) == 100_001 and time.perf_counter() - began < 4
    bomb = "a0: &a0 [x, x, x, x, x, x, x, x, x, x]\n" + "".join(f"a{i}: &a{i} [{', '.join([f'*a{i - 1}'] * 10)}]\n" for i in range(1, 9))
    fine = "base: &b {name: one}\nagain: [*b, *b]\n"
    files = spark.createDataFrame([(1, bomb), (2, fine)], "file_id long, content string")
    rows = trees.yaml_segments(files).collect()
    assert [r.file_id for r in rows if r.kind == "error"] == [1] and [r.text for r in rows if r.file_id == 2] == ["one"] * 3
    assert rebuild.write_yaml(files, trees.yaml_segments(files).where("kind <> 'error'").withColumn("translated", F.col("text"))).where("file_id = 1").first().write_error


def _plain_tokens(content):
    import re

    at = 0
    for m in re.finditer(r"</?([a-zA-Z][a-zA-Z0-9-]*)[^>]*>|<!--[\s\S]*?-->", content):
        if m.start() > at:
            yield at, m.start(), "text"
        yield m.start(), m.end(), "tag"
        at = m.end()
    if at < len(content):
        yield at, len(content), "text"


def test_tokens_equal_one_plain_pattern():
    import random

    rng = random.Random(3)
    pool = ["<a>", "</a>", "<b", ">", "<!--", "-->", "--", "<", "!", "text", "<!-->", "<!--->", "<!doctype>", "</", "-", "<br/>", "\n", "é"]
    for _ in range(3000):
        content = "".join(rng.choice(pool) for _ in range(rng.randint(0, 14)))
        assert [t[:3] for t in trees.html_tokens(content)] == list(_plain_tokens(content)), content


def test_deep_trees_are_rebuilt_or_fail_alone(spark):
    deep = lambda n: '{"a": ' * n + '"x"' + "}" * n
    done = jobs.translate_type(spark.createDataFrame([(1, deep(1500)), (2, '{"a": "x"}'), (3, deep(200_000))], "file_id long, content string"), "json")
    rows = {r.file_id: r for r in done.collect()}
    assert "".join(rows[1].output.split()) == deep(1500).replace(" ", "") and rows[1].error is None
    assert json.loads(rows[2].output) == {"a": "[T]x"} and rows[3].error and rows[3].output == ""
    assert {r.file_id: r.status for r in jobs.job_rows(done).collect()} == {1: "completed", 2: "completed", 3: "failed"}
