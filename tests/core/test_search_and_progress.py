"""Search through postings, progress that counts once, bounded flushes, checked requests, typed settings."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textloom.operators import metadata, search_index
from textloom.operators.translate import job_prompts
from textloom.streaming import progress_of_segments, ring_buffers


def test_search_equals_the_plain_test(spark, tmp_path):
    rng = random.Random(8)
    texts = ["".join(rng.choice("abcÄé ") for _ in range(rng.randint(0, 30))) for _ in range(200)] + [None, "", "ab", "日本語の", "😀😀x😀"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    index = search_index.build_index(rows.where("id < 150"), "id", "t", str(tmp_path / "i"))
    search_index.add_to_index(rows.where("id >= 150"), index)
    for query in ["abc", "A", "ab", "bca", "c ä", "äéa", "aabb", "nowhere", " abc ", "日本語", "😀x😀", "b" * 31]:
        want = [i for i, t in enumerate(texts) if t is not None and query.strip().lower() in t.lower()]
        assert sorted(r.id for r in search_index.indexed_search(rows, index, query).collect()) == want, query
    assert search_index.indexed_search(rows, index, "  ").count() == len(texts)


def test_search_reads_the_postings_of_its_grams_alone(spark, tmp_path):
    rows = spark.range(2000).select("id", F.concat(F.lit("common words and number "), F.col("id").cast("string")).alias("t"))
    index = search_index.build_index(rows, "id", "t", str(tmp_path / "i"))
    found = search_index.candidates(rows, index, "number 1234")
    assert [r.id for r in found.collect()] == [1234]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "PushedFilters: [In(gram" in plan.replace("IsNotNull(gram), ", "")


def test_postings_are_lists_of_ids(spark, tmp_path):
    rows = spark.range(2000).select("id", F.concat(F.lit("common words and number "), F.col("id").cast("string")).alias("t")).repartition(3)
    index = search_index.build_index(rows, "id", "t", str(tmp_path / "i"))
    search_index.add_to_index(rows.where("id < 5"), index)  # ids that are given again
    postings = spark.read.parquet(f"{index.path}/postings")
    plain = {(t[i : i + 3], r.id) for r in rows.collect() for t in [r.t] for i in range(len(t) - 2)}
    assert {(r.gram, r.id) for r in postings.select("gram", F.explode("ids").alias("id")).collect()} == plain
    most = postings.groupBy("gram").count().agg(F.max("count")).first()[0]
    assert most <= 2 * spark.sparkContext.defaultParallelism  # one for each task, not one for each id
    assert sorted(r.id for r in search_index.candidates(rows, index, "number 4").collect()) == [i for i in range(2000) if str(i)[0] == "4"]


@pytest.mark.parametrize("texts", [[], [None, "", "ab"]])
def test_an_index_without_runs(spark, tmp_path, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    index = search_index.build_index(rows, "id", "t", str(tmp_path / "i"))
    assert search_index.indexed_search(rows, index, "abc").collect() == []
    assert [r.t for r in search_index.indexed_search(rows, index, "AB").collect()] == texts[2:]


def test_runs_are_gathered_in_parts(monkeypatch):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab\0Ä日😀\U0010ffff") for _ in range(n)) for n in [3, 4, 5, 8, 13, 40, 200, 3, 7] * 8]
    rows = [(f"k{i % 50}", t) for i, t in enumerate(texts)]
    want = {(t[i : i + 3], k) for k, t in rows for i in range(len(t) - 2)}
    for part, gathered, size in [(1_000_000, 2_000_000, 100), (1, 1, 1), (5, 60, 7)]:
        monkeypatch.setattr(search_index, "PART", part)
        monkeypatch.setattr(search_index, "GATHERED", gathered)
        batches = [pa.RecordBatch.from_pylist([{"id": k, "text": t} for k, t in rows[i : i + size]]) for i in range(0, len(rows), size)]
        out = list(search_index._gathered(iter([batches[0].slice(0, 0), *batches])))
        assert {(x["gram"], k) for b in out for x in b.to_pylist() for k in x["ids"]} == want
        assert all(len(set(grams := b["gram"].to_pylist())) == len(grams) for b in out) and (len(out) > 1) == (gathered < 1000)


def test_a_segment_counts_once(spark, tmp_path):
    rows = [[(1, 0, 4), (1, 1, 4), (2, 0, 1)], [(1, 1, 4), (1, 1, 4), (1, 0, 4)], [(1, 3, 4)], [(1, 2, 4), (1, 3, 4)]]
    for number, batch in enumerate(rows):
        data = spark.createDataFrame([(j, s, f"2024-01-01 00:{10 - number:02d}:00", t) for j, s, t in batch], "job_id long, segment long, at string, total long")
        data.withColumn("at", F.col("at").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("job_id long, segment long, at timestamp, total long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = progress_of_segments(stream).writeStream.outputMode("complete").format("memory").queryName("counted_once").trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    assert {r.job_id: (r.processed, r.progress) for r in spark.table("counted_once").collect()} == {1: (4, 100.0), 2: (1, 100.0)}


def test_two_flushes_are_kept(spark, tmp_path):
    for number in range(5):
        spark.createDataFrame([("ui", number * 10 + i, "m") for i in range(10)], "kind string, seq long, body string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("kind string, seq long, body string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    ring_buffers(stream, str(tmp_path / "out"), str(tmp_path / "check"), limit=7, once=True).awaitTermination()
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["flush=3", "flush=4"]
    assert sorted(r.seq for r in spark.read.parquet(str(tmp_path / "out/flush=4")).collect()) == list(range(43, 50))


def test_requests_of_every_kind(spark):
    def errors(kind, schema, *rows):
        return [r.errors for r in metadata.checked_requests(spark.createDataFrame(list(rows), schema), kind).collect()]

    term = "id long, term string, translation string, notes string, source_language string, target_language string"
    assert errors("new-term", term, (1, "a", "b", None, None, None), (2, "", None, "x" * 1001, "y" * 51, "")) == [[], ["term", "translation", "notes", "source-language"]]
    assert errors("new-term", term, (1, "😀" * 128, "b", None, None, None)) == [["term"]]  # 256 units
    assert errors("changed-term", term, (1, None, None, None, None, None), (None, "", "x" * 501, None, None, None)) == [[], ["id", "term", "translation"]]
    review = "original string, translated string, mode string, temperature double"
    assert errors("review", review, ("{}", "{}", "all", None), (None, "{}", "some", 2.1)) == [[], ["original", "mode", "temperature"]]
    one = "translated string, suggestions array<struct<path:string,suggestion:string>>"
    assert errors("apply", one, ("{}", []), ("{}", [("a", None)]), (None, None)) == [[], ["suggestions"], ["translated", "suggestions"]]
    assert errors("upload", "file_name string, file_type string, content string", ("a", "txt", ""), (None, "txt", None)) == [[], ["file-name", "content"]]
    with pytest.raises(ValueError, match="no requests"):
        metadata.checked_requests(spark.range(1), "other")


def test_settings_in_their_types(spark):
    defaults = {"on": True, "size": 30, "names": ["a"], "theme": "plain"}
    stored = ['{"on": false, "size": 5, "names": ["x", "y"], "theme": "dark"}', '{"on": "no", "size": "big", "other": 1}', "{broken", None, "{}"]
    rows = spark.createDataFrame([(s,) for s in stored], "s string").select(metadata.read_settings(F.col("s"), "on boolean, size int, names array<string>, theme string", defaults).alias("x"))
    found = [tuple(r.x) for r in rows.collect()]
    assert found == [(False, 5, ["x", "y"], "dark")] + [(True, 30, ["a"], "plain")] * 4


def test_prompts_carry_the_terms_of_their_job(spark):
    jobs = spark.createDataFrame([(1, 7, "en", "ar"), (2, 7, "fr", "ar"), (3, 8, "en", "ar")], "id long, user_id long, source_language string, target_language string")
    terms = [(1, 7, "cat", "C", "noun", "en", None), (2, 7, "dog", "D", None, None, ""), (3, 8, "", "E", None, None, None), (4, 7, "fox", "", None, None, None)]
    glossary = spark.createDataFrame(terms, "id long, user_id long, term string, translation string, notes string, source_language string, target_language string")
    prompts = {r.job_id: r.prompt for r in job_prompts(jobs, metadata.glossary_for_jobs(jobs, glossary)).collect()}
    assert prompts[1].endswith('\n- "cat" -> "C" (noun)\n- "dog" -> "D"') and prompts[2].endswith('translation:\n- "dog" -> "D"')
    assert "written in en" in prompts[3] and '"' not in prompts[3]
    few = {r.job_id: r.prompt for r in job_prompts(jobs, metadata.glossary_for_jobs(jobs, glossary), 1).collect()}
    assert few[1].endswith('\n- "cat" -> "C" (noun)')
