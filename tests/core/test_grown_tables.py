"""Queries against their SQL on rows that only larger tables hold."""

import time
from pathlib import Path

import duckdb
import pytest

from textloom.functions.text import one_line
from textloom.jsstr import WHITE, WS, is_blank
from textloom.operators import quality
from textloom.operators.budget import budget_chunks
from textloom.plans import queries

from .test_entry import _rows


def _equals_sql(spark, name, folder):
    got = queries.QUERIES[name](spark, str(folder)).toPandas()
    con = duckdb.connect()
    for table in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {table.stem} AS SELECT * FROM '{table}/*.parquet'")
    want = con.execute(queries.ORACLE_SQL[name]).df()
    assert len(want) and _rows(got) == _rows(want)


@pytest.fixture(scope="module")
def long_paragraphs(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("long")
    texts = ["one line.\n" + "word! " * 700 + "end", "a b\n\nc d", "x " * 499 + "\n" + "y. " * 1200, None]
    docs = [(i, t, "en", "src", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    turns = [(c, t, ("user", "assistant")[t % 2], f"turn {c} {t}") for c in range(2) for t in range(3)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    spark.createDataFrame([(1, "u", "<p>one</p>")], "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    return folder


@pytest.mark.parametrize("name", ["routed_files", "translate_files_by_type"])
def test_paragraphs_of_many_words_stay_whole(spark, long_paragraphs, name):
    _equals_sql(spark, name, long_paragraphs)


def _plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_word_budget_broadcasts_no_table(spark):
    rows = spark.range(500).selectExpr("id % 3 AS file_id", "id AS seg_no", "id % 7 AS words")
    found = budget_chunks(rows, 10)
    assert "SortMergeJoin" in _plan(found) and "Broadcast" not in _plan(found)
    assert found.agg({"words": "sum"}).first()[0] == sum(i % 7 for i in range(500))


def test_split_files_are_diagnosed_before_they_are_ordered(spark):
    """Breaks were placed twice in a row's plan, and the ordering went through all of it once more."""
    text = "one two three four five six seven\n" * 6
    entries = spark.createDataFrame([("f", i, None, text) for i in range(5)], "file string, index long, label string, original string")
    said = spark.createDataFrame([("f", i, text.replace("\n", " ").strip() + "\nx") for i in range(5)], "file string, index long, text string")
    found = quality.scan_line_split_files(entries, said)
    assert "_broken_lines" not in _plan(found) and [r["index"] for r in found.collect()] == list(range(5))


def test_white_space_is_told_in_linear_time(spark):
    """A long run of blanks without a break was gone through once for each of its blanks."""
    rows = spark.createDataFrame([("a" + " " * 300_000 + "b",), ("a \n b\tc\n\nd　 e ﻿",), ("\n",)], "t string")
    begun = time.monotonic()
    assert [r[0] for r in rows.select(one_line(rows["t"])).collect()] == ["a b", "a b\tc d e", ""]
    assert time.monotonic() - begun < 20


def test_white_space_classes(spark):
    every = [chr(i) for i in (*range(0x20, 0xD800), *range(0xE000, 0x10000), *range(0x1F600, 0x1F640), *range(0x20))]
    rows = spark.createDataFrame([(c,) for c in every], "c string")
    blank = {r.c for r in rows.where(is_blank(rows["c"])).collect()}
    spaces = {r.c for r in rows.where(rows["c"].rlike(WS)).collect()}
    assert blank == spaces == set(WHITE)


def test_chunks_cost_little_for_each_word(spark):
    """Words were matched one by one, some two microseconds for each, and once more to see whether a paragraph is long."""
    from textloom.functions.chunks import chunks_of, n_words
    from textloom.sources.text_formats import txt_chunks

    begun = time.monotonic()
    text = "one two three four. " * 200_000
    assert len(chunks_of(text, 30, True)) == -(-200_000 // 7) and time.monotonic() - begun < 2
    every = [chr(i) for i in (*range(0xD800), *range(0xE000, 0x10000))]
    assert {c for c in every if n_words(c) == 0} == set(WHITE) and n_words("a﻿b\x85c　d\x1c") == 3
    rows = spark.createDataFrame([(1, " a b\n\n" + "c d e. " * 3 + "\n\n x y z w v "), (2, None), (3, " \n"), (4, "")], "id long, t string")
    found = {r.id: r.c for r in rows.select("id", txt_chunks(rows["t"], 4, True).alias("c")).collect()}
    assert found == {1: [" a b", "c d e.", "c d e.", "c d e.", "x y z w v"], 2: None, 3: [], 4: []}


def test_breaks_of_few_lines_are_those_of_characters(spark, monkeypatch):
    from textloom.functions import linesplit

    texts = ["", "\n", "a", "a\n", "\na\n\nb c", "[XENO:x ]a\nb😀\nc", "é\n" * 30, None]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    found = lambda: {r.id: r.r for r in rows.select("id", linesplit.break_ratios(rows["t"]).alias("r")).collect()}
    few = found()
    monkeypatch.setattr(linesplit, "FEW_LINES", 0)
    assert few == found() and few[4] == [0.0, 2 / 7, 3 / 7] and few[1] == [0.0] and few[2] == []


def test_a_review_places_breaks_once(spark):
    """Filters on the proposal named it twice, and each naming worked it out."""
    rows = spark.createDataFrame([(0, 1, "p", "k", "one two\nthree four five", "one\ntwo three four five\nx")], "file_id long, seg_no int, path string, key string, original string, translation string")
    plan = quality.badly_split(rows, False)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("_broken_lines(") == 1 and "Filter ((NOT CASE" not in plan
