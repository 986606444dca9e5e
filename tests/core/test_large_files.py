"""Files cut into byte ranges give what the whole file gives; chunks by doubling give what a walk gives."""

import random

import pytest
from pyspark.sql import functions as F

from textloom.operators.budget import budget_chunks
from textloom.sources import large_files, text_formats

CSV = [
    'a,b\n1,"x\ny"\n"q""\n,\n""",z\n\n\r\n,\n"last\r\n,""two"" ",e"mid, dle"d,\n',
    'a,"open\nto the\nend,"",\n\n',
    'a,"open\nto the\nend',
    "no break at the end",
    "x\n\r",
    "x\n",
    "\n\n",
    '""',
    "﻿ü,é\nö,ß\n",
    '"' + "long, cell\n" * 40 + '",z\ny',
]
MARKDOWN = [
    "# Head\ntext\n\nmore\nlines\n```py\ncode\n\n# no head\n```\nafter\n",
    "```\nnever closed\n\ntext",
    "text\r\nof two lines\r\n\r\n  ```\r\nx\r\n```",
    "\n\n",
    "one line",
    "a\n```\n",
    " \n\t\nb\n",
    "",
]


@pytest.fixture
def cut(spark, tmp_path):
    """Write contents as files of their own and read them in ranges of so many bytes."""
    usual = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def write(contents):
        for i, text in enumerate(contents):
            (tmp_path / f"f{i:02}.txt").write_bytes(text.encode())
        names = spark.read.format("binaryFile").load(f"{tmp_path}/*.txt").select(F.regexp_extract("path", r"f(\d+)\.txt", 1).cast("int"), F.xxhash64("path")).collect()
        return f"{tmp_path}/*.txt", {name: number for number, name in names}

    def ranges(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", 0)

    yield write, ranges
    for k, v in usual.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("size", [1, 3, 7, 17, 64])
def test_csv_cut_anywhere(spark, cut, size):
    write, ranges = cut
    path, names = write(CSV)
    whole = spark.createDataFrame([(i, c.lstrip("﻿")) for i, c in enumerate(CSV)], "file_id long, content string")
    want = sorted((r.file_id, r.row_no, r.cells) for r in whole.select("file_id", F.posexplode(text_formats.csv_rows(F.col("content"))).alias("row_no", "cells")).collect())
    ranges(size)
    rows = large_files.csv_file_rows(spark, path)
    if size < 10:
        assert large_files.file_lines(spark, path).select("file_id", "block").distinct().count() > 2 * len(CSV)
    assert sorted((names[r.file_id], r.row_no, r.cells) for r in rows.collect()) == want


@pytest.mark.parametrize("size", [1, 3, 7, 17, 64])
def test_markdown_cut_anywhere(spark, cut, size):
    write, ranges = cut
    path, names = write(MARKDOWN)
    whole = text_formats.md_segments(spark.createDataFrame(list(enumerate(MARKDOWN)), "file_id long, content string"))
    # A file without a byte has no line.
    want = [(r.file_id, r.kind, r.text) for r in whole.where(f"file_id <> {MARKDOWN.index('')}").orderBy("file_id", "seg_no").collect()]
    ranges(size)
    found = large_files.markdown_file_blocks(spark, path).collect()
    assert [x[0:1] + x[2:] for x in sorted((names[r.file_id], r.place, r.kind, r.text) for r in found)] == want


def _walk(words, budget):
    chunks, total = [], 0
    for i, n in enumerate(words):
        if not chunks or total + n > budget:
            chunks.append([i, i, n])
            total = n
        else:
            chunks[-1][1:] = [i, chunks[-1][2] + n]
            total += n
    return [tuple(c) for c in chunks]


@pytest.mark.parametrize("budget", [1, 7, 40])
def test_chunks_by_doubling(spark, monkeypatch, budget):
    monkeypatch.setattr("textloom.operators.budget.ROWS_PER_BLOCK", 16)
    rng = random.Random(budget)
    files = {f: [rng.choice([0, 1, 2, 3, 5, 9, 60]) if f % 2 else rng.randint(0, 4) for _ in range(size)] for f, size in enumerate([1, 2, 300, 301, 64, 17])}
    files[9] = [0, 0, 0, 50, 0, 0]
    rows = [(f, 3 * i, n or None) for f, words in files.items() for i, n in enumerate(words)]
    found = budget_chunks(spark.createDataFrame(rows, "file_id long, seg_no long, words int"), budget).collect()
    want = sorted((f, k, 3 * a, 3 * b, n) for f, words in files.items() for k, (a, b, n) in enumerate(_walk(words, budget)))
    assert sorted(map(tuple, found)) == want
    assert budget_chunks(spark.createDataFrame([], "file_id long, seg_no long, words int"), budget).collect() == []
