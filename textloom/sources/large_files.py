"""CSV and Markdown files of any size, read in byte ranges.

A large file is split wherever its bytes happen to be cut; Spark gives each line to one range. What a line means depends on what
stands before it: whether a quote is open, or a fence. Each range therefore says what it does to either state (which state it is
left in, how many rows or segments begin in it), and prefix sums over these small maps, one row for each range, tell every range
the state and the numbers that it starts with. Lines of one row, or of one run of text, are then put together; nothing else of a
file ever meets.

Defined cases: an empty file has no rows; a quote that is never closed runs to the end of its file; a fence that is never closed
too; lines end at line feeds (CSV keeps other marks, Markdown takes CRLF as one); a line, row or run of text must fit a string.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..jsstr import is_blank, trim
from .text_formats import csv_rows, is_cell_text



def file_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file_id, block, value, size): lines of all files of a path in the order of their range; `size` is the file's length."""
    meta = "_metadata"
    rows = spark.read.option("lineSep", "\n").text(path)
    return rows.select(F.xxhash64(f"{meta}.file_path").alias("file_id"), F.col(f"{meta}.file_block_start").alias("block"), "value", F.col(f"{meta}.file_size").alias("size"))


def _numbered(lines: DataFrame) -> DataFrame:
    """Number the lines of each range and count, for either state that it may start in, what the lines before have begun.

    `lines` has file_id, block, value, turns (whether a line changes the state), new0 and new1 (what begins with a line if the
    state before it is 0 or 1).
    """

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, line, state, counts = None, 0, 0, [0, 0]
        for batch in batches:
            if not batch.num_rows:
                continue
            files, blocks = (np.asarray(batch.column(i)) for i in (0, 1))
            turns = np.asarray(batch.column(3).cast(pa.int8())).astype(np.int64)
            new = np.stack([np.asarray(batch.column(i).cast(pa.int8())).astype(np.int64) for i in (4, 5)])
            cuts = np.flatnonzero((np.diff(files) != 0) | (np.diff(blocks) != 0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                if (files[a], blocks[a]) != key:
                    key, line, state, counts = (files[a], blocks[a]), 0, 0, [0, 0]
                before = (state + np.cumsum(turns[a:b]) - turns[a:b]) & 1
                columns = [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(np.arange(line, line + b - a)), batch.column(2).slice(a, b - a), pa.array(before.astype(bool))]
                for start in (0, 1):
                    begun = new[before ^ start, np.arange(a, b)]
                    columns.append(pa.array(counts[start] + np.cumsum(begun) - begun))
                    counts[start] += int(begun.sum())
                yield pa.RecordBatch.from_arrays([*columns, *(batch.column(i).slice(a, b - a) for i in (3, 4, 5))], names=["file_id", "block", "line", "value", "turned", "count0", "count1", "turns", "new0", "new1"])
                line, state = line + b - a, (state + int(turns[a:b].sum())) & 1

    rows = lines.select("file_id", "block", "value", "turns", "new0", "new1")
    return rows.mapInArrow(number, "file_id long, block long, line long, value string, turned boolean, count0 long, count1 long, turns boolean, new0 boolean, new1 boolean")


def stitched(lines: DataFrame) -> DataFrame:
    """(file_id, block, line, value, inside, number, turns): the state before each line, and how much has begun before it in its file."""
    numbered = _numbered(lines)
    begins = [F.when(F.col("turned"), F.col(f"new{1 - k}")).otherwise(F.col(f"new{k}")).cast("long") for k in (0, 1)]
    maps = numbered.groupBy("file_id", "block").agg(F.sum(F.col("turns").cast("int")).alias("turns"), F.sum(begins[0]).alias("n0"), F.sum(begins[1]).alias("n1"))
    before = Window.partitionBy("file_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    maps = maps.withColumn("open", F.coalesce(F.sum("turns").over(before), F.lit(0)) % 2 == 1)
    base = F.coalesce(F.sum(F.when(F.col("open"), F.col("n1")).otherwise(F.col("n0"))).over(before), F.lit(0))
    starts = maps.select("file_id", "block", "open", base.alias("base"))
    rows = numbered.join(starts, ["file_id", "block"])
    number = F.col("base") + F.when(F.col("open"), F.col("count1")).otherwise(F.col("count0"))
    return rows.select("file_id", "block", "line", "value", (F.col("turned") != F.col("open")).alias("inside"), number.alias("number"), "turns")


def _together(rows: DataFrame, *keys: str) -> DataFrame:
    """Lines of one key in order, joined by line feeds; `value` of single lines stays where it is."""
    lines = F.array_sort(F.collect_list(F.struct("block", "line", "value")))
    return rows.groupBy("file_id", *keys).agg(F.array_join(F.transform(lines, lambda x: x.value), "\n").alias("text"))


def _ends(lines: DataFrame) -> DataFrame:
    """(file_id, closed): whether a file ends with a line feed. A mark of the byte order is no part of its lines."""
    rest = F.max("size") - F.sum((F.octet_length("value") + 1).cast("long"))
    return lines.groupBy("file_id").agg(rest.isin(0, 3).alias("closed"))


def csv_file_rows(spark: SparkSession, path: str) -> DataFrame:
    """(file_id, row_no, cells) of CSV files; a row may have line feeds in quotes, within a range or over several."""
    lines = file_lines(spark, path)
    odd = (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2 == 1
    # A row ends with a line after which no quote is open.
    rows = stitched(lines.select("*", odd.alias("turns"), (~odd).alias("new0"), odd.alias("new1"))).withColumnRenamed("number", "row_no")
    single = ~F.col("inside") & ~F.col("turns")
    text = rows.where(single).select("file_id", "row_no", F.col("value").alias("text")).unionByName(_together(rows.where(~single), "row_no"))
    last = rows.groupBy("file_id").agg(F.max("row_no").alias("last_row")).join(_ends(lines), "file_id")
    text = text.join(last, "file_id")
    # The last row keeps what the file ends with: it has a line feed in an open quote, or none, and then it must hold something.
    ended = (F.col("row_no") != F.col("last_row")) | F.col("closed")
    content = F.when(ended, F.concat("text", F.lit("\n"))).otherwise(F.col("text"))
    return text.select("file_id", "row_no", F.get(csv_rows(content), F.lit(0)).alias("cells")).where("cells IS NOT NULL")


def csv_file_segments(spark: SparkSession, path: str) -> DataFrame:
    """(file_id, row_no, col_no, text, translatable) of CSV files, as `csv_segments` gives them for files in a column."""
    cells = csv_file_rows(spark, path).select("file_id", "row_no", F.posexplode("cells").alias("col_no", "text"))
    return cells.withColumn("translatable", is_cell_text(F.col("text")))


def markdown_file_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(file_id, place, kind, text) of Markdown files in the order of `place`: runs of text, lines of code, blank lines.

    The place of a line that is no text is twice the number of such lines before it, and one; that of a run of text is twice the
    number of such lines before it.
    """
    lines = file_lines(spark, path).withColumn("value", F.regexp_replace("value", "\r$", ""))
    fence = F.startswith(trim(F.col("value")), F.lit("```"))
    other = lines.select("file_id", "block", "value", fence.alias("turns"), (fence | is_blank(F.col("value"))).alias("new0"), F.lit(True).alias("new1"))
    rows = stitched(other)
    code = F.col("turns") | F.col("inside")
    rows = rows.withColumn("kind", F.when(code, "code").when(is_blank(F.col("value")), "blank").otherwise("text"))
    place = 2 * F.col("number") + (F.col("kind") != "text").cast("long")
    rows = rows.withColumn("place", place)
    single = rows.where("kind <> 'text'").select("file_id", "place", "kind", F.when(F.col("kind") == "blank", "").otherwise(F.col("value")).alias("text"))
    runs = _together(rows.where("kind = 'text'"), "place").select("file_id", "place", F.lit("text").alias("kind"), "text")
    return single.unionByName(runs).unionByName(_last_lines(spark, path, rows))


def _last_lines(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    """The empty line after a file's last line feed."""
    state = F.when(F.col("inside") != F.col("turns"), "code").otherwise("blank")
    after = rows.groupBy("file_id").agg(F.max("place").alias("p"), F.max_by(state, F.struct("block", "line")).alias("kind")).join(_ends(file_lines(spark, path)).where("closed"), "file_id")
    # Text before it ends its run: the next place that is no text.
    return after.select("file_id", (F.col("p") + 1 + F.col("p") % 2).alias("place"), "kind", F.lit("").alias("text"))
