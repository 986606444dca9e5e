"""Plain text, subtitles, Markdown and CSV as segment rows, in built-in expressions only.

Segments: file_id, seg_no, kind, path, text, translatable, attrs. Pieces that are not translated are rows too wherever the
file cannot be rebuilt without them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.chunks import chunked
from ..jsstr import WS, is_blank, trim, unix_lines, words

NO_ATTRS = "cast(map() as map<string,string>)"


def _segments(rows: DataFrame, kind: Column, text: Column, translatable: Column, attrs: Column | None = None, path: Column | None = None) -> DataFrame:
    return rows.select(
        "file_id",
        F.col("seg_no").cast("int").alias("seg_no"),
        kind.alias("kind"),
        (F.lit(None).cast("string") if path is None else path).alias("path"),
        text.alias("text"),
        translatable.alias("translatable"),
        (F.expr(NO_ATTRS) if attrs is None else attrs).alias("attrs"),
    )


def _filled(items: Column) -> Column:
    return F.filter(items, lambda x: ~is_blank(x))


def txt_chunks(content: Column, chunk_size: int = 500, lossless: bool = False) -> Column:
    """Paragraphs, those of more words than `chunk_size` in sentence chunks."""
    return chunked(content, chunk_size, lossless, paragraphs=True)


def txt_segments(files: DataFrame, chunk_size: int = 500, lossless: bool = False) -> DataFrame:
    cut = files.select("file_id", txt_chunks(F.col("content"), chunk_size, lossless).alias("chunks"))
    rows = cut.select("file_id", F.posexplode("chunks").alias("seg_no", "text"))
    return _segments(rows, F.lit("text"), F.col("text"), F.lit(True))


def _parts_of_timing(line: Column) -> tuple[Column, Column]:
    parts = F.split(line, "-->")
    return trim(F.get(parts, F.lit(0))), trim(F.coalesce(F.get(parts, F.lit(1)), F.lit("")))


def srt_segments(files: DataFrame) -> DataFrame:
    """Cues with a timing line; blocks of one line, or without a timing, are dropped."""
    blocks = _filled(F.split(unix_lines(F.col("content")), r"\n\n+"))

    def cue(block: Column) -> Column:
        lines = F.split(block, "\n")
        numbered = F.get(lines, F.lit(0)).rlike(rf"\A[0-9]+{WS}*\z")
        timing = F.when(numbered, F.get(lines, F.lit(1))).otherwise(F.get(lines, F.lit(0)))
        start, end = _parts_of_timing(timing)
        text = F.array_join(F.slice(lines, F.when(numbered, 3).otherwise(2), F.size(lines)), "\n")
        index = F.when(numbered, trim(F.get(lines, F.lit(0))))
        good = (F.size(lines) >= 2) & F.coalesce(F.contains(timing, F.lit("-->")), F.lit(False))
        return F.struct(good.alias("good"), start.alias("start"), end.alias("end"), index.alias("index"), text.alias("text"))

    cues = F.filter(F.transform(blocks, cue), lambda c: c.good)
    rows = files.select("file_id", F.posexplode(cues).alias("seg_no", "c"))
    attrs = F.map_filter(F.create_map(F.lit("start"), F.col("c.start"), F.lit("end"), F.col("c.end"), F.lit("index"), F.col("c.index")), lambda k, v: v.isNotNull())
    return _segments(rows, F.lit("cue"), F.col("c.text"), F.lit(True), attrs)


def vtt_segments(files: DataFrame) -> DataFrame:
    """The header as a row of its own, then cues with timing, settings and identifier; other blocks are dropped."""
    blocks = _filled(F.split(unix_lines(F.col("content")), r"\n\n+"))
    is_header = lambda b: F.startswith(F.upper(trim(b)), F.lit("WEBVTT"))
    headers = F.filter(blocks, is_header)
    header = F.coalesce(F.get(F.transform(headers, trim), F.size(headers) - 1), F.lit("WEBVTT"))

    def cue(block: Column) -> Column:
        lines = F.filter(F.split(block, "\n"), lambda x: x != "")
        first = F.get(lines, F.lit(0))
        named = ~F.contains(first, F.lit("-->"))
        timing = F.when(named, F.get(lines, F.lit(1))).otherwise(first)
        parts = F.split(timing, WS + "{2,}")
        start, end = _parts_of_timing(F.get(parts, F.lit(0)))
        settings = F.array_join(F.slice(parts, 2, F.size(parts)), " ")
        text = F.array_join(F.slice(lines, F.when(named, 3).otherwise(2), F.size(lines)), "\n")
        good = F.coalesce(F.contains(timing, F.lit("-->")), F.lit(False))
        return F.struct(good.alias("good"), start.alias("start"), end.alias("end"), F.when(settings != "", settings).alias("settings"), F.when(named, first).alias("identifier"), text.alias("text"))

    cues = F.filter(F.transform(F.filter(blocks, lambda b: ~is_header(b)), cue), lambda c: c.good)
    names = ("start", "end", "settings", "identifier")
    rows = files.select("file_id", header.alias("header"), F.posexplode_outer(cues).alias("seg_no", "c"))
    attrs = F.map_filter(F.create_map(*[x for n in names for x in (F.lit(n), F.col(f"c.{n}"))]), lambda k, v: v.isNotNull())
    out = _segments(rows.where("seg_no IS NOT NULL").withColumn("seg_no", F.col("seg_no") + 1), F.lit("cue"), F.col("c.text"), F.lit(True), attrs)
    head = _segments(files.select("file_id", F.lit(0).alias("seg_no"), header.alias("header")), F.lit("header"), F.col("header"), F.lit(False))
    return head.unionByName(out)


def md_segments(files: DataFrame) -> DataFrame:
    """Runs of text lines; fence lines and what they enclose are code, blank lines are kept as empty rows.

    Lines are rows, so that a document of any length works: a running count of fences tells code from text, and runs of text
    are islands between other lines.
    """
    lines = files.select("file_id", F.posexplode(F.split(unix_lines(F.col("content")), "\n")).alias("line_no", "line"))
    by = Window.partitionBy("file_id").orderBy("line_no")
    fence = F.startswith(trim(F.col("line")), F.lit("```"))
    before = F.coalesce(F.sum(fence.cast("int")).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kind = F.when(fence | (before % 2 == 1), "code").when(is_blank(F.col("line")), "blank").otherwise("text")
    lines = lines.withColumn("kind", kind)
    starts = (F.col("kind") != "text") | (F.lag("kind", 1, "").over(by) != "text")
    lines = lines.withColumn("seg_no", F.sum(starts.cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    runs = lines.groupBy("file_id", "seg_no").agg(F.first("kind").alias("kind"), F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("lines"))
    text = F.when(F.col("kind") == "blank", "").otherwise(F.array_join(F.transform("lines", lambda x: x.line), "\n"))
    return _segments(runs, F.col("kind"), text, F.col("kind") == "text")


_RUN = r'(?:[^"\n]++|"(?:[^"]++|"")*+")*+'
_CELL = r'((?:[^",]++|"(?:[^"]++|"")*+")*+),'


def _cell_value(raw: Column) -> Column:
    """Quotes taken off (they may open in mid-cell), doubled ones as one, carriage returns outside quotes dropped."""
    pieces = F.regexp_extract_all(raw, F.lit(r'"(?:[^"]++|"")*+"|[^"]++'), 0)
    plain = lambda p: F.when(
        F.startswith(p, F.lit('"')), F.replace(F.substr(p, F.lit(2), F.length(p) - 2), F.lit('""'), F.lit('"'))
    ).otherwise(F.replace(p, F.lit("\r"), F.lit("")))
    return F.array_join(F.transform(pieces, plain), "")


def csv_rows(content: Column) -> Column:
    """Rows of cell texts; a quote that is never closed runs to the end."""
    odd = F.length(F.replace(content, F.lit('"'), F.lit(""))) % 2 != F.length(content) % 2
    closed = F.when(odd, F.concat(content, F.lit('"'))).otherwise(content)
    ended = F.when(F.endswith(closed, F.lit("\n")) & ~odd, closed).otherwise(F.concat(closed, F.lit("\n")))
    rows = F.regexp_extract_all(ended, F.lit(f"({_RUN})\n"), 1)
    cells = F.transform(rows, lambda r: F.transform(F.regexp_extract_all(F.concat(r, F.lit(",")), F.lit(_CELL), 1), _cell_value))
    # Nothing, or returns alone, after the last break is no row.
    tail_is_empty = ~F.endswith(content, F.lit("\n")) & (F.size(F.get(cells, F.size(cells) - 1)) == 1) & (F.get(F.get(cells, F.size(cells) - 1), F.lit(0)) == "")
    return F.when(content == "", F.array().cast("array<array<string>>")).when(tail_is_empty, F.slice(cells, 1, F.size(cells) - 1)).otherwise(cells)


def is_cell_text(text: Column) -> Column:
    """Neither blank nor a number."""
    return ~(is_blank(text) | trim(text).rlike(r"\A-?[0-9]+(\.[0-9]+)?\z"))


def csv_segments(files: DataFrame) -> DataFrame:
    """One row for each cell; blank and numeric cells are not translated. The header is data."""
    grid = files.select("file_id", F.posexplode(csv_rows(F.col("content"))).alias("row_no", "cells"))
    cells = grid.select("file_id", "row_no", F.posexplode("cells").alias("col_no", "text"))
    number = F.row_number().over(Window.partitionBy("file_id").orderBy("row_no", "col_no")) - 1
    attrs = F.create_map(F.lit("row"), F.col("row_no").cast("string"), F.lit("col"), F.col("col_no").cast("string"))
    return _segments(cells.withColumn("seg_no", number), F.lit("cell"), F.col("text"), is_cell_text(F.col("text")), attrs)
