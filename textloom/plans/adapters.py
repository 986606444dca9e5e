"""Views of plain tables as job data; each has the same definition in SQL beside it."""

from __future__ import annotations

import html
import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import small_batches


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), F.concat("source", F.lit(".txt")).alias("file_name"), F.col("text").alias("content"))


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("file_id"), F.lit("page.html").alias("file_name"), F.col("html").alias("content"))


def translations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id AS id",
        "doc_id % 50 AS user_id",
        "doc_id AS uploaded_file_id",
        "lang AS source_language",
        "CASE doc_id % 3 WHEN 0 THEN 'ar' WHEN 1 THEN 'en' ELSE 'ja' END AS target_language",
        "CASE doc_id % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'processing' WHEN 2 THEN 'completed' WHEN 3 THEN 'failed' ELSE 'paused' END AS status",
        "timestampadd(MINUTE, cast((doc_id * 7919) % 100000 AS int), timestamp'2024-01-01 00:00:00') AS created_at",
        "cast(n_chars % 97 AS int) AS total_chunks",
        "cast(n_chars % 97 AS int) - cast(n_chars % 2 AS int) * cast(n_chars % 97 > 0 AS int) AS processed_chunks",
    )


TRANSLATIONS = """translations AS (
  SELECT doc_id AS id, doc_id % 50 AS user_id, doc_id AS uploaded_file_id, lang AS source_language,
    CASE doc_id % 3 WHEN 0 THEN 'ar' WHEN 1 THEN 'en' ELSE 'ja' END AS target_language,
    CASE doc_id % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'processing' WHEN 2 THEN 'completed' WHEN 3 THEN 'failed' ELSE 'paused' END AS status,
    TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST((doc_id * 7919) % 100000 AS INTEGER)) AS created_at,
    CAST(n_chars % 97 AS INTEGER) AS total_chunks,
    CAST(n_chars % 97 AS INTEGER) - CAST(n_chars % 2 AS INTEGER) * CAST(n_chars % 97 > 0 AS INTEGER) AS processed_chunks
  FROM documents)"""


def glossary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").selectExpr(
        "item_id AS id",
        "item_id % 5 AS user_id",
        "split(text, ' ')[0] AS term",
        "concat('<', split(text, ' ')[1], '>') AS translation",
        "CASE WHEN item_id % 3 = 0 THEN NULL ELSE split(text, ' ')[2] END AS notes",
        "CASE item_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'en' ELSE 'fr' END AS source_language",
        "CASE item_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'ar' ELSE 'en' END AS target_language",
    )


GLOSSARY = """glossary AS (
  SELECT item_id AS id, item_id % 5 AS user_id, string_split(text, ' ')[1] AS term, '<' || string_split(text, ' ')[2] || '>' AS translation,
    CASE WHEN item_id % 3 = 0 THEN NULL ELSE string_split(text, ' ')[3] END AS notes,
    CASE item_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'en' ELSE 'fr' END AS source_language,
    CASE item_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'ar' ELSE 'en' END AS target_language
  FROM benchmark)"""

LANGUAGE_NAMES = """languages(code, name, english_name) AS (VALUES {rows})"""


def subtitle_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as cues of two seconds."""
    clock = lambda n: f"format_string('%02d:%02d:%02d,000', cast(({n}) div 3600 AS int), cast(({n}) div 60 % 60 AS int), cast(({n}) % 60 AS int))"
    return table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", "role", "text", f"{clock('turn * 2')} AS start", f"{clock('turn * 2 + 1')} AS end")


def _joined(rows: DataFrame, piece, separator: str, head: str = "") -> DataFrame:
    turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", piece.alias("p")))).alias("t"))
    return turns.select(F.col("conv_id").alias("file_id"), F.concat(F.lit(head), F.array_join(F.transform("t", lambda x: x.p), separator)).alias("content"))


def srt_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    piece = F.concat((F.col("turn") + 1).cast("string"), F.lit("\r\n"), "start", F.lit(" --> "), "end", F.lit("\r\n"), "text")
    return _joined(subtitle_rows(spark, sf_dir), piece, "\r\n\r\n").withColumn("file_name", F.lit("talk.srt"))


def vtt_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    point = lambda c: F.replace(F.col(c), F.lit(","), F.lit("."))
    settings = F.when(F.col("turn") % 2 == 1, "  align:start").otherwise("")
    piece = F.concat(F.col("role"), F.lit("\n"), point("start"), F.lit(" --> "), point("end"), settings, F.lit("\n"), "text")
    return _joined(subtitle_rows(spark, sf_dir), piece, "\n\n", "WEBVTT\n\n").withColumn("file_name", F.lit("talk.vtt"))


def md_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    fenced = F.concat(F.lit("```\n"), "text", F.lit("\n\nend\n```"))
    piece = F.when(F.col("role") == "assistant", fenced).otherwise(F.col("text"))
    return _joined(table(spark, sf_dir, "conversations"), piece, "\n\n").withColumn("file_name", F.lit("talk.md"))


def csv_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of a nation as CSV, names in quotes with a comma, a quote and a break inside."""
    rows = table(spark, sf_dir, "customer").withColumn("name", F.concat(F.lit('"'), "c_name", F.lit(', ""x""\n'), "c_mktsegment", F.lit('"')))
    line = F.concat_ws(",", F.col("c_custkey").cast("string"), "name", "c_mktsegment")
    per = rows.groupBy("c_nationkey").agg(F.array_sort(F.collect_list(F.struct("c_custkey", line.alias("l")))).alias("t"))
    return per.select(F.col("c_nationkey").cast("long").alias("file_id"), F.concat(F.lit("key,name,segment\n"), F.array_join(F.transform("t", lambda x: x.l), "\n")).alias("content"))


def json_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as JSON: technical keys, numbers and texts at two depths."""
    rows = table(spark, sf_dir, "conversations").withColumn("m", F.struct(F.col("turn").cast("string").alias("number"), F.col("role").alias("id"), "text", F.struct(F.col("role").alias("label")).alias("who")))
    per = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "m"))).alias("t"))
    content = F.to_json(F.struct(F.lit("talk").alias("title"), F.transform("t", lambda x: x.m).alias("messages")))
    return per.select(F.col("conv_id").alias("file_id"), F.lit("talk.json").alias("file_name"), content.alias("content"))


def customer_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of a nation as a JSON list of labels and segments."""
    per = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.array_sort(F.collect_list(F.struct("c_custkey", "c_name", "c_mktsegment"))).alias("t"))
    items = F.transform("t", lambda x: F.struct(x.c_name.alias("label"), x.c_mktsegment.alias("segment")))
    return per.select(F.col("c_nationkey").cast("long").alias("file_id"), F.lit("c.json").alias("file_name"), F.to_json(F.struct(items.alias("items"))).alias("content"))


def yaml_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of a nation as block YAML with a quoted string, numbers, a list and a text of two lines."""
    per = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.array_sort(F.collect_list(F.struct("c_custkey", "c_name", "c_mktsegment"))).alias("t"))
    item = F.transform("t", lambda x: F.concat(F.lit("  - number: "), x.c_custkey.cast("string"), F.lit("\n    name: "), x.c_name, F.lit("\n    notes:\n      - in "), x.c_mktsegment, F.lit("\n      - |\n        two\n        lines\n      - 7\n")))
    content = F.concat(F.lit("# made from rows\ntitle: 'customers: all'\ncustomers:\n"), F.array_join(item, ""))
    return per.select(F.col("c_nationkey").cast("long").alias("file_id"), F.lit("c.yaml").alias("file_name"), content.alias("content"))


def game_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as game JSON: a tag before each text, and numbers."""
    rows = table(spark, sf_dir, "conversations")
    item = F.struct(F.col("turn").cast("string").alias("number"), F.concat(F.lit("[XENO:wait ]"), "text").alias("text"))
    per = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", item.alias("m")))).alias("t"))
    return per.select(F.col("conv_id").alias("file_id"), F.lit("talk.json").alias("file_name"), F.to_json(F.struct(F.transform("t", lambda x: x.m).alias("messages"))).alias("content"))


def _zipped(rows: DataFrame, entries) -> DataFrame:
    """(file_id, file_name, content): a package for each conversation; `entries` gives its names and texts from turns."""
    per = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))

    def pack(batches):
        for batch in batches:
            made = []
            for turns in batch["t"]:
                held = io.BytesIO()
                with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
                    for name, data in entries(turns):
                        z.writestr(name, data)
                made.append(held.getvalue())
            yield pd.DataFrame({"file_id": batch["conv_id"], "content": made})

    small_batches(rows.sparkSession)
    return per.mapInPandas(pack, "file_id long, content binary").withColumn("file_name", F.lit("package"))


def epub_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as e-books: a chapter for each turn, a style sheet, and a page that is in no reading order."""

    def entries(turns):
        names = [f"ch{t['turn']}.xhtml" for t in turns]
        items = "".join(f'<item media-type="application/xhtml+xml" href="{n}" id="i{k}"/>' for k, n in enumerate(names))
        spine = "".join(f'<itemref idref="i{k}"/>' for k in range(len(names)))
        yield "mimetype", "application/epub+zip"
        yield "META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile media-type="application/oebps-package+xml" full-path="OEBPS/content.opf"/></rootfiles></container>'
        yield "OEBPS/content.opf", f'<package xmlns="http://www.idpf.org/2007/opf"><manifest>{items}<item id="css" href="style.css" media-type="text/css"/></manifest><spine>{spine}<itemref idref="lost"/></spine></package>'
        yield "OEBPS/style.css", "p { margin: 0 }"
        yield "OEBPS/note.xhtml", "<html><body><p>not read</p></body></html>"
        for name, t in zip(names, turns, strict=True):
            yield f"OEBPS/{name}", f"<html><head></head><body><h1>{t['role']}</h1><p>{html.escape(t['text'], quote=False)}</p></body></html>"

    return _zipped(table(spark, sf_dir, "conversations"), entries)


def docx_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as word-processor documents: a paragraph for each turn, its line breaks as breaks."""

    def entries(turns):
        runs = lambda text: "<w:br/>".join(f'<w:t xml:space="preserve">{html.escape(line, quote=False)}</w:t>' for line in text.split("\n"))
        body = "".join(f"<w:p><w:r>{runs(t['text'])}</w:r></w:p>" for t in turns)
        yield "word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>'

    return _zipped(table(spark, sf_dir, "conversations"), entries)


def text_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents with tags, and copies of them that lose, gain or break something, by the document's number."""
    docs = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL AND length(text) > 0")
    original = F.concat(F.lit("[XENO:wait a=b ]"), "text", F.lit("[System:Color name=x ]"), F.when(F.col("doc_id") % 2 == 0, F.lit("\nmore words here")).otherwise(""), F.lit("[/System:Color]"))
    k = F.col("doc_id") % 5
    translation = (
        F.when(k == 0, original)
        .when(k == 1, F.replace(original, F.lit("[XENO:wait a=b ]"), F.lit("")))
        .when(k == 2, F.concat(original, F.lit("[ML:icon ]")))
        .when(k == 3, F.replace(original, F.lit("[/System:Color]"), F.lit("[/System:Other]")))
        .otherwise(F.replace(original, F.lit("\n"), F.lit(" ")))
    )
    return docs.select(F.lit(0).cast("long").alias("file_id"), F.col("doc_id").cast("int").alias("seg_no"), F.concat(F.lit("root.l"), F.col("doc_id").cast("string")).alias("path"), F.concat(F.lit("l"), F.col("doc_id").cast("string")).alias("key"), original.alias("original"), translation.alias("translation"))
