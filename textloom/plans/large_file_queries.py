"""Queries over files that are written from tables and read back in byte ranges."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import shared_folder
from ..sources import large_files
from . import adapters as A
from .queries import MD_RUNS, query


@query(
    """SELECT c_custkey AS key, CAST(unnest([0, 1, 2, 3]) AS INTEGER) AS col_no, unnest([CAST(c_custkey AS VARCHAR), c_name || ', "x"' || chr(10) || upper(c_name), '', c_mktsegment]) AS text,
  unnest([false, true, false, true]) AS translatable FROM customer"""
)
def csv_large_files(spark, sf_dir):
    """All customers as CSV with quotes, commas and line feeds in quotes, in files of many rows that are read in byte ranges."""
    path = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    line = F.concat_ws(",", F.col("c_custkey").cast("string"), F.concat(F.lit('"'), "c_name", F.lit(', ""x""\n'), F.upper("c_name"), F.lit('"')), F.lit(""), "c_mktsegment")
    A.table(spark, sf_dir, "customer").select(line.alias("value")).write.text(path)
    rows = large_files.csv_file_rows(spark, path)
    cells = rows.select(F.get("cells", F.lit(0)).cast("long").alias("key"), F.posexplode("cells").alias("col_no", "text"))
    return cells.withColumn("translatable", large_files.is_cell_text(F.col("text")))


@query(f"""WITH {MD_RUNS} SELECT kind, digest, count(*) AS n FROM (
  SELECT min(kind) AS kind, md5(string_agg(line, chr(10) ORDER BY no)) AS digest FROM runs GROUP BY file_id, seg_no) WHERE kind <> 'blank' GROUP BY kind, digest""")
def md_large_files(spark, sf_dir):
    """All conversations as Markdown with fences, in files of many conversations that are read in byte ranges."""
    path = f"{shared_folder(spark)}/md-{uuid.uuid4().hex}"
    A.md_files(spark, sf_dir).select(F.concat(F.lit("\n"), "content").alias("value")).write.text(path)
    blocks = large_files.markdown_file_blocks(spark, path).where("kind <> 'blank'")
    return blocks.groupBy("kind", F.md5("text").alias("digest")).agg(F.count("*").alias("n"))
