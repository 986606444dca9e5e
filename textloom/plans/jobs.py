"""A translation job over many files: detect, extract, transform, rebuild."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import rebuild
from ..operators.translate import translate_by_column
from ..schema import ERROR
from ..sources import EXTRACTORS, with_types

TEXT_TYPES = ("txt", "srt", "vtt", "md", "html", "csv", "json", "json_game", "yaml")
PACKAGE_TYPES = ("epub", "docx")
MAY_FAIL = ("json", "json_game", "yaml", *PACKAGE_TYPES)  # formats with files that cannot be read
_TREE_WRITERS = {"json": rebuild.write_json, "json_game": rebuild.write_game_json, "yaml": rebuild.write_yaml}
_WRITERS = {"txt": rebuild.write_txt, "srt": rebuild.write_srt, "vtt": rebuild.write_vtt, "md": rebuild.write_md, "html": rebuild.write_html, "csv": rebuild.write_csv, "docx": rebuild.write_txt}

Transform = Callable[[DataFrame], DataFrame]


def translate_type(files: DataFrame, kind: str, transform: Transform = translate_by_column, settings: dict | None = None) -> DataFrame:
    """(file_id, type, output, total_chunks, processed_chunks, failed_chunks, error) of files of one type; `settings` go to its reader.

    A file without any chunk is rebuilt as it is where its format allows that, and has zero counts. A file that cannot be read
    has an error, and an empty output; it stops no other.
    """
    segments = EXTRACTORS[kind](files, **(settings or {}))
    errors = segments.where(F.col("kind") == ERROR)
    return _written(files, transform(segments.where(F.col("kind") != ERROR)), errors, kind)


def outputs_of_type(files: DataFrame, segments: DataFrame, kind: str) -> DataFrame:
    """The same of segments that are translated already (`translated`, `ok`), rows of unreadable files among them."""
    return _written(files, segments.where(F.col("kind") != ERROR), segments.where(F.col("kind") == ERROR), kind)


def _written(files: DataFrame, translated: DataFrame, errors: DataFrame, kind: str) -> DataFrame:
    errors = errors.select("file_id", F.col("text").alias("error"))
    if kind in _TREE_WRITERS:
        outputs = _TREE_WRITERS[kind](files, translated)
    elif kind == "epub":
        outputs = rebuild.write_epub(files, translated).withColumn("output", F.base64("output"))
    else:
        outputs = _WRITERS[kind](translated)
    # The counts come with the outputs: segments are transformed once, which matters where the transform is an external call.
    rows = files.select("file_id").join(outputs, "file_id", "left").fillna(0, ["total_chunks", "failed_chunks"])
    processed = (F.col("total_chunks") - F.col("failed_chunks")).alias("processed_chunks")
    rows = rows.join(errors, "file_id", "left") if kind in MAY_FAIL else rows.withColumn("error", F.lit(None).cast("string"))
    if "write_error" in rows.columns:
        rows = rows.withColumn("error", F.coalesce("error", "write_error"))
    return rows.select("file_id", F.lit(kind).alias("type"), F.coalesce("output", F.lit("")).alias("output"), "total_chunks", processed, "failed_chunks", "error")


def translate_files(files: DataFrame, transform: Transform = translate_by_column, types: tuple[str, ...] = TEXT_TYPES, staging: str | None = None, settings: dict[str, dict] | None = None) -> DataFrame:
    """All files (file_id, file_name, content), each by its type; `settings` of a type go to its reader.

    With `staging`, the files are written there by type first, so that each format reads its own files only.
    """
    typed = with_types(files).select("file_id", "content", "type")
    if staging is not None:
        typed.write.mode("overwrite").partitionBy("type").parquet(staging)
        typed = files.sparkSession.read.schema(typed.schema).parquet(staging)
    parts = [translate_type(typed.where(F.col("type") == kind).select("file_id", "content"), kind, transform, (settings or {}).get(kind)) for kind in types]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def job_rows(results: DataFrame) -> DataFrame:
    """Results as job rows: status, progress, counts and error. `processed_chunks` leaves failed ones out, `progress` does not."""
    failed = F.col("error").isNotNull()
    status, progress = F.when(failed, "failed").otherwise("completed"), F.when(failed, 0.0).otherwise(100.0)
    return results.select("file_id", "type", status.alias("status"), progress.alias("progress"), "total_chunks", "processed_chunks", "failed_chunks", "error")
