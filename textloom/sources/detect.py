"""Document types, and reading files whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What marks a JSON file as a game text.
GAME_KEYS = r"(?i)bdat-bin:|bdat_(common|menu_mes|trial|message)_ms"
GAME_TAGS = r"\[XENO:|\[System:|\[ML:"
_BY_EXTENSION = {"srt": "srt", "vtt": "vtt", "md": "md", "markdown": "md", "html": "html", "htm": "html", "xhtml": "html", "csv": "csv", "yaml": "yaml", "yml": "yaml", "epub": "epub", "docx": "docx"}
BINARY_TYPES = ("epub", "docx")


def detect_type(name: Column, content: Column, override: Column | None = None) -> Column:
    """The type by override, else by extension; JSON is looked into for game texts; whatever is unknown is txt."""
    extension = F.lower(F.element_at(F.split(name, r"\."), -1))
    if override is not None:
        extension = F.when(override != "", F.lower(override)).otherwise(extension)
    game = content.rlike(GAME_KEYS) | content.rlike(GAME_TAGS)
    out = F.when(extension == "json", F.when(game, "json_game").otherwise("json"))
    for ext, kind in _BY_EXTENSION.items():
        out = out.when(extension == ext, kind)
    return out.otherwise("txt")


def with_types(files: DataFrame) -> DataFrame:
    override = F.col("override") if "override" in files.columns else None
    return files.withColumn("type", detect_type(F.col("file_name"), F.coalesce("content", F.lit("")), override))


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files with a stable id from their path."""
    files = spark.read.text(path, wholetext=True).select(F.col("value").alias("content"), F.col("_metadata.file_path").alias("p"))
    return files.select(F.xxhash64("p").alias("file_id"), F.element_at(F.split("p", "/"), -1).alias("file_name"), "content")


def read_binary_files(spark: SparkSession, path: str) -> DataFrame:
    """Whole binary files (e-books, word-processor documents) with a stable id from their path."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.xxhash64("path").alias("file_id"), F.element_at(F.split("path", "/"), -1).alias("file_name"), "content")
