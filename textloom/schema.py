"""Table schemas and the fixed values of the data model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in columns.items()])


_I, _S, _TS = T.IntegerType(), T.StringType(), T.TimestampType()

USERS = _table(id=_I, open_id=_S, name=_S, email=_S, login_method=_S, role=_S, created_at=_TS, updated_at=_TS, last_signed_in=_TS)
UPLOADED_FILES = _table(id=_I, user_id=_I, file_name=_S, file_type=_S, file_size=_I, file_key=_S, file_url=_S, created_at=_TS)
TRANSLATIONS = _table(
    id=_I, user_id=_I, uploaded_file_id=_I, source_language=_S, target_language=_S, status=_S, progress=T.FloatType(), translated_file_key=_S, translated_file_url=_S,
    error_message=_S, total_chunks=_I, processed_chunks=_I, created_at=_TS, updated_at=_TS, completed_at=_TS,
)
GLOSSARY_ENTRIES = _table(id=_I, user_id=_I, term=_S, translation=_S, notes=_S, source_language=_S, target_language=_S, created_at=_TS, updated_at=_TS)

FILES = _table(file_id=T.LongType(), file_name=_S, content=_S)
PACKAGES = _table(file_id=T.LongType(), file_name=_S, content=T.BinaryType())
SEGMENTS = _table(file_id=T.LongType(), seg_no=_I, kind=_S, path=_S, text=_S, translatable=T.BooleanType(), attrs=T.MapType(_S, _S))

#: Kind of the one segment of a file that cannot be read; its text says why.
ERROR = "error"

# Job states, in order of life.
STATUSES = ("pending", "processing", "completed", "failed", "paused")

# Languages by code, own name, English name, and whether they are written from right to left.
LANGUAGES = (
    ("en", "English", "English", False),
    ("ar", "العربية", "Arabic", True),
    ("fr", "Français", "French", False),
    ("es", "Español", "Spanish", False),
    ("de", "Deutsch", "German", False),
    ("it", "Italiano", "Italian", False),
    ("pt", "Português", "Portuguese", False),
    ("ru", "Русский", "Russian", False),
    ("ja", "日本語", "Japanese", False),
    ("ko", "한국어", "Korean", False),
    ("zh", "中文", "Chinese", False),
    ("tr", "Türkçe", "Turkish", False),
    ("pl", "Polski", "Polish", False),
    ("nl", "Nederlands", "Dutch", False),
    ("sv", "Svenska", "Swedish", False),
    ("no", "Norsk", "Norwegian", False),
    ("da", "Dansk", "Danish", False),
    ("fi", "Suomi", "Finnish", False),
    ("el", "Ελληνικά", "Greek", False),
    ("cs", "Čeština", "Czech", False),
    ("hu", "Magyar", "Hungarian", False),
    ("ro", "Română", "Romanian", False),
    ("th", "ไทย", "Thai", False),
    ("vi", "Tiếng Việt", "Vietnamese", False),
    ("id", "Bahasa Indonesia", "Indonesian", False),
    ("ms", "Bahasa Melayu", "Malay", False),
    ("hi", "हिन्दी", "Hindi", False),
    ("bn", "বাংলা", "Bengali", False),
    ("ur", "اردو", "Urdu", True),
    ("fa", "فارسی", "Persian", True),
    ("he", "עברית", "Hebrew", True),
)

# Media types by document type and by file extension.
MEDIA_BY_TYPE = {
    "json": "application/json",
    "json_game": "application/json",
    "srt": "application/x-subrip",
    "vtt": "text/vtt",
    "txt": "text/plain",
    "md": "text/markdown",
    "html": "text/html",
    "csv": "text/csv",
    "yaml": "text/yaml",
    "epub": "application/epub+zip",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
}
MEDIA_BY_EXTENSION = {
    "json": "application/json",
    "srt": "application/x-subrip",
    "vtt": "text/vtt",
    "txt": "text/plain",
    "md": "text/markdown",
    "markdown": "text/markdown",
    "html": "text/html",
    "htm": "text/html",
    "xhtml": "application/xhtml+xml",
    "csv": "text/csv",
    "yaml": "text/yaml",
    "yml": "text/yaml",
    "epub": "application/epub+zip",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
}
UPLOAD_EXTENSIONS = tuple(MEDIA_BY_EXTENSION)
UPLOAD_LIMIT_BYTES = 25 * 1024 * 1024


def languages(spark: SparkSession) -> DataFrame:
    """The language dimension: 31 rows, small by construction."""
    return spark.createDataFrame(LANGUAGES, "code string, name string, english_name string, rtl boolean")
