"""Zipped formats: e-books and word-processor documents. `content` is binary."""

from __future__ import annotations

import html
import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..jsstr import trim, unix_lines
from ..schema import ERROR
from ..session import small_batches
from .text_formats import _segments
from .trees import html_tokens

_CONTAINER = "META-INF/container.xml"
_PARAGRAPH = re.compile(r"<w:p(?: [^>]*)?/>|<w:p[ >].*?</w:p>", re.S)
_RUN = re.compile(r"<w:t(?: [^>]*)?>([^<]*)</w:t>|<w:(tab|br|cr)(?: [^>]*)?/>")


def resolve(base: str, relative: str) -> str:
    """A path within a package, from the folder of the file that names it; a leading slash starts at the package's root."""
    return posixpath.normpath(posixpath.join("/", base, relative)).lstrip("/")


def _elements(document: bytes, name: str) -> list[dict[str, str]]:
    """Attributes of all elements of a name, in any namespace, in document order."""
    return [e.attrib for e in ElementTree.fromstring(document).iter() if isinstance(e.tag, str) and e.tag.rpartition("}")[2] == name]


def chapters(package: zipfile.ZipFile) -> list[str]:
    """Names of the chapters, in reading order."""
    names = set(package.namelist())
    if _CONTAINER not in names:
        raise ValueError(f"no {_CONTAINER}")
    roots = [a["full-path"] for a in _elements(package.read(_CONTAINER), "rootfile") if a.get("full-path") in names]
    if not roots:
        raise ValueError("no package document")
    book = package.read(roots[0])
    manifest = {a["id"]: a for a in _elements(book, "item") if "id" in a and "href" in a}
    order = [manifest[a["idref"]] for a in _elements(book, "itemref") if a.get("idref") in manifest]
    pages = [resolve(posixpath.dirname(roots[0]), a["href"]) for a in order if "html" in a.get("media-type", "")]
    return [page for page in pages if page in names]


def _opened(content: bytes | None) -> zipfile.ZipFile:
    return zipfile.ZipFile(io.BytesIO(content or b""))


def _text_nodes(content: bytes | None) -> Iterator[tuple[str, str, int, int]]:
    with _opened(content) as package:
        for path in chapters(package):
            page = package.read(path).decode("utf-8", "replace")
            for a, b, kind, good in html_tokens(page):
                if kind == "text" and good:
                    yield path, page[a:b], a, b


def epub_segments(files: DataFrame) -> DataFrame:
    """Text nodes of the chapters in reading order, with chapter and place; one row of kind error for a broken package."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for file_id, content in zip(batch["file_id"], batch["content"], strict=True):
                try:
                    out += [(file_id, number, *node, False) for number, node in enumerate(list(_text_nodes(content)))]
                except Exception as error:
                    out.append((file_id, 0, None, f"no valid e-book: {error}", 0, 0, True))
            yield pd.DataFrame(out, columns=["file_id", "seg_no", "path", "text", "start", "end", "error"])

    small_batches(files.sparkSession)
    rows = files.select("file_id", "content").mapInPandas(read, "file_id long, seg_no int, path string, text string, start int, end int, error boolean")
    attrs = F.create_map(F.lit("start"), F.col("start").cast("string"), F.lit("end"), F.col("end").cast("string"))
    return _segments(rows, F.when(F.col("error"), ERROR).otherwise("node"), F.col("text"), ~F.col("error"), attrs, F.col("path"))


def epub_entries(files: DataFrame) -> DataFrame:
    """(file_id, name, is_chapter, data) of every file of a package: the chapters and what is passed through."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for file_id, content in zip(batch["file_id"], batch["content"], strict=True):
                try:
                    with _opened(content) as package:
                        own = set(chapters(package))
                        out += [(file_id, i.filename, i.filename in own, package.read(i)) for i in package.infolist() if not i.is_dir()]
                except Exception:  # a broken package has no entries; `epub_segments` says why
                    continue
            yield pd.DataFrame(out, columns=["file_id", "name", "is_chapter", "data"])

    small_batches(files.sparkSession)
    return files.select("file_id", "content").mapInPandas(read, "file_id long, name string, is_chapter boolean, data binary")


def docx_text(content: bytes | None) -> str:
    """Raw text: each paragraph followed by an empty line; tabs and breaks kept."""
    with _opened(content) as package:
        body = package.read("word/document.xml").decode("utf-8", "replace")
    marks = {"tab": "\t", "br": "\n", "cr": "\n"}
    out = []
    for p in _PARAGRAPH.findall(body):
        out.append("".join(marks[m[2]] if m[2] else html.unescape(m[1]) for m in _RUN.finditer(p)))
    return "".join(f"{p}\n\n" for p in out)


def docx_segments(files: DataFrame) -> DataFrame:
    """Paragraphs of the raw text that are not blank, trimmed; one row of kind error for a broken document."""

    def told(content: bytes | None) -> tuple[str, bool]:
        try:
            return docx_text(content), False
        except Exception as error:
            return f"no valid document: {error}", True

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [told(c) for c in batch["content"]]
            yield pd.DataFrame({"file_id": batch["file_id"], "content": [t for t, _ in found], "error": [e for _, e in found]})

    small_batches(files.sparkSession)
    texts = files.select("file_id", "content").mapInPandas(read, "file_id long, content string, error boolean")
    parts = F.filter(F.transform(F.split(unix_lines(F.col("content")), r"\n\n+"), trim), lambda p: p != "")
    rows = texts.select("file_id", "error", F.posexplode(parts).alias("seg_no", "text"))
    return _segments(rows, F.when(F.col("error"), ERROR).otherwise("text"), F.col("text"), ~F.col("error"))
