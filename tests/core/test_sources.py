"""Extraction and rebuilding, format by format."""

import io
import json
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from textloom.functions.text import smart_chunks
from textloom.operators import rebuild
from textloom.operators.translate import TransformOptions, chunk_counts, mark, render_prompt, translate_by_column, translate_one, translate_segments
from textloom.plans.jobs import job_rows, translate_files, translate_type
from textloom.sources import detect, packages, text_formats, trees


def _files(spark, *contents, name="f.txt"):
    return spark.createDataFrame([(i, name, c) for i, c in enumerate(contents)], "file_id long, file_name string, content string")


def _texts(segments, good=True):
    rows = segments.where("translatable") if good else segments
    return [r.text for r in rows.orderBy("file_id", "seg_no").collect()]


def _chunks(spark, text, n=500, lossless=False):
    return spark.range(1).select(smart_chunks(F.lit(text), n, lossless).alias("c")).first().c


def _plain_chunks(text, limit):
    """The usual form, restated."""
    text = text.strip()
    if not text:
        return []
    ended = re.findall(r"[^.!?\n]+[.!?]+\s*", text)
    rest = text[len("".join(ended)) :].strip()
    parts = [s.strip() for s in ended] + ([rest] if rest else []) or [text]
    out, now, count = [], "", 0
    for s in parts:
        n = len(s.split())
        if count + n > limit and now:
            out.append(now.strip())
            now, count = s, n
        else:
            now, count = f"{now} {s}" if now else s, count + n
    return out + ([now.strip()] if now.strip() else [])


@pytest.mark.parametrize(
    ("text", "limit", "want"),
    [
        ("Hello world. This has no period", 100, ["Hello world. This has no period"]),
        ("just words no punctuation", 500, ["just words no punctuation"]),
        ("", 10, []),
        ("   ", 10, []),
        ("abc\ndef. ghi", 500, ["def. ef. ghi"]),
        ("!!! hello.", 500, ["hello. lo."]),
        ("3.14 is pi.", 500, ["3. 14 is pi."]),
    ],
)
def test_smart_chunks(spark, text, limit, want):
    assert _chunks(spark, text, limit) == want == _plain_chunks(text, limit)


def test_smart_chunks_bound_and_lossless(spark):
    text = " ".join(f"word{i}." for i in range(12))
    assert len(_chunks(spark, text, 5)) == 3
    assert _chunks(spark, "abc\ndef. ghi", lossless=True) == ["abc def. ghi"]
    assert _chunks(spark, "word " * 30_000)[0].startswith("word word")


def test_smart_chunks_of_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for r in docs.select("text", smart_chunks(F.col("text"), 50).alias("c")).collect():
        assert r.c == _plain_chunks(r.text, 50)


def test_txt(spark):
    read = lambda t: _texts(text_formats.txt_segments(_files(spark, t)))
    assert read("Para 1\n\nPara 2\r\n\r\nPara 3") == ["Para 1", "Para 2", "Para 3"]
    assert read("Line one\nLine two\rLine three") == ["Line one", "Line two", "Line three"]
    assert read("  only  ") == ["  only  "] and read("") == read(" \n ") == []
    long = " ".join(f"w{i}." for i in range(900))
    assert len(read(long)) == 2


def test_srt(spark):
    srt = "1\r\n00:00:01,000 --> 00:00:02,000\r\nHello\r\nthere\r\n\r\n00:00:03,000 --> 00:00:04,000\r\nWorld\r\n\r\nno timing\r\nhere\r\n\r\nlone"
    segments = text_formats.srt_segments(_files(spark, srt))
    assert _texts(segments) == ["Hello\nthere", "World"]
    out = rebuild.write_srt(translate_by_column(segments)).first().output
    assert out == "1\n00:00:01,000 --> 00:00:02,000\n[T]Hello\nthere\n\n2\n00:00:03,000 --> 00:00:04,000\n[T]World\n"


def test_vtt(spark):
    vtt = "WEBVTT - title\n\nNOTE x\n\nintro\n00:01.000 --> 00:02.000  align:start  line:0\nHello\n\n00:03.000 --> 00:04.000\nWorld"
    segments = text_formats.vtt_segments(_files(spark, vtt))
    assert _texts(segments) == ["Hello", "World"]
    out = rebuild.write_vtt(translate_by_column(segments)).first().output
    assert out == "WEBVTT - title\n\nintro\n00:01.000 --> 00:02.000  align:start line:0\n[T]Hello\n\n00:03.000 --> 00:04.000\n[T]World\n"
    assert _texts(text_formats.vtt_segments(_files(spark, "")), good=False) == ["WEBVTT"]


def test_md(spark):
    md = "# Title\ntext\n \n```js\ncode\n\nmore\n```\nafter"
    segments = text_formats.md_segments(_files(spark, md))
    assert _texts(segments) == ["# Title\ntext", "after"]
    out = rebuild.write_md(translate_by_column(segments)).first().output
    assert out == "[T]# Title\ntext\n\n```js\ncode\n\nmore\n```\n[T]after"


def test_html(spark):
    page = "<!doctype html><style>a{}</style><p>Hello <em>world</em></p><pre>x <b>y</b></pre><!-- c --><script>if (a<b)x</script>tail"
    assert _texts(trees.html_segments(_files(spark, page))) == ["<!doctype html>", "Hello ", "world"]
    assert _texts(trees.html_segments(_files(spark, page), clean=True)) == ["Hello ", "world"]
    kept = trees.html_segments(_files(spark, page)).withColumn("translated", F.col("text"))
    assert rebuild.write_html(kept).first().output == page
    out = rebuild.write_html(translate_by_column(trees.html_segments(_files(spark, "<p>Hello <em>world</em></p>")))).first().output
    assert out == "<p>[T]Hello <em>[T]world</em></p>"


def _plain_csv(content):
    """The cell states, restated."""
    rows, row, cell, quoted, i = [], [], "", False, 0
    while i < len(content):
        c = content[i]
        if quoted and content[i : i + 2] == '""':
            cell, i = cell + '"', i + 1
        elif c == '"':
            quoted = not quoted
        elif quoted or c not in ",\r\n":
            cell += c
        elif c != "\r":
            row, cell = [*row, cell], ""
            if c == "\n":
                rows, row = [*rows, row], []
        i += 1
    return rows + ([[*row, cell]] if cell or row else [])


@pytest.mark.parametrize(
    "content",
    ['a,b\n"hello, world",1\n"line\nbreak",2', "a,b\nfoo,42\nbar,-3.14\n", "", "\n", ",", 'x"y,z"w,q', '"open, never\nclosed', '"a""b"\r\n,,\n', 'a""b,"c""', "\r\n\r", "a\n\nb"],
)
def test_csv(spark, content):
    rows = spark.range(1).select(text_formats.csv_rows(F.lit(content)).alias("r")).first().r
    assert [list(r) for r in rows] == _plain_csv(content)


def test_csv_segments_and_rebuild(spark):
    segments = text_formats.csv_segments(_files(spark, 'a,b\n"x, ""y""",42\n ,-3.5'))
    assert _texts(segments) == ["a", "b", 'x, "y"']
    assert rebuild.write_csv(translate_by_column(segments)).first().output == '[T]a,[T]b\n"[T]x, ""y""",42\n ,-3.5'


def test_json(spark):
    tree = {"title": "Hello", "id": "abc", "URL": "http://x", "n": 5, "d": "42", "items": [{"name": "A", "qty": 2.0}, "  ", None, True], "10": "ten", "2": "two"}
    deep = "end"
    for _ in range(12):
        deep = {"k": deep}
    tree["deep"] = deep
    files = _files(spark, json.dumps(tree))
    segments = trees.json_segments(files)
    assert [(r.path, r.text) for r in segments.orderBy("seg_no").collect()] == [("root.2", "two"), ("root.10", "ten"), ("root.title", "Hello"), ("root.items[0].name", "A")]
    out = json.loads(rebuild.write_json(files, translate_by_column(segments)).first().output)
    assert out["title"] == "[T]Hello" and out["items"][0] == {"name": "[T]A", "qty": 2} and out["id"] == "abc"
    assert rebuild.write_json(files, segments.limit(0).withColumn("translated", F.lit("x"))).first().output.startswith('{\n  "2": "two"')
    assert _texts(trees.json_segments(_files(spark, "null", "42", "[]"))) == []
    assert _texts(trees.json_segments(_files(spark, '{"a": "x", "b": "y"}'), exclude=("a",))) == ["y"]
    assert sorted(_texts(trees.json_all_segments(_files(spark, '{"id": "x", "b": ["7"]}')))) == ["7", "x"]
    assert trees.json_depths(_files(spark, '{"a": [1, {"b": {}}]}')).first().depth == 3
    with pytest.raises(Exception, match="no valid json"):
        trees.json_segments(_files(spark, "{"), strict=True).collect()
    broken = trees.json_segments(_files(spark, "{", '{"a": "x"}', "")).orderBy("file_id").collect()
    assert [r.kind for r in broken] == ["error", "leaf", "error"] and broken[0].text.startswith("no valid json") and not broken[0].translatable
    null = spark.createDataFrame([(1, None), (2, '{"a": 1}'), (3, "[" * 5000 + "]" * 5000)], "file_id long, content string")
    assert [r.kind for r in trees.yaml_segments(null).where("file_id = 1").collect()] in ([], ["error"])
    assert {r.file_id: r.depth for r in trees.json_depths(null).collect()}[2] == 1


def test_tsv(spark):
    files = _files(spark, '{"a": "x", "b": "y"}')
    tsv = rebuild.to_tsv(trees.json_segments(files)).first().output
    assert tsv == "path\tsource_text\nroot.a\tx\nroot.b\ty"
    back = rebuild.from_tsv(spark.createDataFrame([(0, tsv.replace("\tx", "\tX") + "\nroot.b\t")], "file_id long, tsv string"))
    assert json.loads(rebuild.write_json(files, back).first().output) == {"a": "X", "b": "y"}


def test_yaml(spark):
    files = _files(spark, "title: Hello\nid: abc-123\nlist:\n  - one\n  - 2\nflag: true\n")
    segments = trees.yaml_segments(files)
    assert [(r.path, r.text) for r in segments.orderBy("seg_no").collect()] == [("title", "Hello"), ("id", "abc-123"), ("list[0]", "one")]
    import yaml

    assert yaml.safe_load(rebuild.write_yaml(files, translate_by_column(segments)).first().output) == {"title": "[T]Hello", "id": "[T]abc-123", "list": ["[T]one", 2], "flag": True}


def test_game_json(spark):
    tree = {"lines": [{"text": "[XENO:wait wait=key ]Hi [System:End]\nSecond  part"}, {"text": "こんにちは"}, {"text": "12 [3]"}, {"text": "[ML:icon ]"}, {"text": "plain"}], "caption_ms": "no"}
    files = _files(spark, json.dumps(tree))
    segments = trees.game_json_segments(files)
    assert [(r.path, r.text) for r in segments.orderBy("seg_no").collect()] == [("root.lines[0].text", "Hi\nSecond part"), ("root.lines[4].text", "plain")]
    out = json.loads(rebuild.write_game_json(files, translate_by_column(segments)).first().output)["lines"]
    assert out[0]["text"] == "[T]Hi\nSecond part[XENO:wait wait=key ][System:End]" and out[4]["text"] == "[T]plain" and out[1]["text"] == "こんにちは"
    assert _texts(trees.game_json_segments(files, exclude_japanese=False))[1] == "こんにちは"


def _book():
    made = io.BytesIO()
    with zipfile.ZipFile(made, "w") as z:
        z.writestr("mimetype", "application/epub+zip")
        z.writestr("META-INF/container.xml", '<c:container xmlns:c="urn:c"><c:rootfile media-type="x" full-path="OEBPS/content.opf"/></c:container>')
        items = '<item id="b" href="../b.xhtml" media-type="application/xhtml+xml"/><item id="a" href="t/a.xhtml" media-type="application/xhtml+xml"/><item id="c" href="c.css" media-type="text/css"/>'
        z.writestr("OEBPS/content.opf", f'<package xmlns="urn:p">{items}<itemref idref="a"/><itemref idref="b"/><itemref idref="gone"/></package>')
        z.writestr("OEBPS/t/a.xhtml", "<p>One <b>two</b></p>")
        z.writestr("b.xhtml", "<p>Three</p><pre>no</pre>")
        z.writestr("OEBPS/c.css", "p{}")
    return made.getvalue()


def test_epub(spark):
    files = spark.createDataFrame([(1, "b.epub", bytearray(_book()))], "file_id long, file_name string, content binary")
    segments = packages.epub_segments(files)
    assert _texts(segments) == ["One ", "two", "Three"]
    data = rebuild.write_epub(files, translate_by_column(segments)).first().output
    with zipfile.ZipFile(io.BytesIO(bytes(data))) as z:
        assert z.namelist()[0] == "mimetype" and z.infolist()[0].compress_type == zipfile.ZIP_STORED
        assert z.read("OEBPS/t/a.xhtml") == b"<p>[T]One <b>[T]two</b></p>" and z.read("b.xhtml") == b"<p>[T]Three</p><pre>no</pre>" and z.read("OEBPS/c.css") == b"p{}"
    entries = {r.name: r.is_chapter for r in packages.epub_entries(files).collect()}
    assert entries["b.xhtml"] and not entries["OEBPS/c.css"]
    assert translate_type(files, "epub").first().total_chunks == 3


def test_docx(spark):
    made = io.BytesIO()
    with zipfile.ZipFile(made, "w") as z:
        z.writestr("word/document.xml", '<w:body><w:p><w:r><w:t>Hello </w:t></w:r><w:r><w:t xml:space="preserve">A &amp; B</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>Two</w:t><w:tab/><w:t>x</w:t></w:r></w:p></w:body>')
    files = spark.createDataFrame([(1, "d.docx", bytearray(made.getvalue()))], "file_id long, file_name string, content binary")
    segments = packages.docx_segments(files)
    assert _texts(segments) == ["Hello A & B", "Two\tx"]
    assert rebuild.write_txt(translate_by_column(segments)).first().output == "[T]Hello A & B\n\n[T]Two\tx"


def test_types(spark):
    rows = [("a.JSON", "{}", None, "json"), ("a.json", "[XENO:x]", None, "json_game"), ("a.json", "Bdat_common_ms", None, "json_game"), ("a.markdown", "", None, "md"), ("a.htm", "", None, "html"), ("a.yml", "", None, "yaml"), ("noext", "", None, "txt"), ("a.txt", "", "srt", "srt"), ("a.txt", "[ML:x]", "json", "json_game"), ("a.json", "", "odd", "txt")]
    data = spark.createDataFrame(rows, "name string, content string, override string, want string")
    for r in data.withColumn("got", detect.detect_type(F.col("name"), F.col("content"), F.coalesce("override", F.lit("")))).collect():
        assert r.got == r.want, r


def test_readers(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("x\ny")
    (tmp_path / "in/b.txt").write_text("z")
    rows = detect.read_text_files(spark, str(tmp_path / "in")).collect()
    assert sorted((r.file_name, r.content) for r in rows) == [("a.txt", "x\ny"), ("b.txt", "z")]
    assert {bytes(r.content) for r in detect.read_binary_files(spark, str(tmp_path / "in")).collect()} == {b"x\ny", b"z"}


def test_broken_files_fail_alone(spark):
    made = io.BytesIO()
    with zipfile.ZipFile(made, "w") as z:
        z.writestr("mimetype", "application/epub+zip")
    rows = [(1, bytearray(_book())), (2, bytearray(b"no zip")), (3, None), (4, bytearray(made.getvalue()))]
    files = spark.createDataFrame(rows, "file_id long, content binary")
    for kind, good in (("epub", {1}), ("docx", set())):
        out = {r.file_id: r for r in job_rows(translate_type(files, kind)).collect()}
        assert {i for i, r in out.items() if r.status == "completed"} == good and all(r.error for i, r in out.items() if i not in good)
    text = spark.createDataFrame([(1, '{"a": "b"}'), (2, "{"), (3, None)], "file_id long, content string")
    for kind in ("json", "json_game", "yaml"):
        out = {r.file_id: r for r in translate_type(text, kind).collect()}
        assert "[T]b" in out[1].output and out[1].error is None and (out[2].output, out[2].total_chunks) == ("", 0) and out[2].error


def test_router(spark):
    rows = [(1, "a.txt", "one\ntwo"), (2, "b.md", "x\n\ny"), (3, "c.json", '{"a": "b"}'), (4, "d.csv", "a,1"), (5, "e.yaml", "k: v"), (6, "f.html", "<p>t</p>"), (7, "g.txt", "")]
    out = {r.file_id: r for r in translate_files(spark.createDataFrame(rows, "file_id long, file_name string, content string")).collect()}
    assert {i: r.type for i, r in out.items()} == {1: "txt", 2: "md", 3: "json", 4: "csv", 5: "yaml", 6: "html", 7: "txt"}
    assert (out[1].total_chunks, out[1].processed_chunks, out[4].total_chunks, out[3].total_chunks) == (2, 2, 1, 1)
    assert out[1].output == "[T]one\n\n[T]two" and out[6].output == "<p>[T]t</p>" and out[4].output == "[T]a,1" and out[7].total_chunks == 0


def test_router_with_staging_calls_once(spark, tmp_path):
    rows = [(1, "a.txt", "one\ntwo"), (2, "b.json", '{"a": "b"}')]
    calls = spark.sparkContext.accumulator(0)

    def translator(text, prompt):
        calls.add(1)
        return f"<{text}>"

    files = spark.createDataFrame(rows, "file_id long, file_name string, content string")
    out = translate_files(files, lambda s: translate_segments(s, translator), ("txt", "json"), str(tmp_path / "staging")).collect()
    assert sorted(r.output for r in out) == ["<one>\n\n<two>", '{\n  "a": "<b>"\n}'] and calls.value == 3


def test_translate_with_retry_and_fall_back(spark):
    segments = text_formats.txt_segments(_files(spark, "good\nbad\n-\nskip")).withColumn("translatable", F.col("text") != "skip")

    def translator(text, prompt):
        if text == "bad":
            raise RuntimeError("no")
        return "" if text == "-" else text.upper()

    rows = translate_segments(segments, translator, TransformOptions(attempts=2, first_wait_s=0)).orderBy("seg_no").collect()
    assert [(r.translated, r.ok, r.error) for r in rows] == [("GOOD", True, None), ("bad", False, "no"), ("-", False, "Empty translation"), ("skip", True, None)]
    counts = chunk_counts(translate_segments(segments, translator, TransformOptions(attempts=1, first_wait_s=0))).first()
    assert (counts.total_chunks, counts.processed_chunks, counts.failed_chunks) == (3, 1, 2)
    calls = []
    assert translate_one("x", lambda t, p: calls.append(p) or "", TransformOptions(first_wait_s=0)) == ("x", False, "Empty translation") and len(calls) == 3
    assert translate_one(" ", mark, TransformOptions()) == (" ", True, None) and translate_one(None, mark, TransformOptions()) == (None, True, None)
    assert render_prompt("en", "ar", '- "a" -> "b"').endswith('\n- "a" -> "b"') and "written in en" in render_prompt("en", "ar")


def test_markdown_of_many_lines_stays_in_order(spark):
    text = "\n".join(f"l{i}" if i % 3 else "" for i in range(500))
    segments = text_formats.md_segments(_files(spark, text)).withColumn("translated", F.col("text"))
    assert rebuild.write_md(segments).first().output == text
