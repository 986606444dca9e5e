"""Registered queries of the formats that are read and rebuilt whole: e-books, documents, YAML, game JSON, tables of paths."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import rebuild
from ..operators.translate import TransformOptions, mark, translate_by_column, translate_segments
from ..session import shared_folder
from ..sources import detect, packages, text_formats, trees
from . import adapters as A
from . import jobs
from .queries import PARAGRAPHS, query

_ESCAPED = "replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_CHAPTERS = f"""nodes AS (SELECT conv_id AS file_id, 'OEBPS/ch' || turn || '.xhtml' AS path, 2 * (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) AS first, role, {_ESCAPED.format("text")} AS text FROM conversations),
texts AS (SELECT file_id, CAST(first AS INTEGER) AS seg_no, path, role AS text FROM nodes UNION ALL SELECT file_id, CAST(first + 1 AS INTEGER), path, text FROM nodes)"""


@query(f"WITH {_CHAPTERS} SELECT file_id, seg_no, path, text FROM texts")
def epub_texts(spark, sf_dir):
    return packages.epub_segments(A.epub_files(spark, sf_dir)).select("file_id", "seg_no", "path", "text")


@query(f"WITH {_CHAPTERS} SELECT file_id, seg_no, path, '[T]' || text AS text FROM texts")
def epub_rebuild(spark, sf_dir):
    """Books rebuilt from translated chapters and read again."""
    files = A.epub_files(spark, sf_dir)
    out = rebuild.write_epub(files, translate_by_column(packages.epub_segments(files)))
    return packages.epub_segments(out.select("file_id", F.col("output").alias("content"))).select("file_id", "seg_no", "path", "text")


@query("""SELECT conv_id AS file_id, name, name LIKE '%.xhtml' AND name NOT LIKE '%note%' AS is_chapter FROM (
  SELECT DISTINCT conv_id, unnest(['mimetype', 'META-INF/container.xml', 'OEBPS/content.opf', 'OEBPS/style.css', 'OEBPS/note.xhtml', 'OEBPS/ch' || turn || '.xhtml']) AS name FROM conversations)""")
def epub_entries(spark, sf_dir):
    """Every file of a package: chapters of the reading order, and all that is passed through."""
    return packages.epub_entries(A.epub_files(spark, sf_dir)).select("file_id", "name", "is_chapter")


_DOCX = r"""whole AS (SELECT conv_id AS file_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS t FROM conversations GROUP BY conv_id),
parts AS (SELECT file_id, list_filter(list_transform(regexp_split_to_array(t, '\n\n+'), lambda p: trim(p, ' ' || chr(9) || chr(10) || chr(13))), lambda p: p <> '') AS p FROM whole)"""


@query(f"WITH {_DOCX} SELECT file_id, CAST(generate_subscripts(p, 1) - 1 AS INTEGER) AS seg_no, unnest(p) AS text FROM parts")
def docx_paragraphs(spark, sf_dir):
    return packages.docx_segments(A.docx_files(spark, sf_dir)).select("file_id", "seg_no", "text")


@query(f"""WITH {_DOCX} SELECT file_id, md5(array_to_string(list_transform(p, lambda x: '[T]' || x), chr(10) || chr(10))) AS digest, len(p) AS total_chunks FROM parts""")
def docx_rebuild(spark, sf_dir):
    out = jobs.translate_type(A.docx_files(spark, sf_dir), "docx")
    return out.select("file_id", F.md5("output").alias("digest"), "total_chunks")


_YAML = """rows AS (SELECT CAST(c_nationkey AS BIGINT) AS file_id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS i, c_name, c_mktsegment FROM customer),
leaves AS (SELECT DISTINCT file_id, 'title' AS path, 'customers: all' AS text FROM rows UNION ALL SELECT file_id, 'customers[' || i || '].name', c_name FROM rows
  UNION ALL SELECT file_id, 'customers[' || i || '].notes[0]', 'in ' || c_mktsegment FROM rows UNION ALL SELECT file_id, 'customers[' || i || '].notes[1]', 'two' || chr(10) || 'lines' || chr(10) FROM rows)"""


@query(f"WITH {_YAML} SELECT file_id, path, text FROM leaves")
def yaml_leaves(spark, sf_dir):
    return trees.yaml_segments(A.yaml_files(spark, sf_dir)).select("file_id", "path", "text")


@query(f"WITH {_YAML} SELECT file_id, path, '[T]' || text AS text FROM leaves")
def yaml_rebuild(spark, sf_dir):
    """YAML written with translated strings and read again."""
    files = A.yaml_files(spark, sf_dir)
    out = rebuild.write_yaml(files, translate_by_column(trees.yaml_segments(files)))
    return trees.yaml_segments(out.select("file_id", F.col("output").alias("content"))).select("file_id", "path", "text")


_GAME = r"""items AS (SELECT conv_id AS file_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, turn, text AS said,
  trim(regexp_replace(regexp_replace(regexp_replace(text, '[ \xA0]+', ' ', 'g'), '[ \t]+\n', chr(10), 'g'), '\n[ \t]+', chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13)) AS clean FROM conversations)"""


@query(f"""WITH {_GAME} SELECT file_id, 'root.messages[' || i || '].text' AS path, clean AS text, '[XENO:wait ]' || said AS original, '1' AS tags FROM items""")
def game_texts(spark, sf_dir):
    rows = trees.game_json_segments(A.game_files(spark, sf_dir), exclude_japanese=False)
    return rows.select("file_id", "path", "text", F.col("attrs")["original"].alias("original"), F.col("attrs")["tags"].alias("tags"))


@query(f"""WITH {_GAME} SELECT file_id, 'root.messages[' || i || '].text' AS path, md5(regexp_replace('[T]' || clean || '[XENO:wait ]', '\\s+', '', 'g')) AS digest FROM items""")
def game_rebuild(spark, sf_dir):
    """Game JSON rebuilt with its tags and read again; white space is left out, as lines may be laid out anew."""
    files = A.game_files(spark, sf_dir)
    out = rebuild.write_game_json(files, translate_by_column(trees.game_json_segments(files, exclude_japanese=False)))
    read = trees.json_all_segments(out.select("file_id", F.col("output").alias("content")))
    return read.where("path LIKE '%.text'").select("file_id", F.concat(F.lit("root."), "path").alias("path"), F.md5(F.regexp_replace("text", r"[ \t\r\n]+", "")).alias("digest"))


@query("""WITH n AS (SELECT c_nationkey AS file_id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS i, replace(c_name, 'Customer', 'Kunde') AS name, c_mktsegment FROM customer)
SELECT CAST(file_id AS BIGINT) AS file_id, 'root.items[' || i || '].label' AS path, name AS text FROM n UNION ALL SELECT CAST(file_id AS BIGINT), 'root.items[' || i || '].segment', c_mktsegment FROM n""")
def tsv_import(spark, sf_dir):
    """Paths and texts out as a table, changed there, and back into the JSON."""
    files = A.customer_json(spark, sf_dir)
    table = rebuild.to_tsv(trees.json_segments(files))
    changed = table.select("file_id", F.replace("output", F.lit("Customer"), F.lit("Kunde")).alias("tsv"))
    out = rebuild.write_json(files, rebuild.from_tsv(changed))
    return trees.json_segments(out.select("file_id", F.col("output").alias("content"))).select("file_id", "path", "text")


@query("""WITH p AS (SELECT conv_id AS file_id, 'messages[' || (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) || ']' AS pos, turn, role, text FROM conversations)
SELECT DISTINCT file_id, 'title' AS path, 'talk' AS text FROM p UNION ALL SELECT file_id, pos || '.number', CAST(turn AS VARCHAR) FROM p UNION ALL SELECT file_id, pos || '.id', role FROM p
UNION ALL SELECT file_id, pos || '.text', text FROM p UNION ALL SELECT file_id, pos || '.who.label', role FROM p""")
def json_all_leaves(spark, sf_dir):
    """All strings, technical keys and digits included."""
    return trees.json_all_segments(A.json_files(spark, sf_dir)).select("file_id", "path", "text")


@query(r"""WITH bare AS (SELECT page_id, regexp_replace(regexp_replace(html, '(<script[^>]*>).*?(</script>)', '\1\2', 'gis'), '(<style[^>]*>).*?(</style>)', '\1\2', 'gis') AS h FROM pages),
nodes AS (SELECT page_id, list_filter(regexp_split_to_array(h, '</?[a-zA-Z][a-zA-Z0-9-]*[^>]*>|<!--(?:[^-]|-[^-])*-->'), lambda x: length(regexp_replace(x, '\s', '', 'g')) > 0) AS n FROM bare)
SELECT page_id AS file_id, generate_subscripts(n, 1) AS no, unnest(n) AS text FROM nodes""")
def html_text_nodes(spark, sf_dir):
    nodes = trees.html_segments(A.page_files(spark, sf_dir)).where("translatable")
    per = nodes.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("seg_no", "text"))).alias("n"))
    return per.select("file_id", F.posexplode("n").alias("i", "x")).select("file_id", (F.col("i") + 1).cast("long").alias("no"), F.col("x.text").alias("text"))


@query("SELECT conv_id, turn, CASE WHEN turn % 3 = 1 THEN text ELSE '[T]' || text END AS translated, turn % 3 <> 1 AS ok, CASE WHEN turn % 3 = 1 THEN 'refused' END AS error FROM conversations")
def python_translator(spark, sf_dir):
    """A translator that is a Python function, with retry; what fails keeps its text."""
    rows = A.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.when(F.col("turn") % 3 == 1, "refuse ").otherwise(""), "text").alias("text"), F.lit(True).alias("translatable"))

    def translator(text: str, prompt: str) -> str:
        if text.startswith("refuse "):
            raise ValueError("refused")
        return mark(text, prompt)

    done = translate_segments(rows, translator, TransformOptions(attempts=2, first_wait_s=0.0))
    return done.select("conv_id", "turn", F.regexp_replace("translated", "^refuse ", "").alias("translated"), "ok", "error")


@query(r"""SELECT c_nationkey AS file_id, CASE WHEN c_nationkey % 3 = 1 THEN 'failed' ELSE 'completed' END AS status, CASE WHEN c_nationkey % 3 = 1 THEN 0.0 ELSE 100.0 END AS progress,
  CAST(CASE WHEN c_nationkey % 3 = 1 THEN 0 ELSE 2 * count(*) END AS BIGINT) AS total_chunks FROM customer GROUP BY c_nationkey""")
def broken_files(spark, sf_dir):
    """A file that does not parse fails alone; the others of its job are done."""
    files = A.customer_json(spark, sf_dir)
    broken = files.withColumn("content", F.when(F.col("file_id") % 3 == 1, F.concat("content", F.lit("}"))).otherwise(F.col("content")))
    rows = jobs.job_rows(jobs.translate_type(broken, "json"))
    return rows.select(F.col("file_id").cast("int").alias("file_id"), "status", "progress", "total_chunks")


@query("SELECT n_name || '.json' AS file_name, '{\"nation\": \"' || n_name || '\"}' AS content FROM nation")
def files_read_whole(spark, sf_dir):
    """Files written one by one, read whole as text and as bytes."""
    path = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    rows = A.table(spark, sf_dir, "nation").select("n_name", F.to_json(F.struct(F.col("n_name").alias("nation"))).alias("value"))
    # One folder for each name, one line in each file.
    rows.repartition("n_name").write.partitionBy("n_name").text(path)
    text = detect.read_text_files(spark, f"{path}/*/*.txt").select("file_id", F.rtrim(F.regexp_replace("content", "\n", "")).alias("content"))
    name = F.concat(F.get_json_object("content", "$.nation"), F.lit(".json")).alias("file_name")
    spaced = F.replace("content", F.lit('":"'), F.lit('": "')).alias("content")
    both = text.join(detect.read_binary_files(spark, f"{path}/*/*.txt").select(F.decode("content", "UTF-8").alias("bytes")), F.col("content") == F.regexp_replace("bytes", "\n", ""))
    return both.select(name, spaced)
