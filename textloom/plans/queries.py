"""The registered queries of the library and, where SQL can say the same, the SQL that they are held against."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import markup
from ..functions.text import format_file_size, join_path, output_name, parent_path, progress_percent
from ..jsstr import word_count
from ..operators import metadata, quality, rebuild, search_index
from ..operators.translate import chunk_counts, glossary_lines, translate_by_column
from ..schema import LANGUAGES
from ..session import shared_folder
from ..sources import detect, text_formats, trees
from ..streaming.progress import progress_by_window
from . import adapters as A

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with the equal SQL if there is one."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# --- sources -----------------------------------------------------------------------------------------------------------

_FILLED = r"lambda x: length(regexp_replace(x, '\s', '', 'g')) > 0"
PARAGRAPHS = rf"""unix AS (SELECT doc_id AS file_id, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS t FROM documents),
blocks AS (SELECT file_id, t, list_filter(regexp_split_to_array(t, '\n\n+'), {_FILLED}) AS b FROM unix),
parts AS (SELECT file_id, CASE WHEN len(b) <= 1 AND contains(t, chr(10)) THEN list_filter(string_split(t, chr(10)), {_FILLED}) ELSE b END AS p FROM blocks),
paragraphs AS (SELECT file_id, unnest(p) AS text, generate_subscripts(p, 1) - 1 AS seg_no FROM parts)"""


@query(f"WITH {PARAGRAPHS} SELECT file_id, CAST(seg_no AS INTEGER) AS seg_no, md5(text) AS digest FROM paragraphs")
def txt_paragraphs(spark, sf_dir):
    rows = text_formats.txt_segments(A.document_files(spark, sf_dir), chunk_size=10**9)
    return rows.select("file_id", "seg_no", F.md5("text").alias("digest"))


@query(f"""WITH {PARAGRAPHS}
SELECT file_id, 'txt' AS type, md5(string_agg('[T]' || text, chr(10) || chr(10) ORDER BY seg_no)) AS digest, count(*) AS total_chunks,
  count(*) AS processed_chunks, CAST(0 AS BIGINT) AS failed_chunks FROM paragraphs GROUP BY file_id""")
def translate_rebuild_txt(spark, sf_dir):
    """Flagship: every document split into paragraphs, each transformed, the document rebuilt."""
    files = A.document_files(spark, sf_dir)
    segments = translate_by_column(text_formats.txt_segments(files, chunk_size=10**9))
    processed = (F.col("total_chunks") - F.col("failed_chunks")).alias("processed_chunks")
    return rebuild.write_txt(segments).select("file_id", F.lit("txt").alias("type"), F.md5("output").alias("digest"), "total_chunks", processed, "failed_chunks")


@query(f"""WITH {PARAGRAPHS}, d AS (SELECT doc_id, lang FROM documents)
SELECT lang, count(DISTINCT file_id) AS files, count(*) AS segments,
  CAST(sum(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''))) AS BIGINT) AS words
FROM paragraphs JOIN d ON file_id = doc_id GROUP BY lang""")
def segment_totals(spark, sf_dir):
    rows = text_formats.txt_segments(A.document_files(spark, sf_dir), chunk_size=10**9)
    docs = A.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), "lang")
    # Sums for each document first, so that no text crosses the join.
    per = rows.groupBy("file_id").agg(F.count("*").alias("segments"), F.sum(word_count(F.col("text"))).alias("words"))
    return per.join(docs, "file_id").groupBy("lang").agg(F.countDistinct("file_id").alias("files"), F.sum("segments").alias("segments"), F.sum("words").alias("words"))


@query(f"""WITH {PARAGRAPHS}, f AS (SELECT file_id, length(text) % 7 = 0 AS failed FROM paragraphs)
SELECT file_id, count(*) AS total_chunks, CAST(count(*) - count_if(failed) AS BIGINT) AS processed_chunks, CAST(count_if(failed) AS BIGINT) AS failed_chunks FROM f GROUP BY file_id""")
def failed_chunks(spark, sf_dir):
    segments = text_formats.txt_segments(A.document_files(spark, sf_dir), chunk_size=10**9)
    return chunk_counts(translate_by_column(segments, fails=F.length("text") % 7 == 0))


CUES = """cues AS (SELECT conv_id AS file_id, turn, role, text,
  printf('%02d:%02d:%02d,000', CAST(turn * 2 // 3600 AS INTEGER), CAST(turn * 2 // 60 % 60 AS INTEGER), CAST(turn * 2 % 60 AS INTEGER)) AS start,
  printf('%02d:%02d:%02d,000', CAST((turn * 2 + 1) // 3600 AS INTEGER), CAST((turn * 2 + 1) // 60 % 60 AS INTEGER), CAST((turn * 2 + 1) % 60 AS INTEGER)) AS "end"
  FROM conversations)"""


@query(f"""WITH {CUES} SELECT file_id, CAST(turn AS INTEGER) AS seg_no, start, "end", CAST(turn + 1 AS VARCHAR) AS "index", text FROM cues""")
def srt_cues(spark, sf_dir):
    rows = text_formats.srt_segments(A.srt_files(spark, sf_dir))
    return rows.select("file_id", "seg_no", F.col("attrs")["start"].alias("start"), F.col("attrs")["end"].alias("end"), F.col("attrs")["index"].alias("index"), "text")


@query(f"""WITH {CUES} SELECT file_id, md5(string_agg(CAST(turn + 1 AS VARCHAR) || chr(10) || start || ' --> ' || "end" || chr(10) || '[T]' || text || chr(10), chr(10) ORDER BY turn)) AS digest
FROM cues GROUP BY file_id""")
def srt_rebuild(spark, sf_dir):
    out = rebuild.write_srt(translate_by_column(text_formats.srt_segments(A.srt_files(spark, sf_dir))))
    return out.select("file_id", F.md5("output").alias("digest"))


@query(f"""WITH {CUES} SELECT file_id, CAST(turn + 1 AS INTEGER) AS seg_no, replace(start, ',', '.') AS start, replace("end", ',', '.') AS "end",
  CASE WHEN turn % 2 = 1 THEN 'align:start' END AS settings, role AS identifier, text FROM cues""")
def vtt_cues(spark, sf_dir):
    rows = text_formats.vtt_segments(A.vtt_files(spark, sf_dir)).where("kind = 'cue'")
    return rows.select("file_id", "seg_no", *[F.col("attrs")[n].alias(n) for n in ("start", "end", "settings", "identifier")], "text")


@query(f"""WITH {CUES} SELECT file_id, md5('WEBVTT' || chr(10) || chr(10) || string_agg(role || chr(10) || replace(start, ',', '.') || ' --> ' || replace("end", ',', '.')
  || CASE WHEN turn % 2 = 1 THEN '  align:start' ELSE '' END || chr(10) || '[T]' || text || chr(10), chr(10) ORDER BY turn)) AS digest FROM cues GROUP BY file_id""")
def vtt_rebuild(spark, sf_dir):
    out = rebuild.write_vtt(translate_by_column(text_formats.vtt_segments(A.vtt_files(spark, sf_dir))))
    return out.select("file_id", F.md5("output").alias("digest"))


MD_RUNS = """files AS (SELECT conv_id AS file_id, string_agg(CASE WHEN role = 'assistant' THEN '```' || chr(10) || text || chr(10) || chr(10) || 'end' || chr(10) || '```' ELSE text END,
  chr(10) || chr(10) ORDER BY turn) AS content FROM conversations GROUP BY conv_id),
lines AS (SELECT file_id, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS no FROM files),
fenced AS (SELECT *, line LIKE '```%' AS fence, coalesce(sum(CAST(line LIKE '```%' AS INTEGER)) OVER (PARTITION BY file_id ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM lines),
kinds AS (SELECT *, CASE WHEN fence OR before % 2 = 1 THEN 'code' WHEN trim(line) = '' THEN 'blank' ELSE 'text' END AS kind FROM fenced),
starts AS (SELECT *, CASE WHEN kind <> 'text' OR lag(kind, 1, '') OVER (PARTITION BY file_id ORDER BY no) <> 'text' THEN 1 ELSE 0 END AS s FROM kinds),
runs AS (SELECT *, sum(s) OVER (PARTITION BY file_id ORDER BY no) - 1 AS seg_no FROM starts)"""


@query(f"""WITH {MD_RUNS} SELECT file_id, CAST(seg_no AS INTEGER) AS seg_no, min(kind) AS kind, md5(string_agg(line, chr(10) ORDER BY no)) AS digest FROM runs GROUP BY file_id, seg_no""")
def md_blocks(spark, sf_dir):
    return text_formats.md_segments(A.md_files(spark, sf_dir)).select("file_id", "seg_no", "kind", F.md5("text").alias("digest"))


@query("""SELECT conv_id AS file_id, md5(string_agg(CASE WHEN role = 'assistant' THEN '```' || chr(10) || text || chr(10) || chr(10) || 'end' || chr(10) || '```' ELSE text END,
  chr(10) || chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id""")
def md_round_trip(spark, sf_dir):
    segments = text_formats.md_segments(A.md_files(spark, sf_dir))
    return rebuild.write_md(segments.withColumn("translated", F.col("text"))).select("file_id", F.md5("output").alias("digest"))


@query("SELECT page_id AS file_id, md5(html) AS digest FROM pages")
def html_round_trip(spark, sf_dir):
    segments = trees.html_segments(A.page_files(spark, sf_dir)).withColumn("translated", F.col("text"))
    return rebuild.write_html(segments).select("file_id", F.md5("output").alias("digest"))


@query(r"""SELECT tag, count(*) AS n FROM (SELECT lower(unnest(regexp_extract_all(html, '</?([a-zA-Z][a-zA-Z0-9-]*)[^>]*>', 1))) AS tag FROM pages) GROUP BY tag""")
def html_tag_counts(spark, sf_dir):
    rows = trees.html_segments(A.page_files(spark, sf_dir)).where("kind = 'tag' AND text NOT LIKE '<!--%'")
    return rows.groupBy(F.lower(F.regexp_extract("text", "^</?([a-zA-Z][a-zA-Z0-9-]*)", 1)).alias("tag")).agg(F.count("*").alias("n"))


CSV_CELLS = """numbered AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS r FROM customer),
cells AS (SELECT CAST(c_nationkey AS BIGINT) AS file_id, CAST(r AS INTEGER) AS "row", 0 AS col, CAST(c_custkey AS VARCHAR) AS text, false AS translatable FROM numbered
  UNION ALL SELECT c_nationkey, r, 1, c_name || ', "x"' || chr(10) || c_mktsegment, true FROM numbered
  UNION ALL SELECT c_nationkey, r, 2, c_mktsegment, true FROM numbered
  UNION ALL SELECT DISTINCT c_nationkey, 0, unnest([0, 1, 2]), unnest(['key', 'name', 'segment']), true FROM customer)"""


@query(f"""WITH {CSV_CELLS} SELECT file_id, "row", col, text, translatable FROM cells""")
def csv_cells(spark, sf_dir):
    rows = text_formats.csv_segments(A.csv_files(spark, sf_dir))
    return rows.select("file_id", F.col("attrs")["row"].cast("int").alias("row"), F.col("attrs")["col"].cast("int").alias("col"), "text", "translatable")


@query(f"""WITH {CSV_CELLS}, out AS (SELECT file_id, "row", col, CASE WHEN translatable THEN '[T]' || text ELSE text END AS t FROM cells),
lines AS (SELECT file_id, "row", string_agg(CASE WHEN regexp_matches(t, '[",\n]') THEN '"' || replace(t, '"', '""') || '"' ELSE t END, ',' ORDER BY col) AS line FROM out GROUP BY file_id, "row")
SELECT file_id, md5(string_agg(line, chr(10) ORDER BY "row")) AS digest FROM lines GROUP BY file_id""")
def csv_rebuild(spark, sf_dir):
    out = rebuild.write_csv(translate_by_column(text_formats.csv_segments(A.csv_files(spark, sf_dir))))
    return out.select("file_id", F.md5("output").alias("digest"))


_LEAVES = r"""leaves AS (
  SELECT conv_id AS file_id, 'root.messages[' || (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) || ']' AS pos, role, text FROM conversations)"""


@query(f"""WITH {_LEAVES} SELECT DISTINCT file_id, 'root.title' AS path, 'talk' AS text FROM leaves
UNION ALL SELECT file_id, pos || '.text', text FROM leaves WHERE NOT regexp_matches(text, '^[0-9]+$') AND length(regexp_replace(text, '\\s', '', 'g')) > 0
UNION ALL SELECT file_id, pos || '.who.label', role FROM leaves""")
def json_leaves(spark, sf_dir):
    return trees.json_segments(A.json_files(spark, sf_dir)).select("file_id", "path", "text")


@query(f"""WITH {_LEAVES} SELECT file_id, count(*) AS n, md5(string_agg('[T]' || text, chr(10) ORDER BY pos)) AS texts, bool_and(role IS NOT NULL) AS ids_kept FROM leaves GROUP BY file_id""")
def json_rebuild(spark, sf_dir):
    files = A.json_files(spark, sf_dir)
    out = rebuild.write_json(files, translate_by_column(trees.json_segments(files)))
    shape = "struct<title:string,messages:array<struct<number:string,id:string,text:string>>>"
    read = out.select("file_id", F.inline(F.array(F.from_json("output", shape)))).select("file_id", F.posexplode("messages").alias("i", "m"))
    item = F.struct(F.concat(F.lit("root.messages["), F.col("i").cast("string"), F.lit("]")).alias("at"), F.col("m.text").alias("t"))
    per = read.groupBy("file_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(item)).alias("x"), F.bool_and(~F.startswith("m.id", F.lit("[T]"))).alias("ids_kept"))
    return per.select("file_id", "n", F.md5(F.array_join(F.transform("x", lambda y: y.t), "\n")).alias("texts"), "ids_kept")


@query("SELECT event_id AS file_id, CASE event_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 0 ELSE -1 END AS depth FROM events")
def json_depth(spark, sf_dir):
    k = F.col("event_id") % 4
    content = F.when(k == 0, F.col("props")).when(k == 1, F.concat(F.lit('{"a": [], "b": ['), "props", F.lit("]}"))).when(k == 2, "7").otherwise(F.concat("props", F.lit(",")))
    depths = trees.json_depths(A.table(spark, sf_dir, "events").select(F.col("event_id").alias("file_id"), content.alias("content")))
    return depths.fillna(-1, ["depth"])


@query("""SELECT event_id AS file_id, 'root.say[1]' AS path, 'no ' || json_extract_string(props, '$.k') AS text FROM events""")
def json_numbers_are_no_text(spark, sf_dir):
    """Numbers, digits alone, blank strings and technical keys are never emitted."""
    number = F.get_json_object("props", "$.k")
    content = F.concat(F.lit('{"k": '), number, F.lit(', "id": "x", "say": ["'), number, F.lit('", "no '), number, F.lit('", " ", null, true]}'))
    events = A.table(spark, sf_dir, "events").select(F.col("event_id").alias("file_id"), content.alias("content"))
    return trees.json_segments(events).select("file_id", "path", "text")


@query(f"""WITH {_LEAVES} SELECT file_id, md5('path' || chr(9) || 'source_text' || chr(10) || 'root.title' || chr(9) || 'talk' || chr(10) ||
  string_agg(pos || '.text' || chr(9) || text || chr(10) || pos || '.who.label' || chr(9) || role, chr(10) ORDER BY CAST(regexp_extract(pos, '([0-9]+)', 1) AS INTEGER))) AS digest FROM leaves GROUP BY file_id""")
def json_to_tsv(spark, sf_dir):
    return rebuild.to_tsv(trees.json_segments(A.json_files(spark, sf_dir))).select("file_id", F.md5("output").alias("digest"))


_NAMES = """names AS (SELECT doc_id, 'f.' || (['json', 'JSON', 'srt', 'vtt', 'md', 'markdown', 'htm', 'csv', 'yml', 'epub', 'docx', 'xyz', 'txt'])[1 + doc_id % 13] AS file_name,
  CASE WHEN doc_id % 2 = 0 THEN '[XENO:' ELSE '' END || coalesce(text, '') AS content FROM documents)"""


@query(f"""WITH {_NAMES} SELECT doc_id, CASE lower(string_split(file_name, '.')[-1])
  WHEN 'json' THEN CASE WHEN content LIKE '%[XENO:%' THEN 'json_game' ELSE 'json' END WHEN 'srt' THEN 'srt' WHEN 'vtt' THEN 'vtt' WHEN 'md' THEN 'md' WHEN 'markdown' THEN 'md'
  WHEN 'htm' THEN 'html' WHEN 'csv' THEN 'csv' WHEN 'yml' THEN 'yaml' WHEN 'epub' THEN 'epub' WHEN 'docx' THEN 'docx' ELSE 'txt' END AS type FROM names""")
def detected_types(spark, sf_dir):
    endings = F.array(*[F.lit(x) for x in ("json", "JSON", "srt", "vtt", "md", "markdown", "htm", "csv", "yml", "epub", "docx", "xyz", "txt")])
    docs = A.table(spark, sf_dir, "documents")
    name = F.concat(F.lit("f."), F.get(endings, (F.col("doc_id") % 13).cast("int")))
    content = F.concat(F.when(F.col("doc_id") % 2 == 0, "[XENO:").otherwise(""), F.coalesce("text", F.lit("")))
    return docs.select("doc_id", detect.detect_type(name, content).alias("type"))


# --- metadata ----------------------------------------------------------------------------------------------------------


@query(f"""WITH {A.TRANSLATIONS} SELECT count(*) AS total, count_if(status = 'pending')::BIGINT AS pending, count_if(status = 'processing')::BIGINT AS processing,
  count_if(status = 'completed')::BIGINT AS completed, count_if(status = 'failed')::BIGINT AS failed, count_if(status = 'paused')::BIGINT AS paused FROM translations""")
def status_stats(spark, sf_dir):
    return metadata.status_counts(A.translations(spark, sf_dir))


@query(f"""WITH {A.TRANSLATIONS} SELECT user_id, count(*) AS total, count_if(status = 'pending')::BIGINT AS pending, count_if(status = 'processing')::BIGINT AS processing,
  count_if(status = 'completed')::BIGINT AS completed, count_if(status = 'failed')::BIGINT AS failed, count_if(status = 'paused')::BIGINT AS paused FROM translations GROUP BY user_id""")
def status_stats_by_user(spark, sf_dir):
    return metadata.status_counts(A.translations(spark, sf_dir), "user_id")


@query(f"WITH {A.TRANSLATIONS} SELECT id, status, created_at FROM translations WHERE user_id = 7 ORDER BY created_at DESC, id DESC LIMIT 20")
def history_recent(spark, sf_dir):
    return metadata.history(A.translations(spark, sf_dir), 7).select("id", "status", "created_at").limit(20)


@query(f"WITH {A.TRANSLATIONS} SELECT id, user_id, status FROM translations WHERE id = 42")
def translation_by_id(spark, sf_dir):
    return metadata.lookup(A.translations(spark, sf_dir), "id", 42).select("id", "user_id", "status")


_LANG = A.LANGUAGE_NAMES.format(rows=", ".join(f"('{c}', '{n}', '{e}')" for c, n, e, _ in LANGUAGES))
_HISTORY = f"""{A.TRANSLATIONS}, {_LANG}, named AS (
  SELECT t.*, s.name AS source_name, s.english_name AS source_english, g.name AS target_name, g.english_name AS target_english
  FROM translations t LEFT JOIN languages s ON s.code = t.source_language LEFT JOIN languages g ON g.code = t.target_language)"""


@query(f"""WITH {_HISTORY} SELECT id, status, source_name, target_name FROM named WHERE status = 'failed'
  AND lower(concat_ws(' ', source_language, target_language, source_name, source_english, target_name, target_english, status)) LIKE '%japan%'""")
def history_search(spark, sf_dir):
    rows = metadata.search_history(A.translations(spark, sf_dir), "Japan", "failed")
    return rows.select("id", "status", "source_name", "target_name")


@query(f"WITH {_HISTORY} SELECT source_english, target_english, count(*) AS jobs FROM named GROUP BY ALL")
def jobs_by_language(spark, sf_dir):
    rows = metadata.with_language_names(A.translations(spark, sf_dir))
    return rows.groupBy("source_english", "target_english").agg(F.count("*").alias("jobs"))


@query(f"""WITH {A.GLOSSARY} SELECT id, term, translation, notes FROM glossary
  WHERE coalesce(source_language, '') IN ('', 'en') AND coalesce(target_language, '') IN ('', 'ar')""")
def glossary_scope(spark, sf_dir):
    return metadata.scoped_glossary(A.glossary(spark, sf_dir), "en", "ar")


@query(f"""WITH {A.TRANSLATIONS}, {A.GLOSSARY} SELECT t.id AS job_id, g.id, g.term, g.translation, g.notes FROM translations t JOIN glossary g ON t.user_id = g.user_id
  AND coalesce(g.source_language, '') IN ('', t.source_language) AND coalesce(g.target_language, '') IN ('', t.target_language)""")
def glossary_of_jobs(spark, sf_dir):
    return metadata.glossary_for_jobs(A.translations(spark, sf_dir), A.glossary(spark, sf_dir))


@query(f"""WITH {A.GLOSSARY} SELECT id, term FROM glossary
  WHERE lower(concat_ws(' ', term, translation, coalesce(notes, ''), coalesce(source_language, ''), coalesce(target_language, ''))) LIKE '%the%'""")
def glossary_search(spark, sf_dir):
    return metadata.search_glossary(A.glossary(spark, sf_dir), " The ").select("id", "term")


@query("""SELECT doc_id, length(text) AS n_chars FROM documents WHERE contains(lower(text), 'of the')""")
def indexed_text_search(spark, sf_dir):
    """Documents that hold a phrase, found through a posting table of trigrams."""
    rows = A.table(spark, sf_dir, "documents").where("doc_id IS NOT NULL").select("doc_id", "text")
    index = search_index.build_index(rows, "doc_id", "text", f"{shared_folder(spark)}/index-{uuid.uuid4().hex}")
    return search_index.indexed_search(rows, index, " Of The").select("doc_id", F.length("text").cast("long").alias("n_chars"))


@query(f"""WITH {A.GLOSSARY} SELECT string_agg('- "' || term || '" -> "' || translation || '"' || CASE WHEN coalesce(notes, '') <> '' THEN ' (' || notes || ')' ELSE '' END, chr(10) ORDER BY id) AS prompt_lines
  FROM (SELECT * FROM glossary WHERE term <> '' AND translation <> '' ORDER BY id LIMIT 200)""")
def glossary_prompt(spark, sf_dir):
    return glossary_lines(A.glossary(spark, sf_dir))


@query(f"""WITH {A.TRANSLATIONS} SELECT id, user_id, CASE WHEN id % 2 = 0 THEN true ELSE false END AS allowed FROM
  (SELECT id, CASE WHEN id % 2 = 0 THEN user_id ELSE user_id + 1 END AS user_id FROM translations)""")
def access_checks(spark, sf_dir):
    rows = A.translations(spark, sf_dir)
    asked = rows.select("id", F.when(F.col("id") % 2 == 0, F.col("user_id")).otherwise(F.col("user_id") + 1).alias("user_id"))
    return metadata.may_access(rows, asked)


@query(f"""WITH {A.TRANSLATIONS} SELECT id, CASE WHEN total_chunks = 0 THEN 100.0 ELSE CAST(processed_chunks AS DOUBLE) / total_chunks * 100 END AS progress,
  total_chunks - processed_chunks AS failed FROM translations""")
def job_progress(spark, sf_dir):
    rows = A.translations(spark, sf_dir)
    return rows.select("id", progress_percent(F.col("processed_chunks"), F.col("total_chunks")).alias("progress"), (F.col("total_chunks") - F.col("processed_chunks")).alias("failed"))


@query("""SELECT page_id, media, size_text, name, CASE WHEN NOT known THEN 'unsupported-type' WHEN size > 26214400 THEN 'too-large' END AS reason FROM (
  SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'text/html' WHEN 1 THEN 'text/yaml' WHEN 2 THEN 'application/octet-stream' ELSE 'text/plain' END AS media,
    page_id % 4 <> 2 AS known, length(html) * (page_id % 5) * 4000 AS size, 'a.b_' || 'ar' || (['.html', '.yml', '.exe', '.TXT'])[1 + page_id % 4] AS name,
    CASE WHEN length(html) * (page_id % 5) * 4000 < 1024 THEN length(html) * (page_id % 5) * 4000 || ' B'
      WHEN length(html) * (page_id % 5) * 4000 < 1048576 THEN printf('%.1f KB', floor(length(html) * (page_id % 5) * 40000 / 1024.0 + 0.5) / 10)
      ELSE printf('%.2f MB', floor(length(html) * (page_id % 5) * 400000 / 1048576.0 + 0.5) / 100) END AS size_text FROM pages)""")
def upload_admission(spark, sf_dir):
    endings = F.array(*[F.lit(x) for x in (".html", ".yml", ".exe", ".TXT")])
    rows = A.table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("a.b"), F.get(endings, (F.col("page_id") % 4).cast("int"))).alias("file_name"), (F.length("html") * (F.col("page_id") % 5) * 4000).alias("size"))
    checked = metadata.admitted(rows)
    return checked.select("page_id", metadata.media_type(F.col("file_name")).alias("media"), format_file_size(F.col("size")).alias("size_text"), output_name(F.col("file_name"), F.lit("ar")).alias("name"), "reason")


@query(f"""WITH {A.TRANSLATIONS} SELECT id, CASE WHEN id % 10 = 1 THEN 'completed' ELSE status END AS status FROM translations WHERE id % 10 <> 3""")
def update_and_delete(spark, sf_dir):
    rows = A.translations(spark, sf_dir).select("id", "status")
    changes = rows.where("id % 10 = 1").select("id", F.lit("completed").alias("status"))
    return metadata.deleted(metadata.updated(rows, changes), rows.where("id % 10 = 3"))


@query("""WITH old AS (SELECT c_custkey, 'u' || c_custkey AS open_id, c_name AS name, 'user' AS role FROM customer WHERE c_custkey % 2 = 0),
new AS (SELECT 'u' || c_custkey AS open_id, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE upper(c_name) END AS name, c_custkey % 3 = 0 AS sets FROM customer WHERE c_custkey % 4 <> 1)
SELECT coalesce(o.open_id, n.open_id) AS open_id, CASE WHEN n.sets THEN n.name ELSE o.name END AS name, CASE WHEN n.open_id = 'u6' THEN 'admin' ELSE coalesce(o.role, 'user') END AS role
FROM old o FULL JOIN new n ON o.open_id = n.open_id""")
def user_upsert(spark, sf_dir):
    rows = A.table(spark, sf_dir, "customer").withColumn("open_id", F.concat(F.lit("u"), F.col("c_custkey").cast("string")))
    null = F.lit(None).cast("string")
    signed = F.lit(None).cast("timestamp").alias("last_signed_in")
    old = rows.where("c_custkey % 2 = 0").select("open_id", F.col("c_name").alias("name"), null.alias("email"), null.alias("login_method"), F.lit("user").alias("role"), signed)
    given = F.when(F.col("c_custkey") % 3 == 0, F.array(F.lit("name"))).otherwise(F.array().cast("array<string>"))
    name = F.when(F.col("c_custkey") % 5 == 0, null).otherwise(F.upper("c_name"))
    new = rows.where("c_custkey % 4 <> 1").select("open_id", name.alias("name"), null.alias("email"), null.alias("login_method"), null.alias("role"), signed, given.alias("given"))
    return metadata.upsert_users(old, new, "u6", F.lit("2024-01-01").cast("timestamp")).select("open_id", "name", "role")


@query("""SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS processed,
  CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS DOUBLE) / count(*) OVER (PARTITION BY user_id) * 100 AS progress FROM events""")
def progress_of_users(spark, sf_dir):
    events = A.table(spark, sf_dir, "events").select(F.col("user_id").alias("file_id"), F.col("event_id").alias("seg_no"), F.col("ts").alias("finished_at"))
    rows = metadata.progress_series(events)
    return rows.select(F.col("file_id").alias("user_id"), F.col("seg_no").alias("event_id"), "processed", "progress")


@query("""SELECT event_type AS log, event_id AS line_no FROM (SELECT *, sum(octet_length(encode(props)) + 1) OVER (PARTITION BY event_type ORDER BY event_id DESC) AS upto FROM events) WHERE upto <= 2000""")
def newest_log_lines(spark, sf_dir):
    lines = A.table(spark, sf_dir, "events").select(F.col("event_type").alias("log"), F.col("event_id").alias("line_no"), F.col("props").alias("line"))
    return metadata.newest_within(lines, 2000).select("log", "line_no")


@query("SELECT event_type AS kind, event_id AS seq FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS r FROM events) WHERE r <= 200")
def ring_buffer_contents(spark, sf_dir):
    rows = A.table(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), F.col("event_id").alias("seq"))
    return metadata.keep_last(rows, "kind", "seq", 200)


@query("""SELECT user_id AS job_id, time_bucket(INTERVAL 10 MINUTES, ts, TIMESTAMP '1970-01-01') AS start, count(*) AS processed FROM events GROUP BY ALL""")
def progress_windows(spark, sf_dir):
    events = A.table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.col("ts").cast("timestamp").alias("at"))
    return progress_by_window(events).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""SELECT event_id, CAST(value AS INTEGER) % 300 + 200 AS status, CASE WHEN event_id % 3 = 0 THEN '[streaming response]' WHEN event_id % 3 = 1 THEN '[binary response]' ELSE props END AS body,
  CAST(value AS INTEGER) % 300 + 200 >= 400 AS is_error FROM (SELECT event_id, floor(abs(value)) AS value, props FROM events)""")
def captured_requests(spark, sf_dir):
    kind = F.when(F.col("event_id") % 3 == 0, "text/event-stream").when(F.col("event_id") % 3 == 1, "image/png").otherwise("application/json")
    rows = A.table(spark, sf_dir, "events").select("event_id", (F.floor(F.abs("value")).cast("int") % 300 + 200).alias("status"), kind.alias("content_type"), F.lit(0).alias("declared_length"), F.col("props").alias("body"))
    return metadata.classify_requests(rows).select("event_id", "status", "body", "is_error")


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'a/c.x' WHEN 1 THEN 'c.x' WHEN 2 THEN 'a/b/d/c.x' ELSE 'c.x' END AS joined, CASE WHEN o_orderkey % 4 = 2 THEN 'a/b' ELSE '' END AS parent FROM orders""")
def package_paths(spark, sf_dir):
    k = F.col("o_orderkey") % 4
    base = F.when(k == 1, "").otherwise("a/b")
    relative = F.when(k == 0, "../c.x").when(k == 1, "c.x").when(k == 2, "./d//c.x").otherwise("/c.x")
    return A.table(spark, sf_dir, "orders").select("o_orderkey", join_path(base, relative).alias("joined"), parent_path(F.when(k == 2, "a/b/opf").otherwise("opf")).alias("parent"))


# --- quality -----------------------------------------------------------------------------------------------------------

PAIRS = """pairs AS (SELECT doc_id, original, CASE doc_id % 5 WHEN 0 THEN original WHEN 1 THEN replace(original, '[XENO:wait a=b ]', '') WHEN 2 THEN original || '[ML:icon ]'
    WHEN 3 THEN replace(original, '[/System:Color]', '[/System:Other]') ELSE replace(original, chr(10), ' ') END AS translation FROM (
  SELECT doc_id, '[XENO:wait a=b ]' || text || '[System:Color name=x ]' || CASE WHEN doc_id % 2 = 0 THEN chr(10) || 'more words here' ELSE '' END || '[/System:Color]' AS original
  FROM documents WHERE length(text) > 0))"""


SYMBOL_KINDS = """lines AS (SELECT *, len(string_split(original, chr(10))) AS o, len(string_split(translation, chr(10))) AS t FROM pairs),
symbols AS (SELECT 'root.l' || doc_id AS path, kind FROM (
  SELECT doc_id, CASE WHEN doc_id % 5 = 1 THEN 'missing-tags' WHEN doc_id % 5 IN (2, 3) THEN 'extra-tags' WHEN o > 1 AND o <> t THEN 'line-breaks' END AS kind FROM lines) WHERE kind IS NOT NULL)"""


@query(f"WITH {PAIRS}, {SYMBOL_KINDS} SELECT path, kind, CASE kind WHEN 'missing-tags' THEN 'high' ELSE 'medium' END AS severity FROM symbols")
def symbol_scan(spark, sf_dir):
    return quality.scan_symbols(A.text_pairs(spark, sf_dir)).select("path", "kind", "severity")


@query(r"""SELECT doc_id, md5(regexp_replace(text || CASE WHEN doc_id % 2 = 0 THEN 'more words here' ELSE '' END, '[ \t\r\n]+', '', 'g')) AS words,
  1 AS waits, 1 AS opened, 1 AS closed, 0 AS others FROM documents WHERE length(text) > 0""")
def restored_tags(spark, sf_dir):
    """All copies with the original's tags again, each as often, and their words (laid out anew where breaks were lost)."""
    restored = A.text_pairs(spark, sf_dir).select(F.col("seg_no").cast("long").alias("doc_id"), markup.restore(F.col("original"), F.col("translation")).alias("t"))
    tags = {"waits": "[XENO:wait a=b ]", "opened": "[System:Color name=x ]", "closed": "[/System:Color]"}
    found = restored.withColumn("n", F.size(F.regexp_extract_all("t", F.lit(markup.ANY_TAG), 0)))
    counts = [markup.count_of(F.col("t"), F.lit(tag)).alias(name) for name, tag in tags.items()]
    others = (F.col("n") - sum((markup.count_of(F.col("t"), F.lit(tag)) for tag in tags.values()), F.lit(0))).alias("others")
    plain = F.regexp_replace(F.regexp_replace("t", markup.ANY_TAG, ""), r"[ \t\r\n]+", "")
    return found.select("doc_id", F.md5(plain).alias("words"), *counts, others)


@query(f"""WITH {PAIRS} SELECT count(*) AS scanned, CAST(count_if(doc_id % 5 IN (1, 2, 3) OR (doc_id % 5 = 4 AND contains(original, chr(10)))) AS BIGINT) AS flagged FROM pairs""")
def symbol_scan_totals(spark, sf_dir):
    entries = A.text_pairs(spark, sf_dir)
    return quality.scan_totals(entries, quality.scan_symbols(entries))


@query(f"""WITH {PAIRS}, tags AS (SELECT len(regexp_extract_all(translation, '\\[XENO:')) AS x, len(regexp_extract_all(translation, '\\[/?System:')) AS s, len(regexp_extract_all(translation, '\\[ML:')) AS m FROM pairs)
SELECT count(*) AS total, CAST(sum(x) AS BIGINT) AS xeno, CAST(sum(s) AS BIGINT) AS system, CAST(sum(m) AS BIGINT) AS ml FROM tags""")
def tag_totals(spark, sf_dir):
    rows = A.text_pairs(spark, sf_dir).withColumn("attrs", F.create_map(F.lit("original"), F.col("translation")))
    return quality.tag_report(rows).select("total", "xeno", "system", "ml")


from . import chunk_queries, format_queries, function_queries, job_queries, large_file_queries, linesplit_queries  # noqa: E402, F401  (they register their queries here)
