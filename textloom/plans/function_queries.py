"""Registered queries of the text, markup and metadata functions, each with its SQL."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from ..functions import linesplit, markup, text
from ..jsstr import is_blank, word_count
from ..operators import metadata, quality, rebuild
from ..operators.translate import PROMPT, glossary_lines, job_prompts
from ..schema import LANGUAGES, languages
from ..session import shared_folder
from . import adapters as A
from .queries import query

# --- texts -------------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, md5(text) AS digest, len(string_split(text, chr(10))) AS n_lines FROM documents WHERE text IS NOT NULL")
def normalized_breaks(spark, sf_dir):
    docs = A.table(spark, sf_dir, "documents").where("text IS NOT NULL")
    kinds = F.array(*[F.lit(x) for x in ("\r\n", "\\n", "<br>", "<BR />")])
    other = F.replace("text", F.lit("\n"), F.get(kinds, (F.col("doc_id") % 4).cast("int")))
    return docs.select("doc_id", F.md5(text.normalize_breaks(other)).alias("digest"), text.count_lines(other).alias("n_lines"))


@query(r"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(text, '([,،])\s+', '\1' || chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13))) AS digest
FROM documents WHERE text IS NOT NULL""")
def comma_lines(spark, sf_dir):
    docs = A.table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", F.md5(text.split_after_commas(F.col("text"))).alias("digest"))


@query(r"""SELECT doc_id, CASE WHEN length(s) > 80 THEN s[1:80] || '…' ELSE s END AS short, CASE WHEN length(text) > 1000 THEN text[1:1000] || '...[truncated]' ELSE text END AS logged FROM (
  SELECT doc_id, text, trim(regexp_replace(text, '\s+', ' ', 'g')) AS s FROM documents WHERE text IS NOT NULL)""")
def compacted_texts(spark, sf_dir):
    docs = A.table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", text.compact_text(F.col("text")).alias("short"), text.clip(F.col("text")).alias("logged"))


@query(f"""SELECT doc_id, regexp_matches(t, '[؀-ۿ]') AS arabic, regexp_matches(t, '[぀-ゟ゠-ヿ一-鿿]') AS japanese
FROM (SELECT doc_id, coalesce(text, '') || ' ' || (['plain', 'mit عربي', '日本語 と', 'Ελληνικά'])[1 + doc_id % 4] AS t FROM documents)""")
def scripts_of_texts(spark, sf_dir):
    ends = F.array(*[F.lit(x) for x in ("plain", "mit عربي", "日本語 と", "Ελληνικά")])
    said = F.concat(F.coalesce("text", F.lit("")), F.lit(" "), F.get(ends, (F.col("doc_id") % 4).cast("int")))
    return A.table(spark, sf_dir, "documents").select("doc_id", text.has_arabic(said).alias("arabic"), text.is_japanese(said).alias("japanese"))


@query(r"""WITH lines AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM documents WHERE length(text) > 0),
ends AS (SELECT doc_id, text, no, sum(length(line)) OVER (PARTITION BY doc_id ORDER BY no) + no - 1 AS place, max(no) OVER (PARTITION BY doc_id) AS last FROM lines),
filled AS (SELECT doc_id, count(*) FILTER (trim(line, ' ' || chr(9)) <> '') AS n_lines, CAST(sum(len(list_filter(regexp_split_to_array(line, '\s+'), lambda w: w <> ''))) AS BIGINT) AS n_words FROM lines GROUP BY doc_id)
SELECT doc_id, n_lines, n_words, CAST(last - 1 AS INTEGER) AS n_breaks, coalesce(ratios, 0.0) AS ratios FROM filled JOIN (
  SELECT doc_id, max(last) AS last, round(sum(CASE WHEN no < last THEN place / CAST(length(text) AS DOUBLE) END), 6) AS ratios FROM ends GROUP BY doc_id) USING (doc_id)""")
def line_facts(spark, sf_dir):
    """Lines, words and where breaks stand, of texts with tags that count as nothing."""
    docs = A.table(spark, sf_dir, "documents").where("length(text) > 0").withColumn("tagged", F.concat(F.lit("[XENO:wait ]"), "text", F.lit("[/System:Color]")))
    plain = linesplit.strip_tags(F.col("tagged"))
    ratios = linesplit.break_ratios(F.col("tagged"))
    total = F.round(F.aggregate(ratios, F.lit(0.0), lambda a, x: a + x), 6)
    return docs.select("doc_id", F.size(linesplit.lines_of(plain)).cast("long").alias("n_lines"), word_count(plain).cast("long").alias("n_words"), F.size(ratios).alias("n_breaks"), total.alias("ratios"))


@query("""SELECT item_id, 6 AS n_marks, text || ' {name} $cost [Tag] <b> `x y`' || chr(9) AS restored, text || '{name}' AS one_missing FROM (SELECT item_id, replace(text, chr(10), ' ') AS text FROM benchmark)""")
def format_marks(spark, sf_dir):
    """Technical marks of a text, appended to a copy that lacks them."""
    rows = A.table(spark, sf_dir, "benchmark").select("item_id", F.replace("text", F.lit("\n"), F.lit(" ")).alias("text"))
    marked = F.concat("text", F.lit(" {name} $cost [Tag] <b> `x y`\t"))
    rows = rows.select("item_id", "text", text.format_tags(marked).alias("tags"))
    restored = F.replace(text.restore_format_tags(F.col("text"), F.col("tags")), F.lit(" \t"), F.lit("\t"))
    return rows.select("item_id", F.size("tags").alias("n_marks"), restored.alias("restored"), text.restore_format_tags(F.concat("text", F.lit("{name}")), F.array(F.lit("{name}"))).alias("one_missing"))


@query("""SELECT c_custkey, 'a/' || c_name || '.txt' AS key, CASE c_custkey % 3 WHEN 0 THEN 'a/' || c_name || '_' || substr(sha256('a/' || c_name || '.txt'), 1, 8) || '.txt'
  WHEN 1 THEN 'a/' || c_name || '_' || substr(sha256('a/' || c_name || '.txt'), 1, 8) || '.txt' ELSE 'a.b/' || c_name || '_' || substr(sha256('a.b/' || c_name), 1, 8) END AS stored FROM customer""")
def stored_names(spark, sf_dir):
    rows = A.table(spark, sf_dir, "customer")
    key = F.concat(F.lit("//a/"), "c_name", F.lit(".txt"))
    given = F.when(F.col("c_custkey") % 3 == 0, key).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("a/"), "c_name", F.lit(".txt"))).otherwise(F.concat(F.lit("/a.b/"), "c_name"))
    return rows.select("c_custkey", text.normalize_key(key).alias("key"), rebuild.stored_name(given).alias("stored"))


@query("""SELECT o_orderkey, CASE WHEN size < 1024 THEN size || ' B' WHEN size < 1048576 THEN printf('%.1f KB', floor(size * 10 / 1024.0 + 0.5) / 10) ELSE printf('%.2f MB', floor(size * 100 / 1048576.0 + 0.5) / 100) END AS size_text,
  strftime(o_orderdate, '%-d %B %Y %H:%M') AS at FROM (SELECT o_orderkey, o_orderdate, o_orderkey % 3000 * (o_orderkey % 7 + 1) * 511 AS size FROM orders)""")
def sizes_and_dates(spark, sf_dir):
    size = F.col("o_orderkey") % 3000 * (F.col("o_orderkey") % 7 + 1) * 511
    return A.table(spark, sf_dir, "orders").select("o_orderkey", text.format_file_size(size).alias("size_text"), text.format_date(F.col("o_orderdate")).alias("at"))


_FIELDS = ("user_password", "name", "API_KEY", "note", "Authorization", "cookieName", "title")


@query(f"""SELECT c_custkey, field, CASE WHEN regexp_matches(lower(field), 'password|token|secret|key|authorization|cookie|session') THEN '[REDACTED]' ELSE c_name END AS shown
FROM (SELECT c_custkey, c_name, ([{", ".join(f"'{f}'" for f in _FIELDS)}])[1 + c_custkey % {len(_FIELDS)}] AS field FROM customer)""")
def masked_fields(spark, sf_dir):
    field = F.get(F.array(*[F.lit(f) for f in _FIELDS]), (F.col("c_custkey") % len(_FIELDS)).cast("int"))
    rows = A.table(spark, sf_dir, "customer").select("c_custkey", "c_name", field.alias("field"))
    return rows.select("c_custkey", "field", text.mask_sensitive(F.col("field"), F.col("c_name")).alias("shown"))


@query("""SELECT event_id, '{"k": ' || json_extract_string(props, '$.k') || ', "token": "[REDACTED]", "deep": [' || event_id % 3 || ']}' AS safe FROM events""")
def sanitized_logs(spark, sf_dir):
    told = F.concat(F.lit('{"k": '), F.get_json_object("props", "$.k"), F.lit(', "token": "t'), F.col("event_id").cast("string"), F.lit('", "deep": ['), (F.col("event_id") % 3).cast("string"), F.lit("]}"))
    return A.table(spark, sf_dir, "events").select("event_id", metadata.sanitize_json(told).alias("safe"))


@query("""SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'email' WHEN 1 THEN 'google' WHEN 2 THEN 'microsoft' WHEN 3 THEN 'sso' ELSE NULL END AS method FROM customer""")
def login_methods(spark, sf_dir):
    k = F.col("c_custkey") % 5
    name = lambda *xs: F.array(*[F.lit(f"REGISTERED_PLATFORM_{x}") for x in xs])
    platforms = F.when(k == 0, name("GOOGLE", "EMAIL")).when(k == 1, name("GITHUB", "GOOGLE")).when(k == 2, name("AZURE")).when(k == 3, name("EMAIL")).otherwise(F.array().cast("array<string>"))
    return A.table(spark, sf_dir, "customer").select("c_custkey", text.login_method(platforms, F.when(k == 3, "sso").otherwise(F.lit(None).cast("string"))).alias("method"))


@query("SELECT conv_id AS file_id, arg_min(text, turn) AS first, min(role) FILTER (turn = 1) AS second_role, 'talk' AS title FROM conversations GROUP BY conv_id")
def paths_read(spark, sf_dir):
    files = A.json_files(spark, sf_dir)
    at = lambda p: text.read_path(F.col("content"), F.lit(p))
    return files.select("file_id", at("root.messages[0].text").alias("first"), at("root.messages[1].who.label").alias("second_role"), at("root.title").alias("title"))


@query("""SELECT event_id, event_id % 3 <> 2 AS valid, CASE event_id % 3 WHEN 0 THEN 'no-known-keys,no-tags' WHEN 1 THEN '' END AS warnings FROM events""")
def validated_json(spark, sf_dir):
    k = F.col("event_id") % 3
    content = F.when(k == 0, F.col("props")).when(k == 1, F.lit('{"bdat-bin:x": "[XENO:wait ]"}')).otherwise(F.concat("props", F.lit("}")))
    return A.table(spark, sf_dir, "events").select("event_id", rebuild.valid_json(content).alias("valid"), F.array_join(rebuild.game_warnings(content), ",").alias("warnings"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 3 THEN '' ELSE props END AS reply FROM events""")
def salvaged_replies(spark, sf_dir):
    k = F.col("event_id") % 4
    reply = F.when(k == 0, F.concat(F.lit("Here it is:\n```json\n"), "props", F.lit("\n```\nDone."))).when(k == 1, F.concat(F.lit("```\n"), "props", F.lit("```"))).when(k == 2, F.concat(F.lit("so "), "props", F.lit(" and so on"))).otherwise("nothing")
    return A.table(spark, sf_dir, "events").select("event_id", quality.reply_json(reply).alias("reply"))


# --- markup ------------------------------------------------------------------------------------------------------------


@query(r"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(text, '[ \xA0]+', ' ', 'g'), '[ \t]+\n', chr(10), 'g'), '\n[ \t]+', chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13))) AS digest
FROM documents WHERE length(text) > 0""")
def cleaned_tags(spark, sf_dir):
    rows = A.text_pairs(spark, sf_dir)
    more = F.regexp_replace("original", r"\n?more words here", "")
    return rows.select(F.col("seg_no").cast("long").alias("doc_id"), F.md5(markup.clean_text(more)).alias("digest"))


@query("""SELECT doc_id, CAST(unnest([0, 16 + length(text), 16 + 22 + length(text) + CASE WHEN doc_id % 2 = 0 THEN 16 ELSE 0 END]) AS INTEGER) AS position,
  unnest(['XENO', 'System', 'System']) AS type, unnest(['wait', 'Color', '/System:Color']) AS name, unnest(['a=b', 'name=x', '']) AS attributes FROM documents WHERE length(text) > 0""")
def extracted_tags(spark, sf_dir):
    rows = A.text_pairs(spark, sf_dir).select(F.col("seg_no").cast("long").alias("doc_id"), F.inline(markup.extract_tags(F.col("original"))))
    pairs = F.array_join(F.transform(F.map_entries("attributes"), lambda e: F.concat(e.key, F.lit("="), e.value)), ",")
    return rows.select("doc_id", F.col("position").cast("int").alias("position"), "type", "name", pairs.alias("attributes"))


@query("""WITH t AS (SELECT doc_id % 10 AS file_id, text, doc_id % 3 = 0 AS tagged, length(text) + CASE WHEN doc_id % 3 = 0 THEN 12 ELSE 0 END AS size FROM documents WHERE length(text) > 0)
SELECT file_id, count(*) AS total, CAST(count_if(tagged) AS BIGINT) AS with_tags, CAST(floor(avg(size) + 0.5) AS BIGINT) AS average_length, CAST(count_if(tagged) AS BIGINT) AS xeno FROM t GROUP BY file_id""")
def tag_reports(spark, sf_dir):
    docs = A.table(spark, sf_dir, "documents").where("length(text) > 0")
    original = F.concat(F.when(F.col("doc_id") % 3 == 0, "[XENO:wait ]").otherwise(""), "text")
    segments = docs.select((F.col("doc_id") % 10).alias("file_id"), F.create_map(F.lit("original"), original).alias("attrs"))
    return quality.tag_report(segments).select("file_id", "total", "with_tags", "average_length", "xeno")


@query("""WITH s AS (SELECT length(text) AS n, text, doc_id FROM documents WHERE length(text) > 0) SELECT scope, CAST(n AS BIGINT) AS n FROM (
  SELECT unnest(['all', 'short', 'long', 'with_tags', 'no_arabic']) AS scope, unnest([count(*), count_if(n <= 80), count_if(n >= 180), count_if(doc_id % 2 = 0), count_if(doc_id % 4 <> 1)]) AS n FROM (
    SELECT doc_id, n + CASE WHEN doc_id % 2 = 0 THEN 12 ELSE 0 END + CASE WHEN doc_id % 4 = 1 THEN 5 ELSE 0 END AS n FROM s))""")
def review_scopes(spark, sf_dir):
    docs = A.table(spark, sf_dir, "documents").where("length(text) > 0")
    said = F.concat("text", F.when(F.col("doc_id") % 2 == 0, "[XENO:wait ]").otherwise(""), F.when(F.col("doc_id") % 4 == 1, " عربي").otherwise(""))
    entries = docs.select(said.alias("translation"))
    counts = [quality.in_scope(entries, s).agg(F.lit(s).alias("scope"), F.count("*").alias("n")) for s in ("all", "short", "long", "with_tags", "no_arabic")]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


@query("""SELECT item_id % 4 AS file_id, 'root.m[' || item_id || ']' AS path, CASE WHEN item_id % 3 = 0 THEN 'edited ' || item_id ELSE text END AS suggestion
FROM benchmark WHERE item_id % 5 <> 4 AND NOT item_id % 6 = 5""")
def chosen_suggestions(spark, sf_dir):
    rows = A.table(spark, sf_dir, "benchmark")
    issues = rows.select((F.col("item_id") % 4).alias("file_id"), F.concat(F.lit("root.m["), F.col("item_id").cast("string"), F.lit("]")).alias("path"), "text", F.col("item_id").cast("string").alias("id"))
    issues = issues.withColumn("suggestion", F.when(F.col("id").cast("long") % 6 == 5, " ").otherwise(F.col("text"))).drop("text")
    edited = F.when(F.col("item_id") % 3 == 0, F.concat(F.lit("edited "), F.col("item_id").cast("string")))
    chosen = rows.where("item_id % 5 <> 4").select(F.col("item_id").cast("string").alias("id"), edited.alias("edited"))
    return quality.selected_suggestions(issues, chosen).select("file_id", "path", "suggestion")


@query("""SELECT conv_id AS file_id, 'last ' || conv_id AS first, count(*) AS n, min(text) FILTER (turn = 1) AS second FROM conversations GROUP BY conv_id""")
def patched_json(spark, sf_dir):
    """Suggestions written at their paths; of two for one path the later id wins."""
    files = A.json_files(spark, sf_dir).select("file_id", "content")
    said = lambda word, id_: files.select("file_id", F.lit("root.messages[0].text").alias("path"), F.concat(F.lit(word), F.col("file_id").cast("string")).alias("suggestion"), F.lit(id_).alias("id"))
    out = quality.apply_suggestions(files, said("last ", "b").unionByName(said("early ", "a")))
    return out.select("file_id", F.get_json_object("output", "$.messages[0].text").alias("first"), F.json_array_length(F.get_json_object("output", "$.messages")).cast("long").alias("n"), F.get_json_object("output", "$.messages[1].text").alias("second"))


@query("""WITH p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations)
SELECT conv_id AS file_id, 'root.messages[' || i || '].text' AS path, 'text' AS key, '[XENO:wait ]' || text AS original, 'so: ' || text AS translation FROM p WHERE turn % 3 <> 2""")
def review_pairs(spark, sf_dir):
    """Leaves of an original with the translation at the same path; blank ones drop out."""
    rows = A.table(spark, sf_dir, "conversations")

    def files(said):
        per = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", said.alias("text")))).alias("t"))
        return per.select(F.col("conv_id").alias("file_id"), F.to_json(F.struct(F.transform("t", lambda x: F.struct(x.text.alias("text"))).alias("messages"))).alias("content"))

    pairs = quality.review_entries(files(F.concat(F.lit("[XENO:wait ]"), "text")), files(F.when(F.col("turn") % 3 == 2, " ").otherwise(F.concat(F.lit("so: "), "text"))))
    return pairs.select("file_id", "path", "key", "original", "translation")


@query("""SELECT CAST(c_custkey AS INTEGER) AS part, '"' || replace(c_name, '#', '"') || '","' || c_mktsegment || '"' AS line FROM (SELECT 1 AS c_custkey, replace(c_name, '#', '""') AS c_name, c_mktsegment FROM customer)
UNION ALL SELECT 0, 'c_name,c_mktsegment'""")
def issue_report_lines(spark, sf_dir):
    rows = A.table(spark, sf_dir, "customer").withColumn("c_name", F.replace("c_name", F.lit("#"), F.lit('"')))
    return rebuild.issue_report(rows, ["c_name", "c_mktsegment"])


# --- metadata ----------------------------------------------------------------------------------------------------------


_LANGUAGE_ROWS = ", ".join(f"('{c}', '{n}', '{e}', {str(r).lower()})" for c, n, e, r in LANGUAGES)


@query(f"""SELECT n_nationkey, code, english_name FROM nation JOIN (VALUES {_LANGUAGE_ROWS}) l(code, name, english_name, rtl)
  ON contains(lower(code || ' ' || name || ' ' || english_name), lower(trim(substr(n_name, 1, 1 + n_nationkey % 3))))""")
def picked_languages(spark, sf_dir):
    """Languages that each nation's first letters pick."""
    asked = A.table(spark, sf_dir, "nation").select("n_nationkey", F.expr("concat(' ', substr(n_name, 1, 1 + n_nationkey % 3), ' ')").alias("query"))
    return metadata.pick_languages(asked, "query").select("n_nationkey", "code", "english_name")


@query(f"""WITH {A.TRANSLATIONS} SELECT code, count(*) AS jobs FROM translations JOIN (VALUES {_LANGUAGE_ROWS}) l(code, name, english_name, rtl) ON target_language = code WHERE rtl GROUP BY code""")
def right_to_left_languages(spark, sf_dir):
    """Languages written from right to left, with the jobs that translate into them."""
    rtl = F.broadcast(languages(spark).where("rtl"))
    return A.translations(spark, sf_dir).join(rtl, F.col("target_language") == F.col("code")).groupBy("code").agg(F.count("*").alias("jobs"))


_TERM_ROWS = """SELECT doc_id AS id, string_split(coalesce(text, ''), chr(10))[1] AS term, substr(text, 1, 100 + doc_id % 800) AS translation, CASE WHEN doc_id % 4 > 0 THEN text END AS notes, lang AS source_language,
  CASE WHEN doc_id % 7 = 0 THEN repeat(source, 10) END AS target_language FROM documents"""


def _term_rows(spark, sf_dir):
    return A.table(spark, sf_dir, "documents").selectExpr(
        "doc_id AS id", "split(coalesce(text, ''), '\n')[0] AS term", "substr(text, 1, cast(100 + doc_id % 800 AS int)) AS translation", "CASE WHEN doc_id % 4 > 0 THEN text END AS notes",
        "lang AS source_language", "CASE WHEN doc_id % 7 = 0 THEN repeat(source, 10) END AS target_language",
    )


@query(f"""SELECT id, concat_ws(',', CASE WHEN coalesce(length(term), 0) NOT BETWEEN 1 AND 255 THEN 'term' END, CASE WHEN coalesce(length(translation), 0) NOT BETWEEN 1 AND 500 THEN 'translation' END,
  CASE WHEN length(notes) > 1000 THEN 'notes' END, CASE WHEN length(source_language) > 50 THEN 'source-language' END, CASE WHEN length(target_language) > 50 THEN 'target-language' END) AS errors FROM ({_TERM_ROWS})""")
def term_request_errors(spark, sf_dir):
    """First lines and whole texts as terms to be added."""
    return metadata.checked_requests(_term_rows(spark, sf_dir), "new-term").select("id", F.array_join("errors", ",").alias("errors"))


@query(f"""SELECT id, concat_ws(',', CASE WHEN length(term) NOT BETWEEN 1 AND 255 THEN 'term' END, CASE WHEN length(translation) NOT BETWEEN 1 AND 500 THEN 'translation' END,
  CASE WHEN length(notes) > 1000 THEN 'notes' END, CASE WHEN length(source_language) > 50 THEN 'source-language' END, CASE WHEN length(target_language) > 50 THEN 'target-language' END) AS errors
  FROM (SELECT * REPLACE (CASE WHEN id % 2 = 0 THEN term END AS term, CASE WHEN id % 3 = 0 THEN translation END AS translation) FROM ({_TERM_ROWS}))""")
def term_change_errors(spark, sf_dir):
    """The same as changes, in which a field may be left out."""
    rows = _term_rows(spark, sf_dir).withColumn("term", F.expr("CASE WHEN id % 2 = 0 THEN term END")).withColumn("translation", F.expr("CASE WHEN id % 3 = 0 THEN translation END"))
    return metadata.checked_requests(rows, "changed-term").select("id", F.array_join("errors", ",").alias("errors"))


@query("""SELECT conv_id, turn, concat_ws(',', CASE WHEN turn % 3 = 0 THEN 'translated' END, CASE WHEN role NOT IN ('symbols', 'all') AND turn % 2 = 1 THEN 'mode' END,
  CASE WHEN length(text) / 100.0 > 2 THEN 'temperature' END) AS errors FROM conversations""")
def review_request_errors(spark, sf_dir):
    rows = A.table(spark, sf_dir, "conversations").selectExpr(
        "conv_id", "turn", "text AS original", "CASE WHEN turn % 3 > 0 THEN text END AS translated", "CASE WHEN turn % 2 = 1 THEN role ELSE 'line-split' END AS mode", "length(text) / 100.0D AS temperature"
    )
    return metadata.checked_requests(rows, "review").select("conv_id", "turn", F.array_join("errors", ",").alias("errors"))


@query("""SELECT conv_id, concat_ws(',', CASE WHEN count(*) % 3 = 0 THEN 'translated' END, CASE WHEN bool_or(turn % 5 = 4) THEN 'suggestions' END) AS errors FROM conversations GROUP BY conv_id""")
def apply_request_errors(spark, sf_dir):
    one = F.struct(F.concat(F.lit("root."), F.col("turn").cast("string")).alias("path"), F.when(F.col("turn") % 5 != 4, F.col("text")).alias("suggestion"))
    rows = A.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.when(F.count("*") % 3 != 0, F.lit("{}")).alias("translated"), F.collect_list(one).alias("suggestions"))
    return metadata.checked_requests(rows, "apply").select("conv_id", F.array_join("errors", ",").alias("errors"))


@query("""SELECT page_id, concat_ws(',', CASE WHEN page_id % 5 = 0 THEN 'file-type' END, CASE WHEN contains(html, '<form') THEN 'content' END) AS errors FROM pages""")
def upload_request_errors(spark, sf_dir):
    rows = A.table(spark, sf_dir, "pages").selectExpr("page_id", "url AS file_name", "CASE WHEN page_id % 5 > 0 THEN 'html' END AS file_type", "CASE WHEN NOT contains(html, '<form') THEN html END AS content")
    return metadata.checked_requests(rows, "upload").select("page_id", F.array_join("errors", ",").alias("errors"))


@query("""SELECT o_orderkey, o_orderkey % 2 = 0 AS restore_tags, CASE WHEN o_orderkey % 3 = 0 THEN 30 ELSE CAST(o_orderkey % 100 AS INTEGER) END AS chunk_size, o_orderpriority AS theme,
  '{"restore_tags":' || CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE 'false' END || ',"chunk_size":500,"theme":"' || o_orderpriority || '"}' AS stored FROM orders""")
def typed_settings(spark, sf_dir):
    """Settings in their types: a stored value of another type leaves the default; then one field is changed and all are stored again."""
    size = F.when(F.col("o_orderkey") % 3 == 0, F.lit('"many"')).otherwise((F.col("o_orderkey") % 100).cast("string"))
    tags = F.when(F.col("o_orderkey") % 2 == 0, F.lit("true")).otherwise(F.lit("false"))
    stored = F.concat(F.lit('{"restore_tags":'), tags, F.lit(',"chunk_size":'), size, F.lit(',"theme":"'), "o_orderpriority", F.lit('","other":1}'))
    read = metadata.read_settings(stored, "restore_tags boolean, chunk_size int, theme string", {"restore_tags": True, "chunk_size": 30, "theme": "plain"})
    changes = F.struct(F.lit(None).cast("boolean").alias("restore_tags"), F.lit(500).alias("chunk_size"), F.lit(None).cast("string").alias("theme"))
    rows = A.table(spark, sf_dir, "orders").select("o_orderkey", read.alias("s"))
    return rows.select("o_orderkey", "s.*", metadata.saved_settings(F.col("s"), changes, ["restore_tags", "chunk_size", "theme"]).alias("stored"))


@query(f"""WITH {A.TRANSLATIONS}, {A.GLOSSARY}, terms AS (SELECT t.id AS job_id, g.* FROM translations t JOIN glossary g ON t.user_id = g.user_id
  AND coalesce(g.source_language, '') IN ('', t.source_language) AND coalesce(g.target_language, '') IN ('', t.target_language) WHERE term <> '' AND translation <> ''),
lines AS (SELECT job_id, string_agg('- "' || term || '" -> "' || translation || '"' || CASE WHEN coalesce(notes, '') <> '' THEN ' (' || notes || ')' ELSE '' END, chr(10) ORDER BY id) AS l FROM terms GROUP BY job_id)
SELECT id AS job_id, replace(replace('{PROMPT.replace("'", "''")}', '{{source}}', source_language), '{{target}}', target_language) || coalesce(chr(10) || 'Terms with a fixed translation:' || chr(10) || l, '') AS prompt
FROM translations LEFT JOIN lines ON job_id = id""")
def prompts_of_jobs(spark, sf_dir):
    """The prompt of each job with the terms of its user and languages."""
    jobs = A.translations(spark, sf_dir)
    return job_prompts(jobs, metadata.glossary_for_jobs(jobs, A.glossary(spark, sf_dir)))


@query("""WITH entries AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
SELECT conv_id AS file_id, 'root.' || turn AS path, 'ai-enhance' AS kind, 'medium' AS severity, md5(text || '?') AS suggestion FROM entries WHERE i < 80 AND i % 2 = 0 AND least(n, 80) % 5 <> 3""")
def ai_reviewed(spark, sf_dir):
    """Issues of a reviewer that is a Python function: one call for each file, its replies joined by index; files whose calls fail have none."""
    rows = A.table(spark, sf_dir, "conversations")
    path = F.concat(F.lit("root."), F.col("turn").cast("string")).alias("path")
    entries = rows.select(F.col("conv_id").alias("file_id"), F.col("turn").alias("seg_no"), path, F.lit("text").alias("key"), F.col("text").alias("original"), F.concat("text", F.lit("!")).alias("translation"))

    def reviewer(batch, glossary: str) -> str:
        if len(batch) % 5 == 3:
            raise ValueError("refused")
        return json.dumps({"issues": [{"index": i, "suggestion": f"{original}?"} for i, original, _ in batch if i % 2 == 0]})

    found = quality.review_with(entries, reviewer, attempts=2, first_wait_s=0.0)
    return found.select("file_id", "path", "kind", "severity", F.md5("suggestion").alias("suggestion"))


_BALANCED = r"""given AS (SELECT conv_id, turn, 1 + turn % 5 AS n, regexp_replace(regexp_replace(regexp_replace(text, '\s*\n\s*', ' ', 'g'), '\s{2,}', ' ', 'g'), '^\s+|\s+$', '', 'g') AS t FROM conversations),
cut AS (SELECT *, list_filter(regexp_split_to_array(t, '\s+'), lambda w: w <> '') AS w FROM given),
shares AS (SELECT *, greatest(1, ceil(CAST(length(array_to_string(w, '')) AS DOUBLE) / n)) AS share FROM cut WHERE n > 1 AND len(w) > n),
walk AS (
  SELECT conv_id, turn, 1 AS i, 0 AS done, length(w[1]) AS line, w[1] AS laid FROM shares
  UNION ALL
  SELECT conv_id, turn, i + 1, done + CAST(full_ AS INTEGER), CASE WHEN full_ THEN size ELSE line + 1 + size END, laid || CASE WHEN full_ THEN chr(10) ELSE ' ' END || word FROM (
    SELECT k.*, w[i + 1] AS word, length(w[i + 1]) AS size, done < n - 1 AND line + 1 + length(w[i + 1]) > share AS full_ FROM walk k JOIN shares s USING (conv_id, turn) WHERE i < len(w))
)"""


@query(rf"""WITH RECURSIVE {_BALANCED}
SELECT conv_id, turn, CASE WHEN n <= 1 OR t = '' THEN t WHEN len(w) <= n THEN array_to_string(w, chr(10)) ELSE laid END AS laid
FROM cut LEFT JOIN (SELECT conv_id, turn, laid FROM walk QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY i DESC) = 1) l USING (conv_id, turn)""")
def balanced_texts(spark, sf_dir):
    """All turns laid out on one to five lines."""
    rows = A.table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", text.balanced_lines(F.col("text"), (1 + F.col("turn") % 5).cast("int")).alias("laid"))


@query(f"WITH {A.TRANSLATIONS} SELECT id, status FROM translations WHERE status IN ('processing', 'paused') AND uploaded_file_id = 21 ORDER BY created_at DESC, id DESC LIMIT 1")
def running_job(spark, sf_dir):
    return metadata.in_progress(A.translations(spark, sf_dir), 21).select("id", "status")


@query("""SELECT doc_id, concat_ws(',', CASE WHEN length(source) = 0 OR doc_id % 11 = 0 THEN 'file-name' END, CASE WHEN doc_id % 4 = 0 THEN 'source-language' END, CASE WHEN doc_id % 5 = 0 THEN 'target-language' END,
  CASE WHEN doc_id % 3 = 0 THEN 'chunk-size' END, CASE WHEN doc_id % 7 = 0 THEN 'temperature' END) AS errors FROM documents""")
def request_errors(spark, sf_dir):
    k = F.col("doc_id")
    name = F.when(k % 11 == 0, F.repeat(F.lit("x"), F.lit(256))).otherwise(F.col("source"))
    source = F.when(k % 4 == 0, F.lit(None).cast("string")).otherwise("en")
    target = F.when(k % 5 == 0, "xx").otherwise("ar")
    size = F.when(k % 3 == 0, 2001).when(k % 3 == 1, F.lit(None).cast("int")).otherwise(500)
    heat = F.when(k % 7 == 0, 2.5).when(k % 7 == 1, F.lit(None).cast("double")).otherwise(0.2)
    rows = A.table(spark, sf_dir, "documents").select("doc_id", name.alias("file_name"), source.alias("source_language"), target.alias("target_language"), size.alias("chunk_size"), heat.alias("temperature"))
    return metadata.checked_requests(rows).select("doc_id", F.array_join("errors", ",").alias("errors"))


@query("SELECT conv_id, turn, role FROM conversations WHERE role <> 'system'")
def shown_messages(spark, sf_dir):
    return metadata.without_system(A.table(spark, sf_dir, "conversations")).select("conv_id", "turn", "role")


@query("SELECT n_nationkey, n_name FROM nation UNION ALL SELECT r_regionkey, r_name FROM region")
def appended_rows(spark, sf_dir):
    """Rows inserted in two steps and read back."""
    path = f"{shared_folder(spark)}/appended-{uuid.uuid4().hex}"
    metadata.append_rows(A.table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), path)
    metadata.append_rows(A.table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_nationkey"), F.col("r_name").alias("n_name")), path)
    return spark.read.parquet(path)


@query("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE 'default' END AS theme, CASE WHEN c_custkey % 4 = 0 THEN 'off' ELSE 'on' END AS restore_tags, 'all' AS scope FROM customer""")
def merged_settings(spark, sf_dir):
    """Stored settings over the defaults; what is not known or not valid leaves the default."""
    k = F.col("c_custkey")
    stored = F.when(k % 4 == 0, F.to_json(F.struct(F.col("c_mktsegment").alias("theme"), F.lit("off").alias("restore_tags"), F.lit(1).alias("unknown"))))
    stored = stored.when(k % 4 == 2, F.to_json(F.struct(F.col("c_mktsegment").alias("theme")))).when(k % 4 == 1, F.lit("{broken"))
    rows = A.table(spark, sf_dir, "customer").select("c_custkey", stored.alias("stored"))
    merged = metadata.merged_settings(F.col("stored"), {"theme": "default", "restore_tags": "on", "scope": "all"})
    return rows.select("c_custkey", merged.alias("s")).select("c_custkey", *[F.col("s")[n].alias(n) for n in ("theme", "restore_tags", "scope")])


@query(f"""WITH {A.GLOSSARY} SELECT string_agg('- "' || term || '" -> "' || translation || '"' || CASE WHEN coalesce(notes, '') <> '' THEN ' (' || notes || ')' ELSE '' END, chr(10) ORDER BY id) AS prompt_lines
  FROM (SELECT * FROM glossary WHERE term <> '' AND translation <> '' ORDER BY id LIMIT 120)""")
def review_glossary_prompt(spark, sf_dir):
    return glossary_lines(A.glossary(spark, sf_dir), quality.AI_GLOSSARY_LIMIT)


@query("""SELECT user_id AS job_id, event_id, max(progress) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS shown FROM (SELECT user_id, event_id, ts, CAST(event_id % 101 AS DOUBLE) AS progress FROM events)""")
def shown_progress(spark, sf_dir):
    """Progress as a poller shows it: it never falls."""
    rows = A.table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), "event_id", "ts", (F.col("event_id") % 101).cast("double").alias("progress"))
    return metadata.never_falling(rows, "job_id", "progress", "ts", "event_id").select("job_id", "event_id", "shown")


@query("""SELECT doc_id, length(regexp_replace(text, '\\s', '', 'g')) = 0 AS blank FROM documents WHERE text IS NOT NULL""")
def blank_texts(spark, sf_dir):
    return A.table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", is_blank(F.col("text")).alias("blank"))
