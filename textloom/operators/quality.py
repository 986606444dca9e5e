"""Quality scans over (original, translation) pairs, review and patching.

Entries: file_id, path, key, original, translation. Issues: entries with id, suggestion, kind, severity, reason.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import linesplit, markup
from ..functions.text import count_lines, has_arabic, normalize_breaks
from ..jsstr import is_blank, utf16_length
from ..session import Tables, dealt
from ..sources.trees import GAME_KEYS, MAX_DEPTH, game_json_segments, tree_leaves
from .translate import tried

ISSUE = ("file_id", "path", "key", "original", "translation", "id", "suggestion", "kind", "severity", "reason")
AI_LIMIT, AI_GLOSSARY_LIMIT = 80, 120


def review_entries(originals: DataFrame, translations: DataFrame) -> DataFrame:
    """Leaves of the original game JSON with the translated string at the same path; blank ones drop out."""
    left = game_json_segments(originals, exclude_japanese=False).select("file_id", "seg_no", "path", F.col("attrs")["original"].alias("original"))
    right = tree_leaves(translations, "json", "root", GAME_KEYS, MAX_DEPTH).select("file_id", "path", F.col("text").alias("translation"))
    both = left.join(right.where(~is_blank(F.col("translation"))), ["file_id", "path"])
    return both.select("file_id", "seg_no", "path", F.element_at(F.split("path", r"\."), -1).alias("key"), "original", "translation")


def in_scope(entries: DataFrame, scope: str = "all") -> DataFrame:
    text = F.col("translation")
    rules = {
        "all": F.lit(True),
        "short": utf16_length(text) <= 80,
        "long": utf16_length(text) >= 180,
        "with_tags": text.rlike(markup.HAS_TAG),
        "no_arabic": ~has_arabic(text),
    }
    return entries.where(rules[scope])


def _issue(entries: DataFrame, kind: Column, suggestion: Column, severity: Column, reason: Column) -> DataFrame:
    rows = entries.withColumns({"kind": kind, "suggestion": suggestion, "severity": severity, "reason": reason})
    return rows.withColumn("id", F.concat("path", F.lit(":"), "kind")).select(*ISSUE)


def scan_symbols(entries: DataFrame) -> DataFrame:
    """At most one issue for each entry: missing tags, else other tags, else line breaks."""
    o, t = F.col("original"), F.col("translation")
    found = F.struct(markup.tag_texts(o).alias("o"), markup.tag_texts(t).alias("t"))
    compared = lambda x: F.struct(F.size(x.o).alias("_o"), F.size(x.t).alias("_t"), (F.array_sort(x.o) == F.array_sort(x.t)).alias("_same"), (count_lines(o) != count_lines(t)).alias("_uneven"))
    # Generated rows: the conditions below then read the values instead of working them out again. Tags and lines decide first;
    # only what they do not clear is restored.
    rows = entries.where(~is_blank(t)).select("*", F.inline(F.transform(F.array(found), compared)))
    rows = rows.where((F.col("_o") != F.col("_t")) | ~F.col("_same") | F.col("_uneven"))
    rows = rows.select("*", F.inline(F.array(F.struct(markup.restore(o, t).alias("_restored"), normalize_breaks(t).alias("_plain")))))
    breaks = (F.col("_restored") != F.col("_plain")) & F.col("_uneven")
    kind = F.when(F.col("_o") > F.col("_t"), "missing-tags").when((F.col("_t") > F.col("_o")) | ~F.col("_same"), "extra-tags").when(breaks, "line-breaks")
    rows = rows.withColumn("_kind", kind).where("_kind IS NOT NULL")
    severity = F.when(F.col("_kind") == "missing-tags", "high").otherwise("medium")
    reason = F.when(F.col("_kind") == "line-breaks", "lines-missing").otherwise(F.concat(F.lit("tags "), "_o", F.lit(" to "), "_t"))
    return _issue(rows, F.col("_kind"), F.col("_restored"), severity, reason)


def badly_split(entries: DataFrame, compat: bool = True) -> DataFrame:
    """Entries for which a better split is proposed, with `proposed`, `severity` and `reason`.

    The default keeps the usual thresholds, which read the score of badness as one of goodness: entries at 75 or more are left
    out, and those below 45 are high. With `compat=False` an entry is an issue from 25 on, and high from 50 on.
    """
    o, t = F.col("original"), F.col("translation")
    # A generated row: the conditions below then read the values instead of working them out again.
    rows = entries.where(~is_blank(t)).select("*", F.inline(F.array(F.struct(linesplit.diagnose(o, t).alias("_d")))))
    score = F.col("_d.score")
    rows = rows.where(score < 75 if compat else score >= linesplit.SHOWN)
    rows = rows.select("*", F.inline(F.array(F.struct(linesplit.propose(o, t).alias("proposed")))))
    severity = F.when(score < 45 if compat else score >= linesplit.SHOWN_WITHOUT_PROPOSAL, "high").otherwise("medium")
    reason = F.when(F.size("_d.causes") > 0, F.array_join("_d.causes", "; ")).otherwise(F.concat(F.lit("score "), score.cast("string")))
    return rows.where((F.col("proposed") != "") & (F.col("proposed") != t)).withColumns({"severity": severity, "reason": reason}).drop("_d")


def scan_line_split(entries: DataFrame, compat: bool = True) -> DataFrame:
    """Issues of badly split entries; the suggestion has the original's tags again."""
    rows = badly_split(entries, compat)
    return _issue(rows, F.lit("line-split"), markup.restore(F.col("original"), F.col("proposed")), F.col("severity"), F.col("reason"))


def scan_line_split_files(entries: DataFrame, translations: DataFrame) -> DataFrame:
    """Entries (file, index, label, original) joined with translations (file, index, text): badly split ones, worst first.

    Shown from a badness of 25 on; without a proposal of its own only from 50. Easy: the proposal scores 22 at most.
    """
    # Dealt over a fixed number of tasks: the rows cost far more than their bytes say, by which joined tasks are merged.
    n = dealt(entries.sparkSession)
    both = entries.repartition(n, "file", "index").join(translations.where(~is_blank(F.col("text"))).repartition(n, "file", "index").hint("merge"), ["file", "index"])
    o, t = F.col("original"), F.col("text")
    # Generated rows: what follows then reads the values instead of working them out again.
    once = lambda rows, value, name: rows.select("*", F.inline(F.array(F.struct(value.alias(name)))))
    rows = once(both, linesplit.diagnose(o, t), "diagnosis").where(F.col("diagnosis.score") >= linesplit.SHOWN)
    rows = once(rows, linesplit.propose(o, t), "proposed").withColumn("_new", F.col("proposed") != t)
    rows = rows.where(F.col("_new") | (F.col("diagnosis.score") >= linesplit.SHOWN_WITHOUT_PROPOSAL))
    easy = F.col("_new") & (linesplit.diagnose(o, F.col("proposed")).score <= linesplit.EASY)
    # Written before it is ordered: an ordering goes through its rows twice.
    rows = Tables(entries.sparkSession).write(rows.withColumn("difficulty", F.when(easy, "easy").otherwise("hard")), "badly-split")
    out = rows.select(F.concat("file", F.lit(":"), "index").alias("key"), "file", "index", F.coalesce("label", F.lit("")).alias("label"), "original", F.col("text").alias("current"), "proposed", "diagnosis", "difficulty")
    return out.orderBy(F.desc("diagnosis.score"), "file", "index")


def scan_totals(entries: DataFrame, issues: DataFrame) -> DataFrame:
    """(scanned, flagged)."""
    return entries.agg(F.count("*").alias("scanned")).join(issues.agg(F.count("*").alias("flagged")), how="full", on=F.lit(True))


#: Gets up to 80 entries as (index, original, translation) and the glossary's lines; gives the reply's text.
Reviewer = Callable[[list[tuple[int, str, str]], str], str]


def reply_json(reply: Column) -> Column:
    """The outermost braces of a reply, from its fenced block if it has one."""
    fenced = F.regexp_extract(reply, r"(?s)```(?:json)?\s*(.*?)```", 1)
    return F.regexp_extract(F.when(fenced != "", fenced).otherwise(reply), r"(?s)\{.*\}", 0)


REPLY = "struct<issues:array<struct<index:int,suggestion:string,reason:string,detail:string,severity:string>>>"


def reviewer_replies(entries: DataFrame, reviewer: Reviewer, glossary: str = "", attempts: int = 3, first_wait_s: float = 0.25) -> DataFrame:
    """(file_id, reply, error): what a reviewer says to the first 80 entries of each file, one call for each file.

    A call that fails is repeated with growing waits, as the transform does; a file whose last call fails has an error and no reply,
    and stops no other.
    """
    by = Window.partitionBy("file_id").orderBy("seg_no")
    first = entries.withColumn("index", F.row_number().over(by) - 1).where(F.col("index") < AI_LIMIT)
    asked = first.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("index", "original", "translation"))).alias("batch"))

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            said = [tried(lambda e=e: reviewer([(x["index"], x["original"], x["translation"]) for x in e], glossary), attempts, first_wait_s) for e in batch["batch"]]
            yield pd.DataFrame({"file_id": batch["file_id"], "reply": [r for r, _ in said], "error": [e for _, e in said]})

    return asked.mapInPandas(ask, "file_id long, reply string, error string")


def review_with(entries: DataFrame, reviewer: Reviewer, glossary: str = "", attempts: int = 3, first_wait_s: float = 0.25) -> DataFrame:
    """Issues that a reviewer proposes for the first 80 entries of each file; none where it fails (`reviewer_replies` says why)."""
    by = Window.partitionBy("file_id").orderBy("seg_no")
    first = entries.withColumn("index", F.row_number().over(by) - 1).where(F.col("index") < AI_LIMIT)
    replies = reviewer_replies(entries, reviewer, glossary, attempts, first_wait_s).select("file_id", F.from_json(reply_json(F.col("reply")), REPLY).alias("r"))
    found = replies.select("file_id", F.inline("r.issues")).where(~is_blank(F.coalesce("suggestion", F.lit(""))))
    both = first.join(found.withColumnRenamed("severity", "_s").withColumnRenamed("reason", "_r"), ["file_id", "index"])
    both = both.withColumn("_fixed", markup.restore(F.col("original"), F.col("suggestion"))).where("_fixed <> translation")
    return _issue(both, F.lit("ai-enhance"), F.col("_fixed"), F.coalesce("_s", F.lit("medium")), F.coalesce(F.nullif("_r", F.lit("")), F.lit("suggested")))


def review(entries: DataFrame, mode: str = "all", scope: str = "all", reviewer: Reviewer | None = None, compat: bool = True) -> DataFrame:
    """Issues of all scans that a mode names: symbols, line-split, ai or all."""
    scoped = in_scope(entries, scope)
    parts = []
    if mode in ("symbols", "all"):
        parts.append(scan_symbols(scoped))
    if mode in ("line-split", "all"):
        parts.append(scan_line_split(scoped, compat))
    if reviewer is not None and mode in ("ai", "all"):
        parts.append(review_with(scoped, reviewer))
    if not parts:
        raise ValueError(f"no scan for mode {mode!r} without a reviewer")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def selected_suggestions(issues: DataFrame, chosen: DataFrame) -> DataFrame:
    """(file_id, path, suggestion) of chosen issues (id, edited); an edit goes before the suggestion."""
    picked = issues.join(chosen, "id").where(~is_blank(F.coalesce("edited", "suggestion")))
    return picked.select("file_id", "path", F.coalesce("edited", "suggestion").alias("suggestion"), "id")


def apply_suggestions(translations: DataFrame, suggestions: DataFrame) -> DataFrame:
    """Translated JSON files (file_id, content) with suggestions written at their paths; of several the last id wins."""
    from .rebuild import write_json

    last = suggestions.groupBy("file_id", "path").agg(F.max_by("suggestion", "id").alias("translated"))
    segments = last.withColumns({"text": F.col("translated"), "seg_no": F.lit(0)})
    return write_json(translations, segments)


def tag_report(segments: DataFrame) -> DataFrame:
    """(file_id, total, with_tags, average_length, xeno, system, ml) of game segments; lengths are of the originals."""
    original = F.col("attrs")["original"]
    rows = segments.select("file_id", original.alias("original"), markup.extract_tags(original).alias("tags"))
    of = lambda kind: F.sum(F.size(F.filter("tags", lambda t: t.type == kind)))
    return rows.groupBy("file_id").agg(
        F.count("*").alias("total"),
        F.count_if(F.size("tags") > 0).alias("with_tags"),
        F.round(F.avg(F.length("original"))).cast("long").alias("average_length"),
        of("XENO").alias("xeno"),
        of("System").alias("system"),
        of("ML").alias("ml"),
    )


def samples(segments: DataFrame, n: int = 5) -> DataFrame:
    by = Window.partitionBy("file_id").orderBy("seg_no")
    return segments.withColumn("r", F.row_number().over(by)).where(F.col("r") <= n).drop("r")
