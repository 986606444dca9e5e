"""Job metadata: lookups, history, search, glossary scope, counters, upserts and requests."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.text import SENSITIVE
from ..jsstr import trim, utf16_length
from ..schema import LANGUAGES, MEDIA_BY_EXTENSION, MEDIA_BY_TYPE, STATUSES, UPLOAD_EXTENSIONS, UPLOAD_LIMIT_BYTES, languages


def lookup(table: DataFrame, column: str, value) -> DataFrame:
    """The first row with a value, by id."""
    return table.where(F.col(column) == value).orderBy("id").limit(1)


def owned(table: DataFrame, user_id: int) -> DataFrame:
    return table.where(F.col("user_id") == user_id)


def may_access(table: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests (id, user_id) with `allowed`: the row exists and is the user's own."""
    own = table.select(F.col("id"), F.col("user_id").alias("owner"))
    return requests.join(own, "id", "left").select("id", "user_id", F.coalesce(F.col("owner") == F.col("user_id"), F.lit(False)).alias("allowed"))


def history(translations: DataFrame, user_id: int | None = None) -> DataFrame:
    """Newest first; equal times by id."""
    rows = translations if user_id is None else owned(translations, user_id)
    return rows.orderBy(F.desc("created_at"), F.desc("id"))


def with_language_names(translations: DataFrame) -> DataFrame:
    """Names of both languages; the dimension has 31 rows and is broadcast."""
    names = languages(translations.sparkSession)
    side = lambda p: F.broadcast(names.select(F.col("code").alias(f"{p}_language"), F.col("name").alias(f"{p}_name"), F.col("english_name").alias(f"{p}_english")))
    return translations.join(side("source"), "source_language", "left").join(side("target"), "target_language", "left")


def search_history(translations: DataFrame, query: str = "", status: str = "all") -> DataFrame:
    """Rows of a status whose codes, names or status contain the query, in any case."""
    rows = with_language_names(translations)
    if status != "all":
        rows = rows.where(F.col("status") == status)
    columns = ("source_language", "target_language", "source_name", "source_english", "target_name", "target_english", "status")
    filled = [F.when(F.col(c) != "", F.col(c)) for c in columns]
    return rows.where(F.contains(F.lower(F.concat_ws(" ", *filled)), F.lit(query.lower())))


def scoped_glossary(glossary: DataFrame, source: str, target: str) -> DataFrame:
    """Terms for a pair of languages; a null or empty language matches any."""
    any_or = lambda c, v: F.coalesce(F.col(c), F.lit("")).isin("", v)
    return glossary.where(any_or("source_language", source) & any_or("target_language", target)).select("id", "term", "translation", "notes")


def glossary_for_jobs(jobs: DataFrame, glossary: DataFrame) -> DataFrame:
    """(job_id, id, term, translation, notes): each job with the terms of its user and languages.

    The wildcard is made an equality: a term is offered under its own language or under the any-language key, and a job asks
    for both, so that the join is by key.
    """
    any_key = F.lit("")
    terms = glossary.select("user_id", F.coalesce("source_language", any_key).alias("s"), F.coalesce("target_language", any_key).alias("t"), "id", "term", "translation", "notes")
    asked = jobs.select(F.col("id").alias("job_id"), "user_id", F.explode(F.array_distinct(F.array("source_language", any_key))).alias("s"), "target_language")
    asked = asked.withColumn("t", F.explode(F.array_distinct(F.array("target_language", any_key)))).drop("target_language")
    return asked.join(terms, ["user_id", "s", "t"]).select("job_id", "id", "term", "translation", "notes")


def search_glossary(glossary: DataFrame, query: str) -> DataFrame:
    text = F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in ("term", "translation", "notes", "source_language", "target_language")])
    wanted = query.strip().lower()
    return glossary if not wanted else glossary.where(F.contains(F.lower(text), F.lit(wanted)))


def pick_languages(asked: DataFrame, query: str) -> DataFrame:
    """Rows of `asked`, each with the languages (code, english_name) whose code, own name or English name contains its query text.

    Each row meets the 31 languages in place, without a join; a blank query picks all of them, a null one none.
    """
    known = F.array(*[F.struct(F.lit(c).alias("code"), F.lit(e).alias("english_name"), F.lit(f"{c} {n} {e}".lower()).alias("_text")) for c, n, e, _ in LANGUAGES])
    wanted = F.lower(trim(F.col(query)))
    picked = F.filter(known, lambda x: F.contains(x["_text"], wanted))
    return asked.select("*", F.explode(F.transform(picked, lambda x: F.struct(x["code"].alias("code"), x["english_name"].alias("english_name")))).alias("_l")).select(*asked.columns, "_l.code", "_l.english_name")


def pick_language(spark, query: str) -> DataFrame:
    """The languages that one query text picks."""
    return pick_languages(spark.range(1).select(F.lit(query).alias("q")), "q").select("code", "english_name")


def status_counts(translations: DataFrame, *by: str) -> DataFrame:
    """One row (for each group): total and the count of each state, 0 where there is none."""
    counts = [F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES]]
    return (translations.groupBy(*by) if by else translations.groupBy()).agg(*counts)


def admitted(uploads: DataFrame) -> DataFrame:
    """Uploads (file_name, size) with `ok` and `reason`: known extension, at most 25 MB."""
    known = F.lower(F.element_at(F.split("file_name", r"\."), -1)).isin(*UPLOAD_EXTENSIONS)
    reason = F.when(~known, "unsupported-type").when(F.col("size") > UPLOAD_LIMIT_BYTES, "too-large")
    return uploads.withColumns({"ok": reason.isNull(), "reason": reason})


def media_type(name: Column) -> Column:
    extension = F.lower(F.element_at(F.split(name, r"\."), -1))
    table = F.create_map(*[F.lit(x) for pair in MEDIA_BY_EXTENSION.items() for x in pair])
    return F.coalesce(F.try_element_at(table, extension), F.lit("application/octet-stream"))


def media_type_of(kind: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in MEDIA_BY_TYPE.items() for x in pair])
    return F.coalesce(F.try_element_at(table, kind), F.lit("application/octet-stream"))


def _length(name: str, least: int, most: int, optional: bool = False) -> Column:
    """Too short or too long in UTF-16 units; what is not given is wrong unless it is optional."""
    size = utf16_length(F.col(name))
    return F.coalesce((size < least) | (size > most), F.lit(not optional))


def _range(name: str, low: float, high: float) -> Column:
    return F.coalesce((F.col(name) < low) | (F.col(name) > high), F.lit(False))


def _among(name: str, *values: str) -> Column:
    return ~F.coalesce(F.col(name).isin(*values), F.lit(False))


_UNLIMITED = 2**31 - 1
_TERM = {"term": (1, 255), "translation": (1, 500), "notes": (0, 1000), "source-language": (0, 50), "target-language": (0, 50)}


def _rules(kind: str) -> dict[str, Column]:
    """What makes a request of a kind wrong, by the name of the field."""
    codes = [code for code, *_ in LANGUAGES]
    column = lambda name: name.replace("-", "_")
    if kind == "translate":
        return {
            "file-name": _length("file_name", 1, 255),
            "source-language": _among("source_language", *codes),
            "target-language": _among("target_language", *codes),
            "chunk-size": _range("chunk_size", 1, 2000),
            "temperature": _range("temperature", 0, 2),
        }
    if kind == "review":
        return {
            "original": _length("original", 0, _UNLIMITED),
            "translated": _length("translated", 0, _UNLIMITED),
            "mode": _among("mode", "symbols", "line-split", "ai", "all"),
            "temperature": _range("temperature", 0, 2),
        }
    if kind == "apply":
        broken = F.exists("suggestions", lambda x: x.path.isNull() | x.suggestion.isNull())
        return {"translated": _length("translated", 0, _UNLIMITED), "suggestions": F.coalesce(broken, F.lit(True))}
    if kind == "upload":
        return {column_name.replace("_", "-"): _length(column_name, 0, _UNLIMITED) for column_name in ("file_name", "file_type", "content")}
    if kind == "new-term":
        return {name: _length(column(name), *bounds, optional=bounds[0] == 0) for name, bounds in _TERM.items()}
    if kind == "changed-term":
        return {"id": F.col("id").isNull(), **{name: _length(column(name), *bounds, optional=True) for name, bounds in _TERM.items()}}
    raise ValueError(f"no requests of kind {kind!r}")


def checked_requests(requests: DataFrame, kind: str = "translate") -> DataFrame:
    """Requests with `errors`: the fields that are wrong in each, empty if none is.

    Kinds and columns: translate (file_name, source_language, target_language, chunk_size, temperature), review (original,
    translated, mode, temperature), apply (translated, suggestions of path and suggestion), upload (file_name, file_type, content),
    new-term (term, translation, notes, source_language, target_language), changed-term (the same and id; null: not changed).
    """
    return requests.withColumn("errors", F.array_compact(F.array(*[F.when(broken, F.lit(name)) for name, broken in _rules(kind).items()])))


def in_progress(translations: DataFrame, file_id: int) -> DataFrame:
    """The newest running job of a file."""
    running = F.col("status").isin("processing", "paused") & (F.col("uploaded_file_id") == file_id)
    return history(translations.where(running)).limit(1)


def without_system(messages: DataFrame) -> DataFrame:
    return messages.where(F.col("role") != "system")


def updated(table: DataFrame, changes: DataFrame) -> DataFrame:
    """`table` with the rows of `changes` (id and new values; null keeps the old one)."""
    fresh = changes.select("id", *[F.col(c).alias(f"new_{c}") for c in changes.columns if c != "id"])
    columns = [F.coalesce(f"new_{c}", c).alias(c) if c in changes.columns and c != "id" else F.col(c) for c in table.columns]
    return table.join(fresh, "id", "left").select(*columns)


def deleted(table: DataFrame, ids: DataFrame) -> DataFrame:
    return table.join(ids.select("id"), "id", "left_anti")


def upsert_users(users: DataFrame, changes: DataFrame, owner: str | None, now: Column) -> DataFrame:
    """Users after sign-ins (open_id, name, email, login_method, role, last_signed_in, given array<string>).

    `given` names the fields that a change sets, to null too; a field that it does not name is left alone. A change without any
    renews the last sign-in; the owner becomes admin unless a role is given. Of several changes of a user the last sign-in wins.
    """
    last = Window.partitionBy("open_id").orderBy(F.desc_nulls_last("last_signed_in"))
    one = changes.withColumn("r", F.row_number().over(last)).where("r = 1").drop("r")
    new = one.select("open_id", F.struct(*[c for c in one.columns if c != "open_id"]).alias("n"))
    both = users.join(new, "open_id", "full")
    fresh = F.col("n").isNotNull()
    says = lambda field: fresh & F.array_contains("n.given", field)
    out = {f: F.when(says(f), F.col(f"n.{f}")).otherwise(F.col(f)) for f in ("name", "email", "login_method")}
    is_owner = fresh & (F.col("open_id") == F.lit(owner)) if owner else F.lit(False)
    out["role"] = F.coalesce(F.when(says("role"), F.col("n.role")).when(is_owner, "admin").otherwise(F.col("role")), F.lit("user"))
    sets_none = (F.size("n.given") == 0) & ~is_owner
    signed = F.when(says("last_signed_in"), F.col("n.last_signed_in")).when(fresh & (sets_none | F.col("last_signed_in").isNull()), now)
    out["last_signed_in"] = F.coalesce(signed, F.col("last_signed_in"))
    return both.select("open_id", *[c.alias(n) for n, c in out.items()])


def progress_series(finished: DataFrame) -> DataFrame:
    """Segments (file_id, seg_no, finished_at) with `processed` and `progress` at each completion."""
    by = Window.partitionBy("file_id").orderBy("finished_at", "seg_no")
    total = F.count("*").over(Window.partitionBy("file_id"))
    rows = finished.withColumn("processed", F.row_number().over(by))
    return rows.withColumn("progress", F.col("processed") / total * 100)


def never_falling(rows: DataFrame, key: str, value: str, *order: str) -> DataFrame:
    """`rows` with `shown`: the highest value of the key so far."""
    return rows.withColumn("shown", F.max(value).over(Window.partitionBy(key).orderBy(*order)))


def merged_settings(stored: Column, defaults: dict[str, str]) -> Column:
    """Settings as a map: the stored JSON object's values over the defaults; unknown names and invalid JSON change nothing."""
    read = F.from_json(stored, "map<string,string>")
    value = lambda name, usual: F.coalesce(F.try_element_at(read, F.lit(name)), F.lit(usual))
    return F.create_map(*[x for name, usual in defaults.items() for x in (F.lit(name), value(name, usual))])


def read_settings(stored: Column, schema: str, defaults: dict[str, object]) -> Column:
    """Settings as a struct of typed fields: what the stored JSON object gives in the right type, else the default.

    Unknown names, values of another type, null and invalid JSON leave the default.
    """
    read = F.from_json(stored, schema, {"mode": "PERMISSIVE"})
    return F.struct(*[F.coalesce(read[name], F.lit(usual) if not isinstance(usual, list) else F.array(*map(F.lit, usual))).alias(name) for name, usual in defaults.items()])


def saved_settings(settings: Column, changes: Column, names: list[str]) -> Column:
    """The JSON to store: all named fields, those that `changes` gives (not null) in place of the old ones."""
    return F.to_json(F.struct(*[F.coalesce(changes[n], settings[n]).alias(n) for n in names]))


def newest_within(lines: DataFrame, budget: int, chunk: int = 4096) -> DataFrame:
    """The newest lines (log, line_no, line) of each log that fit a budget of bytes; it stops at the first that does not.

    Sums of chunks of lines come first: only the chunks that the budget reaches are gone through line by line, so that a long
    log is never one task's work.
    """
    size = F.octet_length("line") + 1
    parts = lines.withColumn("part", F.floor(F.col("line_no") / chunk))
    newer = Window.partitionBy("log").orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    sums = parts.groupBy("log", "part").agg(F.sum(size).alias("s")).withColumn("newer", F.coalesce(F.sum("s").over(newer), F.lit(0)))
    reached = parts.join(sums.where(F.col("newer") < budget).select("log", "part", "newer"), ["log", "part"])
    within = Window.partitionBy("log", "part").orderBy(F.desc("line_no"))
    upto = F.col("newer") + F.sum(size).over(within.rowsBetween(Window.unboundedPreceding, 0))
    return reached.withColumn("upto", upto).where(F.col("upto") <= budget).select(*lines.columns)


def keep_last(rows: DataFrame, key: str, order: str, n: int) -> DataFrame:
    by = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("r", F.row_number().over(by)).where(F.col("r") <= n).drop("r")


def classify_requests(requests: DataFrame, limit: int = 10_240) -> DataFrame:
    """Captured requests (status, content_type, declared_length, body): a safe body, and whether they are an error."""
    kind = F.lower(F.coalesce("content_type", F.lit("")))
    body = (
        F.when(kind.rlike("event-stream|ndjson"), "[streaming response]")
        .when(kind.rlike("image|video|audio|octet-stream|pdf|zip"), "[binary response]")
        .when(F.col("declared_length") > limit, "[large response]")
        .otherwise(F.substring("body", 1, limit))
    )
    return requests.withColumns({"body": body, "is_error": F.col("status") >= 400})


def append_rows(table: DataFrame, path: str) -> None:
    """Insert: rows are added beside those that are there."""
    table.write.mode("append").parquet(path)


def _sanitized(value: object, depth: int = 0) -> object:
    if depth > 5:
        return "[Max Depth]"
    if isinstance(value, str):
        return value if len(value) <= 1000 else f"{value[:1000]}...[truncated]"
    if isinstance(value, list):
        return [_sanitized(v, depth + 1) for v in value[:100]]
    if isinstance(value, dict):
        return {k: "[REDACTED]" if any(s in k.lower() for s in SENSITIVE) else _sanitized(v, depth + 1) for k, v in value.items()}
    return value


@F.pandas_udf(StringType())
def sanitize_json(values: pd.Series) -> pd.Series:
    """Logged JSON made safe: sensitive keys redacted, depth 5, strings of 1,000 and arrays of 100 at most; null if invalid."""

    def safe(text: str | None) -> str | None:
        try:
            return None if text is None else json.dumps(_sanitized(json.loads(text)), ensure_ascii=False)
        except ValueError:
            return None

    return values.map(safe)


def blank_to_null(text: Column) -> Column:
    return F.when(trim(text) != "", text)
