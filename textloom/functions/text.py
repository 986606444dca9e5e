"""Text functions as column expressions; but for chunks of so many words, nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..jsstr import WS, let, trim, words
from .chunks import chunked

JAPANESE = r"[぀-ゟ゠-ヿ一-鿿]"
ARABIC = r"[؀-ۿ]"


def normalize_breaks(text: Column) -> Column:
    """CRLF, a literal backslash-n and <br> as line feeds."""
    text = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\\n"), F.lit("\n"))
    return F.regexp_replace(text, rf"(?i)<br{WS}*/?>", "\n")


def count_lines(text: Column) -> Column:
    return F.size(F.split(normalize_breaks(text), "\n"))


def one_line(text: Column) -> Column:
    """Breaks with the white space around them as one blank, longer runs of white space too.

    Each run is taken whole and once; looked for as white space before a break, a long run without one would cost its square.
    """
    return trim(F.regexp_replace(text, rf"{WS}{{2,}}+|\n", " "))


def balanced_lines(text: Column, lines: Column) -> Column:
    """The text on so many lines, filled greedily to an even share of its letters."""

    def filled(tokens: Column) -> Column:
        total = F.aggregate(tokens, F.lit(0), lambda acc, w: acc + F.length(w))
        return let(F.greatest(F.lit(1), F.ceil(total / lines).cast("int")), lambda share: _fill(tokens, lines, share))

    def laid(joined: Column) -> Column:
        tokens = F.filter(words(joined), lambda w: w != "")
        spread = let(tokens, lambda t: F.when(F.size(t) <= lines, F.array_join(t, "\n")).otherwise(filled(t)))
        return F.when((lines <= 1) | (joined == ""), joined).otherwise(spread)

    return let(one_line(normalize_breaks(text)), laid)


def _fill(tokens: Column, lines: Column, share: Column) -> Column:
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("line"))

    def place(acc: Column, word: Column) -> Column:
        full = (F.size(acc.done) < lines - 1) & (acc.line != "") & (F.length(acc.line) + 1 + F.length(word) > share)
        return F.struct(
            F.when(full, F.array_append(acc.done, acc.line)).otherwise(acc.done).alias("done"),
            F.when(full | (acc.line == ""), word).otherwise(F.concat(acc.line, F.lit(" "), word)).alias("line"),
        )

    return F.aggregate(tokens, start, place, lambda acc: F.array_join(F.array_append(acc.done, acc.line), "\n"))


def sentences(text: Column, lossless: bool = False) -> Column:
    """Sentences with what is left over as the last one.

    The default follows the usual form, which measures the rest by the length of what matched: text that the pattern skips
    (before a terminator without letters, or at an inner break) is lost and the tail repeated. `lossless` keeps every character
    that is no white space.
    """

    def every(whole: Column) -> Column:
        found = F.transform(F.regexp_extract_all(whole, F.lit(rf"[^.!?\n]*+[.!?\n]++{WS}*+|[^.!?\n]++"), 0), trim)
        return F.filter(found, lambda s: s != "")

    def usual(whole: Column) -> Column:
        # Entered where the last match ended or where a run begins only: a run without an end is then passed over once.
        ended = F.regexp_extract_all(whole, F.lit(rf"(?:\G|(?<![^.!?\n]))[^.!?\n]++[.!?]++{WS}*+"), 0)

        def with_rest(found: Column) -> Column:
            used = F.aggregate(found, F.lit(0), lambda acc, s: acc + F.length(s))
            kept = F.transform(found, trim)
            out = let(trim(F.substr(whole, used + 1)), lambda rest: F.when(rest != "", F.array_append(kept, rest)).otherwise(kept))
            return let(out, lambda x: F.when(F.size(x) == 0, F.array(whole)).otherwise(x))

        return let(ended, with_rest)

    return let(trim(text), every if lossless else usual)


def smart_chunks(text: Column, max_words: int = 500, lossless: bool = False) -> Column:
    """Sentences packed in order into chunks of at most `max_words` words; a longer sentence is a chunk of its own."""
    return chunked(text, max_words, lossless)


def split_after_commas(text: Column) -> Column:
    """A break after each comma, Latin or Arabic, in place of the white space after it; one empty line at most."""
    return trim(F.regexp_replace(F.regexp_replace(text, rf"([,،]){WS}+", "$1\n"), r"\n{3,}", "\n\n"))


def is_japanese(text: Column) -> Column:
    return text.rlike(JAPANESE)


def has_arabic(text: Column) -> Column:
    return text.rlike(ARABIC)


def parent_path(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def join_path(base: Column, relative: Column) -> Column:
    """A relative path from a base, with `.` and `..` resolved; a leading slash starts at the root."""
    parts = F.filter(F.split(F.concat(base, F.lit("/"), relative), "/"), lambda p: (p != "") & (p != "."))
    walked = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, p: F.when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, p)),
    )
    return F.when(base == "", relative).when(F.startswith(relative, F.lit("/")), F.substr(relative, F.lit(2))).otherwise(F.array_join(walked, "/"))


def normalize_key(key: Column) -> Column:
    return F.regexp_replace(key, "^/+", "")


def format_file_size(size: Column) -> Column:
    return (
        F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
        .when(size < 1024 * 1024, F.format_string("%.1f KB", size / 1024))
        .otherwise(F.format_string("%.2f MB", size / (1024 * 1024)))
    )


def compact_text(text: Column, limit: int = 80) -> Column:
    """White space collapsed, clipped with an ellipsis."""
    short = trim(F.regexp_replace(text, WS + "+", " "))
    return F.when(F.length(short) > limit, F.concat(F.substring(short, 1, limit), F.lit("…"))).otherwise(short)


# Parts of field names whose values are never logged.
SENSITIVE = ("password", "token", "secret", "key", "authorization", "cookie", "session")


def clip(text: Column, limit: int = 1000) -> Column:
    """At most `limit` characters, with a mark where more was cut."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("...[truncated]"))).otherwise(text)


def is_sensitive(name: Column) -> Column:
    """Whether a field's name says that its value must not be logged."""
    return F.lower(name).rlike("|".join(SENSITIVE))


def mask_sensitive(name: Column, value: Column) -> Column:
    return F.when(is_sensitive(name), F.lit("[REDACTED]")).otherwise(value)


def output_name(name: Column, target: Column) -> Column:
    """`base_target.ext` of a file name; a name without a dot is its own base and extension."""
    extension = F.element_at(F.split(name, r"\."), -1)
    return F.concat(F.regexp_replace(name, r"\.[^.]+$", ""), F.lit("_"), target, F.lit("."), extension)


def progress_percent(processed: Column, total: Column) -> Column:
    return F.when(total == 0, 100.0).otherwise(processed / total * 100)


# Technical patterns inside texts, in the order in which they are looked for.
FORMAT_PATTERNS = (
    r"\{[a-zA-Z_][a-zA-Z0-9_]*\}",
    r"\$[a-zA-Z_][a-zA-Z0-9_]*",
    r"\[[a-zA-Z_][a-zA-Z0-9_]*\]",
    r"<[a-zA-Z][a-zA-Z0-9]*>",
    r"`[^`]*`",
    r"(?i)\[code\].*?\[/code\]",
    r"(?i)\[b\].*?\[/b\]",
    r"(?i)\[i\].*?\[/i\]",
    r"(?i)\[u\].*?\[/u\]",
    r"(?i)\[color[^\]]*\].*?\[/color\]",
    r"(?i)\[size[^\]]*\].*?\[/size\]",
    r"(?i)\[font[^\]]*\].*?\[/font\]",
    r"\n",
    r"\t",
)


def format_tags(text: Column) -> Column:
    """All technical patterns of a text, pattern by pattern."""
    return F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(p), 0) for p in FORMAT_PATTERNS]))


def restore_format_tags(text: Column, tags: Column) -> Column:
    """Tags that the text lacks, appended with a blank before each."""
    return F.aggregate(tags, text, lambda acc, t: F.when(F.contains(acc, t), acc).otherwise(F.concat(acc, F.lit(" "), t)))


def format_date(at: Column) -> Column:
    """Day, month and year with the time, for lists."""
    return F.date_format(at, "d MMMM yyyy HH:mm")


def read_path(tree: Column, path: Column) -> Column:
    """The scalar at a path such as `root.a.b[0]` of a JSON text; null where there is none."""
    return F.call_function("get_json_object", tree, F.concat(F.lit("$"), F.substr(path, F.lit(5))))


def login_method(platforms: Column, fallback: Column) -> Column:
    """The first known sign-in platform in order of priority, else the lower-cased fallback."""
    out = F.lit(None).cast("string")
    for platform, name in reversed((("REGISTERED_PLATFORM_EMAIL", "email"), ("REGISTERED_PLATFORM_GOOGLE", "google"), ("REGISTERED_PLATFORM_APPLE", "apple"), ("REGISTERED_PLATFORM_MICROSOFT", "microsoft"), ("REGISTERED_PLATFORM_AZURE", "microsoft"), ("REGISTERED_PLATFORM_GITHUB", "github"))):
        out = F.when(F.array_contains(platforms, platform), name).otherwise(out)
    first = F.lower(F.get(platforms, F.lit(0)))
    return F.when(fallback.isNotNull() & (fallback != ""), fallback).otherwise(F.coalesce(out, first))
