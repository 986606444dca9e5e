"""Inline markup of game texts: finding, removing and restoring tags, as column expressions.

A tag is `[XENO:name a=b ]`, `[System:name ...]`, `[ML:name ...]` or a closing `[/name]`.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..jsstr import WHITE_CLASS, WS, let, trim
from .text import balanced_lines, count_lines, normalize_breaks

# The kinds of tags and what they look like.
KINDS = ("XENO", "System", "ML")
OPENING = {k: rf"\[{k}:([a-zA-Z_]+)(?:{WS}+([^\]]*))?{WS}*\]" for k in KINDS}
CLOSING = r"\[/([a-zA-Z_:]+)\]"
ANY_TAG = r"\[(?:XENO|System|ML):[^\]]+\]|\[/[A-Za-z_:]+\]"
HAS_TAG = r"\[(?:XENO|System|ML):|\[/[A-Za-z_:]+\]"


def tag_texts(text: Column) -> Column:
    """All tags of a text, kind by kind (closing tags last)."""
    return F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(p), 0) for p in (*OPENING.values(), CLOSING)]))


def _places(text: Column, found: Column) -> Column:
    """Where each of the texts in `found` (in order, without overlaps) stands, from 0."""
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("places"))

    def place(acc: Column, tag: Column) -> Column:
        here = F.call_function("locate", tag, text, acc.at)
        return F.struct((here + F.length(tag)).alias("at"), F.array_append(acc.places, here - 1).alias("places"))

    return F.aggregate(found, start, place, lambda acc: acc.places)


def attributes(raw: Column) -> Column:
    """`k=v` pairs as a map; the last of a repeated key wins."""
    pairs = F.regexp_extract_all(raw, F.lit(rf"(\w+)=([^{WHITE_CLASS}]+)"), 0)
    entries = F.transform(pairs, lambda p: F.struct(F.substring_index(p, "=", 1).alias("key"), F.regexp_replace(p, r"^\w+=", "").alias("value")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.greatest(F.size(entries), F.lit(1))), lambda o: o.key == e.key))
    return F.map_from_entries(last)


def _tags_of(text: Column, pattern: str, kind: str, slash: str = "") -> Column:
    full = F.regexp_extract_all(text, F.lit(pattern), 0)

    def tag(z: Column) -> Column:
        raw = F.lit("") if slash else F.regexp_extract(z["full"], pattern, 2)
        return F.struct(
            z["position"].alias("position"),
            F.lit(kind).alias("type"),
            F.concat(F.lit(slash), F.regexp_extract(z["full"], pattern, 1)).alias("name"),
            attributes(raw).alias("attributes"),
            z["full"].alias("full_tag"),
        )

    return F.transform(F.arrays_zip(_places(text, full).alias("position"), full.alias("full")), tag)


def extract_tags(text: Column) -> Column:
    """Tags as structs (position, type, name, attributes, full_tag), in order of position."""
    parts = [_tags_of(text, p, k) for k, p in OPENING.items()] + [_tags_of(text, CLOSING, "System", "/")]
    return F.array_sort(F.flatten(F.array(*parts)), lambda a, b: a.position - b.position)


def clean_text(text: Column) -> Column:
    """Without tags; runs of blanks as one, no blanks around breaks, trimmed."""
    for pattern in (*OPENING.values(), CLOSING):
        text = F.regexp_replace(text, pattern, "")
    text = F.regexp_replace(text, r"[ \xA0]+", " ")
    text = F.regexp_replace(F.regexp_replace(text, r"[ \t]+\n", "\n"), r"\n[ \t]+", "\n")
    return trim(text)


def count_of(text: Column, part: Column) -> Column:
    """How often a text stands in another, without overlaps."""
    return ((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).cast("int")


def same_tags(a: Column, b: Column) -> Column:
    """Whether two texts hold the same tags, each as often."""
    return F.array_sort(tag_texts(a)) == F.array_sort(tag_texts(b))


def restore(original: Column, translated: Column) -> Column:
    """The translation with the original's number of lines and its tags.

    Missing tags are appended in the order in which they first stand in the original; tags that it does not hold go.
    """
    given = F.struct(normalize_breaks(translated).alias("text"), count_lines(original).alias("lines"), F.array_distinct(tag_texts(original)).alias("own"))

    def with_lines(x: Column) -> Column:
        uneven = (x.lines > 1) & (F.size(F.split(x.text, "\n")) != x.lines)
        return let(F.when(uneven, balanced_lines(x.text, x.lines)).otherwise(x.text), lambda text: let(_filled(original, text, x.own), lambda t: _without_others(t, x.own)))

    return let(given, with_lines)


def _filled(original: Column, text: Column, own: Column) -> Column:
    ordered = F.array_sort(own, lambda a, b: F.instr(original, a) - F.instr(original, b))
    return F.aggregate(ordered, text, lambda acc, t: F.concat(acc, F.repeat(t, F.greatest(count_of(original, t) - count_of(acc, t), F.lit(0)))))


def _without_others(text: Column, own: Column) -> Column:
    held = F.regexp_extract_all(text, F.lit(ANY_TAG), 0)
    kept = F.transform(held, lambda t: F.when(F.array_contains(own, t), t).otherwise(""))
    return F.array_join(F.zip_with(F.split(text, ANY_TAG), kept, lambda x, t: F.concat(x, F.coalesce(t, F.lit("")))), "")
