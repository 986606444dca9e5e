"""String semantics of the formats that we follow: wide white space, trimming, UTF-16 lengths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space that trimming and splitting know, plain and by code point.
WHITE = "\t\n\x0b\f\r " + "".join(map(chr, (0x00A0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)))
#: The same for a character class of a regular expression, as ranges: each member is asked for each character.
WHITE_CLASS = r"\t-\r \xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
#: The class and its opposite; both tell printable ASCII first, by one comparison.
WS = f"[[^!-~]&&[{WHITE_CLASS}]]"
NOT_WS = f"[!-~[^{WHITE_CLASS}]]"


def trim(text: Column) -> Column:
    """Without white space at both ends (the plain SQL trim knows only blanks)."""
    return F.trim(text, F.lit(WHITE))


def ltrim(text: Column) -> Column:
    return F.ltrim(text, F.lit(WHITE))


def is_blank(text: Column) -> Column:
    return ~text.rlike(NOT_WS)


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units: characters beyond the basic plane count twice."""
    return F.length(text) + F.regexp_count(text, F.lit(r"[\x{10000}-\x{10FFFF}]"))


def words(text: Column) -> Column:
    """Pieces between runs of white space; a leading or trailing run leaves an empty piece, as splitting does."""
    return F.split(text, WS + "+")


def word_count(text: Column) -> Column:
    """Pieces that are not empty; counted without making them."""
    return F.regexp_count(text, F.lit(NOT_WS + "++"))


def unix_lines(text: Column, lone_cr: bool = False) -> Column:
    """CRLF (and with `lone_cr` also CR) as LF."""
    text = F.replace(text, F.lit("\r\n"), F.lit("\n"))
    return F.replace(text, F.lit("\r"), F.lit("\n")) if lone_cr else text


def let(value: Column, body) -> Column:
    """Bind a value once for a body that names it often; within lambdas equal expressions are not shared otherwise."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
