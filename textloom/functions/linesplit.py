"""How well a translation's lines follow the original's: a score of badness, and a better split.

Column expressions; positions are code points.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..jsstr import NOT_WS, WHITE, is_blank, let, ltrim, trim, word_count
from ..session import small_batches
from .text import one_line

# Marks and tags that count as no text, words that no line may start with, marks that end a sentence.
NO_TEXT = r"[\x{FFF9}-\x{FFFC}\x{E000}-\x{E0FF}]|\[(?:XENO|System|ML):[^\]]+\]|\[/[A-Za-z_:]+\]"
NO_START = (
    "و", "ف", "ل", "ب", "ك",
    "في", "من", "إلى", "الى", "على", "عن", "مع", "حتى", "لكن", "لكنّ", "أو", "أم",
    "ثم", "ثمّ", "إذ", "إذا", "كي", "بل", "لا", "ما", "لم", "لن", "قد",
    "هذا", "هذه", "هؤلاء", "ذلك", "تلك",
    "إنّ", "إنّما", "إن", "ربّما", "ربما", "لعلّ", "لعل", "كأنّ", "كأن", "سوف",
)
SENTENCE_END = "[.!?؟…]"
OPENING_MARKS = "^[«»\"'(]+"
_OPENING, _QUOTES, _PAUSES = "«»\"'(", ("«", '"', "("), ("؛", ";")
_END, _FORBIDDEN = re.compile(SENTENCE_END), frozenset(NO_START)
CAUSES = ("line-count-mismatch", "very-short-line", "very-unbalanced", "broken-phrase", "drift-from-original-positions")

#: Where the score of badness is high enough to be shown, and where a line counts as easy to mend.
SHOWN, SHOWN_WITHOUT_PROPOSAL, EASY = 25, 50, 22
FEW_LINES = 1000


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, NO_TEXT, "")


def lines_of(text: Column) -> Column:
    """Lines that are not blank."""
    return F.filter(F.split(text, r"\r?\n"), lambda x: ~is_blank(x))


def _chars(line: Column) -> Column:
    return F.length(trim(strip_tags(line)))


def _may_not_start(text: Column) -> Column:
    first = F.regexp_replace(F.regexp_extract(ltrim(text), rf"^{NOT_WS}++", 0), OPENING_MARKS, "")
    return first.isin(*NO_START)


def break_ratios(text: Column) -> Column:
    """Where the breaks stand, as parts of the length without tags; one pass over the lines, over the characters where lines are very many."""
    every = lambda plain: F.array_compact(F.transform(F.split(plain, ""), lambda c, i: F.when(c == "\n", i)))
    start = F.struct(F.array().cast("array<int>").alias("found"), F.lit(-1).alias("at"))

    def summed(lines: Column) -> Column:
        def step(acc: Column, line: Column) -> Column:
            return let(acc.at + 1 + F.length(line), lambda at: F.struct(F.array_append(acc.found, at).alias("found"), at.alias("at")))

        # The last line ends with the text, not with a break.
        return F.aggregate(lines, start, step, lambda acc: F.slice(acc.found, 1, F.size(lines) - 1))

    def breaks(plain: Column) -> Column:
        # An array grows by a copy: of few lines that costs less than each character on its own.
        return let(F.split(plain, "\n"), lambda lines: F.when(F.size(lines) <= FEW_LINES, summed(lines)).otherwise(every(plain)))

    return let(strip_tags(text), lambda plain: F.transform(breaks(plain), lambda at: at / F.length(plain)))


def _count(over: Column, condition) -> Column:
    return F.size(F.filter(over, condition))


def _facts(line: Column) -> Column:
    """What the rules look at in a line, taken once; tags are stripped once."""
    whole = trim(line)

    def of(plain: Column) -> Column:
        clean = F.coalesce(F.right(plain, F.lit(1)).rlike(SENTENCE_END), F.lit(False))
        return F.struct(word_count(plain).alias("words"), F.length(plain).alias("chars"), _may_not_start(whole).alias("bad_start"), clean.alias("clean_end"))

    return let(trim(strip_tags(whole)), of)


def diagnose(original: Column, translation: Column) -> Column:
    """struct(score, causes, orig_line_count, tr_line_count); a higher score is worse, 100 at most."""
    facts = F.struct(
        F.transform(lines_of(original), _facts).alias("o"),
        F.transform(lines_of(translation), _facts).alias("t"),
        break_ratios(original).alias("ro"),
        break_ratios(translation).alias("rt"),
    )
    return let(facts, _diagnosis)


def _diagnosis(x: Column) -> Column:
    o, t = x.o, x.t
    no, nt = F.size(o), F.size(t)
    many = nt > 1
    mismatch = F.when((no > 1) & (nt != no), F.least(F.lit(50), 22 + 14 * F.abs(nt - no))).otherwise(0)

    def short(line: Column, i: Column) -> Column:
        other = F.coalesce(F.get(o, i).words, F.lit(0))
        return ((line.words > 0) & (line.words <= 2) & (other >= 4)) | ((line.words == 1) & (nt > 2))

    total = F.aggregate(o, F.lit(0), lambda acc, line: acc + line.chars)
    mean = F.when(total == 0, 1.0).otherwise(total / F.greatest(no, F.lit(1)))

    def broken(line: Column, i: Column) -> Column:
        before = F.get(t, i - 1)
        return (i > 0) & ~before.clean_end & (line.bad_start | ((before.words >= 6) & (line.words <= 3)))

    n_short = F.when(many, _count(t, short)).otherwise(0)
    uneven = let(mean, lambda m: _count(t, lambda line: (line.chars / m < 0.35) | (line.chars / m > 2.2)))
    n_uneven = F.when(many & (no > 0), uneven).otherwise(0)
    n_broken = F.when(many, _count(t, broken)).otherwise(0)
    apart = F.zip_with(x.ro, x.rt, lambda a, b: F.abs(a - b))
    n_drift = F.when((no > 1) & (nt == no) & (F.size(x.ro) == F.size(x.rt)), _count(apart, lambda d: d > 0.18)).otherwise(0)
    parts = F.array(mismatch, F.least(F.lit(30), 14 * n_short), F.least(F.lit(25), 10 * n_uneven), F.least(F.lit(35), 18 * n_broken), F.least(F.lit(20), 10 * n_drift))

    def verdict(p: Column) -> Column:
        causes = F.array_compact(F.array(*[F.when(F.get(p, F.lit(i)) > 0, F.lit(c)) for i, c in enumerate(CAUSES)]))
        score = F.least(F.lit(100), F.aggregate(p, F.lit(0), lambda acc, v: acc + v.cast("int")))
        return F.struct(score.alias("score"), causes.alias("causes"), no.alias("orig_line_count"), nt.alias("tr_line_count"))

    return let(parts, verdict)


# --- a better split ------------------------------------------------------------------------------------------------------


class _Free:
    """Ordered places of equal worth; finds the nearest one that is not taken. Taken places are skipped by links that grow short."""

    def __init__(self) -> None:
        self.at: list[int] = []
        self._after: list[int] = [0]
        self._before: list[int] = [0]

    def add(self, at: int) -> None:
        self.at.append(at)
        self._after.append(len(self.at))
        self._before.append(len(self.at))

    @staticmethod
    def _end(links: list[int], i: int) -> int:
        while links[i] != i:
            links[i] = links[links[i]]
            i = links[i]
        return i

    def nearest(self, spot: int) -> tuple[int, int] | None:
        """(distance, number) of the nearest free place, the left one of two."""
        i = bisect_left(self.at, spot)
        right, left = self._end(self._after, i), self._end(self._before, i) - 1
        found = [(abs(self.at[k] - spot), k) for k in (left, right) if 0 <= k < len(self.at)]
        return min(found) if found else None

    def take(self, k: int) -> None:
        self._after[k], self._before[k + 1] = k + 1, k


def _break_worth(word: str, after: str) -> int:
    """How good a break between two words is."""
    worth = 1 + 2 * (len(word) >= 4) + (len(after) >= 4) + 2 * (after[:1] in _QUOTES)
    return worth + (10 if _END.match(word[-1:]) else 3 * (word[-1:] in _PAUSES))


def _break_places(lens: list[int], joined: str) -> list[int]:
    """For each break of the original, in order, the free blank of the least cost near where it would fall.

    Blanks of equal worth differ in cost by their distance alone, so only the nearest free one of each worth is looked at: a few
    of them for each break, whatever the text's length.
    """
    length, words = len(joined), joined.split(" ")
    by_worth: dict[int, _Free] = {}
    at = -1
    for word, after in zip(words, words[1:], strict=False):
        at += 1 + len(word)
        first = after.strip(WHITE)
        first = re.split(f"[{WHITE}]", first, maxsplit=1)[0].lstrip(_OPENING) if first else ""
        if first not in _FORBIDDEN and 1 <= at < length - 1:
            by_worth.setdefault(_break_worth(word, after), _Free()).add(at)
    reach, total = max(20, math.floor(length * 0.25 + 0.5)), max(sum(lens), 1)
    taken, upto = [], 0
    for size in lens[:-1]:
        upto += size
        spot = math.floor(upto / total * length + 0.5)
        near = [(found[0] - 4 * worth, free.at[found[1]], worth, found[1]) for worth, free in by_worth.items() if (found := free.nearest(spot)) and found[0] <= reach]
        if near:
            _, place, worth, k = min(near)
            by_worth[worth].take(k)
            taken.append(place)
    return sorted(taken)


@F.pandas_udf(StringType())
def _broken_lines(lens: pd.Series, joined: pd.Series, translation: pd.Series) -> pd.Series:
    made = []
    for sizes, text, given in zip(lens, joined, translation, strict=True):
        places = _break_places([int(n) for n in sizes], text) if text is not None else []
        cuts = [0, *(p + 1 for p in places)]
        made.append("\n".join(text[a:b] for a, b in zip(cuts, [*places, None], strict=True)).strip(WHITE) if places else given)
    return pd.Series(made, dtype=object)


def propose(original: Column, translation: Column) -> Column:
    """The translation split where the original's breaks would fall, at the best blank near each; unchanged if there is none.

    Breaks take blanks one after another and none twice, which no built-in expression says in less than the square of the lines;
    a text's breaks are placed in an Arrow batch, everything else stays in the JVM.
    """
    small_batches()
    lens, joined = F.transform(lines_of(original), _chars), one_line(translation)
    plain = is_blank(translation) | (F.size(lens) <= 1)
    broken = _broken_lines(lens, F.when(~plain, joined), translation)
    return F.when(is_blank(translation), translation).when(F.size(lens) <= 1, joined).otherwise(broken)
