"""Personal data (bootstrapped contextual extraction).

Base patterns find e-mail addresses, IP addresses, card and phone numbers; these are the seeds. The words around each seed, and
around each string that is only shaped like such data, are lexical patterns. Spark builds the graph of patterns and instances
over the whole corpus and scores it in rounds: a pattern is as good as the instances that it is seen with, an instance that is
no seed as good as its high-confidence patterns together. What such a pattern finds supports further patterns in the next round,
as seeds do; what no such pattern finds supports none, so that doubtful instances never add up. Strings in the context of a
high-confidence pattern are then reported as well. Confidence is a lower bound, so that a pattern that a seed and another string
take in turn, as chance has it, is never good.

Patterns are words near a span in three forms: the word before it, that with the word after it, and the two words before it. Case,
digits and marks around a word do not matter.

Base spans always stay. Spans are in code points, end exclusive. A context reaches 100 characters to the left and 50 to the right.

Defined cases: null and empty texts hold nothing; repeated rows are reported once each and count as one instance in the graph;
an empty table gives no rows; without seeds no pattern is learnt; extra columns are kept by `mask` and ignored by `find_spans`.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, prepare, string_columns

KINDS = ("email", "ip", "card", "phone")


@dataclass(frozen=True)
class BootstrapOptions:
    rounds: int = 3
    least_seeds: int = 3  # distinct seeds, or instances that a good pattern of the round before finds, that a pattern must be seen with
    confidence: float = 0.54  # of the share of a pattern's instances that are seeds or believed: the lower bound of its interval
    confidence_of_one_word: float = 0.8  # a single word before a span says little
    deviations: float = 1.64  # that the interval is wide on either side
    patterns_per_block: int = 100_000  # so many are sent to the tasks at once, in as many passes as there are blocks


# The base patterns. They find what the plain forms find (leftmost, greedy, without overlaps in a kind); a digit
# run is entered at its start only, which changes no match and keeps long runs linear.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
# Shapes that may be such data where the context says so.
_AT = re.compile(r" ?(?:\(at\)|\[at\]|\{at\}|@) ?| at (?=[\w-]{1,63} dot )", re.I)
_SPELT_DOT = re.compile(" dot ", re.I)
_BEFORE_AT = re.compile(r"[\w.+-]{1,64}\Z")
_AFTER_AT = re.compile(r"[\w-]{1,63}(?:(?:\.| ?\(dot\) ?| ?\[dot\] ?| ?\{dot\} ?| dot )[\w-]{1,63}){0,8}", re.I)
_SHAPES = {
    "ip": re.compile(r"(?<![\w.:])(?:[0-9]{1,3}(?:(?:\[\.\]|[.:_-])[0-9]{1,3}){3}|(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4})(?![\w:])"),
    "card": re.compile(r"(?<![0-9])[0-9](?:[ ./-]?[0-9]){11,18}(?![0-9])"),
    "phone": re.compile(r"(?<![\w+])\(?[0-9]{2,4}\)?(?:[ ./-]{1,2}[0-9]{2,5}){1,4}(?![0-9])"),
}
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        total += x if i % 2 == 0 else x * 2 - 9 * (x > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    emails: list[tuple[int, int]] = []
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            emails.append((start, end))
        at = text.find("@", at + 1)
    ips = [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    cards = [m.span() for m in _CARD.finditer(text) if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    phones = [m.span() for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15] if "+" in text else []
    return {"email": emails, "ip": ips, "card": cards, "phone": phones}


class _Taken:
    """Spans that do not overlap, kept in order, so that a clash is found by bisection."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b in sorted(spans):  # base spans of two kinds may overlap: they count as one
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(b, self.ends[-1])
            else:
                self.starts.append(a)
                self.ends.append(b)

    def clashes(self, start: int, end: int) -> bool:
        i = bisect_right(self.ends, start)
        return i < len(self.starts) and self.starts[i] < end


def shaped_spans(text: str, base: dict[str, list[tuple[int, int]]]) -> list[tuple[str, int, int]]:
    """Strings that are shaped like personal data and overlap no base span."""
    out = []
    if "@" in text or "(" in text or "[" in text or "{" in text or _SPELT_DOT.search(text):
        upto = 0
        for m in _AT.finditer(text):
            left, right = _BEFORE_AT.search(text[max(0, m.start() - 64) : m.start()]), _AFTER_AT.match(text, m.end())
            if left and right and m.start() - (left.end() - left.start()) >= upto:
                upto = right.end()
                out.append(("email", m.start() - (left.end() - left.start()), upto))
    if _DIGIT.search(text):
        for kind, shape in _SHAPES.items():
            for m in shape.finditer(text):
                if kind != "phone" or 7 <= len(_digits(m[0])) <= 15:
                    out.append((kind, *m.span()))
    taken = _Taken([s for spans in base.values() for s in spans])
    return [x for x in out if not taken.clashes(*x[1:])]


_EDGE_MARKS = re.compile(r"^\W+|\W+$")
_NUMBER = re.compile("[0-9]+")


def _plain(word: str) -> str:
    """A word of a context, without case, digits and the marks around it; marks alone stay."""
    return _NUMBER.sub("0", _EDGE_MARKS.sub("", word) or word)


def contexts(text: str, start: int, end: int) -> list[str]:
    """Lexical patterns of a span: the word before it, that with the word after, and the two words before it."""
    before = [_plain(w) for w in text[max(0, start - 100) : start].lower().split()[-2:]]
    after = text[end : end + 50].lower().split()[:1]
    if not before or not any(c.isalpha() for w in before for c in w):
        return []
    found = [f"{before[-1]} _ {_plain(after[0]) if after else ''}", f"{before[-1]}{ONE_WORD}"]
    if len(before) == 2:
        found.append(f"{before[0]} {before[1]} _")
    return found


ONE_WORD = " _ *"


def _instance(text: str) -> str:
    """The letters and digits of a string; a digest of them where they are many."""
    plain = "".join(c for c in text.lower() if c.isalnum())
    return plain if len(plain) <= 64 else hashlib.sha256(plain.encode("utf-8", "replace")).hexdigest()


def context_graph(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Edges (kind, pattern, instance, seed, shaped), each once, over all texts; shaped: seen as no base span."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(0).to_pylist():
                if not text:
                    continue
                base = base_spans(text)
                spans = [(k, a, b, True) for k in KINDS for a, b in base[k]] + [(*x, False) for x in shaped_spans(text, base)]
                rows += [(k, p, _instance(text[a:b]), seed) for k, a, b, seed in spans for p in contexts(text, a, b)]
            if rows:
                rows = list(dict.fromkeys(rows))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["kind", "pattern", "instance", "seed"])

    edges = docs.select("text").mapInArrow(read, "kind string, pattern string, instance string, seed boolean")
    return scratch.write(edges.groupBy("kind", "pattern", "instance").agg(F.max("seed").alias("seed"), (~F.min("seed")).alias("shaped")), "graph")


def _least_share(hits: F.Column, n: F.Column, z: float) -> F.Column:
    """Lower bound of the score interval of a share: few instances prove little, and those of chance contexts nothing."""
    p, zz = hits / n, z * z
    return (p + zz / (2 * n) - z * F.sqrt(F.greatest(p * (1 - p), F.lit(0.0)) / n + zz / (4 * n * n))) / (1 + zz / n)


def score_patterns(edges: DataFrame, scratch: Scratch, options: BootstrapOptions = BootstrapOptions()) -> DataFrame:
    """(kind, pattern, seeds, shaped, confidence, good) after the last round; seeds: with instances that a good pattern has found."""
    o = options
    instances = edges.groupBy("kind", "instance").agg(F.max("seed").cast("double").alias("s"), F.max("seed").alias("believed"))
    patterns = None
    good = F.col("confidence") >= F.when(F.endswith("pattern", F.lit(ONE_WORD)), o.confidence_of_one_word).otherwise(o.confidence)
    for step in range(o.rounds):
        near = edges.join(instances, ["kind", "instance"])
        patterns = near.groupBy("kind", "pattern").agg(F.count_if("believed").alias("seeds"), F.max("shaped").alias("shaped"), F.sum("s").alias("s"), F.count("*").alias("n"))
        score = F.when(F.col("seeds") >= o.least_seeds, _least_share(F.col("s"), F.col("n"), o.deviations)).otherwise(0.0)
        patterns = scratch.write(patterns.select("kind", "pattern", "seeds", "shaped", score.alias("confidence")).withColumn("good", good), "patterns")
        if step + 1 < o.rounds:
            # Noisy or: an instance that is no seed is believed as far as its good patterns are, together.
            told = edges.join(patterns.where("good").select("kind", "pattern", "confidence"), ["kind", "pattern"], "left").groupBy("kind", "instance")
            against = F.exp(F.sum(F.log(1 - F.least(F.coalesce("confidence", F.lit(0.0)), F.lit(0.999)))))
            told = told.agg(F.max("seed").alias("seed"), F.count("confidence").alias("k"), against.alias("against"))
            instances = told.select("kind", "instance", F.when(F.col("seed"), 1.0).when(F.col("k") > 0, 1 - F.col("against")).otherwise(0.0).alias("s"), (F.col("seed") | (F.col("k") > 0)).alias("believed"))
            instances = scratch.write(instances, "instances")
    return patterns


def learn_patterns(docs: DataFrame, scratch: Scratch, options: BootstrapOptions = BootstrapOptions()) -> DataFrame:
    """(kind, pattern) of all high-confidence patterns that stand around a string that is no base span."""
    return score_patterns(context_graph(docs, scratch), scratch, options).where("good AND shaped").select("kind", "pattern")


def _pattern_blocks(patterns: DataFrame, o: BootstrapOptions) -> Iterator[dict[str, frozenset[str]]]:
    """The patterns in blocks of bounded number, one at least; only one block is on the driver at a time."""
    block: list[tuple[str, str]] = []
    for r in patterns.toLocalIterator():
        if len(block) >= o.patterns_per_block:
            yield {k: frozenset(p for kind, p in block if kind == k) for k in KINDS}
            block = []
        block.append((r.kind, r.pattern))
    yield {k: frozenset(p for kind, p in block if kind == k) for k in KINDS}


def _with_last_block(rows: DataFrame, at: int, o: BootstrapOptions) -> tuple[DataFrame, dict[str, frozenset[str]]]:
    """`rows` with a last column, the numbers of the shaped spans that all blocks of patterns but one find; and that one."""
    spark = rows.sparkSession
    learning = Scratch(spark)
    blocks = _pattern_blocks(learn_patterns(rows.select(F.col(f"`{rows.columns[at]}`").alias("text")), learning, o), o)
    last = next(blocks)
    rows = rows.withColumn("_" + "".join(rows.columns), F.lit(None).cast("array<int>"))  # a name that no column has
    before = None
    for block in blocks:
        patterns = spark.sparkContext.broadcast(last)

        def note(batches: Iterator[pa.RecordBatch], patterns=patterns) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts, known = batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
                known = [sorted({*(k or ()), *_believed(t, shaped_spans(t, base_spans(t)), patterns.value)}) if t else None for t, k in zip(texts, known, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(known, pa.list_(pa.int32()))], names=batch.schema.names)

        scratch = Scratch(spark)
        rows = scratch.write(rows.mapInArrow(note, rows.schema), "known")
        if before is not None:
            before.clear()
        last, before = block, scratch
    learning.clear()
    return rows, last


def _believed(text: str, shaped: list[tuple[str, int, int]], patterns: dict[str, frozenset[str]]) -> list[int]:
    return [i for i, (kind, a, b) in enumerate(shaped) if patterns[kind] and any(p in patterns[kind] for p in contexts(text, a, b))]


def all_spans(text: str, patterns: dict[str, frozenset[str]], known: list[int] | None = None) -> tuple[dict[str, list[tuple[int, int]]], list[tuple[str, int, int]]]:
    """Base spans, and all spans by kind and start with those that a pattern finds or that are known (by number) already."""
    base = base_spans(text)
    added: list[tuple[str, int, int]] = []
    if known or any(patterns.values()):
        shaped = shaped_spans(text, base)
        found = [shaped[i] for i in sorted({*(known or ()), *_believed(text, shaped, patterns)})]
        # Shapes of two kinds may overlap: the first kind in the order of KINDS has the place, within a kind none overlap.
        for kind in KINDS:
            taken = _Taken([(a, b) for _, a, b in added])
            added += [(k, a, b) for k, a, b in found if k == kind and not taken.clashes(a, b)]
    whole = [(k, a, b) for k in KINDS for a, b in sorted([*base[k], *((a, b) for kind, a, b in added if kind == k)])]
    return base, whole


def _joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_spans(docs: DataFrame, options: BootstrapOptions = BootstrapOptions()) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base, spans) of every row of (doc_id, text)."""
    spark = prepare(docs.sparkSession)
    rows, last = _with_last_block(string_columns(docs, "doc_id", "text"), 1, options)
    patterns = spark.sparkContext.broadcast(last)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[list[int]] = [[], [], [], []]
            plain, whole = [], []
            for text, known in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                base, spans = all_spans(text or "", patterns.value, known)
                for c, k in zip(counts, KINDS, strict=True):
                    c.append(len(base[k]))
                plain.append(_joined((k, a, b) for k in KINDS for a, b in base[k]))
                whole.append(_joined(spans))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(plain, pa.string()), pa.array(whole, pa.string())], names=["doc_id", *(f"n_{k}" for k in KINDS), "base", "spans"])

    return rows.mapInArrow(find, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, spans string")


def mask(docs: DataFrame, options: BootstrapOptions = BootstrapOptions()) -> DataFrame:
    """`docs`, all columns, with every span in `text` replaced by its kind in brackets."""
    spark = prepare(docs.sparkSession)
    at, names = docs.columns.index("text"), docs.columns
    rows, last = _with_last_block(docs, at, options)
    patterns = spark.sparkContext.broadcast(last)

    def hide(text: str | None, known: list[int] | None) -> str | None:
        if not text:
            return text
        out, upto = [], 0
        for kind, a, b in sorted(all_spans(text, patterns.value, known)[1], key=lambda x: (x[1], x[2])):
            if b > upto:
                # Of overlapping spans the first names the hole; the later one only widens it.
                out += [text[upto:a], f"[{kind.upper()}]"] if a >= upto else []
                upto = b
        return "".join([*out, text[upto:]])

    def change(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns[:-1])
            columns[at] = pa.array([hide(*x) for x in zip(columns[at].to_pylist(), batch.columns[-1].to_pylist(), strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(change, docs.schema)
