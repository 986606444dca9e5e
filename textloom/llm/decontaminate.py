"""Benchmark decontamination (SimHash of item-sized windows, multi-index Hamming blocks, exact verification).

An item of n words is given the window size of its class: the largest of 1, 2, 3, 4, 6, 8, 12, 16, 24, ... 192 not above n, and
the largest not above n - 4 at its start, middle and end. As an item may differ in several places, its ends among them, and
still be similar enough, it also has as many separate smaller windows as leave one of them untouched; an item of more than 192
words has several windows of that size. The SimHash of every window of every size in use is formed in each document and cut into
radius + 1 blocks: any two fingerprints within the radius agree on one block at least. A table for each block leads from a value
to the fingerprints that have it, so that none within the radius is missed and no other table entry is looked at.

A window within the radius says where the item may stand. Among the runs of words there, the one that is most similar is found:
the weighted Jaccard similarity of the five-word shingles (weight: how often each occurs) is taken exactly for every run.

Items come to the tasks in blocks of bounded size, one pass over the documents for each block; a benchmark of any size works.

Defined cases: null and empty texts hold nothing; null or empty items take no part; an item of fewer than five words has its
whole sequence as its one shingle, as a document has, and is found where it is a document's whole text; an item that stands in a
text several times is reported once, at its best place (the first of equal ones); items with equal texts are each reported; a
repeated document row is reported once for each row; extra columns are kept by `remove_contaminated` and ignored by
`find_contamination`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, prepare, string_columns, text_bytes, window_hashes, word_hashes

SHINGLE = 5


@dataclass(frozen=True)
class LeakOptions:
    similarity: float = 0.8
    radius: int = 3
    items_per_block: int = 20_000
    bytes_per_block: int = 8_000_000


def window_sizes(limit: int) -> list[int]:
    """1, 2, 3, 4, 6, 8, 12, ... : sums of two runs of halves; at most 192, so that a bit's count fits a byte."""
    sizes = {1, 2, 3}
    k = 4
    while k <= 192:
        sizes |= {k, k + k // 2}
        k *= 2
    return sorted(s for s in sizes if s <= min(192, limit))


class _Fingerprints:
    """SimHash of all windows of one size over a run of words, for several sizes; sums are shared between sizes."""

    def __init__(self, words: np.ndarray):
        bits = np.unpackbits(words.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1)
        self.sums = {1: bits}

    def _sum(self, size: int) -> np.ndarray:
        if size not in self.sums:
            large = 1 << (size.bit_length() - 1)
            a, b = (size // 2, size // 2) if large == size else (large, size - large)
            left, right = self._sum(a), self._sum(b)
            n = len(left) + a - size
            self.sums[size] = left[: max(0, n)] + right[a : a + max(0, n)]
        return self.sums[size]

    def of(self, size: int) -> np.ndarray:
        counts = self._sum(size)
        return np.packbits(counts > size // 2, axis=1).view("<u8").ravel()


def item_windows(n: int) -> list[tuple[int, int]]:
    """(size, first word) of the windows of an item of n words.

    Beside its first, middle and last window an item has separate ones, of which a copy of similarity 0.8 leaves one as it was.
    Of m shingles such a copy may lack t cut off with its ends and d others, for which d new ones stand: t + 1.8 d <= 0.2 m. A
    window that is no longer whole lacks four shingles at least, none of them those of another window, if `margin` words lie
    before the first and behind the last and two between any: so the two outer ones cost 4 each, all others 7.2.
    """
    whole = window_sizes(n)[-1]
    found = {(whole, 0), (whole, n - whole)}
    if n < 2 * SHINGLE - 1:  # four shingles at most: only an exact copy is similar enough
        return sorted(found)
    size = window_sizes(n - SHINGLE + 1)[-1]
    found |= {(size, 0), (size, (n - size) // 2), (size, n - size)}
    m = max(1, n - SHINGLE + 1)
    parts = 1 if m < 20 else 2 if m < 40 else 3 + (m - 40) // 36
    margin = min(3, m // 5)
    small = window_sizes((n - 2 * margin - 2 * (parts - 1)) // parts)[-1]
    rest = n - 2 * margin - small
    found |= {(small, margin + (j * rest // (parts - 1) if parts > 1 else rest // 2)) for j in range(parts)}
    return sorted(found)


def _blocks(prints: np.ndarray, radius: int) -> Iterator[np.ndarray]:
    edges = np.linspace(0, 64, radius + 2).astype(int)
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield ((prints >> np.uint64(a)) & np.uint64((1 << (b - a)) - 1)).astype(np.int64)


class _Index:
    """Fingerprints of one window size: for each Hamming block a table from value to the fingerprints that have it."""

    def __init__(self, rows: list[tuple[int, int, int]], radius: int):
        self.prints = np.array([p for p, _, _ in rows], np.uint64)
        self.numbers = np.array([n for _, n, _ in rows])  # of the items
        self.places = np.array([a for _, _, a in rows])  # in the items
        self.radius = radius
        self.tables = []
        for values in _blocks(self.prints, radius):
            order = np.argsort(values, kind="stable")
            known, first = np.unique(values[order], return_index=True)
            occurs = np.zeros(1 << -(-64 // (radius + 1)), bool)
            occurs[known] = True
            self.tables.append((occurs, known, np.append(first, len(order)), order))

    def near(self, found: np.ndarray, step: int = 1 << 14) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(number in `found`, fingerprint, distance) of all pairs within the radius; a pair may be met once for each block."""
        for values, (occurs, known, first, order) in zip(_blocks(found, self.radius), self.tables, strict=True):
            hit = np.flatnonzero(occurs[values])
            for k in range(0, len(hit), step):
                part = hit[k : k + step]
                row = np.searchsorted(known, values[part])
                counts = first[row + 1] - first[row]
                ends = np.cumsum(counts)
                at = np.arange(ends[-1]) - np.repeat(ends - counts, counts) + np.repeat(first[row], counts)
                spot, own = np.repeat(part, counts), order[at]
                distance = np.bitwise_count(found[spot] ^ self.prints[own])
                close = distance <= self.radius
                yield spot[close], own[close], distance[close]


@dataclass
class _Items:
    """A bounded block of items, ready to search with."""

    ids: list[int]
    words: list[np.ndarray]
    classes: dict[int, _Index]  # by window size
    short: dict[int, list[int]]  # items of fewer than five words by the hash of their sequence


def prepare_items(rows: list[tuple[int, str]], o: LeakOptions) -> _Items:
    words, first, _, _ = word_hashes(*text_bytes(pa.array([t for _, t in rows], pa.string())))
    kept = [(i, words[a:b]) for (i, _), a, b in zip(rows, first[:-1], first[1:], strict=True) if b > a]
    classes: dict[int, list] = {}
    short: dict[int, list[int]] = {}
    for number, (_, w) in enumerate(kept):
        if len(w) < SHINGLE:
            short.setdefault(int(window_hashes(w, len(w))[0]), []).append(number)
            continue
        prints = _Fingerprints(w)
        for size, place in item_windows(len(w)):
            classes.setdefault(size, []).append((prints.of(size)[place], number, place))
    return _Items([i for i, _ in kept], [w for _, w in kept], {s: _Index(v, o.radius) for s, v in sorted(classes.items())}, short)


def best_run(item: np.ndarray, words: np.ndarray, least: float) -> tuple[float, int, int] | None:
    """(similarity, first word, number of words) of the run of `words` that is most similar to the item, if it reaches `least`.

    Of equal ones the first, then the shortest. A best run begins and ends with a shingle of the item.
    """
    mine, own = np.unique(window_hashes(item, SHINGLE), return_counts=True)
    there = window_hashes(words, SHINGLE)
    m = int(own.sum())
    spot = np.minimum(np.searchsorted(mine, there), len(mine) - 1)
    matched = mine[spot] == there
    at = np.flatnonzero(matched)
    kind = spot[at]
    if np.minimum(np.bincount(kind, minlength=len(mine)), own).sum() < least * m:
        return None
    # How often a run from a start has met each shingle so far: its occurrences up to there, less those before the start.
    order = np.argsort(kind, kind="stable")
    times = np.empty(len(at), np.int64)
    sizes = np.bincount(kind, minlength=len(mine))
    times[order] = np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1
    before = np.zeros(len(mine), np.int64)
    best: tuple[float, int, int] | None = None
    for k, start in enumerate(at.tolist()):
        if len(at) - k < least * m:
            break  # too few are left for any later start
        both = np.cumsum(times[k:] - before[kind[k:]] <= own[kind[k:]])
        alike = both / (m + at[k:] - start + 1 - both)
        end = int(alike.argmax())
        if alike[end] >= least and (best is None or alike[end] > best[0]):
            best = float(alike[end]), start, int(at[k + end]) - start + SHINGLE
        before[kind[k]] += 1
    return best


def search(column: pa.Array, items: _Items, o: LeakOptions) -> list[tuple[int, int, int, int, float, int]]:
    """(row, item number, first word, words, similarity, Hamming distance) of the best place of each item in each row."""
    words, first, _, _ = word_hashes(*text_bytes(column))
    best: dict[tuple[int, int], tuple] = {}
    if items.short:
        for row in np.flatnonzero((np.diff(first) > 0) & (np.diff(first) < SHINGLE)).tolist():
            own = words[first[row] : first[row + 1]]
            for number in items.short.get(int(window_hashes(own, len(own))[0]), ()):
                if len(items.words[number]) == len(own):
                    best[row, number] = (0, len(own), 1.0, 0)
    span = 1 << 14  # words at a time; windows that reach beyond are seen with the next span
    reach = max(items.classes, default=1) - 1
    seen: set[tuple[int, int]] = set()
    for at in range(0, len(words) if items.classes else 0, span):
        prints_of = _Fingerprints(words[at : at + span + reach])
        for size, index in items.classes.items():
            for spots, own, distances in index.near(prints_of.of(size)[:span]):
                starts = at + spots
                rows = np.searchsorted(first, starts, "right") - 1
                inside = starts + size <= first[rows + 1]  # else the window runs into the next row
                for start, row, j, distance in zip(starts[inside].tolist(), rows[inside].tolist(), own[inside].tolist(), distances[inside].tolist(), strict=True):
                    number = int(index.numbers[j])
                    _verify(words, int(first[row]), int(first[row + 1]), row, start - int(index.places[j]), number, items, distance, o, best, seen)
    return [(row, number, *rest) for (row, number), rest in best.items()]


def _verify(words, low, high, row, begin, number, items, distance, o, best, seen) -> None:
    """Look for the item where it would begin at this word, as far around as a similar run may reach."""
    if (begin, number) in seen:
        return
    seen.add((begin, number))
    item = items.words[number]
    slack = len(item) // 4 + SHINGLE
    a, b = max(low, begin - slack), min(high, begin + len(item) + slack)
    found = best_run(item, words[a:b], o.similarity)
    if found:
        alike, start, size = found
        start += a - low
        if (row, number) not in best or (-alike, start) < (-best[row, number][2], best[row, number][0]):
            best[row, number] = (start, size, alike, distance)


def _item_blocks(benchmark: DataFrame, o: LeakOptions) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of bounded number and size; only one block is on the driver at a time."""
    block, held = [], 0
    for r in string_columns(benchmark, "item_id", "text").where("text IS NOT NULL AND text != ''").toLocalIterator():
        if block and (len(block) >= o.items_per_block or held + len(r.text) > o.bytes_per_block):
            yield block
            block, held = [], 0
        block.append((r.item_id, r.text))
        held += len(r.text)
    if block:
        yield block


def find_contamination(docs: DataFrame, benchmark: DataFrame, options: LeakOptions = LeakOptions()) -> DataFrame:
    """(doc_id, item_id, start_word, n_words, similarity, distance) of every item that stands in a document."""
    spark, o = prepare(docs.sparkSession), options
    rows = string_columns(docs, "doc_id", "text")
    schema = "doc_id long, item_id long, start_word long, n_words long, similarity double, distance int"
    out = None
    for block in _item_blocks(benchmark, o):
        items = spark.sparkContext.broadcast(prepare_items(block, o))

        def find(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hits = search(batch.column(1), items.value, o)
                docs_ = batch.column(0).to_pylist()
                made = [(docs_[r], items.value.ids[n], s, k, alike, d) for r, n, s, k, alike, d in sorted(hits)]
                if made:
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), kinds, strict=True)], names=["doc_id", "item_id", "start_word", "n_words", "similarity", "distance"])

        part = rows.mapInArrow(find, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], schema)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, options: LeakOptions = LeakOptions()) -> DataFrame:
    """The rows of `docs`, all columns, in which no benchmark item stands."""
    spark, o = prepare(docs.sparkSession), options
    at = docs.columns.index("text")
    for block in _item_blocks(benchmark, o):
        items = spark.sparkContext.broadcast(prepare_items(block, o))

        def keep(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                clean[[hit[0] for hit in search(batch.column(at), items.value, o)]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs


def contaminated_ids(hits: DataFrame) -> DataFrame:
    return hits.groupBy("doc_id").agg(F.max("similarity").alias("similarity"), F.countDistinct("item_id").alias("n_items"))
