"""Alignment of two tokenizers' ids over the same bytes (two-pointer merge of cumulative token ends).

A document's tokens of both kinds end at byte offsets; merging the two ordered lists of ends walks through them side by side.
Each distinct end closes one stretch of bytes that lies in one token of each kind, which is a link of the two; an end that stands
in both lists closes a group. The merge runs over blocks of many documents at once inside `mapInPandas`, because all documents of
a block end in both lists. A block notes its distinct linked pairs once, with the number of its documents that hold them, and for
each document which of them it holds and how often. Spark counts the pairs (sums of the blocks' numbers), finds the highest count
of each id of either side, and joins both back to the blocks' pairs, from which a second `mapInPandas` sums up each document.

A pair is a row once for each block, not for each document or link; an id's partners are at most the other vocabulary. The
maxima that are broadcast are one row for each id of a vocabulary. Texts beyond `piece_chars` are taken in pieces, cut at a blank
between two ASCII letters, where every token of either kind ends; a document's pieces are added up, so memory stays bounded.

Defined cases: a text that is null or empty, or whose tokens' bytes do not give back a blank and the text, has no tokens: zeros
and an empty digest; strings of special tokens inside texts are plain text; repeated rows are documents of their own, each counted;
ids may be null; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, prepare, string_columns
from .tokens import _BYTE_LETTERS


@dataclass(frozen=True)
class AlignOptions:
    byte_level: str  # path of a byte-level BPE of the tokenizers library (side A)
    pieces: str  # path of a sentencepiece model with byte fallback (side B)
    block_bytes: int = 1 << 20
    piece_chars: int = 1 << 18
    keep_groups: bool = False  # give the groups themselves (`groups`) beside their digest


# How the byte-level pre-tokenizer cuts a text, which no token crosses.
_CUT_A = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Characters whose classes every Unicode version agrees on; a text of others is given to the tokenizer whole.
_STEADY = re.compile(r"[\t\n\r\x20-\x7e\xa1-\u024f]*+")
#: A run of blanks with what follows; a piece of side B has blanks at its start only. One blank at the end stays with the word
#: before it: alone it would be the blank that side B adds, and give no id.
_CUT_B = re.compile(r" +[^ ]*+(?: \Z)?")
CACHE_PARTS, LONG_PART = 200_000, 64


class _Sides:
    """Both tokenizers, and the bytes, lengths and printed forms of their ids."""

    def __init__(self, o: AlignOptions):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(o.byte_level)
        self.a.encode_special_tokens = True
        self.model = self.a.model
        self.b = SentencePieceProcessor(model_file=o.pieces)
        letters = {letter: byte for byte, letter in _BYTE_LETTERS.items()}
        vocabulary = self.a.get_vocab()
        bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for entry, i in vocabulary.items():
            bytes_a[i] = bytes(letters[x] for x in entry) if letters.keys() >= set(entry) else entry.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_a, self.bytes_b = bytes_a, [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("\u2581", " ").encode() for i, p in enumerate(pieces)]
        self.parted = not any("\u2581" in p.lstrip("\u2581") for p in pieces)
        self.size_a, self.size_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        ids = range(max(len(self.bytes_a), len(self.bytes_b)))
        self.printed = np.array([[f"{i}{mark}" for i in ids] for mark in ",|;"], object)
        self.known_a: dict[str, bytes] = {}
        self.known_b: dict[str, bytes] = {}
        self.unlike: set[str] = set()  # known parts whose tokens' bytes are not the part

    def _joined(self, cut: list[list[str] | None], known: dict[str, bytes], learn) -> list[np.ndarray | None]:
        """Ids of texts that are cut into parts; parts that are not known are learnt together, short ones are kept."""
        new = list({p for parts in cut if parts for p in parts} - known.keys())
        known.update(zip(new, learn(new), strict=True))
        ids = [None if parts is None else np.frombuffer(b"".join(map(known.__getitem__, parts)), "<u4") for parts in cut]
        for part in new:
            if len(part) > LONG_PART:
                del known[part]
        return ids

    def _learn_a(self, parts: list[str]) -> list[bytes]:
        units = (p.encode().decode("latin-1").translate(_BYTE_LETTERS) for p in parts)
        return [array("I", [t.id for t in self.model.tokenize(u)]).tobytes() for u in units]

    def _learn_b(self, parts: list[str]) -> list[bytes]:
        learnt = self.b.encode([p[1:] for p in parts], num_threads=1)
        self.unlike.update(p for p, ids in zip(parts, learnt, strict=True) if not self._same(self.bytes_b, ids, p))
        return [array("I", ids).tobytes() for ids in learnt]

    @staticmethod
    def _same(table: list[bytes], ids: list[int], text: str) -> bool:
        return b"".join(map(table.__getitem__, ids)) == text.encode()

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, int] | None]:
        """Ids of both sides and the number of bytes; None where the tokens' bytes are not a blank and the text.

        Side A's ids of its parts give the parts' bytes back by their making; those of side B are held against each part once.
        """
        spaced = [f" {t}" for t in texts]
        for known in (self.known_a, self.known_b):
            if len(known) > CACHE_PARTS:
                known.clear()
        self.unlike = {p for p in self.unlike if len(p) <= LONG_PART} if self.known_b else set()
        cut_a = [_CUT_A.findall(t) if _STEADY.fullmatch(t) else None for t in spaced]
        cut_b = [_CUT_B.findall(t) if self.parted else None for t in spaced]
        out = []
        for text, parts, a, b in zip(spaced, cut_b, self._joined(cut_a, self.known_a, self._learn_a), self._joined(cut_b, self.known_b, self._learn_b), strict=True):
            same = True
            if a is None:
                ids = self.a.encode(text, add_special_tokens=False).ids
                a, same = np.array(ids, np.uint32), self._same(self.bytes_a, ids, text)
            if b is None:
                ids = self.b.encode(text[1:])
                b, same = np.array(ids, np.uint32), same and self._same(self.bytes_b, ids, text)
            elif self.unlike:
                same = same and self.unlike.isdisjoint(parts)
            out.append((a, b, len(text.encode())) if same else None)
        return out


_SIDES: dict[tuple[str, str], _Sides] = {}


def _sides(o: AlignOptions) -> _Sides:
    """One for each Python worker."""
    key = (o.byte_level, o.pieces)
    if key not in _SIDES:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _SIDES[key] = _Sides(o)
    return _SIDES[key]


_CUT = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")


def pieces_of(text: str, size: int) -> Iterator[str]:
    """The text in pieces of at least `size` characters, cut at (and without) a blank between two ASCII letters.

    No token of either kind holds what stands on both sides of such a blank, and both start a word with its blank, so that the
    pieces, each with a blank before it, have the ids of the whole.
    """
    start = 0
    while len(text) - start > size and (cut := _CUT.search(text, start + size)):
        yield text[start : cut.start()]
        start = cut.end()
    yield text[start:]


class _Document:
    """Sums of a document over its pieces."""

    def __init__(self, doc_id):
        self.id, self.sound, self.sha = doc_id, True, hashlib.sha256()
        self.n = np.zeros(4, np.int64)  # tokens of A, of B, groups, links
        self.pairs: list[np.ndarray] = []
        self.times: list[np.ndarray] = []
        self.groups: list[str] = []

    def add(self, n, groups: str, pairs: np.ndarray, times: np.ndarray, keep: bool) -> None:
        if self.n[3]:
            self.sha.update(b";")
        self.sha.update(groups.encode())
        self.n += n
        self.pairs.append(pairs)
        self.times.append(times)
        if keep:
            self.groups.append(groups)

    def held(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct pairs and how often they stand here."""
        if not self.sound or not self.pairs:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(self.pairs) == 1:
            return self.pairs[0], self.times[0]
        pairs, at = np.unique(np.concatenate(self.pairs), return_inverse=True)
        times = np.zeros(len(pairs), np.int64)
        np.add.at(times, at, np.concatenate(self.times))
        return pairs, times


def _merge(queue: list[tuple[_Document, str]], o: AlignOptions) -> None:
    """Tokenize pieces and merge their ends; adds what is found to the pieces' documents."""
    sides = _sides(o)
    sound = []
    for (doc, _), found in zip(queue, sides.encode([text for _, text in queue]), strict=True):
        if found is None:
            doc.sound = False
        else:
            sound.append((doc, *found))
    if not sound:
        return
    a, b = (np.concatenate([x[k] for x in sound]).astype(np.int64) for k in (1, 2))
    ends_a, ends_b = np.cumsum(sides.size_a[a]), np.cumsum(sides.size_b[b])
    piece_ends = np.cumsum([x[3] for x in sound])
    # Two ordered runs: the sort merges them. Ends that stand twice are shared.
    merged = np.concatenate([ends_a, ends_b])
    merged.sort(kind="stable")
    first = np.diff(merged, prepend=-1) != 0
    merged, shared = merged[first], merged[~first]
    pairs = a[np.searchsorted(ends_a, merged)] << 32 | b[np.searchsorted(ends_b, merged)]
    per_piece = lambda ends: np.diff(np.searchsorted(ends, piece_ends, "right"), prepend=0)
    numbers = np.stack([per_piece(x) for x in (ends_a, ends_b, shared, merged)], axis=1)
    # Distinct pairs of each piece.
    distinct, local = np.unique(pairs, return_inverse=True)
    piece = np.repeat(np.arange(len(sound)), numbers[:, 3])
    found, times = np.unique(piece * len(distinct) + local, return_counts=True)
    bounds = np.searchsorted(found, np.arange(len(sound) + 1) * len(distinct))
    found = distinct[found % len(distinct)]
    # Printed ids in the order of groups, A before B; the mark after each says what follows.
    group_a, group_b = np.searchsorted(shared, ends_a), np.searchsorted(shared, ends_b)
    printed = np.empty(len(a) + len(b), object)
    printed[np.arange(len(a)) + np.searchsorted(group_b, group_a, "left")] = sides.printed[np.append(np.diff(group_a), 1).astype(bool).astype(int), a]
    printed[np.arange(len(b)) + np.searchsorted(group_a, group_b, "right")] = sides.printed[np.append(np.diff(group_b), 1).astype(bool) * 2, b]
    upto = np.cumsum(numbers[:, 0] + numbers[:, 1])
    for k, (doc, *_) in enumerate(sound):
        text = "".join(printed[upto[k - 1] if k else 0 : upto[k]].tolist())[:-1]
        doc.add(numbers[k], text, found[bounds[k] : bounds[k + 1]], times[bounds[k] : bounds[k + 1]], o.keep_groups)


_BLOCK = "block long, ids array<{id}>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>, groups array<string>, sizes array<int>, places binary, times binary, pairs array<long>, docs array<int>"


def _block(number: int, docs: list[_Document]) -> pd.DataFrame:
    held = [d.held() for d in docs]
    pairs, places = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
    n = np.stack([d.n if d.sound else np.zeros(4, np.int64) for d in docs])
    row = {
        "block": number,
        "ids": [d.id for d in docs],
        **{c: n[:, i] for i, c in enumerate(("n_a", "n_b", "n_groups", "n_links"))},
        "groups_sha256": [d.sha.hexdigest() if d.sound and d.n[3] else "" for d in docs],
        "groups": [";".join(d.groups) if d.sound else "" for d in docs],
        "sizes": np.array([len(h[0]) for h in held], np.int32),
        "places": places.astype("<u4").tobytes(),
        "times": np.concatenate([h[1] for h in held]).astype("<u4").tobytes(),
        "pairs": pairs,
        "docs": np.bincount(places, minlength=len(pairs)).astype(np.int32),
    }
    return pd.DataFrame({k: [v] for k, v in row.items()})


def aligned_blocks(docs: DataFrame, o: AlignOptions) -> DataFrame:
    """Blocks of documents (doc_id, text) with their numbers, their distinct pairs, and which of them each document holds."""

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        done: list[_Document] = []
        queue: list[tuple[_Document, str]] = []
        size = 0
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].astype(object), batch["text"], strict=True):
                doc = _Document(None if pd.isna(doc_id) else doc_id)
                for piece in pieces_of(text, o.piece_chars) if isinstance(text, str) and text else ():
                    queue.append((doc, piece))
                    size += len(piece)
                    if size >= o.block_bytes:
                        _merge(queue, o)
                        queue, size = [], 0
                done.append(doc)
                if not queue and len(done) > 1 or len(done) >= 4096:
                    _merge(queue, o)
                    yield _block(number, done)
                    number, done, queue, size = number + 1, [], [], 0
        if done:
            _merge(queue, o)
            yield _block(number, done)

    rows = string_columns(docs, "doc_id", "text")
    return rows.mapInPandas(align, _BLOCK.format(id=rows.schema["doc_id"].dataType.simpleString()))


def pair_table(blocks: DataFrame, scratch: Scratch) -> DataFrame:
    """(pair, a_id, b_id, n_docs, best_a, best_b): how many documents hold a pair linked, and whether that is the most of its A or B id."""
    held = blocks.select(F.inline(F.arrays_zip("pairs", "docs"))).groupBy(F.col("pairs").alias("pair")).agg(F.sum("docs").alias("n_docs"))
    counts = scratch.write(held.select("pair", F.shiftright("pair", 32).cast("int").alias("a_id"), F.col("pair").bitwiseAND(0xFFFFFFFF).cast("int").alias("b_id"), "n_docs"), "pairs")
    # One row for each id of a vocabulary.
    most = {c: F.broadcast(counts.groupBy(c).agg(F.max("n_docs").alias(f"most_{c}"))) for c in ("a_id", "b_id")}
    rated = counts.join(most["a_id"], "a_id").join(most["b_id"], "b_id")
    return rated.select("pair", "a_id", "b_id", "n_docs", (F.col("n_docs") == F.col("most_a_id")).alias("best_a"), (F.col("n_docs") == F.col("most_b_id")).alias("best_b"))


def _rated(blocks: DataFrame, rated: DataFrame) -> DataFrame:
    """(block, counts, best): the corpus-wide counts of a block's pairs in their order, and whether each is the best of its A (1) and B id (2)."""
    named = blocks.select("block", F.posexplode("pairs").alias("place", "pair"))
    marks = F.col("best_a").cast("int") + 2 * F.col("best_b").cast("int")
    met = named.join(rated.select("pair", "n_docs", marks.cast("byte").alias("marks")), "pair")
    rows = met.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("place", "n_docs", "marks"))).alias("r"))
    return rows.select("block", F.col("r.n_docs").alias("counts"), F.col("r.marks").alias("best"))


def align_tokens(docs: DataFrame, options: AlignOptions) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, n_a, n_b, n_groups, n_links, n_best, n_best_b, count_sum, groups_sha256, groups) and the table of linked pairs.

    `groups` is null unless the options keep it.
    """
    o, spark = options, prepare(docs.sparkSession)
    scratch = Scratch(spark)
    blocks = scratch.write(aligned_blocks(docs, o), "aligned")
    rated = scratch.write(pair_table(blocks, scratch), "rated")
    numbers = ("n_a", "n_b", "n_groups", "n_links")
    met = blocks.drop("pairs", "docs").join(_rated(blocks, rated), "block", "left")
    id_type = blocks.schema["ids"].dataType.elementType.simpleString()

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                places, times = np.frombuffer(row.places, "<u4"), np.frombuffer(row.times, "<u4").astype(np.int64)
                counts, marks = (np.asarray(x, np.int64) if x is not None else np.zeros(0, np.int64) for x in (row.counts, row.best))
                ends = np.cumsum(row.sizes)
                per_document = lambda x, ends=ends: np.diff(np.append(0, np.cumsum(x))[ends], prepend=0)
                best = [per_document(((marks >> side) & 1)[places] * times) for side in (0, 1)]
                made = pd.DataFrame({"doc_id": pd.Series(row.ids, dtype=object), **{c: getattr(row, c) for c in numbers}})
                made["n_best"], made["n_best_b"], made["count_sum"] = *best, per_document(counts[places] * times)
                made["groups_sha256"], made["groups"] = row.groups_sha256, list(row.groups) if o.keep_groups else None
                yield made

    longs = ", ".join(f"{c} long" for c in (*numbers, "n_best", "n_best_b", "count_sum"))
    found = met.mapInPandas(add_up, f"doc_id {id_type}, {longs}, groups_sha256 string, groups string")
    scratch.clear(blocks, rated)
    return found, rated.drop("pair")
