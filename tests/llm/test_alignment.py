"""Alignment of two tokenizers against a walk with two pointers, token by token."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from textloom.llm import token_align

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
NUMBERS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "n_best_b", "count_sum")


class Plain:
    def __init__(self):
        self.a = Tokenizer.from_file(A)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=B)

    def _bytes_of_b(self, i):
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def walk(self, text):
        """Groups and links of a text, or None."""
        if not text:
            return None
        whole = " " + text
        found = self.a.encode(whole, add_special_tokens=False)
        raw = [self._bytes_of_a(t) for t in found.tokens]
        a, b = list(zip(found.ids, raw, strict=True)), [(i, self._bytes_of_b(i)) for i in self.b.encode(text)]
        if any(b"".join(x for _, x in side) != whole.encode() for side in (a, b)):
            return None
        groups, links, i, j = [([], [])], [], 0, 0
        end_a, end_b = len(a[0][1]), len(b[0][1])
        groups[0][0].append(a[0][0]), groups[0][1].append(b[0][0])
        while True:
            links.append((a[i][0], b[j][0]))
            step_a, step_b = end_a <= end_b, end_b <= end_a
            if step_a and step_b and i + 1 < len(a):
                groups.append(([], []))
            if step_a:
                i += 1
                if i == len(a):
                    return groups, links
                end_a += len(a[i][1])
                groups[-1][0].append(a[i][0])
            if step_b:
                j += 1
                end_b += len(b[j][1])
                groups[-1][1].append(b[j][0])

    def _bytes_of_a(self, token):
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [x for x in range(256) if x not in own]
        return bytes(ord(c) if ord(c) < 256 else rest[ord(c) - 256] for c in token)


@pytest.fixture(scope="module")
def plain():
    return Plain()


def _texts():
    rng = random.Random(5)
    pool = ["alpha", "the", "straße", "naïve", "x", "12345", "日本語", "😀", "\n", "  ", "<|endoftext|>", "</s>", "<0x41>", "don't", "\t", "ﬁ", "é", "\x00", "▁", "(a)", "!!!"]
    texts = ["", None, " ", "a", "alpha", " alpha", " ", "one two three"] + [("alpha beta " * 4000)]
    return texts + ["".join(rng.choice(pool) + rng.choice(["", " ", " "]) for _ in range(rng.randint(1, 60))) for _ in range(120)]


@pytest.mark.parametrize("options", [{}, {"block_bytes": 300, "piece_chars": 40}])
def test_against_two_pointers(spark, plain, options):
    texts = _texts()
    rows = [(i if i != 9 else None, t, "x", i) for i, t in enumerate(texts)] + [(200, "one two three", "y", 1)] * 2
    data = spark.createDataFrame(rows, "doc_id long, text string, n_a string, block int").repartition(3)
    found, pairs = token_align.align_tokens(data, token_align.AlignOptions(A, B, keep_groups=True, **options))
    walked = [(i, plain.walk(t)) for i, t, *_ in rows]
    assert sum(w is not None for _, w in walked) > 40 and sum(w is None for _, w in walked) > 3
    counts = Counter(p for _, w in walked if w for p in set(w[1]))
    most_a, most_b = Counter(), Counter()
    for (a, b), k in counts.items():
        most_a[a], most_b[b] = max(most_a[a], k), max(most_b[b], k)
    assert {(r.a_id, r.b_id): (r.n_docs, r.best_a, r.best_b) for r in pairs.collect()} == {p: (k, k == most_a[p[0]], k == most_b[p[1]]) for p, k in counts.items()}
    want = []
    for i, w in walked:
        if w is None:
            want.append((i, *[0] * 7, "", ""))
            continue
        groups, links = w
        said = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        k = [counts[p] for p in links]
        best = (sum(x == most_a[p[0]] for x, p in zip(k, links, strict=True)), sum(x == most_b[p[1]] for x, p in zip(k, links, strict=True)))
        want.append((i, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links), *best, sum(k), hashlib.sha256(said.encode()).hexdigest(), said))
    assert sorted(map(str, map(tuple, found.select("doc_id", *NUMBERS, "groups_sha256", "groups").collect()))) == sorted(map(str, want))


def test_no_rows(spark):
    found, pairs = token_align.align_tokens(spark.createDataFrame([], "doc_id long, text string"), token_align.AlignOptions(A, B))
    assert found.collect() == [] and pairs.collect() == []


def test_pieces_have_the_ids_of_the_whole(plain):
    rng = random.Random(2)
    for text in _texts():
        if text:
            pieces = list(token_align.pieces_of(text, rng.randint(1, 50)))
            assert " ".join(pieces) == text
            assert sum((plain.b.encode(p) for p in pieces), []) == plain.b.encode(text)
            assert sum((plain.a.encode(" " + p, add_special_tokens=False).ids for p in pieces), []) == plain.a.encode(" " + text, add_special_tokens=False).ids


def test_a_blank_at_the_end_is_a_token(plain):
    """One blank behind the last word was encoded by itself, which gives no id, and the text then had no tokens at all."""
    for text in ("alpha ", "alpha  ", "alpha\n ", " ", "a b ", "straße 12345 "):
        groups, _ = plain.walk(text)
        a, b, n_bytes = token_align._Sides(token_align.AlignOptions(A, B)).encode([text])[0]
        assert (a.tolist(), b.tolist(), n_bytes) == ([x for g in groups for x in g[0]], [x for g in groups for x in g[1]], len(text.encode()) + 1)
