"""Merkle manifest against a plain tree."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from textloom.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, part string, gkey int"


def _hash(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(values):
    return _hash(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def _climb(nodes):
    """All levels of a tree from its leaves up."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([_hash(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def _siblings(levels, at):
    for nodes in levels[:-1]:
        run = at // 3 * 3
        yield nodes[run:at], nodes[at + 1 : run + 3]
        at //= 3


def _plain(rows, other):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r[0], _leaf(r[:5]), _leaf([*r[:4], other(r)])))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[g] = _climb([x[1] for x in groups[g]])
    top = _climb([trees[g][-1][0] for g in order])
    for k, g in enumerate(order):
        for i, (doc, leaf, shown) in enumerate(groups[g]):
            proof, h = "", shown
            for left, right in [*_siblings(trees[g], i), *_siblings(top, k)]:
                proof += "".join(left + right)
                h = _hash(*left, h, *right)
            yield doc, leaf, trees[g][-1][0], top[-1][0], _hash(proof), h, h == top[-1][0]


def _got(data, tampered, options):
    made = merkle.build_manifest(data, tampered, options)
    rows = made.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")), "folded_root", "verified").collect()
    return sorted(map(tuple, rows), key=str)


@pytest.mark.parametrize("levels", [1, 2, 8])
def test_every_proof_against_a_plain_tree(spark, levels):
    rows = [(i, f"s{i % 7 if i % 3 else 0}", "en", i, f"text {i}\nmore" if i % 4 else f"one line {i}", "x", 1) for i in range(200)]
    rows += [(900 + i, f"single{i}", None, None, None, None, None) for i in range(12)]
    rows += [(None, None, None, None, "\n", "y", 2), (None, None, None, None, "", "y", 2), (1000, None, "é", 3, "", "y", 2), (1001, "", "de", 3, "ü\n" * 50_000, "y", 2)]
    rows += [(1002, "zz", "en", 1, "twice\n", "z", 3)] * 4
    crc = lambda r: r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
    want = sorted(_plain(rows, lambda r: r[4].replace("\n", "") if r[4] is not None and crc(r) else r[4]), key=str)
    assert not all(w[-1] for w in want) and any(w[-1] for w in want)
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit("")))
    data = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert _got(data, tampered, merkle.MerkleOptions(levels=levels, rows_per_table=10)) == want


def test_one_leaf_and_no_leaf(spark):
    one = (7, "a", None, 2, "hi", None, None)
    (row,) = _got(spark.createDataFrame([one], SCHEMA), None, merkle.MerkleOptions())
    assert row == (7, _leaf(one[:5]), _leaf(one[:5]), _leaf(one[:5]), _hash(""), _leaf(one[:5]), True)
    assert _got(spark.createDataFrame([], SCHEMA), None, merkle.MerkleOptions()) == []
