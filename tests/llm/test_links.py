import random
from collections import Counter

from textloom.llm import trie_join


def _set(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def _alike(a, b):
    return bool(a & b) and 100 * len(a & b) >= 80 * len(a | b)


def _texts(spark, sf_dir):
    rng = random.Random(6)
    words = [f"w{k}" for k in range(60)]
    rows = [(None, None), (1, ""), (2, " \n "), (3, "word"), (3, "word"), (None, "word two"), (4, "A b\tC d  e"), (5, "a B c D E"), (6, "x" * 50_000)]
    for i in range(120):
        own = list(words)
        for _ in range(rng.randint(0, 3)):
            own[rng.randrange(60)] = f"e{rng.randrange(10**6)}"
        rows.append((1000 + i, " ".join(own)))
    return rows + [(2000, rows[-1][1]), (2001, rows[-1][1])]


def test_every_link_between_different_texts_is_given(spark, sf_dir):
    table = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    for rows in (_texts(spark, sf_dir), table):
        sets = [_set(t) for _, t in rows]
        want = Counter((rows[i][0], len(s), sum(_alike(s, x) for j, x in enumerate(sets) if i != j)) for i, s in enumerate(sets))
        docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", trie_join.F.lit("clash"))
        small = trie_join.JoinOptions(least_common=2, sample=2, members_per_block=7, sets_per_block=9, shingles_per_block=700, shingles_per_tree=500, broadcast_pairs=3, limits=trie_join.Limits(5, 300))
        for options in (trie_join.JoinOptions(), small):
            found = trie_join.jaccard_components(docs, options).select("doc_id", "n_shingles", "n_links")
            assert Counter(map(tuple, found.collect())) == want


def test_no_documents_have_no_links(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert trie_join.jaccard_components(none).collect() == []


def test_shingle_that_each_task_sees_once_is_counted_as_common(spark):
    shared = "these five words are everywhere"
    rows = [(i, " ".join(f"d{i}w{k}" for k in range(30)) + " " + shared) for i in range(64)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(64, "doc_id")
    read = trie_join._sets_and_common(docs, trie_join.JoinOptions(sample=1)).cache()
    order = trie_join._order(read, trie_join.JoinOptions(sample=1))
    words, first, _, _ = trie_join.word_hashes(*trie_join.text_bytes(trie_join.pa.array([shared])))
    assert order.is_common(next(trie_join.row_shingles(words, first))).all() and len(order.hashes) == 1
    read.unpersist()


def _thue_morse(n, first):
    return "".join("ab"[(bin(i).count("1") + first) % 2] for i in range(n))


def test_words_keep_their_identity(spark):
    """Words whose sums of powers are equal, swapped halves of long words, and random long words."""
    rng = random.Random(4)
    half = ["".join(rng.choice("xyz") for _ in range(1 << 16)) for _ in range(2)]
    long = ["".join(rng.choice("ab") for _ in range(rng.choice([63, 64, 65, 66, 128, 1000]))) for _ in range(300)]
    texts = [_thue_morse(1024, 0), _thue_morse(1024, 1), _thue_morse(64, 0), _thue_morse(64, 1), half[0] + half[1], half[1] + half[0], *long]
    texts += [t.upper() for t in texts[:6]] + [t[:-1] + "\x00" for t in texts[:4]] + [t + "\x00" for t in texts[:4]]
    words, first, _, _ = trie_join.word_hashes(*trie_join.text_bytes(trie_join.pa.array(texts)))
    assert len(words) == len(texts) and first.tolist() == list(range(len(texts) + 1))
    names = {}
    for text, word in zip(texts, words.tolist(), strict=True):
        assert names.setdefault(text.lower(), word) == word
    assert len(set(names.values())) == len(names)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [_set(t) for t in texts]
    want = {i: sum(_alike(s, x) for j, x in enumerate(sets) if i != j) for i, s in enumerate(sets)}
    assert {r.doc_id: r.n_links for r in trie_join.jaccard_components(docs).collect()} == want
