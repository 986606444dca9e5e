import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.llm import common, decontaminate, langid, packing, pii_bootstrap, prefix_tree, quality_zdict, queries, token_scan, trie_join, va_topk

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)


def _clash(df):
    names = ["node", "low", "n", "token", "part", "label", "file_id", "score", "ids", "window", "item_id", "kind", "x", "r"]
    return df.withColumns({c: F.lit("clash") for c in names})


def _texts(spark, sf_dir):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


EDGES = [(1, None), (2, ""), (3, " \n "), (4, "word"), (4, "word"), (None, "word two"), (5, "x" * 200_000), (6, "é <|endoftext|> Ünï 12 a.b,c"), (7, "long words here " * 3000)]


def _tokenizer(literal=False):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    t.encode_special_tokens = literal
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def _check_pieces(rows, texts):
    encode = _tokenizer()
    ids = Counter()
    for r in rows:
        own = [*encode(texts[r.doc_id]), 1]
        part = own[r.start : r.start + r.length]
        assert len(part) == r.length > 0 and r.doc_tokens == len(own)
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32
        ids[r.doc_id] += r.length
    assert all(ids[i] % (len(encode(t)) + 1) == 0 and ids[i] for i, t in texts.items())
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    return len(sequences), sum(r.length for r in rows)


def test_packing_is_exact_and_tight(spark, sf_dir):
    number, tokens = _check_pieces(queries.op6_packing(spark, sf_dir).collect(), _texts(spark, sf_dir))
    assert tokens / (number * 2048) > 0.97


def test_packing_edges(spark):
    options = packing.PackOptions(queries.tokenizer_path(), open_windows=2)
    _check_pieces(packing.pack(_clash(_docs(spark, EDGES)), options).collect(), dict(EDGES))
    assert packing.pack(_docs(spark, []), options).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aAbé'sS.,!? \t\n12́İΣς<|endoftext>Kt", max_size=60))
def test_word_encoder_equals_the_tokenizer(text):
    from textloom.llm.tokens import encoder

    assert encoder(queries.tokenizer_path()).encode(text) == np.array(_tokenizer()(text), "<u4").tobytes()


def test_token_scan(spark, sf_dir):
    encode, texts = _tokenizer(True), _texts(spark, sf_dir)
    got = {r.doc_id: r.n_tokens for r in queries.op10_token_counts(spark, sf_dir).collect()}
    assert got == {i: len(encode(t)) for i, t in texts.items()}


def _flat(folder, name, ids, kind="<u2"):
    folder.mkdir(exist_ok=True)
    np.array(ids, kind).tofile(folder / name)


def test_token_scan_edges(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(token_scan, "CHUNK_BLOCKS", 3)
    encode = _tokenizer(True)
    files, order = token_scan.write_token_files(_clash(_docs(spark, EDGES)), queries.tokenizer_path(), 49407)
    for range_ids in (7, 1000):
        got = Counter((r.doc_id, r.n_tokens) for r in token_scan.name_documents(token_scan.scan_separators(files, 49407, range_ids=range_ids), order).collect())
        assert got == Counter((i, len(encode(t))) for i, t in EDGES)
    files, order = token_scan.write_token_files(_docs(spark, EDGES).limit(0), queries.tokenizer_path(), 49407)
    assert token_scan.name_documents(token_scan.scan_separators(files, 49407), order).collect() == []


def test_one_file_cut_at_every_place(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(token_scan, "CHUNK_BLOCKS", 2)
    ids = [1, 2, 9, 9, 3, 4, 5, 6, 7, 8, 9, 1, 9, 2, 2]
    _flat(tmp_path / "flat", "a.ids", ids)
    _flat(tmp_path / "flat", "b.ids", [9])
    _flat(tmp_path / "flat", "empty.ids", [])
    listed = token_scan.list_token_files(spark, str(tmp_path / "flat"))
    names = {r.file_id: r.path[-5] for r in listed.collect()}
    want = sorted([("a", 0, 0, 2, True), ("a", 1, 3, 0, True), ("a", 2, 4, 6, True), ("a", 3, 11, 1, True), ("a", 4, 13, 2, False), ("b", 0, 0, 0, True)])
    for range_ids in range(1, len(ids) + 2):
        found = token_scan.scan_separators(listed, 9, range_ids=range_ids).collect()
        assert sorted((names[r.file_id], *tuple(r)[1:]) for r in found) == want


def test_token_files_on_disk(spark, tmp_path):
    rng, want = np.random.default_rng(5), Counter()
    for width, kind in ((2, "<u2"), (4, "<u4")):
        for k in range(4):
            lengths = rng.integers(0, 40, int(rng.integers(0, 30))).tolist()
            ids = np.concatenate([np.zeros(0, int), *(np.append(rng.integers(0, 49407, n), 49407) for n in lengths)])
            # Ids after the last separator: an unfinished document.
            _flat(tmp_path / f"w{width}", f"part{k}.bin", np.append(ids, [5] * k), kind)
            want += Counter((width, n, True) for n in lengths) + Counter([(width, k, False)] if k else [])
    got = Counter()
    for width in (2, 4):
        files = token_scan.list_token_files(spark, str(tmp_path / f"w{width}"))
        got += Counter((width, r.n_tokens, r.ended) for r in token_scan.scan_separators(files, 49407, width, range_ids=11).collect())
    assert got == want
    (tmp_path / "odd").mkdir()
    (tmp_path / "odd" / "x.bin").write_bytes(b"123")
    with pytest.raises(Exception, match="no whole number of ids"):
        token_scan.scan_separators(token_scan.list_token_files(spark, str(tmp_path / "odd")), 9).collect()


def test_ids_that_two_bytes_cannot_hold_are_an_error():
    assert token_scan._narrow(np.array([1, 65535], "<u4").tobytes(), 2) == np.array([1, 65535], "<u2").tobytes()
    with pytest.raises(ValueError, match="does not fit"):
        token_scan._narrow(np.array([65536], "<u4").tobytes(), 2)
    assert token_scan._narrow(np.array([65536], "<u4").tobytes(), 4) == np.array([65536], "<u4").tobytes()


def _brute_components(texts):
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both) and (x := root(a)) != (y := root(b)):
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


def test_ngram_join_on_the_table(spark, sf_dir):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op5_ngram_join(spark, sf_dir).collect()}
    assert got == _brute_components(_texts(spark, sf_dir))


def test_ngram_join_on_near_copies_and_edges(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(60)]
    texts = {}
    for i in range(120):  # copies at growing distance, all of one base: hot shingles, chains, and pairs on either side of 0.8
        own = list(words)
        for _ in range(rng.randint(0, 3)):
            own[rng.randrange(60)] = f"e{rng.randrange(10**6)}"
        texts[i] = " ".join(own)
    texts |= {1000 + i: t for i, (_, t) in enumerate(EDGES)}
    texts[2000], texts[2001] = "A b\tC d  e", "a B c D E"
    rows = [*texts.items(), (0, texts[0])]
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in trie_join.jaccard_components(_clash(_docs(spark, rows))).collect()}
    assert got == {(i, *x) for i, x in _brute_components(texts).items()}
    assert trie_join.jaccard_components(_docs(spark, [])).collect() == []


def _pool(rng, k=40):
    """Sets of shingle hashes: near copies of a few, at growing distance, and some of one shingle."""
    sets = []
    for _ in range(int(rng.integers(1, 10))):
        base = np.unique(rng.integers(1, 2**63, int(rng.integers(1, 60)), dtype=np.uint64))
        for _ in range(int(rng.integers(1, 8))):
            own = base.copy()
            for at in rng.integers(0, len(own), int(rng.integers(0, len(own) // 4 + 2))):
                own[at] = rng.integers(1, 2**40)
            sets.append(np.unique(own[: max(1, len(own) - int(rng.integers(0, 3)))]))
    return list({s.tobytes(): s for s in sets}.values())


def test_prefix_trees_by_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(30):
        sets = _pool(rng)
        weights = rng.integers(1, 5, len(sets)).tolist()
        alike = [[i != j and 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b)) for j, b in enumerate(sets)] for i, a in enumerate(sets)]
        want = [sum(w for w, x in zip(weights, row, strict=True) if x) for row in alike]
        half = len(sets) // 2
        for limits in (prefix_tree.Limits(), prefix_tree.Limits(5, 100)):
            whole = prefix_tree.Sets(sets, weights)
            forest = prefix_tree.join_sets(whole, None, limits)
            assert whole.links.tolist() == want and all(alike[a][b] for a, b in forest)
            parts = components_of(len(sets), forest)
            assert all(parts[i] == parts[j] for i, row in enumerate(alike) for j, x in enumerate(row) if x)
            if half:
                left, right = prefix_tree.Sets(sets[:half], weights[:half]), prefix_tree.Sets(sets[half:], weights[half:])
                crossing = prefix_tree.join_sets(left, right, limits)
                assert all(alike[a][b] for a, b in crossing)
                prefix_tree.join_sets(left, None, limits)
                prefix_tree.join_sets(right, None, limits)
                assert [*left.links, *right.links] == want


def components_of(n, edges):
    label = list(range(n))
    for a, b in edges:
        old, new = label[b], label[a]
        label = [new if x == old else x for x in label]
    return label


def test_near_copies_share_paths_of_a_tree():
    rng = np.random.default_rng(2)
    base = np.unique(rng.integers(1, 2**63, 200, dtype=np.uint64))
    sets = [np.unique(np.concatenate([np.delete(base, rng.integers(0, 200, 4)), rng.integers(1, 2**63, 4, dtype=np.uint64)])) for _ in range(200)]
    tree = prefix_tree._Tree(sets, sets, True)
    assert tree.forks[1:].mean() > 20
    wide = prefix_tree.Sets(sets, [1] * 200)
    assert len(prefix_tree.join_sets(wide)) == 199 and wide.links.tolist() == [199] * 200


def test_keep_one(spark):
    a, b = "one two three four five six seven eight", "other words that are not alike at all here"
    rows = [(5, a), (3, a), (9, b), (9, b), (None, a), (None, "only a null id has this text here"), (None, "only a null id has this text here"), (7, None), (7, None), (8, "")]
    kept = trie_join.keep_one(_docs(spark, rows))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter([(3, a), (9, b), (None, rows[5][1]), (7, None), (7, None), (8, "")])
    plain = trie_join.keep_one(_docs(spark, [(5, a), (3, a), (9, b), (2, None)]))
    assert sorted(r.doc_id for r in plain.collect()) == [2, 3, 9]


def test_decontamination_by_brute_force(spark, sf_dir):
    bench = {r.item_id: r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    want = set()
    for i, t in _texts(spark, sf_dir).items():
        low = " ".join((t or "").lower().split())
        want |= {(i, j) for j, b in bench.items() if " ".join(b.lower().split()) in low}
    got = queries.op2_decontaminate(spark, sf_dir).collect()
    assert want and want <= {(r.doc_id, r.item_id) for r in got}
    assert all(r.similarity == 1.0 for r in got if (r.doc_id, r.item_id) in want) and all(r.similarity >= 0.8 for r in got)
    # What is found is there: the same windows give the reported similarity.
    texts = _texts(spark, sf_dir)
    for r in got:
        w, item = texts[r.doc_id].split()[r.start_word : r.start_word + r.n_words], bench[r.item_id].split()
        a, b = (Counter(tuple(x.lower() for x in s[k : k + 5]) for k in range(len(s) - 4)) for s in (w, item))
        assert r.similarity == pytest.approx(sum((a & b).values()) / sum((a | b).values()))


def test_decontamination_edges(spark):
    item = "the quick brown fox jumps over the lazy dog and then it sleeps for the whole of the long day"
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "too short"), (5, item)], "item_id long, text string")
    rows = [*EDGES, (20, f"before {item.upper()} after"), (21, item + " " + item), (22, item.replace("fox", "cat").replace("whole", "most").replace("lazy", "old"))]
    got = decontaminate.find_contamination(_clash(_docs(spark, rows)), bench)
    assert sorted((r.doc_id, r.item_id) for r in got.collect()) == [(20, 1), (20, 5), (21, 1), (21, 5)]
    small = decontaminate.LeakOptions(items_per_block=1)
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.find_contamination(_docs(spark, rows), bench, small).collect()) == [(20, 1), (20, 5), (21, 1), (21, 5)]
    assert Counter(r.doc_id for r in decontaminate.remove_contaminated(_docs(spark, rows), bench).collect()) == Counter([*(i for i, _ in EDGES), 22])
    assert decontaminate.find_contamination(_docs(spark, rows), bench.limit(0)).collect() == []


def test_edited_items_are_found_wherever_the_edits_are():
    rng = random.Random(11)
    options, missed, seen = decontaminate.LeakOptions(), 0, 0
    for _ in range(300):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([15, 20, 33, 50, 59, 100, 260]))]
        copy = list(words)
        for _ in range(rng.randint(0, max(1, len(words) // 45))):
            copy[rng.choice([0, len(words) - 1, rng.randrange(len(words))])] = f"x{rng.randrange(5000)}"
        text = " ".join([f"a{rng.randrange(5000)}" for _ in range(40)] + copy + [f"b{rng.randrange(5000)}" for _ in range(40)])
        items = decontaminate.prepare_items([(1, " ".join(words))], options)
        a, b = (Counter(tuple(x[k : k + 5]) for k in range(len(x) - 4)) for x in (words, copy))
        if sum((a & b).values()) >= 0.8 * sum((a | b).values()):
            seen += 1
            missed += not decontaminate.search(pa.array([text]), items, options)
    assert seen > 200 and missed == 0


def _least_lost(n, windows):
    """The fewest shingles that changed words can take with them, over all placements that leave no window as it was."""
    m, best = n - 4, {-1: 0}
    reach = [min((a + s - 1 for s, a in windows if a > i), default=n) for i in range(-1, n)]  # the next change stands here at the latest
    for j in range(n):
        lost = [c + max(0, min(j, m - 1) - max(j - 4, i + 1, 0) + 1) for i, c in best.items() if j <= reach[i + 1]]
        best[j] = min(lost) if lost else m
    return min(c for i, c in best.items() if reach[i + 1] == n)


def test_no_placement_of_edits_touches_every_window():
    for n in range(8, 200):
        lost, m = _least_lost(n, decontaminate.item_windows(n)), n - 4
        assert 5 * (m - lost) < 4 * (m + lost), (n, lost)
    rng = random.Random(12)
    for n, edits in ((52, (0, 49)), (68, (0, 65)), (67, (0, 33)), (104, (0, 1, 26, 51, 103))):
        for _ in range(20):
            words = [f"w{rng.randrange(10**9)}" for _ in range(n)]
            copy = [f"x{rng.randrange(10**9)}" if k in edits else w for k, w in enumerate(words)]
            a, b = (Counter(tuple(x[k : k + 5]) for k in range(len(x) - 4)) for x in (words, copy))
            if sum((a & b).values()) >= 0.8 * sum((a | b).values()):
                assert decontaminate.search(pa.array(["before " * 9 + " ".join(copy) + " after" * 9]), decontaminate.prepare_items([(1, " ".join(words))], decontaminate.LeakOptions()), decontaminate.LeakOptions())


def test_texts_that_end_within_an_item_are_found():
    rng = random.Random(13)
    for n in range(10, 200):
        words = [f"w{rng.randrange(10**9)}" for _ in range(n)]
        cut = (n - 4) // 5
        items = decontaminate.prepare_items([(1, " ".join(words))], decontaminate.LeakOptions())
        for left in {0, cut // 2, cut}:
            assert decontaminate.search(pa.array([" ".join(words[left : n - cut + left])]), items, decontaminate.LeakOptions())


def _best_run(item, words):
    """The most similar run of words, over all runs."""
    want, best = Counter(tuple(item[k : k + 5]) for k in range(len(item) - 4)), (0.0, 0, 0)
    for i in range(len(words) - 4):
        run = Counter()
        for j in range(i, len(words) - 4):
            run[tuple(words[j : j + 5])] += 1
            alike = sum((run & want).values()) / sum((run | want).values())
            if alike > best[0] + 1e-12:
                best = (alike, i, j + 5 - i)
    return best


def _edited(rng, words, edits):
    """A copy with so many words changed, inserted or taken out, now and then at an end, or cut at an end."""
    copy = list(words)
    for _ in range(edits):
        at = rng.choice([0, len(copy) - 1, rng.randrange(len(copy))])
        what = rng.randrange(4)
        if what == 0:
            copy[at] = f"x{rng.randrange(10**9)}"
        elif what == 1:
            copy.insert(at, f"x{rng.randrange(10**9)}")
        elif what == 2 and len(copy) > 1:
            del copy[at]
        elif len(copy) > 6:
            copy = copy[1:] if rng.random() < 0.5 else copy[:-1]
    return copy


def test_best_run_by_brute_force():
    rng = random.Random(21)
    number = lambda words: np.array([zlib.crc32(w.encode()) + 1 for w in words], np.uint64)
    for trial in range(150):
        pool = [f"w{k}" for k in range(4 if trial % 3 == 0 else 1000)]  # few words: shingles recur, in the item and around it
        item = [rng.choice(pool) for _ in range(rng.randint(5, 30))]
        words = [rng.choice(pool) for _ in range(rng.randint(0, 8))] + _edited(rng, item, rng.randint(0, 2)) + [rng.choice(pool) for _ in range(rng.randint(0, 8))]
        alike, start, size = _best_run(item, words)
        got = decontaminate.best_run(number(item), number(words), 0.8)
        assert (got is None and alike < 0.8 - 1e-9) or (got[0] == pytest.approx(alike) and got[1:] == (start, size))


def test_all_similar_copies_of_items_of_any_length_are_found():
    rng, o, seen = random.Random(22), decontaminate.LeakOptions(), 0
    for n in [*range(1, 60), 64, 77, 90, 110, 140, 190, 193, 200, 250, 330, 400] * 4:
        words = [f"w{rng.randrange(10**9)}" for _ in range(n)]
        copy = _edited(rng, words, rng.randint(0, 1 + n // 40)) if n >= 5 else words
        around = [f"a{rng.randrange(10**9)}" for _ in range(12)] if n >= 5 else []
        items = decontaminate.prepare_items([(1, " ".join(words)), (2, "another item of some words that stands nowhere")], o)
        hits = decontaminate.search(pa.array(["x", " ".join(around + copy + around[::-1])]), items, o)
        alike = 1.0 if n < 5 else 0.0
        if n >= 5:
            a, b = (Counter(tuple(x[k : k + 5]) for k in range(len(x) - 4)) for x in (words, copy))
            alike = sum((a & b).values()) / sum((a | b).values())
        if alike >= 0.8:
            seen += 1
            assert [(h[0], h[1]) for h in hits] == [(1, 0)] and hits[0][4] >= alike - 1e-9, (n, alike)
    assert seen > 150


def test_items_shorter_than_a_shingle_are_whole_texts():
    o = decontaminate.LeakOptions()
    items = decontaminate.prepare_items([(1, "Yes"), (2, "no way"), (3, "YES")], o)
    hits = decontaminate.search(pa.array(["yes", "oh yes", None, "No  way", "way no", "no way then it goes on and on"]), items, o)
    assert sorted((h[0], h[1]) for h in hits) == [(0, 0), (0, 2), (3, 1)]


def test_index_gives_all_fingerprints_within_the_radius():
    rng = np.random.default_rng(9)
    prints = rng.integers(0, 2**63, 500, dtype=np.uint64)
    prints[250:] = prints[:250]  # equal ones
    found = prints[rng.integers(0, 500, 300)].copy()
    for i in range(300):
        for bit in rng.choice(64, int(rng.integers(0, 6)), replace=False):
            found[i] ^= np.uint64(1 << int(bit))
    index = decontaminate._Index([(int(p), k, 0) for k, p in enumerate(prints)], 3)
    got = {(a, b) for spots, own, _ in index.near(found, step=7) for a, b in zip(spots.tolist(), own.tolist(), strict=True)}
    assert got == {(i, j) for i in range(300) for j in range(500) if int(found[i] ^ prints[j]).bit_count() <= 3}


def test_simhash_windows_and_hamming_blocks():
    words = np.random.default_rng(2).integers(0, 2**63, 300, dtype=np.uint64)
    prints = decontaminate._Fingerprints(words)
    bits = np.unpackbits(words.view(np.uint8).reshape(-1, 8), axis=1).astype(int)
    for size in decontaminate.window_sizes(192):
        want = np.array([np.packbits(bits[i : i + size].sum(0) > size // 2).view("<u8")[0] for i in range(300 - size + 1)])
        assert (prints.of(size) == want).all()
    rng = np.random.default_rng(3)
    for _ in range(200):
        x = int(rng.integers(0, 2**63))
        y = x
        for bit in rng.choice(64, 3, replace=False):
            y ^= 1 << int(bit)
        a, b = (list(decontaminate._blocks(np.array([v], np.uint64), 3)) for v in (x, y))
        assert any(p[0] == q[0] for p, q in zip(a, b, strict=True))


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.op3_quality(spark, sf).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(r.predicted, labels[i]) for i, r in got.items() if r.held_out and i in labels]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 for i, r in got.items())
    assert len(got) == 1000 and np.mean([a == b for a, b in held]) > 0.93


def test_quality_scores_by_plain_compression(spark):
    import zstandard

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = quality_zdict.fit_quality(docs, spark.read.parquet(f"{sf}/labels.parquet").where(queries.id_fold(3) != 1))
    assert model.good and model.bad and model.slope > 0

    def size(data, words):
        plain = lambda: zstandard.ZstdCompressor(level=model.level, dict_data=zstandard.ZstdCompressionDict(words), write_checksum=False, write_content_size=False, write_dict_id=False)
        return sum(len(plain().compress(data[i : i + model.piece_bytes])) for i in range(0, len(data), model.piece_bytes))

    for r in quality_zdict.score_quality(docs, model).collect():
        data = (r.text or "").encode()
        good, bad = size(data, model.good), size(data, model.bad)
        x = (bad - good) / (bad + good) if data else 0.0
        assert r.quality_score == pytest.approx(1 / (1 + np.exp(-(model.slope * x + model.shift))), abs=1e-9)


def test_logistic_curve_is_where_its_gradient_is_none():
    rng = np.random.default_rng(7)
    x = rng.normal(0.02, 0.05, 400)
    y = (rng.random(400) < 1 / (1 + np.exp(-(40 * x - 0.5)))).astype(float)
    slope, shift = quality_zdict._logistic(x, y)
    p = 1 / (1 + np.exp(-(slope * x + shift)))
    assert abs((p - y).sum()) < 0.05 and abs(((p - y) * (x - x.mean()) / x.std()).sum()) < 0.05 and 20 < slope < 60


def test_rows_without_an_id_are_held_out(spark, tmp_path):
    rows = [(None, "no id at all here", "en"), (5, "some words that stand here", "en"), (6, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(5, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    for query in (queries.op3_quality, queries.op7_language_id):
        got = {r.doc_id: r.held_out for r in query(spark, str(tmp_path)).collect()}
        assert got[None] is True and None not in got.values()


def test_quality_edges(spark):
    docs = _docs(spark, EDGES)
    none = quality_zdict.fit_quality(docs, spark.createDataFrame([], "doc_id long, quality int"))
    scored = quality_zdict.score_quality(docs.withColumn("score", F.lit("clash")), none).collect()
    assert len(scored) == len(EDGES) and all(abs(r.quality_score - 0.5) < 1e-6 for r in scored)
    some = spark.createDataFrame([(4, 1), (5, 0), (7, 1), (7, 0), (6, None), (None, 1)], "doc_id long, quality int")
    model = quality_zdict.fit_quality(docs, some)
    scores = [r.quality_score for r in quality_zdict.score_quality(docs, model).collect()]
    assert all(0 <= s <= 1 for s in scores)
    assert quality_zdict.score_quality(docs.limit(0), model).collect() == []
    assert quality_zdict.score_quality(docs, none, keep=0.6).count() == 0


def test_language_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.op7_language_id(spark, sf).collect()}
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    held = [r.lang_pred == langs[i] for i, r in got.items() if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 for i, r in got.items())
    assert len(got) == len(langs) and np.mean(held) > 0.98


def _plain_grams(text, sizes):
    """Counts of the n-grams of letters, a blank at their ends at most."""
    plain = " " + " ".join("".join(c if c.isalpha() else " " for c in (text or "").lower()).split()) + " "
    return Counter(plain[i : i + n] for n in sizes for i in range(len(plain) - n + 1) if " " not in plain[i + 1 : i + n - 1]) if plain.strip() else Counter()


def test_languages_by_plain_sets_of_ngrams(spark):
    sf, o = "/root/testdata/sf0.01", langid.FitOptions()
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    learn = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 and r.lang is not None and r.text]
    counts, chars = defaultdict(Counter), Counter()
    for r in learn:
        counts[r.lang] += _plain_grams(r.text, o.sizes)
        chars[r.lang] += len(r.text)
    share = {x: {g: n / chars[x] for g, n in c.items() if n >= o.least_count} for x, c in counts.items()}
    most = Counter()
    for own in share.values():
        for g, v in own.items():
            most[g] = max(most[g], v)
    known = {x: {g for g, v in own.items() if v >= o.least_share * most[g]} for x, own in share.items()}
    assert all(len(k) <= o.grams_per_language for k in known.values())
    got = {r.doc_id: r for r in queries.op7_language_id(spark, sf).collect()}
    same = near = seen = 0
    for r in rows:
        grams = _plain_grams(r.text, o.sizes)
        total = sum(grams.values())
        if not total:
            assert got[r.doc_id].lang_pred == "und" and got[r.doc_id].score == 0
            continue
        shares = {x: sum(n for g, n in grams.items() if g in k) / total for x, k in known.items()}
        best = max(sorted(shares), key=shares.get)
        seen += 1
        same += got[r.doc_id].lang_pred == best
        near += abs(got[r.doc_id].score - shares[best] / max(1e-12, sum(shares.values()))) < 0.02
    assert seen > 900 and same >= 0.995 * seen and near >= 0.98 * seen


def test_language_edges(spark):
    rows = [(i, "the cat sat on the mat and the dog ran", "en") for i in range(5)] + [(9 + i, "der hund und die katze sind nicht hier", "de") for i in range(5)] + [(30, "x", None)]
    model = langid.fit_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    texts = [None, "", "12 !?", "the dog sat", "die katze und der hund", "zzz qqq", "\U00010400퟿"]
    data = _clash(_docs(spark, list(enumerate(texts))))
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify_languages(data, model).collect()}
    assert [got[i][0] for i in range(5)] == ["und", "und", "und", "en", "de"] and got[5][0] in ("de", "en") and got[5][1] == 0
    empty = langid.fit_languages(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert {r.lang_pred for r in langid.identify_languages(data, empty).collect()} == {"und"}
    assert langid.identify_languages(data.limit(0), model).collect() == []


def test_bloom_slots_hold_every_inserted_gram(spark):
    rows = [(i, f"wort{chr(97 + i % 26)} satz sprache " * 3, "de") for i in range(40)]
    model = langid.fit_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    names, scores = langid.predict_texts(["satz sprache"], model)
    assert names == ["de"] and scores[0] > 0.9 and (model.false_share < 0.2).all()


def _brute_topk(rows, k=10):
    """Every row is a candidate; of a query id with several rows, all pairs of its rows and the others count."""
    sound = [(i, tuple(int(np.floor(1024 * float(x))) for x in v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    size = Counter(len(v) for _, v in sound).most_common(1)[0][0]
    sound = [(i, v) for i, v in sound if len(v) == size]
    out = set()
    for q in {i for i, _ in sound if i % 100 == 0}:
        pairs = [(-sum(x * y for x, y in zip(a, b, strict=True)), i) for j, a in sound if j == q for i, b in sound if i != q]
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(pairs)[:k])}
    return out


def test_topk_equals_its_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    want = {(a, b, c, d) for a, b, c, d in con.execute(queries.ORACLE_SQL["op4_topk"]).fetchall()}
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in queries.op4_topk(spark, sf_dir).collect()} == want


def test_topk_edges(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.integers(-3, 4, 4).astype(float).tolist()) for i in range(300)]  # many ties
    rows += [(i, [1.0, 1.0, 1.0, 1.0]) for i in range(400, 520)] + [(400, [1.0] * 4), (901, None), (902, []), (903, [1.0, None, 1.0, 1.0]), (904, [float("nan")] * 4), (1000, [float("inf")] * 4), (1100, [1.0, 2.0]), (None, [9.0] * 4)]
    data = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"v": F.lit(1), "score": F.lit("x"), "rank": F.lit(0)})
    small = va_topk.TopkOptions(queries_per_block=3, vectors_per_block=20, cells=4)
    for options in (va_topk.TopkOptions(), small):
        got = {tuple(r) for r in va_topk.exact_topk(data, F.col("vec_id") % 100 == 0, options).collect()}
        assert got == _brute_topk(rows)
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in va_topk.exact_topk(few, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 1024 * 2048)]
    assert va_topk.exact_topk(few.limit(0), F.col("vec_id") == 0).collect() == []


PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _plain_spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in re.sub("[^0-9]", "", m[0])]
            doubled = [d * 2 - 9 * (d > 4) if i % 2 else d for i, d in enumerate(reversed(digits))]
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 16 <= len(digits) <= 19 and sum(doubled) % 10 == 0, "phone": 8 <= len(digits) <= 15}[kind]
            out += [(kind, *m.span())] if good else []
    return out


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a@.1 2-+()9é0%", max_size=50))
def test_base_spans_equal_the_plain_patterns(text):
    found = pii_bootstrap.base_spans(text)
    assert [(k, *s) for k in pii_bootstrap.KINDS for s in found[k]] == _plain_spans(text)


def test_pii_on_the_table(spark, sf_dir):
    import hashlib

    got = {r.doc_id: r for r in queries.op9_pii(spark, sf_dir).collect()}
    for i, t in _texts(spark, sf_dir).items():
        spans = _plain_spans(t or "")
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        r = got[i]
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for x, *_ in spans) for k in PLAIN]
        assert set(joined.split(",")) <= set(r.spans.split(","))


def test_patterns_learnt_from_seeds_find_unseen_identifiers(spark):
    rows = [(i, f"hello there, please reach me at user{i}@mail.example.com any time") for i in range(8)]
    rows += [(20, "hello there, please reach me at jane (at) example (dot) org any time"), (21, "we met @ noon"), (22, None), (23, "")]
    got = {r.doc_id: r for r in pii_bootstrap.find_spans(_clash(_docs(spark, rows))).collect()}
    assert got[20].n_email == 0 and got[20].spans == "email:32:59" and got[21].spans == "" and got[22].spans == got[23].spans == ""
    hidden = {r.doc_id: r.text for r in pii_bootstrap.mask(_docs(spark, rows)).collect()}
    assert hidden[20] == "hello there, please reach me at [EMAIL] any time" and hidden[0].count("[EMAIL]") == 1 and hidden[22] is None
    assert pii_bootstrap.find_spans(_docs(spark, [])).collect() == []


def test_word_hashes_split_on_ascii_white_space_only():
    column = pa.array(["A b\x0bc", None, "", "a b c", "C"])
    words, first, _, _ = common.word_hashes(*common.text_bytes(column))
    assert first.tolist() == [0, 3, 3, 3, 5, 6] and words[2] == words[4] == words[5]
    words, first, *_ = common.word_hashes(*common.text_bytes(column.slice(3, 2)))
    assert first.tolist() == [0, 2, 3]
