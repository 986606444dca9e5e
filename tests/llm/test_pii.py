import math
import random
import string
import time
from collections import defaultdict

from textloom.llm import pii_bootstrap
from textloom.llm.common import Scratch
from textloom.llm.pii_bootstrap import KINDS


def _rows(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_every_good_pattern_is_used_however_many_there_are(spark):
    words = [a + b + c for a in string.ascii_lowercase for b in string.ascii_lowercase for c in string.ascii_lowercase][:5200]
    rows = [(i, ". ".join(f"{w} {w}x write to user{k}{w}@mail.example.com" for k in range(6)) + f". {w} {w}x write to jane{w} (at) example (dot) org") for i, w in enumerate(words)]
    rows = [(i, t.replace(" write to ", f" {words[i]}y ")) for i, t in rows]  # each text has contexts of its own
    found = pii_bootstrap.find_spans(_rows(spark, rows)).collect()
    assert len(found) == len(rows) and all(r.n_email == 6 and len(r.spans.split(",")) == 7 for r in found)


def test_blocks_of_patterns_find_what_one_block_finds(spark):
    rows = [(i, f"write {'abcdefgh'[i % 8]}x to {'stuvwxyz'[i % 8]}q user{i}@mail.example.com now") for i in range(64)]
    rows += [(100 + i, f"write {'abcdefgh'[i]}x to {'stuvwxyz'[i]}q jane (at) example (dot) org now") for i in range(8)] + [(200, None)]
    whole, small = pii_bootstrap.BootstrapOptions(), pii_bootstrap.BootstrapOptions(patterns_per_block=3)
    for ask in (pii_bootstrap.find_spans, pii_bootstrap.mask):
        want, got = (sorted(map(tuple, ask(_rows(spark, rows), o).collect()), key=str) for o in (whole, small))
        assert got == want
    masked = {r.doc_id: r.text for r in pii_bootstrap.mask(_rows(spark, rows), small).collect()}
    assert all("[EMAIL]" in masked[100 + i] and "(at)" not in masked[100 + i] for i in range(8)) and masked[200] is None


TWO_HOPS = [(i, f"please reach me at user{i}@mail.example.com any time") for i in range(60)]
TWO_HOPS += [(100 + i, f"please reach me at jane{i} (at) example (dot) org any time") for i in range(8)]
TWO_HOPS += [(200 + i, f"letters go straight unto jane{i} (at) example (dot) org in spring") for i in range(8)]


def test_contexts_of_discovered_instances_find_more(spark):
    rows = [*TWO_HOPS, (300, "letters go straight unto mary (at) example (dot) org in spring"), (301, "nobody met bob (at) example (dot) org there")]
    got = {r.doc_id: r.spans for r in pii_bootstrap.find_spans(_rows(spark, rows)).collect()}
    assert got[100] and got[200] and got[300].startswith("email:25:") and got[301] == ""


def test_upper_case_marks_are_looked_at(spark):
    rows = [*TWO_HOPS, (300, "please reach me at JANE (AT) HOST (DOT) ORG any time"), (301, "please reach me at Jane [At] Host [Dot] Org any time")]
    got = {r.doc_id: r.spans for r in pii_bootstrap.find_spans(_rows(spark, rows)).collect()}
    assert got[300] == "email:19:43" and got[301] == "email:19:43"


def _brute_patterns(texts, o):
    """The rounds of scoring over plain dictionaries."""
    seed, shaped = defaultdict(bool), defaultdict(bool)
    for text in texts:
        base = pii_bootstrap.base_spans(text)
        spans = [(k, a, b, True) for k in KINDS for a, b in base[k]] + [(*x, False) for x in pii_bootstrap.shaped_spans(text, base)]
        for kind, a, b, is_seed in spans:
            for pattern in pii_bootstrap.contexts(text, a, b):
                edge = kind, pattern, pii_bootstrap._instance(text[a:b])
                seed[edge] |= is_seed
                shaped[edge] |= not is_seed
    belief = {}
    for kind, _, x in seed:
        belief[kind, x] = float(any(seed[e] for e in seed if e[0] == kind and e[2] == x))
    good = {}
    for _ in range(o.rounds):
        members = defaultdict(list)
        for kind, pattern, x in seed:
            members[kind, pattern].append(belief[kind, x])
        good = {}
        for (kind, pattern), told in members.items():
            n, z = len(told), o.deviations
            p = sum(told) / n
            low = (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
            if sum(b > 0 for b in told) >= o.least_seeds and low >= (o.confidence_of_one_word if pattern.endswith(" _ *") else o.confidence):
                good[kind, pattern] = low
        for kind, x in belief:
            own = [e for e in seed if e[0] == kind and e[2] == x]
            if not any(seed[e] for e in own):
                belief[kind, x] = 1 - math.prod(1 - min(0.999, good.get(e[:2], 0.0)) for e in own)
    return {(k, p) for k, p in good if any(shaped[e] for e in seed if e[:2] == (k, p))}


def _planted(rng, n):
    """Texts with one identifier each: (text, kind, start, end, base), kind None where the string is none though shaped alike."""
    made = []
    frames = {"email": ("write to {}", "her address is {} since", "mail: {} for"), "phone": ("call me on {}", "telephone {} or", "ring us under {} before"), "ip": ("server at {}", "host {} answered", "route via {} is"), "card": ("paid with card {}", "card number {} expires", "charge it to {} please")}
    other = ("invoice {} of", "on {} the", "part {} in stock")
    words = [f"w{k}" for k in range(400)]
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))

    def card(valid):
        body = digits(15)
        last = next(c for c in "0123456789" if pii_bootstrap.luhn(body + c))
        return body + (last if valid else str((int(last) + 1) % 10))

    plain = {"email": lambda: f"u{digits(5)}@m{digits(2)}.example.com", "phone": lambda: f"+1 ({digits(3)}) 555-{digits(4)}", "ip": lambda: ".".join(str(rng.randrange(256)) for _ in range(4)), "card": lambda: card(True)}
    hidden = {"email": lambda: f"u{digits(5)} (at) m{digits(2)} (dot) org", "phone": lambda: f"({digits(3)}) 555-{digits(4)}", "ip": lambda: "[.]".join(str(rng.randrange(10, 256)) for _ in range(4)), "card": lambda: card(False)}
    shaped = (lambda: f"{digits(2)}-{digits(2)}-20{digits(2)}", lambda: card(False), lambda: ":".join(f"{rng.randrange(16):x}{digits(1)}" for _ in range(5)))
    for _ in range(n):
        kind = rng.choice(KINDS + (None,))
        base = kind is not None and rng.random() < 0.7
        frame = rng.choice(frames[kind] if kind else other)
        said = (plain[kind] if base else hidden[kind])() if kind else rng.choice(shaped)()
        before = " ".join(rng.sample(words, 8)) + " " + frame[: frame.index("{")]
        made.append((before + said + frame[frame.index("}") + 1 :] + " " + " ".join(rng.sample(words, 5)), kind, len(before), len(before) + len(said), base))
    return made


def test_added_spans_by_brute_force(spark):
    texts = [t for t, *_ in _planted(random.Random(3), 300)] + [t for _, t in TWO_HOPS]
    o = pii_bootstrap.BootstrapOptions()
    patterns = _brute_patterns(texts, o)
    rows = _rows(spark, [*enumerate(texts), (-1, None), (-2, "")])
    assert {tuple(r) for r in pii_bootstrap.learn_patterns(rows, Scratch(spark), o).collect()} == patterns
    by_kind = {k: frozenset(p for kind, p in patterns if kind == k) for k in KINDS}
    got = {r.doc_id: r.spans for r in pii_bootstrap.find_spans(rows).collect()}
    assert all(got[i] == pii_bootstrap._joined(pii_bootstrap.all_spans(t, by_kind)[1]) for i, t in enumerate(texts)) and got[-1] == got[-2] == ""


def test_precision_and_recall_of_added_spans(spark):
    made = _planted(random.Random(4), 3000)
    got = {r.doc_id: set(filter(None, r.spans.split(","))) for r in pii_bootstrap.find_spans(_rows(spark, [(i, t) for i, (t, *_) in enumerate(made)])).collect()}
    hidden = {i: f"{k}:{a}:{b}" for i, (_, k, a, b, base) in enumerate(made) if k and not base}
    base = {i: {f"{k}:{a}:{b}"} if k and is_base else set() for i, (_, k, a, b, is_base) in enumerate(made)}
    added = [(i, s) for i, spans in got.items() for s in spans - base[i]]
    right = sum(hidden.get(i) == s for i, s in added)
    assert right / len(hidden) > 0.98 and right / len(added) > 0.98


def test_spans_of_long_texts_take_linear_time():
    text = " ".join(f"call 555-01{i % 10}{i % 7} or +1 555 010 {i % 9}99 x@y.z" for i in range(30_000))
    began = time.process_time()
    pii_bootstrap.all_spans(text, {k: frozenset(["call _ *", "or _ *"]) for k in KINDS})
    assert time.process_time() - began < 10


def test_long_identifiers_with_equal_starts_are_instances_of_their_own():
    long = "a" * 100
    assert len({pii_bootstrap._instance(long + end) for end in "xyz"}) == 3
