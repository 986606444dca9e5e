"""Tags, line splitting, scans and patching."""

import json
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from textloom.functions import linesplit, markup, text
from textloom.operators import quality
from textloom.plans import adapters


def _one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_tags(spark):
    given = "a[ML:icon icon=enh37 ]b[XENO:wait wait=key x=1 x=2]c[System:Color name=arts_sp ]d[/System:Color] [ML:icon2]"
    tags = _one(spark, markup.extract_tags(F.lit(given)))
    assert [(t.type, t.name) for t in tags] == [("ML", "icon"), ("XENO", "wait"), ("System", "Color"), ("System", "/System:Color")]
    assert all(given[t.position :].startswith(t.full_tag) for t in tags)
    assert tags[0].attributes == {"icon": "enh37"} and tags[1].attributes == {"wait": "key", "x": "2"}
    assert _one(spark, markup.extract_tags(F.lit(""))) == []


@pytest.mark.parametrize(("given", "want"), [("[XENO:wait]Hello[System:End][ML:icon]", "Hello"), ("a  [XENO:n ] b \n\t c", "a b\nc"), ("[ML:icon2]", "[ML:icon2]"), ("", "")])
def test_clean(spark, given, want):
    assert _one(spark, markup.clean_text(F.lit(given))) == want


def test_restore(spark):
    restore = lambda o, t: _one(spark, markup.restore(F.lit(o), F.lit(t)))
    assert restore("[XENO:a ]one two\nthree four[System:End][XENO:a ]", "eins zwei\\ndrei vier") == "eins zwei\ndrei vier[XENO:a ][XENO:a ][System:End]"
    assert restore("Hello", "مرحبا [XENO:fake]") == "مرحبا "
    assert restore("First part[XENO:n ]\nSecond part", "a b c d") == "a\nb c d[XENO:n ]"
    assert restore("x", "y<BR />z\r\nw") == "y\nz\nw"
    assert restore("[ML:icon2]x", "[ML:icon2]y") == "y"


def _plain_balanced(said, n):
    said = re.sub(r"\s{2,}", " ", re.sub(r"\s*\n+\s*", " ", said)).strip()
    words = said.split()
    if n <= 1 or not said:
        return said
    if len(words) <= n:
        return "\n".join(words)
    share = max(1, -(-sum(map(len, words)) // n))
    lines, line = [], ""
    for w in words:
        if len(lines) < n - 1 and line and len(line) + 1 + len(w) > share:
            lines, line = [*lines, line], w
        else:
            line = f"{line} {w}" if line else w
    return "\n".join([*lines, line])


def test_balanced_lines(spark):
    rng = random.Random(1)
    rows = [(" ".join("x" * rng.randint(1, 9) for _ in range(rng.randint(0, 15))), rng.randint(0, 5)) for _ in range(80)]
    for r in spark.createDataFrame(rows, "t string, n int").withColumn("got", text.balanced_lines(F.col("t"), F.col("n"))).collect():
        assert r.got == _plain_balanced(r.t, r.n)


MISMATCH, SHORT, UNEVEN, BROKEN, DRIFT = linesplit.CAUSES


@pytest.mark.parametrize(
    ("original", "translation", "score", "causes"),
    [
        ("one two three\nfour five six", "one two three\nfour five six", 0, []),
        ("one\ntwo", "one two", 36, [MISMATCH]),  # 22 + 14
        ("one\ntwo\nthree", "one two three", 50, [MISMATCH]),  # 22 + 2 * 14
        ("one\ntwo\nthree\nfour", "one two three four", 50, [MISMATCH]),  # 50 at most
        ("one two three four\nfive six seven eight", "a b\nfive six seven eight nine", 34, [SHORT, UNEVEN, DRIFT]),  # 14 + 10 + 10
        ("one two three\nfour five six", "واحد اثنان ثلاثة\nفي البيت هنا", 18, [BROKEN]),
        ("one two three\nfour five six", "واحد اثنان ثلاثة.\nفي البيت هنا", 0, []),  # after the end of a sentence
        ("[XENO:wait a=b ]one two\nthree four", "one two\nthree four[/System:Color]", 0, []),  # tags count as nothing
        ("one line", "one line", 0, []),
        ("a\nb", "", 50, [MISMATCH]),  # 22 + 2 * 14
    ],
)
def test_scores_by_hand(spark, original, translation, score, causes):
    found = _one(spark, linesplit.diagnose(F.lit(original), F.lit(translation)))
    assert (found.score, found.causes) == (score, causes)


@pytest.mark.parametrize(
    ("original", "translation", "proposed"),
    [
        ("aaaa bbbb\ncccc dddd", "one two three four", "one two three\nfour"),  # costs 2, -6 and -12
        ("aaaa aaaa\nbbbb bbbb", "yes. one two three four five", "yes.\none two three four five"),  # the end of a sentence
        ("aaaa\nbbbb", "كلمة في بيت", "كلمة في\nبيت"),  # no line starts with this word
        ("one line", "two\n lines", "two lines"),
        ("a\nb", "oneword", "oneword"),
        ("a\nb", " ", " "),
    ],
)
def test_proposals_by_hand(spark, original, translation, proposed):
    assert _one(spark, linesplit.propose(F.lit(original), F.lit(translation))) == proposed


def test_properties_of_proposals(spark):
    rng = random.Random(7)
    pool = ["و", "في", "كلمة", "word", "longerword", "x", "end.", "«quote", "نعم؟", "(p", "semi;", "هذا", "مرحبا"]

    def text_of(lines):
        return "\n".join(" ".join(rng.choice(pool) for _ in range(rng.randint(1, 9))) for _ in range(lines))

    rows = [(text_of(rng.randint(1, 4)), text_of(rng.randint(1, 4))) for _ in range(300)]
    data = spark.createDataFrame(rows, "o string, t string")
    for r in data.select("o", "t", linesplit.diagnose(F.col("o"), F.col("t")).alias("d"), linesplit.propose(F.col("o"), F.col("t")).alias("p")).collect():
        assert r.p.split() == r.t.split() and 0 <= r.d.score <= 100
        if r.p != r.t:
            lines = r.p.split("\n")
            assert len(lines) <= max(1, len(r.o.split("\n")))
            assert not any(line.split()[0].lstrip("«»\"'(") in linesplit.NO_START for line in lines[1:])


def _game(spark, *texts):
    tree = json.dumps({"lines": [{"text": t} for t in texts]})
    return spark.createDataFrame([(0, tree)], "file_id long, content string")


def test_review_aligns_scans_and_applies(spark):
    original = _game(spark, "[XENO:wait ]Hello", "one two\nthree four", "same", "gone", "日本")
    translated = _game(spark, "مرحبا", "واحد اثنان ثلاثة", "same[ML:icon ]", " ", "x")
    entries = quality.review_entries(original, translated)
    assert [r.path for r in entries.orderBy("seg_no").collect()] == [f"root.lines[{i}].text" for i in (0, 1, 2, 4)]
    issues = {r.path: r for r in quality.review(entries, "symbols").collect()}
    assert {p: r.kind for p, r in issues.items()} == {"root.lines[0].text": "missing-tags", "root.lines[1].text": "line-breaks", "root.lines[2].text": "extra-tags"}
    assert issues["root.lines[0].text"].suggestion == "مرحبا[XENO:wait ]" and issues["root.lines[0].text"].severity == "high"
    assert issues["root.lines[2].text"].suggestion == "same"
    ids = spark.createDataFrame([("root.lines[0].text:missing-tags", None), ("root.lines[1].text:line-breaks", "edited")], "id string, edited string")
    chosen = quality.selected_suggestions(quality.review(entries, "symbols"), ids)
    patched = json.loads(quality.apply_suggestions(translated, chosen).first().output)["lines"]
    assert [x["text"] for x in patched] == ["مرحبا[XENO:wait ]", "edited", "same[ML:icon ]", " ", "x"]
    assert quality.scan_totals(entries, quality.review(entries, "symbols")).first().asDict() == {"scanned": 4, "flagged": 3}


def test_scopes(spark):
    rows = [(0, 0, "a", "k", "o", "x" * 80), (0, 1, "b", "k", "o", "y" * 200), (0, 2, "c", "k", "o", "مرحبا [ML:x ]" + "z" * 80), (0, 3, "d", "k", "o", "😀" * 41)]
    entries = spark.createDataFrame(rows, "file_id long, seg_no int, path string, key string, original string, translation string")
    found = {s: sorted(r.path for r in quality.in_scope(entries, s).collect()) for s in ("all", "short", "long", "with_tags", "no_arabic")}
    assert found == {"all": ["a", "b", "c", "d"], "short": ["a"], "long": ["b"], "with_tags": ["c"], "no_arabic": ["a", "b", "d"]}


def test_line_split_thresholds(spark):
    rows = [(0, 0, "good", "k", "one two three\nfour five six", "one two three four\nfive six"), (0, 1, "bad", "k", "one two three four\nfive six seven eight\nnine ten", "a\nb")]
    entries = spark.createDataFrame(rows, "file_id long, seg_no int, path string, key string, original string, translation string")
    compat = {r.path: r.severity for r in quality.scan_line_split(entries).collect()}
    right = {r.path for r in quality.scan_line_split(entries, compat=False).collect()}
    assert compat.get("good") == "high" and "good" not in right


def test_file_scan(spark):
    entries = spark.createDataFrame([("f", i, None, "one two three four\nfive six seven eight") for i in range(3)], "file string, index int, label string, original string")
    said = spark.createDataFrame([("f", 0, "one\ntwo three four five six seven eight nine ten eleven twelve"), ("f", 1, "one two three four\nfive six seven eight"), ("f", 2, " ")], "file string, index int, text string")
    rows = quality.scan_line_split_files(entries, said).collect()
    assert [(r.key, r.difficulty) for r in rows] == [("f:0", "easy")] and rows[0].proposed.count("\n") == 1


def test_ai_review(spark):
    entries = quality.review_entries(_game(spark, "[XENO:a ]Hi", "Bye"), _game(spark, "[XENO:a ]Salut", "Adieu"))

    def reviewer(batch, glossary):
        return '```json\n{"issues": [{"index": 0, "suggestion": "Bonjour"}, {"index": 1, "suggestion": "Adieu"}, {"index": 9, "suggestion": "x"}, {"index": 1, "suggestion": " "}]}\n```'

    (issue,) = quality.review(entries, "ai", reviewer=reviewer).collect()
    assert (issue.kind, issue.suggestion, issue.severity) == ("ai-enhance", "Bonjour[XENO:a ]", "medium")
    assert quality.review_with(entries, lambda b, g: "no json").collect() == []


def test_report_and_warnings(spark):
    from textloom.operators import rebuild
    from textloom.sources.trees import game_json_segments

    segments = game_json_segments(_game(spark, "[XENO:a ]Hi[ML:b ]", "plain"))
    assert quality.tag_report(segments).first().asDict() == {"file_id": 0, "total": 2, "with_tags": 1, "average_length": 12, "xeno": 1, "system": 0, "ml": 1}
    assert quality.samples(segments, 1).count() == 1
    data = spark.createDataFrame([('{"bdat-bin:x": "[XENO:a]"}',), ('{"a": 1}',), ("{",)], "t string")
    assert [r.w for r in data.select(rebuild.game_warnings(F.col("t")).alias("w")).collect()] == [[], ["no-known-keys", "no-tags"], None]
    lines = rebuild.issue_report(spark.createDataFrame([("a", 'x "y"', None)], "path string, s string, n string"), ["path", "s", "n"]).orderBy("part").collect()
    assert [r.line for r in lines] == ["path,s,n", '"a","x ""y""",""']


def test_format_tags(spark):
    found = _one(spark, text.format_tags(F.lit("{a} $b [c] <d> `e` [b]f[/b]\n")))
    assert found == ["{a}", "$b", "[c]", "[b]", "<d>", "`e`", "[b]f[/b]", "\n"]
    assert _one(spark, text.restore_format_tags(F.lit("x {a}"), F.array(F.lit("{a}"), F.lit("$b")))) == "x {a} $b"
    assert _one(spark, text.split_after_commas(F.lit("a, b،  c\n\n\n\nd "))) == "a,\nb،\nc\n\nd"
    assert _one(spark, text.is_japanese(F.lit("こんにちは"))) and not _one(spark, text.is_japanese(F.lit("Hello")))


def test_pairs_have_every_kind(spark, sf_dir):
    kinds = {r.kind for r in quality.scan_symbols(adapters.text_pairs(spark, sf_dir)).collect()}
    assert kinds == {"missing-tags", "extra-tags", "line-breaks"}


def _random_pairs(n, seed):
    rng = random.Random(seed)
    pool = ["و", "في", "كلمة", "word", "longerword", "x", "end.", "«quote", "نعم؟", "[XENO:wait a=b ]", "(p", "semi;", "هذا", "مرحبا", "«في", "[/System:Color]", "...", "؛"]

    def text_of(lines):
        return "\n".join(" ".join(rng.choice(pool) for _ in range(rng.randint(0, 9))) for _ in range(lines))

    pairs = [(text_of(rng.randint(1, 6)), text_of(rng.randint(1, 6))) for _ in range(n)]
    # More breaks than blanks near them: many breaks want what others have taken.
    pairs += [("\n".join(["ab"] * 40), " ".join(rng.choice(["yes.", "no", "maybe", "it"]) for _ in range(60))) for _ in range(5)]
    return pairs + [("a", ""), ("", "a\nb"), ("a\nb", "  "), ("a b\n\nc d", "x\r\ny"), ("a\nb", "\n\n"), ("a\nb\nc", "x y"), ("", "")]


def test_scores_and_proposals_as_in_sql(spark):
    import duckdb
    import pyarrow as pa

    from textloom.plans.linesplit_queries import proposals_sql, scores_sql

    rows = [(str(i), o, t) for i, (o, t) in enumerate(_random_pairs(300, 5))]
    con = duckdb.connect()
    given = pa.table({n: pa.array(c, pa.string()) for n, c in zip(("path", "original", "translation"), zip(*rows, strict=True), strict=True)})
    con.register("given", given)
    want = con.execute(f"WITH RECURSIVE {scores_sql('given', 'scored')}, {proposals_sql('given', 'better')} SELECT path, score, o, t, causes, proposed FROM scored JOIN better USING (path)").fetchall()
    data = spark.createDataFrame(rows, "path string, original string, translation string")
    found = data.withColumn("d", linesplit.diagnose(F.col("original"), F.col("translation"))).withColumn("p", linesplit.propose(F.col("original"), F.col("translation"))).collect()
    assert len(want) == len(rows)
    known = {p: rest for p, *rest in want}
    for r in found:
        assert [r.d.score, r.d.orig_line_count, r.d.tr_line_count, list(r.d.causes), r.p] == known[r.path], (r.original, r.translation)


def test_twice_the_lines_take_twice_the_time():
    def seconds(lines):
        joined = " ".join(f"word{i % 97} and so. on" for i in range(lines))
        began = time.perf_counter()
        places = linesplit._break_places([10 + i % 7 for i in range(lines)], joined)
        assert len(places) == len(set(places)) == lines - 1
        return time.perf_counter() - began

    seconds(500)
    half, whole = (min(seconds(n) for _ in range(3)) for n in (4000, 8000))
    assert whole <= 2.2 * half + 0.05
