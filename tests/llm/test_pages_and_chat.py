import hashlib
import html
import re
import time
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from textloom.llm import chat_windows, html_extract, queries

PAGES = "page_id long, url string, html string, n_chars string, host string, templates string"


def _page(text, extra=""):
    return f"<html><body><nav>menu</nav><div class='hero'>{extra}</div><div id='content'><p>{text}</p></div></body></html>"


def test_article_text_by_brute_force(spark, sf_dir):
    rows = {r.page_id: r for r in queries.op1_html(spark, sf_dir).collect()}
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    assert len(rows) == len(pages)
    for p in pages:
        found = re.search(r"<article>(.*?)(?:</article>|\Z)", p.html, re.S)
        body = re.sub(r"<[^>]*\Z", "", found[1] if found else "").replace("<br>", " ")
        blocks = [" ".join(html.unescape(re.sub(r"</?b>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        want = "\n".join(x for x in blocks if x)
        assert (rows[p.page_id].text, rows[p.page_id].n_chars, rows[p.page_id].url) == (want, len(want), p.url)


def test_recurring_subtrees_go_and_prose_stays(spark):
    words = "one two three four five six seven eight nine ten".split()
    rows = [(i, f"http://a.example/{i}", _page(f"{w} " * 40 + "end", "Join our club today"), "x", "y", "z") for i, w in enumerate(words)]
    rows += [(99, "http://b.example/1", _page("lone " * 40, "Join our club today"), "x", "y", "z")]
    out = {r.page_id: r.text for r in html_extract.extract_main_text(spark.createDataFrame(rows, PAGES)).collect()}
    assert all("Join" not in out[i] and out[i].startswith(w) for i, w in enumerate(words))
    assert out[99].startswith("Join our club today\nlone")  # once on its host: no template


def test_passage_shared_by_articles_and_copies_of_a_page_stay(spark):
    shared = "<p>" + "licence text " * 20 + "</p>"
    rows = [(i, f"http://a.example/{i}", f"<article><h1>T{i}</h1><p>{'w%d ' % i * 50}</p>{shared}</article>", None, None, None) for i in range(20)]
    rows += [(100 + i, "http://c.example/x", _page("same words " * 30, "short box"), None, None, None) for i in range(20)]
    out = {r.page_id: r.text for r in html_extract.extract_main_text(spark.createDataFrame(rows, PAGES)).collect()}
    assert all("licence text" in out[i] for i in range(20))
    assert all("short box" in out[100 + i] and "same words" in out[100 + i] for i in range(20))


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""),
        ("", ""),
        ("plain &amp; text&nbsp;x", "plain & text x"),
        ("<p>a<br>b <i>c</i>d<p>e<!-- x", "a b cd\ne"),
        ("<main><p>x</main><aside>y</aside>", "x"),
        ("<article>a<section class='comments'>b</section><div class='ad-box'>c</div>d</article>", "a\nd"),
        ("<article><script>if (a<b) '</p>'</script>t<style>p{}</style><form>f</form></article> out", "t"),
        ("<table><tr><td>1<td>2<tr><td>3</table><ul><li>a<li>b</ul>", "1\n2\n3\na\nb"),
        ("<p title='a>b'>x</p><p hidden>y</p>&lt;z&gt; <a href=\"cut", "x\n<z>"),
        ("<div>" * 3000 + "deep", "deep"),
    ],
)
def test_single_pages(page, want):
    assert html_extract.main_text(page, frozenset()) == want


def _neutral(i, variant):
    """A page whose names say nothing: a bar, a box and a foot that its host repeats, around text of its own."""
    bar = "".join(f"<li{' class=x1' if i % 7 == k else ''}>place{variant}{k}</li>" for k in range(7))
    own = [f"p{i}w{k} " * 12 for k in range(3)]
    body = f"<div class='q'><ul>{bar}</ul></div><div class='r'><div><h2>Summary</h2><p>{own[0]}</p><div>see box{variant} too</div><p>{own[1]}</p></div></div><p>{own[2]}</p><div><div>all rights of house{variant}</div></div>"
    return f"<html><body>{body}</body></html>", "\n".join(["Summary", *(o.strip() for o in own)])


def test_counts_alone_find_the_article_where_names_say_nothing(spark):
    made = {i: _neutral(i, i % 2) for i in range(120)}
    rows = [(i, f"http://n{i % 2}.example/{i}", page, None, None, None) for i, (page, _) in made.items()]
    frame = spark.createDataFrame(rows + rows[:3], PAGES)
    for hints, at_once in ((True, 1000), (False, 1000), (False, 3)):  # in the last case templates are joined, not sent
        out = html_extract.extract_main_text(frame, html_extract.TemplateOptions(hints=hints, templates_at_once=at_once)).collect()
        assert len(out) == 123 and all(r.text == made[r.page_id][1] for r in out)
        assert all(r.template_chars > 40 and r.hint_chars == 0 for r in out)


def test_templates_of_a_table_by_brute_force(spark, sf_dir):
    pages = spark.read.parquet(sf_dir.replace("sf0.001", "sf0.01") + "/pages.parquet")
    options = html_extract.TemplateOptions(least_pages=2)
    signs = defaultdict(set)
    cut = {p.page_id: (p.url.split("/")[2], html_extract.parsed(p.html, options)) for p in pages.collect()}
    for host, p in cut.values():
        for h in p.hashes:
            signs[host, h].add(p.sign)
    want = {}
    for i, (host, p) in cut.items():
        want[i] = html_extract.kept_text(p, {h for h in p.hashes if len(signs[host, h]) >= 2})
    got = {r.page_id: (r.text, r.template_chars, r.hint_chars) for r in html_extract.extract_main_text(pages, options).collect()}
    assert got == want and any(t for _, t, _ in got.values())


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<div class='page has-sidebar'><article>text</article><div class='sidebar'>s</div></div>", "text"),
        ("<form><div id=content><p>the whole page stands in a form</p></div></form>", "the whole page stands in a form"),
        ("<article>main story</article><div class='related'><article>card</article></div>", "main story"),
        ("<article class='post'>story<article class='comment'>reply</article></article>", "story"),
        ("<aside><article>no</article></aside><div><p>yes</p></div>", "yes"),
        ("<table><tr><td>a<tr><td>b</table>", "a\nb"),
    ],
)
def test_names_are_hints(page, want):
    assert html_extract.main_text(page, frozenset()) == want


def test_parsing_is_linear_in_depth_and_articles():
    for page in ("<div>" * 40_000 + "deep", "<article>x</article>" * 40_000, "<p><div><b><i>x" * 20_000):
        began = time.process_time()
        html_extract.main_text(page, frozenset())
        assert time.process_time() - began < 10


def test_no_pages(spark):
    assert html_extract.extract_main_text(spark.createDataFrame([], PAGES)).collect() == []


MARK = "<|im_end|><|im_start|>assistant ok"


def _digests(rows):
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in groups.items():
        turns.sort()
        loss = "".join(t for *_, r, t in turns if r == "assistant")
        said = "".join(f"{r}\n{t}\n" for *_, r, t in turns)
        out[conv] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_chat_digests_by_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, 0, "user", MARK), (-1, 1, "assistant", MARK)]
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in queries.op8_chat(spark, sf_dir).collect()}
    assert got == _digests(rows)


def test_windows_keep_system_repeat_history_and_mask_it(spark):
    rows = [(1, 0, "system", "be brief &lt;| & <|x")]
    rows += [(1, i, "user" if i % 2 else "assistant", f"turn{i} " * 20) for i in range(1, 41)]
    rows += [(1, 41, "assistant", "long " * 500), (2, None, None, None), (None, 0, "user", "x"), (3, 0, "a\nb", "dup"), (3, 0, "a\nb", "dup")]
    data = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"no": F.lit("clash"), "at": F.lit(1)})
    options = chat_windows.ChatOptions(budget=256, history=64)
    windows = chat_windows.format_windows(data, options).orderBy("conv_id", "window_no").collect()
    mine = [w for w in windows if w.conv_id == 1]
    assert len(mine) > 5 and all("be brief &amp;lt;| &amp; &lt;|x" in w.formatted for w in mine)
    assert all(w.n_tokens <= 256 for w in mine[:-1]) and mine[-1].n_tokens > 500
    assert any(w.n_repeated > 1 for w in mine[1:]) and mine[0].n_repeated == 0
    targets = [w.formatted[s.start : s.end] for w in mine for s in w.loss_spans]
    assert targets == [t for _, _, r, t in rows[:42] if r == "assistant"]
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat_windows.read_back(chat_windows.format_windows(data, options)).collect()}
    assert got == _digests(rows)
    assert chat_windows.read_back(chat_windows.format_windows(data.limit(0))).collect() == []


def test_chat_equals_its_sql_with_nulls(spark, tmp_path):
    rows = [(1, None, "user", "a"), (1, 0, "assistant", "b"), (1, None, None, None), (1, 2, "assistant", None), (2, 3, "system", "s"), (2, None, "assistant", "x" * 50), (3, 1, None, "&lt;| & <|")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.execute(queries.ORACLE_SQL["op8_chat"])
    names = [c[0] for c in want.description]
    got = queries.op8_chat(spark, str(tmp_path)).select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())


def test_chat_plan_runs_no_python(spark, sf_dir):
    plan = queries.op8_chat(spark, sf_dir)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
