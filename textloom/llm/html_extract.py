"""Main text of web pages (site template removal).

Every page is parsed once. Each block element of its body, menus and footers included, has its subtree hashed (tag, class, id and
text), and Spark counts on how many distinct pages of a host each hash stands. Subtrees that recur are the site's template and are
deleted. Names are the weaker hint: what a host's pages are too few to show is deleted where the element's tag, role, class or id
says that it is a menu, a footer, a form, an advert, a comment and the like, or where it stands outside the page's article. What
is left is returned block by block, with the numbers of characters that either way has deleted.

A page's copies count once for its host. Inside an `article` or `main` element only containers that hold a small part of it are
taken for a template, so a passage that many articles share stays in each of them. A hash recurs at `least_pages` pages, on a host
of any size. Names never delete what holds the article, nor (but for those that HTML itself sets aside) most of a page.

Defined cases: null or empty html gives an empty text; a null url counts as the empty host; a page cut off anywhere is read as
far as it goes (an unfinished tag or comment at its end is dropped); repeated rows give a row each; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, prepare, string_columns

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:"[^"]*+"|'[^']*+'|[^"'>]++)*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>|<[!?/a-zA-Z][^>]*\Z""",
    re.S,
)
_MARKS = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style|itemprop)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_WORD = re.compile(r"[a-z0-9]+")
_BREAK = "\x1e"  # between blocks; in a text it is white space, so none is lost

# Element names by their part in HTML.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table "
    "tbody td tfoot th thead tr ul".split()
)
_UNSEEN = frozenset("head script style noscript template iframe textarea title select datalist svg math canvas object embed applet audio video map xmp noembed noframes button input".split())
_ASIDE = frozenset("nav footer aside menu dialog search".split())
_INLINE = frozenset("a abbr b bdi bdo big cite code em font i kbd mark nobr s small span strike strong sub sup tt u".split())
# Words of class and id names, and roles, that mark what is not the article.
_OTHER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr "
    "notice notices popup modal overlay newsletter subscribe subscription signup login sidebar side rail menu nav navbar navigation "
    "breadcrumb breadcrumbs footer masthead comment comments commentlist reply replies respond disqus share sharing social related "
    "recommended recommendations teaser widget toolbar pagination pager paging copyright disclaimer skip search".split()
)
_OTHER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_CLOSES_LIKE = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select", "datalist"})}
_CONTAINERS = frozenset("div section ul ol dl details table figure header address aside nav footer form menu".split())
_KEPT_LEAVES = frozenset("h1 h2 h3 h4 h5 h6 td th caption tr dt dd".split())  # too small to tell anything by themselves
_CROSSED = frozenset("table tr tbody thead tfoot article main body html div".split())  # an end tag that closes over a cell
_CELL = frozenset({"td", "th", "table"})
_NO_P = frozenset({"button", "td", "th", "object"})
_OWN_TEXT = frozenset("option optgroup legend caption summary figcaption".split())


@dataclass(frozen=True)
class TemplateOptions:
    least_pages: int = 5  # distinct pages of the host
    most_of_article: float = 0.3  # a larger part of an article is never a template
    most_of_page: float = 0.5  # nor is a larger part of a page without an article
    templates_at_once: int = 4_000_000  # sent to the tasks, 32 MB; more are joined
    hints: bool = True  # whether names delete what the counts do not


class _Node:
    __slots__ = ("tag", "start", "end", "hash", "kind", "parts", "chars", "root", "in_root", "in_aside", "in_other", "unseen")

    def __init__(self, tag: str, start: int, parent: _Node | None):
        self.tag, self.start, self.end, self.hash, self.parts, self.chars = tag, start, start, 0, [tag], 0
        self.kind = 0  # 1: its names say that it is not the article; 2: its tag does
        self.root = False
        self.in_root = bool(parent and (parent.in_root or parent.root))
        self.in_aside = bool(parent and (parent.in_aside or parent.kind == 2))
        self.in_other = bool(parent and (parent.in_other or parent.kind == 1))
        self.unseen = bool(parent and parent.unseen)


def _mark(node: _Node, marks: dict[str, str]) -> None:
    """Note what an element's tag and attributes say of it."""
    tag = node.tag
    hidden = tag not in ("html", "body") and ("hidden" in marks or marks.get("aria-hidden", "") == "true" or re.search(r"display\s*:\s*none", marks.get("style", "")))
    node.unseen = node.unseen or tag in _UNSEEN or bool(hidden)
    if tag in _ASIDE:
        node.kind = 2
    elif tag not in ("html", "body", "main"):
        other = any(w in _OTHER_WORDS for name in ("class", "id") if name in marks for w in _WORD.findall(marks[name]))
        node.kind = int(other or tag == "form" or (tag == "header" and not node.in_root) or marks.get("role", "") in _OTHER_ROLES)
    node.root = (tag in ("article", "main") or marks.get("role") == "main" or marks.get("itemprop") == "articlebody") and not node.unseen and not node.in_aside and node.kind < 2
    node.parts += [marks.get("class", ""), marks.get("id", "")]


class _Open:
    """The open elements, with the places of each tag, so that the nearest one is found without a walk."""

    def __init__(self):
        self.nodes: list[_Node] = [_Node("", 0, None)]
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def push(self, node: _Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.nodes))
        if node.tag in _BLOCK:
            self.blocks.append(len(self.nodes))
        self.nodes.append(node)

    def pop(self) -> _Node:
        node = self.nodes.pop()
        self.places[node.tag].pop()
        if node.tag in _BLOCK:
            self.blocks.pop()
        return node

    def last(self, tags) -> int:
        return max((at[-1] for t in tags if (at := self.places.get(t))), default=0)

    def within(self, tags, limit: int) -> int:
        """The outermost open element of these tags above a place of the stack; 0 if there is none."""
        found = [at[i] for t in tags if (at := self.places.get(t)) and (i := bisect_right(at, limit)) < len(at)]
        return min(found, default=0)


def parse(page: str) -> tuple[list[str], list[_Node]]:
    """Visible text of a page in order, with breaks where a block begins or ends, and its closed elements with their runs."""
    items: list[str] = []
    nodes: list[_Node] = []
    stack = _Open()

    def text(raw: str) -> None:
        top = stack.nodes[-1]
        if raw and not top.unseen:
            said = (entities.unescape(raw) if "&" in raw else raw).replace(_BREAK, " ")
            items.append(said)
            words = " ".join(said.split())
            top.parts.append(words)
            top.chars += len(words)

    def close(depth: int) -> None:
        while len(stack.nodes) > depth:
            node = stack.pop()
            node.end = len(items)
            above = stack.nodes[-1]
            if node.tag in _BLOCK:
                items.append(_BREAK)
            if not node.unseen:
                if node.tag in _BLOCK or node.kind or node.root:
                    node.hash = xxhash.xxh3_64_intdigest("\x00".join(node.parts).encode("utf-8", "replace")) - (1 << 63)
                    above.parts.append(f"{node.hash}")
                    nodes.append(node)
                else:
                    above.parts += node.parts
                above.chars += node.chars
            node.parts = None

    at, size = 0, len(page)
    while at < size:
        found = _TOKEN.search(page, at)
        if not found:
            text(page[at:])
            break
        text(page[at : found.start()])
        at = found.end()
        name = found[2] or found[5]
        if not name:
            continue
        tag, ending = name.lower(), found[1] or found[4]
        if ending:
            i = stack.last((tag,))
            if tag == "br":
                text(" ")
            elif i and tag in _INLINE:
                i = i if not stack.blocks or i > stack.blocks[-1] else 0
            elif i and tag not in _CROSSED:
                i = i if i > stack.last(_NO_P if tag == "p" else _CELL - {tag}) else 0
            if tag == "p" and not i:
                items.append(_BREAK)
            elif tag != "br" and i:
                close(i)
            continue
        if tag in _BLOCK:
            if tag not in _OWN_TEXT and (i := stack.last(("p",))) > stack.last(_NO_P):
                close(i)
            if tag in _CLOSES_LIKE and (i := stack.within(_CLOSES_LIKE[tag][0], stack.last(_CLOSES_LIKE[tag][1]))):
                close(i)
            items.append(_BREAK)
        if tag in _VOID:
            if tag == "br":
                text(" ")
            continue
        rest = found[3] if found[2] else found[6]
        marks = {m[1].lower(): (m[2] or "").strip("\"'").lower() for m in _MARKS.finditer(rest)} if "=" in rest or "hidden" in rest else {}
        node = _Node(tag, len(items), stack.nodes[-1])
        _mark(node, marks)
        stack.push(node)
        if tag in _RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            close(len(stack.nodes) - 1)
            at = end.end() if end else size
        elif rest.endswith("/") and tag in ("svg", "math", "path"):
            close(len(stack.nodes) - 1)
    close(1)
    return items, nodes


def _outermost(nodes: list[_Node]) -> list[_Node]:
    out: list[_Node] = []
    for n in sorted(nodes, key=lambda n: (n.start, -n.end)):
        if not out or n.start >= out[-1].end:
            out.append(n)
    return out


def _roots(nodes: list[_Node]) -> list[_Node]:
    """The elements that hold the page's articles: the outermost article elements, else main; none where nothing is marked."""
    usable = [n for n in nodes if n.root and n.chars]
    plain = [n for n in usable if not n.kind and not n.in_other]
    for choice in ([n for n in plain if n.tag == "article"], plain, [n for n in usable if n.tag == "article"], usable):
        if choice:
            return _outermost(choice)
    return []


def _holds(node: _Node, roots: list[_Node], starts: list[int]) -> bool:
    i = bisect_left(starts, node.start)
    return i < len(roots) and roots[i].end <= node.end


def _covered(ranges: list[tuple[int, int]], size: int) -> list[int]:
    """How many of the ranges each place lies in."""
    steps = [0] * (size + 1)
    for a, b in ranges:
        steps[a] += 1
        steps[b] -= 1
    return list(accumulate(steps))


@dataclass
class Parsed:
    """A page cut where an element begins or ends that may be deleted; `hashes` may be keys of any kind."""

    segments: list[str]
    hinted: list[bool]  # by segment: names, or its place outside the article, say that it goes
    hashes: list[int]  # of elements that are deleted where they recur
    starts: list[int]  # their first segments
    ends: list[int]
    sign: int  # equal for copies of a page


def parsed(page: str | None, options: TemplateOptions = TemplateOptions()) -> Parsed:
    o = options
    items, nodes = parse(page or "")
    size = len(items)
    roots = _roots(nodes)
    inside = _covered([(n.start, n.end) for n in roots], size)
    whole = sum(n.chars for n in roots) or sum(len(" ".join(x.split())) for x in items)
    most = (o.most_of_article if roots else o.most_of_page) * whole
    root_starts = [n.start for n in roots]
    removable, others = [], []
    for n in nodes:
        if not n.chars or _holds(n, roots, root_starts):
            continue
        here = n.start < size and inside[n.start] > 0
        if n.kind == 2 or (n.kind == 1 and (roots or n.chars <= most)):
            others.append((n.start, n.end))
        if n.tag in ("html", "body") or n.tag not in _BLOCK:
            continue
        if roots and not here or n.chars <= most and (n.tag in _CONTAINERS if here else n.tag not in _KEPT_LEAVES):
            removable.append(n)
    hint = _covered(others, size)
    cuts = sorted({0, size, *(x for n in removable for x in (n.start, n.end)), *(x for r in others for x in r), *(x for n in roots for x in (n.start, n.end))})
    at = {x: k for k, x in enumerate(cuts)}
    segments = ["".join(items[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
    hinted = [hint[a] > 0 or (bool(roots) and not inside[a]) for a in cuts[:-1]]
    told = inside if roots else _covered([(n.start, n.end) for n in nodes if n.tag == "p"], size)
    prose = [items[i] for i in range(size) if told[i] and (roots or not hint[i])]
    sign = xxhash.xxh3_64_intdigest((" ".join("".join(prose).split()) or page or "").encode("utf-8", "replace")) - (1 << 63)
    return Parsed(segments, hinted, [n.hash for n in removable], [at[n.start] for n in removable], [at[n.end] for n in removable], sign)


def kept_text(page: Parsed, templates: frozenset[int] | set[int], hints: bool = True) -> tuple[str, int, int]:
    """What stays of a page, and how many visible characters its templates and (beyond them) the hints delete."""
    ranges = [(a, b) for h, a, b in zip(page.hashes, page.starts, page.ends, strict=True) if h in templates] if templates else []
    gone = _covered(ranges, len(page.segments))
    kept, by_template, by_hint = [], 0, 0
    for k, said in enumerate(page.segments):
        if not gone[k] and not (hints and page.hinted[k]):
            kept.append(said)
            continue
        size = len(" ".join(said.split()))
        by_template, by_hint = (by_template + size, by_hint) if gone[k] else (by_template, by_hint + size)
        kept.append(_BREAK)
    blocks = (" ".join(b.split()) for b in "".join(kept).split(_BREAK))
    return "\n".join(b for b in blocks if b), by_template, by_hint


def main_text(page: str | None, templates: frozenset[int] | set[int], options: TemplateOptions = TemplateOptions()) -> str:
    return kept_text(parsed(page, options), templates, options.hints)[0]


_PARSED = "page_id long, url string, sign long, segments array<string>, hinted array<boolean>, keys array<long>, starts array<int>, ends array<int>"
_LISTS = (("segments", pa.list_(pa.string())), ("hinted", pa.list_(pa.bool_())), ("keys", pa.list_(pa.int64())), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())))


def _key(host: str, subtree: int) -> int:
    """A subtree's hash within its host."""
    return xxhash.xxh3_64_intdigest(f"{subtree} {host}") - (1 << 63)


def parse_pages(rows: DataFrame, options: TemplateOptions = TemplateOptions()) -> DataFrame:
    """Parsed pages of (page_id, url, host, html); each key stands for a subtree of a host."""
    o = options

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [parsed(x, o) for x in batch.column(3).to_pylist()]
            keys = [[_key(host, h) for h in p.hashes] for host, p in zip(batch.column(2).to_pylist(), found, strict=True)]
            columns = ([p.segments for p in found], [p.hinted for p in found], keys, [p.starts for p in found], [p.ends for p in found])
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([p.sign for p in found], pa.int64()), *(pa.array(c, kind) for c, (_, kind) in zip(columns, _LISTS, strict=True))], names=["page_id", "url", "sign", *(name for name, _ in _LISTS)])

    return rows.select("page_id", "url", "host", "html").mapInArrow(read, _PARSED)


def recurring_subtrees(cut: DataFrame, options: TemplateOptions = TemplateOptions()) -> DataFrame:
    """(key) of the subtrees that stand on many distinct pages of their host, from parsed pages (sign, keys)."""
    seen = cut.select("sign", F.explode("keys").alias("key")).distinct()
    return seen.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= options.least_pages).select("key")


_SALTS = 16  # parts of a template that very many pages hold, where it is joined with them


def _with_found(cut: DataFrame, templates: DataFrame, scratch: Scratch) -> DataFrame:
    """`cut` with `found`, the keys that are templates, by joins alone: no host's list is gathered, no table sent to all tasks."""
    mine = cut.select("row", F.explode(F.array_distinct("keys")).alias("key")).withColumn("salt", F.pmod("row", F.lit(_SALTS)))
    spread = templates.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(_SALTS - 1).cast("long"))))
    hits = mine.join(spread, ["key", "salt"]).groupBy("row").agg(F.collect_set("key").alias("found"))
    return cut.join(scratch.write(hits, "hits"), "row", "left")


def extract_main_text(pages: DataFrame, options: TemplateOptions = TemplateOptions()) -> DataFrame:
    """(page_id, url, text, n_chars, template_chars, hint_chars) of every row of (page_id, url, html)."""
    o, scratch = options, Scratch(prepare(pages.sparkSession))
    rows = string_columns(pages, "page_id", "url", "html")
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    cut = scratch.write(parse_pages(rows.withColumn("host", host), o).withColumn("row", F.monotonically_increasing_id()), "pages")
    templates = scratch.write(recurring_subtrees(cut, o), "templates")
    # Eight bytes stand for a template. As many as one array may hold go to the tasks; beyond that, pages and templates are joined.
    if templates.count() <= o.templates_at_once:
        known = np.sort(templates.toPandas()["key"].to_numpy(np.int64))
        joined = cut.withColumn("found", F.lit(None).cast("array<long>"))
    else:
        known = np.zeros(0, np.int64)
        joined = _with_found(cut, templates, scratch)
    shared = cut.sparkSession.sparkContext.broadcast(known)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for *row, found in zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True):
                keys = np.array(row[2], np.int64)
                at = np.minimum(np.searchsorted(shared.value, keys), max(0, len(shared.value) - 1))
                recurring = set(keys[shared.value[at] == keys].tolist()) if len(shared.value) else set(found or ())
                made.append(kept_text(Parsed(*row, 0), recurring, o.hints))
            texts = [t for t, _, _ in made]
            numbers = [[len(t) for t in texts], [m[1] for m in made], [m[2] for m in made]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string()), *(pa.array(n, pa.int64()) for n in numbers)], names=["page_id", "url", "text", "n_chars", "template_chars", "hint_chars"])

    joined = joined.select("page_id", "url", "segments", "hinted", "keys", "starts", "ends", "found")
    return joined.mapInArrow(keep, "page_id long, url string, text string, n_chars long, template_chars long, hint_chars long")
