"""Tree-shaped formats (JSON, YAML, HTML) as segment rows.

Parsing a tree is the one step that built-in expressions do not do with its order and number forms kept; a small helper in
Arrow batches flattens each file, and everything after it is DataFrame work again.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import markup
from ..functions.text import JAPANESE
from ..jsstr import WHITE, WHITE_CLASS, trim
from ..schema import ERROR
from ..session import dealt, small_batches

# Keys whose values are technical, compared in lower case.
TECHNICAL_KEYS = frozenset(
    "id uuid guid hash version timestamp createdat updatedat url href src icon image thumbnail color hex rgb rgba opacity alpha width "
    "height x y z min max step scale duration delay fps bitrate encoding compression resolution channel channels format mime filepath "
    "filename extension tagid objectid ref $ref _id".split()
)
# Technical keys of game texts. Two are not in lower case and so never match; they are kept as they are.
GAME_KEYS = frozenset(
    "bdat-bin bdat_common_ms bdat_menu_mes_ms bdat_trial_ms caption_ms script_msg_ms pc_arts_ms trial_main_ms vs20200100_ms vs20540100_ms "
    "vs20560100_ms MNU_sysmes_ms MNU_buff_ms 0301e3_ms 0301e4_ms 0301e5_ms".split()
)
MAX_DEPTH = 10
# Elements whose text is not translated.
SKIPPED_ELEMENTS = frozenset("script style noscript code pre kbd samp var".split())

_LEAF = "file_id long, seg_no int, path string, text string, depth int, error boolean"


def entries(tree: dict) -> list[tuple[str, object]]:
    """Keys in the order of the format's own objects: array indexes first, ascending, then by insertion."""
    index = {k for k in tree if k.isdigit() and (k == "0" or k[0] != "0") and int(k) < 2**32 - 1}
    return [(k, tree[k]) for k in (*sorted(index, key=int), *(k for k in tree if k not in index))] if index else list(tree.items())


def most_nodes(content: str) -> int:
    """How many nodes a file may have: a node needs a character, unless aliases repeat it."""
    return 10 * len(content) + 10_000


def leaves(tree: object, path: str, excluded: frozenset[str], limit: int | None, most: int | None = None) -> Iterator[tuple[str, str, int]]:
    """Paths, values and depths of the strings of a tree, in order; a stack stands for the depth, so that any depth is read.

    A tree of more than `most` nodes is an error: aliases of aliases make a small file endless.
    """
    todo: list[tuple[object, str, int]] = [(tree, path, 0)]
    seen = 0
    while todo:
        here, at, depth = todo.pop()
        seen += 1
        if most is not None and seen + len(todo) > most:
            raise ValueError(f"aliases repeat more than {most} nodes")
        if limit is not None and depth > limit:
            continue
        if isinstance(here, str):
            yield at, here, depth
        elif isinstance(here, list):
            todo += [(item, f"{at}[{i}]", depth + 1) for i, item in reversed(list(enumerate(here)))]
        elif isinstance(here, dict):
            known = entries({str(k): v for k, v in here.items()})
            todo += [(item, f"{at}.{key}" if at else key, depth + 1) for key, item in reversed(known) if key.lower() not in excluded]


def load(text: str, kind: str) -> object:
    return load_shared(text, kind)[0]


def load_shared(text: str, kind: str) -> tuple[object, bool]:
    """The tree of a file, and whether parts of it may be shared."""
    if kind == "yaml":
        from . import yaml_text

        return yaml_text.load(text)
    return json.loads(text), False


#: Leaves that a worker holds as rows; a file may have any number.
HELD = 20_000


def own_tasks(files: DataFrame, kind: str) -> DataFrame:
    """YAML files over a fixed number of tasks: reading them costs far more than their bytes say, by which tasks are merged."""
    return files.repartition(dealt(files.sparkSession), "file_id") if kind == "yaml" else files


def tree_leaves(files: DataFrame, kind: str, root: str, excluded: frozenset[str], limit: int | None, strict: bool = False) -> DataFrame:
    """(file_id, seg_no, path, text, depth, error) of all strings.

    A file that does not parse (null, empty, broken, nested too deep for the parser, or endless by aliases) gives one row, whose
    text says why and whose error is true; with `strict` the job fails.
    """

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["file_id", "seg_no", "path", "text", "depth", "error"])

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for file_id, content in zip(batch["file_id"], batch["content"], strict=True):
                try:
                    tree, most = load(content or "", kind), most_nodes(content or "")
                    walk = leaves(tree, root, excluded, limit, most)
                    found = list(islice(walk, HELD))
                    if len(found) == HELD:  # gone through to the end before its first row goes out, then again
                        for _ in walk:
                            pass
                        found = leaves(tree, root, excluded, limit, most)
                except Exception as error:
                    if strict:
                        raise ValueError(f"file {file_id} is no valid {kind}: {error}") from error
                    out.append((file_id, 0, None, f"no valid {kind}: {error}", 0, True))
                    continue
                for i, leaf in enumerate(found):
                    out.append((file_id, i, *leaf, False))
                    if len(out) >= HELD:
                        yield frame(out)
                        out = []
            yield frame(out)

    small_batches(files.sparkSession)
    return own_tasks(files.select("file_id", "content"), kind).mapInPandas(read, _LEAF)


def _as_segments(rows: DataFrame, attrs=None) -> DataFrame:
    empty = F.expr("cast(map() as map<string,string>)")
    kind = F.when(F.col("error"), ERROR).otherwise("leaf")
    return rows.select("file_id", "seg_no", kind.alias("kind"), "path", "text", (~F.col("error")).alias("translatable"), (empty if attrs is None else attrs).alias("attrs"))


def json_segments(files: DataFrame, exclude: tuple[str, ...] = (), strict: bool = False) -> DataFrame:
    """Strings that are not blank and not digits alone, without technical keys, to a depth of 10."""
    rows = tree_leaves(files, "json", "root", TECHNICAL_KEYS | frozenset(exclude), MAX_DEPTH, strict)
    return _as_segments(rows.where(F.col("error") | ((trim(F.col("text")) != "") & ~F.col("text").rlike(r"\A[0-9]+\z"))))


def json_all_segments(files: DataFrame, strict: bool = False) -> DataFrame:
    """All strings that are not blank, whatever their key; paths start at the top-level key."""
    return _as_segments(tree_leaves(files, "json", "", frozenset(), None, strict).where(F.col("error") | (trim(F.col("text")) != "")))


def json_depths(files: DataFrame) -> DataFrame:
    """(file_id, depth): how deep the containers of each file are nested; null where it does not parse."""

    def depth(content: str | None) -> int | None:
        try:
            todo, deepest = [(json.loads(content or ""), 0)], 0
        except (ValueError, RecursionError):
            return None
        while todo:
            here, at = todo.pop()
            deepest = max(deepest, at)
            items = here.values() if isinstance(here, dict) else here if isinstance(here, list) else ()
            todo += [(x, at + 1) for x in items]
        return deepest

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"file_id": batch["file_id"], "depth": pd.array([depth(c) for c in batch["content"]], dtype="Int32")})

    small_batches(files.sparkSession)
    return files.select("file_id", "content").mapInPandas(read, "file_id long, depth int")


def game_json_segments(files: DataFrame, exclude: tuple[str, ...] = (), exclude_japanese: bool = True, strict: bool = False) -> DataFrame:
    """Game texts: `text` is clean; the original with its tags is in `attrs`."""
    rows = tree_leaves(files, "json", "root", GAME_KEYS | frozenset(exclude), MAX_DEPTH, strict)
    wanted = (trim(F.col("text")) != "") & ~F.col("text").rlike(rf"\A[0-9{WHITE_CLASS}\[\]]*\z")
    if exclude_japanese:
        wanted = wanted & ~F.col("text").rlike(JAPANESE)
    rows = rows.where(F.col("error") | wanted).withColumn("original", F.col("text"))
    rows = rows.withColumn("text", F.when(F.col("error"), F.col("text")).otherwise(markup.clean_text(F.col("text")))).where("text <> ''")
    tags = F.size(markup.tag_texts(F.col("original")))
    return _as_segments(rows, F.create_map(F.lit("original"), F.col("original"), F.lit("tags"), tags.cast("string")))


def yaml_segments(files: DataFrame, strict: bool = False) -> DataFrame:
    """All strings that are not blank; keys are not excluded and depth has no limit."""
    return _as_segments(tree_leaves(files, "yaml", "", frozenset(), None, strict).where(F.col("error") | (trim(F.col("text")) != "")))


_TAG = r"</?([a-zA-Z][a-zA-Z0-9-]*)[^>]*>"
_COMMENT, _DECLARATION = r"|<!--[\s\S]*?-->", r"|<[!?][^>]*>"


def _tags(content: str, clean: bool) -> Iterator[re.Match]:
    """Tags and comments in order, in linear time.

    Behind the last end of a comment no comment can be closed, and behind the last `>` no tag: there none is looked for, so that
    no open one is read to the end again and again.
    """
    comments, tags = content.rfind("-->") + 3, content.rfind(">") + 1
    at = 0
    for pattern, end in ((_TAG + _COMMENT, comments if comments > 2 else 0), (_TAG, tags)):
        for m in re.compile(pattern + (_DECLARATION if clean else "")).finditer(content, at, max(at, end)):
            yield m
            at = m.end()
        at = max(at, end)


def html_tokens(content: str, clean: bool = False) -> Iterator[tuple[int, int, str, bool]]:
    """(start, end, kind, translatable) of tags and the text between them, in order.

    `clean` takes declarations for tags; by default they are text, as the format's plain tag pattern has it.
    """
    at, stack = 0, []

    def text(end: int) -> Iterator[tuple[int, int, str, bool]]:
        if end > at:
            yield at, end, "text", not stack and content[at:end].strip(WHITE) != ""

    for m in _tags(content, clean):
        yield from text(m.start())
        yield m.start(), m.end(), "tag", False
        at, name = m.end(), (m[1] or "").lower()
        if name in SKIPPED_ELEMENTS:
            if m[0].startswith("</"):
                if stack and stack[-1] == name:
                    stack.pop()
            elif not m[0].endswith("/>"):
                stack.append(name)
    yield from text(len(content))


def html_segments(files: DataFrame, clean: bool = False) -> DataFrame:
    """Tags and texts in order; the texts outside skipped elements are translated. Entities stay as they are."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for file_id, content in zip(batch["file_id"], batch["content"], strict=True):
                content = content or ""
                out += [(file_id, i, kind, content[a:b], good, a, b) for i, (a, b, kind, good) in enumerate(html_tokens(content, clean))]
            yield pd.DataFrame(out, columns=["file_id", "seg_no", "kind", "text", "translatable", "start", "end"])

    small_batches(files.sparkSession)
    rows = files.select("file_id", "content").mapInPandas(read, "file_id long, seg_no int, kind string, text string, translatable boolean, start int, end int")
    attrs = F.create_map(F.lit("start"), F.col("start").cast("string"), F.lit("end"), F.col("end").cast("string"))
    return rows.select("file_id", "seg_no", "kind", F.lit(None).cast("string").alias("path"), "text", "translatable", attrs.alias("attrs"))
