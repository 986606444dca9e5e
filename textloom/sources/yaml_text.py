"""YAML texts to trees and back, held in memory as plain values alone.

PyYAML makes a node for each scalar before it makes values, and again when it writes; a node takes some twenty times the room of
its text. Here a collection becomes plain values as soon as it is read, and a tree is written part by part. Files with anchors
are taken whole, as parts may be shared. libyaml reads texts without the characters that it takes otherwise than the parser in
Python (tabs, rare breaks, marks); what it refuses is read again by that parser, whose errors are given.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import yaml
from yaml import composer, constructor, nodes, parser, reader, resolver, scanner

#: Characters of texts that both parsers read alike.
_STEADY = re.compile("[\n\r\x20-\x7e\xa0-\u2027\u202a-\ud7ff\ue000-\ufefe\uff00-\ufffd\U00010000-\U0010ffff]*+")
_LINE = re.compile("(\\A|[\n\x85\u2028\u2029])(?=[^\n\x85\u2028\u2029])")
_PLAIN = ("tag:yaml.org,2002:map", "tag:yaml.org,2002:seq")
_MERGE = "tag:yaml.org,2002:merge"
PART = 500  # items of a list that are written together


class _Made(nodes.Node):
    """A collection that is plain values already."""

    __slots__ = ("value", "tag", "start_mark", "end_mark")


class _Early(composer.Composer, constructor.SafeConstructor, resolver.Resolver):
    """Makes the values of a collection when its end is read, unless something else may still look at its nodes."""

    def __init__(self):
        composer.Composer.__init__(self)
        constructor.SafeConstructor.__init__(self)
        resolver.Resolver.__init__(self)
        self.kept = 0  # of open merged values: their nodes are moved
        self.anchored = False
        self.fault: Exception | None = None

    def compose_node(self, parent, index):
        merged = isinstance(index, nodes.ScalarNode) and index.tag == _MERGE
        self.kept += merged
        try:
            node = super().compose_node(parent, index)
        finally:
            self.kept -= merged
        self.anchored = self.anchored or bool(self.anchors)
        inner = parent is not None and parent.tag in _PLAIN
        key = isinstance(parent, nodes.MappingNode) and index is None
        if inner and not (key or merged or self.kept or self.anchored) and isinstance(node, nodes.CollectionNode) and node.tag in _PLAIN:
            try:
                node = _Made(node.tag, self.construct_object(node, deep=True), node.start_mark, node.end_mark)
            except Exception as fault:
                self.fault = self.fault or fault
                node = _Made(node.tag, None, node.start_mark, node.end_mark)
            self.constructed_objects.clear()
        return node

    def get_single_node(self):
        """The root; a value that cannot be made is a fault after those of the text itself."""
        node = super().get_single_node()
        if self.fault:
            raise self.fault
        return node

    def construct_object(self, node, deep=False):
        return node.value if isinstance(node, _Made) else super().construct_object(node, deep)


class _PythonLoader(reader.Reader, scanner.Scanner, parser.Parser, _Early):
    def __init__(self, text):
        reader.Reader.__init__(self, text)
        scanner.Scanner.__init__(self)
        parser.Parser.__init__(self)
        _Early.__init__(self)


_CLoader = None
if yaml.__with_libyaml__:
    from yaml.cyaml import CParser

    class _CLoader(_Early, CParser):
        def __init__(self, text):
            CParser.__init__(self, text)
            _Early.__init__(self)


def _read(kind: type, text: str) -> tuple[object, bool]:
    loader = kind(text)
    try:
        return loader.get_single_data(), loader.anchored
    finally:
        loader.dispose()


def load(text: str) -> tuple[object, bool]:
    """The tree of a text as `yaml.safe_load` gives it, and whether parts of it may be shared."""
    question = "?" in text and ("[" in text or "{" in text)  # in flow collections the parsers differ on it
    if _CLoader and not question and _STEADY.fullmatch(text):
        try:
            return _read(_CLoader, text)
        except yaml.YAMLError:
            pass
    return _read(_PythonLoader, text)


def whole(tree: object) -> str:
    return yaml.safe_dump(tree, allow_unicode=True, sort_keys=False, width=float("inf"))


def dumped(tree: object) -> Iterator[str]:
    """What `yaml.safe_dump` says of a tree without shared parts, in parts."""
    if type(tree) is dict and tree:
        for key, value in tree.items():
            # An empty collection stands behind its key; another one stands in the lines below, a list at the key's own column.
            head = whole({key: []}) if type(value) in (dict, list) and value else ""
            if not head.endswith(": []\n") or head.startswith("? "):
                yield whole({key: value})
                continue
            yield head[: -len(" []\n")] + "\n"
            for part in dumped(value):
                yield part if type(value) is list else _indented(part)
    elif type(tree) is list and tree:
        for i in range(0, len(tree), PART):
            yield whole(tree[i : i + PART])
    else:
        yield whole(tree)


def _indented(part: str) -> str:
    """Lines that are not empty, two columns further in; in quotes the rarer breaks end lines as well."""
    return _LINE.sub(r"\1  ", part)
