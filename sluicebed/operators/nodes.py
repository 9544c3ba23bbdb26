"""YAML and JSON documents as trees, made from parser events without recursion.

Content is untrusted: a document that doesn't parse, or is nested deeper than MAX_DEPTH, has no tree; the others of its object
keep theirs. Only objects that spell one of GATES are parsed, once for all helpers of a pass, and a node knows its byte range.
leaves() gives a document as rows (path, value, place), so that rules about it can be joins and filters in Spark.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

MAX_DEPTH = 100
#: What a document must spell to be parsed: the kinds that are read, as a value, or the name of a setting.
GATES = re.compile(rb"kind[\"']?[ \t]*:\s{0,64}[\"']?(?:Secret|Config|(?:ClusterImage|Cluster)?Policy)|pagerduty_configs")
_START = re.compile(rb"(?m)^(?=---)")


class Node:
    """id: scalar, mapping (value: pairs of nodes) or sequence (value: nodes); start and end: places in bytes."""

    __slots__ = ("end", "id", "start", "value")

    def __init__(self, id_: str, value: object, start: int, end: int = 0) -> None:
        self.id, self.value, self.start, self.end = id_, value, start, end


def compose(text: str) -> Node | None:
    """The first document's root, with places in characters. ValueError if it doesn't parse or is nested too deeply."""
    import yaml

    root: Node | None = None
    open_: list[tuple[Node, list]] = []  # the collections around a place, and what each holds so far
    named: dict[str, Node] = {}

    def placed(node: Node) -> None:
        nonlocal root
        if open_:
            open_[-1][1].append(node)
        elif root is None:
            root = node

    try:
        for e in yaml.parse(text, Loader=getattr(yaml, "CSafeLoader", yaml.SafeLoader)):
            if isinstance(e, yaml.ScalarEvent):
                node = Node("scalar", e.value, e.start_mark.index, e.end_mark.index)
                placed(node)
            elif isinstance(e, yaml.AliasEvent):
                node = named.get(e.anchor)
                placed(node if node and node.end else Node("scalar", "", e.start_mark.index, e.end_mark.index))
                continue
            elif isinstance(e, yaml.CollectionStartEvent):
                node = Node("mapping" if isinstance(e, yaml.MappingStartEvent) else "sequence", [], e.start_mark.index)
                placed(node)
                open_.append((node, []))
                if len(open_) > MAX_DEPTH:
                    raise ValueError("nested too deeply")
            elif isinstance(e, yaml.CollectionEndEvent):
                node, held = open_.pop()
                node.end = e.end_mark.index
                node.value = list(zip(held[::2], held[1::2], strict=False)) if node.id == "mapping" else held
                continue
            elif isinstance(e, yaml.DocumentEndEvent):
                break
            else:
                continue
            if e.anchor:
                named[e.anchor] = node
    except yaml.YAMLError as wrong:
        raise ValueError("doesn't parse") from wrong
    return root


@lru_cache(maxsize=2)
def documents(content: bytes) -> tuple[tuple[int, bytes, Node, np.ndarray], ...]:
    """(byte offset, its bytes, root, byte offset of each character) of each document that spells one of GATES and parses."""
    out, at = [], 0
    for part in _START.split(content) if GATES.search(content) else ():
        if GATES.search(part):
            try:
                text = part.decode("utf-8")
                root = compose(re.sub(r"\A---[^\n]*", lambda m: " " * len(m[0]), text))
            except ValueError:  # of which UnicodeDecodeError is one
                root = None
            if root is not None:
                points = np.frombuffer(text.encode("utf-32-le"), "<u4")
                out.append((at, part, root, np.concatenate([[0], np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF))])))
        at += len(part)
    return tuple(out)


def child(node: Node | None, key: str) -> Node | None:
    if node is not None and node.id == "mapping":
        for k, v in node.value:
            if k.value == key:
                return v
    return None


def scalar(node: Node | None) -> str:
    return node.value if node is not None and node.id == "scalar" else ""


def items(node: Node | None, id_: str = "sequence") -> list:
    return node.value if node is not None and node.id == id_ else []


def _step(name: str) -> str:
    return "/" + name.replace("~", "~0").replace("/", "~1")


def leaves(content: bytes, needle: bytes) -> Iterator[tuple[int, str, str, int, int]]:
    """(byte offset of its document, path as a JSON pointer, value, start, end) of each scalar in the documents that spell the needle. What an alias stands for is given once, at its anchor."""
    for at, part, root, where in documents(content):
        if needle not in part:
            continue
        waiting, seen = [("", root)], set()
        while waiting:
            path, node = waiting.pop()
            if id(node) in seen:
                continue
            seen.add(id(node))
            if node.id == "scalar":
                yield at, path, node.value, at + int(where[node.start]), at + int(where[node.end])
            elif node.id == "mapping":
                waiting += [(path + _step(scalar(k)), v) for k, v in reversed(node.value)]
            else:
                waiting += [(f"{path}/{i}", v) for i, v in reversed(list(enumerate(node.value)))]
