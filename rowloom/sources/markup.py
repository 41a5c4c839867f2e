"""A small document tree on the standard library's HTML parser, with selectors.

Selectors: tag, ``*``, ``.class``, ``#id``, ``[attr]``, ``[attr=v]``, ``[attr*=v]``,
``[attr^=v]``, ``[attr$=v]``, descendant (space) and child (``>``), commas, and at
the end ``::text`` or ``::attr(name)``. Paths: ``//tag[@a='v']/tag/@attr``,
``/text()``, ``.//``, and positions ``[n]``. Nothing else.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: An opening tag that ends open ones of the same kind.
SELF_CLOSING = {"li": {"li"}, "p": {"p"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}


@dataclass(eq=False)
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    parent: "Node | None" = None
    kids: list["Node | str"] = field(default_factory=list)

    def walk(self) -> Iterator["Node"]:
        """This node and those below, in document order."""
        todo = [self]
        while todo:
            node = todo.pop()
            yield node
            todo.extend(k for k in reversed(node.kids) if isinstance(k, Node))

    def texts(self) -> list[str]:
        """The text nodes below, in document order."""
        out, todo = [], list(reversed(self.kids))
        while todo:
            k = todo.pop()
            if isinstance(k, str):
                out.append(k)
            else:
                todo.extend(reversed(k.kids))
        return out

    def own_texts(self) -> list[str]:
        return [k for k in self.kids if isinstance(k, str)]


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#document")

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in SELF_CLOSING and self.at.tag in SELF_CLOSING[tag] and self.at.parent:
            self.at = self.at.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.kids.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.at.tag == tag:
            self.at = self.at.parent or self.root

    def handle_endtag(self, tag: str) -> None:
        node: Node | None = self.at
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        if self.at.kids and isinstance(self.at.kids[-1], str):
            self.at.kids[-1] += data
        else:
            self.at.kids.append(data)


def parse(html: str | None) -> Node:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


_STEP = re.compile(r"(?P<tag>\*|[\w-]+)|\.(?P<cls>[\w-]+)|#(?P<id>[\w-]+)|\[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[*^$~]?=)\s*(?P<q>[\"']?)(?P<val>.*?)(?P=q)\s*)?\]")


_OPERATORS: dict[str | None, Callable[[str | None, str], bool]] = {
    None: lambda has, value: has is not None,
    "=": lambda has, value: has == value,
    "*=": lambda has, value: bool(value) and value in (has or ""),
    "^=": lambda has, value: bool(value) and (has or "").startswith(value),
    "$=": lambda has, value: bool(value) and (has or "").endswith(value),
    "~=": lambda has, value: value in (has or "").split(),
}


@lru_cache(1024)
def _tests(step: str) -> list[Callable[[Node], bool]]:
    """What a node must satisfy to match one step of a selector."""
    out: list[Callable[[Node], bool]] = []
    at = 0
    while at < len(step):
        m = _STEP.match(step, at)
        if not m:
            raise ValueError(f"selector not supported: {step!r}")
        at = m.end()
        if m["tag"]:
            tag = m["tag"].lower()
            out.append((lambda n: n.tag != "#document") if tag == "*" else (lambda n, tag=tag: n.tag == tag))
        elif m["cls"]:
            out.append(lambda n, c=m["cls"]: c in n.attrs.get("class", "").split())
        elif m["id"]:
            out.append(lambda n, i=m["id"]: n.attrs.get("id") == i)
        else:
            out.append(lambda n, a=m["attr"], test=_OPERATORS[m["op"]], v=m["val"] or "": test(n.attrs.get(a), v))
    return out


@lru_cache(1024)
def _split(selector: str, by: str) -> list[str]:
    """Parts at commas or spaces that aren't within brackets."""
    return [x for x in re.split(rf"{by}(?![^\[]*\])", selector.strip()) if x.strip()]


def select(root: Node, selector: str) -> list[Node]:
    """The nodes below root, root itself aside, that match, in document order, each once."""
    found: dict[int, Node] = {}
    for alternative in _split(selector, ","):
        steps = _split(re.sub(r"\s*>\s*(?![^\[]*\])", " > ", alternative), r"\s+")
        here, child = [root], False
        for step in steps:
            if step == ">":
                child = True
                continue
            seen: dict[int, Node] = {}
            tests = _tests(step)
            for base in here:
                below = (k for k in base.kids if isinstance(k, Node)) if child else (n for n in base.walk() if n is not base)
                seen.update((id(n), n) for n in below if all(t(n) for t in tests))
            here, child = list(seen.values()), False
        found.update((id(n), n) for n in here)
    return [n for n in root.walk() if id(n) in found] if len(found) > 1 else list(found.values())


def css(root: Node, selector: str) -> list[str]:
    """What a selector with ::text or ::attr gives, or the text of the nodes that it selects."""
    out: list[str] = []
    for alternative in _split(selector, ","):
        base, _, end = alternative.strip().partition("::")
        deep = base != base.rstrip() or not base
        nodes = select(root, base) if base.strip() else [root]
        if end == "text":
            for n in nodes:
                out += n.texts() if deep else n.own_texts()
        elif end.startswith("attr("):
            out += [n.attrs[end[5:-1]] for n in nodes if end[5:-1] in n.attrs]
        else:
            out += ["".join(n.texts()) for n in nodes]
    return out


_PATH = re.compile(r"(?P<axis>//|/|^)(?:(?P<at>@[\w:-]+)|(?P<text>text\(\))|(?P<tag>\*|[\w-]+)(?P<preds>(?:\[[^\]]*\])*))")


def xpath(root: Node, path: str) -> list[str]:
    """What a path gives: attribute values, text nodes, or the text of elements."""
    path = path[1:] if path.startswith(".") else path
    here, at = [root], 0
    while at < len(path):
        m = _PATH.match(path, at)
        if not m or m.end() == at:
            raise ValueError(f"path not supported: {path!r}")
        at, deep = m.end(), m["axis"] == "//"
        if m["at"]:
            nodes = [n for b in here for n in (b.walk() if deep else [b])]
            return [n.attrs[m["at"][1:]] for n in nodes if m["at"][1:] in n.attrs]
        if m["text"]:
            return [t for b in here for t in (b.texts() if deep else b.own_texts())]
        following: dict[int, Node] = {}
        for b in here:
            pool = [n for n in b.walk() if n is not b] if deep else [k for k in b.kids if isinstance(k, Node)]
            hits = [n for n in pool if m["tag"] in ("*", n.tag)]
            for pred in re.findall(r"\[([^\]]*)\]", m["preds"] or ""):
                if pred.isdigit():
                    hits = hits[int(pred) - 1 : int(pred)]
                elif p := re.fullmatch(r"@([\w:-]+)(?:\s*=\s*[\"'](.*)[\"'])?", pred):
                    hits = [n for n in hits if p[1] in n.attrs and (p[2] is None or n.attrs[p[1]] == p[2])]
                elif p := re.fullmatch(r"contains\(@([\w:-]+),\s*[\"'](.*)[\"']\)", pred):
                    hits = [n for n in hits if p[2] in n.attrs.get(p[1], "")]
                else:
                    raise ValueError(f"path not supported: {path!r}")
            following.update((id(n), n) for n in hits)
        here = list(following.values())
    return ["".join(n.texts()) for n in here]
