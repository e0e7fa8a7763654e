"""Features of HTML pages: the tree of their tags."""

from __future__ import annotations

import zlib
from html.parser import HTMLParser

from .python_source import add_node, empty_features, sha256_of

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SCRIPTING = frozenset(("script", "style", "noscript", "template", "form", "input", "button", "select", "textarea"))


class _Tags(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out, self.open = empty_features(), []

    def handle_starttag(self, tag, attrs):
        depth = len(self.open) + 1
        add_node(self.out, tag, depth)
        if depth == 1:
            self.out["head_nodes"].append(f"{tag}[{self.getpos()[0]}]")
        self.out["tokens"].append(zlib.crc32(tag.encode()) >> 1)
        self.out["tokens_pos"].append(self.getpos())
        group = self.out["keywords"] if tag in SCRIPTING else self.out["operators"]
        group[tag] = group.get(tag, 0) + 1
        for name, _ in attrs:
            self.out["literals"][name] = self.out["literals"].get(name, 0) + 1
        if tag not in VOID:
            self.open.append(tag)

    def handle_endtag(self, tag):
        if tag in self.open:
            while self.open.pop() != tag:
                pass


def extract(code: str, path: str = "") -> dict | None:
    parser = _Tags()
    parser.feed(code)
    parser.close()
    return parser.out | {"sha256": sha256_of(parser.out["structure"])}


def decode(content: bytes) -> str | None:
    return content.decode("utf-8", errors="replace")
