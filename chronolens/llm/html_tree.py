"""A forgiving HTML reader: tags and texts into a tree, with the closing rules that matter for text.

One pass, linear in the page's length whatever the page: each place is searched
for the end of a tag, comment or raw text at most a fixed number of times.
Trees are at most ``MAX_NESTING`` deep; what a page nests deeper becomes
children of the deepest level, so no text is lost and nothing here or in the
callers can run out of stack.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html import unescape

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_TAG_REST = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")  # attributes with quotes, to the tag's end, without backtracking
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")

# Element kinds of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template svg math".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - frozenset("html body caption tbody td tfoot th thead tr legend".split())
#: An opening tag that ends the open element of one of these kinds, inside the nearest of the scopes.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("tbody", "thead", "tr", "td", "th"), "tfoot": ("tbody", "thead", "tr", "td", "th")}
SCOPES = frozenset("html body article section main div table td th ul ol dl blockquote form fieldset header footer nav aside button figure".split())


class Node:
    """An element: its label is the tag with its class, identifier and role; children are nodes and strings."""

    __slots__ = ("tag", "names", "children")

    def __init__(self, tag: str, names: str = ""):
        self.tag, self.names, self.children = tag, names, []

    @property
    def label(self) -> str:
        return f"{self.tag}.{self.names}" if self.names else self.tag


@lru_cache(10_000)
def _names(attributes: str) -> str:
    if not attributes or "=" not in attributes:
        return "hidden" if "hidden" in attributes.lower() else ""
    out = []
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), (a or b or c).lower()
        if name in ("class", "id", "role", "itemprop"):
            out += value.split()
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            out.append("hidden")
    return " ".join(out)


MAX_NESTING = 100
_RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}


def parse(html: str) -> Node:
    root = Node("#root")
    stack = [root]
    flattened: dict[str, int] = {}  # open elements, by tag, that are below the deepest level
    at, n, bad_quotes, bracket = 0, len(html), 0, -1
    while at < n:
        start = html.find("<", at)
        if -1 < bracket < start or bracket < 0:  # the next closing bracket, looked for once
            bracket = html.find(">", max(start, 0))
        if start < 0 or bracket < 0 and not html.startswith("<!--", start):
            stack[-1].children.append(html[at:])  # no tag can end any more
            break
        if start > at:
            stack[-1].children.append(html[at:start])
        if html.startswith("<!--", start):
            end = html.find("-->", start + 4)
            at = end + 3 if end >= 0 else n
            continue
        if html.startswith("<![CDATA[", start):
            end = html.find("]]>", start)
            stack[-1].children.append(html[start + 9 : end if end >= 0 else n].replace("&", "&amp;"))
            at = end + 3 if end >= 0 else n
            continue
        if html[start + 1] in "!?":
            at = bracket + 1
            continue
        closing = html[start + 1] == "/"
        found = _NAME.match(html, start + 1 + closing)
        if not found:
            stack[-1].children.append("<")
            at = start + 1
            continue
        rest = _TAG_REST.match(html, found.end()) if bad_quotes < 3 else None
        if rest:
            at = rest.end()
        else:  # a quote that nothing closes: the tag ends at the next bracket
            bad_quotes += 1
            at = html.find(">", found.end()) + 1
        tag, attributes = found[0].lower(), html[found.end() : at - 1]
        if closing:
            if flattened.get(tag):
                flattened[tag] -= 1
                continue
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    del stack[depth:]
                    flattened.clear()
                    break
                if stack[depth].tag in SCOPES and tag not in SCOPES:
                    break
            continue
        if tag in CLOSES_P:
            _end(stack, ("p",))
        if tag in ENDS:
            _end(stack, ENDS[tag])
        node = Node(tag, _names(attributes))
        stack[-1].children.append(node)
        if tag in RAW:
            end = _RAW_END[tag].search(html, at)
            node.children.append(html[at : end.start() if end else n])
            at = end.end() if end else n
        elif tag not in VOID and not attributes.endswith("/") or tag in ("p", "div"):
            if len(stack) <= MAX_NESTING:
                stack.append(node)
            else:
                flattened[tag] = flattened.get(tag, 0) + 1
    return root


def _end(stack: list[Node], kinds: tuple[str, ...]) -> None:
    for depth in range(len(stack) - 1, 0, -1):
        tag = stack[depth].tag
        if tag in kinds:
            del stack[depth:]
            return
        if tag in SCOPES:
            return


def squeeze(text: str) -> str:
    return " ".join((unescape(text) if "&" in text else text).split())
