"""One forward pass over HTML: its visible text, links, title and language.

Every character is read once: a tag that never ends runs to the end of the page, as browsers read it, so no page
costs more than its length.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape
from urllib.parse import urldefrag, urljoin

#: A comment, a declaration, or a tag with its attributes; values in quotes may hold any character.
_TOKEN = re.compile(
    r"""<(?:!--(?P<comment>)|[!?][^>]*+>?|(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>=]++|=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))|=)*+)(?P<end>>?))""",
    re.S,
)
_VALUE = re.compile(r"""([^\s"'>/=]++)\s*+(?:=\s*+(?:"([^"]*+)"?|'([^']*+)'?|([^\s>]++)))?""", re.S)
# Elements that begin a line, whose content isn't shown, and whose content is no markup.
_LINES = frozenset("p div br li ul ol h1 h2 h3 h4 h5 h6 tr table article section header footer nav aside blockquote pre dd dt dl".split())
_HIDDEN = frozenset("noscript template head".split())
_RAW = frozenset("script style title textarea".split())
_LINKED = {"a": "href", "area": "href", "link": "href", "img": "src", "script": "src", "iframe": "src"}
_BLANK = re.compile("[ \\t\\r\\f\\v\\xa0]+")


@dataclass
class Page:
    """``links`` are (attribute, value as written) in order; ``text`` has one line a block element."""

    text: str = ""
    title: str | None = None
    lang: str | None = None
    links: list[tuple[str, str]] = field(default_factory=list)


def attributes(rest: str) -> dict[str, str]:
    """Names in small letters and values with entities decoded; of equal names the first counts."""
    found: dict[str, str] = {}
    for name, double, single, bare in _VALUE.findall(rest):
        found.setdefault(name.lower(), unescape(double or single or bare))
    return found


def read(body: str) -> Page:
    page, shown, at, hidden, closers = Page(), [], 0, "", {}
    search, size = _TOKEN.search, len(body)
    while m := search(body, at):
        if not hidden and m.start() > at:
            shown.append(body[at : m.start()])
        at = m.end()
        if m["comment"] is not None:
            over = body.find("-->", at)
            at = size if over < 0 else over + 3
            shown.append(" ")
            continue
        if m["name"] is None:
            continue
        name = m["name"].lower()
        if not m["end"]:  # the page ends inside the tag
            break
        if m["close"]:
            if name == hidden:
                hidden = ""
                shown.append(" ")
            elif name in _LINES and not hidden:
                shown.append("\n")
            continue
        if name in _LINES:
            if not hidden:
                shown.append("\n")
        elif name in _LINKED:
            _link(page, name, m["rest"])
        elif name == "html" and page.lang is None:
            page.lang = attributes(m["rest"]).get("lang", "").strip().lower() or None
        if name in _RAW:
            if name not in closers:
                closers[name] = re.compile(rf"</{name}(?=[\s/>])[^>]*+>?", re.I)
            over = closers[name].search(body, at)
            inside, at = body[at : over.start() if over else size], over.end() if over else size
            if name == "title" and page.title is None:
                page.title = " ".join(unescape(inside).split())
            shown.append(inside if name == "textarea" and not hidden else " ")
        elif name in _HIDDEN and not hidden:
            hidden = name
    else:
        if not hidden:
            shown.append(body[at:])
    lines = (_BLANK.sub(" ", x).strip() for x in unescape("".join(shown)).split("\n"))
    page.text = "\n".join(x for x in lines if x)
    return page


def _link(page: Page, name: str, rest: str) -> None:
    kind = _LINKED[name]
    if kind in rest.lower() and (value := attributes(rest).get(kind, "").strip()):
        page.links.append((kind, value))


def resolved(links: list[tuple[str, str]], uri: str) -> list[tuple[str, str]]:
    """(attribute, absolute URI) without fragments, once each; scripts, data and what can't be resolved are left out."""
    found: dict[tuple[str, str], None] = {}
    for kind, raw in links:
        if not raw.lower().startswith(("javascript:", "data:", "#")):
            try:
                found[(kind, urldefrag(urljoin(uri, raw))[0])] = None
            except ValueError:
                continue
    return list(found)
