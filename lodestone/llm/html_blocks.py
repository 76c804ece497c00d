"""Text lines of a web page, with what the markup says about them. A tolerant reader in plain Python."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

#: Kinds of elements.
RAW = "script|style|noscript|template|textarea|iframe|svg|math|object|canvas|title|select"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
OUTSIDE = frozenset("head nav footer aside form button menu dialog".split())
CONTENT = frozenset(("article", "main"))
#: Words of a class or id, and roles, that mark what is not the article.
BOILER_WORDS = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising sponsor sponsored banner promo promotion cookie cookies consent gdpr notice notices alert menu nav navbar navigation breadcrumb breadcrumbs sidebar footer masthead share sharing social related recommended newsletter subscribe subscription signup popup modal overlay comment comments respond reply replies disqus pagination pager widget toolbar login search skip".split()
)
#: Of these, the ones that count within an article too: the kinds of text that are never its own.
INNER_WORDS = frozenset("ad ads adbox adslot advert adverts advertisement advertising sponsor sponsored cookie cookies consent gdpr menu nav navbar navigation breadcrumb breadcrumbs sidebar comment comments respond disqus".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<({RAW})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*>|([^<]+)|(<)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)\b\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)


@dataclass
class Line:
    text: str
    #: Within an article or main element.
    content: bool
    #: Share of the characters that are in links.
    linked: float


def _boiler(attributes: str, inside: bool = False) -> bool:
    """Whether attributes mark what is not the article. inside: the element stands in an article."""
    words = INNER_WORDS if inside else BOILER_WORDS
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id") and not words.isdisjoint(w.lower() for w in re.split(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])", value)):
            return True
        if name == "role" and value.lower() in BOILER_ROLES:
            return True
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and "display:none" in value.replace(" ", "").lower()):
            return True
    return False


def page_lines(page: str) -> list[Line]:
    """The lines of a page outside of scripts, styles, forms, menus, headers, footers, sidebars and what classes call so. Each block is a line."""
    out: list[Line] = []
    parts: list[str] = []
    stack: list[tuple[str, int]] = []  # open elements: name, 1 left out, 2 content
    left_out = content = links = linked = 0

    def close_line() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Line(text, content > 0, linked / len(text)))
            parts.clear()
        linked = 0

    def pop() -> None:
        nonlocal left_out, content, links
        name, kind = stack.pop()
        left_out -= kind == 1
        content -= kind == 2
        links -= name == "a"

    for m in _TOKEN.finditer(page):
        text = m[8] or m[9]
        if text is not None:
            if not left_out:
                parts.append(text)
                if links:
                    linked += len(text)
            continue
        name = (m[3] or m[6] or "").lower()
        if not name:
            continue
        closing, attributes = m[2] or m[5], m[4] if m[3] else m[7]
        if name in BLOCK:
            close_line()
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    while len(stack) > k:
                        pop()
                    break
            continue
        if name in VOID or (attributes and attributes.endswith("/") and name not in BLOCK):
            continue
        if name in CONTENT and left_out and not content and not any(n in ("aside", "footer") for n, _ in stack) and not (attributes and _boiler(attributes)):
            while stack and left_out:  # the element before was never closed
                pop()
        if name in ("p", "li", "a") and stack and stack[-1][0] == name:
            pop()
        outside = name in OUTSIDE or (name == "header" and not content) or (attributes and name not in ("html", "body") and _boiler(attributes, content > 0))
        kind = 1 if outside else 2 if name in CONTENT and not left_out else 0
        stack.append((name, kind))
        left_out += kind == 1
        content += kind == 2
        links += name == "a"
    close_line()
    return out


def common_lines(a: list[str], b: list[str]) -> set[int]:
    """Positions in a of a longest common subsequence of a and b (Hunt and Szymanski: by the matches, in increasing chains)."""
    from bisect import bisect_left

    where: dict[str, list[int]] = {}
    for j, x in enumerate(b):
        where.setdefault(x, []).append(j)
    ends: list[int] = []
    chain: list[tuple] = []
    for i, x in enumerate(a):
        for j in reversed(where.get(x, ())):
            k = bisect_left(ends, j)
            link = (i, chain[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                chain.append(link)
            else:
                ends[k] = j
                chain[k] = link
    out, at = set(), chain[-1] if chain else None
    while at:
        out.add(at[0])
        at = at[1]
    return out
