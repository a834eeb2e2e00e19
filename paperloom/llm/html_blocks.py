"""Leaf blocks of an HTML page, with what is known about their ancestors.

A forgiving reader in one pass: end tags close what they can, a block start
closes an open paragraph, comments, scripts, styles and templates are skipped. A
leaf block is the text between two block boundaries; inline markup, formulas,
drawings and line breaks do not end it. Character references are decoded and white space is folded.

What an ancestor's tag and class words say depends on how much of the page's
text it holds: a sidebar is small, a page "with sidebar" is everything. So the
features of an element are named after its share of the text, which is known
when the page has been read. A class name of one word is told from one of several.
"""

from __future__ import annotations

import html
import re
from typing import NamedTuple

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>""")
_LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_NAMED = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.IGNORECASE)
_TOKEN = re.compile(r"[a-z]+")
#: content that is never text; without an end tag it goes on to the end of the page, as in a browser
_RAW = {tag: re.compile(rf"</{tag}\b[^>]*>", re.IGNORECASE) for tag in ("script", "style")}
_TEMPLATE = re.compile(r"<(/?)template\b[^>]*>", re.IGNORECASE)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var br wbr img label math svg object param noscript iframe".split()
)
_BREAKING = frozenset(
    "br wbr img object noscript iframe svg text title desc foreignobject mtr mtd annotation annotation-xml".split()
)
#: in these all elements are inline, but for blocks of HTML, which end them if no bound is nearer
_FOREIGN = frozenset(("svg", "math"))
_HTML_BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead "
    "tr ul".split()
)
_FOREIGN_BOUNDS = frozenset("foreignobject desc title annotation-xml mi mo mn ms mtext".split())
#: a start tag closes these open elements, up to the given bounds
_CLOSES = {
    "li": (frozenset(("li",)), frozenset(("ul", "ol", "menu"))),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "tr": (frozenset(("tr",)), frozenset(("table",))),
    "td": (frozenset(("td", "th")), frozenset(("table", "tr"))),
    "th": (frozenset(("td", "th")), frozenset(("table", "tr"))),
    "option": (frozenset(("option",)), frozenset(("select",))),
    "body": (frozenset(("head",)), frozenset()),
}
_PARAGRAPH = (frozenset(("p",)), frozenset("td th table button caption article section div object foreignobject annotation-xml".split()))


class Block(NamedTuple):
    """A leaf block: text, share of it inside links, features of its ancestors.

    ``room`` and ``around`` are the shares of the page's text in the nearest
    element that holds more than this block, and in the element around that.
    """

    text: str
    link_share: float
    ancestors: frozenset[str]
    parent: str
    room: float = 1.0
    around: float = 1.0


class _Open(NamedTuple):
    tag: str
    element: int
    in_link: bool
    inline: bool = False


#: from which share of the text on an element's features are named so
SHARES = ((0.85, "whole "), (0.5, "wide "), (0.0, ""))


def _own_features(tag: str, attributes: str) -> list[str]:
    found = [f"in:{tag}"]
    for _, value in _NAMED.findall(attributes) if attributes else ():
        for name in value.lower().split():
            words = _TOKEN.findall(name)
            kind = "word" if len(words) == 1 else "part"
            found += [f"{kind}:{w}" for w in words]
    return found


def _blocks(found: list[tuple[str, float, int, str]], parents: list[int], own: list[tuple[str, str]]) -> list[Block]:
    """Blocks with the features of their ancestors, by the shares of text that these hold."""
    sizes = [0] * len(parents)
    for text, _, element, _ in found:
        sizes[element] += len(text)
    for element in range(len(parents) - 1, 0, -1):  # children come after their parents
        sizes[parents[element]] += sizes[element]
    total = max(1, sizes[0])
    features: list[frozenset[str]] = [frozenset()]
    for element in range(1, len(parents)):
        above = features[parents[element]]
        if sizes[element]:
            level = next(name for least, name in SHARES if sizes[element] >= least * total)
            mine = frozenset(level + f for f in _own_features(*own[element]))
            features.append(above if mine <= above else above | mine)
        else:
            features.append(above)
    blocks = []
    for text, link_share, element, tag in found:
        room = element  # an element with this block alone is no container, whatever its tag
        while room and sizes[room] == len(text):
            room = parents[room]
        around = parents[room]
        blocks.append(Block(text, link_share, features[element], tag, sizes[room] / total, sizes[around] / total))
    return blocks


def leaf_blocks(page: str | None) -> list[Block]:
    """Non-empty leaf blocks of a page in order."""
    page = page or ""
    stack = [_Open("", 0, False)]
    parents, own = [0], [("", "")]
    counts: dict[str, int] = {}
    found: list[tuple[str, float, int, str]] = []
    pieces: list[tuple[str, bool]] = []
    owner = stack[0]
    templates: dict[int, int] | None = None

    def flush() -> None:
        if pieces:
            text = " ".join(html.unescape("".join(p for p, _ in pieces)).split())
            if text:
                linked = sum(len(p) for p, link in pieces if link)
                total = sum(len(p) for p, _ in pieces)
                found.append((text, linked / total, owner.element, owner.tag))
            pieces.clear()

    at, size = 0, len(page)
    while at < size:
        mark = page.find("<", at)
        if mark < 0:
            mark = size
        if mark > at:
            if not pieces:
                owner = next((o for o in reversed(stack) if not o.inline), stack[0])
            pieces.append((page[at:mark], stack[-1].in_link))
        if mark == size:
            break
        tag = _TAG.match(page, mark) or _LOOSE_TAG.match(page, mark)
        if not tag:
            if page.startswith("<!--", mark):
                end = page.find("-->", mark + 4)
                at = size if end < 0 else end + 3
            elif page.startswith(("<!", "<?", "</"), mark):
                end = page.find(">", mark)
                at = size if end < 0 else end + 1
            elif mark + 1 < size and page[mark + 1].isalpha():
                break  # the page ends inside a tag
            else:
                pieces.append(("&lt;", stack[-1].in_link))
                at = mark + 1
            continue
        at = tag.end()
        name = tag[2].lower()
        if name in _RAW and not tag[1]:
            end = _RAW[name].search(page, at)
            at = end.end() if end else size
            continue
        if name == "template" and not tag[1]:
            if "shadowrootmode" not in tag[3].lower():
                if templates is None:
                    templates = _template_ends(page)
                at = max(at, templates.get(mark, at))
            continue
        foreign = name not in _HTML_BLOCKS and any(counts.get(t, 0) > 0 for t in _FOREIGN)
        inline = foreign or name in _INLINE
        if not inline:
            flush()
        elif name in _BREAKING:
            pieces.append((" ", False))
        if tag[1]:
            if counts.get(name, 0) > 0:
                while stack[-1].tag != name:
                    counts[stack.pop().tag] -= 1
                stack.pop()
                counts[name] -= 1
            continue
        if name in _VOID or tag[3].endswith("/") and (foreign or name in _FOREIGN):
            continue
        if not inline:
            if any(counts.get(t, 0) > 0 for t in _FOREIGN):
                for gone in _cut(stack, _FOREIGN, _FOREIGN_BOUNDS):
                    counts[gone.tag] -= 1
            for tags, bounds in (_PARAGRAPH, _CLOSES.get(name)) if name in _CLOSES else (_PARAGRAPH,):
                if any(counts.get(t, 0) > 0 for t in tags):
                    for gone in _cut(stack, tags, bounds):
                        counts[gone.tag] -= 1
        above = stack[-1]
        parents.append(above.element)
        own.append((name, tag[3]))
        stack.append(_Open(name, len(own) - 1, above.in_link or name == "a", inline))
        counts[name] = counts.get(name, 0) + 1
    flush()
    return _blocks(found, parents, own)


def _template_ends(page: str) -> dict[int, int]:
    """Where each template ends, by its start: a copy to be filled, never shown. Those without an end tag are left out."""
    ends, opened = {}, []
    for tag in _TEMPLATE.finditer(page):
        if not tag[1]:
            opened.append(tag.start())
        elif opened:
            ends[opened.pop()] = tag.end()
    return ends


def _cut(stack: list[_Open], tags: frozenset[str], bounds: frozenset[str]) -> list[_Open]:
    """Remove the innermost open element among ``tags``, and all inside it, unless a bound is nearer."""
    for depth in range(len(stack) - 1, 0, -1):
        if stack[depth].tag in tags:
            gone = stack[depth:]
            del stack[depth:]
            return gone
        if stack[depth].tag in bounds:
            break
    return []
