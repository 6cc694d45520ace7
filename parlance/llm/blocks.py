"""Leaf blocks of an HTML page: the runs of text between block-level tags, in page order.

A lenient scanner, linear in the page: tags that are never closed, ends that were never opened, cut-off
pages, comments, raw-text elements and unquoted attributes are taken as browsers take them, as far as the
blocks' borders need it.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

# Fixed values of the HTML standard: void elements, elements whose content is raw text, and elements
# that start and end a block.  The last line of the blocks is for tables.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body button center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol optgroup option p pre "
    "search section select summary template ul noscript svg object "
    "caption colgroup table tbody td tfoot th thead tr".split())
#: Elements without readable text of their own.
DROPPED = frozenset("template noscript svg object select".split())
#: A start tag that ends open elements of these names, as far as the next element of the third set.
_LISTS, _TABLES = frozenset("ul ol menu dir dl".split()), frozenset(["table"])
ENDS = {"li": (frozenset(["li"]), _LISTS), "dt": (frozenset(["dt", "dd"]), _LISTS), "dd": (frozenset(["dt", "dd"]), _LISTS),
        "tr": (frozenset(["tr"]), _TABLES), "td": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
        "th": (frozenset(["td", "th"]), frozenset(["table", "tr"])), "option": (frozenset(["option"]), frozenset(["select"]))}

_TAG = re.compile(r"""</?([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*+"|'[^']*+')*+)>""")
_PLAIN = re.compile(r"</?([a-zA-Z][^\s/>]*+)([^>]*+)>")
_NAMES = re.compile(r"""\b(?:class|id|role|itemprop)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""", re.I)
_LABEL = re.compile(r"""\bdata-label\s*+=\s*+"([^"]*+)\"""")
_SPLIT = re.compile(r"[^a-z0-9]+")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}


@dataclass(slots=True)
class Element:
    """An open block-level element: its name and the words of its class, id and role; those of all open
    elements around it (``above``), and with what is nearest told apart (``path``)."""

    tag: str
    names: tuple[str, ...]
    above: frozenset
    path: frozenset
    label: str | None
    dropped: bool


@dataclass(slots=True)
class Leaf:
    """A leaf block."""

    inside: Element
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


_ROOT = Element("html", (), frozenset(), frozenset(), None, False)


def _names(attributes: str) -> tuple[str, ...]:
    if "=" not in attributes:
        return ()
    found = [w for m in _NAMES.finditer(attributes) for w in _SPLIT.split((m[1] or m[2] or m[3] or "").lower()) if w]
    return tuple(dict.fromkeys(found))


class Scanner:
    """Scans one page; ``known`` (if given) bounds what an element's path may hold."""

    def __init__(self, known=None):
        self.known = known
        self.stack, self.count = [_ROOT], {}
        self.leaves: list[Leaf] = []
        self.leaf: Leaf | None = None
        self.link = 0

    def _flush(self) -> None:
        if self.leaf:
            self.leaf.text = " ".join("".join(self.leaf.parts).split())
            self.leaf.parts = []
            if self.leaf.text:
                self.leaves.append(self.leaf)
            self.leaf = None

    def _pop(self) -> str:
        tag = self.stack.pop().tag
        self.count[tag] -= 1
        if self.link > len(self.stack):
            self.link = 0
        return tag

    def _open(self, tag: str, attributes: str) -> None:
        self._flush()
        if self.stack[-1].tag == "p":
            self._pop()
        if tag in ENDS:
            ended, border = ENDS[tag]
            if any(self.count.get(t) for t in ended):
                for at in range(len(self.stack) - 1, 0, -1):
                    if self.stack[at].tag in border:
                        break
                    if self.stack[at].tag in ended:
                        while len(self.stack) > at:
                            self._pop()
                        break
        if tag in VOID or tag in ("html", "body"):
            return
        around = self.stack[-1]
        names = _names(attributes)
        own = {f"in:{tag}", f"{'.'.join((around.tag, *around.names))}>{'.'.join((tag, *names))}",
               *(f"name:{n}" for n in names)}
        near = {f"near:{x}" for x in (tag, *names, around.tag, *around.names)}
        if self.known is not None:
            own, near = {x for x in own if x in self.known}, {x for x in near if x in self.known}
        above = around.above if own <= around.above else around.above | own
        label = _LABEL.search(attributes) if "data-label" in attributes else None
        self.stack.append(Element(tag, names, above, above | near, label[1] if label else around.label,
                                  around.dropped or tag in DROPPED))
        self.count[tag] = self.count.get(tag, 0) + 1

    def _close(self, tag: str) -> None:
        self._flush()
        if self.count.get(tag):
            while self._pop() != tag:
                pass

    def _text(self, raw: str) -> None:
        inside = self.stack[-1]
        if inside.dropped:
            return
        if self.leaf is None:
            if raw.isspace():
                return
            self.leaf = Leaf(inside)
        text = html.unescape(raw) if "&" in raw else raw
        self.leaf.parts.append(text)
        if self.link:
            self.leaf.linked += len(text)

    def scan(self, page: str) -> list[Leaf]:
        at, end, tag_at = 0, len(page), _TAG
        while at < end:
            start = page.find("<", at)
            if start < 0:
                self._text(page[at:])
                break
            if start > at:
                self._text(page[at:start])
            if page.startswith("<!--", start):
                stop = page.find("-->", start + 4)
                at = end if stop < 0 else stop + 3
                continue
            if page.startswith(("<!", "<?"), start):
                stop = page.find(">", start)
                at = end if stop < 0 else stop + 1
                continue
            found = tag_at.match(page, start)
            if not found and tag_at is _TAG and re.match("</?[a-zA-Z]", page[start:start + 3]):
                tag_at = _PLAIN  # a quote that never ends: from here on a tag ends at the next >
                found = tag_at.match(page, start)
            if not found:
                if re.match("</?[a-zA-Z]", page[start:start + 3]):
                    break  # the page ends inside a tag
                self._text("<")
                at = start + 1
                continue
            at, tag = found.end(), found[1].lower()
            if page[start + 1] == "/":
                if tag in BLOCK:
                    self._close(tag)
                elif tag == "a":
                    self.link = 0
            elif tag in RAW:
                stop = _RAW_END[tag].search(page, at)
                at = end if stop is None else stop.start()
            elif tag in BLOCK:
                self._open(tag, found[2])
            elif tag == "br":
                if self.leaf:
                    self.leaf.parts.append(" ")
            elif tag == "a":
                self.link = len(self.stack)
        self._flush()
        return self.leaves


def leaves(page: str | None, known=None) -> list[Leaf]:
    """The non-empty leaf blocks of a whole page in order; null has none."""
    return Scanner(known).scan(page) if page else []
