"""Leaf blocks of an HTML page with what a sequence model may look at."""

from __future__ import annotations

import re
from html.parser import HTMLParser

#: Elements without an end, elements whose content is not page text, elements that stand in a head, elements that
#: start a line of their own (all others, known or not, stand inside a line), those of them that end an open paragraph,
#: foreign elements that such an element ends, and what the reader of a form fills in or presses.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("audio button canvas datalist frameset head iframe math noframes noscript object optgroup option script select style svg template textarea title video".split())
HEAD = frozenset("base link meta noscript script style template title".split())
CLOSING = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p plaintext pre search section summary table ul xmp dd dt".split())
LINE = CLOSING | frozenset("html body head caption col colgroup legend tbody td tfoot th thead tr".split())
FOREIGN = frozenset("math svg select option optgroup datalist".split())
CONTROL = frozenset("button input select textarea".split())
#: Elements that a new element of the key ends if they are still open above it.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
#: Words in class, id and role that say what an element is for, by purpose.
PURPOSE = {
    "menu": "nav menu navbar navigation breadcrumb breadcrumbs toc pagination pager tabs skip",
    "head": "header masthead topbar head logo branding hero",
    "foot": "footer foot copyright legal colophon credits",
    "side": "sidebar side aside widget widgets rail complementary",
    "more": "related recommended recommendations popular trending tags share sharing social follow",
    "ad": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription paywall toast",
    "comment": "comment comments reply replies respond discussion disqus feedback review reviews",
    "form": "form search login signup register",
    "body": "content article post entry story main body text prose maincontent articlebody contentinfo-main",
}
_PURPOSE = {w: p for p, words in PURPOSE.items() for w in words.split()}
_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")


class Block:
    """A run of text between block elements: its text, its open elements (outermost first), the length of its links, and whether a control stands in it."""

    __slots__ = ("control", "linked", "path", "text")

    def __init__(self, text: str, path: tuple[tuple[str, ...], ...], linked: int, control: bool = False) -> None:
        self.text, self.path, self.linked, self.control = text, path, linked, control


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        self.open: list[tuple[str, ...]] = []  # (element, purposes...)
        self.unseen = 0
        self.links = 0
        self.data: list[str] = []
        self.linked = 0
        self.control = False

    def end_block(self) -> None:
        text = " ".join("".join(self.data).split())
        if text:
            self.blocks.append(Block(text, tuple(e for e in self.open if e[0] in LINE or "-" in e[0]), self.linked, self.control))
        self.data, self.linked, self.control = [], 0, False

    def pop_to(self, at: int) -> None:
        for e in self.open[at:]:
            self.unseen -= e[0] in UNSEEN
            self.links -= e[0] == "a"
        del self.open[at:]

    def end_head(self) -> None:
        """What cannot stand in a head ends it."""
        if self.open and self.open[-1][0] == "head":
            self.pop_to(len(self.open) - 1)

    def end_before(self, tag: str) -> None:
        """End what the start of a block element ends."""
        names = [e[0] for e in self.open]
        if tag in CLOSING and "foreignobject" not in names:
            at = next((i for i, n in enumerate(names) if n in FOREIGN), None)
            if at is not None:
                self.end_block()
                self.pop_to(at)
                del names[at:]
        if tag in CLOSING and not self.unseen and "p" in names:
            self.pop_to(len(names) - 1 - names[::-1].index("p"))
        elif tag in ENDS:
            for i in range(len(names) - 1, -1, -1):
                if names[i] in ENDS[tag]:
                    self.pop_to(i)
                    break
                if names[i] in ("ul", "ol", "dl", "table"):
                    break

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "body":
            names = [e[0] for e in self.open]
            if "head" in names:
                self.pop_to(names.index("head"))
        elif tag not in HEAD:
            self.end_head()
        if tag == "br":
            self.data.append(" ")
        if tag in CONTROL and not self.unseen and ("type", "hidden") not in attrs:
            self.control = True
        if tag in LINE and not (self.unseen and tag in UNSEEN):
            if not self.unseen:
                self.end_block()
            self.end_before(tag)
        if tag in VOID:
            return
        purposes = {_PURPOSE[w.lower()] for k, v in attrs if k in ("class", "id", "role", "itemprop") and v for w in _WORD.findall(v) if w.lower() in _PURPOSE}
        self.unseen += tag in UNSEEN
        self.links += tag == "a"
        self.open.append((tag, *sorted(purposes)))

    def handle_endtag(self, tag: str) -> None:
        if tag in LINE and not self.unseen:
            self.end_block()
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                if tag in LINE and self.unseen and not any(e[0] in UNSEEN for e in self.open[:i]):
                    self.end_block()  # what was left open in it ends with it
                self.pop_to(i)
                break
            if tag not in LINE and self.open[i][0] in LINE:
                break

    def handle_data(self, data: str) -> None:
        if data.strip():
            self.end_head()
        if not self.unseen:
            self.data.append(data)
            if self.links:
                self.linked += len(data.strip())


def blocks(html: str | None) -> list[Block]:
    """The leaf blocks of a page, in page order."""
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    reader.end_block()
    return reader.blocks


def features(block: Block) -> list[str]:
    """Names of what holds for a block: its ancestors and what they are for, and the look of its text."""
    tags = [e[0] for e in block.path]
    purposes = {p for e in block.path for p in e[1:]}
    out = ["any"] + [f"in:{t}" for t in set(tags)] + [f"for:{p}" for p in purposes]
    out.append(f"tag:{tags[-1] if tags else 'none'}")
    apart = purposes - {"body"} or {"nav", "aside", "footer", "header", "address", "menu", "dialog"} & set(tags)
    body = "body" in purposes or bool({"article", "main"} & set(tags))
    out.append(("body" if body else "nobody") + ("+apart" if apart else "+plain"))
    # what the innermost telling ancestor says
    for e in reversed(block.path):
        told = [p for p in e[1:]] or ([e[0]] if e[0] in ("article", "main", "nav", "aside", "footer", "header", "dialog", "menu", "form") else [])
        if told:
            out += [f"inner:{t}" for t in told]
            break
    if "form" in tags:
        out.append(f"form:{tags[-1]}")
        out.append("form+body" if body else "form+nobody")
    if block.control:
        out.append("control")
    n = len(block.text)
    out.append(f"length:{min(6, n.bit_length() // 2)}")
    out.append(f"links:{min(3, int(4 * block.linked / max(1, n)))}")
    out.append("stop" if block.text[-1] in ".!?:;\"'»”…" else "nostop")
    if "©" in block.text:
        out.append("copyright")
    return out
