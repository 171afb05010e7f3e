"""Main text of web pages by composite text density.

*Density.* Every DOM node gets its characters, tags, link characters and link tags, and from them the composite text density:
characters per tag, adjusted by how much of the node is links compared with the whole body. A node's density sum adds the
densities of its children. The block with the largest sum is the content. The least density on its path to the body is the
threshold: subtrees beside that path are content too if their density reaches half of it. Headings, paragraphs, lists,
quotations and tables beside the path, and blocks of the same tag and class as the one on the path, only need to be mostly
text that is no link, as sections of one article differ much in density. No element is content because of its name alone.

*Furniture.* Menus, headers and footers of the page, sidebars, forms, scripts and styles are known by element or role and are no
content, but their characters and tags count in the densities of what holds them. A form with most of the page's text is the
page itself. A class or id of which one word names furniture as a whole (``ad-slot``, ``user-comments``) makes the block no
content. Where such a word is one among others (``notice-of-rights``, ``share-prices``) it only lowers the densities that count
for the choice of the content and for blocks beside its path, by LOWER; what the chosen content holds stays, whatever its name.

The parser works on the whole page in one forward pass with an explicit stack and constant work for each tag, so time is in
proportion to the page, broken markup included. Defined results: a null or empty page, or one without text, gives an empty
text; repeated rows give a row each; nulls in page_id and url stay; extra columns are ignored.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from shadowset.llm.common import arrow_map

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STEP = re.compile(r"[^>\"'=]*+(?:=\s*)?")
_ATTRIBUTE = re.compile(r"""([a-zA-Z][\w:.-]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_TOKENS = re.compile(r"[a-z]+")

# Fixed values of HTML: elements by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: Elements that a later one may end: which ones, and what it does not look beyond.
SCOPES = (
    (frozenset(["p"]), CLOSES_P - {"p"} | {"button", "td", "th", "object"}),
    (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    (frozenset(["dt", "dd"]), frozenset(["dl"])),
    (frozenset(["tr"]), frozenset(["table"])),
    (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    (frozenset(["option"]), frozenset(["select"])),
)
ENDS = {"li": 1, "dt": 2, "dd": 2, "tr": 3, "td": 4, "th": 4, "option": 5} | dict.fromkeys(CLOSES_P, 0)
_SCOPED = frozenset().union(*(a | b for a, b in SCOPES))
UNSEEN = frozenset("head script style noscript template iframe object embed svg canvas title link meta audio video map".split())
FURNITURE = frozenset("nav footer aside button select input textarea menu dialog".split())
PROSE = frozenset("h1 h2 h3 h4 h5 h6 hgroup p blockquote pre figure table ul ol dl".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar toolbar alert alertdialog dialog".split())
# Words of classes and ids that mark furniture, and words that go with them.
MARKS = frozenset(
    """ad ads adbox adsbox adslot advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion sidebar sidebars menu submenu nav navbar navigation
    navigations breadcrumb breadcrumbs cookie cookies consent gdpr notice notices notification banner banners comments comment commentlist disqus respond reply replies share sharing
    social related recommended newsletter subscribe subscription signup login popup modal overlay footer header masthead toolbar pagination pager widget widgets skip""".split()
)
WITH_MARKS = frozenset(
    """a area bar block body bottom box btn button buttons container content entry fixed form global group head holder icon icons inner item items left link links list main
    middle mobile outer page panel post primary reader right secondary section site slot space sticky text thread title top unit user visitor wrap wrapper zone""".split()
)
#: What a block's density is divided by where its class or id holds a word of furniture among others.
LOWER = 8
HARD, STRONG, WEAK, FORM = 1, 2, 3, 4


def _kind(tag: str, attributes: str, inside_article: bool) -> int:
    """HARD: furniture or unseen. STRONG, WEAK: marked by class or id. FORM. 0: none."""
    if tag in UNSEEN or tag in FURNITURE or tag == "header" and not inside_article:
        return HARD
    kind = FORM if tag == "form" else 0
    if not attributes or tag in ("html", "body"):
        return kind
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return HARD
        if name == "role" and value in ROLES:
            return HARD
        if name in ("class", "id") and kind not in (STRONG, FORM) and tag not in ("article", "main"):
            for word in value.split():
                tokens = _TOKENS.findall(word)
                if not MARKS.isdisjoint(tokens) and not word.startswith(("has-", "with-", "no-", "is-")):
                    kind = STRONG if all(t in MARKS or t in WITH_MARKS for t in tokens) else kind or WEAK
    return kind


class Page:
    """The nodes of a page in document order (a parent comes before its children), and its pieces of text with their blocks."""

    def __init__(self, source: str):
        self.tag, self.parent, self.kind, self.sign = ["#root"], [-1], [0], [""]
        self.pieces: list[tuple[int, int, str]] = []
        self.stack, self.scopes, self.open = [0], [(-1,) * len(SCOPES)], {}
        self.block = 0
        self.careless = False  # quotes are ignored after the first tag that quotes keep from ending
        at, end = 0, len(source)
        last = source.rfind(">")
        while at < end:
            start = source.find("<", at)
            if start < 0 or start > last and not source.startswith("<!--", start):
                start = end if start < 0 else start
                self._text(source[at:start] if start == end else source[at:])
                break
            if start > at:
                self._text(source[at:start])
            at = self._markup(source, start)

    def _text(self, text: str) -> None:
        if text:
            self.pieces.append((self.stack[-1], self.block, html.unescape(text)))

    def _markup(self, source: str, start: int) -> int:
        """Take the tag, comment or stray character at start; returns where to go on."""
        if source.startswith("<!--", start):
            close = source.find("-->", start + 4)
            return len(source) if close < 0 else close + 3
        if source.startswith("<![CDATA[", start):
            close = source.find("]]>", start + 9)
            close = len(source) if close < 0 else close
            self.pieces.append((self.stack[-1], self.block, source[start + 9 : close]))
            return close + 3
        closing = source.startswith("</", start)
        m = _NAME.match(source, start + 1 + closing)
        if not m:
            if closing or source[start + 1 : start + 2] in ("!", "?"):
                return source.find(">", start) + 1  # there is one: the caller looked
            self.pieces.append((self.stack[-1], self.block, "<"))
            return start + 1
        stop = source.find(">", m.end()) if closing else self._stop(source, m.end())
        name = m[0].lower()
        if name not in INLINE:
            self.block += 1
        if closing:
            if self.open.get(name):
                i = len(self.stack) - 1
                while self.tag[self.stack[i]] != name:
                    i -= 1
                self._pop(i)
            return stop + 1
        if (scope := ENDS.get(name)) is not None and (i := self.scopes[-1][scope]) > 0:
            self._pop(i)
        attributes = source[m.end() : stop]
        node = len(self.tag)
        self.tag.append(name)
        self.parent.append(self.stack[-1])
        self.kind.append(_kind(name, attributes, self.open.get("article", 0) > 0))
        self.sign.append(name + " " + " ".join(sorted(x.split("=", 1)[1].strip("\"'") for x in re.findall(r"class=(?:\"[^\"]*\"|'[^']*')", attributes))) if attributes else name)
        if name in RAW:
            close = re.compile(f"</{name}(?=[\\s/>])[^>]*>", re.I).search(source, stop + 1)
            return close.end() if close else len(source)
        if name not in VOID and not attributes.endswith("/") or name in ("p", "div", "span", "a", "b", "article"):
            self.stack.append(node)
            scopes = self.scopes[-1]
            if name in _SCOPED:
                depth = len(self.stack) - 1
                scopes = tuple(depth if name in ends else -1 if name in limits else now for now, (ends, limits) in zip(scopes, SCOPES, strict=True))
            self.scopes.append(scopes)
            self.open[name] = self.open.get(name, 0) + 1
        return stop + 1

    def _stop(self, source: str, at: int) -> int:
        """Where the tag ends: at the first > that is in no quoted value."""
        first = source.find(">", at)
        pos = at
        while not self.careless:
            pos = (m := _STEP.match(source, pos)).end()
            c = source[pos : pos + 1]
            if c == ">":
                return pos
            if c in ('"', "'"):
                close = source.find(c, pos + 1) if m[0].rstrip().endswith("=") else pos
                if close < 0:
                    self.careless = True
                pos = close + 1
            elif not c:
                self.careless = True
        return first

    def _pop(self, i: int) -> None:
        for n in self.stack[i:]:
            self.open[self.tag[n]] -= 1
        del self.stack[i:], self.scopes[i:]

    def main_text(self) -> str:
        n, parent, tag = len(self.tag), self.parent, self.tag
        own = [0] * n
        unseen, in_link = [False] * n, [False] * n
        for i in range(1, n):
            unseen[i] = unseen[parent[i]] or tag[i] in UNSEEN
            in_link[i] = in_link[parent[i]] or tag[i] == "a"
        for node, _, text in self.pieces:
            own[node] += sum(map(len, text.split()))
        chars = [0 if u else c for c, u in zip(own, unseen, strict=True)]
        link_chars = [c if x else 0 for c, x in zip(chars, in_link, strict=True)]
        tags, link_tags = [0] * n, [0] * n
        for i in range(n - 1, 0, -1):
            if not unseen[i]:
                p = parent[i]
                chars[p] += chars[i]
                link_chars[p] += link_chars[i]
                tags[p] += tags[i] + 1
                link_tags[p] += link_tags[i] + (tag[i] == "a")
        weight = self._weights(own, chars)
        if weight is None:
            return ""
        body = next((i for i in range(n) if tag[i] == "body"), 0)
        body = body if chars[body] == chars[0] else 0
        share = link_chars[body] / chars[body]
        raw = [density(chars[i], tags[i], link_chars[i], link_tags[i], share) if chars[i] else 0.0 for i in range(n)]
        total = [0.0] * n
        for i in range(1, n):
            total[parent[i]] += raw[i] * weight[i]
        blocks = [i for i in range(n) if tag[i] not in INLINE and weight[i] and chars[i]]
        best = max(blocks, key=lambda i: (total[i], -i))
        if not total[best]:
            best = max(blocks, key=lambda i: (raw[i] * weight[i], -i))
        path = [best]
        while path[-1] not in (body, 0):
            path.append(parent[path[-1]])
        on_path = set(path)
        least = min(raw[i] for i in path) / 2
        signs = {parent[i]: self.sign[i] for i in path}
        taken = {best} | {i for i in path[1:] if own[i]}
        inside = [False] * n
        for i in range(n):
            p = parent[i]
            if not weight[i]:
                continue
            if i == best or p >= 0 and inside[p]:
                inside[i] = True
            elif p in on_path and i not in on_path:
                lower = weight[i] / weight[p]
                mostly_text = lower == 1 and chars[i] > 2 * link_chars[i] and (tag[i] in PROSE or tag[i] in INLINE or self.sign[i] == signs[p])
                inside[i] = mostly_text or raw[i] * lower >= least > 0
        found: dict[int, list[str]] = {}
        for node, block, text in self.pieces:
            if inside[node] or node in taken and weight[node]:
                found.setdefault(block, []).append(text)
        return " ".join(t for t in (" ".join("".join(b).split()) for b in found.values()) if t)

    def _weights(self, own: list[int], chars: list[int]) -> list[float] | None:
        """What each node's density is multiplied by. Marks give way where nothing would be left; None: there is no text but furniture's."""
        n, parent = len(self.tag), self.parent
        for strong in (0.0, 1 / LOWER):
            by = {0: 1.0, HARD: 0.0, STRONG: strong, WEAK: 1 / LOWER}
            weight = [1.0] * n
            for i in range(1, n):
                kind = self.kind[i]
                weight[i] = min(weight[parent[i]], (1.0 if 2 * chars[i] > chars[0] else 0.0) if kind == FORM else by[kind])
            if any(c and w for c, w in zip(own, weight, strict=True)):
                return weight
        return None


def density(chars: int, tags: int, link_chars: int, link_tags: int, share: float) -> float:
    """Composite text density. share: the body's link characters by its characters."""
    c, t, lc, lt = chars, max(1, tags), max(1, link_chars), max(1, link_tags)
    base = math.log(c / max(1, c - link_chars) * link_chars + share * c + math.e)
    return c / t * math.log(max(c / lc * t / lt, 1.0)) / max(math.log(base), 1e-3) if base > 1.001 else c / t * math.log(max(c / lc * t / lt, 1.0))


def main_text(source: str | None) -> str:
    return Page(source).main_text() if source else ""


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) for every row of pages."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            text = [main_text(x.as_py()) for x in batch.column("html")]
            return pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())], names=["page_id", "url", "text", "n_chars"])

        return each

    kind = pages.schema["page_id"].dataType.simpleString()
    return arrow_map(pages.select("page_id", "url", "html"), make, f"page_id {kind}, url string, text string, n_chars long")
