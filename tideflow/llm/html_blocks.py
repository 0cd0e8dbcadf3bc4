"""A page's elements and text blocks, in one pass over its markup.

What browsers do with odd markup is followed where it decides which element a text stands in: implied
end tags, end tags without a start, raw text elements, unfinished tags and comments.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from hashlib import blake2b
from html import unescape

# Names of HTML elements and attributes, by their meaning.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th caption figcaption".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A start tag of the key ends an open element of these, up to the nearest of the barriers.
ENDS = {
    "li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "option": ("option", "select optgroup"), "tr": ("tr td th", "table"),
    "td": ("td th", "tr table"), "th": ("td th", "tr table"), "tbody": ("tr td th thead tbody tfoot", "table"), "thead": ("tr td th thead tbody tfoot", "table"), "tfoot": ("tr td th thead tbody tfoot", "table"),
}
#: Elements and names of classes, ids and roles that say a branch is no part of the article.
NOISE_TAGS = frozenset("nav aside footer form button select dialog menu noscript template svg canvas audio video object".split())
NOISE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promoted sidebar menu nav navbar navigation breadcrumb breadcrumbs "
    "topbar footer copyright cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login search "
    "share sharing social related recommended recommendations trending comment comments respond reply replies discussion disqus widget widgets pager pagination toolbar "
    "contentinfo complementary form".split()
)
MAIN_NAMES = frozenset("main article".split())
HEADER_NAMES = frozenset("header masthead".split())

_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)|</[^>]*+(?:>|\Z)", re.S
)
_NAMED = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)(?:hidden(?=[\s/=]|$)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none)""", re.I)
_DIGITS = re.compile(r"\d+")

DROPPED, JUDGED, KEPT = 0, 1, 2


def digest(*parts: object) -> int:
    """64-bit signed hash of a key; the same in every process."""
    return int.from_bytes(blake2b("\x1f".join(map(str, parts)).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


@dataclass(slots=True)
class Element:
    tag: str
    parent: int
    path: int
    noise: bool
    main: bool
    header: bool
    children: list[str] = field(default_factory=list)


@dataclass(slots=True)
class Block:
    node: int
    text: str
    linked: bool
    state: int = JUDGED


def _names(attributes: str) -> tuple[str, bool, bool, bool, bool]:
    """What an element is known by: its class, id and role without digits; whether they say noise, a comment, main text, or a header."""
    words: list[str] = []
    for name, a, b, c in _NAMED.findall(attributes):
        words += (a or b or c).lower().split()
    noise = comment = main = header = False
    for w in words:
        parts = re.split(r"[^a-z]+", w)
        if parts[0] in ("has", "with", "no", "without", "is"):
            continue
        whole = "".join(parts)
        main |= whole in MAIN_NAMES
        noise |= whole in NOISE_NAMES or parts[0] in NOISE_NAMES or parts[-1] in NOISE_NAMES
        header |= whole in HEADER_NAMES or parts[0] in HEADER_NAMES or parts[-1] in HEADER_NAMES
        comment |= any(p in ("reply", "replies") or (p.startswith("comment") and not p.startswith("commentar")) for p in parts)
    return " ".join(sorted({_DIGITS.sub("0", w) for w in words})), noise or comment, comment, main, header


def parse(html: str) -> tuple[list[Element], list[Block]]:
    """Elements (block elements and what lies outside the article by its name) and text blocks in page order."""
    root = Element("", -1, 0, False, False, False)
    elements, blocks = [root], []
    stack: list[tuple[str, int, bool]] = [("", 0, False)]  # open tags, the element each stands in, whether it silences what it holds
    opened: dict[str, int] = {}
    text: list[str] = []
    links = linked_chars = chars = silent = 0
    cache: dict[str, tuple[str, bool, bool, bool, bool]] = {"": ("", False, False, False, False)}
    pos, end = 0, len(html)

    def flush() -> None:
        nonlocal linked_chars, chars
        if text:
            body = " ".join("".join(text).split())
            if body:
                blocks.append(Block(stack[-1][1], body, linked_chars > 0 and linked_chars >= chars))
            text.clear()
        linked_chars = chars = 0

    def pop() -> None:
        nonlocal links, silent
        tag, _, mute = stack.pop()
        opened[tag] -= 1
        silent -= mute
        if tag == "a":
            links -= 1

    while pos < end:
        m = _TOKEN.search(html, pos)
        upto = m.start() if m else end
        if upto > pos and not silent:
            piece = unescape(html[pos:upto])
            text.append(piece)
            n = len(piece) if not piece.isspace() else 0
            chars += n
            linked_chars += n if links else 0
        if not m:
            break
        pos = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag, closing, attributes = tag.lower(), m[1] or m[4], m[3] or m[6] or ""
        if not html.endswith(">", m.start(), m.end()):
            break  # the page ends within the tag
        if closing:
            if not opened.get(tag):
                if tag in BLOCK:
                    flush()
                continue
            if tag not in BLOCK:  # an inline end tag closes nothing beyond its block
                k = len(stack) - 1
                while stack[k][0] != tag and stack[k][0] not in BLOCK:
                    k -= 1
                if stack[k][0] != tag:
                    continue
            else:
                flush()
            while stack[-1][0] != tag:
                pop()
            pop()
            continue
        if tag == "br":
            text.append("\n")
            continue
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, pos)
            if not close:
                break
            tail = html.find(">", close.end())
            pos = end if tail < 0 else tail + 1
            continue
        block = tag in BLOCK
        if block and opened.get("p"):  # a block ends an open paragraph
            k = len(stack) - 1
            while stack[k][0] != "p" and stack[k][0] not in ("td", "th", "table", "button", "caption", "object", "template"):
                k -= 1
            if stack[k][0] == "p":
                flush()
                while len(stack) > k:
                    pop()
        if tag in ENDS:
            ended, barrier = ENDS[tag]
            ended, barrier, k = ended.split(), barrier.split(), len(stack) - 1
            last = 0
            while k > 0 and stack[k][0] not in barrier:
                if stack[k][0] in ended:
                    last = k
                k -= 1
            if last:
                flush()
                while len(stack) > last:
                    pop()
        if tag in VOID:
            if block:
                flush()
            continue
        names = cache.get(attributes)
        if names is None:
            names = cache[attributes] = _names(attributes) if len(attributes) < 4096 else _names(attributes[:4096])
        own, noise, comment, main, header = names
        if tag in ("html", "body"):
            noise = main = header = False
        elif tag in ("article", "main"):
            noise, main, header = comment, not comment, False
        noise = noise or tag in NOISE_TAGS or (attributes != "" and _HIDDEN.search(attributes) is not None)
        at = stack[-1][1]
        if block:
            flush()
            key = f"{tag} {own}" if own else tag
            parent = elements[at]
            if not parent.children or parent.children[-1] != key:  # runs of like siblings count once
                parent.children.append(key)
            elements.append(Element(tag, at, digest(parent.path, key), noise, main, header or tag == "header"))
            at = len(elements) - 1
        if attributes.endswith("/") and not block:
            continue
        mute = noise and not block  # a button or an inline advert breaks no line
        stack.append((tag, at, mute))
        silent += mute
        opened[tag] = opened.get(tag, 0) + 1
        if tag == "a":
            links += 1
    flush()
    _judge(elements, blocks)
    return elements, blocks


def _judge(elements: list[Element], blocks: list[Block]) -> None:
    """Says of each block whether declarations decide it. Within the main region prose stays; elsewhere only pages without such a region keep text."""
    noise, main, header = [False] * len(elements), [False] * len(elements), [False] * len(elements)
    outside = [False] * len(elements)
    for i, e in enumerate(elements[1:], 1):  # a main region may not stand within what is surely none
        outside[i] = outside[e.parent] or e.tag in NOISE_TAGS or (e.noise and e.tag == "article")
    holds = [False] * len(elements)
    for i in range(len(elements) - 1, 0, -1):
        holds[i] |= elements[i].main and not outside[i]
        holds[elements[i].parent] |= holds[i]
    for i, e in enumerate(elements[1:], 1):
        p = e.parent
        main[i] = main[p] or (e.main and not outside[i])
        header[i] = header[p] or e.header
        wraps = holds[i] and not main[i] and e.tag not in NOISE_TAGS  # a wrapper of the article, whatever its class
        noise[i] = noise[p] or ((e.noise or (e.header and not main[i])) and not wraps)
    region = any(main[b.node] and not noise[b.node] for b in blocks)
    prose = [False] * len(elements)
    for i, e in enumerate(elements[1:], 1):
        prose[i] = e.tag in PROSE or (prose[e.parent] and e.tag not in ("div", "section", "ul", "ol"))
    for b in blocks:
        i = b.node
        if noise[i] or (region and not main[i]) or (header[i] and main[i] and elements[i].tag not in HEADINGS):
            b.state = DROPPED
        elif region and (prose[i] or elements[i].main):
            b.state = KEPT
        elif not region and b.linked:
            b.state = DROPPED  # a line of links is a menu
