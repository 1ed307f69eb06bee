"""Operator 5, HTML extraction: tree scoring.

Every paragraph passes points for its length and commas to its ancestors,
discounted by the share of its text that stands in links. The container with
the most points and those of its siblings that look like more of the same
text are kept, boilerplate inside them is not.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernel

# HTML element names by role, and words in class or id that mark boilerplate.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math".split())
BOILERPLATE = frozenset("nav header footer aside form button select option label menu dialog fieldset object audio video canvas".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - {"body", "html", "head"}
CONTAINERS = frozenset("article main section div td body blockquote html center".split())
UNLIKELY = re.compile(r"(?:^|[\s_-])(?:ad|ads|advert\w*|adsense|banner|breadcrumbs?|comments?|commentlist|replies|respond|cookies?|consent|notices?|alert|disclaimer|footer|footnav|header|masthead|menu|nav|navbar|navigation|newsletter|pager|pagination|popup|modal|promo\w*|related|recommend\w*|share|sharing|social|sidebar|sponsor\w*|subscribe|tags|toolbar|widget|rail)(?:$|[\s_-])", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar alert dialog".split())
CHAR_POINTS, COMMA_POINTS, DECAY = 0.01, 1.0, 0.5

# the last but one part is a tag with a quote that never ends: up to the next ">"
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*>?|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<rest2>[^>]*)(?:>|$)|[^<]+|<", re.S)
_ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


class Node:
    __slots__ = ("tag", "parent", "children", "skip", "score", "text", "linked")

    def __init__(self, tag: str, parent: Node | None, skip: bool):
        self.tag, self.parent, self.skip = tag, parent, skip
        self.children: list[Node | str] = []
        self.score = 0.0
        self.text = self.linked = 0


def parse(source: str) -> Node:
    """A forgiving tree: unclosed elements end with their parent, an opening
    block ends an open paragraph, an unknown closing tag is ignored."""
    root = here = Node("html", None, False)
    opened: list[Node] = [root]
    count: Counter = Counter(("html",))

    def close(i: int) -> None:
        nonlocal here
        for x in opened[i:]:
            count[x.tag] -= 1
        del opened[i:]
        here = opened[-1]

    at, n = 0, len(source)
    while at < n:
        m = _TOKEN.match(source, at)
        at = m.end()
        tag = m["tag"] or m["tag2"]
        rest = m["rest"] if m["tag"] else m["rest2"]
        if tag is None:
            if (s := m[0])[0] != "<" or s == "<":
                here.children.append(s)
            continue
        tag = tag.lower()
        if m["end"] or m["end2"]:
            # the count spares a search of all open elements for a tag that is not open
            for i in range(len(opened) - 1, 0, -1) if count[tag] else ():
                if opened[i].tag == tag:
                    close(i)
                    break
            continue
        if tag in RAW:
            if not rest.endswith("/") or tag in ("script", "style", "title", "textarea"):
                end = re.compile(rf"</{tag}\s*>", re.I).search(source, at)
                at = end.end() if end else n
            continue
        if tag in CLOSES_P:
            inner = "li" if tag == "li" else "p"
            for i in range(len(opened) - 1, 0, -1) if count[inner] else ():
                if opened[i].tag == inner:
                    close(i)
                    break
                if opened[i].tag in CONTAINERS or opened[i].tag in ("table", "ul", "ol"):
                    break
        if tag in ("html", "body") and here is root:
            continue
        skip = here.skip or tag in BOILERPLATE
        if rest and not skip:
            kept = {a.lower(): b or c or d for a, b, c, d in _ATTR.findall(rest)}
            marks = f"{kept.get('class', '')} {kept.get('id', '')}"
            skip = bool(tag not in ("html", "body", "article", "main") and marks.strip() and UNLIKELY.search(marks)) or "hidden" in kept or kept.get("role", "").lower() in ROLES or kept.get("aria-hidden", "") == "true" or bool(re.search(r"display\s*:\s*none", kept.get("style", "")))
        node = Node(tag, here, skip)
        here.children.append(node)
        if tag not in VOID:
            opened.append(node)
            count[tag] += 1
            here = node
    return root


def _all(root: Node) -> list[Node]:
    """All nodes, parents before children."""
    out = [root]
    for x in out:
        out += [y for y in x.children if not isinstance(y, str)]
    return out


def blocks(top: Node) -> list[tuple[Node, str, int]]:
    """Blocks of text below ``top`` in page order: the block element that
    holds each, its text, its characters inside links."""
    out: list[tuple[Node, str, int]] = []
    parts: list[str] = []
    linked = 0

    def flush(owner: Node) -> None:
        nonlocal linked
        if parts:
            if text := " ".join(html.unescape("".join(parts)).split()):
                out.append((owner, text, linked))
            parts.clear()
        linked = 0

    # iterative, since pages may nest deeply
    stack: list[tuple[Node, int, Node, bool]] = [(top, 0, top, False)]
    while stack:
        node, i, owner, link = stack.pop()
        if i == 0 and node.tag in BLOCK:
            flush(owner if not stack else stack[-1][2])
            owner = node
        while i < len(node.children):
            x = node.children[i]
            i += 1
            if isinstance(x, str):
                parts.append(x)
                if link:
                    linked += len(x)
            elif x.skip:
                if x.tag in BLOCK:
                    flush(owner)
            elif x.tag == "br":
                parts.append("\n")
            elif x.tag == "hr":
                flush(owner)
            elif x.children:
                stack += [(node, i, owner, link), (x, 0, owner, link or x.tag == "a")]
                break
        else:
            if node.tag in BLOCK:
                flush(node)
    return out


def extract(source: str) -> str:
    """The main text of a page, its blocks joined by newlines."""
    root = parse(source)
    for owner, text, linked in blocks(root):
        points = (1 + COMMA_POINTS * text.count(",") + CHAR_POINTS * len(text)) * (1 - min(1.0, linked / len(text)))
        node = owner if owner.tag in CONTAINERS else owner.parent or owner
        node.score += points
        node.text += len(text)
        node.linked += linked
    nodes = _all(root)
    for x in reversed(nodes):  # each passes on what it has got from below
        if x.parent is not None:
            x.parent.score += x.score * (DECAY if x.tag in CONTAINERS else 1.0)
            x.parent.text += x.text
            x.parent.linked += x.linked
    scored = [x for x in nodes if x.tag in CONTAINERS and x.text]
    if not scored:
        return ""
    best = max(scored, key=lambda x: x.score * (1 - x.linked / max(1, x.text)))
    up = best
    while up is not None:  # a part of an article or of the main element stands for the whole of it
        if up.tag in ("article", "main"):
            best = up
        up = up.parent
    if best.parent is None:
        return "\n".join(t for _, t, _ in blocks(best))
    kept: list[str] = []
    for x in best.parent.children:
        if isinstance(x, str) or x.skip:
            continue
        found = blocks(x)
        size, linked = sum(len(t) for _, t, _ in found), sum(n for _, _, n in found)
        alike = x.tag == best.tag and x.score >= 0.2 * best.score or x.tag in ("p", "h1", "h2", "pre", "blockquote", "ul", "ol", "table")
        if x is best or size and linked < 0.3 * size and alike:
            kept += [t for _, t, _ in found]
    return "\n".join(kept)


def main_text(pages: DataFrame, source: str = "html") -> DataFrame:
    """``pages`` without ``source``, with ``text`` (empty if none).

    A null or empty page gives an empty text; pages of any size are parsed
    whole; repeated rows one by one; a column named ``text`` is replaced. One
    pass over the rows, no shuffle.
    """
    base = pages.drop("text") if source != "text" else pages
    keep = [c for c in base.columns if c != source]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernel.slices(batches, source):
            out = [extract(x.decode("utf-8", "replace")) for x in kernel.raw(batch.column(source))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(out, pa.string())], names=[*keep, "text"])

    return base.mapInArrow(run, kernel.extended(base.select(*keep).schema, text="string"))
