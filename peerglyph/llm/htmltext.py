"""HTML extraction by tree scoring.

Paragraphs pass points for their length and commas to their ancestors, fewer with each level; a
container's points are discounted by its link density. The best container is kept with those of its
siblings that hold enough points or prose; lists of links in them are left out. Pages are independent, so
nothing is shuffled, and each takes time linear in its length, however deep or broken its markup is.

Defined results: a null or empty page gives an empty text; markup may be broken at any place; a page of
any length is read whole; repeated rows give equal rows; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import map_text

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
STOP = re.compile(r"[>\"']")
PLAIN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^\"'>]*)>")  # a tag without quotes
RAW = {"script", "style", "template", "textarea", "title", "noscript", "iframe", "noembed", "noframes", "xmp", "svg", "math"}
RAW_END = {t: re.compile(rf"</{t}\b", re.I) for t in RAW}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
DROPPED = {"nav", "footer", "aside", "form", "button", "select", "option", "dialog", "menu", "object", "video", "audio", "canvas", "map", "head", "fieldset"}
PARAGRAPHS = {"p", "pre", "blockquote", "td", "dd", "figcaption"}
LISTS = {"ul", "ol", "dl", "div", "section", "table"}
CLOSES_SAME = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
ATTRIBUTE = re.compile(r"""([a-zA-Z][\w:-]*)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
AWAY = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookie\w*|consent|gdpr|notice|alert|popup|modal|overlay|sidebar|side|widget\w*|menu|nav|navbar|navigation|breadcrumbs?|footer|foot|header|masthead|comments?|commentlist|disqus|respond|replies|reply|share|sharing|social|related|recommend\w*|subscribe|newsletter|signup|login|search|tags?|pager|pagination|skip|hidden|outbrain|taboola)(?:$|[\s_-])", re.I)
GOOD = re.compile(r"article|body|content|entry|main|page|post|story|text", re.I)
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar"}


class Node:
    """An element; ``over`` is the nearest block that holds it. Sums are those of all that isn't left out in it."""

    __slots__ = ("tag", "up", "over", "parts", "away", "good", "chars", "linked", "commas", "links", "points", "block")

    def __init__(self, tag: str, up: Node | None, away: bool = False, good: bool = False):
        self.tag, self.up, self.away, self.good = tag, up, away, good
        self.over = None if up is None else up if up.block else up.over
        self.parts: list[Node | str] = []
        self.chars = self.linked = self.commas = self.links = 0
        self.points: float | None = None
        self.block = tag not in INLINE


def _flags(tag: str, attributes: str) -> tuple[bool, bool]:
    """Whether an element is to be left out, and whether its names speak for prose."""
    if not attributes.strip():
        return tag in DROPPED, tag in ("article", "main")
    found = {m[1].lower(): (m[2] or "").strip("\"'") for m in ATTRIBUTE.finditer(attributes)}
    names = f"{found.get('class', '')} {found.get('id', '')}"
    hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
    away = tag in DROPPED or hidden or found.get("role", "").lower() in ROLES or (tag not in ("html", "body", "article", "main") and bool(AWAY.search(names)))
    return away, tag in ("article", "main") or bool(GOOD.search(names))


class Marks:
    """The page's markup, read from left to right in time linear in its length.

    A quote counts after an equals sign alone. Where quotes are never closed, or hide every ">" to the page's
    end, a tag ends at its next ">"; what is found out about the rest of the page on the way is kept.
    """

    def __init__(self, page: str):
        self.page, self.last = page, page.rfind(">")
        self.none_from = {"\"": len(page), "'": len(page)}  # from where on there is no such quote
        self.dead: set[int] = set()  # places outside quotes from which no ">" outside quotes follows

    def end(self, at: int) -> tuple[int, bool]:
        """The place of the ">" that ends a tag read up to ``at`` (-1 if none), and whether its quotes are sound."""
        page, path, start = self.page, [], at
        if at > self.last:
            return -1, False
        while at not in self.dead:
            path.append(at)
            m = STOP.search(page, at)
            if not m:
                break
            at = m.end()
            if m[0] == ">":
                return m.start(), True
            back = m.start() - 1
            while back > start and page[back].isspace() and m.start() - back < 16:
                back -= 1
            if page[back] == "=" and at < self.none_from[m[0]]:
                close = page.find(m[0], at)
                if close < 0:
                    self.none_from[m[0]] = at
                else:
                    at = close + 1
        self.dead.update(path)
        return page.find(">", start), False

    def __iter__(self) -> Iterator[tuple[int, int, str, bool, str, bool]]:
        """Start and end of each tag or comment, its name (empty for a comment), whether it closes, its attributes, whether it is empty by "/"."""
        page, at = self.page, 0
        while (at := page.find("<", at)) >= 0:
            if page.startswith("<!--", at):
                end = page.find("-->", at + 4)
                end = len(page) if end < 0 else end + 3
                yield at, end, "", False, "", False
                at = end
                continue
            closes = page.startswith("/", at + 1)
            plain = PLAIN.match(page, at)
            name = plain or NAME.match(page, at + 1 + closes)
            if name:
                if plain:
                    end, sound, inside, tag = plain.end() - 1, True, plain[3], plain[2].lower()
                else:
                    end, sound = self.end(name.end())
                    inside, tag = page[name.end() : end], name[0].lower()
                if end < 0:
                    return  # no tag ends any more: what follows is text
                yield at, end + 1, tag, closes, inside if sound else inside.replace('"', " ").replace("'", " "), inside.endswith("/")
                at = end + 1
                if tag in RAW and not closes and not inside.endswith("/"):
                    stop = RAW_END[tag].search(page, at)
                    to = page.find(">", stop.end()) if stop else -1
                    to = len(page) if to < 0 else to + 1
                    yield at, to, "", False, "", False
                    at = to
            elif page.startswith(("<!", "<?", "</"), at):
                end = page.find(">", at)
                if end < 0:
                    return
                yield at, end + 1, "", False, "", False
                at = end + 1
            else:
                at += 1


class Stack:
    """The elements that are open, and at which depths those of each tag are."""

    def __init__(self):
        self.open = [Node("#root", None)]
        self.depths: dict[str, list[int]] = {}
        self.blocks = [0]

    @property
    def now(self) -> Node:
        return self.open[-1]

    def depth(self, *tags: str) -> int:
        """Depth of the innermost open element with one of the tags; 0 if there is none."""
        return max((d[-1] for t in tags if (d := self.depths.get(t))), default=0)

    def push(self, node: Node) -> None:
        if node.block:
            self.blocks.append(len(self.open))
        self.depths.setdefault(node.tag, []).append(len(self.open))
        self.open.append(node)

    def close(self, depth: int) -> None:
        """Close the element at ``depth`` and all in it."""
        while depth and len(self.open) > depth:
            node = self.open.pop()
            self.depths[node.tag].pop()
            if node.block:
                self.blocks.pop()


def parse(page: str) -> Node:
    """A tree of elements and texts; whatever is malformed is closed where a reader would expect it."""
    stack, done = Stack(), 0
    for start, end, tag, closes, attributes, empty in Marks(page):
        if start > done:
            stack.now.parts.append(page[done:start])
        done = end
        if not tag or (tag in RAW and not closes):
            continue
        if closes:
            depth = stack.depth(tag)
            if tag not in INLINE or depth > stack.blocks[-1]:  # an inline element's end doesn't reach out of a block
                stack.close(depth)
            continue
        if tag in ("html", "body") and stack.depth(tag):
            continue
        if tag not in INLINE and tag != "br":  # a block ends an open paragraph
            paragraph = stack.depth("p")
            if paragraph > stack.depth("td", "th", "table", "button", "div", "article", "section", "li"):
                stack.close(paragraph)
        if tag in CLOSES_SAME:
            same = stack.depth(*next((g for g in (("dt", "dd"), ("td", "th")) if tag in g), (tag,)))
            if same > stack.depth(*CLOSES_SAME[tag]):
                stack.close(same)
        if tag == "body" or (tag != "head" and tag not in ("meta", "link", "base")):
            while stack.now.tag == "head":
                stack.close(len(stack.open) - 1)
        away, good = _flags(tag, attributes)
        if tag == "header" and not stack.depth("article"):
            away = True
        node = Node(tag, stack.now, away, good)
        stack.now.parts.append(node)
        if tag not in VOID and not empty:
            stack.push(node)
    if done < len(page):
        stack.now.parts.append(page[done:])
    return stack.open[0]


def _open(node: Node | None, tag: str):
    while node is not None:
        if node.tag == tag:
            yield node
        node = node.up


def _walk(root: Node) -> list[Node]:
    """Elements that aren't left out, parents first."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if not node.away:
            out.append(node)
            stack += [p for p in reversed(node.parts) if isinstance(p, Node)]
    return out


def words_of(node: Node) -> str:
    """Text in page order; blocks and line breaks part words, inline elements don't. Lists of links are left out."""
    out: list[str] = []
    stack: list[Node | str] = [node]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(html.unescape(x) if "&" in x else x)
        elif not x.away and not (x.tag in LISTS and x.links >= 3 and x.linked > 0.6 * x.chars):
            if x.block:
                out.append(" ")
                stack.append(" ")
            stack += reversed(x.parts)
    return " ".join("".join(out).split())


def _score(nodes: list[Node]) -> list[Node]:
    """Points of containers, best first; ties go to the earlier one in the page."""
    for node in reversed(nodes):  # children before parents
        for part in node.parts:
            if isinstance(part, str):
                node.chars += len(" ".join(part.split()))
                node.commas += part.count(",")
            elif not part.away:
                node.chars += part.chars
                node.commas += part.commas
                node.linked += part.chars if part.tag == "a" else part.linked
                node.links += part.links + (part.tag == "a")
    found: dict[int, Node] = {}
    for node in nodes:
        bare = node.tag in ("div", "section", "article", "main", "body", "center", "#root") and any(isinstance(p, str) and p.strip() for p in node.parts)
        if bare:
            text = [p for p in node.parts if isinstance(p, str)]
            chars, commas = sum(len(" ".join(p.split())) for p in text), sum(p.count(",") for p in text)
        elif node.tag in PARAGRAPHS:
            chars, commas = node.chars, node.commas
        else:
            continue
        if not chars:
            continue
        points = (1 + commas + min(chars / 100, 3)) * (1 - node.linked / max(1, node.chars))
        up, level = node if bare else node.over, 0
        while up is not None and level < 5:
            if up.tag != "#root":
                if up.points is None:
                    up.points = 5.0 * up.good
                    found[id(up)] = up
                up.points += points / (1, 2, 4, 6, 8)[level]
                level += 1
            up = up.over
    ranked = list(found.values())
    for node in ranked:
        node.points *= 1 - node.linked / max(1, node.chars)
    order = {id(n): i for i, n in enumerate(nodes)}
    return sorted(ranked, key=lambda n: (-n.points, order[id(n)]))


def extract(page: str | None) -> str:
    """The main text of a page; empty if it has none."""
    if not page:
        return ""
    root = parse(page)
    ranked = _score(_walk(root))
    if not ranked:
        return words_of(root)
    best = ranked[0]
    whole = next((n for n in _open(best.up, "article")), None) or next((n for n in _open(best.up, "main")), None)
    if whole is not None:
        best = whole  # sections of one article belong together
    if best.tag in ("main", "body", "#root") or best.up is None:
        return words_of(best)
    limit = max(3.0, 0.2 * (best.points or 0))
    kept = []
    for part in best.up.parts:
        if part is best:
            kept.append(part)
        elif isinstance(part, Node) and not part.away and (best.tag != "article" or part.tag == "article"):
            # beside an article only other articles are kept: a page of several
            prose = part.tag in PARAGRAPHS and part.chars > 80 and part.linked < 0.25 * part.chars
            if prose or (part.points or 0) >= limit or (part.tag in ("h1", "h2") and part.linked < 0.25 * max(1, part.chars)):
                kept.append(part)
    return " ".join(filter(None, map(words_of, kept)))


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and its length in code points, for each row."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [extract(x) for x in batch.column("html").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return map_text(pages.select(F.col("page_id").cast("long"), "url", "html"), "html", work, "page_id long, url string, text string, n_chars long")
