"""HTML extraction by consensus host paths.

Each page votes, in Spark, for the container that scores best on it: its text outside links and boilerplate, less a
share for what lies outside paragraphs. A vote names the container's generalised path: a digest of the tags from the root
with their classes, digits dropped. Votes are summed by host and path; the path with most votes wins its host, and every page is
extracted again from the containers on the winning path, or from its own best one if it has none there. Where containers on
that path differ in their classes' digits (columns of a grid), those with the classes that score best are taken. A headline
belongs to the article if it stands in its container. A form that spans most of a page and holds headlines or paragraphs
wraps it and isn't boilerplate. The page itself counts as a container, as its body tag may be left out. A class, id or role marks boilerplate only if the name as a whole
says so (MARKS and PLAIN words alone), and a header inside an article belongs to it. Where marked wrappers hold all text,
their marks are passed over. Reading takes time in proportion to the page, however many elements are left open.

Nulls, ties and odd input: null html is empty and gives an empty text; a null or odd url belongs to the host ""; equal
votes go to the path first in order; repeated rows vote and are answered each; broken markup (tags left open, tags cut off
at the end, stray ends) is read as far as it goes; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, salted, stored

RESULT = "page_id long, url string, text string, n_chars long"
SALTS = 64
#: Hosts whose winners are broadcast: at most so many rows of two short strings; beyond, pages are shuffled to them.
MOST_BROADCAST = 50_000
#: The path of the page itself.
ROOT = ">"

# HTML elements by kind.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe"}
SKIPPED = {"nav", "footer", "aside", "form", "button", "select", "option", "menu", "dialog", "head", "audio", "video", "canvas", "svg"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "label", "math", "mfrac", "mi", "mn", "mo", "mover", "mrow", "mspace", "msqrt", "mstyle", "msub", "msubsup", "msup", "mtext", "munder", "semantics"}
CONTAINERS = {"article", "main", "section", "div", "td", "body", "center", "blockquote"}
ENDS_PARAGRAPH = {"address", "article", "aside", "blockquote", "center", "details", "dialog", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
# Words of class, id and role names that mark what is not the article, and words that may stand beside them.
MARKS = {
    "ad", "ads", "advert", "advertisement", "adverts", "banner", "breadcrumb", "breadcrumbs", "byline", "comment", "comments", "complementary", "consent", "contentinfo", "cookie", "cookies", "disqus", "footer", "form", "gdpr", "header", "login",
    "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "pager", "pagination", "popup", "promo", "promoted", "related", "replies", "reply", "respond", "search", "share", "sharing", "sidebar", "signup", "social",
    "sponsor", "sponsored", "subscribe", "toolbar", "widget",
}
PLAIN = {
    "area", "article", "articles", "bar", "block", "bottom", "box", "button", "buttons", "col", "column", "container", "content", "desktop", "entry", "global", "google", "group", "icons", "inner", "item", "items", "js", "left", "legal", "link", "links",
    "list", "main", "mobile", "more", "outer", "overlay", "page", "panel", "policy", "post", "posts", "primary", "reader", "readers", "region", "right", "row", "secondary", "section", "site", "slot", "sticky", "stories", "story", "this", "thread", "top",
    "unit", "us", "user", "users", "wp", "wrap", "wrapper",
}

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
#: Attributes one after the other, so that what stands within quotes is none.
_ATTRIBUTE = re.compile(r"""([^\s=>"'/]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_TOLD = {"class", "id", "role", "hidden", "aria-hidden"}
_FORM_END = re.compile("</form", re.I)
_ARTICLE_LIKE = re.compile(r"<(?:h1|article|main)\b|(?:<p\b.*?){3}", re.I | re.S)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_WHITE = re.compile(r"\s+")
#: Places of the elements that end an open one of their kind, and the elements beyond which they don't look for it.
_PEERS = {"p": 0, "li": 1, "dt": 2, "dd": 2, "tr": 3, "td": 4, "th": 4}
_LISTS = {"ul", "ol", "dl", "table"}


class Node:
    """An open element. exact: its own classes, whole; open: for each place of _PEERS the depth of the one in reach, or 0; block: the nearest element that isn't inline; marks: how many inline elements of each tag are open right in it."""

    __slots__ = ("tag", "path", "exact", "skip", "article", "linked", "prose", "open", "block", "marks", "text", "links", "paragraphs")

    def __init__(self, tag: str, path: str, exact: str, skip: bool, above: Node | None, depth: int, inline: bool):
        self.tag, self.path, self.exact, self.skip = tag, path, exact, skip
        self.text = self.links = self.paragraphs = 0
        if above is None:
            self.article = self.linked = self.prose = False
            self.block, self.marks, self.open = self, Counter(), (0, 0, 0, 0, 0)
            return
        self.open, self.article, self.prose = above.open, above.article, above.prose
        self.linked = above.linked or tag == "a"
        if inline:
            self.block, self.marks = above.block, None
            return
        self.block, self.marks = self, Counter()
        if tag in _PEERS or tag in CONTAINERS or tag in _LISTS:
            self.article, self.prose = above.article or tag in ("article", "main"), above.prose or tag == "p"
            places = list(above.open)
            if tag in CONTAINERS:
                places[0] = 0
            if tag in _LISTS:
                places[1:] = 0, 0, 0, 0
            if tag == "tr":
                places[4] = 0
            if tag in _PEERS:
                places[_PEERS[tag]] = depth
            self.open = tuple(places)


def marks_off(name: str, inside: bool) -> bool:
    """Whether a class, id or role name as a whole marks what is not the article; inside: of an article or main."""
    words = [w.lower() for w in _WORD.findall(name)]
    own = [w for w in words if w in MARKS and not (inside and w == "header")]
    return bool(own) and all(w in PLAIN or w in MARKS for w in words)


def described(attributes: str, heed: bool, inside: bool) -> tuple[str, str, bool]:
    """The generalised classes, the whole ones, and whether the element is boilerplate by its class, id or role."""
    classes, exact, marked = "", "", False
    for name, value in _ATTRIBUTE.findall(attributes):
        if (name := name.lower()) not in _TOLD:
            continue
        value = value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            marked = True
        elif name != "aria-hidden":
            marked = marked or heed and any(marks_off(x, inside) for x in value.split())
            if name == "class":
                exact = " ".join(sorted(set(value.lower().split())))
                classes = ".".join(sorted({re.sub(r"[\d_-]+", "", c) for c in value.lower().split()} - {""}))
    return classes, exact, marked


_paths: dict[tuple[str, str, str], str] = {}


def path_below(path: str, tag: str, classes: str) -> str:
    """A 128-bit digest of the whole generalised path."""
    key = (path, tag, classes)
    if key not in _paths:
        if len(_paths) >= 100_000:
            _paths.clear()
        _paths[key] = hashlib.blake2b(f"{path}>{tag}.{classes}".encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()
    return _paths[key]


def walk(page: str, heed: bool = True):
    """Events of a page in order: ("in", node, parents), ("out", node), ("text", raw, nodes), ("break",)."""
    stack, opened, at, end = [Node("", "", "", False, None, 0, False)], Counter(), 0, len(page)
    form_end, wraps = 0, False

    def close():
        node = stack.pop()
        (node.block.marks if node.marks is None else opened)[node.tag] -= 1
        return "out", node, stack

    while at < end:
        found = _TOKEN.search(page, at)
        if found is None:
            yield "text", page[at:], stack
            break
        if found.start() > at:
            yield "text", page[at : found.start()], stack
        at = found.end()
        closing, tag, attributes = (found[1], found[2], found[3]) if found[2] else (found[4], found[5], found[6])
        if not tag:
            continue
        tag = tag.lower()
        inline = tag in INLINE
        if closing:
            # an inline end closes none of the blocks around it
            if (stack[-1].block.marks if inline else opened)[tag] > 0:
                while True:
                    event = close()
                    yield event
                    if event[1].tag == tag:
                        break
            elif not inline:
                yield "break", None, stack
            continue
        if tag in RAW:
            done = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = done.end() if done else end
            continue
        if tag in VOID:
            yield ("space" if inline else "break"), None, stack
            continue
        depth = stack[-1].open[0 if tag in ENDS_PARAGRAPH else _PEERS[tag]] if tag in ENDS_PARAGRAPH or tag in _PEERS else 0
        while depth and len(stack) > depth:
            yield close()
        above = stack[-1]
        classes, exact, marked = described(attributes, heed, above.article) if attributes else ("", "", False)
        article = tag in ("article", "main", "body", "html")
        boilerplate = tag in SKIPPED
        if tag == "form":
            if form_end < at:
                found = _FORM_END.search(page, at)
                form_end = found.start() if found else end
                wraps = 2 * (form_end - at) >= end and _ARTICLE_LIKE.search(page, at, form_end) is not None
            boilerplate = not wraps
        skip = above.skip or boilerplate or (marked and not article) or (tag == "header" and not above.article)
        node = Node(tag, above.path if inline else path_below(above.path, tag, classes), exact, skip, above, len(stack), inline)
        (node.block.marks if inline else opened)[tag] += 1
        stack.append(node)
        yield "in", node, stack
    while len(stack) > 1:
        yield close()


def best_path(page: str, heed: bool = True) -> tuple[str, float]:
    """The path of the container with the best score, and its share of the page's text; "" without text. heed: whether marked wrappers are skipped."""
    best, score, total, stack = "", 0.0, 0, []
    for event, what, stack in walk(page, heed):
        if event == "text":
            if not stack[-1].skip:
                n = len(what.strip())
                stack[-1].text += n
                total += n
                if stack[-1].linked:
                    stack[-1].links += n
                elif stack[-1].prose or stack[-1].tag in ("h1", "h2", "h3", "h4", "li", "pre"):
                    stack[-1].paragraphs += n
        elif event == "out":
            if what.tag in CONTAINERS and not what.skip:
                # nested containers: an outer one must hold clearly more to win, as text counts less where it isn't direct
                value = (what.paragraphs + 0.3 * (what.text - what.paragraphs) - what.links) * (1.2 if what.tag in ("article", "main") else 1.0)
                if value > score:
                    best, score = what.path, value
            share = 0.9 if what.tag in CONTAINERS else 1.0
            stack[-1].text += share * what.text
            stack[-1].links += share * what.links
            stack[-1].paragraphs += share * what.paragraphs
    if stack:
        root = stack[0]
        value = root.paragraphs + 0.3 * (root.text - root.paragraphs) - root.links
        # without any other container even a page of links is its own text
        if value > score or total and not best:
            best, score = ROOT, max(value, 0.0)
    return best, score / max(total, 1)


def text_at(page: str, path: str, heed: bool = True) -> str:
    """The text of the outermost containers on a path, of the classes that score best: blocks in page order, white space as one space, one line end between."""
    found: list[tuple[str, list[str]]] = []
    scores: Counter[str] = Counter()
    blocks, held, open_at = [], [], ROOT if path == ROOT else None

    def flush():
        if block := _WHITE.sub(" ", html.unescape("".join(held))).strip():
            blocks.append(block)
        held.clear()

    for event, what, stack in walk(page, heed):
        if open_at is None:
            if event == "in" and what.path == path and what.tag in CONTAINERS and not what.skip:
                open_at = what
            continue
        if event == "text":
            if not stack[-1].skip:
                held.append(what)
                if open_at is not ROOT:
                    prose = stack[-1].prose or stack[-1].tag in ("h1", "h2", "h3", "h4", "li", "pre")
                    scores[open_at.exact] += len(what.strip()) * ((1.0 if prose else 0.3) - stack[-1].linked)
        elif event == "space":
            held.append(" ")
        elif event == "break" or what.tag not in INLINE:
            flush()
        if event == "out" and what is open_at:
            found.append((what.exact, blocks))
            blocks, open_at = [], None
    flush()
    if path == ROOT:
        return "\n".join(blocks)
    best = min(scores, key=lambda exact: (-scores[exact], exact), default="")
    return "\n".join(block for exact, own in found if exact == best for block in own)


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def winning_paths(pages: DataFrame) -> DataFrame:
    """host, path: by host the path with most votes, each page's vote weighing its container's share of its text."""

    @F.pandas_udf("path string, share double")
    def vote(pages: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([best_path(p or "") for p in pages], columns=["path", "share"])

    votes = pages.select(host_of(F.col("url")).alias("host"), vote(F.coalesce("html", F.lit(""))).alias("vote")).where("vote.path != ''")
    sums = votes.groupBy("host", "vote.path").agg(F.sum(F.round("vote.share", 6)).alias("votes"))
    best = sums.groupBy("host").agg(F.min(F.struct((-F.round("votes", 3)).alias("less"), F.col("path"))).alias("best"))
    return best.select("host", "best.path")


def extract_pages(pages: DataFrame) -> DataFrame:
    """RESULT for every row of pages."""
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    winners = stored(winning_paths(rows), "host-paths")
    keyed = rows.withColumn("host", host_of(F.col("url")))
    if winners.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        joined = keyed.join(F.broadcast(winners), "host", "left")
    else:
        salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")
        joined = keyed.withColumn("salt", salt).join(salted(winners, SALTS), ["host", "salt"], "left")

    def extract(batches):
        import pyarrow as pa

        for some in chunks(batches):
            texts = []
            for r in some:
                text = text_at(r["html"], r["path"]) if r["path"] else ""
                if not text:
                    own, _ = best_path(r["html"])
                    text = text_at(r["html"], own) if own else ""
                if not text:
                    own, _ = best_path(r["html"], heed=False)
                    text = text_at(r["html"], own, heed=False) if own else ""
                texts.append(text)
            columns = [pa.array([r["page_id"] for r in some], pa.int64()), pa.array([r["url"] for r in some], pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    return joined.select("page_id", "url", "html", "path").mapInArrow(extract, RESULT)
