"""Main text of web pages by tag-path ratios.

A page is read into text blocks, each with its path of open block elements from the root.
A path is its elements with their classes. Per path the text length and the punctuation of its blocks
are added up and divided by their number. Both ratios are smoothed between neighbouring paths: a path borrows from
others by a weight for every element on the way between them, little across containers and classed lists, so a short
heading among long paragraphs counts like those and a box beside them does not. The product of the two smoothed ratios
is compared with the page's best; paths below ``LEAST`` of it are left out, and so are paths, or
small elements, that are mostly links. What stands in a menu, header,
footer, sidebar, form, script or style element never enters the ratios; what has the name of such a thing as
a class, id or role, whole or by its head word, starts with a low factor, which a high ratio overrules.

Null and empty pages, and pages without text, give the empty text. Broken markup is read as
far as it goes: missing end tags are implied, a comment or script without an end runs to
the end of the page, and an unfinished tag at the end is dropped. Repeated rows and
null ids are answered each by itself; extra columns are not read; an empty table gives an
empty result.
"""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

LEAST = 0.2
#: Weights of one step between neighbouring paths in the smoothing: into text elements, generic containers, classed lists.
STEP, BOX, LIST = 0.95, 0.02, 0.005
#: Weight of a step into what stands between blocks of the page's main path, or inside an article.
BETWEEN = 0.5
#: Factor on paths outside the article of a page that has one.
PRIOR = 0.1
#: Factor on paths in an element with the name of a menu, advert or the like: only a much higher ratio overrules it.
NAMED = 0.05
#: Share of link text from which a path, or an element around it with less than half of the page's text, is left out; a list or paragraph
#: of an article without a class may be its sources and stays.
LINKED = 0.6
#: Added to marks per block, so that text without marks is compared by length.
FEW_MARKS = 0.1

# HTML's element kinds.
_RAW = "script|style|noscript|iframe|template|textarea|select|svg|canvas|object|math|title"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "html body address article aside blockquote caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hgroup head hr legend li main menu nav ol p pre section summary "
    "table tbody td tfoot th thead tr ul".split()
)
_ENDS_P = BLOCKS - {"html", "body", "head", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "legend", "summary"}
_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_KEEPS = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
#: Elements that never hold main text, and names that say the same; a header inside an article is its own. A form is one of
#: them unless it holds most of the page's text, as where a whole page is wrapped in one.
OUTSIDE = frozenset("head nav footer aside menu dialog button".split())
_NAMES = re.compile(
    r"ads?|advert\w*|sponsor\w*|promo\w*|banner|nav|navbar|navigation|menu|breadcrumbs?|sidebar|aside|"
    r"footer|header|masthead|comments?|replies|respond|thread|discussion|reactions?|disqus|cookies?|consent|notice|gdpr|popup|modal|newsletter|"
    r"subscribe|signup|login|search|share|sharing|social|related|recommend\w*|widget|pagination|pager|skip"
)
#: Words after a name that say how an element looks or is arranged; the word before them is its head.
_TRAILING = frozenset(
    "area bar block box bottom btn button buttons center container content form group holder icon icons inner item items "
    "large left link links list main menu outer panel posts primary right row secondary section slot small stories "
    "text thread title top unit wide widget wrap wrapper".split()
)
#: Words before a header that make it one of the text, and words that say what a page has or lacks.
_OWN = frozenset("article entry post story content page section".split())
_MODIFIERS = frozenset("has no with without hide is not".split())
_HUMP = re.compile(r"(?<=[a-z0-9])(?=[A-Z])|[^A-Za-z]+")
_ATTRIBUTE = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({_RAW})\b[^>]*+(?:>.*?(?:</\1\s*>|\Z)|\Z)|"
    r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""",
    re.I | re.S,
)
_PUNCTUATION = re.compile(r"[^\w\s]")
_STORY = ("article", "main")
#: Elements that make a container around them a part of the text: it only wraps them.
_HELD = frozenset("h1 table dl pre figure blockquote".split())
_TITLES = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that page templates are made of, against those that texts are made of.
_BOXES = frozenset("div section center body html fieldset details dialog".split())


def _classes(attributes: str) -> str:
    """The class, id and role of an element without numbers, as a part of its path."""
    return " ".join(re.sub(r"\d+", "", "".join(m.groups(""))).strip().lower() for m in _ATTRIBUTE.finditer(attributes)).strip()


def _tokens(attributes: str) -> list[str]:
    return " ".join("".join(m.groups("")) for m in _ATTRIBUTE.finditer(attributes)).split()


def _named(token: str, story: bool) -> bool:
    """Whether a class, id or role is, as a whole or by its head word, the name of something beside the text."""
    words = [w.lower() for w in _HUMP.split(token) if w]
    if not words or words[0] in _MODIFIERS:
        return False
    while len(words) > 1 and words[-1] in _TRAILING:
        words.pop()
    if words[-1] == "header" and (story or _OWN & set(words[:-1])):
        return False
    return _NAMES.fullmatch(words[-1]) is not None


def _outside(name: str, story: bool) -> bool:
    return name in OUTSIDE or name == "header" and not story


class _Path:
    """A root-to-leaf path of the page: its sums, and the first and last block below it."""

    __slots__ = ("chars", "first", "form", "plain", "holds", "kids", "last", "links", "marks", "n", "name", "named", "parent", "story", "weight")

    def __init__(self, parent: _Path | None, name: str, classed: bool, named: bool):
        self.parent, self.name, self.kids = parent, name, {}
        self.story = parent is not None and parent.story or name in _STORY
        self.named = name not in _STORY and (named or parent is not None and parent.named)
        self.weight = LIST if classed and name in ("ul", "ol", "menu") else BOX if name in _BOXES or classed and name == "li" else STEP
        self.plain = self.story and not classed and name not in _BOXES  # a text element or list of the article itself
        self.form = self if name == "form" else parent.form if parent is not None else None
        self.chars = self.links = self.marks = self.n = 0
        self.first, self.last, self.holds = -1, -1, False


def _linked(text: str) -> int:
    return len(" ".join(html.unescape(text).split()))


def blocks(page: str) -> tuple[list[_Path], list[tuple[_Path, str]]]:
    """All paths, parents first, and (path, text) of every text block that is not outside the main text, in page order."""
    found: list[tuple[_Path, str]] = []
    stack: list[tuple[str, bool]] = []  # open elements, and whether they lie outside
    places: defaultdict[str, list[int]] = defaultdict(list)  # of the open elements of each name in the stack
    boxes: list[int] = []  # of the open block elements in the stack
    path = _Path(None, "", False, False)
    paths = [path]
    words: list[str] = []
    hidden = anchors = links = 0

    def flush():
        nonlocal links
        if words:
            text = " ".join(html.unescape("".join(words)).split())
            if text:
                leaf = path
                if path.name in _BOXES:  # text of a container itself has a path beside those of its elements
                    leaf = path.kids.get("")
                    if leaf is None:
                        leaf = path.kids[""] = _Path(path, "", False, False)
                        leaf.weight = BOX
                        paths.append(leaf)
                leaf.chars += len(text)
                leaf.links += min(links, len(text))
                leaf.marks += len(_PUNCTUATION.findall(text))
                leaf.n += 1
                found.append((leaf, text))
            words.clear()
        links = 0

    def close(depth: int):
        nonlocal path, hidden, anchors
        while len(stack) > depth:
            name, out = stack.pop()
            places[name].pop()
            if name in BLOCKS:
                boxes.pop()
            hidden -= out
            anchors -= name == "a"
            if name in BLOCKS:
                flush()
                path = path.parent

    at = 0
    for m in _TOKEN.finditer(page):
        if not hidden and m.start() > at:
            words.append(page[at : m.start()])
            if anchors:
                links += _linked(words[-1])
        at = m.end()
        name = (m[3] or m[6] or "").lower()
        if not name:
            continue
        if m[2] or m[5]:
            # An inline element does not end across the block it is not in.
            if places[name] and (name in BLOCKS or not boxes or boxes[-1] < places[name][-1]):
                close(places[name][-1])
            continue
        attributes = m[4] or m[7] or ""
        if name in VOID:
            if name in BLOCKS:
                flush()
            elif name == "br" and not hidden:
                words.append(" ")
            continue
        if name in BLOCKS:
            if not hidden:
                flush()
            if name in _ENDS_P and boxes and stack[boxes[-1]][0] == "p":
                close(boxes[-1])
            if name in _SAME:
                nearest = max((places[x][-1] for x in _SAME[name] if places[x]), default=-1)
                if nearest > max((places[x][-1] for x in _KEEPS[name] if places[x]), default=-1):
                    close(nearest)
        out = _outside(name, path.story)
        if out and not hidden:
            flush()
        places[name].append(len(stack))
        if name in BLOCKS:
            boxes.append(len(stack))
        stack.append((name, out))
        hidden += out
        anchors += name == "a"
        if name in BLOCKS:
            classed = _classes(attributes) if "=" in attributes else ""
            named = classed and name not in ("html", "body", *_STORY) and any(_named(t, path.story) for t in _tokens(attributes))
            label = (name, classed)
            path.holds = path.holds or name in _HELD
            if label not in path.kids:
                path.kids[label] = _Path(path, name, bool(classed), bool(named))
                paths.append(path.kids[label])
            path = path.kids[label]
    if not hidden:
        words.append(page[at:])
    flush()
    return paths, found


def _spans(paths: list[_Path], found: list[tuple[_Path, str]]) -> dict[_Path, list[int]]:
    """Characters and link characters at or below every path; sets its first and last block."""
    for at, (path, _) in enumerate(found):
        path.first, path.last = at if path.first < 0 else path.first, at
    below = {path: [path.chars, path.links] for path in paths}
    for path in reversed(paths[1:]):
        up = path.parent
        below[up] = [a + b for a, b in zip(below[up], below[path], strict=True)]
        if path.first >= 0:
            up.first = path.first if up.first < 0 else min(up.first, path.first)
            up.last = max(up.last, path.last)
    return below


def path_scores(paths: list[_Path], found: list[tuple[_Path, str]]) -> dict[_Path, float]:
    """The product of the two smoothed ratios of every path with text; 0 where links speak against it."""
    own_last = {path: at for at, (path, _) in enumerate(found)}
    own_first = {path: at for at, (path, _) in reversed(list(enumerate(found)))}
    below = _spans(paths, found)
    whole = below[paths[0]][0]
    story = any(path.story for path, _ in found)
    against = {}
    for path in paths:  # a path of links, and what lies in a small element that is mostly links
        chars, links = below[path]
        against[path] = path.parent is not None and (
            against[path.parent] or links >= LINKED * max(chars, 1) and 2 * chars < whole and path.name not in _TITLES and not path.plain
        )
    ratio = lambda chars, marks, prior: chars * (marks + FEW_MARKS) * prior
    prior = {path: (PRIOR if story and not path.story else 1.0) * (NAMED if path.named else 1.0) for path in own_last}
    main = max(own_last, key=lambda p: (p.chars - p.links) * ratio(p.chars / p.n, p.marks / p.n, prior[p]), default=None)
    holders, path = set(), main
    while path is not None:
        holders.add(path)
        path = path.parent
    start = own_first[main] if main is not None else 0  # a title in an element around the main path starts its text
    for path in own_last:
        if path.name == "h1" and path.parent.name not in ("", "html", "body") and holders & {path.parent, path.parent.parent}:
            start = min(start, path.first)
    sums = {}
    for path in paths:
        mass = math.sqrt(path.chars) if path.n and not against[path] else 0.0
        sums[path] = [mass, mass * path.chars / path.n, mass * path.marks / path.n] if mass else [0.0, 0.0, 0.0]
    step = {}
    for path in paths[1:]:
        weight = path.weight
        if against[path] or path.named and not path.parent.named:
            weight = 0.0
        elif path.holds or path in holders:  # a wrapper of a title, a table or the like, or of the main path
            weight = STEP
        elif path.story or main is not None and start < path.first and path.last < own_last[main]:
            weight = max(weight, BETWEEN)  # inside an article a path falls by its name, its links or ratios far below the best
        step[path] = weight
    for path in reversed(paths[1:]):  # the sums below a path, then those of the whole page as seen from it
        sums[path.parent] = [a + step[path] * b for a, b in zip(sums[path.parent], sums[path], strict=True)]
    for path in paths[1:]:
        w = step[path]
        sums[path] = [b + w * (a - w * b) for a, b in zip(sums[path.parent], sums[path], strict=True)]
    return {
        path: 0.0 if against[path] or not sums[path][0] else ratio(sums[path][1] / sums[path][0], sums[path][2] / sums[path][0], prior[path])
        for path in own_last
    }


def _without_forms(paths: list[_Path], found: list[tuple[_Path, str]]) -> list[tuple[_Path, str]]:
    """The blocks outside of forms; a form with most of the page's text is none."""
    if not any(path.form for path, _ in found):
        return found
    below = {path: path.chars for path in paths}
    for path in reversed(paths[1:]):
        below[path.parent] += below[path]
    small = {path for path in paths if path.name == "form" and 2 * below[path] < below[paths[0]]}
    gone = {}
    for path in paths:  # parents first
        gone[path] = path in small or path.parent is not None and gone[path.parent]
        if gone[path]:
            path.chars = path.links = path.marks = path.n = 0
    return [(path, text) for path, text in found if not gone[path]]


def main_text(page: str) -> str:
    """The blocks on paths that reach the threshold, by two line breaks."""
    paths, found = blocks(page)
    found = _without_forms(paths, found)
    if any(path.story for path, _ in found):  # beside an article a name decides
        found = [(path, text) for path, text in found if path.story or not path.named]
    scores = path_scores(paths, found)
    best = max(scores.values(), default=0.0)
    return "\n\n".join(text for path, text in found if scores[path] >= LEAST * best)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))

    def extracted(batches):
        for batch in batches:
            texts = pa.array([main_text(page) if page else "" for page in batch.column(2).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), texts], ["page_id", "url", "text"])

    found = rows.mapInArrow(extracted, StructType([*rows.schema.fields[:2], *StructType.fromDDL("text string")]))
    return found.withColumn("n_chars", F.length("text").cast("long"))
