"""Main text of web pages by tree scoring.

A page becomes a tree of elements (`parse`), each paragraph passes points for its length and its
commas to the elements above it, an element's points are lowered by the share of its text that is
in links, and the best container is kept together with those siblings that score like it or are
plain prose or sections with a heading (`main_text`). An element with a class word of boilerplate goes before that, unless it
looks like the article's wrapper (`_doubted`): then the word only lowers its score. Forms are judged
likewise, as some pages are one form. Work is per row, so pages are spread by the scan alone and no page
depends on another.

Defined results: null or empty html gives an empty text, as does a page without text outside its
menus; broken markup is read as browsers do (unclosed tags end with their parent, unknown ends are
skipped); a page of any length is read whole.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import extended

# Element names of the HTML standard by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg noembed noframes "
                "object select datalist canvas audio video annotation annotation-xml".split())
DROPPED = RAW | frozenset("head nav footer aside button menu dialog fieldset label legend "
                          "option optgroup output progress meter map applet".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt "
                   "fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html "
                   "li main menu nav ol p pre section summary table tbody td tfoot th thead tr "
                   "ul caption".split())
#: An opening tag on the left ends an open element on the right, up to the nearest stop.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}),
        "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
        "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
        "option": ({"option"}, {"select"})}
#: Elements that hold a paragraph: their points go to what is above them.
LEAVES = frozenset("p pre blockquote li td th dd dt h1 h2 h3 h4 h5 h6 figcaption summary".split())
#: Elements above a paragraph that get a share of its points.
REACH = 8
#: Words in class, id or role that mark what is not the article.
UNLIKELY = re.compile(
    r"ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|sidebar|side|aside|menu|"
    r"nav\w*|breadcrumbs?|footer|masthead|topbar|toolbar|comments?|commentlist|disqus|replies|"
    r"respond|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscribe|"
    r"signup|login|share|sharing|social|related|recommend\w*|widget|pagination|pager|search|"
    r"complementary|contentinfo|navigation|dialog|hidden", re.I)
LIKELY = re.compile(r"article|main|content|post|entry|story|text|body", re.I)
#: First words of a class that tells of another element: `has-sidebar` is not a sidebar.
TELLING = re.compile(r"has|have|with|without|no|not|non|is|show|hide", re.I)
#: Words of readers' replies, which may be longer than the article.
REPLIES = re.compile(r"comments?|commentlist|disqus|replies|respond", re.I)
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
#: A short paragraph beside the best container is prose if it ends so.
ENDINGS = frozenset(".!?…。！？:")
#: What a boilerplate word leaves of the score of a container that is kept in spite of it.
LOWERED = 0.7

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)"
    # A quote opens a string right after "=" only.
    r"(?P<attrs>(?:[^>=]|=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'>][^\s>]*)?)*+)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)", re.S)
ATTR = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
NOT_SHOWN = re.compile(r"(?<![\w-])display\s*:\s*none", re.I)
SPACES = re.compile(r"\s+")


class Node:
    __slots__ = ("name", "parent", "children", "dropped", "likely", "doubt", "points", "chars",
                 "linked", "kept")

    def __init__(self, name: str, parent: Node | None, dropped: bool = False,
                 likely: bool = False, doubt: str = ""):
        self.name, self.parent, self.dropped, self.likely = name, parent, dropped, likely
        self.doubt = doubt
        self.children: list = []
        self.points, self.chars, self.linked, self.kept = 0.0, 0, 0, False


def _marked(name: str, attrs: str, in_article: bool) -> tuple[bool, bool, str]:
    """Whether an element is boilerplate by its tag or not shown, whether it looks like text, and
    why its class, id or role, or being a form, lets doubt it: "reply", "likely" (but a whole class
    says it is text), "word" or nothing."""
    if name in DROPPED:
        return True, False, ""
    if name == "header":
        return not in_article, False, ""
    if name == "form" and not attrs:
        return False, False, "word"
    if not attrs or name in ("html", "body", "article", "main"):
        return False, name in ("article", "main"), ""
    hidden, classes = False, []
    for key, value in ATTR.findall(attrs):
        key, value = key.lower(), value.strip("\"'")
        hidden |= key == "hidden" or (key == "style" and bool(NOT_SHOWN.search(value)))
        if key in ("class", "id", "role"):
            classes += [re.split("[_-]+", x.strip("_-")) for x in value.split()]
    likely = any(LIKELY.fullmatch(w) for words in classes for w in words)
    doubted = [w for words in classes if not TELLING.fullmatch(words[0])
               for w in words if UNLIKELY.fullmatch(w)]
    doubt = "" if not doubted else "reply" if any(map(REPLIES.fullmatch, doubted)) else "word"
    if name == "form":
        return hidden, likely, doubt or "word"
    if doubt and any(all(map(LIKELY.fullmatch, words)) for words in classes):
        doubt = "likely"
    return hidden, likely, doubt


def _doubted(root: Node) -> None:
    """Drops the elements in doubt, but for those with a whole class of text, those that hold every
    article and main element of the page, and, on pages without, those with most of its prose."""
    nodes = _elements(root)
    if not any(x.doubt for x in nodes):
        return
    prose, held = {id(x): 0 for x in nodes}, {id(x): 0 for x in nodes}
    for node in reversed(nodes):  # children come after their parents
        if node.name == "a":
            prose[id(node)] = 0
        else:
            prose[id(node)] += sum(len(x.strip()) for x in node.children if isinstance(x, str))
        held[id(node)] += node.name in ("article", "main")
        if node.parent is not None:
            prose[id(node.parent)] += prose[id(node)]
            held[id(node.parent)] += held[id(node)]
    for node in nodes:
        if node.doubt in ("word", "reply"):
            whole = held[id(root)] and held[id(node)] == held[id(root)]
            most = not held[id(root)] and 2 * prose[id(node)] > prose[id(root)]
            node.dropped = not (whole or most) or (node.doubt == "reply" and not whole)


def parse(page: str) -> Node:
    """The tree of a page; children are nodes and strings of decoded text."""
    root = at = Node("#root", None)
    path = [root]  # the open elements
    depths: defaultdict[str, list[int]] = defaultdict(list)  # their places by name, and of all blocks

    def open_(node: Node) -> None:
        nonlocal at
        depths[node.name].append(len(path))
        if node.name in BLOCKS:
            depths["#blocks"].append(len(path))
        path.append(node)
        at = node

    def close(depth: int) -> None:
        """Ends the element at `depth` and all that is open inside it."""
        nonlocal at
        while len(path) > depth:
            node = path.pop()
            depths[node.name].pop()
            if node.name in BLOCKS:
                depths["#blocks"].pop()
        at = path[-1]

    def end_paragraph() -> None:
        inner = depths["#blocks"]
        if inner and path[inner[-1]].name == "p":
            close(inner[-1])

    pos, size = 0, len(page)
    while pos < size:
        start = page.find("<", pos)
        if start < 0:
            start = size
        if start > pos:
            at.children.append(entities.unescape(page[pos:start]))
        if start == size:
            break
        found = TOKEN.match(page, start)
        if not found:
            at.children.append("<")
            pos = start + 1
            continue
        pos = found.end()
        name = found["name"].lower() if found["name"] else None
        if name is None:
            continue
        if found["end"]:
            if depths[name]:
                close(depths[name][-1])
            continue
        if name in VOID:
            if name == "br":
                at.children.append(" ")
            elif name == "hr":
                end_paragraph()
                at.children.append(Node("hr", at))
            continue
        if name in BLOCKS and name not in ("li", "dt", "dd", "tr", "td", "th"):
            end_paragraph()
        elif name in ENDS:
            ended, stops = ENDS[name]
            stop = max((depths[x][-1] for x in stops if depths[x]), default=0)
            first = [(depths[x], bisect(depths[x], stop)) for x in (*ended, "p")]
            inside = [places[n] for places, n in first if n < len(places)]
            if inside:
                close(min(inside))
        child = Node(name, at, *_marked(name, found["attrs"],
                                        bool(depths["article"] or depths["main"])))
        at.children.append(child)
        if name in RAW:
            stop = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(page, pos)
            if stop:
                pos = stop.end()
            elif name in ("script", "style", "textarea", "title"):
                pos = size
            else:
                open_(child)
        elif not found["attrs"].endswith("/") or name in BLOCKS:
            open_(child)
    return root


def _blocks(root: Node) -> list[tuple[Node, str, int]]:
    """Text blocks in page order: (the element that holds the text, text, characters in links)."""
    out: list[tuple[Node, str, int]] = []
    parts: list[str] = []
    state = {"linked": 0, "owner": root}

    def flush() -> None:
        text = SPACES.sub(" ", "".join(parts)).strip()
        if text:
            out.append((state["owner"], text, min(state["linked"], len(text))))
        parts.clear()
        state["linked"] = 0

    stack = [(root, iter(root.children), False, root)]
    while stack:
        node, rest, in_link, owner = stack[-1]
        child = next(rest, None)
        if child is None:
            stack.pop()
            if node.name in BLOCKS:
                flush()
        elif isinstance(child, str):
            if not parts:
                state["owner"] = owner
            parts.append(child)
            if in_link:
                state["linked"] += len(child)
        elif not child.dropped:
            if child.name in BLOCKS:
                flush()
            stack.append((child, iter(child.children), in_link or child.name == "a",
                          child if child.name in BLOCKS else owner))
    flush()
    return out


def main_text(page: str) -> str:
    root = parse(page)
    _doubted(root)
    blocks = _blocks(root)
    if not blocks:
        return ""
    nodes = _elements(root)
    for owner, text, linked in blocks:
        # Points: one for being a paragraph, one a comma, one for each 100 characters (3 at most).
        points = 1 + text.count(",") + text.count("，") + min(len(text) / 100, 3)
        node, step = owner.parent if owner.name in LEAVES else owner, 0
        while node is not None and step <= REACH:
            node.points += points / (2 * step or 1)
            node, step = node.parent, step + 1
        owner.chars += len(text)
        owner.linked += linked
    for node in reversed(nodes):  # children come after their parents
        if node.parent is not None:
            node.parent.chars += node.chars
            node.parent.linked += node.linked

    def score(node: Node) -> float:
        return (node.points + (25 if node.likely else 0)) * (
            1 - node.linked / max(node.chars, 1)) * (LOWERED if node.doubt else 1)

    best = max((x for x in nodes if x.chars), key=score)
    best.kept = True
    if best.parent is not None:
        least = max(10.0, 0.2 * score(best))
        ended = {id(owner) for owner, text, _ in blocks if text[-1] in ENDINGS}
        headed: dict[int, bool] = {}  # elements that hold a heading
        for node in reversed(nodes):
            if headed.get(id(node)) or (node.name in HEADINGS and node.chars):
                headed[id(node)] = headed[id(node.parent)] = True
        for node in best.parent.children:
            if isinstance(node, str) or node.dropped or node is best or not node.chars:
                continue
            prose = node.name in ("p", *HEADINGS) and 4 * node.linked < node.chars and (
                node.chars > 80 or node.name != "p" or id(node) in ended and not node.linked)
            section = (node.name in ("article", "section", "div") and not node.doubt
                       and 4 * node.linked < node.chars and headed.get(id(node), False))
            node.kept = score(node) >= least or prose or section
    for node in nodes:
        node.kept = node.kept or (node.parent is not None and node.parent.kept)
    return "\n\n".join(text for owner, text, _ in blocks if owner.kept)


def _elements(root: Node) -> list[Node]:
    """Every element that is not dropped, parents before children."""
    found = [root]
    for node in found:
        found += [x for x in node.children if not isinstance(x, str) and not x.dropped]
    return found


def extract(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """`pages` without `html_col`, with `text_col` (its main text) and `n_chars`, its code points.

    Columns of `pages` that bear these two names are replaced.
    """
    keep = [c for c in pages.columns if c not in (html_col, text_col, "n_chars")]
    whole = "__html"
    while whole in {c.lower() for c in keep}:
        whole += "_"
    narrow = pages.select(*keep, F.col(html_col).cast("string").alias(whole))
    schema = extended(narrow.drop(whole), f"`{text_col}` string, n_chars long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) if x else "" for x in batch.column(whole).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in keep], pa.array(texts, pa.string()),
                 pa.array(map(len, texts), pa.int64())], names=[*keep, text_col, "n_chars"])

    return narrow.mapInArrow(run, schema)
