"""Main text of web pages by scoring the element tree (operator 10)."""

from __future__ import annotations

import re
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"""([^\s=/"'>]+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")

#: Elements whose content is not markup; all that lies in them goes.
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that are never part of the article.
DROPPED = frozenset("head nav header footer aside form button select option dialog menu svg canvas audio video object fieldset input".split())
#: Elements that begin and end a block of text.
BLOCKS = frozenset(
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr caption blockquote pre figure figcaption address details summary center hgroup hr".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPHS = frozenset("p pre blockquote td li dd".split())
#: Words that page furniture goes by in a class or id.
FURNITURE = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert nav navbar navigation menu sidebar "
    "footer header masthead comment comments disqus respond replies share sharing social related recommended newsletter subscribe subscription signup popup modal overlay breadcrumb breadcrumbs "
    "pagination pager toolbar login search skip".split()
)
#: Those of them that stand for what readers write.
READERS = frozenset("comment comments disqus respond replies".split())
#: Words beside them that say nothing: a name is furniture's if all its words are of the two kinds.
NEUTRAL = frozenset(
    "site page main top bottom left right center inner outer wrap wrapper box bar block panel section area container content list item items links link buttons button icons icon slot unit "
    "widget module group row col column bg fixed sticky reader readers user post posts article articles form text title head body global primary secondary mobile desktop js is has".split()
)
#: Roles of elements that are never part of the article.
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_SIDES = frozenset("has with no without is".split())
#: Text this long in a furniture's element, and most of the page's points, are no furniture.
_LONG = 200
#: A tag that begins ends the open ones of these kinds.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
class Element:
    """An element; ``named`` says that its class or id is furniture's: 1, or 2 if readers' comments'."""

    __slots__ = ("tag", "parent", "inside", "gone", "named", "points", "text", "linked", "commas")

    def __init__(self, tag, parent, gone=False, named=0):
        self.tag, self.parent, self.gone, self.named = tag, parent, gone, named
        self.inside: list = []
        self.points, self.text, self.linked, self.commas = 0.0, 0, 0, 0


def _furniture(tag: str, attrs: str) -> tuple[bool, int]:
    """Whether an element is furniture for sure, and whether (1, or 2 for comments) by its name only."""
    if tag in DROPPED:
        return True, 0
    if tag in ("html", "body", "main", "article") or not attrs.strip("/ \n"):
        return False, 0
    named = 0
    for name, value in _ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "role" and value.lower() in ROLES or name == "aria-hidden" and value.lower() == "true":
            return True, 0
        if name == "style" and "display:none" in value.replace(" ", "").lower():
            return True, 0
        if name in ("class", "id"):
            for each in value.split():
                words = [w.lower() for w in _WORD.findall(each)]
                if words and words[0] not in _SIDES and FURNITURE.intersection(words) and all(w in FURNITURE or w in NEUTRAL or w.isdigit() for w in words):
                    named = max(named, 1 + (not READERS.isdisjoint(words)))
    return False, named


def parse(html: str) -> Element:
    """The element tree. Unclosed, misnested and cut-off markup is read as far as it goes; nothing recurses."""
    root = Element("html", None)
    stack, open_tags, at = [root], {}, 0

    def close(to: int) -> None:
        while len(stack) > to:
            open_tags[stack.pop().tag] -= 1

    def text(part: str) -> None:
        if part:
            stack[-1].inside.append(part)

    while at < len(html):
        lt = html.find("<", at)
        if lt < 0:
            text(html[at:])
            break
        text(html[at:lt])
        m = _TOKEN.match(html, lt)
        if not m:
            text("<")
            at = lt + 1
            continue
        at = m.end()
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            continue
        if m["end"] or m["end2"]:
            if open_tags.get(tag):
                k = len(stack) - 1
                while stack[k].tag != tag and (tag in BLOCKS or stack[k].tag not in BLOCKS):
                    k -= 1
                if stack[k].tag == tag and k:
                    close(k)
            continue
        attrs = m["attrs"] or m["attrs2"] or ""
        if tag in RAW:
            if not attrs.endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(html, at)
                at = end.end() if end else len(html)
            continue
        if tag == "html" or tag == "body" and open_tags.get("body"):
            continue
        if tag == "body" and open_tags.get("head"):
            k = next(i for i, e in enumerate(stack) if e.tag == "head")
            close(k)
        if tag in BLOCKS and open_tags.get("p"):
            k = len(stack) - 1
            while k and stack[k].tag != "p" and stack[k].tag not in BLOCKS:
                k -= 1
            if stack[k].tag == "p":
                close(k)
        if tag in _ENDS and any(open_tags.get(t) for t in _ENDS[tag]):
            k, scope, found = len(stack) - 1, _SCOPE[tag], 0
            while k and stack[k].tag not in scope:
                found = k if stack[k].tag in _ENDS[tag] else found
                k -= 1
            if found:
                close(found)
        e = Element(tag, stack[-1], *_furniture(tag, attrs))
        stack[-1].inside.append(e)
        if tag not in VOID and not attrs.endswith("/"):
            stack.append(e)
            open_tags[tag] = open_tags.get(tag, 0) + 1
    return root


def _measure(root: Element) -> list[Element]:
    """All elements that stay, parents first; each one's letters of text and of text in links, and commas."""
    order, todo = [], [root]
    while todo:
        e = todo.pop()
        if not e.gone:
            order.append(e)
            todo += [c for c in e.inside if isinstance(c, Element)]
    for e in order:
        e.text = e.linked = e.commas = 0
    for e in reversed(order):
        e.text += sum(len(c.strip()) for c in e.inside if isinstance(c, str))
        e.commas += sum(c.count(",") + c.count("、") for c in e.inside if isinstance(c, str))
        if e.tag == "a":
            e.linked = e.text
        if e.parent is not None:
            e.parent.text += e.text
            e.parent.linked += e.linked
            e.parent.commas += e.commas
    return order


def _density(e: Element) -> float:
    return e.linked / e.text if e.text else 0.0


def _score(order: list[Element]) -> None:
    """Points of all containers. A paragraph has a point, one a comma and one a hundred characters (three at most), discounted by
    the share of its text in links.

    Its parent gets all of them, the grandparent half, those above (all of them) a share that falls with the distance.
    """
    for e in order:
        e.points = 0.0
    passed: dict[Element, list[tuple[float, int]]] = {}
    for e in reversed(order):  # children first, so each element passes on what reached it once
        carried: dict[int, float] = {}
        for points, far in passed.pop(e, ()):
            e.points += points / (1 if far == 0 else 2 if far == 1 else 3 * far)
            carried[min(far + 1, _FAR)] = carried.get(min(far + 1, _FAR), 0.0) + points
        own = e.tag in PARAGRAPHS or e.tag in _BOXES and any(isinstance(c, str) and c.strip() for c in e.inside)
        if own and e.text:
            if e.tag in PARAGRAPHS:
                n, commas = e.text, e.commas
            else:
                text = " ".join(c for c in e.inside if isinstance(c, str)).strip()
                n, commas = len(text), text.count(",") + text.count("、")
            points = (min(1.0, n / 25) + commas + min(n // 100, 3)) * (1 - _density(e))
            if e.tag in PARAGRAPHS:
                carried[0] = carried.get(0, 0.0) + points
            else:
                e.points += points
                carried[1] = carried.get(1, 0.0) + points
        if e.parent is not None and carried:
            passed.setdefault(e.parent, []).extend((points, far) for far, points in carried.items())


#: Containers whose own text counts like a paragraph's; from this distance on points are shared out alike.
_BOXES = frozenset("div section article main body html".split())
_FAR = 64


def _worth(e: Element) -> float:
    return e.points * (1 - _density(e))


def _unname(order: list[Element], root: Element) -> list[Element]:
    """The elements that stay once those with furniture's names are gone, but for one that holds most of the page's points."""
    named = [e for e in order if e.named]
    if not named:
        return order
    held: dict[Element, float] = {}
    for e in reversed(order):
        if e.tag in PARAGRAPHS:
            held[e] = held.get(e, 0.0) + max(0, e.text - e.linked)
        if e.parent is not None and e in held:
            held[e.parent] = held.get(e.parent, 0.0) + held[e]
    comments = sum(held.get(e, 0.0) for e in named if e.named == 2)
    for e in named:
        mine = held.get(e, 0.0)
        e.gone = e.named == 2 or mine < _LONG or 2 * mine < held.get(root, 0.0) - comments
    return _measure(root)


def _menu(e: Element) -> bool:
    """A list or box of nothing but short links."""
    if e.tag not in ("ul", "ol", "div", "table") or _density(e) < 0.9:
        return False
    links, todo = 0, [e]
    while todo:
        x = todo.pop()
        if x.tag == "a":
            links += 1
        else:
            todo += [c for c in x.inside if isinstance(c, Element) and not c.gone]
    return links > 1 and e.text < 25 * links


def _kept(best: Element) -> list[Element]:
    """The best container and those of its siblings that are content as well, in page order.

    The container is widened to its parent as long as that has other elements with points, short of the page itself; so
    an article whose sections have points of their own is taken whole. Menus at either end of it, outside of an
    <article>, are not part of it.
    """
    while best.parent is not None and best.tag not in ("article", "main") and best.parent.tag not in ("html", "body", "main"):
        others = [e for e in best.parent.inside if isinstance(e, Element) and e is not best and not e.gone and e.text]
        if best.parent.tag != "article" and not any(_worth(e) > 0 or e.tag in HEADINGS or e.tag in PARAGRAPHS for e in others):
            break
        best = best.parent
    around = best
    while around is not None and around.tag != "article":
        around = around.parent
    if around is None:
        for side in (best.inside, list(reversed(best.inside))):
            for e in side:
                if isinstance(e, str) and e.strip() or isinstance(e, Element) and not e.gone and e.text and not _menu(e):
                    break
                if isinstance(e, Element) and not e.gone and e.text:
                    e.gone = True
    if best.parent is None or around is not None:
        return [best]
    enough = max(10.0, 0.2 * _worth(best))
    kept = []
    for e in best.parent.inside:
        if not isinstance(e, Element) or e.gone:
            continue
        if e is best or _worth(e) >= enough:
            kept.append(e)
        elif e.tag == "p" and e.text and (e.text > 80 and _density(e) < 0.25 or _density(e) == 0):
            kept.append(e)
        elif e.tag in HEADINGS and _density(e) < 0.5:
            kept.append(e)
    return kept


def _blocks(e: Element) -> list[str]:
    """Texts of the blocks of an element, in page order; all that is in it, but for furniture."""
    out, part = [], []

    def flush():
        line = " ".join(unescape("".join(part)).split())
        if line:
            out.append(line)
        part.clear()

    todo: list = [e]
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            part.append(x)
        elif x.gone:
            continue
        elif x.tag in ("br", "td", "th", "img"):
            part.append(" ")
            todo += reversed(x.inside)
        elif x.tag in BLOCKS:
            flush()
            todo.append(None)
            todo += reversed(x.inside)
        else:
            todo += reversed(x.inside)
    flush()
    return out


def main_text(html: str | None) -> str:
    """The article's blocks, one a line; empty if there is none."""
    if not html:
        return ""
    root = parse(html)
    order = _unname(_measure(root), root)
    _score(order)
    best = max((e for e in order if e.points > 0), key=_worth, default=None)
    return "\n".join(line for e in _kept(best) for line in _blocks(e)) if best is not None else ""


EXTRACTED = "page_id long, url string, text string, n_chars long"


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page. No shuffle: a page is worked on alone.

    A null or empty page, and one without text outside of furniture, has an empty text. Markup
    that is cut off, unclosed or misnested is read as browsers do in the main. Very long pages are read whole. Ties of points go
    to the element that begins first. Repeated rows stay; other columns are ignored, also such as are named text or n_chars.
    """
    common.ship(pages.sparkSession)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            texts = [main_text(h.as_py()) for h in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, EXTRACTED)
