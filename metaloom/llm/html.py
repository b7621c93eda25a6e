"""HTML extraction by line-block distribution: markup is stripped to lines, text lengths are summed over sliding windows of lines, and what lies between a surge and the next dive is kept."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_arrow, table

# Element and attribute names with a meaning here.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "svg", "annotation", "annotation-xml", "iframe", "object", "canvas", "audio", "video", "select", "head"}
BLOCKS = set("address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split())
FRAMES = set("article aside blockquote body center details dialog div dl fieldset figure footer form header main menu nav ol search section table ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
ALWAYS_OUT = {"nav", "aside", "form", "footer", "menu", "dialog", "search", "button", "fieldset"}
ROLES_OUT = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "form"}
WORDS_OUT = set("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead comment comments commentlist disqus share sharing social related recommended newsletter subscribe subscription signup login popup modal overlay widget pagination pager skip toolbar topbar".split())
# The same in German, French, Spanish, Italian, Portuguese and Dutch.
WORDS_OUT |= set("werbung anzeige anzeigen werbeanzeige kommentar kommentare leserkommentare fusszeile kopfzeile seitenleiste hinweis teilen verwandte publicite pub annonce annonces commentaire commentaires pied entete avis partager publicidad anuncio anuncios comentario comentarios pie cabecera aviso compartir pubblicita annuncio commento commenti intestazione avviso condividi publicidade comentarios rodape cabecalho compartilhar advertentie reclame reactie reacties voettekst zijbalk melding delen".split())
#: Of these, words that also name parts of articles ("related work", "social history"): their elements stay where they hold prose.
SOFT = set("related social share sharing recommended notice banner widget overlay skip verwandte teilen partager compartir condividi compartilhar delen hinweis avis aviso avviso melding anzeige anzeigen annonce annonces annuncio anuncio pie pied pub entete".split())
COMMENT_WORDS = set("comment comments commentlist disqus kommentar kommentare leserkommentare commentaire commentaires comentario comentarios commento commenti reactie reacties".split())
CONTENT_WORDS = {"article", "post", "entry", "content", "story"}
#: A class or id that begins or ends so says what an element has, not what it is.
BEGINS, ENDS = {"with", "has", "have", "no", "without", "is", "not", "hide", "show"}, {"enabled", "disabled", "on", "off", "open", "closed", "active", "visible", "less"}
#: Elements whose lines belong together.
HOLDERS = {"article", "main", "div", "section", "body", "table"}

#: Elements whose content is text up to their end tag, whatever stands in it and whether or not they are written as empty; those of other languages can be empty.
RAW_TEXT = {"script", "style", "noscript", "textarea", "title", "iframe"}
FOREIGN = {"svg", "annotation", "annotation-xml"}
NAME = re.compile(r"[^\s/>]+")
VALUE = re.compile(r"=\s*+")
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?")
CAMEL = re.compile(r"[a-z0-9]+|[A-Z]+[a-z0-9]*")
#: Lines in a window, and the least sum of a window that counts as a surge.
WINDOW, SURGE = 3, 86


def _out(tag: str, attributes: str, in_article: bool) -> str:
    """Whether an element and all below it is none of the article: "always", or by its "words" or as "comments" unless it holds the page's text, or as "soft" unless it holds prose, or "" if it may be."""
    if tag in ALWAYS_OUT:
        return "always"
    words: set[str] = set()
    content = False
    if attributes.strip():
        for m in ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name in ("class", "id"):
                for one in value.split():
                    parts = [w.lower() for w in CAMEL.findall(one)]
                    if parts and (parts[0] in BEGINS or parts[-1] in ENDS):
                        continue
                    content |= bool(parts) and CONTENT_WORDS.issuperset(parts)
                    words.update(parts)
            elif name == "role" and value.strip().lower() in ROLES_OUT:
                return "always"
            elif name == "hidden" or (name == "aria-hidden" and value.strip().lower() == "true"):
                return "always"
            elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return "always"
    if tag == "header" or "header" in words:
        return "" if in_article or words & CONTENT_WORDS else "words"
    if tag in ("html", "body", "main"):
        return ""
    if words & COMMENT_WORDS:
        return "comments"
    if tag == "article" or content or not words & WORDS_OUT:
        return ""
    return "soft" if words & WORDS_OUT <= SOFT else "words"


class Line(NamedTuple):
    text: str
    linked: int  # characters of it in links
    element: int  # the innermost element around it that is in the page's tree, or 0


class Tree:
    """Elements that matter for the choice of lines, numbered from 1 in the order in which they begin, each with its parent: what holds for all elements around a line is worked out once for each element, from parent to child."""

    def __init__(self) -> None:
        self.parent = [0]
        self.why = [""]  # as _out tells
        self.out = [False]  # in an element that is always boilerplate
        self.marked = [-1]  # outermost article or main element around it, itself included, or -1
        self.holder = [0]  # innermost element that holds lines together, itself included, or 0
        self.outer = [True]  # no holder is around that one

    def add(self, parent: int, tag: str, why: str) -> int:
        n = len(self.parent)
        self.parent.append(parent)
        self.why.append(why)
        self.out.append(self.out[parent] or why == "always")
        mark = tag in ("article", "main") and not self.out[n] and self.marked[parent] < 0
        self.marked.append(n if mark else self.marked[parent])
        holds = tag in HOLDERS
        self.holder.append(n if holds else self.holder[parent])
        self.outer.append(self.holder[parent] == 0 if holds else self.outer[parent])
        return n

    def inherited(self, own: list) -> list:
        """For each element the first true value among its ancestors', from the outermost to itself."""
        out = [own[0]]
        for n in range(1, len(self.parent)):
            out.append(out[self.parent[n]] or own[n])
        return out

    def gathered(self, own: list[int], join) -> list[int]:
        """For each element its value joined with those of all elements in it."""
        out = list(own)
        for n in range(len(out) - 1, 0, -1):
            out[self.parent[n]] = join(out[self.parent[n]], out[n])
        return out


class Page:
    """A page's markup, scanned once from its start to its end: what is looked for in vain from one place isn't looked for again behind it."""

    def __init__(self, html: str):
        self.html, self.absent = html, {}

    def find(self, what: str, at: int) -> int:
        if self.absent.get(what, len(self.html)) <= at:
            return -1
        k = self.html.find(what, at)
        if k < 0:
            self.absent[what] = at
        return k

    def closing(self, tag: str, at: int) -> int:
        """The place of an element's end tag."""
        if self.absent.get(tag, len(self.html)) <= at:
            return -1
        m = re.compile(rf"</{tag}(?=[\s/>])" if tag != "head" else r"</head(?=[\s/>])|<body(?=[\s/>])", re.I).search(self.html, at)
        if not m:
            self.absent[tag] = at
            return -1
        return m.start()

    def end(self, at: int) -> int:
        """Where a tag ends whose name ends at a place: behind the first > outside of quoted values; a quote that is never closed is none. Without one, the tag is the rest of the page."""
        html = self.html
        while True:
            close = self.find(">", at)
            if close < 0:
                return len(html)
            value = self.find("=", at)
            if value < 0 or value > close:
                return close + 1
            at = VALUE.match(html, value).end()
            if html[at : at + 1] in ("'", '"'):
                other = self.find(html[at], at + 1)
                at = other + 1 if other >= 0 else at + 1


def lines(html: str) -> tuple[list[Line], Tree]:
    """A page's blocks in order, and the tree of the elements named in them. Time and memory are in proportion to the page."""
    found: list[Line] = []
    page, tree = Page(html), Tree()
    open_: list[tuple[str, int]] = []
    counts: dict[str, int] = {}
    text: list[str] = []
    linked = link = here = 0

    def close() -> None:
        nonlocal linked
        if text:
            if joined := " ".join(unescape("".join(text)).split()):
                found.append(Line(joined, linked, here))
            text.clear()
        linked = 0

    def leave(k: int) -> None:
        nonlocal here
        for tag, _ in open_[k:]:
            counts[tag] -= 1
        del open_[k:]
        here = open_[-1][1] if open_ else 0

    at, n = 0, len(html)
    while at < n:
        start = page.find("<", at)
        data = html[at:start] if start >= 0 else html[at:]
        if data:
            text.append(data)
            linked += len(data) if link else 0
        if start < 0:
            break
        ends = html.startswith("/", start + 1)
        name = start + 1 + ends
        if html.startswith("<!--", start):
            stop = page.find("-->", start + 2)
            at = stop + 3 if stop >= 0 else n
            continue
        if not ("a" <= html[name : name + 1].lower() <= "z"):
            if html[start + 1 : start + 2] in ("!", "?", "/"):
                stop = page.find(">", start)
                at = stop + 1 if stop >= 0 else n
            else:
                text.append("<")
                linked += 1 if link else 0
                at = start + 1
            continue
        word = NAME.match(html, name)
        tag, at = word[0].lower(), page.end(word.end())
        if ends:
            if tag == "a":
                link = 0
            if tag in BLOCKS:
                close()
            if counts.get(tag):
                leave(next(k for k in range(len(open_) - 1, -1, -1) if open_[k][0] == tag))
            continue
        attributes = html[word.end() : at - 1]
        if tag in RAW and not (tag in FOREIGN and attributes.endswith("/")):
            stop = page.closing(tag, at)
            if stop >= 0:
                at = stop if html.startswith(("<body", "<BODY"), stop) else page.end(stop + 2 + len(tag))
            elif tag in RAW_TEXT:
                at = n
            continue
        if tag == "a":
            link = 1
        if tag in BLOCKS:
            close()
            if open_ and open_[-1][0] in ("p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "td", "th", "tr", "dt", "dd") and (tag == open_[-1][0] or open_[-1][0] == "p"):
                leave(len(open_) - 1)
        if tag not in VOID:
            why = "" if tree.out[here] else _out(tag, attributes, tree.marked[here] >= 0)
            if tag in FRAMES or why:
                if tag not in BLOCKS:
                    close()
                here = tree.add(here, tag, why)
                open_.append((tag, here))
                counts[tag] = counts.get(tag, 0) + 1
    close()
    return found, tree


def _taken_back(found: list[Line], tree: Tree) -> set[int]:
    """Elements that are boilerplate by their words but hold most of the page's text (those for comments: all of it that could surge), and soft ones with a line of prose that could surge alone."""
    sizes = [0 if tree.out[x.element] or 2 * x.linked > len(x.text) else len(x.text) for x in found]
    most = [0] * len(tree.parent)
    own = [0] * len(tree.parent)
    for x, n in zip(found, sizes, strict=True):
        most[x.element] = max(most[x.element], n)
        own[x.element] += n
    most, whole = tree.gathered(most, max), tree.gathered(own, int.__add__)
    back = {e for e, why in enumerate(tree.why) if why == "soft" and most[e] > SURGE}
    # The elements by words that stand next below each such element, and below none (0).
    worded = [why in ("words", "comments", "soft") and e not in back for e, why in enumerate(tree.why)]
    above, below = [0], {}
    for e in range(1, len(tree.parent)):
        p = tree.parent[e]
        above.append(p if worded[p] else above[p])
        if worded[e]:
            below.setdefault(above[e], []).append(e)
    rest = whole[0] - sum(whole[e] for e in below.get(0, []))
    heap = [(tree.why[e] == "comments", -whole[e], e) for e in below.get(0, []) if whole[e]]
    heapq.heapify(heap)
    while heap:
        of_comments, size, e = heap[0]
        all_of_it = -size > SURGE >= rest
        if not (all_of_it if of_comments else -2 * size > whole[0] or all_of_it):
            break
        heapq.heappop(heap)
        back.add(e)
        rest += whole[e] - sum(whole[k] for k in below.get(e, []))
        for k in below.get(e, []):
            if whole[k]:
                heapq.heappush(heap, (tree.why[k] == "comments", -whole[k], k))
    return back


def extract(html: str | None) -> str:
    """The main text of a whole page. Lines of boilerplate elements and lines that are mostly links weigh nothing, nor do lines outside article and main elements where these hold the heaviest region. A region is a run of lines up to the next windows without weight; those with a window over SURGE are kept whole, and so is every line with weight in an element that holds such a window's heaviest line. Without any surge the heaviest run of lines is kept (all of the marked lines, if they weigh)."""
    found, tree = lines(html or "")
    if not found:
        return ""
    back = _taken_back(found, tree)
    hidden = tree.inherited([o or (w in ("words", "comments", "soft") and e not in back) for e, (o, w) in enumerate(zip(tree.out, tree.why, strict=True))])
    out = np.array([hidden[x.element] for x in found])
    size = np.array([len(x.text) for x in found])
    marked = np.array([tree.marked[x.element] for x in found])
    links = np.array([2 * x.linked > len(x.text) for x in found])
    weight = np.where(out | links, 0, size)
    inside = np.where(out | (marked < 0), 0, size)
    if by_mark := bool(inside.any()) and inside.sum() >= max((w for _, _, _, w in _runs(np.where(marked < 0, weight, 0))), default=0):
        weight = inside
    runs = _runs(weight)
    keep = np.zeros(len(weight), bool)
    if surged := [r for r in runs if len(r[2])]:
        blocks: set[int] = set()
        for i, j, at, _ in surged:
            keep[i:j] = True
            for k in at.tolist():
                top = k + int(weight[k : k + WINDOW].argmax())
                of = found[top].element
                if by_mark:
                    blocks.add(tree.marked[of])
                elif tree.holder[of]:
                    blocks.add(tree.holder[of])
        if by_mark:
            keep |= np.isin(marked, list(blocks))
        else:
            # Lines right in the body have no element of their own; what else the body holds isn't theirs.
            inside_block = tree.inherited([e in blocks and not tree.outer[e] for e in range(len(tree.parent))])
            keep |= np.array([tree.holder[x.element] in blocks or inside_block[x.element] for x in found])
    elif by_mark:
        keep[:] = True
    elif runs:
        i, j, _, _ = max(runs, key=lambda r: r[3])
        keep[i:j] = True
    # Lines of links stand where lines with weight stand before and after them in a kept region.
    kept = np.flatnonzero(keep & (weight > 0))
    between = np.zeros(len(weight), bool)
    for i, j, _, _ in runs:
        if len(own := kept[(kept >= i) & (kept < j)]):
            between[own[0] : own[-1] + 1] = True
    keep &= (weight > 0) | (links & ~out & between)
    return "\n".join(x.text for x, k in zip(found, keep, strict=True) if k)


def _runs(weight: np.ndarray) -> list[tuple[int, int, np.ndarray, int]]:
    """Runs of lines between windows without weight: first line, line after the last, where a window surges, weight."""
    total = np.concatenate([[0], np.cumsum(weight)])
    ends = np.minimum(np.arange(len(weight)) + WINDOW, len(weight))
    sums = total[ends] - total[: len(weight)]
    runs, i = [], 0
    while i < len(weight):
        if weight[i] == 0:
            i += 1
            continue
        j = i
        while j < len(weight) and sums[j] > 0:
            j += 1
        runs.append((i, j, i + np.flatnonzero(sums[i:j] > SURGE), int(total[j] - total[i])))
        i = j
    return runs


def main_text(pages: DataFrame) -> DataFrame:
    """Adds text to pages(page_id, url, html): the main text, empty if there's none; null html counts as empty. Only those three columns are read; repeated rows give repeated results, an empty table none. Pages are read whole, however long. Of equally heavy regions without a surge the first is kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([extract(h.as_py()) for h in b.column(2)], pa.string())], ["page_id", "url", "text"])

    return in_arrow(pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")), run, "page_id long, url string, text string")


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages", "page_id", "url", "html")).withColumn("n_chars", F.length("text").cast("long"))
