"""Main text of web pages by block rules in two passes.

A page is cut into blocks at its block-level tags. The first pass decides blocks by where they stand, by link density, and by length and stop-word density;
short blocks, and middling ones, stay open. The second pass gives open blocks the label of the nearest decided neighbour, where nearness counts
the steps between two blocks in the tree of elements before the blocks between them.
"""

from __future__ import annotations

import html as references
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_texts

# Function words of English, French, German and Spanish.
STOP_WORDS = frozenset("""
a an and are as at be been but by for from had has have he her his i in is it its not of on or she that the their there they this to was we were which who will with you
au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou par pas plus pour qu que qui sa se ses son sont sur un une vous
als am auch auf aus bei das dass dem den der des die ein eine einem einen einer er es für haben hat ich ihr im ist mit nach nicht sich sie sind und uns vom von war wie wir zu zum zur
al como con cuando de del el ella ellos en entre era es esta este ha la las lo los más me muy no nos o para pero por que se sin sobre su sus también un una y ya
""".split())
# Elements that start and end a block, that have no end tag, whose content is not text, and that hold no part of an article.
BLOCK_TAGS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6
header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul""".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED_TAGS = frozenset("script style noscript template svg iframe object canvas audio video title textarea select button datalist map head".split())
RAW_TAGS = frozenset("script style title textarea iframe noscript template svg object canvas audio video select button datalist map".split())
OUTSIDE_TAGS = frozenset("nav footer aside menu dialog search".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
OUTSIDE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search status toolbar".split())
# Words of class and id names that mark what is no part of an article.
OUTSIDE_NAMES = frozenset("""
ad adbox adcontainer ads adsbygoogle adsense adslot adunit adv advert advertisement advertising adverts promo promoted promotion sponsor sponsored sponsors
nav navbar navigation menu menus breadcrumb breadcrumbs pager pagination toolbar footer copyright colophon disclaimer legal
sidebar aside rail widget widgets related recommended recommendations trending teaser teasers
comment comments commentlist disqus respond replies reply discussion
cookie cookies consent gdpr notice notices alert alerts popup modal overlay dialog paywall
form login signin signup register subscribe subscription newsletter search share sharing social follow tagcloud hidden
""".split())
HEADER_NAMES = frozenset("header masthead topbar banner logo".split())
#: A heading with nothing but such a word opens reader comments.
COMMENTS = re.compile(r"(?:\d+\s+)?(?:(?:reader|user|your)\s+)?(?:comments?|kommentare?|leserkommentare?|commentaires?|comentarios?)(?:\s*[(:]?\s*\d*\s*[):]?)?", re.I)
ARTICLE_NAME = re.compile(r"\b(?:article|entry|post|story)[-_]?(?:body|content|text)\b", re.I)
# Elements that a start tag ends, up to the given borders.
IMPLIED = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table")}
IMPLIED = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in IMPLIED.items()}

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"'=]++|=\s*\"[^\"]*\"|=\s*'[^']*'|[\"'=])*+)>?|<[!?/][^>]*+>?", re.S)
ATTRIBUTE = re.compile(r"([^\s\"'>/=]++)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
WORD = re.compile(r"[^\W\d_]+")

GOOD, BAD, NEAR, SHORT = "good", "bad", "near", "short"
#: Characters below which a block is short, and above which dense stop words make it good at once.
LENGTH_LOW, LENGTH_HIGH = 70, 200
#: Shares of stop words: middling and dense. Pages with fewer than the last are in a language that the list does not know.
STOPS_LOW, STOPS_HIGH, STOPS_KNOWN = 0.15, 0.25, 0.04
#: Share of characters in links beyond which a block is a list of links.
LINKS_HIGH = 0.33


def main_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """All columns of ``pages`` and text, n_chars: the blocks of the article in page order, joined by \\n, and its code points.

    Character references are decoded once; white space in a block, no-break spaces included, becomes one space, and ends are trimmed. Without
    blocks, and for null or empty pages, text is empty and n_chars 0. Repeated pages give equal rows, an empty table an empty one; an input column named
    text or n_chars is replaced, all others pass. A page is held whole in one task, whatever its length; a tag, comment or script that the page never ends runs to its end.
    When two decided neighbours are equally near, a short block takes the label bad, a middling one good.
    """
    def work(body: np.ndarray, offs: np.ndarray) -> list[pa.Array]:
        raw = body.tobytes()
        texts = ["\n".join(article_blocks(raw[a:b].decode("utf-8", "replace"))) for a, b in zip(offs[:-1], offs[1:])]
        return [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]

    return map_texts(pages, html, "text string, n_chars bigint", work)


def article_blocks(page: str) -> list[str]:
    """Texts of the blocks that belong to the article."""
    tree = Tree(page)
    labels = inherited(tree, decided(tree))
    return [b.text for b, label in zip(tree.blocks, labels) if label == GOOD]


class Block:
    __slots__ = ("text", "linked", "element", "heading")

    def __init__(self, text: str, linked: int, element: int, heading: bool):
        self.text, self.linked, self.element, self.heading = text, linked, element, heading


class Tree:
    """Blocks of a page and, for each element with blocks below it: its parent, depth, whether it is outside the article, and its article (or -1)."""

    def __init__(self, page: str):
        self.blocks: list[Block] = []
        self.parent, self.depth = [-1], [0]
        self.tags, self.outside, self.holds, self.header, self.article, self.from_block = [""], [""], [False], [False], [False], [None]
        self._stack, self._open = [0], Counter()
        self._parts: list[str] = []
        self._linked, self._link, self._breaks = 0, None, 0
        self._read(page)
        self._flush()
        self._inherit()

    def _read(self, page: str) -> None:
        at, end = 0, len(page)
        while at < end:
            m = TAG.search(page, at)
            self._text(page[at:m.start() if m else end])
            if m is None:
                break
            at = m.end()
            close, name = m[1], (m[2] or "").lower()
            if not name:
                continue
            if close:
                self._close(name)
            elif name in RAW_TAGS:
                stop = re.compile(rf"</{name}(?![^\s/>])[^>]*+>?", re.I).search(page, at)
                at = end if stop is None else stop.end()
                if name != "noscript" and name in BLOCK_TAGS:
                    self._flush()
            else:
                self._start(name, m[3])

    def _text(self, raw: str) -> None:
        if not raw or self._open["head"]:
            return
        text = references.unescape(raw) if "&" in raw else raw
        self._parts.append(text)
        if not text.isspace():
            self._breaks = 0
            if self._link is not None:
                self._linked += len("".join(text.split()))

    def _flush(self) -> None:
        text = " ".join("".join(self._parts).split())
        if text:
            i = self._stack[-1]
            heading = any(self.tags[j] in HEADINGS for j in self._stack[-3:])
            self.blocks.append(Block(text, self._linked, i, heading))
            if len(text) < LENGTH_LOW and COMMENTS.fullmatch(text) and self.from_block[up := max(self.parent[i], 0) if heading else i] is None:
                self.from_block[up] = len(self.blocks) - 1
        self._parts, self._linked, self._breaks = [], 0, 0

    def _start(self, name: str, attributes: str) -> None:
        if name == "br":
            self._parts.append(" ")
            self._breaks += 1
            if self._breaks == 2:
                self._flush()
            return
        if name == "a":
            self._link = len(self._stack)
        given = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)} if attributes.strip(" /") else {}
        names = " ".join(given.get(k, "") for k in ("class", "id"))
        words = {w.lower() for w in NAME_WORD.findall(names)} if names.strip() else set()
        style = given.get("style", "").replace(" ", "").lower()
        concealed = "hidden" in given or given.get("aria-hidden", "").lower() == "true" or "display:none" in style or "visibility:hidden" in style
        marked = bool(words & OUTSIDE_NAMES) or name == "form"
        article = name in ("article", "main") or given.get("role", "").lower() in ("article", "main") or "articlebody" in given.get("itemprop", "").lower() or bool(ARTICLE_NAME.search(names))
        role = given.get("role", "").lower() in OUTSIDE_ROLES
        why = "always" if name in OUTSIDE_TAGS or role or concealed else "named" if marked and name not in ("html", "body") else ""
        if name in VOID_TAGS:
            if name == "hr":
                self._flush()
            return
        if name not in BLOCK_TAGS and name != "head" and not why and not article:
            return
        self._flush()
        if name in BLOCK_TAGS and self._open["p"]:
            self._end_implied(frozenset(("p",)), frozenset(("div", "article", "section", "td", "li", "blockquote", "main", "body", "aside", "form", "dd", "figure")))
        if name in IMPLIED:
            self._end_implied(*IMPLIED[name])
        parent = self._stack[-1]
        i = len(self.parent)
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        self.tags.append(name)
        self.outside.append(why)
        self.holds.append(False)
        self.header.append(name in ("header", "hgroup") or bool(words & HEADER_NAMES and name not in ("html", "body", "article", "main")))
        self.article.append(article)
        self.from_block.append(None)
        self._stack.append(i)
        self._open[name] += 1
        if name in ("h1", "main") or "articlebody" in given.get("itemprop", "").lower():
            for j in reversed(self._stack[:-1]):
                if self.holds[j]:
                    break
                self.holds[j] = True
        if article and name != "main":
            for j in reversed(self._stack[:-1]):
                if self.tags[j] == "main":
                    self.article[j] = False

    def _end_implied(self, names: frozenset, borders: frozenset) -> None:
        for k in range(len(self._stack) - 1, 0, -1):
            tag = self.tags[self._stack[k]]
            if tag in borders:
                return
            if tag in names:
                self._pop(k)
                return

    def _close(self, name: str) -> None:
        if name == "a":
            self._link = None
        if not self._open[name]:
            if name in BLOCK_TAGS:
                self._flush()
            return
        self._flush()
        for k in range(len(self._stack) - 1, 0, -1):
            if self.tags[self._stack[k]] == name:
                self._pop(k)
                return

    def _pop(self, k: int) -> None:
        for i in self._stack[k:]:
            self._open[self.tags[i]] -= 1
        del self._stack[k:]
        if self._link is not None and self._link > len(self._stack):
            self._link = None

    def _inherit(self) -> None:
        """What holds for an element holds for all below it; parents come before their children."""
        n = len(self.parent)
        self.is_outside, self.home, self.in_header, self.since = [False] * n, [-1] * n, [False] * n, [None] * n
        for i in range(1, n):
            p = self.parent[i]
            named = self.outside[i] == "named" and not self.holds[i]
            self.is_outside[i] = self.is_outside[p] or self.outside[i] == "always" or named
            self.home[i] = i if self.article[i] and not self.is_outside[i] else self.home[p]
            self.in_header[i] = self.in_header[p] or self.header[i]
            own = [x for x in (self.since[p], self.from_block[i]) if x is not None]
            self.since[i] = min(own) if own else None

    def apart(self, a: int, b: int) -> int:
        """Steps from one element to the other in the tree."""
        steps = 0
        while a != b:
            if self.depth[a] >= self.depth[b]:
                a = self.parent[a]
            else:
                b = self.parent[b]
            steps += 1
        return steps


def decided(tree: Tree) -> list[str]:
    """First pass: good, bad, or open (near: middling, short). Bad by place is told apart, as it says nothing about neighbours."""
    words = [WORD.findall(b.text.lower()) for b in tree.blocks]
    stops = [sum(w in STOP_WORDS for w in ws) for ws in words]
    known = sum(stops) >= STOPS_KNOWN * sum(map(len, words))
    out = []
    for k, (b, ws, n) in enumerate(zip(tree.blocks, words, stops)):
        i = b.element
        home = tree.home[i] >= 0
        letters = len(b.text) - b.text.count(" ")
        since = tree.since[i]
        if tree.is_outside[i] or (since is not None and k >= since) or (tree.in_header[i] and not (home and b.heading)):
            out.append("outside")
        elif b.linked > LINKS_HIGH * letters and not (b.heading and home) and not (home and len(b.text) > LENGTH_HIGH):
            out.append(BAD)
        elif b.text.startswith("©") or ("©" in b.text and len(b.text) < LENGTH_HIGH and not home):
            out.append(BAD)
        elif len(b.text) < LENGTH_LOW or b.heading:
            out.append(SHORT)
        else:
            dense = n / max(1, len(ws)) if known else STOPS_HIGH
            if dense >= STOPS_HIGH:
                out.append(GOOD if len(b.text) > LENGTH_HIGH or home else NEAR)
            elif dense >= STOPS_LOW or home:
                out.append(NEAR)
            else:
                out.append(BAD)
    return out


def inherited(tree: Tree, labels: list[str]) -> list[str]:
    """Second pass. The borders of an article count as good neighbours; a page with text in an article takes none from elsewhere."""
    n = len(labels)
    ahead, behind = [None] * n, [None] * n
    for where, run in ((behind, range(n)), (ahead, range(n - 1, -1, -1))):
        last = None
        for k in run:
            where[k] = last
            if labels[k] in (GOOD, BAD):
                last = k
    out = []
    for k, label in enumerate(labels):
        if label in (NEAR, SHORT):
            i, votes = tree.blocks[k].element, []
            for other in (behind[k], ahead[k]):
                if other is not None and tree.home[tree.blocks[other].element] == tree.home[i]:
                    votes.append((tree.apart(i, tree.blocks[other].element), abs(other - k), labels[other]))
                elif tree.home[i] >= 0:
                    votes.append((tree.apart(i, tree.home[i]), n, GOOD))
            nearest = min(votes)[:2] if votes else None
            told = {v[2] for v in votes if v[:2] == nearest}
            label = (GOOD if label == NEAR else BAD) if len(told) == 2 else told.pop() if told else GOOD
        out.append(label)
    if any(label == GOOD and tree.home[b.element] >= 0 for b, label in zip(tree.blocks, out)):
        out = [BAD if tree.home[b.element] < 0 else label for b, label in zip(tree.blocks, out)]
    return out
