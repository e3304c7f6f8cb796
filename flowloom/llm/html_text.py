"""Main text of web pages by composite text density.

A page becomes a small tree. With C characters (white space aside), T tags, LC of the
characters and LT of the tags within links, and b the body, a node's density is

    C / T * log(C / LC * T / LT) / log(1 + ln(C / (C - LC) * LC + LC_b / C_b * C + e))

(zero counts as one in a denominator). Densities of the children are summed per node, the
subtree with the largest sum is the article, and the least density between it and the
body is the threshold: every node that reaches it gives its own subtree of the largest sum.

Departures from the published method: the 1 in the outer logarithm, without which the
base is 1 on pages without links; a node's own text counts as one child without tags, so
that text outside paragraphs has a density; formatting within a line is no tag. What
class, id or role names as an advert, menu, comment or the like counts as link text (its
density is then about zero); such names are disbelieved where they cover an article, main
part or main heading, or leave less than ``BELIEVED`` of the largest sum. Elements that
are never text or state that they are no article (``NEVER``) and hidden ones are left out.
The ``article`` or ``main`` element around the densest node and the main heading before
it belong to the text too; link lists and named parts under the threshold do not, nor do last
blocks that read like a footer.
"""

from __future__ import annotations

import html as entities
import math
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table

#: Elements without end tag, with raw content, never part of an article, and inside a line of text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript iframe xmp textarea title".split())
NEVER = RAW - {"xmp"} | frozenset("head nav footer aside form button select option datalist dialog menu template".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr object applet audio video canvas map svg math mi mn mo ms mtext mrow mstyle mspace "
    "msup msub msubsup mfrac msqrt mroot mover munder munderover semantics annotation".split()
)
#: A paragraph ends where one of these begins; an item ends where its like begins.
ENDS_P = frozenset(
    "address article aside blockquote center details dir div dl fieldset figure figcaption footer form h1 h2 h3 h4 h5 h6 "
    "header hr main menu nav ol p pre section table ul".split()
)
ENDS_LIKE = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
    "th": ("td", "th"), "option": ("option",), "thead": ("tr",), "tbody": ("thead", "tbody"), "tfoot": ("tbody",),
}
SCOPES = frozenset("html body table ul ol dl div article section main td th blockquote aside nav form header footer".split())
#: Words of class, id and role that name what is not the article.
HINTS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs byline comment comments commentlist consent cookie "
    "cookies disqus footer gdpr header login masthead menu menubar modal nav navbar navigation newsletter notice notices "
    "notification overlay pagination popup promo promoted promotion recommended related reply replies respond search share sharing "
    "sidebar signup skip social sponsor sponsored subscribe subscription tags toolbar topbar widget alert complementary "
    "contentinfo".split()
)
#: Words that say nothing beside a hint: "reader-comments" is one, "no-sidebar" or "social-history" is not.
FRAME = frozenset(
    "area bar block bottom box buttons col column container content ct div entry form global group holder icons inner item items left "
    "links list main outer page panel placeholder post posts primary reader readers right row secondary section site slot text thread "
    "top unit user users view wrap wrapper".split()
)
#: Hints are ignored that leave less than this part of the largest density sum.
BELIEVED = 0.1
#: A part with this share of link text and so many links is a list of links.
LINKED, LINKS = 0.8, 3
#: A last block of at most so many characters that says this is a footer, with or without a name.
FOOTER = 300
_FOOTER = re.compile(
    r"^\s*(?:copyright\b|©|\(c\)).{0,60}\d{4}|\ball rights reserved\b|^\s*powered by\b|\b(?:privacy|cookie) policy\b.*\bterms\b|\bterms\b.*\b(?:privacy|cookie) policy\b",
    re.I | re.S,
)
_ATTRIBUTES = re.compile(r"""(?:[^"'>]++|"[^"]*+"|'[^']*+')*+>""")
_NAMED = re.compile(r"""(?:^|[\s"'])(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/>"']|$)""", re.I)
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_SPLIT = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")


def named(value: str) -> bool:
    """Whether one of the names in an attribute is made of hints."""
    for name in value.split():
        parts = {w.lower() for w in _SPLIT.split(name) if len(w) > 1}
        if parts & HINTS and parts <= HINTS | FRAME:
            return True
    return False


class Page:
    """Elements in page order: tag, parent, whether left out or hinted, and the text pieces between them."""

    def __init__(self, source: str):
        self.tags, self.parents, self.left_out, self.hinted = ["#root"], [-1], [False], [False]
        self.pieces: list[tuple[int, str]] = []  # (element, text); a break between blocks is text " "
        self.open = [0]
        self.places: dict[str, list[int]] = {}  # tag -> its positions in ``open``
        self._read(source)

    def _start(self, tag: str, attributes: str) -> None:
        if tag in ENDS_P:
            self._end_implied(("p",), ENDS_P - {"p"})
        if tag in ENDS_LIKE:
            self._end_implied(ENDS_LIKE[tag], SCOPES - {"td", "th"})
        out, hint = tag in NEVER, False
        if attributes and not out:
            for name, *values in _NAMED.findall(attributes):
                name, value = name.lower(), "".join(values)
                if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
                    out = True
                elif name == "style":
                    out |= bool(_HIDDEN.search(value))
                elif name != "aria-hidden" and tag not in ("html", "body", "article", "main"):
                    hint |= named(value)
        if tag not in INLINE:
            self.pieces.append((self.open[-1], " "))
        self.tags.append(tag)
        self.parents.append(self.open[-1])
        self.left_out.append(out)
        self.hinted.append(hint)
        if tag not in VOID:
            self.places.setdefault(tag, []).append(len(self.open))
            self.open.append(len(self.tags) - 1)

    def _last(self, tags) -> int:
        """Position of the innermost open element of these tags, or 0."""
        return max((at[-1] for t in tags if (at := self.places.get(t))), default=0)

    def _close(self, k: int) -> None:
        for i in self.open[k:]:
            self.places[self.tags[i]].pop()
        del self.open[k:]

    def _end_implied(self, which: tuple, stop: frozenset) -> None:
        k = self._last(which)
        if k and k >= self._last(stop):
            self.pieces.append((self.open[k], " "))
            self._close(k)

    def _end(self, tag: str) -> None:
        k = self._last((tag,))
        if not k or tag in INLINE and self._last(SCOPES) > k:
            return
        if tag not in INLINE:
            self.pieces.append((self.open[k], " "))
        self._close(k)

    def _text(self, text: str) -> None:
        if text:
            self.pieces.append((self.open[-1], entities.unescape(text)))

    def _read(self, s: str) -> None:
        at, n = 0, len(s)
        while at < n:
            lt = s.find("<", at)
            if lt < 0 or lt + 1 >= n:
                self._text(s[at:])
                return
            c = s[lt + 1]
            if not (c in "!?/" or c.isascii() and c.isalpha()):
                self._text(s[at : lt + 1])
                at = lt + 1
                continue
            self._text(s[at:lt])
            if c in "!?":
                if s.startswith("<!--", lt):
                    end = s.find("-->", lt + 4)
                    at = end + 3 if end >= 0 else n
                else:
                    end = s.find(">", lt)
                    at = end + 1 if end >= 0 else n
                continue
            name = _NAME.match(s, lt + 1 + (c == "/"))
            if c == "/":
                end = s.find(">", lt)
                at = end + 1 if end >= 0 else n
                if name:
                    self._end(name[0].lower())
                continue
            tag = name[0].lower()
            rest = _ATTRIBUTES.match(s, name.end())
            end = rest.end() if rest else (s.find(">", lt) + 1 or n)
            self._start(tag, s[name.end() : end - 1])
            at = end
            if tag in RAW:
                close = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(s, at)
                if tag == "xmp":  # shown as it stands
                    self.pieces.append((self.open[-1], s[at : close.start() if close else n]))
                at = close.start() if close else n
                if not close:
                    return

    def settle(self) -> None:
        """Passes on what is left out or hinted to what stands below."""
        tags, parents, n = self.tags, self.parents, len(self.tags)
        self.marked = marked = [t in ("article", "main", "h1") for t in tags]
        for i in range(n - 1, 0, -1):
            marked[parents[i]] |= marked[i]
        holds = [m or t in ("body", "html") for m, t in zip(marked, tags)]
        inside = [False] * n
        for i in range(1, n):
            p = parents[i]
            inside[i] = inside[p] or tags[p] in ("article", "main")
            if tags[i] == "header" and not (inside[i] and holds[i]):
                self.left_out[i] = True if inside[i] or not holds[i] else self.left_out[i]
            self.left_out[i] |= self.left_out[p]
            self.hinted[i] = self.hinted[i] and not holds[i] or self.hinted[p]

    def densities(self, body: int, hints: bool) -> tuple[list[float], list[float], list[float]]:
        """``(density, sum of the children's densities, share of link text)`` of every element."""
        tags, parents, n = self.tags, self.parents, len(self.tags)
        linked = [False] * n
        for i in range(1, n):
            linked[i] = tags[i] == "a" or linked[parents[i]] or hints and self.hinted[i]
        own, own_linked = [0] * n, [0] * n
        for i, text in self.pieces:
            if not self.left_out[i]:
                k = len("".join(text.split()))
                own[i] += k
                own_linked[i] += k * linked[i]
        chars, links = own[:], own_linked[:]
        marks = [0 if t in INLINE and t != "a" else 1 for t in tags]
        self.link_tags = link_tags = [int(m and x) for m, x in zip(marks, linked)]
        for i in range(n - 1, 0, -1):
            if not self.left_out[i]:
                for count in (chars, links, marks, link_tags):
                    count[parents[i]] += count[i]
        of_body = links[body] / max(chars[body], 1)

        def density_of(c: int, t: int, lc: int, lt: int) -> float:
            base = math.log(1 + math.log(c / max(c - lc, 1) * lc + of_body * c + math.e))
            return c / max(t, 1) * math.log(max(c / max(lc, 1) * max(t, 1) / max(lt, 1), 1.0)) / base

        density, sums = [0.0] * n, [0.0] * n
        for i in range(n):
            if chars[i] and not self.left_out[i]:
                density[i] = density_of(chars[i], marks[i], links[i], link_tags[i])
                if own[i]:
                    sums[i] += density_of(own[i], 1, own_linked[i], int(linked[i]))
        for i in range(n - 1, 0, -1):
            if tags[i] in INLINE and tags[i] != "a":  # formatting is part of its parent's text
                sums[parents[i]] += sums[i]
            else:
                sums[parents[i]] += density[i]
        self.chars = chars
        return density, sums, [x / max(c, 1) for x, c in zip(links, chars)]

    def article(self) -> str:
        tags, parents, n = self.tags, self.parents, len(self.tags)
        self.settle()
        body = next((i for i in range(n) if tags[i] == "body"), 0)
        within = [i == body for i in range(n)]
        for i in range(1, n):
            within[i] |= within[parents[i]]
        blocks = [i for i in range(n) if within[i] and (i == body or tags[i] not in INLINE)]

        def densest(sums: list[float]) -> int:
            return max(blocks, key=lambda i: (sums[i], tags[i] in ("article", "main"), -i))

        density, sums, share = self.densities(body, True)
        best = densest(sums)
        if any(self.hinted):
            plain = self.densities(body, False)
            other = densest(plain[1])
            if not (sums[best] and self.marked[best]) and sums[best] < BELIEVED * plain[1][other]:
                (density, sums, share), best = plain, other
            else:
                self.densities(body, True)
        threshold, path = density[best], best
        while path != body:
            path = parents[path]
            threshold = min(threshold, density[path])
        block, strongest = list(range(n)), list(range(n))
        for i in range(1, n):
            if i != body and tags[i] in INLINE:
                block[i] = block[parents[i]]
        for i in reversed(blocks):
            if i != body:
                p = block[parents[i]]
                if sums[strongest[i]] > sums[strongest[p]]:
                    strongest[p] = strongest[i]
        chosen = [False] * n
        for i in blocks:
            if i != body and self.chars[i] and density[i] >= threshold > 0:
                chosen[strongest[i]] = True
        chosen[best] = True
        around, path = -1, best
        while path > 0 and (around < 0 or tags[around] != "article"):
            if tags[path] in ("article", "main"):
                around = path
            path = parents[path]
        if around >= 0:
            chosen[around] = True
        heading = max((i for i in blocks if tags[i] == "h1" and i < best and not share[i]), default=-1)
        if heading >= 0:
            chosen[heading] = True
        for i in range(1, n):
            listed = share[i] >= LINKED and self.link_tags[i] >= LINKS and self.chars[i] and tags[i] not in INLINE
            named_out = share[i] == 1 and self.hinted[i]
            if density[i] < threshold and (listed or named_out):
                self.left_out[i] = True
            self.left_out[i] |= self.left_out[parents[i]]
            chosen[i] |= chosen[parents[i]]
        pieces = [(block[i], t) for i, t in self.pieces if chosen[i] and not self.left_out[i]]
        kept = [tags[i] in ("article", "main") for i in range(n)]  # what stands there, or as a paragraph beside the densest text, is no footer
        beside = [i == best for i in range(n)]
        for i in range(1, n):
            kept[i] |= kept[parents[i]]
            beside[i] |= beside[parents[i]]
        while True:
            k, last, size = len(pieces), None, 0
            while k and (not pieces[k - 1][1].strip() or last in (None, pieces[k - 1][0])) and size <= FOOTER:
                k -= 1
                if pieces[k][1].strip():
                    if kept[pieces[k][0]] or beside[pieces[k][0]] and tags[pieces[k][0]] == "p":
                        size = FOOTER + 1
                    last, size = pieces[k][0], size + len(pieces[k][1])
            if not any(t.strip() for _, t in pieces[:k]) or size > FOOTER or not _FOOTER.search("".join(t for _, t in pieces[k:])):
                break  # the whole text is never a footer
            del pieces[k:]
        return " ".join("".join(t for _, t in pieces).split())


def main_text(source: str | None) -> str:
    """Text of the article; empty for null, empty or textless pages."""
    return Page(source).article() if source else ""


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """Input columns plus ``text`` and ``n_chars`` (code points); each row by itself, nothing is shuffled.

    Null and empty html give an empty text; repeated rows, null ids and urls stay as they
    are; input columns named ``text`` or ``n_chars`` are replaced, others of any name stay;
    of nodes with equal sums an ``article`` or ``main`` goes first, then the first one.
    """

    @F.pandas_udf("string")
    def text(sources: pd.Series) -> pd.Series:
        return pd.Series([main_text(s) for s in sources], dtype=object)

    out = pages.drop("text", "n_chars").withColumn("text", text(F.col(html)))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")
