"""Main text of web pages from a streaming parser's events.

The standard library's parser feeds a small state machine that cuts the page
into blocks ("lines") and leaves out elements that are never main text
(menus, forms, scripts, asides).  Parts whose class or role says so are marked
and left out too, unless they hold most of a page without an article, or nothing
would be left.  Each
line's text-to-tag ratio is smoothed with a Gaussian; a threshold between the
two clusters of smoothed ratios marks content lines; the container that holds
most of them is the content region and is taken whole.
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Elements left out with all they hold.
NEVER = frozenset("script style noscript template svg math iframe object embed canvas audio video select button textarea "
                  "form nav footer aside dialog head title menu".split())
#: Elements that begin and end a line.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure "
                   "footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table "
                   "tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of class and id names, and roles, that mark other parts of a page.
MARKS = re.compile(r"(?:^|[\s_-])(?:ad|ads|adv|advert\w*|adbox|banner|breadcrumbs?|byline-share|comments?|commentlist|consent|"
                   r"cookies?|disclaimer|disqus|footer|gdpr|header|masthead|menu|modal|nav|navbar|navigation|newsletter|notices?|"
                   r"pagination|pager|popup|promo\w*|recommend\w*|related|replies|reply|respond|search|share|sharing|sidebar|signup|"
                   r"social|sponsor\w*|subscribe|toolbar|topbar|widget|alert|paywall|login|rail)(?:$|[\s_-])", re.I)
#: What stands beside such words in ids, and in classes of paragraphs; other
#: names, like related-work or share-price, are of the text itself.
BESIDE = re.compile(r"(?:posts?|articles?|stories|items?|list|box|form|section|area|bar|wrap\w*|container|content|left|right|top|bottom|main|"
                    r"site|page|block|links?|buttons?|icons?|media|thread|primary|secondary|slot|unit|text|message|\d+)?$", re.I)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TEXT = frozenset("p pre blockquote dd dt td th figcaption".split()) | HEADINGS
#: An article beside a heavier one belongs to the page if it has this share of its content.
BESIDE_SHARE = 0.25
#: Classes that say something about the page or the post: has-sidebar, tag-social, entry-header.
MODIFIERS = re.compile(r"(?:has|no|with|without|tag|category|cat)[_-]|(?:entry|article|post|story|content|page)[_-]+header$", re.I)
HEADERS = re.compile(r"(?:^|[_-])(?:header|masthead)(?:$|[_-])", re.I)
#: Elements that leave an open head open.
OF_HEAD = frozenset("head title meta link style script noscript base template".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
CONTENT = frozenset(("article", "main"))
#: Width of the Gaussian, in lines.
SIGMA = 1.0


class _Lines(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, str, int]] = []  # text, tags, characters in links, element, region
        self.marked: list[int] = []  # of each line, the innermost marked element around it (0: none)
        self.open: list[tuple[str, bool, bool]] = []  # block elements, whether each is left out, and marked
        self.names: Counter[str] = Counter()  # the same, counted
        self.marks: list[int] = []  # the marked ones among them
        self.outer = [0]  # of each marked element, the next one around it
        self.parts: list[str] = []
        self.tags = self.linked = self.links = self.left_out = 0
        self.region, self.regions = 0, 0  # 0: outside of any article or main part
        self.inside: list[int] = []

    def _flush(self):
        text = " ".join("".join(self.parts).split())
        if text:
            self.lines.append((text, self.tags, self.linked, self.open[-1][0] if self.open else "", self.region))
            self.marked.append(self.marks[-1] if self.marks else 0)
        self.parts, self.tags, self.linked = [], 0, 0

    def parse_html_declaration(self, i):
        """Whatever begins with <! and is no comment ends at the next >."""
        if self.rawdata.startswith("<!--", i):
            return self.parse_comment(i)
        return self.rawdata.find(">", i + 2) + 1 or -1

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag == "br":
            self.parts.append(" ")
        if tag == "a":
            self.links = 1
        if self.names["head"] and tag not in OF_HEAD and (tag == "body" or not (self.names["noscript"] or self.names["template"])):
            self._close("head")  # its end tag may be missing
        hidden, marked = self._hidden(tag, attrs), self._marked(tag, attrs)
        if tag in CONTENT and not hidden and not marked:
            self._flush()
            while (self.left_out or self.marks) and self.open:  # an element that was never closed does not hide the article
                self._pop()
        if tag not in BLOCKS and tag not in NEVER:
            return
        if tag in BLOCKS:
            self._flush()
            self.links = 0
            if self.open and self.open[-1][0] == "p":
                self._pop()
        if tag in VOID:
            return
        out = tag in NEVER or hidden
        marked = marked or (tag == "header" and not self.region)
        self.open.append((tag, out, marked))
        self.names[tag] += 1
        self.left_out += out
        if marked:
            self.outer.append(self.marks[-1] if self.marks else 0)
            self.marks.append(len(self.outer) - 1)
        if tag in CONTENT and not self.left_out and not self.marks:
            if not self.region:
                self.regions += 1
                self.region = self.regions
            self.inside.append(len(self.open))

    @staticmethod
    def _hidden(tag, attrs):
        if tag in ("html", "body"):
            return False
        a = {k: v or "" for k, v in attrs}
        return bool("hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "").lower())

    def _marked(self, tag, attrs):
        if tag in ("html", "body") or (tag in CONTENT and not self.region and not self.marks):
            return False
        a = {k: v or "" for k, v in attrs}
        if a.get("role", "").lower() in ROLES:
            return True
        if tag in HEADINGS:
            return False
        names = [(name, tag in TEXT) for name in a.get("class", "").split()] + [(name, True) for name in a.get("id", "").split()]
        return any(MARKS.search(name) and not MODIFIERS.match(name) and not (self.region and HEADERS.search(name))
                   and not (whole and not all(MARKS.match(x) or BESIDE.match(x) for x in re.split("[_-]", name)))
                   for name, whole in names)

    def _pop(self):
        tag, out, marked = self.open.pop()
        self.names[tag] -= 1
        self.left_out -= out
        if marked:
            self.marks.pop()
        if self.inside and self.inside[-1] > len(self.open):
            self.inside.pop()
            if not self.inside:
                self.region = 0

    def handle_endtag(self, tag):
        self.tags += 1
        if tag == "a":
            self.links = 0
        if tag not in BLOCKS and tag not in NEVER:
            return
        if tag in BLOCKS:
            self._flush()
        self._close(tag)

    def _close(self, tag):
        if self.names[tag]:
            while self.open:
                last = self.open[-1][0]
                self._pop()
                if last == tag:
                    break

    def content_lines(self) -> list[tuple[str, int, int, str, int]]:
        """The lines outside of marked elements.  Without an article an element
        with most of the text is not one of the page's other parts; all lines
        count if none is left."""
        kept = np.zeros(len(self.outer), dtype=bool)
        kept[0] = True
        if not any(line[-1] and not m for line, m in zip(self.lines, self.marked, strict=True)):
            size = np.bincount(self.marked, [len(line[0]) for line in self.lines], len(self.outer))
            total = size.sum()
            for m in range(len(self.outer) - 1, 0, -1):  # inner elements have higher numbers
                size[self.outer[m]] += size[m]
            for m in range(1, len(self.outer)):
                kept[m] = kept[self.outer[m]] and size[m] > total / 2
        return [line for line, m in zip(self.lines, self.marked, strict=True) if kept[m]] or self.lines

    def handle_data(self, data):
        if self.left_out and self.open[-1][0] == "head" and data.strip():
            self._close("head")
        if self.left_out:
            return
        self.parts.append(data)
        if self.links:
            self.linked += len(data)


def _threshold(x: np.ndarray) -> float:
    """Border between the two clusters of the values (2-means on one axis)."""
    low, high = float(x.min()), float(x.max())
    for _ in range(20):
        border = (low + high) / 2
        below, above = x[x <= border], x[x > border]
        if not len(above):
            return low
        new = float(below.mean()), float(above.mean())
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def main_text(html: str) -> str:
    """The main text: its blocks joined by blank lines; empty if there is none."""
    parser = _Lines()
    parser.feed(html)
    parser.close()
    parser._flush()
    lines = parser.content_lines()
    if not lines:
        return ""
    ratio = np.array([max(0, len(t) - 2 * linked) / (1 + tags) for t, tags, linked, *_ in lines])
    reach = np.arange(-3, 4)
    kernel = np.exp(-(reach ** 2) / (2 * SIGMA ** 2))
    smooth = np.convolve(ratio, kernel, mode="full")[3:3 + len(ratio)]
    smooth /= np.convolve(np.ones(len(ratio)), kernel, mode="full")[3:3 + len(ratio)]
    content = smooth >= _threshold(smooth)
    region = np.array([r for *_, r in lines])
    mass = np.bincount(region, weights=ratio * content, minlength=parser.regions + 1)
    if parser.regions and mass[1:].max() > 0:
        best = 1 + int(np.argmax(mass[1:]))
        unlinked = np.bincount(region, weights=ratio, minlength=parser.regions + 1)
        whole = unlinked >= BESIDE_SHARE * unlinked[best]  # articles or main parts, whole
        whole[[0, best]] = False, True
        chosen = whole[region]
    else:
        found = np.flatnonzero(content & (ratio > 0))
        if not len(found):
            return ""
        chosen = np.zeros(len(lines), dtype=bool)
        chosen[found[0]:found[-1] + 1] = True  # short lines between content lines belong to it
        for i in range(found[0] - 1, -1, -1):  # so do unlinked lines right before and after
            if lines[i][2] and lines[i][3] not in TEXT:
                break
            chosen[i] = True
        for i in range(found[-1] + 1, len(lines)):
            if lines[i][2] and lines[i][3] not in TEXT:
                break
            chosen[i] = True
    return "\n\n".join(line[0] for line, keep in zip(lines, chosen, strict=True) if keep)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row; a null page is empty,
    malformed markup is read as far as it goes.  Articles side by side are all
    kept but for those with little of the heaviest one's content; equal ones tie."""

    def extract(batches):
        for batch in batches:
            texts = [main_text(h) if h else "" for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(extract, "page_id long, url string, text string, n_chars long")
