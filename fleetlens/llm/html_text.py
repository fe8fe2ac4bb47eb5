"""Main text of web pages by line-block distribution.

The markup of a whole page is stripped into lines, one per block of text; every line has a
length, which is 0 for what is no article text: lines in menus, headers, footers, sidebars, notices,
adverts, forms and reader comments (told by their elements, roles, whole class names and ids) and, where the
page names an article or a main part, lines outside it.  Text inside links doesn't count.  A class name or id never leaves out a main part below it, nor an article
below it that is longer than the rest of the named text, save where it names reader comments: articles below these stay out
whatever their length; ids of headings, and plain words as ids of sections and inside
an article, don't count, for they are made from headings.
Lengths are summed over sliding windows of WINDOW lines.  A surge is where a window's sum rises above the
threshold, a dive where it falls back to 0.  All parts between a surge and its dive are kept, from the first to the last line
with a length, with all lines in them that are not left out, wholly linked ones too, and with the headings and
paragraphs at their edges that the windows of their first and last line reach.  The threshold is SURGE
characters (or a third of the page's highest window, for short pages).  In a named article or main part it is 0, for nothing that is
written there may be lost, and only its own lines that are not left out are in the windows: there a dive is a run of WINDOW or more wholly linked
lines (a menu, a table of contents, a list of other stories without any telling name), which goes, at the article's
end together with the headings right before it; shorter runs stay.  Where all of it is linked, it stays whole.

Character references are decoded, white space in a line becomes one space, lines are joined by one space.

Defined results: a null page counts as empty and has an empty text; unclosed elements end with their
parents, an unclosed link counts in its first line only; an unclosed comment, and an unclosed element that HTML reads as raw text (script, style,
textarea, title, iframe, noembed, noframes, xmp), runs to the end of the page; a self-closed svg or math is
empty, an unclosed one ends at the next HTML block or with its parent; repeated rows are
extracted each on their own; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re

import numpy as np
from pyspark.sql import DataFrame

from fleetlens.llm.common import add_columns, free_name

WINDOW = 3
SURGE = 86

# fixed values: element names of the HTML standard
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span "
                    "strike strong sub sup time tt u var wbr img picture source track meter progress ruby rb rt rp".split())
# read as raw text, so that only their own end tag ends them
_RAW = frozenset("script style iframe textarea title noembed noframes xmp".split())
# parsed as any element, without text
_EMPTY = frozenset("noscript template object svg math canvas audio video select".split())
# parts of svg and math whose content is HTML again, and HTML elements that end an open svg or math
_HTML_AGAIN = frozenset("foreignobject desc title annotation-xml mi mo mn ms mtext".split())
_BREAKOUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre "
                      "ruby s small span strong strike sub sup table tt u ul var article section main aside header footer nav figure form".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_OUT = frozenset("nav footer aside form button fieldset dialog menu head".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
# words that name, as a whole class name or id, what is no article text; a name may have known words before and after
# them (main-nav, ad-slot-2), but other words make it another name (has-sidebar, layout-nav, related-work)
_WORDS = (r"ads?|adverts?|advertisement|advertising|adsense|banner|sponsor(?:ed)?|promo(?:tion)?|cookies?|consent|gdpr|notices?|"
          r"alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|nav|navbar|navigation|menu|breadcrumbs?|pagination|pager|sidebar|"
          r"side-bar|widget|related|recommended|share|sharing|social|comments?|commentlist|discussion|disqus|replies|respond|footer|foot|masthead|"
          r"topbar|toolbar|skip-link|hidden")
_BEFORE = "site|page|main|global|primary|secondary|top|bottom|mobile|desktop|sticky|fixed|post|article|entry|blog|reader|user|google|div|js|is|visually"
_AFTER = (r"wrapper|wrap|container|box|block|bar|area|list|links?|items?|inner|buttons?|icons?|panel|slot|unit|space|posts|articles|stories|"
          r"thread|form|\d+")
_END = "(?![^-])"  # a word ends here
_HINT = re.compile(rf"(?:(?:site|page)-header|comments?-(?:section|body|content|text|title|meta)|(?:(?:{_BEFORE})-)*+(?:{_WORDS}))"
                   rf"(?:-(?:{_WORDS}|{_AFTER}){_END})*+")
# the id of a section or of a part of an article is often made from its heading: there all words count, and one must be no plain word
_HINT_ID = re.compile(rf"(?:{_WORDS}|\d+)(?:-(?:{_WORDS}|\d+){_END})*+")
_NO_TOPIC = re.compile(r"(?:^|-)(?:ads?|adverts?|adsense|cookie|comments?|commentlist|disqus|respond|nav|navbar|breadcrumbs?|pager|sidebar|"
                       r"side-bar|footer|masthead|topbar|skip-link)(?:$|-)")
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

# an article inside or beside the main one that is a comment or a teaser
_SIDE_ARTICLE = re.compile(rf"(?:(?:{_BEFORE}|node)-)*+(?:comments?|reply|replies|teasers?|related|promo|sponsored|ads?)"
                           rf"(?:-(?:{_WORDS}|{_AFTER}|body|content|cards?|teasers?|reply){_END})*+")
# words that name reader comments in a class name or id that leaves an element out
_COMMENTS = re.compile(r"(?:^|-)(?:comments?|commentlist|discussion|disqus|reply|replies|respond)(?:$|-)")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
#: Elements that end at the next one of their name.
_SIBLINGS = frozenset("li dt dd tr td th option".split())

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_REST = re.compile(r"""(?:[^>"']|"[^"]*"|'[^']*')*+>""")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")


def _attributes(raw: str) -> dict[str, str]:
    return {k.lower(): html.unescape(a or b or c) for k, a, b, c in _ATTRIBUTE.findall(raw)}


def _tokens(names: str) -> list[str]:
    """Class names or ids in lower case, their words joined by one hyphen."""
    return ["-".join(re.findall(r"[^_-]+", t)) for t in _CAMEL.sub("-", names).lower().split()]


def _hints(name: str, at: dict[str, str], inside: int) -> list[str]:
    """The class names and ids of an element that say that it holds no article text."""
    classes, ids = _tokens(at.get("class", "")), _tokens(at.get("id", ""))
    if name == "article":
        return [t for t in classes + ids if _SIDE_ARTICLE.fullmatch(t)]
    if name in ("html", "body", "main", "h1"):
        return []
    out = [t for t in classes if _HINT.fullmatch(t)]
    if name in _HEADINGS:
        return out
    if inside or name == "section":
        return out + [t for t in ids if _HINT_ID.fullmatch(t) and _NO_TOPIC.search(t)]
    return out + [t for t in ids if _HINT.fullmatch(t)]


_BY_NAME, _AS_COMMENTS, _BY_ELEMENT = 1, 2, 3


def _left_out(name: str, raw: str, inside: int) -> int:
    """Whether an element holds no article text: 0, _BY_NAME (class names or id), _AS_COMMENTS (these name reader
    comments), _BY_ELEMENT (element, role, not shown)."""
    if name in _OUT or (name == "header" and not inside):
        return _BY_ELEMENT
    if "=" not in raw and "hidden" not in raw:
        return 0
    at = _attributes(raw)
    if "hidden" in at or at.get("aria-hidden") == "true" or at.get("role", "").lower() in _ROLES:
        return _BY_ELEMENT
    if "display:none" in at.get("style", "").replace(" ", "").lower():
        return _BY_ELEMENT
    hints = _hints(name, at, inside)
    return (_AS_COMMENTS if any(map(_COMMENTS.search, hints)) else _BY_NAME) if hints else 0


class Line:
    __slots__ = ("text", "linked", "out", "inside", "below", "prose", "heading")

    def __init__(self, text: str, linked: int, out: bool, inside: bool, below: int, prose: bool, heading: bool) -> None:
        self.text, self.linked, self.out, self.inside = text, linked, out, inside
        self.below, self.prose, self.heading = below, prose, heading

    def length(self) -> int:
        return max(len(self.text) - self.linked, 0)


_MAIN, _ARTICLE = 1, 2


def lines(page: str) -> list[Line]:
    """The non-empty lines of a page: text, characters inside links, whether left out, whether in an article or main part,
    the number of the article below an element that is left out by its name (0: none), whether a heading or paragraph, whether a heading."""
    out: list[Line] = []
    pieces: list[str] = []
    linked = 0
    # open block elements: name, left out, inside main or article, inside an element without text, inside svg or math, number as in Line
    stack: list[tuple[str, int, int, bool, bool, int]] = []
    left_out = inside = below = found_below = 0
    empty = foreign = False
    aside = False  # a paragraph that is left out
    link_from = 0  # the first line of the link
    link = prose = heading = False

    def end() -> None:
        nonlocal pieces, linked
        words = "".join(pieces).split()
        if words:
            text = " ".join(words)
            if linked > len(text) - len(words):
                linked = len(text)  # all but the spaces
            out.append(Line(text, linked, bool(left_out or aside), bool(inside), below, prose, heading))
        pieces, linked = [], 0

    def link_left_open() -> None:
        """A link without an end tag counts in its first line only."""
        nonlocal linked
        for r in out[link_from + 1:]:
            r.linked = 0
        if len(out) > link_from:
            linked = 0

    def close_to(k: int) -> None:
        """Close the elements from the k-th on."""
        nonlocal left_out, inside, empty, foreign, below
        del stack[k:]
        left_out, inside, empty, foreign, below = stack[-1][1:] if stack else (0, 0, False, False, 0)

    at, n = 0, len(page)
    last_cdata = page.rfind("]]>") - 8
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > at and not empty:
            text = html.unescape(page[at:lt])
            pieces.append(text)
            if link:
                linked += sum(map(len, text.split()))
        if lt == n:
            break
        mark = page[lt + 1:lt + 2]
        if mark == "!" or mark == "?":
            if page.startswith("<!--", lt):
                close = page.find("-->", lt + 4)
                at = n if close < 0 else close + 3
            elif foreign and lt < last_cdata and page.startswith("<![CDATA[", lt):
                at = page.find("]]>", lt + 9) + 3
            else:
                close = page.find(">", lt)
                at = n if close < 0 else close + 1
            continue
        ending = mark == "/"
        name_at = _NAME.match(page, lt + 1 + ending)
        if not name_at:
            if not empty:
                pieces.append("<")  # not a tag
            at = lt + 1
            continue
        name = name_at.group().lower()
        rest = _REST.match(page, name_at.end())
        close = rest.end() if rest else page.find(">", name_at.end()) + 1
        if not close:
            break  # a tag that never ends
        raw, at = page[name_at.end():close - 1], close
        if foreign and (name in ("p", "br") or name in _INLINE if ending else name in _BREAKOUT):
            k = next((k + 1 for k in range(len(stack) - 1, -1, -1) if not stack[k][4]), 0)
            if not ending or name not in _INLINE or all(e[0] != name for e in stack[k:]):
                close_to(k)
        if name == "a" and not empty:
            if link and not ending:
                link_left_open()
            link, link_from = not ending, len(out)
        if name in _INLINE and not foreign:
            continue
        if name in _RAW and not ending and not foreign:
            found = re.compile(rf"</{name}\b", re.I).search(page, at)
            close = page.find(">", found.end()) if found else -1
            at = n if close < 0 else close + 1
            if name != "textarea" and not empty:
                end()
            continue
        if not empty and name != "select":
            end()
        if not empty and name not in _EMPTY:
            prose = prose and name == "br" or not ending and (name == "p" or name in _HEADINGS)
            heading = heading and name == "br" or not ending and name in _HEADINGS
            aside = name == "p" and not ending and _left_out(name, raw, inside) > 0
        if name in _SIBLINGS and not ending and stack and stack[-1][0] == name:
            close_to(len(stack) - 1)
        if ending:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    if not stack[k][3]:
                        end()
                        if link:
                            link_left_open()
                        link = aside = False
                    close_to(k)
                    break
        elif name not in _VOID and name != "p" and not raw.endswith("/"):
            if not empty and name not in _EMPTY:
                here = _left_out(name, raw, inside)
                if name in ("article", "main"):
                    # a name doesn't blank a named part below it, but articles among reader comments are comments
                    if 0 < left_out <= (_BY_NAME if name == "article" else _AS_COMMENTS) and not here and inside != _ARTICLE:
                        left_out = 0
                        if name == "article":
                            found_below += 1
                            below = found_below
                    inside = max(inside, _ARTICLE if name == "article" else _MAIN)
                left_out = max(left_out, here)
            foreign = name in ("svg", "math") or foreign and name not in _HTML_AGAIN
            empty = empty or name in _EMPTY
            stack.append((name, left_out, inside, empty, foreign, below))
    end()
    if link:
        link_left_open()
    return out


def between_surges_and_dives(lengths: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Runs [first, last] of lines from a surge (a window's sum rises above ``threshold``) to its dive
    (a window's sum is 0 again), trimmed to lines with a length."""
    n = len(lengths)
    sums = np.append(0, np.cumsum(lengths))
    window = sums[np.minimum(np.arange(n) + WINDOW, n)] - sums[:-1]
    out, i = [], 0
    while i < n:
        up = np.flatnonzero(window[i:] > threshold)
        if not len(up):
            break
        surge = i + int(up[0])
        down = np.flatnonzero(window[surge:] == 0)
        dive = surge + int(down[0]) if len(down) else n
        full = np.flatnonzero(lengths[surge:dive])
        out.append((surge + int(full[0]), surge + int(full[-1])))
        i = dive + 1
    return out


def _settle_articles_below(rows: list[Line]) -> None:
    """Leave out the articles below elements with names such as related or comments, unless such an article
    is longer than all that is in other articles and main parts (without these, than all other text)."""
    sizes: dict[int, int] = {}
    named = other = 0
    for r in rows:
        if r.out:
            continue
        if r.below:
            sizes[r.below] = sizes.get(r.below, 0) + len(r.text)
        elif r.inside:
            named += len(r.text)
        else:
            other += r.length()
    for r in rows:
        if r.below and sizes.get(r.below, 0) <= (named or other):
            r.out = True


def _in_article(lengths: np.ndarray, rows: list[Line]) -> list[tuple[int, int]]:
    """The parts of a named article: all but its runs of WINDOW or more lines without a length, and but the headings that
    lead to such a run at its end."""
    parts = between_surges_and_dives(lengths, 0)
    first, last = parts[0][0], parts[-1][1]
    if first < WINDOW:
        parts[0] = (0, parts[0][1])
    if len(rows) - 1 - last < WINDOW:
        parts[-1] = (parts[-1][0], len(rows) - 1)
    else:
        while last > parts[-1][0] and rows[last].heading:
            last -= 1
        parts[-1] = (parts[-1][0], last)
    return parts


def main_text(page: str | None) -> str:
    """The main text of one whole page."""
    rows = lines(page or "")
    if not rows:
        return ""
    _settle_articles_below(rows)
    named = [r for r in rows if r.inside and not r.out]
    if named:
        rows = named
    lengths = np.array([0 if r.out else r.length() for r in rows])
    if named and not lengths.any():
        lengths = np.array([len(r.text) for r in rows])
    if named:
        return " ".join(r.text for a, b in _in_article(lengths, rows) for r in rows[a:b + 1])
    sums = np.append(0, np.cumsum(lengths))
    highest = max(sums[min(i + WINDOW, len(rows))] - sums[i] for i in range(len(rows)))
    keep: set[int] = set()
    for a, b in between_surges_and_dives(lengths, min(SURGE, highest / 3)):
        keep.update(k for k in range(max(a - WINDOW + 1, 0), min(b + WINDOW, len(rows))) if a <= k <= b or rows[k].prose)
    return " ".join(rows[k].text for k in sorted(keep) if not rows[k].out)


def extracted(pages: DataFrame, page: str = "html") -> tuple[DataFrame, str]:
    """``pages`` with the main text of every page; the second value names the column."""
    name = free_name(pages, "text")
    return add_columns(pages, page, {name: "string"}, lambda: lambda ps: [[main_text(p) for p in ps]]), name
