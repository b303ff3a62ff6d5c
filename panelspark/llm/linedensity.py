"""Main text of web pages by line-block distribution.

Markup is stripped to lines: one per block of text, with white space collapsed and character
references decoded. Text under menus, headers, footers, sidebars, notices, adverts, forms, scripts,
styles and reader comments leaves an empty line behind. Such empty lines, and lines that are mostly
links, part the page into runs of lines; an article or main element is one run of its own, whatever is
skipped or linked in it.

The lengths of a run's lines are summed over sliding windows of a few lines. Where a window's sum rises
over the threshold (surge) text begins, where it falls away (dive) it ends; a run with a surge is text and
is kept whole, with its short lines and its ends. The threshold is half a typical line: the length over which lines
hold half of the page's text, where no line counts for more than ``LONGEST`` characters. Lines in an
article count ``ARTICLE`` times, so that they need less to surge and the rest of the page more.

Defined results: a null, empty or text-less page has the empty text; a page cut off in the middle
ends where it ends; ids and repeated rows pass through; an empty table gives no rows. Only the
named columns are read, so other columns cannot clash.
"""

import html as entities
import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element and class names.
RAW = frozenset("script style noscript template textarea svg iframe object canvas math title".split())
SKIPPED = frozenset("nav footer aside form button select dialog menu head".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark q ruby rb rt rp "
    "s samp small span strike strong sub sup time tt u var wbr".split()
)
UNWANTED = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies "
    "consent gdpr notice alert sidebar nav navbar navigation menu breadcrumb breadcrumbs footer comment comments "
    "disqus respond replies share sharing social related recommended newsletter subscribe popup modal overlay "
    "widget toolbar pagination masthead".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
_TAG = re.compile(
    r"<!--(?:.*?-->|.*)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|</?[a-zA-Z][^>]*\Z",
    re.S,
)
_NAMED = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
#: Characters that one line counts for at most; what a line in an article counts for, in lines outside.
LONGEST, ARTICLE = 500, 4
_SPACE = re.compile(r"\s+")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_ENDS = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*>?", re.I) for name in RAW}


def _unwanted(name: str, attributes: str, inside: bool) -> bool:
    if name in SKIPPED or (name == "header" and not inside):
        return True
    if not attributes or name in ("article", "main", "body", "html"):
        return False
    for key, value in _NAMED.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
            return True
        if key == "role" and value.lower() in ROLES and not (inside and value.lower() == "banner"):
            return True
        if key in ("class", "id"):
            words = {w.lower() for w in _PART.findall(value)}
            if words & UNWANTED or ("header" in words and not inside):
                return True
    return False


def lines_of(page: str) -> list[tuple[str, int, int]]:
    """(text, characters inside links, number of its outermost article or 0) per line; skipped parts
    are empty lines."""
    lines, words, linked = [], [], 0
    stack: list[tuple[str, bool]] = []  # open elements, and whether each starts a skipped part
    opened: Counter[str] = Counter()  # how many of each name are open
    starts: list[int] = []  # where in the stack skipped parts start
    articles = links = number = at = 0

    def flush(gap=False):
        nonlocal words, linked
        text = _SPACE.sub(" ", "".join(words)).strip()
        if text:
            lines.append((text, linked, number if articles else 0))
        elif gap:
            lines.append(("", 0, 0))
        words, linked = [], 0

    def say(raw):
        nonlocal linked
        if raw and not starts:
            text = entities.unescape(raw)
            words.append(text)
            if links:
                linked += len(text)

    def close(depth):
        nonlocal articles, links
        while len(stack) > depth:
            name, off = stack.pop()
            opened[name] -= 1
            if off:
                starts.pop()
            articles -= name in ("article", "main")
            links -= name == "a"

    while True:
        tag = _TAG.search(page, at)
        say(page[at : tag.start()] if tag else page[at:])
        if not tag:
            break
        at = tag.end()
        name = (tag[2] or tag[5] or "").lower()
        if not name:
            continue
        ending, attributes = tag[1] or tag[4], tag[3] or tag[6] or ""
        if name not in INLINE:
            flush()
        if ending:
            if opened[name]:
                off, depth = bool(starts), len(stack) - 1
                while stack[depth][0] != name:
                    depth -= 1
                close(depth)
                if off and not starts:
                    flush(gap=True)
            continue
        if name in RAW:
            if not attributes.rstrip().endswith("/"):
                end = _ENDS[name].search(page, at)
                at = end.end() if end else len(page)
            continue
        if name in VOID:
            continue
        if name in ("article", "main") and starts:
            flush()
            close(starts[0])  # a part that was never closed
        if name in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and stack and stack[-1][0] == name:
            close(len(stack) - 1)
        off = _unwanted(name, attributes, articles > 0)
        if off and not starts:
            flush(gap=True)
        if off:
            starts.append(len(stack))
        stack.append((name, off))
        opened[name] += 1
        if name in ("article", "main"):
            number += not articles
            articles += 1
        links += name == "a"
    flush()
    return lines


def runs(lines: list[tuple[str, int, int]]) -> list[list[int]]:
    """Positions of lines in runs: parted by skipped parts and link lines outside, one per article."""
    found: list[list[int]] = []
    by_article: dict[int, list[int]] = {}
    new = True
    for i, (text, linked, article) in enumerate(lines):
        if article:
            if article not in by_article:
                found.append(by_article.setdefault(article, []))
            by_article[article].append(i)
            new = True
        elif not text or 2 * linked >= len(text):
            new = True
        else:
            if new:
                found.append([])
                new = False
            found[-1].append(i)
    return found


def surges(weights: list[int], window: int, least: float) -> bool:
    """Whether some window of lines holds more than ``least``."""
    held = sum(weights[:window])
    if held > least:
        return True
    for i in range(window, len(weights)):
        held += weights[i] - weights[i - window]
        if held > least:
            return True
    return False


def typical(weights: list[int]) -> int:
    """The length over which lines hold half of the text, long lines counted for LONGEST."""
    short = sorted((min(w, LONGEST) for w in weights if w), reverse=True)
    held, half = 0, sum(short) / 2
    for w in short:
        held += w
        if held >= half:
            return w
    return 0


def main_text(page, window: int = 3, share: float = 0.5) -> str:
    if not page:
        return ""
    lines = lines_of(page)
    weights = [len(text) * (ARTICLE if article else 1) for text, _, article in lines]
    parts = runs(lines)
    least = share * typical([weights[i] for part in parts for i in part])
    kept = [i for part in parts if surges([weights[i] for i in part], window, least) for i in part]
    return "\n".join(lines[i][0] for i in sorted(kept) if lines[i][0])


def extract(
    pages: DataFrame, window: int = 3, page_id: str = "page_id", url: str = "url", html: str = "html"
) -> DataFrame:
    """page_id, url, text, n_chars."""

    @F.pandas_udf("string")
    def text_of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: main_text(t, window))

    body = F.coalesce(F.col(html), F.lit(""))
    out = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), text_of(body).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("bigint"))
