"""HTML extraction by maximum-scoring subsequence.

A page is a row of tokens: words and tags. Words score positive and tags negative, by log-odds that labelled pages give to
what a token is and where it stands (inside which kind of element). One linear scan finds the contiguous run of tokens
with the largest sum; elements inside it whose words score negative (adverts, asides, comments) are left out of its text.

Defined results: a null or empty page, or one without a positive run, has the empty text; of equal runs the first is
taken; a comment, tag or raw element that is never closed takes the rest of its page; a very long page is scanned once;
repeated rows give equal rows; an empty table an empty result; columns other than the named ones are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame

from tilewright.llm.common import arrow_pass
from tilewright.llm.htmllabels import PAGES

#: Fixed values of HTML: elements whose content is no text, without content, and those that begin a new block.
RAW = frozenset("script style noscript template svg math head title iframe object canvas select textarea button".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements that a new block of the kind ends without a tag.
ENDS_P = BLOCK - {"body", "html"}
#: Kinds of surroundings by element, and by a word of class, id or role. First that fits wins.
ELEMENTS = {"nav": "nav", "menu": "nav", "footer": "footer", "header": "header", "aside": "aside", "form": "form", "dialog": "notice", "article": "article", "main": "article"}
MARKS = (
    ("comments", re.compile(r"comment|disqus|reply|replies|respond|discussion")),
    ("ad", re.compile(r"^(ad|ads|adv|advert\w*|adsbygoogle|sponsor\w*|promo\w*|banner|commercial)$")),
    ("notice", re.compile(r"cookie|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscribe|paywall|^dialog$|disclaimer|legal")),
    ("nav", re.compile(r"^(nav\w*|menu\w*|breadcrumbs?|pagination|pager|topbar|toolbar|tabs|skip)$")),
    ("aside", re.compile(r"sidebar|^(aside|widget\w*|related|recommended|popular|share|sharing|social|tags|complementary|author|byline)$")),
    ("footer", re.compile(r"^(footer\w*|contentinfo|copyright|colophon|imprint)$")),
    ("header", re.compile(r"^(header|masthead|logo|site-header|search)$")),
    ("form", re.compile(r"^(form|signup|login|signin)$")),
    ("article", re.compile(r"^(article\w*|content|post|entry|story|main|text|prose)$")),
)
#: Ends the kind of what an article holds besides its text: left out, but no border of the article.
INSIDE = "+"
_NAME, _BARE, _BLANK = re.compile(r"[A-Za-z][^\s/>]*"), re.compile(r"[^\s>]*"), re.compile(r"\s*")
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPACE = re.compile(r"\s+")


def kind_of(tag: str, attributes: str) -> str | None:
    """What an element says about its words: a kind, or None if it says nothing."""
    if tag in ELEMENTS and ELEMENTS[tag] != "article":
        return ELEMENTS[tag]
    if attributes and ("=" in attributes):
        words = [w for _, a, b, c in _ATTR.findall(attributes) for w in re.split(r"[\s_\-]+", (a or b or c).lower()) if w]
        for name, pattern in MARKS:
            if any(map(pattern.search, words)):
                return name
    return ELEMENTS.get(tag)


def _tag_end(page: str, at: int) -> int:
    """Where the tag ends whose attributes begin at: its ">" outside of quoted values, or the page's end.

    It only moves on: quotes count after "=" alone, and what has been looked at is never looked at again.
    """
    end = page.find(">", at)
    while end >= 0:
        equals = page.find("=", at, end)
        if equals < 0:
            return end
        at = _BLANK.match(page, equals + 1).end()
        if page[at : at + 1] in ("'", '"'):
            at = page.find(page[at], at + 1) + 1
            if not at:
                break
        else:
            at = _BARE.match(page, at).end()
        if end < at:
            end = page.find(">", at)
    return len(page)


def tokens(page: str) -> list[tuple[str, str, str, int]]:
    """(what, kind of surroundings, text, block) of each tag ("<p>" or "</p>", inline "<i>") and each piece of text ("#").

    One scan, linear in the page whatever is unclosed in it: an unclosed comment, tag or raw element takes the rest.
    """
    out: list[tuple[str, str, str, int]] = []
    stack: list[tuple[str, str]] = []  # open elements that matter: name, kind of what is inside
    opened: Counter = Counter()  # of each name, how many are open
    kind, block, at, size = "", 0, 0, len(page)
    low: str | None = None

    def enter(tag: str, inside: str) -> None:
        stack.append((tag, inside))
        opened[tag] += 1

    def leave(tag: str) -> str:
        """Closes elements up to the last open one of that name; the kind that is then around."""
        while stack:
            name = stack.pop()[0]
            opened[name] -= 1
            if name == tag:
                break
        return stack[-1][1] if stack else ""

    while at < size:
        if page[at] != "<":
            end = page.find("<", at)
            end = size if end < 0 else end
            out.append(("#", kind, page[at:end], block))
            at = end
            continue
        closing = page.startswith("/", at + 1)
        name = _NAME.match(page, at + 1 + closing)
        if name is None:
            if page.startswith("!--", at + 1):
                end = page.find("-->", at + 4)
                at = size if end < 0 else end + 3
            elif closing or page[at + 1 : at + 2] in ("!", "?"):
                end = page.find(">", at)
                at = size if end < 0 else end + 1
            else:  # a sign of its own
                out.append(("#", kind, "<", block))
                at += 1
            continue
        tag, end = name[0].lower(), _tag_end(page, name.end())
        attributes, at = page[name.end() : end], end + 1
        if end == size:
            break
        if not closing and tag in RAW:
            if attributes.endswith("/"):
                continue
            low = page.lower() if low is None else low
            end = low.find(f"</{tag}", at)
            close = page.find(">", end) if end >= 0 else -1
            at = close + 1 if close >= 0 else size
            out.append((f"<{tag}>", kind, "", block))
            if tag in ("head", "title"):
                block += 1
            continue
        if tag in VOID:
            if tag in BLOCK:
                block += 1
            elif tag == "br":
                out.append(("#", kind, " ", block))
            continue
        if closing:
            if opened[tag]:
                kind = leave(tag)
            out.append((f"</{tag}>" if tag in BLOCK else "</i>", kind, "", block))
            block += tag in BLOCK
            continue
        if tag in ENDS_P and any(x[0] == "p" for x in stack[-3:]):
            kind = leave("p")
        if tag in BLOCK:
            block += 1
            inside = kind_of(tag, attributes)
            if inside == "header" and kind == "article":
                inside = "article"  # an article's own header
            own = inside or kind
            if kind not in ("", "article") and inside == "article":
                own = kind  # nothing inside a menu or a comment is the article
            elif kind == "article" and own != "article":
                own += INSIDE
            out.append((f"<{tag}>", own, "", block))
            kind = own
        else:
            out.append(("<a>" if tag == "a" else "<i>", kind, "", block))
            inside = kind_of(tag, attributes) if attributes and tag in ("span", "a", "ins", "label", "small", "dialog") else None
            if inside and inside != "article" and not kind.endswith(INSIDE):
                kind = inside + (INSIDE if kind == "article" else "")
        enter(tag, kind)
    return out


def features(what: str, kind: str) -> tuple[str, ...]:
    """The weights that a token's score adds up: of a word its surroundings, of a tag also itself outside of the article."""
    if what == "#":
        return (f"word in {kind or 'body'}",)
    return ("tag in article",) if kind == "article" or kind.endswith(INSIDE) else (what, f"tag in {kind or 'body'}")


def learn(pages: tuple = PAGES) -> dict[str, float]:
    """Log-odds of each feature's tokens inside main text against outside; words count each, tags as one."""
    inside, outside = Counter(), Counter()
    for page in pages:
        own = False
        for what, kind, text, _ in tokens(page.replace("[[", "\x01").replace("]]", "\x02")):
            for part in re.split("([\x01\x02])", text) if what == "#" else [text]:
                if part in ("\x01", "\x02"):
                    own = part == "\x01"
                    continue
                n = len(part.split()) if what == "#" else 1
                if n:
                    for f in {*features(what, kind), *([what] if what != "#" else [])}:
                        (inside if own else outside)[f] += n
    weight = {}
    for f in {*inside, *outside}:
        odds = math.log((inside[f] + 0.5) / (outside[f] + 0.5))
        if f.endswith(INSIDE):
            weight[f] = 0.0
            continue
        # a tag never adds to a run: inside the article it costs little, at the page's frame it costs much
        weight[f] = min(max(odds, -4.0), 2.0) if f.startswith("word") else min(max(odds, -4.0) - 0.2, -0.2) if f.startswith("<") else min(max(odds, -4.0), -0.02)
    weight["word in body"] = max(weight.get("word in body", 0.0), 1.0)  # with no mark of any kind, words are text
    weight["tag in body"] = max(weight.get("tag in body", 0.0), -0.5)
    return weight


class Extractor:
    def __init__(self, pages: tuple = PAGES):
        self.weight = learn(pages)
        self.memo: dict[tuple[str, str], float] = {}

    def score(self, what: str, kind: str) -> float:
        got = self.memo.get((what, kind))
        if got is None:
            got = self.memo[what, kind] = sum(self.weight.get(f, 0.0 if f.endswith(INSIDE) else 0.5 if f.startswith("word") else -0.2) for f in features(what, kind))
        return got

    def region(self, page: list[tuple[str, str, str, int]]) -> tuple[int, int]:
        """The run of tokens with the largest sum, as a slice; the first of several, empty if no sum is positive."""
        best, now, begin, found = 0.0, 0.0, 0, (0, 0)
        for i, (what, kind, text, _) in enumerate(page):
            if what == "#":
                n = len(text.split())
                if not n:
                    continue
                now += n * self.score(what, kind)
            else:
                now += self.score(what, kind)
            if now <= 0:
                now, begin = 0.0, i + 1
            elif now > best:
                best, found = now, (begin, i + 1)
        return found

    def text(self, page: str | None) -> str:
        if not page:
            return ""
        row = tokens(page)
        a, b = self.region(row)
        blocks: list[list[str]] = []
        last = None
        for what, kind, text, block in row[a:b]:
            if what != "#" or self.score(what, kind) <= 0:
                continue
            if block != last:
                blocks.append([])
                last = block
            blocks[-1].append(text)
        joined = (_SPACE.sub(" ", html.unescape("".join(x))).strip() for x in blocks)
        return " ".join(x for x in joined if x)


_one: list[Extractor] = []


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """key, url, text, n_chars (code points) of every page."""

    def work(batch: pa.RecordBatch) -> dict:
        if not _one:
            _one.append(Extractor())
        texts = [_one[0].text(p) for p in batch[2].to_pylist()]
        return {key: batch[0], url: batch[1], "text": texts, "n_chars": pa.array(map(len, texts), pa.int64())}

    kinds = dict(pages.dtypes)
    return arrow_pass(pages, [key, url, page], work, f"{key} {kinds[key]}, {url} {kinds[url]}, text string, n_chars long")
