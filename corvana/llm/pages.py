"""Main text of web pages by two-pass block rules.

A page is read once into blocks of text between block-level tags, with the elements each lies in. First pass: a block is bad
in a boilerplate element (by tag, role, class or id) or with many links; good in an article, or long with enough stop words;
bad if long without them; and else undecided. Names decide alone where all their words say boilerplate (`cookie-notice-box`),
and whatever their other words where one is never said of an article (`reader-comments`, `ad-slot`), unless it only tells that
such a part is there or not (`comments-open`, `no-ads`); where a name has other words too (`legal analysis`), or in an article
only words that may as well name a part of it (`tags`, `legal`), density, length and links decide. A block that is one link is
undecided in an article, where it may be a source, and elsewhere if it is short and in no list: it may be a byline. Second
pass: an undecided block takes the label of its nearest decided neighbour, of its own container before others and, at equal
distance, of the one that follows if it is a heading; a heading looks past rows of links. An article's long blocks are good
whatever their stop words: they may be code, tables or another language. Where no block of a page is good, those are that no
name and no link speaks against: a page of short paragraphs, or plain text.

Both passes are linear in the page: tags are found by one scan, open elements are counted, and nearest neighbours come from
a sweep in each direction.

Defined results: null and empty html give the empty text. Broken markup is read as far as it goes: unknown or unmatched end
tags are skipped, open elements end with the page, scripts and styles end at their own end tag only, and from a tag on whose
quotes never close, tags end at the next `>`. Repeated rows each give their row. Nothing is cut or capped, whatever a page's
size. An empty table gives an empty result. `extract` puts its result in place of a column of the same name; other columns
pass through.
"""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

#: What follows `<` in a tag, and the rest of it up to `>` with its quotes.
NAME = re.compile(r"(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
REST = re.compile(r"(?>[^>\"']+|\"[^\"]*\"|'[^']*')*+>")
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
RAW = {x: re.compile(rf"</{x}\s*>", re.IGNORECASE) for x in ("script", "style", "textarea", "noscript", "template", "title", "svg", "iframe")}
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements an opening tag ends when they are open.
ENDS = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "tr": {"tr", "td", "th", "p"}} | {x: {"p"} for x in "h1 h2 h3 h4 h5 h6 ul ol dl div section article table blockquote pre form footer header nav aside main figure hr address".split()}
BAD_TAGS = frozenset("nav footer aside form head button select dialog menu fieldset legend".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search alert dialog menu menubar".split())
BAD_NAMES = re.compile(
    r"(?:^|(?<=[\s_-]))(?:ads?|adverts?|advert(?:isement|ising|s)?|sponsor(?:ed|s)?|promos?|promotions?|banners?|cookies?|consent|gdpr|notices?|notifications?|alerts?|side-?bars?|widgets?|navs?|navbar|navigation|menus?|breadcrumbs?|"
    r"comments?|comment-?list|respond|replies|discussion|disqus|footers?|masthead|site-?header|page-?header|topbar|toolbar|shar(?:e|ing)|social|newsletter|subscri(?:be|ption)|sign-?up|login|popups?|modal|overlay|related|recommend(?:ed|ations)?|pagination|pager|copyright|legal|disclaimer|search|tags?|toc)(?=$|[\s_-])",
    re.IGNORECASE,
)
#: Bad names that also name a part of an article, and words of a name that say nothing.
WEAK = frozenset("legal tag tags search discussion toc related alert alerts overlay disclaimer".split())
NEUTRAL = frozenset("box block list wrapper wrap section area container content item items bar panel inner outer row col column left right top bottom main site page global primary secondary small large sticky fixed floating inline links link button buttons icons text title articles posts stories topics reading products heading header body module component group the and of".split())
#: Names that are never an article's, whatever stands beside them, and words that make them say what a page has or has not.
STRONG = re.compile(r"ads?|adverts?|advertisements?|advertising|sponsor(?:ed|s)?|promos?|promotions?|cookies?|consent|gdpr|comments?|disqus|replies|shar(?:e|ing)|social|newsletter|subscri(?:be|ption)|popups?|modal")
ABOUT = frozenset("no not without has have with open closed enabled disabled off on hide hidden allow allowed".split())
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
#: Frequent words of the four languages.
STOP_WORDS = frozenset("""the of and to a in is that it for was on as be with by this are at from or an he his not have they you which had were but we her she there been their has will would all if can who
der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über so zum
le la les de des du un une et en que qui est dans pour par sur pas au aux ce il elle ne se son sa avec plus ou sont cette mais ont
el los las y que en un una por con no para es se su al lo como más o pero sus le ha me si sin sobre este ya entre cuando""".split())
LONG, STOPS_HIGH, LINKS_HIGH = 70, 0.12, 0.5
WORD = re.compile(r"[^\W\d_]+").findall


class Block:
    __slots__ = ("anchors", "article", "bad", "container", "dull", "heading", "in_article", "label", "last", "linked", "listed", "parts", "row", "text")

    def __init__(self, bad: int, in_article: bool, container: int, heading: bool, article: bool = False, listed: bool = False):
        self.parts, self.linked, self.text = [], 0, ""
        self.bad, self.in_article, self.container, self.heading, self.label = bad, in_article, container, heading, None
        self.article, self.listed = article, listed  # in an article element, in a list
        self.anchors, self.last = 0, None  # how many links it has, and the last of them
        self.row = self.dull = False  # bad for its links alone, or for its lack of stop words


def named(name: str, in_article: bool) -> int:
    """What a class or id says of a block: 0 nothing, 1 a word among others, 2 a word that an article may use, 3 boilerplate."""
    found = [m.group().lower() for m in BAD_NAMES.finditer(name)]
    if not found:
        return 0
    for token in name.lower().split():
        words = re.split(r"[_-]+", token)
        if any(map(STRONG.fullmatch, words)) and ABOUT.isdisjoint(words):
            return 3
    others = [w for w in re.split(r"[\s_-]+", BAD_NAMES.sub(" ", name).lower()) if w and not w.isdigit() and w not in NEUTRAL]
    if others:
        return 1
    return 2 if in_article and WEAK.issuperset(found) else 3


def badness(tag: str, attributes: str, in_article: bool) -> int:
    if tag in BAD_TAGS or tag == "header" and not in_article:
        return 3
    if not attributes.strip() or tag in ("html", "body", "main"):
        return 0
    found = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(attributes)}
    if found.get("role", "").lower() in BAD_ROLES or found.get("aria-hidden", "").lower() == "true" or HIDDEN.search(found.get("style", "")):
        return 3
    if re.search(r"(?:^|\s)hidden(?:\s|$)", re.sub(r"=\s*(?:\"[^\"]*\"|'[^']*')", " ", attributes)):
        return 3
    return max(named(found.get(k, ""), in_article) for k in ("class", "id"))


class Open:
    """Open elements: how many of each tag, and where the block-level ones are."""

    def __init__(self):
        self.stack: list[tuple[str, int, bool, int]] = []  # tag, badness, in article, container
        self.counts: dict[str, int] = {}
        self.blocks: list[int] = []

    def push(self, tag: str, bad: int, in_article: bool, container: int) -> None:
        if tag in BLOCKS:
            self.blocks.append(len(self.stack))
        self.stack.append((tag, bad, in_article, container))
        self.counts[tag] = self.counts.get(tag, 0) + 1

    def pop(self) -> str:
        tag = self.stack.pop()[0]
        self.counts[tag] -= 1
        if self.blocks and self.blocks[-1] == len(self.stack):
            self.blocks.pop()
        return tag

    def close(self, tag: str) -> None:
        if self.counts.get(tag):
            while self.pop() != tag:
                pass

    def end(self, tags: frozenset | set) -> None:
        """Close the innermost blocks as long as they are of these tags."""
        while self.blocks and self.stack[at := self.blocks[-1]][0] in tags:
            while len(self.stack) > at:
                self.pop()

    def now(self) -> tuple[int, bool, int]:
        return self.stack[-1][1:] if self.stack else (0, False, 0)


HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
CONTAINERS = frozenset("article main section div nav aside header footer form body".split())


def blocks(page: str) -> list[Block]:
    """Blocks of text in page order."""
    out: list[Block] = []
    held = Open()
    containers, at, end_of_page, quotes, anchor = 0, 0, len(page), True, 0
    endless: set[str] = set()
    now: Block | None = None

    def add(text: str) -> None:
        nonlocal now
        if not text or now is None and text.isspace():
            return
        if now is None:
            now = Block(*held.now(), any(held.counts.get(h) for h in HEADINGS), bool(held.counts.get("article")), bool(held.counts.get("li")))
            out.append(now)
        text = html.unescape(text)
        now.parts.append(text)
        if held.counts.get("a") and (size := len(text.strip())):
            now.linked += size
            now.anchors += now.last != anchor
            now.last = anchor

    while at < end_of_page:
        begin = page.find("<", at)
        if begin < 0:
            add(page[at:])
            break
        m = NAME.match(page, begin + 1)
        if not m and page[begin + 1 : begin + 2] not in ("!", "?"):
            add(page[at : begin + 1])
            at = begin + 1
            continue
        add(page[at:begin])
        if not m:
            end = "-->" if page.startswith("<!--", begin) else ">"
            found = page.find(end, begin + 2)
            at = found + len(end) if found >= 0 else end_of_page
            continue
        rest = REST.match(page, m.end()) if quotes else None
        if rest:
            at = rest.end()
        else:
            quotes = False
            found = page.find(">", m.end())
            at = found + 1 if found >= 0 else end_of_page
        tag, attributes = m[2].lower(), page[m.end() : at - 1]
        if m[1]:
            if tag in BLOCKS:
                now = None
            held.close(tag)
            continue
        if tag in RAW and tag not in endless:
            end = RAW[tag].search(page, at)
            if end or tag in ("script", "style", "textarea", "title"):
                at = end.end() if end else end_of_page
                continue
            endless.add(tag)
        if tag in BLOCKS:
            now = None
            held.end(ENDS.get(tag, frozenset()))
        elif tag == "br":
            add(" ")
        if tag in VOID:
            continue
        anchor += tag == "a"
        bad, article, container = held.now()
        bad = max(bad, badness(tag, attributes, article))
        if tag in CONTAINERS:
            containers += 1
            container = containers
        held.push(tag, bad, article or tag in ("article", "main"), container)
    for b in out:
        b.text = " ".join("".join(b.parts).split())
    return [b for b in out if b.text]


def first_pass(b: Block) -> bool | None:
    words = WORD(b.text.lower())
    linked = b.linked / len(b.text)
    stops = sum(w in STOP_WORDS for w in words) / max(len(words), 1)
    if b.bad == 3:
        return False
    if linked > LINKS_HIGH:
        if not b.bad and b.anchors == 1 and (b.article or not b.listed and len(b.text) < LONG):
            return None
        b.row = not b.bad and not b.listed
        return False
    if len(b.text) >= LONG:
        if b.bad:
            return stops >= STOPS_HIGH and linked <= LINKS_HIGH / 2
        b.dull = not b.in_article and stops < STOPS_HIGH
        return not b.dull
    return False if b.bad == 2 else None


def sweep(found: list[Block], order: range) -> list[tuple[int | None, int | None, int | None]]:
    """For each block the last decided one before it in the order: of its container, of its side of the article, of all; for a
    heading, of those that are no rows of links."""
    last: dict = {}
    near = [(None, None, None)] * len(found)
    for k in order:
        b = found[k]
        keys = (("c", b.container), ("a", b.in_article), ("all",))
        near[k] = tuple(last.get((b.heading, *x)) for x in keys)
        if b.label is not None and b.bad != 3:
            for x in keys:
                last[False, *x] = k
                if not b.row:
                    last[True, *x] = k
    return near


def decide(found: list[Block]) -> None:
    """Both passes over the blocks of a page."""
    for b in found:
        b.label = first_pass(b)
    if not any(b.label for b in found):
        for b in found:
            b.label = not b.bad and (b.label is None or b.dull)
        return
    before, after = sweep(found, range(len(found))), sweep(found, range(len(found) - 1, -1, -1))
    labels = {}
    for k, b in enumerate(found):
        if b.label is None:
            labels[k] = b.in_article  # no decided block but those in boilerplate elements
            for x, y in zip(before[k], after[k], strict=True):
                if x is not None or y is not None:
                    nearer = y if x is None else x if y is None else x if k - x < y - k or k - x == y - k and not b.heading else y
                    labels[k] = found[nearer].label
                    break
    for k, label in labels.items():
        found[k].label = label


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    decide(found)
    return "\n\n".join(b.text for b in found if b.label)


def extract(pages: DataFrame, column: str = "html", to: str = "text") -> DataFrame:
    """pages with the main text of each."""

    @F.pandas_udf("string")
    def run(column: pd.Series) -> pd.Series:
        return column.map(main_text)

    return pages.withColumn(to, run(F.coalesce(column, F.lit(""))))


def op10(spark, sf_dir: str) -> DataFrame:
    found = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
