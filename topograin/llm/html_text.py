"""HTML main-text extraction by two-pass block rules.

A page is cut into blocks at block-level tags. Structure marks the candidates: what stands in a
menu, header, footer, sidebar, notice, advert, form or comment thread is bad, and an
article or main element, or what stands for one, is a region of its own. The rules decide.
The first pass classifies each block by itself: one that is mostly links is bad; one that
is long with enough stop words, or of middle length with some and without links, is good; all else,
headings and long blocks without stop words among it, is ambiguous. In the second pass an
ambiguous block takes its label from the nearest decided blocks before and after it. In a
region a good one on either side is enough, and none outside it counts. Beside articles both
must agree or the nearer be good, and an article counts as bad. In a region without a good block the
ambiguous ones are judged together, as one block: bad if more than half of its text is links and too few
words are stop words, else good, for nothing else says that an article's text is none.
A page without regions and decided blocks keeps what is not bad.

Plan. Pages are independent: one streaming pass, no shuffle, no limit on length.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements by role.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
RAW = frozenset("script style noscript template iframe noembed noframes textarea title xmp object svg math canvas audio video select button datalist head".split())
LITERAL = frozenset("script style iframe noembed noframes textarea title xmp".split())
OUTSIDE = frozenset("nav footer aside form menu dialog fieldset".split())
ARTICLE = frozenset("article main".split())
CLOSED = frozenset("aside nav footer".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of class, id and role that mark what is no article, whatever stands beside them.
MARKS = frozenset(
    "advert adverts advertisement advertising adsense sponsored teaser"
    " nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toolbar topbar"
    " footer contentinfo copyright disclaimer colophon sidebar complementary"
    " cookie cookies gdpr notification notifications popup modal overlay lightbox paywall newsletter signup login searchbox"
    " comment comments commentlist disqus respond replies".split()
)
#: Words that do so only alone, or among such words and those of places.
WEAK_MARKS = frozenset(
    "ad ads adv banner sponsor promo promotion promoted legal aside widget widgets rail related recommended recommendations trending popular"
    " consent notice notices alert subscribe subscription search form reply discussion share sharing social follow dialog".split()
)
PLACES = frozenset("box boxes block blocks area slot unit container wrapper wrap inner outer section list links link items item posts post articles article stories story news content bar buttons button icons panel card cards left right top bottom header head title site page main global mobile desktop sticky fixed group row col column text html js".split())
#: Words that turn a mark round, as in no-sidebar.
WITHOUT = frozenset("no not has have with without hide hidden".split())
HEADER_MARKS = frozenset("header masthead siteheader".split())
THREAD_MARKS = frozenset("comment comments commentlist disqus respond replies".split())
#: Words of class, id, role and itemprop that mark the article of a page without such elements.
BODY_MARKS = frozenset("article post entry story main".split())
#: Frequent words of some languages.
STOP_WORDS = frozenset(
    "a about after all also an and are as at be been but by can could did do for from had has have he her his how i if in into is it its more no not of on one only or other our out she so some such than that the their them then there these they this to up was we were what when which who will with would you your"
    " aber als am an auch auf aus bei bin bis da das dass dem den der des die doch durch ein eine einem einen einer es für hat ich ihr im in ist kann mit nach nicht noch nur oder sich sie sind so über um und uns von vor war was wenn wie wir zu zum zur"
    " au aux avec ce ces cette dans de des du elle en est et eux il ils je la le les leur lui mais me même mes moi mon ne nos notre nous on ou où par pas plus pour qu que qui sa se ses son sur ta te tes toi ton tu un une vos votre vous"
    " al algo como con de del desde donde el ella ellos en entre era es esta este esto fue ha hay la las le les lo los más me mi muy no nos o para pero por porque que se ser si sin sobre su sus también te tiene un una uno y ya".split()
)
LONG, SHORT_STOPS, MIN_STOPS, LINKS, ARTICLE_LINKS = 140, 3, 0.15, 0.5, 0.8

_TAG = re.compile(r"""<!--(?:>|->|.*?(?:--!?>|$))|<(/?)([a-zA-Z][^\s/>]*)((?:[^"'>]|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|$)|<[!?/][^>]*(?:>|$)""", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z][\w:-]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_HAS_ARTICLE = re.compile(r"<(?:article|main)[\s>]", re.I)
_LETTERS = re.compile(r"[^\W\d_]+")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


@dataclass
class Block:
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    outside: bool = False
    article: bool = False
    region: int = 0
    heading: bool = False
    item: bool = False
    text: str = ""


def _marked(attributes: str, article: bool) -> bool:
    """True if class, id, role or hiding say that an element is no article."""
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        if name == "style" and "display:none" in value.replace(" ", "").lower():
            return True
        if name in ("class", "id", "role"):
            for part in value.split():
                words = {w.lower() for w in _WORD.findall(part)}
                if words & WITHOUT:
                    continue
                if words & MARKS or not article and words & HEADER_MARKS or words & WEAK_MARKS and all(w in WEAK_MARKS or w in PLACES or w.isdigit() for w in words):
                    return True
    return False


def _words(attributes: str) -> set[str]:
    return {w.lower() for m in _ATTRIBUTE.finditer(attributes) if m[1].lower() in ("class", "id", "role", "itemprop") for w in _WORD.findall(m[2] or m[3] or m[4] or "")}


def parse(page: str) -> list[Block]:
    """The blocks of a page in order, those without text left out."""
    out: list[Block] = []
    bare = not _HAS_ARTICLE.search(page)
    body: list = []  # [tag, open tags of that name] of the element that stands for an article
    now = Block()
    outside: list[list] = []  # [tag, open tags of that name]
    article = links = region = 0
    heading = item = False

    def end() -> None:
        nonlocal now
        now.text = " ".join("".join(now.parts).split())
        if now.text:
            out.append(now)
        now = Block()

    def put(text: str) -> None:
        if not text:
            return
        now.parts.append(text)
        if text.strip():
            if links:
                now.linked += len("".join(text.split()))
            now.outside |= bool(outside)
            now.article |= article > 0
            now.region = region if article else now.region
            now.heading |= heading
            now.item |= item

    def closed(x: list) -> bool:
        if x[4] is None:
            x[4] = _closes(page, x[0], x[1], at)
        return x[4]

    at = 0
    while True:
        m = _TAG.search(page, at)
        if m is None:
            put(html.unescape(page[at:]))
            break
        if m.start() > at:
            put(html.unescape(page[at : m.start()]))
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
        if tag in RAW and not closing:
            at = _after(page, tag, at, attributes.rstrip().endswith("/"))
            if tag not in ("button", "select", "textarea"):
                continue
            put(" ")
            continue
        if tag == "br":
            put(" ")
        if tag == "a":
            links = 0 if closing else 1
        if tag in BLOCK:
            end()
            links = 0 if tag != "a" else links
            heading = not closing and len(tag) == 2 and tag[0] == "h" and tag[1].isdigit()
            item = (item and tag not in ("ul", "ol", "p", "article", "main")) if closing else (tag == "li" or item and tag not in ("p", "article", "main"))
        held = bool(outside) and outside[-1][0] == tag
        if tag in ARTICLE and not held and not (attributes and not closing and _words(attributes) & THREAD_MARKS):
            if not closing:
                # an article never lies in what has been left open before it, a comment thread or what is closed behind it aside
                if not any(x[2] or x[0] in CLOSED and closed(x) for x in outside):
                    outside = []
                region += article == 0
                article += 1
            else:
                article = max(0, article - 1)
                outside = [x for x in outside if x[3] <= article]
        elif closing:
            if held:
                outside[-1][1] -= 1
                if not outside[-1][1]:
                    outside.pop()
            if body and body[0] == tag:
                body[1] -= 1
                if not body[1]:
                    body, article = [], 0
        elif tag not in VOID and not attributes.rstrip().endswith("/"):
            if body and body[0] == tag:
                body[1] += 1
            if held:
                outside[-1][1] += 1
            elif tag not in ("body", "html") and (tag in OUTSIDE or tag == "header" and not article or attributes and _marked(attributes, article > 0)):
                outside.append([tag, 1, bool(_words(attributes) & THREAD_MARKS), article, None])
            elif bare and not body and not outside and tag in ("div", "section", "td") and attributes and _words(attributes) & BODY_MARKS:
                body, article = [tag, 1], 1
                region += 1
    end()
    return out


def _closes(page: str, tag: str, depth: int, at: int) -> bool:
    """True if an element, open at that depth of its name, is closed after this place."""
    for m in re.compile(rf"<(/?){tag}\b[^>]*>", re.I).finditer(page, at):
        depth += -1 if m[1] else 0 if m[0].endswith("/>") else 1
        if not depth:
            return True
    return False


def _after(page: str, tag: str, at: int, empty: bool = False) -> int:
    """Where the element's end tag ends; nested elements of the name count unless its text is
    literal. An element that closes itself, or is never closed, holds nothing unless its text is literal."""
    if empty and tag not in LITERAL:
        return at
    begin = at
    if tag == "head":
        m = re.compile(r"</head\s*>|(?=<body[\s>])", re.I).search(page, at)
        if m is None:
            return at
        # a closing tag inside a script of the head is not the head's
        return m.end()
    depth, find = 1, re.compile(rf"<(/?){tag}\b[^>]*>", re.I)
    while depth:
        m = find.search(page, at)
        if m is None:
            return len(page) if tag in LITERAL else begin
        at = m.end()
        depth += -1 if m[1] else (0 if tag in LITERAL or m[0].endswith("/>") else 1)
    return at


def _stops(text: str, stop_words: frozenset[str]) -> tuple[int, int]:
    """Stop words and words. Words of other scripts than the stop words' count as stop words."""
    words = _LETTERS.findall(text.lower())
    return sum(w in stop_words or w[0] >= "\u0370" for w in words), len(words)


def first_pass(b: Block, stop_words: frozenset[str] = STOP_WORDS) -> bool | None:
    """What a block is by itself: good, bad, or None."""
    density = b.linked / max(1, len("".join(b.text.split())))
    if b.outside:
        return False
    if density > (ARTICLE_LINKS if b.article else LINKS) and (b.item or not b.article):
        return False
    if not b.article and b.text.startswith(("©", "(c) ", "Copyright ")):
        return False
    stops, words = _stops(b.text, stop_words)
    good = len(b.text) >= LONG and stops >= MIN_STOPS * max(1, words) or len(b.text) >= LONG / 2 and stops >= SHORT_STOPS and not b.linked
    return True if good and not b.heading else None


def classify(blocks: list[Block], stop_words: frozenset[str] = STOP_WORDS) -> list[bool]:
    """True for the blocks of the main text."""
    marks = [first_pass(b, stop_words) for b in blocks]
    regions = {b.region: [] for b in blocks if b.article and not b.outside}
    for i, b in enumerate(blocks):
        if b.region in regions and not b.outside:
            regions[b.region].append(i)
    out = list(marks)
    for held in regions.values():
        _inherit_in_region(blocks, marks, held, out, stop_words)
    beside = [i for i, b in enumerate(blocks) if b.region not in regions or b.outside]
    if not regions and not any(marks):
        return [m is None for m in marks]
    for i in beside:
        if marks[i] is None:
            # nearest decided by their text; a region is one good block that counts as bad
            near = []
            for step in (-1, 1):
                k = i + step
                while 0 <= k < len(blocks) and (blocks[k].outside or marks[k] is None and blocks[k].region not in regions):
                    k += step
                if 0 <= k < len(blocks):
                    near.append((abs(k - i), blocks[k].region in regions or not marks[k]))
            out[i] = bool(near) and not min(near)[1]
    return [bool(x) for x in out]


def _inherit_in_region(blocks: list[Block], marks: list[bool | None], held: list[int], out: list[bool | None], stop_words: frozenset[str]) -> None:
    """Labels of the ambiguous blocks of a region, whose places are held."""
    open_ = [i for i in held if marks[i] is None]
    if not any(marks[i] for i in held):
        text = " ".join(blocks[i].text for i in open_)
        stops, words = _stops(text, stop_words)
        linked = sum(blocks[i].linked for i in open_) > LINKS * len("".join(text.split()))
        for i in open_:
            out[i] = not linked or stops >= MIN_STOPS * max(1, words)
        return
    ahead, seen = {}, None
    for i in reversed(held):
        ahead[i] = seen
        seen = seen if marks[i] is None else marks[i]
    seen = None
    for i in held:
        if marks[i] is None:
            out[i] = bool(seen or ahead[i])
        else:
            seen = marks[i]


def main_text(page: str | None, stop_words: frozenset[str] = STOP_WORDS) -> str:
    """The article of a page: its blocks, in order, with an empty line between."""
    blocks = parse(page or "")
    return "\n\n".join(b.text for b, good in zip(blocks, classify(blocks, stop_words)) if good)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", stop_words: frozenset[str] = STOP_WORDS) -> DataFrame:
    """(page_id, url, text, n_chars) per row; a null or empty page has an empty text.

    Repeated rows stay; other columns are not read. Broken markup ends where the page does.
    stop_words, in lower case, are those of the pages' languages.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p.as_py(), stop_words) for p in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
