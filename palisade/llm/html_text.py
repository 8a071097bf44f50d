"""HTML main-text extraction by two-pass block rules.

A page is cut into blocks at block-level tags. Blocks inside scripts, menus, forms, asides and other elements that mean
so never count. A class or id that names such a container only counts where it is a container's own name: words such as
"has-sidebar" or "no-ads" don't, nor does any name of an element that holds an article, a main element or a level-one
heading, and if all text stands in named containers no name counts. Pass 1 classifies the rest by stop-word density,
length and link density; inside an article or main element, text that isn't mostly links is good whatever its words.
Pass 2 gives ambiguous short blocks the label of their nearest decided neighbours. If a page has such an element, only
it can hold main text.

A page is read once from left to right, in time proportional to its length whatever it holds.

Edge cases: null and empty pages give an empty text; unclosed tags close with what holds them; a tag without an end is
text, and where quotes leave no end to a tag, quotes count no more in that page; unknown references stay as they are;
repeated rows are repeated; extra columns are ignored.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm.kernels import slices

SHORT, LONG = 70, 200
LOW_STOP, HIGH_STOP = 0.30, 0.32
MOST_LINKS = 0.33

# Common function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    """a about after all also an and any are as at be because been but by can could did do does for from had has have he her him his how i if in into is it
    its just like me more most my no not now of on one only or other our out over she so some such than that the their them then there these they this those
    to too under up us was we were what when where which who will with would you your
    aber alle als also am an auch auf aus bei bin bis da damit dann das dass dem den der des die dies diese doch du durch ein eine einem einen einer eines er
    es für hat hatte ich ihr im in ist ja kann man mit nach nicht noch nur oder ohne sein sich sie sind so über um und uns unter vom von vor war was wenn wie
    wir wird zu zum zur
    au aux avec ce ces cette comme dans de des du elle en est et été être eux il ils je la le les leur lui mais même ne nos nous on ont ou où par pas plus
    pour qu que qui sa se ses si son sont sur tout un une vos vous
    al ante antes como con contra cual cuando de del desde donde durante e el ella ellos en entre era es esa ese eso esta este esto fue ha hasta la las le lo
    los más me mi muy no nos o para pero por porque que quien se sin sobre su sus también te un una uno y ya""".split()
)
# Elements by what they mean for text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
RAW = frozenset("script style noscript template textarea svg math iframe object canvas audio video title select xmp".split())
DROPPED = frozenset("head nav footer aside form button fieldset menu dialog".split())
MAIN = frozenset("article main".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar".split())
#: Names, in class and id attributes, of what isn't main text.
NAMES = frozenset(
    """ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion banner banners cookie cookies consent gdpr notice notices
    alert popup modal overlay newsletter subscribe subscription signup signin login sidebar sidebars aside rail widget widgets nav navbar navigation menu menus breadcrumb
    breadcrumbs footer footers masthead topbar comment comments commentlist respond reply replies disqus related recommended share sharing social toolbar pagination pager
    copyright skip""".split()
)
#: Words that may follow a name in a compound, as in "comment-list".
PARTS = frozenset(
    """area articles bar block body bottom box buttons col column container content footer form group header icons inner item items left link links list main menu message
    news outer overlay panel posts right row section slot stories text thread title top unit widget wrap wrapper""".split()
)
#: Words before a name that say what a page has or lacks, as in "has-sidebar".
RELATIONS = frozenset("has have with without no not is show hide enable disable js layout page post body content".split())
#: Elements of text, whose names count only if they are nothing else, as in class="ad".
TEXTS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th pre blockquote figcaption caption span b i em strong".split())

_MARK = re.compile("[>\"']")
_NAMED = re.compile(r"/?[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_WORD = re.compile(r"[^\W\d_]+")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def _named(tag: str, value: str, in_main: bool) -> int:
    """2 if a class or id is such a name, 1 if it has a compound of one, else 0. Headers in main text are its own."""
    found = 0
    for word in value.split():
        if word.lower() in NAMES or word.lower() == "header" and not in_main:
            return 2
        parts = [x.lower() for x in _NAME.findall(word)]
        if parts[1:] == ["header"] and parts[0] in ("site", "page", "main", "top") and not in_main:
            return 2
        if tag in TEXTS or len(parts) < 2 or parts[0] in RELATIONS:
            continue
        if parts[-1] in NAMES or parts[0] in NAMES and parts[1] in PARTS:
            found = 1
    return found


def _drops(tag: str, attributes: str, in_main: bool) -> tuple[bool, int]:
    """Whether an element never holds main text, and whether its names say so."""
    if tag in DROPPED or tag == "header" and not in_main:
        return True, 0
    named = 0
    if attributes.strip():
        for name, value in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'")
            if name in ("class", "id") and tag not in ("html", "body", *MAIN):
                named = max(named, _named(tag, value, in_main))
            elif name == "role" and value.lower() in ROLES or name == "hidden" or name == "aria-hidden" and value.lower() == "true":
                return True, 0
            elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return True, 0
    return False, named


class Container:
    """An element with such a name: how sure that is, whether it holds an article or heading, and how much text."""

    __slots__ = ("sure", "holds", "size")

    def __init__(self, sure: bool):
        self.sure, self.holds, self.size = sure, False, 0


class Block:
    __slots__ = ("text", "linked", "main", "label", "within")

    def __init__(self, text: str, linked: int, main: bool, within: tuple[Container, ...] = ()):
        self.text, self.linked, self.main, self.label, self.within = text, linked, main, "", within


def _tags(page: str):
    """(start, end, closing, name, attributes) of the tags of a page; comments, declarations and raw elements, with all
    they hold, have no name."""
    at, quotes = 0, True
    missing: set[str] = set()  # what a page doesn't hold from here on
    while (i := page.find("<", at)) >= 0:
        at = i + 1
        if page.startswith("<!--", i):
            end = page.find("-->", i + 4)
            at = len(page) if end < 0 else end + 3
            yield i, at, False, "", ""
            continue
        other = page[i + 1 : i + 2] in ("!", "?")
        name = None if other else _NAMED.match(page, i + 1)
        if not other and not name:
            continue
        end = -1
        if not other and quotes:  # the first > that isn't quoted
            pos = name.end()
            while end < 0 and (m := _MARK.search(page, pos)):
                if m[0] == ">":
                    end = m.start()
                else:
                    close = -1 if m[0] in missing else page.find(m[0], m.end())
                    if close < 0:
                        missing.add(m[0])
                    pos = m.end() if close < 0 else close + 1
            quotes = end >= 0
        if end < 0:
            end = -1 if ">" in missing else page.find(">", i)
            if end < 0:
                missing.add(">")
                continue
        at = end + 1
        if other:
            yield i, at, False, "", ""
            continue
        closing = name[0][0] == "/"
        tag = name[0].lstrip("/").lower()
        if tag in RAW and not closing:
            if not page.endswith("/", 0, end):
                close = None if tag in missing else re.compile(f"</{tag}\\s*>", re.I).search(page, at)
                if close is None:
                    missing.add(tag)
                at = len(page) if close is None else close.end()
            yield i, at, False, "", " "
            continue
        yield i, at, closing, tag, page[name.end() : end]


def blocks(page: str) -> list[Block]:
    """Blocks that stand in no dropped element, in page order."""
    out: list[Block] = []
    # tag, whether it drops, whether it is main, the container that it is
    stack: list[tuple[str, bool, bool, Container | None]] = []
    open_: dict[str, int] = {}
    at_block: list[int] = []  # where in the stack the elements of block level stand
    inside: list[dict[str, int]] = [{}]  # inline elements that are open within each of them
    containers: list[Container] = []
    dropped = main = links = 0
    text: list[tuple[str, bool]] = []

    def flush() -> None:
        nonlocal text
        if text:
            whole = " ".join(html.unescape("".join(t for t, _ in text)).split())
            if whole and not dropped:
                linked = sum(len(" ".join(html.unescape(t).split())) for t, a in text if a)
                out.append(Block(whole, linked, main > 0, tuple(containers[:8])))
                if containers:
                    containers[0].size += len(whole)
            text = []

    def pop(to: int) -> None:
        nonlocal dropped, main, links
        while len(stack) > to:
            tag, d, m, c = stack.pop()
            dropped -= d
            main -= m
            links -= tag == "a"
            open_[tag] -= 1
            if at_block and at_block[-1] == len(stack):
                at_block.pop()
                inside.pop()
            else:
                inside[-1][tag] -= 1
            if c:
                containers.pop()
                if c.holds and containers:
                    containers[-1].holds = True

    at = 0
    for start, end, closing, tag, attributes in _tags(page):
        if start > at:
            text.append((page[at:start], links > 0))
        at = end
        if not tag:
            if attributes:
                text.append((attributes, False))
            continue
        inline = tag in INLINE
        if tag == "br":
            text.append((" ", False))
            continue
        if not inline:
            flush()
        if closing:
            if inside[-1].get(tag, 0) if inline else open_.get(tag, 0):
                i = len(stack) - 1
                while stack[i][0] != tag:
                    i -= 1
                pop(i)
            continue
        if tag in VOID or attributes.endswith("/"):
            continue
        if not inline and at_block:  # a block ends the paragraph, item or cell of its kind that is still open
            held = stack[at_block[-1]][0]
            if held == "p" or held == tag and tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
                pop(at_block[-1])
        d, named = _drops(tag, attributes, main > 0)
        is_main = tag in MAIN
        if containers and (is_main or tag == "h1"):
            containers[-1].holds = True
        c = Container(named == 2) if named and not d else None
        if c:
            containers.append(c)
        if inline:
            inside[-1][tag] = inside[-1].get(tag, 0) + 1
        else:
            at_block.append(len(stack))
            inside.append({})
        stack.append((tag, d, is_main, c))
        open_[tag] = open_.get(tag, 0) + 1
        dropped += d
        main += is_main
        links += tag == "a"
    if at < len(page):
        text.append((page[at:], links > 0))
    flush()
    pop(0)
    return _unnamed(out)


def _unnamed(found: list[Block]) -> list[Block]:
    """Blocks that no name excludes: those of surely named containers, and of others unless they hold most of the text."""
    total = sum(len(b.text) for b in found)
    keep = [b for b in found if not any(not c.holds and (c.sure or 2 * c.size <= total) for c in b.within)]
    return keep or found


def classify(found: list[Block]) -> list[Block]:
    """The good blocks."""
    if any(b.main for b in found):
        found = [b for b in found if b.main]
    for b in found:
        n = len(b.text)
        links = b.linked / n
        if links > MOST_LINKS and (not b.main or links > 0.8 and n < SHORT):
            b.label = "bad"
        elif b.main:
            b.label = "short" if n < SHORT and b.linked else "good"
        else:
            words = _WORD.findall(b.text.lower())
            stop = sum(w in STOP_WORDS for w in words) / max(1, len(words))
            if n < SHORT:
                b.label = "bad" if b.linked else "short"
            elif stop >= HIGH_STOP:
                b.label = "good" if n > LONG else "near"
            else:
                b.label = "near" if stop >= LOW_STOP else "bad"
    # pass 2: near-good blocks beside good ones are good; short ones follow their nearest decided neighbours
    any_good = any(b.label == "good" for b in found)
    labels = [b.label if b.label in ("good", "bad") else "good" if b.label == "near" and not any_good else "" for b in found]

    def follow(kind: str, needed: int) -> None:
        """Labels blocks of a kind by how many of the nearest decided blocks on either side are good."""
        before, after = "bad", ["bad"] * (len(found) + 1)
        for i in range(len(found) - 1, -1, -1):
            after[i] = labels[i] or after[i + 1]
        new = {}
        for i, b in enumerate(found):
            if b.label == kind and not labels[i]:
                new[i] = "good" if (before == "good") + (after[i + 1] == "good") >= needed else "bad"
            before = labels[i] or before
        for i, label in new.items():
            labels[i] = label

    follow("near", 1)
    follow("short", 2)
    return [b for b, label in zip(found, labels, strict=True) if label == "good"]


def main_text(page: str | None) -> str:
    return "\n".join(b.text for b in classify(blocks(page or "")))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row."""

    def run(batches):
        for b in slices(batches, "html"):
            texts = [main_text(x) for x in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", F.col("html").cast("string").alias("html")).mapInArrow(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
