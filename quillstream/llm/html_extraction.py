"""Main text of web pages by two-pass block rules.

A page is read once by a scanner that keeps a stack of open containers and cuts text into blocks
at block-level tags.  Pass one decides each block: text in menus, forms, adverts, comments and
the like is boilerplate, as are blocks that are mostly links; long blocks with enough stop words
are content; short or undecided ones are ambiguous.  Pass two gives each ambiguous block the label
of its nearest decided neighbours.

Containers are evidence, not verdicts.  ``main`` and ``article`` rule out what is outside them
only if they hold enough of the page's prose.  The containers of one class name are judged
together: they are boilerplate if they hold less than a part of the prose, which depends on how
plainly the name says so; one that holds more is boilerplate only if its name is plain and enough
prose is left without it, so that a wrapper named after a sidebar is not taken for one, and long
comments are.  Only elements made for it, hidden ones among them, are final.  Stop words are
listed for four languages; in a page of another one its own frequent words stand in for them, and
sentence marks where words aren't separated.  A page whose rules leave nothing is read again with
fewer of them.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.llm.core import arrays, blocks, table
from quillstream.shipping import ship

BLOCK_BYTES = 4_000_000
LONG, SHORT_LINKS, LINKS, STOPS = 70, 0.5, 0.33, 0.2
#: Parts of a page's prose: main or articles that rule out the rest hold at least so much;
#: containers by name less than HALF, or MAIN if the name tells a state rather than a thing; or
#: they leave REST to others.
MAIN, HALF, REST = 0.25, 0.5, 0.15
#: How plainly a name says that an element is boilerplate: a sure word that other words follow
#: (menu-open), an uncertain word, a sure word.
STATE, MAYBE, PLAIN = 1, 2, 3
#: Listed stop words are so rare in languages that have no list.
FOREIGN = 0.08

# fixed values: frequent words of the languages that pages come in
STOP_WORDS = frozenset(
    "the of and to in is that it for was on with as are be this by at from or an a not have has had but they you his her were which all we there been one if would will can their when who what so no out up about"
    " de la le et les des en un une du est que qui dans pour par sur au pas plus ce il elle avec sont aux ou se ne mais nous vous son sa ses leur cette"
    " der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über"
    " el los las del y que se por con para una su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde".split()
)
# fixed values: elements by what they do to text
RAW = frozenset("script style noscript textarea title xmp iframe noembed noframes".split())
MUTE = frozenset("template svg math object select button canvas audio video datalist".split())
BOILERPLATE = frozenset("nav footer aside menu dialog fieldset label legend".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr input option optgroup".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that a new one of the same kind closes, since authors leave their end tags out.
CLOSING = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
#: Blocks that end an open paragraph.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
# fixed values: parts of class names, ids and roles of what is not the article
SURE = re.compile(
    r"ads?|advert\w*|adsense|sponsor\w*|promo\w*|popup|modal|cookie\w*|consent|gdpr|subscribe\w*|newsletter|signup|login|paywall|nav|navbar|navigation|menu\w*|breadcrumb\w*|masthead|topbar|footer|sidebar|widget\w*"
    r"|related|recommend\w*|comments?|commentlist|disqus|replies|respond|pagination|pager|complementary|contentinfo|alertdialog",
    re.I,
)
UNSURE = re.compile(
    r"banner|overlay|notices?|alert|header|bottom|copyright|legal|side|rail|trending|popular|share|sharing|social|toolbar|reply|discussion|reviews|search|form|tags|skip|hidden|disclaimer|dialog",
    re.I,
)
# fixed values: first parts of names that tell what a page is about or has, not what the element is
ABOUT = frozenset("tag category cat format status type has with without no not".split())
#: A name with an uncertain word says what the element is if it ends with that or one of these.
ENDINGS = frozenset("box bar block list area section wrap wrapper container inner outer links buttons icons widget panel text".split())

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
SKIP, ATTRIBUTE, EQUALS, VALUE = re.compile(r"[\s/]*"), re.compile(r"[^\s/>=]+|="), re.compile(r"\s*=\s*"), re.compile(r"[^\s>]*")
WORD = re.compile(r"[^\W\d_]+")
WIDE = re.compile("[฀-໿က-႟ក-៿⺀-鿿가-힯豈-﫿\U00020000-\U0003ffff]")
SENTENCE = re.compile("[.!?…](?:\\s|$)|[。！？，।؟۔،።။។]")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass(slots=True)
class Block:
    text: str
    linked: int  # characters in links, without white space
    bad: bool  # in an element that is boilerplate for sure
    weak: int  # the innermost container with a name of boilerplate, -1 if none
    article: bool
    main: bool
    heading: bool
    header: bool  # in the header of an article


class Tags:
    """Reads the tags of a page, each character a bounded number of times."""

    def __init__(self, page: str):
        self.page, self.missing = page, set()
        self.lower, self.ahead = "", {}

    def find(self, what: str, at: int) -> int:
        """As str.find; what was once not found isn't looked for again."""
        if what in self.missing:
            return -1
        k = self.page.find(what, at)
        if k < 0:
            self.missing.add(what)
        return k

    def attributes(self, at: int) -> tuple[dict[str, str], int]:
        """The attributes from ``at``, and where the tag ends (-1: it doesn't).  A quote that is
        not closed before a delimiter ends with the tag."""
        page, found = self.page, {}
        while True:
            at = SKIP.match(page, at).end()
            if at >= len(page):
                return found, -1
            if page[at] == ">":
                return found, at + 1
            m = ATTRIBUTE.match(page, at)
            name, at = m[0], m.end()
            m = EQUALS.match(page, at)
            value = ""
            if m:
                at = m.end()
                quote = page[at : at + 1]
                if quote in ('"', "'"):
                    k = self.find(quote, at + 1)
                    if k >= 0 and page[k + 1 : k + 2] in " \t\n\r\f/>":
                        value, at = page[at + 1 : k], k + 1
                    else:
                        k = self.find(">", at + 1)
                        value, at = page[at + 1 : k if k >= 0 else at + 1], k if k >= 0 else len(page)
                else:
                    m = VALUE.match(page, at)
                    value, at = m[0], m.end()
            if len(name) < 20:
                found.setdefault(name.lower(), value)

    def closes(self, name: str, at: int) -> int:
        """Where the end tag of ``name`` begins, -1 if there is none."""
        key = "</" + name
        if key in self.missing:
            return -1
        if self.ahead.get(key, -1) >= at:  # places are asked for in order
            return self.ahead[key]
        if not self.lower:
            self.lower = self.page.lower()
            if len(self.lower) != len(self.page):  # letters that grow: ASCII ones are all we need
                self.lower = re.sub("[A-Z]+", lambda m: m[0].lower(), self.page)
        while (k := self.lower.find(key, at)) >= 0:
            if self.lower[k + len(key) : k + len(key) + 1] in " \t\n\r\f/>":
                self.ahead[key] = k
                return k
            at = k + len(key)
        self.missing.add(key)
        return -1


def hidden(attributes: dict[str, str]) -> bool:
    return bool(
        "hidden" in attributes and attributes["hidden"].lower() != "until-found" or attributes.get("aria-hidden", "").lower() == "true" or HIDDEN.search(attributes.get("style", ""))
    )


def marks(name: str, attributes: dict[str, str]) -> dict[str, int]:
    """The class names, ids and roles that say that an element is boilerplate, and how plainly."""
    found: dict[str, int] = {}
    for key in ("class", "id", "role"):
        for word in attributes.get(key, "").split():
            parts = [p for p in re.split(r"[_-]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", word)) if p]
            if not parts or parts[0].lower() in ABOUT:
                continue
            if name in ("article", "main", "body", "html"):
                if name == "article" and parts[0].lower() in ("comment", "comments", "reply", "related", "promo", "sponsored", "ad"):
                    found[word] = PLAIN
                continue
            tail = parts[-1].lower()
            for k, p in enumerate(parts):
                says_what = k == len(parts) - 1 or tail in ENDINGS or tail.isdigit()
                mark = (PLAIN if says_what else STATE) if SURE.fullmatch(p) else MAYBE if says_what and UNSURE.fullmatch(p) else 0
                if mark:
                    found[word] = max(mark, found.get(word, 0))
    return found


@dataclass(slots=True)
class Named:
    """A container with names of boilerplate."""

    parent: int  # the named container it is in, -1 if none
    names: dict[str, int]
    first: list[str]  # those that no container around it has


def cut(page: str) -> tuple[list[Block], list[Named]]:
    """The blocks in order, and the containers with names of boilerplate."""
    out: list[Block] = []
    named: list[Named] = []
    around: Counter = Counter()  # names of the open containers
    tags, depth = Tags(page), Counter()
    # name, mute, bad, weak, article, main, heading, header
    top = ("", False, False, -1, False, False, False, False)
    stack = [top]
    text: list[str] = []
    link: list[list[int]] | None = None  # (block, characters) of an open link
    linked: Counter = Counter()

    def flush() -> None:
        nonlocal text
        if text:
            body = " ".join("".join(text).split())
            if body:
                _, _, bad, weak, article, main, heading, header = stack[-1]
                out.append(Block(body, 0, bad, weak, article, main, heading, header))
            text = []

    def add(raw: str) -> None:
        if raw and not stack[-1][1]:
            plain = html.unescape(raw) if "&" in raw else raw
            text.append(plain)
            if link is not None:
                n = len("".join(plain.split()))
                if link and link[-1][0] == len(out):
                    link[-1][1] += n
                else:
                    link.append([len(out), n])

    def end_link(closed: bool) -> None:
        """A link without an end ends with its block."""
        nonlocal link
        for k, n in (link or []) if closed else (link or [])[:1]:
            linked[k] += n
        link = None

    def pop() -> None:
        if not stack[-1][1]:
            flush()
        name, _, _, weak, *_ = stack.pop()
        depth[name] -= 1
        if weak != stack[-1][3]:
            around.subtract(named[weak].names.keys())

    def push(name: str, mute: bool, final: bool, names: dict[str, int]) -> None:
        _, was_mute, bad, weak, article, main, heading, header = stack[-1]
        if names:
            named.append(Named(weak, names, [x for x in names if not around[x]]))
            around.update(names.keys())
            weak = len(named) - 1
        inside = article or main
        stack.append((
            name, mute or was_mute, bad or final, weak, article or name == "article", main or name == "main",
            heading or name in HEADINGS, header or name == "header" and inside,
        ))
        depth[name] += 1

    at, n = 0, len(page)
    while at < n:
        k = page.find("<", at)
        if k < 0:
            break
        c = page[k + 1 : k + 2]
        if c == "!" or c == "?":
            add(page[at:k])
            if page.startswith("<!--", k):
                e = tags.find("-->", k + 2)
                at = n if e < 0 else e + 3
            elif page.startswith("<![CDATA[", k):
                e = tags.find("]]>", k)
                add(page[k + 9 : n if e < 0 else e])
                at = n if e < 0 else e + 3
            else:
                e = tags.find(">", k)
                at = n if e < 0 else e + 1
            continue
        end = c == "/"
        m = NAME.match(page, k + 2 if end else k + 1)
        if not m:  # a sign, not a tag
            if end:
                e = tags.find(">", k)
                add(page[at:k])
                at = n if e < 0 else e + 1
            else:
                add(page[at : k + 1])
                at = k + 1
            continue
        add(page[at:k])
        name = m[0].lower()
        attributes, at = tags.attributes(m.end())
        if at < 0:
            at = n
            break
        if end:
            if name == "a":
                end_link(True)
            elif name in INLINE and name != "span":
                pass
            elif depth[name]:
                if name == "span" and stack[-1][0] != "span":
                    continue
                while stack[-1][0] != name:
                    pop()
                pop()
            elif name != "span" and not stack[-1][1]:
                flush()
            continue
        if name in RAW:
            e = tags.closes(name, at)
            if e >= 0:
                at = tags.attributes(e + 2 + len(name))[1]
                at = n if at < 0 else at
            elif name in ("script", "style"):
                at = n
            text.append(" ")
        elif name in MUTE:
            text.append(" ")
            if not (name in ("svg", "math") and page[at - 2] == "/") and tags.closes(name, at) >= 0:
                push(name, True, False, {})
        elif stack[-1][1]:
            if name not in VOID and name not in INLINE and depth[name]:
                push(name, True, False, {})  # so that its end tag does not close one further out
        elif name == "a":
            end_link(False)
            if "href" in attributes:
                link = []
        elif name == "br":
            text.append(" ")
        elif name in INLINE:
            if name == "span":
                names = {x: m for x, m in marks(name, attributes).items() if m == PLAIN}
                if depth["span"] or names or hidden(attributes):
                    if names or hidden(attributes):
                        flush()
                    push(name, False, hidden(attributes), names)
        else:
            flush()
            if name in ENDS_P and stack[-1][0] == "p":
                pop()
            while stack[-1][0] in CLOSING.get(name, ()):
                pop()
            if name not in VOID:
                inside = stack[-1][4] or stack[-1][5]
                final = name in BOILERPLATE or name == "header" and not inside or hidden(attributes)
                names = {} if final else marks(name, attributes)
                if name == "header":
                    names = {x: m for x, m in names.items() if m == PLAIN}
                elif name == "form" and not final:
                    names["<form>"] = MAYBE
                push(name, False, final, names)
    add(page[at:])
    flush()
    end_link(False)
    for k, chars in linked.items():
        if k < len(out):
            out[k].linked = chars
    return out, named


def width(text: str) -> int:
    """Length, where a character of a script without spaces counts for two."""
    return len(text) if text.isascii() else len(text) + len(WIDE.findall(text))


def decide(found: list[Block], named: list[Named]) -> list[bool]:
    """Which blocks are content, by the two passes; with fewer rules if these leave nothing."""
    for use_marks, use_words in ((True, True), (False, True), (False, False)):
        keep = _decide(found, named, use_marks, use_words)
        if any(keep):
            return keep
    return keep


def _held(found: list[Block], named: list[Named], prose: list[int]) -> Counter:
    """The prose in the containers of each name."""
    held = [0] * len(named)
    for b, p in zip(found, prose):
        if b.weak >= 0:
            held[b.weak] += p
    out: Counter = Counter()
    for k in range(len(named) - 1, -1, -1):  # a container comes after the one it is in
        if named[k].parent >= 0:
            held[named[k].parent] += held[k]
        for name in named[k].first:
            out[name] += held[k]
    return out


def _boilerplate(found: list[Block], named: list[Named], prose: list[int]) -> list[bool]:
    """Which named containers are boilerplate."""
    plain: dict[str, int] = {}
    for c in named:
        for name, mark in c.names.items():
            plain[name] = max(mark, plain.get(name, 0))

    def inside(names: set[str]) -> list[bool]:
        out: list[bool] = []
        for c in named:
            out.append(c.parent >= 0 and out[c.parent] or not names.isdisjoint(c.names))
        return out

    total = sum(prose)
    part = _held(found, named, prose)
    bad = {x for x, mark in plain.items() if part[x] < (MAIN if mark == STATE else HALF) * total or not total}
    if large := [x for x, mark in plain.items() if mark == PLAIN and x not in bad]:
        gone = inside(bad)
        prose = [0 if b.weak >= 0 and gone[b.weak] else p for b, p in zip(found, prose)]
        main = [p if b.main else 0 for b, p in zip(found, prose)]
        total, part, in_main = sum(prose), _held(found, named, prose), _held(found, named, main)
        bad |= {x for x in large if total - part[x] >= REST * total and total or sum(main) - in_main[x] > REST * REST * total}
    return inside(bad)


def _decide(found: list[Block], named: list[Named], use_marks: bool, use_words: bool) -> list[bool]:
    size = [len(b.text) - b.text.count(" ") for b in found]
    links = [min(1.0, b.linked / max(1, n)) for b, n in zip(found, size)]
    strong = [b.bad for b in found]
    prose = [0 if bad or x > LINKS else n for bad, x, n in zip(strong, links, size)]
    weak = _boilerplate(found, named, prose) if use_marks else [False] * len(named)
    bad = [s or b.weak >= 0 and weak[b.weak] for s, b in zip(strong, found)]
    prose = [0 if x else p for x, p in zip(bad, prose)]
    total = max(1, sum(prose))
    main = sum(p for p, b in zip(prose, found) if b.main)
    article = sum(p for p, b in zip(prose, found) if b.article)
    both = sum(p for p, b in zip(prose, found) if b.article and b.main)
    if main >= MAIN * total and main:
        region = [b.main and (b.article or both < HALF * main) for b in found]
    elif article >= HALF * total and article:
        region = [b.article for b in found]
    else:
        region = [False] * len(found)
    ruled = any(region)
    # an article's header has its title; dates and names beside it decide nothing
    bad = [x or b.header and not b.heading and len(b.text) < LONG for x, b in zip(bad, found)]

    words = [WORD.findall(b.text.lower()) if p else [] for b, p in zip(found, prose)]
    of_page = Counter(w for ws in words for w in ws)
    n_words = sum(of_page.values())
    stop_words, foreign = STOP_WORDS, False
    if n_words and sum(of_page[w] for w in STOP_WORDS if w in of_page) < FOREIGN * n_words:
        foreign = True
        stop_words = frozenset(w for w, c in of_page.items() if c >= 3 and c >= 0.005 * n_words)

    first: list[bool | None] = []
    for b, x, wrong, inside, ws in zip(found, links, bad, region, words):
        if wrong or ruled and not inside:
            first.append(False)
            continue
        if x > (SHORT_LINKS if inside else LINKS):
            first.append(False)
            continue
        long = width(b.text)
        stops = sum(w in stop_words for w in ws) / max(1, len(ws))
        if foreign and SENTENCE.search(b.text):
            stops = max(stops, STOPS)
        if long >= LONG and (inside or stops >= STOPS):
            first.append(True)
        elif long >= 3 * LONG and x < 0.1 and stops >= STOPS / 2:
            first.append(True)
        elif not use_words:
            first.append(True)
        else:
            first.append(None)
    return neighbours(first, bad, region)


def neighbours(first: list[bool | None], bad: list[bool], region: list[bool]) -> list[bool]:
    """All labels: an ambiguous block has that of the nearest decided one on either side in the
    same part of the page (boilerplate containers don't count); content if the two differ inside
    an article; a part without any decided block is content inside an article only."""
    n = len(first)
    seen: list[list[bool]] = [[] for _ in range(n)]
    for order in (range(n), range(n - 1, -1, -1)):
        last, part = None, None
        for i in order:
            if region[i] != part:
                last, part = None, region[i]
            if first[i] is None:
                if last is not None:
                    seen[i].append(last)
            elif not bad[i]:
                last = first[i]
    return [(x if x is not None else (any(s) if inside else all(s) and len(s) > 0) if s else inside) for x, s, inside in zip(first, seen, region)]


def extract(page: str) -> str:
    found, named = cut(page)
    return "\n".join(b.text for b, keep in zip(found, decide(found, named)) if keep)


def _extract(batches):
    for batch in blocks(batches, "html", BLOCK_BYTES):
        texts = [extract(x) if x else "" for x in batch.column("html").to_pylist()]
        yield arrays(page_id=batch.column("page_id"), url=batch.column("url"), text=pa.array(texts, pa.string()), n_chars=pa.array([len(x) for x in texts], pa.int64()))


def extract_text(df: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for each row: the main text of the whole page, blocks joined by
    a line feed.  Null and empty pages, and pages without content, give an empty text; repeated
    rows give equal results; an empty table stays empty; other columns are ignored.  Rows are
    independent: one pass, no shuffle."""
    ship(df.sparkSession)
    rows = df.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(page).alias("html"))
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def op1_html_extraction(spark, sf_dir):
    return extract_text(table(spark, sf_dir, "pages"))
