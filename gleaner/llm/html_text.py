"""Main text of HTML pages from flat text blocks and a decision tree.

A page becomes a flat list of text blocks, cut at block-level tags. Each block has its words and link
density, those of the blocks before and after it, and what its surroundings tell: if it is inside a
container that is marked as boilerplate (menu, footer, form, comments and so on, by tag, role, class or
id), the share of the page's running words in there and their number; whether it is inside an article,
a heading, or a legal line; and the running words of the page. A decision tree, trained on the labelled
table below, keeps or drops it. So a mark is one feature among others: a form or a section named
"cookies" around the whole article is no boilerplate. Only what is not shown is left out at once.

Defined cases: a null or empty page, and one without text, gives the empty text; broken markup
(unclosed or stray tags, a tag cut off at the end) is read as far as it goes: only an unclosed script,
style or comment reaches to the end of the page, '/>' closes an unseen element, a head ends where
something stands that a head cannot hold, and a link that is not closed ends with its block; equal
pages, repeated rows too, give equal texts; very long pages are read whole, in time in proportion;
other columns pass, and if one is named like the text, the added column gets underscores before its
name; an empty table gives no rows.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import free_name, plain_names

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "share", "room", "article", "heading", "legal", "page")

#: The labelled table: pages as rows of blocks, each a kind, its number of words, and + if it is main text.
#: P is plain, S has some links, L is a link, H a first heading, h another one, C a legal line; A, B, E
#: and D are plain, a link, mostly links and a heading in an article; X and Y are plain and a link in a
#: marked container that holds few of the running words; O is plain and Q a heading in one that holds
#: most of them, W is plain in a layout around an article; N is plain in a container that holds all there
#: is, but little.
LABELLED = """
    L1- L1- L2- P60+ P85+ P1+ P40+ P12+ X8- Y2- X25-
    L1- L3- D4+ A60+ A85+ A2+ A40+ B3+ A25+ A1+ A9+ X30- Y4- X14-
    D2+ A5+ A2+ A1+ X90- X120- X12-
    Y1- Y1- D7+ A12+ A4+ A3+ A33+ A6+ A10+ A200+ Y5- X8-
    Y2- X35- D9+ A16+ A2+ A7+ A5+ A70+ A3+ A1+ X60- X20- X15- X4-
    X40- D5+ A18+ S12+ A28+ S4+ A45+ A4+ X7- Y1-
    A1+ A1+
    X55- A3+ X9-
    Y1- D3+ A30+ A5+ A7+ A9+ A2+ A3+ A2+ A4+ A50+ X16-
    D6+ A400+ A1+ A350+ A8+ A6+ A1+ A2+ A500+ B2+ A60+ Y3- Y5-
    L1- L2- H3+ P8+ P22+ P11+ P60+ P130+ C6-
    L1- H2+ P26+ P25+ C4-
    L2- L1- L1- H5+ P4+ P90+ P13+ P41+ P138+ P79+ P12+ L3- L6- C9-
    H6+ P10+ P150+ P30+ P11+ P15+ P63+ P31+ P97+
    P16+
    P26+ P25+ P26+
    L1- P12+ L1- L2-
    L4- L5- P40+ L6- L7- L2-
    H3+ P12+ P70+ h2+ P36+ P20+ h4+ P14+ P300+ S18+ P22+ L4- L9- L12-
    L1- L1- H8+ P30+ h3+ P45+ h1+ P11+ P18+ P5+ P55+ h2- L3- L4- L5- C12-
    h1- L2- L3- L1- H2+ P26+ P60+ h2- L4- L8-
    h2- L5- L5- h3- L6- L2- H4+ P33+ P17+ P80+ C7-
    L1- L1- H3+ P3- L2- P120+ P90+ P4+ C20-
    L2- P5- L1- H5+ P50+ P44+ P70+ P3- L1- P2- L2-
    L1- L1- P2- L1- P4- L3- P5- L1- H7+ P28+ P95+ P3+
    P35+ P80+ P4+ L2- P6- L1- P3- L1-
    h3- P5- P4- P2- P2- H3+ P44+ P61+ P35+
    S40+ S30+ S11+ P20+ S60+
    P1+ P2+
    P2+
    P5+
    Y1- P3+ X9-
    L1- L1- P4+ L2-
    P9+ P6+
    H2+ P7+
    L1- L3- L2-
    C7-
    L2- C5-
    C12- P18+ P41+
    P30+ P55+ C3-
    P260+ P17+ C18-
    h1- L2- L2- H2+ P26+
    D2+ A60+ B6- B5- B7- B4- B8-
    A17+ E3- B9- B10-
    D4+ A40+ A30+ E5- B4- B9- B6-
    A25+ E14+ A45+ B3+ A38+ E11+ A8+
    Y1- D3+ A22+ A90+ B5- B3- B2- Y4-
    h1- L1- h2- L4- L2- L3- H3+ P33+ P140+ P40+ h2- L4-
    D3+ A26+ A25+ A4+
    Y1- D1+ A40+ A12+ A2+ A60+ A2+ A35+ A5+ A3+ X3-
    A2+ A70+ A2+ A33+ A1+ A4+ A8+ A140+ A7+ Y2-
    L1- A6+ A28+ A3+ A2+ A31+ A2+ L3- L2-
    L2- Q3+ O40+ O12+ O60+ O22+ X14-
    Q1+ O25+ O26+
    L1- L1- Q5+ O17+ O16+ C6-
    Y1- Y1- Q4+ O130+ O8+ O90+ O30+ O12+ O11+ X25- Y2-
    O60+ O5+ O70+ X7- X3-
    Y2- O48+ O31+ O2- P4- Y1-
    Q2+ O97+ O60+ O298+ O11+ O13+ C5-
    Y1- W16+ W17+ X4-
    L1- W3+ W60+ W4+ W25+ X9-
    W33+
    N12-
    Y1- N18- X4-
    N4- N25- L1-
    N13- N14-
    Y1- Y1- N3- N22- C7-
    L1- N16- X11-
    X16- X30- P20+ P60+
    X90- Y8- Y2- X8- H4+ P40+ X50- X7- P35+ X60- X45-
    H5+ P80+ X2- P50+ h3+ P31+ Y12- Y20- Y30- P24+ P15+ C4-
    L25- L11- L13- P40+ L16- L40-
    L9- L9- L8- L14- L30-
"""

#: Tags whose content is code, up to their closing tag or the end of the page.
RAW = ("script", "style")
#: Tags that a head may hold; any other tag or text ends a head that was not closed.
HEAD_TAGS = frozenset("base basefont bgsound html link meta title".split()) | {*RAW}
#: Tags whose content is never text of the page. One that is never closed is no more than its opening tag.
UNSEEN = ("noscript", "template", "iframe", "svg", "object", "select", "textarea", "button", "canvas", "audio", "video", "datalist")
#: Tags that end a block.
BLOCK_TAGS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody tfoot thead title tr ul".split())
#: Tags within a block that part words.
SPACE_TAGS = frozenset(["br", "td", "th", "wbr", "img", "input"])
#: Tags that hold other blocks and are kept on the stack until they are closed.
CONTAINERS = frozenset("article aside blockquote body details dialog div dl fieldset figure footer form header main menu nav ol section table ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILERPLATE_TAGS = frozenset("aside dialog footer form menu nav".split())
ARTICLE_TAGS = frozenset(["article", "main"])
BOILERPLATE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Words of a class or id that mark boilerplate, and an article.
BOILERPLATE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright disclaimer discussion disqus footer form gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification overlay paging pagination popup promo promoted promotion recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags toolbar widget widgets".split()
)
#: Those that can as well be a topic: in an article they mark only a few words, or links.
TOPIC_WORDS = frozenset(["discussion", "recommended", "related", "share", "sharing", "social", "tags"])
#: Words of a topic's container from which on it is part of its article.
TOPIC_LEAST = 12
#: What quotes or shows something is part of its article, whatever it is called.
QUOTES = frozenset(["blockquote", "figure", "pre", "table"])
ARTICLE_WORDS = frozenset("article body content entry main post story text".split())
#: Names of readers, and of what they say: a container named after both is theirs.
READER_WORDS = frozenset("community guest guests reader readers user users visitor visitors".split())
SAID_WORDS = frozenset("feedback letters opinion opinions posts reaction reactions remarks response responses review reviews said says talk thoughts voices".split())
#: Headings of reader comments, which mark what follows in their container.
_COMMENTS = re.compile(r"(?:\d+ )?(?:(?:reader|user|visitor)s?'? (?:comments?|opinions?|reviews|responses|reactions|feedback)|comments?|leave a (?:reply|comment)|kommentare?|leserkommentare|commentaires?|comentarios?)(?: ?\(\d+\))?:?", re.I)
#: Short blocks that begin or end so are no part of a text that is not in an article element.
_LEGAL = re.compile(r"(?:©|\(c\) |copyright\b)|.*\b(?:all rights reserved|alle rechte vorbehalten|tous droits réservés|todos los derechos reservados)\W*\Z", re.I | re.S)
LEGAL_MOST = 25
HEADINGS = {"h1": 2, "h2": 1, "h3": 1, "h4": 1, "h5": 1, "h6": 1}
#: Words from which on a block without links is running text.
RUNNING = 10
#: What running words outside of marks weigh against those in a marked container: few of them little, a paragraph or two much, and words of an article most.
OUTSIDE, PARAGRAPH, OWN_ARTICLE = 5, 20, 1000
#: The room of a block that no mark confines, and the most that is told to the tree.
ROOM = 1000

# Attributes; a quote that is never closed counts as none.
_REST = r"""(?:"[^"]*"|'[^']*'|[^'">])*+(?=>|\Z)|[^>]*"""
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<close>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<rest>{_REST})(?:>|\Z)", re.I | re.S)
#: Opening and closing tags of unseen elements; a longer name, such as <svg-icon>, is another element.
_UNSEEN_TAG = re.compile(rf"<(?P<close>/?)(?P<tag>{'|'.join(UNSEEN)})(?=[\s/>])(?P<rest>{_REST})(?:>|\Z)", re.I | re.S)
_LINK_TAG = re.compile(rf"<(?P<close>/?)a(?=[\s/>])(?P<rest>{_REST})(?:>|\Z)", re.I | re.S)
_HREF = re.compile(r"(?<![\w-])href(?![\w-])", re.I)
_RAW_END = {tag: re.compile(rf"</{tag}(?:[\s/][^>]*)?>", re.I) for tag in RAW}
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_UNSHOWN = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)
#: What an element has around or beside it, or lacks, such as no-sidebar: it is not what the element is.
_ABSENT = re.compile(r"(?<![a-z])(?:no|with|without|has)[-_]\S*")
_SPACE = re.compile(r"\s+")


@dataclass
class Block:
    """A text block. ``share`` and ``room`` tell of the marked container around it (see ``_settle``), ``page`` of running words outside of standing marks."""

    text: str
    words: int
    links: float
    article: bool
    heading: int
    share: float = 1.0
    room: float = ROOM
    page: float = 0.0

    def running(self) -> int:
        return self.words if self.words >= RUNNING and self.links < 0.5 else 0


def _marks(tag: str, rest: str, article: bool, inner: bool) -> tuple[bool, str, bool]:
    """Of an opening container: whether it is not shown, the kind of mark it is ("plain", "topic" or none), and whether anything marks an article."""
    unshown, bad, words_of, good = False, tag in BOILERPLATE_TAGS or (tag == "header" and not article), set(), tag in ARTICLE_TAGS
    for name, value in _ATTRIBUTE.findall(rest):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id"):
            for names in (value, _CAMEL.sub(" ", value)):
                words_of |= set(re.split(r"[^a-z]+", _ABSENT.sub(" ", names.lower())))
        elif name == "role":
            bad, good = bad or value.lower() in BOILERPLATE_ROLES, good or value.lower() in ("main", "article")
        elif name == "hidden":
            unshown |= value.lower() != "until-found"
        elif name == "aria-hidden":
            unshown |= value.lower() == "true"
        elif name == "style":
            unshown |= _UNSHOWN.search(value) is not None
    found = {w for w in words_of if w in BOILERPLATE_WORDS or ("comment" in w and "commentar" not in w)}
    if words_of & READER_WORDS and words_of & SAID_WORDS:
        found |= words_of & SAID_WORDS
    if tag in ARTICLE_TAGS or tag == "body" or (inner and tag in QUOTES):
        found = set()
    kind = "plain" if bad or found - TOPIC_WORDS else "topic" if found else ""
    return unshown, kind, good or bool(words_of & ARTICLE_WORDS)


@dataclass
class Mark:
    """A container that its tag, role, class or id marks as boilerplate; ``outer`` is the mark around it.

    ``running`` counts the running words inside, ``words`` and ``linked`` all and those in links.
    ``confines`` is not set where the mark has also a word of articles or only topics, or holds an
    article element: such a container may be small. A ``topic`` in an article is no mark if it holds text.
    """

    outer: Mark | None
    topic: bool = False
    confines: bool = True
    running: int = 0
    words: int = 0
    linked: float = 0.0
    share: float = 0.0

    def void(self) -> bool:
        return self.topic and self.words >= TOPIC_LEAST and 2 * self.linked < self.words


@dataclass
class Place:
    """Surroundings of a text: not shown; inside an article; inside an article that is no body element; the innermost mark."""

    unshown: bool = False
    article: bool = False
    inner: bool = False
    mark: Mark | None = None


def _settle(found: list[Block], places: list[Place], marks: list[Mark]) -> None:
    """Gives each block the share of the page's running words that the marked container around it holds, and their number.

    No mark is final. Of the outermost marks, one may hold most of the running words, if there are few
    outside: those outside of marks weigh more, and those of an article there outweigh any. What is
    directly in it counts as outside for the marks within it, and so on inwards. The marks beside it
    and those within them keep their small shares.
    """
    for block, place in zip(found, places, strict=True):
        if place.mark:
            place.mark.words += block.words
            place.mark.linked += block.words * block.links
            place.mark.running += block.running()
    for mark in reversed(marks):  # inner marks come later
        if mark.outer:
            mark.outer.words += mark.words
            mark.outer.linked += mark.linked
            mark.outer.running += mark.running
    around: dict[int, Mark | None] = {}  # the innermost mark that is not void, by mark
    within: dict[int | None, list[Mark]] = {}
    for mark in marks:
        outer = around[id(mark.outer)] if mark.outer else None
        around[id(mark)] = outer if mark.void() else mark
        if not mark.void():
            within.setdefault(id(outer) if outer else None, []).append(mark)
    standing = [around[id(p.mark)] if p.mark else None for p in places]
    direct: dict[int | None, list[int]] = {}  # running words, and words of articles
    for block, place, mark in zip(found, places, standing, strict=True):
        words = direct.setdefault(id(mark) if mark else None, [0, 0])
        words[0] += block.running()
        words[1] += block.words if place.inner else 0
    opened, (outside, own) = [None], direct.get(None, (0, 0))
    while (level := within.get(opened[-1])) is not None:
        total = sum(m.running for m in level) + OUTSIDE * outside * (1 + outside / PARAGRAPH) + OWN_ARTICLE * own
        for mark in level:
            mark.share = mark.running / total if total else 0.0
        most = max(level, key=lambda m: m.share)
        if most.share <= 0.5:
            break
        opened.append(id(most))
        more = direct.get(id(most), (0, 0))
        outside, own = outside + more[0], own + more[1]
    open_marks = set(opened)
    page = min(ROOM, sum(b.running() for b, m in zip(found, standing, strict=True) if (id(m) if m else None) in open_marks))
    for block, mark in zip(found, standing, strict=True):
        block.page = page
        if mark:
            block.share = mark.share
            block.room = min(ROOM, mark.running) if mark.confines else ROOM


def _unseen_ends(page: str) -> dict[int, int]:
    """Where unseen elements begin and end. A closing tag belongs to the last open one of its name."""
    ends: dict[int, int] = {}
    opened: dict[str, list[int]] = {tag: [] for tag in UNSEEN}
    for token in _UNSEEN_TAG.finditer(page):
        tag = token["tag"].lower()
        if not token["close"]:
            if not token["rest"].endswith("/"):
                opened[tag].append(token.start())
        elif opened[tag]:
            ends[opened[tag].pop()] = token.end()
    return ends


def _closed_links(page: str) -> set[int]:
    """Where the links begin that are closed before another one begins; they hold whatever is between."""
    closed, opened = set(), None
    for token in _LINK_TAG.finditer(page):
        if not token["close"]:
            opened = token.start()
        elif opened is not None:
            closed.add(opened)
            opened = None
    return closed


def blocks(page: str) -> list[Block]:
    """The page's text blocks in order; those without text are left out."""
    found: list[Block] = []
    places: list[Place] = []
    marks: list[Mark] = []
    stack: list[tuple[str, Place]] = []
    pieces: list[tuple[str, bool]] = []
    link = wide = False  # in a link; in one that is closed, which goes on over block tags
    place = Place()
    own: Place | None = None  # a block that holds no blocks and has attributes, such as <p class=ad>
    heading = 0

    def inside(tag: str, rest: str) -> Place:
        unshown, kind, good = _marks(tag, rest, place.article, place.inner)
        # A main element is never part of a menu; if it seems to be, the menu was left open.
        mark = None if tag == "main" else place.mark
        if tag in ARTICLE_TAGS:
            outer = mark
            while outer and outer.confines:
                outer.confines, outer = False, outer.outer
        if kind:
            mark = Mark(mark, kind == "topic" and place.inner, not good and kind == "plain")
            marks.append(mark)
        return Place(place.unshown or unshown, place.article or good, place.inner or (good and tag != "body"), mark)

    def flush() -> None:
        nonlocal place
        if pieces and not (own or place).unshown:
            text = _SPACE.sub(" ", html.unescape("".join(p for p, _ in pieces))).strip()
            if text:
                if heading and _COMMENTS.fullmatch(text):
                    place = replace(place, mark=Mark(place.mark))
                    marks.append(place.mark)
                linked = sum(len(html.unescape(p).split()) for p, is_link in pieces if is_link)
                words = len(text.split(" "))
                places.append(own or place)
                found.append(Block(text, words, min(1.0, linked / words), places[-1].article, heading))
        pieces.clear()

    at, ends, closed, head, title = 0, _unseen_ends(page), _closed_links(page), False, False
    while token := _TOKEN.search(page, at):
        if token.start() > at and (not head or not title):
            between = page[at : token.start()]
            head = head and not between.strip()
            if not head:
                pieces.append((between, link))
        at = token.end()
        if not (tag := token["tag"]):
            continue
        tag = tag.lower()
        if tag in RAW and not token["close"]:
            if not token["rest"].endswith("/"):
                end = _RAW_END[tag].search(page, at)
                at = end.end() if end else len(page)
            continue
        if tag in UNSEEN:
            at = ends.get(token.start(), at)
            continue
        if tag == "head":
            head, title = not token["close"], False
            flush()
            continue
        title = tag == "title" and not token["close"]
        head = head and tag in HEAD_TAGS
        if tag == "a":
            # An anchor that only names a place is no link.
            link = not token["close"] and (_HREF.search(token["rest"]) is not None or not token["rest"].strip())
            wide = link and token.start() in closed
        elif tag in SPACE_TAGS:
            pieces.append((" ", link))
        elif tag in BLOCK_TAGS:
            flush()
            own, link = None, link and wide
            heading = 0 if token["close"] else HEADINGS.get(tag, 0)
            if tag in CONTAINERS:
                if not token["close"]:
                    if not token["rest"].endswith("/"):
                        stack.append((tag, place))
                        place = inside(tag, token["rest"])
                elif any(t == tag for t, _ in stack):
                    while True:
                        t, place = stack.pop()
                        if t == tag:
                            break
            elif not token["close"] and tag not in VOID and token["rest"]:
                own = inside(tag, token["rest"])
    if at < len(page) and not (head and title):
        pieces.append((page[at:], link))
    flush()
    _settle(found, places, marks)
    return found


@dataclass
class Tree:
    """Nodes of a decision tree; a leaf has feature -1 and a verdict."""

    feature: list[int]
    limit: list[float]
    below: list[int]
    above: list[int]
    keeps: list[bool]

    def keep(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        feature, limit = np.array(self.feature), np.array(self.limit)
        below, above = np.array(self.below), np.array(self.above)
        while len(live := np.flatnonzero(feature[node] >= 0)):
            at = node[live]
            node[live] = np.where(x[live, feature[at]] <= limit[at], below[at], above[at])
        return np.array(self.keeps)[node]


def train(rows: np.ndarray, labels: np.ndarray, depth: int = 12) -> Tree:
    """Splits by Gini impurity until a node is pure or ``depth`` is reached; ties go to the first feature."""
    tree = Tree([], [], [], [], [])

    def grow(index: np.ndarray, left: int) -> int:
        me, y = len(tree.feature), labels[index]
        for column, value in ((tree.feature, -1), (tree.limit, 0.0), (tree.below, 0), (tree.above, 0), (tree.keeps, bool(2 * y.sum() >= len(y)))):
            column.append(value)
        if left and 0 < y.sum() < len(y):
            best = None
            for f in range(rows.shape[1]):
                values = np.unique(rows[index, f])
                for limit in (values[1:] + values[:-1]) / 2:
                    low = rows[index, f] <= limit
                    cost = sum(len(p) * p.mean() * (1 - p.mean()) for p in (y[low], y[~low]))
                    if best is None or cost < best[0] - 1e-12:
                        best = (cost, f, limit, low)
            if best:
                _, tree.feature[me], tree.limit[me], low = best
                tree.below[me] = grow(index[low], left - 1)
                tree.above[me] = grow(index[~low], left - 1)
        return me

    grow(np.arange(len(rows)), depth)
    return tree


#: By kind of a labelled block: links, article, heading, legal, share, room (0: the running words of the container).
_KINDS = {
    "P": (0.0, 0, 0, 0, 1.0, ROOM),
    "S": (0.25, 0, 0, 0, 1.0, ROOM),
    "L": (1.0, 0, 0, 0, 1.0, ROOM),
    "H": (0.0, 0, 2, 0, 1.0, ROOM),
    "h": (0.0, 0, 1, 0, 1.0, ROOM),
    "C": (0.0, 0, 0, 1, 1.0, ROOM),
    "A": (0.0, 1, 0, 0, 1.0, ROOM),
    "B": (1.0, 1, 0, 0, 1.0, ROOM),
    "E": (0.65, 1, 0, 0, 1.0, ROOM),
    "D": (0.0, 1, 2, 0, 1.0, ROOM),
    "X": (0.0, 0, 0, 0, 0.1, 0),
    "Y": (1.0, 0, 0, 0, 0.0, 0),
    "O": (0.0, 0, 0, 0, 0.9, 0),
    "Q": (0.0, 0, 2, 0, 0.9, 0),
    "W": (0.0, 0, 0, 0, 1.0, ROOM),
    "N": (0.0, 0, 0, 0, 1.0, 0),
}


def labelled_table() -> tuple[np.ndarray, np.ndarray]:
    """The features and labels of the labelled pages' blocks."""
    rows, labels = [], []
    for line in LABELLED.strip().splitlines():
        found, groups = [], {}
        for kind, words, label in re.findall(r"(\w)(\d+)([+-])", line):
            links, article, heading, legal, share, room = _KINDS[kind]
            text = "Copyright" if legal else ""
            found.append(Block(text, int(words), links, bool(article), heading, share, room))
            if not room:
                groups.setdefault("XY" if share < 0.5 else "OQN", []).append(found[-1])
            labels.append(label == "+")
        for blocks_of in groups.values():
            for block in blocks_of:
                block.room = min(ROOM, sum(b.running() for b in blocks_of))
        for block in found:
            block.page = min(ROOM, sum(b.running() for b in found if b.share > 0.5))
        rows.append(features(found))
    return np.vstack(rows), np.array(labels)


def features(found: list[Block]) -> np.ndarray:
    if not found:
        return np.zeros((0, len(FEATURES)))
    own = np.array([(b.words, b.links) for b in found], float)
    edge = np.zeros((1, 2))
    rest = [(b.share, b.room, b.article, b.heading, not b.article and b.words < LEGAL_MOST and _LEGAL.match(b.text) is not None, b.page > 0) for b in found]
    return np.hstack([own, np.vstack([edge, own[:-1]]), np.vstack([own[1:], edge]), np.array(rest, float)])


def main_text(page: str | None, tree: Tree) -> str:
    found = blocks(page or "")
    if not found:
        return ""
    return "\n".join(b.text for b, keep in zip(found, tree.keep(features(found)), strict=True) if keep)


def extract(pages: DataFrame, html_column: str = "html", name: str = "text") -> DataFrame:
    """``pages`` with the main text in place of the page."""
    tree = train(*labelled_table())
    plain, named = plain_names(pages)
    page, kept = plain.columns.index(named[html_column]), [c for c in pages.columns if c != html_column]
    carried = plain.drop(named[html_column])
    names = [*carried.columns, "found"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py(), tree) for x in batch.column(page)]
            yield pa.RecordBatch.from_arrays([*[c for k, c in enumerate(batch.columns) if k != page], pa.array(texts, pa.string())], names)

    return plain.mapInArrow(run, carried.schema.add("found", "string")).toDF(*kept, *free_name(carried.toDF(*kept), name))


def with_length(extracted: DataFrame, name: str = "text") -> DataFrame:
    return extracted.withColumn("n_chars", F.length(name).cast("long"))
