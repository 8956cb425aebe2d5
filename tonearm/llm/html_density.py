"""Main text of web pages by composite text density.

The page becomes a tree of block elements; inline elements are transparent but count as tags.
What is never main text goes first: scripts, styles, navigation, page headers and footers,
sidebars and form controls, by their elements. A class, id or role goes by its whole words: a name
all of whose words say furniture (``related-posts``, not ``related-work``) drops a container that
leaves a part of its article, or of the page, standing; headings and paragraphs only go as
adverts; an id of a section, which may be an anchor, needs links as well; a form goes if it holds
less than half of the text around it.

For each block with C characters and T tags, of which LC and LT in links, and for the body with
C_b and LC_b, the composite density is

    C / T * log(C / LC * T / LT) / log(ln(C / (C - LC) * LC + LC_b / C_b * C + e))

with T, LC, LT and C - LC of 0 taken as 1. A block's density sum is the sum over its children. The block
of largest sum is the main one. The threshold is the least density on the path from it to the
body; along that path, headings and siblings of at least that density belong to the text too, as
do siblings whose plain density, characters outside links a tag, is near the least on the path,
and siblings with paragraphs that are not mostly links: the logarithm alone would leave out short
sections. If the main block lies in an article, or else in a main element, all of that element
belongs to the text, less what is dropped by kind or name, and only other articles are taken from
outside the outermost of them.

Defined results: a null or empty page gives an empty text; a page without tags is one block;
broken markup is read as browsers do in the common cases (unclosed paragraphs and list items,
stray end tags, unclosed comments); repeated rows are read each alone; a very long page is read
whole, with work in proportion to its length; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import read, ship

RESULT = "page_id long, url string, text string, n_chars long, density_sum double"

_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<(?P<end>/)?(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(?P<end2>/)?(?P<name2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)>|<[!?/][^>]*(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"(class|id|role|style|hidden|aria-hidden)(?=[\s=>/]|\Z)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_SPACE = re.compile(r"\s+")
_WORDS = re.compile(r"[a-z]+")
#: A name of a layout, such as no-sidebar: it tells what a block has or lacks, not what it is.
_LAYOUT = frozenset(["no", "has", "with", "without"])

# words of HTML and of common page templates
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
DROPPED = frozenset("head script style noscript iframe template textarea title nav footer aside button select option input label fieldset svg canvas object embed applet audio video map dialog menu noembed noframes".split())
BLOCKS = frozenset("html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table caption thead tbody tfoot tr td th ul head".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
KEEPS = frozenset("html body article main".split())
NOT_MAIN = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion comment comments commentlist disqus reply replies respond cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login nav navbar navigation navi menu breadcrumb breadcrumbs pagination pager sidebar aside widget widgets footer masthead topbar toolbar share sharing social related recommended recommendations tags tagcloud skip contentinfo complementary dialog search form".split()
)
REMARKS = frozenset("comment comments commentlist disqus reply replies respond".split())
ADVERTS = frozenset("ad ads advert adverts advertisement advertising adsense sponsored".split())
#: Words that say where a block of that name is or what it is made of, not what it is about.
PARTS = frozenset(
    "a about all area articles article bar block body bottom box btn button buttons center col column container content count custom desktop entry feed fixed form foot footer global google group head header holder "
    "icon icons id inner item items js l large latest layout left level link links list lists lg m main md media mobile module more news outer page pages panel popular post posts primary r region right row s secondary section "
    "site slot sm small span sticky story stories text the thread title top type unit user view with wp wrap wrapper xs zone".split()
)
#: How sure a name is: needs links too, is enough, tells of reader comments; or the block is a form.
WEAK, SURE, REMARK, FORM = 1, 2, 3, 4
#: Elements that a name other than an advert's does not drop: text, not containers of it.
TEXTUAL = frozenset("h1 h2 h3 h4 h5 h6 p li td th tr dd dt pre blockquote figure figcaption table tbody thead tfoot caption".split())
#: A block that a name tells off goes only if this share of the text of the page, or of the article
#: or main element that it lies in, is left then, or, for reader comments, so many characters.
LEFT_SHARE = 0.1
LEFT_CHARS = 40
#: Blocks that show that what holds them is text.
PROSE = frozenset("p blockquote pre dl h1 h2 h3 h4 h5 h6 table".split())
#: Part of the least plain density on the body path that siblings of the main block need.
LOOSE = 0.5
_CLOSED_BY = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"]),
}
_SCOPE = {"li": frozenset("ul ol menu dir".split()), "dt": frozenset(["dl"]), "dd": frozenset(["dl"]), "tr": frozenset(["table"]), "td": frozenset(["tr", "table"]), "th": frozenset(["tr", "table"])}


class Block:
    __slots__ = ("chars", "children", "density", "drop", "link_chars", "link_tags", "name", "named", "own", "parent", "sum", "tags")

    def __init__(self, name: str, parent: Block | None, drop: bool = False, named: int = 0):
        self.name, self.parent, self.drop, self.named = name, parent, drop, named
        self.children: list[Block | str] = []  # blocks, and texts between them
        self.own: list[str] = []  # pieces of the text that is being read
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.sum = 0.0

    def flush(self) -> None:
        if self.own:
            text = _SPACE.sub(" ", "".join(self.own)).strip()
            if text:
                self.children.append(text)
            self.own = []


def _furniture(token: str) -> int:
    """What one class, id or role says."""
    words = _WORDS.findall(token)
    if not words or words[0] in _LAYOUT:
        return 0
    telling = [w for w in words if w in NOT_MAIN]
    if not telling or any(w not in PARTS and w not in NOT_MAIN for w in words):
        return 0
    return REMARK if not REMARKS.isdisjoint(telling) else SURE


def _named(name: str, attrs: str) -> tuple[int, bool]:
    """How sure the names of an element tell that it is not main text, and whether it is hidden."""
    named, hidden = 0, False
    for m in _ATTRIBUTE.finditer(attrs):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key in ("class", "id", "role"):
            for token in value.split():
                says = _furniture(token)
                if says and name not in BLOCKS or name in TEXTUAL:  # inline elements are text too
                    says = SURE if token in ADVERTS else 0
                elif says == SURE and key == "id" and name == "section":
                    says = WEAK
                named = max(named, says)
        elif key == "style":
            hidden = hidden or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value) is not None
        else:
            hidden = hidden or key == "hidden" or value == "true"
    return named, hidden


def parse(page: str) -> Block:
    """The tree of block elements."""
    root = Block("#root", None)
    stack: list[tuple[str, Block, bool]] = [("#root", root, False)]  # element, its block, in a link
    at, n = 0, len(page)

    def text(piece: str) -> None:
        if piece:
            _, block, link = stack[-1]
            if "&" in piece:
                piece = html.unescape(piece)
            block.own.append(piece)
            if link:
                block.link_chars += len(_SPACE.sub(" ", piece).strip())

    def pop_to(depth: int) -> None:
        for k in range(depth, len(stack)):  # an inline element shares the block below it
            if k == 0 or stack[k][1] is not stack[k - 1][1]:
                stack[k][1].flush()
        del stack[depth:]

    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        name = m["name"] or m["name2"]
        if name is None:
            continue
        name = name.lower()
        if m["end"] or m["end2"]:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == name:
                    if name in BLOCKS or not any(e in BLOCKS for e, _, _ in stack[depth + 1 :]):
                        pop_to(depth)
                    break
                if stack[depth][0] in KEEPS and name not in BLOCKS:
                    break
            continue
        attrs = m["attrs"] if m["name"] else m["attrs2"]
        closes = _CLOSED_BY.get(name)
        if closes:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] in closes:
                    pop_to(depth)
                    break
                if stack[depth][0] in _SCOPE.get(name, ()):
                    break
        elif name in BLOCKS:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == "p":
                    pop_to(depth)
                    break
                if stack[depth][0] in BLOCKS:
                    break
        _, above, link = stack[-1]
        if name in ("html", "body") and any(e == name for e, _, _ in stack):
            continue
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        named, hidden = _named(name, attrs) if attrs and name not in KEEPS else (0, False)
        named = FORM if name == "form" else named
        drop = name in DROPPED or hidden or name == "header" and not any(e in ("article", "main") for e, _, _ in stack)
        if name in BLOCKS or drop or named:
            above.flush()
            block = Block(name, above, drop, named)
            block.tags = 1  # its own
            if name in VOID:
                continue
            above.children.append(block)
            stack.append((name, block, link))
            continue
        above.tags += 1
        if link or name == "a":
            above.link_tags += 1
        if name == "br" or name in ("img", "wbr"):
            above.own.append(" " if name == "br" else "")
        elif name not in VOID and not attrs.endswith("/"):
            stack.append((name, above, link or name == "a"))
    pop_to(0)
    return root


def _totals(order: list[Block], own: list[tuple[int, int, int]]) -> None:
    """Totals of each block from its own; a block that is dropped counts nothing."""
    for b, (tags, link_chars, link_tags) in zip(order, own, strict=True):
        b.chars, b.tags, b.link_chars, b.link_tags = sum(len(c) for c in b.children if isinstance(c, str)), tags, link_chars, link_tags
    for b in reversed(order):
        if b.drop:
            b.chars = b.tags = b.link_chars = b.link_tags = 0
        if b.parent is not None:
            p = b.parent
            p.chars, p.tags, p.link_chars, p.link_tags = p.chars + b.chars, p.tags + b.tags, p.link_chars + b.link_chars, p.link_tags + b.link_tags


def _measure(root: Block) -> None:
    """Totals of each block, and which blocks their names drop."""
    order, todo = [], [root]
    while todo:  # a block before those in it
        b = todo.pop()
        order.append(b)
        todo += [c for c in reversed(b.children) if isinstance(c, Block)]
    own = [(b.tags, b.link_chars, b.link_tags) for b in order]
    _totals(order, own)
    named = [(i, b) for i, b in enumerate(order) if b.named and not b.drop]
    if not named:
        return
    place = {id(b): i for i, b in enumerate(order)}
    last, holds, region = list(range(len(order))), [False] * len(order), [0] * len(order)
    for i, b in enumerate(order[1:], 1):
        up = place[id(b.parent)]
        region[i] = up if b.parent.name in ("article", "main") and b.parent.chars else region[up]
    for i in range(len(order) - 1, 0, -1):
        b, up = order[i], place[id(order[i].parent)]
        last[up] = max(last[up], last[i])
        holds[i] = holds[i] or b.name in ("article", "main") and b.chars > 0
        holds[up] = holds[up] or holds[i]
    lost = [0] * (len(order) + 1)  # sums over places, as a binary indexed tree

    def upto(i: int) -> int:
        total = 0
        while i:
            total += lost[i]
            i &= i - 1
        return total

    def net(i: int) -> int:
        """Characters of a block without what names have dropped in it."""
        return order[i].chars - upto(last[i] + 1) + upto(i)

    # small blocks first: what is left of a block without them decides about it
    for i, b in sorted(named, key=lambda x: x[1].chars):
        mine, around = net(i), net(region[i])
        if b.named == FORM:
            b.drop = 2 * mine <= around and not holds[i]
        elif holds[i]:
            b.drop = False
        elif holds[0] and not region[i]:
            b.drop = True  # outside the article
        else:
            enough = LEFT_CHARS if b.named == REMARK else LEFT_SHARE * order[region[i]].chars
            b.drop = around - mine >= enough and (b.named != WEAK or 3 * b.link_chars >= b.chars)
        if b.drop:
            k = i + 1
            while k < len(lost):
                lost[k] += mine
                k += k & -k
    _totals(order, own)


def densities(root: Block) -> tuple[Block, list[Block]]:
    """Set the density and density sum of every kept block; the body, and all in page order."""
    order, todo = [], [root]
    while todo:
        b = todo.pop()
        order.append(b)
        todo += [c for c in reversed(b.children) if isinstance(c, Block) and not c.drop]
    body = next((b for b in order if b.name == "body"), root)
    ratio = body.link_chars / max(1, body.chars)
    for b in reversed(order):
        c, t = b.chars, max(1, b.tags)
        if c:
            lc, lt, plain = max(1, b.link_chars), max(1, b.link_tags), max(1, c - b.link_chars)
            inner = math.log(c / plain * lc + ratio * c + math.e)  # over ln(1 + e), so its logarithm is positive
            b.density = c / t * math.log(max(1.0, c / lc * t / lt)) / math.log(inner)
        b.sum = sum(x.density for x in b.children if isinstance(x, Block) and not x.drop)
        if any(isinstance(x, str) for x in b.children):  # texts between blocks are children too
            b.sum += sum(len(x) for x in b.children if isinstance(x, str)) / t if b.sum else 0.0
    return body, order


def _plain(block: Block) -> float:
    return max(0, block.chars - block.link_chars) / max(1, block.tags)


def _prose(block: Block) -> bool:
    """Paragraphs, and not mostly links."""
    if 3 * block.link_chars >= block.chars:
        return False
    todo = [block]
    while todo:
        b = todo.pop()
        if b.name in PROSE and b.chars:
            return True
        todo += [c for c in b.children if isinstance(c, Block) and not c.drop]
    return False


def _text(block: Block, out: list[str]) -> None:
    todo: list[Block | str] = [block]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif not x.drop:
            todo += reversed(x.children)


def main_text(page: str | None) -> tuple[str, float]:
    """The text, and the density sum of the main block."""
    if not page:
        return "", 0.0
    root = parse(page)
    _measure(root)
    body, order = densities(root)
    inside = {id(body)}
    kept = [b for b in order if b is body or (id(b.parent) in inside and not inside.add(id(b)))]
    kept = [b for b in kept if b.chars] or [body]
    best = max(kept, key=lambda b: b.sum)
    if best.sum <= 0:  # one block without blocks in it
        best = max(kept, key=lambda b: (b.density, -len(b.children)))
    path = [best]
    while path[-1] is not body and path[-1].parent is not None:
        path.append(path[-1].parent)
    threshold = min(b.density for b in path)
    loose = LOOSE * min(_plain(b) for b in path)
    out: list[str] = []
    on_path = {id(b) for b in path}
    region = next((b for b in reversed(path) if b.name in ("article", "main")), None)
    whole = next((b for b in reversed(path) if b.name == "article"), region) or best
    todo: list[tuple[Block, Block | str, bool]] = [(path[-1], path[-1], region is None)]  # with the block that holds it
    while todo:
        above, x, inside = todo.pop()
        if x is whole:
            _text(whole, out)
        elif isinstance(x, str):
            if inside and (above is not body or len(x) / max(1, above.tags) >= min(threshold, loose)):
                out.append(x)
        elif id(x) in on_path:
            todo += [(x, c, inside or x is region) for c in reversed(x.children)]
        elif not x.drop and x.chars and (inside or x.name == "article") and (x.name in HEADINGS or x.density >= threshold or _plain(x) >= loose or _prose(x)):
            _text(x, out)
    return " ".join(out), best.sum


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars, density_sum``, a row per page."""
    ship(pages.sparkSession)
    names = [c.split()[0] for c in RESULT.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(x.as_py()) for x in batch.column(2)]
            columns = [batch.column(0), batch.column(1), pa.array([t for t, _ in found], pa.string()), pa.array([len(t) for t, _ in found], pa.int64()), pa.array([s for _, s in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, RESULT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))
