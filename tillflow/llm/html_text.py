"""Main text of web pages by wrapper induction over the pages of a host.

Every page becomes a tree of elements. Pages of a host with the same containers (paths of sections and of named
elements outside the main part, repeats and digits ignored) have one layout; layouts of fewer than MIN_PAGES different
pages go with the largest layout of their host. One page per layout, chosen by a hash, is the reference; every other
page is aligned with its layout's reference by simple tree matching, so a block of text has the same slot in all of them.
Texts are counted per slot over all pages, copies of one page once and pages without text never. A text that fills its
slot in more than half of the layout's different pages, and in MIN_PAGES at least, is template; what varies is content.
Menus, headers, footers,
sidebars, notices, adverts, forms and comments can vary from page to page too, so elements that HTML or their
class, id or role names as such never hold content, and where a page has a main part, content lies in it. A name
counts if a whole word of it says so ("sidebar", "site-footer"), not for a part of one ("has-sidebar") or beside a word
for content ("widget article-body"). No name hides html, body, the only main part of a page, or all of its text.

A host may hold a third of all pages: counts are combined before the shuffle, and the references of its layouts are
the small side of the join, so adaptive execution splits a busy host. Pages are never collected per host.

Defined cases: NULL and empty html give the empty text; pages without a readable host share one nameless
host; broken and cut-off markup is read as far as it goes; a host with few pages has no template; equal pages
give equal texts; very long pages are read whole; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tillflow.session import materialize

MIN_PAGES = 4
#: References of all hosts are sent to every task up to this size; beyond it they are joined by a shuffle.
BROADCAST_BYTES = 32 << 20
#: Levels of a tree that are matched; deeper elements have no slot.
DEEPEST = 200

# Names of HTML elements by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg object xmp select".split())
HIDDEN = frozenset("annotation annotation-xml head script style textarea title noscript iframe template svg object xmp select nav header footer aside form button dialog menu".split())
MAIN = frozenset("article main".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr "
    "math annotation annotation-xml maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split()
)
CLOSES = {
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]),
    "th": frozenset(["td", "th"]),
    "option": frozenset(["option"]),
}
# Words in class, id or role that mark parts around the text.
AROUND = frozenset(
    "ad ads adv advert adverts advertisement banner sponsor sponsored promo cookie cookies consent gdpr notice notices alert popup modal overlay nav navbar navigation menu breadcrumb breadcrumbs "
    "sidebar aside footer header masthead toolbar comment comments reply replies respond disqus discussion share sharing social related recommended subscribe newsletter signup login search "
    "pagination pager widget contentinfo complementary".split()
)

# Words that may stand beside those of AROUND in one compound, and words for content.
BESIDE = frozenset(
    "area bar block body bottom box button buttons center column container content desktop fixed form global group header inner item items left line link links list main mobile outer page panel post posts "
    "primary right row secondary section site slot small sticky text title top unit wrap wrapper".split()
)
CONTENT = frozenset("article body content entry main post story text".split())
# Parts that list articles of others: these do not make them main parts.
LISTS = frozenset("comment comments reply replies respond disqus discussion related recommended".split())
NEVER = frozenset("#page html body".split())

#: Elements that make up a layout; others do if they have a name.
SECTION = frozenset("body div section main article nav header footer aside table form center frameset".split())
DIGITS = re.compile(r"\d+")

TOKEN = re.compile(r"""<(?:!--.*?(?:-->|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|[!?/][^>]*(?:>|\Z)|[a-zA-Z][^>]*(?:>|\Z))""", re.S)
NAMED = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PART = re.compile(r"[^a-z0-9]+")
RAW_END = {tag: re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I) for tag in RAW}


class Element:
    """An element: tag, label for matching, children (elements and strings), whether it is around the text."""

    __slots__ = ("tag", "label", "children", "around", "number", "form")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.children, self.number, self.form = tag, [], -1, None
        names = " ".join("".join(m) for m in NAMED.findall(attributes)).lower() if "=" in attributes else ""
        self.label = f"{tag} {names}"
        self.around = tag in HIDDEN or (bool(names) and tag not in NEVER and _named_around(names))


def _named_around(names: str) -> bool:
    """Whether class, id and role say that an element is around the text."""
    found = False
    for name in names.split():
        parts = [p for p in PART.split(name) if p and not p.isdigit()]
        if AROUND.isdisjoint(parts):
            if parts and parts[-1] in CONTENT:
                return False
        elif all(p in AROUND or p in BESIDE for p in parts):
            found = True
    return found


def _cleared(root: Element) -> None:
    """Names do not hide the only main part of a page, and the name of <main> or of what holds it counts for nothing."""
    todo: list[tuple[Element, Element | None, bool, bool]] = [(root, None, False, False)]
    clear = {tag: False for tag in MAIN}
    held: dict[int, Element | None] = {}
    mains = []
    while todo:
        element, parent, inside, listed = todo.pop()
        held[id(element)] = parent
        inside = inside or element.around
        listed = listed or (element.around and not LISTS.isdisjoint(PART.split(element.label)))
        if element.tag == "main" or (element.tag == "article" and not listed):
            mains.append((element, inside))
            clear[element.tag] |= not inside
        # Parts that HTML itself puts around the text keep their main parts to themselves; a form may hold a page.
        if element.tag not in HIDDEN or element.tag == "form":
            todo.extend((c, element, inside, listed) for c in element.children if not isinstance(c, str))
    for element, inside in mains:
        if inside and (element.tag == "main" or not clear["article"]):
            while element is not None and id(element) in held:
                element.around = False
                element = held[id(element)]


def parse(html: str) -> Element:
    """Tree of a page; elements are numbered in page order."""
    root = Element("#page")
    stack, at, number = [root], 0, 0
    while True:
        m = TOKEN.search(html, at)
        if m is None:
            break
        if m.start() > at:
            stack[-1].children.append(html[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    del stack[depth:]
                    break
            continue
        if tag not in INLINE:
            # A block ends an open paragraph, an item ends the item before it.
            for depth in range(len(stack) - 1, 0, -1):
                open_tag = stack[depth].tag
                if open_tag == "p" or open_tag in CLOSES.get(tag, ()):
                    del stack[depth:]
                    break
                if open_tag not in INLINE:
                    break
        element = Element(tag, m[3])
        element.number = number = number + 1
        stack[-1].children.append(element)
        if tag in RAW and not m[3].endswith("/"):
            end = RAW_END[tag].search(html, at)
            at = end.end() if end else len(html)
        elif tag not in VOID and not m[3].endswith("/"):
            stack.append(element)
    if at < len(html):
        stack[-1].children.append(html[at:])
    _cleared(root)
    if not blocks(root):
        _uncovered(root)
    return root


def _uncovered(root: Element) -> None:
    """Where names would hide all text of a page, only elements that HTML names are around it."""
    todo = [root]
    while todo:
        element = todo.pop()
        element.around = element.tag in HIDDEN
        if not element.around:
            todo.extend(c for c in element.children if not isinstance(c, str))


def blocks(root: Element) -> list[tuple[Element, int, str]]:
    """(owner, number of the run in it, text) of every block of text that is not around the text."""
    mains = _mains(root)
    found: list[tuple[Element, int, str]] = []
    runs: dict[int, int] = {}

    def close(owner: Element, run: list[str]) -> None:
        text = "".join(run)
        text = " ".join((unescape(text) if "&" in text else text).split())
        run.clear()
        if text:
            nth = runs.get(id(owner), 0)
            runs[id(owner)] = nth + 1
            found.append((owner, nth, text))

    for main in mains:
        run: list[str] = []
        # (element, owner of its text, next child); inline elements share the owner and the run.
        todo: list[list] = [[main, main, 0]]
        while todo:
            element, owner, i = todo[-1]
            if i == len(element.children):
                todo.pop()
                if element is owner:
                    close(owner, run)
                continue
            todo[-1][2] = i + 1
            child = element.children[i]
            if isinstance(child, str):
                run.append(child)
            elif child.tag == "br":
                run.append(" ")
            elif child.around or child.tag in VOID:
                if child.tag not in INLINE:
                    close(owner, run)
            elif child.tag in INLINE:
                todo.append([child, owner, 0])
            else:
                close(owner, run)
                todo.append([child, child, 0])
    return found


def _mains(root: Element) -> list[Element]:
    """Outermost main parts of a page, or the page itself."""
    found, todo = [], [root]
    while todo:
        element = todo.pop()
        if element.tag in MAIN:
            found.append(element)
            continue
        todo.extend(c for c in reversed(element.children) if not isinstance(c, str) and not c.around)
    return found or [root]


def layout(root: Element) -> int:
    """Hash of the set of container paths of a page."""
    paths, todo = {"#page"}, [(root, "#page", 0)]
    while todo:
        element, path, depth = todo.pop()
        for child in element.children:
            if isinstance(child, str) or child.tag in INLINE or child.around or child.tag in RAW or child.tag in VOID:
                continue
            named = child.tag in SECTION or child.label != f"{child.tag} "
            below = f"{xxh64_intdigest(path.encode())} {DIGITS.sub('#', child.label)}" if named else path
            paths.add(below)
            if child.tag not in MAIN and depth < DEEPEST:
                todo.append((child, below, depth + 1))
    return xxh64_intdigest("\n".join(sorted(paths)).encode()) >> 1


def _form(element: Element, forms: dict) -> int:
    """Number of the shape of an element: label and shapes of its children; equal shapes, equal numbers."""
    todo = [element]
    while todo:
        e = todo[-1]
        kids = [c for c in e.children if not isinstance(c, str)]
        missing = [c for c in kids if c.form is None]
        if missing:
            todo.extend(missing)
            continue
        todo.pop()
        e.form = forms.setdefault((e.label, tuple(c.form for c in kids)), len(forms))
    return element.form


class Matcher:
    """Simple tree matching against one reference page; scores of pairs of shapes are remembered."""

    def __init__(self, html: str):
        self.forms: dict = {}
        self.reference = parse(html)
        _form(self.reference, self.forms)
        self.scores: dict[tuple[int, int], int] = {}

    def score(self, a: Element, b: Element, depth: int = 0) -> int:
        """Number of pairs in the best matching that keeps order and parents."""
        if a.label != b.label or depth > DEEPEST:
            return 0
        key = (a.form, b.form)
        known = self.scores.get(key)
        if known is None:
            known = self.scores[key] = 1 + sum(s for _, _, s in self.pairs(a, b, depth))
            if len(self.scores) > 100_000:
                self.scores.clear()
        return known

    def pairs(self, a: Element, b: Element, depth: int) -> list[tuple[Element, Element, int]]:
        """Matched children of two matched elements with their scores."""
        left = [c for c in a.children if not isinstance(c, str)]
        right = [c for c in b.children if not isinstance(c, str)]
        head, tail = 0, 0
        while head < min(len(left), len(right)) and left[head].form == right[head].form:
            head += 1
        while tail < min(len(left), len(right)) - head and left[-1 - tail].form == right[-1 - tail].form:
            tail += 1
        out = [(x, y, self.score(x, y, depth + 1)) for x, y in zip(left[:head], right[:head])]
        ends = [(x, y, self.score(x, y, depth + 1)) for x, y in zip(left[len(left) - tail :], right[len(right) - tail :])]
        left, right = left[head : len(left) - tail], right[head : len(right) - tail]
        if left and right:
            table = [[0] * (len(right) + 1)]
            for x in left:
                above, row = table[-1], [0]
                for j, y in enumerate(right):
                    s = self.score(x, y, depth + 1) if x.label == y.label else 0
                    row.append(max(above[j + 1], row[j], above[j] + s))
                table.append(row)
            i, j, middle = len(left), len(right), []
            while i and j:
                if table[i][j] == table[i - 1][j]:
                    i -= 1
                elif table[i][j] == table[i][j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    middle.append((left[i], right[j], table[i + 1][j + 1] - table[i][j]))
            out += reversed(middle)
        return out + ends

    def slots(self, page: Element) -> dict[int, int]:
        """Number of the reference element of every matched element of a page."""
        _form(page, self.forms)
        found, todo = {page.number: self.reference.number}, [(self.reference, page, 0)]
        while todo:
            a, b, depth = todo.pop()
            if depth <= DEEPEST:
                for x, y, _ in self.pairs(a, b, depth):
                    found[y.number] = x.number
                    todo.append((x, y, depth + 1))
        return found


_matchers: dict[str, Matcher] = {}


def _matcher(reference: str) -> Matcher:
    if reference not in _matchers or len(_matchers[reference].forms) > 200_000:
        if len(_matchers) >= 256:
            _matchers.clear()
        _matchers[reference] = Matcher(reference)
    return _matchers[reference]


def slotted(html: str, reference: str) -> list[tuple[int, int, str]]:
    """(slot, hash of the text, text) of every block of a page; slot -1: not in the reference."""
    page = parse(html)
    found = blocks(page)
    numbers = _matcher(reference).slots(page) if found else {}
    out = []
    for owner, nth, text in found:
        number = numbers.get(owner.number)
        slot = -1 if number is None or nth >= 1000 else (number + 1) * 1000 + nth
        out.append((slot, xxh64_intdigest(text.encode()) >> 1, text))
    return out


def _shaped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the layout of a page and the digest of its blocks, NULL if it has none."""
    for batch in batches:
        layouts, digests = [], []
        for html in batch.column("html").to_pylist():
            root = parse(html)
            found = [text for _, _, text in blocks(root)]
            layouts.append(layout(root) if found else None)
            digests.append(xxh64_intdigest("\n".join(found).encode()) >> 1 if found else None)
        columns = [*batch.columns, pa.array(layouts, pa.int64()), pa.array(digests, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "layout", "digest"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hosts, groups, slots, hashes, digests = [], [], [], [], []
        for host, group, html, reference, digest in zip(*[batch.column(c).to_pylist() for c in ("host", "group", "html", "reference", "digest")]):
            for slot, h in {(s, h) for s, h, _ in slotted(html, reference or "") if s >= 0}:
                hosts.append(host)
                groups.append(group)
                slots.append(slot)
                hashes.append(h)
                digests.append(digest)
        columns = [pa.array(hosts, pa.string()), *[pa.array(x, pa.int64()) for x in (groups, slots, hashes, digests)]]
        yield pa.RecordBatch.from_arrays(columns, ["host", "group", "slot", "hash", "digest"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for html, reference, template in zip(batch.column("html").to_pylist(), batch.column("reference").to_pylist(), batch.column("template").to_pylist()):
            fixed = {(t["slot"], t["hash"]) for t in template or ()}
            if fixed:
                kept = [text for slot, h, text in slotted(html, reference or "") if (slot, h) not in fixed]
            else:
                kept = [text for _, _, text in blocks(parse(html))]
            texts.append("\n\n".join(kept))
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
        )


def _small(frame: DataFrame, column: str) -> DataFrame:
    """A stored frame with a hint to send it to all tasks, if its texts are no more than BROADCAST_BYTES; else as it is."""
    size = frame.agg(F.sum(F.octet_length(column) + 64)).first()[0] or 0
    return F.broadcast(frame) if size <= BROADCAST_BYTES else frame


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars."""
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url_col), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"), host.alias("host"))
    shaped = rows.mapInArrow(_shaped, "page_id long, url string, html string, host string, layout long, digest long")
    # Pages without blocks have no layout: they are neither a reference nor counted.
    draw = F.xxhash64(F.md5(F.col("html").cast("binary")))
    different = shaped.where("digest IS NOT NULL").groupBy("host", "layout", "digest").agg(F.min(draw).alias("draw"))
    different = materialize(different, "html-pages")
    drawable = rows.withColumn("draw", draw)
    layouts = different.groupBy("host", "layout").agg(F.count(F.lit(1)).alias("n"), F.min("draw").alias("draw"))
    largest = layouts.groupBy("host").agg(F.max(F.struct("n", "layout")).alias("most"))
    group = F.when(F.col("n") >= MIN_PAGES, F.col("layout")).otherwise(F.col("most.layout"))
    grouped = materialize(layouts.join(largest, "host").select("host", "layout", "draw", group.alias("group")), "html-layouts")
    # Only draws are compared; the text of one page per layout is kept.
    drawn = grouped.where(F.col("layout") == F.col("group")).select("host", "draw", "group")
    found = drawable.join(drawn, ["host", "draw"]).groupBy("host", "group").agg(F.first("html").alias("reference"))
    members = grouped.select("host", "layout", "group")
    counted = different.join(members, ["host", "layout"]).select("host", "group", "digest").distinct().groupBy("host", "group").agg(F.count(F.lit(1)).alias("pages"))
    references = materialize(found.join(counted, ["host", "group"]).where(F.col("pages") >= MIN_PAGES), "html-references")
    # Copies of a page are one page, here and in the number of pages: only the drawn one is aligned. Rows meet by page,
    # not by host, so a host of any size is spread out, and the parsed layout comes from the stored rows.
    told = different.join(members, ["host", "layout"]).select("host", "draw", "group", "digest")
    aligned = drawable.join(told, ["host", "draw"]).join(_small(references, "reference"), ["host", "group"]).select("host", "group", "html", "reference", "digest")
    counts = aligned.mapInArrow(_counted, "host string, group long, slot long, hash long, digest long").distinct()
    counts = counts.groupBy("host", "group", "slot", "hash").agg(F.count(F.lit(1)).alias("n"))
    fixed = counts.join(references.select("host", "group", "pages"), ["host", "group"]).where((2 * F.col("n") > F.col("pages")) & (F.col("n") >= MIN_PAGES))
    # A slot has one text in more than half of the pages at most, so a layout has as many as its reference has blocks.
    templates = fixed.groupBy("host", "group").agg(F.collect_list(F.struct("slot", "hash")).alias("template"))
    wrappers = members.join(references.join(templates, ["host", "group"]), ["host", "group"]).select("host", "layout", "reference", "template")
    wrappers = materialize(wrappers, "html-wrappers")
    return shaped.join(_small(wrappers, "reference"), ["host", "layout"], "left").select("page_id", "url", "html", "reference", "template").mapInArrow(_texts, "page_id long, url string, text string, n_chars long")
