"""HTML extraction by wrapper induction.

Each page becomes a tree of its blocks; a run of like siblings (one label and
the same tree below) is one node of it, so a page's shape doesn't depend on how
much it says.  The different shapes of a host are aligned by simple tree
matching (the maximum matching of two ordered, labelled trees, by dynamic
programming over their children) into one template tree, whose nodes are the
host's slots.  Then every page is aligned to its host's template, and for each
slot the pages that have it and the pages that show a text in it are counted,
exactly, by hash.  Texts that nearly all of a slot's pages show, and at least
half of the host's, are constant: they are the template's.  The others vary; the content is the slot that holds
the varying text, found by going down from the root as long as one slot holds
nearly all of it.  Element kinds and names decide what the counts can't: menus,
adverts and comments that vary from page to page too.  Hosts with fewer than
``MIN_PAGES`` pages have no constants and rely on kinds and names more.

Every step adds up or goes by the order of the shapes, so rows don't depend on
how pages are dealt to tasks.  Shapes are merged in salted rounds that hold one
template at a time; counts are added up in the tasks before they move; pages
meet their host's wrapper over many tasks.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolens.llm.html_tree import BLOCK, RAW, Node, parse, squeeze
from chronolens.llm.scratch import Scratch

SALTS = 16
MERGE_SALTS = 64  # templates of a host's shapes that are made side by side
MIN_PAGES = 8  # different pages that a constant must be on: by the classes of their hashes, MARKS in all, so copies of a page count once
MARKS = 64
CONSTANT = 0.95  # share of them that show the same text
ALIKE = 32  # more siblings of one label than this are one run, whatever is below them
HOLDS = 0.8  # share of the varying text that a slot must hold to be gone down into
MAJORITY = 0.5  # the same for a slot whose kind or name says content; and what clears one whose name says otherwise
COUNTED = 400_000  # different (slot, text) pairs that a task counts before it sends them on

# Elements, and words of class names, identifiers and roles, that aren't the article.
NEVER = RAW | frozenset("head button select option input label dialog menu canvas audio video object".split())
KINDS = frozenset("nav aside footer".split())
NAMED = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert|adverts|advertisement|advertising|banner|banners|breadcrumb|breadcrumbs|consent|cookie|cookies|dialog|footer|gdpr|login|menu|menubar|modal|nav|navbar|navigation|newsletter|notice|notices|overlay|pagination|popup|promo|promoted|recommended|related|search|share|sharing|sidebar|signup|skip|social|sponsor|sponsored|subscribe|tags|toolbar|widget|widgets|complementary|contentinfo|alert)(?:$|[\s_-])"
)
SPOKEN = re.compile(r"(?:^|[\s_-])(?:comment|comments|commentlist|disqus|hidden|replies|respond)(?:$|[\s_-])")
HEADS = re.compile(r"(?:^|[\s_-])(?:header|masthead|topbar|site-?header|banner)(?:$|[\s_-])")
ARTICLE = re.compile(r"(?:^|[\s_-])(?:article|articlebody|main|content|post|entry|story|body-?copy)(?:$|[\s_-])")
CONTAINERS = frozenset("#root html body main div section center form table tbody tr td header".split())
HEADINGS = frozenset("h1 h2".split())
_PLAIN = re.compile(r"[^a-z_-]")


@lru_cache(50_000)
def verdict(tag: str, names: str, inside: bool) -> int:
    """By kind and name: 2 never content, 1 not content unless the counts clear it, 0 nothing against it. inside: below an article, whose own header holds the title."""
    if tag in NEVER or tag in KINDS or names and SPOKEN.search(names):
        return 2
    if tag == "header" and not inside:
        return 2
    if tag in ("article", "main", "body", "html", "#root"):
        return 0
    if tag == "form":
        return 1
    return 1 if names and (NAMED.search(names) or not inside and HEADS.search(names)) else 0


class Block:
    """A block element of a page: its texts and the blocks among them in order, and the characters of its links."""

    __slots__ = ("tag", "names", "items", "links", "shape")

    def __init__(self, tag: str, names: str):
        self.tag, self.names = tag, names
        self.items: list[str | Block] = []
        self.links = 0
        self.shape: Shape | None = None


def blocks(node: Node, inside: bool = False) -> Block:
    out = Block(node.tag, node.names)
    inside = inside or node.tag in ("article", "main")
    current: list[str] = []

    def flush() -> None:
        if text := squeeze("".join(current)):
            out.items.append(text)
        current.clear()

    stack: list[tuple[str | Node, bool]] = [(c, False) for c in reversed(node.children)]
    while stack:
        x, in_link = stack.pop()
        if isinstance(x, str):
            current.append(x)
            out.links += len(x) if in_link else 0
        elif x.tag == "br":
            current.append(" ")
        elif x.tag in NEVER:
            current.append(" ") if x.tag in BLOCK else None
        elif x.tag in BLOCK:
            flush()
            out.items.append(blocks(x, inside))
        elif verdict(x.tag, x.names, inside) == 0:
            stack.extend((c, in_link or x.tag == "a") for c in reversed(x.children))
    flush()
    return out


class Shape:
    """A node of a page's collapsed tree, or of a template: label, pages, children; number in the template."""

    __slots__ = ("label", "pages", "children", "number", "key")

    def __init__(self, label: str, pages: int = 1, children: list | None = None):
        self.label, self.pages, self.children = label, pages, children or []
        self.number, self.key = -1, ""

    @property
    def tag(self) -> str:
        return self.label.partition(".")[0]

    @property
    def names(self) -> str:
        return self.label.partition(".")[2]

    def dump(self) -> list:
        return [self.label, self.pages, [c.dump() for c in self.children]]

    @classmethod
    def load(cls, x: list) -> Shape:
        return cls(x[0], x[1], [cls.load(c) for c in x[2]])

    def nodes(self) -> Iterator[Shape]:
        """In document order, this one first."""
        stack = [self]
        while stack:
            x = stack.pop()
            yield x
            stack.extend(reversed(x.children))

    def numbered(self) -> Shape:
        for i, x in enumerate(self.nodes()):
            x.number = i
        return self


@lru_cache(50_000)
def label_of(tag: str, names: str) -> str:
    """Tag and names; words of names with anything but letters (numbers of posts, generated names) are left out."""
    names = " ".join(sorted({x for x in names.split() if not _PLAIN.search(x)})) if names else ""
    tag = _PLAIN.sub("_", tag.replace("#", "")) if tag not in BLOCK else tag
    return f"{tag}.{names}" if names else tag


def shaped(block: Block) -> Shape:
    """The collapsed tree of a page; every block knows the node that it became."""
    out = Shape(label_of(block.tag, block.names))
    made = [(x, shaped(x)) for x in block.items if type(x) is Block]
    block.shape = out
    if not made:
        out.key = out.label
        return out
    number: dict[str, int] = {}
    for _, s in made:
        number[s.label] = number.get(s.label, 0) + 1
    by_key: dict[str, Shape] = {}
    for x, s in made:
        run = s.label if number[s.label] > ALIKE else s.key
        if run not in by_key:
            by_key[run] = s
            out.children.append(s)
        elif by_key[run].key != s.key:
            _absorb(by_key[run], s)
        x.shape = by_key[run]
    out.key = _key(out)
    return out


def _key(s: Shape) -> str:
    return f"{s.label}({','.join(c.key for c in s.children)})" if s.children else s.label


def _absorb(into: Shape, other: Shape) -> None:
    """Adds the children of a like sibling of the same page."""
    at = {c.label: c for c in into.children}
    for c in other.children:
        if c.label in at:
            _absorb(at[c.label], c)
        else:
            at[c.label] = c
            into.children.append(c)
    into.key = _key(into)


def settled(block: Block) -> None:
    """After siblings were absorbed: every block's node is the one that is in the tree."""
    stack = [block]
    while stack:
        x = stack.pop()
        if not x.shape.children:
            continue
        own = {id(c) for c in x.shape.children}
        by_label = {c.label: c for c in x.shape.children}
        for child in x.items:
            if type(child) is Block:
                if id(child.shape) not in own:
                    child.shape = by_label[child.shape.label]
                stack.append(child)


def read(html: str) -> tuple[Block, Shape]:
    page = blocks(parse(html))
    shape = shaped(page)
    settled(page)
    return page, shape


def heaviest(pairs: list[tuple[int, int, int]], width: int) -> list[tuple[int, int]]:
    """Of pairs (i, j, weight), the chain rising in both i and j with the largest weight, by dynamic programming over prefix maxima."""
    tree: list[tuple[int, int]] = [(0, -1)] * (width + 1)
    before: list[int] = []
    top = (0, -1)
    for k, (_, j, w) in enumerate(pairs):  # by i, and by j from the right, so that one i is used once
        best, x = (0, -1), j
        while x > 0:
            if tree[x][0] > best[0]:
                best = tree[x]
            x &= x - 1
        before.append(best[1])
        own = (best[0] + w, k)
        x = j + 1
        while x <= width:
            if own[0] > tree[x][0]:
                tree[x] = own
            x += x & -x
        if own[0] > top[0]:
            top = own
    out, k = [], top[1]
    while k >= 0:
        out.append(pairs[k][:2])
        k = before[k]
    return out[::-1]


def matching(a: list[Shape], b: list[Shape], depth: int = 3) -> list[tuple[int, int]]:
    """Simple tree matching of two child lists: the order-keeping pairs of like labels with the largest common trees."""
    if [x.label for x in a] == [x.label for x in b]:
        return [(i, i) for i in range(len(a))]
    places: dict[str, list[int]] = {}
    for j, y in enumerate(b):
        places.setdefault(y.label, []).append(j)
    pairs = [(i, j, common(x, b[j], depth)) for i, x in enumerate(a) for j in reversed(places.get(x.label, ()))]
    return heaviest(pairs, len(b))


def common(a: Shape, b: Shape, depth: int) -> int:
    """Size of the largest common top-down tree, down to a depth."""
    if depth == 0 or not a.children or not b.children:
        return 1
    return 1 + sum(common(a.children[i], b.children[j], depth - 1) for i, j in matching(a.children, b.children, depth - 1))


def merge(into: Shape, other: Shape) -> None:
    """Aligns other to the template; what has no place in it yet gets one, after what stands before it."""
    into.pages += other.pages
    pairs = dict((j, i) for i, j in matching(into.children, other.children))
    for j, i in pairs.items():
        merge(into.children[i], other.children[j])
    fresh: dict[int, list[Shape]] = {}
    place = -1
    for j, child in enumerate(other.children):
        if j in pairs:
            place = pairs[j]
        else:
            fresh.setdefault(place, []).append(child)
    if fresh:
        into.children = [x for i in range(-1, len(into.children)) for x in ([into.children[i]] if i >= 0 else []) + fresh.get(i, [])]


def align(template: Shape, page: Shape) -> None:
    """Numbers the page's nodes by the template's; -1 where it has none."""
    page.number = template.number
    for i, j in matching(template.children, page.children):
        align(template.children[i], page.children[j])


def text_hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(errors="surrogatepass"), digest_size=8).digest(), "little", signed=True)


def mark_of(html: str) -> int:
    """One of MARKS bits of a signed number."""
    bit = text_hash(html) % MARKS
    return 1 << bit if bit < 63 else -1 << 63


def shown(page: Block) -> Iterator[tuple[Block, str]]:
    """The texts of a page with their blocks, in order."""
    stack: list[tuple[Block, str | Block]] = [(page, x) for x in reversed(page.items)]
    while stack:
        block, x = stack.pop()
        if isinstance(x, str):
            yield block, x
        else:
            stack.extend((x, y) for y in reversed(x.items))


def wrapper(template: Shape, chars: dict[int, int], links: dict[int, int], constants: dict[int, list[int]]) -> dict:
    """What of a numbered template is content: numbers of the content slots, numbers of slots to leave out, and the constant texts by slot.

    chars: characters that vary, by slot; links: characters in links.
    """
    enough = template.pages >= MIN_PAGES
    mass: dict[int, int] = {}
    linked: dict[int, int] = {}
    against: dict[int, int] = {}
    inside: dict[int, bool] = {template.number: False}
    order = list(template.nodes())
    for t in order:
        against[t.number] = verdict(t.tag if t is not template else "#root", t.names, inside[t.number])
        for c in t.children:
            inside[c.number] = inside[t.number] or t.tag in ("article", "main")
    whole: dict[int, int] = {}
    for t in reversed(order):  # with what only its name speaks against
        whole[t.number] = 0 if against[t.number] == 2 else chars.get(t.number, 0) + sum(whole[c.number] for c in t.children)
    total = whole[template.number]
    out: set[int] = set()
    for t in reversed(order):
        cleared = enough and 2 * t.pages >= template.pages and whole[t.number] >= MAJORITY * total > 0
        dropped = against[t.number] == 2 or against[t.number] == 1 and not cleared
        mass[t.number] = 0 if dropped else chars.get(t.number, 0) + sum(mass[c.number] for c in t.children)
        linked[t.number] = 0 if dropped else links.get(t.number, 0) + sum(linked[c.number] for c in t.children)
        if dropped:
            out.add(t.number)
    content, above = template, template

    def says(t: Shape) -> bool:
        return t.tag in ("article", "main") or bool(t.names and ARTICLE.search(t.names))

    if not enough:  # too few pages to trust: an article by its kind, if there is one
        found = [t for t in order if t.tag == "article" and mass[t.number]] or [t for t in order if t.tag == "main" and mass[t.number]]
        if found:
            content = max(found, key=lambda t: (mass[t.number], -t.number))
            above = next(t for t in order if content in t.children)
    while content.tag != "article":
        own = mass[content.number]
        best = max(content.children, key=lambda c: (mass[c.number], -c.number), default=None)
        if best is None or not own or not mass[best.number]:
            break
        held = mass[best.number] / own
        title = any(c is not best and mass[c.number] and any(x.tag in HEADINGS and mass[x.number] for x in c.nodes()) for c in content.children)
        if not (best.tag in CONTAINERS | {"article"} and (held >= HOLDS and not title or held >= MAJORITY and best.tag == "article" or held >= MAJORITY and says(best) and not title)):
            break
        content, above = best, content
    chosen = [c.number for c in above.children if c.label == content.label and c.number not in out] if content.tag == "article" else [content.number]
    if enough and content.tag not in ("article", "main"):  # lists of links beside the content are menus
        for t in content.nodes():
            m = mass[t.number]
            if t is not content and t.tag in ("ul", "ol", "dl", "table", "div", "section") and linked[t.number] >= 0.7 * m and 0 < m < 0.2 * mass[content.number]:
                out.add(t.number)
    return {"content": sorted(chosen), "out": sorted(out), "fixed": {str(k): sorted(v) for k, v in sorted(constants.items())}}


def alone(page: Block, shape: Shape) -> dict:
    """The wrapper of a page by itself."""
    shape.numbered()
    chars: dict[int, int] = {}
    links: dict[int, int] = {}
    for block, text in shown(page):
        chars[block.shape.number] = chars.get(block.shape.number, 0) + len(text)
    stack = [page]
    while stack:
        x = stack.pop()
        links[x.shape.number] = links.get(x.shape.number, 0) + x.links
        stack.extend(y for y in x.items if isinstance(y, Block))
    return wrapper(shape, chars, links, {})


class Rules:
    """A host's wrapper as the tasks use it."""

    def __init__(self, template: Shape, found: dict):
        self.template = template
        self.content, self.out = set(found["content"]), set(found["out"])
        self.fixed = {int(k): set(v) for k, v in found["fixed"].items()}
        self.known: dict[str, list[int]] = {}

    def number(self, shape: Shape) -> None:
        numbers = self.known.get(shape.key)
        if numbers is None:
            align(self.template, shape)
            if len(self.known) < 10_000:
                self.known[shape.key] = [x.number for x in shape.nodes()]
        else:
            for x, k in zip(shape.nodes(), numbers, strict=True):
                x.number = k


def content_texts(page: Block, rules: Rules, constants: bool = True) -> list[str]:
    """The texts of the content slots without what is left out and (if constants) without constant texts."""
    out: list[str] = []
    stack: list[tuple[Block | None, str | Block, bool, bool]] = [(None, page, False, False)]
    while stack:
        block, x, on, inside = stack.pop()
        if isinstance(x, Block):
            k = x.shape.number
            # a slot that the template doesn't have is judged by kind and name
            if k in rules.out or k < 0 and verdict(x.tag, x.names, inside):
                continue
            on, inside = on or k in rules.content, inside or x.tag in ("article", "main")
            stack.extend((x, y, on, inside) for y in reversed(x.items))
        elif on and not (constants and block.tag != "h1" and text_hash(x) in rules.fixed.get(block.shape.number, ())):
            out.append(x)  # a title may recur; it is content
    return out


def extract(html: str, rules: Rules | None) -> str:
    if not html:
        return ""
    page, shape = read(html)
    found: list[str] = []
    if rules is not None:
        rules.number(shape)
        found = content_texts(page, rules) or content_texts(page, rules, constants=False)
    if not found:  # a page without its host's content slot, or without a wrapper
        found = content_texts(page, Rules(shape, alone(page, shape)))
    return "\n\n".join(found)


# -- plans


def _shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different shapes of each host's pages, with their numbers."""
    for batch in batches:
        seen: dict[tuple[str, str], list] = {}
        for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            shape = read(html or "")[1]
            seen.setdefault((host, shape.key), [0, shape])[0] += 1
        rows = [(host, hashlib.blake2b(key.encode(), digest_size=16).hexdigest(), n, json.dumps(shape.dump())) for (host, key), (n, shape) in seen.items()]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.string()), strict=True)], names=["host", "mark", "n", "shape"])


def _weighted(shape: Shape, n: int) -> Shape:
    for x in shape.nodes():
        x.pages = n
    return shape


def _merge_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Templates of runs of equal (host, salt), one at a time."""
    now: tuple | None = None
    template: Shape | None = None
    done: list[tuple] = []

    def send() -> pa.RecordBatch:
        columns = list(zip(*done, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.string())], names=["host", "salt", "template"])

    for batch in batches:
        for host, salt, n, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            shape = _weighted(Shape.load(json.loads(blob)), n)
            if (host, salt) == now:
                merge(template, shape)
                continue
            if now is not None:
                done.append((*now, json.dumps(template.dump())))
            now, template = (host, salt), shape
        if done:
            yield send()
            done = []
    if now is not None:
        done.append((*now, json.dumps(template.dump())))
        yield send()


def _join_templates(table: pa.Table) -> pa.Table:
    whole: Shape | None = None
    for _, blob in sorted(zip(table.column("salt").to_pylist(), table.column("template").to_pylist(), strict=True)):
        t = Shape.load(json.loads(blob))
        if whole is None:
            whole = t
        else:
            merge(whole, t)
    return pa.table([table.column("host")[:1], pa.array([json.dumps(whole.dump())])], names=["host", "template"])


NOTHING = {"content": [], "out": [], "fixed": {}}


def _known(cache: dict, template: str | None, found: str | None = None) -> Rules | None:
    """Rules from their stored form, kept for the pages to come."""
    if template is None:
        return None
    if (template, found) not in cache:
        if len(cache) > 1_000:
            cache.clear()
        cache[template, found] = Rules(Shape.load(json.loads(template)).numbered(), json.loads(found) if found else NOTHING)
    return cache[template, found]


COUNTS = "host string, slot int, text long, pages long, chars long, links long, marks long"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """By host, slot and text: the pages that show it and its characters; by host and slot (text null): the pages that have it, its characters, and those in links. Both with the set of the pages' hash classes, as bits."""
    cache: dict = {}
    sums: dict[tuple, list[int]] = {}

    def send() -> Iterator[pa.RecordBatch]:
        rows = list(sums.items())
        sums.clear()
        for a in range(0, len(rows), 20_000):
            part = rows[a : a + 20_000]
            columns = [*zip(*(k for k, _ in part), strict=True), *zip(*(v for _, v in part), strict=True)]
            kinds = (pa.string(), pa.int32(), *[pa.int64()] * 5)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in COUNTS.split(", ")])

    for batch in batches:
        for host, html, template in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            page, shape = read(html or "")
            _known(cache, template).number(shape)
            own: dict[tuple, list[int]] = {}
            for block, text in shown(page):
                k = block.shape.number
                if k >= 0:
                    for key in ((host, k, text_hash(text)), (host, k, None)):
                        own.setdefault(key, [1, 0, 0])[1] += len(text)
            stack = [page]
            while stack:
                x = stack.pop()
                if x.links and x.shape.number >= 0 and (host, x.shape.number, None) in own:
                    own[host, x.shape.number, None][2] += x.links
                stack.extend(y for y in x.items if isinstance(y, Block))
            mark = mark_of(html or "")
            for key, (n, chars, links) in own.items():
                old = sums.setdefault(key, [0, 0, 0, 0])
                old[0] += n
                old[1] += chars
                old[2] += links
                old[3] |= mark
        if len(sums) > COUNTED:
            yield from send()
    yield from send()


def _decide(table: pa.Table) -> pa.Table:
    """A host's wrapper, from its template and the sums of its slots."""
    template = Shape.load(json.loads(table.column("template")[0].as_py())).numbered()
    chars: dict[int, int] = {}
    links: dict[int, int] = {}
    constants: dict[int, list[int]] = {}
    for slot, text, pages, n, m in zip(*(table.column(c).to_pylist() for c in ("slot", "text", "pages", "chars", "links")), strict=True):
        if slot is None or text is not None and 2 * pages < template.pages:
            continue
        if text is None:
            chars[slot], links[slot] = chars.get(slot, 0) + n, m
        else:
            chars[slot] = chars.get(slot, 0) - n
            constants.setdefault(slot, []).append(text)
    return pa.table([table.column("host")[:1], table.column("template")[:1], pa.array([json.dumps(wrapper(template, chars, links, constants))])], names=["host", "template", "rules"])


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache: dict = {}
    for batch in batches:
        out = [extract(html or "", _known(cache, template, found)) for html, template, found in zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True)]
        out = [x.encode(errors="replace").decode() for x in out]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], names=["id", "url", "text", "n_chars"])


def wrappers(source: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows (host, template, rules) from rows (host, html) whose host isn't empty."""
    shapes = source.mapInArrow(_shapes, "host string, mark string, n long, shape string")
    # one row for each different shape of a host: the same whatever task saw it
    distinct = shapes.groupBy("host", "mark").agg(F.sum("n").alias("n"), F.min("shape").alias("shape"))
    salted = distinct.withColumn("salt", F.pmod(F.xxhash64("mark"), F.lit(MERGE_SALTS)).cast("int"))
    dealt = salted.repartition("host", "salt").sortWithinPartitions("host", "salt", "mark").select("host", "salt", "n", "shape")
    partial = dealt.mapInArrow(_merge_sorted, "host string, salt int, template string")
    templates = scratch.write(partial.groupBy("host").applyInArrow(_join_templates, "host string, template string"))
    counts = _salted_join(source, templates, F.xxhash64("html")).select("host", "html", "template").where("template IS NOT NULL").mapInArrow(_count, COUNTS)
    counts = scratch.write(counts.groupBy("host", "slot", "text").agg(*[F.sum(c).alias(c) for c in ("pages", "chars", "links")], F.bit_or("marks").alias("marks")).where((F.bit_count("marks") >= MIN_PAGES) | F.col("text").isNull()).drop("marks"))
    slots = counts.where("text IS NULL")
    on = slots.select("host", "slot", F.col("pages").alias("of"))
    fixed = counts.where("text IS NOT NULL").join(on, ["host", "slot"]).where(F.col("pages") >= CONSTANT * F.col("of")).drop("of")
    # a host's slots and constants are bounded by its template
    sums = slots.unionByName(fixed).withColumnRenamed("host", "h")
    known = templates.join(sums, templates["host"] == sums["h"], "left").select("host", "template", "slot", "text", "pages", "chars", "links")
    return scratch.write(known.groupBy("host").applyInArrow(_decide, "host string, template string, rules string"))


def _salted_join(pages: DataFrame, table: DataFrame, by) -> DataFrame:
    """pages with the row of table of their host, a host's pages over SALTS tasks."""
    salted = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return pages.withColumn("salt", F.pmod(by, F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row for each row of pages: id, url, text, n_chars (code points).

    Blocks of the main text in page order, joined by an empty line; white space
    inside a block is one space.  A null or empty page has an empty text.  A
    page without a host, or of a host with few pages, is read by the rules for
    elements and names.  A page that would be empty without its host's constant
    texts keeps them.  Rows that repeat are read, and counted, as often; other
    columns, of any name, are not read; no rows give no rows.  Of texts that
    tie, none is preferred: all that nearly all pages show are constant.
    """
    scratch = Scratch(pages.sparkSession, "html")
    host = F.coalesce(F.regexp_extract(F.lower(F.trim(F.col(f"`{url_col}`"))), r"^(?:[a-z][a-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:@]+)", 1), F.lit(""))
    source = pages.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").cast("string").alias("html"), host.alias("host"))
    found = wrappers(source.where("host <> ''").select("host", "html"), scratch)
    met = _salted_join(source, found, F.xxhash64("id", "url"))
    out = met.select("id", "url", "html", "template", "rules").mapInArrow(_apply, "id long, url string, text string, n_chars long")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")
