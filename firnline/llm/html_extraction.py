"""Main text of web pages by wrapper induction.

Pages of a host are aligned with reference pages of that host by simple tree matching.
A slot whose text stays the same on the pages that have it is part of the template; slots
that vary are content, unless their place says that they are not: menus, page headers and
footers, side bars, notices, adverts, forms, comments.

Every page is parsed once and aligned, on its own, with ``REFERENCES`` pages of its host and as
many of its layout, if the host has several and this one has more than ``LEAST_PAGES`` pages.
What is known about a host or layout is summed from its pages before it is shuffled, so a host with a
third of all pages is no heavier than others.
"""

from __future__ import annotations

import html as entities
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from firnline.llm.columns import read_table
from firnline.session import materialise

QUERY = "op3_html_extraction"

REFERENCES = 2
#: A slot is template if at least so many other pages have it, and this share of them has the same text in it.
LEAST_PAGES, CONSTANT_SHARE = 5, 0.9
#: Reference pages are broadcast up to so many bytes and joined beyond.
BROADCAST_BYTES = 64 << 20
#: Trees are aligned down to this depth; text below it is read but never template.
DEPTH = 150

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|</([a-zA-Z][^\s/>]*)[^>]*>|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S
)
_ATTRIBUTE = re.compile(r"([^\s\"'=<>/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike"
    " strong sub sup time tt u var wbr img input label nobr".split()
)
#: Elements whose content is not markup.
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg math object video audio canvas".split())
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "body": {"head"},
}
SECTIONS = frozenset("ul ol dl table body html article main section div nav aside header footer form".split())

NOT_CONTENT = frozenset("head nav footer aside form button select option fieldset dialog menu header".split()) | RAW
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar menu nav navbar"
    " navigation breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr notice notices alert popup modal overlay"
    " newsletter subscribe signup login share sharing social related recommended comment comments disqus replies respond"
    " widget toolbar pagination pager".split()
)
#: Words that may stand beside one of NAMES in a class or id of the same place: site-footer, not no-sidebar or comments-open.
BESIDE = frozenset(
    "site page main primary secondary top bottom global container wrapper wrap box bar area block section list links link item items"
    " inner outer icons icon buttons button slot unit posts form text title body group panel column col header js"
    " social user post article content".split()
)
MAIN_NAMES = frozenset("content article post entry story".split())


class Node:
    __slots__ = ("tag", "label", "names", "places", "role", "children", "runs", "parent")

    def __init__(self, tag: str, attributes: str, parent: Node | None):
        self.tag, self.parent, self.role = tag, parent, ""
        self.children: list[Node] = []
        #: Text runs and children in page order.
        self.runs: list[list[str] | Node] = []
        self.names: set[str] = set()
        #: Parts of each class and id by itself.
        self.places: list[set[str]] = []
        label = ""
        for name, *values in _ATTRIBUTE.findall(attributes) if attributes else ():
            name = name.lower()
            if name in ("class", "id"):
                value = "".join(values)
                self.places.extend({x.lower() for x in _NAME_PART.findall(token)} for token in value.split())
                self.names.update(*self.places)
                label += "." + value if name == "class" else ""
            elif name == "role":
                self.role = "".join(values).lower()
        self.label = tag + label

    def add(self, text: str) -> None:
        if not self.runs or isinstance(self.runs[-1], Node):
            self.runs.append([])
        self.runs[-1].append(text)

    def text(self) -> str:
        """What stands in this node itself, for comparing slots."""
        return " ".join(tidy(r) for r in self.runs if not isinstance(r, Node))


def tidy(parts: list[str]) -> str:
    return " ".join(entities.unescape("".join(parts)).split())


def parse(page: str) -> Node:
    """Tree of the block elements; inline elements dissolve into the text, white space for ``br``."""
    root = node = Node("#page", "", None)
    at = 0
    while True:
        m = _TOKEN.search(page, at)
        if m is None:
            node.add(page[at:])
            return root
        if m.start() > at:
            node.add(page[at:m.start()])
        at = m.end()
        end, start = m[1], m[2]
        if start:
            tag = start.lower()
            if tag in RAW:
                if not m[3].endswith("/"):
                    close = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
                    at = close.end() if close else len(page)
            elif tag in INLINE:
                continue
            elif tag in VOID:
                node.add(" ")
            else:
                node = _opened(node, tag, m[3])
        elif end:
            tag = end.lower()
            if tag in INLINE or tag in VOID:
                continue
            up = node
            while up.parent is not None and up.tag != tag:
                up = up.parent
            if up.parent is not None:
                node = up.parent


def _opened(node: Node, tag: str, attributes: str) -> Node:
    closing = CLOSES.get(tag, set()) | {"p"}
    up = node
    while up.parent is not None and (up.tag in closing or up.tag not in SECTIONS):
        if up.tag in closing:
            node = up.parent
        up = up.parent
    child = Node(tag, attributes, node)
    node.children.append(child)
    node.runs.append(child)
    return child


def skeleton(root: Node) -> str:
    """The tree without its texts: ``[label, hash of the text, children]``, nested no deeper than ``DEPTH``."""
    def down(n: Node, depth: int) -> list:
        return [n.label, text_hash(n), [down(c, depth + 1) for c in n.children] if depth < DEPTH else []]

    return json.dumps(down(root, 0))


def text_hash(n: Node) -> int:
    return zlib.crc32(n.text().encode("utf-8", "surrogatepass"))


def numbered(tree: list, start: int = 0) -> tuple[list, int]:
    """Give every node of a skeleton its position: ``[label, hash, children, position]``."""
    at = start + 1
    for c in tree[2]:
        at = numbered(c, at)[1]
    tree.append(start)
    return tree, at


def align(page: Node, reference: list) -> dict[int, tuple[int, bool]]:
    """Simple tree matching: ``id(node) -> (position in the reference, same text)`` of the largest matching.

    Among matchings of equal size, one with more equal texts is taken.
    """
    found: dict[int, tuple[int, bool]] = {}
    hashes: dict[int, int] = {}

    def same(n: Node, r: list) -> bool:
        if id(n) not in hashes:
            hashes[id(n)] = text_hash(n)
        return hashes[id(n)] == r[1]

    memo: dict[tuple[int, int], tuple[float, list]] = {}

    def weight(n: Node, r: list, depth: int) -> float:
        if n.label != r[0]:
            return 0.0
        own = 1.0 + 1e-3 * same(n, r)
        return own + (children(n, r, depth)[0] if n.children and r[2] and depth < DEPTH else 0.0)

    def children(n: Node, r: list, depth: int) -> tuple[float, list]:
        key = id(n), r[3]
        if key not in memo:
            a, b = n.children, r[2]
            w = [[weight(x, y, depth + 1) for y in b] for x in a]
            best = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
            for i, row in enumerate(w):
                now, before = best[i + 1], best[i]
                for j, x in enumerate(row):
                    now[j + 1] = max(before[j] + x, before[j + 1], now[j]) if x else max(before[j + 1], now[j])
            pairs, i, j = [], len(a), len(b)
            while i and j:
                if w[i - 1][j - 1] and best[i][j] == best[i - 1][j - 1] + w[i - 1][j - 1]:
                    i, j = i - 1, j - 1
                    pairs.append((a[i], b[j]))
                elif best[i][j] == best[i - 1][j]:
                    i -= 1
                else:
                    j -= 1
            memo[key] = best[-1][-1], pairs
        return memo[key]

    queue = [(page, reference, 0)] if page.label == reference[0] else []
    for n, r, depth in queue:
        found[id(n)] = r[3], same(n, r)
        if n.children and r[2] and depth < DEPTH:
            queue.extend((x, y, depth + 1) for x, y in children(n, r, depth)[1])
    return found


def named_apart(n: Node) -> bool:
    """One whole class or id names a place that is not content."""
    return any(not NAMES.isdisjoint(p) and p <= NAMES | BESIDE for p in n.places)


def excluded(n: Node, inside: bool, kept: frozenset[int] = frozenset()) -> bool:
    """``inside`` an article or main part; names and forms do not exclude what ``kept`` holds, nor ``body``, ``main`` and articles."""
    if n.tag in ("html", "body", "main") or n.role == "main":
        return False
    if n.tag == "header":
        return not inside
    if n.tag == "form" and n.role not in ROLES:
        return id(n) not in kept
    if n.tag in NOT_CONTENT or n.role in ROLES:
        return True
    if id(n) in kept or (n.tag == "article" and not inside):
        return False
    return named_apart(n) or (not inside and {"header"} in n.places)


def is_main(n: Node) -> bool:
    return n.tag == "main" or n.role == "main"


def around_main(root: Node) -> frozenset[int]:
    """Places that hold a main part, or a form or article with more than half of the page's text, and these themselves."""
    nodes = [root]
    for n in nodes:
        nodes.extend(n.children)
    kept: set[int] = set()
    if any(is_main(n) for n in nodes):
        for n in nodes:
            up = n if is_main(n) else None
            while up is not None and id(up) not in kept:
                kept.add(id(up))
                up = up.parent
    large = [n for n in nodes if n.tag in ("article", "form")]
    if large:
        size: dict[int, int] = {}
        for n in reversed(nodes):
            own = sum(len("".join(r).strip()) for r in n.runs if not isinstance(r, Node))
            size[id(n)] = own + sum(size[id(c)] for c in n.children)
        for n in large:
            up = n if 2 * size[id(n)] > size[id(root)] else None
            while up is not None and id(up) not in kept:
                kept.add(id(up))
                up = up.parent
    return frozenset(kept)


def content_roots(root: Node, kept: frozenset[int] = frozenset()) -> list[Node]:
    """Main parts and articles outside of excluded places and of each other; else parts named so; else the page."""
    parts, named = [], []
    stack = [root]
    while stack:
        n = stack.pop()
        if excluded(n, False, kept):
            continue
        if n.tag == "article" or is_main(n):
            parts.append(n)
            continue
        if not MAIN_NAMES.isdisjoint(n.names):
            named.append(n)
            # the outermost named part holds the inner ones
            if not any(True for _ in _below(n, "article", "main")):
                continue
        stack.extend(reversed(n.children))
    return parts or named or [root]


def _below(n: Node, *tags: str) -> Iterator[Node]:
    stack = list(n.children)
    while stack:
        x = stack.pop()
        if x.tag in tags or ("main" in tags and x.role == "main"):
            yield x
        stack.extend(x.children)


def slots(root: Node) -> Iterator[tuple[Node, str]]:
    """Text runs of the content in page order, with their nodes.

    If nothing is left, those of the largest place that was excluded by its name or as a form.
    """
    kept = around_main(root)
    found = [x for top in content_roots(root, kept) for x in _runs_below(top, kept)]
    return iter(found or max(_set_aside(root, kept), key=lambda x: sum(len(t) for _, t in x), default=[]))


def _runs_below(top: Node, kept: frozenset[int]) -> Iterator[tuple[Node, str]]:
    stack: list[tuple[Node, object, bool]] = [(top, top, False)]
    while stack:
        owner, item, inside = stack.pop()
        if isinstance(item, Node):
            if item is top or not excluded(item, inside, kept):
                within = inside or item.tag == "article" or is_main(item)
                stack.extend((item, r, within) for r in reversed(item.runs))
        else:
            text = tidy(item)
            if text:
                yield owner, text


def _set_aside(root: Node, kept: frozenset[int]) -> Iterator[list[tuple[Node, str]]]:
    """Texts of the outermost places that names or forms exclude."""
    stack = [root]
    while stack:
        n = stack.pop()
        if not excluded(n, False, kept):
            stack.extend(reversed(n.children))
        elif n.role not in ROLES and (n.tag == "form" or n.tag not in NOT_CONTENT):
            yield list(_runs_below(n, kept))


def host(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit(""))


def layout(page: Column) -> Column:
    """Hash of the kinds of block elements of a page: their tags and classes, without digits."""
    starts = F.regexp_extract_all(page, F.lit(r"(?i)<((?:body|main|section|article|div|form|table|nav|aside|header|footer)\b[^<>]*)>"), F.lit(1))
    tag = lambda x: F.regexp_extract(x, r"^[A-Za-z]+", 0)
    name = lambda x: F.regexp_extract(x, r"(?i)\sclass\s*=\s*[\"']?([^\"'>]*)", 1)
    labels = F.transform(starts, lambda x: F.lower(F.concat_ws(".", tag(x), F.regexp_replace(name(x), r"\d+", ""))))
    return F.xxhash64(F.array_sort(F.array_distinct(labels)))


def references(pages: DataFrame) -> DataFrame:
    """Skeletons of up to ``REFERENCES`` pages: ``host, layout, refs``, by a hash of page and address.

    Of each host, with a NULL ``layout``, and of each layout of more than ``LEAST_PAGES`` pages of a host with several.
    """
    order = F.xxhash64("page_id", "url")
    groups = materialise(pages.where("host IS NOT NULL").groupBy("host", "layout", F.pmod(order, F.lit(REFERENCES)).alias("slot")).agg(
        F.min(order).alias("order"), F.count(F.lit(1)).alias("n")
    ))
    several = groups.groupBy("host").agg(F.min("layout").alias("a"), F.max("layout").alias("b")).where("a != b").select("host")
    large = groups.groupBy("host", "layout").agg(F.sum("n").alias("n")).where(F.col("n") > LEAST_PAGES).join(several, "host", "left_semi")
    of_host = groups.groupBy("host", "slot").agg(F.min("order").alias("order")).withColumn("layout", F.lit(None).cast("bigint"))
    of_layout = groups.join(large.select("host", "layout"), ["host", "layout"], "left_semi").select("host", "slot", "order", "layout")
    # written first, so that its size is known when the join is planned and pages stay where they are if it is small
    chosen = materialise(of_host.unionByName(of_layout))
    met = pages.select("host", "html", order.alias("order")).join(chosen.select("host", "order").distinct(), ["host", "order"])
    met = met.groupBy("host", "order").agg(F.min("html").alias("html"))

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            trees = pa.array([skeleton(parse(h or "")) for h in b.column("html").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("host"), b.column("order"), trees], ["host", "order", "tree"])

    trees = chosen.join(met.mapInArrow(reduce, "host string, order bigint, tree string"), ["host", "order"])
    by_slot = F.map_from_entries(F.collect_list(F.struct("slot", "tree")))
    return trees.groupBy("host", "layout").agg(by_slot.alias("m")).select(
        "host", "layout", F.array(*[F.element_at("m", F.lit(i).cast("bigint")) for i in range(REFERENCES)]).alias("refs")
    )


_SLOT = pa.struct([("text", pa.string()), ("at", pa.list_(pa.int32())), ("same", pa.list_(pa.bool_()))])
_ALIGNED = "page_id bigint, url string, host string, layout bigint, copy array<boolean>, slots array<struct<text:string,at:array<int>,same:array<boolean>>>"


def _align_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    trees: dict[str, list] = {}
    for b in batches:
        found, copies = [], []
        for page, refs in zip(b.column("html").to_pylist(), b.column("refs").to_pylist()):
            root = parse(page or "")
            wanted = list(slots(root))
            matches = []
            done: dict[str | None, dict] = {None: {}}
            for tree in refs:
                if tree in done:
                    matches.append(done[tree])
                    continue
                if tree not in trees:
                    if len(trees) > 2000:
                        trees.clear()
                    trees[tree] = numbered(json.loads(tree))[0]
                done[tree] = align(root, trees[tree])
                matches.append(done[tree])
            none = (-1, False)
            spots = [[m.get(id(n), none) for m in matches] for n, _ in wanted]
            found.append([
                {"text": t, "at": [p for p, _ in s], "same": [e for _, e in s]} for (_, t), s in zip(wanted, spots)
            ])
            # a page that equals a reference in every slot is taken for a copy of it and proves nothing
            equal = [bool(spots) and all(s[k][1] for s in spots) for k in range(len(matches))]
            copies.append([any(equal[:REFERENCES]), any(equal[REFERENCES:])])
        yield pa.RecordBatch.from_arrays(
            [
                b.column("page_id"), b.column("url"), b.column("host"), b.column("layout"), pa.array(copies, pa.list_(pa.bool_())),
                pa.array(found, pa.list_(_SLOT)),
            ],
            ["page_id", "url", "host", "layout", "copy", "slots"],
        )


def _by_scope(known: DataFrame, column: str) -> list[tuple[DataFrame, list[str], str]]:
    """What is known about hosts and about layouts, with the keys and the name of the column."""
    names = f"host_{column}", f"layout_{column}"
    return [
        (known.where("layout IS NULL").select("host", F.col(column).alias(names[0])), ["host"], names[0]),
        (known.where("layout IS NOT NULL").select("host", "layout", F.col(column).alias(names[1])), ["host", "layout"], names[1]),
    ]


def main_text(pages: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Main text of each row of ``pages`` (``page_id, url, html``): ``page_id, url, text, n_chars``.

    One row for each input row, repeated rows and NULL ids too. NULL and empty html gives an
    empty text; so does a page without content. A page without a host, or of a host with few
    pages, has no template and is judged by its own markup alone. Malformed markup is read as
    far as it goes: unclosed elements end with their parents, stray end tags are skipped and
    a lone ``<`` is text. Other columns are not read.
    """
    own = pages.select("page_id", "url", "html", host(F.col("url")).alias("host"), layout(F.col("html")).alias("layout"))
    refs = materialise(references(own))
    size = refs.agg(F.sum(F.aggregate("refs", F.lit(0).cast("bigint"), lambda a, t: a + F.coalesce(F.octet_length(t), F.lit(0))))).first()[0] or 0
    none = F.array().cast("array<string>")
    met = own
    for part, keys, name in _by_scope(refs, "refs"):
        met = met.join(F.broadcast(part) if size <= broadcast_bytes else part, keys, "left").withColumn(name, F.coalesce(name, none))
    met = met.select("page_id", "url", "host", "layout", "html", F.concat("host_refs", "layout_refs").alias("refs"))
    aligned = materialise(met.mapInArrow(_align_batches, _ALIGNED))
    spots = aligned.where("host IS NOT NULL").select("host", "layout", "copy", F.explode("slots").alias("s")).select(
        "host", "layout", "copy", F.posexplode(F.arrays_zip("s.at", "s.same")).alias("ref", "x")
    ).where("x.at >= 0")
    own_layout = F.col("ref") >= REFERENCES
    spots = spots.where(~F.get("copy", own_layout.cast("int"))).withColumn("layout", F.when(own_layout, F.col("layout")))
    seen = spots.groupBy("host", "layout", "ref", F.col("x.at").alias("at")).agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("x.same"), 1)).alias("equal")
    )
    template = seen.where((F.col("n") >= LEAST_PAGES) & (F.col("equal") >= CONSTANT_SHARE * F.col("n")))
    known = materialise(template.groupBy("host", "layout").agg(F.collect_set(F.struct("ref", "at")).alias("constant")))
    met = aligned
    for part, keys, name in _by_scope(known, "constant"):
        met = met.join(part, keys, "left")

    def fixed(s: Column) -> Column:
        def among(constant: str) -> Column:
            found = F.exists(constant, lambda c: F.coalesce((F.get(s["at"], c["ref"]) == c["at"]) & F.get(s["same"], c["ref"]), F.lit(False)))
            return F.coalesce(found, F.lit(False))

        return among("host_constant") | among("layout_constant")

    content = F.filter("slots", lambda s: ~fixed(s))
    texts = met.select("page_id", "url", F.array_join(F.transform(content, lambda s: s["text"]), " ").alias("text"))
    return texts.withColumn("n_chars", F.char_length("text").cast("bigint"))


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(read_table(spark, sf_dir, "pages"))


SQL = None
