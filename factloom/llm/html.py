"""Operator 7: HTML extraction by a site style tree.

1. Every page is parsed to its blocks of text and the layout of its elements, which are
   stored as hashes (``outlined``).  An element's style path is its tags with their classes,
   ids and roles, from the root down.
2. The pages of one host are merged into one tree of style paths (``trees``), with two
   importances for each node, both from entropies over the host's pages:

   - presentation: the entropy of the orders in which it holds other blocks; what a
     template fixes has 0, however fresh the text in it;
   - content: one less the mean entropy of its texts, so a text that every page repeats
     counts nothing, and a text of one page alone counts fully.

   A node's composite importance is its content's, times a quarter and three quarters of
   the greatest presentation importance from the root down to it.
3. Each host sets its own scale (``ruled``): a node counts relative to the composite of
   the host's typical important text, and a node seen on few pages also by what the trees
   of other hosts say of its path.  This is weighed against a weak prior of its tags, the
   more so the more pages there are, and blocks below ``THRESHOLD`` leave the page, and
   with them every branch in which no block stays.  For that pages are parsed again, which
   costs less than to keep all texts on disk beside the shuffle that brings them together
   with their rules.

Tags alone keep every block (``extracted(pages, statistics=False)`` shows that), so on a
host of two pages or more the tree decides.  A host of one page has no tree; there, and on
pages of which the tree would leave nothing, tags and names decide, inside what the page
marks as main if that has text.  Elements that hold no text to read (scripts, styles, form
fields, hidden ones) go always.  So do those that name themselves adverts or readers'
comments, whose text is as fresh as an article's; but a name alone is not believed of a
phrase or paragraph within the main part, of an element that holds the page's title
heading or main part, and where no text would be left (see ``_settled``).
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import spread_join, stored, table, worker_cache

#: Importance below which a block goes.
THRESHOLD = 0.5
#: The most that statistics weigh, and the pages at which they weigh half of it.
MOST_WEIGHT = 0.9
HALF_PAGES = 3
#: Importance by tags, before any statistics.
NOISE, UNKNOWN, MAIN = 0.5, 0.6, 0.75
#: How much of a text's importance rests on the freedom of the layout around it.
LAYOUT = 0.75
#: Pages that the trees of other hosts count as, at most.
ELSEWHERE = 8
#: Depth to which style paths grow; a deeper element's path is the one there and its own style.
PATH_DEPTH = 60
#: Copies of what a path is joined to, so that none that many hosts or paths share is one key.
SALTS = 16

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: An opening tag on the left closes an open one on the right (within its list or table).
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tbody", "thead", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tr", "td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol menu dl table select body html article div section main".split())
#: Items of lists and tables: however many follow each other, they are one in a layout.
ITEMS = frozenset("li dt dd tr td th".split())
#: Elements without text to read, and elements that seldom hold the main text.
NEVER = frozenset("button canvas datalist head iframe input noscript object optgroup option script select style svg template textarea title".split())
NOISE_TAGS = frozenset("aside dialog fieldset footer form header menu nav search".split())
NOISE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search status toolbar".split())
MAIN_TAGS = MAIN_ROLES = frozenset({"article", "main"})
#: What an article's own text is made of; there a name says what a phrase is about.
PHRASES = frozenset("a abbr b blockquote cite code dd dt em figcaption h1 h2 h3 h4 h5 h6 i mark p pre q small span strong td th u".split())
#: Names of what advertisers and readers wrote.
OTHERS = frozenset("ad ads adv advert adverts advertisement advertisements advertising adsense adslot comment comments commentlist disqus promo promoted promotion replies reply respond sponsor sponsored".split())
#: Names of layout, heeded where a host has no tree.
LAYOUT_NAMES = frozenset(
    "banner banners breadcrumb breadcrumbs consent cookie cookies copyright dialog disclaimer footer gdpr header login masthead menu menubar modal nav navbar navigation newsletter notice notices notification overlay pager pagination paging popup privacy recommended related search share sharing sidebar sidebars signup skip social subscribe subscription tags toc toolbar topbar".split()
)
#: Parts of names that tell nothing; a name counts if all its other parts are in a list.
PLAIN = frozenset("area bar block body bottom box container content form group inner item items left link links list main outer page pane panel posts reader right row section site slot static stories top unit user view widget widgets wrap wrapper zone".split())
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][\w:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
UNSEEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\b", re.I)
HOST = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)"


class Node:
    """An element.  ``gone``: its text is never read; ``others``: it names itself an advert
    or comments, and is believed; ``noise``: its tag or role, or one above, seldom holds
    main text; ``named``: a name says so; ``main``: it is within what the page marks as
    main.  ``id`` is a hash of its style path."""

    __slots__ = ("anchor", "children", "depth", "gone", "main", "named", "noise", "number", "others", "parent", "style", "tag")

    def __init__(self, tag: str, style: str, parent, gone=False, noise=False, named=False, main=False):
        self.tag, self.style, self.parent = tag, style, parent
        self.gone, self.noise, self.named, self.main = gone, noise, named, main
        self.others = False
        self.children: list = []  # nodes, and strings of text
        self.number = 0 if parent is None else None
        self.depth = 0 if parent is None else parent.depth + 1
        #: The element whose path those of its children go on from.
        self.anchor = self if self.depth <= PATH_DEPTH else parent.anchor

    @property
    def id(self) -> int:
        if self.number is None:
            self.number = _hashed(f"{self.parent.anchor.id}/{self.style}")
        return self.number

    def path(self) -> list[int]:
        """Ids from this element up to the root."""
        out, node = [self.id], self.anchor if self.anchor is not self else self.parent
        while node is not None:
            out.append(node.id)
            node = node.parent
        return out


def _hashed(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "replace")) - (1 << 63)


def _named(names: list[str], known: frozenset) -> bool:
    """Whether a name is one of the known, beside parts that tell nothing."""
    for name in names:
        parts = {p for p in re.split(r"[-_\d]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower()) if p}
        if parts & known and parts <= known | PLAIN:
            return True
    return False


TELLING = re.compile(r"class|id|role|hidden|style", re.I)
#: What attributes of a tag say, as a worker remembers it, and how many of them.
CACHE_TAGS = 50_000


def _said(tag: str, attributes: str) -> tuple:
    """(style, unseen, by others, layout, layout within main, roles) of a tag; digits in
    names do not tell styles apart."""
    names, roles, unseen = [], set(), False
    for key, *values in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), "".join(values)
        if key in ("class", "id"):
            names += value.split()
        elif key == "role":
            roles.update(value.lower().split())
        elif key == "hidden":
            unseen = True
        elif key == "aria-hidden":
            unseen = unseen or value.lower() == "true"
        elif key == "style":
            unseen = unseen or bool(UNSEEN.search(value))
    style = tag + "".join("." + x for x in sorted({re.sub(r"\d+", "0", n.lower()) for n in names})) + "".join("@" + x for x in sorted(roles))
    telling = names if tag not in ("html", "body", "main") else []
    layout = telling if tag != "article" else []
    return style, unseen, _named(telling, OTHERS), _named(layout, LAYOUT_NAMES), _named(layout, LAYOUT_NAMES - {"header", "masthead"}), roles


def _element(tag: str, attributes: str, parent: Node, known: dict) -> Node:
    key = (tag, attributes if attributes and TELLING.search(attributes) else "")
    if key not in known:
        if len(known) >= CACHE_TAGS:
            known.clear()
        known[key] = _said(*key)
    style, unseen, others, layout, within_main, roles = known[key]
    # A label is part of a form wherever that is; elsewhere it is text.
    gone = parent.gone or unseen or tag in NEVER or (tag == "label" and parent.noise)
    noise = parent.noise or (tag in NOISE_TAGS and not (tag == "header" and parent.main)) or bool(roles & NOISE_ROLES)
    main = parent.main or tag in MAIN_TAGS or bool(roles & MAIN_ROLES)
    node = Node(tag, style, parent, gone, noise, parent.named or (within_main if parent.main else layout), main)
    node.others = others and not (parent.main and tag in PHRASES)
    return node


def _settled(root: Node) -> Node:
    """``root``, with ``others`` withdrawn from elements that hold an h1 or a main element,
    and from all if they leave the page no text."""
    named, text, stack = [], False, [(root, False)]
    while stack:
        node, under = stack.pop()
        if node.tag == "h1" or node.tag == "main":
            above = node.parent
            while under and above is not None:
                above.others, above = False, above.parent
        under = under or node.others
        if node.others:
            named.append(node)
        for child in node.children:
            if isinstance(child, str):
                text = text or (not under and not child.isspace())
            elif not child.gone:
                stack.append((child, under))
    # Text under a withdrawn name counts, so only a page without any other is read whole.
    if not text and not any(not n.others for n in named):
        for node in named:
            node.others = False
    return root


def parsed(page: str | None) -> Node:
    """The page's tree.  Missing end tags are implied as browsers do for paragraphs, list
    items and table cells; an end tag without an open element is dropped."""
    root = Node("#root", "", None)
    known = worker_cache().setdefault("tags", {})
    text = page or ""
    at, open_node = 0, root
    position = 0
    opened: Counter[str] = Counter()  # open elements by tag, so that no end tag is sought in vain

    def closed(node: Node) -> Node:
        last = open_node
        while last is not node.parent:
            opened[last.tag] -= 1
            last = last.parent
        return last

    while True:
        match = TOKEN.search(text, position)
        if match is None:
            break
        if match.start() > at:
            open_node.children.append(text[at : match.start()])
        position = at = match.end()
        tag = (match[2] or "").lower()
        if not tag:
            continue
        if match[1]:
            node = open_node if opened[tag] else root
            while node is not root and node.tag != tag:
                if node.tag in ("td", "th") and tag not in ("tr", "tbody", "thead", "tfoot", "table"):
                    node = root
                    break
                node = node.parent
            if node is not root:
                open_node = closed(node)
            elif tag == "p":
                open_node.children.append(_element("p", "", open_node, known))
            continue
        if tag in BLOCKS and opened["p"]:
            # An open paragraph ends where a block begins.
            node = open_node
            while node is not root and node.tag != "p" and node.tag not in BLOCKS:
                node = node.parent
            if node.tag == "p":
                open_node = closed(node)
        if tag in CLOSES and any(opened[x] for x in CLOSES[tag]):
            node = open_node
            while node is not root and node.tag not in CLOSES[tag] and node.tag not in SCOPES:
                node = node.parent
            if node.tag in CLOSES[tag]:
                open_node = closed(node)
                if tag == "tr" and open_node.tag == "tr":
                    open_node = closed(open_node)
        node = _element(tag, match[3], open_node, known)
        open_node.children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}[^>]*>", re.I).search(text, position)
            position = at = end.end() if end else len(text)
        elif tag not in VOID and not match[3].rstrip().endswith("/"):
            open_node = node
            opened[tag] += 1
    if at < len(text):
        open_node.children.append(text[at:])
    return _settled(root)


def blocks(root: Node) -> list[tuple[Node, str]]:
    """(element, text) of each block in page order, without elements that are gone."""
    out: list[tuple[Node, str]] = []
    pieces: list[str] = []

    def flush(holder: Node) -> None:
        if pieces:
            text = "".join(pieces)
            text = " ".join((entities.unescape(text) if "&" in text else text).split())
            if text:
                out.append((holder, text))
            pieces.clear()

    stack = [(root, iter(root.children), root)]  # element, children to come, the block that holds its text
    while stack:
        node, rest, holder = stack[-1]
        for child in rest:
            if isinstance(child, str):
                pieces.append(child)
            elif child.tag == "br":
                pieces.append(" ")
            elif child.tag in BLOCKS:
                flush(holder)
                if not (child.gone or child.others):
                    stack.append((child, iter(child.children), child))
                    break
            elif not (child.gone or child.others):
                stack.append((child, iter(child.children), holder))
                break
        else:
            stack.pop()
            if node.tag in BLOCKS:
                flush(holder)
    flush(root)
    return out


def layouts(root: Node) -> Iterator[tuple[Node, str]]:
    """(element, styles of the blocks in it, in order) of the root and every block."""
    stack = [root]
    while stack:
        node = stack.pop()
        if node is root or node.tag in BLOCKS:
            styles: list[str] = []
            for c in node.children:
                if not isinstance(c, str) and c.tag in BLOCKS and not (c.gone or c.others) and not (c.tag in ITEMS and styles and styles[-1] == c.style):
                    styles.append(c.style)
            yield node, ">".join(styles)
        stack += [c for c in node.children if not isinstance(c, str) and not (c.gone or c.others)]


#: Bits of a block's kind.
IS_NOISE, IS_NAMED, IS_MAIN = 1, 2, 4
KINDS = 8


def _lists(rows: list[list[tuple]], kinds: dict[str, pa.DataType]) -> pa.ListArray:
    """An array of structs for each row."""
    flat = [x for row in rows for x in row]
    ends = pa.array([0, *accumulate(map(len, rows))], pa.int32())
    columns = list(zip(*flat, strict=True)) or [()] * len(kinds)
    return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], list(kinds)))


def host_of(url):
    """Lower-case host of a URL column; '' where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, HOST, 1), F.lit("")))


#: What a page is known by in both scans: two hashes of what it holds, so the scans may be
#: split in any way; rows that repeat a page share them, and share its rules.
KEY = ["one", "two"]


def _keyed(pages: DataFrame) -> DataFrame:
    return pages.select(F.xxhash64("url", "html").alias("one"), F.xxhash64(F.lit(1), "html", "url").alias("two"), "page_id", "url", "html")


def _placed(found: list[tuple[Node, str]]) -> dict[int, int]:
    """The place of each different path of a page's blocks."""
    return {i: at for at, i in enumerate(dict.fromkeys(node.id for node, _ in found))}


def outlined(pages: DataFrame) -> DataFrame:
    """one and two (see ``KEY``), host, paths (different ones of blocks, with all above),
    shapes (different pairs of path and layout) and texts (different pairs of path and
    text, as a hash with the size).  Written once."""
    source = _keyed(pages).select(*KEY, host_of(F.col("url")).alias("host"), "html")

    kinds = ({"id": pa.int64(), "up": pa.list_(pa.int64())}, {"id": pa.int64(), "shape": pa.int64()}, {"id": pa.int64(), "hash": pa.int64(), "size": pa.int32()})

    def outline(page: str | None) -> tuple[list, list, list]:
        root = parsed(page)
        found = blocks(root)
        first = {node.id: node for node, _ in reversed(found)}
        texts = dict.fromkeys((node.id, _hashed(text), len(text)) for node, text in found)
        shapes = dict.fromkeys((node.id, _hashed(shape)) for node, shape in layouts(root))
        return [(i, first[i].path()) for i in _placed(found)], list(shapes), list(texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 128):
                part = batch.slice(low, 128)
                found = zip(*map(outline, part.column(3).to_pylist()), strict=True)
                lists = [_lists(rows, kind) for rows, kind in zip(found, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *lists], names=[*KEY, "host", "paths", "shapes", "texts"])

    return stored(source.mapInArrow(run, "one long, two long, host string, paths array<struct<id: long, up: array<long>>>, shapes array<struct<id: long, shape: long>>, texts array<struct<id: long, hash: long, size: int>>"), "outline")


def packed(pages: DataFrame) -> DataFrame:
    """one, two, page_id, url, codes (of each block the place of its path and its kind) and
    texts (of all blocks, a line each, compressed)."""
    source = _keyed(pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            for low in range(0, batch.num_rows, 128):
                part = batch.slice(low, 128)
                codes, texts = [], []
                for page in part.column(4).to_pylist():
                    found = blocks(parsed(page))
                    place = _placed(found)
                    codes.append([place[n.id] * KINDS + IS_NOISE * n.noise + IS_NAMED * n.named + IS_MAIN * n.main for n, _ in found])
                    texts.append(press("\n".join(text for _, text in found).encode("utf-8", "replace")))
                yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(codes, pa.list_(pa.int32())), pa.array(texts, pa.binary())], names=[*KEY, "page_id", "url", "codes", "texts"])

    kinds = dict(source.dtypes)
    return source.mapInArrow(run, f"one long, two long, page_id {kinds['page_id']}, url {kinds['url']}, codes array<int>, texts binary")


def trees(outline: DataFrame) -> DataFrame:
    """host, id, pages, content, freedom, chars, composite of every path with text, on
    hosts of two pages or more: the merged tree of each.

    A page sends each of its layouts and texts once; counts are pre-aggregated, so a host
    with a third of all pages costs what its tree has, not its pages.
    """
    evenness = 1 - F.sum(F.col("n") * F.log("n")) / (F.sum("n") * F.log(F.sum("n")))
    shapes = outline.select("host", F.explode("shapes").alias("s")).groupBy("host", "s.id", "s.shape").agg(F.count("*").alias("n"))
    layout = shapes.groupBy("host", "id").agg(F.when(F.sum("n") > 1, evenness).otherwise(1.0).alias("presentation"))
    paths = outline.select("host", F.explode("paths").alias("p")).groupBy("host", "p.id").agg(F.count("*").alias("pages"), F.any_value("p.up").alias("up"))  # a path has one way up
    salted = layout.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    above = paths.select("host", "id", F.explode("up").alias("above"), F.pmod("id", F.lit(SALTS)).cast("int").alias("salt"))
    freedom = above.join(salted.withColumnRenamed("id", "above"), ["host", "above", "salt"]).groupBy("host", "id").agg(F.max("presentation").alias("freedom"))
    counted = outline.select("host", F.explode("texts").alias("t")).groupBy("host", "t.id", "t.hash").agg(F.count("*").alias("n"), F.max("t.size").alias("size"))
    spread = counted.groupBy("host", "id").agg(F.sum("n").alias("texts"), F.sum(F.col("n") * F.log("n")).alias("nlogn"), F.sum(F.col("n") * F.col("size")).alias("chars"))
    content = F.when(F.col("pages") > 1, F.greatest(F.lit(0.0), 1 - F.col("nlogn") / (F.col("texts") * F.log("pages")))).otherwise(1.0)
    grown = outline.groupBy("host").agg(F.count("*").alias("of")).where("of > 1")
    joined = paths.drop("up").join(grown, "host", "left_semi").join(freedom, ["host", "id"]).join(spread, ["host", "id"])
    measured = joined.select("host", "id", "pages", content.alias("content"), "freedom", "chars")
    return measured.withColumn("composite", F.col("content") * (1 - LAYOUT + LAYOUT * F.col("freedom")))


def ruled(forest: DataFrame) -> DataFrame:
    """host, id, pages, importance: composites on each host's scale (1 is the mean over
    its text, in which important text counts more), with those of the same path on other
    hosts, which count as ``ELSEWHERE`` pages at most.  A host without any important text
    has no rows."""
    several = forest.where("pages > 1")
    weight = F.col("chars") * F.col("composite")
    scale = several.groupBy("host").agg(F.sum(weight * F.col("composite")).alias("a"), F.sum(weight).alias("b")).where("b > 0").select("host", (F.col("a") / F.col("b")).alias("scale"))
    own = forest.join(scale, "host").select("host", "id", "pages", F.least(F.lit(1.0), F.col("composite") / F.col("scale")).alias("own"))
    times = F.when(F.col("pages") > 1, F.col("pages")).otherwise(0)
    everywhere = own.groupBy("id").agg(F.sum(times).alias("all_pages"), F.sum(times * F.col("own")).alias("all_sum"))
    salted = everywhere.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    both = own.withColumn("salt", F.pmod(F.xxhash64("host"), F.lit(SALTS)).cast("int")).join(salted, ["id", "salt"])
    others = F.col("all_pages") - times
    heard = F.least(F.lit(ELSEWHERE), others)
    elsewhere = F.when(others > 0, (F.col("all_sum") - times * F.col("own")) / others).otherwise(0.0)
    return both.select("host", "id", (F.col("pages") + heard).alias("pages"), ((F.col("pages") * F.col("own") + heard * elsewhere) / (F.col("pages") + heard)).alias("importance"))


def _kept(statistics: bool) -> Column:
    """Whether each block stays, of a row with ``codes`` and ``rules`` (one for each path)."""
    has = lambda code, bit: code.bitwiseAND(F.lit(bit)) != 0

    def by_tree(code: Column) -> Column:
        rule = F.element_at("rules", F.shiftright(code, 3) + 1)
        square = rule["pages"] * rule["pages"]
        weight = MOST_WEIGHT * square / (square + HALF_PAGES * HALF_PAGES) if statistics else F.lit(0.0)
        prior = F.when(has(code, IS_NOISE), NOISE).when(has(code, IS_MAIN), MAIN).otherwise(UNKNOWN)
        return (1 - weight) * prior + weight * rule["importance"] >= THRESHOLD

    plain = lambda code: ~has(code, IS_NOISE) & ~has(code, IS_NAMED)
    some = lambda kept: F.when(F.exists(kept, lambda k: k), kept)
    tree = F.when(F.col("rules").isNotNull(), F.transform("codes", by_tree))
    main = F.transform("codes", lambda code: plain(code) & has(code, IS_MAIN))
    return F.coalesce(some(tree), some(main), F.transform("codes", plain))


def extracted(pages: DataFrame, statistics: bool = True) -> DataFrame:
    """page_id, url, text and n_chars of every page.

    Null and empty pages have an empty text; pages without a host in their url are one
    host; repeated rows count as pages and each give a row; very long pages are read whole.
    An empty table gives no row.  Without ``statistics`` the trees' importances weigh
    nothing, which shows what tags alone would keep.
    """
    outline = outlined(pages)
    asked = outline.select(*KEY, "host", F.posexplode("paths").alias("at", "p")).select(*KEY, "host", "at", "p.id")
    found = spread_join(asked, stored(ruled(trees(outline)), "rules"), ["host", "id"], "inner")
    found = found.groupBy(*KEY).agg(F.sort_array(F.collect_set(F.struct("at", "pages", "importance"))).alias("rules"))  # a page's own paths
    judged = spread_join(packed(pages), found, KEY, sizes=outline).select("page_id", "url", _kept(statistics).alias("kept"), "texts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = [zstandard.decompress(x).decode().split("\n") if kept else [] for kept, x in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            texts = ["\n".join(x for x, stays in zip(part, kept, strict=True) if stays) for part, kept in zip(lines, batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = dict(pages.dtypes)
    return judged.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))
