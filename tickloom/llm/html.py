"""Main text of web pages by wrapper induction."""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settled

#: Kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
SKIPPED = frozenset("head script style noscript template iframe object svg math canvas audio video nav footer aside form button select textarea input dialog menu title".split())
CLOSES_P = frozenset("address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
CLOSES = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}
#: Words of class, id or role that name furniture, and content.
FURNITURE = frozenset("ad ads adv advert adverts advertisement advertisements advertising banner sponsor sponsored promo promotion promoted sidebar menu nav navbar navigation breadcrumb breadcrumbs footer cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social comment comments commentlist disqus replies respond related recommended recommendations widget toolbar pagination pager skip contentinfo search complementary".split())
HEADERS = frozenset("header masthead topbar".split())
CONTENT = frozenset("content article post entry story".split())
#: Of these, those that name something beside the article even where it is one itself; the others may name a frame around the main article.
BESIDE = frozenset("ad ads advert adverts advertisement advertisements comment comments commentlist disqus replies respond related recommended recommendations promo promotion promoted sponsor sponsored".split())
FRAMES = frozenset("html body main".split())
#: A slot is template where this share of its pages have a value that pages of other content have as well, in so many pages of a host at least; a text where this share of a host's pages have it in one slot.
REPEATED, PAGES, CONSTANT = 0.5, 4, 0.8
#: Children of a template's node by position (others share one slot), and levels of a template (deeper nodes belong to the slot above them).
NODES, DEPTH = 256, 48
#: Templates merged at once, templates a task holds, and counts of texts that a task holds before it passes them on.
FAN, HELD, COUNTS = 64, 512, 200_000
#: Templates and wrappers up to so many bytes in all are broadcast to the pages; beyond it they are joined by a shuffle.
BROADCAST = 32 << 20

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*'|[\"'])*+)>?|<[!?][^>]*>?", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")


class Node:
    """A block element: its key, the words that name it, and its items in order: child nodes, and lists of pieces of text."""

    __slots__ = ("tag", "key", "words", "off", "frame", "items")

    def __init__(self, tag: str, key: str, words: frozenset, off: bool):
        self.tag, self.key, self.words, self.off, self.items = tag, key, words, off, []
        self.frame = tag in FRAMES  # or it has the main article within

    def nodes(self) -> list:
        return [x for x in self.items if isinstance(x, Node)]

    def texts(self) -> list[str]:
        return [t for x in self.items if not isinstance(x, Node) and (t := _plain("".join(x)))]


def _named(tag: str, attributes: str) -> tuple[str, frozenset, bool]:
    """Key, words and whether the element is hidden. Names of class, id and role are words, and so is what a name with hyphens ends in: share-price is a price."""
    names, off = [], False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id", "role"):
            names += value.lower().split()
        elif name == "style":
            off |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value.lower()))
        else:
            off |= name == "hidden" or name == "aria-hidden" and value.lower() == "true"
    key = ".".join([tag, *sorted({re.sub(r"\d+", "0", x) for x in names})])
    return key, frozenset(w for x in names for w in (x, re.split(r"[-_:]+", x)[-1])), off


def _after_inline(page: str, at: int, tag: str, block: str) -> int:
    """Where an inline element that is left out ends: after its own closing tag, elements of its kind within it counted, or before its block's."""
    depth = 1
    while m := _TOKEN.search(page, at):
        at = m.end()
        name = (m[2] or "").lower()
        if name == tag:
            depth += -1 if m[1] else 1
        elif m[1] and name == block:
            return m.start()
        if not depth:
            return at
    return len(page)


def parse(page: str) -> Node:
    """The tree of a page's block elements; inline elements are part of their block's text. Truncated markup ends what is open."""
    root = Node("", "", frozenset(), False)
    stack, known = [root], {}
    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            break
        if m.start() > at:
            _put(stack[-1], page[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "p" or tag not in INLINE:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        del stack[k:]
                        break
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?![a-zA-Z0-9])[^>]*>?", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if tag in VOID:
            _put(stack[-1], " ")
            continue
        named = known.get((tag, m[3])) or known.setdefault((tag, m[3]), _named(tag, m[3]))
        if tag in INLINE:
            if named[2] or named[1] & FURNITURE:
                at = _after_inline(page, at, tag, stack[-1].tag)
            continue
        if tag in CLOSES_P and stack[-1].tag == "p":
            stack.pop()
        if tag in CLOSES:
            mine, stop = CLOSES[tag]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in stop:
                    break
                if stack[k].tag in mine.split():
                    del stack[k:]
                    break
        node = Node(tag, *named)
        if tag in ("article", "main") and not node.off and not node.words & BESIDE:
            node.frame = True
            for above in reversed(stack):
                if above.frame or above.tag in SKIPPED or above.words & BESIDE:
                    break
                above.frame = True
        stack[-1].items.append(node)
        stack.append(node)
    if at < n:
        _put(stack[-1], page[at:])
    return root


def _put(node: Node, text: str) -> None:
    if node.items and not isinstance(node.items[-1], Node):
        node.items[-1].append(text)
    else:
        node.items.append([text])


def _plain(text: str) -> str:
    return " ".join(entities.unescape(text).split())


def _hash(text: str) -> int:
    return xxhash.xxh32_intdigest(text)


def fold(node: Node, level: int = 0) -> list:
    """A tree of slots [key, children, nodes]: neighbours of one key are a list of one kind and fold into one slot.

    Where a node has over NODES children even so, children of one key fold wherever they stand. Nodes below DEPTH levels
    belong to the slot at that level.
    """
    if level >= DEPTH:
        every, left = [], [node]
        while left:
            every.append(x := left.pop())
            left += reversed(x.nodes())
        return [node.key, [], every]
    slots: list = []
    by_key: dict = {}
    own = node.nodes()
    scattered = len(own) > NODES
    for child in own:
        one = fold(child, level + 1)
        if scattered and child.key in by_key:
            _join(by_key[child.key], one)
        elif not scattered and slots and slots[-1][0] == child.key:
            _join(slots[-1], one)
        else:
            slots.append(one)
            by_key[child.key] = one
    return [node.key, slots, [node]]


def _join(a: list, b: list) -> None:
    """Adds the folded node b to its neighbour a."""
    for i, j in aligned(a, b):
        if i is None:
            a[1].append(j)
        elif j is not None:
            _join(i, j)
    a[2] += b[2]


def aligned(a: list, b: list) -> list[tuple]:
    """Pairs of the children of a and b in order, as the largest simple tree matching has them; None stands for no partner."""
    left, right = a[1], b[1]
    if [x[0] for x in left] == [x[0] for x in right]:
        return list(zip(left, right))
    best = [[0] * (len(right) + 1) for _ in range(len(left) + 1)]
    match = {}
    for i, x in enumerate(left):
        for j, y in enumerate(right):
            m = match[i, j] = matching(x, y)
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + m if m else 0)
    pairs: list[tuple] = []
    i, j = len(left), len(right)
    while i or j:
        if i and j and match[i - 1, j - 1] and best[i][j] == best[i - 1][j - 1] + match[i - 1, j - 1]:
            i, j = i - 1, j - 1
            pairs.append((left[i], right[j]))
        elif i and best[i][j] == best[i - 1][j]:
            i -= 1
            pairs.append((left[i], None))
        else:
            j -= 1
            pairs.append((None, right[j]))
    return pairs[::-1]


def matching(a: list, b: list) -> int:
    """Nodes of the largest simple tree matching of two trees: roots match by key, children in order."""
    if a[0] != b[0]:
        return 0
    row = [0] * (len(b[1]) + 1)
    for x in a[1]:
        new = [0]
        for j, y in enumerate(b[1]):
            m = matching(x, y)
            new.append(max(row[j + 1], new[j], row[j] + m if m else 0))
        row = new
    return 1 + row[-1]


def counted(tree: list) -> list:
    """A template of one page: [key, children, pages]."""
    return [tree[0], [counted(c) for c in tree[1]], 1]


def merged(a: list, b: list) -> list:
    """The template of the pages of two templates whose roots have one key. The rarest of over NODES children lose their own slot; see places()."""
    nodes = [x if y is None else y if x is None else merged(x, y) for x, y in aligned(a, b)]
    if len(nodes) > NODES:
        least = sorted((x[2] for x in nodes), reverse=True)[NODES - 1]
        nodes = [x for x in nodes if x[2] >= least][:NODES]
    return [a[0], nodes, a[2] + b[2]]


def places(template: list | None, tree: list, path: str = "") -> list[str]:
    """The path of the template's slot for each slot of a folded page, parents first. Nodes without a partner share one slot, *, with all that is in them."""
    out = [path]
    if template is None:
        return out + [x for c in tree[1] for x in places(None, c, path)]
    number = {id(x): k for k, x in enumerate(template[1])}
    partner = {id(y): x for x, y in aligned(template, tree) if x is not None and y is not None}
    for c in tree[1]:
        x = partner.get(id(c))
        out += places(x, c, f"{path}/*" if x is None else f"{path}/{number[id(x)]}")
    return out


def slots(tree: list) -> list[list[Node]]:
    """The nodes of each slot of a folded page, parents first."""
    return [tree[2], *(t for c in tree[1] for t in slots(c))]


def shape(tree: list) -> str:
    return tree[0] + "(" + ",".join(map(shape, tree[1])) + ")"


def _is_furniture(node: Node, inside: bool) -> bool:
    """By names and kinds of elements alone. inside: within the article, whose own header is content."""
    if node.off or node.tag in SKIPPED:
        return True
    if node.frame:
        return False
    if node.words & FURNITURE:
        return True
    return not inside and (node.tag == "header" or bool(node.words & HEADERS))


def regions(root: Node) -> list[Node]:
    """The outermost articles of a page, else its main element, else the outermost of a class, id or role of content, else the page."""

    def outermost(is_one) -> list[Node]:
        found, left = [], [root]
        while left:
            x = left.pop()
            if x is not root and is_one(x):
                found.append(x)
            else:
                left += [c for c in reversed(x.nodes()) if not _is_furniture(c, False)]
        return found

    for is_one in (lambda c: c.tag == "article" or "article" in c.words, lambda c: c.tag == "main" or "main" in c.words, lambda c: bool(c.words & CONTENT)):
        if found := outermost(is_one):
            return found
    return [root]


def blocks(root: Node, wrapper: dict | None = None, slot_paths: list[str] | None = None, tree: list | None = None, names: bool = True) -> list[str]:
    """The texts of a page's content blocks in order.

    With a wrapper these are all blocks but those in its template slots and its constant texts; without one, those of the
    page's regions(). With `names`, elements that are furniture by name or kind are left out as well: only by these can a
    reader's comment, which varies as an article does, be told.
    """
    template: set[int] = set()
    fixed: dict[int, list] = {}
    if wrapper:
        for path, own in zip(slot_paths, slots(tree)):
            if path in wrapper["slots"]:
                template.update(map(id, own))
            elif path in wrapper["texts"]:
                fixed |= dict.fromkeys(map(id, own), wrapper["texts"][path])
    out: list[str] = []
    left: list[tuple] = [(r, None, not wrapper) for r in ([root] if wrapper else regions(root)[::-1])]
    while left:
        node, text, inside = left.pop()
        if text is not None:
            if (plain := _plain("".join(text))) and not (id(node) in fixed and _hash(plain) in fixed[id(node)]):
                out.append(plain)
            continue
        inside |= node.tag in ("article", "main")
        for item in reversed(node.items):
            if not isinstance(item, Node):
                if id(node) not in template:
                    left.append((node, item, inside))
            elif not names or not _is_furniture(item, inside):
                left.append((item, None, inside))
    return out


def host(url):
    """Column of the host of a URL in small letters, without user and port; empty where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def templates(pages: DataFrame) -> DataFrame:
    """Templates (host, pages, template) of `pages` (url, html), from all pages of each host, furniture and all.

    A task merges the pages of one shape that it reads; what the tasks have is merged about FAN templates of a host at
    once, until one is left for each host. So a host with most of the pages is spread over all tasks, and no group grows
    with it.
    """

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}

        def out() -> pd.DataFrame:
            rows = [(h, s, t[2], json.dumps(t)) for (h, s), t in held.items()]
            held.clear()
            return pd.DataFrame(rows, columns=["host", "shape", "pages", "template"])

        for b in batches:
            for h, page in zip(b["host"], b["html"]):
                tree = fold(parse(page or ""))
                key = h, xxhash.xxh64_hexdigest(shape(tree))
                one = counted(tree)
                held[key] = merged(held[key], one) if key in held else one
            if len(held) > HELD:
                yield out()
        if held:
            yield out()

    kinds = "host string, shape string, pages long, template string"

    def merge(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(["pages", "shape", "template"], ascending=[False, True, True])
        all_of = None
        for t in b["template"]:
            one = json.loads(t)
            all_of = one if all_of is None else merged(all_of, one)
        return pd.DataFrame([(b["host"].iloc[0], b["shape"].iloc[0], all_of[2], json.dumps(all_of))], columns=["host", "shape", "pages", "template"])

    found = pages.select(host(F.col("url")).alias("host"), "html").mapInPandas(gather, kinds)
    found = settled(found)
    while True:
        groups = found.groupBy("host").agg(F.ceil(F.count("*") / F.lit(FAN)).alias("groups"))
        most = groups.agg(F.max("groups")).first()[0] or 0
        salted = found.join(groups, "host").withColumn("salt", F.pmod(F.xxhash64("shape", "template"), F.col("groups"))).drop("groups")
        found = settled(salted.groupBy("host", "salt").applyInPandas(lambda b: merge(b), kinds))
        if most <= 1:
            return found.select("host", "pages", "template")


def induce(pages: DataFrame) -> DataFrame:
    """Wrappers (host, template, slots, texts) of the hosts of PAGES pages or more; see REPEATED and CONSTANT.

    All pages of a host are laid over its template, and the values of each slot, and each text in it, are counted. A value
    is repeated where pages of different content have it, content being told by a page's longest text, so that copies of a
    page don't make its article template. `slots` are the paths of template slots, `texts` paths with a text's hash.
    """
    made = templates(pages).where(F.col("pages") >= PAGES)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict = {}
        seen: dict = {}

        def out() -> pd.DataFrame:
            rows = [(*k, *v) for k, v in seen.items()]
            seen.clear()
            return pd.DataFrame(rows, columns=["host", "path", "whole", "text", "n", "low", "high"])

        for b in batches:
            for h, page, template in zip(b["host"], b["html"], b["template"]):
                tree = fold(parse(page or ""))
                by_path: dict[str, list] = {}
                for path, own in zip(_placed(known, h, template, tree), slots(tree)):
                    if texts := [t for x in own for t in x.texts()]:
                        by_path.setdefault(path, []).extend(texts)
                longest = _hash(max((t for x in by_path.values() for t in x), key=len, default=""))
                values = {(h, path, True, _hash("\0".join(own))) for path, own in by_path.items()}
                for one in values | {(h, path, False, _hash(t)) for path, own in by_path.items() for t in own}:
                    n, low, high = seen.get(one, (0, longest, longest))
                    seen[one] = n + 1, min(low, longest), max(high, longest)
                if len(seen) > COUNTS:
                    yield out()
        if seen:
            yield out()

    rows = pages.select(host(F.col("url")).alias("host"), "html").join(_small(made.select("host", "template"), "template"), "host")
    counts = rows.mapInPandas(count, "host string, path string, whole boolean, text long, n long, low long, high long")
    counts = counts.groupBy("host", "path", "whole", "text").agg(F.sum("n").alias("n"), (F.min("low") < F.max("high")).alias("again"))
    counts = settled(counts.where("again or whole"))
    of_slots = counts.where("whole").groupBy("host", "path").agg(F.sum("n").alias("on"), F.sum(F.when(F.col("again"), F.col("n")).otherwise(0)).alias("again"))
    of_slots = of_slots.where((F.col("on") >= PAGES) & (F.col("again") >= REPEATED * F.col("on"))).groupBy("host").agg(F.array_sort(F.collect_list("path")).alias("slots"))
    texts = counts.where("again and not whole").join(_small(made.select("host", "pages"), "host"), "host").where(F.col("n") >= CONSTANT * F.col("pages"))
    texts = texts.groupBy("host").agg(F.array_sort(F.collect_list(F.concat_ws(" ", "path", "text"))).alias("texts"))
    none = F.array().cast("array<string>")
    return made.join(of_slots, "host", "left").join(texts, "host", "left").select("host", "template", F.coalesce("slots", none).alias("slots"), F.coalesce("texts", none).alias("texts"))


def _placed(known: dict, h: str, template: str, tree: list) -> list[str]:
    """places(), kept for HELD shapes of pages."""
    key = h, shape(tree)
    if key not in known:
        if len(known) > HELD:
            known.clear()
        known[key] = places(json.loads(template), tree)
    return known[key]


def _small(of: DataFrame, column: str) -> DataFrame:
    """`of` (host, `column`; written before), to be broadcast where it is small."""
    size = of.agg(F.coalesce(F.sum(F.length(F.col(column).cast("string")) + F.length("host")), F.lit(0))).first()[0]
    return F.broadcast(of) if size <= BROADCAST else of


def extract(pages: DataFrame, names: bool = True) -> DataFrame:
    """One row for each row of `pages` (page_id, url, html): page_id, url, text.

    The text of the content blocks in page order, joined by one space: see blocks() and regions(). Character references
    are decoded, white space within a block is one space. Null and empty pages have an empty text. Pages without a host
    share one wrapper. Repeated rows have their text again. Hosts of fewer than PAGES pages have no wrapper.
    """
    made = settled(induce(pages).withColumn("wrapper", F.to_json(F.struct("template", "slots", "texts"))).select("host", "wrapper"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict = {}
        paths: dict = {}
        for b in batches:
            texts = []
            for h, page, w in zip(b["host"], b["html"], b["wrapper"]):
                root = parse(page or "")
                if not w:
                    texts.append(" ".join(blocks(root, names=names)))
                    continue
                if w not in known:
                    if len(known) > HELD:
                        known.clear()
                    of = json.loads(w)
                    fixed: dict = {}
                    for x in of["texts"]:
                        path, text = x.rsplit(" ", 1)
                        fixed.setdefault(path, set()).add(int(text))
                    known[w] = {"template": of["template"], "slots": set(of["slots"]), "texts": fixed}
                of, tree = known[w], fold(root)
                texts.append(" ".join(blocks(root, of, _placed(paths, h, of["template"], tree), tree, names)))
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": texts})

    rows = pages.select(F.col("page_id").cast("string").alias("page_id"), "url", "html", host(F.col("url")).alias("host")).join(_small(made, "wrapper"), "host", "left")
    out = rows.select("page_id", "url", "html", "host", "wrapper").mapInPandas(run, "page_id string, url string, text string")
    return out.withColumn("page_id", F.col("page_id").cast(pages.schema["page_id"].dataType))
