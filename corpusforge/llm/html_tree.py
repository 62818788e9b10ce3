"""Main text of web pages by site style trees (operator 7).

Pages are parsed to trees of block elements. Trees of one host are merged on
the path of tags and classes; a merged node knows on how many pages it occurs,
with which sequences of children (presentation) and which texts (content). Its
presentation and content importance are the entropies of these two, as shares
of the greatest possible; a node that looks and reads the same on most pages of
its host has low importance in both, and its branch is removed from each page.

Copies of a page on one host count as one page, so that a page does not look
like boilerplate because it is stored often. The root, ``html`` and ``body`` are
never removed, and a page of low-importance branches only keeps all of them.

Importance alone cannot tell a page's own advert or menu from its article, as
both differ from page to page. So importance has a prior from the page's
semantics: elements whose tag, role or class names a menu, header, footer,
sidebar, notice, advert, form, script, style or reader comments have
importance 0; what an ``article`` or ``main`` holds besides has importance 1,
and if a page has such an element the rest of the page has 0. The entropies
decide for pages without one, and inside an article for elements whose class
only begins with a furniture word and goes on with another (``social-history``).
If the only articles of a page stand in furniture that just a compound class
(``top-banner-wrap``) or a ``form`` tells, these wrappers count as plain elements.

Counts are merged inside a task and then by Spark's aggregates, so a host with
many pages is never gathered. Low-importance paths of a host go to its pages by
a join; the list's size is checked before it is sent to every executor.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge.llm.common import cut, join_checked, ready
from corpusforge.llm.urls import host_of

FLUSH = 100_000         # merged nodes a task holds before it hands them on

#: HTML's element kinds, and the words that name page furniture.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template iframe textarea title xmp noembed noframes".split())
BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure "
            "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre "
            "section select summary table tbody td tfoot th thead tr ul".split())
FURNITURE_TAGS = set("nav footer aside form head menu button select dialog svg object canvas audio video map".split()) | RAW
FURNITURE_ROLES = set("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar".split())
FURNITURE = set("ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments "
                "consent cookie cookies discussion disqus footer gdpr header masthead menu menus modal nav navbar "
                "navigation newsletter notice notices overlay popup promo promotion related replies respond share "
                "sharing sidebar skip social sponsor sponsored subscribe subscription toolbar widget widgets".split())
#: First parts of a compound class that name a state of the page, not the element's kind.
STATES = set("has hide is no not show with without".split())
#: Parts that say nothing of what an element holds, and those of a header that is the site's.
PLAIN = set("area bar block body box button buttons container content form group icon icons inline inner item items link "
            "links list outer panel post posts row section signup slot stories top unit wrap wrapper zone".split())
SITE = set("app global main menu nav navigation site top".split())
#: A start tag of the key closes an open element of the value.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}, "optgroup": {"option", "optgroup"}}
SCOPE = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"},
         "th": {"table"}, "option": {"select"}, "optgroup": {"select"}}

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)"
                 r"((?:[^>=]++|=\s*(?:\"[^\"]*\"|'[^']*'|))*+)(?:>|\Z)", re.S)
ATTR = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)


#: How far an element is furniture: not at all; as the host's entropies say;
#: yes, unless it holds the page's only articles; yes.
PLAIN_KIND, DOUBTFUL, WRAPPING, CERTAIN = range(4)


class Node:
    """An element of the page's block tree. ``parts``: text and child nodes."""

    __slots__ = ("tag", "path", "kind", "parts", "names")

    def __init__(self, tag: str, path: int, kind: int = PLAIN_KIND, names: str = ""):
        self.tag, self.path, self.kind, self.names, self.parts = tag, path, kind, names, []

    @property
    def furniture(self) -> bool:
        return self.kind >= WRAPPING


def _word_kind(word: str, in_article: bool) -> int:
    if word in FURNITURE:
        return CERTAIN
    first, *rest = re.split(r"[-_]+", word)
    if not rest or first in STATES:
        return PLAIN_KIND
    last = rest[-1]
    if not in_article:
        return WRAPPING if first in FURNITURE or last in FURNITURE else PLAIN_KIND
    if last in ("header", "masthead"):      # an article's sections have headers of their own
        return CERTAIN if first in SITE or first in FURNITURE else PLAIN_KIND
    if last in FURNITURE:
        return CERTAIN
    if first in FURNITURE:
        return CERTAIN if all(x in PLAIN or x in FURNITURE for x in rest) else DOUBTFUL
    return PLAIN_KIND


def _furniture(tag: str, attrs: str, in_article: bool) -> tuple[int, str]:
    if tag == "form":
        return WRAPPING, ""
    if tag in FURNITURE_TAGS or (tag == "header" and not in_article):
        return CERTAIN, ""
    kind, names = PLAIN_KIND, ""
    for m in ATTR.finditer(attrs) if attrs else ():
        value = (m[2] or m[3] or m[4] or "").lower()
        if m[1].lower() == "role":
            if value in FURNITURE_ROLES:
                return CERTAIN, value
            continue
        names += " " + value
        if tag not in ("html", "body", "article", "main", "h1"):
            kind = max([kind, *(_word_kind(x, in_article) for x in value.split())])
            if kind == CERTAIN:
                break
    return kind, names


class _Stack:
    """The open elements, and where those of each tag stand: finding the
    nearest one of a tag does not walk the stack."""

    def __init__(self, root: Node):
        self.nodes, self.at, self.blocks = [root], {}, []

    def push(self, node: Node) -> None:
        self.at.setdefault(node.tag, []).append(len(self.nodes))
        if node.tag in BLOCK:
            self.blocks.append(node.tag)
        self.nodes.append(node)

    def nearest(self, tags) -> int:
        """Place of the innermost open element of these tags, 0 if none."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)

    def close(self, k: int) -> None:
        while len(self.nodes) > k:
            node = self.nodes.pop()
            self.at[node.tag].pop()
            if node.tag in BLOCK:
                self.blocks.pop()

    def in_article(self) -> bool:
        return bool(self.at.get("article") or self.at.get("main"))


def parse(page: str) -> Node:
    """Block tree of a page. Any input gives a tree, in time about linear in its
    length: unclosed elements end with their container, stray end tags are
    ignored, inline tags vanish."""
    root = Node("", 0)
    stack = _Stack(root)
    at, n = 0, len(page)

    def text(s: str) -> None:
        if s:
            stack.nodes[-1].parts.append(s)

    while at < n:
        m = TAG.search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at:m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if tag == "br":
            text(" ")
        if m[1]:
            if k := stack.nearest((tag,)):
                stack.close(k)
            continue
        if tag == "br":
            continue
        if tag == "body" and (k := stack.nearest(("head",))):   # a head that was not closed ends here
            stack.close(k)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(page, at)
            at = n if not end else page.find(">", end.end() - 1) + 1 or n
            continue
        kind, names = _furniture(tag, m[3], stack.in_article())
        if tag not in BLOCK and kind < WRAPPING:
            continue
        if tag in BLOCK and stack.blocks and stack.blocks[-1] == "p":   # a block ends an open paragraph
            stack.close(stack.nearest(("p",)))
        if tag in CLOSES and (k := stack.nearest(CLOSES[tag])) > stack.nearest(SCOPE[tag]):
            stack.close(k)
        node = Node(tag, hash_of(f"{stack.nodes[-1].path}>{tag}{names}"), kind, names)
        stack.nodes[-1].parts.append(node)
        if tag not in VOID and not (m[3].endswith("/") and tag not in BLOCK):
            stack.push(node)
    _open_wrappers(root)
    return root


def hash_of(s: str) -> int:
    from xxhash import xxh64_intdigest
    return xxh64_intdigest(s.encode("utf-8", "surrogatepass")) - (1 << 63)


def _has_article(root: Node) -> bool:
    todo = [root]
    while todo:
        node = todo.pop()
        if node.tag in ("article", "main") and not node.furniture:
            return True
        todo += [x for x in node.parts if isinstance(x, Node) and not x.furniture]
    return False


def _open_wrappers(root: Node) -> None:
    """If all articles of a page stand in furniture, wrappers around them that
    are furniture by a compound class or as a form become plain elements.
    Articles that are themselves comments, teasers or the like do not count."""
    if _has_article(root):
        return
    todo: list = [(root, None)]
    while todo:
        node, above = todo.pop()
        if node.tag in ("article", "main") and not FURNITURE & set(node.names.split()):
            while above and above[0].kind == WRAPPING:
                above[0].kind = PLAIN_KIND
                above = above[1]
        if node.kind == CERTAIN:
            continue
        if node.kind == WRAPPING:
            above = (node, above)
        todo += [(x, above) for x in node.parts if isinstance(x, Node)]


def main_text(root: Node, low: frozenset = frozenset()) -> str:
    """Blocks of the important branches, in page order, joined by newlines. If
    nothing is left without the branches ``low``, they stay. In an article
    only doubtful elements can be low branches."""
    only = _has_article(root)
    blocks = _blocks(root, low, only)
    return "\n".join(blocks or (_blocks(root, frozenset(), only) if low else ()))


def _blocks(root: Node, low: frozenset, only: bool) -> list[str]:
    blocks, run = [], []

    def flush():
        if run:
            s = " ".join(entities.unescape("".join(run)).split())
            if s:
                blocks.append(s)
            run.clear()

    todo: list = [(root, not only)]
    while todo:         # an explicit stack, as trees may be deep
        x, inside = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            if inside:
                run.append(x)
        elif not x.furniture:
            mine = only and x.tag in ("article", "main")
            if (not only or x.kind == DOUBTFUL) and x.path in low and x.tag not in ("", "html", "body"):
                flush()
                continue
            flush()
            todo.append((None, inside))
            todo += [(p, inside or mine) for p in reversed(x.parts)]
        else:
            if x.tag in BLOCK:
                flush()
    flush()
    return blocks


def style_rows(root: Node):
    """``(path, presentation, content)`` of every block element of a page."""
    out: list[tuple[int, int, int]] = []
    done: dict[int, int] = {}
    todo = [(root, False)]
    while todo:
        node, ready_ = todo.pop()
        kids = [p for p in node.parts if isinstance(p, Node)]
        if not ready_:
            todo.append((node, True))
            todo += [(k, False) for k in kids]
            continue
        body = "\x00".join(str(done[id(p)]) if isinstance(p, Node) else " ".join(p.split()) for p in node.parts)
        done[id(node)] = content = hash_of(body)
        out.append((node.path, hash_of(">".join(k.tag + k.names for k in kids)), content))
    return out


def _merge(batches):
    """Pages -> merged nodes of each host: (host, path, style, content, copies,
    n); nodes of pages with as many copies are merged."""
    seen: Counter = Counter()

    def rows():
        host, path, style, content, copies = zip(*seen)
        out = pa.RecordBatch.from_arrays(
            [pa.array(host, pa.string()), pa.array(path, pa.int64()), pa.array(style, pa.int64()),
             pa.array(content, pa.int64()), pa.array(copies, pa.int64()), pa.array(list(seen.values()), pa.int64())],
            names=["host", "path", "style", "content", "copies", "n"])
        seen.clear()
        return out

    for b in batches:
        for host, page, copies in zip(*(x.to_pylist() for x in b.columns)):
            # a path counts once a page, with all that stands there
            at: dict[int, list[tuple[int, int]]] = {}
            for path, style, content in style_rows(parse(page or "")):
                at.setdefault(path, []).append((style, content))
            for path, both in at.items():
                s, c = both[0] if len(both) == 1 else (hash_of(repr([x[0] for x in both])), hash_of(repr([x[1] for x in both])))
                seen[host, path, s, c, copies] += 1
            if len(seen) >= FLUSH:
                yield rows()
    if seen:
        yield rows()


def low_importance(pages: DataFrame, least_pages: int = 5, least: float = 0.3) -> DataFrame:
    """``pages``: ``(host, html)``. ``(host, low array<long>)``: the paths whose
    presentation and content importance are both under ``least``, on hosts
    where they occur on ``least_pages`` different pages or more."""
    html = F.coalesce("html", F.lit(""))
    pages = pages.select("host", "html", F.xxhash64(html).alias("page"), F.octet_length(html).alias("size"))
    # only pages with copies are listed; all copies of a page say the same, so n / copies is whole
    copies = cut(pages.groupBy("host", "page", "size").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1"))
    size = copies.agg(F.sum(2 * F.length("host") + 96)).first()[0] or 0
    pages = join_checked(pages, copies, ["host", "page", "size"], "left", size)
    nodes = cut(pages.select("host", "html", F.coalesce("copies", F.lit(1)).cast("long").alias("copies"))
                .mapInArrow(_merge, "host string, path long, style long, content long, copies long, n long")
                .groupBy("host", "path", "style", "content", "copies").agg(F.sum("n").alias("n"))
                .groupBy("host", "path", "style", "content").agg(F.sum(F.ceil(F.col("n") / F.col("copies"))).alias("n")))
    scored = None
    for what in ("style", "content"):
        one = nodes.groupBy("host", "path", what).agg(F.sum("n").alias("n"))
        one = one.groupBy("host", "path").agg(
            F.sum("n").alias("m"), F.sum(F.col("n") * F.log(F.col("n").cast("double"))).alias("x"))
        one = one.select("host", "path", "m", F.when(F.col("m") > 1, F.round(
            1 - F.col("x") / (F.col("m") * F.log(F.col("m").cast("double"))), 9)).otherwise(1.0).alias(what))
        scored = one if scored is None else scored.join(one.drop("m"), ["host", "path"])
    low = scored.where((F.col("m") >= least_pages) & (F.greatest("style", "content") < least))
    return low.groupBy("host").agg(F.collect_list("path").alias("low"))


def extract(df: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """One row per row of ``df``: ``(id_col, url_col, text, n_chars)``.

    Blocks of the main text in page order, joined by newlines; character
    references are decoded and white space inside a block becomes one space.
    Null, empty and text-free pages have empty text. A null url has the empty
    host. Copies count as one page of their host and give equal rows, and rows
    that repeat an id are judged one by one. A page of any length or depth is
    parsed whole, in time about linear in its length. Other columns of ``df`` are
    not read, so their names cannot clash."""
    ready(df.sparkSession)
    src = df.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"),
                    host_of(F.col(url_col).cast("string")).alias("host"), F.col(html_col).cast("string").alias("html"))
    low = cut(low_importance(src.select("host", "html")))
    size = low.agg(F.sum(16 * F.size("low") + 2 * F.length("host") + 64)).first()[0] or 0
    both = join_checked(src, low, "host", "left", size).select("id", "url", "html", "low")

    def run(batches):
        for b in batches:
            out = [main_text(parse(h or ""), frozenset(x or ()))
                   for h, x in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())],
                                             names=["id", "url", "text"])

    kinds = {f.name: f.dataType.simpleString() for f in both.schema.fields}
    got = both.mapInArrow(run, f"id {kinds['id']}, url {kinds['url']}, text string")
    return got.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text",
                      F.length("text").cast("long").alias("n_chars"))
