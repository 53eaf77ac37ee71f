"""Operator 10: main text of web pages by consensus host paths.

Every page's containers are scored by the plain text of their blocks (links count against it, a parent shares half of what its
children hold). Each page votes for the generalised tag-class path of its best container; Spark sums the votes by
host (a container inside an article votes for the article), and the path with the most votes is extracted from all of the host's pages. A page that lacks its host's path,
or has no host, uses its own best container.

Defined results
- null html is empty and gives an empty text; unclosed, misnested and stray tags are tolerated; a head or select whose
  end tag is left out ends where a block begins that can't be inside it.
- an element is left out for its tag (:data:`DROPPED`, inline ones too), as a form, or for a class, id or role that says so:
  as a whole, or by a word that is never an article's (:data:`STRONG`) and isn't negated. A page without an ``article`` or
  ``main`` to go by keeps the marked element or form that holds over `MOST` times the text of all that is unmarked, and more
  than two blocks of `PROSE` characters.
- an element of navigation that is never closed hides nothing.
- without an ``article`` or ``main``, a container widens to its parent (not to the body) while all beside it reads as prose.
- ties between containers go to the outer, earlier one; between paths to the smaller hash; repeated rows repeat.
- other columns are ignored; an empty table gives no rows.

Votes are two hashes and a count, so they combine before the shuffle and a hot host costs no more than another. The
winners (two longs a host) are broadcast only up to a checked number of hosts, else joined by shuffle.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.session import cut, sized_join

#: Elements whose content is never main text.
DROPPED = set("aside button datalist dialog footer header iframe input label menu nav noscript object option select svg template textarea head title".split())
#: Words of class and id that mark what isn't the article.
MARKS = set(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies "
    "disqus footer header login masthead menu modal nav navbar navigation newsletter notice notices notification pagination pager "
    "popup promo promoted recommended related replies reply responses search share sharing sidebar signup skip social sponsor "
    "sponsored subscribe subscription tags toolbar widget".split()
)
#: Words that may stand beside a mark in a name without changing what it marks ("site-header", "comment-list").
BESIDE = set(
    "area article articles bar block body bottom box col column container content footer global group inner item items left links list "
    "main media menu news outer page panel post posts primary reader right row secondary section site slot small stories story sub "
    "sticky text top user unit widget wrap wrapper".split()
)
#: Words that mark whatever name they stand in, and words that take such a mark back.
STRONG = set("ad adbox ads advert advertisement advertorial adverts comment comments consent cookie cookies disqus newsletter promo promoted sponsor sponsored".split())
NEGATED = set("has hide no non with without".split())
#: Elements that hide the rest of a page if their end tag is missing.
UNCLOSED = set("aside footer header menu nav".split())
MOST = 3
PROSE = 80  # characters of a block that reads as prose
#: Roles of what isn't the article.
ROLES = set("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
BLOCKS = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 header hgroup hr html li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = set("article body div main section td dd li blockquote center html table tbody tr ul ol figure details".split())
KEPT_WHOLE = {"html", "body", "main", "article"}
OF_SELECT = {"option", "optgroup"}
#: Elements that end an open head where its end tag is left out: all blocks but these.
IN_HEAD = {"head", "html", "menu", "option"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that a start tag of the key ends, up to the nearest of the stop elements.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
STOPS = set("ul ol dl table html body article section main div blockquote td th".split())

#: A tag's attributes end at the first > outside quotes; where a quote never closes, at the first > at all. Both need a
#: > ahead, so pages are scanned up to their last one: every try then succeeds or fails at once, and time stays linear.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<(script|style|textarea|title)\b[^>]*>.*?(?:</\1\s*>|$)|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?>[^<>\"']+|\"[^\"<]*+\"|'[^'<]*+')*+(?=>)|[^>]*+)>",
    re.S | re.I,
)
_OPENS = re.compile(r"<[a-zA-Z/!?]")
DEEPEST = 200  # containers below this depth share the path of the one at it
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[a-z]+")


class _Node:
    __slots__ = ("tag", "path", "drop", "mark", "parent", "score", "index", "own", "size", "prose")

    def __init__(self, tag: str, path: str, drop: bool, mark: bool, parent, index: int):
        self.tag, self.path, self.drop, self.mark, self.parent, self.index = tag, path, drop, mark, parent, index
        self.score, self.own, self.size, self.prose = 0, 0, 0, 0


def marked(attrs: dict[str, str]) -> bool:
    """Whether a class, the id or a role says that an element isn't the article: a name counts only if all its words are
    marks or stand beside them ("site-header" does, "has-sidebar" and "share-price" don't), or one is strong and none negates it
    ("ad-container-300x250" does, "no-comments" doesn't)."""
    for kind, value in attrs.items():
        for name in value.lower().split():
            words = _WORD.findall(name)
            if kind == "role":
                if name in ROLES:
                    return True
            elif any(w in MARKS for w in words) and all(w in MARKS or w in BESIDE for w in words):
                return True
            elif any(w in STRONG for w in words) and not any(w in NEGATED for w in words):
                return True
    return False


def parse(page: str, open_ones: frozenset[str] = frozenset()) -> tuple[list[_Node], list[tuple[_Node, str]]]:
    """Containers in page order; kept blocks as (container, text) in page order. ``open_ones``: tags that hide nothing here."""
    unclosed: set[str] = set()
    root = _Node("", "", False, False, None, 0)
    stack = [root]
    nodes: list[_Node] = [root]
    found: list[tuple[_Node, str, int]] = []
    parts: list[str] = []
    links = 0
    at = in_link = 0

    def flush() -> None:
        nonlocal links
        if parts:
            text = " ".join(_html.unescape("".join(parts)).split())
            if text:
                found.append((stack[-1], text, links))
            parts.clear()
        links = 0

    last = page.rfind(">") + 1
    for m in _TOKEN.finditer(page, 0, last):
        if m.start() > at and not stack[-1].drop:
            parts.append(page[at : m.start()])
            if in_link:
                links += m.start() - at
        at = m.end()
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        if m[2]:
            if tag in BLOCKS:
                flush()
            through = tag in BLOCKS or tag == "a" or tag in DROPPED or tag == "form"  # ends open blocks inside it too
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    if through:
                        unclosed.update(n.tag for n in stack[k + 1 :] if n.tag in UNCLOSED)
                    if through or not any(n.tag in BLOCKS for n in stack[k + 1 :]):
                        del stack[k:]
                    break
                if not through and stack[k].tag in STOPS:
                    break
            if tag == "a":
                in_link = 0
            continue
        if tag == "br":
            if not stack[-1].drop:
                parts.append(" ")
            continue
        if tag in BLOCKS:
            flush()
            if len(stack) > 1 and tag not in IN_HEAD and any(n.tag == "head" for n in stack[1:3]):
                del stack[next(k for k, n in enumerate(stack) if n.tag == "head") :]
            if tag not in OF_SELECT and any(n.tag == "select" for n in stack[-3:]):  # no other block fits into a select: it ended
                del stack[next(k for k, n in enumerate(stack) if n.tag == "select") :]
            ended = ENDS.get(tag, ())
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p" or stack[k].tag in ended:
                    del stack[k:]
                    if not ended:
                        break
                elif stack[k].tag in STOPS:
                    break
        if tag in VOID:
            continue
        above = stack[-1]
        if tag == "a":
            in_link = 1
        attrs = {a.lower(): (b or c or d) for a, b, c, d in _ATTR.findall(m[4])} if "=" in m[4] else {}
        if m[4].rstrip().endswith("/") and tag not in BLOCKS:
            continue
        path = above.path
        if tag in CONTAINERS and path.count("/") < DEEPEST:
            general = ".".join(sorted({re.sub(r"\d+", "", c) for c in attrs.get("class", "").lower().split()}))
            path = f"{above.path}/{tag}.{general}" if general else f"{above.path}/{tag}"
        mark = tag == "form" or bool(attrs) and tag in BLOCKS and tag not in KEPT_WHOLE and marked(attrs)
        n = _Node(tag, path, above.drop or tag in DROPPED and tag not in open_ones, mark, above, len(nodes))
        nodes.append(n)
        stack.append(n)
    unclosed.update(n.tag for n in stack if n.tag in UNCLOSED)
    if unclosed - open_ones:
        return parse(page, open_ones | unclosed)
    tail = _OPENS.split(page[at:], maxsplit=1)[0]
    if tail and not stack[-1].drop:
        parts.append(tail)
    flush()
    return nodes, _scored(nodes, found)


def _scored(nodes: list[_Node], found: list[tuple[_Node, str, int]]) -> list[tuple[_Node, str]]:
    """The blocks outside of marked elements, their containers' scores added up."""
    hidden = _hidden(nodes)
    whole = [n for n in nodes if n.tag in ("article", "main") and not n.drop]
    if whole and all(hidden[n.index] for n in whole):  # a mark around all there is of an article can't be meant
        for n in whole:
            while n.parent is not None:
                n.mark = False
                n = n.parent
        hidden = _hidden(nodes)
    elif not whole:
        hidden = _lifted(nodes, found, hidden)
    blocks = []
    for top, text, links in found:
        if hidden[top.index]:
            continue
        c = _home(top)
        blocks.append((c, text))
        gain = max(0, len(text) - 2 * links)
        c.own += gain
        c.size += len(text)
        c.prose += len(text) >= PROSE
        c.score += 2 * gain
        if c.parent is not None:
            _home(c.parent).score += gain
    return blocks


def _lifted(nodes: list[_Node], found: list[tuple[_Node, str, int]], hidden: list[bool]) -> list[bool]:
    """Marks of a page that names no article: one around over ``MOST`` times the text of all that is unmarked can't be meant, nor
    then can those around it. What lies in a mark of its own inside isn't counted for the outer one."""
    while True:
        held: dict[int, int] = {}
        free = 0
        for top, text, links in found:
            gain = max(0, len(text) - 2 * links)
            n = top
            while n is not None and not n.mark:
                n = n.parent
            if n is None:
                free += gain
            else:
                held[n.index] = held.get(n.index, 0) + gain
        most = max(held, key=lambda k: (held[k], -k), default=None)
        if most is None or held[most] <= max(MOST * free, 2 * PROSE):
            return hidden
        n = nodes[most]
        while n is not None:
            n.mark = False
            n = n.parent
        hidden = _hidden(nodes)


def _hidden(nodes: list[_Node]) -> list[bool]:
    out: list[bool] = []
    for n in nodes:
        out.append(n.mark or n.parent is not None and out[n.parent.index])
    return out


def _home(n: _Node) -> _Node:
    while n.parent is not None and n.tag not in CONTAINERS:
        n = n.parent
    return n


def path_hash(path: str) -> int:
    return xxhash.xxh64_intdigest(path.encode()) - (1 << 63)


def best(nodes: list[_Node]) -> _Node | None:
    """The container with the highest score, widened to the article that holds it; none where no block counts."""
    top = None
    for n in nodes:
        if n.score > 0 and n.tag in CONTAINERS | {""} and (top is None or n.score > top.score):
            top = n
    return top and _whole(top, nodes)


def _whole(top: _Node, nodes: list[_Node]) -> _Node:
    """The nearest article around a container, else the nearest main; else the outermost container that adds only text of
    its own (a headline, a standfirst) and no other container's. It has the container's score at least."""
    above = [top]
    while above[-1].parent is not None:
        above.append(above[-1].parent)
    out = next((n for tag in ("article", "main") for n in above if n.tag == tag), None)
    if out is None:
        out = _widened(top, above, nodes)
    out.score = max(out.score, top.score)
    return out


def _widened(top: _Node, above: list[_Node], nodes: list[_Node]) -> _Node:
    """The outermost ancestor below the body whose containers all read as prose beside ``top``: few links, and a block of some length
    in each. One that adds nothing is passed over."""
    held, size, prose = [n.own for n in nodes], [n.size for n in nodes], [n.prose for n in nodes]
    inner: dict[int, list[int]] = {}
    for n in reversed(nodes[1:]):
        for values in (held, size, prose):
            values[n.parent.index] += values[n.index]
        if n.tag in CONTAINERS and size[n.index]:
            inner.setdefault(_home(n.parent).index, []).append(n.index)
    out = top
    for parent in above[1:]:
        if parent.tag in ("body", "html", ""):
            break
        if parent.tag not in CONTAINERS:
            continue
        beside = [k for k in inner.get(parent.index, []) if nodes[k] not in above]
        if any(2 * held[k] < size[k] or not prose[k] for k in beside):
            break
        if parent.own or beside:
            out = parent
    return out


def extract(page: str | None, winner: int | None = None) -> str:
    """Blocks of the containers on the winning path (or the page's own best), joined by an empty line."""
    if not page:
        return ""
    nodes, blocks = parse(page)
    paths = {path_hash(n.path): n.path for n in nodes if n.tag in CONTAINERS or not n.tag} if winner is not None else {}
    own = paths.get(winner)
    if own is None or not any(_within(c, own) for c, _ in blocks):
        top = best(nodes)
        own = top.path if top else ""
    return "\n\n".join(t for c, t in blocks if _within(c, own))


def _within(c: _Node, path: str) -> bool:
    return c.path == path or c.path.startswith(path + "/")


def host_of(url: str | None) -> str:
    m = re.match(r"\s*(?:[a-z][a-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", url or "", re.I)
    return m[1].lower() if m else ""


def _host_hash(url: str | None) -> int | None:
    host = host_of(url)
    return path_hash(host) if host else None


def votes(pages: DataFrame) -> DataFrame:
    """(host, path) hashes with the summed scores of the pages' best containers. ``pages``: url, html."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: dict[tuple[int, int], int] = {}
            for url, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                host = _host_hash(url)
                top = best(parse(page)[0]) if page and host is not None else None
                if top:
                    k = (host, path_hash(top.path))
                    rows[k] = rows.get(k, 0) + top.score
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in rows], pa.int64()), pa.array([k[1] for k in rows], pa.int64()), pa.array(list(rows.values()), pa.int64())], names=["host", "path", "score"])

    return pages.select("url", "html").mapInArrow(run, "host long, path long, score long").groupBy("host", "path").agg(F.sum("score").alias("score"))


def main_text(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """page_id, url, text. ``pages`` needs the id, url and html."""
    pages = pages.select(F.col(id_col).alias("page_id"), "url", "html")
    won = votes(pages).groupBy("host").agg(F.max(F.struct("score", F.negative("path").alias("_order"), "path")).alias("w"))
    won = cut(won.select("host", F.col("w.path").alias("winner")))

    def hosts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([_host_hash(u) for u in b.column("url").to_pylist()], pa.int64())], names=["page_id", "url", "html", "host"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(p, w) for p, w in zip(b.column("html").to_pylist(), b.column("winner").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    known = pages.mapInArrow(hosts, "page_id long, url string, html string, host long")
    return sized_join(known, won, ["host"], "left").select("page_id", "url", "html", "winner").mapInArrow(run, "page_id long, url string, text string")


def op10_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
