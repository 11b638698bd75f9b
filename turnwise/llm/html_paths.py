"""Main text of web pages by consensus of each host's pages.

1. Every page is parsed and its containers are scored: by the share of the page's text that they hold outside menus, headers,
   footers, sidebars, notices, adverts, forms and comments, by what their tag and classes say, and by link density.
2. The best container's path of tags and classes, with digits generalised, is the page's vote.  Votes are counted per host in
   Spark; a host's winning paths are those with at least ``LEAST_SHARE`` of its votes, so at most ``1 / LEAST_SHARE``.
3. Every page is parsed again and its text taken from all containers at the winning path with the most votes that the page
   has.  If they hold less than ``LEAST_HELD`` of its text, the next winning path that holds as much is taken, then the page's own best
   container; but never one at a path that the host's pages often have and mostly did not vote for, such as a box.

Votes are summed before they are shuffled, so a host with a third of all pages is one row for each path and task; the
winners are a narrow table that is joined to the pages.

What a class or id alone names as a menu, notice and so on is left out only if it does not hold most of the page's text, or its heading.

Defined results: a null or empty page, and a page of nothing but what tags and roles leave out, has the empty text; a null url, or one
without ``://``, belongs to the host ""; repeated rows vote and are extracted each.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.llm.common import arrow_rows, materialize

LEAST_SHARE = 0.05
LEAST_HELD = 0.3

# What HTML says of its elements, and common names of page parts.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title svg".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINERS = frozenset("article body div main section td".split())
LEFT_OUT_TAGS = frozenset("aside button canvas datalist dialog embed footer form head header iframe input label menu nav noscript object option script select style svg template textarea title".split())
LEFT_OUT_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
LEFT_OUT_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertisements alert banner breadcrumb breadcrumbs comment comments consent cookie cookies "
    "discussion disqus footer gdpr header login masthead menu menus modal nav navbar navigation newsletter notice notices notification pager pagination popup promo "
    "promos promotion replies reply respond sidebar sidebars signup sponsor sponsored subscribe toolbar topbar".split()
)
COMMENT_NAMES = frozenset("comment comments discussion disqus replies reply respond".split())
CONTENT_NAMES = frozenset("article body content entry main post story text".split())
NEGATING = frozenset("has no with without".split())
CLOSED_BY: dict[str, frozenset[str]] = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]),
    "th": frozenset(["td", "th"]), "option": frozenset(["option"]),
}
KEEPS_OPEN = frozenset("article aside blockquote body details div dl fieldset figure footer form header html main nav ol section table ul".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>|<(?P<close2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<rest2>[^>]*)(?:>|\Z)",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_NAME = re.compile(r"[a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_DIGITS = re.compile(r"\d+")
_BLOCK_TAG = re.compile(rf"</?(?:{'|'.join(sorted(BLOCK))})(?=[\s/>])", re.IGNORECASE)
PATH_CHARS = 2_000  # a longer path goes on from its hash


@dataclass
class Node:
    tag: str
    parent: int
    names: tuple[str, ...] = ()
    left_out: bool = False
    named: frozenset[str] = frozenset()  # names of LEFT_OUT_NAMES, which leave it out if the rest of the page bears them out
    content: bool = False
    in_content: bool = False
    step: str = ""
    own: int = 0  # characters of kept text in the subtree
    linked: int = 0  # those in links


@dataclass
class Page:
    """A parsed page: nodes in document order, and blocks of kept text as (node, text)."""

    nodes: list[Node] = field(default_factory=list)
    blocks: list[tuple[int, str]] = field(default_factory=list)

    def paths(self) -> list[str]:
        """Every node's path of steps from the root; what is beyond ``PATH_CHARS`` is told apart by a running hash."""
        found: list[str] = []
        for node in self.nodes:
            path = f"{found[node.parent]}>{node.step}" if node.parent >= 0 else node.step
            found.append(path if len(path) <= PATH_CHARS else f"#{xxhash.xxh3_128_hexdigest(path)}")
        return found


def _node(tag: str, rest: str, parent: int, nodes: list[Node]) -> Node:
    node = Node(tag, parent)
    classes: list[str] = []
    if rest and ("=" in rest):
        for m in _ATTRIBUTE.finditer(rest):
            kind, value = m[1].lower(), entities.unescape(m[2] or m[3] or m[4] or "")
            if kind == "role":
                node.left_out |= value.strip().lower() in LEFT_OUT_ROLES
                node.content |= value.strip().lower() in ("main", "article")
                continue
            for name in value.split():
                words = _NAME.findall(_CAMEL.sub("-", name).lower())
                named = {w for w, before in zip(words, ["", *words], strict=False) if before not in NEGATING}
                if tag not in ("html", "body", "article", "main"):
                    node.named |= named & LEFT_OUT_NAMES
                node.content |= bool(named & CONTENT_NAMES)
                if kind == "class":
                    classes.append(_DIGITS.sub("#", name.lower()).replace(">", "_"))
    node.names = tuple(sorted(set(classes)))
    node.step = ".".join([tag, *node.names])
    above = nodes[parent] if parent >= 0 else None
    # The header of an article holds its title.
    node.in_content = bool(above and above.in_content) or tag in ("article", "main") or (node.content and tag in CONTAINERS and tag != "body")
    if tag in LEFT_OUT_TAGS and not (tag == "header" and node.in_content):
        node.left_out = True
    node.left_out |= bool(above and above.left_out)
    return node


class _RawEnds:
    """Where elements of raw content end, found in one pass over the text for each tag."""

    def __init__(self, text: str):
        self.text, self.ends, self.none_beyond = text, {}, {}

    def after(self, tag: str, start: int, at: int) -> int:
        """Where to go on after the start tag [start, at).

        Scripts and styles without an end tag take the rest.  Any other element that is not closed ends at the next tag of a block: what
        follows is the page's.  Elements that may hold their like are closed by the end tag of their own level.
        """
        end = self._nested(tag).get(start) if tag in ("svg", "template") else self._next(tag, at)
        if end is not None:
            return end
        if tag in ("script", "style"):
            return len(self.text)
        block = None if "block" in self.none_beyond else _BLOCK_TAG.search(self.text, at)
        if block is None:
            self.none_beyond["block"] = True
        return block.start() if block else at

    def _next(self, tag: str, at: int) -> int | None:
        if tag in self.none_beyond:
            return None
        found = re.compile(rf"</{tag}\b[^>]*>?", re.IGNORECASE).search(self.text, at)
        if found is None:
            self.none_beyond[tag] = True
        return found.end() if found else None

    def _nested(self, tag: str) -> dict[int, int]:
        if tag not in self.ends:
            opened, ends = [], {}
            for m in re.compile(rf"<(/?){tag}\b([^>]*)>?", re.IGNORECASE).finditer(self.text):
                if not m[1]:
                    if not m[2].endswith("/"):
                        opened.append(m.start())
                elif opened:
                    ends[opened.pop()] = m.end()
            self.ends[tag] = ends
        return self.ends[tag]


def parse(text: str) -> Page:
    """Parse leniently: end tags that are missing are implied, those without a beginning are ignored.

    Linear in the text: tags are counted within the innermost element that keeps others open, so that no look through the open elements finds
    nothing, and what it finds is closed.
    """
    page, stack = Page(), []
    nodes, blocks = page.nodes, page.blocks
    pieces: list[tuple[int, str, bool]] = []  # node, text, whether in a link
    pending: list[tuple[int, list[tuple[int, str, bool]]]] = []
    opened: Counter[str] = Counter()
    scopes: list[Counter[str]] = [Counter()]  # open tags inside each element of KEEPS_OPEN
    in_block: list[int] = []  # each node's innermost block
    raw = _RawEnds(text)

    def flush() -> None:
        if pieces:
            pending.append((in_block[stack[-1]] if stack else -1, pieces.copy()))
            pieces.clear()

    def close(depth: int) -> None:
        for i in reversed(stack[depth:]):
            tag = nodes[i].tag
            opened[tag] -= 1
            if tag in KEEPS_OPEN:
                scopes.pop()
            else:
                scopes[-1][tag] -= 1
        del stack[depth:]

    def add(raw: str) -> None:
        if not (stack and nodes[stack[-1]].left_out):
            pieces.append((stack[-1] if stack else -1, entities.unescape(raw) if "&" in raw else raw, any(nodes[i].tag == "a" for i in stack[-4:])))

    at, size = 0, len(text)
    while at < size:
        found = _TOKEN.search(text, at)
        if not found:
            add(text[at:])
            break
        if found.start() > at:
            add(text[at : found.start()])
        at = found.end()
        tag = (found["tag"] or found["tag2"] or "").lower()
        if not tag:
            continue
        if found["close"] or found["close2"]:
            if not (opened if tag in KEEPS_OPEN else scopes[-1])[tag]:
                continue
            depth = len(stack) - 1
            while nodes[stack[depth]].tag != tag:
                depth -= 1
            if tag in BLOCK:
                flush()
            close(depth)
            continue
        if tag == "br":
            pieces.append((-1, " ", False))
            continue
        if tag in BLOCK:
            flush()
            # A block ends an open paragraph; an item ends the item before it.
            enders = CLOSED_BY.get(tag, frozenset()) | {"p"}
            if tag[0] == "h" and tag[1:].isdigit():
                enders |= {"h1", "h2", "h3", "h4", "h5", "h6"}
            depth = len(stack)
            while any(scopes[-1][e] for e in enders):
                depth -= 1
                if nodes[stack[depth]].tag in enders:
                    close(depth)
        if tag in VOID:
            continue
        rest = found["rest"] or found["rest2"] or ""
        if tag in ("svg", "math") and rest.endswith("/"):
            continue
        if tag in RAW:
            at = raw.after(tag, found.start(), at)
            continue
        if rest.endswith("/") and tag not in BLOCK:
            continue
        if tag in ("html", "body") and opened[tag]:
            continue
        opened[tag] += 1
        if tag in KEEPS_OPEN:
            scopes.append(Counter())
        else:
            scopes[-1][tag] += 1
        in_block.append(len(nodes) if tag in BLOCK else in_block[stack[-1]] if stack else -1)
        nodes.append(_node(tag, rest, stack[-1] if stack else -1, nodes))
        stack.append(len(nodes) - 1)
    flush()
    _leave_out(nodes, pending)
    for at, found in pending:
        kept = [x for x in found if x[0] < 0 or not nodes[x[0]].left_out]
        block = " ".join("".join(x[1] for x in kept).split())
        if block:
            blocks.append((at, block))
            if at >= 0:
                nodes[at].own += len(block)
                nodes[at].linked += min(sum(len(x[1]) for x in kept if x[2]), len(block))
    for node in reversed(nodes):
        if node.parent >= 0:
            nodes[node.parent].own += node.own
            nodes[node.parent].linked += node.linked
    return page


def _leave_out(nodes: list[Node], pending: list[tuple[int, list[tuple[int, str, bool]]]]) -> None:
    """Leave out nodes by their names, but for those that hold most of the page's text, an article, or its heading.

    Comments may hold most of a page, and articles, and are left out nevertheless.
    """
    if not any(n.named for n in nodes):
        return
    held, whole = [0] * len(nodes), 0
    for _, found in pending:
        for at, text, _ in found:
            whole += len(text.strip())
            if at >= 0:
                held[at] += len(text.strip())
    heads, articles = [False] * len(nodes), [False] * len(nodes)
    for i in range(len(nodes) - 1, -1, -1):
        node = nodes[i]
        if node.left_out:
            continue
        heads[i] |= node.tag in ("h1", "main")
        articles[i] |= node.tag == "article"
        if node.parent >= 0:
            held[node.parent] += held[i]
            heads[node.parent] |= heads[i]
            articles[node.parent] |= articles[i]
    for i, node in enumerate(nodes):
        saved = heads[i] or (not node.named & COMMENT_NAMES and (articles[i] or 2 * held[i] > whole))
        node.left_out |= bool(node.named) and not saved
        node.left_out |= node.parent >= 0 and nodes[node.parent].left_out


def best_container(page: Page) -> int:
    """The node that most likely holds the main text; -1 for the whole page.

    A container that names itself as the article counts for most; of such ones the outermost, of others the innermost that
    still holds nearly all text.
    """
    whole = sum(len(text) for _, text in page.blocks)
    best, found = 0.0, -1
    if not whole:
        return found
    depths: list[int] = []
    for i, node in enumerate(page.nodes):
        depth = depths[node.parent] + 1 if node.parent >= 0 else 0
        depths.append(depth)
        if node.left_out or node.tag not in CONTAINERS:
            continue
        share = node.own / whole
        if share < LEAST_HELD:
            continue
        said = 1.0 if node.tag == "article" else 0.8 if node.tag == "main" else 0.4 if node.content and node.tag != "body" else 0.0
        value = (1.0 if share >= 0.9 else share) + said - 0.5 * node.linked / max(1, node.own)
        value += -0.001 * depth if said else 0.001 * depth
        if value > best:
            best, found = value, i
    return found


def extract(page: Page, winners: list[str], refused: frozenset[str] = frozenset()) -> str:
    """Blocks below the nodes at the first winning path that the page has, else below its best container.

    Where the first path holds little of the page, another one or the best container, unless refused, takes its place.
    """
    chosen: set[int] = set()
    if winners and page.nodes:
        paths, order = page.paths(), {w: k for k, w in reversed([*enumerate(winners)])}
        at: dict[int, set[int]] = {}
        for i, (path, node) in enumerate(zip(paths, page.nodes, strict=True)):
            if path in order and node.own:
                at.setdefault(order[path], set()).add(i)
        whole = sum(len(text) for _, text in page.blocks)
        held = {w: sum(page.nodes[i].own for i in at[w]) for w in sorted(at)}
        if at:
            chosen = at[min(at)]
            if held[min(at)] < LEAST_HELD * whole:
                best = best_container(page)
                own = {best} if best < 0 or paths[best] not in refused else chosen
                chosen = next((at[w] for w in held if held[w] >= LEAST_HELD * whole and winners[w] not in refused), own)
    if not chosen:
        chosen = {best_container(page)}
    below: dict[int, bool] = {-1: -1 in chosen}

    def inside(i: int) -> bool:
        path = []
        while i not in below:
            if i in chosen:
                below[i] = True
                break
            path.append(i)
            i = page.nodes[i].parent
        for j in path:
            below[j] = below[i]
        return below[path[0]] if path else below[i]

    return "\n\n".join(text for at, text in page.blocks if inside(at))


def _decoded(values: pa.Array) -> Iterator[str]:
    return ((v or b"").decode("utf-8", "replace") for v in values.to_pylist())


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in arrow_rows(batches):
        found: Counter[tuple[str, str]] = Counter()
        voted: Counter[tuple[str, str]] = Counter()
        for host, text in zip(batch.column("host").to_pylist(), _decoded(batch.column("body")), strict=True):
            page = parse(text)
            at = best_container(page)
            if at < 0:
                continue
            paths = page.paths()
            chosen = paths[at]
            seen = {p for p, node in zip(paths, page.nodes, strict=True) if node.own and not node.left_out and node.tag in CONTAINERS}
            found.update((host, p) for p in seen | {chosen})
            voted[host, chosen] += 1
        keys = list(found)
        yield pa.RecordBatch.from_arrays(
            [pa.array([h for h, _ in keys], pa.string()), pa.array([p for _, p in keys], pa.string()), pa.array([voted[k] for k in keys], pa.int64()), pa.array([found[k] for k in keys], pa.int64())],
            names=["host", "path", "votes", "pages"],
        )


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in arrow_rows(batches):
        told = zip(_decoded(batch.column("body")), batch.column("winners").to_pylist(), batch.column("refused").to_pylist(), strict=True)
        found = [extract(parse(text), winners or [], frozenset(refused or ())) for text, winners, refused in told]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(found, pa.string())], names=["id", "url", "text"])


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, winners, refused) from pages(host, body): each host's winning paths, most votes first, and the containers' paths
    that so many of its pages have, but of which most did not vote for them."""
    votes = pages.mapInArrow(_votes, "host string, path string, votes long, pages long").groupBy("host", "path").agg(F.sum("votes").alias("votes"), F.sum("pages").alias("pages"))
    whole = votes.groupBy("host").agg(F.sum("votes").alias("whole"))
    least = LEAST_SHARE * F.col("whole")
    votes = votes.join(whole, "host").where(F.col("pages") >= least).withColumn("wins", F.col("votes") >= least)
    ordered = F.sort_array(F.collect_list(F.when(F.col("wins"), F.struct((-F.col("votes")).alias("order"), "path"))))
    refused = F.sort_array(F.collect_list(F.when(2 * F.col("votes") < F.col("pages"), F.col("path"))))
    return votes.groupBy("host").agg(ordered.alias("w"), refused.alias("refused")).select("host", F.col("w.path").alias("winners"), "refused")


def main_texts(pages: DataFrame, name: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text) of every row."""
    kind = dict(pages.dtypes)[id_col]
    host = F.lower(F.coalesce(F.regexp_extract(F.col(f"`{url_col}`"), r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url"), host.alias("host"), F.col(f"`{html_col}`").cast("binary").alias("body"))
    winners = materialize(host_paths(rows.select("host", "body")), f"{name}_winners")
    joined = rows.join(winners, "host", "left").select("id", "url", "body", "winners", "refused")
    return joined.mapInArrow(_texts, f"id {kind}, url string, text string")
