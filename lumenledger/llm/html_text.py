"""Main text of web pages by wrapper induction.

1.  Every page becomes a tree of elements.  An element's path is the chain of tags and classes to it.  Trees of a host are aligned as
    simple tree matching does: an element can only match one with its path, and of siblings that share a path, those of equal
    text match one by one, whatever varies before and after them.  As the matched pairs are found by path and text, it needs no
    reference page and no pair of pages, so a host with a third of all pages is a sum like any other.
2.  Constant nodes are template: elements whose text recurs with almost all contents that have text at their path (``SHARE``, and
    ``MIN_VOTES`` beside the first at least).  Pages of one content (``content_key``) have one vote together, so copies don't make
    an article a template; nodes inside an article or main element keep their text however often it recurs.  So do paths
    where nearly all text is links: the menus, whatever is in them.
3.  Varying slots are content.  The host's region is the deepest element, but none in an article, that holds ``REGION`` of all varying text of its pages; a
    page's text is that of its slots in the region, with headings and paragraphs right before it.  Adverts, dates and teasers
    vary as well, but lie outside.
4.  A host needs three contents for this.  For the others, and for pages without the host's region, the article or main element
    is the region, if there is one.  Elements that never hold content (menus, footers, sidebars, notices, adverts, forms,
    comments) are known by element, role and class, since reader comments vary like an article.
"""

from __future__ import annotations

import functools
import hashlib
import html as html_std
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenledger.llm.common import bound_batches, fresh, materialise

MIN_VOTES, SHARE = 2, 0.9
#: Share of a host's varying text that its region holds, and contents that a host needs for one.
REGION, CONTENTS = 0.8, 3
#: Tables up to this size go to all executors; larger ones are joined by a shuffle.
BROADCAST_BYTES = 32 << 20

# Element names by what they do.
AD_NAMES = frozenset("ad ads advert adverts advertisement advertising promo promoted sponsor sponsored".split())
COMMENT_NAMES = frozenset("comment comments disqus replies respond".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe xmp noembed noframes template svg canvas audio video annotation annotation-xml".split())
INLINE = frozenset("""a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr
    math semantics mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom msub msup msubsup munder mover munderover""".split())
#: Stand-ins for what a browser shows: text only within an article.
STAND_IN = frozenset("noscript object".split())
NEVER = frozenset("nav footer aside menu dialog button select fieldset head".split())
CLOSES = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"]),
}
MAIN = frozenset("main h1".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that may be a host's region.
REGIONS = frozenset("html body main article section div center table tbody tr td form".split())
SCOPES = frozenset("ul ol dl table article main section div body html aside nav footer header form td th".split())
NEVER_NAMED = frozenset(
    """ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies
    disqus footer gdpr masthead menu modal nav navbar navigation newsletter notice notification pager pagination popup promo
    promoted promotion recommended related replies respond share sharing sidebar site-header skip-link social sponsor sponsored
    subscribe subscription toolbar topbar widget""".split()
)
NEVER_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|</[a-zA-Z][^>]*>|<[a-zA-Z](?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|<[a-zA-Z][^>]*>", re.S)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
#: One attribute after the other: its name, and its value if it has one.
_ATTR = re.compile(r"""([^\s"'>/=][^\s>/=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
_KNOWN = re.compile("class|id|role|hidden|href", re.I)
_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}


class Node:
    __slots__ = ("tag", "sig", "skip", "kids", "texts", "content", "hard", "soft", "size", "main", "block", "links", "href")

    def __init__(self, tag: str, sig: str, skip: bool, content: bool, hard: bool = False, soft: int = 0, parent: Node | None = None):
        self.tag, self.sig, self.skip, self.content = tag, sig, skip, content
        # never holds content; or only if it holds the page's content
        self.hard, self.soft = hard, soft
        # signs of text in it, and whether it is or holds a main or h1 (2), or only the page's largest article (1)
        self.size, self.main = 0, 2 if tag in MAIN and not hard else 0
        self.kids: list[Node] = []
        self.texts: list[str] = []
        # the block that its text goes to, and signs of its texts that are in links
        self.block = parent.block if parent and tag in INLINE else self
        self.links, self.href = 0, False


def attributes(token: str, tag: str) -> dict[str, str]:
    """The attributes of a start tag, lower-cased; of equal names the first counts."""
    out: dict[str, str] = {}
    if len(token) > len(tag) + 2 and _KNOWN.search(token, len(tag) + 1):
        for name, a, b, c in _ATTR.findall(token, len(tag) + 1, len(token) - 1):
            out.setdefault(name.lower(), (a or b or c).lower())
    return out


def _named(tag: str, said: dict[str, str], flow: bool) -> tuple[bool, int]:
    """Whether an element's names say that it never holds content, and whether they make it doubtful: 1, or 2 for reader comments.

    ``flow``: it is in an article.  There headings and paragraphs are content unless their class is that of adverts or comments, and an id
    is but an anchor.  An article isn't content if its class says that it is an advert or a comment.
    """
    classes, ids = said.get("class", "").split(), said.get("id", "").split()
    if tag in ("body", "html", "main", "h1"):
        return False, 0
    foreign = AD_NAMES | COMMENT_NAMES
    if tag == "article":
        return not foreign.isdisjoint(classes), 0
    if flow and (tag in HEADINGS or tag == "p"):
        return False, 0 if foreign.isdisjoint(classes) else 1
    names = classes + ids
    if not COMMENT_NAMES.isdisjoint(names):
        return False, 2
    return False, int(any(n in NEVER_NAMED or not NEVER_NAMED.isdisjoint(re.split(r"[-_]+", n)) for n in names))


def _judged(token: str, tag: str, flow: bool) -> tuple[bool, int, str, bool]:
    """What a start tag says: whether its element never holds content or only perhaps, its signature, and whether it is a link."""
    said = attributes(token, tag)
    hard = tag in NEVER or (tag == "header" or tag in STAND_IN) and not flow
    hard = hard or said.get("role") in NEVER_ROLES or "hidden" in said or said.get("aria-hidden") == "true"
    foreign, soft = _named(tag, said, flow)
    hard = hard or foreign
    names = set(said.get("class", "").split()) | set(said.get("id", "").split())
    return hard, 0 if hard else max(soft, int(tag == "form")), ".".join([tag, *sorted(names)]), tag == "a" and "href" in said


#: Start tags recur; those of up to SHORT signs are judged once.
SHORT = 120
_judged_once = functools.lru_cache(1 << 15)(_judged)


def _open(token: str, tag: str, parent: Node, number: int, spared: frozenset[int]) -> Node:
    """The node of a start tag."""
    hard, soft, sig, href = (_judged_once if len(token) <= SHORT else _judged)(token, tag, parent.content)
    skip = parent.skip or hard or soft > 0 and number not in spared
    node = Node(tag, sig, skip, parent.content or tag in ("article", "main") and not hard, hard, soft, parent)
    node.href = href
    return node


def blocks(page: str) -> tuple[Node, list[tuple[Node, str]]]:
    """The tree of a page, and its blocks of text in page order with the nodes that hold them.

    Parsing forgives: unclosed elements end with their parents, stray end tags are ignored.  Forms and elements with a word of
    ``NEVER_NAMED`` as a name or in one hold no content, but not if a main or h1, the page's largest article, or nearly all of the page's
    text is in them; for elements named as reader comments an article doesn't count.
    """
    root, out, spared = _parse(page, frozenset())
    return _parse(page, spared)[:2] if spared else (root, out)


def _parse(page: str, spared: frozenset[int]) -> tuple[Node, list[tuple[Node, str]], frozenset[int]]:
    """As ``blocks``, with the numbers of elements to spare; also of those that ought to be."""
    opened: list[tuple[Node, Node]] = []
    root = Node("", "", False, False)
    stack = [root]
    count: dict[str, int] = {"href": 0}  # open elements of each tag, and open links
    out: list[tuple[Node, str]] = []
    held: list[str] = []
    linked = 0
    holder = root

    def flush() -> None:
        nonlocal held, linked
        if held:
            text = " ".join("".join(held).split())
            if text:
                holder.texts.append(text)
                holder.links += linked
                out.append((holder, text))
            held, linked = [], 0

    def write(text: str) -> None:
        nonlocal holder, linked
        if not text:
            return
        signs = len("".join(text.split()))
        stack[-1].size += signs
        if not held:
            holder = stack[-1].block
        # an element that never holds content may be inline: its text stays apart
        if stack[-1].skip and not holder.skip:
            return
        if count["href"]:
            linked += signs
        held.append(html_std.unescape(text))

    def shut(k: int) -> None:
        for node in stack[k:]:
            count[node.tag] -= 1
            count["href"] -= node.href
        del stack[k:]

    at, end = 0, len(page)
    # tags end at a >; what follows the last one is text, but for a comment that isn't closed
    tags_end = page.rfind(">") + 1
    unclosed: set[str] = set()  # raw elements without an end tag from here on
    while at < end:
        m = _TOKEN.search(page, at, tags_end)
        if not m:
            rest = page.find("<!--", at)
            write(page[at:] if rest < 0 else page[at:rest])
            break
        write(page[at : m.start()])
        token, at = m[0], m.end()
        if token.startswith("<!") or token.startswith("<?"):
            if at == tags_end and token.startswith("<!--") and not token.endswith("-->"):
                break
            continue
        tag = _NAME.match(token)[1].lower()
        if token[1] == "/":
            if tag not in INLINE:
                flush()
            if not count.get(tag):
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    if any(n.tag not in INLINE for n in stack[k:]):
                        flush()
                    shut(k)
                    break
                if tag in INLINE and stack[k].tag not in INLINE:
                    break
            continue
        if tag in RAW:
            if not token.endswith("/>"):
                stop = None if tag in unclosed else _END[tag].search(page, at)
                if stop:
                    at = stop.end()
                else:
                    unclosed.add(tag)
                    at = end if tag in ("script", "style", "template", "textarea") else at
            continue
        if tag not in INLINE:
            flush()
            closed = CLOSES.get(tag, frozenset())
            if tag not in VOID and count.get("p") or any(count.get(t) for t in closed):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag in closed or stack[k].tag == "p" and tag not in VOID:
                        shut(k)
                        break
                    if stack[k].tag in SCOPES:
                        break
        if tag in VOID or token.endswith("/>") and tag not in INLINE:
            continue
        node = _open(token, tag, stack[-1], len(opened), spared)
        opened.append((node, stack[-1]))
        stack[-1].kids.append(node)
        stack.append(node)
        count[tag] = count.get(tag, 0) + 1
        count["href"] += node.href
    flush()
    if spared or not any(node.soft for node, _ in opened):
        return root, out, spared
    for node, parent in reversed(opened):
        if not node.hard:
            parent.size += node.size
    largest = max((node for node, _ in opened if node.tag == "article" and not node.hard), key=lambda node: node.size, default=None)
    if largest is not None:
        largest.main = max(largest.main, 1)
    for node, parent in reversed(opened):
        if not node.hard:
            parent.main = max(parent.main, node.main)
    spare = frozenset(n for n, (node, _) in enumerate(opened) if node.soft and (node.main >= node.soft or node.size and node.size >= SHARE * root.size))
    return root, out, spare


# ---------------------------------------------------------------- trees and their alignment by path and text


def host_of(url):
    """The host of a url, lower-cased; empty for none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


@functools.lru_cache(1 << 16)
def _step(path: int, sig: str) -> int:
    """The hashed path of a child."""
    return _hash(path, sig)


def _hash(path: int, text: str) -> int:
    raw = hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8, key=path.to_bytes(8, "little", signed=True)).digest()
    return int.from_bytes(raw, "little", signed=True)


def elements(root: Node) -> Iterator[tuple[int, int, Node]]:
    """(hashed path, number of the parent, node) of all elements of a page; parents come first, the root with -1."""
    todo: list[tuple[Node, int, int]] = [(root, 0, -1)]
    number = -1
    while todo:
        node, path, parent = todo.pop()
        number += 1
        yield path, parent, node
        todo += [(kid, _step(path, kid.sig), number) for kid in node.kids if kid.kids or kid.texts or kid.tag not in INLINE]


def node_hash(path: int, node: Node) -> int | None:
    """The hash of an element's path and text; None for no text."""
    return _hash(path, "\x1f".join(node.texts)) if node.texts else None


def content_key(found: list[tuple[Node, str]]) -> bytes:
    """What copies of one content share, whatever advert, menu or date is around it.

    The text in the article or main element; without one the headings, the longest paragraph and the longest block.
    """
    left = [(node, text) for node, text in found if not node.skip]
    key = [text for node, text in left if node.content]
    if not key:
        key = [text for node, text in left if node.tag in HEADINGS]
        rest = [(len(text), text, node.tag) for node, text in left if node.tag not in HEADINGS]
        key += [max(some)[1] for some in ([r for r in rest if r[2] == "p"], rest) if some]
    return hashlib.blake2b("\x1f".join(key).encode("utf-8", "surrogatepass"), digest_size=16).digest()


#: What ``_slot_rows`` notes of each element: path, parent, hash of path and text, signs of its texts and of those in links, and whether
#: it votes, may be a region, and never holds content.
_GROUPS = "_host string, _key binary, _paths array<bigint>, _parents array<int>, _nodes array<bigint>, _signs array<int>, _links array<int>, _votes array<boolean>, _may array<boolean>, _skips array<boolean>"


def _slot_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.list_(k) for k in (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.bool_())]
    for batch in batches:
        keys: list[bytes] = []
        columns: list[list] = [[] for _ in kinds]
        for page in batch.column(1):
            root, found = blocks(page.as_py() or "")
            keys.append(content_key(found))
            rows: list[tuple] = []
            within: list[bool] = []  # an article is a region as a whole
            for path, parent, node in elements(root):
                within.append(node.tag == "article" or parent >= 0 and within[parent])
                votes = not node.content
                signs = sum(len(t) - t.count(" ") for t in node.texts)
                may = node.tag in REGIONS and not (parent >= 0 and within[parent])
                rows.append((path, parent, node_hash(path, node) if votes else None, signs, node.links, votes, may, node.skip))
            for column, values in zip(columns, zip(*rows)):
                column.append(list(values))
        yield pa.record_batch([batch.column(0), pa.array(keys, pa.binary()), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=[x.split()[0] for x in _GROUPS.split(", ")])


def _region_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Elements of pages with their host's constant nodes and link paths -> varying text of each path and all below, and its depth."""
    for batch in batches:
        out: dict[tuple[str, int, int], int] = {}
        for host, paths, parents, nodes, signs, links, votes, may, skips, constant, menus in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("_host", "_paths", "_parents", "_nodes", "_signs", "_links", "_votes", "_may", "_skips", "_constant", "_menus"))):
            constant, menus = set(constant or []), set(menus or [])
            mass = [0 if x or v and (n in constant or p in menus) else s - k for p, n, s, k, v, x in zip(paths, nodes, signs, links, votes, skips)]
            depth = [0] * len(paths)
            for i in range(1, len(paths)):
                depth[i] = depth[parents[i]] + 1
            for i in range(len(paths) - 1, 0, -1):
                mass[parents[i]] += mass[i]
            for i, (path, m) in enumerate(zip(paths, mass)):
                if m > 0 and (may[i] or not i):
                    key = (host, path, depth[i])
                    out[key] = out.get(key, 0) + m
        rows = [(*key, m) for key, m in out.items()]
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64()]
        yield pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["_host", "_path", "_depth", "_mass"])


def _join_hosts(rows: DataFrame, small: DataFrame, size: int, how: str) -> DataFrame:
    """Join on the host; the table of hosts is broadcast only if its measured size is within the bound."""
    if size <= BROADCAST_BYTES:
        return rows.join(F.broadcast(small.withColumnRenamed("_host", "_h")), F.col("_host") == F.col("_h"), how).drop("_h")
    keyed = small.select(fresh(F.col("_host")).alias("_h"), *[c for c in small.columns if c != "_host"])
    return rows.join(keyed, fresh(F.col("_host")) == F.col("_h"), how).drop("_h")


def _sized(hosts: DataFrame) -> tuple[DataFrame, int]:
    """A table of hosts, written, and its size in bytes."""
    out = materialise(hosts, "templates")
    size = F.length("_host") + 96
    for c, kind in out.dtypes:
        if kind.startswith("array"):
            size = size + 8 * F.greatest(F.size(c), F.lit(0))
    return out, out.agg(F.sum(size)).first()[0] or 0


def templates(pages: DataFrame) -> tuple[DataFrame, int]:
    """(_host, _constant, _menus, _region): hashed constant nodes, paths of links and path of the region, of each host that has
    any; and the table's size in bytes.  ``pages``: _host, _html.
    """
    pages_groups = materialise(pages.select("_host", "_html").mapInArrow(_slot_rows, _GROUPS), "slots")
    zipped = F.filter(F.arrays_zip("_paths", "_nodes", "_signs", "_links", "_votes"), lambda g: g["_votes"] & g["_nodes"].isNotNull())
    voting = pages_groups.select("_host", "_key", zipped.alias("g")).where("size(g) > 0")
    # one vote a content, however many copies it has; distinct first, so a hot node spreads over all tasks
    each = voting.select("_host", "_key", F.explode("g").alias("s")).select("_host", "_key", F.col("s._paths").alias("_path"), F.col("s._nodes").alias("_node")).distinct()
    nodes = each.groupBy("_host", "_path", "_node").agg(F.count("*").alias("_same"))
    paths = voting.select("_host", "_key", F.explode(F.array_distinct(F.col("g._paths"))).alias("_path")).distinct().groupBy("_host", "_path").agg(F.count("*").alias("_all"))
    # a content's node against the other contents
    often = nodes.where(F.col("_same") > MIN_VOTES)
    constant = often.join(paths, ["_host", "_path"]).where(F.col("_same") - 1 >= SHARE * (F.col("_all") - 1))
    # no more nodes a host than its pages share
    constant = constant.groupBy("_host").agg(F.sort_array(F.collect_list("_node")).alias("_constant"))
    # paths where links are nearly all of the text; of many contents, so no more than a host's pages share
    texts = voting.select("_host", F.explode("g").alias("s")).groupBy("_host", F.col("s._paths").alias("_path")).agg(F.sum("s._signs").alias("_s"), F.sum("s._links").alias("_l"))
    menus = texts.where((F.col("_s") > 0) & (F.col("_l") >= SHARE * F.col("_s"))).join(paths.where(F.col("_all") >= CONTENTS), ["_host", "_path"])
    menus = menus.groupBy("_host").agg(F.sort_array(F.collect_list("_path")).alias("_menus"))
    boiler, size = _sized(constant.join(menus, "_host", "full"))

    known = pages_groups.drop("_key")
    mass = _join_hosts(known, boiler, size, "left").select(*known.columns, "_constant", "_menus").mapInArrow(_region_rows, "_host string, _path long, _depth int, _mass long")
    sums = mass.groupBy("_host", "_path", "_depth").agg(F.sum("_mass").alias("_mass"))
    total = sums.where("_depth = 0").select(fresh(F.col("_host")).alias("_h"), F.col("_mass").alias("_whole"))
    contents = pages_groups.select("_host", "_key").distinct().groupBy("_host").agg(F.count("*").alias("_n")).where(F.col("_n") >= CONTENTS).select(fresh(F.col("_host")).alias("_i"))
    held = sums.where("_depth > 0").join(total, fresh(F.col("_host")) == F.col("_h")).where(F.col("_mass") >= REGION * F.col("_whole")).join(contents, fresh(F.col("_host")) == F.col("_i"), "left_semi")
    # two elements that hold most of the text lie in each other, so depth orders them
    region = held.groupBy("_host").agg(F.max(F.struct("_depth", "_path"))["_path"].alias("_region"))
    return _sized(boiler.join(region, "_host", "full"))


def main_text(page: str | None, constant: list[int] | None = None, menus: list[int] | None = None, region: int | None = None) -> str:
    """The text of a page's content slots: blocks in page order, joined by one space."""
    root, found = blocks(page or "")
    gone: set[int] = set()
    inside: set[int] = set()
    before: set[int] = set()
    if constant or menus or region is not None:
        hashes, links = set(constant or []), set(menus or [])
        within: list[bool] = []  # of each element: whether it is in the region
        tree = list(elements(root))
        holder = next((parent for path, parent, _ in tree if path == region), None)
        for path, parent, node in tree:
            within.append(path == region or parent >= 0 and within[parent])
            if not node.content and (path in links or hashes and node_hash(path, node) in hashes):
                gone.add(id(node))
            if within[-1]:
                inside.add(id(node))
            elif holder is not None and parent == holder and (node.tag in HEADINGS or node.tag == "p"):
                before.add(id(node))
    left = [(node, text) for node, text in found if not node.skip and id(node) not in gone]
    if any(id(node) in inside for node, _ in left):
        first = next(k for k, (node, _) in enumerate(left) if id(node) in inside)
        # an article or main element in the region is more exact than the region
        article = any(node.content for node, _ in left if id(node) in inside)
        left = [(node, text) for k, (node, text) in enumerate(left) if id(node) in inside and (node.content or not article) or k < first and id(node) in before]
    elif any(node.content for node, _ in left):
        left = [(node, text) for node, text in left if node.content]
    return " ".join(text for _, text in left)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row a row of ``pages``: id, url, text, n_chars (code points).

    A null or empty html has an empty text.  Pages without a host (null or odd url) count as one host.  Rows that share
    an id are pages of their own.  Copies of one content have one vote on a host's template; ids don't matter for it.
    """
    bound_batches(pages.sparkSession)
    slim = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), host_of(F.col(url_col)).alias("_host"), F.col(html_col).alias("_html"))
    found, size = templates(slim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [main_text(*(x.as_py() for x in row)) for row in zip(*batch.columns[2:])]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=["_id", "_url", "text", "n_chars"])

    joined = _join_hosts(slim, found, size, "left").select("_id", "_url", "_html", "_constant", "_menus", "_region")
    done = joined.mapInArrow(run, "_id long, _url string, text string, n_chars long")
    return done.select(F.col("_id").alias(id_col), F.col("_url").alias(url_col), "text", "n_chars")
