"""Main text of web pages with a site style tree.

1. Each page is parsed into its whole tree of block elements; only scripts, styles and form controls are left out. A
   block of text belongs to a *node*: the chain of block elements around it, each with its classes, on its host.
2. The pages of one host are merged into its style tree. Of each node it holds m, the pages that have it (pages with the
   same longest blocks, up to BODY of their text, are copies of one article and count once); the *styles*, its sequences of child elements, with
   their pages; and the texts found in it, with theirs.
3. Importance. Of a text seen on n pages: 1 - log(n') / log(m), where n' = n^2 / (n + EVIDENCE) is the lower confidence
   bound of n, so that a few pages prove nothing. Content importance of a node: the mean over all text below it, by
   characters. Presentation importance: the entropy of its styles over log(m). Composite importance of a node with l
   styles: (1 - DAMPING^l) * presentation + DAMPING^l * content.
4. From every page go the branches whose composite importance is under THRESHOLD (but for one that holds most of the
   page's text) and the single texts under it. A heading stays when the text that follows it does.
5. What a page says of itself counts as well, for varying adverts, reader comments and hosts of few pages: elements that
   are never article text by name (nav, aside, footer, ...) have no importance, nor have those marked by whole tokens of
   class and role (never ids), but for wrappers of most of the page's text, and unless little would be left. A page with
   ``article`` or ``main`` elements is reduced to them if they hold most of what is left.

Scale: a host may hold any share of the pages. The tree is made of partial aggregates over hashes of (node, text) and
(node, style). What it removes is a set of hashes; up to LOW_BROADCAST of them go to every executor, more are joined to
the pages by hash. For the tree alone, elements nested deeper than DEEP count as their ancestor at that depth.

Defined results: null html counts as empty and gives an empty text; pages without a host (null or broken url) form one
site; text outside of elements is kept, tags that never end are dropped; a page of which the tree would leave nothing
keeps its blocks; repeated rows each give a row (and count once in the tree); ids of any type, nulls too, are kept as
they are; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from functools import partial
from html import unescape
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halocline.llm._common import Table, whole_text_batches

THRESHOLD, DAMPING = 0.25, 0.9
#: Square of the normal quantile of a one-sided confidence of 95 %.
EVIDENCE = 2.7
BODY = 0.8
DEEP = 256
#: Removed branches and texts up to which they are sent to every executor, 8 bytes each.
LOW_BROADCAST = 1 << 20

TAG = re.compile(r"""<(?:!--(?:.*?-->|.*\Z)|(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*+)>|[!?][^>]*>)""", re.DOTALL)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
HOST = re.compile(r"^[a-z][a-z0-9+.-]*://(?:[^@/?#]*@)?([^/:?#]+)", re.IGNORECASE)
UNENDED = re.compile(r"<[a-zA-Z/!?]")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp template".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split())
#: Never part of the tree; and never article text, but in the tree.
LEFT_OUT = frozenset("button fieldset form head iframe input label legend noscript object option script select style svg template textarea title canvas audio video".split())
PRUNED = frozenset("aside dialog footer menu nav search".split())
MAIN = frozenset(("article", "main"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A class token or role marks what is not article text if it is made of these words and of NEUTRAL ones only.
NOISE = frozenset(
    "ad|ads|adv|advert|adverts|advertisement|advertising|adsense|banner|breadcrumb|breadcrumbs|comment|comments|commentlist|respond|replies|reply|disqus|complementary|contentinfo|consent|cookie|cookies|copyright|disclaimer|footer|gdpr|header|login|masthead|menu|menubar|modal|nav|navbar|navigation|newsletter|notice|notices|alert|overlay|pager|pagination|popup|promo|promoted|promotion|recommended|related|search|share|sharing|sidebar|sidebars|signup|social|sponsor|sponsored|subscribe|toolbar|topbar|widget|widgets".split("|")
)
NEUTRAL = frozenset("area bar block bottom box container inner left link links list right section site slot top unit".split())
#: A marked element of several blocks with more than this share of the page's text (nested marked ones apart) is a
#: wrapper, and stays.
WRAPPER = 0.5
#: Pruning that leaves less than this share of the text is not done; nor is a reduction to article and main below MOST.
LEAST, MOST = 0.2, 0.5
#: Starting one of these ends an open one of the same set.
SIBLINGS = {"p": "p", "li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr", "td": "td th", "th": "td th", "option": "option"}
#: Starting one of these ends an open paragraph.
ENDS_P = BLOCK - frozenset("body head html td th tr tbody thead tfoot option optgroup legend summary figcaption".split())
SCOPES = frozenset("table ul ol dl article section div body td th main nav aside blockquote".split())


def _hash(text: str, seed: int) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), seed)


class Block(NamedTuple):
    """``chain``: the node and its ancestors, outermost first; ``item``: the text in its node; ``noise``: numbers of the
    marked elements around it."""

    chain: tuple[int, ...]
    item: int
    text: str
    pruned: bool
    main: bool
    heading: bool
    noise: tuple[int, ...]


class Node:
    __slots__ = ("name", "chain", "style", "out", "pruned", "main", "noise")

    def __init__(self, name: str, chain: tuple[int, ...], out: bool, pruned: bool, main: bool, noise: tuple[int, ...]):
        self.name, self.chain, self.style, self.out, self.pruned, self.main, self.noise = name, chain, 0, out, pruned, main, noise


def is_noise(attributes: dict[str, str]) -> bool:
    """Whether a class token or role (never an id) is made of NOISE words, neutral ones apart."""
    for token in f"{attributes.get('class', '')} {attributes.get('role', '')}".lower().split():
        words = [w.rstrip("0123456789") for w in re.split("[_-]+", token)]
        if any(w in NOISE for w in words) and all(w in NOISE or w in NEUTRAL or not w for w in words):
            return True
    return False


def parse(html: str, site: int = 0) -> tuple[list[Block], set[tuple[int, int]]]:
    """Blocks in page order, and (node, style) of every block element of the tree."""
    out: list[Block] = []
    styles: set[tuple[int, int]] = set()
    marked = 0
    stack = [Node("", (site,), False, False, False, ())]
    text: list[str] = []
    owner = stack[0]

    def flush() -> None:
        if text:
            block = " ".join("".join(text).split())
            if block:
                out.append(Block(owner.chain, _hash(block, owner.chain[-1]), block, owner.pruned, owner.main, owner.name in HEADINGS, owner.noise))
            text.clear()

    def add(raw: str) -> None:
        nonlocal owner
        if raw and not stack[-1].out:
            if not text:
                owner = stack[-1]
            text.append(unescape(raw) if "&" in raw else raw)

    def close(i: int) -> None:
        styles.update((n.chain[-1], n.style) for n in stack[i:] if not n.out)
        del stack[i:]

    at, end = 0, len(html)
    while at < end:
        m = TAG.search(html, at)
        if m is None:
            rest = html[at:]
            cut = UNENDED.search(rest)  # a tag that never ends
            add(rest if cut is None else rest[: cut.start()])
            break
        if m.start() > at:
            add(html[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if m[1]:
            if name == "br":
                add(" ")
                continue
            if name in BLOCK:
                flush()
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == name:
                    if (stack[i].out, stack[i].pruned) != (stack[i - 1].out, stack[i - 1].pruned):
                        flush()
                    close(i)
                    break
                if name not in BLOCK and stack[i].name in BLOCK:
                    break
            continue
        if name == "br":
            add(" ")
            continue
        if name in RAW and name not in ("noscript", "template"):
            stop = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.IGNORECASE).search(html, at)
            at = stop.end() if stop else end
            continue
        block = name in BLOCK
        if block:
            flush()
        if name in VOID:
            continue
        if block and name in ENDS_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == "p":
                    close(i)
                    break
                if stack[i].name in SCOPES:
                    break
        if name in SIBLINGS:
            same = SIBLINGS[name].split()
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name in same:
                    close(i)
                    break
                if stack[i].name in SCOPES and stack[i].name not in ("td", "th") or stack[i].name in ("ul", "ol", "table", "dl"):
                    break
        parent = stack[-1]
        attributes = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(m[3])} if m[3] else {}
        noisy = name not in ("html", "body", "article", "main") and is_noise(attributes)
        left_out = parent.out or name in LEFT_OUT or "hidden" in attributes
        # Marked elements within a line are pruned at once: they are no wrappers.
        pruned = parent.pruned or name in PRUNED or (noisy and not block) or (name == "header" and not parent.main)
        marked += noisy
        main = parent.main or name in MAIN or attributes.get("role", "").lower() in ("main", "article")
        if block or (left_out, pruned) != (parent.out, parent.pruned):
            if not block:
                flush()
            chain = parent.chain
            if block and not left_out and len(chain) < DEEP:
                kind = " ".join([name, *sorted(attributes.get("class", "").split())])
                parent.style = _hash(kind, parent.style)
                chain = (*chain, _hash(kind, chain[-1]))
            stack.append(Node(name, chain, left_out, pruned, main, (*parent.noise, marked) if noisy and block else parent.noise))
    flush()
    close(0)
    return out, styles


def own_choice(blocks: list[Block]) -> list[bool]:
    """Which blocks may be article text by what the page says of itself."""
    size = lambda some: sum(len(b.text) for b in some)
    free = [b for b in blocks if not b.pruned]
    total = size(free)
    own: dict[int, list[int]] = {}
    for b in free:
        if b.noise:
            own.setdefault(b.noise[-1], []).append(len(b.text))
    wrappers = {k for k, n in own.items() if len(n) > 1 and sum(n) > WRAPPER * total}
    kept = [not b.pruned and wrappers.issuperset(b.noise) for b in blocks]
    some = [b for b, k in zip(blocks, kept, strict=True) if k]
    if size(some) < LEAST * total:
        kept, some = [not b.pruned for b in blocks], free
    main = size(b for b in some if b.main)
    if main and main >= MOST * size(some):
        kept = [k and b.main for k, b in zip(kept, blocks, strict=True)]
    return kept


def article_blocks(html: str) -> list[str]:
    """Texts of the blocks that may be article text, as far as the page alone can tell."""
    blocks, _ = parse(html)
    return [b.text for b, kept in zip(blocks, own_choice(blocks), strict=True) if kept]


def longest_blocks(texts: list[str]) -> list[str]:
    """The longest texts, which hold BODY of all characters."""
    out, left = [], BODY * sum(map(len, texts))
    for t in sorted(texts, key=len, reverse=True):
        if left <= 0:
            break
        out.append(t)
        left -= len(t)
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


PARSED = "site long, key long, texts array<string>, items array<long>, chars array<int>, chains array<int>, flags array<int>, ways array<array<long>>, styles array<struct<node:long,style:long>>"


def _parse(batches):
    for batch in batches:
        columns: dict[str, list] = {name.split()[0]: [] for name in re.split(r", (?=[a-z]+ )", PARSED)}
        for url, html in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            m = HOST.match(url or "")
            site = _hash(m[1].lower() if m else "", 1)
            blocks, styles = parse(html or "", site)
            kept = own_choice(blocks)
            ways: dict[tuple[int, ...], int] = {}
            which = [ways.setdefault(b.chain, len(ways)) for b in blocks]
            longest = longest_blocks([b.text for b, k in zip(blocks, kept, strict=True) if k])
            columns["site"].append(_signed(site))
            columns["key"].append(_signed(_hash("\n".join(longest), site)))
            # A text that the page itself rules out is only a hash from here on.
            columns["texts"].append([b.text if k else None for b, k in zip(blocks, kept, strict=True)])
            columns["items"].append([_signed(b.item) for b in blocks])
            columns["chars"].append([len(b.text) for b in blocks])
            columns["chains"].append(which)
            columns["flags"].append([int(b.heading) for b in blocks])
            columns["ways"].append([[_signed(x) for x in way] for way in ways])
            columns["styles"].append([{"node": _signed(a), "style": _signed(b)} for a, b in sorted(styles)])
        struct = pa.struct([("node", pa.int64()), ("style", pa.int64())])
        kinds = dict(site=pa.int64(), key=pa.int64(), texts=pa.list_(pa.string()), items=pa.list_(pa.int64()), chars=pa.list_(pa.int32()), chains=pa.list_(pa.int32()), flags=pa.list_(pa.int32()), ways=pa.list_(pa.list_(pa.int64())), styles=pa.list_(struct))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(v, kinds[k]) for k, v in columns.items()]], names=["id", "url", *columns])


def _sure(n: Column) -> Column:
    """Log of the lower confidence bound of a count of pages, 0 at least."""
    return F.log(F.greatest(F.lit(1.0), n * n / (n + EVIDENCE)))


def importances(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, pages, composite) of every node and (item, pages, importance) of every text seen on several pages."""
    styles = parsed.select("key", F.explode("styles").alias("s")).groupBy("s.node", "s.style").agg(F.countDistinct("key").cast("double").alias("n"))
    nodes = styles.groupBy("node").agg(F.sum("n").alias("pages"), F.sum(F.col("n") * F.log("n")).alias("spread"), F.count("*").alias("styles"))
    wide = F.when(F.col("pages") > 1, F.log("pages"))
    nodes = Table(nodes.select("node", "pages", wide.alias("wide"), F.coalesce((wide - F.col("spread") / F.col("pages")) / wide, F.lit(1.0)).alias("presentation"), F.pow(F.lit(DAMPING), F.col("styles")).alias("damping")), "pages-nodes").df
    blocks = parsed.select("key", "ways", F.explode(F.arrays_zip("items", "chars", "chains")).alias("b"))
    texts = blocks.select("key", F.element_at(F.get("ways", F.col("b.chains")), -1).alias("node"), F.col("b.items").alias("item"), F.col("b.chars").alias("chars"))
    texts = Table(texts.groupBy("node", "item").agg(F.countDistinct("key").cast("double").alias("n"), F.max("chars").alias("chars")), "pages-texts").df
    weight = F.col("n") * F.col("chars")
    leaves = texts.groupBy("node").agg(F.sum(weight).alias("weight"), F.sum(weight * _sure(F.col("n"))).alias("common")).join(nodes.select("node", "wide"), "node")
    leaves = leaves.select("node", "weight", (F.col("weight") - F.coalesce(F.col("common") / F.col("wide"), F.lit(0.0))).alias("own"))
    ways = parsed.select(F.explode("ways").alias("way")).groupBy(F.element_at("way", -1).alias("node")).agg(F.first("way").alias("way"))
    content = leaves.join(ways, "node").select(F.explode("way").alias("node"), "weight", "own").groupBy("node").agg((F.sum("own") / F.sum("weight")).alias("content"))
    composite = (1 - F.col("damping")) * F.col("presentation") + F.col("damping") * F.col("content")
    single = texts.where("n > 1").join(nodes, "node").select("item", F.col("n").alias("pages"), F.coalesce(1 - _sure(F.col("n")) / F.col("wide"), F.lit(1.0)).alias("importance"))
    return nodes.join(content, "node").select("node", "pages", composite.alias("composite")), single


def low_importance(parsed: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(low): hashes of the nodes and texts whose importance is under the threshold; ``parsed`` is read several times."""
    nodes, texts = importances(parsed)
    return nodes.where(F.col("composite") < threshold).select(F.col("node").alias("low")).union(texts.where(F.col("importance") < threshold).select("item"))


def choose(texts: list[str | None], items: list[int], chars: list[int], chains: list[int], headings: list[int], ways: list[list[int]], low) -> list[str]:
    """The texts that stay, given the hashes ``low`` (anything with ``in``)."""
    open_ = [i for i, t in enumerate(texts) if t is not None]
    total = sum(chars[i] for i in open_)
    below: dict[int, int] = {}
    for i in open_:
        for node in ways[chains[i]]:
            below[node] = below.get(node, 0) + chars[i]
    cut = {node for node, n in below.items() if n <= WRAPPER * total and node in low}
    stays = {i: items[i] not in low and cut.isdisjoint(ways[chains[i]]) for i in open_}
    for at, i in reversed(list(enumerate(open_))):
        around = ways[chains[i]][:-1]
        if headings[i] and not stays[i] and cut.isdisjoint(around):
            after = next((j for j in open_[at + 1 :] if not headings[j] or ways[chains[j]][: len(around)] != around), None)
            stays[i] = after is not None and ways[chains[after]][: len(around)] == around and stays[after]
    out = [texts[i] for i in open_ if stays[i]]
    return out or [texts[i] for i in open_]


class _Sorted:
    """A sorted array of hashes as a set."""

    def __init__(self, values: np.ndarray):
        self.values = values

    def __contains__(self, x: int) -> bool:
        at = int(np.searchsorted(self.values, x))
        return at < len(self.values) and int(self.values[at]) == x


def _choose(low: Broadcast | None, batches):
    every = _Sorted(low.value) if low is not None else None
    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("texts", "items", "chars", "chains", "flags", "ways", "low")]
        got = ["\n".join(choose(*row, every if every is not None else set(own or ()))) for *row, own in zip(*columns, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got, pa.string())], names=["id", "url", "text"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", threshold: float = THRESHOLD) -> DataFrame:
    """id, url, text, n_chars for every page."""
    spark = pages.sparkSession
    whole_text_batches(spark)
    kind = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    parsed = Table(rows.mapInArrow(_parse, f"id {kind}, url string, {PARSED}"), "pages-parsed").df
    low = Table(low_importance(parsed, threshold).distinct(), "pages-low").df
    needed = ["id", "url", "texts", "items", "chars", "chains", "flags", "ways"]
    if low.count() <= LOW_BROADCAST:
        values = spark.sparkContext.broadcast(np.sort(np.array([r[0] for r in low.collect()], dtype=np.int64)))
        chosen = parsed.select(*needed, F.lit(None).cast("array<long>").alias("low"))
    else:
        # Rows that share (id, key) share their hashes as well, so the join is exact whatever repeats.
        values, row = None, F.xxhash64("id", "key")
        hashes = parsed.select(row.alias("row"), F.explode(F.array_distinct(F.concat("items", F.flatten("ways")))).alias("low"))
        found = hashes.join(low, "low").groupBy("row").agg(F.collect_set("low").alias("low"))
        chosen = parsed.withColumn("row", row).join(found, "row", "left").select(*needed, "low")
    text = chosen.mapInArrow(partial(_choose, values), f"id {kind}, url string, text string")
    return text.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text").withColumn("n_chars", F.length("text").cast("long"))
