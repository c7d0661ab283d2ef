"""SimHash near-duplicates with a Gray-order hierarchical index.

A document's fingerprint has a bit set where over half of its shingle hashes have it. Two searches share one engine:

* ``simhash_groups``: 64-bit fingerprints linked at ``max_bits`` differing bits or fewer. Exact: the bits are cut into
  BLOCKS blocks, and two linked fingerprints differ in at most ``max_bits // BLOCKS`` bits of one of them, so for each
  block the whole table is indexed in the Gray order of the fingerprints turned to begin with that block (a route).
* ``near_duplicate_groups``: shingle similarity (Jaccard) of ``similarity`` or more. One fingerprint word cannot tell
  0.8 from less, so fingerprints are several words long, as many as give RECALL of pairs just at the threshold an equal
  band of bits; a band is a route. Candidates differ in at most the bits expected at the threshold, for the shingle
  counts where that is most, plus five standard deviations. Documents of FEW shingles or fewer flip more bits, so they
  also meet on an exact route: each of the rarest shingles of which two similar documents must share one (prefix filter),
  where their sets are compared. The candidates' connected sets are then checked exactly: within each, documents are linked when their shingle sets
  are as similar as asked for, so no document is grouped that has no such partner.

The index of a route is a tree over the Gray order, where neighbours share long bit patterns. Its upper nodes are ranges
of that order: prefixes of the block, as long as keep a range near RANGE_ROWS of n spread fingerprints. Ranges are the
tasks; two ranges meet only if their prefixes differ in no more bits than the block may, so all other pairs of ranges are
pruned before anything is read. Within a range, FAN neighbours make a node, FAN nodes an upper node; a node holds the
pattern of the bits that all below it agree on. Of a pair of nodes, differences add up from the block's and from all
agreed bits: as soon as either exceeds its limit the pair is dropped whole, else the search goes one level down, where
more bits are agreed on.

Scale: equal fingerprints are folded into one row before the search. A range with more than its share of rows is cut into
chunks of at most MOST_ROWS, and pairs of chunks go to different tasks. A task sends a star for each connected set it
found, never pairs, and the stars go to ``connected_components``. The exact check reads the shingles of documents with a
candidate partner only; a connected set with more than its share of rows or shingles is cut into chunks in the same way.

Defined results: null text counts as empty; a text without words has fingerprint zero, and links like any other; equal
texts always share a component; ids must be whole numbers (others are an error) and should be unique (rows of one id
share their component); rows with a null id have a fingerprint, no component and link nothing, and the filter keeps them;
an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import lru_cache, partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halocline.llm._common import SMALL_IDS, Table, attach_groups, whole_text_batches, without_ids
from halocline.llm._components import connected_components, label_min, star_edges

SEED = 42
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
FAN = 8
#: Blocks of the exact search, and rows of a range that its prefix length aims at.
BLOCKS, RANGE_ROWS = 3, 2048
#: Rows of one range or band that stay together, at least and at most; between them, longer ones number LONG_ROUTES.
ROUTE_ROWS, MOST_ROWS, LONG_ROUTES = 4096, 1 << 16, 20_000
#: Share of the pairs just at the similarity threshold that must meet on a band.
RECALL = 0.99
#: Documents of so many shingles or fewer take the exact route too; one in COMMON shingles there may be a common one.
FEW, COMMON = 16, 1 << 16
SHINGLES_AT_ONCE = 1 << 15
#: Rows and shingles of a connected set that the exact check keeps together, at least.
SET_ROWS, SET_SHINGLES = 1024, 1 << 20
#: And at most.
MOST_SET_ROWS, MOST_SET_SHINGLES = 1 << 13, 1 << 23


def shingle_digests(text: str, size: int):
    """XXH64 digests (big-endian) of the word shingles, joined, some at a time."""
    words = text.encode().translate(LOWER).split()
    digest = xxhash.xxh64_digest
    if len(words) < size:
        if words:
            yield digest(b" ".join(words), SEED)
        return
    joined = b" ".join(words)
    starts = np.zeros(len(words) + 1, dtype=np.int64)
    np.cumsum([len(w) + 1 for w in words], out=starts[1:])
    ends = (starts[size:] - 1).tolist()
    starts = starts.tolist()
    for at in range(0, len(ends), SHINGLES_AT_ONCE):
        part = slice(at, at + SHINGLES_AT_ONCE)
        yield b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[part], ends[part], strict=False)])


def _mix(h: np.ndarray, word: int) -> np.ndarray:
    """An independent hash for each further word of the fingerprint."""
    h = h + np.uint64(word * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def fingerprint(text: str, size: int, words: int = 1) -> bytes:
    """8 * words bytes, big-endian; one word counts repeated shingles, several take each shingle once (for Jaccard)."""
    counts, n = np.zeros((words, 64), dtype=np.int64), 0
    parts = shingle_digests(text, size)
    if words > 1:
        base = shingle_set(text, size)
        parts = (base[at : at + SHINGLES_AT_ONCE].astype(">u8").tobytes() for at in range(0, len(base), SHINGLES_AT_ONCE))
    for data in parts:
        raw = np.frombuffer(data, dtype=np.uint8).reshape(-1, 8)
        n += len(raw)
        hashes = raw.view(">u8").ravel().astype(np.uint64) if words > 1 else None
        for w in range(words):
            own = raw if w == 0 else _mix(hashes, w).astype(">u8").view(np.uint8).reshape(-1, 8)
            counts[w] += np.unpackbits(own, axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > n).tobytes() if n else bytes(8 * words)


def _fingerprints(size: int, words: int, batches):
    for batch in batches:
        got = [fingerprint(t, size, words) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.binary())], names=["doc", "fp"])


# ---- routes ----------------------------------------------------------------------------------------------------


def gray_routes(n: int, max_bits: int) -> tuple[list[tuple[int, int]], int, int]:
    """Blocks (first bit from the top, bits), the most bits that differ in one of them, and the ranges' prefix length."""
    edges = [round(64 * i / BLOCKS) for i in range(BLOCKS + 1)]
    prefix = min(20, max(0, math.ceil(math.log2(max(n, 1) / RANGE_ROWS))))
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)], max_bits // BLOCKS, prefix


def _ranges(blocks: list[tuple[int, int]], most: int, prefix: int, batches):
    """(fp, rep) -> a row for each range that the fingerprint may meet a partner in: its own (key) and the other's."""
    flips = [sum(1 << i for i in bits) for k in range(most + 1) for bits in combinations(range(prefix), k)]
    for batch in batches:
        if not len(batch):
            continue
        word = np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype=">u8").astype(np.uint64)
        for route, (first, _) in enumerate(blocks):
            turned = (word << np.uint64(first)) | (word >> np.uint64(64 - first)) if first else word
            key = (turned >> np.uint64(64 - prefix)).astype(np.int64) if prefix else np.zeros(len(word), dtype=np.int64)
            data = turned.astype(">u8").tobytes()
            fp = pa.array([data[i : i + 8] for i in range(0, len(data), 8)], pa.binary())
            for flip in flips:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(word), route, dtype=np.int32)), pa.array(key), pa.array(key ^ flip), fp, batch.column(1)], names=["route", "key", "other", "fp", "rep"])


def flip_rate(similarity: float) -> float:
    """Expected share of differing bits: the angle between the two shingle vectors, over pi."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


@lru_cache
def worst_flip_rate(similarity: float, few: int) -> float:
    """The largest expected share of differing bits of pairs of ``similarity`` with over ``few`` shingles in one of them."""
    worst = flip_rate(similarity)

    def over(s: int, own: int, n: int) -> float:
        return sum(math.comb(own, i) for i in range(own + 1) if 2 * (s + i) > n) / 2**own

    for shared in range(1, 4 * few):
        rest = math.floor(shared / similarity + 1e-9) - shared
        for x in range(rest // 2 + 1):
            y = rest - x
            if shared + y <= few:
                continue
            sets = [(math.comb(shared, s) / 2**shared, over(s, x, shared + x), over(s, y, shared + y)) for s in range(shared + 1)]
            worst = max(worst, sum(p * (a * (1 - b) + b * (1 - a)) for p, a, b in sets))
    return worst


def band_plan(n: int, similarity: float) -> tuple[int, list[list[int]], int]:
    """(words of the fingerprint, masks, most differing bits)."""
    bits = min(24, max(12, math.ceil(math.log2(max(n, 1) / 64))))
    f = worst_flip_rate(similarity, FEW)
    bands = math.ceil(math.log(1 - RECALL) / math.log(1 - (1 - f) ** bits))
    per_word = 64 // bits
    words = math.ceil(bands / per_word)
    masks = []
    for b in range(bands):
        mask = [0] * words
        mask[b // per_word] = ((1 << bits) - 1) << (b % per_word * bits)
        masks.append(mask)
    return words, masks, math.floor(64 * words * f + 5 * math.sqrt(64 * words * f * (1 - f)))


def _route(masks: list[list[int]], batches):
    """(fp, rep) -> a row for each band: (route, key, other = key, fp, rep)."""
    for batch in batches:
        if not len(batch):
            continue
        words = np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype=">u8").astype(np.uint64).reshape(len(batch), -1)
        for r, mask in enumerate(masks):
            key = np.zeros(len(batch), dtype=np.uint64)
            for w, m in enumerate(mask):
                if m:
                    key ^= words[:, w] & np.uint64(m)
            keys = pa.array(key.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(batch), r, dtype=np.int32)), keys, keys, batch.column(0), batch.column(1)], names=["route", "key", "other", "fp", "rep"])


# ---- the index -------------------------------------------------------------------------------------------------


def gray_rank(words: np.ndarray) -> np.ndarray:
    """Rank of each fingerprint (n, words; first word highest) in the sequence of Gray codes."""
    out = words.copy()
    for s in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(s)
    odd = np.zeros(len(words), dtype=bool)
    for w in range(words.shape[1]):
        out[odd, w] = ~out[odd, w]
        odd = (out[:, w] & np.uint64(1)).astype(bool)
    return out


def _levels(words: np.ndarray, group: np.ndarray):
    """Node levels from single fingerprints up to one node a group: (pattern, agreed bits, first child)."""
    low = high = words
    levels = [(words, np.full_like(words, np.uint64(0xFFFFFFFFFFFFFFFF)), None)]
    while True:
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        if len(first) == len(group):
            return levels, group
        size = np.diff(np.r_[first, len(group)])
        within = np.arange(len(group)) - np.repeat(first, size)
        heads = np.flatnonzero(within % FAN == 0)
        low, high = np.bitwise_and.reduceat(low, heads, axis=0), np.bitwise_or.reduceat(high, heads, axis=0)
        levels.append((low, ~(low ^ high), np.r_[heads, len(group)]))
        group = group[heads]


def linked_stars(words: np.ndarray, group: np.ndarray, reps: np.ndarray, max_bits: int, block: tuple[int, int] = (64, 64), side: np.ndarray | None = None, at_once: int = 1 << 19, tally: Counter | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links within groups (rows sorted by group), as star edges between ``reps``.

    ``block``: (bits, most): of the first ``bits`` bits at most ``most`` may differ. ``side`` (0 or 1): a group with both
    sides is searched between them only. ``tally`` counts the tests of nodes and of leaves.
    """
    tree = group * 2 + (0 if side is None else side)
    order = np.lexsort((*gray_rank(words).T[::-1], tree))
    words, reps, tree = words[order], reps[order], tree[order]
    levels, roots = _levels(words, tree)
    high = np.zeros(words.shape[1], dtype=np.uint64)
    high[0] = np.uint64(((1 << block[0]) - 1) << (64 - block[0]))
    limited = block[1] < block[0]
    # Roots are in the order of (group, side): of a group with two, the pair of both; else the pair of the root itself.
    same = roots[1:] // 2 == roots[:-1] // 2
    first = np.flatnonzero(np.r_[True, ~same]) if len(roots) else np.zeros(0, dtype=np.int64)
    a, b = first, first + np.r_[same, False][first] if len(roots) else first
    stack = [(len(levels) - 1, a, b.astype(np.int64))]
    found_a, found_b, held = [], [], 0
    while stack:
        level, a, b = stack.pop()
        if level == 0:
            keep = a != b
            found_a.append(a[keep])
            found_b.append(b[keep])
            held += len(a)
            if held > 1 << 21:
                label = label_min(len(words), np.concatenate(found_a), np.concatenate(found_b))
                moved = np.flatnonzero(label != np.arange(len(words)))
                found_a, found_b, held = [moved], [label[moved]], len(moved)
            continue
        child = levels[level][2]
        pattern, agreed, _ = levels[level - 1]
        n_a, n_b = child[a + 1] - child[a], child[b + 1] - child[b]
        cells = n_a * n_b
        until = np.cumsum(cells)
        cuts = [0, *(np.searchsorted(until, np.arange(at_once, until[-1], at_once)) + 1), len(a)] if len(a) else [0]
        for x, y in zip(cuts, cuts[1:], strict=False):
            if y <= x:
                continue
            n = cells[x:y]
            pair = np.repeat(np.arange(x, y), n)
            cell = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
            i, j = child[a[pair]] + cell // n_b[pair], child[b[pair]] + cell % n_b[pair]
            once = i <= j
            i, j = i[once], j[once]
            apart = (pattern[i] ^ pattern[j]) & agreed[i] & agreed[j]
            keep = np.bitwise_count(apart).sum(axis=1, dtype=np.int64) <= max_bits
            if limited:
                keep &= np.bitwise_count(apart & high).sum(axis=1, dtype=np.int64) <= block[1]
            if tally is not None:
                tally["leaves" if level == 1 else "nodes"] += len(i)
                tally["pruned"] += int((~keep).sum()) if level > 1 else 0
            if keep.any():
                stack.append((level - 1, i[keep], j[keep]))
    if not found_a:
        return reps[:0], reps[:0]
    a, b = np.concatenate(found_a), np.concatenate(found_b)
    touched, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    return star_edges(reps[touched], at[: len(a)], at[len(a) :])


GROUP = ["route", "lo", "hi", "a", "b"]


def _search(max_bits: int, blocks: list[tuple[int, int]], batches, rows_at_once: int = 1 << 17):
    """Rows sorted by GROUP -> star edges; a group is never cut. ``blocks``: (bits, most) of each route, if limited."""

    def solve(table: pa.Table):
        us, vs = [], []
        route = table.column("route").to_numpy()
        cuts = [0, *(np.flatnonzero(route[1:] != route[:-1]) + 1).tolist(), len(route)]
        for x, y in zip(cuts, cuts[1:], strict=False):
            part = table.slice(x, y - x)
            words = np.frombuffer(b"".join(part.column("fp").to_pylist()), dtype=">u8").astype(np.uint64).reshape(part.num_rows, -1)
            keys = np.stack([part.column(c).to_numpy().astype(np.int64) for c in GROUP], axis=1)
            group = np.cumsum(np.r_[0, (keys[1:] != keys[:-1]).any(axis=1)])
            u, v = linked_stars(words, group, part.column("rep").to_numpy(), max_bits, blocks[route[x]] if blocks else (64, 64), part.column("side").to_numpy().astype(np.int64))
            us.append(u)
            vs.append(v)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], names=["u", "v"])

    held, n = [], 0
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        n += len(batch)
        if n < rows_at_once:
            continue
        table = pa.Table.from_batches(held)
        same = np.ones(n, dtype=bool)
        for c in GROUP:
            same &= table.column(c).to_numpy() == table.column(c)[n - 1].as_py()
        cut = n - int(same.sum())
        if cut:
            yield solve(table.slice(0, cut))
            held = table.slice(cut).combine_chunks().to_batches()
            n -= cut
    if held:
        yield solve(pa.Table.from_batches(held))


# ---- the exact check -------------------------------------------------------------------------------------------


def shingle_set(text: str, size: int) -> np.ndarray:
    """Sorted hashes of the different shingles."""
    found = [np.unique(np.frombuffer(data, dtype=">u8").astype(np.uint64)) for data in shingle_digests(text, size)]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.uint64)


def _shingle_sets(size: int, batches):
    for batch in batches:
        got = [shingle_set(t, size) for t in batch.column(2).to_pylist()]
        arrays = [batch.column(0), batch.column(1), pa.array([s.tobytes() for s in got], pa.binary()), pa.array([len(s) for s in got], pa.int64())]
        yield pa.RecordBatch.from_arrays(arrays, names=["doc", "component", "shingles", "n"])


def similar_labels(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """Position of the first set in each one's component, over links of ``similarity`` or more; empty sets are equal."""
    n, size = len(sets), np.array([len(s) for s in sets])
    ends = np.r_[0, np.cumsum(size)]
    column = np.unique(np.concatenate(sets), return_inverse=True)[1]
    seen, label = np.zeros(int(column.max()) + 1 if len(column) else 0, dtype=bool), np.arange(n)
    for i in range(n):
        if (label == label[0]).all():
            break
        own = column[ends[i] : ends[i + 1]]
        seen[own] = True
        upto = np.r_[0, np.cumsum(seen[column])]
        seen[own] = False
        common = upto[ends[1:]] - upto[ends[:-1]]
        joined = np.unique(label[common >= similarity * (size + size[i] - common) - 1e-9])
        if len(joined) > 1:
            label[np.isin(label, joined)] = joined[0]
    return label


def _similar_stars(similarity: float, batches):
    """Rows (component, a, b, doc, shingles) sorted by the first three -> star edges of each group."""
    us, vs, docs, sets, key = [], [], [], [], None

    def solve() -> None:
        ids = np.array(docs, dtype=np.int64)
        label = similar_labels(sets, similarity)
        moved = label != np.arange(len(label))
        us.append(ids[moved])
        vs.append(ids[label[moved]])

    for batch in batches:
        for *now, doc, data in zip(*[batch.column(c).to_pylist() for c in ("component", "a", "b", "doc", "shingles")], strict=True):
            if now != key:
                if docs:
                    solve()
                docs, sets, key = [], [], now
            docs.append(doc)
            sets.append(np.frombuffer(data, dtype=np.uint64))
    if docs:
        solve()
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], names=["u", "v"])


def _few_sets(size: int, batches):
    for batch in batches:
        docs, sets = [], []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            # Every text: one of many words may still have few different shingles.
            if 0 < len(found := shingle_set(text, size)) <= FEW:
                docs.append(doc)
                sets.append(found.view(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["doc", "grams"])


def _prefixes(similarity: float, common: dict[int, int], batches):
    """(doc, grams) -> a row for each of the rarest shingles, of which similar documents share one."""
    for batch in batches:
        rows = []
        for doc, grams in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            data = np.array(grams, dtype=np.int64).tobytes()
            order = sorted(grams, key=lambda g: (common.get(g, 0), g))
            rows.extend((doc, g, data, len(grams)) for g in order[: len(grams) - math.ceil(similarity * len(grams) - 1e-9) + 1])
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.int64()), strict=True)]
        yield pa.RecordBatch.from_arrays(arrays, names=["doc", "component", "shingles", "n"])


def _few_edges(docs: DataFrame, id_col: str, text_col: str, size: int, similarity: float) -> DataFrame:
    """Star edges (u, v) of all similar documents of FEW shingles or fewer; exact."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    few = Table(texts.mapInArrow(partial(_few_sets, size), "doc long, grams array<long>"), "near-few")
    total = few.df.agg(F.coalesce(F.sum(F.size("grams")), F.lit(0))).first()[0]
    counts = few.df.select(F.explode("grams").alias("g")).groupBy("g").agg(F.count("*").alias("n"))
    common = {r["g"]: r["n"] for r in counts.where(F.col("n") > max(64, total // COMMON)).collect()}  # COMMON rows at most
    sets = Table(few.df.mapInArrow(partial(_prefixes, similarity, common), "doc long, component long, shingles binary, n long"), "near-prefixes")
    return _exact_edges(sets, sets.df.count(), similarity)


def _exact_components(docs: DataFrame, loose: Table, id_col: str, text_col: str, size: int, similarity: float) -> DataFrame:
    """(doc, component) of all documents, from candidate sets ``loose`` (doc, component)."""
    groups = Table(loose.df.groupBy("component").agg(F.count("*").alias("rows")).where("rows > 1"), "near-groups")
    total = groups.df.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    members = Table(attach_groups(loose.df, groups.df, ["component"], "rows", total).where("rows is not null").select("doc", "component"), "near-members")
    chosen = F.broadcast(members.df) if total <= SMALL_IDS else members.df
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(chosen, "doc").select("doc", "component", "text")
    sets = Table(texts.mapInArrow(partial(_shingle_sets, size), "doc long, component long, shingles binary, n long"), "near-sets")
    edges = _exact_edges(sets, total, similarity).unionByName(_few_edges(docs, id_col, text_col, size, similarity))
    found = connected_components(edges).select(F.col("node").alias("doc"), F.col("component").alias("exact"))
    return loose.df.select("doc").join(found, "doc", "left").select("doc", F.coalesce("exact", "doc").alias("component"))


def _exact_edges(sets: Table, total: int, similarity: float) -> DataFrame:
    """Star edges (u, v) within each component of ``sets`` (doc, component, shingles, n; ``total`` rows)."""
    all_shingles = sets.df.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    rows = min(MOST_SET_ROWS, max(SET_ROWS, total // LONG_ROUTES))
    shingles = min(MOST_SET_SHINGLES, max(SET_SHINGLES, all_shingles // LONG_ROUTES))
    parts = F.greatest(F.ceil(F.count("*") / rows), F.ceil(F.sum("n") / shingles)).cast("int")
    long = Table(sets.df.groupBy("component").agg(parts.alias("chunks")).where("chunks > 1"), "near-long")
    chunked = (
        sets.df.join(small(long.df), "component", "left")
        .withColumn("chunks", F.coalesce("chunks", F.lit(1)))
        .withColumn("own", F.pmod(F.xxhash64("doc"), F.col("chunks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select("component", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "doc", "shingles")
    )
    group = ["component", "a", "b"]
    return chunked.repartition(*group).sortWithinPartitions(*group).mapInArrow(partial(_similar_stars, similarity), "u long, v long")


# ---- operators -------------------------------------------------------------------------------------------------


def _groups(docs: DataFrame, id_col: str, text_col: str, size: int, words: int, plan) -> DataFrame:
    """(id, fp, component); ``plan(n)`` gives, for n different fingerprints, the function that sends them to routes, the
    routes' number, limits of their blocks, and the most differing bits."""
    spark = docs.sparkSession
    whole_text_batches(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = Table(texts.mapInArrow(partial(_fingerprints, size, words), "doc long, fp binary"), "simhash-rows")
    folded = Table(rows.df.where("doc is not null").groupBy("fp").agg(F.min("doc").alias("rep"), F.count("*").alias("n")), "simhash-folded")
    total, different = folded.df.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    route, copies, blocks, max_bits = plan(different)
    routed = folded.df.select("fp", "rep").mapInArrow(route, "route int, key long, other long, fp binary, rep long")
    most = min(MOST_ROWS, max(ROUTE_ROWS, different * copies // LONG_ROUTES))
    # Only keys and counts are shuffled here.
    sizes = routed.where("key = other").groupBy("route", "key").agg(F.count("*").alias("rows"))
    long = Table(sizes.where(F.col("rows") > most).select("route", "key", F.ceil(F.col("rows") / most).cast("int").alias("chunks")), "simhash-long")
    parts = small(long.df)
    # A row of chunk ``own`` meets every chunk of the other range; of its own range, each pair of chunks once.
    chunked = (
        routed.join(parts, ["route", "key"], "left")
        .join(parts.select("route", F.col("key").alias("other"), F.col("chunks").alias("others")), ["route", "other"], "left")
        .withColumn("own", F.pmod(F.xxhash64("fp"), F.coalesce("chunks", F.lit(1))).cast("int"))
        .withColumn("their", F.explode(F.sequence(F.lit(0), F.coalesce("others", F.lit(1)) - 1)))
    )
    before = (F.col("key") < F.col("other")) | ((F.col("key") == F.col("other")) & (F.col("own") <= F.col("their")))
    placed = chunked.select(
        "route",
        F.least("key", "other").alias("lo"),
        F.greatest("key", "other").alias("hi"),
        F.when(before, F.col("own")).otherwise(F.col("their")).alias("a"),
        F.when(before, F.col("their")).otherwise(F.col("own")).alias("b"),
        F.when(before, 0).otherwise(1).alias("side"),
        "fp",
        "rep",
    )
    edges = placed.repartition(*GROUP).sortWithinPartitions(*GROUP).mapInArrow(partial(_search, max_bits, blocks), "u long, v long")
    components = connected_components(edges)
    labelled = Table(
        folded.df.join(components, folded.df.rep == components.node, "left").select("fp", "n", F.coalesce("component", "rep").alias("component")),
        "simhash-labels",
    )
    folded.drop()
    long.drop()
    known = attach_groups(rows.df.where("doc is not null"), labelled.df, ["fp"], "n", total).select("doc", "fp", "component")
    nameless = rows.df.where("doc is null").select("doc", "fp", F.lit(None).cast("long").alias("component"))
    return known.unionByName(nameless).withColumnRenamed("doc", id_col)


def small(df: DataFrame) -> DataFrame:
    """``df`` (a written table) marked for broadcast, if it is counted to be small."""
    return F.broadcast(df) if df.count() <= SMALL_IDS else df


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 4, max_bits: int = 4) -> DataFrame:
    """id, fingerprint (16 hex digits), component_id: the smallest id reachable over links of ``max_bits`` or fewer."""

    def plan(n: int):
        blocks, most, prefix = gray_routes(n, max_bits)
        return partial(_ranges, blocks, most, prefix), BLOCKS, [(bits, most) for _, bits in blocks], max_bits

    got = _groups(docs, id_col, text_col, shingle_words, 1, plan)
    return got.select(id_col, F.lower(F.hex("fp")).alias("fingerprint"), F.col("component").alias("component_id"))


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, similarity: float = 0.8) -> DataFrame:
    """id, component_id: groups of documents whose shingle similarity is ``similarity`` or more, closed over links."""
    nameless = docs.where(F.col(id_col).isNull()).select(F.col(id_col).cast("long"), F.lit(None).cast("long").alias("component_id"))
    docs = docs.where(F.col(id_col).isNotNull())
    words, masks, max_bits = band_plan(docs.count(), similarity)
    candidates = _groups(docs, id_col, text_col, shingle_words, words, lambda _: (partial(_route, masks), len(masks), [], max_bits))
    loose = Table(candidates.select(F.col(id_col).alias("doc"), "component"), "near-loose")
    exact = _exact_components(docs, loose, id_col, text_col, shingle_words, similarity)
    return exact.select(F.col("doc").alias(id_col), F.col("component").alias("component_id")).unionByName(nameless)


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one document (the smallest id) of each near-duplicate group, columns as they were."""
    groups = near_duplicate_groups(docs, id_col, text_col, shingle_words, similarity)
    gone = Table(groups.where(F.col("component_id") != F.col(id_col)).select(id_col), "simhash-gone")
    return without_ids(docs, gone.df, id_col, gone.df.count())
