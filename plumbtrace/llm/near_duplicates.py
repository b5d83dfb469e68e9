"""MinHash near-duplicates with sequential Bayesian verification, and their components.

1. Every text becomes its set of distinct shingles (64-bit hashes). Texts with equal sets are one node
   from here on, so copies are never paired.
2. MinHash signatures are cut into bands; nodes that share a band's key are candidates. Signatures are
   also kept as one byte for each hash function.
3. Stars: in each bucket every node is paired with the smallest. A pair's signature bytes are compared in
   batches; it is dropped as soon as the posterior chance of a similarity at the bar falls under `miss`.
   What survives is verified on the full sets, and verified links merge components.
4. Rest: in buckets that still hold several components, all pairs of different components are compared in
   the same sequential way: of small buckets as rows, of larger ones where blocks of members meet. Of each two
   components that meet, the pair that agrees most is verified first; once those links have merged components, all
   plausible pairs of components that are still different are verified. Blocks bring their members' full sets along and
   verify their pairs themselves, so only links that join components become rows: how many pairs lie just under the bar
   grows with the square of a group's size. Pairs in one component need no check, since they can't change the result.
   So no link is lost but by the chances of the bands and of `miss`; nothing is capped.

Links, components and labels stay distributed; each step is a written table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from plumbtrace.sources.scratch import materialise

SHINGLE = 5
#: A similarity of NUMERATOR / 100 or more links.
NUMERATOR = 75
BANDS, ROWS = 24, 4
HASHES = BANDS * ROWS
BATCH = 16
MISS = 1e-4
#: Members of larger buckets are compared on so many hashes, checked after each further STEP.
LONG, STEP = 480, 96
#: Buckets of more members are compared by blocks of BLOCK, or of fewer whose sets have about BLOCK_BYTES together.
SMALL, BLOCK, BLOCK_BYTES = 16, 1024, 8 << 20
#: Candidate nodes (24 bytes each) whose keys are broadcast to fetch texts; more are joined by a shuffle.
BROADCAST_NODES = 1_000_000
#: Words whose hashes a task keeps.
KNOWN_WORDS = 200_000
_CHUNK = 1 << 17

_RNG = np.random.default_rng(1009)
_PLACES = _RNG.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) | np.uint64(1)
_TIMES = (_RNG.integers(1, 1 << 32, HASHES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_FLIPS = _RNG.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)
_TIMES = np.append(_TIMES, (_RNG.integers(1, 1 << 32, LONG - HASHES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32))
_FLIPS = np.append(_FLIPS, _RNG.integers(0, 1 << 32, LONG - HASHES, dtype=np.uint64).astype(np.uint32))


def _mixed(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return z ^ (z >> np.uint64(32))


class Shingler:
    """Texts -> sorted arrays of distinct shingle hashes. Keeps word hashes for later texts."""

    def __init__(self, size: int = SHINGLE):
        self.size, self.known = size, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        if not words:
            return np.zeros(0, np.uint64)
        known = self.known
        if len(known) > KNOWN_WORDS:
            known.clear()
        for w in set(words):
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = max(1, len(h) - self.size + 1)
        z = np.full(n, min(len(h), self.size), np.uint64)
        for k in range(min(self.size, len(h))):
            z += h[k:k + n] * _PLACES[k]
        return np.unique(_mixed(z))


def signatures(sets: list[np.ndarray], hashes: int = HASHES) -> np.ndarray:
    """Minima of the first `hashes` functions over each non-empty set (32-bit)."""
    out = np.empty((len(sets), hashes), np.uint32)
    at = 0
    while at < len(sets):
        to, size = at, 0
        while to < len(sets) and (to == at or size + len(sets[to]) <= _CHUNK):
            size += len(sets[to])
            to += 1
        flat = np.concatenate(sets[at:to]).astype(np.uint32)
        starts = np.concatenate([[0], np.cumsum([len(s) for s in sets[at:to - 1]])]).astype(np.int64)
        buffer = np.empty_like(flat)
        for k in range(hashes):
            np.bitwise_xor(flat, _FLIPS[k], out=buffer)
            np.multiply(buffer, _TIMES[k], out=buffer)
            out[at:to, k] = np.minimum.reduceat(buffer, starts)
        at = to
    return out


def signature_bytes(sig: np.ndarray) -> np.ndarray:
    """One byte of each minimum, mixed from all its bits: the top bits of a large set's minima are all 0."""
    return ((sig * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)


def least_matches(miss: float = MISS) -> dict[int, int]:
    """Compared hashes -> matches below which a pair is dropped: there, under a flat prior, the posterior
    chance that the similarity reaches the bar is less than `miss`."""
    x = np.linspace(0.0005, 0.9995, 1000)
    # one-byte values agree by chance once in 256
    agree = x + (1 - x) / 256
    out = {}
    for n in [*range(BATCH, HASHES + 1, BATCH), *range(HASHES + STEP, LONG + 1, STEP)]:
        for m in range(n + 1):
            logs = m * np.log(agree) + (n - m) * np.log(1 - agree)
            p = np.exp(logs - logs.max())
            if p[x >= NUMERATOR / 100].sum() / p.sum() >= miss:
                out[n] = m
                break
    return out


_LEAST = least_matches()


def plausible(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs of cards (size in 4 bytes, HASHES or LONG signature bytes) may still link, by size and by posterior."""
    n, m = (np.ascontiguousarray(x[:, :4]).view("<u4")[:, 0].astype(np.int64) for x in (a, b))
    left = np.flatnonzero(100 * np.minimum(n, m) >= NUMERATOR * np.maximum(n, m))
    matches, start = np.zeros(len(left), np.int64), 4
    for end, least in _LEAST.items():
        if 4 + end > a.shape[1]:
            break
        matches += (a[left, start:4 + end] == b[left, start:4 + end]).sum(1)
        start = 4 + end
        keep = matches >= least
        left, matches = left[keep], matches[keep]
    return left


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not len(small):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return 100 * both >= NUMERATOR * (len(a) + len(b) - both)


def _cards(values) -> np.ndarray:
    return np.frombuffer(b"".join(values), np.uint8).reshape(-1, 4 + HASHES)


def shingled(docs: DataFrame) -> DataFrame:
    """(doc_id, h, n_shingles, node, bands, card) of every row of docs (doc_id, text), stored."""

    @F.arrow_udf("n_shingles long, node binary, bands array<long>, card binary")
    def compute(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        shingler = Shingler()
        for texts in batches:
            rows = []
            for start in range(0, len(texts), 512):
                # of a batch's texts, few at a time are Python's
                sets = [shingler(t) for t in texts.slice(start, 512).to_pylist()]
                full = [s for s in sets if len(s)]
                sig = signatures(full) if full else np.zeros((0, HASHES), np.uint32)
                wide = sig.astype(np.uint64).reshape(-1, BANDS, ROWS)
                keys = np.full(wide.shape[:2], 0, np.uint64) + np.arange(BANDS, dtype=np.uint64)
                for k in range(ROWS):
                    keys = _mixed(keys + wide[:, :, k] * np.uint64(0xD6E8FEB86659FD93))
                keys, low, k = keys.view(np.int64), signature_bytes(sig), 0
                for s in sets:
                    if not len(s):
                        rows.append((0, None, None, None))
                        continue
                    rows.append((len(s), xxhash.xxh3_128_digest(s.tobytes()), keys[k], np.uint32(len(s)).tobytes() + low[k].tobytes()))
                    k += 1
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary()))]
            yield pa.StructArray.from_arrays(columns, ["n_shingles", "node", "bands", "card"])

    rows = docs.select("doc_id", F.xxhash64("text").alias("h"), compute("text").alias("s"))
    return materialise(rows.select("doc_id", "h", "s.*"), "near_sets")


def _only_stars(edges: DataFrame) -> bool:
    """Whether every a of edges (a > b) has one b, and no b is an a: then each component's smallest node is its b."""
    ups = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    downs = edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    by_node = ups.unionByName(downs).groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return by_node.where("up > 1 or (up = 1 and down = 1)").isEmpty()


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for every node with an edge (a, b); root: the smallest node reachable.

    Alternating large-star and small-star steps on written tables, until only stars are left.
    """
    now = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "near_edges")
    while not _only_stars(now):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # as many rows as edges at most, so repeated ones wait for the end of the step
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("e"))
        now = materialise(small.select("e.a", F.col("e.m").alias("b")).where("a <> b").distinct(), "near_stars")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes that link on their full sets."""

    @F.pandas_udf("boolean")
    def same(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        shingler, kept = Shingler(), {}
        for a, b in batches:
            out = []
            for x, y in zip(a, b):
                if x not in kept:  # a star's centre comes many times in a row
                    kept = {x: shingler(x)}
                out.append(linked(kept[x], shingler(y)))
            yield pd.Series(out, dtype=bool)

    for side in "ab":
        pairs = pairs.join(texts.select(F.col("node").alias(side), F.col("text").alias(f"text_{side}")), side)
    return pairs.where(same("text_b", "text_a")).select("a", "b")


def _merged(labels: DataFrame | None, links: DataFrame) -> DataFrame | None:
    """Labels after links; the components so far are stars already."""
    if links.isEmpty():
        return labels
    return connected(links if labels is None else links.unionByName(labels.select(F.col("node").alias("a"), F.col("root").alias("b"))))


def _members(candidates: DataFrame, *more: str) -> DataFrame:
    return candidates.select("node", "card", *more, F.explode("keys").alias("key"))


def _star_pairs(candidates: DataFrame) -> DataFrame:
    """Plausible pairs of a bucket's members with its smallest node."""

    @F.pandas_udf("boolean")
    def likely(a: pd.Series, b: pd.Series) -> pd.Series:
        out = np.zeros(len(a), bool)
        if len(a):
            out[plausible(_cards(a), _cards(b))] = True
        return pd.Series(out)

    # nodes alone are dealt by bucket; cards, six times as long, come to the pairs that are left of all buckets together
    nodes = candidates.select("node", F.explode("keys").alias("key"))
    first = nodes.groupBy("key").agg(F.min("node").alias("first"))
    pairs = nodes.join(first, "key").where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b")).distinct()
    for side in "ab":
        pairs = pairs.join(candidates.select(F.col("node").alias(side), F.col("card").alias(f"card_{side}")), side)
    return pairs.where(likely("card_a", "card_b")).select("a", "b")


def _mixed_buckets(candidates: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Members of the buckets that hold more than one component: (key, node, root, card, large)."""
    if labels is None:
        told = _members(candidates.withColumn("root", F.col("node")), "root")
    else:
        told = _members(candidates.join(labels, "node", "left").withColumn("root", F.coalesce("root", "node")), "root")
    mixed = told.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y"), (F.count("*") > SMALL).alias("large"))
    return told.join(mixed.where("x <> y").select("key", "large"), "key")


def _small_pairs(told: DataFrame) -> DataFrame:
    """Plausible pairs of different components inside buckets of SMALL members at most."""
    packed = told.groupBy("key").agg(F.collect_list(F.concat("node", "root", "card")).alias("items"))
    width = 32 + 4 + HASHES

    @F.pandas_udf("array<struct<a: binary, b: binary>>")
    def compare(buckets: pd.Series) -> pd.Series:
        out = []
        for items in buckets:
            u = np.frombuffer(b"".join(items), np.uint8).reshape(-1, width)
            i, j = np.triu_indices(len(u), 1)
            other = (u[i, 16:32] != u[j, 16:32]).any(1)
            i, j = i[other], j[other]
            keep = plausible(u[i, 32:], u[j, 32:])
            found = (sorted((u[p, :16].tobytes(), u[q, :16].tobytes())) for p, q in zip(i[keep], j[keep]))
            out.append([{"a": a, "b": b} for a, b in found])
        return pd.Series(out)

    return packed.select(F.explode(compare("items")).alias("p")).select("p.a", "p.b").distinct()


def _blocks(told: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members of larger buckets as (node, card, hashes, block), and which blocks meet (x, y); members and meetings are stored.

    Their cards hold LONG hashes: the posterior of a pair just under the bar falls with the number compared, and here
    a member meets many. `hashes` is a member's full set.

    Each member has one block, by the first of its buckets, whatever other buckets it is in; two blocks meet once,
    however many buckets they share. A block has about BLOCK members, or BLOCK_BYTES of sets.
    """

    @F.pandas_udf("card binary, hashes binary")
    def card_and_set(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        shingler = Shingler()
        for b in batches:
            out = []
            for start in range(0, len(b), 512):
                sets = [shingler(t) for t in b.iloc[start:start + 512]]
                cards = (np.uint32(len(s)).tobytes() + low.tobytes() for s, low in zip(sets, signature_bytes(signatures(sets, LONG))))
                out += [(card, s.tobytes()) for card, s in zip(cards, sets)]
            yield pd.DataFrame(out, columns=["card", "hashes"], dtype=object)

    homes = told.groupBy("node").agg(F.min("key").alias("home")).join(texts, "node")
    # texts are spread over all tasks again before they are hashed
    homes = homes.repartition("node").select("node", "home", card_and_set("text").alias("s"))
    homes = materialise(homes.select("node", "home", "s.*", F.octet_length("s.hashes").alias("bytes")), "near_blocks")
    sizes = homes.groupBy("home").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("bytes") / BLOCK_BYTES)).alias("n"))
    block = F.xxhash64("home", F.pmod(F.xxhash64("node"), "n")).alias("block")
    homes = homes.join(sizes, "home").select("node", "card", "hashes", block)
    roots = told.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", "root")).alias("most"))
    placed = told.select("key", "node", "root").join(homes.select("node", "block"), "node").join(roots, "key")
    placed = placed.groupBy("key", "block").agg(F.max(F.col("root") != F.col("most.root")).alias("minor"))
    meets = placed.where("minor").select("key", F.col("block").alias("x")).join(placed.select("key", F.col("block").alias("y")), "key")
    return homes, materialise(meets.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), "near_meetings")


def _meeting_pairs(left: np.ndarray, right: np.ndarray | None, best: bool, sets: list[np.ndarray] | None = None) -> list[tuple[bytes, bytes]]:
    """Plausible pairs of different components between two blocks, or inside one (right is None).

    Members are rows of node, root and card. With `best`, only the pair of each two components whose signatures agree most.
    With `sets` (of the members of left, then right), only pairs that link on them and join what no pair before has joined.
    """
    u = left if right is None else np.concatenate([left, right])
    component = np.unique(np.ascontiguousarray(u[:, 16:32]).view("V16")[:, 0], return_inverse=True)[1]
    cards, out, top = u[:, 32:], [], {}

    def counts(i: int, j: int) -> bool:
        if sets is None:
            return True
        if component[i] == component[j] or not linked(sets[i], sets[j]):
            return False
        component[component == component[j]] = component[i]
        return True

    here, there = np.arange(len(left)), np.arange(len(left), len(u))
    if right is not None and len(there) < len(here):  # one batch of comparisons for each of the fewer
        here, there = there, here
    for i in here:
        js = np.arange(i + 1, len(u)) if right is None else there
        js = js[component[js] != component[i]]
        if not len(js):
            continue
        js = js[plausible(np.broadcast_to(cards[i], (len(js), cards.shape[1])), cards[js])]
        if best and len(js):
            agree = (cards[js, 4:] == cards[i, 4:]).sum(1)
            order = np.lexsort((js, -agree))
            for k in order[np.unique(component[js[order]], return_index=True)[1]]:
                two = (min(component[i], component[js[k]]), max(component[i], component[js[k]]))
                if two not in top or agree[k] > top[two][0]:
                    top[two] = (agree[k], i, js[k])
        else:
            out.extend((i, j) for j in js if counts(i, j))
    if best:
        out = [(i, j) for _, i, j in sorted(top.values(), key=lambda t: -t[0]) if counts(i, j)]
    return [tuple(sorted((u[i, :16].tobytes(), u[j, :16].tobytes()))) for i, j in out]


def _block_links(homes: DataFrame, meets: DataFrame, labels: DataFrame | None, best: bool) -> DataFrame:
    """Links (a, b) of different components, found and verified where blocks meet: at most one fewer than a meeting's members.

    A block travels as one row, so a meeting reads 2 x (BLOCK x 516 bytes + BLOCK_BYTES) at most, however many of its
    pairs are plausible.
    """
    told = homes if labels is None else homes.join(labels, "node", "left")
    root = F.col("node") if labels is None else F.coalesce("root", "node")
    told = told.select("block", "node", root.alias("root"), "card", "hashes")
    packed = materialise(
        told.groupBy("block").agg(
            F.collect_list(F.concat("node", "root", "card", "hashes")).alias("items"), F.min("root").alias("low"), F.max("root").alias("high")
        ), "near_packed_blocks",
    )
    ends = packed.select("block", "low", "high")
    for side in "xy":
        meets = meets.join(ends.select(F.col("block").alias(side), F.col("low").alias(f"low_{side}"), F.col("high").alias(f"high_{side}")), side)
    meets = meets.where("least(low_x, low_y) <> greatest(high_x, high_y)")
    sides = meets.select("x", "y", F.explode(F.array_distinct(F.array("x", "y"))).alias("block")).join(packed.select("block", "items"), "block")
    width = 32 + 4 + LONG

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        blocks = [np.frombuffer(b"".join(x[:width] for x in items), np.uint8).reshape(-1, width) for items in group["items"]]
        sets = [np.frombuffer(x[width:], np.uint64) for items in group["items"] for x in items]
        links = _meeting_pairs(blocks[0], blocks[1] if len(blocks) > 1 else None, best, sets)
        return pd.DataFrame(links, columns=["a", "b"])

    return sides.groupBy("x", "y").applyInPandas(compare, "a binary, b binary").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, h, n_shingles, component_id, kept.

    component_id: the smallest doc_id reachable by links. Null, empty and wordless texts have an empty set
    and link with nothing; texts under five words are one shingle; equal sets are linked. Repeated rows
    come as often as they stand, with one component. A null doc_id counts only where a component has no other
    (component_id is null then), and isn't kept. Only doc_id and text are read, so other columns don't matter.
    """
    return _with_roots(docs).drop("root")


def _with_roots(docs: DataFrame) -> DataFrame:
    """What near_duplicates() returns, and root: the smallest node of the row's component, null for empty sets.

    Unlike component_id, which is null or repeated where doc_ids are, root names a component.
    """
    rows = shingled(docs)
    nodes = materialise(
        rows.where("n_shingles > 0").groupBy("node").agg(
            F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "h")).alias("pick"), F.first("bands").alias("bands"), F.first("card").alias("card")
        ), "near_nodes",
    )
    placed = nodes.select("node", F.explode("bands").alias("key"))
    shared = placed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    # a node has BANDS keys at most
    asked = placed.join(shared, "key").groupBy("node").agg(F.collect_list("key").alias("keys"))
    candidates = materialise(nodes.join(asked, "node").select("node", "pick", "card", "keys"), "near_candidates")
    texts = _texts(docs, candidates)

    stars = materialise(_star_pairs(candidates), "near_pairs")
    found = materialise(_verified(stars, texts), "near_links")
    labels = None if found.isEmpty() else connected(found)
    rest = materialise(_mixed_buckets(candidates, labels), "near_rest_members")
    tried = stars.select(F.greatest("a", "b").alias("b"), F.least("a", "b").alias("a"))
    homes, meets = _blocks(rest.where("large"), texts)
    pairs = materialise(_small_pairs(rest.where("not large")).join(tried, ["a", "b"], "left_anti"), "near_rest")
    links = _verified(pairs, texts).unionByName(_block_links(homes, meets, labels, True))
    labels = _merged(labels, materialise(links, "near_links"))
    labels = _merged(labels, materialise(_block_links(homes, meets, labels, False), "near_links"))

    named = nodes.select("node", "least")
    if labels is not None:
        named = named.join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
        smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
        named = named.join(smallest, "root").select("node", "root", "component_id")
    else:
        named = named.select("node", F.col("node").alias("root"), F.col("least").alias("component_id"))
    out = rows.select("doc_id", "h", "n_shingles", "node").join(named, "node", "left")
    out = out.withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept")
    return out.select("doc_id", "h", "n_shingles", "component_id", kept, "root")


def _texts(docs: DataFrame, candidates: DataFrame) -> DataFrame:
    """(node, text): one text of each candidate node, stored."""
    picks = candidates.select("node", F.col("pick.doc_id").alias("pick_id"), F.col("pick.h").alias("pick_h"))
    if picks.count() <= BROADCAST_NODES:
        picks = F.broadcast(picks)
    texts = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
    found = texts.join(picks, (F.col("h") == F.col("pick_h")) & F.col("doc_id").eqNullSafe(F.col("pick_id")))
    # rows that repeat give a node's text more than once
    return materialise(found.groupBy("node").agg(F.first("text").alias("text")), "near_texts")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of docs (doc_id, text and others) for each component, and all rows with an empty set.

    The row with the smallest doc_id stays (of rows with one id, that with the smallest hash of its text; of equal rows, one).
    """
    found = _with_roots(docs)
    order = F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "h")
    grouped = found.where("n_shingles > 0").groupBy("root").agg(F.min(order).alias("m"))
    keep = grouped.select(F.col("m.doc_id").alias("keep_id"), F.col("m.h").alias("keep_h"))
    tagged = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64("text").alias("h"), F.col("doc_id"))
    kept = tagged.join(keep, (F.col("h") == F.col("keep_h")) & F.col("doc_id").eqNullSafe(F.col("keep_id")))
    repeated = found.groupBy("doc_id", "h").agg(F.count("*").alias("n")).where("n > 1")
    if not repeated.isEmpty():
        kept = kept.groupBy("doc_id", "h").agg(F.first("row").alias("row"))
    empty = tagged.join(found.where("n_shingles = 0").select("h").distinct().withColumnRenamed("h", "keep_h"), F.col("h") == F.col("keep_h"))
    return kept.select("row.*").unionByName(empty.select("row.*"))
