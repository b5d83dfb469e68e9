"""Near-duplicate embeddings with an inverted multi-index.

1. Packing. Every task gathers rows of one label whose directions lie within LEADER radians of a leader (exact copies
   above all), in batches. A leader's row holds its members, and a code: the mean direction, one byte a component, with
   the greatest angle between the code and a member as its radius. All members of a leader link with each other
   (2 * LEADER is less than the angle of the bar), so a vector or a tight group that a third of all rows
   share costs a few leaders a task.
2. Inverted multi-index. The halves of the codes have a codebook each, fitted on a bounded sample; a pair of entries is
   a cell. A leader visits cells nearest first (multi-sequence traversal of the two sorted lists of distances), until
   the sum of its distances exceeds that of its nearest cell by `reach`. `reach` is where, on the sample, partners at
   exactly the bar's angle were found with the target recall. A pair is looked for once, from the smaller cell.
3. Meeting. Leaders are dealt to groups (label, entry of the first half, coarse entry of the second); a leader comes once to
   each group with visited cells. Groups of more than BLOCK leaders are cut into a grid of blocks. With the angle
   between two codes, and their radii, all pairs of members surely link, or surely don't, or the pair of leaders is
   undecided. Sure links come out as counts for each leader and as a forest of the group, never as pairs.
4. Verification. Undecided pairs of leaders fetch their members' vectors, and every pair of members is compared by cosine
   in double precision.

So no link is reported that isn't one; what can be missed are pairs near the bar whose cell isn't visited.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from plumbtrace.operators.bounded import broadcast_if_small
from plumbtrace.sources.scratch import materialise

from .near_duplicates import connected
from .one_bit_search import usable

BAR = 0.93
#: Radians between a leader and its members.
LEADER = 0.08
#: Rows of a batch of leaders, and leaders of a block.
ROWS, BLOCK = 8192, 4096
#: Leaders that codebooks and reach are fitted on, at most.
SAMPLE = 16_384
TARGET_RECALL = 0.995
ENTRIES = 256
#: Leaders of the largest label for each cell.
CELL = 32
#: Slack of angles against rounding.
EPS = 1e-6
_CHUNK = 512
#: Kinds of rows that a meeting hands on.
COUNT, EDGE, ASK = range(3)


def directions(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; scaled by the largest component first, so that no square leaves the range."""
    x = x / np.abs(x).max(1)[:, None]
    return x / np.sqrt((x * x).sum(1))[:, None]


def decoded(codes: np.ndarray) -> np.ndarray:
    c = codes.astype(np.float64)
    return c / np.sqrt((c * c).sum(1))[:, None]


def _angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1, 1))


def _leaders(x: np.ndarray) -> np.ndarray:
    """For each direction the place of its leader; leaders lead themselves."""
    bar = np.cos(LEADER)
    lead = np.full(len(x), -1)
    heads: list[int] = []
    for at in range(0, len(x), _CHUNK):
        part = np.arange(at, min(at + _CHUNK, len(x)))
        if heads:
            near = x[part] @ x[heads].T
            best = near.argmax(1)
            found = near[np.arange(len(part)), best] >= bar
            lead[part[found]] = np.array(heads)[best[found]]
        rest = part[lead[part] < 0]
        inner = x[rest] @ x[rest].T >= bar
        open_ = np.ones(len(rest), bool)
        for k in range(len(rest)):
            if open_[k]:
                own = inner[k] & open_
                own[k] = True
                lead[rest[own]] = rest[k]
                open_ &= ~own
                heads.append(int(rest[k]))
    return lead


def packed(vectors: DataFrame, dtype: T.DataType) -> DataFrame:
    """Stored leaders: leader (a key), label, d, n (rows), code, radius, ids, place (of each row's vector), vectors (distinct)."""
    wide = isinstance(dtype.elementType, T.DoubleType)
    kind = np.float64 if wide else np.float32
    schema = T.StructType([
        T.StructField("label", vectors.schema["label"].dataType), T.StructField("d", T.IntegerType()), T.StructField("n", T.LongType()),
        T.StructField("code", T.BinaryType()), T.StructField("radius", T.DoubleType()), T.StructField("ids", T.ArrayType(vectors.schema["vec_id"].dataType)),
        T.StructField("place", T.ArrayType(T.IntegerType())), T.StructField("vectors", T.BinaryType()),
    ])
    arrow = to_arrow_schema(schema)

    def gather(ids: list, label, raw: np.ndarray) -> list[dict]:
        u = directions(raw.astype(np.float64))
        lead = _leaders(u)
        order = np.argsort(lead, kind="stable")
        out = []
        for rows in np.split(order, np.flatnonzero(np.diff(lead[order])) + 1):
            distinct, place = np.unique(raw[rows], axis=0, return_inverse=True)
            v = directions(distinct.astype(np.float64))
            centre = v.mean(0)
            code = np.rint(centre / np.abs(centre).max() * 127).astype(np.int8)
            radius = float(_angle(v @ decoded(code[None])[0]).max()) + EPS
            out.append({
                "label": label, "d": raw.shape[1], "n": len(rows), "code": code.tobytes(), "radius": radius, "ids": [ids[k] for k in rows],
                "place": place.reshape(-1).tolist(), "vectors": distinct.tobytes(),
            })
        return out

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in frames:
            for at in range(0, f.num_rows, ROWS):
                part = f.slice(at, ROWS)
                labels, ids = part.column("label").to_pylist(), part.column("vec_id").to_pylist()
                by: dict = {}
                for k, (label, v) in enumerate(zip(labels, part.column("v"))):
                    by.setdefault((label, len(v.values)), []).append(k)
                flat, offsets = part.column("v").values.to_numpy(zero_copy_only=False), part.column("v").offsets.to_numpy()
                rows = []
                for (label, d), at_rows in by.items():
                    raw = flat[offsets[at_rows][:, None] + np.arange(d)].astype(kind)
                    rows += gather([ids[k] for k in at_rows], label, raw)
                yield pa.RecordBatch.from_pylist(rows, arrow)

    return materialise(vectors.mapInArrow(batches, schema).select(F.monotonically_increasing_id().alias("leader"), "*"), "vector_leaders")


def _nearest_entries(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (book * book).sum(1)[None] - 2 * (x @ book.T), 0)


def _codebook(x: np.ndarray, entries: int, rounds: int = 8) -> np.ndarray:
    book = x[np.linspace(0, len(x) - 1, entries).astype(int)]
    for _ in range(rounds):
        near = _nearest_entries(x, book).argmin(1)
        sums = np.zeros_like(book)
        np.add.at(sums, near, x)
        counts = np.bincount(near, minlength=entries)
        book = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], book)
    return book


class MultiIndex:
    """Two codebooks over the halves of directions, the coarse group of each second entry, and the traversal's reach."""

    def __init__(self, sample: np.ndarray, entries: int, groups: int, bar: float, target: float):
        entries = max(1, min(entries, len(sample)))
        self.half = sample.shape[1] // 2
        self.books = [_codebook(part, entries) for part in (sample[:, :self.half], sample[:, self.half:])]
        coarse = _codebook(self.books[1], max(1, min(groups, entries)))
        self.coarse = _nearest_entries(self.books[1], coarse).argmin(1)
        self.entries = entries
        rng = np.random.default_rng(83)
        o = rng.normal(size=sample.shape)
        o -= (o * sample).sum(1)[:, None] * sample
        length = np.sqrt((o * o).sum(1))[:, None]
        partners = bar * sample + np.sqrt(1 - bar * bar) * np.where(length > 1e-9, o / np.maximum(length, 1e-9), 0)
        mine, other = self.distances(sample), self.distances(partners)
        cells = [d[0].argmin(1) * entries + d[1].argmin(1) for d in (mine, other)]
        swap = cells[0] > cells[1]
        d1, d2 = (np.where(swap[:, None], other[h], mine[h]) for h in (0, 1))
        goal, rows = np.where(swap, cells[0], cells[1]), np.arange(len(sample))
        excess = d1[rows, goal // entries] + d2[rows, goal % entries] - d1.min(1) - d2.min(1)
        self.reach = float(np.quantile(excess, target)) + 1e-9

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _nearest_entries(x[:, :self.half], self.books[0]), _nearest_entries(x[:, self.half:], self.books[1])

    def visits(self, d1: np.ndarray, d2: np.ndarray) -> tuple[tuple[int, int], list[tuple[int, int]]]:
        """A vector's own cell, and the cells that it visits from there on (its own among them)."""
        a, b = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
        s1, s2 = d1[a].tolist(), d2[b].tolist()
        a, b = a.tolist(), b.tolist()
        own, stop = (a[0], b[0]), s1[0] + s2[0] + self.reach
        heap, found, last = [(s1[0] + s2[0], 0, 0)], [], len(a) - 1
        while heap:
            s, i, j = heapq.heappop(heap)
            if s > stop:
                break
            if (a[i], b[j]) >= own:
                found.append((a[i], b[j]))
            # each cell is pushed once: down the second list, and along the first only from its head
            if j < last:
                heapq.heappush(heap, (s1[i] + s2[j + 1], i, j + 1))
            if j == 0 and i < last:
                heapq.heappush(heap, (s1[i + 1] + s2[0], i + 1, 0))
        return own, found


def _fit(leaders: DataFrame, d: int, largest: int, bar: float, target: float) -> MultiIndex:
    rows = leaders.where(F.col("d") == d).select("code", F.xxhash64("code").alias("h")).orderBy("h", "code").limit(SAMPLE).collect()
    sample = decoded(np.frombuffer(b"".join(bytes(r.code) for r in rows), np.int8).reshape(-1, d))
    entries = int(np.clip(np.ceil(np.sqrt(largest / CELL)), 4, ENTRIES))
    # as many groups as leave a block of leaders to each
    return MultiIndex(sample, entries, -(-largest // (entries * BLOCK)), bar, target)


def _dealt(leaders: DataFrame, d: int, index: MultiIndex) -> DataFrame:
    """One row for each leader and group that it visits: its code, own second entry where it lives there, and visited entries."""
    entries, coarse = index.entries, index.coarse
    schema = "leader long, label " + leaders.schema["label"].dataType.simpleString() + ", n long, code binary, radius double, first int, coarse int, own int, visits binary"

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), 2048):
                part = f.iloc[at:at + 2048]
                d1, d2 = index.distances(decoded(np.frombuffer(b"".join(part["code"]), np.int8).reshape(-1, d)))
                rows = []
                for k in range(len(part)):
                    own, cells = index.visits(d1[k], d2[k])
                    by: dict = {}
                    for i, j in cells:
                        by.setdefault((i, int(coarse[j])), np.zeros(entries, np.uint8))[j] = 1
                    for (i, g), on in by.items():
                        # cells of the own first entry that come after the own one are told from visits of others by `own`
                        lives = i == own[0] and g == coarse[own[1]]
                        rows.append((k, i, g, own[1] if lives else -1, np.packbits(on).tobytes()))
                dealt = pd.DataFrame(rows, columns=["k", "first", "coarse", "own", "visits"])
                same = part[["leader", "label", "n", "code", "radius"]].iloc[dealt.pop("k").to_numpy()].reset_index(drop=True)
                yield pd.concat([same, dealt], axis=1)

    return leaders.where(F.col("d") == d).select("leader", "label", "n", "code", "radius").mapInPandas(deal, schema)


def _meetings(dealt: DataFrame, d: int, entries: int, bar: float) -> DataFrame:
    """(a, b, kind, n) of every group: COUNT of sure links for leader a, EDGE of its forest, or ASK for an undecided pair."""
    group = ["label", "first", "coarse"]
    large = dealt.groupBy(*group).agg(F.count("*").alias("rows")).where(F.col("rows") > BLOCK)
    large = large.select(*group, F.ceil(F.col("rows") / BLOCK).cast("int").alias("blocks"))
    rows = dealt.join(broadcast_if_small(large), group, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("h", F.pmod(F.xxhash64("leader"), F.col("blocks")).cast("int"))
    # a row looks for others in all columns of its line of the grid; one that lives here is found in all lines of its column
    line = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.struct(F.col("h").alias("x"), b.alias("y"), F.lit(True).alias("looks"), ((b == F.col("h")) & (F.col("own") >= 0)).alias("lives")))
    column = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.struct(b.alias("x"), F.col("h").alias("y"), F.lit(False).alias("looks"), F.lit(True).alias("lives")))
    seats = F.when(F.col("own") >= 0, F.concat(line, F.filter(column, lambda s: s["x"] != s["y"]))).otherwise(line)
    rows = rows.select(*group, "leader", "n", "code", "radius", "own", "visits", F.explode(seats).alias("s")).select("*", "s.*").drop("s")
    theta = float(np.arccos(bar))

    def told(rows: list[tuple[int, int, int, int]]) -> pd.DataFrame:
        return pd.DataFrame(np.array(rows, np.int64).reshape(-1, 4), columns=["a", "b", "kind", "n"])

    def meet(f: pd.DataFrame) -> pd.DataFrame:
        found = f[f["lives"]]
        looks = f[f["looks"]].sort_values("leader")
        found = found.sort_values("leader")
        if not len(found) or not len(looks):
            return told([])
        x, y = (decoded(np.frombuffer(b"".join(t["code"]), np.int8).reshape(-1, d)) for t in (looks, found))
        kx, ky, wx, wy = looks["leader"].to_numpy(), found["leader"].to_numpy(), looks["n"].to_numpy(), found["n"].to_numpy()
        rx, ry, ox, oy = looks["radius"].to_numpy(), found["radius"].to_numpy(), looks["own"].to_numpy(), found["own"].to_numpy()
        seen = np.unpackbits(np.frombuffer(b"".join(looks["visits"]), np.uint8).reshape(len(looks), -1), axis=1, count=entries).astype(bool)
        count_x, count_y = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
        out, head = [], {}

        def top(k: int) -> int:
            while head.get(k, k) != k:
                head[k] = head.get(head[k], head[k])
                k = head[k]
            return k

        for at in range(0, len(x), _CHUNK):
            part = slice(at, at + _CHUNK)
            # in one cell, from the smaller key; else from the smaller cell, which is the only one that has the other's bit
            once = seen[part][:, oy] & ((ox[part][:, None] != oy[None]) | (kx[part][:, None] < ky[None]))
            cosine = x[part] @ y.T
            once &= cosine >= np.cos(min(np.pi, theta + rx[part].max() + ry.max()))
            i, j = np.nonzero(once)
            angle, slack = _angle(cosine[i, j]), rx[part][i] + ry[j]
            i += at
            sure, ask = angle + slack <= theta - EPS, (angle + slack > theta - EPS) & (angle - slack <= theta + EPS)
            out += [(a, b, ASK, 0) for a, b in zip(kx[i[ask]].tolist(), ky[j[ask]].tolist())]
            i, j = i[sure], j[sure]
            np.add.at(count_x, i, wy[j])
            np.add.at(count_y, j, wx[i])
            for a, b in zip(kx[i].tolist(), ky[j].tolist()):
                s, t = top(a), top(b)
                if s != t:
                    head[max(s, t)] = min(s, t)
                    out.append((a, b, EDGE, 0))
        for keys, counts in ((kx, count_x), (ky, count_y)):
            has = np.flatnonzero(counts)
            out += [(int(keys[k]), -1, COUNT, int(counts[k])) for k in has]
        return told(out)

    return rows.groupBy(*group, "x", "y").applyInPandas(meet, "a long, b long, kind int, n long")


def _verified(asked: DataFrame, leaders: DataFrame, d: int, bar: float, kind) -> DataFrame:
    """(a, b, counts_a, counts_b) of the undecided pairs that link: for each distinct vector of a and b, rows linked on the other side."""
    sides = leaders.select("leader", "place", "vectors")
    for side in "ab":
        asked = asked.join(sides.select(F.col("leader").alias(side), F.col("place").alias(f"place_{side}"), F.col("vectors").alias(f"vectors_{side}")), side)

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for r in f.itertuples(index=False):
                x, y = (np.frombuffer(v, kind).reshape(-1, d).astype(np.float64) for v in (r.vectors_a, r.vectors_b))
                wx, wy = np.bincount(r.place_a, minlength=len(x)), np.bincount(r.place_b, minlength=len(y))
                u, w = directions(x), directions(y)
                counts_y = np.zeros(len(y), np.int64)
                counts_x = np.zeros(len(x), np.int64)
                for at in range(0, len(x), _CHUNK):
                    part = slice(at, at + _CHUNK)
                    link = u[part] @ w.T >= bar
                    counts_x[part] = link @ wy
                    counts_y += wx[part] @ link
                if counts_x.any():
                    out.append((r.a, r.b, counts_x, counts_y))
            yield pd.DataFrame(out, columns=["a", "b", "counts_a", "counts_b"])

    return asked.mapInPandas(compare, "a long, b long, counts_a array<long>, counts_b array<long>")


def embedding_duplicates(vectors: DataFrame, bar: float = BAR, target_recall: float = TARGET_RECALL) -> DataFrame:
    """Per row of `vectors` (vec_id, embedding, label): vec_id, label, n_links, component_id, kept.

    Rows link whose labels are equal and not null and whose vectors have a cosine of `bar` or more. n_links counts the
    other rows that a row links with; component_id is the smallest vec_id reachable by links, its own included.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, and rows of other
    lengths aren't compared. Repeated rows are rows of their own, which link. A null vec_id counts only where a
    component has no other (component_id is null then), and isn't kept. Other columns don't matter.
    """
    if not np.cos(2 * LEADER + 0.01) > bar:
        raise ValueError("bar must leave room for the members of a leader")
    rows = vectors.select("vec_id", "label", F.col("embedding").alias("v"))
    takes = usable(F.col("v")) & F.col("label").isNotNull()
    dtype = rows.schema["v"].dataType
    kind = np.float64 if isinstance(dtype.elementType, T.DoubleType) else np.float32
    leaders = packed(rows.where(takes), dtype)
    sizes = leaders.groupBy("d", "label").agg(F.count("*").alias("n")).groupBy("d").agg(F.max("n").alias("n")).collect()

    counts = edges = links = None
    for d, largest in sizes:
        index = _fit(leaders, d, largest, bar, target_recall)
        met = materialise(_meetings(materialise(_dealt(leaders, d, index), "vector_visits"), d, index.entries, bar), "vector_meetings")
        found = materialise(_verified(met.where(F.col("kind") == ASK).select("a", "b"), leaders, d, bar, kind), "vector_links")
        new = (
            met.where(F.col("kind") == COUNT).select(F.col("a").alias("leader"), F.col("n").alias("sure")),
            met.where(F.col("kind") == EDGE).select("a", "b").unionByName(found.select("a", "b")),
            found.select(F.col("a").alias("leader"), F.posexplode("counts_a")).unionByName(found.select(F.col("b").alias("leader"), F.posexplode("counts_b"))).where("col > 0"),
        )
        counts, edges, links = new if counts is None else [x.unionByName(y) for x, y in zip((counts, edges, links), new)]

    alone = rows.where(~takes).select("vec_id", "label", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    if counts is None:
        return alone.withColumn("kept", F.col("vec_id").isNotNull())
    named = leaders.select("leader", F.array_min("ids").alias("least"))
    if not edges.isEmpty():
        roots = connected(edges).select(F.col("node").alias("leader"), "root")
        named = named.join(roots, "leader", "left").withColumn("root", F.coalesce("root", "leader"))
        component = named.groupBy("root").agg(F.min("least").alias("component_id"))
        named = named.join(component, "root").select("leader", "component_id")
    else:
        named = named.select("leader", F.col("least").alias("component_id"))
    sure = counts.groupBy("leader").agg(F.sum("sure").alias("sure"))
    told = leaders.select("leader", "label", "n", F.arrays_zip("ids", "place").alias("m")).join(sure, "leader", "left").join(named, "leader")
    members = told.select("leader", "label", "component_id", (F.col("n") - 1 + F.coalesce("sure", F.lit(0))).alias("base"), F.explode("m").alias("m"))
    members = members.select("leader", "label", "component_id", "base", F.col("m.ids").alias("vec_id"), F.col("m.place").alias("pos"))
    more = links.groupBy("leader", "pos").agg(F.sum("col").alias("more"))
    members = members.join(more, ["leader", "pos"], "left")
    linked = members.select("vec_id", "label", (F.col("base") + F.coalesce("more", F.lit(0))).alias("n_links"), "component_id")
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
