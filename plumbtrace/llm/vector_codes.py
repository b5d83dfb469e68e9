"""Vector codes by product quantisation: Lloyd rounds over partition-local cover trees, in whole numbers.

Vectors become integers (floor of `scale` times each component) and are cut into equal parts; each part has a
codebook. Every task packs its rows into batches and builds one cover tree per batch and part: the root covers all
points; a node's children cover it at half its radius, the first child keeps the node's centre, siblings lie further
apart than that radius. A subtree is a range of one order of the points, so that prefix sums of that order are the
cumulative sums of all subtrees. The trees are stored once and read in each round.

A round walks down each tree. With r the radius of a node, and d1 and d2 the distances of its centre to the nearest
and the second nearest entry, d2 - d1 > 2 r means, by the triangle inequality, that all its points are nearer to the first
entry than to any other: the whole subtree goes there with its cumulative sum. Other nodes descend; single points
are compared exactly, ties go to the lower index. Tasks hand on one row (count and sum) for each entry that
they used, which Spark adds up; an entry becomes the floor of sum / count, one without points stays.

Only the codebooks (parts * entries rows) pass through the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from plumbtrace.operators.bounded import broadcast_if_small
from plumbtrace.sources.scratch import materialise

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Rows of a batch, and so points of a tree: its distance matrix has BATCH ** 2 numbers.
BATCH = 1024
#: Integers are held within these bounds, so that no squared distance leaves 64 bits.
BOUND = 1 << 27


class CoverTree:
    """Points (distinct rows of a matrix, in the order of the tree), their counts, and nodes as ranges of that order."""

    def __init__(self, points, counts, of_row, start, end, centre, radius, child, children):
        self.points, self.counts, self.of_row = points, counts, of_row
        self.start, self.end, self.centre, self.radius = start, end, centre, radius
        #: first child node and number of children; a node of one point has none
        self.child, self.children = child, children
        weighted = np.concatenate([counts[:, None], points * counts[:, None]], 1)
        self.sums = np.concatenate([np.zeros((1, weighted.shape[1]), np.int64), np.cumsum(weighted, 0)])

    @classmethod
    def build(cls, rows: np.ndarray) -> CoverTree:
        points, of_row, counts = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
        of_row = of_row.reshape(-1)
        n = len(points)
        far = np.sqrt(squared_distances(points, points).astype(np.float64)) * (1 + 1e-12)
        order = np.arange(n)
        start, end, centre, radius, child, children = [0], [n], [0], [0.0], [0], [0]
        node = 0
        while node < len(start):
            a, b = start[node], end[node]
            if b - a == 1:
                node += 1
                continue
            ids = order[a:b].copy()
            near = far[np.ix_(ids, ids)]
            own = int(np.flatnonzero(ids == centre[node])[0])
            reach = float(near[own].max())
            radius[node] = reach
            half = reach / 2
            groups, open_ = [], np.ones(len(ids), bool)
            pick = own
            while True:
                taken = (near[pick] <= half) & open_
                taken[pick] = True
                groups.append((pick, np.flatnonzero(taken)))
                open_ &= ~taken
                pick = int(open_.argmax())
                if not open_[pick]:
                    break
            child[node], children[node] = len(start), len(groups)
            at = a
            for pick, members in groups:
                start.append(at)
                end.append(at + len(members))
                order[at:at + len(members)] = ids[members]
                centre.append(int(ids[pick]))
                radius.append(0.0)
                child.append(0)
                children.append(0)
                at += len(members)
            node += 1
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        nodes = [np.array(x) for x in (start, end)] + [place[np.array(centre)], np.array(radius)] + [np.array(x) for x in (child, children)]
        return cls(points[order].astype(np.int64), counts[order].astype(np.int64), place[of_row], *nodes)

    def dump(self) -> list[bytes]:
        small = np.int16 if len(self.points) and np.abs(self.points).max() < 1 << 15 else np.int32
        nodes = np.stack([self.start, self.end, self.centre, self.child, self.children]).astype(np.int16 if BATCH < 1 << 14 else np.int32)
        return [bytes([np.dtype(small).itemsize]) + self.points.astype(small).tobytes(), self.counts.astype(np.int16).tobytes(),
                self.of_row.astype(np.int16).tobytes(), nodes.tobytes(), self.radius.tobytes()]

    @classmethod
    def load(cls, blobs, width: int) -> CoverTree:
        points = np.frombuffer(blobs[0], np.int16 if blobs[0][0] == 2 else np.int32, offset=1).reshape(-1, width).astype(np.int64)
        nodes = np.frombuffer(blobs[3], np.int16).reshape(5, -1).astype(np.int64)
        counts, of_row = (np.frombuffer(b, np.int16).astype(np.int64) for b in blobs[1:3])
        return cls(points, counts, of_row, nodes[0], nodes[1], nodes[2], np.frombuffer(blobs[4]), nodes[3], nodes[4])

    def walk(self, book: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(nodes, entry of each) that together cover every point once."""
        now = np.zeros(1, np.int64)
        while len(now):
            d = squared_distances(self.points[self.centre[now]], book)
            best = d.argmin(1)
            rows = np.arange(len(now))
            first = np.sqrt(d[rows, best].astype(np.float64))
            d[rows, best] = np.iinfo(np.int64).max
            second = np.sqrt(d.min(1).astype(np.float64))
            single = self.end[now] - self.start[now] == 1
            done = single | (second * (1 - 1e-12) - first * (1 + 1e-12) > 2 * self.radius[now])
            yield now[done], best[done]
            rest = now[~done]
            sizes = self.children[rest]
            ahead = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            now = np.repeat(self.child[rest], sizes) + ahead


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of two integer matrices."""
    top = max([float(np.abs(x).max()) if x.size else 0.0 for x in (a, b)])
    # sums of products below 2^53 are exact in doubles, which multiply faster
    kind = np.float64 if 4 * top * top * max(1, a.shape[1]) < 2.0 ** 52 else np.int64
    x, y = a.astype(kind), b.astype(kind)
    if kind is np.float64:
        return ((x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * (x @ y.T)).astype(np.int64)
    out = np.zeros((len(a), len(b)), np.int64)
    for k in range(a.shape[1]):
        out += (x[:, k][:, None] - y[:, k][None]) ** 2
    return out


def usable(vector: Column) -> Column:
    """Neither null nor empty, and all components finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) > 0) & finite, F.lit(False))


def integers(vector: Column, scale: int = SCALE) -> Column:
    return F.transform(vector, lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(float(BOUND))), F.lit(float(-BOUND)))).cast("int"))


def _trees(rows: DataFrame, parts: int, dim: int) -> DataFrame:
    """Stored batches: ids and labels of the rows, and the dumped tree of each part."""
    width = -(-dim // parts)
    label_type, id_type = rows.schema["label"].dataType, rows.schema["vec_id"].dataType
    schema = T.StructType([T.StructField("ids", T.ArrayType(id_type)), T.StructField("labels", T.ArrayType(label_type)), T.StructField("trees", T.ArrayType(T.ArrayType(T.BinaryType())))])
    arrow = to_arrow_schema(schema)

    def pack(held: pa.Table) -> pa.RecordBatch:
        x = np.zeros((len(held), width * parts), np.int64)
        x[:, :dim] = held["v"].combine_chunks().flatten().to_numpy().reshape(-1, dim)
        trees = [CoverTree.build(x[:, p * width:(p + 1) * width]).dump() for p in range(parts)]
        return pa.RecordBatch.from_pylist([{"ids": held["vec_id"].to_pylist(), "labels": held["label"].to_pylist(), "trees": trees}], arrow)

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for f in frames:
            new = pa.Table.from_batches([f])
            held = new if held is None else pa.concat_tables([held, new])
            while len(held) >= BATCH:
                yield pack(held.slice(0, BATCH))
                held = held.slice(BATCH)
        if held is not None and len(held):
            yield pack(held)

    return materialise(rows.select("vec_id", "label", "v").mapInArrow(batches, schema), "code_trees")


def _summed(trees: DataFrame, books: np.ndarray) -> list:
    """(part, entry, n, sums) of one round."""
    parts, width = books.shape[0], books.shape[2]

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((parts, books.shape[1], 1 + width), np.int64)
        for f in frames:
            for dumped in f["trees"]:
                for p in range(parts):
                    tree = CoverTree.load(dumped[p], width)
                    for nodes, entries in tree.walk(books[p]):
                        np.add.at(total[p], entries, tree.sums[tree.end[nodes]] - tree.sums[tree.start[nodes]])
        part, entry = np.nonzero(total[:, :, 0])
        if len(part):
            yield pd.DataFrame({"part": part, "entry": entry, "n": total[part, entry, 0], "sums": list(total[part, entry, 1:])})

    rows = trees.select("trees").mapInPandas(add, "part int, entry int, n long, sums array<long>")
    cells = [F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(width)]
    return rows.groupBy("part", "entry").agg(F.sum("n").alias("n"), *cells).collect()


def fit_codebooks(trees: DataFrame, books: np.ndarray, rounds: int) -> np.ndarray:
    for _ in range(rounds):
        new = books.copy()
        for part, entry, n, *sums in _summed(trees, books):
            new[part, entry] = [s // n for s in sums]
        books = new
    return books


def _assigned(trees: DataFrame, books: np.ndarray, label_type, id_type) -> DataFrame:
    """(vec_id, label, code, error) of every row."""
    parts, width = books.shape[0], books.shape[2]
    schema = T.StructType([T.StructField("vec_id", id_type), T.StructField("label", label_type), T.StructField("code", T.ArrayType(T.IntegerType())), T.StructField("error", T.LongType())])

    arrow = to_arrow_schema(schema)

    def assign(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in frames:
            for row in range(f.num_rows):
                # the ids and labels of the batch, as they came
                ids, labels = (f.column(c)[row].values for c in ("ids", "labels"))
                codes, error = np.empty((len(ids), parts), np.int32), np.zeros(len(ids), np.int64)
                for p, dumped in enumerate(f.column("trees")[row].as_py()):
                    tree = CoverTree.load(dumped, width)
                    entry = np.empty(len(tree.points), np.int64)
                    for nodes, entries in tree.walk(books[p]):
                        sizes = tree.end[nodes] - tree.start[nodes]
                        ahead = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                        entry[np.repeat(tree.start[nodes], sizes) + ahead] = np.repeat(entries, sizes)
                    codes[:, p] = entry[tree.of_row]
                    error += ((tree.points - books[p][entry]) ** 2).sum(1)[tree.of_row]
                lists = pa.ListArray.from_arrays(np.arange(0, codes.size + 1, parts, dtype=np.int32), codes.reshape(-1))
                columns = [ids, labels, lists, pa.array(error)]
                yield pa.RecordBatch.from_arrays([c.cast(t.type) for c, t in zip(columns, arrow)], schema=arrow)

    return materialise(trees.mapInArrow(assign, schema), "codes")


def codebooks_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def vector_codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """Codes of all usable rows of `vectors` (vec_id, embedding, label), and the codebooks (parts x entries x width).

    Per row: vec_id, label, code (entry of each part), error (squared distances summed over the parts), label_error
    (errors summed over rows with equal labels, null labels together).

    Rows whose vector is null, empty or holds null or non-finite components are left out, and so are vectors of another
    length than that of the smallest vec_id (ties: the smallest vector). Lengths that `parts` doesn't divide are filled up
    with zeros. Components are held within +-2^27 after scaling. Codebooks start from the `entries` smallest vec_ids
    (ties: by vector; null ids last); fewer rows give fewer entries, none give an empty result. Repeated rows count
    and return as often as they stand. Other columns don't matter.
    """
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", "label", F.col("embedding").alias("e")).where(usable(F.col("e"))).select("vec_id", "label", integers(F.col("e"), scale).alias("v"))
    first = rows.select("vec_id", "v").orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    label_type, id_type = rows.schema["label"].dataType, rows.schema["vec_id"].dataType
    if not first:
        empty = rows.select("vec_id", "label", F.array(F.lit(0)).alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"))
        return empty.where("false"), np.zeros((parts, 0, 0), np.int64)
    dim = len(first[0].v)
    rows = rows.where(F.size("v") == dim)
    start = [r.v for r in first if len(r.v) == dim]
    if len(start) < len(first):
        start = [r.v for r in rows.select("vec_id", "v").orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()]
    width = -(-dim // parts)
    books = np.zeros((len(start), parts * width), np.int64)
    books[:, :dim] = start
    books = np.ascontiguousarray(books.reshape(len(start), parts, width).transpose(1, 0, 2))
    trees = _trees(rows, parts, dim)
    books = fit_codebooks(trees, books, rounds)
    codes = _assigned(trees, books, label_type, id_type)
    by_label = codes.groupBy("label").agg(F.sum("error").alias("label_error")).select(F.col("label").alias("l"), "label_error")
    out = codes.join(broadcast_if_small(by_label), F.col("label").eqNullSafe(F.col("l")), "left")
    return out.select("vec_id", "label", "code", "error", "label_error"), books
