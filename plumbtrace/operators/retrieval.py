"""Chunking, BM25 and vector top-k, contexts and judgement pools."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from plumbtrace.functions.binding import bind, let
from plumbtrace.functions.hashing import hash_u32
from .bounded import broadcast_if_small
from .ordered import top_k
from .scoring import spread
from .splits import random_negatives

# Chunk size and overlap, results per query, BM25 parameters.
CHUNK_SIZE, CHUNK_OVERLAP = 512, 20
TOP_K = 3
BM25_K1, BM25_B = 1.5, 0.75
NO_CONTEXT = "No additional technical documentation available."
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"
SENTENCE_END = r"(?<=[.!?])\s+"


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def tokens(text: Column) -> Column:
    """Lower-case runs of at least two letters, digits or underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), 0)


def stride_chunks(docs: DataFrame, doc: str, text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Windows of `size` words that share `overlap` words with the one before."""
    stride = size - overlap
    cut = bind(docs.select(doc, text), _w=words(F.col(text))).filter(F.size("_w") > 0)
    n = F.greatest(F.ceil((F.size("_w") - overlap) / float(stride)), F.lit(1)).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array_join(F.slice("_w", i * stride + 1, size), " "))
    return bind(cut, _pieces=pieces).select(doc, F.posexplode("_pieces").alias("chunk_pos", "text"))


def sentence_chunks(docs: DataFrame, doc: str, text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Greedy packing of whole sentences into at most `size` words.

    A sentence longer than a chunk is cut into pieces of `size` words first. When a
    chunk closes, its last sentences of together at most `overlap` words open the
    next one. One fold per document, inside the JVM.
    """
    sentence_type = "array<struct<t:string,n:int>>"
    as_pieces = lambda s: let(words(s), lambda w: F.when(F.size(w) == 0, F.array().cast("array<array<string>>")).otherwise(F.transform(
        F.sequence(F.lit(0), F.floor((F.size(w) - 1) / F.lit(size)).cast("int")), lambda i: F.slice(w, i * size + 1, size))))
    units = F.transform(
        F.flatten(F.transform(F.split(F.col(text), SENTENCE_END), as_pieces)),
        lambda w: F.struct(F.array_join(w, " ").alias("t"), F.size(w).alias("n")))
    cut = bind(docs.select(doc, text), _u=units.cast(sentence_type)).filter(F.size("_u") > 0)

    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x["n"])
    joined = lambda a: F.array_join(F.transform(a, lambda x: x["t"]), " ")
    # tail of the closed chunk that fits the overlap: walk backwards, stop at the first misfit
    tail = lambda a, room: F.aggregate(
        F.reverse(a), F.struct(F.array().cast(sentence_type).alias("k"), F.lit(0).alias("n"), F.lit(False).alias("stop")),
        lambda s, x: F.when(s["stop"] | (s["n"] + x["n"] > room), F.struct(s["k"].alias("k"), s["n"].alias("n"), F.lit(True).alias("stop")))
        .otherwise(F.struct(F.concat(F.array(x), s["k"]).alias("k"), (s["n"] + x["n"]).alias("n"), F.lit(False).alias("stop"))),
        lambda s: s["k"])
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast(sentence_type).alias("open"))
    step = lambda s, x: F.when(
        (F.size(s["open"]) == 0) | (total(s["open"]) + x["n"] <= size),
        F.struct(s["done"].alias("done"), F.concat(s["open"], F.array(x)).alias("open")),
    ).otherwise(F.struct(
        F.concat(s["done"], F.array(joined(s["open"]))).alias("done"),
        F.concat(tail(s["open"], F.least(F.lit(overlap), F.lit(size) - x["n"])), F.array(x)).alias("open")))
    chunks = F.aggregate("_u", empty, step, lambda s: F.concat(s["done"], F.array(joined(s["open"]))))
    return bind(cut, _chunks=chunks).select(doc, F.posexplode("_chunks").alias("chunk_pos", "text"))


def with_chunk_id(chunks: DataFrame, text: str = "text") -> DataFrame:
    return chunks.withColumn("chunk_id", F.sha2(F.col(text), 256))


def unique_chunks(chunks: DataFrame, order: list[str]) -> DataFrame:
    """One row per chunk id, taken from its first place. Copies meet in a map-side aggregate."""
    rest = [c for c in chunks.columns if c != "chunk_id"]
    first = F.min_by(F.struct(*rest), F.struct(*order))
    return chunks.groupBy("chunk_id").agg(first.alias("_c"), F.count("*").alias("copies")).select("chunk_id", "_c.*", "copies")


def bm25_counts(chunks: DataFrame, key: str, text: str, unique: bool = False) -> DataFrame:
    """(chunk, length, terms, tfs): one row per chunk, its different terms and how often each occurs.

    With `unique`, each key comes once and chunks are counted where they are, without a shuffle.
    Otherwise rows of the same key and length are put together first.
    """
    t = bind(spread(chunks.select(key, text), [key]), _t=tokens(F.col(text))).withColumn("length", F.size("_t")).filter(F.col("length") > 0)
    if not unique:
        t = t.groupBy(key, "length").agg(F.flatten(F.collect_list("_t")).alias("_t"))
    out = T.StructType([chunks.schema[key], T.StructField("length", T.IntegerType()), T.StructField("terms", T.ArrayType(T.StringType())),
                        T.StructField("tfs", T.ArrayType(T.LongType()))])

    def count(batches):
        for batch in batches:
            found = batch.column("_t")
            n = len(found)
            named = found.flatten().dictionary_encode()
            row = np.repeat(np.arange(n), found.value_lengths().to_numpy())
            pairs, tfs = np.unique(row * max(1, len(named.dictionary)) + named.indices.to_numpy(), return_counts=True)
            row, code = np.divmod(pairs, max(1, len(named.dictionary)))
            cuts = pa.array(np.searchsorted(row, np.arange(n + 1)).astype("int32"))
            terms = pa.ListArray.from_arrays(cuts, named.dictionary.take(pa.array(code)))
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column("length"), terms, pa.ListArray.from_arrays(cuts, pa.array(tfs.astype("int64")))],
                                             [key, "length", "terms", "tfs"])

    return t.select(key, "length", "_t").mapInArrow(count, out)


def postings_of(counts: DataFrame, key: str) -> DataFrame:
    """(chunk, length, term, tf) from rows of `bm25_counts`."""
    return counts.select(key, "length", F.explode(F.arrays_zip("terms", "tfs")).alias("_p")).select(
        key, "length", F.col("_p.terms").alias("term"), F.col("_p.tfs").alias("tf"))


def bm25_postings(chunks: DataFrame, key: str, text: str) -> DataFrame:
    """(chunk, length, term, tf). Terms are counted inside each chunk row."""
    return postings_of(bm25_counts(chunks, key, text), key)


def corpus_size(chunks: DataFrame, postings: DataFrame) -> tuple[int, float]:
    """Number of chunks (also those without a token) and their mean length: two numbers."""
    n = chunks.count()
    total = postings.agg(F.sum("tf")).first()[0] or 0
    return n, (total / n if n else 0.0)


def bm25_terms(postings: DataFrame, n_chunks: int) -> DataFrame:
    """Document frequency and idf per term."""
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    return df.withColumn("idf", F.log(1.0 + (F.lit(float(n_chunks)) - F.col("df") + 0.5) / (F.col("df") + 0.5)))


SALTS = 16


def bm25_topk(queries: DataFrame, query: str, text: str, chunks: DataFrame, key: str, chunk_text: str,
              k: int = TOP_K, k1: float = BM25_K1, b: float = BM25_B, postings: DataFrame | None = None,
              broadcast_limit: int = 20_000, counts: DataFrame | None = None) -> DataFrame:
    """k best chunks per query: every query term counts, however common it is.

    Query terms are broadcast while they are few: each task then runs through its chunks with the k best of
    each query, and no pair of query and chunk becomes a row. Otherwise the join on the term is salted by chunk,
    so that a term found in most chunks spreads over many tasks. `counts` are rows of `bm25_counts`, each key
    once; from `postings`, those of a chunk are gathered first.
    """
    if postings is None:
        postings = bm25_postings(chunks, key, chunk_text) if counts is None else postings_of(counts, key)
    n_chunks, avg_length = corpus_size(chunks, postings)
    asked = queries.select(query, F.explode(tokens(F.col(text))).alias("term")).groupBy(query, "term").agg(F.count("*").alias("qtf"))
    vocabulary = broadcast_if_small(asked.select("term").distinct(), broadcast_limit)
    found = postings.join(vocabulary, "term", "left_semi")
    weighted = asked.join(bm25_terms(found, n_chunks), "term").select(query, "term", (F.col("qtf") * F.col("idf")).alias("weight"))
    few = weighted.limit(broadcast_limit + 1).collect()
    norm = k1 * (1 - b + b * F.col("length") / F.lit(avg_length or 1.0))
    order = [F.col("score").desc(), F.col(key)]
    if len(few) <= broadcast_limit:
        gain = F.col("tf") / (F.col("tf") + norm)
        if counts is None:
            hits = found.groupBy(key).agg(F.collect_list(F.struct("term", gain.alias("gain"))).alias("_h"))
            hits = hits.select(key, F.col("_h.term").alias("terms"), F.col("_h.gain").alias("gains"))
        else:
            hits = counts.select(key, "terms", F.transform("tfs", lambda tf: tf / (tf + norm)).alias("gains"))
        return top_k(_best_chunks(hits, key, few, weighted.schema[query], k), [query], order, k)
    salted = postings.withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(SALTS)))
    spread = weighted.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    gain = F.col("weight") * F.col("tf") / (F.col("tf") + norm)
    scored = salted.join(spread, ["term", "_salt"]).groupBy(query, key).agg(F.round(F.sum(gain), 9).alias("score"))
    return top_k(scored, [query], order, k)


#: Queries and (query, term) weights that one matrix product covers, and cells of its other side.
PRODUCT_QUERIES, PRODUCT_WEIGHTS, PRODUCT_CELLS = 256, 4096, 1 << 21


def _best_chunks(hits: DataFrame, key: str, weighted: list, query: T.StructField, k: int) -> DataFrame:
    """The k best chunks of each query within each task, from (chunk, terms, gains) and few (query, term, weight)."""
    places: dict = {}
    weights: list[list[tuple[str, float]]] = []
    for name, term, weight in weighted:
        at = places.setdefault(name, len(places))
        if at == len(weights):
            weights.append([])
        weights[at].append((term, weight))
    blocks, first = [], 0
    while first < len(weights):
        last, size = first + 1, len(weights[first])
        while last < len(weights) and last - first < PRODUCT_QUERIES and size + len(weights[last]) <= PRODUCT_WEIGHTS:
            size += len(weights[last])
            last += 1
        blocks.append(weights[first:last])
        first = last
    session = hits.sparkSession
    shared = session.sparkContext.broadcast(blocks)
    schema = T.StructType([T.StructField("_q", T.IntegerType()), hits.schema[key], T.StructField("score", T.DoubleType())])

    def best_of_task(batches):
        products = []
        for block in shared.value:
            names = {term: i for i, term in enumerate(dict.fromkeys(term for one in block for term, _ in one))}
            matrix = np.zeros((len(names), len(block)))
            for i, one in enumerate(block):
                for term, weight in one:
                    matrix[names[term], i] += weight
            products.append((pa.array(list(names), pa.string()), matrix, RunningBest(list(range(len(block))), np.zeros((0, 0)), k, "bm25")))
        kind = None
        for batch in batches:
            kind = batch.schema.field(key).type
            keys = np.empty(batch.num_rows, dtype=object)
            keys[:] = batch.column(key).to_pylist()
            row = np.repeat(np.arange(batch.num_rows), batch.column("terms").value_lengths().to_numpy())
            terms, gains = batch.column("terms").flatten(), batch.column("gains").flatten().to_numpy()
            for names, matrix, state in products:
                place = pc.fill_null(pc.index_in(terms, value_set=names), -1).to_numpy()
                used = np.flatnonzero(place >= 0)
                step = max(64, PRODUCT_CELLS // len(names))
                for at in range(0, batch.num_rows, step):
                    some = used[np.searchsorted(row[used], at):np.searchsorted(row[used], at + step)]
                    n = min(step, batch.num_rows - at)
                    grid = np.bincount((row[some] - at) * len(names) + place[some], gains[some], n * len(names)).reshape(n, -1)
                    scores = (grid @ matrix).T
                    state.offer(0, np.where(scores > 0, -np.round(scores, 9), np.nan), keys[at:at + n])
        offset = 0
        for _, _, state in products if kind is not None else []:
            sizes = [len(loss) for loss, _ in state.best]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(np.arange(offset, offset + len(sizes)), sizes).astype("int32")),
                pa.array([name for _, names in state.best for name in names], kind),
                pa.array(-np.concatenate([loss for loss, _ in state.best]))], ["_q", key, "score"])
            offset += len(sizes)

    named = session.createDataFrame(list(enumerate(places)), T.StructType([schema["_q"], query]))
    return hits.mapInArrow(best_of_task, schema).join(F.broadcast(named), "_q").select(query.name, key, F.round("score", 9).alias("score"))


#: Bytes of the query matrix that travel to every task; larger query tables meet the corpus in a grid of blocks.
BROADCAST_BYTES = 16 << 20
#: Bytes of vectors on either side of a cell of the grid.
QUERY_BLOCK_BYTES, CORPUS_BLOCK_BYTES = 4 << 20, 32 << 20


class RunningBest:
    """The k best corpus rows of every query of a block, over any number of batches.

    Scores are compared as rounded to nine digits, ties by key. A batch costs one matrix product; only queries
    that a batch improves are merged.
    """

    def __init__(self, ids: list, queries: np.ndarray, k: int, metric: str):
        self.ids, self.queries, self.k, self.metric = ids, queries, k, metric
        self.bar = np.full(len(ids), np.inf)
        self.best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0, dtype=object))] * len(ids)

    def add(self, keys: np.ndarray, vectors: np.ndarray) -> None:
        for at in range(0, len(self.ids), 256):
            scores = np.round(similarity(self.queries[at:at + 256], vectors, self.metric), 9)
            self.offer(at, scores if self.metric == "l2" else -scores, keys)

    def offer(self, at: int, loss: np.ndarray, keys: np.ndarray) -> None:
        """Losses of the queries from number `at` on, a row each, against the corpus rows `keys`; NaN takes no part."""
        near = loss <= self.bar[at:at + len(loss)][:, None]
        for i in np.flatnonzero(near.any(1)):
            take = np.flatnonzero(near[i])
            if len(take) > self.k:
                # all rows that tie with the k-th stay until keys decide
                limit = np.partition(loss[i, take], self.k - 1)[self.k - 1]
                take = take[loss[i, take] <= limit]
            old_loss, old_keys = self.best[at + i]
            both, names = np.concatenate([old_loss, loss[i, take]]), np.concatenate([old_keys, keys[take]])
            missing = np.array([name is None for name in names])
            if missing.any():
                # a missing key comes first among ties
                order = np.concatenate([np.flatnonzero(missing), (known := np.flatnonzero(~missing))[np.argsort(names[known], kind="stable")]])
                order = order[np.argsort(both[order], kind="stable")][:self.k]
            else:
                order = np.lexsort((names, both))[:self.k]
            self.best[at + i] = both[order], names[order]
            if len(order) == self.k:
                self.bar[at + i] = both[order[-1]]

    def rows(self, query: str, key: str) -> pd.DataFrame:
        sizes = [len(loss) for loss, _ in self.best]
        loss = np.concatenate([x for x, _ in self.best]) if self.ids else np.zeros(0)
        names = np.concatenate([x for _, x in self.best]) if self.ids else np.zeros(0, dtype=object)
        ids = [name for name, n in zip(self.ids, sizes) for _ in range(n)]
        return pd.DataFrame({query: pd.Series(ids, dtype=object), key: pd.Series(names, dtype=object), "score": loss if self.metric == "l2" else -loss})


def vector_topk(queries: DataFrame, query: str, query_vector: str, corpus: DataFrame, key: str, vector: str,
                k: int = TOP_K, metric: str = "l2") -> DataFrame:
    """Exact k nearest corpus rows per query, for any number of queries: distance for l2, similarity for cosine and dot.

    A query matrix of at most `BROADCAST_BYTES` travels to every task, which runs through its rows with the k best of
    each query. Larger query tables meet the corpus in a grid: both are dealt to blocks of bounded bytes, and each cell
    (query block, corpus block) does the same. Either way a task hands on k rows per query, merged once; no pair
    becomes a row. Rows without a vector take no part.
    """
    queries = queries.select(query, query_vector).where(F.col(query_vector).isNotNull())
    corpus = corpus.select(key, vector).where(F.col(vector).isNotNull())
    size = queries.agg(F.count("*").alias("n"), F.max(F.size(query_vector)).alias("d")).first()
    schema = T.StructType([queries.schema[query], corpus.schema[key], T.StructField("score", T.DoubleType())])
    if not size["n"]:
        empty = T.StructType([*schema.fields, T.StructField("rank", T.IntegerType())])
        return queries.sparkSession.createDataFrame([], empty)
    row_bytes = 8 * size["d"]
    if size["n"] * row_bytes <= BROADCAST_BYTES:
        rows = queries.collect()
        shared = queries.sparkSession.sparkContext.broadcast(([r[query] for r in rows], np.asarray([r[query_vector] for r in rows], dtype="float64")))

        def best_of_task(batches):
            state = RunningBest(*shared.value, k, metric)
            for batch in batches:
                if len(batch):
                    state.add(batch[key].to_numpy(dtype=object), np.stack(batch[vector].to_numpy()).astype("float64"))
            yield state.rows(query, key)

        partial = corpus.mapInPandas(best_of_task, schema)
    else:
        partial = _grid_best(queries, query, query_vector, corpus, key, vector, k, metric, size["n"], row_bytes, schema)
    partial = partial.withColumn("score", F.round("score", 9))
    order = F.col("score").asc() if metric == "l2" else F.col("score").desc()
    return top_k(partial, [query], [order, F.col(key)], k)


def _grid_best(queries: DataFrame, query: str, query_vector: str, corpus: DataFrame, key: str, vector: str, k: int, metric: str,
               n: int, row_bytes: int, schema: T.StructType) -> DataFrame:
    """The k best rows of each query in each corpus block, from a grid of blocks."""
    q_blocks = -(-n * row_bytes // QUERY_BLOCK_BYTES)
    c_blocks = max(-(-corpus.count() * row_bytes // CORPUS_BLOCK_BYTES), queries.sparkSession.sparkContext.defaultParallelism // q_blocks, 1)
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(int(blocks) - 1)))
    # the place in the grid is a hash of the whole row, so a key that repeats is spread as well
    left = queries.select(F.pmod(F.xxhash64(query, query_vector), F.lit(int(q_blocks))).cast("int").alias("_q"), every(c_blocks).alias("_c"), query, query_vector)
    right = corpus.select(every(q_blocks).alias("_q"), F.pmod(F.xxhash64(key, vector), F.lit(int(c_blocks))).cast("int").alias("_c"), key, vector)

    def meet(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(q):
            return pd.DataFrame({f.name: [] for f in schema.fields})
        state = RunningBest(q[query].tolist(), np.stack(q[query_vector].to_numpy()).astype("float64"), k, metric)
        for at in range(0, len(c), 4096):
            part = c.iloc[at:at + 4096]
            state.add(part[key].to_numpy(dtype=object), np.stack(part[vector].to_numpy()).astype("float64"))
        return state.rows(query, key)

    return left.groupBy("_q", "_c").cogroup(right.groupBy("_q", "_c")).applyInPandas(meet, schema)


def similarity(queries: np.ndarray, corpus: np.ndarray, metric: str) -> np.ndarray:
    product = queries @ corpus.T
    if metric == "dot":
        return product
    q2, c2 = (queries ** 2).sum(1)[:, None], (corpus ** 2).sum(1)[None, :]
    if metric == "cosine":
        return product / np.maximum(np.sqrt(q2 * c2), 1e-300)
    return np.sqrt(np.maximum(q2 + c2 - 2 * product, 0.0))


def pooled(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Union of two result lists, each pair once."""
    return first.select(*keys).union(second.select(*keys)).dropDuplicates(keys)


def judgment_pool(first: DataFrame, second: DataFrame, queries: DataFrame, candidates: DataFrame, query: str, item: str,
                  seed, negatives: int = 2) -> DataFrame:
    """Both result lists and a few random others per query, in a seeded random order."""
    pool = pooled(first, second, [query, item])
    extra = random_negatives(queries, candidates, pool, query, item, seed, negatives)
    both = pool.withColumn("is_negative", F.lit(False)).unionByName(extra.withColumn("is_negative", F.lit(True)))
    w = Window.partitionBy(query).orderBy(hash_u32(f"{seed}-order", F.col(query), F.col(item)), item)
    return both.withColumn("position", F.row_number().over(w))


def run_lists(ranked: DataFrame, query: str, engine: str, item: str) -> DataFrame:
    """(query, engine, ordered ids): at most k rows per list."""
    lists = ranked.groupBy(query).agg(F.array_sort(F.collect_list(F.struct("rank", F.col(item).alias("id")))).alias("_l"))
    return lists.select(query, F.lit(engine).alias("engine"), F.transform("_l", lambda x: x["id"]).alias("ids"))


def retrieval_grid(queries: DataFrame, query: str, results: dict[str, DataFrame], item: str, engines: list[str]) -> DataFrame:
    """Every query with every engine and its ordered ids; [] where nothing was retrieved."""
    from plumbtrace.streaming.resume import work_grid

    grid = work_grid(queries.select(query), engines)
    lists = None
    for name, ranked in results.items():
        one = run_lists(ranked, query, name, item)
        lists = one if lists is None else lists.unionByName(one)
    joined = grid.join(lists, [query, "engine"], "left")
    return joined.withColumn("ids", F.coalesce("ids", F.array().cast(lists.schema["ids"].dataType)))


def contexts(runs: DataFrame, query: str, chunks: DataFrame, key: str, text: str, fallback: str = NO_CONTEXT) -> DataFrame:
    """Texts of the retrieved chunks in rank order, or the fallback sentence."""
    rows = runs.select(query, "engine", F.posexplode("ids").alias("_pos", key)).join(chunks.select(key, text), key)
    joined = rows.groupBy(query, "engine").agg(F.array_sort(F.collect_list(F.struct("_pos", text))).alias("_t"))
    out = runs.join(joined, [query, "engine"], "left")
    texts = F.array_join(F.transform("_t", lambda x: x[text]), "\n")
    return out.withColumn("context", F.coalesce(texts, F.lit(fallback))).drop("_t")
