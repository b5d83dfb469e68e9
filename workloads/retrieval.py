"""Chunks, BM25, vector search and retrieval metrics over documents and benchmark passages."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from plumbtrace.functions.hashing import hash_u32
from plumbtrace.functions.scalars import rounded
from plumbtrace.operators import ireval, retrieval, textoverlap
from plumbtrace.plans import prompts

from .audit import h
from .common import stored
from .metrics import rnd
from .registry import Tables, query

SIZE, OVERLAP, DIMS = 128, 20, 32
ENGINES = ["none", "bm25", "vector"]

CHUNKS = rf"""cut AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents),
pieces AS (SELECT doc_id, unnest(range(greatest(ceil((len(w) - {OVERLAP}) / {SIZE - OVERLAP}.0), 1)::BIGINT)) AS pos, w FROM cut WHERE len(w) > 0),
placed AS (SELECT doc_id, pos::INTEGER AS chunk_pos, array_to_string(list_slice(w, pos * {SIZE - OVERLAP} + 1, pos * {SIZE - OVERLAP} + {SIZE}), ' ') AS text FROM pieces),
hashed AS (SELECT *, sha256(text) AS chunk_id FROM placed),
chunks AS (SELECT chunk_id, min(text) AS text, count(*) AS copies FROM hashed GROUP BY chunk_id)"""

TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')"

BM25 = rf"""sized AS (SELECT chunk_id, text, len({TOKENS}) AS length FROM chunks),
stats AS (SELECT count(*) AS n, avg(length) AS avgl FROM sized),
post AS (SELECT chunk_id, length, term, count(*) AS tf FROM (SELECT chunk_id, length, unnest({TOKENS}) AS term FROM sized) GROUP BY ALL),
idf AS (SELECT term, count(*) AS df, ln(1.0::DOUBLE + ((SELECT n FROM stats)::DOUBLE - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM post GROUP BY term),
asked AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({TOKENS}) AS term FROM benchmark) GROUP BY ALL),
scored AS (SELECT item_id, chunk_id, round(sum(qtf * idf * tf / (tf + 1.5::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * length / (SELECT avgl FROM stats)))), 9) AS score
  FROM asked JOIN idf USING (term) JOIN post USING (term) GROUP BY ALL),
bm25 AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, chunk_id) AS rank FROM scored QUALIFY rank <= 3)"""

VECTOR_OF = ", ".join(f"coalesce(sum(tf) FILTER (dim = {i}), 0)::DOUBLE" for i in range(DIMS))
VECTOR = f"""dims AS (SELECT term, {h('v', 'term')} % {DIMS} AS dim FROM (SELECT term FROM post UNION SELECT term FROM asked)),
cv AS (SELECT chunk_id, [{VECTOR_OF}] AS v FROM post JOIN dims USING (term) GROUP BY chunk_id),
qv AS (SELECT item_id, [{VECTOR_OF}] AS v FROM (SELECT item_id, term, qtf AS tf FROM asked) JOIN dims USING (term) GROUP BY item_id),
vector AS (SELECT item_id, chunk_id, round(list_cosine_similarity(qv.v, cv.v), 9) AS score,
  row_number() OVER (PARTITION BY item_id ORDER BY round(list_cosine_similarity(qv.v, cv.v), 9) DESC, chunk_id) AS rank FROM qv, cv QUALIFY rank <= 3)"""

LISTS = """lists AS (SELECT item_id, 'bm25' AS engine, list(chunk_id ORDER BY rank) AS ids FROM bm25 GROUP BY ALL
  UNION ALL SELECT item_id, 'vector', list(chunk_id ORDER BY rank) FROM vector GROUP BY ALL),
runs AS (SELECT b.item_id, e.engine, coalesce(l.ids, []::VARCHAR[]) AS ids FROM benchmark b CROSS JOIN (VALUES ('none'), ('bm25'), ('vector')) e(engine)
  LEFT JOIN lists l ON l.item_id = b.item_id AND l.engine = e.engine)"""

SENTENCES = r"""qrels AS (SELECT DISTINCT b.item_id, c.chunk_id FROM
  (SELECT item_id, unnest(regexp_split_to_array(array_to_string(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''), ' '), '[.!?]+ ?')) AS s FROM benchmark) b
  JOIN (SELECT chunk_id, unnest(regexp_split_to_array(text, '[.!?]+ ?')) AS s FROM chunks) c ON b.s = c.s WHERE length(b.s) > 20)"""

WITH_RUNS = f"WITH {CHUNKS}, {BM25}, {VECTOR}, {LISTS}"
WITH_QRELS = f"{WITH_RUNS}, {SENTENCES}"


def chunk_table(spark, d):
    def build():
        placed = retrieval.stride_chunks(Tables(spark, d).documents, "doc_id", "text", SIZE, OVERLAP)
        return retrieval.unique_chunks(retrieval.with_chunk_id(placed), ["doc_id", "chunk_pos"])

    return stored(spark, d, "chunks", build)


def counts(spark, d):
    return stored(spark, d, "counts", lambda: retrieval.bm25_counts(chunk_table(spark, d), "chunk_id", "text", unique=True))


def postings(spark, d):
    return retrieval.postings_of(counts(spark, d), "chunk_id")


def asked(spark, d):
    return Tables(spark, d).benchmark.select("item_id", F.col("text").alias("query"))


def bm25(spark, d):
    return retrieval.bm25_topk(asked(spark, d), "item_id", "query", chunk_table(spark, d), "chunk_id", "text", counts=counts(spark, d))


def hashed_vectors(terms, key):
    """Term counts folded into a few dimensions: a stand-in for an embedding table."""
    dim = hash_u32("v", F.col("term")) % DIMS
    t = terms.withColumn("dim", dim)
    return t.groupBy(key).agg(F.array(*[F.sum(F.when(F.col("dim") == i, F.col("tf")).otherwise(0)).cast("double") for i in range(DIMS)]).alias("v"))


def chunk_vectors(counts, key):
    """`hashed_vectors` of rows that hold a whole chunk each: folded where they are, each term hashed once a batch."""
    def fold(batches):
        for batch in batches:
            n = batch.num_rows
            named = batch.column("terms").flatten().dictionary_encode()
            dims = np.array([int(hashlib.md5(f"v|{t}".encode()).hexdigest()[:8], 16) % DIMS for t in named.dictionary.to_pylist()], dtype="int64")
            row = np.repeat(np.arange(n), batch.column("terms").value_lengths().to_numpy())
            v = np.bincount(row * DIMS + dims[named.indices.to_numpy()], batch.column("tfs").flatten().to_numpy(), n * DIMS)
            cuts = pa.array(np.arange(n + 1, dtype="int32") * DIMS)
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.ListArray.from_arrays(cuts, pa.array(v))], [key, "v"])

    return counts.select(key, "terms", "tfs").mapInArrow(fold, f"{key} string, v array<double>")


def vector_results(spark, d):
    corpus = stored(spark, d, "chunk_vectors", lambda: chunk_vectors(counts(spark, d), "chunk_id"))
    q = asked(spark, d).select("item_id", F.explode(retrieval.tokens(F.col("query"))).alias("term")).withColumn("tf", F.lit(1))
    return retrieval.vector_topk(hashed_vectors(q, "item_id"), "item_id", "v", corpus, "chunk_id", "v", 3, "cosine")


def runs(spark, d):
    def build():
        results = {"bm25": bm25(spark, d), "vector": vector_results(spark, d)}
        return retrieval.retrieval_grid(asked(spark, d), "item_id", results, "chunk_id", ENGINES)

    return stored(spark, d, "runs", build)


def qrels(spark, d):
    def build():
        flat = F.array_join(retrieval.words(F.col("query")), " ")
        q = asked(spark, d).select("item_id", F.explode(F.split(flat, "[.!?]+ ?")).alias("s")).filter(F.length("s") > 20)
        c = chunk_table(spark, d).select("chunk_id", F.explode(F.split("text", "[.!?]+ ?")).alias("s"))
        return q.join(c, "s").select("item_id", "chunk_id").distinct()

    return stored(spark, d, "qrels", build)


def judged_runs(spark, d):
    return ireval.judged_runs(runs(spark, d), qrels(spark, d), "item_id", "engine", "ids", "chunk_id")


@query("r01_stride_chunks", f"WITH {CHUNKS} SELECT doc_id, chunk_pos, text FROM placed")
def r01(spark, d):
    return retrieval.stride_chunks(Tables(spark, d).documents, "doc_id", "text", SIZE, OVERLAP)


@query("r01b_sentence_chunks")
def r01b(spark, d):
    return retrieval.sentence_chunks(Tables(spark, d).documents, "doc_id", "text")


@query("r02_unique_chunks", f"""WITH {CHUNKS} SELECT c.chunk_id, c.copies, h.doc_id, h.chunk_pos FROM chunks c JOIN
(SELECT chunk_id, doc_id, chunk_pos FROM hashed QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY doc_id, chunk_pos) = 1) h USING (chunk_id)""")
def r02(spark, d):
    placed = retrieval.stride_chunks(Tables(spark, d).documents, "doc_id", "text", SIZE, OVERLAP)
    return retrieval.unique_chunks(retrieval.with_chunk_id(placed), ["doc_id", "chunk_pos"]).select("chunk_id", "copies", "doc_id", "chunk_pos")


@query("f06_content_hash", "SELECT doc_id, sha256(text) AS chunk_id FROM documents")
def f06(spark, d):
    return retrieval.with_chunk_id(Tables(spark, d).documents).select("doc_id", "chunk_id")


@query("r03_bm25_index", f"WITH {CHUNKS}, {BM25} SELECT term, df, round(idf, 6) AS idf, (SELECT n FROM stats) AS n_chunks, round((SELECT avgl FROM stats), 6) AS avg_length FROM idf")
def r03(spark, d):
    n, length = retrieval.corpus_size(chunk_table(spark, d), postings(spark, d))
    terms = retrieval.bm25_terms(postings(spark, d), n)
    return rnd(terms, "idf").withColumn("n_chunks", F.lit(n).cast("long")).withColumn("avg_length", rounded(F.lit(length)))


@query("r04_bm25_topk", f"WITH {CHUNKS}, {BM25} SELECT item_id, chunk_id, round(score, 6) AS score, rank::INTEGER AS rank FROM bm25")
def r04(spark, d):
    return rnd(bm25(spark, d), "score")


NEAREST = """cent AS (SELECT label, list(round(a, 6) ORDER BY i) AS v FROM (SELECT label, i, avg(x::DOUBLE) AS a FROM
  (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding) AS x FROM embeddings) GROUP BY ALL) GROUP BY label)"""


def centroids(spark, d):
    e = Tables(spark, d).embeddings.select("label", F.posexplode("embedding").alias("i", "x"))
    means = e.groupBy("label", "i").agg(rounded(F.avg(F.col("x").cast("double"))).alias("a"))
    # one short row per class: its dimensions in order
    return means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "a"))).alias("s")).select(
        "label", F.transform("s", lambda x: x["a"]).alias("v"))


@query("r05_vector_topk", f"""WITH {NEAREST}, s AS (SELECT c.label AS query_label, e.vec_id, round(list_distance(c.v, e.embedding::DOUBLE[]), 9) AS score FROM cent c, embeddings e)
SELECT query_label, vec_id, round(score, 6) AS score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_label ORDER BY score, vec_id) AS rank FROM s) WHERE rank <= 3""")
def r05(spark, d):
    q = centroids(spark, d).withColumnRenamed("label", "query_label")
    return rnd(retrieval.vector_topk(q, "query_label", "v", Tables(spark, d).embeddings, "vec_id", "embedding"), "score")


def nearest_of_all(score: str, order: str) -> str:
    return f"""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id, round({score}, 9) AS score FROM v q, v c)
SELECT query_id, vec_id, round(score, 6) AS score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score {order}, vec_id) AS rank FROM s) WHERE rank <= 3"""


def all_against_all(spark, d, metric):
    e = Tables(spark, d).embeddings
    q = e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("v"))
    return rnd(retrieval.vector_topk(q, "query_id", "v", e, "vec_id", "embedding", metric=metric), "score")


# every vector is a query: a table of any size, which meets the corpus in a grid once it outgrows a broadcast


@query("r05b_vector_topk_by_cell", nearest_of_all("list_distance(q.e, c.e)", "ASC"))
def r05b(spark, d):
    return all_against_all(spark, d, "l2")


@query("r05c_vector_topk_cosine", nearest_of_all("list_cosine_similarity(q.e, c.e)", "DESC"))
def r05c(spark, d):
    return all_against_all(spark, d, "cosine")


@query("r05d_vector_topk_dot", nearest_of_all("list_inner_product(q.e, c.e)", "DESC"))
def r05d(spark, d):
    return all_against_all(spark, d, "dot")


@query("r06_none_engine", "SELECT item_id, 'none' AS engine, 0 AS n_ids FROM benchmark")
def r06(spark, d):
    r = retrieval.retrieval_grid(asked(spark, d), "item_id", {"bm25": bm25(spark, d)}, "chunk_id", ["none"])
    return r.select("item_id", "engine", F.size("ids").alias("n_ids"))


@query("r07_context", f"""{WITH_RUNS}, x AS (SELECT item_id, engine, unnest(ids) AS chunk_id, generate_subscripts(ids, 1) AS i FROM runs),
t AS (SELECT item_id, engine, string_agg(text, chr(10) ORDER BY i) AS context FROM x JOIN chunks USING (chunk_id) GROUP BY ALL)
SELECT r.item_id, r.engine, coalesce(t.context, 'No additional technical documentation available.') AS context FROM runs r LEFT JOIN t ON t.item_id = r.item_id AND t.engine = r.engine""")
def r07(spark, d):
    return retrieval.contexts(runs(spark, d), "item_id", chunk_table(spark, d), "chunk_id", "text").drop("ids")


@query("r08_judgment_pool", f"""WITH {CHUNKS}, {BM25}, {VECTOR},
pool AS (SELECT item_id, chunk_id FROM bm25 UNION SELECT item_id, chunk_id FROM vector),
ring AS (SELECT chunk_id, row_number() OVER (ORDER BY {h('pool', 'chunk_id')}, chunk_id) AS slot, count(*) OVER () AS size FROM chunks),
steps AS (SELECT b.item_id, r.chunk_id, (r.slot - 1 - {h('pool-start', 'b.item_id')}::HUGEINT % r.size + r.size) % r.size AS step FROM benchmark b, ring r),
neg AS (SELECT item_id, chunk_id FROM steps s WHERE NOT EXISTS (SELECT 1 FROM pool p WHERE p.item_id = s.item_id AND p.chunk_id = s.chunk_id)
  QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY step) <= 2),
both_ AS (SELECT item_id, chunk_id, false AS is_negative FROM pool UNION ALL SELECT item_id, chunk_id, true FROM neg)
SELECT *, (row_number() OVER (PARTITION BY item_id ORDER BY {h('pool-order', 'item_id', 'chunk_id')}, chunk_id))::INTEGER AS position FROM both_""")
def r08(spark, d):
    return retrieval.judgment_pool(vector_results(spark, d), bm25(spark, d), asked(spark, d), chunk_table(spark, d), "item_id", "chunk_id", "pool")


@query("r09_retrieval_grid", f"{WITH_RUNS} SELECT item_id, engine, ids FROM runs")
def r09(spark, d):
    return runs(spark, d)


# ---- retrieval metrics -----------------------------------------------------------

FLAGS = f"""{WITH_QRELS}, items AS (SELECT item_id, engine, unnest(ids) AS chunk_id, generate_subscripts(ids, 1) AS rank FROM runs),
hits AS (SELECT i.*, q.item_id IS NOT NULL AS rel FROM items i LEFT JOIN qrels q ON q.item_id = i.item_id AND q.chunk_id = i.chunk_id),
tot AS (SELECT b.item_id, count(q.chunk_id) AS total FROM benchmark b LEFT JOIN qrels q USING (item_id) GROUP BY ALL),
agg AS (SELECT r.item_id, r.engine, len(r.ids) AS n, t.total, count(*) FILTER (rel AND rank <= 3) AS h3, min(rank) FILTER (rel) AS first_rank,
  coalesce(sum(1.0::DOUBLE / log2(rank + 1)) FILTER (rel AND rank <= 3), 0) AS dcg
  FROM runs r JOIN tot t USING (item_id) LEFT JOIN hits h ON h.item_id = r.item_id AND h.engine = r.engine GROUP BY ALL),
m AS (SELECT item_id, engine, n > 0 AND engine <> 'none' AS ok, h3 / 3.0::DOUBLE AS p, CASE WHEN total = 0 THEN 0 ELSE h3 / total::DOUBLE END AS r,
  (h3 > 0)::INTEGER::DOUBLE AS h, coalesce(1.0::DOUBLE / first_rank, 0) AS mrr,
  CASE WHEN total = 0 THEN 0 ELSE dcg / list_sum(list_transform(range(1, least(total, 3) + 1), lambda i: 1.0::DOUBLE / log2(i + 1))) END AS ndcg FROM agg)"""


def metric_query(name, column, short, fn):
    @query(name, f"{FLAGS} SELECT item_id, engine, round(CASE WHEN ok THEN {short} END, 6) AS {column} FROM m")
    def run(spark, d):
        scores = ireval.score_runs(judged_runs(spark, d), "item_id", "engine", "ids")
        return scores.select("item_id", "engine", rounded(F.col(fn)).alias(column))


metric_query("e01_precision_at_k", "precision", "p", "precision_at_3")
metric_query("e02_recall_at_k", "recall", "r", "recall_at_3")
metric_query("e03_hit_at_k", "hit", "h", "hit_at_3")
metric_query("e04_mrr", "mrr", "mrr", "mrr")
metric_query("e05_ndcg_at_k", "ndcg", "ndcg", "ndcg_at_3")

ALL = ["precision_at_3", "recall_at_3", "hit_at_3", "mrr", "ndcg_at_3"]
SHORT = dict(zip(ALL, ["p", "r", "h", "mrr", "ndcg"]))


@query("e06_ir_metrics_detailed", f"{FLAGS} SELECT item_id, engine, {', '.join(f'round(CASE WHEN ok THEN {s} END, 6) AS {n}' for n, s in SHORT.items())} FROM m")
def e06(spark, d):
    return rnd(ireval.score_runs(judged_runs(spark, d), "item_id", "engine", "ids"), *ALL)


@query("e07_engine_summary", f"{FLAGS} SELECT engine, {', '.join(f'round(avg(CASE WHEN ok THEN {s} END), 4) AS {n}' for n, s in SHORT.items())}, count(CASE WHEN ok THEN 1 END) AS n FROM m GROUP BY engine")
def e07(spark, d):
    return ireval.engine_summary(ireval.score_runs(judged_runs(spark, d), "item_id", "engine", "ids"), "engine", ALL)


# ---- text overlap ------------------------------------------------------------------

PAIRS = """pairs AS (SELECT a.conv_id, a.turn, a.text AS candidate, b.text AS reference FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1)"""


def pairs(spark, d):
    c = Tables(spark, d).conversations
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reference"))
    return c.select("conv_id", "turn", F.col("text").alias("candidate")).join(nxt, ["conv_id", "turn"])


def rouge_sql(n):
    grams = "t" if n == 1 else "list_transform(range(1, greatest(len(t), 1)), lambda i: t[i] || ' ' || t[i + 1])"
    tok = "regexp_extract_all(lower({}), '[a-z0-9]+')"
    return f"""WITH {PAIRS}, t AS (SELECT conv_id, turn, 'c' AS side, {tok.format('candidate')} AS t FROM pairs UNION ALL SELECT conv_id, turn, 'r', {tok.format('reference')} FROM pairs),
g AS (SELECT conv_id, turn, side, unnest({grams}) AS gram FROM t),
k AS (SELECT conv_id, turn, gram, count(*) FILTER (side = 'c') AS c, count(*) FILTER (side = 'r') AS r FROM g GROUP BY ALL),
s AS (SELECT p.conv_id, p.turn, coalesce(sum(least(c, r)), 0)::DOUBLE AS hits, coalesce(sum(c), 0)::DOUBLE AS c, coalesce(sum(r), 0)::DOUBLE AS r FROM pairs p LEFT JOIN k ON k.conv_id = p.conv_id AND k.turn = p.turn GROUP BY ALL),
q AS (SELECT conv_id, turn, CASE WHEN c = 0 THEN 0 ELSE hits / c END AS p, CASE WHEN r = 0 THEN 0 ELSE hits / r END AS rc FROM s)
SELECT conv_id, turn, round(p, 6) AS precision, round(rc, 6) AS recall, round(CASE WHEN p + rc = 0 THEN 0 ELSE 2 * p * rc / (p + rc) END, 6) AS f1 FROM q"""


@query("e08_rouge1", rouge_sql(1))
def e08(spark, d):
    return rnd(textoverlap.rouge_n(pairs(spark, d), ["conv_id", "turn"], "candidate", "reference", 1), "precision", "recall", "f1")


@query("e08b_rouge2", rouge_sql(2))
def e08b(spark, d):
    return rnd(textoverlap.rouge_n(pairs(spark, d), ["conv_id", "turn"], "candidate", "reference", 2), "precision", "recall", "f1")


@query("e08c_rouge_l")
def e08c(spark, d):
    return rnd(textoverlap.rouge_l(pairs(spark, d), ["conv_id", "turn"], "candidate", "reference"), "precision", "recall", "f1")


@query("e09_embedding_match", """
WITH t AS (SELECT vec_id // 20 AS pair, CASE WHEN vec_id % 2 = 0 THEN 'candidate' ELSE 'reference' END AS side, vec_id, embedding::DOUBLE[] AS v FROM embeddings),
s AS (SELECT a.pair, a.side, a.vec_id, max(list_cosine_similarity(a.v, b.v)) AS s FROM t a JOIN t b ON a.pair = b.pair AND a.side <> b.side GROUP BY ALL),
m AS (SELECT pair, avg(s) FILTER (side = 'candidate') AS p, avg(s) FILTER (side = 'reference') AS r FROM s GROUP BY pair)
SELECT pair, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / (p + r), 6) AS f1 FROM m""")
def e09(spark, d):
    t = Tables(spark, d).embeddings.select(
        F.floor(F.col("vec_id") / 20).alias("pair"), F.when(F.col("vec_id") % 2 == 0, "candidate").otherwise("reference").alias("side"),
        "vec_id", "embedding")
    return rnd(textoverlap.embedding_match(t, "pair", "side", "vec_id", "embedding"), "precision", "recall", "f1")


@query("j10_relevance_join", f"""{WITH_QRELS}, items AS (SELECT item_id, engine, unnest(ids) AS chunk_id, generate_subscripts(ids, 1) AS rank FROM runs)
SELECT i.item_id, i.engine, i.rank::INTEGER AS rank, i.chunk_id, q.item_id IS NOT NULL AS relevant FROM items i LEFT JOIN qrels q ON q.item_id = i.item_id AND q.chunk_id = i.chunk_id""")
def j10(spark, d):
    return ireval.relevance_join(runs(spark, d), qrels(spark, d), "item_id", "engine", "ids", "chunk_id")
