"""One query per operator, over the supplied tables, next to the SQL that checks it where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import (
    credentials, decontaminate, document_quality, embedding_duplicates, language, main_text, mixing, near_duplicates, one_bit_search,
    periodic_runs, token_frames, toxicity, vector_codes,
)
from .common import distinct_labels, fold, ship, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship(spark)
            return fn(spark, folder)

        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql.strip()
        return fn

    return register


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


OP1_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark WHERE item_id IS NOT NULL),
g AS (
  SELECT DISTINCT item, least(len(words), 13) AS n, array_to_string(words[k:k + 12], ' ') AS gram
  FROM b, LATERAL (SELECT unnest(range(1, greatest(2, len(words) - 11))) AS k) WHERE len(words) > 0),
lengths AS (SELECT DISTINCT n FROM g),
occ AS (
  SELECT w.doc_id, k, l.n, array_to_string(words[k:k + l.n - 1], ' ') AS gram
  FROM w, lengths l, LATERAL (SELECT unnest(range(1, greatest(1, len(words) - l.n + 2))) AS k)),
hit AS (SELECT doc_id, k, n, item FROM occ JOIN g USING (n, gram)),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, k, n FROM hit), LATERAL (SELECT unnest(range(k, k + n)) AS p) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY 1)
SELECT w.doc_id, CAST(coalesce(len(words), 0) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= coalesce(len(words), 0) AS contaminated
FROM w LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@query("op1_decontaminate", OP1_SQL)
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op2_mix")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    documents, _ = mixing.mix(table(spark, folder, "documents"))
    return documents.select("doc_id", "size", "source_size", "target", "taken", "source")


@query("op3_token_frames")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return token_frames.token_digest(table(spark, folder, "documents"), tokenizer_path())


@query("op6_language")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang", fold(F.col("doc_id"), 4).alias("fold"))
    o = F.col("language")
    return language.identify(docs, F.col("fold") != 2).select(
        "doc_id", (F.col("fold") == 2).alias("held_out"), o.lang_pred.alias("lang_pred"), o.score.alias("score")
    )


@query("op9_quality")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    labels = distinct_labels(table(spark, folder, "labels"), "quality").where(fold(F.col("doc_id"), 5) != 0)
    scores = document_quality.quality_scores(docs, labels)
    return scores.select(
        "doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


@query("op5_toxicity")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    labels = distinct_labels(table(spark, folder, "labels"), "toxic").where(fold(F.col("doc_id"), 3) != 1)
    return toxicity.toxicity_scores(docs, labels).select(
        "doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


@query("op7_secrets")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    s = F.col("secrets")
    return credentials.find_secrets(table(spark, folder, "documents").select("doc_id", "text")).select(
        "doc_id", s.n_assign.alias("n_assign"), s.n_access.alias("n_access"), s.n_hex.alias("n_hex"),
        F.sha2(s.base, 256).alias("base_sha256"), s.spans.alias("spans"),
    )


@query("op4_near_duplicates")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, folder, "documents").select("doc_id", "text")).drop("h")


@query("op8_one_bit_search")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return one_bit_search.search(table(spark, folder, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 100 == 0)


@query("op10_main_text")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return main_text.extract_pages(table(spark, folder, "pages").select("page_id", "url", "html"))


def with_period(text: Column, doc_id: Column) -> Column:
    """The text, made periodic from a word on where the last digit of crc32(doc_id) is 0.

    With h = crc32 of the decimal id, g = floor(h / 10) and n words, word i >= a = g mod n becomes word
    a + (i - a) mod p, p = 1 + floor((n - a) / (3 + g mod 8)).
    """
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    trimmed = F.regexp_replace(text, r"^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$", "")
    w = F.split(trimmed, r"[ \t\n\x0B\f\r]+")
    n = F.size(w)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    # no lambdas: Spark can't hand their results to a Python function
    tail = F.slice(F.flatten(F.array_repeat(F.slice(w, a + 1, p), F.ceil((n - a) / p).cast("int"))), 1, n - a)
    changed = F.array_join(F.concat(F.slice(w, 1, a), tail), " ")
    return F.when((h % 10 == 0) & (trimmed != ""), changed).otherwise(text)


@query("op11_periodic_runs")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", with_period(F.col("text"), F.col("doc_id")).alias("text"))
    found = docs.select("doc_id", periodic_runs.periodic_runs(F.col("text")).alias("p"))
    found = found.select("doc_id", "p.runs", "p.best", "p.collapsed")
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"),
        F.col("best.period").alias("period"), F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )


def _op12_sql(parts: int = vector_codes.PARTS, rounds: int = vector_codes.ROUNDS) -> str:
    """Distances of all parts to all entries, round by round."""
    steps = ["""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT vec_id, part, v[part * (len(v) // %(parts)d) + 1:(part + 1) * (len(v) // %(parts)d)] AS x FROM kept, (SELECT unnest(range(%(parts)d)) AS part)),
b0 AS (SELECT part, CAST(row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS BIGINT) AS entry, x AS c FROM p QUALIFY entry < 256)""" % {"parts": parts}]
    near = """
a%(r)d AS (
  SELECT vec_id, part, x, arg_min(entry, d * 256 + entry) AS entry, min(d) AS d
  FROM (SELECT vec_id, p.part, x, entry, list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c) AS d FROM p JOIN b%(r)d b ON b.part = p.part)
  GROUP BY vec_id, part, x)"""
    for r in range(rounds):
        steps.append(near % {"r": r})
        steps.append("""
m%(r)d AS (SELECT part, entry, list(s ORDER BY k) AS c FROM (
  SELECT part, entry, k, floor(sum(x[k]) / count(*)) AS s FROM a%(r)d, LATERAL (SELECT unnest(range(1, len(x) + 1)) AS k) GROUP BY part, entry, k) GROUP BY part, entry),
b%(next)d AS (SELECT b.part, b.entry, coalesce(m.c, b.c) AS c FROM b%(r)d b LEFT JOIN m%(r)d m ON m.part = b.part AND m.entry = b.entry)""" % {"r": r, "next": r + 1})
    steps.append(near % {"r": rounds})
    return ",".join(steps) + """,
digest AS (SELECT sha256(string_agg(list_aggregate(list_transform(c, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), 'string_agg', ','), ',' ORDER BY part, entry)) AS h FROM b%(r)d),
coded AS (SELECT vec_id, string_agg(lpad(lower(to_hex(entry)), 2, '0'), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a%(r)d GROUP BY vec_id)
SELECT c.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256
FROM coded c JOIN kept k ON k.vec_id = c.vec_id, digest""" % {"r": rounds}


@query("op12_vector_codes", _op12_sql())
def op12(spark: SparkSession, folder: str) -> DataFrame:
    codes, books = vector_codes.vector_codes(table(spark, folder, "embeddings").select("vec_id", "embedding", "label"))
    code = F.array_join(F.transform("code", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    return codes.select("vec_id", code.alias("code"), "error", "label_error", F.lit(vector_codes.codebooks_digest(books)).alias("codebooks_sha256"))


OP13_SQL = """
WITH RECURSIVE e AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
u AS (SELECT vec_id, label, v, sqrt(list_inner_product(v, v)) AS l FROM e),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_inner_product(a.v, b.v) / (a.l * b.l) >= 0.93),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id JOIN least ON least.a = vec_id
"""


@query("op13_embedding_duplicates", OP13_SQL)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_duplicates.embedding_duplicates(table(spark, folder, "embeddings").select("vec_id", "embedding", "label")).drop("label")
