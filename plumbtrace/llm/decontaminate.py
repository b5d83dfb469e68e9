"""Benchmark decontamination by a prefix-filtered join with exact verification.

Every benchmark item is cut into windows of `window` consecutive words (a shorter item is
one window). A window can only occur where all of its words occur, so the join needs one
prefix token per window: its rarest word, by the number of times that word occurs in all
documents. A document position of that word is a candidate; the word's place inside the
window fixes where the window would start (positional bound), the rest of the document must
hold the window (length bound), and the words are then compared one by one.

The benchmark is the query set. It is read in blocks of bounded bytes, each broadcast to one
pass over the documents; passes are chained on the rows themselves, so nothing is shuffled
but the word counts, and hot documents, words or sources change nothing.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F


WINDOW = 13
#: Bytes of benchmark text that one pass over the documents carries.
BLOCK_BYTES = 32 << 20

#: ASCII other than letters and digits separates words; A-Z is lower-cased.
_SEPARATORS = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256)
)

RESULT = "n_words long, n_hit long, item_ids array<string>, spans array<array<long>>"


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_SEPARATORS).split() if text else []


def windows_of(items: list[tuple[str, str | None]], window: int) -> dict[tuple[bytes, ...], set[str]]:
    """Word window -> ids of the items that hold it."""
    found: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
    for item, text in items:
        words = words_of(text)
        for k in range(max(1, len(words) - window + 1) if words else 0):
            found[tuple(words[k:k + window])].add(item)
    return dict(found)


def prefix_index(windows: dict, counts: dict[bytes, int]) -> dict[bytes, list]:
    """Rarest word of each window -> [(place of the word, window, items)]."""
    index: dict[bytes, list] = defaultdict(list)
    for window, items in windows.items():
        rank, place = min((counts.get(w, 0), k) for k, w in enumerate(window))
        if rank:  # a window with a word that no document holds can't occur
            index[window[place]].append((place, window, tuple(sorted(items))))
    return dict(index)


def match(words: list[bytes], index: dict[bytes, list]) -> tuple[list[list[int]], set[str]]:
    """Spans of words covered by windows (merged, in order) and the items found."""
    spans, items = [], set()
    get = index.get
    for at, hits in enumerate(map(get, words)):
        if hits:
            for place, window, ids in hits:
                start = at - place
                if start >= 0 and start + len(window) <= len(words) and tuple(words[start:start + len(window)]) == window:
                    spans.append([start, start + len(window)])
                    items.update(ids)
    return merge(spans), items


def merge(spans: list) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(map(list, spans)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _item_blocks(items: DataFrame, block_bytes: int) -> Iterator[list[tuple[str, str | None]]]:
    """The benchmark in blocks that hold about `block_bytes` of text, by a hash of the id."""
    items = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text")).where("item_id is not null").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // block_bytes) or 1
    for k in range(blocks):
        yield [tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()]


def _word_counts(texts: DataFrame, vocabulary: set[bytes]) -> dict[bytes, int]:
    """How often each word of the block occurs in all documents; at most one row per word reaches the driver."""
    shared = texts.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted, seen = shared.value, Counter()
        for batch in batches:
            for text in batch["text"]:
                seen.update(filter(wanted.__contains__, words_of(text)))
        yield pd.DataFrame({"word": pd.Series(list(seen), dtype=object), "n": list(seen.values())})

    rows = texts.mapInPandas(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {bytes(r.word): r.n for r in rows}


def find_benchmark(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """All rows and columns of `docs` with a struct column `overlap`: n_words, n_hit, item_ids, spans.

    `n_hit` counts words inside an occurrence of a window, `spans` are word ranges (end exclusive),
    `item_ids` the items as strings, sorted. Null and empty texts have no words and no hits; null or
    wordless items match nothing; an item without an id can't be named and is left out; repeated items
    and documents count as they stand. Empty tables give empty results or no hits. Other columns are
    passed on untouched, except that a column named `overlap` is replaced.
    """
    spark = docs.sparkSession
    out = docs.withColumn("overlap", F.lit(None).cast(f"struct<{_as_struct(RESULT)}>"))
    texts = docs.select(F.col(text).alias("text"))
    for items in _item_blocks(benchmark, block_bytes):
        windows = windows_of(items, window)
        counts = _word_counts(texts, {w for x in windows for w in x}) if windows else {}
        shared = spark.sparkContext.broadcast(prefix_index(windows, counts))
        out = out.withColumn("overlap", _matcher(shared)(F.col(text), F.col("overlap")))
    return out


def _as_struct(ddl: str) -> str:
    return ", ".join(x.replace(" ", ": ", 1) for x in ddl.split(", "))


def _matcher(shared):
    @F.pandas_udf(RESULT)
    def overlap(batches: Iterator[tuple[pd.Series, pd.DataFrame]]) -> Iterator[pd.DataFrame]:
        index = shared.value
        for texts, before in batches:
            rows = []
            for text, old_ids, old_spans in zip(texts, before["item_ids"], before["spans"]):
                words = words_of(text)
                spans, items = match(words, index)
                if old_ids is not None:
                    spans, items = merge([*spans, *old_spans]), items | set(old_ids)
                rows.append((len(words), sum(b - a for a, b in spans), sorted(items), spans))
            yield pd.DataFrame(rows, columns=["n_words", "n_hit", "item_ids", "spans"])

    return overlap


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Contaminated: at least one hit, and a twentieth or more of the words are hit.
    """
    o = F.col("overlap")
    return find_benchmark(docs.select("doc_id", "text"), benchmark, **options).select(
        "doc_id", o.n_words.alias("n_words"), o.n_hit.alias("n_hit"), F.size(o.item_ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(o.item_ids, ","), 256).alias("items_sha256"),
        ((o.n_hit > 0) & (20 * o.n_hit >= o.n_words)).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of `docs` that aren't contaminated, with their own columns."""
    o = F.col("overlap")
    # a name of the input's own must survive
    kept = find_benchmark(docs.select(F.struct(*docs.columns).alias("row"), F.col("text").alias("text")), benchmark, **options)
    return kept.where(~((o.n_hit > 0) & (20 * o.n_hit >= o.n_words))).select("row.*")
