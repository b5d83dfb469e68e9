"""Mixing sources to target weights, with DataFrame and SQL functions only.

1. Pack: every source's documents are laid end to end in a fixed order and cut into blocks of
   `block` words; the last block of a source may be short.
2. Targets: sources in code-point order (null last) weigh 5, 2, 1, repeating, and share
   `share` of all words; a target stops at `cap` times its source's size, and the excess is
   shared out anew by weight until none is above.
3. Draw: the mix has one slot per block it takes. A slot's place is a pseudorandom permutation of
   all slots, cut into output shards of equal size: every shard's counts of sources are
   then a multinomial draw conditioned on the totals (multivariate hypergeometric), so that
   each source meets its target, whatever its size.
4. Map: slot k of a source is in epoch k div n; in each epoch a keyed permutation of the
   block indices (swap-or-not, which is a bijection on any 0..n-1) says which block it gets. The
   short block comes last. The last slot of a source takes only the words still due.
5. Join slots with blocks by (source, index).

Running totals go by salted runs of a source, so a source with a third of all rows is many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbtrace.operators.bounded import broadcast_if_small, join_on
from plumbtrace.sources.scratch import materialise

#: Weights by position of the source.
WEIGHTS = (5, 2, 1)
BLOCK_WORDS = 64
SHARD_SLOTS = 4096
#: Documents of a source that one running total covers.
RUN_ROWS = 2048
#: Slots that one row of the slot generator stands for.
CHUNK = 4096
ROUNDS = 24


def word_count(text: Column) -> Column:
    """Number of maximal runs of characters other than the six ASCII blanks; null has none."""
    blanks = "\t\n\x0b\x0c\r"
    flat = F.translate(text, blanks, " " * len(blanks))
    # a word begins where a non-blank follows a blank: count blanks before and after runs are squeezed
    squeezed = F.trim(F.regexp_replace(flat, " {2,}", " "))
    return F.coalesce(
        F.when(F.length(squeezed) == 0, F.lit(0)).otherwise(F.length(squeezed) - F.length(F.replace(squeezed, F.lit(" "), F.lit(""))) + 1), F.lit(0)
    ).cast("long")


def _permuted(k: Column, n: Column, *key: Column) -> Column:
    """Swap-or-not: a keyed bijection of 0..n-1."""

    def round_(state: Column, i: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(i, *key), n) - state, n)
        swap = F.xxhash64(F.greatest(state, partner), i, *key).bitwiseAND(F.lit(1)) == 1
        return F.when(swap, partner).otherwise(state)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), k, round_)


def source_targets(sizes: DataFrame, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size) -> with s (position), weight and target.

    One row per source. Positions come from a range partitioning and per-partition counts,
    not from one task; each round of sharing is one aggregate.
    """
    ranged = sizes.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last())
    ranged = materialise(ranged.withColumn("part", F.spark_partition_id()), "mix_sources")
    by_part = Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition
    parts = ranged.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.col("s") % len(WEIGHTS) + 1).cast("int"))
    placed = (
        ranged.withColumn("k", F.row_number().over(by_part)).join(parts, "part")
        .withColumn("s", (F.col("first") + F.col("k") - 1).cast("long")).withColumn("weight", weight)
        .select("source", "source_size", "s", "weight")
    )
    total = float(share * (placed.agg(F.sum("source_size")).first()[0] or 0))
    most, level, left, weights = F.lit(cap) * F.col("source_size"), 0.0, total, None
    while True:
        # sources above the level are at their cap; the others share what is left by weight
        over = most <= F.lit(level) * F.col("weight")
        row = placed.agg(
            F.sum(F.when(over, most).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight")))
        ).first()
        capped, weights = row[0] or 0.0, row[1] or 0.0
        if not weights:
            break
        risen = (total - capped) / weights
        if risen <= level * (1 + 1e-12):
            break
        level = risen
    target = F.when(most <= F.lit(level) * F.col("weight"), most).otherwise(F.lit(level) * F.col("weight"))
    return placed.withColumn("target", F.least(target, most))


def mix(docs: DataFrame, seed: int = 7, block: int = BLOCK_WORDS, share: float = 1.5, cap: float = 2.0, shard_slots: int = SHARD_SLOTS) -> tuple[DataFrame, DataFrame]:
    """(documents, slots) of the mix of `docs` (doc_id, source, text).

    documents: doc_id, h (a hash of id and text), source, size, source_size, target, taken. Every row of the input is
    one row; null or blank texts have size 0 and are taken 0 times; null is a source of its own;
    repeated rows are documents of their own (equal ones are interchangeable); null ids are kept.
    slots: s (source position), shard, place (in the shard), index (block), words: the plan by which
    a writer fills output shards. Empty input gives empty results.
    """
    sized = docs.select(
        "doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("doc_id", "text").alias("h")
    )
    sized = materialise(sized, "mix_sizes")
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    targets = materialise(
        source_targets(sizes.select("source", "source_size"), share, cap).alias("t")
        .join(sizes.select(F.col("source").alias("s2"), "n_docs"), F.expr("source <=> s2")).drop("s2"), "mix_targets",
    )
    # runs of a source: by hash, about RUN_ROWS documents each
    tagged = join_on(sized, broadcast_if_small(targets), ["source"])
    tagged = tagged.withColumn("run", F.pmod(F.xxhash64("h", F.lit(seed)), F.ceil(F.col("n_docs") / RUN_ROWS)))
    order = ["h", F.col("doc_id"), "size"]
    inner = Window.partitionBy("s", "run").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    tagged = materialise(
        tagged.withColumn("within", F.coalesce(F.sum("size").over(inner), F.lit(0)))
        .select("doc_id", "h", "source", "size", "source_size", "target", "s", "run", "within"), "mix_runs",
    )
    runs = tagged.groupBy("s", "run").agg(F.sum("size").alias("words"))
    outer = Window.partitionBy("s").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("s", "run", F.coalesce(F.sum("words").over(outer), F.lit(0)).alias("run_start"))
    placed = tagged.join(runs, ["s", "run"]).withColumn("start", F.col("run_start") + F.col("within"))

    slots = _slots(targets, seed, block, shard_slots)
    # a source has one slot at most that takes only the head of its block
    takes = slots.groupBy("s", "index").agg(
        F.sum(F.col("whole").cast("long")).alias("whole"), F.sum(F.when(~F.col("whole"), F.col("words")).otherwise(0)).alias("head")
    )
    parts = placed.where("size > 0").select(
        "s", "start", "size",
        F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))).alias("index"),
    )
    at = F.greatest(F.col("start") - F.col("index") * block, F.lit(0))
    to = F.least(F.col("start") + F.col("size") - F.col("index") * block, F.lit(block))
    taken = (
        # sizes of generated rows can't be estimated: without the hint Spark might broadcast all blocks
        parts.hint("merge").join(takes.hint("merge"), ["s", "index"])
        .withColumn("words", F.col("whole") * (to - at) + F.greatest(F.least(to, F.col("head")) - at, F.lit(0)))
        .groupBy("s", "start", "size").agg(F.sum("words").alias("taken"))
    )
    keyed = placed.select("doc_id", "h", "source", "size", "source_size", "target", "s", "start")
    documents = keyed.hint("merge").join(taken.hint("merge"), ["s", "start", "size"], "left").select(
        "doc_id", "h", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")
    )
    return documents, slots


def _slots(targets: DataFrame, seed: int, block: int, shard_slots: int) -> DataFrame:
    """The plan: one row per slot."""
    size, due = F.col("source_size"), F.col("due")
    t = targets.where("source_size > 0").withColumn("due", F.round("target").cast("long"))
    t = t.withColumn("n_full", F.floor(size / block)).withColumn("n", F.ceil(size / block)).withColumn("epochs", F.floor(due / size))
    t = t.withColumn("rest", due - F.col("epochs") * size)
    t = t.withColumn("n_part", F.least(F.floor(F.col("rest") / block), F.col("n_full")))
    t = t.withColumn("head", F.col("rest") - F.col("n_part") * block).withColumn("n_whole", F.col("epochs") * F.col("n") + F.col("n_part"))
    t = t.withColumn("n_slots", F.col("n_whole") + (F.col("head") > 0).cast("long")).withColumn("group", F.floor(F.col("s") / CHUNK))
    # offsets in two levels: inside groups of positions, and over the groups
    before = (Window.unboundedPreceding, -1)
    groups = t.groupBy("group").agg(F.sum("n_slots").alias("in_group")).select(
        "group", F.coalesce(F.sum("in_group").over(Window.orderBy("group").rowsBetween(*before)), F.lit(0)).alias("group_start")
    )
    total = t.agg(F.sum("n_slots")).first()[0] or 0
    all_slots = F.lit(total).cast("long")
    t = t.join(F.broadcast(groups), "group").withColumn(
        "first", F.col("group_start") + F.coalesce(F.sum("n_slots").over(Window.partitionBy("group").orderBy("s").rowsBetween(*before)), F.lit(0))
    )
    chunks = t.where("n_slots > 0").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_slots") - 1) / CHUNK))))
    # a chunk is few bytes but much work, so the number of tasks is given
    chunks = chunks.repartition(max(targets.sparkSession.sparkContext.defaultParallelism * 2, -(-total // (16 * CHUNK))), "s", "chunk")
    k, n, n_full = F.col("k"), F.col("n"), F.col("n_full")
    slots = chunks.withColumn("k", F.explode(F.sequence(F.col("chunk") * CHUNK, F.least((F.col("chunk") + 1) * CHUNK, F.col("n_slots")) - 1)))
    slots = slots.withColumn("j", F.pmod(k, n)).withColumn("epoch", F.floor(k / n)).withColumn("whole", k < F.col("n_whole"))
    slots = slots.withColumn("index", F.when(F.col("j") >= n_full, n_full).otherwise(_permuted(F.col("j"), n_full, F.lit(seed), F.col("s"), F.col("epoch"))))
    place = _permuted(F.col("first") + k, all_slots, F.lit(seed + 1))
    return slots.select(
        "s", "source", F.floor(place / shard_slots).alias("shard"), F.pmod(place, F.lit(shard_slots)).alias("place"), "index", "whole",
        F.when(F.col("whole"), F.least(F.lit(block), size - F.col("index") * block)).otherwise(F.col("head")).cast("long").alias("words"),
    )


def mixed_documents(docs: DataFrame, seed: int = 7, **options) -> DataFrame:
    """The rows of `docs` as often as the mix takes them, with their own columns.

    A document that the mix takes x times its size (0 to 2) comes floor(x) times, and once more
    with probability x - floor(x), by a hash of its id and text; equal rows share alike. Rows
    without words have nothing to take and stay once. `docs` needs doc_id, source and text.
    """
    documents, _ = mix(docs, seed=seed, **options)
    shares = documents.groupBy("doc_id", "h").agg((F.sum("taken") / F.greatest(F.sum("size"), F.lit(1))).alias("share"), F.max("size").alias("size"))
    luck = F.pmod(F.xxhash64("doc_id", "h", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    times = shares.select(
        F.col("doc_id"), "h", F.when(F.col("size") == 0, 1).otherwise(F.floor(F.col("share") + luck)).cast("int").alias("times")
    )
    rows = docs.select(F.col("doc_id"), F.xxhash64("doc_id", "text").alias("h"), F.struct(*docs.columns).alias("row"))
    return join_on(rows, times.where("times > 0"), ["doc_id", "h"]).select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")
