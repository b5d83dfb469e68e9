"""Samples and splits decided by hashed row keys."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbtrace.functions.binding import let
from plumbtrace.functions.hashing import hash_order, hash_u32, hash_uniform
from .bounded import attach_one, broadcast_if_small, join_on
from .ordered import hash_row_numbers, row_numbers, top_k

BITS = 16
SPLITS = (("train", 0.6), ("val", 0.2), ("test", 0.2))


def hash_split(df: DataFrame, keys: list, seed, parts=SPLITS, out: str = "split") -> DataFrame:
    """Row-local split by a hash of the keys: no shuffle, shares hold in expectation.

    Passing the columns of a session as keys keeps a session on one side.
    """
    u = hash_uniform(seed, *keys)
    return df.withColumn(out, _by_threshold(u, parts))


def _by_threshold(u: Column, parts) -> Column:
    cumulative, out = 0.0, None
    for name, share in parts[:-1]:
        cumulative = round(cumulative + share, 12)
        out = F.when(u < cumulative, name) if out is None else out.when(u < cumulative, name)
    return F.lit(parts[-1][0]) if out is None else out.otherwise(parts[-1][0])


def session_key(columns: list[str]) -> Column:
    """Endpoint columns joined by dashes, gaps written as 0."""
    return F.concat_ws("-", *[F.coalesce(F.col(c).cast("string"), F.lit("0")) for c in columns])


def group_split(df: DataFrame, session: list[str], seed, parts=SPLITS, out: str = "split") -> DataFrame:
    """A session goes wholly to one part."""
    return hash_split(df, [session_key(session)], seed, parts, out)


def segment_by_hash(df: DataFrame, groups: list[str], key: list[str], seed, cuts: Column, names: list[str],
                    out: str = "split") -> DataFrame:
    """Exact segments of each group in hash order.

    `cuts` is an array of row counts per group, computed from column `_total`; the
    first cuts[0] rows get names[0], up to cuts[1] names[1], and so on. Only rows
    whose hash prefix holds a cut are ranked; all others are decided by counts of
    prefixes, so even a group with most of the table stays spread out.
    """
    hashed = df.withColumn("_h", hash_u32(seed, *key)).withColumn("_b", F.shiftright("_h", 32 - BITS).cast("int"))
    histogram = hashed.groupBy(*groups, "_b").agg(F.count("*").alias("_n"))
    by_group = Window.partitionBy(*[F.col(g) for g in groups])
    running = histogram.select(
        *groups, "_b", "_n",
        F.coalesce(F.sum("_n").over(by_group.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_n").over(by_group).alias("_total"),
    ).withColumn("_cuts", cuts)
    # per group and cut: its row number, the first prefix that reaches past it, and the rows before that prefix
    n = len(names) - 1
    edge = lambda i: F.min(F.when(F.col("_before") + F.col("_n") > F.col("_cuts")[i], F.struct("_b", "_before")))
    edges = running.groupBy(*groups).agg(
        *[F.max(F.col("_cuts")[i]).alias(f"_cut{i}") for i in range(n)], *[edge(i).alias(f"_edge{i}") for i in range(n)])
    flat = edges.select(*groups, *[c for i in range(n) for c in (
        F.col(f"_cut{i}"), F.col(f"_edge{i}._b").alias(f"_at{i}"), F.col(f"_edge{i}._before").alias(f"_pre{i}"))])
    tagged = join_on(hashed, broadcast_if_small(flat), groups)
    contested_by = lambda i: F.coalesce((F.col("_b") == F.col(f"_at{i}")) & (F.col(f"_pre{i}") < F.col(f"_cut{i}")), F.lit(False))
    past = lambda i: F.coalesce((F.col("_b") > F.col(f"_at{i}")) | ((F.col("_b") == F.col(f"_at{i}")) & (F.col(f"_pre{i}") >= F.col(f"_cut{i}"))), F.lit(False))
    split_here, segment, before, behind = F.lit(False), F.lit(0), F.lit(None).cast("long"), F.lit(0)
    for i in range(n):
        split_here = split_here | contested_by(i)
        segment = segment + past(i).cast("int")
        before = F.coalesce(before, F.when(contested_by(i), F.col(f"_pre{i}")))
        behind = behind + (F.col(f"_cut{i}") < F.col("_pos")).cast("int")
    name = lambda i: F.element_at(F.array(*[F.lit(v) for v in names]), i + 1)
    settled = tagged.filter(~split_here).withColumn(out, name(segment))
    inside = Window.partitionBy(*groups, "_b").orderBy("_h", *key)
    ranked = tagged.filter(split_here).withColumn("_pos", F.row_number().over(inside) + before)
    contested = ranked.withColumn(out, name(behind)).drop("_pos")
    helpers = ["_h", "_b", *[f"{c}{i}" for i in range(n) for c in ("_cut", "_at", "_pre")]]
    return settled.unionByName(contested).drop(*helpers)


def stratified_split(df: DataFrame, label: str, key: list[str], seed, parts=SPLITS, out: str = "split") -> DataFrame:
    """Exact shares per label (rounded down, the rest goes to the last part)."""
    cumulative, cuts = 0.0, []
    for _, share in parts[:-1]:
        cumulative = round(cumulative + share, 12)
        cuts.append(F.floor(F.lit(cumulative) * F.col("_total") + 1e-9).cast("long"))
    return segment_by_hash(df, [label], key, seed, F.array(*cuts), [n for n, _ in parts], out)


def sample_per_group(df: DataFrame, groups: list[str], key: list[str], seed, quota: int | Column) -> DataFrame:
    """Exactly the first `quota` rows of each group in hash order (all, if it has fewer)."""
    q = F.lit(quota) if isinstance(quota, int) else quota
    taken = segment_by_hash(df, groups, key, seed, F.array(q.cast("long")), ["in", "out"], "_side")
    return taken.filter("_side = 'in'").drop("_side")


def stratified_sample(df: DataFrame, label: str, key: list[str], seed, size: int) -> DataFrame:
    """`size` rows in proportion to the labels; one pool if there are too few rows or one label."""
    shape = df.groupBy(label).agg(F.count("*").alias("n")).agg(
        F.count("*").alias("classes"), F.sum("n").alias("total")).first()
    total, classes = shape["total"] or 0, shape["classes"]
    if total <= size:
        return df
    if classes <= 1 or size < classes:
        return sample(df, key, seed, size)
    quota = F.round(F.col("_total") * F.lit(size) / F.lit(total)).cast("long")
    return sample_per_group(df, [label], key, seed, quota)


def sample(df: DataFrame, key: list[str], seed, size: int) -> DataFrame:
    """First `size` rows of the whole table in hash order."""
    pooled = df.withColumn("_pool", F.lit(0))
    return sample_per_group(pooled, ["_pool"], key, seed, size).drop("_pool")


# Background rows by training rows.
BACKGROUND_LADDER = ((1000, 100), (10000, 500))
BACKGROUND_MAX = 1000


def background_size(rows: int) -> int:
    for limit, size in BACKGROUND_LADDER:
        if rows <= limit:
            return min(size, rows)
    return min(BACKGROUND_MAX, rows)


def background_sample(df: DataFrame, key: list[str], seed) -> DataFrame:
    return sample(df, key, seed, background_size(df.count()))


def ordered_cut(df: DataFrame, order: str, tie: list[str], share: float = 0.8, out: str = "split") -> DataFrame:
    """First share of the rows in an explicit order is train, the rest test."""
    numbered = row_numbers(df, order, tie, "_rn")
    limit = int(share * df.count())
    return numbered.withColumn(out, F.when(F.col("_rn") <= limit, "train").otherwise("test")).drop("_rn")


def shuffled(df: DataFrame, key: list[str], seed, out: str = "position") -> DataFrame:
    """Seeded shuffle as an explicit position column."""
    hashed = df.withColumn("_h", hash_u32(seed, *key))
    return hash_row_numbers(hashed, "_h", key, out).drop("_h")


def balanced_cases(df: DataFrame, correct: str, key: list[str], seed, each: int = 3) -> DataFrame:
    """The same number of right and of wrong predictions."""
    return sample_per_group(df, [correct], key, seed, each)


def quotas_can_be_filled(df: DataFrame, query: str, engine: str, cell: str, quotas: dict[tuple[str, str], int]) -> bool:
    """Whether some choice fills every (cell, engine) quota with each query used once.

    A matching exists exactly if, in each cell, every set of engines together has as many queries as its quotas ask for.
    Queries are counted by the set of engines that they have, so a few counts per cell decide.
    """
    engines = sorted({e for _, e in quotas})
    sets = df.where(F.col(engine).isin(engines)).groupBy(cell, query).agg(F.array_sort(F.collect_set(engine)).alias("_e"))
    counts = sets.groupBy(cell, "_e").agg(F.count("*").alias("n")).collect()
    for c in {c for c, _ in quotas}:
        wanted = {e: q for (own, e), q in quotas.items() if own == c}
        for size in range(1, len(wanted) + 1):
            for some in combinations(sorted(wanted), size):
                if sum(r["n"] for r in counts if r[cell] == c and set(some) & set(r["_e"])) < sum(wanted[e] for e in some):
                    return False
    return True


def quota_sample(df: DataFrame, query: str, engine: str, cell: str, level: str, quotas: dict[tuple[str, str], int],
                 levels: list[int], minimum: int, seeds: int = 1000) -> DataFrame:
    """Fill each (cell, engine) quota, use a query once, and cover every level.

    For each seed the engines of a cell draw one after another, in an order that the seed hashes, each from all
    queries not drawn so far, in hash order. The smallest seed whose draw fills all quotas and has `minimum`
    rows of each level wins. Seeds are tried in growing batches. Raises ValueError where no draw can fill the quotas,
    and another where none of the seeds did. A query has one cell, and one row for each engine.
    """
    needed = F.create_map(*[x for (c, e), q in quotas.items() for x in (F.lit(f"{c}|{e}"), F.lit(q))])
    most = max(sum(q for (own, _), q in quotas.items() if own == c) for c, _ in quotas)
    rows = df.select(query, engine, cell, level).withColumn("_quota", needed[F.concat_ws("|", cell, engine)])
    rows = rows.filter("_quota IS NOT NULL")
    if not quotas_can_be_filled(rows, query, engine, cell, quotas):
        raise ValueError("no choice of distinct queries fills all quotas")
    engines, first, batch = max(len([1 for own, _ in quotas if own == c]) for c, _ in quotas), 0, 16
    while first < seeds:
        last = min(seeds, first + batch) - 1
        picked = _quota_draws(rows, query, engine, cell, level, most, engines, first, last)
        checks = [F.count_if(F.col(level) == v) >= minimum for v in levels]
        ok = F.count("*") == sum(quotas.values())
        for c in checks:
            ok = ok & c
        seed = picked.groupBy("seed").agg(ok.alias("ok")).filter("ok").agg(F.min("seed").alias("seed")).first()["seed"]
        if seed is not None:
            return _quota_draws(rows, query, engine, cell, level, most, engines, seed, seed)
        first, batch = last + 1, batch * 4
    raise ValueError(f"none of {seeds} seeds fills all quotas with {minimum} rows of each level, though the quotas can be filled")


def _quota_draws(rows: DataFrame, query: str, engine: str, cell: str, level: str, most: int, engines: int, first: int, last: int) -> DataFrame:
    """(seed, query, engine, cell, level) of the draws of seeds first..last."""
    offered = rows.withColumn("seed", F.explode(F.sequence(F.lit(first), F.lit(last))))
    offered = offered.withColumn("_h", hash_u32("pick", F.col("seed"), F.col(query), F.col(engine)))
    # others can take no more queries from an engine than the cell draws in all
    near = top_k(offered, ["seed", cell, engine], [F.col("_h"), F.col(query)], most, "_r")
    offers = near.groupBy("seed", cell, engine).agg(F.first("_quota").alias("_quota"), F.array_sort(F.collect_list(F.struct("_r", F.col(query).alias("q"), F.col(level).alias("l")))).alias("_o"))
    turn = F.struct(hash_u32("turn", F.col("seed"), F.col(cell), F.col(engine)).alias("t"), F.col(engine).alias("e"), F.col("_quota").alias("n"), F.col("_o").alias("o"))
    turns = offers.groupBy("seed", cell).agg(F.array_sort(F.collect_list(turn)).alias("_t"))
    item = f"struct<e: {rows.schema[engine].dataType.simpleString()}, q: {rows.schema[query].dataType.simpleString()}, l: {rows.schema[level].dataType.simpleString()}>"
    drawn = F.array().cast(f"array<{item}>")

    def after_turn(k: int):
        turn = F.col("_t")[k]
        told = lambda o: F.struct(turn["e"].alias("e"), o["q"].alias("q"), o["l"].alias("l"))

        def add(used: Column) -> Column:
            free = F.filter(turn["o"], lambda o: ~F.exists(used, lambda u: u["q"] == o["q"]))
            return F.when(F.size("_t") > k, F.concat(used, F.transform(F.slice(free, F.lit(1), turn["n"]), told))).otherwise(used)

        return add

    for k in range(engines):
        drawn = let(drawn, after_turn(k))
    return turns.select("seed", cell, F.inline(drawn)).select("seed", F.col("q").alias(query), F.col("e").alias(engine), cell, F.col("l").alias(level))


def blinded(df: DataFrame, key: list[str], seed, prefix: str = "A", width: int = 2, out: str = "id") -> DataFrame:
    """Shuffle and number rows A01, A02, ..."""
    numbered = shuffled(df, key, seed, "_n")
    digits = F.greatest(F.length(F.col("_n").cast("string")), F.lit(width))
    padded = F.lpad(F.col("_n").cast("string"), digits, F.lit("0"))
    return numbered.withColumn(out, F.concat(F.lit(prefix), padded)).drop("_n")


def random_negatives(queries: DataFrame, candidates: DataFrame, pooled: DataFrame, query: str, item: str,
                     seed, n: int = 2) -> DataFrame:
    """n items per query that are not pooled yet, fewer only when fewer are left.

    Items sit on a ring in hash order. Each query takes the n + (its pooled count)
    items that follow its own point on the ring: at most the pooled ones among
    them drop out, so n remain. Work grows with queries, not queries x items.
    """
    ring = shuffled(candidates.select(item).distinct(), [item], seed, "_slot")
    size = ring.agg(F.count("*").alias("_size"))
    counts = pooled.groupBy(query).agg(F.count_distinct(item).alias("_pooled"))
    start = attach_one(queries.select(query).distinct().join(counts, query, "left"), size).filter("_size > 0")
    reach = F.least(F.coalesce("_pooled", F.lit(0)) + n, F.col("_size"))
    slots = start.select(
        query, "_size", hash_u32(f"{seed}-start", F.col(query)).alias("_from"),
        F.explode(F.sequence(F.lit(0).cast("long"), reach.cast("long") - 1)).alias("_step"),
    ).withColumn("_slot", (F.col("_from") + F.col("_step")) % F.col("_size") + 1)
    drawn = slots.join(ring, "_slot").join(pooled.select(query, item).distinct(), [query, item], "left_anti")
    return top_k(drawn, [query], [F.col("_step")], n, "_r").select(query, item)
