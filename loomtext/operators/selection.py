"""Ordinals, shards, stratified cover and audit samples."""

from __future__ import annotations

import random
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.operators.constraints import positive
from loomtext.operators.draws import draws
from loomtext.operators.lexicon import DESCRIPTIONS
from loomtext.sources.scratch import materialized

#: Groups of a partition, over all partitions, that may be broadcast.
MOST_GROUPS = 100_000


def with_ordinal(df: DataFrame, *order: str, name: str = "source_idx", by: tuple[str, ...] = (), start: int = 0) -> DataFrame:
    """Consecutive numbers in the order of a unique key, globally or within ``by``.

    Rows are range-partitioned and sorted by group and key, and written with their place in the partition. A group's first
    place there, and what it has in the partitions before, make the place its number: one row for each partition and group. No
    single task sees all rows, nor all of a group.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = df.repartitionByRange(n, *by, *order).sortWithinPartitions(*by, *order).withColumn("_id", F.monotonically_increasing_id())
    # The identifier is the partition above 33 bits and the place below.
    parts = materialized(parts, "ordinal").withColumn("_p", F.shiftright("_id", 33))
    keys = [("_p", "_q"), *((c, f"_by{k}") for k, c in enumerate(by))]
    groups = parts.groupBy("_p", *by).agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    groups = groups.withColumn("_less", F.col("_first") - F.coalesce(before, F.lit(0)) - start)
    groups = materialized(groups.select(*(F.col(c).alias(a) for c, a in keys), "_less"), "ordinal-groups")
    few = F.broadcast(groups) if groups.count() <= MOST_GROUPS else groups
    out = parts.join(few, reduce(and_, (F.col(c).eqNullSafe(F.col(a)) for c, a in keys)))
    return out.withColumn(name, F.col("_id") - F.col("_less")).drop("_p", "_id", "_less", *(a for _, a in keys))


def shard_of(ordinal: Column, size: int) -> Column:
    """Shard number from 1 of an ordinal from 1."""
    return (F.floor((ordinal - 1) / size) + 1).cast("int")


def shard_key(stream: Column, ordinal: Column, size: int) -> Column:
    return F.format_string("%s-part-%04d", stream, shard_of(ordinal, size))


def custom_id(prefix: str, stream: Column, ordinal: Column) -> Column:
    return F.format_string(f"{prefix}-%s-%06d", stream, ordinal)


def combined(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union in the order of source_idx (missing last), then format."""
    return a.unionByName(b).orderBy(F.coalesce(F.col("source_idx"), F.lit(10**12)), "input_format")


def seeded(seed: int, *key: Column) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *(k.cast("string") for k in key)), 256)


def audit_quota(rows: DataFrame, size: int, first: str = "request") -> DataFrame:
    """(input_format, n, quota): a share for ``first`` rounded half to even, the rest for the other."""
    n = rows.agg(F.count("*").alias("total"), F.count_if(F.col("input_format") == first).alias("n_first"))
    target = F.least(F.lit(size), F.col("total"))
    share = F.coalesce(F.bround(F.try_divide(target * F.col("n_first"), F.col("total").cast("double"))), F.lit(0)).cast("long")
    other = "duty_role" if first == "request" else "request"
    one = lambda name, k, q: F.struct(F.lit(name).alias("input_format"), k.cast("long").alias("n"), q.cast("long").alias("quota"))
    return n.select(F.explode(F.array(one(first, F.col("n_first"), share), one(other, F.col("total") - F.col("n_first"), target - share))).alias("q")).select("q.*")


def audit_sample(rows: DataFrame, size: int, seed: int, key: str = "source_idx") -> DataFrame:
    """The quota of each format in a seeded hash order, then all in another; audit_id from 1. A bounded sample."""
    positive(size=size)
    quota = F.broadcast(audit_quota(rows, size).select(F.col("input_format").alias("_f"), "quota"))
    w = Window.partitionBy("input_format").orderBy(seeded(seed, F.col("input_format"), F.col(key)), key)
    # Only the first ``size`` rows of each format can be chosen: take them before ranking, by a top-k that sorts in parts.
    first = None
    for fmt in ("request", "duty_role"):
        top = rows.where(F.col("input_format") == fmt).orderBy(seeded(seed, F.col("input_format"), F.col(key)), key).limit(size)
        first = top if first is None else first.unionByName(top)
    chosen = first.withColumn("_r", F.row_number().over(w)).join(quota, F.col("input_format") == F.col("_f")).where("_r <= quota").drop("_r", "_f", "quota")
    return chosen.withColumn("audit_id", F.row_number().over(Window.orderBy(seeded(seed + 1, F.col(key)), key)))


def cover_candidates(rows: DataFrame, count: int, tie: Column, key: str = "scenario_id") -> DataFrame:
    """The best ``count`` rows of each distinct category set by (tie, key): all that a cover of ``count`` can choose from."""
    r = rows.select(key, "moral_categories", tie.alias("tie"))
    w = Window.partitionBy("moral_categories").orderBy("tie", key)
    return r.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= count).drop("_r")


def exact_ties(rows: DataFrame, seed: int, key: str = "scenario_id", order: str = "source_idx") -> DataFrame:
    """(key, tie): consecutive draws of one seeded generator in source order, drawn where the rows are."""
    numbered = with_ordinal(rows.select(key, order), order, name="_n")
    drawn = draws(rows.sparkSession, seed, numbered.count())
    return numbered.join(drawn, F.col("_n") == F.col("ordinal")).select(key, F.col("draw").alias("tie"))


def exact_audit_sample(rows: DataFrame, size: int, seed: int, key: str = "source_idx", formats: tuple[str, str] = ("request", "duty_role")) -> DataFrame:
    """The audit sample as one seeded generator draws it: the rows of each format in source order are shuffled in turn, the
    first ones by quota taken, and those shuffled again. Places are shuffled on the driver (a number a row, one format at a
    time), rows stay where they are; for small inputs."""
    positive(size=size)
    n = {f: 0 for f in formats} | {r[0]: r[1] for r in rows.where(F.col("input_format").isin(*formats)).groupBy("input_format").count().collect()}
    total = sum(n.values())
    target = min(size, total)
    first = round(target * n[formats[0]] / total) if total else 0
    rng = random.Random(seed)
    chosen: list[tuple[str, int]] = []
    for f, quota in zip(formats, (first, target - first), strict=True):
        places = list(range(n[f]))
        rng.shuffle(places)
        chosen += [(f, p) for p in places[:quota]]
    rng.shuffle(chosen)
    picked = rows.sparkSession.createDataFrame([(f, p, k) for k, (f, p) in enumerate(chosen, 1)], "_f string, _n long, audit_id int")
    out = None
    for f in formats:  # numbered without a task that sees all rows of a format
        own = with_ordinal(rows.where(F.col("input_format") == f), key, name="_at").join(F.broadcast(picked.where(F.col("_f") == f)), F.col("_at") == F.col("_n")).drop("_at", "_f", "_n")
        out = own if out is None else out.unionByName(own)
    return out


def seed_cover(rows: DataFrame, count: int, seed: int, mode: str = "hash", key: str = "scenario_id", domain=None) -> DataFrame:
    """(seed_no, key): a greedy cover of the categories, one row for each uncovered category in the domain's order, then
    by most uncovered, rarest, fewest categories, tie-break, id.

    Within one category set all but tie-break and id is equal, so the driver needs at most ``count`` rows of each of the
    (at most 2**10 - 1) sets. ``hash`` breaks ties by a seeded hash; ``exact`` by one generator in source order, for small inputs.
    """
    positive(count=count)
    # Three small results are drawn from these rows; what derives their categories runs once.
    rows = materialized(rows.select(key, "moral_categories", *(["source_idx"] if mode == "exact" else [])), "cover")
    if mode == "exact":
        keyed = rows.join(exact_ties(rows, seed, key), key)
        candidates = cover_candidates(keyed, count, F.col("tie"), key)
    else:
        candidates = cover_candidates(rows, count, F.xxhash64(F.lit(seed), F.col(key)).cast("double"), key)
    total, freq = rows.count(), {r[0]: r[1] for r in rows.select(F.explode("moral_categories").alias("c")).groupBy("c").count().collect()}
    if total < count:
        raise ValueError(f"{count} seeds are wanted, {total} rows have categories")
    pool = [(tuple(r["moral_categories"]), r["tie"], r[key]) for r in candidates.collect()]
    covered: set[str] = set()
    chosen: list = []

    def take(options):
        best = min(options, key=lambda o: (-sum(c not in covered for c in o[0]), -sum(1 / freq[c] for c in o[0]), len(o[0]), o[1], o[2]))
        pool.remove(best)
        covered.update(best[0])
        chosen.append(best[2])

    for category in domain or DESCRIPTIONS:
        options = [o for o in pool if category in o[0]]
        if category not in covered and options and len(chosen) < count:
            take(options)
    while len(chosen) < count and pool:
        take(pool)
    return rows.sparkSession.createDataFrame(list(enumerate(chosen, 1)), f"seed_no int, {key} {rows.schema[key].dataType.simpleString()}")
