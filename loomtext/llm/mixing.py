"""Mixing sources to target weights by capped water-filling.

Each source asks for its weight's share of the wanted words. Targets that exceed ``max_epochs`` times the source are
clamped there and their excess is shared again by weight among the others, until none is above: every target is
least(cap, level * weight) for one water level, found from sources sorted by cap / weight with running sums over the
source table only (one row a source). Sources with a weight of zero or no words get nothing; where all are clamped,
the rest of the wanted words stays untaken.

A target of r times its source takes every document floor(r) times; the fraction takes some documents once more. Those
are the first ones in a seeded hash order: documents are dealt to 4,096 slots of an md5 digest, running sums over a source's slots
(bounded, whatever the input) find the slot where the wanted words are reached, and that slot counts whole or not,
whichever is nearer. So taken words come within half a slot of the target, nothing is sorted globally, and reruns
agree. Copies of one doc_id stand in one slot and are taken alike.

Defined results: null or empty texts have size 0; null sources are a source of their own, sorted last; a null doc_id
is hashed as ''; repeated rows count each; a text of any length is one document; an empty table gives no rows; the
caller's columns stay, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomtext.llm.common import small_side, stored, table

SEED = "mix-1"
SLOTS = 4096
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def slot(doc_id: Column, seed: str = SEED) -> Column:
    """0..4095 from the first 3 hex digits of md5(seed:doc_id)."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 3), 16, 10).cast("int")


def cyclic_weights(sources: DataFrame, cycle: tuple[int, ...] = (3, 1, 2)) -> DataFrame:
    """Adds ``weight``: the cycle's numbers in turn over sources by code point, null last. One row a source."""
    k = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(cycle)
    return sources.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in cycle)), (k + 1).cast("int")))


def water_fill(sources: DataFrame, share: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """Adds ``target`` to rows (source, source_size, weight)."""
    everything = Window.partitionBy()
    s = sources.withColumn("_cap", F.when(F.col("weight") > 0, F.col("source_size") * F.lit(max_epochs)).otherwise(0.0)).withColumn("_w", F.greatest("weight", F.lit(0.0)))
    s = s.withColumn("_ratio", F.when((F.col("_w") > 0) & (F.col("_cap") > 0), F.col("_cap") / F.col("_w")).otherwise(0.0))
    before = Window.orderBy("_ratio", F.col("source").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("_want", F.lit(share) * F.sum("source_size").over(everything))
    # The first level that its source does not reach is the water's; levels computed further on lie lower.
    # The level if this source and all of a larger ratio were free: clamped ones before it are at their caps.
    free = F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))
    level = (F.col("_want") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.when(free > 0, free)
    s = s.withColumn("_level", level)
    s = s.withColumn("_water", F.max(F.when((F.col("_level") <= F.col("_ratio")) & (F.col("_ratio") > 0), F.col("_level"))).over(everything))
    target = F.when(F.col("_water").isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("_water") * F.col("_w")))
    return s.withColumn("target", target.cast("double")).drop("_cap", "_w", "_ratio", "_want", "_level", "_water")


def plan_mix(sized: DataFrame, weights=cyclic_weights, share: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """From rows (source, slot, size): rows (source, source_size, target, whole, last_slot), one a source.

    A document is taken whole + (slot <= last_slot) times.
    """
    slots = sized.groupBy("source", "slot").agg(F.sum("size").alias("words"))
    by_slot = Window.partitionBy("source").orderBy("slot")
    slots = slots.withColumn("upto", F.sum("words").over(by_slot))
    totals = water_fill(weights(slots.groupBy("source").agg(F.sum("words").alias("source_size"))), share, max_epochs)
    totals = totals.withColumn("_r", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    # A ratio that rounding keeps just below a whole number counts as that number.
    totals = totals.withColumn("whole", F.floor(F.col("_r") + 1e-9).cast("long"))
    totals = totals.withColumn("_rest", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size")))
    t = totals.select(F.col("source").alias("_s"), "source_size", "target", "whole", "_rest")
    both = slots.join(t, slots["source"].eqNullSafe(t["_s"]))
    # A slot is taken if that comes nearer to the rest than leaving it: half of it lies below.
    last = F.max(F.when(F.col("upto") - F.col("words") / 2.0 <= F.col("_rest") - 1e-6, F.col("slot")))
    return both.groupBy("_s", "source_size", "target", "whole").agg(F.coalesce(last, F.lit(-1)).alias("last_slot")).withColumnRenamed("_s", "source")


def mix(docs: DataFrame, weights=cyclic_weights, share: float = 1.5, max_epochs: float = 2.0, seed: str = SEED) -> DataFrame:
    """``docs`` with size, source_size, target, copies and taken (size * copies); no row is dropped and all columns are kept,
    whatever their names, but the five replace columns of theirs."""
    # The caller's columns travel as one, so that no name of theirs meets one of these.
    d = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "source", n_words(F.col("text")).alias("size"), slot(F.col("doc_id"), seed).alias("slot"))
    plan = plan_mix(d.select("source", "slot", "size"), weights, share, max_epochs)
    plan = small_side(stored(plan.withColumnRenamed("source", "of"), "mix-plan"))
    out = d.join(plan, d["source"].eqNullSafe(plan["of"]))
    copies = (F.col("whole") + F.when(F.col("slot") <= F.col("last_slot"), 1).otherwise(0)).cast("long")
    made = {"size": F.col("size"), "source_size": F.col("source_size"), "target": F.col("target"), "copies": copies, "taken": (F.col("size") * copies).cast("long")}
    order = [*docs.columns, *(c for c in made if c not in docs.columns)]
    return out.select(*(made[c].alias(c) if c in made else F.col("row")[c].alias(c) for c in order))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


OP6_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
  CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 3) AS INTEGER) AS slot FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT)]::DOUBLE AS weight, 2.0 * source_size AS cap FROM s),
k AS (SELECT a.source, a.cap / a.weight AS ratio,
  (1.5 * (SELECT sum(source_size) FROM w) - coalesce(sum(b.cap) FILTER (b.cap / b.weight < a.cap / a.weight), 0)) / sum(b.weight) FILTER (b.cap / b.weight >= a.cap / a.weight) AS level
  FROM w a, w b WHERE a.cap > 0 GROUP BY a.source, a.cap, a.weight),
l AS (SELECT max(level) AS water FROM k WHERE level <= ratio),
t AS (SELECT source, source_size, CASE WHEN water IS NULL THEN cap ELSE least(cap, water * weight) END::DOUBLE AS target FROM w, l),
r AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size + 1e-9) AS BIGINT) ELSE 0 END AS whole FROM t),
q AS (SELECT source, slot, words, sum(words) OVER (PARTITION BY source ORDER BY slot) AS upto FROM (SELECT source, slot, sum(size) AS words FROM d GROUP BY source, slot)),
c AS (SELECT r.source, max(CASE WHEN upto - words / 2.0 <= greatest(0.0, target - whole * source_size) - 1e-6 THEN slot END) AS last_slot FROM q JOIN r ON q.source IS NOT DISTINCT FROM r.source GROUP BY r.source)
SELECT d.doc_id, d.size, r.source_size, r.target, CAST(d.size * (r.whole + CASE WHEN d.slot <= coalesce(c.last_slot, -1) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source JOIN c ON c.source IS NOT DISTINCT FROM r.source
"""
QUERIES = {"op6_mixing": op6_mixing}
ORACLES = {"op6_mixing": OP6_SQL}
