"""Corpus pipeline: five stages, each written as Parquet and read again as the next one's documents.

Toxic documents go; cross-site boilerplate lines go from the texts (n_chars follows); of each component of near
duplicates (five words, similarity 0.8) the document with the smallest doc_id stays; documents that hold a benchmark
window go; the rest is mixed to target weights, one row for each repetition of a document (``copy``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm.common import small_side, stored, table
from loomtext.llm.decontam import decontaminate
from loomtext.llm.jaccard import near_duplicates
from loomtext.llm.linededup import remove_boilerplate
from loomtext.llm.mixing import mix
from loomtext.llm.toxicity import score_texts, train, training_sample


#: The columns that operators look at; all others pass through them under names that nothing else has.
NEEDED = ("doc_id", "text", "source")


def apart(docs: DataFrame) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """(``docs`` with plain names for columns that operators need not see, what gives a result its own names again).

    Columns given besides replace those of their names.
    """
    own = {c: c if c in NEEDED else f"__own_{i}" for i, c in enumerate(docs.columns)}

    def back(df: DataFrame, *more: str) -> DataFrame:
        return df.select(*(F.col(x).alias(c) for c, x in own.items() if c not in more), *more)

    return docs.select(*(F.col(f"`{c}`").alias(x) for c, x in own.items())), back


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with predicted = 0 stay, each row judged by its text; null and empty texts score as clean; without a toxic
    and a clean training text all stay. Repeated rows are judged alike; an empty table stays empty."""
    model = train(training_sample(docs, table(spark, sf_dir, "labels")))
    d, back = apart(docs)
    return back(score_texts(d, model, keep=d.columns).where("predicted = 0"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on four sites and in four texts go from every text; near duplicates (as in the next stage) count as one text, so
    that a document's copies do not make its own lines boilerplate and are still found as copies. Null texts stay null, an
    empty table stays empty."""
    d, back = apart(docs)
    found = stored(near_duplicates(d, k=5, num=80, den=100, by_row=True).where("component IS NOT NULL"), "pipeline-classes")
    # Only classes of several different texts say more than the texts themselves.
    several = found.groupBy("component").agg(F.min("text_hash").alias("a"), F.max("text_hash").alias("b")).where("a <> b").select("component")
    classes = stored(found.join(several, "component", "left_semi").select("doc_id", "text_hash", F.col("component").alias("class")).distinct(), "pipeline-several")
    out = back(remove_boilerplate(d, classes=classes))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row whose doc_id names its component stays, by doc_id and text; rows without doc_id stay, a doc_id on several
    rows of one component (one text, if that is empty) stays once."""
    d, back = apart(docs)
    group = F.coalesce(F.concat(F.lit("c"), "component"), F.concat(F.lit("t"), "text_hash"))
    found = stored(near_duplicates(d, k=5, num=80, den=100, by_row=True).withColumn("__group", group), "pipeline-near")
    d = d.withColumn("__text", F.xxhash64("text"))
    losers = found.where("doc_id <> component_id").select(F.col("doc_id").alias("__loser"), F.col("text_hash").alias("__lost")).distinct()
    kept = d.join(small_side(stored(losers, "pipeline-losers")), (F.col("doc_id") == F.col("__loser")) & (F.col("__text") == F.col("__lost")), "left_anti")
    repeated = found.where("doc_id = component_id").groupBy("doc_id", "__group").agg(F.count("*").alias("__rows"), F.collect_set("text_hash").alias("__texts")).where("__rows > 1")
    if repeated.isEmpty():
        return back(kept)
    repeated = stored(repeated.select(F.col("doc_id").alias("__twice"), "__group", F.explode("__texts").alias("__one")), "pipeline-repeated")
    same = (F.col("doc_id") == F.col("__twice")) & (F.col("__text") == F.col("__one"))
    once = kept.join(repeated, same).dropDuplicates(["doc_id", "__group"])
    return back(kept.join(repeated, same, "left_anti")).unionByName(back(once))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without any benchmark window stay; null and wordless texts have none, an empty benchmark drops nothing."""
    d, back = apart(docs)
    return back(decontaminate(d, table(spark, sf_dir, "benchmark"), keep=d.columns).where("NOT contaminated"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each repetition, numbered by ``copy``; null sources are a source, rows with equal doc_id are taken alike."""
    d, back = apart(docs)
    out = mix(d).where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return back(out, "size", "source_size", "target", "copy")


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("ngram_jaccard_join", jaccard), ("benchmark_decontamination", decontamination), ("mixing", mixing)]

#: The first stage is a trained model, so SQL cannot express the whole.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
