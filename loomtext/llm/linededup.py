"""Cross-site boilerplate lines by distinct-site spread.

Lines are the pieces of a text between line feeds, compared after trimming ASCII white space and lower-casing, by a
128-bit hash. For each line hash HyperLogLog sketches of the sites (``source``) it stands on and of the different texts
that hold it are merged by partial and final aggregation; a hot line is two sketches of fixed size in every task. Lines
whose estimates are far above ``min_sites`` and ``min_texts`` are boilerplate, those far below either are not, and lines
near a threshold get exact distinct counts. Texts whose lines, as compared and in order, are equal count as one, so the
copies of a document alone do not make its lines boilerplate; ``classes`` can say so of near copies too. Boilerplate lines of at least ``min_chars`` characters
are removed from every text that has them; the other lines stay as they are, in order. The exchange that decides
carries hashes only. With ``spare_copies`` (off unless asked for) texts whose lines are those of another row too stay
whole, so that removing near duplicates afterwards still sees them.

Defined results: a null text stays null, with no lines; empty lines are never boilerplate; a null source counts as one
site; a line repeated on one site, in one or many documents, counts that site once; a text all of whose lines are
boilerplate is empty; documents are never dropped; a very long text costs time in proportion to its lines; extra columns
stay, n_lines and n_removed replace columns of their names; rows with equal doc_id are judged by their own text; an empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm.common import small_side, stored, table

#: Sites and different texts that a line must stand on.
MIN_SITES, MIN_TEXTS = 4, 4
MIN_CHARS = 1
#: log2 of the sketch's registers: a relative standard error of about 3 %.
LG_K = 10
#: Estimates within this share of the threshold are counted exactly: over six standard errors.
NEAR = 0.25


def key(line: Column) -> Column:
    """The line as compared: trimmed of ASCII white space, in lower case."""
    return F.lower(F.btrim(line, F.lit(" \t\n\x0b\f\r")))


def line_table(docs: DataFrame, min_chars: int = MIN_CHARS, classes: DataFrame | None = None) -> DataFrame:
    """(id, text_hash, pos, a, b, site, body) of each line that is long enough; lines by hash only, written once."""
    keys = F.transform(F.split("text", "\n"), key)
    # Hashes of whole texts are made below the explosion, once a text and not once a line.
    texts = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("text_hash"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("site"), F.xxhash64(keys).alias("body"), keys.alias("keys"))
    if classes is not None:
        c = small_side(classes.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "class"))
        texts = texts.join(c, texts["id"].eqNullSafe(c["_id"]) & (texts["text_hash"] == c["_hash"]), "left")
        texts = texts.select("id", "text_hash", "site", F.coalesce("class", "body").alias("body"), "keys")
    lines = texts.select("id", "text_hash", "site", "body", F.posexplode("keys").alias("pos", "line"))
    lines = lines.where(F.length("line") >= max(1, min_chars))
    return stored(lines.select("id", "text_hash", "pos", F.xxhash64("line").alias("a"), F.xxhash64(F.lit(7), "line").alias("b"), "site", "body"), "line-table")


def spread(lines: DataFrame, min_sites: int = MIN_SITES, min_texts: int = MIN_TEXTS) -> DataFrame:
    """(a, b) of the boilerplate lines."""
    least = {"site": min_sites, "body": min_texts}
    # One row for each line, site and text, so that repeats collapse before the exchange.
    pairs = stored(lines.select("a", "b", "site", "body").distinct(), "line-sites")
    # A line of one site or one text needs no sketch.
    several = pairs.groupBy("a", "b").agg(*(F.min(c).alias(f"{c}_min") for c in least), *(F.max(c).alias(f"{c}_max") for c in least))
    several = several.where(" AND ".join(f"{c}_min <> {c}_max" for c, n in least.items() if n > 1) or "TRUE").select("a", "b")
    sketches = pairs.join(several, ["a", "b"], "left_semi").groupBy("a", "b").agg(*(F.hll_sketch_agg(c, F.lit(LG_K)).alias(c) for c in least))
    est = stored(sketches.select("a", "b", *(F.hll_sketch_estimate(c).alias(c) for c in least)), "line-estimates")
    est = est.where(" AND ".join(f"{c} >= {n * (1 - NEAR)}" for c, n in least.items()))
    far = " AND ".join(f"{c} > {n * (1 + NEAR)}" for c, n in least.items())
    near = est.where(f"NOT ({far})").select("a", "b")
    exact = pairs.join(near, ["a", "b"]).groupBy("a", "b").agg(*(F.count_distinct(c).alias(c) for c in least))
    return est.where(far).select("a", "b").unionByName(exact.where(" AND ".join(f"{c} >= {n}" for c, n in least.items())).select("a", "b"))


def remove_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, min_texts: int = MIN_TEXTS, min_chars: int = MIN_CHARS, spare_copies: bool = False, classes: DataFrame | None = None) -> DataFrame:
    """``docs`` with ``text`` cut and n_lines, n_removed added; all rows and columns are kept, whatever their names, but the
    two replace columns of theirs.

    ``classes`` (doc_id, text_hash, class; stored, a row a text) names texts that count as one though their lines differ, such
    as near duplicates.
    """
    # The caller's columns travel as one, so that no name of theirs meets one of these.
    d = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("row"), "doc_id", "source", "text")
    lines = line_table(d, min_chars, classes)
    boiler = small_side(stored(spread(lines, min_sites, min_texts), "boilerplate"))
    cut = lines.join(boiler, ["a", "b"]).groupBy(F.col("id").alias("cut_id"), F.col("text_hash").alias("cut_hash")).agg(F.collect_set("pos").alias("cut"))
    # Lines travel through the join as an array, so that what stays is taken from it by place, in time linear in the lines.
    d = d.select("row", "doc_id", F.xxhash64("text").alias("text_hash"), F.split("text", "\n").alias("lines"))
    out = d.join(cut, d["doc_id"].eqNullSafe(cut["cut_id"]) & (d["text_hash"] == cut["cut_hash"]), "left").select("row", "lines", "cut")
    if spare_copies:
        body = F.xxhash64(F.transform("lines", key)).alias("body")
        whole = d.select(body, "lines").where("lines IS NOT NULL")
        copies = small_side(stored(whole.groupBy("body").count().where("count > 1").select(F.col("body").alias("copied")), "line-copies"))
        out = out.withColumn("body", body).join(copies, F.col("body") == F.col("copied"), "left").withColumn("cut", F.when(F.col("copied").isNull(), F.col("cut")))
    stays = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.coalesce("cut", F.array().cast("array<int>")))
    kept = F.array_join(F.transform(stays, lambda i: F.get("lines", i)), "\n")
    made = {"text": F.when(F.col("lines").isNotNull(), kept), "n_lines": F.greatest(F.size("lines"), F.lit(0)).cast("long"), "n_removed": F.coalesce(F.size("cut"), F.lit(0)).cast("long")}
    order = [*docs.columns, *(c for c in ("n_lines", "n_removed") if c not in docs.columns)]
    return out.select(*(made[c].alias(c) if c in made else F.col("row")[c].alias(c) for c in order))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("kept_chars"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP7_SQL = rf"""
WITH l AS (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, lower(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS key FROM l),
t AS (SELECT text, string_agg(key, chr(10) ORDER BY pos) AS body FROM (SELECT DISTINCT text, key, pos FROM k) GROUP BY text),
b AS (SELECT key FROM k JOIN t USING (text) WHERE length(key) >= {MIN_CHARS} GROUP BY key HAVING count(DISTINCT coalesce(source, '')) >= {MIN_SITES} AND count(DISTINCT body) >= {MIN_TEXTS}),
m AS (SELECT k.*, b.key IS NOT NULL AS boiler FROM k LEFT JOIN b ON k.key = b.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (boiler) AS n_removed,
  CAST(length(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT boiler), '')) AS BIGINT) AS kept_chars,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT boiler), '')) AS kept_sha256
FROM m GROUP BY doc_id, text
"""
QUERIES = {"op7_line_dedup": op7_line_dedup}
ORACLES = {"op7_line_dedup": OP7_SQL}
