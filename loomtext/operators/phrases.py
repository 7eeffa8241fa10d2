"""A lexicon of phrases given as a table, matched through an index of first words.

A text is cut once into runs of word characters and what lies between; a phrase is a list of such pieces. Only places whose
word is the first of some phrase are looked at, and there the text's pieces are compared with the phrases of that word. So a
place is a match exactly where no word character stands on either side, and the work does not grow with the lexicon.

Matches of one category do not overlap: from left to right, and of phrases that begin at one place the one of lower rank.

A lexicon within ``MOST_PHRASES`` and ``MOST_CHARS`` (both are counted) is a literal index and matching is a projection; a
larger one is joined by first word, and matches meet by row and category.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The largest lexicon that is a literal of the plan.
MOST_PHRASES, MOST_CHARS = 20_000, 1 << 20
#: The largest lexicon that is sent to all executors; the words of texts are exchanged only for a larger one.
MOST_SENT, MOST_SENT_CHARS = 500_000, 16 << 20
PIECES = r"(?U)\w+|\W+"
#: Characters outside ASCII that count as ASCII letters where case does not matter: fixed values.
ALIKE = ("ſKİı", "skii")


def fold(c: Column) -> Column:
    return F.lower(F.translate(c, *ALIKE))


def pieces(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PIECES), F.lit(0))


def expand(term: str) -> list[str]:
    """The phrases of a finite pattern in the order in which a regular expression would try them: groups of alternatives,
    single characters in brackets, and either of them or one character with a question mark."""
    out, at = [""], 0
    while at < len(term):
        if term.startswith("(?:", at):
            depth, end = 1, at + 3
            while depth:
                depth += {"(": 1, ")": -1}.get(term[end], 0)
                end += 1
            inner, parts, level = term[at + 3 : end - 1], [""], 0
            for ch in inner:
                level += {"(": 1, ")": -1}.get(ch, 0)
                if ch == "|" and level == 0:
                    parts.append("")
                else:
                    parts[-1] += ch
            options = [x for p in parts for x in expand(p)]
        elif term[at] == "[":
            end = term.index("]", at) + 1
            options = list(term[at + 1 : end - 1])
        else:
            options, end = [term[at]], at + 1
            if re.match(r"[\\.*+{}()|^$]", term[at]):
                raise ValueError(f"{term!r} is no finite pattern")
        if end < len(term) and term[end] == "?":
            options, end = [*options, ""], end + 1
        out, at = [a + b for a in out for b in options], end
    return out


def table_of(spark: SparkSession, terms: dict[str, list[str]]) -> DataFrame:
    """(category, phrase, rank) of terms by category; a term may be a finite pattern."""
    rows = [(c, p, k) for c, ts in terms.items() for k, p in enumerate(x for t in ts for x in expand(t))]
    return spark.createDataFrame(rows, "category string, phrase string, rank int")


def _entries(lexicon: DataFrame) -> DataFrame:
    """(first, category, rank, pieces); phrases that do not begin and end with a word character cannot match and are left out."""
    p = pieces(fold(F.col("phrase")))
    d = lexicon.select("category", "rank", F.explode(F.array(p)).alias("pieces")).where(F.size("pieces") > 0)
    word = lambda c: c.rlike(r"(?U)^\w")
    return d.withColumn("first", F.element_at("pieces", 1)).where(word(F.col("first")) & word(F.element_at("pieces", -1)))


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _literal(lexicon: DataFrame) -> tuple[list[str], str] | None:
    """(first words, SQL of a map from them to their phrases) of a lexicon within the bounds, else None."""
    n, size = lexicon.agg(F.count("*"), F.coalesce(F.sum(F.length("phrase") + F.length("category")), F.lit(0))).first()
    if n > MOST_PHRASES or size > MOST_CHARS:
        return None
    by: dict[str, list[str]] = {}
    for r in _entries(lexicon).collect():
        entry = f"named_struct('category', {_quoted(r['category'])}, 'rank', {r['rank']}, 'pieces', array({', '.join(map(_quoted, r['pieces']))}))"
        by.setdefault(r["first"], []).append(entry)
    if not by:
        return [], "map()"
    return list(by), "map(" + ", ".join(f"{_quoted(w)}, array({', '.join(es)})" for w, es in sorted(by.items())) + ")"


def _apart(ordered: Column) -> Column:
    """Of structs (category, at, rank, end) in that order those that do not overlap an earlier one of their category."""
    kept = "array<struct<category:string,at:int,end:int>>"
    start = F.struct(F.lit("").alias("category"), F.lit(0).alias("end"), F.array().cast(kept).alias("out"))

    def step(s: Column, x: Column) -> Column:
        new = (s["category"] != x["category"]) | (x["at"] >= s["end"])
        one = F.array(F.struct(x["category"].alias("category"), x["at"].alias("at"), x["end"].alias("end")))
        return F.struct(F.when(new, x["category"]).otherwise(s["category"]).alias("category"), F.when(new, x["end"]).otherwise(s["end"]).alias("end"), F.when(new, F.concat(s["out"], one)).otherwise(s["out"]).alias("out"))

    return F.aggregate(ordered, start, step, lambda s: s["out"])


def _once(df: DataFrame, name: str, c: Column) -> DataFrame:
    """``df`` with a column that is computed once a row, however often it is used: the optimiser does not look through an
    explosion."""
    return df.withColumn(name, F.explode(F.array(c)))


def matched(rows: DataFrame, text: Column, lexicon: DataFrame, key: str | None = None) -> DataFrame:
    """``rows`` with ``_pieces`` and ``_matches``: array<struct<category, at, end>>, places counted in pieces. A lexicon
    beyond the bounds needs a ``key`` that tells rows apart."""
    found = _literal(lexicon)
    d = _once(rows, "_pieces", pieces(text))
    if found is None:
        if key is None:
            raise ValueError("a lexicon of this size is joined, for which rows need a key")
        hits = _by_join(d, key, lexicon).withColumnRenamed(key, "_key")
        out = d.join(hits, d[key] == F.col("_key"), "left").drop("_key")
        return out.withColumn("_matches", F.coalesce("_matches", F.array().cast("array<struct<category:string,at:int,end:int>>")))
    words, index = found
    d = _once(d, "_folded", F.transform("_pieces", fold))
    places = F.filter(F.transform("_folded", lambda w, i: F.struct(i.alias("at"), w.alias("word"))), lambda x: x["word"].isin(*words) if words else F.lit(False))
    d = _once(d, "_places", places)

    def here(x: Column) -> Column:
        own = F.filter(F.element_at(F.expr(index), x["word"]), lambda e: F.slice("_folded", x["at"] + 1, F.size(e["pieces"])) == e["pieces"])
        return F.transform(own, lambda e: F.struct(e["category"].alias("category"), x["at"].alias("at"), e["rank"].alias("rank"), (x["at"] + F.size(e["pieces"])).alias("end")))

    if not words:
        return d.withColumn("_matches", F.array().cast("array<struct<category:string,at:int,end:int>>")).drop("_folded", "_places")
    d = _once(d, "_found", F.array_sort(F.flatten(F.transform("_places", here))))
    return _once(d, "_matches", _apart(F.col("_found"))).drop("_folded", "_places", "_found")


def _by_join(d: DataFrame, key: str, lexicon: DataFrame) -> DataFrame:
    """(key, _matches) of rows that have any, by a join on first words."""
    entries = _entries(lexicon)
    longest = entries.agg(F.max(F.size("pieces"))).first()[0] or 1
    n, size = lexicon.agg(F.count("*"), F.sum(F.length("phrase") + F.length("category"))).first()
    if n <= MOST_SENT and size <= MOST_SENT_CHARS:
        entries = F.broadcast(entries)
    w = _once(d.select(key, "_pieces"), "_folded", F.transform("_pieces", fold))
    tails = F.transform("_folded", lambda w, i: F.struct(i.alias("at"), w.alias("first"), F.slice("_folded", i + 1, longest).alias("tail")))
    w = w.select(F.col(key), F.explode(F.filter(tails, lambda x: x["first"].rlike(r"(?U)^\w"))).alias("x")).select(key, "x.*")
    hits = w.join(entries, "first").where(F.slice("tail", F.lit(1), F.size("pieces")) == F.col("pieces"))
    hits = hits.select(key, F.struct("category", "at", "rank", (F.col("at") + F.size("pieces")).alias("end")).alias("m"))
    # A group is the matches of one row, as many as its text has places at most.
    return hits.groupBy(key).agg(_apart(F.array_sort(F.collect_list("m"))).alias("_matches"))


def words_by_category(d: DataFrame, name: str) -> DataFrame:
    """``matched`` rows with ``name``: map<category, sorted distinct lower-case matches>."""
    word = lambda m: F.lower(F.array_join(F.slice("_pieces", m["at"] + 1, m["end"] - m["at"]), ""))
    categories = F.array_sort(F.array_distinct(F.transform("_matches", lambda m: m["category"])))
    one = lambda c: F.struct(c.alias("key"), F.array_sort(F.array_distinct(F.transform(F.filter("_matches", lambda m: m["category"] == c), word))).alias("value"))
    return _once(d, name, F.map_from_entries(F.transform(categories, one))).drop("_pieces", "_matches")


def counts_by_category(d: DataFrame) -> DataFrame:
    """(category, documents, matches) of ``matched`` rows: one scan, a partial sum for each category."""
    each = d.select(F.explode(F.array_distinct(F.transform("_matches", lambda x: x["category"]))).alias("category"), "_matches")
    each = each.select("category", F.size(F.filter("_matches", lambda x: x["category"] == F.col("category"))).alias("k"))
    return each.groupBy("category").agg(F.count("*").alias("documents"), F.sum("k").cast("long").alias("matches"))
