"""Multi-label keyword categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.operators.phrases import matched, table_of, words_by_category

#: Categories with their descriptions, and the terms of each: fixed values.
DESCRIPTIONS = {
    "life_and_lethal_harm": "Questions involving death, killing, preservation of life, or lethal force.",
    "pain_and_suffering": "Questions involving physical or emotional pain, suffering, injury, or abuse.",
    "ability_and_impairment": "Questions involving disability, bodily or mental impairment, or loss of capacity.",
    "freedom_and_coercion": "Questions involving autonomy, consent, coercion, confinement, force, or restricted choice.",
    "pleasure_and_welfare": "Questions involving welfare, well-being, happiness, pleasure, or deprivation of benefit.",
    "truth_and_deception": "Questions involving honesty, deception, secrecy, disclosure, or misleading others.",
    "fairness_and_cheating": "Questions involving fairness, cheating, theft, fraud, favoritism, or exploitation.",
    "promises_and_commitments": "Questions involving promises, agreements, vows, contracts, or commitments.",
    "law_and_legality": "Questions involving laws, crimes, legal institutions, punishment, or lawful authority.",
    "role_duty_and_obligation": "Questions involving duties, responsibilities, professional roles, orders, or obligations.",
}
TERMS = {
    "life_and_lethal_harm": [
        r"kill(?:s|ed|ing)?", r"murder(?:s|ed|ing)?", r"death", r"dead", r"die", r"dies", r"dying", r"life", r"lives", r"lethal", r"fatal", r"suicid(?:e|al)", r"execut(?:e|es|ed|ion)",
        r"assassinat(?:e|es|ed|ion)", r"shoot(?:s|ing)?", r"shot", r"stab(?:s|bed|bing)?", r"grenade", r"weapon of mass destruction", r"end (?:his|her|their|a|the) life", r"preserv(?:e|es|ed|ing) life",
    ],
    "pain_and_suffering": [
        r"pain", r"painful", r"suffer(?:s|ed|ing)?", r"agony", r"tortur(?:e|es|ed|ing)", r"injur(?:y|ies|ed)", r"wound(?:s|ed)?", r"harm(?:s|ed|ful|ing)?", r"abuse(?:r|d)?", r"assault(?:s|ed|ing)?",
        r"rape(?:s|d)?", r"attack(?:s|ed|ing)?", r"beat(?:s|en|ing)?", r"fight(?:s|ing)?", r"distress(?:ed)?", r"trauma(?:tic)?", r"violence", r"violent",
    ],
    "ability_and_impairment": [
        r"disabl(?:e|ed|ing|ity)", r"impair(?:s|ed|ment|ing)?", r"incapacitat(?:e|ed|ion)", r"amputat(?:e|ed|ion)", r"paraly(?:ze|zed|sis)", r"unconscious", r"organ transplant(?:ation)?s?",
        r"replacement organ", r"bodily capacity", r"mental capacity", r"loss of ability",
    ],
    "freedom_and_coercion": [
        r"freedom", r"liberty", r"autonomy", r"consent(?:s|ed|ing)?", r"without consent", r"coerc(?:e|es|ed|ion|ive)", r"forc(?:e|es|ed|ing)", r"kidnap(?:s|ped|ping)?", r"hostage",
        r"imprison(?:s|ed|ment|ing)?", r"confin(?:e|ed|ement|ing)", r"restrict(?:s|ed|ion|ing)?", r"threaten(?:s|ed|ing)?", r"demand(?:s|ed|ing)?",
    ],
    "pleasure_and_welfare": [
        r"pleasure", r"happiness", r"well[- ]being", r"welfare", r"quality of life", r"depriv(?:e|es|ed|ing) (?:of )?(?:pleasure|benefit)", r"compassion", r"mercy", r"reliev(?:e|es|ed|ing) suffering",
    ],
    "truth_and_deception": [
        r"lie", r"lies", r"lied", r"lying", r"deceiv(?:e|es|ed|ing)", r"deception", r"dishonest(?:y)?", r"honest(?:y)?", r"truth(?:ful)?", r"mislead(?:s|ing)?", r"secret(?:s)?",
        r"conceal(?:s|ed|ing|ment)?", r"disclos(?:e|es|ed|ing|ure)", r"confess(?:es|ed|ing|ion)?", r"withhold(?:s|ing)? information", r"do not tell", r"cover up",
    ],
    "fairness_and_cheating": [
        r"cheat(?:s|ed|ing)?", r"fair(?:ness|ly)?", r"unfair(?:ly|ness)?", r"steal(?:s|ing)?", r"stole", r"stolen", r"theft", r"fraud(?:ulent)?", r"plagiari(?:ze|zed|sm)",
        r"exploit(?:s|ed|ation|ing)?", r"favoritism", r"discriminat(?:e|es|ed|ion|ing)", r"equal(?:ity|ly)?", r"affair", r"infidelity", r"unfaithful", r"sexual(?:ly)? unfaithful", r"credit card",
        r"take credit", r"undeserved advantage",
    ],
    "promises_and_commitments": [
        r"promis(?:e|es|ed|ing)", r"commitment(?:s)?", r"committed to", r"pledge(?:s|d)?", r"vow(?:s|ed)?", r"agreement(?:s)?", r"contract(?:s|ed)?", r"gave (?:his|her|their|my|your) word",
        r"keep (?:his|her|their|my|your) word",
    ],
    "law_and_legality": [
        r"law", r"laws", r"legal(?:ly|ity)?", r"illegal(?:ly|ity)?", r"unlawful(?:ly)?", r"crime(?:s)?", r"criminal(?:s)?", r"police", r"jury", r"juror(?:s)?", r"court", r"judge", r"verdict",
        r"guilty", r"innocent", r"arrest(?:s|ed|ing)?", r"prison(?:er|ers)?", r"punish(?:es|ed|ment|ing)?", r"constitution(?:al)?", r"government", r"regulation(?:s)?", r"authorities", r"death penalty",
    ],
    "role_duty_and_obligation": [
        r"duty", r"duties", r"obligation(?:s)?", r"responsib(?:le|ility|ilities)", r"ordered", r"order(?:s|ed) you", r"command(?:s|ed|ing)?", r"professional", r"soldier", r"police officer",
        r"police offer", r"doctor", r"nurse", r"surgeon", r"specialist", r"teacher", r"attorney", r"lawyer", r"judge", r"juror", r"jury", r"editor", r"ceo", r"manager", r"parent", r"guardian",
        r"counselor", r"officer", r"employee", r"employer", r"scientist", r"paramedic", r"ambulance driver", r"military commander", r"undercover agent",
        r"part of (?:a|an|the) (?:group|team|mission)", r"on duty",
    ],
}


def pattern(terms: list[str]) -> str:
    """Any of the terms with no word character on either side, whatever the case."""
    return rf"(?iU)(?<!\w)(?:{'|'.join(terms)})(?!\w)"


def keyword_matches(text: Column, lexicon: dict[str, list[str]] | None = None) -> Column:
    """map<category, sorted distinct lower-case matches> of the categories that match, by one pattern a category: for single
    expressions and terms that are no finite patterns. ``categorized`` goes through ``phrases``, with the same result."""
    entries = []
    for name, terms in (lexicon or TERMS).items():
        found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern(terms)), F.lit(0)), F.lower)
        entries.append(F.struct(F.lit(name).alias("key"), F.array_sort(F.array_distinct(found)).alias("value")))
    return F.map_filter(F.map_from_entries(F.array(*entries)), lambda _, v: F.size(v) > 0)


def routing_text(mode: str, context: Column, *actions: Column) -> Column:
    if mode not in ("context", "context_actions"):
        raise ValueError(f"unknown routing text mode {mode!r}")
    return context if mode == "context" else F.concat_ws(" ", context, *actions)


def categorized(rows: DataFrame, mode: str = "context", lexicon: dict[str, list[str]] | DataFrame | None = None, overrides: DataFrame | None = None) -> DataFrame:
    """``rows`` (scenario_id, context, actions) with matched_keywords, inferred and final categories and review flags.

    ``lexicon`` is a table (category, phrase, rank) or terms by category. ``overrides`` (scenario_id, moral_categories)
    replace what was inferred.
    """
    text = routing_text(mode, F.col("context"), *(F.col(c) for c in ("action1", "action2") if c in rows.columns))
    phrases = lexicon if isinstance(lexicon, DataFrame) else table_of(rows.sparkSession, lexicon or TERMS)
    out = words_by_category(matched(rows, text, phrases, key="scenario_id"), "matched_keywords")
    out = out.withColumn("inferred_categories", F.array_sort(F.map_keys("matched_keywords")))
    if overrides is None:
        out = out.withColumn("_o", F.lit(None).cast("array<string>"))
    else:
        o = overrides.select(F.col("scenario_id").alias("_id"), F.array_sort(F.array_distinct("moral_categories")).alias("_o"))
        out = out.join(o, F.col("scenario_id") == F.col("_id"), "left").drop("_id")
    out = out.withColumn("human_override_applied", F.col("_o").isNotNull()).withColumn("moral_categories", F.coalesce("_o", "inferred_categories")).drop("_o")
    out = out.withColumn("category_source", F.when(F.col("human_override_applied"), F.lit("human_override")).otherwise(F.lit("keyword_router")))
    return out.withColumn("needs_human_review", F.size("moral_categories") == 0)


def category_counts(rows: DataFrame, domain: list[str] | None = None) -> DataFrame:
    """(category, n) for the whole domain, zero where none has it."""
    spark = rows.sparkSession
    names = spark.createDataFrame([(c,) for c in (domain or list(DESCRIPTIONS))], "category string")
    n = rows.select(F.explode("moral_categories").alias("category")).groupBy("category").agg(F.count("*").alias("n"))
    return names.join(n, "category", "left").select("category", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def with_rarity(rows: DataFrame) -> DataFrame:
    """``rarity``: the sum of 1 / frequency over a row's categories. Frequencies are one row: the domain is fixed."""
    n = rows.select(F.explode("moral_categories").alias("c")).groupBy("c").agg(F.count("*").alias("n"))
    freq = n.agg(F.map_from_entries(F.collect_list(F.struct("c", "n"))).alias("_f"))
    total = F.aggregate("moral_categories", F.lit(0.0), lambda s, c: s + 1.0 / F.element_at("_f", c))
    return rows.join(F.broadcast(freq), F.lit(True)).withColumn("rarity", total).drop("_f")


def descriptions(categories: Column) -> Column:
    known = F.create_map(*(F.lit(x) for kv in DESCRIPTIONS.items() for x in kv))
    return F.map_from_arrays(categories, F.transform(categories, lambda c: F.element_at(known, c)))
