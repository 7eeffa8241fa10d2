"""Named queries over the driver's tables and the SQL that checks them, written apart from the Spark plans."""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.functions import parsing as P
from loomtext.functions import prompts as M
from loomtext.functions import text as X
from loomtext.operators import constraints as C
from loomtext.operators import joins as J
from loomtext.operators import lexicon as L
from loomtext.operators import metrics as A
from loomtext.operators import normalize as N
from loomtext.operators import phrases as H
from loomtext.operators import rawrows as K
from loomtext.operators import routing as R
from loomtext.operators import scoring as S
from loomtext.operators import selection as O
from loomtext.operators import validators as V
from loomtext.plans import jobs, stages
from loomtext.sources import readers, writers
from loomtext.sources.scratch import fresh_path, materialized, widened
from loomtext.streaming.resume import run_pending, stream_scores
from loomtext.plans.relations import CASES, DILEMMAS, PREDICTIONS, RAW_OUTPUTS, SKILLS, derived

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


def table(spark, sf, name) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def clean_sql(c: str) -> str:
    return f"trim(regexp_replace(coalesce({c}, ''), '\\s+', ' ', 'g'))"


# ---- routing

_PREFIX_RE = "^(" + "|".join(p.replace("'", "''") for p in R.REQUEST_PREFIXES) + ")"
_SIGNALS = rf"""
c AS ({CASES}), k AS (SELECT source_idx, label, {clean_sql('scenario')} AS s, {clean_sql('excuse')} AS e FROM c),
g AS (SELECT *, regexp_matches(e, '(?i)^(no|but)\b') AS rr, regexp_matches(e, '(?i)^(so i should|i should|so i ought to|therefore i should)\b') AS dr,
  ends_with(s, '?') OR regexp_matches(lower(s), '{_PREFIX_RE}') AS rs, regexp_matches(s, '(?i)^(i am|i''m|i work|i serve|as (an?|the)|my (job|role|position|profession))\b') AS ds FROM k),
r AS (SELECT *, CASE WHEN dr THEN CASE WHEN rs AND NOT ds THEN 1 ELSE 2 END WHEN rr THEN CASE WHEN ds AND NOT rs THEN 3 ELSE 4 END
  WHEN rs AND NOT ds THEN 5 WHEN ds AND NOT rs THEN 6 WHEN rs AND ds THEN 7 ELSE 8 END AS o FROM g),
f AS (SELECT *, 'H' || lpad(CAST(source_idx AS VARCHAR), greatest(6, length(CAST((SELECT count(*) - 1 FROM c) AS VARCHAR)))::INT, '0') AS target_id,
  ['ambiguous', 'duty_role', 'request', 'request', 'request', 'duty_role', 'ambiguous', 'ambiguous'][o] AS input_format,
  ['duty_role_response_conflicts_with_request_scenario', 'explicit_so_i_should_response', 'explicit_no_or_but_response_with_declarative_scenario', 'explicit_no_or_but_response', 'request_shaped_scenario',
   'duty_or_role_shaped_scenario', 'scenario_has_both_request_and_duty_role_signals', 'no_supported_textual_routing_rule'][o] AS reason,
  ['duty_response_conflicts_with_request_scenario', 'explicit_duty_response', 'explicit_no_or_but_response', 'explicit_no_or_but_response', 'request_shaped_scenario', 'duty_or_role_shaped_scenario',
   'no_unique_supported_route', 'no_unique_supported_route'][o] AS reason2 FROM r)
"""


def routed(spark, sf, router=R.route) -> DataFrame:
    cases = derived(spark, sf, CASES)
    return R.routed(cases, router).withColumn("target_id", X.padded_id("H", F.col("source_idx"), table(spark, sf, "orders").count()))


def views(spark, sf) -> dict[str, DataFrame]:
    """All views of one routed table: signals are matched once, whatever is read of it."""
    return R.split_views(materialized(routed(spark, sf), "routed"))


@query("route_counts", f"WITH {_SIGNALS} SELECT t.input_format, l.label, CAST(count(f.source_idx) AS BIGINT) AS n FROM (VALUES ('request'), ('duty_role'), ('ambiguous')) t(input_format) CROSS JOIN (SELECT DISTINCT label FROM f) l LEFT JOIN f ON f.input_format = t.input_format AND f.label = l.label GROUP BY 1, 2")
def route_counts(spark, sf):
    return A.domain_counts(routed(spark, sf), "input_format", (*R.FORMATS, "ambiguous"), "label")


@query("route_rows", f"WITH {_SIGNALS} SELECT source_idx, s AS scenario, e AS excuse, input_format, reason AS routing_reason FROM f")
def route_rows(spark, sf):
    return routed(spark, sf).select("source_idx", "scenario", "excuse", "input_format", "routing_reason")


@query("route_v2_rows", f"WITH {_SIGNALS} SELECT source_idx, input_format, reason2 AS routing_reason FROM f")
def route_v2_rows(spark, sf):
    return routed(spark, sf, R.route_folded).select("source_idx", "input_format", "routing_reason")


@query("split_public", f"WITH {_SIGNALS} SELECT target_id, source_idx, input_format, s AS scenario, e AS excuse FROM f WHERE input_format <> 'ambiguous'")
def split_public(spark, sf):
    v = views(spark, sf)
    return v["request"].unionByName(v["duty_role"])


@query("split_private", f"WITH {_SIGNALS} SELECT target_id, source_idx, input_format, label AS gold_verdict FROM f")
def split_private(spark, sf):
    return views(spark, sf)["private"]


@query("split_audit", f"WITH {_SIGNALS} SELECT target_id, source_idx, input_format, s AS scenario, e AS excuse, reason AS routing_reason FROM f")
def split_audit(spark, sf):
    return views(spark, sf)["audit"]


@query("ambiguous_rows", f"WITH {_SIGNALS} SELECT target_id, source_idx, input_format, s AS scenario, e AS excuse, reason AS routing_reason FROM f WHERE input_format = 'ambiguous'")
def ambiguous_rows(spark, sf):
    return views(spark, sf)["ambiguous"]


# ---- text


@query("dup_stats", "WITH g AS (SELECT text, count(*) n FROM documents GROUP BY text), e AS (SELECT text, source, count(*) n FROM documents GROUP BY text, source) SELECT (SELECT count(*) FROM g) AS distinct_groups, (SELECT CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) FROM g) AS rows_in_shared_groups, (SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM e) AS exact_duplicates")
def dup_stats(spark, sf):
    return A.duplicate_stats(table(spark, sf, "documents"), "text", "text", "source")


_WS = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]+"


@query("normalized_texts", rf"SELECT doc_id, sha256(trim(regexp_replace(coalesce(text, ''), '{_WS}', ' ', 'g'))) AS collapsed_sha256, sha256(regexp_replace(coalesce(text, ''), '^{_WS}|{_WS}$', '', 'g')) AS stripped_sha256, CASE WHEN trim(regexp_replace(coalesce(text, ''), '{_WS}', ' ', 'g')) = '' THEN 0 ELSE len(string_split(trim(regexp_replace(coalesce(text, ''), '{_WS}', ' ', 'g')), ' ')) END::INTEGER AS n_words, len(regexp_extract_all(coalesce(text, ''), '[.!?](?:[\"'')\]]+)?(?:[\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}]|$)'))::INTEGER AS n_sentences FROM documents")
def normalized_texts(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", X.sha256(X.collapse(t)).alias("collapsed_sha256"), X.sha256(X.strip_ends(t)).alias("stripped_sha256"), X.count_words(t).alias("n_words"), X.count_sentences(t).alias("n_sentences"))


@query("group_hash", f"WITH c AS ({CASES}) SELECT source_idx, substr(sha256(lower({clean_sql('scenario')})), 1, 16) AS scenario_group_id FROM c")
def group_hash(spark, sf):
    return derived(spark, sf, CASES).select("source_idx", X.group_id(F.col("scenario")).alias("scenario_group_id"))


@query("clean_skills", f"""WITH k AS ({SKILLS}), e(m, skill) AS (VALUES (0, 'Assess whether the stated reason is a genuine obstacle that releases the person from the request.'), (1, 'Assess the duty.'), (2, 'Weigh the role'), (3, ''), (4, 'Assess if the role, its ordinary scope and its core obligations make the proposed responsibility a fitting one here.'), (5, '"'))
SELECT source_idx, skill, starts_with(skill, 'Assess') AS starts_with_assess, CASE WHEN skill = '' THEN 0 ELSE len(string_split(skill, ' ')) END::INTEGER AS word_count, CASE WHEN skill = '' THEN 0 ELSE len(string_split(skill, ' ')) END BETWEEN 12 AND 40 AS word_count_in_range FROM k JOIN e ON m = source_idx % 6""")
def clean_skills(spark, sf):
    d = derived(spark, sf, SKILLS).withColumn("skill", X.clean_skill(F.col("raw"))).withColumn("c", X.skill_checks(F.col("skill")))
    return d.select("source_idx", "skill", "c.starts_with_assess", "c.word_count", "c.word_count_in_range")


@query("strip_artifacts", f"WITH k AS ({SKILLS}), e(m, v) AS (VALUES (0, 'It rained. So the trip was off.'), (1, 'open end'), (2, 'One. Two! Three? Four. Five \"quoted.\" Six'), (3, 'no sentence end but many words here , ; :')) SELECT source_idx, v AS rationale FROM k JOIN e ON m = source_idx % 4")
def strip_artifacts(spark, sf):
    return derived(spark, sf, SKILLS).select("source_idx", X.strip_artifacts(F.col("rationale")).alias("rationale"))


@query("cap_rationales", f"WITH k AS ({SKILLS}), e(m, v, c) AS (VALUES (0, 'It rained. So the trip was.', TRUE), (1, 'open end', FALSE), (2, 'One. Two! Three?', TRUE), (3, 'no sentence end but many words.', TRUE)) SELECT source_idx, v AS bounded, c AS changed FROM k JOIN e ON m = source_idx % 4")
def cap_rationales(spark, sf):
    c = X.cap_rationale(X.strip_artifacts(F.col("rationale")), 6, 3)
    return derived(spark, sf, SKILLS).select("source_idx", c["text"].alias("bounded"), c["changed"].alias("changed"))


@query("parse_verdicts", f"""WITH k AS ({RAW_OUTPUTS}), e(m, prediction, parse_method, vals) AS (VALUES (0, 1, 'final_marker', '1'), (1, 1, 'answer_marker', '1,1'), (2, 0, 'json_verdict', '0,0'), (3, 1, 'json_verdict', '1,1'), (4, 1, 'json_verdict', '1'),
(5, 1, 'final_marker', '0,1'), (6, 1, 'answer_marker', '1'), (7, NULL, 'unparsed', ''), (8, 1, 'standalone_final_line', ''), (9, NULL, 'unparsed', '')) SELECT source_idx, prediction, parse_method, vals AS explicit_values, vals = '0,1' AS conflicting FROM k JOIN e ON m = tmpl""")
def parse_verdicts(spark, sf):
    d = P.with_verdict(derived(spark, sf, RAW_OUTPUTS), "raw_output", "v")
    return d.select("source_idx", "v.prediction", "v.parse_method", F.array_join(F.transform("v.explicit_values", lambda x: x.cast("string")), ",").alias("explicit_values"), "v.conflicting")


# ---- ordinals


@query("padded_ids", "SELECT conv_id, turn, 'H' || lpad(CAST(k AS VARCHAR), greatest(6, length(CAST((SELECT count(*) - 1 FROM conversations) AS VARCHAR)))::INT, '0') AS target_id FROM (SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn) - 1 AS k FROM conversations)")
def padded_ids(spark, sf):
    c = table(spark, sf, "conversations")
    return O.with_ordinal(c, "conv_id", "turn").select("conv_id", "turn", X.padded_id("H", F.col("source_idx"), c.count()).alias("target_id"))


@query("stream_ordinals", f"WITH {_SIGNALS} SELECT source_idx, CAST(row_number() OVER (PARTITION BY input_format ORDER BY source_idx) AS BIGINT) AS stream_order, printf('case-%s-%06d', input_format, row_number() OVER (PARTITION BY input_format ORDER BY source_idx)) AS custom_id FROM f WHERE input_format <> 'ambiguous'")
def stream_ordinals(spark, sf):
    d = O.with_ordinal(materialized(routed(spark, sf).select("source_idx", "input_format"), "routed").where("input_format <> 'ambiguous'"), "source_idx", name="stream_order", by=("input_format",), start=1)
    return d.select("source_idx", "stream_order", O.custom_id("case", F.col("input_format"), F.col("stream_order")).alias("custom_id"))


@query("shard_keys", "SELECT conv_id, turn, role || '-part-' || lpad(CAST((k - 1) // 50 + 1 AS VARCHAR), 4, '0') AS shard_key FROM (SELECT *, row_number() OVER (PARTITION BY role ORDER BY conv_id, turn) AS k FROM conversations)")
def shard_keys(spark, sf):
    d = O.with_ordinal(table(spark, sf, "conversations"), "conv_id", "turn", name="k", by=("role",), start=1)
    return d.select("conv_id", "turn", O.shard_key(F.col("role"), F.col("k"), 50).alias("shard_key"))


# ---- categories

_TERMS_VALUES = ", ".join(f"({q(c)}, {q('(?i)\\b(?:' + '|'.join(t) + ')\\b')})" for c, t in L.TERMS.items())
_MATCHED = f"d AS ({DILEMMAS}), lex(category, p) AS (VALUES {_TERMS_VALUES}), m AS (SELECT scenario_id, category, unnest(regexp_extract_all(context, p)) AS w FROM d, lex), x AS (SELECT DISTINCT scenario_id, category, lower(w) AS w FROM m), n AS (SELECT DISTINCT scenario_id, category FROM x)"


def categorized(spark, sf, **options):
    return L.categorized(derived(spark, sf, DILEMMAS), **options)


@query("keyword_matches", f"WITH {_MATCHED} SELECT scenario_id, category, string_agg(w, '|' ORDER BY w) AS words FROM x GROUP BY 1, 2")
def keyword_matches(spark, sf):
    d = categorized(spark, sf).select("scenario_id", F.explode("matched_keywords").alias("category", "words"))
    return d.withColumn("words", F.array_join("words", "|"))


_DOMAIN = ", ".join(f"({q(c)})" for c in L.DESCRIPTIONS)


@query("category_counts", f"WITH {_MATCHED} SELECT t.category, CAST(count(n.scenario_id) AS BIGINT) AS n FROM (VALUES {_DOMAIN}) t(category) LEFT JOIN n ON n.category = t.category GROUP BY 1")
def category_counts(spark, sf):
    return L.category_counts(categorized(spark, sf))


@query("category_rarity", f"WITH {_MATCHED}, f AS (SELECT category, count(*) AS k FROM n GROUP BY 1) SELECT scenario_id, round(sum(1.0 / k), 9) AS rarity, count(*) AS n_categories FROM n JOIN f USING (category) GROUP BY 1")
def category_rarity(spark, sf):
    d = materialized(categorized(spark, sf).select("scenario_id", "moral_categories"), "categories")
    d = L.with_rarity(d).where(F.size("moral_categories") > 0)
    return d.select("scenario_id", F.round("rarity", 9).alias("rarity"), F.size("moral_categories").cast("long").alias("n_categories"))


@query("uncategorized_rows", f"WITH {_MATCHED} SELECT scenario_id, context, action1, action2 FROM d WHERE scenario_id NOT IN (SELECT scenario_id FROM n)")
def uncategorized_rows(spark, sf):
    return categorized(spark, sf).where("needs_human_review").select("scenario_id", "context", "action1", "action2")


#: Function words of the documents' languages, as a lexicon parameter.
FUNCTION_WORDS = {"en": ["the", "and", "of"], "de": ["der", "die", "und"], "fr": ["le", "les", "et"], "es": ["el", "los", "que"]}


@query("function_word_counts", "WITH t AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+') AS w FROM documents), u AS (SELECT doc_id, unnest(w) AS w FROM t), l(category, w) AS (VALUES " + ", ".join(f"('{c}', '{w}')" for c, ws in FUNCTION_WORDS.items() for w in ws) + ") SELECT l.category, count(DISTINCT doc_id) AS documents, count(*) AS matches FROM u JOIN l USING (w) GROUP BY 1")
def function_word_counts(spark, sf):
    """One scan of the texts, whatever the number of categories."""
    return H.counts_by_category(H.matched(widened(table(spark, sf, "documents").select("text")), F.col("text"), H.table_of(spark, FUNCTION_WORDS)))


@query("lexicon_by_join", ORACLES["function_word_counts"])
def lexicon_by_join(spark, sf):
    """The same with a lexicon too large for a literal: filled up with phrases that no text has, it is joined by first word."""
    extra = spark.range(H.MOST_PHRASES + 1).select(F.lit("none").alias("category"), F.format_string("zq%dzq zq", "id").alias("phrase"), F.lit(0).alias("rank"))
    lexicon = H.table_of(spark, FUNCTION_WORDS).unionByName(extra)
    return H.counts_by_category(H.matched(widened(table(spark, sf, "documents").select("doc_id", "text")), F.col("text"), lexicon, key="doc_id"))


_OVERRIDES = "SELECT concat('S', CAST(o_orderkey AS STRING)) AS scenario_id FROM orders WHERE o_orderkey % 7 = 0"


def overrides(spark, sf):
    return derived(spark, sf, _OVERRIDES).withColumn("moral_categories", F.array(F.lit("truth_and_deception"), F.lit("law_and_legality"), F.lit("truth_and_deception")))


@query("override_categories", f"WITH {_MATCHED}, o AS ({_OVERRIDES}), i AS (SELECT scenario_id, string_agg(category, ',' ORDER BY category) AS c FROM n GROUP BY 1) SELECT scenario_id, CASE WHEN o.scenario_id IS NOT NULL THEN 'law_and_legality,truth_and_deception' ELSE coalesce(i.c, '') END AS moral_categories, coalesce(i.c, '') AS inferred_categories, o.scenario_id IS NOT NULL AS human_override_applied FROM d LEFT JOIN o USING (scenario_id) LEFT JOIN i USING (scenario_id)")
def override_categories(spark, sf):
    d = categorized(spark, sf, overrides=overrides(spark, sf))
    return d.select("scenario_id", F.array_join("moral_categories", ",").alias("moral_categories"), F.array_join("inferred_categories", ",").alias("inferred_categories"), "human_override_applied")


_MATCHED_ALL = _MATCHED.replace("regexp_extract_all(context, p)", "regexp_extract_all(context || ' ' || action1 || ' ' || action2, p)")


@query("routing_text_matches", f"WITH {_MATCHED_ALL} SELECT scenario_id, category, string_agg(w, '|' ORDER BY w) AS words FROM x GROUP BY 1, 2")
def routing_text_matches(spark, sf):
    """Matches in the context and both actions."""
    d = categorized(spark, sf, mode="context_actions").select("scenario_id", F.explode("matched_keywords").alias("category", "words"))
    return d.withColumn("words", F.array_join("words", "|"))


_DESCRIBED = ", ".join(f"({q(c)}, {q(t)})" for c, t in L.DESCRIPTIONS.items())


@query("category_descriptions", f"WITH {_MATCHED}, t(category, description) AS (VALUES {_DESCRIBED}) SELECT scenario_id, category, description FROM n JOIN t USING (category)")
def category_descriptions(spark, sf):
    d = categorized(spark, sf).select("scenario_id", L.descriptions(F.col("moral_categories")).alias("m"))
    return d.select("scenario_id", F.explode("m").alias("category", "description"))


@query("unknown_overrides", f"WITH d AS ({DILEMMAS}), o AS ({_OVERRIDES}) SELECT scenario_id FROM o WHERE scenario_id NOT IN (SELECT scenario_id FROM d WHERE source_idx % 2 = 0)")
def unknown_overrides(spark, sf):
    return overrides(spark, sf).select("scenario_id").join(derived(spark, sf, DILEMMAS).where("source_idx % 2 = 0").select("scenario_id"), "scenario_id", "left_anti")


@query("seed_cover")
def seed_cover(spark, sf):
    return O.seed_cover(categorized(spark, sf).where(~F.col("needs_human_review")), 24, 7)


# ---- joins and constraints


@query("strict_join_queries", f"WITH {_SIGNALS} SELECT target_id, source_idx, input_format, s AS scenario, e AS excuse, label AS gold_verdict FROM f WHERE input_format <> 'ambiguous'")
def strict_join_queries(spark, sf):
    v = views(spark, sf)
    joined, _ = J.strict_one_to_one(v["request"].unionByName(v["duty_role"]), v["private"].where("input_format <> 'ambiguous'").drop("input_format", "target_id"), "source_idx")
    return joined


@query("strict_join_violations", f"WITH {_SIGNALS} SELECT CAST(source_idx AS VARCHAR) AS key, 'extra' AS problem FROM f WHERE input_format = 'ambiguous'")
def strict_join_violations(spark, sf):
    v = views(spark, sf)
    return J.strict_one_to_one(v["request"].unionByName(v["duty_role"]), v["private"].drop("target_id", "input_format"), "source_idx")[1]


@query("missing_labels", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_labels(spark, sf):
    return J.pending(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), "doc_id")


@query("extra_labels", "SELECT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def extra_labels(spark, sf):
    return J.pending(table(spark, sf, "labels").select("doc_id"), table(spark, sf, "documents").where("lang = 'en'"), "doc_id")


@query("key_set_diff", "SELECT doc_id, CASE WHEN l.doc_id IS NULL THEN 'left_only' ELSE 'right_only' END AS side FROM (SELECT doc_id FROM documents WHERE lang = 'en') d FULL OUTER JOIN (SELECT doc_id FROM labels) l USING (doc_id) WHERE d.doc_id IS NULL OR l.doc_id IS NULL")
def key_set_diff(spark, sf):
    return J.key_set_diff(table(spark, sf, "documents").where("lang = 'en'"), table(spark, sf, "labels"), "doc_id")


@query("doc_label_join", "SELECT doc_id, lang, source, quality, toxic FROM documents JOIN labels USING (doc_id)")
def doc_label_join(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "lang", "source").join(table(spark, sf, "labels"), "doc_id")


@query("pending_docs", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 0)")
def pending_docs(spark, sf):
    return J.pending(table(spark, sf, "documents").select("doc_id", "lang"), table(spark, sf, "labels").where("toxic = 0"), "doc_id")


@query("labelled_semi", "SELECT doc_id FROM documents WHERE lang = 'de' INTERSECT SELECT doc_id FROM labels")
def labelled_semi(spark, sf):
    return J.shared_keys(table(spark, sf, "documents").where("lang = 'de'"), table(spark, sf, "labels"), "doc_id")


@query("source_lookup", f"WITH d AS ({DILEMMAS}) SELECT scenario_id, context, action2 FROM d")
def source_lookup(spark, sf):
    d = derived(spark, sf, DILEMMAS)
    joined, _ = J.strict_lookup(d.select("scenario_id"), d, "scenario_id")
    return joined.select("scenario_id", "context", "action2")


@query("context_mismatch", f"WITH d AS ({DILEMMAS}) SELECT scenario_id FROM d WHERE source_idx % 5 = 1 AND source_idx % 4 <> 0")
def context_mismatch(spark, sf):
    d = derived(spark, sf, DILEMMAS)
    other = d.select("scenario_id", F.when(F.col("source_idx") % 5 == 1, F.when(F.col("source_idx") % 4 == 0, "").otherwise("changed")).otherwise(F.col("context")).alias("other"))
    return J.mismatches(d.join(other, "scenario_id"), "context", "other").select("scenario_id")


@query("target_mismatch", "SELECT o_orderkey FROM orders WHERE o_orderkey % 4 IN (1, 3)")
def target_mismatch(spark, sf):
    m = F.col("o_orderkey") % 4
    d = table(spark, sf, "orders").select("o_orderkey", F.when(m == 1, "").when(m != 3, "T1").alias("own"), F.when(m == 2, "").otherwise("T1").alias("declared"))
    return J.contradicted(d, "own", "declared").select("o_orderkey")


@query("choice_resolution", f"WITH d AS ({DILEMMAS}) SELECT scenario_id, CASE WHEN chosen_action <> '' THEN chosen_action WHEN source_idx % 4 IN (0, 2) THEN action1 ELSE action2 END AS resolved FROM d")
def choice_resolution(spark, sf):
    return derived(spark, sf, DILEMMAS).select("scenario_id", P.chosen_action(F.col("chosen_action"), F.col("choice"), F.col("action1"), F.col("action2")).alias("resolved"))


@query("label_names", "SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN NULL WHEN 4 THEN 0 END::INTEGER AS named, CASE o_orderkey % 6 WHEN 0 THEN 1 WHEN 1 THEN 0 END::INTEGER AS strict, CASE o_orderkey % 6 WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 5 THEN 1 END::INTEGER AS lenient FROM orders")
def label_names(spark, sf):
    m = F.col("o_orderkey") % 6
    a = F.when(m == 0, "1").when(m == 1, " 0 ").when(m == 3, "2").when(m == 5, "1.0")
    b = F.when(m == 2, "1").when(m == 4, "0").when(m == 0, "0")
    return table(spark, sf, "orders").select("o_orderkey", P.named_label(a, b).alias("named"), P.strict_label(a).alias("strict"), P.lenient_label(a).alias("lenient"))


@query("alias_types", "SELECT o_orderkey, ['request', 'duty_role', 'duty_role', 'duty_role', NULL, 'request'][o_orderkey % 6 + 1] AS canonical FROM orders")
def alias_types(spark, sf):
    names = F.array(*(F.lit(x) for x in (" Requests", "role/duty", "DUTY-role ", "role", "other", "request")))
    return table(spark, sf, "orders").select("o_orderkey", P.canonical_type(F.get(names, (F.col("o_orderkey") % 6).cast("int"))).alias("canonical"))


@query("leak_guard", "SELECT event_id, 'k' AS leaked FROM events WHERE props IS NOT NULL")
def leak_guard(spark, sf):
    d = C.leaks(table(spark, sf, "events"), "props", ("k", "label"))
    return d.select("event_id", F.array_join("leaked", ",").alias("leaked"))


@query("nested_leaks", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'label' WHEN 1 THEN 'rationale' ELSE 'gold_verdict,label' END AS leaked FROM events WHERE event_id % 4 <> 3")
def nested_leaks(spark, sf):
    m = F.col("event_id") % 3
    doc = F.when(m == 0, '{"label": null, "x": 1}').when(m == 1, '{"input": {"rationale": null, "y": 2}}').otherwise('{"label": 1, "input": {"gold_verdict": 0}}')
    d = table(spark, sf, "events").withColumn("doc", F.when(F.col("event_id") % 4 == 3, '{"input": {"scenario": "s"}}').otherwise(doc))
    return C.leaks(d, "doc", C.FORBIDDEN).select("event_id", F.array_join("leaked", ",").alias("leaked"))


@query("missing_fields", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'a,b' ELSE 'b' END AS missing FROM orders WHERE o_orderkey % 4 < 3")
def missing_fields(spark, sf):
    m = F.col("o_orderkey") % 4
    d = table(spark, sf, "orders").select("o_orderkey", F.when(m >= 2, "x").when(m == 0, " \t\n").alias("a"), F.when(m.isin(0, 3), "y").when(m == 1, "").when(m == 2, "\t").alias("b"))
    return C.missing_fields(d, "o_orderkey", "a", "b").select("o_orderkey", F.array_join("missing", ",").alias("missing"))


@query("duplicate_keys", "SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1 HAVING count(*) > 1 ORDER BY conv_id LIMIT 10")
def duplicate_keys(spark, sf):
    return C.duplicates(table(spark, sf, "conversations"), "conv_id").orderBy("conv_id").limit(10)


@query("response_problems", "SELECT o_orderkey, ['error', 'status', 'no_choices', 'blank'][o_orderkey % 5 + 1] AS problem FROM orders WHERE o_orderkey % 5 < 4")
def response_problems(spark, sf):
    m = F.col("o_orderkey") % 5
    choice = F.struct(F.struct(F.when(m == 3, "\n").otherwise("text").alias("content")).alias("message"))
    d = table(spark, sf, "orders").withColumn("choices", F.when(m == 2, F.array().cast("array<struct<message:struct<content:string>>>")).otherwise(F.array(choice)))
    text = F.get("choices", F.lit(0))["message"]["content"]
    p = C.response_problem(F.when(m == 0, "boom"), F.when(m == 1, 500).otherwise(200), F.col("choices"), text)
    return d.select("o_orderkey", p.alias("problem")).where("problem IS NOT NULL")


_RAW_INPUTS = """SELECT o_orderkey AS ordinal, CASE o_orderkey % 5
    WHEN 0 THEN concat('{"source_idx": ', CAST(o_orderkey + 7 AS STRING), ', "target_id": "T1", "input_format": "role/duty", "scenario": " s ", "excuse": "e", "label": null}')
    WHEN 1 THEN '{"task_type": "Duty-Role", "scenario": "a", "excuse": "b", "gold": 1, "gold_label": 0}'
    WHEN 2 THEN '{"scenario": "c", "excuse": "d"}'
    WHEN 3 THEN '{"input_format": "request", "task_type": "duty", "scenario": "e", "excuse": "f"}'
    ELSE '{"scenario": "  ", "excuse": "g"}' END AS json
FROM orders"""


@query("normalized_inputs", f"WITH k AS ({_RAW_INPUTS}) SELECT ordinal, CASE WHEN ordinal % 5 = 0 THEN ordinal + 7 ELSE ordinal END AS source_idx, CASE WHEN ordinal % 5 = 0 THEN 'T1' END AS target_id, CASE WHEN ordinal % 5 = 3 THEN 'request' ELSE 'duty_role' END AS input_format, ['s', 'a', 'c', 'e', ''][ordinal % 5 + 1] AS scenario, ['label', 'gold,gold_label', '', '', ''][ordinal % 5 + 1] AS private_fields FROM k")
def normalized_inputs(spark, sf):
    d, _ = N.normalize_inputs(derived(spark, sf, _RAW_INPUTS), "duty_role", "cases")
    return d.select("ordinal", "source_reference.source_idx", "source_reference.target_id", "input_format", "input.scenario", F.array_join("private_fields_present_in_source", ",").alias("private_fields"))


@query("input_violations", f"WITH k AS ({_RAW_INPUTS}) SELECT ordinal, CASE ordinal % 5 WHEN 3 THEN 'wrong_type' ELSE 'missing_text' END AS problem FROM k WHERE ordinal % 5 IN (3, 4)")
def input_violations(spark, sf):
    return N.normalize_inputs(derived(spark, sf, _RAW_INPUTS), "duty_role", "cases")[1]


#: Skill lines: own, nested and text keys, a null or empty key beside a nested one, labels that are there though null.
_SKILL_LINES = """SELECT o_orderkey AS k, concat(CASE o_orderkey % 8
    WHEN 0 THEN concat('{"source_idx": ', CAST(o_orderkey AS STRING), ', "target_id": "T', CAST(o_orderkey AS STRING), '", "scenario": "\\\\t s ", "excuse": "e"')
    WHEN 1 THEN concat('{"source_reference": {"source_idx": ', CAST(o_orderkey AS STRING), ', "target_id": "T', CAST(o_orderkey AS STRING), '"}, "input": {"scenario": "a", "excuse": " b"}, "scenario": "not this"')
    WHEN 2 THEN concat('{"source_idx": " ', CAST(o_orderkey AS STRING), ' ", "target_id": "T', CAST(o_orderkey AS STRING), '", "input": "no object", "scenario": "c", "excuse": "d"')
    WHEN 3 THEN concat('{"source_idx": null, "source_reference": {"source_idx": ', CAST(o_orderkey AS STRING), ', "target_id": "T"}, "scenario": "e", "excuse": "f"')
    WHEN 4 THEN concat('{"source_idx": ', CAST(o_orderkey AS STRING), ', "target_id": "", "source_reference": {"target_id": "T"}, "scenario": 0, "excuse": "g"')
    WHEN 5 THEN concat('{"source_idx": ', CAST(o_orderkey AS STRING), ', "target_id": "T", "label": null, "scenario": "h", "excuse": "i"')
    WHEN 6 THEN concat('{"source_idx": "', CAST(o_orderkey AS STRING), '.5", "target_id": "T", "input": {"gold": 1, "scenario": "j", "excuse": []}')
    ELSE '[{"source_idx": 1' END, CASE WHEN o_orderkey % 8 = 7 THEN '}]' ELSE concat(', "input_format": "', CASE WHEN o_orderkey % 2 = 0 THEN 'request' ELSE 'duty_role' END, '", "skill_description": "Assess it."}') END) AS json
FROM orders"""
_LABEL_LINES = """SELECT o_orderkey AS k, CASE o_orderkey % 3
    WHEN 0 THEN concat('{"source_idx": ', CAST(o_orderkey AS STRING), ', "target_id": null, "label": ', CAST(o_custkey % 2 AS STRING), '}')
    WHEN 1 THEN concat('{"source_reference": {"source_idx": "', CAST(o_orderkey AS STRING), '"}, "gold_verdict": null, "gold": "', CAST(o_custkey % 2 AS STRING), '"}')
    ELSE concat('{"source_idx": ', CAST(o_orderkey AS STRING), ', "target_id": "T', CAST(o_orderkey AS STRING), '", "gold_verdict": "", "gold_label": ', CAST(o_custkey % 2 AS STRING), '}') END AS json
FROM orders"""


@query("raw_row_problems", f"WITH k AS ({_SKILL_LINES}) SELECT k, ['', '', '', 'no_source_idx', 'no_target_id,incomplete', 'leaks_labels', 'bad_source_idx,incomplete,leaks_labels', 'no_object'][k % 8 + 1] AS problems FROM k")
def raw_row_problems(spark, sf):
    """Keys that are absent, null or empty are told apart row by row."""
    d = K.skill_rows(derived(spark, sf, _SKILL_LINES), keep=("k",))
    return d.select("k", F.array_join("problems", ",").alias("problems"))


@query("frozen_raw_queries", f"WITH k AS ({_SKILL_LINES}) SELECT 'T' || k AS target_id, k AS source_idx, CASE WHEN k % 2 = 0 THEN 'request' ELSE 'duty_role' END AS input_format, ['s', 'a', 'c'][k % 8 + 1] AS scenario, ['e', 'b', 'd'][k % 8 + 1] AS excuse, CAST(o_custkey % 2 AS INTEGER) AS gold_verdict FROM k JOIN orders ON k = o_orderkey WHERE k % 8 < 3")
def frozen_raw_queries(spark, sf):
    """Raw skill and label lines joined strictly; keys are the row's own, nested, or text."""
    lines = [derived(spark, sf, t).where("k % 8 < 3").select("json") for t in (_SKILL_LINES, _LABEL_LINES)]
    out = stages.freeze_queries(*lines)
    return out["queries"].drop("skill_description").join(out["labels"].select("source_idx", "gold_verdict"), "source_idx")


_EXEMPLAR_LINES = """SELECT concat('{"source_reference": {"scenario_id": "S', CAST(o_orderkey AS STRING), '", "source_idx": ', CAST(o_orderkey AS STRING), '}, "skill_description": "Assess it.", "moral_categories": ["a", "b"], "framework": "',
  CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE 'own' END, '", "input": {"context": "', CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE concat('c', CAST(o_orderkey AS STRING)) END, '"}}') AS json FROM orders"""
_EXEMPLAR_SOURCE = """SELECT concat(' S', CAST(o_orderkey AS STRING)) AS id, concat('c', CAST(o_orderkey AS STRING), ' ') AS context, 'one' AS action_1, 'two' AS action2, CASE o_orderkey % 4 WHEN 0 THEN '1' WHEN 1 THEN 'Option_2' WHEN 2 THEN 'a' ELSE 'b' END AS choice,
  CASE WHEN o_orderkey % 3 = 0 THEN 'said' ELSE ' ' END AS chosen_action, 'thought' AS thought_process, 'f' AS framework FROM orders"""


@query("frozen_raw_exemplars", "SELECT 'S' || o_orderkey AS exemplar_id, o_orderkey AS source_idx, 'c' || o_orderkey AS context, CASE WHEN o_orderkey % 3 = 0 THEN 'said' WHEN o_orderkey % 4 IN (0, 2) THEN 'one' ELSE 'two' END AS chosen_action, 'a,b' AS moral_categories, 'f' AS framework FROM orders")
def frozen_raw_exemplars(spark, sf):
    d = stages.freeze_exemplars(derived(spark, sf, _EXEMPLAR_LINES), derived(spark, sf, _EXEMPLAR_SOURCE))
    return d.select("exemplar_id", "source_idx", "context", "chosen_action", F.array_join("moral_categories", ",").alias("moral_categories"), "framework")


@query("validator_counts", f"""WITH d AS (SELECT doc_id, count(*) AS n FROM documents GROUP BY 1), l AS (SELECT doc_id, count(*) AS n FROM labels GROUP BY 1)
SELECT (SELECT count(*) FROM documents) AS "rows", (SELECT count(*) FROM d WHERE n > 1) AS left_twice, (SELECT count(*) FROM l WHERE n > 1) AS right_twice, (SELECT count(*) FROM d WHERE doc_id NOT IN (SELECT doc_id FROM l)) AS left_only,
(SELECT count(*) FROM l WHERE doc_id NOT IN (SELECT doc_id FROM d)) AS right_only, (SELECT count(*) FROM documents WHERE regexp_replace(coalesce(text, ''), '^{_WS}|{_WS}$', '', 'g') = '') AS empty_text, (SELECT count(*) FROM documents WHERE lang IS NULL OR lang NOT IN ('en', 'de')) AS other_lang, (SELECT count(*) FROM labels WHERE toxic = 1) AS toxic""")
def validator_counts(spark, sf):
    """All rules of a pair of relations in one aggregation: row rules of both sides, keys twice, keys on one side only."""
    d = V.counts(table(spark, sf, "documents"), "doc_id", {"empty_text": V.not_empty("text"), "other_lang": V.outside("lang", ("en", "de"))}, table(spark, sf, "labels"), {"toxic": F.col("toxic") == 1})
    names = {V.TWICE_LEFT: "left_twice", V.TWICE_RIGHT: "right_twice", V.LEFT_ONLY: "left_only", V.RIGHT_ONLY: "right_only"}
    return d.select(*(F.col(f"`{c}`").alias(names.get(c, c)) for c in d.columns))


# ---- prompts

_BLOCK = "CASE input_format WHEN 'request' THEN 'Case format: request or excuse' || chr(10) || 'Scenario: ' || s || chr(10) || 'Proposed excuse: ' || e ELSE 'Case format: role or responsibility' || chr(10) || 'Role or context: ' || s || chr(10) || 'Proposed responsibility: ' || e END"


def public(spark, sf):
    return split_public(spark, sf).withColumn("block", M.case_block(F.col("input_format"), F.col("scenario"), F.col("excuse")))


@query("prompt_blocks", f"WITH {_SIGNALS} SELECT source_idx, sha256({_BLOCK}) AS block_sha256, sha256('Scenario: ' || s || chr(10) || 'Proposed response or responsibility: ' || e || chr(10) || chr(10) || {q(M.DIRECT)} || chr(10) || chr(10) || {q(M.VERDICT)}) AS direct_sha256 FROM f WHERE input_format <> 'ambiguous'")
def prompt_blocks(spark, sf):
    return public(spark, sf).select("source_idx", X.sha256(F.col("block")).alias("block_sha256"), X.sha256(M.direct_prompt(M.neutral_block(F.col("scenario"), F.col("excuse")))).alias("direct_sha256"))


@query("verdict_prompts", f"WITH {_SIGNALS}, p AS (SELECT *, CASE WHEN source_idx % 2 = 0 THEN 'direct_verdict' ELSE 'rationale_verdict' END AS condition FROM f WHERE input_format <> 'ambiguous') SELECT source_idx, condition, sha256({_BLOCK} || chr(10) || chr(10) || CASE WHEN condition = 'direct_verdict' THEN {q(M.DIRECT)} ELSE 'Candidate reasoning trace:' || chr(10) || 'Because ' || e END || chr(10) || chr(10) || {q(M.VERDICT)}) AS prompt_sha256 FROM p")
def verdict_prompts(spark, sf):
    d = public(spark, sf).withColumn("condition", F.when(F.col("source_idx") % 2 == 0, "direct_verdict").otherwise("rationale_verdict"))
    return d.select("source_idx", "condition", X.sha256(M.verdict_prompt(F.col("block"), F.col("condition"), F.concat(F.lit("Because "), F.col("excuse")))).alias("prompt_sha256"))


@query("prompt_hash", f"WITH {_SIGNALS} SELECT source_idx, sha256({q(M.SYSTEM)} || chr(10) || {_BLOCK} || chr(10) || chr(10) || {q(M.RATIONALE)}) AS prompt_sha256 FROM f WHERE input_format <> 'ambiguous'")
def prompt_hash(spark, sf):
    return public(spark, sf).select("source_idx", X.prompt_digest(M.SYSTEM, M.rationale_prompt(F.col("block"))).alias("prompt_sha256"))


_SEEDS = "SELECT CAST(o_orderkey + 1 AS INT) AS position, concat('Could you do task ', CAST(o_orderkey AS STRING), '?') AS scenario, 'No, I am ill.' AS excuse, concat('Assess reason ', CAST(o_orderkey AS STRING), '.') AS skill_description FROM orders WHERE o_orderkey < 16"


@query("fewshot_prompts", f"WITH {_SIGNALS}, z AS ({_SEEDS}), t AS (SELECT {q(M.FEW_SHOT)} || string_agg(chr(10) || chr(10) || '### Demonstration ' || position || chr(10) || '### Case type: request' || chr(10) || '### Scenario: ' || scenario || chr(10) || '### Proposed excuse or duty claim: ' || excuse || chr(10) || '### Skills: ' || skill_description, '' ORDER BY position) AS d FROM z) SELECT source_idx, sha256(d || chr(10) || chr(10) || '### New case' || chr(10) || '### Case type: request' || chr(10) || '### Scenario: ' || s || chr(10) || '### Proposed excuse or duty claim: ' || e || chr(10) || '### Skills:') AS prompt_sha256 FROM f, t WHERE input_format = 'request'")
def fewshot_prompts(spark, sf):
    d = M.few_shot_prompts(split_public(spark, sf).where("input_format = 'request'"), derived(spark, sf, _SEEDS), "request")
    return d.select("source_idx", X.sha256(F.col("prompt")).alias("prompt_sha256"))


@query("checklist_prompts", f"WITH {_SIGNALS} SELECT source_idx, sha256({q(M.TASK)} || chr(10) || chr(10) || {q(M.CHECKLIST)} || chr(10) || chr(10) || {q(M.DEMONSTRATIONS)} || chr(10) || chr(10) || 'OPTIONAL DEMONSTRATIONS:' || chr(10) || '[]' || chr(10) || chr(10) || 'TARGET CASE:' || chr(10) || 'Scenario: ' || s || chr(10) || 'Proposed excuse or responsibility: ' || e || chr(10) || chr(10) || {q(M.CLOSING)}) AS prompt_sha256 FROM f WHERE input_format <> 'ambiguous'")
def checklist_prompts(spark, sf):
    return public(spark, sf).select("source_idx", X.sha256(M.checklist_prompt(F.col("scenario"), F.col("excuse"))).alias("prompt_sha256"))


@query("batch_requests", f"WITH {_SIGNALS}, p AS (SELECT *, printf('case-%s-%06d', input_format, row_number() OVER (PARTITION BY input_format ORDER BY source_idx)) AS custom_id FROM f WHERE input_format <> 'ambiguous') SELECT custom_id, 'POST' AS method, 'judge-1' AS model, 'user' AS role, sha256({_BLOCK}) AS content_sha256, 120 AS max_tokens FROM p")
def batch_requests(spark, sf):
    d = O.with_ordinal(public(spark, sf), "source_idx", name="k", by=("input_format",), start=1)
    r = M.request(O.custom_id("case", F.col("input_format"), F.col("k")), F.col("block"), "judge-1")
    m = F.get(F.col("r.body.messages"), F.lit(0))
    return d.select(r.alias("r")).select("r.custom_id", "r.method", "r.body.model", m["role"].alias("role"), X.sha256(m["content"]).alias("content_sha256"), "r.body.max_tokens")


# ---- metrics

_SOFT = f"k AS ({PREDICTIONS}), v AS (SELECT *, exp(score0 - greatest(score0, score1)) AS e0, exp(score1 - greatest(score0, score1)) AS e1, CASE WHEN score0 >= score1 THEN 0 ELSE 1 END AS predicted_verdict FROM k), y AS (SELECT *, e0 / (e0 + e1) AS p0, e1 / (e0 + e1) AS p1 FROM v)"


def predictions(spark, sf):
    d = derived(spark, sf, PREDICTIONS).withColumn("s", P.softmax2(F.col("score0"), F.col("score1")))
    d = d.withColumn("predicted_verdict", F.col("s.verdict")).withColumn("probability_0", F.col("s.p0")).withColumn("probability_1", F.col("s.p1")).drop("s")
    d = d.withColumn("correct", F.col("predicted_verdict") == F.col("gold_verdict"))
    return d.withColumn("gold_probability", P.by_label(F.col("gold_verdict"), F.col("probability_0"), F.col("probability_1")))


@query("softmax_verdicts", f"WITH {_SOFT} SELECT source_idx, predicted_verdict, round(p0, 9) AS probability_0, round(p1, 9) AS probability_1, round(CASE gold_verdict WHEN 0 THEN p0 ELSE p1 END, 9) AS gold_probability FROM y")
def softmax_verdicts(spark, sf):
    return predictions(spark, sf).select("source_idx", "predicted_verdict", *(F.round(c, 9).alias(c) for c in ("probability_0", "probability_1", "gold_probability")))


@query("group_accuracy_rollup", f"WITH {_SOFT}, w AS (SELECT input_format, completed, CASE WHEN source_idx % 5 <> 0 THEN predicted_verdict END AS prediction, gold_verdict FROM y) SELECT input_format, CAST(grouping(input_format) AS INTEGER) AS overall, count(*) AS total, count(*) FILTER (completed) AS completed, count(*) FILTER (completed AND prediction = gold_verdict) AS correct, count(*) FILTER (completed AND prediction IS NOT NULL) AS parsed, round(count(*) FILTER (completed AND prediction = gold_verdict) / count(*), 9) AS accuracy, round(count(*) FILTER (completed AND prediction IS NOT NULL) / count(*) FILTER (completed), 9) AS parse_rate FROM w GROUP BY ROLLUP (input_format)")
def group_accuracy_rollup(spark, sf):
    d = predictions(spark, sf).withColumn("prediction", F.when(F.col("source_idx") % 5 != 0, F.col("predicted_verdict")))
    d = A.accuracy_rollup(d.withColumn("correct", F.coalesce(F.col("prediction") == F.col("gold_verdict"), F.lit(False))))
    return d.withColumn("accuracy", F.round("accuracy", 9)).withColumn("parse_rate", F.round("parse_rate", 9))


@query("confusion", f"WITH {_SOFT} SELECT " + ", ".join(f"count(*) FILTER (gold_verdict = {g} AND predicted_verdict = {p}) AS gold_{g}_predicted_{p}" for g in (0, 1) for p in (0, 1)) + " FROM y")
def confusion(spark, sf):
    return A.confusion(predictions(spark, sf))


@query("label_confusion", "SELECT " + ", ".join(f"count(*) FILTER (quality = {g} AND toxic = {p}) AS gold_{g}_predicted_{p}" for g in (0, 1) for p in (0, 1)) + " FROM labels")
def label_confusion(spark, sf):
    return A.confusion(table(spark, sf, "labels"), "quality", "toxic")


@query("class_metrics", f"WITH {_SOFT}, c AS (SELECT l.k AS label, count(*) FILTER (gold_verdict = l.k AND predicted_verdict = l.k)::DOUBLE AS tp, count(*) FILTER (gold_verdict <> l.k AND predicted_verdict = l.k)::DOUBLE AS fp, count(*) FILTER (gold_verdict = l.k AND predicted_verdict <> l.k)::DOUBLE AS fn FROM y, (VALUES (0), (1)) l(k) GROUP BY l.k), m AS (SELECT label, tp / (tp + fp) AS p, tp / (tp + fn) AS r, CAST(tp + fn AS BIGINT) AS support FROM c) SELECT label, round(p, 9) AS precision, round(r, 9) AS recall, round(2 * p * r / (p + r), 9) AS f1, support, round((SELECT avg(2 * p * r / (p + r)) FROM m), 9) AS macro_f1 FROM m")
def class_metrics(spark, sf):
    d = A.class_metrics(predictions(spark, sf))
    return d.select("label", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1", "macro_f1")), "support")


@query("format_accuracy", f"WITH {_SOFT} SELECT t.f AS input_format, count(y.source_idx) AS records, round(coalesce(avg((predicted_verdict = gold_verdict)::INT), 0.0), 9) AS accuracy FROM (VALUES ('request'), ('duty_role'), ('ambiguous')) t(f) LEFT JOIN y ON input_format = t.f GROUP BY 1")
def format_accuracy(spark, sf):
    return A.accuracy_by(predictions(spark, sf), domain=(*R.FORMATS, "ambiguous")).withColumn("accuracy", F.round("accuracy", 9))


@query("observed_accuracy", f"WITH {_SOFT} SELECT input_format, count(*) AS records, round(avg((predicted_verdict = gold_verdict)::INT), 9) AS accuracy FROM y GROUP BY 1")
def observed_accuracy(spark, sf):
    return A.accuracy_by(predictions(spark, sf)).withColumn("accuracy", F.round("accuracy", 9))


@query("mean_gold_probability", f"WITH {_SOFT} SELECT count(*) AS records, round(avg(CASE gold_verdict WHEN 0 THEN p0 ELSE p1 END), 9) AS mean_gold_probability FROM y")
def mean_gold_probability(spark, sf):
    return A.summary(predictions(spark, sf)).select("records", F.round("mean_gold_probability", 9).alias("mean_gold_probability"))


@query("flag_counts", f"WITH {_SOFT} SELECT count(*) AS records, count(*) FILTER (predicted_verdict = gold_verdict) AS correct, count(*) FILTER (NOT completed) AS pending, count(*) FILTER (source_idx % 17 = 0) AS input_was_truncated FROM y")
def flag_counts(spark, sf):
    d = predictions(spark, sf).withColumn("pending", ~F.col("completed")).withColumn("input_was_truncated", F.col("source_idx") % 17 == 0)
    return A.summary(d, ("pending", "input_was_truncated")).select("records", "correct", "pending", "input_was_truncated")


@query("usage_totals", f"WITH k AS ({SKILLS}) SELECT CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(coalesce(completion_tokens, 0)) AS BIGINT) AS completion_tokens FROM k")
def usage_totals(spark, sf):
    return A.usage_totals(derived(spark, sf, SKILLS), "prompt_tokens", "completion_tokens")


_JOBS = """SELECT concat('job-', CAST(o_orderkey AS STRING)) AS job_key, CASE o_orderkey % 5 WHEN 0 THEN 'completed' WHEN 1 THEN 'failed' WHEN 2 THEN 'expired' WHEN 3 THEN 'in_progress' ELSE 'cancelled' END AS status,
  CASE o_orderkey % 3 WHEN 0 THEN 'b,a,b' WHEN 1 THEN 'a' ELSE NULL END AS codes FROM orders"""


@query("job_error_codes", f"WITH k AS ({_JOBS}) SELECT job_key, CASE codes WHEN 'b,a,b' THEN 'a,b' ELSE coalesce(codes, '') END AS codes FROM k WHERE status IN ('failed', 'expired', 'cancelled')")
def job_error_codes(spark, sf):
    d = derived(spark, sf, _JOBS).withColumn("error_codes", F.split("codes", ","))
    return A.error_codes(d).select("job_key", F.array_join("codes", ",").alias("codes"))


@query("job_actions", f"WITH k AS ({_JOBS}) SELECT CASE WHEN o = 0 THEN 'request' ELSE job_key END AS job_key, status, CASE WHEN status = 'completed' THEN 'keep' WHEN status = 'in_progress' THEN 'wait' WHEN codes = 'a' AND o = 0 THEN 'retire' ELSE 'fail' END AS action FROM (SELECT *, length(job_key) % 2 AS o FROM k)")
def job_actions(spark, sf):
    """What follows for each of many jobs, by a join with the transitions."""
    d = derived(spark, sf, _JOBS).withColumn("job_key", F.when(F.length("job_key") % 2 == 0, "request").otherwise(F.col("job_key")))
    codes = F.transform(F.split("codes", ","), lambda c: F.when(c == "a", jobs.OVERSIZED).otherwise(c))
    return jobs.job_actions(d.withColumn("error_codes", codes)).select("job_key", "status", "action")


@query("one_row_report", f"WITH {_SOFT}, f AS (SELECT input_format, count(*) AS n, avg((predicted_verdict = gold_verdict)::INT) AS a FROM y GROUP BY 1), c AS (SELECT count(*) FILTER (gold_verdict = 1 AND predicted_verdict = 1)::DOUBLE AS tp, count(*) FILTER (gold_verdict = 0 AND predicted_verdict = 1)::DOUBLE AS fp, count(*) FILTER (gold_verdict = 1 AND predicted_verdict = 0)::DOUBLE AS fn FROM y) SELECT (SELECT count(*) FROM y) AS records, (SELECT round(avg((predicted_verdict = gold_verdict)::INT), 9) FROM y) AS accuracy, round(2 * tp / (2 * tp + fp + fn), 9) AS f1_of_1, CAST(tp + fn AS BIGINT) AS support_of_1, (SELECT n FROM f WHERE input_format = 'request') AS requests, (SELECT round(a, 9) FROM f WHERE input_format = 'duty_role') AS duty_role_accuracy FROM c")
def one_row_report(spark, sf):
    """The whole summary as one row, with maps of the metrics by label and format."""
    r = A.report(predictions(spark, sf), (), R.FORMATS)
    of = lambda c, k: F.element_at(c, F.lit(k))
    return r.select("records", F.round("accuracy", 9).alias("accuracy"), F.round(of("per_label", 1)["f1"], 9).alias("f1_of_1"), of("per_label", 1)["support"].alias("support_of_1"), of("by_input_format", "request")["records"].alias("requests"), F.round(of("by_input_format", "duty_role")["accuracy"], 9).alias("duty_role_accuracy"))


@query("completed_rollup", "WITH d AS (SELECT lang, toxic FROM documents LEFT JOIN labels USING (doc_id)) SELECT lang, CAST(grouping(lang) AS INTEGER) AS overall, count(*) AS total, count(toxic) AS completed, count(*) FILTER (toxic = 0) AS correct FROM d GROUP BY ROLLUP (lang)")
def completed_rollup(spark, sf):
    """Rows without a label stay in the totals: a left join before the aggregation."""
    l = table(spark, sf, "labels").select("doc_id", "toxic")  # noqa: E741
    d = table(spark, sf, "documents").select("doc_id", "lang").join(l, "doc_id", "left").withColumn("completed", F.col("toxic").isNotNull()).withColumn("prediction", F.col("toxic"))
    d = A.accuracy_rollup(d.withColumn("correct", F.coalesce(F.col("toxic") == 0, F.lit(False))), "lang")
    return d.select("lang", "overall", "total", "completed", "correct")


@query("batch_result_violations", f"WITH k AS ({_JOBS}) SELECT job_key AS key, CASE WHEN status = 'in_progress' THEN 'missing' ELSE 'duplicate_right' END AS problem FROM k WHERE status IN ('in_progress', 'expired')")
def batch_result_violations(spark, sf):
    d = derived(spark, sf, _JOBS).select(F.col("job_key").alias("custom_id"), "status")
    output = d.where("status <> 'in_progress'").unionByName(d.where("status = 'expired'")).select("custom_id", F.lit(1).alias("answer"))
    return J.batch_results(d, output)[1]


@query("seed_bank_problems", f"SELECT 's' || o_orderkey AS seed_id, CASE o_orderkey % 4 WHEN 1 THEN 'wrong_format' WHEN 2 THEN 'empty_input' ELSE 'not_assess' END AS problem FROM orders WHERE o_orderkey % 4 > 0 UNION ALL SELECT count(*) || ' rows', 'wrong_size' FROM orders")
def seed_bank_problems(spark, sf):
    m = F.col("o_orderkey") % 4
    seeds = table(spark, sf, "orders").select(F.concat(F.lit("s"), F.col("o_orderkey")).alias("seed_id"), F.when(m == 1, "duty_role").otherwise("request").alias("input_format"), F.lit("s").alias("scenario"), F.when(m == 2, " ").otherwise("e").alias("excuse"), F.when(m == 3, "Weigh it").otherwise("Assess it").alias("skill_description"))
    return C.seed_bank(seeds, "request", 16)


@query("format_failures", f"WITH k AS ({SKILLS}), b AS (SELECT source_idx FROM k WHERE source_idx % 6 NOT IN (0, 4)) SELECT source_idx, (SELECT count(*) FROM b) AS failures FROM b")
def format_failures(spark, sf):
    d = derived(spark, sf, SKILLS).withColumn("c", X.skill_checks(X.clean_skill(F.col("raw")))).withColumn("ok", F.col("c.starts_with_assess") & F.col("c.word_count_in_range") & F.col("c.single_line"))
    count, bad = A.format_failures(d, "ok", "source_idx", "source_idx")
    return bad.join(F.broadcast(count), F.lit(True))


# ---- unions, samples


@query("combined_union", "SELECT conv_id, turn, role, length(text) AS n FROM conversations")
def combined_union(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role", F.length("text").cast("long").alias("n"))
    return c.where("role = 'user'").unionByName(c.where("role IS NULL OR role <> 'user'"))


@query("ordered_combined", f"WITH {_SIGNALS}, o AS (SELECT CASE WHEN source_idx % 50 = 0 THEN NULL ELSE source_idx END AS source_idx, input_format, target_id FROM f WHERE input_format <> 'ambiguous') SELECT * FROM o ORDER BY coalesce(source_idx, 1000000000000), input_format")
def ordered_combined(spark, sf):
    v = views(spark, sf)
    idx = F.when(F.col("source_idx") % 50 != 0, F.col("source_idx")).alias("source_idx")
    a, b = (v[f].select(idx, "input_format", "target_id") for f in R.FORMATS)
    return O.combined(a, b)


@query("idempotent_diff", "SELECT doc_id, 1 - toxic AS toxic, 'left' AS side FROM labels WHERE doc_id % 9 = 0 UNION ALL SELECT doc_id, toxic, 'right' FROM labels WHERE doc_id % 9 = 0")
def idempotent_diff(spark, sf):
    t = table(spark, sf, "labels").select("doc_id", "toxic")
    return J.relation_diff(t.withColumn("toxic", F.when(F.col("doc_id") % 9 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic"))), t)


@query("ordered_diff", "WITH o AS (SELECT doc_id, toxic, row_number() OVER (ORDER BY doc_id) - 1 AS k, row_number() OVER (ORDER BY CASE WHEN doc_id % 10 = 3 THEN doc_id + 1 WHEN doc_id % 10 = 4 THEN doc_id - 1 ELSE doc_id END) - 1 AS m FROM labels) SELECT a.k AS ordinal, a.doc_id AS left_id, b.doc_id AS right_id FROM o a JOIN o b ON a.k = b.m WHERE a.doc_id <> b.doc_id OR a.toxic IS DISTINCT FROM b.toxic")
def ordered_diff(spark, sf):
    """The same rows in another order: every place at which the two lists differ."""
    t = table(spark, sf, "labels").select("doc_id", "toxic")
    m = F.col("doc_id") % 10
    moved = O.with_ordinal(t.withColumn("_o", F.when(m == 3, F.col("doc_id") + 1).when(m == 4, F.col("doc_id") - 1).otherwise(F.col("doc_id"))), "_o", name="ordinal").drop("_o")
    d = J.ordered_diff(O.with_ordinal(t, "doc_id", name="ordinal"), moved)
    id_of = lambda c: F.get_json_object(c, "$.doc_id").cast("long")
    return d.select("ordinal", id_of("left").alias("left_id"), id_of("right").alias("right_id"))


@query("audit_quota", f"WITH {_SIGNALS}, n AS (SELECT count(*) AS total, count(*) FILTER (input_format = 'request') AS r FROM f WHERE input_format <> 'ambiguous'), s AS (SELECT *, least(100, total) AS t, least(100, total) * r / total::DOUBLE AS x FROM n) SELECT 'request' AS input_format, r AS n, CAST(round_even(x, 0) AS BIGINT) AS quota FROM s UNION ALL SELECT 'duty_role', total - r, CAST(t - round_even(x, 0) AS BIGINT) FROM s")
def audit_quota(spark, sf):
    return O.audit_quota(split_public(spark, sf), 100)


@query("audit_sample", f"WITH {_SIGNALS}, n AS (SELECT least(100, count(*)) AS t, CAST(round_even(least(100, count(*)) * count(*) FILTER (input_format = 'request') / count(*)::DOUBLE, 0) AS BIGINT) AS r FROM f WHERE input_format <> 'ambiguous'), h AS (SELECT source_idx, input_format, row_number() OVER (PARTITION BY input_format ORDER BY sha256('3:' || input_format || ':' || source_idx), source_idx) AS i FROM f WHERE input_format <> 'ambiguous'), u AS (SELECT h.* FROM h, n WHERE i <= CASE input_format WHEN 'request' THEN r ELSE t - r END) SELECT source_idx, input_format, CAST(row_number() OVER (ORDER BY sha256('4:' || source_idx), source_idx) AS INTEGER) AS audit_id FROM u")
def audit_sample(spark, sf):
    return O.audit_sample(split_public(spark, sf).select("source_idx", "input_format"), 100, 3)


@query("exact_draws", "SELECT doc_id, CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) AS place, true AS in_range FROM documents")
def exact_draws(spark, sf):
    """One generator's draws for all rows in order, made by tasks that go on from noted states; the draws themselves are
    tested against a plain loop."""
    t = O.with_ordinal(table(spark, sf, "documents").select("doc_id"), "doc_id", name="place")
    tied = O.exact_ties(t, 11, "doc_id", "place")
    return t.join(tied, "doc_id").select("doc_id", "place", F.col("tie").between(0, 1).alias("in_range"))


@query("experiment_grid", "SELECT CAST(row_number() OVER (ORDER BY m, c, n_name) - 1 AS INTEGER) AS task, m AS model, c AS condition, n_name AS site FROM (VALUES ('m1'), ('m2')) a(m), (VALUES ('direct_verdict'), ('rationale_verdict')) b(c), nation")
def experiment_grid(spark, sf):
    return J.grid(spark, model=["m1", "m2"], condition=["direct_verdict", "rationale_verdict"], site=table(spark, sf, "nation").select("n_name"))


# ---- scoring with a deterministic stand-in

_SCORE = "-((('0x' || substr(sha256(b || chr(0) || '{c}'), 1, 2))::INTEGER) + 1) / 64.0"
_SCORED = f"p AS (SELECT *, {_BLOCK} AS b FROM f WHERE input_format <> 'ambiguous'), z AS (SELECT *, {_SCORE.format(c='{"verdict": 0}')} AS s0, {_SCORE.format(c='{"verdict": 1}')} AS s1 FROM p)"


def scored(spark, sf):
    return S.score_verdicts(public(spark, sf).withColumnRenamed("block", "prompt"), S.Deterministic, M.SYSTEM)


class Other(S.Deterministic):
    """A second model: the first one's scores less one."""

    def score(self, system, prompts, completion):
        return [(x - 1.0, i, n) for x, i, n in super().score(system, prompts, completion)]


@query("two_scorers", f"WITH {_SIGNALS}, {_SCORED} SELECT target_id, s0 AS first_score, s0 - 1.0 AS second_score FROM z")
def two_scorers(spark, sf):
    """Two models over the same rows in one session, each with its own scores."""
    p = public(spark, sf).withColumnRenamed("block", "prompt")
    a, b = (S.score_verdicts(p, m, M.SYSTEM).select("target_id", F.col("label_logprob_0").alias(n)) for m, n in ((S.Deterministic, "first_score"), (Other, "second_score")))
    return a.join(b, "target_id")


@query("scored_with_fake", f"WITH {_SIGNALS}, {_SCORED}, t AS (SELECT *, CASE WHEN s0 >= s1 THEN 0 ELSE 1 END AS predicted_verdict, exp(s0 - greatest(s0, s1)) AS e0, exp(s1 - greatest(s0, s1)) AS e1 FROM z) SELECT target_id, predicted_verdict, predicted_verdict = label AS correct, round(CASE label WHEN 0 THEN e0 ELSE e1 END / (e0 + e1), 9) AS gold_probability FROM t")
def scored_with_fake(spark, sf):
    labels = views(spark, sf)["private"]
    return J.late_labels(scored(spark, sf), labels).select("target_id", "predicted_verdict", "correct", F.round("gold_probability", 9).alias("gold_probability"))


#: The stand-in stops at its fourth sentence, which are nine words each.
_GENERATED = f"""WITH {_SIGNALS}, p AS (SELECT *, {_BLOCK} AS b FROM f WHERE input_format <> 'ambiguous')
SELECT target_id, ('0x' || substr(sha256(b || chr(0) || (source_idx + 5)), 1, 2))::INTEGER % 2 AS prediction, 'final_marker' AS parse_method,
least(len(regexp_extract_all('[system] ' || {q(M.SYSTEM)} || ' [user] ' || b, '\\S+')), 4096) AS input_token_count, 36::BIGINT AS generated_token_count, false AS hit_max_new_tokens FROM p"""


@query("generated_and_parsed", _GENERATED)
def generated_and_parsed(spark, sf):
    """Texts of the stand-in generator, each row by its own seed, and the verdicts parsed from them."""
    g = S.generate_texts(public(spark, sf).withColumnRenamed("block", "prompt"), S.Deterministic, M.SYSTEM, seed=5)
    g = P.with_verdict(g, "raw_output", "v")
    return g.select("target_id", "v.prediction", "v.parse_method", "input_token_count", "generated_token_count", "hit_max_new_tokens")


# ---- sources, sinks, resume


#: White space at the ends of a text is part of it; the writer would take it off.
AS_IS = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


@query("csv_roundtrip", "SELECT doc_id, lang, coalesce(text, '') AS text FROM documents")
def csv_roundtrip(spark, sf):
    """Texts with line feeds, quotes and backslashes written as CSV and read back."""
    path = fresh_path(spark, "csv")
    table(spark, sf, "documents").select("doc_id", "lang", "text").write.csv(path, header=True, escape='"', quoteAll=True, **AS_IS)
    d = readers.read_csv(spark, path, ("doc_id", "text"))
    return d.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text")


@query("csv_in_blocks", ORACLES["csv_roundtrip"])
def csv_in_blocks(spark, sf):
    """A file of each task's texts, quoted only where they must be, read in parts of 64 KB, most of which begin inside quotes."""
    path = fresh_path(spark, "csv-one")
    table(spark, sf, "documents").select("doc_id", "lang", "text").write.csv(path, header=True, escape='"', emptyValue="", **AS_IS)
    d = readers.read_csv(spark, path, ("doc_id", "text"), split=1 << 16)
    return d.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text")


_LINES = """SELECT o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN concat('{"k": ', CAST(o_orderkey AS STRING), '}') WHEN 1 THEN concat('{"k": 1}{"k": ', CAST(o_orderkey AS STRING), '}') WHEN 2 THEN '{"k": 3} {"k": 4}'
  WHEN 3 THEN '{"k": 6, "k": 7} x}' WHEN 4 THEN '{"k": "}{", "l": [{}, "]"]}' WHEN 5 THEN '[1]' WHEN 6 THEN '{"k": 1},"v": 0}' ELSE '' END AS line FROM orders"""


@query("json_line_faults", f"WITH k AS ({_LINES}) SELECT o_orderkey, line FROM k WHERE o_orderkey % 8 IN (1, 2, 3, 5, 6)")
def json_line_faults(spark, sf):
    """Lines that are not one whole JSON object."""
    return derived(spark, sf, _LINES).where(readers.not_objects(F.col("line"))).select("o_orderkey", "line")


@query("jsonl_roundtrip", "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN role END AS role, text FROM conversations")
def jsonl_roundtrip(spark, sf):
    path = fresh_path(spark, "jsonl")
    writers.write_jsonl(table(spark, sf, "conversations").withColumn("role", F.when(F.col("turn") % 2 == 0, F.col("role"))), path)
    return readers.read_jsonl(spark, path, "conv_id long, turn long, role string, text string")


@query("null_keys_written", "SELECT conv_id, turn, 'conv_id,role,text,turn' AS keys FROM conversations")
def null_keys_written(spark, sf):
    path = fresh_path(spark, "keys")
    writers.write_jsonl(table(spark, sf, "conversations").withColumn("role", F.lit(None).cast("string")), path)
    j = readers.read_raw_json(spark, path)
    keys = F.array_join(F.array_sort(C.present_keys(F.col("json"), None)), ",")
    return j.select(F.get_json_object("json", "$.conv_id").cast("long").alias("conv_id"), F.get_json_object("json", "$.turn").cast("long").alias("turn"), keys.alias("keys"))


@query("fan_out_counts", f"WITH {_MATCHED} SELECT category, count(*) AS n FROM n GROUP BY 1")
def fan_out_counts(spark, sf):
    path = fresh_path(spark, "fan")
    writers.fan_out(categorized(spark, sf).select("scenario_id", "moral_categories"), path, "moral_categories")
    return spark.read.json(path).groupBy("category").agg(F.count("*").alias("n"))


@query("idempotent_write", "SELECT doc_id, toxic, FALSE AS written_again FROM labels")
def idempotent_write(spark, sf):
    path, t = fresh_path(spark, "once"), table(spark, sf, "labels").select("doc_id", "toxic")
    writers.ensure_written(t, path)
    again = writers.ensure_written(t.repartition(3), path)
    return spark.read.parquet(path).withColumn("written_again", F.lit(again))


@query("file_sha256", "SELECT CAST(octet_length(encode(b)) AS BIGINT) AS size, sha256(b) AS sha256 FROM (SELECT string_agg(doc_id || ',' || quality || ',' || toxic || chr(10), '' ORDER BY doc_id) AS b FROM labels)")
def file_sha256(spark, sf):
    """The digest of a written file, read back in blocks."""
    path = fresh_path(spark, "digest")
    table(spark, sf, "labels").select("doc_id", "quality", "toxic").coalesce(1).sortWithinPartitions("doc_id").write.csv(path)
    return readers.file_digests(spark, path).where("path LIKE '%.csv'").select("size", "sha256")


@query("streamed_word_counts", "SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\s\\x0b\\x1c-\\x1f\\x{85}\\p{Z}]+')) AS INTEGER) AS n_words FROM documents")
def streamed_word_counts(spark, sf):
    """Texts that arrive in files, half of them twice, measured by a stream that looks at no result it has written."""
    source, d = fresh_path(spark, "arriving"), table(spark, sf, "documents").select("doc_id", "text")
    n = max(4, d.rdd.getNumPartitions())  # a file holds no more than a task of the scan reads
    d.repartition(n).write.parquet(source)
    d.where("doc_id % 2 = 0").repartition(n // 2).write.mode("append").parquet(source)
    measure = lambda b: b.select("doc_id", X.count_words(F.col("text")).alias("n_words"))
    path = fresh_path(spark, "measured")
    stream_scores(spark, source, d.schema, fresh_path(spark, "stream"), path, "doc_id", measure, files_per_batch=n * 3 // 4)
    return readers.read_completed(spark, path, "doc_id")


@query("manifest_counts", "SELECT 'documents' AS name, (SELECT count(*) FROM documents) AS rows UNION ALL SELECT 'labels', (SELECT count(*) FROM labels)")
def manifest_counts(spark, sf):
    m = writers.manifest({n: table(spark, sf, n) for n in ("documents", "labels")})
    return spark.createDataFrame([(n, v["rows"]) for n, v in m["tables"].items()], "name string, rows long")


@query("resumed_scoring", ORACLES["scored_with_fake"])
def resumed_scoring(spark, sf):
    """Scored in two runs, the second of which finds the first's rows in the checkpoint table."""
    path = fresh_path(spark, "scores")
    p = public(spark, sf).withColumnRenamed("block", "prompt")
    score = lambda d: S.score_verdicts(d, S.Deterministic, M.SYSTEM)
    run_pending(p.where("source_idx % 3 = 0"), path, "target_id", score)
    done = run_pending(p, path, "target_id", score)
    out = J.late_labels(done, views(spark, sf)["private"])
    return out.select("target_id", "predicted_verdict", "correct", F.round("gold_probability", 9).alias("gold_probability"))
