"""Label-blind routing of cases into two formats by the shape of their texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.functions.text import casefold, collapse, matches_any, starts_with_any

#: Openings and patterns of the signals: fixed values.
REQUEST_PREFIXES = (
    "aren't you supposed to",
    "are you supposed to",
    "weren't you supposed to",
    "were you supposed to",
    "could you",
    "can you",
    "would you",
    "will you",
    "couldn't you",
    "can't you",
    "don't you need to",
    "do you need to",
    "go ",
)
REQUEST_RESPONSE = (r"^no\b", r"^but\b")
DUTY_RESPONSE = (r"^so\s+i\s+should\b", r"^i\s+should\b", r"^so\s+i\s+ought\s+to\b", r"^therefore\s+i\s+should\b")
DUTY_SCENARIO = (r"^i\s+am\b", r"^i['’]m\b", r"^i\s+work\b", r"^i\s+serve\b", r"^as\s+(?:an?|the)\b", r"^my\s+(?:job|role|position|profession)\b")

FORMATS = ("request", "duty_role")


def signals(scenario: Column, response: Column, fold: bool = False) -> list[Column]:
    """The four signals of cleaned texts: request response, duty response, request scenario, duty scenario.

    ``fold`` compares by case folding instead of lower case.
    """
    key = casefold(scenario) if fold else F.lower(scenario)
    return [
        matches_any(response, REQUEST_RESPONSE),
        matches_any(response, DUTY_RESPONSE),
        scenario.endswith("?") | starts_with_any(key, REQUEST_PREFIXES),
        matches_any(scenario, DUTY_SCENARIO),
    ]


#: The outcome by what the response signals (nothing, request, duty, both: rows) and what the scenario does (likewise:
#: columns): fixed values, as are the outcomes' names.
TRUTH = (
    (7, 4, 5, 6),
    (3, 3, 2, 3),
    (1, 0, 1, 1),
    (7, 4, 5, 6),
)
OUTCOMES = [
    ("ambiguous", "duty_role_response_conflicts_with_request_scenario"),
    ("duty_role", "explicit_so_i_should_response"),
    ("request", "explicit_no_or_but_response_with_declarative_scenario"),
    ("request", "explicit_no_or_but_response"),
    ("request", "request_shaped_scenario"),
    ("duty_role", "duty_or_role_shaped_scenario"),
    ("ambiguous", "scenario_has_both_request_and_duty_role_signals"),
    ("ambiguous", "no_supported_textual_routing_rule"),
]
#: The second router's: same formats, fewer reasons.
FOLDED_OUTCOMES = [
    ("ambiguous", "duty_response_conflicts_with_request_scenario"),
    ("duty_role", "explicit_duty_response"),
    ("request", "explicit_no_or_but_response"),
    ("request", "explicit_no_or_but_response"),
    ("request", "request_shaped_scenario"),
    ("duty_role", "duty_or_role_shaped_scenario"),
    ("ambiguous", "no_unique_supported_route"),
    ("ambiguous", "no_unique_supported_route"),
]


def _route(scenario: Column, response: Column, outcomes: list[tuple[str, str]], fold: bool) -> Column:
    # One number of the four signals looks the outcome up, so that each signal stands in the plan once.
    code = sum((F.when(s, 1 << k).otherwise(0) for k, s in enumerate(signals(scenario, response, fold))), F.lit(0))
    rows = (outcomes[TRUTH[c & 3][c >> 2]] for c in range(16))
    return F.get(F.array(*(F.struct(F.lit(f).alias("input_format"), F.lit(r).alias("routing_reason")) for f, r in rows)), code)


def route(scenario: Column, response: Column, cleaned: bool = False) -> Column:
    """struct(input_format, routing_reason) of two texts, which are cleaned unless they are already."""
    s, r = (scenario, response) if cleaned else (collapse(scenario), collapse(response))
    return _route(s, r, OUTCOMES, False)


def route_folded(scenario: Column, response: Column, cleaned: bool = False) -> Column:
    s, r = (scenario, response) if cleaned else (collapse(scenario), collapse(response))
    return _route(s, r, FOLDED_OUTCOMES, True)


def routed(cases: DataFrame, router=route) -> DataFrame:
    """``cases`` (scenario, excuse) cleaned and routed."""
    c = cases.withColumn("scenario", collapse(F.col("scenario"))).withColumn("excuse", collapse(F.col("excuse")))
    c = c.withColumn("_r", router(F.col("scenario"), F.col("excuse"), True))
    return c.withColumn("input_format", F.col("_r.input_format")).withColumn("routing_reason", F.col("_r.routing_reason")).drop("_r")


PUBLIC = ("target_id", "source_idx", "input_format", "scenario", "excuse")


def split_views(routed_cases: DataFrame) -> dict[str, DataFrame]:
    """Public rows by format, private labels of all rows, audit, ambiguous rows; public views hold no label."""
    label = F.col("label").alias("gold_verdict")
    return {
        **{f: routed_cases.where(F.col("input_format") == f).select(*PUBLIC) for f in FORMATS},
        "ambiguous": routed_cases.where(F.col("input_format") == "ambiguous").select(*PUBLIC, "routing_reason"),
        "private": routed_cases.select("target_id", "source_idx", "input_format", label),
        "audit": routed_cases.select(*PUBLIC, "routing_reason"),
    }
