"""Text normalisation, checks and templates as Column expressions."""

from __future__ import annotations

from collections.abc import Iterable
from functools import cache, reduce
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode-aware text tools see it: Java's ``\s`` alone lacks some of these.
WS = r"[\s\x1c-\x1f\x85\p{Z}]"
NOT_WS = r"[^\s\x1c-\x1f\x85\p{Z}]"


def collapse(c: Column) -> Column:
    """White-space runs become one blank, ends are stripped, null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), WS + "+", " "))


def collapse_falsy(c: Column, data_type: str) -> Column:
    """As ``collapse``, but numeric zero and false count as empty too."""
    if data_type == "boolean":
        return collapse(F.when(c, c.cast("string")))
    if data_type in ("tinyint", "smallint", "int", "bigint", "float", "double") or data_type.startswith("decimal"):
        return collapse(F.when(c != 0, c.cast("string")))
    return collapse(c)


def strip_ends(c: Column) -> Column:
    """Only the ends are stripped; null is empty."""
    return F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), f"^{WS}+|{WS}+$", "")


@cache
def _folds() -> tuple[str, str, dict[str, str]]:
    """(characters, what each folds to) of those that fold to one character, and those that fold to several."""
    one, several = {}, {}
    for n in chain(range(0xD800), range(0xE000, 0x110000)):
        c = chr(n)
        f = c.casefold()
        if f != c:
            (one if len(f) == 1 else several)[c] = f
    return "".join(one), "".join(one.values()), several


def casefold(c: Column) -> Column:
    """Full case folding as Unicode has it. One pass over the characters; a second one only over texts with a character that
    folds to several."""
    alike, to, several = _folds()
    t = F.translate(c, alike, to)
    known = F.expr("map(" + ", ".join(f"'{k}', '{v}'" for k, v in several.items()) + ")")
    wide = F.array_join(F.transform(F.split(t, ""), lambda x: F.coalesce(F.element_at(known, x), x)), "")
    return F.when(t.rlike("[" + "".join(several) + "]"), wide).otherwise(t)


def starts_with_any(c: Column, prefixes: Iterable[str]) -> Column:
    return reduce(lambda a, b: a | b, (c.startswith(p) for p in prefixes))


def matches_any(c: Column, patterns: Iterable[str]) -> Column:
    return c.rlike("(?iU)" + "|".join(f"(?:{p})" for p in patterns))


def count_words(c: Column) -> Column:
    return F.regexp_count(F.coalesce(c.cast("string"), F.lit("")), F.lit(NOT_WS + "+"))


#: The end of a sentence: a fixed pattern.
SENTENCE_END = r"""[.!?](?:["')\]]+)?(?:\s|$)"""


def count_sentences(c: Column) -> Column:
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(SENTENCE_END))


def padded_id(prefix: str, n: Column, rows: int, least: int = 6) -> Column:
    """prefix + zero-padded ordinal, as wide as the largest ordinal needs and ``least`` at least."""
    return F.format_string(f"{prefix}%0{max(least, len(str(max(rows - 1, 0))))}d", n)


def sha256(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def group_id(text: Column) -> Column:
    """16 hex digits that equal texts share, whatever their case and spacing."""
    return F.substring(sha256(casefold(collapse(text))), 1, 16)


def prompt_digest(system: str, prompt: Column) -> Column:
    return sha256(F.concat(F.lit(system + "\n"), prompt))


#: What is taken off generated texts: fixed values.
SKILL_HEADING = r"(?iU)^\s*(?:#{1,4}\s*)?(?:skill description|skills?)\s*:\s*"
QUOTED = r"""^(["'])(.*)\1$"""
THINKING = r"(?is)<think>.*?</think>"
SPECIAL = r"(?i)<\|[^>]+\|>|</?s>|<think>|</think>"
RATIONALE_HEADING = r"(?iU)^\s*(?:reasoning|rationale)\s*:\s*"


def clean_skill(c: Column) -> Column:
    """A leading heading goes, white space collapses, one pair of equal quotes around all goes."""
    t = strip_ends(c)
    t = F.regexp_replace(t, SKILL_HEADING, "")
    return collapse(F.regexp_replace(collapse(t), QUOTED, "$2"))


def skill_checks(c: Column, least: int = 12, most: int = 40) -> Column:
    n = count_words(c)
    return F.struct(c.startswith("Assess").alias("starts_with_assess"), (~c.contains("\n")).alias("single_line"), n.alias("word_count"), n.between(least, most).alias("word_count_in_range"))


def strip_artifacts(c: Column) -> Column:
    """Closed thinking blocks, then special tokens, then a leading heading go; white space collapses."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), THINKING, " ")
    t = F.regexp_replace(t, SPECIAL, " ")
    return collapse(F.regexp_replace(t, RATIONALE_HEADING, ""))


def cap_rationale(c: Column, max_words: int = 80, max_sentences: int = 4) -> Column:
    """struct(text, changed): the first whole sentences, then the first words.

    Text after the last whole sentence goes if there is one; cut words lose trailing ``,;:`` and gain a full stop.
    """
    t = collapse(c)
    found = F.regexp_extract_all(t, F.lit(r"(?s).*?[.!?](?:[\"')\]]+)?(?:\s|$)"), F.lit(0))
    bounded = F.when(F.size(found) > 0, F.array_join(F.transform(F.slice(found, 1, max_sentences), lambda s: strip_ends(s)), " ")).otherwise(t)
    words = F.split(bounded, " ")
    cut = F.regexp_replace(F.array_join(F.slice(words, 1, max_words), " "), "[ ,;:]+$", "")
    cut = F.when((cut != "") & ~F.substring(cut, -1, 1).isin(".", "!", "?"), F.concat(cut, F.lit("."))).otherwise(cut)
    out = collapse(F.when(F.size(words) > max_words, cut).otherwise(bounded))
    return F.struct(out.alias("text"), (out != t).alias("changed"))


def rationale_or(c: Column, fallback: str) -> Column:
    """struct(text, was_empty): an empty rationale becomes a fixed sentence, and is marked."""
    t = collapse(c)
    return F.struct(F.when(t == "", F.lit(fallback)).otherwise(t).alias("text"), (t == "").alias("was_empty"))


def or_raise(ok: Column, value: Column, message: str) -> Column:
    return F.when(ok, value).otherwise(F.raise_error(F.lit(message)))
