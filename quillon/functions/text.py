"""Text functions as Spark expressions: normalization, tokens, overlap, parsing, templates."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from quillon.functions.bind import let

ABSTAIN = "UNKNOWN"
#: Characters that folding changes in ways ``lower`` does not: below U+0250 by list, from there on all but punctuation.
_ODD = "[ª¨¯²³´µ¸¹º¼½¾ĲĳĿŀŉſǄ-ǌǰ-ǳ\u001c-\u001f]|[^\\x{0000}-\\x{024f}\\p{P}]"


def _after_folding(x: Column) -> Column:
    x = F.regexp_replace(x, r"\p{P}", "")
    x = F.regexp_replace(x, r"(?U)\b(a|an|the)\b", " ")
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def _fold(text: str) -> str:
    plain = "".join(c for c in unicodedata.normalize("NFKC", text).casefold() if not unicodedata.category(c).startswith("P"))
    return " ".join(re.sub(r"\b(a|an|the)\b", " ", plain).split())


@F.pandas_udf(StringType())
def _exact(texts: pd.Series) -> pd.Series:
    return texts.map(_fold, na_action="ignore")


@F.pandas_udf(ArrayType(StringType()))
def _exact_all(lists: pd.Series) -> pd.Series:
    return lists.map(lambda texts: [None if t is None else _fold(t) for t in texts], na_action="ignore")


def _native(text: Column) -> Column:
    return _after_folding(F.replace(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ")))


def normalize(text: Column | str) -> Column:
    """Fold case and compatibility forms, drop punctuation and articles, collapse white space.

    Runs in the JVM; only rows that hold characters whose compatibility form or
    case folding may differ from ``lower`` are folded by an Arrow function. Of
    arrays take ``normalize_all``: a lambda cannot call Python.
    """
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(_exact(F.when(text.rlike(_ODD), text)), _native(text))


def normalize_all(texts: Column) -> Column:
    """``normalize`` of every element of an array."""
    odd = F.exists(texts, lambda t: F.coalesce(t.rlike(_ODD), F.lit(False)))
    return F.coalesce(_exact_all(F.when(odd, texts)), F.transform(texts, _native))


def tokens(text: Column | str) -> Column:
    return split_tokens(normalize(text))


def split_tokens(normalized: Column) -> Column:
    """Tokens of an already normalized text; none for an empty one."""
    return F.filter(F.split(normalized, " "), lambda t: t != "")


def normalize_spaced(text: Column) -> Column:
    """The audit's normalization: punctuation becomes a space instead of vanishing."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"(?U)[^\w\s]", " "), r"(?U)\s+", " "))


def exact_match(answer: Column, aliases: Column) -> Column:
    """Normalized equality with any alias; an empty answer never matches."""
    both = F.struct(normalize(answer).alias("mine"), normalize_all(aliases).alias("gold"))
    return let(both, lambda b: (b["mine"] != "") & F.exists(b["gold"], lambda a: a == b["mine"]))


def is_abstention(answer: Column, abstain: str = ABSTAIN) -> Column:
    return normalize(answer) == F.lit(_fold(abstain))


def first_line(text: Column) -> Column:
    """First line that is not blank, trimmed; empty if there is none."""
    lines = F.filter(F.split(text, r"\R"), lambda x: F.trim(x) != "")
    return F.coalesce(F.trim(F.try_element_at(lines, F.lit(1))), F.when(text.isNotNull(), F.lit("")))


def strip_answer_prefix(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), r"(?iu)^(answer:|a:|the answer is)\s*", "")


def clean_answer(text: Column, abstain: str = ABSTAIN) -> Column:
    """First line without an answer prefix; an abstention in its canonical spelling."""
    plain = F.trim(strip_answer_prefix(first_line(text)))
    return F.when(is_abstention(plain, abstain), F.lit(abstain)).otherwise(plain)


def _numbered(tokens: Column) -> Column:
    """Tokens with the number of the occurrence, so that equal tokens of a text differ and sets of them are multisets."""
    return let(F.array_sort(tokens), lambda s: F.transform(s, lambda t, i: F.concat(t, F.lit(" "), (i - F.array_position(s, t)).cast("string"))))


def _overlap_f1(a: Column, b: Column) -> Column:
    both = F.size(a) + F.size(b)
    return F.when(both == 0, F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(2.0 * F.size(F.array_intersect(a, b)) / both)


def token_f1(a: Column, b: Column) -> Column:
    """F1 of two token arrays as multisets; two empty ones agree, one empty one does not."""
    return let(F.struct(_numbered(a).alias("a"), _numbered(b).alias("b")), lambda s: _overlap_f1(s["a"], s["b"]))


def mean_pairwise_f1(texts: Column) -> Column:
    """Mean token F1 over the unordered pairs of an array of normalized texts; 1 below two texts."""
    n = F.size(texts)

    def pairs(parts: Column) -> Column:
        scores = lambda i: F.transform(F.sequence(i + 1, n - 1), lambda j: _overlap_f1(F.get(parts, i), F.get(parts, j)))
        return F.flatten(F.transform(F.sequence(F.lit(0), n - 2), scores))

    total = F.aggregate(let(F.transform(texts, lambda t: _numbered(split_tokens(t))), pairs), F.lit(0.0), lambda s, x: s + x)
    return F.when(n < 2, F.lit(1.0)).otherwise(total / (n * (n - 1) / 2))


def count_distinct(normalized: Column) -> Column:
    return F.size(F.array_distinct(normalized))


def clean_aliases(aliases: Column) -> Column:
    """Trimmed, not blank, each once, in order."""
    return F.array_distinct(F.filter(F.transform(aliases, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")))


def contains_run(normalized: Column, part: Column) -> Column:
    """Whether the tokens of ``part`` stand side by side in ``normalized``; an empty part is in nothing."""
    return (part != "") & F.contains(F.concat(F.lit(" "), normalized, F.lit(" ")), F.concat(F.lit(" "), part, F.lit(" ")))


def first_run(normalized: Column, part: Column) -> Column:
    """Token index at which ``part`` first stands in ``normalized``, -1 if it does not."""
    padded, wanted = F.concat(F.lit(" "), normalized, F.lit(" ")), F.concat(F.lit(" "), part, F.lit(" "))
    head = F.substring(padded, F.lit(1), F.position(wanted, padded))
    return F.when(contains_run(normalized, part), F.size(split_tokens(head))).otherwise(F.lit(-1))


def covered(token: Column, question: Column) -> Column:
    """Whether a token is in the question's tokens, as it is or less one final s."""
    stem = F.substring(token, F.lit(1), F.length(token) - 1)
    return F.array_contains(question, token) | ((F.length(token) > 1) & token.endswith("s") & F.array_contains(question, stem))


def parse_verdict(reply: Column) -> Column:
    """The verdict a normalized reply begins with, or null."""
    return F.nullif(F.regexp_extract(normalize(reply), r"^(incorrect|correct|ambiguous)\b", 1), F.lit(""))


def parse_confidence(reply: Column, most: int = 100) -> Column:
    """A bare integer of at most three digits, a percent sign allowed, as a share of ``most``; else null."""
    digits = F.regexp_extract(reply, r"(?U)^\s*(\d{1,3})\s*%?\s*$", 1)
    value = digits.try_cast("int")
    return F.when((value >= 0) & (value <= most), value / F.lit(float(most)))


def parse_alias_json(raw: Column, fallback: Column) -> Column:
    """A JSON list of strings; a JSON scalar is a list of one; broken JSON falls back."""
    whole = F.from_json(raw, "array<string>")
    scalar = F.get_json_object(F.concat(F.lit('{"x":'), raw, F.lit("}")), "$.x")
    parsed = F.coalesce(F.when(~F.trim(raw).startswith("["), F.when(scalar.isNotNull(), F.array(scalar))), whole, F.array().cast("array<string>"))
    return clean_aliases(F.concat(F.array(fallback), parsed))


def struct_aliases(answer: Column) -> Column:
    """Value, aliases and normalized aliases of an answer struct in one list."""
    none = F.array().cast("array<string>")
    return clean_aliases(F.concat(F.array(answer["value"]), F.coalesce(answer["aliases"], none), F.coalesce(answer["normalized_aliases"], none)))


def gold_in_question(question: Column, aliases: Column) -> Column:
    """Leakage: an alias stands, token by token, in the question."""
    both = F.struct(normalize(question).alias("asked"), normalize_all(aliases).alias("gold"))
    return let(both, lambda b: F.exists(b["gold"], lambda part: contains_run(b["asked"], part)))


def spans_granularity(aliases: Column, gap: int = 2) -> Column:
    """Whether any two aliases differ by more than ``gap`` tokens or one holds the other."""
    size = lambda x: F.size(F.filter(F.split(x, " "), lambda t: t != ""))
    apart = lambda a, b: (a != b) & ((size(a) - size(b) > gap) | contains_run(a, b))
    return let(F.transform(aliases, normalize_spaced), lambda plain: F.exists(plain, lambda a: F.exists(plain, lambda b: apart(a, b))))


def inverse_subject(question: Column) -> Column:
    """X of "what is X the capital of?", or null."""
    return F.nullif(F.regexp_extract(question, r"(?i)^\s*what\s+is\s+(.+?)\s+the\s+capital\s+of\s*\??\s*$", 1), F.lit(""))


def echoes(answer: Column, subject: Column) -> Column:
    """exact, contained or none: how an answer repeats the question's subject."""
    a, s = normalize_spaced(answer), normalize_spaced(subject)
    return F.when((a == s) & (s != ""), "exact").when(contains_run(a, s) | contains_run(s, a), "contained").otherwise("none")


def render_answers(aliases: Column) -> Column:
    return F.concat_ws(" | ", aliases)


def render(template: str, **values: Column) -> Column:
    """Fill ``{name}`` slots of a fixed template; an empty answer shows as (empty)."""
    parts = re.split(r"\{(\w+)\}", template)
    pieces = [F.lit(p) if i % 2 == 0 else F.when(F.trim(values[p]) == "", F.lit("(empty)")).otherwise(values[p]) for i, p in enumerate(parts)]
    return F.concat(*pieces)


def few_shot_prefix(pairs: list[tuple[str, str]], template: str) -> str:
    return "".join(f"{template.format(question=q)} {a}\n\n" for q, a in pairs)
