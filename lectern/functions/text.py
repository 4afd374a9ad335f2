"""Text expressions. All of them stay inside the JVM and touch one row at a time."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern import fixed

# Unicode-aware white space, with the separator controls that Python's split() also uses.
SPACE = r"(?U)[\s\x1c-\x1f]+"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, also where it is used several times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def collapse_whitespace(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACE, " "))


def whitespace_tokens(text: Column) -> Column:
    """Tokens between white space; blank or null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda t: t != "")


def blank(text: Column) -> Column:
    return F.coalesce(collapse_whitespace(text), F.lit("")) == ""


def token_count(text: Column, method: str = "whitespace") -> Column:
    if method == "character":
        return F.coalesce(F.length(text), F.lit(0))
    if method != "whitespace":
        raise ValueError(f"unknown token method {method!r}")
    return F.size(whitespace_tokens(text))


def truncate(text: Column, n: int) -> Column:
    """The text itself within the budget, else its first ``n`` tokens."""
    return bind(
        whitespace_tokens(text),
        lambda tokens: F.when(F.size(tokens) <= n, text).otherwise(F.array_join(F.slice(tokens, 1, n), " ")),
    )


# What a text must contain for a pattern to match; a cheap test that spares the search.
_PII_GUARDS = {
    "email": lambda text: F.contains(text, F.lit("@")),
    "phone": lambda text: F.rlike(text, F.lit(r"(?U)\d\d")),
    "national_id": lambda text: F.rlike(text, F.lit(r"(?U)\d{8}")),
    "iban": lambda text: F.rlike(text, F.lit(r"(?U)[A-Z]{2}\d{2}[A-Z0-9]{11}")),
}


def pii_types(types: Sequence[str] | None) -> list[str]:
    return list(fixed.PII_PATTERNS) if types is None else [t for t in types if t in fixed.PII_PATTERNS]


def mask_one(text: Column, kind: str) -> Column:
    masked = F.regexp_replace(text, "(?U)" + fixed.PII_PATTERNS[kind], fixed.PII_REPLACEMENTS[kind])
    return F.when(_PII_GUARDS[kind](text), masked).otherwise(text)


def pii_hits(text: Column, kind: str) -> Column:
    return F.regexp_count(text, F.lit("(?U)" + fixed.PII_PATTERNS[kind]))


def mask_pii(text: Column, types: Sequence[str] | None = None) -> Column:
    def step(kind: str) -> Callable[[Column], Column]:
        return lambda t: mask_one(t, kind)

    for kind in pii_types(types):
        text = bind(text, step(kind))
    return text


def first_sentence_summary(text: Column, max_length: int = fixed.SUMMARY_LENGTH) -> Column:
    """First sentence and a full stop, or its first characters and an ellipsis."""
    return bind(
        strip(F.get(F.split(strip(text), r"(?U)[.!?]+\s+", 2), F.lit(0))),
        lambda first: F.when(F.length(first) <= max_length, F.concat(first, F.lit("."))).otherwise(
            F.concat(F.substring(first, 1, max_length), F.lit("..."))
        ),
    )


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def sentences(text: Column) -> Column:
    """Non-blank stripped sentences, split after sentence marks followed by space."""
    parts = F.transform(F.split(strip(text), r"(?U)[.!?]+\s+"), strip)
    return F.filter(parts, lambda s: s != "")


def last_items(items: Column, n: int) -> Column:
    return F.slice(items, F.greatest(F.size(items) - n, F.lit(0)) + 1, F.lit(n))


def last_sentences(text: Column, n: int = 3) -> Column:
    return bind(
        bind(sentences(text), lambda found: last_items(found, n)),
        lambda kept: F.when(F.size(kept) > 0, F.concat(F.array_join(kept, ". "), F.lit("."))).otherwise(F.lit("")),
    )


def _language_score(tokens: Column, lowered: Column, lang: str, rank: int) -> Column:
    score = F.size(F.filter(tokens, lambda t: t.isin(sorted(set(fixed.LANGUAGE_WORDS[lang]))))).cast("double")
    letters = fixed.LANGUAGE_LETTERS[lang]
    if letters:
        marked = F.length(lowered) - F.length(F.translate(lowered, letters, ""))
        score = score + F.lit(0.5) * marked
    # Ties go to the language listed first.
    return F.struct(score.alias("score"), F.lit(-rank).alias("order"), F.lit(lang).alias("lang"))


def language(text: Column) -> Column:
    """Best-scoring language by function words and marked letters; blank text is ``unknown``.

    Arabic is decided by its share of letters. No word list is joined: each list is a
    literal set, so scoring needs neither a shuffle nor an exploded token table.
    """

    def decide(source: Column) -> Column:
        lowered = source["lowered"]
        scores = [
            _language_score(source["tokens"], lowered, lang, rank)
            for rank, lang in enumerate(fixed.LANGUAGE_WORDS)
        ]
        letters = F.length(lowered) - F.length(F.regexp_replace(lowered, r"\p{L}+", ""))
        arabic = F.length(lowered) - F.length(F.regexp_replace(lowered, r"\p{IsArabic}+", ""))
        return F.struct(
            F.array_max(F.array(*scores)).alias("best"), letters.alias("letters"), arabic.alias("arabic")
        )

    def tokenised(lowered: Column) -> Column:
        known = sorted({w for words in fixed.LANGUAGE_WORDS.values() for w in words})
        # One pass keeps the function words of any language; the lists then see only those.
        words = F.filter(F.split(lowered, r"[^\p{L}]+"), lambda t: t.isin(known))
        return F.struct(lowered.alias("lowered"), words.alias("tokens"))

    evidence = bind(bind(F.lower(F.coalesce(text, F.lit(""))), tokenised), decide)
    return bind(
        evidence,
        lambda e: F.when(e["letters"] == 0, F.lit("unknown"))
        .when(e["arabic"] * 2 > e["letters"], F.lit("ar"))
        .when(e["best"]["score"] > 0, e["best"]["lang"])
        .otherwise(F.lit("unknown")),
    )


def intent_scores(text: Column, rules: dict[str, Sequence[str]] | None = None) -> dict[str, Column]:
    """Share of matched patterns per intent. Patterns are literals, compiled once per task."""
    lowered = F.lower(text)
    scores = {}
    for intent, patterns in (rules or fixed.INTENT_PATTERNS).items():
        hits = [F.rlike(lowered, F.lit("(?iuU)" + p)).cast("int") for p in patterns]
        total = hits[0]
        for hit in hits[1:]:
            total = total + hit
        scores[intent] = total.cast("double") / len(patterns)
    return scores


def best_intent(text: Column, rules=None, threshold: float = 0.5) -> Column:
    """struct(intent, intent_confidence): best score, first in order on ties, ``other`` when low."""
    ranked = F.array_max(
        F.array(
            *[
                F.struct(score.alias("score"), F.lit(-rank).alias("order"), F.lit(intent).alias("intent"))
                for rank, (intent, score) in enumerate(intent_scores(text, rules).items())
            ]
        )
    )
    empty = F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("order"), F.lit("other").alias("intent"))
    return bind(
        F.when(blank(text), empty).otherwise(ranked),
        lambda r: F.struct(
            F.when(r["score"] < threshold, F.lit("other")).otherwise(r["intent"]).alias("intent"),
            r["score"].alias("intent_confidence"),
        ),
    )
