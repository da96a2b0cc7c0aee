"""Text expressions: tokens, synonyms, n-grams, coverage. All of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vocab import EXTRA_STOP, STOP, SYNONYMS


def strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with more columns, each computed once a row however often it is used: the optimiser doesn't fold an expression
    through the one-element generator."""
    made = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select("*", F.explode(F.array(made)).alias("_once")).select(
        *[F.col(f"`{c}`") for c in df.columns], "_once.*",
    )


def tokens(text: Column) -> Column:
    """Lower-case runs of letters, digits and dots, without dots at their ends, without stop words; in order."""
    raw = F.transform(
        F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9.]+"), 0),
        lambda t: F.btrim(t, F.lit(".")),
    )
    return F.filter(raw, lambda t: (t != "") & ~t.isin(STOP))


def content_tokens(text: Column) -> Column:
    return F.filter(tokens(text), lambda t: ~t.isin(EXTRA_STOP))


def synonyms() -> Column:
    """The synonym table as a map literal."""
    return F.create_map(*[x for k, v in SYNONYMS.items() for x in (F.lit(k), strings(v))])


def related(term: Column) -> Column:
    return F.coalesce(F.try_element_at(synonyms(), term), F.array().cast("array<string>"))


def expanded(toks: Column) -> Column:
    """Tokens, then all their synonyms; repeats stay."""
    return F.concat(toks, F.flatten(F.transform(toks, related)))


def bigrams(toks: Column, between: str = "_") -> Column:
    n = F.size(toks)
    pairs = F.zip_with(F.slice(toks, 1, n - 1), F.slice(toks, 2, n - 1), lambda a, b: F.concat_ws(between, a, b))
    return F.when(n > 1, pairs).otherwise(F.array().cast("array<string>"))


def features(toks: Column) -> Column:
    """Unigrams and bigrams."""
    return F.concat(toks, bigrams(toks))


def covered(terms: Column, have: Column) -> Column:
    """The terms of which they or a synonym are in have."""
    return F.filter(terms, lambda t: F.array_contains(have, t) | F.arrays_overlap(related(t), have))


def coverage(terms: Column, have: Column, of_none: float) -> Column:
    """The share of distinct terms that have covers; of_none where there are no terms. Both should be columns, not
    expressions: have is looked at once a term."""
    return F.when(F.size(terms) == 0, F.lit(of_none)).otherwise(F.size(covered(terms, have)) / F.size(terms))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v,
    )


def cosine(a: Column, b: Column) -> Column:
    """Cosine; the norm of a zero vector counts as 1."""
    norm = lambda v: F.coalesce(F.nullif(F.sqrt(dot(v, v)), F.lit(0.0)), F.lit(1.0))
    return dot(a, b) / (norm(a) * norm(b))


def sentences(text: Column) -> Column:
    return F.filter(
        F.transform(F.split(F.coalesce(text, F.lit("")), r"(?<=[.;])\s+", -1), lambda s: F.trim(s)),
        lambda s: s != "",
    )
