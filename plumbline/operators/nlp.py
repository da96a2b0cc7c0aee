"""Entities in clinical notes: a lexicon, with negation judged by the words before a mention."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import sentences
from ..functions.vocab import CONDITION_ALIASES, NEGATIONS, SYMPTOMS, TERMINATORS
from ..scratch import materialise
from .index import bounded

ENTITY = "struct<type:string,text:string,negated:boolean,sentence:string>"
#: A trigger counts if it is among so many words before the mention.
REACH = 6
KINDS = ("symptom", "condition", "allergen")


def lexicon() -> list[tuple[str, str, str]]:
    """(type, name, pattern) of all symptoms and conditions."""
    conditions = {
        c: "|".join(re.escape(n) for n in sorted({c.lower(), *names}, key=lambda n: (-len(n), n)))
        for c, names in CONDITION_ALIASES.items()
    }
    return [
        ("symptom", s, rf"\b(?:{'|'.join(p)})\b") for s, p in SYMPTOMS.items()
    ] + [("condition", c, rf"\b(?:{p})\b") for c, p in conditions.items()]


def literals(pattern: str) -> list[str]:
    """A string for each alternative of a lexicon's pattern without which it can't match: all up to its first special
    character, and what that makes optional."""
    out = []
    for part in pattern.removeprefix(r"\b(?:").removesuffix(r")\b").replace("\\", "").split("|"):
        plain = re.match(r"[^?*+{(\[.]*", part)[0]
        out.append(plain[:-1] if plain != part and part[len(plain)] in "?*{" else plain)
    return out


def mentioned(s: Column, low: Column, pattern: str) -> Column:
    """Whether a sentence (and itself in lower case) has a match: a pattern is tried only where one of its literals is."""
    some = [F.contains(low, F.lit(x)) for x in literals(pattern)]
    either = some[0]
    for c in some[1:]:
        either = either | c
    return either & s.rlike(f"(?i){pattern}")


def negated(before: Column) -> Column:
    """Whether what stands before a mention negates it: a trigger within REACH words, with no terminator after it. What has
    no trigger's first word anywhere isn't cut into words."""
    first = r"(?i)\b(" + "|".join(dict.fromkeys(t.split()[0] for t in NEGATIONS[3:-3].split("|"))) + r")\b"
    scope = F.regexp_replace(before, f"(?is)^.*{TERMINATORS}", "")
    words = F.filter(F.split(scope, r"\s+"), lambda w: w != "")
    near = F.array_join(
        F.slice(words, F.greatest(F.size(words) - (REACH - 1), F.lit(1)), REACH), " ",
    )
    return F.when(before.rlike(first), near.rlike(f"(?i){NEGATIONS}")).otherwise(F.lit(False))


def entities(text: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """Array of entities of some kinds: of each sentence and name the first mention, then the sentence's allergens."""
    wanted = [x for x in lexicon() if x[0] in kinds]
    pieces = {x for _, _, pattern in wanted for x in literals(pattern)}
    some = "|".join(re.escape(x) for x in sorted(pieces))

    def of(x: Column) -> Column:
        s, named = x["s"], []
        for kind, name, pattern in wanted:
            before = F.regexp_extract(s, f"(?is)^(.*?){pattern}", 1)
            entity = F.struct(
                F.lit(kind).alias("type"), F.lit(name).alias("text"), negated(before).alias("negated"),
                s.alias("sentence"),
            )
            named.append(F.when(mentioned(s, x["low"], pattern), entity))
        found = F.regexp_extract(s, r"(?i)allerg(?:y|ies)(?: status)?:\s*([A-Za-z ,]+?)(?:\.|$)", 1)
        items = F.filter(
            F.transform(F.split(found, ",| and "), lambda x: F.trim(x)),
            lambda x: (x != "") & ~F.lower(x).isin("none known", "none"),
        )
        allergens = F.transform(
            items,
            lambda x: F.struct(
                F.lit("allergen").alias("type"), x.alias("text"), F.lit(False).alias("negated"), s.alias("sentence"),
            ),
        )
        said = F.array_compact(F.array(*named)).cast(f"array<{ENTITY}>")
        said = F.when(x["low"].rlike(some), said).otherwise(F.array().cast(f"array<{ENTITY}>"))
        return F.concat(said, allergens.cast(f"array<{ENTITY}>")) if "allergen" in kinds else said

    both = F.transform(sentences(text), lambda s: F.struct(s.alias("s"), F.lower(s).alias("low")))
    return F.flatten(F.transform(both, of))


def entity_rows(texts: DataFrame, text: str, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """texts without the text's column, and e: a row for each entity of entities(). Equal sentences are searched once, in a
    table of their own, and joined to where they stand; the table is broadcast only where a count says that it is small."""
    said = texts.select(*[c for c in texts.columns if c != text], F.explode(sentences(F.col(text))).alias("_s"))
    found = said.select("_s").distinct().select("_s", F.explode(entities(F.col("_s"), kinds)).alias("e"))
    found = materialise(found, "entities")
    return said.join(bounded(found, found.count()), "_s").drop("_s")


def note_symptoms(notes: DataFrame, keys: list[str], date: str, text: str) -> DataFrame:
    """keys, name, negated, mentions, last: each symptom's mentions over the notes of a key. Sentences are exploded
    before they are searched, so that a pattern runs once a sentence."""
    rows = notes.select(*keys, date, F.explode(sentences(F.col(text))).alias("s")).withColumn("low", F.lower("s"))
    checks = []
    for kind, name, pattern in lexicon():
        if kind == "symptom":
            entity = F.struct(
                F.lit(name).alias("name"),
                negated(F.regexp_extract("s", f"(?is)^(.*?){pattern}", 1)).alias("negated"),
            )
            checks.append(F.when(mentioned(F.col("s"), F.col("low"), pattern), entity))
    hits = rows.select(*keys, date, F.explode(F.array_compact(F.array(*checks))).alias("e"))
    return hits.groupBy(*keys, "e.name", "e.negated").agg(
        F.count(F.lit(1)).alias("mentions"), F.max(date).alias("last"),
    )
