"""Personal data by weak supervision, with DataFrame functions only.

Base patterns find e-mail and network addresses, card and phone numbers. Looser patterns propose more spans. Every
candidate is voted on by labelers (strict form, gazetteers of endings, prefixes and area codes, words before it,
its edges, its length); expectation-maximisation estimates from the counts of vote patterns how far each
labeler can be trusted. The beliefs that follow train a logistic classifier that sees the span itself and its
surroundings (its length, make-up and neighbours, and what else its text holds) beside the votes. It judges every
candidate: looser spans are added where it is confident, and base spans, which stay, are named where it doubts them.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

KINDS = ["email", "ip", "card", "phone"]

#: The base patterns, in forms that find the same matches in linear time: a start inside a run of its own
#: characters can't succeed where the run's start failed, so only run starts (or ends of matches) are tried.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Looser forms: spelt-out at and dot, version 6 addresses, other separators, and numbers without a plus.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?[\[({](?:at|AT)[\])}]\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:\.|[\[({](?:dot|DOT)[\])}])\x20?[A-Za-z0-9-]{1,63}){1,5}",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9./_])[0-9]{4}([./_])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9./_])",
    "phone": r"(?<![0-9+().-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])",
}
#: What has to occur in a text before a pattern is tried on it.
HINT = {
    "email": "[@]|(?i:[\\[({]at[\\])}])", "ip": "[0-9]\\.[0-9]|[0-9A-Fa-f]:[0-9A-Fa-f]",
    "card": "[0-9][\\x20./_-]?[0-9][\\x20./_-]?[0-9][\\x20./_-]?[0-9]", "phone": "\\+[0-9]|[0-9][\\x20.-][0-9]{4}",
}

# Gazetteers and cue words, as regular expressions.
ENDINGS = r"(?i)\b(?:com|org|net|edu|gov|mil|int|info|biz|io|dev|app|ai|co|me|tv|eu|us|uk|de|fr|es|it|nl|be|ch|at|pl|cz|se|no|fi|dk|pt|ie|ru|ua|tr|in|cn|jp|kr|au|nz|br|mx|ar|cl|ca|za)$"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|3[068]|6011|65|35)"
CUES = {
    "email": r"(?i)(?:e-?mail|mail|contact|write|reach|correo|adresse|courriel|kontakt|@)[^A-Za-z0-9]*\S{0,12}\W*$",
    "ip": r"(?i)(?:\bip|address|host|server|client|from|peer|ping|dns|gateway|adresse|direcci.n)[^A-Za-z0-9]*\S{0,12}\W*$",
    "card": r"(?i)(?:card|visa|master|amex|credit|debit|payment|pan|carte|tarjeta|karte)[^A-Za-z0-9]*\S{0,12}\W*$",
    "phone": r"(?i)(?:phone|tel|call|fax|mobile|cell|whatsapp|t.l.phone|telefon|tel.fono|llam|anruf|appel)[^A-Za-z0-9]*\S{0,12}\W*$",
}
OTHER = r"(?i)(?:version|release|isbn|issn|doi|order|invoice|sku|section|figure|serial|part no|chapter|build|\bv)[^A-Za-z0-9]*$"
LABELERS = ["form", "gazetteer", "cue", "other", "edges", "length"]

_SPAN = "array<struct<start:int,v:string,before:string,after:string>>"
_CAND = "array<struct<kind:int,base:boolean,start:int,end:int,votes:string,seen:string>>"


#: Matches whose offsets are added up in one go; arrays grow by copying, so longer ones are made of such parts.
PART = 128


def _located(m: str, g: str) -> str:
    """Matches m with their offsets, from them and the gaps g around them."""
    step = f"named_struct('at', a.at + length({g}[i - 1]) + length({m}[i - 1]), 'out', concat(a.out, array(named_struct('start', a.at + length({g}[i - 1]), 'v', {m}[i - 1], 'before', right({g}[i - 1], 40), 'after', left({g}[i], 1)))))"
    before = " + ".join(f"aggregate(slice({x}, 1, c * {PART}), 0, (n, v) -> n + length(v))" for x in (m, g))
    part = f"aggregate(sequence(c * {PART} + 1, least(size({m}), (c + 1) * {PART})), named_struct('at', {before}, 'out', CAST(array() AS {_SPAN})), (a, i) -> {step}, a -> a.out)"
    return f"CASE WHEN size({m}) > 0 THEN flatten(transform(sequence(0, (size({m}) - 1) DIV {PART}), c -> {part})) ELSE CAST(array() AS {_SPAN}) END"


_DIGITS = "regexp_replace(x.v, '[^0-9]', '')"
_LUHN = f"aggregate(sequence(1, length({_DIGITS})), 0, (a, i) -> a + CASE WHEN i % 2 = 1 THEN CAST(substring({_DIGITS}, -i, 1) AS INT) ELSE CAST(substring({_DIGITS}, -i, 1) AS INT) * 2 - CASE WHEN substring({_DIGITS}, -i, 1) > '4' THEN 9 ELSE 0 END END) % 10 = 0"
_VALID = {
    "email": "true",
    "ip": "forall(split(x.v, '[.]'), p -> p rlike '^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$')",
    "card": f"length({_DIGITS}) BETWEEN 13 AND 19 AND {_LUHN}",
    "phone": f"length({_DIGITS}) BETWEEN 9 AND 15",
}


def _vote(yes: str, no: str = "false") -> str:
    return f"CASE WHEN {yes} THEN '1' WHEN {no} THEN '2' ELSE '0' END"


def _quoted(pattern: str) -> str:
    return "r'" + pattern.replace("'", "\\x27") + "'"


def _votes(kind: str, base: bool) -> str:
    """A digit for each labeler: 1 yes, 2 no, 0 abstains."""
    gazetteer = {
        "email": _vote(f"x.v rlike {_quoted(ENDINGS)}", "true"),
        "ip": _vote("NOT x.v rlike '^(?:0+|2[4-5][0-9])[.]'", "true"),
        "card": _vote(f"{_DIGITS} rlike '{ISSUERS}'", "true"),
        "phone": _vote(
            f"{_DIGITS} rlike '^(?:1?[2-9][0-9]{{2}}[2-9][0-9]{{6}}|[2-9][0-9]{{8,14}})$'",
            f"{_DIGITS} rlike '^0{{3}}'",
        ),
    }[kind]
    length = {
        "email": "length(x.v) BETWEEN 6 AND 80", "ip": "length(x.v) BETWEEN 7 AND 39",
        "card": f"length({_DIGITS}) BETWEEN 15 AND 16", "phone": f"length({_DIGITS}) BETWEEN 10 AND 13",
    }[kind]
    valid = "true" if base else {"email": "true", "ip": "true", "card": _LUHN, "phone": "true"}[kind]
    return "concat(" + ", ".join([
        _vote(valid if base else f"false AND {valid}", f"NOT ({valid})"),
        gazetteer,
        _vote(f"x.before rlike {_quoted(CUES[kind])}"),
        _vote("false", f"x.before rlike {_quoted(OTHER)}"),
        _vote(
            "(x.before = '' OR right(x.before, 1) rlike '[^A-Za-z0-9]') AND (x.after = '' OR x.after rlike '[^A-Za-z0-9]')",
            "true",
        ),
        _vote(length, "true"),
    ]) + ")"


#: What the classifier sees of a span, in order: each is one digit, so that spans that look alike can be counted.
SEEN = ["length", "digit share", "separators", "letters in upper case", "character before", "character after"]


def _binned(value: str, *edges: float) -> str:
    """SQL for the number of edges that a value reaches."""
    return " + ".join(f"CAST({value} >= {e} AS INT)" for e in edges)


def _kind_of(char: str) -> str:
    """SQL for what a character is: 0 none, 1 white space, 2 a letter or digit, 3 an opening or quoting mark, 4 anything else."""
    return f"CASE WHEN {char} = '' THEN 0 WHEN {char} rlike '\\\\s' THEN 1 WHEN {char} rlike '[\\\\p{{L}}0-9]' THEN 2 WHEN {char} rlike '[(<:=\"\\']' THEN 3 ELSE 4 END"


def _seen() -> str:
    digits, size = f"length({_DIGITS})", "length(x.v)"
    parts = [
        _binned(size, 10, 14, 18, 24, 40), _binned(f"{digits} / {size}", 0.05, 0.4, 0.7, 0.9), _binned(
            "length(regexp_replace(x.v, '[A-Za-z0-9]', ''))", 1, 2, 3, 5,
        ),
        "CASE WHEN x.v rlike '[A-Z]' THEN CASE WHEN x.v rlike '[a-z]' THEN 1 ELSE 2 END ELSE 0 END", _kind_of(
            "right(x.before, 1)"
        ), _kind_of("x.after"),
    ]
    return "concat(" + ", ".join(f"CAST({p} AS STRING)" for p in parts) + ")"


#: Base spans of a text, in their order, in runs that are skipped where a span lies outside all of one.
RUN = 64


def _apart(found: str) -> str:
    """SQL for the spans of found that are base ones or meet none of those: a looser span that meets a base one says
    nothing new. Base spans are sorted once and looked at in runs, so that long texts don't make all pairs."""
    base = f"array_sort(transform(filter({found}, x -> x.base), x -> named_struct('start', x.start, 'end', x.end)))"
    run = f"slice(b, i * {RUN} + 1, {RUN})"
    runs = f"transform(sequence(0, size(b) DIV {RUN}), i -> named_struct('low', array_min(transform({run}, y -> y.start)), 'high', array_max(transform({run}, y -> y.end)), 'spans', {run}))"
    meets = "exists(r, z -> z.low < x.end AND x.start < z.high AND exists(z.spans, y -> x.start < y.end AND y.start < x.end))"
    kept = f"filter({found}, x -> x.base OR NOT {meets})"
    # transform over one element names a value, so that it is made once and not for each span
    return f"transform(array({base}), b -> transform(array({runs}), r -> {kept})[0])[0]"


def candidates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id and found: every base and looser span with its votes, from one scan of the text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    df = docs.select(F.col(id_col).alias("doc_id"), text.alias("t"))
    cols = []
    for kind in KINDS:
        for tag, pattern in (("b", BASE[kind]), ("l", LOOSE[kind])):
            m, g = f"m_{tag}_{kind}", f"g_{tag}_{kind}"
            df = df.withColumn(m, F.when(F.col("t").rlike(HINT[kind]), F.regexp_extract_all("t", F.lit(pattern), 0)))
            df = df.withColumn(g, F.when(F.size(m) > 0, F.split("t", pattern, -1)))
            cols += [m, g]
    df = df.drop("t")
    parts = []
    for k, kind in enumerate(KINDS):
        for tag in "bl":
            valid = _VALID[kind] if tag == "b" else "true"
            made = f"named_struct('kind', {k}, 'base', {str(tag == 'b').lower()}, 'start', x.start, 'end', x.start + length(x.v), 'votes', {_votes(kind, tag == 'b')}, 'seen', {_seen()})"
            parts.append(
                f"transform(filter({_located(f'm_{tag}_{kind}', f'g_{tag}_{kind}')}, x -> {valid}), x -> {made})"
            )
    df = df.withColumn("found", F.expr(f"CAST(concat({', '.join(parts)}) AS {_CAND})"))
    return df.select("doc_id", F.expr(_apart("found")).alias("found"))


def reliabilities(counts: dict[str, int], rounds: int = 50) -> tuple[
    float, list[dict[str, list[float]]], dict[str, float]
]:
    """EM over counts of vote patterns: the share of true spans, each labeler's P(vote | false, true), and the
    belief for each pattern. Starts from the majority of votes."""
    belief = {v: min(0.95, max(0.05, 0.5 + 0.15 * (v.count("1") - v.count("2")))) for v in counts}
    share, tables = 0.5, []
    for _ in range(rounds):
        total = sum(counts.values())
        share = (sum(n * belief[v] for v, n in counts.items()) + 1) / (total + 2)
        tables = []
        for i in range(len(LABELERS)):
            seen = {c: [0.5, 0.5] for c in "012"}
            for v, n in counts.items():
                seen[v[i]][0] += n * (1 - belief[v])
                seen[v[i]][1] += n * belief[v]
            sums = [sum(x[z] for x in seen.values()) for z in (0, 1)]
            tables.append({c: [x[z] / sums[z] for z in (0, 1)] for c, x in seen.items()})
        for v in counts:
            odds = math.log(share / (1 - share)) + sum(
                math.log(tables[i][c][1] / tables[i][c][0]) for i, c in enumerate(v)
            )
            belief[v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return share, tables, belief


def patterns_of(found: DataFrame) -> list:
    """kind, votes, seen, crowd, n: how many candidates look alike in all that the classifier sees. There are 4 kinds, 729 votes
    and 7,500 looks at most, whatever the size of the corpus."""
    rows = found.select(F.explode("found").alias("x"), F.expr(_CROWD).alias("crowd"))
    return rows.groupBy("x.kind", "x.votes", "x.seen", "crowd").agg(F.count(F.lit(1)).alias("n")).collect()


#: What else a text holds: few or many other candidates.
_CROWD = f"CAST({_binned('size(found)', 2, 4, 10)} AS STRING)"


def features(votes: str, seen: str, crowd: str) -> list[str]:
    """Names of what holds of a candidate; abstentions say nothing."""
    return [
        "bias", *(f"v{i}{c}" for i, c in enumerate(votes) if c != "0"), *(f"s{i}{c}" for i, c in enumerate(seen)),
        f"c0{crowd}"
    ]


def classifier(rows: list[tuple[list[str], float, int]], rounds: int = 400, ridge: float = 1e-3) -> dict[str, float]:
    """Weights of a logistic model over features, from (features, belief, how many): gradient steps with momentum on the mean
    loss."""
    names = sorted({f for fs, _, _ in rows for f in fs})
    place = {f: i for i, f in enumerate(names)}
    x = np.zeros((len(rows), len(names)))
    for r, (fs, _, _) in enumerate(rows):
        x[r, [place[f] for f in fs]] = 1
    belief, n = np.array([b for _, b, _ in rows], float), np.array([c for _, _, c in rows], float)
    n /= max(1.0, n.sum())
    w, speed = np.zeros(len(names)), np.zeros(len(names))
    for _ in range(rounds if rows else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        speed = 0.9 * speed + x.T @ ((belief - p) * n) - ridge * w
        w += 0.5 * speed
    return {f: float(w[i]) for f, i in place.items()}


def trained(rows: list) -> list[dict[str, float]]:
    """The classifier's weights for each kind: votes give beliefs, beliefs train on all that is seen."""
    out = []
    for k in range(len(KINDS)):
        mine, counts = [r for r in rows if r["kind"] == k], defaultdict(int)
        for r in mine:
            counts[r["votes"]] += r["n"]
        belief = reliabilities(counts)[2] if counts else {}
        out.append(
            classifier([(features(r["votes"], r["seen"], r["crowd"]), belief[r["votes"]], r["n"]) for r in mine])
        )
    return out


def _log_odds(weights: list[dict[str, float]]) -> str:
    """SQL for the classifier's log odds that x is personal data."""
    cases = []
    for k, w in enumerate(weights):
        terms = [f"{w.get('bias', 0.0):.9f}D"]
        for f, value in sorted(w.items()):
            if f != "bias":
                of = {
                    "v": f"substring(x.votes, {int(f[1]) + 1}, 1)", "s": f"substring(x.seen, {int(f[1]) + 1}, 1)",
                    "c": _CROWD,
                }[f[0]]
                terms.append(f"CASE WHEN {of} = '{f[2:]}' THEN {value:.9f}D ELSE 0D END")
        cases.append(f"WHEN {k} THEN {' + '.join(terms)}")
    return f"(CASE x.kind {' '.join(cases)} END)"


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.9) -> DataFrame:
    """One row for each input row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, doubtful.

    Spans are kind:start:end in code points, the end exclusive, by kind (email, ip, card, phone) and start, joined
    by commas. The counts and base_sha256 are of the base spans; spans adds looser ones that the classifier gives
    probability `least` or more; doubtful holds the base spans that it gives 1 - `least` or less. A null text counts as empty and has none. Repeated rows give repeated results, ids
    are passed on as they are; other columns are ignored; an empty table gives an empty result.

    The texts are scanned once, into a table of candidates. Labelers are weighed on counts of vote patterns, of
    which there are 4 * 3^6 at most, and the classifier learns from counts of what candidates look like, which are bounded
    too, whatever the size of the corpus; only those counts reach the driver.
    """
    found = materialise(candidates(docs, id_col, text_col), "candidates")
    odds, edge = _log_odds(trained(patterns_of(found))), math.log(least / (1 - least))
    added = F.expr(f"filter(found, x -> x.base OR {odds} >= {edge:.9f}D)")
    doubted = F.expr(f"filter(found, x -> x.base AND {odds} <= {-edge:.9f}D)")
    base = found.select("doc_id", F.expr("filter(found, x -> x.base)").alias("b"), added.alias("a"), doubted.alias("d"))
    names = f"array({', '.join(repr(k) for k in KINDS)})"
    joined = lambda c: F.expr(
        f"array_join(transform(array_sort(transform({c}, x -> named_struct('kind', x.kind, 'start', x.start, 'end', x.end))), x -> concat_ws(':', {names}[x.kind], x.start, x.end)), ',')"
    )
    counts = [
        F.expr(f"CAST(size(filter(b, x -> x.kind = {k})) AS BIGINT)").alias(f"n_{kind}")
        for k, kind in enumerate(KINDS)
    ]
    return base.select(
        "doc_id", *counts, F.sha2(joined("b"), 256).alias("base_sha256"), joined("a").alias("spans"),
        joined("d").alias("doubtful"),
    )


def redact_pii(text: Column, spans: Column) -> Column:
    """text with each span (as find_pii writes them) replaced by its kind in brackets; overlapping ones by the first."""
    parsed = F.transform(
        F.filter(F.split(spans, ","), lambda s: s != ""),
        lambda s: F.struct(
            F.split(s, ":")[1].cast("int").alias("start"), F.split(s, ":")[2].cast("int").alias("end"),
            F.split(s, ":")[0].alias("kind"),
        ),
    )
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, x: Column) -> Column:
        ahead = x["start"] >= a["at"]
        return F.struct(
            F.when(ahead, x["end"]).otherwise(a["at"]).alias("at"),
            F.when(
                ahead,
                F.concat(
                    a["out"], F.substring(text, a["at"] + 1, x["start"] - a["at"]), F.lit("["), x["kind"], F.lit("]"),
                ),
            ).otherwise(a["out"]).alias("out"),
        )

    return F.aggregate(
        F.array_sort(parsed), zero, step,
        lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))),
    )
