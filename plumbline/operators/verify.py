"""Are an answer's lines borne out by what they cite?"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.questions import content

_CITE = re.compile(r"\[(\d+)\]")
_NUMBER = re.compile(r"(?<![\w.])\d+(?:\.\d+)?")


@dataclass(frozen=True)
class Line:
    """A line of an answer that claims something, with the evidence that it cites."""

    text: str
    cites: tuple[int, ...]
    known: dict[int, str]

    @property
    def said(self) -> str:
        return " ".join(self.known[n] for n in self.cites if n in self.known)


def _uncited(x: Line, _: float) -> str:
    return "" if x.cites else "cites nothing"


def _unknown(x: Line, _: float) -> str:
    strange = [str(n) for n in x.cites if n not in x.known]
    return f"cites unknown evidence {', '.join(strange)}" if strange else ""


def _unborne(x: Line, _: float) -> str:
    missing = [n for n in _NUMBER.findall(x.text) if not re.search(rf"(?<![\w.]){re.escape(n)}(?!\w)", x.said)]
    return f"evidence lacks {', '.join(missing)}" if missing else ""


def _far(x: Line, least: float) -> str:
    mine = set(content(x.text))
    share = len(mine & set(content(_CITE.sub(" ", x.said)))) / len(mine) if mine else 1.0
    return "" if share >= least else f"evidence has {share:.0%} of its words"


#: What can be said against a claim; the first thing that is counts.
OBJECTIONS = [_uncited, _unknown, _unborne, _far]


def verify_answer(answer: str, evidence: list[dict], least: float = 0.5) -> dict:
    """Each line but blank ones, headers and model-derived ones (≈) is a claim. It is supported if it cites known evidence,
    all its numbers stand in the cited texts, and enough of its words do. Without evidence, an answer that cites nothing
    claims nothing."""
    known = {e["n"]: e["text"] for e in evidence}
    lines = [x for x in (line.strip(" -•\t") for line in answer.splitlines()) if x and not x.endswith(":")]
    if not known and not _CITE.search(answer):
        lines = []
    judged = []
    for text in (x for x in lines if x[0] != "≈"):
        line = Line(_CITE.sub("", text).strip(), tuple(map(int, _CITE.findall(text))), known)
        reason = next((r for object_to in OBJECTIONS if (r := object_to(line, least))), "")
        judged.append({"text": line.text, "cites": list(line.cites), "supported": not reason, "reason": reason})
    good, total = sum(c["supported"] for c in judged), len(judged)
    derived = sum(x[0] == "≈" for x in lines)
    return {
        "faithfulness": round(good / total, 3) if total else 1.0, "claims": judged, "derived_lines": derived,
        "supported": good, "total": total,
    }


def claims(answers: DataFrame, evidence: DataFrame, least: float = 0.5) -> DataFrame:
    """answers(aid, answer) and evidence(aid, n, text) -> aid, line_no, cites, overlap, missing (numbers not in the evidence),
    supported: a row for each claim."""
    lines = answers.select(
        "aid", F.posexplode(F.split("answer", "\n")).alias("line_no", "line"),
    ).withColumn("line", F.btrim("line", F.lit(" -•\t")))
    lines = lines.filter((F.col("line") != "") & ~F.col("line").endswith(":") & ~F.col("line").startswith("≈"))
    cites = F.transform(F.regexp_extract_all("line", F.lit(r"\[(\d+)\]"), 1), lambda n: n.cast("int"))
    lines = lines.select(
        "aid", "line_no", cites.alias("cites"), F.regexp_replace("line", r"\[\d+\]", "").alias("claim"),
    )
    cited = lines.select("aid", "line_no", F.explode("cites").alias("n")).join(evidence, ["aid", "n"])
    said = cited.groupBy("aid", "line_no").agg(
        F.array_join(F.collect_list("text"), " ").alias("said"), F.countDistinct("n").alias("known"),
    )
    words = lambda c: F.array_distinct(T.content_tokens(F.col(c)))
    nums = lambda c: F.regexp_extract_all(c, F.lit(r"(?<![\w.])\d+(?:\.\d+)?"), 0)
    met = T.once(
        lines.join(said, ["aid", "line_no"], "left"), mine=words("claim"), theirs=words("said"), numbers=nums("said"),
    )
    overlap = F.when(F.size("mine") == 0, 1.0).otherwise(F.size(F.array_intersect("mine", "theirs")) / F.size("mine"))
    missing = F.size(F.filter(nums("claim"), lambda n: ~F.coalesce(F.array_contains("numbers", n), F.lit(False))))
    known = (F.size("cites") > 0) & (F.coalesce("known", F.lit(0)) == F.size(F.array_distinct("cites")))
    rows = met.select(
        "aid", "line_no", "cites", overlap.alias("overlap"), missing.alias("missing"), known.alias("_known"),
    )
    holds = F.col("_known") & (F.col("missing") == 0) & (F.col("overlap") >= least)
    return rows.withColumn("supported", F.coalesce(holds, F.lit(False))).drop("_known")


def verify_batch(answers: DataFrame, evidence: DataFrame, least: float = 0.5) -> DataFrame:
    """aid, supported, total, faithfulness of each answer: what verify_answer gives, for whole tables."""
    got = claims(answers, evidence, least).groupBy("aid").agg(
        F.sum(F.col("supported").cast("int")).alias("supported"), F.count(F.lit(1)).alias("total"),
    )
    rows = answers.select("aid").join(got, "aid", "left").na.fill(0, ["supported", "total"])
    return rows.withColumn(
        "faithfulness", F.when(F.col("total") == 0, 1.0).otherwise(F.round(F.col("supported") / F.col("total"), 3)),
    )
