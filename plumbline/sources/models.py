"""A language model behind HTTP, as a source of answers and passages. It may fail at any time: then nothing comes back,
and whoever asked has another way."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Path, and seconds allowed for a passage and an answer.
PATH, PASSAGE_S, ANSWER_S = "/api/generate", 30, 60
# End of the fixed values.


def post(url: str, body: dict, timeout: float) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"})
    with urllib.request.urlopen(request, timeout=timeout) as reply:
        return json.load(reply)


class HttpModel:
    """One prompt in, one text out; None where the service fails or says nothing."""

    def __init__(self, url: str, model: str, send: Callable[[str, dict, float], dict] = post):
        self.url, self.model, self.send = url.rstrip("/") + PATH, model, send

    def _ask(self, prompt: str, timeout: float) -> str | None:
        try:
            said = self.send(
                self.url, {"model": self.model, "prompt": prompt, "stream": False}, timeout,
            ).get("response")
        except (OSError, ValueError, AttributeError, urllib.error.URLError):
            return None
        return said.strip() or None if isinstance(said, str) else None

    def answer(self, question: str, hits: list) -> str | None:
        """An answer from numbered evidence only, with citations."""
        if not hits:
            return None
        shown = "\n".join(f"[{n}] {h.chunk.text}" for n, h in enumerate(hits, 1))
        return self._ask(
            f"Below are numbered extracts of a medical record.\n{shown}\n\nUse nothing else. Put the number of each extract you rely on in brackets, as in [1]. If they don't tell, say that. Don't advise on treatment.\nQuestion: {question}",
            ANSWER_S,
        )

    def passage(self, question: str) -> str | None:
        """What a record might say that answers the question, in a sentence or two."""
        return self._ask(
            f"Write one or two sentences as they could stand in a medical record that answers this: {question}",
            PASSAGE_S,
        )


def generated(prompts: DataFrame, prompt_col: str, model: HttpModel, name: str = "response") -> DataFrame:
    """prompts with the model's reply to each (null where it failed), asked from the executors, a batch a request loop."""
    rows = prompts.drop(name) if name in prompts.columns and name != prompt_col else prompts

    def run(batches):
        for frame in batches:
            yield frame.assign(**{name: [model._ask(p, ANSWER_S) if p else None for p in frame[prompt_col]]})

    return rows.mapInPandas(run, rows.withColumn(name, F.lit(None).cast("string")).schema)
