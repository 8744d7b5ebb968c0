"""Recorded answers of a model, and the JSON object in an answer's text."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _valid(c: Column) -> Column:
    return F.when(F.try_parse_json(c).isNotNull(), c)


def json_object(c: Column) -> Column:
    """The text of the first fenced block if it is JSON, else from the first { to the last } if that is, else null."""
    fenced = F.trim(F.regexp_extract(c, r"(?s)```(?:json)?\s*(.*?)```", 1), F.lit(" \t\r\n"))
    has_fence = F.rlike(c, F.lit(r"(?s)```(?:json)?\s*.*?```"))
    start, last = F.instr(c, "{"), F.length(c) - F.instr(F.reverse(c), "}") + 1
    braces = F.when((start > 0) & F.contains(c, F.lit("}")) & (last > start), F.substring(c, start, last - start + 1))
    return F.coalesce(F.when(has_fence & (fenced != ""), _valid(fenced)), _valid(braces))


def ask(requests: DataFrame, call: Callable[[str], str]) -> DataFrame:
    """Answers of an injected callable, batch by batch; ``requests`` holds key and prompt. Failures give a null answer."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            answers = []
            for prompt in part["prompt"]:
                try:
                    answers.append(call(prompt))
                except Exception:  # a failed call must not end the run; the pair is told apart by its null
                    answers.append(None)
            yield pd.DataFrame({"key": part["key"], "raw_text": answers})

    return requests.select("key", "prompt").mapInPandas(run, "key string, raw_text string")
