"""Language-model calls as an external, replayable function.

A prompt table is answered by joining recorded responses; only prompts without one go to a responder, a callable
that the caller provides.  Nothing here opens a connection.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Parts of messages that mark errors worth another try.
TRANSIENT = ("429", "502", "503", "504", "timeout", "econnreset", "rate limit", "overloaded")


def prompt_key(model: Column, system: Column, prompt: Column) -> Column:
    """What a recorded response is found by."""
    return F.sha2(F.concat_ws("\u0001", model, system, prompt), 256)


def replay(prompts: DataFrame, log: DataFrame) -> DataFrame:
    """Prompts (with ``prompt_key``) with their recorded ``content``; null where none is recorded."""
    latest = log.groupBy("prompt_key").agg(F.max_by("content", "ord").alias("content"))
    return prompts.join(latest, "prompt_key", "left")


def replayer(log: DataFrame, model: str = "") -> Callable[[DataFrame, str], DataFrame]:
    """A function that adds ``reply`` to rows with a ``prompt`` from recorded responses (``prompt_key``, ``content``, ``ord``).

    The key is that of the model, the stage and the prompt; rows without a prompt, and unrecorded ones, get null.
    """

    latest = log.groupBy(F.col("prompt_key").alias("_key")).agg(F.max_by("content", "ord").alias("reply"))

    def ask(rows: DataFrame, stage: str) -> DataFrame:
        keyed = rows.withColumn("_own", F.when(F.col("prompt").isNotNull(), prompt_key(F.lit(model), F.lit(stage), F.col("prompt"))))
        return keyed.join(latest, F.col("_own") == F.col("_key"), "left").drop("_own", "_key")

    return ask


class JsonModeRefused(Exception):
    """A responder's answer that it can't be asked for JSON; it is asked again without."""


#: Fixed value: seconds before the first new try; each further one waits twice as long.
FIRST_WAIT = 5.0


def one_answer(respond: Callable[..., str], prompt: str, tries: int, first_wait: float, sleep: Callable[[float], None]) -> tuple[str | None, str | None]:
    """``content`` and ``error`` of one prompt.  Transient errors are tried again after waits that double; a refusal of JSON
    mode drops that mode, which is no try of its own."""
    json_mode, n, error = True, 0, None
    while n < tries:
        try:
            return respond(prompt, json_mode=json_mode), None
        except JsonModeRefused as e:
            error = str(e)
            if not json_mode:
                return None, error
            json_mode = False
        except Exception as e:  # noqa: BLE001  the error is part of the result
            error, n = str(e), n + 1
            if not any(t in error.lower() for t in TRANSIENT):
                return None, error
            if n < tries:
                sleep(first_wait * 2 ** (n - 1))
    return None, error


def answer(prompts: DataFrame, respond: Callable[..., str], tries: int = 3, at_once: int = 4, first_wait: float = FIRST_WAIT) -> DataFrame:
    """``prompt_key``, ``content`` and ``error`` from a responder, called as ``respond(prompt, json_mode=...)``.

    A task has at most ``at_once`` calls in flight, and gives its rows in their order.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time
        from concurrent.futures import ThreadPoolExecutor

        with ThreadPoolExecutor(at_once) as pool:
            for rows in batches:
                found = list(pool.map(lambda prompt: one_answer(respond, prompt, tries, first_wait, time.sleep), rows["prompt"]))
                yield pd.DataFrame({"prompt_key": rows["prompt_key"].to_list(), "content": [c for c, _ in found], "error": [e for _, e in found]})

    return prompts.select("prompt_key", "prompt").mapInPandas(run, "prompt_key string, content string, error string")


def json_span(text: str) -> str | None:
    """The first balanced JSON array or object in a text, strings respected; an array goes before an object in it."""
    text = re.sub(r"<think>.*?</think>", "", text, flags=re.S)
    for start in (i for i, c in enumerate(text) if c in "[{"):
        depth, quoted, escaped = [], False, False
        for i in range(start, len(text)):
            c = text[i]
            if quoted:
                quoted, escaped = escaped or c != '"', not escaped and c == "\\"
                continue
            if c == '"':
                quoted = True
            elif c in "[{":
                depth.append("]" if c == "[" else "}")
            elif c in "]}":
                if not depth or depth.pop() != c:
                    break
                if not depth:
                    try:
                        json.loads(text[start : i + 1])
                    except ValueError:
                        break
                    return text[start : i + 1]
    return None


# Fixed value: how a model refuses.
REFUSALS = "не могу обсуждать|давайте поговорим|не могу помочь с этим"


def json_rows(text: str) -> str | None:
    """The JSON of a response, as an array where it is one: the whole span, else every balanced object on its own, as a
    response that was cut off has them.  Null for a refusal and for a text without JSON."""
    if re.search(REFUSALS, text, re.I):
        return None
    plain = re.sub(r"<think>.*?</think>", "", text, flags=re.S)
    first = plain.find("[")
    cut_off = first >= 0 and ("{" not in plain or first < plain.find("{"))
    span = json_span(plain)
    if span is not None and (span[0] == "[" or not cut_off):
        return span
    found, rest = [], plain
    while (span := json_span(rest)) is not None:
        if span[0] == "{":
            found.append(span)
        rest = rest[rest.index(span) + len(span) :]
    return f"[{','.join(found)}]" if found else None


def transient(error: Column) -> Column:
    """Whether an error's message marks it worth another try."""
    low = F.lower(F.coalesce(error, F.lit("")))
    hit = F.lit(False)
    for part in TRANSIENT:
        hit = hit | F.contains(low, F.lit(part))
    return hit


def _spans(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else json_rows(t))


def parse_rows(responses: DataFrame, ddl: str, content: str = "content") -> DataFrame:
    """One row for each object in the responses' JSON; objects without the first field are dropped."""
    first = ddl.split()[0]
    span = responses.withColumn("_json", F.pandas_udf(_spans, "string")(F.col(content)))
    many = F.when(F.startswith("_json", F.lit("[")), F.from_json("_json", f"array<struct<{ddl}>>")).otherwise(F.array(F.from_json("_json", f"struct<{ddl}>")))
    return span.withColumn("_item", F.explode(many)).where(F.col(f"_item.{first}").isNotNull()).drop("_json").select("*", "_item.*").drop("_item")
