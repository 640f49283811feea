"""Calls to a model as a step between tables: replies are kept, so a second run calls nothing again."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.agents.replies import parse_reply


class Backend(Protocol):
    """Anything that answers a prompt."""

    def __call__(self, prompt: str) -> str: ...


class Canned:
    """A backend for tests: the reply of the first key that the prompt contains."""

    def __init__(self, replies: dict[str, str], default: str = "[]") -> None:
        self.replies, self.default = replies, default

    def __call__(self, prompt: str) -> str:
        return next((r for k, r in self.replies.items() if k in prompt), self.default)


class Fallback:
    """A second backend for what the first fails on or answers without a required mark."""

    def __init__(self, first: Backend, second: Backend, mark: str = "") -> None:
        self.first, self.second, self.mark = first, second, mark

    def __call__(self, prompt: str) -> str:
        try:
            reply = self.first(prompt)
        except Exception:  # a backend may fail in any way
            return self.second(prompt)
        return reply if self.mark in reply else self.second(prompt)


#: What the message of a backend says that does not know an argument.
UNKNOWN_ARGUMENT = ("unsupported parameter", "unsupported_parameter", "not supported", "invalid_request_error", "param': 'stop'", 'param": "stop"')


class Stopping:
    """A backend that is asked to stop at some marks, and asked again without them where it says that it cannot; any other failure stands."""

    def __init__(self, backend: Callable[..., str], stop: Sequence[str]) -> None:
        self.backend, self.stop = backend, list(stop)

    def __call__(self, prompt: str) -> str:
        if self.stop:
            try:
                return self.backend(prompt, stop=self.stop)
            except Exception as failed:  # a backend may fail in any way
                said = str(failed).lower()
                if "stop" not in said or not any(m in said for m in UNKNOWN_ARGUMENT):
                    raise
        return self.backend(prompt)


def four_characters(text: str) -> int:
    """Tokens of a text where a token is taken as four characters."""
    return -(-len(text) // 4)


def ask(elements: DataFrame, ident: str, prompt: str, backend: Backend, kept: DataFrame | None = None) -> DataFrame:
    """``ident, prompt_hash, reply, value, error`` for each row with a prompt; prompts answered in ``kept`` are not asked again.

    ``value`` is the parsed reply as JSON. Equal prompts are asked once.
    """
    asked = elements.where(F.col(prompt).isNotNull()).select(ident, F.sha2(prompt, 256).alias("prompt_hash"), F.col(prompt).alias("_p"))
    new = asked.groupBy("prompt_hash").agg(F.any_value("_p").alias("_p"))
    if kept is not None:
        new = new.join(kept.select("prompt_hash").distinct(), "prompt_hash", "left_anti")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for key, text in frame.itertuples(index=False, name=None):
                try:
                    reply = backend(text)
                except Exception as failed:
                    rows.append((key, None, None, f"{type(failed).__name__}: {failed}"))
                    continue
                try:
                    rows.append((key, reply, json.dumps(parse_reply(reply)), None))
                except ValueError as failed:
                    rows.append((key, reply, None, str(failed)))
            yield pd.DataFrame(rows, columns=["prompt_hash", "reply", "value", "error"])

    replies = new.mapInPandas(run, "prompt_hash string, reply string, value string, error string")
    if kept is not None:
        replies = replies.unionByName(kept.select("prompt_hash", "reply", "value", "error"))
    return asked.drop("_p").join(replies, "prompt_hash").select(ident, "prompt_hash", "reply", "value", "error")


def records_of(answers: DataFrame, ident: str) -> DataFrame:
    """A row for each record of the answers: ``ident, ord, row`` (a map); a single record counts as a list of one."""
    listed = F.from_json("value", "array<map<string, string>>")
    single = F.from_json("value", "map<string, string>")
    rows = F.when(F.trim("value").startswith("["), listed).otherwise(F.array(single))
    return answers.where("value is not null").select(ident, F.posexplode(rows).alias("ord", "row")).where("row is not null")


def pack(elements: DataFrame, doc: str, order: str, text: str, most_tokens: int, kind: str | None = None, kind_as: str | None = None, count: Callable[[str], int] = four_characters) -> DataFrame:
    """Neighbouring paragraphs of a document (of one class, if given) packed up to a number of tokens: ``doc, pack, first, last, tokens, text`` (and ``kind`` if asked for).

    ``count`` says how many tokens a paragraph has; a pack counts all its paragraphs. One pass over rows sorted by document and
    order holds the open pack alone, so a long document needs no more memory than a short one.
    """
    own = elements.select(doc, F.col(order).cast("long").alias("_o"), F.coalesce(F.col(text), F.lit("")).alias("_t"), (F.col(kind) if kind else F.lit("")).alias("_k"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, number, now = None, 0, None
        for frame in frames:
            rows = []
            for d, o, t, k in frame.itertuples(index=False, name=None):
                tokens = count(t)
                if now is not None and d == last and k == now[5] and now[3] + tokens <= most_tokens:
                    now[2], now[3] = o, now[3] + tokens
                    now[4].append(t)
                    continue
                if now is not None:
                    rows.append((last, number, now[1], now[2], now[3], "\n\n".join(now[4]), now[5]))
                number = number + 1 if now is not None and d == last else 0
                last, now = d, [d, o, o, tokens, [t], k]
            yield pd.DataFrame(rows, columns=names)
        yield pd.DataFrame([] if now is None else [(last, number, now[1], now[2], now[3], "\n\n".join(now[4]), now[5])], columns=names)

    names = [doc, "pack", "first", "last", "tokens", "text", "kind"]
    schema = f"{doc} {dict(own.dtypes)[doc]}, pack int, first long, last long, tokens long, text string, kind string"
    packed = own.repartition(doc).sortWithinPartitions(doc, "_o").mapInPandas(run, schema)
    return packed if kind_as else packed.drop("kind")
