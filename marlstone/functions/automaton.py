"""Many words looked for in one reading of a text."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


@lru_cache(maxsize=16)
def _machine(words: tuple[str, ...]) -> object:
    """An automaton over all words that yields their numbers; built once a worker."""
    import ahocorasick

    machine = ahocorasick.Automaton()
    for k, word in enumerate(words):
        machine.add_word(word, k)
    machine.make_automaton()
    return machine


def _found(words: tuple[str, ...]) -> object:
    @F.pandas_udf("array<int>")
    def numbers(texts: pd.Series) -> pd.Series:
        machine = _machine(words)
        return pd.Series([[] if t is None else sorted({k for _, k in machine.iter(t)}) for t in texts])

    return numbers


class Words:
    """Lists of words, of which ``found`` says in one pass over a (lower-case) text which occur in it, and ``hits`` what that means for one list.

    A word in several lists is looked for once. Words are compared in lower case and found inside other words too.
    """

    def __init__(self, lists: Mapping[str, Sequence[str]]) -> None:
        self.lists = {name: list(words) for name, words in lists.items()}
        self.words = tuple(dict.fromkeys(w.lower() for words in self.lists.values() for w in words))
        if "" in self.words:
            raise ValueError("an empty word is in every text")
        self.number = {w: k for k, w in enumerate(self.words)}

    def found(self, text: Column) -> Column:
        """Numbers of the words that occur in a text; a null text has none."""
        return _found(self.words)(text)

    def hits(self, numbers: Column, name: str) -> Column:
        """The words of a list, in its order and spelling, that are among the numbers found."""
        pairs = [F.struct(F.lit(self.number[w.lower()]).alias("k"), F.lit(w).alias("w")) for w in self.lists[name]]
        if not pairs:
            return F.array().cast("array<string>")
        return F.transform(F.filter(F.array(*pairs), lambda p: F.array_contains(numbers, p.k)), lambda p: p.w)
