"""Many fixed patterns in one pass over a text: an Aho-Corasick automaton in Arrow batches.

The automaton is built on the driver and sent to the tasks with the function, so the patterns' bytes are counted
first: more than ``MOST_BYTES`` raise, and callers go in blocks or by a join instead. A text is read once
from its first character to its last, whatever the number of patterns; overlapping matches all count.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_BYTES = 16 << 20


def size_of(patterns: list[str]) -> int:
    return sum(len(p.encode()) for p in patterns)


class Automaton:
    """Built once where it arrives: the pickled form is the list of patterns."""

    def __init__(self, patterns: list[str]):
        if size_of(patterns) > MOST_BYTES:
            raise ValueError(f"patterns have more than {MOST_BYTES} bytes")
        self.patterns, self._built = list(patterns), None

    def __getstate__(self) -> bytes:
        return pickle.dumps(self.patterns)

    def __setstate__(self, state: bytes) -> None:
        self.patterns, self._built = pickle.loads(state), None

    def found(self, text: str) -> list[int]:
        """Places in ``patterns`` of those that are in the text, sorted; equal patterns are one, the first."""
        if self._built is None:
            made = ahocorasick.Automaton()
            for k, p in enumerate(self.patterns):
                if p and p not in made:
                    made.add_word(p, k)
            made.make_automaton()
            self._built = made
        if not len(self._built):
            return []
        return sorted({k for _, k in self._built.iter(text)})


def found(text: Column, patterns: list[str]) -> Column:
    """Places (from 0) of the patterns that are substrings of a text, sorted; none for a null text. Empty patterns
    are never found."""
    automaton = Automaton(patterns)

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([[] if t is None else automaton.found(t) for t in batch])

    return run(text)


def among(places: Column, patterns: list[str], some: list[str]) -> Column:
    """How many of ``some`` are among the places that ``found`` gave for ``patterns``."""
    return F.size(F.array_intersect(places, F.array(*[F.lit(patterns.index(w)) for w in dict.fromkeys(some)])))
