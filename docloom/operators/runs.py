"""The longest run of tokens that two texts share, in time linear in both.

The states of the suffix automaton of one text stand for its runs; the other text is read through it token by
token, and the length matched so far is the longest run that ends there. A state knows where its runs end first,
so of equally long runs the first in the one text and the first in the other are found.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


TOKEN = re.compile(r"[^\x20\x09-\x0D]+")


class Automaton:
    def __init__(self, tokens: list):
        self.next: list[dict] = [{}]
        self.link, self.length, self.first = [-1], [0], [-1]
        last = 0
        for at, token in enumerate(tokens):
            last = self._append(last, token, at)

    def _state(self, next_: dict, length: int, first: int) -> int:
        self.next.append(next_)
        self.link.append(0)
        self.length.append(length)
        self.first.append(first)
        return len(self.next) - 1

    def _append(self, last: int, token, at: int) -> int:
        new, state = self._state({}, self.length[last] + 1, at), last
        while state >= 0 and token not in self.next[state]:
            self.next[state][token] = new
            state = self.link[state]
        if state < 0:
            return new
        old = self.next[state][token]
        if self.length[old] == self.length[state] + 1:
            self.link[new] = old
            return new
        twin = self._state(dict(self.next[old]), self.length[state] + 1, self.first[old])
        self.link[twin], self.link[old], self.link[new] = self.link[old], twin, twin
        while state >= 0 and self.next[state].get(token) == old:
            self.next[state][token] = twin
            state = self.link[state]
        return new


def longest_run(a: list, b: list) -> tuple[int, int, int]:
    """Length of the longest common run and where it begins in a and in b; (0, 0, 0) if there is none."""
    automaton = Automaton(b)
    next_, link, length = automaton.next, automaton.link, automaton.length
    state = matched = 0
    best = (0, 0, 0)
    for at, token in enumerate(a):
        while state and token not in next_[state]:
            state = link[state]
            matched = length[state]
        if token in next_[state]:
            state, matched = next_[state][token], matched + 1
        if matched > best[0]:
            best = matched, at - matched + 1, automaton.first[state] - matched + 1
    return best


def _runs(batches):
    for batch in batches:
        columns = []
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            words, others = TOKEN.findall(a or ""), TOKEN.findall(b or "")
            n, at, other = longest_run(words, others)
            columns.append((n, at, other, " ".join(words[at : at + n])))
        made = list(zip(*columns, strict=True)) or [()] * 4
        kept = [batch.column(c) for c in batch.schema.names if c not in ("a", "b")]
        names = [c for c in batch.schema.names if c not in ("a", "b")]
        yield pa.RecordBatch.from_arrays([*kept, *[pa.array(c, t) for c, t in zip(made, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)]], [*names, "n_tokens", "at", "other_at", "run"])


def longest_runs(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """For each row the longest run of tokens (whatever stands between ASCII white space) that its texts ``a`` and
    ``b`` share: the other columns, n_tokens, at and other_at (from 0; the first of equally long runs), run (one space between tokens).

    A null or empty text shares nothing: 0 tokens, empty run. The other columns mustn't have these names.
    """
    rest = [f for f in pairs.schema.fields if f.name not in (a, b)]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rest], "n_tokens long, at long, other_at long, run string"])
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = pairs.select(*[f.name for f in rest], F.col(a).alias("a"), F.col(b).alias("b"))
    return rows.repartition(n).mapInArrow(_runs, schema)
