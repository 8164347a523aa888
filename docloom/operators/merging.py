"""Two ordered recognitions of one thing put together, group by group.

The first list is completed from the second: a row without a value takes that of the first row of the second
that matches it and has one. If the second has rows with a value that match nothing, both are merged in the order of
the second: each of its rows stands for the first row of the first list that matches it and isn't used yet, or,
with a value, for itself; what is left of the first list follows in its own order. What a row finds depends
on what those before it used, so a group is merged in sequence, in a cogroup of both tables.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .people import same_subject


class _Known:
    """A rule asked once a pair of texts."""

    def __init__(self, rule: Callable[[str, str], bool]):
        self.rule, self.answers = rule, {}

    def __call__(self, a: str, b: str) -> bool:
        if (a, b) not in self.answers:
            self.answers[a, b] = self.rule(a, b)
        return self.answers[a, b]


def merge(first: list[tuple], second: list[tuple], rule: Callable[[str, str], bool]) -> list[tuple[int, int]]:
    """Lists of (text, has a value) to pairs (place in the first or -1, place in the second whose value it has or that stands there, or -1)."""
    same = _Known(rule)
    valued = [k for k, (text, has) in enumerate(second) if has and text]
    gives = [-1 if has or not text else next((k for k in valued if same(text, second[k][0])), -1) for text, has in first]
    if not any(not any(text and same(text, second[k][0]) for text, _ in first) for k in valued):
        return list(enumerate(gives))
    left, out = dict.fromkeys(range(len(first))), []
    for k, (text, has) in enumerate(second):
        if text:
            i = next((i for i in left if first[i][0] and same(first[i][0], text)), None)
            if i is not None:
                del left[i]
                out.append((i, gives[i]))
            elif has:
                out.append((-1, k))
    return out + [(i, gives[i]) for i in left]


def merge_groups(first: DataFrame, second: DataFrame, keys: list[str], order: list[str], text: str, value: str, rule: Callable[[str, str], bool] = same_subject) -> DataFrame:
    """keys, pos (from 0), text, value and source of the merged lists: ``first`` (its row, as it was), ``filled``
    (its row with the value of a row of the second) or ``second``.

    Both tables have ``keys``, ``order``, ``text`` and ``value`` of equal types. Groups that only one of them has are kept: the second's
    rows with a value and a text, in order, where the first has none. Null and empty texts match nothing and are kept
    in the first table only. Null keys are a group. A task holds one group of both tables: two recognitions of
    a document, not a table. Empty tables: an empty result.
    """
    kinds = {f.name: f.dataType for f in first.schema.fields}
    schema = T.StructType([*[T.StructField(k, kinds[k]) for k in keys], T.StructField("pos", T.LongType()), T.StructField(text, T.StringType()), T.StructField(value, kinds[value]), T.StructField("source", T.StringType())])
    slim = lambda x: x.select(*keys, *[F.col(c).alias(f"o{k}") for k, c in enumerate(order)], F.col(text).cast("string").alias("text"), F.col(value).alias("value"))
    sorting = [(f"o{k}", "ascending") for k in range(len(order))]

    def run(key, a: pa.Table, b: pa.Table) -> pa.Table:
        a, b = a.sort_by(sorting), b.sort_by(sorting)
        texts, others = a.column("text").to_pylist(), b.column("text").to_pylist()
        values, other_values = a.column("value").to_pylist(), b.column("value").to_pylist()
        got = merge([(t or "", v is not None) for t, v in zip(texts, values, strict=True)], [(t or "", v is not None) for t, v in zip(others, other_values, strict=True)], rule)
        made = [(p, others[k], other_values[k], "second") if i < 0 else (p, texts[i], values[i], "first") if k < 0 else (p, texts[i], other_values[k], "filled") for p, (i, k) in enumerate(got)]
        columns = list(zip(*made, strict=True)) or [()] * 4
        own = [pa.array([x.as_py()] * len(made), x.type) for x in key]
        return pa.Table.from_arrays([*own, pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], a.schema.field("value").type), pa.array(columns[3], pa.string())], [*keys, "pos", text, value, "source"])

    return slim(first).groupBy(*keys).cogroup(slim(second).groupBy(*keys)).applyInArrow(run, schema)
