"""The dictionary entry closest to each word, over whole tables.

An entry is close if its ratio with the word (functions/fuzzy.py) is at least the cutoff; the closest one wins, of
equally close ones the last in the order of letters. Equal words are looked up once.

Words and entries of a ratio of c or more have a common subsequence of c (n + m) / 2 letters, n and m their
lengths. For entries and words of up to SHORT letters all subsequences of the lengths in question are the keys of an
index (letters are deleted on both sides, so an edit in either is met); longer ones share pairs of rare
letters. No close pair can be missed; the ratio is computed for what the index gives.

A dictionary of up to MOST entries travels to the tasks, which hold its index; its size is counted first. A
larger one is joined by the pairs of rare letters, both sides dealt by key.
"""

from __future__ import annotations

from collections import defaultdict
from difflib import SequenceMatcher
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fuzzy as fz
from .fuzzy_join import letter_places

CUTOFF = 0.8
SHORT = 9
MOST = 20_000


def reachable(n: int, cutoff: float) -> range:
    """Lengths of the texts that can be close to one of n letters."""
    return range(fz.shortest_partner(n, cutoff), int(n * (2 - cutoff) / cutoff + fz.TINY) + 1)


def subsequences(text: str, lengths: set[int]) -> set[str]:
    return {"".join(c) for size in lengths for c in combinations(text, size)}


class Index:
    """Entries by what close words share with them."""

    def __init__(self, entries: list[str], cutoff: float, places: dict[str, int]):
        self.cutoff, self.places = cutoff, places
        self.by_letters: dict[str, list[str]] = defaultdict(list)
        self.by_pairs: dict[str, list[str]] = defaultdict(list)
        self.bags = {e: frozenset(fz.letters(e)) for e in entries}
        lengths = {len(e) for e in entries}
        self.lengths = sorted(n for n in lengths if n <= SHORT)
        for e in sorted(set(entries)):
            if len(e) <= SHORT:
                for key in subsequences(e, {fz.shared_letters(len(e), n, cutoff) for n in reachable(len(e), cutoff) if n <= SHORT} & set(range(1, len(e) + 1))):
                    self.by_letters[key].append(e)
            for key in fz.pair_keys(e, cutoff, places):
                self.by_pairs[key].append(e)

    def candidates(self, word: str) -> set[str]:
        n = len(word)
        if n > SHORT:
            return {e for key in fz.pair_keys(word, self.cutoff, self.places) for e in self.by_pairs.get(key, ())}
        near = reachable(n, self.cutoff)
        sizes = {fz.shared_letters(n, m, self.cutoff) for m in self.lengths if m in near}
        found = {e for key in subsequences(word, {s for s in sizes if s <= n}) for e in self.by_letters.get(key, ())}
        if near and near[-1] > SHORT:
            found |= {e for key in fz.pair_keys(word, self.cutoff, self.places) for e in self.by_pairs.get(key, ()) if len(e) > SHORT}
        return found

    def closest(self, word: str) -> tuple[str, float] | None:
        if not word:
            return None
        matcher = SequenceMatcher(None, "", word)  # which keeps what it knows of its second text
        bag, best = frozenset(fz.letters(word)), (self.cutoff, "")
        for entry in self.candidates(word):
            if 2 * len(bag & self.bags[entry]) >= best[0] * (len(entry) + len(word)) - fz.TINY:
                matcher.set_seq1(entry)
                best = max(best, (matcher.ratio(), entry))
        return (best[1], best[0]) if best[1] else None


def _look_up(entries: list[str], cutoff: float, places: dict[str, int]):
    def run(batches):
        index = Index(entries, cutoff, places)
        for batch in batches:
            got = [index.closest(w) or (None, None) for w in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("text"), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], ["text", "entry", "ratio"])

    return run


def _keys(cutoff: float, places: dict[str, int]):
    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("text"), pa.array([fz.pair_keys(t, cutoff, places) for t in texts], pa.list_(pa.string()))], ["text", "keys"])

    return run


def _ratios(cutoff: float):
    def run(batches):
        for batch in batches:
            pairs = zip(batch.column("entry").to_pylist(), batch.column("text").to_pylist(), strict=True)
            ratio = [fz.ratio_of(e, w) if fz.alike(e, w, cutoff) else None for e, w in pairs]
            yield pa.RecordBatch.from_arrays([batch.column("text"), batch.column("entry"), pa.array(ratio, pa.float64())], ["text", "entry", "ratio"])

    return run


def closest_entries(words: DataFrame, dictionary: DataFrame, word: str, entry: str, cutoff: float = CUTOFF, most: int = MOST) -> DataFrame:
    """Distinct texts of ``words`` as rows (text, entry, ratio), entry and ratio null where nothing is close.

    ``word`` and ``entry`` name the columns; null and empty texts are left out on both sides. Texts are compared
    as they are. Empty tables: no rows, or no entries.
    """
    n = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    distinct = lambda x, c: x.select(F.col(c).cast("string").alias("text")).where("text <> ''").distinct()
    texts, entries = distinct(words, word).repartition(n), distinct(dictionary, entry)
    places = letter_places(entries)
    few = entries.limit(most + 1).collect()
    if len(few) <= most:
        return texts.mapInArrow(_look_up([r.text for r in few], cutoff, places), "text string, entry string, ratio double")
    keyed = lambda x, name: x.mapInArrow(_keys(cutoff, places), "text string, keys array<string>").select(F.col("text").alias(name), F.explode("keys").alias("key"))
    met = keyed(texts, "text").join(keyed(entries, "entry"), "key").where(2 * F.least(F.length("text"), F.length("entry")) >= cutoff * (F.length("text") + F.length("entry")) - fz.TINY)
    close = met.select("text", "entry").distinct().repartition(n).mapInArrow(_ratios(cutoff), "text string, entry string, ratio double").where("ratio is not null")
    best = close.groupBy("text").agg(F.max(F.struct("ratio", "entry")).alias("best")).select("text", "best.entry", "best.ratio")
    return texts.join(best, "text", "left")
