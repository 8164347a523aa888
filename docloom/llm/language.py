"""Language identification with word-first backoff.

A known word scores by its log frequency in each language. An unseen word falls back to its
character n-grams, boundaries included: to the longest length of which any n-gram is known, then
shorter ones, down to single letters.

The tables are counted on a hash-chosen sample of the labelled documents, of each language about an
even share of ``train_chars`` characters (a parameter: beyond it more text no longer moves the
frequencies). They hold every word and n-gram of the sample with its counts in every language, so
their size is bounded by the sample. Prediction reads every whole text.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")  # numbers such as ½ or ① are none, vowel signs stay in their word
LONGEST = 5
TRAIN_CHARS = 12_000_000
KEPT_WORDS = 200_000
UNDETERMINED = "und"
EVIDENCE = 0.02  # a score this close to an even share tells nothing
COVER = 4  # n-grams of this length tell whether an unseen word could be of a learned language
COVERAGE = 0.15  # a text of which less is known is in none of the learned languages


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _grams(word: str, n: int) -> list[str]:
    if n == 1:
        return list(word)
    padded = f"\x02{word}\x03"
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def fit(docs: DataFrame, train_chars: int = TRAIN_CHARS) -> dict:
    """Count words and n-grams by language over the labelled rows (text, lang, doc_id)."""
    rows = docs.where("text is not null and lang is not null").where(~held_out(F.col("doc_id")))
    by_lang = rows.groupBy("lang").agg(F.sum(F.length("text").cast("double")).alias("chars")).collect()  # one row a language
    each = train_chars / max(len(by_lang), 1)
    langs = sorted(r["lang"] for r in by_lang)
    shares = [(r["lang"], math.ceil(min(1.0, each / max(r["chars"], 1)) * (1 << 20))) for r in by_lang]
    limits = docs.sparkSession.createDataFrame(shares, "lang string, share long")
    rows = rows.join(F.broadcast(limits), "lang").where(F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 20)) < F.col("share")).select("lang", "text")

    def count(batches):
        words: dict[str, Counter] = {}

        def flush():
            out = [(lang, w, n) for lang, c in words.items() for w, n in c.items()]
            words.clear()
            return pd.DataFrame(out, columns=["lang", "word", "n"])

        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                words.setdefault(lang, Counter()).update(LETTERS.findall(text.lower()))
            if sum(map(len, words.values())) > 300_000:
                yield flush()
        yield flush()

    def split(batches):
        """The word itself as size 0, and its n-grams."""
        for batch in batches:
            out: Counter = Counter()
            for lang, word, n in zip(batch["lang"], batch["word"], batch["n"], strict=True):
                out[lang, 0, word] += n
                for size in range(1, LONGEST + 1):
                    for g in _grams(word, size):
                        out[lang, size, g] += n
            yield pd.DataFrame([(*k, v) for k, v in out.items()], columns=["lang", "size", "gram", "n"])

    counted = rows.mapInPandas(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    grams = counted.mapInPandas(split, "lang string, size int, gram string, n long").groupBy("lang", "size", "gram").agg(F.sum("n").alias("n"))
    found = grams.toArrow().combine_chunks()  # as many rows as the sample has words and n-grams
    at = {lang: i for i, lang in enumerate(langs)}
    lang = np.array([at[x] for x in found.column("lang").to_pylist()], np.int16)
    size, n = (found.column(c).to_numpy() for c in ("size", "n"))
    names = found.column("gram").to_pylist()
    base = np.zeros((LONGEST + 1, len(langs)))
    places: list[dict[str, int]] = []
    entry = np.zeros(len(n), np.int64)
    delta = np.zeros(len(n), np.float32)
    count_ = 0
    for k in range(LONGEST + 1):
        mine = np.flatnonzero(size == k)
        place: dict[str, int] = {}
        for i in mine.tolist():
            entry[i] = place.setdefault(names[i], count_ + len(place))
        count_ += len(place)
        places.append(place)
        total = np.bincount(lang[mine], n[mine], len(langs)) + 0.1 * len(place) + 1
        base[k] = math.log(0.1) - np.log(total)
        delta[mine] = np.log((n[mine] + 0.1) / 0.1)
    order = np.lexsort((lang, entry))
    first = np.searchsorted(entry[order], np.arange(count_ + 1))
    return {"langs": langs, "places": places, "base": base, "first": first, "lang": lang[order], "delta": delta[order]}


class Predictor:
    """Scores by the log frequency of an entry in each language: what an entry never seen has, and for
    the languages that hold it how much more. A batch of texts is scored at once."""

    def __init__(self, model: dict):
        self.m = model
        self.langs, self.words = model["langs"], model["places"][0]
        self.even = 1 / max(len(self.langs), 1)
        self._forget()

    def _forget(self) -> None:
        self.unseen: dict[str, int] = {}
        self.unseen_scores = np.zeros((0, len(self.langs)))
        self.unseen_cover = np.zeros(0)

    def _sums(self, entries: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        """By owner and language, the sum of what its entries have over an entry never seen."""
        first = self.m["first"]
        start = first[entries]
        many = first[entries + 1] - start
        ends = np.cumsum(many)
        at = np.repeat(start - (ends - many), many) + np.arange(ends[-1] if len(ends) else 0)
        size = len(self.langs)
        return np.bincount(np.repeat(owner, many) * size + self.m["lang"][at], self.m["delta"][at], n * size).reshape(n, size)

    def _known_grams(self, word: str, n: int) -> list[int]:
        place = self.m["places"][n]
        return [place[g] for g in _grams(word, n) if g in place]

    def _back_off(self, words: list[str]) -> None:
        """Scores of unseen words, and the share of their n-grams of length COVER that are known."""
        entries, owner, count, sizes, cover = [], [], [], [], []
        for k, w in enumerate(words):
            some = min(COVER, len(w) + 2)
            covering = self._known_grams(w, some)
            cover.append(len(covering) / (len(w) + 3 - some))
            for n in range(LONGEST, 0, -1):
                known = covering if n == some and n > 1 else self._known_grams(w, n)
                if known:
                    break
            entries += known
            owner += [k] * len(known)
            count.append(max(len(known), 1))
            sizes.append(n if known else -1)
        got = self._sums(np.array(entries, np.int64), np.array(owner, np.int64), len(words)) / np.array(count)[:, None]
        got += np.vstack([self.m["base"], np.zeros(len(self.langs))])[sizes]
        self.unseen.update(zip(words, range(len(self.unseen), len(self.unseen) + len(words)), strict=True))
        self.unseen_scores = np.vstack([self.unseen_scores, got])
        self.unseen_cover = np.append(self.unseen_cover, cover)

    def rejects(self, lang: str, score: float, coverage: float) -> bool:
        return lang == UNDETERMINED or score < min(self.even + EVIDENCE, 0.99) or coverage < COVERAGE

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float]]:
        """Of each text the language, its score, and how much of its letters is known."""
        found = [LETTERS.findall(t.lower()) if t else [] for t in texts]
        size = np.array([len(x) for x in found], np.int64)
        if not size.sum() or not self.langs:
            return [(UNDETERMINED, 0.0, 0.0)] * len(texts)
        if len(self.unseen) > KEPT_WORDS:
            self._forget()
        flat = [w for x in found for w in x]
        owner = np.repeat(np.arange(len(found)), size)
        at = np.fromiter(map(self.words.get, flat, [-1] * len(flat)), np.int64, len(flat))
        letters = np.fromiter(map(len, flat), np.int64, len(flat))
        known, lost = np.flatnonzero(at >= 0), np.flatnonzero(at < 0)
        words = [flat[k] for k in lost.tolist()]
        if new := [w for w in dict.fromkeys(words) if w not in self.unseen]:
            self._back_off(new)
        row = np.fromiter(map(self.unseen.__getitem__, words), np.int64, len(words))
        n = len(found)
        total = self._sums(at[known], owner[known], n) + np.bincount(owner[known], minlength=n)[:, None] * self.m["base"][0]
        for k in range(len(self.langs)):
            total[:, k] += np.bincount(owner[lost], self.unseen_scores[row, k], n)
        covered = np.bincount(owner[known], letters[known], n) + np.bincount(owner[lost], letters[lost] * self.unseen_cover[row], n)
        total /= np.sqrt(np.maximum(size, 1))[:, None]
        p = np.exp(total - total.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        cover = covered / np.maximum(np.bincount(owner, letters, n), 1)
        return [(self.langs[b], float(x[b]), float(c)) if k else (UNDETERMINED, 0.0, 0.0) for k, b, x, c in zip(size.tolist(), best.tolist(), p, cover, strict=True)]


def identify(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """Predict the language of each row of ``docs`` (doc_id, text, lang to learn from; others ignored).

    Returns doc_id, held_out, lang_pred, score, rejected. A text that is null or has no letter is
    `und` with score 0; letters that no table knows give the first language with an even share.
    Rejected: `und`, a score that is hardly above an even share, or a text of which hardly a word or
    n-gram is known. Without any labelled row all is `und`. Rows are treated one by one, so repeated rows and null ids need no rule.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model or fit(docs))  # bounded by train_chars

    def run(batches):
        p = Predictor(shared.value)
        for batch in batches:
            got = p.predict(batch["text"].tolist())
            lang, score, _ = zip(*got, strict=True) if got else ((), (), ())
            yield pd.DataFrame({"doc_id": batch["doc_id"], "held_out": batch["held_out"], "lang_pred": lang, "score": score, "rejected": [p.rejects(*x) for x in got]})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInPandas(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, rejected boolean")


def accepted(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """The rows of ``docs`` that are not rejected, all columns kept; a null lang is filled by the prediction."""
    shared = docs.sparkSession.sparkContext.broadcast(model or fit(docs))

    def run(batches):
        p = Predictor(shared.value)
        for batch in batches:
            got = p.predict(batch.column("text").to_pylist())
            keep = pa.array([not p.rejects(*x) for x in got], pa.bool_())
            at = batch.schema.get_field_index("lang")
            filled = pa.array([a if a is not None else b for a, (b, *_) in zip(batch.column(at).to_pylist(), got, strict=True)], pa.string())
            yield batch.set_column(at, "lang", filled).filter(keep)

    return docs.mapInArrow(run, docs.schema)
