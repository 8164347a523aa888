"""Encoding texts into the pieces of a SentencePiece vocabulary, N best segmentations, and decoding.

The lattice of a text has an edge for every piece that occurs in it and, for a character no piece
covers, one edge through its UTF-8 bytes. A forward Viterbi pass gives each position the best score
of any path that reaches it; that is the exact remaining cost for an A* search running backward from
the end, so the search leaves the queue in order of total score and stops after N paths.

No piece holds a space after another character, so paths of neighbouring words don't interact.
The forward pass therefore runs per word, over all new words of a batch at once, and also tells what a
word's second-best path costs. Only the N - 1 words of a text where that is least can differ from the
best path in any of its N best: for them the A* search gives the N best, and a best-first search over
those gives the N best of the text exactly. This is the form the method takes here.

Scores: a vocabulary of type unigram brings log probabilities. One of type BPE brings merge ranks,
for which the log probability of a Zipf law over the rank stands in. A byte costs 10 more than the
rarest piece.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
NBEST = 4
KEPT_WORDS = 200_000  # words and letters of words whose paths a worker keeps; beyond that it starts afresh
KEPT_LETTERS = 4_000_000
LONG_WORD = 64  # longer words are cut where no piece reaches across
ALPHABET = 0x250  # Latin scripts
BLOCK = 1 << 16  # ids that are decoded at once


@dataclass
class Vocabulary:
    """Pieces with a space written as a space, their scores, and the ids of the 256 bytes."""

    pieces: dict[str, tuple[int, float, tuple[int]]]
    byte_ids: list[int]
    byte_score: float
    surface: list[bytes]  # by id
    dummy_prefix: bool = True
    longest: int = field(init=False)
    starts: dict = field(init=False)
    words: re.Pattern = field(init=False)

    def __post_init__(self) -> None:
        self.longest = max((len(p) for p in self.pieces), default=1)
        self.starts = {p[:k]: () for p in self.pieces for k in range(1, len(p))} | self.pieces  # pieces and what they start with
        self.words = self._words()

    def _words(self) -> re.Pattern:
        """What cuts a text into words no piece reaches across: before a space, around a line end, after
        letters before a mark that follows a letter in no piece. Where pieces hold these, there's no cut."""
        long = [p for p in self.pieces if len(p) > 1]
        if any(" " in p.lstrip(" ") for p in long):
            return re.compile(r"[\s\S]+")
        letter = re.compile(r"[^\W\d_]")
        after = {y for p in long for x, y in zip(p, p[1:], strict=False) if letter.match(x)}
        marks = "".join(c for c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" if c not in after)
        ends = re.escape(marks) + " " + ("\n" if "\n" not in after else "")
        line = "" if any("\n" in p for p in long) else "\n"
        return re.compile((r"\n| *[^\W\d_]+(?=[%s]|\Z)| *[^ \n]+| +" if line else r" *[^\W\d_]+(?=[%s]|\Z)| *[^ ]+| +") % ends)


def load(path: str = DEFAULT_MODEL) -> Vocabulary:
    """Read a SentencePiece model on the driver; its size is that of the vocabulary."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    normal = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    scores = {i: model.get_score(i) for i in normal}
    if min(scores.values()) < -1000:  # merge ranks
        scores = {i: -math.log(2 + min(-s, n)) - math.log(math.log(n)) for i, s in scores.items()}
    text = {i: model.id_to_piece(i).replace("▁", " ") for i in normal}
    surface = [text[i].encode() if i in text else b"" for i in range(n)]
    byte_ids = [0] * 256
    for i in range(n):
        if model.is_byte(i):
            b = int(model.id_to_piece(i)[1:-1], 16)
            byte_ids[b], surface[i] = i, bytes([b])
    return Vocabulary({text[i]: (i, scores[i], (i,)) for i in normal}, byte_ids, min(scores.values()) - 10, surface, model.encode("a")[:1] == model.encode(" a")[-1:] or bool(surface[model.encode("a")[0]].startswith(b" ")))


def lattice(v: Vocabulary, word: str) -> tuple[list[list[tuple[int, tuple[int, ...], float]]], list[float]]:
    """By end position the edges (start, ids, score) into it, and the best score of a path to it."""
    size = len(word)
    into: list[list[tuple[int, tuple[int, ...], float]]] = [[] for _ in range(size + 1)]
    best = [0.0] + [-math.inf] * size
    get = v.starts.get
    for i in range(size):
        known = best[i]
        one = False
        for j in range(i + 1, size + 1):
            hit = get(word[i:j])
            if hit is None:
                break
            if hit:
                if j == i + 1:
                    one = True
                into[j].append((i, hit[2], hit[1]))
                if known + hit[1] > best[j]:
                    best[j] = known + hit[1]
        if not one:
            raw = word[i].encode()
            score = v.byte_score * len(raw)
            into[i + 1].append((i, tuple([v.byte_ids[b] for b in raw]), score))
            if known + score > best[i + 1]:
                best[i + 1] = known + score
    return into, best


def best_two(v: Vocabulary, word: str) -> tuple[float, tuple[int, ...], float]:
    """Score and ids of the best path, and by how much the second best is worse, without a search."""
    into, best = lattice(v, word)
    size = len(word)
    second = [-math.inf] * (size + 1)
    back: list[tuple[int, tuple[int, ...]] | None] = [None] * (size + 1)
    for j in range(1, size + 1):
        one = two = -math.inf
        for start, ids, score in into[j]:
            x = best[start] + score
            if x > one:
                one, two, back[j] = x, one, (start, ids)
            elif x > two:
                two = x
            if second[start] + score > two:
                two = second[start] + score
        second[j] = two
    parts, at = [], size
    while at:
        at, some = back[at]
        parts.append(some)
    return best[size], tuple(i for some in reversed(parts) for i in some), best[size] - second[size]


def word_paths(v: Vocabulary, word: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
    """The n best paths through the lattice of one word, best first.

    Of equal scores the one nearest to its end goes on, and no place is left more than n times: what follows
    a place on one of the n best paths is among its own n best. So a run of equal letters takes time in
    proportion to its length.
    """
    into, best = lattice(v, word)
    size = len(word)
    queue = [(-best[size], size, 0, 0.0, None)]
    ticket, out, visits = 1, [], [0] * (size + 1)
    while queue and len(out) < n:
        f, at, _, done, path = heapq.heappop(queue)
        if at == 0:
            ids: list[int] = []
            while path is not None:
                ids += path[0]
                path = path[1]
            out.append((-f, tuple(ids)))
            continue
        visits[at] += 1
        if visits[at] > n:
            continue
        for start, ids, score in into[at]:
            heapq.heappush(queue, (-(best[start] + score + done), start, ticket, done + score, (ids, path)))
            ticket += 1
    return out


def independent(v: Vocabulary, word: str) -> list[str]:
    """The parts of a long word between places that no piece reaches across."""
    out, start, reach = [], 0, 0
    for i in range(len(word)):
        reach = max(reach, i + 1)
        for j in range(i + 1, len(word) + 1):
            hit = v.starts.get(word[i:j])
            if hit is None:
                break
            if hit:
                reach = max(reach, j)
        if reach == i + 1:
            out.append(word[start:reach])
            start = reach
    return out


def _gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs flat[start : start + size], one behind the other."""
    ends = np.cumsum(size)
    if not len(ends):
        return flat[:0]
    return flat[np.repeat(start - (ends - size), size) + np.arange(ends[-1])]


class Decoder:
    def __init__(self, vocabulary: Vocabulary):
        surface = [*vocabulary.surface, b""]  # the last for ids that are none
        self.flat = np.frombuffer(b"".join(surface), np.uint8)
        self.size = np.array([len(s) for s in surface], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.prefix = vocabulary.dummy_prefix

    def texts(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """The texts of the runs of ids between the offsets."""
        none = len(self.size) - 1
        ids = np.where((ids >= 0) & (ids < none), ids, none)
        blocks = (ids[k : k + BLOCK] for k in range(0, len(ids), BLOCK))  # places are eight times as large as what lies there
        raw = b"".join(_gather(self.flat, self.start[some], self.size[some]).tobytes() for some in blocks)
        ends = np.concatenate([[0], np.cumsum(self.size[ids])])[offsets].tolist()
        parts = (raw[a:b] for a, b in zip(ends, ends[1:], strict=False))
        return [(x[1:] if self.prefix and x[:1] == b" " else x).decode("utf-8", "replace") for x in parts]


class Forward:
    """The forward pass over the lattices of many words of one length at once.

    The pieces are a trie over an alphabet: the letters and signs of Latin scripts that are pieces
    themselves. Words with other characters, or long ones, go one by one; the results are the same.
    """

    def __init__(self, v: Vocabulary):
        self.v = v
        letters = sorted(c for c in v.pieces if len(c) == 1 and ord(c) < ALPHABET)
        self.column = np.zeros(ALPHABET + 1, np.int32)
        self.column[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        fits = set(letters)
        states = {"": 1}
        for p in sorted(v.starts, key=len):
            if p[:-1] in states and p[-1] in fits:
                states[p] = len(states) + 1
        inner = {states[p[:-1]] for p in states if p}
        self.row = np.zeros(len(states) + 1, np.min_scalar_type(len(inner)))
        self.row[sorted(inner)] = np.arange(1, len(inner) + 1)
        self.step = np.zeros((len(inner) + 1, len(letters) + 1), np.min_scalar_type(len(states)))  # a row for each state that goes on; 0 is where no piece does
        self.piece = np.full(len(states) + 1, -1, np.int32)
        self.score = np.full(len(states) + 1, -np.inf)
        for p, k in states.items():
            if p:
                self.step[self.row[states[p[:-1]]], self.column[ord(p[-1])]] = k
                if hit := v.starts[p]:
                    self.piece[k], self.score[k] = hit[0], hit[1]

    def __call__(self, words: list[str]):
        """(order, score, loss, size, ids): indices of the words in the order of what follows: the best score, by how much
        the second best is worse, the number of ids, and the ids one behind the other."""
        out: list[tuple] = []
        by_size: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            by_size.setdefault(len(w), []).append(k)
        for size, rows in by_size.items():
            odd = rows
            if size <= LONG_WORD:
                points = np.frombuffer("".join([words[k] for k in rows]).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, size)
                columns = self.column[np.minimum(points, ALPHABET)]
                fine = (columns > 0).all(1)
                if fine.any():
                    out.append((np.array(rows)[fine], *self._solve(columns[fine].T.copy())))
                odd = [rows[k] for k in np.flatnonzero(~fine)]
            for k in odd:
                score, ids, loss = best_two(self.v, words[k])
                out.append(([k], [score], [loss], [len(ids)], np.array(ids, np.int32)))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))

    def _solve(self, columns: np.ndarray):
        size, n = columns.shape
        best, second = np.full((size + 1, n), -np.inf), np.full((size + 1, n), -np.inf)
        start, piece = np.zeros((size + 1, n), np.int64), np.zeros((size + 1, n), np.int32)
        best[0] = 0
        for i in range(size):
            state = np.ones(n, np.int32)
            for j in range(i + 1, size + 1):
                state = self.step[self.row[state], columns[j - 1]]
                if not state.any():
                    break
                score = self.score[state]
                x, y = best[i] + score, second[i] + score
                better = x > best[j]
                second[j] = np.where(better, np.maximum(best[j], y), np.maximum(second[j], x))
                np.maximum(best[j], x, out=best[j])
                start[j][better] = i
                piece[j][better] = self.piece[state[better]]
        at, everyone = np.full(n, size), np.arange(n)
        ids = np.zeros((n, size), np.int32)  # filled from behind
        count = np.zeros(n, np.int64)
        while (on := at > 0).any():
            rows, here = everyone[on], at[on]
            count[rows] += 1
            ids[rows, size - count[rows]] = piece[here, rows]
            at[rows] = start[here, rows]
        return best[size], best[size] - second[size], count, ids[np.arange(size) >= size - count[:, None]]


class Encoder:
    """Encodes batches of texts. The best path of a word, and what its second best loses, come from the forward
    pass; the A* search runs for words where a text's N best may differ. Both are kept."""

    def __init__(self, vocabulary: Vocabulary, nbest: int = NBEST):
        self.v, self.n = vocabulary, nbest
        self.decoder = Decoder(vocabulary)
        self.forward = Forward(vocabulary)
        self._clear()

    def _clear(self) -> None:
        self.at: dict[str, int] = {}
        self.names: list[str] = []
        self.searched: dict[int, list[tuple[float, tuple[int, ...]]]] = {}
        self.score, self.loss, self.size, self.flat = array("d"), array("d"), array("q"), array("i")
        self.letters = 0

    def _numbered(self, words: list[str]) -> Iterator[int]:
        """The numbers of words; new ones get the next."""
        for w in words:
            if w not in self.at:
                self.at[w] = len(self.names)
                self.names.append(w)
        return map(self.at.__getitem__, words)

    def _learn(self, words: list[str]) -> None:
        order, score, loss, size, ids = self.forward(words)
        turn = np.argsort(order)
        ids = _gather(ids, (np.cumsum(size) - size)[turn], size[turn])
        for mine, new, kind in ((self.score, score[turn], np.float64), (self.loss, loss[turn], np.float64), (self.size, size[turn], np.int64), (self.flat, ids, np.int32)):
            mine.frombytes(np.ascontiguousarray(new, kind).tobytes())
        self.letters += sum(map(len, words))

    def paths(self, k: int, best: tuple[int, ...]) -> list[tuple[float, tuple[int, ...]]]:
        """The N best paths of a word, of equals the one of the forward pass first."""
        found = self.searched.get(k)
        if found is None:
            found = word_paths(self.v, self.names[k], self.n)
            if found[0][1] != best:
                rest = [x for x in found if x[1] != best]
                found = [(found[0][0], best), *rest][: self.n]
            self.searched[k] = found
        return found

    def words(self, text: str) -> list[str]:
        found = self.v.words.findall(f" {text}" if self.v.dummy_prefix and text else text)
        if max(map(len, found), default=0) > LONG_WORD:
            found = [part for w in found for part in (independent(self.v, w) if len(w) > LONG_WORD else (w,))]
        return found

    def choices(self, words: np.ndarray, loss: np.ndarray, ids: np.ndarray, ends: np.ndarray) -> list[tuple[float, list[tuple[int, tuple[int, ...]]]]]:
        """The N best of a text: what each loses against the best, and at which words it has which ids."""
        few = self.n - 1
        near = np.arange(len(loss)) if len(loss) <= few else np.flatnonzero(loss <= np.partition(loss, few - 1)[few - 1]) if few else np.arange(0)
        near = near[np.argsort(loss[near], kind="stable")][:few].tolist()
        near = [k for k in near if loss[k] < math.inf]
        options = [self.paths(int(words[k]), tuple(ids[ends[k] : ends[k + 1]].tolist())) for k in near]
        queue: list[tuple[float, tuple[tuple[int, int], ...]]] = [(0.0, ())]  # loss, choices by rank in `near`
        best = []
        while queue and len(best) < self.n:
            lost, choice = heapq.heappop(queue)
            best.append((lost, [(near[r], options[r][c][1]) for r, c in choice]))
            last = choice[-1] if choice else (-1, 0)
            if choice and last[1] + 1 < len(options[last[0]]):
                mine = options[last[0]]
                heapq.heappush(queue, (lost + mine[last[1]][0] - mine[last[1] + 1][0], (*choice[:-1], (last[0], last[1] + 1))))
            for r in range(last[0] + 1, len(near)):
                heapq.heappush(queue, (lost + options[r][0][0] - options[r][1][0], (*choice, (r, 1))))
        return best

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[list[tuple[float, np.ndarray]]]]:
        """Ids of the best paths of all texts, where each text begins in them, and the N best (score, ids) of each."""
        if len(self.at) > KEPT_WORDS or self.letters > KEPT_LETTERS:
            self._clear()
        numbers, bounds = array("q"), [0]
        for t in texts:  # the strings of one text at a time
            numbers.extend(self._numbered(self.words(t)))
            bounds.append(len(numbers))
        if new := self.names[len(self.score) :]:
            self._learn(new)
        word = np.array(numbers, np.int64)
        score, loss, size = np.array(self.score), np.array(self.loss), np.array(self.size)
        start = np.cumsum(size) - size
        count = size[word]
        ids = _gather(np.array(self.flat, np.int32), start[word], count)
        ends = np.concatenate([[0], np.cumsum(count)])
        offsets = ends[bounds]
        best = []
        for a, b in zip(bounds, bounds[1:], strict=False):
            total = float(score[word[a:b]].sum())
            mine = []
            for lost, choice in self.choices(word[a:b], loss[word[a:b]], ids, ends[a : b + 1]):
                at, parts = ends[a], []
                for k, other in sorted(choice):
                    parts += [ids[at : ends[a + k]], np.array(other, np.int32)]
                    at = ends[a + k + 1]
                mine.append((total - lost, np.concatenate([*parts, ids[at : ends[b]]])))
            best.append(mine)
        return ids, offsets, best

    def nbest_ids(self, text: str) -> list[tuple[float, list[int]]]:
        return [(score, ids.tolist()) for score, ids in self.encode([text])[2][0]]


_ENCODERS: dict[tuple[str, int], Encoder] = {}  # of a worker process, so that what one task has searched serves the next


def encode(docs: DataFrame, model: str = DEFAULT_MODEL, nbest: int = NBEST) -> DataFrame:
    """Encode the text of each row of ``docs`` (doc_id, text; other columns are ignored).

    Returns doc_id, n_chars, n_pieces, pieces (ids of the best path), scores (of the N best,
    descending), others (ids of the second best to the N-th), decoded_sha256 (of the text that the
    pieces decode to) and round_trip (whether that is the text). A text with fewer than N
    segmentations has as many as there are. Null text counts as empty; an empty text has no pieces
    and one path of score 0. Rows are treated one by one, so repeated rows, null ids and empty tables
    need no rule.
    """
    spark = docs.sparkSession
    vocabulary = load(model)
    key = (f"{model} {zlib.crc32(repr(sorted(vocabulary.pieces.items())).encode())}", nbest)
    shared = spark.sparkContext.broadcast(vocabulary)  # as large as the vocabulary

    def run(batches):
        encoder = _ENCODERS.get(key)
        if encoder is None:
            _ENCODERS.clear()
            encoder = _ENCODERS[key] = Encoder(shared.value, nbest)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            ids, offsets, best = encoder.encode(texts)
            back = encoder.decoder.texts(ids, offsets)
            others = [x for mine in best for _, x in mine[1:]]
            inner = np.cumsum([0, *map(len, others)])
            outer = np.cumsum([0, *(len(mine) - 1 for mine in best)])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(list(map(len, texts)), pa.int64()), pa.array(np.diff(offsets), pa.int64()),
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids)),
                    pa.array([[s for s, _ in mine] for mine in best], pa.list_(pa.float64())),
                    pa.ListArray.from_arrays(pa.array(outer, pa.int32()), pa.ListArray.from_arrays(pa.array(inner, pa.int32()), pa.array(np.concatenate([ids[:0], *others])))),
                    pa.array([hashlib.sha256(b.encode("utf-8", "surrogatepass")).hexdigest() for b in back], pa.string()),
                    pa.array([a == b for a, b in zip(texts, back, strict=True)], pa.bool_()),
                ],
                ["doc_id", "n_chars", "n_pieces", "pieces", "scores", "others", "decoded_sha256", "round_trip"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_chars long, n_pieces long, pieces array<int>, scores array<double>, others array<array<int>>, decoded_sha256 string, round_trip boolean")


def decode(rows: DataFrame, pieces: str = "pieces", model: str = DEFAULT_MODEL) -> DataFrame:
    """Decode a column of piece ids of ``rows`` (doc_id, array<int>; other columns are ignored).

    Returns doc_id, text. Null ids give a null text, an empty array an empty one. Ids that are null, outside the
    vocabulary or of control pieces stand for nothing; bytes that make no character become U+FFFD.
    """
    shared = rows.sparkSession.sparkContext.broadcast(load(model))  # as large as the vocabulary

    def run(batches):
        decoder = Decoder(shared.value)
        for batch in batches:
            lists = batch.column("ids").to_pylist()
            flat = np.array([-1 if i is None else i for x in lists for i in x or ()], np.int64)
            texts = decoder.texts(flat, np.cumsum([0, *(len(x or ()) for x in lists)]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([None if x is None else t for x, t in zip(lists, texts, strict=True)], pa.string())], ["doc_id", "text"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", F.col(pieces).cast("array<int>").alias("ids")).mapInArrow(run, f"doc_id {kind}, text string")
