"""Suffix-array dedup: remove every byte covered by a string of LENGTH bytes that starts elsewhere too.

A suffix array of all positions would move hundreds of bytes for each of them. Equal strings choose
equal anchors, so only the suffixes at anchors are sorted, and the result is still exact:

1. Every window of LENGTH bytes has an anchor: the leftmost of its grams of GRAM bytes with the
   smallest hash. Neighbouring windows with one anchor make a stretch; its context is the bytes they
   cover. Equal windows have equal anchors at equal offsets. A stretch whose gram occurs nowhere else
   can't hold a repeated window and goes no further.
2. Stretches with equal contexts (by a 128-bit hash) are counted together before anything moves. One
   of each travels as the suffix from its anchor on, followed by what precedes the anchor, reversed.
3. The suffixes are sorted by the distributed merge sort of `suffixes`; the common prefixes it keeps
   tell how far to the right of the anchor any other suffix agrees, and bound the windows to look at.
4. A context with copies is repeated throughout. Other windows are compared within their group of
   suffixes with one gram, those of a group that crosses a range's edge after they are brought together.
   Of groups over GROUP suffixes, what neighbours in the
   order share is settled at once, and each window that the order leaves open goes once per run of
   neighbours into a further shuffle of window hashes (128 bits), so no group is gathered in a task.
5. The repeated windows go back to the documents.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, partitions, written
from .passages import shared_runs
from .suffixes import common_prefix, sorted_ranges

LENGTH = 400
GRAM = 128  # a power of two below LENGTH
CHUNK = 1 << 20  # windows looked at together in a long text
GROUP = 4096  # suffixes with one gram that a task compares by itself

_RNG = np.random.default_rng(7)
_BYTE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = _RNG.integers(0, 1 << 63, 32, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOW = np.uint64(0xFFFFFF)


def stretches(raw: bytes, length: int = LENGTH, gram: int = GRAM):
    """Arrays (first window, last window, anchor, gram hash) of the stretches of a text."""
    parts = []
    for start in range(0, max(len(raw) - length + 1, 0), CHUNK):
        h = _BYTE[np.frombuffer(raw, np.uint8, min(CHUNK + length - 1, len(raw) - start), start)]
        m, k = 1, 0
        while m < gram:
            h = h[:-m] * _STEP[k] + h[m:]
            m, k = 2 * m, k + 1
        h ^= h >> np.uint64(29)
        h *= np.uint64(0x9E3779B97F4A7C15)
        v = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
        width, m = length - gram + 1, 1
        while 2 * m <= width:
            v = np.minimum(v[:-m], v[m:])
            m *= 2
        if m < width:
            v = np.minimum(v[: len(v) - (width - m)], v[width - m :])
        at = (v & _LOW).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        parts.append((first + start, np.append(first[1:], len(at)) - 1 + start, at[first] + start, h[at[first]].view(np.int64)))
    if not parts:
        return (np.zeros(0, np.int64),) * 4
    return tuple(map(np.concatenate, zip(*parts, strict=True)))


def _stretch_rows(length: int, gram: int):
    def run(batches):
        for batch in batches:
            cols: list[list] = [[] for _ in range(8)]
            for d, x, y, text in zip(*(batch.column(c).to_pylist() for c in ("d", "x", "y", "text")), strict=True):
                raw = text.encode()
                if len(raw) < length:
                    continue
                lo, hi, a, key = (v.tolist() for v in stretches(raw, length, gram))
                view = memoryview(raw)
                digest = xxhash.xxh3_128_digest
                for c, v in zip(cols, ([d] * len(lo), [x] * len(lo), [y] * len(lo), lo, hi, a, key, [digest(bytes((p - s).to_bytes(4, "little")) + bytes(view[s : t + length])) for s, t, p in zip(lo, hi, a, strict=True)]), strict=True):
                    c.extend(v)
            kinds = (*[pa.int64()] * 7, pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["d", "x", "y", "lo", "hi", "a", "key", "cls"])

    return run


def _contexts(length: int):
    """The suffix of each representative: from its anchor on, then what is before, reversed."""

    def run(batches):
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for text, reps in zip(batch.column("text").to_pylist(), batch.column("reps").to_pylist(), strict=True):
                raw = text.encode()
                for r in reps:
                    lo, hi, a = r["lo"], r["hi"], r["a"]
                    right = raw[a : hi + length]
                    for c, v in zip(out, (right + raw[lo:a][::-1], len(right), r["cls"], r["n"]), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.binary()), pa.array(out[3], pa.int64())], ["s", "first", "cls", "n"])

    return run


MARKS = "cls binary, o1 long, o2 long, win binary, pid int, s binary, first int, best int, lo int, hi int, before int, behind int, gram long, n long"
_KINDS = (pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
_NAMES = [c.split()[0] for c in MARKS.split(", ")]
_REST = (None,) * 10


def _text(s: bytes, first: int) -> bytes:
    return s[first:][::-1] + s[:first]


def _to_compare(cls: bytes, s: bytes, first: int, best: int, lo: int, hi: int, other: int, length: int):
    """Rows of the windows of a suffix that only a further comparison can settle.

    A window reaches d bytes before the anchor and ``length - d`` from it on. Suffixes with the same
    bytes from the anchor on share at most ``best`` before it, others at most ``other`` from it on;
    the windows with lo <= d <= hi are the preceding suffix's too, which puts them forward.
    """
    left = len(s) - first
    t = _text(s, first)
    for d in range(max(length - first, 0), left + 1):
        if (d <= best or d >= length - other) and not lo <= d <= hi:
            yield (cls, left - d, left - d, xxhash.xxh3_128_digest(t[left - d : left - d + length]), *_REST)


def _settle(group: list, length: int) -> list[tuple]:
    """Repeated windows (cls, from, to) of a whole group of sorted (shared before, item), compared by themselves."""
    n = len(group)
    order = sorted((item[0][item[1] :], k) for k, (_, item) in enumerate(group))
    near = [0] * n
    for (s, i), (t, j) in zip(order, order[1:], strict=False):
        c = common_prefix(s, t)
        near[i], near[j] = max(near[i], c), max(near[j], c)
    seen: dict[bytes, int] = {}
    mine = []
    for k, (shared, (s, first, _, copies)) in enumerate(group):
        right = min(max(shared if k else 0, group[k + 1][0] if k + 1 < n else 0), first)
        left = len(s) - first
        t = _text(s, first)
        for o in range(max(0, left - near[k]), min(len(s) - length, left - length + right) + 1):
            w = xxhash.xxh3_128_digest(t[o : o + length])
            seen[w] = seen.get(w, 0) + 1
            if copies == 1:
                mine.append((k, o, w))
    out: list[list] = []
    last = None
    for k, o, w in mine:
        if seen[w] > 1:
            if last == (k, o - 1):
                out[-1][2] = o
            else:
                out.append([group[k][1][2], o, o])
            last = (k, o)
    return [tuple(r) for r in out]


def _settle_groups(length: int):
    """Over suffixes sorted by (gram, string), of groups that went over several ranges."""

    def run(batches):
        group: list = []
        gram = None
        for batch in batches:
            rows: list[tuple] = []
            for g, *item in zip(*(batch.column(c).to_pylist() for c in ("gram", "s", "first", "cls", "n")), strict=True):
                if group and g != gram:
                    rows += _settle(group, length)
                    group = []
                group.append((common_prefix(group[-1][1][0], item[0]) if group else 0, tuple(item)))
                gram = g
            yield _intervals(rows)
        yield _intervals(_settle(group, length) if group else [])

    return run


def _intervals(rows: list[tuple]):
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 3, _KINDS, strict=False)], _NAMES[:3])


def _visit(length: int, gram: int, most: int):
    """Over sorted suffixes: rows of MARKS. With neither window nor string, windows o1 to o2 repeat;
    with a window, it is to be compared; with a string, its windows are to be found when the borders
    of its range are known; without class, what the range tells its neighbours of its borders."""

    def visit(stream):
        pid = TaskContext.get().partitionId()
        rows: list[tuple] = []

        def settle_by_order(group: list, open_left: bool, open_right: bool) -> None:
            """A group that is large or goes on elsewhere: what neighbours share is settled by their order."""
            n = len(group)
            strings = [item[0] for _, item in group]
            firsts = [item[1] for _, item in group]
            right = [0] + [min(group[k][0], firsts[k - 1], firsts[k]) for k in range(1, n)] + [0]
            left = [0] + [common_prefix(strings[k - 1][firsts[k - 1] :], strings[k][firsts[k] :]) for k in range(1, n)] + [0]
            same = [False] + [right[k] == firsts[k] == firsts[k - 1] for k in range(1, n)] + [False]
            start = 0
            while start < n:
                end = start
                while same[end + 1]:
                    end += 1
                # What others share from the anchor on is at most what the neighbour's whole string shares.
                before = min(group[start][0], firsts[start]) if start else None if open_left else 0
                behind = min(group[end + 1][0], firsts[start]) if end + 1 < n else None if open_right else 0
                for k in range(start, end + 1):
                    s, first, cls, copies = group[k][1]
                    size = len(s) - first
                    if copies == 1:
                        for j in (k, k + 1):
                            if 0 < j < n and left[j] >= length - right[j]:
                                rows.append((cls, size - left[j], size - length + right[j], None, *_REST))
                    best = max(left[k] if same[k] else 0, left[k + 1] if same[k + 1] else 0)
                    if (k == 0 and open_left) or (k == n - 1 and open_right):
                        best = size
                    lo, hi = length - right[k], left[k]
                    if open_left or open_right:
                        rows.append((cls, None, None, None, pid, s, first, best, lo, hi, before, behind, xxhash.xxh3_64_intdigest(s[:gram]) >> 1, copies))
                    else:
                        rows.extend(_to_compare(cls, s, first, best, lo, hi, max(before, behind), length))
                start = end + 1

        def settle(group: list, open_left: bool, open_right: bool) -> None:
            rows.extend((item[2], 0, len(item[0]) - length, None, *_REST) for _, item in group if item[3] > 1)
            if open_left or open_right or len(group) > most:
                settle_by_order(group, open_left, open_right)
            elif len(group) > 1:
                rows.extend((*r, None, *_REST) for r in _settle(group, length))

        def batch():
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * len(_KINDS), _KINDS, strict=True)], _NAMES)
            rows.clear()
            return out

        group: list = []
        begun = False
        head = tail = last = None  # the first suffix, the bytes from the anchor on of its run and of the last one
        behind_head = before_tail = None  # what the first other suffix shares with them
        for shared, item in stream:
            right = item[0][: item[1]]
            if head is None:
                head, first_right, tail = item[0], right, right
            elif right != tail:
                if behind_head is None:
                    behind_head = min(shared, len(tail))
                tail, before_tail = right, min(shared, len(right))
            last = item[0]
            if group and shared < gram:
                settle(group, not begun, False)
                group, begun = [], True
            group.append((shared, item))
            if len(rows) >= 20_000:
                yield batch()
        if group:
            settle(group, not begun, True)
            rows.append((None, len(first_right), len(tail), last, pid, head, None, None, None, None, before_tail, behind_head, None, None))
        yield batch()

    return visit


def _open_windows(length: int, borders: dict[int, tuple]):
    """Windows of the suffixes whose group goes on in other ranges, once all borders are known."""
    ranges = sorted(borders)

    def reach(right: bytes, pid: int, step: int) -> int:
        """What the nearest suffix with other bytes from the anchor on shares with these, looking one way."""
        at = ranges.index(pid) + step
        while 0 <= at < len(ranges):
            head, first, tail, last, before_tail, behind_head = borders[ranges[at]]
            near, size, known = (tail, last, before_tail) if step < 0 else (head, first, behind_head)
            if near[:size] != right:
                return common_prefix(near, right)
            if known is not None:
                return known
            at += step
        return 0

    def run(batches):
        found: dict[tuple[int, bytes], tuple[int, int]] = {}
        for batch in batches:
            rows: list[tuple] = []
            for cls, pid, s, first, best, lo, hi, before, behind in zip(*(batch.column(c).to_pylist() for c in ("cls", "pid", "s", "first", "best", "lo", "hi", "before", "behind")), strict=True):
                key = (pid, s[:first])
                if key not in found:
                    found[key] = (reach(key[1], pid, -1), reach(key[1], pid, 1))
                other = max(found[key][0] if before is None else before, found[key][1] if behind is None else behind)
                rows += [r[:4] for r in _to_compare(cls, s, first, best, lo, hi, other, length)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 4, _KINDS, strict=False)], _NAMES[:4])

    return run


def _removed():
    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for text, cuts in zip(batch.column("text").to_pylist(), batch.column("cuts").to_pylist(), strict=True):
                raw = text.encode()
                spans: list[list[int]] = []
                for start, end in sorted((c >> 32, c & 0xFFFFFFFF) for c in cuts or ()):
                    if spans and start <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], end)
                    else:
                        spans.append([start, end])
                rest, at = [], 0
                for s, e in spans:
                    rest.append(raw[at:s])
                    at = e
                kept = b"".join([*rest, raw[at:]]) if spans else raw
                for c, v in zip(out, (len(raw), sum(e - s for s, e in spans), len(spans), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if spans else text), strict=True):
                    c.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            arrays = [pa.array(c, k) for c, k in zip(out, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("own"), *arrays], ["own", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"])

    return run


def _removal(docs: DataFrame, columns: list[str], length: int, gram: int, group: int, words: int | None = None) -> DataFrame:
    """Rows (own: a struct of the columns but text, n_bytes, n_removed, n_spans, kept_sha256, kept_text)."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    # Rows are known by their id, of any type, and 128 bits of their text; rows without an id don't meet those with one.
    keys = {"d": F.xxhash64("doc_id"), **{k: F.xxhash64(F.lit(k), F.col("doc_id").isNull(), text) for k in ("x", "y")}}
    own = F.struct(*[c for c in columns if c != "text"])
    plain = docs.select(own.alias("own"), *[c.alias(k) for k, c in keys.items()], text.alias("text"))
    runs, at_runs = shared_runs(plain.select("d", "x", "y", "text"), words) if words else (None, None)
    found, at_found = written(plain.where(F.octet_length("text") >= length).select("d", "x", "y", "text").mapInArrow(_stretch_rows(length, gram), "d long, x long, y long, lo long, hi long, a long, key long, cls binary"))

    twice = found.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    classes = found.groupBy("key", "cls").agg(F.count("*").alias("n"), F.min(F.struct("d", "x", "y", "lo", "hi", "a")).alias("rep")).join(twice, "key")
    reps = classes.select("rep.d", "rep.x", "rep.y", F.struct("rep.lo", "rep.hi", "rep.a", "cls", "n").alias("r")).groupBy("d", "x", "y").agg(F.collect_list("r").alias("reps"))
    sources = plain.where(F.octet_length("text") >= length).select("d", "x", "y", "text")
    strings, at_strings = written(sources.join(reps, ["d", "x", "y"]).select("text", "reps").mapInArrow(_contexts(length), "s binary, first int, cls binary, n long"))
    drop(spark)
    size = strings.agg(F.coalesce(F.sum(F.octet_length("s")), F.lit(0)), F.count("*")).first()

    marks, at_marks = written(sorted_ranges(strings, size[0], size[1], _visit(length, gram, group), MARKS))
    drop(spark, at_strings)
    ends = {r["pid"]: (bytes(r["s"]), r["o1"], bytes(r["win"]), r["o2"], r["before"], r["behind"]) for r in marks.where("cls is null").collect()}  # one row a range
    waiting = marks.where("cls is not null and s is not null")
    grams = waiting.groupBy("gram").agg(F.count("*").alias("size"))
    apart = waiting.join(grams.where(F.col("size") <= group).select("gram"), "gram", "left_semi").select("gram", "s", "first", "cls", "n")
    apart = apart.repartition(partitions(spark), "gram").sortWithinPartitions("gram", "s").mapInArrow(_settle_groups(length), "cls binary, o1 long, o2 long").withColumn("win", F.lit(None).cast("binary"))
    large = waiting.join(grams.where(F.col("size") > group).select("gram"), "gram", "left_semi").mapInArrow(_open_windows(length, ends), "cls binary, o1 long, o2 long, win binary")
    marks, at_settled = written(marks.where("cls is not null and s is null").select("cls", "o1", "o2", "win").union(apart).union(large))
    open_ = marks.where("win is not null")
    shared = open_.groupBy("win").agg(F.count_distinct("cls").alias("n")).where("n > 1").select("win")
    settled = marks.where("win is null").select("cls", "o1", "o2").union(open_.join(shared, "win", "left_semi").select("cls", "o1", "o2"))
    spans = found.join(settled, "cls").select("d", "x", "y", F.shiftleft(F.col("lo") + F.col("o1"), 32).bitwiseOR(F.col("lo") + F.col("o2") + length).alias("span"))
    cuts = (spans.union(runs) if runs else spans).groupBy("d", "x", "y").agg(F.collect_set("span").alias("cuts"))
    cuts, _ = written(cuts)  # the result reads it
    drop(spark, at_found, at_marks, at_settled, *([at_runs] if at_runs else []))
    own_kind = plain.schema["own"].dataType.simpleString()
    return plain.join(cuts, ["d", "x", "y"], "left").select("own", "text", "cuts").mapInArrow(_removed(), f"own {own_kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string")


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """Remove repeated strings of ``length`` bytes from the text of ``docs`` (doc_id, text).

    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept_text of each row; of kept_text,
    bytes that no longer make a character are left out. Null text counts as empty; texts shorter
    than ``length`` stay whole; repeated rows count as different documents, so they lose everything
    long enough; a doc_id may be of any type, repeated or null; an empty table gives an empty result.
    """
    return _removal(docs, ["doc_id"], length, gram, group).select("own.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text")


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP, words: int | None = None) -> DataFrame:
    """The rows and columns of ``docs`` with kept_text for text; n_chars, if there, is counted again.

    With ``words``, runs of so many words that another row has too go as well, however few bytes they
    have; both kinds are judged on the input.
    """
    out = _removal(docs, docs.columns, length, gram, group, words)
    made = {"text": F.col("kept_text")} | ({"n_chars": F.length("kept_text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return out.select(*[made[c].alias(c) if c in made else F.col("own")[c].alias(c) for c in docs.columns])


# The same by brute force: hashes of all windows of 400 bytes.
ORACLE = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
f AS MATERIALIZED (SELECT doc_id, i, hash(substr(h, 2 * i + 1, 800)) AS q FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 399)) AS i FROM d)),
w AS MATERIALIZED (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 800)) AS g FROM f SEMI JOIN (SELECT q FROM f GROUP BY q HAVING count(*) > 1) USING (q) JOIN d USING (doc_id)),
s AS (SELECT doc_id, i, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS step FROM w SEMI JOIN (SELECT g FROM w GROUP BY g HAVING count(*) > 1) USING (g)),
r AS (SELECT doc_id, min(i) AS a, max(i) + 400 AS b FROM (SELECT *, sum(CASE WHEN step <= 400 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM s) GROUP BY doc_id, k),
p AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM r),
c AS (SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept FROM p JOIN d USING (doc_id) GROUP BY doc_id),
k AS (SELECT doc_id, len(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, coalesce(kept, h) AS kept FROM d LEFT JOIN c USING (doc_id))
SELECT doc_id, n_bytes, n_removed, n_spans, sha256(unhex(kept)) AS kept_sha256,
  decode(unhex(array_to_string(list_filter(regexp_extract_all(kept, '[0-7].|[CD].[89AB].|E.[89AB].[89AB].|F.[89AB].[89AB].[89AB].|..'), lambda x: len(x) > 2 OR x < '8'), ''))) AS text FROM k
"""
