"""Codes, top rows and the prefix trie against plain Python over small tables, and their SQL over the given ones."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from docloom.llm import codes, integers, queries, topk, trie

DATA = "/root/testdata/sf0.001"
VECTOR = "vec_id long, embedding array<float>, label int"


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def whole(v, scale):
    return [math.floor(scale * x) for x in v]


def codes_by_hand(rows, rounds=codes.ROUNDS):
    kept = [(i, whole(v, codes.SCALE), label) for i, v, label in rows if usable(v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    size = next((len(q) for _, q, _ in kept if q and len(q) % 8 == 0), None)
    fit = [r for r in kept if len(r[1]) == size]
    w = (size or 8) // 8
    part = lambda q, p: q[p * w : (p + 1) * w]
    books = [[part(q, p) for _, q, _ in fit[:16]] for p in range(8)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(8):
            groups = defaultdict(list)
            for _, q, _ in fit:
                groups[near(part(q, p), books[p])[1]].append(part(q, p))
            for k, xs in groups.items():
                books[p][k] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    out, by_label = [], {}
    for i, q, label in kept:
        if len(q) == size:
            found = [near(part(q, p), books[p]) for p in range(8)]
            code, error = "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)
            by_label[label] = by_label.get(label, 0) + error
        else:
            code = error = None
        out.append((i, code, error, label))
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return [(i, c, e, by_label.get(label), digest) for i, c, e, label in out]


def ordered(rows):
    return sorted(map(tuple, rows), key=repr)


def clustered(n, size, seed):
    r = random.Random(seed)
    centres = [[r.uniform(-1, 1) for _ in range(size)] for _ in range(5)]
    return [(i, [float(np.float32(c + r.gauss(0, 0.05))) for c in r.choice(centres)], r.choice([None, 0, 1, 2])) for i in range(n)]


HOSTILE = [
    (None, [0.5] * 16, 1), (3, None, 1), (4, [0.1] * 15 + [None], 1), (5, [float("nan")] * 16, 2), (6, [float("inf")] * 16, None), (7, [], 1), (8, [0.25] * 7, 9),
    (2, [0.5] * 16, 1), (2, [0.5] * 16, 1), (2, [-0.5] * 16, None), (2, [0.0] * 16, 0),
]


@pytest.mark.parametrize("rows", [clustered(120, 24, 1), clustered(9, 8, 2), HOSTILE, HOSTILE + clustered(40, 16, 3), [(i, [0.125] * 8, 0) for i in range(50)], [(1, None, 0)], []])
def test_codes_equal_a_full_scan(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], f"{VECTOR}, code string, error long")  # names that clash with the result's
    got = codes.compress(df)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert ordered(got.collect()) == ordered(codes_by_hand(rows))


@pytest.mark.parametrize("size", [1, 2, 3, 8, 13, 128])
def test_bounds_are_conservative_and_save_work(size):
    r = np.random.default_rng(size)
    centres = r.integers(-4000, 4000, (16, size))
    x = np.concatenate([centres[r.integers(0, 16, 500)] + r.integers(-40, 40, (500, size)), r.integers(-3, 3, (500, size)), centres])
    entries = np.concatenate([centres[:12], centres[:2], r.integers(-3, 3, (2, size))])
    full = ((x[:, None] - entries[None]) ** 2).sum(2)
    code, error, left = codes.nearest(x, entries)
    assert (code == full.argmin(1)).all() and (error == full.min(1)).all()
    assert left == sorted(left, reverse=True) and (size < 8 or left[-1] < 0.4 * len(x) * 16)


def test_large_components():
    import pyarrow as pa

    big = pa.array([[1e5] * 64, [1e200] * 8], pa.list_(pa.float64()))
    assert integers.floors(big.slice(0, 1), 1024)[64][1][0, 0] == 102_400_000
    with pytest.raises(ArithmeticError):
        integers.floors(big, 1024)


def top_by_hand(rows, every, k):
    kept = [(i, whole(v, topk.SCALE)) for i, v, _ in rows if usable(v)]
    out = []
    for a, (i, q) in enumerate(kept):
        if i is not None and i % every == 0:
            found = [(-sum(x * y for x, y in zip(q, c, strict=True)), j is None, j) for b, (j, c) in enumerate(kept) if a != b and len(c) == len(q)]
            out += [(i, n + 1, j, -s) for n, (s, _, j) in enumerate(sorted(found, key=lambda f: (f[0], f[1], f[2] or 0))[:k])]
    return out


TIES = [(i, [1.0, 0.0], 0) for i in range(40)] + [(i, [float(i % 3), 1.0], 0) for i in range(40, 60)]


@pytest.mark.parametrize("rows", [clustered(300, 12, 4), HOSTILE, HOSTILE * 3, TIES, TIES * 2, clustered(6, 4, 5), [(0, [0.0] * 4, 0)], [(0, None, 0)], []])
@pytest.mark.parametrize(("block", "sample"), [(256, 1024), (256, 20)])
def test_top_rows_equal_all_scores(spark, rows, block, sample):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], f"{VECTOR}, rank int, block string")
    got = topk.top_k(df, topk.every(2), 10, sample=sample, block=block)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert ordered(got.collect()) == ordered(top_by_hand(rows, 2, 10))


def test_pivots_stop_the_search_early():
    r = np.random.default_rng(7)
    centres = r.integers(-1000, 1000, (40, 32))
    x = centres[r.integers(0, 40, 4000)] + r.integers(-30, 30, (4000, 32))
    block = topk.Block(list(range(4000)), x, topk.spread(x[:1024], topk.PIVOTS))
    for q in x[::500]:
        scores = x @ q
        want = sorted(zip((-scores).tolist(), range(4000), strict=True))[:11]
        assert block.best(q, 11, topk.NONE) == [(i, -s) for s, i in want]
    assert block.evaluated < 8 * 4000 / 4


def trie_by_hand(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in own.items()}
    nodes = defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(math.fmod(c, 5))
        seq = own.get(base, [])[:h] + own[c][h:]
        for d in range(len(seq) + 1):
            nodes[tuple(seq[:d])].append((c, d == len(seq)))
    kids = defaultdict(list)
    for n in nodes:
        if n:
            kids[n[:-1]].append(n)
    total = {}
    for n in sorted(nodes, key=len, reverse=True):
        saved = (len(nodes[n]) - 1) * len(n[-1][1].encode()) if n else 0
        total[n] = (sum(total[k][0] for k in kids[n]) or 1, saved + sum(total[k][1] for k in kids[n]))
    least = {n: min(c for c, _ in m) for n, m in nodes.items()}
    ends = {n: hashlib.sha256(",".join(str(c) for c in sorted(c for c, e in m if e)).encode()).hexdigest() for n, m in nodes.items()}
    return [(least[n], len(n), least[n[:-1]] if n else None, len(m), len(kids[n]), *total[n], ends[n]) for n, m in nodes.items()]


def talk(n, seed, texts=3, longest=14, low=0):
    r = random.Random(seed)
    return [(c, t, r.choice(["user", "assistant", None]), r.choice(["", "é" * k, None]) if r.random() < 0.2 else "x" * r.randrange(1, texts + 1)) for c in range(low, low + n) for t in range(r.randrange(longest)) for k in (r.randrange(3),)]


SAME = [(c, t, "user", f"turn {t}") for c in range(60) for t in range(12)]
ODD = [(None, 0, "user", "lost"), (7, None, None, None), (7, None, "user", "a"), (7, 1, "user", "b"), (7, 1, "user", "a"), (7, 1, "user", "a"), (-3, 0, "u", "x"), (-5, 0, "u", "y"), (-5, 1, "u", "z"), (3, 0, "u", "y"), (2**62, 5, "u", "y")]


LONG = [(9, t, "user", "long") for t in range(300)] + SAME
TALKS = [talk(60, 1), talk(80, 2, texts=1) + talk(40, 3, low=-20), ODD, LONG, [(9, 0, "user", "same")] * 50, [(None, 1, "a", "b")], []]


@pytest.mark.parametrize(("rows", "cell"), [*((rows, 4) for rows in TALKS), (TALKS[1], trie.CELL), (LONG, trie.CELL)])
def test_trie_equals_plain_prefixes(spark, rows, cell):
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, depth int, seq int").repartition(3)
    got = trie.prefix_trie(df, cell=cell)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert ordered(got.collect()) == ordered(trie_by_hand(rows))


def test_a_million_letters_in_a_turn(spark):
    rows = [(c, t, "user", "a" * 1_000_000 + "é") for c in (5, 6) for t in range(3)]
    got = trie.prefix_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert ordered(got.collect()) == ordered(trie_by_hand(rows))


@pytest.mark.parametrize("name", ["op11_vector_codes", "op12_top_rows", "op13_prefix_trie"])
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("embeddings", "conversations"):
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    got = queries.QUERIES[name](spark, DATA)
    want = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert ordered(got.select(*names).collect()) == ordered(want.fetchall())
