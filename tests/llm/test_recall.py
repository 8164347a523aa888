"""What candidate search finds of all that brute force finds, on the tables of sf0.01 and on planted vectors."""

import os

import numpy as np
import pyarrow.parquet as pq
import pytest
from test_operators import roots

from docloom.llm import common, fingerprint, near, vectors

DATA = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


def texts_by_id():
    t = pq.read_table(f"{DATA}/documents.parquet", columns=["doc_id", "text"])
    return dict(sorted(zip(t["doc_id"].to_pylist(), t["text"].to_pylist(), strict=True)))


@needs_tables
def test_near_documents_all_found(spark):
    texts = texts_by_id()
    ids = list(texts)
    hashes = near.WordHashes()
    seq = [near.shingles(t, hashes) for t in texts.values()]
    shared = near.common_counts([near.labelled(s) for s in seq])
    links = []
    for i in range(len(ids)):
        for j in range(i + 1, len(ids)):
            if texts[ids[i]] == texts[ids[j]] or (shared[i, j] * 1.8 >= 0.8 * (len(seq[i]) + len(seq[j])) - 1e-6 and near.aligned(seq[i], seq[j])):
                links.append((j, i))
    want = {ids[k]: ids[r] for k, r in enumerate(roots(len(ids), links * 2))}
    got = {x.doc_id: x.class_id for x in near.near_duplicates(common.table(spark, DATA, "documents")).collect()}
    lost = sum(got[ids[a]] != got[ids[b]] for a, b in links)
    assert len(links) > 90 and lost <= 0.01 * len(links)
    assert all(want[got[i]] == want[i] for i in ids)  # nothing joined that brute force keeps apart


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance, bit by bit over one text."""
    at: dict[str, int] = {}
    for k, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << k
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    plus, minus, score = full, 0, len(a)
    for c in b:
        here = at.get(c, 0)
        x = (((here & plus) + plus) ^ plus) | here | minus
        up, down = minus | full & ~(x | plus), plus & x
        score += bool(up & top) - bool(down & top)
        up, down = (up << 1 | 1) & full, (down << 1) & full
        plus, minus = down | full & ~((here | minus) | up), up & (here | minus)
    return score


def plain_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@needs_tables
def test_fingerprints_find_close_texts(spark):
    """Texts a few edits in a thousand characters apart share a class of fingerprints; unlike ones don't."""
    texts = texts_by_id()
    docs = common.table(spark, DATA, "documents")
    by_words = {x.doc_id: x.class_id for x in near.near_duplicates(docs).collect()}
    by_walk = {x.doc_id: x.class_id for x in fingerprint.fingerprints(docs).collect()}
    close = found = 0
    for i, c in by_words.items():
        a, b = texts[i], texts[c]
        if i != c and a and b and abs(len(a) - len(b)) < 50 and edit_distance(a, b) <= 0.002 * max(len(a), len(b)):
            close += 1
            found += by_walk[i] == by_walk[c]
    assert close >= 20 and found >= 0.9 * close
    for i, c in by_walk.items():
        if i != c:
            assert edit_distance(texts[i], texts[c]) <= 0.1 * max(len(texts[i]), len(texts[c])) + 1


def test_edit_distance():
    r = np.random.default_rng(2)
    for _ in range(60):
        a, b = ("".join(r.choice(list("abc"), r.integers(1, 30))) for _ in range(2))
        assert edit_distance(a, b) == plain_distance(a, b)


def test_planted_vectors(spark):
    """Groups of vectors at cosines around the threshold: links found of those that brute force finds."""
    r = np.random.default_rng(8)
    base = r.standard_normal((250, 64))
    x = np.vstack([b + r.standard_normal((8, 64)) * r.uniform(0.1, 0.3) for b in base])
    label = r.integers(0, 3, len(x))
    rows = [(i, [float(v) for v in e], int(k)) for i, (e, k) in enumerate(zip(x, label, strict=True))]
    out = {v.vec_id: v for v in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    hit = (unit @ unit.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(hit, False)
    n = hit.sum(1)
    got = np.array([out[i].n_links for i in range(len(x))])
    assert n.sum() > 1500 and (got <= n).all() and got.sum() >= 0.99 * n.sum()
    want = roots(len(x), [(int(a), int(b)) for a, b in np.argwhere(hit)])
    assert sum(out[i].component_id == want[i] for i in range(len(x))) >= 0.99 * len(x)
