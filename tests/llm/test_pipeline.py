"""The pipeline, stage by stage, against brute force on a small table."""

import hashlib
import random
from collections import Counter

import pytest

import corpus_pipeline
from docloom.llm import near, pieces

from test_operators import brute_repeats, roots

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents():
    r = random.Random(11)
    letters = {"en": "etaoinshrdlu", "fr": "esaitnrulodc"}
    words = {k: ["".join(r.choice(v) for _ in range(r.randint(3, 8))) for _ in range(500)] for k, v in letters.items()}
    text = lambda lang, n: [r.choice(words[lang]) for _ in range(n)]
    passage = text("en", 110)  # more than 400 bytes
    assert len(" ".join(passage)) > 450
    rows = []

    def add(words_, lang, source, i=None):
        t = words_ if words_ is None or isinstance(words_, str) else " ".join(words_)
        rows.append((len(rows) if i is None else i, t, lang, source, None if t is None else len(t)))

    for k in range(40):
        lang = "en" if k % 2 else "fr"
        base = text(lang, r.randint(20, 260))
        add(base, lang, r.choice(["a", "a", "b"]))
        if k % 4 == 0:  # a near copy and an exact one
            copy = list(base)
            copy[len(copy) // 2] = "changed"
            add(copy, lang, "b")
            add(base, None, "c")
    for k in range(4):  # different texts with one passage in common
        own = text("en", 300)
        add([*own[: 60 * k], *passage, *own[60 * k :]], "en", "d")
    add(None, "en", "a")
    add("", "en", "a")
    add("12 34 !", "en", "a")
    add("бвгд жзик лмнп рстф", None, "b")
    add(text("fr", 40), "fr", None)
    add(text("fr", 60), "fr", "a", i=3)  # an id that another text has
    add(rows[3][1], "en", "a", i=3)  # and the same row again
    return rows


def key(rows):
    return sorted(rows, key=repr)


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage got and returned, and what run() returns."""
    folder = str(tmp_path_factory.mktemp("data"))
    spark.createDataFrame(documents(), SCHEMA).write.parquet(f"{folder}/documents.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = [docs.collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, docs, folder)
        assert made.columns == docs.columns or k == len(corpus_pipeline.STAGES) - 1
        made.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out.append(docs.collect())
    return [[tuple(r) for r in rows] for rows in out], [tuple(r) for r in corpus_pipeline.run(spark, folder).collect()]


def test_names():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "repeated_passages", "source_mix", "pieces"]


def test_language(stages):
    before, after = stages[0][0], stages[0][1]
    gone = [r for r in before if r[1] is None or not any("a" <= c <= "z" for c in r[1])]
    assert len(gone) == 4 and key((r[0], r[1], r[3], r[4]) for r in after) == key((r[0], r[1], r[3], r[4]) for r in before if r not in gone)
    assert all(r[2] in ("en", "fr") for r in after)


def test_near_duplicates(stages):
    before, after = stages[0][1], stages[0][2]
    hashes = near.WordHashes()
    seq = [near.shingles(r[1], hashes) for r in before]
    links = [(i, j) for i in range(len(before)) for j in range(i) if before[i][1] == before[j][1] or near.aligned(seq[i], seq[j])]
    root = roots(len(before), links)
    first = {}
    for r, k in zip(before, root, strict=True):
        first[k] = min(first.get(k, r), r, key=lambda x: (x[0], hashlib.md5(x[1].encode()).hexdigest()))
    assert key(after) == key(first.values()) and len(after) < len(before) - 15


def test_repeated_passages(stages):
    before, after = stages[0][2], stages[0][3]
    raw = [r[1].encode() for r in before]
    want = brute_repeats(raw, 400)
    assert sum(w[1] > 0 for w in want) == 4
    got = [(r[0], len(r[1]), hashlib.sha256(r[1].encode()).hexdigest()) for r in after]
    assert key(got) == key((r[0], n - removed, digest) for r, (n, removed, _, digest) in zip(before, want, strict=True))
    assert all(r[4] == len(r[1]) for r in after)


def test_mix(stages):
    """Weighted fair queueing by hand: finish times, sorted over all sources, cut at the budget."""
    before, after = stages[0][3], stages[0][4]
    sources = sorted({r[3] for r in before}, key=lambda s: (s is None, s or ""))
    size = Counter()
    for r in before:
        size[r[3]] += len(r[1].split())
    weight = {s: k % 3 + 1 for k, s in enumerate(sources)}
    total, capped = sum(size.values()), {}
    while True:
        open_ = [s for s in sources if s not in capped]
        level = (total - sum(capped.values())) / sum(weight[s] for s in open_)
        over = [s for s in open_ if weight[s] * level > 3 * size[s]]
        if not over:
            break
        capped |= {s: 3 * size[s] for s in over}
    target = {s: capped.get(s, weight[s] * level) for s in sources}
    queue = []
    for s in sources:
        order = sorted((hashlib.md5(f"{r[0]}#mix".encode()).hexdigest(), r[0], len(r[1].split()), r) for r in before if r[3] == s)
        for copy in range(3):
            upto = copy * size[s]
            for h, i, n, r in order:
                upto += n
                queue.append((upto / target[s], h, i, n, copy, r))
    queue.sort(key=lambda q: q[:5])
    want, left = [], total
    for *_, n, _, r in queue:
        if left <= 0:
            break
        if n:
            text = r[1] if n <= left else " ".join(r[1].split()[:left])
            want.append((r[0], text, r[2], r[3], len(text)))
        left -= n
    assert key(after) == key(want)


def test_pieces_and_run(stages):
    steps, whole = stages
    encoder = pieces.Encoder(pieces.load())
    got = [(r[0], r[2], list(r[3])) for r in steps[5]]
    want = []
    for r in steps[4]:
        ids = encoder.nbest_ids(r[1])[0][1]
        want.append((r[0], len(ids), ids))
    assert key(got) == key(want)
    assert key(map(repr, whole)) == key(map(repr, steps[5]))
