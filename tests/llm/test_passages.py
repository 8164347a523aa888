"""Passages of more than 50 words that documents share, most of them shorter than 400 bytes."""

import random

import pytest

import corpus_pipeline
from docloom.llm import passages, repeats

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def writer(seed):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("etaoinshrdlué") for _ in range(r.randint(2, 7))) for _ in range(3000)]
    return r, lambda n: [r.choice(vocabulary) for _ in range(n)]


def brute_spans(texts, words):
    """Byte spans (start, end) of the runs of so many words that another text has."""
    places = []
    for t in texts:
        raw, at = t.encode(), 0
        places.append([])
        for w in raw.split():
            start = raw.index(w, at)
            at = start + len(w)
            places[-1].append((w, start, at))
    holders = {}
    for k, p in enumerate(places):
        for i in range(len(p) - words + 1):
            holders.setdefault(tuple(w for w, *_ in p[i : i + words]), set()).add(k)
    return [{(p[i][1], p[i + words - 1][2]) for i in range(len(p) - words + 1) if len(holders[tuple(w for w, *_ in p[i : i + words])]) > 1} for p in places]


@pytest.mark.parametrize("words", [1, 5, 16, 51])
def test_shared_runs(spark, words):
    r, text = writer(4)
    planted = [text(n) for n in (words - 1, words, words + 1, 2 * words + 3, 120)]
    texts = ["", " \t\n", "one", *["".join(w + r.choice([" ", "\n", "\t ", " \r\n"]) for w in text(r.randint(0, 2)) + r.choice(planted) + text(r.randint(0, 40))) for _ in range(60)]]
    texts += [" ".join(2 * text(words + 9)), texts[5]]  # repeated within one text only; a repeated row
    rows = [(0, k if k < len(texts) - 1 else 5, 0, t) for k, t in enumerate(texts)]
    out, _ = passages.shared_runs(spark.createDataFrame(rows, "d long, x long, y long, text string"), words)
    got = {}
    for x in out.collect():
        got.setdefault(x.x, set()).add((x.span >> 32, x.span & 0xFFFFFFFF))
    assert got == {k: s for k, s in enumerate(brute_spans(texts, words)[:-1]) if s}


def test_pipeline_removes_passages_of_over_50_words(spark, tmp_path):
    r, text = writer(6)
    gone, kept = [text(n) for n in (51, 52, 56, 60)], text(50)
    assert all(len(" ".join(p).encode()) < 400 for p in gone)
    rows, want = [], {}
    for k in range(16):
        own, passage = text(r.randint(80, 200)), [*gone, kept, []][k % 6]
        at = r.randint(1, len(own) - 1)
        rows.append((k, " ".join([*own[:at], *passage, *own[at:]]), "en", "a", None))
        want[k] = [*own[:at], *(passage if passage is kept else []), *own[at:]]
    own = text(60)
    rows += [(20, " ".join(own + ["x"] + own[:55]), "en", "a", None), (21, None, "en", "a", None), (22, "", "en", "a", None)]
    want |= {20: own + ["x"] + own[:55], 21: [], 22: []}
    docs = spark.createDataFrame(rows, SCHEMA)
    out = corpus_pipeline.remove_repeated_passages(spark, docs, str(tmp_path)).collect()
    got = {x.doc_id: x.text.split() for x in out}
    for x in out:
        assert got[x.doc_id] == want[x.doc_id] and x.n_chars == len(x.text)
    assert len(out) == len(rows)
    assert corpus_pipeline.remove_repeated_passages(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_both_kinds_are_judged_on_the_input(spark):
    """A passage that a longer repeated string overlaps goes as a whole, and a lone long word goes by its bytes."""
    _, text = writer(8)
    a, b, c, long = text(30), text(30), text(90), "z" * 450
    texts = [" ".join(p) for p in (["1", *a, *b, "2"], ["3", *b, *c, "4"], ["5", *a, *b, *c, "6"], ["7", long, "8"], ["9", long, "10"])]
    out = repeats.without_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), words=51).collect()
    assert ["".join(x.text.split()) for x in sorted(out)] == ["12", "34", "56", "78", "910"]
