"""Corpus operators against brute force on small tables, with nulls, empty and repeated rows and clashing names."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from docloom.llm import cluster, common, fingerprint, html_tree, language, mixing, near, pages, pieces, quality, repeats, vectors, warc
from docloom.llm.suffixes import LoserTree, common_prefix, decode, front_code

DOC = "doc_id long, text string, source string, lang string, n_chars long, key string, h string, d long, n long, x int, size long, rank int, copy int, words int, taken long, cuts string, own string, row string, node long"
CLASHING = (0, "k", "h", 1, 2, 3, 78, 5, 6, 7, 8, "c", "o", "r", 9)


def table(spark, rows):
    """(doc_id, text, source, lang), with columns whose names the operators use inside."""
    return spark.createDataFrame([(*r, *CLASHING) for r in rows], DOC)


def own_columns(row):
    return tuple(row)[5:] == CLASHING[1:]


def roots(n, links):
    root = list(range(n))
    for _ in range(n):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    return root


def test_components(spark):
    r = random.Random(3)
    links = [(r.randrange(60), r.randrange(60)) for _ in range(40)] + [(k, k + 1) for k in range(60, 90)] + [(95, x) for x in range(96, 99)]
    edges = spark.createDataFrame([*links, (None, 3), (4, 4)], "a long, b long")
    got = {x.node: x.root for x in common.components(edges).collect()}
    want = roots(99, links)
    assert got == {k: want[k] for a, b in links if a != b for k in (a, b)}
    assert common.components(edges.limit(0)).count() == 0


def brute_repeats(texts, size):
    seen = Counter(t[i : i + size] for t in texts for i in range(len(t) - size + 1))
    out = []
    for t in texts:
        cover = [False] * len(t)
        for k in range(len(t) - size + 1):
            if seen[t[k : k + size]] > 1:
                cover[k : k + size] = [True] * size
        spans = sum(c and not (k and cover[k - 1]) for k, c in enumerate(cover))
        out.append((len(t), sum(cover), spans, hashlib.sha256(bytes(b for b, c in zip(t, cover, strict=True) if not c)).hexdigest()))
    return out


@pytest.mark.parametrize("group", [4096, 2])
def test_repeats(spark, group):
    r = random.Random(5)
    base = ["".join(r.choice("abcdefg ") for _ in range(90)) for _ in range(4)]
    texts = [None, "", "é" * 70, "x" * 200]
    for _ in range(120):
        parts = ["".join(r.choice("abcdefg ") for _ in range(r.randint(0, 40)))]
        for _ in range(r.randint(0, 2)):
            b = base[0] if r.random() < 0.6 else r.choice(base)
            parts.append(b[r.randint(0, 40) : r.randint(50, 90)] + r.choice("xyz"))
        texts.append("".join(parts))
    rows = [(i, t, "s", "en") for i, t in enumerate(texts)] + [(7, texts[7], "s", "en"), (None, texts[8], "s", "en")]
    out = repeats.remove_repeats(table(spark, rows), length=40, gram=8, group=group).collect()
    want = brute_repeats([(t or "").encode() for _, t, *_ in rows], 40)
    assert sorted(tuple(x)[1:5] for x in out) == sorted(want)
    assert all(hashlib.sha256(x.kept_text.encode()).hexdigest() == x.kept_sha256 for x in out if "é" not in (texts[x.doc_id or 0] or ""))
    assert repeats.remove_repeats(table(spark, rows).limit(0)).count() == 0
    kept = repeats.without_repeats(table(spark, rows), length=40, gram=8, group=group).collect()
    assert all(own_columns(x) and x.n_chars == len(x.text) for x in kept)
    assert sorted((str(x.doc_id), x.text) for x in kept) == sorted((str(x.doc_id), x.kept_text) for x in out)


def test_repeats_in_a_long_text(spark):
    r = random.Random(25)
    long = "".join(r.choice("abcdefghijklmnop ") for _ in range(1_300_000))
    rows = [(1, long, "s", "en"), (2, "x" + long[700_000:700_600] + "y", "s", "en"), (3, long[:300], "s", "en")]
    out = {x.doc_id: x for x in repeats.remove_repeats(table(spark, rows)).collect()}
    assert (out[1].n_removed, out[1].n_spans, out[2].kept_text, out[3].n_removed) == (600, 1, "xy", 0)


def test_loser_tree():
    r = random.Random(1)
    items = [("".join(r.choice("ab") for _ in range(r.randint(0, 9))).encode(), 0, bytes(16), 1) for _ in range(300)]
    runs = [sorted(items[k::7]) for k in range(7)]
    out = list(LoserTree([decode(list(front_code(x))) for x in runs]))
    assert [i[0] for _, i in out] == sorted(i[0] for i in items)
    assert all(p == common_prefix(a[0], b[0]) for (_, a), (p, b) in zip(out, out[1:], strict=False))


def test_pieces(spark):
    v = pieces.load()
    e = pieces.Encoder(v)

    def brute(s, n):
        s, out = " " + s, []

        def go(i, score, ids):
            if i == len(s):
                out.append((score, ids))
                return
            hits = [(j, v.pieces[s[i:j]]) for j in range(i + 1, len(s) + 1) if s[i:j] in v.pieces]
            for j, h in hits:
                go(j, score + h[1], [*ids, h[0]])
            if not hits or hits[0][0] != i + 1:
                raw = s[i].encode()
                go(i + 1, score + v.byte_score * len(raw), ids + [v.byte_ids[b] for b in raw])

        go(0, 0.0, [])
        return sorted(out, key=lambda x: -x[0])[:n]

    for s in ("a", "the cat", "in, on", "x\n漢y", "▁ b", "  z", "aaaaaa"):
        got, want = e.nbest_ids(s), brute(s, pieces.NBEST)
        assert np.allclose([x for x, _ in got], [x for x, _ in want])
        assert len({tuple(i) for _, i in got}) == len(got)
        assert all(e.decoder.texts(np.array(i), np.array([0, len(i)])) == [s] for _, i in got)
    rows = [(1, "Hello, world", "s", "en"), (2, None, "s", "en"), (3, "", "s", "en"), (None, "▁\x00", "s", "en"), (1, "Hello, world", "s", "en"), (9, "漢字" * 90 + "b" * 200, "s", "en")]
    df = pieces.encode(table(spark, rows))
    out = df.collect()
    assert all(x.round_trip and len(x.scores) == 1 + len(x.others) for x in out) and [x.n_pieces for x in out if x.doc_id in (2, 3)] == [0, 0]
    for x in out:
        text = next(t or "" for i, t, *_ in rows if i == x.doc_id)
        assert [x.pieces, *x.others] == [i for _, i in e.nbest_ids(text)] and np.allclose(x.scores, [s for s, _ in e.nbest_ids(text)])
    again = {(x.doc_id, x.text) for x in pieces.decode(df).collect()}
    assert again == {(i, t or "") for i, t, *_ in rows}
    second = df.selectExpr("doc_id", "get(others, 0) as ids").where("ids is not null")
    assert {(x.doc_id, x.text) for x in pieces.decode(second, "ids").collect()} == {(i, t) for i, t, *_ in rows if t and i is not None}
    odd = spark.createDataFrame([(1, None), (2, []), (3, [None, -5, 10**6, 1])], "doc_id long, pieces array<int>")
    assert {x.doc_id: x.text for x in pieces.decode(odd).collect()} == {1: None, 2: "", 3: ""}
    assert pieces.encode(table(spark, rows).limit(0)).count() == pieces.decode(odd.limit(0)).count() == 0


def test_pieces_of_a_long_text():
    e = pieces.Encoder(pieces.load())
    r = random.Random(4)
    text = " ".join("".join(r.choice("etaoinshr") for _ in range(r.randint(1, 9))) for _ in range(200_000)) + "漢" * 100_000
    ids, offsets, best = e.encode([text, "a"])
    assert e.decoder.texts(ids, offsets) == [text, "a"]
    assert all(e.decoder.texts(x, np.array([0, len(x)])) == [text] for _, x in best[0]) and len(best[0]) == pieces.NBEST
    assert all(a[0] >= b[0] for a, b in zip(best[0], best[0][1:], strict=False))


def test_parts_of_a_long_word_are_independent():
    v = pieces.load()
    for word in ("internationalisation" * 5, "漢字b" * 30, "0x" * 40 + "\n" * 3):
        parts = pieces.independent(v, word)
        assert "".join(parts) == word
        whole = [s for s, _ in pieces.word_paths(v, word, 1)]
        assert np.allclose(whole, sum(pieces.word_paths(v, p, 1)[0][0] for p in parts))


def test_mix(spark):
    r = random.Random(2)
    rows = [(i, " ".join("w" * r.randint(1, 60)), r.choice(["a", "a", "a", "b", "c", None]), "en") for i in range(200)]
    rows += [(3, "w w", "a", "en"), (None, "w", "b", "en"), (None, None, "c", "en"), (500, "", "d", "en")]
    out = mixing.mix(table(spark, rows), with_source=True).collect()
    assert len(out) == len(rows)
    assert sum(x.taken for x in out) == sum(x.size for x in out)
    assert all(0 <= x.taken <= 3 * x.size for x in out)
    taken = Counter()
    for x in out:
        taken[x.source] += x.taken
    assert all(abs(taken[x.source] - x.target) <= 70 for x in out)
    assert sorted(map(tuple, out), key=repr) == sorted(map(tuple, mixing.mix(table(spark, rows), with_source=True).collect()), key=repr)
    assert mixing.mix(table(spark, rows).limit(0)).count() == 0
    copies = mixing.copies_taken(table(spark, rows))
    words = copies.select("text").toPandas()["text"].map(lambda t: len(t.split())).sum()
    assert words == sum(x.taken for x in out)
    kept = copies.collect()
    assert all(own_columns(x) and x.n_chars == len(x.text) for x in kept)
    count = Counter((x.doc_id, x.source) for x in kept)
    assert all(n <= 3 * sum(x.doc_id == k[0] and x.source == k[1] for x in out) for k, n in count.items())
    assert mixing.copies_taken(table(spark, rows).limit(0)).count() == 0


def test_near_documents(spark):
    r = random.Random(4)
    words = ["".join(r.choice("abcdefghij") for _ in range(4)) for _ in range(400)]
    bases = [[r.choice(words) for _ in range(r.randint(30, 90))] for _ in range(12)]
    texts = []
    for b in bases:
        for _ in range(8):
            c = list(b)
            for _ in range(r.randint(0, 4)):
                c[r.randrange(len(c))] = r.choice(words)
            texts.append(" ".join(c))
    rows = [(i, t, "s", "en") for i, t in enumerate(texts)] + [(900, "", "s", "en"), (901, "", "s", "en"), (902, None, "s", "en"), (None, texts[0], "s", "en"), (903, " ", "s", "en")]
    hashes = near.WordHashes()
    seq = [near.labelled(near.shingles(t, hashes)) for t in texts]
    sim = lambda a, b: len(set(a.tolist()) & set(b.tolist())) / len(set(a.tolist()) | set(b.tolist()))
    links = [(i, j) for i in range(len(texts)) for j in range(i) if texts[i] == texts[j] or sim(seq[i], seq[j]) >= 0.8]
    want = roots(len(texts), links)
    got = {x.doc_id: x.class_id for x in near.near_duplicates(table(spark, rows)).collect()}
    assert [got[i] for i in range(len(texts))] == want
    assert (got[900], got[901], got[902], got[903], got[None]) == (900, 900, 902, 903, None)
    assert near.near_duplicates(table(spark, rows).limit(0)).count() == 0


def test_near_short_documents(spark):
    r = random.Random(14)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    texts = []
    for k in range(160):
        t = [word() for _ in range((9, 10, 14, 8)[k % 4])]  # 5, 6, 10 and 4 shingles
        texts += [t, t[1:] if k % 8 < 4 else t[:-1]]
        texts += [t[1:-1]] if k % 4 == 2 else []
    texts.append(["a"] * 9)
    texts.append(["a"] * 8)
    hashes = near.WordHashes()
    seq = [near.shingles(" ".join(t), hashes) for t in texts]
    n = len(texts)
    links = [(i, j) for i in range(n) for j in range(i) if near.aligned(seq[i], seq[j])]
    assert len(links) >= 40 + 40 + 3 * 40 + 1
    out = near.near_duplicates(table(spark, [(i, " ".join(t), "s", "en") for i, t in enumerate(texts)])).collect()
    got = {x.doc_id: x.class_id for x in out}
    assert [got[i] for i in range(n)] == roots(n, links)


def test_labels_of_repeats_do_not_part_texts(spark):
    """A text with one shingle repeated shares sketches with a copy in which nothing repeats."""
    hashes = near.WordHashes()
    words = [f"w{k}" for k in range(120)]
    again = [*words[:5], *words]
    a, b = (near.shingles(" ".join(t), hashes) for t in (words, again))
    assert set(near.sketches(near.labelled(a))) & set(near.sketches(near.labelled(b)))


def test_near_rows_that_share_ids(spark):
    r = random.Random(15)
    text = lambda n=60: [f"w{r.randrange(500)}" for _ in range(n)]
    one, two = text(), text()
    near_one = [*one[:30], "x", *one[31:]]
    join = " ".join
    rows = [(1, join(one)), (1, join(two)), (2, join(near_one)), (None, join(one)), (None, join(near_one)), (3, None), (3, None), (4, join(two)), (4, join(two)), (5, ""), (6, ""), (0, "short text")]
    got = near.deduplicated(table(spark, [(*x, "s", "en") for x in rows])).collect()
    assert sorted((str(x.doc_id), str(x.text)) for x in got) == sorted([("1", join(one)), ("1", join(two)), ("3", "None"), ("3", "None"), ("5", ""), ("0", "short text")])
    assert all(own_columns(x) for x in got)
    out = Counter((x.doc_id, x.class_id, x.kept) for x in near.near_duplicates(table(spark, [(*x, "s", "en") for x in rows])).collect())
    assert out == Counter([(1, 1, True), (1, 1, True), (2, 1, False), (None, None, True), (None, None, True), (3, 3, True), (3, 3, True), (4, 1, False), (4, 1, False), (5, 5, True), (6, 5, False), (0, 0, True)])
    long = " ".join(f"w{k}" for k in range(250_000))
    rows = [(1, long), (2, long.replace("w17 ", "y ")), (3, "w1 w2 w3 w4 w5 w6")]
    assert {x.doc_id: x.class_id for x in near.near_duplicates(table(spark, [(*x, "s", "en") for x in rows])).collect()} == {1: 1, 2: 1, 3: 3}
    assert near.deduplicated(table(spark, []).limit(0)).count() == 0


def test_classes_over_blocks(spark):
    """Members of a bucket are linked if close, over blocks of a few: chains that go from block to block, and several classes in one bucket."""
    r = random.Random(5)
    value = {k: r.randrange(1000) for k in range(150)}
    members = [(1, k, 1) for k in range(120)] + [(2, k, 1) for k in range(100, 150)] + [(3, k, 1) for k in range(100, 150)]

    def make():
        def compare(payloads):
            v = np.array([p[0] for p in payloads])
            return np.abs(v[:, None] - v[None, :]) <= 6, lambda i, j: abs(int(v[i]) - int(v[j])) <= 6

        return compare

    links = [(a, b) for a in range(150) for b in range(a) if abs(value[a] - value[b]) <= 6 and ((a < 120 and b < 120) or (a >= 100 and b >= 100))]
    want = roots(150, links)
    df = spark.createDataFrame(members, "bucket long, node long, size long")
    payload = spark.createDataFrame(list(value.items()), "node long, value int")
    got = {x.node: x.root for x in cluster.linked_classes(df, payload, make, block=7).collect()}
    assert [got.get(k, k) for k in range(150)] == want and len(set(want)) > 5
    assert cluster.linked_classes(df.limit(0), payload, make).count() == 0


def test_common_counts():
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 60, r.integers(0, 40))).astype(np.uint64) for _ in range(70)]
    got = near.common_counts(sets)
    assert all(got[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(70) for j in range(i + 1, 70))


def test_alignment_keeps_order():
    a = np.arange(100, dtype=np.uint64)
    assert near.aligned(a, np.delete(a, [3, 50]))
    assert not near.aligned(a, np.concatenate([a[50:], a[:50]]))


def test_vectors(spark):
    r = np.random.default_rng(3)
    base = r.standard_normal((12, 16))
    x = np.vstack([b + r.standard_normal((20, 16)) * 0.22 for b in base]).astype(np.float32)
    label = [int(k) for k in r.integers(0, 2, len(x))]
    rows = [(i, [float(v) for v in e], k) for i, (e, k) in enumerate(zip(x, label, strict=True))]
    rows += [(300, rows[0][1], rows[0][2]), (301, [0.0] * 16, 0), (302, None, 0), (303, [float("nan")] * 16, 0), (304, rows[1][1], None), (305, [None] * 16, 1)]
    df = spark.createDataFrame([(*t, "x") for t in rows], "vec_id long, embedding array<float>, label int, sig string")
    unit = np.array([t[1] for t in rows[:241]], float)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    same = np.array([t[2] for t in rows[:241]])
    near_ = (unit @ unit.T >= 0.93) & (same[:, None] == same[None, :])
    np.fill_diagonal(near_, False)
    out = {v.vec_id: v for v in vectors.near_vectors(df, block=7).collect()}
    got = np.array([out[t[0]].n_links for t in rows[:241]])
    assert near_.sum() > 500 and abs(got.sum() - near_.sum()) <= 0.01 * near_.sum() and (got <= near_.sum(1)).all()
    assert all(out[k].n_links == 0 and out[k].kept for k in range(301, 306))
    assert vectors.near_vectors(df.limit(0)).count() == 0


def test_pages(spark):
    model = pages.trained()
    html = '<html><head><title>T</title></head><body><nav><ul><li><a href="/">Home</a></ul></nav><article><h1>A title</h1><p>First &amp; one,\n  long enough to be a text of its own, with words.<p>Second block of the same text, also of some length.</p><div class="ad">Buy now</div></article><div class="comments"><p>I liked this one.</p></div><footer>&copy; x</footer></body></html>'
    df = spark.createDataFrame([(1, "u", html, 5), (2, None, None, 5), (None, "u", "", 5), (3, "u", "<p><<b", 5)], "page_id long, url string, html string, text int")
    got = {x.page_id: x.text for x in pages.main_text(df, model).collect()}
    assert got[1] == "A title\n\nFirst & one, long enough to be a text of its own, with words.\n\nSecond block of the same text, also of some length."
    assert got[2] == got[None] == ""


def test_decoding_is_the_best_labelling_without_contradiction():
    from itertools import product

    r = np.random.default_rng(1)
    for _ in range(40):
        n = int(r.integers(2, 8))
        parents = [-1] + [int(r.integers(0, k)) for k in range(1, n)]
        p, weight = r.random(n), 1 + 3 * r.random(n)

        def worth(label, parents=parents, p=p, weight=weight):
            """label: 0 outside, 1 main, 2 boilerplate within a main part; None if it contradicts its parent's."""
            total = 0.0
            for k, x in enumerate(label):
                up = label[parents[k]] if k else 0
                if (up == 0 and x == 2) or (up == 1 and x == 0) or (up == 2 and x != 2):
                    return None
                total += weight[k] * float(np.log(p[k]) if x == 1 else np.log1p(-p[k]))
                total -= pages.START * (up == 0 and x == 1) + pages.SWITCH * (up == 1 and x == 2)
            return total

        best = max((w, x) for x in product(range(3), repeat=n) if (w := worth(x)) is not None)
        assert pages.decode(parents, p, weight) == [v == 1 for v in best[1]]


def test_held_out_pages(spark):
    """Pages of another seed than the trained ones: nearly all texts are the article's, word for word."""
    model = pages.trained()
    grammar = pages.Grammar(seed=77)
    exact, overlap = 0, []
    for _ in range(120):
        page = grammar.page()
        nodes, _, _ = pages.describe(html_tree.parse(page))
        want = pages.print_blocks(nodes, [node.judge == "1" for node in nodes])
        got = pages.extract(page, model)
        exact += got == want
        a, b = Counter(got.split()), Counter(want.split())
        overlap.append(2 * sum((a & b).values()) / max(1, sum(a.values()) + sum(b.values())) if a or b else 1.0)
    assert exact >= 100 and np.mean(overlap) > 0.94


def test_hostile_pages_take_linear_time():
    import time

    for part in ('<a "', "</b>", "<b>", "<div>", "<ul><div>", "<li>", '<a "> "', "<!", "<a b=", "x", "<svg>", "</svg>", "<i><div>", "<p><b>", "&lt", '<p class="a', "<td><table>"):
        page = "<p>begin</p>" + part * 60_000
        start = time.time()
        html_tree.parse(page)
        assert time.time() - start < 12, part
    html_tree.parse("<p " + "a" * 1_000_000 + ">t</p>")
    root = html_tree.parse("<div>" * 3000 + "deep" + "</div>" * 3000 + "<p>after</p>")
    assert [x.tag for x in root.items] == ["div", "p"] and root.items[1].items == ["after"]


def test_language(spark):
    r = random.Random(1)
    make = lambda words: " ".join(r.choice(words) for _ in range(30))
    one, two = ["hello", "world", "thing"], ["bonjour", "monde", "chose"]
    rows = [(i, make(one if i % 2 else two), "s", "en" if i % 2 else "fr") for i in range(100)]
    rows += [(200, None, "s", "en"), (201, "123 !", "s", None), (None, "worlds", "s", None), (202, "hello", "s", None)]
    out = {x.doc_id: x for x in language.identify(table(spark, rows)).collect()}
    assert all(out[i].lang_pred == ("en" if i % 2 else "fr") for i in range(100))
    assert out[200].lang_pred == out[201].lang_pred == "und" and out[None].lang_pred == out[202].lang_pred == "en"
    kept = {x.doc_id: x.lang for x in language.accepted(table(spark, rows)).collect()}
    assert 200 not in kept and 201 not in kept and kept[202] == "en"
    assert language.identify(table(spark, rows).limit(0)).count() == 0


def test_language_rejects_and_keeps(spark):
    r = random.Random(3)
    letters = {"en": "etaoinshrdlu", "fr": "esaitnrulodc", "xx": "zkwyvqjbpmgf"}
    vocabulary = {k: ["".join(r.choice(v) for _ in range(r.randint(2, 9))) for _ in range(400)] for k, v in letters.items()}
    make = lambda k: " ".join(r.choice(vocabulary[k]) for _ in range(80))
    rows = [(i, make("en"), "s", "en") for i in range(300)] + [(300 + i, make("fr"), "s", "fr") for i in range(300)] + [(600 + i, make("xx"), "s", "xx") for i in range(12)]
    rows += [(1000 + i, " ".join("".join(r.choice("абвгдежзик") for _ in range(6)) for _ in range(50)), "s", None) for i in range(20)]
    out = {x.doc_id: x for x in language.identify(table(spark, rows)).collect()}
    assert all(out[i].lang_pred == lang and not out[i].rejected for i, _, _, lang in rows if i < 1000)
    assert all(out[1000 + i].rejected for i in range(20))
    model = language.fit(table(spark, rows))
    learned = {w for i, t, _, lang in rows if lang and not out[i].held_out for w in t.split()}
    assert learned <= set(model["places"][0])  # nothing that the sample holds is cut away
    long = " ".join(vocabulary["fr"] * 400)
    assert language.identify(table(spark, [(1, long, "s", None)]), model).first().lang_pred == "fr"


def test_fingerprints(spark):
    r = random.Random(6)
    texts = [None, "", "ab", "abc"] + ["".join(r.choice("abcdefgh é") for _ in range(r.randint(3, 400))) for _ in range(30)]
    rows = [(i, t, "s", "en") for i, t in enumerate(texts)] + [(100, texts[9], "s", "en")]
    out = {x.doc_id: x for x in fingerprint.fingerprints(table(spark, rows)).collect()}
    order = sorted(((i, t or "") for i, t, *_ in rows), reverse=True)
    for (i, t), (j, after) in zip(order, order[1:] + order[:1], strict=True):
        x = out[i]
        assert x.n_chars == len(t) and x.edited_sha256 == hashlib.sha256(fingerprint.edited(t, after).encode()).hexdigest()
        assert x.near_next == fingerprint.likeness(x.fingerprint, out[j].fingerprint) and 0 <= x.near_edited <= 1
    assert out[100].fingerprint == out[9].fingerprint
    assert np.mean([out[i].near_edited for i in range(4, 34)]) > np.mean([out[i].near_next for i in range(4, 34)]) + 0.3
    assert fingerprint.fingerprints(table(spark, rows).limit(0)).count() == 0


def test_fingerprint_classes(spark):
    r = random.Random(16)
    texts = ["".join(r.choice("abcdefgh é") for _ in range(r.randint(1, 900))) for _ in range(40)] + [None, ""]
    copies = []
    for k, t in enumerate(texts[:40]):
        at = r.randrange(len(t))
        copies.append(t[:at] + r.choice(["", "x", "yz"]) + t[at + 1 :] if k % 3 else t)  # none of them next to its source by doc_id
    rows = [(i, t, "s", "en") for i, t in enumerate(texts + copies)] + [(5, texts[5], "s", "en"), (None, texts[7], "s", "en"), (None, "q" * 50, "s", "en")]
    bands = fingerprint.Bands()
    out = fingerprint.fingerprints(table(spark, rows)).collect()
    found = {x.doc_id: x for x in out}
    steps = []
    for t in texts + copies:
        ends = bands.walker.ends(fingerprint.classes(fingerprint.code_points(t or "")))
        steps.append(ends[-1] if ends else 0)
    n = len(steps)
    links = [(i, j) for i in range(n) for j in range(i) if bands.alike(found[i].fingerprint, steps[i], found[j].fingerprint, steps[j])]
    assert sum(j < 40 and i == j + 42 for i, j in links) > 25
    assert [found[i].class_id for i in range(n)] == roots(n, links)
    assert sorted([x.class_id for x in out if x.doc_id is None], key=str) == [found[7].class_id, None] and len(out) == len(rows)


def test_quality(spark):
    r = random.Random(8)
    good = lambda: " ".join("".join(r.choice("abcdefg") for _ in range(r.randint(2, 8))) for _ in range(60))
    rows = [(i, good() if i % 4 else good().upper() + "!!!", "s", "en") for i in range(160)] + [(None, None, "s", "en"), (500, "", "s", "en")]
    labels = spark.createDataFrame([(i, 1 if i % 4 else 0, 0) for i in range(160)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    out = {x.doc_id: x for x in quality.score(table(spark, rows), labels).collect()}
    held = [i for i in range(160) if out[i].held_out]
    assert held and all(out[i].predicted == (1 if i % 4 else 0) for i in held)
    assert all(0 <= x.score <= 1 for x in out.values())
    assert quality.score(table(spark, rows[:3])).first().score == 0.5
    assert quality.score(table(spark, rows).limit(0), labels).count() == 0
    long = good() * 4000
    few = quality.fit(table(spark, [*rows, (4, long, "s", "en"), (7, rows[7][1], "s", "en"), (7, "other", "s", "en")]), labels, numbers=40 * quality.FEATURES)
    assert np.isfinite(few.p["W"]).all()  # the long text doesn't fit the bound, others do
    assert 0 <= quality.score(table(spark, [(1, long, "s", "en")]), network=few).first().score <= 1


def test_revisits(spark):
    r = random.Random(9)
    kinds = ["http://www.Ex.org:80/a/?b=2&a=1&utm_x=1#f", "https://ex.org/a?a=1&b=2", "https://ex.org/c"]
    rows = []
    for i in range(300):
        u = kinds[0 if r.random() < 0.3 else 1 if r.random() < 0.8 else 2]
        revisit = r.random() < 0.5
        h = {"etag": f'"{r.randint(0, 1)}"', "x": str(i), "content-length": "9"} if r.random() < 0.9 else None
        rows.append((i, "revisit" if revisit else "response", u, r.randint(0, 40), h, None if revisit else f"d{i}", i))
    rows += [(900, "revisit", None, 1, None, None, 0), (901, "revisit", "https://none/", 1, None, None, 0), (902, "metadata", kinds[0], 1, None, None, 0)]
    df = spark.createDataFrame(rows, "record_id long, type string, url string, ts int, headers map<string,string>, digest string, n_bytes long")
    got = {x.record_id: x for x in warc.resolve_revisits(df).collect()}
    name = {kinds[0]: 0, kinds[1]: 0, kinds[2]: 1}
    for i, kind, u, ts, h, *_ in rows[:300]:
        if kind != "revisit":
            continue
        before = [x for x in rows[:300] if x[1] == "response" and name[x[2]] == name[u] and (x[3], x[0]) < (ts, i)]
        base = max(before, key=lambda x: (x[3], x[0]), default=None)
        x = got[i]
        assert x.refers_to == (base[0] if base else None)
        old = (base[4] or {}) if base else {}
        status = "missing" if base is None else "unverified" if not h else "resolved" if h["etag"] == old.get("etag") else "mismatch"
        assert x.status == status
        if status in ("resolved", "unverified"):
            assert x.digest == base[5] and x.headers == old | {k: v for k, v in (h or {}).items() if k != "content-length"}
    assert got[900].status == got[901].status == "missing" and 902 not in got
    twice = warc.resolve_revisits(df.union(df)).collect()
    assert len(twice) == 2 * len(got) and all(got[x.record_id] == x for x in twice)
    assert warc.resolve_revisits(df.limit(0)).count() == 0
    alone = warc.resolve_revisits(df.where("type = 'revisit'")).collect()
    assert len(alone) == len(got) and all(x.status == "missing" for x in alone)


def test_damaged_warc():
    good = warc.record_bytes("response", "http://a/", "2020-01-01T00:00:00Z", "urn:1", b"HTTP/1.1 200 OK\r\n\r\nhi")
    bad = good.replace(b"Content-Length: 21", b"Content-Length: many")
    assert bad != good
    got = [x["block"] for x in warc.records_of(bad + good + b"junk\r\n" + good[:-12])]
    assert got == [b"HTTP/1.1 200 OK\r\n\r\nhi"] * 2 + [b"HTTP/1.1 200 "]
    import gzip

    packed = gzip.compress(good * 500) + gzip.compress(good)
    assert len(list(warc.records_of(packed[:-9]))) >= 1


def test_warc_round_trip(spark, tmp_path):
    import gzip

    full = warc.record_bytes("response", "http://a/", "2020-01-01T00:00:00Z", "urn:1", b'HTTP/1.1 200 OK\r\nETag: "1"\r\nContent-Length: 2\r\n\r\nhi')
    again = warc.record_bytes("revisit", "http://a/", "2020-01-02T00:00:00Z", "urn:2", b'HTTP/1.1 304 Not Modified\r\nETag: "1"\r\nX-A: b\r\n\r\n', {"WARC-Profile": warc.NOT_MODIFIED[0]})
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(full) + gzip.compress(again))
    out = warc.resolve_revisits(warc.read_warc(spark, str(tmp_path))).first()
    assert out.status == "resolved" and out.refers_to == "urn:1" and out.headers == {"etag": '"1"', "content-length": "2", "x-a": "b"} and out.n_bytes == 2


def test_revisits_refer_to_full_responses(spark, tmp_path):
    parts = []
    for k, line in enumerate(("200 OK", "206 Partial Content", "404 Not Found", "503 Service Unavailable", "304 Not Modified")):
        parts.append(warc.record_bytes("response", "http://a/", f"2020-01-0{k + 1}T00:00:00Z", f"urn:{k}", f'HTTP/1.1 {line}\r\nETag: "{k}"\r\n\r\nb{k}'.encode()))
    parts.append(warc.record_bytes("response", "dns:a", "2020-01-01T00:00:00Z", "urn:dns", b"a. 1 IN A 1.2.3.4"))
    parts.append(warc.record_bytes("revisit", "http://a/", "2020-01-09T00:00:00Z", "urn:9", b'HTTP/1.1 304 Not Modified\r\nETag: "0"\r\n\r\n', {"WARC-Profile": warc.NOT_MODIFIED[0]}))
    (tmp_path / "a.warc").write_bytes(b"".join(parts))
    records = warc.read_warc(spark, str(tmp_path))
    assert {r.record_id: r.http_status for r in records.collect()} == {"urn:0": 200, "urn:1": 206, "urn:2": 404, "urn:3": 503, "urn:4": 304, "urn:dns": None, "urn:9": 304}
    out = warc.resolve_revisits(records).first()
    assert out.status == "resolved" and out.refers_to == "urn:0" and out.headers == {"etag": '"0"'} and out.n_bytes == 2
