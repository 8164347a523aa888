"""Operators over whole tables against plain Python: nulls, empty and repeated rows, ties, keys that hold all rows, clashing names."""

import datetime
import json
import math
import os
import random
import re
import time
from collections import Counter, OrderedDict
from difflib import get_close_matches

import pytest
from pyspark.sql import functions as F

from docloom import queries as q
from docloom import tables
from docloom.functions import fuzzy as fz
from docloom.operators import close_match, fuzzy_join, merging, nearest, people, ranges, relational, runs, selection

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def ordered(rows):
    return sorted(map(tuple, rows), key=repr)


NAMES = ["SCIENCE", "SOCIAL SCIENCE", "Maths II", "MATHEMATICS", "ring", "RING BOLT", "red", "gear", "are", "a", "ear", "anvil", "anvyl", "kannada 1", "computer", "x", "", "bolt", "bo", "olt b", "plate", "platen", "gizmo", "widget", "widgets"]


def bent(r, word):
    letters = list(word)
    for _ in range(r.randrange(3)):
        if letters and r.random() < 0.5:
            letters.pop(r.randrange(len(letters)))
        else:
            letters.insert(r.randrange(len(letters) + 1), r.choice("abcde xyzé"))
    return "".join(letters)


@pytest.mark.parametrize("by", [["g"], []])
@pytest.mark.parametrize("most", [fuzzy_join.MOST, 3])
def test_first_match_and_append(spark, by, most):
    r = random.Random(most)
    name = lambda: None if r.random() < 0.05 else bent(r, r.choice(NAMES))
    left = [(g, i, name(), "t", 1) for g in (0, 1, None) for i in range(40)] * 2
    right = [(g, i, name(), i * 10) for g in (0, 1, None) for i in range(30)]
    a = spark.createDataFrame(left, "g int, i int, name string, text string, first int")
    b = spark.createDataFrame(right, "g int, i int, name string, marks int")
    same = lambda g, n, h, t: (not by or (g is not None and g == h)) and n and t and people.same_subject(n, t)
    got = fuzzy_join.first_match(a, b, "name", ["i", "marks"], ["g"], by, most=most)
    assert got.columns == [*a.columns, "match"]
    want = []
    for row in left:
        found = [(i, m, t, g) for g, i, t, m in right if same(row[0], row[2], g, t)]
        want.append((*row, min(found, key=lambda f: (f[0], f[1], f[2], f[3] is not None, f[3] or 0)) if found else None))
    assert ordered((*x[:5], x.match and (x.match.i, x.match.marks, x.match.name, x.match.g)) for x in got.collect()) == ordered(want)
    rest = fuzzy_join.without_match(a, b, "name", by, most=most)
    assert ordered(rest.collect()) == ordered(x for x in right if x[2] and not any(same(g, n, x[0], x[2]) for g, _, n, *_ in left))


def test_fuzzy_joins_pair_nothing_with_everything(spark):
    words = tables._words(spark.read.parquet(f"{DATA}/benchmark.parquet"), "item_id")
    parts = tables._part_words(spark, DATA)
    for most in (fuzzy_join.MOST, 3):
        for joined in (fuzzy_join.first_match(words, parts, "word", ["p_partkey", "pos"], most=most), fuzzy_join.without_match(parts, words, "word", most=most)):
            assert not re.search("Cartesian|NestedLoop", plan(joined))
    empty = spark.createDataFrame([], "g int, i int, name string")
    one = spark.createDataFrame([(1, 1, "x")], "g int, i int, name string")
    assert fuzzy_join.first_match(one, empty, "name", ["i"]).first().match is None
    assert fuzzy_join.first_match(empty, one, "name", ["i"]).count() == 0
    assert fuzzy_join.without_match(empty, one, "name").count() == 1


@pytest.mark.parametrize("least", [0.5, 0.75, 0.8, 0.95])
def test_keys_miss_no_pair(least):
    r = random.Random(4)
    words = ["".join(r.choice("aabbccdde") for _ in range(r.randrange(1, 13))) for _ in range(250)]
    places = {"a1": 9, "b1": 8, "c1": 7, "a2": 6}
    keys = {w: set(fz.pair_keys(w, least, places)) for w in words}
    for a in words[:125]:
        for b in words[125:]:
            near = fz.ratio_of(a, b) >= least
            assert fz.alike(a, b, least) == near
            assert not near or keys[a] & keys[b]


def test_numbered(spark):
    rows = [(i // 3, i) for i in range(500)]
    random.Random(1).shuffle(rows)
    got = ranges.numbered(spark.createDataFrame(rows, "part int, seq int").withColumnsRenamed({"part": "k", "seq": "i"}), ["k", "i"], parts=7)
    assert ordered(got.collect()) == ordered((i // 3, i, i) for i in range(500))
    assert ranges.numbered(spark.createDataFrame([], "k int"), ["k"]).count() == 0


@pytest.mark.parametrize("keys", [["k"], []])
def test_islands(spark, keys):
    r = random.Random(1)
    rows = [(r.choice([1, 1, 1, 1, 1, None, 2]), r.choice([None] + [r.randrange(600)] * 20), i, 3) for i in range(700)] + [(9, 5, 900, 0), (9, 5, 900, 0)]
    df = spark.createDataFrame(rows, "k int, at int, id int, row int")
    last, number, want = {}, {}, []
    for row in sorted(rows, key=lambda x: (x[1] is not None, x[1] or 0, x[2])):
        k = row[0] if keys else 0
        if row[1] is None:
            want.append((*row, None))
            continue
        if k not in last or row[1] - last[k] > 3:
            number[k] = number.get(k, 0) + 1
        last[k] = row[1]
        want.append((*row, number[k]))
    got = ranges.islands(df, keys, "at", 3, ["id"], parts=6) if keys else ranges.islands(df.withColumn("one", F.lit(1)), ["one"], "at", 3, ["id"], parts=6).drop("one")
    assert ordered(got.collect()) == ordered(want)
    assert ranges.islands(df.limit(0), ["k"], "at", 3).count() == 0


def test_sessions_of_a_stream_equal_those_of_a_table(spark, tmp_path):
    from docloom.streaming.flows import session_stream

    events = spark.read.parquet(f"{DATA}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.where("ts < '2024-01-15'").coalesce(1).write.parquet(str(tmp_path / "in/a"))
    late = spark.createDataFrame([(None, datetime.datetime(2025, 1, 1), 10**6, "view", 0.0, "")], events.schema)
    events.where("ts >= '2024-01-15'").union(late).coalesce(1).write.parquet(str(tmp_path / "in/b"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    run = session_stream(stream, ["user_id"], "ts", "6 hours", "30 days").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination(180)
    got = ordered(spark.read.parquet(str(tmp_path / "out")).collect())
    table = ranges.islands(events, ["user_id"], "ts", 6 * 3600, ["event_id"]).groupBy("user_id", "island").agg(F.min("ts").alias("began"), F.max("ts").alias("ended"), F.count("*").alias("n"))
    assert got == ordered(table.select("user_id", "began", "ended", "n").collect())


def nearest_by_hand(asking, candidates, within):
    used, out = set(), {}
    for k, at, i in sorted((a for a in asking if a[0] is not None and a[1] is not None), key=lambda a: (a[1], a[2])):
        found = [(abs(x - at), x, j) for kk, x, j in candidates if kk == k and x is not None and j not in used and abs(x - at) <= within]
        if found:
            far, _, j = min(found)
            used.add(j)
            out[i] = j, far
    return out


@pytest.mark.parametrize(("n", "m", "span", "within", "keys"), [(150, 170, 300, 7, 1), (200, 80, 200, 10, 1), (120, 200, 1500, 50, 3), (200, 210, 60, 3, 2), (250, 250, 2000, 400, 1), (5, 0, 9, 3, 1), (0, 5, 9, 3, 1)])
def test_nearest_free(spark, n, m, span, within, keys):
    r = random.Random(n + m)
    place = lambda: r.randrange(span) if r.random() < 0.97 else None
    asking = [(r.choice([None, *range(keys)]) if r.random() < 0.1 else r.randrange(keys), place(), i) for i in range(n)]
    candidates = [(r.randrange(keys), place(), 10_000 + i) for i in range(m)]
    a, c = (spark.createDataFrame(x, "k int, at int, id int") for x in (asking, candidates))
    got = nearest.nearest_free(a, c, ["k"], "at", ["id"], within, parts=8).collect()
    assert len(got) == n
    assert {x.id: (x.candidate.id, x.distance) for x in got if x.candidate} == nearest_by_hand(asking, candidates, within)


def test_a_change_that_goes_through_all_parts_takes_few_rounds(spark, monkeypatch):
    """One asking row too many moves every later one on by a candidate."""
    asking = [(0, -1, -1), *[(0, 10 * i, i) for i in range(640)]]
    candidates = [(0, 10 * i + 4, 10_000 + i) for i in range(640)]
    a, c = (spark.createDataFrame(x, "k int, at int, id int") for x in (asking, candidates))
    rounds = []
    monkeypatch.setattr(nearest, "checkpointed", lambda x, f=nearest.checkpointed: (rounds.append(x), f(x))[1])
    got = nearest.nearest_free(a, c, ["k"], "at", ["id"], 100, parts=32).collect()
    assert {x.id: (x.candidate.id, x.distance) for x in got if x.candidate} == nearest_by_hand(asking, candidates, 100)
    assert len(rounds) <= 10


@pytest.mark.parametrize("seed", range(4))
def test_nearest_in_chains(spark, monkeypatch, seed):
    r = random.Random(seed)
    monkeypatch.setattr(nearest, "CHAIN", 4)
    asking = [(0 if r.random() < 0.8 else 1, r.randrange(1500), i) for i in range(500)]
    candidates = [(0 if r.random() < 0.8 else 1, r.randrange(1500), 10_000 + i) for i in range(490)]
    a, c = (spark.createDataFrame(x, "k int, at int, id int") for x in (asking, candidates))
    got = nearest.nearest_free(a, c, ["k"], "at", ["id"], 30, parts=40).collect()
    assert {x.id: (x.candidate.id, x.distance) for x in got if x.candidate} == nearest_by_hand(asking, candidates, 30)


def test_parts_follow_the_rows(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(nearest, "in_ranges", lambda rows, order, parts=None, f=nearest.in_ranges: (seen.append(parts), f(rows, order, parts))[1])
    a = spark.range(50).select(F.lit(0).alias("k"), F.col("id").alias("at"), "id")
    nearest.nearest_free(a, a, ["k"], "at", ["id"], 3)
    monkeypatch.setattr(nearest, "ROWS_A_PART", 10)
    nearest.nearest_free(a, a, ["k"], "at", ["id"], 3)
    assert seen == [1, 10]


def test_a_part_hands_on_what_crosses_its_border():
    rows = [(nearest.OWN, "k", 1.0, 1), (nearest.OWN, "k", 8.0, 2), (nearest.ASKS, "k", 9.0, 3), (nearest.AHEAD, "k", 9.5, 4), (nearest.AHEAD, "k", 30.0, 5)]
    assert nearest.serve(rows, 5) == ([(3, 4)], [(nearest.FREE, "k", 8.0, 2), (nearest.TAKEN, "k", 9.5, 4)])
    assert nearest.serve([*rows, (nearest.TAKEN, "k", 9.5, 4)], 5)[0] == [(3, 2)]


def test_merged_groups_equal_merged_rows(spark):
    r = random.Random(3)
    rows = lambda n: [(g, i, bent(r, r.choice(NAMES)) or "Q", r.choice([None, r.randrange(100)])) for g in (1, 2, 3, 4, None) for i in range(r.randrange(n))]
    first, second = [*rows(9), (5, 0, "ONLY", 1), (7, 0, "", None), (7, 1, "", 5)], [*rows(9), (6, 0, "ONLY", 1), (6, 1, "", 3), (6, 2, "LAST", None)]
    schema = "g int, i int, subject string, marks int"
    a, b = spark.createDataFrame(first, schema), spark.createDataFrame(second, schema)
    got = merging.merge_groups(a.repartition(4), b.repartition(3), ["g"], ["i"], "subject", "marks").collect()
    for g in (1, 2, 3, 4, None, 5, 6):
        x, y = ([{"subject": t, "marks": m} for h, _, t, m in side if h == g] for side in (first, second))
        y = [s for s in y if s["subject"]]
        want = [(s["subject"], s["marks"]) for s in people.merged(x, y)]
        mine = [(t.subject, t.marks) for t in sorted((t for t in got if t.g == g), key=lambda t: t.pos)]
        assert mine == want
    assert [(t.subject, t.marks, t.source) for t in got if t.g == 7] == [("", None, "first"), ("", 5, "first")]
    assert [(t.subject, t.source) for t in got if t.g == 6] == [("ONLY", "second")]


def runs_by_hand(a, b):
    best = (0, 0, 0)
    for i in range(len(a)):
        for j in range(len(b)):
            k = 0
            while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
                k += 1
            if k > best[0]:
                best = k, i, j
    return best


def test_longest_runs(spark):
    r = random.Random(5)
    texts = [([r.choice("abc") for _ in range(r.randrange(16))], [r.choice("abc") for _ in range(r.randrange(16))]) for _ in range(1500)]
    assert all(runs.longest_run(a, b) == runs_by_hand(a, b) for a, b in texts)
    rows = [(1, "a b c\xa0d e", "x  b c\xa0d\n y"), (2, None, "a"), (3, "", ""), (4, "a", "b"), (5, "q q q", "q q")]
    got = {x.id: tuple(x)[1:] for x in runs.longest_runs(spark.createDataFrame(rows, "id int, l string, r string"), "l", "r").collect()}
    assert got == {1: (2, 1, 1, "b c\xa0d"), 2: (0, 0, 0, ""), 3: (0, 0, 0, ""), 4: (0, 0, 0, ""), 5: (2, 0, 0, "q q")}


def test_runs_take_linear_time():
    r = random.Random(1)
    took = []
    for n in (50_000, 100_000):
        a, b = ([r.randrange(60) for _ in range(n)] for _ in range(2))
        start = time.process_time()
        runs.longest_run(a, b)
        runs.longest_run([0] * n, [0] * n)
        took.append(time.process_time() - start)
    assert took[1] < 4 * took[0] + 0.5 and took[1] < 10


@pytest.mark.parametrize("cutoff", [0.6, 0.8, 0.9])
def test_closest_entries(spark, cutoff):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcde") for _ in range(r.randrange(1, 15)))
    words = [word() for _ in range(300)]
    entries = [word() for _ in range(120)] + [w[:k] + "x" + w[k:] for w in words[:50] for k in (1, len(w) // 2)]
    wanted = {w: get_close_matches(w, entries, 1, cutoff) for w in words}
    a = spark.createDataFrame([(w,) for w in [*words, words[0], "", None]], "entry string")
    b = spark.createDataFrame([(e,) for e in [*entries, entries[0], "", None]], "text string")
    for most in (close_match.MOST, 5):
        got = close_match.closest_entries(a, b, "entry", "text", cutoff, most).collect()
        assert {x.text: x.entry for x in got} == {w: e[0] if e else None for w, e in wanted.items()}
        assert all(x.entry is None or x.ratio == fz.ratio_of(x.entry, x.text) for x in got)
    assert close_match.closest_entries(a, b.limit(0), "entry", "text").where("entry is not null").count() == 0


@pytest.mark.parametrize(("few", "bins"), [(4096, 1024), (20, 8), (1, 2)])
def test_upper_medians(spark, few, bins):
    r = random.Random(1)
    inf, nan = math.inf, math.nan
    rows = [(r.choice([None, 1, 1, 1, 2]), r.choice([None, inf, -inf, nan, 0.0, 5.0]) if r.random() < 0.3 else r.gauss(0, 10)) for _ in range(800)]
    rows += [(7, 3.0)] * 100 + [(8, nan)] * 30 + [(9, 1.7e308), (9, -1.7e308), (9, 0.0)] * 20 + [(10, None)] + [(11, inf)] * 40 + [(12, 1.0), (12, 1.0 + 2**-52)] * 30
    got = selection.upper_medians(spark.createDataFrame(rows, "k int, v double"), ["k"], "v", few, bins)
    want = []
    for k in {k for k, _ in rows}:
        values = sorted((v for kk, v in rows if kk == k and v is not None), key=lambda v: (v != v, v if v == v else 0))
        if values:
            want.append((k, len(values), values[len(values) // 2]))
    assert repr(ordered(got.collect())) == repr(ordered(want))


def test_best_rows(spark):
    rows = [(1, 5, 2, "b"), (1, 5, 1, "a"), (1, 4, 0, "c"), (2, None, 0, "d"), (None, 1, 0, "e"), (3, -7, 9, "f"), (3, -7, 9, "f")]
    got = selection.best_rows(spark.createDataFrame(rows, "k int, score int, tie int, low string"), ["k"], "score", ["tie"], ["low", "tie"])
    assert ordered(got.collect()) == ordered([(1, 5, "a", 1), (None, 1, "e", 0), (3, -7, "f", 9)])


def replayed(rows, capacity, idle):
    caches, out = {}, []
    for key, at, tie, item in sorted(rows, key=lambda x: (x[1], x[2])):
        cache = caches.setdefault(key, OrderedDict())
        for old, use in list(cache.items()):
            if at - use > idle:
                del cache[old]
                out.append((key, use + idle, None, old, "idle", old, None))
        hit, evicted = item in cache, None
        cache.pop(item, None)
        if not hit and len(cache) == capacity:
            evicted = cache.popitem(last=False)[0]
        cache[item] = at
        out.append((key, at, tie, item, "hit" if hit else "miss", evicted, len(cache)))
    return out


def test_caches_over_a_table(spark):
    from docloom.streaming.caches import cached

    r = random.Random(6)
    start, second = datetime.datetime(2024, 1, 1), datetime.timedelta(seconds=1)
    rows = [(r.choice("aaaaaab"), start + r.randrange(4000) * second, i, str(r.randrange(30))) for i in range(900)]
    df = spark.createDataFrame([*rows, (None, start, 1, "x"), ("a", None, 1, "x"), ("a", start, 1, None)], "key string, ts timestamp, n long, item string")
    for capacity, idle in ((1, 10_000), (7, 60), (50, 300)):
        got = cached(df.repartition(5), "key", "ts", "n", "item", capacity, idle)
        assert ordered(got.collect()) == ordered(replayed(rows, capacity, idle * second))
    assert cached(df.limit(0), "key", "ts", "n", "item").count() == 0


def test_caches_of_a_stream_survive_restarts(spark, tmp_path):
    from docloom.streaming import caches

    events = spark.read.parquet(f"{DATA}/events.parquet").withColumns({"item": F.get_json_object("props", "$.k"), "ts": F.col("ts").cast("timestamp")})
    rows = [(str(x.user_id), x.ts, x.event_id, x["item"]) for x in events.collect()]
    day = datetime.timedelta(days=1)
    before = spark.conf.get(caches.STORE[0])
    spark.conf.set(*caches.STORE)
    try:
        for low, high in (("2024-01-01", "2024-01-09"), ("2024-01-09", "2024-01-20"), ("2024-01-20", "2024-03-01")):
            events.where(f"ts >= '{low}' and ts < '{high}'").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = caches.cached(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), "user_id", "ts", "event_id", "item", 5, 3 * 86_400)
            run = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
            assert run.awaitTermination(180)
    finally:
        spark.conf.set(caches.STORE[0], before)
    got, want = spark.read.parquet(str(tmp_path / "out")).collect(), replayed(rows, 5, 3 * day)
    assert ordered(x for x in got if x.outcome != "idle") == ordered(x for x in want if x[4] != "idle")
    assert {x[4] for x in want} == {"hit", "miss", "idle"} and any(x[5] and x[4] == "miss" for x in want)
    # Idle items come out once each: those a later request of the user finds, and those whose time the watermark has passed.
    idle = [tuple(x) for x in got if x.outcome == "idle"]
    last = max(at for _, at, _, _ in rows)
    assert len(set(idle)) == len(idle) and {x for x in want if x[4] == "idle"} <= set(idle)
    assert all(x[1] <= last + day for x in idle)


def test_uploads_round_trip(spark, tmp_path):
    from docloom.sources import uploads

    uploads.register(spark)
    content = {"a/1.txt": b"id 1234 5678 9012, ABCDE1234F", "a/2.png": b"ABCDE1234F \xff", "b/3.txt": b"", "b/4.json": "{\"é\": 123456789}".encode(), "5.txt": b"x" * 3_000_000}
    rows = spark.createDataFrame([(k, bytearray(v), 1) for k, v in content.items()], "name string, content binary, extra int").repartition(3)
    want = content | {"a/1.txt": b"id XXXX XXXX 9012, XXXXXX234F"}
    for pack in ("true", "false"):
        folder = str(tmp_path / pack)
        rows.write.format("uploads").mode("append").option("pack", pack).save(folder)
        back = spark.read.format("uploads").option("partbytes", 1000).load(folder)
        assert {x.name: bytes(x.content) for x in back.collect()} == want
        assert {x.name: (x.mime, x.length) for x in back.collect()} == {k: (uploads.mime_of(k), len(v)) for k, v in want.items()}
        found = back.where("mime = 'text/plain' and length >= 10 and name like 'a/%'")
        assert [x.name for x in found.collect()] == ["a/1.txt"] and "length >= 10" not in plan(found).replace("L", "")
        assert spark.read.format("uploads").schema("name string, length long").load(folder).agg(F.sum("length")).first()[0] == sum(map(len, want.values()))
        assert not os.path.isdir(f"{folder}/_staging")
    rows.limit(2).write.format("uploads").mode("overwrite").option("pack", "false").save(str(tmp_path / "false"))
    assert spark.read.format("uploads").load(str(tmp_path / "false")).count() == 2


def test_uploads_of_others_and_empty_folders(spark, tmp_path):
    from docloom.sources import uploads

    uploads.register(spark)
    (tmp_path / "in").mkdir()
    assert spark.read.format("uploads").load(str(tmp_path / "in")).count() == 0
    (tmp_path / "in/x.png").write_bytes(b"1")
    assert [x.mime for x in spark.read.format("uploads").load(f"file://{tmp_path}/in").collect()] == ["image/png"]
    spark.createDataFrame([("y.txt", bytearray(b"2"))], "name string, content binary").write.format("uploads").mode("append").save(str(tmp_path / "in"))
    assert sorted(x.name for x in spark.read.format("uploads").load(str(tmp_path / "in")).collect()) == ["x.png", "y.txt"]


@pytest.mark.parametrize("pack", ["true", "false"])
def test_a_failed_write_leaves_nothing(spark, tmp_path, pack):
    from docloom.sources import uploads

    uploads.register(spark)
    folder = str(tmp_path / "out")
    write = lambda rows: rows.write.format("uploads").mode("append").option("pack", pack).save(folder)
    files = lambda: sorted(os.path.join(d, f) for d, _, names in os.walk(folder) for f in names)
    good = spark.createDataFrame([(f"{k}.txt", bytearray(b"x")) for k in range(20)], "name string, content binary")
    write(good)
    before = files()
    with pytest.raises(Exception, match="not a name"):
        write(good.withColumn("name", F.when(F.col("name") == "13.txt", "../13.txt").otherwise(F.concat(F.lit("n"), "name"))).repartition(4))
    assert files() == before and not os.path.isdir(f"{folder}/_staging")
    if pack == "false":
        with pytest.raises(Exception, match="there already"):
            write(good.limit(3))
        assert files() == before
    assert spark.read.format("uploads").load(folder).count() == 20


def test_no_sink_writes_an_identifier(spark, tmp_path):
    """Every sink of results, its files read as bytes: no identifier of the examples is in them."""
    from docloom.plans.extract import extract
    from docloom.plans.stages import checkpointed
    from docloom.sources.records import as_json, write_results
    from docloom.streaming.flows import extract_stream

    results = checkpointed(extract(q.example_documents(spark)))
    secret = {r[0] for c in ("aadhaar.aadhaar_number", "pan.pan_number", "driving_license.dl_number", "marksheet.register_number") for r in results.where(f"{c} is not null").select(c).collect()}
    assert len(secret) >= 4
    for lines in (False, True):
        write_results(results, str(tmp_path / f"json{lines}"), "json", lines=lines)
        as_json(results, lines=lines).select("json").write.text(str(tmp_path / f"text{lines}"))
    q.example_documents(spark).write.json(str(tmp_path / "in"))
    extract_stream(spark, str(tmp_path / "in"), str(tmp_path / "stream"), str(tmp_path / "c")).awaitTermination(120)
    spark.read.parquet(str(tmp_path / "stream")).write.json(str(tmp_path / "plain"))
    texts = [open(os.path.join(d, f)).read() for name in ("jsonFalse", "jsonTrue", "textFalse", "textTrue", "plain") for d, _, names in os.walk(tmp_path / name) for f in names if f.startswith("part")]
    assert any(json.loads(x) for t in texts for x in t.splitlines())
    letters = lambda t: re.sub("[^0-9A-Za-z]", "", t)
    assert not [s for s in secret for t in texts if letters(s) in letters(t)]


def test_ranks_differences_and_zips(spark):
    from docloom.operators import relational

    r = random.Random(2)
    a = [(r.choice([1, 1, 1, None]), r.choice(["x", "y", None]), i) for i in range(300)]
    b = [(r.choice([1, 1, 1, None]), r.choice(["x", "y", None]), i) for i in range(120)]
    x, y = (spark.createDataFrame(rows, "k int, v string, i int") for rows in (a, b))
    seen, want = {}, []
    for row in a:
        seen[row[0]] = seen.get(row[0], 0) + 1
        want.append((*row, seen[row[0]]))
    assert ordered(ranges.ranked(x, ["k"], ["i"], parts=5).collect()) == ordered(want)
    left, rest = {}, []
    for k, v, _ in b:
        left[k, v] = left.get((k, v), 0) + 1
    for k, v, i in a:
        if left.get((k, v), 0):
            left[k, v] -= 1
        else:
            rest.append((k, v, i))
    assert ordered(relational.ordered_difference(x, y, ["k"], "v", ["i"]).collect()) == ordered(rest)
    others = {k: [row for row in b if row[0] == k] for k in (1, None)}
    zipped = [(*row, others[row[0]][n - 1] if n <= len(others[row[0]]) else None) for *row, n in want]
    assert ordered((*z[:3], z.other and tuple(z.other)) for z in relational.zip_by_rank(x, y, ["k"], ["i"]).collect()) == ordered(zipped)
    firsts = relational.first_rows(x, ["v"], ["i"])
    assert firsts.columns == ["k", "v", "i"] and ordered(firsts.collect()) == ordered(next(row for row in a if row[1] == v) for v in ("x", "y", None))


@pytest.mark.parametrize(("most", "few"), [(1 << 16, 1 << 16), (1 << 16, 0), (5, 1 << 16), (5, 0)])
def test_a_difference_ranks_values_that_both_have(spark, most, few):
    r = random.Random(4)
    rows = lambda n, m: [(r.choice([1, 2, None]), r.choice(["hot", None, *map(str, range(m))]), i) for i in range(n)]
    a, b = rows(400, 90), rows(200, 60)
    x, y = spark.createDataFrame(a, "k int, v string, i int"), spark.createDataFrame(b, "k long, v string, i int")
    left, want = Counter((k, v) for k, v, _ in b), []
    for row in a:
        if left[row[:2]]:
            left[row[:2]] -= 1
        else:
            want.append(row)
    assert ordered(relational.ordered_difference(x, y, ["k"], "v", ["i"], most, few).collect()) == ordered(want)
    assert relational.ordered_difference(x.limit(0), y, ["k"], "v", ["i"], most, few).count() == 0
    assert relational.ordered_difference(x, y.limit(0), ["k"], "v", ["i"], most, few).count() == len(a)


def test_a_difference_writes_no_copy_of_its_rows(spark):
    from pathlib import Path

    from docloom.plans.stages import checkpoint_dir

    size = lambda: sum(f.stat().st_size for f in Path(checkpoint_dir(spark).removeprefix("file:")).rglob("*") if f.is_file())
    text = F.concat_ws("", *[F.sha2(F.concat_ws("-", "i", F.lit(k)), 512) for k in range(8)])
    a = spark.range(3000).select((F.col("id") % 30).alias("k"), F.col("id").alias("i")).withColumn("v", text)
    before = size()
    left = relational.ordered_difference(a, a.where("i % 10 = 0"), ["k"], "v", ["i"]).agg(F.count("*").alias("n"), F.sum(F.length("v")).alias("bytes")).first()
    assert left.n == 2700 and size() - before < 0.2 * left.bytes


def test_patterns_find_every_place():
    from docloom.operators.sheets import Pattern

    sums = Pattern("a b both", ("a b both", lambda a, b, c: a + b == c), ("a", lambda a: a > 1))
    assert [tuple(v.values()) for v in sums.find([1, 1, 2, 3, 5, 8, 0])] == [(2, 3, 5), (3, 5, 8)]
    assert sums.read([2, None, 9]) == {"a": 2, "b": None, "both": 9} and sums.read([1, None, 9]) is None and list(sums.find([2, 3])) == []
