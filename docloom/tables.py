"""Registered queries of the join-, order- and state-shaped operators, over whole given tables, and their SQL."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import close_match, fuzzy_join, merging, nearest, ranges, relational, runs, selection, sheets
from .operators.lines import group_lines
from .operators.sheets import CORE
from .plans.stages import shared_folder
from .sources import uploads
from .streaming import caches


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _words(table: DataFrame, *keys: str) -> DataFrame:
    """Words of ASCII letters, in capitals, with their place in the text."""
    return table.select(*keys, F.posexplode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("pos", "word")).withColumn("word", F.upper("word"))


def _part_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("pos", "word"))


def fuzzy_words(spark, sf_dir):
    """Every word of the documents and the first word of a part's name that is the same or alike."""
    words = _words(_table(spark, sf_dir, "documents"), "doc_id").groupBy("word").agg(F.count("*").alias("n"))
    found = fuzzy_join.first_match(words, _part_words(spark, sf_dir), "word", ["p_partkey", "pos"])
    return found.select("word", "n", "match.p_partkey", F.col("match.word").alias("part_word"))


def fuzzy_append(spark, sf_dir):
    """Words of part names, and after them the words of the benchmark that are like none of them, with where they occur first."""
    parts = _part_words(spark, sf_dir)
    other = _words(_table(spark, sf_dir, "benchmark"), "item_id")
    new = fuzzy_join.without_match(parts, other, "word")
    rows = parts.select(F.lit("part").alias("side"), F.col("p_partkey").alias("key"), "pos", F.upper("word").alias("word")).union(new.select(F.lit("benchmark"), "item_id", "pos", "word"))
    return rows.groupBy("side", "word").agg(F.min(F.struct("key", "pos")).alias("first"), F.count("*").alias("n")).select("side", "word", "first.key", F.col("first.pos").cast("long").alias("pos"), "n")


CLICK_DAYS, CLICK_HOURS = 2, 1


def _purchases_and_clicks(spark: SparkSession, sf_dir: str, *keys) -> list[DataFrame]:
    events = _table(spark, sf_dir, "events").select(*keys, "ts", "event_id", "event_type")
    return [events.where(F.col("event_type") == kind).drop("event_type") for kind in ("purchase", "click")]


def _nearest_clicks(spark: SparkSession, sf_dir: str, within: float, *keys) -> DataFrame:
    asking, clicks = _purchases_and_clicks(spark, sf_dir, *keys)
    found = nearest.nearest_free(asking, clicks, [c for c in asking.columns if c not in ("ts", "event_id")], "ts", ["event_id"], within)
    return found.select("event_id", F.col("candidate.event_id").alias("click_id"), F.round("distance", 6).alias("seconds"))


def nearest_clicks(spark, sf_dir):
    """Each purchase and the nearest click of its user within two days that no earlier purchase of the user has."""
    return _nearest_clicks(spark, sf_dir, CLICK_DAYS * 86_400, "user_id")


def nearest_clicks_of_all(spark, sf_dir):
    """The same as if all events were one user's, within an hour: one key holds every row."""
    return _nearest_clicks(spark, sf_dir, CLICK_HOURS * 3_600, F.lit(0).alias("one"))


def _sessions(events: DataFrame, keys: list[str], gap: float) -> DataFrame:
    rows = ranges.islands(events, keys, "ts", gap, ["event_id"], "session")
    return rows.groupBy(*keys, "session").agg(F.min("ts").alias("began"), F.max("ts").alias("ended"), F.count("*").alias("n"), F.count_if(F.col("event_type") == "purchase").alias("purchases"))


def event_sessions(spark, sf_dir):
    """Sessions of each user: a new one begins after more than six hours without an event."""
    return _sessions(_table(spark, sf_dir, "events"), ["user_id"], 6 * 3600)


def event_bursts(spark, sf_dir):
    """Bursts of all events together, ten minutes apart: one key holds every row."""
    return _sessions(_table(spark, sf_dir, "events").withColumn("one", F.lit(0).cast("long")), ["one"], 600)


def longest_shared_runs(spark, sf_dir):
    """The longest run of tokens that each document shares with the document of the next id."""
    docs = ranges.numbered(_table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])
    after = docs.select((F.col("place") - 1).alias("place"), F.col("doc_id").alias("next_id"), F.col("text").alias("next_text"))
    return runs.longest_runs(docs.join(after, "place").drop("place"), "text", "next_text")


def closest_words(spark, sf_dir):
    """For every word of five letters or more of the documents the closest word of the benchmark."""
    words = _words(_table(spark, sf_dir, "documents"), "doc_id").where(F.length("word") >= 5)
    entries = _words(_table(spark, sf_dir, "benchmark"), "item_id")
    return close_match.closest_entries(words, entries, "word", "word").select(F.col("text").alias("word"), "entry", F.round("ratio", 9).alias("ratio"))


def line_medians(spark, sf_dir):
    """Upper median of prices and the best priced line, by flag and over all lines (flag null), which are one key then."""
    lines = _table(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice", "l_orderkey", "l_linenumber")
    both = lines.unionByName(lines.withColumn("l_returnflag", F.lit(None).cast("string")))
    middle = selection.upper_medians(both, ["l_returnflag"], "l_extendedprice").select("l_returnflag", "n", F.col("kth").alias("median_price"))
    best = selection.best_rows(both, ["l_returnflag"], "l_extendedprice", ["l_orderkey", "l_linenumber"], ["l_orderkey", "l_linenumber"])
    renamed, same = ranges.on_keys(["l_returnflag"])
    best = best.select(*renamed, F.col("l_extendedprice").alias("top_price"), "l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"))
    return middle.join(best, same).select("l_returnflag", "n", "median_price", "top_price", "l_orderkey", "l_linenumber")


def merged_turns(spark, sf_dir):
    """Turns of each conversation merged with those of the next one by their first two words; those of the assistant
    have a value, their length."""
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.upper(F.regexp_extract("text", "^[^A-Za-z]*([A-Za-z]+(?: [A-Za-z]+)?)", 1)).alias("name"), F.when(F.col("role") == "assistant", F.length("text").cast("long")).alias("n_chars"))
    after = turns.withColumn("conv_id", F.col("conv_id") - 1).join(turns.select("conv_id").distinct(), "conv_id", "left_semi")
    return merging.merge_groups(turns, after, ["conv_id"], ["turn"], "name", "n_chars")


CACHE_SIZE, CACHE_DAYS = 12, 10


def cached_requests(spark, sf_dir):
    """Events as requests for the item in their properties, through a cache of each user."""
    events = _table(spark, sf_dir, "events").withColumn("item", F.get_json_object("props", "$.k"))
    out = caches.cached(events, "user_id", "ts", "event_id", "item", CACHE_SIZE, CACHE_DAYS * 86_400)
    return out.select(F.col("key").cast("long").alias("user_id"), F.col("at").cast("timestamp_ntz").alias("ts"), F.col("tie").alias("event_id"), "item", "outcome", "evicted", F.col("held").cast("long").alias("held"))


def page_uploads(spark, sf_dir):
    """Pages written as uploads and read again: what came through of each."""
    pages = _table(spark, sf_dir, "pages")
    uploads.register(spark)
    folder = shared_folder(spark)
    pages.select(F.format_string("pages/%d.html", "page_id").alias("name"), F.encode("html", "UTF-8").alias("content")).write.format("uploads").mode("append").option("mask", "false").save(folder)
    back = spark.read.format("uploads").load(folder).where("mime = 'text/html' and length > 0")
    return back.select(F.regexp_extract("name", "([0-9]+)[.]html", 1).cast("long").alias("page_id"), "mime", "length", F.sha2("content", 256).alias("sha256"))


def order_lines(spark, sf_dir):
    """Items of an order as tokens on a page, by quantity downwards and by discount from the left, put into lines by their gaps."""
    items = _table(spark, sf_dir, "lineitem")
    x, y = F.round(F.col("l_discount") * 1000), F.col("l_quantity") * 4
    tokens = items.select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber").cast("long") * 1_000_000_000 + F.col("l_partkey")).alias("pos"), F.concat_ws("", F.lower("l_returnflag"), "l_linenumber").alias("text"), x.alias("x"), y.alias("y"), (x + 12).alias("x_end"), F.lit(1200).alias("height"), F.lit(200).alias("width"))
    return group_lines(tokens).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "line")


def answered_turns(spark, sf_dir):
    """The k-th turn of the user in a conversation with the k-th one of the assistant."""
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", "role")
    users, others = (turns.where(F.col("role") == role).drop("role") for role in ("user", "assistant"))
    return relational.zip_by_rank(users, others, ["conv_id"], ["turn"]).select("conv_id", "turn", F.col("other.turn").alias("answer"), F.length("text").cast("long").alias("n_asked"), F.length("other.text").cast("long").alias("n_answered"))


def new_lines(spark, sf_dir):
    """Lines of a document that the one of the next id doesn't have as often."""
    lines = _table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line"))
    after = lines.select((F.col("doc_id") - 1).alias("doc_id"), "line", "pos")
    return relational.ordered_difference(lines, after, ["doc_id"], "line", ["pos"]).select("doc_id", F.col("pos").cast("long").alias("pos"), "line")


def first_words(spark, sf_dir):
    """Where each word of the documents occurs first."""
    words = _words(_table(spark, sf_dir, "documents"), "doc_id")
    return relational.first_rows(words, ["word"], ["doc_id", "pos"]).select("word", "doc_id", F.col("pos").cast("long").alias("pos"))


#: Three numbers in a row of which the third is the sum of the others, as parts and total stand on a sheet.
ADDS_UP = sheets.Pattern("one two total", ("one two total", lambda a, b, c: a + b == c > 0))


def number_sums(spark, sf_dir):
    """Numbers of up to three digits in a page of which two in a row add up to the next."""
    def run(batches):
        for batch in batches:
            found = [(page, v["one"], v["two"], v["total"]) for page, numbers in zip(batch.column("page_id").to_pylist(), batch.column("numbers").to_pylist(), strict=True) for v in ADDS_UP.find(numbers)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in list(zip(*found, strict=True)) or [()] * 4], ["page_id", "one", "two", "total"])

    pages = _table(spark, sf_dir, "pages").select("page_id", F.transform(F.regexp_extract_all("html", F.lit("[0-9]+"), F.lit(0)), lambda n: F.when(F.length(n) <= 3, n.cast("long"))).alias("numbers"))
    pages = pages.select("page_id", F.filter("numbers", lambda n: n.isNotNull()).alias("numbers"))
    return pages.mapInArrow(run, "page_id long, one long, two long, total long").groupBy("page_id", "one", "two", "total").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (fuzzy_words, fuzzy_append, nearest_clicks, nearest_clicks_of_all, event_sessions, event_bursts, longest_shared_runs, closest_words, line_medians, merged_turns, cached_requests, page_uploads, order_lines, answered_turns, new_lines, first_words, number_sums)}

_CORE = ", ".join(f"({k}, '{c}')" for k, c in enumerate(CORE))


def _words_sql(table: str, key: str) -> str:
    return f"SELECT {key}, upper(unnest(w)) AS word, unnest(range(len(w))) AS pos FROM (SELECT {key}, regexp_extract_all(text, '[A-Za-z]+') AS w FROM {table})"


_PART_WORDS = "SELECT p_partkey, unnest(w) AS word, unnest(range(len(w))) AS pos FROM (SELECT p_partkey, string_split(upper(p_name), ' ') AS w FROM part)"
# Ratio of every pair of `pairs` (a, b): the longest block first (of equal ones the first in a, then in b), then what stands left and right of it.
_RATIOS = """r(a, b, x, y, m) AS (SELECT a, b, a, b, 0 FROM pairs UNION ALL
  SELECT a, b, z.x, z.y, z.m FROM (SELECT a, b, unnest([struct_pack(x := substr(x, 1, i - 1), y := substr(y, 1, j - 1), m := n), struct_pack(x := substr(x, i + n), y := substr(y, j + n), m := 0)]) AS z
    FROM (SELECT a, b, x, y, n, i, instr(y, substr(x, i, n)) AS j FROM (SELECT a, b, x, y, list_max(w) AS n, list_position(w, list_max(w)) AS i FROM (
      SELECT a, b, x, y, list_transform(range(1, length(x) + 1), lambda i: coalesce(list_max(list_filter(range(1, length(x) - i + 2), lambda k: contains(y, substr(x, i, k)))), 0)) AS w FROM r WHERE x <> '' AND y <> '')) WHERE n > 0))),
ratios AS (SELECT a, b, 2.0 * sum(m) / (length(a) + length(b)) AS ratio FROM r GROUP BY a, b)"""


def _same(left: str, right: str) -> str:
    """Common table expressions up to `same` (a, b): all pairs of distinct texts of two queries (text) that match."""
    core = "SELECT text, coalesce((SELECT c FROM (VALUES {0}) k(i, c) WHERE contains(text, c) ORDER BY length(c) DESC, i LIMIT 1), text) AS core FROM (SELECT DISTINCT text FROM ({1}) WHERE text <> '')"
    return f"""xs AS ({core.format(_CORE, left)}), ys AS ({core.format(_CORE, right)}),
plain AS (SELECT x.text AS a, y.text AS b, x.core = y.core OR (x.core NOT IN (SELECT c FROM (VALUES {_CORE}) k(i, c)) AND y.core NOT IN (SELECT c FROM (VALUES {_CORE}) k(i, c)) AND (contains(x.text, y.text) OR contains(y.text, x.text))) AS same FROM xs x, ys y),
pairs AS (SELECT a, b FROM plain WHERE NOT same AND 2 * least(length(a), length(b)) >= {fuzzy_join.LEAST} * (length(a) + length(b))), {_RATIOS},
same AS (SELECT a, b FROM plain WHERE same UNION ALL SELECT a, b FROM ratios WHERE ratio >= {fuzzy_join.LEAST})"""


def _nearest_sql(key: str, seconds: int) -> str:
    """Purchases of a key one after the other, each with its clicks from the nearest on and those used that are still in reach."""
    return f"""WITH RECURSIVE e AS (SELECT {key} AS key, event_id, ts, event_type FROM events),
asks AS (SELECT key, event_id, ts, row_number() OVER (PARTITION BY key ORDER BY ts, event_id) AS k FROM e WHERE event_type = 'purchase'),
near AS MATERIALIZED (SELECT a.key, a.k, a.event_id, epoch_us(any_value(a.ts)) AS t, list(struct_pack(i := c.event_id, t := epoch_us(c.ts), d := abs(epoch_us(c.ts) - epoch_us(a.ts))) ORDER BY abs(epoch_us(c.ts) - epoch_us(a.ts)), c.ts, c.event_id) FILTER (WHERE c.event_id IS NOT NULL) AS clicks
  FROM asks a LEFT JOIN (SELECT * FROM e WHERE event_type = 'click') c ON a.key = c.key AND abs(epoch_us(c.ts) - epoch_us(a.ts)) <= {seconds * 1000000} GROUP BY a.key, a.k, a.event_id),
g(key, k, event_id, got, used) AS (SELECT key, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS STRUCT(i BIGINT, t BIGINT, d BIGINT)), CAST([] AS STRUCT(i BIGINT, t BIGINT, d BIGINT)[]) FROM (SELECT DISTINCT key FROM asks)
  UNION ALL SELECT key, k, event_id, got, CASE WHEN got IS NULL THEN used ELSE list_append(used, got) END FROM
  (SELECT key, k, event_id, list_filter(clicks, lambda x: NOT list_contains(list_transform(used, lambda u: u.i), x.i))[1] AS got, used FROM
    (SELECT g.key, n.k, n.event_id, n.clicks, list_filter(g.used, lambda u: u.t >= n.t - {seconds * 1000000}) AS used FROM g JOIN near n ON n.key = g.key AND n.k = g.k + 1)))
SELECT event_id, got.i AS click_id, round(got.d / 1000000.0, 6) AS seconds FROM g WHERE k > 0"""


def _sessions_sql(key: str, name: str, seconds: int) -> str:
    return f"""WITH e AS (SELECT {key} AS {name}, ts, event_id, event_type, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY {key} ORDER BY ts, event_id) <= {seconds * 1000000} THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY {name} ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM e)
SELECT {name}, CAST(session AS BIGINT) AS session, min(ts) AS began, max(ts) AS ended, count(*) AS n, CAST(count(*) FILTER (WHERE event_type = 'purchase') AS BIGINT) AS purchases FROM s GROUP BY {name}, session"""


ORACLE_SQL = {
    "fuzzy_words": f"""WITH RECURSIVE words AS (SELECT word AS text, count(*) AS n FROM ({_words_sql('documents', 'doc_id')}) GROUP BY word),
firsts AS (SELECT * FROM (SELECT p_partkey, word, row_number() OVER (PARTITION BY word ORDER BY p_partkey, pos) AS k, pos FROM ({_PART_WORDS})) WHERE k = 1), {_same("SELECT text FROM words", "SELECT word AS text FROM firsts")},
best AS (SELECT a, p_partkey, b, row_number() OVER (PARTITION BY a ORDER BY p_partkey, pos) AS k FROM same JOIN firsts ON b = word)
SELECT text AS word, n, p_partkey, lower(b) AS part_word FROM words LEFT JOIN best ON a = text AND k = 1""",
    "fuzzy_append": f"""WITH RECURSIVE {_same(f"SELECT word AS text FROM ({_PART_WORDS})", f"SELECT word AS text FROM ({_words_sql('benchmark', 'item_id')})")},
rows AS (SELECT 'part' AS side, p_partkey AS key, pos, word FROM ({_PART_WORDS}) UNION ALL SELECT 'benchmark', item_id, pos, word FROM ({_words_sql('benchmark', 'item_id')}) WHERE word NOT IN (SELECT b FROM same))
SELECT side, word, key, CAST(pos AS BIGINT) AS pos, n FROM (SELECT side, word, key, pos, row_number() OVER (PARTITION BY side, word ORDER BY key, pos) AS k, count(*) OVER (PARTITION BY side, word) AS n FROM rows) WHERE k = 1""",
    "nearest_clicks": _nearest_sql("user_id", CLICK_DAYS * 86_400),
    "nearest_clicks_of_all": _nearest_sql("0", CLICK_HOURS * 3_600),
    "event_sessions": _sessions_sql("user_id", "user_id", 6 * 3600),
    "event_bursts": _sessions_sql("CAST(0 AS BIGINT)", "one", 600),
    # Equal tokens of both texts by their diagonal: a run is an unbroken stretch of one.
    "longest_shared_runs": r"""WITH d AS (SELECT doc_id, lead(doc_id) OVER (ORDER BY doc_id) AS next_id, list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '') AS w FROM documents),
t AS (SELECT doc_id, next_id, unnest(w) AS token, unnest(range(len(w))) AS pos FROM d),
m AS (SELECT a.doc_id, a.pos AS i, b.pos AS j FROM t a JOIN t b ON b.doc_id = a.next_id AND a.token = b.token),
g AS (SELECT doc_id, i, j, i - row_number() OVER (PARTITION BY doc_id, i - j ORDER BY i) AS island FROM m),
r AS (SELECT doc_id, min(i) AS p, min(j) AS q, count(*) AS n FROM g GROUP BY doc_id, i - j, island),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, p, q) AS k FROM r)
SELECT d.doc_id, d.next_id, coalesce(n, 0) AS n_tokens, coalesce(p, 0) AS "at", coalesce(q, 0) AS other_at, CASE WHEN n IS NULL THEN '' ELSE array_to_string(list_slice(w, p + 1, p + n), ' ') END AS run
FROM d LEFT JOIN best ON best.doc_id = d.doc_id AND k = 1 WHERE next_id IS NOT NULL""",
    "line_medians": """WITH l AS (SELECT l_returnflag, l_extendedprice AS p, l_orderkey, l_linenumber FROM lineitem UNION ALL SELECT NULL, l_extendedprice, l_orderkey, l_linenumber FROM lineitem),
o AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY p) - 1 AS k, count(*) OVER (PARTITION BY l_returnflag) AS n, row_number() OVER (PARTITION BY l_returnflag ORDER BY p DESC, l_orderkey, l_linenumber) AS best FROM l)
SELECT a.l_returnflag, a.n, a.p AS median_price, b.p AS top_price, b.l_orderkey, CAST(b.l_linenumber AS BIGINT) AS l_linenumber FROM o a JOIN o b ON a.l_returnflag IS NOT DISTINCT FROM b.l_returnflag AND b.best = 1 WHERE a.k = a.n // 2""",
    # All pairs that lengths and letters allow; ratios by longest blocks, as above.
    "closest_words": f"""WITH RECURSIVE w AS (SELECT DISTINCT word FROM ({_words_sql("documents", "doc_id")}) WHERE length(word) >= 5), e AS (SELECT DISTINCT word FROM ({_words_sql("benchmark", "item_id")})),
abc AS (SELECT list_transform(range(26), lambda k: chr(CAST(65 + k AS INTEGER))) AS abc),
wc AS (SELECT word, list_transform(abc, lambda c: length(word) - length(replace(word, c, ''))) AS c FROM w, abc), ec AS (SELECT word, list_transform(abc, lambda c: length(word) - length(replace(word, c, ''))) AS c FROM e, abc),
pairs AS (SELECT ec.word AS a, wc.word AS b FROM wc JOIN ec ON 2 * least(length(ec.word), length(wc.word)) >= {close_match.CUTOFF} * (length(ec.word) + length(wc.word)) WHERE 2 * list_sum(list_transform(list_zip(ec.c, wc.c), lambda z: least(z[1], z[2]))) >= {close_match.CUTOFF} * (length(ec.word) + length(wc.word))), {_RATIOS},
best AS (SELECT a, b, ratio, row_number() OVER (PARTITION BY b ORDER BY ratio DESC, a DESC) AS k FROM ratios WHERE ratio >= {close_match.CUTOFF})
SELECT word, a AS entry, round(ratio, 9) AS ratio FROM w LEFT JOIN best ON b = word AND k = 1""",
    # The rows of the second one after the other, each with the rows of the first that match it.
    "merged_turns": f"""WITH RECURSIVE t AS (SELECT conv_id, turn, upper(regexp_extract(text, '^[^A-Za-z]*([A-Za-z]+(?: [A-Za-z]+)?)', 1)) AS name, CASE WHEN role = 'assistant' THEN CAST(length(text) AS BIGINT) END AS v FROM conversations),
x AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM t),
y AS (SELECT conv_id - 1 AS conv_id, name, v, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS j FROM t WHERE conv_id - 1 IN (SELECT conv_id FROM t)),
keyed AS (SELECT text, coalesce((SELECT c FROM (VALUES {_CORE}) k(i, c) WHERE contains(text, c) ORDER BY length(c) DESC, i LIMIT 1), text) AS core FROM (SELECT DISTINCT name AS text FROM t WHERE name <> '')),
met AS (SELECT x.conv_id, x.i, y.j, x.name AS a, y.name AS b, y.v, x.v AS own, k.core = l.core OR (k.core NOT IN (SELECT c FROM (VALUES {_CORE}) z(i, c)) AND l.core NOT IN (SELECT c FROM (VALUES {_CORE}) z(i, c)) AND (contains(x.name, y.name) OR contains(y.name, x.name))) AS plain
  FROM x JOIN y ON x.conv_id = y.conv_id JOIN keyed k ON k.text = x.name JOIN keyed l ON l.text = y.name),
pairs AS (SELECT DISTINCT a, b FROM met WHERE NOT plain), {_RATIOS},
same AS (SELECT met.* FROM met LEFT JOIN ratios r ON met.a = r.a AND met.b = r.b WHERE plain OR ratio >= {fuzzy_join.LEAST}),
fill AS (SELECT conv_id, i, v FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, i ORDER BY j) AS k FROM same WHERE v IS NOT NULL AND own IS NULL) WHERE k = 1),
new AS (SELECT DISTINCT conv_id FROM y WHERE v IS NOT NULL AND name <> '' AND NOT EXISTS (SELECT 1 FROM same s WHERE s.conv_id = y.conv_id AND s.j = y.j)),
s AS MATERIALIZED (SELECT y.conv_id, y.j, list(s.i ORDER BY s.i) FILTER (WHERE s.i IS NOT NULL) AS fits FROM y LEFT JOIN same s ON s.conv_id = y.conv_id AND s.j = y.j GROUP BY y.conv_id, y.j),
g(conv_id, j, i, used) AS (SELECT conv_id, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST([] AS BIGINT[]) FROM new
  UNION ALL SELECT conv_id, j, i, CASE WHEN i IS NULL THEN used ELSE list_append(used, i) END FROM (SELECT g.conv_id, s.j, list_filter(s.fits, lambda k: NOT list_contains(g.used, k))[1] AS i, g.used FROM g JOIN s ON s.conv_id = g.conv_id AND s.j = g.j + 1)),
placed AS (SELECT conv_id, 0 AS side, j, i FROM g WHERE j > 0 AND i IS NOT NULL
  UNION ALL SELECT g.conv_id, 0, g.j, NULL FROM g JOIN y ON y.conv_id = g.conv_id AND y.j = g.j WHERE g.i IS NULL AND y.v IS NOT NULL AND y.name <> ''
  UNION ALL SELECT x.conv_id, 1, NULL, x.i FROM x WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.conv_id = x.conv_id AND g.i = x.i))
SELECT p.conv_id, row_number() OVER (PARTITION BY p.conv_id ORDER BY side, p.j, p.i) - 1 AS pos, CASE WHEN p.i IS NULL THEN y.name ELSE x.name END AS name, CASE WHEN p.i IS NULL THEN y.v ELSE coalesce(x.v, f.v) END AS n_chars,
  CASE WHEN p.i IS NULL THEN 'second' WHEN x.v IS NULL AND f.v IS NOT NULL THEN 'filled' ELSE 'first' END AS source
FROM placed p LEFT JOIN x ON x.conv_id = p.conv_id AND x.i = p.i LEFT JOIN y ON y.conv_id = p.conv_id AND y.j = p.j AND p.i IS NULL LEFT JOIN fill f ON f.conv_id = p.conv_id AND f.i = p.i""",
    # A cache holds the items used last: every request with the last use of every item before it, by recency.
    "cached_requests": f"""WITH e AS (SELECT user_id, ts, event_id, json_extract_string(props, '$.k') AS item, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events),
u AS (SELECT e.user_id, e.r, p.item, max(p.r) AS last_r, max(p.ts) AS last_ts FROM e JOIN e p ON p.user_id = e.user_id AND p.r < e.r GROUP BY e.user_id, e.r, p.item),
k AS (SELECT u.*, row_number() OVER (PARTITION BY u.user_id, u.r ORDER BY last_r DESC) AS place, e.ts - last_ts <= INTERVAL {CACHE_DAYS} DAY AS fresh, e.before - last_ts <= INTERVAL {CACHE_DAYS} DAY AS was, e.item = u.item AS same FROM u JOIN e ON e.user_id = u.user_id AND e.r = u.r),
h AS (SELECT user_id, r, count(*) FILTER (WHERE fresh AND place <= {CACHE_SIZE}) AS n, coalesce(bool_or(same AND fresh AND place <= {CACHE_SIZE}), false) AS hit, max(CASE WHEN fresh AND place = {CACHE_SIZE} THEN item END) AS oldest FROM k GROUP BY user_id, r)
SELECT e.user_id, ts, event_id, item, CASE WHEN hit THEN 'hit' ELSE 'miss' END AS outcome, CASE WHEN NOT hit THEN oldest END AS evicted, CAST(least({CACHE_SIZE}, coalesce(n, 0) + CASE WHEN coalesce(hit, false) THEN 0 ELSE 1 END) AS BIGINT) AS held FROM e LEFT JOIN h ON h.user_id = e.user_id AND h.r = e.r
UNION ALL SELECT user_id, last_ts + INTERVAL {CACHE_DAYS} DAY, NULL, item, 'idle', item, NULL FROM k WHERE NOT fresh AND was AND place <= {CACHE_SIZE}""",
    "page_uploads": "SELECT page_id, 'text/html' AS mime, CAST(strlen(html) AS BIGINT) AS length, sha256(html) AS sha256 FROM pages WHERE html <> ''",
    "order_lines": """WITH t AS (SELECT l_orderkey AS doc_id, l_linenumber * CAST(1000000000 AS BIGINT) + l_partkey AS pos, lower(l_returnflag) || CAST(l_linenumber AS VARCHAR) AS text, round(l_discount * 1000) AS x, l_quantity * 4 AS y FROM lineitem),
a AS (SELECT *, CASE WHEN y - lag(y) OVER (PARTITION BY doc_id ORDER BY y, pos) <= 12 THEN 0 ELSE 1 END AS n FROM t),
b AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY y, pos ROWS UNBOUNDED PRECEDING) AS r FROM a),
c AS (SELECT *, CASE WHEN lag(r) OVER w = r AND x - (lag(x) OVER w + 12) <= 50 THEN 0 ELSE 1 END AS m, row_number() OVER w AS nth FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY r, x, y, pos)),
d AS (SELECT *, sum(m) OVER (PARTITION BY doc_id ORDER BY nth ROWS UNBOUNDED PRECEDING) AS k FROM c)
SELECT doc_id, CAST(k AS BIGINT) AS line_no, upper(string_agg(text, ' ' ORDER BY nth)) AS line FROM d GROUP BY doc_id, k""",
    "answered_turns": """WITH t AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS k FROM conversations)
SELECT a.conv_id, a.turn, b.turn AS answer, CAST(length(a.text) AS BIGINT) AS n_asked, CAST(length(b.text) AS BIGINT) AS n_answered FROM t a LEFT JOIN t b ON a.conv_id = b.conv_id AND a.k = b.k AND b.role = 'assistant' WHERE a.role = 'user'""",
    "new_lines": """WITH l AS (SELECT doc_id, unnest(w) AS line, CAST(unnest(range(len(w))) AS BIGINT) AS pos FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS w FROM documents)),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) AS nth FROM l), g AS (SELECT doc_id - 1 AS doc_id, line, count(*) AS n FROM l GROUP BY ALL)
SELECT n.doc_id, n.pos, n.line FROM n LEFT JOIN g ON n.doc_id = g.doc_id AND n.line = g.line WHERE n.nth > coalesce(g.n, 0)""",
    "first_words": f"""SELECT word, doc_id, CAST(pos AS BIGINT) AS pos FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY doc_id, pos) AS k FROM ({_words_sql("documents", "doc_id")})) WHERE k = 1""",
    "number_sums": """WITH p AS (SELECT page_id, list_transform(list_filter(regexp_extract_all(html, '[0-9]+'), lambda x: length(x) <= 3), lambda x: CAST(x AS BIGINT)) AS v FROM pages),
w AS (SELECT page_id, v[i] AS one, v[i + 1] AS two, v[i + 2] AS total FROM (SELECT page_id, v, unnest(range(1, len(v) - 1)) AS i FROM p))
SELECT page_id, one, two, total, count(*) AS n FROM w WHERE one + two = total AND total > 0 GROUP BY ALL""",
}
