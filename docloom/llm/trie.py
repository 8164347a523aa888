"""The trie of all conversation prefixes: who shares a prefix, and what sharing it saves.

Turns are sorted by range, so that a conversation of any length is spread over tasks; from there on a turn
is two 64-bit hashes and a byte count, and texts are moved once. A prefix is named by its depth and the
exclusive or of its turns' hashes, each hashed with its place (128 bits); running values over long
conversations are taken in cells of CELL turns, with one value carried from cell to cell.

Totals of subtrees come by peeling leaves. The nodes with one smallest member form a path from the
node where that conversation leaves smaller ones down to its end, so every node is in one path and a path
hangs below one node of a smaller path. A path holds a counter of the paths that hang below it and haven't
reported; a path whose counter is zero sends its totals (leaves, saved tokens) to the node above it, and
rounds go on until only the root's path is left. As a path is one node of this peeling, rounds are as
many as branchings lie one below the other, however long the conversations are. Running sums up each
path then give the totals of its nodes.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, cut_plain, drop, partitions, written

GROUP = 5  # conversations that share the head of one of them
HEADS = 9  # heads have 0 to 8 turns
CELL = 4096
NO_ENDS = hashlib.sha256(b"").hexdigest()
COLUMNS = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def _numbered(conversations: DataFrame) -> tuple[DataFrame, str]:
    """conv_id, part, seq, t1, t2, bytes: seq counts the turns of a part in order, and parts are in order too."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    # Ranges are told apart by the beginnings of texts only: their borders are gathered by the driver.
    key = [F.col("conv_id"), F.asc_nulls_first("turn")]
    ranged = turns.repartitionByRange(partitions(turns.sparkSession), *key, F.substring("role", 1, 32), F.substring("text", 1, 32))
    ranged = ranged.sortWithinPartitions(*key, "role", "text").withColumn("seq", F.monotonically_increasing_id())
    hashes = [F.xxhash64(F.lit(k), "role", "text").alias(f"t{k}") for k in (1, 2)]
    return written(ranged.select("conv_id", F.shiftright("seq", 33).cast("int").alias("part"), "seq", *hashes, F.octet_length("text").cast("long").alias("bytes")))


def _rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns of the rebuilt conversations (conv_id, depth, t1, t2, bytes, end), and conversations (conv_id, length)."""
    spans = turns.groupBy("conv_id", "part").agg(F.min("seq").alias("start"), F.count("*").alias("n"))
    by_part = Window.partitionBy("conv_id").orderBy("part")
    spans = spans.withColumn("before", F.coalesce(F.sum("n").over(by_part.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    spans = cut(spans.withColumn("turns", F.sum("n").over(Window.partitionBy("conv_id"))).drop("n"))
    convs = spans.where("before = 0").select("conv_id", "turns", (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base"), (F.crc32(F.col("conv_id").cast("string")) % HEADS).alias("head"))
    bases = convs.select(F.col("conv_id").alias("base"), F.col("turns").alias("base_turns"))
    taken = F.least("head", F.coalesce("base_turns", F.lit(0)))
    convs = convs.join(bases, "base", "left").withColumn("taken", taken).withColumn("length", F.col("taken") + F.greatest(F.col("turns") - F.col("head"), F.lit(0)))
    convs = cut(convs.select("conv_id", "base", "head", "taken", "length"))
    # At most nine conversations have one base, so what they take of it travels as an array.
    members = convs.where("taken > 0").groupBy("base").agg(F.collect_list(F.struct("conv_id", "taken", "length")).alias("takers")).withColumnRenamed("base", "conv_id")
    spans = spans.join(convs, "conv_id").join(members, "conv_id", "left").select("conv_id", "part", "start", "before", "head", "taken", "length", "takers")
    placed = turns.join(spans, ["conv_id", "part"]).withColumn("p", F.col("seq") - F.col("start") + F.col("before") + 1)
    target = lambda c, d, n: F.struct(c.alias("conv_id"), d.alias("depth"), n.alias("length"))
    own = F.when(F.col("p") > F.col("head"), F.array(target(F.col("conv_id"), F.col("p") - F.col("head") + F.col("taken"), F.col("length"))))
    lent = F.transform(F.filter("takers", lambda m: m["taken"] >= F.col("p")), lambda m: target(m["conv_id"], F.col("p"), m["length"]))
    none = F.array().cast("array<struct<conv_id:bigint,depth:bigint,length:bigint>>")
    rows = placed.select("t1", "t2", "bytes", F.explode(F.concat(F.coalesce(own, none), F.coalesce(lent, none))).alias("to"))
    return rows.select("to.conv_id", "to.depth", "t1", "t2", "bytes", (F.col("to.depth") == F.col("to.length")).alias("end")), convs.select("conv_id", "length")


def _running(rows: DataFrame, key: str, order: str, values: dict[str, tuple[str, object]], longest: int, cell: int, down: bool = False) -> DataFrame:
    """Running aggregates of ``values`` (name: column and a function that adds up) by order within key, from
    the first row to the current one, or from the last if ``down``. order counts from 0 or 1 to ``longest``.

    Rows are dealt by key and cell of the order; where any key has several cells, what the earlier cells of a key
    come to is joined to it.
    """
    rows = rows.withColumn("cell", F.floor(F.col(order) / cell))
    by = F.desc if down else F.asc
    inner = Window.partitionBy(key, "cell").orderBy(by(order)).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumns({name: add(F.col(column)).over(inner) for name, (column, add) in values.items()})
    if longest >= cell:
        outer = Window.partitionBy(key).orderBy(by("cell")).rowsBetween(Window.unboundedPreceding, -1)
        cells = rows.groupBy(key, "cell").agg(*[add(F.col(column)).alias(f"carried_{name}") for name, (column, add) in values.items()])
        cells = cells.select(key, "cell", *[add(F.col(f"carried_{name}")).over(outer).alias(f"carried_{name}") for name, (_, add) in values.items()])
        out = out.join(cells, [key, "cell"])
        both = {name: F.array(F.col(name), F.coalesce(F.col(f"carried_{name}"), F.lit(0))) for name in values}
        out = out.withColumns({name: _two(add, x) for (name, x), (_, add) in zip(both.items(), values.values(), strict=True)}).drop(*[f"carried_{name}" for name in values])
    return out.drop("cell")


def _two(add, pair):
    return F.get(pair, F.lit(0)).bitwiseXOR(F.get(pair, F.lit(1))) if add is F.bit_xor else F.get(pair, F.lit(0)) + F.get(pair, F.lit(1))


def _digests(batches):
    """SHA-256 of the ids of each node, over rows sorted by node and id; an id is held no longer than its batch."""
    now, state = None, None
    for batch in batches:
        out: list[tuple] = []
        for *node, conv_id in zip(*(batch.column(c).to_pylist() for c in ("depth", "n1", "n2", "conv_id")), strict=True):
            if node != now:
                if now is not None:
                    out.append((*now, state.hexdigest()))
                now, state = node, hashlib.sha256(str(conv_id).encode())
            else:
                state.update(b",%d" % conv_id)
        if out:
            yield _digest_rows(out)
    if now is not None:
        yield _digest_rows([(*now, state.hexdigest())])


def _digest_rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["depth", "n1", "n2", "ends_sha256"])


def _peeled(paths: DataFrame) -> DataFrame:
    """What every path sends up: conv_id and depth of the node that gets it, leaves, saved.

    ``paths``: path, parent (null for the root's), top (its depth), leaves and saved of its own nodes.
    """
    below = paths.where("parent is not null").groupBy(F.col("parent").alias("path")).agg(F.count("*").alias("waits"))
    state = cut_plain(paths.join(below, "path", "left").withColumn("waits", F.coalesce("waits", F.lit(0))))
    sent = []
    while True:
        done = state.where("waits = 0 and parent is not null").select(F.col("parent").alias("conv_id"), (F.col("top") - 1).alias("depth"), "leaves", "saved")
        sent.append(done)
        left = state.where("waits > 0")
        if left.isEmpty():
            return reduce(DataFrame.union, sent)
        got = done.groupBy(F.col("conv_id").alias("path")).agg(F.count("*").alias("n"), F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        plus = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
        state = cut_plain(left.join(got, "path", "left").select("path", "parent", "top", plus("leaves", "l").alias("leaves"), plus("saved", "s").alias("saved"), (F.col("waits") - F.coalesce("n", F.lit(0))).alias("waits")))


def prefix_trie(conversations: DataFrame, cell: int = CELL) -> DataFrame:
    """Nodes of the trie of rebuilt ``conversations`` (conv_id integer, turn, role, text; other columns are ignored).

    A conversation's turns are ordered by turn, null first, equal turns by role, then text (both null as
    empty); repeated rows are turns of their own. Conversation c begins with the first h turns of
    conversation c - c % 5 (remainder with the sign of c), h = crc32(c in decimals) % 9, and goes on with its own turns after its first
    h. Rows whose conv_id is null belong to no conversation. A node is a distinct sequence of first turns
    (role, text) by a 128-bit hash; the root has none. Returned per node: conv_id (smallest member),
    depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    An empty table has no root: its result is empty.
    """
    spark = conversations.sparkSession
    turns, at_turns = _numbered(conversations)
    rows, convs = _rebuilt(turns)
    n, least, longest = convs.agg(F.count("*"), F.min("conv_id"), F.max("length")).first()
    if not n:
        drop(spark, at_turns)
        return spark.createDataFrame([], COLUMNS)
    rows = rows.withColumns({f"x{k}": F.xxhash64("depth", f"t{k}") for k in (1, 2)})
    rows = _running(rows, "conv_id", "depth", {"n1": ("x1", F.bit_xor), "n2": ("x2", F.bit_xor)}, longest, cell)
    rows, at_rows = written(rows.select("conv_id", "depth", "n1", "n2", F.col("n1").bitwiseXOR(F.col("x1")).alias("p1"), F.col("n2").bitwiseXOR(F.col("x2")).alias("p2"), "bytes", "end"))

    node = ["depth", "n1", "n2"]
    nodes = rows.groupBy(*node).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("p1").alias("p1"), F.min("p2").alias("p2"), ((F.count("*") - 1) * F.min("bytes")).alias("saved"))
    root = spark.range(1).select(*[F.lit(0).cast("long").alias(c) for c in node], F.lit(least).alias("conv_id"), F.lit(n).alias("n_convs"), *[F.lit(None).cast("long").alias(c) for c in ("p1", "p2")], F.lit(0).cast("long").alias("saved"))
    nodes, at_nodes = written(nodes.unionByName(root))
    ends = rows.where("end").select(*node, "conv_id").unionByName(convs.where("length = 0").select(*[F.lit(0).cast("long").alias(c) for c in node], "conv_id"))
    ends = ends.repartition(*node).sortWithinPartitions(*node, "conv_id").mapInArrow(_digests, "depth long, n1 long, n2 long, ends_sha256 string")
    kids = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("n1"), F.col("p2").alias("n2")).agg(F.count("*").alias("n_children"))
    whole = nodes.join(kids, node, "left").join(ends, node, "left")
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("n1").alias("p1"), F.col("n2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    whole = whole.join(above.where("depth > 1"), ["depth", "p1", "p2"], "left").withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.lit(least)).otherwise(F.col("parent_conv_id")))
    whole, _ = written(whole.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "saved", F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256")))
    drop(spark, at_turns, at_rows, at_nodes)

    paths = whole.groupBy(F.col("conv_id").alias("path")).agg(F.min_by("parent_conv_id", "depth").alias("parent"), F.min("depth").alias("top"), F.sum((F.col("n_children") == 0).cast("long")).alias("leaves"), F.sum("saved").alias("saved"))
    sent = _peeled(paths).groupBy("conv_id", "depth").agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
    own = whole.join(sent, ["conv_id", "depth"], "left").withColumns({"l": F.coalesce("l", F.lit(0)) + (F.col("n_children") == 0).cast("long"), "s": F.coalesce("s", F.lit(0)) + F.col("saved")})
    totals = _running(own, "conv_id", "depth", {"n_leaves": ("l", F.sum), "saved_tokens": ("s", F.sum)}, longest, cell, down=True)
    return totals.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


# The same by lists: every prefix of every rebuilt conversation, and every node with all nodes above it.
ORACLE = f"""
WITH bits AS (SELECT list(list_reduce(range(8), lambda c, k: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END), i) ORDER BY i) AS crc FROM (SELECT unnest(range(256)) AS i)),
o AS (SELECT conv_id, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT conv_id, turns, xor(list_reduce(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda c, x: xor(c >> 8, crc[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) % {HEADS} AS h FROM o, bits),
s AS (SELECT h.conv_id, list_concat(list_slice(coalesce(b.turns, []), 1, h), list_slice(h.turns, h + 1, len(h.turns))) AS s FROM h LEFT JOIN o b ON b.conv_id = h.conv_id - h.conv_id % {GROUP}),
p AS (SELECT conv_id, d, len(s) AS n, list_slice(s, 1, d) AS node FROM (SELECT conv_id, s, unnest(range(len(s) + 1)) AS d FROM s)),
n AS (SELECT node, d, min(conv_id) AS conv_id, count(*) AS n_convs, CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * strlen(node[d].t) END AS own,
  sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE d = n), '')) AS ends FROM p GROUP BY node, d),
k AS (SELECT list_slice(node, 1, d - 1) AS node, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k ON n.node = k.node),
a AS (SELECT list_slice(node, 1, e) AS node, CAST(sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_leaves, CAST(sum(own) AS BIGINT) AS saved_tokens FROM (SELECT node, n_children, own, unnest(range(d + 1)) AS e FROM f) GROUP BY 1)
SELECT f.conv_id, f.d AS depth, u.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens, f.ends AS ends_sha256
FROM f JOIN a ON f.node = a.node LEFT JOIN f u ON f.d > 0 AND u.node = list_slice(f.node, 1, f.d - 1)
"""
