"""Classes of near duplicates from buckets of candidates, compared in place and block by block."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, drop, partitions

BLOCK = 1024  # members compared in one piece
BLOCK_BYTES = 8 << 20

#: From the payloads of some members: which pairs may be links (a square matrix of which the upper
#: half counts), and the exact test of a pair.
Compare = Callable[[list[tuple]], tuple[np.ndarray, Callable[[int, int], bool]]]


def link(roots: np.ndarray, side: np.ndarray, compare: Compare, payloads: list[tuple]) -> np.ndarray:
    """Merge the roots of members that links join, all or across two sides; no pair within one root is tested."""
    roots = roots.copy()
    if (roots == roots[0]).all():
        return roots
    across = len(set(side.tolist())) > 1
    may, test = compare(payloads)
    for i in range(len(roots) - 1):
        for j in np.flatnonzero(may[i, i + 1 :]) + i + 1:
            a, b = roots[i], roots[j]
            if a != b and not (across and side[i] == side[j]) and test(i, int(j)):
                roots[roots == max(a, b)] = min(a, b)
        if (roots == roots[0]).all():
            break
    return roots


def _linker(make: Callable[[], Compare], columns: list[str]):
    """Over rows sorted by (bucket, one, two): an edge from each member to the root that it gets."""

    def run(batches):
        compare = make()
        held: dict[int, tuple] = {}
        now = None
        out: list[tuple[int, int]] = []

        def settle() -> None:
            if len(held) > 1:
                nodes = np.array(list(held), np.int64)
                before = np.array([r[0] for r in held.values()], np.int64)
                after = link(before, np.array([r[1] for r in held.values()]), compare, [r[2:] for r in held.values()])
                out.extend((n, r) for n, b, r in zip(nodes.tolist(), before.tolist(), after.tolist(), strict=True) if b != r)
            held.clear()

        def batch_of():
            got = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else ([], []))], ["a", "b"])
            out.clear()
            return got

        for batch in batches:
            units = zip(*(batch.column(c).to_pylist() for c in ("bucket", "one", "two")), strict=True)
            rows = zip(*(batch.column(c).to_pylist() for c in ("node", "root", "side", *columns)), strict=True)
            for unit, (node, *row) in zip(units, rows, strict=True):
                if unit != now:
                    settle()
                    now = unit
                held[node] = tuple(row)
            if len(out) > 10_000:
                yield batch_of()
        settle()
        yield batch_of()

    return run


def linked_classes(members: DataFrame, payload: DataFrame, make: Callable[[], Compare], block: int = BLOCK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Connected components of the links within buckets.

    ``members``: rows (bucket long, node long, size), each pair once; size is what the node's payload
    takes. ``payload``: one row (node, ...) per node that shares a bucket. ``make`` is called in a
    worker. Of buckets with the same members one is looked at. A bucket is cut into blocks; each
    member goes to one block, and the bucket's smallest node to all of them, which joins the blocks of
    a large group of copies. Only buckets of several blocks whose members aren't one component by then have
    pairs of blocks compared, and of those only pairs that hold several components. So every two
    members of a bucket are compared or in one component, and what moves is one copy of each member
    but for buckets that are large and unlike.

    Returns (node, root) for the nodes that have a link; root is the smallest node of the component.
    """
    spark = members.sparkSession
    hashes = [F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"x{k}") for k in (1, 2)]
    buckets = members.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.min("node").alias("pivot"), *hashes).where("n > 1")
    buckets = buckets.groupBy("n", "pivot", "x1", "x2").agg(F.min("bucket").alias("bucket"), F.min("bytes").alias("bytes"))
    buckets = cut(buckets.select("bucket", "pivot", F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("bytes") / block_bytes)).cast("int").alias("blocks")))
    placed = cut(members.join(buckets, "bucket").select("bucket", "node", "blocks", F.pmod(F.hash("node"), F.col("blocks")).alias("block")))
    columns = [c for c in payload.columns if c != "node"]

    def compared(rows: DataFrame) -> DataFrame:
        """rows: node, root, bucket, one, two, side."""
        keys = ["bucket", "one", "two"]
        full = rows.join(payload, "node").select(*keys, "node", "root", "side", *columns)
        return full.repartition(partitions(spark), *keys).sortWithinPartitions(*keys).mapInArrow(_linker(make, columns), "a long, b long")

    own = placed.select("bucket", "node", F.col("block").alias("one"))
    pivots = buckets.where("blocks > 1").select("bucket", F.col("pivot").alias("node"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("one"))
    first = own.union(pivots).select("bucket", "node", F.col("node").alias("root"), "one", F.col("one").alias("two"), F.lit(0).alias("side"))
    links = cut(compared(first))
    labels = components(links)

    wide = placed.where("blocks > 1").join(labels, "node", "left").select("bucket", "node", "block", F.coalesce("root", "node").alias("root"))
    several = wide.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("bucket")
    wide = cut(wide.join(several, "bucket", "left_semi"))
    if not wide.isEmpty():
        ends = wide.groupBy("bucket", "block").agg(F.min("root").alias("low"), F.max("root").alias("high"))
        other = ends.select(F.col("bucket").alias("same"), F.col("block").alias("two"), F.col("low").alias("low2"), F.col("high").alias("high2"))
        pairs = ends.withColumnRenamed("block", "one").join(other, (F.col("bucket") == F.col("same")) & (F.col("one") < F.col("two"))).where("least(low, low2) <> greatest(high, high2)")
        pairs = cut(pairs.select("bucket", "one", "two"))
        both = pairs.select("*", F.explode(F.array(F.struct(F.col("one").alias("block"), F.lit(0).alias("side")), F.struct(F.col("two").alias("block"), F.lit(1).alias("side")))).alias("x"))
        rows = wide.join(both.select("bucket", "one", "two", "x.block", "x.side"), ["bucket", "block"]).select("bucket", "node", "root", "one", "two", "side")
        labels = components(links.union(cut(compared(rows))).union(labels.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    drop(spark)
    return labels
