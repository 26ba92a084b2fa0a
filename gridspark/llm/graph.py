"""Connected components of an edge table, by rounds of stars in stored tables."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gridspark.functions.sizing import stored

#: Neighbours from which a node counts as a hub, and how many hubs a table has at most (a larger one has a higher limit).
HUB_ROWS = 1_000
MAX_HUBS = 100_000
#: Edges (of two longs) that one task finishes without rounds; a counted table is held against it.
FINISH_EDGES = 250_000


def roots_of(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of the nodes 0 to n - 1 the smallest one that edges (a, b) reach from it."""
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        open_ = x != y
        if not open_.any():
            return root
        np.minimum.at(root, np.maximum(x, y)[open_], np.minimum(x, y)[open_])
        while (root[root] != root).any():
            root = root[root]


def _finish(batches):
    """All edges (u, v) of a small table to rows (node, root)."""
    ends = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if ends:
        u, v = (np.concatenate(x) for x in zip(*ends))
        ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        root = roots_of(at[:len(u)], at[len(u):], len(ids))
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[root])], ["node", "root"])


def _stamp(edges: DataFrame):
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def _with_least(both: DataFrame, ends: int) -> DataFrame:
    """Each row (u, v) with ``m``, the smallest of u and its neighbours. Rows of a node with more
    than ``limit`` neighbours are not brought together: such nodes are at most MAX_HUBS by
    counting, and their table is broadcast to the rows."""
    limit = max(HUB_ROWS, -(-ends // MAX_HUBS))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("c"))
    hubs = stored(least.filter(F.col("c") > limit).select("u", "m"), "hubs")
    if hubs.isEmpty():
        return both.join(least.select("u", "m"), "u")
    hubs = F.broadcast(hubs)
    rest = both.join(hubs, "u", "left_anti").join(least.filter(F.col("c") <= limit).select("u", "m"), "u")
    return both.join(hubs, "u").unionByName(rest)


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root): for every node of an edge its smallest reachable node, itself included.

    ``edges`` has two columns of longs. Each round hangs the larger neighbours of a node on its
    smallest neighbour (large star), then the smaller ones (small star), until nothing moves;
    rounds grow with the logarithm of the longest path. Rounds are written to the shared folder,
    so a lost executor costs one round. A table of at most FINISH_EDGES edges, at the start or after
    a round, is finished by one task. Null ends and loops are ignored. An empty table gives none.
    """
    u, v = edges.columns
    e = edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).filter("u is not null and v is not null and u <> v").distinct()
    e = stored(e, name)
    stamp = _stamp(e)
    while stamp[0] > FINISH_EDGES:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, 2 * stamp[0]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.filter("u <> v").distinct(), name)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(
            F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
        e = stored(small.select("x.*").filter("u <> v").distinct(), name)
        before, stamp = stamp, _stamp(e)
        if before == stamp:
            break
    if stamp[0] <= FINISH_EDGES:
        return e.select("u", "v").coalesce(1).mapInArrow(_finish, "node long, root long")
    roots = e.select(F.col("v").alias("u")).distinct()
    return e.groupBy("u").agg(F.min("v").alias("v")).unionByName(roots.select("u", F.col("u").alias("v"))).toDF("node", "root")
