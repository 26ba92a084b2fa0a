"""Approximate nearest neighbours: p-stable hashing with several probes for each table, and an exact pass
for queries whose neighbours lie beyond its reach."""

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from gridspark.functions.sizing import stored

#: Rows of one chunk of the index; a task holds one chunk and streams the queries past it.
CHUNK_ROWS = 20_000


class Hashes:
    """``tables`` groups of ``k`` Gaussian (2-stable) projections, cut into cells of ``width``."""

    def __init__(self, dim: int, tables: int, k: int, width: float, seed: int):
        rng = np.random.default_rng(seed)
        self.a = rng.normal(size=(tables, dim, k))
        self.width = width
        self.shift = rng.uniform(0, width, (tables, 1, k))
        self.code = rng.integers(1, 1 << 62, (tables, k), dtype=np.int64) | 1
        self.moves = np.array(list(itertools.product((-1, 0, 1), repeat=k)), np.int64)

    def cells(self, x: np.ndarray):
        """Per table the cell numbers and the place inside the cell, from 0 to 1."""
        z = (np.einsum("nd,tdk->tnk", x, self.a) + self.shift) / self.width
        cell = np.floor(z)
        return cell.astype(np.int64), z - cell

    def buckets(self, x: np.ndarray) -> np.ndarray:
        cell, _ = self.cells(x)
        return np.einsum("tnk,tk->tn", cell, self.code)

    def probes(self, x: np.ndarray, n: int) -> np.ndarray:
        """Per table and query the first ``n`` buckets in order of estimated success: moves to
        neighbouring cells rank by the sum of squared distances to the walls they cross."""
        cell, place = self.cells(x)
        n = min(n, len(self.moves))
        out = np.empty((len(cell), len(x), n), np.int64)
        for t in range(len(cell)):
            cost = np.zeros((len(x), len(self.moves)))
            for i in range(self.moves.shape[1]):
                f = place[t, :, i]
                cost += np.stack([f * f, 0 * f, (1 - f) ** 2], 1)[:, self.moves[:, i] + 1]
            order = np.argsort(cost, 1, kind="stable")[:, :n]
            out[t] = (cell[t] @ self.code[t])[:, None] + (self.moves @ self.code[t])[order]
        return out


class Chunk:
    """Rows of the index with the inverted lists of their buckets; without ``hashes`` for exact search alone."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, hashes: Hashes | None = None):
        self.ids, self.x, self.hashes = ids, x, hashes
        self.tables = []
        for row in hashes.buckets(x) if hashes else ():
            code, inverse = np.unique(row, return_inverse=True)
            self.tables.append((code, np.argsort(inverse, kind="stable"), np.concatenate(([0], np.cumsum(np.bincount(inverse))))))

    def search(self, q_ids: np.ndarray, q: np.ndarray, probes: int, top: int):
        """For each query (ids, distances) of its nearest candidates, ties to the smaller id."""
        visits = self.hashes.probes(q, probes)
        for j in range(len(q)):
            here = np.zeros(len(self.ids), bool)
            for (code, rows, at), row in zip(self.tables, visits[:, j]):
                hit = np.minimum(np.searchsorted(code, row), len(code) - 1)
                for h in hit[code[hit] == row]:
                    here[rows[at[h]:at[h + 1]]] = True
            here &= self.ids != q_ids[j]
            yield self._best(np.flatnonzero(here), q[j], top)

    def exact(self, q_ids: np.ndarray, q: np.ndarray, top: int):
        """For each query (ids, distances) of its nearest rows, ties to the smaller id."""
        with np.errstate(all="ignore"):
            norm, own = (self.x ** 2).sum(1), (q ** 2).sum(1)
            # Rounded squares of distances, with a bound of their error; what may be among the nearest is computed anew.
            rough = norm + own[:, None] - 2 * (q @ self.x.T)
            slack = 16 * np.finfo(float).eps * q.shape[1] * (norm.max() + own)
            for j in range(len(q)):
                cand = np.flatnonzero(self.ids != q_ids[j])
                d = rough[j, cand]
                if len(cand) > top:
                    cand = cand[~(d > np.partition(d, top - 1)[top - 1] + slack[j])]
                yield self._best(cand, q[j], top)

    def _best(self, cand: np.ndarray, q: np.ndarray, top: int):
        dist = np.sqrt(((self.x[cand] - q) ** 2).sum(1))
        if len(cand) > top:
            near = dist <= np.partition(dist, top - 1)[top - 1]
            cand, dist = cand[near], dist[near]
        order = np.lexsort((self.ids[cand], dist))[:top]
        return self.ids[cand[order]], dist[order]


def usable(df: DataFrame) -> DataFrame:
    """(vec_id, vector) with the components as doubles, without null ids, null, empty or zero
    vectors and vectors with null or non-finite components."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    bad = F.exists("vector", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = df.filter("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("vector"))
    return rows.filter(~bad & F.exists("vector", lambda v: v != 0))


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _reach(hashes: Hashes, probes: int, x: np.ndarray, far: float, target: float, seed: int) -> float:
    """The largest distance, on a grid around ``far``, at which ``target`` of rows are found: 500
    rows of ``x`` moved so far, in directions between other rows. 0 where there is none."""
    rng = np.random.default_rng(seed)
    a, b, c = rng.integers(0, len(x), (3, 500))
    way = x[b] - x[c]
    size = np.sqrt((way ** 2).sum(1))
    from_, way = x[a[size > 0]], way[size > 0] / size[size > 0, None]
    if not len(way):
        return 0.0
    visits = hashes.probes(from_, probes)
    for r in far * 0.95 ** np.arange(-30, 100):
        hit = (visits == hashes.buckets(from_ + r * way)[:, :, None]).any(2).any(0)
        if hit.mean() >= target:
            return float(r)
    return 0.0


def fit(rows: DataFrame, dim: int, tables: int = 4, k: int = 8, top: int = 10, target: float = 0.97, sample: int = 4_000,
        seed: int = 7):
    """(hashes, probes, reach) fitted on about ``sample`` rows, those whose id hashes lowest.

    The cell width is the sample's median distance to its ``top``-th neighbour, of the distances
    above 0, times 1.25; the probes are the fewest of a doubling series that find ``target`` of the
    sample's neighbours. Up to the distance ``reach`` the probes find ``target`` of the rows or more,
    whatever the sample's neighbours are; it is below 0 where nothing can be fitted.
    """
    n = rows.count()
    turn = F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.lit(1 << 20))
    got = rows.filter(turn < int(min(1.0, sample / max(1, n)) * (1 << 20))).orderBy("vec_id").limit(2 * sample).toPandas()
    if len(got) < 3:
        return Hashes(dim, tables, k, 1.0, seed), 3 ** k, -1.0
    x = np.stack(got["vector"].to_numpy()).astype(float)
    ids = got["vec_id"].to_numpy()
    pick = np.random.default_rng(seed).permutation(len(x))[:100]
    true = {}
    for i in pick:
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        d[ids == ids[i]] = np.inf
        true[i] = np.sort(d)[:top]
    last = np.array([t[np.isfinite(t)].max() for t in true.values() if np.isfinite(t).any()])
    if not (last > 0).any():  # each has copies enough: any other row
        last = np.sqrt(((x[pick] - x[pick[::-1]]) ** 2).sum(1))
    last = last[(last > 0) & np.isfinite(last)]
    if not len(last):
        return Hashes(dim, tables, k, 1.0, seed), 3 ** k, -1.0
    far = float(np.median(last))
    hashes = Hashes(dim, tables, k, 1.25 * far * math.sqrt(2), seed)
    chunk, probes = Chunk(ids, x, hashes), 25
    while probes < 3 ** k:
        hit = [np.sum(d <= true[i].max() if len(d) else 0) / max(1, np.isfinite(true[i]).sum())
               for i, (_, d) in zip(pick, chunk.search(ids[pick], x[pick], probes, top))]
        if np.mean(hit) >= target:
            break
        probes *= 2
    probes = min(probes, 3 ** k)
    return hashes, probes, _reach(hashes, probes, x, far, target, seed)


def nearest(df: DataFrame, queries: DataFrame, top: int = 10, tables: int = 4, k: int = 8, target: float = 0.97,
            sample: int = 4_000, chunk_rows: int = CHUNK_ROWS, seed: int = 7) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``queries`` the ``top`` nearest found in ``df``.

    Both tables have vec_id and embedding. Rows are dealt to chunks of about ``chunk_rows`` by the
    hash of their id, so a bucket that holds a third of all rows is spread over all chunks; each
    chunk keeps inverted lists of its buckets, and every query visits its probes in each. Found
    rows meet their exact distance, and the best of each chunk are ranked once more; ties go to
    the smaller vec_id. A query that found fewer than ``top`` rows, or whose last is farther than
    the probes reach, is compared with every row of every chunk instead. Rows without a usable
    vector take no part; so do vectors of another length than most. A query's own id is never
    found; repeated ids are separate rows, of the queries as well. An empty table gives none.
    """
    rows = stored(usable(df), "ann-rows")
    asked = usable(queries)
    sizes = rows.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if sizes is None:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, n = sizes
    rows, asked = rows.filter(F.size("vector") == dim), asked.filter(F.size("vector") == dim)
    asked = stored(asked.select(F.monotonically_increasing_id().alias("no"), "vec_id", "vector"), "ann-queries")
    hashes, probes, reach = fit(rows, dim, tables, k, top, target, sample, seed)
    chunks = math.ceil(n / chunk_rows)
    names = ["query_id", "rank", "vec_id", "score"]
    if reach < 0:
        return _search(rows, asked, None, 0, top, chunks, seed).select(*names)
    found = stored(_search(rows, asked, hashes, probes, top, chunks, seed), "ann-found")
    sure = found.groupBy("no").agg(F.count("*").alias("finds"), F.max("score").alias("last")).filter(
        (F.col("finds") >= min(top, n)) & (F.col("last") <= reach)).select("no")
    weak = stored(asked.join(sure, "no", "left_anti"), "ann-weak")
    if weak.isEmpty():
        return found.select(*names)
    again = _search(rows, weak, None, 0, top, chunks, seed)
    return found.join(sure, "no", "left_semi").select(*names).unionByName(again.select(*names))


def _search(rows: DataFrame, asked: DataFrame, hashes: Hashes | None, probes: int, top: int, chunks: int, seed: int) -> DataFrame:
    """(no, query_id, rank, vec_id, score) of the queries (no, vec_id, vector), by ``hashes`` or, without them, exact."""
    box = rows.sparkSession.sparkContext.broadcast((hashes, probes))
    turn = F.pmod(F.xxhash64(F.lit(seed + 1), "vec_id"), F.lit(chunks)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))
    both = rows.select(turn.alias("chunk"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("no"), "vec_id", "vector").unionByName(
        asked.select(every.alias("chunk"), F.lit(1).alias("kind"), "no", "vec_id", "vector"))
    both = both.repartition(chunks, "chunk").sortWithinPartitions("chunk", "kind")

    def run(batches):
        hashes, probes = box.value
        now, ids, xs, index = None, [], [], None
        for b in batches:
            chunk, kind = b.column("chunk").to_numpy(), b.column("kind").to_numpy()
            cuts = np.flatnonzero((chunk[1:] != chunk[:-1]) | (kind[1:] != kind[:-1])) + 1
            for a, z in zip([0, *cuts], [*cuts, len(chunk)]):
                if a == z:
                    continue
                if now != chunk[a]:
                    now, ids, xs, index = chunk[a], [], [], None
                part = b.slice(a, z - a)
                part_no, part_ids, x = part.column("no").to_numpy(), part.column("vec_id").to_numpy(), _matrix(part.column("vector"))
                if kind[a] == 0:
                    ids.append(part_ids)
                    xs.append(x)
                    continue
                if index is None and ids:
                    index = Chunk(np.concatenate(ids), np.concatenate(xs), hashes)
                if index is None:
                    continue
                for s in range(0, len(x), 200):
                    q_no, q_ids, q = part_no[s:s + 200], part_ids[s:s + 200], x[s:s + 200]
                    found = list(index.search(q_ids, q, probes, top) if hashes else index.exact(q_ids, q, top))
                    size = [len(i) for i, _ in found]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.repeat(q_no, size)), pa.array(np.repeat(q_ids, size)),
                        pa.array(np.concatenate([i for i, _ in found])), pa.array(np.concatenate([d for _, d in found]))],
                        ["no", "query_id", "vec_id", "score"])

    best = W.partitionBy("no").orderBy("score", "vec_id")
    found = both.mapInArrow(run, "no long, query_id long, vec_id long, score double").withColumn("rank", F.row_number().over(best))
    return found.filter(F.col("rank") <= top)
