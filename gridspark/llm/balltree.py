"""Ranked lexical search: exact inner products through ball trees over sparse integer vectors.

A document is the vector of its impacts, (1000000000 * tf) div (1000 * tf + 8 * m), over the terms that
items ask for; an item is the vector of its terms' weights; the score is their inner product. Blocks of
documents are split into balls. No member of a ball scores above centre * item + radius * |item|, so
whole subtrees go once the worst hit of an item is better. Centres are whole numbers and roots are
rounded up, so all bounds are exact in 64 bits and hold without a margin.
"""

import heapq
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from gridspark.functions.sizing import stored

#: Distinct terms that one pass over the documents looks for, unless a single item has more.
PASS_TERMS = 200_000
BLOCK_DOCS = 8_192
#: Entries of a block's vectors, and numbers that the centres of its tree may hold.
BLOCK_ENTRIES = 2_000_000
CENTRE_NUMBERS = 4_000_000
LEAF_DOCS = 32
TEXT_BYTES = 1 << 20
#: All bytes that separate terms become spaces, A-Z become a-z; bytes of other letters stay.
TERMS = bytes(x + 32 if 65 <= x <= 90 else x if 48 <= x <= 57 or 97 <= x <= 122 or x >= 128 else 32 for x in range(256))


def term_counts(text: str | None) -> tuple[int, Counter]:
    """Number of terms and how often each occurs; long texts are taken in pieces that end between terms."""
    data, count, at = (text or "").encode(), Counter(), 0
    while at < len(data):
        end = at + TEXT_BYTES
        piece = data[at:end].translate(TERMS)
        while end < len(data) and not piece.endswith(b" "):
            piece += data[end:end + 4096].translate(TERMS)
            cut = piece.rfind(b" ", end - at) + 1
            end = at + cut if cut else end + 4096
            piece = piece[:end - at]
        count.update(piece.split())
        at = end
    return sum(count.values()), count


def root_up(x: np.ndarray) -> np.ndarray:
    """Smallest whole numbers whose squares are not below ``x``."""
    r = np.sqrt(x.astype(np.float64)).astype(np.int64) - 1
    while (low := r * r < x).any():
        r += low
    return r


class Tree:
    """Balls over one block: rows ``indptr`` of columns ``cols`` with ``vals``; no row is empty.

    Children follow their parents; a leaf's rows lie together in ``order`` and in the entries.
    """

    def __init__(self, indptr, cols, vals, leaf=LEAF_DOCS):
        self.columns, cols = np.unique(cols, return_inverse=True)
        self.indptr, self.cols, self.vals = indptr, cols, vals
        self.norm = np.add.reduceat(vals * vals, indptr[:-1])
        docs = len(indptr) - 1
        leaf = max(leaf, -(-2 * docs * len(self.columns) // CENTRE_NUMBERS))
        self.centres, self.radii, self.leaves, self.children = [], [], [], []
        waiting, order, at = [(np.arange(docs), None)], [], 0
        while waiting:
            rows, parent = waiting.pop()
            node = self._ball(rows)
            if parent is not None:
                self.children[parent].append(node)
            if len(rows) > leaf:
                waiting += [(part, node) for part in self._halves(rows, self.centres[node])]
            else:
                self.leaves[node] = (at, at + len(rows))
                order.append(rows)
                at += len(rows)
        self.order = np.concatenate(order)
        at, first = self._entries(self.order)
        self.cols, self.vals, self.indptr = self.cols[at], self.vals[at], np.append(first, len(at))

    def _entries(self, rows):
        """Positions of the rows' entries, and where each row's begin among them."""
        size = self.indptr[rows + 1] - self.indptr[rows]
        first = np.cumsum(size) - size
        return np.arange(size.sum()) + np.repeat(self.indptr[rows] - first, size), first

    def _squares(self, rows, centre):
        """Squared distances of rows from a centre."""
        at, first = self._entries(rows)
        return self.norm[rows] - 2 * np.add.reduceat(self.vals[at] * centre[self.cols[at]], first) + int((centre * centre).sum())

    def _ball(self, rows):
        at, _ = self._entries(rows)
        # Sums stay far below 2 ** 53, so they are exact.
        total = np.bincount(self.cols[at], weights=self.vals[at], minlength=len(self.columns)).astype(np.int64)
        centre = total // len(rows)
        self.centres.append(centre)
        self.radii.append(int(root_up(self._squares(rows, centre).max(keepdims=True))[0]))
        self.leaves.append(None)
        self.children.append([])
        return len(self.centres) - 1

    def _point(self, row):
        out = np.zeros(len(self.columns), np.int64)
        at = slice(self.indptr[row], self.indptr[row + 1])
        out[self.cols[at]] = self.vals[at]
        return out

    def _halves(self, rows, centre):
        """Two equal parts: by how much nearer rows are to one of two far ones than to the other."""
        a = rows[int(np.argmax(self._squares(rows, centre)))]
        from_a = self._squares(rows, self._point(a))
        from_b = self._squares(rows, self._point(rows[int(np.argmax(from_a))]))
        order, half = np.argsort(from_a - from_b, kind="stable"), len(rows) // 2
        return rows[order[:half]], rows[order[half:]]

    def scores(self, leaf, weights):
        """Rows of a leaf and their inner products with ``weights``, a number for each of the block's columns."""
        a, z = leaf
        first = self.indptr[a:z + 1]
        at = slice(first[0], first[-1])
        return self.order[a:z], np.add.reduceat(self.vals[at] * weights[self.cols[at]], first[:-1] - first[0])


class Searcher:
    """Best hits of items over blocks. ``items`` are (term numbers, weights), one pair each."""

    def __init__(self, items, k: int):
        self.k, self.best = k, [[] for _ in items]  # heaps of (score, -place in the order of ids, id)
        self.items = items
        self.sizes = np.array([len(t) for t, _ in items], np.int64)
        self.terms = np.concatenate([t for t, _ in items]) if items else np.zeros(0, np.int64)
        self.weights = np.concatenate([w for _, w in items]) if items else np.zeros(0, np.int64)
        self.owner = np.repeat(np.arange(len(items)), self.sizes)
        self.norms = root_up(self._sums(self.weights * self.weights))
        self.balls = self.scored = 0

    def _sums(self, values):
        out = np.zeros(len(self.items), np.int64)
        np.add.at(out, self.owner[:len(values)], values)
        return out

    def add(self, ids, indptr, cols, vals):
        """Search one block; ``ids`` are its documents, None allowed."""
        full = np.flatnonzero(np.diff(indptr))
        if not len(full):
            return
        tree, ids = Tree(np.append(indptr[full], indptr[-1]), cols, vals), [ids[i] for i in full]
        place = np.searchsorted(tree.columns, self.terms)
        inside = place < len(tree.columns)
        inside[inside] = tree.columns[place[inside]] == self.terms[inside]
        inside = np.flatnonzero(inside)
        place, owner, weights = place[inside], self.owner[inside], self.weights[inside]
        first = np.searchsorted(owner, np.arange(len(self.items) + 1))
        bounds = {}

        def bound(node):
            """Upper bounds of all items, once a node is met."""
            if node not in bounds:
                total = np.zeros(len(self.items), np.int64)
                np.add.at(total, owner, weights * tree.centres[node][place])
                bounds[node] = total + self.norms * tree.radii[node]
                self.balls += 1
            return bounds[node]

        dense = np.zeros(len(tree.columns), np.int64)
        for q in range(len(self.items)):
            part = slice(first[q], first[q + 1])
            if first[q] == first[q + 1]:
                continue
            heap, best = [(-int(bound(0)[q]), 0)], self.best[q]
            dense[place[part]] = weights[part]
            while heap:
                top, node = heapq.heappop(heap)
                if len(best) == self.k and -top < best[0][0]:
                    break
                for child in tree.children[node]:
                    b = min(-top, int(bound(child)[q]))
                    if b > 0 and (len(best) < self.k or b >= best[0][0]):
                        heapq.heappush(heap, (-b, child))
                if tree.leaves[node] is not None:
                    self._leaf(q, tree.scores(tree.leaves[node], dense), ids)
            dense[place[part]] = 0

    def _leaf(self, q, found, ids):
        rows, score = found
        self.scored += len(rows)
        best = self.best[q]
        least = best[0][0] if len(best) == self.k else 1
        for i in np.flatnonzero(score >= least):
            d = ids[rows[i]]
            hit = (int(score[i]), d is not None, -d if d is not None else 0)
            if len(best) < self.k:
                heapq.heappush(best, hit)
            elif hit > best[0]:
                heapq.heapreplace(best, hit)

    def hits(self):
        """(item, id, score) of the hits kept."""
        return [(q, -d if known else None, s) for q, best in enumerate(self.best) for s, known, d in best]


def _passes(items: DataFrame) -> DataFrame:
    """(item_id, terms, pass): distinct terms of every item, dealt into passes of about PASS_TERMS terms."""
    def run(batches):
        for b in batches:
            got = [sorted(term_counts(t)[1]) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("item_id"), pa.array(got, pa.list_(pa.binary()))], ["item_id", "terms"])

    kind = items.schema["item_id"].dataType.simpleString()
    found = items.select("item_id", "text").mapInArrow(run, f"item_id {kind}, terms array<binary>")
    found = found.filter("size(terms) > 0").withColumn("no", F.monotonically_increasing_id())
    found = stored(found, "search-items")
    total = found.agg(F.sum(F.size("terms"))).first()[0] or 0
    passes = -(-total // PASS_TERMS)
    return found.withColumn("pass", F.pmod(F.xxhash64("no"), F.lit(max(1, passes)))), passes


def _vectors(docs: DataFrame, terms: list[bytes]) -> DataFrame:
    """(doc_id, n, terms: numbers in ``terms``, tf) of every document with a term."""
    box = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches):
        number = {t: i for i, t in enumerate(box.value)}
        for b in batches:
            for a in range(0, b.num_rows, 500):
                part = b.slice(a, 500)
                rows, ns, ts, fs = [], [], [], []
                for i, text in enumerate(part.column("text").to_pylist()):
                    n, count = term_counts(text)
                    if n:
                        found = sorted((number[t], c) for t, c in count.items() if t in number)
                        rows.append(i)
                        ns.append(n)
                        ts.append([t for t, _ in found])
                        fs.append([c for _, c in found])
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(ns, pa.int64()),
                                                  pa.array(ts, pa.list_(pa.int32())), pa.array(fs, pa.list_(pa.int64()))], ["doc_id", "n", "terms", "tf"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n long, terms array<int>, tf array<long>")


def _document_counts(vectors: DataFrame, size: int) -> DataFrame:
    """(term, df): documents that hold each term number."""
    def run(batches):
        count = np.zeros(size, np.int64)
        for b in batches:
            count += np.bincount(b.column("terms").flatten().to_numpy(), minlength=size)
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(count[at])], ["term", "df"])

    return vectors.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


def _search(vectors: DataFrame, items, k: int, n_docs: int, length: int) -> DataFrame:
    """(no, doc_id, score): every task's best documents of each item; ``items`` has (no, term numbers, weights)."""
    box = vectors.sparkSession.sparkContext.broadcast(items)

    def run(batches):
        found = Searcher([(t, w) for _, t, w in box.value], k)
        ids, parts, docs, entries = [], [], 0, 0

        def flush():
            sizes, cols, tf, n = (np.concatenate(x) for x in zip(*parts))
            m = 10 + (90 * n * n_docs) // length
            vals = (1_000_000_000 * tf) // (1000 * tf + 8 * np.repeat(m, sizes))
            found.add(ids, np.concatenate(([0], np.cumsum(sizes))), cols, vals)
            ids.clear()
            parts.clear()

        for b in batches:
            for a in range(0, b.num_rows, 512):
                part = b.slice(a, 512)
                terms, tf = part.column("terms"), part.column("tf")
                parts.append((np.diff(terms.offsets.to_numpy()).astype(np.int64), terms.flatten().to_numpy().astype(np.int64), tf.flatten().to_numpy(), part.column("n").to_numpy()))
                ids += part.column("doc_id").to_pylist()
                docs, entries = docs + part.num_rows, entries + len(parts[-1][1])
                if docs >= BLOCK_DOCS or entries >= BLOCK_ENTRIES:
                    flush()
                    docs = entries = 0
        if parts:
            flush()
        hits = found.hits()
        yield pa.RecordBatch.from_arrays([pa.array([box.value[q][0] for q, _, _ in hits], pa.int64()), pa.array([d for _, d, _ in hits], pa.int64()),
                                          pa.array([s for _, _, s in hits], pa.int64())], ["no", "doc_id", "score"])

    return vectors.mapInArrow(run, "no long, doc_id long, score long")


def rank(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``k`` documents of highest score above 0, equal scores by
    ascending doc_id; all where there are fewer.

    ``docs`` has doc_id (a whole number) and text, ``items`` item_id and text; other columns, whatever
    their names, are not read. Terms are runs of ASCII letters and digits and all other characters
    beyond ASCII, only A-Z lower-cased; texts of any length count whole. A document's m is
    10 + (90 * n * N) div L, a term's weight floor(1000 * ln((2 * N + 2) / (2 * df + 1))).

    Items are dealt into passes of a bounded number of terms (an item with more is a pass of its own);
    a pass turns every document into the vector over its terms, counts their documents, and
    searches blocks of documents by their trees. A task keeps ``k`` hits an item over all its blocks, so only
    those are shuffled. Rows with the same or no doc_id are documents of their own, those
    without an id behind others of the same score. Repeated item_ids are items of their own, each
    with ranks from 1. Null or empty texts have no terms, give no rows, and do not count.
    """
    spark = docs.sparkSession
    kind = items.schema["item_id"].dataType.simpleString()
    items, passes = _passes(items)
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    for p in range(passes):
        # Bounded by PASS_TERMS, or one item's own terms.
        mine = items.filter(F.col("pass") == p).select("no", "terms").collect()
        terms = sorted({bytes(t) for r in mine for t in r.terms})
        vectors = stored(_vectors(docs, terms), "search-vectors")
        n_docs, length = vectors.agg(F.count("*"), F.sum("n")).first()
        if not n_docs:
            return out
        weight = F.floor(1000 * F.log((2 * F.lit(n_docs) + 2).cast("double") / (2 * F.col("df") + 1).cast("double")))
        known = _document_counts(vectors, len(terms)).select("term", weight.cast("long").alias("w")).toPandas()
        weights = np.zeros(len(terms), np.int64)
        weights[known["term"].to_numpy()] = known["w"].to_numpy()
        number = {t: i for i, t in enumerate(terms)}
        asked = []
        for r in sorted(mine, key=lambda r: r.no):
            at = np.array([number[bytes(t)] for t in r.terms], np.int64)
            at = at[weights[at] > 0]
            asked.append((r.no, at, weights[at]))
        hits = _search(vectors, asked, k, n_docs, length)
        first = W.partitionBy("no").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        hits = hits.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k)
        out = out.unionByName(hits.join(items.select("no", "item_id"), "no").select("item_id", "rank", "doc_id", "score"))
    return out


SQL = r"""
WITH dt AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM dt GROUP BY ALL),
len AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
tot AS (SELECT count(*)::BIGINT AS nd, sum(n)::BIGINT AS l FROM len),
it AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
w AS (SELECT term, floor(1000 * ln((2 * any_value(nd) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, tot GROUP BY term),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nd) // l))))::BIGINT AS score
      FROM it JOIN w USING (term) JOIN tf USING (term) JOIN len USING (doc_id), tot GROUP BY item_id, doc_id)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10
"""
