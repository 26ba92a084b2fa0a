"""N-gram Jaccard join: prefix trees over globally ordered n-gram sets.

Two sets are linked when 100 * |intersection| >= percent * |union|, so they differ in at most
k = (|x| + |y|) * (100 - percent) / (100 + percent) n-grams. Work is dealt out by what linked sets
must share: the space of n-gram hashes is cut into k + s equal ranges, of which two linked sets
agree in s at least. So each set may leave out its s - 1 ranges that most other sets have. Sets that
agree in one of the others are joined into groups, and the members of a group meet in prefix
trees, which decide exactly. A group too large for a task is cut into blocks.
"""

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gridspark.functions.sizing import MAX_BROADCAST_ROWS, stored
from gridspark.llm.arrays import mix, shingle_sets, small_batches, text_slices
from gridspark.llm.graph import components, roots_of
from gridspark.llm.names import free_names

#: N-grams of one block, and sets of the sample that every block of a group has.
BLOCK_GRAMS = 1_000_000
PIVOTS = 32
#: Signatures that a task brings together, about, and the bounds (of 64) of the rounds in which they are dealt.
PART_SIGNATURES = 4_000_000
SEND_GRAMS = 1_000_000
TURNS = (0, 4, 64)
#: Signatures that are on their way at once while sets that share them are counted, about; bits of a map of ids.
COUNT_SIGNATURES = 200_000_000
ID_BITS = 1 << 24
_K1, _K2, _K3 = (np.uint64(x) for x in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))


class Ranges:
    """Signatures of a set: for each size band it may meet partners in, one for each hash range.

    Bands are [l, 100 l / percent]; a set signs for its own and the next band, so that any two sets
    that may be linked share a band, whose k fits its largest sizes. Ranges with fewer than
    ``poor`` n-grams are left out where fewer than s ranges of the set are so poor: linked sets
    agree in s ranges at least, so one of these is rich, or else both sets are too poor in the same
    ranges and keep them all. What is left of s is what a set needs: as many signatures at least it
    has in common with any set that it is linked with.
    """

    def __init__(self, percent: int):
        self.percent = percent
        self.low, self.bands = [1], []

    def _band(self, i: int):
        while len(self.bands) <= i:
            low = self.low[-1]
            high = low * 100 // self.percent
            k = 2 * high * (100 - self.percent) // (100 + self.percent)
            spare = 1 + math.ceil(0.25 * k) if k else 1
            parts = k + spare
            load = low / parts
            poor, tail, term = 1, 0.0, math.exp(-load)
            for c in range(0, 6):  # the expected number of ranges with c n-grams or fewer
                tail += term
                if tail * parts + 2 * math.sqrt(tail * parts) > (spare - 1) / 2:
                    break
                poor, term = c + 1, term * load / (c + 1)
            cuts = np.array([(j << 64) // parts for j in range(1, parts)], np.uint64)
            self.bands.append((k, spare, poor, cuts, np.arange(parts, dtype=np.uint64) * _K1 + np.uint64(i * int(_K2) % (1 << 64))))
            self.low.append(high + 1)
        return self.bands[i]

    def sign(self, grams: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Signatures by band, and how many of them the set needs."""
        n = len(grams)
        while self.low[-1] <= n:
            self._band(len(self.bands))
        i = int(np.searchsorted(self.low, n, "right")) - 1
        sums, out, needs = None, [], []
        for band in (i, i + 1):
            k, spare, poor, cuts, salt = self._band(band)
            if not k:
                continue
            if sums is None:
                sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(grams ^ _K3))))
            at = np.concatenate(([0], np.searchsorted(grams, cuts), [n]))
            count = at[1:] - at[:-1]
            sig = mix((sums[at[1:]] - sums[at[:-1]]) + salt)
            rich = count >= poor
            if len(sig) - rich.sum() < spare:
                out.append(sig[rich])
                needs.append(spare - len(sig) + int(rich.sum()))
            else:
                out.append(sig)
                needs.append(spare)
        return out, min(needs, default=0)


class Tree:
    """Prefix tree over sets as ascending rows of ranks, with what is left below each node."""

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray):
        self.sets, self.sizes = sets, sizes
        keys = [s.astype(">u4").tobytes() for s in sets]
        order = sorted(range(len(sets)), key=keys.__getitem__)
        # node: parent, depth at its start and end, member whose items it spells, children, members that end here
        self.parent, self.start, self.end, self.member = [-1], [0], [0], [order[0] if order else 0]
        self.kids, self.here = [[]], [[]]
        path, last = [0], None
        for i in order:
            s = sets[i]
            common = 0
            if last is not None:
                m = min(len(last), len(s))
                off = np.flatnonzero(last[:m] != s[:m])
                common = int(off[0]) if len(off) else m
            while self.start[path[-1]] >= common and path[-1]:
                path.pop()
            top = path[-1]
            if self.end[top] > common:  # the edge is cut
                mid = self._add(self.parent[top], self.start[top], common, self.member[top])
                self.kids[self.parent[top]][-1] = mid
                self.parent[top], self.start[top] = mid, common
                self.kids[mid].append(top)
                path[-1] = top = mid
            if len(s) > common:
                new = self._add(top, common, len(s), i)
                self.kids[top].append(new)
                path.append(new)
                top = new
            self.here[top].append(i)
            last = s
        self.leaf = {i: node for node, own in enumerate(self.here) for i in own}
        n = len(self.parent)
        self.alive, self.least, self.rest = [0] * n, [1 << 60] * n, [0] * n
        walk, stack = [], [0]
        while stack:
            node = stack.pop()
            walk.append(node)
            stack.extend(self.kids[node])
        for node in reversed(walk):
            self.alive[node] += len(self.here[node])
            for i in self.here[node]:
                self.least[node] = min(self.least[node], int(sizes[i]))
            for kid in self.kids[node]:
                self.alive[node] += self.alive[kid]
                self.least[node] = min(self.least[node], self.least[kid])
                self.rest[node] = max(self.rest[node], self.rest[kid] + self.end[kid] - self.start[kid])

    def _add(self, parent, start, end, member):
        for column, x in ((self.parent, parent), (self.start, start), (self.end, end), (self.member, member)):
            column.append(x)
        self.kids.append([])
        self.here.append([])
        return len(self.parent) - 1

    def remove(self, i: int) -> None:
        node = self.leaf[i]
        self.here[node].remove(i)
        while node >= 0:
            self.alive[node] -= 1
            node = self.parent[node]

    def linked(self, i: int, mark: np.ndarray, percent: int) -> list[int]:
        """Members still in the tree that are linked with set ``i``; mark has its ranks set."""
        s, n, found = self.sets[i], int(self.sizes[i]), []
        stack = [(0, 0, 0)]  # node, overlap before it, items of s passed before it
        while stack:
            node, overlap, passed = stack.pop()
            edge = self.sets[self.member[node]][self.start[node]:self.end[node]]
            if len(edge):
                overlap += int(np.count_nonzero(mark[edge]))
                passed = int(np.searchsorted(s, edge[-1], "right"))
            for j in self.here[node]:
                if (100 + percent) * overlap >= percent * (n + int(self.sizes[j])):
                    found.append(j)
            left = len(s) - passed
            for kid in self.kids[node]:
                most = overlap + min(left, self.rest[kid] + self.end[kid] - self.start[kid])
                if self.alive[kid] and (100 + percent) * most >= percent * (n + self.least[kid]):
                    stack.append((kid, overlap, passed))
        return found


def join_sets(ids: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links among the sets that span all their components, each checked exactly.

    N-grams are ordered by how many sets have them, frequent ones first, so that near copies share
    long paths. One that a single set has can be in no intersection and leaves the tree; a set that
    has too few others left can be linked with none and goes, until nothing changes. A component is
    then found from any of its members: what is linked with it leaves the tree and is asked next.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    if not len(flat):
        return []
    _, rank = np.unique(flat, return_inverse=True)
    while True:
        df = np.bincount(rank, minlength=1)
        shared = df[rank] >= 2
        kept = np.bincount(owner[shared], minlength=len(sets))
        fits = 100 * kept >= percent * sizes
        stay = shared & fits[owner]
        if stay.all():
            break
        rank, owner = rank[stay], owner[stay]
        if not len(rank):
            return []
    old, rank = np.unique(rank, return_inverse=True)
    df = np.bincount(rank)
    place = np.empty(len(df), np.int64)
    place[np.argsort(-df, kind="stable")] = np.arange(len(df))
    rank = place[rank]
    order = np.lexsort((rank, owner))
    rank, owner = rank[order], owner[order]
    members, first = np.unique(owner, return_index=True)
    trimmed = np.split(rank, first[1:])
    tree = Tree(trimmed, sizes[members])
    mark, links, waiting = np.zeros(len(df), bool), [], set(range(len(members)))
    while waiting:
        seed = waiting.pop()
        tree.remove(seed)
        queue = [seed]
        while queue and tree.alive[0]:
            i = queue.pop()
            mark[trimmed[i]] = True
            for j in tree.linked(i, mark, percent):
                tree.remove(j)
                waiting.discard(j)
                queue.append(j)
                links.append((int(ids[members[i]]), int(ids[members[j]])))
            mark[trimmed[i]] = False
    return links


def _blob(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def _sign_documents(n: int, percent: int):
    """Arrow batches of (doc_id, text) to rows (doc_id, n, w1, w2, m, need, sigs): set size, set hash of 128 bits,
    signatures, their count and need. Sets met before in a batch sign only once; their documents are tied by the set hash."""
    def run(batches):
        ranges = Ranges(percent)
        for b in batches:
            seen = set()
            for lo, hi, buf, offs in text_slices(b.column("text")):
                count, whole, sigs, size, needs = [], [], [], [], []
                for grams in shingle_sets(buf, offs, n):
                    h = tuple(int(mix(mix(grams ^ k).sum(keepdims=True) + np.uint64(len(grams)))[0].astype(np.int64)) if len(grams) else 0 for k in (_K3, _K2))
                    count.append(len(grams))
                    whole.append(h)
                    signed, need = ranges.sign(grams) if len(grams) and h not in seen else ([], 0)
                    seen.add(h)
                    sigs += signed
                    size.append(sum(map(len, signed)))
                    needs.append(need)
                sigs = np.concatenate([np.zeros(0, np.uint64), *sigs]).view(np.int64)
                offsets = pa.array(np.concatenate(([0], np.cumsum(size))).astype(np.int32))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), pa.array(count, pa.int64()), *[pa.array([h[k] for h in whole], pa.int64()) for k in (0, 1)],
                                                  pa.array(size, pa.int64()), pa.array(needs, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(sigs))], ["doc_id", "n", "w1", "w2", "m", "need", "sigs"])
    return run


def _by_part(part, a, b, c):
    """Packed rows of three columns by part, in the order they have within it."""
    if len(part) and part.max() < 1 << 16:
        part = part.astype(np.uint16)  # these are sorted by counting
    order = np.argsort(part, kind="stable")
    cuts = np.flatnonzero(np.diff(part[order])) + 1
    return _packed([(int(part[at[0]]), 0, _blob(a[at]), _blob(b[at]), _blob(c[at])) for at in np.split(order, cuts) if len(at)])


def _deal(low: int, high: int, parts: int, distinct: bool):
    """(own, need, sigs) to packed rows (part, kind, a, b, c): the signatures of a round (its bounds are of 64)
    with their owner and what it needs; ``distinct`` takes out those that an owner has twice in a batch."""
    def run(batches):
        for b in batches:
            lists = b.column("sigs")
            size = np.diff(lists.offsets.to_numpy())
            own, need = (np.repeat(b.column(c).to_numpy(), size) for c in ("own", "need"))
            sig = lists.flatten().to_numpy().view(np.uint64)
            spread = mix(sig ^ _K2)
            now = (spread >> np.uint64(58) >= low) & (spread >> np.uint64(58) < high)
            at = np.flatnonzero(now)
            if distinct:
                at = at[_distinct(sig[at], own[at], need[at])]
            yield _by_part((spread[at] % np.uint64(parts)).astype(np.int64), sig[at], own[at], np.minimum(need[at], 65535).astype(np.uint16))
    return run


def _distinct(sig, own, need):
    """Places of the rows in the order by signature and owner, for each such pair the one with the smallest need."""
    order = np.lexsort((need, own, sig))
    s, o = sig[order], own[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (o[1:] != o[:-1])
    return order[new]


def _gathered(batches, *kinds):
    """Part after part the columns a, b and c of its packed rows."""
    held: dict[int, list] = {}
    for b in batches:
        for r in b.to_pylist():
            held.setdefault(r["part"], []).append((r["a"], r["b"], r["c"]))
    for key in sorted(held):
        yield [np.concatenate([np.frombuffer(r[k], kind) for r in rows]) for rows in [held.pop(key)] for k, kind in enumerate(kinds)]


#: How many owners a signature has, and what one of them needs.
_RANK = np.dtype([("df", "<u4"), ("need", "<u2")])


def _shared(parts: int):
    """Packed signatures to packed rows by owner: those that another one has too, with how many have them."""
    def run(batches):
        for sig, own, need in _gathered(batches, np.uint64, np.int64, np.uint16):
            order = np.argsort(sig)
            same = np.concatenate(([False], sig[order[1:]] == sig[order[:-1]], [False]))
            order = order[same[1:] | same[:-1]]  # most signatures have one owner
            order = order[_distinct(sig[order], own[order], need[order])]
            sig, own, need = sig[order], own[order], need[order]
            at = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1]))) if len(sig) else np.zeros(0, np.int64)
            df = np.repeat(np.diff(at, append=len(sig)), np.diff(at, append=len(sig)))
            keep = df > 1
            rank = np.empty(int(keep.sum()), _RANK)
            rank["df"], rank["need"] = df[keep], need[keep]
            yield _by_part((mix(own[keep].view(np.uint64) ^ _K3) % np.uint64(parts)).astype(np.int64), sig[keep], own[keep], rank)
    return run


def _trim(batches):
    """Packed signatures by owner to rows (doc_id, need, sigs) without the need - 1 that most others have.

    Of the signatures that two linked sets have in common, as many as either needs, the one that
    fewest have comes behind need - 1 others in the order of both, so both keep it.
    """
    for sig, own, rank in _gathered(batches, np.uint64, np.int64, _RANK):
        order = np.lexsort((sig, -rank["df"].astype(np.int64), own))
        sig, own, need = sig[order], own[order], rank["need"][order].astype(np.int64)
        at = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        size = np.diff(at, append=len(own))
        need = np.repeat(np.minimum.reduceat(need, at), size) if len(at) else need
        keep = np.arange(len(own)) - np.repeat(at, size) >= need - 1
        sig, own = sig[keep], own[keep]
        at = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1]))) if len(own) else np.zeros(0, np.int64)
        offsets = pa.array(np.append(at, len(own)).astype(np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(own[at]), pa.array(np.zeros(len(at), np.int64)), pa.ListArray.from_arrays(offsets, pa.array(sig.view(np.int64)))], ["doc_id", "need", "sigs"])


def spanning(key: np.ndarray, doc: np.ndarray):
    """A forest over documents with equal keys: every document but the smallest of its tree, with that one."""
    order = np.lexsort((doc, key))
    key, doc = key[order], doc[order]
    ids, at = np.unique(doc, return_inverse=True)
    first = np.concatenate(([True], key[1:] != key[:-1]))
    hub = at[np.flatnonzero(first)][np.cumsum(first) - 1]
    root = roots_of(at, hub, len(ids))
    off = root != np.arange(len(ids))
    return ids[off], ids[root[off]]


def _forests(batches):
    """Packed signatures to rows (u, v): a spanning forest of the owners that agree in one, over all that the task has."""
    sigs, owners = [], []
    for b in batches:
        sigs += [np.frombuffer(x, np.uint64) for x in b.column("a").to_pylist()]
        owners += [np.frombuffer(x, np.int64) for x in b.column("b").to_pylist()]
    if sigs:
        u, v = spanning(np.concatenate(sigs), np.concatenate(owners))
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])


def _grams_of_groups(n: int, parts: int):
    """(grp, doc_id, text) to packed rows (part, kind, a, b, c): n-grams within their group, with their document."""
    def rows(held, own):
        key, own = np.concatenate(held), np.concatenate(own)
        part = (key % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        out = []
        for at in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
            if len(at):
                table, index = np.unique(own[at], return_inverse=True)
                out.append((int(part[at[0]]), 0, _blob(key[at]), _blob(index.astype(np.uint32)), _blob(table)))
        return _packed(out)

    def run(batches):
        held, own, size = [], [], 0
        for b in batches:
            grp, ids = b.column("grp").to_numpy().view(np.uint64), b.column("doc_id").to_numpy()
            for lo, hi, buf, offs in text_slices(b.column("text")):
                for d, grams in zip(range(lo, hi), shingle_sets(buf, offs, n)):
                    held.append(mix(grams ^ mix(grp[d:d + 1] + _K1)))
                    own.append(np.full(len(grams), ids[d], np.int64))
                    size += len(grams)
                if size > SEND_GRAMS:
                    yield rows(held, own)
                    held, own, size = [], [], 0
        if held:
            yield rows(held, own)
    return run


def _count_shared(parts: int):
    """Packed n-grams to packed rows (a: documents, b: counts): how many of a document's n-grams another row has too."""
    def run(batches):
        held: dict[int, list] = {}
        for b in batches:
            for r in b.to_pylist():
                held.setdefault(r["part"], []).append((r["a"], r["b"], r["c"]))
        for key in sorted(held):
            rows = held.pop(key)
            grams = np.concatenate([np.frombuffer(r[0], np.uint64) for r in rows])
            doc = np.concatenate([np.frombuffer(r[2], np.int64)[np.frombuffer(r[1], np.uint32)] for r in rows])
            _, at, count = np.unique(grams, return_inverse=True, return_counts=True)
            ids, kept = np.unique(doc[count[at] > 1], return_counts=True)
            part = (mix(ids.view(np.uint64)) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            yield _packed([(int(part[x[0]]), 0, _blob(ids[x]), _blob(kept[x].astype(np.int64)), b"")
                           for x in np.split(order, np.flatnonzero(np.diff(part[order])) + 1) if len(x)])
    return run


def _sum_counts(batches):
    """Packed documents and counts to one row (doc_id, kept) for each document."""
    held: dict[int, list] = {}
    for b in batches:
        for r in b.to_pylist():
            held.setdefault(r["part"], []).append((np.frombuffer(r["a"], np.int64), np.frombuffer(r["b"], np.int64)))
    for key in sorted(held):
        ids, at = np.unique(np.concatenate([r[0] for r in held[key]]), return_inverse=True)
        kept = np.bincount(at, np.concatenate([r[1] for r in held[key]]), len(ids)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(kept)], ["doc_id", "kept"])


def _packed(rows):
    kinds = (pa.int32(), pa.int32(), *[pa.binary()] * 3)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 5, kinds)], ["part", "kind", "a", "b", "c"])


def _join_blocks(n: int, percent: int):
    """Arrow batches of (grp, block, chunk, doc_id, text), sorted by the first three, to links (u, v)."""
    def links(ids, sets):
        if len(ids) < 2:
            return []
        return join_sets(np.array(ids, np.int64), sets, percent)

    def run(batches):
        now, ids, sets, out = None, [], [], []
        for b in batches:
            grp, block, chunk, doc = (b.column(c).to_numpy() for c in ("grp", "block", "chunk", "doc_id"))
            for lo, hi, buf, offs in text_slices(b.column("text")):
                for d, grams in zip(range(lo, hi), shingle_sets(buf, offs, n)):
                    if now != (grp[d], block[d], chunk[d]):
                        out += links(ids, sets)
                        now, ids, sets = (grp[d], block[d], chunk[d]), [], []
                    ids.append(doc[d])
                    sets.append(grams)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["u", "v"])
                out = []
        out += links(ids, sets)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["u", "v"])
    return run


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= MAX_BROADCAST_ROWS else df


def _with_texts(docs: DataFrame, cand: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose id is in ``cand``, with its columns. Where these are too many for a broadcast,
    a bit map of hashes of their ids, of ID_BITS bits however many there are, holds back other texts before the join."""
    if cand.count() <= MAX_BROADCAST_ROWS:
        return docs.join(F.broadcast(cand), "doc_id")
    names = free_names([*docs.columns, *cand.columns], "word", "bits", "at")
    word, bits, at = names
    place = F.pmod(F.xxhash64(F.lit("text"), "doc_id"), F.lit(ID_BITS))
    seen = cand.select(place.alias(at)).groupBy(F.shiftright(at, 6).alias(word)).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(`{at}` & 63 as int))")).alias(bits))
    near = docs.withColumn(at, place).withColumn(word, F.shiftright(at, 6)).join(F.broadcast(seen), word)
    return near.filter(F.expr(f"getbit(`{bits}`, cast(`{at}` & 63 as int)) = 1")).drop(*names).join(cand, "doc_id")


def _run_blocks(rows: DataFrame, n: int, percent: int) -> DataFrame:
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = ("grp", "block", "chunk")
    rows = rows.select(*key, "doc_id", "text").repartition(parts, *key).sortWithinPartitions(*key)
    return stored(rows.mapInArrow(_join_blocks(n, percent), "u long, v long"), "ngram-links")


_PACKED = "part int, kind int, a binary, b binary, c binary"


def _groups(known: DataFrame, n: int, percent: int):
    """The documents (doc_id, other: smallest of the same set, n), and one document of each set in
    groups of two sets or more: (grp, doc_id, least: its smallest set, grams: of the group).

    Signatures that several sets have are counted first, and each set leaves out those that most have,
    as many as it can spare. The others are dealt out in rounds, few at first. Documents that agree become
    one before the next round, so a group that the first one joins sends each signature once from then on.
    """
    signed = stored(known.select("doc_id", "text").mapInArrow(_sign_documents(n, percent), "doc_id long, n long, w1 long, w2 long, m long, need long, sigs array<long>"), "ngram-signed")
    equal = signed.filter("n > 0").groupBy("w1", "w2").agg(F.min("doc_id").alias("other"), F.count("*").alias("m")).filter("m > 1").drop("m")
    equal = stored(equal, "ngram-equal")
    sizes = signed.select("doc_id", "n", "w1", "w2").join(_small(equal), ["w1", "w2"], "left")
    sizes = stored(sizes.select("doc_id", F.coalesce("other", "doc_id").alias("other"), "n"), "ngram-sizes")
    edges = sizes.filter("doc_id <> other").select(F.col("doc_id").alias("u"), F.col("other").alias("v"))
    signed = signed.filter("m > 0")
    total = signed.agg(F.sum("m")).first()[0] or 0
    parts = max(int(known.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // PART_SIGNATURES))
    repeated = not signed.groupBy("doc_id").count().filter("count > 1").isEmpty()
    # Each document hangs on the smallest of its set already, unless one has several sets.
    agree = components(edges, "ngram-groups") if repeated else edges.unionByName(edges.select(F.col("v").alias("u"), "v").distinct()).toDF("node", "root")
    agree = stored(agree, "ngram-agree")

    def dealt(signed, low, high, distinct):
        own = signed.join(_small(agree.filter("node <> root")), F.col("doc_id") == F.col("node"), "left").select(F.coalesce("root", "doc_id").alias("own"), "need", "sigs")
        return own.mapInArrow(_deal(low, high, 4 * parts, distinct), _PACKED).repartition(parts, "part")

    rounds = min(64, -(-total // COUNT_SIGNATURES)) or 1
    shared = [dealt(signed, 64 * i // rounds, 64 * (i + 1) // rounds, False).mapInArrow(_shared(4 * parts), _PACKED) for i in range(rounds)]
    if rounds > 1:
        shared = [stored(x, "ngram-shared") for x in shared]
    shared = reduce(DataFrame.unionByName, shared).repartition(parts, "part")
    signed = stored(shared.mapInArrow(_trim, "doc_id long, need long, sigs array<long>"), "ngram-trimmed")
    for low, high in zip(TURNS, TURNS[1:]):
        packed = dealt(signed, low, high, True)
        found = stored(packed.mapInArrow(_forests, "u long, v long"), "ngram-forests")
        if found.isEmpty():
            continue
        # Only roots and documents without one are in the forests, so the components join those alone.
        moved = _small(stored(components(found, "ngram-groups"), "ngram-moved"))
        old = agree.join(moved.toDF("was", "now"), F.col("root") == F.col("was"), "left").select("node", F.coalesce("now", "root").alias("root"))
        agree = stored(old.unionByName(moved.join(_small(agree.select("node")), "node", "left_anti")), "ngram-agree")
    heads = sizes.filter("doc_id = other and n > 0").groupBy("doc_id").agg(F.min("n").alias("least"), F.max("n").alias("n")).join(
        agree.withColumnsRenamed({"node": "doc_id", "root": "grp"}), "doc_id")
    totals = heads.groupBy("grp").agg(F.count("*").alias("m"), F.sum("n").alias("grams")).filter("m > 1")
    return sizes, heads.join(totals.select("grp", "grams"), "grp").select("grp", "doc_id", "least", "grams")


def jaccard_components(docs: DataFrame, n: int = 3, percent: int = 90, block_grams: int = BLOCK_GRAMS) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs`` (doc_id, text).

    A document's set has the hashes (64 bits) of its distinct ``n``-word shingles, A-Z lower-cased;
    with fewer words its whole sequence; none without words or text, and it is linked with nothing.
    Components follow all links of 100 * |intersection| >= percent * |union|, between different
    texts as well as equal ones; ``component_id`` is the smallest doc_id reachable, itself
    included. Rows that repeat a doc_id are one document with several sets. A null doc_id is linked
    with nothing and has a null component. No rows give no rows.

    Equal sets are one before anything is compared. A group of n-grams beyond ``block_grams`` is
    cut into blocks by the hash of doc_id, all with the same few pivots; members outside the
    group's largest component then meet every block, so no link that joins components is lost.
    """
    spark = docs.sparkSession
    docs = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = docs.filter("doc_id is not null")
    sizes, heads = _groups(known, n, percent)
    same = sizes.filter("doc_id <> other").select("doc_id", "other")
    heads = stored(heads.withColumn("blocks", F.ceil(F.col("grams") / block_grams).cast("int")), "ngram-heads")
    large = heads.filter("blocks > 1")
    if not large.isEmpty():
        # Members without enough n-grams that another member has are linked with none of them; the
        # others sign once more among themselves.
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        packed = _with_texts(known, large.select("grp", "doc_id")).select("grp", "doc_id", "text").mapInArrow(_grams_of_groups(n, 4 * parts), _PACKED)
        few = parts // 4 + 1
        kept = packed.repartition(parts, "part").mapInArrow(_count_shared(few), _PACKED).repartition(few, "part").mapInArrow(_sum_counts, "doc_id long, kept long")
        left = stored(kept.join(large, "doc_id").filter(F.col("kept") * 100 >= F.col("least") * percent).select("doc_id"), "ngram-left")
        _, again = _groups(_with_texts(known, left), n, percent)
        again = again.withColumn("blocks", F.ceil(F.col("grams") / block_grams).cast("int"))
        heads = stored(heads.filter("blocks = 1").unionByName(again), "ngram-heads")
    turn = F.xxhash64(F.lit("block"), "doc_id")
    block = F.pmod(turn, F.col("blocks")).cast("int")
    large = heads.filter("blocks > 1")
    is_large = not large.isEmpty()
    first = heads.select("grp", "doc_id", block.alias("block"))
    if is_large:
        pivots = large.groupBy("grp", "blocks").agg(F.slice(F.sort_array(F.collect_list(F.when(F.pmod(turn, F.col("blocks") * 64) == 0, F.col("doc_id")))), 1, PIVOTS).alias("p"))
        pivots = pivots.select("grp", "blocks", F.explode("p").alias("doc_id"))
        pivots = pivots.select("grp", "doc_id", F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"))
        first = first.unionByName(pivots).distinct()
    first = stored(first.withColumn("chunk", F.lit(-1)), "ngram-blocks")
    links = _run_blocks(_with_texts(known, first), n, percent)

    if is_large:
        parted = components(links, "ngram-parts")
        state = large.join(parted.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))
        main = state.groupBy("grp", "root").agg(F.count("*").alias("m")).groupBy("grp").agg(F.max_by("root", F.struct("m", "root")).alias("main"))
        state = stored(state.join(main, "grp").select("grp", "doc_id", "blocks", (F.col("root") != F.col("main")).alias("rest")), "ngram-state")
        rest = state.filter("rest").withColumn("chunk", block)
        chunks = rest.select("grp", "chunk").distinct()
        # Every block once for each chunk of the rest, and each chunk with every block.
        sides = state.withColumn("block", block).join(chunks, "grp").select("grp", "doc_id", "block", "chunk").unionByName(
            rest.select("grp", "doc_id", F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"), "chunk"))
        sides = stored(sides.distinct(), "ngram-rest")
        links = links.unionByName(_run_blocks(_with_texts(known, sides), n, percent))

    final = components(links.unionByName(same.toDF("u", "v")), "ngram-final")
    final = stored(final, "ngram-components")
    out = sizes.select("doc_id", F.col("n").alias("n_shingles")).join(final.withColumnsRenamed({"node": "doc_id", "root": "r"}), "doc_id", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("r", "doc_id").alias("component_id"))
    unknown = docs.filter("doc_id is null").select("text")
    return out.unionByName(unknown.mapInArrow(_count_only(n), "doc_id long, n_shingles long, component_id long"))


def _count_only(n: int):
    def run(batches):
        for b in batches:
            count = [len(g) for *_, buf, offs in text_slices(b.column("text")) for g in shingle_sets(buf, offs, n)]
            none = pa.nulls(len(count), pa.int64())
            yield pa.RecordBatch.from_arrays([none, pa.array(count, pa.int64()), none], ["doc_id", "n_shingles", "component_id"])
    return run


def one_per_component(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """Rows of ``docs`` without near copies: of each component the document with the smallest id
    stays, of rows that repeat its id the one whose content hashes lowest. Rows without an id stay. All columns stay."""
    found = jaccard_components(docs, n, percent).filter("doc_id is not null")
    drop = stored(found.filter("doc_id <> component_id").select("doc_id").distinct(), "ngram-drop")
    kept = docs.join(_small(drop), "doc_id", "left_anti").select(*docs.columns)
    if docs.select("doc_id").filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").isEmpty():
        return kept
    row = F.struct(*docs.columns)
    one = kept.filter("doc_id is not null").groupBy("doc_id").agg(F.min_by(row, F.sha2(F.to_json(row), 256)).alias("row"))
    return one.select("row.*").unionByName(kept.filter("doc_id is null"))
