"""Suffix-array dedup: deep-shallow sorting finds every 200-byte string that occurs twice.

Not all suffixes need sorting. Of the 32-byte pieces of a window of 200 bytes, the one with the
smallest hash is its anchor: windows with equal bytes have their anchors in the same place, so only
suffixes and (reversed) prefixes at anchors are compared, and only at anchors whose piece occurs
twice. At an anchor, a window that starts d bytes before it occurs twice where another anchor agrees
in the d bytes to its left and the 200 - d bytes to its right; both orders come from the sorter.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gridspark.functions.sizing import stored
from gridspark.llm.arrays import _BYTE, _INVERSE, mix, powers, prefix_hash, span_hash, text_slices

LENGTH = 200
PIECE = 32
#: Anchors that share a piece and are sorted in one task; beyond it their windows are compared one by one.
MAX_GROUP = 20_000
#: Contexts sorted at once.
CHUNK = 1 << 15
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)
_OTHER = mix(np.arange(1001, 1257, dtype=np.uint64)) | np.uint64(1)


# -- the sorter ------------------------------------------------------------------------------------

def blind_trie_order(items: list[int], strings: list[bytes], numbers: list[int], width: int) -> list[int]:
    """``items`` in the order of their strings, by insertion into a blind trie.

    A node is [depth, {byte: child}, any leaf]; a leaf is a list of equal items. A string goes down
    by the bytes at branching depths alone, is compared once with the leaf it meets, and branches
    off where the two differ."""
    root = None
    for i in items:
        if root is None:
            root = (width, None, [i])
            continue
        s, node = strings[i], root
        while node[1] is not None:
            node = node[1].get(s[node[0]]) or next(iter(node[1].values()))
        diff = numbers[i] ^ numbers[node[2][0]]
        if not diff:
            node[2].append(i)
            continue
        depth = width - (diff.bit_length() + 7) // 8
        other, parent, edge = node[2][0], None, None
        node = root
        while node[0] < depth:
            parent, edge = node, s[node[0]]
            node = node[1][edge]
        leaf = (width, None, [i])
        if node[1] is not None and node[0] == depth:
            node[1][s[depth]] = leaf
            continue
        branch = (depth, {strings[other][depth]: node, s[depth]: leaf}, None)
        if parent is None:
            root = branch
        else:
            parent[1][edge] = branch
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if node[1] is None:
            out.extend(node[2])
        else:
            stack.extend(child for _, child in sorted(node[1].items(), reverse=True))
    return out


def deep_shallow_order(rows: np.ndarray, shallow: int = 40, small: int = 48) -> np.ndarray:
    """Order of equally long byte strings: multikey quicksort, eight bytes a key, down to
    ``shallow`` bytes or ``small`` strings; blind tries order what agrees that far."""
    n, width = rows.shape
    order = np.arange(n)
    wide = -(-width // 8) * 8
    padded = np.zeros((n, wide), np.uint8)
    padded[:, :width] = rows
    keys = padded.view(">u8").astype(np.uint64)
    deep, stack = [], [(0, n, 0)]
    while stack:
        lo, hi, depth = stack.pop()
        if hi - lo < 2:
            continue
        if hi - lo <= small or depth * 8 >= min(shallow, width):
            deep.append((lo, hi))
            continue
        seg = order[lo:hi]
        key = keys[seg, depth]
        pivot = np.sort(key[[0, len(key) // 2, len(key) - 1]])[1]
        below, above = key < pivot, key > pivot
        a, z = int(below.sum()), int(above.sum())
        order[lo:hi] = np.concatenate([seg[below], seg[~(below | above)], seg[above]])
        stack += [(lo, lo + a, depth), (lo + a, hi - z, depth + 1), (hi - z, hi, depth)]
    if deep:
        flat = np.ascontiguousarray(rows).tobytes()
        strings = [flat[i:i + width] for i in range(0, n * width, width)]
        numbers = [int.from_bytes(s, "big") for s in strings]
        for lo, hi in deep:
            if hi - lo == 2:
                a, b = order[lo], order[lo + 1]
                if numbers[a] > numbers[b]:
                    order[lo], order[lo + 1] = b, a
            else:
                order[lo:hi] = blind_trie_order(order[lo:hi].tolist(), strings, numbers, width)
    return order


def common_prefix(rows: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each string and the one before it in the order; -1 for the first."""
    s = rows[order]
    differ = s[1:] != s[:-1]
    out = np.where(differ.any(1), differ.argmax(1), rows.shape[1]) if len(s) > 1 else np.zeros(0, np.int64)
    return np.concatenate(([-1], out))


def repeated_windows(group: np.ndarray, left: np.ndarray, right: np.ndarray, l_len: np.ndarray, r_len: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """dup[i, d]: the window that starts d bytes before anchor i occurs twice.

    ``left`` has the bytes before each anchor, nearest first, ``right`` those from it on, of which
    ``l_len`` and ``r_len`` are in the document; ``weight`` counts equal contexts. Both sides are
    put in order, the group's number first. At a depth, anchors with a common beginning are
    neighbours, so their class is a running count of the places where the common prefix is shorter.
    """
    n, most, length = len(group), left.shape[1], right.shape[1]
    head = np.ascontiguousarray(group.astype(">u8")).view(np.uint8).reshape(n, 8)
    classes = []
    for side in (right, left):
        s = np.concatenate([head, side], 1)
        order = deep_shallow_order(s)
        classes.append((order, common_prefix(s, order) - 8))
    dup = np.zeros((n, most + 1), bool)
    heavy = weight >= 2
    (r_order, r_lcp), (l_order, l_lcp) = classes
    r_class, l_class = np.empty(n, np.int64), np.empty(n, np.int64)
    for d in range(most + 1):
        here = np.flatnonzero((r_len >= length - d) & (l_len >= d))
        if not len(here):
            continue
        r_class[r_order] = np.cumsum(r_lcp < length - d)
        l_class[l_order] = np.cumsum(l_lcp < d)
        key = r_class[here] * (n + 1) + l_class[here]
        by = np.argsort(key, kind="stable")
        same = key[by][1:] == key[by][:-1]
        twice = np.zeros(len(here), bool)
        twice[1:] = same
        twice[:-1] |= same
        dup[here[by], d] = twice
        dup[here, d] |= heavy[here]
    return dup


def offsets_to_spans(dup: np.ndarray, length: int):
    """(row, start, end) relative to the anchor for each run of repeated window starts."""
    edge = np.zeros((len(dup), dup.shape[1] + 2), np.int8)
    edge[:, 1:-1] = dup
    step = np.diff(edge, axis=1)
    row, first = np.nonzero(step == 1)
    _, last = np.nonzero(step == -1)
    return row, -(last - 1), length - first


# -- anchors ---------------------------------------------------------------------------------------

def anchors(buf: np.ndarray, offs: np.ndarray, length: int, piece: int):
    """Positions and piece hashes of the anchors of all windows of the documents."""
    n = len(buf)
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    p = prefix_hash(buf)
    h = mix((p[piece:] - p[:-piece]) * powers(_INVERSE, n)[:n - piece + 1])
    bits = np.uint64(int(n).bit_length())
    # The rightmost of equal hashes wins, wherever the window lies.
    key = ((h >> bits) << bits) | (np.uint64((1 << int(bits)) - 1) - np.arange(len(h), dtype=np.uint64))
    span, w = 1, length - piece + 1
    while span * 2 <= w:
        key = np.minimum(key[:-span], key[span:])
        span *= 2
    if w > span:
        key = np.minimum(key[:len(key) - (w - span)], key[w - span:])
    start = np.ones(len(key), bool)  # windows inside one document
    for o in offs[1:-1]:
        start[max(0, o - length + 1):o] = False
    found = np.uint64((1 << int(bits)) - 1) - (key[start] & np.uint64((1 << int(bits)) - 1))
    flag = np.zeros(len(h), bool)
    flag[found.astype(np.int64)] = True
    at = np.flatnonzero(flag)
    return at, h[at]


_PACKED = "part int, kind int, " + ", ".join(f"{c} binary" for c in "abcdefg")


def _pack(kind: int, part: np.ndarray, columns) -> list[tuple]:
    order = np.argsort(part, kind="stable")
    out = []
    for at in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
        if len(at):
            out.append((int(part[at[0]]), kind, *[np.ascontiguousarray(c[at]).tobytes() for c in columns], *[b""] * (7 - len(columns))))
    return out


def _batch(rows: list[tuple]):
    kinds = (pa.int32(), pa.int32(), *[pa.binary()] * 7)
    columns = list(zip(*rows)) if rows else [()] * 9
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["part", "kind", *"abcdefg"])


def _held(batches):
    held: dict[tuple[int, int], list] = {}
    for b in batches:
        for part, kind, *cols in zip(*(b.column(c).to_pylist() for c in ("part", "kind", *"abcdefg"))):
            held.setdefault((part, kind), []).append(cols)
    for key in sorted(held):
        rows = held.pop(key)
        yield key, [b"".join(r[c] for r in rows) for c in range(7)]


def _find_anchors(length: int, piece: int, parts: int):
    """(k1, k2, text) to packed (hash, k1, k2, place); of equal texts two in a batch speak for all."""
    def run(batches):
        for b in batches:
            k1, k2 = b.column("k1").to_numpy(), b.column("k2").to_numpy()
            seen: dict[tuple, int] = {}
            cols: list[list] = [[], [], [], []]
            for lo, hi, buf, offs in text_slices(b.column("text")):
                at, h = anchors(buf, offs, length, piece)
                doc = np.searchsorted(offs, at, "right") - 1
                fresh = np.zeros(hi - lo, bool)
                for d in range(lo, hi):
                    n = seen[k1[d], k2[d]] = seen.get((k1[d], k2[d]), 0) + 1
                    fresh[d - lo] = n <= 2
                ok = fresh[doc]
                at, h, doc = at[ok], h[ok], doc[ok]
                for c, x in zip(cols, (h, k1[lo + doc], k2[lo + doc], (at - offs[doc]).astype(np.int64))):
                    c.append(x)
            if cols[0]:
                h, a, z, at = (np.concatenate(c) for c in cols)
                yield _batch(_pack(0, (mix(h) % np.uint64(parts)).astype(np.int64), (h, a, z, at)))
    return run


def _repeated(max_group: int):
    """Packed anchors to rows (k1, k2, places, hot): of each text those whose piece occurs twice."""
    def run(batches):
        for _, (h, k1, k2, at, *_) in _held(batches):
            h = np.frombuffer(h, np.uint64)
            k1, k2, at = (np.frombuffer(x, np.int64) for x in (k1, k2, at))
            order = np.argsort(h, kind="stable")
            head = np.flatnonzero(np.concatenate(([True], h[order][1:] != h[order][:-1]))) if len(h) else np.zeros(0, np.int64)
            count = np.diff(np.append(head, len(h)))
            count = np.repeat(count, count)
            keep = order[count >= 2]
            hot = (count > max_group)[count >= 2]
            by = np.lexsort((at[keep], k2[keep], k1[keep]))
            keep, hot = keep[by], hot[by]
            if not len(keep):
                continue
            a, z, p = k1[keep], k2[keep], at[keep]
            new = np.concatenate(([True], (a[1:] != a[:-1]) | (z[1:] != z[:-1]) | (p[1:] != p[:-1])))
            a, z, p, hot = a[new], z[new], p[new], hot[new]
            first = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (z[1:] != z[:-1]))))
            ends = np.append(first[1:], len(a))
            yield pa.RecordBatch.from_arrays([
                pa.array(a[first]), pa.array(z[first]),
                pa.array([p[s:e].astype(np.int64).tobytes() for s, e in zip(first, ends)], pa.binary()),
                pa.array([hot[s:e].astype(np.uint8).tobytes() for s, e in zip(first, ends)], pa.binary())], ["k1", "k2", "places", "hot"])
    return run


def _contexts(length: int, piece: int, parts: int, flush: int = 24 << 20):
    """(k1, k2, text, cand) to packed contexts (kind 0), members (1) and single windows (2)."""
    most = length - piece
    wide = most + length

    def run(batches):
        for b in batches:
            k1, k2, cand = b.column("k1").to_numpy(), b.column("k2").to_numpy(), b.column("cand").to_pylist()
            seen, out, held = set(), [], 0
            for lo, hi, buf, offs in text_slices(b.column("text")):
                at, doc, hot = [], [], []
                for d in range(lo, hi):
                    for c in cand[d] or ():
                        x = np.frombuffer(c["places"], np.int64)
                        at.append(x + offs[d - lo])
                        doc.append(np.full(len(x), d - lo))
                        hot.append(np.frombuffer(c["hot"], np.uint8))
                if not at:
                    continue
                at, doc, hot = np.concatenate(at), np.concatenate(doc), np.concatenate(hot) > 0
                fresh = np.zeros(hi - lo, bool)
                for d in range(lo, hi):
                    fresh[d - lo] = (k1[d], k2[d]) not in seen
                    seen.add((k1[d], k2[d]))
                p, p2 = prefix_hash(buf), prefix_hash(buf, _OTHER)
                hot_at, hot_doc = at[hot], doc[hot]
                at, doc = at[~hot], doc[~hot]
                left = np.minimum(most, at - offs[doc])
                right = np.minimum(length, offs[doc + 1] - at)
                fp = span_hash(p, at, at + piece)
                h = mix(span_hash(p2, at - left, at + right) + (left * 512 + right).astype(np.uint64))
                members = [(fp, h, k1[lo + doc], k2[lo + doc], at - offs[doc], fresh[doc])]
                by = np.lexsort((h, fp))
                new = np.concatenate(([True], (fp[by][1:] != fp[by][:-1]) | (h[by][1:] != h[by][:-1]))) if len(by) else np.zeros(0, bool)
                one = by[new]
                if len(one):
                    weight = np.diff(np.append(np.flatnonzero(new), len(by))).astype(np.int64)
                    space = np.zeros(len(buf) + 2 * wide, np.uint8)
                    space[wide:wide + len(buf)] = buf
                    ctx = space[(at[one] - most + wide)[:, None] + np.arange(wide)]
                    place = np.arange(-most, length)
                    ctx[(place < -left[one][:, None]) | (place >= right[one][:, None])] = 0
                    out += _pack(0, (mix(fp[one]) % np.uint64(parts)).astype(np.int64), (fp[one], h[one], weight, left[one], right[one], ctx))
                    held += ctx.size
                if len(hot_at):
                    start = np.unique((hot_at[:, None] - np.arange(most + 1)).ravel())
                    owner = np.searchsorted(offs, np.maximum(start, 0), "right") - 1
                    ok = (start >= 0) & (start + length <= offs[owner + 1])
                    start, owner = start[ok], owner[ok]
                    g1, g2 = span_hash(p, start, start + length), span_hash(p2, start, start + length)
                    members.append((g1, g2, k1[lo + owner], k2[lo + owner], start - offs[owner], fresh[owner]))
                    by = np.lexsort((g2, g1))
                    new = np.concatenate(([True], (g1[by][1:] != g1[by][:-1]) | (g2[by][1:] != g2[by][:-1]))) if len(by) else np.zeros(0, bool)
                    weight = np.diff(np.append(np.flatnonzero(new), len(by))).astype(np.int64)
                    one = by[new]
                    out += _pack(2, (mix(g1[one]) % np.uint64(parts)).astype(np.int64), (g1[one], g2[one], weight))
                for a, z, x, y, s, ok in members:
                    out += _pack(1, (mix(x[ok].view(np.uint64)) % np.uint64(parts)).astype(np.int64), (a[ok], z[ok], x[ok], y[ok], s[ok]))
                if held > flush:
                    yield _batch(out)
                    out, held = [], 0
            yield _batch(out)
    return run


_VERDICTS = "kind int, fp long, h long, k1 long, k2 long, lo long, hi long"


def _rows(kind, fp, h, k1=None, k2=None, lo=None, hi=None):
    n = len(fp)
    none = np.zeros(n, np.int64)
    cols = [np.full(n, kind, np.int32), fp.view(np.int64), h.view(np.int64)] + [none if c is None else c for c in (k1, k2, lo, hi)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["kind", "fp", "h", "k1", "k2", "lo", "hi"])


def _judge(length: int, piece: int, chunk: int):
    """Packed contexts to rows: kind 0 (fp, h, lo, hi) repeated stretches around an anchor with this
    context, kind 1 (fp, h, k1, k2, lo) where the context lies."""
    most = length - piece
    wide = most + length

    def merged(fp, h, weight):
        by = np.lexsort((h, fp))
        new = np.concatenate(([True], (fp[by][1:] != fp[by][:-1]) | (h[by][1:] != h[by][:-1])))
        return by[new], np.add.reduceat(weight[by], np.flatnonzero(new))

    def run(batches):
        for (_, kind), cols in _held(batches):
            if not cols[0]:
                continue
            fp, h = np.frombuffer(cols[0], np.uint64), np.frombuffer(cols[1], np.uint64)
            if kind == 1:
                k1, k2, at = (np.frombuffer(c, np.int64) for c in cols[2:5])
                for a in range(0, len(fp), 1 << 16):
                    z = a + (1 << 16)
                    yield _rows(1, fp[a:z], h[a:z], k1[a:z], k2[a:z], at[a:z])
                continue
            one, weight = merged(fp, h, np.frombuffer(cols[2], np.int64))
            if kind == 2:
                one = one[weight >= 2]
                yield _rows(0, fp[one], h[one], lo=np.zeros(len(one), np.int64), hi=np.full(len(one), length))
                continue
            left, right = (np.frombuffer(c, np.int64) for c in cols[3:5])
            ctx = np.frombuffer(cols[5], np.uint8).reshape(-1, wide)
            # one is in the order of fp: whole groups go together
            heads = np.flatnonzero(np.concatenate(([True], fp[one][1:] != fp[one][:-1], [True])))
            a = 0
            while a < len(one):
                z = int(heads[min(np.searchsorted(heads, a + chunk, "right"), len(heads) - 1)])
                at, w = one[a:z], weight[a:z]
                a = z
                dup = repeated_windows(fp[at], ctx[at][:, :most][:, ::-1], ctx[at][:, most:], left[at], right[at], w)
                row, lo, hi = offsets_to_spans(dup, length)
                yield _rows(0, fp[at[row]], h[at[row]], lo=lo.astype(np.int64), hi=hi.astype(np.int64))
    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, piece: int = PIECE, max_group: int = MAX_GROUP, chunk: int = CHUNK, with_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for each row of ``docs`` (doc_id, text).

    Texts are UTF-8 bytes, null counts as empty. Every byte is removed that lies in a string of
    ``length`` bytes which starts anywhere else too, in the same document (also overlapping) or in
    another row; strings do not cross documents and are judged on the input. ``n_spans`` counts
    maximal removed runs. Rows are told apart by their text alone (128-bit hash): equal texts, with
    or without equal ids, are occurrences of each other. Texts shorter than ``length`` keep all.
    No rows give no rows. With ``with_text`` the kept bytes (``kept``, binary) and the removed spans
    (``spans``) come too.

    Anchors of a piece that occurs more than ``max_group`` times go another exact way: each of their
    windows is counted by its 128-bit hash, with sums before and after the shuffle.
    """
    spark = docs.sparkSession
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    k1, k2 = F.xxhash64("text").alias("k1"), F.xxhash64(F.lit("again"), "text").alias("k2")
    texts = docs.filter(F.octet_length("text") >= length).select(k1, k2, "text")
    found = texts.mapInArrow(_find_anchors(length, piece, parts), _PACKED).repartition(parts // 4, "part")
    found = found.mapInArrow(_repeated(max_group), "k1 long, k2 long, places binary, hot binary")
    cand = stored(found.groupBy("k1", "k2").agg(F.collect_list(F.struct("places", "hot")).alias("cand")), "suffix-anchors")  # of one text
    rows = texts.join(cand, ["k1", "k2"]).mapInArrow(_contexts(length, piece, parts), _PACKED).repartition(parts // 4, "part")
    rows = stored(rows.mapInArrow(_judge(length, piece, chunk), _VERDICTS), "suffix-verdicts")
    verdicts = rows.filter("kind = 0").select("fp", "h", "lo", "hi")
    members = rows.filter("kind = 1").select("fp", "h", "k1", "k2", F.col("lo").alias("at"))
    spans = members.join(verdicts, ["fp", "h"]).select("k1", "k2", F.struct((F.col("at") + F.col("lo")).cast("int").alias("lo"), (F.col("at") + F.col("hi")).cast("int").alias("hi")).alias("s"))
    spans = stored(spans.groupBy("k1", "k2").agg(F.collect_set("s").alias("spans")), "suffix-spans")  # of one text
    rows = docs.select("doc_id", "text", k1, k2).join(spans, ["k1", "k2"], "left").select("doc_id", "text", "spans")

    def cut(batches):
        for b in batches:
            ids, spans = b.column("doc_id"), b.column("spans").to_pylist()
            n, removed, count, digest, kept, gone = [], [], [], [], [], []
            for lo, hi, buf, offs in text_slices(b.column("text")):
                for d in range(lo, hi):
                    t = buf[offs[d - lo]:offs[d - lo + 1]]
                    runs = []
                    for s in sorted((s["lo"], s["hi"]) for s in spans[d] or ()):
                        if runs and s[0] <= runs[-1][1]:
                            runs[-1][1] = max(runs[-1][1], s[1])
                        else:
                            runs.append([*s])
                    left, at = [], 0
                    for a, z in runs:
                        left.append(t[at:a].tobytes())
                        at = z
                    left = b"".join([*left, t[at:].tobytes()])
                    n.append(len(t))
                    removed.append(len(t) - len(left))
                    count.append(len(runs))
                    digest.append(hashlib.sha256(left).hexdigest())
                    if with_text:
                        kept.append(left)
                        gone.append([{"start": a, "end": z} for a, z in runs])
            cols = [ids, pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(digest, pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_text:
                cols += [pa.array(kept, pa.binary()), pa.array(gone, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]
                names += ["kept", "spans"]
            yield pa.RecordBatch.from_arrays(cols, names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    more = ", kept binary, spans array<struct<start:int,end:int>>" if with_text else ""
    return rows.mapInArrow(cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string{more}")
