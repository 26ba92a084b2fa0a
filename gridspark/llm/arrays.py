"""Texts of an Arrow batch as byte arrays: words and shingles without a Python loop over them.

All hashes are 64 bits wide and a function of the bytes alone, so tasks agree on them.
"""

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
#: Bytes that separate words: \x20 and \x09-\x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEPS = tuple(_U(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3,
                               0x589965CC75374CC3, 0x1D8E4E27C47D124F))


#: Rows of a batch of texts on its way to Python and back; a batch is held on both sides.
BATCH_ROWS = 1_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(df):
    """``df``, after its session was told to send no more than BATCH_ROWS rows at a time."""
    conf = df.sparkSession.conf
    now = int(conf.get(_BATCH, "10000"))
    if now <= 0 or now > BATCH_ROWS:
        conf.set(_BATCH, str(BATCH_ROWS))
    return df


def mix(x):
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x = x ^ (x >> _U(29))
    x = x * _U(0xE7037ED1A0B428DB)
    return x ^ (x >> _U(32))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64)) | _U(1)
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** i modulo 2 ** 64 for i below n; kept between calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        a = np.full(max(n, 2 * SLICE_BYTES), base, np.uint64)
        a[0] = 1
        have = _powers[base] = np.multiply.accumulate(a)
    return have[:n]


def text_slices(column: pa.Array, limit: int = SLICE_BYTES):
    """Yield (first row, end row, bytes, offsets) with about ``limit`` bytes at a time; one
    text is never cut. Null counts as empty."""
    column = column.fill_null("").cast(pa.large_string())
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    a, n = 0, len(column)
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + limit, "right")) - 1)
        yield a, b, data[offs[a]:offs[b]], offs[a:b + 1] - offs[a]
        a = b


def prefix_hash(buf: np.ndarray, table: np.ndarray = _BYTE) -> np.ndarray:
    """Sums of byte values times powers; the hash of [s, e) is (p[e] - p[s]) times the inverse power of s."""
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(table[buf] * powers(_BASE, len(buf)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix((prefix[ends] - prefix[starts]) * powers(_INVERSE, len(prefix))[starts] + (ends - starts).astype(np.uint64))


def words(buf: np.ndarray, offs: np.ndarray):
    """Starts, ends and document of each word; words do not cross documents."""
    ink = ~SPACE[buf]
    first, last = ink.copy(), ink.copy()
    first[1:] &= ~ink[:-1]
    last[:-1] &= ~ink[1:]
    full = offs[1:] > offs[:-1]
    a, z = offs[:-1][full], offs[1:][full] - 1
    first[a] = ink[a]
    last[z] = ink[z]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def shingle_sets(buf: np.ndarray, offs: np.ndarray, n: int) -> list[np.ndarray]:
    """Per document the ascending distinct hashes of its ``n``-word shingles, A-Z lower-cased;
    of its whole word sequence where it has fewer words; empty without words."""
    starts, ends, doc = words(buf, offs)
    count = np.bincount(doc, minlength=len(offs) - 1)
    if len(starts):
        h = span_hash(prefix_hash(buf, _LOWER), starts, ends)
        m = len(h) - n + 1
        if m > 0:
            grams = np.zeros(m, np.uint64)
            for j in range(n):
                grams += mix(h[j:j + m] + _STEPS[j]) * _STEPS[j]
            grams = mix(grams)
        else:
            grams = np.zeros(0, np.uint64)
    at = np.concatenate(([0], np.cumsum(count)))
    out = []
    for d, c in enumerate(count):
        if c >= n:
            g = np.sort(grams[at[d]:at[d] + c - n + 1])
            out.append(g[np.concatenate(([True], g[1:] != g[:-1]))])
        elif c:
            whole = _U(c)
            with np.errstate(over="ignore"):
                for j in range(c):
                    whole = mix(whole + h[at[d] + j] * _STEPS[j % len(_STEPS)])
            out.append(np.array([whole], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
