from collections import defaultdict

import pytest

from gridspark.llm import mixing, queries, sharding
from tests.compare import compare, duck
from tests.conftest import SF


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_sql(spark, name):
    msg, _ = compare(queries.QUERIES[name](spark, SF), duck(SF), queries.ORACLES[name])
    assert msg is None, msg


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, key int, size string")


def water(sizes, epochs=3, weights=(5, 2, 1)):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        if not free:
            return fixed
        level = (total - sum(fixed.values())) / sum(w[s] for s in free)
        over = [s for s in free if level * w[s] > epochs * sizes[s]]
        if not over:
            return fixed | {s: level * w[s] for s in free}
        fixed |= {s: float(epochs * sizes[s]) for s in over}


def test_plan_against_rounds_of_resharing(spark, monkeypatch):
    rows = [(i, "w " * (i % 17 + 1), "abcdefg"[i % 7 if i % 3 else 0], 0, "z") for i in range(300)]
    rows += [(900 + i, " x\ty\x0bz ", None, 0, "z") for i in range(3)] + [(950, None, "empty", 0, "z"), (951, "", "empty", 0, "z"), (None, "a b", "b", 0, "z")]
    rows += [(7, "w w", "c", 0, "z")] * 3
    for bucket_rows in (2_000, 5):
        monkeypatch.setattr(mixing, "BUCKET_ROWS", bucket_rows)
        got = mixing.plan_mix(frame(spark, rows)).collect()
        assert len(got) == len(rows)
        sizes, taken = defaultdict(int), defaultdict(int)
        for r in got:
            sizes[r.source] += r.size
            taken[r.source] += r.taken
            assert 0 <= r.taken <= 3 * r.size
        want = water(sizes)
        for r in got:
            assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
        assert all(abs(taken[s] - want[s]) <= 0.5 for s in sizes)
        if bucket_rows == 2_000:
            first = sorted(map(str, got))
    assert sorted(map(str, got)) == first
    copies = mixing.mix_documents(frame(spark, rows))
    assert copies.columns == ["doc_id", "text", "source", "key", "size"]
    assert all(c <= 3 for c in copies.filter("doc_id > 7").groupBy("doc_id").count().toPandas()["count"])


def test_empty_and_one(spark):
    assert mixing.plan_mix(frame(spark, [])).collect() == []
    assert mixing.mix_documents(frame(spark, [])).collect() == []
    assert mixing.plan_mix(frame(spark, [(1, None, None, 0, "")])).first().taken == 0


def test_shards(spark):
    import zlib
    rows = [(i, "é" * (i * 37 % 91), "s", 0, "") for i in range(2_000)] + [(5_000 + i, "same text", "s", 0, "") for i in range(1_000)]
    rows += [(None, None, "s", 0, ""), (3, "x", "s", 0, ""), (3, "x", "s", 0, ""), (9_999, "long " * 2_000, None, 0, "")]
    got = sharding.shard_by_bytes(frame(spark, rows)).collect()
    assert sorted(str((r.doc_id, r.size, r.text_crc32)) for r in got) == sorted(
        str((d, len((t or "").encode()) + 16, None if t is None else zlib.crc32(t.encode()))) for d, t, *_ in rows)
    size, slots, total = defaultdict(int), defaultdict(list), sum(r.size for r in got)
    for r in got:
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 40
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    longest = max(r.size for r in got)
    assert all(abs(x - total / 40) <= longest for x in size.values())
    assert sharding.shard_by_bytes(frame(spark, [])).collect() == []
