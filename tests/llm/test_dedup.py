import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark.functions import sizing
from gridspark.llm import graph, ngram_join, suffix
from tests.llm import brute

SCHEMA = "doc_id long, text string, block int, grp string"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, 1, "x") for d, t in rows], SCHEMA)


def corpus(seed=3):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = " ".join(r.choice(words) for _ in range(60))
    rows = []
    for d in range(60):
        text = " ".join(r.choice(words) for _ in range(r.randrange(0, 200)))
        rows.append((d, text + (" " + passage if d % 3 == 0 else "")))
    for d in range(60, 120):  # near copies of one text, near copies of near copies
        w = rows[d % 2 + 3][1].split() if d < 90 else rows[d - 30][1].split()
        for _ in range(r.randrange(0, 3)):
            if w:
                w[r.randrange(len(w))] = r.choice(words)
        rows.append((d, " ".join(w)))
    rows += [(120, None), (121, ""), (122, " \t\n"), (123, "One two"), (124, "one TWO"), (125, "a"), (126, "long " * 30_000), (127, "ééé ß " * 50)]
    return rows


@pytest.mark.parametrize("n,percent,block", [(3, 90, 10 ** 6), (5, 80, 10 ** 6), (3, 80, 300), (2, 50, 500)])
def test_components(spark, n, percent, block):
    rows = corpus()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(frame(spark, rows), n, percent, block).collect()}
    assert got == brute.components(rows, n, percent)


@pytest.mark.parametrize("hub_rows,finish", [(2, 0), (1000, 0), (2, 53), (1000, 250_000)])
def test_components_of_hubs(spark, monkeypatch, hub_rows, finish):
    """Stars, a path of hubs, repeated, null and looped edges, with and without nodes that count as
    hubs; by rounds alone, finished by a task after a round and from the start."""
    monkeypatch.setattr(graph, "HUB_ROWS", hub_rows)
    monkeypatch.setattr(graph, "FINISH_EDGES", finish)
    edges = [(100 + i, 100) for i in range(40)] + [(300 + i, 300) for i in range(9)] + [(105, 304), (7, 139), (500, 501), (501, 502), (100, 101), (900, 900), (None, 3)]
    got = dict(map(tuple, graph.components(spark.createDataFrame(edges, "u long, v long")).collect()))
    large = {*range(100, 140), *range(300, 309), 7}
    assert got == {**{x: 7 for x in large}, 500: 500, 501: 500, 502: 500}


def test_components_edges(spark):
    assert ngram_join.jaccard_components(frame(spark, [])).collect() == []
    rows = [(None, "a b c d"), (None, None), (5, "a b c d"), (4, "a b c d"), (4, "a b c d"), (4, "q r s t u"), (9, "q r s t u"), (7, None), (7, "")]
    got = sorted(map(tuple, ngram_join.jaccard_components(frame(spark, rows)).collect()), key=str)
    assert got == sorted([(None, 2, None), (None, 0, None), (5, 2, 4), (4, 2, 4), (4, 2, 4), (4, 3, 4), (9, 3, 4), (7, 0, 7), (7, 0, 7)], key=str)
    kept = ngram_join.one_per_component(frame(spark, rows), 3, 90)
    assert kept.columns == ["doc_id", "text", "block", "grp"]
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([None, None, 4, 7], key=str)


def test_join_sets_links_are_exact():
    r = np.random.default_rng(1)
    base = r.integers(0, 1 << 60, 300).astype(np.uint64)
    sets = [np.unique(np.concatenate([r.permutation(base)[:int(r.integers(200, 300))], r.integers(0, 1 << 60, int(r.integers(0, 40))).astype(np.uint64)])) for _ in range(80)]
    for percent in (70, 80, 90):
        links = ngram_join.join_sets(np.arange(80), sets, percent)
        for a, b in links:
            both = len(np.intersect1d(sets[a], sets[b]))
            assert 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both)
        root = list(range(80))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a in range(80):
            for b in range(a):
                both = len(np.intersect1d(sets[a], sets[b]))
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    root[find(a)] = find(b)
        assert len({find(x) for x in range(80)}) == 80 - len(links)


def test_deep_shallow_order():
    r = random.Random(5)
    strings = [bytes(r.choice(b"ab") for _ in range(60)) for _ in range(300)] + [b"a" * 60] * 5
    strings += [b"a" * r.randrange(60) + b"b" for _ in range(200)]
    rows = np.array([list(s.ljust(60, b"\0")) for s in strings], np.uint8)
    for shallow, small in ((40, 48), (8, 2), (16, 3), (60, 1000)):
        order = suffix.deep_shallow_order(rows, shallow, small)
        assert [rows[i].tobytes() for i in order] == sorted(x.tobytes() for x in rows)
        lcp = suffix.common_prefix(rows, order)
        for k in range(1, len(order)):
            a, b = rows[order[k - 1]], rows[order[k]]
            assert lcp[k] == next((i for i in range(60) if a[i] != b[i]), 60)


@pytest.mark.parametrize("max_group,chunk", [(20_000, 1 << 15), (2, 50)])
def test_repeats(spark, max_group, chunk):
    r = random.Random(8)
    rnd = lambda n, a="abcdefgh ": "".join(r.choice(a) for _ in range(n))
    p = rnd(260)
    rows = [(1, rnd(500) + p + rnd(300)), (2, p), (3, p[:199]), (4, p[30:230]), (5, rnd(50) + p[:220]), (6, p[40:] + p[40:]), (7, None), (8, ""),
            (9, "a" * 201), (10, "ab" * 400), (11, rnd(900)), (11, rnd(900)), (None, p + "é" * 120), (12, "é" * 120), (13, rnd(400, "xy")), (13, "same " * 39 + "x" * 5)]
    rows += [(20, rnd(199)), (21, rnd(200))]
    rows += [(22, rows[-1][1])] + [(30 + i, rnd(30) + p[i:i + 215] + rnd(30)) for i in range(20)]
    got = sorted(map(tuple, suffix.remove_repeats(frame(spark, rows), max_group=max_group, chunk=chunk).collect()), key=str)
    want = [(d, *x) for (d, _), x in zip(rows, brute.repeats([t for _, t in rows], 200))]
    assert got == sorted(want, key=str)
    assert suffix.remove_repeats(frame(spark, [])).collect() == []
    full = suffix.remove_repeats(frame(spark, rows), with_text=True).filter("doc_id = 1").first()
    assert full.n_bytes - len(full.kept) == full.n_removed and len(full.spans) == full.n_spans


def test_spans_of_a_text_do_not_repeat(spark, monkeypatch):
    kept, tables = suffix.stored, {}

    def stored(df, name):
        tables[name] = kept(df, name)
        return tables[name]

    monkeypatch.setattr(suffix, "stored", stored)
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(i, text) for i in range(64)] + [(100, "other " + text)]
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        got = suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert len(got) == 65 and all(r.n_removed >= len(text) for r in got)
    spans = [r.spans for r in tables["suffix-spans"].collect()]
    assert spans and all(len(s) == len(set(s)) for s in spans)


def test_stored_leaves_no_shuffle_files(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        found = disk.getAllFiles()
        return {x for x in (found.apply(i).getName() for i in range(found.size())) if x.startswith("shuffle_")}

    before = files()
    summary = sizing.stored(spark.range(1000).groupBy(F.col("id") % 7).count(), "summary")
    for _ in range(50):  # they go in the background
        if not files() - before:
            break
        time.sleep(0.2)
    assert not files() - before
    assert summary.count() == 7


@pytest.mark.parametrize("small", [False, True])
def test_common_passages_join_no_groups(spark, monkeypatch, small):
    """Texts that share a passage but too little else are in no group; near copies among them are.
    With small limits signatures are counted in rounds and a bit map holds back other texts."""
    if small:
        monkeypatch.setattr(ngram_join, "COUNT_SIGNATURES", 5_000)
        monkeypatch.setattr(ngram_join, "MAX_BROADCAST_ROWS", 3)
        monkeypatch.setattr(ngram_join, "ID_BITS", 128)
    r = random.Random(4)
    passage = " ".join(f"b{i}" for i in range(40))
    rows = [(d, passage + " " + " ".join(f"w{r.randrange(5000)}" for _ in range(300))) for d in range(100)]
    rows += [(1000 + d, t.replace("b7 ", "z ")) for d, t in rows[:6]] + [(2000 + d, t) for d, t in rows[3:8]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    groups = {}
    for grp, doc_id in ngram_join._groups(docs, 5, 80)[1].select("grp", "doc_id").collect():
        groups.setdefault(grp, set()).add(doc_id)
    assert sorted(map(sorted, groups.values())) == [[d, 1000 + d] for d in range(6)]
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_join.jaccard_components(docs, 5, 80, 2_000).collect()}
    assert got == brute.components(rows, 5, 80)
