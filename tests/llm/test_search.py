"""URL filters, ranked search and phrases: against brute force, on skewed and odd rows, round trips."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from gridspark.llm import balltree, phrases, urls

DOCS = "doc_id long, text string, lang string, score int, n string"


# ---- URL filters

def judged(rules, url, default="allow"):
    known = {}
    for h, p, v in rules:
        if h:
            key = (h.lower(), p or "")
            known[key] = max(v, known.get(key, ""))
    host = path = ""
    if url and "://" in url:
        m = re.match(r"(?s)([^/?#]*)([^?#]*)", url.split("://", 1)[1])
        host, path = m[1].translate({c: c + 32 for c in range(65, 91)}), m[2]
    fit = [(len(h) + len(p), len(h), h + p, v) for (h, p), v in known.items() if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[2], best[3] if best else default


def check_urls(spark, rules, pages, default="allow"):
    frame = spark.createDataFrame([(i, u, 1, "x") for i, u in pages], "page_id long, url string, part int, key string")
    got = sorted(map(tuple, urls.judge(frame, urls.rule_table(spark, rules), default).collect()), key=repr)
    assert got == sorted([(i, *judged(rules, u, default)) for i, u in pages], key=repr)


@pytest.mark.parametrize("range_rows", [100, 10**6])
def test_urls_against_brute_force(spark, monkeypatch, range_rows):
    monkeypatch.setattr(urls, "RANGE_ROWS", range_rows)
    r = random.Random(3)
    host = lambda: ".".join(r.choice(["a", "b", "ab", "com", "x"]) for _ in range(r.randint(1, 4)))
    path = lambda: "".join(r.choice(["/", "a", "b", "é", "\n"]) for _ in range(r.randint(0, 5)))
    rules = [(host(), r.choice(["", "/"]) + path(), r.choice(["allow", "block"])) for _ in range(300)]
    pages = [(i, r.choice(["http://", "HTTPS://", "x"]) + host().upper() + "/" + path() + r.choice(["", "?q=://b.com/", "#f"])) for i in range(2000)]
    # A third of all rows is one url.
    check_urls(spark, rules, pages + [(i % 9, "http://a.com/a") for i in range(1000)])


def test_urls_odd_rows(spark):
    pages = [(None, None), (1, ""), (1, "a.com/"), (2, "http://"), (3, "http:///p"), (4, "http://a.com"), (5, "http://a.com?x"), (6, "http://a.com/"),
             (7, "http://A.COM:80/"), (8, "http://ba.com/"), (9, "http://b.a.com/é/" + "z" * 300_000), (None, "http://a.com/"), (10, "x://y://a.com/"), (11, "http://a..com/"), (12, "http://.com/")]
    rules = [("a.com", "/", "block"), ("A.com", "/", "allow"), ("com", "", "allow"), (None, "/", "block"), ("", "", "block"), ("b.a.com", "/é", "allow"), ("com", None, "allow")]
    check_urls(spark, rules, pages)
    check_urls(spark, rules, pages, "block")
    check_urls(spark, [], pages)
    check_urls(spark, rules, [])
    with pytest.raises(ValueError):
        urls.judge(spark.createDataFrame(pages, "page_id long, url string"), urls.rule_table(spark, rules), "maybe")
    with pytest.raises(Exception, match="allow or block"):
        urls.judge(spark.createDataFrame(pages, "page_id long, url string"), urls.rule_table(spark, [("a", "/", "no")])).collect()


# ---- ranked search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def ranked(docs, items, k):
    tf = [(d, Counter(terms(t))) for d, t in docs]
    tf = [(d, c, sum(c.values())) for d, c in tf if c]
    total, length = len(tf), sum(n for _, _, n in tf)
    df = Counter(t for _, c, _ in tf for t in c)
    w = {t: math.floor(1000 * math.log((2 * total + 2) / (2 * f + 1))) for t, f in df.items()}
    out = []
    for item, text in items:
        hits = []
        for d, c, n in tf:
            m = 10 + (90 * n * total) // length
            score = sum(w[t] * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if t in c)
            if score > 0:
                hits.append((-score, d is None, d or 0))
        out += [(item, i + 1, None if none else d, -s) for i, (s, none, d) in enumerate(sorted(hits)[:k])]
    return sorted(out, key=repr)


def corpus(seed=5, n=400):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(120)] + ["Äh", "ä", "42"]
    text = lambda: "".join(r.choice(words) + r.choice([" ", ", ", "\n", "-", "_"]) for _ in range(r.randint(1, 40)))
    docs = [(i, text()) for i in range(n)]
    docs += [(1000 + i, "w1 w2 w3 copy" + " w4" * (i % 2)) for i in range(n // 2)]
    return docs, [(i, text()) for i in range(30)] + [(90, "w1 w2 w3 copy"), (91, "unknown"), (92, ""), (93, None), (None, "w5")]


@pytest.mark.parametrize("pass_terms, block", [(200_000, 8_192), (40, 50)])
def test_search_against_brute_force(spark, monkeypatch, pass_terms, block):
    monkeypatch.setattr(balltree, "PASS_TERMS", pass_terms)
    monkeypatch.setattr(balltree, "BLOCK_DOCS", block)
    docs, items = corpus()
    docs += [(None, "w1 w2 w3 copy"), (None, "w9"), (7, "w9 w9"), (7, "w9 w9"), (2000, None), (2001, "... --"), (2002, "w7 " * 300_000)]
    frame = spark.createDataFrame([(d, t, "en", 1, "x") for d, t in docs], DOCS)
    got = balltree.rank(frame, spark.createDataFrame([(i, t, 5) for i, t in items], "item_id long, text string, rank int"), 10)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == ranked(docs, items, 10)


def test_search_of_nothing(spark):
    docs, items = spark.createDataFrame([(1, "a", "en", 1, "x")], DOCS), spark.createDataFrame([(1, "a")], "item_id int, text string")
    assert [tuple(r) for r in balltree.rank(docs, items.limit(0)).collect()] == []
    assert balltree.rank(docs.limit(0), items).collect() == []
    # A single document: its only term weighs floor(1000 * ln(4 / 3)).
    assert [tuple(r) for r in balltree.rank(docs, items).collect()] == [(1, 1, 1, 287 * (10**9 // 1800))]


def test_term_slices(monkeypatch):
    text = "Ab,é x1 " * 5000 + "long" * 3000
    monkeypatch.setattr(balltree, "TEXT_BYTES", 101)
    n, count = balltree.term_counts(text)
    assert n == len(terms(text)) and {k.decode(): v for k, v in count.items()} == dict(Counter(terms(text)))


def block(seed, docs=600, columns=80):
    r = np.random.default_rng(seed)
    rows = [np.sort(r.choice(columns, r.integers(1, 12), replace=False)) for _ in range(docs)]
    rows[docs // 2:] = [rows[0]] * (docs - docs // 2)
    indptr = np.concatenate(([0], np.cumsum([len(x) for x in rows])))
    return indptr, np.concatenate(rows), r.integers(1, 10**6, indptr[-1])


def test_balls_hold_their_members():
    indptr, cols, vals = block(1)
    tree = balltree.Tree(indptr, cols, vals, leaf=8)
    dense = np.zeros((len(indptr) - 1, len(tree.columns)), np.int64)
    for i in range(len(indptr) - 1):
        dense[i, np.searchsorted(tree.columns, cols[indptr[i]:indptr[i + 1]])] = vals[indptr[i]:indptr[i + 1]]
    query = np.random.default_rng(2).integers(0, 25_000, len(tree.columns))
    norm = balltree.root_up(np.array([(query * query).sum()]))[0]

    def members(node):
        if tree.leaves[node] is not None:
            a, z = tree.leaves[node]
            return list(tree.order[a:z])
        return [x for c in tree.children[node] for x in members(c)]

    assert sorted(members(0)) == list(range(len(indptr) - 1))
    for node, (centre, radius) in enumerate(zip(tree.centres, tree.radii)):
        rows = members(node)
        far = ((dense[rows] - centre) ** 2).sum(1).max()
        assert (radius - 1) ** 2 < far <= radius ** 2 or far == radius == 0
        assert (dense[rows] @ query <= centre @ query + norm * radius).all()


def test_bounds_leave_subtrees_out():
    """Clusters of near copies: the best hits lie in one, and the others are never scored."""
    r, rows = np.random.default_rng(4), []
    for c in range(40):
        rows += [np.arange(10 * c, 10 * c + 10)] * 100
    indptr = np.arange(0, 10 * len(rows) + 1, 10)
    cols, vals = np.concatenate(rows), r.integers(99_000, 100_000, 10 * len(rows))
    found = balltree.Searcher([(np.arange(10 * q, 10 * q + 10), np.full(10, 5_000)) for q in range(5)], 10)
    found.add(list(range(len(rows))), indptr, cols, vals)
    assert found.scored < 0.2 * 5 * len(rows)
    sums = vals.reshape(-1, 10).sum(1) * 5_000
    for q in range(5):
        want = sorted((-sums[i], i) for i in range(100 * q, 100 * q + 100))[:10]
        assert sorted((-s, d) for k, d, s in found.hits() if k == q) == want


# ---- phrases

def mined(docs, least, top, percent=100):
    f, n = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate({c: c + 32 for c in range(65, 91)})):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, 6):
                f[lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        cand = {g: a for g, a in c.items() if len(g) > 1 and a >= least}
        inside = defaultdict(int)
        for g, a in cand.items():
            for k in range(2, len(g)):
                for i in range(len(g) - k + 1):
                    inside[g[i:i + k]] = max(inside[g[i:i + k]], a)
        rows = []
        for g, a in cand.items():
            if 100 * inside[g] < percent * a:
                s, _, l, r = min((1000 * a * n[lang] // (c[g[:k]] * c[g[k:]]), k, c[g[:k]], c[g[k:]]) for k in range(1, len(g)))
                rows.append((-s, -a, " ".join(g).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def speech(seed=8):
    r = random.Random(seed)
    words = ["the", "The", "é", "x\x01y", "of", "end", "a-b", "\u2003"] + [f"v{i}" for i in range(30)]
    text = lambda: "".join(r.choice(words) + r.choice([" ", " ", "\t", ", ", "\n", "  "]) for _ in range(r.randint(0, 60)))
    docs = [(r.choice(["en", "en", "de", None, "und", ""]), text()) for _ in range(500)]
    # One passage and one word, over and over.
    docs += [("en", "one fixed passage of words, again. one fixed passage of")] * 300 + [("de", "the the the the the the the")] * 60
    return docs + [("en", None), (None, None), ("en", ""), ("fr", "..,;"), ("en", "the " * 400_000)]


@pytest.mark.parametrize("lookup, percent, top", [(10**6, 100, 2000), (5, 60, 7)])
def test_phrases_against_brute_force(spark, monkeypatch, lookup, percent, top):
    monkeypatch.setattr(phrases, "LOOKUP_WORDS", lookup)
    docs = speech()
    frame = spark.createDataFrame([(i, t, lang, 1, "x") for i, (lang, t) in enumerate(docs)], DOCS)
    got = phrases.collocations(frame, least=10, top=top, percent=percent)
    assert sorted(map(tuple, got.collect())) == mined(docs, 10, top, percent)


def test_phrases_take_texts_in_small_batches(spark):
    """Batches of texts are held in the executor and in Python, so their rows are bounded."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(name)
    spark.conf.set(name, "10000")
    try:
        phrases.collocations(spark.createDataFrame([(1, "a b", "en", 1, "x")], DOCS), least=1)
        assert int(spark.conf.get(name)) <= 1_000
    finally:
        spark.conf.set(name, old)


def test_phrases_of_nothing(spark):
    assert phrases.collocations(spark.createDataFrame([], DOCS)).collect() == []
    assert phrases.collocations(spark.createDataFrame([(1, None, None, 1, "x"), (2, "a b", "en", 1, "x")], DOCS)).collect() == []


def test_many_small_filters_and_slices(spark, monkeypatch):
    docs = speech(9)
    frame = spark.createDataFrame([(i, t, lang, 1, "x") for i, (lang, t) in enumerate(docs)], DOCS)
    for name, value in (("TASK_ENTRIES", 500), ("SHARD_ROWS", 3_000), ("TEXT_BYTES", 50)):
        monkeypatch.setattr(phrases, name, value)
    assert sorted(map(tuple, phrases.collocations(frame, least=10).collect())) == mined(docs, 10, 2000)


@pytest.mark.parametrize("n, bits", [(2, 7), (3, 21), (4, 16), (5, 13), (5, 25)])
def test_filters_give_back_what_they_count(n, bits):
    r = np.random.default_rng(n * bits)
    ids = r.integers(0, 1 << bits, (5_000, n)).astype(np.uint64)
    ids[2_000:3_000] = ids[0]
    want = Counter(map(tuple, ids.tolist()))
    filters = phrases.Filters(n, bits, 4)
    rows = list(filters.add("en", *phrases.pack(list(ids.T), bits))) + list(filters.flush())
    rows += list(filters.add("en", *phrases.pack(list(ids.T), bits))) + list(filters.flush())
    got = {}
    for shard in {s for _, s, _ in rows}:
        hi, lo, counts = filters.merge(shard, [d for _, s, d in rows if s == shard])
        got |= dict(zip(map(tuple, phrases.unpack(hi, lo, n, bits).tolist()), counts.tolist()))
    assert got == {k: 2 * c for k, c in want.items()}
    # Compact: little more than the bits that the quotient leaves over, and a byte for the count.
    assert sum(len(d) for _, _, d in rows) < 2 * len(want) * (-(-(n * bits) // 8) + 2)


def test_permutation_is_undone():
    for h in (7, 32, 33, 63):
        r = np.random.default_rng(h)
        hi, lo = phrases._whole(r.integers(0, 1 << h, 1000).astype(np.uint64), r.integers(0, 1 << h, 1000).astype(np.uint64), h)
        there = phrases.permute(hi, lo, h)
        back = phrases.permute(*there, h, back=True)
        assert (back[0] == hi).all() and (back[1] == lo).all() and not (there[1] == lo).all()
