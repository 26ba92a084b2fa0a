import itertools
import math
import random
import re
import textwrap

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark.llm import ann, chat, decontam, langid, licenses, queries, toxicity
from tests.conftest import SF
from tests.llm import brute


def segmentations(word, prob):
    return sum(math.prod(prob[p] for p in pieces) for cut in itertools.product((0, 1), repeat=len(word) - 1)
               for pieces in [_pieces(word, cut)] if all(p in prob for p in pieces))


def _pieces(word, cut):
    out = [word[0]]
    for x, c in zip(word[1:], cut):
        if c:
            out.append(x)
        else:
            out[-1] += x
    return out


def test_forward_sums_all_segmentations():
    pieces = ["▁", "▁a", "a", "b", "ab", "ba", "bab", "▁ab"]
    index = {p: i for i, p in enumerate(pieces)}
    prob = np.random.default_rng(1).uniform(0.01, 0.2, (len(pieces) + 2, 1))
    prob[-1] = 0
    words = ["▁abab", "▁b", "▁ababab", "▁bbab", "▁axa"]
    p = {x: prob[i, 0] for x, i in index.items()} | {"x": prob[-2, 0]}
    want = [math.log(segmentations(w, p)) for w in words]
    assert np.allclose(langid.word_scores(words, index, prob)[:, 0], want)


def test_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    got = [r for r in queries.op2_language_id(spark, SF).collect() if r.held_out]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in got]) > 0.95
    model = langid.train(docs.select(F.col("doc_id").alias("key"), "text", "lang"), rounds=1)
    odd = spark.createDataFrame([(1, None, "x", 0.5), (2, "", "x", 0.5), (3, "12 !?", "x", 0.5), (4, "the of " * 60_000, "x", 0.5), (4, "the", "x", 0.5)],
                                "doc_id long, text string, lang_pred string, score double")
    found = sorted(map(tuple, langid.predict(odd, model).collect()))
    assert [f[:2] for f in found[:3]] == [(1, "und"), (2, "und"), (3, "und")] and {f[1] for f in found[3:]} == {"en"}
    assert all(0 <= f[2] <= 1 for f in found)
    none = langid.train(docs.filter("false").select(F.col("doc_id").alias("key"), "text", "lang"))
    assert {r.lang_pred for r in langid.predict(odd, none).collect()} == {"und"}
    assert langid.predict(odd.filter("false"), model).collect() == []


def test_language_sample_keeps_rare(spark):
    rows = [(i, f"the house of the man and the dog {i}", "en") for i in range(4_000)] + [(5_000 + i, "saluton mia bona amiko kaj lia granda hundo", "eo") for i in range(3)]
    docs = spark.createDataFrame(rows, "key long, text string, lang string")
    langs, index, prob = langid.train(docs, rounds=1, sample_rows=200)
    flat = 1 / (len(index) + 1)
    assert langs == ["en", "eo"] and (prob.max(0) > 100 * flat).all()
    # Of the frequent language a sample is left: its words count less than in all rows.
    seen = []
    keep = langid.stored
    langid.stored = lambda df, name: seen.append(keep(df, name)) or seen[-1]
    try:
        langid.train(docs, rounds=0, sample_rows=200)
    finally:
        langid.stored = keep
    n = {r.lang: r.n for r in seen[0].filter(F.col("word").isin("▁dog", "▁hundo")).collect()}
    assert n[1] == 3 and 120 <= n[0] <= 280


def test_toxicity(spark):
    rows = [(i, ("nasty rude " if i % 5 == 0 else "") + " ".join(f"w{(i * j) % 97}x" for j in range(1, 40))) for i in range(600)]
    docs = spark.createDataFrame([(d, t, 9.0) for d, t in rows] + [(None, "nasty", 1.0), (1000, None, 1.0), (1001, "", 1.0), (1002, "fine " * 50_000, 1.0)],
                                 "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(0, 300)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit_documents(docs, labels, F.lit(False))
    got = {r.doc_id: r.predicted for r in toxicity.score(docs, model).collect()}
    assert all(got[i] == int(i % 5 == 0) for i in range(600)) and got[1000] == got[1001] == got[1002] == 0
    assert toxicity.score(docs, model).columns == ["doc_id", "text", "score", "predicted"]
    nothing = toxicity.fit_documents(docs, labels.filter("false"), F.lit(False))
    assert toxicity.score(docs, nothing).filter("predicted = 1").isEmpty()
    assert toxicity.score(docs.filter("false"), model).collect() == []


def _risk_parts(x_p, x_u, prior, w, b):
    """(prior * E_p[loss(+)], bracket), written out."""
    loss = lambda f, y: 1 / (1 + math.exp(y * f))
    f = lambda s: sum(w[x] for x in s) + b
    mean = lambda xs: sum(xs) / len(xs)
    return prior * mean([loss(f(s), 1) for s in x_p]), mean([loss(f(s), -1) for s in x_u]) - prior * mean([loss(f(s), -1) for s in x_p])


@pytest.mark.parametrize("prior,negative", [(0.2, False), (0.9, True)])
def test_nnpu_slope(prior, negative):
    """The step against the numeric derivative of the written risk, on both sides of the bracket."""
    x_p, x_u = [[0, 1], [0], [0, 2], [1, 2]], [[2], [], [1], [0, 2], [2], [2, 1]]
    flat = lambda sets: (np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.array([x for s in sets for x in s]), len(sets))
    w, b = np.array([0.7, -0.2, 0.4]), -0.3
    bracket, g = toxicity.nnpu_slope(flat(x_p), flat(x_u), w, b, prior)
    confirmed, want = _risk_parts(x_p, x_u, prior, w, b)
    assert abs(bracket - want) < 1e-12 and (bracket < 0) == negative
    risk = lambda v: (lambda a, c: -c if negative else a + c)(*_risk_parts(x_p, x_u, prior, v[:3], v[3]))
    v, h = np.append(w, b), 1e-6
    assert np.allclose(g, [(risk(v + h * e) - risk(v - h * e)) / (2 * h) for e in np.eye(4)], atol=1e-8)


def test_nnpu_training_decides(monkeypatch):
    """Without a step nothing is found; with them positives among the unlabelled and new ones are. The
    bracket turns negative in some steps: without its floor the confirmed texts alone are learnt."""
    r = random.Random(1)
    # A positive has some of the features 0 to 5, another text of 6 to 11; those from 100 on tell nothing.
    one = lambda positive: sorted({*(r.choices(range(6), k=3) if positive else r.choices(range(6, 12), k=3)), *r.choices(range(100, 400), k=2)})
    x_p, hidden, clean, new = ([one(x < 180) for x in range(a, b)] for a, b in ((0, 60), (60, 120), (180, 720), (120, 180)))
    hits = lambda sets, w, b: sum(sum(w.get(x, 0.0) for x in s) + b >= 0 for s in sets)
    w, b = toxicity.nnpu_fit(x_p, hidden + clean, 0.1, rounds=0)
    assert not any(w.values()) and abs(b - math.log(0.1 / 0.9)) < 1e-12 and hits(x_p + hidden, w, b) == 0
    seen, slope = [], toxicity.nnpu_slope
    monkeypatch.setattr(toxicity, "nnpu_slope", lambda *a: (lambda out: seen.append(out[0]) or out)(slope(*a)))
    w, b = toxicity.nnpu_fit(x_p, hidden + clean, 0.1, rounds=400)
    assert hits(hidden, w, b) >= 55 and hits(new, w, b) >= 55 and hits(clean, w, b) == 0
    assert -0.01 < min(seen) < 0 and sum(x < 0 for x in seen) > 20
    seen.clear()
    monkeypatch.setattr(toxicity, "nnpu_slope", lambda *a: (lambda out: seen.append(out[0]) or out)(slope(*a, non_negative=False)))
    w, b = toxicity.nnpu_fit(x_p, hidden + clean, 0.1, rounds=400)
    assert min(seen) < -0.03 and hits(x_p, w, b) >= 55 and hits(hidden, w, b) <= 30 and hits(new, w, b) <= 40


def legal(roles):
    before = None
    for r in roles:
        if r not in chat.NEXT[before]:
            return False
        before = r
    return not roles or roles[-1] in chat.FINAL


def best_cost(roles):
    """Least cost over all ways, turn by turn, by search over every choice."""
    if not roles:
        return 0.0
    costs = {chat.START: 0.0}
    for role in roles:
        after = {}
        for s, r, c, _, _ in chat.steps(role if role in chat.ROLES else None):
            if s in costs:
                after[r] = min(after.get(r, math.inf), costs[s] + c)
        costs = after
    return min(c for s, c in costs.items() if chat.ROLES[s] in chat.FINAL)


@pytest.mark.parametrize("parts", ["1", "7"])
def test_chat(spark, parts):
    kinds = ["system", "user", "assistant", None, "tool"]
    rows, k = [], 0
    for n in range(1, 5):
        for combo in itertools.islice(itertools.product(kinds, repeat=n), 0, None, 1 if n < 4 else 5):
            rows += [(k, t, r, f"t{t}") for t, r in enumerate(combo)]
            k += 1
    rows += [(10_000, t, kinds[t * t % 5], None if t % 3 else "x") for t in range(3_000)] + [(None, None, "user", "a"), (None, 1, "user", "")]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = chat.repair(spark.createDataFrame([(*r, "y") for r in rows], "conv_id long, turn long, role string, text string, part string")).collect()
        assert chat.repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert len(got) == len(rows)
    by = {}
    for r in sorted(got, key=lambda r: (str(r.conv_id), -1 if r.turn is None else r.turn)):
        by.setdefault(r.conv_id, []).append(r)
    for turns in by.values():
        rendered = "".join(t.piece for t in turns)
        roles = [p.split("\n")[0] for p in rendered.split("<|im_start|>")[1:]]
        assert legal(roles), roles
        assert rendered.endswith(chat.CLOSE) and rendered.count("<|im_start|>") == rendered.count("<|im_end|>")
        cost = 0.0
        for t in turns:
            own = t.role if t.role in chat.ROLES else None
            c = chat.COSTS
            cost += (c["merge"] if own in (None, t.role_out) else c["merge_other"]) if t.op == "merge" else 0 if t.op == "keep" else c["name" if own is None else "relabel"]
            cost += c["insert"] if t.inserted else 0
        assert abs(cost - best_cost([t.role for t in turns])) < 1e-9


def test_licenses(spark):
    rows = [(1, "a b\nReleased under the MIT License.\nc d"), (2, None), (3, ""), (4, "Licensed under CC BY-NC 4.0."), (4, "Licensed under CC BY-NC 4.0."),
            (5, "no such thing"), (6, "x\n" * 50_000 + "Licensed under the Apache License, Version 2.0."), (7, "This is my license to drive a car."),
            (8, "This work is licensed under the GNU General Public License, version 3."), (9, "This work is now licensed under the GNU General Public License, version 3.")]
    df = spark.createDataFrame([(d, t, "z") for d, t in rows], "doc_id long, text string, line string")
    got = sorted((r.doc_id, r.license, r.line, r.reduction > 0, r.differences) for r in licenses.scan_licenses(df).collect())
    assert got == [(1, "MIT", 1, True, ""), (4, "CC-BY-NC-4.0", 0, True, ""), (4, "CC-BY-NC-4.0", 0, True, ""), (6, "Apache-2.0", 50_000, True, ""),
                   (8, "GPL-3.0", 0, True, ""), (9, "GPL-3.0", 0, True, " -> now")]
    assert licenses.scan_licenses(df.filter("false")).collect() == []


def test_licenses_wrapped(spark):
    want, rows = {}, []
    for name, texts in licenses.TEMPLATES.items():
        for t in texts:
            for width in (60, 70, 80):
                lines = textwrap.wrap(t, width)
                want[len(rows)] = (name, t, 3, 1.0)
                rows.append((len(rows), "first words\nand more\n\n" + "\n".join(("# " if width == 70 else "") + x for x in lines) + "\n\nthe text goes on"))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.license, r.template, r.line, r.wording) for r in licenses.scan_licenses(df).filter("reduction > 0").collect())
    assert got == sorted((d, *w) for d, w in want.items())


def test_licenses_each(spark):
    mit, apache, gpl = licenses.TEMPLATES["MIT"], licenses.TEMPLATES["Apache-2.0"], licenses.TEMPLATES["GPL-3.0"]
    four = "\n".join((apache[1], mit[2], gpl[1], "Licensed under CC BY-SA 4.0."))
    rows = [(1, "Released under the MIT License.\nAll rights reserved."), (2, f"{mit[2]}\n{apache[1]}"), (3, four), (4, f"{mit[0]} {mit[0]} {mit[0]}"), (5, gpl[1] * 2)]
    # In one line without breaks, a notice at every place around a multiple of 4,000 characters.
    rows += [(10 + k, "licence " * ((4_000 - 50 * k) // 8) + mit[2] + " of words" * 900) for k in range(0, 16)]
    got = {}
    for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, []).append((r.line, r.license))
    want = {1: [(0, "MIT"), (1, "Proprietary")], 2: [(0, "MIT"), (1, "Apache-2.0")], 3: [(0, "Apache-2.0"), (1, "MIT"), (2, "GPL-3.0"), (3, "CC-BY-SA-4.0")],
            4: [(0, "MIT")] * 3, 5: [(0, "GPL-3.0")] * 2} | {10 + k: [(0, "MIT")] for k in range(0, 16)}
    assert {d: sorted(g) for d, g in got.items()} == want


def test_licenses_against_every_word(monkeypatch):
    """Notices with words left out, put in or replaced, in prose, side by side and repeated, against the search at every place."""
    r = random.Random(3)
    scanner = licenses.Scanner(licenses.TEMPLATES)
    prose = [f"{a}{b}" for a in "ka le mi to su".split() for b in "ran vel dos".split()] + "the of under and in work this license rights all by version 3 2 part form language".split()
    texts = ["All rights reserved.\n" * 400, "Licensed under CC BY-SA 4.0. " * 60, "mit " * 2_000, licenses.TEMPLATES["MIT"][2] * 5]
    for _ in range(150):
        words = r.choices(prose, k=r.randrange(0, 120))
        for _ in range(r.randrange(1, 4)):
            t = r.choice(scanner.items).text.split()
            for _ in range(r.randrange(0, len(t) // 12 + 1)):
                k = r.randrange(len(t))
                t[k:k + 1] = r.choice([[], [t[k], "now"], ["other"]])
            words += t + r.choices(prose, k=r.randrange(3, 80))
        texts.append(" ".join(words))
    want = [brute.notices(t, scanner.items) for t in texts]
    got = [scanner.found(licenses.tokens(t)) for t in texts]
    assert [len(w) for w in want[:4]] == [400, 60, 0, 5] and [[x[:3] for x in g] for g in got] == want
    assert all(x[4] > x[5] for g in got for x in g)
    # The ranking decides: asked in the reverse order, like licences are confirmed for each other.
    rank = licenses.Scanner.rank
    monkeypatch.setattr(licenses.Scanner, "rank", lambda self, words: [(-saved, *x) for saved, *x in rank(self, words)[::-1]])
    scanner = licenses.Scanner(licenses.TEMPLATES)
    assert [[x[:3] for x in scanner.found(licenses.tokens(t))] for t in texts] != want


def test_leaks(spark):
    item = " ".join(f"q{i}" for i in range(20))
    part = " ".join(f"q{i}" for i in range(17))
    rows = [(1, "x y z " * 3_000 + item.upper() + " end" * 9_000), (2, part + " and more"), (3, " ".join(f"q{i}" for i in range(16))), (4, None), (5, ""),
            (6, "a b c d"), (None, item), (7, item), (7, item), (8, " ".join(f"q{i}" for i in range(9)) + " | " + " ".join(f"q{i}" for i in range(8, 20)))]
    docs = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(1, item, 2), (2, "a b c d", 2), (3, None, 2), (None, item, 2), (4, item, 2)], "item_id long, text string, q int")
    got = sorted((r.doc_id, r.item_id, r.shared, r.item_shingles) for r in decontam.leaks(docs, items).collect())
    want = [(d, i, n, 16) for d, n in ((1, 16), (2, 13), (7, 16)) for i in (1, 4)]
    want += [(8, i, 5 + 8, 16) for i in (1, 4)] + [(6, 2, 1, 1)]
    assert got == sorted(want)
    assert sorted((r.doc_id for r in decontam.without_leaks(docs, items).collect()), key=str) == sorted([3, 4, 5, None], key=str)
    assert decontam.leaks(docs.filter("false"), items).collect() == [] and decontam.leaks(docs, items.filter("false")).collect() == []


def test_nearest_recall(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    got = {}
    for r in queries.op8_nearest(spark, SF).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hit = 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((x - x[ids == q]) ** 2).sum(1))
        d[ids == q] = np.inf
        found = sorted(got[q])
        assert [f[0] for f in found] == list(range(1, 11)) and all(abs(d[ids == v][0] - s) < 1e-12 for _, v, s in found)
        assert [(s, v) for _, v, s in found] == sorted((s, v) for _, v, s in found)
        hit += len(set(ids[np.lexsort((ids, d))[:10]]) & {v for _, v, _ in found})
    assert hit / (10 * len(got)) >= 0.9 and len(got) == (ids % 100 == 0).sum()


def test_nearest_edges(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [float("inf"), 1.0]),
            (8, [0.0, 2.0]), (None, [1.0, 1.0]), (9, [1.0]), (100, [0.0, 0.0])]
    df = spark.createDataFrame([(v, e, 0) for v, e in rows], "vec_id long, embedding array<float>, chunk int")
    got = [(r.query_id, r["rank"], r.vec_id) for r in ann.nearest(df, df.filter("vec_id % 100 = 0")).orderBy("query_id", "rank").collect()]
    assert got[:2] == [(0, 1, 1), (0, 2, 2)] and {g[0] for g in got} == {0} and len(got) <= 3
    assert ann.nearest(df.filter("false"), df).collect() == []


def test_nearest_all_queries_full(spark):
    rng = np.random.default_rng(3)
    copies = np.repeat(rng.normal(size=(40, 8)), 15, 0)  # 600 rows in groups of copies
    spread = np.concatenate([rng.normal(size=(300, 8)) * 1_000, rng.normal(size=(100, 8)) * 8_000])
    x = np.concatenate([copies, spread])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(df, df.filter("vec_id % 3 = 0"), chunk_rows=300).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    hit = total = 0
    for q in range(0, len(x), 3):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        found = sorted(got[q])
        assert [k for k, _ in found] == list(range(1, 11))
        if q >= 600:
            hit, total = hit + len(set(np.lexsort((np.arange(len(x)), d))[:10]) & {v for _, v in found}), total + 10
    assert hit / total >= 0.97
    two = spark.createDataFrame([(1, [0.0, 1.0]), (2, [0.0, 11.0])], "vec_id long, embedding array<double>")
    assert sorted((r.query_id, r.vec_id, r.score) for r in ann.nearest(two, two).collect()) == [(1, 2, 10.0), (2, 1, 10.0)]
    # Two rows of one query id are two queries.
    twice = ann.nearest(df, df.filter("vec_id = 700").withColumn("n", F.explode(F.array(F.lit(1), F.lit(2)))).drop("n"))
    assert twice.count() == 20 and twice.select("vec_id").distinct().count() == 10


def contained(docs, items, n=5, share=0.8):
    words = lambda t: [w for w in re.split(r"[^\w]|_", t.lower()) if w]
    grams = lambda w, k: {tuple(w[i:i + k]) for i in range(len(w) - k + 1)}
    out = set()
    for d, t in docs:
        for i, it in items:
            w = words(it)
            if w:
                own = grams(w, min(n, len(w)))
                both = len(own & grams(words(t), min(n, len(w))))
                if both >= math.ceil(share * len(own) - 1e-9):
                    out.add((d, i, both, len(own)))
    return sorted(out)


def test_short_items_and_shared_openings(spark):
    """Items of one to four words, and many items with one opening: found whole, few candidates."""
    opening = " ".join(f"o{i}" for i in range(12))
    items = [(i, f"{opening} " + " ".join(f"i{i}x{j}" for j in range(12))) for i in range(40)]
    items += [(100, "one two three four"), (101, "solo"), (102, "zwei drei"), (103, "a b c"), (104, "..."), (105, "x1 x2 x3 x4 x5")]
    docs = [(i, f"{opening} and nothing else of {i}") for i in range(30)] + [(200, items[7][1] + " tail"), (201, "One, two; three four"), (202, "here solo stands"), (203, "drei zwei"),
            (204, "zwei drei"), (205, "a b"), (206, "a b c d"), (207, ""), (208, "x1 x2 x3 x4 x5")]
    a = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, h int")
    b = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, q int")
    kept, seen = decontam.stored, {}
    decontam.stored = lambda df, name: seen.setdefault(name, kept(df, name))
    try:
        got = decontam.leaks(a, b).collect()
    finally:
        decontam.stored = kept
    assert sorted((r.doc_id, r.item_id, r.shared, r.item_shingles) for r in got) == contained(docs, items)
    assert seen["leak-pairs"].count() <= 20


def test_long_runs_of_letters():
    """No run is cut and no sum underflows: logs of exact fractions."""
    from fractions import Fraction
    index = {"▁": 0, "a": 1, "aa": 2, "b": 3}
    prob = np.array([[0.1, 0.2], [1e-7, 0.3], [1e-7, 1e-7], [0.2, 1e-7], [1e-7, 1e-6], [0.0, 0.0]])
    for word in ("▁" + "a" * 300, "▁" + "я" * 200, "▁" + "ab" * 500 + "я"):
        got = langid.word_scores([word, word], index, prob)
        for lang in range(2):
            p = {w: Fraction(float(prob[i, lang])) for w, i in index.items()}
            before, now = Fraction(0), Fraction(1)
            for j, c in enumerate(word):
                pair = word[j - 1:j + 1]
                before, now = now, now * p.get(c, Fraction(float(prob[4, lang]))) + (before * p[pair] if j and pair in p else 0)
            want = math.log(now.numerator) - math.log(now.denominator)
            assert np.allclose(got[:, lang], want, rtol=1e-10)
    longest = langid._log_forward(["▁" + "ab" * 6000], langid.Pieces(index), prob)
    assert np.isfinite(longest).all() and (longest < -50_000).all()


def test_lattice_finds_every_piece():
    pieces = ["▁", "▁the", "th", "e", "он", "о", "𐐨x", "the" * 9]
    index = {p: i for i, p in enumerate(pieces)}
    for word in ("▁the", "▁он𐐨x", "▁" + "the" * 9 + "e"):
        ids = langid.lattice([word], index)[0]
        for i in range(len(word)):
            for j in range(i + 1, min(len(word), i + ids.shape[1]) + 1):
                want = index.get(word[i:j], len(index) + (j > i + 1))
                assert ids[i, j - i - 1] == want
