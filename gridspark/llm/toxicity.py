"""Toxicity from confirmed toxic examples and unlabelled text: non-negative positive-unlabelled learning."""

import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gridspark.functions.sizing import stored
from gridspark.llm.arrays import small_batches

WORDS = re.compile(r"[^\W\d_]+")
BITS = 24
PREFIXES = (3, 4, 5, 6, 7)
#: Shares of a text's words above which a word or prefix counts as frequent, if it occurs twice.
RATES = (0.002, 0.01)
#: Words whose features a worker keeps; beyond it the table is started anew.
KEPT_WORDS = 100_000


def word_features(word: str) -> tuple[int, ...]:
    """Numbers of a word and of its prefixes, each with room for the levels of frequency."""
    every = (word, *[f"^{word[:n]}" for n in PREFIXES if n <= len(word)])
    return tuple((zlib.crc32(f.encode()) & ((1 << BITS) - 1)) * 4 for f in every)


def text_features(text: str | None, of=word_features) -> list[int]:
    """The distinct features of a whole text: each word and prefix, and again for each rate it reaches."""
    words = WORDS.findall(text.lower()) if text else []
    count: dict[int, int] = {}
    for w, c in Counter(words).items():
        for f in of(w):
            count[f] = count.get(f, 0) + c
    out, n = list(count), len(words)
    for f, c in count.items():
        if c > 1:
            out += [f + level for level, r in enumerate(RATES, 1) if c >= r * n]
    return out


def select(p: np.ndarray, u: np.ndarray, n_p: int, n_u: int, min_docs: int, surprise: float = 5.0) -> np.ndarray:
    """Whether features found in p of n_p positives and u of n_u unlabelled texts tell the two apart:
    in ``min_docs`` positives, twice as often there, and ``surprise`` deviations above chance."""
    share = (u + 1.0) / (n_u + 2.0)
    return (p >= min_docs) & (p / n_p > 2 * share) & (p - n_p * share > surprise * np.sqrt(n_p * share * (1 - share)))


def _sigmoid(f: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(f, -30, 30)))


def nnpu_slope(p, u, w: np.ndarray, b: float, prior: float, non_negative: bool = True):
    """The bracket E_u[loss(-)] - prior * E_p[loss(-)] at weights w and bias b, and the direction to step
    against: the slope of prior * E_p[loss(+)] + bracket, or of the bracket turned round where it is
    negative. p and u have (row, column, number of rows) of their features; the loss is the sigmoid's."""
    def side(rows, columns, n):
        s = _sigmoid(np.bincount(rows, w[columns], n) + b)
        d = s * (1 - s)
        return s.mean(), np.append(np.bincount(columns, d[rows], len(w)), d.sum()) / n

    (mean_p, gp), (mean_u, gu) = side(*p), side(*u)
    bracket = mean_u - prior * mean_p
    return bracket, prior * gp - gu if non_negative and bracket < 0 else gu - 2 * prior * gp


def nnpu_fit(x_p: list, x_u: list, prior: float, rounds: int = 100, rate: float = 0.03, decay: float = 0.02):
    """Weights {feature: weight} and bias of a linear classifier on sets of features.

    The risk is prior * E_p[loss(+)] + max(0, E_u[loss(-)] - prior * E_p[loss(-)]) with the sigmoid
    loss; where the bracket is negative the step goes against its gradient, as the non-negative
    estimator asks. Weights start at zero and the bias at the prior's log-odds, so that training
    alone tells texts apart; a square penalty of ``decay`` holds the weights near zero.
    """
    kept = np.unique(np.concatenate([np.zeros(0, np.int64), *[np.asarray(s, np.int64) for s in x_p]]))
    size = len(kept)
    if not size or not x_u:
        return {}, -10.0

    def matrix(sets):
        flat = np.concatenate([np.zeros(0, np.int64), *[np.asarray(s, np.int64) for s in sets]])
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.minimum(np.searchsorted(kept, flat), size - 1)
        here = kept[at] == flat
        return row[here], at[here], len(sets)

    p, u = matrix(x_p), matrix(x_u)
    w, b = np.zeros(size), float(np.log(min(max(prior, 1e-3), 0.5) / (1 - min(max(prior, 1e-3), 0.5))))
    mean, square = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, rounds + 1):
        _, g = nnpu_slope(p, u, w, b, prior)
        g[:size] += decay / size * w
        mean, square = 0.9 * mean + 0.1 * g, 0.999 * square + 0.001 * g * g
        move = rate * (mean / (1 - 0.9 ** step)) / (np.sqrt(square / (1 - 0.999 ** step)) + 1e-8)
        w, b = w - move[:size], b - move[size]
    return dict(zip(kept.tolist(), w.tolist())), float(b)


def _fit_sample(sample: DataFrame, prior: float):
    """Fit on a bounded stored table (text, toxic, in_u)."""
    def count(batches):
        for b in batches:
            got: dict[int, list[int]] = {}
            of = lru_cache(KEPT_WORDS)(word_features)
            for t, toxic, in_u in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), b.column("in_u").to_pylist()):
                for f in text_features(t, of):
                    c = got.setdefault(f, [0, 0])
                    c[0] += toxic == 1
                    c[1] += in_u
            yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.int64()), *[pa.array([c[k] for c in got.values()], pa.int64()) for k in (0, 1)]], ["f", "p", "u"])

    n_p, n_u = sample.agg(F.count_if(F.col("toxic") == 1), F.count_if("in_u")).first()
    least = 3 if n_p < 500 else 5
    found = sample.mapInArrow(count, "f long, p long, u long").groupBy("f").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    found = found.filter(F.col("p") >= least).toPandas()
    kept = set(found["f"][select(found["p"].to_numpy(), found["u"].to_numpy(), max(1, n_p), n_u, least)].tolist())

    def sets(batches):
        for b in batches:
            of = lru_cache(KEPT_WORDS)(word_features)
            got = [[f for f in text_features(t, of) if f in kept] for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("toxic"), b.column("in_u"), pa.array(got, pa.list_(pa.int64()))], ["toxic", "in_u", "features"])

    got = sample.mapInArrow(sets, "toxic int, in_u boolean, features array<long>").toPandas()
    return nnpu_fit(list(got.loc[got["toxic"] == 1, "features"]), list(got.loc[got["in_u"], "features"]), prior)


def fit_documents(docs: DataFrame, labels: DataFrame, held_out, sample_positive: int = 4_000, sample_unlabelled: int = 12_000):
    """(weights, bias) from ``docs`` (doc_id, text) with the ``labels`` (doc_id, toxic) of rows outside ``held_out``.

    Rows with toxic = 1 are the confirmed examples; the unlabelled text is drawn from all rows. A
    label 0 enters only the class prior, the share of 1 among labelled documents. Of each kind
    about so many documents as the two bounds say, those whose id hashes lowest, are the sample.
    Ids are joined with labels first and the sample's ids pick their texts, so no text is shuffled;
    features are counted over the sample by Spark, and the driver sees those that tell the kinds
    apart. Of several labels of a document the largest counts; null ids and texts take no part.
    Without a confirmed example nothing is toxic.
    """
    small_batches(docs)
    found = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    ids = docs.filter(~held_out).select("doc_id").filter("doc_id is not null").distinct().join(found, "doc_id", "left")
    ids = stored(ids, "toxic-ids")
    n = ids.agg(F.count_if(F.col("toxic") == 1).alias("p"), F.count("*").alias("n"), F.count("toxic").alias("l")).first()
    if not n["p"]:
        return {}, -10.0
    turn = F.pmod(F.xxhash64(F.lit("toxicity"), "doc_id"), F.lit(1 << 20))
    limit = lambda bound, have: int(min(1.0, bound / max(1, have)) * (1 << 20))
    in_u = turn < limit(sample_unlabelled, n["n"])
    is_p = F.coalesce(F.col("toxic") == 1, F.lit(False)) & (turn < limit(sample_positive, n["p"]))
    sample = ids.select("doc_id", F.when(is_p, 1).otherwise(0).alias("toxic"), in_u.alias("in_u")).filter("toxic = 1 or in_u")
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # bounded by the two parameters
    return _fit_sample(stored(rows.filter("text is not null").select("text", "toxic", "in_u"), "toxic-sample"), n["p"] / n["l"])


def score(docs: DataFrame, model, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """Add ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on), or two columns of other ``names``;
    needs only the column text, whole and of any length. A null or empty text has no feature, so
    its score is the bias's. Columns that have these names are replaced. Each row stands alone."""
    box = small_batches(docs).sparkSession.sparkContext.broadcast(model)
    keep = [c for c in docs.columns if c not in names]
    send = keep if "text" in keep else [*keep, "text"]

    def run(batches):
        weights, bias = box.value
        bases = {f - f % 4 for f in weights}
        known: dict[str, tuple] = {}
        of = lambda w: tuple(f for f in word_features(w) if f in bases)
        for b in batches:
            total = np.empty(b.num_rows)
            column = b.column("text")
            for a in range(0, b.num_rows, 500):
                if len(known) > KEPT_WORDS:
                    known = {}
                for i, t in enumerate(column.slice(a, 500).to_pylist()):
                    words = WORDS.findall(t.lower()) if t else ()
                    count: dict[int, int] = {}
                    for w in words:
                        fs = known.get(w)
                        if fs is None:
                            fs = known[w] = of(w)
                        for f in fs:
                            count[f] = count.get(f, 0) + 1
                    x = bias
                    for f, c in count.items():
                        x += weights.get(f, 0.0)
                        if c > 1:
                            x += sum(weights.get(f + level, 0.0) for level, r in enumerate(RATES, 1) if c >= r * len(words))
                    total[a + i] = x
            found = _sigmoid(total)
            yield pa.RecordBatch.from_arrays([b.column(c) for c in keep] + [pa.array(found), pa.array((found >= 0.5).astype(np.int32))], [*keep, *names])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*keep).schema)
    return docs.select(*send).mapInArrow(run, schema + f"`{names[0]}` double, `{names[1]}` int")
