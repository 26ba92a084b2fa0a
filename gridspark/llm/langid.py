"""Language of a text: unigram pieces of a fixed public vocabulary, all segmentations summed."""

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gridspark.functions.sizing import stored
from gridspark.llm.arrays import mix, small_batches

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
START = "▁"
LETTERS = re.compile(r"[^\W\d_]+")
#: Longer runs of letters are scored like all others, but nothing is learnt from them.
LONGEST_TAUGHT = 64
#: Words whose scores every task has from the start, the most frequent of the sample, and those a worker keeps beyond them.
SHARED_WORDS = 200_000
KEPT_WORDS = 200_000
#: Positions of a lattice made at a time, and entries of one.
CHUNK = 4096
LATTICE_ENTRIES = 1 << 21
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


class Pieces(dict):
    """Piece -> number, with the pieces of each length as sorted hashes next to their letters, and the
    scores of words that are known beforehand."""

    def __init__(self, pieces):
        super().__init__(pieces)
        by: dict[int, list] = {}
        for p, i in self.items():
            by.setdefault(len(p), []).append((p, i))
        self.longest = max(by, default=1)
        self.tables = {}
        for k, rows in by.items():
            codes = _codes([p for p, _ in rows])
            h = _hashes(codes, k)[:, 0]
            order = np.argsort(h)
            self.tables[k] = h[order], codes[order], np.array([i for _, i in rows], np.int32)[order]
        self.known: dict[str, int] = {}
        self.scores = None


def _codes(words: list[str]) -> np.ndarray:
    """Code points of words of one length."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), len(words[0]))


def _hashes(codes: np.ndarray, k: int, prefix=None) -> np.ndarray:
    """Hash of every stretch of ``k`` letters."""
    n = codes.shape[1]
    prefix = _prefix(codes) if prefix is None else prefix
    back = np.full(n - k + 1, _INVERSE, np.uint64)
    back[0] = 1
    return (prefix[:, k:] - prefix[:, :n - k + 1]) * np.multiply.accumulate(back)


def _prefix(codes: np.ndarray) -> np.ndarray:
    powers = np.full(codes.shape[1], _BASE, np.uint64)
    powers[0] = 1
    out = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64)
    np.cumsum(mix(codes.astype(np.uint64) + _U(1)) * np.multiply.accumulate(powers), axis=1, out=out[:, 1:])
    return out


def read_pieces(path: str = VOCABULARY) -> list[str]:
    """The lower-case letter pieces of a sentencepiece vocabulary, in its order."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = dict.fromkeys(model.id_to_piece(i).lower() for i in range(model.get_piece_size())
                          if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i)))
    return [p for p in found if p == START or LETTERS.fullmatch(p.removeprefix(START))]


def text_words(text: str | None) -> list[str]:
    """Runs of letters, lower-cased, each after a start mark."""
    return [START + w for w in LETTERS.findall(text.lower())] if text else []


def lattice(words: list[str], index: dict[str, int]):
    """Piece number of every stretch of words of one length n: ids[word, start, length - 1], the
    number of pieces where a stretch is none. A single letter that is no piece is the last piece."""
    pieces = index if isinstance(index, Pieces) else Pieces(index)
    n, unknown = len(words[0]), len(pieces)
    codes = _codes(words)
    prefix = _prefix(codes)
    ids = np.full((len(words), n, min(n, pieces.longest)), unknown + 1, np.int32)
    for k, (hashes, letters, numbers) in pieces.tables.items():
        if k > n:
            continue
        h = _hashes(codes, k, prefix)
        at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
        word, start = np.nonzero(hashes[at] == h)
        at = at[word, start]
        same = (codes[word[:, None], start[:, None] + np.arange(k)] == letters[at]).all(1)
        ids[word[same], start[same], k - 1] = numbers[at[same]]
    ids[:, :, 0][ids[:, :, 0] == unknown + 1] = unknown
    return ids


def _by_length(words: list[str]):
    by: dict[int, list[int]] = {}
    for k, w in enumerate(words):
        by.setdefault(len(w), []).append(k)
    for n, at in by.items():
        most = max(1, min(4096, LATTICE_ENTRIES // (16 * n)))
        for a in range(0, len(at), most):
            yield at[a:a + most]


def forward(ids: np.ndarray, prob: np.ndarray) -> np.ndarray:
    """alpha[word, position, language]: total probability of all segmentations of each beginning."""
    m, n, longest = ids.shape
    alpha = np.zeros((m, n + 1, prob.shape[1]))
    alpha[:, 0] = 1
    for j in range(1, n + 1):
        for k in range(1, min(j, longest) + 1):
            alpha[:, j] += alpha[:, j - k] * prob[ids[:, j - k, k - 1]]
    return alpha


def backward(ids: np.ndarray, prob: np.ndarray) -> np.ndarray:
    m, n, longest = ids.shape
    beta = np.zeros((m, n + 1, prob.shape[1]))
    beta[:, n] = 1
    for i in range(n - 1, -1, -1):
        for k in range(1, min(n - i, longest) + 1):
            beta[:, i] += beta[:, i + k] * prob[ids[:, i, k - 1]]
    return beta


def _log_forward(words: list[str], pieces: Pieces, prob: np.ndarray) -> np.ndarray:
    """Log of the sum over all segmentations of words of one length, in each language. Only the last sums a
    piece can reach back to are held, and they are scaled as they shrink, so words may be of any length."""
    n, longest = len(words[0]), pieces.longest
    logs = np.zeros((len(words), prob.shape[1]))
    alpha = np.ones((len(words), 1, prob.shape[1]))
    for a in range(0, n, CHUNK):
        low = max(0, a - longest)
        ids = lattice([w[low:a + CHUNK] for w in words], pieces)
        size = ids.shape[1]
        alpha = np.concatenate((alpha, np.zeros((len(words), size - (a - low), prob.shape[1]))), axis=1)
        for j in range(a - low + 1, size + 1):
            k = np.arange(1, min(j, ids.shape[2]) + 1)
            alpha[:, j] = (alpha[:, j - k] * prob[ids[:, j - k, k - 1]]).sum(1)
            if j % 8 == 0:
                near = alpha[:, max(0, j - longest):j + 1]
                scale = near.max(1)
                near /= scale[:, None]
                logs += np.log(scale)
        alpha = alpha[:, -min(longest, size) - 1:]
    return logs + np.log(alpha[:, -1])


def word_scores(words: list[str], index: dict[str, int], prob: np.ndarray) -> np.ndarray:
    """Log of the forward sum of each word in each language; prob has a row for unknown letters and a row of zeros."""
    pieces = index if isinstance(index, Pieces) else Pieces(index)
    out = np.zeros((len(words), prob.shape[1]))
    for at in _by_length(words):
        out[at] = _log_forward([words[k] for k in at], pieces, prob)
    return out


def _gathered(batches, rows: int = 20_000):
    """Batches of words put together, since words of one length are worked on at once."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += len(b)
        if size >= rows:
            yield pd.concat(held, ignore_index=True)
            held, size = [], 0
    if held:
        yield pd.concat(held, ignore_index=True)


def _expected(index, box):
    """Expected piece counts of (lang, word, n) rows under the current probabilities."""
    def run(batches):
        prob = box.value
        total = np.zeros((prob.shape[0], prob.shape[1]))
        for b in _gathered(batches):
            langs, ws, n = b["lang"].to_numpy(), b["word"].tolist(), b["n"].to_numpy().astype(float)
            for at in _by_length(ws):
                ids = lattice([ws[k] for k in at], index)
                for lang in np.unique(langs[at]):
                    mine = np.flatnonzero(langs[at] == lang)
                    p, x = prob[:, [lang]], ids[mine]
                    alpha, beta = forward(x, p)[:, :, 0], backward(x, p)[:, :, 0]
                    scale = n[np.asarray(at)[mine]] / np.maximum(alpha[:, -1], 1e-300)
                    for k in range(x.shape[2]):
                        for i in range(x.shape[1] - k):
                            q = x[:, i, k]
                            total[:, lang] += np.bincount(q, alpha[:, i] * p[q, 0] * beta[:, i + k + 1] * scale, len(total))
        piece, lang = np.nonzero(total)
        yield pd.DataFrame({"piece": piece, "lang": lang, "n": total[piece, lang]})
    return run


def train(rows: DataFrame, vocabulary: str = VOCABULARY, rounds: int = 3, sample_rows: int = 20_000, floor: float = 1e-7):
    """(languages, piece index, probabilities) from rows (key, text, lang), by expectation maximisation.

    About ``sample_rows`` rows are used when there are more: of every language as many, those whose
    ``key`` hashes lowest, or all where it has fewer.
    Word counts are made by Spark and each round's expected counts are summed by Spark; the driver
    holds one number for each piece and language. No usable row gives no languages.
    """
    spark = small_batches(rows).sparkSession
    rows = rows.filter("text is not null and lang is not null")
    per = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    langs = sorted(per)
    if sum(per.values()) > sample_rows:
        left, most = sample_rows, 0.0
        for i, c in enumerate(sorted(per.values())):
            most = left / (len(per) - i)
            left -= min(c, most)
        limit = F.create_map(*[F.lit(x) for lang, c in per.items() for x in (lang, int(min(1.0, most / c) * (1 << 40)))])
        rows = rows.filter(F.pmod(F.xxhash64(F.lit("langid"), "key"), F.lit(1 << 40)) < limit[F.col("lang")])
    index = Pieces({p: i for i, p in enumerate(read_pieces(vocabulary))})
    if not langs:
        return [], index, np.zeros((len(index) + 2, 0))
    number = F.create_map(*[F.lit(x) for i, c in enumerate(langs) for x in (c, i)])

    def split(batches):
        for b in batches:
            for lang, part in b.groupby("lang"):
                count: dict[str, int] = {}
                for t in part["text"]:
                    for w in text_words(t):
                        if len(w) <= LONGEST_TAUGHT:
                            count[w] = count.get(w, 0) + 1
                yield pd.DataFrame({"lang": lang, "word": list(count), "n": list(count.values())})

    counts = rows.select(number[F.col("lang")].alias("lang"), "text").mapInPandas(split, "lang int, word string, n long")
    counts = stored(counts.groupBy("lang", "word").agg(F.sum("n").alias("n")), "langid-words")
    prob = np.full((len(index) + 2, len(langs)), 1.0 / (len(index) + 1))
    prob[-1] = 0
    for _ in range(rounds):
        box = spark.sparkContext.broadcast(prob)
        found = counts.mapInPandas(_expected(index, box), "piece int, lang int, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n"))
        total = np.zeros_like(prob)
        found = found.toPandas()  # at most one number for each piece and language
        total[found["piece"], found["lang"]] = found["n"]
        total[:-1] += 0.01
        prob = np.maximum(total / total.sum(0), floor)
        prob[-1] = 0
        box.destroy()
    return langs, _with_known(index, prob, counts), prob


def _with_known(index: Pieces, prob: np.ndarray, counts: DataFrame) -> Pieces:
    """The pieces with the scores of the sample's most frequent words, made once and by Spark."""
    box = counts.sparkSession.sparkContext.broadcast((index, prob))

    def run(batches):
        for b in _gathered(batches):
            words = b["word"].tolist()
            yield pd.DataFrame({"word": words, "score": list(word_scores(words, *box.value))})

    words = counts.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "word").limit(SHARED_WORDS).select("word")
    parts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = words.repartition(parts).mapInPandas(run, "word string, score array<double>").toPandas()
    out = Pieces(index)
    out.known = {w: i for i, w in enumerate(found["word"])}
    out.scores = np.stack(found["score"]) if len(found) else None
    return out


def predict(docs: DataFrame, model) -> DataFrame:
    """Add ``lang_pred`` and ``score`` (the language's share among all languages, each as likely
    beforehand) to ``docs``; needs only the column text. The whole text counts. A null text, one
    without a letter, or a model without languages gives ``und`` and 0; ties go to the first
    language by code point."""
    langs, index, prob = model
    box = small_batches(docs).sparkSession.sparkContext.broadcast((langs, index, prob))
    keep = [c for c in docs.columns if c not in ("text", "lang_pred", "score")]

    def run(batches):
        langs, index, prob = box.value
        shared = index.scores if index.scores is not None else np.zeros((0, len(langs)))
        known, table = dict(index.known), shared
        for b in batches:
            names = np.full(b.num_rows, "und", object)
            score = np.zeros(b.num_rows)
            column = b.column("text")
            for a in range(0, b.num_rows, 500):
                lists = [text_words(t) for t in column.slice(a, 500).to_pylist()]
                if len(known) > len(shared) + KEPT_WORDS:
                    known, table = dict(index.known), shared
                fresh = list(dict.fromkeys(w for ws in lists for w in ws if w not in known))
                if fresh and langs:
                    known.update(zip(fresh, range(len(table), len(table) + len(fresh))))
                    table = np.concatenate([table, word_scores(fresh, index, prob)])
                if not langs:
                    continue
                for i, ws in enumerate(lists):
                    if ws:
                        total = table[np.fromiter(map(known.__getitem__, ws), np.int64, len(ws))].sum(0)
                        best = int(total.argmax())
                        names[a + i], score[a + i] = langs[best], 1 / np.exp(total - total[best]).sum()
            yield pa.RecordBatch.from_arrays([b.column(c) for c in keep] + [pa.array(names, pa.string()), pa.array(score)], keep + ["lang_pred", "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return docs.select(*keep, "text").mapInArrow(run, (schema + ", " if schema else "") + "lang_pred string, score double")
