"""Benchmark decontamination: size-partitioned MinHash containment search. DataFrame operations only."""

import math

from pyspark.sql import DataFrame, functions as F

from gridspark.functions.sizing import MAX_BROADCAST_ROWS, stored

WORDS = 5
CONTAINMENT = 0.8
#: Hashes are 62 bits wide, so thresholds stay inside a long.
SPACE = 1 << 62


def word_list(text):
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), lambda w: w != "")


def shingle_words(words, n: int):
    """The n-word shingles as strings of words; none with fewer words."""
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: F.array_join(F.slice(words, i + 1, n), " "))
                  ).otherwise(F.array().cast("array<string>"))


def item_words(words, n: int):
    """The n-word shingles of an item; with fewer words its whole sequence is the only one."""
    short = F.when(F.size(words) > 0, F.array(F.array_join(words, " "))).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(words) >= n, shingle_words(words, n)).otherwise(short)


def _hash(shingle):
    return F.shiftrightunsigned(F.xxhash64(shingle), 2)


def item_shingles(items: DataFrame, n: int) -> DataFrame:
    """(item_id, shingle, q, size): distinct shingles of every item, their number, and the words of each."""
    each = items.filter("item_id is not null and text is not null").select("item_id", word_list(F.col("text")).alias("w"))
    each = each.select("item_id", F.least(F.size("w"), F.lit(n)).alias("size"), F.array_distinct(item_words(F.col("w"), n)).alias("s"))
    each = each.select("item_id", "size", F.explode("s").alias("shingle")).distinct()
    q = each.groupBy("item_id").agg(F.count("*").alias("q"))
    return each.join(q, "item_id")


#: The maps that say which hashes leave the scan have 16 bits a sketch hash, but 2 ** MAP_BITS at most; a full
#: map lets more hashes through to the join.
MAP_BITS = 18


def _one(h, bits: int):
    """The bit of a hash among the 64 of the long that its leading bits name."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, 62 - bits).bitwiseAND(F.lit(63)).cast("int"))


def _hit(table, h, bits: int):
    return F.get(table, F.shiftright(h, 68 - bits).cast("int")).bitwiseAND(_one(h, bits)) != 0


def _hits(hashes, table, bits: int):
    return F.filter(hashes, lambda h: _hit(table, h, bits))


def _run_hashes(k: int):
    """Hash of every run of ``k`` words of the column ``w``."""
    return F.transform(F.sequence(F.lit(1), F.size("w") - (k - 1)), lambda i: _hash(F.array_join(F.slice("w", i, k), " ")))


def _maps(sketch: DataFrame, n_bits: int) -> list[tuple[int, list[int]]]:
    """(least that items need, map) of each size class, largest first; a map holds the sketches of its class and
    those below. The driver holds 2 ** MAP_BITS bits a class at most."""
    rows = sketch.groupBy("class", F.shiftright("h", 68 - n_bits).cast("int").alias("word")).agg(
        F.bit_or(_one(F.col("h"), n_bits)).alias("bits"), F.min("c").alias("least")).collect()
    table, out = [0] * (1 << (n_bits - 6)), []
    for k in sorted({r["class"] for r in rows}):
        for r in rows:
            if r["class"] == k:
                table[r["word"]] |= r["bits"]
        out.append((min(r["least"] for r in rows if r["class"] == k), list(table)))
    return out[::-1]


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= MAX_BROADCAST_ROWS else df


def leaks(docs: DataFrame, items: DataFrame, n: int = WORDS, containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, item_id, shared, item_shingles, containment) for every pair where ``containment`` or
    more of the item's distinct ``n``-word shingles occur in the document.

    Items are partitioned by size: an item of q shingles, of which a document must hold
    c = ceil(containment * q), is searched by q - c + 1 of its shingles, those that the fewest items
    have, by hash among equals (its MinHash sketch). A document that contains the item holds one of
    them at least, however long it is, so no pair is missed. Each size class (powers of two) has a
    bit map of its sketches; a document of u shingles looks only into classes whose items need no
    more than u, and only hashes that their map holds leave the scan. Candidate pairs are verified
    on the shingles themselves, those of their own items alone.

    An item with fewer than ``n`` words has one shingle, its whole sequence, and documents are searched for
    runs of as many words. Items and documents without words and null ids and texts give no pair.
    Repeated items or documents are the same item or document: their shingles are put together, other
    columns, whatever their names, are not read. Empty tables give none.
    """
    words = stored(item_shingles(items, n), "leak-items")
    needed = F.ceil(F.col("q") * F.lit(containment) - 1e-9).cast("long")
    spread = words.groupBy("shingle").agg(F.countDistinct("item_id").alias("df"))
    listed = words.join(spread, "shingle").select("item_id", "q", needed.alias("c"), F.struct("df", _hash(F.col("shingle")).alias("h")).alias("x"))
    sketch = listed.groupBy("item_id", "q", "c").agg(F.sort_array(F.collect_list("x")).alias("x"))  # one item's shingles
    sketch = sketch.select("c", F.floor(F.log2("q")).cast("int").alias("class"), "item_id",
                           F.explode(F.slice("x.h", F.lit(1), (F.col("q") - F.col("c") + 1).cast("int"))).alias("h"))
    sketch = stored(sketch.groupBy("h", "class").agg(F.min("c").alias("c"), F.collect_set("item_id").alias("items")), "leak-sketch")
    size = sketch.count()
    item_rows = words.count()
    lengths = sorted(r[0] for r in words.select("size").distinct().collect())  # at most n
    bits = min(MAP_BITS, max(10, (16 * size).bit_length()))
    maps = _maps(sketch, bits)
    docs = docs.filter("doc_id is not null and text is not null")
    got = docs.select("doc_id", word_list(F.col("text")).alias("w")).filter(F.size("w") > 0)
    # sequence(1, 0) would count down, hence the condition on the words.
    hashes = [F.when(F.size("w") >= k, _run_hashes(k)).otherwise(F.array().cast("array<bigint>")) for k in lengths]
    got = got.select("doc_id", F.greatest(F.size("w") - (n - 1), F.lit(1)).alias("u"), (F.concat(*hashes) if hashes else F.array().cast("array<bigint>")).alias("hs"))
    inside = F.array().cast("array<bigint>")
    for least, table in reversed(maps):
        inside = F.when(F.col("u") >= least, _hits("hs", F.lit(table), bits)).otherwise(inside)
    got = got.select("doc_id", "u", F.explode(F.array_distinct(inside)).alias("h"))
    pairs = got.join(_small(sketch, size), "h").filter("u >= c").select("doc_id", F.explode("items").alias("item_id")).distinct()
    pairs = stored(pairs, "leak-pairs")
    cand = stored(pairs.groupBy("doc_id").agg(F.collect_set("item_id").alias("cand")), "leak-candidates")  # one document's candidates
    texts = docs.select("doc_id", "text").join(_small(cand, cand.count()), "doc_id")
    # The word list is a column of its own: inside the function over positions it would be made anew for each.
    found = texts.select("doc_id", "cand", word_list(F.col("text")).alias("w"))
    every = F.concat(*[shingle_words(F.col("w"), k) for k in lengths]) if lengths else F.array().cast("array<string>")
    found = found.select("doc_id", "cand", F.explode(F.array_distinct(every)).alias("shingle"))
    mine = _small(words, item_rows).alias("i")
    found = found.join(mine, (F.col("i.shingle") == found["shingle"]) & F.array_contains("cand", F.col("i.item_id")))
    found = found.select("doc_id", "i.item_id", "i.shingle", "i.q").distinct()
    found = found.groupBy("doc_id", "item_id", "q").agg(F.count("*").alias("shared")).filter(F.col("shared") >= needed)
    return found.select("doc_id", "item_id", "shared", F.col("q").alias("item_shingles"), (F.col("shared") / F.col("q")).alias("containment"))


def without_leaks(docs: DataFrame, items: DataFrame, n: int = WORDS, containment: float = CONTAINMENT) -> DataFrame:
    """Rows of ``docs`` whose doc_id is in no pair of :func:`leaks`; null ids and texts stay."""
    bad = stored(leaks(docs, items, n, containment).select("doc_id").distinct(), "leak-ids")
    return docs.join(_small(bad, bad.count()), "doc_id", "left_anti").select(*docs.columns)


SQL = r"""
WITH dw AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w : w <> '') AS w
            FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
iw AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w : w <> '') AS w
       FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
bs AS (SELECT DISTINCT item_id, w[i:i + 4] AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS i FROM iw)
  UNION ALL SELECT DISTINCT item_id, w FROM iw WHERE len(w) BETWEEN 1 AND 4),
ds AS (SELECT DISTINCT doc_id, w[i:i + k - 1] AS s FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, (SELECT DISTINCT len(s) AS k FROM bs))),
q AS (SELECT item_id, count(*) AS q FROM bs GROUP BY item_id)
SELECT doc_id, item_id, count(*) AS shared, any_value(q) AS item_shingles, count(*)::DOUBLE / any_value(q)::DOUBLE AS containment
FROM ds JOIN bs USING (s) JOIN q USING (item_id) GROUP BY doc_id, item_id HAVING count(*) >= ceil(any_value(q) * 0.8 - 1e-9)
"""
