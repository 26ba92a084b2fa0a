import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gridspark.llm import decontam, mixing, toxicity
from tests.conftest import SF
from tests.llm import brute


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    kept = {}
    rows = docs
    for name, stage in corpus_pipeline.STAGES:
        rows = stage(spark, rows, SF).cache()
        if name != names[-1]:
            assert rows.columns == docs.columns
        kept[name] = rows
    ids = lambda n: {r.doc_id for r in kept[n].select("doc_id").collect()}
    model = toxicity.fit_documents(docs, spark.read.parquet(f"{SF}/labels.parquet"), F.lit(False))
    bad = {r.doc_id for r in toxicity.score(docs, model).filter("predicted = 1").collect()}
    every = {r.doc_id: r.text for r in docs.collect()}
    assert ids("toxicity") == set(every) - bad
    found = brute.components([(d, every[d]) for d in ids("toxicity")], 5, 80)
    assert ids("ngram_join") == {d for d, (_, c) in found.items() if c == d}
    leaked = {r.doc_id for r in decontam.leaks(kept["ngram_join"], spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert ids("decontamination") == ids("ngram_join") - leaked
    plan = {r.doc_id: (r.taken, r.size) for r in mixing.plan_mix(kept["decontamination"]).collect()}
    times = {r.doc_id: r["count"] for r in kept["mixing"].groupBy("doc_id").count().collect()}
    assert all(abs(times.get(d, 0) * size - taken) <= size for d, (taken, size) in plan.items())
    assert kept["sharding"].count() == kept["mixing"].count()


@pytest.mark.parametrize("empty", [0, 1, 2, 3, 4])
def test_stages_on_odd_rows(spark, empty):
    _, stage = corpus_pipeline.STAGES[empty]
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    assert stage(spark, spark.createDataFrame([], schema), SF).collect() == []
    rows = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "a", 0), (2, "a b c", None, None, 5), (2, "a b c", None, None, 5)], schema)
    assert stage(spark, rows, SF).count() >= 1


def test_stages_on_null_and_repeated_ids(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    item = spark.read.parquet(f"{SF}/benchmark.parquet").filter("text is not null").orderBy("item_id").first().text
    text = [" ".join(f"w{k}x{i}" for i in range(30)) for k in range(4)]
    frame = lambda rows: spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], schema)
    pairs = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    rows = [(3, text[0]), (3, text[1]), (4, text[1]), (None, text[0]), (None, text[2]), (None, text[2]), (None, text[2]), (5, text[3]), (5, text[3]), (6, ""), (6, "")]
    stages = dict(corpus_pipeline.STAGES)
    for order in (rows, rows[::-1]):
        assert pairs(stages["ngram_join"](spark, frame(order), SF)) == sorted([(3, text[0]), (3, text[1]), (None, text[2]), (5, text[3]), (6, "")], key=str)
    rows = [(None, f"before {item} after"), (None, text[0]), (3, item), (3, text[1]), (4, text[2])]
    assert pairs(stages["decontamination"](spark, frame(rows), SF)) == sorted([(None, text[0]), (3, text[1]), (4, text[2])], key=str)


def test_stages_keep_columns_of_any_name(spark):
    """Columns named like those that stages work with come out as they went in."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = ["score", "Predicted", "_times", "_time", "_whole", "_CUT", "_source", "no", "row", "grp", "text_", "size", "item_id", "n_shingles", "component_id", "was"]
    wide = docs.select("*", *[F.concat(F.lit(c), F.col("doc_id")).alias(c) for c in extra])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for rows in (wide, wide.unionByName(wide.limit(3))):
            got = stage(spark, rows, SF)
            assert got.columns == wide.columns, name
            assert got.filter(" or ".join(f"`{c}` <> concat('{c}', doc_id)" for c in extra)).isEmpty(), name
