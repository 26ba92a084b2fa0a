"""A corpus pipeline of five stages over documents: toxic texts out, one of each group of near copies,
benchmark leaks out, sources mixed to target weights, shards of equal bytes.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet to the shared
folder and gives what is read back to the next stage. All but the last return the columns of documents.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridspark.functions.sizing import stored
from gridspark.llm import decontam, mixing, ngram_join, sharding, toxicity
from gridspark.llm.names import free_names


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5. The classifier learns from all labelled documents given."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit_documents(docs, labels, F.lit(False))
    names = free_names(docs.columns, "score", "predicted")
    return toxicity.score(docs, model, tuple(names)).filter(F.col(names[1]) == 0).select(*docs.columns)


def _numbered(docs: DataFrame) -> DataFrame | None:
    """Rows (no, row: all columns) where an id is null or repeated, None where doc_id tells rows apart."""
    if docs.groupBy("doc_id").count().filter("doc_id is null or count > 1").isEmpty():
        return None
    return stored(docs.select(F.monotonically_increasing_id().alias("no"), F.struct(*docs.columns).alias("row")), "rows-numbered")


def copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of 0.8 or more on five-word shingles:
    the one with the smallest id, one without an id only where no other has one. Rows that share an
    id but hold different texts are documents of their own. Texts without words are linked
    with nothing; of equal ones with one id a single row stays."""
    rows = _numbered(docs)
    if rows is None:
        return ngram_join.one_per_component(docs, n=5, percent=80)
    found = ngram_join.jaccard_components(rows.select(F.col("no").alias("doc_id"), "row.text"), n=5, percent=80)
    rows = rows.join(found.select(F.col("doc_id").alias("no"), "n_shingles", "component_id"), "no")
    wordless = (F.col("n_shingles") == 0) & F.col("row.doc_id").isNotNull()
    group = (F.when(~wordless, F.col("component_id")).alias("g"), F.when(wordless, F.col("row.doc_id")).alias("d"),
             F.when(wordless, F.coalesce("row.text", F.lit(""))).alias("t"))
    # Among rows of one id the content decides, so that reruns keep the same.
    first = F.struct(F.col("row.doc_id").isNull(), F.col("row.doc_id"), F.sha2(F.to_json("row"), 256), F.col("no"))
    kept = rows.groupBy(*group).agg(F.min_by("no", first).alias("no")).select("no")
    return rows.join(kept, "no", "left_semi").select("row.*")


def leaks_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without 0.8 or more of a benchmark item's five-word shingles. Rows without an id, or
    with one that others have too, are judged one by one."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = _numbered(docs)
    if rows is None:
        return decontam.without_leaks(docs, items)
    kept = decontam.without_leaks(rows.select(F.col("no").alias("doc_id"), "row.text", "row"), items)
    return kept.select("row.*")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix repeats them."""
    return mixing.mix_documents(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row of the mix in one of 40 shards."""
    return sharding.shard_by_bytes(docs)


STAGES = [("toxicity", toxic_out), ("ngram_join", copies_out), ("decontamination", leaks_out), ("mixing", mixed), ("sharding", shards)]
#: The classifier and crc32 are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
