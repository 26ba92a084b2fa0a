"""The operators as queries over the test tables, next to their SQL where SQL can say it."""

from pyspark.sql import functions as F

from gridspark.llm import ann, balltree, chat, decontam, langid, licenses, mixing, ngram_join, phrases, sharding, suffix, toxicity, urls


def _table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _held_out(modulus: int, remainder: int):
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    return F.coalesce(crc % modulus == remainder, F.lit(False))


def op1_chat_formatting(spark, sf):
    return chat.repair(_table(spark, sf, "conversations"))


def op2_language_id(spark, sf):
    docs = _table(spark, sf, "documents").select("doc_id", "text", "lang")
    held = _held_out(3, 1)
    model = langid.train(docs.filter(~held).select(F.col("doc_id").alias("key"), "text", "lang"))
    out = langid.predict(docs.select("doc_id", "text", held.alias("held_out")), model)
    return out.select("doc_id", "held_out", "lang_pred", "score")


def op3_toxicity(spark, sf):
    docs = _table(spark, sf, "documents")
    held = _held_out(5, 0)
    model = toxicity.fit_documents(docs, _table(spark, sf, "labels"), held)
    out = toxicity.score(docs.select("doc_id", "text", held.alias("held_out")), model)
    return out.select("doc_id", "held_out", "score", "predicted")


def op4_suffix_dedup(spark, sf):
    return suffix.remove_repeats(_table(spark, sf, "documents"))


def op5_license_scan(spark, sf):
    return licenses.scan_licenses(_table(spark, sf, "documents"))


def op6_mixing(spark, sf):
    plan = mixing.plan_mix(_table(spark, sf, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken")


def op7_decontamination(spark, sf):
    return decontam.leaks(_table(spark, sf, "documents"), _table(spark, sf, "benchmark"))


def op8_nearest(spark, sf):
    rows = _table(spark, sf, "embeddings")
    return ann.nearest(rows, rows.filter(F.col("vec_id") % 100 == 0))


def op9_sharding(spark, sf):
    return sharding.shard_by_bytes(_table(spark, sf, "documents"))


def op10_ngram_join(spark, sf):
    return ngram_join.jaccard_components(_table(spark, sf, "documents"))


def op11_url_filters(spark, sf):
    return urls.judge(_table(spark, sf, "pages"), urls.rule_table(spark, urls.RULES))


def op12_ranked_search(spark, sf):
    return balltree.rank(_table(spark, sf, "documents"), _table(spark, sf, "benchmark"))


def op13_phrase_mining(spark, sf):
    return phrases.collocations(_table(spark, sf, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_chat_formatting, op2_language_id, op3_toxicity, op4_suffix_dedup, op5_license_scan, op6_mixing, op7_decontamination,
    op8_nearest, op9_sharding, op10_ngram_join, op11_url_filters, op12_ranked_search,
    op13_phrase_mining)}
ORACLES = {"op6_mixing": mixing.SQL, "op7_decontamination": decontam.SQL,
           "op11_url_filters": urls.SQL, "op12_ranked_search": balltree.SQL, "op13_phrase_mining": phrases.SQL}
