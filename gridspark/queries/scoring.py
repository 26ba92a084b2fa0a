"""Score tables, log text and JSON statistics."""

from pyspark.sql import functions as F

from gridspark.operators import aggregates as ag, scores as sc
from gridspark.queries.registry import query, rounded
from gridspark.sources import adapters as ad

_NATION = "scores AS (SELECT n_name AS variable, c_mktsegment AS model, CASE WHEN avg(c_acctbal) < 4000 THEN '--' WHEN max(c_acctbal) > 9950 THEN '~' ELSE CAST(count(*) AS VARCHAR) END AS score FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)"
_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def _nation_scores(spark, sf):
    c, n = ad.table(spark, sf, "customer"), ad.table(spark, sf, "nation")
    d = c.join(n, c.c_nationkey == n.n_nationkey).groupBy(F.col("n_name").alias("variable"), F.col("c_mktsegment").alias("model"))
    return d.agg(F.when(F.avg("c_acctbal") < 4000, "--").when(F.max("c_acctbal") > 9950, "~")
                 .otherwise(F.count(F.lit(1)).cast("string")).alias("score"))


@query("x01_score_matrix", f"""
WITH {_NATION}, s AS (SELECT variable, model, CASE WHEN score NOT IN ('--', '~') THEN CAST(score AS DOUBLE) END AS s FROM scores)
SELECT variable, {", ".join(f"max(CASE WHEN model = '{m}' THEN s END) AS {m}" for m in _SEGMENTS)}, round(avg(s), 6) AS average FROM s GROUP BY variable""")
def score_matrix(spark, sf):
    return rounded(sc.score_matrix(_nation_scores(spark, sf), "variable", "model", _SEGMENTS, "score"), "average")


@query("x02_model_delta", """
WITH s AS (SELECT o_orderpriority AS variable, 'm' || CAST(o_custkey % 2 AS VARCHAR) AS model, o_orderstatus AS scalar_name, avg(o_totalprice / 365.2425) AS data FROM orders GROUP BY ALL)
SELECT variable, round(max(CASE WHEN model = 'm1' AND scalar_name = 'F' THEN data END) - max(CASE WHEN model = 'm0' AND scalar_name = 'F' THEN data END), 6) AS delta_spatial,
  round(max(CASE WHEN model = 'm1' AND scalar_name = 'O' THEN data END) - max(CASE WHEN model = 'm0' AND scalar_name = 'O' THEN data END), 6) AS delta_overall FROM s GROUP BY variable""")
def model_delta(spark, sf):
    s = ad.table(spark, sf, "orders").groupBy(
        F.col("o_orderpriority").alias("variable"), F.concat(F.lit("m"), F.pmod("o_custkey", F.lit(2)).cast("string")).alias("model"),
        F.col("o_orderstatus").alias("scalar_name")).agg(F.avg(F.col("o_totalprice") / 365.2425).alias("data"))
    return rounded(sc.model_delta(s, "m0", "m1", {"F": "delta_spatial", "O": "delta_overall"}), "delta_spatial", "delta_overall")


# Score rows from orders: the status is the experiment, the priority the region.
_EXPERIMENTS = """
e AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'co2' WHEN 'O' THEN 'pre' ELSE 'tmp' END AS experiment,
  CASE WHEN o_orderkey % 7 = 0 THEN 'unparsed' WHEN o_orderstatus = 'P' THEN 'tmp_' || CAST(o_custkey % 11 - 5 AS VARCHAR) ELSE 'run_' || CASE WHEN o_custkey % 2 = 0 THEN '+' ELSE '-' END || CAST(o_custkey % 100 AS VARCHAR) || 'pct' END AS model,
  CASE o_custkey % 5 WHEN 0 THEN 'Benchmark Period Mean (intersection)' WHEN 1 THEN 'Bias' ELSE 'Model Period Mean (intersection)' END AS scalar_name,
  'v' || CAST(o_custkey % 3 AS VARCHAR) AS variable, o_orderpriority AS region, o_totalprice AS data, o_custkey FROM orders)"""


def _experiments(spark, sf):
    k, c, s = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderstatus")
    mod = lambda x, n: F.pmod(x, F.lit(n))
    model = (F.when(mod(k, 7) == 0, "unparsed").when(s == "P", F.concat(F.lit("tmp_"), (mod(c, 11) - 5).cast("string")))
             .otherwise(F.concat(F.lit("run_"), F.when(mod(c, 2) == 0, "+").otherwise("-"), mod(c, 100).cast("string"), F.lit("pct"))))
    scalar = (F.when(mod(c, 5) == 0, "Benchmark Period Mean (intersection)").when(mod(c, 5) == 1, "Bias")
              .otherwise("Model Period Mean (intersection)"))
    return ad.table(spark, sf, "orders").select(
        k, F.when(s == "F", "co2").when(s == "O", "pre").otherwise("tmp").alias("experiment"), model.alias("model"),
        scalar.alias("scalar_name"), F.concat(F.lit("v"), mod(c, 3).cast("string")).alias("variable"),
        F.col("o_orderpriority").alias("region"), F.col("o_totalprice").alias("data"))


@query("x03_counterfactual_table", f"""
WITH {_EXPERIMENTS}, k AS (SELECT *, CASE scalar_name WHEN 'Benchmark Period Mean (intersection)' THEN 'Benchmark' ELSE 'Model' END AS type FROM e WHERE scalar_name <> 'Bias'),
u AS (SELECT * FROM k WHERE type = 'Model' UNION ALL (SELECT * FROM k WHERE type = 'Benchmark' QUALIFY row_number() OVER (PARTITION BY variable, region ORDER BY o_orderkey) = 1)),
p AS (SELECT *, TRY_CAST(nullif(regexp_extract(model, '([-+]?[0-9]+)pct$', 1), '') AS INT) AS pct, TRY_CAST(nullif(regexp_extract(model, 'tmp_([-+]?[0-9]+)$', 1), '') AS INT) AS tmp FROM u),
x AS (SELECT o_orderkey, experiment, type, variable, region, data, CASE WHEN type = 'Benchmark' THEN 0.0 WHEN experiment = 'co2' THEN 300.0 * (1 + pct / 100.0) WHEN experiment = 'pre' THEN -abs(pct) WHEN experiment = 'tmp' THEN 285.5 - 273.15 + tmp END AS x FROM p)
SELECT o_orderkey, experiment, type, variable, region, data, round(x, 6) + 0.0 AS x FROM x WHERE x IS NOT NULL""")
def counterfactual_table(spark, sf):
    d = sc.counterfactual_table(_experiments(spark, sf), 285.5, order_col="o_orderkey")
    d = d.withColumn("x", F.round("x", 6) + 0.0)
    return d.select("o_orderkey", "experiment", "type", "variable", "region", "data", "x")


_LABELS = ", ".join(f"('{k}', '{v}')" for k, v in sc.LABEL_TO_KEY.items())


@query("x04_resolve_labels", f"""
WITH m AS (SELECT * FROM (VALUES {_LABELS}) v(label, key)),
t AS (SELECT CASE o_custkey % 5 WHEN 0 THEN 'GPP' WHEN 1 THEN 'FireEmissions' WHEN 2 THEN 'cveg' WHEN 3 THEN 'Luc' ELSE o_orderstatus END AS token, count(*) AS n FROM orders GROUP BY 1),
k AS (SELECT DISTINCT CASE o_orderpriority WHEN '5-LOW' THEN 'GrossPrimaryProduction' WHEN '1-URGENT' THEN 'FireEmissions' WHEN '2-HIGH' THEN 'CarboninVegetation' ELSE 'F' END AS variable FROM orders)
SELECT token, n, coalesce((SELECT variable FROM k WHERE variable = token), (SELECT max(k.variable) FROM k JOIN m ON m.label = k.variable WHERE lower(m.key) = lower(token))) AS label FROM t""")
def resolve_labels(spark, sf):
    o = ad.table(spark, sf, "orders")
    c = F.pmod("o_custkey", F.lit(5))
    token = F.when(c == 0, "GPP").when(c == 1, "FireEmissions").when(c == 2, "cveg").when(c == 3, "Luc").otherwise(F.col("o_orderstatus"))
    tokens = o.groupBy(token.alias("token")).agg(F.count(F.lit(1)).alias("n"))
    p = F.col("o_orderpriority")
    known = o.select(F.when(p == "5-LOW", "GrossPrimaryProduction").when(p == "1-URGENT", "FireEmissions")
                     .when(p == "2-HIGH", "CarboninVegetation").otherwise("F").alias("variable"))
    return sc.resolve_labels(tokens, known)


_N = r"[-+]?[\d.]+(?:e[-+]?\d+)?"
_LOG = ad.LOG_SQL + f""",
p AS (SELECT file, line_no,
  TRY_CAST(nullif(regexp_extract(line, 'batches per GPU — train=(\\d+),', 1), '') AS INT) AS spe,
  TRY_CAST(nullif(regexp_extract(line, '\\[Epoch (\\d+)/', 1), '') AS INT) AS ep,
  TRY_CAST(nullif(regexp_extract(line, 'Progress — epoch (\\d+)/', 1), '') AS INT) AS pe,
  TRY_CAST(nullif(regexp_extract(line, 'Progress .*batch (\\d+)/', 1), '') AS INT) AS pb,
  TRY_CAST(nullif(regexp_extract(line, 'avg_batch_loss=({_N})', 1), '') AS DOUBLE) AS bl,
  TRY_CAST(nullif(regexp_extract(line, 'Validation @ batch (\\d+)', 1), '') AS INT) AS vb,
  TRY_CAST(nullif(regexp_extract(line, '^\\[(?:Validation @ batch \\d+|Pre-flight validation)\\] avg_loss=({_N})', 1), '') AS DOUBLE) AS vl,
  line LIKE '[Pre-flight%' AS pre, line LIKE '%Epoch average%' AS summ, line FROM lines),
h AS (SELECT file, arg_min(spe, line_no) FILTER (spe IS NOT NULL) AS spe1, min(line_no) FILTER (spe IS NOT NULL) AS spe_at, arg_min(ep, line_no) FILTER (ep IS NOT NULL) AS base FROM p GROUP BY file),
f AS (SELECT p.*, h.spe1, h.spe_at, h.base, last_value(ep IGNORE NULLS) OVER (PARTITION BY p.file ORDER BY line_no) AS cur FROM p JOIN h ON h.file = p.file)"""


@query("x05_training_log_batches", f"""
WITH {_LOG}
SELECT file, line_no, 'batch' AS kind, coalesce(pe, cur) AS epoch, coalesce(pb, 1) AS batch, CAST((coalesce(pe, cur) - base) * spe1 + coalesce(pb, 1) AS INT) AS step, bl AS loss, NULL AS val_loss FROM f
WHERE bl IS NOT NULL AND (pe IS NOT NULL OR (spe_at <= line_no AND cur IS NOT NULL))
UNION ALL SELECT file, line_no, 'probe', coalesce(cur, base, 1), vb, CAST((coalesce(cur, base, 1) - base) * spe1 + least(vb, spe1) AS INT), NULL, vl FROM f WHERE vb IS NOT NULL
UNION ALL SELECT file, line_no, 'preflight', NULL, NULL, 0, NULL, vl FROM f WHERE pre""")
def training_log_batches(spark, sf):
    ev = sc.parse_log(ad.log_lines(spark, sf))
    return ev.filter("kind <> 'summary'").select("file", "line_no", "kind", "epoch", "batch", "step", "loss", "val_loss")


@query("x05_training_log_epochs", f"""
WITH {_LOG}, s AS (SELECT file, line_no, base, spe1, regexp_extract(line, '^(.*),123', 1) || ',123' AS ts, CAST(regexp_extract(line, 'train loss=({_N})', 1) AS DOUBLE) AS train_loss, CAST(regexp_extract(line, 'val loss=({_N})', 1) AS DOUBLE) AS val_loss FROM f WHERE summ)
SELECT file, CAST(base + row_number() OVER (PARTITION BY file ORDER BY line_no) - 1 AS INT) AS epoch, ts, train_loss, val_loss, 7 AS val_cnt, CAST(row_number() OVER (PARTITION BY file ORDER BY line_no) * spe1 AS INT) AS val_step FROM s""")
def training_log_epochs(spark, sf):
    return sc.epoch_table(sc.parse_log(ad.log_lines(spark, sf)))


@query("x06_stats_json", """
WITH p AS (SELECT l_returnflag AS variable, l_extendedprice / 365.2425 AS v FROM lineitem)
SELECT variable, count(*) AS n, round(sum(v), 3) AS sum, round(avg(v), 6) AS mean, round(min(v), 6) AS min, round(max(v), 6) AS max FROM p GROUP BY ALL""")
def stats_json(spark, sf):
    """Shard moments written as JSON maps, some texts broken, read back and merged."""
    d = ad.table(spark, sf, "lineitem").select("l_suppkey", F.col("l_returnflag").alias("variable"), (F.col("l_extendedprice") / 365.2425).alias("value"))
    m = ag.moments(d, ["l_suppkey", "variable"]).withColumnRenamed("n", "count")
    entry = F.struct("count", "sum", "sumsq", "min", "max")
    j = m.groupBy("l_suppkey").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("variable", entry)))).alias("json"))
    broken = j.select("l_suppkey", F.lit('{"A": {"count": 3, "sum"').alias("json"))
    empty = j.select("l_suppkey", F.lit('{"A": {"count": 0, "sum": 0.0}, "Z": null}').alias("json"))
    rows = sc.parse_stats_json(j.unionByName(broken).unionByName(empty), keys=["l_suppkey"])
    out = ag.merge_moments(rows).select("variable", "n", "sum", "mean", "min", "max")
    return rounded(rounded(out, "sum", n=3), "mean", "min", "max")


@query("x06_event_properties", """
SELECT event_type, 'k' AS name, count(*) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS INT)) AS BIGINT) AS total FROM events GROUP BY event_type""")
def event_properties(spark, sf):
    d = ad.table(spark, sf, "events").select("event_type", F.explode(F.from_json("props", "map<string,int>")).alias("name", "v"))
    return d.groupBy("event_type", "name").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"))
