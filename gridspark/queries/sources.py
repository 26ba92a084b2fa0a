"""Sources and sinks. A query that stores something writes below the shared scratch folder."""

from pyspark.sql import functions as F

from gridspark.operators import aggregates as ag, cleaning as cl
from gridspark.queries.registry import query, rounded
from gridspark.session import scratch_path
from gridspark.sources import adapters as ad, catalog as ct, fields as fd, text as tx

_VY = ("source", "cell", "year")
VY = ["variable", "source", "lat_idx", "lon_idx", "year"]


def _stored(spark, sf, name):
    """The yearly field of four variables, stored in the partitioned layout."""
    f = ad.field_vars(spark, sf, "source", "scenario", "cell", "year")
    path = scratch_path(spark, name)
    fd.write_field(f, path)
    return path


_SVY = "variable, source, scenario, lat_idx, lon_idx, year"


@query("s01_read_field", f"""
WITH {ad.field_vars_sql("source", "scenario", "cell", "year")}
SELECT {_SVY}, round(value, 6) AS value FROM field WHERE variable IN ('gpp', 'ra') AND scenario IN ('S1', 'S3') AND year BETWEEN 1996 AND 1999""")
def read_field(spark, sf):
    path = _stored(spark, sf, "s01")
    d = fd.read_field(spark, path, ["gpp", "ra"], ["S1", "S3"], (1996, 1999))
    return rounded(d.select(*_SVY.split(", "), "value"), "value")


@query("s02_select_variables", f"""
WITH {ad.field_vars_sql(*_VY)} SELECT variable, year, round(avg(value), 6) AS value FROM field WHERE variable IN ('gpp', 'rh') GROUP BY ALL""")
def select_variables(spark, sf):
    d = cl.select_variables(ad.field_vars(spark, sf, *_VY), ["gpp", "rh"])
    return rounded(d.groupBy("variable", "year").agg(F.avg("value").alias("value")), "value")


@query("s02_absent_variables", """
WITH p AS (SELECT DISTINCT event_type AS v FROM events), w AS (SELECT unnest(['click', 'lai', 'mrso']) AS variable)
SELECT variable, (SELECT string_agg(v, ',' ORDER BY v) FROM p) AS available FROM w WHERE variable NOT IN (SELECT v FROM p)""")
def absent_variables(spark, sf):
    e = ad.table(spark, sf, "events")
    d = cl.absent_variables(e, ["click", "lai", "mrso"], name="event_type")
    return d.select("variable", F.array_join("available", ",").alias("available"))


@query("s03_resolve_catalog", f"""
WITH {ad.CATALOG_SQL}, r AS (SELECT model, scenario, CASE variable WHEN 'F' THEN 'cTotal' WHEN 'O' THEN 'cTotal' ELSE variable END AS variable,
  CASE variable WHEN 'O' THEN 1 ELSE 0 END AS rnk, path FROM catalog),
g AS (SELECT model, scenario, variable, rnk, min(path) AS path, count(*) AS n_paths FROM r GROUP BY ALL)
SELECT model, scenario, variable, path, n_paths FROM g QUALIFY rnk = min(rnk) OVER (PARTITION BY model, scenario, variable)""")
def resolve_catalog(spark, sf):
    aliases = {"F": ("cTotal", 0), "O": ("cTotal", 1)}
    return ct.resolve_catalog(ad.catalog(spark, sf), ["model", "scenario", "variable"], aliases, strict=False)


@query("s04_filter_catalog", f"""
WITH {ad.CATALOG_SQL} SELECT model, scenario, variable, o_orderkey FROM catalog
WHERE model IN ('model_1', 'model_4') AND variable = 'F'""")
def filter_catalog(spark, sf):
    d = ct.filter_catalog(ad.catalog(spark, sf), model=["model_1", "model_4"], scenario=None, variable="F")
    return d.select("model", "scenario", "variable", "o_orderkey")


_FILES = """files AS (SELECT DISTINCT 'tmp_' || CAST(o_custkey % 50 AS VARCHAR) || '_' || CAST(year(o_orderdate) AS VARCHAR) ||
  CASE WHEN o_custkey % 3 = 0 THEN '-' || CAST(year(o_orderdate) + 2 AS VARCHAR) ELSE '' END || '.nc' AS path,
  CAST(year(o_orderdate) AS INT) AS start_year, CAST(year(o_orderdate) + CASE WHEN o_custkey % 3 = 0 THEN 2 ELSE 0 END AS INT) AS end_year FROM orders)"""


@query("s05_prune_by_year", f"WITH {_FILES} SELECT path, start_year, end_year FROM files WHERE end_year >= 1997 AND start_year <= 1998")
def prune_by_year(spark, sf):
    y = F.year("o_orderdate")
    span = F.when(F.pmod("o_custkey", F.lit(3)) == 0, F.concat(F.lit("-"), (y + 2).cast("string"))).otherwise("")
    files = ad.table(spark, sf, "orders").select(F.concat(
        F.lit("tmp_"), F.pmod("o_custkey", F.lit(50)).cast("string"), F.lit("_"), y.cast("string"), span, F.lit(".nc")).alias("path")).distinct()
    return ct.prune_by_year(files, 1997, 1998)


@query("s06_year_from_name", f"""
WITH {ad.CATALOG_SQL} SELECT CAST(regexp_extract(path, '[0-9]{{4}}') AS INT) AS file_year, count(*) AS n FROM catalog GROUP BY 1""")
def year_from_name(spark, sf):
    return ad.catalog(spark, sf).groupBy(ct.year_from_name("path").alias("file_year")).agg(F.count(F.lit(1)).alias("n"))


@query("s07_scenario_from_name", f"""
WITH {ad.CATALOG_SQL} SELECT coalesce(nullif(regexp_extract(path, 'S[0-3]'), ''), 'misc') AS file_scenario, count(*) AS n FROM catalog GROUP BY 1""")
def scenario_from_name(spark, sf):
    return ad.catalog(spark, sf).groupBy(ct.scenario_from_name("path").alias("file_scenario")).agg(F.count(F.lit(1)).alias("n"))


@query("s08_route_sources", """
WITH v AS (SELECT 'S' || CAST(l_linenumber % 4 AS VARCHAR) AS scenario,
  CASE l_returnflag WHEN 'A' THEN 'tmp' WHEN 'N' THEN 'primf' ELSE CASE WHEN l_linestatus = 'F' THEN 'co2' ELSE 'lai' END END AS variable FROM lineitem)
SELECT scenario, variable, CASE WHEN (scenario = 'S0' AND variable IN ('tmp', 'primf', 'co2')) OR (scenario = 'S1' AND variable IN ('tmp', 'primf'))
  OR (scenario = 'S2' AND variable = 'primf') THEN 'preindustrial' ELSE 'historical' END AS origin, count(*) AS n FROM v GROUP BY ALL""")
def route_sources(spark, sf):
    v = (F.when(F.col("l_returnflag") == "A", "tmp").when(F.col("l_returnflag") == "N", "primf")
         .when(F.col("l_linestatus") == "F", "co2").otherwise("lai"))
    d = ad.table(spark, sf, "lineitem").select(
        F.concat(F.lit("S"), F.pmod("l_linenumber", F.lit(4)).cast("string")).alias("scenario"), v.alias("variable"))
    return ct.route_sources(d).groupBy("scenario", "variable", "origin").agg(F.count(F.lit(1)).alias("n"))


@query("s09_annual_series_to_cells", f"""
WITH {ad.CELLS_SQL}, s AS (SELECT CAST(year(o_orderdate) AS INT) AS year, sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS v FROM orders GROUP BY 1),
k AS (SELECT year, CAST(v AS DOUBLE) AS value FROM s ORDER BY year DESC LIMIT 5)
SELECT lat_idx, lon_idx, year, k.value FROM cells, k""")
def annual_series_to_cells(spark, sf):
    s = ad.table(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("v"))
    lines = s.select(F.concat_ws("   ", F.col("year").cast("string"), F.col("v").cast("string")).alias("value"))
    header = lines.limit(1).select(F.lit("year ppm").alias("value"))
    path = scratch_path(spark, "s09")
    lines.unionByName(header).write.text(path)
    series = tx.read_annual_series(spark, path, keep=5)
    return tx.series_to_cells(series, ad.cells(spark, sf).select("lat_idx", "lon_idx"))


@query("s10_year_blocks", """
WITH y AS (SELECT DISTINCT o_orderpriority AS source, CAST(year(o_orderdate) AS INT) AS year FROM orders WHERE year(o_orderdate) <> 1996),
i AS (SELECT *, year - row_number() OVER (PARTITION BY source ORDER BY year) AS isl FROM y),
p AS (SELECT *, (row_number() OVER (PARTITION BY source, isl ORDER BY year) - 1) // 2 AS part FROM i)
SELECT source, year, min(year) OVER w AS block_start, max(year) OVER w AS block_end FROM p WINDOW w AS (PARTITION BY source, isl, part)""")
def year_blocks(spark, sf):
    y = ad.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("source"), F.year("o_orderdate").alias("year")).distinct()
    return ct.year_blocks(y.filter("year <> 1996"), ["source"], 2)


@query("s11_write_field", f"""
WITH {ad.field_vars_sql("source", "scenario", "cell", "year")} SELECT variable, scenario, count(*) AS n, round(avg(value), 6) AS value FROM field GROUP BY ALL""")
def write_field(spark, sf):
    d = fd.read_field(spark, _stored(spark, sf, "s11"))
    return rounded(d.groupBy("variable", "scenario").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("value")), "value")


@query("s12_materialise", f"""
WITH {ad.field_sql("source", "year", "month")} SELECT source, year, month, round(value, 6) AS value FROM field""")
def materialise(spark, sf):
    return rounded(fd.materialise(ad.field(spark, sf, "source", "year", "month"), scratch_path(spark, "s12")), "value")


_EXPORT_NAMES = "CASE variable WHEN 'gpp' THEN 'lai_modis' WHEN 'ra' THEN 'lai_avh15c1' WHEN 'rh' THEN 'cTotal_monthly' ELSE variable END"


@query("s13_export_sets", f"""
WITH {ad.field_vars_sql("source", "cell", "year", "month")}, e AS (SELECT {_EXPORT_NAMES} AS v0, source, lat_idx, lon_idx, CAST(1901 + (year - 1995) * 20 AS INT) AS year, month, value FROM field),
r AS (SELECT CASE v0 WHEN 'lai_avh15c1' THEN 'lai' WHEN 'cTotal_monthly' THEN 'cTotal' ELSE v0 END AS variable, * FROM e WHERE v0 <> 'lai_modis'),
k AS (SELECT variable, year, month, CASE WHEN variable = 'cTotal' THEN avg(value) OVER (PARTITION BY variable, source, lat_idx, lon_idx, year) ELSE value END AS value FROM r)
SELECT variable, period, month, count(*) AS n, round(avg(value), 6) AS value FROM (
  SELECT variable, 'full' AS period, month, value FROM k UNION ALL SELECT variable, 'early', month, value FROM k WHERE year BETWEEN 1901 AND 1918
  UNION ALL SELECT variable, 'late', month, value FROM k WHERE year BETWEEN 2018 AND 2023) GROUP BY ALL""")
def export_sets(spark, sf):
    f = cl.rename_variables(ad.field_vars(spark, sf, "source", "cell", "year", "month"),
                            {"gpp": "lai_modis", "ra": "lai_avh15c1", "rh": "cTotal_monthly"})
    f = f.withColumn("year", (1901 + (F.col("year") - 1995) * 20).cast("int"))
    path = scratch_path(spark, "s13")
    fd.write_export(f, path)
    d = spark.read.parquet(path)
    return rounded(d.groupBy("variable", "period", "month").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("value")), "value")


@query("s14_report_csv", f"""
WITH {ad.field_sql("source", "year")}
SELECT year, round(max(CASE WHEN source = 'M0' THEN value END), 6) AS M0, round(max(CASE WHEN source = 'M1' THEN value END), 6) AS M1,
  round(max(CASE WHEN source = 'M2' THEN value END), 6) AS M2, round(max(CASE WHEN source = 'M3' THEN value END), 6) AS M3 FROM field GROUP BY year""")
def report_csv(spark, sf):
    models = ["M0", "M1", "M2", "M3"]
    wide = ag.report_table(ad.field(spark, sf, "source", "year"), "year", "source", models)
    path = scratch_path(spark, "s14")
    fd.write_report_csv(rounded(wide, *models), path)
    return spark.read.csv(path, header=True, schema="year int, M0 double, M1 double, M2 double, M3 double")


@query("s15_upsert_variable", f"""
WITH {ad.field_vars_sql("source", "scenario", "cell", "year")}, u AS (SELECT CASE WHEN variable = 'gpp' THEN value * 2 ELSE value END AS value, variable, scenario FROM field
  UNION ALL SELECT value * 0, 'fLuc', scenario FROM field WHERE variable = 'gpp')
SELECT variable, scenario, count(*) AS n, round(avg(value), 6) AS value FROM u GROUP BY ALL""")
def upsert_variable(spark, sf):
    path = _stored(spark, sf, "s15")
    gpp = ad.field_vars(spark, sf, "source", "scenario", "cell", "year", variables=("gpp",))
    fd.upsert_variable(gpp.withColumn("value", F.col("value") * 2).unionByName(cl.zero_like(gpp, "fLuc")), path)
    d = spark.read.parquet(path)
    return rounded(d.groupBy("variable", "scenario").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("value")), "value")
