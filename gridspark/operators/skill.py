"""Skill metrics of (label, prediction) pairs: all of them sums, so one aggregate each."""

from pyspark.sql import Column, DataFrame, functions as F

from gridspark.functions.nulls import finite
from gridspark.functions.sizing import stored
from gridspark.operators.aggregates import merged_deviations
from gridspark.operators.time_axis import day_to_month, to_annual


def _pairs(y: str, p: str):
    ok = finite(y) & finite(p)
    return F.when(ok, F.col(y)), F.when(ok, F.col(p))


def r2(y: str = "y", p: str = "yhat", kind: str = "label") -> Column:
    """1 - SSE/SST on present pairs.

    'label' takes the spread of the labels, 'prediction' that of the second series,
    'pearson2' is the squared correlation.
    """
    a, b = _pairs(y, p)
    if kind == "pearson2":
        c = F.corr(a, b)
        return c * c
    ref = a if kind == "label" else b
    sst = F.var_pop(ref) * F.count(ref)
    return F.when(sst > 0, 1 - F.sum((a - b) * (a - b)) / sst)


def rmse(y: str = "y", p: str = "yhat") -> Column:
    a, b = _pairs(y, p)
    return F.sqrt(F.avg((b - a) * (b - a)))


def nrmse(y: str = "y", p: str = "yhat") -> Column:
    """RMSE over the population std of the labels."""
    a, b = _pairs(y, p)
    sd = F.stddev_pop(a)
    return F.when(sd > 0, F.sqrt(F.avg((b - a) * (b - a))) / sd)


def acc(y: str = "y", p: str = "yhat") -> Column:
    """Centred correlation."""
    a, b = _pairs(y, p)
    return F.when((F.stddev_pop(a) > 0) & (F.stddev_pop(b) > 0), F.corr(a, b))


def n_pairs(y: str = "y", p: str = "yhat") -> Column:
    a, _ = _pairs(y, p)
    return F.count(a)


GLOBAL_ROW = "GLOBAL(equal_weight)"


def metric_table(df: DataFrame, y: str = "y", p: str = "yhat", by: str = "variable") -> DataFrame:
    """Metrics per variable after a global row: plain mean of the metrics, sum of n."""
    per = df.groupBy(by).agg(n_pairs(y, p).alias("n"), r2(y, p).alias("R2"),
                             nrmse(y, p).alias("nRMSE"), acc(y, p).alias("ACC"))
    return _with_global(per, by)


def _with_global(per: DataFrame, by: str) -> DataFrame:
    per = stored(per, "metrics")  # a row a variable, read twice
    whole = per.agg(F.sum("n").alias("n"), *[F.avg(m).alias(m) for m in ("R2", "nRMSE", "ACC")])
    top = whole.select(F.lit(GLOBAL_ROW).alias(by), "n", "R2", "nRMSE", "ACC")
    return top.unionByName(per).orderBy(F.col(by) != GLOBAL_ROW, by)


def cell_metrics(df: DataFrame, keys, y: str = "y", p: str = "yhat") -> DataFrame:
    """R2 and RMSE maps."""
    return df.groupBy(*keys).agg(r2(y, p).alias("r2"), rmse(y, p).alias("rmse"))


def taylor_statistics(df: DataFrame, keys, y: str = "y", p: str = "yhat") -> DataFrame:
    """Relative standard deviation, correlation and its angle."""
    a, b = _pairs(y, p)
    d = df.groupBy(*keys).agg(F.stddev_samp(a).alias("ref_std"), F.stddev_samp(b).alias("std"),
                              F.corr(a, b).alias("corr"))
    return d.withColumns({"rel_std": F.try_divide("std", "ref_std"),
                          "theta": F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("corr"))))})


def pair_moments(df: DataFrame, keys, y: str = "y", p: str = "yhat") -> DataFrame:
    """All that the metrics need of a shard: n, means, squared deviations and their product, squared error."""
    a, b = _pairs(y, p)
    n = F.count(a)
    return df.groupBy(*keys).agg(
        n.alias("n"), F.avg(a).alias("mean_y"), F.avg(b).alias("mean_p"), (F.var_pop(a) * n).alias("m2_y"), (F.var_pop(b) * n).alias("m2_p"),
        (F.covar_pop(a, b) * n).alias("c"), F.sum((a - b) * (a - b)).alias("sse"))


def merge_pair_moments(shards: DataFrame, keys) -> DataFrame:
    """The pair moments of all rows from those of any shards of them, met pairwise about their means;
    a key without pairs has n = 0."""
    shard = F.struct(F.col("n").cast("double").alias("n"), F.array("mean_y", "mean_p").alias("mean"), F.array("m2_y", "m2_p").alias("m2"), "c")
    d = shards.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("sse").alias("sse"), merged_deviations(F.when(F.col("n") > 0, shard)).alias("__m"))
    m = lambda name, i: F.get(F.col(f"__m.{name}"), F.lit(i))
    return d.select(*keys, "n", m("mean", 0).alias("mean_y"), m("mean", 1).alias("mean_p"), m("m2", 0).alias("m2_y"), m("m2", 1).alias("m2_p"),
                    F.col("__m.c").alias("c"), "sse")


def skill_of_moments(m: DataFrame, keys) -> DataFrame:
    """Every metric of this module from pair moments: n, r2 (three kinds), rmse, nrmse, acc and the Taylor statistics."""
    n, sse = F.col("n"), F.col("sse")
    spread = (F.col("m2_y") > 0) & (F.col("m2_p") > 0)
    corr = F.when(spread, F.col("c") / F.sqrt(F.col("m2_y")) / F.sqrt(F.col("m2_p")))
    samples = lambda c: F.when(n > 1, F.sqrt(F.col(c) / (n - 1)))
    rmse_ = F.sqrt(F.try_divide(sse, n))
    d = m.select(*keys, n, F.when(F.col("m2_y") > 0, 1 - sse / F.col("m2_y")).alias("r2"), F.when(F.col("m2_p") > 0, 1 - sse / F.col("m2_p")).alias("r2_prediction"),
                 (corr * corr).alias("r2_pearson"), rmse_.alias("rmse"), F.when(F.col("m2_y") > 0, rmse_ / F.sqrt(F.col("m2_y") / n)).alias("nrmse"), corr.alias("acc"),
                 samples("m2_y").alias("ref_std"), samples("m2_p").alias("std"))
    return d.withColumns({"rel_std": F.try_divide("std", "ref_std"), "theta": F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("acc"))))})


def metric_table_of_moments(m: DataFrame, by: str = "variable") -> DataFrame:
    """:func:`metric_table` from merged pair moments."""
    per = skill_of_moments(m, [by]).select(by, "n", F.col("r2").alias("R2"), F.col("nrmse").alias("nRMSE"), F.col("acc").alias("ACC"))
    return _with_global(per, by)


TOTAL_ROW = "TOTAL"


def supervised_score(daily: DataFrame, labels_monthly: DataFrame, labels_annual: DataFrame, keys,
                     weights: dict[str, float] | None = None, loss: str = "mse") -> DataFrame:
    """Loss per variable of daily predictions pooled to the resolution of the labels, with
    its weight, and the row TOTAL whose ``weighted`` is the sum of weight * loss."""
    def score(pooled, labels, on):
        d = pooled.join(labels.select(*on, F.col("value").alias("label")), on)
        e = F.col("value") - F.col("label")
        return d.groupBy("variable").agg(F.avg(e * e if loss == "mse" else F.abs(e)).alias("loss"))

    monthly = score(day_to_month(daily, ["variable", *keys]), labels_monthly, ["variable", *keys, "year", "month"])
    annual = score(to_annual(daily, ["variable", *keys]), labels_annual, ["variable", *keys, "year"])
    d = monthly.unionByName(annual)
    if weights:
        m = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))])
        w = F.coalesce(F.try_element_at(m, F.col("variable")), F.lit(1.0))
    else:
        w = F.lit(1.0)
    d = d.withColumn("weight", w).withColumn("weighted", F.col("weight") * F.col("loss"))
    whole = F.grouping("variable") == 1  # one pass gives the variables and their sum
    d = d.rollup("variable").agg(F.first("loss").alias("__l"), F.first("weight").alias("__w"), F.sum("weighted").alias("weighted"), whole.alias("__all"))
    return d.select(F.when(F.col("__all"), TOTAL_ROW).otherwise(F.col("variable")).alias("variable"),
                    F.when(~F.col("__all"), F.col("__l")).alias("loss"), F.when(~F.col("__all"), F.col("__w")).alias("weight"), "weighted")


def loss_rollup(df: DataFrame, keys, loss: str = "loss", n: str = "n") -> DataFrame:
    """Count-weighted mean loss over shards."""
    agg = F.try_divide(F.sum(F.col(loss) * F.col(n)), F.sum(n)).alias(loss)
    return df.groupBy(*keys).agg(agg, F.sum(n).alias(n)) if keys else df.agg(agg, F.sum(n).alias(n))


# Label variables whose gaps do not drop a batch-year.
IGNORED_GAPS = ("lai_avh15c1", "lai_modis")


def complete_label_years(labels: DataFrame, keys, ignore=IGNORED_GAPS, value: str = "value") -> DataFrame:
    """Keys and years whose labels are all present, apart from ignored variables."""
    ok = finite(value) | F.col("variable").isin(*ignore)
    return labels.groupBy(*keys, "year").agg(F.bool_and(ok).alias("__ok")).filter("__ok").drop("__ok")
