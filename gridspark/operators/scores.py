"""Score tables, log text and JSON statistics."""

import re

from pyspark.sql import DataFrame, Window as W, functions as F

from gridspark.functions.sizing import broadcast_counted, stored

# Markers of a missing score.
MISSING_SCORES = ("--", "~")


def numeric_score(c):
    """Text score to number; '--' and '~' are missing."""
    c = F.trim(F.col(c) if isinstance(c, str) else c)
    return F.when(~c.isin(*MISSING_SCORES), c.try_cast("double"))


def score_matrix(df: DataFrame, rows: str, columns: str, values, score: str) -> DataFrame:
    """Rows x columns of scores and the mean over the present ones."""
    d = df.withColumn("__s", numeric_score(score))
    wide = d.groupBy(rows).pivot(columns, list(values)).agg(F.first("__s", ignorenulls=True))
    mean = d.filter(F.col(columns).isin(*values)).groupBy(rows).agg(F.avg("__s").alias("average"))
    return wide.join(mean, rows, "left")


def model_delta(df: DataFrame, base: str, other: str, scalars: dict[str, str], row: str = "variable",
                model: str = "model", scalar: str = "scalar_name", value: str = "data") -> DataFrame:
    """other - base of every listed scalar per row; ``scalars`` names the output columns."""
    def mean(m, s):
        return F.avg(F.when((F.col(model) == m) & (F.col(scalar) == s), F.col(value)))
    return df.groupBy(row).agg(*[(mean(other, s) - mean(base, s)).alias(out) for s, out in scalars.items()])


# Scalars kept in the counterfactual table, CO2 baseline, kelvin offset.
KEPT_SCALARS = {"Benchmark Period Mean (intersection)": "Benchmark",
                "Model Period Mean (intersection)": "Model"}
CO2_BASELINE_PPM = 300.0
KELVIN = 273.15
EXPERIMENT_ORDER = ("tmp", "co2", "pre")


def counterfactual_table(df: DataFrame, mean_temperature_k: float | None, order_col: str | None = None) -> DataFrame:
    """Score rows of offset experiments on an absolute axis ``x``.

    Input columns: experiment, model, scalar_name, variable, region, data. CO2 offsets
    become ppm, precipitation offsets drier percentages, temperature offsets degrees C
    around the mean, or stay bare without one; benchmarks sit at 0, once per (variable,
    region), the first experiment of EXPERIMENT_ORDER before others; rows that do not parse go away.
    """
    kinds = F.create_map(*[F.lit(x) for kv in KEPT_SCALARS.items() for x in kv])
    d = df.filter(F.col("scalar_name").isin(*KEPT_SCALARS))
    d = d.withColumn("type", F.try_element_at(kinds, F.col("scalar_name")))
    rank = F.lit(len(EXPERIMENT_ORDER))
    for i, name in enumerate(EXPERIMENT_ORDER):
        rank = F.when(F.col("experiment") == name, i).otherwise(rank)
    d = first_of_flagged(d, ["variable", "region"], F.col("type") == "Benchmark",
                         [order_col] if order_col else [rank, "experiment", "model", "data"])
    pct = F.nullif(F.regexp_extract("model", r"([-+]?\d+)pct$", 1), F.lit("")).cast("int")
    tmp = F.nullif(F.regexp_extract("model", r"tmp_([-+]?\d+)$", 1), F.lit("")).cast("double")
    x = (F.when(F.col("type") == "Benchmark", 0.0)
         .when((F.col("experiment") == "co2") & pct.isNotNull(), CO2_BASELINE_PPM * (1 + pct / 100))
         .when((F.col("experiment") == "pre") & pct.isNotNull(), -F.abs(pct).cast("double"))
         .when((F.col("experiment") == "tmp") & tmp.isNotNull(), (0.0 if mean_temperature_k is None else mean_temperature_k - KELVIN) + tmp)
         .otherwise(F.col("model").try_cast("double")))
    return d.withColumn("x", x).filter(F.col("x").isNotNull())


def first_of_flagged(df: DataFrame, keys, flag, order) -> DataFrame:
    """Keep one row per key among flagged rows, and all other rows.

    The first row per key comes from an aggregate, so a hot key is combined map-side.
    """
    flagged = df.filter(flag)
    cols = F.struct(*df.columns)
    best = (flagged.groupBy(*keys).agg(F.min_by(cols, F.struct(*order)).alias("__r"))
            .select("__r.*"))
    return df.filter(~F.coalesce(flag, F.lit(False))).unionByName(best.select(*df.columns))


# Long variable label -> internal key.
LABEL_TO_KEY = {
    "GrossPrimaryProduction": "gpp", "NetPrimaryProduction": "npp", "AutotrophicRespiration": "ra",
    "HeterotrophicRespiration": "rh", "NetBiomeProductivity": "nbp", "FireEmissions": "fire",
    "Land-UseChangeEmissions": "luc", "CarboninVegetation": "cVeg", "CarboninSoilPool": "cSoil",
    "CarboninLitterPool": "cLitter", "CarboninEcosystem": "cTotal", "LeafAreaIndex": "lai",
    "Evapotranspiration": "evap", "TotalSoilMoistureContent": "mrso", "TotalRunoff": "mrro",
}


def resolve_labels(tokens: DataFrame, known: DataFrame, token: str = "token", label: str = "variable",
                   mapping=None) -> DataFrame:
    """Label of each token: itself when known, else that of its key, whatever the case,
    when the table holds it; missing otherwise."""
    mapping = mapping or LABEL_TO_KEY
    lookup = F.create_map(*[F.lit(x) for k, v in mapping.items() for x in (v.lower(), k)])
    have = known.select(F.col(label).alias("__l")).distinct()
    d = tokens.withColumn("__alias", F.try_element_at(lookup, F.lower(token)))
    d = d.join(have.withColumnRenamed("__l", "__a"), F.col(token) == F.col("__a"), "left")
    d = d.join(have.withColumnRenamed("__l", "__b"), F.col("__alias") == F.col("__b"), "left")
    return d.withColumn("label", F.coalesce("__a", "__b")).drop("__a", "__b", "__alias")


# Line formats of a training log.
NUMBER = r"[-+]?[\d.]+(?:e[-+]?\d+)?"
LOG_PATTERNS = {
    "batches": r"(?i)Dataloader batches per GPU\s*[—-]\s*train=(\d+),\s*val=(\d+),\s*test=(\d+)",
    "epoch_start": r"(?i)\[Epoch\s+(\d+)\/(\d+)\]",
    "progress": r"(?i)Progress\s+.*?[—-]\s*epoch\s+(\d+)\/(\d+),\s*batch\s+(\d+)\/(\d+),\s*avg_batch_loss=(" + NUMBER + ")",
    "batch_loss": r"\bavg_batch_loss=(" + NUMBER + r")\b",
    "mid_validation": r"(?i)\[Validation\s*@\s*batch\s*(\d+)\]\s*avg_loss=(" + NUMBER + ")",
    "preflight": r"(?i)^\[Pre-flight\s+validation\]\s*avg_loss=(" + NUMBER + ")",
    "summary": r"(?i)^(\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2},\d+)\s+\[INFO\]\s+Epoch average train loss=("
               + NUMBER + r"),\s*val loss=(" + NUMBER + r")(?:\s*\(val_cnt=(\d+)\))?",
}


# A literal every matching line holds, in lower case.
LOG_MARKS = {"batches": "batches per gpu", "epoch_start": "[epoch", "progress": "progress", "batch_loss": "avg_batch_loss=",
             "mid_validation": "[validation", "preflight": "[pre-flight", "summary": "epoch average train loss="}


def carry_forward(df: DataFrame, keys, order: str, columns, block: int = 100_000) -> DataFrame:
    """Last present value at or before each row, for groups of any size.

    A group is cut into blocks of ``order``; only the last value of each block is carried
    along the group, and the fill runs inside a block.
    """
    d = df.withColumn("__blk", F.floor(F.col(order) / block))
    inside = W.partitionBy(*keys, "__blk").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    across = W.partitionBy(*keys).orderBy("__blk").rowsBetween(W.unboundedPreceding, -1)
    last = d.groupBy(*keys, "__blk").agg(*[
        F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(f"__l_{c}") for c in columns])
    carry = last.withColumns({f"__c_{c}": F.last(f"__l_{c}", ignorenulls=True).over(across) for c in columns})
    carry = carry.drop(*[f"__l_{c}" for c in columns])
    d = d.withColumns({f"__f_{c}": F.last(c, ignorenulls=True).over(inside) for c in columns})
    d = d.join(carry, [*keys, "__blk"])
    out = {c: F.coalesce(f"__f_{c}", f"__c_{c}") for c in columns}
    return d.withColumns(out).drop("__blk", *[f"__{x}_{c}" for c in columns for x in "fc"])


def parse_log(lines: DataFrame, file: str = "file", line_no: str = "line_no", text: str = "line") -> DataFrame:
    """Log lines to events: kind (batch, probe, preflight, summary), epoch, batch, loss,
    val_loss, ts, val_cnt, step. Input is any number of files with numbered lines."""
    line = F.trim(text)

    def part(name, i):
        # The expression runs only where its literal occurs.
        found = F.nullif(F.regexp_extract(line, LOG_PATTERNS[name], i), F.lit(""))
        return F.when(F.lower(line).contains(LOG_MARKS[name]), found)

    marked = F.lower(text).rlike("|".join(re.escape(m) for m in LOG_MARKS.values()))
    d = lines.filter(marked).select(
        file, line_no,
        part("batches", 1).cast("int").alias("steps_seen"),
        part("epoch_start", 1).cast("int").alias("epoch_now"),
        part("progress", 1).cast("int").alias("p_epoch"),
        part("progress", 3).cast("int").alias("p_batch"),
        part("progress", 5).cast("double").alias("p_loss"),
        part("batch_loss", 1).cast("double").alias("b_loss"),
        part("mid_validation", 1).cast("int").alias("v_batch"),
        part("mid_validation", 2).cast("double").alias("v_loss"),
        part("preflight", 1).cast("double").alias("f_loss"),
        part("summary", 1).alias("s_ts"), part("summary", 2).cast("double").alias("s_train"),
        part("summary", 3).cast("double").alias("s_val"), part("summary", 4).cast("int").alias("s_cnt"))
    hit = F.lit(False)
    for c in ("p_loss", "b_loss", "v_loss", "f_loss", "s_ts"):
        hit = hit | F.col(c).isNotNull()
    # Few lines hold a marker, and every later step needs only those: the text is read once.
    d = stored(d, "log")
    # First steps-per-epoch line and first epoch line per file, from one aggregate.
    heads = d.groupBy(file).agg(
        F.min_by("steps_seen", F.when(F.col("steps_seen").isNotNull(), F.col(line_no))).alias("__steps"),
        F.min(F.when(F.col("steps_seen").isNotNull(), F.col(line_no))).alias("__steps_at"),
        F.min_by("epoch_now", F.when(F.col("epoch_now").isNotNull(), F.col(line_no))).alias("__base"),
        F.max("p_batch").alias("__max_batch"))
    d = carry_forward(d, [file], line_no, ["epoch_now"]).filter(hit)
    d = d.join(broadcast_counted(stored(heads, "heads")), file)
    base = F.coalesce("__base", F.lit(1))
    alone = F.col("b_loss").isNotNull() & (F.col("__steps_at") <= F.col(line_no)) & F.col("epoch_now").isNotNull()
    kind = (F.when(F.col("p_loss").isNotNull(), "batch").when(alone, "batch")
            .when(F.col("v_loss").isNotNull(), "probe").when(F.col("f_loss").isNotNull(), "preflight")
            .when(F.col("s_ts").isNotNull(), "summary"))
    d = d.withColumn("kind", kind).filter(F.col("kind").isNotNull())
    progress = F.col("p_loss").isNotNull()
    epoch = (F.when(progress, F.col("p_epoch")).when(F.col("kind") == "batch", F.col("epoch_now"))
             .when(F.col("kind") == "probe", F.coalesce("epoch_now", base)))
    batch = (F.when(progress, F.col("p_batch")).when(F.col("kind") == "batch", 1)
             .when(F.col("kind") == "probe", F.col("v_batch")))
    steps = F.coalesce("__steps", "__max_batch")
    d = d.withColumns({"epoch": epoch, "batch": batch, "__spe": steps, "__b0": base})
    step = (F.when(F.col("kind") == "preflight", 0)
            .when(F.col("kind") == "probe", (F.col("epoch") - F.col("__b0")) * F.col("__spe")
                  + F.least("batch", "__spe"))
            .when(F.col("kind") == "batch", (F.col("epoch") - F.col("__b0")) * F.col("__spe") + F.col("batch")))
    return d.select(
        file, line_no, "kind", "epoch", "batch", step.cast("int").alias("step"),
        F.when(F.col("kind") == "batch", F.coalesce("p_loss", "b_loss"))
        .when(F.col("kind") == "summary", F.col("s_train")).alias("loss"),
        F.when(F.col("kind") == "probe", F.col("v_loss")).when(F.col("kind") == "preflight", F.col("f_loss"))
        .when(F.col("kind") == "summary", F.col("s_val")).alias("val_loss"),
        F.when(F.col("kind") == "summary", F.col("s_ts")).alias("ts"),
        F.when(F.col("kind") == "summary", F.col("s_cnt")).alias("val_cnt"), F.col("__b0").alias("base_epoch"),
        F.col("__spe").cast("int").alias("steps_per_epoch"))


def epoch_table(events: DataFrame, file: str = "file", line_no: str = "line_no") -> DataFrame:
    """One row per epoch summary, numbered from the first epoch seen, with the global step at
    its end, where its validation loss belongs. Only summaries, one per epoch, meet in the window."""
    s = events.filter(F.col("kind") == "summary")
    n = F.row_number().over(W.partitionBy(file).orderBy(line_no)) - 1
    return s.select(file, (F.col("base_epoch") + n).cast("int").alias("epoch"), "ts",
                    F.col("loss").alias("train_loss"), "val_loss", "val_cnt",
                    ((n + 1) * F.col("steps_per_epoch")).cast("int").alias("val_step"))


def parse_stats_json(df: DataFrame, text: str = "json", keys=()) -> DataFrame:
    """JSON maps variable -> statistics to rows; unreadable texts and entries without a
    positive count drop out."""
    m = F.from_json(text, f"map<string,{_stats_ddl()}>")
    d = df.select(*keys, F.explode(m).alias("variable", "__s"))
    d = d.filter(F.col("__s").isNotNull()).select(
        *keys, "variable", F.col("__s.count").alias("n"), "__s.sum", "__s.sumsq", "__s.mean",
        "__s.std", "__s.min", "__s.max")
    return d.filter(F.col("n") > 0)


def _stats_ddl() -> str:
    return "struct<count:bigint,sum:double,sumsq:double,mean:double,std:double,min:double,max:double>"


def tag_and_append(parts: dict[str, DataFrame], tag: str = "experiment") -> DataFrame:
    """Tables one below the other with a column naming where each row is from."""
    out = None
    for name, d in parts.items():
        d = d.withColumn(tag, F.lit(name))
        out = d if out is None else out.unionByName(d)
    return out


def stitch_runs(runs: DataFrame, key: str = "epoch", ts: str = "ts") -> DataFrame:
    """One row per epoch over several runs; the later timestamp wins."""
    return (runs.groupBy(key).agg(F.max_by(F.struct(*[c for c in runs.columns if c != key]), F.col(ts)).alias("__r"))
            .select(key, "__r.*"))
