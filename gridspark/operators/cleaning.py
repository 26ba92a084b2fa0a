"""Projection, renaming, value cleaning and row selection."""

from pyspark.sql import DataFrame, functions as F

from gridspark.functions.nulls import SENTINELS, clean_value, finite
from gridspark.functions.sizing import one_row
from gridspark.schema import NITROGEN_FERTILISER, NON_NEGATIVE_OUTPUTS, variables_table


def rename_variables(df: DataFrame, names: dict[str, str], columns: dict[str, str] | None = None) -> DataFrame:
    """Rename variables by a literal map and coordinate columns by another."""
    if names:
        lookup = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
        new = F.coalesce(F.try_element_at(lookup, F.col("variable")), F.col("variable"))
        df = df.withColumn("variable", new)
    return df.withColumnsRenamed(columns or {})


def attach_attributes(df: DataFrame) -> DataFrame:
    """Unit, long name and standard name; the registry has fewer than 100 rows."""
    return df.join(F.broadcast(variables_table(df.sparkSession)), "variable", "left")


def sentinels_to_null(df: DataFrame, value: str = "value", sentinels=SENTINELS) -> DataFrame:
    return df.withColumn(value, clean_value(value, sentinels))


def clip_negative(df: DataFrame, variables=NON_NEGATIVE_OUTPUTS, value: str = "value") -> DataFrame:
    """Negatives of the listed variables become 0; missing stays missing."""
    clip = F.col("variable").isin(*variables) & (F.col(value) < 0)
    return df.withColumn(value, F.when(clip, 0.0).otherwise(F.col(value)))


def zero_like(df: DataFrame, variable: str, value: str = "value") -> DataFrame:
    """A field that is 0 where the source is present, under another name."""
    return df.withColumns({value: F.col(value) * 0.0, "variable": F.lit(variable)})


def missing_to_zero(df: DataFrame, variables=NITROGEN_FERTILISER, value: str = "value") -> DataFrame:
    fill = F.when(F.col("variable").isin(*variables), F.coalesce(value, F.lit(0.0)))
    return df.withColumn(value, fill.otherwise(F.col(value)))


def finite_rows(df: DataFrame, columns) -> DataFrame:
    """Rows present and finite in every listed column."""
    keep = F.lit(True)
    for c in columns:
        keep = keep & finite(c)
    return df.filter(keep)


def complete_cell_years(df: DataFrame, cell, expected: int, value: str = "value") -> DataFrame:
    """Cell-years whose values are all present: ``expected`` = channels x days."""
    return (df.groupBy(*cell, "year").agg(F.count(value).alias("__n"))
            .filter(F.col("__n") == expected).drop("__n"))


def select_complete(df: DataFrame, cell, expected: int, value: str = "value") -> DataFrame:
    """Rows of complete cell-years only."""
    return df.join(complete_cell_years(df, cell, expected, value), [*cell, "year"], "left_semi")


def scatter_back(df: DataFrame, results: DataFrame, keys, columns) -> DataFrame:
    """Every original key with its result, missing where nothing was computed."""
    return df.select(*keys).distinct().join(results.select(*keys, *columns), list(keys), "left")


def valid_variables(stats: DataFrame, present: DataFrame, exclude=(), optional=()) -> DataFrame:
    """Variables with finite mean and std, std > 0, not excluded and present, by name.

    A variable that is neither valid nor ``optional`` shows with valid = false.
    """
    ok = finite("mean") & finite("std") & (F.coalesce(F.col("std"), F.lit(0.0)) > 0)
    d = (stats.filter(~F.col("variable").isin(*exclude)) if exclude else stats)
    d = (d.withColumn("__ok", ok)
         .join(present.select("variable").distinct().withColumn("__p", F.lit(True)), "variable", "left"))
    d = d.withColumn("valid", F.col("__ok") & F.coalesce("__p", F.lit(False)))
    if optional:
        d = d.filter(F.col("valid") | ~F.col("variable").isin(*optional))
    return d.select("variable", "valid").orderBy("variable")


def replace_labels(df: DataFrame, mapping: dict[str, str], label_groups, group: str = "role",
                   name: str = "variable") -> DataFrame:
    """Read another variable for a logical label, in label groups only."""
    lookup = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    actual = F.when(F.col(group).isin(*label_groups), F.try_element_at(lookup, F.col(name)))
    return df.withColumn("actual_variable", F.coalesce(actual, F.col(name)))


def select_variables(df: DataFrame, names, name: str = "variable", absent: str = "fail") -> DataFrame:
    """Rows of the wanted variables. One that the field does not hold fails at once, with the names that are
    there, unless ``absent`` is 'skip'; only the column of names is read for it."""
    if absent == "fail":
        gone = absent_variables(df, names, name).collect()  # as many rows as wanted names
        if gone:
            raise ValueError(f"no variable {', '.join(sorted(r['variable'] for r in gone))}; there are {', '.join(gone[0]['available'])}")
    elif absent != "skip":
        raise ValueError(f"unknown rule {absent!r}")
    return df.filter(F.col(name).isin(*names))


def absent_variables(df: DataFrame, names, name: str = "variable") -> DataFrame:
    """Wanted names the field does not hold, with the list of those it does."""
    spark = df.sparkSession
    present = df.select(F.col(name).alias("variable")).distinct()
    have = present.agg(F.array_sort(F.collect_set("variable")).alias("available"))
    wanted = spark.createDataFrame([(n,) for n in names], "variable string")
    absent = wanted.join(present, "variable", "left_anti")
    return absent.withColumn("available", one_row(have)["available"])
