"""Path catalogs, file names and source routing."""

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from gridspark.functions.sizing import broadcast_bounded
from gridspark.schema import CATALOG_COLUMNS, FIRST_YEAR, LAST_YEAR, source_rules_table


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Path catalog from CSV with a header, all text."""
    return spark.read.csv(path, header=True).select(*CATALOG_COLUMNS)


def filter_catalog(df: DataFrame, **wanted) -> DataFrame:
    """Keep rows whose columns match a scalar or a list; None ignores a column."""
    for col, want in wanted.items():
        if want is not None:
            names = [want] if isinstance(want, str) else list(want)
            df = df.filter(F.col(col).isin(*names))
    return df


def resolve_catalog(catalog: DataFrame, keys, aliases: dict[str, tuple[str, int]] | None = None,
                    strict: bool = True, path: str = "path", wanted: DataFrame | None = None) -> DataFrame:
    """One path per (model, scenario, variable).

    With ``wanted`` (the keys) these rows alone are resolved, and one without any candidate fails the job.

    ``aliases`` maps a stored variable to (name, rank). ``strict`` fails the job when a key
    has more than one candidate, aliases included; otherwise the lowest rank wins and
    ``n_paths`` says how many paths share it.
    """
    d = catalog
    if aliases:
        m = F.create_map(*[x for k, (n, r) in aliases.items()
                           for x in (F.lit(k), F.struct(F.lit(n).alias("n"), F.lit(r).alias("r")))])
        hit = F.try_element_at(m, F.col("variable"))
        d = d.withColumns({"__rank": F.coalesce(hit["r"], F.lit(0)),
                           "variable": F.coalesce(hit["n"], F.col("variable"))})
    else:
        d = d.withColumn("__rank", F.lit(0))
    per = d.groupBy(*keys, "__rank").agg(F.min(path).alias(path), F.count(F.lit(1)).alias("n_paths"))
    out = per.groupBy(*keys).agg(F.min_by(F.struct(path, "n_paths"), "__rank").alias("__r"),
                                 F.sum("n_paths").alias("__all")).select(*keys, "__r.*", "__all")
    if wanted is not None:
        out = wanted.select(*keys).distinct().join(out, list(keys), "left")
        none = F.raise_error(F.concat_ws(" ", F.lit("no input for"), *keys))
        out = out.withColumn(path, F.coalesce(path, none))
    if not strict:
        return out.drop("__all")
    bad = F.raise_error(F.concat_ws(" ", F.lit("several inputs for"), *keys))
    return out.withColumn(path, F.when(F.col("__all") == 1, F.col(path)).otherwise(bad)).drop("n_paths", "__all")


def year_from_name(name) -> "F.Column":
    """First four digits of a file name, if they are a year of the covered period."""
    y = F.nullif(F.regexp_extract(name, r"(\d{4})", 1), F.lit("")).cast("int")
    return F.when(y.between(FIRST_YEAR, LAST_YEAR), y)


def scenario_from_name(name) -> "F.Column":
    return F.coalesce(F.nullif(F.regexp_extract(name, r"S[0-3]", 0), F.lit("")), F.lit("misc"))


# Fixed value: a year of a file name, at its start or after an underscore or a dash.
NAME_YEARS = r"(?:^|[_-])((?:19|20)\d{2})(?!\d)"


def prune_by_year(files: DataFrame, y0: int, y1: int, path: str = "path", keep_undated: bool = False) -> DataFrame:
    """Files whose year or span of years (2001 or 2001-2010) overlaps [y0, y1], by start.

    A file without a year is left out unless ``keep_undated``.
    """
    name = F.element_at(F.split(path, "/"), -1)
    years = F.transform(F.regexp_extract_all(name, F.lit(NAME_YEARS), F.lit(1)), lambda y: y.cast("int"))
    d = files.withColumns({"start_year": F.array_min(years), "end_year": F.array_max(years)})
    keep = (F.col("end_year") >= y0) & (F.col("start_year") <= y1)
    return d.filter(F.coalesce(keep, F.lit(keep_undated))).orderBy("start_year", "end_year", path)


def route_sources(df: DataFrame) -> DataFrame:
    """Historical or pre-industrial origin of each (scenario, variable); the rules are data
    (under 200 rows), so a changed routing is a changed row."""
    rules = broadcast_bounded(source_rules_table(df.sparkSession), 200)
    d = df.join(rules, ["scenario", "variable"], "left")
    return d.withColumn("origin", F.coalesce("origin", F.lit("historical")))


def year_blocks(df: DataFrame, keys, n: int, year: str = "year") -> DataFrame:
    """Blocks of at most n consecutive years; a gap starts a new block.

    One row per year and key is assumed (years are few), so the window is short.
    """
    w = W.partitionBy(*keys).orderBy(year)
    d = df.withColumn("__island", F.col(year) - F.row_number().over(w))
    inside = W.partitionBy(*keys, "__island").orderBy(year)
    d = d.withColumn("__part", F.floor((F.row_number().over(inside) - 1) / n))
    block = W.partitionBy(*keys, "__island", "__part")
    return (d.withColumns({"block_start": F.min(year).over(block), "block_end": F.max(year).over(block)})
            .drop("__island", "__part"))
