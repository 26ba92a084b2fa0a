"""Derived variables, unit conversion and balance residuals."""

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gridspark.functions import noleap as nl

# Unit conversions (scale, offset): converted = value * scale + offset.
SECONDS_PER_DAY = 86400.0
UNIT_FACTORS = {
    ("g m-2 d-1", "kg m-2 s-1"): (1.0 / (1000.0 * SECONDS_PER_DAY), 0.0),
    ("kg m-2 s-1", "g m-2 d-1"): (1000.0 * SECONDS_PER_DAY, 0.0),
    ("K", "C"): (1.0, -273.15),
    ("per year", "per decade"): (10.0, 0.0),
}
# Fixed value: solar constant in kW m-2.
SOLAR_CONSTANT = 1.361


def total_carbon() -> Column:
    return F.col("cVeg") + F.col("cLitter") + F.col("cSoil")


def difference(wide: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """a - b under a new name, missing if either is."""
    return wide.withColumn(out, F.col(a) - F.col(b))


def net_ecosystem_exchange(wide: DataFrame) -> DataFrame:
    """nee = gpp - rh - ra; positive is a sink, missing if any part is."""
    return wide.withColumn("nee", F.col("gpp") - F.col("rh") - F.col("ra"))


def potential_radiation(lat, doy) -> Column:
    """Daily potential radiation of a latitude and day of year, hourly trapezoid."""
    lat = F.col(lat) if isinstance(lat, str) else lat
    doy = F.col(doy) if isinstance(doy, str) else doy
    phi = F.radians(lat)
    delta = F.radians(23.45 * F.sin(F.radians((360.0 / 365.0) * (284 + doy))))
    a, b = F.sin(phi) * F.sin(delta), F.cos(phi) * F.cos(delta)

    # cos of the hour angles 1..24 is fixed; the trapezoid halves both ends.
    total = F.lit(0.0)
    for hour in range(1, 25):
        c = math.cos(math.radians(15.0 * (hour - 12.0)))
        total = total + F.greatest(a + b * c, F.lit(0.0)) * (0.5 if hour in (1, 24) else 1.0)
    return SOLAR_CONSTANT * total * 3600.0


def convert_units(df: DataFrame, unit: str, to_unit: str, value: str = "value") -> DataFrame:
    """Convert rows whose unit differs from their target; an unknown pair fails the job."""
    pairs = F.create_map(*[x for (a, b), (s, o) in UNIT_FACTORS.items()
                           for x in (F.lit(f"{a}>{b}"), F.struct(F.lit(s).alias("s"), F.lit(o).alias("o")))])
    f = F.try_element_at(pairs, F.concat_ws(">", unit, to_unit))
    bad = F.raise_error(F.concat(F.lit("no conversion "), F.concat_ws(">", unit, to_unit))).cast("double")
    v = (F.when(F.col(unit) == F.col(to_unit), F.col(value))
         .when(f.isNull(), bad).otherwise(F.col(value) * f["s"] + f["o"]))
    return df.withColumns({value: v, unit: F.col(to_unit)})


def _change_in_year(col, keys):
    """Change since the month before, missing where that month has no row."""
    w = W.partitionBy(*keys, "year").orderBy("month")
    return F.when(F.lag("month").over(w) == F.col("month") - 1, F.col(col) - F.lag(col).over(w))


def _water(keys):
    net = (F.col("pre") - F.col("mrro") - F.col("evapotrans")) * nl.seconds_in_month("month")
    return _change_in_year("mrso", keys) - net


def _npp():
    return F.col("npp") - (F.col("gpp") - F.col("ra"))


def _nbp():
    return F.col("nbp") - (F.col("npp") - F.col("rh") - F.col("fFire") - F.col("fLuc"))


def _stock_flux(keys, integrate):
    flux = F.col("nbp") * nl.seconds_in_month("month") if integrate else F.col("nbp")
    return _change_in_year("cTotal_monthly", keys) - flux


def water_residual(wide: DataFrame, keys) -> DataFrame:
    """Change of soil moisture minus (pre - mrro - evapotrans) over the month, Feb..Dec."""
    return wide.withColumn("residual", _water(keys)).filter(F.col("month") > 1)


def npp_residual(wide: DataFrame) -> DataFrame:
    """npp - (gpp - ra)."""
    return wide.withColumn("residual", _npp())


def nbp_residual(wide: DataFrame) -> DataFrame:
    """nbp - (npp - rh - fFire - fLuc)."""
    return wide.withColumn("residual", _nbp())


def stock_flux_residual(wide: DataFrame, keys, integrate: bool = True) -> DataFrame:
    """Change of monthly total carbon minus nbp over the month, Feb..Dec; without
    ``integrate`` the flux is not multiplied by seconds."""
    return wide.withColumn("residual", _stock_flux(keys, integrate)).filter(F.col("month") > 1)


def partition_residual(monthly: DataFrame, annual: DataFrame, keys) -> DataFrame:
    """December total carbon minus the sum of its annual pools."""
    dec = monthly.filter(F.col("month") == 12).select(*keys, "year", "cTotal_monthly")
    d = dec.join(annual.select(*keys, "year", "cVeg", "cLitter", "cSoil"), [*keys, "year"])
    return d.withColumn("residual", F.col("cTotal_monthly") - total_carbon())


# Balance names and the variables each needs.
BALANCES = {
    "water_balance": ("mrso", "pre", "mrro", "evapotrans"),
    "npp_balance": ("npp", "gpp", "ra"),
    "nbp_balance": ("nbp", "npp", "rh", "fFire", "fLuc"),
    "nbp_vs_delta_ctotal_monthly": ("cTotal_monthly", "nbp"),
    "carbon_partition_december": ("cTotal_monthly", "cVeg", "cLitter", "cSoil"),
}


def balance_residuals(monthly: DataFrame, keys, annual: DataFrame | None = None) -> DataFrame:
    """Residuals of every balance whose variables are all columns, long form.

    The monthly balances are columns of one pass, opened into rows afterwards.
    """
    have = set(monthly.columns)
    pools = set(annual.columns) if annual is not None else set()
    found = {}
    if have.issuperset(BALANCES["water_balance"]):
        found["water_balance"] = _water(keys)
    if have.issuperset(BALANCES["npp_balance"]):
        found["npp_balance"] = _npp()
    if have.issuperset(BALANCES["nbp_balance"]):
        found["nbp_balance"] = _nbp()
    if have.issuperset(BALANCES["nbp_vs_delta_ctotal_monthly"]):
        found["nbp_vs_delta_ctotal_monthly"] = _stock_flux(keys, True)
    out = None
    if found:
        wide = monthly.select("month", *[e.alias(n) for n, e in found.items()])
        out = wide.unpivot(["month"], list(found), "balance", "residual")
        changes = F.col("balance").isin("water_balance", "nbp_vs_delta_ctotal_monthly")
        out = out.filter(~changes | (F.col("month") > 1)).drop("month")
    if "cTotal_monthly" in have and pools.issuperset(("cVeg", "cLitter", "cSoil")):
        part = partition_residual(monthly, annual, keys).select(
            F.lit("carbon_partition_december").alias("balance"), "residual")
        out = part if out is None else out.unionByName(part)
    return out


def balance_scores(residuals: DataFrame, weights: dict[str, float], loss: str = "mse") -> DataFrame:
    """Mean residual loss per balance, its weighted value, and the weighted total row."""
    r = F.col("residual")
    per = residuals.groupBy("balance").agg(
        F.avg(r * r if loss == "mse" else F.abs(r)).alias("loss"), F.count(r).alias("n"))
    w = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))])
    per = (per.withColumn("weight", F.coalesce(F.try_element_at(w, F.col("balance")), F.lit(0.0)))
           .filter(F.col("weight") > 0).withColumn("weighted", F.col("weight") * F.col("loss")))
    whole = F.grouping("balance") == 1  # one pass gives the balances and their sum
    d = per.rollup("balance").agg(F.first("loss").alias("loss"), F.sum("n").alias("n"), F.first("weight").alias("weight"),
                                  F.sum("weighted").alias("weighted"), whole.alias("__all"))
    return d.select(F.when(F.col("__all"), "TOTAL").otherwise(F.col("balance")).alias("balance"),
                    F.when(~F.col("__all"), F.col("loss")).alias("loss"), "n", F.when(~F.col("__all"), F.col("weight")).alias("weight"), "weighted")


def bias(df: DataFrame, keys, role: str = "role", value: str = "value", label_minus_predicted=False) -> DataFrame:
    """Predicted minus label per key; the other sign on request."""
    p = F.max(F.when(F.col(role) == "Predicted", F.col(value)))
    y = F.max(F.when(F.col(role) == "Label", F.col(value)))
    return df.groupBy(*keys).agg(((y - p) if label_minus_predicted else (p - y)).alias("bias"))


def split_role(df: DataFrame, name: str = "name") -> DataFrame:
    """Role and suffix of names like Label_gpp; other names have neither."""
    pattern = r"^(Label|Predicted|Bias)_(.+)$"
    part = lambda i: F.nullif(F.regexp_extract(name, pattern, i), F.lit(""))
    return df.withColumns({"role": part(1), "suffix": part(2)})


def complete_roles(df: DataFrame, keys=("suffix",)) -> DataFrame:
    """Suffixes that have both a label and a prediction."""
    both = (F.max((F.col("role") == "Label").cast("int")) + F.max((F.col("role") == "Predicted").cast("int")))
    return df.filter(F.col("role").isNotNull()).groupBy(*keys).agg(both.alias("__b")).filter("__b = 2").drop("__b")
