"""Table schemas, variable registry and split rules."""

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

CELL = ["lat_idx", "lon_idx"]
SERIES = ["variable", "source", "scenario", *CELL]

FIELD = T.StructType([
    T.StructField("variable", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("scenario", T.StringType()), T.StructField("lat_idx", T.IntegerType()),
    T.StructField("lon_idx", T.IntegerType()), T.StructField("t", T.IntegerType()),
    T.StructField("year", T.IntegerType()), T.StructField("month", T.IntegerType()),
    T.StructField("value", T.DoubleType()),
])
CATALOG_COLUMNS = ("model", "scenario", "variable", "time_res", "path")

# Years covered, scenarios, land models.
FIRST_YEAR, LAST_YEAR = 1901, 2023
SCENARIOS = ("S0", "S1", "S2", "S3")
MODELS = ("CLASSIC", "CLM5.0", "ELM", "JSBACH", "ORCHIDEE", "SDGVM", "VISIT", "VISIT-UT")

# Variable names by resolution and role.
MONTHLY_FLUXES = ("mrro", "evapotrans", "nbp", "ra", "gpp", "rh", "fLuc", "fFire", "npp")
MONTHLY_STATES = ("lai", "cTotal_monthly", "mrso")
ANNUAL_STATES = ("cVeg", "cLitter", "cSoil")
CLIMATE = ("pre", "pres", "tmp", "spfh", "ugrd", "vgrd", "dlwrf", "tmax", "tmin",
           "tswrf", "fd", "cld")
NITROGEN_DEPOSITION = ("drynhx", "drynoy", "wetnhx", "wetnoy")
NITROGEN_FERTILISER = ("nfer_crop_nh4", "nfer_crop_no3", "nfer_pas_nh4", "nfer_pas_no3")
STATIC_LAND = ("elevation", "soil_depth", "soil_porosity", "pore_size_index",
               "orography_std_dev")
LAND_USE_STATES = ("primf", "primn", "secdf", "secdn", "urban", "c3ann", "c4ann", "c3per",
                   "c4per", "c3nfx", "pastr", "range", "secmb", "secma")
LAND_USE_MANAGEMENT = (
    "fertl_c3ann", "irrig_c3ann", "crpbf_c3ann", "fertl_c4ann", "irrig_c4ann", "crpbf_c4ann",
    "fertl_c3per", "irrig_c3per", "crpbf_c3per", "fertl_c4per", "irrig_c4per", "crpbf_c4per",
    "fertl_c3nfx", "irrig_c3nfx", "crpbf_c3nfx", "fharv_c3per", "fharv_c4per", "flood",
    "rndwd", "fulwd", "combf", "crpbf_total")
ROLLING_MEANS = tuple(f"{v}_rolling_mean" for v in ("pre", "tmp", "spfh", "tmax", "tmin"))
LAND_USE_DELTAS = tuple(f"{v}_delta" for v in LAND_USE_STATES)

LAND_USE = LAND_USE_MANAGEMENT + LAND_USE_STATES
DAILY_FORCING = CLIMATE + ("potential_radiation",)
MONTHLY_FORCING = NITROGEN_DEPOSITION
ANNUAL_FORCING = (NITROGEN_FERTILISER + STATIC_LAND + LAND_USE + ("population", "co2")
                  + ROLLING_MEANS)

# Variables that may not be negative (model output; forcing offsets).
NON_NEGATIVE_OUTPUTS = ("gpp", "ra", "rh", "evapotrans", "fFire", "mrro", "mrso", "lai",
                        "cVeg", "cLitter", "cSoil")
NON_NEGATIVE_OFFSETS = ("pre", "mrro", "evapotrans", "mrso", "lai", "cVeg", "cSoil", "cLitter",
                        "cTotal", "population", "potential_radiation", "tswrf", "dlwrf", "fd",
                        "cld")

# Export names of variables that go under another name.
EXPORT_ALIASES = {"lai": "lai", "lai_avh15c1": "lai", "lai_modis": "lai",
                  "cTotal_monthly": "cTotal"}

# Export names written as a flat annual mean in monthly sets.
ANNUAL_EXPORTS = ("cVeg", "cSoil", "cLitter", "cTotal")

# Units and names of output variables.
_CARBON_FLUX, _CARBON_STOCK = "kg m-2 s-1", "kg m-2"
OUTPUT_ATTRIBUTES = {
    "nbp": (_CARBON_FLUX, "Net Biome Productivity",
            "net_biome_productivity_of_biomass_expressed_as_carbon_mass_flux"),
    "gpp": (_CARBON_FLUX, "Gross Primary Production",
            "gross_primary_productivity_of_biomass_expressed_as_carbon_mass_flux"),
    "npp": (_CARBON_FLUX, "Net Primary Production",
            "net_primary_productivity_of_biomass_expressed_as_carbon_mass_flux"),
    "ra": (_CARBON_FLUX, "Autotrophic Respiration", "autotrophic_respiration_carbon_mass_flux"),
    "rh": (_CARBON_FLUX, "Heterotrophic Respiration",
           "heterotrophic_respiration_carbon_mass_flux"),
    "fLuc": (_CARBON_FLUX, "Land-Use Change Emissions", "land_use_change_carbon_mass_flux"),
    "fFire": (_CARBON_FLUX, "Fire Emissions", "fire_carbon_mass_flux"),
    "mrro": (_CARBON_FLUX, "Total Runoff", "total_runoff_flux"),
    "evapotrans": (_CARBON_FLUX, "Evapotranspiration", "evapotranspiration_flux"),
    "cLitter": (_CARBON_STOCK, "Carbon in Litter Pool", "carbon_mass_content_of_litter"),
    "cSoil": (_CARBON_STOCK, "Carbon in Soil Pool", "carbon_mass_content_of_soil"),
    "cVeg": (_CARBON_STOCK, "Carbon in Vegetation", "carbon_mass_content_of_vegetation"),
    "cTotal": (_CARBON_STOCK, "Total Carbon in Ecosystem",
               "carbon_mass_content_of_ecosystem"),
    "cTotal_monthly": (_CARBON_STOCK, "Total Carbon in Ecosystem",
                       "carbon_mass_content_of_ecosystem"),
    "mrso": (_CARBON_STOCK, "Total Soil Moisture Content", "soil_moisture_content"),
    "lai": ("m2 m-2", "Leaf Area Index", "leaf_area_index"),
    "lai_avh15c1": ("m2 m-2", "Leaf Area Index", "leaf_area_index"),
    "lai_modis": ("m2 m-2", "Leaf Area Index", "leaf_area_index"),
}

# Channel groups in input order and in output order.
INPUT_GROUPS = (("daily_forcing", DAILY_FORCING), ("monthly_forcing", MONTHLY_FORCING),
                ("monthly_states", MONTHLY_STATES), ("annual_forcing", ANNUAL_FORCING),
                ("annual_states", ANNUAL_STATES))
OUTPUT_GROUPS = (("monthly_fluxes", MONTHLY_FLUXES), ("monthly_states", MONTHLY_STATES),
                 ("annual_states", ANNUAL_STATES))

# Scenario -> variable groups read from the pre-industrial source.
PREINDUSTRIAL_GROUPS = {"S0": ("climate", "land_use", "co2"), "S1": ("climate", "land_use"),
                        "S2": ("land_use",), "S3": ()}

# Periods (first year, last year, set the period forces) and mask codes.
PERIODS = {
    "train_period": (1928, 2013, "train"), "val_period_early": (1919, 1927, "val"),
    "val_period_late": (2014, 2017, "val"), "test_period_early": (1901, 1918, "test"),
    "test_period_late": (2018, 2023, "test"), "whole_period": (1901, 2023, None),
}
MASK_CODES = {0: "train", 1: "val", 2: "test"}
TEST_WINDOWS = ((1901, 1918), (2018, 2023))


def as_field(df: DataFrame, **constants) -> DataFrame:
    """Columns and types of a field; a key the input lacks takes its value from
    ``constants`` or is missing."""
    cols = []
    for f in FIELD:
        c = F.col(f.name) if f.name in df.columns else F.lit(constants.get(f.name))
        cols.append(c.cast(f.dataType).alias(f.name))
    return df.select(*cols)


def variable_group(name: str) -> str:
    """Source-routing group of a variable."""
    if name in CLIMATE:
        return "climate"
    if name in LAND_USE:
        return "land_use"
    return "co2" if name == "co2" else "other"


def variables_table(spark: SparkSession) -> DataFrame:
    """One row per output variable with unit, long name and standard name."""
    rows = [(v, *a) for v, a in OUTPUT_ATTRIBUTES.items()]
    return spark.createDataFrame(
        rows, "variable string, units string, long_name string, standard_name string")


def source_rules_table(spark: SparkSession) -> DataFrame:
    """(scenario, variable) pairs that read the pre-industrial source."""
    names = CLIMATE + LAND_USE + ("co2",)
    rows = [(s, v, "preindustrial") for s, groups in PREINDUSTRIAL_GROUPS.items()
            for v in names if variable_group(v) in groups]
    return spark.createDataFrame(rows, "scenario string, variable string, origin string")


def split_rules_table(spark: SparkSession, periods=None) -> DataFrame:
    """(mask code, period) -> split with its year range."""
    rows = []
    for period, (y0, y1, forced) in (periods or PERIODS).items():
        for code, name in MASK_CODES.items():
            if (code == 0) == (period != "whole_period"):
                rows.append((code, period, y0, y1, forced or name))
    return spark.createDataFrame(
        rows, "tvt int, period string, first_year int, last_year int, split string")
