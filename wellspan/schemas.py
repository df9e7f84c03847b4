"""Table schemas and the fixed vocabulary of the observation and weather feeds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# --- fixed values: feed column names and lists -------------------------------------------

STATION_KEY = "code_bss"
DATE_INDEX = "date_index"
LEVEL = "niveau_nappe_eau"

WEATHER_VARIABLES: dict[str, str] = {
    "weather_code": "int",
    "temperature_2m_max": "double",
    "temperature_2m_min": "double",
    "apparent_temperature_max": "double",
    "apparent_temperature_min": "double",
    "sunrise": "string",
    "sunset": "string",
    "daylight_duration": "double",
    "sunshine_duration": "double",
    "uv_index_max": "double",
    "uv_index_clear_sky_max": "double",
    "rain_sum": "double",
    "showers_sum": "double",
    "snowfall_sum": "double",
    "precipitation_sum": "double",
    "precipitation_hours": "double",
    "precipitation_probability_max": "double",
    "shortwave_radiation_sum": "double",
    "et0_fao_evapotranspiration": "double",
    "cloud_cover_mean": "double",
    "dew_point_2m_mean": "double",
    "et0_fao_evapotranspiration_sum": "double",
    "relative_humidity_2m_mean": "double",
    "snowfall_water_equivalent_sum": "double",
    "pressure_msl_mean": "double",
    "surface_pressure_mean": "double",
    "visibility_mean": "double",
    "wind_speed_10m_mean": "double",
    "soil_moisture_0_to_100cm_mean": "double",
    "soil_temperature_0_to_100cm_mean": "double",
}

OBSERVATION_DROP = [
    "code_nature_mesure", "nom_nature_mesure", "urn_bss", "timestamp_mesure", "statut",
    "qualification", "code_continuite", "nom_continuite", "code_producteur",
    "profondeur_nappe", "date_mesure",
]

WEATHER_DROP_SPARSE = [
    "precipitation_probability_max", "uv_index_clear_sky_max", "uv_index_max",
    "visibility_mean", "showers_sum", "snowfall_sum", "date", "snowfall_water_equivalent_sum",
]

WEATHER_DROP_COLLINEAR = [
    "et0_fao_evapotranspiration_sum", "relative_humidity_2m_mean", "rain_sum",
    "surface_pressure_mean", "dew_point_2m_mean", "precipitation_hours", "sunshine_duration",
    "weather_code", "apparent_temperature_min", "apparent_temperature_max",
    "temperature_2m_min",
]

FORECAST_REGRESSORS = [
    "shortwave_radiation_sum", "et0_fao_evapotranspiration",
    "soil_temperature_0_to_100cm_mean", "P_cum_90d", "Peff_cum_90d", "Temperature_mean_90d",
]


@dataclass(frozen=True)
class IndexSpec:
    """One standardised index: its name, the daily column behind it and the monthly aggregate."""

    name: str
    column: str
    agg: str


INDEX_SPECS = [
    IndexSpec("SPLI", "niveau_nappe_eau", "mean"),
    IndexSpec("SPI", "precipitation_sum", "sum"),
    IndexSpec("SETI", "et0_fao_evapotranspiration", "sum"),
    IndexSpec("SSTI", "soil_temperature_0_to_100cm_mean", "sum"),
    IndexSpec("SSRI", "shortwave_radiation_sum", "sum"),
    IndexSpec("SWSI", "wind_speed_10m_mean", "sum"),
    IndexSpec("SCCI", "cloud_cover_mean", "sum"),
    IndexSpec("SPMI", "pressure_msl_mean", "sum"),
    IndexSpec("SPEI", "Peff", "sum"),
    IndexSpec("SSMI", "soil_moisture_0_to_100cm_mean", "mean"),
]

SCALES = (1, 3, 6, 12)

# Monthly aggregation of raw drivers for lag analysis: fluxes sum, states mean, rolled last.
DRIVER_AGG = {
    "shortwave_radiation_sum": "sum",
    "et0_fao_evapotranspiration": "sum",
    "cloud_cover_mean": "mean",
    "wind_speed_10m_mean": "mean",
    "soil_temperature_0_to_100cm_mean": "mean",
    "P_cum_30d": "last",
    "P_cum_90d": "last",
    "Peff_cum_30d": "last",
    "Peff_cum_90d": "last",
    "Temperature_mean_90d": "last",
}

# Additive-forecaster sweep.
PARAM_GRID = {
    "changepoint_prior_scale": [0.01, 0.05, 0.1, 0.3, 0.5],
    "seasonality_prior_scale": [0.1, 1.0, 10.0],
    "changepoint_range": [0.8],
}
HORIZONS = (14, 30)
CV_PERIOD_DAYS = 45
CV_INITIAL_FRACTION = 0.8
LAMBDA_DEGRADATION = 0.4
LAMBDA_SPREAD = 0.3
MIN_FORECAST_DAYS = 14
HISTORY_WINDOW_DAYS = 220

FLOAT_PARAMS = ["changepoint_prior_scale", "seasonality_prior_scale", "changepoint_range", "interval_width"]
BOOL_PARAMS = ["weekly_seasonality", "daily_seasonality", "yearly_seasonality"]
TEXT_PARAMS = ["seasonality_mode"]

# --- end of fixed values -----------------------------------------------------------------

_KINDS = {
    "string": T.StringType(), "double": T.DoubleType(), "int": T.IntegerType(),
    "long": T.LongType(), "date": T.DateType(),
}


def struct_of(columns: dict[str, str]) -> T.StructType:
    """Schema from name to type name; needs no running session."""
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in columns.items()])


def _same(kind: str, names: str) -> dict[str, str]:
    return {name: kind for name in names.split()}


STATION_SCHEMA = struct_of({
    **_same("string", "code_bss bss_id libelle_pe"),
    **_same("double", "x y"),
    **_same("string", "nom_commune code_commune_insee nom_departement code_departement"),
    **_same("double", "altitude_station profondeur_investigation"),
    **_same("date", "date_debut_mesure date_fin_mesure"),
    "nb_mesures_piezo": "int",
    **_same("string", "noms_masse_eau_edl codes_masse_eau_edl codes_bdlisa"),
})

OBSERVATION_SCHEMA = struct_of({
    **_same("string", "code_bss bss_id"),
    "date_mesure": "date",
    **_same("double", "niveau_nappe_eau profondeur_nappe"),
    **_same("string", "mode_obtention nom_producteur urn_bss"),
    "timestamp_mesure": "long",
    **_same("string", "statut qualification code_continuite nom_continuite code_producteur"),
    **_same("string", "code_nature_mesure nom_nature_mesure"),
})

WEATHER_SCHEMA = struct_of({
    "date": "date", **_same("double", "latitude longitude"), "code_bss": "string", **WEATHER_VARIABLES,
})


def page_schema(record: T.StructType) -> T.StructType:
    """Envelope of one landed feed page: the records and the link to the next page."""
    return T.StructType([
        T.StructField("data", T.ArrayType(record)),
        T.StructField("next", T.StringType()),
    ])


def weather_doc_schema(variables: dict[str, str] | None = None) -> T.StructType:
    """Envelope of one weather document: parallel daily arrays."""
    kinds = {"time": "string", **(variables or WEATHER_VARIABLES)}
    daily = T.StructType([T.StructField(n, T.ArrayType(_KINDS[k])) for n, k in kinds.items()])
    return T.StructType([
        T.StructField("code_bss", T.StringType()), T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()), T.StructField("daily", daily),
    ])
