"""Column schemas of the inputs and of the stored tables."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {
    "int": T.IntegerType(),
    "long": T.LongType(),
    "double": T.DoubleType(),
    "string": T.StringType(),
    "boolean": T.BooleanType(),
    "timestamp": T.TimestampType(),
    "array<float>": T.ArrayType(T.FloatType()),
}


def _schema(columns: str) -> T.StructType:
    """``name type, name type``; unlike a DDL string this needs no session at import."""
    pairs = [column.split() for column in columns.split(", ")]
    return T.StructType([T.StructField(name, _TYPES[dtype]) for name, dtype in pairs])


# Source key -> column, type of a snapshot element.
SNAPSHOT_FIELDS = (
    ("pl_name", "planet_name", "string"),
    ("hostname", "host_star", "string"),
    ("disc_year", "discovery_year", "int"),
    ("discoverymethod", "discovery_method", "string"),
    ("pl_bmasse", "planet_mass", "double"),
    ("pl_rade", "planet_radius", "double"),
    ("pl_orbper", "orbital_period", "double"),
    ("pl_orbsmax", "semi_major_axis", "double"),
    ("pl_orbeccen", "eccentricity", "double"),
    ("pl_eqt", "equilibrium_temp", "double"),
    ("pl_dens", "planet_density", "double"),
    ("pl_insol", "insolation_flux", "double"),
    ("st_teff", "star_temperature", "double"),
    ("st_rad", "star_radius", "double"),
    ("st_mass", "star_mass", "double"),
    ("st_spectype", "star_spectral_type", "string"),
    ("sy_dist", "distance_parsecs", "double"),
    ("sy_snum", "num_stars", "int"),
    ("sy_pnum", "num_planets", "int"),
)

# Source key -> column, type of a reference element.
REFERENCE_FIELDS = (
    ("pl_name", "planet_name", "string"),
    ("pl_refname", "reference_name", "string"),
    ("pl_pubdate", "pub_date", "string"),
    ("pl_bmasse", "planet_mass", "double"),
    ("pl_rade", "planet_radius", "double"),
    ("pl_orbper", "orbital_period", "double"),
    ("pl_eqt", "equilibrium_temp", "double"),
    ("pl_dens", "planet_density", "double"),
    ("discoverymethod", "discovery_method", "string"),
)

# The compared fields, in log order.
COMPARED_FIELDS = (
    "discovery_year", "discovery_method", "planet_radius", "planet_mass", "orbital_period",
    "semi_major_axis", "eccentricity", "equilibrium_temp", "planet_density", "insolation_flux",
)

SOLAR_SYSTEMS = _schema(
    "id long, distance_parsecs double, num_stars int, num_planets int, created_utc timestamp, updated_utc timestamp"
)
STARS = _schema(
    "id long, solar_system_id long, name string, temperature_k double, radius_solar double, mass_solar double, "
    "spectral_type string, created_utc timestamp, updated_utc timestamp"
)
PLANETS = _schema(
    "id long, solar_system_id long, planet_name string, discovery_year int, discovery_method string, "
    "planet_radius double, planet_mass double, orbital_period double, semi_major_axis double, eccentricity double, "
    "equilibrium_temp double, planet_density double, insolation_flux double, classification string, "
    "plavalova_code string, habitability_score string, scientific_note string, created_utc timestamp, "
    "updated_utc timestamp"
)
PLANET_STARS = _schema("planet_id long, star_id long")
ATMOSPHERES = _schema(
    "id long, planet_id long, ingest_run_id int, molecule string, detection_type string, spectral_reference string, "
    "habitability_score double, habitability_reasoning string, created_utc timestamp, updated_utc timestamp"
)
INGEST_RUN = _schema(
    "id int, run_timestamp timestamp, source string, source_url string, status string, rows_fetched long, "
    "rows_new long, rows_updated long, rows_deleted long, rows_unchanged long, error_message string, "
    "completed_at timestamp"
)
CHANGE_LOG = _schema(
    "ingest_run_id int, planet_name string, change_type string, field_name string, old_value string, "
    "new_value string, ai_classification string, ai_reasoning string, detected_at timestamp"
)
CHANGE_REPORT = _schema(
    "ingest_run_id int, model_used string, prompt_sent string, report_text string, tokens_used int, "
    "generated_at timestamp"
)
PIPELINE_LOG = _schema(
    "ingest_run_id int, log_level string, message string, exception string, logged_at timestamp"
)
RETRIEVAL_LOG = _schema(
    "ingest_run_id int, planet_name string, reference_id long, reference_name string, similarity_score double, "
    "was_referenced boolean, retrieved_at timestamp"
)
EVAL_RESULT = _schema(
    "ingest_run_id int, eval_type string, planet_name string, expected_value string, actual_value string, "
    "score int, dimension string, pass_fail string, evaluated_at timestamp"
)
DRIFT_VERDICT = _schema(
    "run_id long, current_avg double, recent_runs long, scored_runs long, rolling_avg double, drop double, verdict string"
)
REFERENCES = _schema(
    "id long, planet_name string, reference_name string, pub_date string, content string, embedding array<float>, "
    "created_utc timestamp"
)
ANSWERS = _schema("digest string, answer string, asked_at timestamp, model string")
# One row per valid attempt of a stage; of one stage the greatest number counts.
STAGE_COMMITS = _schema("ingest_run_id int, stage string, attempt string, number long")
LEGACY_CATALOGUE = _schema(
    "id long, planet_name string, host_star string, discovery_year int, created_utc timestamp, "
    "updated_utc timestamp"
)


def json_schema(fields: tuple[tuple[str, str, str], ...]) -> T.StructType:
    return _schema(", ".join(f"{key} {dtype}" for key, _, dtype in fields))


def evidence_schema(schema: T.StructType) -> T.StructType:
    """Columns of an evidence table on disk: the table's, then the run and the stage that wrote them."""
    own = [f for f in schema.fields if f.name not in ("ingest_run_id", "stage")]
    return T.StructType([*own, T.StructField("ingest_run_id", T.IntegerType()), T.StructField("stage", T.StringType())])
