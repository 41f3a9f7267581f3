"""From raw report rows to warehouse rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from epimill import schemas
from epimill.functions.dates import (
    date_text,
    file_date,
    parse_iso_date,
    parse_timestamp,
    time_parts,
    timestamp_text,
)
from epimill.operators.joins import merge_lookups
from epimill.operators.shape import blank_keys, first_per_key, whole_numbers

# Columns of the reports and lookups.
CASE_COLUMNS = [
    "FIPS", "Admin2", "Province_State", "Country_Region", "Last_Update",
    "Confirmed", "Deaths", "Recovered", "Active",
]
VAC_COLUMNS = ["location", "date", "vaccine", *schemas.VAC_MEASURES]
AREA_COLUMNS = [
    "UID", "iso2", "iso3", "code3", "FIPS", "Admin2", "Province_State",
    "Country_Region", "Lat", "Long_", "Combined_Key", "Population",
]
LOCATION_COLUMNS = ["Country_Region", "location", "continent"]
# Old reports have no codes, sub-areas or active cases; all reports have the others.
CASE_REQUIRED = ["Province_State", "Country_Region", "Last_Update", "Confirmed", "Deaths", "Recovered"]
LINEAGE = ["layout", "source_file", "position"]


def lower_names(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({name: name.lower() for name in df.columns})


def conform_cases(raw: DataFrame) -> DataFrame:
    """Daily report rows as ``daily_case`` rows plus lineage; the day is the file's."""
    rows = lower_names(raw).withColumn("date_case", file_date(F.col("source_file")))
    rows = rows.withColumn("date_string", date_text(F.col("date_case")))
    rows = blank_keys(whole_numbers(rows, schemas.CASE_MEASURES), schemas.KEYS["daily_case"])
    rows = rows.withColumns({name: F.col(name).cast("int") for name in schemas.CASE_MEASURES})
    return rows.select(*schemas.DAILY_CASE.fieldNames(), *LINEAGE)


def first_cases(rows: DataFrame) -> DataFrame:
    """One row per key: new layout before old, then file, then row order."""
    kept = first_per_key(rows, schemas.KEYS["daily_case"], ["layout", "source_file", "position"])
    return kept.select(*schemas.DAILY_CASE.fieldNames())


def time_rows(rows: DataFrame, stamp: str = "last_update") -> DataFrame:
    """One time dimension row per distinct parsed stamp; unreadable stamps have none."""
    parsed = rows.select(parse_timestamp(F.col(stamp)).alias("parsed"))
    # Filters on an aggregate stay above it; on the key they would parse every row twice.
    seen = parsed.groupBy("parsed").agg(F.max("parsed").alias("ts")).where("ts is not null")
    return seen.select(
        timestamp_text(F.col("ts")).alias("last_update"),
        date_text(F.col("ts")).alias("date_string"),
        *[part.alias(name) for name, part in time_parts(F.col("ts")).items()],
    )


def conform_vaccinations(raw: DataFrame) -> DataFrame:
    """Vaccination rows as ``vac`` rows plus lineage."""
    rows = raw.withColumnRenamed("date", "date_org")
    rows = rows.withColumn("date_string", date_text(parse_iso_date(F.col("date_org"))))
    rows = blank_keys(whole_numbers(rows, schemas.VAC_MEASURES), ["location", "date_org", "vaccine"])
    return rows.select(*schemas.VAC.fieldNames(), "source_file", "position")


def first_vaccinations(rows: DataFrame) -> DataFrame:
    """One row per key, in file and row order."""
    kept = first_per_key(rows, schemas.KEYS["vac"], ["source_file", "position"])
    return kept.select(*schemas.VAC.fieldNames())


def conform_lookup(areas: DataFrame, locations: DataFrame) -> DataFrame:
    """Area and location lookups merged into ``country_loc`` rows, one per key.

    Each side is reduced to its first row per key before the join, which leaves the
    same rows as reducing the joined ones, without multiplying repeats.
    """
    area_keys = ["fips", "admin2", "province_state", "country_region"]
    place_keys = ["country_region", "location"]
    left = first_per_key(blank_keys(lower_names(areas), area_keys), area_keys, ["source_file", "position"])
    right = first_per_key(blank_keys(lower_names(locations), place_keys), place_keys, ["source_file", "position"])
    rows = merge_lookups(left.drop(*LINEAGE), right.drop(*LINEAGE), "country_region")
    kept = blank_keys(whole_numbers(rows, ["uid", "code3", "population"]), schemas.KEYS["country_loc"])
    return kept.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schemas.COUNTRY_LOC])
