"""Warehouse schemas, unique keys and source header names."""

from __future__ import annotations

from pyspark.sql import types as T

# Table columns, types and unique keys.
DAILY_CASE = T.StructType(
    [
        T.StructField("fips", T.StringType()),
        T.StructField("admin2", T.StringType()),
        T.StructField("province_state", T.StringType()),
        T.StructField("country_region", T.StringType()),
        T.StructField("date_string", T.StringType()),
        T.StructField("last_update", T.StringType()),
        T.StructField("confirmed", T.IntegerType()),
        T.StructField("deaths", T.IntegerType()),
        T.StructField("recovered", T.IntegerType()),
        T.StructField("active", T.IntegerType()),
        T.StructField("date_case", T.DateType()),
    ]
)
VAC = T.StructType(
    [
        T.StructField("location", T.StringType()),
        T.StructField("date_string", T.StringType()),
        T.StructField("date_org", T.StringType()),
        T.StructField("vaccine", T.StringType()),
        T.StructField("total_vaccinations", T.LongType()),
        T.StructField("people_vaccinated", T.LongType()),
        T.StructField("people_fully_vaccinated", T.LongType()),
    ]
)
COUNTRY_LOC = T.StructType(
    [
        T.StructField("country_region", T.StringType()),
        T.StructField("location", T.StringType()),
        T.StructField("uid", T.IntegerType()),
        T.StructField("iso2", T.StringType()),
        T.StructField("iso3", T.StringType()),
        T.StructField("code3", T.IntegerType()),
        T.StructField("fips", T.StringType()),
        T.StructField("admin2", T.StringType()),
        T.StructField("province_state", T.StringType()),
        T.StructField("combined_key", T.StringType()),
        T.StructField("lat", T.FloatType()),
        T.StructField("long_", T.FloatType()),
        T.StructField("population", T.IntegerType()),
        T.StructField("continent", T.StringType()),
    ]
)
DIM_TIME = T.StructType(
    [
        T.StructField("last_update", T.StringType()),
        T.StructField("date_string", T.StringType()),
        T.StructField("hour", T.IntegerType()),
        T.StructField("day", T.IntegerType()),
        T.StructField("week", T.IntegerType()),
        T.StructField("month", T.IntegerType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("weekday", T.IntegerType()),
    ]
)
CSV_RECORD = T.StructType(
    [
        T.StructField("file_name", T.StringType()),
        T.StructField("last_update", T.StringType()),
        T.StructField("data_type", T.StringType()),
    ]
)

TABLES = {
    "daily_case": DAILY_CASE,
    "vac": VAC,
    "country_loc": COUNTRY_LOC,
    "dim_time": DIM_TIME,
    "csv_record": CSV_RECORD,
}
KEYS = {
    "daily_case": ["fips", "admin2", "province_state", "country_region", "date_string"],
    "vac": ["location", "date_org"],
    "country_loc": ["fips", "admin2", "province_state", "country_region", "location"],
    "dim_time": ["last_update"],
    "csv_record": ["file_name", "data_type"],
}
UPDATE_COLUMNS = {
    "daily_case": ["confirmed", "deaths", "recovered", "active"],
    "vac": ["vaccine", "total_vaccinations", "people_vaccinated", "people_fully_vaccinated"],
    "csv_record": ["last_update"],
}
# Our choice: the column each table is stored by. Loads rewrite only the
# partitions a batch touches; tables without one are only ever appended to. Case
# reports come by the day. Vaccination rows are few per day, so they are stored by
# month, in a column that only storage knows.
PARTITIONS = {"daily_case": "date_case", "vac": "date_month", "csv_record": "data_type"}
STORAGE_COLUMNS = {"vac": ("date_month", "substring(date_string, 1, 7)")}

# Header names of the older daily reports and of the lookups.
RENAMES = {
    "Province/State": "Province_State",
    "Country/Region": "Country_Region",
    "Last Update": "Last_Update",
    "Latitude": "Lat",
    "Longitude": "Long_",
}
CASE_MEASURES = ["confirmed", "deaths", "recovered", "active"]
VAC_MEASURES = ["total_vaccinations", "people_vaccinated", "people_fully_vaccinated"]
