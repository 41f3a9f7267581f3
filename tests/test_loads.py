import csv
import datetime as dt
import os
import random
import uuid

import pytest
from conftest import plan_of, rows
from hypothesis import HealthCheck, given, settings, strategies as st
from oracle import compare
from pyspark.sql import functions as F

from epimill import schemas
from epimill.operators.shape import STAMP_CORRECTIONS, first_per_key
from epimill.plans import conform, dashboard, quality
from epimill.plans.landing import copy_reports, land_cases, land_lookup, land_vaccinations, rewrite_old_cases
from epimill.plans.reports import ORACLES, loads
from epimill.plans.update import (
    Landing,
    case_files,
    daily_update,
    load_cases,
    load_lookup,
    load_vaccinations,
    read_vaccination_totals,
)
from epimill.sinks.merge import insert_if_absent, replace_rows, upsert
from epimill.sinks.warehouse import Warehouse, in_values
from epimill.sources.csv_files import broken_rows, column_names, header_groups, read_csv_files
from epimill.sources.files import (
    choose_files,
    in_day_batches,
    in_hash_batches,
    list_files,
    names_between,
    read_batches,
    with_layout,
    with_name_containing,
)
from epimill.streaming.ingest import ingest_reports, stream_files

NEW = ["FIPS", "Admin2", "Province_State", "Country_Region", "Last_Update", "Confirmed", "Deaths", "Recovered", "Active"]
LATER = ["FIPS", "Admin2", "Province_State", "Country_Region", "Last_Update", "Lat", "Long_", "Confirmed", "Deaths", "Recovered", "Active", "Combined_Key"]
OLD = ["Province/State", "Country/Region", "Last Update", "Confirmed", "Deaths", "Recovered"]


def write(path, header, lines):
    """A CSV with an unnamed leading index, as stored by the landing job."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", newline="") as file:
        writer = csv.writer(file, lineterminator="\n")
        writer.writerow(["", *header])
        for index, line in enumerate(lines):
            writer.writerow([index, *line])


@pytest.fixture
def landing(tmp_path):
    root = str(tmp_path / "land")
    cases, old = f"{root}/daily_case_data", f"{root}/daily_case_data/old_format"
    write(f"{old}/01-22-2020.csv", OLD, [["Hubei", "China", "1/22/2020 17:00", "444", "17", "28"], ["", "France", "1/22/20 17:00", "", "", ""]])
    write(f"{cases}/03-22-2020.csv", NEW, [
        ["01001", "Autauga", "Alabama", "US", "2020-03-22 23:45:00", "12.0", "2.5", "3.5", "7"],
        ["01001", "Autauga", "Alabama", "US", "2020-03-22 23:45:00", "99", "99", "99", "99"],
        ["", "", "", "France", "2020-03-22T23:45:00", "100", "1", "0", "99"],
    ])
    write(f"{cases}/03-23-2020.csv", LATER, [
        ["", "", "", "France", "2020-03-23 23:45", "1.5", "-2.5", "130", "2", "0", "128", 'France, "main"'],
        ["01001", "Autauga", "Alabama", "US", "junk", "32.5", "-86.6", "20", "", "", "", "Autauga, Alabama, US"],
    ])
    vac = f"{root}/vaccination_data/country_data"
    header = ["location", "date", "vaccine", "source_url", "total_vaccinations", "people_vaccinated", "people_fully_vaccinated"]
    write(f"{vac}/France.csv", header, [
        ["France", "2020-03-22", "A, B", "u", "10.0", "8", "2"],
        ["France", "2020-03-22", "again", "u", "11", "9", "3"],
        ["France", "2020-03-23", "A", "u", "20", "", ""],
    ])
    write(f"{vac}/South Korea+.csv", header, [["South Korea", "2020-03-23", "A", "u", "5", "", ""]])
    write(f"{root}/UID_ISO_FIPS_LookUp_Table.csv",
          ["UID", "iso2", "iso3", "code3", "FIPS", "Admin2", "Province_State", "Country_Region", "Lat", "Long_", "Combined_Key", "Population"],
          [["250", "FR", "FRA", "250", "", "", "", "France", "46.2", "2.2", "France", "65000000"],
           ["840", "US", "USA", "840", "", "", "", "US", "40.0", "-100.0", "US", "329466283"],
           ["84001001", "US", "USA", "840", "01001", "Autauga", "Alabama", "US", "32.5", "-86.6", "Autauga, Alabama, US", "55869"],
           ["516", "NA", "NAM", "516", "", "", "", "Namibia", "", "", "Namibia", ""]])
    write(f"{root}/locations.csv", ["Country/Region", "location", "continent", "population"],
          [["France", "France", "Europe", "1"], ["US", "United States", "North America", "2"], ["Korea, South", "South Korea", "Asia", "3"]])
    write(f"{root}/vaccinations.csv", ["location", "iso_code", "date"],
          [["France", "FRA", "2020-03-22"], ["South Korea", "KOR", "2020-03-23"], ["Chile", "CHL", "2020-04-01"]])
    return Landing(root)


def test_merges(spark):
    target = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0), (None, "n", 0.0)], "k int, label string, v double")
    batch = spark.createDataFrame([(2, "x", None), (3, "c", 3.0), (None, "m", 5.0)], "k int, label string, v double")
    assert rows(upsert(target, batch, ["k"], ["v"])) == [
        (1, "a", 1.0), (2, "b", None), (3, "c", 3.0), (None, "m", 5.0), (None, "n", 0.0)
    ]
    assert rows(insert_if_absent(target, batch, ["k"])) == [(3, "c", 3.0), (None, "m", 5.0)]
    assert rows(replace_rows(target, batch, F.col("v") > 1), "label") == [("a",), ("c",), ("m",), ("n",), ("x",)]


pairs = st.dictionaries(st.integers(0, 9), st.integers(0, 99), max_size=8)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(pairs, min_size=1, max_size=3))
def test_upserts_act_like_a_dictionary(spark, batches):
    def frame(items):
        return spark.createDataFrame([(k, f"first {v}", v) for k, v in items.items()], "k int, label string, v int")

    table, labels, counts = frame({}), {}, {}
    for batch in batches:
        table = upsert(table, frame(batch), ["k"], ["v"])
        table = upsert(table, frame(batch), ["k"], ["v"])
        for k, v in batch.items():
            labels.setdefault(k, f"first {v}")
            counts[k] = v
    assert rows(table) == sorted(((k, labels[k], counts[k]) for k in counts), key=repr)


def test_tables_have_fixed_schemas(warehouse):
    for name, schema in schemas.TABLES.items():
        found = {field.name: field.dataType for field in warehouse.read(name).schema}
        assert found == {field.name: field.dataType for field in schema}
    warehouse.create_tables()


def test_stored_rows_are_found_by_a_new_catalog(spark, warehouse, landing):
    daily_update(warehouse, landing)
    before = {name: rows(warehouse.read(name)) for name in schemas.TABLES}
    for name in schemas.TABLES:
        spark.sql(f"DROP TABLE {warehouse.name(name)}")
    again = Warehouse(spark, warehouse.database)
    again.create_tables()
    assert {name: rows(again.read(name)) for name in schemas.TABLES} == before
    assert load_cases(again, landing) == 0


def test_listing_is_not_recursive_by_default(spark, landing):
    own = list_files(spark, landing.path(landing.cases))
    assert rows(own, "file_name") == [("03-22-2020.csv",), ("03-23-2020.csv",)]
    everything = list_files(spark, landing.path(landing.cases), recursive=True)
    assert rows(everything, "file_name") == [("01-22-2020.csv",), ("03-22-2020.csv",), ("03-23-2020.csv",)]
    assert rows(list_files(spark, landing.path(landing.vaccinations)), "file_name") == [("France.csv",), ("South Korea+.csv",)]
    assert rows(list_files(spark, landing.path("nowhere/"))) == []
    assert rows(list_files(spark, landing.root, "locations.csv"), "file_name") == [("locations.csv",)]


def test_choice_of_files(spark):
    files = spark.createDataFrame([("03-20-2020.csv",), ("03-21-2020.csv",), ("03-22-2020.csv",)], "file_name string")
    ledger = spark.createDataFrame([("03-21-2020.csv", "case"), ("03-22-2020.csv", "vac")], "file_name string, data_type string")
    names = lambda df: [row[0] for row in rows(df, "file_name")]
    assert names(choose_files(files, ledger, "case")) == ["03-20-2020.csv", "03-22-2020.csv"]
    assert names(choose_files(files, ledger, "case", ("2020-03-21",))) == ["03-21-2020.csv"]
    assert names(choose_files(files, ledger, "case", ("2020-03-20", "2020-03-21"))) == ["03-20-2020.csv", "03-21-2020.csv"]
    assert len(names(choose_files(files, ledger, "case", process_all=True))) == 3
    assert names(with_name_containing(files, ["20-2020"])) == ["03-20-2020.csv"]
    assert [row[0] for row in rows(names_between(spark, "2020-02-28", "2020-03-01"))] == ["02-28-2020.csv", "02-29-2020.csv", "03-01-2020.csv"]
    assert rows(with_layout(files), "layout") == [("new",), ("old",), ("old",)]


def test_headers_are_grouped_and_columns_bound_by_name(spark, landing):
    paths = [f"{landing.path(landing.cases)}{name}" for name in ("03-22-2020.csv", "03-23-2020.csv")]
    assert len(header_groups(spark, paths)) == 2
    got = read_csv_files(spark, paths, ["FIPS", "Country_Region", "Confirmed", "Missing"])
    got = got.withColumn("position", F.col("position.index"))
    assert rows(got) == [
        ("01001", "US", "12.0", None, "03-22-2020.csv", 0),
        ("01001", "US", "20", None, "03-23-2020.csv", 1),
        ("01001", "US", "99", None, "03-22-2020.csv", 1),
        (None, "France", "100", None, "03-22-2020.csv", 2),
        (None, "France", "130", None, "03-23-2020.csv", 0),
    ]
    assert column_names("\ufeffa,\"b, c\",,d") == ["a", "b, c", "_c2", "d"]


def test_named_header_is_enforced(spark, tmp_path):
    path = str(tmp_path / "03-22-2020.csv")
    with open(path, "w") as file:
        file.write("a,b\n1,2\n")
    assert rows(read_csv_files(spark, [path], ["b"], header=["a", "b"]), "b") == [("2",)]
    with pytest.raises(Exception, match="header"):
        read_csv_files(spark, [path], ["b"], header=["b", "a"]).collect()


def test_report_without_a_required_column_stops_the_load(warehouse, landing):
    header = [name if name != "Country_Region" else "Country" for name in NEW]
    write(f"{landing.path(landing.cases)}/03-24-2020.csv", header, [["", "", "", "US", "", "1", "", "", ""]])
    with pytest.raises(ValueError, match="Country_Region.*03-24-2020.csv"):
        load_cases(warehouse, landing)
    assert warehouse.read("csv_record").count() == 0


def test_quoted_line_breaks(spark, tmp_path):
    path = str(tmp_path / "a.csv")
    with open(path, "w") as file:
        file.write('a,b\n"New\nYork",2\nOhio,3\n')
    with pytest.raises(Exception, match="no row of its header in a.csv"):
        read_csv_files(spark, [path], ["a", "b"]).collect()
    assert rows(read_csv_files(spark, [path], ["a", "b"], multi_line=True), "a", "b") == [("New\nYork", "2"), ("Ohio", "3")]


WIDE = [*NEW, "Combined_Key", "Lat", "Long_"]


@pytest.mark.parametrize("broken", ["Combined_Key", "Province_State", "Long_"])
def test_rows_broken_in_any_column_stop_the_load(spark, warehouse, landing, broken):
    values = {"Province_State": "New York", "Country_Region": "US", "Last_Update": "2020-03-24 01:00:00", "Confirmed": "70", "Combined_Key": "New York, US", "Lat": "1", "Long_": "2"}
    texts = [values | {broken: "New\nYork"}, values | {"Province_State": "Ohio", "Confirmed": "9"}]
    path = f"{landing.path(landing.cases)}/03-24-2020.csv"
    write(path, WIDE, [[t.get(name, "") for name in WIDE] for t in texts])
    with pytest.raises(Exception, match="no row of its header in 03-24-2020.csv"):
        load_cases(warehouse, landing)
    assert warehouse.read("daily_case").isEmpty() and warehouse.read("csv_record").isEmpty()
    assert broken_rows(spark, [path]).where("text LIKE 'York\"%'").count() == 1
    with pytest.raises(Exception, match="no row of its header"):  # whatever is read of it
        read_csv_files(spark, [path], ["Confirmed"]).select("Confirmed").collect()
    with pytest.raises(Exception, match="no row of its header"):
        copy_reports(spark, [path], f"{landing.root}/copied")
    load_cases(warehouse, landing, dates=("2020-03-24", "2020-03-24"), multi_line=True)
    assert sorted(row[0] for row in warehouse.read("daily_case").select("confirmed").collect()) == [9, 70]


def test_rows_broken_in_unread_columns_of_other_files_stop(spark, warehouse, landing):
    header = ["location", "date", "vaccine", "source_url", "total_vaccinations", "people_vaccinated", "people_fully_vaccinated"]
    write(f"{landing.path(landing.vaccinations)}France.csv", header, [["France", "2021-01-01", "x", "http://a\nb", "1", "1", "0"]])
    with pytest.raises(Exception, match="no row of its header in France.csv"):
        load_vaccinations(warehouse, landing)
    write(landing.path(landing.vaccination_totals), ["location", "iso_code", "date", "x"], [["France", "F\nR", "2021-01-01", "1"]])
    with pytest.raises(Exception, match="no row of its header in vaccinations.csv"):
        read_vaccination_totals(spark, landing).collect()
    write(landing.path(landing.locations), ["Country/Region", "location", "source", "continent"], [["France", "France", "a\nb", "Europe"]])
    with pytest.raises(Exception, match="no row of its header in locations.csv"):
        read_csv_files(spark, [landing.path(landing.locations)], ["location"]).select("location").collect()


def test_the_stream_query_sees_faults(spark, monkeypatch):
    sf_dir, whole = "/root/testdata/sf0.001", loads.ingest_reports

    def forgetful(warehouse, files, checkpoint):
        return whole(warehouse, files, f"{checkpoint}-{uuid.uuid4().hex}")

    monkeypatch.setattr(loads, "ingest_reports", forgetful)
    with pytest.raises(RuntimeError, match="read again"):
        loads.stream_ingest(spark, sf_dir)
    monkeypatch.setattr(loads, "ingest_reports", whole)
    one_by_one = Warehouse.upsert
    monkeypatch.setattr(Warehouse, "upsert", lambda self, table, batch, source=None, whole_rows=False: one_by_one(self, table, batch, source))
    assert compare(spark, sf_dir, "stream_ingest", loads.stream_ingest, ORACLES["stream_ingest"]) != ""


def test_rows_of_parts_without_an_index_are_ordered_by_part(spark, tmp_path):
    report = tmp_path / "report=03-22-2020.csv"
    os.makedirs(report)
    with open(report / "part-0.csv", "w") as file:
        file.write("a,b\nk,1\n")
    with open(report / "part-1.csv", "w") as file:
        file.write("a,b\nk,2\n" + "x,9\n" * 50_000)
    found = first_per_key(read_csv_files(spark, [str(report)], ["a", "b"]), ["a"], ["source_file", "position"])
    assert rows(found, "a", "b") == [("k", "1"), ("x", "9")]


def test_unreadable_counts_are_reported(spark):
    raw = spark.createDataFrame([("1,234", "5"), ("7.0", " "), (None, "many")], "Confirmed string, Deaths string")
    found = rows(quality.check_unreadable(raw, ["Confirmed", "Deaths"]), "direction", "value")
    assert found == [("Confirmed", "1,234"), ("Deaths", "many")]


class Lost(Exception):
    pass


@pytest.mark.parametrize("step", ["_commit", "_switch"])
def test_readers_see_old_or_new_rows_and_a_lost_driver_loses_none(spark, warehouse, landing, monkeypatch, step):
    load_cases(warehouse, landing)
    before = rows(warehouse.read("daily_case"))
    in_hand = warehouse.read("daily_case").where("country_region = 'France'")
    in_hand.schema, in_hand.explain  # planned before the load
    kept = rows(in_hand)
    write(f"{landing.path(landing.cases)}/03-24-2020.csv", NEW, [["", "", "", "US", "2020-03-24 01:00:00", "50", "", "", ""]])
    write(f"{landing.path(landing.cases)}/03-22-2020.csv", NEW, [["", "", "", "France", "2020-03-22 23:45:00", "777", "", "", ""]])
    whole = getattr(Warehouse, step)

    def lost(self, table, *rest):
        if table == "daily_case":
            raise Lost
        return whole(self, table, *rest)

    monkeypatch.setattr(Warehouse, step, lost)
    with pytest.raises(Lost):
        load_cases(warehouse, landing, dates=("2020-03-22", "2020-03-24"))
    assert rows(warehouse.read("daily_case")) == before
    monkeypatch.undo()
    if step == "_switch":  # committed: a new catalog finds the new rows
        spark.sql(f"DROP TABLE {warehouse.name('daily_case')}")
        warehouse.create_tables()
        assert warehouse.read("daily_case").count() == len(before) + 1
        assert (777,) in rows(warehouse.read("daily_case"), "confirmed")
    load_cases(warehouse, landing, dates=("2020-03-22", "2020-03-24"))
    assert warehouse.read("daily_case").count() == len(before) + 1
    assert (777,) in rows(warehouse.read("daily_case"), "confirmed")
    assert rows(in_hand) == kept  # its files are still there


def test_stream_does_not_depend_on_the_order_of_parts(spark, warehouse, tmp_path):
    report, check = str(tmp_path / "in/report=03-22-2020.csv"), str(tmp_path / "check")
    late = [["", "", "", "France", "2020-03-22 09:00:00", "900", "", "", ""]]
    early = [["", "", "", "France", "2020-03-22 01:00:00", "100", "", "", ""]]
    write(f"{report}/part-1.csv", NEW, [[], late[0]][1:])
    with open(f"{report}/part-1.csv") as file:
        text = file.read().replace("\n0,", "\n7,")
    with open(f"{report}/part-1.csv", "w") as file:
        file.write(text)
    ingest_reports(warehouse, stream_files(spark, str(tmp_path / "in"), "new"), check)
    assert rows(warehouse.read("daily_case"), "confirmed") == [(900,)]
    write(f"{report}/part-0.csv", NEW, early)
    ingest_reports(warehouse, stream_files(spark, str(tmp_path / "in"), "new"), check)
    assert rows(warehouse.read("daily_case"), "confirmed", "last_update") == [(100, "2020-03-22 01:00:00")]


def test_landing_by_name_refuses_two_files(spark, landing):
    write(f"{landing.root}/again/locations.csv", ["Country/Region", "location", "continent"], [["a", "b", "c"]])
    with pytest.raises(ValueError, match="several files"):
        land_lookup(spark, landing.root, "locations.csv", landing.path("copy.csv"))


def test_case_load(warehouse, landing):
    assert load_cases(warehouse, landing) == 3
    got = rows(warehouse.read("daily_case"), "fips", "province_state", "country_region", "date_string", "last_update", "confirmed", "deaths", "recovered", "active")
    assert got == [
        ("", "", "France", "2020-01-22", "1/22/20 17:00", None, None, None, None),
        ("", "", "France", "2020-03-22", "2020-03-22T23:45:00", 100, 1, 0, 99),
        ("", "", "France", "2020-03-23", "2020-03-23 23:45", 130, 2, 0, 128),
        ("", "Hubei", "China", "2020-01-22", "1/22/2020 17:00", 444, 17, 28, None),
        ("01001", "Alabama", "US", "2020-03-22", "2020-03-22 23:45:00", 12, 2, 4, 7),
        ("01001", "Alabama", "US", "2020-03-23", "junk", 20, None, None, None),
    ]
    assert rows(warehouse.read("daily_case"), "date_case")[0] == (dt.date(2020, 1, 22),)
    assert rows(warehouse.read("dim_time"), "last_update", "date_string", "hour", "weekday") == [
        ("2020-01-22 17:00:00", "2020-01-22", 17, 2),
        ("2020-03-22 23:45:00", "2020-03-22", 23, 6),
        ("2020-03-23 23:45:00", "2020-03-23", 23, 0),
    ]
    assert rows(warehouse.read("csv_record"), "file_name", "data_type") == [
        ("01-22-2020.csv", "case"), ("03-22-2020.csv", "case"), ("03-23-2020.csv", "case")
    ]
    before = rows(warehouse.read("daily_case"))
    assert load_cases(warehouse, landing) == 0
    assert load_cases(warehouse, landing, process_all=True) == 3
    assert rows(warehouse.read("daily_case")) == before


def test_reprocessed_file_updates_measures_only(warehouse, landing):
    load_cases(warehouse, landing)
    write(f"{landing.path(landing.cases)}/03-23-2020.csv", NEW, [
        ["", "", "", "France", "2020-05-25 01:00:00", "120", "9", "1", "5"],
        ["", "", "", "Chile", "2020-05-25 01:00:00", "7", "0", "0", "7"],
    ])
    assert load_cases(warehouse, landing, dates=("2020-03-23",)) == 1
    got = rows(warehouse.read("daily_case").where("date_string = '2020-03-23'"), "country_region", "last_update", "confirmed", "deaths")
    assert got == [("Chile", "2020-05-25 01:00:00", 7, 0), ("France", "2020-03-23 23:45", 120, 9), ("US", "junk", 20, None)]
    assert warehouse.read("daily_case").where("date_string = '2020-03-22'").count() == 2


def test_reload_country_drops_emptied_days(warehouse, landing):
    load_cases(warehouse, landing)
    # China is alone with France on the first day; its file no longer has it.
    write(f"{landing.path(landing.old_cases)}/01-22-2020.csv", OLD, [["", "France", "1/22/20 17:00", "3", "", ""]])
    load_cases(warehouse, landing, dates=("2020-01-22",), reload_country="China")
    load_cases(warehouse, landing, dates=("2020-01-01", "2020-03-23"), reload_country="France")
    got = rows(warehouse.read("daily_case"), "country_region", "date_string", "confirmed")
    assert got == [
        ("France", "2020-01-22", 3), ("France", "2020-03-22", 100), ("France", "2020-03-23", 130),
        ("US", "2020-03-22", 12), ("US", "2020-03-23", 20),
    ]
    write(f"{landing.path(landing.old_cases)}/01-22-2020.csv", OLD, [])
    load_cases(warehouse, landing, dates=("2020-01-22",), reload_country="France")
    assert warehouse.read("daily_case").where("date_string = '2020-01-22'").count() == 0
    assert not os.path.exists(f"{warehouse.location.removeprefix('file:')}/daily_case/date_case=2020-01-22")


def test_reload_without_dates_clears_the_country(warehouse, landing):
    load_cases(warehouse, landing)
    os.makedirs(landing.path(landing.cases), exist_ok=True)
    write(f"{landing.path(landing.cases)}/03-24-2020.csv", NEW, [["", "", "", "US", "2020-03-24 01:00:00", "50", "", "", ""]])
    load_cases(warehouse, landing, reload_country="US")
    got = rows(warehouse.read("daily_case").where("country_region = 'US'"), "date_string", "confirmed")
    assert got == [("2020-03-22", 12), ("2020-03-23", 20), ("2020-03-24", 50)]
    assert warehouse.read("daily_case").count() == 7


@pytest.mark.parametrize("size, batches", [(1, [["a", "b", "c"], ["d"], ["e"]]), (3, [["a", "b", "c"], ["d", "e"]]), (9, [["a", "b", "c", "d", "e"]])])
def test_batches_hold_whole_days_in_order(spark, size, batches):
    days = {"a": 1, "b": 1, "c": 1, "d": 2, "e": 4}
    reports = spark.createDataFrame([(name, dt.date(2020, 3, day)) for name, day in days.items()], "report_path string, file_date date")
    got = [[row["report_path"] for row in chosen] for chosen in read_batches(in_day_batches(reports, size))]
    assert got == batches
    assert list(read_batches(in_day_batches(reports.limit(0), size))) == []


def test_hash_batches_keep_every_report_and_equal_names_together(spark):
    reports = spark.createDataFrame([(f"{folder}/{i}", str(i)) for i in range(40) for folder in "xy"], "report_path string, file_name string")
    got = [{row["report_path"] for row in chosen} for chosen in read_batches(in_hash_batches(reports, 20))]
    assert len(got) == 4 and sum(map(len, got)) == 80
    assert all(f"y/{path[2:]}" in batch for batch in got for path in batch)


def test_load_in_batches_goes_on_where_it_stopped(warehouse, landing):
    """Batches before a broken one are stored and booked; the repeated load takes the others."""
    path = f"{landing.path(landing.cases)}/03-23-2020.csv"
    with open(path) as file:
        whole = file.read()
    with open(path, "a") as file:
        file.write("8,torn\n")
    with pytest.raises(Exception, match="no row of its header"):
        load_cases(warehouse, landing, reports_per_batch=1)
    assert rows(warehouse.read("csv_record"), "file_name") == [("01-22-2020.csv",), ("03-22-2020.csv",)]
    assert warehouse.read("daily_case").where("date_string = '2020-03-23'").count() == 0
    with open(path, "w") as file:
        file.write(whole)
    assert load_cases(warehouse, landing, reports_per_batch=1) == 1
    assert warehouse.read("daily_case").count() == 6


@pytest.mark.parametrize("dates", [None, ("2020-01-01", "2020-04-30")])
def test_reload_in_batches_clears_days_between_and_after_the_reports(warehouse, landing, dates):
    for day in ("03-25-2020", "04-01-2020", "04-20-2020"):
        write(f"{landing.path(landing.cases)}/{day}.csv", NEW, [["", "", "", "US", f"{day} 01:00:00", "50", "", "", ""]])
    load_cases(warehouse, landing)
    for day in ("03-25-2020", "04-20-2020"):
        os.remove(f"{landing.path(landing.cases)}/{day}.csv")
    open(f"{landing.path(landing.cases)}/03-22-2020.csv", "w").close()  # a batch of an empty file alone
    load_cases(warehouse, landing, dates=dates, reload_country="US", reports_per_batch=1)
    got = rows(warehouse.read("daily_case").where("country_region = 'US'"), "date_string", "confirmed")
    assert got == [("2020-03-23", 20), ("2020-04-01", 50)]


def test_landing_in_batches(spark, landing, tmp_path):
    target = Landing(str(tmp_path / "other"))
    source = landing.path(landing.cases)
    assert land_cases(spark, source, target, reports_per_batch=1) == 3
    assert land_cases(spark, source, target) == 0
    found = {row["file_name"] for row in case_files(spark, target).collect()}
    assert found == {"01-22-2020.csv", "03-22-2020.csv", "03-23-2020.csv"}


def test_file_read_for_one_country_is_loaded_for_the_others_later(warehouse, landing):
    load_cases(warehouse, landing, dates=("2020-03-22",), reload_country="US")
    assert rows(warehouse.read("daily_case"), "country_region") == [("US",)]
    assert warehouse.read("csv_record").count() == 0
    assert load_cases(warehouse, landing) == 3
    assert warehouse.read("daily_case").count() == 6


def test_corrections_apply_on_load(warehouse, landing):
    write(f"{landing.path(landing.cases)}/06-01-2021.csv", NEW, [["", "", "Nebraska", "US", "2021-06-01 04:00:00", "1", "1", "1", "1"]])
    load_cases(warehouse, landing, dates=("2021-06-01",), corrections=STAMP_CORRECTIONS)
    assert rows(warehouse.read("daily_case"), "last_update", "date_string") == [("2021-06-02 04:00:00", "2021-06-01")]


def test_vaccination_load(warehouse, landing):
    assert load_vaccinations(warehouse, landing) == 2
    got = rows(warehouse.read("vac"), "location", "date_string", "vaccine", "total_vaccinations", "people_vaccinated")
    assert got == [
        ("France", "2020-03-22", "A, B", 10, 8), ("France", "2020-03-23", "A", 20, None), ("South Korea", "2020-03-23", "A", 5, None)
    ]
    # The file is rewritten in place: the old day changes, a new one comes.
    write(f"{landing.path(landing.vaccinations)}/France.csv",
          ["location", "date", "vaccine", "source_url", "total_vaccinations", "people_vaccinated", "people_fully_vaccinated"],
          [["France", "2020-03-23", "B", "u", "21", "9", "3"], ["France", "2020-04-01", "B", "u", "30", "9", "3"]])
    assert load_vaccinations(warehouse, landing) == 2
    assert load_vaccinations(warehouse, landing, process_all=False) == 0
    got = rows(warehouse.read("vac").where("location = 'France'"), "date_string", "vaccine", "total_vaccinations")
    assert got == [("2020-03-22", "A, B", 10), ("2020-03-23", "B", 21), ("2020-04-01", "B", 30)]
    assert "date_month" not in warehouse.read("vac").columns


def test_lookup_load_never_changes_old_rows(warehouse, landing):
    load_lookup(warehouse, landing)
    got = rows(warehouse.read("country_loc"), "country_region", "location", "uid", "iso2", "fips", "population", "continent")
    assert got == [
        ("France", "France", 250, "FR", "", 65000000, "Europe"),
        ("Korea, South", "South Korea", None, None, "", None, "Asia"),
        ("Namibia", "", 516, "NA", "", None, None),
        ("US", "United States", 840, "US", "", 329466283, "North America"),
        ("US", "United States", 84001001, "US", "01001", 55869, "North America"),
    ]
    write(landing.path(landing.locations), ["Country/Region", "location", "continent"], [["France", "France", "changed"], ["Chile", "Chile", "South America"]])
    load_lookup(warehouse, landing)
    after = rows(warehouse.read("country_loc"), "country_region", "location", "continent")
    assert ("France", "France", "Europe") in after
    assert ("Chile", "Chile", "South America") in after


def test_daily_update_checks_and_dashboard(warehouse, landing):
    assert daily_update(warehouse, landing) == {"case_files": 3, "vaccination_files": 2}
    found = rows(quality.check_all(warehouse, landing))
    assert ("dates", "not in vac", "2020-04-01") in found
    assert ("locations", "not in vac", "Chile") in found
    assert ("locations", "not in csv_record", "South Korea") in found
    assert ("countries", "not in daily_case", "Namibia") in found
    assert not [row for row in found if row[0] == "unique key"]
    os.remove(f"{landing.path(landing.cases)}/03-22-2020.csv")
    write(f"{landing.path(landing.cases)}/03-25-2020.csv", NEW, [])
    found = rows(quality.check_all(warehouse, landing))
    assert ("case files", "only in csv_record", "03-22-2020.csv") in found
    assert ("case files", "only in files", "03-25-2020.csv") in found

    tables = [warehouse.read(name) for name in ("daily_case", "vac", "country_loc")]
    series = dashboard.adjusted_series(dashboard.combine(*tables))
    got = rows(dashboard.latest_status(series), "country_region", "date_string", "past_week_daily_cases", "adjusted_people_vaccinated", "vac_class")
    # First day: no counts; second: change from null is 0; third: 30.
    assert got == [("France", "2020-03-23", 10.0, 10.0, "total_only")]
    chart = rows(dashboard.latest_chart(dashboard.latest_status(series)), "continent", "country_region", "colour")
    assert chart == [("Europe", "France", "blue")]


def test_queries_in_plain_sql_run_on_the_tables(spark, warehouse, landing):
    load_cases(warehouse, landing)
    table = warehouse.name("daily_case")
    got = spark.sql(f"SELECT Country_Region AS c, sum(Confirmed) AS n FROM {table} WHERE date_string > '2020-03-22' GROUP BY c")
    assert rows(got) == [("France", 130), ("US", 20)]


def test_stream_reads_each_file_once(spark, warehouse, tmp_path):
    folder, checkpoint = str(tmp_path / "in"), str(tmp_path / "check")

    def run():
        ingest_reports(warehouse, stream_files(spark, folder, "new", max_files=1), checkpoint)

    write(f"{folder}/03-22-2020.csv", NEW, [["", "", "", "France", "2020-03-22 23:45:00", "100", "", "", ""]])
    write(f"{folder}/03-23-2020.csv", LATER, [
        ["", "", "", "France", "2020-03-23 23:45:00", "1", "2", "130", "", "", "", ""]
    ])
    run()
    write(f"{folder}/03-24-2020.csv", NEW, [["", "", "", "France", "2020-03-24 23:45:00", "120", "", "", ""]])
    run()
    # A rewritten file is not met again.
    write(f"{folder}/03-22-2020.csv", NEW, [["", "", "", "France", "2020-03-22 23:45:00", "999", "", "", ""]])
    run()
    assert rows(warehouse.read("daily_case"), "date_string", "confirmed") == [
        ("2020-03-22", 100), ("2020-03-23", 130), ("2020-03-24", 120)
    ]
    assert warehouse.read("csv_record").count() == 3
    assert warehouse.read("dim_time").count() == 3


def test_stream_judges_a_report_as_one(spark, warehouse, tmp_path):
    folder = str(tmp_path / "in")
    report = f"{folder}/report=03-22-2020.csv"
    write(f"{report}/part-1.csv", NEW, [["", "", "", "France", "2020-03-22 23:45:00", "100", "", "", ""]])
    with open(f"{report}/part-0.csv", "w") as file:
        file.write(",".join(["", *NEW]) + "\n5,,,,France,2020-03-22 23:45:00,999,,,\n")
    for part, age in (("part-1.csv", 1000), ("part-0.csv", 500)):
        path = f"{report}/{part}"
        os.utime(path, (os.stat(path).st_mtime - age,) * 2)
    ingest_reports(warehouse, stream_files(spark, folder, "new", max_files=1), str(tmp_path / "check"))
    assert rows(warehouse.read("daily_case"), "confirmed") == [(100,)]


def test_stream_stops_at_another_header(spark, warehouse, tmp_path):
    folder = str(tmp_path / "in")
    os.makedirs(folder)
    with open(f"{folder}/03-22-2020.csv", "w") as file:
        file.write("Confirmed,Country_Region\n1,France\n")
    files = stream_files(spark, folder, "new")
    with pytest.raises(Exception, match="header"):
        ingest_reports(warehouse, files, str(tmp_path / "check"), headers={"new": ["Country_Region", "Confirmed"]})


def test_checks_see_blank_and_null(spark):
    areas = spark.createDataFrame([("France", None), ("US", "Ohio"), ("Chile", "Ohio")], "country_region string, province_state string")
    table = spark.createDataFrame([("France", ""), (None, None)], "country_region string, province_state string")
    assert rows(quality.check_areas(areas, table, "t")) == [
        ("countries", "not in t", "Chile"), ("countries", "not in t", "US"), ("provinces", "not in t", "Ohio")
    ]
    lookup = spark.createDataFrame([("France", ""), ("France", None), ("US", ""), ("US", "Ohio")], "country_region string, province_state string")
    assert rows(quality.check_fan_out(lookup), "value") == [("France",)]


def test_landing_from_a_source_folder(spark, warehouse, landing, tmp_path):
    copy = Landing(str(tmp_path / "copy"))
    assert land_cases(spark, landing.path(landing.cases), copy) == 3
    assert land_cases(spark, landing.path(landing.cases), copy) == 0
    assert land_cases(spark, landing.path(landing.cases), copy, ("2020-03-22", "2020-03-23")) == 2
    assert rows(list_files(spark, copy.path(copy.old_cases)), "file_name") == [("01-22-2020.csv",)]
    write(f"{landing.path(landing.vaccinations)}/Cote d'Ivoire.csv", ["location", "date", "vaccine", "total_vaccinations", "people_vaccinated", "people_fully_vaccinated"],
          [["Cote d'Ivoire", "2020-03-23", "A", "3", "", ""]])
    assert land_vaccinations(spark, landing.path(landing.vaccinations), copy) == 3
    assert land_vaccinations(spark, landing.path(landing.vaccinations), copy) == 3
    for name in (landing.areas, landing.locations):
        assert land_lookup(spark, landing.root, name, copy.path(name))
    assert not land_lookup(spark, landing.root, "nowhere.csv", copy.path("nowhere.csv"))
    assert daily_update(warehouse, copy) == {"case_files": 3, "vaccination_files": 3}
    assert warehouse.read("daily_case").count() == 6
    assert warehouse.read("vac").count() == 4
    assert warehouse.read("country_loc").count() == 5
    recorded = rows(warehouse.read("csv_record").where("data_type = 'vac'"), "file_name")
    assert recorded == [("Cote d'Ivoire.csv",), ("France.csv",), ("South Korea+.csv",)]


def test_old_reports_rewritten_with_new_names(spark, landing):
    target = landing.path("rewritten")
    rewrite_old_cases(spark, landing, target)
    paths = [row[0] for row in list_files(spark, target).select("report_path").collect()]
    ((names, _),) = header_groups(spark, paths)
    assert names == ["_c0", "Province_State", "Country_Region", "Last_Update", "Confirmed", "Deaths", "Recovered"]


def test_chart_choices():
    assert dashboard.chart_columns("Percentage", "Per 100K") == (
        "percent_adjusted_people_vaccinated", "past_week_daily_cases_per_100k"
    )
    assert dashboard.chart_columns("Absolute", "Absolute") == ("adjusted_people_vaccinated", "past_week_daily_cases")
    assert dashboard.chart_selection("Continent", ["France"], ["Asia"]) == ("all", ["Asia"])
    assert dashboard.chart_selection("Country", ["France"], ["Asia"]) == (["France"], "all")
    assert dashboard.chart_selection("Country", [], None) == ("all", "all")


def test_case_file_without_a_date_is_an_error(warehouse, landing):
    write(f"{landing.path(landing.cases)}/notes.csv", NEW, [["", "", "", "France", "junk", "1", "", "", ""]])
    with pytest.raises(ValueError, match="notes.csv"):
        load_cases(warehouse, landing)
    assert warehouse.read("daily_case").count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_loads_act_like_a_dictionary_of_first_rows(warehouse, tmp_path, seed):
    """Random reports with repeated keys, loaded in steps and partly again."""
    draw = random.Random(seed)
    landing = Landing(str(tmp_path / "land"))
    days = ["03-20-2020", "03-21-2020", "03-22-2020", "03-23-2020"]
    stored = {}

    def land(day):
        old = day < "03-22-2020"
        lines, first = [], {}
        for _ in range(draw.randint(1, 12)):
            province, country = draw.choice(["", "P", "Q"]), draw.choice(["A", "B", "C"])
            stamp, counts = f"3/{draw.randint(1, 28)}/20 {draw.randint(0, 23)}:00", [draw.randint(0, 99) for _ in "abc"]
            texts = [f"{count}.0" if draw.random() < 0.8 else "" for count in counts]
            lines.append([province, country, stamp, *texts] if old else ["", "", province, country, stamp, *texts, ""])
            numbers = tuple(int(float(text)) if text else None for text in texts)
            first.setdefault((province, country), (stamp, numbers))
        folder = landing.path(landing.old_cases if old else landing.cases)
        write(f"{folder}/{day}.csv", OLD if old else NEW, lines)
        for key, (stamp, numbers) in first.items():
            kept = stored.get((day, *key), (stamp,))[0]
            stored[(day, *key)] = (kept, numbers)

    for day in days[:3]:
        land(day)
    load_cases(warehouse, landing)
    land(days[3])
    load_cases(warehouse, landing)
    land(days[1])
    load_cases(warehouse, landing, dates=("2020-03-21",))
    found = {}
    for row in warehouse.read("daily_case").collect():
        day = row["date_case"].strftime("%m-%d-%Y")
        assert (day, row["province_state"], row["country_region"]) not in found
        counts = (row["confirmed"], row["deaths"], row["recovered"])
        found[day, row["province_state"], row["country_region"]] = (row["last_update"], counts)
    assert found == stored


def test_vaccination_rows_without_a_date_are_kept_and_reported(warehouse, landing):
    header = ["location", "date", "vaccine", "total_vaccinations", "people_vaccinated", "people_fully_vaccinated"]
    path = f"{landing.path(landing.vaccinations)}/France.csv"
    write(path, header, [["France", "soon", "A", "1", "", ""], ["France", "2020-03-22", "A", "2", "", ""]])
    load_vaccinations(warehouse, landing)
    write(path, header, [["France", "soon", "A", "3", "", ""]])
    load_vaccinations(warehouse, landing)
    got = rows(warehouse.read("vac").where("location = 'France'"), "date_org", "date_string", "total_vaccinations")
    assert got == [("2020-03-22", "2020-03-22", 2), ("soon", None, 3)]
    assert rows(quality.check_unread_dates(warehouse.read("vac"))) == [("dates", "not a date", "soon")]


def test_upsert_shuffles_each_side_once_and_prunes_partitions(warehouse):
    stage = warehouse.read("daily_case").selectExpr("*", "'new' AS layout", "uuid() AS source_file", "rand() AS position")
    day = warehouse.stored("daily_case").where(in_values("date_case", [dt.date(2020, 1, 22), None]))
    keys, update = schemas.KEYS["daily_case"], schemas.UPDATE_COLUMNS["daily_case"]
    plan = plan_of(upsert(day, conform.first_cases(stage), keys, update))
    assert plan.count("Exchange") == 2
    assert "PartitionFilters: [((date_case" in plan or "PartitionFilters: [(date_case" in plan
