"""Event files with unequal headers, wide dummies, and the session table with many categories."""

import datetime

from pyspark.sql import functions as F

from sessionloom.operators import encode
from sessionloom.plans import whole
from sessionloom.sources import files
from sessionloom.sources.fixtures import session_events


def write(folder, name, text):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(text, encoding="utf-8")


def test_columns_are_found_by_name_in_every_file(spark, tmp_path):
    write(tmp_path, "a.csv", "event_time,event_type,product_id,category_id,user_id,user_session,session_value\n"
          "2025-06-19 10:23:07+00:00,BUY,p1,c1,u1,s1,1.5\n2025-06-19T10:23:08,VIEW,p2,c1,u1,s1,NaN\n")
    write(tmp_path, "b c.csv", '﻿user_session, event_type ,event_time,"product_id",event_type\ns2,VIEW,never,"p,3",x\ns3,BUY\n')
    write(tmp_path, "empty.csv", "")
    write(tmp_path, "head.csv", "user_id,user_session\n")
    got = sorted(map(tuple, files.read_events(spark, str(tmp_path)).collect()), key=lambda r: r[5] + r[1])
    at = datetime.datetime(2025, 6, 19, 10, 23, 7)
    assert got == [
        (at, "BUY", "p1", "c1", "u1", "s1", 1.5),
        (at.replace(second=8), "VIEW", "p2", "c1", "u1", "s1", None),
        (None, "VIEW", "p,3", None, None, "s2", None),
    ]
    report = {r["file_path"].rsplit("/", 1)[1]: r for r in files.event_file_report(spark, str(tmp_path)).collect()}
    assert report["a.csv"]["n_rows"] == 2 and report["a.csv"]["unread_session_value"] == 1
    b = report["b%20c.csv"]
    assert (b["n_rows"], b["n_rejected"], b["unread_event_time"]) == (2, 1, 1)
    assert files.read_events(spark, str(tmp_path)).select("user_session").count() == 3


def test_no_file_with_a_header_gives_no_events(spark, tmp_path):
    write(tmp_path, "empty.csv", "")
    got = files.read_events(spark, str(tmp_path))
    assert got.count() == 0 and got.schema == files.EVENT_SCHEMA


def test_wide_dummies_equal_the_narrow_ones(spark):
    rows = [(i, v) for i, v in enumerate(["b", "a", None, "c", "b"])]
    df = spark.createDataFrame(rows, "id long, v string")
    wide = encode.one_hot_vector(df, "v", "vector", fit_on=df.where("v <> 'c'"), code="place")
    got = {r["id"]: (r["vector"].toArray().tolist(), r["place"]) for r in wide.collect()}
    assert got == {0: ([0, 1], 1), 1: ([1, 0], 0), 2: ([0, 0], None), 3: ([0, 0], None), 4: ([0, 1], 1)}
    assert set(wide.columns) == {"id", "v", "vector", "place"}
    none = encode.one_hot_vector(df, "v", "vector", fit_on=df.limit(0))
    assert {tuple(r["vector"].toArray()) for r in none.collect()} == {(0.0,)}


def test_session_table_with_more_categories_than_columns(spark, monkeypatch):
    monkeypatch.setattr(whole, "NARROW", 3)
    events = session_events(spark, "/root/testdata/sf0.001")
    table = whole.session_table(events)
    assert "main_category_vector" in table.columns and not any(c.startswith("cat_") for c in table.columns)
    sizes = {(len(r["main_category_vector"]), r["main_category_vector"].numNonzeros()) for r in table.collect()}
    assert sizes == {(events.select("category_id").distinct().count(), 1)}
    assert table.select(F.count("*")).first()[0] == events.select("user_session").distinct().count()
