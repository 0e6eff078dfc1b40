"""Small hand tables for the places where results are easily wrong."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sessionloom.functions import moments, ratios, texts
from sessionloom.functions.fixed_values import AMOUNT_EXCEPTIONS, UNIVERSITY_GRADE_EXCEPTIONS
from sessionloom.operators import columns, encode, lookup, sessions
from sessionloom.plans import whole
from sessionloom.sources import files


def values(df, column):
    return [row[column] for row in df.collect()]


def one(spark, rows, schema, expression):
    df = spark.createDataFrame([(i, *([r] if not isinstance(r, tuple) else r)) for i, r in enumerate(rows)], "i int, " + schema)
    return values(df.select("i", expression.alias("x")).orderBy("i"), "x")


def test_two_digit_years_and_bounds(spark):
    texts_ = ["12-May-94", "03/27/01 00:00", "Kasım 1999", "1985-01-01", "12-May-68", "x", None, " 2001 "]
    got = one(spark, texts_, "t string", moments.parse_year("t"))
    assert got == [1994, 2001, 1999, None, None, None, None, 2001]


def test_day_parts_differ(spark):
    hours = list(range(24))
    got = {p: one(spark, hours, "h int", moments.day_part("h", p)) for p in moments.DAY_PARTS}
    assert got["right_closed"][6] == "gece" and got["right_closed"][7] == "sabah"
    assert got["right_closed"][18] == "oglen" and got["right_closed"][19] == "aksam"
    assert got["left_closed"][6] == 0 and got["left_closed"][5] == 3 and got["left_closed"][18] == 2
    assert got["named"][21] == "evening" and got["named"][22] == "night"
    assert got["shifted"][4] == 3 and got["shifted"][17] == 2 and got["shifted"][21] == 3


def test_time_arithmetic_ignores_the_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        a, b = dt.datetime(2024, 3, 10, 1, 0), dt.datetime(2024, 3, 10, 4, 0, 0, 5)
        got = one(
            spark, [(a, b)], "a timestamp_ntz, b timestamp_ntz",
            moments.seconds_between(F.col("a"), F.col("b")),
        )
        assert got == [10800.000005]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_bad_timestamps_become_null(spark):
    got = one(spark, ["2024-01-01 10:00:00", "nope", None], "t string", moments.parse_time("t"))
    assert got == [dt.datetime(2024, 1, 1, 10), None, None]


def test_text_folding(spark):
    given = ["İSTANBUL Çğışöü", "Straße & Æon", "  A\t b1 ", "", None]
    plain = one(spark, given, "t string", texts.normalize_text("t"))
    assert plain == ["istanbul cgisou", "strasse  aeon", "  a\t b ", "", None]
    collapsed = one(spark, given, "t string", texts.normalize_text("t", collapse=True))
    assert collapsed == ["istanbul cgisou", "strasse aeon", "a b", "bilinmiyor", "bilinmiyor"]


def test_missing_text_has_no_words_unless_legacy(spark):
    assert one(spark, [None, " a bb  ccc "], "t string", texts.word_total("t")) == [0, 3]
    assert one(spark, [None], "t string", texts.word_total("t", legacy=True)) == [1]
    assert one(spark, [None], "t string", texts.long_words("t", 9, legacy=True)) == [1]
    assert one(spark, [None], "t string", texts.long_words("t", 10, legacy=True)) == [0]


def test_amounts(spark):
    given = {
        "300 TL": 300, "500TL, 300TL": 800, "300-400": 350, "400,00 TL": 400, "1000.00 TL": 1000,
        "420,geri ödemeli": 420, "600 okul,200 LCW": 800, "650TL + 400 TL": 1050, "560?": 560,
        "500 TL - 300 TL": 800, "Tam Burslu olduğum için yalnız eğitim ücreti ek burs almıyorum": 0,
        "400, 425": 825, **AMOUNT_EXCEPTIONS,
    }
    assert one(spark, list(given), "t string", texts.money_amount("t")) == [float(v) for v in given.values()]
    assert one(spark, [None], "t string", texts.money_amount("t")) == [0.0]


def test_grades(spark):
    given = {
        "4.0-3.5": 3.75, "3.50-3": 3.25, "2.50 -3.00": 2.75, "2.00 - 2.50": 2.25, "1.00 - 2.50": 1.75,
        "Ortalama bulunmuyor": -1, **UNIVERSITY_GRADE_EXCEPTIONS,
    }
    got = one(spark, list(given), "t string", texts.range_midpoint("t", UNIVERSITY_GRADE_EXCEPTIONS))
    assert got == [float(v) for v in given.values()]
    school = {"84-70": 77.0, "2.50 ve altı": 2.5, "100-85": 92.5, "50 - 74": 62.0, "3.00-2.50": 2.75}
    assert one(spark, list(school), "t string", texts.range_midpoint("t")) == list(school.values())


def test_division_by_zero(spark):
    rows = [(0, 0), (5, 0), (6, 3), (None, 2)]
    schema = "a int, b int"
    assert one(spark, rows, schema, ratios.safe_ratio("a", "b")) == [0, 0, 2, 0]
    assert one(spark, rows, schema, ratios.plain_ratio("a", "b")) == [None, None, 2, None]
    assert one(spark, rows, schema, ratios.smooth_ratio("a", "b")) == [0, 5, 1.5, None]
    assert one(spark, rows, schema, ratios.per_unit("a", "b")) == [0, 5, 2, None]


def test_infinite_and_nan(spark):
    inf = float("inf")
    assert one(spark, [inf, -inf, float("nan"), 1.5], "a double", ratios.finite("a")) == [None, None, None, 1.5]


def test_half_even(spark):
    assert one(spark, [0.125, 0.375, 2.5], "a double", ratios.round_even("a", 2)) == [0.12, 0.38, 2.5]


def test_mode_takes_the_smallest_on_a_tie(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (1, "b"), (1, "a"), (2, None), (3, "z")], "k int, v string")
    got = {r["k"]: r["m"] for r in sessions.main_value(df, "k", "v", "m").collect()}
    assert got == {1: "a", 3: "z"}


def test_first_value_skips_nulls_and_follows_time(spark):
    day = dt.datetime(2024, 1, 1)
    rows = [("s", day, 3, "c"), ("s", day, 2, None), ("s", day + dt.timedelta(1), 1, "a")]
    df = spark.createDataFrame(rows, "s string, event_time timestamp_ntz, event_id int, v string")
    assert values(df.groupBy("s").agg(sessions.first_value("v").alias("v")), "v") == ["c"]


def test_equal_width_edges_and_constant(spark):
    df = spark.createDataFrame([(float(x),) for x in (0, 1, 2, 3)], "x double")
    cut = encode.equal_width(df, "x", ["low", "medium", "high"], "b")
    assert {r["x"]: r["b"] for r in cut.collect()} == {0: "low", 1: "low", 2: "medium", 3: "high"}
    same = spark.createDataFrame([(4.0,), (4.0,), (None,)], "x double")
    cut = encode.equal_width(same, "x", ["low", "medium", "high"], "b")
    assert sorted(values(cut, "b"), key=str) == [None, "medium", "medium"]


def test_scaling_uses_the_population_deviation_and_keeps_constants(spark):
    df = spark.createDataFrame([(1.0, 7.0), (3.0, 7.0)], "x double, c double")
    got = encode.standardize(df, ["x", "c"]).orderBy("x").collect()
    assert [(r["x"], r["c"]) for r in got] == [(-1.0, 0.0), (1.0, 0.0)]


def test_codes_of_unseen_values(spark):
    train = spark.createDataFrame([("b",), ("a",), ("c",)], "v string")
    test = spark.createDataFrame([("c",), ("q",), (None,)], "v string")
    got = {r["v"]: r["v_code"] for r in encode.codes(test, "v", train, unseen=-1).collect()}
    assert got == {"c": 2, "q": -1, None: -1}
    got = {r["v"]: r["v_code"] for r in encode.codes(test, "v", train, sentinel="Unknown").collect()}
    assert got == {"c": 3, "q": 0, None: 0}


def test_first_contained_follows_list_order(spark):
    df = spark.createDataFrame([("ankara izmir",), ("van",), ("xx",), (None,)], "t string")
    items = spark.createDataFrame([("izmir", 0), ("ankara", 1), ("an", 2), ("longer than any text", 3)], "item string, o int")
    got = {r["t"]: r["f"] for r in lookup.first_contained(df, "t", items, "f").collect()}
    assert got == {"ankara izmir": "izmir", "van": "an", "xx": "xx", None: None}


def test_place_chain(spark):
    sheet = spark.createDataFrame(
        [("İzmir", "Bornova", 0), ("Konya", "Ereğli", 1), ("Zonguldak", "Ereğli", 2)],
        "city string, district string, ord int",
    )
    fixes = spark.createDataFrame([("kdz eregli", "zonguldak")], "wrong string, fixed string")
    df = spark.createDataFrame(
        [(i, t) for i, t in enumerate(["IZMİR / merkez", "Bornova", "ereğli", "Kdz. Ereğli", "Paris", None])],
        "i int, place string",
    )
    got = lookup.resolve_place(df, "place", sheet, "city", fixes).orderBy("i")
    assert values(got, "city") == ["izmir", "izmir", "zonguldak", "zonguldak", "bilinmiyor", "bilinmiyor"]


def test_codes_of_survey_answers(spark):
    df = spark.createDataFrame(
        [("Erkek", "Evet", "İmam Hatip Lisesi", "3.0"), (None, None, "?", None),
         ("KADIN", "Hayır", "ÖZEL", "Kardeş Sayısı 1 Ek Bilgi Aile Hk. Anne Vefat")],
        schema="`Cinsiyet` string, `Ingilizce Biliyor musunuz` string, `Lise Turu` string, `Kardes Sayisi` string",
    )
    got = [tuple(r) for r in whole.survey_table(df).collect()]
    assert got == [(1, 1, 1, 3), (0, -1, 0, 0), (None, 0, 3, 1)]


def test_label_never_multiplies_rows(spark):
    df = spark.createDataFrame([("s", 1, 5.0), ("s", 2, 6.0), ("s", 0, None)], "k string, o int, v double")
    assert [tuple(r) for r in columns.one_row_per(df, "k", "v", ["o"]).collect()] == [("s", 5.0)]


def test_align_fills_drops_and_orders(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, z int")
    aligned = columns.align_to(df, ["b", "missing", "a"])
    assert aligned.columns == ["b", "missing", "a"]
    assert tuple(aligned.first()) == (2, 0, 1)


def test_clean_names(spark):
    df = spark.createDataFrame([(1, 2)], "event_time int, `Doğum Yeri2` int")
    assert columns.clean_names(df).columns == ["eventtime", "Doum Yeri"]


def test_lookup_sheet_and_json(spark, tmp_path):
    sheet = tmp_path / "sheet.csv"
    sheet.write_text("a,b\nil,ilçe\nKonya,Ereğli\nİzmir,Bornova\n", encoding="utf-8")
    rows = files.read_lookup(spark, str(sheet)).orderBy("ord").drop("ord").collect()
    assert [tuple(r) for r in rows] == [("Konya", "Ereğli"), ("İzmir", "Bornova")]
    table = tmp_path / "map.json"
    table.write_text('{\n "a": "1",\n "b": "2"\n}', encoding="utf-8")
    assert {tuple(r) for r in files.read_json_map(spark, str(table)).collect()} == {("a", "1"), ("b", "2")}
    names = tmp_path / "list.json"
    names.write_text('["x", "y"]', encoding="utf-8")
    assert [tuple(r) for r in files.read_json_list(spark, str(names)).orderBy("ord").collect()] == [(0, "x"), (1, "y")]


def test_wide_column_is_refused(spark):
    with pytest.raises(ValueError):
        encode.distinct_values(spark.range(20).select(F.col("id").alias("v")), "v", at_most=10)
