"""Scalar functions against values worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from tramline.functions import numeric, text


def values(spark, rows, schema, column):
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"_i int, {schema}").repartition(2)
    return [r.x for r in sorted(frame.select("_i", column.alias("x")).collect(), key=lambda r: r._i)]


def one(spark, cells, column, kind="string"):
    return values(spark, [(c,) for c in cells], f"c {kind}", column(F.col("c")))


def duck_equals(spark, tmp_path, name, table, rows, schema):
    """A query over one table of its own against its DuckDB text."""
    import duckdb

    from tramline import catalog

    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    got = con.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in got.description]
    assert {tuple(r) for r in catalog.queries()[name](spark, str(tmp_path)).select(*columns).collect()} == set(got.fetchall())


def test_names(spark):
    assert one(spark, ["Wealthy (NB)", "Wealthy (NB) ", " A(EB)", "B (XB)", None, "C (WB) (SB)"], text.base_name) == ["Wealthy", "Wealthy (NB)", "A", "B (XB)", "", "C (WB)"]
    assert one(spark, ["  Café  du\tMonde ", None, ""], text.composed_name) == ["Café du Monde", "", ""]
    assert one(spark, ["  Café  DU ", None], text.place_key) == ["cafe du", None]
    assert one(spark, ["abc", "", None, "éa"], text.cap_word) == ["Abc", "", "", "Éa"]


def test_clocks(spark):
    assert one(spark, ["6:5:00", "25:10:05", "7:60:00", " 07:00:00 ", "", None], text.seconds) == [21900, 90605, 28800, 25200, None, None]
    for bad in ("7:00", "x", "1:2:3:4", "1:b:2"):
        with pytest.raises(Exception, match="no clock time"):
            one(spark, [bad], text.seconds)
    assert one(spark, [87360, 360000, 59, 3600, -60], text.hhmm, "int") == ["24:16", "100:00", "0:00", "1:00", "-1:59"]
    assert one(spark, [87361, 5], text.hhmmss, "int") == ["24:16:01", "0:00:05"]


def test_dates(spark):
    day = lambda c: text.pretty_date(text.date8(c))
    assert one(spark, ["20240101", "20240229", "20230229", "2024"], day) == ["Mon 1 Jan 2024", "Thu 29 Feb 2024", None, None]
    assert [str(x) for x in one(spark, ["2024-01-07", "", None, "20240108", "no"], lambda c: text.window_monday(c, "20231231"))] == ["2024-01-01", "2023-12-25", "2023-12-25", "2024-01-08", "None"]
    assert values(spark, [("20240101", "20240131"), ("20240101", "x"), ("20240301", "20240301")], "a string, b string", text.day_count(F.col("a"), F.col("b"))) == [31, 0, 1]


def test_tags(spark):
    assert one(spark, ["10", "1", "2", "0:15", "2:00", "2:01", "0:02:00", "10:00", "often", None], text.interval_s) == [600, None, 120, 900, 7200, None, 120, None, None, None]
    assert one(spark, ["#aBc", "abc", "a1b2c3", "#A1B2C3", "Red", " grey ", "reddish", None], text.colour) == ["AABBCC", None, "A1B2C3", "A1B2C3", "FF0000", "808080", None, None]
    pairs = [("node", "12"), ("way", "12x"), ("area", "12"), (None, "w1234"), (None, "x9"), ("node", None), (None, None), ("relation", "r1")]
    got = values(spark, pairs, "k string, i string", text.osm_identity(F.col("k"), F.col("i")))
    assert [None if x is None else tuple(x) for x in got] == [("node", 12), ("way", 12), None, ("way", 1234), None, None, None, None]
    assert one(spark, ["http://a", "https://b", "ftp://c", None, "HTTP://d"], text.is_http_url) == [True, True, False, False, False]


def plain_hash(s):
    units = [int.from_bytes(s.encode("utf-16-le")[i : i + 2], "little") for i in range(0, 2 * len(s.encode("utf-16-le")) // 2, 2)]
    a, b = 0x811C9DC5, 0x01000193
    for i, c in enumerate(units):
        a = (a ^ c) * 0x01000193 % 2**32
        b = (b ^ (c + i)) * 0x85EBCA6B % 2**32
        b = (b << 13 | b >> 19) % 2**32
    return f"{a:08x}{b:08x}"


def test_stable_hashes(spark):
    cells = ["", "a", "hello", "é\U0001f600x", "a" * 300, "hello"]
    assert text.stable_hashes(cells) == [plain_hash(c) for c in cells]
    assert one(spark, [*cells, None], text.stable_hash) == [*map(plain_hash, cells), None]
    assert text.stable_hashes([""]) == ["811c9dc501000193"]


def test_wording(spark):
    got = values(spark, [("It works", "Now"), ("Done.", ""), ("", "Only"), ("He said “no.”", "So"), (None, None)], "a string, b string", text.explain_text(F.col("a"), F.col("b")))
    assert got == ["It works. Now", "Done.", "Only", "He said “no.” So", ""]
    assert values(spark, [([],), (["A"],), (["A", "B"],), (["A", "B", "C"],)], "w array<string>", text.joined_words(F.col("w"))) == ["", "A", "A and B", "A, B and C"]
    assert values(spark, [("library", "Library", 2), ("library", "Library", 1), ("dog_park", None, 0), ("water", "Water", 3)], "k string, l string, n int", text.noun(F.col("k"), F.col("l"), F.col("n"))) == ["libraries", "library", "dog parks", "bodies of water"]
    assert one(spark, ["0", "1", "2", None], text.direction_word) == ["outbound", "inbound", "direction 2", "direction "]
    assert one(spark, ["radial-hub", "grid-like", None], text.shape_word) == ["hub-and-spoke", "grid like", ""]
    assert values(spark, [("1.5", "usd"), ("free", "eur"), (None, None), ("2.675", "")], "p string, c string", text.fare(F.col("p"), F.col("c"))) == ["1.50 USD", "free EUR", "", "2.68"]


def test_numbers(spark):
    n = lambda p, comma=True: (lambda c: text.number(c, p, comma))
    assert one(spark, [1493.0, -0.4, 2.5, -2.5, 1e7], n(0), "double") == ["1,493", "-0", "3", "-3", "10,000,000"]
    assert one(spark, [76.83, 1.005, 2.675], n(2), "double") == ["76.83", "1.01", "2.68"]
    assert one(spark, [0.1234, 12.0], lambda c: text.percent(c), "double") == ["12.3%", "1200.0%"]
    assert one(spark, [1609.344, 402.336, 1000.0, 0.0], lambda c: text.miles(c), "double") == ["1 mi", "0.25 mi", "0.62 mi", "0 mi"]
    assert values(spark, [(402.336, 804.672)], "a double, b double", text.miles_range(F.col("a"), F.col("b"))) == ["0.25–0.5 mi"]
    assert one(spark, [12345.0], lambda c: text.kilometres(c), "double") == ["12.3 km"]
    assert one(spark, [2589988.110336], lambda c: text.square_miles(c), "double") == ["1.0 sq mi"]
    assert one(spark, [12.5], lambda c: text.minutes(c), "double") == ["13 min"]
    assert one(spark, [1.005, 2.675, -0.5, 1e-7, 123456.5], lambda c: numeric.half_up(c, 2), "double") == [1.01, 2.68, -0.5, 0.0, 123456.5]
    assert values(spark, [(1.0, 3.0), (5.0, 3.0), (-1.0, 3.0), (1.0, 0.0)], "a double, b double", numeric.fill_percent(F.col("a"), F.col("b"))) == [33.3, 100.0, 0.0, 0.0]


def test_guards(spark):
    got = one(spark, ["1.5", "-inf", "Infinity", "NaN", "1e3", ".5", "x", "", None], numeric.try_float)
    assert got[:3] == [1.5, -math.inf, math.inf] and math.isnan(got[3]) and got[4:] == [1000.0, 0.5, None, None, None]
    assert one(spark, [" 12 ", "+3", "-4", "1.0", "", None], numeric.try_int) == [12, 3, -4, 0, 0, 0]


def test_natural_order(spark):
    cells = ["10 Miles", "3 Miles", "a2b10", "A2b9", "a2b", "B1", "", "007", "7"]
    frame = spark.createDataFrame([(c,) for c in cells], "c string")
    assert [r.c for r in frame.orderBy(text.natural_key(F.col("c"))).collect()] == ["", "3 Miles", "007", "7", "10 Miles", "a2b", "A2b9", "a2b10", "B1"][:1] + ["3 Miles", "007", "7", "10 Miles", "a2b", "A2b9", "a2b10", "B1"]


def test_class_keys(spark):
    assert one(spark, [3.0, 2.5, None], lambda c: text.class_key(c, "number"), "double") == ["n:3", "n:2.5", "null"]
    assert one(spark, [True, False, None], lambda c: text.class_key(c, "boolean"), "boolean") == ["b:1", "b:0", "null"]
    assert one(spark, ['a"b', None], lambda c: text.class_key(c, "text")) == ['s:"a\\"b"', "null"]
    assert values(spark, [(["x", None],), (None,), ([],)], "c array<string>", text.class_key(F.col("c"), "texts")) == ['a:[s:"x",null]', "null", "a:[]"]


def test_sorted_sums_and_bisection(spark):
    import bisect

    lists = [[], [1.0], [1.0, 1.0, 2.0, 5.0, 5.0, 9.0]]
    rows = [(own, x) for own in lists for x in (0.0, 1.0, 3.0, 5.0, 9.0, 10.0)]
    assert values(spark, rows, "v array<double>, x double", numeric.bisect_left(F.col("v"), F.col("x"))) == [bisect.bisect_left(v, x) for v, x in rows]
    assert values(spark, rows, "v array<double>, x double", numeric.bisect_right(F.col("v"), F.col("x"))) == [bisect.bisect_right(v, x) for v, x in rows]
    assert values(spark, [([1e16, 1.0, -1e16],), ([-1e16, 1.0, 1e16],)], "v array<double>", numeric.sum_sorted(F.col("v"))) == [0.0, 0.0]


def test_formats_of_large_keys_equal_their_sql(spark, tmp_path):
    """Keys beyond 10,000 give four digits of kilometres, which the SQL writes without a comma."""
    duck_equals(spark, tmp_path, "fn_formats", "customer", [(k, k * 1.25 - 9000) for k in (7, 9999, 10000, 12345, 1234567)], "c_custkey long, c_acctbal double")


def test_first_letters_equal_their_sql(spark, tmp_path):
    """Every code point as a text's first: none becomes two letters."""
    texts = [chr(c) + "x\u0301y ß" for c in range(1, 0x110000) if not 0xD800 <= c <= 0xDFFF and chr(c).isalpha()]
    duck_equals(spark, tmp_path, "fn_name_lengths", "documents", [*enumerate([*texts, "", "\U0001f600", "e\u0301"]), (-1, None)], "doc_id long, text string")
