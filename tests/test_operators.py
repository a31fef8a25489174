"""Invariants and edge cases the twins do not reach."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from demandloom.functions.scalars import clean_text, erp_date, natural_key, period_start, table_name, to_date, to_number
from demandloom.operators import compare as cmp
from demandloom.operators import filters as flt
from demandloom.operators import hierarchy as hier
from demandloom.operators import publish as pub
from demandloom.operators import selection as sel
from demandloom.operators import series as ser
from demandloom.operators import totals as tot
from demandloom.operators import upsert as up
from demandloom.sources import landing as src
from demandloom.sources.catalogue import Catalogue, typed_load


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


# ---------------------------------------------------------------- scalars


def test_texts(spark):
    df = spark.createDataFrame([(" a ",), ("NaN",), ("",), ("None ",), (None,), ("null",)], "t string")
    assert [r[0] for r in df.select(clean_text(F.col("t"))).collect()] == ["a", None, None, None, None, None]


def test_numbers(spark):
    df = spark.createDataFrame([("1",), (" -2.5 ",), ("1e3",), ("n/a",), ("",), (None,), (".5",), ("1.2.3",)], "t string")
    assert [r[0] for r in df.select(to_number(F.col("t"))).collect()] == [1.0, -2.5, 1000.0, None, None, None, 0.5, None]


def test_erp_dates(spark):
    texts = ["/Date(0)/", "/Date(-86400000)/", "2024-02-29T10:00:00", "2024-02-30", "soon", "/Date(x)/", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(erp_date(F.col("t"))).collect()]
    assert got == [dt.date(1970, 1, 1), dt.date(1969, 12, 31), dt.date(2024, 2, 29), None, None, None, None]


def test_natural_keys_keep_nulls_and_borders_apart(spark):
    df = spark.createDataFrame([("a|b", "c"), ("a", "b|c"), (None, "c"), ("-", "c"), ("", "c")], "x string, y string")
    assert df.select(natural_key(["x", "y"]).alias("k")).distinct().count() == 5


def test_periods(spark):
    df = spark.createDataFrame([(dt.date(2024, 5, 15),)], "d date")
    d = F.col("d")
    got = df.select(*[period_start(d, i) for i in ("WEEKLY", "MONTHLY", "QUARTERLY", "YEARLY", "DAILY", "odd")], period_start(d, "DAILY", True)).first()
    assert [x.isoformat() for x in got] == ["2024-05-13", "2024-05-01", "2024-04-01", "2024-01-01", "2024-05-15", "2024-05-01", "2024-05-01"]


def test_table_names(spark):
    df = spark.createDataFrame([("Final - Consensus Plan!",), ("  __x__ ",), ("!!!",), ("a" * 64,)], "t string")
    assert [r[0] for r in df.select(table_name(F.col("t"))).collect()] == ["final_consensus_plan", "x", None, None]


# ---------------------------------------------------------------- sources

FIELDS = {
    "fields": [
        {"field_name": "Product", "data_type": "Char", "is_unique_key": True, "field_length": 50},
        {"field_name": "sold_on", "data_type": "Date", "is_date_field": True},
        {"field_name": "units", "data_type": "Decimal", "is_target_variable": True},
        {"field_name": "active", "data_type": "Boolean", "is_characteristic": True},
    ]
}


def test_catalogue_rules():
    c = Catalogue.parse(json.dumps(FIELDS))
    assert (c.target, c.date, c.columns, c.dimensions, c.unique_keys) == ("units", "sold_on", ["product", "active"], ["product"], ["product"])
    assert c.schema()["units"].dataType.simpleString() == "decimal(18,2)" and c.schema()["product"].metadata["field_length"] == 50
    for change in ({"field_name": "a b"}, {"field_name": "product"}, {"data_type": "Blob"}, {"is_date_field": True}):
        with pytest.raises(ValueError):
            Catalogue.parse({"fields": [*FIELDS["fields"], {"field_name": "z", "data_type": "Char", **change}]})


def test_sheet_round_trip(spark, tmp_path):
    path = str(tmp_path / "sheet")
    sheet = spark.createDataFrame([(" A ", "2024-01-05", "3", "x"), (None, None, None, None), ("B", "bad", "-1", "y")], "` Product` string, date string, Units string, note string")
    src.write_sheet(sheet, path)
    back = src.clean_sheet(src.read_sheet(spark, path))
    assert back.columns == ["Product", "date", "Units", "note"] and back.count() == 2
    mapping = src.map_columns(back.columns, Catalogue.parse(FIELDS))
    assert mapping["sales"] == {"target": "Units", "date": "date", "uom": None, "unit_price": None} and list(mapping["skipped"]) == ["note"]
    good = src.good_rows(src.validate_sales(src.apply_mapping(back, mapping)))
    assert rows(good.select("product", "date", "quantity", "uom"), "product") == [("A", dt.date(2024, 1, 5), 3.0, "EACH")]
    with pytest.raises(ValueError):
        src.map_columns(["a", "b"], Catalogue.parse(FIELDS))
    with pytest.raises(ValueError):
        src.clean_sheet(spark.createDataFrame([("x",)], "a string"))


def test_json_and_parquet_sheets(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5)], "k string, v double")
    for fmt in ("json", "parquet"):
        getattr(df.write, fmt)(str(tmp_path / fmt))
        assert src.read_sheet(spark, str(tmp_path / fmt), fmt).count() == 1


def test_typed_load_names_rejects(spark):
    df = spark.createDataFrame([("p", "2024-01-01", "1.234", "true"), ("q", "x", "y", None)], "product string, sold_on string, units string, active string")
    out = typed_load(df, Catalogue.parse(FIELDS)).orderBy("product").collect()
    assert (str(out[0].units), out[0].rejected, out[1].units, out[1].rejected) == ("1.23", "", None, "sold_on,units")


# ---------------------------------------------------------------- filters


def test_erp_filter_spellings(spark):
    df = spark.createDataFrame([(1, "a", dt.date(2024, 1, 1)), (2, "b", dt.date(2024, 2, 1)), (3, "c", dt.date(2024, 3, 1))], "n int, t string, d date")

    def hits(config):
        return [r.n for r in df.where(flt.erp_filter(config)).orderBy("n").collect()]

    assert hits({"n": {"gt": 1}, "t": {"ne": "c"}}) == [2]
    assert hits({"or": [("n", "eq", 1), ("d", "ge", "2024-03-01")]}) == [1, 3]
    assert hits({"and": [("n", "le", 2)], "or": [("t", "in", ["a", "c"])]}) == [1]
    assert hits({}) == [1, 2, 3]
    with pytest.raises(ValueError):
        flt.erp_filter({"n": {"like": 1}})


def test_facets_with_nulls(spark):
    df = spark.createDataFrame([("a", "x"), ("a", None), (None, "x"), ("b", "y")], "p string, q string")
    many = {(r.field, r.value): r.value_count for r in flt.facets(df, {"p": ["a"], "q": []}).collect()}
    assert many == {("p", "a"): 2, ("p", None): 1, ("p", "b"): 1, ("q", "x"): 1, ("q", None): 1}
    assert {(r.value, r.display_value) for r in flt.facet(df, "q").collect()} == {("x", "x"), (None, "NULL"), ("y", "y")}


# ---------------------------------------------------------------- upserts

KEYS = ["k", "d"]


def table(spark, data):
    return spark.createDataFrame(data, "k string, d int, q double, uom string")


def test_upsert_is_idempotent(spark):
    old, new = table(spark, [("a", 1, 1.0, "o"), ("b", 1, 2.0, "o")]), table(spark, [("b", 1, 9.0, "n"), ("c", 1, 3.0, "n")])
    once = up.upsert(old, new, KEYS)
    want = [("a", 1, 1.0, "o"), ("b", 1, 9.0, "n"), ("c", 1, 3.0, "n")]
    assert rows(once, "k") == want and rows(up.upsert(once, new, KEYS), "k") == want
    assert rows(up.upsert_flags(old, new, KEYS).select("k", "action"), "k") == [("b", "updated"), ("c", "inserted")]
    assert rows(up.upsert_target_only(old, new, KEYS, "q"), "k") == [("a", 1, 1.0, "o"), ("b", 1, 9.0, "o"), ("c", 1, 3.0, "n")]


def test_last_row_wins_for_any_input_order(spark):
    data = [("a", 1, float(i), str(i)) for i in range(50)] + [("b", 1, 1.0, None)]
    for part in (data, data[::-1]):
        df = table(spark, part).withColumn("row_no", F.col("q"))
        assert rows(up.last_per_key(df, KEYS, ["row_no"]).select(*KEYS, "q"), "k") == [("a", 1, 49.0), ("b", 1, 1.0)]


def test_find_or_create_without_keys(spark):
    old = spark.createDataFrame([("m1", "a")], "master_id string, p string")
    new = spark.createDataFrame([("a", 1), ("a", 2)], "p string, row_no string")
    out = up.find_or_create(old, new, [], ["row_no"], "master_id")
    assert out.count() == 3 and out.select("master_id").distinct().count() == 3
    keyed = up.find_or_create(old, new, ["p"], ["row_no"], "master_id")
    assert keyed.count() == 1


def test_insert_absent_refuses_unknown_fields(spark):
    df = spark.createDataFrame([("x", "y")], "a string, b string")
    with pytest.raises(ValueError):
        up.insert_absent(df, df, ["a"], "id")


# ---------------------------------------------------------------- hierarchy


def test_drift_goes_to_the_first_highest_ratio(spark):
    ratios = spark.createDataFrame([("g", m, 1 / 3) for m in "abc"] + [("h", "z", 1.0)], "g string, master_id string, ratio double")
    periods = spark.createDataFrame([("g", dt.date(2024, 1, 1), 100.0), ("g", dt.date(2024, 2, 1), 0.0), ("h", dt.date(2024, 1, 1), 7.0)], "g string, plan_date date, quantity double")
    out = hier.apply_ratios(ratios, periods, ["g"])
    assert rows(out.where("g = 'g' AND month(plan_date) = 1").select("master_id", "quantity"), "master_id") == [("a", 33.3334), ("b", 33.3333), ("c", 33.3333)]
    sums = {(r.g, r.plan_date.month): round(r.s, 4) for r in out.groupBy("g", "plan_date").agg(F.sum("quantity").alias("s")).collect()}
    assert sums == {("g", 1): 100.0, ("g", 2): 0.0, ("h", 1): 7.0}


def test_ratios_sum_to_one_and_fall_back(spark):
    members = spark.createDataFrame([("g", "a"), ("g", "b"), ("h", "c"), ("h", "d"), (None, "e")], "g string, master_id string")
    plan = spark.createDataFrame([("a", 5.0), ("b", -2.0), ("c", -1.0)], "master_id string, quantity double")
    out = {r.master_id: r.ratio for r in hier.member_ratios(members, ["g"], table=plan).collect()}
    assert out == {"a": 1.0, "b": 0.0, "c": 0.5, "d": 0.5, "e": 1.0}


def test_zero_source_allocates_zero(spark):
    flat = spark.createDataFrame([("p", "x", 0.0), ("p", "y", 0.0), (None, "x", 4.0)], "p string, l string, quantity double")
    out = {(r.p, r.l): r.allocation_factor for r in hier.split_ratios(flat, ["p"], ["p", "l"]).collect()}
    assert out == {("p", "x"): 0.0, ("p", "y"): 0.0, (None, "x"): 1.0}


# ---------------------------------------------------------------- series and selection


def test_gap_filling_and_profile_of_flat_series(spark):
    df = spark.createDataFrame([("a", dt.date(2024, 1, 1), 4.0), ("a", dt.date(2024, 4, 1), 4.0)], "e string, period date, total_quantity double")
    filled = ser.fill_gaps(df, ["e"])
    assert [r.total_quantity for r in filled.orderBy("period").collect()] == [4.0, 0.0, 0.0, 4.0]
    p = ser.profile(df, ["e"]).first()
    assert (p.cv, p.skewness, p.outlier_count) == (0.0, 0.0, 0)
    assert ser.profile(df.where("e = 'zzz'"), ["e"]).count() == 0


def test_first_seen_codes(spark):
    df = spark.createDataFrame([(["b", None, "a", "b"],)], "v array<string>")
    assert df.select(ser.first_seen_codes(F.col("v"))).first()[0] == [0.0, 1.0, 2.0, 0.0]


def test_best_fit_prefers_direction_and_skips_failures(spark):
    cols = "e string, algorithm string, mape double, accuracy double, mae double, rmse double, mae_accuracy double, rmse_accuracy double, forecast array<double>, test_forecast array<double>"
    data = [
        ("x", "a", 10.0, 90.0, 1.0, 1.0, 90.0, 90.0, [1.0, 2.0], [1.0]), ("x", "b", 20.0, 80.0, 2.0, 2.0, 80.0, 80.0, [3.0, 4.0], [3.0]),
        ("x", "failed", 0.0, 100.0, 0.0, 0.0, 100.0, 100.0, None, None),
    ]
    df = spark.createDataFrame(data, cols)
    for metric in ("mape", "accuracy"):
        best = sel.best_fit(df, ["e"], metric).first()
        assert (best.selected_algorithm, best.candidates, best.summary_accuracy) == ("a", 2, 90.0)


def test_pair_metrics_mirror_and_single_points(spark):
    df = spark.createDataFrame([("e", "a", 1, 10.0), ("e", "b", 1, 12.0), ("e", "a", 2, 5.0)], "e string, run string, d int, v double")
    one = cmp.pair_metrics(cmp.aligned_pairs(cmp.side_by_side(df, ["e"], "run", "d", "v", ["a", "b"]), ["e"], "d", ["a", "b"]), ["e"]).first()
    two = cmp.pair_metrics(cmp.aligned_pairs(cmp.side_by_side(df, ["e"], "run", "d", "v", ["b", "a"]), ["e"], "d", ["b", "a"]), ["e"]).first()
    assert (one.average_difference, one.correlation, one.comparison_points) == (2.0, 1.0, 1) and two.average_difference == -2.0


# ---------------------------------------------------------------- publishing


def test_redaction_at_depth(spark):
    deep = {"a": [{"Secret": {"x": [1, {"y": 2}]}, "ok": {"token": "t"}}], "s": 'say "token": 1'}
    texts = [json.dumps(deep), '{"Token" : -1.5e3, "x": "token"}', "not json \\u0041", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, payload string")
    got = [r.p for r in pub.redact(df, "payload").select("i", F.col("payload").alias("p")).orderBy("i").collect()]
    assert json.loads(got[0]) == {"a": [{"Secret": pub.REDACTED, "ok": {"token": pub.REDACTED}}], "s": 'say "token": 1'}
    assert json.loads(got[1]) == {"Token": pub.REDACTED, "x": "token"} and got[2] == texts[2] and got[3] is None


def test_numbering_is_dense_under_skew(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), "id").repartition(5)
    out = pub.number_rows(df, ["k", "id"], "n", partitions=6).orderBy("k", "id").collect()
    assert [r.n for r in out] == list(range(1, 5001))


def test_group_totals_match_null_keys(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0), ("a", 5.0)], "g string, q double")
    out = tot.with_group_totals(df, ["g"], {"t": F.sum("q")})
    assert sorted(r.t for r in out.collect()) == [3.0, 3.0, 5.0]


def test_distinct_count_of_repeated_ids(spark):
    df = spark.createDataFrame([("s1", dt.date(2024, 1, 1), 1.0, 2.0), ("s1", dt.date(2024, 1, 9), 1.0, 4.0)], "sales_id string, sale_date date, quantity double, unit_price double")
    assert tot.period_totals(df, [], id_is_key=False).first().transaction_count == 1
    assert tot.period_totals(df, []).first().transaction_count == 2
    with pytest.raises(ValueError):
        tot.level_columns("a-b", ["a"])


# ---------------------------------------------------------------- dates, filters and requests as they are written


def test_written_dates(spark):
    want = {
        "2024-03-15": "2024-03-15", " 2024/3/5 ": "2024-03-05", "03/15/2024": "2024-03-15", "15 Mar 2024": "2024-03-15", "15-march-2024": "2024-03-15",
        "Mar 15, 2024": "2024-03-15", "20240315": "2024-03-15", "2024-03-15T10:20:30": "2024-03-15", "3/15/2024 10:20": "2024-03-15", "15.3.2024": None,
        "2024": None, "13/13/2024": None, "2024-02-30": None, "soon": None, "": None,
    }
    df = spark.createDataFrame([(t,) for t in want], "t string")
    got = {r.t: r.d and r.d.isoformat() for r in df.select("t", to_date(F.col("t")).alias("d")).collect()}
    assert got == want
    assert df.select(to_date(F.lit("15.3.2024"), day_first=True)).first()[0] == dt.date(2024, 3, 15)


def test_non_finite_numbers_are_no_numbers(spark):
    df = spark.createDataFrame([("inf",), ("-Infinity",), ("nan",), ("1e999",), ("7",)], "t string")
    assert [r[0] for r in df.select(to_number(F.col("t"))).collect()] == [None, None, None, None, 7.0]


def test_sales_rows_keep_odd_cells_apart(spark):
    cells = [("03/15/2024", "inf", "u" * 30), ("15 Mar 2024", "5", None), (None, "-1", "EA")]
    df = spark.createDataFrame([(*c, "1.5") for c in cells], "date string, quantity string, uom string, unit_price string")
    got = src.validate_sales(df).select("date", "quantity", "errors", F.length("uom").alias("n")).collect()
    assert [tuple(r) for r in got] == [
        (dt.date(2024, 3, 15), None, src.BAD_QUANTITY, 20), (dt.date(2024, 3, 15), 5.0, "", 4), (None, -1.0, f"{src.NO_DATE}; {src.NEGATIVE_QUANTITY}", 2),
    ]
    assert src.validate_sales(df, unit_chars=None).agg(F.max(F.length("uom"))).first()[0] == 30
    bad = src.error_rows(src.validate_sales(df).withColumn("up", F.lit(1)).withColumn("i", F.monotonically_increasing_id()), "up", ["i"])
    assert [r.error_no for r in bad.orderBy("i").collect()] == [1, 2]


def test_error_rows_number_each_upload(spark):
    rows_ = [(u, i, "bad" if (i * 7 + j) % 3 else "") for j, u in enumerate(["a", "b", None]) for i in range(40)]
    df = spark.createDataFrame(rows_, "up string, i int, errors string")
    got = src.error_rows(df, "up", ["i"])
    want = []
    for u in ("a", "b", None):
        want += [(u, i, n + 1) for n, i in enumerate(sorted(i for w, i, e in rows_ if w == u and e))]
    assert sorted(((r.up or "", r.i, r.error_no) for r in got.collect())) == sorted((u or "", i, n) for u, i, n in want)
    assert src.error_rows(df.where("false"), "up", ["i"]).count() == 0


def test_erp_filter_over_raw_text(spark):
    texts = ["/Date(1705363200000)/", "2024-01-14T23:59:59", "2024-01-15", "soon", None]  # the first is 16 January 2024
    df = spark.createDataFrame([(t,) for t in texts], "P string")
    hit = flt.erp_filter({"P": {"ge": "2024-01-15"}}, dict(df.dtypes))
    assert [r.P for r in df.where(hit).collect()] == [texts[0], texts[2]]


def test_equal_requests_in_any_key_order(spark):
    parts = ['"forecast_filters":{"a":[1,2],"b":{"x":1,"y":null}}', '"forecast_start":"2024-01"', '"forecast_end":"2024-06"', '"algorithms":[{"algorithm_id":2,"k":1}]']
    turned = ['"algorithms":[{"k":1,"algorithm_id":2}]', '"forecast_filters":{"b":{"y":null,"x":1},"a":[1,2]}', *parts[1:3]]
    other = [parts[0].replace("[1,2]", "[2,1]"), *parts[1:]]
    text = lambda ps: "{" + ", ".join(ps) + "}"
    new = spark.createDataFrame([(1, text(turned)), (2, text(other)), (3, "{}")], "id int, request_data string")
    running = spark.createDataFrame([(text(parts),)], "request_data string")
    assert [r.id for r in pub.duplicate_running(new, running).collect()] == [1]


# ---------------------------------------------------------------- nothing is capped or lost


def test_large_values_are_published_whole(spark):
    series = spark.createDataFrame([(1, [dt.date(2024, m, 1) for m in range(1, 13)], [2e6 + 1000.0 * m for m in range(12)])], "e int, periods array<date>, ys array<double>")
    scored = sel.evaluate(series, ["e"], ["linear_regression"], 3)
    values = [r.value for r in sel.result_rows(scored, ["e"], "2025-01-01").collect()]
    assert min(values) > 1.9e6 and len(set(values)) > 3
    capped = sel.result_rows(scored, ["e"], "2025-01-01", cap=sel.RESULT_BOUND)
    assert {r.value for r in capped.collect()} == {sel.RESULT_BOUND}


def test_future_dates_follow_the_interval(spark):
    series = spark.createDataFrame([(1, [dt.date(2024, 1, 1)] * 8, [1.0 * k for k in range(8)])], "e int, periods array<date>, ys array<double>")
    scored = sel.evaluate(series, ["e"], ["linear_regression"], 3)
    for interval, days in (("WEEKLY", ["2025-01-06", "2025-01-13", "2025-01-20"]), ("QUARTERLY", ["2025-01-06", "2025-04-06", "2025-07-06"])):
        rows_ = sel.result_rows(scored, ["e"], "2025-01-06", interval=interval).where("result_type = 'future_forecast'")
        assert sorted(r.result_date.isoformat() for r in rows_.collect()) == days


def test_every_level_is_offered():
    assert len(tot.offered_levels("abcde")) == 5 + 10 + 10
    assert len(tot.offered_levels("abcde", pairs=2, triples=1)) == 5 + 2 + 1


def test_trees_keep_short_series_and_refuse_odd_settings(spark):
    from demandloom.functions import seriesmath as sm
    from demandloom.operators import trees

    data = [(k, [float(10 + (k + i) % 4) for i in range(n)]) for k, n in enumerate((1, 3, 6, 9, 10, 30, 30))]
    series = spark.createDataFrame(data, "e int, ys array<double>")
    model = trees.fit_pooled(series, ["e"], trees.forest(10, 2), partitions=3)
    made = {r.e: r.forecast for r in trees.roll_pooled(model, series, ["e"], 4).collect()}
    line = {r.e: r.f for r in series.select("e", sm.linear(F.col("ys"), 4).alias("f")).collect()}
    assert sorted(made) == [k for k, _ in data] and all(made[k] == line[k] for k in range(4))
    assert made[5] != line[5]
    short = series.where("e < 4")
    assert trees.fit_pooled(short, ["e"], trees.forest(10, 2)) is None
    with pytest.raises(ValueError, match="n_estimators"):
        trees.forest(n_estimators=1000)


def _scored(spark, data):
    names = "e int, algorithm string, mape double, accuracy double, mae double, rmse double, mae_accuracy double, rmse_accuracy double, forecast array<double>, test_forecast array<double>, fallback array<double>"
    return spark.createDataFrame([(e, a, m, 100.0 - m if m is not None else None, mae, mae, 50.0, 50.0, f, f, [9.0]) for e, a, m, mae, f in data], names)


def test_non_finite_and_unscored_models_never_win(spark):
    nan = float("nan")
    scored = _scored(spark, [(1, "a", 5.0, 2.0, [1.0]), (1, "b", 0.0, 0.0, [nan]), (1, "c", None, None, [3.0]), (2, "c", None, None, [3.0]), (2, "d", None, None, [4.0]), (3, "a", 1.0, 1.0, None), (3, "b", 1.0, 1.0, [float("inf")])])
    got = {r.e: (r.selected_algorithm, r.forecast, r.candidates) for r in sel.best_fit(scored, ["e"], "mae").collect()}
    assert got == {1: ("a", [1.0], 2), 2: ("c", [3.0], 2), 3: ("simple_moving_average", [9.0], 0)}


def test_metric_of_each_entity(spark):
    scored = _scored(spark, [(1, "a", 5.0, 2.0, [1.0]), (1, "b", 9.0, 1.0, [2.0]), (2, "a", 5.0, 2.0, [1.0]), (2, "b", 9.0, 1.0, [2.0])])
    by = F.when(F.col("e") == 1, "mae").otherwise("mape")
    got = {r.e: (r.selected_algorithm, r.metric) for r in sel.best_fit(scored, ["e"], by).collect()}
    assert got == {1: ("b", "mae"), 2: ("a", "mape")}


def test_short_series_have_no_score(spark):
    series = spark.createDataFrame([(1, [dt.date(2024, m, 1) for m in (1, 2, 3)], [1.0, 5.0, 2.0])], "e int, periods array<date>, ys array<double>")
    scored = sel.evaluate(series, ["e"], ["linear_regression", "moving_average"], 2)
    assert {(r.mae, r.test_periods, len(r.forecast)) for r in scored.collect()} == {(None, 0, 2)}


def test_merges_read_each_side_once(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (None, "n", "x")], "k int, v string, kept string")
    new = spark.createDataFrame([(2, "B"), (3, "C"), (None, "N")], "k int, v string")
    merged = up.upsert(old, new, ["k"])
    assert sorted(rows(merged, "k", "v"), key=str) == sorted([(1, "a", "x"), (2, "B", None), (3, "C", None), (None, "n", "x"), (None, "N", None)], key=str)
    assert merged._jdf.queryExecution().toString().count("Join FullOuter") > 0
    dims = spark.createDataFrame([("a", None, "1"), (None, None, "2")], "x string, y string, id string")
    batch = spark.createDataFrame([("a", None, 1), ("b", "c", 2), (None, None, 3), ("b", "c", 4)], "x string, y string, i int")
    made = up.find_or_create(dims, batch, ["x", "y"], ["i"], "id")
    assert made.count() == 3 and [r.x for r in made.where("is_new").collect()] == ["b"]


def test_table_versions(spark, tmp_path):
    from demandloom.sources import tables

    root, df = str(tmp_path), spark.createDataFrame([(1, "a")], "k int, v string")
    assert tables.list_tables(spark, root) == [] and tables.versions(spark, root, "plan") == []
    assert tables.write_table(df, root, "plan") == 1
    assert tables.write_table(tables.read_table(spark, root, "plan").union(df), root, "plan") == 2
    (tmp_path / "plan" / "v000000003").mkdir()  # a writer that was lost
    assert tables.read_table(spark, root, "plan").count() == 2 and tables.read_table(spark, root, "plan", 1).count() == 1
    assert tables.list_tables(spark, root) == ["plan"] and tables.write_table(df, root, "plan") == 4
    for bad in (lambda: tables.write_table(df, root, "a/b"), lambda: tables.read_table(spark, root, "none"), lambda: tables.read_table(spark, root, "plan", 3)):
        with pytest.raises(ValueError):
            bad()
    tables.claim(spark, f"{root}/plan/v000000005.claim")  # a writer that has yet to write
    with pytest.raises(tables.Conflict):
        tables.claim(spark, f"{root}/plan/v000000005.claim")
    assert tables.write_table(df, root, "plan") == 6 and tables.versions(spark, root, "plan") == [1, 2, 4, 6]
    assert tables.drop_table(spark, root, "plan") and tables.list_tables(spark, root) == []


def test_tables_hold_the_catalogues_types(spark, tmp_path):
    from demandloom.sources import tables

    fields = [{"field_name": "d", "data_type": "Date", "is_date_field": True}, {"field_name": "q", "data_type": "Decimal", "is_target_variable": True}]
    catalogue = Catalogue.parse({"fields": fields})
    typed = typed_load(spark.createDataFrame([("2024-01-02", "1.5")], "d string, q string"), catalogue).drop("rejected")
    assert tables.write_table(typed, str(tmp_path), "sales", catalogue) == 1
    assert tables.read_table(spark, str(tmp_path), "sales").dtypes == [("d", "date"), ("q", "decimal(18,2)")]
    with pytest.raises(ValueError, match="another type"):
        tables.write_table(typed.withColumn("q", F.lit("x")), str(tmp_path), "sales", catalogue)
