"""Tables kept by month, and factors on calendar days."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from demandloom.operators import series as ser
from demandloom.sources import months

SCHEMA = "k string, d date, q double"


def frame(spark, *rows, schema=SCHEMA):
    return spark.createDataFrame([(k, d and dt.date.fromisoformat(d), *rest) for k, d, *rest in rows], schema)


def held(df):
    return sorted((r.k, str(r.d), r.q) for r in df.collect())


def files(root):
    return {os.path.join(a, f) for a, _, fs in os.walk(root) for f in fs if f.endswith(".parquet")}


def test_a_merge_writes_only_touched_months(spark, tmp_path):
    root = str(tmp_path)
    old = frame(spark, *[(k, f"2024-{m:02d}-{d:02d}", 1.0) for k in "ab" for m in range(1, 13) for d in (1, 15)], ("n", None, 1.0))
    assert months.create(old, root, "sales", "d") == 1
    before, first = files(root), months.months(spark, root, "sales")
    assert len(first) == 13 and first["undated"]
    batch = frame(spark, ("a", "2024-03-15", 2.0), ("c", "2024-03-02", 3.0), ("c", "2025-01-01", 4.0), ("n", None, 5.0))
    assert months.merge(batch, root, "sales", ["k", "d"]) == 2
    second = months.months(spark, root, "sales")
    assert {m for m in second if first.get(m) != second[m]} == {"2024-03", "2025-01", "undated"}
    assert before <= files(root) and {f.split("month_=")[1][:7] for f in files(root) - before} == {"2024-03", "2025-01", "undated"}
    want = {(k, str(d)): q for k, d, q in held(old) if d != "None"} | {("a", "2024-03-15"): 2.0, ("c", "2024-03-02"): 3.0, ("c", "2025-01-01"): 4.0}
    got = held(months.read(spark, root, "sales"))
    assert [r for r in got if r[1] != "None"] == sorted((*k, q) for k, q in want.items())
    assert [r for r in got if r[1] == "None"] == [("n", "None", 1.0), ("n", "None", 5.0)]  # a NULL key matches nothing
    assert held(months.read(spark, root, "sales", 1)) == held(old) and months.versions(spark, root, "sales") == [1, 2]
    some = months.read(spark, root, "sales", first="2024-03", last="2024-04")
    assert {r[1][:7] for r in held(some)} == {"2024-03", "2024-04"} and all("2024-0" in f for f in some.inputFiles())


def test_an_empty_batch_carries_all_months(spark, tmp_path):
    root = str(tmp_path)
    months.create(frame(spark, ("a", "2024-01-01", 1.0)), root, "t", "d")
    assert months.merge(spark.createDataFrame([], SCHEMA), root, "t", ["k", "d"]) == 2
    assert months.months(spark, root, "t", 1) == months.months(spark, root, "t", 2)
    months.create(spark.createDataFrame([], SCHEMA), root, "e", "d")
    assert months.read(spark, root, "e").count() == 0 and months.read(spark, root, "e").columns == ["k", "d", "q"]
    months.merge(frame(spark, ("a", "2024-01-01", 1.0, "x"), schema=SCHEMA + ", note string"), root, "t", ["k", "d"])
    months.merge(frame(spark, ("b", "2024-05-01", 1.0), schema=SCHEMA), root, "t", ["k", "d"])
    assert sorted((r.k, r.note) for r in months.read(spark, root, "t").collect()) == [("a", "x"), ("b", None)]


def test_the_second_of_two_writers_fails(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    months.create(frame(spark, ("a", "2024-01-01", 1.0)), root, "t", "d")
    whole, ran = months._write, []

    def slow(*args):
        out = whole(*args)
        if not ran:  # another writer merges while this one has yet to commit
            ran.append(True)
            months.merge(frame(spark, ("b", "2024-02-01", 2.0)), root, "t", ["k", "d"])
        return out

    monkeypatch.setattr(months, "_write", slow)
    with pytest.raises(months.Conflict):
        months.merge(frame(spark, ("c", "2024-03-01", 3.0)), root, "t", ["k", "d"])
    assert held(months.read(spark, root, "t")) == [("a", "2024-01-01", 1.0), ("b", "2024-02-01", 2.0)]
    assert months.merge(frame(spark, ("c", "2024-03-01", 3.0)), root, "t", ["k", "d"]) == 3
    with pytest.raises(months.Conflict):  # the number is taken
        months._commit(spark, root, "t", 3, 3, {})
    (tmp_path / "t" / "versions" / "000000004.json").write_text('{"date"')  # a writer that was lost
    assert months.versions(spark, root, "t") == [1, 2, 3] and months.read(spark, root, "t").count() == 3
    assert months.merge(frame(spark, ("a", "2024-01-01", 9.0)), root, "t", ["k", "d"]) == 5
    assert months.read(spark, root, "t").count() == 3


def test_months_refuse_what_they_cannot_keep(spark, tmp_path):
    root, df = str(tmp_path), frame(spark, ("a", "2024-01-01", 1.0))
    months.create(df, root, "t", "d")
    for bad in (
        lambda: months.create(df, root, "t", "d"), lambda: months.create(df, root, "a/b", "d"), lambda: months.create(df, root, "u", "when"),
        lambda: months.merge(df, root, "u", ["k", "d"]), lambda: months.merge(df, root, "t", ["k"]), lambda: months.read(spark, root, "t", 7),
        lambda: months.merge(df.withColumn("q", F.lit("x")), root, "t", ["k", "d"]),
    ):
        with pytest.raises(ValueError):
            bad()


# ---------------------------------------------------------------- factors


def day_range(first, n, keep=lambda d: True):
    d, out = dt.date.fromisoformat(first), []
    while len(out) < n:
        if keep(d):
            out.append(d)
        d += dt.timedelta(1)
    return out


MONTH_END = day_range("2023-01-01", 9, lambda d: (d + dt.timedelta(1)).day == 1)
HISTORY = {
    "month end": MONTH_END,
    "quarter end": [d for d in day_range("2022-01-01", 12, lambda d: (d + dt.timedelta(1)).day == 1) if d.month % 3 == 0],
    "opening": [dt.date(2023, 1, 2), dt.date(2023, 2, 1), dt.date(2023, 3, 1), dt.date(2023, 4, 3)],
    "closing": [dt.date(2023, 3, 31), dt.date(2023, 4, 28), dt.date(2023, 5, 31)],
    "friday": day_range("2023-01-01", 6, lambda d: d.weekday() == 4),
    "business": day_range("2023-01-04", 12, lambda d: d.weekday() < 5),
    "daily": day_range("2023-01-04", 12),
    "year": [dt.date(y, 1, 1) for y in (2020, 2021, 2022)],
    "fifteenth": [dt.date(2023, m, 15) for m in (1, 2, 3, 4)],
    "hole": [d for d in MONTH_END if d.month != 4],
    "two": MONTH_END[:2],
    "one": MONTH_END[:1],
}
CALENDAR = {
    "month end": ("MONTHLY", "last day"), "quarter end": ("QUARTERLY", "last day"), "opening": ("MONTHLY", "first business day"),
    "closing": ("MONTHLY", "last business day"), "friday": ("WEEKLY", "weekday"), "business": ("DAILY", "business day"), "daily": ("DAILY", "day"),
    "year": ("YEARLY", "first day"), "fifteenth": ("MONTHLY", None), "hole": ("MONTHLY", None), "two": ("MONTHLY", None), "one": ("DAILY", None),
}


def history(spark):
    rows = [(n, d, float(i)) for n, ds in HISTORY.items() for i, d in enumerate(ds)]
    return spark.createDataFrame(rows, "factor_name string, factor_date date, factor_value double")


def test_calendars(spark):
    rows = history(spark)
    rows = rows.unionByName(rows).unionByName(spark.createDataFrame([("daily", None, 1.0), ("no date", None, 1.0)], rows.schema))
    got = {r.factor_name: (r.interval, r.anchor) for r in ser.factor_calendar(rows).collect()}
    assert got == CALENDAR
    assert ser.factor_calendar(rows.limit(0)).count() == 0


def test_factors_go_on_where_their_calendar_says(spark):
    out = ser.continue_factors(history(spark), "2024-01-10", "2024-07-02")
    got = {}
    for r in out.orderBy("factor_name", "factor_date").collect():
        got.setdefault(r.factor_name, []).append((r.factor_date, r.factor_value))
    days = [dt.date(2024, 1, 10) + dt.timedelta(i) for i in range(175)]
    last = lambda d: (d + dt.timedelta(1)).day == 1
    want = {
        "month end": [d for d in days if last(d)], "quarter end": [d for d in days if last(d) and d.month % 3 == 0],
        "opening": [dt.date(2024, m, d) for m, d in ((2, 1), (3, 1), (4, 1), (5, 1), (6, 3), (7, 1))],
        "closing": [dt.date(2024, m, d) for m, d in ((1, 31), (2, 29), (3, 29), (4, 30), (5, 31), (6, 28))],
        "friday": [d for d in days if d.weekday() == 4], "business": [d for d in days if d.weekday() < 5], "daily": days,
        "fifteenth": [dt.date(2024, m, 10) for m in range(1, 7)], "hole": [dt.date(2024, m, 10) for m in range(1, 7)],
    }
    assert {n: [d for d, _ in v] for n, v in got.items()} == want
    for name, points in got.items():  # each history is the line through 0, 1, 2, ...
        n = len(HISTORY[name])
        assert [v for _, v in points] == pytest.approx([n + i for i in range(len(points))])
    assert ser.continue_factors(history(spark), "2024-07-02", "2024-01-10").count() == 0
