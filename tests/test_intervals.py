"""Periods and gaps against a day-by-day count, with entities split over many partitions."""

import random
from datetime import date, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspan.functions.dates import edition_no, parse_day, parse_month
from quillspan.operators.intervals import merge_intervals

D0 = date(2020, 1, 1)
SCHEMA = "entity string, from_day date, to_day date, span_kind string, __s string"


def brute(rows):
    out = []
    for e in {r[0] or "" for r in rows}:
        days = sorted({a + timedelta(k) for x, a, b in rows if (x or "") == e and a and b and a <= b for k in range((b - a).days + 1)})
        runs = []
        for d in days:
            if runs and d == runs[-1][1] + timedelta(1):
                runs[-1][1] = d
            else:
                runs.append([d, d])
        out += [(e, "period", a, b) for a, b in runs]
        out += [(e, "gap", x[1] + timedelta(1), y[0] - timedelta(1)) for x, y in zip(runs, runs[1:])]
    return sorted(out)


def got(spark, rows, width=5):
    df = spark.createDataFrame([(e, a, b, "clash", "clash") for e, a, b in rows], SCHEMA)
    return sorted((r.entity, r.span_kind, r.from_date, r.to_date) for r in merge_intervals(df, ["entity"], width=width).collect())


day = st.integers(0, 40).map(lambda k: D0 + timedelta(k))
interval = st.tuples(st.sampled_from(["a", "b", None, ""]), st.one_of(st.none(), day), st.one_of(st.none(), day))


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(interval, max_size=25), st.integers(1, 6))
def test_any_intervals(spark, rows, width):
    assert got(spark, rows, width) == brute(rows)


def test_one_entity_holding_most_rows_spans_partitions(spark):
    random.seed(1)
    rows = [("hot", D0 + timedelta(a := random.randrange(3000)), D0 + timedelta(a + random.randrange(3))) for _ in range(800)]
    rows += [("hot", D0, D0 + timedelta(600))] + [("z", D0, D0)] * 3
    assert got(spark, rows, 16) == brute(rows)


def test_one_interval_covers_all_partitions(spark):
    rows = [("e", D0, D0 + timedelta(500))] + [("e", D0 + timedelta(k), D0 + timedelta(k)) for k in range(0, 700, 7)]
    assert got(spark, rows, 8) == brute(rows)


def test_empty(spark):
    assert got(spark, []) == []


@pytest.mark.parametrize(
    ("text", "day"),
    [
        ("2020-02-01", "2020-02-01"), ("01/02/2020", "2020-02-01"), ("1 February 2020", "2020-02-01"), ("1 Feb 2020", "2020-02-01"), (" 2020-02-01 10:20:30", "2020-02-01"),
        ("31/02/2020", None), ("TO FOLLOW", None), ("#REF!", None), ("", None), (None, None), ("2020-13-01", None), ("1 Fob 2020", None),
    ],
)
def test_parse_day(spark, text, day):
    r = spark.createDataFrame([(text,)], "t string").select(parse_day(F.col("t")).cast("string").alias("d")).first()
    assert r.d == day


@pytest.mark.parametrize(("text", "month"), [("2021-08", "2021-08"), ("Aug-21", "2021-08"), ("August 2021", "2021-08"), ("08/2021", "2021-08"), ("2021-08-09", "2021-08"), ("2021-18", ""), ("soon", ""), (None, "")])
def test_parse_month(spark, text, month):
    assert spark.createDataFrame([(text,)], "t string").select(parse_month(F.col("t")).alias("m")).first().m == month


def test_edition_order(spark):
    rows = spark.createDataFrame([("july2023",), (" December2022 ",), ("soon",), (None,)], "e string").select(edition_no(F.col("e")).alias("n"))
    assert [r.n for r in rows.collect()] == [2023 * 12 + 6, 2022 * 12 + 11, None, None]
