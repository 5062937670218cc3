"""Daily counts: the ratings of the log, day by day, without the log."""

from __future__ import annotations

import datetime as dt
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from affinity.operators import daily, ratings
from affinity.sources import schemas

WEIGHTS = {"a": 0.1, "b": 0.3}
ROWS = [
    (u, i, "abx"[(u + i + d) % 3], f"202401{d:02d}")
    for u in range(4) for i in range(3) for d in (1, 2, 2, 9, 15, 20) if (u * i + d) % 4
]
ODD = [(1, 7, "a", "soon"), (1, 7, None, None), (2, 1, "a", None)]


@pytest.fixture
def log(spark):
    return lambda rows: spark.createDataFrame(rows, schemas.USER_ACTIONS)


def bits(df):
    return sorted((r.uid, r.aid, r.rating.hex()) for r in df.collect())


def stamps(path):
    return {p: p.stat().st_mtime_ns for p in Path(path).glob("day=*/*.parquet")}


@pytest.mark.parametrize("as_of", [dt.date(2024, 1, 2), dt.date(2024, 1, 9), dt.date(2024, 2, 20)])
def test_ratings_equal_those_of_the_log(spark, log, tmp_path, as_of):
    counts = daily.write_days(log(ROWS + ROWS[:9] + ODD), str(tmp_path / "days"))
    until = [r for r in ROWS + ROWS[:9] + ODD if not (r[3] or "x").isdigit() or r[3] <= as_of.strftime("%Y%m%d")]
    expected = ratings.user_item_ratings(log(until), as_of, WEIGHTS)
    assert bits(daily.ratings_as_of(counts, as_of, WEIGHTS)) == bits(expected)


def test_a_new_day_touches_its_own_folder_only(spark, log, tmp_path):
    path = str(tmp_path / "days")
    daily.write_days(log([r for r in ROWS if r[3] < "20240115"]), path)
    before = stamps(path)
    daily.write_days(log([r for r in ROWS if r[3] >= "20240115"]), path)
    after = stamps(path)
    assert before.items() <= after.items() and len(after) > len(before)
    whole = daily.daily_counts(log(ROWS))
    assert sorted(daily.read_days(spark, path).collect()) == sorted(whole.collect())
    # A day written again is the same day.
    daily.write_days(log([r for r in ROWS if r[3] == "20240115"]), path)
    assert sorted(daily.read_days(spark, path).collect()) == sorted(whole.collect())


def test_late_rows_are_merged(spark, log, tmp_path):
    path = str(tmp_path / "days")
    late = [(3, 2, "a", "20240109"), (9, 9, "b", "20240109"), (9, 8, "b", "20240110"), (5, 5, "a", "?")]
    daily.write_days(log(ROWS + ODD), path)
    others = {p: t for p, t in stamps(path).items() if "day=2024-01-20" in str(p)}
    got = daily.write_days(log(late), path, merge=True)
    expected = daily.daily_counts(log(ROWS + ODD + late))
    key = lambda df: sorted(map(repr, df.collect()))
    assert key(got) == key(expected)
    assert others.items() <= stamps(path).items()


def test_only_days_up_to_the_one_asked_for_are_read(spark, log, tmp_path):
    counts = daily.write_days(log(ROWS), str(tmp_path / "days"))
    plan = daily.ratings_as_of(counts, dt.date(2024, 1, 9), WEIGHTS)._jdf.queryExecution().toString()
    assert "PartitionFilters: [(isnull(day" in plan and "<= 2024-01-09" in plan


def test_empty_log(spark, log, tmp_path):
    path = str(tmp_path / "days")
    daily.write_days(log(ROWS), path)
    assert daily.write_days(log([]), path).agg(F.sum("n")).first()[0] == len(ROWS)
    assert daily.ratings_as_of(daily.daily_counts(log([])), dt.date(2024, 1, 9)).count() == 0
