import datetime as dt
import random
from collections import defaultdict

import pytest

from ledgerloom.plans.trend import Weeks, week_over_week

WEEKS = Weeks(dt.date(2025, 5, 12), dt.date(2025, 5, 18), dt.date(2025, 5, 5), dt.date(2025, 5, 11))
BEFORE, NOW = dt.datetime(2025, 5, 6), dt.datetime(2025, 5, 13)


def test_labels_percent_and_order(make_items, rows):
    items = make_items(
        {"resource": "up", "used": BEFORE, "cost": 3},
        {"resource": "up", "used": NOW, "cost": 4},
        {"resource": "new", "used": NOW, "cost": 9},
        {"resource": "down", "used": BEFORE, "cost": 8},
        {"resource": "same", "used": BEFORE, "cost": 2},
        {"resource": "same", "used": NOW, "cost": 2},
        {"resource": "zero", "used": NOW, "cost": 0},
        {"resource": "", "used": NOW, "cost": 100},
    )
    assert [(r[0], r[3], r[4], r[5], r[6], r[7]) for r in rows(week_over_week(items, WEEKS))] == [
        ("new", 0.0, 9.0, 9.0, None, "New Resource"),
        ("up", 3.0, 4.0, 1.0, 33.33, "Increasing"),
        ("same", 2.0, 2.0, 0.0, 0.0, "Stable"),
        ("down", 8.0, 0.0, -8.0, -100.0, "Decreasing"),
    ]


def test_a_negative_base_has_no_percentage(make_items, rows):
    items = make_items({"used": BEFORE, "cost": -2}, {"used": NOW, "cost": 5})
    assert [r[3:] for r in rows(week_over_week(items, WEEKS))] == [(-2.0, 5.0, 7.0, 0.0, "Increasing")]


def test_the_last_day_counts_only_at_midnight(make_items, rows):
    items = make_items(
        {"used": dt.datetime(2025, 5, 18), "cost": 1},
        {"used": dt.datetime(2025, 5, 18, 13), "cost": 10},
        {"used": dt.datetime(2025, 5, 11, 13), "cost": 20},
        {"used": dt.datetime(2025, 5, 5), "cost": 2},
    )
    assert [r[3:5] for r in rows(week_over_week(items, WEEKS))] == [(2.0, 1.0)]


def test_places_repeat_the_cost_of_the_whole_resource(make_items, rows):
    items = make_items(
        {"service": "a", "used": NOW, "cost": 1},
        {"service": "b", "used": NOW, "cost": 2},
        # Credits cost nothing here, but show where the resource was.
        {"service": "c", "used": BEFORE, "cost": 50, "type": "Credit"},
    )
    assert [(r[1], r[3], r[4]) for r in rows(week_over_week(items, WEEKS))] == [
        ("a", 0.0, 3.0),
        ("b", 0.0, 3.0),
        ("c", 0.0, 3.0),
    ]


def test_weeks_must_follow_each_other():
    with pytest.raises(ValueError):
        Weeks(WEEKS.previous_start, WEEKS.previous_end, WEEKS.current_start, WEEKS.current_end)


@pytest.mark.parametrize("k", [1, 4, 20, None])
def test_same_as_the_join_form(make_items, rows, k):
    """Against brute force, with one resource that holds most rows."""
    random.seed(k)
    data = [
        {
            "resource": random.choice(["hot", "hot", "hot", "a", "b", "c", "", "d"]),
            "service": random.choice("xyz"),
            "region": random.choice(["n", "s"]),
            "type": random.choice(["Usage", "Usage", "Credit", "Refund", "Tax"]),
            "used": dt.datetime(2025, 5, 4) + dt.timedelta(hours=random.randrange(24 * 16)),
            "cost": random.randrange(0, 9),
        }
        for _ in range(300)
    ]

    def within(row, first, last):
        return dt.datetime.combine(first, dt.time()) <= row["used"] <= dt.datetime.combine(last, dt.time())

    costs = {"now": defaultdict(int), "before": defaultdict(int)}
    places = set()
    for row in data:
        if not row["resource"]:
            continue
        if within(row, WEEKS.previous_start, WEEKS.current_end):
            places.add((row["resource"], row["service"], row["region"]))
        if row["type"] not in ("Credit", "Refund"):
            if within(row, WEEKS.current_start, WEEKS.current_end):
                costs["now"][row["resource"]] += row["cost"]
            if within(row, WEEKS.previous_start, WEEKS.previous_end):
                costs["before"][row["resource"]] += row["cost"]
    expected = sorted(
        ((*p, costs["before"][p[0]], costs["now"][p[0]]) for p in places if costs["before"][p[0]] or costs["now"][p[0]]),
        key=lambda r: (r[3] - r[4], r[0], r[1], r[2]),
    )[:k]
    assert [r[:5] for r in rows(week_over_week(make_items(*data), WEEKS, k))] == expected
