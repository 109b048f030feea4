"""The leaderboards' feed against a fold in plain Python."""

import datetime
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from skeinlake.llm import leaderboard as lb

LINE = "sale_id long, line_no int, item_id long, vendor_id long, quantity int, amount double, discount double, flag string, shipped_at timestamp_ntz, day string"


def brute(lines, vendors, items):
    nations, prices, batches = dict(vendors), dict(items), defaultdict(list)
    for sale, line, item, vendor, quantity, amount, _, flag, shipped, _ in lines:
        text = ",".join("" if x is None else str(x) for x in (sale, item, vendor, line))
        h = zlib.crc32(text.encode())
        s = (shipped.date() - datetime.date(1970, 1, 1)).days if shipped else 19723 + h % 150
        a = s + h % 7 + (20 if h % 5 == 0 else 0)
        cents = math.floor(100 * amount + 0.5) if amount is not None else quantity * math.floor(100 * prices[item] + 0.5) if quantity is not None and prices.get(item) is not None else 0
        batches[max(1, min(8, 1 + math.floor((a - 19723) * 8 / 180)))].append((nations.get(vendor), item, item in prices, s, a, -cents if flag == "swapped" else cents))
    latest, deltas = None, defaultdict(lambda: defaultdict(list))
    for b in sorted(batches):
        for nation, item, listed, s, a, cents in batches[b]:
            if nation is not None and listed and not (latest is not None and s + 15 < latest):
                deltas[nation][a].append((item, cents))
        latest = max([s for *_, s, _, _ in batches[b]] + ([latest] if latest is not None else []))
    out = []
    for nation, days in deltas.items():
        revenue, board = defaultdict(float), []
        for a in sorted(days):
            for item, cents in days[a]:
                revenue[item] += cents
            now = sorted((i for i in revenue if revenue[i] > 0), key=lambda i: (-revenue[i], i))[:10]
            for item in {*board, *now}:
                old, new = (x.index(item) + 1 if item in x else None for x in (board, now))
                if old != new:
                    out.append((nation, a, item, max(1, min(8, 1 + math.floor((a - 19723) * 8 / 180))), "enter" if old is None else "exit" if new is None else "move", old, new, int(revenue[item])))
            board = now
    return sorted(out, key=repr)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def made(n, seed):
    draw = random.Random(seed)
    vendors = [(v, draw.choice([0, 1, 2, None])) for v in range(8)]
    items = [(i, draw.choice([None, 2.5, 10.005, 77.77])) for i in range(25)]
    lines = []
    for k in range(n):
        day = datetime.datetime(2023, 12, 20) + datetime.timedelta(days=min(int(k * 170 / n) + draw.randrange(12), 165), hours=draw.randrange(24))
        hot = draw.random() < 0.33
        lines.append((draw.choice([k, None]) if draw.random() < 0.02 else k // 2, draw.randrange(3), 3 if hot else draw.choice([*range(27), None]), 1 if hot else draw.choice([*range(9), None]), draw.choice([None, 0, 1, 3]), draw.choice([None, 0.0, 0.005, 12.345, 100.0]), 0.1, draw.choice(["kept", "swapped", "returned", None]), draw.choice([day, day, day, None]), "clash"))
    return lines + lines[:20], vendors, items


@pytest.mark.parametrize("slices", [1, 3])
def test_feed_equals_a_fold(spark, slices):
    lines, vendors, items = made(900, slices)
    got = lb.feed(spark.createDataFrame(lines, LINE), spark.createDataFrame(vendors, "vendor_id long, nation_id int"), spark.createDataFrame(items, "item_id long, price double"), slices)
    assert rows(got) == brute(lines, vendors, items)


def test_old_and_late_days(spark):
    """Days before 1970 and after 2100; a line from far ahead makes all later batches' lines late."""
    at = lambda *d: datetime.datetime(*d)
    lines = [(i, 1, i, 0, 1, 5.0 + i, 0.0, "kept", t, "x") for i, t in enumerate([at(1950, 1, 1), at(1969, 12, 31), at(2024, 1, 3), at(2024, 1, 3), at(2024, 2, 20), at(2024, 3, 20), at(2150, 1, 1), at(9999, 12, 31)] * 2)]
    vendors, items = [(0, 7)], [(i, 1.0) for i in range(20)]
    got = lb.feed(spark.createDataFrame(lines, LINE), spark.createDataFrame(vendors, "vendor_id long, nation_id int"), spark.createDataFrame(items, "item_id long, price double"))
    assert rows(got) == brute(lines, vendors, items)


def test_empty_tables(spark):
    none = spark.createDataFrame([], LINE)
    assert lb.feed(none, spark.createDataFrame([], "vendor_id long, nation_id int"), spark.createDataFrame([], "item_id long, price double")).collect() == []


def test_folding_in_parts_gives_the_same_boards():
    draw = np.random.default_rng(2)
    days, items, cents = draw.integers(0, 30, 400), draw.integers(0, 60, 400), draw.integers(-50, 100, 400).astype(float)
    empty = [np.empty(0, k) for k in lb._KINDS]
    whole, _ = lb._fold(days, items, cents, *empty[3:], np.inf)
    state, parts = [days, items, cents, *empty[3:]], []
    for until in (-1, 4, 11, 11, 29):
        some, state = lb._fold(*[x.copy() for x in state], until)
        parts += some
    assert parts == whole and not len(state[0])
