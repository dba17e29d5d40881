"""Point-in-time features against plain loops over each probe's facts."""

import datetime as dt
import random
import zlib

import pytest
from pyspark.sql import functions as F

from concordat.llm import pointintime
from concordat.llm.pointintime import DAY, point_in_time

CLICKS = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string"
SALES = "sale_id long, client_id long, status string, total double, sold_at timestamp_ntz, arrived_at timestamp_ntz, t long, client string"
LINES = "sale_id long, line_no int, item_id long, amount double, shipped_at timestamp_ntz, known long, day int"
FIRST = dt.datetime(2024, 1, 1)
FEATURES = ("n_clicks", "n_purchases", "click_cents", "last_click_id", "n_sales", "sale_cents", "n_lines", "n_items", "line_cents")


def us(t):
    return (t - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)


def cents(x):
    import math

    return 0 if x is None or not math.isfinite(x) else math.floor(100 * x + 0.5)


def plain(clicks, sales, lines):
    out = []
    for sale_id, client, _, _, sold, *_ in sales:
        if None in (sale_id, client, sold):
            continue
        t = us(sold) + zlib.crc32(str(sale_id).encode()) % 259200 * 1_000_000
        label = any(c == client and s and t < us(s) <= t + 7 * DAY for _, c, _, _, s, *_ in sales)
        for d in (2, 14):
            inside = lambda x, a: x and a and t - d * DAY < us(x) <= t and us(a) + 14_400_000_000 <= t  # noqa: B023, E731
            own = [c for c in set(clicks) if c[3] == client and inside(c[1], c[2])]
            last = max(((c[1], -1 if c[0] is None else c[0], c[0]) for c in own), default=(None, None, None))[2]
            bought = [s for s in sales if s[1] == client and inside(s[4], s[5])]
            parts = [x for s in bought for x in lines if x[0] is not None and x[0] == s[0] and x[4] and us(x[4]) <= t]
            out.append((sale_id, d, t, label, len(own), sum(c[4] == "purchase" for c in own), sum(cents(c[5]) for c in own), last, len(bought), sum(cents(s[3]) for s in bought), len(parts), len({x[2] for x in parts} - {None}), sum(cents(x[3]) for x in parts)))
    return sorted(out, key=str)


def run(spark, clicks, sales, lines):
    c, s, x = spark.createDataFrame(clicks, CLICKS), spark.createDataFrame(sales, SALES), spark.createDataFrame(lines, LINES)
    later = F.crc32(F.col("sale_id").cast("string").cast("binary")) % 259200 * 1_000_000
    probes = s.select("sale_id", F.col("client_id").alias("client"), (pointintime.micros(s, "sold_at") + later).alias("t")).filter("client IS NOT NULL AND t IS NOT NULL")
    return sorted((tuple(r) for r in point_in_time(probes, c, s, x).select("sale_id", "d", "t", "label", *FEATURES).collect()), key=str)


def made(seed, clients, n):
    g = random.Random(seed)
    at = lambda span=40: FIRST + dt.timedelta(seconds=g.choice([g.randrange(span * 86400), g.randrange(span) * 86400]))
    late = lambda t: t + dt.timedelta(seconds=g.choice([0, 60, 7200, 3 * 86400, 15 * 86400, -600]))
    clicks = [(g.choice([i, i // 2]), t, late(t), g.choice(clients), g.choice(["view", "purchase", None]), g.choice([1.005, -2.5, None, float("nan"), float("inf")]), "{}") for i in range(n) for t in [at()]]
    clicks += clicks[::5] + [(None, FIRST, FIRST, clients[0], "view", 1.0, None), (1, None, FIRST, clients[0], "view", 1.0, None), (2, FIRST, None, clients[0], "view", 1.0, None), (3, FIRST, FIRST, None, "view", 1.0, None)]
    sales = [(i, g.choice(clients), "x", g.choice([10.0, 0.125, None]), t, late(t), 5, "y") for i in range(n // 2) for t in [at()]]
    sales += sales[::9] + [(None, 1, "x", 1.0, FIRST, FIRST, 5, "y"), (n, None, "x", 1.0, FIRST, FIRST, 5, "y"), (n + 1, 1, "x", 1.0, None, FIRST, 5, "y"), (n + 2, 1, "x", 1.0, FIRST, None, 5, "y")]
    lines = [(g.randrange(n), i, g.choice([1, 1, 2, 3, None]), g.choice([2.0, 0.335, None]), g.choice([None, FIRST + dt.timedelta(days=g.randrange(50))]), 0, 0) for i in range(2 * n)]
    return clicks, sales, [*lines, *lines[::7], (None, 1, 1, 1.0, FIRST, 0, 0)]


@pytest.mark.parametrize("seed", [1, 2])
def test_every_probe(spark, seed):
    tables = made(seed, [1, 1, 1, 2, 3, None], 150)
    assert run(spark, *tables) == plain(*tables)


def test_dense_client_in_narrow_bins(spark, monkeypatch):
    monkeypatch.setattr(pointintime, "DENSE", 2)
    tables = made(3, [1, 1, 1, 1, 2], 250)
    assert run(spark, *tables) == plain(*tables)


def test_empty_tables(spark):
    _, sales, _ = made(4, [1, 2], 12)
    assert run(spark, [], sales, []) == plain([], sales, [])
    assert run(spark, [], [], []) == []
