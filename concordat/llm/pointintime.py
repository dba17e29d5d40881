"""Point-in-time features from a materialised temporal history.

Facts are intervals of validity: a click counts in a window of d days from the moment
it is known (the later of its time and its arrival plus a delay) until d days after its
time.  Each interval is a plus at its start and a minus at its end.  A client's pluses and
minuses, in order of time, are coalesced into segments of constant sums that end where
the next begins (``lead``); ties leave one segment.  Segments are split at the edges of
bins of 2^40 microseconds, halved for dense clients until a bin holds some 64 changes,
and a probe joins the one segment of its bin that holds its time.

Running sums never follow a client through one task: sums run within a bin, bins within
their base bin, and base bins, of which time sets the number, within the client.  The
sum at a bin's start is its opening, added to the segment that a probe finds.
Distinct items are counted by joining the overlapping intervals of a client and item into
one: within days, with the latest end of earlier days carried in.  The latest click
known is a running maximum, as clicks leave a window in the order of their times.

Defined results for odd input: a sale with a null client_id, sold_at or sale_id gives no row;
other rows without a client, time or arrival, and lines without shipped_at or of no
sale, never count; null and non-finite amounts are 0; repeated sales are sales of their
own, and a line counts for each row of its sale; fully equal clicks (by the seven columns
named) count once; an arrival before the time itself counts from the time; empty tables
give zeros or no rows; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

from .shared import materialize

DAY = 86_400_000_000
#: A bin spans 2^BASE microseconds, 12.7 days; a client's level halves it so many times.
BASE = 40
#: Changes of a client from which its bins are halved: with five months of time about 64 a bin.
DENSE = 1024


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970, of a time without a zone as if it were UTC."""
    if not isinstance(df.schema[name].dataType, TimestampNTZType):
        return F.unix_micros(F.col(name).cast("timestamp"))
    seconds = F.expr(f"cast(`{name}` - TIMESTAMP_NTZ '1970-01-01 00:00:00' as interval second)")
    return (seconds.cast("decimal(18,6)") * 1_000_000).cast("long")


def cents(c: Column) -> Column:
    x = c.cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), F.lit(0)).otherwise(F.floor(100 * x + 0.5)).cast("long")


def shift(level: Column) -> Column:
    return F.lit(BASE) - F.coalesce(level, F.lit(0))


def levelled(rows: DataFrame, levels: DataFrame) -> DataFrame:
    """Rows (client, t) with the width of their client's bins (a shift) and their bin."""
    out = rows.join(levels, "client", "left").withColumn("shift", shift(F.col("level"))).drop("level")
    return out.withColumn("bin", F.expr("shiftright(t, shift)"))


class History:
    """Segments of constant sums, by client and bin, and every bin's opening sums."""

    def __init__(self, changes: DataFrame, counts: DataFrame, probes: DataFrame, sums: list[str], latest: str | None = None, name: str = "history"):
        """changes: client, t, ``sums`` and ``latest`` (a struct or null), to be added from t on;
        counts: client, n, about the number of changes; probes: client, t."""
        self.sums, self.latest = sums, latest
        levels = counts.groupBy("client").agg(F.sum("n").alias("n")).filter(F.col("n") > DENSE)
        self.levels = materialize(levels.select("client", F.ceil(F.log2(F.col("n") / DENSE)).cast("int").alias("level")), name + "-levels")
        begun = levelled(probes.select("client", "t"), self.levels).withColumn("t", F.expr("shiftleft(bin, shift)"))
        begun = begun.withColumns({s: F.lit(0).cast("long") for s in sums})
        rows = levelled(changes, self.levels)
        if latest:
            begun = begun.withColumn(latest, F.lit(None).cast(changes.schema[latest].dataType))
        in_bin = Window.partitionBy("client", "bin").orderBy("t")
        so_far = in_bin.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        rows = rows.unionByName(begun).withColumn("till", F.lead("t").over(in_bin))
        rows = rows.withColumns(self._totals(so_far)).filter(F.col("till").isNull() | (F.col("t") < F.col("till")))
        self.segments = materialize(rows, name + "-segments")
        ends = self.segments.filter(F.col("till").isNull()).withColumn("base", F.shiftright("t", BASE)).drop("t", "till", "shift")
        before = lambda *key: Window.partitionBy(*key[:-1]).orderBy(key[-1]).rowsBetween(Window.unboundedPreceding, -1)
        whole = ends.groupBy("client", "base").agg(*(F.sum(s).alias(s) for s in sums), *([F.max(latest).alias(latest)] if latest else []))
        whole = whole.select("client", "base", *(c.alias("base_" + k) for k, c in self._totals(before("client", "base")).items()))
        ends = ends.select("client", "base", "bin", *(c.alias(k) for k, c in self._totals(before("client", "base", "bin")).items()))
        self.openings = ends.join(whole, ["client", "base"]).select("client", "bin", *(c.alias("open_" + k) for k, c in self._added("", "base_").items()))

    def _totals(self, w) -> dict[str, Column]:
        out = {s: F.coalesce(F.sum(s).over(w), F.lit(0)) for s in self.sums}
        return out | ({self.latest: F.max(self.latest).over(w)} if self.latest else {})

    def _added(self, a: str, b: str) -> dict[str, Column]:
        out = {s: F.col(a + s) + F.col(b + s) for s in self.sums}
        return out | ({self.latest: F.greatest(a + self.latest, b + self.latest)} if self.latest else {})

    def at(self, probes: DataFrame) -> DataFrame:
        """The probes (client, t and other columns) with the sums of the segment that holds t."""
        own = [c for c in probes.columns if c not in ("client", "t")]
        found = levelled(probes, self.levels).drop("shift").join(self.openings, ["client", "bin"])
        segments = self.segments.select("client", "bin", F.col("t").alias("since"), "till", *self.sums, *([self.latest] if self.latest else []))
        found = found.join(segments, ["client", "bin"]).filter((F.col("since") <= F.col("t")) & (F.col("till").isNull() | (F.col("t") < F.col("till"))))
        return found.select("client", "t", *own, *(c.alias(k) for k, c in self._added("", "open_").items()))


_LATEST = "struct<ts:long,id:long>"


def changes_of(rows: DataFrame, points: list[tuple[Column, dict[str, Column], Column]], names: list[str]) -> DataFrame:
    """A change for each row and point (time, what it adds, whether it applies)."""
    kind = lambda n: _LATEST if n == "latest" else "long"
    nothing = lambda n: F.lit(None) if n == "latest" else F.lit(0)
    made = [F.when(applies, F.struct(t.alias("t"), *(adds.get(n, nothing(n)).cast(kind(n)).alias(n) for n in names))) for t, adds, applies in points]
    return rows.select("client", F.explode(F.array(*made)).alias("c")).filter(F.col("c").isNotNull()).select("client", "c.*")


def windowed(days: tuple[int, ...], since: Column, known: Column, adds: dict[str, Column]) -> list[tuple[Column, dict[str, Column], Column]]:
    """The points of a fact of time ``since``, known from ``known`` on, for every window."""
    valid = {d: known < since + d * DAY for d in days}
    enter = {f"{n}_{d}": F.when(valid[d], c).otherwise(F.lit(0)) for d in days for n, c in adds.items()}
    return [(known, enter, F.lit(True))] + [(since + d * DAY, {f"{n}_{d}": -c for n, c in adds.items()}, valid[d]) for d in days]


def names_of(days: tuple[int, ...], *names: str) -> list[str]:
    return [f"{n}_{d}" for d in days for n in names]


def known_clicks(clicks: DataFrame, delay: int, longest: int) -> DataFrame:
    """client, ts, known, click_id, bought, cents of the distinct clicks that can ever count."""
    own = clicks.select("click_id", "ts", "arrived_at", "client_id", "kind", "value", "props").filter("client_id IS NOT NULL AND ts IS NOT NULL AND arrived_at IS NOT NULL").distinct()
    rows = own.select(F.col("client_id").alias("client"), micros(own, "ts").alias("ts"), micros(own, "arrived_at").alias("known"), F.col("click_id").cast("long").alias("click_id"), F.coalesce(F.col("kind") == "purchase", F.lit(False)).cast("long").alias("bought"), cents(F.col("value")).alias("cents"))
    return rows.withColumn("known", F.greatest("ts", F.col("known") + delay)).filter(F.col("known") < F.col("ts") + longest * DAY)


def known_lines(lines: DataFrame, sales: DataFrame, longest: int) -> DataFrame:
    """client, item, sold, known, n, cents: lines of one client, item and times in one row.

    Adding them up first keeps the lines of one sale or item from meeting in one task.
    """
    rows = lines.select("sale_id", F.col("item_id").alias("item"), micros(lines, "shipped_at").alias("shipped"), cents(F.col("amount")).alias("cents")).filter("sale_id IS NOT NULL AND shipped IS NOT NULL")
    rows = rows.join(sales.select("sale_id", "client", "sold", F.col("known").alias("sale_known")), "sale_id")
    rows = rows.withColumn("known", F.greatest("sale_known", "shipped")).filter(F.col("known") < F.col("sold") + longest * DAY)
    return rows.groupBy("client", "item", "sold", "known").agg(F.count("*").alias("n"), F.sum("cents").alias("cents"))


def item_changes(lines: DataFrame, days: tuple[int, ...]) -> tuple[DataFrame, DataFrame]:
    """The lines with, for each window, whether they begin an interval of their item and when the one
    before it ended; and the end of each client and item's last interval."""
    lines = lines.withColumn("day", F.floor(F.col("known") / DAY))
    ends = {d: F.when(F.col("known") < F.col("sold") + d * DAY, F.col("sold") + d * DAY) for d in days}
    daily = lines.filter("item IS NOT NULL").groupBy("client", "item", "day").agg(*(F.max(ends[d]).alias(f"end_{d}") for d in days))
    by_day = Window.partitionBy("client", "item").orderBy("day")
    earlier = by_day.rowsBetween(Window.unboundedPreceding, -1)
    daily = daily.withColumns({f"carry_{d}": F.max(f"end_{d}").over(earlier) for d in days} | {"next": F.lead("day").over(by_day)})
    last = daily.filter("next IS NULL").select("client", *(F.greatest(f"carry_{d}", f"end_{d}").alias(f"end_{d}") for d in days))
    carried = daily.filter(reduce(Column.__or__, [F.col(f"carry_{d}").isNotNull() for d in days])).select("client", "item", "day", *(f"carry_{d}" for d in days))
    within = Window.partitionBy("client", "item", "day").orderBy("known", "sold").rowsBetween(Window.unboundedPreceding, -1)
    rows = lines.join(carried, ["client", "item", "day"], "left")
    rows = rows.withColumns({f"before_{d}": F.when(F.col("item").isNotNull(), F.greatest(F.col(f"carry_{d}"), F.max(ends[d]).over(within))) for d in days})
    begins = {f"begins_{d}": ends[d].isNotNull() & F.col("item").isNotNull() & (F.col(f"before_{d}").isNull() | (F.col("known") > F.col(f"before_{d}"))) for d in days}
    return rows.withColumns(begins).drop("day", *(f"carry_{d}" for d in days)), last


def point_in_time(probes: DataFrame, clicks: DataFrame, sales: DataFrame, lines: DataFrame, days: tuple[int, ...] = (2, 14), delay_minutes: int = 240, horizon_days: int = 7) -> DataFrame:
    """The features of every probe (client, t in microseconds, and other columns) for each window.

    The probes' other columns must not have the names of the features or of the history's columns.

    Adds d, label (a sale within the horizon after t), n_clicks, n_purchases, click_cents,
    last_click_id, n_sales, sale_cents, n_lines, n_items and line_cents.
    """
    delay, longest = delay_minutes * 60_000_000, max(days)
    own = [c for c in probes.columns if c not in ("client", "t")]
    clicks = materialize(known_clicks(clicks, delay, longest), "pit-clicks")
    names = names_of(days, "n_clicks", "n_purchases", "click_cents")
    points = windowed(days, F.col("ts"), F.col("known"), {"n_clicks": F.lit(1), "n_purchases": F.col("bought"), "click_cents": F.col("cents")})
    points[0][1]["latest"] = F.struct(F.col("ts"), F.col("click_id").alias("id"))
    click_history = History(changes_of(clicks, points, [*names, "latest"]), clicks.groupBy("client").agg((3 * F.count("*")).alias("n")), probes, names, "latest", "pit-click")

    sold = sales.filter("client_id IS NOT NULL AND sold_at IS NOT NULL")
    sold = sold.select("sale_id", F.col("client_id").alias("client"), micros(sold, "sold_at").alias("sold"), micros(sold, "arrived_at").alias("arrived"), cents(F.col("total")).alias("cents"))
    sold = sold.withColumn("known", F.when(F.col("arrived").isNotNull(), F.greatest("sold", F.col("arrived") + delay)))
    names = [*names_of(days, "n_sales", "sale_cents"), "ahead"]
    points = windowed(days, F.col("sold"), F.col("known"), {"n_sales": F.lit(1), "sale_cents": F.col("cents")})
    points[0] = (*points[0][:2], F.col("known").isNotNull())
    points += [(F.col("sold") - horizon_days * DAY, {"ahead": F.lit(1)}, F.lit(True)), (F.col("sold"), {"ahead": F.lit(-1)}, F.lit(True))]
    sale_history = History(changes_of(sold, points, names), sold.groupBy("client").agg((5 * F.count("*")).alias("n")), probes, names, None, "pit-sale")

    bought = materialize(known_lines(lines, sold.filter("known IS NOT NULL"), longest), "pit-lines")
    rows, last = item_changes(bought, days)
    names = names_of(days, "n_lines", "line_cents", "n_items")
    points = windowed(days, F.col("sold"), F.col("known"), {"n_lines": F.col("n"), "line_cents": F.col("cents")})
    points[0][1].update({f"n_items_{d}": F.col(f"begins_{d}").cast("long") for d in days})
    points += [(F.col(f"before_{d}"), {f"n_items_{d}": F.lit(-1)}, F.col(f"begins_{d}") & F.col(f"before_{d}").isNotNull()) for d in days]
    changes = changes_of(rows, points, names).unionByName(changes_of(last, [(F.col(f"end_{d}"), {f"n_items_{d}": F.lit(-1)}, F.col(f"end_{d}").isNotNull()) for d in days], names))
    changes = changes.groupBy("client", "t").agg(*(F.sum(n).alias(n) for n in names))  # the lines of one large sale all leave at once
    line_history = History(changes, bought.groupBy("client").agg((5 * F.count("*")).alias("n")), probes, names, None, "pit-line")

    found = line_history.at(sale_history.at(click_history.at(probes)))
    recent = {d: F.when(F.col("latest.ts") > F.col("t") - d * DAY, F.col("latest.id")) for d in days}
    plain = ("n_clicks", "n_purchases", "click_cents", "n_sales", "sale_cents", "n_lines", "n_items", "line_cents")
    per_window = [F.struct(F.lit(d).alias("d"), recent[d].alias("last_click_id"), *(F.col(f"{n}_{d}").alias(n) for n in plain)) for d in days]
    return found.select("client", "t", *own, (F.col("ahead") > 0).alias("label"), F.explode(F.array(*per_window)).alias("w")).select("client", "t", *own, "label", "w.*")


def op11_point_in_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    clicks, sales, lines = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("clicks", "sales", "sale_lines"))
    later = F.crc32(F.col("sale_id").cast("string").cast("binary")) % 259200 * 1_000_000
    probes = sales.select("sale_id", F.col("client_id").alias("client"), (micros(sales, "sold_at") + later).alias("t")).filter("client IS NOT NULL AND t IS NOT NULL")
    out = point_in_time(probes, clicks, sales, lines)
    return out.select("sale_id", "d", F.col("t").alias("t_us"), "label", "n_clicks", "n_purchases", "click_cents", "last_click_id", "n_sales", "sale_cents", "n_lines", "n_items", "line_cents")


ORACLE_SQL = """
WITH crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS tab
), s AS (
  SELECT sale_id, client_id AS client, epoch_us(sold_at) AS sold, epoch_us(arrived_at) AS arrived,
    CASE WHEN isfinite(total) THEN CAST(floor(100 * total + 0.5) AS BIGINT) ELSE 0 END AS cents
  FROM sales WHERE client_id IS NOT NULL AND sold_at IS NOT NULL
), p AS (
  SELECT row_number() OVER () AS r, sale_id, client, sold + 1000000 * (xor(list_reduce(list_transform(string_split(CAST(sale_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
      lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8), 4294967295), 4294967295) % 259200) AS t
  FROM s, crc_table WHERE sale_id IS NOT NULL
), w AS (SELECT r, sale_id, client, t, d, t - d * 86400000000 AS since FROM p, (VALUES (2), (14)) AS x(d)),
c AS (
  SELECT click_id, client_id AS client, epoch_us(ts) AS ts, epoch_us(arrived_at) + 14400000000 AS known, kind,
    CASE WHEN isfinite(value) THEN CAST(floor(100 * value + 0.5) AS BIGINT) ELSE 0 END AS cents
  FROM (SELECT DISTINCT click_id, ts, arrived_at, client_id, kind, value, props FROM clicks)
), by_click AS (
  SELECT r, d, count(*) AS n_clicks, count(*) FILTER (WHERE kind = 'purchase') AS n_purchases, sum(cents) AS click_cents, arg_max(click_id, (ts, click_id)) AS last_click_id
  FROM w JOIN c ON w.client = c.client AND since < ts AND ts <= t AND known <= t GROUP BY r, d
), known_sales AS (
  SELECT r, d, t, s.* FROM w JOIN s ON w.client = s.client AND since < sold AND sold <= t AND arrived + 14400000000 <= t
), by_sale AS (SELECT r, d, count(*) AS n_sales, sum(cents) AS sale_cents FROM known_sales GROUP BY r, d),
by_line AS (
  SELECT r, d, count(*) AS n_lines, count(DISTINCT item_id) AS n_items, sum(CASE WHEN isfinite(amount) THEN CAST(floor(100 * amount + 0.5) AS BIGINT) ELSE 0 END) AS line_cents
  FROM known_sales k JOIN sale_lines l ON k.sale_id = l.sale_id AND epoch_us(shipped_at) <= t GROUP BY r, d
)
SELECT sale_id, CAST(d AS INTEGER) AS d, t AS t_us, EXISTS (SELECT 1 FROM s WHERE s.client = w.client AND w.t < s.sold AND s.sold <= w.t + 604800000000) AS label,
  coalesce(n_clicks, 0) AS n_clicks, coalesce(n_purchases, 0) AS n_purchases, CAST(coalesce(click_cents, 0) AS BIGINT) AS click_cents, last_click_id,
  coalesce(n_sales, 0) AS n_sales, CAST(coalesce(sale_cents, 0) AS BIGINT) AS sale_cents, coalesce(n_lines, 0) AS n_lines, coalesce(n_items, 0) AS n_items,
  CAST(coalesce(line_cents, 0) AS BIGINT) AS line_cents
FROM w LEFT JOIN by_click USING (r, d) LEFT JOIN by_sale USING (r, d) LEFT JOIN by_line USING (r, d)
"""
