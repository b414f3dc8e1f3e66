"""Point-in-time features of sales: what was known of a client at a time t, over windows of days, and what came next.

Every feature is a sum over events of the client that are active at t: from the time an event is known (entry) until it has
left the window of d days (expiry). So it is the running total of an entry log at t less that of an expiry log at t - d.
The logs (clicks, sales, their lines, items; for the last click a running maximum by time and id; for the label the next
sale) are kept apart and hold one client's changes in order of time. Distinct items are counted by joining an item's
overlapping intervals first, so that an item enters once and expires once.

Logs and lookups (t, and t - d for each d) are dealt by ranges of (client, time). A range is a time slice: its task takes
running totals and looks them up with pandas ``merge_asof``, and tells the totals of its last client and the first
sale of its first one; from these, windows over the few slices of a client make the opening balances, which are added before
the lookups of a sale are joined again. A hot client is cut into as many slices as its rows ask for, and no row goes to the
driver, into a broadcast, or all to one task.

Overlaps of an item are joined in two steps: intervals that run beyond the hour in which they begin are one interval per
hour (else per minute, else per microsecond), and a window goes over what is left, so a hot pair of client and item has as
many rows there as hours.

Defined results: a sale without client or time has no row and counts nowhere; one that never arrived counts for labels alone; clicks
or lines without a time count nowhere; rows of clicks that are equal in all columns count once; a repeated
row of sales counts, has a row, and is joined with its lines, each time; NaN and infinite amounts are 0; the null sale_id has
the crc32 of the empty text; a null click_id is the smallest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

DAY, HOUR, MINUTE = 86_400_000_000, 3_600_000_000, 60_000_000
DAYS = (2, 14)
LABEL_DAYS = 7
#: Minutes after its arrival until a row is known.
DELAY = 240
#: Seconds over which the times of features are spread behind the sales.
SPREAD = 259_200
#: Rows of a time slice, about.
SLICE = 300_000
#: Logs and their measures.
LOGS = {"clicks": ("n", "p", "c"), "sales": ("n", "c"), "lines": ("n", "c"), "items": ("n",)}
MEASURES = ("n", "p", "c")
ENTRY, EXPIRY, NEXT, LOOKUP = 0, 10, 20, 30
NONE = -(2**63)


def micros(at: str) -> Column:
    """Microseconds since 1970 of a timestamp with or without a zone (then UTC), whatever the session's zone."""
    gap = f"(`{at}` - TIMESTAMP_NTZ '1970-01-01 00:00:00')"
    plain = F.expr(f"extract(DAY FROM {gap}) * {DAY}L + extract(HOUR FROM {gap}) * {HOUR}L + extract(MINUTE FROM {gap}) * {MINUTE}L + cast(extract(SECOND FROM {gap}) * 1000000 AS BIGINT)")
    return plain.cast("bigint")


def _time(df: DataFrame, name: str) -> Column:
    return micros(name) if dict(df.dtypes)[name] == "timestamp_ntz" else F.unix_micros(F.col(name).cast("timestamp"))


def cents(amount: str) -> Column:
    x = F.col(amount).cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")) | x.isNull(), F.lit(0)).otherwise(F.floor(x * 100 + 0.5)).cast("bigint")


def _known(at: str = "at", arrived: str = "arrived") -> Column:
    """When an event is known; null where one of its times is."""
    return F.when(F.col(at).isNotNull() & F.col(arrived).isNotNull(), F.greatest(F.col(at), F.col(arrived) + DELAY * MINUTE))


def _in_window(days: tuple[int, ...], values: dict[str, Column], known: str, at: str) -> list[Column]:
    """Each measure for each window: 0 where the event has left the window before it is known."""
    return [F.when(F.col(known) < F.col(at) + d * DAY, values.get(m, F.lit(0))).otherwise(F.lit(0)).cast("bigint").alias(f"{m}_{d}") for d in days for m in MEASURES]


def _columns(days: tuple[int, ...]) -> list[str]:
    return [f"{m}_{d}" for d in days for m in MEASURES]


def _log(rows: DataFrame, code: int, at: str, days: tuple[int, ...], x1: Column | None = None, x2: Column | None = None) -> DataFrame:
    """Rows of one log: client, at, log, two extra numbers, and the measures that ``rows`` has (else 0)."""
    has = [F.col(c) if c in rows.columns else F.lit(0).cast("bigint").alias(c) for c in _columns(days)]
    extra = [(F.lit(None) if x is None else x).cast("bigint").alias(name) for name, x in (("x1", x1), ("x2", x2))]
    return rows.select(F.col("client"), F.col(at).alias("at"), F.lit(code).cast("int").alias("log"), *extra, *has)


def _distinct(df: DataFrame) -> DataFrame:
    """Rows that are equal in all columns once; long columns are compared by their 128-bit digests."""
    keys = [F.unhex(F.md5(F.col(f"`{c}`"))).alias(c) if kind == "string" and c != "kind" else F.to_json(F.struct(F.col(f"`{c}`"))).alias(c) if "map<" in kind or kind == "variant" else F.col(f"`{c}`") for c, kind in df.dtypes]
    return df.select(*keys).distinct()


def _items(lines: DataFrame, days: tuple[int, ...]) -> tuple[DataFrame, DataFrame]:
    """Entries and expiries of items: client, at and n of each window; an item's overlapping intervals are one."""
    d0 = days[0]
    early = F.col("b") < F.col("s") + d0 * DAY  # in the shorter window too
    end = F.col("s") + F.when(F.col("early"), d0 * DAY).otherwise(days[-1] * DAY)
    level = F.when(F.floor(F.col("b") / HOUR) + 1 <= end / HOUR, F.lit(HOUR)).when(F.floor(F.col("b") / MINUTE) + 1 <= end / MINUTE, F.lit(MINUTE)).otherwise(F.lit(1))
    spans = lines.where("item is not null").select("client", "item", "b", "s", early.alias("early")).withColumn("level", level.cast("bigint"))
    spans = spans.groupBy("client", "item", "early", "level", F.expr("b div level").alias("cell")).agg(F.min("b").alias("b"), F.max("s").alias("s"))
    order = W.partitionBy("client", "item").orderBy("b", "level", "cell", "early")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    of = {d: F.col("s") if d == days[-1] else F.when(F.col("early"), F.col("s")) for d in days}
    seen = spans.select("client", "item", "b", "s", "early", *[F.max(of[d]).over(before).alias(f"before_{d}") for d in days], F.lead("b").over(order).isNull().alias("last"))
    opens = {d: of[d].isNotNull() & (F.col(f"before_{d}").isNull() | (F.col("b") >= F.col(f"before_{d}") + d * DAY)) for d in days}
    bit = lambda c: F.coalesce(c, F.lit(False)).cast("bigint")
    entry = seen.select("client", F.col("b").alias("at"), *[bit(opens[d]).alias(f"n_{d}") for d in days])
    # The end of the interval before, where a new one opens, and the end of the last one; both windows in one row where they agree.
    ends = [(f"before_{d}", d, opens[d] & F.col(f"before_{d}").isNotNull()) for d in days] + [(F.greatest(F.col(f"before_{d}"), of[d]), d, F.col("last")) for d in days]
    marks = F.array(*[F.struct((F.col(at) if isinstance(at, str) else at).alias("at"), *[bit(cond if d == e else F.lit(False)).alias(f"n_{e}") for e in days]) for at, d, cond in ends])
    used = F.filter(marks, lambda m: m["at"].isNotNull() & (sum((m[f"n_{d}"] for d in days[1:]), m[f"n_{days[0]}"]) > 0))
    same = (F.size(used) == len(days)) & (F.array_min(F.transform(used, lambda m: m["at"])) == F.array_max(F.transform(used, lambda m: m["at"]))) & F.col("last") & F.forall(F.array(*[F.col(f"before_{d}").isNull() for d in days]), lambda x: x)
    one = F.array(F.struct(F.col("s").alias("at"), *[F.lit(1).cast("bigint").alias(f"n_{d}") for d in days]))
    expiry = seen.select("client", F.explode(F.when(same, one).otherwise(used)).alias("m")).select("client", "m.*")
    return entry.where(" + ".join(f"n_{d}" for d in days) + " > 0"), expiry


def features(clicks: DataFrame, sales: DataFrame, sale_lines: DataFrame, days: tuple[int, ...] = DAYS, label_days: int = LABEL_DAYS) -> DataFrame:
    """sale_id, d, t_us, label and the features of every sale with a client and a time, a row per window of ``days``."""
    days = tuple(sorted(days))
    columns = _columns(days)
    sold = sales.select("sale_id", F.col("client_id").cast("bigint").alias("client"), _time(sales, "sold_at").alias("at"), _time(sales, "arrived_at").alias("arrived"), cents("total").alias("c")).where("client is not null and at is not null")
    sold = sold.withColumn("known", _known())
    digits = F.coalesce(F.col("sale_id").cast("string"), F.lit("")).cast("binary")
    asked = sold.groupBy("sale_id", "client", (F.col("at") + F.crc32(digits) % SPREAD * 1_000_000).alias("t")).agg(F.count("*").alias(columns[0]))

    clicked = _distinct(clicks).select(F.col("click_id").cast("bigint").alias("click_id"), F.col("client_id").cast("bigint").alias("client"), _time(clicks, "ts").alias("at"), _time(clicks, "arrived_at").alias("arrived"), "kind", cents("value").alias("c"))
    clicked = clicked.withColumn("known", _known()).where(F.col("client").isNotNull() & (F.col("known") < F.col("at") + days[-1] * DAY))
    bought = (F.coalesce(F.col("kind"), F.lit("")) == "purchase").cast("bigint")
    clicked = common.materialize(clicked.select("client", "click_id", "at", "known", *_in_window(days, {"n": F.lit(1), "p": bought, "c": F.col("c")}, "known", "at")), "times-clicks")
    seen = sold.where(F.col("known") < F.col("at") + days[-1] * DAY)
    counted = seen.select("client", "at", "known", *_in_window(days, {"n": F.lit(1), "c": F.col("c")}, "known", "at"))

    lines = sale_lines.select("sale_id", F.col("item_id").cast("bigint").alias("item"), _time(sale_lines, "shipped_at").alias("shipped"), cents("amount").alias("c")).where("sale_id is not null and shipped is not null")
    lines = lines.join(seen.select("sale_id", "client", F.col("at").alias("s"), "known").hint("shuffle_merge"), "sale_id").withColumn("b", F.greatest("known", "shipped"))
    lines = common.materialize(lines.where(F.col("b") < F.col("s") + days[-1] * DAY).select("client", "item", "b", "s", "c"), "times-lines")
    measured = lines.select("client", "b", "s", *_in_window(days, {"n": F.lit(1), "c": F.col("c")}, "b", "s"))
    added = lambda key: measured.groupBy("client", key).agg(*[F.sum(c).alias(c) for c in columns])
    item_entry, item_expiry = _items(lines, days)

    logs = [
        _log(clicked, ENTRY, "known", days, F.col("at"), F.coalesce(F.col("click_id"), F.lit(NONE))), _log(clicked, EXPIRY, "at", days),
        _log(counted, ENTRY + 1, "known", days), _log(counted, EXPIRY + 1, "at", days),
        _log(added("b"), ENTRY + 2, "b", days), _log(added("s"), EXPIRY + 2, "s", days),
        _log(item_entry, ENTRY + 3, "at", days), _log(item_expiry, EXPIRY + 3, "at", days),
        _log(sold, NEXT, "at", days),
        _log(asked, LOOKUP, "t", days, F.col("t"), F.col("sale_id")),
        *[_log(asked.withColumn("at", F.col("t") - d * DAY), LOOKUP + d, "at", days, F.col("t"), F.col("sale_id")) for d in days],
    ]
    everything = logs[0]
    for log in logs[1:]:
        everything = everything.unionByName(log)
    everything = common.materialize(everything, "times-logs")
    slices = max(1, -(-everything.count() // SLICE), int(clicks.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = everything.repartitionByRange(slices, "client", "at")
    sums = [f"{log}_{m}_{d}" for log, kinds in LOGS.items() for m in kinds for d in days]
    schema = "slice int, client bigint, log int, t bigint, sale_id bigint, times bigint, last_at bigint, last_id bigint, next bigint, " + ", ".join(f"{c} bigint" for c in sums) + ", " + ", ".join(f"x_{c} bigint" for c in sums)
    found = common.materialize(dealt.mapInArrow(lambda batches: _lookups(batches, days), schema), "times-found")
    return _rejoined(found, sums, days, label_days)


def _lookups(batches: Iterator[pa.RecordBatch], days: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    """The lookups of a slice with what its own logs say, and an edge row for its first and its last client."""
    table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
    if table is None or not table.num_rows:
        return
    ids = table.column("x2")
    rows = table.drop_columns(["x2"]).to_pandas()
    rows["x1"] = table.column("x1").fill_null(0).to_numpy()
    rows["x2"] = ids.fill_null(NONE).to_numpy()
    rows["place"] = np.arange(len(rows))
    rows = rows.sort_values("at", kind="stable", ignore_index=True)
    of = dict(tuple(rows.groupby("log")))
    empty = rows.iloc[:0]
    first, last = rows["client"].min(), rows["client"].max()
    now = of.get(LOOKUP, empty).reset_index(drop=True)
    before = {d: of.get(LOOKUP + d, empty).reset_index(drop=True) for d in days}
    parts = {LOOKUP: (now, {}), **{LOOKUP + d: (frame, {}) for d, frame in before.items()}}
    edge: dict[str, int] = {}

    def asof(left: pd.DataFrame, log: pd.DataFrame, **how) -> np.ndarray:
        """For each lookup the place in ``log`` of what it finds, or -1."""
        right = pd.DataFrame({"client": log["client"].to_numpy(), "at": log["at"].to_numpy(), "i": np.arange(len(log))})
        return pd.merge_asof(left[["client", "at"]], right, on="at", by="client", **how)["i"].fillna(-1).to_numpy(np.int64)

    def taken(values: np.ndarray, places: np.ndarray, none: int = 0) -> np.ndarray:
        return np.append(values, none)[places]

    for k, (name, kinds) in enumerate(LOGS.items()):
        entry, expiry = of.get(ENTRY + k, empty), of.get(EXPIRY + k, empty)
        found = asof(now, entry)
        for d in days:
            gone = asof(before[d], expiry)
            for m in kinds:
                for log, places, kind, sign, prefix in ((entry, found, LOOKUP, 1, ""), (expiry, gone, LOOKUP + d, -1, "x_")):
                    running = log.groupby("client", sort=False)[f"{m}_{d}"].cumsum().to_numpy(np.int64)
                    parts[kind][1][f"{name}_{m}_{d}"] = sign * taken(running, places)
                    edge[f"{prefix}{name}_{m}_{d}"] = sign * int(log.loc[log["client"] == last, f"{m}_{d}"].sum())
    # The latest click so far: a running maximum of ranks by (time, id).
    entry = of.get(ENTRY, empty)
    order = np.lexsort((entry["x2"], entry["x1"]))
    rank = np.empty(len(entry), np.int64)
    rank[order] = np.arange(len(entry))
    top = entry.assign(rank=rank).groupby("client", sort=False)["rank"].cummax().to_numpy(np.int64)
    best = taken(top, asof(now, entry), -1)
    parts[LOOKUP][1]["last_at"] = taken(entry["x1"].to_numpy()[order], best, NONE)
    parts[LOOKUP][1]["last_id"] = taken(entry["x2"].to_numpy()[order], best, NONE)
    own = rank[(entry["client"] == last).to_numpy()]
    if len(own):
        edge |= {"last_at": int(entry["x1"].to_numpy()[order[own.max()]]), "last_id": int(entry["x2"].to_numpy()[order[own.max()]])}
    upcoming = of.get(NEXT, empty)
    parts[LOOKUP][1]["next"] = taken(upcoming["at"].to_numpy(), asof(now, upcoming, direction="forward", allow_exact_matches=False), 2**63 - 1)

    here = TaskContext.get().partitionId()
    sums = [f"{log}_{m}_{d}" for log, kinds in LOGS.items() for m in kinds for d in days]
    names = ["slice", "client", "log", "t", "sale_id", "times", "last_at", "last_id", "next", *sums, *[f"x_{c}" for c in sums]]
    for kind, (frame, values) in parts.items():
        if len(frame):
            zero, count = np.zeros(len(frame), np.int64), len(frame)
            made = {"slice": np.full(count, here, np.int32), "client": frame["client"].to_numpy(), "log": np.full(count, kind, np.int32), "t": frame["x1"].to_numpy(), "times": frame[_columns(days)[0]].to_numpy(), "last_at": np.full(count, NONE), "last_id": np.full(count, NONE), "next": np.full(count, 2**63 - 1)} | values
            arrays = [ids.take(pa.array(frame["place"].to_numpy())).combine_chunks() if n == "sale_id" else pa.array(made.get(n, zero)) for n in names]
            yield from pa.table(arrays, names=names).to_batches(max_chunksize=20_000)
    start = upcoming.loc[upcoming["client"] == first, "at"]
    edges = [{"client": int(last), **edge}]
    if first != last:
        edges.append({"client": int(first)})
    edges[-1]["next"] = int(start.min()) if len(start) else 2**63 - 1
    rest = {n: 0 for n in names} | {"slice": here, "log": NEXT, "last_at": NONE, "last_id": NONE, "next": 2**63 - 1, "sale_id": None}
    kinds = {"slice": pa.int32(), "log": pa.int32()}
    yield pa.RecordBatch.from_arrays([pa.array([(rest | e)[n] for e in edges], kinds.get(n, pa.int64())) for n in names], names=names)


def _rejoined(found: DataFrame, sums: list[str], days: tuple[int, ...], label_days: int) -> DataFrame:
    """Opening balances from the edges, added to the lookups; the lookups of a sale are one row again."""
    edges = found.where(F.col("log") == NEXT)
    earlier = W.partitionBy("client").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    later = W.partitionBy("client").orderBy("slice").rowsBetween(1, W.unboundedFollowing)
    opening = edges.select(
        "slice", "client", F.max(F.struct("last_at", "last_id")).over(earlier).alias("o_last"), F.min("next").over(later).alias("o_next"),
        *[F.sum(f"{x}{c}").over(earlier).alias(f"o_{x}{c}") for x in ("", "x_") for c in sums],
    )
    rows = found.where(F.col("log") >= LOOKUP).drop(*[f"x_{c}" for c in sums]).join(opening.hint("shuffle_merge"), ["slice", "client"], "left")
    now = F.col("log") == LOOKUP

    def balance(c: str) -> Column:
        d = int(c.rpartition("_")[2])
        return F.col(c) + F.coalesce(F.when(now, F.col(f"o_{c}")).when(F.col("log") == LOOKUP + d, F.col(f"o_x_{c}")), F.lit(0))

    own = F.struct("last_at", "last_id")
    rows = rows.select("sale_id", "client", "t", "times", F.when(now, F.greatest(own, F.coalesce(F.col("o_last"), own))).otherwise(own).alias("last"), F.when(now, F.least("next", "o_next")).otherwise(F.col("next")).alias("next"), *[balance(c).alias(c) for c in sums])
    sale = rows.groupBy("sale_id", "client", "t").agg(F.max("times").alias("times"), F.max("last").alias("last"), F.min("next").alias("next"), *[F.sum(c).alias(c) for c in sums])
    last_id = lambda d: F.when((F.col("last.last_at") > F.col("t") - d * DAY) & (F.col("last.last_id") != NONE), F.col("last.last_id"))
    of = {"n_clicks": "clicks_n", "n_purchases": "clicks_p", "click_cents": "clicks_c", "last_click_id": None, "n_sales": "sales_n", "sale_cents": "sales_c", "n_lines": "lines_n", "n_items": "items_n", "line_cents": "lines_c"}
    windows = F.array(*[F.struct(F.lit(d).alias("d"), *[(F.col(f"{c}_{d}") if c else last_id(d)).alias(n) for n, c in of.items()]) for d in days])
    sale = sale.select("sale_id", F.col("t").alias("t_us"), (F.col("next") <= F.col("t") + label_days * DAY).alias("label"), F.explode(F.array_repeat(windows, F.col("times").cast("int"))).alias("w"))
    sale = sale.select("sale_id", "t_us", "label", F.explode("w").alias("w"))
    return sale.select("sale_id", "w.d", "t_us", "label", *[f"w.{n}" for n in of])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(*(common.table(spark, sf_dir, name) for name in ("clicks", "sales", "sale_lines")))


SQL = """
WITH s AS (
  SELECT sale_id, client_id, epoch_us(sold_at) AS s, greatest(epoch_us(sold_at), epoch_us(arrived_at) + 14400000000) AS known, arrived_at,
         CASE WHEN isfinite(total) THEN floor(100 * total + 0.5)::BIGINT ELSE 0 END AS cents,
         epoch_us(sold_at) + 1000000 * (xor(4294967295, list_reduce(list_transform(range(1, length(coalesce(sale_id::VARCHAR, '')) + 1), lambda i: ascii((sale_id::VARCHAR)[i])::BIGINT),
           lambda crc, b: list_reduce(range(8)::BIGINT[], lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, xor(crc, b)), 4294967295::BIGINT)) % 259200) AS t,
         row_number() OVER () AS rn
  FROM sales WHERE client_id IS NOT NULL AND sold_at IS NOT NULL
),
w AS (SELECT s.rn, s.sale_id, s.client_id, s.t, d FROM s, (VALUES (2), (14)) AS x(d)),
c AS (
  SELECT w.rn, w.d, count(*) AS n_clicks, count(*) FILTER (kind = 'purchase') AS n_purchases,
         sum(CASE WHEN isfinite(value) THEN floor(100 * value + 0.5)::BIGINT ELSE 0 END)::BIGINT AS click_cents,
         max_by(click_id, (ts, click_id)) AS last_click_id
  FROM w JOIN (SELECT DISTINCT * FROM clicks) c ON c.client_id = w.client_id AND epoch_us(c.ts) > w.t - w.d * 86400000000 AND epoch_us(c.ts) <= w.t
    AND epoch_us(c.arrived_at) + 14400000000 <= w.t
  GROUP BY ALL
),
seen AS (
  SELECT w.rn, w.d, w.t, s.sale_id, s.cents FROM w JOIN s ON s.client_id = w.client_id AND s.s > w.t - w.d * 86400000000 AND s.s <= w.t
    AND epoch_us(s.arrived_at) + 14400000000 <= w.t
),
b AS (SELECT rn, d, count(*) AS n_sales, sum(cents)::BIGINT AS sale_cents FROM seen GROUP BY ALL),
l AS (
  SELECT rn, d, count(*) AS n_lines, count(DISTINCT item_id) AS n_items, sum(CASE WHEN isfinite(amount) THEN floor(100 * amount + 0.5)::BIGINT ELSE 0 END)::BIGINT AS line_cents
  FROM seen JOIN sale_lines l ON l.sale_id = seen.sale_id AND epoch_us(l.shipped_at) <= seen.t GROUP BY ALL
),
n AS (SELECT a.rn, bool_or(b.s > a.t AND b.s <= a.t + 604800000000) AS label FROM s a JOIN s b USING (client_id) GROUP BY ALL)
SELECT w.sale_id, w.d::INT AS d, w.t AS t_us, n.label, coalesce(n_clicks, 0) AS n_clicks, coalesce(n_purchases, 0) AS n_purchases, coalesce(click_cents, 0) AS click_cents,
       last_click_id, coalesce(n_sales, 0) AS n_sales, coalesce(sale_cents, 0) AS sale_cents, coalesce(n_lines, 0) AS n_lines, coalesce(n_items, 0) AS n_items, coalesce(line_cents, 0) AS line_cents
FROM w JOIN n USING (rn) LEFT JOIN c USING (rn, d) LEFT JOIN b USING (rn, d) LEFT JOIN l USING (rn, d)
"""
