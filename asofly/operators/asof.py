"""As-of joins: what was known at a bar's time, and never later.

Both sides are stacked and sorted per key and block of time; the last auxiliary row at or before each bar is carried along by
a running window, and into a block from the last row of the blocks before it. No range join, and no task holds a key's whole
history.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(bars: DataFrame, aux: DataFrame, *, on: str = "available_time", by: list[str] | None = None, columns: list[str] | None = None, prefix: str = "aux_", tie: str | None = None, block_days: int = 30) -> DataFrame:
    """Bars with the latest auxiliary row at or before their time; equal times match.

    block_days: how much of a key's history one task sorts. by: columns that must be equal. columns: auxiliary ones to take (default: all others). The matched row's time comes as
    `<prefix><on>`. Among auxiliary rows of one time, the one with the highest tie column wins. Bars without a match keep
    nulls; the number of bars doesn't change.
    """
    by = by or []
    columns = columns or [c for c in aux.columns if c not in (on, *by)]
    right = aux.select(*by, F.col(on).alias("_t"), F.lit(0).alias("_side"), F.struct(F.col(on).alias("_on"), *columns).alias("_aux"), (F.col(tie) if tie else F.lit(0)).cast("string").alias("_tie"))
    left = bars.select(*by, F.col(on).alias("_t"), F.lit(1).alias("_side"), F.lit("").alias("_tie"), F.struct(*bars.columns).alias("_bar"))
    block = F.floor(F.unix_timestamp(F.col("_t").cast("timestamp")) / (block_days * 86400)).alias("_k")
    both = left.unionByName(right, allowMissingColumns=True).select("*", block)
    w = Window.partitionBy(*by, "_k").orderBy("_t", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    within = both.withColumn("_in", F.last("_aux", ignorenulls=True).over(w)).filter("_side = 1")
    ends = both.groupBy(*by, "_k").agg(F.max_by("_aux", F.when(F.col("_side") == 0, F.struct("_t", "_tie"))).alias("_end"))  # a row for each block
    before = F.last("_end", ignorenulls=True).over(Window.partitionBy(*by).orderBy("_k").rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.select(*(F.col(c).alias(f"_by_{c}") for c in by), F.col("_k").alias("_by_k"), before.alias("_carry")).filter("_carry is not null")
    same = F.col("_k") == F.col("_by_k")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    carried = within.join(ends, same, "left").withColumn("_got", F.coalesce("_in", "_carry"))
    taken = [F.col(f"_got.{c}").alias(c) for c in columns]
    return carried.select("_bar.*", F.col("_got._on").alias(f"{prefix}{on}"), *taken)


def asof_funding(bars: DataFrame, funding: DataFrame, *, default_hours: int = 8) -> DataFrame:
    """Funding as of each bar, null with a reason if older than its own interval or if its asset has none at all."""
    j = asof_join(bars, funding, by=["asset"], columns=["funding_rate", "funding_interval_hours"], prefix="funding_")
    age = F.expr("timestampdiff(SECOND, funding_available_time, available_time)")
    fresh = age <= F.coalesce("funding_interval_hours", F.lit(default_hours)) * 3600
    known = funding.select("asset").distinct().withColumn("_known", F.lit(True))
    j = j.join(known, "asset", "left")
    reason = F.when(F.col("_known").isNull(), "FUNDING_ASSET_MISSING").when(~F.coalesce(fresh, F.lit(False)), "FUNDING_UNAVAILABLE_OR_GAPPED")
    return j.withColumn("funding_rate", F.when(fresh, F.col("funding_rate"))).withColumn("funding_reason", reason).drop("_known")


def delayed(oi: DataFrame, minutes: int) -> DataFrame:
    """Open interest available `minutes` after its event in all: what its label already counts is topped up."""
    had = F.coalesce(F.regexp_extract("availability_assumption", r"DELAY_(\d+)M", 1).try_cast("int"), F.lit(0))
    return oi.withColumn("available_time", F.col("available_time") + F.make_dt_interval(mins=F.greatest(F.lit(minutes) - had, F.lit(0))))


def asof_open_interest(bars: DataFrame, oi: DataFrame, *, minutes: int = 5, bar_hours: int = 1) -> DataFrame:
    """Open interest as of each bar after a publication delay; null with a reason beyond one bar's age."""
    j = asof_join(bars, delayed(oi, minutes), by=["asset"], columns=["open_interest"], prefix="oi_")
    fresh = F.expr("timestampdiff(SECOND, oi_available_time, available_time)") <= bar_hours * 3600
    known = oi.select("asset").distinct().withColumn("_known", F.lit(True))
    j = j.join(known, "asset", "left")
    reason = F.when(F.col("_known").isNull(), "OI_ASSET_MISSING").when(~F.coalesce(fresh, F.lit(False)), "OI_UNAVAILABLE_OR_GAPPED")
    return j.withColumn("open_interest", F.when(fresh, F.col("open_interest"))).withColumn("oi_reason", reason).drop("_known")


def snapshot(bars: DataFrame, funding: DataFrame | None = None, oi: DataFrame | None = None) -> DataFrame:
    """Bars with funding and open interest as of their availability, per asset; an absent input leaves null columns."""
    out = bars
    if funding is not None:
        out = asof_join(out, funding, by=["asset"], columns=["funding_rate"], prefix="funding_")
    else:
        out = out.withColumn("funding_available_time", F.lit(None).cast("timestamp_ntz")).withColumn("funding_rate", F.lit(None).cast("double"))
    if oi is not None:
        return asof_join(out, oi, by=["asset"], columns=["open_interest"], prefix="oi_")
    return out.withColumn("oi_available_time", F.lit(None).cast("timestamp_ntz")).withColumn("open_interest", F.lit(None).cast("double"))


def delay_views(oi: DataFrame, delays: tuple[int, ...], as_of: str | None = None) -> DataFrame:
    """The series once per publication delay, relabelled, what isn't available by as_of left out."""
    views = []
    for d in delays:
        v = oi.withColumn("available_time", F.expr(f"event_time + interval {d} minutes")).withColumn("availability_assumption", F.lit(f"BINANCE_METRICS_DELAY_{d}M")).withColumn("delay", F.lit(d))
        views.append(v.filter(F.col("available_time") <= F.lit(as_of).cast("timestamp_ntz")) if as_of else v)
    return reduce(DataFrame.unionByName, views)


def asof_by_delay(bars: DataFrame, views: DataFrame, delays: tuple[int, ...]) -> DataFrame:
    """Bars against every delay view at once: the delay is one more key of the same as-of join.

    An asset of the bars that has no view at all is an error.
    """
    missing = bars.select("asset").distinct().join(views.select("asset").distinct(), "asset", "left_anti").first()
    if missing is not None:
        raise ValueError(f"DELAY_VIEW_MISSING: {missing[0]}")
    wide = bars.withColumn("delay", F.explode(F.array(*(F.lit(d) for d in delays))))
    return asof_join(wide, views, by=["delay", "asset"], columns=["open_interest"], prefix="oi_")


def latest_through(records: DataFrame, t: str, *, on: str = "available_time", key: list[str] | None = None) -> DataFrame:
    """The latest record at or before t, per key."""
    rows = records.filter(F.col(on) <= F.lit(t).cast("timestamp_ntz"))
    keep = [c for c in records.columns if c not in (key or [])]
    best = rows.groupBy(*(key or [])).agg(F.max_by(F.struct(*keep), F.struct(on, *[c for c in keep if c != on])).alias("r"))
    return best.filter("r is not null").select(*(key or []), "r.*")


def members_only(bars: DataFrame, members: DataFrame) -> DataFrame:
    """Bars of assets that are members on their day, and only once the selection was made. A doubled membership is an error."""
    twice = members.groupBy("asset", F.date_trunc("day", F.col("selection_time")).alias("_d")).count().filter("count > 1").select("asset").first()
    if twice is not None:
        raise ValueError(f"DUPLICATE_MEMBERSHIP: {twice[0]}")
    m = members.select(F.col("asset").alias("_a"), F.col("selection_time").alias("_s"))
    day = F.date_trunc("day", F.col("available_time")).cast("timestamp_ntz")
    return bars.join(m, (bars["asset"] == m["_a"]) & (day == F.date_trunc("day", m["_s"]).cast("timestamp_ntz")) & (m["_s"] <= bars["available_time"]), "left_semi")
