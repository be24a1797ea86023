"""Venue calendars, missing sessions, total returns, as-of joins of reports, folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retroscope.functions.windows import by_time


def venue_calendar(bars: DataFrame, groups: DataFrame) -> DataFrame:
    """market, session, venue_ordinal, week (its Monday), week_number within the year."""
    days = bars.join(groups, "security").select("market", "session").distinct()
    week = F.to_date(F.date_trunc("week", "session"))
    own = Window.partitionBy("market").orderBy("session")
    return days.select("market", "session", (F.row_number().over(own) - 1).cast("bigint").alias("venue_ordinal"), week.alias("week"), F.dense_rank().over(Window.partitionBy("market", F.year("session")).orderBy(week)).cast("bigint").alias("week_number"))


def missing_sessions(bars: DataFrame, groups: DataFrame, window: int = 21) -> DataFrame:
    """Bars on their market's calendar: sessions missed since the last bar, and whether a look-back window has none.

    A window of rows is whole if it spans as many venue sessions as it has rows.
    """
    calendar = venue_calendar(bars, groups).select("market", "session", "venue_ordinal")
    rows = bars.join(groups, "security").join(calendar, ["market", "session"])
    gap = F.col("venue_ordinal") - F.lag("venue_ordinal", 1).over(by_time()) - 1
    span = F.col("venue_ordinal") - F.lag("venue_ordinal", window - 1).over(by_time())
    return rows.select("security", "session", "venue_ordinal", F.coalesce(gap, F.lit(0)).alias("missed"), F.coalesce(span == window - 1, F.lit(False)).alias("window_whole"))


def total_return(bars: DataFrame, actions: DataFrame) -> DataFrame:
    """Causal total-return closes from base 100: growth is (split * close + dividend) over the close before."""
    rows = bars.join(actions, ["security", "session"], "left").withColumns({"split": F.coalesce("split", F.lit(1.0)), "dividend": F.coalesce("dividend", F.lit(0.0))})
    growth = (F.col("split") * F.col("close") + F.col("dividend")) / F.lag("close", 1).over(by_time())
    rows = rows.withColumn("growth", F.coalesce(growth, F.lit(1.0)))
    return rows.withColumns({"tr_close": 100 * F.exp(F.sum(F.ln("growth")).over(by_time())), "cum_split": F.exp(F.sum(F.ln("split")).over(by_time()))})


def asof(left: DataFrame, right: DataFrame, key: str, at: str, known: str, values: list[str], forward: bool = False) -> DataFrame:
    """left with the values of right's last row at or before `at` (forward: its first row after `at`).

    One shuffle by key: both sides in one order, then the last value seen. Right rows of one key and time
    must be unique.
    """
    last = F.last if not forward else F.first
    a = left.withColumns({"_t": F.col(at), "_side": F.lit(1), "_v": F.lit(None).cast(right.select(F.struct(known, *values)).schema[0].dataType)})
    b = right.select(F.col(key), F.col(known).alias("_t"), F.lit(0).alias("_side"), F.struct(known, *values).alias("_v"))
    frame = Window.partitionBy(key).orderBy("_t", "_side")
    frame = frame.rowsBetween(1, Window.unboundedFollowing) if forward else frame.rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True).withColumn("_v", last("_v", ignorenulls=True).over(frame))
    return both.where("_side = 1").select(*left.columns, *(F.col(f"_v.{c}").alias(c) for c in (known, *values)))


def report_features(reports: DataFrame) -> DataFrame:
    """Rolling means of 2 reports, growth against 4 reports before (over its size), and acceleration."""
    own = Window.partitionBy("security").orderBy("report_date")
    two = own.rowsBetween(-1, 0)

    def growth(x: Column) -> Column:
        before = F.lag(x, 4).over(own)
        return F.try_divide(x - before, F.nullif(F.abs(before), F.lit(0.0)))

    rows = reports.withColumn("revenue_mean_2", F.when(F.count("revenue").over(two) >= 2, F.avg("revenue").over(two)))
    rows = rows.withColumns({"revenue_growth": growth(F.col("revenue")), "revenue_mean_growth": growth(F.col("revenue_mean_2"))})
    return rows.withColumn("revenue_acceleration", F.col("revenue_mean_growth") - F.lag("revenue_mean_growth", 1).over(own))


def folds(rows: DataFrame) -> DataFrame:
    """Roles of origins in the fold of each year there is, by the maturity of their outcomes.

    rows: security, session, available. For fold year y: train is known before y - 1, validation lies in
    y - 1 and is known before y, evaluation lies in y, the bank holds all that is known before y.
    """
    years = rows.select(F.year("session").alias("fold")).distinct()  # a handful
    start = lambda back: F.make_date(F.col("fold") - back, F.lit(1), F.lit(1))
    s, a = F.col("session"), F.col("available")
    roles = {"train": a < start(1), "validation": (s >= start(1)) & (s < start(0)) & (a < start(0)), "evaluation": (F.year(s) == F.col("fold")), "bank": a < start(0)}
    listed = F.array_compact(F.array(*(F.when(test, F.lit(role)) for role, test in roles.items())))
    return rows.join(F.broadcast(years)).select("fold", "security", "session", F.explode(listed).alias("role"))


def exchange_days(begin: Column, end: Column, holidays: tuple[str, ...] = ("01-01", "12-25")) -> Column:
    """Array of the weekdays from begin to end that are no holidays (month and day)."""
    return F.filter(F.sequence(begin, end), lambda d: (F.dayofweek(d).between(2, 6)) & ~F.date_format(d, "MM-dd").isin(*holidays))


def schedule(bars: DataFrame) -> DataFrame:
    """security, session, status for each day from a security's first bar to its last: CLOSED on days without trade,
    VALID where an open day has a bar, MISSING where it has none. Bars of closed days are left out."""
    spans = bars.groupBy("security").agg(F.min("session").alias("_a"), F.max("session").alias("_b"))
    days = spans.withColumn("_open", exchange_days(F.col("_a"), F.col("_b"))).select("security", F.explode(F.sequence("_a", "_b")).alias("session"), "_open")
    days = days.select("security", "session", F.array_contains("_open", F.col("session")).alias("_is_open"))
    seen = bars.select("security", "session", F.lit(True).alias("_bar"))
    status = F.when(~F.col("_is_open"), "CLOSED").when(F.col("_bar"), "VALID").otherwise("MISSING")
    return days.join(seen, ["security", "session"], "left").select("security", "session", status.alias("status"))


def calendar_digest(calendar: DataFrame) -> DataFrame:
    """market, sessions, digest: SHA-256 of the sorted sessions of a market."""
    days = F.array_join(F.array_sort(F.collect_set(F.date_format("session", "yyyy-MM-dd"))), "|")
    return calendar.groupBy("market").agg(F.countDistinct("session").alias("sessions"), F.sha2(days, 256).alias("digest"))


def report_scores(reports: DataFrame) -> DataFrame:
    """Rolling means of 2 and 8 reports of eps and revenue, latest against the mean of 8, growth against 4 before, and
    the share of the known of three flags (growth over 0.25, acceleration, latest above the mean) that hold."""
    own = Window.partitionBy("security").orderBy("report_date")
    rows = reports
    for x in ("eps", "revenue"):
        for k in (2, 8):
            frame = own.rowsBetween(1 - k, 0)
            rows = rows.withColumn(f"{x}_mean_{k}", F.when(F.count(x).over(frame) >= 2, F.avg(x).over(frame)))
        before = F.lag(x, 4).over(own)
        rows = rows.withColumns({f"{x}_growth": F.try_divide(F.col(x) - before, F.nullif(F.abs(before), F.lit(0.0))), f"{x}_vs_mean": F.try_divide(F.col(x), F.nullif(F.col(f"{x}_mean_8"), F.lit(0.0))) - 1})
        mean_before = F.lag(f"{x}_mean_2", 4).over(own)
        rows = rows.withColumn("_g", F.try_divide(F.col(f"{x}_mean_2") - mean_before, F.nullif(F.abs(mean_before), F.lit(0.0))))
        rows = rows.withColumn(f"{x}_acceleration", F.col("_g") - F.lag("_g", 1).over(own)).drop("_g")
    flags = [F.col("eps_growth") > 0.25, F.col("eps_acceleration") > 0, F.col("revenue_vs_mean") > 0]
    held = sum((F.coalesce(f.cast("int"), F.lit(0)) for f in flags[1:]), F.coalesce(flags[0].cast("int"), F.lit(0)))
    known = sum((f.isNotNull().cast("int") for f in flags[1:]), flags[0].isNotNull().cast("int"))
    return rows.withColumn("score", F.try_divide(held.cast("double"), known.cast("double")))


def report_coverage(reports: DataFrame, first: int, last: int, as_of: str, sparse: int = 2, stale: int = 120) -> DataFrame:
    """Per security: years without a report and with fewer than `sparse`, days since the last one, and why it fails."""
    by_year = reports.groupBy("security", F.year("report_date").alias("year")).agg(F.count("*").alias("n"), F.max("report_date").alias("d"))
    got = by_year.groupBy("security").agg(F.collect_set("year").alias("_years"), F.array_sort(F.collect_list(F.when(F.col("n") < sparse, F.col("year")))).alias("sparse_years"), F.max("d").alias("last_report"), F.sum("n").alias("reports"))
    missing = F.array_sort(F.array_except(F.sequence(F.lit(first), F.lit(last)), F.col("_years")))
    age = F.datediff(F.lit(as_of).cast("date"), "last_report")
    out = got.withColumns({"missing_years": missing, "days_stale": age})
    reasons = F.array_compact(F.array(F.when(F.size("missing_years") > 0, F.lit("missing_years")), F.when(F.size("sparse_years") > 0, F.lit("sparse_years")), F.when(F.col("days_stale") > stale, F.lit("stale"))))
    return out.withColumn("reasons", reasons).drop("_years")


def total_return_bars(bars: DataFrame, actions: DataFrame, missing_limit: int = 30) -> DataFrame:
    """Causal total-return open, high, low and close from base 100, and volume in first shares, per uninterrupted
    segment: a gap of more than missing_limit days begins a new one. Prices move with the growth from the close before."""
    rows = bars.join(actions, ["security", "session"], "left").withColumns({"split": F.coalesce("split", F.lit(1.0)), "dividend": F.coalesce("dividend", F.lit(0.0))})
    gap = F.coalesce(F.datediff("session", F.lag("session", 1).over(by_time())) > missing_limit, F.lit(False)).cast("int")
    rows = rows.withColumn("_gap", gap).withColumn("segment", F.sum("_gap").over(by_time())).drop("_gap")
    own = Window.partitionBy("security", "segment").orderBy("session")
    before = F.lag("close", 1).over(own)
    grown = lambda c: (F.col("split") * F.col(c) + F.col("dividend")) / before
    rows = rows.withColumn("_growth", F.coalesce(grown("close"), F.lit(1.0)))
    rows = rows.withColumns({"tr_close": 100 * F.exp(F.sum(F.ln("_growth")).over(own)), "cum_split": F.exp(F.sum(F.ln("split")).over(own)), "_first": before.isNull()})
    for c in ("open", "high", "low"):
        rows = rows.withColumn(f"tr_{c}", F.when(F.col("_first"), 100 * F.col(c) / F.col("close")).otherwise(F.lag("tr_close", 1).over(own) * grown(c)))
    return rows.withColumn("tr_volume", F.col("volume") / F.col("cum_split")).drop("_growth", "_first")


def utc_visible(left: DataFrame, right: DataFrame) -> DataFrame:
    """Per pair of markets: sessions, and on how many the other market's close of that day was known at one's own close.

    left and right: market, session, close_utc.
    """
    other = right.select(F.col("market").alias("other"), "session", F.col("close_utc").alias("_other"))
    both = left.join(other, "session").where("market <> other")
    return both.groupBy("market", "other").agg(F.count("*").alias("sessions"), F.sum((F.col("_other") <= F.col("close_utc")).cast("bigint")).alias("visible"))


def fold_manifest(rows: DataFrame) -> DataFrame:
    """Rows per role of the fold of each year in rows (session, available, matures: when 63 and 126 rows on are known).

    For year y: train lies and is known before y - 2, validation in y - 2, development in y - 1 (each known by its end),
    evaluation in y whatever becomes of it, bank lies and is mature before y - 2.
    """
    years = rows.select(F.year("session").alias("fold")).distinct()  # a handful
    at = lambda k: F.make_date(F.col("fold") + k, F.lit(1), F.lit(1))
    s, a, m = F.col("session"), F.col("available"), F.col("matures")
    inside = lambda k: (s >= at(k)) & (s < at(k + 1)) & (a < at(k + 1))
    roles = {"train": (s < at(-2)) & (a < at(-2)), "validation": inside(-2), "development": inside(-1), "evaluation": F.year(s) == F.col("fold"), "bank": (s < at(-2)) & (m < at(-2))}
    return rows.crossJoin(F.broadcast(years)).groupBy("fold").agg(*(F.count(F.when(test, 1)).alias(role) for role, test in roles.items()))


def walk_forward(rows: DataFrame, train: int, validation: int, test: int, step: int) -> DataFrame:
    """train_from, train_to, validation_to, test_to: years of rolling splits within the years there are."""
    span = rows.agg(F.min(F.year("session")).alias("a"), F.max(F.year("session")).alias("b"))
    starts = span.where("a is not null").select(F.explode(F.sequence("a", "b", F.lit(step))).alias("train_from"), "b")
    ends = starts.select("train_from", (F.col("train_from") + train - 1).alias("train_to"), (F.col("train_from") + train + validation - 1).alias("validation_to"), (F.col("train_from") + train + validation + test - 1).alias("test_to"), "b")
    return ends.where(F.col("test_to") <= F.col("b")).drop("b")


def admitted(rows: DataFrame, whole_input: Column, known_target: Column, evaluated: Column) -> DataFrame:
    """rows with reason: short_history without a whole input window, no_target where the target is not known; rows that are
    evaluated need no target. Null: admitted."""
    reason = F.when(~whole_input, "short_history").when(~known_target & ~evaluated, "no_target")
    return rows.withColumn("reason", reason)
