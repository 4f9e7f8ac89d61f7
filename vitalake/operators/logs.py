"""Log and availability measures. One function serves a table and a stream.

A trailing range ends at its stamp and includes it: the range of `span` at time e is (e - span, e].
Spark's windows include their start instead, so times are moved back by one microsecond, the
resolution of a timestamp, before they are put into a window.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitalake import schemas
from vitalake.functions.values import line_holds, matches

# The monitoring services themselves, left out of every overview panel, the age limit
# of arriving samples, the trailing range of the rate panels, and the time between two samples.
MONITORING = "loki|promtail|grafana|prometheus"
MAX_AGE = timedelta(hours=168)
RATE_RANGE = timedelta(minutes=5)
SAMPLE_STEP = timedelta(seconds=15)
TAIL_LINES = 200

Labels = Mapping[str, tuple[str | None, str | None]]
Pattern = str | Sequence[str]


def _seconds(span: timedelta) -> str:
    return f"{span // timedelta(microseconds=1)} microseconds"


def select_streams(df: DataFrame, labels: Labels | None = None, pattern: Pattern | None = None,
                   line: str = "line") -> DataFrame:
    """Rows whose labels match {label: (include, exclude)} and whose line holds the pattern (or words)."""
    for label, (include, exclude) in (labels or {}).items():
        df = df.filter(matches(label, include, exclude))
    return df.filter(line_holds(line, pattern)) if pattern else df


def parse_logs(
    df: DataFrame, keep: Sequence[str], arrived: str = "arrived", also: Sequence[str] = ()
) -> DataFrame:
    """Container records to log lines: (ts, line, stream and the four labels).

    `df` holds the raw record text as `value`, the container's meta labels, and the arrival time.
    Only listed services are kept. A record that is not the driver's JSON stays as it is and takes
    its arrival time. Columns named in `also` are passed on.
    """
    return parsed(df.filter(F.col("meta_service").isin(*keep)), arrived, also)


def parsed(df: DataFrame, arrived: str = "arrived", also: Sequence[str] = ()) -> DataFrame:
    """All container records as log lines (see `parse_logs`)."""
    return df.withColumn("_record", F.from_json("value", schemas.LOG_RECORD)).select(
        F.coalesce(F.col("_record.time").try_cast("timestamp"), F.col(arrived)).alias("ts"),
        F.coalesce("_record.log", "value").alias("line"),
        F.col("_record.stream").alias("stream"),
        F.col("meta_project").alias("compose_project"),
        F.col("meta_service").alias("compose_service"),
        F.regexp_replace("meta_name", r"^/", "").alias("container"),
        F.col("meta_id").alias("container_id"),
        *also,
    )


def reject_old(
    df: DataFrame, ts: str = "ts", as_of: Column | datetime | None = None, max_age: timedelta = MAX_AGE
) -> DataFrame:
    """Drop samples older than `max_age` at their arrival; default arrival is the batch's time."""
    if isinstance(as_of, datetime):
        arrived = _at(df, ts, as_of)
    else:
        arrived = F.current_timestamp() if as_of is None else as_of
    return df.filter(F.col(ts) >= arrived - F.expr(f"INTERVAL {max_age.total_seconds()} SECOND"))


#: Why a record is not stored: its service is not kept, or its line was too old when it arrived.
REFUSED_SERVICE, REFUSED_AGE = "service", "age"


def judge_records(df: DataFrame, keep: Sequence[str], max_age: timedelta = MAX_AGE, arrived: str = "arrived") -> DataFrame:
    """All container records as log lines with `arrived`, and `refused`: why a line is not stored, NULL if it is.

    A record without a service is refused as one of a service that is not kept.
    """
    lines = parsed(df, arrived, also=[F.col(arrived).alias("arrived")])
    old = F.col("ts") < F.col("arrived") - F.expr(f"INTERVAL {max_age.total_seconds()} SECOND")
    kept = F.coalesce(F.col("compose_service").isin(*keep), F.lit(False))
    return lines.withColumn("refused", F.when(~kept, REFUSED_SERVICE).when(old, REFUSED_AGE))


def _at(df: DataFrame, ts: str, when: datetime) -> Column:
    """A moment as a literal of the type of the time column, so that the column itself is not cast."""
    return F.lit(when).cast(dict(df.dtypes)[ts])


def in_range(df: DataFrame, ts: str, as_of: datetime, span: timedelta) -> Column:
    """as_of - span < ts <= as_of (UTC), with literal bounds that reach the parquet scan and its folders of days."""
    inside = (F.col(ts) > _at(df, ts, as_of - span)) & (F.col(ts) <= _at(df, ts, as_of))
    if "day" in df.columns:  # a stored log table: other days are not listed or read
        inside &= F.col("day").between(F.lit((as_of - span).date()), F.lit(as_of.date()))
    return inside


def count_over_time(
    df: DataFrame,
    as_of: datetime,
    span: timedelta,
    pattern: Pattern | None = None,
    labels: Labels | None = None,
    by: Sequence[str] = (),
    ts: str = "ts",
    line: str = "line",
) -> DataFrame:
    """Number of matching lines in the range before `as_of`: in total (0 if none), or per label."""
    rows = select_streams(df.filter(in_range(df, ts, as_of, span)), labels, pattern, line)
    return rows.groupBy(*by).agg(F.count("*").alias("n"))


def count_series(
    df: DataFrame,
    by: Sequence[str],
    span: timedelta = RATE_RANGE,
    step: timedelta = timedelta(minutes=1),
    pattern: Pattern | None = None,
    labels: Labels | None = None,
    ts: str = "ts",
    line: str = "line",
) -> DataFrame:
    """Matching lines per label in the trailing range at every step: (by.., window_end, n).

    A table is first counted into buckets of one step, and only the buckets are spread over the
    ranges that contain them, so the rows are scanned and combined once however many ranges overlap.
    A stream has to aggregate in one go; its rows are spread by the sliding window.
    """
    rows = select_streams(df, labels, pattern, line)
    if df.isStreaming or span % step:
        # The watermarked column must go into the window as it is; `watermark` has moved it back.
        at = F.col("_at") if "_at" in df.columns else before(ts)
        return (
            # Windows start on multiples of the step; the offset makes them end there instead.
            rows.groupBy(*by, F.window(at, _seconds(span), _seconds(step), _seconds(-span % step)).alias("w"))
            .agg(F.count("*").alias("n"))
            .select(*by, F.col("w.end").alias("window_end"), "n")
        )
    buckets = rows.groupBy(*by, step_end(ts, step).alias("_end")).agg(F.count("*").alias("n"))
    return spread_counts(buckets, by, span, step, dict(df.dtypes)[ts])


def step_end(ts: str, step: timedelta) -> Column:
    """End of the step that holds a time, in whole microseconds: the first range end at or after t is t + pmod(-t, step)."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    return micros + F.pmod(-micros, F.lit(step // timedelta(microseconds=1)))


def spread_counts(buckets: DataFrame, by: Sequence[str], span: timedelta, step: timedelta, kind: str) -> DataFrame:
    """Counts of steps (by.., _end, n) added up over the trailing ranges that hold them: (by.., window_end, n)."""
    every = step // timedelta(microseconds=1)
    ends = F.sequence(F.col("_end"), F.col("_end") + (span // step - 1) * every, F.lit(every))
    spread = buckets.select(*by, F.explode(ends).alias("_end"), "n")
    return (
        spread.groupBy(*by, "_end")
        .agg(F.sum("n").alias("n"))
        .select(*by, F.timestamp_micros("_end").cast(kind).alias("window_end"), "n")
    )


def count_long_series(
    df: DataFrame,
    by: Sequence[str],
    span: timedelta,
    step: timedelta,
    pattern: Pattern | None = None,
    labels: Labels | None = None,
    ts: str = "ts",
    line: str = "line",
) -> DataFrame:
    """`count_series` of a table for ranges of very many steps, which overlap so much that spreading costs most.

    A step adds its count when it enters the range and takes it away when it leaves; the running sum of a label holds
    until the next change. So the work follows the steps and the result, not their product with the overlap. A
    label's changes lie in one task: two a step at most, whatever the number of its lines.
    """
    if span % step:
        raise ValueError("the range must be a whole number of steps")
    every, length = step // timedelta(microseconds=1), span // timedelta(microseconds=1)
    rows = select_streams(df, labels, pattern, line)
    buckets = rows.groupBy(*by, step_end(ts, step).alias("_end")).agg(F.count("*").alias("n"))
    enters, leaves = F.struct(F.col("_end").alias("at"), F.col("n")), F.struct((F.col("_end") + length).alias("at"), (-F.col("n")).alias("n"))
    changes = buckets.select(*by, F.explode(F.array(enters, leaves)).alias("_c"))
    changes = changes.groupBy(*by, F.col("_c.at").alias("_at")).agg(F.sum("_c.n").alias("_d"))
    in_order = Window.partitionBy(*by).orderBy("_at")
    running, following = F.sum("_d").over(in_order), F.lead("_at").over(in_order)
    held = changes.select(*by, "_at", running.alias("n"), following.alias("_next")).filter("n > 0")
    ends = held.select(*by, F.explode(F.sequence(F.col("_at"), F.col("_next") - every, F.lit(every))).alias("_end"), "n")
    return ends.select(*by, F.timestamp_micros("_end").cast(dict(df.dtypes)[ts]).alias("window_end"), "n")


def before(ts: str) -> Column:
    return F.col(ts) - F.expr("INTERVAL 0.000001 SECOND")


def watermark(df: DataFrame, delay: timedelta = MAX_AGE, ts: str = "ts") -> DataFrame:
    """Bound the state of a streaming `count_series`; `_at` is the time its windows use.

    This follows event time, so it is another test than `reject_old`, which follows the clock.
    """
    return df.withColumn("_at", before(ts)).withWatermark("_at", _seconds(delay))


def rate(df: DataFrame, by: Sequence[str], span: timedelta = RATE_RANGE,
         step: timedelta = timedelta(minutes=1), **options) -> DataFrame:
    """Lines per second per label in the trailing range at every step: (by.., window_end, rate)."""
    series = count_series(df, by, span, step, **options)
    return series.select(*by, "window_end", (F.col("n") / span.total_seconds()).alias("rate"))


def search(
    df: DataFrame,
    labels: Labels | None = None,
    pattern: Pattern | None = None,
    limit: int | None = None,
    ts: str = "ts",
    tie: Sequence[str] = (),
    line: str = "line",
) -> DataFrame:
    """Matching lines, newest first; `limit` keeps the last lines only, as a tail does."""
    rows = select_streams(df, labels, pattern, line).orderBy(F.col(ts).desc(), *tie)
    return rows if limit is None else rows.limit(limit)


def label_values(
    df: DataFrame,
    label: str,
    include: str | None = ".+",
    exclude: str | None = None,
    labels: Labels | None = None,
    ts: str = "ts",
    delay: timedelta = MAX_AGE,
) -> DataFrame:
    """Distinct values of a label, in alphabetical order; `labels` chains an earlier choice.

    On a stream a value comes once, and again if it was not seen for `delay`: older ones leave the state.
    """
    rows = select_streams(df, labels).filter(matches(label, include, exclude))
    if not df.isStreaming:
        return rows.select(label).distinct().orderBy(label)
    return rows.select(label, ts).withWatermark(ts, _seconds(delay)).dropDuplicatesWithinWatermark([label]).select(label)


def series_stats(
    series: DataFrame,
    by: Sequence[str],
    value: str,
    functions: Sequence[str] = ("max", "mean", "sum", "last"),
    at: str = "window_end",
) -> DataFrame:
    """Legend figures of every series: any of max, mean, sum, last."""
    aggs = {
        "max": F.max(value),
        "mean": F.avg(value),
        "sum": F.sum(value),
        "last": F.max_by(value, at),
    }
    return series.groupBy(*by).agg(*[aggs[f].alias(f"{f}_{value}") for f in functions])


# The texts of a status panel.
STATUS_TEXT = {0.0: "DOWN", 1.0: "UP"}


def last_value(samples: DataFrame, by: str = "job", value: str = "value", order: Sequence[str] = ("ts",)) -> DataFrame:
    """Newest non-NULL value per job. `order` breaks ties among equal times when it names more."""
    key = F.struct(*order) if len(order) > 1 else F.col(order[0])
    rows = samples.filter(F.col(value).isNotNull())
    return rows.groupBy(by).agg(F.max_by(value, key).alias("last"))


def service_status(samples: DataFrame, by: str = "job", value: str = "value", order: Sequence[str] = ("ts",)) -> DataFrame:
    """Newest non-NULL value per job and its text, UP or DOWN; other values show as they are."""
    last = last_value(samples, by, value, order)
    text = reduce(
        lambda acc, kv: F.when(F.col("last") == kv[0], F.lit(kv[1])).otherwise(acc),
        STATUS_TEXT.items(),
        F.col("last").cast("string"),
    )
    return last.withColumn("status", text)


def availability(
    samples: DataFrame,
    jobs: str = ".+",
    step: timedelta = SAMPLE_STEP,
    by: str = "job",
    value: str = "value",
    order: Sequence[str] = ("ts",),
) -> DataFrame:
    """Last value and share of up samples per job and step, for the jobs that match."""
    key = F.struct(*order) if len(order) > 1 else F.col(order[0])
    ts = order[0]
    at = F.col("_at") if "_at" in samples.columns else before(ts)
    return (
        samples.filter(matches(by, jobs) & F.col(value).isNotNull())
        .groupBy(by, F.window(at, _seconds(step)).alias("w"))
        .agg(F.max_by(value, key).alias("last"), F.avg(value).alias("up_ratio"))
        .select(by, F.col("w.end").alias("window_end"), "last", "up_ratio")
    )


#: Steps of a slice of time; one job's samples are as many groups as it has slices.
SLICE_STEPS = 1024


def availability_filled(
    samples: DataFrame,
    as_of: datetime,
    span: timedelta,
    jobs: str = ".+",
    step: timedelta = SAMPLE_STEP,
    staleness: timedelta = timedelta(minutes=5),
    by: str = "job",
    value: str = "value",
    order: Sequence[str] = ("ts",),
) -> DataFrame:
    """(by, window_end, last, up_ratio, age_s) for every job and every step that ends in the range before `as_of`.

    last is the newest non-NULL value up to the end of the step that is younger than `staleness` there, whether the step
    has a sample or not, and NULL where there is none; age_s says how old it is. up_ratio is the share of up samples
    in the step itself. Samples from before the range count while they are not stale. A job without a sample has no rows.

    Samples are reduced to one row per job and step first. The steps of a job are cut into slices of SLICE_STEPS,
    each filled for itself; what a slice lacks at its start is carried from the slices before, of which there is one
    row per job and slice. So a job that holds a third of all samples, or a long range, is many small groups.
    """
    ts, every = order[0], step // timedelta(microseconds=1)
    kind = dict(samples.dtypes)[ts]
    key = F.struct(*order) if len(order) > 1 else F.col(ts)
    rows = samples.filter(matches(by, jobs) & F.col(value).isNotNull()).filter(in_range(samples, ts, as_of, span + staleness))
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    steps = rows.groupBy(by, step_end(ts, step).alias("_end")).agg(
        F.max_by(F.struct(F.col(value).alias("last"), micros.alias("at")), key).alias("_seen"), F.avg(value).alias("up_ratio")
    )
    epoch = datetime(1970, 1, 1, tzinfo=as_of.tzinfo)
    low, high = ((x - epoch) // timedelta(microseconds=1) for x in (as_of - span - staleness, as_of))
    first, last, shown_from = low + -low % every, high - high % every, (as_of - span - epoch) // timedelta(microseconds=1)
    width = SLICE_STEPS * every
    slices = F.sequence(F.lit(first), F.lit(max(first, last)), F.lit(width))
    sliced = steps.select(by).distinct().select(by, F.explode(slices).alias("_slice"))
    ends = F.sequence(F.col("_slice"), F.least(F.col("_slice") + width - every, F.lit(max(first, last))), F.lit(every))
    grid = sliced.select(by, "_slice", F.explode(ends).alias("_end"))
    known = grid.join(steps, [by, "_end"], "left")

    here = Window.partitionBy(by, "_slice").orderBy("_end").rowsBetween(Window.unboundedPreceding, 0)
    filled = known.withColumn("_here", F.last("_seen", ignorenulls=True).over(here))
    newest = known.groupBy(by, "_slice").agg(F.max_by("_seen", F.when(F.col("_seen").isNotNull(), F.col("_end"))).alias("_newest"))
    earlier = Window.partitionBy(by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = newest.select(by, "_slice", F.last("_newest", ignorenulls=True).over(earlier).alias("_carried"))
    seen = filled.join(carried, [by, "_slice"]).withColumn("_last", F.coalesce("_here", "_carried"))
    age = F.col("_end") - F.col("_last.at")
    fresh = age < staleness // timedelta(microseconds=1)
    return seen.filter((F.col("_end") > shown_from) & (F.col("_end") <= high)).select(
        by, F.timestamp_micros("_end").cast(kind).alias("window_end"), F.when(fresh, F.col("_last.last")).alias("last"), "up_ratio",
        F.when(fresh, age / 1e6).alias("age_s"),
    )
