"""The panels of the log and overview dashboards, as frames.

Fixed values: titles aside, the filters, ranges, legend figures and bands are those of the panels.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalake.functions import values
from vitalake.operators import logs

SERVICE = "compose_service"
DEFAULT_RANGE = timedelta(hours=1)

LOG_STEPS = {
    "errors": values.LOG_ERROR_STEPS,
    "warnings": values.LOG_WARNING_STEPS,
    "total": values.LOG_TOTAL_STEPS,
    "fatals": values.LOG_FATAL_STEPS,
}
OVERVIEW_STEPS = {
    "errors": values.OVERVIEW_ERROR_STEPS,
    "warnings": values.OVERVIEW_WARNING_STEPS,
    "fatals": values.OVERVIEW_FATAL_STEPS,
}


def log_summary(
    lines: DataFrame,
    as_of: datetime,
    span: timedelta,
    service: str = ".+",
    exclude: str | None = None,
    steps: dict = LOG_STEPS,
    ts: str = "ts",
    line: str = "line",
) -> DataFrame:
    """The counts of the stat panels and their bands in one row, from one scan of the range."""
    rows = logs.select_streams(
        lines.filter(logs.in_range(lines, ts, as_of, span)), {SERVICE: (service, exclude)}
    )
    flags = values.severity_flags(line)
    counts = rows.agg(
        F.count_if(flags["is_error"]).alias("errors"),
        F.count_if(flags["is_warning"]).alias("warnings"),
        F.count_if(flags["is_fatal"]).alias("fatals"),
        F.count("*").alias("total"),
    )
    return counts.withColumns({f"{name}_band": values.band(name, s) for name, s in steps.items()})


def _recent(lines: DataFrame, as_of: datetime, span: timedelta) -> DataFrame:
    return lines.filter(logs.in_range(lines, "ts", as_of, span))


def container_logs(
    lines: DataFrame,
    as_of: datetime,
    span: timedelta = DEFAULT_RANGE,
    service: str = ".+",
    container: str = ".+",
    step: timedelta = timedelta(minutes=1),
) -> dict[str, DataFrame]:
    """Panels and choices of the container log dashboard."""
    recent = _recent(lines, as_of, span)
    chosen = {SERVICE: (service, None)}
    # Lines of one trailing range before the shown time count in its first points.
    points = _recent(lines, as_of, span + logs.RATE_RANGE)
    rate = _shown(logs.rate(points, [SERVICE], step=step, labels=chosen), as_of, span)
    errors = _shown(
        logs.count_series(points, [SERVICE], step=step, pattern=values.ERROR_WORDS, labels=chosen), as_of, span
    )
    return {
        "summary": log_summary(lines, as_of, span, service),
        "rate": rate,
        "rate_legend": logs.series_stats(rate, [SERVICE], "rate", ("max", "mean")),
        "errors_by_service": errors.withColumn("band", values.band("n", values.ERROR_RATE_STEPS)),
        "errors_legend": logs.series_stats(errors, [SERVICE], "n", ("max", "sum")),
        "errors": logs.search(recent, chosen, values.ERROR_WORDS),
        "lines": logs.search(recent, {**chosen, "container": (container, None)}),
        "services": logs.label_values(recent, SERVICE, ".+", logs.MONITORING),
        "containers": logs.label_values(recent, "container", labels=chosen),
    }


def overview(
    lines: DataFrame,
    samples: DataFrame,
    as_of: datetime,
    span: timedelta = DEFAULT_RANGE,
    service: str = ".+",
    step: timedelta = timedelta(minutes=1),
    order: Sequence[str] = ("ts",),
) -> dict[str, DataFrame]:
    """Panels and choices of the overview dashboard, all for the shown time."""
    points = logs.select_streams(_recent(lines, as_of, span + logs.RATE_RANGE), {SERVICE: (".+", logs.MONITORING)})
    chosen = {SERVICE: (service, None)}
    rate = _shown(logs.rate(points, [SERVICE], step=step, labels=chosen), as_of, span)
    errors = _shown(
        logs.count_series(points, [SERVICE], step=step, pattern=values.ERROR_WORDS, labels=chosen), as_of, span
    )
    shown = _recent(samples, as_of, span)
    availability = logs.availability(shown, service, step, order=order)
    return {
        "status": logs.service_status(shown, order=order).withColumn("band", values.band("last", values.STATUS_STEPS)),
        "summary": log_summary(lines, as_of, logs.RATE_RANGE, ".+", logs.MONITORING, OVERVIEW_STEPS),
        "rate": rate,
        "rate_legend": logs.series_stats(rate, [SERVICE], "rate", ("max", "mean")),
        "errors_by_service": errors.withColumn("band", values.band("n", values.OVERVIEW_FATAL_STEPS)),
        "errors_legend": logs.series_stats(errors, [SERVICE], "n", ("max", "sum")),
        "availability": availability,
        "availability_legend": logs.series_stats(availability, ["job"], "last", ("last",)),
        "recent_errors": logs.search(points.filter(logs.in_range(points, "ts", as_of, span)), chosen, values.ERROR_WORDS),
        "services": logs.label_values(_recent(lines, as_of, span), SERVICE, ".+", logs.MONITORING),
    }


def _shown(series: DataFrame, as_of: datetime, span: timedelta) -> DataFrame:
    return series.filter(logs.in_range(series, "window_end", as_of, span))
