"""Time columns: epoch seconds are DOUBLE, a text without a zone is UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def coerce_epoch(raw: Column) -> Column:
    """Epoch seconds from a number or an ISO text; null when neither (the caller reports it)."""
    text = F.trim(raw.cast("string"))
    return F.coalesce(text.try_cast("double"), F.unix_micros(F.try_to_timestamp(text)) / F.lit(1e6))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def path_epoch(path: Column) -> Column:
    """Epoch seconds in front of the first underscore of a screenshot's file name."""
    return F.split(base_name(path), "_")[0].try_cast("double")


def utc_now_iso() -> Column:
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _parts(total: Column) -> tuple[Column, Column, Column]:
    return F.floor(total / 3600), F.floor((total % 3600) / 60), total % 60


def duration_text(seconds: Column) -> Column:
    """1h 2m / 2m 3s / 4s, rounded half to even."""
    hours, minutes, rest = _parts(F.greatest(F.bround(seconds), F.lit(0)).cast("bigint"))
    return (
        F.when(hours > 0, F.format_string("%dh %dm", hours, minutes))
        .when(minutes > 0, F.format_string("%dm %ds", minutes, rest))
        .otherwise(F.format_string("%ds", rest))
    )


def padded_duration_text(seconds: Column) -> Column:
    """1h 02m 03s / 02m 03s, cut to whole seconds."""
    hours, minutes, rest = _parts(F.greatest(seconds.cast("bigint"), F.lit(0)))
    return F.when(hours > 0, F.format_string("%dh %02dm %02ds", hours, minutes, rest)).otherwise(
        F.format_string("%02dm %02ds", minutes, rest)
    )


def clock_text(seconds: Column) -> Column:
    """h:mm:ss, or mm:ss under an hour."""
    hours, minutes, rest = _parts(seconds.cast("bigint"))
    return F.when(hours > 0, F.format_string("%d:%02d:%02d", hours, minutes, rest)).otherwise(
        F.format_string("%02d:%02d", minutes, rest)
    )
