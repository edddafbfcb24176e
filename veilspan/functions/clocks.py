"""Clock renderings of seconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _part(seconds: Column) -> Column:
    return F.floor(seconds).cast("int")


def minute_clock(seconds: Column) -> Column:
    """``[MM:SS]``; minutes run past 59."""
    return F.format_string("[%02d:%02d]", _part(seconds / 60), _part(seconds % 60))


def subtitle_clock(seconds: Column) -> Column:
    """``HH:MM:SS,mmm`` with truncated milliseconds."""
    return F.format_string(
        "%02d:%02d:%02d,%03d", _part(seconds / 3600), _part((seconds % 3600) / 60), _part(seconds % 60),
        _part((seconds % 1) * 1000))


def duration_label(seconds: Column) -> Column:
    """``H:MM:SS`` of whole seconds, with days when there are any."""
    s = F.floor(seconds).cast("long")
    days = F.floor(s / 86400)
    hms = F.format_string("%d:%02d:%02d", F.floor(s % 86400 / 3600), F.floor(s % 3600 / 60), s % 60)
    prefix = F.when(days == 0, "").when(days == 1, "1 day, ").otherwise(F.concat(days.cast("string"), F.lit(" days, ")))
    return F.concat(prefix, hms)
