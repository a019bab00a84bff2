"""Dates with times of day that no session time zone touches: text to TIMESTAMP_NTZ and back."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillframe.functions.strftime import SHORT, spark_pattern

EPOCH = "1970-01-01 00:00:00"


def epoch() -> Column:
    return F.lit(EPOCH).cast("timestamp_ntz")


def read_clock(text: Column, pattern: str) -> Column:
    """Text in a Spark pattern without zone. It is read as UTC, so that no local clock skips or repeats an hour."""
    stamp = F.try_to_timestamp(F.concat(text, F.lit(" +0000")), F.lit(pattern + " Z"))
    return F.timestamp_add("MICROSECOND", F.unix_micros(stamp), epoch())


def whole_seconds(value: Column) -> Column:
    """Without the fraction of a second."""
    return F.timestamp_add("SECOND", F.floor(F.timestamp_diff("MICROSECOND", epoch(), value) / 1_000_000), epoch())


def clock_text(value: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss``."""
    return F.substring(value.cast("string"), 1, 19)


def _two(number: Column) -> Column:
    return F.lpad(number.cast("string"), 2, "0")


def seconds_text(seconds: Column) -> Column:
    """``HH:mm:ss`` of seconds since midnight."""
    part = lambda n, size: _two(F.floor(seconds / n) % size)
    return F.concat(part(3600, 24), F.lit(":"), part(60, 60), F.lit(":"), part(1, 60))


def write_clock(value: Column, form: str) -> Column:
    """A TIMESTAMP_NTZ in a strftime format: the time of day from its own parts, the rest from its date."""
    for k, v in SHORT.items():
        form = form.replace(f"%{k}", v)
    hour = F.hour(value)
    parts = {
        "%H": _two(hour), "%M": _two(F.minute(value)), "%S": _two(F.second(value)), "%I": _two((hour + 11) % 12 + 1), "%p": F.when(hour < 12, "AM").otherwise("PM"),
    }
    out = []
    for token in re.findall(r"%[HMSIp]|(?:(?!%[HMSIp])(?:%.|[^%]))+|%", form, re.S):
        out.append(parts[token] if token in parts else F.date_format(value.cast("date"), spark_pattern(token)))
    return F.concat(*out) if out else F.when(value.isNotNull(), F.lit(""))
