"""Display formats as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
BYTE_UNITS = ["B", "KB", "MB", "GB", "TB"]


def one_decimal(value: Column) -> Column:
    """One decimal place, half up, as text."""
    return F.round(value.cast("decimal(30,6)"), 1).cast("decimal(30,1)").cast("string")


def format_bytes(n: Column) -> Column:
    """Base 1024 with one decimal: ``1.5 KB``; zero is ``0 B``; terabytes are the largest unit."""
    text = F.when(n == 0, "0 B")
    for i, unit in enumerate(BYTE_UNITS):
        value = F.concat(one_decimal(n / F.lit(float(1024**i))), F.lit(f" {unit}"))
        last = i == len(BYTE_UNITS) - 1
        text = text.otherwise(value) if last else text.when(n < 1024 ** (i + 1), value)
    return text


def format_uptime(seconds: Column) -> Column:
    """``3d 4h 5m``, ``4h 5m`` or ``5m``."""
    d, h, m = (F.floor(seconds / 86400), F.floor(seconds % 86400 / 3600), F.floor(seconds % 3600 / 60))
    minutes = F.concat(m, F.lit("m"))
    hours = F.concat(h, F.lit("h "), minutes)
    return F.when(d > 0, F.concat(d, F.lit("d "), hours)).when(h > 0, hours).otherwise(minutes)


def format_age(seconds: Column) -> Column:
    """``just now``, ``12s ago``, ``5m ago`` or ``30h ago``."""
    s = F.floor(seconds)
    return (
        F.when(s < 5, "just now")
        .when(s < 60, F.concat(s, F.lit("s ago")))
        .when(s < 3600, F.concat(F.floor(s / 60), F.lit("m ago")))
        .otherwise(F.concat(F.floor(s / 3600), F.lit("h ago")))
    )


def short_id(text: Column, n: int = 12) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("…"))).otherwise(text)


def format_percent(ratio: Column) -> Column:
    return F.concat(one_decimal(ratio * 100), F.lit("%"))
