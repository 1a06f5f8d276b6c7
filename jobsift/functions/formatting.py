"""Display formatters (N01-N05) as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def format_datetime(c, pattern: str = "MMMM dd, yyyy") -> Column:
    """``%B %d, %Y``; strings are parsed as ISO, unparseable strings are
    returned unchanged; NULL -> ``''``."""
    x = _c(c)
    ts = F.try_to_timestamp(x.cast("string"))
    return (F.when(x.isNull(), F.lit(""))
            .when(ts.isNull(), x.cast("string"))
            .otherwise(F.date_format(ts, pattern)))


def format_relative_time(c, as_of) -> Column:
    """N02: "just now", "N minutes ago", ..., "N years ago"; future -> "in the future"."""
    ts = _c(c).cast("timestamp")
    now = _c(as_of).cast("timestamp")
    sec = F.unix_timestamp(now) - F.unix_timestamp(ts)
    days = F.floor(sec / 86400)

    def plural(n, unit):
        return F.concat(n.cast("string"), F.lit(" "), F.lit(unit),
                        F.when(n == 1, F.lit("")).otherwise(F.lit("s")), F.lit(" ago"))

    return (F.when(ts.isNull(), F.lit(""))
            .when(sec < 0, F.lit("in the future"))
            .when(sec < 60, F.lit("just now"))
            .when(sec < 3600, plural(F.floor(sec / 60), "minute"))
            .when(sec < 86400, plural(F.floor(sec / 3600), "hour"))
            .when(days == 1, F.lit("yesterday"))
            .when(days < 7, plural(days, "day"))
            .when(days < 30, plural(F.floor(days / 7), "week"))
            .when(days < 365, plural(F.floor(days / 30), "month"))
            .otherwise(plural(F.floor(days / 365), "year")))


def format_currency(c, symbol: str = "$") -> Column:
    """``$`` + thousands separators + 2 decimals; unparseable unchanged."""
    x = _c(c)
    d = x.cast("string").try_cast("double")
    return (F.when(x.isNull(), F.lit(""))
            .when(d.isNull(), x.cast("string"))
            .otherwise(F.concat(F.lit(symbol), F.format_number(d, 2))))


def pluralize(n, singular: str, plural: str | None = None) -> Column:
    """The singular word if the count is 1, else the plural (default: + "s")."""
    return F.when(_c(n) == 1, F.lit(singular)).otherwise(F.lit(plural or singular + "s"))


def format_filesize(c) -> Column:
    """Bytes in 1024 steps, B/KB/MB/GB/TB, one decimal (ties round half up)."""
    b = _c(c).cast("double")
    units = ["B", "KB", "MB", "GB"]
    out = None
    for i, u in enumerate(units):
        cond = b < float(1024 ** (i + 1))
        val = F.concat(F.format_string("%.1f", F.round(b / float(1024 ** i), 1)), F.lit(" " + u))
        out = F.when(cond, val) if out is None else out.when(cond, val)
    return F.when(b.isNull(), F.lit(None)).otherwise(
        out.otherwise(F.concat(F.format_string("%.1f", F.round(b / float(1024 ** 4), 1)), F.lit(" TB"))))
