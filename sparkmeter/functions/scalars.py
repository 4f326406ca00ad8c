"""Scalar expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, and 0.0 for a zero whole."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / whole)


def seconds(ts: Column) -> Column:
    """Whole epoch seconds of a timestamp without zone, whatever the session's zone."""
    days = F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date"))
    return (days * F.lit(DAY).cast("long") + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.floor(F.second(ts))).cast("long")


def utc_day(secs: Column) -> Column:
    """YYYY-MM-DD of epoch seconds."""
    return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(secs / DAY).cast("int")), "yyyy-MM-dd")


def iso_seconds(text: Column) -> Column:
    """Epoch seconds of YYYY-MM-DDTHH:MM:SS[.d+]Z, else null: no offsets; a day past the month's end rolls over; not before 1970."""
    shape = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?Z$"
    y, mo, d, h, mi, s = (F.substring(text, at, n).try_cast("int") for at, n in ((1, 4), (6, 2), (9, 2), (12, 2), (15, 2), (18, 2)))
    ok = mo.between(1, 12) & d.between(1, 31) & (h <= 23) & (mi <= 59) & (s <= 60)
    days = F.datediff(F.date_add(F.make_date(y, mo, F.lit(1)), d - 1), F.lit("1970-01-01").cast("date"))
    total = days.cast("long") * DAY + h * 3600 + mi * 60 + s
    return F.when(text.rlike(shape) & ok & ((y >= 1970) | (total >= 0)), total)


def bytes_of(text: Column) -> Column:
    return F.octet_length(text)


def approx_tokens(count: Column) -> Column:
    """Four bytes a token, rounded up."""
    return F.ceil(count / 4).cast("long")


def byte_prefix(text: Column, n: int) -> Column:
    """The first n bytes, less a character that they cut."""
    head = F.substring(text, 1, n)
    # at most n characters; drop characters from the end until the bytes fit
    whole = F.octet_length(head) <= n
    sizes = F.transform(F.split(head, ""), lambda c: F.octet_length(c))
    fit = F.aggregate(sizes, F.struct(F.lit(0).alias("b"), F.lit(0).alias("c")), lambda s, x: F.when(s["b"] + x <= n, F.struct((s["b"] + x).alias("b"), (s["c"] + 1).alias("c"))).otherwise(F.struct(F.lit(n + 1).alias("b"), s["c"].alias("c"))), lambda s: s["c"])
    return F.when(whole, head).otherwise(F.substring(head, F.lit(1), fit))


def digit_runs(text: Column) -> Column:
    """Runs of digits, commas between two digits removed first; each once."""
    plain = F.regexp_replace(text, r"(?<=[0-9]),(?=[0-9])", "")
    return F.array_distinct(F.regexp_extract_all(plain, F.lit(r"([0-9]+)"), 1))
