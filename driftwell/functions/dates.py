"""Date functions as columns. Dates are texts (YYYY-MM-DD...), ordered and compared as texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Short month names and full ones, as the pages print them.
MONTHS_SHORT = "jan fev mar abr mai jun jul ago set out nov dez".split()
MONTHS_LONG = "janeiro fevereiro março abril maio junho julho agosto setembro outubro novembro dezembro".split()


def _part(iso: Column, at: int, n: int) -> Column:
    return F.substring(iso, at, n).try_cast("int")


def _month(iso: Column) -> Column:
    return F.get(F.array(*[F.lit(m) for m in MONTHS_SHORT]), _part(iso, 6, 2) - 1)


def fmt_date(iso: Column) -> Column:
    """'2026-09-26...' -> '26 set 2026'; what is no date stays as it is; null stays null."""
    good = iso.rlike(r"\A\d{4}-\d{2}-\d{2}") & (_part(iso, 1, 4) > 0) & (_part(iso, 6, 2).between(1, 12)) & (_part(iso, 9, 2) > 0)
    return F.when(good, F.concat_ws(" ", _part(iso, 9, 2).cast("string"), _month(iso), _part(iso, 1, 4).cast("string"))).otherwise(iso)


def fmt_range(start: Column, end: Column) -> Column:
    """Four shapes: one day, one month, one year, else two full dates; texts that are no dates stand as they are."""
    day = lambda c: _part(c, 9, 2).cast("string")
    shaped = start.rlike(r"\A\d{4}-\d{2}-\d{2}") & end.rlike(r"\A\d{4}-\d{2}-\d{2}")
    same_year, same_month = shaped & (_part(start, 1, 4) == _part(end, 1, 4)), _part(start, 6, 2) == _part(end, 6, 2)
    one_month = F.concat(day(start), F.lit("–"), day(end), F.lit(" "), _month(start), F.lit(" "), F.substring(start, 1, 4))
    one_year = F.concat(day(start), F.lit(" "), _month(start), F.lit(" – "), day(end), F.lit(" "), _month(end), F.lit(" "), F.substring(start, 1, 4))
    return (
        F.when(start.isNull(), None)
        .when(end.isNull() | (end == start), fmt_date(start))
        .when(same_year & same_month, one_month)
        .when(same_year, one_year)
        .otherwise(F.concat(fmt_date(start), F.lit(" – "), fmt_date(end)))
    )


def slashes(iso: Column) -> Column:
    """'2026-07-10...' -> '10/07/2026'; '' for null."""
    return F.when(iso.isNull() | (iso == ""), "").otherwise(F.concat(F.substring(iso, 9, 2), F.lit("/"), F.substring(iso, 6, 2), F.lit("/"), F.substring(iso, 1, 4)))


def month_before(day: str) -> Column:
    """The day a month earlier by calendar overflow: 2026-03-31 -> 2026-03-03 (there is no 31st of February)."""
    d = F.lit(day).cast("date")
    return F.date_format(F.date_add(F.add_months(F.trunc(d, "MM"), -1), F.dayofmonth(d) - 1), "yyyy-MM-dd")


def gmt_suffix(text: Column) -> Column:
    """A GMT time without zone gets +00:00."""
    return F.when(text.isNull() | (text == ""), None).when(text.endswith("Z") | text.endswith("+00:00"), text).otherwise(F.concat(text, F.lit("+00:00")))


def slash_date(text: Column) -> Column:
    """'2026/07/10' -> '2026-07-10'."""
    return F.nullif(F.replace(text, F.lit("/"), F.lit("-")), F.lit(""))


def range_ends(text: Column) -> Column:
    """Struct (starts, ends): first and last of all YYYY/MM/DD in a text; one date is both; none is null."""
    found = F.regexp_extract_all(text, F.lit(r"\d{4}/\d{2}/\d{2}"), F.lit(0))
    some = F.size(found) > 0
    return F.struct(F.when(some, slash_date(F.get(found, F.lit(0)))).alias("starts"), F.when(some, slash_date(F.try_element_at(found, F.lit(-1)))).alias("ends"))


def span_days(first: Column, last: Column) -> Column:
    """Days between two ISO times, 0.01 at least; 0.01 too if either cannot be read."""
    seconds = F.unix_micros(last.try_cast("timestamp")) - F.unix_micros(first.try_cast("timestamp"))
    return F.coalesce(F.greatest(seconds / F.lit(86400e6), F.lit(0.01)), F.lit(0.01))


def minute_text(iso: Column) -> Column:
    """'2026-07-10T12:34:56' -> '2026-07-10 12:34 UTC', a dash for null."""
    return F.coalesce(F.concat(F.substring(F.replace(iso, F.lit("T"), F.lit(" ")), 1, 16), F.lit(" UTC")), F.lit("—"))
