"""Numbers and texts that record a moment, as JVM expressions over whole columns.

Everything here is plain integer arithmetic, so that results do not depend on the session's time zone.
"""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Genuine moments lie in [2012-01-01, 2026-01-01), in seconds since 1970.
GENUINE = (1_325_376_000, 1_767_225_600)

#: Ticks a second, and seconds from the epoch to 1970, of the countings in use. Their genuine ranges do not overlap.
#: Epochs: 1970 (Unix), 1904 (QuickTime), 2001 (Cocoa), 1601 (Windows, in ticks of 100 ns or as milliseconds).
COUNTINGS = (
    *((unit, 0) for unit in (1, 1_000, 1_000_000, 1_000_000_000)),
    *((unit, 2_082_844_800) for unit in (1, 1_000, 1_000_000, 1_000_000_000)),
    *((unit, -978_307_200) for unit in (1, 1_000, 1_000_000)),
    (10_000_000, 11_644_473_600),
    (1_000, 11_644_473_600),
)

MICROS = 1_000_000


def days_from_civil(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 of a date that exists; to be guarded by date_exists."""
    return F.unix_date(F.make_date(y, m, d)).cast("bigint")


def date_exists(y: Column, m: Column, d: Column) -> Column:
    """Whether the calendar has the date; year 0 does not exist."""
    leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    last = F.when(m.isin(4, 6, 9, 11), 30).when(m == 2, F.when(leap, 29).otherwise(28)).otherwise(31)
    return (y >= 1) & m.between(1, 12) & (d >= 1) & (d <= last)


def time_exists(h: Column, mi: Column, s: Column) -> Column:
    return h.between(0, 23) & mi.between(0, 59) & s.between(0, 59)


#: Microseconds of a number x written as the digits YYYYMMDDhhmmss, else null; in SQL, as the text is parsed at once where building it
#: from columns would take hundreds of calls.
_DIGITS = """
x -> CASE WHEN x div 10000000000 >= 1 AND x div 100000000 % 100 BETWEEN 1 AND 12 AND x div 1000000 % 100 >= 1
 AND x div 1000000 % 100 <= CASE WHEN x div 100000000 % 100 IN (4, 6, 9, 11) THEN 30 WHEN x div 100000000 % 100 = 2 THEN
  CASE WHEN x div 10000000000 % 4 = 0 AND (x div 10000000000 % 100 <> 0 OR x div 10000000000 % 400 = 0) THEN 29 ELSE 28 END ELSE 31 END
 AND x div 10000 % 100 <= 23 AND x div 100 % 100 <= 59 AND x % 100 <= 59
THEN (unix_date(make_date(CAST(x div 10000000000 AS INT), CAST(x div 100000000 % 100 AS INT), CAST(x div 1000000 % 100 AS INT))) * 86400L + x div 10000 % 100 * 3600 + x div 100 % 100 * 60 + x % 100) * 1000000L END"""


def number_us(name: str, years: tuple[int, int] = GENUINE) -> Column:
    """Microseconds since 1970 of the numbers in a column, of an unknown unit, epoch or notation, else null.

    Units and epochs are told apart by where the value comes to lie: only one choice falls into the genuine years, which `years` gives
    as seconds since 1970; for other years the first of COUNTINGS that fits counts. Null, 0 and negative numbers, and numbers
    that fall nowhere, are no time.
    """
    v, (low, high) = f"CAST(`{name}` AS BIGINT)", years
    cases = []
    for unit, epoch in COUNTINGS:
        scaled = f"({v} - {epoch * unit}L)"
        us = f"{scaled} * {MICROS // unit}L" if unit <= MICROS else f"{scaled} div {unit // MICROS}L"
        cases.append(f"WHEN {v} >= {(low + epoch) * unit}L AND {v} < {min((high + epoch) * unit, 2**63 - 1)}L THEN {us}")
    first, last = (int(datetime.fromtimestamp(t, UTC).strftime("%Y%m%d")) for t in (low, high - 1))
    stamp = f"CASE WHEN {v} BETWEEN {first * 10**6}L AND {last * 10**6 + 235_959}L THEN {v} WHEN {v} BETWEEN {first * 10**9}L AND {last * 10**9 + 235_959_999}L THEN {v} div 1000L WHEN {v} BETWEEN {first}L AND {last}L THEN {v} * 1000000L END"
    # a lambda, so that the code of the calendar is made once and not for each use of the stamp
    digits = f"transform(array({stamp}), {_DIGITS})[0] + CASE WHEN {v} > {10**16}L THEN {v} % 1000L ELSE 0L END * 1000L"
    return F.expr(f"CASE WHEN {v} IS NULL OR {v} <= 0 THEN NULL {' '.join(cases)} ELSE {digits} END")
