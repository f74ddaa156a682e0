"""Moments written in many formats, precisions and zones, brought to microseconds since 1970-01-01 UTC.

A text is taken apart into a local time and a mark of its zone with regular expressions on the JVM. Named zones are resolved
by an as-of join of the local time to the zone's offset intervals, which are exploded by local year: two intervals that hold
the local time mean a repeated hour, none means a skipped hour, one gives the offset directly.
"""

from __future__ import annotations

import struct
from datetime import UTC, datetime, timedelta
from functools import lru_cache
from importlib.resources import files
from pathlib import Path
from zoneinfo import TZPATH, ZoneInfo, available_timezones

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumatable.functions.instants import GENUINE, MICROS, date_exists, days_from_civil, number_us, time_exists
from lumatable.functions.text import strip_wrapping
from lumatable.runtime import spread, table

# English month names by their first three letters, and zone abbreviations with their offsets in minutes.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
ABBREVIATIONS = {
    "z": 0, "ut": 0, "utc": 0, "gmt": 0, "wet": 0, "west": 60, "bst": 60, "cet": 60, "cest": 120, "met": 60, "mest": 120,
    "eet": 120, "eest": 180, "msk": 180, "eat": 180, "ist": 330, "npt": 345, "jst": 540, "kst": 540, "awst": 480,
    "acst": 570, "acdt": 630, "aest": 600, "aedt": 660, "lhst": 630, "lhdt": 660, "nzst": 720, "nzdt": 780,
    "nst": -210, "ndt": -150, "ast": -240, "adt": -180, "est": -300, "edt": -240, "cst": -360, "cdt": -300,
    "mst": -420, "mdt": -360, "pst": -480, "pdt": -420, "akst": -540, "akdt": -480, "hst": -600,
}

#: Local years for which offset intervals are built: those the zone database is reliable for. Local times outside take the offset
#: that holds at the nearest end.
YEARS = (1970, 2038)
_WEEK = 604_800


def _tz_file(name: str) -> bytes:
    """The compiled file of a zone, from the system's database, else from the tzdata package."""
    for folder in TZPATH:
        if (path := Path(folder, name)).is_file():
            return path.read_bytes()
    return files("tzdata").joinpath("zoneinfo", *name.split("/")).read_bytes()


def _written_changes(data: bytes) -> tuple[list[tuple[int, int]], str]:
    """(second since 1970, offset from then on) of the changes that a compiled file lists, the first valid from the beginning of
    time, and its rule for later times."""

    def block(at: int, width: int) -> tuple[int, tuple]:
        isut, isstd, leap, times, types, chars = struct.unpack_from(">6l", data, at + 20)
        return at + 44 + times * (width + 1) + types * 6 + chars + leap * (width + 4) + isstd + isut, (at + 44, times, types)

    end, (at, times, types) = block(0, 4)
    if data[4:5] in (b"", b"\0"):
        raise ValueError("the zone database has files of the first version only")
    end, (at, times, types) = block(end, 8)
    moments = struct.unpack_from(f">{times}q", data, at)
    which = data[at + 8 * times : at + 9 * times]
    offsets = [struct.unpack_from(">l", data, at + 9 * times + 6 * k)[0] for k in range(types)]
    return [(-(1 << 40), offsets[0]), *((t, offsets[k]) for t, k in zip(moments, which, strict=True))], data[end:].decode().strip()


def _later_changes(zone: ZoneInfo, begin: int, end: int) -> list[tuple[int, int]]:
    """Changes of a zone's rule from `begin` on, found by weekly samples and bisection to the second."""
    origin = datetime(1970, 1, 1, tzinfo=UTC)
    offset = lambda t: int((origin + timedelta(seconds=t)).astimezone(zone).utcoffset().total_seconds())
    out, last = [], offset(begin)
    for t in range(begin + _WEEK, end + _WEEK, _WEEK):
        if (now := offset(t)) != last:
            lo, hi = t - _WEEK, t
            while hi - lo > 1:
                mid = (lo + hi) // 2
                lo, hi = (mid, hi) if offset(mid) == last else (lo, mid)
            out.append((hi, now))
            last = now
    return out


@lru_cache(maxsize=1)
def zone_intervals() -> list[tuple[str, int, int, int]]:
    """(zone in lower case, begin, until, offset) in seconds, begin and until in local time, of each zone of the public database and
    each interval that touches YEARS. About 600 zones: a fixed size."""
    begin, end = (int(datetime(y, 1, 1, tzinfo=UTC).timestamp()) for y in YEARS)
    day, far, rules, out = 86_400, 1 << 40, {}, []
    for name in sorted(available_timezones()):
        changes, rule = _written_changes(_tz_file(name))
        if "," in rule:  # summer time for ever; zones of one rule share its changes
            since = max(begin, changes[-1][0] + 1)
            if (rule, since) not in rules:
                rules[rule, since] = _later_changes(ZoneInfo(name), since, end)
            changes = changes + rules[rule, since]
        merged = [c for i, c in enumerate(changes) if i == 0 or c[1] != changes[i - 1][1]]
        for i, (at, offset) in enumerate(merged):
            until = merged[i + 1][0] if i + 1 < len(merged) else far
            if until > begin - 2 * day and at < end + 2 * day:
                out.append((name.lower(), at + offset, until + offset, offset))
    return out


def offset_table(spark: SparkSession) -> DataFrame:
    """zone, local_year, and the offset intervals that touch the year in local time, with the one before them."""
    import pyarrow as pa

    rows = zone_intervals()
    flat = pa.table({k: pa.array([r[i] for r in rows], t) for i, (k, t) in enumerate((("zone", pa.string()), ("begin", pa.int64()), ("until", pa.int64()), ("offset", pa.int32())))})
    low, high = (int(datetime(y, 1, 1, tzinfo=UTC).timestamp()) for y in YEARS)
    # an interval also serves the year in which it ends, and the year after where it ends within the last day
    year = lambda c: F.year(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.greatest(F.lit(low), F.least(F.lit(high - 1), c)) / 86_400).cast("int")))
    spans = spark.createDataFrame(flat).withColumn("local_year", F.explode(F.sequence(year(F.col("begin")), year(F.col("until") + 86_400))))
    return spans.groupBy("zone", "local_year").agg(F.sort_array(F.collect_list(F.struct("begin", "until", "offset"))).alias("__spans"))


def resolve_zone(df: DataFrame, local_s: str, zone: str, out: str, matches: str | None = None) -> DataFrame:
    """Adds `out`, the offset in seconds of the named zone at a local time in seconds; null for an unknown zone.

    The repeated hour takes the larger offset, which is the earlier instant; a skipped hour takes the offset before the change.
    `matches` names a column for the number of intervals that hold the local time: 2 in a repeated hour, 0 in a skipped one.
    """
    year = F.year(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col(local_s) / 86_400).cast("int")))
    keyed = df.withColumn("__zone", F.lower(F.col(zone))).withColumn("__year", F.when(F.col("__zone").isNotNull() & year.isNotNull(), F.greatest(F.lit(YEARS[0]), F.least(F.lit(YEARS[1] - 1), year))))
    low, high = (int(datetime(y, 1, 1, tzinfo=UTC).timestamp()) for y in YEARS)
    spans = F.broadcast(offset_table(df.sparkSession).withColumnRenamed("zone", "__zone").withColumnRenamed("local_year", "__year"))  # the public zones: a fixed size
    t = F.greatest(F.lit(low), F.least(F.lit(high - 1), F.col(local_s)))
    holding = F.filter("__spans", lambda x: (x["begin"] <= t) & (t < x["until"]))
    passed = F.filter("__spans", lambda x: x["until"] <= t)
    offset = F.when(F.size(holding) > 0, F.array_max(F.transform(holding, lambda x: x["offset"]))).otherwise(F.try_element_at(passed, F.lit(-1))["offset"])
    found = {out: F.when(F.col("__spans").isNotNull(), offset)} | ({matches: F.size(holding)} if matches else {})
    return keyed.join(spans, ["__zone", "__year"], "left").withColumns(found).drop("__zone", "__year", "__spans")


_OFFSET = r"[+-](?:0?\d|1[0-8])(?::?[0-5]\d)?"
_ZONE = rf"\s*(Z|z|(?:UTC|GMT)?{_OFFSET}|[A-Za-z]{{2,5}})?\s*(?:\[([A-Za-z_]+(?:/[A-Za-z0-9_+\-]+)*)\])?"
_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?(?:\s*([AaPp])\.?[Mm]\.?)?"
_WRITTEN = {
    "ymd": rf"^(\d{{4}})[:/-](\d{{1,2}})[:/-](\d{{1,2}})(?:(?:\s*[Tt]\s*|\s+){_CLOCK}{_ZONE})?$",
    "compact": rf"^(\d{{4}})(\d{{2}})(\d{{2}})(?:[Tt_ -]?(\d{{2}}):?(\d{{2}})(?::?(\d{{2}})(?:[.,](\d+))?)?()?{_ZONE})?$",
    "dmy": rf"^(\d{{1,2}})\.\s?(\d{{1,2}})\.\s?(\d{{4}}|\d{{2}})(?:,?\s+{_CLOCK}{_ZONE})?$",
    "mdy": rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}|\d{{2}})(?:,?\s+{_CLOCK}{_ZONE})?$",
    "mail": rf"^(?:[A-Za-z]{{3,9}}\.?,?\s+)?(\d{{1,2}})[\s-]+([A-Za-z]{{3,9}})\.?,?[\s-]+(\d{{4}}|\d{{2}})(?:,?\s+{_CLOCK}{_ZONE})?$",
    "long": rf"^(?:[A-Za-z]{{3,9}}\.?,?\s+)?([A-Za-z]{{3,9}})\.?\s+(\d{{1,2}}),?\s+(\d{{4}})(?:,?\s+{_CLOCK}{_ZONE})?$",
}
_PLACES = {"ymd": (1, 2, 3), "compact": (1, 2, 3), "dmy": (3, 2, 1), "mdy": (3, 1, 2), "mail": (3, 2, 1), "long": (3, 1, 2)}


def offset_seconds(text: Column) -> Column:
    """Seconds of an offset such as +05:30, +0530, -8, Z or UTC+2; null where it is none, or out of -18 to 18 hours."""
    t = F.regexp_replace(F.upper(strip_wrapping(text)), "^(UTC|GMT)(?=[+-])", "")
    g = lambda k: F.regexp_extract(t, r"^([+-])(\d{1,2})(?::?(\d{2}))?$", k)
    hours, minutes = g(2).try_cast("int"), F.coalesce(g(3).try_cast("int"), F.lit(0))
    value = F.when(g(1) == "-", -1).otherwise(1) * (hours * 3_600 + minutes * 60)
    return F.when(t.isin("Z", "UTC", "GMT"), 0).when((hours <= 18) & (minutes < 60), value)


def text_parts(df: DataFrame, text: str) -> DataFrame:
    """Adds what a text says: __bare_us of a bare number in UTC, __local_us of a date with or without a time, __mark (the zone
    mark in the text) and __region (a zone's name in brackets). A text without an existing date or with a time that does
    not exist gives nulls.

    Each way of writing is rewritten to the same ten parts, year|month|day|hour|minute|second|fraction|half|mark|region.
    """
    t = F.col("__text")
    df = df.withColumn("__text", strip_wrapping(F.col(text))).withColumn("__number", t.try_cast("bigint"))
    parts = F.lit(None).cast("string")
    for name, pattern in reversed(_WRITTEN.items()):
        order = [*_PLACES[name], *range(4, 11)]
        parts = F.when(t.rlike(pattern), F.regexp_replace(t, pattern, "|".join(f"${k}" for k in order))).otherwise(parts)
    number = F.when(t.rlike(r"^\d{12,19}$"), number_us("__number"))
    seconds = F.when(t.rlike(r"^\d{9,11}(?:\.\d{1,9})?$"), F.floor(t.try_cast("decimal(30,9)") * MICROS).cast("bigint"))
    df = df.withColumns({"__parts": F.split(parts, r"\|"), "__bare_us": F.coalesce(seconds, number)})
    p = lambda k: F.col("__parts")[k]
    named = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.substring(p(1), 1, 3))).cast("int")
    short = F.length(p(0)) == 2
    hour, half = p(3).try_cast("int"), F.lower(p(7))
    df = df.withColumn(
        "__n",
        F.array(
            p(0).try_cast("int") + F.when(short, 2000).otherwise(0),
            F.coalesce(p(1).try_cast("int"), named),
            p(2).try_cast("int"),
            F.when(p(3) == "", 0).when(half == "", hour).when(hour.between(1, 12), hour % 12 + F.when(half == "p", 12).otherwise(0)),
            *(F.when(p(k) == "", 0).otherwise(p(k).try_cast("int")) for k in (4, 5)),
            F.when(p(6) == "", 0).otherwise(F.rpad(F.substring(p(6), 1, 6), 6, "0").try_cast("int")),
        ),
    )
    y, m, d, h, mi, s, fraction = (F.col("__n")[k] for k in range(7))
    local = (days_from_civil(y, m, d) * 86_400 + h * 3_600 + mi * 60 + s) * MICROS + fraction
    filled = lambda k: F.when(p(k) != "", p(k))
    return df.withColumns({"__local_us": F.when(F.col("__bare_us").isNull() & date_exists(y, m, d) & time_exists(h, mi, s), local), "__mark": filled(8), "__region": filled(9)}).drop("__text", "__number", "__parts", "__n")


def text_instants(df: DataFrame, text: str, offset_time: str, time_zone: str, out: str = "instant_us", status: str | None = None) -> DataFrame:
    """Adds `out`, the instant in microseconds of a written moment, or null where the text is not readable.

    The zone is that in the text (an offset, an abbreviation, else a name in brackets), else the offset column, else the zone
    column with its summer time, else UTC. Empty or unknown zones count as absent. `status` names a column that tells how the
    instant came about: number, offset (written in the text or beside it), zone, ambiguous (a repeated hour of the zone),
    nonexistent (a skipped one), utc (no zone given) or unreadable.
    """
    df = text_parts(df, text)
    names = F.create_map(*(F.lit(x) for k, v in ABBREVIATIONS.items() for x in (k, v * 60)))
    in_text = F.coalesce(offset_seconds(F.col("__mark")), F.try_element_at(names, F.lower("__mark")))
    zone_text = strip_wrapping(F.col(time_zone))
    df = df.withColumns({"__offset": in_text, "__aside": offset_seconds(F.col(offset_time)), "__zoned": F.coalesce(offset_seconds(zone_text), F.try_element_at(names, F.lower(zone_text)))})
    df = df.withColumn("__name", F.when(F.col("__offset").isNull(), F.when(F.col("__region").isNotNull(), F.col("__region")).when(F.col("__aside").isNull(), zone_text)))
    df = resolve_zone(df.withColumn("__local_s", F.floor(F.col("__local_us") / MICROS)), "__local_s", "__name", "__named", "__matches")
    by_region = F.when(F.col("__region").isNotNull(), F.col("__named"))
    offset = F.coalesce("__offset", by_region, "__aside", "__named", "__zoned", F.lit(0))
    us = F.coalesce(F.col("__bare_us"), F.col("__local_us") - offset.cast("bigint") * MICROS)
    if status:
        named = F.when(F.col("__matches") > 1, "ambiguous").when(F.col("__matches") == 0, "nonexistent").otherwise("zone")
        how = F.when(us.isNull(), "unreadable").when(F.col("__bare_us").isNotNull(), "number").when(F.col("__offset").isNotNull(), "offset").when(by_region.isNotNull(), named)
        df = df.withColumn(status, how.when(F.col("__aside").isNotNull(), "offset").when(F.col("__named").isNotNull(), named).when(F.col("__zoned").isNotNull(), "offset").otherwise("utc"))
    return df.withColumn(out, us).drop("__bare_us", "__local_us", "__mark", "__region", "__offset", "__aside", "__zoned", "__name", "__local_s", "__named", "__matches")


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query p1_found: field_name, image_id, instant_us of each readable value of the two fields.

    Rows without an id are dropped; repeated rows come out once; an empty table gives no rows.
    """
    created = table(spark, sf_dir, "images").select(F.lit("images.created_at").alias("field_name"), F.col("id").alias("image_id"), number_us("created_at").alias("instant_us"))
    headers = spread(table(spark, sf_dir, "image_metadata").select("image_id", "capture_date", "offset_time", "time_zone"))  # texts are dear to take apart
    written = text_instants(headers, "capture_date", "offset_time", "time_zone").select(F.lit("image_metadata.capture_date").alias("field_name"), "image_id", "instant_us")
    return created.unionByName(written).where(F.col("image_id").isNotNull() & F.col("instant_us").isNotNull()).distinct()


def status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query p1_status: image_id, instant_us and status of each written moment, readable or not."""
    headers = spread(table(spark, sf_dir, "image_metadata").select("image_id", "capture_date", "offset_time", "time_zone").where("image_id is not null"))
    return text_instants(headers, "capture_date", "offset_time", "time_zone", status="status").select("image_id", "instant_us", "status").distinct()


__all__ = ["GENUINE", "found", "number_us", "offset_seconds", "resolve_zone", "text_instants"]
