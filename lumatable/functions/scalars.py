"""Scalar functions of the catalogue as JVM expressions."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# File extensions and the format each stands for, and the formats that are raw files.
FORMATS = {
    "jpg": "JPEG", "jpeg": "JPEG", "png": "PNG", "webp": "WEBP", "gif": "GIF", "heif": "HEIF", "heic": "HEIF", "avif": "AVIF", "tiff": "TIFF", "tif": "TIFF",
    "orf": "RAW_ORF", "cr2": "RAW_CR2", "cr3": "RAW_CR3", "nef": "RAW_NEF", "arw": "RAW_ARW", "dng": "RAW_DNG", "raf": "RAW_RAF", "rw2": "RAW_RW2",
    "mp4": "VIDEO_MP4", "mov": "VIDEO_MOV", "m4v": "VIDEO_M4V", "mts": "VIDEO_MTS", "m2ts": "VIDEO_M2TS", "avi": "VIDEO_AVI", "mkv": "VIDEO_MKV", "3gp": "VIDEO_3GP", "webm": "VIDEO_WEBM",
}
COLORS = ("none", "red", "yellow", "green", "blue", "purple")
EDIT_SUFFIXES = ("_modified", "_edit", "_edited", "-edit")
# The orientation after a quarter turn, for orientations 1 to 8.
CLOCKWISE, COUNTERCLOCKWISE = (6, 7, 8, 5, 2, 3, 4, 1), (8, 5, 6, 7, 4, 1, 2, 3)


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^./\\]+)$", 1))


def stem(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(name, r"^.*/", ""), r"(?<=.)\.[^.]*$", "")


def directory(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def base_stem(name: Column) -> Column:
    """The stem without one edit suffix; suffixes are told apart by letter case."""
    return F.regexp_replace(stem(name), f"(?:{'|'.join(EDIT_SUFFIXES)})$", "")


def is_edited_variant(name: Column) -> Column:
    return base_stem(name) != stem(name)


def format_of(name: Column) -> Column:
    """The format a file's extension stands for, else UNKNOWN."""
    return F.coalesce(F.try_element_at(_format_map(), extension(name)), F.lit("UNKNOWN"))


def _format_map() -> Column:
    return F.expr("map(" + ", ".join(f"'{x}'" for kv in FORMATS.items() for x in kv) + ")")  # parsed at once


def stored_format(text: Column) -> Column:
    """A stored format, which may be a format's name or a file extension; other text gives UNKNOWN."""
    return F.when(F.array_contains(F.expr("array(" + ", ".join(f"'{x}'" for x in sorted(set(FORMATS.values()))) + ")"), text), text).otherwise(F.coalesce(F.try_element_at(_format_map(), F.lower(text)), F.lit("UNKNOWN")))


def is_raw(fmt: Column) -> Column:
    return F.coalesce(stored_format(fmt).startswith("RAW_"), F.lit(False))


def is_video(fmt: Column) -> Column:
    return F.coalesce(stored_format(fmt).startswith("VIDEO_"), F.lit(False))


def color_number(name: Column) -> Column:
    """The number of a colour label's English name; null for other text."""
    low = F.lower(name)
    return reduce(lambda acc, kv: acc.when(low == kv[1], kv[0]), enumerate(COLORS), F.when(F.lit(False), 0))


def color_name(label: Column) -> Column:
    return F.try_element_at(F.array(*map(F.lit, COLORS)), F.when(label.between(0, 5), label + 1))


def darktable_color(label: Column) -> Column:
    """The index 0 to 4 used in sidecars for labels 1 to 5; null for none."""
    return F.when(label.between(1, 5), label - 1)


def flag_of_word(word: Column) -> Column:
    low = F.lower(word)
    return F.when(low.isin("pick", "picked"), 1).when(low.isin("reject", "rejected"), -1).otherwise(0)


def visible() -> Column:
    """Files that are not hidden, in a form the scan takes."""
    return F.col("hidden").isNull() | (F.col("hidden") == F.lit(False))


def clamp(c: Column, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def rotate(orientation: Column, clockwise: bool = True) -> Column:
    """The orientation after a quarter turn; null and invalid ones count as 1."""
    o = F.when(orientation.between(1, 8), orientation).otherwise(1)
    return F.element_at(F.array(*map(F.lit, CLOCKWISE if clockwise else COUNTERCLOCKWISE)), o)


def display_aspect(width: Column, height: Column, orientation: Column) -> Column:
    """Width by height as shown; 3:2 where unknown, turned for orientations 5 to 8."""
    a = F.when((width > 0) & (height > 0), width / height).otherwise(1.5)
    return F.when(orientation.between(5, 8), 1 / a).otherwise(a)


def format_exposure(seconds: Column) -> Column:
    return F.when(seconds <= 0, None).when(seconds < 1, F.concat(F.lit("1/"), F.round(1 / seconds).cast("int").cast("string"))).otherwise(F.regexp_replace(seconds.cast("string"), r"\.0$", ""))


def format_duration(seconds: Column, hours: bool = True) -> Column:
    s = F.floor(seconds).cast("bigint")
    short = F.concat(F.floor(s / 60).cast("string"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))
    long = F.concat(F.floor(s / 3600).cast("string"), F.lit(":"), F.lpad(F.floor(s % 3600 / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))
    return F.when(s >= 3600, long).otherwise(short) if hours else short


def duration_of_metadata(metadata: Column) -> Column:
    """A text `duration`, else a numeric duration_seconds or duration as M:SS, which never shows hours; broken JSON gives null."""
    text, seconds = F.get_json_object(metadata, "$.duration"), F.get_json_object(metadata, "$.duration_seconds").try_cast("double")
    number = text.try_cast("double")
    return F.when(text.isNotNull() & number.isNull(), text).otherwise(format_duration(F.coalesce(seconds, number), hours=False))


def gps_coordinate(degrees: Column, minutes: Column, seconds: Column, hemisphere: Column) -> Column:
    value = (degrees + minutes / 60 + seconds / 3600) * F.when(F.upper(hemisphere).isin("S", "W"), -1).otherwise(1)
    most = F.when(F.upper(hemisphere).isin("N", "S"), 90).otherwise(180)
    return F.when(F.abs(value) <= most, value)


def target_size(width: Column, height: Column, edge: int) -> tuple[Column, Column]:
    """Width and height that fit the long edge, never enlarged, at least 1."""
    scale = F.least(F.lit(1.0), F.lit(float(edge)) / F.greatest(width, height))
    return tuple(F.greatest(F.lit(1), F.round(c * scale).cast("int")) for c in (width, height))


def percent_of(value: Column, reference: Column) -> Column:
    return F.when(reference > 0, F.round(value / reference * 100).cast("int"))


def grade(percent: Column, eyes: bool = True) -> Column:
    bad, poor, fair = (50, 65, 80) if eyes else (8, 20, 50)
    return F.when(percent < bad, "Bad").when(percent < poor, "Poor").when(percent < fair, "Fair").when(percent.isNotNull(), "Good")


def filename_from_template(template: str, name: Column, second: Column, ext: Column) -> Column:
    """A name by a template with {name}, {ext}, {date} and {date:%Y%m%d}; undated gives blanks, a missing extension is added."""
    import re

    # Strftime codes and their Java patterns.
    codes = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%y": "yy", "%j": "DDD"}
    out, last = [], 0
    for m in re.finditer(r"\{(name|ext|date)(?::([^}]*))?\}", template):
        out.append(F.lit(template[last : m.start()]))
        if m.group(1) == "date":
            pattern = re.sub(r"%[YmdHMSyj]", lambda x: "'" + codes[x.group()] + "'", m.group(2) or "%Y-%m-%d")
            java = "".join(p if k % 2 else (f"'{p}'" if p else "") for k, p in enumerate(pattern.split("'")))
            out.append(F.coalesce(F.date_format(F.timestamp_seconds(second), java), F.lit("")))
        else:
            out.append(name if m.group(1) == "name" else ext)
        last = m.end()
    out.append(F.lit(template[last:]))
    made = F.concat(*out)
    return made if "{ext}" in template else F.concat(made, F.lit("."), ext)


def thumb_path(digest: Column, size: str) -> Column:
    return F.concat_ws("/", F.lit(size), F.substring(digest, 1, 2), F.concat(digest, F.lit(".jpg")))


def day_of(second: Column) -> Column:
    """Number of the day since 1970, by floor division."""
    return F.floor(second / 86_400).cast("bigint")


def day_bounds(year: Column, month: Column, day: Column) -> Column:
    """First and last second of a day as a struct (start, end); a date that does not exist gives 0 and 0."""
    start = F.unix_date(F.try_to_date(F.format_string("%04d-%02d-%02d", year, month, day), "yyyy-MM-dd")).cast("bigint") * 86_400
    return F.struct(F.coalesce(start, F.lit(0)).cast("bigint").alias("start"), F.coalesce(start + 86_399, F.lit(0)).cast("bigint").alias("end"))


def parse_wall_clock(text: Column) -> Column:
    """Seconds of `2024-05-01 12:30:00`, with or without seconds; null for other text."""
    t = F.trim(text)
    return F.unix_seconds(F.coalesce(F.try_to_timestamp(t, F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(t, F.lit("yyyy-MM-dd HH:mm"))))


def format_wall_clock(second: Column) -> Column:
    return F.date_format(F.timestamp_seconds(second), "yyyy-MM-dd HH:mm:ss")


def describe_shift(delta: Column) -> Column:
    """A difference in seconds as +1d 02:03:04."""
    s = F.abs(delta)
    clock = F.format_string("%02d:%02d:%02d", F.floor(s % 86_400 / 3600), F.floor(s % 3600 / 60), s % 60)
    days = F.floor(s / 86_400)
    return F.when(delta.isNotNull(), F.concat(F.when(delta < 0, "-").otherwise("+"), F.when(days > 0, F.concat(days.cast("string"), F.lit("d "))).otherwise(""), clock))


def format_bytes(n: Column) -> Column:
    shown = lambda unit, name: F.format_string(f"%.1f {name}", F.bround(n / unit, 1))
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024 * 1024, shown(1024.0, "KB")).when(n.isNotNull(), shown(1024.0 * 1024.0, "MB"))


def section_title(second: Column, n: Column) -> Column:
    """The header of a day: its date in words, and how many photos it has."""
    date = F.coalesce(F.date_format(F.timestamp_seconds(second), "EEEE, MMMM d, yyyy"), F.lit("Unknown Date"))
    return F.concat(date, F.lit("  ·  "), n.cast("string"), F.when(n == 1, " photo").otherwise(" photos"))


def capture_moment(**sources: Column) -> Column:
    """The capture moment by the order of trust: original, digitized, xmp, tool, container (videos only, above 0), modified, mtime.
    Sources that are not given count as null."""
    container = sources.get("container")
    order = [sources.get("original"), sources.get("digitized"), sources.get("xmp"), sources.get("tool"), None if container is None else F.when(container > 0, container), sources.get("modified"), sources.get("mtime")]
    given = [c for c in order if c is not None]
    return F.coalesce(*given) if given else F.lit(None).cast("bigint")


def step_index(index: Column, by: Column, n: Column) -> Column:
    """An index moved round a list of n entries, in either direction; null for an empty list."""
    return F.when(n > 0, F.pmod(index + by, n))


# The first bytes of files, in hexadecimal, where they begin, and the kind of content they tell.
SIGNATURES = (
    (0, "ffd8ff", "image/jpeg"), (0, "89504e470d0a1a0a", "image/png"), (0, "474946", "image/gif"), (8, "57454250", "image/webp"), (8, "41564920", "video/x-msvideo"),
    (8, "43520200", "image/x-canon-cr2"), (0, "49492a00", "image/tiff"), (0, "4d4d002a", "image/tiff"), (4, "6674797068656963", "image/heif"), (4, "667479706d696631", "image/heif"), (4, "6674797061766966", "image/avif"),
    (4, "6674797071742020", "video/quicktime"), (4, "6674797069736f6d", "video/mp4"), (4, "667479706d703432", "video/mp4"), (4, "667479704d3456", "video/x-m4v"), (0, "1a45dfa3", "video/x-matroska"),
)


def mime_of_content(content: Column) -> Column:
    """The kind of content by the first bytes of a file; null where they tell nothing."""
    head = F.lower(F.hex(F.substring(content, 1, 24)))
    out = F.lit(None).cast("string")
    for place, code, kind in reversed(SIGNATURES):
        out = F.when(F.substring(head, 2 * place + 1, len(code)) == code, kind).otherwise(out)
    return out


def xml_unescape(c: Column) -> Column:
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def xml_escape(c: Column) -> Column:
    for entity, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'")):
        c = F.replace(c, F.lit(char), F.lit(entity))
    return c


def percent_decode(c: Column) -> Column:
    """%XX decoded; a plus stays a plus, as in paths."""
    return F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))


def search_words(text: str) -> list[str]:
    """Words of a search text, each a space-separated phrase of its tokens; words without letters and digits drop out."""
    import regex

    out = [" ".join(regex.findall(r"[\p{L}\p{N}]+", w)) for w in text.split()]
    return [w for w in out if w]


def fold_word(word: str) -> str:
    """A word as the search compares it: without regard to case and accents."""
    return "".join(c for c in unicodedata.normalize("NFD", word.casefold()) if not unicodedata.combining(c))


def begins_with(token: Column, word: str) -> Column:
    """Whether a token in lower case begins with a folded word; only tokens of other than plain letters need the collation."""
    collated = F.startswith(F.collate(token, "UNICODE_CI_AI"), F.collate(F.lit(word), "UNICODE_CI_AI"))
    return F.when(F.length(token) == F.octet_length(token), F.startswith(token, F.lit(word))).otherwise(collated)


def matches_text(text: str, columns: list[str]) -> Column:
    """Whether each word of `text` begins a word in one of the columns, without regard to case and accents. A text without any
    word matches nothing.

    The columns are cleaned once, as one text with a mark between them that no phrase can pass; rows of plain letters are compared
    as they are, only others by the collation.
    """
    words = search_words(text)
    if not words:
        return F.lit(False)
    cleaned = F.regexp_replace(F.concat(F.lit(" "), F.concat_ws(" \x1f ", *columns)), r"[^\p{L}\p{N}\x1f]+", " ")
    plain = lambda x: F.length(x) == F.octet_length(x)
    hit = lambda x, w: F.when(plain(x), F.contains(F.lower(x), F.lit(f" {fold_word(w)}"))).otherwise(F.contains(F.collate(x, "UNICODE_CI_AI"), F.collate(F.lit(f" {w}"), "UNICODE_CI_AI")))
    return F.exists(F.array(cleaned), lambda x: reduce(lambda a, b: a & b, (hit(x, w) for w in words)))
