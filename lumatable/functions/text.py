"""Text cleaning shared by the operators, as JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that surround a value without belonging to it: white space of any kind, NUL, byte-order mark, quotes.
_SPACE = "".join(map(chr, [0, *range(0x9, 0xE), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))
_QUOTES = "\"'\u2018\u2019\u201c\u201d\u00ab\u00bb`"


def strip_space(c: Column) -> Column:
    """`c` without white space at its ends."""
    return F.btrim(c, F.lit(_SPACE))


def strip_wrapping(c: Column) -> Column:
    """`c` without white space, NULs and quotes at its ends."""
    return F.btrim(c, F.lit(_SPACE + _QUOTES))


def path_parts(path: Column) -> Column:
    """Parts of a written path: split at | or /, trimmed, empty parts dropped, in lower case; null gives none."""
    split = F.split(F.translate(F.lower(F.coalesce(path, F.lit(""))), "/", "|"), r"\|")
    return F.filter(F.transform(split, strip_space), lambda x: x != "")


def camera_key(c: Column) -> Column:
    """A camera's name in lower case without surrounding white space, NULs and quotes; null where nothing is left."""
    name = F.lower(strip_wrapping(c))
    return F.when(name != "", name)
