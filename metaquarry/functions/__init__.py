"""Column functions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLANK = "[\\s\\x1c-\\x1f]"


def strip(c: Column | str) -> Column:
    """Without white space at either end, blanks beyond ASCII included."""
    return F.regexp_replace(c, f"(?U)^{_BLANK}+|{_BLANK}+\\z", "")


def strip_bom(c: Column | str) -> Column:
    return F.regexp_replace(c, "^\\uFEFF+", "")


def base_name(path: Column | str) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def extension(path: Column | str) -> Column:
    """The last suffix of the file name in lower case, with its dot; none for a leading dot."""
    return F.lower(F.regexp_extract(path, "[^/](\\.[^./]+)$", 1))


def stem(path: Column | str) -> Column:
    """The file name without its last suffix."""
    name = base_name(path)
    return F.when(name.rlike("^.+\\.[^.]+$"), F.regexp_replace(name, "\\.[^.]+$", "")).otherwise(name)


def relative_to(path: Column | str, root: str) -> Column:
    p = F.col(path) if isinstance(path, str) else path
    prefix = root.rstrip("/") + "/"
    return F.when(p.startswith(prefix), F.substr(p, F.lit(len(prefix) + 1))).otherwise(p)


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    return F.round(F.when(whole > 0, part * 100.0 / whole).otherwise(0.0), digits)
