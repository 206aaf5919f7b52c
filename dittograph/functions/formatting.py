"""Numbers as people read them."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F


class SizeUnit(Enum):
    AUTO = "Auto"
    BYTES = "Bytes"
    KB = "KB"
    MB = "MB"
    GB = "GB"
    TB = "TB"


_UNITS = "B KB MB GB TB".split()



def _scaled(size: Column, power: int) -> Column:
    text = (size.cast("double") / F.lit(float(1024**power))).cast("decimal(38,2)").cast("string")
    return F.concat(F.regexp_replace(text, r"\.?0+$", ""), F.lit(" " + _UNITS[power]))


def format_size(size: Column, unit: SizeUnit = SizeUnit.AUTO, max_unit: str = "TB") -> Column:
    """Bytes as text: in a fixed unit, or in the largest that leaves at least 1, up to ``max_unit``."""
    if unit is SizeUnit.BYTES:
        return F.concat(size.cast("long").cast("string"), F.lit(" B"))
    if unit is not SizeUnit.AUTO:
        return _scaled(size, _UNITS.index(unit.value))
    top = _UNITS.index(max_unit)
    out = F.when(size < 1024, F.concat(size.cast("long").cast("string"), F.lit(" B")))
    for power in range(1, top):
        out = out.when(size < 1024 ** (power + 1), _scaled(size, power))
    return out.otherwise(_scaled(size, top))


def format_percent(share: Column) -> Column:
    """A share of 1 as whole percent."""
    return F.concat(F.floor(share * 100 + 0.5).cast("string"), F.lit("%"))


def counted(n: Column, noun: str) -> Column:
    """``3 files``: thousands grouped, an s unless it is one."""
    return F.concat(F.format_number(n, 0), F.lit(f" {noun}"), F.when(n == 1, "").otherwise("s"))


def format_date(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd")


def usage_band(share: Column) -> Column:
    """Band of a drive's used share."""
    return F.when(share < 0.75, "normal").when(share < 0.9, "warning").otherwise("critical")


def parse_megabytes(text: str | None) -> int:
    """A size limit that a user typed: whole, not negative; blank is 0, which means none."""
    text = (text or "").strip()
    if not text:
        return 0
    if not text.isascii() or not text.isdigit():
        raise ValueError(f"not a whole number of megabytes: {text!r}")
    return int(text)
