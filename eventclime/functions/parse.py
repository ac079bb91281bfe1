"""Token typing for text sources (never throws; bad tokens become null)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_INT_TOKEN = r"^[+-]?[0-9]+$"
_DAY_TOKEN = r"^[0-9]{8}$"


def empty_to_null(c: Column) -> Column:
    """An empty token means "no value"."""
    return F.nullif(c, F.lit(""))


def parse_int(c: Column, typ: str = "int") -> Column:
    """Integer token: optional sign and digits only (no blanks, no decimals);
    anything else, or an overflow of ``typ``, gives null."""
    return F.when(c.rlike(_INT_TOKEN), c.try_cast(typ))


def parse_double(c: Column) -> Column:
    """Floating-point token; unparsable gives null."""
    return empty_to_null(c).try_cast("double")


def parse_yyyymmdd(c: Column) -> Column:
    """Strict ``yyyyMMdd`` date: eight digits forming a real calendar day."""
    return F.when(
        c.rlike(_DAY_TOKEN),
        F.try_to_timestamp(c, F.lit("yyyyMMdd")).cast("date"),
    )


def parse_flag(c: Column) -> Column:
    """Boolean token: true iff it is ``1``; empty gives null."""
    return empty_to_null(c) == F.lit("1")


def parse_token(c: Column, typ: str) -> Column:
    """Type one token by the layout's type name."""
    if typ in ("int", "long"):
        return parse_int(c, typ)
    if typ == "double":
        return parse_double(c)
    if typ == "date":
        return parse_yyyymmdd(c)
    if typ == "boolean":
        return parse_flag(c)
    return empty_to_null(c)
