"""Reproducible random draws: the same number for the same parts, in any partitioning and engine."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def u01(*parts) -> Column:
    """Uniform number in [0, 1): the first 8 hex digits of md5 of the parts joined by ``|``."""
    cols = [(p if isinstance(p, Column) else F.lit(p)).cast("string") for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *cols)), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def above(p: float, *parts) -> Column:
    """Whether u01 of the parts is more than p, told from the hash's digits without making a number of them."""
    least = math.floor(p * 2**32) + 1
    cols = [(x if isinstance(x, Column) else F.lit(x)).cast("string") for x in parts]
    return F.md5(F.concat_ws("|", *cols)) >= f"{least:08x}" if least < 2**32 else F.lit(False)


def r6(c) -> Column:
    """Round to six places, without a negative zero."""
    return F.round(c, 6) + F.lit(0.0)


def stripped(c) -> Column:
    """Text without ASCII white space at either end."""
    return F.btrim(c if isinstance(c, Column) else F.col(c), F.lit(" \t\n\x0b\f\r"))


def words_of(c) -> Column:
    """Words between white space; an empty text has none."""
    s = stripped(c)
    return F.when(F.length(s) == 0, F.array().cast("array<string>")).otherwise(F.split(s, r"\s+"))


def terms_of(c) -> Column:
    """Lower-case terms of two or more letters, digits or underscores."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}_]{2,})"), 1)
