"""Joins on keys of which one may hold a third of all rows: rows are joined on the key and one of SALTS shares of it.

The side with a row for each key collects, as bits of a long, which shares the key's rows fall into, and repeats its row
for those only. So it never has more rows than the other side, and a key of one row stays one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 64


def salt(*by: Column | str) -> Column:
    """The share of a row, by what tells the rows of a key apart."""
    return F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int").alias("salt")


def bit(share: Column | str) -> Column:
    """The share as a bit, for ``bit_or``."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.col(share) if isinstance(share, str) else share)


def for_members(keys: DataFrame) -> DataFrame:
    """Rows of (..., salts) once for each share in ``salts``: (..., salt)."""
    share = F.explode(F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda i: F.getbit("salts", i) == 1))
    return keys.select("*", share.alias("salt")).drop("salts")
